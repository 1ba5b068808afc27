"""Class lineage from facts: resolved bases, closure, and where evidence lies in the tree of targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiberloom.operators import graph
from fiberloom.operators import matching as m
from fiberloom.scratch import settle
from fiberloom.sources.code import family


def class_table(facts: DataFrame) -> DataFrame:
    """(symbol, name, module, path, line, end_line, bases)."""
    qual = F.when(F.col("owner") == "", F.col("name")).otherwise(F.concat_ws(".", "owner", "name"))
    return family(facts, "class").select(F.concat_ws(".", "module", qual).alias("symbol"), "name", "module", "path", "line", "end_line", F.col("items").alias("bases"), "numbers")


def resolved_bases(facts: DataFrame) -> DataFrame:
    """(symbol, base, resolved, how): by import alias, module, unique suffix, then unique simple name; else unresolved.

    A suffix or simple name that several classes have resolves nothing.
    """
    classes = settle(class_table(facts), "classes")
    imports = family(facts, "import").select("module", F.col("name").alias("head"), F.col("value").alias("target")).dropDuplicates(["module", "head"])
    asked = classes.select("symbol", "module", F.explode("bases").alias("base")).withColumn("head", F.substring_index("base", ".", 1))
    asked = asked.withColumn("rest", F.expr("substring(base, length(head) + 1)")).join(imports, ["module", "head"], "left")
    asked = asked.withColumn("full", F.coalesce(F.concat("target", "rest"), F.col("base"))).withColumn("local", F.concat_ws(".", "module", "base")).withColumn("simple", F.substring_index("base", ".", -1))
    exact = classes.select(F.col("symbol").alias("name"), F.col("symbol").alias("target")).distinct()
    suffix, simple = m.unique_suffixes(classes, "symbol"), m.unique_only(classes, "name", "symbol")
    for column, table, to in (("full", exact, "_alias"), ("local", exact, "_local"), ("full", suffix, "_suffix"), ("simple", simple, "_simple")):
        asked = asked.join(table.select(F.col("name").alias(column), F.col("target").alias(to)), column, "left")
    how = F.when(F.col("_alias").isNotNull(), "import").when(F.col("_local").isNotNull(), "module").when(F.col("_suffix").isNotNull(), "suffix").when(F.col("_simple").isNotNull(), "simple").otherwise("unresolved")
    return asked.select("symbol", "base", F.coalesce("_alias", "_local", "_suffix", "_simple").alias("resolved"), how.alias("how"))


def lineage(facts: DataFrame) -> DataFrame:
    """(descendant, ancestor, depth) over resolved bases; of settled facts it is closed once and kept with them."""
    kept = getattr(facts, "closed_lineage", None)
    if kept is None:
        kept = graph.closure(resolved_bases(facts).where("resolved is not null"), "symbol", "resolved")
        if hasattr(facts, "settled_at"):
            facts.closed_lineage = kept
    return kept


def targets(facts: DataFrame) -> DataFrame:
    """(path, qualname, kind, line, end_line) of modules, classes and functions."""
    qual = F.concat_ws(".", F.nullif("owner", F.lit("")), F.nullif("func", F.lit("")), "name")
    inner = family(facts, "class", "method", "function").select("path", qual.alias("qualname"), F.col("family").alias("kind"), "line", "end_line")
    whole = facts.groupBy("path", "module").agg(F.max("end_line").alias("end_line")).select("path", F.col("module").alias("qualname"), F.lit("module").alias("kind"), F.lit(1).cast("long").alias("line"), "end_line")
    return inner.unionByName(whole)


def evidence_targets(evidence: DataFrame, target: DataFrame) -> DataFrame:
    """Targets that hold each evidence row (path, at, symbol): those named by the symbol, else non-modules, else modules."""
    held = m.contained(evidence, target, ["path"], "at", "line", "end_line")
    named = (F.col("qualname") == F.col("symbol")) | F.col("symbol").endswith(F.concat(F.lit("."), "qualname")) | F.col("qualname").endswith(F.concat(F.lit("."), "symbol"))
    tier = F.when(named, 0).when(F.col("kind") != "module", 1).otherwise(2)
    return m.best_tier(held, ["path", "at", "symbol"], tier)
