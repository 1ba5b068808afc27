"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources get water-filled word budgets.  A budget of more than a source's size takes complete epochs
first; the fraction that is left goes to documents in ascending order of an exponential key
``-ln(u) / quality``, prefix-summed up to the budget (the last one is cut to meet it).

Keys are first counted in KEY_BUCKETS buckets per source, so that a source with a third of all rows is
summed by partial aggregation.  Only the bucket that holds a source's cut is put in order, however much of
the source it holds: its rows are dealt by ranges of key over all tasks, sizes are summed by range, and each range
is prefix-summed from there.

Defined cases: null text counts as empty (size 0, nothing taken); a null source is a source of its
own, last in order; repeated rows are separate documents; equal keys (null doc_ids share one) go by doc_id, size
and a number of the row's own, so that ties too are dealt over ranges; a text of any length is counted whole in one
pass; an empty table gives an empty result; columns of the input other than doc_id, text, source and those to keep are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiberloom.scratch import join_checked, number_rows, running_sum, settle

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
KEY_BUCKETS = 4096
SHARE = 1.5
MOST_EPOCHS = 2
CYCLE = (5, 2, 1)
SEED = 17


def text_quality(text: Column, size: Column) -> Column:
    """A weight in (0, 1]: nearer to 1 the nearer the mean of characters per word is to 6."""
    return F.lit(1.0) / (F.lit(1.0) + F.abs(F.length(text) / F.greatest(size, F.lit(1)) - F.lit(6.0)))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on doc_id and seed alone."""
    hexed = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("-")))), 1, 12)
    return (F.conv(hexed, 16, 10).cast("double") + 0.5) / float(1 << 48)


def water_fill(sources: DataFrame, total: float, cap: float) -> DataFrame:
    """Add ``target``: shares of ``total`` by ``weight``, none above ``cap`` times ``source_size``.

    One row of sums reaches the driver per round; rounds end when no further source meets its cap.
    """
    level, capped = 0.0, -1
    while True:
        full = F.col("source_size") * cap <= F.col("weight") * level
        row = sources.agg(
            F.count(F.when(full, 1)).alias("n"),
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("free"),
        ).first()
        if row["n"] == capped or not row["free"]:
            break
        capped, level = row["n"], (total - cap * row["held"]) / row["free"]
    full = F.col("source_size") * cap <= F.col("weight") * level
    return sources.withColumn("target", F.when(full | F.lit(not row["free"]), F.col("source_size") * cap).otherwise(F.col("weight") * level))


def mix(documents: DataFrame, quality=text_quality, seed: int = SEED, share: float = SHARE, cap: float = float(MOST_EPOCHS), cycle: tuple = CYCLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """How many words of each document the mix takes.

    Returns doc_id, source, size, source_size, target, taken, and the columns to keep.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = documents.select("doc_id", "source", "text", *keep).withColumn("size", size)
    key = -F.log(uniform(F.col("doc_id"), seed)) / F.coalesce(quality(F.col("text"), F.col("size")), F.lit(1.0))
    sized = sized.withColumn("_key", key)
    docs = settle(
        sized.select(
            "doc_id", "source", "size", "_key", F.monotonically_increasing_id().alias("_row"), *keep,
            F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_source"),
            F.least(F.floor((1 - F.exp(-F.col("_key"))) * KEY_BUCKETS), F.lit(KEY_BUCKETS - 1)).cast("int").alias("_bucket"),
        ),
        "mix-docs",
    )
    counts = settle(docs.groupBy("_source", "source", "_bucket").agg(F.sum("size").alias("_words")), "mix-buckets")
    totals = counts.groupBy("_source", "source").agg(F.sum("_words").alias("source_size"))
    ranked = number_rows(totals, ["source"], "_rank", "mix-sources")
    weights = F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.col("_rank") % len(cycle) + 1).cast("int"))
    ranked = settle(ranked.select("_source", "source_size", weights.alias("weight")), "mix-weights")
    everything = ranked.agg(F.sum("source_size")).first()[0] or 0
    targets = water_fill(ranked, share * everything, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("_epochs", epochs).withColumn("_budget", F.when(F.col("source_size") > 0, F.round("target").cast("long") - F.col("_epochs") * F.col("source_size")).otherwise(0))
    targets = settle(targets, "mix-targets")

    # the bucket of each source in which its budget ends, and the words before it
    by_bucket = Window.partitionBy("_source").orderBy("_bucket")
    running = join_checked(counts.drop("source").withColumn("_upto", F.sum("_words").over(by_bucket)), targets.select("_source", "_budget"), "_source", row_bytes=80)
    cuts = running.where((F.col("_upto") > F.col("_budget")) & (F.col("_upto") - F.col("_words") <= F.col("_budget")))
    cuts = cuts.groupBy("_source").agg(F.min("_bucket").alias("_cut"), F.min_by(F.col("_upto") - F.col("_words"), "_bucket").alias("_before"))
    plan = settle(targets.join(cuts, "_source", "left").withColumn("_cut", F.coalesce("_cut", F.lit(KEY_BUCKETS))), "mix-plan")

    placed = join_checked(docs, plan, "_source", row_bytes=120, salt_by="doc_id")
    whole = placed.where(F.col("_bucket") != F.col("_cut")).withColumn("_part", F.when(F.col("_bucket") < F.col("_cut"), F.col("size")).otherwise(0))
    at_cut = running_sum(placed.where(F.col("_bucket") == F.col("_cut")), "_source", ["_key", "doc_id", "size", "_row"], "size", "_earlier", "mix-cut")
    left = F.col("_budget") - F.col("_before") - F.col("_earlier")
    at_cut = at_cut.withColumn("_part", F.greatest(F.lit(0), F.least(F.col("size"), left))).drop("_earlier")
    taken = (F.col("_epochs") * F.col("size") + F.col("_part")).cast("long")
    return whole.unionByName(at_cut).select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), taken.alias("taken"), *keep)
