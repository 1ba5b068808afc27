"""Fibers, witnesses, cohorts, dependencies and orbits over any table and any key columns."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiberloom.functions.costs import ceil_log2
from fiberloom.scratch import paired, settle

#: Left rows of one key that meet its right rows in one place, and pairs that a task makes.
PAIR_BLOCK, PAIRS_A_TASK = 1000, 10_000_000
#: Ids that one chunk of like rows holds, about.
MEMBERS = 256


def cell(*columns: str) -> Column:
    """Columns as one comparable value in which nulls are equal."""
    return F.struct(*[F.col(c) for c in columns])


def fibers(df: DataFrame, keys: list[str], distinct: dict[str, str] | None = None, least: int = 1) -> DataFrame:
    """Rows per key, and distinct counts {name: column}; groups under ``least`` rows are left out."""
    counts = [F.count_distinct(c).alias(name) for name, c in (distinct or {}).items()]
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), *counts)
    return out.where(F.col("n") >= least) if least > 1 else out


def witness_sets(df: DataFrame, witness: list[str], value: str) -> DataFrame:
    """The sorted set of values of each witness, as text."""
    return df.groupBy(*witness).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(value)), ",").alias("members"))


def cohorts(df: DataFrame, witness: str, fiber: str, least_fibers: int, least_witnesses: int = 2) -> DataFrame:
    """Sets of witnesses closed under sharing: for each pair's common fibers, all witnesses that have them all.

    Pairs come from an equi-join on the fiber; support is relational division (count of shared fibers met).
    """
    own = df.select(F.col(witness).alias("w"), F.col(fiber).alias("f")).distinct()
    pairs = own.alias("a").join(own.alias("b"), F.col("a.f") == F.col("b.f")).where("a.w < b.w")
    shared = pairs.groupBy(F.col("a.w").alias("w1"), F.col("b.w").alias("w2")).agg(F.array_sort(F.collect_list(F.col("a.f"))).alias("fs")).where(F.size("fs") >= least_fibers)
    sets = shared.select("fs").distinct().withColumn("set_id", F.array_join("fs", ","))
    wanted = sets.select("set_id", F.size("fs").alias("need"), F.explode("fs").alias("f"))
    support = wanted.join(own, "f").groupBy("set_id", "need", "w").agg(F.count("*").alias("have")).where("have = need")
    out = support.groupBy("set_id", "need").agg(F.count("*").alias("n_witnesses"), F.array_join(F.array_sort(F.collect_list("w")), ",").alias("witnesses"))
    return out.where(F.col("n_witnesses") >= least_witnesses).select(F.col("set_id").alias("fibers"), F.col("need").cast("long").alias("n_fibers"), "n_witnesses", "witnesses")


def determined_axes(df: DataFrame, given: list[str], axes: list[str]) -> DataFrame:
    """One row (axis, determined): whether the columns ``given`` fix each axis; nulls are values."""
    named = {f"_a{i}": a for i, a in enumerate(axes)}
    own = df.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(given)], *[F.struct(a).alias(n) for n, a in named.items()])
    counts = [F.count_distinct(n).alias(n) for n in named]
    per = own.groupBy(*[f"_g{i}" for i in range(len(given))]).agg(*counts) if given else own.agg(*counts)
    most = per.agg(*[F.coalesce(F.max(n), F.lit(0)).alias(n) for n in named])
    return most.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), (F.col(n) <= 1).alias("determined")) for n, a in named.items()])).alias("r")).select("r.axis", "r.determined")


def dependency_violations(df: DataFrame, given: list[str], axis: str, row_id: str) -> DataFrame:
    """Pairs of rows equal on ``given`` and unlike on ``axis``, only within keys that have two values at all.

    Right rows go by a number in place of the key; a large key is dealt over many tasks.
    """
    n = df.groupBy(*given).agg(F.count_distinct(cell(axis)).alias("_v"), F.count("*").alias("_n")).where("_v > 1")
    mixed = settle(n.select(*given, "_n", F.monotonically_increasing_id().alias("_no")), "violations-keys")
    made = mixed.agg(F.sum(F.col("_n").cast("double") * F.col("_n") / 2)).first()[0] or 0
    rows = df.select(*given, F.col(axis).alias("_value"), F.col(row_id).alias("_id")).join(mixed, given)
    side = lambda name: [F.col("_value").alias(f"{name}_value"), F.col("_id").alias(f"{name}_id")]
    pairs = paired(rows, "_no", "_id", [*given, *side("left")], side("right"), made, PAIR_BLOCK, PAIRS_A_TASK)
    return pairs.where("left_id < right_id and not (left_value <=> right_value)").drop("_no")


def minimal_keys(df: DataFrame, axes: list[str], most: int = 3) -> list[tuple[str, ...]]:
    """The smallest column sets that tell all distinct rows apart, up to ``most`` columns.

    One aggregation per size counts the distinct values of all sets not above a key already found.
    """
    if len(axes) > 12:
        raise ValueError("minimal_keys looks at all sets of columns; give it at most 12")
    total = df.select(*axes).distinct().count()
    found: list[tuple[str, ...]] = []
    for k in range(1, most + 1):
        open_ = [c for c in combinations(axes, k) if not any(set(f) <= set(c) for f in found)]
        if not open_:
            break
        row = df.agg(*[F.count_distinct(cell(*c)).alias(f"c{i}") for i, c in enumerate(open_)]).first()
        found += [c for i, c in enumerate(open_) if row[f"c{i}"] == total]
    return found


def geometry(df: DataFrame, axes: list[str]) -> DataFrame:
    """One row: groups, largest group, rows beyond one a group, the bits that tell a largest group apart, injectivity."""
    sizes = df.groupBy(*axes).agg(F.count("*").alias("n"))
    out = sizes.agg(F.count("*").alias("n_fibers"), F.coalesce(F.max("n"), F.lit(0)).alias("max_fiber"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("collision_excess"))
    return out.withColumn("bits", ceil_log2(F.col("max_fiber")).cast("long")).withColumn("injective", F.col("max_fiber") <= 1)


def orbits(df: DataFrame, axes: list[str], least: int = 2) -> DataFrame:
    """Groups over every proper non-empty subset of ``axes`` in one pass of grouping sets; absent axes are null and named by ``level``."""
    subsets = [c for k in range(1, len(axes)) for c in combinations(axes, k)]
    out = df.groupingSets([[F.col(a) for a in c] for c in subsets], *[F.col(a) for a in axes]).agg(F.grouping_id().alias("level"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least).select("level", *axes, "n")


def orbit_residue(df: DataFrame, chosen: list[str], others: list[str], least: int = 2) -> DataFrame:
    """Groups by the chosen axes with the sorted names of the other axes that vary in them."""
    grouped = df.groupBy(*chosen).agg(F.count("*").alias("n"), *[F.count_distinct(cell(o)).alias(f"_d_{o}") for o in others]).where(F.col("n") >= least)
    names = F.array_compact(F.array(*[F.when(F.col(f"_d_{o}") > 1, F.lit(o)) for o in sorted(others)]))
    return grouped.select(*chosen, "n", F.array_join(names, ",").alias("varying"))


def closed_repertoire(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Each key of either side with how many rows it has and whether it was expected."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    out = keys.select(key).distinct().withColumn("_want", F.lit(True)).join(counts, key, "full_outer")
    n = F.coalesce("n", F.lit(0)).cast("long")
    state = F.when(F.col("_want").isNull(), "unexpected").when(n == 0, "missing").when(n > 1, "duplicate").otherwise("covered")
    return out.select(key, n.alias("n"), state.alias("state"))


def injectivity(df: DataFrame, left: str, right: str) -> DataFrame:
    """One row: the most partners on either side, and whether the relation is one to one."""
    pairs = df.select(left, right).distinct()
    most = lambda k: pairs.groupBy(k).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("m"))
    a, b = most(left).withColumn("side", F.lit("left")), most(right).withColumn("side", F.lit("right"))
    out = a.unionByName(b).agg(F.max(F.when(F.col("side") == "left", F.col("m"))).alias("most_right_per_left"), F.max(F.when(F.col("side") == "right", F.col("m"))).alias("most_left_per_right"))
    return out.withColumn("one_to_one", (F.col("most_right_per_left") <= 1) & (F.col("most_left_per_right") <= 1))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def confusable_pairs(df: DataFrame, row_id: str, views: list[list[str]]) -> DataFrame:
    """Pairs of rows that are equal in at least one view (a list of columns), each view an equi-join.

    Rows that no view tells apart go in chunks: chunks are paired, and a pair is written out for its rows in the task that made it.
    A view leaves out what an earlier one has made, so that no pair is dealt out again; only where rows share an id are pairs
    made distinct.
    """
    keys = [F.to_json(cell(*view), {"ignoreNullFields": "false"}).alias(f"_k{i}") for i, view in enumerate(views)]
    named = [f"_k{i}" for i in range(len(views))]
    rows = df.select(F.col(row_id).alias("_id"), *keys).where("_id is not null")
    shared = not rows.groupBy("_id").agg(F.count("*").alias("_n")).where("_n > 1").isEmpty()
    sizes = rows.groupBy(*named).agg(F.count("*").alias("_rows"))
    dealt = rows.join(sizes, named).withColumn("_part", F.pmod(F.xxhash64("_id"), F.ceil(F.col("_rows") / MEMBERS)))
    chunks = settle(dealt.groupBy(*named, "_part").agg(F.sort_array(F.collect_list("_id")).alias("_ids")).drop("_part").withColumn("_chunk", F.monotonically_increasing_id()), "confusable-chunks")
    side = lambda name, i: [F.col("_chunk").alias(f"_{name}"), F.col("_ids").alias(f"_{name}_ids"), *[F.col(f"_k{j}").alias(f"_{name}{j}") for j in range(i)]]
    parts = []
    for i, key in enumerate(named):
        n = settle(chunks.groupBy(key).agg(F.sum(F.size("_ids")).alias("_n")).where("_n > 1"), "confusable-sizes")
        made = n.agg(F.sum(F.col("_n").cast("double") * F.col("_n") / 2)).first()[0] or 0
        new = [F.col(f"_left{j}") != F.col(f"_right{j}") for j in range(i)]
        met = paired(chunks.join(n, key), key, "_chunk", side("left", i), side("right", i), made, PAIR_BLOCK, PAIRS_A_TASK)
        met = met.where(reduce(lambda a, b: a & b, new, F.expr("_left <= _right")))
        ones = met.select("_left", "_right", "_right_ids", F.explode("_left_ids").alias("_one"))
        pairs = ones.select("_left", "_right", "_one", F.explode("_right_ids").alias("_two")).where("_one < _two or (_left <> _right and _one > _two)")
        parts.append(pairs.select(F.least("_one", "_two").alias("left_id"), F.greatest("_one", "_two").alias("right_id")))
    every = reduce(DataFrame.unionByName, parts)
    return every.distinct() if shared else every


def confusable_count(df: DataFrame, views: list[list[str]]) -> DataFrame:
    """One row ``edges``: how many pairs of rows are alike under one view or more, without making any.

    By inclusion and exclusion: pairs alike under several views are those of the fibers of all their columns.
    """
    parts = []
    for k in range(1, len(views) + 1):
        for some in combinations(views, k):
            axes = sorted({a for v in some for a in v})
            pairs = df.groupBy(*axes).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("p"))
            parts.append(pairs.select((F.col("p") * (1 if k % 2 else -1)).alias("p")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.agg(F.sum("p").alias("edges"))
