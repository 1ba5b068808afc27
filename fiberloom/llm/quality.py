"""Quality rules: base counts, then robust outliers by minimum covariance determinant.

Counts are made per document by array functions, without taking documents apart into rows.  Their
transforms (DIMENSIONS) form a vector; per language and source the mean and covariance of the tightest
SHARE of the vectors are found by concentration steps: distances from the last estimate, the bin of
distance that holds the share, then moments of what lies within.  Steps go on until no group's determinant falls any
more, from several starts (STARTS); each group keeps the first start that ends with the least determinant (or within BETTER of it).  A document whose
Mahalanobis distance from its group's estimate is above the threshold is rejected.

Every step is a grouped aggregate over a narrow settled table, so a group with a third of all rows is
summed by partial aggregation; distances are counted in bins, never sorted.  The estimate of a language and source is
drawn towards its language's, and that towards the one of all documents, as if SHRINK documents of the wider group were
in the narrower one: this decides for a group of one and fades for one of many, without a switch.

Defined cases: null text has no words (and fails the base rules); null language and source are groups of
their own; the square of the floor is added to each variance; repeated rows count as
often as they stand; a text of any length is counted whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiberloom.scratch import join_checked, settle

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
LEAST_WORDS, MOST_REPEAT = 50, 50
SHARE = 0.75
#: Steps that all groups make, the most steps, the fall of a determinant's logarithm below which a group has settled, and by how much
#: it must be lower for a later start to count as better (whole bins come in and go out, so equal sets of rows can differ by less).
STEPS, MOST_STEPS, SETTLED, BETTER = 5, 100, 1e-3, 1e-2
#: Shares of the rows, in the middle of each dimension, that make the first estimates (1: all rows).
STARTS = (0.75, 0.4, 1.0)
#: Documents of the wider group in the narrower one: with fewer than THRESHOLD * CONSISTENCY a text alone in its group could never be far from it.
SHRINK = 100.0
#: Of the distances of a group's own rows: squared, about the upper 1e-5 of chi-square with four degrees.
THRESHOLD = 28.5
#: Scales a covariance of the inner 75 % (four dimensions) to that of all.
CONSISTENCY = 1.46
#: Added in square to the variances, at the scale of a short document's chance: its mean word length, one symbol, one repeated line and the words of it.
#: Larger ones would decide in place of the groups' own spread, which is 0.05 or less on given texts.
FLOORS = (0.05, 0.035, 0.2, 0.15)
BINS_PER_E = 32


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """How many words lie in three-word windows found twice or more."""
    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2]))

    def covered(sorted_pairs: Column) -> Column:
        like = lambda p, i: F.coalesce(F.get(sorted_pairs, i)["h"] == p["h"], F.lit(False))
        again = F.filter(sorted_pairs, lambda p, i: like(p, i - 1) | like(p, i + 1))
        places = F.sort_array(F.transform(again, lambda p: p["i"]))
        return let(places, lambda q: F.aggregate(F.transform(q, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(q, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    def in_order(w: Column) -> Column:
        return F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def of(w: Column) -> Column:
        """Only documents with a repeated window have theirs sorted."""
        return let(w, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(in_order(w), covered)))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: of(windows(h))))


def counts(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long)."""
    text = F.coalesce("text", F.lit(""))
    words = documents.select(*keep, text.alias("_text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("_lines"))
    return words.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_words")).cast("long").alias("n_repeat_words"),
    )


def dimensions() -> list[Column]:
    """The transformed statistics: length of words, and the shares of symbols, of repeated words and of repeated lines, on log scales."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [F.log(chars / n), F.log1p(F.col("n_symbols") / chars * 100) / 2, F.log1p(F.col("n_repeat_words") / n * 20) / 2, F.log1p(F.col("n_dup_lines") * 100 / n) / 2]


DIMENSIONS = 4
PAIRS = list(combinations_with_replacement(range(DIMENSIONS), 2))


def moments() -> list[Column]:
    """Aggregates: the number of rows, sums and sums of products of x0, x1, ..."""
    return [F.count("*").cast("double").alias("_n"), *[F.sum(f"x{i}").alias(f"_s{i}") for i in range(DIMENSIONS)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"_p{i}{j}") for i, j in PAIRS]]


def with_estimate(sums: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Means m and the inverse Cholesky factor l of the covariance (times ``scale``, floored), from moments()."""
    mean = [F.col(f"_s{i}") / F.col("_n") for i in range(DIMENSIONS)]
    out = sums.select(*keys, "_n", *[m.alias(f"m{i}") for i, m in enumerate(mean)], *[((F.col(f"_p{i}{j}") / F.col("_n") - mean[i] * mean[j]) * scale + F.lit(FLOORS[i] ** 2 if i == j else 0.0)).alias(f"_c{i}{j}") for i, j in PAIRS])
    # one column at a time, as each factor is used by later ones
    for j in range(DIMENSIONS):
        out = out.withColumn(f"_f{j}{j}", F.sqrt(F.greatest(F.col(f"_c{j}{j}") - sum((F.col(f"_f{j}{k}") ** 2 for k in range(j)), F.lit(0.0)), F.lit(FLOORS[j] ** 2 / 100))))
        out = out.withColumns({f"_f{i}{j}": (F.col(f"_c{j}{i}") - sum((F.col(f"_f{i}{k}") * F.col(f"_f{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"_f{j}{j}") for i in range(j + 1, DIMENSIONS)}) if j + 1 < DIMENSIONS else out
    return out.select(*keys, "_n", *[f"m{i}" for i in range(DIMENSIONS)], *[F.col(f"_f{i}{j}").alias(f"l{i}{j}") for i in range(DIMENSIONS) for j in range(i + 1)])


def distance() -> Column:
    """The squared Mahalanobis distance of x from m by forward substitution with the factor l."""
    def solve(i: int, z: list[Column]) -> Column:
        return (F.col(f"x{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * z[k] for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}")

    z: list[Column] = []
    for i in range(DIMENSIONS):
        z.append(solve(i, z))
    return sum((v * v for v in z), F.lit(0.0))


MOMENTS = ["_n", *[f"_s{i}" for i in range(DIMENSIONS)], *[f"_p{i}{j}" for i, j in PAIRS]]


def spread(sums: DataFrame, keys: list[str]) -> DataFrame:
    """The moments with the logarithm of the determinant of their covariance in ``_det``."""
    det = sum((F.log(F.col(f"l{i}{i}")) * 2 for i in range(DIMENSIONS)), F.lit(0.0))
    return sums.join(with_estimate(sums, keys, 1.0).select(*keys, det.alias("_det")), keys)


def concentrate(vectors: DataFrame, group: str, share: float = SHARE, starts: tuple[float, ...] = STARTS) -> DataFrame:
    """Moments of the share with the least determinant found, by group, of a settled table (group, x0, x1, ...).

    Each start is of the moments of the middle of each dimension (within the bins that hold its share around the median).
    """
    keys = [group, "_start"]
    first = [start_moments(vectors, group, s).withColumn("_start", F.lit(i)) for i, s in enumerate(starts)]
    state = moving = settle(spread(reduce(DataFrame.unionByName, first), keys), "mcd-start")
    for step in range(1, MOST_STEPS + 1):
        placed = join_checked(vectors, settle(with_estimate(moving, keys, 1.0), "mcd-estimate"), group, row_bytes=200, salt_by="x0")
        placed = placed.withColumn("_bin", F.floor(F.log1p(distance()) * BINS_PER_E).cast("int"))
        binned = placed.groupBy(*keys, "_bin").agg(*moments())
        upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bin"))
        total = F.sum("_n").over(Window.partitionBy(*keys))
        inner = binned.withColumn("_before", upto - F.col("_n")).withColumn("_all", total).where(F.col("_before") < F.col("_all") * share)
        after = spread(inner.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in MOMENTS]), keys)
        if step <= STEPS:
            state = moving = settle(after, "mcd-step")
            continue
        # from here on only what falls goes on; whole bins come in and go out, so a step can also rise
        moving = settle(after.join(moving.select(*keys, F.col("_det").alias("_was")), keys).where(F.col("_det") < F.col("_was") - SETTLED).drop("_was"), "mcd-step")
        if moving.isEmpty():
            near = state.withColumn("_least", F.min("_det").over(Window.partitionBy(group))).where(F.col("_det") <= F.col("_least") + BETTER)
            return settle(near.groupBy(group).agg(F.min_by(F.struct(*MOMENTS), "_start").alias("_m")).select(group, "_m.*"), "mcd-best")
        state = settle(state.join(moving.select(*keys), keys, "left_anti").unionByName(moving), "mcd-state")
    raise RuntimeError(f"determinants still fall after {MOST_STEPS} steps")


def drawn(own: DataFrame, wider: DataFrame, on: str, by: float) -> DataFrame:
    """``own`` moments, with ``by`` documents as those of ``wider`` are, met on the column ``on`` of both."""
    return own.join(wider.select(on, *[(F.col(c) / F.col("_n") * by).alias(f"_w{c}") for c in MOMENTS]), on).select(*[c for c in own.columns if c not in MOMENTS], *[(F.col(c) + F.col(f"_w{c}")).alias(c) for c in MOMENTS])


def start_moments(vectors: DataFrame, group: str, share: float) -> DataFrame:
    """Moments of the rows that lie, in every dimension, within the middle bins holding ``share`` of the group."""
    every = vectors.groupBy(group).agg(*moments())
    if share >= 1:
        return every
    bins = vectors.select(group, F.explode(F.array(*[F.struct(F.lit(i).alias("_d"), F.floor(F.col(f"x{i}") * BINS_PER_E).alias("_bin")) for i in range(DIMENSIONS)])).alias("_b")).select(group, "_b.*")
    counted = bins.groupBy(group, "_d", "_bin").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group, "_d")
    tail = (1 - share) / 2
    limits = counted.withColumn("_upto", F.sum("_n").over(w.orderBy("_bin"))).withColumn("_all", F.sum("_n").over(w))
    limits = limits.where((F.col("_upto") > F.col("_all") * tail) & (F.col("_upto") - F.col("_n") < F.col("_all") * (1 - tail)))
    limits = limits.groupBy(group).agg(*[F.min(F.when(F.col("_d") == i, F.col("_bin"))).alias(f"_lo{i}") for i in range(DIMENSIONS)], *[F.max(F.when(F.col("_d") == i, F.col("_bin"))).alias(f"_hi{i}") for i in range(DIMENSIONS)])
    limits = settle(limits, "mcd-limits")
    placed = join_checked(vectors, limits, group, row_bytes=120, salt_by="x0")
    inside = [F.floor(F.col(f"x{i}") * BINS_PER_E).between(F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i in range(DIMENSIONS)]
    some = placed.where(reduce(and_, inside)).groupBy(group).agg(*moments())
    # a group whose middle is empty starts from all its rows
    joined = every.join(some.select(group, *[F.col(c).alias(f"_i{c}") for c in MOMENTS]), group, "left")
    return joined.select(group, *[F.coalesce(f"_i{c}", c).alias(c) for c in MOMENTS])


def judge(documents: DataFrame, threshold: float = THRESHOLD, shrink: float = SHRINK) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the distance."""
    group = lambda *parts: F.to_json(F.struct(*parts))
    lang, source = F.col("lang"), F.col("source")
    keyed = documents.select("doc_id", "text", group(lang.alias("l"), source.alias("s")).alias("_fine"), group(lang.alias("l"), F.lit(1).alias("any")).alias("_wide"))
    counted = counts(keyed, ("doc_id", "_fine", "_wide"))
    xs = {f"x{i}": x for i, x in enumerate(dimensions())}
    rows = settle(counted.withColumns(xs), "quality-counts")
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEAT)
    rows = rows.withColumn("base_failed", failed)
    # each row that passes teaches its own group, its language and the whole
    names = [f"x{i}" for i in range(DIMENSIONS)]
    good = rows.where(~F.col("base_failed"))
    vectors = settle(good.select(F.explode(F.array(F.col("_fine"), F.col("_wide"), F.lit("*"))).alias("_group"), *names), "quality-vectors")
    found = concentrate(vectors, "_group")
    at = lambda key: good.select(*key).distinct()
    whole = found.where("_group = '*'").first()  # one row of sums
    share = {c: whole[c] / whole["_n"] * shrink if whole else 0.0 for c in MOMENTS}
    wide = found.withColumnRenamed("_group", "_wide").join(at(["_wide"]), "_wide").select("_wide", *[(F.col(c) + F.lit(share[c])).alias(c) for c in MOMENTS])
    fine = drawn(found.withColumnRenamed("_group", "_fine").join(at(["_fine", "_wide"]), "_fine"), wide, "_wide", shrink)
    lookup = settle(with_estimate(fine, ["_fine"], CONSISTENCY).drop("_n"), "quality-lookup")
    placed = join_checked(rows, lookup, "_fine", "left", row_bytes=240, salt_by="doc_id")
    far = F.coalesce(distance(), F.lit(0.0))
    kept = ~F.col("base_failed") & (far <= threshold)
    return placed.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.when(~F.col("base_failed"), far).alias("distance"))
