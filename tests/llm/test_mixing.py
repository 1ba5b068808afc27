import re
from collections import defaultdict

from fiberloom.llm import mixing
from tests.llm.fixtures import documents, frame


def filled(sizes, weights, total, cap):
    held = set()
    while True:
        free = [s for s in sizes if s not in held]
        level = (total - cap * sum(sizes[s] for s in held)) / max(sum(weights[s] for s in free), 1)
        more = {s for s in free if cap * sizes[s] <= level * weights[s]}
        if not more:
            return {s: cap * sizes[s] if s in held else level * weights[s] for s in sizes}
        held |= more


def test_targets_and_what_is_taken(spark):
    rows = documents()
    sizes = defaultdict(int)
    for d in rows:
        sizes[d[3]] += len(re.findall(mixing.WORD, d[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: mixing.CYCLE[i % 3] for i, s in enumerate(order)}
    want = filled(sizes, weights, 1.5 * sum(sizes.values()), 2.0)
    got = mixing.mix(frame(spark)).toPandas()
    assert len(got) == len(rows)
    by = {None if k != k else k: g for k, g in got.groupby("source", dropna=False)}
    for s in order:
        g = by[s]
        assert (g.source_size == sizes[s]).all() and abs(g.target.iloc[0] - want[s]) < 1e-6
        assert abs(g.taken.sum() - want[s]) <= 1
        epochs = int(want[s] // sizes[s])
        assert (g.taken >= epochs * g["size"]).all() and (g.taken <= 2 * g["size"]).all()
        assert ((g.taken % g["size"].clip(lower=1)) > 0).sum() <= 1 + (epochs == 2)


def test_the_first_by_key_are_taken_and_reruns_agree(spark):
    rows = [(i, "w " * (1 + i % 5), "en", "a" if i % 3 else "b", 0, 7, "k", 1, 2, 0.5, "h", "b") for i in range(300)]
    one, two = (sorted(map(tuple, mixing.mix(frame(spark, rows)).collect())) for _ in range(2))
    assert one == two
    from pyspark.sql import functions as F

    df = frame(spark, rows).withColumn("u", mixing.uniform(F.col("doc_id"), mixing.SEED)).withColumn("w", F.expr("size(split(text, ' ')) - 1"))
    keys = {r.doc_id: (r.k, r.doc_id) for r in df.withColumn("k", -F.log("u") / mixing.text_quality(F.col("text"), F.col("w"))).collect()}
    for s in "ab":
        own = [r for r in one if r[1] == s]
        more = [keys[r[0]] for r in own if r[5] > int(r[4] // r[3]) * r[2]]
        less = [keys[r[0]] for r in own if r[5] == int(r[4] // r[3]) * r[2]]
        assert not more or not less or max(more) < min(less)


def test_empty_and_wordless(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    only = mixing.mix(frame(spark, [(1, None, "en", "a", 0, 7, "k", 1, 2, 0.5, "h", "b")])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in only] == [(0, 0, 0.0, 0)]


def test_a_source_of_one_bucket_and_of_null_ids_is_dealt_over_ranges(spark):
    """Texts of one long word fall into the last bucket of keys; rows without an id all have one key."""
    long = [(i, "x" * (40_000 + i) + " y" * (i % 3), "en", "a", 0, 7, "k", 1, 2, 0.5, "h", "b") for i in range(200)]
    bare = [(None, "w " * (1 + i % 4), "en", "b", 0, 7, "k", 1, 2, 0.5, "h", "b") for i in range(200)]
    docs = frame(spark, long + bare)
    got = mixing.mix(docs).toPandas()
    assert len(got) == 400 and (got.taken <= 2 * got["size"]).all()
    for _, own in got.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 1
        whole = own.target.iloc[0] // own.source_size.iloc[0] * own["size"]
        assert ((own.taken > whole) & (own.taken < whole + own["size"])).sum() <= 1


def test_running_sums_of_a_hot_group(spark):
    from fiberloom.scratch import running_sum

    rows = [("hot" if i % 7 else "cold", i * 37 % 101, i) for i in range(400)]
    got = running_sum(spark.createDataFrame(rows, "g string, k long, n long"), "g", ["k", "n"], "n", "before").collect()
    by = defaultdict(list)
    for g, k, n in sorted(rows, key=lambda r: r[1:]):
        by[g].append(n)
    assert len(got) == len(rows)
    assert all(r.before == sum(by[r.g][: by[r.g].index(r.n)]) for r in got)
