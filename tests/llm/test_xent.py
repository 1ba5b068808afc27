import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fiberloom.llm import xent
from tests.llm.fixtures import documents, frame, small


def test_losses_against_plain_counts(spark):
    rows = documents()
    good = {3, 4, 5, 62, 900, 12345}
    labels = spark.createDataFrame([(g,) for g in [*good, 3]] + [(None,)], "doc_id long")
    got = xent.cross_entropy_difference(frame(spark), labels).collect()
    places = xent.WordPlaces()
    tokens = [[places[w] for w in re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")] for r in rows]
    pair = lambda v, w: int(xent.bigram_places(np.array([v]), np.array([w]))[0])

    def model(texts):
        one, two, before = Counter(), Counter(), Counter()
        for t in texts:
            one.update(t)
            two.update(pair(v, w) for v, w in zip([0, *t], t))
            before[0] += bool(t)
        total, size = sum(one.values()), 1 << xent.WORD_BITS
        share = lambda w: (one[w] + xent.ALPHA) / (total + xent.ALPHA * size)
        return lambda v, w: -math.log2((two[pair(v, w)] + xent.MU * share(w)) / ((before[0] if v == 0 else one[v]) + xent.MU))

    whole, target = model(tokens), model([t for r, t in zip(rows, tokens, strict=True) if r[0] in good])
    want = []
    for r, t in zip(rows, tokens, strict=True):
        mean = lambda m: sum(m(v, w) for v, w in zip([0, *t], t)) / len(t)  # noqa: B023, E731
        want.append((-1 if r[0] is None else r[0], len(t), *((mean(target), mean(whole)) if t else (math.nan, math.nan))))
    have = [(-1 if r.doc_id is None else r.doc_id, r.n_words, math.nan if r.score is None else r.target_loss, math.nan if r.score is None else r.background_loss) for r in got]
    key = lambda r: (r[0], r[1], round(r[2], 3) if r[2] == r[2] else -1)
    assert np.allclose(np.array(sorted(have, key=key)), np.array(sorted(want, key=key)), atol=1e-4, equal_nan=True)


def test_target_texts_score_lower(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    french = docs.where("lang = 'fr' and doc_id % 2 = 0").select("doc_id")
    got = xent.cross_entropy_difference(docs, french).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 2 = 1").toPandas()
    assert got[got.lang == "fr"].score.median() < got[got.lang == "en"].score.median() - 2


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert xent.cross_entropy_difference(frame(spark, []), none).count() == 0
    assert xent.cross_entropy_difference(frame(spark), none).where("n_words > 0 and score is null").count() == 0


def test_more_words_and_bigrams_than_places(spark):
    """Against the words themselves, with more of them than the smoothing's least vocabulary."""
    rnd = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rnd.integers(0, 400_000, 900)) for _ in range(250)]
    good = set(range(0, 250, 7))
    labels = spark.createDataFrame([(g,) for g in good], "doc_id long")
    got = {r.doc_id: r for r in xent.cross_entropy_difference(frame(spark, small(enumerate(texts))), labels).collect()}
    tokens = [t.split() for t in texts]
    size = len(set().union(*tokens))
    assert size > 1 << xent.WORD_BITS
    for chosen, name in ((good, "target_loss"), (range(250), "background_loss")):
        one, two = Counter(), Counter()
        for d in chosen:
            one.update(tokens[d])
            two.update(zip([None, *tokens[d]], tokens[d]))
        total, before = sum(one.values()), {**one, None: len(chosen)}
        share = lambda w: (one[w] + xent.ALPHA) / (total + xent.ALPHA * size)  # noqa: B023, E731
        loss = lambda v, w: -math.log2((two[v, w] + xent.MU * share(w)) / (before.get(v, 0) + xent.MU))  # noqa: B023, E731
        want = [sum(loss(v, w) for v, w in zip([None, *t], t)) / len(t) for t in tokens]
        assert np.allclose([got[d][name] for d in range(250)], want, atol=1e-9)


def test_chunks_and_buckets_do_not_matter(spark, monkeypatch):
    labels = spark.createDataFrame([(3,), (62,)], "doc_id long")
    one = sorted(map(repr, xent.cross_entropy_difference(frame(spark), labels).selectExpr("doc_id", "n_words", "round(score, 9) s").collect()))
    monkeypatch.setattr(xent, "CHUNK_CHARS", 500)
    monkeypatch.setattr(xent, "LEAST_BUCKETS", 3)
    assert one == sorted(map(repr, xent.cross_entropy_difference(frame(spark), labels).selectExpr("doc_id", "n_words", "round(score, 9) s").collect()))


def test_targets_are_not_broadcast(spark):
    """However many there are: here more than a broadcast may hold."""
    labels = spark.range(300_000).select((F.col("id") * 3).alias("doc_id"))
    few = labels.where("doc_id < 100000")
    want = sorted(map(repr, xent.cross_entropy_difference(frame(spark), few).selectExpr("doc_id", "n_words", "round(score, 9) s").collect()))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "3m")
    try:
        got = sorted(map(repr, xent.cross_entropy_difference(frame(spark), labels).selectExpr("doc_id", "n_words", "round(score, 9) s").collect()))
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert got == want
