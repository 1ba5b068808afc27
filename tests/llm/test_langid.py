import zlib

import numpy as np

from fiberloom.llm import langid
from tests.llm.fixtures import frame


def grams(text):
    cleaned = langid.NOT_LETTER.sub(" ", text.lower()).strip()
    b = f" {cleaned} ".encode() if cleaned else b""
    return {b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}


def test_gram_codes_are_the_grams():
    for t in ("", "1 2!", "Ab c", "déjà vu", "a" * 50):
        codes = set(langid.gram_codes(t).tolist())
        assert len(codes) == len(grams(t))


def test_scores_are_ridge_on_the_nystroem_map():
    """The folded product equals the kernel's row times the map times the solution, from sets of grams."""
    texts = ["the cat sat on the mat", "a dog and the cat", "le chat est sur la table", "un chien et le chat", "die katze und der hund", "der hund ist ein tier"]
    langs = ["en", "en", "fr", "fr", "de", "de"]
    sets = [np.unique(langid.gram_codes(t)) for t in texts]
    landmark = [True, False] * 3
    model = langid.fit(sets, langs, landmark)
    seen = set().union(*(set(s.tolist()) for s, m in zip(sets, landmark, strict=True) if m))
    own = [set(s.tolist()) & seen for s in sets]
    k = lambda a, b: len(a & b) / max(1, len(a) * len(b)) ** 0.5
    marks = [o for o, m in zip(own, landmark, strict=True) if m]
    values, vectors = np.linalg.eigh(np.array([[k(a, b) for b in marks] for a in marks]))
    to_map = vectors / np.sqrt(values)
    x = np.array([[k(a, b) for b in marks] for a in own]) @ to_map
    y = np.array([[float(a == b) for b in ("de", "en", "fr")] for a in langs])
    w = (y / y.sum(axis=0)).sum(axis=1, keepdims=True)
    solved = np.linalg.solve(x.T @ (x * w) + langid.RIDGE / 3 * np.eye(3) * w.mean(), x.T @ (y * w))
    column = np.full(langid.GRAMS, len(model.grams), dtype=np.int32)
    column[model.grams] = np.arange(len(model.grams))
    assert np.allclose(model.scores([langid.gram_codes(t) for t in texts], column), x @ solved, atol=1e-4)


def test_held_out_accuracy(spark):
    got = langid.identify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id]).all()
    assert (both.lang == both.lang_pred)[both.held_out].mean() > 0.98


def test_odd_rows(spark):
    got = {r.doc_id: r for r in langid.identify(frame(spark)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "fr", "und") for r in got.values())


def test_empty_and_unlabelled(spark):
    assert langid.identify(frame(spark, [])).count() == 0
    df = frame(spark, [(1, "some words", None, "a", 0, 7, "k", 1, 2, 0.5, "h", "b")])
    assert [r.lang_pred for r in langid.identify(df).collect()] == ["und"]
