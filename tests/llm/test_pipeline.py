import re
from collections import Counter

import corpus_pipeline
from fiberloom.llm import mixing, suffixdedup
from tests.llm.fixtures import documents, frame
from tests.llm.test_minhash import classes
from tests.llm.test_suffixdedup import brute


def columns(df):
    assert df.columns == list(corpus_pipeline.COLUMNS)
    return df.collect()


def test_stages_on_odd_rows(spark):
    rows = documents()
    docs = frame(spark)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near-dedup", "repeats", "mixing", "packing"]
    known = columns(corpus_pipeline.known_language(spark, docs, ""))
    assert len(known) == sum(bool(re.search(r"[^\W\d_]", r[1] or "")) for r in rows) and {r.lang for r in known} <= {"en", "fr"}

    left = columns(corpus_pipeline.one_of_near_copies(spark, docs, ""))
    ids = Counter(r.doc_id for r in left)
    assert max(ids.values()) == 1
    unlike = [r for r in rows if r[1] != "another text under the same id" and re.search(r"\S", r[1] or "")]
    assert {-1 if i is None else i for i in ids} == {min(c) for c in classes(unlike)} | {r[0] for r in rows if not re.search(r"\S", r[1] or "")}

    cut = columns(corpus_pipeline.without_repeats(spark, docs, ""))
    want = [r for r in brute(rows) if r[1] > r[2] or not r[2]]
    assert len(cut) == len(want)

    sizes = {r.doc_id: len(re.findall(mixing.WORD, r.text or "")) for r in left}
    few = frame(spark, [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 7, "k", 1, 2, 0.5, "h", "b") for r in left])
    taken = {r.doc_id: r.taken for r in mixing.mix(few).collect()}
    got = Counter()
    for r in columns(corpus_pipeline.mixed(spark, few, "")):
        got[r.doc_id] += len(re.findall(mixing.WORD, r.text))
        assert next(x.text for x in left if x.doc_id == r.doc_id).startswith(r.text) and r.n_chars == len(r.text)
    assert got == Counter({k: v for k, v in taken.items() if v}) and all(v <= 2 * sizes[k] for k, v in got.items())


def test_run_over_a_folder(spark, tmp_path):
    frame(spark).select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(got) and (got.groupby("sequence_id").length.sum() <= 2048).all()


def test_empty(spark, tmp_path):
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0


def test_nothing_that_is_new_is_cut(spark):
    rows = [(i, f"document {i} is about nothing else but {i * i} and says so once", "en", "a", 0, 7, "k", 1, 2, 0.5, "h", "b") for i in range(30)]
    assert suffixdedup.cut_repeats(frame(spark, rows)).where("n_removed > 0").count() == 0


def test_rows_without_an_id_are_documents_of_their_own(spark):
    rows = documents()
    unlike = [r for r in rows if r[0] is not None and r[0] < 60 and len((r[1] or "").split()) > 20]
    bare = [(None, *r[1:]) for r in unlike]
    docs = frame(spark, [*bare, bare[0], *[(i, f"short text {i} {i * i} {i + 7}", "en", "a", *r[4:]) for i, r in enumerate(rows[:9])]])
    left = columns(corpus_pipeline.one_of_near_copies(spark, docs, ""))
    assert sorted(r.text for r in left if r.doc_id is None) == sorted({r[1] for r in bare})

    few = frame(spark, bare)
    taken = Counter()
    for r in mixing.mix(few.withColumn("t", few.text), keep=("t",)).collect():
        taken[r.t] += r.taken
    got = Counter()
    for r in columns(corpus_pipeline.mixed(spark, few, "")):
        whole = [x[1] for x in bare if x[1].startswith(r.text)]
        assert len(whole) == 1
        got[whole[0]] += len(re.findall(mixing.WORD, r.text))
    assert got == Counter({k: v for k, v in taken.items() if v})


def test_language_of_rows_that_share_an_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*corpus_pipeline.COLUMNS)
    alone = {r.text: r.lang for r in columns(corpus_pipeline.known_language(spark, docs, ""))}
    shared = docs.union(docs.where("lang in ('en', 'fr')").selectExpr("cast(null as long)", "concat(text, ' ')", "lang", "source", "n_chars"))
    got = [r for r in columns(corpus_pipeline.known_language(spark, shared, "")) if r.doc_id is None]
    same = [r.lang == alone.get(r.text[:-1]) for r in got]
    assert len({r.lang for r in got}) > 1 and sum(same) > 0.9 * len(same)


def test_unlike_texts_under_one_id_all_come_through(spark, tmp_path):
    """Wholly different texts, two without an id and two under 7, beside copies of each."""
    rnd = __import__("random").Random(3)
    words = lambda: " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(3, 8))) for _ in range(40))
    rows = [(i, words(), "en", "a") for i in (None, None, 7, 7, 8)]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in [*rows, *rows]], "doc_id long, text string, lang string, source string, n_chars long")
    known = corpus_pipeline.known_language(spark, docs, "")
    left = columns(corpus_pipeline.one_of_near_copies(spark, known, ""))
    assert sorted(r.text for r in left) == sorted(r[1] for r in rows)
    assert sorted(str(r.doc_id) for r in left) == ["7", "8", "None", "None", "None"]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).selectExpr("sum(length)").first()[0] >= 5 * 40
