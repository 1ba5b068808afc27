import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from fiberloom.llm import suffixdedup as sd
from tests.llm.fixtures import documents, frame, small, text


@given(st.lists(st.sampled_from([b"a", b"b", b"ab", b"\x00", b"\xff", b"banana"]), max_size=40).map(b"".join))
def test_suffix_array(data):
    assert sd.suffix_array(data).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


@pytest.mark.parametrize("depth", [1, 5, 7, 20, 100])
def test_buckets_to_a_depth(depth):
    data = bytes(random.Random(depth).choices(b"ab", k=3000)) + b"ab" * 300
    pointers = sd.refine(np.frombuffer(data, dtype=np.uint8), depth)
    seen = {}
    for i, p in enumerate(pointers.tolist()):
        assert seen.setdefault(p, data[i : i + depth]) == data[i : i + depth]
    assert len(seen) == len({data[i : i + depth] for i in range(len(data))})


def brute(rows, length=100):
    seen, out = set(), []
    for d, t in sorted(((-(1 << 63) if r[0] is None else r[0], (r[1] or "").encode()) for r in rows)):
        change = np.zeros(len(t) + 1, int)
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            if w in seen:
                change[s] += 1
                change[s + length] -= 1
            seen.add(w)
        gone = np.cumsum(change[:-1]) > 0
        left = np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()
        out.append((d, len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def tangled(seed):
    rnd = random.Random(seed)
    passage = text(rnd, 80)
    rows = []
    for i in range(150):
        t = text(rnd, rnd.randint(0, 40))
        a = rnd.randint(0, 200)
        t += rnd.choice(("", passage[a : a + rnd.randint(50, 250)] + t[:120], "ab" * rnd.randint(1, 200), passage[10:75] + text(rnd, 15)))
        rows.append((i, t))
    return small(rows + [(300 + i, rows[3 * i][1]) for i in range(30)])


@pytest.mark.parametrize("seed", range(3))
def test_against_all_strings(spark, seed, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(sd, "BUCKET_BYTES", 700)
    rows = tangled(seed)
    assert found(sd.cut_repeats(frame(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    rows = documents()
    assert found(sd.cut_repeats(frame(spark))) == brute(rows)


def test_text_and_columns_are_kept(spark):
    rows = small([(1, "é" * 80 + "x"), (2, "é" * 80 + "y"), (3, None)])
    got = {r.doc_id: r for r in sd.cut_repeats(frame(spark, rows), keep=("lang", "n_chars"), with_text=True).collect()}
    assert got[1].kept_text == "é" * (51 - 1) + "x" or got[1].n_removed > 0
    assert got[2].kept_text.endswith("y") and got[2].lang == "en" and got[3].kept_text == ""


def test_long_documents_are_taken_in_steps(monkeypatch):
    """Blocks of a document are cut at places that do not change what is found."""
    rows = [(1, text(random.Random(1), 900)), (2, "q" + text(random.Random(1), 900))]
    table = pa.table({"_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    monkeypatch.setattr(sd, "BLOCK", 1500)
    own = sd.Chunk(table, 100, 32)
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(own.runs.first, own.runs.last, strict=True)])
    want = np.concatenate([np.arange(a, b - 99) for a, b in zip(own.starts[:-1], own.starts[1:], strict=True)])
    assert (np.sort(starts) == want).all()


def test_empty(spark):
    assert sd.cut_repeats(frame(spark, [])).count() == 0


def test_rows_that_share_an_id_are_dealt_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(sd, "BUCKET_BYTES", 700)
    rows = [(None if i % 3 == 0 else 5 if i % 7 == 0 else i, *r[1:]) for i, r in enumerate(tangled(4))]
    got = sd.numbered(frame(spark, rows).selectExpr("coalesce(doc_id, -1) _id", "text")).collect()
    order = [r for r in sorted(got, key=lambda r: r._nth) if r._nth]
    assert [(r._id, r.text.encode()) for r in order] == sorted((-1 if r[0] is None else 5, r[1].encode()) for r in rows if r[0] in (None, 5))
    assert found(sd.cut_repeats(frame(spark, rows))) == brute(rows)


def test_kept_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", 70, 80), (2, "b", 71, 81)], "doc_id long, text string, chunk long, n_bytes long")
    got = {r.doc_id: r for r in sd.cut_repeats(docs, keep=("chunk", "n_bytes")).collect()}
    assert [(got[i].chunk, got[i].n_bytes_kept, got[i].n_bytes) for i in (1, 2)] == [(70, 80, 1), (71, 81, 1)]


def test_pointers_of_names():
    rnd = np.random.default_rng(2)
    names = [rnd.integers(0, k, 2000).astype(np.uint64) for k in (40, 5, 3)]
    pointer = sd.refine_names(*names)
    rows = list(zip(*(x.tolist() for x in names), strict=True))
    last = {r: i for i, r in enumerate(sorted(rows))}
    assert pointer.tolist() == [last[r] for r in rows]
