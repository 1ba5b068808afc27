import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from fiberloom.llm import digest
from tests.llm.fixtures import documents, frame, text


@given(st.binary(max_size=300), st.binary(max_size=300))
def test_likeness(a, b):
    x, y = digest.fingerprint(a), digest.fingerprint(b)
    assert len(x) == len(y) == 72
    assert 0 <= digest.likeness(x, y) == digest.likeness(y, x) <= 1 and digest.likeness(x, x) == 1


def test_long_texts_are_counted_across_blocks(monkeypatch):
    import numpy as np

    data = np.frombuffer(random.Random(1).randbytes(5000), dtype=np.uint8)
    whole = digest.triplet_counts(data)
    monkeypatch.setattr(digest, "BLOCK", 700)
    parts = digest.triplet_counts(data)
    assert parts.sum() == whole.sum() == 4998 + 4997 and (parts == whole).all()


def test_edits_stay_near():
    rnd = random.Random(2)
    far, near = [], []
    for _ in range(30):
        a, b = text(rnd, 400), text(rnd, 400)
        x = digest.fingerprint(a.encode())
        near.append(digest.likeness(x, digest.fingerprint((a[: len(a) * 3 // 4] + b[: len(a) // 4]).encode())))
        far.append(digest.likeness(x, digest.fingerprint(random.Random(b).randbytes(2000))))
    assert min(near) > max(far)


def test_against_plain_code(spark, monkeypatch):
    rows = documents()
    ids = sorted({-(1 << 63) if d[0] is None else d[0] for d in rows})
    follow = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    texts = {}
    for d in rows:
        i = -(1 << 63) if d[0] is None else d[0]
        texts.setdefault(i, []).append(d[1] or "")
    want = []
    for i, own in texts.items():
        head = min(texts[follow[i]], key=lambda t: t.encode())
        for t in own:
            edited = (t[: len(t) - len(t) // 4] + head[: len(t) // 4]).encode()
            x, y, z = (digest.fingerprint(b) for b in (t.encode(), edited, head.encode()))
            want.append((-1 if i < 0 else i, len(t), hashlib.sha256(edited).hexdigest(), x, y, digest.likeness(x, y), digest.likeness(x, z)))
    got = [(-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in digest.edited_fingerprints(frame(spark)).collect()]
    assert sorted(got) == sorted(want)


def test_empty_and_alone(spark):
    assert digest.edited_fingerprints(frame(spark, [])).count() == 0
    (r,) = digest.edited_fingerprints(frame(spark, [(4, "abcdefgh", "en", "a", 0, 7, "k", 1, 2, 0.5, "h", "b")])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1


def test_rows_of_one_id_are_set_down_when_they_are_many(spark, monkeypatch):
    """A third without an id and many under one, more than a worker keeps, over several ranges."""
    monkeypatch.setattr(digest, "WAITING_BYTES", 300)
    rnd = random.Random(5)
    rows = [(rnd.choice((None, None, 7, i)), text(rnd, rnd.choice((0, 2, 9, 40)))) for i in range(150)]
    heads = {}
    for i, t in rows:
        heads[i] = min(heads.get(i, t), t, key=lambda x: x.encode())
    order = sorted(heads, key=lambda i: (i is not None, i or 0))
    follow = dict(zip(order, order[1:] + order[:1], strict=True))
    want = []
    for i, t in rows:
        head = heads[follow[i]]
        edited = (t[: len(t) - len(t) // 4] + head[: len(t) // 4]).encode()
        x, y, z = (digest.fingerprint(b) for b in (t.encode(), edited, head.encode()))
        want.append((-1 if i is None else i, len(t), hashlib.sha256(edited).hexdigest(), x, y, digest.likeness(x, y), digest.likeness(x, z)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in digest.edited_fingerprints(docs).collect()]
    assert sorted(got) == sorted(want)
