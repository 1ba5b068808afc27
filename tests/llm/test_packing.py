import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from fiberloom.llm import packing
from tests.llm.fixtures import documents, frame


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_path())


def test_ids_are_the_tokenizers_own(tokenizer):
    encoder, rnd = packing.WordEncoder(packing.tokenizer_path()), random.Random(1)
    alphabet = [*"ab'sréÉßÿÞ×÷ªµΣςİ̇ \n\t\r\x0b\x0c\x1c\x85\xa0​1٣!?.,<|>ſK가\U0001f600$#%", "<|endoftext|>", "'ll", " <|startoftext|>"]
    for _ in range(3000):
        x = "".join(rnd.choices(alphabet, k=rnd.randint(0, 30)))
        assert encoder.encode([x])[0].tolist() == tokenizer.encode(x, add_special_tokens=False).ids, repr(x)


def test_small_caches_change_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    encoder = packing.WordEncoder(packing.tokenizer_path())
    texts = [d[1] or "" for d in documents()]
    for x, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == tokenizer.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(20))
def test_a_window_is_filled_as_well_as_can_be(seed):
    rnd = random.Random(seed)
    capacity = rnd.randint(5, 40)
    pool = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 12))]
    sums = {0}
    for x in pool:
        sums |= {s + x for s in sums if s + x <= capacity}
    lengths = sorted(set(pool), reverse=True)
    fill = packing.fill_window(lengths, [pool.count(x) for x in lengths], capacity)
    assert all(n <= pool.count(x) for x, n in fill.items())
    assert sum(x * n for x, n in fill.items()) == max(sums)


def test_plan_uses_every_piece_once():
    rnd = random.Random(2)
    histogram = {k: rnd.randint(1, 900) for k in (1, 2, 3, 5, 8, 9, 17, 20, 31, 33, 40, 64)} | {4: 3000}
    seen = {}
    for length, first, each, offset, sequence, times in packing.plan_windows(histogram, 64):
        for r in range(first, first + each * times):
            assert (length, r) not in seen
            seen[length, r] = (sequence + (r - first) // each, offset + length * ((r - first) % each))
    assert len(seen) == sum(histogram.values())
    windows = {}
    for (length, _), (s, o) in seen.items():
        windows.setdefault(s, []).append((o, length))
    for pieces in windows.values():
        at = 0
        for o, length in sorted(pieces):
            assert o == at
            at += length
        assert at <= 64
    assert len(windows) <= 1.03 * sum(k * n for k, n in histogram.items()) / 64


def test_pieces_cover_every_document(spark, tokenizer):
    rows = documents()
    got = packing.pack(frame(spark)).toPandas()
    want = sorted((-1 if d[0] is None else d[0], len(ids), at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for d in rows for ids in [tokenizer.encode(d[1] or "", add_special_tokens=False).ids + [1]] for at in range(0, len(ids), 2048))
    assert sorted((-1 if r.doc_id != r.doc_id else int(r.doc_id), r.doc_tokens, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    for _, w in got.sort_values("offset").groupby("sequence_id"):
        assert (w.offset == w.length.cumsum() - w.length).all() and w.length.sum() <= 2048
    assert got.sequence_id.nunique() <= got.length.sum() / 2048 + 2


def test_empty(spark):
    assert packing.pack(frame(spark, [])).count() == 0
