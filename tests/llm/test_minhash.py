import random
import re
from collections import Counter
from itertools import combinations

import numpy as np

from fiberloom.llm import minhash
from tests.llm.fixtures import documents, frame, small, text


def shingles(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def jaccard(a, b):
    x, y = ({k: 1 + np.log(n) for k, n in s.items()} for s in (a, b))
    every = set(x) | set(y)
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in set(x) & set(y))


def classes(rows):
    """By all pairs."""
    home = {i: i for i in range(len(rows))}
    sets = [shingles(r[1]) for r in rows]

    def find(i):
        while home[i] != i:
            i = home[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] & sets[j] and jaccard(sets[i], sets[j]) >= 0.8:
            home[find(j)] = find(i)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(rows[i][0])
    return sorted(sorted(-1 if x is None else x for x in v) for v in out.values())


def found(df):
    out = {}
    rows = df.collect()
    for r in rows:
        out.setdefault((r.class_id, r.class_size), []).append(-1 if r.doc_id is None else r.doc_id)
    return rows, out


def test_exact_similarity_and_its_estimate():
    rnd = np.random.default_rng(1)
    a = np.unique(rnd.integers(0, 2**63, 400).astype(np.uint64))
    wa, some = rnd.uniform(1, 3, 400), rnd.random(400) < 0.8
    wb = np.where(rnd.random(400) < 0.7, wa, 2 * wa)[some]
    exact = minhash.probability_jaccard(a, wa, a[some], wb)
    want = sum(1 / np.maximum(wa / wa[i], np.where(some, np.r_[wb, 0][np.where(some, np.cumsum(some) - 1, -1)], 0) / wb[np.cumsum(some)[i] - 1]).sum() for i in np.flatnonzero(some))
    assert abs(exact - want) < 1e-9
    s = minhash.signatures(np.r_[np.zeros(400, int), np.ones(some.sum(), int)], np.r_[a, a[some]], np.r_[wa, wb], 2, 4096)
    assert abs((s[0] == s[1]).mean() - exact) < 0.03


def test_the_bound_holds():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        n = 30
        x, y = rnd.random(n) * (rnd.random(n) < 0.8), rnd.random(n) * (rnd.random(n) < 0.8)
        a, b = np.flatnonzero(x).astype(np.uint64), np.flatnonzero(y).astype(np.uint64)
        left, right = x[y == 0].sum() / x.sum(), y[x == 0].sum() / y.sum()
        assert minhash.probability_jaccard(a, x[x > 0], b, y[y > 0]) <= 1 / (1 / (1 - left) + 1 / (1 - right) - 1) + 1e-9


def test_shingles():
    texts = ["", "a b", "a b c d e f", "a b c d e a b c d e", "é x y z\x1cq w e r", "one\ttwo\nthree four  five"]
    doc, _, n = minhash.shingle_sets(texts, minhash.WordHashes())
    for i, t in enumerate(texts):
        assert sorted(n[doc == i].tolist()) == sorted(shingles(t).values())


def test_classes_of_edited_copies(spark):
    rnd = random.Random(7)
    rows = []
    for base in range(6):
        words = text(rnd, 80).split()
        for copy in range(12):
            own = list(words)
            for _ in range(rnd.choice((0, 1, 1, 2, 3))):
                own[rnd.randrange(len(own))] = "edit%d" % rnd.randrange(10**6)
            rows.append((100 * base + copy, " ".join(own)))
    rows = small(rows)
    out, by = found(minhash.near_classes(frame(spark, rows)))
    assert sorted(sorted(v) for v in by.values()) == classes(rows)
    assert all(k[0] == min(v) and k[1] == len(v) for k, v in by.items())


def test_odd_rows(spark):
    rows = [r for r in documents() if r[1] != "another text under the same id"]  # two classes cannot be told apart by one id
    out, by = found(minhash.near_classes(frame(spark, rows)))
    assert len(out) == len(rows)
    empty = [r for r in out if r.doc_id in (900, 901, 902)]
    assert all(r.class_id == r.doc_id and r.class_size == 1 for r in empty)
    wordy = [r for r in rows if shingles(r[1])]
    skip = [r[0] for r in rows if not shingles(r[1])]
    assert sorted(sorted(v) for k, v in by.items() if not (len(v) <= 2 and v[0] in skip)) == classes(wordy)


def test_empty(spark):
    assert minhash.near_classes(frame(spark, [])).count() == 0


def test_what_stays_apart_is_compared_in_full(spark):
    """Without further pivots, all classes still come out: chains whose ends are unlike the pivot."""
    rnd = random.Random(9)
    words = text(rnd, 120).split()
    rows = []
    for i in range(40):
        own = list(words)
        for j in range(i // 2, i // 2 + 3):
            own[5 * j % 115] = f"edit{j}"
        rows.append((i, " ".join(own)))
    rows = small(rows)
    out, by = found(minhash.near_classes(frame(spark, rows), turns=0))
    assert sorted(sorted(v) for v in by.values()) == classes(rows)


def test_class_keys_tell_classes_apart_that_share_an_id(spark):
    """All rows, with unlike texts under one id and without any."""
    rows = documents() + small([(None, "a text without an id, of its own words"), (None, "another one, quite unlike the first of them"), (None, None), (None, "")])
    got = minhash.near_classes(frame(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.class_key, []).append(-1 if r.doc_id is None else r.doc_id)
    assert all(r.class_size == len(by[r.class_key]) for r in got)
    wordless = [[-1 if r[0] is None else r[0]] for r in rows if not shingles(r[1])]
    assert sorted(sorted(v) for v in by.values()) == sorted(classes([r for r in rows if shingles(r[1])]) + wordless)
