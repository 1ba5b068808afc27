import random
import re
from collections import Counter

import numpy as np

from fiberloom.llm import quality
from tests.llm.fixtures import documents, frame, small

WORD = re.compile(quality.WORD)


def base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(quality.SYMBOL, text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    rows = documents() + [(d, t, "en", "q", 0, 7, "k", 1, 2, 0.5, "h", "b") for d, t in ((1000, "a b c a b c"), (1001, "x x x x"), (1002, " \n\x0b a b \U0001f600# \n#\n#"), (1003, "a\na\n\n \na b"), (1004, "a b c d a b c e b c d"))]
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(frame(spark, rows)).collect())
    want = sorted((d[0] or -1, *base(d[1]), base(d[1])[0] < 50 or 100 * base(d[1])[4] > 50 * base(d[1])[0]) for d in rows)
    assert got == want


def mcd(x, share, steps):
    """The same steps in plain arrays."""
    bins = lambda v: np.floor(v * quality.BINS_PER_E)
    inside = np.ones(len(x), bool)
    for k in range(x.shape[1]):
        b = bins(x[:, k])
        values, n = np.unique(b, return_counts=True)
        upto = n.cumsum()
        ok = values[(upto > len(x) * (1 - share) / 2) & (upto - n < len(x) * (1 + share) / 2)]
        inside &= (b >= ok.min()) & (b <= ok.max())
    take, scale = inside if inside.any() else np.ones(len(x), bool), 1.0
    for step in range(steps + 1):
        mean = x[take].mean(axis=0)
        cov = ((x[take].T @ x[take]) / take.sum() - np.outer(mean, mean)) * scale + np.diag(np.square(quality.FLOORS))
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        b = np.floor(np.log1p(d) * quality.BINS_PER_E)
        order = np.sort(b)
        take = np.searchsorted(order, b, "left") < len(x) * share
        scale = quality.CONSISTENCY if step == steps - 1 else 1.0
    return d


def test_distances(spark):
    rnd = random.Random(4)
    make = lambda odd: " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 9))) + ("$$#" if odd else "") for _ in range(rnd.randint(60, 200)))
    rows = [(i, make(i % 15 == 0), "en", "a", 0, 7, "k", 1, 2, 0.5, "h", "b") for i in range(150)]
    got = {r.doc_id: r for r in quality.judge(frame(spark, rows)).collect()}
    stats = np.array([base(r[1]) for r in rows], dtype=float)
    n, chars, symbols, lines, repeat = stats.T
    x = np.stack([np.log(chars / n), np.log1p(symbols / chars * 100) / 2, np.log1p(repeat / n * 20) / 2, np.log1p(lines * 100 / n) / 2], axis=1)
    want = mcd(x, quality.SHARE, quality.STEPS)
    assert np.allclose([got[r[0]].distance for r in rows], want, rtol=1e-6)
    assert all(got[i].kept == (i % 15 != 0) for i in range(150))


def test_some_symbols_go_and_clean_texts_stay(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(2, 9)))
    lines = lambda: [" ".join(word() for _ in range(8)) for _ in range(rnd.randint(12, 25))]

    def junk(share):
        chars = list("\n".join(lines()))
        at = [i for i, c in enumerate(chars) if c not in " \n"]
        for i in rnd.sample(at, round(len(at) * share / 100)):
            chars[i] = rnd.choice("#*$%&|<>")
        return "".join(chars)

    clean = ["\n".join(lines()) for _ in range(160)]
    odd = [clean[0] + " #", clean[1] + "\n" + clean[1].split("\n")[3]]
    bad = [junk(8 + i % 7) for i in range(21)]
    got = {r.doc_id: r for r in quality.judge(frame(spark, small(enumerate(clean + odd + bad)))).collect()}
    first = len(clean) + len(odd)
    assert [i for i in got if got[i].kept != (i < first)] == []


def test_no_python_in_the_plan(spark):
    plan = quality.judge(frame(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.split("== Physical Plan ==")[1])


def test_empty(spark):
    assert quality.judge(frame(spark, [])).count() == 0


def fast_mcd(x, share, draws=60):
    """Plain FastMCD: many random starts, exact shares by sorting, steps until the determinant stops falling."""
    rnd, h, best = np.random.default_rng(1), int(np.ceil(len(x) * share)), (np.inf, None)
    for _ in range(draws):
        take, last = rnd.choice(len(x), 8, replace=False), np.inf
        for _ in range(100):
            mean = x[take].mean(axis=0)
            cov = x[take].T @ x[take] / len(take) - np.outer(mean, mean) + np.diag(np.square(quality.FLOORS))
            det = np.linalg.slogdet(cov)[1]
            if len(take) == h and det >= last - 1e-12:
                break
            last = det if len(take) == h else np.inf
            take = np.argsort(np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean), kind="stable")[:h]
        if det < best[0]:
            best = det, take
    return best


def test_determinants_against_fast_mcd(spark):
    """Clusters, a far third, and a scattered cloud: the determinant found is the least one, but for what a bin holds more."""
    rnd = np.random.default_rng(3)
    clouds = {
        "one": rnd.normal(0, 0.2, (400, 4)),
        "far": np.r_[rnd.normal(1, 0.1, (300, 4)), rnd.normal(4, 0.1, (90, 4))],
        "line": np.c_[rnd.normal(0, 0.5, 400), rnd.normal(0, 0.02, (400, 3))] + np.r_[np.zeros((330, 4)), rnd.uniform(-3, 3, (70, 4))],
    }
    rows = [(g, *map(float, r)) for g, x in clouds.items() for r in x]
    vectors = quality.settle(spark.createDataFrame(rows, "g string, x0 double, x1 double, x2 double, x3 double"), "test-vectors")
    got = {r.g: r for r in quality.spread(quality.concentrate(vectors, "g"), ["g"]).collect()}
    for g, x in clouds.items():
        det, take = fast_mcd(x, quality.SHARE)
        mean = np.array([got[g][f"_s{i}"] / got[g]["_n"] for i in range(4)])
        assert abs(got[g]["_det"] - det) < 0.25 and np.abs(mean - x[take].mean(axis=0)).max() < 0.05
        assert len(x) * quality.SHARE <= got[g]["_n"] <= len(x) * (quality.SHARE + 0.06)


def test_small_groups_lean_on_their_language(spark):
    """A group of one text like all others of its language is not rejected; an odd one is."""
    rnd = random.Random(8)
    make = lambda odd: " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 9))) + ("$$#" if odd else "") for _ in range(120))
    rows = [(i, make(False), "en", f"s{i % 3}", 0, 7, "k", 1, 2, 0.5, "h", "b") for i in range(120)]
    rows += [(200, make(False), "en", "alone", 0, 7, "k", 1, 2, 0.5, "h", "b"), (201, make(True), "en", "odd", 0, 7, "k", 1, 2, 0.5, "h", "b"), (202, make(True), None, None, 0, 7, "k", 1, 2, 0.5, "h", "b")]
    got = {r.doc_id: r.kept for r in quality.judge(frame(spark, rows)).collect()}
    assert [got[i] for i in (200, 201, 202)] == [True, False, False] and all(got[i] for i in range(120))
