"""Queries without SQL against plain searches over whole tables."""

from collections import defaultdict
from itertools import combinations

import pytest

from fiberloom.operators import search
from fiberloom.plans import registry
from tests.oracle import DATA, connect

FOLDER = DATA / "sf0.001"


@pytest.fixture(scope="module")
def rows():
    c = connect(FOLDER)
    return lambda sql: c.sql(sql).fetchall()


def got(spark, name):
    return sorted(tuple(r) for r in registry.QUERIES[name](spark, str(FOLDER)).collect())


def grouped(rows):
    out = defaultdict(list)
    for key, *rest in rows:
        out[key].append(tuple(rest))
    return out


def test_beam_trajectories(spark, rows):
    want = []
    for brand, parts in grouped(rows("SELECT p_brand, p_partkey, p_type, p_size FROM part")).items():
        front = [(0, (), frozenset())]
        for _ in range(4):
            grown = [(t + g, (*path, i), used | {c}) for t, path, used in front for i, c, g in parts if c not in used]
            front = sorted(grown, key=lambda s: (-s[0], s[1]))[:8] or front
            if not grown:
                break
        want += [(brand, k + 1, i, front[0][0]) for k, i in enumerate(front[0][1])]
    assert got(spark, "beam_trajectories") == sorted(want)


def test_concept_lattice(spark, rows):
    want = set()
    for region, pairs in grouped(rows("SELECT DISTINCT n_regionkey, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey")).items():
        has, names = {n: {s for m, s in pairs if m == n} for n, _ in pairs}, sorted({s for _, s in pairs})
        for k in range(len(names) + 1):
            for some in combinations(names, k):
                extent = [v for v in has.values() if set(some) <= v]
                closed = set.intersection(*extent) if extent else set(names)
                want.add((region, ",".join(sorted(closed)), len(extent)))
    assert got(spark, "concept_lattice") == sorted(want)


def test_maximal_cliques(spark, rows):
    want = []
    for size, pairs in grouped(rows("SELECT DISTINCT p_size, p_brand, p_type FROM part")).items():
        types = {b: {t for c, t in pairs if c == b} for b, _ in pairs}
        near = lambda a, b: types[a] & types[b]  # noqa: B023, E731
        whole = [set(s) for k in range(2, len(types) + 1) for s in combinations(sorted(types), k) if all(near(a, b) for a, b in combinations(s, 2))]
        want += [(",".join(f"{size}/{b}" for b in sorted(s)), len(s)) for s in whole if not any(s < o for o in whole)]
    assert got(spark, "maximal_cliques") == sorted(want)


def test_execution_groups(spark, rows):
    want = []
    for brand, parts in grouped(rows("SELECT p_brand, p_partkey, p_type FROM part")).items():
        batches = []
        for i, t in sorted(parts):
            at = next((k for k, used in enumerate(batches) if t not in used), len(batches))
            batches += [set()] * (at == len(batches))
            batches[at] = batches[at] | {t}
            want.append((brand, i, at))
    assert got(spark, "execution_groups") == sorted(want)


def test_pattern_cover(spark, rows):
    """As large as any cover must be at least, and whole."""
    found = grouped(got(spark, "pattern_cover"))
    parts = grouped(rows("SELECT DISTINCT p_type, p_brand, p_size FROM part"))
    assert set(found) == set(parts)
    for kind, pairs in parts.items():
        assert {s for b, s in pairs if b in {b for _, b in found[kind]}} == {s for _, s in pairs}


def test_fewest_against_all_choices():
    import random

    rnd = random.Random(8)
    for _ in range(200):
        sets = {f"s{i:02}": {rnd.randrange(9) for _ in range(rnd.randint(0, 4))} for i in range(rnd.randint(0, 8))}
        every = set().union(*sets.values())
        want = next(some for k in range(9) for some in combinations(sorted(sets), k) if set().union(*(sets[s] for s in some)) == every)
        assert search.fewest(sets) == want


def test_greedy_cover(spark, rows):
    """Each pick has most brands that no pick before it has (ties: the least supplier), until all are covered."""
    owned = defaultdict(set)
    for s, b in rows("SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey"):
        owned[s].add(b)
    left, want = set().union(*owned.values()), []
    while left:
        gain, pick = min((-len(v & left), s) for s, v in owned.items())
        want.append((len(want) + 1, pick, -gain))
        left -= owned[pick]
    assert sorted(tuple(r) for r in registry.QUERIES["greedy_cover"](spark, str(FOLDER)).collect()) == want
