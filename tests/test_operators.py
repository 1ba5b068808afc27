from itertools import combinations

import pytest
from pyspark.sql import functions as F

from fiberloom import scratch
from fiberloom.functions import costs, names
from fiberloom.operators import graph, grouping, incremental, matching, ranking, search
from fiberloom.sources import sinks


def test_dependencies_of_three_rows(spark):
    df = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 2, 1)], "id string, x int, y int")
    holds = lambda given: {r.axis for r in grouping.determined_axes(df, given, ["x", "y"]).collect() if r.determined}
    assert holds(["x"]) == {"x", "y"} and holds(["y"]) == {"y"} and holds([]) == {"y"}
    g = grouping.geometry(df, ["x"]).first()
    assert (g.n_fibers, g.max_fiber, g.collision_excess, g.bits, g.injective) == (2, 2, 1, 1, False)
    assert grouping.minimal_keys(df, ["id", "x", "y"]) == [("id",)]
    assert [(r.left_id, r.right_id) for r in grouping.dependency_violations(df, ["y"], "x", "id").orderBy("left_id").collect()] == [("a", "c"), ("b", "c")]


def test_nulls_are_values_in_dependencies(spark):
    df = spark.createDataFrame([(1, None), (1, 5), (2, None)], "x int, y int")
    assert not [r for r in grouping.determined_axes(df, ["x"], ["y"]).collect() if r.determined]


def test_bits_and_certificates(spark):
    df = spark.range(6).withColumn("bits", costs.ceil_log2(F.col("id")))
    assert [r.bits for r in df.orderBy("id").collect()] == [0, 0, 1, 2, 2, 3]
    made = costs.certificate(F.lit(12), F.lit(1), F.lit(2), F.lit(4), F.lit(1), F.lit(1))
    assert spark.range(1).select(*[e.alias(k) for k, e in made.items()]).first().asDict() == {"before": 12, "after": 7, "margin": 0, "savings": 5, "pays_rent": True}
    assert spark.range(1).select(costs.load_score(*map(F.lit, (3, 2, 2, 130, 40)))).first()[0] == 510


def test_cohorts(spark):
    df = spark.createDataFrame([("A", f) for f in "fgh"] + [("B", f) for f in "fg"] + [("C", "f")], "w string, f string")
    assert [tuple(r) for r in grouping.cohorts(df, "w", "f", 2).collect()] == [("f,g", 2, 2, "A,B")]


def test_token_gate(spark):
    right = [(k, f"{k}{i}") for k, n in (("p", 5), ("q", 4), ("r", 10), ("s", 1)) for i in range(n)]
    left = [(1, f"{k}{i}") for k, n in (("p", 2), ("q", 2), ("r", 3), ("s", 1)) for i in range(n)]
    got = matching.token_edges(spark.createDataFrame(left, "l long, t string"), spark.createDataFrame(right, "r string, t string"), "l", "r", "t")
    assert sorted(r.r for r in got.collect()) == ["q", "r"]


def test_unique_suffixes_fail_closed(spark):
    one = spark.createDataFrame([("types.Target",), ("other.Unrelated",)], "s string")
    two = spark.createDataFrame([("left.types.Target",), ("right.types.Target",)], "s string")
    get = lambda df: {r.name: r.target for r in matching.unique_suffixes(df, "s").collect()}
    assert get(one)["Target"] == "types.Target" and "types.Target" not in get(two) and "Target" not in get(two)


def test_components_and_closure(spark):
    edges = [(1, 2), (2, 3), (4, 5), (6, 6), (None, 1)] + [(i, i + 1) for i in range(100, 160)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5, 6)] == [1, 1, 1, 4, 4, 6] and {got[i] for i in range(100, 161)} == {100}
    loop = graph.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "x string, y string"), "x", "y")
    assert {(r.descendant, r.ancestor, r.depth) for r in loop.collect() if r.descendant == "d"} == {("d", "a", 1), ("d", "b", 2), ("d", "c", 3)}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_cliques_and_independent_sets():
    edges = {frozenset(e) for e in combinations("abcd", 2)} - {frozenset("ad")} | {frozenset("de")}
    assert search.maximal_cliques(edges) == [("a", "b", "c"), ("b", "c", "d"), ("d", "e")]
    total, taken = search.independent_set({"a": 3, "b": 2, "c": 2, "d": 1}, {frozenset("ab"), frozenset("ac")})
    assert (total, set(taken)) == (5, {"b", "c", "d"})


def test_groups_too_large_for_a_search_are_refused(spark):
    df = spark.range(50).select(F.lit("g").alias("g"), "id")
    with pytest.raises(ValueError, match="at most 10"):
        search.checked(df, "g", 10)


def test_cover(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 2), ("y", 3), ("y", 4), ("z", 1)], "o string, i long")
    assert [tuple(r) for r in search.greedy_cover(df, "o", "i").collect()] == [(1, "y", 3), (2, "x", 1)]


def test_names(spark):
    row = spark.range(1).select(names.normalized(F.lit("AlphaHandler-x.Y")), names.tokens(F.lit("fooBar_foo")), names.variants(F.lit("AlphaHandler"), ("handler",)), names.public_name(F.array(F.lit("alpha"), F.lit("handler"))), names.common_prefix(F.lit("Alpha"), F.lit("Alps")), names.symbol_root(F.lit("a:b.c")), names.parents(F.lit("a/b/c.py"))).first()
    assert list(row) == ["alpha_handler_x_y", ["bar", "foo"], ["alpha", "alpha_handler"], "AlphaHandler", "Alp", "a", ["a", "a/b"]]


def test_runs(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate("aabbbacccc")] + [(2, 0, None), (2, 1, None), (2, 2, None)], "k long, t long, v string")
    got = sorted((r.k, r.v or "", r.n, r.first_t) for r in ranking.runs(df, ["k"], ["t"], "v", 3).collect())
    assert got == [(1, "b", 3, 2), (1, "c", 4, 6), (2, "", 3, 0)]


def test_differences_and_overlay(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k long, v string")
    b = spark.createDataFrame([(2, "y"), (3, "z"), (4, None)], "k long, v string")
    assert {(r.k, r.change) for r in matching.differences(a, b, "k", ["v"]).collect()} == {(1, "removed"), (2, "changed"), (4, "new")}
    assert {(r.k, r.v) for r in matching.overlay(a, b, "k").collect()} == {(1, "x"), (2, "y"), (3, "z"), (4, None)}


def test_digest_is_of_the_bag(spark):
    rows = [(1, "x"), (2, None), (2, None)]
    d = lambda r: incremental.input_digest(spark.createDataFrame(r, "k long, v string"))
    assert d(rows) == d(rows[::-1]) != d(rows[:2]) and d([]) == d([])


def test_numbers_and_neighbours_over_ranges(spark):
    df = spark.createDataFrame([(v,) for v in (*range(0, 500, 5), None)], "v long")
    numbered = {r.v: r.n for r in scratch.number_rows(df, ["v"], "n").collect()}
    assert numbered == {v: i for i, v in enumerate(range(0, 500, 5))} | {None: 100}
    follow = {r.v: r.w for r in scratch.next_value(df.where("v is not null"), "v", "w").collect()}
    assert follow == {v: (v + 5) % 500 for v in range(0, 500, 5)}


def test_salted_join_keeps_all_rows(spark, monkeypatch):
    left = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    want = sorted(map(tuple, scratch.join_checked(left, right, "k", "left", salt_by="id").collect()), key=str)
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, scratch.join_checked(left, right, "k", "left", salt_by="id").collect()), key=str) == want


def test_publish(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    sinks.publish(df.limit(1), str(tmp_path), "t")
    sinks.publish(df, str(tmp_path), "t")
    assert sinks.latest(spark, str(tmp_path), "t").count() == 2
    m = spark.read.schema(sinks.MANIFEST).parquet(f"{tmp_path}/_manifest")
    assert sinks.to_retire(m, 1, 1 << 30).count() == 1
    with pytest.raises(LookupError):
        sinks.latest(spark, str(tmp_path), "other")


def test_covers_orders_and_batches(spark):
    assert search.fewest({"x": {1, 2}, "y": {2, 3}, "z": {1, 2, 3}}) == ("z",)
    assert search.topological(["a", "b", "c"], {"a": {"c"}, "b": {"a"}}) == ["c", "a", "b"]
    with pytest.raises(ValueError, match="cycle"):
        search.topological(["a", "b"], {"a": {"b"}, "b": {"a"}})
    df = spark.createDataFrame([("g", 1, "x"), ("g", 2, "x"), ("g", 3, "y"), ("g", 4, "x")], "g string, i long, r string")
    assert {(r.row_id, r.batch) for r in search.first_fit(df, "g", "i", "r").collect()} == {(1, 0), (2, 1), (3, 0), (4, 2)}


def test_greedy_cover_is_whole_or_an_error(spark):
    df = spark.createDataFrame([(f"o{i}", i) for i in range(4)], "o string, i long")
    assert search.greedy_cover(df, "o", "i").count() == 4
    with pytest.raises(ValueError, match="left after 3 rounds"):
        search.greedy_cover(df, "o", "i", most_rounds=3)


def test_overlaps_against_all_pairs(spark):
    import random
    from itertools import combinations

    rnd = random.Random(4)
    sets = {i: {"hot"} | {f"t{rnd.randrange(25)}" for _ in range(rnd.randint(0, 8))} for i in range(60)}
    df = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "i long, t string")
    for least in (1, 2, 4):
        want = sorted((a, b, len(sets[a] & sets[b])) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least)
        assert sorted(map(tuple, matching.overlap_pairs(df, "i", "t", least).collect())) == want
    other = {f"r{i}": {"hot"} | {f"t{rnd.randrange(25)}" for _ in range(rnd.randint(1, 12))} for i in range(30)}
    right = spark.createDataFrame([(i, t) for i, s in other.items() for t in s], "r string, t string")
    for least, sure, ratio in ((2, 3, 0.5), (1, 9, 0.9), (4, 5, 0.1)):
        got = sorted((r.i, r.r, r.n_shared, r.total) for r in matching.token_edges(df, right, "i", "r", "t", least, sure, ratio).collect())
        n = {(i, r): len(s & o) for i, s in sets.items() for r, o in other.items()}
        assert got == sorted((i, r, k, len(other[r])) for (i, r), k in n.items() if k >= least and (k >= sure or k / len(other[r]) >= ratio))


def test_dominators_and_path_counts(spark):
    import random

    rnd = random.Random(6)
    for trial in range(2):
        pairs = {(rnd.randrange(12), rnd.randrange(12)) for _ in range(26)} | {(0, 1)}
        near = {a: sorted(b for x, b in pairs if x == a and b != a) for a in range(12)}

        def reach(without):
            seen, todo = set(), [0] if without != 0 else []
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += [y for y in near[x] if y != without]  # noqa: B023
            return seen

        want = sorted((t, d) for t in reach(None) for d in reach(None) if d != t and t not in reach(d))
        edges = spark.createDataFrame([(a, b) for a, b in pairs if a != b], "a long, b long")
        assert sorted(map(tuple, graph.dominators_from(edges, "a", "b", 0).collect())) == want
        down = sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]})
        ways = {0: 1}
        for t in range(1, 12):
            ways[t] = sum(ways[a] for a, b in down if b == t)
        got = {r.target: r.n_paths for r in graph.path_counts(spark.createDataFrame(down, "a long, b long"), "a", "b", 0).collect()}
        assert got == {t: n for t, n in ways.items() if n}


def test_pairs_alike_are_counted_without_pairs(spark):
    import random
    from itertools import combinations

    rnd = random.Random(2)
    rows = [(rnd.randrange(4), rnd.randrange(3), rnd.choice(("x", None))) for _ in range(50)]
    df = spark.createDataFrame(rows, "a long, b long, c string")
    views = [["a"], ["b", "c"], ["a", "c"]]
    alike = lambda p, q: any(all(p["abc".index(x)] == q["abc".index(x)] for x in v) for v in views)
    assert grouping.confusable_count(df, views).first().edges == sum(alike(p, q) for p, q in combinations(rows, 2))


def test_no_text_of_an_atom_meets_the_pairs(spark):
    df = spark.createDataFrame([(i, f"a line that is long {k}") for i in range(6) for k in range(3)], "row long, wording string")
    got = matching.overlap_pairs(df, "row", "wording", 2)
    assert "wording" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(a, b, 3) for a, b in combinations(range(6), 2)]


def test_copies_make_pairs_once_their_sets_are_counted(spark, monkeypatch):
    made = {}
    monkeypatch.setattr(matching, "settle", lambda df, label: made.setdefault(label, scratch.settle(df, label)))
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", 0)
    kinds = [{"a", "b", "c"}, {"b", "c", "d"}, {"d", "e"}, {"e", "f"}]
    rows = {i: kinds[i % 4] for i in range(40)}
    df = spark.createDataFrame([(i, t) for i, s in rows.items() for t in s], "i long, t string")
    want = sorted((a, b, len(rows[a] & rows[b])) for a, b in combinations(rows, 2) if len(rows[a] & rows[b]) >= 2)
    assert sorted(map(tuple, matching.overlap_pairs(df, "i", "t", 2).collect())) == want
    assert made["overlap-sets"].count() == 4


def test_confusable_pairs_are_made_once(spark):
    rows = [(i, i % 3 if i % 7 else None, i % 4, i % 2) for i in range(40)]
    views = [["a", "b"], ["b", "c"], ["a"]]
    alike = lambda x, y: x[1:3] == y[1:3] or x[2:] == y[2:] or x[1] == y[1]
    want = sorted((x[0], y[0]) for x, y in combinations(rows, 2) if alike(x, y))
    got = grouping.confusable_pairs(spark.createDataFrame(rows, "i int, a int, b int, c int"), "i", views)
    assert sorted(map(tuple, got.collect())) == want
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    twice = grouping.confusable_pairs(spark.createDataFrame([*rows, *rows], "i int, a int, b int, c int"), "i", views)
    assert sorted(map(tuple, twice.collect())) == want


@pytest.mark.parametrize("broadcast", [24 << 20, 0])
def test_related_pairs_are_weighed_where_they_are_made(spark, monkeypatch, broadcast):
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", broadcast)
    for name, value in (("SETS_A_BLOCK", 2), ("SETS_A_TASK", 5), ("MEMBERS", 3)):
        monkeypatch.setattr(matching, name, value, raising=False)
    places = [(i, i % 4 if i % 9 else None) for i in range(50)]
    tags = [(i, f"t{k}") for i in range(50) for k in range(8) if (i % 5 * 3 + k) % 4 < 2] + [(7, None), (None, "t1"), (60, "t1"), (60, "lone")]
    parts = [(places, "id long, key int", 3), (tags + tags[:9], "id long, key string", 1)]
    own = [({}, weight) for *_, weight in parts]
    for (rows, _, _), (keys, _) in zip(parts, own, strict=True):
        for i, k in rows:
            keys.setdefault(i, set()).update([] if k is None else [k])
    weigh = lambda a, b: sum(weight * len(keys.get(a, set()) & keys.get(b, set())) for keys, weight in own)
    frames = [(spark.createDataFrame(rows, schema), weight) for rows, schema, weight in parts]
    for least in (1, 3, 5):
        got = matching.relation_graph(frames, least)
        assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
        want = [(a, b, weigh(a, b)) for a, b in combinations([*range(50), 60], 2) if weigh(a, b) >= least]
        assert sorted(map(tuple, got.collect())) == want
    with pytest.raises(ValueError):
        matching.relation_graph([(frames[0][0], -1)], 1)


def test_violations_of_one_key_are_the_work_of_many_tasks(spark, monkeypatch):
    for name, value in (("PAIR_BLOCK", 10), ("PAIRS_A_TASK", 500)):
        monkeypatch.setattr(grouping, name, value, raising=False)
    rows = [("hot", 1, i % 3 or None, i) for i in range(120)] + [("hot", 1, 9, 5), ("hot", None, 1, 6), ("hot", None, 2, 7), ("same", 1, 4, 8), ("same", 1, 4, 9), ("two", 1, 1, 10), ("two", 1, None, 11), ("two", 1, 3, None)]
    df = spark.createDataFrame(rows, "a string, b int, v int, i long")
    got = grouping.dependency_violations(df, ["a", "b"], "v", "i")
    assert got.columns == ["a", "b", "left_value", "left_id", "right_value", "right_id"]
    known = [r for r in rows if r[1] is not None and r[3] is not None]
    want = [(x[0], x[1], x[2], x[3], y[2], y[3]) for x in known for y in known if x[:2] == y[:2] and x[3] < y[3] and x[2] != y[2]]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    per_task = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(per_task) > 4 and max(per_task) < len(want) / 2


def test_rows_that_look_alike_are_paired_by_chunks(spark):
    """A thousand rows in twenty kinds, some without an id: pairs are joined as chunks, not as rows."""
    rows = [(i if i != 5 else None, i % 10, i % 4, 1) for i in range(1000)]
    got = grouping.confusable_pairs(spark.createDataFrame(rows, "i int, a int, b int, c int"), "i", [["a", "c"], ["b", "c"]])
    want = sorted((x[0], y[0]) for x, y in combinations([r for r in rows if r[0] is not None], 2) if x[1] == y[1] or x[2] == y[2])
    assert sorted(map(tuple, got.collect())) == want
    assert "explode" in got._jdf.queryExecution().optimizedPlan().toString()
    joined = []

    def look(node):
        if "Join" in node.nodeName():
            joined.append(node.metrics().apply("numOutputRows").value())
        inner = node.executedPlan() if "AdaptiveSparkPlan" in node.nodeName() else node.plan() if "QueryStage" in node.nodeName() else None
        if inner is not None:
            look(inner)
        for k in range(node.children().size()):
            look(node.children().apply(k))

    look(got._jdf.queryExecution().executedPlan())
    assert joined and sum(joined) < len(want) / 100
