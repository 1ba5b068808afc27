"""Searches inside small groups, spread over the groups; group sizes are checked before anything is searched."""

from __future__ import annotations

from itertools import combinations, count, islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fiberloom.operators.graph import connected_components
from fiberloom.scratch import settle

MOST_IN_GROUP = 5_000


def checked(df: DataFrame, group: str, most: int = MOST_IN_GROUP) -> DataFrame:
    """``df``, or an error that names a group with more than ``most`` rows; such groups are not cut short."""
    large = df.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > most).limit(1).collect()
    if large:
        raise ValueError(f"group {large[0][0]!r} has {large[0]['n']} rows; this search takes at most {most}")
    return df


def greedy_cover(pairs: DataFrame, owner: str, item: str, most_rounds: int | None = None) -> DataFrame:
    """(rank, owner, gain): the owner with most uncovered items (ties: least owner), until no one adds any.

    Items left after ``most_rounds`` are an error; None is no bound, as each round covers an item at least.
    Each round is an aggregate and an anti-join on the executors; one row reaches the driver.
    """
    left = settle(pairs.select(F.col(owner).alias("owner"), F.col(item).alias("item")).distinct(), "cover")
    picked = []
    for rank in count(1):
        best = left.groupBy("owner").agg(F.count("*").alias("gain")).orderBy(F.desc("gain"), "owner").limit(1).collect()
        if not best:
            break
        if most_rounds is not None and rank > most_rounds:
            raise ValueError(f"items are left after {most_rounds} rounds")
        picked.append((rank, best[0]["owner"], best[0]["gain"]))
        left = settle(left.join(left.where(F.col("owner") == best[0]["owner"]).select("item"), "item", "left_anti").select("owner", "item"), "cover")
    kind = dict(pairs.dtypes)[owner]
    return pairs.sparkSession.createDataFrame(picked, f"rank long, {owner} {kind}, gain long")


def heaviest_independent(df: DataFrame, family: str, row_id: str, resource: str, weight: str) -> DataFrame:
    """(family, row_id, weight): the heaviest choice of rows of which no two use the same resource.

    Conflicts form cliques by resource, so the exact answer is the heaviest row of each (ties: least id).
    """
    best = df.groupBy(family, resource).agg(F.max(F.struct(F.col(weight).alias("w"), (-F.col(row_id)).alias("i"))).alias("b"))
    return best.select(family, resource, (-F.col("b.i")).alias(row_id), F.col("b.w").alias(weight))


def independent_set(nodes: dict[str, float], conflicts: set[frozenset]) -> tuple[float, tuple[str, ...]]:
    """The heaviest set of nodes without a conflict, by branch and bound on the sum of what is left."""
    order = sorted(nodes, key=lambda n: (-nodes[n], n))
    rest = [0.0]
    for n in reversed(order):
        rest.append(rest[-1] + max(nodes[n], 0))
    rest.reverse()
    best: tuple[float, tuple[str, ...]] = (0.0, ())
    stack: list[tuple[int, float, tuple[str, ...]]] = [(0, 0.0, ())]
    while stack:
        at, total, taken = stack.pop()
        if total > best[0]:
            best = (total, taken)
        if at == len(order) or total + rest[at] <= best[0]:
            continue
        stack.append((at + 1, total, taken))
        if all(frozenset((order[at], t)) not in conflicts for t in taken):
            stack.append((at + 1, total + nodes[order[at]], (*taken, order[at])))
    return best


def beam(df: DataFrame, group: str, row_id: str, covers: str, gain: str, width: int = 8, depth: int = 4) -> DataFrame:
    """(group, step, row_id, total) of the best sequence: each step takes an uncovered item; ``width`` sequences go on.

    No sequence is followed by more than ``width`` items, so only the best ``width`` rows of what they cover come into question.
    """

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        items = sorted(zip(rows[row_id], rows[covers], rows[gain], strict=True), key=lambda r: (-r[2], r[0]))
        front = [(0, (), frozenset())]
        for _ in range(depth):
            grown = [(total + g, (*path, i), used | {c}) for total, path, used in front for i, c, g in islice((x for x in items if x[1] not in used), width)]
            if not grown:
                break
            front = sorted(grown, key=lambda s: (-s[0], s[1]))[:width]
        total, path, _ = front[0]
        return pd.DataFrame([(rows[group].iloc[0], k + 1, i, total) for k, i in enumerate(path)], columns=["group", "step", "row_id", "total"])

    kinds = dict(df.dtypes)
    place = F.row_number().over(Window.partitionBy(group, covers).orderBy(F.desc(gain), row_id))
    df = df.withColumn("_place", place).where(F.col("_place") <= width).drop("_place")
    return checked(df, group).groupBy(group).applyInPandas(search, f"`group` {kinds[group]}, step long, row_id {kinds[row_id]}, total long")


def concepts(df: DataFrame, group: str, row_object: str, attribute: str, most_attributes: int = 12) -> DataFrame:
    """(group, attributes, n_objects): every set of attributes that is closed, for groups of few attributes."""

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        has = rows.groupby(row_object)[attribute].agg(frozenset)
        names = sorted(set(rows[attribute]))
        if len(names) > most_attributes:
            raise ValueError(f"{len(names)} attributes; the lattice of all their sets is built for at most {most_attributes}")
        closed = set()
        for k in range(len(names) + 1):
            for some in combinations(names, k):
                extent = [a for a in has if set(some) <= a]
                closed.add(frozenset(names) if not extent else frozenset.intersection(*extent))
        made = [(rows[group].iloc[0], ",".join(sorted(c)), sum(c <= a for a in has)) for c in closed]
        return pd.DataFrame(sorted(made), columns=["group", "attributes", "n_objects"])

    return checked(df, group).groupBy(group).applyInPandas(search, f"`group` {dict(df.dtypes)[group]}, attributes string, n_objects long")


def maximal_cliques(edges: set[frozenset]) -> list[tuple[str, ...]]:
    """Bron-Kerbosch with pivots, without recursion."""
    near: dict[str, set[str]] = {}
    for e in edges:
        a, b = tuple(e)
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out, stack = [], [(frozenset(), set(near), set())]
    while stack:
        taken, open_, done = stack.pop()
        if not open_ and not done:
            out.append(tuple(sorted(taken)))
            continue
        pivot = max(open_ | done, key=lambda n: (len(near[n] & open_), n))
        for n in sorted(open_ - near[pivot]):
            stack.append((taken | {n}, open_ & near[n], done & near[n]))
            open_, done = open_ - {n}, done | {n}
    return sorted(out)


def cliques(edges: DataFrame, left: str, right: str, least: int) -> DataFrame:
    """(members, size): maximal cliques of at least ``least`` nodes, searched by connected component."""
    pairs = settle(edges.select(F.col(left).alias("u"), F.col(right).alias("v")), "clique-edges")
    parts = connected_components(pairs, "u", "v")
    placed = pairs.join(parts.withColumnRenamed("node", "u"), "u")

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        found = maximal_cliques({frozenset(e) for e in zip(rows["u"], rows["v"], strict=True) if e[0] != e[1]})
        return pd.DataFrame([(",".join(map(str, c)), len(c)) for c in found if len(c) >= least], columns=["members", "size"])

    return checked(placed, "component").groupBy("component").applyInPandas(search, "members string, size long")


def first_fit(df: DataFrame, group: str, row_id: str, resource: str) -> DataFrame:
    """(group, row_id, batch): rows in order of id, each in the first batch that does not use its resource yet.

    Batches that use a resource are the first ones, so a row's batch is its place among the rows of its resource.
    """
    place = F.row_number().over(Window.partitionBy(group, resource).orderBy(row_id)) - 1
    return df.select(F.col(group).alias("group"), F.col(row_id).alias("row_id"), place.cast("long").alias("batch"))


def fewest(sets: dict[str, set], most: int = 21) -> tuple[str, ...]:
    """The fewest sets (ties: first by name) that together hold all that any of them holds."""
    every = set().union(*sets.values()) if sets else set()
    if len(sets) > most:
        raise ValueError(f"{len(sets)} sets; the smallest cover is searched among at most {most}")
    names, places = sorted(sets), {x: i for i, x in enumerate(every)}
    masks = [sum(1 << places[x] for x in sets[n]) for n in names]
    rest = [0]
    for m in reversed(masks):
        rest.append(rest[-1] | m)
    rest.reverse()

    def cover(at: int, open_: int, left: int) -> tuple[str, ...] | None:
        """The first by name of ``left`` sets or fewer from ``at`` on that hold what is open."""
        if not open_:
            return ()
        if open_ & ~rest[at] or open_.bit_count() > left * max(((m & open_).bit_count() for m in masks[at:]), default=0):
            return None
        for i in range(at, len(masks)):
            if open_ & ~rest[i]:
                return None
            if masks[i] & open_ and (found := cover(i + 1, open_ & ~masks[i], left - 1)) is not None:
                return (names[i], *found)
        return None

    return next(found for k in range(len(sets) + 1) if (found := cover(0, (1 << len(every)) - 1, k)) is not None)


def minimum_cover(df: DataFrame, group: str, owner: str, item: str, most: int = 30) -> DataFrame:
    """(group, rank, owner): the fewest owners of a group that have all its items."""

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        found = fewest({o: set(v) for o, v in rows.groupby(owner)[item]}, most)
        return pd.DataFrame([(rows[group].iloc[0], k + 1, o) for k, o in enumerate(found)], columns=["group", "rank", "owner"])

    kinds = dict(df.dtypes)
    return checked(df, group).groupBy(group).applyInPandas(search, f"`group` {kinds[group]}, rank long, owner {kinds[owner]}")


def topological(nodes: list[str], needs: dict[str, set[str]]) -> list[str]:
    """Nodes after all they need, the first by name among those that can come next; raises on a cycle."""
    left, out = sorted(nodes), []
    while left:
        ready = [n for n in left if not (needs.get(n, set()) & set(left))]
        if not ready:
            raise ValueError(f"a cycle among {left}")
        out.append(ready[0])
        left.remove(ready[0])
    return out
