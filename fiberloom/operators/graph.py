"""Graph operators on edge tables: connected components, closures and bounded paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiberloom.scratch import discard, settle


def connected_components(edges: DataFrame, left: str, right: str, most_rounds: int = 64) -> DataFrame:
    """(node, component): the least node of its component, for every node that has an edge.

    Alternates large-star and small-star steps, each a grouping and an equi-join on the node, until the edges
    are stars around the least nodes; rounds grow with the logarithm of a component's size.  Only the number
    of edges and a checksum of them reach the driver.  Null ends are ignored, as are loops, except that a node with
    nothing but a loop is its own component.
    """
    pairs = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null")
    nodes = settle(pairs.select("u").union(pairs.select("v")).distinct(), "cc-nodes")
    now = settle(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = settle(large, "cc-large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = settle(small.unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc-edges")
        discard(now, large)
        now = after
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == (seen["n"], seen["h"]):
            break
        mark = (seen["n"], seen["h"])
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    return nodes.join(now.withColumnRenamed("u", "node"), nodes["u"] == F.col("node"), "left").select(nodes["u"].alias("node"), F.coalesce("v", nodes["u"]).alias("component"))


def closure(edges: DataFrame, child: str, parent: str, most_depth: int = 64) -> DataFrame:
    """(descendant, ancestor, depth): all that is reached over ``edges``, at the least depth; cycles end by themselves.

    Each round joins only what the last one found and writes only what is new; it ends when nothing comes.
    """
    step = settle(edges.select(F.col(child).alias("descendant"), F.col(parent).alias("via")).where("descendant is not null and via is not null").distinct(), "closure-edges")
    known = front = settle(step.select("descendant", F.col("via").alias("ancestor"), F.lit(1).cast("long").alias("depth")), "closure-front")
    up = step.select(F.col("descendant").alias("ancestor"), F.col("via").alias("next"))
    for depth in range(2, most_depth + 1):
        found = front.join(up, "ancestor").select("descendant", F.col("next").alias("ancestor")).distinct()
        found = found.join(known, ["descendant", "ancestor"], "left_anti").withColumn("depth", F.lit(depth).cast("long"))
        front = settle(found, "closure-front")
        if front.isEmpty():
            return known
        known = known.unionByName(front)
    raise RuntimeError(f"closure is deeper than {most_depth}")


def all_paths(spark, edges_view: str, roots_view: str, most_depth: int = 16) -> DataFrame:
    """(target, path) of all simple paths from the roots over edges (src, dst), both given as views, by a recursive query."""
    return spark.sql(f"""
        WITH RECURSIVE walk(target, path, depth) AS (
          SELECT id, array(id), 0 FROM {roots_view}
          UNION ALL
          SELECT e.dst, concat(w.path, array(e.dst)), w.depth + 1
          FROM walk w JOIN {edges_view} e ON e.src = w.target
          WHERE w.depth < {most_depth} AND NOT array_contains(w.path, e.dst))
        SELECT target, path FROM walk""")


def path_counts(edges: DataFrame, src: str, dst: str, root, most_depth: int = 1000) -> DataFrame:
    """(target, n_paths) of an acyclic graph: how many paths lead from the root to each node.

    Counts are summed by node and length, so no path is ever made; a graph still walked after ``most_depth`` steps is an error.
    """
    step = settle(edges.select(F.col(src).alias("target"), F.col(dst).alias("_to")), "count-edges")
    found = front = settle(step.sparkSession.createDataFrame([(root, 1)], f"target {dict(step.dtypes)['target']}, n_paths long"), "count-front")
    for _ in range(most_depth):
        front = settle(front.join(step, "target").groupBy("_to").agg(F.sum("n_paths").alias("n_paths")).withColumnRenamed("_to", "target"), "count-front")
        if front.isEmpty():
            return found.groupBy("target").agg(F.sum("n_paths").alias("n_paths"))
        found = found.unionByName(front)
    raise RuntimeError(f"paths are longer than {most_depth}: a cycle?")


def dominators_from(edges: DataFrame, src: str, dst: str, root, most_depth: int = 1000) -> DataFrame:
    """(target, dominator): nodes other than itself that lie on every path from the root to the target; cycles may occur.

    Candidates are the nodes of one shortest path to each target, as every dominator lies on that; those are dropped that some
    predecessor neither is nor has, until none is.  Rows are as many as nodes times their depth, not as paths.
    """
    step = settle(edges.select(F.col(src).alias("_from"), F.col(dst).alias("target")).distinct(), "dom-edges")
    seen = front = settle(step.sparkSession.createDataFrame([(root,)], f"target {dict(step.dtypes)['target']}"), "dom-front")
    above = None
    for _ in range(most_depth):
        found = front.withColumnRenamed("target", "_from").join(step, "_from").join(seen, "target", "left_anti").groupBy("target").agg(F.min("_from").alias("dominator"))
        found = settle(found, "dom-front")
        if found.isEmpty():
            break
        more = found if above is None else found.unionByName(found.select("target", F.col("dominator").alias("_via")).join(above.withColumnRenamed("target", "_via"), "_via").select("target", "dominator"))
        level = settle(more, "dom-level")
        above = level if above is None else above.unionByName(level)
        front, seen = found.select("target"), seen.unionByName(found.select("target"))
    else:
        raise RuntimeError(f"nodes are further than {most_depth} from the root")
    if above is None:
        return seen.select("target", F.col("target").alias("dominator")).limit(0)
    reached = settle(step.join(seen.withColumnRenamed("target", "_from"), "_from", "left_semi").where(F.col("target") != F.lit(root)), "dom-reached")
    now = settle(above, "dom")
    while True:
        asked = now.join(reached, "target").where("dominator <> _from")
        lacking = asked.join(now.select(F.col("target").alias("_from"), "dominator"), ["_from", "dominator"], "left_anti").select("target", "dominator").distinct()
        lacking = settle(lacking, "dom-lacking")
        if lacking.isEmpty():
            return now
        now = settle(now.join(lacking, ["target", "dominator"], "left_anti"), "dom")


def dominators(paths: DataFrame) -> DataFrame:
    """(target, dominator): nodes other than itself that lie on every path to the target."""
    totals = paths.groupBy("target").agg(F.count("*").alias("_all"))
    on = paths.select("target", F.explode(F.array_distinct("path")).alias("dominator")).groupBy("target", "dominator").agg(F.count("*").alias("_n"))
    return on.join(totals, "target").where("_n = _all and target <> dominator").select("target", "dominator")


def boundary(edges: DataFrame, inside: DataFrame, left: str, right: str, node: str) -> DataFrame:
    """Edges that leave a set of nodes."""
    into = inside.select(F.col(node).alias(left)).distinct()
    return edges.join(into, left, "left_semi").join(inside.select(F.col(node).alias(right)).distinct(), right, "left_anti")
