"""Components, closures, paths and small searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from fiberloom.operators import graph, search
from fiberloom.plans.registry import query


@query("""
WITH RECURSIVE l AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 20),
s AS (SELECT line, min(doc_id) AS hub FROM l GROUP BY line HAVING count(*) > 1), e AS (SELECT DISTINCT doc_id AS a, hub AS b FROM l JOIN s USING (line) WHERE doc_id <> hub),
n AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
walk AS (SELECT DISTINCT a AS node, a AS label FROM n UNION SELECT n.b, w.label FROM walk w JOIN n ON n.a = w.node AND w.label < n.b)
SELECT node, min(label) AS component FROM walk GROUP BY node
""")
def connected_components(spark, table):
    """Documents that share any long line; each line is a star around its least document, so no pairs are made."""
    lines = table("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") > 20).distinct()
    hubs = lines.groupBy("line").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    return graph.connected_components(lines.join(hubs, "line").where("doc_id <> hub"), "doc_id", "hub")


@query("""
WITH RECURSIVE e AS (SELECT conv_id, turn, turn - 1 AS up FROM conversations WHERE turn > 0), c AS (SELECT conv_id, turn, up, 1 AS depth FROM e UNION ALL SELECT c.conv_id, c.turn, e.up, c.depth + 1 FROM c JOIN e ON e.conv_id = c.conv_id AND e.turn = c.up)
SELECT conv_id || '.' || turn AS descendant, conv_id || '.' || up AS ancestor, min(depth)::BIGINT AS depth FROM c GROUP BY 1, 2
""")
def lineage_closure(spark, table):
    name = lambda turn: F.concat_ws(".", F.col("conv_id").cast("string"), turn.cast("string"))
    edges = table("conversations").where("turn > 0").select(name(F.col("turn")).alias("child"), name(F.col("turn") - 1).alias("parent"))
    return graph.closure(edges, "child", "parent")


EDGES = """
SELECT 'root' AS src, 'r' || r_regionkey AS dst FROM region UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation
UNION SELECT 'n' || s_nationkey, 's' || (s_suppkey % 50) FROM supplier
"""


@query(f"""
WITH RECURSIVE e AS ({EDGES}), walk AS (SELECT 'root' AS target, ['root'] AS path UNION ALL SELECT e.dst, list_append(path, e.dst) FROM walk JOIN e ON e.src = target),
t AS (SELECT target, count(*) AS k FROM walk GROUP BY 1), o AS (SELECT target, node, count(*) AS k FROM (SELECT target, unnest(path) AS node FROM walk) GROUP BY 1, 2)
SELECT o.target, o.node AS dominator FROM o JOIN t ON o.target = t.target AND o.k = t.k WHERE o.node <> o.target
""")
def dominators(spark, table):
    """Regions, nations and buckets of suppliers under one root: who lies on every way to whom."""
    edge = lambda df, a, b: df.select(a.alias("src"), b.alias("dst"))
    named = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    region, nation, supplier = (table(t) for t in ("region", "nation", "supplier"))
    edges = edge(region, F.lit("root"), named("r", F.col("r_regionkey")))
    edges = edges.union(edge(nation, named("r", F.col("n_regionkey")), named("n", F.col("n_nationkey"))))
    edges = edges.union(edge(supplier, named("n", F.col("s_nationkey")), named("s", F.col("s_suppkey") % 50)))
    return graph.dominators_from(edges, "src", "dst", "root")


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) AND s_suppkey % 2 = 1")
def boundary_edges(spark, table):
    """Edges from nations of region 0 to suppliers that are not in the marked set (even numbers)."""
    edges = table("supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("a"), F.concat(F.lit("s"), "s_suppkey").alias("b"), "s_suppkey", "s_nationkey")
    inside = table("nation").where("n_regionkey = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("node")).union(table("supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("s"), "s_suppkey")))
    return graph.boundary(edges, inside, "a", "b", "node").select("s_suppkey", "s_nationkey")


@query()
def greedy_cover(spark, table):
    """Suppliers in order of what they add to the brands covered, until nothing is added."""
    pairs = table("lineitem").join(table("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("id"), F.col("p_brand").alias("item"))
    return search.greedy_cover(pairs, "id", "item")


@query("SELECT p_brand || '/' || p_size::VARCHAR AS family, p_type AS resource, arg_max(p_partkey, (round(p_retailprice, 2), -p_partkey)) AS p_partkey, max(round(p_retailprice, 2)) AS weight FROM part GROUP BY p_brand, p_size, p_type")
def mwis_selection(spark, table):
    """Of the parts of each brand and size, the heaviest set without two of one type."""
    part = table("part").select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("family"), "p_partkey", F.col("p_type").alias("resource"), F.round("p_retailprice", 2).alias("weight"))
    return search.heaviest_independent(part, "family", "p_partkey", "resource", "weight")


@query()
def beam_trajectories(spark, table):
    """For each brand, sequences of parts that cover new types at each step, by savings, within a beam."""
    part = table("part").select("p_brand", "p_partkey", "p_type", F.col("p_size").cast("long").alias("gain"))
    return search.beam(part, "p_brand", "p_partkey", "p_type", "gain")


@query()
def concept_lattice(spark, table):
    """All closed sets of attributes of the nations' segments, per region."""
    rows = table("customer").join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", "n_name", "c_mktsegment").distinct()
    return search.concepts(rows, "n_regionkey", "n_name", "c_mktsegment")


@query()
def maximal_cliques(spark, table):
    """Maximal cliques of brands that share types at one size (named size/brand), for each size, by component."""
    part = table("part").select("p_size", F.concat_ws("/", F.col("p_size").cast("string"), "p_brand").alias("brand"), "p_type").distinct()
    a, b = part.withColumnRenamed("brand", "a"), part.withColumnRenamed("brand", "b")
    edges = a.join(b, ["p_size", "p_type"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where("n >= 1").select("a", "b")
    return search.cliques(edges, "a", "b", least=2)
