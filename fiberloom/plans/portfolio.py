"""Plans and reports over findings-like rows: gates, scores, partitions, covers and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fiberloom.functions.costs import certificate
from fiberloom.operators import graph, grouping, search
from fiberloom.plans.registry import query


@query("""
WITH o AS (SELECT GROUPING(p_brand, p_type, p_size)::BIGINT AS level, p_brand, p_type, p_size, count(*)::BIGINT AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), (p_size), (p_brand, p_type), (p_brand, p_size), (p_type, p_size)) HAVING count(*) >= 2),
c AS (SELECT *, CASE level WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 4 THEN 2 ELSE 1 END::BIGINT AS axes FROM o),
s AS (SELECT *, (n - 1 - axes - 4)::BIGINT AS savings FROM c)
SELECT level, p_brand, p_type, p_size, n, savings, savings > 0 AS accepted, row_number() OVER (PARTITION BY level ORDER BY savings DESC, p_brand NULLS LAST, p_type NULLS LAST, p_size NULLS LAST)::BIGINT AS place FROM s
""")
def factorization_plans(spark, table):
    """Orbits with what factoring them out saves, accepted or not, in order of savings."""
    o = grouping.orbits(table("part"), ["p_brand", "p_type", "p_size"]).withColumn("level", F.col("level").cast("long"))
    axes = F.when(F.col("level").isin(1, 2, 4), 2).otherwise(1).cast("long")
    made = certificate(F.col("n"), F.lit(1).cast("long"), axes, F.lit(4).cast("long"), F.lit(1), F.lit(1))
    s = o.withColumn("savings", made["savings"].cast("long")).withColumn("accepted", made["pays_rent"])
    order = [F.desc("savings"), *[F.col(c).asc_nulls_last() for c in ("p_brand", "p_type", "p_size")]]
    return s.withColumn("place", F.row_number().over(Window.partitionBy("level").orderBy(*order)).cast("long")).select("level", "p_brand", "p_type", "p_size", "n", "savings", "accepted", "place")


@query("""
WITH w AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS kinds, round(sum(o_totalprice), 2) AS price FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT CASE WHEN kinds >= 3 THEN 'authority' ELSE 'cleanup' END AS lane, o_custkey, n::BIGINT AS n, price, row_number() OVER (PARTITION BY kinds >= 3 ORDER BY n DESC, price DESC, o_custkey)::BIGINT AS place FROM w
""")
def authority_gate(spark, table):
    """Work items split into those under one authority (three kinds or more) and the rest, ranked in each lane."""
    w = table("orders").where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("o_orderpriority").alias("kinds"), F.round(F.sum("o_totalprice"), 2).alias("price"))
    lane = F.when(F.col("kinds") >= 3, "authority").otherwise("cleanup")
    place = F.row_number().over(Window.partitionBy("lane").orderBy(F.desc("n"), F.desc("price"), "o_custkey"))
    return w.withColumn("lane", lane).select("lane", "o_custkey", "n", "price", place.cast("long").alias("place"))


@query("""
SELECT l_orderkey, sum(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 1 ELSE 0 END)::BIGINT AS loci, sum(CASE l_returnflag WHEN 'N' THEN 2 ELSE 0 END)::BIGINT AS sites, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE -1 END)::BIGINT AS balance
FROM lineitem GROUP BY 1 HAVING greatest(sum(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 1 ELSE 0 END), sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE -1 END)) > 0
""")
def impact_deltas(spark, table):
    """Each kind of metric mapped to its vector, summed; only groups with some positive part stay."""
    flag = F.col("l_returnflag")
    total = lambda e, name: F.sum(e).alias(name)
    out = table("lineitem").groupBy("l_orderkey").agg(total(F.when(flag == "R", 3).when(flag == "A", 1).otherwise(0), "loci"), total(F.when(flag == "N", 2).otherwise(0), "sites"), total(F.when(F.col("l_linestatus") == "F", 1).otherwise(-1), "balance"))
    return out.where(F.greatest("loci", "balance") > 0)


@query("SELECT p_partkey, p_name FROM part WHERE p_type LIKE 'S%' AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND p_size BETWEEN 5 AND 20 AND NOT p_name LIKE '%9'")
def selector_query(spark, table):
    p = table("part")
    return p.where(F.col("p_type").like("S%") & F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3") & F.col("p_size").between(5, 20) & ~F.col("p_name").like("%9")).select("p_partkey", "p_name")


@query("""
WITH e AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey)::BIGINT AS ordinal, count(*) OVER (PARTITION BY l_partkey)::BIGINT AS degree FROM e
""")
def incidence(spark, table):
    """The hypergraph of suppliers and parts: each pair once, with its ordinal and the degree of the part."""
    e = table("lineitem").select("l_suppkey", "l_partkey").distinct()
    degree = e.groupBy("l_partkey").agg(F.count("*").alias("degree"))
    return e.join(degree, "l_partkey").select("l_suppkey", "l_partkey", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_partkey")).cast("long").alias("ordinal"), "degree")


@query("SELECT md5(concat_ws('|', o_orderstatus, o_orderpriority)) AS evidence_id, count(*)::BIGINT AS n, min(o_orderkey) AS first_order, string_agg(DISTINCT (o_custkey % 10)::VARCHAR, ',' ORDER BY (o_custkey % 10)::VARCHAR) AS findings FROM orders GROUP BY 1")
def evidence_ordinals(spark, table):
    """Evidence told apart by its id alone, with where it was seen first and by which findings."""
    e = F.md5(F.concat_ws("|", "o_orderstatus", "o_orderpriority"))
    return table("orders").groupBy(e.alias("evidence_id")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"), F.array_join(F.array_sort(F.collect_set((F.col("o_custkey") % 10).cast("string"))), ",").alias("findings"))


@query("SELECT event_type, ts::DATE AS day, count(*)::BIGINT AS n FROM events WHERE event_id IN (SELECT min(event_id) FROM events GROUP BY user_id, event_type) GROUP BY ALL")
def first_seen_daily(spark, table):
    e = table("events")
    first = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id")).select("event_id")
    return e.join(first, "event_id", "left_semi").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY c_custkey")
def union_dedup(spark, table):
    c = table("customer")
    return c.where("c_acctbal < 0").select("c_custkey").unionByName(c.where("c_mktsegment = 'BUILDING'").select("c_custkey")).dropDuplicates()


@query("SELECT o_orderpriority, o_orderstatus FROM orders EXCEPT ALL SELECT o_orderpriority, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0")
def bag_difference(spark, table):
    o = table("orders")
    pick = lambda df: df.select("o_orderpriority", "o_orderstatus")
    return pick(o).exceptAll(pick(o.where("o_orderkey % 2 = 0")))


@query("""
WITH RECURSIVE e AS (SELECT s_suppkey AS src, s_suppkey * 2 AS dst FROM supplier WHERE s_suppkey > 0 UNION SELECT s_suppkey, s_suppkey * 3 FROM supplier WHERE s_suppkey > 0),
x AS (SELECT src, dst FROM e WHERE dst <= (SELECT max(s_suppkey) FROM supplier)),
w AS (SELECT src AS root, dst AS target FROM x WHERE src = 1 UNION ALL SELECT w.root, x.dst FROM w JOIN x ON x.src = w.target)
SELECT target, count(*)::BIGINT AS n_paths FROM w GROUP BY target HAVING count(*) >= 2
""")
def path_diagrams(spark, table):
    """Targets that are reached from the root in two ways or more (edges from n to 2n and 3n)."""
    s = table("supplier").where("s_suppkey > 0").select(F.col("s_suppkey").alias("src"))
    most = table("supplier").agg(F.max("s_suppkey")).first()[0] or 0
    edges = s.select("src", (F.col("src") * 2).alias("dst")).union(s.select("src", F.col("src") * 3)).where(F.col("dst") <= most)
    return graph.path_counts(edges, "src", "dst", 1).where("target <> 1 and n_paths >= 2")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) AND n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name <> 'ASIA')")
def ownership_roots(spark, table):
    """Nations that own no large supplier, in regions that count."""
    owners = table("supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    counted = table("region").where("r_name <> 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"))
    return table("nation").join(owners, "n_nationkey", "left_anti").join(counted, "n_regionkey", "left_semi").select("n_nationkey", "n_name")


@query("SELECT detector, modules_now, round(seconds * modules_now / modules, 6) AS predicted FROM (SELECT event_type AS detector, sum(value) AS seconds, count(DISTINCT user_id) AS modules, 500 AS modules_now FROM events GROUP BY 1)")
def scan_prediction(spark, table):
    """Time of the last scan scaled to another number of modules."""
    last = table("events").groupBy(F.col("event_type").alias("detector")).agg(F.sum("value").alias("seconds"), F.count_distinct("user_id").alias("modules"))
    return last.select("detector", F.lit(500).alias("modules_now"), F.round(F.col("seconds") * 500 / F.col("modules"), 6).alias("predicted"))


@query('SELECT p_brand AS "group", p_partkey AS row_id, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) - 1 AS batch FROM part')
def execution_groups(spark, table):
    """Parts of each brand in groups that use no type twice: each goes to the first group that has room for it."""
    return search.first_fit(table("part").select("p_brand", "p_partkey", "p_type"), "p_brand", "p_partkey", "p_type")


@query()
def pattern_cover(spark, table):
    """The fewest brands whose parts have all sizes of a type, with the brands in order of their first part."""
    part = table("part").select("p_type", "p_brand", F.col("p_size").cast("string").alias("size")).distinct()
    return search.minimum_cover(part, "p_type", "p_brand", "size")
