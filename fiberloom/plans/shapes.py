"""Grouping queries: fibers, witnesses, cohorts, dependencies, orbits, rollups."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from fiberloom.functions.costs import ceil_log2, certificate
from fiberloom.operators import grouping as g
from fiberloom.plans.registry import query


@query("""
SELECT p_brand, p_type, p_size, count(*)::BIGINT AS n_parts, min(p_partkey) AS first_part
FROM part GROUP BY p_brand, p_type, p_size HAVING count(*) >= 2
""")
def repeated_shape_detector(spark, table):
    part = table("part")
    return part.groupBy("p_brand", "p_type", "p_size").agg(F.count("*").alias("n_parts"), F.min("p_partkey").alias("first_part")).where("n_parts >= 2")


FIBER_SQL = """
SELECT l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m') AS ship_month, count(*)::BIGINT AS n, count(DISTINCT l_suppkey)::BIGINT AS n_suppliers
FROM lineitem GROUP BY ALL
"""


def _line_months(table):
    return table("lineitem").select("l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM").alias("ship_month"), "l_suppkey")


@query(FIBER_SQL)
def fiber_groups(spark, table):
    return g.fibers(_line_months(table), ["l_returnflag", "l_linestatus", "ship_month"], {"n_suppliers": "l_suppkey"})


@query(FIBER_SQL + " HAVING count(*) >= 20")
def fiber_having(spark, table):
    return g.fibers(_line_months(table), ["l_returnflag", "l_linestatus", "ship_month"], {"n_suppliers": "l_suppkey"}, least=20)


@query("""
SELECT o_custkey, count(*)::BIGINT AS n, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS members
FROM orders GROUP BY o_custkey
""")
def witness_groups(spark, table):
    return g.witness_sets(table("orders"), ["o_custkey"], "o_orderpriority")


@query("""
WITH own AS (SELECT DISTINCT p_brand AS w, p_type || '/' || p_size::VARCHAR AS f FROM part),
pairs AS (SELECT a.w AS w1, b.w AS w2, string_agg(a.f, ',' ORDER BY a.f) AS fs, count(*) AS k FROM own a JOIN own b ON a.f = b.f AND a.w < b.w GROUP BY 1, 2 HAVING count(*) >= 2),
sets AS (SELECT DISTINCT fs, k FROM pairs),
wanted AS (SELECT fs, k, unnest(string_split(fs, ',')) AS f FROM sets),
support AS (SELECT fs, k, w FROM wanted JOIN own USING (f) GROUP BY fs, k, w HAVING count(*) = k)
SELECT fs AS fibers, k::BIGINT AS n_fibers, count(*)::BIGINT AS n_witnesses, string_agg(w, ',' ORDER BY w) AS witnesses FROM support GROUP BY fs, k HAVING count(*) >= 2
""")
def coherence_cohorts(spark, table):
    part = table("part").select("p_brand", F.concat_ws("/", "p_type", F.col("p_size").cast("string")).alias("fiber"))
    return g.cohorts(part, "p_brand", "fiber", least_fibers=2)


@query("SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS n_users FROM events GROUP BY event_type")
def finding_counts(spark, table):
    return g.fibers(table("events"), ["event_type"], {"n_users": "user_id"})


@query("""
SELECT l_suppkey, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS price, round(sum(l_discount), 2) AS discount, round(sum(l_tax), 2) AS tax
FROM lineitem GROUP BY l_suppkey
""")
def impact_vector_sum(spark, table):
    parts = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
    return table("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), *[F.round(F.sum(c), 2).alias(name) for name, c in parts.items()])


@query("""
SELECT count(*)::BIGINT AS n, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS n_final, count(*) FILTER (o_orderpriority = '1-URGENT')::BIGINT AS n_urgent,
 round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS final_price, count(DISTINCT o_custkey)::BIGINT AS n_customers,
 count(*) FILTER (greatest(o_totalprice - 100000, 0) > 0)::BIGINT AS n_large FROM orders
""")
def economics_rollup(spark, table):
    final = F.col("o_orderstatus") == "F"
    return table("orders").agg(
        F.count("*").alias("n"), F.count_if(final).alias("n_final"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"),
        F.round(F.sum(F.when(final, F.col("o_totalprice")).otherwise(0.0)), 2).alias("final_price"), F.count_distinct("o_custkey").alias("n_customers"),
        F.count_if(F.greatest(F.col("o_totalprice") - 100000, F.lit(0)) > 0).alias("n_large"))


BUCKETS = ("tiny", "small", "medium", "large", "huge", "none")


@query("""
WITH cats(bucket) AS (VALUES ('tiny'), ('small'), ('medium'), ('large'), ('huge'), ('none')),
sized AS (SELECT CASE WHEN p_size IS NULL THEN 'none' WHEN p_size <= 10 THEN 'tiny' WHEN p_size <= 20 THEN 'small' WHEN p_size <= 30 THEN 'medium' WHEN p_size <= 60 THEN 'large' ELSE 'huge' END AS bucket, p_size FROM part)
SELECT bucket, count(p_size)::BIGINT AS n, coalesce(sum(p_size), 0)::BIGINT AS total FROM cats LEFT JOIN sized USING (bucket) GROUP BY bucket
""")
def change_budget(spark, table):
    size = F.col("p_size")
    bucket = F.when(size.isNull(), "none").when(size <= 10, "tiny").when(size <= 20, "small").when(size <= 30, "medium").when(size <= 60, "large").otherwise("huge")
    sums = table("part").groupBy(bucket.alias("bucket")).agg(F.count("p_size").alias("n"), F.sum("p_size").alias("total"))
    cats = spark.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return cats.join(sums, "bucket", "left").select("bucket", zero("n"), zero("total"))


@query("""
WITH t AS (SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT n_regionkey, count(DISTINCT n_nationkey) a, count(DISTINCT n_name) b, count(DISTINCT r_name) c FROM t GROUP BY 1)
SELECT 'n_nationkey' AS axis, max(a) <= 1 AS determined FROM p UNION ALL SELECT 'n_name', max(b) <= 1 FROM p UNION ALL SELECT 'r_name', max(c) <= 1 FROM p
""")
def fd_closure(spark, table):
    t = table("nation").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return g.determined_axes(t, ["n_regionkey"], ["n_nationkey", "n_name", "r_name"])


@query("""
SELECT a.p_brand, a.p_type, a.p_size AS left_value, a.p_partkey AS left_id, b.p_size AS right_value, b.p_partkey AS right_id
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey AND a.p_size IS DISTINCT FROM b.p_size
""")
def fd_violations(spark, table):
    return g.dependency_violations(table("part"), ["p_brand", "p_type"], "p_size", "p_partkey")


KEY_AXES = ("n_nationkey", "n_name", "n_regionkey", "r_name")


@query("""
WITH t AS (SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM t))
""" + " UNION ALL ".join(f"SELECT '{a}' AS key_columns, 1::BIGINT AS size FROM t, d GROUP BY d.n HAVING count(DISTINCT {a}) = d.n" for a in KEY_AXES) + "".join(
    f" UNION ALL SELECT '{a},{b}', 2::BIGINT FROM t, d GROUP BY d.n HAVING count(DISTINCT ({a}, {b})) = d.n AND count(DISTINCT {a}) < d.n AND count(DISTINCT {b}) < d.n" for a, b in combinations(KEY_AXES, 2)))
def minimal_keys(spark, table):
    t = table("nation").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    keys = g.minimal_keys(t, list(KEY_AXES), most=2)
    return spark.createDataFrame([(",".join(k), len(k)) for k in keys], "key_columns string, size long")


@query("""
WITH s AS (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment)
SELECT count(*)::BIGINT AS n_fibers, max(n)::BIGINT AS max_fiber, sum(n - 1)::BIGINT AS collision_excess, CASE WHEN max(n) <= 1 THEN 0 ELSE length(bin(max(n) - 1)) END::BIGINT AS bits, max(n) <= 1 AS injective FROM s
""")
def fiber_geometry(spark, table):
    return g.geometry(table("customer"), ["c_nationkey", "c_mktsegment"])


@query("""
SELECT GROUPING(p_brand, p_type, p_size)::BIGINT AS level, p_brand, p_type, p_size, count(*)::BIGINT AS n FROM part
GROUP BY GROUPING SETS ((p_brand), (p_type), (p_size), (p_brand, p_type), (p_brand, p_size), (p_type, p_size)) HAVING count(*) >= 2
""")
def orbits_all_subsets(spark, table):
    return g.orbits(table("part"), ["p_brand", "p_type", "p_size"])


@query("""
SELECT p_brand, p_size, count(*)::BIGINT AS n, concat_ws(',', CASE WHEN count(DISTINCT p_name) > 1 THEN 'p_name' END, CASE WHEN count(DISTINCT p_type) > 1 THEN 'p_type' END) AS varying
FROM part GROUP BY p_brand, p_size HAVING count(*) >= 2
""")
def orbit_residue(spark, table):
    return g.orbit_residue(table("part"), ["p_brand", "p_size"], ["p_type", "p_name"])


@query("""
WITH o AS (SELECT p_brand, p_type, count(*) AS n, count(DISTINCT p_size) AS sizes, max(c) AS collisions FROM (SELECT p_brand, p_type, p_size, count(*) OVER (PARTITION BY p_brand, p_type, p_size) AS c FROM part) GROUP BY 1, 2),
c AS (SELECT p_brand, p_type, (n * 3)::BIGINT AS before, (1 + 2 + sizes)::BIGINT AS after, (CASE WHEN collisions <= 1 THEN 0 ELSE length(bin(collisions - 1)) END)::BIGINT AS margin FROM o)
SELECT *, before - after - margin AS savings, before - after - margin > 0 AS pays_rent FROM c
""")
def mdl_certificate(spark, table):
    sized = table("part").groupBy("p_brand", "p_type", "p_size").agg(F.count("*").alias("c"))
    o = sized.groupBy("p_brand", "p_type").agg(F.sum("c").alias("n"), F.count("*").alias("sizes"), F.max("c").alias("collisions"))
    made = certificate(F.col("n") * 3, F.lit(1), F.lit(2), F.col("sizes"), F.col("collisions"), F.lit(1))
    return o.select("p_brand", "p_type", *[(e if name == "pays_rent" else e.cast("long")).alias(name) for name, e in made.items()])


@query("""
WITH x AS (SELECT max(n) AS most_right_per_left FROM (SELECT count(DISTINCT p_type) AS n FROM part GROUP BY p_brand)), y AS (SELECT max(n) AS most_left_per_right FROM (SELECT count(DISTINCT p_brand) AS n FROM part GROUP BY p_type))
SELECT most_right_per_left, most_left_per_right, most_right_per_left <= 1 AND most_left_per_right <= 1 AS one_to_one FROM x, y
""")
def injective_registry(spark, table):
    return g.injectivity(table("part"), "p_brand", "p_type")


@query("""
WITH want(event_type) AS (VALUES ('click'), ('view'), ('purchase'), ('refund'), ('teleport')), have AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, coalesce(n, 0)::BIGINT AS n, CASE WHEN want.event_type IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' ELSE 'covered' END AS state
FROM want FULL JOIN have USING (event_type)
""")
def exhaustive_policy(spark, table):
    want = spark.createDataFrame([(x,) for x in ("click", "view", "purchase", "refund", "teleport")], "event_type string")
    return g.closed_repertoire(table("events"), want, "event_type")


@query("""
WITH e(event_type, lo, hi) AS (VALUES ('click', 10, 100), ('view', 1, NULL), ('purchase', 0, 5), ('teleport', 1, NULL), ('refund', 0, 0)), c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, coalesce(n, 0)::BIGINT AS observed, CASE WHEN coalesce(n, 0) < lo THEN 'too few' WHEN hi IS NOT NULL AND coalesce(n, 0) > hi THEN CASE WHEN hi = 0 THEN 'forbidden' ELSE 'too many' END ELSE 'ok' END AS reason
FROM e LEFT JOIN c USING (event_type)
""")
def calibration_gate(spark, table):
    rows = [("click", 10, 100), ("view", 1, None), ("purchase", 0, 5), ("teleport", 1, None), ("refund", 0, 0)]
    wanted = spark.createDataFrame(rows, "event_type string, lo long, hi long")
    n = F.coalesce("n", F.lit(0)).cast("long")
    reason = F.when(n < F.col("lo"), "too few").when(F.col("hi").isNotNull() & (n > F.col("hi")), F.when(F.col("hi") == 0, "forbidden").otherwise("too many")).otherwise("ok")
    return wanted.join(g.fibers(table("events"), ["event_type"]), "event_type", "left").select("event_type", n.alias("observed"), reason.alias("reason"))


@query("""
SELECT n, CASE WHEN n <= 1 THEN 0 ELSE length(bin(n - 1)) END::BIGINT AS bits FROM (SELECT DISTINCT p_size::BIGINT AS n FROM part)
""")
def ceil_log2_sizes(spark, table):
    return table("part").select(F.col("p_size").cast("long").alias("n")).distinct().withColumn("bits", ceil_log2(F.col("n")).cast("long"))


@query("""
SELECT DISTINCT a.p_partkey AS left_id, b.p_partkey AS right_id FROM part a JOIN part b ON a.p_partkey < b.p_partkey
 AND ((a.p_brand = b.p_brand AND a.p_type = b.p_type) OR (a.p_size = b.p_size AND a.p_type = b.p_type))
""")
def confusable_rows(spark, table):
    return g.confusable_pairs(table("part"), "p_partkey", [["p_brand", "p_type"], ["p_size", "p_type"]])


@query("""
WITH views AS (SELECT DISTINCT a.c_custkey AS l, b.c_custkey AS r FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey AND a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment),
deg AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT (SELECT count(*) FROM views)::BIGINT AS edges, sum(n * (n - 1) / 2)::BIGINT AS clique_edges, (SELECT count(*) FROM views) = sum(n * (n - 1) / 2) AS transitive FROM deg
""")
def transitive_confusability(spark, table):
    """Pairs that look alike, and those of the cliques they would have to fill; both are counted without making a pair."""
    edges = g.confusable_count(table("customer"), [["c_nationkey", "c_mktsegment"]])
    full = g.fibers(table("customer"), ["c_nationkey", "c_mktsegment"]).agg(F.sum(F.expr("n * (n - 1) div 2")).alias("clique_edges"))
    both = edges.select("edges", F.lit(None).cast("long").alias("clique_edges")).unionByName(full.select(F.lit(None).cast("long").alias("edges"), "clique_edges"))
    return both.agg(F.max("edges").alias("edges"), F.max("clique_edges").alias("clique_edges")).withColumn("transitive", F.col("edges") == F.col("clique_edges"))


ROLES = ("p_brand", "p_type", "p_size", "p_name")


def _itemset_sql() -> str:
    parts = []
    for c in combinations(ROLES, 2):
        key = " || '|' || ".join(f"'{a}=' || {a}::VARCHAR" for a in c)
        parts.append(f"SELECT {key} AS roles, p_partkey FROM part")
    return f"SELECT roles, count(*)::BIGINT AS n, min(p_partkey) AS first_part FROM ({' UNION ALL '.join(parts)}) GROUP BY roles HAVING count(*) >= 3"


@query(_itemset_sql())
def role_itemsets(spark, table):
    """Every pair of roles that at least three records have in common."""
    sets = F.array(*[F.concat_ws("|", *[F.concat(F.lit(f"{a}="), F.col(a).cast("string")) for a in c]) for c in combinations(ROLES, 2)])
    return table("part").select(F.explode(sets).alias("roles"), "p_partkey").groupBy("roles").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part")).where("n >= 3")
