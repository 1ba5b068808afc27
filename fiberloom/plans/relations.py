"""Joins: mirrors, resolution, containment, membership, and differences of two states."""

from __future__ import annotations

from pyspark.sql import functions as F

from fiberloom.functions import names
from fiberloom.operators import matching as m
from fiberloom.plans.registry import query

WORDS = r"[^a-zà-öø-ÿ]+"


def _words(df, row_id):
    return df.select(row_id, F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), WORDS), lambda t: F.length(t) > 5))).alias("token"))


@query("""
WITH d AS (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-zà-öø-ÿ]+')) AS token FROM documents) WHERE length(token) > 5),
b AS (SELECT DISTINCT item_id, token FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^a-zà-öø-ÿ]+')) AS token FROM benchmark) WHERE length(token) > 5),
t AS (SELECT item_id, count(*) AS total FROM b GROUP BY 1)
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, any_value(total)::BIGINT AS total, round(count(*) / any_value(total), 6) AS coverage FROM d JOIN b USING (token) JOIN t USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 8 AND (count(*) >= 40 OR count(*) / any_value(total) >= 0.5)
""")
def mirror_edges(spark, table):
    edges = m.token_edges(_words(table("documents"), "doc_id"), _words(table("benchmark"), "item_id"), "doc_id", "item_id", "token", least=8, sure=40, ratio=0.5)
    return edges.withColumn("coverage", F.round("coverage", 6))


@query("""
WITH l AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 20)
SELECT a.doc_id AS left_id, b.doc_id AS right_id, count(*)::BIGINT AS n_shared FROM l a JOIN l b ON a.line = b.line AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING count(*) >= 2
""")
def near_duplicate_pairs(spark, table):
    lines = table("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") > 20)
    return m.overlap_pairs(lines, "doc_id", "line", least=2)


@query("""
SELECT md5(regexp_replace(regexp_replace(lower(text), '[0-9]', '#', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS fingerprint, count(*)::BIGINT AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) >= 2
""")
def fingerprint_groups(spark, table):
    return table("documents").groupBy(names.fingerprint_text(F.col("text")).alias("fingerprint")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n >= 2")


NORMAL = r"regexp_replace(lower(regexp_replace(regexp_replace({0}, '[\-.: ]+', '_', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '^_+|_+$', '', 'g')"


@query(f"SELECT p_partkey, {NORMAL.format('p_name')} AS normal, list_aggregate(list_sort(list_distinct(list_filter(string_split({NORMAL.format('p_name')}, '_'), lambda t: t <> ''))), 'string_agg', ',') AS tokens FROM part")
def normalize_names(spark, table):
    return table("part").select("p_partkey", names.normalized(F.col("p_name")).alias("normal"), F.array_join(names.tokens(F.col("p_name")), ",").alias("tokens"))


@query(f"""
WITH p AS (SELECT p_partkey, unnest(list_distinct(string_split({NORMAL.format("p_name || ' ' || p_type")}, '_'))) AS t FROM part)
SELECT p_partkey, count(*)::BIGINT AS n_strong FROM p WHERE t NOT IN ('', 'part', 'standard', 'small') GROUP BY 1 HAVING count(*) >= 2
""")
def affinity_filter(spark, table):
    """Parts with at least two tokens of name and type that are not weak words."""
    strong = table("part").select("p_partkey", F.explode(names.tokens(F.concat_ws(" ", "p_name", "p_type"))).alias("t")).where(~F.col("t").isin("part", "standard", "small"))
    return strong.groupBy("p_partkey").agg(F.count("*").alias("n_strong")).where("n_strong >= 2")


@query("""
WITH q AS (SELECT DISTINCT 'NATION_' || (c_custkey % 40)::VARCHAR AS name FROM customer UNION SELECT r_name FROM region),
n AS (SELECT n_name AS name, 'nation:' || n_nationkey::VARCHAR AS target FROM nation), r AS (SELECT r_name AS name, 'region:' || r_regionkey::VARCHAR AS target FROM region)
SELECT q.name, coalesce(n.target, r.target) AS resolved, CASE WHEN n.target IS NOT NULL THEN 'nation' WHEN r.target IS NOT NULL THEN 'region' ELSE 'unresolved' END AS how
FROM q LEFT JOIN n USING (name) LEFT JOIN r USING (name)
""")
def alias_resolution(spark, table):
    asked = table("customer").select(F.concat(F.lit("NATION_"), (F.col("c_custkey") % 40).cast("string")).alias("name")).union(table("region").select("r_name")).distinct()
    nation = table("nation").select(F.col("n_name").alias("name"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("target"))
    region = table("region").select(F.col("r_name").alias("name"), F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("target"))
    return m.first_resolved(asked, "name", [("nation", m.unique_only(nation, "name", "target")), ("region", m.unique_only(region, "name", "target"))])


HOST = "regexp_extract(url, '://([^/?#]*)', 1)"


@query(f"""
WITH h AS (SELECT DISTINCT {HOST} AS host FROM pages), p AS (SELECT host, string_split(host, '.') AS parts FROM h),
s AS (SELECT host, array_to_string(parts[i:], '.') AS suffix FROM p, unnest(range(1, len(parts) + 1)) AS u(i))
SELECT suffix AS name, min(host) AS target FROM s GROUP BY suffix HAVING count(DISTINCT host) = 1
""")
def unique_suffix_join(spark, table):
    hosts = table("pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    return m.unique_suffixes(hosts, "host")


@query("""
SELECT o_orderkey, count(*)::BIGINT AS n_inside FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 60 DAY GROUP BY o_orderkey
""")
def containment_join(spark, table):
    spans = table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("_start"), F.expr("o_orderdate + INTERVAL 60 DAY").alias("_end"))
    inside = m.contained(table("lineitem").select("l_orderkey", "l_shipdate"), spans, ["l_orderkey"], "l_shipdate", "_start", "_end")
    return inside.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_inside"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def qualified_semi(spark, table):
    return table("documents").select("doc_id", "source").join(table("labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '2000-01-01')")
def unreferenced_anti(spark, table):
    urgent = table("orders").where("o_orderpriority = '1-URGENT' and o_orderdate >= timestamp'2000-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return table("customer").select("c_custkey", "c_name").join(urgent, "c_custkey", "left_anti")


BEFORE = "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS price FROM orders WHERE o_orderkey % 7 <> 0"
AFTER = "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, round(o_totalprice, 2) AS price FROM orders WHERE o_orderkey % 5 <> 0"


def _states(table):
    orders = table("orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price"))
    after = orders.where("o_orderkey % 5 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")))
    return orders.where("o_orderkey % 7 <> 0"), after


@query(f"""
WITH b AS ({BEFORE}), a AS ({AFTER}) SELECT o_orderkey, CASE WHEN b.price IS NULL THEN 'new' WHEN a.price IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM b FULL JOIN a USING (o_orderkey) WHERE b.price IS NULL OR a.price IS NULL OR a.o_orderstatus <> b.o_orderstatus OR a.price <> b.price
""")
def snapshot_diff(spark, table):
    return m.differences(*_states(table), "o_orderkey", ["o_orderstatus", "price"])


@query(f"WITH b AS ({BEFORE}), a AS ({AFTER}) SELECT change, count(*)::BIGINT AS n FROM (SELECT CASE WHEN b.price IS NULL THEN 'new' WHEN a.price IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a USING (o_orderkey) WHERE b.price IS NULL OR a.price IS NULL OR a.o_orderstatus <> b.o_orderstatus) GROUP BY 1")
def incremental_changed(spark, table):
    return m.differences(*_states(table), "o_orderkey", ["o_orderstatus", "price"]).groupBy("change").agg(F.count("*").alias("n"))


@query(f"WITH b AS ({BEFORE}), a AS ({AFTER}) SELECT * FROM a UNION ALL SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)")
def overlay_merge(spark, table):
    return m.overlay(*_states(table), "o_orderkey")


@query("""
WITH asked AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT 'Brand#none'), k AS (SELECT p_brand AS name, count(DISTINCT p_type) AS n, min(p_type) AS one FROM part GROUP BY 1)
SELECT name, coalesce(n, 0)::BIGINT AS candidates, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS state, CASE WHEN n = 1 THEN one END AS target FROM asked LEFT JOIN k USING (name)
""")
def claim_resolution(spark, table):
    part = table("part").withColumnRenamed("p_brand", "name")
    asked = part.select("name").union(spark.createDataFrame([("Brand#none",)], "name string"))
    return m.claims(asked, part, "name", "p_type")


@query("""
WITH b AS (SELECT DISTINCT l_suppkey AS id, p_brand AS k FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 50),
s AS (SELECT s_suppkey AS id, s_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey),
e AS (SELECT x.id AS l, y.id AS r, 3 AS w FROM s x JOIN s y ON x.n = y.n AND x.id < y.id UNION ALL SELECT x.id, y.id, 1 FROM s x JOIN s y ON x.r = y.r AND x.id < y.id UNION ALL SELECT x.id, y.id, 1 FROM b x JOIN b y ON x.k = y.k AND x.id < y.id)
SELECT l AS left_id, r AS right_id, sum(w)::BIGINT AS weight FROM e GROUP BY 1, 2 HAVING sum(w) >= 3
""")
def relation_graph(spark, table):
    place = table("supplier").join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    brands = table("lineitem").where("l_quantity >= 50").join(table("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("id"), F.col("p_brand").alias("key"))
    parts = [(place.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("key")), 3), (place.select(F.col("s_suppkey").alias("id"), F.col("n_regionkey").alias("key")), 1), (brands, 1)]
    return m.relation_graph(parts, least=3)


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_ops(spark, table):
    o = table("orders")
    pick = lambda cond: o.where(cond).select("o_custkey")
    return pick("o_orderpriority = '1-URGENT'").intersect(pick("o_orderpriority = '5-LOW'")).subtract(pick("o_orderstatus = 'P'"))


@query("SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1 HAVING bool_or(o_orderdate >= TIMESTAMP '2001-01-01')")
def report_scope(spark, table):
    """Groups of which any member lies in the report's scope, with all their members counted."""
    o = table("orders")
    scope = o.where("o_orderdate >= timestamp'2001-01-01'").select("o_custkey").distinct()
    return o.join(scope, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS price FROM orders WHERE o_orderstatus NOT IN ('P') AND o_totalprice >= 1000 GROUP BY 1")
def excluded_patterns(spark, table):
    kept = table("orders").where(~F.col("o_orderstatus").isin("P") & (F.col("o_totalprice") >= 1000))
    return kept.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"))


@query("SELECT doc_id, substr(md5(concat_ws('|', doc_id::VARCHAR, source, lang)), 1, 10) AS stable_id FROM documents")
def stable_ids(spark, table):
    return table("documents").select("doc_id", names.stable_id(F.col("doc_id").cast("string"), F.col("source"), F.col("lang")).alias("stable_id"))


@query("""
WITH p AS (SELECT page_id, string_split(regexp_extract(url, '://([^?#]*)', 1), '/') AS parts FROM pages)
SELECT page_id, array_to_string(parts[1:i], '/') AS parent FROM p, unnest(range(1, len(parts))) AS u(i)
""")
def path_parents(spark, table):
    return table("pages").select("page_id", F.explode(names.parents(F.regexp_extract("url", "://([^?#]*)", 1))).alias("parent"))


@query("""
WITH g AS (SELECT p_brand, min(p_name) AS lo, max(p_name) AS hi FROM part GROUP BY 1)
SELECT p_brand, (SELECT coalesce(max(i), 0) FROM unnest(range(0, 65)) AS u(i) WHERE i <= least(length(lo), length(hi)) AND lo[1:i] = hi[1:i])::BIGINT AS prefix_length FROM g
""")
def common_prefixes(spark, table):
    g = table("part").groupBy("p_brand").agg(F.min("p_name").alias("lo"), F.max("p_name").alias("hi"))
    return g.select("p_brand", F.length(names.common_prefix(F.col("lo"), F.col("hi"))).cast("long").alias("prefix_length"))
