"""Order: slices, first rows, runs and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from fiberloom.functions.costs import load_score
from fiberloom.operators import matching as m
from fiberloom.operators import ranking as r
from fiberloom.plans.registry import query

LINE = "l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice"


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE})::BIGINT AS n FROM lineitem) WHERE n <= 6")
def evidence_slice(spark, table):
    first = r.first_rows(table("lineitem"), ["l_orderkey"], LINE.split(", "), 6, rank="n")
    return first.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("n").cast("long").alias("n"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM (SELECT *, rank() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1 GROUP BY 1, 2")
def first_location(spark, table):
    """The earliest event of each user and type, found by aggregation alone."""
    return table("events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS k FROM orders) WHERE k = 1")
def preference_tier(spark, table):
    return m.best_tier(table("orders").select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], F.col("o_orderpriority"))


@query("""
WITH x AS (SELECT user_id, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events)
SELECT user_id, event_type, count(*)::BIGINT AS n, arg_min(event_id, (ts, event_id)) AS first_event_id FROM x GROUP BY user_id, event_type, g HAVING count(*) >= 3
""")
def event_runs(spark, table):
    return r.runs(table("events"), ["user_id"], ["ts", "event_id"], "event_type", least=3).drop("first_ts")


KEYS = "SELECT 'priority' AS kind, o_orderpriority AS value, * FROM orders UNION ALL SELECT 'month', strftime(o_orderdate, '%Y-%m'), * FROM orders UNION ALL SELECT 'customer', o_custkey::VARCHAR, * FROM orders"


@query(f"""
SELECT kind, value, count(*)::BIGINT AS n, (100 * count(*) + 25 * count(DISTINCT o_orderstatus) + 10 * count(DISTINCT o_custkey) + least(count(DISTINCT o_orderpriority), 100) + least(count(DISTINCT o_orderkey), 100))::BIGINT AS score
FROM ({KEYS}) GROUP BY kind, value HAVING count(*) >= 2 ORDER BY score DESC, n DESC, kind, value LIMIT 25
""")
def impact_ranking(spark, table):
    """The 25 keys that carry most orders: a report, so its limit is the feature."""
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in (("priority", F.col("o_orderpriority")), ("month", F.date_format("o_orderdate", "yyyy-MM")), ("customer", F.col("o_custkey")))])
    rows = table("orders").select(F.explode(keys).alias("k"), "o_orderstatus", "o_custkey", "o_orderpriority", "o_orderkey").select("k.*", "o_orderstatus", "o_custkey", "o_orderpriority", "o_orderkey")
    d = F.count_distinct
    scored = rows.groupBy("kind", "value").agg(F.count("*").alias("n"), load_score(F.count("*"), d("o_orderstatus"), d("o_custkey"), d("o_orderpriority"), d("o_orderkey")).cast("long").alias("score")).where("n >= 2")
    return r.top(scored, [F.desc("score"), F.desc("n"), F.col("kind"), F.col("value")], 25)


@query("SELECT p_brand, p_type, count(*)::BIGINT AS n FROM part GROUP BY 1, 2 ORDER BY n DESC, p_brand, p_type LIMIT 40")
def pattern_counts_sorted(spark, table):
    return r.top(table("part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")), [F.desc("n"), F.col("p_brand"), F.col("p_type")], 40)


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_generation(spark, table):
    at = F.struct("ts", "event_id")
    return table("events").groupBy("user_id").agg(F.max_by("event_id", at).alias("event_id"), F.max_by("event_type", at).alias("event_type"))


@query("""
SELECT c_custkey, kept_bytes FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k, sum(length(c_name)) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::BIGINT AS kept_bytes FROM customer)
WHERE k <= 20 AND kept_bytes <= 300
""")
def retention(spark, table):
    """What a bounded cache keeps of each nation: the newest (here: richest) 20 within 300 bytes."""
    from pyspark.sql import Window

    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    ranked = table("customer").select("c_custkey", F.row_number().over(w).alias("k"), F.sum(F.length("c_name")).over(w).cast("long").alias("kept_bytes"))
    return ranked.where("k <= 20 and kept_bytes <= 300").select("c_custkey", "kept_bytes")
