"""Policies, orders, demand and plans over rows that stand for findings, authorities and projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fiberloom.functions import names, vocabulary
from fiberloom.operators import control, graph
from fiberloom.operators import matching as m
from fiberloom.plans.registry import query
from fiberloom.plans.relations import _words
from fiberloom.scratch import number_rows, settle


def listed(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


VALUES = ", ".join(f"({i}, '{p}')" for i, p in enumerate(vocabulary.PATTERNS, 1))


@query(f"""
WITH d(pattern_id, title) AS (VALUES {VALUES})
SELECT pattern_id::BIGINT AS pattern_id, title, count(p_partkey)::BIGINT AS n, coalesce(sum(p_size), 0)::BIGINT AS loci FROM d LEFT JOIN part ON p_size = pattern_id GROUP BY ALL
""")
def pattern_dimension(spark, table):
    """The dimension of patterns (21 rows, broadcast) with what falls under each."""
    d = spark.createDataFrame(list(enumerate(vocabulary.PATTERNS, 1)), "pattern_id long, title string")
    per = table("part").groupBy(F.col("p_size").cast("long").alias("pattern_id")).agg(F.count("*").alias("n"), F.sum("p_size").alias("loci"))
    return per.join(F.broadcast(d), "pattern_id", "right").select("pattern_id", "title", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("loci", F.lit(0)).alias("loci"))


@query(f"""
WITH d(pattern_id, title) AS (VALUES {VALUES}), f AS (SELECT p_brand, p_type, count(*) AS n, min(p_size) AS s FROM part GROUP BY 1, 2)
SELECT p_brand || '/' || p_type AS finding, title, printf('%s has %d parts of %s; factor them out.', p_brand, n, p_type) AS summary, n::BIGINT AS n FROM f JOIN d ON pattern_id = (s - 1) % 21 + 1
""")
def finding_template(spark, table):
    """Findings given their pattern's constants and a sentence from a template."""
    d = spark.createDataFrame(list(enumerate(vocabulary.PATTERNS, 1)), "pattern_id long, title string")
    f = table("part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.min("p_size").alias("s")).withColumn("pattern_id", ((F.col("s") - 1) % 21 + 1).cast("long"))
    said = F.format_string("%s has %d parts of %s; factor them out.", "p_brand", "n", "p_type")
    return f.join(F.broadcast(d), "pattern_id").select(F.concat_ws("/", "p_brand", "p_type").alias("finding"), "title", said.alias("summary"), "n")


@query("""
WITH e AS (SELECT 'nation' AS kind, n_nationkey AS node, n_regionkey AS up FROM nation UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier UNION ALL SELECT 'customer', c_custkey, c_nationkey FROM customer)
SELECT kind, count(DISTINCT node)::BIGINT AS nodes, count(*)::BIGINT AS edges, count(DISTINCT up)::BIGINT AS owners, max(k)::BIGINT AS most FROM (SELECT *, count(*) OVER (PARTITION BY kind, up) AS k FROM e) GROUP BY kind
""")
def graph_summary(spark, table):
    """Nodes, edges, owners and the largest degree of each kind."""
    kinds = (("nation", "n_nationkey", "n_regionkey"), ("supplier", "s_suppkey", "s_nationkey"), ("customer", "c_custkey", "c_nationkey"))
    parts = [table(t).select(F.lit(t).alias("kind"), F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("up")) for t, a, b in kinds]
    per = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind", "up").agg(F.count("*").alias("k"), F.count_distinct("node").alias("d"))
    return per.groupBy("kind").agg(F.sum("d").alias("nodes"), F.sum("k").alias("edges"), F.count("*").alias("owners"), F.max("k").alias("most"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_type LIKE 'S%' THEN 0 WHEN p_type LIKE 'E%' THEN 1 ELSE 2 END, p_brand, p_type, p_partkey)::BIGINT AS place FROM part")
def detector_priority_order(spark, table):
    """All findings in order of priority, pattern, title and id, numbered over ranges."""
    tier = F.when(F.col("p_type").startswith("S"), 0).when(F.col("p_type").startswith("E"), 1).otherwise(2)
    rows = table("part").select("p_partkey", tier.alias("tier"), "p_brand", "p_type")
    return number_rows(rows, ["tier", "p_brand", "p_type", "p_partkey"], "_nth", "priority").select("p_partkey", (F.col("_nth") + 1).alias("place"))


@query("""
WITH e AS (SELECT s_nationkey AS authority, l_partkey AS projection, count(*) AS facts FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT authority, projection, facts::BIGINT AS facts, row_number() OVER (ORDER BY facts DESC, authority, projection)::BIGINT AS place FROM e
""")
def mirror_edge_order(spark, table):
    """Edges with most facts first, then by authority and projection."""
    e = table("lineitem").join(table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("authority"), F.col("l_partkey").alias("projection")).agg(F.count("*").alias("facts")).where("facts >= 2")
    ordered = number_rows(e.withColumn("_less", -F.col("facts")), ["_less", "authority", "projection"], "_nth", "edges")
    return ordered.select("authority", "projection", "facts", (F.col("_nth") + 1).alias("place"))


BEAM = 50


@query(f"""
WITH t AS (SELECT o_custkey, sum(CASE WHEN o_orderstatus <> 'O' THEN o_totalprice ELSE 0 END) AS before, sum(o_totalprice) AS after FROM orders GROUP BY 1),
b AS (SELECT o_custkey FROM t ORDER BY round(before, 2) DESC, o_custkey LIMIT {BEAM}), a AS (SELECT o_custkey FROM t ORDER BY round(after, 2) DESC, o_custkey LIMIT {BEAM}),
pick AS (SELECT c_nationkey AS n FROM a JOIN customer ON c_custkey = o_custkey JOIN t USING (o_custkey) ORDER BY round(after, 2) DESC, o_custkey LIMIT 1)
SELECT 'exposed' AS change, o_custkey FROM (SELECT o_custkey FROM a EXCEPT SELECT o_custkey FROM b) UNION ALL
SELECT 'blocked', o_custkey FROM a JOIN customer ON c_custkey = o_custkey, pick WHERE c_nationkey = n
""")
def beam_changes(spark, table):
    """Keys that come among the first {BEAM} (the beam is the feature), and keys there that share the pick's nation."""
    t = table("orders").groupBy("o_custkey").agg(F.round(F.sum(F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")).otherwise(0)), 2).alias("before"), F.round(F.sum("o_totalprice"), 2).alias("after"))
    top = lambda c: t.orderBy(F.desc(c), "o_custkey").limit(BEAM)
    after = settle(top("after").join(table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey"), "beam")
    exposed = after.select("o_custkey").exceptAll(top("before").select("o_custkey"))
    pick = after.orderBy(F.desc("after"), "o_custkey").limit(1).select("c_nationkey")
    blocked = after.join(F.broadcast(pick), "c_nationkey", "left_semi")
    return exposed.select(F.lit("exposed").alias("change"), "o_custkey").unionByName(blocked.select(F.lit("blocked").alias("change"), "o_custkey"))


@query(f"""
WITH w AS (SELECT p_partkey, unnest(list_distinct(string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '))) AS token FROM part UNION ALL SELECT p_partkey, unnest(['kinds', 'value', 'format', 'keys']) FROM part WHERE p_size % 2 = 0)
SELECT token, token IN ({listed(vocabulary.with_plurals(vocabulary.WEAK_WORDS))}) AS weak, token IN ({listed(vocabulary.with_plurals(vocabulary.ROLE_WORDS))}) AS role, count(*)::BIGINT AS n FROM w WHERE token <> '' GROUP BY ALL
""")
def token_roles(spark, table):
    """Words of names, weak ones and those of roles marked, plurals included."""
    part = table("part")
    words = part.select(F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", " "), " "))).alias("token"))
    more = part.where("p_size % 2 = 0").select(F.explode(F.array(*map(F.lit, ("kinds", "value", "format", "keys")))).alias("token"))
    weak, role = (F.col("token").isin(*vocabulary.with_plurals(w)) for w in (vocabulary.WEAK_WORDS, vocabulary.ROLE_WORDS))
    return words.unionByName(more).where("token <> ''").groupBy("token").agg(F.count("*").alias("n")).select("token", weak.alias("weak"), role.alias("role"), "n")


@query("""
WITH k AS (SELECT o_custkey, string_agg(x, ';' ORDER BY x) AS structure FROM (SELECT DISTINCT o_custkey, o_orderpriority || ':' || o_orderstatus AS x FROM orders) GROUP BY 1)
SELECT md5(structure) AS structural_key, count(*)::BIGINT AS n, min(o_custkey) AS first_key FROM k GROUP BY 1
""")
def structural_key(spark, table):
    """Customers by a canonical key of the nested set of their orders' priorities and states."""
    pairs = F.array_sort(F.collect_set(F.concat_ws(":", "o_orderpriority", "o_orderstatus")))
    k = table("orders").groupBy("o_custkey").agg(F.array_join(pairs, ";").alias("structure"))
    return k.groupBy(F.md5("structure").alias("structural_key")).agg(F.count("*").alias("n"), F.min("o_custkey").alias("first_key"))


LABELS = {"click": "Clicked", "view": "Viewed", "purchase": "Bought"}


@query("SELECT CASE event_type WHEN 'click' THEN 'Clicked' WHEN 'view' THEN 'Viewed' WHEN 'purchase' THEN 'Bought' ELSE event_type END AS label, count(*)::BIGINT AS n FROM events GROUP BY 1")
def enum_labels(spark, table):
    """Values shown by their labels; a value without one stands for itself."""
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return table("events").groupBy(F.coalesce(F.try_element_at(label, F.col("event_type")), F.col("event_type")).alias("label")).agg(F.count("*").alias("n"))


@query("""
SELECT doc_id, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS token FROM documents) WHERE token IN ('license', 'copyright') GROUP BY 1
""")
def signal_prefilter(spark, table):
    """Documents with a word, split into words only if the raw text holds it at all."""
    has = F.lower("text")
    some = table("documents").where(has.contains("license") | has.contains("copyright"))
    return some.select("doc_id", F.explode(F.split(has, "[^a-z]+")).alias("token")).where("token in ('license', 'copyright')").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT l_partkey, count(*)::BIGINT AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 50 AND p_type LIKE 'E%') GROUP BY 1")
def presence_demand(spark, table):
    """Context rows of what a report target asks for."""
    return control.demanded(table("lineitem").withColumnRenamed("l_partkey", "p_partkey"), table("part").where("p_size = 50 and p_type like 'E%'"), "p_partkey").groupBy(F.col("p_partkey").alias("l_partkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("""
WITH RECURSIVE d AS (SELECT s_suppkey AS node, s_suppkey AS up FROM supplier WHERE s_acctbal > 9000 UNION SELECT node, up // 2 FROM d WHERE up > 1)
SELECT up AS ancestor, count(*)::BIGINT AS n FROM d GROUP BY 1
""")
def focused_demand(spark, table):
    """How many demanded nodes descend from each (n descends from n // 2): edges are made for those alone."""
    seeds = table("supplier").where("s_acctbal > 9000").select("s_suppkey")
    halves = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.greatest("s_suppkey", F.lit(1)))).cast("int")), lambda i: F.floor(F.col("s_suppkey") / F.pow(F.lit(2), i)).cast("long"))
    return seeds.where("s_suppkey > 0").select(F.explode(halves).alias("ancestor")).groupBy("ancestor").agg(F.count("*").alias("n"))


@query("""
WITH m AS (SELECT DISTINCT user_id AS module, user_id % 7 AS context FROM events), ch AS (SELECT DISTINCT user_id AS module FROM events WHERE event_type = 'purchase' AND value > 95),
q(query, granularity) AS (VALUES ('shape', 'module'), ('lineage', 'context'), ('portfolio', 'global')),
s AS (SELECT 'module' AS granularity, module FROM m WHERE module IN (SELECT module FROM ch) UNION ALL SELECT 'context', module FROM m WHERE context IN (SELECT context FROM m WHERE module IN (SELECT module FROM ch)) UNION ALL SELECT 'global', module FROM m WHERE EXISTS (SELECT 1 FROM ch))
SELECT query, module FROM q JOIN s USING (granularity)
""")
def cache_granularity(spark, table):
    """What each query makes again after some modules changed, by its granularity."""
    e = table("events")
    modules = settle(e.select(F.col("user_id").alias("module"), (F.col("user_id") % 7).alias("context")).distinct(), "modules")
    changed = settle(e.where("event_type = 'purchase' and value > 95").select(F.col("user_id").alias("module")).distinct(), "changed")
    queries = spark.createDataFrame([("shape", "module"), ("lineage", "context"), ("portfolio", "global")], "query string, granularity string")
    return control.to_recompute(modules, changed, queries)


@query("""
SELECT event_id, coalesce(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT), CASE WHEN value > 50 THEN floor(value)::BIGINT END, -1) AS chosen,
 CASE WHEN regexp_matches(props, '[0-9]') THEN 'props' WHEN value > 50 THEN 'value' ELSE 'none' END AS provider FROM events
""")
def maybe_pipeline(spark, table):
    """The first provider that has a value: a number in the text, else a large value, else none."""
    parsed = F.nullif(F.regexp_extract(F.coalesce("props", F.lit("")), "([0-9]+)", 1), F.lit("")).try_cast("long")
    large = F.when(F.col("value") > 50, F.floor("value").cast("long"))
    said = F.when(F.col("props").rlike("[0-9]"), "props").when(F.col("value") > 50, "value").otherwise("none")
    return table("events").select("event_id", control.first_of(parsed, large, F.lit(-1).cast("long")).alias("chosen"), said.alias("provider"))


@query("""
WITH c AS (SELECT a.conv_id, a.turn FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 JOIN conversations d ON d.conv_id = a.conv_id AND d.turn = a.turn + 2
 WHERE a.role = 'user' AND b.role = 'assistant' AND d.role = 'user' AND length(b.text) > length(a.text))
SELECT conv_id, min(turn) AS first_turn, count(*)::BIGINT AS matches FROM c GROUP BY 1
""")
def pattern_grammar(spark, table):
    """Conversations with a user's turn, a longer answer and another turn of the user in a row: where first, and how often.

    Neighbours are met by a window over each conversation, in place of joins of the table with itself.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    near = lambda c, n: F.lead(c, n).over(w)
    t = table("conversations").select("conv_id", "turn", "role", F.length("text").alias("size"))
    rows = t.select("conv_id", "turn", "role", "size", near("turn", 1).alias("t1"), near("role", 1).alias("r1"), near("size", 1).alias("s1"), near("turn", 2).alias("t2"), near("role", 2).alias("r2"))
    met = rows.where("role = 'user' and r1 = 'assistant' and r2 = 'user' and t1 = turn + 1 and t2 = turn + 2 and s1 > size")
    return met.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.count("*").alias("matches"))


@query("""
SELECT o_orderpriority AS kind, count(*)::BIGINT AS n, count(*) FILTER (CASE o_orderpriority WHEN '1-URGENT' THEN true WHEN '2-HIGH' THEN o_orderstatus <> 'P' WHEN '3-MEDIUM' THEN o_totalprice > 1000 AND c_acctbal > 0 ELSE c_mktsegment = 'BUILDING' END)::BIGINT AS admitted
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1
""")
def admissibility(spark, table):
    """Matches admitted by the policy of their kind."""
    rows = table("orders").join(table("customer"), F.col("c_custkey") == F.col("o_custkey"))
    kind = F.col("o_orderpriority")
    admits = F.when(kind == "1-URGENT", F.lit(True)).when(kind == "2-HIGH", F.col("o_orderstatus") != "P").when(kind == "3-MEDIUM", (F.col("o_totalprice") > 1000) & (F.col("c_acctbal") > 0)).otherwise(F.col("c_mktsegment") == "BUILDING")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(admits).alias("admitted"))


@query(f"""
WITH l AS (SELECT p_partkey, p_name || CASE p_size % 5 WHEN 0 THEN '-stopWords' WHEN 1 THEN ' weak' ELSE '' END AS label FROM part)
SELECT p_partkey FROM l WHERE NOT list_has_any(string_split(regexp_replace(lower(regexp_replace(regexp_replace(label, '[\\-.: ]+', '_', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '^_+|_+$', '', 'g'), '_'), [{listed(vocabulary.SUPPRESSING_WORDS)}])
""")
def suppression(spark, table):
    """Projections whose label holds no word of suppression."""
    ending = F.when(F.col("p_size") % 5 == 0, "-stopWords").when(F.col("p_size") % 5 == 1, " weak").otherwise("")
    words = names.tokens(F.concat("p_name", ending))
    return table("part").where(~F.arrays_overlap(words, F.array(*map(F.lit, vocabulary.SUPPRESSING_WORDS)))).select("p_partkey")


@query("""
WITH d AS (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-zà-öø-ÿ]+')) AS token FROM documents) WHERE length(token) > 5),
b AS (SELECT DISTINCT item_id, token FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^a-zà-öø-ÿ]+')) AS token FROM benchmark) WHERE length(token) > 5),
t AS (SELECT item_id, count(*) AS total FROM b GROUP BY 1), e AS (SELECT doc_id, item_id, count(*) AS n, any_value(total) AS total FROM d JOIN b USING (token) JOIN t USING (item_id) GROUP BY 1, 2 HAVING count(*) >= 8 AND (count(*) >= 40 OR count(*) / any_value(total) >= 0.5))
SELECT item_id, doc_id, n::BIGINT AS n_shared FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS k FROM e) WHERE k = 1
""")
def best_match(spark, table):
    """The document that shares most words with each passage, among those that pass the gate."""
    edges = m.token_edges(_words(table("documents"), "doc_id"), _words(table("benchmark"), "item_id"), "doc_id", "item_id", "token", least=8, sure=40, ratio=0.5)
    best = edges.groupBy("item_id").agg(F.max_by(F.struct("doc_id", "n_shared"), F.struct("n_shared", -F.col("doc_id"))).alias("b"))
    return best.select("item_id", "b.doc_id", "b.n_shared")


AXES = ("p_brand", "p_type", "p_size")


@query(" UNION ALL ".join(f"SELECT '{a}' AS axis, max(n) > 1 AS independent FROM (SELECT count(DISTINCT {a}) AS n FROM part GROUP BY {', '.join(b for b in AXES if b != a)})" for a in AXES))
def independence(spark, table):
    """Whether an axis is left open by the others together; axes are orthogonal if all are."""
    parts = [table("part").groupBy(*[b for b in AXES if b != a]).agg(F.count_distinct(a).alias("n")).agg((F.coalesce(F.max("n"), F.lit(0)) > 1).alias("independent")).select(F.lit(a).alias("axis"), "independent") for a in AXES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
WITH RECURSIVE l AS (SELECT DISTINCT doc_id, source, line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 20),
s AS (SELECT line, min(doc_id) AS hub FROM l GROUP BY line HAVING count(*) > 1), e AS (SELECT DISTINCT doc_id AS a, hub AS b FROM l JOIN s USING (line) WHERE doc_id <> hub), n AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
walk AS (SELECT DISTINCT a AS node, a AS label FROM n UNION SELECT n.b, w.label FROM walk w JOIN n ON n.a = w.node AND w.label < n.b), c AS (SELECT node, min(label) AS component FROM walk GROUP BY node)
SELECT component, source, lang, count(*)::BIGINT AS n, min(node) AS first_doc FROM c JOIN documents ON doc_id = node GROUP BY ALL
""")
def execution_partition(spark, table):
    """Components of documents, split by source and language: what one worker takes."""
    lines = table("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") > 20).distinct()
    hubs = lines.groupBy("line").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    parts = graph.connected_components(lines.join(hubs, "line").where("doc_id <> hub"), "doc_id", "hub")
    placed = parts.withColumnRenamed("node", "doc_id").join(table("documents").select("doc_id", "source", "lang"), "doc_id")
    return placed.groupBy("component", "source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("""
WITH RECURSIVE e AS (SELECT s_suppkey AS src, s_suppkey * 2 AS dst FROM supplier WHERE s_suppkey > 0 UNION SELECT s_suppkey, s_suppkey * 3 FROM supplier WHERE s_suppkey > 0),
x AS (SELECT src, dst FROM e WHERE dst IN (SELECT s_suppkey FROM supplier)), w AS (SELECT s_suppkey AS node, 0 AS batch FROM supplier WHERE s_suppkey > 0 AND s_suppkey NOT IN (SELECT dst FROM x) UNION SELECT x.dst, w.batch + 1 FROM w JOIN x ON x.src = w.node)
SELECT node AS s_suppkey, max(batch)::BIGINT AS batch FROM w GROUP BY 1
""")
def execution_queue(spark, table):
    """Plans in batches: each in the first one after all it waits for (n waits for n / 2 and n / 3)."""
    own = table("supplier").where("s_suppkey > 0").select("s_suppkey")
    waits = own.select(F.col("s_suppkey").alias("node"), F.explode(F.array((F.col("s_suppkey") / 2), (F.col("s_suppkey") / 3))).alias("on")).where("on = floor(on)").select("node", F.col("on").cast("long").alias("on"))
    waits = settle(waits.join(own.select(F.col("s_suppkey").alias("on")), "on", "left_semi"), "waits")

    def later(now):
        need = waits.join(now.select(F.col("s_suppkey").alias("on"), "batch"), "on").groupBy("node").agg((F.max("batch") + 1).alias("_b"))
        return now.join(need.withColumnRenamed("node", "s_suppkey"), "s_suppkey", "left").select("s_suppkey", F.coalesce("_b", F.lit(0).cast("long")).alias("batch"))

    return control.fixpoint(own.withColumn("batch", F.lit(0).cast("long")), later, "s_suppkey")


@query("""
WITH RECURSIVE w AS (SELECT s_suppkey, s_suppkey AS v FROM supplier WHERE s_suppkey > 0 UNION ALL SELECT s_suppkey, v // 2 FROM w WHERE v % 2 = 0)
SELECT s_suppkey, min(v) AS normal FROM w GROUP BY 1
""")
def rewrite_fixpoint(spark, table):
    """Rewriting until nothing changes: an even number becomes its half."""
    start = table("supplier").where("s_suppkey > 0").select("s_suppkey", F.col("s_suppkey").alias("normal"))
    return control.fixpoint(start, lambda now: now.select("s_suppkey", F.when(F.col("normal") % 2 == 0, F.floor(F.col("normal") / 2).cast("long")).otherwise(F.col("normal")).alias("normal")), "s_suppkey")


@query("""
WITH b AS (SELECT o_orderpriority AS lane, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS open, sum(o_totalprice) AS cost FROM orders GROUP BY 1), a AS (SELECT o_orderpriority AS lane, count(*) AS n, sum(o_totalprice) AS cost FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT lane, b.n::BIGINT AS before, coalesce(a.n, 0)::BIGINT AS after, coalesce(a.n, 0) < b.n AS fewer, coalesce(a.cost, 0) < b.cost AS cheaper, coalesce(a.n, 0) < b.n AND coalesce(a.cost, 0) < b.cost AND 4 * b.open < 3 * b.n AS proved FROM b LEFT JOIN a USING (lane)
""")
def economics_proof(spark, table):
    """Two states and their gates: fewer, cheaper, and enough closed."""
    o, done = table("orders"), F.col("o_orderstatus") != "F"
    per = o.groupBy(F.col("o_orderpriority").alias("lane")).agg(F.count("*").alias("before"), F.count_if(done).alias("after"), F.sum("o_totalprice").alias("_b"), F.coalesce(F.sum(F.when(done, F.col("o_totalprice"))), F.lit(0.0)).alias("_a"), F.count_if(F.col("o_orderstatus") == "O").alias("_o"))
    fewer, cheaper = F.col("after") < F.col("before"), F.col("_a") < F.col("_b")
    return per.select("lane", "before", "after", fewer.alias("fewer"), cheaper.alias("cheaper"), (fewer & cheaper & (4 * F.col("_o") < 3 * F.col("before"))).alias("proved"))


@query("""
WITH f AS (SELECT p_brand, p_type, count(*) AS n, count(DISTINCT p_size) AS sizes FROM part GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT p_brand AS plan, count(*)::BIGINT AS findings, sum(n)::BIGINT AS loci, sum(greatest(n - sizes, 0))::BIGINT AS savings, (10 * sum(greatest(n - sizes, 0)) + sum(n) + count(*))::BIGINT AS priority FROM f GROUP BY 1
""")
def scan_plans(spark, table):
    """Findings gathered to plans by brand, with the priority of each."""
    f = table("part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.count_distinct("p_size").alias("sizes")).where("n >= 2")
    saved = F.greatest(F.col("n") - F.col("sizes"), F.lit(0))
    per = f.groupBy(F.col("p_brand").alias("plan")).agg(F.count("*").alias("findings"), F.sum("n").alias("loci"), F.sum(saved).alias("savings"))
    return per.withColumn("priority", 10 * F.col("savings") + F.col("loci") + F.col("findings"))


@query("""
WITH a AS (SELECT n_nationkey AS authority, r_name AS kind FROM nation JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT s_suppkey AS projection, s_nationkey AS authority, s_acctbal >= 0 AS certified FROM supplier)
SELECT kind, count(DISTINCT a.authority)::BIGINT AS authorities, count(DISTINCT projection)::BIGINT AS projections, count(projection)::BIGINT AS edges, count(*) FILTER (certified)::BIGINT AS certificates FROM a LEFT JOIN p USING (authority) GROUP BY 1
""")
def descent_graph(spark, table):
    """Authorities, projections, edges and certificates by kind of authority."""
    a = table("nation").join(F.broadcast(table("region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("authority"), F.col("r_name").alias("kind"))
    p = table("supplier").select(F.col("s_suppkey").alias("projection"), F.col("s_nationkey").alias("authority"), (F.col("s_acctbal") >= 0).alias("certified"))
    met = a.join(p, "authority", "left")
    return met.groupBy("kind").agg(F.count_distinct("authority").alias("authorities"), F.count_distinct("projection").alias("projections"), F.count("projection").alias("edges"), F.count_if("certified").alias("certificates"))


@query("""
SELECT c_mktsegment, count(*)::BIGINT AS n, sum(CASE WHEN c_acctbal > 5000 THEN 3 WHEN c_nationkey < 5 THEN 2 ELSE 1 END)::BIGINT AS weight FROM customer GROUP BY 1
""")
def metric_providers(spark, table):
    """Weights from the first provider of an ordered list that has one."""
    providers = [F.when(F.col("c_acctbal") > 5000, 3), F.when(F.col("c_nationkey") < 5, 2), F.lit(1)]
    return table("customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum(control.first_of(*providers)).alias("weight"))
