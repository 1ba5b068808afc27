"""DuckDB SQL for the queries of this subpackage that SQL can express, from the same parameters."""

from __future__ import annotations

from fiberloom.llm import linkrank, mixing, warc


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def mixing_sql() -> str:
    hexed = f"substr(md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, '-')), 1, 12)"
    return f"""
WITH d AS (SELECT doc_id, source, length(text) AS chars, coalesce(len(regexp_extract_all(text, '{mixing.WORD}')), 0)::BIGINT AS size FROM documents),
k AS (SELECT *, -ln((('0x' || {hexed})::BIGINT::DOUBLE + 0.5) / {float(1 << 48)}) / coalesce(1.0 / (1.0 + abs(chars / greatest(size, 1) - 6.0)), 1.0) AS key FROM d),
s AS (SELECT source, source_size, {list(mixing.CYCLE)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.CYCLE)} + 1] AS weight FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
r AS (SELECT *, row_number() OVER o AS place, (SELECT {mixing.SHARE} * sum(source_size) FROM s) AS total,
  coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held, sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM s WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)),
l AS (SELECT place, (total - {float(mixing.MOST_EPOCHS)} * held) / free AS level FROM r WHERE {float(mixing.MOST_EPOCHS)} * source_size > weight * ((total - {float(mixing.MOST_EPOCHS)} * held) / free) ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN l.place IS NULL OR r.place < l.place THEN {float(mixing.MOST_EPOCHS)} * source_size ELSE weight * level END::DOUBLE AS target FROM r LEFT JOIN l ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
b AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT - epochs * source_size ELSE 0 END AS budget FROM e),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source
"""


def warc_sql() -> str:
    def urn(kind: str, rest: str) -> str:
        h = f"md5({kind} || '|' || {rest})"
        return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"

    text = "payload"
    for pattern, put in warc.STRIP:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(put)}, 'g')".replace("'\n'", "chr(10)")
    for name, char in warc.ENTITIES:
        text = f"replace({text}, {quoted(name)}, {quoted(char)})"
    for pattern, put in warc.TIDY:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(put)}, 'g')".replace("'\n'", "chr(10)")
    nl = "chr(13) || chr(10)"
    title = f"regexp_replace(regexp_extract(payload, {quoted(warc.TITLE)}, 1), '[ \\t\\n\\f\\r]+', ' ', 'g')"
    links = f"coalesce(list_aggregate(list_transform(regexp_extract_all(payload, {quoted(warc.LINK)}, 1), lambda x: 'outlink: ' || x || {nl}), 'string_agg', ''), '')"
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
r AS (SELECT *, {urn("'response'", "coalesce(page_id::VARCHAR, '-') || '|' || target_uri")} AS refers_to, 'sha256:' || sha256(payload) AS source_digest FROM p),
k AS (SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type, 'source-digest: ' || source_digest || {nl} || 'source-bytes: ' || strlen(payload)::VARCHAR || {nl} || 'title: ' || {title} || {nl} || {links} AS block FROM r
 UNION ALL SELECT *, 'conversion', 'text/plain', {text} FROM r)
SELECT page_id, record_type, {urn("'derived|' || record_type", "refers_to")} AS record_id, refers_to, target_uri, '2024-01-01T00:00:00Z' AS date, content_type,
 'HTTP/1.1 200 OK' || {nl} || 'Content-Type: text/html' AS source_headers, source_digest, 'sha256:' || sha256(block) AS block_digest, strlen(block)::BIGINT AS block_bytes, block FROM k
"""


def urls_sql() -> str:
    lower = lambda x: f"translate({x}, '{linkrank.UPPER}', '{linkrank.LOWER}')"
    ordered = sorted(linkrank.RULES, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r[0] != "block"))
    case = lambda value: "CASE " + " ".join(f"WHEN (host = {quoted(h)} OR ends_with(host, {quoted('.' + h)})) AND starts_with(path, {quoted(p)}) THEN {quoted(value(v, h, p))}" for v, h, p in ordered) + " END"
    rounds = []
    for i in range(1, linkrank.ROUNDS + 1):
        last = "seeds" if i == 1 else f"r{i - 1}"
        rounds.append(f"""r{i} AS MATERIALIZED (SELECT host, sum(t) AS t, sum(d) AS d FROM (SELECT w.dst AS host, s.t * w.t * {linkrank.DAMPING} AS t, s.d * w.d * {linkrank.DAMPING} AS d FROM {last} s JOIN ways w ON w.src = s.host
 UNION ALL SELECT host, t * (1 - {linkrank.DAMPING}), d * (1 - {linkrank.DAMPING}) FROM seeds) GROUP BY host)""")
    return f"""
WITH cut AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, html, {lower("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
said AS (SELECT page_id, html, host, path, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS said FROM parts),
hosts AS (SELECT host, count(*) FILTER (said = 'allow') AS a, count(*) FILTER (said = 'block') AS b FROM said GROUP BY host),
seeds AS (SELECT host, a / greatest((SELECT sum(a) FROM hosts), 1.0) AS t, b / greatest((SELECT sum(b) FROM hosts), 1.0) AS d FROM hosts),
links AS (SELECT host AS src, {lower("regexp_extract(unnest(regexp_extract_all(html, " + quoted(linkrank.HREF) + ", 1)), '//([^/?#]*)', 1)")} AS dst FROM said),
up AS (SELECT DISTINCT src, regexp_replace(src, '^[^.]*\\.', '') AS dst FROM (SELECT array_to_string(labels[i:], '.') AS src FROM (SELECT string_split(host, '.') AS labels FROM hosts), unnest(range(1, greatest(len(labels) - 1, 1) + 1)) AS u(i))),
edges AS (SELECT src, dst, sum(n) AS n FROM (SELECT src, dst, 1.0 AS n FROM links WHERE dst <> src AND dst <> '' UNION ALL SELECT src, dst, 1.0 FROM up WHERE dst <> src AND instr(dst, '.') > 0 UNION ALL SELECT dst, src, 1.0 FROM up WHERE dst <> src AND instr(dst, '.') > 0) GROUP BY src, dst),
ways AS MATERIALIZED (SELECT src, dst, sum(t) AS t, sum(d) AS d FROM (
 SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS t, 0.0 AS d FROM edges UNION ALL SELECT dst, src, 0.0, n / sum(n) OVER (PARTITION BY dst) FROM edges) GROUP BY src, dst),
{", ".join(rounds)}
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN coalesce(d, 0) > {linkrank.THRESHOLD} * (coalesce(t, 0) + coalesce(d, 0)) THEN 'block' ELSE 'allow' END) AS verdict FROM said LEFT JOIN r{linkrank.ROUNDS} USING (host)
"""


SQL = {"op2_mixing": mixing_sql(), "op3_warc": warc_sql(), "op10_urls": urls_sql()}
