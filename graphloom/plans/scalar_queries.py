"""Queries of scalar functions, deletes and recognisers that other queries do not cover, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as Sc
from ..operators import frontend as W
from ..operators import mutations as M
from ..operators import resolution as X
from ..sources.projection import INGEST_GRAPH_SQL, ORDER_GRAPH_SQL, ingest_graph, order_graph
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


_WORD = "(CASE p_partkey % 7 WHEN 0 THEN p_name || 's' WHEN 1 THEN p_type || 'ies' WHEN 2 THEN p_type || 'xes' WHEN 3 THEN p_brand || 'ches' WHEN 4 THEN 's' WHEN 5 THEN 'ies' ELSE p_type END)"
_add("ref_scalar_singular", lambda s, d: table(s, d, "part").select("p_partkey", F.expr(_WORD).alias("w")).select("p_partkey", Sc.singular(F.col("w")).alias("one"), Sc.without_suffix(F.col("w"), "IES").alias("bare")), f"""
WITH w AS (SELECT p_partkey, {_WORD} AS w FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(w, '(?i)ies$') AND length(w) > 3 THEN left(w, length(w) - 3) || 'y' WHEN regexp_matches(w, '(?i)(ses|xes|zes|ches|shes)$') THEN left(w, length(w) - 2) WHEN regexp_matches(w, '(?i)s$') AND length(w) > 1 THEN left(w, length(w) - 1) ELSE w END AS one,
 regexp_replace(w, '(?i)ies$', '') AS bare FROM w""")
_add("ref_scalar_common_prefix", lambda s, d: Sc.common_prefix(order_graph(s, d)[0].where("namespace is not null").select("project_context", "namespace"), "project_context", "namespace", "."), f"""WITH {ORDER_GRAPH_SQL},
x AS (SELECT DISTINCT project_context, namespace, unnest(generate_series(1, len(string_split(namespace, '.')))) AS k FROM n WHERE namespace IS NOT NULL),
y AS (SELECT project_context, k, count(DISTINCT namespace) AS c, min(lower(array_to_string(string_split(namespace, '.')[1:k], '.'))) AS a, max(lower(array_to_string(string_split(namespace, '.')[1:k], '.'))) AS b, min(array_to_string(string_split(namespace, '.')[1:k], '.')) AS p FROM x GROUP BY 1, 2),
t AS (SELECT project_context, count(DISTINCT namespace) AS c FROM x GROUP BY 1)
SELECT t.project_context, max(p) FILTER (y.c = t.c AND a = b) AS prefix FROM t JOIN y ON y.project_context IS NOT DISTINCT FROM t.project_context GROUP BY 1""")
_WINDOW = "(CASE p_partkey % 5 WHEN 0 THEN p_size || 'h' WHEN 1 THEN p_size || 'D' WHEN 2 THEN ' ' || p_size || 'm' WHEN 3 THEN 'h' ELSE p_size || ' days' END)"
_add("ref_scalar_window_seconds", lambda s, d: table(s, d, "part").select("p_partkey", Sc.window_seconds(F.expr(_WINDOW)).alias("seconds")), f"""
WITH w AS (SELECT p_partkey, lower(trim({_WINDOW})) AS w FROM part)
SELECT p_partkey, CASE WHEN regexp_full_match(w, '-?\\d{{1,9}}[mhd]') THEN left(w, length(w) - 1)::BIGINT * CASE right(w, 1) WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 ELSE 60 END ELSE 86400 END::BIGINT AS seconds FROM w""")
_STOP = ["should", "which", "with", "this", "that", "from"]
_add("ref_scalar_feature_terms", lambda s, d: Sc.feature_terms(
    table(s, d, "documents").select("text", F.lit(6).alias("weight")).unionByName(table(s, d, "documents").select(F.col("source").alias("text"), F.lit(2).alias("weight"))), _STOP, 40), r"""
WITH t AS (SELECT unnest(regexp_split_to_array(lower(text), '[ \t\r\n.,:;/\\\-_`"''()\[\]{}]+')) AS term, 6 AS weight FROM documents UNION ALL SELECT unnest(regexp_split_to_array(lower(source), '[ \t\r\n.,:;/\\\-_`"''()\[\]{}]+')), 2 FROM documents)
SELECT term, sum(weight)::BIGINT AS weight FROM t WHERE length(term) >= 4 AND term NOT IN ('should', 'which', 'with', 'this', 'that', 'from') GROUP BY 1 ORDER BY weight DESC, term LIMIT 40""")
_GLOBS = ["**/obj/**", "**/*.g.cs", "src/*/Data/*", "tests/**"]
_add("ref_scalar_glob_match", lambda s, d: table(s, d, "nodes").select("ingest_no", Sc.glob_match(F.col("file_path"), _GLOBS).alias("hit")), r"""
SELECT ingest_no, regexp_matches(replace(coalesce(file_path, ''), '\', '/'), '(?i)^(?:.*/)?obj/.*$|^(?:.*/)?[^/]*\.g\.cs$|^src/[^/]*/data/[^/]*$|^tests/.*$') AS hit FROM nodes""")
_TOOLTEXT = """concat('[McpServerTool(Name = "', p_name, '")] x [mcpservertool ( name="', p_brand, '" )] McpServerTool(Name = "")')"""
_add("ref_scalar_tool_names", lambda s, d: table(s, d, "part").select("p_partkey", F.explode(Sc.tool_names(F.expr(_TOOLTEXT))).alias("tool")), f"""
SELECT DISTINCT p_partkey, trim(unnest(regexp_extract_all({_TOOLTEXT}, '(?i)McpServerTool\\s*\\(\\s*Name\\s*=\\s*"([^"]+)"\\s*\\)', 1))) AS tool FROM part""")

_COLOUR = """(CASE p_partkey % 6 WHEN 0 THEN '#' || lpad(lower(hex((p_partkey * 7919 + 1048576) % 16777216)), 6, '0') WHEN 1 THEN 'rgb(' || (p_partkey % 300) || ', ' || (p_size * 2) || '%, 7)' WHEN 2 THEN 'RGBA(1,2,3,0.5)'
 WHEN 3 THEN 'hsl(' || (p_partkey % 720 - 360) || ', ' || p_size * 2 || '%, 40%)' WHEN 4 THEN 'Orange' ELSE p_size || 'px' END)"""
_HSL = "round(255 * (0.4 - p_size * 0.02 * 0.4 * greatest(-1.0, least(k - 3, 9 - k, 1.0))))::INT"
_K = "(({n} + ((p_partkey % 720 - 360 + 720) % 360) / 30.0) % 12)"


def _colours(s, d):
    c = Sc.colour(F.col("v"))
    return table(s, d, "part").select("p_partkey", F.expr(_COLOUR).alias("v")).select("p_partkey", F.explode(F.array(c)).alias("c")).where("c is not null").select("p_partkey", "c.r", "c.g", "c.b", "c.a")


_add("ref_scalar_colour", _colours, f"""
WITH v AS (SELECT p_partkey, p_size, p_partkey % 6 AS kind, lpad(lower(hex((p_partkey * 7919 + 1048576) % 16777216)), 6, '0') AS h FROM part), b AS (SELECT *, CASE WHEN length(h) = 6 THEN h WHEN length(h) = 3 THEN h[1] || h[1] || h[2] || h[2] || h[3] || h[3] END AS w FROM v WHERE kind < 5)
SELECT p_partkey,
 CASE kind WHEN 0 THEN ('0x' || w[1:2])::INT WHEN 1 THEN least(p_partkey % 300, 255)::INT WHEN 2 THEN 1 WHEN 3 THEN {_HSL.replace('k', _K.format(n=0))} ELSE 255 END AS r,
 CASE kind WHEN 0 THEN ('0x' || w[3:4])::INT WHEN 1 THEN round(least(p_size * 2, 100) * 2.55::DOUBLE)::INT WHEN 2 THEN 2 WHEN 3 THEN {_HSL.replace('k', _K.format(n=8))} ELSE 165 END AS g,
 CASE kind WHEN 0 THEN ('0x' || w[5:6])::INT WHEN 1 THEN 7 WHEN 2 THEN 3 WHEN 3 THEN {_HSL.replace('k', _K.format(n=4))} ELSE 0 END AS b,
 CASE kind WHEN 2 THEN 128 ELSE 255 END AS a FROM b WHERE kind <> 0 OR w IS NOT NULL""")
_add("ref_R13_near_duplicate_colours", lambda s, d: W.near_duplicate_colours(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("property"), F.expr("concat('#', lpad(lower(hex(p_size * 5)), 2, '0'), lpad(lower(hex(p_partkey % 8 * 30)), 2, '0'), '40')").alias("value"))), """
WITH RECURSIVE v AS (SELECT p_partkey AS id, p_type AS property, p_size * 5 AS r, p_partkey % 8 * 30 AS g, '#' || lpad(lower(hex(p_size * 5)), 2, '0') || lpad(lower(hex(p_partkey % 8 * 30)), 2, '0') || '40ff' AS colour FROM part),
x AS (SELECT *, row_number() OVER (PARTITION BY property ORDER BY colour) AS k FROM (SELECT DISTINCT property, r, g, colour FROM v)),
w AS (SELECT property, k, [{'colour': colour, 'r': r, 'g': g}] AS leaders, colour AS leader, colour FROM x WHERE k = 1 UNION ALL
 SELECT property, k, CASE WHEN len(near) > 0 THEN leaders ELSE list_append(leaders, me) END, CASE WHEN len(near) > 0 THEN near[1].colour ELSE colour END, colour FROM
 (SELECT x.property, x.k, x.colour, w.leaders, {'colour': x.colour, 'r': x.r, 'g': x.g} AS me, list_filter(w.leaders, lambda l: sqrt((l.r - x.r) ** 2 + (l.g - x.g) ** 2) <= 18) AS near FROM w JOIN x ON x.property = w.property AND x.k = w.k + 1))
SELECT v.property, leader, v.colour, id FROM v JOIN w ON w.property = v.property AND w.colour = v.colour""")

# Deletes
_add("ref_M3_delete_kinds", lambda s, d: M.delete_kinds(*ingest_graph(s, d), ["Diagnostic", "Property"], "tidalledger")[1].groupBy("type").agg(F.count("*").alias("edges")), f"""WITH {INGEST_GRAPH_SQL},
gone AS (SELECT id FROM gn WHERE type IN ('Diagnostic', 'Property') AND lower(project_context) = 'tidalledger') SELECT type, count(*) AS edges FROM ge WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) GROUP BY 1""")
_add("ref_M4_delete_batches", lambda s, d: M.delete_batches(*ingest_graph(s, d), table(s, d, "node_deletions").select(F.col("node_id").alias("id")))[2], f"WITH {INGEST_GRAPH_SQL} SELECT type, count(*) AS deleted FROM gn WHERE id IN (SELECT node_id FROM node_deletions) GROUP BY 1")

# Data access: statements of all kinds put together from parts
_STATEMENT = """(CASE p_partkey % 5 WHEN 0 THEN concat('await prisma.part', p_size, '.findMany({})') WHEN 1 THEN concat('prismaClient.brand.upsert( { id: ', p_partkey, ' })') WHEN 2 THEN concat("knex('t", p_size, "').where({ a: 1 }).del()")
 WHEN 3 THEN concat('MATCH (a:Part', p_size, ')-[r:USES]->(b) RETURN b') ELSE concat('select x from tab', p_size, ' where y') END)"""
_add("ref_S15_data_accesses", lambda s, d: X.data_accesses(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.expr(_STATEMENT).alias("text"))), """
SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'prisma' WHEN 1 THEN 'prisma' WHEN 2 THEN 'knex' WHEN 3 THEN 'cypher' ELSE 'sql' END AS provider, CASE WHEN p_partkey % 5 IN (1, 2) THEN 'Write' ELSE 'Read' END AS operation,
 CASE p_partkey % 5 WHEN 0 THEN 'part' || p_size WHEN 1 THEN 'brand' WHEN 2 THEN 't' || p_size WHEN 3 THEN 'Part' || p_size ELSE 'tab' || p_size END AS name FROM part
UNION ALL SELECT p_partkey, 'cypher', 'Read', 'USES' FROM part WHERE p_partkey % 5 = 3""")
