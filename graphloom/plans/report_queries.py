"""Queries of reports, mutations, settings, styles, resolution and streams, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import NEEDS_PATH, layer_sql
from ..operators import algorithms as A
from ..operators import frontend as W
from ..operators import knowledge as K
from ..operators import mutations as M
from ..operators import reader as Rd
from ..operators import resolution as X
from ..operators import scoring as C
from ..operators import settings as Se
from ..operators import structural as St
from ..operators.model import COMMUNITY, STRUCTURAL, TRAVERSAL, sql_list
from ..operators.traverse import editing_context, impact
from ..sources.projection import INGEST_GRAPH_SQL, ORDER_GRAPH_SQL, ingest_graph, order_graph
from ..sources.tables import table
from ..streaming.watch import debounce
from .knowledge_queries import DOCS_SQL, _COS, _HAS, documents
from .structural_queries import SQL as _ST, _god, _FRESH, _VIOL
from .traverse_queries import SQL as _TV, _down, _impact

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name, graph, run, sql=None):
    QUERIES[name] = lambda spark, d: run(*graph(spark, d))
    if sql:
        SQL[name] = f"WITH RECURSIVE {ORDER_GRAPH_SQL if graph is order_graph else INGEST_GRAPH_SQL}{sql}"


def _raw(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


# Reader
_add("ref_P10_node_query", order_graph, lambda n, e: Rd.nodes(n, Rd.NodeFilter(labels=["Class", "Method"], project="america", contains={"name": "7"}), "lineCount", True, 10, 50).select("id", "name", "line_count"),
     " SELECT id, name, line_count FROM n WHERE type IN ('Class', 'Method') AND lower(project_context) = 'america' AND contains(lower(name), '7') ORDER BY line_count DESC NULLS FIRST, id LIMIT 50 OFFSET 10")
_add("ref_P11_relationship_query", order_graph, lambda n, e: Rd.relationships(e, n, ["Writes", "Reads"], project="ASIA"),
     " SELECT DISTINCT src, dst, e.type FROM e JOIN n s ON s.id = src JOIN n t ON t.id = dst WHERE e.type IN ('Writes', 'Reads') AND (lower(s.project_context) = 'asia' OR lower(t.project_context) = 'asia') ORDER BY src, e.type, dst LIMIT 100")
_add("ref_P15_labels", order_graph, lambda n, e: Rd.labels(n).unionByName(Rd.labels(e)).distinct(), " SELECT DISTINCT type FROM n UNION SELECT DISTINCT type FROM e")
_add("ref_P16_node_by_id", order_graph, lambda n, e: Rd.node(n, "customer:8").select("id", "name", "type"), " SELECT id, name, type FROM n WHERE id = 'customer:8'")
_raw("ref_property_rows", lambda s, d: Rd.property_rows(table(s, d, "nodes").where("properties is not null").select(F.col("ingest_no").alias("id"), "properties")), """
WITH p AS (SELECT ingest_no AS id, unnest(map_entries(properties)) AS e FROM nodes) SELECT id, e.key AS key, e.value AS value,
 CASE WHEN e.value IS NULL THEN 'Null' WHEN lower(e.value) IN ('true', 'false') THEN 'Boolean' WHEN regexp_full_match(e.value, '-?[0-9]{1,18}') THEN 'Integer' WHEN regexp_full_match(e.value, '-?[0-9]+\\.[0-9]+') THEN 'Float' ELSE 'String' END AS kind FROM p WHERE e.key NOT IN ('id', 'name', 'type', 'embedding')""")

# Mutations
_COLS = ["name", "type", "file_path"]
_CUT = "2026-03-01"


def _states(s, d):
    """The node table as of a day, and what came later."""
    raw = table(s, d, "nodes").where("id is not null")
    old = raw.where(f"last_indexed_at < '{_CUT}'")
    was = old.groupBy("id").agg(F.max_by(F.struct(*_COLS, "source_hash", "created_at", "updated_at", "last_indexed_at"), F.struct("last_indexed_at", "ingest_no")).alias("r"), F.count("*").alias("change_count")).select("id", "r.*", "change_count")
    was = was.withColumn("created_at", F.coalesce("created_at", "last_indexed_at"))
    return was, raw.where(f"last_indexed_at >= '{_CUT}'")


def _m1(s, d):
    was, new = _states(s, d)
    return M.upsert_nodes(was, new, F.lit("2026-12-01 00:00:00").cast("timestamp"), _COLS)


_raw("ref_M1_T4_upsert_nodes", _m1, f"""
WITH o AS (SELECT id, name, type, file_path, source_hash, coalesce(created_at, last_indexed_at) AS created_at, updated_at, last_indexed_at, c AS change_count FROM (SELECT *, count(*) OVER (PARTITION BY id) AS c FROM nodes WHERE id IS NOT NULL AND last_indexed_at < TIMESTAMP '{_CUT}') QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_indexed_at DESC, ingest_no DESC) = 1),
w AS (SELECT * FROM nodes WHERE id IS NOT NULL AND last_indexed_at >= TIMESTAMP '{_CUT}' QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingest_no DESC) = 1),
j AS (SELECT coalesce(o.id, w.id) AS id, w.id IS NOT NULL AS came, o.id IS NOT NULL AS was, w.id IS NOT NULL AND (w.source_hash IS NULL OR o.source_hash IS NULL OR w.source_hash <> o.source_hash) AS ch, o.name AS n1, w.name AS n2, o.type AS t1, w.type AS t2, o.file_path AS f1, w.file_path AS f2, o.source_hash AS h1, w.source_hash AS h2, o.created_at AS c1, o.updated_at AS u1, o.last_indexed_at AS l1, o.change_count AS k1 FROM o FULL JOIN w ON o.id = w.id)
SELECT id, CASE WHEN came THEN n2 ELSE n1 END AS name, CASE WHEN came THEN t2 ELSE t1 END AS type, CASE WHEN came THEN f2 ELSE f1 END AS file_path, CASE WHEN came THEN h2 ELSE h1 END AS source_hash,
 CASE WHEN was THEN c1 ELSE TIMESTAMP '2026-12-01' END AS created_at, CASE WHEN ch OR NOT was THEN TIMESTAMP '2026-12-01' ELSE u1 END AS updated_at, CASE WHEN came THEN TIMESTAMP '2026-12-01' ELSE l1 END AS last_indexed_at, (coalesce(k1, 0) + ch::INT)::BIGINT AS change_count FROM j""")


def _m2(s, d):
    n, _ = ingest_graph(s, d)
    e = table(s, d, "edges").select("edge_no", "src", "type", "dst", "confidence", "indexed_at")
    old = e.where(f"indexed_at < '{_CUT}'").groupBy("src", "type", "dst").agg(F.max_by("confidence", "edge_no").alias("confidence"))
    return M.upsert_edges(old, e.where(f"indexed_at >= '{_CUT}'"), n)


_raw("ref_M2_upsert_edges", _m2, f"WITH {INGEST_GRAPH_SQL}" + f""",
nw AS (SELECT src, type, dst, confidence FROM edges WHERE indexed_at >= TIMESTAMP '{_CUT}' AND src IN (SELECT id FROM gn) AND dst IN (SELECT id FROM gn) QUALIFY row_number() OVER (PARTITION BY src, type, dst ORDER BY edge_no DESC) = 1),
od AS (SELECT src, type, dst, confidence FROM edges WHERE indexed_at < TIMESTAMP '{_CUT}' QUALIFY row_number() OVER (PARTITION BY src, type, dst ORDER BY edge_no DESC) = 1)
SELECT * FROM nw UNION ALL SELECT * FROM od WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.src = od.src AND nw.type = od.type AND nw.dst = od.dst)""")
_add("ref_M3_delete_project", order_graph, lambda n, e: M.delete_project(n, e, "asia")[1].select("src", "dst", "type"), """
 SELECT src, dst, type FROM e WHERE src NOT IN (SELECT id FROM n WHERE lower(project_context) = 'asia') AND dst NOT IN (SELECT id FROM n WHERE lower(project_context) = 'asia')""")


def _m3(s, d):
    n, e = ingest_graph(s, d)
    return M.delete_files(n, e, table(s, d, "nodes").where("file_path like '%Tests.cs'").select(F.col("file_path").alias("path")))[0].select("id")


_raw("ref_M3_delete_files", _m3, f"WITH {INGEST_GRAPH_SQL} SELECT id FROM gn WHERE file_path IS NULL OR lower(file_path) NOT IN (SELECT lower(file_path) FROM nodes WHERE file_path LIKE '%Tests.cs')")


def _s10(s, d):
    f = table(s, d, "nodes").where("file_path is not null")
    state = lambda x: x.groupBy("file_path").agg(F.max_by("source_hash", F.struct("updated_at", "ingest_no")).alias("hash")).withColumnRenamed("file_path", "path")
    low = lambda x: x.groupBy(F.lower("path").alias("k")).agg(F.min(F.struct("path", "hash")).alias("r")).select("r.*")
    return M.incremental_plan(low(state(f.where(f"updated_at < '{_CUT}'"))), low(state(f.where("updated_at >= '2026-01-01'"))))


def _file_state(cond):
    return f"(SELECT file_path AS path, source_hash AS hash FROM (SELECT * FROM nodes WHERE file_path IS NOT NULL AND {cond} QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY updated_at DESC, ingest_no DESC) = 1) QUALIFY row_number() OVER (PARTITION BY lower(file_path) ORDER BY file_path) = 1)"


_raw("ref_S10_U3_incremental_plan", _s10, f"""
WITH a AS {_file_state(f"updated_at < TIMESTAMP '{_CUT}'")}, b AS {_file_state("updated_at >= TIMESTAMP '2026-01-01'")}
SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'deleted' ELSE 'changed' END AS action FROM a FULL JOIN b ON lower(a.path) = lower(b.path) WHERE a.path IS NULL OR b.path IS NULL OR a.hash IS DISTINCT FROM b.hash""")
_raw("ref_M10_merge_partial_types", lambda s, d: M.merge_partial_types(table(s, d, "nodes")), """
SELECT id, min(file_path) AS file_path, sum(line_count)::BIGINT AS line_count, min(line_number) AS line_number, arg_max(summary, {'a': length(summary), 'b': summary}) FILTER (summary IS NOT NULL) AS summary, count(*) AS parts FROM nodes WHERE id IS NOT NULL GROUP BY id""")


def _m5(s, d):
    n, _ = ingest_graph(s, d)
    has = K.extract_keywords(K.keyword_sources(n, documents(s, d)))
    part = has.where("id like 'TidalLedger%'").withColumn("weight", F.lit(1.0))
    return M.replace_keywords(has, part).groupBy("id").agg(F.count("*").alias("keywords"))


_raw("ref_M5_replace_keywords", _m5, f"WITH {INGEST_GRAPH_SQL}, {DOCS_SQL}, {_HAS} SELECT id, count(*) AS keywords FROM hk GROUP BY id")


def _t5(s, d):
    src = table(s, d, "nodes").where("summary is not null and name is not null").select(F.col("ingest_no").alias("id"), F.explode(F.array(F.struct(F.lit("name").alias("source"), F.col("name").alias("text")), F.struct(F.lit("summary").alias("source"), F.col("summary").alias("text")))).alias("p")).select("id", "p.source", "p.text")
    stored = table(s, d, "nodes").where("ingest_no % 2 = 0").select(F.col("ingest_no").alias("id"), F.sha2(F.concat(F.lit("name:"), "name", F.lit("\nsummary:"), "summary", F.lit("\n")), 256).alias("checksum"))
    return M.unchanged_texts(src, stored)


_raw("ref_T5_unchanged_texts", _t5, "SELECT ingest_no AS id FROM nodes WHERE summary IS NOT NULL AND name IS NOT NULL AND ingest_no % 2 = 0")


def _contexts(s, d):
    del_ = table(s, d, "node_deletions").groupBy("node_id").agg(F.min("deletion_no").alias("id"))
    raw = table(s, d, "nodes").groupBy("id").agg(F.min_by("source_hash", "ingest_no").alias("hash_then")).withColumnRenamed("id", "node_id")
    return del_.join(raw, "node_id", "left").select("id", "node_id", "hash_then")


_raw("ref_J12_context_status", lambda s, d: M.context_status(_contexts(s, d), ingest_graph(s, d)[0]), f"WITH {INGEST_GRAPH_SQL}" + """,
c AS (SELECT min(deletion_no) AS id, node_id FROM node_deletions GROUP BY node_id), f AS (SELECT id AS node_id, arg_min(source_hash, ingest_no) FILTER (source_hash IS NOT NULL) AS hash_then FROM nodes GROUP BY id)
SELECT c.id, CASE WHEN gn.id IS NULL THEN 'orphaned' WHEN hash_then IS NULL OR source_hash IS NULL THEN 'hash-unknown' WHEN hash_then = source_hash THEN 'graph-unchanged' ELSE 'target-changed' END AS status FROM c LEFT JOIN f ON f.node_id = c.node_id LEFT JOIN gn ON gn.id = c.node_id""")


def _m8(s, d):
    c = table(s, d, "node_deletions").select(F.col("deletion_no").alias("id"), "node_id", "reason")
    return M.add_contexts(c.where("id % 2 = 0"), c.where("id % 3 = 0")).select("id", "node_id")


_raw("ref_M8_add_contexts", _m8, "SELECT deletion_no AS id, node_id FROM node_deletions WHERE deletion_no % 2 = 0 OR deletion_no % 3 = 0")
_add("ref_M9_external_link", order_graph, lambda n, e: M.external_link(n, e, "order:1", "Mailer", "Service")[1].where("dst = 'ExternalConcept:Mailer'").select("src", "dst", "type"), " SELECT id AS src, 'ExternalConcept:Mailer' AS dst, 'Uses' AS type FROM n WHERE id = 'order:1'")

# Streams, as batches
_raw("ref_T1_debounce", lambda s, d: debounce(table(s, d, "events").select("ts", F.concat(F.lit("user/"), "user_id").alias("path"), (F.col("event_type") == "error").alias("deleted")), "1 hour"), """
WITH ev AS (SELECT ts, 'user/' || user_id AS path, event_type = 'error' AS deleted FROM events WHERE ts IS NOT NULL),
m AS (SELECT *, (lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 1 HOUR)::INT AS s FROM ev WINDOW w AS (PARTITION BY path ORDER BY ts)), g AS (SELECT *, sum(s) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM m)
SELECT path, min(ts) AS opened, max(ts) + INTERVAL 1 HOUR AS closed, arg_max(deleted, {'t': ts, 'd': deleted}) AS deleted, count(*) AS events FROM g GROUP BY path, b""")
_raw("ref_T2_refresh_batch", lambda s, d: table(s, d, "nodes").where("id is not null").select(F.col("project_context").alias("project"), "id").dropDuplicates(["project", "id"]), "SELECT DISTINCT project_context AS project, id FROM nodes WHERE id IS NOT NULL")

# Scores
_TT = "(coalesce(file_role = 'Test', false) OR (coalesce(file_role, 'Unknown') = 'Unknown' AND (contains(lower(coalesce(namespace, '')), 'test') OR contains(lower(coalesce(file_path, '')), 'test') OR contains(lower(coalesce(name, '')), 'test'))))"


def _some(n, e):
    t = n.where("file_role = 'Test'").select(F.col("id").alias("src"))
    r = e.where("type = 'Calls'").join(t, "src", "left_semi").agg(F.min("dst").alias("id")).first()
    return r["id"] or ""


_J3 = f""", tg AS (SELECT * FROM {{n}} WHERE id = (SELECT min(dst) FROM {{e}} ee WHERE ee.type = 'Calls' AND src IN (SELECT id FROM {{n}} WHERE file_role = 'Test'))),
ts AS (SELECT * FROM {{n}} WHERE {_TT}), dc AS (SELECT DISTINCT src AS id FROM {{e}} WHERE type = 'Calls' AND dst = (SELECT id FROM tg)),
rt AS (SELECT * FROM (SELECT id, 'direct' AS match FROM ts WHERE id IN (SELECT id FROM dc) ORDER BY name, id LIMIT 25)
 UNION ALL SELECT * FROM (SELECT ts.id, 'heuristic' FROM ts, tg WHERE ts.id NOT IN (SELECT id FROM dc) AND (ts.file_path = tg.file_path OR ts.namespace = tg.namespace OR contains(lower(coalesce(ts.file_path, '')), lower(tg.name)) OR contains(lower(ts.name), lower(tg.name)) OR contains(lower(tg.name), lower(ts.name))
  OR (length(split_part(lower(tg.name), '(', 1)) >= 4 AND (contains(lower(coalesce(ts.file_path, '')), split_part(lower(tg.name), '(', 1)) OR contains(lower(ts.name), split_part(lower(tg.name), '(', 1))))) ORDER BY ts.name, ts.id LIMIT 25))"""
_add("ref_J3_related_tests", order_graph, lambda n, e: C.related_tests(n, e, _some(n, e)), _J3.format(n="n", e="e") + " SELECT * FROM rt")
_add("ref_J3_related_tests_ingest", ingest_graph, lambda n, e: C.related_tests(n, e, _some(n, e)), _J3.format(n="gn", e="ge") + " SELECT * FROM rt")
_add("ref_C3_recommended_tests", order_graph, lambda n, e: C.recommended_tests(C.related_tests(n, e, _some(n, e))), _J3.format(n="n", e="e") + """
SELECT id, max(CASE WHEN match = 'direct' THEN 300 ELSE 40 END) AS score, CASE WHEN max(CASE WHEN match = 'direct' THEN 300 ELSE 40 END) >= 250 THEN 0 WHEN contains(lower(id), 'contract') OR contains(lower(id), 'api') THEN 1 WHEN contains(lower(id), 'integration') THEN 2 ELSE 3 END AS category FROM rt GROUP BY id""")
_HIT = "hit AS (" + _impact("n", "e", "part:5", "Class", 3).rsplit("\nSELECT best.id", 1)[1].join(["SELECT best.id", ")"])
_IMP = ", " + _impact("n", "e", "part:5", "Class", 3).rsplit("\nSELECT best.id", 1)[0] + ", " + _HIT
_add("ref_C1_impact_confidence", order_graph, lambda n, e: C.impact_confidence(impact(n, e, "part:5", 3), n.withColumn("line_number", F.lit(None).cast("int")), e, "part:5"), _IMP + f""",
ls AS (SELECT src AS id, min(coalesce(confidence, 1.0)) AS least, bool_or(type IN ('Implements', 'Inherits')) AS ab FROM e WHERE type IN {sql_list(TRAVERSAL)} GROUP BY src)
SELECT hit.id, dist, CASE WHEN {_FRESH.replace('coalesce(line_number > 0, false) OR ', '').replace('type IN', 'n.type IN')} = 'Low' THEN 'unknown' WHEN coalesce(ab, false) OR coalesce(least, 1.0) < 0.95 OR bucket = 'workflow' THEN 'heuristic' ELSE 'proven' END AS confidence FROM hit JOIN n ON n.id = hit.id LEFT JOIN ls ON ls.id = hit.id""")


def _kinds(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", (F.col("vec_id") * 7 % 97).cast("int").alias("lines"), "embedding")


def _fan(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 7).alias("fan_in"))


_DUP = f"""em AS (SELECT vec_id AS id, label, (vec_id * 7 % 97)::INT AS lines, embedding, vec_id % 7 AS fan FROM embeddings), pl AS (SELECT * FROM em ORDER BY lines DESC, id LIMIT 200),
dp AS (SELECT a.id AS a, q.id AS b, round((1 + {_COS}) / 2, 6) AS score, a.fan::BIGINT AS fan_a, q.fan::BIGINT AS fan_b, a.lines AS la, q.lines AS lb FROM pl a JOIN em q ON a.label = q.label AND a.id < q.id WHERE round((1 + {_COS}) / 2, 6) >= 0.5 ORDER BY score DESC, a.fan + q.fan DESC, a.id, q.id LIMIT 20)"""
_raw("ref_J10_duplicate_candidates", lambda s, d: C.duplicate_candidates(_kinds(s, d), _fan(s, d), 0.5), f"WITH {_DUP} SELECT a, b, score, fan_a, fan_b FROM dp")
_raw("ref_C9_partition_duplicates", lambda s, d: C.partition_duplicates(C.duplicate_candidates(_kinds(s, d), _fan(s, d), 0.5), _kinds(s, d)), f"WITH {_DUP} SELECT a, b, score, score >= 0.92 AND greatest(fan_a, fan_b) <= 4 AND coalesce(least(la, lb) / nullif(greatest(la, lb), 0)::DOUBLE, 0) >= 0.5 AS is_primary FROM dp")
_add("ref_R9_erosion_timeline", order_graph, lambda n, e: C.erosion_timeline(n, e, "1998-08-02", 30), f"""{_god('n', 'e', 300, 3).replace('SELECT g.id, line_count', ', godc AS (SELECT g.id, line_count', 1).replace('ORDER BY quality DESC, line_count DESC, fan_in DESC, name, g.id LIMIT 20', 'ORDER BY quality DESC, line_count DESC, fan_in DESC, name, g.id LIMIT 20)')}, {_VIOL},
vt AS (SELECT * FROM viol WHERE violation IS NOT NULL ORDER BY violation, sn, tn, src, dst, type LIMIT 50),
vd AS (SELECT coalesce(greatest(coalesce(s.updated_at, s.created_at), coalesce(t.updated_at, t.created_at))::DATE, DATE '1998-08-02') AS day FROM vt JOIN n s ON s.id = src JOIN n t ON t.id = dst),
gd AS (SELECT coalesce(coalesce(updated_at, created_at)::DATE, DATE '1998-08-02') AS day, godc.line_count FROM godc JOIN n ON n.id = godc.id),
dy AS (SELECT unnest(generate_series(DATE '1998-07-04', DATE '1998-08-02', INTERVAL 1 DAY))::DATE AS day)
SELECT day, (SELECT count(*) FROM vd WHERE vd.day <= dy.day) AS violations, (SELECT count(*) FROM gd WHERE gd.day <= dy.day) AS god_classes, (SELECT coalesce(sum(line_count), 0)::BIGINT FROM gd WHERE gd.day <= dy.day) AS god_lines FROM dy""")
_add("ref_C5_context_cost", order_graph, lambda n, e: C.context_cost(n.select(F.col("project_context").alias("pack"), "file_path", "line_count", (F.col("type") == "Method").alias("relation"))), """
 SELECT project_context AS pack, (120 + 20 * count(*) + 15 * count(*) FILTER (type = 'Method') + 16 * count(DISTINCT file_path) + 150 + sum(12 * least(coalesce(line_count, 20), 80)))::BIGINT AS tokens FROM n GROUP BY 1""")
_raw("ref_C26_snippets_in_budget", lambda s, d: C.snippets_in_budget(table(s, d, "documents").where("n_chars > 0").select((F.col("doc_id") / 50).cast("long").alias("pack"), (F.col("doc_id") % 50).alias("rank"), F.col("doc_id").cast("string").alias("id"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("lines"), F.length("text").alias("chars"))))
_add("ref_C6_caller_groups", order_graph, lambda n, e: C.caller_groups(n, e, "part:5"), f"""
, c AS (SELECT DISTINCT src AS id FROM e WHERE dst = 'part:5' AND type IN {sql_list(TRAVERSAL)} AND src <> 'part:5')
SELECT c.id, CASE WHEN {_TT} THEN 'test' WHEN type = 'Method' THEN 'method' WHEN type IN ('Class', 'Struct', 'Interface') THEN 'class' ELSE 'context' END AS "group" FROM c JOIN n ON n.id = c.id""")
_raw("ref_C13_stale_knowledge", lambda s, d: (lambda n, e, k: C.stale_knowledge(k, n, e, K.symbol_mentions(k, n)))(*ingest_graph(s, d), documents(s, d)), f"WITH {INGEST_GRAPH_SQL}, {DOCS_SQL}" + r""",
x AS (SELECT DISTINCT id, unnest(regexp_extract_all(regexp_replace(content, '(?s)```.*?```', ' ', 'g'), '`([A-Z][A-Za-z0-9]*(?:[A-Z][A-Za-z0-9]*|\.[A-Za-z][A-Za-z0-9]*)+)`', 1)) AS symbol FROM kd)
SELECT 'older-than-code' AS signal, id FROM kd WHERE updated_at < (SELECT max(updated_at)::DATE - 180 FROM gn)
UNION ALL SELECT DISTINCT 'unresolved-mention', id FROM x WHERE split_part(symbol, '.', -1) NOT IN (SELECT name FROM gn WHERE name IS NOT NULL)
UNION ALL SELECT 'orphan-concept', id FROM gn WHERE type = 'ExternalConcept' AND id NOT IN (SELECT dst FROM ge)
UNION ALL SELECT 'unreferenced-code', id FROM (SELECT id FROM gn WHERE type IN ('Method', 'Class') AND id NOT IN (SELECT dst FROM ge WHERE type IN """ + sql_list([*STRUCTURAL, "Contains"]) + """) ORDER BY type, name, id LIMIT 25)""")
_add("ref_C16_exact_symbol", ingest_graph, lambda n, e: C.exact_symbol(n, "resolve", "Method", ".cs", 80), f"""
 SELECT id, ((CASE WHEN lower(name) = 'resolve' THEN 10 WHEN ends_with(lower(id), 'resolve') THEN 8 WHEN contains(lower(name), 'resolve') THEN 4 ELSE 0 END) + CASE WHEN type = 'Method' THEN 5 ELSE 0 END + CASE WHEN ends_with(lower(file_path), '.cs') THEN 6 ELSE 0 END + CASE WHEN abs(line_number - 80) <= 5 THEN 3 ELSE 0 END + CASE WHEN {_FRESH} = 'High' THEN 1 ELSE 0 END)::INT AS score
FROM gn WHERE contains(lower(name), 'resolve') OR contains(lower(id), 'resolve') ORDER BY score DESC, id LIMIT 5""")


def _feedback(n):
    return n.where("file_path is not null").groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("accepted"), F.min("line_number").alias("ignored")).where("accepted > 10").withColumn("ignored", F.lit(2))


_add("ref_C14_C21_surface", ingest_graph, lambda n, e: C.implementation_surface(n, ["route", "index"], _feedback(n)), """
, sc AS (SELECT file_path, 4 * contains(lower(coalesce(name, '')), 'route')::INT + 2 * contains(lower(coalesce(summary, '')), 'route')::INT + 4 * contains(lower(coalesce(name, '')), 'index')::INT + 2 * contains(lower(coalesce(summary, '')), 'index')::INT AS b, file_role FROM gn WHERE file_path IS NOT NULL),
f AS (SELECT file_path, sum(b + (file_role IN ('Source', 'Unknown'))::INT) AS s, count(*) AS nodes FROM sc WHERE b > 0 GROUP BY 1), fb AS (SELECT file_path, 4 * count(*) - 6 AS plus FROM gn WHERE file_path IS NOT NULL GROUP BY 1 HAVING count(*) > 10),
t AS (SELECT f.file_path, (s + coalesce(plus, 0))::BIGINT AS score, nodes FROM f LEFT JOIN fb ON fb.file_path = f.file_path ORDER BY score DESC, f.file_path LIMIT 17)
SELECT file_path, score, nodes, CASE WHEN score >= 12 THEN 'High' WHEN score >= 6 THEN 'Medium' ELSE 'Low' END AS confidence, row_number() OVER (ORDER BY score DESC, file_path) <= 5 AS is_primary FROM t""")
_add("ref_C18_replace_surface", ingest_graph, lambda n, e: C.replace_surface(n, e, "tern-log"), f"""
, m AS (SELECT id AS src, coalesce(array_to_string(string_split(namespace, '.')[1:2], '.'), '(none)') AS module FROM gn)
SELECT module, count(DISTINCT ge.src) AS nodes, count(*) AS edges FROM ge JOIN m ON m.src = ge.src WHERE ge.type IN {sql_list(STRUCTURAL)} AND dst IN (SELECT id FROM gn WHERE contains(lower(name), 'tern-log') OR contains(lower(id), 'tern-log')) GROUP BY 1""")
_CHG = "id in ('part:5', 'part:9', 'order:100')"
_add("ref_C19_changed_subgraph", order_graph, lambda n, e: C.changed_subgraph(n, e, n.where(_CHG), 2), f"""
, st AS (SELECT DISTINCT dst AS a, src AS b FROM e WHERE type IN {sql_list(TRAVERSAL)}), bfs AS (SELECT id AS root, id, 0 AS dist FROM n WHERE {_CHG} UNION SELECT root, b, dist + 1 FROM bfs JOIN st ON a = id WHERE dist < 2)
SELECT id, min(dist)::INT AS dist, count(DISTINCT root) AS seeds FROM bfs WHERE id NOT IN (SELECT id FROM n WHERE {_CHG}) GROUP BY id""")
_add("ref_C19_node_risk", order_graph, lambda n, e: C.node_risk(n.withColumn("line_number", F.lit(None).cast("int")), e, n.where("id like 'part:1%'")), f"""
, {_VIOL}, fn AS (SELECT dst AS id, count(*) AS fan FROM e WHERE type IN {sql_list(STRUCTURAL)} GROUP BY 1), cv AS (SELECT DISTINCT dst AS id FROM e WHERE type = 'Calls' AND src IN (SELECT id FROM n WHERE {_TT})),
p AS (SELECT n.id, (CASE WHEN fan >= 8 THEN 4 WHEN fan >= 3 THEN 2 WHEN fan > 0 THEN 1 ELSE 0 END + CASE WHEN cv.id IS NULL THEN 2 ELSE 0 END + CASE WHEN change_count >= 5 THEN 2 WHEN change_count >= 3 THEN 1 ELSE 0 END
 + 3 * (n.id IN (SELECT src FROM viol WHERE violation IS NOT NULL))::INT + (updated_at IS NULL OR (coalesce(trim(file_path), '') = '' AND type IN {sql_list(NEEDS_PATH)}))::INT)::INT AS points FROM n LEFT JOIN fn ON fn.id = n.id LEFT JOIN cv ON cv.id = n.id WHERE n.id LIKE 'part:1%')
SELECT *, CASE WHEN points >= 8 THEN 'High' WHEN points >= 4 THEN 'Medium' ELSE 'Low' END AS risk FROM p""")
_add("ref_C20_pull_request", order_graph, lambda n, e: C.pull_request_report(n, e, n.where(_CHG)), f"""
, cn AS (SELECT id FROM n WHERE {_CHG})
SELECT 'changed' AS section, id FROM cn UNION ALL SELECT DISTINCT 'affected', src FROM e WHERE type IN {sql_list(TRAVERSAL)} AND dst IN (SELECT id FROM cn) AND src NOT IN (SELECT id FROM cn)
UNION ALL SELECT 'untested', id FROM ({_ST['ref_J2_coverage_gaps']}) WHERE id IN (SELECT id FROM cn) UNION ALL SELECT 'hotspot', id FROM ({_ST['ref_R1_hotspots']}) WHERE id IN (SELECT id FROM cn)""")
_add("ref_C25_file_reasons", order_graph, lambda n, e: C.file_reasons(n, editing_context(n, e, "customer:8")), f""", c9 AS ({_TV['ref_G9_editing_context']})
SELECT file_path, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles, count(DISTINCT c9.id) AS nodes FROM c9 JOIN n ON n.id = c9.id WHERE file_path IS NOT NULL GROUP BY 1""")


def _owner(n, e):
    r = e.where("type = 'Contains'").join(n.where("type = 'Class'").select(F.col("id").alias("src")), "src", "left_semi").groupBy("src").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "src").first()
    return r["src"] if r else ""


_raw("ref_R19_shared_evidence", lambda s, d: C.shared_evidence(table(s, d, "lineitem").select(F.col("l_returnflag").alias("group"), F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("evidence"))), """
WITH i AS (SELECT DISTINCT l_returnflag AS g, l_orderkey AS id, l_suppkey AS ev FROM lineitem), c AS (SELECT g, count(DISTINCT id) AS n FROM i GROUP BY 1),
h AS (SELECT g, count(*) AS hit FROM (SELECT DISTINCT a.g, a.id, b.id AS other FROM i a JOIN i b ON a.g = b.g AND a.ev = b.ev AND a.id < b.id) GROUP BY 1)
SELECT c.g AS "group", (n * (n - 1) / 2)::BIGINT AS pairs, round(coalesce(hit, 0) / (n * (n - 1) / 2)::DOUBLE, 6) AS share FROM c LEFT JOIN h ON h.g = c.g""")


# Resolution: orders call parts by name, at most three candidates of a brand and size
def _calls(s, d):
    p = table(s, d, "part")
    m = p.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.concat_ws("-", "p_type", "p_size").alias("name"), (F.col("p_size") % 3).alias("required"), (F.col("p_size") % 3 + 1).alias("total"), (F.col("p_partkey") % 11 == 0).alias("variadic"),
                 F.col("p_brand").alias("owner"), F.concat("p_brand", F.lit("/"), (F.col("p_partkey") % 3).cast("string")).alias("file"), F.concat("p_type", (F.col("p_partkey") % 40).cast("string")).alias("namespace"))
    c = table(s, d, "supplier").crossJoin(s.range(40).withColumnRenamed("id", "k"))  # 40 calls per supplier
    k = F.col("s_suppkey") * 40 + F.col("k")
    c = c.select(k.alias("call_id"), F.concat_ws("-", F.element_at(F.array(*[F.lit(x) for x in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "NONE")]), (k % 6 + 1).cast("int")), ((k * 13) % 50 + 1).cast("string")).alias("name"), (k % 4).cast("int").alias("args"),
                 F.concat(F.lit("Brand#"), (k % 25 + 1).cast("string")).alias("src_type"), F.concat(F.lit("Brand#"), (k % 25 + 1).cast("string"), F.lit("/"), (k % 3).cast("string")).alias("src_file"), F.concat(F.lit("LARGE"), (k % 40).cast("string")).alias("src_namespace"),
                 F.when(k % 5 == 0, F.concat(F.lit("Brand#"), (k % 7 + 1).cast("string"))).alias("receiver"), F.element_at(F.array(F.lit("Typed"), F.lit("This"), F.lit("Unqualified"), F.lit("Chained")), (k % 4 + 1).cast("int")).alias("kind"))
    return c, m


_CALLS = """m AS (SELECT 'part:' || p_partkey AS id, p_type || '-' || p_size AS name, p_size % 3 AS required, p_size % 3 + 1 AS total, p_partkey % 11 = 0 AS var_, p_brand AS owner, p_brand || '/' || p_partkey % 3 AS file, p_type || p_partkey % 40 AS namespace FROM part),
k AS (SELECT s_suppkey * 40 + r AS k FROM supplier, (SELECT unnest(range(40)) AS r)),
c AS (SELECT k AS call_id, ['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'NONE'][k % 6 + 1] || '-' || (k * 13 % 50 + 1) AS name, k % 4 AS args, 'Brand#' || (k % 25 + 1) AS src_type, 'Brand#' || (k % 25 + 1) || '/' || k % 3 AS src_file, 'LARGE' || k % 40 AS src_namespace, CASE WHEN k % 5 = 0 THEN 'Brand#' || (k % 7 + 1) END AS receiver, ['Typed', 'This', 'Unqualified', 'Chained'][k % 4 + 1] AS kind FROM k),
j AS (SELECT c.*, m.id, coalesce(required <= args AND (var_ OR args <= total), false) AS ok, coalesce(owner = receiver, false) AS t1, coalesce(kind IN ('This', 'Unqualified') AND owner = src_type, false) AS t2, coalesce(file = src_file, false) AS t4, coalesce(namespace = src_namespace, false) AS t5 FROM c LEFT JOIN m ON m.name = c.name),
g AS (SELECT call_id, any_value(kind) AS kind, count(id) AS named, count(*) FILTER (ok) AS fit, count(*) FILTER (ok AND t1) AS n1, max(id) FILTER (ok AND t1) AS i1, count(*) FILTER (ok AND t2) AS n2, max(id) FILTER (ok AND t2) AS i2, count(*) FILTER (ok) AS n3, max(id) FILTER (ok) AS i3, count(*) FILTER (ok AND t4) AS n4, max(id) FILTER (ok AND t4) AS i4, count(*) FILTER (ok AND t5) AS n5, max(id) FILTER (ok AND t5) AS i5 FROM j GROUP BY call_id),
t AS (SELECT *, CASE WHEN kind = 'Chained' THEN NULL WHEN n1 = 1 THEN 'receiver' WHEN kind = 'Typed' THEN NULL WHEN n2 = 1 THEN 'own' WHEN n3 = 1 THEN 'sole' WHEN n4 = 1 THEN 'file' WHEN n5 = 1 THEN 'namespace' END AS tier FROM g),
res AS (SELECT call_id, CASE tier WHEN 'receiver' THEN i1 WHEN 'own' THEN i2 WHEN 'sole' THEN i3 WHEN 'file' THEN i4 WHEN 'namespace' THEN i5 END AS target, tier, CASE WHEN tier IS NOT NULL THEN 'resolved' WHEN named = 0 THEN 'external' WHEN fit = 0 THEN 'unresolved' ELSE 'indeterminate' END AS disposition FROM t)"""
_raw("ref_J13_resolve_calls", lambda s, d: X.resolve_calls(*_calls(s, d)), f"WITH {_CALLS} SELECT * FROM res")
_raw("ref_R17_accounting", lambda s, d: X.accounting(X.resolve_calls(*_calls(s, d)).select(F.col("call_id").alias("id"), "disposition", F.col("tier").alias("reason"))), f"""WITH {_CALLS}
SELECT disposition, tier AS reason, count(*) AS n, array_to_string(list_sort(list(call_id::VARCHAR) FILTER (k <= 3)), ',') AS samples FROM (SELECT *, row_number() OVER (PARTITION BY disposition, tier ORDER BY call_id) AS k FROM res) GROUP BY 1, 2""")


def _type_refs(s, d):
    n, e = ingest_graph(s, d)
    t = n.where("type in ('Class', 'Interface', 'Enum', 'Struct')").select("id", F.substring_index("name", ".", -1).alias("name"), "namespace", F.col("file_path").alias("file"))
    r = n.where("type = 'File'").select(F.col("id").alias("ref_id"), F.lit(None).cast("string").alias("target_id"), F.regexp_extract("file_path", r"([A-Za-z0-9]+)\.\w+$", 1).alias("name"), F.lit(None).cast("string").alias("src_namespace"), F.col("file_path").alias("src_file"))
    return r, t


_raw("ref_J14_resolve_types", lambda s, d: X.resolve_types(*_type_refs(s, d)), f"WITH {INGEST_GRAPH_SQL}" + r""",
t AS (SELECT id, split_part(name, '.', -1) AS name, file_path AS file FROM gn WHERE type IN ('Class', 'Interface', 'Enum', 'Struct')), r AS (SELECT id AS ref_id, regexp_extract(file_path, '([A-Za-z0-9]+)\.\w+$', 1) AS name, file_path AS src_file FROM gn WHERE type = 'File'),
g AS (SELECT ref_id, count(t.id) AS n, max(t.id) AS i, count(*) FILTER (t.file = src_file) AS nf, max(t.id) FILTER (t.file = src_file) AS f FROM r LEFT JOIN t ON t.name = r.name GROUP BY ref_id)
SELECT ref_id, CASE WHEN n = 1 THEN i WHEN nf = 1 THEN f END AS target, CASE WHEN n = 1 OR nf = 1 THEN 'resolved' WHEN n = 0 THEN 'external' ELSE 'indeterminate' END AS disposition FROM g""")


def _runs(s, d):
    o = table(s, d, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("run_id"), F.when(k % 2 == 0, "csharp").otherwise("typescript").alias("language"), F.concat(F.lit("s"), (k % 6).cast("string")).alias("scope"), F.col("o_orderdate").alias("completed_at"), (k % 97 == 0).alias("partial"), (k % 2 + 1).alias("schema_version"),
                    F.when(k % 3 == 0, "full").otherwise("incremental").alias("mode"), (k % 500).alias("scanned"), (k % 60).alias("ingested"), (k % 90).alias("resolved"), F.lit(0).alias("unresolved"), (k % 5).alias("indeterminate"), (k % 7).alias("external"), F.lit(0).alias("legacy"),
                    F.concat(F.lit('{"arity":'), (k % 4).cast("string"), F.lit(',"r'), (k % 5).cast("string"), F.lit('":2}')).alias("reasons"))


_RUNS = """rn AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'csharp' ELSE 'typescript' END AS language, 's' || o_orderkey % 6 AS scope, o_orderdate AS at_, o_orderkey % 97 = 0 AS partial, CASE WHEN o_orderkey % 3 = 0 THEN 'full' ELSE 'incremental' END AS mode, o_orderkey % 500 AS scanned, o_orderkey % 60 AS ingested, o_orderkey % 90 AS resolved, o_orderkey % 5 AS indeterminate, o_orderkey % 7 AS external FROM orders)"""
_raw("ref_R7_relationship_trust", lambda s, d: X.relationship_trust(_runs(s, d)), f"""WITH {_RUNS},
fl AS (SELECT language, scope, arg_max(resolved, {{'a': at_, 'k': k}}) AS fr FROM rn WHERE mode = 'full' GROUP BY 1, 2), la AS (SELECT * FROM rn QUALIFY row_number() OVER (PARTITION BY language, scope ORDER BY at_ DESC, k DESC) = 1),
t AS (SELECT count(*) AS runs, bool_or(partial OR coalesce(mode = 'incremental' AND ingested * 10 <= scanned AND resolved * 2 < fr, false)) AS low, sum(resolved)::BIGINT AS resolved, sum(indeterminate)::BIGINT AS indeterminate, sum(external)::BIGINT AS external FROM la LEFT JOIN fl USING (language, scope))
SELECT CASE WHEN low THEN 'Low' WHEN indeterminate > 0 THEN 'Medium' ELSE 'High' END AS confidence, runs, resolved, 0::BIGINT AS unresolved, indeterminate, external FROM t""")
_raw("ref_R7_reason_counts", lambda s, d: X.reason_counts(_runs(s, d)), """WITH x AS (SELECT 'arity' AS reason, o_orderkey % 4 AS n FROM orders UNION ALL SELECT 'r' || o_orderkey % 5, 2 FROM orders), g AS (SELECT reason, sum(n)::BIGINT AS n FROM x GROUP BY 1)
SELECT reason, n, round(100.0 * n / (SELECT sum(n) FROM g)::DOUBLE, 1) AS percent FROM g ORDER BY n DESC, reason LIMIT 3""")


def _sessions(s, d):
    e = table(s, d, "events")
    kind = F.when(F.col("event_type") == "view", "suggestion").when(F.col("event_type") == "purchase", "test").when(F.col("event_type") == "error", "stale").otherwise("other")
    ev = e.select(F.col("user_id").alias("session"), kind.alias("kind"), F.concat(F.lit("tool"), (F.col("event_id") % 4).cast("string")).alias("tool"), F.array(F.concat(F.lit("f"), (F.col("event_id") % 9).cast("string"))).alias("files"))
    ch = e.select("user_id").distinct().select(F.col("user_id").alias("session"), F.array(F.concat(F.lit("f"), (F.col("user_id") % 9).cast("string")), F.lit("f1")).alias("files"))
    return ev, ch


_SESS = """ev AS (SELECT user_id AS session, CASE event_type WHEN 'view' THEN 'suggestion' WHEN 'purchase' THEN 'test' WHEN 'error' THEN 'stale' ELSE 'other' END AS kind, 'tool' || event_id % 4 AS tool, 'f' || event_id % 9 AS f, 'f' || event_id % 9 IN ('f' || user_id % 9, 'f1') AS hit FROM events)"""
_raw("ref_S7_R14_session_usefulness", lambda s, d: X.session_usefulness(*_sessions(s, d)), f"""WITH {_SESS}, g AS (SELECT session, count(*) FILTER (kind = 'suggestion') AS suggestions, count(*) FILTER (kind = 'suggestion' AND hit) AS accepted, count(*) FILTER (kind = 'test') AS tests, count(*) FILTER (kind = 'stale') AS stale FROM ev GROUP BY session)
SELECT *, CASE WHEN suggestions = 0 THEN 'unknown' WHEN accepted * 2 >= suggestions AND tests > 0 THEN 'high' WHEN accepted > 0 THEN 'partial' ELSE 'low' END AS rating FROM g""")
_raw("ref_R15_tool_precision", lambda s, d: X.tool_precision(*_sessions(s, d)), f"WITH {_SESS}, u AS (SELECT DISTINCT session, tool, f, hit FROM ev WHERE kind = 'suggestion') SELECT tool, count(*) FILTER (hit) AS accepted, count(*) FILTER (NOT hit) AS ignored FROM u GROUP BY tool")


# Styles: parts as declarations
def _styles(s, d):
    p = table(s, d, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("id"), F.concat("p_brand", (k % 5).cast("string")).alias("file_path"), F.lower("p_type").alias("property"), F.lit("CssClass").alias("target_kind"), F.concat(F.lit("c"), (k % 4).cast("string")).alias("target"), (k % 40).cast("int").alias("source_order"), k.alias("line"),
        F.struct(F.lit(0).alias("a"), (k % 3 + 1).cast("int").alias("b"), (k % 2).cast("int").alias("c")).alias("spec"), F.when(k % 3 == 0, F.concat(F.lit(".c"), (k % 4).cast("string"))).otherwise(F.lit("div .x")).alias("selector"), F.concat("p_size", F.lit("px")).alias("value"),
    )


_STY = """d AS (SELECT p_partkey AS id, p_brand || p_partkey % 5 AS file_path, lower(p_type) AS property, 'CssClass' AS target_kind, 'c' || p_partkey % 4 AS target, p_partkey % 40 AS so, p_partkey AS line, (0, p_partkey % 3 + 1, p_partkey % 2) AS spec, CASE WHEN p_partkey % 3 = 0 THEN '.c' || p_partkey % 4 ELSE 'div .x' END AS selector FROM part)"""
_raw("ref_J15_cascade_conflicts", lambda s, d: W.cascade_conflicts(_styles(s, d)), f"WITH {_STY} SELECT file_path, property, target_kind, target, w.id AS winner, l.id AS loser, CASE WHEN w.spec > l.spec THEN 'specificity' ELSE 'order' END AS reason FROM d w JOIN d l USING (file_path, property, target_kind, target) WHERE (w.spec, w.so, w.line) > (l.spec, l.so, l.line)")
_raw("ref_J16_specificity_warnings", lambda s, d: W.specificity_warnings(_styles(s, d)), f"WITH {_STY} SELECT file_path, property, target_kind, target, c.id AS stronger, s.id AS simple FROM d s JOIN d c USING (file_path, property, target_kind, target) WHERE s.selector = '.' || target AND c.spec > s.spec AND abs(c.so - s.so) <= 6 AND c.id <> s.id")
_raw("ref_R13_near_duplicate_styles", lambda s, d: W.near_duplicate_styles(_styles(s, d)), """WITH RECURSIVE v AS (SELECT p_partkey AS id, lower(p_type) AS property, p_size::DOUBLE AS number FROM part),
x AS (SELECT property, number, row_number() OVER (PARTITION BY property ORDER BY number) AS k FROM (SELECT DISTINCT property, number FROM v)),
w AS (SELECT property, number, k, number AS leader FROM x WHERE k = 1 UNION ALL SELECT x.property, x.number, x.k, CASE WHEN x.number - w.leader <= greatest(2.0, 0.08 * abs(w.leader)) THEN w.leader ELSE x.number END FROM w JOIN x ON x.property = w.property AND x.k = w.k + 1)
SELECT v.property, 'px' AS unit, leader, v.number, id FROM v JOIN w ON w.property = v.property AND w.number = v.number""")
_raw("ref_S15_table_accesses", lambda s, d: X.table_accesses(table(s, d, "nodes").where("source_snippet is not null").select(F.col("ingest_no").alias("id"), F.col("source_snippet").alias("text"))), r"""
WITH x AS (SELECT ingest_no AS id, unnest(regexp_extract_all(source_snippet, '(?i)\b((?:select\b[^;"]*?\bfrom|insert\s+into|update|delete\s+from)\s+[A-Za-z_][A-Za-z0-9_.]*)', 1)) AS s FROM nodes)
SELECT DISTINCT id, CASE WHEN regexp_matches(s, '(?i)^select') THEN 'Read' ELSE 'Write' END AS operation, regexp_extract(s, '([A-Za-z_][A-Za-z0-9_.]*)$', 1) AS table_name FROM x""")

# Status, packs, routes and patterns
_raw("ref_R10_doctor_status", lambda s, d: (lambda n, e: C.doctor_status(n, e, documents(s, d), table(s, d, "nodes").where("embedding_csv is not null and id is not null").select("id")))(*ingest_graph(s, d)), f"WITH {INGEST_GRAPH_SQL}, {DOCS_SQL}" + """
SELECT (SELECT count(*) FROM gn) AS nodes, (SELECT count(*) FROM gn WHERE type = 'Diagnostic') AS diagnostics, (SELECT count(*) FROM ge WHERE type = 'Calls') AS call_edges, (SELECT count(*) FROM kd) AS documents, (SELECT count(*) FROM gn WHERE id IN (SELECT id FROM nodes WHERE embedding_csv IS NOT NULL)) AS embedded""")
_raw("ref_C24_with_trust", lambda s, d: C.with_trust(St.hotspots(*order_graph(s, d)).select("id", "fan_in"), X.relationship_trust(_runs(s, d))),
     f"WITH h AS ({_ST['ref_R1_hotspots']}), t AS ({SQL['ref_R7_relationship_trust']}) SELECT id, fan_in, CASE WHEN confidence <> 'High' THEN 'relationship evidence is ' || lower(confidence) END AS warning FROM h, t")
_J3_PART = _J3.format(n="n", e="e").replace("(SELECT min(dst) FROM e ee WHERE ee.type = 'Calls' AND src IN (SELECT id FROM n WHERE file_role = 'Test'))", "'part:5'")
_add("ref_C4_context_pack", order_graph, lambda n, e: C.context_pack(n, e, "part:5", 2), f"""{_J3_PART},
c9 AS ({_TV['ref_G9_editing_context'].replace('customer:8', 'part:5')}), im AS (WITH RECURSIVE {_impact('n', 'e', 'part:5', 'Class', 2)}), dn AS (WITH RECURSIVE {_down('n', 'e', 'part:5', 2)})
SELECT 'target' AS part, id FROM n WHERE id = 'part:5' UNION ALL SELECT role, id FROM c9 UNION ALL SELECT 'affected', id FROM im UNION ALL SELECT 'needed', id FROM dn UNION ALL SELECT 'test', id FROM rt""")
_add("ref_C15_edit_route", ingest_graph, lambda n, e: C.edit_route(n, e, ["route", "index"]), f""",
su AS ({SQL['ref_C14_C21_surface'].replace('HAVING count(*) > 10', 'HAVING false')}), bt AS (SELECT file_path FROM su ORDER BY score DESC, file_path LIMIT 1), mi AS (SELECT id FROM gn WHERE file_path = (SELECT file_path FROM bt)),
li AS (SELECT DISTINCT file_path FROM gn WHERE id IN (SELECT dst FROM ge WHERE type IN {sql_list(TRAVERSAL)} AND src IN (SELECT id FROM mi) UNION SELECT src FROM ge WHERE type IN {sql_list(TRAVERSAL)} AND dst IN (SELECT id FROM mi)) AND file_path IS NOT NULL)
SELECT file_path, score, CASE WHEN file_path = (SELECT file_path FROM bt) THEN 'anchor' WHEN file_path IN (SELECT file_path FROM li) THEN 'companion' ELSE 'context' END AS role FROM su""")
_raw("ref_C22_tool_dependencies", lambda s, d: C.tool_dependencies(s, "impact"), "SELECT 'impact' AS producer, unnest(['test_shield', 'impact_confidence']) AS consumer")

# Settings: event properties as JSON files; a graph of configuration from parts and suppliers
_raw("ref_S8_S9_settings", lambda s, d: Se.settings(table(s, d, "events").select(F.concat(F.lit("e"), "event_id", F.lit(".json")).alias("path"), F.col("props").alias("content"))), """
SELECT 'e' || event_id || '.json' AS path, 'k' AS raw_key, 'k' AS key, left(json_extract_string(props, '$.k'), 80) AS preview FROM events""")


def _config(s, d):
    p, sup = table(s, d, "part"), table(s, d, "supplier")
    key = F.concat_ws(":", F.lower("p_type"), F.concat(F.lit("s"), (F.col("p_size") % 5).cast("string")))
    n = (
        p.select(F.concat(F.lit("file:"), "p_brand").alias("id"), F.col("p_brand").alias("name"), F.lit("ConfigurationFile").alias("type"), F.concat("p_brand", F.lit(".json")).alias("file_path")).distinct()
        .unionByName(p.select(F.concat(F.lit("entry:"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("ConfigurationEntry").alias("type"), F.lit(None).cast("string").alias("file_path")))
        .unionByName(p.select(F.concat(F.lit("key:"), key).alias("id"), key.alias("name"), F.lit("ConfigurationKey").alias("type"), F.lit(None).cast("string").alias("file_path")).distinct())
        .unionByName(p.select(F.concat(F.lit("key:"), F.lower("p_type")).alias("id"), F.lower("p_type").alias("name"), F.lit("ConfigurationKey").alias("type"), F.lit(None).cast("string").alias("file_path")).distinct())
        .unionByName(sup.select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("Class").alias("type"), F.concat(F.lit("src/"), "s_name").alias("file_path")))
    ).withColumn("line_number", F.lit(1))
    k = F.col("s_suppkey")
    leaf = F.concat(F.lit("key:"), F.element_at(F.array(*[F.lit(x) for x in ("economy", "promo", "small")]), (k % 3 + 1).cast("int")), F.lit(":s"), (k % 5).cast("string"))
    sect = F.concat(F.lit("key:"), F.element_at(F.array(*[F.lit(x) for x in ("economy", "promo", "small")]), (k % 3 + 1).cast("int")))
    e = (
        p.select(F.concat(F.lit("file:"), "p_brand").alias("src"), F.concat(F.lit("entry:"), "p_partkey").alias("dst"), F.lit("DefinesConfig").alias("type"), F.lit(1.0).alias("confidence"))
        .unionByName(p.select(F.concat(F.lit("entry:"), "p_partkey").alias("src"), F.concat(F.lit("key:"), key).alias("dst"), F.when(F.col("p_partkey") % 2 == 0, "DefinesConfig").otherwise("OverridesConfig").alias("type"), F.lit(1.0).alias("confidence")))
        .unionByName(sup.select(F.concat(F.lit("supplier:"), k).alias("src"), leaf.alias("dst"), F.lit("ReadsConfig").alias("type"), ((k % 10) / 10.0).alias("confidence")))
        .unionByName(sup.select(F.concat(F.lit("supplier:"), k).alias("src"), sect.alias("dst"), F.lit("BindsConfig").alias("type"), F.when(k % 4 > 0, (k % 10) / 10.0).alias("confidence")))
    )
    return n, e


_CFG = """p AS (SELECT *, lower(p_type) || ':s' || p_size % 5 AS key FROM part), su AS (SELECT *, ['economy', 'promo', 'small'][s_suppkey % 3 + 1] AS sec FROM supplier)"""
_raw("ref_J4_config_definitions", lambda s, d: Se.definitions(*_config(s, d), "Promo:S1"), f"""WITH {_CFG}
SELECT 'file:' || p_brand AS file, 'entry:' || p_partkey AS entry, 'key:' || key AS key, CASE WHEN p_partkey % 2 = 0 THEN 'DefinesConfig' ELSE 'OverridesConfig' END AS relation FROM p WHERE key = 'promo:s1' ORDER BY p_brand || '.json', p_name, 'entry:' || p_partkey LIMIT 100""")
_raw("ref_J5_config_usages", lambda s, d: Se.usages(*_config(s, d), "promo:s1"), f"""WITH {_CFG},
u AS (SELECT 'supplier:' || s_suppkey AS src, 'key:' || sec || ':s' || s_suppkey % 5 AS dst, 'ReadsConfig' AS type, s_suppkey % 10 / 10.0 AS raw, s_suppkey % 10 / 10.0 AS confidence, s_name FROM su WHERE sec = 'promo' AND s_suppkey % 5 = 1
 UNION ALL SELECT 'supplier:' || s_suppkey, 'key:' || sec, 'BindsConfig', CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 10 / 10.0 END, least(coalesce(CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 10 / 10.0 END, 0.75), 0.75), s_name FROM su WHERE sec = 'promo')
SELECT src, dst, type, confidence::DOUBLE AS confidence FROM u ORDER BY coalesce(raw, 0) DESC, 'src/' || s_name, s_name, src LIMIT 100""")
_raw("ref_S13_class_attributes", lambda s, d: W.class_attributes(table(s, d, "customer").select(F.col("c_custkey").alias("page"), F.concat(F.lit('<div class="card '), F.lower("c_mktsegment"), F.lit('" id="c'), "c_custkey", F.lit('"><link rel="x" href="a.css">')).alias("html"))), """
SELECT c_custkey AS page, unnest(['class', 'class', 'id', 'stylesheet']) AS kind, unnest(['card', lower(c_mktsegment), 'c' || c_custkey, 'a.css']) AS name FROM customer""")
_raw("ref_S16_diagnostics", lambda s, d: X.parse_diagnostics(table(s, d, "nodes").where("lower(type) = 'diagnostic' and file_path is not null and line_number is not null").select(F.col("ingest_no").alias("output_id"), F.lit(1).alias("n"), F.concat("file_path", F.lit("("), "line_number", F.lit(",1): error TS2304: Cannot find "), "name").alias("text"))), """
SELECT 'tsc' AS tool, file_path AS file, line_number AS line, 'error' AS severity, 'TS2304' AS code, 'Cannot find ' || name AS message FROM nodes WHERE lower(type) = 'diagnostic' AND file_path IS NOT NULL AND line_number IS NOT NULL""")


def _m7(s, d):
    """Documents re-sent in a second half: the mentions of the newest versions, dangling ones repaired."""
    n, _ = ingest_graph(s, d)
    return K.mentions(documents(s, d), n).groupBy("type").agg(F.count("*").alias("links"), F.count_distinct("id").alias("documents"))


_raw("ref_M7_document_links", _m7, f"WITH {INGEST_GRAPH_SQL}, {DOCS_SQL}" + """, a AS (SELECT DISTINCT id, trim(unnest(regexp_split_to_array(related_node_ids_csv, '[,;|\\r\\n]'))) AS target FROM kd), b AS (SELECT DISTINCT id, trim(unnest(regexp_split_to_array(related_document_ids_csv, '[,;|\\r\\n]'))) AS key FROM kd),
l AS (SELECT DISTINCT id, 'Mentions' AS type, target FROM a WHERE target IN (SELECT id FROM gn) UNION ALL SELECT DISTINCT b.id, 'References', t.id FROM b JOIN kd t ON t.id = b.key OR t.source = b.key WHERE b.key <> '') SELECT type, count(*) AS links, count(DISTINCT id) AS documents FROM l GROUP BY 1""")
_raw("ref_M6_save_classes", lambda s, d: M.save_classes(*(lambda k: (k.withColumn("classification", F.lit("Unknown")), k.where("keyword < 'm'")))(K.keyword_statistics(K.extract_keywords(K.keyword_sources(ingest_graph(s, d)[0], documents(s, d)))).select("keyword", F.lit("DomainConcept").alias("classification")))),
     f"WITH {INGEST_GRAPH_SQL}, {DOCS_SQL}, {_HAS} SELECT DISTINCT keyword, CASE WHEN keyword < 'm' THEN 'DomainConcept' ELSE 'Unknown' END AS classification FROM hk")
