"""Queries of the relational operators, over the order graph or the ingest graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import NEEDS_HASH, NEEDS_LINE, NEEDS_PATH, PROFILES, effective_role_sql, layer_sql, path_role_sql
from ..operators import structural as S
from ..operators.model import COARSE, COVERING, FORBIDDEN, LAYERS, STRUCTURAL, TRAVERSAL, WORKFLOW, sql_list
from ..sources.projection import INGEST_GRAPH_SQL, ORDER_GRAPH_SQL, ingest_graph, order_graph
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, graph, run, sql: str | None, with_sql: str | None = None):
    QUERIES[name] = lambda spark, d: run(*graph(spark, d))
    if sql:
        SQL[name] = f"WITH {ORDER_GRAPH_SQL if graph is order_graph else INGEST_GRAPH_SQL}{with_sql or ''} {sql}"


PROJECT = "TidalLedger"
_FRESH = f"""CASE WHEN updated_at IS NULL OR (type IN {sql_list(NEEDS_PATH)} AND coalesce(trim(file_path), '') = '') THEN 'Low'
 WHEN (type IN {sql_list(NEEDS_LINE)} AND NOT (coalesce(line_number > 0, false) OR coalesce(line_count > 0, false))) OR (type IN {sql_list(NEEDS_HASH)} AND coalesce(trim(source_hash), '') = '') THEN 'Medium' ELSE 'High' END"""

QUERIES["ref_P1_graph_counts"] = lambda s, d: S.graph_counts(*ingest_graph(s, d), PROJECT, table(s, d, "nodes").where("embedding_csv is not null and id is not null").select("id"))
SQL["ref_P1_graph_counts"] = f"""WITH {INGEST_GRAPH_SQL}
SELECT (SELECT count(*) FROM gn WHERE lower(project_context) = 'tidalledger') AS nodes, (SELECT count(*) FROM gn WHERE lower(project_context) = 'tidalledger' AND type = 'Diagnostic') AS diagnostics,
 (SELECT count(*) FROM ge JOIN gn s ON s.id = src JOIN gn t ON t.id = dst WHERE ge.type = 'Calls' AND (lower(s.project_context) = 'tidalledger' OR lower(t.project_context) = 'tidalledger')) AS call_edges,
 (SELECT count(*) FROM gn WHERE lower(project_context) = 'tidalledger' AND id IN (SELECT id FROM nodes WHERE embedding_csv IS NOT NULL)) AS embedded"""
_add("ref_P2_project_contexts", ingest_graph, lambda n, e: S.project_contexts(n), "SELECT DISTINCT project_context FROM gn WHERE project_context IS NOT NULL ORDER BY 1 LIMIT 100")
_add("ref_P3_suggest_project", ingest_graph, lambda n, e: S.suggest_project(n, "tidal-ledgr"), """
, p AS (SELECT DISTINCT project_context, lower(regexp_replace(project_context, '[^\\p{L}\\p{Nd}]', '', 'g')) AS b FROM gn WHERE project_context IS NOT NULL),
s AS (SELECT project_context, CASE WHEN b = 'tidalledgr' THEN 0 WHEN contains(b, 'tidalledgr') OR contains('tidalledgr', b) THEN 1 WHEN levenshtein(b, 'tidalledgr') <= 2 THEN levenshtein(b, 'tidalledgr') + 2 END::INTEGER AS score FROM p WHERE b <> '')
SELECT project_context, score FROM s WHERE score IS NOT NULL""")
_add("ref_P4_unreferenced", order_graph, S.unreferenced, f"""
SELECT id, name, type FROM n WHERE type IN ('Method', 'Class') AND id NOT IN (SELECT dst FROM e WHERE type IN {sql_list([*STRUCTURAL, 'Contains'])}) ORDER BY type, name, id LIMIT 100""")
_add("ref_P5_large_nodes", order_graph, lambda n, e: S.large_nodes(n), """
SELECT id, type, line_count FROM n WHERE ((type = 'Class' AND line_count > 400) OR (type = 'Method' AND line_count > 40)) AND file_role IN ('Source', 'Unknown') ORDER BY line_count DESC, id LIMIT 50""")
_add("ref_P6_recently_changed", ingest_graph, lambda n, e: S.recently_changed(n, "2026-09-01 00:00:00"), f"""
SELECT id, coalesce(updated_at, created_at) AS changed_at, CASE WHEN created_at >= TIMESTAMP '2026-09-01' AND (updated_at IS NULL OR created_at = updated_at) THEN 'created' ELSE 'updated' END AS change_type
FROM gn WHERE type IN {sql_list(S.CHANGE_TYPES)} AND (created_at >= TIMESTAMP '2026-09-01' OR updated_at >= TIMESTAMP '2026-09-01') ORDER BY changed_at DESC, id LIMIT 50""")
_add("ref_P7_high_churn", order_graph, lambda n, e: S.high_churn(n), """
SELECT id, change_count, line_count FROM n WHERE change_count >= 3
ORDER BY (contains(lower(coalesce(namespace, '')), 'test') OR contains(lower(coalesce(file_path, '')), 'test'))::INT, (type = 'Namespace')::INT, change_count DESC, coalesce(line_count, 0) DESC, name, id LIMIT 50""")
_add("ref_P8_diagnostics", ingest_graph, lambda n, e: S.diagnostics(n, "re"), """
SELECT id, name, file_path, line_number FROM gn WHERE type = 'Diagnostic' AND starts_with(lower(name), 're') ORDER BY file_path NULLS LAST, line_number NULLS LAST, name, id LIMIT 200""")
_add("ref_P9_latest_update", ingest_graph, lambda n, e: S.latest_update(n, PROJECT), "SELECT max(updated_at) AS updated_at FROM gn WHERE lower(project_context) = 'tidalledger'")
_add("ref_P17_allowed_by_profile", ingest_graph, lambda n, e: S.allowed_by_profile(n, "TestShield").select("id"),
     f"SELECT id FROM gn WHERE {effective_role_sql('file_path', 'file_role')} IN {sql_list(PROFILES['TestShield'])}")
_add("ref_S14_P18_P19_roles_layers", ingest_graph, lambda n, e: S.roles_and_layers(n),
     f"SELECT id, {path_role_sql('file_path')} AS path_role, {effective_role_sql('file_path', 'file_role')} AS role, {layer_sql()} AS layer FROM gn")
_add("ref_P19_order_layers", order_graph, lambda n, e: S.roles_and_layers(n).select("id", "layer"), f"SELECT id, {layer_sql()} AS layer FROM n")
_add("ref_P20_freshness", ingest_graph, lambda n, e: n.select("id", S.freshness().alias("confidence")), f"SELECT id, {_FRESH} AS confidence FROM gn")
_ROLE = effective_role_sql("file_path", "file_role")
_add("ref_P21_actionability", ingest_graph, lambda n, e: S.actionability(n), f"""
, r AS (SELECT *, {_ROLE} AS role, contains(lower(concat_ws(' ', file_path, namespace, name)), 'test') AS hay FROM gn),
b AS (SELECT *, role = 'Test' OR (role = 'Unknown' AND hay) AS test, coalesce(line_count < 3, false) AS few,
  lower(name) IN {sql_list([x.lower() for x in S.PLUMBING])} OR ends_with(lower(name), 'options') OR ends_with(lower(name), 'endpoints') OR ends_with(lower(name), 'tools') AS plumb FROM r),
c AS (SELECT *, test OR role IN {sql_list(S.SUPPRESSED_ROLES)} OR coalesce(type IN {sql_list(S.SUPPRESSED_TYPES)}, false) AS sup, role IN ('Source', 'Unknown') AND coalesce(type IN {sql_list(S.PRODUCTION_TYPES)}, false) AS prod FROM b)
SELECT id, CASE WHEN sup THEN 'SuppressedNoise' WHEN prod THEN 'ProductionCandidate' ELSE 'BroaderHeuristicMatch' END AS bucket,
 CASE WHEN sup THEN 200 + 10 * test::INT + 5 * (file_path IS NULL)::INT WHEN prod THEN 10 * (file_path IS NULL)::INT + 10 * few::INT + 15 * plumb::INT
  ELSE 100 + 5 * coalesce(type IN {sql_list(S.BROAD_TYPES)}, false)::INT + 5 * (file_path IS NULL)::INT + 5 * few::INT END AS penalty FROM c""")
_add("ref_J1_cross_project", order_graph, S.cross_project, f"""
SELECT src, dst, e.type, s.project_context AS source_project, t.project_context AS target_project FROM e JOIN n s ON s.id = src JOIN n t ON t.id = dst
WHERE e.type IN {sql_list(STRUCTURAL)} AND lower(s.project_context) <> lower(t.project_context) ORDER BY 4, 5, 1, 2, 3 LIMIT 100""")
_TEST = "(coalesce(file_role = 'Test', false) OR contains(lower(coalesce(namespace, '')), 'test') OR contains(lower(coalesce(file_path, '')), 'test') OR contains(lower(coalesce(name, '')), 'test') OR contains(lower(coalesce(file_path, '')), '.spec.'))"
_MEMBERS = "mem AS (SELECT DISTINCT c.id AS owner, a.dst AS member FROM {n} c JOIN {e} a ON a.src = c.id AND a.type = 'Contains' WHERE c.type = 'Class' UNION SELECT c.id, b.dst FROM {n} c JOIN {e} a ON a.src = c.id AND a.type = 'Contains' JOIN {e} b ON b.src = a.dst AND b.type = 'Contains' WHERE c.type = 'Class')"


def _gaps(n, e):
    return f"""{_MEMBERS.format(n=n, e=e)},
hit AS (SELECT DISTINCT dst FROM {e} WHERE type IN ('Calls', 'Uses') AND src IN (SELECT id FROM {n} WHERE {_TEST})),
fan AS (SELECT dst AS id, count(DISTINCT src) AS fan_in FROM {e} WHERE type IN {sql_list(COVERING)} GROUP BY 1),
gap AS (SELECT p.id, type, coalesce(fan_in, 0)::BIGINT AS fan_in, line_count, name, file_path, change_count FROM {n} p LEFT JOIN fan ON fan.id = p.id
 WHERE type IN ('Class', 'Method') AND file_role IN ('Source', 'Unknown') AND p.id NOT IN (SELECT dst FROM hit) AND p.id NOT IN (SELECT owner FROM mem WHERE member IN (SELECT dst FROM hit))
 ORDER BY (contains(lower(coalesce(file_path, '')), '/program.cs') OR lower(name) IN ('dependencyinjection', 'neo4joptions', 'embeddingoptions') OR ends_with(lower(name), 'options') OR ends_with(lower(name), 'endpoints') OR ends_with(lower(name), 'tools'))::INT,
  coalesce(fan_in, 0) DESC, coalesce(line_count, 0) DESC, coalesce(change_count, 0) DESC, type, name, p.id LIMIT 100)"""


_add("ref_J2_coverage_gaps", order_graph, S.coverage_gaps, f", {_gaps('n', 'e')} SELECT id, type, fan_in, line_count FROM gap")
_add("ref_J2_coverage_gaps_ingest", ingest_graph, S.coverage_gaps, f", {_gaps('gn', 'ge')} SELECT id, type, fan_in, line_count FROM gap")
_add("ref_R1_hotspots", order_graph, S.hotspots, f"""
SELECT dst AS id, any_value(name) AS name, any_value(n.type) AS type, count(*) AS fan_in FROM e JOIN n ON n.id = dst WHERE e.type IN {sql_list(STRUCTURAL)} AND n.type IN ('Method', 'Class', 'Interface') GROUP BY dst ORDER BY fan_in DESC, id LIMIT 15""")
_add("ref_R1_hotspots_ingest", ingest_graph, lambda n, e: S.hotspots(n, e, PROJECT), f"""
SELECT dst AS id, any_value(name) AS name, any_value(gn.type) AS type, count(*) AS fan_in FROM ge JOIN gn ON gn.id = dst WHERE ge.type IN {sql_list(STRUCTURAL)} AND gn.type IN ('Method', 'Class', 'Interface') AND lower(project_context) = 'tidalledger' GROUP BY dst ORDER BY fan_in DESC, id LIMIT 15""")


def _god(n, e, lines, fan):
    return f""", {_MEMBERS.format(n=n, e=e)},
big AS (SELECT id, name, line_count FROM {n} WHERE type = 'Class' AND line_count > {lines} AND file_role IN ('Source', 'Unknown')),
c AS (SELECT dst AS id, src AS caller, CASE WHEN type IN ('DependsOn', 'Implements', 'Inherits') THEN 3 ELSE 1 END AS rank FROM {e} WHERE type IN {sql_list(TRAVERSAL)} AND src <> dst AND dst IN (SELECT id FROM big)
 UNION ALL SELECT owner, src, CASE WHEN type = 'DependsOn' THEN 3 ELSE 2 END FROM {e} JOIN mem ON member = dst WHERE type IN {sql_list(STRUCTURAL)} AND src <> owner AND src <> dst AND owner IN (SELECT id FROM big)),
k AS (SELECT c.id, caller, min(CASE WHEN x.type IN {sql_list(WORKFLOW)} THEN 4 ELSE rank END) AS rank FROM c JOIN {n} x ON x.id = caller GROUP BY 1, 2),
g AS (SELECT id, count(*) AS fan_in, count(*) FILTER (rank = 1) AS direct, count(*) FILTER (rank = 2) AS via_members, count(*) FILTER (rank = 3) AS dependency, count(*) FILTER (rank = 4) AS heuristic FROM k GROUP BY id HAVING count(*) > {fan})
SELECT g.id, line_count, fan_in, direct, via_members, dependency, heuristic, 4 * direct + 3 * via_members + 2 * dependency + heuristic AS quality FROM g JOIN big ON big.id = g.id ORDER BY quality DESC, line_count DESC, fan_in DESC, name, g.id LIMIT 20"""


_add("ref_R2_god_classes", order_graph, S.god_classes, _god("n", "e", 300, 3))
_add("ref_R2_god_classes_ingest", ingest_graph, lambda n, e: S.god_classes(n, e, 100, 2), _god("gn", "ge", 100, 2))
_BUSY = "ref_J6_diagnostics_near"


def _near(n, e):
    one = n.where("type = 'Diagnostic' and file_path is not null").agg(F.min("id").alias("id")).first()
    return S.diagnostics_near(n, one["id"] if one else "")


_add(_BUSY, ingest_graph, _near, """
, o AS (SELECT * FROM gn WHERE id = (SELECT min(id) FROM gn WHERE type = 'Diagnostic' AND file_path IS NOT NULL))
SELECT g.id, g.file_path, abs(coalesce(g.line_number, 0) - coalesce(o.line_number, 0)) AS distance FROM gn g JOIN o ON g.file_path = o.file_path AND g.project_context = o.project_context WHERE g.type = 'Diagnostic'""")


def _rule(s, t, layers=LAYERS, forbidden=FORBIDDEN):
    hit = lambda c, parts: "(" + " OR ".join(f"contains({c}, '{p}')" for p in parts) + ")"
    return "CASE " + " ".join(f"WHEN {hit(s, layers[a])} AND {hit(t, layers[b])} THEN '{a} must not depend on {b}'" for a, b in forbidden) + " END"


RULES_INGEST = ({"Storage": [".Storage"], "Routing": [".Routing"], "Reports": [".Reports", ".Review"]}, [("Storage", "Reports"), ("Routing", "Storage")])
_VIOL = f"viol AS (SELECT {_rule('s.namespace', 't.namespace')} AS violation, src, dst, e.type, s.name AS sn, t.name AS tn FROM e JOIN n s ON s.id = src JOIN n t ON t.id = dst WHERE e.type IN {sql_list(COARSE)})"
_add("ref_J7_violations", order_graph, S.violations, f", {_VIOL} SELECT violation, src, dst, type FROM viol WHERE violation IS NOT NULL ORDER BY violation, sn, tn, src, dst, type LIMIT 50")
_add("ref_J7_violations_all_ingest", ingest_graph, lambda n, e: S.violations(n, e, *RULES_INGEST, limit=None), f"""
SELECT * FROM (SELECT {_rule('s.namespace', 't.namespace', *RULES_INGEST)} AS violation, src, dst, ge.type FROM ge JOIN gn s ON s.id = src JOIN gn t ON t.id = dst WHERE ge.type IN {sql_list(COARSE)}) WHERE violation IS NOT NULL""")
_CYC = f"pp AS (SELECT DISTINCT s.namespace AS a, t.namespace AS b FROM e JOIN n s ON s.id = src JOIN n t ON t.id = dst WHERE e.type IN {sql_list(COARSE)} AND s.namespace <> t.namespace AND s.file_role IN ('Source', 'Unknown') AND t.file_role IN ('Source', 'Unknown'))"
_CYC2 = "SELECT x.a AS from_namespace, x.b AS to_namespace FROM pp x JOIN pp y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b"
_add("ref_J8_namespace_cycles", order_graph, S.namespace_cycles, f", {_CYC} {_CYC2} ORDER BY 1, 2 LIMIT 50")
_add("ref_J8_namespace_cycles_ingest", ingest_graph, lambda n, e: S.namespace_cycles(n, e, None), f", {_CYC.replace(' e JOIN n s', ' ge e JOIN gn s').replace('JOIN n t', 'JOIN gn t')} {_CYC2}")
_add("ref_R16_overview", order_graph, lambda n, e: S.overview(n), """
SELECT type, count(*) AS nodes, string_agg(name, ', ' ORDER BY name, id) FILTER (rn <= 5) AS first_names FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY name, id) AS rn FROM n) GROUP BY type""")
_add("ref_R11_graph_drift", ingest_graph, lambda n, e: S.graph_drift(n), f"""
, d AS (SELECT count(*) FILTER (type IN {sql_list(NEEDS_PATH)} AND coalesce(trim(file_path), '') = '') AS no_path,
 count(*) FILTER (type IN {sql_list(NEEDS_LINE)} AND NOT (coalesce(line_number > 0, false) OR coalesce(line_count > 0, false))) AS no_line, count(*) FILTER (updated_at IS NULL) AS no_time,
 count(*) FILTER (type IN {sql_list(NEEDS_HASH)} AND coalesce(trim(file_path), '') <> '' AND coalesce(trim(source_hash), '') = '') AS no_hash,
 count(*) FILTER (file_role NOT IN ('Unknown', 'Test') AND coalesce(trim(file_path), '') <> '' AND {path_role_sql('file_path')} = 'Test') AS role_conflicts, count(*) FILTER ({_FRESH} = 'Low') AS low FROM gn)
SELECT *, CASE WHEN low > 25 OR no_path > 50 OR no_line > 100 OR role_conflicts > 50 THEN 'high' WHEN low > 5 OR no_path > 10 OR no_line > 25 OR role_conflicts > 10 THEN 'moderate' ELSE 'low' END AS severity FROM d""")
_add("ref_R12_freshness_findings", ingest_graph, lambda n, e: S.freshness_findings(n, PROJECT), f"""
SELECT id, {_FRESH} AS confidence, concat_ws(',', CASE WHEN updated_at IS NULL THEN 'time' END, CASE WHEN type IN {sql_list(NEEDS_PATH)} AND coalesce(trim(file_path), '') = '' THEN 'path' END,
 CASE WHEN type IN {sql_list(NEEDS_LINE)} AND NOT (coalesce(line_number > 0, false) OR coalesce(line_count > 0, false)) THEN 'line' END, CASE WHEN type IN {sql_list(NEEDS_HASH)} AND coalesce(trim(source_hash), '') = '' THEN 'hash' END) AS missing
FROM gn WHERE lower(project_context) = 'tidalledger' ORDER BY CASE {_FRESH} WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END, id LIMIT 200""")
_add("ref_R12_freshness_counts", ingest_graph, lambda n, e: S.freshness_counts(n), f"SELECT {_FRESH} AS confidence, count(*) AS nodes FROM gn GROUP BY 1")


def _with_lines(n):
    return n.withColumn("line_number", F.lit(None).cast("int"))


_FRESH_ORDER = _FRESH.replace("coalesce(line_number > 0, false) OR ", "")
_add("ref_R8_weather_score", order_graph, lambda n, e: S.unit_health(_with_lines(n), e), f"""
, {_gaps('n', 'e')}, {_VIOL}, {_CYC},
o AS (SELECT (SELECT count(*) FROM ({_CYC2} LIMIT 50)) AS cycles, (SELECT count(*) FROM (SELECT 1 FROM viol WHERE violation IS NOT NULL LIMIT 50)) AS broken, (SELECT count(*) FROM gap) AS gaps, (SELECT count(*) FROM n WHERE {_FRESH_ORDER} = 'Low') AS low)
SELECT *, greatest(0, least(100, 100 - (least(25, 5 * cycles) + least(25, 5 * broken) + least(20, gaps // 5) + least(20, low // 10) + CASE WHEN EXISTS (SELECT 1 FROM e WHERE type IN {sql_list(TRAVERSAL)}) THEN least(10, (SELECT count(*) FROM n)) ELSE 0 END)))::INT AS score FROM o""")
