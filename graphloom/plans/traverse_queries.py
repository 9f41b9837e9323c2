"""Queries of the traversals over the order graph and the ingest graph, with recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import traverse as T
from ..operators.model import COARSE, FORBIDDEN, LAYERS, TRAVERSAL, WORKFLOW, sql_list
from ..sources.projection import INGEST_GRAPH_SQL, ORDER_GRAPH_SQL, ingest_graph, order_graph
from .structural_queries import RULES_INGEST, _rule

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name, graph, run, sql=None):
    QUERIES[name] = lambda spark, d: run(*graph(spark, d))
    if sql:
        SQL[name] = f"WITH RECURSIVE {ORDER_GRAPH_SQL if graph is order_graph else INGEST_GRAPH_SQL}, {sql}"


_TR = sql_list(TRAVERSAL)
_INSIDE = """ins AS (SELECT id, 0 AS level FROM {n} WHERE id = '{at}' UNION SELECT dst, 1 FROM {e} WHERE src = '{at}' AND type = 'Contains'
 UNION SELECT b.dst, 2 FROM {e} a JOIN {e} b ON b.src = a.dst AND b.type = 'Contains' WHERE a.src = '{at}' AND a.type = 'Contains')"""


def _down(n, e, at, depth):
    return f"""{_INSIDE.format(n=n, e=e, at=at)},
st AS (SELECT DISTINCT src AS a, dst AS b FROM {e} WHERE type IN {_TR}),
bfs AS (SELECT DISTINCT id, 0 AS dist FROM ins UNION SELECT b, dist + 1 FROM bfs JOIN st ON a = id WHERE dist < {depth})
SELECT id, min(dist)::INT AS dist FROM bfs WHERE id NOT IN (SELECT id FROM ins) GROUP BY id ORDER BY dist, id LIMIT 50"""


_add("ref_G3_downstream", order_graph, lambda n, e: T.downstream(n, e, "order:100", 4), _down("n", "e", "order:100", 4))
_add("ref_G3_downstream_class", order_graph, lambda n, e: T.downstream(n, e, "customer:8", 2), _down("n", "e", "customer:8", 2))
_add("ref_G3_downstream_empty", order_graph, lambda n, e: T.downstream(n, e, "supplier:none", 3), _down("n", "e", "supplier:none", 3))
_WF = sql_list(WORKFLOW)


def _impact(n, e, at, kind, depth):
    """The five ways for a node of a known type."""
    other = (
        f"SELECT DISTINCT src AS id FROM {e} WHERE dst = '{at}' AND type IN ('Implements', 'Inherits')" if kind == "Interface"
        else f"SELECT DISTINCT dst AS id FROM {e} WHERE src = '{at}' AND type IN ('Implements', 'Inherits')" if kind == "Class" else "SELECT NULL AS id WHERE false"
    )
    inner_rank = "CASE WHEN m.r = 'DependsOn' THEN 3 ELSE 2 END" if kind == "Interface" else "3"
    return f"""{_INSIDE.format(n=n, e=e, at=at)},
oth AS ({other}),
inn AS (SELECT DISTINCT o.id AS top, x.dst AS id FROM oth o JOIN {e} x ON x.src = o.id AND x.type = 'Contains' UNION SELECT o.id, y.dst FROM oth o JOIN {e} x ON x.src = o.id AND x.type = 'Contains' JOIN {e} y ON y.src = x.dst AND y.type = 'Contains'),
roots AS (SELECT DISTINCT 'own' AS way, id, id AS top FROM ins UNION ALL SELECT 'other', id, id FROM oth UNION ALL SELECT 'inner', id, top FROM inn),
st AS (SELECT DISTINCT dst AS a, src AS b, type AS rel FROM {e} WHERE type IN {_TR}),
bfs AS (SELECT DISTINCT id AS root, id, 0 AS dist, NULL::VARCHAR AS r FROM roots UNION SELECT root, b, dist + 1, coalesce(r, rel) FROM bfs JOIN st ON a = id WHERE dist < {depth}),
far AS (SELECT root, id, min({{'dist': dist, 'r': r}}) AS m FROM bfs GROUP BY root, id HAVING min(dist) > 0),
f AS (SELECT way, top, far.root, far.id, m, x.type IN {_WF} AS beside FROM roots JOIN far ON far.root = roots.id JOIN {n} x ON x.id = far.id),
a AS (SELECT id, m.dist + (root <> '{at}')::INT AS dist, CASE WHEN beside THEN 4 WHEN root <> '{at}' AND m.r = 'DependsOn' THEN 3 WHEN root <> '{at}' THEN 2 WHEN m.r IN ('DependsOn', 'Implements', 'Inherits') THEN 3 ELSE 1 END AS rank
 FROM f WHERE way = 'own' AND id NOT IN (SELECT id FROM ins)),
g AS (SELECT way, top, id, min(m) AS m, any_value(beside) AS beside FROM f WHERE way <> 'own' AND id <> '{at}' AND id <> top AND id <> root GROUP BY 1, 2, 3),
b AS (SELECT id, m.dist + CASE WHEN way = 'other' THEN 1 ELSE 2 END AS dist, CASE WHEN beside THEN 4 WHEN way = 'other' THEN 3 ELSE {inner_rank} END AS rank FROM g),
best AS (SELECT id, min({{'rank': rank, 'dist': dist}}) AS m FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE dist <= {depth} GROUP BY id)
SELECT best.id, m.dist::INT AS dist, CASE m.rank WHEN 1 THEN 'direct-class' WHEN 2 THEN 'member' WHEN 3 THEN 'dependency' ELSE 'workflow' END AS bucket FROM best JOIN {n} x ON x.id = best.id ORDER BY m.dist, m.rank, x.name, best.id LIMIT 50"""


_add("ref_G1_G2_impact", order_graph, lambda n, e: T.impact(n, e, "part:5", 4), _impact("n", "e", "part:5", "Class", 4))
_add("ref_G1_impact_interface", order_graph, lambda n, e: T.impact(n, e, _first(n, e, "Interface"), 3), _impact("n", "e", "'||(SELECT pk FROM pick)||'", "Interface", 3).replace("ins AS (", "pick AS (SELECT min(dst) AS pk FROM e WHERE type = 'Implements'), ins AS (", 1))


def _first(n, e, kind):
    r = e.where("type = 'Implements'").agg(F.min("dst").alias("at")).first()
    return r["at"] or ""


_add("ref_G1_impact_supplier", order_graph, lambda n, e: T.impact(n, e, "supplier:3", 2), _impact("n", "e", "supplier:3", "DatabaseTable", 2))
_UND = f"st AS (SELECT a, b, min(rel) AS rel FROM (SELECT src AS a, dst AS b, type AS rel FROM e WHERE type IN {_TR} UNION ALL SELECT dst, src, type FROM e WHERE type IN {_TR}) GROUP BY 1, 2)"
_add("ref_G4_connection", order_graph, lambda n, e: T.connection(n, e, "order:100", "order:2000"), f"""{_UND},
bfs AS (SELECT 'order:2000' AS id, 0 AS dist UNION SELECT b, dist + 1 FROM bfs JOIN st ON a = id WHERE dist < 4),
d AS (SELECT id, min(dist) AS dist FROM bfs GROUP BY id),
walk AS (SELECT 0 AS step, 'order:100' AS id, (SELECT dist FROM d WHERE id = 'order:100') AS left_
 UNION ALL SELECT step + 1, (SELECT min(st.b) FROM st JOIN d ON d.id = st.b WHERE st.a = w.id AND d.dist = w.left_ - 1), left_ - 1 FROM walk w WHERE left_ > 0)
SELECT step, w.id, (SELECT rel FROM st WHERE a = w.id AND b = (SELECT x.id FROM walk x WHERE x.step = w.step + 1)) AS via FROM walk w WHERE left_ IS NOT NULL""")
_add("ref_G4_no_connection", order_graph, lambda n, e: T.connection(n, e, "customer:7", "order:100"), "z AS (SELECT 1) SELECT 0 AS step, '' AS id, '' AS via WHERE false")
_add("ref_G8_neighbours", order_graph, lambda n, e: T.neighbours(e, "part:5", 2, ["Calls", "Uses", "DependsOn"], "both", 100000), """
st AS (SELECT src AS a, dst AS b, src, dst, type, src || '|' || type || '|' || dst AS eid FROM (SELECT DISTINCT src, dst, type FROM e WHERE type IN ('Calls', 'Uses', 'DependsOn'))
 UNION ALL SELECT dst, src, src, dst, type, src || '|' || type || '|' || dst FROM (SELECT DISTINCT src, dst, type FROM e WHERE type IN ('Calls', 'Uses', 'DependsOn')) WHERE src <> dst),
one AS (SELECT * FROM st WHERE a = 'part:5'), two AS (SELECT st.* FROM one JOIN st ON st.a = one.b WHERE st.eid <> one.eid)
SELECT DISTINCT b AS id, src, dst, type, 1 AS dist FROM one WHERE b <> 'part:5' UNION SELECT DISTINCT b, src, dst, type, 2 FROM two WHERE b <> 'part:5'""")
_add("ref_G8_neighbours_out", ingest_graph, lambda n, e: T.neighbours(e, _busy(e), 1, None, "out", 100), """
z AS (SELECT min(src) AS pk FROM ge WHERE type = 'Calls') SELECT DISTINCT dst AS id, src, dst, type, 1 AS dist FROM ge WHERE src = (SELECT pk FROM z) AND dst <> src ORDER BY dist, id, src, type, dst LIMIT 100""")


def _busy(e):
    return e.where("type = 'Calls'").agg(F.min("src").alias("at")).first()["at"] or ""


_add("ref_G7_ego_edges", order_graph, lambda n, e: T.ego_edges(e, "part:5", 2, 100), """
nb AS (SELECT 'part:5' AS id UNION SELECT dst FROM e WHERE src = 'part:5' UNION SELECT src FROM e WHERE dst = 'part:5')
SELECT DISTINCT src, dst, type FROM e WHERE src IN (SELECT id FROM nb) OR dst IN (SELECT id FROM nb) ORDER BY 1, 2, 3 LIMIT 100""")
_CO = sql_list(COARSE)
_add("ref_G11_neighbourhood", order_graph, lambda n, e: T.neighbourhood(e, "part:5", 2), f"""
st AS (SELECT src AS a, dst AS b FROM e WHERE type IN {_CO} UNION SELECT dst, src FROM e WHERE type IN {_CO}), bfs AS (SELECT 'part:5' AS id, 0 AS dist UNION SELECT b, dist + 1 FROM bfs JOIN st ON a = id WHERE dist < 2)
SELECT DISTINCT id FROM bfs WHERE id <> 'part:5'""")
_add("ref_G9_editing_context", order_graph, lambda n, e: T.editing_context(n, e, "customer:8"), f"""{_INSIDE.format(n='n', e='e', at='customer:8')},
r AS (SELECT 'caller' AS role, src AS id FROM e WHERE type IN {_TR} AND dst IN (SELECT id FROM ins) UNION SELECT 'callee', dst FROM e WHERE type IN {_TR} AND src IN (SELECT id FROM ins) UNION SELECT 'interface', dst FROM e WHERE type = 'Implements' AND src IN (SELECT id FROM ins))
SELECT role, id FROM r WHERE id NOT IN (SELECT id FROM ins) QUALIFY row_number() OVER (PARTITION BY role ORDER BY id) <= 10""")
_add("ref_G10_subgraph_summary", order_graph, lambda n, e: T.subgraph_summary(e, "order:100"), """
o AS (SELECT DISTINCT dst FROM e WHERE src = 'order:100') SELECT (SELECT count(*) FROM o) AS neighbours, (SELECT string_agg(dst, ',' ORDER BY dst) FROM (SELECT dst FROM o ORDER BY dst LIMIT 10)) AS first""")
_add("ref_G12_namespace_members", order_graph, lambda n, e: T.namespace_members(n, "AMERICA.NATION_1"), "z AS (SELECT 1) SELECT id, namespace, type FROM n WHERE (namespace = 'AMERICA.NATION_1' OR starts_with(namespace, 'AMERICA.NATION_1.')) AND type NOT IN ('Namespace', 'File')")
_add("ref_G13_resolve_id", order_graph, lambda n, e: T.resolve_id(n, "order100"), """
h AS (SELECT id, CASE WHEN lower(id) = 'order100' THEN 0 WHEN ends_with(lower(id), 'order100') THEN 1 ELSE 2 END AS rank, (type = 'File')::INT AS f FROM n WHERE lower(id) = 'order100' OR ends_with(lower(id), 'order100') OR lower(name) = 'order100'),
g AS (SELECT rank, f, count(*) AS c, min(id) AS id FROM h GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 1) SELECT id, rank FROM g WHERE c = 1""")
_add("ref_G14_structural_intent", order_graph, lambda n, e: T.answer_intent(n, e, "who calls part:5?"), f"z AS (SELECT 1) SELECT DISTINCT src AS id FROM e WHERE dst = 'part:5' AND src <> 'part:5' AND type IN {_TR} ORDER BY src LIMIT 10")
_add("ref_G14_callees", order_graph, lambda n, e: T.answer_intent(n, e, "Dependencies of order:100"), f"z AS (SELECT 1) SELECT DISTINCT dst AS id FROM e WHERE src = 'order:100' AND dst <> 'order:100' AND type IN {_TR} ORDER BY dst LIMIT 10")
_add("ref_G14_members", order_graph, lambda n, e: T.answer_intent(n, e, "members in america.nation_1"), "z AS (SELECT 1) SELECT id FROM n WHERE (namespace = 'AMERICA.NATION_1' OR starts_with(namespace, 'AMERICA.NATION_1.')) AND type NOT IN ('Namespace', 'File')")
_add("ref_G15_extraction_closure", order_graph, lambda n, e: T.extraction_closure(n, e, n.where("id in ('order:100', 'part:5')")), """
bare AS (SELECT id FROM n WHERE file_path IS NULL), bfs AS (SELECT id, 0 AS dist FROM n WHERE id IN ('order:100', 'part:5') UNION SELECT dst, dist + 1 FROM bfs JOIN e ON src = bfs.id WHERE dst IN (SELECT id FROM bare) AND dist < 12)
SELECT id, min(dist)::INT AS dist FROM bfs GROUP BY id""")
_add("ref_G16_type_hierarchy", ingest_graph, lambda n, e: T.type_hierarchy(e), """
up AS (SELECT DISTINCT src AS a, dst AS b FROM ge WHERE type IN ('Inherits', 'Implements')), bfs AS (SELECT DISTINCT a AS id, a AS base, 0 AS dist FROM up UNION SELECT id, b, dist + 1 FROM bfs JOIN up ON a = base WHERE dist < 20)
SELECT id, base, min(dist)::INT AS dist FROM bfs GROUP BY id, base HAVING min(dist) > 0""")


def _smell(n, e, depth, rules=(LAYERS, FORBIDDEN)):
    return f"""
ok AS (SELECT id, name, namespace FROM {n} WHERE namespace IS NOT NULL AND file_role IN ('Source', 'Unknown')),
st AS (SELECT DISTINCT src AS a, dst AS b FROM {e} WHERE type IN {_CO}),
b0 AS (SELECT id FROM ok WHERE {' OR '.join(f"contains(namespace, '{p}')" for a, _ in rules[1] for p in rules[0][a])}),
bfs AS (SELECT id AS source, id, 0 AS dist, [id] AS path FROM b0 UNION SELECT source, b, dist + 1, list_append(path, b) FROM bfs JOIN st ON a = id WHERE dist < {depth}),
short AS (SELECT source, id, min({{'dist': dist, 'path': path}}) AS m FROM bfs GROUP BY 1, 2)
SELECT {_rule('s.namespace', 't.namespace', *rules)} AS violation, source, short.id AS target, m.dist::INT AS dist, array_to_string(m.path, '>') AS path
FROM short JOIN ok s ON s.id = source JOIN ok t ON t.id = short.id WHERE source <> short.id AND {_rule('s.namespace', 't.namespace', *rules)} IS NOT NULL ORDER BY dist, violation, s.name, t.name, source, target LIMIT 50"""


_add("ref_G6_smell_paths", order_graph, lambda n, e: T.smell_paths(n, e, 1), _smell("n", "e", 1))
_add("ref_G6_smell_paths_deep", ingest_graph, lambda n, e: T.smell_paths(n, e, 3, 50, *RULES_INGEST), _smell("gn", "ge", 3, RULES_INGEST))


def _endpoint(n):
    r = n.where("type = 'ApiEndpoint'").agg(F.min("id").alias("id")).first()
    return r["id"] or ""


_add("ref_G5_trace_endpoint", order_graph, lambda n, e: T.trace_endpoint(n, e, _endpoint(n), 2, 20), """
ep AS (SELECT min(id) AS id FROM n WHERE type = 'ApiEndpoint'),
k AS (SELECT id, type, name, CASE WHEN type = 'ExternalConcept' AND external_kind = 'DatabaseOperation' THEN coalesce(recognition, 1.0) END AS op FROM n),
d AS (SELECT DISTINCT src, dst, type FROM e),
st AS (SELECT src AS a, dst AS b, false AS jump, src || '|' || type || '|' || dst AS eid FROM d WHERE type IN ('Calls', 'Uses', 'Reads', 'Writes', 'PublishesTo', 'SubscribesTo') UNION ALL SELECT dst, src, true, src || '|' || type || '|' || dst FROM d WHERE type = 'Implements'),
trl AS (SELECT d.src AS id, [d.dst, d.src] AS path, []::VARCHAR[] AS used, false AS jumped, k.op AS worst, true AS open, 0 AS hop FROM d JOIN ep ON d.dst = ep.id JOIN k ON k.id = d.src WHERE d.type = 'Uses'
 UNION ALL SELECT b, list_append(path, b), list_append(used, eid), jumped OR jump, CASE WHEN worst IS NULL THEN k.op WHEN k.op IS NULL THEN worst ELSE least(worst, k.op) END, NOT jump, hop + 1 FROM trl JOIN st ON a = trl.id JOIN k ON k.id = b WHERE hop < 2 AND NOT list_contains(used, eid) AND NOT (jumped AND jump)),
r AS (SELECT DISTINCT hop + 2 AS length, trl.id AS target, array_to_string(path, '>') AS path, name FROM trl JOIN k ON k.id = trl.id WHERE hop > 0 AND open AND (k.type = 'MessageTopic' OR (k.type = 'DatabaseTable' AND worst >= 0.8)))
SELECT length, target, path FROM r ORDER BY length, name, path LIMIT 20""")
