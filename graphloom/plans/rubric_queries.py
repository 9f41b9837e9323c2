"""Queries of the reports by rubric, with SQL written from the rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import effective_role_sql, layer_sql
from ..operators import algorithms as A
from ..operators import knowledge as K
from ..operators import reports as R
from ..operators.model import COMMUNITY, TRAVERSAL, sql_list
from ..sources.projection import INGEST_GRAPH_SQL, ORDER_GRAPH_SQL, ingest_graph, order_graph
from ..sources.tables import table
from .knowledge_queries import DOCS_SQL, _COS, _HAS, documents
from .report_queries import SQL as _REPORT_SQL, _TT
from .structural_queries import _FRESH, _gaps, _god
from .traverse_queries import _impact

QUERIES: dict = {}
SQL: dict[str, str] = {}
_TR = sql_list(TRAVERSAL)


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


# Test shield
_TARGET = "part:5"
_PATH = ", " + _impact("n", "e", _TARGET, "Class", 2).rsplit("\nSELECT best.id", 1)[0] + ", hit AS (" + "SELECT best.id" + _impact("n", "e", _TARGET, "Class", 2).rsplit("\nSELECT best.id", 1)[1] + ")"


def _stem(c: str) -> str:
    return rf"lower(regexp_extract(coalesce({c}, ''), '([^/\\]+?)(?:\.[^./\\]*)?$', 1))"


def _alike(a: str, b: str) -> str:
    return f"(length({a}) > 0 AND length({b}) > 0 AND (contains({a}, {b}) OR contains({b}, {a})))"


_NEAR = f"""(coalesce(lower(t.file_path) = lower(p.file_path), false) OR coalesce(lower(t.namespace) = lower(p.namespace), false)
 OR (t.file_path IS NOT NULL AND p.file_path IS NOT NULL AND ({_alike(_stem('t.file_path'), _stem('p.file_path'))} OR {_alike(_stem('t.file_path'), "lower(coalesce(p.name, ''))")} OR {_alike(_stem('p.file_path'), "lower(coalesce(t.name, ''))")})))"""
_HAY = "lower(concat_ws(' ', name, file_path, namespace))"
QUERIES["ref_C2_test_shield"] = lambda s, d: R.test_shield(*order_graph(s, d), _TARGET, 2)
SQL["ref_C2_test_shield"] = f"""WITH RECURSIVE {ORDER_GRAPH_SQL}{_PATH},
pt AS (SELECT * FROM n WHERE NOT {_TT} AND (id = '{_TARGET}' OR id IN (SELECT id FROM hit))),
ts0 AS (SELECT *, {_any(_HAY, R.SUPPORT_WORDS)} AS support FROM n WHERE {_TT}),
ts AS (SELECT *, NOT support AND (type = 'Method' OR (type = 'Class' AND coalesce(lower(file_path), '') NOT IN (SELECT lower(file_path) FROM ts0 WHERE type = 'Method' AND NOT support AND file_path IS NOT NULL))) AS fit FROM ts0),
pairs AS (SELECT p, t, max(d) AS direct, max(l) AS place FROM (
 SELECT DISTINCT dst AS p, src AS t, 1 AS d, 0 AS l FROM e WHERE type = 'Calls' AND dst IN (SELECT id FROM pt) AND src IN (SELECT id FROM ts)
 UNION ALL SELECT p.id, t.id, 0, 1 FROM ts t JOIN pt p ON {_NEAR}) GROUP BY 1, 2),
dp AS (SELECT DISTINCT src AS p, dst FROM e WHERE type IN {_TR} AND src IN (SELECT id FROM pt)),
sh AS (SELECT p, count(*) AS shared FROM dp WHERE dst IN (SELECT dst FROM dp WHERE p = '{_TARGET}') GROUP BY 1),
rr AS (SELECT t, pairs.p, 100 * direct + 50 * (pairs.p <> '{_TARGET}')::INT + 10 * coalesce(shared, 0) + 5 * place AS score, CASE WHEN fit AND direct = 1 THEN (pairs.p <> '{_TARGET}')::INT ELSE 2 END AS rank
 FROM pairs LEFT JOIN sh ON sh.p = pairs.p JOIN ts ON ts.id = t),
bs AS (SELECT * FROM rr QUALIFY row_number() OVER (PARTITION BY t ORDER BY rank, score DESC, p) = 1),
al AS (SELECT CASE rank WHEN 0 THEN 'direct' WHEN 1 THEN 'primary' ELSE 'secondary' END AS shield, t AS id, p AS protects, score FROM bs
 UNION ALL SELECT 'unshielded', id, NULL, 0 FROM pt WHERE id NOT IN (SELECT p FROM pairs))
SELECT shield, al.id, protects, score::INT AS score FROM al JOIN n ON n.id = al.id QUALIFY row_number() OVER (PARTITION BY shield ORDER BY score DESC, lower(name), al.id) <= 20"""

# Responsibility slices


def _owner(e):
    r = e.where("type = 'Contains'").groupBy("src").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "src").limit(1)
    return r


def _slices(s, d):
    n, e = ingest_graph(s, d)
    classes = n.where("type = 'Class'").select(F.col("id").alias("src"))
    one = _owner(e.join(classes, "src", "left_semi")).join(n.select(F.col("id").alias("src"), "name"), "src").first()
    if one is None:
        return R.responsibility_slices(n, e, "")
    docs = documents(s, d).where(F.lower("content").contains((one["name"] or one["src"]).lower())).limit(3).count()
    return R.responsibility_slices(n, e, one["src"], docs, n.where("file_path is not null").select("id", F.col("file_path").alias("community")))


def _words(c: str) -> str:
    return rf"list_filter(string_split_regex(lower(trim(regexp_replace(regexp_replace({c}, '(\p{{Lu}})', ' \1', 'g'), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g'))), ' +'), lambda x: x <> '')"


_IDENT = r"regexp_replace(regexp_replace(coalesce(list_filter(string_split(trim(split_part(base, '(', 1)), '.'), lambda x: trim(x) <> '')[-1], base), '^I(\p{Lu})', '\1'), '(?i)async$', '')"
_GENERIC = sql_list(R.GENERIC_WORDS)
_LADDER = " ".join(f"WHEN {_any('txt', w)} THEN '{n}'" for n, w in R.SLICE_WORDS)
_PLURAL = """CASE WHEN regexp_matches(nm, '(?i)(ies|ses|xes|zes|ches|shes)$') THEN nm WHEN regexp_matches(nm, '(?i)[^aeiou]y$') AND length(nm) > 1 THEN left(nm, length(nm) - 1) || 'ies'
 WHEN regexp_matches(nm, '(?i)(s|x|z|ch|sh)$') THEN nm || 'es' ELSE nm || 's' END"""
QUERIES["ref_C12_responsibility_slices"] = _slices
SQL["ref_C12_responsibility_slices"] = f"""WITH {INGEST_GRAPH_SQL}, {DOCS_SQL},
ow AS (SELECT src AS id FROM ge WHERE type = 'Contains' AND src IN (SELECT id FROM gn WHERE type = 'Class') GROUP BY src ORDER BY count(*) DESC, src LIMIT 1),
dc AS (SELECT least(count(*), 3) AS docs FROM kd WHERE contains(lower(content), (SELECT lower(coalesce(name, gn.id)) FROM gn JOIN ow ON ow.id = gn.id))),
ins AS (SELECT dst AS id FROM ge WHERE type = 'Contains' AND src = (SELECT id FROM ow) UNION SELECT b.dst FROM ge a JOIN ge b ON b.src = a.dst AND b.type = 'Contains' WHERE a.type = 'Contains' AND a.src = (SELECT id FROM ow)),
m AS (SELECT id, name, coalesce(summary, '') AS summary, file_path FROM gn WHERE type = 'Method' AND NOT {_TT} AND id IN (SELECT id FROM ins) AND id <> (SELECT id FROM ow)),
wh AS (SELECT id AS other, name, {_TT} AS is_test, type IN {sql_list(R.DEPENDENCY_TYPES)} AND string_split(split_part(name, '(', 1), '.')[-1] NOT IN {sql_list(R.FRAMEWORK_NAMES)} AND NOT (coalesce(namespace, '') = 'System' OR starts_with(coalesce(namespace, ''), 'System.Threading')) AS usable,
 type IN ('ApiEndpoint', 'ExternalConcept') OR {_any("lower(concat_ws(' ', name, namespace, file_path))", R.WORKFLOW_WORDS)} AS flow FROM gn),
j AS (SELECT x.*, wh.* FROM (SELECT DISTINCT src AS m, dst AS o, 'out' AS way, type FROM ge WHERE type IN {_TR} AND src IN (SELECT id FROM m) UNION ALL SELECT DISTINCT dst, src, 'in', type FROM ge WHERE type IN {_TR} AND dst IN (SELECT id FROM m)) x JOIN wh ON wh.other = x.o WHERE x.m <> x.o),
g AS (SELECT m, list_sort(list(DISTINCT {{'name': name, 'id': other}}) FILTER (way = 'out' AND usable AND NOT is_test)) AS deps, list_sort(list(DISTINCT {{'name': name, 'id': other}}) FILTER (way = 'in' AND flow AND NOT is_test)) AS flows,
 list_sort(list(DISTINCT {{'name': name, 'id': other}}) FILTER (way = 'in' AND is_test AND type = 'Calls')) AS tests FROM j GROUP BY m),
s1 AS (SELECT id, name, summary, file_path, coalesce(deps, []) AS deps, coalesce(flows, []) AS flows, coalesce(tests, []) AS tests FROM m LEFT JOIN g ON g.m = m.id),
s2 AS (SELECT *, lower(concat_ws(' ', name, summary, array_to_string(list_transform(flows, lambda x: x.name), ' '), array_to_string(list_transform(deps, lambda x: x.name), ' '))) AS txt,
 CASE WHEN len(flows) > 0 THEN CASE WHEN regexp_extract(flows[1].name, '\\S*/([^/\\s]+)/?\\s*$', 1) <> '' THEN regexp_extract(flows[1].name, '\\S*/([^/\\s]+)/?\\s*$', 1) ELSE flows[1].name END WHEN len(deps) > 0 THEN deps[1].name
 ELSE coalesce(list_filter({_words('name')}, lambda x: x NOT IN {_GENERIC})[1], '') END AS base FROM s1),
s3 AS (SELECT *, list_filter({_words(_IDENT)}, lambda x: x NOT IN {_GENERIC})[1:3] AS tell FROM s2),
s4 AS (SELECT *, CASE WHEN base = '' THEN '' WHEN len(tell) > 0 THEN array_to_string(list_transform(tell, lambda x: upper(x[1]) || x[2:]), '') ELSE base END AS nm FROM s3),
s5 AS (SELECT *, CASE {_LADDER} WHEN nm = '' THEN 'Deferred' ELSE {_PLURAL} END AS slice FROM s4),
s AS (SELECT *, lower(slice) AS key, list_concat(list_concat(list_transform(deps, lambda x: x.id), list_transform(flows, lambda x: x.id)), list_transform(tests, lambda x: x.id)) AS ev FROM s5),
pr AS (SELECT a.key, count(*) FILTER (len(list_intersect(a.ev, b.ev)) > 0) / count(*)::DOUBLE AS share FROM s a JOIN s b ON a.key = b.key AND a.id < b.id GROUP BY 1),
tg AS (SELECT key, max(k) AS together FROM (SELECT key, file_path, count(*) AS k FROM s WHERE file_path IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
ag AS (SELECT key, min(slice) AS slice, count(*) AS methods, len(list_distinct(flatten(list(list_transform(deps, lambda x: x.id))))) AS deps, len(list_distinct(flatten(list(list_transform(flows, lambda x: x.id))))) AS callers,
 len(list_distinct(flatten(list(list_transform(tests, lambda x: x.id))))) AS tests FROM s GROUP BY key),
sc AS (SELECT slice, methods, deps, callers, tests, methods + 5 * deps + 4 * callers + 4 * tests + 2 * docs - CASE WHEN deps + callers + tests = 0 THEN 3 ELSE 0 END + CASE WHEN coalesce(together, 0) >= 2 THEN 1 ELSE 0 END AS score, coalesce(together, 0) AS together,
 round(coalesce(share, 0), 6) AS shared, (SELECT count(*) FROM s) AS total FROM ag LEFT JOIN pr ON pr.key = ag.key LEFT JOIN tg ON tg.key = ag.key, dc)
SELECT slice, methods, deps::BIGINT AS deps, callers::BIGINT AS callers, tests::BIGINT AS tests, score::BIGINT AS score, CASE WHEN score >= 18 AND together >= 2 THEN 'High' WHEN score >= 9 THEN 'Medium' ELSE 'Low' END AS confidence, shared,
 CASE WHEN methods > {R.SLICE_METHODS} OR (total >= 8 AND methods / total::DOUBLE > {R.SLICE_SHARE}) OR (methods >= 4 AND shared < {R.SLICE_EVIDENCE}) THEN 'defer' ELSE 'keep' END AS verdict FROM sc WHERE methods > 1 OR score >= 8"""

# Extraction: one query over communities, which SQL cannot find, and one over namespaces in their place.
QUERIES["ref_C11_extraction_suggestions"] = lambda s, d: (lambda n, e: R.extraction_suggestions(n, e, A.communities(n, e, COMMUNITY)))(*ingest_graph(s, d))
QUERIES["ref_C11_extraction_of_namespaces"] = lambda s, d: (lambda n, e: R.extraction_suggestions(n, e, n.where("namespace is not null").select("id", F.col("namespace").alias("community"))))(*order_graph(s, d))
_GOD = _god("n", "e", 300, 3).replace("SELECT g.id, line_count", ", godc AS (SELECT g.id, line_count", 1).replace("name, g.id LIMIT 20", "name, g.id LIMIT 20)").lstrip(", ")
SQL["ref_C11_extraction_of_namespaces"] = f"""WITH {ORDER_GRAPH_SQL}, {_GOD}, {_gaps('n', 'e').replace('mem AS', 'mem2 AS', 1).replace('FROM mem ', 'FROM mem2 ').replace('fan AS', 'fan9 AS').replace('JOIN fan ON fan.id', 'JOIN fan9 ON fan9.id')},
hs AS (SELECT dst AS id, count(*) AS fan FROM e JOIN n ON n.id = dst WHERE e.type IN ('Calls', 'Uses', 'DependsOn', 'UsesClass', 'UsesId', 'DefinesSelector', 'ImportsStyle', 'UsesCssVariable', 'DefinesCssVariable', 'Reads', 'Writes', 'PublishesTo', 'SubscribesTo') AND n.type IN ('Method', 'Class', 'Interface') GROUP BY 1 ORDER BY fan DESC, id LIMIT 50),
al AS (SELECT *, namespace AS community, coalesce(file_role, 'Unknown') IN ('Source', 'Unknown') AND NOT {_TT} AS prod, {layer_sql()} AS layer FROM n WHERE namespace IS NOT NULL),
ra AS (SELECT community, avg(prod::INT) AS ratio FROM al GROUP BY 1),
mm AS (SELECT al.*, fan, godc.id IS NOT NULL AS god, gap.id IS NOT NULL AS gp FROM al LEFT JOIN hs ON hs.id = al.id LEFT JOIN godc ON godc.id = al.id LEFT JOIN gap ON gap.id = al.id WHERE prod AND al.type IN ('Method', 'Class', 'Interface')),
te AS (SELECT community, count(DISTINCT src) AS tests FROM mm JOIN e ON e.dst = mm.id AND e.type = 'Calls' WHERE src IN (SELECT id FROM n WHERE {_TT}) GROUP BY 1),
an AS (SELECT community, id AS anchor, fan, god FROM mm QUALIFY row_number() OVER (PARTITION BY community ORDER BY god DESC, coalesce(fan, 0) DESC, coalesce(line_count, 0) DESC, coalesce(change_count, 0) DESC, lower(name), id) = 1),
ga AS (SELECT community, count(*) AS members, count(DISTINCT lower(CASE WHEN trim(file_path) <> '' THEN file_path END)) AS files, sum(gp::INT) AS gaps, count(DISTINCT CASE WHEN layer <> 'Unknown' THEN layer END) AS layers FROM mm GROUP BY 1 HAVING count(*) >= 3),
jj AS (SELECT ga.*, anchor, ratio, coalesce(tests, 0) AS tests, coalesce(fan, 0) >= 3 AS hot, god FROM ga JOIN an ON an.community = ga.community JOIN ra ON ra.community = ga.community LEFT JOIN te ON te.community = ga.community),
sc AS (SELECT *, (CASE WHEN members BETWEEN 4 AND 8 THEN 6 WHEN members = 3 THEN 4 WHEN members <= 12 THEN 3 ELSE 1 END + CASE WHEN ratio >= 0.8 THEN 3 WHEN ratio >= 0.6 THEN 2 ELSE 0 END + CASE WHEN files <= 2 THEN 3 WHEN files <= 4 THEN 2 ELSE 0 END
 + CASE WHEN tests > 0 THEN 2 ELSE 0 END - gaps - 2 * greatest(0, layers - 1) + CASE WHEN hot THEN 2 ELSE 0 END + CASE WHEN god THEN 3 ELSE 0 END)::BIGINT AS score,
 CASE WHEN ratio >= 0.8 AND tests > 0 AND gaps = 0 AND layers <= 1 AND (god OR hot) THEN 'High' WHEN ratio >= 0.6 AND tests > 0 AND layers <= 2 THEN 'Medium' ELSE 'Low' END AS confidence FROM jj)
SELECT community, anchor, members, files, tests, gaps::BIGINT AS gaps, layers, round(ratio, 4) AS ratio, score, confidence, score >= 5 AND confidence <> 'Low' AND ratio > 0.5 AS is_primary FROM sc"""

# Implementation patterns


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.concat(F.lit("part:"), "vec_id").alias("id"), "embedding")


def _patterns(s, d):
    n, e = order_graph(s, d)
    n = n.withColumn("line_number", F.lit(None).cast("int"))
    one = _vectors(s, d).where("id = 'part:5'").first()
    return R.implementation_patterns(n, e, R.pattern_seeds(n, "large", _vectors(s, d), [float(x) for x in one["embedding"]]))


_FRESH_ORDER = _FRESH.replace("coalesce(line_number > 0, false) OR ", "")
QUERIES["ref_C10_implementation_patterns"] = _patterns
SQL["ref_C10_implementation_patterns"] = f"""WITH {ORDER_GRAPH_SQL},
code AS (SELECT * FROM n WHERE type IN ('Class', 'Method', 'Interface')),
lx AS (SELECT id, 0.55::DOUBLE AS seed, 'lexical' AS how FROM code WHERE contains(lower(name), 'large') ORDER BY name, id LIMIT 24),
em AS (SELECT 'part:' || a.vec_id AS id, round({_COS}, 6) AS seed, 'embedding' AS how FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 5) q WHERE 'part:' || a.vec_id IN (SELECT id FROM code)),
ne AS (SELECT * FROM em WHERE seed >= 0.45 ORDER BY seed DESC, id LIMIT 24),
sd AS (SELECT id, max(seed) AS seed, array_to_string(list_sort(list(DISTINCT how)), ',') AS how FROM (SELECT * FROM lx UNION ALL SELECT * FROM ne) GROUP BY id),
ed AS (SELECT DISTINCT src, dst, type FROM e WHERE type IN {_TR}),
nr AS (SELECT x.*, k.type AS kind, k.is_test FROM (SELECT src AS id, dst AS other, type, true AS out FROM ed WHERE src IN (SELECT id FROM sd) UNION ALL SELECT dst, src, type, false FROM ed WHERE dst IN (SELECT id FROM sd)) x JOIN (SELECT id, type, {_TT} AS is_test FROM n) k ON k.id = x.other),
g AS (SELECT id, max((NOT out AND NOT is_test)::INT) AS callers, max(out::INT) AS callees, max((out AND type = 'Implements')::INT) AS bases, max((kind IN ('DatabaseTable', 'MessageTopic'))::INT) AS store, max((kind = 'ApiEndpoint')::INT) AS entry, max((kind = 'ExternalConcept')::INT) AS external,
 count(DISTINCT CASE WHEN NOT out AND is_test AND type = 'Calls' THEN other END) AS direct, coalesce(list(DISTINCT other) FILTER (NOT out AND is_test AND type = 'Calls'), []) AS seen_by FROM nr GROUP BY id),
gs AS (SELECT g.id, count(*) AS guess FROM g JOIN n a ON a.id = g.id JOIN (SELECT id AS t, namespace FROM n WHERE {_TT} AND namespace IS NOT NULL) t ON t.namespace = a.namespace WHERE NOT list_contains(seen_by, t.t) AND t.t <> g.id GROUP BY 1),
sc AS (SELECT coalesce(CASE WHEN trim(coalesce(namespace, '')) <> '' THEN array_to_string(string_split(namespace, '.')[1:3], '.') END, array_to_string(string_split(replace(file_path, '\\', '/'), '/')[1:2], '/'), '(none)') AS scope, sd.id, how,
 (round(100 * seed) + 18 * (callers + callees + bases + store + entry) + 8 * least(direct, 3) + 3 * least(coalesce(guess, 0), 2) + 6 * (entry + store + external) - CASE {_FRESH_ORDER} WHEN 'Low' THEN 25 WHEN 'Medium' THEN 6 ELSE 0 END)::INT AS score
 FROM sd JOIN n ON n.id = sd.id JOIN g ON g.id = sd.id LEFT JOIN gs ON gs.id = sd.id WHERE callers + callees + bases + store + entry >= 2)
SELECT scope, id, score, how FROM sc QUALIFY row_number() OVER (PARTITION BY scope ORDER BY score DESC, id) = 1 ORDER BY score DESC, scope LIMIT 10"""

# Feature path
_FEATURE, _TERMS = "endpoint shipment", ["endpoint", "shipment", "invoice"]


def _where(t: str, cols) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({c}, '')), '{t}')" for c in cols) + ")::INT"


_FOUR, _TWO = ["name", "summary", "file_path", "namespace"], ["name", "summary"]
_SLASH = "lower(replace(coalesce(file_path, ''), '\\', '/'))"
_API = f"(type = 'ApiEndpoint' OR contains({_SLASH}, '/api/') OR contains({_SLASH}, '/controllers/'))"
_INFRA = f"(contains({_SLASH}, '/infrastructure/') OR contains(lower(coalesce(namespace, '')), '.infrastructure'))"
_CONTRACT = r"(type = 'Interface' OR regexp_matches(regexp_extract(coalesce(file_path, ''), '([^/\\]+?)(?:\.[^./\\]*)?$', 1), '^I\p{Lu}') OR " + _any("lower(coalesce(name, ''))", ["interface", "port"]) + " OR " + _any("lower(coalesce(file_path, ''))", ["port", "abstractions"]) + ")"
_HITS = "(" + " + ".join(_where(t, _FOUR) for t in _TERMS) + ")"
_PATHS = f"""fp AS (SELECT gn.*, (CASE WHEN type = 'Method' THEN 5 WHEN type IN ('Class', 'Interface', 'ApiEndpoint') THEN 4 WHEN type = 'File' THEN 2 ELSE 1 END + 6 * {_where(_FEATURE, _TWO)} + 3 * {_HITS} + CASE WHEN {_HITS} >= 2 THEN 6 ELSE 0 END
 + CASE WHEN {_HITS} >= 2 AND type = 'Method' THEN 8 ELSE 0 END + 2 * ({' + '.join(_where(t, _TWO) for t in _TERMS)}) + CASE WHEN {_CONTRACT} THEN -8 WHEN {_API} OR {_INFRA} THEN 2 ELSE 0 END
 - CASE WHEN coalesce(file_role, '') = 'Test' OR contains(lower(coalesce(file_path, '')), 'test') THEN 6 ELSE 0 END)::INT AS score
 FROM gn WHERE trim(coalesce(file_path, '')) <> '' AND ({_HITS} > 0 OR {_where(_FEATURE, _FOUR)} > 0) ORDER BY score DESC, lower(file_path), id LIMIT 12)"""


def _feature(s, d):
    return R.feature_path(ingest_graph(s, d)[0], _FEATURE, _TERMS)


QUERIES["ref_C17_feature_path"] = _feature
SQL["ref_C17_feature_path"] = f"WITH {INGEST_GRAPH_SQL}, {_PATHS} SELECT id, score, {layer_sql()} AS layer FROM fp"


def _status(s, d):
    n, e = ingest_graph(s, d)
    docs = documents(s, d).where(F.lower("content").contains("endpoint") & F.lower("content").contains("shipment"))
    return R.feature_status(n, e, docs, R.feature_path(n, _FEATURE, _TERMS), _FEATURE, _TERMS)


QUERIES["ref_C17_feature_status"] = _status
SQL["ref_C17_feature_status"] = f"""WITH {INGEST_GRAPH_SQL}, {DOCS_SQL}, {_PATHS},
fd AS (SELECT * FROM kd WHERE contains(lower(content), 'endpoint') AND contains(lower(content), 'shipment')),
a AS (SELECT count(*) AS nodes, coalesce(max(greatest({', '.join(_where(t, _TWO) for t in [_FEATURE, *_TERMS])})), 0) AS direct, coalesce(max(({_FRESH} = 'High')::INT), 0) AS fresh, count(*) FILTER ({_FRESH} = 'Low') AS stale,
 coalesce(max({_API}::INT), 0) * coalesce(max({_INFRA}::INT), 0) + coalesce(max({_CONTRACT}::INT), 0) * coalesce(max({_INFRA}::INT), 0) AS crosses FROM fp),
b AS (SELECT count(DISTINCT src) AS tests FROM ge WHERE type = 'Calls' AND dst IN (SELECT id FROM fp) AND src IN (SELECT id FROM gn WHERE {_TT})),
c AS (SELECT count(*) AS documents, coalesce(max((contains(lower(replace(coalesce(source, id), '\\', '/')), 'docs/features/') OR contains(lower(replace(coalesce(source, id), '\\', '/')), '{_FEATURE}') OR contains(lower(coalesce(content, '')), '{_FEATURE}'))::INT), 0) AS match FROM fd)
SELECT nodes, documents, tests, CASE WHEN documents = 0 AND nodes = 0 THEN 'not_found_in_graph' WHEN nodes = 0 THEN 'planned_or_documented_without_code_surface' WHEN documents > 0 AND tests > 0 THEN 'documented_with_code_and_test_evidence' WHEN documents > 0 THEN 'documented_with_possible_code_surface' ELSE 'possible_code_surface_without_feature_doc' END AS status,
 CASE WHEN match = 1 AND direct = 1 AND tests > 0 AND fresh = 1 THEN 'high' WHEN documents > 0 AND nodes > 0 THEN 'medium' ELSE 'low' END AS confidence,
 CASE WHEN nodes = 0 THEN 'unknown' WHEN (crosses > 0 AND tests = 0) OR stale > nodes // 3 THEN 'high' WHEN crosses > 0 OR tests = 0 OR nodes > 8 THEN 'medium' ELSE 'low' END AS risk FROM a, b, c"""

# Documents of a change
_CHANGED = "file_path LIKE 'src/Routing/%'"


def _change(s, d):
    n, docs = ingest_graph(s, d)[0], documents(s, d)
    has = K.extract_keywords(K.keyword_sources(n, docs))
    mine = n.where(_CHANGED)
    return R.change_documents(mine.select("file_path").distinct(), has.join(mine.select("id"), "id", "left_semi"), has.join(docs.select("id"), "id", "left_semi"), docs)


QUERIES["ref_C20_change_documents"] = _change
SQL["ref_C20_change_documents"] = f"""WITH {INGEST_GRAPH_SQL}, {DOCS_SQL}, {_HAS},
cn AS (SELECT * FROM gn WHERE {_CHANGED}),
cw AS (SELECT keyword, max(w) AS w FROM (SELECT unnest(string_split_regex(lower(file_path), '[/\\\\._-]')) AS keyword, 0.6::DOUBLE AS w FROM cn UNION ALL SELECT keyword, 1.5 * weight FROM hk WHERE id IN (SELECT id FROM cn)) WHERE length(trim(keyword)) >= 3 OR w <> 0.6 GROUP BY 1),
dd AS (SELECT id, replace(coalesce(source, ''), '\\', '/') AS source FROM kd WHERE coalesce(source, '') <> '' AND lower(replace(source, '\\', '/')) NOT IN (SELECT lower(replace(file_path, '\\', '/')) FROM cn)),
sc AS (SELECT hk.id, dd.source, round(sum(w * weight * CASE WHEN contains(lower(dd.source), hk.keyword) THEN 1.8 WHEN contains(lower(dd.source), 'docs/features/') THEN 1.25 WHEN ends_with(lower(dd.source), 'readme.md') OR ends_with(lower(dd.source), 'todo.md') THEN 1.15 ELSE 1.0 END::DOUBLE), 3) AS score
 FROM hk JOIN cw ON cw.keyword = hk.keyword JOIN dd ON dd.id = hk.id GROUP BY 1, 2 HAVING round(sum(w * weight * CASE WHEN contains(lower(dd.source), hk.keyword) THEN 1.8 WHEN contains(lower(dd.source), 'docs/features/') THEN 1.25 WHEN ends_with(lower(dd.source), 'readme.md') OR ends_with(lower(dd.source), 'todo.md') THEN 1.15 ELSE 1.0 END::DOUBLE), 3) >= 4)
SELECT source, id, score, CASE WHEN score >= 8 THEN 'High' ELSE 'Medium' END AS confidence FROM (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lower(source) ORDER BY score DESC, source, id) = 1) ORDER BY score DESC, lower(source), id LIMIT 20"""

# Implementation surface without its context
_SURFACE_TERMS = ["route", "index"]


def _pruned(s, d):
    from ..operators.scoring import implementation_surface

    n, _ = ingest_graph(s, d)
    return R.prune_surface(n, implementation_surface(n, _SURFACE_TERMS), _SURFACE_TERMS)


QUERIES["ref_C14_pruned_surface"] = _pruned
_HIT = "(" + " OR ".join(f"contains(lower(coalesce(name, '')), '{t}') OR contains(lower(coalesce(summary, '')), '{t}')" for t in _SURFACE_TERMS) + ")"
SQL["ref_C14_pruned_surface"] = f"""WITH {INGEST_GRAPH_SQL},
su AS ({_REPORT_SQL['ref_C14_C21_surface'].replace('HAVING count(*) > 10', 'HAVING false')}),
mt AS (SELECT *, {effective_role_sql('file_path', 'file_role')} AS eff, {_FRESH} AS fresh FROM gn WHERE {_HIT} AND file_path IN (SELECT file_path FROM su)),
pf AS (SELECT file_path, arg_min(fresh, {{'l': coalesce(line_number, 2147483647), 'i': id}}) AS fresh, arg_min(eff, id) AS role, max((lower(name) IN {sql_list(_SURFACE_TERMS)})::INT) AS exact, min({_CONTRACT}::INT) AS contract, max((type IN {sql_list(R.EDITABLE)})::INT) AS editable FROM mt GROUP BY 1),
al AS (SELECT su.file_path, score, CASE WHEN fresh = 'Low' THEN 'stale' WHEN regexp_matches(replace(su.file_path, '\\', '/'), '(?i)\\.(md|markdown|txt)$|/docs/|^docs/') THEN 'documentation' WHEN role = 'Test' THEN 'test' WHEN role IN {sql_list(R.WRITTEN_ROLES)} THEN 'generated'
 WHEN role = 'Configuration' AND coalesce(exact, 0) = 0 THEN 'configuration' WHEN contract = 1 THEN 'contract' WHEN editable = 0 THEN 'file-only' END AS reason FROM su JOIN pf ON pf.file_path = su.file_path),
pt AS (SELECT *, CASE WHEN reason IS NULL OR ((SELECT count(*) FROM al WHERE reason IS NULL) = 0 AND row_number() OVER (ORDER BY score DESC, file_path) = 1) THEN 'primary' ELSE 'context' END AS part FROM al)
SELECT file_path, score, part, CASE WHEN part = 'context' THEN reason END AS reason FROM pt QUALIFY row_number() OVER (PARTITION BY part ORDER BY score DESC, file_path) <= CASE part WHEN 'primary' THEN 5 ELSE 12 END"""

# Risk of replacing a dependency
QUERIES["ref_C18_replace_risk"] = lambda s, d: R.replace_risk(*ingest_graph(s, d), "tern-log")
SQL["ref_C18_replace_risk"] = f"""WITH {INGEST_GRAPH_SQL},
ed AS (SELECT DISTINCT src, dst, type FROM ge WHERE type IN {_TR}), mi AS (SELECT * FROM gn WHERE id IN (SELECT src FROM ed WHERE dst IN (SELECT id FROM gn WHERE contains(lower(coalesce(name, '')), 'tern-log') OR contains(lower(id), 'tern-log')))),
ab AS (SELECT id AS other, {_API} AS api, {_INFRA} AS infra, {_TT} AS is_test, lower(project_context) AS project FROM gn),
nr AS (SELECT x.id, x.type, out, ab.*, lower(mi.project_context) AS own FROM (SELECT src AS id, dst AS o, type, true AS out FROM ed WHERE src IN (SELECT id FROM mi) UNION ALL SELECT dst, src, type, false FROM ed WHERE dst IN (SELECT id FROM mi)) x JOIN ab ON ab.other = x.o JOIN mi ON mi.id = x.id),
g AS (SELECT id, max((out AND type = 'Implements')::INT) AS bases, max((NOT out AND api)::INT) AS by_api, max((out AND infra)::INT) AS on_infra, max((NOT out AND is_test AND type = 'Calls')::INT) AS tested, max((NOT out AND own IS DISTINCT FROM project)::INT) AS abroad FROM nr GROUP BY id),
r AS (SELECT coalesce(array_to_string(string_split(namespace, '.')[1:2], '.'), '(none)') AS module, CASE WHEN {_CONTRACT} OR coalesce(bases, 0) = 1 THEN 3 ELSE 0 END + CASE WHEN {_API} OR coalesce(by_api, 0) = 1 THEN 2 ELSE 0 END + CASE WHEN {_INFRA} OR coalesce(on_infra, 0) = 1 THEN 2 ELSE 0 END
 + CASE WHEN file_path IN (SELECT file_path FROM gn WHERE type = 'Diagnostic' AND file_path IS NOT NULL) THEN 2 ELSE 0 END + 2 * (1 - coalesce(tested, 0)) + CASE WHEN {_FRESH} = 'Low' THEN 2 ELSE 0 END + 2 * coalesce(abroad, 0) AS r FROM mi LEFT JOIN g ON g.id = mi.id)
SELECT module, count(*) AS nodes, sum(r)::BIGINT AS risk, count(*) FILTER (r <= 2) AS safe, CASE WHEN count(*) FILTER (r <= 2) = count(*) THEN 'Low' WHEN sum(r) >= 8 THEN 'High' WHEN sum(r) >= 4 THEN 'Medium' ELSE 'Low' END AS level FROM r GROUP BY 1"""
