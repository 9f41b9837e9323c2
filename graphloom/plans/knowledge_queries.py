"""Queries over documents, keywords and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import knowledge as K
from ..operators.versions import in_force
from ..sources.projection import INGEST_GRAPH_SQL, ingest_graph
from ..sources.tables import table
from ..functions.columns import SHORT_TERMS, STOPWORDS
from ..operators.model import sql_list

QUERIES: dict = {}
SQL: dict[str, str] = {}


def documents(spark, d):
    """Knowledge documents in force; doc_kind is the kind of their metadata."""
    raw = table(spark, d, "knowledge_docs")
    return in_force(raw, ["content", "source", "project_context", "created_at", "updated_at", F.col("metadata")["kind"].alias("doc_kind"), "related_node_ids_csv", "related_document_ids_csv"])


DOCS_SQL = """kd AS (SELECT id, content, source, project_context, created_at, updated_at, metadata['kind'] AS doc_kind, related_node_ids_csv, related_document_ids_csv
 FROM knowledge_docs WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, ingest_no DESC) = 1)"""


def _add(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        SQL[name] = f"WITH {INGEST_GRAPH_SQL}, {DOCS_SQL} {sql}"


def _tok(c: str) -> str:
    x = c
    for p in (r"(\p{Ll})(\p{Lu})", r"(\p{L})(\p{Nd})", r"(\p{Nd})(\p{L})", r"(\p{Lu})(\p{Lu}\p{Ll})"):
        x = f"regexp_replace({x}, '{p}', '\\1 \\2', 'g')"
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: x <> '')"


_CASES = " ".join(f"WHEN '{k}|{s}' THEN {w}" for k, m in K.SOURCE_WEIGHTS.items() for s, w in m.items())
_SOURCES = """ks AS (SELECT * FROM (
 SELECT id, kind, unnest(['name', 'summary', 'namespace', 'filePath', 'type']) AS source, unnest([name, summary, namespace, file_path, type]) AS text FROM (SELECT *, CASE WHEN type IN ('ApiEndpoint', 'Diagnostic', 'ExternalConcept') THEN type ELSE 'CodeNode' END AS kind FROM gn)
 UNION ALL SELECT id, 'KnowledgeDocument', unnest(['title', 'content', 'source', 'kind']), unnest([source, content, source, doc_kind]) FROM kd) WHERE text IS NOT NULL AND trim(text) <> '')"""
_HAS = f"""{_SOURCES},
kt AS (SELECT id, kind, source, unnest({_tok('text')}) AS keyword FROM ks),
kf AS (SELECT * FROM kt WHERE NOT regexp_full_match(keyword, '[0-9a-f]{{16,}}') AND NOT regexp_full_match(keyword, '\\p{{Nd}}+') AND keyword NOT IN {sql_list(STOPWORDS)} AND (length(keyword) >= 4 OR keyword IN {sql_list(SHORT_TERMS)})),
kp AS (SELECT id, kind, source, keyword, count(*) AS n FROM kf GROUP BY ALL),
ka AS (SELECT id, keyword, sum(n)::BIGINT AS count, sum(CASE kind || '|' || source {_CASES} ELSE 0.2 END::DOUBLE) AS w FROM kp GROUP BY ALL),
kw AS (SELECT id, keyword, count, round(w * (1 + log10(count)), 4) AS weight FROM ka),
hk AS MATERIALIZED (SELECT * FROM kw QUALIFY row_number() OVER (PARTITION BY id ORDER BY weight DESC, count DESC, keyword) <= 40)"""
_KIND = " ".join(f"WHEN keyword IN {sql_list(w)} THEN '{k}'" for k, w in K.CLASS_TERMS.items())
_FACT = " ".join(f"WHEN '{k}' THEN {f}" for k, f in K.CLASS_FACTOR.items())
_CLASSES = f"""stt AS (SELECT keyword, count(DISTINCT id) AS document_frequency, sum(count)::BIGINT AS total_frequency FROM hk GROUP BY keyword),
rc AS (SELECT (SELECT count(*) FROM gn) + (SELECT count(*) FROM kd) AS records),
c1 AS (SELECT stt.*, document_frequency / records::DOUBLE >= 0.35 AS is_common FROM stt, rc),
c2 AS (SELECT *, CASE WHEN keyword IN {sql_list(K.NOISE_TERMS)} THEN 'Noise' WHEN is_common THEN 'CommonProjectTerm' {_KIND} ELSE 'Unknown' END AS classification FROM c1),
kc AS (SELECT keyword, document_frequency, total_frequency, classification, is_common, classification = 'Noise' AS is_noise,
 round(CASE WHEN classification = 'Noise' THEN 0.0 ELSE total_frequency / document_frequency::DOUBLE * CASE classification {_FACT} ELSE 1.0 END * CASE WHEN is_common THEN 0.35 ELSE 1.0 END END, 6) AS usefulness FROM c2)"""


def _has(spark, d):
    n, _ = ingest_graph(spark, d)
    docs = documents(spark, d)
    return n, docs, K.extract_keywords(K.keyword_sources(n, docs))


def _classes(spark, d):
    n, docs, has = _has(spark, d)
    return n, docs, has, K.classify_keywords(K.keyword_statistics(has), n.select("id").unionByName(docs.select("id")))


_add("ref_R4_extract_keywords", lambda s, d: _has(s, d)[2], f", {_HAS} SELECT * FROM hk")
_add("ref_R3_keyword_statistics", lambda s, d: K.keyword_statistics(_has(s, d)[2]), f", {_HAS} SELECT keyword, count(DISTINCT id) AS document_frequency, sum(count)::BIGINT AS total_frequency FROM hk GROUP BY keyword")
_add("ref_R5_classify_keywords", lambda s, d: _classes(s, d)[3], f", {_HAS}, {_CLASSES} SELECT * FROM kc")


def _related(s, d):
    n, docs, has, classes = _classes(s, d)
    source = docs.agg(F.min("id").alias("id")).first()["id"]
    return K.related_by_keywords(has, classes, source or "", n.count() + docs.count())


_REL = """sr AS (SELECT min(id) AS id FROM kd), mx AS (SELECT ceil(records * 0.35) AS most FROM rc),
mine AS (SELECT hk.keyword, weight AS w, usefulness FROM hk JOIN kc ON kc.keyword = hk.keyword WHERE hk.id = (SELECT id FROM sr) AND NOT is_noise AND document_frequency <= (SELECT most FROM mx)),
rel AS (SELECT hk.id, count(DISTINCT hk.keyword) AS shared, sum(w * weight * usefulness) AS sc, array_to_string(list_sort(list(DISTINCT hk.keyword))[1:20], ',') AS keywords FROM hk JOIN mine ON mine.keyword = hk.keyword WHERE hk.id <> (SELECT id FROM sr) GROUP BY hk.id HAVING count(DISTINCT hk.keyword) >= 3 AND sum(w * weight * usefulness) >= 0.25),
rl AS (SELECT id, shared, round(sc, 4) AS score, keywords FROM rel ORDER BY round(sc, 4) DESC, shared DESC, id LIMIT 20)"""
_add("ref_J9_related_by_keywords", _related, f", {_HAS}, {_CLASSES}, {_REL} SELECT * FROM rl")
_add("ref_R6_related_confidence", lambda s, d: K.related_confidence(_related(s, d)), f""", {_HAS}, {_CLASSES}, {_REL}
SELECT id, shared, score, CASE WHEN len(list_filter(string_split(keywords, ','), lambda x: x NOT IN {sql_list(K.CONFIDENCE_STOPS)})) = 0 THEN 'awareness' WHEN shared >= 5 OR score >= 0.6 THEN 'high' WHEN shared >= 4 OR score >= 0.4 THEN 'medium' ELSE 'awareness' END AS confidence FROM rl""")


def _bm25(source, text, words):
    return f""", tk AS (SELECT id, {_tok(text)} AS t FROM {source} WHERE {text} IS NOT NULL), al AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tk),
h AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM tk) WHERE term IN {sql_list(words)} GROUP BY ALL), dfr AS (SELECT term, count(*) AS df FROM h GROUP BY term)
SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM h JOIN dfr ON dfr.term = h.term, al GROUP BY id ORDER BY score DESC, id LIMIT 10"""


_add("ref_S3_node_search", lambda s, d: K.bm25(ingest_graph(s, d)[0], F.concat_ws(" ", "name", "summary"), "stale graph lease"), _bm25("(SELECT id, concat_ws(' ', name, summary) AS x FROM gn)", "x", ["stale", "graph", "lease"]))
_add("ref_S5_document_search", lambda s, d: K.bm25(documents(s, d), F.concat_ws(" ", "content", "source"), "nightly scheduler lease"), _bm25("(SELECT id, concat_ws(' ', content, source) AS x FROM kd)", "x", ["nightly", "scheduler", "lease"]))
_add("ref_S2_node_scan", lambda s, d: K.node_scan(ingest_graph(s, d)[0], "resolve", "src/", "Method"), "SELECT id, name, type FROM gn WHERE contains(lower(name), 'resolve') AND contains(lower(file_path), 'src/') AND type = 'Method' ORDER BY id LIMIT 100")
_add("ref_S4_document_list", lambda s, d: K.document_list(documents(s, d), "TidalLedger"), "SELECT id, source, updated_at FROM kd WHERE coalesce(doc_kind, '') <> 'human-cognitive-seed' AND lower(project_context) = 'tidalledger' ORDER BY updated_at DESC NULLS LAST, id LIMIT 200")
_add("ref_doc_chunks", lambda s, d: K.chunks(documents(s, d), 400))
_add("ref_doc_references", lambda s, d: K.document_references(documents(s, d)).where("kind = 'code'"), r""", x AS (SELECT DISTINCT id, unnest(regexp_extract_all(content, '`([A-Za-z0-9_./\\-]+\.(?:cs|tsx?|jsx?|html|css|json|ya?ml))`', 1)) AS target FROM kd)
SELECT DISTINCT id, 'code' AS kind, regexp_replace(regexp_replace(replace(target, '\', '/'), '(^|/)(\./)+', '\1', 'g'), '^/+|/+$|(/)/+', '\1', 'g') AS target FROM x""")
_add("ref_doc_links", lambda s, d: K.document_references(documents(s, d)).where("kind != 'code'"))
_add("ref_J11_mentions", lambda s, d: K.mentions(documents(s, d), ingest_graph(s, d)[0]), """, a AS (SELECT DISTINCT id, trim(unnest(regexp_split_to_array(related_node_ids_csv, '[,;|\\r\\n]'))) AS target FROM kd), b AS (SELECT DISTINCT id, trim(unnest(regexp_split_to_array(related_document_ids_csv, '[,;|\\r\\n]'))) AS key FROM kd)
SELECT DISTINCT id, 'Mentions' AS type, target FROM a WHERE target IN (SELECT id FROM gn) UNION ALL SELECT DISTINCT b.id, 'References', t.id FROM b JOIN kd t ON t.id = b.key OR t.source = b.key WHERE b.key <> ''""")
_add("ref_symbol_mentions", lambda s, d: K.symbol_mentions(documents(s, d), ingest_graph(s, d)[0]), r""", x AS (SELECT DISTINCT id, unnest(regexp_extract_all(regexp_replace(content, '(?s)```.*?```', ' ', 'g'), '`([A-Z][A-Za-z0-9]*(?:[A-Z][A-Za-z0-9]*|\.[A-Za-z][A-Za-z0-9]*)+)`', 1)) AS symbol FROM kd)
SELECT id, symbol, split_part(symbol, '.', -1) IN (SELECT name FROM gn WHERE name IS NOT NULL) AS known FROM x""")


def _vectors(s, d):
    return table(s, d, "embeddings").withColumnRenamed("vec_id", "id")


def _query_vector(s, d, i=0):
    return [float(x) for x in table(s, d, "embeddings").where(f"vec_id = {i}").first()["embedding"]]


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[])"
QUERIES["ref_S6_vector_search"] = lambda s, d: K.vector_search(_vectors(s, d), _query_vector(s, d), 10, 3)
SQL["ref_S6_vector_search"] = f"WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0) SELECT vec_id AS id, label, round({_COS}, 6) AS cosine FROM embeddings a, q WHERE label = 3 ORDER BY cosine DESC, id LIMIT 10"
QUERIES["ref_C7_similar_nodes"] = lambda s, d: K.similar_nodes(_vectors(s, d), 7)
SQL["ref_C7_similar_nodes"] = f"""WITH q AS (SELECT embedding, label AS own FROM embeddings WHERE vec_id = 7), t AS (SELECT vec_id AS id, round((1 + {_COS}) / 2, 6) AS score, label = own AS same_family FROM embeddings a, q WHERE vec_id <> 7 ORDER BY score DESC, id LIMIT 10)
SELECT *, same_family AND score >= 0.85 AS is_primary FROM t"""
QUERIES["ref_C8_hybrid_search"] = lambda s, d: K.hybrid_search(_vectors(s, d), 7, _vectors(s, d).where("label < 5").select("id"), 20)
SQL["ref_C8_hybrid_search"] = f"WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 7), t AS (SELECT vec_id AS id, label, round({_COS}, 6) AS cosine FROM embeddings a, q ORDER BY cosine DESC, id LIMIT 21) SELECT id, cosine FROM t WHERE label < 5"
QUERIES["ref_C8_hybrid_strict"] = lambda s, d: K.hybrid_search(_vectors(s, d), 7, _vectors(s, d).where("label < 5").select("id"), 20, True)
SQL["ref_C8_hybrid_strict"] = f"WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 7) SELECT vec_id AS id, round({_COS}, 6) AS cosine FROM embeddings a, q WHERE label < 5 ORDER BY cosine DESC, id LIMIT 21"
