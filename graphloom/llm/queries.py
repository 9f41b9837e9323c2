"""Queries of the operators for training data, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.versions import in_force
from ..sources.tables import table
from .bpe import encode_column
from .files import not_hand_written
from .functions import function_pairs
from .neighbours import search_vectors, similar_pairs, usable_vectors
from .packing import pack
from .spans import SharedSpans
from .terms import term_counts


def p2_found(spark, d):
    return similar_pairs(usable_vectors(table(spark, d, "nodes")), 64)


def p2_search(spark, d):
    """Nearest vectors of every node in force whose ingest number is divisible by 100, by search on the graph."""
    vectors = usable_vectors(table(spark, d, "nodes"))
    last = in_force(table(spark, d, "nodes"), [F.col("ingest_no").alias("q")]).where("q % 100 = 0")
    return search_vectors(vectors, vectors.join(last, "id").select("q", "vec"), 64)


def p3_found(spark, d):
    return not_hand_written(table(spark, d, "nodes"), table(spark, d, "third_party_files")).select("id")


def p4_found(spark, d):
    return function_pairs(table(spark, d, "nodes")).select("id")


def p4_pairs(spark, d):
    return function_pairs(table(spark, d, "nodes"))


def _texts(spark, d):
    """Summaries of nodes and contents of knowledge documents, rows in force only."""
    return (
        in_force(table(spark, d, "nodes"), [F.col("summary").alias("text")])
        .select("text")
        .unionByName(in_force(table(spark, d, "knowledge_docs"), [F.col("content").alias("text")]).select("text"))
    )


def p5_found(spark, d):
    return term_counts(_texts(spark, d)).where("mark is not null").select("term", "mark")


def p5_counts(spark, d):
    return term_counts(_texts(spark, d))


def p6_ids(spark, d):
    return encode_column(table(spark, d, "documents"))


def p7_containers(spark, d):
    return pack(table(spark, d, "documents"))


def p8_found(spark, d):
    return SharedSpans(table(spark, d, "documents")).document_pairs()


def p8_shared(spark, d):
    docs = table(spark, d, "documents")
    return SharedSpans(docs).report(docs)


QUERIES = {f.__name__: f for f in (p2_found, p2_search, p3_found, p4_found, p4_pairs, p5_found, p5_counts, p6_ids, p7_containers, p8_found, p8_shared)}

_FORCE = "QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, ingest_no DESC) = 1"
_TERMS = f"""
recs AS (
  SELECT 'n' || ingest_no AS rec, summary AS text FROM (SELECT * FROM nodes WHERE id IS NOT NULL {_FORCE})
  UNION ALL SELECT 'k' || ingest_no, content FROM (SELECT * FROM knowledge_docs WHERE id IS NOT NULL {_FORCE})),
split AS (SELECT rec, unnest(regexp_extract_all(lower(nfc_normalize(text)), '[\\p{{L}}\\p{{N}}]+')) AS term FROM recs),
counts AS (SELECT term, count(*)::BIGINT AS occurrences, count(DISTINCT rec)::BIGINT AS records FROM split GROUP BY term),
marked AS (SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records >= (SELECT count(DISTINCT rec) FROM split) / 10.0 THEN 'common' END AS mark FROM counts)
"""
_GRAMS = """
t AS (SELECT doc_id, text FROM documents WHERE length(text) >= 200),
g AS (SELECT doc_id, md5(substring(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 199)) AS i FROM t)),
u AS (SELECT DISTINCT doc_id, h FROM g)
"""
_VECTORS = f"""
forced AS (SELECT id, embedding_csv FROM nodes WHERE id IS NOT NULL {_FORCE}),
lists AS (SELECT id, list_transform(list_filter(list_transform(string_split(embedding_csv, ','), lambda x: trim(x)), lambda x: x <> ''), lambda x: TRY_CAST(x AS DOUBLE)) AS v FROM forced),
good AS (SELECT id, v::DOUBLE[64] AS v FROM lists WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
c AS (SELECT a.id AS x, b.id AS y, round(array_cosine_similarity(a.v, b.v), 6) AS cos FROM good a JOIN good b ON a.id <> b.id),
top AS (SELECT * FROM c WHERE cos >= 0.92 QUALIFY row_number() OVER (PARTITION BY x ORDER BY cos DESC, y) <= 5)
"""
SQL = {
    "p2_found": f"WITH {_VECTORS} SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM top",
    "p5_found": f"WITH {_TERMS} SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p5_counts": f"WITH {_TERMS} SELECT * FROM marked",
    "p8_found": f"WITH {_GRAMS} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id",
}
