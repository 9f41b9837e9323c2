"""Queries for references to records that do not exist."""

from __future__ import annotations

from ..operators.references import missing_reference_report, missing_references
from ..sources.tables import table


def _args(spark, d):
    return [table(spark, d, n) for n in ("edges", "nodes", "node_deletions", "external_concepts")]


def p1_found(spark, d):
    return missing_references(*_args(spark, d)).select("row_no", "side").withColumnRenamed("row_no", "edge_no")


def p1_report(spark, d):
    return missing_reference_report(*_args(spark, d))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report}

_REFS = """
refs AS (
  SELECT edge_no, 'src' AS side, src AS id, indexed_at AS t FROM edges
  UNION ALL SELECT edge_no, 'dst', dst, indexed_at FROM edges),
good AS (SELECT * FROM refs WHERE id IS NOT NULL AND NOT regexp_full_match(id, '\\s*')),
lasts AS (
  SELECT g.edge_no, g.side, g.id, g.t, max(n.last_indexed_at) AS l
  FROM good g LEFT JOIN nodes n ON n.id = g.id AND n.last_indexed_at <= g.t GROUP BY ALL),
gone AS (
  SELECT l.edge_no, l.side, max(d.deleted_at) AS dl
  FROM lasts l JOIN node_deletions d ON d.node_id = l.id AND d.deleted_at <= l.t GROUP BY ALL),
bad AS (
  SELECT l.edge_no, l.side, l.id, l.t,
    CASE WHEN l.id NOT IN (SELECT id FROM nodes WHERE id IS NOT NULL AND last_indexed_at IS NOT NULL) THEN 'never'
         WHEN l.l IS NULL THEN 'later' ELSE 'deleted' END AS reason
  FROM lasts l LEFT JOIN gone g ON g.edge_no = l.edge_no AND g.side = l.side
  WHERE l.id NOT IN (SELECT id FROM external_concepts WHERE id IS NOT NULL)
    AND (l.l IS NULL OR g.dl > l.l))
"""
_CELL = "side, CASE WHEN starts_with(id, 'ExternalConcept:') THEN 'external_concepts' ELSE 'nodes' END AS parent, strftime(t, '%Y-%m') AS month"
SQL = {
    "p1_found": f"WITH {_REFS} SELECT edge_no, side FROM bad",
    "p1_report": f"""WITH {_REFS},
total AS (SELECT {_CELL}, count(*) AS refs FROM good GROUP BY ALL),
miss AS (SELECT {_CELL}, count(*) AS missing, count(DISTINCT id) AS ids_missing,
  count(*) FILTER (reason = 'never') AS never_indexed, count(*) FILTER (reason = 'later') AS indexed_later,
  count(*) FILTER (reason = 'deleted') AS deleted FROM bad GROUP BY ALL)
SELECT t.side, t.parent, t.month, t.refs, coalesce(m.missing, 0) AS missing, coalesce(m.ids_missing, 0) AS ids_missing,
  coalesce(m.never_indexed, 0) AS never_indexed, coalesce(m.indexed_later, 0) AS indexed_later, coalesce(m.deleted, 0) AS deleted
FROM total t LEFT JOIN miss m ON m.side = t.side AND m.parent = t.parent AND m.month IS NOT DISTINCT FROM t.month""",
}
