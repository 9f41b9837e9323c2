"""Queries of the whole-graph algorithms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import algorithms as A
from ..operators.model import COMMUNITY, TRAVERSAL, sql_list
from ..sources.projection import INGEST_GRAPH_SQL, ORDER_GRAPH_SQL, ingest_graph, order_graph

QUERIES: dict = {}
SQL: dict[str, str] = {}
_TR = sql_list(TRAVERSAL)


def _add(name, graph, run, sql=None):
    QUERIES[name] = lambda spark, d: run(*graph(spark, d))
    if sql:
        SQL[name] = f"WITH RECURSIVE {ORDER_GRAPH_SQL if graph is order_graph else INGEST_GRAPH_SQL}, {sql}"


def _rank(n, e, rounds):
    steps = "".join(
        f", r{k + 1} AS MATERIALIZED (SELECT r{k}.id, 0.15 + 0.85 * coalesce(g.got, 0) AS score FROM r{k} LEFT JOIN (SELECT b, sum(score * w) AS got FROM lk JOIN r{k} ON a = id GROUP BY b) g ON g.b = r{k}.id)"
        for k in range(rounds)
    )
    return f"""ev AS (SELECT src AS a, dst AS b, count(*) AS c FROM {e} WHERE type IN {_TR} GROUP BY 1, 2), lk AS MATERIALIZED (SELECT a, b, c::DOUBLE / sum(c) OVER (PARTITION BY a) AS w FROM ev),
r0 AS (SELECT id, 0.15::DOUBLE AS score FROM {n}){steps} SELECT id, round(score, 6) AS score FROM r{rounds}"""


_score = lambda df: df.select("id", F.round("score", 6).alias("score"))
_add("ref_A1_pagerank", order_graph, lambda n, e: _score(A.pagerank(n, e)).orderBy(F.desc("score"), "id").limit(20), _rank("n", "e", 20) + " ORDER BY score DESC, id LIMIT 20")
_add("ref_A1_pagerank_all_ingest", ingest_graph, lambda n, e: A.pagerank(n, e).select("id", F.round(F.col("score") + 1e-7, 4).alias("score")), _rank("gn", "ge", 20).replace("round(score, 6)", "round(score + 1e-7, 4)"))


_UND = f"""un AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM ge WHERE type IN {_TR} UNION ALL SELECT dst, src FROM ge WHERE type IN {_TR}) WHERE a <> b)"""
_CC = """cc AS (SELECT a AS id, a AS other FROM un UNION SELECT cc.id, un.b FROM cc JOIN un ON un.a = cc.other)"""
def _betweenness(depth: int) -> str:
    """Ways from every source level by level (neighbours that are in neither of the last two levels), then what each
    source leans on its nodes from the farthest level back. A graph may be so deep."""
    out = "b0 AS MATERIALIZED (SELECT DISTINCT a AS s, a AS id, 1.0::DOUBLE AS ways FROM un)"
    for k in range(depth):
        seen = " ".join(f"AND NOT EXISTS (SELECT 1 FROM b{j} o WHERE o.s = x.s AND o.id = un.b)" for j in ({k, k - 1} - {-1}))
        out += f", b{k + 1} AS MATERIALIZED (SELECT x.s, un.b AS id, sum(ways) AS ways FROM b{k} x JOIN un ON un.a = x.id WHERE true {seen} GROUP BY 1, 2)"
    for k in range(depth - 1, 0, -1):
        dep, join = ("(1 + coalesce(z.dep, 0))", f"LEFT JOIN l{k + 1} z ON z.s = y.s AND z.id = y.id") if k < depth - 1 else ("1", "")
        out += f", l{k} AS MATERIALIZED (SELECT x.s, x.id, sum(x.ways / y.ways * {dep}) AS dep FROM b{k} x JOIN un ON un.a = x.id JOIN b{k + 1} y ON y.s = x.s AND y.id = un.b {join} GROUP BY 1, 2)"
    levels = " UNION ALL ".join(f"SELECT id, dep FROM l{k}" for k in range(1, depth))
    return f"{out} SELECT v.id, round(coalesce(sum(dep), 0) / 2, 6) AS score FROM (SELECT DISTINCT a AS id FROM un) v LEFT JOIN ({levels}) x ON x.id = v.id GROUP BY v.id"


_add("ref_A2_betweenness", ingest_graph, lambda n, e: _score(A.betweenness(n, e)), f"{_UND}, {_betweenness(30)}")
_add("ref_A3_articulation_points", ingest_graph, lambda n, e: A.articulation_points(n, e), f"""{_UND},
rv AS (SELECT DISTINCT a AS v, b AS st_, b AS at_ FROM un UNION SELECT rv.v, rv.st_, un.b FROM rv JOIN un ON un.a = rv.at_ WHERE un.b <> rv.v),
c AS (SELECT v, st_, min(at_) AS c FROM rv GROUP BY 1, 2) SELECT v AS id, count(DISTINCT c) AS parts FROM c GROUP BY v HAVING count(DISTINCT c) > 1""")
_add("ref_A3_articulation_points_order", order_graph, lambda n, e: A.articulation_points(n, e), None)
_add("ref_A4_bridges", ingest_graph, lambda n, e: A.bridges(n, e).select("a", "b", F.col("sizes")[0].alias("larger"), F.col("sizes")[1].alias("smaller")), f"""{_UND}, {_CC},
sz AS (SELECT id, count(*) AS whole FROM cc GROUP BY id),
ed AS MATERIALIZED (SELECT a, b FROM un WHERE a < b),
rc AS (SELECT a, b, a AS at_ FROM ed UNION SELECT rc.a, rc.b, un.b FROM rc JOIN un ON un.a = rc.at_ WHERE NOT (un.a = rc.a AND un.b = rc.b) AND NOT (un.a = rc.b AND un.b = rc.a)),
si AS (SELECT a, b, count(*) AS part FROM rc GROUP BY 1, 2)
SELECT si.a, si.b, greatest(part, whole - part) AS larger, least(part, whole - part) AS smaller FROM si JOIN sz ON sz.id = si.a WHERE NOT EXISTS (SELECT 1 FROM rc WHERE rc.a = si.a AND rc.b = si.b AND rc.at_ = si.b)""")
_add("ref_A4_bridges_order", order_graph, lambda n, e: A.bridges(n, e))
_add("ref_A5_communities", ingest_graph, lambda n, e: A.communities(n, e, ["Calls"]).orderBy("community", "id").limit(200))
_add("ref_A6_communities_of", ingest_graph, lambda n, e: A.communities(n, e, COMMUNITY).join(n.where("type = 'Class'").select("id"), "id", "left_semi"))
_add("ref_R18_community_report", ingest_graph, lambda n, e: A.community_report(n, A.communities(n, e, COMMUNITY)))
_add("ref_A7_no_projection", ingest_graph, lambda n, e: A.projected(n, e, ["SubscribesTo"]), "zz AS (SELECT 1) SELECT src AS a, dst AS b FROM ge WHERE type = 'SubscribesTo'")
_add("ref_A8_risky_core", ingest_graph, lambda n, e: A.risky_core(n, e))
