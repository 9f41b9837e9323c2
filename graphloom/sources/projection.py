"""Two graphs over the supplied tables: one from the order tables, one from the ingested node and edge rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.model import EDGE_TYPES, FILE_ROLES, NODE_TYPES
from ..operators.versions import in_force
from .tables import table

_SEGMENT = {"AUTOMOBILE": "Core", "BUILDING": "Application", "FURNITURE": "Tests", "HOUSEHOLD": "Infrastructure", "MACHINERY": "Api"}
_PART = {"ECONOMY": "Core", "STANDARD": "Core", "LARGE": "Application", "MEDIUM": "Infrastructure", "SMALL": "Infrastructure", "PROMO": "Api"}
_PART_TYPE = {"LARGE": "Interface", "MEDIUM": "Method", "PROMO": "ApiEndpoint", "SMALL": "ExternalConcept"}


def _case(column: str, names: dict[str, str], other: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {other} END"


def canonical(column: str, names: list[str], other: str = "NULL") -> str:
    """SQL for the canonical spelling of a name given in any letter case."""
    return _case(f"lower(trim({column}))", {n.lower(): n for n in names}, other)


_N = ["id", "name", "type", "namespace", "file_path", "line_count", "source_hash", "file_role", "project_context", "change_count", "created_at", "updated_at", "external_kind", "recognition"]
_NULLS = {
    "file_path": "string", "line_count": "int", "source_hash": "string", "change_count": "bigint", "created_at": "timestamp", "updated_at": "timestamp",
    "external_kind": "string", "recognition": "double",
}


def _nodes(df: DataFrame, **cols: str) -> DataFrame:
    kinds = _NULLS
    return df.select(*[
        (F.expr(cols[c]) if c in cols else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in _N
    ])


def order_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the order tables: regions, nations, customers, orders, parts and suppliers.

    Customers are classes in layers by market segment, orders their methods, suppliers topics and tables; line
    items give the calls, uses, reads and writes.
    """
    t = lambda n: table(spark, d, n)
    region, nation, customer, orders, part, supplier, line = (t(n) for n in ("region", "nation", "customer", "orders", "part", "supplier", "lineitem"))
    where = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", "n_name", "r_name")
    seg = _case("c_mktsegment", _SEGMENT)
    cust = customer.join(where, customer["c_nationkey"] == where["n_nationkey"]).withColumn("layer", F.expr(seg)).select(
        "c_custkey", "c_name", "c_acctbal", "layer", "n_name", "r_name"
    ).withColumn("ns", F.expr("r_name || '.' || n_name || '.' || layer")).withColumn(
        "path", F.expr("CASE WHEN layer = 'Tests' THEN 'tests/' || n_name || '/' || c_name || 'Tests.cs' ELSE 'src/' || layer || '/' || n_name || '/' || c_name || '.cs' END")
    ).withColumn("role", F.expr("CASE WHEN layer = 'Tests' THEN 'Test' ELSE 'Source' END"))
    stats = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    nodes = [
        _nodes(region, id="'region:' || r_regionkey", name="r_name", type="'Namespace'", namespace="r_name", file_role="'Unknown'", project_context="r_name"),
        _nodes(where, id="'nation:' || n_nationkey", name="n_name", type="'Module'", namespace="r_name || '.' || n_name", file_path="'src/' || n_name || '/index.ts'", file_role="'Source'", project_context="r_name"),
        _nodes(
            cust.join(stats, F.col("c_custkey") == F.col("o_custkey"), "left"), id="'customer:' || c_custkey", name="c_name", type="'Class'", namespace="ns", file_path="path",
            line_count="floor(abs(c_acctbal) / 10)", source_hash="CASE WHEN c_acctbal >= 0 THEN sha2(c_name, 256) END", file_role="role", project_context="r_name",
            change_count="coalesce(n, 0)", created_at="lo", updated_at="hi",
        ),
        _nodes(
            orders.join(cust, F.col("o_custkey") == F.col("c_custkey")), id="'order:' || o_orderkey", name="'order' || o_orderkey", type="'Method'", namespace="ns", file_path="path",
            line_count="floor(o_totalprice / 5000)", source_hash="sha2('order' || o_orderkey, 256)", file_role="role", project_context="r_name", created_at="o_orderdate", updated_at="o_orderdate",
        ),
        _nodes(
            part, id="'part:' || p_partkey", name="p_name || ' ' || p_partkey", type=_case("p_type", _PART_TYPE, "'Class'"), namespace=f"'Catalog.' || p_brand || '.' || ({_case('p_type', _PART)})",
            file_path=f"'src/' || ({_case('p_type', _PART)}) || '/' || p_brand || '/Part' || p_partkey || '.cs'", line_count="p_size * 10", source_hash="sha2(p_name, 256)", file_role="'Source'",
            project_context="'Catalog'", external_kind="CASE WHEN p_type = 'SMALL' THEN 'DatabaseOperation' END", recognition="CASE WHEN p_type = 'SMALL' THEN p_size / 50.0D END",
        ),
        _nodes(
            supplier.join(where, F.col("s_nationkey") == F.col("n_nationkey")), id="'supplier:' || s_suppkey", name="s_name",
            type="CASE WHEN s_suppkey % 2 = 0 THEN 'MessageTopic' ELSE 'DatabaseTable' END", namespace="r_name || '.' || n_name || '.Persistence'", file_role="'Unknown'", project_context="r_name",
        ),
    ]
    out = nodes[0]
    for n in nodes[1:]:
        out = out.unionByName(n)

    e = lambda df, src, dst, type, confidence="1.0D": df.select(F.expr(src).alias("src"), F.expr(dst).alias("dst"), F.expr(type).alias("type"), F.expr(confidence).cast("double").alias("confidence"))
    from pyspark.sql import Window

    after = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    follow = orders.withColumn("next", F.lead("o_orderkey").over(after)).where("next is not null")
    lines = line.groupBy("l_orderkey", "l_partkey").agg(F.max("l_discount").alias("disc")).join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    first = line.where("l_linenumber = 1")
    flags = first.select("l_orderkey", "l_suppkey", "l_returnflag").distinct()
    pairs = first.where("l_quantity >= 40").groupBy("l_partkey", "l_suppkey").agg(F.min(F.struct("l_orderkey", "l_returnflag")).alias("m")).join(
        part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")
    )
    std, large = part.where("p_type = 'STANDARD'"), part.where("p_type = 'LARGE'").select(F.col("p_partkey").alias("q"), "p_brand", "p_size")
    edges = [
        e(nation, "'region:' || n_regionkey", "'nation:' || n_nationkey", "'Contains'"),
        e(customer.where("c_acctbal >= 0"), "'nation:' || c_nationkey", "'customer:' || c_custkey", "'Contains'"),
        e(orders, "'customer:' || o_custkey", "'order:' || o_orderkey", "'Contains'"),
        e(follow, "'order:' || o_orderkey", "'order:' || next", "'Calls'", "CASE WHEN o_orderpriority < '3' THEN 0.9D ELSE 1.0D END"),
        e(lines, "'order:' || l_orderkey", "'part:' || l_partkey", "CASE WHEN p_type = 'PROMO' THEN 'Uses' ELSE 'Calls' END", "1 - disc"),
        e(flags, "'order:' || l_orderkey", "'supplier:' || l_suppkey", "CASE l_returnflag WHEN 'R' THEN 'Reads' WHEN 'A' THEN 'Writes' ELSE 'PublishesTo' END"),
        e(pairs.where("m.l_returnflag <> 'A'"), "'part:' || l_partkey", "'supplier:' || l_suppkey", "CASE WHEN p_type = 'SMALL' THEN 'Writes' ELSE 'DependsOn' END"),
        e(pairs.where("m.l_returnflag = 'A'"), "'supplier:' || l_suppkey", "'part:' || l_partkey", "'DependsOn'"),
        e(std.join(large, ["p_brand", "p_size"]), "'part:' || p_partkey", "'part:' || q", "'Implements'"),
    ]
    all_ = edges[0]
    for x in edges[1:]:
        all_ = all_.unionByName(x)
    return out, all_


_DK = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "timestamp": "TIMESTAMP", "double": "DOUBLE"}


def _sql(source: str, **cols: str) -> str:
    return "SELECT " + ", ".join(f"CAST({cols.get(c, 'NULL')} AS {_DK[_NULLS.get(c, 'string')]}) AS {c}" for c in _N) + f" FROM {source}"


#: The same graph for DuckDB: common table expressions n and e.
ORDER_GRAPH_SQL = f"""
w AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
cu AS (SELECT *, r_name || '.' || n_name || '.' || layer AS ns,
  CASE WHEN layer = 'Tests' THEN 'tests/' || n_name || '/' || c_name || 'Tests.cs' ELSE 'src/' || layer || '/' || n_name || '/' || c_name || '.cs' END AS path,
  CASE WHEN layer = 'Tests' THEN 'Test' ELSE 'Source' END AS role
  FROM (SELECT *, {_case('c_mktsegment', _SEGMENT)} AS layer FROM customer JOIN w ON c_nationkey = n_nationkey)),
cst AS (SELECT o_custkey AS k, count(*) AS cnt, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY o_custkey),
n AS (
{_sql('region', id="'region:' || r_regionkey", name='r_name', type="'Namespace'", namespace='r_name', file_role="'Unknown'", project_context='r_name')}
UNION ALL {_sql('w', id="'nation:' || n_nationkey", name='n_name', type="'Module'", namespace="r_name || '.' || n_name", file_path="'src/' || n_name || '/index.ts'", file_role="'Source'", project_context='r_name')}
UNION ALL {_sql('cu LEFT JOIN cst ON k = c_custkey', id="'customer:' || c_custkey", name='c_name', type="'Class'", namespace='ns', file_path='path', line_count='floor(abs(c_acctbal) / 10)', source_hash="CASE WHEN c_acctbal >= 0 THEN sha256(c_name) END", file_role='role', project_context='r_name', change_count='coalesce(cnt, 0)', created_at='lo', updated_at='hi')}
UNION ALL {_sql('orders JOIN cu ON o_custkey = c_custkey', id="'order:' || o_orderkey", name="'order' || o_orderkey", type="'Method'", namespace='ns', file_path='path', line_count='floor(o_totalprice / 5000)', source_hash="sha256('order' || o_orderkey)", file_role='role', project_context='r_name', created_at='o_orderdate', updated_at='o_orderdate')}
UNION ALL {_sql('part', id="'part:' || p_partkey", name="p_name || ' ' || p_partkey", type=_case('p_type', _PART_TYPE, "'Class'"), namespace=f"'Catalog.' || p_brand || '.' || ({_case('p_type', _PART)})", file_path=f"'src/' || ({_case('p_type', _PART)}) || '/' || p_brand || '/Part' || p_partkey || '.cs'", line_count='p_size * 10', source_hash='sha256(p_name)', file_role="'Source'", project_context="'Catalog'", external_kind="CASE WHEN p_type = 'SMALL' THEN 'DatabaseOperation' END", recognition="CASE WHEN p_type = 'SMALL' THEN p_size / 50.0 END")}
UNION ALL {_sql('supplier JOIN w ON s_nationkey = n_nationkey', id="'supplier:' || s_suppkey", name='s_name', type="CASE WHEN s_suppkey % 2 = 0 THEN 'MessageTopic' ELSE 'DatabaseTable' END", namespace="r_name || '.' || n_name || '.Persistence'", file_role="'Unknown'", project_context='r_name')}),
fi AS (SELECT * FROM lineitem WHERE l_linenumber = 1),
pr AS (SELECT l_partkey, l_suppkey, min({{'o': l_orderkey, 'f': l_returnflag}}) AS m, any_value(p_type) AS p_type FROM fi JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 40 GROUP BY 1, 2),
e AS (
SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'Contains' AS type, 1.0::DOUBLE AS confidence FROM nation
UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'Contains', 1.0 FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'Contains', 1.0 FROM orders
UNION ALL SELECT 'order:' || o_orderkey, 'order:' || nx, 'Calls', CASE WHEN o_orderpriority < '3' THEN 0.9 ELSE 1.0 END
  FROM (SELECT *, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx FROM orders) WHERE nx IS NOT NULL
UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, CASE WHEN any_value(p_type) = 'PROMO' THEN 'Uses' ELSE 'Calls' END, 1 - max(l_discount) FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey, l_partkey
UNION ALL SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey, CASE l_returnflag WHEN 'R' THEN 'Reads' WHEN 'A' THEN 'Writes' ELSE 'PublishesTo' END, 1.0 FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_returnflag FROM fi)
UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, CASE WHEN p_type = 'SMALL' THEN 'Writes' ELSE 'DependsOn' END, 1.0 FROM pr WHERE m.f <> 'A'
UNION ALL SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'DependsOn', 1.0 FROM pr WHERE m.f = 'A'
UNION ALL SELECT 'part:' || a.p_partkey, 'part:' || b.p_partkey, 'Implements', 1.0 FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size WHERE a.p_type = 'STANDARD' AND b.p_type = 'LARGE')
"""


def ingest_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) in force of the ingest tables, with canonical types and roles.

    Vertices are the rows in force and the external concepts. ``change_count`` counts the distinct source hashes
    an id was sent with. Of equal edges (src, type, dst) the newest counts; edges with an end that is no vertex
    are left out, as an upsert would skip them.
    """
    raw = table(spark, d, "nodes")
    cols = ["name", F.expr(canonical("type", NODE_TYPES)).alias("type"), "namespace", "file_path", "line_number", "line_count", "summary", "source_hash",
            F.expr(canonical("file_role", FILE_ROLES, "'Unknown'")).alias("file_role"), "project_context", "created_at", "updated_at"]
    changes = raw.groupBy("id").agg(F.count_distinct("source_hash").alias("change_count"))
    mine = in_force(raw, cols).join(changes, "id")
    ext = table(spark, d, "external_concepts").select("id", "name", F.lit("ExternalConcept").alias("type"), F.lit("Unknown").alias("file_role"))
    nodes = mine.unionByName(ext, allowMissingColumns=True)
    e = table(spark, d, "edges").withColumn("type", F.expr(canonical("type", EDGE_TYPES))).where("type is not null and src is not null and dst is not null")
    newest = e.groupBy("src", "type", "dst").agg(F.max_by(F.struct("confidence", "call_site"), F.struct("indexed_at", "edge_no")).alias("r")).select("src", "type", "dst", "r.*")
    ids = nodes.select("id")
    ok = newest.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, ok.select("src", "dst", "type", "confidence", "call_site")


#: The same for DuckDB: common table expressions gn and ge.
INGEST_GRAPH_SQL = f"""
ch AS (SELECT id, count(DISTINCT source_hash) AS change_count FROM nodes GROUP BY id),
gn AS (
  SELECT f.id, name, {canonical('type', NODE_TYPES)} AS type, namespace, file_path, line_number, line_count, summary, source_hash, {canonical('file_role', FILE_ROLES, "'Unknown'")} AS file_role,
    project_context, created_at, updated_at, change_count
  FROM (SELECT * FROM nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, ingest_no DESC) = 1) f JOIN ch ON ch.id = f.id
  UNION ALL SELECT id, name, 'ExternalConcept', NULL, NULL, NULL, NULL, NULL, NULL, 'Unknown', NULL, NULL, NULL, NULL FROM external_concepts),
ge AS (
  SELECT src, dst, type, confidence, call_site FROM (SELECT * REPLACE ({canonical('type', EDGE_TYPES)} AS type) FROM edges)
  WHERE type IS NOT NULL AND src IN (SELECT id FROM gn) AND dst IN (SELECT id FROM gn)
  QUALIFY row_number() OVER (PARTITION BY src, type, dst ORDER BY indexed_at DESC NULLS LAST, edge_no DESC) = 1)
"""


def lower_blank(c: str | Column) -> Column:
    """Trimmed lower case, null if blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.trim(c)), F.lit(""))
