from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import frontend, mutations, resolution
from graphloom.operators.model import EDGE_SCHEMA
from graphloom.sources import sinks


def values(spark, rows, expr):
    return [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string").orderBy("i").select(expr(F.col("x"))).collect()]


def test_names(spark):
    assert values(spark, ["Queries", "ies", "Boxes", "Batches", "Days", "s", "Tray", None], S.singular) == ["Query", "ie", "Box", "Batch", "Day", "s", "Tray", None]
    assert values(spark, ["RunASYNC", "Run"], lambda c: S.without_suffix(c, "Async")) == ["Run", "Run"]
    rows = spark.createDataFrame([("a", "X.Y.Z"), ("a", "x.y.W"), ("b", "Q"), ("b", "R"), ("c", ""), ("c", None), ("d", "One.Two")], "k string, v string")
    assert {r["k"]: r["prefix"] for r in S.common_prefix(rows, "k", "v", ".").collect()} == {"a": "x.y", "b": None, "d": "One.Two"}


def test_windows_globs_and_tools(spark):
    assert values(spark, ["3h", " 2D ", "5m", "x", None, "h", "-1h"], S.window_seconds) == [10800, 172800, 300, 86400, 86400, 86400, -3600]
    hit = lambda x: values(spark, ["obj/a.cs", "a\\obj\\b\\c.cs", "objects/a.cs", "A.G.CS", "src/x/Data/y", "src/x/z/Data/y", None], lambda c: S.glob_match(c, [x]))
    assert hit("**/obj/**") == [True, True, False, False, False, False, False]
    assert hit("**/*.g.cs") == [False, False, False, True, False, False, False]
    assert hit("src/*/Data/*") == [False, False, False, False, True, False, False]
    assert values(spark, ['[McpServerTool(Name = "a b")] [mcpservertool(name="c")] McpServerTool(Name="a b")', None], S.tool_names) == [["a b", "c"], None]


def test_feature_terms(spark):
    rows = spark.createDataFrame([("Add retry/backoff to Retry queue", 6), ("retry-notes", 2), (None, 6), ("ignored words", 0)], "text string, weight int")
    assert [tuple(r) for r in S.feature_terms(rows, ["queue"]).collect()] == [("retry", 14), ("backoff", 6), ("notes", 2)]


def test_colours(spark):
    got = values(spark, ["#F00", "#12345680", "rgb(10, 50%, 300)", "rgba(1,2,3,0.5)", "hsl(120, 100%, 25%)", "hsla(-120deg,100%,50%,50%)", "Orange", "12px", "rgb(1,2)", "#12", None, "hsl(1,2,3)"], S.colour)
    assert [tuple(x) if x else None for x in got] == [
        (255, 0, 0, 255), (18, 52, 86, 128), (10, 127, 255, 255), (1, 2, 3, 128), (0, 128, 0, 255), (0, 0, 255, 127), (255, 165, 0, 255), None, None, None, None, None,
    ]
    d = spark.createDataFrame([("#000000", "#030400")], "a string, b string").select(S.colour_distance(S.colour(F.col("a")), S.colour(F.col("b")))).first()[0]
    assert d == 5.0
    rows = spark.createDataFrame([(1, "color", "#101010"), (2, "color", "rgb(20,20,20)"), (3, "color", "#303030"), (4, "fill", "#101011"), (5, "color", "2px")], "id int, property string, value string")
    assert {r["id"]: r["leader"] for r in frontend.near_duplicate_colours(rows).collect()} == {1: "#101010ff", 2: "#101010ff", 3: "#303030ff", 4: "#101011ff"}


def test_data_accesses(spark):
    texts = [
        "db.query('SELECT a FROM users WHERE 1'); INSERT INTO logs VALUES (1)", "await this.prisma.order.findMany({}); prisma.order.deleteMany()", "knex('items').join('x').insert({})\n  .into('audit'); knex.select('a').from('b')",
        "MERGE (p:Person {id: 1})-[r:KNOWS]->(q:`Group`)", None, "", "plain words from nobody",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {(r["id"], r["provider"], r["operation"], r["name"]) for r in resolution.data_accesses(df).collect()}
    assert got == {
        (0, "sql", "Read", "users"), (0, "sql", "Write", "logs"), (1, "prisma", "Read", "order"), (1, "prisma", "Write", "order"), (2, "knex", "Write", "items"), (2, "knex", "Write", "audit"), (2, "knex", "Read", "b"),
        (3, "cypher", "Write", "Person"), (3, "cypher", "Write", "Group"), (3, "cypher", "Write", "KNOWS"),
    }


def test_deletes(spark):
    n = spark.createDataFrame([("f", "File", "p"), ("d", "Diagnostic", "p"), ("d2", "Diagnostic", "q"), ("c", "ConfigurationEntry", "p"), ("k", "ConfigurationKey", "p"), ("k2", "ConfigurationKey", "p")], "id string, type string, project_context string")
    e = spark.createDataFrame([("f", "d", "Contains", 1.0), ("c", "k", "DefinesConfig", 1.0), ("f", "k2", "ReadsConfig", 1.0)], EDGE_SCHEMA)
    ids = lambda df: {r["id"] for r in df.collect()}
    m, x = mutations.delete_kinds(n, e, ["Diagnostic"], "P")
    assert ids(m) == {"f", "d2", "c", "k", "k2"} and x.count() == 2
    m, x = mutations.delete_kinds(n, e, ["ConfigurationEntry"])
    assert ids(m) == {"f", "d", "d2", "k2"} and x.count() == 2  # k is linked with nothing any more
    gone = spark.createDataFrame([("d",), ("d",), ("nobody",), (None,)], "id string")
    m, x, counts = mutations.delete_batches(n, e, gone)
    assert ids(m) == {"f", "d2", "c", "k", "k2"} and [tuple(r) for r in counts.collect()] == [("Diagnostic", 1)]
    assert mutations.delete_all(n, e)[0].count() == 0


def test_written_graph_is_read_by_project_and_type(spark, tmp_path):
    n = spark.createDataFrame([("a", "p"), ("b", "q"), ("c", None)], "id string, project_context string")
    e = spark.createDataFrame([("a", "b", "Calls", 1.0), ("b", "c", "Uses", 1.0)], EDGE_SCHEMA)
    sinks.write_graph(n, e, str(tmp_path / "g"))
    m, x = sinks.read_graph(spark, str(tmp_path / "g"))
    assert {tuple(r) for r in m.select("id", "project_context").collect()} == {("a", "p"), ("b", "q"), ("c", None)} and x.count() == 2
    m, x = sinks.read_graph(spark, str(tmp_path / "g"), "p", ["Uses"])
    assert [r["id"] for r in m.collect()] == ["a"] and [r["src"] for r in x.collect()] == ["b"] and set(x.columns) == set(e.columns)
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "project" in plan


def test_bad_rows_of_an_ingest_stop_no_others(spark):
    rows = spark.createDataFrame([("a", "calls"), ("", "Calls"), (None, "Uses"), ("b", "Nonsense"), ("c", None)], "src string, type string")
    good, bad = sinks.checked(rows, ["src"], {"type": ["Calls", "Uses"]})
    assert {r["src"] for r in good.collect()} == {"a", "c"} and {r["fault"] for r in bad.collect()} == {"src", "type"} and bad.count() == 3


def test_session_files(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"project":"p","kind":"suggestion","toolName":"t","files":["a","b"],"staleWarning":true}\n\n  \nnot json\n{"kind":"test"}\n')
    good, bad = sinks.read_sessions(spark, str(tmp_path / "s.jsonl"))
    got = {r["kind"]: r for r in good.collect()}
    assert set(got) == {"suggestion", "test"} and got["suggestion"]["files"] == ["a", "b"] and got["suggestion"]["stale_warning"] and got["test"]["files"] == []
    assert [r["chars"] for r in bad.collect()] == [8]
