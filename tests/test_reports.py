"""Reports by rubric, on graphs small enough to be worked out by hand."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import algorithms as A
from graphloom.operators import reports as R
from graphloom.operators.model import EDGE_SCHEMA, NODE_SCHEMA


def graph(spark, nodes, edges):
    base = {"type": "Method", "role": "Source", "lines": 10, "changes": 0}
    rows = []
    for n in nodes:
        n = base | n
        rows.append((n["id"], n.get("name", n["id"]), n["type"], n.get("ns", "N"), n.get("path"), 1, n["lines"], n.get("summary"), "h", n["role"], "p", n["changes"], None, None, None))
    e = spark.createDataFrame([(s, d, t, 1.0) for s, d, t in edges], EDGE_SCHEMA)
    return spark.createDataFrame(rows, NODE_SCHEMA).withColumn("updated_at", F.lit("2024-01-01").cast("timestamp")), e


def test_test_shield(spark):
    n, e = graph(spark, [
        {"id": "t", "name": "Target", "path": "src/zeta.cs", "ns": "A"}, {"id": "c", "name": "Caller", "path": "src/kappa.cs", "ns": "B"}, {"id": "lone", "name": "Lone", "path": "src/lone.cs", "ns": "C"},
        {"id": "dep", "path": "src/dep.cs", "ns": "D", "role": "Source"},
        {"id": "x1", "name": "hits", "path": "tests/uno.cs", "ns": "T1", "role": "Test"},  # calls the target
        {"id": "x2", "name": "walks", "path": "tests/dos.cs", "ns": "T2", "role": "Test"},  # calls the caller
        {"id": "x3", "name": "near", "path": "tests/CallerTests.cs", "ns": "T3", "role": "Test"},  # only by its place
        {"id": "x4", "name": "setup", "path": "tests/quattro.cs", "ns": "T4", "role": "Test"},  # supports other tests
        {"id": "x5", "type": "Class", "name": "UnoTests", "path": "tests/uno.cs", "ns": "T1", "role": "Test"},  # a class with a method of its own
    ], [("c", "t", "Calls"), ("lone", "t", "Calls"), ("t", "dep", "Calls"), ("c", "dep", "Calls"), ("x1", "t", "Calls"), ("x2", "c", "Calls"), ("x4", "t", "Calls"), ("x5", "t", "Calls")])
    got = {r["id"]: (r["shield"], r["protects"], r["score"]) for r in R.test_shield(n, e, "t").collect()}
    assert got == {
        "x1": ("direct", "t", 100 + 10), "x2": ("primary", "c", 100 + 50 + 10), "x3": ("secondary", "c", 50 + 10 + 5),
        "x4": ("secondary", "t", 110), "x5": ("secondary", "t", 110), "lone": ("unshielded", None, 0),
    }
    assert R.test_shield(n, e, "nobody").count() == 0


def test_names_of_slices(spark):
    rows = ["BuildMinimalAsync", "IOrderStore", "A.B.getUserName(int)", "set", "HTTPBox"]
    df = spark.createDataFrame([(r,) for r in rows], "x string").withColumn("__n", R.clean_name(F.col("x")))
    got = {r["x"]: (r["__n"], r["p"]) for r in df.withColumn("p", R.plural(F.col("__n"))).collect()}
    assert got["BuildMinimalAsync"] == ("BuildMinimal", "BuildMinimals") and got["IOrderStore"] == ("OrderStore", "OrderStores")
    assert got["A.B.getUserName(int)"] == ("UserName", "UserNames") and got["set"] == ("set", "sets")
    words = spark.createDataFrame([("Query",), ("Boxes",), ("Day",), ("Batch",)], "__n string").select(R.plural(F.col("__n")).alias("p"))
    assert [r["p"] for r in words.collect()] == ["Queries", "Boxes", "Days", "Batches"]


def test_responsibility_slices(spark):
    n, e = graph(spark, [
        {"id": "K", "type": "Class"}, {"id": "a", "name": "FindRows"}, {"id": "b", "name": "QueryRows"}, {"id": "c", "name": "Run"}, {"id": "d", "name": "Zap"}, {"id": "e", "name": "GetTray"},
        {"id": "store", "type": "Class", "name": "IOrderStore"}, {"id": "task", "type": "Class", "name": "Task"}, {"id": "ctl", "name": "TrayController"}, {"id": "tst", "role": "Test", "path": "tests/x.cs"},
    ], [("K", x, "Contains") for x in "abcde"] + [("a", "store", "Calls"), ("b", "store", "Calls"), ("a", "task", "Uses"), ("c", "store", "Calls"), ("ctl", "d", "Calls"), ("tst", "a", "Calls")])
    got = {r["slice"]: r.asDict() for r in R.responsibility_slices(n, e, "K", docs=5).collect()}
    # a and b by a word of their names; c by its dependency; d by its caller; e alone by its own name is too little.
    assert set(got) == {"Search", "OrderStores", "TrayControllers"}
    s = got["Search"]
    assert (s["methods"], s["deps"], s["tests"], s["score"], s["confidence"], s["shared"]) == (2, 1, 1, 2 + 5 + 4 + 6, "Medium", 1.0)
    assert got["OrderStores"]["score"] == 1 + 5 + 6 and got["TrayControllers"]["score"] == 1 + 4 + 6
    together = n.select("id", F.lit(1).alias("community"))
    assert {r["slice"]: (r["score"], r["confidence"]) for r in R.responsibility_slices(n, e, "K", 5, together).collect()}["Search"] == (18, "High")
    assert R.responsibility_slices(n, e, "nobody").count() == 0


def test_extraction_suggestions(spark):
    members = [{"id": f"m{i}", "path": f"src/{i % 2}.cs", "ns": "X.Core.P", "lines": 10 + i} for i in range(4)]
    n, e = graph(spark, members + [{"id": "q", "role": "Generated"}, {"id": "tst", "role": "Test", "path": "tests/t.cs"}, {"id": "z1"}, {"id": "z2"}], [("tst", f"m{i}", "Calls") for i in range(3)] + [(f"m{i}", "m3", "Calls") for i in range(3)])
    found = spark.createDataFrame([(f"m{i}", "c") for i in range(4)] + [("q", "c"), ("z1", "small"), ("z2", "small")], "id string, community string")
    r, = R.extraction_suggestions(n, e, found).collect()
    # 4 members 6, four fifths production 3, two files 3, a test 2, one gap (m3) -1, anchor m3 with fan-in 3: 2.
    assert (r["community"], r["anchor"], r["members"], r["files"], r["tests"], r["gaps"], r["layers"], r["ratio"]) == ("c", "m3", 4, 2, 1, 1, 1, 0.8)
    assert (r["score"], r["confidence"], r["is_primary"]) == (6 + 3 + 3 + 2 - 1 + 2, "Medium", True)


def test_extraction_plan_reads_the_graph_from_tables(spark):
    """However large the plan of the graph is, that of the report is not."""
    n, e = spark.createDataFrame([{"id": "a"}], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA)
    for k in range(40):
        n = n.join(spark.range(1).selectExpr(f"'n{k}' as id"), "id", "left")
    df = R.extraction_suggestions(n, e, n.select("id", F.col("name").alias("community")))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") < 40



def test_implementation_patterns(spark):
    n, e = graph(spark, [
        {"id": "s", "name": "SaveTray", "ns": "A.B.C.D", "path": "src/s.cs"}, {"id": "u", "name": "Use", "ns": "U", "path": "src/u.cs"}, {"id": "tb", "type": "DatabaseTable", "ns": None},
        {"id": "t1", "role": "Test", "ns": "T", "path": "tests/a.cs"}, {"id": "t2", "role": "Test", "ns": "A.B.C.D", "path": "tests/b.cs"}, {"id": "v", "name": "Vec", "ns": None, "path": "lib/x/v.cs"},
    ], [("u", "s", "Calls"), ("s", "tb", "Writes"), ("t1", "s", "Calls"), ("u", "v", "Calls"), ("v", "tb", "Reads")])
    vec = spark.createDataFrame([("s", [1.0, 0.0]), ("v", [1.0, 1.0]), ("u", [0.0, 1.0])], "id string, embedding array<double>")
    seeds = R.pattern_seeds(n, "tray", vec, [1.0, 0.0])
    assert {r["id"]: (r["seed"], r["how"]) for r in seeds.collect()} == {"s": (1.0, "embedding,lexical"), "v": (0.707107, "embedding")}
    got = {r["scope"]: (r["id"], r["score"]) for r in R.implementation_patterns(n, e, seeds).collect()}
    # s: seed 100, callers, callees and store 54, a test 8, one more of its namespace 3, a store 6.
    assert got == {"A.B.C": ("s", 100 + 54 + 8 + 3 + 6), "lib/x": ("v", 71 + 54 + 6)}


def test_feature_path_and_status(spark):
    n, e = graph(spark, [
        {"id": "m", "name": "ShipOrder", "path": "src/Ship/order.cs", "ns": "App"}, {"id": "i", "type": "Interface", "name": "IShip", "path": "src/IShip.cs"},
        {"id": "tst", "name": "shipTests", "role": "Test", "path": "tests/shipTests.cs"}, {"id": "o", "name": "Other", "path": "src/o.cs"}, {"id": "bare", "name": "ship"},
    ], [("tst", "m", "Calls")])
    path = R.feature_path(n, "ship order", ["ship", "order"])
    # m: method 5, two terms 6 + 6 + 8, both in the name 4. i: interface 4, one term 3 + 2, a contract -8. tst: 5 + 3 + 2 - 6.
    assert [(r["id"], r["score"]) for r in path.collect()] == [("m", 29), ("tst", 4), ("i", 1)]
    assert {r["id"]: r["score"] for r in R.feature_path(n, "ship interface", ["ship"]).collect()}["i"] == 4 + 3 + 2 + 2
    docs = spark.createDataFrame([("d", "docs/features/ship.md", "x")], "id string, source string, content string")
    r = R.feature_status(n, e, docs, path, "ship order", ["ship", "order"]).first()
    assert (r["status"], r["confidence"], r["risk"], r["tests"]) == ("documented_with_code_and_test_evidence", "high", "low", 1)
    r = R.feature_status(n, e, docs.limit(0), path.limit(0), "ship order", []).first()
    assert (r["status"], r["confidence"], r["risk"]) == ("not_found_in_graph", "low", "unknown")


def test_pruned_surface(spark):
    n, _ = graph(spark, [
        {"id": "a", "name": "RouteTable", "path": "src/a.cs"}, {"id": "b", "name": "route", "path": "docs/b.md"}, {"id": "c", "name": "IRoute", "type": "Interface", "path": "src/IRoute.cs"},
        {"id": "d", "name": "RouteTests", "path": "tests/RouteTests.cs", "role": "Test"}, {"id": "e", "name": "route list", "type": "Property", "path": "src/e.cs"}, {"id": "f", "name": "other", "path": "src/f.cs"},
    ], [("a", "f", "Calls")])
    surface = spark.createDataFrame([("src/a.cs", 9), ("docs/b.md", 8), ("src/IRoute.cs", 7), ("tests/RouteTests.cs", 6), ("src/e.cs", 5), ("src/f.cs", 4)], "file_path string, score int")
    got = {r["file_path"]: (r["part"], r["reason"]) for r in R.prune_surface(n, surface, ["route"]).collect()}
    assert got == {
        "src/a.cs": ("primary", None), "docs/b.md": ("context", "documentation"), "src/IRoute.cs": ("context", "contract"), "tests/RouteTests.cs": ("context", "test"), "src/e.cs": ("context", "file-only"),
    }
    got = {r["file_path"]: (r["part"], r["reason"]) for r in R.prune_surface(n, surface.where("score in (8, 7)"), ["route"]).collect()}
    assert got == {"docs/b.md": ("primary", None), "src/IRoute.cs": ("context", "contract")}  # something must be primary


def test_documents_of_a_change(spark):
    files = spark.createDataFrame([("src/Billing/tax.cs",), (None,)], "file_path string")
    words = lambda rows: spark.createDataFrame(rows, "id string, keyword string, weight double")
    docs = spark.createDataFrame([("a", "docs/features/x.md"), ("b", "notes/billing.md"), ("c", "README.md"), ("d", "src\\Billing\\tax.cs"), ("e", None), ("f", "docs/features/X.md")], "id string, source string")
    got = R.change_documents(
        files, words([("n", "rate", 2.0)]),
        words([("a", "rate", 2.0), ("a", "billing", 1.0), ("b", "billing", 4.0), ("b", "rate", 1.0), ("c", "rate", 1.0), ("d", "rate", 9.0), ("e", "rate", 9.0), ("f", "rate", 1.2)]), docs,
    ).collect()
    # rate weighs 1.5 * 2, billing 0.6. a: (2 * 3 + 0.6) * 1.25; b: 4 * 0.6 * 1.8 + 3; c: 3 * 1.15 is too little; f has a's source.
    assert [(r["id"], r["score"], r["confidence"]) for r in got] == [("a", 8.25, "High"), ("b", 7.32, "Medium")]


def test_communities_have_high_modularity(spark):
    import random

    rnd = random.Random(5)
    ids = [f"g{k // 12}n{k:02d}" for k in range(60)]
    pairs = {(a, b) for a in ids for b in ids if a < b and rnd.random() < (0.5 if a[:2] == b[:2] else 0.02)}
    n, e = graph(spark, [{"id": i} for i in ids], [(a, b, "Calls") for a, b in pairs])

    def modularity(group):
        deg = {i: sum(i in p for p in pairs) for i in ids}
        m = len(pairs)
        inside = sum(group[a] == group[b] for a, b in pairs)
        return inside / m - sum((sum(deg[i] for i in ids if group[i] == g) / (2 * m)) ** 2 for g in set(group.values()))

    found = {r["id"]: r["community"] for r in A.communities(n, e, ["Calls"]).collect()}
    planted = modularity({i: i[:2] for i in ids})
    assert modularity(found) >= 0.97 * planted > 0.5


@pytest.mark.parametrize("length", [80])
def test_long_chains_are_walked_to_the_end(spark, length):
    from graphloom.operators.traverse import type_hierarchy

    ids = [f"c{k:03d}" for k in range(length)]
    n, e = graph(spark, [{"id": i} for i in ids[:2]], [(a, b, "Inherits") for a, b in zip(ids, ids[1:])])
    got = type_hierarchy(e.where("true")).where("id = 'c000'").agg(F.max("dist"), F.count("*")).first()
    assert tuple(got) == (length - 1, length - 1)


def test_risk_of_replacing_a_dependency(spark):
    n, e = graph(spark, [
        {"id": "lib", "type": "ExternalConcept", "name": "OldLog", "ns": None}, {"id": "a", "ns": "A.B.C", "path": "src/a.cs"}, {"id": "b", "ns": "A.B", "path": "src/Infrastructure/b.cs"},
        {"id": "t", "role": "Test", "path": "tests/x.cs"}, {"id": "ep", "type": "ApiEndpoint", "path": "src/ep.cs"},
    ], [("a", "lib", "Uses"), ("b", "lib", "Uses"), ("t", "a", "Calls"), ("ep", "b", "Calls")])
    # a is tested and safe; b is infrastructure, called by an endpoint, without a test: 2 + 2 + 2.
    assert [tuple(r) for r in R.replace_risk(n, e, "oldlog").collect()] == [("A.B", 2, 6, 1, "Medium")]
    assert R.replace_risk(n, e, "nothing").count() == 0
