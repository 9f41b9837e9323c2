import random
from itertools import combinations

import __spark_entry__ as E
from pyspark.sql import functions as F

from graphloom.operators import resolution as X
from graphloom.operators import scoring as C
from graphloom.operators.model import EDGE_SCHEMA, NODE_SCHEMA


def graph(spark):
    n = [(i, i, t, "N", p, 1, 10, None, "h", r, "p", 0, None, None, None) for i, t, p, r in [
        ("svc", "Class", "src/svc.cs", "Source"), ("svc.go", "Method", "src/svc.cs", "Source"), ("use", "Method", "src/use.cs", "Source"), ("goTest", "Method", "tests/goTests.cs", "Test"), ("file", "File", "src/use.cs", "Source"),
    ]]
    e = [("svc", "svc.go", "Contains"), ("use", "svc.go", "Calls"), ("goTest", "svc.go", "Calls"), ("file", "svc.go", "Uses")]
    return spark.createDataFrame(n, NODE_SCHEMA), spark.createDataFrame([(s, d, t, 1.0) for s, d, t in e], EDGE_SCHEMA)


def test_related_and_recommended_tests(spark):
    n, e = graph(spark)
    found = C.related_tests(n, e, "svc.go")
    assert [(r["id"], r["match"]) for r in found.collect()] == [("goTest", "direct")]
    assert [(r["id"], r["score"], r["category"]) for r in C.recommended_tests(found).collect()] == [("goTest", 300, 0)]
    assert C.related_tests(n, e, "nobody").count() == 0


def test_caller_groups_leave_out_files_of_exact_callers(spark):
    n, e = graph(spark)
    assert {(r["id"], r["group"]) for r in C.caller_groups(n, e, "svc").collect()} == {("use", "method"), ("goTest", "test")}


def test_snippets_shrink_to_the_budget(spark):
    rows = spark.createDataFrame([("a", 1, "x", 10, 400), ("a", 2, "y", 100, 8000), ("a", 3, "z", 5, 40), ("b", 1, "q", 3, 10)], "pack string, rank int, id string, lines int, chars int")
    got = {(r["pack"], r["id"]): r["tokens"] for r in C.snippets_in_budget(rows, 1000).collect()}
    assert got == {("a", "x"): 100, ("a", "y"): 900, ("b", "q"): 3} or got[("a", "x")] == 100 and sum(v for (p, _), v in got.items() if p == "a") <= 1000


def test_shared_evidence(spark):
    rows = spark.createDataFrame([("g", 1, "a"), ("g", 1, "a"), ("g", 2, "a"), ("g", 3, "b"), ("h", 9, "x")], "group string, id int, evidence string")
    assert {r["group"]: (r["pairs"], r["share"]) for r in C.shared_evidence(rows).collect()} == {"g": (3, 0.333333), "h": (0, None)}


def test_shared_evidence_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.randrange(9)) for g in "ab" for i in range(25) for _ in range(rng.randrange(1, 6))]
    sets = {}
    for g, i, x in rows:
        sets.setdefault(g, {}).setdefault(i, set()).add(x)
    want = {g: round(sum(bool(a & b) for a, b in combinations(s.values(), 2)) / 300, 6) for g, s in sets.items()}
    assert {r["group"]: r["share"] for r in C.shared_evidence(spark.createDataFrame(rows, "group string, id int, evidence int")).collect()} == want


def test_shared_evidence_of_all_items(spark, tmp_path):
    rows = [("A", 1, 7, 5), ("A", 2, 7, 50), ("A", 3, 8, 1), ("A", 3, 7, 2)]
    spark.createDataFrame(rows, "l_returnflag string, l_orderkey long, l_suppkey long, l_quantity int").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [(r["pairs"], r["share"]) for r in E.queries()["ref_R19_shared_evidence"](spark, str(tmp_path)).collect()] == [(3, 1.0)]


def test_calls_resolve_only_if_unique(spark):
    m = spark.createDataFrame([("m1", "Go", 1, 1, False, "A", "a.cs", "N"), ("m2", "Go", 1, 1, False, "B", "b.cs", "M"), ("m3", "Go", 0, 0, False, "A", "a.cs", "N")], "id string, name string, required int, total int, variadic boolean, owner string, file string, namespace string")
    calls = spark.createDataFrame(
        [(1, "Go", 1, "A", "x", "x", None, "Unqualified"), (2, "Go", 1, "Z", "z", "M", None, "Unqualified"), (3, "Go", 1, "Z", "z", "Q", None, "Unqualified"), (4, "Go", 7, "A", "x", "x", None, "This"), (5, "No", 1, "A", "x", "x", None, "This"),
         (6, "Go", 1, "A", "x", "x", "B", "Typed"), (7, "Go", 1, "A", "x", "x", "Q", "Typed"), (8, "Go", 0, "A", "x", "x", None, "Chained"), (9, None, None, "A", "x", "x", None, "This")],
        "call_id int, name string, args int, src_type string, src_file string, src_namespace string, receiver string, kind string",
    )
    got = {r["call_id"]: (r["target"], r["tier"], r["disposition"]) for r in X.resolve_calls(calls, m).collect()}
    assert got == {
        1: ("m1", "own", "resolved"), 2: ("m2", "namespace", "resolved"), 3: (None, None, "indeterminate"), 4: (None, None, "unresolved"), 5: (None, None, "external"),
        6: ("m2", "receiver", "resolved"), 7: (None, None, "indeterminate"), 8: (None, None, "indeterminate"), 9: (None, None, "indeterminate"),
    }
    acc = X.accounting(X.resolve_calls(calls, m).select(F.col("call_id").alias("id"), "disposition", F.col("tier").alias("reason")))
    assert acc.agg(F.sum("n")).first()[0] == 9


def test_trust_levels(spark):
    s = "run_id int, language string, scope string, completed_at int, partial boolean, schema_version int, mode string, scanned int, ingested int, resolved int, unresolved int, indeterminate int, external int, legacy int, reasons string"
    level = lambda rows: X.relationship_trust(spark.createDataFrame(rows, s)).first()["confidence"]
    ok = (1, "c", "a", 1, False, 2, "full", 100, 100, 50, 0, 0, 1, 0, '{"x": 2}')
    assert level([]) == "Unknown" and level([ok]) == "High"
    assert level([ok, (2, "c", "a", 2, False, 2, "incremental", 100, 5, 3, 0, 0, 0, 0, "broken")]) == "Low"
    assert level([ok, (3, "c", "b", 1, False, 2, "full", 1, 1, 1, 0, 4, 0, 0, None)]) == "Medium"
    runs = spark.createDataFrame([ok, (2, "c", "a", 2, False, 2, "full", 1, 1, 1, 0, 0, 0, 0, "broken")], s)
    assert [(r["reason"], r["n"], r["percent"]) for r in X.reason_counts(runs).collect()] == [("x", 2, 100.0)]
