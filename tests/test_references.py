from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from graphloom.operators.references import missing_reference_report, missing_references

E = "edge_no long, src string, dst string, indexed_at timestamp, t int, id string"
N = "id string, last_indexed_at timestamp, day int"
D = "node_id string, deleted_at timestamp, reason string"
X = "id string, name string"
T0 = datetime(2025, 1, 1)
at = lambda h: None if h is None else T0 + timedelta(hours=h)


def frames(spark, edges, nodes, gone, fixed):
    return (
        spark.createDataFrame([(i, s, d, at(h), 1, "x") for i, s, d, h in edges], E), spark.createDataFrame([(i, at(h), 0) for i, h in nodes], N),
        spark.createDataFrame([(i, at(h), "") for i, h in gone], D), spark.createDataFrame([(i, "") for i in fixed], X),
    )


def brute(edges, nodes, gone, fixed):
    out = []
    for no, s, d, t in edges:
        for side, i in (("src", s), ("dst", d)):
            if i is None or not i.strip() or i in fixed:
                continue
            up = [h for j, h in nodes if j == i and h is not None]
            seen = [h for h in up if t is not None and h <= t]
            if seen and not any(j == i and h is not None and max(seen) < h <= t for j, h in gone):
                continue
            out.append((no, side, "never" if not up else "later" if not seen else "deleted"))
    return sorted(out)


def run(spark, *tables):
    return sorted((r["row_no"], r["side"], r["reason"]) for r in missing_references(*frames(spark, *tables)).collect())


def test_nulls_blanks_ties_and_repeats(spark):
    edges = [(1, "a", "b", 10), (2, None, " ", 10), (3, "", "\t", 5), (4, "a", "x", None), (5, "a", "a", 10), (5, "a", "a", 10), (6, "c", "c", 30), (7, "c", "c", 26), (8, "z", "é", 3)]
    nodes = [("a", 10), ("a", 10), (None, 1), ("b", None), ("b", 11), ("c", 25), ("c", 1), ("é", 3)]
    gone = [("c", 26), ("c", 27), ("a", 10), (None, 3), ("q", None)]
    assert run(spark, edges, nodes, gone, ["x"]) == brute(edges, nodes, gone, ["x"])


def test_empty_tables(spark):
    assert run(spark, [], [], [], []) == []
    assert run(spark, [(1, "a", None, 1)], [], [], []) == [(1, "src", "never")]
    assert missing_reference_report(*frames(spark, [], [], [], [])).collect() == []


_id = st.sampled_from(["a", "b", "hot", "hot", None, " "])
_h = st.one_of(st.none(), st.integers(0, 60))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(_id, _id, _h), max_size=30), st.lists(st.tuples(_id, _h), max_size=20), st.lists(st.tuples(_id, _h), max_size=10))
def test_against_brute_force(spark, edges, nodes, gone):
    edges = [(i, *e) for i, e in enumerate(edges)]
    nodes = [(i, h) for i, h in nodes if i != " "]
    assert run(spark, edges, nodes, gone, ["b"]) == brute(edges, nodes, gone, ["b"])


def test_report_counts(spark):
    edges = [(1, "a", "ExternalConcept:p", 1), (2, "a", "b", 2), (3, "a", "b", 3)]
    rows = {(r["side"], r["parent"]): r for r in missing_reference_report(*frames(spark, edges, [("a", 2)], [], ["ExternalConcept:p"])).collect()}
    assert (rows["src", "nodes"]["refs"], rows["src", "nodes"]["missing"], rows["src", "nodes"]["indexed_later"]) == (3, 1, 1)
    assert (rows["dst", "nodes"]["missing"], rows["dst", "nodes"]["ids_missing"], rows["dst", "nodes"]["never_indexed"]) == (2, 1, 2)
    assert rows["dst", "external_concepts"]["missing"] == 0
