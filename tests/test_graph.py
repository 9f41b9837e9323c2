import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import columns as L
from graphloom.operators import algorithms as A
from graphloom.operators import frontend as W
from graphloom.operators import knowledge as K
from graphloom.operators import mutations as M
from graphloom.operators import reader as Rd
from graphloom.operators import resolution as X
from graphloom.operators import settings as Se
from graphloom.operators import structural as S
from graphloom.operators import traverse as T
from graphloom.operators.model import EDGE_SCHEMA, NODE_SCHEMA
from graphloom.operators.versions import in_force
from graphloom.plans import algorithm_queries as Q
from graphloom.plans.session import Workspace


def graph(spark, nodes, edges):
    """Nodes as (id, type[, namespace]) and edges as (src, type, dst)."""
    n = [(i, i, t, (x or [None])[0], None, None, None, None, None, "Source", "p", None, None, None, None) for i, t, *x in nodes]
    return spark.createDataFrame(n, NODE_SCHEMA), spark.createDataFrame([(s, d, t, 1.0) for s, t, d in edges], EDGE_SCHEMA)


def plain(spark, pairs):
    ids = sorted({x for p in pairs for x in p})
    return graph(spark, [(i, "Method") for i in ids], [(a, "Calls", b) for a, b in pairs])


def parts_without(adj, gone):
    left, n = set(adj) - {gone}, 0
    while left:
        n += 1
        todo = [left.pop()]
        while todo:
            for y in adj[todo.pop()]:
                if y in left:
                    left.discard(y)
                    todo.append(y)
    return n


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bridges_and_articulation_points_against_removal(spark, seed):
    rnd = random.Random(seed)
    pairs = {tuple(sorted(rnd.sample("abcdefghijkl", 2))) for _ in range(13)}
    n, e = plain(spark, pairs)
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    whole = parts_without(adj, None)

    def of(v):  # parts of v's own component without v
        return parts_without(adj, v) - whole + 1

    want = {v: of(v) for v in adj if of(v) > 1}
    assert {r["id"]: r["parts"] for r in A.articulation_points(n, e).collect()} == want
    cut = set()
    for a, b in pairs:
        adj[a].discard(b), adj[b].discard(a)
        if parts_without(adj, None) > whole:
            cut.add((a, b))
        adj[a].add(b), adj[b].add(a)
    assert {(r["a"], r["b"]) for r in A.bridges(n, e).collect()} == cut


@pytest.mark.parametrize("run", [A.bridges, A.articulation_points])
def test_a_graph_that_one_task_holds_is_not_walked_level_by_level(spark, run):
    ids = [f"n{i:03d}" for i in range(200)]
    random.Random(3).shuffle(ids)
    n, e = plain(spark, [*zip(ids, ids[1:]), ("x", "y"), ("y", "z"), ("z", "x")])
    sc = spark.sparkContext
    sc.setJobGroup("held", "held")
    got = run(n, e).collect()
    jobs = len(sc.statusTracker().getJobIdsForGroup("held"))
    sc.setJobGroup("", "")
    assert len(got) == (199 if run is A.bridges else 198) and jobs < 60
    if run is A.bridges:
        assert {tuple(r["sizes"]) for r in got} == {(200 - k, k) for k in range(1, 101)}


@pytest.mark.parametrize("held", [0, A.HELD_LINKS])
def test_blocks_held_and_by_joins(spark, held, monkeypatch):
    monkeypatch.setattr(A, "HELD_LINKS", held)
    n, e = plain(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("b", "a"), ("p", "q"), ("r", "r")])
    assert {(r["a"], r["b"], *r["sizes"]) for r in A.bridges(n, e).collect()} == {("c", "d", 3, 2), ("d", "e", 4, 1), ("p", "q", 1, 1)}
    assert {(r["id"], r["parts"]) for r in A.articulation_points(n, e).collect()} == {("c", 2), ("d", 2)}


def test_components_of_a_long_chain(spark):
    ids = [f"n{i:03d}" for i in range(60)]
    random.Random(5).shuffle(ids)
    p = spark.createDataFrame([*zip(ids, ids[1:]), ("x", "y")], "a string, b string")
    both = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b")))
    got = A.components(Workspace(spark, "t"), both).collect()
    assert {r["root"] for r in got if r["id"] not in "xy"} == {"n000"} and {r["root"] for r in got if r["id"] in "xy"} == {"x"}


def test_betweenness_of_a_path(spark):
    n, e = plain(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    assert {r["id"]: r["score"] for r in A.betweenness(n, e).collect()} == {"a": 0.0, "b": 2.0, "c": 2.0, "d": 0.0}


def test_betweenness_of_a_long_chain_and_a_square(spark):
    chain = [f"n{i:02d}" for i in range(70)]
    got = {r["id"]: r["score"] for r in A.betweenness(*plain(spark, [*zip(chain, chain[1:]), ("p", "q"), ("q", "r"), ("r", "s"), ("s", "p")])).collect()}
    assert got == {**{c: i * (69.0 - i) for i, c in enumerate(chain)}, **dict.fromkeys("pqrs", 0.5)}
    n, e = plain(spark, [("a", "b"), ("b", "c"), ("x", "y")])
    assert {r["id"]: r["score"] for r in A.betweenness(n, e, sources=n.where("id = 'a'")).collect()} == {"b": 0.5, "c": 0.0}


def test_betweenness_of_a_wide_and_a_narrow_graph(spark):
    """Fronts of few and of most nodes: two hubs over forty leaves, and a tail."""
    leaves = [f"l{i:02d}" for i in range(40)]
    got = {r["id"]: r["score"] for r in A.betweenness(*plain(spark, [(h, x) for h in "pq" for x in leaves] + [("p", "t"), ("t", "u")])).collect()}
    # A leaf is on one of 40 ways from q to each of p, t and u; p on half the ways of leaves, on all those of t and u but their own.
    assert got["l00"] == pytest.approx(3 / 40) and got["t"] == pytest.approx(42) and got["u"] == 0
    assert got["q"] == pytest.approx(40 * 39 / 4) and got["p"] == pytest.approx(40 * 39 / 4 + 2 * 41)


@pytest.mark.parametrize("name", ["ref_A2_betweenness", "ref_A3_articulation_points", "ref_A4_bridges", "ref_A8_risky_core"])
def test_algorithms_read_all_projects(spark, name):
    """The graph and the operator are what the query was registered with; no node is of a named project."""
    run = dict(zip(Q.QUERIES[name].__code__.co_freevars, Q.QUERIES[name].__closure__))["run"].cell_contents
    assert run(*plain(spark, [("a", "b"), ("b", "c")])).count() > 0


def test_weather_score_counts_bridges(spark):
    def rest(k, kind):
        ids = [f"n{i:02d}" for i in range(k)]
        r = S.unit_health(*graph(spark, [(i, "Method") for i in ids], [(a, kind, b) for a, b in zip(ids, ids[1:])])).first()
        return 100 - min(25, 5 * r["cycles"]) - min(25, 5 * r["broken"]) - min(20, r["gaps"] // 5) - min(20, r["low"] // 10) - r["score"]

    assert [rest(4, "Calls"), rest(12, "Calls"), rest(12, "Contains")] == [4, 10, 0]


def test_communities_of_two_cliques(spark):
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(5) for j in range(i)] + [("a0", "b0")]
    n, e = plain(spark, pairs)
    got = {r["id"]: r["community"] for r in A.communities(n, e, ["Calls"]).collect()}
    assert len({c for i, c in got.items() if i[0] == "a"}) == 1 and len({c for i, c in got.items() if i[0] == "b"}) == 1 and len(set(got.values())) == 2


def test_algorithms_on_empty_graphs(spark):
    n, e = graph(spark, [("a", "Class")], [])
    assert A.bridges(n, e).count() == 0 and A.articulation_points(n, e).count() == 0 and A.communities(n, e, ["Calls"]).count() == 0
    assert [tuple(r) for r in A.pagerank(n, e).collect()] == [("a", pytest.approx(0.15))]


def test_impact_through_an_interface(spark):
    n, e = graph(
        spark, [("IFlow", "Interface"), ("IFlow.Run", "Method"), ("Flow", "Class"), ("Flow.Run", "Method"), ("Checkout.Run", "Method")],
        [("IFlow", "Contains", "IFlow.Run"), ("Flow", "Contains", "Flow.Run"), ("Flow", "Implements", "IFlow"), ("Checkout.Run", "Calls", "Flow.Run")],
    )
    got = {r["id"]: (r["dist"], r["bucket"]) for r in T.impact(n, e, "IFlow", 3).collect()}
    assert got["Flow"] == (1, "dependency") and got["Checkout.Run"][0] >= 2
    assert T.impact(n, e, "nobody", 3).count() == 0


def test_endpoint_trace(spark):
    n, e = graph(
        spark, [("page", "File"), ("post", "ApiEndpoint"), ("svc", "Class"), ("op", "ExternalConcept"), ("tbl", "DatabaseTable"), ("topic", "MessageTopic")],
        [("svc", "Uses", "post"), ("svc", "Calls", "op"), ("op", "Writes", "tbl"), ("svc", "PublishesTo", "topic"), ("svc", "Reads", "tbl")],
    )
    n = n.withColumn("external_kind", F.when(F.col("id") == "op", "DatabaseOperation")).withColumn("recognition", F.when(F.col("id") == "op", 0.9))
    assert [(r["target"], r["path"]) for r in T.trace_endpoint(n, e, "POST").collect()] == [("topic", "post>svc>topic"), ("tbl", "post>svc>op>tbl")]


def test_connection_and_neighbours(spark):
    n, e = plain(spark, [("a", "b"), ("c", "b"), ("c", "d"), ("x", "y")])
    assert [(r["id"], r["via"]) for r in T.connection(n, e, "a", "d").collect()] == [("a", "Calls"), ("b", "Calls"), ("c", "Calls"), ("d", None)]
    assert T.connection(n, e, "a", "x").count() == 0 and [r["id"] for r in T.connection(n, e, "a", "a").collect()] == ["a"]
    assert {(r["id"], r["dist"]) for r in T.neighbours(e, "a", 2).collect()} == {("b", 1), ("c", 2)}


def test_coverage_gap_and_unreferenced(spark):
    n, e = graph(spark, [("A", "Class"), ("A.m", "Method"), ("B", "Class"), ("ATest", "Class"), ("lone", "Method")], [("A", "Contains", "A.m"), ("ATest", "Calls", "A.m")])
    assert {r["id"] for r in S.coverage_gaps(n, e).collect()} == {"B", "ATest", "lone"}
    assert {r["id"] for r in S.unreferenced(n, e).collect()} == {"A", "B", "ATest", "lone"}


def test_row_in_force(spark):
    df = spark.createDataFrame(
        [("a", 1, None, "old"), ("a", 2, 5, "new"), ("a", 3, 5, "newest"), (None, 4, 9, "x"), ("b", 5, None, None), ("c", 6, 1, None)], "id string, ingest_no long, updated_at int, v string"
    )
    assert {r["id"]: r["v"] for r in in_force(df, ["v"]).collect()} == {"a": "newest", "b": None, "c": None}
    assert in_force(df.limit(0), ["v"]).count() == 0


def col(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_tokens_and_keywords(spark):
    t = lambda s: col(spark, L.tokens(F.lit(s)))
    assert t("BuildMinimalContextAsync") == ["build", "minimal", "context", "async"]
    assert t("HTTPServerOK2x") == ["http", "server", "ok", "2", "x"]
    assert t("/api/notes/unread-replies/count") == ["api", "notes", "unread", "replies", "count"]
    assert t("") == [] and t(None) is None
    words = "use the new api sdk for ts clients and set token 1234 0123456789abcdef".split()
    keep = spark.createDataFrame([(w,) for w in words], "w string").where(L.is_keyword(F.col("w")))
    assert [r["w"] for r in keep.collect()] == ["api", "sdk", "ts", "clients", "token"]


def test_scalar_columns(spark):
    c = lambda x: col(spark, x)
    assert c(L.route_template(F.lit("https://h.org/Api/users/{id}/:Item/?q=1#f"))) == "/api/users/{param}/{param}"
    assert c(L.collapse_path(F.lit("docs/./a\\..//b/../../x.md"))) == "x.md"
    assert tuple(c(L.selector_specificity(F.lit("#a .b > div:hover::before")))) == (1, 2, 2)
    assert c(L.mask_value(F.lit("Db:Password"), F.lit("p"))) == "***" and c(L.config_key(F.lit(" 'A__B' "))) == "A:B"
    assert c(L.path_role(F.lit("src\\x\\Foo.g.cs"))) == "Generated" and c(L.path_role(F.lit("tests/a/b.ts"))) == "Test" and c(L.path_role(F.lit(None).cast("string"))) == "Unknown"
    assert c(L.layer(F.lit("My.Core.Thing"), F.lit(None).cast("string"))) == "Core" and c(L.layer(F.lit("MyCore"), F.lit("a/Api/b"))) == "API"


def test_chunks():
    assert K.split_chunks("abc", 10) == ["abc"]
    assert K.split_chunks("aaa\r\n\r\nbbb\n\ncccccccccccc", 8) == ["aaa\n\nbbb", "cccccccc", "cccc"]
    assert K.split_chunks("\n\n\n\n\n\n\n\n\n\n\n", 4) == ["\n\n\n\n"]


def test_document_references(spark):
    d = spark.createDataFrame([("d", "See [x](docs/../a.md#p) and [y](https://z) `src/B.cs` GET /Users/{id}?q"), ("e", None)], "id string, content string")
    assert {(r["kind"], r["target"]) for r in K.document_references(d).collect()} == {("link", "a.md"), ("code", "src/B.cs"), ("route", "GET /users/{param}")}


def test_reader_validation(spark):
    n, _ = graph(spark, [("a", "Class")], [])
    with pytest.raises(ValueError):
        Rd.nodes(n, Rd.NodeFilter(equals={"a b": "1"}))
    with pytest.raises(ValueError):
        Rd.nodes(n, Rd.NodeFilter(), sort="nope")
    with pytest.raises(ValueError):
        Rd.page(n, -1, 5)
    assert Rd.nodes(n, Rd.NodeFilter(labels=["Class"]), limit=1000).count() == 1 and Rd.depth_of(9) == 3


def test_settings(spark):
    f = spark.createDataFrame(
        [("a.json", '{"A": {"B": [1, true, null]}, "ApiKey": "k"}'), ("bad.json", "{"), ("c.yml", "services:\n  web:\n    environment:\n      - MODE=x\n    ports:\n      - 80\n"), ("x/.env", "# c\nexport A__B='1'\nN"), ("n.json", None)],
        "path string, content string",
    )
    got = {(r["path"], r["key"]): r["preview"] for r in Se.settings(f).collect()}
    assert got == {
        ("a.json", "A:B:0"): "1", ("a.json", "A:B:1"): "true", ("a.json", "A:B:2"): "", ("a.json", "ApiKey"): "***",
        ("c.yml", "services:web:environment:MODE"): "x", ("c.yml", "services:web:ports:0"): "80", ("x/.env", "A:B"): "1",
    }


def test_config_definitions_and_usages(spark):
    n, e = graph(
        spark, [("f", "ConfigurationFile"), ("en", "ConfigurationEntry"), ("Db:Url", "ConfigurationKey"), ("Db", "ConfigurationKey"), ("u", "Class"), ("v", "Class")],
        [("f", "DefinesConfig", "en"), ("en", "DefinesConfig", "Db:Url"), ("u", "ReadsConfig", "Db:Url"), ("v", "BindsConfig", "Db")],
    )
    assert [(r["file"], r["entry"], r["relation"]) for r in Se.definitions(n, e, "db:url").collect()] == [("f", "en", "DefinesConfig")]
    assert {r["src"]: r["confidence"] for r in Se.usages(n, e, "Db:Url").collect()} == {"u": 1.0, "v": 0.75}


def test_styles(spark):
    s = spark.createDataFrame([("a.css", "/* x */ .b { color: red; margin: 4px } #i .b { color: blue }")], "file_path string, css string")
    d = [(r["selector"], r["property"], r["target"], tuple(r["spec"])) for r in W.declarations(s).collect()]
    assert d == [(".b", "color", "b", (0, 1, 0)), (".b", "margin", "b", (0, 1, 0)), ("#i .b", "color", "b", (1, 1, 0))]
    p = spark.createDataFrame([("p", '<link href="x.css"><div class="a b" id=\'q\'>'), ("n", None)], "page string, html string")
    assert {(r["kind"], r["name"]) for r in W.class_attributes(p).collect()} == {("class", "a"), ("class", "b"), ("id", "q"), ("stylesheet", "x.css")}
    v = spark.createDataFrame([(1, "margin", "16px"), (2, "margin", "1.05rem"), (3, "margin", "30px"), (4, "margin", "auto"), (5, "margin", None)], "id int, property string, value string")
    assert {r["id"]: r["leader"] for r in W.near_duplicate_styles(v).collect()} == {1: 16.0, 2: 16.0, 3: 30.0}


def test_diagnostics_and_tables(spark):
    lines = spark.createDataFrame([(1, 1, "src/a.ts(3,4): error TS2304: Cannot find x."), (1, 2, "src/b.ts"), (1, 3, "  7:1  warn  Bad thing  no-bad"), (2, 1, "noise")], "output_id int, n int, text string")
    got = {(r["tool"], r["file"], r["line"], r["severity"], r["code"]) for r in X.parse_diagnostics(lines).collect()}
    assert got == {("tsc", "src/a.ts", 3, "error", "TS2304"), ("eslint", "src/b.ts", 7, "warn", "no-bad")}
    t = spark.createDataFrame([(1, 'q("SELECT a FROM users u"); x("insert into Log values")')], "id int, text string")
    assert {(r["operation"], r["table_name"]) for r in X.table_accesses(t).collect()} == {("Read", "users"), ("Write", "Log")}


def test_incremental_plan_and_deletes(spark):
    s = lambda rows: spark.createDataFrame(rows, "path string, hash string")
    before, now = s([("A", "1"), ("b", "1"), ("c", None)]), s([("a", "1"), ("b", "2"), ("d", None)])
    plan = {(r["path"], r["action"]) for r in M.incremental_plan(before, now).collect()}
    assert plan == {("b", "changed"), ("c", "deleted"), ("d", "changed")}
    assert {r["action"] for r in M.incremental_plan(before.limit(0), now).collect()} == {"changed"}
    n, e = plain(spark, [("a", "b"), ("b", "c")])
    left_n, left_e = M.delete_nodes(n, e, n.where("id = 'a'"))
    assert left_n.count() == 2 and [(r["src"], r["dst"]) for r in left_e.collect()] == [("b", "c")]


def test_intents(spark):
    assert T.structural_intent("Who calls  `Foo.Bar`?") == ("callers", "Foo.Bar")
    assert T.structural_intent("dependencies of Foo") == ("callees", "Foo")
    assert T.structural_intent("why") is None
    n, e = graph(spark, [("I", "Interface", "N.A"), ("A", "Class", "n.b"), ("F", "File", "N")], [("A", "Implements", "I"), ("F", "Uses", "I")])
    ask = lambda q: {r["id"] for r in T.answer_intent(n, e, q).collect()}
    assert ask("implementations of I") == {"A"} and ask("who calls i") == {"A", "F"} and ask("members in n") == {"I", "A"} and ask("callees of A") == {"I"}
    assert ask("who calls nobody") == set() and ask("hello") == set()


def most_rows(plan):
    """The most rows that an operator of an executed plan gave."""
    m = plan.metrics().get("numOutputRows")
    below = [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if plan.nodeName().endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().size())]
    return max([m.get().value() if m.isDefined() else 0, *map(most_rows, below)])


def test_calls_do_not_meet_their_candidates_one_by_one(spark):
    m = spark.range(300).selectExpr("'m' || id as id", "'f' as name", "0 as required", "1 as total", "false as variadic", "'o' || id as owner", "'x' || id % 7 as file", "'n' || id % 50 as namespace")
    m = m.unionByName(m.where("id = 'm5'").selectExpr("'g' as id", "'g' as name", "required", "total", "variadic", "owner", "file", "namespace"))
    c = spark.range(400).selectExpr(
        "id as call_id", "case when id = 8 then null when id = 9 then 'h' when id = 10 then 'g' else 'f' end as name", "case when id = 12 then null when id = 16 then 5 else 1 end as args", "'o' || id as src_type",
        "'x9' as src_file", "'n9' as src_namespace", "case when id = 4 then 'o7' end as receiver", "element_at(array('Typed', 'This', 'Unqualified', 'Chained'), cast(id % 4 + 1 as int)) as kind",
    )
    df = X.resolve_calls(c, m)
    got = {r["call_id"]: (r["target"], r["tier"], r["disposition"]) for r in df.collect()}
    assert [got[i] for i in (1, 3, 4, 8, 9, 10, 12, 16)] == [
        ("m1", "own", "resolved"), (None, None, "indeterminate"), ("m7", "receiver", "resolved"), (None, None, "indeterminate"), (None, None, "external"), ("g", "sole", "resolved"),
        (None, None, "indeterminate"), (None, None, "unresolved"),
    ]
    assert len(got) == 400 and got[302] == (None, None, "indeterminate")
    assert most_rows(df._jdf.queryExecution().executedPlan()) <= 400


def test_outcomes_are_worked_out_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    o = spark.range(10).selectExpr("id", "if(id < 8, 'resolved', 'external') as disposition", "if(id < 8, 'sole', null) as reason")
    got = {tuple(r) for r in X.accounting(o.coalesce(1).mapInArrow(count, o.schema)).collect()}
    assert got == {("resolved", "sole", 8, "0,1,2"), ("external", None, 2, "8,9")} and made.value == 10
