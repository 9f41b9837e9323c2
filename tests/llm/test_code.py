import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm.comments import assign, clean, documented, describe, has_code, says_something, split_comments, stem
from graphloom.llm.files import ATTRIBUTES, attribute_macros, attribute_rules, declarations, glob_regex, not_hand_written, text_sign, tidy_path
from graphloom.llm.functions import function_pairs
from graphloom.llm.neighbours import most_similar, read_vector, similar_pairs, usable_vectors

N = (
    "id string, ingest_no long, updated_at int, type string, name string, summary string, source_snippet string, file_path string, file_role string, "
    "project_context string, embedding_csv string, r string, sign string"
)


def nodes(spark, rows):
    base = {"ingest_no": 1, "updated_at": 1}
    cols = [c.split()[0] for c in N.split(", ")]
    return spark.createDataFrame([tuple((base | r).get(c) for c in cols) for r in rows], N)


# Documentation

SAYS = ["Returns null for stale trays.", "Liefert die Einträge in fester Reihenfolge.", "Resolve <see cref=\"X\"/> before the lock is taken.", "Sorts by name. See Foo.", "Retries 3 times"]
NOTHING = [
    None, "", "  ", "TODO", "todo: document this method", "FIXME add docs", "N/A", "...", "-", "?", "xxx", "tbd", "No description.", "Undocumented.", "Same as above.", "See base class.",
    "<inheritdoc/>", "{@inheritDoc}", '<inheritdoc cref="IX"/>', "See ResolveWindow.", "[Proj-123]", "(feb12f9)", "Resolves the window.", "ResolveWindow", "ResolveWindow function", "The resolve window method.",
    "Method to resolve the window.", "This method resolves the window. [Proj-12]", "Summary description for ResolveWindow.", "Copyright (c) X contributors. All rights reserved.", "// eslint-disable-next-line complexity",
    "// -----------------", "// #region Helpers", "// var x = Resolve(1);\n// return x;", "<summary/>", '<param name="x">The x.</param>', "https://example.org/x", "commit 1a2b3c4d",
]


@pytest.mark.parametrize("text", SAYS)
def test_documentation_that_says_something(text):
    assert says_something(text, "ResolveWindow")


@pytest.mark.parametrize("text", NOTHING)
def test_documentation_that_says_nothing(text):
    assert not says_something(text, "ResolveWindow")


def test_clean_and_stem():
    assert clean("/**\n * Walks.\n * @param x the x\n * @returns the y\n */") == "Walks.\nthe y"
    assert clean("/// <summary>\n/// A <see cref=\"T:B.C\"/> d\n/// </summary>") == "A B.C d"
    assert stem("indexes") == stem("index") and stem("classifies") == stem("classify") == stem("classified") and stem("merging") == stem("merge") == stem("Merged")


def test_comments_in_strings_are_none():
    code, found = split_comments('var a = "// no"; // yes\nvar b = `/* no */`; /* y */')
    assert [t for *_, t in found] == ["// yes", "/* y */"] and "// no" in code and "yes" not in code
    assert not has_code("// only\n/* this */\n") and not has_code(None) and has_code("x")


def test_functions_and_their_comments():
    src = (
        "// Copyright (c) A.\n\n/// <summary>Adds a pair.</summary>\n/// <param name=\"left\">L.</param>\n[Obsolete]\npublic int Add(int left)\n{\n    // inside\n    return left;\n}\n"
        "\n// apart\n\nprivate void Drop()\n{\n}\n// one\n// two\nfunction go(a) {\n}\n"
    )
    got = {x.name: (x.text, x.direct) for x in documented(src)}
    assert got == {"Add": ("Adds a pair.", True), "go": ("one\ntwo", True)}


def test_matching_is_the_heaviest():
    assert assign({(0, 0): 1.0, (0, 1): 2.0, (1, 0): 0.5, (1, 1): 1.9}) == {0: 0, 1: 1}
    assert assign({}) == {} and assign({(0, 0): -1.0}) == {}
    # Fewer pairs may weigh more than many: row 0 keeps column 1, row 1 stays alone.
    assert assign({(0, 1): 5.0, (0, 0): 1.0, (1, 1): 3.0}) == {1: 0}


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 4), st.integers(0, 4)), st.integers(-2, 9).map(float), max_size=14))
def test_matching_against_all_matchings(weight):
    from itertools import permutations

    best = max(sum(max(0.0, weight.get((r, c), 0.0)) for r, c in enumerate(p)) for p in permutations(range(5)))
    got = assign(weight)
    assert len(set(got.values())) == len(got) and all(weight[r, c] > 0 for c, r in got.items())
    assert abs(sum(weight[r, c] for c, r in got.items()) - best) < 1e-9


def test_links_compete_and_implausible_ones_are_rejected():
    # Both comments stand above b; the first one's tags are those of a, so a gets it and b the nearer one.
    src = (
        "function a(left, right) {\n}\n\n/** Joins both halves.\n * @param left x\n * @param right y\n */\n\n"
        "// Drops the cache of the tray.\nfunction b(tray) {\n}\n"
    )
    got = {x.name: (x.text, x.direct) for x in documented(src)}
    assert got == {"a": ("Joins both halves.", False), "b": ("Drops the cache of the tray.", True)}
    # Blank lines, other names and foreign tags make a link implausible; the name mends the blank line.
    assert documented("// Keeps the carry of a call.\n\nvoid Add(int a)\n{\n}\n") == []
    assert [x.direct for x in documented("// Add keeps the carry of a call.\n\nvoid Add(int a)\n{\n}\n")] == [False]
    assert documented("// Add keeps the carry of a call.\n// @param zeta z\n\nvoid Add(int a)\n{\n}\n") == []
    assert documented("void Add(int a)\n{\n  // Keeps the carry of a call.\n}\n") == []
    # A comment after the heading, or above a statement, belongs to nobody.
    assert documented("void Add(int a) // Keeps the carry of a call.\n{\n}\n") == []


def test_summary_and_comment_compete():
    code = "/** Keeps the carry of add.\n * @param left x\n */\nfunction add(left) {\n}\n"
    assert describe("add", "Sums with carry.", code) == ("Keeps the carry of add.", "comment")  # tags and name fit
    assert describe("add", "Sums with carry.", code.replace("left x", "zeta x")) == ("Sums with carry.", "summary")
    assert describe("gone", "Sums with carry.", "function add(left) {\n}\n") == ("Sums with carry.", "summary")


def test_many_functions_in_one_source():
    src = "".join(f"/** Moves tray {i} along. */\nfunction f{i}(a) {{\n}}\n\n" for i in range(800))
    assert len(documented(src)) == 800


def test_commented_out_code_says_nothing():
    for code in (
        "// [Obsolete]\n// public IEnumerable FooOld(int a)\n// {\n//   lock (_gate)\n//   return _rows\n//     .Where(x => x.A > 3)\n//     .ToList();\n// }",
        "// public override string FooOld(in Keyword keyword)\n// {\n// return a.B();\n// }",
    ):
        assert not says_something(code, "Foo")


def test_describe():
    code = "public int Add(int a) { return a; }"
    assert describe("Add", "Adds with carry.", code) == ("Adds with carry.", "summary")
    assert describe("Add", "TODO", "// Keeps the carry of the last call.\n" + code) == ("Keeps the carry of the last call.", "comment")
    assert describe("Add", "TODO", "// Keeps the carry.\n\n" + code) is None
    assert describe("Add", "Adds with carry.", "// no code") is None and describe("Add", None, "public int Add()\n{\n  // Keeps the carry of the call.\n}") is None


def test_function_pairs(spark):
    code = "int F(int a) { return a; }"
    df = nodes(spark, [
        {"id": "a", "type": "METHOD", "name": "F", "summary": "Keeps the last carry.", "source_snippet": code},
        {"id": "a", "type": "Method", "name": "F", "summary": "old", "source_snippet": None, "updated_at": 0, "ingest_no": 9},
        {"id": "b", "type": "method", "name": "F", "summary": None, "source_snippet": code},
        {"id": "c", "type": "File", "name": "F", "summary": "Keeps the last carry.", "source_snippet": code},
        {"id": "d", "type": None, "name": None}, {"id": None, "type": "Method"}, {"id": "e", "type": "Method", "name": None, "summary": "Keeps it all.", "source_snippet": "x" * 200_000},
    ])
    assert {r["id"] for r in function_pairs(df).collect()} == {"a", "e"} and function_pairs(df.limit(0)).count() == 0


# Files


def test_globs():
    m = lambda p, x: __import__("re").match(glob_regex(p), x) is not None
    assert m("*.g.cs", "a/b/X.g.cs") and not m("*.g.cs", "a/X.cs") and not m("*.g.cs", "a/X.G.cs")
    assert m("/gen/*.ts", "gen/a.ts") and not m("/gen/*.ts", "a/gen/a.ts") and not m("gen/*.ts", "gen/a/b.ts")
    # An inner slash ties a pattern to its directory, whatever follows.
    assert m("vendor/**", "vendor/a/b.c") and not m("vendor/**", "x/vendor/b.c") and not m("vendor/**", "vendor") and m("**/vendor/**", "x/vendor/b.c")
    assert m("src/**/x.js", "src/x.js") and m("src/**/x.js", "src/a/b/x.js") and m("**/x.js", "x.js") and not m("a**b", "a/b") and m("a**b", "axyb")
    assert m("[!a-c]*.js", "d.js") and not m("[!a-c]*.js", "x/a.js") and m("a[.]b", "a.b") and m("we\\*rd", "we*rd") and not m("we\\*rd", "weird") and m("a?c", "abc") and not m("a?c", "a/c")
    assert glob_regex("obj/") is None and glob_regex("!x") is None and glob_regex("") is None  # a directory is no file


def test_attribute_files():
    g, v = ATTRIBUTES
    text = '# c\n*.pb.go linguist-generated\n"my lib/**" linguist-vendored=false -linguist-generated text\nobj/ linguist-generated\n*.x !linguist-vendored\n*.t tool\n'
    rules = attribute_rules(text, attribute_macros("[attr]tool linguist-generated -diff\n[attr]\n"))
    assert [(n, k, a, x) for n, k, _, a, x in rules] == [(1, 0, g, 1), (2, 0, v, 0), (2, 1, g, 0), (4, 0, v, -1), (5, 1, g, 1)]
    assert rules[1][2] == glob_regex("my lib/**")
    assert attribute_rules("*.t -tool\n*.u tool", {"tool": ["tool", "linguist-generated"]})[0][0] == 1  # a macro that names itself; unset ones say nothing
    assert attribute_rules(None) == [] and attribute_macros(None) == {}
    assert tidy_path(" .\\src//a.cs") == "src/a.cs" and tidy_path(None) == ""


def test_declarations(spark):
    sources = spark.createDataFrame([
        ("p", ".gitattributes", "[attr]made linguist-generated\n*.ts made\nlib/** linguist-vendored\nown/** linguist-generated\n"),
        ("p", "lib/.gitattributes", "ours/** !linguist-vendored\nk.js -linguist-vendored\nx.js -linguist-vendored linguist-vendored\n*.ts -linguist-generated\n"),
        ("p", "own/.gitattributes", "* linguist-generated\nhand.js linguist-generated=false\n"),
        ("q", "sub/.gitattributes", "gen/** linguist-generated\n"),
    ], "project string, path string, rules string")
    paths = ["a.ts", "a.js", "lib/b.js", "lib/k.js", "lib/x.js", "lib/c.ts", "lib/ours/d.js", "lib/ours/d.ts", "own/z.js", "own/hand.js", "deep/lib/b.js", ""]
    files = spark.createDataFrame([(f"p:{x}", "p", x) for x in paths] + [(f"q:{x}", "q", x) for x in ("gen/a.js", "sub/gen/a.js", "a.ts")], "id string, project string, path string")
    got = {r["id"]: r["declared"] for r in declarations(files, sources).collect()}
    assert got == {
        "p:a.ts": True, "p:lib/b.js": True, "p:lib/k.js": False, "p:lib/x.js": True, "p:lib/c.ts": True,  # vendored still, though not generated
        "p:lib/ours/d.ts": False, "p:own/z.js": True, "p:own/hand.js": False, "q:sub/gen/a.js": True,
    }
    assert declarations(files, sources.limit(0)).count() == 0


SIGNS = [
    ("// <auto-generated>\n// x\nclass A {}", "generated"), ("/* @generated by t */\nx", "generated"), ("#nullable enable\n// Code generated by t v1. DO NOT EDIT.\nx", "generated"),
    ("// Ce fichier est généré par t, toute modification sera perdue.\nx", "generated"), ("// Automatisch erzeugt aus a.xml - nicht von Hand ändern\nx", "generated"),
    ("// Nothing in here is auto-generated, whatever the name says.\nx", None), ("// The exporter writes its own do-not-edit banner; this file is ours.\nx", None),
    ("// Written by hand: replaces the generated client we dropped.\nx", None), ("// Copyright (c) A contributors. Some licence.\nclass A {}", None),
    ("/*!\n * lib v1.2.3\n * (c) The lib contributors\n */\nx", "vendored"), ("class A {}\n// @generated by t", None), (None, None), ("", None),
    ("module.exports = [" + "1.5,-2.25," * 60 + "]", "data"), ('const A = "' + "Zx9+" * 100 + '"', "data"), ("const s = [1, 2, 3];\n" + "function walk(node) {\n  return node.next;\n}\n" * 20, None),
    ("function a(b,c){return b+c}var d=e[1]||f;" * 12, "minified"),
]


@pytest.mark.parametrize("text,want", SIGNS)
def test_text_sign(text, want):
    assert text_sign(text) == want


def test_not_hand_written(spark):
    body = "\n".join(f"export function load{i}(a) {{\n  return this.store{i}.read(a, {i});\n}}" for i in range(12))
    f = lambda i, path, text="class A {\n}\n", role="Source", **k: {"id": i, "type": "file", "file_path": path, "source_snippet": text, "file_role": role, "project_context": "p"} | k
    df = nodes(spark, [
        f("hand", "src/CodeGeneration/GeneratedThing.cs"), f("obj", "src\\a\\obj\\Debug\\x.cs"), f("copy", "src/util/y.js", "// patched\n" + body.replace("load3", "load3b")), f("vend", "third_party/p/z.js"),
        f("stale", "src/a.cs", role="Generated"), f("bare", "src/b.cs", None, " generated "), f("null", None, None, None), f("snap", "src/Data/XModelSnapshot.cs"), f("test", "tests/AbcTests.cs"),
        f("m", "obj/x.cs", type="Method"), f("case", "Src/OBJ/x.cs"),
    ])
    items = spark.createDataFrame([(1, body, "x"), (2, None, None), (3, "", None)], "item_id long, content string, id string")
    got = {r["id"]: r["reason"] for r in not_hand_written(df, items).collect()}
    assert got == {"obj": "listed", "copy": "copy", "vend": "listed", "bare": "role", "snap": "listed", "case": "listed"}
    assert not_hand_written(df.limit(0), items.limit(0)).count() == 0


def test_patterns_are_mined_from_declarations_and_used_elsewhere(spark):
    f = lambda i, path, project, text="class A {\n}\n", role="Source": {"id": i, "type": "File", "file_path": path, "source_snippet": text, "file_role": role, "project_context": project}
    rows = []
    for p in ("p", "q"):  # two repositories declare what is in emitted/, and that kept/ is theirs
        rows += [f(f"{p}a", ".gitattributes", p, "emitted/** linguist-generated\nemitted/own.ts -linguist-generated\nobj/** -linguist-generated\n"), f(f"{p}own", "emitted/own.ts", p), f(f"{p}obj", "obj/k.cs", p)]
        rows += [f(f"{p}e{i}", f"emitted/f{i}.ts", p) for i in range(8)] + [f(f"{p}h{i}", f"src/f{i}.ts", p) for i in range(8)]
        rows += [f(f"{p}out", "dist/x.js", p)]  # a repository with an attribute file is not judged by patterns
    rows += [f("r1", "web/Emitted/z.ts", "r"), f("r2", "src/z.ts", "r"), f("r3", "dist/z.js", "r")]  # one without any
    rows += [f(f"s{i}", f"src/made/f{i}.cs", "st"[i % 2], role="Generated") for i in range(9)] + [f("s9", "src/made/g.cs", "s", role=None)]  # roles declare, too
    rows += [f(f"t{i}", f"src/Release/f{i}.cs", "t", role="BuildArtifact" if i % 2 else "Source") for i in range(12)]  # not precise enough
    got = {r["id"]: r["reason"] for r in not_hand_written(nodes(spark, rows), spark.createDataFrame([], "item_id long, content string")).collect()}
    want = {f"{p}e{i}": "declared" for p in "pq" for i in range(8)} | {"r1": "mined", "r3": "listed"} | {f"s{i}": "mined" for i in range(10)}
    assert got == want


# Vectors


def test_read_vector():
    ok = ",".join(["1"] * 4)
    assert read_vector(ok, 4) is not None and read_vector(" 1 , 2,,3,4 ,", 4) is not None
    for bad in (None, "", "1,2,3", "1,2,3,4,5", "0,0,0,0", "1,2,3,nan", "1,2,3,inf", "1,2,3,x", "[1,2,3,4]", "1,2,3,1_0"):
        assert read_vector(bad, 4) is None
    v = np.frombuffer(read_vector("1e300,1e300,0,0", 4), "<f4")
    assert np.allclose(v, [0.5**0.5, 0.5**0.5, 0, 0])


def vectors(spark, x, ids=None):
    csv = [",".join(map(repr, map(float, v))) for v in x]
    return usable_vectors(nodes(spark, [{"id": i, "embedding_csv": c} for i, c in zip(ids or [f"n{k:04d}" for k in range(len(x))], csv)]), dim=x.shape[1])


def top(x, k, ids):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    out = {}
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[i, j], ids[j]))
        out[ids[i]] = [ids[j] for j in order[:k]]
    return out, s


def test_recall_of_the_neighbour_graph(spark):
    rnd = np.random.default_rng(1)
    centres = rnd.standard_normal((40, 16))
    x = centres[rnd.integers(0, 40, 1500)] + 0.5 * rnd.standard_normal((1500, 16))
    ids = [f"n{k:04d}" for k in range(len(x))]
    want, _ = top(x, 5, ids)
    got = {}
    for r in most_similar(vectors(spark, x), 16).collect():
        got.setdefault(r["id"], []).append(r["other"])
    recall = np.mean([len(set(want[i]) & set(got.get(i, []))) / 5 for i in ids])
    assert recall >= 0.9 and all(len(v) == 5 for v in got.values())


def test_copies_ties_and_threshold(spark):
    rnd = np.random.default_rng(2)
    x = np.concatenate([np.tile(rnd.standard_normal(8), (30, 1)), rnd.standard_normal((20, 8))])
    x = np.concatenate([x, x[30:32] * 3 + 0.01 * rnd.standard_normal((2, 8))])
    ids = [f"n{(k * 7) % 52:04d}" for k in range(len(x))]
    want, s = top(x, 5, ids)
    at = {i: k for k, i in enumerate(ids)}
    pairs = {tuple(sorted((i, j))) for i, js in want.items() for j in js if s[at[i], at[j]] >= 0.92}
    assert {(r["id_a"], r["id_b"]) for r in similar_pairs(vectors(spark, x, ids), 8).collect()} == pairs


def test_no_and_single_vectors(spark):
    x = np.ones((1, 4))
    assert most_similar(vectors(spark, x), 4).count() == 0 and most_similar(vectors(spark, x).limit(0), 4).count() == 0


def test_greedy_search_finds_the_nearest(spark):
    from graphloom.llm.neighbours import search_vectors

    rnd = np.random.default_rng(5)
    centres = rnd.standard_normal((30, 16))
    x = centres[rnd.integers(0, 30, 1200)] + 0.5 * rnd.standard_normal((1200, 16))
    x[7] = x[8]  # one vector of two ids
    v = vectors(spark, x)
    q = v.where("id like '%00'").selectExpr("cast(substring(id, 2) as bigint) as q", "vec")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got, hit, n = {}, 0, 0
    for r in search_vectors(v, q, 16).collect():
        got.setdefault(r["q"], []).append(r["cosine"])
    for i, cos in got.items():
        best = np.unique(np.round(u @ u[i], 6))[::-1][:5]
        hit += sum(c >= best[-1] - 2e-6 for c in cos)
        n += len(cos)
    assert len(got) == 12 and n == 60 and hit / n >= 0.9
    assert search_vectors(v, q.limit(0), 16).count() == 0


def test_all_vectors_that_meet_are_compared():
    import pyarrow as pa

    from graphloom.llm.neighbours import _meet

    rnd = np.random.default_rng(3)
    v = rnd.standard_normal((1300, 8))
    v[1299] = v[0]  # far apart in the input
    q = np.rint(v * (32767 / np.abs(v).max(1, keepdims=True))).astype("<i2")
    n = len(v)
    t = pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(n, np.int64)), pa.array(np.arange(n)), pa.array(np.full(n, -1, np.float32)), pa.array([r.tobytes() for r in q], pa.binary())], names=["at", "cls", "least", "short"]
    )
    got = {}
    for b in _meet([t], 8, -1.0, 4):
        for c, nbr in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got[c] = set(np.frombuffer(nbr, "<i8"))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -3)
    want = np.argsort(-s, axis=1)[:, :4]
    assert all(len(got[i] & set(want[i])) >= 3 for i in range(n)) and 1299 in got[0] and 0 in got[1299]


def test_recall_in_a_dense_cluster(spark):
    """More nearly equal vectors than links, closer to each other than 8 bits could tell."""
    rnd = np.random.default_rng(4)
    centre = rnd.standard_normal(64)
    x = np.concatenate([centre + 0.02 * rnd.standard_normal((900, 64)), rnd.standard_normal((600, 64))])
    x = x[rnd.permutation(len(x))]
    ids = [f"n{k:04d}" for k in range(len(x))]
    want, s = top(x, 5, ids)
    at = {i: k for k, i in enumerate(ids)}
    pairs = {tuple(sorted((i, j))) for i, js in want.items() for j in js if s[at[i], at[j]] >= 0.92}
    got = {(r["id_a"], r["id_b"]) for r in similar_pairs(vectors(spark, x, ids), 64).collect()}
    assert len(got & pairs) >= 0.9 * len(pairs) and len(got & pairs) >= 0.9 * len(got)
