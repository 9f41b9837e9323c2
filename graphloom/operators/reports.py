"""Reports by rubric: test shield, responsibility slices, extraction, patterns, feature paths, documents of a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cosine, freshness, layer
from ..plans.session import Workspace
from .model import PRODUCTION_ROLES, TRAVERSAL
from .scoring import shared_evidence, test_role
from .structural import coverage_gaps, god_classes, hotspots
from .traverse import impact, inside

#: Words of tests that only support other tests.
SUPPORT_WORDS = ["builder", "fixture", "helper", "factory", "setup", "arrange", "stub", "mock", "fake", "spy", "double", "harness", "seed"]
#: Words in name, summary and surroundings of a method, and the slice they show, in this order.
SLICE_WORDS = [
    ("ContextPacks", ["context", "minimal", "editing", "pack"]),
    ("Impact", ["impact", "downstream", "caller", "connection", "blast"]),
    ("Diagnostics", ["diagnostic", "fresh", "drift", "stale"]),
    ("Knowledge", ["knowledge", "document", "docs", "keyword"]),
    ("Configuration", ["config", "option", "setting"]),
    ("Search", ["search", "query", "find", "resolve"]),
]
#: Words of method names that name no responsibility; words of callers that start a workflow; types
#: that any method may mention.
GENERIC_WORDS = ["handle", "process", "execute", "validate", "update", "create", "get", "set"]
WORKFLOW_WORDS = ["tool", "controller", "endpoint", "command", "cli", "workflow"]
FRAMEWORK_NAMES = ["CancellationToken", "Task", "ValueTask", "String", "Int32", "Boolean", "Object"]
DEPENDENCY_TYPES = ["Class", "Interface", "Method", "ConfigurationKey", "ApiEndpoint"]
#: Limits of a slice, and what a goal says that asks for other contracts.
SLICE_METHODS, SLICE_SHARE, SLICE_EVIDENCE = 24, 0.7, 0.25
CONTRACT_GOALS = ["interface", "contract", "port", "signature", "public api", "repository pattern"]
_STEM = r"([^/\\]+?)(?:\.[^./\\]*)?$"


def _low(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def _has(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def _alike(a: Column, b: Column) -> Column:
    return (F.length(a) > 0) & (F.length(b) > 0) & (a.contains(b) | b.contains(a))


def located(t: str, p: str) -> Column:
    """Whether a test stands near a node: same file, same namespace, or file names (or names) one in the other."""
    stem = lambda x: F.lower(F.regexp_extract(F.coalesce(F.col(f"{x}_file"), F.lit("")), _STEM, 1))
    name = lambda x: _low(f"{x}_name")
    files = F.col(f"{t}_file").isNotNull() & F.col(f"{p}_file").isNotNull()
    same = lambda c: F.coalesce(F.lower(F.col(f"{t}_{c}")) == F.lower(F.col(f"{p}_{c}")), F.lit(False))
    return same("file") | same("ns") | files & (_alike(stem(t), stem(p)) | _alike(stem(t), name(p)) | _alike(stem(p), name(t)))


def _named(nodes: DataFrame, p: str) -> DataFrame:
    return nodes.select(F.col("id").alias(p), F.col("file_path").alias(f"{p}_file"), F.col("namespace").alias(f"{p}_ns"), F.col("name").alias(f"{p}_name"))


def test_shield(nodes: DataFrame, edges: DataFrame, target: str, depth: int = 2, limit: int = 20) -> DataFrame:
    """``shield, id, protects, score``: tests around a target and what calls it, and callers without any test.

    The path is the target and what it affects (a report of at most 50 nodes), tests left out. A test protects a
    node directly if it calls it, else by its place (:func:`located`). Score: 100 direct, 50 if the node is not the
    target, 10 for each dependency it shares with the target, 5 by place. ``direct`` are tests that call the target,
    ``primary`` those that call another node of the path; the rest, and tests that only support others, are
    ``secondary``; a test counts once, in its best way. ``unshielded`` are nodes of the path with no test.
    The best ``limit`` of each kind are given, by score, name and id. An unknown target has no rows.
    """
    ws = Workspace(nodes.sparkSession, "shield")
    wanted = impact(nodes, edges, target, depth).select("id").unionByName(nodes.where(F.col("id") == target).select("id")).distinct()
    path = ws.cut(_named(nodes.where(~test_role()).join(wanted, "id", "left_semi"), "p"))
    support = _has(F.lower(F.concat_ws(" ", "name", "file_path", "namespace")), SUPPORT_WORDS)
    tests = nodes.where(test_role()).withColumn("support", support)
    peers = tests.where("type = 'Method' and not support and file_path is not null").select(F.lower("file_path").alias("f")).distinct().withColumn("peer", F.lit(True))
    tests = tests.withColumn("f", F.lower("file_path")).join(peers, "f", "left")
    fit = ~F.col("support") & ((F.col("type") == "Method") | (F.col("type") == "Class") & F.col("peer").isNull())
    flags = tests.select(F.col("id").alias("t"), fit.alias("fit"))
    calls = edges.where("type = 'Calls'").join(path.select(F.col("p").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("p"), F.col("src").alias("t"))
    calls = calls.join(flags.select("t"), "t", "left_semi").distinct()
    # The path is a stated set of at most 51 rows against all tests.
    near = _named(tests, "t").join(F.broadcast(path), located("t", "p")).select("p", "t")
    pairs = near.select("p", "t", F.lit(0).alias("d"), F.lit(1).alias("l")).unionByName(calls.select("p", "t", F.lit(1).alias("d"), F.lit(0).alias("l")))
    pairs = ws.cut(pairs.groupBy("p", "t").agg(F.max("d").alias("direct"), F.max("l").alias("place")))
    deps = edges.where(F.col("type").isin(TRAVERSAL)).join(path.select(F.col("p").alias("src")), "src", "left_semi").select(F.col("src").alias("p"), "dst").distinct()
    shared = deps.join(deps.where(F.col("p") == target).select("dst"), "dst", "left_semi").groupBy("p").agg(F.count("*").alias("shared"))
    far = (F.col("p") != target).cast("int")
    score = 100 * F.col("direct") + 50 * far + 10 * F.coalesce("shared", F.lit(0)) + 5 * F.col("place")
    rank = F.when(F.col("fit") & (F.col("direct") == 1), far).otherwise(2)
    rows = pairs.join(shared, "p", "left").join(flags, "t").select("t", "p", score.cast("int").alias("score"), rank.alias("rank"))
    best = rows.groupBy("t").agg(F.min(F.struct("rank", -F.col("score"), "p")).alias("m"))
    kinds = F.array(F.lit("direct"), F.lit("primary"), F.lit("secondary"))
    found = best.select(kinds[F.col("m.rank")].alias("shield"), F.col("t").alias("id"), F.col("m.p").alias("protects"), (-F.col("m.col2")).alias("score"))
    bare = path.join(pairs.select("p").distinct(), "p", "left_anti").select(F.lit("unshielded").alias("shield"), F.col("p").alias("id"), F.lit(None).cast("string").alias("protects"), F.lit(0).alias("score"))
    first = Window.partitionBy("shield").orderBy(F.desc("score"), F.lower("name"), "id")
    all_ = found.unionByName(bare).join(nodes.select("id", "name"), "id")
    return all_.withColumn("n", F.row_number().over(first)).where(F.col("n") <= limit).select("shield", "id", "protects", "score")


def plural(c: Column) -> Column:
    """The plural of an English name; what ends like a plural stays."""
    return (
        F.when(c.rlike("(?i)(ies|ses|xes|zes|ches|shes)$"), c).when(c.rlike("(?i)[^aeiou]y$") & (F.length(c) > 1), F.concat(F.expr("left(__n, length(__n) - 1)"), F.lit("ies")))
        .when(c.rlike("(?i)(s|x|z|ch|sh)$"), F.concat(c, F.lit("es"))).otherwise(F.concat(c, F.lit("s")))
    )


def words_of(c: Column) -> Column:
    """Words of an identifier in lower case: a word ends before a capital and at what is no letter or digit."""
    spaced = F.regexp_replace(F.regexp_replace(c, r"(\p{Lu})", " $1"), r"[^\p{L}\p{Nd}]+", " ")
    return F.filter(F.split(F.lower(F.trim(spaced)), " +"), lambda w: w != "")


def _identifier(c: Column) -> Column:
    """The last part of a name without parameters, the mark of interfaces and the ending Async."""
    last = F.element_at(F.filter(F.split(F.trim(F.substring_index(c, "(", 1)), r"\."), lambda x: F.trim(x) != ""), -1)
    return F.regexp_replace(F.regexp_replace(F.coalesce(last, c), r"^I(?=\p{Lu})", ""), "(?i)async$", "")


def clean_name(c: Column) -> Column:
    """The first three telling words of a name, joined; the name itself if it has none."""
    telling = F.slice(F.filter(words_of(_identifier(c)), lambda w: ~w.isin(GENERIC_WORDS)), 1, 3)
    joined = F.array_join(F.transform(telling, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")
    return F.when(F.size(telling) > 0, joined).otherwise(c)


def slice_signals(nodes: DataFrame, edges: DataFrame, owner: str) -> DataFrame:
    """``id, name, summary`` of the methods of a class with lists of dependencies, workflow callers and tests
    (structs of name and id, sorted), each as long as the method has edges."""
    own = inside(nodes, edges, owner).where("level > 0").select("id")
    m = nodes.where(F.col("type") == "Method").where(~test_role()).join(own, "id", "left_semi").select("id", "name", "summary")
    e = edges.where(F.col("type").isin(TRAVERSAL)).select("src", "dst", "type").distinct()
    who = nodes.select(
        F.col("id").alias("other"), F.struct("name", "id").alias("who"), test_role().alias("is_test"),
        (F.col("type").isin(DEPENDENCY_TYPES) & ~F.element_at(F.split(F.substring_index("name", "(", 1), r"\."), -1).isin(FRAMEWORK_NAMES) & ~_system()).alias("usable"),
        (F.col("type").isin("ApiEndpoint", "ExternalConcept") | _has(F.lower(F.concat_ws(" ", "name", "namespace", "file_path")), WORKFLOW_WORDS)).alias("flow"),
    )
    mine = m.select(F.col("id").alias("m"))
    out = e.join(mine.withColumnRenamed("m", "src"), "src", "left_semi").select(F.col("src").alias("m"), F.col("dst").alias("other"), F.lit("out").alias("way"), "type")
    into = e.join(mine.withColumnRenamed("m", "dst"), "dst", "left_semi").select(F.col("dst").alias("m"), F.col("src").alias("other"), F.lit("in").alias("way"), "type")
    j = out.unionByName(into).join(who, "other").where("m != other")
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("who"))))
    g = j.groupBy("m").agg(
        pick((F.col("way") == "out") & F.col("usable") & ~F.col("is_test")).alias("deps"), pick((F.col("way") == "in") & F.col("flow") & ~F.col("is_test")).alias("flows"),
        pick((F.col("way") == "in") & F.col("is_test") & (F.col("type") == "Calls")).alias("tests"),
    )
    none = F.array().cast("array<struct<name:string,id:string>>")
    return m.join(g, m["id"] == g["m"], "left").select("id", "name", "summary", *[F.coalesce(c, none).alias(c) for c in ("deps", "flows", "tests")])


def _system() -> Column:
    ns = F.coalesce(F.col("namespace"), F.lit(""))
    return (ns == "System") | ns.startswith("System.Threading")


def responsibility_slices(nodes: DataFrame, edges: DataFrame, owner: str, docs: int = 0, groups: DataFrame | None = None) -> DataFrame:
    """``slice, methods, deps, callers, tests, score, confidence, shared, verdict`` of a class.

    A method's slice is the first of SLICE_WORDS of which a word stands in its name, summary, the names of workflow
    callers or dependencies; else it is named after its first workflow caller, its first dependency, or the first
    telling word of its name, in the plural, else ``Deferred``. Score: methods + 5 dependencies + 4 workflow callers
    + 4 tests (each counted once) + 2 for each of up to three documents, less 3 without any evidence, plus a bonus
    for methods that ``groups`` (id, community) puts together: 1 if two or more are in the slice's largest group.
    High from 18 with two such methods, Medium from 9. Slices of one method need a score of 8. ``verdict`` is
    ``defer`` for a slice of more than 24 methods, of more than 0.7 of at least 8 methods, or of 4 or more methods
    of which less than a quarter of the pairs share evidence (``shared``).
    """
    ws = Workspace(nodes.sparkSession, "slices")
    s = slice_signals(nodes, edges, owner)
    text = F.lower(F.concat_ws(" ", "name", F.coalesce("summary", F.lit("")), F.array_join("flows.name", " "), F.array_join("deps.name", " ")))
    word = F.element_at(F.concat(F.filter(words_of(F.col("name")), lambda w: ~w.isin(GENERIC_WORDS)), F.array(F.lit(""))), 1)
    base = F.when(F.size("flows") > 0, _flow_name()).when(F.size("deps") > 0, F.col("deps")[0]["name"]).otherwise(word)
    s = s.withColumn("__base", base).withColumn("__n", F.when(F.col("__base") == "", "").otherwise(clean_name(F.col("__base"))))
    ladder = F.lit(None).cast("string")
    for name, terms in reversed(SLICE_WORDS):
        ladder = F.when(_has(text, terms), name).otherwise(ladder)
    s = s.withColumn("slice", F.coalesce(ladder, F.when(F.col("__n") == "", "Deferred").otherwise(plural(F.col("__n"))))).withColumn("key", F.lower("slice"))
    s = ws.cut(s.select("id", "slice", "key", "deps", "flows", "tests"))
    evidence = s.select("key", "id", F.explode_outer(F.concat("deps.id", "flows.id", "tests.id")).alias("x"))
    ratio = shared_evidence(evidence.select(F.col("key").alias("group"), "id", F.col("x").alias("evidence"))).select(F.col("group").alias("key"), "share")
    many = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(f"{c}.id")))).cast("long")
    g = s.groupBy("key").agg(
        F.min("slice").alias("slice"), F.count("*").alias("methods"), many("deps").alias("deps"), many("flows").alias("callers"), many("tests").alias("tests"),
    )
    if groups is None:
        g = g.withColumn("together", F.lit(0).cast("long"))
    else:
        per = s.select("key", "id").join(groups.select("id", "community"), "id").groupBy("key", "community").agg(F.count("*").alias("k")).groupBy("key").agg(F.max("k").alias("together"))
        g = g.join(per, "key", "left").withColumn("together", F.coalesce("together", F.lit(0).cast("long")))
    bare = (F.col("deps") + F.col("callers") + F.col("tests")) == 0
    score = (
        F.col("methods") + 5 * F.col("deps") + 4 * F.col("callers") + 4 * F.col("tests") + 2 * min(docs, 3)
        - F.when(bare, 3).otherwise(0) + F.when(F.col("together") >= 2, 1).otherwise(0)
    )
    total = s.agg(F.count("*").alias("total"))
    j = g.withColumn("score", score).join(ratio, "key", "left").crossJoin(F.broadcast(total))  # one row
    wide = (F.col("methods") > SLICE_METHODS) | (F.col("total") >= 8) & (F.col("methods") / F.col("total") > SLICE_SHARE) | (F.col("methods") >= 4) & (F.coalesce("share", F.lit(0.0)) < SLICE_EVIDENCE)
    confidence = F.when((F.col("score") >= 18) & (F.col("together") >= 2), "High").when(F.col("score") >= 9, "Medium").otherwise("Low")
    return j.where("methods > 1 or score >= 8").select(
        "slice", "methods", "deps", "callers", "tests", "score", confidence.alias("confidence"), F.coalesce("share", F.lit(0.0)).alias("shared"),
        F.when(wide, "defer").otherwise("keep").alias("verdict"),
    )


def _flow_name() -> Column:
    """Name of the first workflow caller; of an endpoint the last part of its route."""
    name = F.col("flows")[0]["name"]
    part = F.regexp_extract(name, r"\S*/([^/\s]+)/?\s*$", 1)
    return F.when(part != "", part).otherwise(name)


def extraction_suggestions(nodes: DataFrame, edges: DataFrame, found: DataFrame, least: int = 3, primary: int = 5) -> DataFrame:
    """Communities (``id, community``) worth a module of their own, with the parts of their score.

    Members are production classes, interfaces and methods, at least ``least``. Points: 6 for 4 to 8 members, 4 for 3,
    3 up to 12, else 1; 3 (2) if 0.8 (0.6) of the whole community are production; 3 (2) for up to 2 (4) files; 2 with
    a test that calls a member; less 1 for each coverage gap and 2 for each layer beyond the first; 2 if the anchor
    has a fan-in of 3 among the hotspots, 3 if it is a god class. The anchor is a god class if there is one, then
    the greatest fan-in, lines, changes, then the first name. ``is_primary`` needs ``primary`` points, production
    in the majority and more than low confidence.
    """
    ws = Workspace(nodes.sparkSession, "extraction")
    # Each part below reads the graph several times; over its tables, one plan of all of them outgrows the driver.
    nodes = ws.cut(nodes.select("id", "name", "type", "namespace", "file_path", "line_count", "file_role", "change_count"))
    edges = ws.cut(edges.select("src", "dst", "type"))
    found = ws.cut(found.select("id", "community"))
    prod = F.coalesce("file_role", F.lit("Unknown")).isin(PRODUCTION_ROLES) & ~test_role()
    all_ = found.select("id", "community").join(nodes, "id").withColumn("prod", prod)
    ratio = all_.groupBy("community").agg(F.avg(F.col("prod").cast("double")).alias("ratio"))
    m = all_.where(F.col("prod") & F.col("type").isin("Method", "Class", "Interface"))
    hot = ws.cut(hotspots(nodes, edges, limit=50).select("id", "fan_in"))
    god = ws.cut(god_classes(nodes, edges, 300, 3).select("id", F.lit(True).alias("god")))
    gaps = ws.cut(coverage_gaps(nodes, edges).select("id", F.lit(1).alias("gap")))
    m = ws.cut(
        m.select("id", "community", "name", "file_path", "namespace", "line_count", "change_count")
        .join(hot, "id", "left").join(god, "id", "left").join(gaps, "id", "left")
        .withColumn("layer", layer(F.col("namespace"), F.col("file_path")))
    )
    tests = nodes.where(test_role()).select(F.col("id").alias("src"))
    calls = edges.where("type = 'Calls'").join(tests, "src", "left_semi").select("src", F.col("dst").alias("id"))
    tested = m.select("id", "community").join(calls, "id").groupBy("community").agg(F.count_distinct("src").alias("tests"))
    order = F.struct(
        F.when(F.col("god"), 0).otherwise(1), -F.coalesce("fan_in", F.lit(0)), -F.coalesce("line_count", F.lit(0)), -F.coalesce("change_count", F.lit(0)), F.lower("name"), F.col("id")
    )
    g = m.groupBy("community").agg(
        F.count("*").alias("members"), F.count_distinct(F.lower(F.when(F.trim("file_path") != "", F.col("file_path")))).alias("files"), F.sum(F.coalesce("gap", F.lit(0))).alias("gaps"),
        F.count_distinct(F.when(F.col("layer") != "Unknown", F.col("layer"))).alias("layers"), F.min_by(F.struct("id", "fan_in", "god"), order).alias("a"),
    ).where(F.col("members") >= least)
    j = g.join(ratio, "community").join(tested, "community", "left").withColumn("tests", F.coalesce("tests", F.lit(0).cast("long")))
    fan = F.coalesce("a.fan_in", F.lit(0)) >= 3
    big = F.coalesce("a.god", F.lit(False))
    n = F.col("members")
    score = (
        F.when(n.between(4, 8), 6).when(n == 3, 4).when(n <= 12, 3).otherwise(1) + F.when(F.col("ratio") >= 0.8, 3).when(F.col("ratio") >= 0.6, 2).otherwise(0)
        + F.when(F.col("files") <= 2, 3).when(F.col("files") <= 4, 2).otherwise(0) + F.when(F.col("tests") > 0, 2).otherwise(0) - F.col("gaps")
        - 2 * F.greatest(F.lit(0), F.col("layers") - 1) + F.when(fan, 2).otherwise(0) + F.when(big, 3).otherwise(0)
    )
    sure = (
        F.when((F.col("ratio") >= 0.8) & (F.col("tests") > 0) & (F.col("gaps") == 0) & (F.col("layers") <= 1) & (big | fan), "High")
        .when((F.col("ratio") >= 0.6) & (F.col("tests") > 0) & (F.col("layers") <= 2), "Medium").otherwise("Low")
    )
    j = j.withColumn("score", score.cast("long")).withColumn("confidence", sure)
    return j.select(
        "community", F.col("a.id").alias("anchor"), "members", "files", "tests", "gaps", "layers", F.round("ratio", 4).alias("ratio"), "score", "confidence",
        ((F.col("score") >= primary) & (F.col("confidence") != "Low") & (F.col("ratio") > 0.5)).alias("is_primary"),
    )


def pattern_seeds(nodes: DataFrame, term: str, vectors: DataFrame | None = None, query: list[float] | None = None, each: int = 24, lexical: float = 0.55, least: float = 0.45) -> DataFrame:
    """``id, seed, how``: nodes whose name has a term (``lexical``) and nodes whose vector is near a query (cosine of
    at least ``least``), the first ``each`` of both; a node found both ways keeps the greater value."""
    code = nodes.where(F.col("type").isin("Class", "Method", "Interface"))
    s = code.where(_low("name").contains(term.lower())).orderBy("name", "id").limit(each).select("id", F.lit(lexical).alias("seed"), F.lit("lexical").alias("how"))
    if vectors is not None and query is not None:
        q = F.array(*[F.lit(float(x)) for x in query])
        near = vectors.join(code.select("id"), "id", "left_semi").select("id", F.round(cosine(F.col("embedding"), q), 6).alias("seed")).where(F.col("seed") >= least)
        s = s.unionByName(near.orderBy(F.desc("seed"), "id").limit(each).withColumn("how", F.lit("embedding")))
    return s.groupBy("id").agg(F.max("seed").alias("seed"), F.array_join(F.array_sort(F.collect_set("how")), ",").alias("how"))


def implementation_patterns(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, limit: int = 10) -> DataFrame:
    """``scope, id, score, how``: the best example of a pattern per scope, from ``seeds`` (:func:`pattern_seeds`).

    Of a seed's neighbours, five kinds of evidence count 18 each (callers, callees, interfaces, stores, entry points)
    and two kinds are needed; up to three tests that call it count 8, up to two more of its namespace 3, and entry,
    store and external 6 each; low freshness costs 25, medium 6; the seed's value counts up to 100. A scope is three
    parts of the namespace, else two of the path.
    """
    ws = Workspace(nodes.sparkSession, "patterns")
    seed = ws.cut(seeds.join(nodes, "id"))
    ids = seed.select("id")
    e = edges.where(F.col("type").isin(TRAVERSAL)).select("src", "dst", "type").distinct()
    kinds = nodes.select(F.col("id").alias("other"), F.col("type").alias("kind"), test_role().alias("is_test"))
    near = (
        e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("other"), "type", F.lit(True).alias("out"))
        .unionByName(e.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("other"), "type", F.lit(False).alias("out")))
        .join(kinds, "other")
    )
    any_ = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int"))
    called = F.when(~F.col("out") & F.col("is_test") & (F.col("type") == "Calls"), F.col("other"))
    g = near.groupBy("id").agg(
        any_(~F.col("out") & ~F.col("is_test")).alias("callers"), any_(F.col("out")).alias("callees"), any_(F.col("out") & (F.col("type") == "Implements")).alias("bases"),
        any_(F.col("kind").isin("DatabaseTable", "MessageTopic")).alias("store"), any_(F.col("kind") == "ApiEndpoint").alias("entry"), any_(F.col("kind") == "ExternalConcept").alias("external"),
        F.count_distinct(called).alias("direct"), F.collect_set(called).alias("by"),
    )
    tests = nodes.where(test_role() & F.col("namespace").isNotNull()).select("namespace", F.col("id").alias("t"))
    more = (
        seed.select("id", "namespace").join(g.select("id", "by"), "id").join(tests, "namespace").where(~F.array_contains("by", F.col("t")) & (F.col("t") != F.col("id")))
        .groupBy("id").agg(F.count("*").alias("guess"))
    )
    found = F.col("callers") + F.col("callees") + F.col("bases") + F.col("store") + F.col("entry")
    less = F.when(freshness() == "Low", 25).when(freshness() == "Medium", 6).otherwise(0)
    score = (
        F.round(100 * F.col("seed")) + 18 * found + 8 * F.least("direct", F.lit(3)) + 3 * F.least(F.coalesce("guess", F.lit(0)), F.lit(2))
        + 6 * (F.col("entry") + F.col("store") + F.col("external")) - less
    )
    space = F.when(F.trim(F.coalesce("namespace", F.lit(""))) != "", F.substring_index("namespace", ".", 3))
    scope = F.coalesce(space, F.substring_index(F.replace(F.col("file_path"), F.lit("\\"), F.lit("/")), "/", 2), F.lit("(none)"))
    s = seed.join(g, "id").join(more, "id", "left").where(found >= 2).select(scope.alias("scope"), "id", score.cast("int").alias("score"), "how")
    best = s.groupBy("scope").agg(F.min_by(F.struct("id", "score", "how"), F.struct(-F.col("score"), F.col("id"))).alias("b")).select("scope", "b.*")
    return best.orderBy(F.desc("score"), "scope").limit(limit)


def _api(p: str = "") -> Column:
    f = F.lower(F.replace(F.coalesce(F.col(p + "file_path"), F.lit("")), F.lit("\\"), F.lit("/")))
    return (F.col(p + "type") == "ApiEndpoint") | f.contains("/api/") | f.contains("/controllers/")


def _infrastructure() -> Column:
    return F.replace(_low("file_path"), F.lit("\\"), F.lit("/")).contains("/infrastructure/") | _low("namespace").contains(".infrastructure")


def _contract() -> Column:
    stem = F.regexp_extract(F.coalesce("file_path", F.lit("")), _STEM, 1)
    return (
        (F.col("type") == "Interface") | stem.rlike(r"^I\p{Lu}") | _low("name").contains("interface") | _low("name").contains("port")
        | _low("file_path").contains("port") | _low("file_path").contains("abstractions")
    )


def feature_path(nodes: DataFrame, feature: str, terms: list[str], limit: int = 12) -> DataFrame:
    """``id, score, layer`` of the nodes along a feature, best first.

    Candidates have a file and the feature or one of the terms in name, summary, path or namespace. Points: 5 for a
    method, 4 for a class, interface or endpoint, 2 for a file, else 1; 6 if name or summary has the whole feature;
    3 for each term found anywhere, 6 more from two of them, 8 more for methods; 2 for each term in name or summary;
    8 less for a contract unless the feature asks for one, else 2 more for contracts, endpoints and infrastructure;
    6 less for tests.
    """
    low = feature.lower()
    terms = list(dict.fromkeys(t.lower() for t in terms))
    where = lambda t, cols: F.greatest(*[_low(c).contains(t).cast("int") for c in cols])
    hits = sum((where(t, ["name", "summary", "file_path", "namespace"]) for t in terms), F.lit(0))
    plain = sum((where(t, ["name", "summary"]) for t in terms), F.lit(0))
    whole = where(low, ["name", "summary"])
    any_ = (hits > 0) | (where(low, ["name", "summary", "file_path", "namespace"]) > 0)
    asks = any(w in low for w in CONTRACT_GOALS)
    contract = F.when(_contract() & F.lit(not asks), -8).when(_contract() | _api() | _infrastructure(), 2).otherwise(0)
    kind = F.when(F.col("type") == "Method", 5).when(F.col("type").isin("Class", "Interface", "ApiEndpoint"), 4).when(F.col("type") == "File", 2).otherwise(1)
    test = (F.coalesce("file_role", F.lit("")) == "Test") | _low("file_path").contains("test")
    score = (
        kind + 6 * whole + 3 * hits + F.when(hits >= 2, 6).otherwise(0) + F.when((hits >= 2) & (F.col("type") == "Method"), 8).otherwise(0) + 2 * plain
        + contract - F.when(test, 6).otherwise(0)
    )
    found = nodes.where((F.trim(F.coalesce("file_path", F.lit(""))) != "") & any_)
    return (
        found.select("id", score.cast("int").alias("score"), layer(F.col("namespace"), F.col("file_path")).alias("layer"), "file_path")
        .orderBy(F.desc("score"), F.lower("file_path"), "id").limit(limit).select("id", "score", "layer")
    )


def feature_status(nodes: DataFrame, edges: DataFrame, docs: DataFrame, ranked: DataFrame, feature: str, terms: list[str]) -> DataFrame:
    """One row on a feature path: ``status, confidence, risk`` and the counts behind them.

    ``docs`` are the documents found for the feature (id, source, content); tests are those that call a ranked node.
    A document matches if its source is below docs/features/ or source or content has the feature; code is direct if
    a name or summary has the feature or a term.
    """
    low, ws = feature.lower(), Workspace(nodes.sparkSession, "feature")
    r = ws.cut(ranked.select("id").join(nodes, "id"))
    direct = F.lit(False)
    for t in [low, *(x.lower() for x in terms)]:
        direct = direct | _low("name").contains(t) | _low("summary").contains(t)
    yes = lambda c: F.coalesce(F.max(c.cast("int")), F.lit(0))
    a = r.agg(
        F.count("*").alias("nodes"), yes(direct).alias("direct"), yes(freshness() == "High").alias("fresh"), F.count_if(freshness() == "Low").alias("stale"),
        (yes(_api()) * yes(_infrastructure()) + yes(_contract()) * yes(_infrastructure())).alias("crosses"),
    )
    tests = nodes.where(test_role()).select(F.col("id").alias("src"))
    b = edges.where("type = 'Calls'").join(r.select(F.col("id").alias("dst")), "dst", "left_semi").join(tests, "src", "left_semi").agg(F.count_distinct("src").alias("tests"))
    source = F.lower(F.replace(F.coalesce("source", "id"), F.lit("\\"), F.lit("/")))
    match = source.contains("docs/features/") | source.contains(low) | _low("content").contains(low)
    c = docs.agg(F.count("*").alias("documents"), yes(match).alias("match"))
    j = a.crossJoin(b).crossJoin(c)  # one row each
    n, d, t = F.col("nodes"), F.col("documents"), F.col("tests")
    status = (
        F.when((d == 0) & (n == 0), "not_found_in_graph").when(n == 0, "planned_or_documented_without_code_surface").when((d > 0) & (t > 0), "documented_with_code_and_test_evidence")
        .when(d > 0, "documented_with_possible_code_surface").otherwise("possible_code_surface_without_feature_doc")
    )
    sure = F.when((F.col("match") == 1) & (F.col("direct") == 1) & (t > 0) & (F.col("fresh") == 1), "high").when((d > 0) & (n > 0), "medium").otherwise("low")
    far = F.col("crosses") > 0
    risk = F.when(n == 0, "unknown").when(far & (t == 0) | (F.col("stale") > F.floor(n / 3)), "high").when(far | (t == 0) | (n > 8), "medium").otherwise("low")
    return j.select("nodes", "documents", "tests", status.alias("status"), sure.alias("confidence"), risk.alias("risk"))


def change_documents(files: DataFrame, node_words: DataFrame, doc_words: DataFrame, docs: DataFrame, limit: int = 20) -> DataFrame:
    """``source, id, score, confidence``: documents that share keywords with a change.

    ``files``: file_path of the changed files, whose parts of three letters and more weigh 0.6; ``node_words`` and
    ``doc_words``: id, keyword, weight, those of changed nodes counted 1.5 times. A keyword's weight in the change is
    its greatest. Score: sum over common keywords of both weights, times 1.8 if the document's source has the keyword,
    else 1.25 below docs/features/, else 1.15 for README.md and TODO.md. High from 8, Medium from 4; less is left out,
    and so are changed files themselves. Each source is named once, by its best document.
    """
    parts = files.where("file_path is not null").select(F.explode(F.split(F.lower("file_path"), r"[/\\._-]")).alias("keyword")).where(F.length(F.trim("keyword")) >= 3)
    change = (
        parts.select("keyword", F.lit(0.6).alias("w")).unionByName(node_words.select("keyword", (1.5 * F.col("weight")).alias("w")))
        .groupBy("keyword").agg(F.max("w").alias("w"))
    )
    path = F.replace(F.coalesce("source", F.lit("")), F.lit("\\"), F.lit("/"))
    d = docs.select("id", path.alias("source")).where("source != ''")
    d = d.join(files.select(F.lower(F.replace("file_path", F.lit("\\"), F.lit("/"))).alias("f")).distinct(), F.lower("source") == F.col("f"), "left_anti")
    low = F.lower("source")
    factor = F.when(low.contains(F.col("keyword")), 1.8).when(low.contains("docs/features/"), 1.25).when(low.endswith("readme.md") | low.endswith("todo.md"), 1.15).otherwise(1.0)
    s = doc_words.join(change, "keyword").join(d, "id").groupBy("id", "source").agg(F.round(F.sum(F.col("w") * F.col("weight") * factor), 3).alias("score")).where("score >= 4")
    best = s.groupBy(F.lower("source").alias("k")).agg(F.min_by(F.struct("source", "id", "score"), F.struct(-F.col("score"), F.col("source"), F.col("id"))).alias("b")).select("b.*")
    return best.orderBy(F.desc("score"), F.lower("source"), "id").limit(limit).select("source", "id", "score", F.when(F.col("score") >= 8, "High").otherwise("Medium").alias("confidence"))


#: Types one can edit, roles that tools write, endings and folders of documentation.
EDITABLE = ["Method", "Class", "Struct", "ApiEndpoint", "ConfigurationKey"]
WRITTEN_ROLES = ["Generated", "BuildArtifact", "Snapshot", "Migration"]
DOC_PATH = r"(?i)\.(md|markdown|txt)$|/docs/|^docs/"


def prune_surface(nodes: DataFrame, surface: DataFrame, terms: list[str], primary: int = 5, context: int = 12) -> DataFrame:
    """``file_path, score, part, reason`` of an implementation surface (``file_path, score``): files to edit and context.

    A file is context for the first reason that holds: ``stale`` (its first matching node has low freshness),
    ``documentation`` path, ``test`` role, ``generated`` roles, ``configuration`` unless a node has a term for its name,
    ``contract`` (all its matching nodes are contracts), ``file-only`` (none of them can be edited). The others are
    primary; if there is none, the best file is. The first ``primary`` and ``context`` by score and path are given.
    """
    from ..functions.columns import effective_role

    name = F.lower(F.coalesce("name", F.lit("")))
    match = F.lit(False)
    exact = F.lit(False)
    for t in terms:
        match = match | name.contains(t.lower()) | _low("summary").contains(t.lower())
        exact = exact | (name == t.lower())
    m = nodes.where(match).join(surface.select("file_path"), "file_path", "left_semi")
    per = m.groupBy("file_path").agg(
        F.min_by(freshness(), F.struct(F.coalesce("line_number", F.lit(2**31 - 1)), "id")).alias("fresh"), F.min_by(effective_role(F.col("file_path"), F.col("file_role")), "id").alias("role"),
        F.max(exact.cast("int")).alias("exact"), F.min(_contract().cast("int")).alias("contract"), F.max(F.col("type").isin(EDITABLE).cast("int")).alias("editable"),
    )
    why = (
        F.when(F.col("fresh") == "Low", "stale").when(F.regexp_replace("file_path", r"\\", "/").rlike(DOC_PATH), "documentation").when(F.col("role") == "Test", "test")
        .when(F.col("role").isin(WRITTEN_ROLES), "generated").when((F.col("role") == "Configuration") & (F.col("exact") == 0), "configuration")
        .when(F.col("contract") == 1, "contract").when(F.col("editable") == 0, "file-only")
    )
    ws = Workspace(nodes.sparkSession, "surface")
    all_ = ws.cut(surface.select("file_path", "score").join(per, "file_path").select("file_path", "score", why.alias("reason")))
    none = all_.agg(F.count_if(F.col("reason").isNull()).alias("free"))
    best = Window.orderBy(F.desc("score"), "file_path")  # a surface has at most a few dozen files
    j = all_.withColumn("n", F.row_number().over(best)).crossJoin(F.broadcast(none))  # one row
    j = j.withColumn("part", F.when(F.col("reason").isNull() | (F.col("free") == 0) & (F.col("n") == 1), "primary").otherwise("context"))
    first = Window.partitionBy("part").orderBy(F.desc("score"), "file_path")
    j = j.withColumn("k", F.row_number().over(first)).where(F.when(F.col("part") == "primary", F.col("k") <= primary).otherwise(F.col("k") <= context))
    return j.select("file_path", "score", "part", F.when(F.col("part") == "context", F.col("reason")).alias("reason"))


def replace_risk(nodes: DataFrame, edges: DataFrame, concept: str) -> DataFrame:
    """``module, nodes, risk, safe, level`` of what depends on a concept, by the first two parts of the namespace.

    Points of a node: 3 for a contract or a node with an interface; 2 each for an endpoint or a caller that is one, for
    infrastructure or a callee that is some, diagnostics in its file, no test that calls it, low freshness, and callers
    of other projects. Up to 2 points are safe. A module's risk is the sum; its level is High from 8, Medium from 4,
    and Low if all its nodes are safe.
    """
    low = concept.lower()
    ws = Workspace(nodes.sparkSession, "replace")
    e = edges.where(F.col("type").isin(TRAVERSAL)).select("src", "dst", "type").distinct()
    what = nodes.where(_low("name").contains(low) | F.lower("id").contains(low)).select(F.col("id").alias("dst"))
    mine = ws.cut(e.join(what, "dst", "left_semi").select(F.col("src").alias("id")).distinct().join(nodes, "id"))
    ids = mine.select("id")
    about = nodes.select(F.col("id").alias("other"), _api().alias("api"), _infrastructure().alias("infra"), test_role().alias("is_test"), F.lower("project_context").alias("project"))
    out = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("other"), "type", F.lit(True).alias("out"))
    into = e.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("other"), "type", F.lit(False).alias("out"))
    near = out.unionByName(into).join(about, "other").join(mine.select("id", F.lower("project_context").alias("own")), "id")
    yes = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int"))
    g = near.groupBy("id").agg(
        yes(F.col("out") & (F.col("type") == "Implements")).alias("bases"), yes(~F.col("out") & F.col("api")).alias("by_api"), yes(F.col("out") & F.col("infra")).alias("on_infra"),
        yes(~F.col("out") & F.col("is_test") & (F.col("type") == "Calls")).alias("tested"), yes(~F.col("out") & ~F.col("own").eqNullSafe(F.col("project"))).alias("abroad"),
    )
    faulty = nodes.where("type = 'Diagnostic' and file_path is not null").select("file_path").distinct().withColumn("faulty", F.lit(1))
    n = lambda c: F.coalesce(c, F.lit(0))
    j = mine.join(g, "id", "left").join(faulty, "file_path", "left")
    risk = (
        F.when(_contract() | (n("bases") == 1), 3).otherwise(0) + F.when(_api() | (n("by_api") == 1), 2).otherwise(0) + F.when(_infrastructure() | (n("on_infra") == 1), 2).otherwise(0)
        + 2 * n("faulty") + 2 * (1 - n("tested")) + F.when(freshness() == "Low", 2).otherwise(0) + 2 * n("abroad")
    )
    m = j.select(F.coalesce(F.substring_index("namespace", ".", 2), F.lit("(none)")).alias("module"), risk.alias("r"))
    s = m.groupBy("module").agg(F.count("*").alias("nodes"), F.sum("r").cast("long").alias("risk"), F.count_if(F.col("r") <= 2).alias("safe"))
    level = F.when(F.col("safe") == F.col("nodes"), "Low").when(F.col("risk") >= 8, "High").when(F.col("risk") >= 4, "Medium").otherwise("Low")
    return s.select("module", "nodes", "risk", "safe", level.alias("level"))
