"""Scores and reports put together from the structural operators and traversals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cosine, freshness, layer
from ..plans.session import Workspace
from .model import PRODUCTION_ROLES, STRUCTURAL, TRAVERSAL
from .structural import coverage_gaps, god_classes, hotspots, is_test, namespace_cycles, unreferenced, violations
from .traverse import impact, inside


def test_role(prefix: str = "") -> Column:
    """A test role, or an unknown role and test in namespace, path or name."""
    return F.coalesce(F.col(prefix + "file_role") == "Test", F.lit(False)) | (F.coalesce(F.col(prefix + "file_role"), F.lit("Unknown")) == "Unknown") & is_test(prefix)


def related_tests(nodes: DataFrame, edges: DataFrame, target: str, each: int = 25) -> DataFrame:
    """``id, match``: tests that call the target, and tests related to it by file, namespace or name.

    The target is one row, so the comparison of names is a filter over the tests.
    """
    t = nodes.where(F.col("id") == target).first()
    tests = nodes.where(test_role())
    direct = edges.where((F.col("type") == "Calls") & (F.col("dst") == target)).select(F.col("src").alias("id")).distinct()
    d = tests.join(direct, "id", "left_semi").orderBy("name", "id").limit(each).select("id", F.lit("direct").alias("match"))
    if t is None:
        return d
    low, bare = (t["name"] or "").lower(), (t["name"] or "").lower().split("(")[0]
    p, n = F.lower(F.coalesce("file_path", F.lit(""))), F.lower("name")
    near = (
        F.coalesce(F.col("file_path") == F.lit(t["file_path"]), F.lit(False)) | F.coalesce(F.col("namespace") == F.lit(t["namespace"]), F.lit(False))
        | p.contains(low) | n.contains(low) | F.contains(F.lit(low), n)
    )
    if len(bare) >= 4:
        near = near | p.contains(bare) | n.contains(bare)
    h = tests.where(near).join(direct, "id", "left_anti").orderBy("name", "id").limit(each).select("id", F.lit("heuristic").alias("match"))
    return d.unionByName(h)


def recommended_tests(found: DataFrame) -> DataFrame:
    """Tests by score and category; a test counts once with its best score."""
    s = found.groupBy("id").agg(F.max(F.when(F.col("match") == "direct", 300).otherwise(40)).alias("score"))
    low = F.lower("id")
    rank = F.when(F.col("score") >= 250, 0).when(low.contains("contract") | low.contains("api"), 1).when(low.contains("integration"), 2).otherwise(3)
    return s.select("id", "score", rank.alias("category")).orderBy("category", F.desc("score"), "id")


def impact_confidence(hit: DataFrame, nodes: DataFrame, edges: DataFrame, target: str) -> DataFrame:
    """Affected callers as proven, heuristic or unknown by freshness and the certainty of their edges."""
    least = edges.where(F.col("type").isin(TRAVERSAL)).groupBy(F.col("src").alias("id")).agg(
        F.min(F.coalesce("confidence", F.lit(1.0))).alias("least"), F.max(F.col("type").isin("Implements", "Inherits")).alias("abstract")
    )
    j = hit.join(nodes.select("id", freshness().alias("fresh")), "id").join(least, "id", "left")
    return j.select(
        "id", "dist",
        F.when(F.col("fresh") == "Low", "unknown").when(F.coalesce("abstract", F.lit(False)) | (F.coalesce("least", F.lit(1.0)) < 0.95) | (F.col("bucket") == "workflow"), "heuristic")
        .otherwise("proven").alias("confidence"),
    )


def duplicate_candidates(vectors: DataFrame, fan: DataFrame, least: float = 0.88, limit: int = 20) -> DataFrame:
    """Pairs of items of one kind with similar vectors: ``a, b, score, fan_in``, a < b.

    ``vectors``: id, label, lines, embedding. The max(10 * limit, 100) largest items are the sources, as the
    report has it; they are a bounded set compared with all items of their kind.
    """
    pool = vectors.orderBy(F.desc("lines"), "id").limit(max(10 * limit, 100)).select(F.col("id").alias("a"), "label", F.col("embedding").alias("ea"))
    j = F.broadcast(pool).join(vectors.select(F.col("id").alias("b"), "label", F.col("embedding").alias("eb")), "label").where("a < b")
    j = j.select("a", "b", F.round((1 + cosine(F.col("ea"), F.col("eb"))) / 2, 6).alias("score")).where(F.col("score") >= least)
    fa, fb = fan.select(F.col("id").alias("a"), F.col("fan_in").alias("fa")), fan.select(F.col("id").alias("b"), F.col("fan_in").alias("fb"))
    j = j.join(fa, "a", "left").join(fb, "b", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return j.select("a", "b", "score", n("fa").alias("fan_a"), n("fb").alias("fan_b")).orderBy(F.desc("score"), F.desc(F.col("fan_a") + F.col("fan_b")), "a", "b").limit(limit)


def partition_duplicates(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Whether a candidate pair is primary: score, fan-in and size ratio within bounds."""
    la, lb = vectors.select(F.col("id").alias("a"), F.col("lines").alias("la")), vectors.select(F.col("id").alias("b"), F.col("lines").alias("lb"))
    j = pairs.join(la, "a").join(lb, "b")
    ratio = F.least("la", "lb") / F.nullif(F.greatest("la", "lb"), F.lit(0))
    return j.select("a", "b", "score", ((F.col("score") >= 0.92) & (F.greatest("fan_a", "fan_b") <= 4) & (F.coalesce(ratio, F.lit(0.0)) >= 0.5)).alias("is_primary"))


def erosion_timeline(nodes: DataFrame, edges: DataFrame, last_day: str, days: int = 30) -> DataFrame:
    """Per day of the window: violations and god classes known by then, lines of the latter.

    Signals are counted per day first; the running sum goes over at most 90 days.
    """
    days = max(1, min(days, 90))
    day = lambda c: F.coalesce(F.to_date(c), F.lit(last_day).cast("date"))
    at = nodes.select(F.col("id"), F.coalesce("updated_at", "created_at").alias("t"))
    v = violations(nodes, edges).join(at.select(F.col("id").alias("src"), F.col("t").alias("ts")), "src").join(at.select(F.col("id").alias("dst"), F.col("t").alias("td")), "dst")
    v = v.select(day(F.greatest("ts", "td")).alias("day"), F.lit(1).alias("v"), F.lit(0).alias("g"), F.lit(0).cast("long").alias("lines"))
    g = god_classes(nodes, edges).join(at, "id").select(day("t").alias("day"), F.lit(0).alias("v"), F.lit(1).alias("g"), F.col("line_count").cast("long").alias("lines"))
    first = F.date_sub(F.lit(last_day).cast("date"), days - 1)
    spark = nodes.sparkSession
    window = spark.range(1).select(F.explode(F.sequence(first, F.lit(last_day).cast("date"))).alias("day"))
    sums = v.unionByName(g).where(F.col("day") <= F.lit(last_day).cast("date")).withColumn("day", F.greatest("day", first)).groupBy("day").agg(F.sum("v").alias("v"), F.sum("g").alias("g"), F.sum("lines").alias("lines"))
    run = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # at most 90 rows
    z = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(run).cast("long")
    return window.join(sums, "day", "left").select("day", z("v").alias("violations"), z("g").alias("god_classes"), z("lines").alias("god_lines"))


def context_cost(rows: DataFrame, summaries: int = 150, snippets: bool = True) -> DataFrame:
    """Estimated tokens of a context pack per ``pack``: rows, relations, files and snippets each have a price."""
    snippet = F.sum(12 * F.least(F.coalesce("line_count", F.lit(20)), F.lit(80))) if snippets else F.lit(0)
    cost = 120 + 20 * F.count("*") + 15 * F.count_if(F.col("relation")) + 16 * F.count_distinct("file_path") + summaries + snippet
    return rows.groupBy("pack").agg(cost.cast("long").alias("tokens"))


def snippets_in_budget(rows: DataFrame, budget: int = 2000) -> DataFrame:
    """``pack, id, tokens``: snippets taken in order while at least 80 tokens are left, each shrunk to what is left.

    ``rows``: pack, rank, id, lines, chars, at most a few dozen per pack. A snippet costs a quarter of its
    characters; one that is too long keeps left / 18 lines. The budget left depends on how each was shrunk, so
    it is a fold, not a running sum.
    """
    items = rows.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "lines", "chars"))).alias("items"))
    zero = F.struct(F.lit(budget).cast("int").alias("left"), F.array().cast("array<struct<id:string,tokens:int>>").alias("out"))

    def take(acc, x):
        left = acc["left"]
        full = F.ceil(x["chars"] / 4).cast("int")
        room = F.least(x["lines"], F.floor(left / 18).cast("int"))
        cost = F.when(full <= left, full).otherwise(F.least(left, F.ceil(x["chars"] * room / F.greatest(x["lines"], F.lit(1)) / 4).cast("int"))).cast("int")
        return F.when((left >= 80), F.struct((left - cost).cast("int").alias("left"), F.concat(acc["out"], F.array(F.struct(x["id"].alias("id"), cost.alias("tokens")))).alias("out"))).otherwise(acc)

    return items.select("pack", F.explode(F.aggregate("items", zero, take)["out"]).alias("o")).select("pack", "o.id", "o.tokens")


def caller_groups(nodes: DataFrame, edges: DataFrame, target: str) -> DataFrame:
    """Callers of a node and its members by group; a file is left out if an exact caller of it is known."""
    own = inside(nodes, edges, target).select(F.col("id").alias("dst"))
    c = edges.where(F.col("type").isin(TRAVERSAL)).join(own, "dst", "left_semi").select(F.col("src").alias("id")).distinct().join(own.withColumnRenamed("dst", "id"), "id", "left_anti")
    c = c.join(nodes, "id")
    g = F.when(test_role(), "test").when(F.col("type") == "Method", "method").when(F.col("type").isin("Class", "Struct", "Interface"), "class").otherwise("context")
    c = c.select("id", "type", "file_path", g.alias("group"))
    exact = c.where(F.col("group").isin("method", "class")).select("file_path").where("file_path is not null").distinct()
    return c.where("type != 'File'").select("id", "group").unionByName(c.where("type = 'File'").join(exact, "file_path", "left_anti").select("id", "group"))


def stale_knowledge(docs: DataFrame, nodes: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """``signal, id``: documents that name unknown symbols or are older than the code, concepts nothing uses, and, from
    ten of them on or beside any other signal, the first 25 classes and methods that nothing refers to."""
    newest = nodes.agg(F.max("updated_at").alias("newest"))
    old = docs.crossJoin(F.broadcast(newest)).where(F.col("updated_at") < F.date_sub("newest", 180)).select(F.lit("older-than-code").alias("signal"), "id")  # one row
    lost = symbols.where("not known").select(F.lit("unresolved-mention").alias("signal"), "id").distinct()
    used = edges.select(F.col("dst").alias("id")).distinct()
    orphan = nodes.where("type = 'ExternalConcept'").join(used, "id", "left_anti").select(F.lit("orphan-concept").alias("signal"), "id")
    some = old.unionByName(lost).unionByName(orphan)
    bare = unreferenced(nodes, edges).select(F.lit("unreferenced-code").alias("signal"), "id").limit(25)
    told = some.limit(1).agg(F.count("*").alias("told")).crossJoin(bare.agg(F.count("*").alias("bare")))  # one row each
    return some.unionByName(bare.join(F.broadcast(told), (F.col("told") > 0) | (F.col("bare") >= 10)).select("signal", "id"))


def exact_symbol(nodes: DataFrame, wanted: str, kind: str | None = None, path: str | None = None, line: int | None = None, limit: int = 5) -> DataFrame:
    """Candidates for a symbol with a score: name, id, type, file, nearness of the line and freshness."""
    low = wanted.lower()
    n = F.lower("name")
    s = F.when(n == low, 10).when(F.lower("id").endswith(low), 8).when(n.contains(low), 4).otherwise(0)
    hit = nodes.where(n.contains(low) | F.lower("id").contains(low))
    if kind:
        s = s + F.when(F.col("type") == kind, 5).otherwise(0)
    if path:
        s = s + F.when(F.lower("file_path").endswith(path.lower()), 6).otherwise(0)
    if line is not None:
        s = s + F.when(F.abs(F.col("line_number") - line) <= 5, 3).otherwise(0)
    s = s + F.when(freshness() == "High", 1).otherwise(0)
    return hit.select("id", s.cast("int").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def implementation_surface(nodes: DataFrame, terms: list[str], accepted: DataFrame | None = None, primary: int = 5) -> DataFrame:
    """Files by the summed score of their nodes that match the terms, plus feedback; the best are primary.

    ``accepted``: path, accepted, ignored; feedback adds 4 per accepted and takes 3 per ignored suggestion.
    """
    name, summary = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("summary", F.lit("")))
    s = F.lit(0)
    for t in terms:
        s = s + F.when(name.contains(t.lower()), 4).otherwise(0) + F.when(summary.contains(t.lower()), 2).otherwise(0)
    s = s + F.when((s > 0) & F.col("file_role").isin(PRODUCTION_ROLES), 1).otherwise(0)
    f = nodes.where("file_path is not null").withColumn("s", s).where("s > 0").groupBy("file_path").agg(F.sum("s").alias("score"), F.count("*").alias("nodes"))
    if accepted is not None:
        f = f.join(accepted.select(F.col("path").alias("file_path"), (4 * F.col("accepted") - 3 * F.col("ignored")).alias("plus")), "file_path", "left").withColumn("score", F.col("score") + F.coalesce("plus", F.lit(0)))
    conf = F.when(F.col("score") >= 12, "High").when(F.col("score") >= 6, "Medium").otherwise("Low")
    top = f.orderBy(F.desc("score"), "file_path").limit(primary + 12)
    rank = Window.orderBy(F.desc("score"), "file_path")  # over at most primary + 12 rows
    return top.withColumn("n", F.row_number().over(rank)).select("file_path", F.col("score").cast("long").alias("score"), "nodes", conf.alias("confidence"), (F.col("n") <= primary).alias("is_primary"))


def changed_subgraph(nodes: DataFrame, edges: DataFrame, changed: DataFrame, depth: int = 2) -> DataFrame:
    """``id, dist, seeds``: what depends on changed nodes, least distance and how many of them reach it."""
    from .traverse import moves, reach

    ws = Workspace(nodes.sparkSession, "changed")
    back = ws.cut(moves(edges, TRAVERSAL, "in"))
    seeds = changed.select("id").distinct()
    far = reach(ws, back, seeds.select(F.col("id").alias("root"), "id"), depth).where("dist > 0")
    return far.join(seeds, "id", "left_anti").groupBy("id").agg(F.min("dist").alias("dist"), F.count_distinct("root").alias("seeds"))


def node_risk(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Risk points of changed nodes: fan-in, missing tests, churn, violations, freshness; High from 8, Medium from 4."""
    seeds = changed.select("id").distinct()
    fan = edges.where(F.col("type").isin(STRUCTURAL)).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan"))
    tests = nodes.where(test_role()).select(F.col("id").alias("src"))
    covered = edges.where("type = 'Calls'").join(tests, "src", "left_semi").select(F.col("dst").alias("id")).distinct().withColumn("covered", F.lit(True))
    broken = violations(nodes, edges, limit=None).select(F.col("src").alias("id")).distinct().withColumn("broken", F.lit(True))
    j = nodes.join(seeds, "id", "left_semi").join(fan, "id", "left").join(covered, "id", "left").join(broken, "id", "left")
    f = F.coalesce("fan", F.lit(0))
    churn = F.coalesce("change_count", F.lit(0))
    pts = (
        F.when(f >= 8, 4).when(f >= 3, 2).when(f > 0, 1).otherwise(0) + F.when(F.coalesce("covered", F.lit(False)), 0).otherwise(2)
        + F.when(churn >= 5, 2).when(churn >= 3, 1).otherwise(0) + F.when(F.coalesce("broken", F.lit(False)), 3).otherwise(0) + F.when(freshness() == "Low", 1).otherwise(0)
    )
    return j.select("id", pts.cast("int").alias("points"), F.when(pts >= 8, "High").when(pts >= 4, "Medium").otherwise("Low").alias("risk"))


def replace_surface(nodes: DataFrame, edges: DataFrame, concept: str) -> DataFrame:
    """Per module: how many nodes and edges depend on a concept."""
    low = concept.lower()
    what = nodes.where(F.lower("name").contains(low) | F.lower("id").contains(low)).select(F.col("id").alias("dst"))
    e = edges.where(F.col("type").isin(STRUCTURAL)).join(what, "dst", "left_semi")
    m = nodes.select(F.col("id").alias("src"), F.coalesce(F.substring_index("namespace", ".", 2), F.lit("(none)")).alias("module"))
    return e.join(m, "src").groupBy("module").agg(F.count_distinct("src").alias("nodes"), F.count("*").alias("edges"))


def shared_evidence(items: DataFrame) -> DataFrame:
    """Per group, the share of pairs of methods with common evidence: ``group, pairs, share``.

    ``items``: group, id, evidence (distinct rows). Pairs with common evidence are counted from the number of ids
    of each evidence, so they are not formed, except those with two or more in common: a pair that shares k is
    counted k times over the evidence and in k (k - 1) / 2 pairs of evidence, which give k back.
    """
    d = items.distinct()
    n = d.groupBy("group").agg(F.count_distinct("id").alias("n"))
    e = d.where("group is not null and id is not null and evidence is not null")
    once = e.groupBy("group", "evidence").agg(F.count("*").alias("m")).groupBy("group").agg(F.sum(F.expr("m * (m - 1) div 2")).alias("shared"))
    two = e.alias("x").join(e.alias("y"), ["group", "id"]).where("x.evidence < y.evidence").select("group", "id", F.col("x.evidence").alias("e1"), F.col("y.evidence").alias("e2"))
    same = two.alias("x").join(two.alias("y"), ["group", "e1", "e2"]).where("x.id < y.id").groupBy("group", F.col("x.id").alias("p"), F.col("y.id").alias("q")).agg(F.count("*").alias("j"))
    again = same.groupBy("group").agg(F.sum(F.round((1 + F.sqrt(1 + 8 * F.col("j"))) / 2).cast("long") - 1).alias("again"))
    hit = once.join(again, "group", "left").select("group", (F.col("shared") - F.coalesce("again", F.lit(0))).alias("hit"))
    pairs = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    return n.join(hit, "group", "left").select("group", pairs.alias("pairs"), F.round(F.coalesce("hit", F.lit(0)) / F.nullif(pairs, F.lit(0)), 6).alias("share"))


def pull_request_report(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """``section, id`` of a change: changed nodes, affected ones, untested ones, hotspots among them."""
    seeds = changed.select("id").distinct()
    gaps = coverage_gaps(nodes, edges).select("id").join(seeds, "id", "left_semi")
    hot = hotspots(nodes, edges).select("id").join(seeds, "id", "left_semi")
    far = changed_subgraph(nodes, edges, seeds, 1).select("id")
    tag = lambda df, s: df.select(F.lit(s).alias("section"), "id")
    return tag(nodes.select("id").join(seeds, "id", "left_semi"), "changed").unionByName(tag(far, "affected")).unionByName(tag(gaps, "untested")).unionByName(tag(hot, "hotspot"))


def file_reasons(nodes: DataFrame, context: DataFrame) -> DataFrame:
    """Why each file is in a pack: the roles its nodes play."""
    j = context.join(nodes.where("file_path is not null").select("id", "file_path"), "id")
    return j.groupBy("file_path").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.count_distinct("id").alias("nodes"))


def doctor_status(nodes: DataFrame, edges: DataFrame, docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: nodes, nodes with a vector, call edges, diagnostics and documents."""
    a = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("type") == "Diagnostic").alias("diagnostics"))
    b = edges.agg(F.count_if(F.col("type") == "Calls").alias("call_edges"))
    c, d = docs.agg(F.count("*").alias("documents")), nodes.select("id").join(vectors.select("id"), "id", "left_semi").agg(F.count("*").alias("embedded"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d)  # one row each


def with_trust(report: DataFrame, trust: DataFrame) -> DataFrame:
    """A report with a warning column if the relationships behind it may be incomplete."""
    note = F.when(F.col("confidence") != "High", F.concat(F.lit("relationship evidence is "), F.lower("confidence")))
    return report.crossJoin(F.broadcast(trust.select(note.alias("warning"))))  # one row


def context_pack(nodes: DataFrame, edges: DataFrame, target: str, depth: int = 2) -> DataFrame:
    """``part, id`` of a minimal context: the target, its callers, callees and interfaces, what it affects and needs, its tests."""
    from .traverse import downstream, editing_context

    tag = lambda df, p: df.select(F.lit(p).alias("part"), "id")
    own = tag(nodes.where(F.col("id") == target), "target")
    around = editing_context(nodes, edges, target).select(F.col("role").alias("part"), "id")
    return (
        own.unionByName(around).unionByName(tag(impact(nodes, edges, target, depth), "affected"))
        .unionByName(tag(downstream(nodes, edges, target, depth), "needed")).unionByName(tag(related_tests(nodes, edges, target), "test"))
    )


def edit_route(nodes: DataFrame, edges: DataFrame, terms: list[str]) -> DataFrame:
    """Files to edit: the best match is the anchor, files linked with it by dependencies are companions, the rest context."""
    surface = implementation_surface(nodes, terms)
    ws = Workspace(nodes.sparkSession, "route")
    surface = ws.cut(surface)
    best = surface.orderBy(F.desc("score"), "file_path").limit(1).select("file_path")  # one row
    file = nodes.where("file_path is not null").select("id", "file_path")
    mine = file.join(F.broadcast(best), "file_path", "left_semi").select("id")
    e = edges.where(F.col("type").isin(TRAVERSAL))
    linked = (
        e.join(mine.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
        .unionByName(e.join(mine.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))).distinct().join(file, "id").select("file_path").distinct()
    )
    j = surface.join(linked.withColumn("linked", F.lit(True)), "file_path", "left").join(best.withColumn("first", F.lit(True)), "file_path", "left")
    return j.select("file_path", "score", F.when(F.coalesce("first", F.lit(False)), "anchor").when(F.coalesce("linked", F.lit(False)), "companion").otherwise("context").alias("role"))


#: Which analyses read the output of which.
TOOL_LINKS = [
    ("upsert_nodes", "extract_keywords"), ("upsert_nodes", "hotspots"), ("upsert_edges", "hotspots"), ("upsert_edges", "impact"), ("extract_keywords", "keyword_statistics"),
    ("keyword_statistics", "classify_keywords"), ("classify_keywords", "related_by_keywords"), ("impact", "test_shield"), ("impact", "impact_confidence"), ("related_tests", "test_shield"),
    ("violations", "erosion_timeline"), ("god_classes", "erosion_timeline"), ("pagerank", "risky_core"), ("bridges", "risky_core"), ("hotspots", "pull_request_report"),
]


def tool_dependencies(spark, tool: str) -> DataFrame:
    """Analyses that read the output of one, a filter of a constant table."""
    return spark.createDataFrame(TOOL_LINKS, "producer string, consumer string").where(F.col("producer") == tool)
