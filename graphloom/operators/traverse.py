"""Bounded traversals as loops of joins, one per hop.

The frontier is deduplicated in every hop and written out, so the plan of a hop does not contain the earlier
ones and a lost executor costs one hop. Spark broadcasts a frontier or joins it by shuffle as its size asks.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import Workspace
from .model import COARSE, ENDPOINT, PRODUCTION_ROLES, TRAVERSAL, WORKFLOW
from .structural import broken_rule


def moves(edges: DataFrame, types: list[str] | None, direction: str = "out") -> DataFrame:
    """(a, b, rel, confidence): one step goes from a to b, along the edge, against it or either way."""
    e = edges if types is None else edges.where(F.col("type").isin(types))
    c = F.col("confidence") if "confidence" in edges.columns else F.lit(None).cast("double")
    out = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("type").alias("rel"), c.alias("confidence"))
    back = e.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("type").alias("rel"), c.alias("confidence"))
    return out if direction == "out" else back if direction == "in" else out.unionByName(back)


def reach(ws: Workspace, steps: DataFrame, start: DataFrame, depth: int | None) -> DataFrame:
    """Least number of steps from each root: (root, id, dist, first_rel), the start itself at 0.

    ``start``: (root, id). ``steps``: (a, b, rel). first_rel is the smallest relation of the first step among
    the shortest ways. Stops early when nothing new is found; without a depth only then.
    """
    seen = ws.cut(start.distinct().select("root", "id", F.lit(0).alias("dist"), F.lit(None).cast("string").alias("first_rel")))
    front = seen
    for hop in itertools.count(1) if depth is None else range(1, depth + 1):
        new = (
            front.join(steps, F.col("id") == F.col("a")).select("root", F.col("b").alias("id"), F.coalesce("first_rel", "rel").alias("first_rel"))
            .groupBy("root", "id").agg(F.min("first_rel").alias("first_rel")).join(seen, ["root", "id"], "left_anti")
            .select("root", "id", F.lit(hop).alias("dist"), "first_rel")
        )
        front = ws.cut(new)
        if front.isEmpty():
            break
        # A long walk is cut off now and then, so that plans stay short.
        seen = seen.unionByName(front) if hop % 16 else ws.cut(seen.unionByName(front))
    return seen


def inside(nodes: DataFrame, edges: DataFrame, owner: str, levels: int = 2) -> DataFrame:
    """Ids of a node and its members over up to ``levels`` Contains edges, with their level."""
    c = edges.where("type = 'Contains'").select(F.col("src").alias("id"), "dst").distinct()
    out = front = nodes.where(F.col("id") == owner).select("id", F.lit(0).alias("level"))
    for k in range(1, levels + 1):
        front = front.join(c, "id").select(F.col("dst").alias("id"), F.lit(k).alias("level"))
        out = out.unionByName(front)
    return out.groupBy("id").agg(F.min("level").alias("level"))


def downstream(nodes: DataFrame, edges: DataFrame, source: str, depth: int = 5, limit: int = 50) -> DataFrame:
    """What a node and its members depend on, with the least distance; the members themselves are left out."""
    ws = Workspace(nodes.sparkSession, "downstream")
    steps = ws.cut(moves(edges, TRAVERSAL))
    start = ws.cut(inside(nodes, edges, source).select(F.lit("").alias("root"), "id"))
    far = reach(ws, steps, start, max(1, min(depth, 8))).where("dist > 0").select("id", "dist")
    return far.orderBy("dist", "id").limit(limit)


def impact(nodes: DataFrame, edges: DataFrame, target: str, depth: int = 5, limit: int = 50) -> DataFrame:
    """Who is affected by a change of a node: ``id, dist, bucket``.

    Five ways lead to a caller: to the node or its members; for an interface to its implementers and their
    members; for a class to its abstractions and their members. A caller counts with its best bucket, then its
    least distance within it, which may exceed the shortest distance.
    """
    spark = nodes.sparkSession
    ws = Workspace(spark, "impact")
    depth = max(1, min(depth, 8))
    one = nodes.where(F.col("id") == target).select("id", "type").first()
    if one is None:
        return nodes.select("id", F.lit(0).alias("dist"), F.lit("").alias("bucket")).limit(0)
    back = ws.cut(moves(edges, TRAVERSAL, "in"))
    kinds = nodes.select("id", F.col("type").isin(WORKFLOW).alias("beside"))
    own = ws.cut(inside(nodes, edges, target))
    contains = edges.where("type = 'Contains'").select("src", "dst").distinct()
    bases = edges.where(F.col("type").isin("Implements", "Inherits"))

    roots = own.select(F.lit("own").alias("way"), F.col("id"), F.col("id").alias("top"))
    other = None
    if one["type"] in ("Interface", "Class"):
        other = (
            bases.where(F.col("dst") == target).select(F.col("src").alias("id")) if one["type"] == "Interface"
            else bases.where(F.col("src") == target).select(F.col("dst").alias("id"))
        ).distinct()
        inner = other.join(contains.select(F.col("src").alias("id"), "dst"), "id").select(F.col("id").alias("top"), F.col("dst").alias("id"))
        inner = inner.unionByName(inner.join(contains.select(F.col("src").alias("id"), "dst"), "id").select("top", F.col("dst").alias("id"))).distinct()
        roots = roots.unionByName(other.select(F.lit("other").alias("way"), "id", F.col("id").alias("top"))).unionByName(
            inner.select(F.lit("inner").alias("way"), "id", "top")
        )
    roots = ws.cut(roots)
    far = reach(ws, back, roots.select(F.col("id").alias("root"), "id").distinct(), depth).where("dist > 0")
    found = roots.select("way", F.col("id").alias("root"), "top").join(far, "root").join(kinds, "id")
    found = found.join(own.select("id", F.lit(True).alias("mine")), "id", "left")
    # The best way per root (or per implementer) and caller is the shortest, then the smallest last relation.
    mine = found.where("way = 'own' and mine is null").withColumn("at_target", F.col("root") == target)
    a = mine.select(
        "id", (F.col("dist") + F.when(F.col("at_target"), 0).otherwise(1)).alias("dist"),
        F.when(F.col("beside"), 4)
        .when(~F.col("at_target") & (F.col("first_rel") == "DependsOn"), 3).when(~F.col("at_target"), 2)
        .when(F.col("first_rel").isin("DependsOn", "Implements", "Inherits"), 3).otherwise(1).alias("rank"),
    )
    rest = found.where((F.col("way") != "own") & (F.col("id") != target) & (F.col("id") != F.col("top")) & (F.col("id") != F.col("root")))
    best = rest.groupBy("way", "top", "id").agg(F.min(F.struct("dist", "first_rel")).alias("m"), F.first("beside").alias("beside"))
    member_rank = F.when(F.col("m.first_rel") == "DependsOn", 3).otherwise(2) if one["type"] == "Interface" else F.lit(3)
    b = best.select(
        "id", (F.col("m.dist") + F.when(F.col("way") == "other", 1).otherwise(2)).alias("dist"),
        F.when(F.col("beside"), 4).when(F.col("way") == "other", 3).otherwise(member_rank).alias("rank"),
    )
    both = a.unionByName(b).where(F.col("dist") <= depth).groupBy("id").agg(F.min(F.struct("rank", "dist")).alias("m"))
    names = nodes.select("id", "name")
    bucket = F.element_at(F.array(*[F.lit(x) for x in ("direct-class", "member", "dependency", "workflow")]), F.col("m.rank"))
    return both.join(names, "id").orderBy("m.dist", "m.rank", "name", "id").select("id", F.col("m.dist").alias("dist"), bucket.alias("bucket")).limit(limit)


def connection(nodes: DataFrame, edges: DataFrame, a: str, b: str, most: int = 10) -> DataFrame:
    """The shortest undirected way between two nodes: ``step, id, via`` with the smallest ids among equals.

    Distances from b are found hop by hop until a is met; the way then follows falling distances from a.
    """
    spark = nodes.sparkSession
    ws = Workspace(spark, "connection")
    steps = ws.cut(moves(edges, TRAVERSAL, "both").groupBy("a", "b").agg(F.min("rel").alias("rel")))
    front = seen = ws.cut(nodes.where(F.col("id") == b).select("id", F.lit(0).alias("dist")))
    hop, met = 0, a == b and not seen.isEmpty()
    while not met and hop < most and not front.isEmpty():
        hop += 1
        front = ws.cut(front.join(steps, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("dist", F.lit(hop)))
        seen = seen.unionByName(front)
        met = not front.where(F.col("id") == a).isEmpty()
    way, here = [], a
    if met:
        for d in range(hop - 1, -1, -1):
            at = here
            nxt = steps.where(F.col("a") == at).join(seen.where(F.col("dist") == d), F.col("b") == F.col("id")).agg(F.min(F.struct("b", "rel")).alias("m")).first()["m"]
            way.append((len(way), at, nxt["rel"]))
            here = nxt["b"]
        way.append((len(way), here, None))
    return spark.createDataFrame(way, "step int, id string, via string")


def neighbours(edges: DataFrame, node: str, depth: int = 1, types: list[str] | None = None, direction: str = "both", limit: int = 100) -> DataFrame:
    """Distinct (neighbour, last edge, distance) over trails of up to three edges, none used twice."""
    spark = edges.sparkSession
    ws = Workspace(spark, "neighbours")
    e = edges.select("src", "dst", "type").distinct().withColumn("eid", F.concat_ws("|", "src", "type", "dst"))
    if types:
        e = e.where(F.col("type").isin(types))
    parts = [e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "src", "dst", "type", "eid")] if direction != "in" else []
    if direction != "out":
        parts.append(e.where("src != dst" if parts else "true").select(F.col("dst").alias("a"), F.col("src").alias("b"), "src", "dst", "type", "eid"))
    steps = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    steps = ws.cut(steps)
    front = spark.createDataFrame([(node, [])], "id string, used array<string>")
    out = None
    for hop in range(1, max(1, min(depth, 3)) + 1):
        front = ws.cut(
            front.join(steps, F.col("id") == F.col("a")).where(~F.array_contains("used", F.col("eid")))
            .select(F.col("b").alias("id"), F.concat("used", F.array("eid")).alias("used"), "src", "dst", "type")
        )
        here = front.where(F.col("id") != node).select("id", "src", "dst", "type", F.lit(hop).alias("dist")).distinct()
        out = here if out is None else out.unionByName(here)
        front = front.select("id", "used")
    return out.orderBy("dist", "id", "src", "type", "dst").limit(limit)


def ego_edges(edges: DataFrame, node: str, depth: int = 1, limit: int = 100) -> DataFrame:
    """Edges within so many undirected steps of a node, by application ids."""
    ws = Workspace(edges.sparkSession, "ego")
    steps = ws.cut(moves(edges, None, "both"))
    start = edges.sparkSession.createDataFrame([("", node)], "root string, id string")
    near = reach(ws, steps, start, max(0, depth - 1)).select("id")
    e = edges.select("src", "dst", "type").distinct()
    return (
        e.join(near.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(e.join(near.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "type"))
        .distinct().orderBy("src", "dst", "type").limit(limit)
    )


def neighbourhood(edges: DataFrame, node: str, hops: int = 2) -> DataFrame:
    """Distinct ids within so many undirected coarse dependencies of a node."""
    ws = Workspace(edges.sparkSession, "hybrid")
    steps = ws.cut(moves(edges, COARSE, "both"))
    start = edges.sparkSession.createDataFrame([("", node)], "root string, id string")
    return reach(ws, steps, start, max(1, min(hops, 8))).where("dist > 0").select("id")


def editing_context(nodes: DataFrame, edges: DataFrame, node: str, each: int = 10) -> DataFrame:
    """``role, id``: up to ten callers, callees and interfaces of a node and its members, by id."""
    own = inside(nodes, edges, node).select("id")
    e = edges.where(F.col("type").isin(TRAVERSAL))
    callers = e.join(own.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.lit("caller").alias("role"), F.col("src").alias("id"))
    callees = e.join(own.withColumnRenamed("id", "src"), "src", "left_semi").select(F.lit("callee").alias("role"), F.col("dst").alias("id"))
    bases = edges.where("type = 'Implements'").join(own.withColumnRenamed("id", "src"), "src", "left_semi").select(F.lit("interface").alias("role"), F.col("dst").alias("id"))
    rows = callers.unionByName(callees).unionByName(bases).distinct().join(nodes.select("id"), "id", "left_semi").join(own, "id", "left_anti")
    from pyspark.sql import Window

    w = Window.partitionBy("role").orderBy("id")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= each).select("role", "id")


def subgraph_summary(edges: DataFrame, node: str, first: int = 10) -> DataFrame:
    """One row: number of out-neighbours and the first of them."""
    out = edges.where(F.col("src") == node).select("dst").distinct()
    few = out.orderBy("dst").limit(first).agg(F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("first"))
    return out.agg(F.count("*").alias("neighbours")).crossJoin(few)  # one row each


def namespace_members(nodes: DataFrame, namespace: str) -> DataFrame:
    """Nodes in a namespace or below it, but no namespaces or files."""
    n, low = F.lower("namespace"), namespace.lower()
    return nodes.where(((n == low) | n.startswith(low + ".")) & ~F.col("type").isin("Namespace", "File")).select("id", "namespace", "type")


def resolve_id(nodes: DataFrame, wanted: str) -> DataFrame:
    """The one best node for a name or id: exact id, id ending, code before files, then path; none if not unique."""
    low = wanted.lower()
    hit = nodes.where((F.lower("id") == low) | F.lower("id").endswith(low) | (F.lower("name") == low))
    rank = F.when(F.lower("id") == low, 0).when(F.lower("id").endswith(low), 1).otherwise(2)
    best = hit.select("id", rank.alias("rank"), (F.col("type") == "File").cast("int").alias("is_file")).groupBy("rank", "is_file").agg(
        F.count("*").alias("n"), F.min("id").alias("id")
    )
    return best.orderBy("rank", "is_file").limit(1).where("n = 1").select("id", "rank")


def smell_paths(nodes: DataFrame, edges: DataFrame, depth: int = 4, limit: int = 50, layers=None, forbidden=None) -> DataFrame:
    """Shortest dependency ways between nodes of forbidden layers: ``violation, source, target, dist, path``.

    All ways of one length are looked at before the next; it ends once ``limit`` pairs are found, since longer
    ways sort behind. Among equal ways the smallest ids win.
    """
    ws = Workspace(nodes.sparkSession, "smell")
    steps = ws.cut(moves(edges, COARSE).select("a", "b").distinct())
    ok = nodes.where(F.col("namespace").isNotNull() & F.col("file_role").isin(PRODUCTION_ROLES)).select("id", "name", "namespace")
    # Only sources of some rule start a way.
    from .model import FORBIDDEN, LAYERS
    from .structural import _tokens_hit

    lay, rules = layers or LAYERS, forbidden or FORBIDDEN
    begins = F.lit(False)
    for a, _ in rules:
        begins = begins | _tokens_hit(F.col("namespace"), lay[a])
    front = ws.cut(ok.where(begins).select(F.col("id").alias("source"), "id", F.array("id").alias("path")))
    out, n = None, 0
    s = ok.select(F.col("id").alias("source"), F.col("name").alias("s_name"), F.col("namespace").alias("s_ns"))
    t = ok.select(F.col("id"), F.col("name").alias("t_name"), F.col("namespace").alias("t_ns"))
    seen = front.select("source", "id")
    for hop in range(1, max(1, min(depth, 6)) + 1):
        front = ws.cut(
            front.join(steps, F.col("id") == F.col("a")).select("source", F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"))
            .groupBy("source", "id").agg(F.min("path").alias("path")).join(seen, ["source", "id"], "left_anti")
        )
        seen = seen.unionByName(front.select("source", "id"))
        here = front.join(s, "source").join(t, "id").withColumn("violation", broken_rule(F.col("s_ns"), F.col("t_ns"), layers, forbidden)).where("violation is not null and source != id")
        here = ws.cut(here.select("violation", "source", F.col("id").alias("target"), F.lit(hop).alias("dist"), "path", "s_name", "t_name"))
        out = here if out is None else out.unionByName(here)
        n += here.count()
        if n >= limit:
            break
    return out.orderBy("dist", "violation", "s_name", "t_name", "source", "target").limit(limit).select(
        "violation", "source", "target", "dist", F.array_join("path", ">").alias("path")
    )


def trace_endpoint(nodes: DataFrame, edges: DataFrame, route: str, depth: int = 10, limit: int = 20, least: float = 0.8) -> DataFrame:
    """Ways from an endpoint's handlers to topics and tables: ``length, target, path``.

    Nodes need ``external_kind`` and ``recognition``. A topic ends a way; a table does if a recognised database
    operation lies on it and none of them is below ``least``. A way may pass once from a contract to an
    implementation. Ways of one length are complete before the next, which ends once ``limit`` are found.
    """
    ws = Workspace(nodes.sparkSession, "trace")
    low = route.lower()
    ends = nodes.where((F.col("type") == "ApiEndpoint") & ((F.lower("name") == low) | (F.col("id") == route) | F.col("id").endswith(f"::ApiEndpoint::{route}")))
    e = edges.select("src", "dst", "type").distinct()
    forward = e.where(F.col("type").isin(ENDPOINT)).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(False).alias("jump"), F.concat_ws("|", "src", "type", "dst").alias("eid"))
    jump = e.where("type = 'Implements'").select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(True).alias("jump"), F.concat_ws("|", "src", "type", "dst").alias("eid"))
    kinds = nodes.select(
        F.col("id").alias("b"), "type", F.col("name").alias("target_name"),
        F.when((F.col("type") == "ExternalConcept") & (F.col("external_kind") == "DatabaseOperation"), F.coalesce("recognition", F.lit(1.0))).alias("operation"),
    )
    steps = ws.cut(forward.unionByName(jump).join(kinds, "b"))
    front = ws.cut(
        e.where("type = 'Uses'").join(ends.select(F.col("id").alias("dst")), "dst", "left_semi")
        .join(kinds.select(F.col("b").alias("src"), "operation"), "src")
        .select(F.col("src").alias("id"), F.array("dst", "src").alias("path"), F.array().cast("array<string>").alias("used"), F.lit(False).alias("jumped"), F.col("operation").alias("worst"), F.lit(True).alias("open"))
    )
    out, n = None, 0
    for hop in range(1, max(1, min(depth, 12)) + 1):
        front = ws.cut(
            front.join(steps, F.col("id") == F.col("a")).where(~F.array_contains("used", F.col("eid")) & ~(F.col("jumped") & F.col("jump")))
            .select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"), F.concat("used", F.array("eid")).alias("used"), (F.col("jumped") | F.col("jump")).alias("jumped"),
                    F.least("worst", "operation").alias("worst"), (~F.col("jump")).alias("open"), "type", "target_name")
        )
        good = (F.col("type") == "MessageTopic") | ((F.col("type") == "DatabaseTable") & (F.col("worst") >= least))
        # An implementation reached by the jump itself has yet to take a step.
        here = ws.cut(front.where(good & F.col("open")).select(F.lit(hop + 2).alias("length"), F.col("id").alias("target"), "target_name", F.array_join("path", ">").alias("path")).distinct())
        out = here if out is None else out.unionByName(here)
        n += here.count()
        front = front.select("id", "path", "used", "jumped", "worst", "open")
        if n >= limit or front.isEmpty():
            break
    return out.orderBy("length", "target_name", "path").limit(limit).select("length", "target", "path")


def closure(ws: Workspace, steps: DataFrame, start: DataFrame) -> DataFrame:
    """All ids reachable from each root, to the fixpoint, however long the ways."""
    return reach(ws, steps, start, None).select("root", "id", "dist")


def type_hierarchy(edges: DataFrame) -> DataFrame:
    """(id, base) over any number of Inherits and Implements edges."""
    ws = Workspace(edges.sparkSession, "bases")
    up = ws.cut(moves(edges, ["Inherits", "Implements"]))
    start = up.select(F.col("a").alias("root"), F.col("a").alias("id")).distinct()
    return closure(ws, up, start).where("dist > 0").select(F.col("root").alias("id"), F.col("id").alias("base"), "dist")


def extraction_closure(nodes: DataFrame, edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen ids and all nodes without a file reached from them through such nodes."""
    ws = Workspace(nodes.sparkSession, "extraction")
    bare = nodes.where("file_path is null").select(F.col("id").alias("b"))
    steps = ws.cut(moves(edges, None).join(bare, "b", "left_semi").select("a", "b", "rel"))
    return closure(ws, steps, chosen.select(F.lit("").alias("root"), "id")).select("id", "dist")


#: Openings of structural questions and what they ask for.
INTENTS = {
    "who calls ": "callers", "callers of ": "callers", "callees of ": "callees", "dependencies of ": "callees", "implementations of ": "implementations",
    "classes implementing ": "implementations", "members in ": "members", "types in namespace ": "members", "types in module ": "members",
}


def structural_intent(question: str) -> tuple[str, str] | None:
    """(kind, subject) of a structural question, or None: callers, callees, implementations or members."""
    q = " ".join(question.strip().split()).rstrip("?").rstrip()
    for opening, kind in INTENTS.items():
        if q.lower().startswith(opening):
            return kind, q[len(opening) :].strip().strip("`\"'")
    return None


def answer_intent(nodes: DataFrame, edges: DataFrame, question: str) -> DataFrame:
    """Ids that answer a structural question; none if it is no such question or its subject is not one node.

    Members are the nodes of a namespace. The others come from the subject's editing context: its callers, its
    callees with its interfaces, or the classes, structs and methods among its callers.
    """
    got = structural_intent(question)
    none = nodes.select("id").limit(0)
    if not got:
        return none
    kind, subject = got
    if kind == "members":
        return namespace_members(nodes, subject).select("id")
    one = resolve_id(nodes.where(~F.col("type").isin("File", "Namespace")), subject).first()
    if one is None:
        return none
    context = editing_context(nodes, edges, one["id"])
    if kind == "callees":
        return context.where("role in ('callee', 'interface')").select("id").distinct()
    callers = context.where("role = 'caller'").select("id")
    if kind == "implementations":
        return callers.join(nodes.where(F.col("type").isin("Class", "Struct", "Method")).select("id"), "id", "left_semi")
    return callers
