"""Relational operators over the graph: filters, joins and aggregations without traversal.

All take DataFrames and return one. ``limit`` is part of each report; ties are broken by id so that results do
not depend on partitioning. Edges may repeat and may end outside the nodes; only edges between given nodes count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import effective_role, freshness, layer, path_role
from .model import COARSE, COVERING, FORBIDDEN, LAYERS, PRODUCTION_ROLES, STRUCTURAL, TRAVERSAL, WORKFLOW


def of_project(df: DataFrame, project: str | None, column: str = "project_context") -> DataFrame:
    """Rows of one project in any letter case; all rows if none is named."""
    return df if not (project or "").strip() else df.where(F.lower(F.trim(column)) == project.strip().lower())


def with_ends(edges: DataFrame, nodes: DataFrame, src: list[str], dst: list[str]) -> DataFrame:
    """Edges with columns of both ends, named s_ and t_."""
    s = nodes.select(F.col("id").alias("src"), *[F.col(c).alias(f"s_{c}") for c in src])
    t = nodes.select(F.col("id").alias("dst"), *[F.col(c).alias(f"t_{c}") for c in dst])
    return edges.join(s, "src").join(t, "dst")


def is_diagnostic(nodes: DataFrame) -> Column:
    """A diagnostic that is not the record of an index run, where nodes tell."""
    kind = F.col("type") == "Diagnostic"
    return kind & (F.coalesce("external_kind", F.lit("")) != "IndexRun") if "external_kind" in nodes.columns else kind


def graph_counts(nodes: DataFrame, edges: DataFrame, project: str | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """One row: nodes, call edges with an end in the project, diagnostics, and with ``vectors`` (id) nodes that have one."""
    mine = of_project(nodes, project)
    calls = with_ends(edges.where("type = 'Calls'"), nodes, ["project_context"], ["project_context"])
    if (project or "").strip():
        p = project.strip().lower()
        calls = calls.where((F.lower("s_project_context") == p) | (F.lower("t_project_context") == p))
    a = mine.agg(F.count("*").alias("nodes"), F.count_if(is_diagnostic(nodes)).alias("diagnostics"))
    a = a.crossJoin(F.broadcast(calls.agg(F.count("*").alias("call_edges"))))  # one row each
    if vectors is None:
        return a
    return a.crossJoin(F.broadcast(mine.join(vectors.select("id"), "id", "left_semi").agg(F.count("*").alias("embedded"))))  # one row


def project_contexts(nodes: DataFrame, first: str = "", last: str = "", limit: int = 100) -> DataFrame:
    """Distinct projects that begin and end with the given letters, sorted."""
    p = nodes.where("project_context is not null").select("project_context").distinct()
    low = F.lower("project_context")
    return p.where(low.startswith(first.lower()) & low.endswith(last.lower())).orderBy("project_context").limit(limit)


def suggest_project(nodes: DataFrame, wanted: str) -> DataFrame:
    """Projects near a misspelt name with their score: 0 equal, 1 contained, 2 plus a small edit distance."""
    bare = lambda c: F.lower(F.regexp_replace(c, "[^\\p{L}\\p{Nd}]", ""))
    w = bare(F.lit(wanted))
    p = nodes.where("project_context is not null").select("project_context").distinct().withColumn("bare", bare(F.col("project_context"))).where("bare != ''")
    d = F.levenshtein("bare", w)
    score = F.when(F.col("bare") == w, 0).when(F.contains("bare", w) | F.contains(w, F.col("bare")), 1).when(d <= F.when(F.length(w) <= 8, 1).otherwise(2), d + 2)
    return p.select("project_context", score.alias("score")).where("score is not null").orderBy("score", F.lower("project_context"))


def unreferenced(nodes: DataFrame, edges: DataFrame, limit: int = 100) -> DataFrame:
    """Methods and classes that nothing depends on or contains."""
    hit = edges.where(F.col("type").isin([*STRUCTURAL, "Contains"])).select(F.col("dst").alias("id"))
    return nodes.where("type in ('Method', 'Class')").join(hit, "id", "left_anti").orderBy("type", "name", "id").select("id", "name", "type").limit(limit)


def large_nodes(nodes: DataFrame, class_lines: int = 400, method_lines: int = 40, limit: int = 50) -> DataFrame:
    big = ((F.col("type") == "Class") & (F.col("line_count") > class_lines)) | ((F.col("type") == "Method") & (F.col("line_count") > method_lines))
    return nodes.where(big & F.col("file_role").isin(PRODUCTION_ROLES)).orderBy(F.desc("line_count"), "id").select("id", "type", "line_count").limit(limit)


CHANGE_TYPES = ["Namespace", "Class", "Struct", "Interface", "Method", "Delegate", "Property", "Field", "Event", "Indexer", "Operator", "Enum", "File", "Module"]


def recently_changed(nodes: DataFrame, cutoff: str, limit: int = 50) -> DataFrame:
    """Code created or updated since the cutoff, newest first."""
    at = F.lit(cutoff).cast("timestamp")
    c, u = F.col("created_at"), F.col("updated_at")
    return (
        nodes.where(F.col("type").isin(CHANGE_TYPES) & ((c >= at) | (u >= at)))
        .select("id", F.coalesce(u, c).alias("changed_at"), F.when((c >= at) & (u.isNull() | (c == u)), "created").otherwise("updated").alias("change_type"))
        .orderBy(F.desc("changed_at"), "id").limit(limit)
    )


def high_churn(nodes: DataFrame, least: int = 3, limit: int = 50) -> DataFrame:
    tested = F.lower(F.coalesce("namespace", F.lit(""))).contains("test") | F.lower(F.coalesce("file_path", F.lit(""))).contains("test")
    return (
        nodes.where(F.col("change_count") >= least)
        .orderBy(tested.cast("int"), (F.col("type") == "Namespace").cast("int"), F.desc("change_count"), F.desc(F.coalesce("line_count", F.lit(0))), "name", "id")
        .select("id", "change_count", "line_count").limit(limit)
    )


def diagnostics(nodes: DataFrame, prefix: str = "", limit: int = 200) -> DataFrame:
    """Diagnostics by place; the name starts with the severity asked for."""
    return (
        nodes.where(is_diagnostic(nodes) & F.lower("name").startswith(prefix.lower()))
        .orderBy(F.asc_nulls_last("file_path"), F.asc_nulls_last("line_number"), "name", "id").select("id", "name", "file_path", "line_number").limit(limit)
    )


def latest_update(nodes: DataFrame, project: str | None = None) -> DataFrame:
    return of_project(nodes, project).agg(F.max("updated_at").alias("updated_at"))


def roles_and_layers(nodes: DataFrame) -> DataFrame:
    """Role by path, effective role, layer and confidence of every node."""
    return nodes.select(
        "id", path_role(F.col("file_path")).alias("path_role"), effective_role(F.col("file_path"), F.col("file_role")).alias("role"),
        layer(F.col("namespace"), F.col("file_path")).alias("layer"),
    )


def allowed_by_profile(nodes: DataFrame, profile: str) -> DataFrame:
    """Nodes whose effective role the profile looks at; the matrix is a constant of eight rows."""
    from ..functions.columns import PROFILES

    return nodes.where(effective_role(F.col("file_path"), F.col("file_role")).isin(PROFILES[profile]))


#: Fixed values of the ranking.
SUPPRESSED_ROLES = ["Test", "Configuration", "Migration", "Snapshot", "Generated", "BuildArtifact"]
SUPPRESSED_TYPES = ["ConfigurationKey", "ConfigurationEntry", "Diagnostic", "Property", "Field", "Event", "Indexer", "Operator"]
PRODUCTION_TYPES = ["Class", "Struct", "Interface", "Method", "Delegate", "Enum", "Module"]
BROAD_TYPES = ["Namespace", "File", "ApiEndpoint", "ConfigurationFile", "DatabaseTable", "ExternalConcept", "MessageTopic", "ExternalService"]
PLUMBING = [
    "DependencyInjection", "Program", "Startup", "CompositionRoot", "ServiceCollectionExtensions", "StartupExtensions", "ConfigureServices", "Module",
    "AppModule", "ContainerModule",
]
PLUMBING_ENDS = ["Options", "Endpoints", "Tools"]


def actionability(nodes: DataFrame) -> DataFrame:
    """Bucket and rank penalty of every node: production, broader match or suppressed."""
    role = effective_role(F.col("file_path"), F.col("file_role"))
    hay = F.lower(F.concat_ws(" ", "file_path", "namespace", "name"))
    test = (role == "Test") | ((role == "Unknown") & hay.contains("test"))
    no_path, few = F.col("file_path").isNull(), F.coalesce(F.col("line_count") < 3, F.lit(False))
    low = F.lower("name")
    plumbing = low.isin([x.lower() for x in PLUMBING])
    for e in PLUMBING_ENDS:
        plumbing = plumbing | low.endswith(e.lower())
    suppressed = test | role.isin(SUPPRESSED_ROLES) | F.col("type").isin(SUPPRESSED_TYPES)
    production = role.isin(PRODUCTION_ROLES) & F.col("type").isin(PRODUCTION_TYPES)
    n = lambda c, v: F.when(c, v).otherwise(0)
    return nodes.select(
        "id",
        F.when(suppressed, "SuppressedNoise").when(production, "ProductionCandidate").otherwise("BroaderHeuristicMatch").alias("bucket"),
        F.when(suppressed, 200 + n(test, 10) + n(no_path, 5))
        .when(production, n(no_path, 10) + n(few, 10) + n(plumbing, 15))
        .otherwise(100 + n(F.col("type").isin(BROAD_TYPES), 5) + n(no_path, 5) + n(few, 5)).cast("int").alias("penalty"),
    )


def cross_project(nodes: DataFrame, edges: DataFrame, project: str | None = None, limit: int = 100) -> DataFrame:
    """Structural edges between nodes of different projects; a node without one is in none."""
    e = with_ends(edges.where(F.col("type").isin(STRUCTURAL)), nodes, ["project_context"], ["project_context"])
    s, t = F.lower("s_project_context"), F.lower("t_project_context")
    e = e.where(s != t)
    if (project or "").strip():
        e = e.where((s == project.strip().lower()) | (t == project.strip().lower()))
    return e.select("src", "dst", "type", F.col("s_project_context").alias("source_project"), F.col("t_project_context").alias("target_project")).orderBy(
        "source_project", "target_project", "src", "dst", "type"
    ).limit(limit)


def is_test(prefix: str = "") -> Column:
    """A node in a test role, or with test in its namespace, path or name."""
    c = lambda n: F.lower(F.coalesce(F.col(prefix + n), F.lit("")))
    return (
        F.coalesce(F.col(prefix + "file_role") == "Test", F.lit(False)) | c("namespace").contains("test") | c("file_path").contains("test") | c("name").contains("test")
        | c("file_path").contains(".spec.")
    )


def members(nodes: DataFrame, edges: DataFrame, kind: str = "Class") -> DataFrame:
    """(owner, member) pairs over one or two Contains edges from nodes of a type."""
    inside = edges.where("type = 'Contains'").select("src", "dst").distinct()
    one = inside.join(nodes.where(F.col("type") == kind).select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("owner"), F.col("dst").alias("member"))
    two = one.join(inside.select(F.col("src").alias("member"), "dst"), "member").select("owner", F.col("dst").alias("member"))
    return one.unionByName(two).distinct()


#: Names and path of wiring, whose gaps come last.
GAP_LAST_NAMES, GAP_LAST_ENDS, GAP_LAST_PATH = ["dependencyinjection", "neo4joptions", "embeddingoptions"], ["options", "endpoints", "tools"], "/program.cs"


def coverage_gaps(nodes: DataFrame, edges: DataFrame, limit: int = 100) -> DataFrame:
    """Production classes and methods that no test calls or uses, nor, for classes, any of their members."""
    prod = nodes.where(F.col("type").isin("Class", "Method") & F.col("file_role").isin(PRODUCTION_ROLES))
    tests = nodes.where(is_test()).select(F.col("id").alias("src"))
    hit = edges.where(F.col("type").isin("Calls", "Uses")).join(tests, "src", "left_semi").select("dst").distinct()
    owners = members(nodes, edges).join(hit.withColumnRenamed("dst", "member"), "member", "left_semi").select(F.col("owner").alias("id"))
    open_ = prod.join(hit.withColumnRenamed("dst", "id"), "id", "left_anti").join(owners, "id", "left_anti")
    known = nodes.select(F.col("id").alias("src"))
    fan = edges.where(F.col("type").isin(COVERING)).join(known, "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("fan_in"))
    name, path = F.lower("name"), F.lower(F.coalesce("file_path", F.lit("")))
    plumbing = path.contains(GAP_LAST_PATH) | name.isin(GAP_LAST_NAMES)
    for end in GAP_LAST_ENDS:
        plumbing = plumbing | name.endswith(end)
    return (
        open_.join(fan, "id", "left").withColumn("fan_in", F.coalesce("fan_in", F.lit(0)).cast("long"))
        .orderBy(plumbing.cast("int"), F.desc("fan_in"), F.desc(F.coalesce("line_count", F.lit(0))), F.desc(F.coalesce("change_count", F.lit(0))), "type", "name", "id")
        .select("id", "type", "fan_in", "line_count").limit(limit)
    )


def hotspots(nodes: DataFrame, edges: DataFrame, project: str | None = None, limit: int = 15) -> DataFrame:
    """Methods, classes and interfaces with most structural edges into them."""
    known = nodes.select(F.col("id").alias("src"))
    fan = edges.where(F.col("type").isin(STRUCTURAL)).join(known, "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    mine = of_project(nodes.where("type in ('Method', 'Class', 'Interface')"), project).select("id", "name", "type")
    return fan.join(mine, "id").orderBy(F.desc("fan_in"), "id").select("id", "name", "type", "fan_in").limit(limit)


def _fan_bucket(rank: Column) -> Column:
    return F.element_at(F.array(F.lit("direct-class"), F.lit("member"), F.lit("dependency"), F.lit("workflow")), rank)


def god_classes(nodes: DataFrame, edges: DataFrame, lines: int = 300, fan_in: int = 3, limit: int = 20) -> DataFrame:
    """Large classes with many callers, each caller counted once in its best bucket."""
    big = nodes.where((F.col("type") == "Class") & (F.col("line_count") > lines) & F.col("file_role").isin(PRODUCTION_ROLES)).select("id", "name", "line_count")
    kinds = nodes.select(F.col("id").alias("caller"), F.col("type").isin(WORKFLOW).alias("beside"))
    e = edges.select(F.col("src").alias("caller"), F.col("dst"), "type")
    direct = (
        e.where(F.col("type").isin(TRAVERSAL)).join(big.select(F.col("id").alias("dst")), "dst", "left_semi").where("caller != dst")
        .select(F.col("dst").alias("id"), "caller", F.when(F.col("type").isin("DependsOn", "Implements", "Inherits"), 3).otherwise(1).alias("rank"))
    )
    own = members(nodes, edges).join(big.select(F.col("id").alias("owner")), "owner", "left_semi")
    via = (
        e.where(F.col("type").isin(STRUCTURAL)).join(own.select(F.col("member").alias("dst"), F.col("owner").alias("id")), "dst")
        .where("caller != id and caller != dst").select("id", "caller", F.when(F.col("type") == "DependsOn", 3).otherwise(2).alias("rank"))
    )
    best = (
        direct.unionByName(via).join(kinds, "caller").withColumn("rank", F.when(F.col("beside"), 4).otherwise(F.col("rank")))
        .groupBy("id", "caller").agg(F.min("rank").alias("rank"))
    )
    n = lambda r, a: F.count_if(F.col("rank") == r).alias(a)
    return (
        best.groupBy("id").agg(F.count("*").alias("fan_in"), n(1, "direct"), n(2, "via_members"), n(3, "dependency"), n(4, "heuristic")).where(F.col("fan_in") > fan_in)
        .withColumn("quality", 4 * F.col("direct") + 3 * F.col("via_members") + 2 * F.col("dependency") + F.col("heuristic"))
        .join(big, "id").orderBy(F.desc("quality"), F.desc("line_count"), F.desc("fan_in"), "name", "id")
        .select("id", "line_count", "fan_in", "direct", "via_members", "dependency", "heuristic", "quality").limit(limit)
    )


def diagnostics_near(nodes: DataFrame, node_id: str) -> DataFrame:
    """Diagnostics in the file of a node, nearest line first."""
    one = nodes.where(F.col("id") == node_id).select(F.col("file_path"), F.col("project_context"), F.col("line_number").alias("at"))
    return (
        nodes.where("type = 'Diagnostic'").join(one, ["file_path", "project_context"])
        .select("id", "file_path", F.abs(F.coalesce("line_number", F.lit(0)) - F.coalesce("at", F.lit(0))).alias("distance")).orderBy("distance", "id")
    )


def _tokens_hit(namespace: Column, parts: list[str]) -> Column:
    hit = F.lit(False)
    for p in parts:
        hit = hit | namespace.contains(p)
    return hit


def broken_rule(source: Column, target: Column, layers=None, forbidden=None) -> Column:
    """The first forbidden dependency between the layers of two namespaces, as text; null if none."""
    layers, forbidden = layers or LAYERS, forbidden or FORBIDDEN
    out = F.lit(None).cast("string")
    for a, b in reversed(forbidden):
        out = F.when(_tokens_hit(source, layers[a]) & _tokens_hit(target, layers[b]), f"{a} must not depend on {b}").otherwise(out)
    return out


def violations(nodes: DataFrame, edges: DataFrame, layers=None, forbidden=None, limit: int | None = 50) -> DataFrame:
    """Dependencies against the layer rules."""
    ns = nodes.where("namespace is not null")
    e = with_ends(edges.where(F.col("type").isin(COARSE)), ns, ["namespace", "name"], ["namespace", "name"])
    e = e.withColumn("violation", broken_rule(F.col("s_namespace"), F.col("t_namespace"), layers, forbidden)).where("violation is not null")
    e = e.select("violation", "src", "dst", "type", "s_name", "t_name")
    if limit is not None:
        e = e.orderBy("violation", "s_name", "t_name", "src", "dst", "type").limit(limit)
    return e.select("violation", "src", "dst", "type")


def namespace_cycles(nodes: DataFrame, edges: DataFrame, limit: int | None = 50) -> DataFrame:
    """Pairs of namespaces that depend on each other."""
    ns = nodes.where(F.col("namespace").isNotNull() & F.col("file_role").isin(PRODUCTION_ROLES))
    p = with_ends(edges.where(F.col("type").isin(COARSE)), ns, ["namespace"], ["namespace"]).where("s_namespace != t_namespace").select("s_namespace", "t_namespace").distinct()
    back = p.select(F.col("t_namespace").alias("s_namespace"), F.col("s_namespace").alias("t_namespace"))
    both = p.where("s_namespace < t_namespace").join(back, ["s_namespace", "t_namespace"], "left_semi").select(
        F.col("s_namespace").alias("from_namespace"), F.col("t_namespace").alias("to_namespace")
    )
    return both if limit is None else both.orderBy("from_namespace", "to_namespace").limit(limit)


def overview(nodes: DataFrame, names: int = 5) -> DataFrame:
    """Count and first names per type."""
    w = Window.partitionBy("type").orderBy("name", "id")
    first = nodes.where("type is not null").withColumn("n", F.row_number().over(w)).where(F.col("n") <= names).groupBy("type").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]), ", ").alias("first_names")
    )
    return nodes.where("type is not null").groupBy("type").agg(F.count("*").alias("nodes")).join(first, "type")


def freshness_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(freshness().alias("confidence")).agg(F.count("*").alias("nodes"))


def freshness_findings(nodes: DataFrame, project: str | None = None, limit: int = 200) -> DataFrame:
    """``id, confidence, missing`` of the first nodes by confidence (Low first) and id: which of path, line, hash and
    time a node should have and lacks."""
    from ..functions.columns import NEEDS_HASH, NEEDS_LINE, NEEDS_PATH

    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    line = F.coalesce(F.col("line_number") > 0, F.lit(False)) | F.coalesce(F.col("line_count") > 0, F.lit(False))
    need = lambda kinds: F.coalesce(F.col("type").isin(kinds), F.lit(False))
    lacks = [(F.col("updated_at").isNull(), "time"), (need(NEEDS_PATH) & blank("file_path"), "path"), (need(NEEDS_LINE) & ~line, "line"), (need(NEEDS_HASH) & blank("source_hash"), "hash")]
    rank = F.when(F.col("confidence") == "Low", 0).when(F.col("confidence") == "Medium", 1).otherwise(2)
    return (
        of_project(nodes, project).select("id", freshness().alias("confidence"), F.concat_ws(",", *[F.when(c, n) for c, n in lacks]).alias("missing"))
        .orderBy(rank, "id").limit(limit)
    )


def graph_drift(nodes: DataFrame) -> DataFrame:
    """One row: how many nodes lack path, line, hash or time, or are stored under a role their path denies."""
    from ..functions.columns import NEEDS_HASH, NEEDS_LINE, NEEDS_PATH

    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    line = F.coalesce(F.col("line_number") > 0, F.lit(False)) | F.coalesce(F.col("line_count") > 0, F.lit(False))
    need = lambda kinds: F.coalesce(F.col("type").isin(kinds), F.lit(False))
    n = nodes.agg(
        F.count_if(need(NEEDS_PATH) & ~has("file_path")).alias("no_path"), F.count_if(need(NEEDS_LINE) & ~line).alias("no_line"),
        F.count_if(F.col("updated_at").isNull()).alias("no_time"), F.count_if(need(NEEDS_HASH) & has("file_path") & ~has("source_hash")).alias("no_hash"),
        F.count_if(~F.col("file_role").isin("Unknown", "Test") & has("file_path") & (path_role(F.col("file_path")) == "Test")).alias("role_conflicts"),
        F.count_if(freshness() == "Low").alias("low"),
    )
    high = "low > 25 or no_path > 50 or no_line > 100 or role_conflicts > 50"
    some = "low > 5 or no_path > 10 or no_line > 25 or role_conflicts > 10"
    return n.withColumn("severity", F.expr(f"case when {high} then 'high' when {some} then 'moderate' else 'low' end"))


def unit_health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, the weather score: 100 less capped deductions for cycles, violations, gaps, low confidence, bridges.

    Bridges are the first ten nodes by betweenness, whatever their score, of a graph with any edge to walk: their
    number, all that is asked for, needs no scores.
    """
    cycles = namespace_cycles(nodes, edges).agg(F.count("*").alias("cycles"))
    broken = violations(nodes, edges).agg(F.count("*").alias("broken"))
    gaps = coverage_gaps(nodes, edges).agg(F.count("*").alias("gaps"))
    low = nodes.agg(F.count_if(freshness() == "Low").alias("low"))
    ids = nodes.select("id").distinct()
    walked = edges.where(F.col("type").isin(TRAVERSAL)).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").limit(1).agg(F.count("*").alias("walked"))
    bridges = ids.limit(10).agg(F.count("*").alias("bridges")).crossJoin(walked)
    one = cycles.crossJoin(broken).crossJoin(gaps).crossJoin(low).crossJoin(bridges)  # one row each
    less = "least(25, 5 * cycles) + least(25, 5 * broken) + least(20, gaps div 5) + least(20, low div 10) + if(walked > 0, least(10, bridges), 0)"
    return one.withColumn("score", F.expr(f"greatest(0, least(100, 100 - ({less})))").cast("int")).drop("bridges", "walked")
