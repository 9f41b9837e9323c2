"""Whole-graph algorithms as loops of joins and aggregations. Betweenness holds the graph in each task; bridges and
articulation points hold it in one task up to a size, and are loops of joins beyond."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import Workspace
from .blocks import gathered
from .model import TRAVERSAL
from .structural import freshness, layer
from .traverse import moves
from .ways import Ways


#: Vertices and undirected links of a graph that one task holds as numbers (about 80 and 8 bytes each).
HELD_VERTICES, HELD_LINKS = 13_000_000, 80_000_000


def projected(nodes: DataFrame, edges: DataFrame, types: list[str] = TRAVERSAL, undirected: bool = False) -> DataFrame:
    """Distinct (a, b) between given nodes over the wanted edge types; no row if none of them occurs."""
    ids = nodes.select("id").distinct()
    e = moves(edges, types, "both" if undirected else "out").select("a", "b").distinct()
    if undirected:
        e = e.where("a != b")
    return e.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")


def pagerank(nodes: DataFrame, edges: DataFrame, types: list[str] = TRAVERSAL, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """``id, score`` over the whole graph, not normalised: (1 - d) + d times what callers pass on.

    Parallel edges count each. Nodes without in-edges keep 1 - d. Links lie in buckets of their source and ranks in
    buckets of the node, so a round shuffles only what is passed on, summed up per target before it moves.
    """
    spark = nodes.sparkSession
    ws, n = Workspace(spark, "pagerank"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = nodes.select("id").distinct()
    e = moves(edges, types).select("a", "b").join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    e = e.groupBy("a", "b").agg(F.count("*").alias("n"))
    deg = e.groupBy("a").agg(F.sum("n").alias("deg"))
    links = ws.cut_by(e.join(deg, "a").select("a", "b", (F.col("n") / F.col("deg")).alias("w")), "a", n)
    rank = ws.cut_by(ids.withColumn("score", F.lit(1 - damping)), "id", n)
    for k in range(rounds):
        given = links.join(rank, F.col("a") == F.col("id")).groupBy("b").agg(F.sum(F.col("score") * F.col("w")).alias("got"))
        new = rank.select("id").join(given, F.col("id") == F.col("b"), "left").select("id", (F.lit(1 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("score"))
        # Two rounds per table: a plan of two joins is short enough.
        if k % 2 or k == rounds - 1:
            old, rank = rank, ws.cut_by(new, "id", n)
            ws.drop(old)
        else:
            rank = new
    return rank


def components(ws: Workspace, pairs: DataFrame) -> DataFrame:
    """``id, root`` of every id in undirected (a, b) pairs, given both ways; root is the component's smallest id.

    Labels fall to the least label around, then to their label's label, until none changes.
    """
    pairs = ws.cut(pairs)
    lab = ws.cut(pairs.select(F.col("a").alias("id")).distinct().withColumn("root", F.col("id")))
    while True:
        around = pairs.join(lab.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        low = ws.cut(lab.join(around, "id", "left").select("id", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root")))
        jump = low.join(low.select(F.col("id").alias("root"), F.col("root").alias("next")), "root", "left").select("id", "old", F.coalesce("next", "root").alias("root"))
        new = ws.cut(jump)
        done = new.where("old != root").isEmpty()
        ws.drop(low)
        ws.drop(lab)
        lab = new.select("id", "root")
        if done:
            return lab


def spanning_forest(ws: Workspace, pairs: DataFrame) -> DataFrame:
    """``id, parent, depth, root``: breadth-first trees from each component's smallest id."""
    roots = components(ws, pairs)
    tree = front = ws.cut(roots.where("id = root").select("id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), "root"))
    d = 0
    while not front.isEmpty():
        d += 1
        nxt = (
            front.select(F.col("id").alias("a"), "root").join(pairs, "a").groupBy(F.col("b").alias("id")).agg(F.min(F.struct("a", "root")).alias("m"))
            .join(tree.select("id"), "id", "left_anti").select("id", F.col("m.a").alias("parent"), F.lit(d).alias("depth"), F.col("m.root").alias("root"))
        )
        front = ws.cut(nxt)
        tree = tree.unionByName(front)
    return ws.cut(tree)


def _upward(ws: Workspace, tree: DataFrame, values: DataFrame, how, zero) -> DataFrame:
    """``id, value`` with the values of all descendants folded in, level by level from the leaves."""
    deepest = tree.agg(F.max("depth").alias("d")).first()["d"] or 0
    known = ws.cut(tree.join(values, "id", "left").select("id", "parent", "depth", F.coalesce("value", F.lit(zero)).alias("value")))
    done = below = known.where(F.col("depth") == deepest)
    for d in range(deepest - 1, -1, -1):
        up = below.groupBy(F.col("parent").alias("id")).agg(how(F.col("value")).alias("more"))
        here = known.where(F.col("depth") == d).join(up, "id", "left")
        pair = F.array("value", F.coalesce("more", F.lit(zero)))
        merged = F.col("value").bitwiseXOR(F.coalesce("more", F.lit(zero))) if how is F.bit_xor else pair[0] + pair[1]
        below = ws.cut(here.select("id", "parent", "depth", merged.alias("value")))
        done = done.unionByName(below)
    return done.select("id", "value")


def numbered(ws: Workspace, nodes: DataFrame, edges: DataFrame, types: list[str]) -> tuple[DataFrame, int, DataFrame]:
    """``id, k`` with the numbers from 0 of the nodes, how many they are, and the distinct undirected links (x, y) between
    them by number, x < y."""
    ids = ws.cut(nodes.select("id").distinct().withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    rows = {r["p"]: r["n"] for r in ids.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, n = [], 0
    for p in range(max(rows, default=0) + 1):
        before.append(n)
        n += rows.get(p, 0)
    ids = ids.select("id", (F.element_at(F.lit(before), (part + 1).cast("int")) + F.col("at").bitwiseAND((1 << 33) - 1)).cast("long").alias("k"))
    number = lambda c, k: ids.select(F.col("id").alias(c), F.col("k").alias(k))
    e = moves(edges, types).select("a", "b").where("a != b").join(number("a", "x"), "a").join(number("b", "y"), "b")
    return ids, n, ws.cut(e.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())


def _held(ws: Workspace, nodes: DataFrame, edges: DataFrame, types: list[str], solve, schema: str, graph: tuple | None = None) -> tuple[DataFrame, DataFrame] | None:
    """The numbered nodes, and what ``solve`` makes of the graph as number arrays in one task; None if it is too large for one."""
    ids, n, links = graph or numbered(ws, nodes, edges, types)
    m = links.count()
    if n > HELD_VERTICES or m > HELD_LINKS:
        if graph is None:
            ws.drop(links)
        return None

    def run(batches):
        import numpy as np
        import pyarrow as pa

        found = [np.asarray(c, np.int64) for c in solve(gathered(batches, n, m))]
        for at in range(0, len(found[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in found], names=[c.split()[0] for c in schema.split(", ")])

    return ids, ws.cut(links.coalesce(1).mapInArrow(run, schema))


def bridges(nodes: DataFrame, edges: DataFrame, types: list[str] = TRAVERSAL, graph: tuple | None = None) -> DataFrame:
    """Edges whose removal splits a component: ``a, b, sizes`` with a < b and the sizes of the two parts, falling."""
    ws = Workspace(nodes.sparkSession, "bridges")
    held = _held(ws, nodes, edges, types, lambda g: g.bridges(), "v long, w long, part long, rest long", graph)
    if held is None:
        return _bridges_by_joins(ws, nodes, edges, types)
    ids, found = held
    end = lambda c, name: ids.select(F.col("k").alias(c), F.col("id").alias(name))
    return found.join(end("v", "p"), "v").join(end("w", "q"), "w").select(
        F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.sort_array(F.array("part", "rest"), False).alias("sizes")
    )


def _bridges_by_joins(ws: Workspace, nodes: DataFrame, edges: DataFrame, types: list[str]) -> DataFrame:
    """:func:`bridges` of a graph of any size.

    Every edge outside the spanning forest gets a random-looking 64-bit number; a forest edge is a bridge if
    the numbers over its subtree cancel out, which happens by chance once in 2^64.
    """
    pairs = ws.cut(projected(nodes, edges, types, undirected=True))
    tree = spanning_forest(ws, pairs)
    in_tree = tree.where("parent is not null").select(F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b"))
    extra = pairs.where("a < b").join(in_tree, ["a", "b"], "left_anti").select("a", "b", F.xxhash64("a", "b").alias("h"))
    marks = extra.select(F.col("a").alias("id"), "h").unionByName(extra.select(F.col("b").alias("id"), "h")).groupBy("id").agg(F.bit_xor("h").alias("value"))
    xor = _upward(ws, tree, marks, F.bit_xor, 0)
    size = ws.cut(_upward(ws, tree, tree.select("id", F.lit(1).cast("long").alias("value")), F.sum, 0))
    whole = size.join(tree.where("parent is null").select("id"), "id", "left_semi").select(F.col("id").alias("root"), F.col("value").alias("whole"))
    return (
        tree.where("parent is not null").join(xor.where("value = 0").select("id"), "id", "left_semi").join(size, "id").join(whole, "root")
        .select(
            F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b"),
            F.sort_array(F.array(F.col("value"), F.col("whole") - F.col("value")), False).alias("sizes"),
        )
    )


def articulation_points(nodes: DataFrame, edges: DataFrame, types: list[str] = TRAVERSAL, graph: tuple | None = None) -> DataFrame:
    """Nodes whose removal splits their component: ``id, parts`` with the number of parts left."""
    ws = Workspace(nodes.sparkSession, "articulation")
    held = _held(ws, nodes, edges, types, lambda g: g.articulation_points(), "k long, parts long", graph)
    if held is None:
        return _articulation_by_joins(ws, nodes, edges, types)
    return held[1].join(held[0], "k").select("id", "parts")


def _articulation_by_joins(ws: Workspace, nodes: DataFrame, edges: DataFrame, types: list[str]) -> DataFrame:
    """:func:`articulation_points` of a graph of any size.

    Without a node v its subtrees and the rest of the component are held together by edges outside the
    spanning forest only. Each such edge is walked up to where its ends meet: below that point it ties a
    subtree to the rest, at that point two subtrees. The parts of v are the components of these ties, found
    for all nodes at once. Walks are as long as the forest is deep, which breadth-first trees keep short.
    """
    pairs = ws.cut(projected(nodes, edges, types, undirected=True))
    tree = spanning_forest(ws, pairs)
    up = tree.select("id", "parent", "depth")
    in_tree = tree.where("parent is not null").select(F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b"))
    extra = pairs.where("a < b").join(in_tree, ["a", "b"], "left_anti")
    pa = up.select(F.col("id").alias("a"), F.col("parent").alias("pa"), F.col("depth").alias("da"))
    pb = up.select(F.col("id").alias("b"), F.col("parent").alias("pb"), F.col("depth").alias("db"))
    walk = ws.cut(extra.distinct())
    ties = None
    out = F.lit("\0")
    while not walk.isEmpty():
        w = ws.cut(walk.join(pa, "a").join(pb, "b"))
        # The deeper end climbs; ends of one depth with unequal parents climb both.
        climb_a = F.col("da") >= F.col("db")
        climb_b = F.col("db") >= F.col("da")
        meet = F.col("pa").eqNullSafe(F.col("pb")) & climb_a & climb_b
        onto = (climb_a & ~climb_b & (F.col("pa") == F.col("b"))) | (climb_b & ~climb_a & (F.col("pb") == F.col("a")))
        # At the meeting point both subtrees are tied.
        here = w.where(meet).select(F.col("pa").alias("v"), F.col("a").alias("x"), F.col("b").alias("y"))
        going = w.where(~meet & ~onto)
        side = lambda p, c, cond: going.where(cond).select(F.col(p).alias("v"), F.col(c).alias("x"), out.alias("y"))
        here = here.unionByName(side("pa", "a", climb_a)).unionByName(side("pb", "b", climb_b)).distinct()
        here = ws.cut(here)
        ties = here if ties is None else ties.unionByName(here)
        walk = going.select(F.when(climb_a, F.col("pa")).otherwise(F.col("a")).alias("a"), F.when(climb_b, F.col("pb")).otherwise(F.col("b")).alias("b")).where("a != b").distinct()
        walk = ws.cut(walk)
    parts = tree.where("parent is not null").select(F.col("parent").alias("v"), F.col("id").alias("x")).unionByName(
        tree.where("parent is not null").select(F.col("id").alias("v"), out.alias("x"))
    )
    name = lambda c: F.concat(F.col("v"), F.lit("\1"), F.col(c))
    parts = parts.select("v", name("x").alias("id")).distinct()
    if ties is None:
        count = parts.groupBy("v").agg(F.count("*").alias("parts"))
    else:
        both = ties.select(name("x").alias("a"), name("y").alias("b")).distinct()
        joined = components(ws, both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        count = parts.join(joined, "id", "left").groupBy("v").agg(F.count_distinct(F.coalesce("root", "id")).alias("parts"))
    return count.where("parts > 1").select(F.col("v").alias("id"), "parts")


def betweenness(nodes: DataFrame, edges: DataFrame, types: list[str] = TRAVERSAL, sources: DataFrame | None = None, graph: tuple | None = None) -> DataFrame:
    """``id, score``: number of shortest ways through each node, undirected, each pair counted once.

    Exact if all nodes are sources (the default): every task walks from its share of the sources over the graph, which it
    holds as arrays of numbers, but only as far as :mod:`.ways` must. In the worst case that is time of nodes by edges;
    then give a bounded set of sources and read the score as their part. ``graph`` is what :func:`numbered` made of it, if it did.
    """
    import numpy as np
    import pyarrow as pa

    spark = nodes.sparkSession
    ws, sc = Workspace(spark, "betweenness"), spark.sparkContext
    ids, n, links = graph or numbered(ws, nodes, edges, types)
    starts = np.full(n, sources is None)
    if sources is not None:
        starts[ids.join(sources.select("id").distinct(), "id", "left_semi").select("k").toArrow()["k"].to_numpy()] = True
    xy = links.toArrow()
    held, tasks = sc.broadcast((n, *[xy[c].to_numpy().astype(np.int32) for c in ("x", "y")], starts)), 2 * sc.defaultParallelism

    def walk(batches):
        ways = Ways(*held.value)
        for batch in batches:
            for k in batch.column(0).to_numpy():
                sums = ways.walk(ways.sources[k::tasks])
                at = np.append(np.flatnonzero(sum(sums)), -1)  # there is a row even if nothing is walked
                yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(np.append(c, 0.0)[at]) for c in sums]], names=["k", "inner", "out", "into"])

    def finish(batches):
        ways = Ways(*held.value)
        sums = np.zeros((3, len(ways.at) + 1))
        for b in batches:
            sums[:, b.column(0).to_numpy()] = [b.column(c).to_numpy() for c in (1, 2, 3)]
        at, score = ways.scores(*sums[:, :-1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(score)], names=["k", "score"])

    found = spark.range(0, tasks, 1, tasks).mapInArrow(walk, "k long, inner double, out double, into double")
    found = ws.cut(found.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("inner", "out", "into")]))
    scores = ws.cut(found.coalesce(1).mapInArrow(finish, "k long, score double"))
    held.unpersist()
    return ids.join(scores, "k").select("id", "score")


def communities(nodes: DataFrame, edges: DataFrame, types: list[str], levels: int = 3, rounds: int = 8) -> DataFrame:
    """``id, community``: groups of high modularity by local moves, then by moves of whole groups.

    In a round, the half of the nodes that a hash picks move to the group around them with the greatest gain,
    ties to the smallest name; the other half moves next, so neighbours do not swap for ever. A group is named
    after its smallest member. Deterministic; not the order of moves of any other implementation.
    """
    ws = Workspace(nodes.sparkSession, "communities")
    links = ws.cut(moves(edges, types, "both").where("a != b").groupBy("a", "b").agg(F.count("*").cast("double").alias("w")).join(nodes.select(F.col("id").alias("a")), "a", "left_semi").join(nodes.select(F.col("id").alias("b")), "b", "left_semi"))
    total = links.agg(F.sum("w").alias("w")).first()["w"]
    if not total:
        return nodes.select("id", F.col("id").alias("community")).limit(0)
    place = ws.cut(links.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id")))
    cur = links
    for level in range(levels):
        deg = ws.cut(cur.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")))
        lab = ws.cut(deg.select("id", F.col("id").alias("c"), "k"))
        moved_any = False
        for r in range(rounds):
            sums = lab.groupBy("c").agg(F.sum("k").alias("tot"))
            turn = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(2)) == r % 2
            near = cur.where("a != b").join(lab.select(F.col("id").alias("b"), F.col("c")), "b").groupBy(F.col("a").alias("id"), "c").agg(F.sum("w").alias("win"))
            own = lab.select("id", F.col("c").alias("mine"), "k")
            # The own group is an option even if no link leads into it.
            options = near.unionByName(own.select("id", F.col("mine").alias("c"), F.lit(0.0).alias("win"))).groupBy("id", "c").agg(F.sum("win").alias("win"))
            gain = options.join(own, "id").join(sums, "c").withColumn(
                "gain", F.round(F.col("win") - F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("mine"), F.col("k")).otherwise(0.0)) / total, 9)
            )
            best = gain.groupBy("id").agg(
                F.max(F.struct(F.col("gain"), (F.col("c") == F.col("mine")).cast("int"))).alias("top"), F.max("k").alias("k"), F.first("mine").alias("mine"),
                F.min_by("c", F.struct(-F.col("gain"), -(F.col("c") == F.col("mine")).cast("int"), F.col("c"))).alias("c"),
            )
            new = ws.cut(best.select("id", F.when(turn, F.col("c")).otherwise(F.col("mine")).alias("c"), "k", (turn & (F.col("c") != F.col("mine"))).alias("moved")))
            moves_now = not new.where("moved").isEmpty()
            moved_any = moved_any or moves_now
            ws.drop(lab)
            lab = new.select("id", "c", "k")
            if r % 2 and not moves_now:
                break
        if not moved_any:
            break
        place = ws.cut(place.join(lab.select(F.col("id").alias("community"), F.col("c").alias("next")), "community").select("id", F.col("next").alias("community")))
        cur = ws.cut(
            cur.join(lab.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(lab.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
            .groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w"))
        )
    least = place.groupBy("community").agg(F.min("id").alias("name"))
    return place.join(least, "community").select("id", F.col("name").alias("community"))


def community_report(nodes: DataFrame, found: DataFrame, least: int = 3, share: float = 0.6) -> DataFrame:
    """Per community: size, share of production nodes, most common first two namespace parts, bucket and confidence.

    Production candidates have ``least`` members, as many of them production, and a ``share`` of production (High from
    0.8, else Medium); others with any production node are broader matches (Medium), the rest noise (Low).
    """
    from .structural import actionability

    prod = actionability(nodes).select("id", (F.col("bucket") == "ProductionCandidate").cast("int").alias("prod"))
    j = found.join(nodes.select("id", F.substring_index("namespace", ".", 2).alias("segment")), "id").join(prod, "id")
    seg = j.where("segment is not null").groupBy("community", "segment").agg(F.count("*").alias("n")).groupBy("community").agg(
        F.min_by("segment", F.struct(-F.col("n"), F.col("segment"))).alias("segment")
    )
    g = j.groupBy("community").agg(F.count("*").alias("size"), F.sum("prod").alias("prod")).withColumn("r", F.col("prod") / F.col("size"))
    bucket = (
        F.when((F.col("prod") >= least) & (F.col("r") >= share), "ProductionCandidate").when(F.col("prod") > 0, "BroaderHeuristicMatch").otherwise("SuppressedNoise")
    )
    sure = F.when((F.col("prod") >= least) & (F.col("r") >= max(share, 0.8)), "High").when(F.col("prod") > 0, "Medium").otherwise("Low")
    return g.select("community", "size", F.round("r", 4).alias("production_share"), bucket.alias("bucket"), sure.alias("confidence")).join(seg, "community", "left")


def risky_core(nodes: DataFrame, edges: DataFrame, types: list[str] = TRAVERSAL, sources: DataFrame | None = None) -> DataFrame:
    """The eight riskiest nodes: betweenness, PageRank, articulation and bridges, each against its greatest.

    Score = 40, 22, 23 and 15 parts of the four, the best twelve corrected by connected layers (+4 each beyond
    the first) and by freshness (-18 Low, -6 Medium), within 0 to 100.
    """
    ws = Workspace(nodes.sparkSession, "risk")
    # Every step reads the graph: it is written once, and numbered once for the three that hold it as arrays.
    nodes, edges = ws.cut(nodes), ws.cut(edges.where(F.col("type").isin(types)))
    graph = numbered(ws, nodes, edges, types)
    top = lambda df, col, n: ws.cut(df.orderBy(F.desc(col), "id").limit(n))
    btw = top(betweenness(nodes, edges, types, sources, graph).where("score > 0"), "score", 20).select("id", F.col("score").alias("btw"))
    pr = top(pagerank(nodes, edges, types), "score", 20).select("id", F.col("score").alias("pr"))
    art = top(articulation_points(nodes, edges, types, graph), "parts", 20).select("id", F.col("parts").cast("double").alias("art"))
    cut_edges = ws.cut(bridges(nodes, edges, types, graph).orderBy("a", "b").limit(30))
    br = cut_edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").cast("double").alias("br"))
    all_ = btw.join(pr, "id", "full").join(art, "id", "full").join(br, "id", "full")
    hi = all_.agg(*[F.max(c).alias(f"m_{c}") for c in ("btw", "pr", "art", "br")])
    part = lambda c, w: F.when(F.col(f"m_{c}") > 0, F.coalesce(c, F.lit(0.0)) / F.col(f"m_{c}")).otherwise(0.0) * w
    keep = nodes.where(F.col("file_role").isin("Source", "Unknown") & (F.col("type") != "File"))
    base = (
        all_.crossJoin(F.broadcast(hi))  # one row
        .withColumn("base", F.round(part("btw", 40) + part("pr", 22) + part("art", 23) + part("br", 15)).cast("int"))
        .select("id", "base").where("base > 0").join(keep, "id").orderBy(F.desc("base"), "name", "id").limit(12)
    )
    base = ws.cut(base.withColumn("own_layer", layer(F.col("namespace"), F.col("file_path"))))
    ends = moves(edges, types, "both").select("a", "b").join(base.select(F.col("id").alias("a")), "a", "left_semi")
    around = ends.join(nodes.select(F.col("id").alias("b"), layer(F.col("namespace"), F.col("file_path")).alias("l")), "b").select(F.col("a").alias("id"), "l")
    layers = around.unionByName(base.select("id", F.col("own_layer").alias("l"))).where("l != 'Unknown'").groupBy("id").agg(F.count_distinct("l").alias("layers"))
    less = F.when(freshness() == "Low", 18).when(freshness() == "Medium", 6).otherwise(0)
    scored = base.join(layers, "id", "left").withColumn(
        "score", F.greatest(F.lit(0), F.least(F.lit(100), F.col("base") + 4 * F.greatest(F.lit(0), F.coalesce("layers", F.lit(0)) - 1) - less)).cast("int")
    )
    label = F.when(F.col("score") >= 75, "Critical").when(F.col("score") >= 55, "High").when(F.col("score") >= 35, "Moderate").otherwise("Watch")
    return scored.orderBy(F.desc("score"), "name", "id").limit(8).select("id", "base", "score", label.alias("label"))
