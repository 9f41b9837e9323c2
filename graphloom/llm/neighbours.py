"""The most similar vectors of every vector: a neighbour graph by NN-descent.

Vectors are unit vectors of 32-bit floats in a binary column. A first graph comes from blocks of vectors that
are close in a random order (sorted signs of random hyperplanes). Rounds of joins then bring together, at each
vector, all vectors it is linked with in either direction; each pair that meets is compared and offered to both.
Only vectors with a changed link take part in the next round.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.versions import in_force
from ..plans.session import Workspace

#: Links kept per vector if only near pairs are asked for (from a cosine of NEAR), and if pairs of any cosine are.
LINKS, MORE_LINKS, NEAR = 8, 16, 0.8
#: Orders tried for the first graph, vectors per block, signs in an order. A projection of its own, in 31 bits, orders
#: vectors of equal signs, so those of a dense cluster are near their neighbours, too.
ORDERS, BLOCK, SIGNS = 6, 1024, 24
#: Members of a vector that are all compared with each other; more are dealt to groups of about so many, other ones in
#: each round. Rows of a comparison held at once.
HUB, TILE = 4096, 512
#: Rounds end when fewer than this share of the links changed, at the latest after ROUNDS.
SETTLED, ROUNDS = 0.001, 8
#: The same share for a graph that is only walked on: a search finds its way over links that are not yet the best.
WALKABLE = 0.03
_LINK = "cls bigint, nbr binary, sim binary, fresh binary"


def read_vector(text: str | None, dim: int) -> bytes | None:
    """The unit vector of a comma separated list, or None unless it is exactly ``dim`` finite numbers, not all 0.

    Entries are trimmed, empty ones dropped.
    """
    if not text:
        return None
    parts = [p for p in map(str.strip, text.split(",")) if p]
    if len(parts) != dim or "_" in text:
        return None
    try:
        v = np.array(list(map(float, parts)))
    except ValueError:
        return None
    top = np.abs(v).max()
    if not math.isfinite(top) or not top > 0:
        return None
    v /= top
    return (v / np.sqrt(v @ v)).astype("<f4").tobytes()


def _read(batches, column: str, dim: int):
    for b in batches:
        at = b.schema.get_field_index(column)
        vec = pa.array([read_vector(t, dim) for t in b.column(at).to_pylist()], pa.binary())
        yield b.set_column(at, "vec", vec)


def usable_vectors(nodes: DataFrame, column: str = "embedding_csv", dim: int = 64) -> DataFrame:
    """``id, vec`` of the rows in force whose vector is usable. Vectors are read before versions are compared,
    so the shuffle carries 4 bytes per number."""
    rows = nodes.where("id is not null").select("id", "updated_at", "ingest_no", F.col(column).alias("csv"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:3])
    read = rows.mapInArrow(lambda b: _read(b, "csv", dim), f"{kinds}, vec binary")
    return in_force(read, ["vec"]).where("vec is not null")


def _matrix(column, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, dim)


def _unit(short: np.ndarray) -> np.ndarray:
    """Unit vectors of short forms."""
    q = short.astype(np.float32)
    return q / np.sqrt(np.einsum("ij,ij->i", q, q))[:, None]


def _orders(batches, dim: int, seed: int):
    planes = np.random.default_rng(seed).standard_normal((dim, ORDERS * (SIGNS + 1))).astype(np.float32)
    planes /= np.sqrt((planes**2).sum(0))
    weights = (1 << np.arange(SIGNS, dtype=np.int64))[::-1]
    for b in batches:
        shade = (_matrix(b.column(1), "<f4", dim) @ planes).reshape(-1, ORDERS, SIGNS + 1)
        rest = np.clip((shade[:, :, SIGNS] + 1) * (1 << 30), 0, (1 << 31) - 1).astype(np.int64)
        place = ((shade[:, :, :SIGNS] > 0) @ weights).astype(np.int64) * (1 << 31) + rest
        q = _matrix(b.column(1), "<f4", dim)
        q = np.rint(q * (32767 / np.abs(q).max(1, keepdims=True))).astype("<i2")
        rows = [q[i].tobytes() for i in range(len(q))]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(rows, pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(place.ravel()), ORDERS).cast(pa.list_(pa.int64()))],
            names=["cls", "vec", "short", "place"],
        )


def _links(cls, nbr, sim, fresh) -> pa.RecordBatch:
    """Rows of packed links; all arguments but cls are matrices of one row per vector, -2 marks no link."""
    keep = [s > -2 for s in sim]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(cls),
            pa.array([n[k].astype("<i8").tobytes() for n, k in zip(nbr, keep)], pa.binary()),
            pa.array([s[k].astype("<f4").tobytes() for s, k in zip(sim, keep)], pa.binary()),
            pa.array([f[k].astype("u1").tobytes() for f, k in zip(fresh, keep)], pa.binary()),
        ],
        names=["cls", "nbr", "sim", "fresh"],
    )


def _best(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the k largest entries of each row."""
    k = min(k, s.shape[1])
    at = np.argpartition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k :]
    return at, np.take_along_axis(s, at, 1)


def _blocks(batches, dim: int, links: int):
    """Links within consecutive runs of about BLOCK rows of a sorted partition."""
    cls, vec = [], []

    def block(n):
        nonlocal cls, vec
        c, v = np.array(cls[:n]), _unit(np.frombuffer(b"".join(vec[:n]), dtype="<i2").reshape(-1, dim))
        cls, vec = cls[n:], vec[n:]
        s = v @ v.T
        np.fill_diagonal(s, -3)
        at, sim = _best(s, links)
        return _links(c, c[at], sim, np.ones(sim.shape, dtype=bool))

    for b in batches:
        cls += b.column(0).to_pylist()
        vec += b.column(1).to_pylist()
        while len(cls) >= 2 * BLOCK:
            yield block(BLOCK)
    while cls:
        yield block(len(cls) if len(cls) < 3 * BLOCK // 2 else BLOCK)


def _sorted_groups(batches, key: int):
    """Batches cut so that rows of one key, adjacent in the input, come together."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        if not t.num_rows:
            continue
        k = t.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1]))
        rest = t.slice(cut)
        if cut:
            yield t.slice(0, cut)
    if rest is not None and rest.num_rows:
        yield rest


def _merge(batches, links: int):
    """The ``links`` best distinct links of each vector, from several rows of links per vector sorted by vector.

    A link is fresh if no earlier graph had it: old rows have fresh = 0, which wins over an offer.
    """
    for t in _sorted_groups(batches, 0):
        raw = [t.column(i).to_pylist() for i in (1, 2, 3)]
        n = np.array([len(f) for f in raw[2]])
        cls = np.repeat(t.column(0).to_numpy(), n)
        nbr, sim, fresh = (np.frombuffer(b"".join(r), dtype=d) for r, d in zip(raw, ("<i8", "<f4", "u1")))
        order = np.lexsort((fresh, nbr, cls))
        cls, nbr, sim, fresh = cls[order], nbr[order], sim[order], fresh[order]
        first = np.ones(len(cls), dtype=bool)
        first[1:] = (cls[1:] != cls[:-1]) | (nbr[1:] != nbr[:-1])
        cls, nbr, sim, fresh = cls[first], nbr[first], sim[first], fresh[first]
        order = np.lexsort((nbr, -sim, cls))
        cls, nbr, sim, fresh = cls[order], nbr[order], sim[order], fresh[order]
        heads, start, count = np.unique(cls, return_index=True, return_counts=True)
        kept = np.minimum(count, links)
        cut = lambda a, d: [a[s : s + k].astype(d).tobytes() for s, k in zip(start, kept)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(heads), pa.array(cut(nbr, "<i8"), pa.binary()), pa.array(cut(sim, "<f4"), pa.binary()), pa.array(cut(fresh, "u1"), pa.binary())],
            names=["cls", "nbr", "sim", "fresh"],
        )


def _ends(batches):
    """Both directions of every link: the vector that is sent, where it goes, whether the link is fresh, and
    whether its own least similarity is known."""
    for b in batches:
        n = np.array([len(f) for f in b.column(3).to_pylist()])
        u = np.repeat(b.column(0).to_numpy(), n)
        v = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype="<i8")
        fresh = np.frombuffer(b"".join(b.column(3).to_pylist()), dtype="u1").astype(bool)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((u, v))), pa.array(np.concatenate((v, u))), pa.array(np.concatenate((fresh, fresh)))],
            names=["cls", "at", "fresh"],
        )


def _least(batches, links: int):
    """The least similarity among the links of each vector with all its links, else -1."""
    for b in batches:
        sim = [np.frombuffer(s, dtype="<f4") for s in b.column(1).to_pylist()]
        least = np.array([s.min() if len(s) >= links else -1.0 for s in sim], dtype=np.float32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(least)], names=["cls", "least"])


def _meet(batches, dim: int, floor: float, links: int):
    """Offers from comparing, at each vector, all vectors sent to it with each other. Of what one meeting offers to a
    vector its ``links`` best are kept; no other could become one of its links."""
    for t in _sorted_groups(batches, 0):
        at = t.column(0).to_numpy()
        cls, least = t.column(1).to_numpy(), t.column(2).to_numpy()
        q = _unit(_matrix(t.column(3), "<i2", dim))
        bound = np.maximum(least, floor)
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        rows: list[tuple] = []
        for s, e in zip(starts, np.concatenate((starts[1:], [len(at)]))):
            if e - s < 2:
                continue
            for a in range(s, e, TILE):
                z = min(e, a + TILE)
                sim = q[a:z] @ q[s:e].T
                sim[np.arange(z - a), np.arange(a - s, z - s)] = -3
                if e - s > links + 1:
                    best, value = _best(sim, links)
                    i, k = np.nonzero(value > bound[a:z, None])
                    j, v = best[i, k], value[i, k]
                else:
                    i, j = np.nonzero(sim > bound[a:z, None])
                    v = sim[i, j]
                if len(i):
                    rows.append((cls[a + i], cls[s + j], v))
        if rows:
            u, v, w = (np.concatenate(x) for x in zip(*rows))
            order = np.lexsort((v, u))
            u, v, w = u[order], v[order], w[order]
            once = np.ones(len(u), dtype=bool)
            once[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
            u, v, w = u[once], v[once], w[once]
            heads, start, count = np.unique(u, return_index=True, return_counts=True)
            cut = lambda x, d: pa.array([x[s : s + k].astype(d).tobytes() for s, k in zip(start, count)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(heads), cut(v, "<i8"), cut(w, "<f4"), cut(np.ones(len(v)), "u1")], names=["cls", "nbr", "sim", "fresh"]
            )


def _pairs(batches, floor: float):
    for b in batches:
        n = np.array([len(f) // 8 for f in b.column(1).to_pylist()], dtype=np.int64)
        u = np.repeat(b.column(0).to_numpy(), n)
        v = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype="<i8")
        s = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype="<f4")
        keep = s >= floor
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(u, v)[keep]), pa.array(np.maximum(u, v)[keep])], names=["a", "b"]
        )


def _cosines(batches, dim: int):
    for b in batches:
        x, y = (_matrix(b.column(i), "<f4", dim).astype(np.float64) for i in (2, 3))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.einsum("ij,ij->i", x, y))], names=["a", "b", "cosine"])


def neighbour_graph(ws: Workspace, vectors: DataFrame, dim: int, floor: float = -1.0, seed: int = 7, settled: float = SETTLED) -> tuple[DataFrame, DataFrame]:
    """``(links, vectors)``: packed links of every distinct vector, and the vectors with their short forms.

    ``vectors``: ``cls, vec``, cls unique. Offers below ``floor`` are not made, as far as links go that a
    caller who asks for pairs of at least that cosine has no use for; links of the first graph are kept at any
    cosine, for the joins to walk on. Comparisons in the rounds use 16 bits per number. Rounds end once no more than
    ``settled`` of the links change.
    """
    links = LINKS if floor >= NEAR else MORE_LINKS
    vecs = ws.cut(
        vectors.select("cls", "vec").mapInArrow(lambda b: _orders(b, dim, seed), "cls bigint, vec binary, short binary, place array<bigint>")
    )
    first = None
    for i in range(ORDERS):
        one = (
            vecs.select(F.col("place")[i].alias("p"), "cls", "short")
            .repartitionByRange("p", "cls").sortWithinPartitions("p", "cls").select("cls", "short")
            .mapInArrow(lambda b: _blocks(b, dim, links), _LINK)
        )
        first = one if first is None else first.unionByName(one)
    merge = lambda df: ws.cut(df.repartition("cls").sortWithinPartitions("cls").mapInArrow(lambda b: _merge(b, links), _LINK))
    graph = merge(first)
    slack = floor - 0.001  # what 16 bits per number may be off, with room
    for turn in range(ROUNDS):
        ends = ws.cut(
            graph.mapInArrow(_ends, "cls bigint, at bigint, fresh boolean").repartition("cls")
            .groupBy("cls", "at").agg(F.max("fresh").alias("fresh"))
        )
        hubs = ws.cut(ends.groupBy("at").agg(F.count("*").alias("n")).where(F.col("n") > HUB))
        met = ends if not turn else ends.join(ends.where("fresh").select("at").distinct(), "at", "left_semi")
        sent = met.select("cls", "at").join(
            vecs.select("cls", "short").join(graph.select("cls", "sim").mapInArrow(lambda b: _least(b, links), "cls bigint, least float"), "cls"), "cls"
        )
        if hubs.isEmpty():
            dealt = sent.withColumn("salt", F.lit(0).cast("long"))
        else:
            dealt = sent.join(hubs, "at", "left").withColumn(
                "salt", F.pmod(F.xxhash64(F.lit(turn), "cls"), F.coalesce(F.ceil(F.col("n") / HUB), F.lit(1)).cast("long"))
            )
        offers = (
            dealt.repartition("at", "salt").sortWithinPartitions("at", "salt").select("at", "cls", "least", "short")
            .mapInArrow(lambda b: _meet(b, dim, slack, links), _LINK)
        )
        old = graph
        kept = old.withColumn("fresh", F.expr("cast(repeat(char(0), length(fresh)) as binary)"))
        offers = ws.cut(offers)
        graph = merge(kept.unionByName(offers))
        for t in (old, ends, hubs, offers):
            ws.drop(t)
        n = graph.agg(
            F.sum(F.length("fresh")).alias("all"),
            F.sum(F.length(F.regexp_replace(F.hex("fresh"), "00", "")) / 2).alias("fresh"),
        ).first()
        if not n["all"] or n["fresh"] <= settled * n["all"]:
            break
    return graph, vecs


def most_similar(vectors: DataFrame, dim: int, k: int = 5, floor: float = -1.0, seed: int = 7) -> DataFrame:
    """``id, rank, other, cosine``: for each id up to ``k`` other ids of greatest cosine of at least ``floor``.

    ``vectors``: ``id, vec`` (see :func:`usable_vectors`), id unique. Cosines are rounded to 6 decimals, ties go
    to the smaller id. Equal vectors form a class that the graph holds once; of a class only the first k + 1
    ids can be anyone's neighbours, so a large class yields k rows per id like any other. Classes are 64-bit
    hashes of the vector. No vectors give no rows; a single one has no neighbours.
    """
    ws = Workspace(vectors.sparkSession, "neighbours")
    members = ws.cut(vectors.select("id", F.xxhash64("vec").alias("cls"), "vec"))
    graph, vecs = neighbour_graph(ws, members.groupBy("cls").agg(F.min("vec").alias("vec")), dim, floor, seed)
    pairs = graph.select("cls", "nbr", "sim").mapInArrow(lambda b: _pairs(b, floor - 0.001), "a bigint, b bigint").distinct()
    v = vecs.select("cls", "vec")
    exact = (
        pairs.join(v.select(F.col("cls").alias("a"), F.col("vec").alias("va")), "a")
        .join(v.select(F.col("cls").alias("b"), F.col("vec").alias("vb")), "b")
        .select("a", "b", "va", "vb")
        .mapInArrow(lambda b: _cosines(b, dim), "a bigint, b bigint, cosine double")
        .withColumn("cosine", F.round("cosine", 6)).where(F.col("cosine") >= floor)
    )
    exact = ws.cut(exact)
    by_id = Window.partitionBy("cls").orderBy("id")
    heads = members.select("id", "cls").withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1).select("cls", F.col("id").alias("other"))
    towards = exact.select(F.col("a").alias("mine"), F.col("b").alias("cls"), "cosine").unionByName(
        exact.select(F.col("b").alias("mine"), F.col("a").alias("cls"), "cosine")
    )
    offered = towards.join(heads, "cls").select("mine", "other", "cosine").unionByName(
        heads.select(F.col("cls").alias("mine"), "other", F.lit(1.0).alias("cosine"))
    )
    best = Window.partitionBy("mine").orderBy(F.desc("cosine"), "other")
    short = offered.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    mine = Window.partitionBy("id").orderBy("n")
    return (
        members.select("id", F.col("cls").alias("mine")).join(short, "mine").where("id != other")
        .withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k)
        .select("id", "rank", "other", "cosine")
    )


def similar_pairs(vectors: DataFrame, dim: int, k: int = 5, floor: float = 0.92) -> DataFrame:
    """``id_a < id_b`` where one is among the other's ``k`` most similar and the cosine is at least ``floor``."""
    near = most_similar(vectors, dim, k, floor)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def _neighbours_of(batches):
    """(query, neighbour) of every link of the vectors to be expanded."""
    for b in batches:
        nbr = [np.frombuffer(x, dtype="<i8") for x in b.column(1).to_pylist()]
        q = np.repeat(b.column(0).to_numpy(), [len(x) for x in nbr])
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate(nbr) if nbr else np.zeros(0, np.int64))], names=["q", "cls"])


def _scores(batches, dim: int, kind: str = "<f4"):
    for b in batches:
        x, y = (_matrix(b.column(i), kind, dim).astype(np.float64) for i in (2, 3))
        if kind != "<f4":
            x, y = (v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None] for v in (x, y))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.einsum("ij,ij->i", x, y))], names=["q", "cls", "cosine"])


def _shorten(batches, dim: int):
    """Short forms (16 bits per number) of the second column's vectors."""
    for b in batches:
        v = _matrix(b.column(1), "<f4", dim)
        q = np.rint(v * (32767 / np.abs(v).max(1, keepdims=True))).astype("<i2")
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in q], pa.binary())], names=["q", "vec", "short"])


def graph_search(ws: Workspace, graph: DataFrame, vecs: DataFrame, queries: DataFrame, dim: int, k: int = 5, beam: int = 96, entries: int = 256, rounds: int = 16) -> DataFrame:
    """``q, cls, cosine``: for each query (``q, vec``) the k best vectors found by greedy search on the graph.

    All queries walk at once, over short forms. A query starts at the nearest of ``entries`` vectors picked by hash, a
    bounded set, and in each round looks at the links of the members of its beam that were not looked at; it ends
    when its beam brings nothing new. The best 2 k of a beam are compared exactly. What is compared is a few times
    the beam per query and round.
    """
    short = vecs.select("cls", F.col("short").alias("y"))
    start = ws.cut(short.orderBy(F.xxhash64("cls")).limit(entries))
    q = ws.cut(queries.select("q", "vec").mapInArrow(lambda b: _shorten(b, dim), f"q {queries.schema['q'].dataType.simpleString()}, vec binary, short binary"))
    x = q.select("q", F.col("short").alias("x"))
    best = Window.partitionBy("q").orderBy(F.desc("cosine"), "cls")
    keep = lambda df, n: df.withColumn("n", F.row_number().over(best)).where(F.col("n") <= n).drop("n")
    scored = lambda df: df.select("q", "cls", "x", "y").mapInArrow(lambda b: _scores(b, dim, "<i2"), "q bigint, cls bigint, cosine double")
    # A stated query set against a bounded set of entries.
    state = ws.cut(keep(scored(x.repartition("q").join(F.broadcast(start), F.lit(True))), beam).withColumn("seen", F.lit(False)))
    for _ in range(rounds):
        todo = state.where("not seen").select("q", "cls")
        found = todo.join(graph.select("cls", "nbr"), "cls").select("q", "nbr").mapInArrow(_neighbours_of, "q bigint, cls bigint").distinct()
        new = found.join(state.select("q", "cls"), ["q", "cls"], "left_anti")
        hits = scored(new.join(x, "q").join(short, "cls")).withColumn("seen", F.lit(False))
        nxt = ws.cut(keep(state.withColumn("seen", F.lit(True)).unionByName(hits), beam))
        ws.drop(state)
        state = nxt
        if state.where("not seen").isEmpty():
            break
    last = keep(state, 2 * k).select("q", "cls").join(q.select("q", F.col("vec").alias("x")), "q").join(vecs.select("cls", F.col("vec").alias("y")), "cls")
    exact = last.select("q", "cls", "x", "y").mapInArrow(lambda b: _scores(b, dim), "q bigint, cls bigint, cosine double")
    return keep(exact, k).select("q", "cls", F.round("cosine", 6).alias("cosine"))


def search_vectors(vectors: DataFrame, queries: DataFrame, dim: int, k: int = 5, seed: int = 7) -> DataFrame:
    """``q, id, ids, cosine``: for each query (``q bigint, vec``) its k nearest distinct vectors, each with its
    smallest id and the number of ids that share it. An empty index gives no rows."""
    ws = Workspace(vectors.sparkSession, "search")
    members = ws.cut(vectors.select("id", F.xxhash64("vec").alias("cls"), "vec"))
    graph, vecs = neighbour_graph(ws, members.groupBy("cls").agg(F.min("vec").alias("vec")), dim, -1.0, seed, WALKABLE)
    hits = graph_search(ws, graph, vecs, queries, dim, k)
    names = members.groupBy("cls").agg(F.min("id").alias("id"), F.count("*").alias("ids"))
    return hits.join(names, "cls").select("q", "id", "ids", "cosine")
