"""Filling containers of fixed capacity with documents that belong together.

The index over the documents' tokens is sharded by content: a coarse quantizer over all documents (centres of short
sketches of their BM25 vectors) puts documents with like tokens into one shard. Within a shard an inverted index
answers, for each seed document, which unused documents are nearest by BM25, and these fill the seed's container.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import Workspace
from .bpe import DEFAULT_VOCABULARY, encode_batches, encoder

K1, B = 1.2, 0.75
OUT = "container_id bigint, position int, doc_id bigint, start_token int, n_tokens int"
#: Tokens a shard holds at most, about: a few hundred containers, a few MB of index.
SHARD_TOKENS = 1_000_000
#: Numbers in a sketch, documents the centres are fitted on (the only sample; every document is assigned and packed),
#: the most centres, and turns of the fit.
SKETCH, FIT_ROWS, CENTRES, TURNS = 96, 10_000, 512, 12
#: Share of a container that is filled by nearness alone before the rest is closed with the best fit.
NEAR_SHARE = 0.8


def token_bytes(size: int) -> str:
    """Two bytes hold an id of a vocabulary of up to 65,536 entries."""
    return "<u2" if size <= 1 << 16 else "<u4"


def _packed(batches, path: str):
    """Token ids as bytes, with their number."""
    kind = token_bytes(encoder(path).size)
    w = int(kind[-1])
    for b in encode_batches(batches, "doc_id", "text", path):
        ids = b.column(1)
        off = ids.offsets.to_numpy()
        flat = ids.values.to_numpy().astype(kind).tobytes()
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(np.diff(off).astype(np.int32)), pa.array([flat[w * s : w * e] for s, e in zip(off[:-1], off[1:])], pa.binary())],
            names=["doc_id", "n", "tokens"],
        )


def _frequencies(batches, size: int):
    """Documents per token id over one partition: at most one row per vocabulary entry."""
    df = np.zeros(size, dtype=np.int64)
    for b in batches:
        for raw in b.column(0).to_pylist():
            df[np.unique(np.frombuffer(raw, dtype=token_bytes(size)))] += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["token", "df"])


def _planes(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and sign of each token in a sketch."""
    rnd = np.random.default_rng(11)
    return rnd.integers(0, SKETCH, size), rnd.choice(np.array([-1.0, 1.0], dtype=np.float32), size)


def sketch(tokens: np.ndarray, idf: np.ndarray, mean: float, place: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """A short unit vector whose products come near those of the BM25 vectors: weights added at hashed places."""
    t, c = np.unique(tokens, return_counts=True)
    w = idf[t] * (c * (K1 + 1)) / (c + K1 * (1 - B + B * len(tokens) / mean))
    v = np.bincount(place[t], weights=w * sign[t], minlength=SKETCH).astype(np.float32)
    n = float(np.sqrt(v @ v))
    return v / n if n else v


def fit_centres(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centres of the rows of x by spherical k-means; the first ones are rows far from each other."""
    at = [0]
    near = x @ x[0]
    while len(at) < min(k, len(x)):
        at.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[at[-1]])
    c = x[at].copy()
    for _ in range(TURNS):
        mine = np.argmax(x @ c.T, axis=1)
        for j in np.unique(mine):
            v = x[mine == j].sum(0)
            n = float(np.sqrt(v @ v))
            if n:
                c[j] = v / n
    return c


def _sketches(batches, idf: np.ndarray, mean: float):
    place, sign = _planes(len(idf))
    for b in batches:
        rows = [sketch(np.frombuffer(raw, dtype=token_bytes(len(idf))), idf, mean, place, sign).tobytes() for raw in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["doc_id", "sketch"])


def _assign(batches, idf: np.ndarray, mean: float, centres: np.ndarray):
    """The nearest centre of each document."""
    place, sign = _planes(len(idf))
    for b in batches:
        x = np.stack([sketch(np.frombuffer(raw, dtype=token_bytes(len(idf))), idf, mean, place, sign) for raw in b.column(2).to_pylist()]) if b.num_rows else np.zeros((0, SKETCH), np.float32)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.argmax(x @ centres.T, axis=1).astype(np.int32))], names=["doc_id", "n", "tokens", "centre"])


def _nearest(items: np.ndarray, score: np.ndarray, sizes: np.ndarray, ids: np.ndarray, first: int = 48):
    """Items with a positive score, best first, then larger, then smaller id. The first few are found without sorting
    all; the others are sorted once they are asked for."""
    s = score[items]
    items, s = items[s > 0], s[s > 0]
    rest = items[:0]
    if len(items) > 4 * first:
        least = np.partition(s, len(s) - first)[len(s) - first]
        rest, items = items[s < least], items[s >= least]
    yield from items[np.lexsort((ids[items], -sizes[items], -score[items]))].tolist()
    if len(rest):
        yield from rest[np.lexsort((ids[rest], -sizes[rest], -score[rest]))].tolist()


def pack_shard(ids: np.ndarray, sizes: np.ndarray, tokens: list[np.ndarray], capacity: int, idf: np.ndarray, mean: float):
    """Containers of one shard: lists of item numbers. Items are at most ``capacity`` long and not empty.

    The largest unused item seeds a container. All unused items with a positive BM25 score are tried from the best
    downwards and taken if they fit, until NEAR_SHARE of the container is full; ties go to the larger, then to the
    smaller id. The gap is then closed with the largest item that still fits, nearest first among equals.
    """
    n = len(sizes)
    order = np.lexsort((ids, -sizes))  # largest first
    term, doc, tf = [], [], []
    for i in range(n):
        t, c = np.unique(tokens[i], return_counts=True)
        term.append(t)
        doc.append(np.full(len(t), i, dtype=np.int32))
        tf.append(c)
    lens = np.array([len(t) for t in term])
    start_of = np.concatenate(([0], np.cumsum(lens)))
    term_all, doc_all, tf_all = np.concatenate(term), np.concatenate(doc), np.concatenate(tf)
    weight = idf[term_all] * (tf_all * (K1 + 1)) / (tf_all + K1 * (1 - B + B * sizes[doc_all] / mean))
    by_term = np.argsort(term_all, kind="stable")
    post_doc, post_w = doc_all[by_term].astype(np.intp), weight[by_term].astype(np.float64)
    heads, first = np.unique(term_all[by_term], return_index=True)
    last = np.concatenate((first[1:], [len(by_term)]))
    slot = np.searchsorted(heads, term_all)  # the posting list of each (item, term)

    free = np.ones(n, dtype=bool)
    # Unused items by size, for the best fit: one sorted array per call, thinned as items go.
    by_size = np.lexsort((ids, sizes))
    sorted_sizes = sizes[by_size]
    out = []
    for seed in order:
        if not free[seed]:
            continue
        free[seed] = False
        box, gap = [int(seed)], capacity - int(sizes[seed])
        alive = free[by_size]
        by_size, sorted_sizes = by_size[alive], sorted_sizes[alive]
        if len(by_size) and sorted_sizes[0] <= gap:
            s = slot[start_of[seed] : start_of[seed + 1]]
            lists = [slice(a, b) for a, b in zip(first[s].tolist(), last[s].tolist())]
            score = np.bincount(
                np.concatenate([post_doc[x] for x in lists]), weights=np.concatenate([post_w[x] for x in lists]), minlength=n
            )
            open_ = by_size[: np.searchsorted(sorted_sizes, gap, side="right")]
            for i in _nearest(open_, score, sizes, ids):
                if capacity - gap >= NEAR_SHARE * capacity:
                    break
                if sizes[i] <= gap:
                    box.append(i)
                    free[i] = False
                    gap -= int(sizes[i])
            while True:
                hi = np.searchsorted(sorted_sizes, gap, side="right")
                while hi and not free[by_size[hi - 1]]:
                    hi -= 1
                if not hi:
                    break
                lo = np.searchsorted(sorted_sizes, sorted_sizes[hi - 1])
                same = by_size[lo:hi][free[by_size[lo:hi]]]
                i = same[np.lexsort((ids[same], -score[same]))[0]]
                box.append(int(i))
                free[i] = False
                gap -= int(sizes[i])
        out.append(box)
    return out


def _pack_table(table: pa.Table, capacity: int, idf: np.ndarray, mean: float) -> pa.Table:
    shard = table.column("shard")[0].as_py()
    order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
    doc = table.column("doc_id").to_numpy()[order]
    raw = table.column("tokens").to_pylist()
    toks = [np.frombuffer(raw[i], dtype=token_bytes(len(idf))) for i in order]
    rows: list[tuple] = []
    box = 0
    base = shard << 32
    items, starts, kept = [], [], []
    for d, t in zip(doc, toks):
        start = 0
        if len(t) > capacity:
            while len(t) - start >= capacity:  # full pieces have containers of their own
                rows.append((base + box, 0, d, start, capacity))
                box, start = box + 1, start + capacity
        if start < len(t):
            items.append(d)
            starts.append(start)
            kept.append(t[start:])
    if items:
        ids, sizes = np.array(items), np.array([len(t) for t in kept])
        for group in pack_shard(ids, sizes, kept, capacity, idf, mean):
            rows += [(base + box, p, ids[i], starts[i], sizes[i]) for p, i in enumerate(group)]
            box += 1
    cols = list(zip(*rows)) if rows else [[]] * 5
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    names = ["container_id", "position", "doc_id", "start_token", "n_tokens"]
    return pa.table([pa.array(np.array(c, dtype=np.int64)).cast(t) for c, t in zip(cols, types)], names=names)


def pack(
    docs: DataFrame, capacity: int = 2048, path: str = DEFAULT_VOCABULARY, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """One row per document, or piece of one, with its container and place in it.

    Every token of every document is in exactly one row; only documents longer than ``capacity`` are split,
    into full pieces and one rest. Null and empty texts have no tokens and no row. Equal texts are separate
    items. There are as many centres as shards of ``shard_tokens`` are needed, at most CENTRES, fitted on FIT_ROWS
    documents picked by a hash of the id; the documents of a centre are dealt by a hash of the id to shards of about
    ``shard_tokens``, so neither a hot source nor copies make one large. The document frequencies behind BM25 count all
    documents. Collected are one number per vocabulary entry, the sketches of the fit, and the tokens per centre.
    ``doc_id`` must be unique.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "pack")
    coded = ws.cut(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            lambda b: _packed(b, path), "doc_id bigint, n int, tokens binary"
        ).where("n > 0")
    )
    size = encoder(path).size
    totals = coded.agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).first()
    n, tokens = totals["docs"], totals["tokens"] or 0
    if not n:
        return spark.createDataFrame([], OUT)
    seen = (
        coded.select("tokens").mapInArrow(lambda b: _frequencies(b, size), "token int, df bigint")
        .groupBy("token").agg(F.sum("df").alias("df")).toArrow()
    )
    df = np.zeros(size)
    df[seen.column("token").to_numpy()] = seen.column("df").to_numpy()
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = tokens / n
    k = min(CENTRES, -(-tokens // shard_tokens))
    if k > 1:
        picked = coded.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < FIT_ROWS).select("doc_id", "tokens")
        fit = picked.mapInArrow(lambda b: _sketches(b, idf, mean), "doc_id bigint, sketch binary").toArrow().sort_by("doc_id")
        centres = fit_centres(np.frombuffer(b"".join(fit.column("sketch").to_pylist()), dtype="<f4").reshape(-1, SKETCH), k) if fit.num_rows else np.zeros((1, SKETCH), np.float32)
    else:
        centres = np.zeros((1, SKETCH), np.float32)
    placed = ws.cut(coded.mapInArrow(lambda b: _assign(b, idf, mean, centres), "doc_id bigint, n int, tokens binary, centre int"))
    ws.drop(coded)
    # One row per centre.
    held = {r["centre"]: r["tokens"] for r in placed.groupBy("centre").agg(F.sum("n").alias("tokens")).collect()}
    parts = {c: max(1, -(-t // shard_tokens)) for c, t in held.items()}
    first, at = {}, 0
    for c in sorted(parts):
        first[c], at = at, at + parts[c]
    lookup = F.create_map(*[F.lit(x) for c in sorted(parts) for x in (c, F.struct(F.lit(first[c]).cast("long").alias("first"), F.lit(parts[c]).cast("long").alias("parts")))])
    dealt = placed.select(lookup[F.col("centre")].alias("s"), "doc_id", "tokens").select(
        (F.col("s.first") + F.pmod(F.xxhash64("doc_id"), F.col("s.parts"))).alias("shard"), "doc_id", "tokens"
    )
    return dealt.groupBy("shard").applyInArrow(lambda t: _pack_table(t, capacity, idf, mean), OUT)
