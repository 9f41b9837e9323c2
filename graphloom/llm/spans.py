"""Long exact spans shared between documents, by relative Lempel-Ziv parsing.

Equal texts form a class. An anchor is a gram of half the wanted length chosen by content alone, such that any
span of that length holds one. Around every anchor that stands in more than one class, the grams of the full
length are compared by hash; texts that have one in common are each linked with one of them, the reference block
of that passage. Texts are then parsed against the blocks they are linked with, once per link, so a passage that
n texts share costs n parses. What the parse finds decides; hashes only name the blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import Workspace
from .bpe import slices

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x94D049BB133111EB)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Rows up to which a table of document numbers (16 bytes each) is broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 100_000


def codes(text: str) -> np.ndarray:
    """Code points of the text."""
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _join(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    x = (u * _C2) ^ (v + (v >> np.uint64(29)))
    x *= _C1
    return x ^ (x >> np.uint64(32))


def grams(x: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n code points; position i covers x[i : i + n]."""
    h, w = (x.astype(np.uint64) + np.uint64(1)) * _C3, 1
    h ^= h >> np.uint64(31)
    while w * 2 <= n:
        h = _join(h[:-w], h[w:])
        w *= 2
    return _join(h[: len(h) - (n - w)], h[n - w :]) if w < n else h


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (minimum or maximum) over every run of w values."""
    m, k = x, 1
    while k * 2 <= w:
        m = f(m[:-k], m[k:])
        k *= 2
    return f(m[: len(m) - (w - k)], m[w - k :]) if k < w else m


#: Stands around texts that are hashed together; no code point.
_EDGE = np.uint32(0x110000)


class _Joined:
    """Several texts in one array, with edges around each so that no window reaches into another text."""

    def __init__(self, texts: list[str], span: int):
        self.span, self.k = span, span // 2
        self.reach = span - self.k  # an anchor lies at most so far inside a gram of the span's length
        lens = np.array([len(t) for t in texts], dtype=np.int64)
        edge = np.full(self.reach, _EDGE, dtype=np.uint32)
        parts = [edge]
        for t in texts:
            parts += [codes(t), edge]
        self.x = np.concatenate(parts)
        self.start = self.reach + np.concatenate(([0], np.cumsum(lens + self.reach)[:-1])).astype(np.int64) if len(lens) else np.zeros(0, np.int64)
        self.text = np.full(len(self.x), -1, dtype=np.int64)
        self.left = np.zeros(len(self.x), dtype=np.int64)  # code points from here to the end of the text
        for i, (s, n) in enumerate(zip(self.start.tolist(), lens.tolist())):
            self.text[s : s + n] = i
            self.left[s : s + n] = np.arange(n, 0, -1)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Text number and hash of the distinct anchors of each text."""
        g, span = grams(self.x, self.k), self.span
        h = np.where(self.left[: len(g)] >= self.k, g, _TOP)
        w = span - self.k + 1
        low = _slide(h, w, np.minimum)
        low = np.where(self.left[: len(low)] >= span, low, np.uint64(0))  # windows over the end of a text say nothing
        low = np.concatenate((np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)))
        best = _slide(low, w, np.maximum)[: len(h)]
        at = np.flatnonzero((best == h) & (h != _TOP))
        rows = np.unique(np.stack([self.text[at].astype(np.uint64), h[at]], axis=1), axis=0)
        return rows[:, 0].astype(np.int64), rows[:, 1].view(np.int64)

    def gram(self, at: np.ndarray, n: int, hashes: np.ndarray) -> np.ndarray:
        """Hashes of the grams of n code points at positions of one text, 0 where the text ends before."""
        inside = (at >= 0) & (self.left[np.maximum(at, 0)] >= n)
        return np.where(inside, hashes[np.minimum(np.maximum(at, 0), len(hashes) - 1)], np.uint64(0))


def anchors(texts: list[str], span: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every distinct anchor of texts of at least ``span`` code points.

    A gram of half the span is an anchor if it has the least hash within some window of the span's length, so
    two equal spans hold the same anchor at the same place.
    """
    return _Joined(texts, span).anchors()


def quarters(span: int) -> list[tuple[int, int]]:
    """Ranges (both ends included) of places that an anchor can have in a span."""
    reach = span - span // 2
    q = -(-reach // 4)
    return [(a, min(a + q, reach)) for a in range(0, reach, q)]


def _anchor_batches(batches, span: int):
    for b in batches:
        texts, cls = b.column(0).to_pylist(), b.column(1).to_numpy()
        for s, e in slices([len(t) for t in texts]):
            mine, anchor = anchors(texts[s:e], span)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(cls[s:e][mine])], names=["anchor", "cls"])


_PLACE = "anchor bigint, cls bigint, pos int, win bigint, keys array<bigint>"


def _places(batches, span: int):
    """Where the anchors stand in each text: position, hash of the window around (cut off at the ends of the text),
    and for each quarter the hash of what all grams of the span's length with the anchor there have in common (0
    if there is none)."""
    for b in batches:
        texts, cls, wanted = b.column(1).to_pylist(), b.column(0).to_numpy(), b.column(2)
        off, flat = wanted.offsets.to_numpy(), wanted.values.to_numpy().view(np.uint64)
        for s, e in slices([len(t) for t in texts]):
            j = _Joined(texts[s:e], span)
            g = grams(j.x, j.k)
            live = np.unique(flat[off[s] - off[0] : off[e] - off[0]])
            at = np.flatnonzero(np.isin(g, live) & (j.left[: len(g)] >= j.k))
            win = grams(j.x, j.k + 2 * j.reach)[at - j.reach]
            key = np.stack([g[at], j.text[at].astype(np.uint64), win], axis=1)
            at = at[np.unique(key, axis=0, return_index=True)[1]] if len(at) else at
            keys, hashes = [], {}
            for lo, hi in quarters(span):
                n = span - (hi - lo)
                if n not in hashes:
                    hashes[n] = grams(j.x, n)
                here = j.gram(at - lo, n, hashes[n])
                keys.append(np.where(j.text[at - lo] == j.text[at], here, np.uint64(0)))
            keys = np.stack(keys, axis=1) if len(at) else np.zeros((0, len(quarters(span))), np.uint64)
            win = grams(j.x, j.k + 2 * j.reach)[at - j.reach]
            mine = j.text[at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(g[at].view(np.int64)), pa.array(cls[s:e][mine]), pa.array((at - j.start[mine]).astype(np.int32)), pa.array(win.view(np.int64)),
                    pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel().view(np.int64)), keys.shape[1]).cast(pa.list_(pa.int64())),
                ],
                names=["anchor", "cls", "pos", "win", "keys"],
            )


def _passages(batches, span: int):
    """Hashes of the grams of the span's length around anchors, for the quarters asked for."""
    ranges = quarters(span)
    names = ["anchor", "h", "win", "cls"]
    for b in batches:
        for cls, text, places in zip(*(b.column(k).to_pylist() for k in range(3))):
            h = grams(codes(text), span)
            out = set()
            for x in places:
                lo, hi = ranges[x["j"]]
                for i in range(max(0, x["pos"] - hi), min(len(h) - 1, x["pos"] - lo) + 1):
                    out.add((x["anchor"], int(h[i : i + 1].view(np.int64)[0]), x["win"], cls))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


class Block:
    """A reference text with an index of all its grams of the wanted length."""

    def __init__(self, text: str, span: int):
        self.x, self.span = codes(text), span
        h = grams(self.x, span)
        self.order = np.argsort(h, kind="stable")
        self.sorted = h[self.order]

    def factors(self, text: str) -> list[tuple[int, int, int]]:
        """Greedy parse of the text: (start, start in the block, length) of each factor of at least ``span``.

        At a position whose gram occurs in the block the longest match there is taken, of equal ones the first in
        the block. The parse goes on at the last position whose gram does not lie within that factor, so a span
        over the boundary of two factors is not lost.
        """
        y, n = codes(text), self.span
        h = grams(y, n)
        lo, hi = np.searchsorted(self.sorted, h), np.searchsorted(self.sorted, h, side="right")
        hit = np.flatnonzero(hi > lo)
        out, at = [], 0
        while at < len(hit):
            i = int(hit[at])
            m, j = self._longest(y, i, self.order[lo[i] : hi[i]])
            if m < n:  # equal hash of unequal texts
                at += 1
                continue
            out.append((i, j, m))
            at = int(np.searchsorted(hit, i + m - n + 1))
        return out

    def _longest(self, y: np.ndarray, i: int, starts: np.ndarray) -> tuple[int, int]:
        """Longest match of y[i:] at one of the starts. All are followed at once, and those that fall behind are
        dropped, so a gram that a block repeats costs one look per code point and repeat still in the race."""
        if len(starts) == 1:
            return _common(y[i:], self.x[int(starts[0]) :]), int(starts[0])
        left, m, step = np.sort(starts), 0, 256
        while True:
            k = min(step, len(y) - i - m)
            room = np.minimum(k, len(self.x) - left - m)
            if k <= 0 or room.max() <= 0:
                return m, int(left[0])
            at = np.minimum(left[:, None] + m + np.arange(k), len(self.x) - 1)
            same = (self.x[at] == y[i + m : i + m + k]) & (np.arange(k) < room[:, None])
            got = np.where(same.all(axis=1), k, np.argmin(same, axis=1))
            left = left[got == got.max()]
            m += int(got.max())
            if got.max() < k:
                return m, int(left[0])
            if len(left) == 1:
                return m + _common(y[i + m :], self.x[int(left[0]) + m :]), int(left[0])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n, step = min(len(a), len(b)), 512
    for s in range(0, n, step):
        e = min(n, s + step)
        differ = np.flatnonzero(a[s:e] != b[s:e])
        if len(differ):
            return s + int(differ[0])
    return n


_FACTOR = "cls bigint, other bigint, start bigint, other_start bigint, length bigint"


def _parse(batches, span: int):
    """Factors of texts against their block. Rows are (block, class or null, text), sorted, the block's own first."""
    block, at = None, None
    for b in batches:
        out = []
        for r, cls, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if cls is None:
                at, block = r, Block(text.as_py(), span)
            elif r == at:
                out += [(cls, r, *f) for f in block.factors(text.as_py())]
        cols = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["cls", "other", "start", "other_start", "length"])


def text_hash(seed: int):
    """64 bits of the text, other ones for each seed."""
    return F.xxhash64("text") if not seed else F.xxhash64(F.lit(seed), "text")


def text_classes(ws: Workspace, base: DataFrame, code=text_hash) -> DataFrame:
    """``base`` (with ``text``) and the class of the text: a 64-bit hash, checked against the texts.

    Where unequal texts have one hash, all but the least of them get a new one, until no two texts share any. Only
    texts whose hash occurs more than once are compared.
    """
    out = base.withColumn("cls", code(0))
    for seed in range(1, 50):
        twice = out.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls")
        clash = ws.cut(
            out.join(twice, "cls", "left_semi").groupBy("cls").agg(F.min("text").alias("low"), F.max("text").alias("high"))
            .where("low != high").select("cls", "low")
        )
        if clash.isEmpty():
            return out
        out = out.join(clash, "cls", "left").withColumn("cls", F.when(F.col("low").isNotNull() & (F.col("text") != F.col("low")), code(seed)).otherwise(F.col("cls"))).drop("low")
    raise RuntimeError("texts cannot be told apart by their hashes")


class SharedSpans:
    """Spans of at least ``span`` code points that stand in more than one distinct text.

    ``members``: doc_id and class, a class being all documents with an equal text. ``factors``: factors of each class
    in the reference blocks (classes, too) it is linked with; every code point of a class that lies in a span of
    another class lies in one of its factors. Any two classes that share a span have a factor in each other or are
    in one of the ``groups`` together. Copies are never paired with each other; texts shorter than the
    span (null and empty ones too) are left out.

    Nothing here grows with pairs: an anchor or passage that a third of all texts hold is combined before each
    shuffle, texts of one block are dealt to tasks of about ``deal`` parses, and equal sets are kept once.
    """

    def __init__(self, docs: DataFrame, span: int = 200, broadcast_rows: int = BROADCAST_ROWS, deal: int = 64, code=text_hash):
        spark = docs.sparkSession
        self.ws = ws = Workspace(spark, "spans")
        self.deal = deal
        small = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
        base = text_classes(ws, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") >= span), code)
        self.members = base.select("doc_id", "cls")
        found = ws.cut(base.select("text", "cls").mapInArrow(lambda b: _anchor_batches(b, span), "anchor bigint, cls bigint"))
        twice = ws.cut(found.groupBy("anchor").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a < b").select("anchor"))
        wanted = ws.cut(found.join(small(twice), "anchor", "left_semi").groupBy("cls").agg(F.collect_set("anchor").alias("anchors")))
        texts = ws.cut(
            base.join(small(wanted.select("cls")), "cls", "left_semi").groupBy("cls").agg(F.min_by("text", "doc_id").alias("text"))
        )
        ws.drop(found)
        ws.drop(twice)
        places = ws.cut(texts.join(wanted, "cls").select("cls", "text", "anchors").mapInArrow(lambda b: _places(b, span), _PLACE))
        ws.drop(wanted)
        windows = ws.cut(
            places.groupBy("anchor", "win").agg(F.min(F.struct("cls", "pos", "keys")).alias("m"), F.max("cls").alias("last"), F.count("*").alias("n"))
            .select("anchor", "win", F.col("m.cls").alias("rep"), F.col("m.pos").alias("pos"), F.col("m.keys").alias("keys"), "last", "n")
        )
        # What the grams of a quarter have in common: two texts are a pair to be parsed; more texts in one and the same
        # window are a set; only more texts in several windows have to be told apart by the grams themselves.
        parts = ws.cut(
            places.select("anchor", "win", "cls", F.posexplode("keys").alias("j", "key")).where("key != 0")
            .groupBy("anchor", "j", "key").agg(F.min("cls").alias("a"), F.max("cls").alias("b"), F.count("*").alias("n"), (F.min("win") != F.max("win")).alias("mixed")).where("a < b")
        )
        asked = (
            windows.select("anchor", "win", "rep", "pos", F.posexplode("keys").alias("j", "key")).where("key != 0")
            .join(parts.where("n > 2 and mixed").select("anchor", "j", "key"), ["anchor", "j", "key"], "left_semi")
            .groupBy(F.col("rep").alias("cls")).agg(F.collect_list(F.struct("anchor", "win", "pos", "j")).alias("places"))
        )
        grams_ = ws.cut(
            texts.join(asked, "cls").select("cls", "text", "places").mapInArrow(lambda b: _passages(b, span), "anchor bigint, h bigint, win bigint, cls bigint")
        )
        passages = ws.cut(grams_.groupBy("anchor", "h").agg(F.min("cls").alias("rep"), F.max("cls").alias("last"), *self._sign("win")).where("rep < last or n > 1"))
        # Of passages with equal windows one stands for all.
        kept = ws.cut(passages.groupBy("anchor", "n", "s", "t", "m").agg(F.min(F.struct("h", "rep", "last")).alias("p")).select("anchor", "p.*"))
        rows = ws.cut(grams_.join(kept.select("anchor", "h", F.col("rep").alias("low")), ["anchor", "h"]).withColumnRenamed("cls", "rep"))
        many = windows.where("n > 2").select("anchor", "win").unionByName(rows.select("anchor", "win")).distinct()
        held = ws.cut(places.select("anchor", "win", "cls").join(windows.where("n > 1").select("anchor", "win", "rep"), ["anchor", "win"]).unionByName(
            windows.where("n = 1").join(rows.select("anchor", "win").distinct(), ["anchor", "win"], "left_semi").select("anchor", "win", F.col("rep").alias("cls"), "rep")
        ))
        two = lambda a, b: F.struct(F.col(a).alias("cls"), F.col(b).alias("other"))
        both = lambda df, a, b: df.select(F.explode(F.array(two(a, b), two(b, a))).alias("x"))
        links = ws.cut(
            held.select(two("cls", "rep").alias("x")).unionByName(windows.where("rep < last").select(two("rep", "last").alias("x")))
            .unionByName(both(parts.where("n = 2"), "a", "b"))
            .unionByName(kept.select(two("rep", "last").alias("x"))).unionByName(rows.select(two("rep", "low").alias("x")))
            .select("x.*").where("cls != other").distinct()
        )
        blocks = ws.cut(links.groupBy("other").agg(F.ceil(F.count("*") / deal).alias("tasks")))
        dealt = links.join(small(blocks), "other").select("other", "cls", F.pmod(F.xxhash64("cls"), "tasks").alias("task"))
        none = F.lit(None).cast("long")
        work = (
            texts.join(blocks.select(F.col("other").alias("cls"), "tasks"), "cls")
            .select(F.col("cls").alias("other"), none.alias("cls"), "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"))
            .unionByName(dealt.join(texts, "cls").select("other", "cls", "text", "task"))
        )
        self.factors = ws.cut(
            work.repartition("other", "task").sortWithinPartitions("other", "task", F.asc_nulls_first("cls")).select("other", "cls", "text")
            .mapInArrow(lambda b: _parse(b, span), _FACTOR)
        )
        self._held, self._rows = ws.cut(held.join(many, ["anchor", "win"], "left_semi")), rows
        self._windows = ws.cut(windows.where("n > 2").select("anchor", "win", "n"))
        for t in (texts, places, windows, parts, blocks, links, grams_, passages, held):
            ws.drop(t)

    @staticmethod
    def _sign(column: str):
        """Columns that tell sets of distinct numbers apart, combined before the shuffle."""
        return [F.count("*").alias("n"), F.bit_xor(F.xxhash64(column)).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), column)).alias("t"), F.max(column).alias("m")]

    @property
    def groups(self) -> DataFrame:
        """``set, cls, n`` of more than two classes that hold one passage, equal sets once. Who is in a set follows
        from the factors: the class shares one with the block of its window, and that with the block of the set."""
        sure = self.factors.select("cls", "other").distinct()
        firm = lambda df, a, b: df.where(F.col(a) == F.col(b)).unionByName(
            df.where(F.col(a) != F.col(b)).join(sure.select(F.col("cls").alias(a), F.col("other").alias(b)), [a, b], "left_semi").select(df.columns)
        )
        rows = firm(self._rows.select("anchor", "h", "win", "rep", "low"), "rep", "low").select("anchor", "h", "win").unionByName(
            self._windows.select("anchor", F.col("win").alias("h"), "win")
        )
        held = firm(self._held.select("anchor", "win", "cls", "rep"), "cls", "rep")
        # Windows that many texts hold are dealt to several tasks.
        full = self.ws.cut(
            held.select("anchor", "win", "cls", F.pmod(F.xxhash64("cls"), F.lit(16)).cast("int").alias("salt"))
            .join(rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15)))), ["anchor", "win", "salt"])
            .select("anchor", "h", "cls").distinct()
        )
        kept = (
            full.groupBy("anchor", "h").agg(*self._sign("cls")).where("n > 2")
            .groupBy("n", "s", "t", "m").agg(F.min(F.struct("anchor", "h")).alias("g")).select("g.*", "n")
        )
        return full.join(kept, ["anchor", "h"]).select(F.struct("anchor", "h").alias("set"), "cls", "n")

    def class_pairs(self) -> DataFrame:
        """``x < y`` of all classes that share a span: as many rows as there are such pairs."""
        g = self.groups
        tasks = F.ceil(F.col("n") / self.deal)
        a = g.select("set", F.col("cls").alias("x"), F.pmod(F.xxhash64("cls"), tasks).alias("task"))
        b = g.select("set", F.col("cls").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1)).alias("task"))
        parsed = self.factors.select(F.least("cls", "other").alias("x"), F.greatest("cls", "other").alias("y"))
        return a.join(b, ["set", "task"]).where("x < y").select("x", "y").unionByName(parsed).distinct()

    def document_pairs(self) -> DataFrame:
        """``doc_id_a < doc_id_b`` of all documents that share a span, equal texts included.

        As many rows as there are such pairs, which is what is asked for here; ``groups`` with ``members`` say the
        same without expanding anything.
        """
        m = self.members
        across = (
            self.class_pairs().join(m.select(F.col("cls").alias("x"), F.col("doc_id").alias("p")), "x")
            .join(m.select(F.col("cls").alias("y"), F.col("doc_id").alias("q")), "y")
            .select(F.least("p", "q").alias("doc_id_a"), F.greatest("p", "q").alias("doc_id_b"))
        )
        copies = m.select("cls", F.col("doc_id").alias("doc_id_a")).join(m.select("cls", F.col("doc_id").alias("doc_id_b")), "cls")
        return across.unionByName(copies.where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b"))

    def report(self, docs: DataFrame) -> DataFrame:
        """Per document: code points, code points that lie in a shared span, blocks it is linked with, copies.

        A document with an equal copy of at least the span's length is shared throughout. Null texts have 0
        code points.
        """
        parts = self.factors
        # At most one interval per start position of a text, whatever the number of partners.
        longest = parts.groupBy("cls", F.col("start").alias("s")).agg(F.max(F.col("start") + F.col("length")).alias("e"))
        before = Window.partitionBy("cls").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
        covered = (
            longest.withColumn("done", F.coalesce(F.max("e").over(before), F.lit(0)))
            .groupBy("cls").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "done"))).alias("covered"))
        )
        links = parts.groupBy("cls", "other").agg(F.lit(1).alias("one")).groupBy("cls").agg(F.count("*").alias("links"))
        copies = self.members.groupBy("cls").agg(F.count("*").alias("size"))
        known = self.members.join(copies, "cls").join(covered, "cls", "left").join(links, "cls", "left")
        all_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
        n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
        return all_.join(known, "doc_id", "left").select(
            "doc_id", "chars",
            F.when(F.col("size") > 1, F.col("chars")).otherwise(n("covered")).alias("shared_chars"),
            n("links").alias("linked_blocks"), F.greatest(n("size") - 1, F.lit(0)).alias("copies"),
        )
