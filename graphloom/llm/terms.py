"""Occurrences and records of every distinct term, counted in burst tries.

Every task counts its records in a burst trie and hands on its containers and the weights of its prefixes. From
the weights, adaptive prefixes are chosen: a prefix that holds too large a share of all terms is split by its next
letter, again and again. Containers are routed by these prefixes, cut where they reach over one, and matching
subtrees are merged, one route at a time.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import Workspace

#: Maximal runs of letters and digits (Unicode L and N): word characters but for the underscore and marks.
_TERM = re.compile(r"[^\W_]+")


def terms_of(text: str | None) -> list[str]:
    """Terms of the text in NFC and lower case, in order; none for null or blank texts."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return _TERM.findall(text.lower())


class BurstTrie:
    """Counters of terms in containers that split by the next letter once they hold too many terms.

    A container is a dict from the rest of a term to [occurrences, records]; an inner node is a dict of
    children by letter, with the counter of the term that ends there under the empty string.
    """

    def __init__(self, burst: int = 2048):
        self.burst, self.root, self.terms = burst, _Leaf(), 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        self.graft("", (term,), (occurrences,), (records,))

    def graft(self, prefix: str, rests, occurrences, records) -> None:
        """Merge a subtree: the container of the terms ``prefix + rest``. The prefix is walked once; what is met
        there is a container, and the two are merged, or an inner node, and its children take their parts."""
        node, parent, at = self.root, None, 0
        while at < len(prefix) and isinstance(node, dict):
            parent, letter = node, prefix[at]
            at += 1
            node = parent.get(letter)
            if node is None:
                node = parent[letter] = _Leaf()
        if isinstance(node, dict):  # the prefix ends at an inner node
            for rest, o, r in zip(rests, occurrences, records):
                self._descend(node, rest, o, r)
            return
        counts, more = node.counts, prefix[at:]
        for rest, o, r in zip(rests, occurrences, records):
            rest = more + rest
            count = counts.get(rest)
            if count is None:
                counts[rest] = [o, r]
                self.terms += 1
            else:
                count[0] += o
                count[1] += r
        self._burst(node, parent, prefix[at - 1] if at else "")

    def _descend(self, node: dict, term: str, o: int, r: int) -> None:
        at = 0
        while isinstance(node, dict):
            if at == len(term):
                end = node.get("")
                if end is None:
                    node[""] = [o, r]
                    self.terms += 1
                else:
                    end[0] += o
                    end[1] += r
                return
            parent, letter = node, term[at]
            at += 1
            node = parent.get(letter)
            if node is None:
                node = parent[letter] = _Leaf()
        rest = term[at:]
        count = node.counts.get(rest)
        if count is not None:
            count[0] += o
            count[1] += r
            return
        node.counts[rest] = [o, r]
        self.terms += 1
        self._burst(node, parent, letter)

    def _burst(self, leaf: "_Leaf", parent: dict | None, letter: str) -> None:
        """Split a container until none of its parts is too large."""
        todo = [(leaf, parent, letter)]
        while todo:
            leaf, parent, letter = todo.pop()
            if len(leaf.counts) <= self.burst:
                continue
            inner: dict = {}
            for rest, count in leaf.counts.items():
                if rest:
                    inner.setdefault(rest[0], _Leaf()).counts[rest[1:]] = count
                else:
                    inner[""] = count
            if parent is None:
                self.root = inner
            else:
                parent[letter] = inner
            todo += [(x, inner, c) for c, x in inner.items() if c]

    def leaves(self):
        """(prefix, rests of terms, occurrences, records) per container, in the order of a walk."""
        walk = [("", self.root)]
        while walk:
            prefix, node = walk.pop()
            if isinstance(node, dict):
                if "" in node:
                    yield prefix, [""], [node[""][0]], [node[""][1]]
                walk += [(prefix + c, x) for c, x in node.items() if c]
            elif node.counts:
                yield prefix, list(node.counts), [c[0] for c in node.counts.values()], [c[1] for c in node.counts.values()]

    def weights(self, least: float) -> dict[str, int]:
        """Terms below each prefix of up to DEPTH letters that holds more than ``least``."""
        out: dict[str, int] = {}
        for prefix, rests, *_ in self.leaves():
            for i in range(min(len(prefix), DEPTH) + 1):
                out[prefix[:i]] = out.get(prefix[:i], 0) + len(rests)
            todo = [(prefix, rests)]
            while todo:  # into a container, as far as a part of it may weigh enough
                at, group = todo.pop()
                if len(group) <= least or len(at) >= DEPTH:
                    continue
                by: dict[str, list[str]] = {}
                for r in group:
                    if r:
                        by.setdefault(r[0], []).append(r[1:])
                for c, g in by.items():
                    out[at + c] = len(g)
                    todo.append((at + c, g))
        return {p: n for p, n in out.items() if n > least}


class _Leaf:
    __slots__ = ("counts",)

    def __init__(self):
        self.counts: dict[str, list[int]] = {}


#: Letters up to which a prefix can be split; terms that still share too much are dealt by a hash.
DEPTH = 32
#: Parts of a prefix that is too heavy and cannot be split by letters any more.
PARTS = 64
_LEAF = pa.schema([
    ("kind", pa.string()), ("prefix", pa.string()), ("rest", pa.list_(pa.string())), ("occurrences", pa.list_(pa.int64())),
    ("records", pa.list_(pa.int64())), ("n", pa.int64()),
])
_ROW = "kind string, prefix string, rest array<string>, occurrences array<bigint>, records array<bigint>, n bigint"


def _count(batches, most: int, routes: int):
    trie, filled = BurstTrie(), 0
    for batch in batches:
        occurrences, records = Counter(), Counter()
        for text in batch.column(0).to_pylist():
            found = terms_of(text)
            if found:
                filled += 1
                occurrences.update(found)
                records.update(set(found))
        for term, n in occurrences.items():
            trie.add(term, n, records[term])
        if trie.terms > most:
            yield from _rows(trie, routes)
            trie = BurstTrie()
    yield from _rows(trie, routes)
    yield pa.RecordBatch.from_pylist([{"kind": "filled", "n": filled}], schema=_LEAF)


def _rows(trie: BurstTrie, routes: int):
    """The containers of a trie and the weights of its heavier prefixes."""
    chunk: list[dict] = []
    for prefix, rest, o, r in trie.leaves():
        chunk.append({"kind": "leaf", "prefix": prefix, "rest": rest, "occurrences": o, "records": r})
        if len(chunk) == 64:
            yield pa.RecordBatch.from_pylist(chunk, schema=_LEAF)
            chunk = []
    chunk += [{"kind": "weight", "prefix": p, "n": n} for p, n in trie.weights(trie.terms / routes).items()]
    if chunk:
        yield pa.RecordBatch.from_pylist(chunk, schema=_LEAF)


def route_of(term: str, split: frozenset[str]) -> str:
    """The shortest prefix of a term that is not split; one that cannot be split further, with a part number."""
    at = 0
    while term[:at] in split:
        if at == DEPTH:
            return f"{term[:at]}\0{zlib.crc32(term.encode('utf-8', 'surrogatepass')) % PARTS}"
        if at == len(term):
            break
        at += 1
    return term[:at]


_ROUTED = pa.schema([("route", pa.string()), ("prefix", pa.string()), ("rest", pa.list_(pa.string())), ("occurrences", pa.list_(pa.int64())), ("records", pa.list_(pa.int64()))])


def _route(batches, split: frozenset[str]):
    """Containers with their route; one that reaches over split prefixes is cut."""
    for b in batches:
        rows = []
        for prefix, rest, occ, rec in zip(*(b.column(k).to_pylist() for k in range(4))):
            if prefix not in split:  # then all its terms have one route
                rows.append((route_of(prefix, split), prefix, rest, occ, rec))
                continue
            parts: dict[str, tuple[list, list, list]] = {}
            for t, o, r in zip(rest, occ, rec):
                part = parts.setdefault(route_of(prefix + t, split), ([], [], []))
                part[0].append(t)
                part[1].append(o)
                part[2].append(r)
            rows += [(route, prefix, *part) for route, part in parts.items()]
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ROUTED)], schema=_ROUTED)


def _merge(batches):
    """Terms of each route, from its containers merged in one trie. Rows of a route come one after another."""
    at, trie = None, BurstTrie()
    for b in batches:
        for route, prefix, rest, occ, rec in zip(*(b.column(k).to_pylist() for k in range(5))):
            if route != at:
                yield from _terms(trie)
                at, trie = route, BurstTrie()
            trie.graft(prefix, rest, occ, rec)
    yield from _terms(trie)


def _terms(trie: BurstTrie, most: int = 50_000):
    terms, occ, rec = [], [], []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(occ, pa.int64()), pa.array(rec, pa.int64())], names=["term", "occurrences", "records"])

    for prefix, rests, o, r in trie.leaves():
        terms += [prefix + x for x in rests]
        occ += o
        rec += r
        if len(terms) >= most:
            yield batch()
            terms, occ, rec = [], [], []
    if terms:
        yield batch()


def term_counts(
    texts: DataFrame, column: str = "text", rare: int = 2, common: float = 0.1, trie_terms: int = 400_000, routes: int = 1024, least_route: int = 2048
) -> DataFrame:
    """``term, occurrences, records, mark`` for every distinct term of a text column.

    Each task counts its records in a burst trie, so what is written is one entry per distinct term and task,
    however often a term occurs; a trie with more than ``trie_terms`` terms is handed on and begun anew. A prefix
    with more than a share of 1 / ``routes`` of all entries, and more than ``least_route`` of them, is split by its
    next letter, so a prefix that a third of all terms share is spread like any other, up to DEPTH letters; beyond
    them by a hash. A task drops prefixes below its own share of 1 / ``routes``, hence no route weighs more than
    twice the share. At most ``routes`` prefixes of each length are split: this table is collected. Containers are
    then shuffled by route and merged as subtrees.

    mark is ``rare`` for terms in at most ``rare`` records, else ``common`` for terms in at least ``common`` of the
    records that have any term, else null (rare wins where both hold). Null, empty and blank texts hold no term
    and are not counted as records.
    """
    ws = Workspace(texts.sparkSession, "terms")
    counted = ws.cut(texts.select(F.col(column).cast("string")).mapInArrow(lambda b: _count(b, trie_terms, routes), _ROW))
    leaves = counted.where("kind = 'leaf'")
    total = leaves.agg(F.sum(F.size("rest")).alias("n")).first()["n"] or 0
    heavy = counted.where("kind = 'weight'").groupBy("prefix").agg(F.sum("n").alias("n")).where(F.col("n") > max(total / routes, least_route))
    split = frozenset(heavy.select("prefix").toArrow().column(0).to_pylist())
    counts = (
        leaves.select("prefix", "rest", "occurrences", "records")
        .mapInArrow(lambda b: _route(b, split), "route string, prefix string, rest array<string>, occurrences array<bigint>, records array<bigint>")
        .repartition("route").sortWithinPartitions("route")
        .mapInArrow(_merge, "term string, occurrences bigint, records bigint")
    )
    # One row, by construction.
    filled = counted.where("kind = 'filled'").agg(F.sum("n").alias("filled"))
    return counts.join(F.broadcast(filled), F.lit(True)).select(
        "term", "occurrences", "records",
        F.when(F.col("records") <= rare, "rare").when(F.col("records") >= F.col("filled") * F.lit(common), "common").alias("mark"),
    )
