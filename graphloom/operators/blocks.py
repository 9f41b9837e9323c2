"""Bridges and articulation points of a graph held as number arrays: a spanning forest by hooking, then the low and high
points of its subtrees (Tarjan and Vishkin). Time is linear in the links but for the rounds of hooking and the levels of
the forest; memory is eight bytes per link and about eighty per vertex."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Fixed value: links looked at together.
CHUNK = 1 << 22


def hooked(n: int, x: np.ndarray, y: np.ndarray, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Labels of the components of vertices 0 to n - 1 under the links (x, y), and which links form a spanning forest.

    In a round, every group hooks onto the smallest group around it, if below its own. A hub takes the least label around
    it in one round and all others hook onto it in the next.
    """
    lab, tree = np.arange(n, dtype=np.int32), np.zeros(len(x), bool)
    chunks = []
    for at in range(0, len(x), CHUNK):
        i = np.arange(at, min(at + CHUNK, len(x)), dtype=np.int32)
        chunks.append(i if use is None else i[use[at : at + CHUNK]])
    while chunks:
        best = np.full(n, np.iinfo(np.int64).max)
        left = []
        for i in chunks:
            p, q = lab[x[i]], lab[y[i]]
            apart = p != q
            i, p, q = i[apart], p[apart], q[apart]
            if len(i):
                np.minimum.at(best, np.maximum(p, q), np.minimum(p, q).astype(np.int64) << 32 | i)
                left.append(i)
        who = np.flatnonzero(best != np.iinfo(np.int64).max)
        tree[best[who] & 0xFFFFFFFF] = True
        lab[who] = best[who] >> 32
        while not np.array_equal(nxt := lab[lab], lab):
            lab = nxt
        chunks = left
    return lab, tree


class Blocks:
    """A rooted spanning forest with ``root``, ``parent`` (-1 at roots), ``size`` of subtrees, ``pre`` (preorder number)
    and ``low``, ``high``: the least and greatest preorder number that the subtree or a link outside the forest from it has.
    """

    def __init__(self, n: int, x: np.ndarray, y: np.ndarray):
        self.n, self.x, self.y = n, x, y
        self.root, self.tree = hooked(n, x, y)
        self._plant()
        self._reach()

    def _plant(self) -> None:
        n, t = self.n, np.flatnonzero(self.tree)
        a, b = np.concatenate([self.x[t], self.y[t]]), np.concatenate([self.y[t], self.x[t]])
        first = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))])
        order = np.argsort(a, kind="stable")
        del a, t
        around = b[order]
        del b, order
        self.parent = np.full(n, -1, np.int32)
        # A label is the number of one vertex of its component, which becomes the root.
        self.levels = [np.flatnonzero(self.root == np.arange(n, dtype=np.int32)).astype(np.int32)]
        while len(front := self.levels[-1]):
            many = first[front + 1] - first[front]
            u = np.repeat(front, many)
            w = around[np.repeat(first[front] - (np.cumsum(many) - many), many) + np.arange(len(u))]
            down = w != self.parent[u]
            w = w[down]
            self.parent[w] = u[down]
            self.levels.append(w)
        self.levels.pop()
        self.size = np.ones(n, np.int32)
        for v in reversed(self.levels[1:]):
            np.add.at(self.size, self.parent[v], self.size[v])
        self.pre = np.zeros(n, np.int32)
        for k, v in enumerate(self.levels):
            before = np.cumsum(self.size[v], dtype=np.int64) - self.size[v]
            if k:  # children of one parent lie together
                p = self.parent[v]
                new = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
                before -= np.repeat(before[new], np.diff(np.concatenate([new, [len(p)]])))
                before += self.pre[p] + 1
            self.pre[v] = before

    def _reach(self) -> None:
        self.low, self.high = self.pre.copy(), self.pre.copy()
        for at in range(0, len(self.x), CHUNK):
            out = ~self.tree[at : at + CHUNK]
            p, q = self.x[at : at + CHUNK][out], self.y[at : at + CHUNK][out]
            for u, w in ((p, q), (q, p)):
                np.minimum.at(self.low, u, self.pre[w])
                np.maximum.at(self.high, u, self.pre[w])
        for v in reversed(self.levels[1:]):
            np.minimum.at(self.low, self.parent[v], self.low[v])
            np.maximum.at(self.high, self.parent[v], self.high[v])

    def _leaves(self, v: np.ndarray, over: np.ndarray) -> np.ndarray:
        """Whether a link outside the forest leads from the subtree of v to beyond the subtree of ``over``."""
        return (self.low[v] < self.pre[over]) | (self.high[v] >= self.pre[over] + self.size[over])

    def bridges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ends of every bridge, and the sizes of the two parts it holds together, the lower end's first."""
        v = np.flatnonzero(self.parent >= 0)
        v = v[~self._leaves(v, v)]
        return v, self.parent[v], self.size[v], self.size[self.root[v]] - self.size[v]

    def articulation_points(self) -> tuple[np.ndarray, np.ndarray]:
        """Vertices whose removal splits their component, and how many parts are left.

        A vertex stands for the forest link to its parent. Two of them are in one block if a link joins subtrees neither of
        which holds the other, or if the lower subtree has a link beyond the upper one; parts are blocks at a vertex.
        """
        same = np.zeros(len(self.x), bool)
        for at in range(0, len(self.x), CHUNK):
            p, q, t = self.x[at : at + CHUNK], self.y[at : at + CHUNK], self.tree[at : at + CHUNK]
            swap = self.pre[p] > self.pre[q]
            p, q = np.where(swap, q, p), np.where(swap, p, q)
            beside = self.pre[q] >= self.pre[p] + self.size[p]
            same[at : at + CHUNK] = np.where(t, (self.parent[p] >= 0) & self._leaves(q, p), beside)
        block, _ = hooked(self.n, self.x, self.y, same)
        c = np.flatnonzero(self.parent >= 0)
        v = self.parent[c]
        other = (block[c] != block[v]) | (self.parent[v] < 0)
        pairs = np.unique(v[other].astype(np.int64) * self.n + block[c[other]])
        v, parts = np.unique(pairs // self.n, return_counts=True) if self.n else (pairs, pairs)
        parts = parts + (self.parent[v] >= 0)
        return v[parts > 1], parts[parts > 1]


def gathered(batches: Iterator, n: int, m: int) -> Blocks:
    """The graph of record batches of m links (x, y)."""
    x, y, at = np.empty(m, np.int32), np.empty(m, np.int32), 0
    for b in batches:
        x[at : at + b.num_rows], y[at : at + b.num_rows] = b.column(0).to_numpy(), b.column(1).to_numpy()
        at += b.num_rows
    return Blocks(n, x[:at], y[:at])
