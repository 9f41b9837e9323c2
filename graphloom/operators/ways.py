"""Betweenness of a graph held as number arrays, exact, without walking the whole graph from every source.

Trees that hang on the rest are worked out by their sizes. Then every component has a hub, its vertex of most links. A pair
whose ways lead through the hub needs no walk: its ways are those of one end to the hub times those of the other end. So a
source is walked only over the vertices that it reaches at least as fast without the hub (Brandes), and what the walks
leave over goes along the ways to the hub in one pass. In the worst case a walk is over the whole component.
"""

from __future__ import annotations

import numpy as np

from .blocks import hooked

#: Sources walked together at most, and entries of the tables that tell what they have reached.
TOGETHER, REACHED = 64, 1 << 21


def _arcs(n: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the neighbours of every vertex begin, and the neighbours, of undirected links."""
    a, b = np.concatenate([x, y]), np.concatenate([y, x])
    return np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]), b[np.argsort(a, kind="stable")].astype(np.int32)


def _around(first: np.ndarray, around: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``v`` and the neighbours there, link by link."""
    many = first[v + 1] - first[v]
    i = np.repeat(np.arange(len(v)), many)
    return i, around[np.repeat(first[v] - (np.cumsum(many) - many), many) + np.arange(len(i))]


def _put(sums: np.ndarray, at: np.ndarray, more: np.ndarray) -> None:
    if len(at) * 8 < len(sums):
        np.add.at(sums, at, more)
    else:
        sums += np.bincount(at, more, len(sums))


class Ways:
    """Vertices 0 to n - 1 under distinct links (x, y); ``starts`` tells which are sources.

    ``a`` and ``w`` count sources and vertices of a vertex and the trees on it, ``d`` and ``ways`` are steps and numbers of
    shortest ways to the hub.
    """

    def __init__(self, n: int, x: np.ndarray, y: np.ndarray, starts: np.ndarray):
        self.n = n
        self.lab, _ = hooked(n, x, y)
        self.start = starts.astype(np.int64)
        total = lambda v: np.bincount(self.lab, v, n).astype(np.int64)[self.lab]
        self.all_a, self.all_w = total(self.start), total(np.ones(n))
        gone = self._peel(x, y)
        core = ~gone[x] & ~gone[y]
        x, y = x[core], y[core]
        self._measure(x, y, gone)
        off = ~self.hub[x] & ~self.hub[y]
        self.at = np.flatnonzero(~gone & ~self.hub)
        self.at = self.at[np.argsort(self.d[self.at], kind="stable")]
        self.walk = Walk(self.at, self.d, self.ways, self.a, self.w, x[off], y[off], bool(starts.all()))
        self.sources = np.flatnonzero(self.walk.a)

    def _peel(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = self.n
        self.a, self.w, self.inner = self.start.copy(), np.ones(n, np.int64), np.zeros(n, np.int64)
        gone, deg, link = np.zeros(n, bool), np.bincount(x, minlength=n) + np.bincount(y, minlength=n), np.zeros(n, np.int64)
        np.bitwise_xor.at(link, x, y.astype(np.int64))
        np.bitwise_xor.at(link, y, x.astype(np.int64))
        leaf = np.flatnonzero(deg == 1)
        while len(leaf):
            leaf = leaf[(deg[link[leaf]] > 1) | (link[leaf] < leaf)]  # of two that hang on each other one stays
            p = link[leaf]
            gone[leaf], deg[leaf] = True, 0
            np.subtract.at(deg, p, 1)
            np.bitwise_xor.at(link, p, leaf)
            for sums, more in ((self.inner, self.a[leaf] * self.w[leaf]), (self.a, self.a[leaf]), (self.w, self.w[leaf])):
                np.add.at(sums, p, more)
            p = np.unique(p)
            leaf = p[deg[p] == 1]
        return gone

    def _measure(self, x: np.ndarray, y: np.ndarray, gone: np.ndarray) -> None:
        n = self.n
        first, around = _arcs(n, x, y)
        best = np.lexsort((-np.diff(first), gone, self.lab))
        front = best[np.concatenate([[True], np.diff(self.lab[best]) != 0])] if n else best
        self.hub, self.d, self.ways = np.zeros(n, bool), np.full(n, -1, np.int32), np.zeros(n)
        self.hub[front], self.d[front], self.ways[front], self.levels = True, 0, 1, []
        while len(front):
            i, t = _around(first, around, front)
            back, new = (self.d[t] == len(self.levels) - 1) & (self.d[t] >= 0), self.d[t] < 0
            self.levels.append((front, front[i[back]], t[back]))
            i, t = i[new], t[new]
            _put(self.ways, t, self.ways[front[i]])
            front = np.unique(t)
            self.d[front] = len(self.levels)

    def _spread(self, sums: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        out[self.at] = sums
        return out

    def scores(self, inner: np.ndarray, out: np.ndarray, into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vertices that a source reaches and their betweenness, pairs counted by half from each end, from the sums of
        :class:`Walk` over all sources."""
        inner, out, into = (self._spread(c) for c in (inner, out, into))
        to, of = self.all_w - self.w - out, self.all_a - self.a - into
        total = (self.all_a - self.start) * (self.all_w - 1) - self.inner - (self.all_a - self.a) * (self.all_w - self.w) + inner
        at_hub = np.flatnonzero(self.hub)
        hub = np.zeros(self.n, np.int64)
        hub[self.lab[at_hub]] = self.w[at_hub]
        s = self.at
        through = np.bincount(self.lab[s], self.a[s] * (to[s] - hub[self.lab[s]]), self.n)
        total[at_hub] += through[self.lab[at_hub]]
        own = self.a * to + self.w * of
        flow = np.zeros(self.n)
        for front, u, t in reversed(self.levels[1:]):
            total[front] += flow[front]
            _put(flow, t, (own[u] + flow[u]) * (self.ways[t] / self.ways[u]))
        v = np.flatnonzero(self.all_a > self.start)
        return v, total[v] / 2


class Walk:
    """The vertices of a graph that are neither on trees nor hubs, nearest to the hub first. Neighbours farther from the hub
    come first; ``ends`` has by vertex where its neighbours begin, where those no farther and those nearer do, and the end.

    With ``half``, all are sources, and a walk finds only the pairs with vertices no farther from the hub than its source:
    those nearer are taken for both ends, those as far for the source alone.
    """

    def __init__(self, at: np.ndarray, d: np.ndarray, ways: np.ndarray, a: np.ndarray, w: np.ndarray, x: np.ndarray, y: np.ndarray, half: bool):
        n = len(at)
        place = np.empty(len(d), np.int64)
        place[at] = np.arange(n)
        self.d, self.ways, self.a, self.w, self.half = d[at].astype(np.int64), ways[at], a[at].astype(float), w[at].astype(float), half
        x, y = place[x], place[y]
        u, t = np.concatenate([x, y]), np.concatenate([y, x])
        order = np.lexsort((-self.d[t], u))
        u, self.around = u[order], t[order]
        up = self.d[self.around] - self.d[u]
        count = lambda ok: np.bincount(u[ok], minlength=n)
        begin = np.cumsum(np.concatenate([[0], count(up >= -1)]))[:-1]
        self.ends = np.concatenate([begin, begin + count(up > 0), begin + count(up >= 0), begin + count(up >= -1)])

    def __call__(self, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By vertex, over the ways from these sources that are shortest and miss the hub: what leans on it as an inner
        vertex, and how much of its pairs as a source and as a target they take from the hub."""
        n, d = len(self.d), self.d
        inner, out, into = np.zeros(n), np.zeros(n), np.zeros(n)
        b = max(1, min(TOGETHER, REACHED // max(n, 1)))
        fresh, slot = np.ones(b * n, bool), np.empty(b * n, np.int32)
        for at in range(0, len(sources), b):
            s = sources[at : at + b]
            code = np.arange(len(s)) * n + s
            row, v, ways, ds = np.arange(len(s)), s, np.ones(len(s)), d[s]
            fresh[code] = False
            levels, steps = [], []
            while len(v):
                levels.append((code, row, v, ways, ds))
                # The step to come may lead to a vertex no farther than by the hub, and with half, one from which a vertex
                # no farther from the hub than the source can still be reached so.
                left, x = 2 * ds - len(levels), d[v] - ds
                end = np.minimum(np.maximum(x + left + 2, 1), 3)
                if self.half:
                    begin = self.ends[np.minimum(np.maximum(x - left + 1, 0), 2) * n + v]
                    many = np.maximum(self.ends[end * n + v] - begin, 0)
                else:
                    begin = self.ends[v]
                    many = self.ends[end * n + v] - begin
                i = np.repeat(np.arange(len(v)), many)
                t = self.around[np.repeat(begin - np.cumsum(many) + many, many) + np.arange(len(i))]
                code = (code - v)[i] + t
                ok = np.flatnonzero(fresh[code])
                i, code = i[ok], code[ok]
                k = np.arange(len(code))
                slot[code] = k
                first = np.flatnonzero(slot[code] == k)
                new = code[first]
                slot[new] = k[: len(new)]
                j = slot[code]
                ways = np.bincount(j, ways[i], len(new))
                fresh[new] = False
                code, v, row = new, t[ok[first]], row[i[first]]
                ds = d[s][row]
                steps.append((i, j))
            more, found = None, []
            for k in range(len(levels) - 1, 0, -1):
                code, row, v, ways, ds = levels[k]
                fresh[code] = True
                dv, take = d[v], np.ones(len(v))
                tie = np.flatnonzero(ds + dv == k)
                by = self.ways[s[row[tie]]] * self.ways[v[tie]]
                take[tie] = ways[tie] / (ways[tie] + by)
                give = self.w[v] * take
                back = self.a[s][row]
                if self.half:
                    both = np.sign(ds - dv) + 1
                    np.add.at(out, s, np.bincount(row, give * (both > 0), len(s)))
                    take *= both > 1
                    give *= both
                else:
                    np.add.at(out, s, np.bincount(row, give, len(s)))
                give /= ways
                found.append((v, back * ways * more if more is not None else np.zeros(len(v)), back * take))
                if more is not None:
                    give += more
                i, j = steps[k - 1]
                more = np.bincount(i, give[j], len(levels[k - 1][1]))
            fresh[levels[0][0]] = True
            if found:
                v, part, take = map(np.concatenate, zip(*found))
                _put(inner, v, part)
                _put(into, v, take)
        return (inner, out + into, out + into) if self.half else (inner, out, into)
