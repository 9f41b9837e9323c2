import random

import numpy as np
import pytest

from graphloom.operators.ways import Ways


def links(pairs):
    return tuple(np.array([p[k] for p in sorted(pairs)], np.int64) for k in (0, 1))


def scores(n, pairs, starts):
    g = Ways(n, *links(pairs), starts)
    v, score = g.scores(*g.walk(g.sources))
    return dict(zip(v.tolist(), score.tolist()))


def brandes(n, pairs, starts):
    adj = [[b if a == v else a for a, b in pairs if v in (a, b)] for v in range(n)]
    total = {}
    for s in np.flatnonzero(starts).tolist():
        dist, ways, order = {s: 0}, {s: 1.0}, [s]
        for u in order:
            for w in adj[u]:
                if w not in dist:
                    dist[w], ways[w] = dist[u] + 1, 0.0
                    order.append(w)
                if dist[w] == dist[u] + 1:
                    ways[w] += ways[u]
        dep = dict.fromkeys(order, 0.0)
        for w in reversed(order[1:]):
            for u in adj[w]:
                if dist[u] + 1 == dist[w]:
                    dep[u] += ways[u] / ways[w] * (1 + dep[w])
            total[w] = total.get(w, 0.0) + dep[w] / 2
    return total


@pytest.mark.parametrize("seed", range(6))
def test_scores_against_walks_from_every_source(seed):
    """Trees, several components, hubs and none; all vertices as sources and some; a score of 0 is 0."""
    rnd = random.Random(seed)
    for k in range(60):
        n = rnd.randint(1, 30)
        hub = lambda: 0 if rnd.random() < 0.2 else rnd.randrange(n)
        pairs = {tuple(sorted(p)) for p in ((hub(), rnd.randrange(n)) for _ in range(int(n * rnd.choice([0.5, 1, 1.3, 2])))) if p[0] != p[1]}
        starts = np.array([k % 2 == 0 or rnd.random() < 0.4 for _ in range(n)])
        got, want = scores(n, pairs, starts), brandes(n, pairs, starts)
        assert got == pytest.approx(want, abs=1e-9) and {v for v in got if got[v] > 0} == {v for v in want if want[v] > 0}


def test_a_walk_ends_where_the_ways_by_the_hub_are_shorter():
    """On a ring around a hub a walk stays near its source; leaves are not walked from at all."""
    n, ring = 4001, range(1, 2001)
    pairs = {(0, v) for v in ring} | {(v, v % 2000 + 1) if v < 2000 else (1, 2000) for v in ring} | {(v, v + 2000) for v in ring}
    g = Ways(n, *links(pairs), np.ones(n, bool))
    inner, out, into = g.walk(g.sources[:1])
    assert len(g.sources) == 2000 and np.count_nonzero(out + into) <= 5
    got = scores(n, pairs, np.ones(n, bool))
    # Every vertex on the ring has a leaf. Of two that are two steps apart, half the ways lead by the one between them.
    apart = 2000 * 1999 // 2
    assert got[0] == pytest.approx(4 * (apart - 2000 - 2000 / 2)) and got[2001] == 0
    assert [got[v] for v in ring] == pytest.approx([n - 2 + 4 / 2] * 2000)


def test_graphs_of_no_vertex_and_no_link():
    none = np.zeros(0, np.int64)
    for n in (0, 3):
        g = Ways(n, none, none, np.ones(n, bool))
        assert len(g.scores(*g.walk(g.sources))[0]) == 0
