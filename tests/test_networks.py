"""Betweenness, strong components and chains against plain versions, on graphs small enough for these."""

from collections import deque

import numpy as np
import pytest

from daybook.operators import graph


def frames(spark, n, links):
    return spark.createDataFrame(links, "source long, target long"), spark.createDataFrame([(i,) for i in range(n)], "id long")


def paths_from(s, links):
    """Distance and number of shortest paths to every node that s reaches."""
    far, number, todo = {s: 0}, {s: 1}, deque([s])
    while todo:
        v = todo.popleft()
        for w in sorted({b for a, b in links if a == v and a != b}):
            if w not in far:
                far[w], number[w] = far[v] + 1, 0
                todo.append(w)
            if far[w] == far[v] + 1:
                number[w] += number[v]
    return far, number


def random_links(n, m, seed):
    rng = np.random.default_rng(seed)
    return [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))]


@pytest.mark.parametrize("n, m, seed", [(12, 25, 1), (14, 18, 2)])
def test_betweenness_counts_shortest_paths(spark, n, m, seed):
    links = random_links(n, m, seed) + [(0, 0), (1, 2), (1, 2)]
    known = {s: paths_from(s, links) for s in range(n)}
    want = dict.fromkeys(range(n), 0.0)
    for s in range(n):
        for t in known[s][0]:
            for v in range(n):
                if v not in (s, t) and s != t and v in known[s][0] and t in known[v][0] and known[s][0][v] + known[v][0][t] == known[s][0][t]:
                    want[v] += known[s][1][v] * known[v][1][t] / known[s][1][t]
    got = {r["id"]: r["score"] for r in graph.betweenness(*frames(spark, n, links)).collect()}
    assert got == {v: pytest.approx(x / ((n - 1) * (n - 2)), abs=1e-6) for v, x in want.items()}
    assert any(got.values())


def test_betweenness_without_edges(spark):
    edges, nodes = frames(spark, 3, [])
    assert {r["score"] for r in graph.betweenness(edges, nodes).collect()} == {0.0}


@pytest.mark.parametrize("n, m, seed", [(15, 20, 3), (12, 9, 5)])
def test_strong_components_and_chains(spark, n, m, seed):
    links = random_links(n, m, seed)
    reach = {s: set(paths_from(s, links)[0]) for s in range(n)}
    part = {v: min(w for w in reach[v] if v in reach[w]) for v in range(n)}
    edges, nodes = frames(spark, n, links)
    got = graph.strong_components(edges, nodes)
    assert {r["id"]: r["component"] for r in got.collect()} == part
    over = {(part[a], part[b]) for a, b in links if part[a] != part[b]}

    def depth(p):
        return 1 + max((depth(b) for a, b in over if a == p), default=0)

    assert graph.longest_chain(edges, got) == max(map(depth, set(part.values())))


def test_strong_components_that_do_not_settle_raise(spark):
    ring = [(i, (i + 1) % 12) for i in range(12)]
    with pytest.raises(RuntimeError):
        graph.strong_components(*frames(spark, 12, ring), limit=3)
