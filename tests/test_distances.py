"""Distances and betweenness on graphs of many shapes against plain searches."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tidegraph.operators import distances as D
from tidegraph.operators import metrics as M


def search(n, edges, s):
    near = [[] for _ in range(n)]
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    d, q = {s: 0}, deque([s])
    while q:
        u = q.popleft()
        for v in near[u]:
            if v not in d:
                d[v] = d[u] + 1
                q.append(v)
    return d


def plain_betweenness(n, edges):
    """Brandes, halved nothing: every ordered pair, normalised by (n - 1)(n - 2)."""
    near = [[] for _ in range(n)]
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    out = [0.0] * n
    for s in range(n):
        d, sigma, order, q = {s: 0}, [0] * n, [], deque([s])
        sigma[s] = 1
        while q:
            u = q.popleft()
            order.append(u)
            for v in near[u]:
                if v not in d:
                    d[v] = d[u] + 1
                    q.append(v)
                if d[v] == d[u] + 1:
                    sigma[v] += sigma[u]
        delta = [0.0] * n
        for v in reversed(order):
            for u in near[v]:
                if d[u] == d[v] - 1:
                    delta[u] += sigma[u] / sigma[v] * (1 + delta[v])
            if v != s:
                out[v] += delta[v]
    return [x / ((n - 1) * (n - 2)) if n > 2 else 0.0 for x in out]


def grid(w, h):
    return w * h, [(y * w + x, y * w + x + 1) for y in range(h) for x in range(w - 1)] + [(y * w + x, y * w + w + x) for y in range(h - 1) for x in range(w)]


def shapes():
    rng = random.Random(3)
    tree = [(i, rng.randrange(max(0, i - 6), i)) for i in range(1, 60)]
    ladder = [(2 * i, 2 * i + 1) for i in range(14)] + [(2 * i, 2 * i + 2) for i in range(13)] + [(2 * i + 1, 2 * i + 3) for i in range(13)]
    clique = [(i, j) for i in range(6) for j in range(i)]
    lollipop = clique + [(i, i + 1) for i in range(5, 30)]
    subdivided = []  # a dense graph whose edges are chains of different lengths
    n = 6
    for i in range(6):
        for j in range(i):
            last = i
            for _ in range(rng.randrange(1, 5)):
                subdivided.append((last, n))
                last, n = n, n + 1
            subdivided.append((last, j))
    loose = [(i, i + 1) for i in range(19)] + [(i, i + 1) for i in range(21, 29)]  # two paths and a node alone
    return {
        "path": (40, [(i, i + 1) for i in range(39)]), "cycle": (30, [(i, (i + 1) % 30) for i in range(30)]), "tree": (60, tree), "ladder": (28, ladder), "star": (40, [(0, i) for i in range(1, 40)]),
        "lollipop": (31, lollipop), "subdivided": (n, subdivided), "loose": (30, loose), "grid": grid(8, 3), "dense": (40, [(i, j) for i in range(40) for j in range(i) if rng.random() < 0.2]), "one": (1, []), "none": (5, []),
    }


@pytest.mark.parametrize("patience", [0])
def test_distances_equal_plain(graph, patience):
    all_shapes = shapes()
    n, e = graph(**all_shapes)
    found = D.Distances(n, e, patience=patience)
    assert found.vectors is not None
    sums = {(r.series_id, r.node): (r.reached, r.total, r.far) for r in found.sums().collect()}
    counts = {}
    for r in found.counts().collect():
        counts.setdefault((r.series_id, r.source), {})[r.d] = r.cnt
    for k, (size, edges) in all_shapes.items():
        for s in range(size):
            d = [x for x in search(size, edges, s).values() if x]
            assert sums[k, s] == (len(d), sum(d), max(d, default=0)), (k, s)
            assert counts.get((k, s), {}) == {x: d.count(x) for x in set(d)}, (k, s)


def test_distances_from_listed_sources(graph):
    all_shapes = {k: v for k, v in shapes().items() if k in ("path", "lollipop", "subdivided", "dense", "loose")}
    n, e = graph(**all_shapes)
    some = n.where("node % 23 = 1")
    found = D.Distances(n, e, some, patience=4)
    pairs = {}
    for r in found.pairs().collect():
        pairs.setdefault((r.series_id, r.source), {})[r.node] = r.d
    sums = {(r.series_id, r.node): (r.reached, r.total, r.far) for r in found.sums().collect()}
    assert set(pairs) == {(k, s) for k, (size, _) in all_shapes.items() for s in range(1, size, 23)} == set(sums)
    for (k, s), got in pairs.items():
        want = search(*all_shapes[k], s)
        assert got == want and sums[k, s] == (len(want) - 1, sum(want.values()), max(want.values()))


@pytest.mark.parametrize("at_once", [1, 1 << 22])
def test_betweenness_equals_plain(graph, at_once):
    some = {k: v for k, v in shapes().items() if k in (("dense", "one") if at_once == 1 else ("star", "subdivided", "grid", "none"))}
    n, e = graph(**some)
    got = {(r.series_id, r.node): r.betweenness for r in M.betweenness(n, e, at_once=at_once).collect()}
    for k, (size, edges) in some.items():
        assert [got[k, i] for i in range(size)] == pytest.approx(plain_betweenness(size, edges), abs=1e-12), k


def test_long_graph_takes_few_jobs(spark):
    """10,000 nodes, diameter above 500: jobs grow with the logarithm, not with the diameter."""
    size = 10_000
    nodes = spark.range(size).select(F.lit("a").alias("series_id"), F.col("id").alias("node"))
    step = spark.range(size - 1).select(F.lit("a").alias("series_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    rungs = spark.range(size // 16 - 1).select(F.lit("a").alias("series_id"), (F.col("id") * 16).alias("src"), (F.col("id") * 16 + 16).alias("dst"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("long", "distances")
    ends = nodes.where(f"node IN (0, 5000, {size - 1})")
    got = {r.node: (r.reached, r.far) for r in D.Distances(nodes, step.unionByName(rungs), ends).sums().collect()}
    jobs = len(tracker.getJobIdsForGroup("long"))
    spark.sparkContext.setJobGroup("rest", "others")
    far = {s: max(search(size, [(i, i + 1) for i in range(size - 1)] + [(i * 16, i * 16 + 16) for i in range(size // 16 - 1)], s).values()) for s in got}
    assert far[0] > 500 and got == {s: (size - 1, far[s]) for s in got}
    assert jobs < far[0], jobs
