import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import F1
from tidegraph import tiles
from tidegraph.operators import graphs as G
from tidegraph.operators import metrics as M


def brute(x):
    h, v = set(), set()
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            mid = range(i + 1, j)
            if all(x[k] < min(x[i], x[j]) for k in mid):
                h.add((i, j))
            if all((x[k] - x[i]) * (j - i) < (x[j] - x[i]) * (k - i) for k in mid):
                v.add((i, j))
    return h, v


@pytest.mark.parametrize("fan,block", [(4, 16), (32, 1 << 20)])
def test_visibility_equals_brute_force(make, fan, block):
    rng = random.Random(2)
    series = {"f1": F1, "f2": [2, 2, 1, 2, 2], "f3": [1, 1, 1, 1], "one": [7], "up": list(range(40)), "down": list(range(40, 0, -1)),
              "bowl": [(i - 20) ** 2 for i in range(41)], "r1": [rng.randrange(6) for _ in range(90)], "r2": [rng.randrange(999) for _ in range(70)]}
    df = make(**series)
    h, v = {k: set() for k in series}, {k: set() for k in series}
    for r in G.horizontal_visibility(df, block=fan).collect():
        h[r.series_id].add((r.src, r.dst))
    for r in G.natural_visibility(df, fan=fan, block=block).collect():
        v[r.series_id].add((r.src, r.dst))
    for k, x in series.items():
        assert (h[k], v[k]) == brute(x), k
        assert len(h[k]) <= max(2 * len(x) - 3, 0)


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(4)
    pts = {"a": rng.standard_normal((150, 3)), "b": np.zeros((30, 3)), "c": rng.integers(0, 3, (60, 3)).astype(float)}
    rows = [(k, i, [float(v) for v in p]) for k, a in pts.items() for i, p in enumerate(a)]
    return pts, spark.createDataFrame(rows, "series_id string, node long, vec array<double>")


@pytest.mark.parametrize("size", [16, 256])
def test_tiles_equal_brute_force(spark, clouds, size):
    pts, df = clouds
    radius = spark.createDataFrame([(k, 0.7) for k in pts], "series_id string, r double")
    pairs = {(r.series_id, frozenset((r.src, r.dst))) for r in tiles.near_pairs(df, radius, size=size).collect()}
    near = {(r.series_id, r.node): (r.other, r.dist) for r in tiles.nearest(df, min_gap=2, size=size).collect()}
    counts = {(r.series_id, r.k): r.pairs for r in tiles.pair_counts(df, radius.select("series_id", F.array(F.lit(0.3), "r").alias("rs")), size=size).collect()}
    want = set()
    for k, a in pts.items():
        d = np.sqrt(((a[:, None] - a[None]) ** 2).sum(-1))
        c = np.abs(a[:, None] - a[None]).max(-1)
        up = np.triu_indices(len(a), 1)
        want |= {(k, frozenset((i, j))) for i, j in zip(*up) if d[i, j] <= 0.7}
        assert counts[k, 0] == (c[up] <= 0.3).sum() and counts[k, 1] == (c[up] <= 0.7).sum()
        gap = np.abs(np.subtract.outer(np.arange(len(a)), np.arange(len(a)))) <= 2
        d[gap] = np.inf
        for i in range(len(a)):
            assert near[k, i][0] == d[i].argmin()
    assert pairs == want


SHAPES = {
    "path": (5, [(0, 1), (1, 2), (2, 3), (3, 4)]), "star": (5, [(0, i) for i in range(1, 5)]), "cycle": (5, [(i, (i + 1) % 5) for i in range(5)]),
    "complete": (4, [(i, j) for i in range(4) for j in range(i)]), "two": (6, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)]), "single": (1, []),
    "f1": (8, sorted(brute(F1)[0])),
}


def test_known_graphs(graph):
    n, e = graph(**SHAPES)
    comp = {r.series_id: r.components for r in M.component_metrics(M.component_labels(n, e)).collect()}
    assert comp == {"path": 1, "star": 1, "cycle": 1, "complete": 1, "two": 2, "single": 1, "f1": 1}
    d = {r.series_id: r.diameter_approx for r in M.two_sweep_diameter(n, e).collect()}
    assert d == {"path": 4, "star": 2, "cycle": 2, "complete": 1, "two": None, "single": 0, "f1": 4}
    c = {(r.series_id, r.node): r.clustering for r in M.clustering(n, e).collect()}
    assert [round(c["f1", i], 6) for i in range(8)] == [0.666667, 1, 0.666667, 0.3, 1, 0.5, 1, 0.666667]
    assert c["complete", 0] == 1 and c["two", 5] == 1 and c["single", 0] == 0
    b = {(r.series_id, r.node): round(r.betweenness, 6) for r in M.betweenness(n, e).collect()}
    assert [b["path", i] for i in range(5)] == [0, 0.5, 0.666667, 0.5, 0]
    assert [b["star", i] for i in range(5)] == [1, 0, 0, 0, 0] and b["cycle", 2] == 0.166667 and b["two", 0] == 0
    assert [b["f1", i] for i in range(8)] == [0.119048, 0, 0.119048, 0.595238, 0, 0.166667, 0, 0.095238]
    cl = {(r.series_id, r.node): round(r.closeness, 6) for r in M.closeness(n, e).collect()}
    assert [cl["f1", i] for i in range(8)] == [0.583333, 0.411765, 0.583333, 0.777778, 0.538462, 0.636364, 0.4375, 0.583333]
    assert cl["single", 0] == 0
    dm = {r.series_id: r for r in M.distance_metrics(n, e).collect()}
    assert (dm["f1"].diameter, dm["f1"].radius, dm["two"].diameter) == (4, 2, 1)
    core = M.largest_component(M.component_labels(n, e))
    ev = {(r.series_id, r.node): r.eigenvector for r in M.eigenvector(core, e.join(core.withColumnRenamed("node", "src"), ["series_id", "src"], "left_semi")).collect()}
    want = [0.317184, 0.193283, 0.317184, 0.53055, 0.295751, 0.440124, 0.247156, 0.371056]
    assert [ev["f1", i] for i in range(8)] == pytest.approx(want, abs=2e-5)


def test_long_path_has_one_component_in_few_rounds(graph):
    n, e = graph(p=(300, [(i, i + 1) for i in range(299)]), q=(200, [(i, i + 2) for i in range(198)]))
    assert {r.series_id: r.components for r in M.component_metrics(M.component_labels(n, e)).collect()} == {"p": 1, "q": 2}


def test_sampled_betweenness_is_close(graph):
    n, e = graph(f1=SHAPES["f1"])
    exact = {r.node: r.betweenness for r in M.betweenness(n, e).collect()}
    part = {r.node: r.betweenness for r in M.betweenness(n, e, M.hash_sample(n, 6)).collect()}
    assert max(abs(exact[k] - part[k]) for k in exact) < 0.3


def test_sample_neighbours_merge_in_levels(spark, monkeypatch):
    monkeypatch.setattr(tiles, "MERGE", 3)
    x = np.random.default_rng(5).normal(size=(90, 2))
    cloud = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "series_id string, node long, vec array<double>")
    found = tiles.sample_neighbours(cloud, cloud.where("node % 9 = 0"), 5, size=4).collect()
    for i in range(0, 90, 9):
        want = np.sort(np.linalg.norm(x - x[i], axis=1))[1:6]
        assert np.allclose(sorted(r.dist for r in found if r.node == i), want)


def plain_hvg(x):
    return {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if all(v < min(x[i], x[j]) for v in x[i + 1 : j])}


@pytest.mark.parametrize("block", [4, 16])
def test_stacks_of_blocks_give_the_same_edges(make, block):
    rng = np.random.default_rng(8)
    series = {
        "noise": rng.normal(size=90).tolist(), "ties": rng.integers(0, 4, 90).tolist(), "rising": list(range(60)), "falling": list(range(60, 0, -1)), "constant": [1] * 40, "one": [5],
        "valley": [*range(40, 0, -1), *range(40)], "peak": [*range(30), *range(30, 0, -1)], "spike": [*range(50, 0, -1), 99], "comb": [i % 7 * (i % 3) for i in range(80)],
    }
    got = {}
    for r in G.horizontal_visibility(make(**series), block=block).collect():
        got.setdefault(r.series_id, []).append((r.src, r.dst))
    for k, x in series.items():
        assert len(got.get(k, [])) == len(set(got.get(k, []))) and set(got.get(k, [])) == plain_hvg(x), k


def test_monotone_series_spreads_over_tasks(spark):
    """Each block of a rising series hands on one point, of a falling one none but its last: rows stay linear and even."""
    n = 200_000
    rows = spark.range(n).select(F.lit("up").alias("series_id"), F.col("id").alias("t"), F.col("id").cast("double").alias("x"))
    rows = rows.unionByName(rows.select(F.lit("down").alias("series_id"), "t", (-F.col("x")).alias("x")))
    blocks = G._stacked_blocks(rows, ["series_id"], 4096)
    sizes = [r.n for r in blocks.select(F.size("src").alias("n")).collect()]
    assert max(sizes) <= 4 * sorted(sizes)[len(sizes) // 2]
    got = G.horizontal_visibility(rows, block=4096).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("dst") - F.col("src")).alias("reach")).collect()
    assert {(r.series_id, r.n, r.reach) for r in got} == {("up", n - 1, 1), ("down", n - 1, 1)}
