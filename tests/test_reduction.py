"""Pair sums, ranks and correlations of wide components, against plain sums over pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.layout import deal
from tidegraph.operators import aggregates as A
from tidegraph.operators import dependence as D
from tidegraph.operators import reduce as R

CELL = "series_id string, t long, idx int, component string, x double"


def odd_cells():
    """Missing, NULL and repeated cells, two components of one idx, a NULL position, a NULL key, large means."""
    rng = np.random.default_rng(3)
    rows = []
    for key, size in (("a", 60), ("b", 14), (None, 19)):
        for t in [*range(size), None]:
            for idx in range(1, 6):
                for _ in range(1 + (rng.random() < 0.1)):
                    if rng.random() < 0.9:
                        x = None if rng.random() < 0.1 else float(1e6 * (idx == 2) + rng.integers(0, 9) + idx * rng.standard_normal())
                        rows.append((key, t, None if idx == 5 and rng.random() < 0.3 else idx, f"C_{idx}{'x' * (idx == 4 and (t or 0) % 2)}", x))
    return rows


def by_hand(rows):
    groups = {}
    for ka, ta, ia, ca, xa in rows:
        for kb, tb, ib, cb, xb in rows:
            if ka == kb and ta == tb and ia is not None and ib is not None and ia < ib:
                groups.setdefault((ka, ia, ib, ca, cb), []).append((xa, xb))
    out = {}
    for g, pairs in groups.items():
        both = np.array([p for p in pairs if None not in p], dtype=float).reshape(-1, 2)
        r = np.corrcoef(both.T)[0, 1] if len(both) > 1 else None
        sides = []
        for side in (0, 1):
            v = np.array([p[side] for p in pairs if p[side] is not None])
            sides.append((v.std(), (v**2).sum()) if len(v) else (None, None))
        out[g] = (r, len(pairs), sides[0][0], sides[1][0], sides[0][1], sides[1][1])
    return out


@pytest.mark.parametrize("cells", [17, 1 << 17])
def test_component_pairs(spark, monkeypatch, cells):
    monkeypatch.setattr(A, "CELLS", cells)
    rows = odd_cells()
    got = A.component_pairs(spark.createDataFrame(rows, CELL))
    assert dict(got.dtypes) == {"series_id": "string", "i": "int", "j": "int", "ci": "string", "cj": "string", "r": "double", "n": "bigint", "si": "double", "sj": "double", "ei": "double", "ej": "double"}
    got, want = {tuple(r)[:5]: tuple(r)[5:] for r in got.collect()}, by_hand(rows)
    assert got.keys() == want.keys()
    for g, v in want.items():
        for a, b in zip(got[g], v, strict=True):
            assert a is None if b is None else a == pytest.approx(b, rel=1e-6, abs=1e-7), (g, got[g], v)


def test_component_pairs_not_finite(spark):
    rows = [("a", t, i, f"C_{i}", x) for t, v in enumerate([(1.0, 2.0, math.nan), (2.0, math.inf, 1.0), (4.0, 1.0, 5.0)]) for i, x in enumerate(v, 1)]
    got = {(r.i, r.j): r for r in A.component_pairs(spark.createDataFrame(rows, CELL)).collect()}
    assert all(math.isnan(r.r) for r in got.values())
    assert got[1, 2].ei == pytest.approx(21.0) and got[1, 2].ej == math.inf and math.isnan(got[1, 3].ej) and math.isnan(got[1, 2].sj)


def test_pairs_are_not_rows(spark):
    """64 components make 2016 pairs a position; no operator of the plan may make a row of each."""
    m = spark.range(40).select(F.lit("a").alias("series_id"), F.col("id").alias("t"), F.array(*[F.rand(i) for i in range(64)]).alias("vec"))
    pairs = A.component_pairs(R.as_components(m))
    assert "explode(filter(" not in pairs._jdf.queryExecution().toString()
    assert pairs.count() == 2016


def test_deal(spark):
    rows = spark.createDataFrame([(k, t % 50) for k, n in (("a", 400), (None, 90), ("c", 5)) for t in range(n)], "series_id string, t long")
    got = deal(rows, 20).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_part").alias("parts"), F.count_distinct("t", "_part").alias("whole")).collect()
    got = {r.series_id: (r.n, r.parts, r.whole) for r in got}
    assert got["c"] == (5, 1, 5) and got["a"][0] == 400 and 10 < got["a"][1] <= 20 and got["a"][2] == 50
    assert got[None][0] == 90 and 1 < got[None][1] <= 5 and got[None][2] == 50


def test_ranks_short_and_long(spark):
    """Series of at most a block and longer ones have the same ranks, NULLs, NaN, zeros of both signs and ties included."""
    rng = np.random.default_rng(8)
    odd = [None, None, None, math.nan, math.nan, 0.0, -0.0, 7.0, -3.0]
    rows = [(k, t, odd[t] if t < len(odd) and k == "a" else float(rng.integers(-4, 5))) for k, n in (("a", 60), ("b", 5)) for t in range(n)]
    rows += [("n", t, None) for t in range(4)] + [(None, 1, 2.0)]
    df = spark.createDataFrame(rows, "series_id string, t long, x double")
    short, long = ({(r.series_id, r.t): r.rank for r in D.average_ranks(df, "x", tie="t", block=b).collect()} for b in (1 << 20, 16))
    assert short == long and len(short) == 69
    plan = D.average_ranks(df, "x", tie="t")._jdf.queryExecution().toString()
    assert plan.partition("== Physical Plan ==")[2].count("Exchange hashpartitioning") == 1


def test_pca_is_dealt(spark, monkeypatch):
    """Rows of one key are dealt to groups; NULL vectors and NULL entries count as missing."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 5)) @ rng.standard_normal((5, 5)) + 100
    vecs = [[None if (i, j) in ((3, 1), (9, 4)) else float(v) for j, v in enumerate(row)] for i, row in enumerate(x)]
    rows = [("a", i, v) for i, v in enumerate(vecs)] + [("a", 300, None)]
    m = spark.createDataFrame(rows, "series_id string, t long, vec array<double>")
    monkeypatch.setattr(R, "CELLS", 100)
    z = np.array(vecs, dtype=float)
    z = (z - np.nanmean(z, axis=0)) / np.nanstd(z, axis=0)
    vals = np.sort(np.linalg.eigvalsh([[np.nanmean(z[:, i] * z[:, j]) for j in range(5)] for i in range(5)]))[::-1]
    vals, model = np.maximum(vals, 0.0), R.pca_model(m, 5)
    assert np.allclose(model.first().ratio, vals / vals.sum(), atol=1e-12)
    assert np.allclose(model.first().scale, np.nanstd(np.array(vecs, dtype=float), axis=0))


def test_reduction_report(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((200, 6)) @ rng.standard_normal((6, 6))
    m = spark.createDataFrame([("a", i, [float(v) for v in row]) for i, row in enumerate(x)], "series_id string, t long, vec array<double>")
    got = {r.stage: r for r in R.reduction_report(R.as_components(m), R.as_components(m.withColumn("vec", F.slice("vec", 1, 2)))).collect()}
    up = np.triu_indices(6, 1)
    r, s = np.corrcoef(x.T), np.corrcoef(x.argsort(axis=0).argsort(axis=0).T)
    b, a = got["before"], got["after"]
    assert (b.pairs, a.pairs) == (15, 1)
    assert np.allclose([b.max_abs, b.mean_abs, b.max_spearman], [abs(r[up]).max(), abs(r[up]).mean(), abs(s[up]).max()])
    assert np.allclose([b.frobenius, a.max_abs, a.max_spearman], [math.sqrt(2 * (r[up] ** 2).sum()), abs(r[0, 1]), abs(s[0, 1])])
