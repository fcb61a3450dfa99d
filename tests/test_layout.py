import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph import layout
from tidegraph.core import cut
from tidegraph.layout import attach, ordered_position, over_time, quantiles, scan, summarise
from tidegraph.operators import windows as W


@pytest.fixture(scope="module")
def walk(make):
    rng = random.Random(3)
    return make(a=[rng.randrange(50) for _ in range(300)], b=[rng.randrange(5) for _ in range(37)], c=[1.0])


def test_position_is_dense_and_ordered(spark, walk):
    p = ordered_position(walk.drop("t"), ["x"], name="pos").toPandas()
    for _, g in p.groupby("series_id"):
        g = g.sort_values("pos")
        assert list(g.pos) == list(range(len(g)))
        assert g.x.is_monotonic_increasing


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_position_does_not_depend_on_partitions(spark, walk, partitions):
    p = ordered_position(walk.repartition(partitions), ["x", "t"], name="pos")
    got = {(r.series_id, r.t): r.pos for r in p.collect()}
    rows = walk.toPandas().sort_values(["series_id", "x", "t"])
    for k, g in rows.groupby("series_id"):
        for i, t in enumerate(g.t):
            assert got[k, t] == i


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_blocks_with_halo_equal_one_window(walk, block):
    out = over_time(
        walk, lambda w: {"s": F.sum("x").over(w.rowsBetween(-4, 2)), "l": F.lag("x", 3).over(w)}, before=4, after=2, block=block
    ).toPandas()
    assert len(out) == walk.count()
    for _, g in out.groupby("series_id"):
        x = g.sort_values("t").x.to_numpy()
        s = [x[max(0, i - 4) : i + 3].sum() for i in range(len(x))]
        assert np.allclose(g.sort_values("t").s, s)


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("exclusive", [False, True])
@pytest.mark.parametrize("block,rows", [(5, None), (64, None), (1 << 20, 300)])
def test_scan(walk, reverse, exclusive, block, rows):
    out = scan(walk, {"s": ("sum", F.col("x")), "m": ("max", F.col("x"))}, block=block, rows=rows, reverse=reverse, exclusive=exclusive).toPandas()
    for _, g in out.groupby("series_id"):
        g = g.sort_values("t", ascending=not reverse)
        x = g.x.to_numpy()
        n = 1 if exclusive else 0
        for i, (s, m) in enumerate(zip(g.s, g.m)):
            part = x[: i + 1 - n]
            assert (np.nan_to_num(s) == part.sum()) and (np.isnan(m) if not len(part) else m == part.max())


def test_attach_splits_long_keys(walk):
    s = summarise(walk, F.avg("x").alias("m"))
    assert attach(walk, s, chunk=10).count() == walk.count()
    assert attach(walk, s, chunk=10).select("series_id", "m").distinct().count() == 3


def test_quantiles(walk):
    got = {r.series_id: r for r in quantiles(walk, "x", [0.1, 0.5, 0.9]).collect()}
    for k, g in walk.toPandas().groupby("series_id"):
        assert np.allclose([got[k].q10, got[k].q50, got[k].q90], np.percentile(g.x, [10, 50, 90]))


def test_quantiles_with_a_value_that_most_rows_share(make):
    values = {"a": [3.0] * 800 + list(range(200)), "b": [1, 5], "c": [2.0] * 50}
    got = {r.series_id: r for r in quantiles(make(**values), "x", [0.05, 0.5, 0.95]).collect()}
    for k, x in values.items():
        assert np.allclose([got[k].q5, got[k].q50, got[k].q95], np.percentile(x, [5, 50, 95]))


def test_random_windows_do_not_depend_on_blocks(make, monkeypatch):
    df = make(a=list(range(300)), b=[1, 2])
    whole = {tuple(r) for r in W.random_windows(df, 9, 2, seed=3).collect()}
    monkeypatch.setattr(W, "BLOCK", 4)
    assert whole == {tuple(r) for r in W.random_windows(df, 9, 2, seed=3).collect()}
    assert len(whole) == 302


def test_long_plateau_counts_once_in_small_blocks(make):
    df = make(p=[0, 2, 2, 2, 0, 1, 0], q=[0] + [5] * 40 + [1, 3, 3])
    for block in (3, 1 << 20):
        got = {(r.series_id, r.t) for r in W.local_maxima(df, block=block).collect()}
        assert got == {("p", 2), ("p", 5), ("q", 20)}


def test_affine_scan_equals_a_loop(spark):
    rng = np.random.default_rng(6)
    rows = [(k, t, float(a), float(m)) for k, n in (("a", 37), ("b", 1), ("c", 64)) for t, (a, m) in enumerate(rng.uniform(-1, 1, (n, 2)))]
    df = spark.createDataFrame(rows, "series_id string, t long, add double, mul double")
    got = {(r.series_id, r.t): (r.add, r["mul"]) for r in layout.affine_scan(df, "add", "mul", rows=64).collect()}
    for key in "abc":
        add, mul = 0.0, 1.0
        for k, t, a, m in rows:
            if k == key:
                add, mul = a + m * add, m * mul
                assert np.allclose(got[k, t], (add, mul), atol=1e-12)


def test_spread_join_deals_hot_keys(spark):
    """Nine rows of ten under one key: as many rows as a plain join, no part with more than a few of them."""
    left = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    got = layout.spread_join(left, right, ["k"], "n")
    assert got.columns == ["k", "v", "s"] and got.count() == 20_000 and got.select("v").distinct().count() == 20_000
    assert got.where("k = 0").select("s").distinct().count() == 1
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_tables_are_sized_by_their_rows(spark):
    """Two million rows of sorted keys are a few hundred kB of files; no join may take that for their size."""
    rows = spark.range(1 << 21).select(F.floor(F.col("id") / 64).cast("string").alias("series_id"), (F.col("id") % 64).alias("node"))
    labels, core = cut(rows.withColumn("label", F.lit(0).cast("long"))), cut(rows.where("node < 32"))
    few = cut(rows.where("series_id < 3").select("series_id").distinct())
    both = labels.join(core, ["series_id", "node"], "left_semi")
    assert "BroadcastHashJoin" not in plan_of(both)
    assert "BroadcastHashJoin" in plan_of(labels.join(few, ["series_id"], "left_semi"))
    assert both.count() == 1 << 20
    assert labels.unionByName(labels).groupBy("label").count().first()["count"] == 1 << 22
