"""Descriptive statistics of series and components, and decomposition quality."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidegraph.core import KEYS, ship
from tidegraph.functions.closed import t_critical
from tidegraph.layout import BLOCK, attach, deal, over_time, quantiles, ranked_values, spread_join
from tidegraph.operators.shape import RESIDUAL
from tidegraph.operators.windows import change_columns, local_maxima, rolling

CKEYS = ("series_id", "component")
CELLS = 1 << 17


def price_summary(df: DataFrame, width: int = 30, *, keys=KEYS, t="t", x="x", ts="ts", block=BLOCK) -> DataFrame:
    """AGG-1: size, span, range, total return, daily return and rolling volatility of returns."""
    r = change_columns(df, keys=keys, t=t, x=x, block=block)
    v = over_time(
        r,
        lambda w: {
            "_vol": F.when(
                F.count("ret").over(w.rowsBetween(-(width - 1), 0)) == width,
                F.stddev_samp("ret").over(w.rowsBetween(-(width - 1), 0)),
            )
        },
        keys=keys, t=t, before=width - 1, block=block,
    )
    g = v.groupBy(*keys).agg(
        F.count(x).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.min(x).alias("min_x"), F.max(x).alias("max_x"),
        F.min_by(x, t).alias("_a"), F.max_by(x, t).alias("_b"),
        F.avg("ret").alias("ret_mean"), F.stddev_samp("ret").alias("ret_std"),
        F.avg("_vol").alias("vol_mean"), F.max("_vol").alias("vol_max"),
    )
    return g.withColumn("total_return", (F.try_divide("_b", "_a") - 1) * 100).drop("_a", "_b")


def yearly_returns(df: DataFrame, *, keys=KEYS, t="t", x="x", ts="ts", block=BLOCK) -> DataFrame:
    """AGG-2: mean, standard deviation and sum of simple returns by year."""
    r = change_columns(df, keys=keys, t=t, x=x, block=block).where(F.col("ret").isNotNull())
    return r.groupBy(*keys, F.year(ts).alias("year")).agg(
        F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"), F.sum("ret").alias("sum")
    )


def event_summary(df: DataFrame, cols: Sequence[str], *, keys=KEYS) -> DataFrame:
    """AGG-3: of event-like columns (mostly 0): how many, sum, mean where positive, maximum."""
    aggs = []
    for c in cols:
        pos = F.when(F.col(c) > 0, F.col(c))
        aggs += [F.count(pos).alias(f"{c}_count"), F.sum(c).alias(f"{c}_sum"), F.avg(pos).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max")]
    return df.groupBy(*keys).agg(*aggs)


def describe(df: DataFrame, x="x", *, keys=KEYS) -> DataFrame:
    """AGG-4: count, mean, sample std, min, exact quartiles, max."""
    base = df.groupBy(*keys).agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"),
    )
    return base.join(quantiles(df, x, [0.25, 0.5, 0.75], keys=keys), list(keys))


def moments(df: DataFrame, x="x", *, keys=KEYS) -> DataFrame:
    """AGG-5, AGG-6: bias-corrected skewness and excess kurtosis, Jarque-Bera on population moments."""
    g = df.groupBy(*keys).agg(F.count(x).alias("n"), F.skewness(x).alias("_g1"), F.kurtosis(x).alias("_g2"))
    n, g1, g2 = F.col("n"), F.col("_g1"), F.col("_g2")
    jb = n / 6.0 * (g1 * g1 + g2 * g2 / 4.0)
    return g.select(
        *keys, "n",
        F.when(n > 2, g1 * F.sqrt(n * (n - 1.0)) / (n - 2)).alias("skew"),
        F.when(n > 3, (n - 1) / ((n - 2.0) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurtosis"),
        jb.alias("jb"), F.exp(-jb / 2).alias("jb_p"), (F.exp(-jb / 2) > 0.05).alias("normal"),
    )


def component_metrics(comps: DataFrame, *, keys=CKEYS, t="t", x="x", block=BLOCK, rows: int | None = None) -> DataFrame:
    """AGG-7: energy, sample variance, number of cycles (local maxima), mean absolute value."""
    base = comps.groupBy(*keys).agg(
        F.sum(F.col(x) * F.col(x)).alias("energy"), F.var_samp(x).alias("variance"), F.avg(F.abs(F.col(x))).alias("amplitude")
    )
    peaks = local_maxima(comps.select(*keys, t, x), keys=keys, t=t, x=x, block=block, rows=rows)
    cycles = peaks.groupBy(*keys).agg(F.count(F.lit(1)).alias("cycles"))
    return base.join(cycles, list(keys), "left").na.fill(0, ["cycles"])


def variance_fraction(comps: DataFrame, series: DataFrame, *, keys=KEYS, x="x") -> DataFrame:
    """AGG-8: population variance of a component over that of its series."""
    a = comps.groupBy(*keys, "component").agg(F.var_pop(x).alias("_c"))
    b = series.groupBy(*keys).agg(F.var_pop(x).alias("_x"))
    return a.join(b, list(keys)).select(*keys, "component", F.try_divide("_c", "_x").alias("fraction"))


def _is_res() -> Column:
    return F.col("component") == RESIDUAL


def _by_time(comps: DataFrame, keys, t="t", **sums: Column) -> DataFrame:
    """Conditional sums over the components of each position."""
    return comps.groupBy(*keys, t).agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def quality(comps: DataFrame, series: DataFrame, *, keys=("series_id", "method"), skeys=KEYS, t="t", alpha_pairs=True, most: int | None = None) -> DataFrame:
    """AGG-9: modes, relative RMSE, share of IMF_1 and of the residual, pair correlation (AGG-10).

    Pairs are those of all components, or of the first ``most``. Shares use population variances: IMF_1 over the series, residual over the sum of all components.
    """
    total = _by_time(comps, keys, t, _sum=F.col("x"))
    fit = total.join(series.select(*skeys, t, F.col("x").alias("_x")), [*skeys, t])
    err = fit.groupBy(*keys).agg(
        F.sum((F.col("_sum") - F.col("_x")) ** 2).alias("_e"), F.sum(F.col("_x") ** 2).alias("_xx"),
        F.var_pop("_x").alias("_var"),
    )
    spread = comps.groupBy(*keys, "component").agg(F.var_pop("x").alias("_v"))
    energy = spread.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("modes"),
        F.sum("_v").alias("_all"),
        F.coalesce(F.sum(F.when(_is_res(), F.col("_v"))), F.lit(0.0)).alias("_res"),
        F.coalesce(F.sum(F.when(F.col("component") == "IMF_1", F.col("_v"))), F.lit(0.0)).alias("_imf1"),
    )
    out = err.join(energy, list(keys)).select(
        *keys, "modes",
        (F.sqrt("_e") / (F.sqrt("_xx") + 1e-15)).alias("rel_rmse"),
        (F.col("_imf1") / (F.col("_var") + 1e-15)).alias("imf1_share"),
        (F.col("_res") / (F.col("_all") + 1e-15)).alias("residual_share"),
    )
    if alpha_pairs:
        pairs = pair_correlation(comps.where(~_is_res() & (F.lit(True) if most is None else F.col("idx") <= most)), keys=keys, t=t)
        out = out.join(pairs, list(keys), "left").na.fill(0, ["pair_corr", "n_pairs"])
    return out


def _pair_sums(cells: pa.Table, keys: Sequence[str]) -> pa.Table:
    """Sums over pairs of cells at the same position, for every pair of components i < j of one group of cells.

    Cells are counted and added up by position and component (a component may be missing or come several times at a
    position); products of these tables give the sums over pairs. Values are taken from a centre of each component.
    Names: x, y over pairs with both values; a, b over pairs with a value on that side.
    """
    codes = lambda c: cells[c].combine_chunks().dictionary_encode("encode")
    at, names = codes("_t").indices.to_numpy(), codes("component")
    idx, col = np.unique(cells["idx"].to_numpy(), return_inverse=True)
    cols, col = np.unique(col * len(names.dictionary) + names.indices.to_numpy(), return_inverse=True)
    idx, names = idx[cols // len(names.dictionary)], names.dictionary.take(pa.array(cols % len(names.dictionary)))
    m, p = int(at.max()) + 1, len(cols)
    given = ~cells["_x"].is_null().to_numpy()
    x = cells["_x"].fill_null(0.0).to_numpy()
    use = given & np.isfinite(x)
    centre = np.zeros(p)
    centre[col[use][::-1]] = x[use][::-1]  # a constant is its own centre: its spread is exactly 0
    x = np.where(use, x, centre[col])
    gap = np.bincount(col, x - centre[col], p) / np.maximum(np.bincount(col[use], minlength=p), 1)
    x = x - centre[col] - np.where(use, gap[col], 0.0)
    centre = centre + gap
    table = lambda v: np.bincount(at * p + col, v, m * p).reshape(m, p)
    rows, has, s, q = table(np.ones(len(x))), table(given.astype(float)), table(x), table(x * x)
    i, j = np.nonzero((idx[:, None] < idx) & (rows.T @ rows > 0))
    over = lambda u, v: (u.T @ v)[i, j]
    sums = {}
    for side, of, n, sx, qx in (
        ("x", i, over(has, has), over(s, has), over(q, has)), ("y", j, over(has, has), over(has, s), over(has, q)),
        ("a", i, over(has, rows), over(s, rows), over(q, rows)), ("b", j, over(rows, has), over(rows, s), over(rows, q)),
    ):
        mean = sx / np.maximum(n, 1)
        sums |= {f"n{side}": n, f"m{side}": centre[of] + mean, f"v{side}": np.maximum(qx - sx * mean, 0.0), f"e{side}": qx + 2 * centre[of] * sx + centre[of] ** 2 * n}
    sums["c"] = over(s, s) - over(s, has) * over(has, s) / np.maximum(sums["nx"], 1)
    if not use[given].all():
        nan, odd = (table(given & v) for v in (np.isnan(cells["_x"].fill_null(0.0).to_numpy()), ~use))
        sums["c"][over(odd, has) + over(has, odd) > 0] = np.nan
        for side, one, two in (("a", (odd, rows), (nan, rows)), ("b", (rows, odd), (rows, nan))):
            sums[f"v{side}"][over(*one) > 0] = np.nan
            sums[f"e{side}"][over(*one) > 0] = np.inf
            sums[f"e{side}"][over(*two) > 0] = np.nan
    first = pa.array(np.zeros(len(i), dtype=np.int64))
    out = {k: cells[k].combine_chunks().take(first) for k in keys}
    out |= {"i": pa.array(idx[i]), "j": pa.array(idx[j]), "ci": names.take(pa.array(i)), "cj": names.take(pa.array(j)), "n": pa.array(over(rows, rows))}
    out |= {k: pa.array(v, mask=sums[f"n{k[1]}"] == 0 if k[0] == "m" else None) for k, v in sums.items()}
    return pa.table(out)


def component_pairs(comps: DataFrame, *, keys=KEYS, t="t", x="x") -> DataFrame:
    """Pearson r of every pair of components i < j of a key, with n.

    No table of pairs at each position: large keys are dealt by position to groups of about ``CELLS`` cells, a group gives
    its sums for each pair of components at once, and the sums of the groups are merged about a common reference.
    """
    kinds = comps.schema
    cells = comps.where(F.col("idx").isNotNull()).select(*keys, F.col(t).alias("_t"), "idx", "component", F.col(x).cast("double").alias("_x"))
    schema = T.StructType([kinds[k] for k in keys])
    for name, kind in (("i", "idx"), ("j", "idx"), ("ci", "component"), ("cj", "component")):
        schema = schema.add(name, kinds[kind].dataType)
    sides = [f"{v}{side}" for side in "xyab" for v in "nmve"]
    for name in ("n", *sides, "c"):
        schema = schema.add(name, "double")

    def sums(table: pa.Table) -> pa.Table:
        return _pair_sums(table, keys).select(schema.names).cast(to_arrow_schema(schema))

    ship(comps.sparkSession)
    parts = deal(cells, CELLS, keys=keys, t="_t").groupBy(*keys, "_part").applyInArrow(sums, schema)
    pair = [*keys, "i", "j", "ci", "cj"]
    every = Window.partitionBy(*pair)
    parts = parts.withColumns({f"d{s}": F.coalesce(F.col(f"m{s}") - F.min(f"m{s}").over(every), F.lit(0.0)) for s in "xyab"})
    shift = lambda s: F.sum(F.col(f"n{s}") * F.col(f"d{s}"))
    total = lambda s: F.sum(f"n{s}")
    spread = lambda s: F.greatest(F.sum(F.col(f"v{s}") + F.col(f"n{s}") * F.col(f"d{s}") ** 2) - F.try_divide(shift(s) * shift(s), total(s)), F.lit(0.0))
    both = F.sum(F.col("c") + F.col("nx") * F.col("dx") * F.col("dy")) - F.try_divide(shift("x") * shift("y"), total("x"))
    some = lambda s, v: F.when(total(s) > 0, v)
    return parts.groupBy(*pair).agg(
        F.when(total("x") > 1, both / F.sqrt(spread("x") * spread("y"))).alias("r"), F.sum("n").cast("long").alias("n"),
        some("a", F.sqrt(spread("a") / total("a"))).alias("si"), some("b", F.sqrt(spread("b") / total("b"))).alias("sj"),
        some("a", F.sum("ea")).alias("ei"), some("b", F.sum("eb")).alias("ej"),
    )


def pair_correlation(comps: DataFrame, *, keys=KEYS, t="t", x="x") -> DataFrame:
    """AGG-10: mean |r| over pairs, number of pairs, share of pairs with p < 0.05.

    Components of negligible norm or spread are left out.
    """
    norms = comps.groupBy(*keys, "component").agg(F.sqrt(F.sum(F.col(x) ** 2)).alias("_norm"))
    top = norms.groupBy(*keys).agg(F.max("_norm").alias("_top"))
    p = component_pairs(comps, keys=keys, t=t, x=x).join(top, list(keys))
    floor = 1e-12 * (F.col("_top") + 1e-12)
    p = p.where(
        (F.sqrt("ei") > floor) & (F.sqrt("ej") > floor) & (F.col("si") >= 1e-15) & (F.col("sj") >= 1e-15)
        & F.col("r").isNotNull() & ~F.isnan("r")
    )
    nu = F.col("n") - 2.0
    score = F.abs(F.col("r")) * F.sqrt(nu / F.greatest(1.0 - F.col("r") ** 2, F.lit(1e-300)))
    return p.groupBy(*keys).agg(
        F.avg(F.abs("r")).alias("pair_corr"), F.count(F.lit(1)).alias("n_pairs"),
        F.avg((score > t_critical(nu)).cast("double")).alias("significant_share"),
    )


def reconstruction(comps: DataFrame, series: DataFrame, *, keys=("series_id", "method"), skeys=KEYS, t="t") -> DataFrame:
    """AGG-11: RMSE, relative RMSE, maximum and mean absolute error of the sum of components."""
    total = _by_time(comps, keys, t, _sum=F.col("x"))
    d = F.col("_sum") - F.col("_x")
    return (
        total.join(series.select(*skeys, t, F.col("x").alias("_x")), [*skeys, t])
        .groupBy(*keys)
        .agg(
            F.sqrt(F.avg(d * d)).alias("rmse"),
            F.try_divide(F.sqrt(F.sum(d * d)), F.sqrt(F.sum(F.col("_x") ** 2))).alias("rel_rmse"),
            F.max(F.abs(d)).alias("max_abs"),
            F.avg(F.abs(d)).alias("mean_abs"),
        )
    )


def spearman_with_time(df: DataFrame, *, keys=KEYS, t="t", x="x") -> DataFrame:
    """STA-2: rank correlation of values with their position (average ranks for ties)."""
    from tidegraph.operators.dependence import average_ranks

    r = average_ranks(df.select(*keys, t, x), x, keys=keys, tie=t)
    return r.groupBy(*keys).agg(F.corr("rank", F.col(t).cast("double")).alias("spearman"))


def line_fit(df: DataFrame, *, keys=KEYS, t="t", x="x") -> DataFrame:
    """Slope, intercept and R2 against the position; a constant series has slope 0, R2 0."""
    y, p = F.col(x), F.col(t).cast("double")
    g = df.groupBy(*keys).agg(
        F.covar_pop(y, p).alias("_c"), F.var_pop(p).alias("_vt"), F.var_pop(y).alias("_vy"),
        F.avg(y).alias("_my"), F.avg(p).alias("_mt"), F.count(y).alias("n"),
    )
    slope = F.when(F.col("_vt") > 0, F.col("_c") / F.col("_vt")).otherwise(0.0)
    # ss_tot carries the 1e-15 guard of the published definition
    r2 = 1 - (F.col("_vy") * F.col("n") - slope * F.col("_c") * F.col("n")) / (F.col("_vy") * F.col("n") + 1e-15)
    return g.select(*keys, "n", slope.alias("slope"), (F.col("_my") - slope * F.col("_mt")).alias("intercept"), r2.alias("r2"))


def trend_metrics(df: DataFrame, *, keys=KEYS, t="t", x="x", tol=1e-10, block=BLOCK) -> DataFrame:
    """AGG-12 core: level statistics, monotone flags, line fit and Spearman with time."""
    steps = over_time(df, lambda w: {"_d": F.col(x) - F.lag(x).over(w)}, keys=keys, t=t, before=1, block=block)
    g = steps.groupBy(*keys).agg(
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.coalesce(F.bool_and(F.col("_d") >= -tol), F.lit(True)).alias("rising"),
        F.coalesce(F.bool_and(F.col("_d") <= tol), F.lit(True)).alias("falling"),
    )
    return (
        g.join(line_fit(df, keys=keys, t=t, x=x).select(*keys, "slope", "r2"), list(keys))
        .join(spearman_with_time(df, keys=keys, t=t, x=x), list(keys))
        .withColumn("monotone", F.col("rising") | F.col("falling"))
    )


def residual_trend(comps: DataFrame, series: DataFrame, *, keys=("series_id", "method"), skeys=KEYS, t="t", block=BLOCK) -> DataFrame:
    """AGG-12: the residual as trend, and its largest gap to series minus modes."""
    res = comps.where(_is_res())
    by_t = _by_time(comps, keys, t, _imf=F.when(~_is_res(), F.col("x")), _res=F.when(_is_res(), F.col("x")))
    gap = (
        by_t.join(series.select(*skeys, t, F.col("x").alias("_x")), [*skeys, t])
        .groupBy(*keys)
        .agg(F.max(F.abs(F.col("_res") - (F.col("_x") - F.coalesce("_imf", F.lit(0.0))))).alias("max_gap"))
    )
    return trend_metrics(res, keys=keys, t=t, block=block).join(gap, list(keys))


def residual_linearity(df: DataFrame, *, keys=KEYS, t="t", x="x", block=BLOCK) -> DataFrame:
    """AGG-13: R2, distance to the line over the norm, slope, shares of rising and falling steps."""
    steps = over_time(df, lambda w: {"_d": F.col(x) - F.lag(x).over(w)}, keys=keys, t=t, before=1, block=block)
    g = steps.groupBy(*keys).agg(
        F.avg((F.col("_d") > 1e-12).cast("double")).alias("rise_share"),
        F.avg((F.col("_d") < -1e-12).cast("double")).alias("fall_share"),
        F.sum(F.col(x) ** 2).alias("_xx"), F.var_pop(x).alias("_v"),
    )
    fit = line_fit(df, keys=keys, t=t, x=x)
    ss_res = F.greatest(F.col("_v") * F.col("n") - (F.col("r2") * (F.col("_v") * F.col("n") + 1e-15)) + 1e-15, F.lit(0.0))
    return g.join(fit, list(keys)).select(
        *keys, "r2", (F.sqrt(ss_res) / (F.sqrt("_xx") + 1e-15)).alias("line_rmse"), "slope", "rise_share", "fall_share",
        F.greatest("rise_share", "fall_share").alias("same_sign_share"),
        (F.col("fall_share") < 1e-6).alias("rising"), (F.col("rise_share") < 1e-6).alias("falling"),
    )


def composite_trend(comps: DataFrame, last: int = 2, *, keys=("series_id", "method"), t="t") -> DataFrame:
    """AGG-14: sum of the ``last`` slowest modes and the residual, per position."""
    top = comps.where(~_is_res()).groupBy(*keys).agg(F.max("idx").alias("_k"))
    bounds = top.join(comps.groupBy(*keys).agg(F.max(t).alias("_last")), list(keys))
    picked = attach(comps, bounds, keys=keys, t=t).where(_is_res() | (F.col("idx") > F.col("_k") - last))
    return picked.groupBy(*keys, t).agg(F.sum("x").alias("x"))


def composite_report(
    comps: DataFrame, series: DataFrame, last: int = 2, *, keys=("series_id", "method"), skeys=KEYS, t="t", block=BLOCK
) -> DataFrame:
    """AGG-14: metrics of the composite trend, correlations, and gains over the residual alone."""
    trend = composite_trend(comps, last, keys=keys, t=t)
    res = comps.where(_is_res())
    both = (
        trend.withColumnRenamed("x", "_tr")
        .join(res.select(*keys, t, F.col("x").alias("_res")), [*keys, t])
        .join(series.select(*skeys, t, F.col("x").alias("_x")), [*skeys, t])
    )
    corr = both.groupBy(*keys).agg(
        F.corr("_res", "_tr").alias("corr_residual_trend"), F.corr("_x", "_res").alias("corr_x_residual"),
        F.corr("_x", "_tr").alias("corr_x_trend"),
    )
    pick = ["slope", "r2", "spearman", "monotone"]
    a = trend_metrics(trend, keys=keys, t=t, block=block).select(*keys, *pick)
    b = trend_metrics(res, keys=keys, t=t, block=block).select(*keys, *[F.col(c).alias(f"res_{c}") for c in pick])
    return (
        a.join(b, list(keys)).join(corr, list(keys))
        .withColumn("gain_r2", F.col("r2") - F.col("res_r2"))
        .withColumn("gain_corr_x", F.col("corr_x_trend") - F.col("corr_x_residual"))
    )


def trend_component(comps: DataFrame, series: DataFrame, *, keys=("series_id", "method"), skeys=KEYS, t="t", dc: int = 1) -> DataFrame:
    """AGG-16: the slow component of each method.

    Adaptive sifting (and plain sifting): the residual, else the gap; ensemble sifting:
    |x - sum of modes|; band split with dc = 1: its first mode, else as adaptive.
    """
    by_t = comps.groupBy(*keys, t).agg(
        F.sum(F.when(~_is_res(), F.col("x"))).alias("_imf"),
        F.max(F.when(_is_res(), F.col("x"))).alias("_res"),
        F.max(F.when(F.col("component") == "IMF_1", F.col("x"))).alias("_one"),
    )
    d = by_t.join(series.select(*skeys, t, F.col("x").alias("_x")), [*skeys, t])
    gap = F.abs(F.col("_x") - F.coalesce("_imf", F.lit(0.0)))
    slow = (
        F.when(F.col("method").startswith("ensemble"), gap)
        .when(F.col("method").startswith("band") & F.lit(dc == 1) & F.col("_one").isNotNull(), F.col("_one"))
        .otherwise(F.coalesce("_res", gap))
    )
    return d.select(*keys, t, slow.alias("x"), F.col("_x").alias("original"))


def trend_purity(slow: DataFrame, *, keys=("series_id", "method"), t="t", block=BLOCK) -> DataFrame:
    """AGG-15: R2, slope, Spearman, rise / fall shares, roughness and correlation with the original."""
    steps = over_time(
        slow,
        lambda w: {
            "_d": F.col("x") - F.lag("x").over(w),
            "_d2": F.col("x") - 2 * F.lag("x").over(w) + F.lag("x", 2).over(w),
        },
        keys=keys, t=t, before=2, block=block,
    )
    g = steps.groupBy(*keys).agg(
        F.avg((F.col("_d") > 1e-12).cast("double")).alias("rise_share"),
        F.avg((F.col("_d") < -1e-12).cast("double")).alias("fall_share"),
        (F.stddev_pop("_d2") / (F.stddev_pop("x") + 1e-15)).alias("roughness"),
        F.corr("x", "original").alias("corr_original"),
    )
    return (
        g.join(line_fit(slow, keys=keys, t=t).select(*keys, "slope", "r2"), list(keys))
        .join(spearman_with_time(slow, keys=keys, t=t), list(keys))
        .withColumn("same_sign_share", F.greatest("rise_share", "fall_share"))
    )


def mode_gaps(comps: DataFrame, series: DataFrame, *, keys=("series_id", "method"), skeys=KEYS, t="t", dc: int = 1) -> DataFrame:
    """AGG-17: per position: gap to all modes, sum of modes, sum of oscillating modes, trend gap."""
    per = comps.where(~_is_res()).groupBy(*keys, t).agg(
        F.sum("x").alias("mode_sum"),
        F.sum(F.when(F.col("idx") > 1, F.col("x"))).alias("_osc"),
        F.max(F.when(F.col("idx") == 1, F.col("x"))).alias("first_mode"),
    )
    d = per.join(series.select(*skeys, t, F.col("x").alias("original")), [*skeys, t])
    osc = F.coalesce("_osc", "mode_sum") if dc == 1 else F.col("mode_sum")
    return d.select(
        *keys, t, "original", "first_mode", "mode_sum", osc.alias("oscillating_sum"),
        F.abs(F.col("original") - F.col("mode_sum")).alias("gap"),
        F.abs(F.col("original") - F.coalesce("_osc", "mode_sum")).alias("trend_gap"),
    )


def gap_summary(gaps: DataFrame, *, keys=("series_id", "method")) -> DataFrame:
    return gaps.groupBy(*keys).agg(
        F.avg("gap").alias("gap_mean"), F.max("gap").alias("gap_max"),
        F.avg("trend_gap").alias("trend_gap_mean"), F.stddev_pop("trend_gap").alias("trend_gap_std"),
        F.corr("trend_gap", "first_mode").alias("trend_gap_corr"),
    )


def metric_range(metrics: DataFrame, values: Sequence[str], *, by=("graph",)) -> DataFrame:
    """AGG-18: minimum and maximum of metrics over components; NULL is ignored."""
    aggs = []
    for v in values:
        aggs += [F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max")]
    return metrics.groupBy(*by).agg(*aggs)


def histogram(df: DataFrame, x="x", bins: int = 50, *, keys=KEYS, t="t") -> DataFrame:
    """AGG-19: equal-width bins between minimum and maximum; the top edge belongs to the last bin."""
    s = df.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count(F.lit(1)).alias("_rows"))
    r = spread_join(df.select(*keys, x, t), s, keys, "_rows").where(F.col(x).isNotNull())
    pos = (F.col(x) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins
    b = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor(pos), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    return r.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def node_summary(df: DataFrame, x: str, *, keys=KEYS) -> DataFrame:
    """AGG-20: mean and maximum of a node metric."""
    return df.groupBy(*keys).agg(F.avg(x).alias(f"{x}_mean"), F.max(x).alias(f"{x}_max"))


def embedding_dispersion(df: DataFrame, vec: str = "vec", *, keys=KEYS) -> DataFrame:
    """AGG-21: trace of the covariance of an embedding and the value range."""
    per = (
        df.select(*keys, F.posexplode(vec).alias("_c", "_v"))
        .groupBy(*keys, "_c")
        .agg(F.var_samp("_v").alias("_var"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    )
    return per.groupBy(*keys).agg(
        F.sum("_var").alias("dispersion"), (F.max("_hi") - F.min("_lo")).alias("value_range")
    )


def readout(nodes: DataFrame, vec: str = "features", *, keys=KEYS, node="node") -> DataFrame:
    """AGG-22: per graph and feature: sum, mean, median (lower), max, product, population std and variance."""
    long = nodes.select(*keys, node, F.posexplode(vec).alias("feature", "v"))
    g = long.groupBy(*keys, "feature").agg(
        F.sum("v").alias("sum"), F.avg("v").alias("mean"), F.max("v").alias("max"), F.product("v").alias("mul"),
        F.stddev_pop("v").alias("std"), F.var_pop("v").alias("var"),
    )
    gk = (*keys, "feature")
    mid = F.floor((F.col("_n") - 1) / 2)
    ranked = ranked_values(long, "v", keys=gk).where((F.col("_lo") <= mid) & (mid < F.col("_hi")))
    return g.join(ranked.select(*gk, F.col("v").alias("median")), list(gk), "left")
