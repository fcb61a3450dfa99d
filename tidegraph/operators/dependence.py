"""Dependence and nonlinearity tests per series."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.core import KEYS, cut
from tidegraph.functions.closed import adf_p, chi2_even_tail, kpss_p, normal_cdf
from tidegraph.layout import BLOCK, affine_scan, attach, longest, ordered_position, over_time, scan, summarise
from tidegraph.operators.aggregates import component_pairs, line_fit
from tidegraph.operators.windows import delay_embedding, lagged_pairs
from tidegraph.tiles import nearest, pair_counts


def average_ranks(df: DataFrame, x: str, *, keys=KEYS, tie: str, block=BLOCK) -> DataFrame:
    """Add ``rank``: 1-based rank by value, ties share their average rank.

    Where no series exceeds a block, one sort of each series gives all ranks. Else runs of equal values are found along
    the global order by two scans (first and last position of the run), so even one value in a third of all rows needs
    no join on it. NULLs come first in the order of ``tie``; the last of them shares the end of the run after it. Rows of
    NULL keys have no rank.
    """
    df = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    if rows <= block:
        w, peers = Window.partitionBy(*keys).orderBy(x, tie), Window.partitionBy(*keys).orderBy(x)
        pos = df.withColumn("_pos", F.row_number().over(w)).withColumns({"_a": F.rank().over(peers), "_b": F.count(F.lit(1)).over(peers)})
        pos = pos.withColumn("_n", F.when(F.lead(x).over(w).isNotNull(), F.lead("_b").over(w)))
        null = F.col("_pos") + F.coalesce("_n", "_pos")
        return pos.withColumn("rank", F.when(F.col(x).isNull(), null).otherwise(F.col("_a") + F.col("_b")) / 2.0).drop("_pos", "_a", "_b", "_n")
    pos = ordered_position(df, [x, tie], keys=keys, name="_pos")
    pos = over_time(pos, lambda w: {"_p": F.lag(x).over(w), "_n": F.lead(x).over(w)}, keys=keys, t="_pos", before=1, after=1)
    opens = F.when(F.col("_p").isNull() | (F.col("_p") != F.col(x)), F.col("_pos"))
    closes = F.when(F.col("_n").isNull() | (F.col("_n") != F.col(x)), F.col("_pos"))
    pos = scan(pos, {"_a": ("max", opens)}, keys=keys, t="_pos")
    pos = scan(pos, {"_b": ("min", closes)}, keys=keys, t="_pos", reverse=True)
    return pos.withColumn("rank", (F.col("_a") + F.col("_b")) / 2.0 + 1.0).drop("_pos", "_p", "_n", "_a", "_b")


def correlation_summary(comps: DataFrame, *, keys=KEYS, t="t") -> DataFrame:
    """STA-1: maximum, mean and Frobenius norm of the off-diagonal Pearson matrix."""
    r = F.col("r")
    return component_pairs(comps, keys=keys, t=t).groupBy(*keys).agg(
        F.max(F.abs(r)).alias("max_abs"), F.avg(F.abs(r)).alias("mean_abs"), F.sqrt(2 * F.sum(r * r)).alias("frobenius"),
        F.count(r).alias("pairs"),
    )


def rank_correlation(comps: DataFrame, *, keys=KEYS, t="t") -> DataFrame:
    """STA-2: Spearman r of every pair of components."""
    ranked = average_ranks(comps.select(*keys, "component", "idx", t, "x"), "x", keys=(*keys, "component"), tie=t)
    return component_pairs(ranked.select(*keys, "component", "idx", t, F.col("rank").alias("x")), keys=keys, t=t).select(
        *keys, "i", "j", "ci", "cj", "r", "n"
    )


def correlation_flags(comps: DataFrame, pearson_limit=1e-6, spearman_limit=0.15, *, keys=KEYS, t="t") -> DataFrame:
    """STA-2 / RED-10: are all pairs below the Pearson and Spearman limits?"""
    p = component_pairs(comps, keys=keys, t=t).groupBy(*keys).agg(F.max(F.abs("r")).alias("max_pearson"))
    s = rank_correlation(comps, keys=keys, t=t).groupBy(*keys).agg(F.max(F.abs("r")).alias("max_spearman"))
    return p.join(s, list(keys)).select(
        *keys, "max_pearson", "max_spearman",
        (F.col("max_pearson") < pearson_limit).alias("pearson_ok"),
        (F.col("max_spearman") < spearman_limit).alias("spearman_ok"),
    )


def _centred(df: DataFrame, value: Column, keys, t) -> DataFrame:
    v = df.select(*keys, t, value.alias("x"))
    s = summarise(v, F.avg("x").alias("_m"), keys=keys, t=t)
    return attach(v, s, keys=keys, t=t).select(*keys, t, (F.col("x") - F.col("_m")).alias("x"))


def autocorrelation(df: DataFrame, lags: int = 20, *, squares=True, keys=KEYS, t="t", x="x", block=BLOCK) -> DataFrame:
    """(keys, tau, rho, n): autocorrelation of x squared (or x) about its mean; NULL for a constant series."""
    c = _centred(df, F.col(x) * F.col(x) if squares else F.col(x), keys, t)
    total = c.groupBy(*keys).agg(F.sum(F.col("x") ** 2).alias("_v"), F.count(F.lit(1)).alias("n"))
    prod = lagged_pairs(c, lags, keys=keys, t=t, block=block).groupBy(*keys, "tau").agg(F.sum(F.col("x") * F.col("y")).alias("_p"))
    return prod.join(total, list(keys)).select(*keys, "tau", F.try_divide("_p", "_v").alias("rho"), "n")


def square_dependence(df: DataFrame, lags: int = 20, lb_lags: int = 10, *, keys=KEYS, t="t", x="x", block=BLOCK) -> DataFrame:
    """STA-3, STA-4: significant lags of the squares, largest |rho|, Ljung-Box with p value and flag."""
    rho, n = F.col("rho"), F.col("n")
    lb = F.when(F.col("tau") <= lb_lags, rho * rho / (n - F.col("tau")))
    g = autocorrelation(df, max(lags, lb_lags), keys=keys, t=t, x=x, block=block).groupBy(*keys).agg(
        F.sum(F.when(F.col("tau") <= lags, (F.abs(rho) > 1.96 / F.sqrt(n)).cast("int"))).alias("significant_lags"),
        F.max(F.when(F.col("tau") <= lags, F.abs(rho))).alias("max_rho"),
        (F.max(n) * (F.max(n) + 2) * F.sum(lb)).alias("lb"),
    )
    p = chi2_even_tail(F.col("lb"), lb_lags)
    return g.withColumn("lb_p", p).withColumn("nonlinear", p < 0.05)


def _gram(rows: DataFrame, cols: Sequence[str], keys) -> DataFrame:
    """(keys, gram ARRAY, n): cross products of columns; partial sums per batch, then one small shuffle."""
    p = len(cols)
    key_fields = [rows.schema[k] for k in keys]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, g in b.groupby(list(keys), sort=False):
                z = g[list(cols)].to_numpy(dtype=float)
                out = dict(zip(keys, key))
                m = (z.T @ z).ravel()
                yield pd.DataFrame([{**out, "i": i, "v": v} for i, v in enumerate(m)])

    schema = T.StructType([*key_fields, T.StructField("i", T.IntegerType()), T.StructField("v", T.DoubleType())])
    parts = rows.select(*keys, *cols).mapInPandas(partial, schema)
    sums = parts.groupBy(*keys, "i").agg(F.sum("v").alias("v"))
    return sums.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("gram")
    ).withColumn("p", F.lit(p))


def _ols_from_gram(g: np.ndarray, use: list[int]) -> tuple[np.ndarray, float, np.ndarray]:
    """Regression of column 0 on columns ``use``: coefficients, residual sum of squares, inverse."""
    inv = np.linalg.pinv(g[np.ix_(use, use)])
    beta = inv @ g[use, 0]
    return beta, float(g[0, 0] - beta @ g[use, 0]), inv


def adf(df: DataFrame, max_lag: int | None = None, *, keys=KEYS, t="t", x="x", block=BLOCK) -> DataFrame:
    """STA-5: augmented Dickey-Fuller with constant, lag by AIC on a common sample, p by MacKinnon.

    All regressions of a series come from one cross-product matrix; the choice of the lag is
    a p x p problem per series.
    """
    c = cut(_centred(df, F.col(x), keys, t))
    n_max = longest(c, t)
    top = max_lag if max_lag is not None else int(np.ceil(12 * (n_max / 100) ** 0.25))
    lags = over_time(
        c, lambda w: {"_d": F.col("x") - F.lag("x").over(w), "_l": F.lag("x").over(w)},
        lambda w: {f"_d{k}": F.lag("_d", k).over(w) for k in range(1, top + 1)},
        keys=keys, t=t, before=top + 2, block=block,
    )
    n = c.groupBy(*keys).agg(F.max(t).alias("_last"))
    limit = F.lit(max_lag) if max_lag is not None else F.least(
        F.ceil(12 * F.pow((F.col("_last") + 1) / 100.0, F.lit(0.25))).cast("int"), F.lit(top)
    )
    cols = ["_d", "_l", "_one", *[f"_d{k}" for k in range(1, top + 1)]]

    def design(extra: DataFrame, name: str) -> DataFrame:
        r = attach(lags, extra.join(n, list(keys)), keys=keys, t=t).where(F.col(t) >= F.col(name) + 1)
        zero = {f"_d{k}": F.when(F.col(name) >= k, F.col(f"_d{k}")).otherwise(0.0) for k in range(1, top + 1)}
        return r.withColumns({**zero, "_one": F.lit(1.0)})

    limits = n.withColumn("_lim", limit).drop("_last")
    first = _gram(design(limits, "_lim"), cols, keys).join(limits, list(keys))

    @F.pandas_udf("int")
    def pick(gram: pd.Series, lim: pd.Series) -> pd.Series:
        out = []
        for flat, m in zip(gram, lim):
            g = np.asarray(flat).reshape(len(cols), len(cols))
            nobs = g[2, 2]
            aic = []
            for k in range(m + 1):
                use = [1, 2, *range(3, 3 + k)]
                _, rss, _ = _ols_from_gram(g, use)
                aic.append(nobs * (np.log(2 * np.pi * max(rss, 1e-300) / nobs) + 1) + 2 * len(use))
            out.append(int(np.argmin(aic)))
        return pd.Series(out)

    best = cut(first.select(*keys, pick("gram", "_lim").alias("lag")))
    second = _gram(design(best, "lag"), cols, keys).join(best, list(keys))

    @F.pandas_udf("double")
    def tstat(gram: pd.Series, lag: pd.Series) -> pd.Series:
        out = []
        for flat, k in zip(gram, lag):
            g = np.asarray(flat).reshape(len(cols), len(cols))
            use = [1, 2, *range(3, 3 + k)]
            beta, rss, inv = _ols_from_gram(g, use)
            out.append(beta[0] / np.sqrt(rss / (g[2, 2] - len(use)) * inv[0, 0]))
        return pd.Series(out)

    stat = second.select(*keys, "lag", tstat("gram", "lag").alias("adf"))
    return stat.withColumn("adf_p", adf_p(F.col("adf"))).withColumn("stationary", F.col("adf_p") < 0.05)


def kpss(df: DataFrame, *, keys=KEYS, t="t", x="x", block=BLOCK) -> DataFrame:
    """STA-6: KPSS about a linear trend, automatic bandwidth, p by table interpolation."""
    fit = line_fit(df, keys=keys, t=t, x=x).withColumn("_last", F.col("n") - 1)
    r = cut(
        attach(df.select(*keys, t, x), fit, keys=keys, t=t).select(
            *keys, t, "n", (F.col(x) - F.col("slope") * F.col(t) - F.col("intercept")).alias("x")
        )
    )
    n_max = longest(r, t)
    short = max(1, int(np.floor(n_max ** (2 / 9))))
    base = r.groupBy(*keys).agg(F.sum(F.col("x") ** 2).alias("_rr"), F.max("n").alias("n"))
    n = F.col("n")

    def products(lags: int) -> DataFrame:
        p = lagged_pairs(r, lags, keys=keys, t=t, block=block)
        return p.groupBy(*keys, "tau").agg(F.sum(F.col("x") * F.col("y")).alias("_c")).join(base, list(keys))

    c = F.col("_c") / (n / 2.0)
    low = products(short).where(F.col("tau") <= F.floor(F.pow(n, F.lit(2 / 9))))
    width = low.groupBy(*keys).agg(
        (F.max("_rr") / F.max(n) + F.sum(c)).alias("_s0"), F.sum(F.col("tau") * c).alias("_s1"), F.max(n).alias("n")
    )
    gamma = 1.1447 * F.pow(F.pow(F.coalesce(F.try_divide("_s1", "_s0"), F.lit(0.0)), 2), F.lit(1 / 3))
    width = cut(width.select(*keys, F.least(F.floor(gamma * F.pow(n, F.lit(1 / 3))), n - 1).cast("int").alias("lags")))
    top = max(1, width.agg(F.max("lags")).first()[0] or 1)
    long_run = (
        products(top).join(width, list(keys)).groupBy(*keys)
        .agg(
            F.max("_rr").alias("_rr"), F.max("lags").alias("lags"),
            F.sum(F.when(F.col("tau") <= F.col("lags"), (1 - F.col("tau") / (F.col("lags") + 1)) * F.col("_c")).otherwise(0.0)).alias("_w"),
        )
    )
    walk = scan(r, {"_s": ("sum", F.col("x"))}, keys=keys, t=t, block=block, rows=n_max)
    eta = walk.groupBy(*keys).agg(F.sum(F.col("_s") ** 2).alias("_ss"), F.max(n).alias("n"))
    stat = F.try_divide(F.col("_ss") / (n * n), (F.col("_rr") + 2 * F.col("_w")) / n)
    return eta.join(long_run, list(keys)).select(*keys, "lags", stat.alias("kpss")).withColumn(
        "kpss_p", F.when(F.col("kpss").isNotNull(), kpss_p(F.col("kpss")))
    ).withColumn("stationary", F.col("kpss_p") > 0.05)


def ar1(df: DataFrame, *, keys=KEYS, t="t", x="x", block=BLOCK) -> tuple[DataFrame, DataFrame]:
    """STA-7: (coefficients, residuals). Residuals are a series again, positions from 0."""
    lag = over_time(df, lambda w: {"_l": F.lag(x).over(w)}, keys=keys, t=t, before=1, block=block).where(F.col("_l").isNotNull())
    coef = lag.groupBy(*keys).agg(
        F.regr_slope(x, "_l").alias("phi"), F.regr_intercept(x, "_l").alias("const"),
        F.count(F.lit(1)).alias("n"), F.max(t).alias("_last"),
    )
    resid = attach(lag, coef, keys=keys, t=t).select(
        *keys, (F.col(t) - 1).alias(t), (F.col(x) - F.col("const") - F.col("phi") * F.col("_l")).alias("x")
    )
    return coef.drop("_last"), resid


def close_counts(df: DataFrame, radius: DataFrame, *, keys=KEYS, t="t", x="x") -> DataFrame:
    """(keys, t, c): number of values of the series strictly within radius(keys, r) of x, itself included.

    Counts come from ranks: every value asks how many values lie below its two limits.
    """
    last = df.groupBy(*keys).agg(F.max(t).alias("_last"))
    d = attach(df.select(*keys, t, x), radius.join(last, list(keys)), keys=keys, t=t)
    # below the upper limit: strictly; at or below the lower limit
    probes = F.array(
        F.struct(F.col(x).alias("v"), F.lit(1).alias("kind")),
        F.struct((F.col(x) - F.col("r")).alias("v"), F.lit(2).alias("kind")),
        F.struct((F.col(x) + F.col("r")).alias("v"), F.lit(0).alias("kind")),
    )
    e = d.select(*keys, t, F.explode(probes).alias("_p")).select(*keys, t, "_p.v", "_p.kind")
    e = ordered_position(e, ["v", "kind", t], keys=keys, name="_e")
    e = scan(e, {"_below": ("sum", (F.col("kind") == 1).cast("long"))}, keys=keys, t="_e")
    signed = F.when(F.col("kind") == 0, F.col("_below")).otherwise(-F.col("_below"))
    return e.where(F.col("kind") != 1).groupBy(*keys, t).agg(F.sum(signed).alias("c"))


def bds(df: DataFrame, dims: Sequence[int] = (2, 3, 4, 5), *, factor: float = 1.5, keys=KEYS, t="t", x="x", block=BLOCK) -> DataFrame:
    """STA-8: BDS statistic for each embedding dimension, radius ``factor`` standard deviations.

    Close pairs of all dimensions are counted in one pass: dimension is part of the key.
    """
    s = cut(df.select(*keys, t, F.col(x).alias("x")))
    stats = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (factor * F.stddev_samp("x")).alias("r"))
    counts = close_counts(s, stats.select(*keys, "r"), keys=keys, t=t)
    k = counts.groupBy(*keys).agg(F.sum(F.col("c") * F.col("c")).alias("_cc"), F.sum("c").alias("_c"))
    n = F.col("n")
    base = stats.join(k, list(keys)).select(
        *keys, "n", "r",
        ((F.col("_cc") - 3 * F.col("_c") + 2 * n) / (n * (n - 1.0) * (n - 2))).alias("K"),
        ((F.col("_c") - n) / (n * (n - 1.0))).alias("C1"),
    )
    base = cut(base)
    dkeys = (*keys, "m")
    clouds, tails = None, None
    for m in dims:
        e = delay_embedding(s, 1, m, keys=keys, t=t, block=block).withColumnRenamed(t, "node").withColumn("m", F.lit(m))
        # C1 of the statistic in dimension m uses the last n - m + 1 points
        tail = s.where(F.col(t) >= m - 1).select(*keys, F.col(t).alias("node"), F.array("x").alias("vec")).withColumn("m", F.lit(-m))
        clouds = e if clouds is None else clouds.unionByName(e)
        tails = tail if tails is None else tails.unionByName(tail)
    both = clouds.unionByName(tails)
    radii = base.select(*keys, F.explode(F.array(*[F.lit(v) for d in dims for v in (d, -d)])).alias("m"), F.array("r").alias("rs"))
    pairs = pair_counts(both, radii, keys=dkeys, metric="chebyshev", strict=True)
    p = pairs.groupBy(*keys, F.abs("m").alias("m")).agg(
        F.sum(F.when(F.col("m") > 0, F.col("pairs"))).alias("_pm"), F.sum(F.when(F.col("m") < 0, F.col("pairs"))).alias("_p1")
    )
    m, K, C1 = F.col("m"), F.col("K"), F.col("C1")
    size = n - m + 1
    share = lambda c: F.col(c) / (size * (size - 1) / 2.0)
    tail_sum = F.aggregate(
        F.sequence(F.lit(1), m - 1), F.lit(0.0), lambda acc, j: acc + F.pow(K, m - j) * F.pow(C1, 2 * j)
    )
    var = 4 * (F.pow(K, m) + 2 * tail_sum + (m - 1) * (m - 1) * F.pow(C1, 2 * m) - m * m * K * F.pow(C1, 2 * m - 2))
    stat = F.sqrt(size) * (share("_pm") - F.pow(share("_p1"), m)) / F.sqrt(var)
    out = p.join(base, list(keys)).select(*keys, "m", stat.alias("bds"))
    return out.withColumn("bds_p", 2 * (1 - normal_cdf(F.abs("bds"))))


def volatility_grid(
    df: DataFrame, grid: Sequence[Mapping[str, float]], *, span: int = 4096, keys=KEYS, t="t", x="x"
) -> DataFrame:
    """STA-9: log likelihood of h_t = omega*v + alpha*x_{t-1}^2 + beta*h_{t-1} on a parameter grid, AIC, BIC.

    v is the mean square of the series and the start value of h. beta = 0 is ARCH(1)
    (2 parameters), else GARCH(1,1) (3 parameters). The recursion is affine in its start
    value, so blocks of ``span`` points are folded to one map each, the maps chained by ``affine_scan``, and the blocks
    evaluated again from their start values.
    """
    points = F.array(*[F.struct(F.lit(i).alias("point"), *[F.lit(float(g[k])).alias(k) for k in ("omega", "alpha", "beta")]) for i, g in enumerate(grid)])
    v = summarise(df, F.avg(F.col(x) ** 2).alias("_v"), F.count(F.lit(1)).alias("n"), keys=keys, t=t)
    rows = attach(df.select(*keys, t, x), v, keys=keys, t=t)
    blocks = cut(
        rows.groupBy(*keys, F.floor(F.col(t) / span).alias("blk")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct(t, (F.col(x) ** 2).alias("s")))), lambda p: p["s"]).alias("sq"),
            F.max("_v").alias("_v"), F.max("n").alias("n"),
        ).select("*", F.explode(points).alias("g")).select("*", "g.*").drop("g")
    )
    a, b, w = F.col("alpha"), F.col("beta"), F.col("omega") * F.col("_v")
    end = F.aggregate("sq", F.lit(0.0), lambda acc, s: w + a * s + b * acc)
    maps = blocks.select(*keys, "point", "blk", "_v", end.alias("add"), F.pow(b, F.size("sq").cast("double")).alias("mul"))
    chain = affine_scan(maps, "add", "mul", keys=(*keys, "point"), t="blk", rows=longest(blocks, "blk"))
    before = Window.partitionBy(*keys, "point").orderBy("blk")
    reached = F.lag("add", 1).over(before) + F.lag("mul", 1).over(before) * F.col("_v")
    chain = chain.select(*keys, "point", "blk", F.coalesce(reached, "_v").alias("_h0"))
    start = F.struct(F.col("_h0").alias("h"), F.lit(0.0).alias("l"))
    ll = F.aggregate(
        "sq", start,
        lambda acc, s: F.struct(
            (w + a * s + b * acc["h"]).alias("h"),
            (acc["l"] - 0.5 * (F.lit(float(np.log(2 * np.pi))) + F.ln(acc["h"]) + s / acc["h"])).alias("l"),
        ),
    )["l"]
    g = blocks.join(chain, [*keys, "point", "blk"]).groupBy(*keys, "point", "omega", "alpha", "beta").agg(
        F.sum(ll).alias("loglik"), F.max("n").alias("n")
    )
    k = F.when(F.col("beta") == 0, 2).otherwise(3)
    model = F.when(F.col("beta") == 0, "arch").otherwise("garch")
    return g.withColumn("model", model).withColumn("aic", 2 * k - 2 * F.col("loglik")).withColumn(
        "bic", k * F.ln("n") - 2 * F.col("loglik")
    )


def best_volatility(grid: DataFrame, *, keys=KEYS) -> DataFrame:
    """STA-9: grid point of least AIC per series and model."""
    cols = ["point", "omega", "alpha", "beta", "loglik", "aic", "bic"]
    g = grid.groupBy(*keys, "model").agg(F.min_by(F.struct(*cols), F.struct("aic", "point")).alias("_b"))
    return g.select(*keys, "model", *[F.col(f"_b.{c}").alias(c) for c in cols])


def verdict(adf_table: DataFrame, lb_table: DataFrame, *, keys=KEYS) -> DataFrame:
    """STA-10: non-stationary level, dependence of squared returns, suited for decomposition."""
    a = adf_table.select(*keys, (~F.col("stationary")).alias("nonstationary"))
    b = lb_table.select(*keys, F.col("nonlinear"))
    return a.join(b, list(keys)).withColumn(
        "verdict",
        F.when(F.col("nonstationary") & F.col("nonlinear"), "suited: non-stationary and nonlinear")
        .when(F.col("nonstationary"), "suited: non-stationary")
        .when(F.col("nonlinear"), "suited: nonlinear")
        .otherwise("no indication"),
    )


def _bins(df: DataFrame, keys, t, x) -> DataFrame:
    """(keys, t, n, b): number of bin edges at or below x, with floor(sqrt n) edges from min to max."""
    s = summarise(df, F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count(F.lit(1)).alias("n"), keys=keys, t=t)
    s = s.withColumn("_nb", F.floor(F.sqrt("n")))
    d = attach(df.select(*keys, t, x), s, keys=keys, t=t)
    step = (F.col("_hi") - F.col("_lo")) / (F.col("_nb") - 1)
    guess = F.floor((F.col(x) - F.col("_lo")) / step)

    def edge(k: Column) -> Column:
        return F.when(k >= F.col("_nb") - 1, F.col("_hi")).otherwise(k * step + F.col("_lo"))

    up = F.when((guess + 1 <= F.col("_nb") - 1) & (edge(guess + 1) <= F.col(x)), guess + 2)
    b = up.when(edge(guess) > F.col(x), guess).otherwise(F.least(guess + 1, F.col("_nb")))
    flat = (F.col("_hi") == F.col("_lo")) | (F.col("_nb") < 2)
    return d.select(*keys, t, "n", F.when(flat, F.lit(1).cast("long")).otherwise(b).alias("b"))


def mutual_information(df: DataFrame, tau_max: int = 50, *, keys=KEYS, t="t", x="x", block=BLOCK) -> DataFrame:
    """STA-11: (keys, tau, mi) in nats for tau = 1 .. min(tau_max, floor(n / 2) - 1)."""
    d = _bins(df, keys, t, x)
    wide = over_time(
        d, lambda w: {"_next": F.array(*[F.lead("b", k).over(w) for k in range(1, tau_max + 1)])},
        keys=keys, t=t, after=tau_max, block=block,
    )
    pairs = wide.select(*keys, "n", "b", F.posexplode("_next").alias("_k", "c")).where(
        F.col("c").isNotNull() & (F.col("_k") + 1 <= F.floor(F.col("n") / 2) - 1)
    )
    joint = cut(pairs.groupBy(*keys, (F.col("_k") + 1).alias("tau"), "b", "c").agg(F.count(F.lit(1)).alias("f")))
    pb = joint.groupBy(*keys, "tau", "b").agg(F.sum("f").alias("fb"))
    pc = joint.groupBy(*keys, "tau", "c").agg(F.sum("f").alias("fc"))
    total = joint.groupBy(*keys, "tau").agg(F.sum("f").alias("m"))
    j = joint.join(pb, [*keys, "tau", "b"]).join(pc, [*keys, "tau", "c"]).join(total, [*keys, "tau"])
    term = F.col("f") / F.col("m") * F.ln(F.col("f") * F.col("m") / (F.col("fb") * F.col("fc")))
    return j.groupBy(*keys, "tau").agg(F.sum(term).alias("mi"))


def choose_tau(mi: DataFrame, *, keys=KEYS, rule: str = "minimum", digits: int = 12) -> DataFrame:
    """STA-12: delay from the MI curve (at most tau_max rows per key).

    ``minimum``: first strict local minimum, else the point after the first rise, else the
    second delay; curves of one or two values give the first. ``first_rise``: index of the
    first rise. Values are compared after rounding to ``digits``.
    """
    if rule not in ("minimum", "first_rise"):
        raise ValueError("rule must be 'minimum' or 'first_rise'")
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("tau")
    m = mi.withColumn("_v", F.round("mi", digits))
    r = m.withColumns({"_p": F.lag("_v").over(w), "_n": F.lead("_v").over(w)})
    low = F.min(F.when((F.col("_v") < F.col("_p")) & (F.col("_v") < F.col("_n")), F.col("tau")))
    rise = F.min(F.when(F.col("_v") > F.col("_p"), F.col("tau")))
    if rule == "first_rise":
        return r.groupBy(*keys).agg((rise - 2).alias("tau"))
    pick = F.when(F.count(F.lit(1)) <= 2, F.min("tau")).otherwise(F.coalesce(low, rise, F.min("tau") + 1))
    return r.groupBy(*keys).agg(pick.alias("tau"))


def embed_by(df: DataFrame, params: DataFrame, tau_top: int, d_top: int, *, keys=KEYS, t="t", x="x", block=BLOCK) -> DataFrame:
    """Delay embedding with tau and d per key (columns ``tau``, ``d`` of params): (keys, node, vec)."""
    last = df.groupBy(*keys).agg(F.max(t).alias("_last"))
    d = attach(df.select(*keys, t, x), params.select(*keys, "tau", "d").join(last, list(keys)), keys=keys, t=t)
    reach = tau_top * (d_top - 1)
    wide = over_time(
        d, lambda w: {"_f": F.collect_list(x).over(w.rowsBetween(0, reach))}, keys=keys, t=t, after=reach, block=block
    )
    need = (F.col("d") - 1) * F.col("tau") + 1
    vec = F.transform(F.sequence(F.lit(0), F.col("d") - 1), lambda i: F.get("_f", i * F.col("tau")))
    return wide.where(F.size("_f") >= need).select(*keys, F.col(t).alias("node"), vec.alias("vec"))


def false_neighbours(
    df: DataFrame, taus: DataFrame, d_max: int = 10, *, factor=10.0, enough=0.1, keys=KEYS, t="t", x="x", block=BLOCK
) -> tuple[DataFrame, DataFrame]:
    """STA-13: (share of false nearest neighbours per dimension, chosen dimension per key).

    All dimensions run in one pass with the dimension as part of the key.
    """
    s = cut(df.select(*keys, t, F.col(x).alias("x")))
    tau_top = taus.agg(F.max("tau")).first()[0]
    dims = taus.select(*keys, "tau", F.explode(F.sequence(F.lit(2), F.lit(d_max))).alias("d"))
    last = s.groupBy(*keys).agg(F.max(t).alias("_last"))
    dkeys = (*keys, "d")
    reach = int(tau_top) * d_max
    d = attach(s, taus.select(*keys, "tau").join(last, list(keys)), keys=keys, t=t)
    wide = over_time(d, lambda w: {"_f": F.collect_list("x").over(w.rowsBetween(0, reach))}, keys=keys, t=t, after=reach, block=block)
    e = wide.select("*", F.explode(F.sequence(F.lit(2), F.lit(d_max))).alias("d"))
    e = e.where(F.size("_f") >= (F.col("d") - 1) * F.col("tau") + 1).select(
        *dkeys, F.col(t).alias("node"),
        F.transform(F.sequence(F.lit(0), F.col("d") - 1), lambda i: F.get("_f", i * F.col("tau"))).alias("vec"),
        F.get("_f", F.col("d") * F.col("tau")).alias("nxt"),
    )
    e = cut(e)
    near = nearest(e.select(*dkeys, "node", "vec"), keys=dkeys)
    other = e.select(*dkeys, F.col("node").alias("other"), F.col("nxt").alias("nxt2"))
    r = e.select(*dkeys, "node", "nxt").join(near, [*dkeys, "node"], "left").join(other, [*dkeys, "other"], "left")
    false = (F.col("dist") > 1e-10) & (F.abs(F.col("nxt") - F.col("nxt2")) / F.col("dist") > factor)
    ratios = r.groupBy(*dkeys).agg(F.avg(F.coalesce(false, F.lit(False)).cast("double")).alias("ratio"))
    ratios = cut(ratios)
    chosen = ratios.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("ratio") < enough, F.col("d"))), F.min_by("d", F.struct("ratio", "d"))).alias("d")
    )
    return ratios, chosen.join(dims.select(*keys, "tau").distinct(), list(keys))


def correlation_dimension(
    df: DataFrame, d: int = 10, tau: int = 1, *, low=0.1, high=0.5, step=1.03, keys=KEYS, t="t", x="x", block=BLOCK
) -> tuple[DataFrame, DataFrame]:
    """STA-14: (correlation sums per radius, slope of log C on log r). Maximum norm, radii in standard deviations."""
    count = int(np.floor(np.log(high / low) / np.log(step) + 1e-9)) + 1
    sd = df.groupBy(*keys).agg(F.stddev_samp(x).alias("_sd"))
    e = delay_embedding(df, tau, d, keys=keys, t=t, x=x, block=block).withColumnRenamed(t, "node")
    rs = F.array(*[F.col("_sd") * (low * step**k) for k in range(count)])
    sizes = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    radii = sd.select(*keys, rs.alias("rs"))
    sums = (
        pair_counts(e, radii, keys=keys, metric="chebyshev")
        .join(sizes, list(keys)).join(radii, list(keys))
        .select(*keys, "k", F.get("rs", F.col("k")).alias("r"), (F.col("pairs") / (F.col("m") * (F.col("m") - 1) / 2.0)).alias("c"))
    )
    sums = cut(sums)
    slope = sums.where(F.col("c") > 0).groupBy(*keys).agg(F.regr_slope(F.ln("c"), F.ln("r")).alias("dimension"))
    return sums, slope


def lyapunov(
    df: DataFrame, d: int = 10, tau: int = 1, min_gap: int = 10, steps: int = 20, *, keys=KEYS, t="t", x="x", block=BLOCK
) -> tuple[DataFrame, DataFrame]:
    """STA-15: (mean log divergence per step, largest Lyapunov exponent = its slope)."""
    e = cut(delay_embedding(df, tau, d, keys=keys, t=t, x=x, block=block).withColumnRenamed(t, "node"))
    top = e.groupBy(*keys).agg(F.max("node").alias("_last"))
    starts = attach(e, top.withColumn("_top", F.col("_last")), keys=keys, t="node").where(
        F.col("node") <= F.col("_top") - (steps - 1)
    )
    near = nearest(starts.select(*keys, "node", "vec"), keys=keys, min_gap=min_gap)
    ahead = near.select(*keys, "node", "other", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("k")).select(
        *keys, "k", (F.col("node") + F.col("k")).alias("p"), (F.col("other") + F.col("k")).alias("q")
    )
    p = e.select(*keys, F.col("node").alias("p"), F.col("vec").alias("vp"))
    q = e.select(*keys, F.col("node").alias("q"), F.col("vec").alias("vq"))
    both = ahead.join(p, [*keys, "p"]).join(q, [*keys, "q"])
    dist = F.sqrt(F.aggregate(F.zip_with("vp", "vq", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    curve = both.withColumn("_d", dist).where(F.col("_d") > 0).groupBy(*keys, "k").agg(F.avg(F.ln("_d")).alias("divergence"))
    curve = cut(curve)
    return curve, curve.groupBy(*keys).agg(F.regr_slope("divergence", F.col("k").cast("double")).alias("exponent"))
