"""Window operators on series(series_id, t, x). ``t`` runs 0..n-1 without gaps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.core import KEYS
from tidegraph.functions.noise import between, uniform
from tidegraph.layout import BLOCK, attach, over_time, scan, with_halo


def _full(w, width: int, agg: Column) -> Column:
    frame = w.rowsBetween(-(width - 1), 0)
    return F.when(F.count("_v").over(frame) == width, agg.over(frame))


def change_columns(df: DataFrame, *, keys=KEYS, t="t", x="x", block=BLOCK) -> DataFrame:
    """WIN-1, WIN-2, WIN-9: simple and log return in percent (NULL after a zero), first and second difference."""
    return over_time(
        df,
        lambda w: {"_1": F.lag(x, 1).over(w), "_2": F.lag(x, 2).over(w)},
        keys=keys, t=t, before=2, block=block,
    ).select(
        *df.columns,
        ((F.try_divide(F.col(x), F.col("_1")) - 1) * 100).alias("ret"),
        (F.ln(F.try_divide(F.col(x), F.col("_1"))) * 100).alias("log_ret"),
        (F.col(x) - F.col("_1")).alias("d1"),
        ((F.col(x) - F.col("_1")) - (F.col("_1") - F.col("_2"))).alias("d2"),
    )


def rolling(
    df: DataFrame, means: Sequence[int] = (), stds: Sequence[int] = (), *, keys=KEYS, t="t", x="x", block=BLOCK
) -> DataFrame:
    """WIN-3, WIN-4: rolling mean and sample standard deviation, NULL until the window is full."""
    reach = max([*means, *stds]) - 1

    def layer(w):
        out = {f"mean_{n}": _full(w, n, F.avg("_v")) for n in means}
        return out | {f"std_{n}": _full(w, n, F.stddev_samp("_v")) for n in stds}

    return over_time(df.withColumn("_v", F.col(x)), layer, keys=keys, t=t, before=reach, block=block).drop("_v")


def rolling_iqr(df: DataFrame, width: int = 252, *, keys=KEYS, t="t", x="x", block=BLOCK) -> DataFrame:
    """WIN-7: interquartile range of each full trailing window."""

    def layer(w):
        frame = w.rowsBetween(-(width - 1), 0)
        q = lambda p: F.percentile("_v", p).over(frame)
        return {"iqr": F.when(F.count("_v").over(frame) == width, q(0.75) - q(0.25))}

    return over_time(df.withColumn("_v", F.col(x)), layer, keys=keys, t=t, before=width - 1, block=block).drop("_v")


def _cv(mean: Column, std: Column) -> Column:
    return F.when(mean > 0, std / mean).otherwise(0.0)


def amplitude_variability(df: DataFrame, width: int = 252, *, keys=KEYS, **kw) -> DataFrame:
    """WIN-5: how much the rolling standard deviation moves."""
    v = F.col(f"std_{width}")
    g = rolling(df, stds=[width], keys=keys, **kw).groupBy(*keys).agg(
        F.avg(v).alias("vol_mean"), F.stddev_samp(v).alias("vol_std"), F.max(v).alias("_hi"), F.min(v).alias("_lo")
    )
    return g.select(
        *keys, "vol_mean", "vol_std",
        _cv(F.col("vol_mean"), F.col("vol_std")).alias("vol_cv"),
        F.when(F.col("_lo") > 0, F.col("_hi") / F.col("_lo")).otherwise(0.0).alias("vol_max_min"),
        F.when(_cv(F.col("vol_mean"), F.col("vol_std")) > 0.3, "high").otherwise("moderate").alias("amplitude"),
    )


def frequency_variability(df: DataFrame, width: int = 252, *, keys=KEYS, t="t", x="x", block=1 << 14) -> DataFrame:
    """WIN-6: sign changes about the window's own mean in the ``width`` points before each row,
    and crossings of the rolling mean where it is defined.

    The own mean differs from window to window, so counts cannot be carried from row to row;
    each block with its halo is compared as one small array.
    """
    wide, _ = with_halo(df.select(*keys, t, F.col(x).cast("double").alias("x")), t=t, before=width + 1, block=block)
    size = max(block, width + 1)
    schema = T.StructType(
        [wide.schema[k] for k in keys]
        + [T.StructField("c", T.DoubleType()), T.StructField("turn", T.LongType())]
    )

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        own = (pdf[t] // size == pdf["_blk"]).to_numpy()
        v = pdf["x"].to_numpy()
        c, turn = np.full(len(v), np.nan), np.zeros(len(v), dtype="int64")
        if len(v) >= width:
            past = sliding_window_view(v, width)
            mean = np.concatenate([m.mean(axis=1) for m in np.array_split(past, len(past) // 4096 + 1)])
            for lo in range(0, len(past) - 1, 4096):
                hi = min(lo + 4096, len(past) - 1)
                side = np.sign(past[lo:hi] - mean[lo:hi, None])
                c[width + lo : width + hi] = (side[:, 1:] != side[:, :-1]).sum(axis=1)
            level = np.sign(v[width - 1 :] - mean)
            turn[width:] = level[1:] != level[:-1]
        out = pdf.loc[own, list(keys)].copy()
        out["c"], out["turn"] = c[own], turn[own]
        return out

    rows = wide.groupBy(*keys, "_blk").applyInPandas(count, schema)
    c = F.when(~F.isnan("c"), F.col("c"))
    g = rows.groupBy(*keys).agg(
        F.sum("turn").alias("crossings"), F.avg(c).alias("freq_mean"), F.stddev_pop(c).alias("freq_std")
    )
    cv = _cv(F.col("freq_mean"), F.col("freq_std"))
    return g.select(
        *keys, "crossings", "freq_mean", "freq_std", cv.alias("freq_cv"),
        F.when(cv > 0.3, "high").otherwise("moderate").alias("frequency"),
    )


def dispersion_variability(df: DataFrame, width: int = 252, *, keys=KEYS, **kw) -> DataFrame:
    """WIN-7 summary: mean, standard deviation and CV of the rolling IQR."""
    g = rolling_iqr(df, width, keys=keys, **kw).groupBy(*keys).agg(
        F.avg("iqr").alias("iqr_mean"), F.stddev_samp("iqr").alias("iqr_std")
    )
    return g.withColumn("iqr_cv", _cv(F.col("iqr_mean"), F.col("iqr_std")))


def local_maxima(df: DataFrame, *, keys=KEYS, t="t", x="x", block=BLOCK, rows: int | None = None) -> DataFrame:
    """WIN-8: peaks; a plateau counts once (reported at its middle, rounded down).

    The value before a run of equals and the start of the run are carried along the series,
    so a plateau may be of any length.
    """
    marked = over_time(
        df, lambda w: {"_p": F.lag(x).over(w), "_n": F.lead(x).over(w)}, keys=keys, t=t, before=1, after=1, block=block
    )
    new_run = F.col("_p").isNull() | (F.col("_p") != F.col(x))
    runs = scan(
        marked,
        {"_run": ("max", F.when(new_run, F.struct(F.col(t).alias("start"), F.col("_p").alias("prev"))))},
        keys=keys, t=t, block=block, rows=rows,
    )
    peak = (F.col("_run.prev") < F.col(x)) & (F.col("_n") < F.col(x))
    return runs.where(peak).select(*keys, F.floor((F.col("_run.start") + F.col(t)) / 2).alias(t), x)


def delay_embedding(
    df: DataFrame, tau: int, d: int, *, keys=KEYS, t="t", x="x", block=BLOCK, rows: int | None = None
) -> DataFrame:
    """WIN-10: rows (x_t, x_{t+tau}, ...) as array ``vec``; ``rows`` is checked against (d-1)*tau when given."""
    if tau < 1 or d < 1:
        raise ValueError("tau and d must be at least 1")
    reach = (d - 1) * tau
    if rows is not None and rows - reach <= 0:
        raise ValueError("series too short for this tau and d")
    out = over_time(
        df,
        lambda w: {f"_e{i}": F.lead(x, i * tau).over(w) for i in range(1, d)} | {"_e0": F.col(x)},
        keys=keys, t=t, after=reach, block=block,
    )
    return out.where(F.col(f"_e{d - 1}").isNotNull()).select(*keys, t, F.array(*[f"_e{i}" for i in range(d)]).alias("vec"))


def lagged_pairs(df: DataFrame, lags: int, *, keys=KEYS, t="t", x="x", block=BLOCK) -> DataFrame:
    """JN-4: rows (tau, t, x, y = x at t + tau) for tau = 1..lags, without a self-join."""
    wide = over_time(
        df, lambda w: {"_next": F.array(*[F.lead(x, k).over(w) for k in range(1, lags + 1)])},
        keys=keys, t=t, after=lags, block=block,
    )
    return (
        wide.select(*keys, t, x, F.posexplode("_next").alias("_k", "y"))
        .where(F.col("y").isNotNull())
        .select(*keys, (F.col("_k") + 1).alias("tau"), t, x, "y")
    )


def random_windows(
    df: DataFrame, max_size: int, min_size: int, *, mode: int = 1, count: int | None = None, seed: int = 0,
    keys=KEYS, t="t", x="x",
) -> DataFrame:
    """WIN-11: random windows, newest row first, sizes by hash.

    Mode 1 tiles the series without overlap (window ids from the newest end); mode 2 draws
    ``count`` overlapping windows and drops those of one row. In mode 1 the ends are running
    sums of the drawn sizes, block by block, so a long series spreads over many tasks.
    """
    if mode not in (1, 2):
        raise ValueError("mode must be 1 or 2")
    if mode == 2 and count is None:
        raise ValueError("count is required in mode 2")
    if not 1 <= min_size <= max_size:
        raise ValueError("sizes must satisfy 1 <= min_size <= max_size")
    sizes = df.groupBy(*keys).agg((F.max(t) + 1).alias("_n"))
    ident = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    if mode == 1:
        last = F.floor((F.col("_n") - 1) / min_size)  # draws are enough if all sizes are the least
        first = F.col("_block") * BLOCK
        draws = (
            sizes.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / BLOCK))))
            .select(*keys, "_n", F.explode(F.sequence(first, F.least(last, first + BLOCK - 1))).alias("window_id"))
            .withColumn("_size", between(min_size, max_size, ident, F.lit(0), F.col("window_id"), F.lit(seed)))
        )
        ends = scan(draws, {"_end": ("sum", F.col("_size"))}, keys=keys, t="window_id")
        spans = (
            ends.withColumn("_from", F.col("_end") - F.col("_size"))
            .where(F.col("_from") < F.col("_n"))
            .withColumn("_to", F.least("_end", "_n"))
        )
    else:
        spans = (
            sizes.withColumn("window_id", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
            .withColumn("_from", between(F.lit(0), F.col("_n") - 1, "start", ident, F.col("window_id"), F.lit(seed)))
            .withColumn("_left", F.col("_n") - F.col("_from"))
            .withColumn(
                "_to",
                F.col("_from")
                + between(
                    F.least(F.lit(min_size), F.col("_left")), F.least(F.lit(max_size), F.col("_left")),
                    "size", ident, F.col("window_id"), F.lit(seed),
                ),
            )
            .where(F.col("_to") - F.col("_from") > 1)
        )
    # newest first: rank r counts from the newest row, t = n - 1 - r; an equi-join, no range join
    picks = spans.select(
        *keys, "window_id", F.col("_from"), F.col("_n"),
        F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)).alias("_r"),
    ).select(*keys, "window_id", (F.col("_r") - F.col("_from")).alias("pos"), (F.col("_n") - 1 - F.col("_r")).alias(t))
    return picks.join(df.select(*keys, t, x), [*keys, t])


def split_windows(window_id: Column, *parts: Column, share: float = 0.8, seed: int = 0) -> Column:
    """WIN-12: 'train' or 'test' by hash of the window."""
    return F.when(uniform("split", *parts, window_id, F.lit(seed)) < share, "train").otherwise("test")


def pad_windows(windows: DataFrame, size: int, *, keys=KEYS, x="x") -> DataFrame:
    """WIN-13: per window arrays of length ``size``: values, mask, position. Windows hold at most ``size`` rows."""
    arr = F.transform(F.array_sort(F.collect_list(F.struct("pos", x))), lambda s: s[x])
    g = windows.groupBy(*keys, "window_id").agg(arr.alias("_v"))
    pad = F.lit(size) - F.size("_v")
    return g.select(
        *keys, "window_id",
        F.concat("_v", F.array_repeat(F.lit(0.0), pad)).alias("values"),
        F.concat(F.array_repeat(F.lit(1), F.size("_v")), F.array_repeat(F.lit(0), pad)).alias("mask"),
        F.sequence(F.lit(0), F.lit(size - 1)).alias("position"),
    )


def masked_squared_error(target: Column, guess: Column) -> Column:
    """WIN-14: mean squared error of two arrays over places where the target is not 0."""
    sq = F.zip_with(target, guess, lambda a, b: F.when(a != 0, (a - b) * (a - b)))
    kept = F.filter(sq, lambda v: v.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, b: a + b) / F.size(kept))


def with_series_length(df: DataFrame, *, keys=KEYS, t="t") -> DataFrame:
    """Add ``n``, the number of rows of the series."""
    last = df.groupBy(*keys).agg(F.max(t).alias("_last"))
    return attach(df, last.withColumn("n", F.col("_last") + 1), keys=keys, t=t)
