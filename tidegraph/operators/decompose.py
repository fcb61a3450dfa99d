"""Additive decompositions of many series at once: IMF_1 .. IMF_K and Residuo, long form.

Output: (keys, component, idx, t, x); the components of a position add up to the series.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.core import KEYS, cut
from tidegraph.functions.noise import gauss
from tidegraph.layout import BLOCK, attach, over_time, scan, summarise
from tidegraph.operators import aggregates as agg
from tidegraph.operators.shape import RESIDUAL, best_row, pivot_mean, stack
from tidegraph.operators.sifting import sift_series


def _turns(x: Column, p: Column, n: Column, tol: Column) -> tuple[Column, Column]:
    """(is a maximum, is a minimum) against both neighbours; steps within ``tol`` count as flat."""
    return (x - p > tol) & (x - n >= -tol), (p - x > tol) & (n - x >= -tol)


def _sift_pass(df: DataFrame, keys, t, h: str, block: int, rows: int, on: Column) -> DataFrame:
    """Where ``on`` holds, replace column ``h`` by h minus the mean of its two piecewise-linear envelopes."""
    base = list(df.columns)
    d = over_time(
        df, lambda w: {"_p": F.lag(h).over(w), "_n": F.lead(h).over(w)},
        keys=keys, t=t, before=1, after=1, block=block, rows=rows,
    )
    x = F.col(h)
    top, low = _turns(x, F.col("_p"), F.col("_n"), F.col("_tol"))
    here = F.struct(F.col(t).alias("t"), x.alias("x"))
    d = d.withColumns({"_max": F.when(top, here), "_min": F.when(low, here)})
    d = scan(d, {"_lmax": ("max", F.col("_max")), "_lmin": ("max", F.col("_min"))}, keys=keys, t=t, block=block, rows=rows)
    d = scan(d, {"_rmax": ("min", F.col("_max")), "_rmin": ("min", F.col("_min"))}, keys=keys, t=t, block=block, rows=rows, reverse=True)

    def envelope(left: str, right: str) -> Column:
        # outside the first / last knot the envelope is flat: the ends carry that knot's value
        a, b = F.col(left), F.col(right)
        frac = (F.col(t) - a["t"]) / (b["t"] - a["t"])
        return (
            F.when(a.isNull(), b["x"]).when(b.isNull() | (a["t"] == b["t"]), a["x"]).otherwise(a["x"] + (b["x"] - a["x"]) * frac)
        )

    mean = (envelope("_lmax", "_rmax") + envelope("_lmin", "_rmin")) / 2.0
    return d.withColumn(h, F.when(on, x - mean).otherwise(x)).select(*base)


def _extrema_counts(df: DataFrame, keys, t, x: str, block: int, rows: int | None = None, *more: Column) -> DataFrame:
    """Per key: numbers of maxima and minima, last position and ``more``; needs the flatness column ``_tol``."""
    d = over_time(
        df, lambda w: {"_p": F.lag(x).over(w), "_n": F.lead(x).over(w)},
        keys=keys, t=t, before=1, after=1, block=block, rows=rows,
    )
    top, low = _turns(F.col(x), F.col("_p"), F.col("_n"), F.col("_tol"))
    return d.groupBy(*keys).agg(
        F.count(F.when(top, 1)).alias("_maxima"), F.count(F.when(low, 1)).alias("_minima"), F.max(t).alias("_last"), *more
    )


FLAT = 1e-10


def sift(
    series: DataFrame, max_imf: int = 8, sifts: int = 5, *, keys=KEYS, t="t", x="x", block=BLOCK
) -> DataFrame:
    """DEC-1: empirical mode decomposition with piecewise-linear envelopes.

    A mode is what remains after ``sifts`` envelope subtractions; a series whose rest has
    fewer than two maxima or minima stops, its rest is the residual. Steps below 1e-10
    standard deviations of the series count as flat. Series of at most ``block`` rows are sifted
    whole in tasks of bounded size, longer ones by windows with one checkpoint per mode.
    """
    if max_imf < 1 or sifts < 1:
        raise ValueError("max_imf and sifts must be at least 1")
    base = series.select(*keys, t, F.col(x).cast("double").alias("_r"), F.lit(max_imf).alias("_most"), F.lit(sifts).alias("_passes"))
    return _sift_many(base, max_imf, sifts, keys, t, block)


def _sift_many(base: DataFrame, most: int, passes: int, keys, t, block: int) -> DataFrame:
    """``sift`` of many series at once, each with its own numbers of modes and passes: (keys, t, _r, _most, _passes).
    ``most`` and ``passes`` are the largest of these."""
    base = cut(base)
    last, n = base.agg(F.max(t), F.count(F.lit(1))).first()
    rows = 0 if last is None else int(last) + 1
    if rows <= block:
        return cut(sift_series(base, keys, t, n, FLAT, RESIDUAL))
    flat = _spread(base, keys, t, "_r", "_sd")
    state = cut(
        attach(base, flat, keys=keys, t=t).select(*keys, t, "_r", "_most", "_passes", (F.col("_sd") * FLAT).alias("_tol"))
    )
    modes: list[DataFrame] = []
    for k in range(1, most + 1):
        counts = cut(_extrema_counts(state, keys, t, "_r", block, rows, F.max("_most").alias("_most")))
        alive = (F.col("_maxima") >= 2) & (F.col("_minima") >= 2) & (F.col("_most") >= k)
        if counts.where(alive).isEmpty():
            break
        go = counts.select(*keys, "_last", alive.alias("_go"))
        work = attach(state, go, keys=keys, t=t).withColumn("_h", F.col("_r"))
        for done in range(passes):
            work = _sift_pass(work, keys, t, "_h", block, rows, F.col("_go") & (F.col("_passes") > done))
        work = cut(work)
        modes.append(
            work.where("_go").select(*keys, F.lit(f"IMF_{k}").alias("component"), F.lit(k).alias("idx"), t, F.col("_h").alias("x"))
        )
        state = work.select(
            *keys, t, F.when(F.col("_go"), F.col("_r") - F.col("_h")).otherwise(F.col("_r")).alias("_r"), "_most", "_passes", "_tol"
        )
    out = state.select(*keys, F.lit(RESIDUAL).alias("component"), (F.col("_most") + 1).alias("idx"), t, F.col("_r").alias("x"))
    for m in modes:
        out = out.unionByName(m)
    return out


def _spread(series: DataFrame, keys, t, x, name: str) -> DataFrame:
    return summarise(series, F.stddev_pop(x).alias(name), keys=keys, t=t)


def _with_residual(modes: DataFrame, series: DataFrame, keys, t, x, idx: int | Column) -> DataFrame:
    total = modes.groupBy(*keys, t).agg(F.sum("x").alias("_sum"))
    res = series.select(*keys, t, F.col(x).cast("double").alias("_x")).join(total, [*keys, t], "left")
    return modes.unionByName(
        res.select(
            *keys, F.lit(RESIDUAL).alias("component"), (F.lit(idx) if isinstance(idx, int) else idx).alias("idx"), t,
            (F.col("_x") - F.coalesce("_sum", F.lit(0.0))).alias("x"),
        )
    )


def _trials(df: DataFrame, trials: int) -> DataFrame:
    return df.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))


def ensemble_sift(
    series: DataFrame, trials: int = 100, noise_width: float = 0.05, seed: int = 42, max_imf: int = 8, sifts: int = 5,
    *, keys=KEYS, t="t", x="x", block=BLOCK,
) -> DataFrame:
    """DEC-2: mean of the modes over noisy copies; residual = series - sum of modes.

    Copies are independent keys, so the work spreads over (series, trial). A copy without
    mode k counts as 0 in the mean of mode k.
    """
    ident = [F.col(k).cast("string") for k in keys]
    spread = attach(series.select(*keys, t, F.col(x).alias("x")), _spread(series, keys, t, x, "_sd"), keys=keys, t=t)
    noisy = _trials(spread, trials).select(
        *keys, "trial", t,
        (F.col("x") + noise_width * F.col("_sd") * gauss(*ident, F.col("trial"), F.col(t), F.lit(seed))).alias("x"),
    )
    modes = sift(noisy, max_imf, sifts, keys=(*keys, "trial"), t=t, block=block).where(F.col("component") != RESIDUAL)
    mean = cut(modes.groupBy(*keys, "component", "idx", t).agg((F.sum("x") / trials).alias("x")))
    return _with_residual(mean, series, keys, t, x, max_imf + 1)


def adaptive_noise_sift(
    series: DataFrame, trials: int = 100, epsilon: float = 0.2, seed: int = 42, max_imf: int = 8, sifts: int = 5,
    *, keys=KEYS, t="t", x="x", block=BLOCK,
) -> DataFrame:
    """DEC-3: complete ensemble decomposition with adaptive noise (Torres et al. 2011).

    Stage k adds epsilon * std(rest) * (mode k-1 of the noise, unit variance) to the rest and
    averages the first modes. The noise is decomposed once.
    """
    ident = [F.col(k).cast("string") for k in keys]
    tk = (*keys, "trial")
    noise = cut(
        _trials(series.select(*keys, t), trials).select(*tk, t, gauss(*ident, F.col("trial"), F.col(t), F.lit(seed)).alias("x"))
    )
    first = noise.select(*tk, F.lit("IMF_0").alias("component"), F.lit(0).alias("idx"), t, "x")
    parts = cut(sift(noise, max_imf, sifts, keys=tk, t=t, block=block).where(F.col("component") != RESIDUAL).unionByName(first))
    unit = cut(_spread(parts, (*tk, "idx"), t, "x", "_sn"))
    first_rest = series.select(*keys, t, F.col(x).cast("double").alias("x"))
    rest = cut(
        attach(first_rest, _spread(first_rest, keys, t, "x", "_sd"), keys=keys, t=t).select(
            *keys, t, "x", (F.col("_sd") * FLAT).alias("_tol")
        )
    )
    modes = []
    for k in range(1, max_imf + 1):
        counts = cut(_extrema_counts(rest, keys, t, "x", block))
        alive = (F.col("_maxima") >= 2) & (F.col("_minima") >= 2)
        if counts.where(alive).isEmpty():
            break
        live = counts.where(alive).select(*keys, "_last").join(_spread(rest, keys, t, "x", "_sr").drop("_last"), list(keys))
        base = _trials(attach(rest, live, keys=keys, t=t), trials)
        n = parts.where(F.col("idx") == k - 1).drop("component")
        n = attach(n, unit.where(F.col("idx") == k - 1), keys=(*tk, "idx"), t=t).select(
            *tk, t, (F.col("x") / F.greatest("_sn", F.lit(1e-300))).alias("_noise")
        )
        noisy = base.join(n, [*tk, t], "left").select(
            *tk, t, (F.col("x") + epsilon * F.col("_sr") * F.coalesce("_noise", F.lit(0.0))).alias("x")
        )
        one = sift(noisy, 1, sifts, keys=tk, t=t, block=block).where(F.col("component") == "IMF_1")
        mode = cut(one.groupBy(*keys, t).agg((F.sum("x") / trials).alias("x")))
        modes.append(mode.select(*keys, F.lit(f"IMF_{k}").alias("component"), F.lit(k).alias("idx"), t, "x"))
        rest = cut(
            rest.join(mode.withColumnRenamed("x", "_m"), [*keys, t], "left").select(
                *keys, t, (F.col("x") - F.coalesce("_m", F.lit(0.0))).alias("x"), "_tol"
            )
        )
    out = rest.select(*keys, F.lit(RESIDUAL).alias("component"), F.lit(max_imf + 1).alias("idx"), t, "x")
    for m in modes:
        out = out.unionByName(m)
    return out


def band_split(series: DataFrame, k: int = 5, dc: int = 1, *, keys=KEYS, t="t", x="x", block=BLOCK) -> DataFrame:
    """DEC-4: K modes from differences of centred moving averages of half-width 1, 2, 4, ...

    dc = 0: modes from fast to slow, residual = widest average. dc = 1: mode 1 is the widest
    average (trend), the others from slow to fast, residual = series - sum (near 0). Ends
    use the part of the window inside the series. All averages share one window pass.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    d = _averages(series, k - 1 if dc == 1 else k, keys, t, x, block)
    return d.select(*keys, t, F.explode(F.array(*_band_cells(k, dc))).alias("_c")).select(*keys, "_c.component", "_c.idx", t, "_c.x")


def _averages(series: DataFrame, bands: int, keys, t, x, block: int) -> DataFrame:
    """The series as _m0 and its centred moving averages of half-width 1, 2, 4, ... as _m1 .. _m<bands>."""
    half = [2**i for i in range(bands)]
    return over_time(
        series.select(*keys, t, F.col(x).cast("double").alias("_m0")),
        lambda w: {f"_m{i + 1}": F.avg("_m0").over(w.rowsBetween(-h, h)) for i, h in enumerate(half)},
        keys=keys, t=t, before=half[-1], after=half[-1], block=block,
    )


def _band_cells(k: int, dc: int) -> list[Column]:
    """The components of ``band_split`` as structs (component, idx, x) over the columns of ``_averages``."""
    bands = k - 1 if dc == 1 else k
    band = [F.col(f"_m{i}") - F.col(f"_m{i + 1}") for i in range(bands)]
    modes = [F.col(f"_m{bands}"), *reversed(band)] if dc == 1 else band
    total = modes[0]
    for m in modes[1:]:
        total = total + m
    cells = [F.struct(F.lit(f"IMF_{i + 1}").alias("component"), F.lit(i + 1).alias("idx"), m.alias("x")) for i, m in enumerate(modes)]
    return [*cells, F.struct(F.lit(RESIDUAL).alias("component"), F.lit(k + 1).alias("idx"), (F.col("_m0") - total).alias("x"))]


METHODS = {"sift": sift, "ensemble": ensemble_sift, "adaptive": adaptive_noise_sift, "band": band_split}


def decompose(series: DataFrame, method: str, params: Mapping | None = None, *, keys=KEYS, t="t", x="x") -> DataFrame:
    """One decomposition by name, with a ``method`` column."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    out = METHODS[method](series, **(params or {}), keys=keys, t=t, x=x)
    return out.withColumn("method", F.lit(method))


def _pick(grid: Sequence[Mapping], name: str, default) -> Column:
    """Value of a parameter at the row's ``point``."""
    return F.get(F.array(*[F.lit(g.get(name, default)) for g in grid]), F.col("point"))


def _at_points(df: DataFrame, grid: Sequence[Mapping]) -> DataFrame:
    return df.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))))


def _sift_grid(series: DataFrame, grid: Sequence[Mapping], keys, t, x, block) -> DataFrame:
    base = _at_points(series.select(*keys, t, F.col(x).cast("double").alias("_r")), grid)
    base = base.withColumns({"_most": _pick(grid, "max_imf", 8), "_passes": _pick(grid, "sifts", 5)})
    return _sift_many(base, max(g.get("max_imf", 8) for g in grid), max(g.get("sifts", 5) for g in grid), (*keys, "point"), t, block)


def _ensemble_grid(series: DataFrame, grid: Sequence[Mapping], keys, t, x, block) -> DataFrame:
    ident, pk = [F.col(k).cast("string") for k in keys], (*keys, "point")
    spread = attach(series.select(*keys, t, F.col(x).alias("x")), _spread(series, keys, t, x, "_sd"), keys=keys, t=t)
    trials = _pick(grid, "trials", 100)
    copies = _at_points(spread, grid).withColumn("trial", F.explode(F.sequence(F.lit(0), trials - 1)))
    noise = gauss(*ident, F.col("trial"), F.col(t), _pick(grid, "seed", 42))
    noisy = copies.select(*pk, "trial", t, (F.col("x") + _pick(grid, "noise_width", 0.05) * F.col("_sd") * noise).alias("_r"))
    noisy = noisy.withColumns({"_most": _pick(grid, "max_imf", 8), "_passes": _pick(grid, "sifts", 5)})
    modes = _sift_many(noisy, max(g.get("max_imf", 8) for g in grid), max(g.get("sifts", 5) for g in grid), (*pk, "trial"), t, block)
    sums = modes.where(F.col("component") != RESIDUAL).groupBy(*pk, "component", "idx", t).agg(F.sum("x").alias("x"))
    mean = cut(sums.withColumn("x", F.col("x") / trials))
    return _with_residual(mean, _at_points(series.select(*keys, t, x), grid), pk, t, x, _pick(grid, "max_imf", 8) + 1)


def _band_grid(series: DataFrame, grid: Sequence[Mapping], keys, t, x, block) -> DataFrame:
    """All points share one window pass: the averages of the widest one are those of all others."""
    out = []
    for i, g in enumerate(grid):
        k, dc = g.get("k", 5), g.get("dc", 1)
        if k < 2:
            raise ValueError("k must be at least 2")
        out += [F.struct(F.lit(i).alias("point"), c.alias("c")) for c in _band_cells(k, dc)]
    d = _averages(series, max(g.get("k", 5) - (g.get("dc", 1) == 1) for g in grid), keys, t, x, block)
    cells = d.select(*keys, t, F.explode(F.array(*out)).alias("_p"))
    return cells.select(*keys, "_p.point", "_p.c.component", "_p.c.idx", t, "_p.c.x")


#: Methods whose grids run as one plan, the point a part of the key; others run point by point.
GRIDS = {"sift": _sift_grid, "ensemble": _ensemble_grid, "band": _band_grid}


def evaluate_grid(series: DataFrame, method: str, grid: Sequence[Mapping], *, keys=KEYS, t="t", x="x", block=BLOCK) -> tuple[DataFrame, DataFrame]:
    """(evaluations, components) of a method on a parameter grid; ``point`` numbers the grid."""
    if not grid:
        raise ValueError("empty grid")
    if method in GRIDS:
        comps = GRIDS[method](series, grid, tuple(keys), t, x, block)
    else:
        comps = None
        for i, g in enumerate(grid):
            c = decompose(series, method, g, keys=keys, t=t, x=x).drop("method").withColumn("point", F.lit(i))
            comps = c if comps is None else comps.unionByName(c)
    comps = cut(comps)
    q = agg.quality(comps, series, keys=(*keys, "point"), skeys=keys, t=t)
    names = F.array(*[F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in g.items()])) for g in grid])
    return q.withColumn("params", F.get(names, F.col("point"))), comps


def calibrate(series: DataFrame, method: str, grid: Sequence[Mapping], *, max_rmse=1e-10, digits=9, keys=KEYS, t="t") -> DataFrame:
    """DEC-5: valid points (relative RMSE below ``max_rmse``), least pair correlation, then least residual share."""
    e, _ = evaluate_grid(series, method, grid, keys=keys, t=t)
    order = [F.round("pair_corr", digits), F.round("residual_share", digits), F.col("point")]
    return best_row(e.where(F.col("rel_rmse") < max_rmse), order, keys=keys)


def calibrate_linear_residual(
    series: DataFrame, method: str, grid: Sequence[Mapping], *, reference: int = 0, max_rmse=1e-10, digits=9, keys=KEYS, t="t"
) -> DataFrame:
    """DEC-6: best point for a linear rising residual, best separation, and the reference point.

    Rows carry ``choice`` = 'linear_residual', 'separation' or 'reference'.
    """
    e, comps = evaluate_grid(series, method, grid, keys=keys, t=t)
    lin = agg.residual_linearity(comps.where(F.col("component") == RESIDUAL), keys=(*keys, "point"), t=t)
    both = cut(e.join(lin, [*keys, "point"]).withColumn("n_imfs", F.col("modes") - 1))
    ok = both.where(F.col("rel_rmse") < max_rmse)
    r = lambda c: F.round(c, digits)
    linear = [
        (~F.col("rising")).cast("int"), (F.col("slope") <= 0).cast("int"), -F.col("n_imfs"), -r("r2"), -r("rise_share"),
        r("line_rmse"), r("rel_rmse"), r("pair_corr"), F.col("point"),
    ]
    apart = [r("pair_corr"), r("residual_share"), F.col("point")]
    return stack(
        {
            "linear_residual": best_row(ok, linear, keys=keys),
            "separation": best_row(ok, apart, keys=keys),
            "reference": both.where(F.col("point") == reference),
        },
        "choice",
    )


def compare_methods(series: DataFrame, methods: Mapping[str, Mapping], *, keys=KEYS, t="t") -> tuple[DataFrame, DataFrame]:
    """DEC-7: (metrics table over series and methods, mean table with one column set per method)."""
    comps = None
    for name, params in methods.items():
        c = decompose(series, name, params, keys=keys, t=t)
        comps = c if comps is None else comps.unionByName(c)
    comps = cut(comps)
    q = agg.quality(comps, series, keys=(*keys, "method"), skeys=keys, t=t)
    wide = pivot_mean(q, keys[0], "method", ["rel_rmse", "pair_corr", "residual_share"], list(methods))
    return q, wide
