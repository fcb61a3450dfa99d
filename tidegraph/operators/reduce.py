"""Component reduction: standardisation, PCA, ICA, reconstruction, and the choice of k.

A matrix is (keys, t, vec ARRAY<DOUBLE>) with p entries per row. Plans work on whole arrays, so their size does not
grow with p squared; moments are sums per key taken before the shuffle, p x p algebra runs per key on one small row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidegraph.core import KEYS, cut, ship
from tidegraph.layout import attach, deal
from tidegraph.operators.aggregates import CELLS
from tidegraph.operators.dependence import correlation_summary, rank_correlation

MODEL = "mean array<double>, scale array<double>, unmix array<array<double>>, mix array<array<double>>, ratio array<double>"


def as_matrix(comps: DataFrame, p: int, *, keys=KEYS, t="t") -> DataFrame:
    """Long components idx = 1..p to one array per position."""
    cells = F.array_sort(F.collect_list(F.struct("idx", "x")))
    rows = comps.where(F.col("idx") <= p).groupBy(*keys, t).agg(cells.alias("_c"))
    return rows.where(F.size("_c") == p).select(*keys, t, F.transform("_c", lambda c: c["x"]).alias("vec"))


def as_components(matrix: DataFrame, prefix: str = "Z_", *, keys=KEYS, t="t") -> DataFrame:
    return matrix.select(*keys, t, F.posexplode("vec").alias("_i", "x")).select(
        *keys, F.concat(F.lit(prefix), (F.col("_i") + 1).cast("string")).alias("component"), (F.col("_i") + 1).alias("idx"), t, "x"
    )


def _entry(i: int) -> Column:
    return F.get("vec", F.lit(i))


def _means(matrix: DataFrame, p: int, keys, t) -> DataFrame:
    """Mean, population standard deviation of every column, and the last position, as a written table: one small row a key."""
    cells = matrix.select(*keys, t, F.posexplode_outer("vec").alias("_i", "_x"))
    each = cells.groupBy(*keys, "_i").agg(F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("scale"), F.max(t).alias("_last"))
    entry = F.when(F.col("_i").isNotNull(), F.struct("_i", F.struct("mean", "scale")))
    g = each.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_of"), F.max("_last").alias("_last"))
    entries = F.transform(F.array(*[F.lit(i) for i in range(p)]), lambda i: F.try_element_at("_of", i))
    return cut(g.select(*keys, entries["mean"].alias("mean"), entries["scale"].alias("scale"), "_last"))


def _scaled() -> Column:
    centred = F.zip_with("vec", "mean", lambda x, m: x - m)
    return F.zip_with(centred, "scale", lambda x, s: x / F.when(s > 0, s).otherwise(1.0))


def standardise(matrix: DataFrame, p: int, *, keys=KEYS, t="t") -> DataFrame:
    """RED-1: zero mean and unit population standard deviation per column; constant columns become 0."""
    return attach(matrix, _means(matrix, p, keys, t), keys=keys, t=t).select(*keys, t, _scaled().alias("vec"))


def _dot(weights: Column, values: Column | str) -> Column:
    return F.aggregate(F.zip_with(weights, values, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def _times(matrix: str, values: Column | str) -> Column:
    """Product of an array of rows with a vector."""
    return F.transform(matrix, lambda row: _dot(row, values))


def pca_model(matrix: DataFrame, p: int, k: int | None = None, *, keys=KEYS, t="t") -> DataFrame:
    """RED-2: model row per key: mean, scale, unmix (k x p), mix (p x k), ratio of explained variance.

    Large keys are dealt to groups of about ``CELLS`` entries, a group gives its sums of products of all columns at once;
    then an eigenproblem per key. Largest |loading| of each component is positive.
    """
    k = k or p
    if not 1 <= k <= p:
        raise ValueError("k must be between 1 and p")
    stats = _means(matrix, p, keys, t)
    rows = attach(matrix, stats, keys=keys, t=t)
    zs = rows.where(F.col("vec").isNotNull()).select(*keys, t, F.slice(_scaled(), 1, p).alias("vec"))
    schema = T.StructType([zs.schema[k] for k in keys]).add("_s", T.ArrayType(T.DoubleType())).add("_n", T.ArrayType(T.DoubleType()))

    def products(rows: pa.Table) -> pa.Table:
        """Sums and counts of the products of all columns over one part of a matrix."""
        flat = rows["vec"].combine_chunks().flatten()
        z, has = flat.fill_null(0.0).to_numpy().reshape(-1, p), (~flat.is_null().to_numpy(False)).astype(float).reshape(-1, p)
        key = {k: rows[k].slice(0, 1) for k in keys}
        return pa.table({**key, "_s": [(z.T @ z).ravel()], "_n": [(has.T @ has).ravel()]}).cast(to_arrow_schema(schema))

    ship(matrix.sparkSession)
    parts = deal(zs, max(CELLS // p, 1), keys=keys, t=t).drop(t).groupBy(*keys, "_part").applyInArrow(products, schema)
    cells = parts.select(*keys, F.posexplode(F.arrays_zip("_s", "_n")).alias("_i", "_c"))
    cells = cells.groupBy(*keys, "_i").agg(F.try_divide(F.sum("_c._s"), F.sum("_c._n")).alias("_line"))
    g = cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_line"))), lambda r: r["_line"]).alias("cov"))
    g = g.join(stats, list(keys))

    @F.pandas_udf("unmix array<array<double>>, mix array<array<double>>, ratio array<double>, vals array<double>")
    def solve(cov: pd.Series) -> pd.DataFrame:
        out = []
        for flat in cov:
            m = np.asarray(flat, dtype=float).reshape(p, p)
            m = (m + m.T) / 2
            vals, vecs = np.linalg.eigh(m)
            order = np.argsort(-vals, kind="stable")
            vals, vecs = np.maximum(vals[order], 0.0), vecs[:, order].T
            flip = np.sign(vecs[np.arange(p), np.argmax(np.abs(np.round(vecs, 9)), axis=1)])
            vecs = (vecs * flip[:, None])[:k]
            out.append((vecs.tolist(), vecs.T.tolist(), (vals[:k] / vals.sum()).tolist(), vals[:k].tolist()))
        return pd.DataFrame(out, columns=["unmix", "mix", "ratio", "vals"])

    return cut(g.select(*keys, "_last", "mean", "scale", solve("cov").alias("_s")).select(*keys, "_last", "mean", "scale", "_s.*"))


def transform(matrix: DataFrame, model: DataFrame, p: int, k: int, *, keys=KEYS, t="t") -> DataFrame:
    """Scores of a PCA or ICA model: (keys, t, vec of length k)."""
    rows = attach(matrix, model.select(*keys, "_last", "mean", "scale", "unmix"), keys=keys, t=t)
    return rows.withColumn("_z", _scaled()).select(*keys, t, _times("unmix", "_z").alias("vec"))


def inverse(scores: DataFrame, model: DataFrame, p: int, k: int, *, keys=KEYS, t="t") -> DataFrame:
    """RED-4: back to the original columns and units."""
    rows = attach(scores, model.select(*keys, "_last", "mean", "scale", "mix"), keys=keys, t=t)
    back = F.zip_with(_times("mix", "vec"), "scale", lambda x, s: x * s)
    return rows.select(*keys, t, F.zip_with(back, "mean", lambda x, m: x + m).alias("vec"))


def explained(model: DataFrame, *, keys=KEYS) -> DataFrame:
    """(keys, idx, ratio, cumulative)."""
    d = model.select(*keys, "ratio", F.posexplode("ratio").alias("_i", "r"))
    total = F.aggregate(F.slice("ratio", F.lit(1), F.col("_i") + 1), F.lit(0.0), lambda a, b: a + b)
    return d.select(*keys, (F.col("_i") + 1).alias("idx"), F.col("r").alias("ratio"), total.alias("cumulative"))


def ica_model(
    matrix: DataFrame, p: int, k: int, *, seed: int = 42, tol: float = 1e-4, max_rounds: int = 200, keys=KEYS, t="t"
) -> DataFrame:
    """RED-3: FastICA (parallel, logcosh, unit-variance sources) for every key at once.

    Data are whitened once and checkpointed; a round is one aggregate of k*k + k sums per
    key and a k x k step per key. Sources are ordered by explained variance, the largest
    mixing entry of each is positive. ``converged`` tells whether a key met ``tol``.
    """
    base = pca_model(matrix, p, k, keys=keys, t=t)
    rows = attach(matrix, base.select(*keys, "_last", "mean", "scale", "unmix", "vals"), keys=keys, t=t)
    scores = rows.withColumn("_z", _scaled()).select(*keys, t, "vals", _times("unmix", "_z").alias("vec"))
    white = cut(scores.select(*keys, t, F.zip_with("vec", "vals", lambda x, v: x / F.sqrt(F.greatest(v, F.lit(1e-12)))).alias("vec")))
    start = np.random.default_rng(seed).standard_normal((k, k))

    def decorrelate(w: np.ndarray) -> np.ndarray:
        s, u = np.linalg.eigh(w @ w.T)
        return (u / np.sqrt(np.maximum(s, 1e-12))) @ u.T @ w

    w0 = decorrelate(start)
    literal = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in w0])
    state = cut(base.select(*keys, "_last", literal.alias("w"), F.lit(float("inf")).alias("move")))
    z = [_entry(i) for i in range(k)]

    @F.pandas_udf("w array<array<double>>, move double")
    def step(w: pd.Series, eg: pd.Series, ed: pd.Series, move: pd.Series) -> pd.DataFrame:
        out = []
        for old, g, d, m in zip(w, eg, ed, move):
            old = np.array([list(r) for r in old], dtype=float)
            if m < tol:
                out.append((old.tolist(), m))
                continue
            new = decorrelate(np.asarray(g, dtype=float).reshape(k, k) - np.asarray(d, dtype=float)[:, None] * old)
            out.append((new.tolist(), float(np.max(np.abs(np.abs(np.sum(new * old, axis=1)) - 1)))))
        return pd.DataFrame(out, columns=["w", "move"])

    for _ in range(max_rounds):
        r = attach(white, state.where(F.col("move") >= tol), keys=keys, t=t)
        r = r.select(*keys, "vec", *[F.tanh(_dot(F.get("w", F.lit(i)), "vec")).alias(f"_g{i}") for i in range(k)])
        sums = r.groupBy(*keys).agg(
            F.array(*[F.avg(F.col(f"_g{i}") * z[j]) for i in range(k) for j in range(k)]).alias("eg"),
            F.array(*[F.avg(1 - F.col(f"_g{i}") * F.col(f"_g{i}")) for i in range(k)]).alias("ed"),
        )
        fill = F.array(*[F.lit(0.0)] * (k * k))
        nxt = state.join(sums, list(keys), "left").select(
            *keys, "_last", step("w", F.coalesce("eg", fill), F.coalesce("ed", F.slice(fill, 1, k)), "move").alias("_s")
        )
        state = cut(nxt.select(*keys, "_last", "_s.*"))
        if state.where(F.col("move") >= tol).isEmpty():
            break

    @F.pandas_udf("unmix array<array<double>>, mix array<array<double>>, ratio array<double>")
    def finish(w: pd.Series, unmix: pd.Series, vals: pd.Series) -> pd.DataFrame:
        out = []
        for wi, e, v in zip(w, unmix, vals):
            wi = np.array([list(r) for r in wi], dtype=float)
            e = np.array([list(r) for r in e], dtype=float)
            v = np.maximum(np.asarray(v, dtype=float), 1e-12)
            mix = (wi @ (e * np.sqrt(v)[:, None])).T
            un = wi @ (e / np.sqrt(v)[:, None])
            power = (mix**2).sum(axis=0)
            order = np.argsort(-power, kind="stable")
            flip = np.sign(mix[np.argmax(np.abs(mix), axis=0), np.arange(k)])[order]
            out.append(((un[order] * flip[:, None]).tolist(), (mix[:, order] * flip).tolist(), (power[order] / p).tolist()))
        return pd.DataFrame(out, columns=["unmix", "mix", "ratio"])

    m = base.drop("ratio", "mix").join(state.drop("_last"), list(keys)).select(
        *keys, "_last", "mean", "scale", finish("w", "unmix", "vals").alias("_s"), (F.col("move") < tol).alias("converged")
    )
    return cut(m.select(*keys, "_last", "mean", "scale", "_s.*", "converged"))


def model_table(model: DataFrame, *, keys=KEYS) -> DataFrame:
    """Model as rows (keys, name, row, values)."""
    one = [F.struct(F.lit(n).alias("name"), F.array(F.col(n)).alias("rows")) for n in ("mean", "scale")]
    two = [F.struct(F.lit(n).alias("name"), F.col(n).alias("rows")) for n in ("mix", "unmix")]
    d = model.select(*keys, F.explode(F.array(*one, *two)).alias("_m"))
    return d.select(*keys, "_m.name", F.posexplode("_m.rows").alias("row", "values"))


def reconstruction_by_column(matrix: DataFrame, guess: DataFrame, p: int, *, keys=KEYS, t="t") -> DataFrame:
    """RED-5: (keys, column, r2, rmse) from the matrix and its reconstruction."""
    both = matrix.join(guess.select(*keys, t, F.col("vec").alias("hat")), [*keys, t])
    cells = both.select(*keys, F.posexplode(F.arrays_zip("vec", "hat")).alias("column", "_c"))
    e = F.col("_c.vec") - F.col("_c.hat")
    g = cells.groupBy(*keys, (F.col("column") + 1).alias("column")).agg(
        F.sum(e * e).alias("ss_res"), F.var_pop("_c.vec").alias("_v"), F.count(F.lit(1)).alias("n"),
        F.sum(F.col("_c.vec") ** 2).alias("ss"),
    )
    tot = F.col("_v") * F.col("n")
    return g.select(
        *keys, "column", F.when(tot > 1e-30, 1 - F.col("ss_res") / tot).otherwise(0.0).alias("r2"),
        F.sqrt(F.col("ss_res") / F.col("n")).alias("rmse"), "ss_res", "ss", "n",
    )


def reconstruction_metrics(by_column: DataFrame, *, keys=KEYS) -> DataFrame:
    """RED-5: global RMSE, relative Frobenius error, mean R2."""
    return by_column.groupBy(*keys).agg(
        F.sqrt(F.sum("ss_res") / F.sum("n")).alias("rmse"),
        F.when(F.sum("ss") > 0, F.sqrt(F.sum("ss_res")) / F.sqrt(F.sum("ss"))).otherwise(0.0).alias("frobenius"),
        F.avg("r2").alias("r2_mean"),
    )


def ica_grid(matrix: DataFrame, p: int, ks: Sequence[int] | None = None, *, seed=42, max_rounds=200, keys=KEYS, t="t") -> DataFrame:
    """RED-6: (keys, k, r2_mean, frobenius, rmse, max_corr, converged) for k = 2 .. p - 1."""
    out = None
    for k in ks or range(2, p):
        m = ica_model(matrix, p, k, seed=seed, max_rounds=max_rounds, keys=keys, t=t)
        z = transform(matrix, m, p, k, keys=keys, t=t)
        back = inverse(z, m, p, k, keys=keys, t=t)
        fit = reconstruction_metrics(reconstruction_by_column(matrix, back, p, keys=keys, t=t), keys=keys)
        corr = correlation_summary(as_components(z, keys=keys, t=t), keys=keys, t=t).select(*keys, F.col("max_abs").alias("max_corr"))
        row = fit.join(corr, list(keys)).join(m.select(*keys, "converged"), list(keys)).withColumn("k", F.lit(k))
        out = row if out is None else out.unionByName(row)
    return cut(out)


def knee(curve: DataFrame, k: str = "k", y: str = "y", *, keys=KEYS) -> DataFrame:
    """RED-7: (keys, knee): k of the largest distance to the line between first and last point."""
    ends = curve.groupBy(*keys).agg(
        F.min(k).alias("_k0"), F.max(k).alias("_k1"), F.min_by(y, k).alias("_y0"), F.max_by(y, k).alias("_y1")
    )
    d = curve.join(ends, list(keys))
    kn = (F.col(k) - F.col("_k0")) / (F.col("_k1") - F.col("_k0") + 1e-12)
    yn = (F.col(y) - F.col("_y0")) / (F.col("_y1") - F.col("_y0") + 1e-12)
    gap = F.round(F.abs(yn - kn) / float(np.sqrt(2.0)), 12)
    return d.groupBy(*keys).agg(F.min_by(k, F.struct((-gap).alias("a"), F.col(k).alias("b"))).alias("knee"))


def viable_points(grid: DataFrame, limit: float = 0.01, *, keys=KEYS) -> DataFrame:
    """RED-8: points with max |corr| below the limit, else the half with the smallest."""
    w = Window.partitionBy(*keys)
    ranked = grid.withColumns(
        {
            "_ok": F.count(F.when(F.col("max_corr") < limit, 1)).over(w),
            "_half": F.greatest(F.floor(F.count(F.lit(1)).over(w) / 2), F.lit(1)),
            "_r": F.row_number().over(w.orderBy("max_corr", "k")),
        }
    )
    keep = F.when(F.col("_ok") > 0, F.col("max_corr") < limit).otherwise(F.col("_r") <= F.col("_half"))
    return ranked.where(keep).drop("_ok", "_half", "_r")


def choose_k(
    grid: DataFrame, p: int, *, limit=0.01, r2_share=0.72, error_factor=1.15, keys=KEYS
) -> DataFrame:
    """RED-8: chosen k per key with knee, thresholds and the composite score."""
    v = viable_points(grid, limit, keys=keys)
    top = v.groupBy(*keys).agg(F.max("r2_mean").alias("r2_max"), F.max("frobenius").alias("err_max"))
    kn = knee(v.withColumn("y", F.col("r2_mean")), keys=keys)
    ref = v.join(kn, list(keys)).where(F.col("k") == F.col("knee")).select(*keys, "knee", F.col("frobenius").alias("err_ref"))
    d = v.join(top, list(keys)).join(ref, list(keys))
    good = (F.col("r2_mean") >= r2_share * F.col("r2_max")) & (F.col("frobenius") <= error_factor * F.col("err_ref"))
    pick = d.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(good, F.col("k"))), F.max("knee")).alias("k"),
        F.max("knee").alias("knee"), F.max("r2_max").alias("r2_max"), F.max("err_max").alias("err_max"), F.max("err_ref").alias("err_ref"),
    )
    r = pick.join(grid, [*keys, "k"])
    r2n = F.when(F.col("r2_max") > 1e-12, F.col("r2_mean") / F.col("r2_max")).otherwise(0.0)
    errn = F.when(F.col("err_max") > 1e-12, F.col("frobenius") / F.col("err_max")).otherwise(0.0)
    indep = F.when(F.col("max_corr") < limit, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("max_corr") / max(limit, 1e-12)))
    score = 0.45 * r2n + 0.25 * (1 - errn) + 0.20 * indep + 0.10 * (1 - F.col("k") / float(p))
    return r.select(*keys, "k", "knee", "err_ref", "r2_max", "r2_mean", "frobenius", "max_corr", score.alias("score"))


def choose_k_by_reference(grid: DataFrame, reference: int, p: int, *, limit=0.01, r2_share=0.90, keys=KEYS) -> DataFrame:
    """RED-9: the reference k if it is independent, else the smallest k with enough R2."""
    top = grid.groupBy(*keys).agg(F.max("r2_mean").alias("r2_max"))
    d = grid.join(top, list(keys))
    at_ref = F.max(F.when((F.col("k") == reference) & (F.col("max_corr") < limit) & F.lit(reference < p), F.col("k")))
    enough = F.min(F.when(F.col("r2_mean") >= r2_share * F.col("r2_max"), F.col("k")))
    fallback = F.max_by("k", "r2_mean")
    return d.groupBy(*keys).agg(F.coalesce(at_ref, enough, fallback).alias("k"), at_ref.isNotNull().alias("is_reference"))


def reduction_report(before: DataFrame, after: DataFrame, *, limit=0.01, keys=KEYS, t="t") -> DataFrame:
    """RED-10: pair correlation of components before and of channels after the reduction."""
    parts = []
    for name, c in (("before", before), ("after", after)):
        s = correlation_summary(c, keys=keys, t=t)
        r = rank_correlation(c, keys=keys, t=t).groupBy(*keys).agg(F.max(F.abs("r")).alias("max_spearman"))
        parts.append(s.join(r, list(keys)).withColumn("stage", F.lit(name)))
    return parts[0].unionByName(parts[1]).withColumn("independent", F.col("max_abs") < limit)
