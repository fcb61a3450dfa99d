"""Pairwise distances inside a key, as bounded tiles.

Points of a key are sorted by their first coordinate and cut into blocks of ``SIZE``
points; a tile is a pair of blocks. Tiles whose first coordinates are farther apart than
the radius are never formed, every tile costs at most SIZE**2 distances, and tiles of one
key spread over all tasks, so a key with a third of all points is not a hot task. Only
results leave a tile: pairs within the radius, counts, or the best neighbour per point.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.core import KEYS, cut
from tidegraph.layout import attach, ordered_position, scan

SIZE = 256
MERGE = 64


def _blocks(points: DataFrame, keys, size: int) -> DataFrame:
    """(keys, blk, lo, hi, ids, flat, extras): blocks of points in first-coordinate order."""
    pos = ordered_position(points.withColumn("_x0", F.col("vec")[0]), ["_x0", "node"], keys=keys, name="_pos")
    member = F.struct("_pos", "node", "vec")
    g = pos.groupBy(*keys, F.floor(F.col("_pos") / size).cast("long").alias("blk")).agg(
        F.array_sort(F.collect_list(member)).alias("_m"),
        F.min("_x0").alias("lo"), F.max("_x0").alias("hi"),
    )
    return cut(
        g.select(
            *keys, "blk", "lo", "hi",
            F.transform("_m", lambda m: m["node"]).alias("ids"),
            F.flatten(F.transform("_m", lambda m: m["vec"])).alias("flat"),
        )
    )


def _count_not_above(meta: DataFrame, values: Column, limits: Column, keys, name: str, strict: bool) -> DataFrame:
    """(keys, blk, name): number of blocks of the key whose value is <= (or <, strict) the limit of blk."""
    # at equal numbers, a limit sorts after values for <=, before them for <
    first = meta.select(*keys, "blk", values.alias("_v"), F.lit(1).alias("_kind"))
    second = meta.select(*keys, "blk", limits.alias("_v"), F.lit(0 if strict else 2).alias("_kind"))
    ordered = ordered_position(first.unionByName(second), ["_v", "_kind", "blk"], keys=keys, name="_e")
    counted = scan(ordered, {name: ("sum", (F.col("_kind") == 1).cast("long"))}, keys=keys, t="_e")
    return counted.where(F.col("_kind") != 1).select(*keys, "blk", name)


def _tile_list(blocks: DataFrame, keys, reach: Column, *, directed: bool) -> DataFrame:
    """(keys, a, b) of blocks whose first-coordinate gap is at most ``reach`` of block a."""
    meta = blocks.select(*keys, "blk", "lo", "hi", reach.alias("_r"))
    last = _count_not_above(meta, F.col("lo"), F.col("hi") + F.col("_r"), keys, "_last", strict=False)
    spans = last
    if directed:
        first = _count_not_above(meta, F.col("hi"), F.col("lo") - F.col("_r"), keys, "_first", strict=True)
        spans = last.join(first, [*keys, "blk"])
        start = F.col("_first")
    else:
        start = F.col("blk")
    return spans.select(
        *keys, F.col("blk").alias("a"), F.explode(F.sequence(start, F.greatest(F.col("_last") - 1, start))).alias("b")
    )


def _load_tiles(blocks: DataFrame, tiles: DataFrame, keys, extra: Sequence[str] = ()) -> DataFrame:
    left = blocks.select(*keys, F.col("blk").alias("a"), F.col("ids").alias("ia"), F.col("flat").alias("fa"), *extra)
    right = blocks.select(*keys, F.col("blk").alias("b"), F.col("ids").alias("ib"), F.col("flat").alias("fb"))
    return tiles.join(left, [*keys, "a"]).join(right, [*keys, "b"]).repartition(*keys, "a", "b")


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distance of every row of a to every row of b, coordinate by coordinate."""
    out = np.zeros((len(a), len(b)))
    for c in range(a.shape[1]):
        d = a[:, c][:, None] - b[:, c][None, :]
        if metric == "chebyshev":
            np.maximum(out, np.abs(d), out=out)
        else:
            out += d * d
    return out if metric == "chebyshev" else np.sqrt(out)


def _run(
    tiles: DataFrame, keys, fields: list[T.StructField], work: Callable[[pd.Series, np.ndarray], dict | None], metric: str
) -> DataFrame:
    """Apply ``work(row, distance matrix)`` to every tile; it returns equal-length columns."""
    names = [f.name for f in fields]
    key_fields = [tiles.schema[k] for k in keys]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, rows = [], 0
            for row in batch.itertuples(index=False):
                a = np.asarray(row.fa, dtype=float).reshape(len(row.ia), -1)
                b = np.asarray(row.fb, dtype=float).reshape(len(row.ib), -1)
                cols = work(row, distances(a, b, metric))
                if cols is None:
                    continue
                part = pd.DataFrame(cols, columns=names)
                for k in reversed(keys):
                    part.insert(0, k, getattr(row, k))
                held.append(part)
                rows += len(part)
                if rows >= 65536:
                    yield pd.concat(held, ignore_index=True)
                    held, rows = [], 0
            if held:
                yield pd.concat(held, ignore_index=True)

    return tiles.mapInPandas(apply, T.StructType(key_fields + fields))


def _same(row) -> np.ndarray:
    return np.asarray(row.ia)[:, None] == np.asarray(row.ib)[None, :]


def near_pairs(points: DataFrame, radius: DataFrame, *, keys=KEYS, metric="euclidean", size=SIZE) -> DataFrame:
    """JN-5: pairs (src < dst in block order, dist) of points (keys, node, vec) with dist <= radius(keys, r)."""
    blocks = _blocks(points, keys, size)
    last = blocks.groupBy(*keys).agg(F.max("blk").alias("_last"))
    blocks = attach(blocks, radius.join(last, list(keys)), keys=keys, t="blk")
    tiles = _load_tiles(blocks, _tile_list(blocks, keys, F.col("r"), directed=False), keys, ["r"])

    def work(row, d):
        hit = d <= row.r
        if row.a == row.b:
            hit &= np.triu(np.ones_like(hit), 1)
        i, j = np.nonzero(hit)
        if not len(i):
            return None
        return {"src": np.asarray(row.ia)[i], "dst": np.asarray(row.ib)[j], "dist": d[i, j]}

    fields = [T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("dist", T.DoubleType())]
    return _run(tiles, keys, fields, work, metric)


def pair_counts(
    points: DataFrame, radii: DataFrame, *, keys=KEYS, metric="chebyshev", strict=False, size=SIZE
) -> DataFrame:
    """(keys, k, pairs): number of unordered pairs within each radius of radii(keys, rs ARRAY)."""
    blocks = _blocks(points, keys, size)
    last = blocks.groupBy(*keys).agg(F.max("blk").alias("_last"))
    blocks = attach(blocks, radii.join(last, list(keys)), keys=keys, t="blk")
    tiles = _load_tiles(blocks, _tile_list(blocks, keys, F.array_max("rs"), directed=False), keys, ["rs"])

    def work(row, d):
        values = d[np.triu_indices(len(d), 1)] if row.a == row.b else d.ravel()
        values = np.sort(values)
        counts = np.searchsorted(values, np.asarray(row.rs, dtype=float), side="left" if strict else "right")
        return {"k": np.arange(len(counts)), "pairs": counts}

    fields = [T.StructField("k", T.IntegerType()), T.StructField("pairs", T.LongType())]
    return _run(tiles, keys, fields, work, metric).groupBy(*keys, "k").agg(F.sum("pairs").alias("pairs"))


def nearest(points: DataFrame, *, keys=KEYS, min_gap: int = 0, metric="euclidean", size=SIZE) -> DataFrame:
    """Nearest other point of the key: (keys, node, other, dist), ties to the smaller node.

    ``min_gap`` asks for |node - other| > min_gap. A first round looks at the own and the
    next block only and gives an upper bound per block; the second round visits exactly the
    blocks that the bound leaves open.
    """
    blocks = _blocks(points, keys, size)

    def work(row, d):
        ia, ib = np.asarray(row.ia), np.asarray(row.ib)
        d = np.where(np.abs(ia[:, None] - ib[None, :]) <= min_gap, np.inf, d)
        order = np.argsort(ib, kind="stable")
        best = order[np.argmin(d[:, order], axis=1)]
        dist = d[np.arange(len(ia)), best]
        ok = np.isfinite(dist)
        return {"node": ia[ok], "other": ib[best][ok], "dist": dist[ok]} if ok.any() else None

    fields = [T.StructField("node", T.LongType()), T.StructField("other", T.LongType()), T.StructField("dist", T.DoubleType())]
    top = blocks.groupBy(*keys).agg(F.max("blk").alias("_last"))
    near = attach(blocks.select(*keys, "blk"), top.withColumn("_top", F.col("_last")), keys=keys, t="blk").select(
        *keys, F.col("blk").alias("a"),
        F.explode(F.sequence(F.greatest(F.col("blk") - 1, F.lit(0)), F.least(F.col("blk") + 1, F.col("_top")))).alias("b"),
    )
    first = cut(_run(_load_tiles(blocks, near, keys), keys, fields, work, metric))
    bound = first.groupBy(*keys, "node").agg(F.min("dist").alias("_ub"))
    members = blocks.select(*keys, "blk", F.explode("ids").alias("node"))
    reach = (
        members.join(bound, [*keys, "node"], "left")
        .groupBy(*keys, "blk")
        .agg(F.max(F.coalesce("_ub", F.lit(float("inf")))).alias("_reach"))
    )
    wide = cut(blocks.join(reach, [*keys, "blk"]))
    rest = _tile_list(wide, keys, F.col("_reach"), directed=True).where(F.abs(F.col("a") - F.col("b")) > 1)
    second = _run(_load_tiles(wide, rest, keys), keys, fields, work, metric)
    best = first.unionByName(second).groupBy(*keys, "node").agg(F.min(F.struct("dist", "other")).alias("_b"))
    return best.select(*keys, "node", F.col("_b.other").alias("other"), F.col("_b.dist").alias("dist"))


def sample_neighbours(points: DataFrame, sample: DataFrame, k: int, *, keys=KEYS, size=SIZE) -> DataFrame:
    """Distances (keys, node, dist) from sampled points to their k nearest others.

    ``sample`` has a fixed number of points per key; every block keeps at most k distances
    per sampled point. They are merged in levels of MERGE blocks, so no list grows with the key.
    """
    blocks = _blocks(points, keys, size)
    picked = _blocks(sample, keys, size)
    left = picked.select(*keys, F.col("blk").alias("a"), F.col("ids").alias("ia"), F.col("flat").alias("fa"))
    many = picked.groupBy(*keys).agg(F.max("blk").alias("_k"))
    top = blocks.groupBy(*keys).agg(F.max("blk").alias("_last"))
    right = attach(blocks, many.join(top, list(keys)), keys=keys, t="blk").select(
        *keys, F.col("blk").alias("b"), F.col("ids").alias("ib"), F.col("flat").alias("fb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k"))).alias("a"),
    )
    tiles = right.join(left, [*keys, "a"]).repartition(*keys, "a", "b")

    def work(row, d):
        ia = np.asarray(row.ia)
        d = np.where(_same(row), np.inf, d)
        part = np.sort(d, axis=1)[:, :k]
        i, j = np.nonzero(np.isfinite(part))
        return {"node": ia[i], "dist": part[i, j], "blk": np.full(len(i), row.b)}

    fields = [T.StructField("node", T.LongType()), T.StructField("dist", T.DoubleType()), T.StructField("blk", T.LongType())]
    found = _run(tiles, keys, fields, work, "euclidean")
    for _ in range(2):
        part = found.groupBy(*keys, "node", F.floor(F.col("blk") / MERGE).cast("long").alias("blk"))
        least = part.agg(F.slice(F.sort_array(F.collect_list("dist")), 1, k).alias("_d"))
        found = least.select(*keys, "node", "blk", F.explode("_d").alias("dist"))
    merged = found.groupBy(*keys, "node").agg(F.slice(F.sort_array(F.collect_list("dist")), 1, k).alias("_d"))
    return merged.select(*keys, "node", F.explode("_d").alias("dist"))
