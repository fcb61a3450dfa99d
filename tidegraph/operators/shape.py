"""Projections, filters, stacking, pivots and joins by position or calendar."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.core import KEYS
from tidegraph.layout import ordered_position, spread_join

RESIDUAL = "Residuo"


# PRJ-1, PRJ-2
def component_columns(df: DataFrame, prefixes: Sequence[str] = ("IMF_", "Z_"), residual: bool = True) -> list[str]:
    found = []
    for p in prefixes:
        nums = sorted(int(m.group(1)) for c in df.columns if (m := re.fullmatch(re.escape(p) + r"(\d+)", c)))
        found += [f"{p}{n}" for n in nums]
    return found + ([RESIDUAL] if residual and RESIDUAL in df.columns else [])


def to_long(df: DataFrame, cols: Sequence[str] | None = None, *, ids: Sequence[str] = ("series_id", "t")) -> DataFrame:
    """Wide components to (ids, component, idx, x); idx counts from 1 in column order."""
    cols = list(cols or component_columns(df))
    if not cols:
        raise ValueError("no component columns")
    order = F.map_from_arrays(F.array(*[F.lit(c) for c in cols]), F.array(*[F.lit(i + 1) for i in range(len(cols))]))
    return df.unpivot(list(ids), cols, "component", "x").withColumn("idx", order[F.col("component")])


def to_wide(df: DataFrame, components: Sequence[str], *, ids: Sequence[str] = ("series_id", "t")) -> DataFrame:
    return df.groupBy(*ids).pivot("component", list(components)).agg(F.first("x"))


# PRJ-3
def cap_components(df: DataFrame, n: int, *, keys=KEYS) -> tuple[DataFrame, DataFrame]:
    """First ``n`` modes of every key, and a per-key flag whether a residual exists."""
    flags = df.groupBy(*keys).agg(F.max(F.col("component") == RESIDUAL).alias("has_residual"))
    return df.where((F.col("component") != RESIDUAL) & (F.col("idx") <= n)), flags


# PRJ-4
def scale(x: Column, lo: float, hi: float) -> Column:
    return (F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))) - lo) / (hi - lo)


def unscale(x: Column, lo: float, hi: float) -> Column:
    return x * (hi - lo) + lo


# PRJ-5
def recode(col: Column, mapping: Mapping, other=None, null=None) -> Column:
    out = F.when(col.isNull(), F.lit(null))
    for code, value in mapping.items():
        out = out.when(col == code, F.lit(value))
    return out.otherwise(F.lit(other))


# PRJ-6
def positional_encoding(pos: Column, d: int, mode: int = 2) -> Column:
    """Array of d numbers. Mode 1: sine everywhere; mode 2: sine on even, cosine on odd places."""
    if mode not in (1, 2):
        raise ValueError("mode must be 1 or 2")

    def place(i: Column) -> Column:
        angle = pos / F.pow(F.lit(10000.0), 2.0 * F.floor(i / 2) / d)
        return F.sin(angle) if mode == 1 else F.when(i % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))

    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), place)


# PRJ-7
def range_label(lo: Column, hi: Column, digits: int = 4) -> Column:
    return F.when(lo.isNull() | hi.isNull(), F.lit("-")).otherwise(F.format_string(f"%.{digits}f - %.{digits}f", lo, hi))


# FLT-1, FLT-2
def date_range(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts).between(F.lit(start), F.lit(end)))


def missing_report(df: DataFrame, cols: Sequence[str], *, keys=KEYS) -> DataFrame:
    """Missing count and percent per key and column."""
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols]
    )
    return counts.unpivot([*keys, "rows"], list(cols), "column", "missing").withColumn(
        "missing_pct", F.col("missing") * 100.0 / F.col("rows")
    )


# FLT-3
def truncate_to_common_length(df: DataFrame, *, keys=KEYS, within=("method",), t="t") -> DataFrame:
    """Cut the tables of a key (told apart by ``within``) to the shortest of them."""
    sizes = df.groupBy(*keys, *within).agg((F.max(t) + 1).alias("_n"), F.count(F.lit(1)).alias("_rows"))
    sizes = sizes.groupBy(*keys).agg(F.min("_n").alias("_n"), F.sum("_rows").alias("_rows"))
    return spread_join(df, sizes, keys, "_rows").where(F.col(t) < F.col("_n")).drop("_n")


# FLT-4
def split_by_date(df: DataFrame, threshold, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Train strictly before the threshold, test from it on; the threshold row is in test only."""
    edge = F.lit(threshold)
    return df.where(F.col(ts) < edge), df.where(F.col(ts) >= edge)


# FLT-5, JN-6
def subgraph(nodes: DataFrame, edges: DataFrame, keep: Column, *, keys=KEYS) -> tuple[DataFrame, DataFrame]:
    """Nodes that satisfy ``keep`` renumbered from 0, and the edges with both ends kept."""
    kept = ordered_position(nodes.where(keep), ["node"], keys=keys, name="new_node")
    ids = kept.select(*keys, "node", "new_node")
    src = ids.withColumnsRenamed({"node": "src", "new_node": "new_src"})
    dst = ids.withColumnsRenamed({"node": "dst", "new_node": "new_dst"})
    inner = edges.join(src, [*keys, "src"]).join(dst, [*keys, "dst"])
    return kept, inner.select(*keys, F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))


def edges_within(edges: DataFrame, nodes: DataFrame, *, keys=KEYS) -> DataFrame:
    """Edges with both ends in the node set, without renumbering."""
    ids = nodes.select(*keys, "node").distinct()
    return edges.join(ids.withColumnRenamed("node", "src"), [*keys, "src"], "left_semi").join(
        ids.withColumnRenamed("node", "dst"), [*keys, "dst"], "left_semi"
    )


# SET-1
def stack(tables: Mapping[str, DataFrame], label: str = "method") -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.withColumn(label, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables to stack")
    return out


# SHP-1, SHP-2
def pivot_mean(df: DataFrame, index: str, columns: str, values: Sequence[str], labels: Sequence[str]) -> DataFrame:
    return df.groupBy(index).pivot(columns, list(labels)).agg(*[F.avg(v).alias(v) for v in values])


def crosstab(df: DataFrame, rows: str, columns: str, labels: Sequence[str]) -> DataFrame:
    return df.groupBy(rows).pivot(columns, list(labels)).count().na.fill(0)


# SRT-1
def best_row(df: DataFrame, order: Sequence[Column], *, keys=KEYS) -> DataFrame:
    """First row of each key in lexicographic order, by an aggregate instead of a sort."""
    ranks = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(order)])
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ranks).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def smallest(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


# JN-1
def align_to_calendar(series: DataFrame, calendar: DataFrame, *, ts="ts", drop_missing=True) -> DataFrame:
    """Series on the reference dates (``calendar`` has ``ts``); a series without gaps keeps all of them.

    With ``drop_missing=False`` gaps stay as NULL rows. Series ids are few against rows, so
    the grid of (series, date) is the output size, not larger.
    """
    rows = series.join(calendar.select(ts).distinct(), ts, "left_semi")
    if drop_missing:
        return rows.where(F.col("x").isNotNull())
    grid = series.select("series_id").distinct().join(calendar.select(ts).distinct())
    return grid.join(rows, ["series_id", ts], "left")


def calendar_gaps(series: DataFrame, calendar: DataFrame, *, ts="ts") -> DataFrame:
    """Per series: dates of the calendar, dates found, dates missing."""
    days = calendar.select(ts).distinct()
    total = days.agg(F.count(F.lit(1)).alias("calendar_dates"))
    found = series.join(days, ts, "left_semi").where(F.col("x").isNotNull())
    return (
        series.groupBy("series_id").agg(F.lit(1).alias("_one"))
        .join(found.groupBy("series_id").agg(F.countDistinct(ts).alias("found")), "series_id", "left")
        .join(F.broadcast(total))
        .select(
            "series_id",
            "calendar_dates",
            F.coalesce("found", F.lit(0)).alias("found"),
            (F.col("calendar_dates") - F.coalesce("found", F.lit(0))).alias("missing"),
        )
    )


# JN-2
def with_original(components: DataFrame, series: DataFrame, *, keys=KEYS, t="t") -> DataFrame:
    """Components next to the value ``original`` of the same position."""
    return components.join(series.select(*keys, t, F.col("x").alias("original")), [*keys, t])


# JN-3
def side_by_side(metrics: DataFrame, left_id: str, right_id: str, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    a = metrics.where(F.col("series_id") == left_id).select(*on, *[F.col(v).alias(f"{v}_a") for v in values])
    b = metrics.where(F.col("series_id") == right_id).select(*on, *[F.col(v).alias(f"{v}_b") for v in values])
    return a.join(b, list(on))


# JN-7
def with_grid(series: DataFrame, grid: Sequence[Mapping]) -> DataFrame:
    """Every row once per point of a parameter grid (a driver-side list, so its size is known)."""
    if not grid:
        raise ValueError("empty grid")
    points = F.array(*[F.struct(F.lit(i).alias("point"), *[F.lit(v).alias(k) for k, v in g.items()]) for i, g in enumerate(grid)])
    return series.select("*", F.explode(points).alias("_g")).select("*", "_g.*").drop("_g")


def row_rank(df: DataFrame, order: Sequence[Column], *, keys) -> DataFrame:
    """Rank of rows in small result tables (grids and metric tables)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
