"""Sources: tables and files into ``series(series_id, t, ts, x)``, edges and collected results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.layout import ordered_position


def _need(df: DataFrame, *cols: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def load_series(df: DataFrame, ts: str, value: str, series_id: str | None = None, name: str = "series") -> DataFrame:
    """SRC-1: (series_id, ts, x DOUBLE, t) with t = 0-based position by time; rows of equal time in order of value."""
    _need(df, ts, value, *([series_id] if series_id else []))
    sid = F.col(series_id).cast("string") if series_id else F.lit(name)
    rows = df.select(sid.alias("series_id"), F.col(ts).alias("ts"), F.col(value).cast("double").alias("x"))
    return ordered_position(rows, ["ts", "x"])


def read_csv_series(
    spark: SparkSession, path: str, date_col: str = "DATE", value_col: str = "value", fmt: str = "yyyy-MM-dd"
) -> DataFrame:
    """SRC-2: one CSV with a date column and a value column; empty or '.' values become NULL."""
    raw = spark.read.option("header", True).csv(path)
    _need(raw, date_col, value_col)
    return raw.select(
        F.to_timestamp_ntz(F.col(date_col), F.lit(fmt)).alias("ts"),
        F.expr(f"try_cast(`{value_col}` as double)").alias("x"),
    )


def parse_date(col: Column, year_first: bool = True) -> Column:
    """SRC-3: date from text written with '/' or '-'."""
    return F.to_date(F.regexp_replace(col, "/", "-"), "yyyy-MM-dd" if year_first else "dd-MM-yyyy")


def align_timestamps(df: DataFrame, ts: str, *, zone: str | None = None, keys=("series_id",), tie: str) -> DataFrame:
    """SRC-4: wall-clock ``zone`` to UTC midnight; of several rows of a day the last one stays.

    The last row is picked by an aggregate, so a day with very many rows is reduced before
    the shuffle. ``tie`` orders rows of equal time.
    """
    utc = F.col(ts)
    if zone:
        utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), utc)
    day = F.date_trunc("day", utc).cast("timestamp_ntz")
    rest = [c for c in df.columns if c not in (*keys, ts)]
    return (
        df.select(*keys, day.alias(ts), utc.alias("_at"), *rest)
        .groupBy(*keys, ts)
        .agg(F.max_by(F.struct(*rest), F.struct("_at", tie)).alias("_row"))
        .select(*keys, ts, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )


def collect_table(
    spark: SparkSession, folder: str, graphs: Sequence[str] = ("hvg", "nvg", "recurrencia"), pattern: str = "*.csv"
) -> DataFrame:
    """SRC-5: CSV files below ``{folder}/{graph}/{component}/`` as one table, key columns first.

    Files of one graph type share their header. Columns are united by name: a column gets the type its values have,
    double where graph types differ in the kind of number, string where they differ otherwise.
    """
    reader = spark.read.options(header=True, inferSchema=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    parts = []
    for graph in graphs:
        part = reader.csv(f"{folder}/{graph}")
        cols = [c for c in part.columns if c not in ("component", "graph")]
        part = part.select(
            F.regexp_extract("_metadata.file_path", rf"/{graph}/([^/]+)/", 1).alias("component"),
            F.lit(graph).alias("graph"),
            *cols,
        )
        parts.append(part)
    if not parts:
        raise ValueError("no graph types given")
    kinds: dict[str, set[str]] = {}
    for part in parts:
        for column, kind in part.dtypes:
            kinds.setdefault(column, set()).add(kind)
    numbers = {"int", "bigint", "double"}
    same = {c: next(iter(k)) if len(k) == 1 else "double" if k <= numbers else "string" for c, k in kinds.items()}
    out = None
    for part in parts:
        part = part.select(*[F.col(c).cast(same[c]).alias(c) for c in part.columns])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_edges(spark: SparkSession, path: str, src: str = "source", dst: str = "target") -> DataFrame:
    """SRC-6: only the two end columns are read."""
    return spark.read.parquet(path).select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))
