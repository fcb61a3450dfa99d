"""Sinks: graph tables, reports, and the skip-if-present rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = ("graph", "method", "component")


def write_table(df: DataFrame, path: str, *, fmt: str = "parquet", force: bool = True, partition_by=()) -> None:
    """SNK-2 / SNK-3: ``force=False`` keeps an existing table."""
    writer = df.write.mode("overwrite" if force else "ignore")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_graph(nodes: DataFrame, edges: DataFrame, meta: DataFrame, base: str, *, force: bool = True) -> None:
    """SNK-1: ``features``, ``edges`` and ``metadata`` below ``base``, partitioned by graph keys present."""
    for name, df in (("features", nodes), ("edges", edges)):
        write_table(df, f"{base}/{name}", force=force, partition_by=[p for p in PARTS if p in df.columns])
    write_table(meta, f"{base}/metadata", fmt="csv", force=force)


def write_report(df: DataFrame, path: str, *, force: bool = True) -> None:
    """SNK-2: one JSON object per row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite" if force else "ignore").text(path)
