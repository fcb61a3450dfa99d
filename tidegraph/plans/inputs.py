"""Series made from the given tables, in Spark and, for checking, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.core import cut
from tidegraph.layout import ordered_position
from tidegraph.operators.graphs import horizontal_visibility
from tidegraph.sources.readers import load_series

UNIT = 10000.0


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_series(spark: SparkSession, folder: str) -> DataFrame:
    """Raw values by event type."""
    return load_series(table(spark, folder, "events"), "ts", "value", "event_type")


def user_series(spark: SparkSession, folder: str) -> DataFrame:
    """Raw values by user: many short series."""
    return load_series(table(spark, folder, "events"), "ts", "value", "user_id")


def hour_series(spark: SparkSession, folder: str) -> DataFrame:
    """Mean value by event type and hour."""
    e = table(spark, folder, "events")
    g = e.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.round(F.avg("value"), 6).alias("x"))
    return load_series(g, "ts", "x", "event_type")


def ship_daily(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "lineitem").groupBy("l_returnflag", F.col("l_shipdate").alias("ts"))
    return g.agg((F.round(F.sum("l_extendedprice"), 2) / UNIT).alias("x"))


def ship_series(spark: SparkSession, folder: str) -> DataFrame:
    """Daily sum of prices by return flag."""
    return load_series(ship_daily(spark, folder), "ts", "x", "l_returnflag")


def user_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one graph a user: all events of the user in order of time, and the horizontal visibility
    edges among those of each event type; the types are separate components."""
    e = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("series_id"), "event_type", "ts", "event_id", F.col("value").alias("x"))
    e = ordered_position(e, ["ts", "event_id"], name="node").where("event_type IS NOT NULL")
    e = cut(e.select("series_id", "event_type", "node", "x"))
    edges = horizontal_visibility(e, keys=("series_id", "event_type"), t="node")  # a type's events keep their order
    return e.select("series_id", "node"), cut(edges.select("series_id", "src", "dst"))


def order_daily(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("ts"))
    return g.agg((F.round(F.sum("o_totalprice"), 2) / UNIT).alias("x"))


def order_series(spark: SparkSession, folder: str) -> DataFrame:
    """Daily sum of order totals by priority, with gaps."""
    return load_series(order_daily(spark, folder), "ts", "x", "series_id")


def embedding_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors as one matrix."""
    e = table(spark, folder, "embeddings")
    vec = F.transform("embedding", lambda v: v.cast("double"))
    return e.select(F.lit("vectors").alias("series_id"), F.col("vec_id").alias("t"), vec.alias("vec"))


# The same series as SQL common table expressions.
SQL_EVENT = """s_event AS (SELECT event_type AS series_id, ts, value AS x,
  row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS t FROM events)"""
SQL_USER = """s_user AS (SELECT CAST(user_id AS VARCHAR) AS series_id, ts, value AS x,
  row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS t FROM events)"""
SQL_HOUR = """s_hour AS (SELECT series_id, ts, x, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS t FROM (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, round(avg(value), 6) AS x FROM events GROUP BY ALL))"""
SQL_SHIP = """s_ship AS (SELECT series_id, ts, x, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS t FROM (
  SELECT l_returnflag AS series_id, l_shipdate AS ts, round(sum(l_extendedprice), 2) / 10000.0::DOUBLE AS x FROM lineitem GROUP BY ALL))"""
SQL_ORDER = """s_order AS (SELECT series_id, ts, x, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS t FROM (
  SELECT o_orderpriority AS series_id, o_orderdate AS ts, round(sum(o_totalprice), 2) / 10000.0::DOUBLE AS x FROM orders GROUP BY ALL))"""
