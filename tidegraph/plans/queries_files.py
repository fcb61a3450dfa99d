"""Checked queries that write files with Spark and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegraph.core import cut, new_path
from tidegraph.operators import graphs as G
from tidegraph.operators import metrics as M
from tidegraph.plans.inputs import SQL_USER, table, user_series
from tidegraph.plans.queries_graphs import HVG_BY_DEFINITION
from tidegraph.plans.queries_series import rounded
from tidegraph.sources import readers, writers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


@query(
    "csv_series",
    """WITH g AS (SELECT o_orderdate AS ts, count(*) AS n FROM orders GROUP BY 1)
      SELECT 'orders' AS series_id, ts, CASE WHEN n % 3 > 0 THEN n::DOUBLE END AS x, row_number() OVER (ORDER BY ts) - 1 AS t FROM g""",
)
def csv_series(spark, d):
    """SRC-2: orders a day, as a CSV file in which some days hold '.' or nothing."""
    n = F.col("n").cast("string")
    days = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("DATE")).agg(F.count(F.lit(1)).alias("n"))
    days = days.select("DATE", F.when(F.col("n") % 3 > 0, n).when(F.col("n") % 2 == 0, ".").alias("value"))
    path = new_path(spark)
    writers.write_table(days, path, fmt="csv")
    return readers.load_series(readers.read_csv_series(spark, path), "ts", "x", name="orders")


def _user_graphs(spark, d):
    s = cut(user_series(spark, d))
    nodes, edges, counts = G.all_graphs(s, ("hvg",))
    return nodes, cut(edges), counts


@query("graph_tables_edges", f"WITH {SQL_USER}, {HVG_BY_DEFINITION.format(src='s_user')} SELECT src, dst FROM hvg")
def graph_tables_edges(spark, d):
    """SNK-1 and SRC-6: graphs of all users written as tables, their edges read back."""
    path = new_path(spark)
    writers.write_graph(*_user_graphs(spark, d), path)
    return readers.read_edges(spark, f"{path}/edges", "src", "dst")


@query(
    "graph_tables_features",
    f"""WITH {SQL_USER} SELECT series_id, t AS node, x, 'hvg' AS graph FROM s_user""",
)
def graph_tables_features(spark, d):
    """SNK-1: the features beside them; the graph type is a folder."""
    path = new_path(spark)
    writers.write_graph(*_user_graphs(spark, d), path)
    back = spark.read.schema("series_id string, node long, features array<double>, graph string").parquet(f"{path}/features")
    return back.select("series_id", "node", F.get("features", F.lit(0)).alias("x"), "graph")


@query(
    "graph_report",
    f"""WITH {SQL_USER}, {HVG_BY_DEFINITION.format(src='s_user')}, n AS (SELECT series_id, count(*) AS n FROM s_user GROUP BY 1)
      SELECT series_id, n, count(src) AS m, round(2.0 * count(src) / n, 6) AS mean_degree FROM n LEFT JOIN hvg USING (series_id) GROUP BY series_id, n""",
)
def graph_report(spark, d):
    """SNK-2: one JSON object a graph."""
    nodes, edges, _ = _user_graphs(spark, d)
    path = new_path(spark)
    writers.write_report(M.size_metrics(nodes, edges).select("series_id", "n", "m", "mean_degree"), path)
    return rounded(spark.read.schema("series_id string, n long, m long, mean_degree double").json(path))


@query("kept_table", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def kept_table(spark, d):
    """SNK-3: a table that is there stays, unless the caller forces it."""
    e, path = table(spark, d, "events"), new_path(spark)
    writers.write_table(e.groupBy("event_type").agg((-F.count(F.lit(1))).alias("n")), path)
    writers.write_table(e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), path, force=True)
    writers.write_table(e.groupBy("event_type").agg(F.lit(0).cast("long").alias("n")), path, force=False)
    return spark.read.parquet(path)


_COLLECTED = {"hvg": ("IMF_1", "IMF_2"), "nvg": ("IMF_1", "Residuo")}


@query(
    "collected_table",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS component, '{g}' AS graph, event_type, CAST(user_id AS INTEGER) AS user_id, {"CAST(count(*) AS DOUBLE)" if g == "hvg" else "max(value)"} AS value,
          {"CAST(sum(event_id) AS INTEGER)" if g == "hvg" else "NULL"} AS ids FROM events WHERE user_id % 2 = {i} GROUP BY event_type, user_id"""
        for g, parts in _COLLECTED.items() for i, c in enumerate(parts)
    ),
)
def collected_table(spark, d):
    """SRC-5: results of two graph types and three components, each a folder of CSV files, as one typed table."""
    path, events = new_path(spark), table(spark, d, "events")
    for graph, parts in _COLLECTED.items():
        for i, component in enumerate(parts):
            rows = events.where(F.col("user_id") % 2 == i).groupBy("event_type", "user_id")
            if graph == "hvg":
                rows = rows.agg(F.count(F.lit(1)).alias("value"), F.sum("event_id").alias("ids"))
            else:
                rows = rows.agg(F.max("value").alias("value"))
            writers.write_table(rows, f"{path}/{graph}/{component}", fmt="csv")
    return readers.collect_table(spark, path, tuple(_COLLECTED))
