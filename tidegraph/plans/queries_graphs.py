"""Checked queries on series graphs and graph metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegraph.core import cut
from tidegraph.operators import aggregates as A
from tidegraph.operators import dependence as D
from tidegraph.operators import graphs as G
from tidegraph.operators import metrics as M
from tidegraph.operators import shape as S
from tidegraph.plans import registry
from tidegraph.plans.inputs import SQL_EVENT, SQL_HOUR, SQL_USER, event_series, hour_series, user_graph, user_series
from tidegraph.plans.queries_series import rounded
from tidegraph.plans.queries_tests import sql_fnn, sql_mi

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


# visibility by definition: no point between that blocks
HVG_BY_RUN = """hvg AS (SELECT series_id, src, dst FROM (SELECT a.series_id, a.t AS src, b.t AS dst, a.x AS xa, b.x AS xb,
    max(b.x) OVER (PARTITION BY a.series_id, a.t ORDER BY b.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
    FROM {src} a JOIN {src} b ON a.series_id = b.series_id AND b.t > a.t) WHERE top IS NULL OR top < least(xa, xb))"""
HVG_BY_DEFINITION = """hvg AS MATERIALIZED (SELECT a.series_id, a.t AS src, b.t AS dst FROM {src} a JOIN {src} b ON a.series_id = b.series_id AND b.t > a.t
    WHERE NOT EXISTS (SELECT 1 FROM {src} k WHERE k.series_id = a.series_id AND k.t > a.t AND k.t < b.t AND k.x >= least(a.x, b.x)))"""
NVG_BY_DEFINITION = """nvg AS MATERIALIZED (SELECT a.series_id, a.t AS src, b.t AS dst FROM {src} a JOIN {src} b ON a.series_id = b.series_id AND b.t > a.t
    WHERE NOT EXISTS (SELECT 1 FROM {src} k WHERE k.series_id = a.series_id AND k.t > a.t AND k.t < b.t AND (k.x - a.x) / (k.t - a.t) >= (b.x - a.x) / (b.t - a.t)))"""
NVG_BY_RUN = """nvg AS (SELECT series_id, src, dst FROM (SELECT a.series_id, a.t AS src, b.t AS dst, (b.x - a.x) / (b.t - a.t) AS s,
    max((b.x - a.x) / (b.t - a.t)) OVER (PARTITION BY a.series_id, a.t ORDER BY b.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
    FROM {src} a JOIN {src} b ON a.series_id = b.series_id AND b.t > a.t) WHERE top IS NULL OR s > top)"""


@query("hvg_edges", f"WITH {SQL_EVENT}, {HVG_BY_RUN.format(src='s_event')} SELECT * FROM hvg")
def hvg_edges(spark, d):
    return G.horizontal_visibility(event_series(spark, d))


@query("hvg_edges_many_series", f"WITH {SQL_USER}, {HVG_BY_DEFINITION.format(src='s_user')} SELECT * FROM hvg")
def hvg_edges_many_series(spark, d):
    return G.horizontal_visibility(user_series(spark, d))


@query("nvg_edges", f"WITH {SQL_EVENT}, {NVG_BY_RUN.format(src='s_event')} SELECT * FROM nvg")
def nvg_edges(spark, d):
    return G.natural_visibility(event_series(spark, d))


@query("nvg_edges_many_series", f"WITH {SQL_USER}, {NVG_BY_DEFINITION.format(src='s_user')} SELECT * FROM nvg")
def nvg_edges_many_series(spark, d):
    return registry.build("nvg", user_series(spark, d))


_DIST = "sqrt(list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(a.v, b.v)]))"
REC_SQL = f"""{SQL_HOUR}, {sql_mi('s_hour', 20)}, {sql_fnn('s_hour', (2, 3, 4))},
  cloud AS MATERIALIZED (SELECT e.series_id, e.node, e.v FROM emb e JOIN dim USING (series_id, d)),
  pd AS MATERIALIZED (SELECT a.series_id, a.node AS src, b.node AS dst, {_DIST} AS dist FROM cloud a JOIN cloud b ON a.series_id = b.series_id AND a.node <> b.node),
  eps AS MATERIALIZED (SELECT series_id, quantile_cont(dist, 0.1) AS epsilon FROM (SELECT *, row_number() OVER (PARTITION BY series_id, src ORDER BY dist, dst) AS r FROM pd) WHERE r <= 99 GROUP BY 1)"""


@query(
    "recurrence_parameters",
    f"""WITH {REC_SQL} SELECT series_id, tau, CAST(d AS INTEGER) AS d, round(epsilon, 6) AS epsilon FROM tau JOIN dim USING (series_id) JOIN eps USING (series_id)""",
)
def recurrence_parameters(spark, d):
    p, _ = G.recurrence_parameters(hour_series(spark, d), 20, 4)
    return rounded(p.select("series_id", F.col("tau").cast("long").alias("tau"), F.col("d").cast("int").alias("d"), "epsilon"))


@query("recurrence_edges", f"WITH {REC_SQL} SELECT pd.series_id, src, dst FROM pd JOIN eps USING (series_id) WHERE dist <= epsilon")
def recurrence_edges(spark, d):
    return registry.build("recurrence", hour_series(spark, d), tau_max=20, d_max=4)


@query(
    "graph_counts",
    f"""WITH {REC_SQL}, {HVG_BY_RUN.format(src='s_hour')}, {NVG_BY_RUN.format(src='s_hour')},
      n AS (SELECT series_id, count(*) AS n FROM s_hour GROUP BY 1), c AS (SELECT series_id, count(*) AS n FROM cloud GROUP BY 1)
      SELECT series_id, 'hvg' AS graph, any_value(n) AS n, count(*) AS edges FROM hvg JOIN n USING (series_id) GROUP BY 1
      UNION ALL SELECT series_id, 'nvg', any_value(n), count(*) FROM nvg JOIN n USING (series_id) GROUP BY 1
      UNION ALL SELECT pd.series_id, 'recurrence', any_value(c.n), count(*) FROM pd JOIN eps USING (series_id) JOIN c USING (series_id) WHERE dist <= epsilon GROUP BY 1""",
)
def graph_counts(spark, d):
    return G.all_graphs(hour_series(spark, d), tau_max=20, d_max=4)[2]


@query(
    "simple_edges",
    """SELECT DISTINCT event_type, least(user_id, event_id % 97) AS src, greatest(user_id, event_id % 97) AS dst FROM events WHERE user_id <> event_id % 97""",
)
def simple_edges(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", F.col("user_id").alias("src"), (F.col("event_id") % 97).alias("dst"))
    return G.simple_edges(e, keys=("event_type",))


@query(
    "neighbourhood_mean",
    f"""WITH {SQL_USER}, {HVG_BY_DEFINITION.format(src='s_user')}
      SELECT h.series_id, dst AS node, round(avg(x), 6) AS x FROM hvg h JOIN s_user s ON s.series_id = h.series_id AND s.t = h.src GROUP BY ALL""",
)
def neighbourhood_mean(spark, d):
    s = cut(user_series(spark, d))
    h = G.neighbourhood_mean(G.visibility_nodes(s), G.horizontal_visibility(s))
    return rounded(h.select("series_id", "node", F.get("features", F.lit(0)).alias("x")))


# visibility edges between the points of at least 30, renumbered
SUB_SQL = f"""{SQL_USER}, {HVG_BY_DEFINITION.format(src='s_user')},
  kept AS MATERIALIZED (SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS node FROM s_user WHERE x >= 30),
  e AS MATERIALIZED (SELECT h.series_id, a.node AS src, b.node AS dst FROM hvg h JOIN kept a ON a.series_id = h.series_id AND a.t = h.src JOIN kept b ON b.series_id = h.series_id AND b.t = h.dst)"""


def user_subgraph(spark, d):
    s = cut(user_series(spark, d))
    nodes = s.select("series_id", F.col("t").alias("node"), "x")
    kept, edges = S.subgraph(nodes, G.horizontal_visibility(s), F.col("x") >= 30)
    return cut(kept.select("series_id", F.col("new_node").alias("node"), F.col("node").alias("t"))), cut(edges)


@query("subgraph_reindex", f"WITH {SUB_SQL} SELECT * FROM e")
def subgraph_reindex(spark, d):
    return user_subgraph(spark, d)[1]


@query(
    "edges_within",
    f"""WITH {SQL_USER}, {HVG_BY_DEFINITION.format(src='s_user')} SELECT series_id, src, dst FROM hvg h
      WHERE EXISTS (SELECT 1 FROM s_user s WHERE s.series_id = h.series_id AND s.t = h.src AND s.x >= 30)
        AND EXISTS (SELECT 1 FROM s_user s WHERE s.series_id = h.series_id AND s.t = h.dst AND s.x >= 30)""",
)
def edges_within(spark, d):
    s = cut(user_series(spark, d))
    return S.edges_within(G.horizontal_visibility(s), s.where("x >= 30").select("series_id", F.col("t").alias("node")))


# a disconnected graph over all events: visibility edges among the events of each type of a user
GRAPH_SQL = f"""kept AS MATERIALIZED (SELECT CAST(user_id AS VARCHAR) AS series_id, event_type, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS node,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS t FROM events),
  kinds AS MATERIALIZED (SELECT series_id || '|' || event_type AS series_id, t, x FROM kept), {HVG_BY_DEFINITION.format(src='kinds')},
  e AS MATERIALIZED (SELECT a.series_id, a.node AS src, b.node AS dst FROM hvg h JOIN kept a ON a.series_id || '|' || a.event_type = h.series_id AND a.t = h.src
    JOIN kept b ON b.series_id || '|' || b.event_type = h.series_id AND b.t = h.dst),
  arc AS MATERIALIZED (SELECT series_id, src, dst FROM e UNION ALL SELECT series_id, dst, src FROM e),
  size AS MATERIALIZED (SELECT series_id, count(*) AS n FROM kept GROUP BY 1)"""


@query(
    "size_metrics",
    f"""WITH {GRAPH_SQL} SELECT s.series_id, n, count(src) AS m, round(2.0 * count(src) / (n * (n - 1)), 6) AS density, round(2.0 * count(src) / n, 6) AS mean_degree
      FROM size s LEFT JOIN e USING (series_id) GROUP BY s.series_id, n""",
)
def size_metrics(spark, d):
    return rounded(M.size_metrics(*user_graph(spark, d)))


DEG_SQL = "deg AS MATERIALIZED (SELECT k.series_id, k.node, count(arc.dst) AS degree FROM kept k LEFT JOIN arc ON arc.series_id = k.series_id AND arc.src = k.node GROUP BY ALL)"


@query(
    "degree_metrics",
    f"""WITH {GRAPH_SQL}, {DEG_SQL} SELECT series_id, min(degree) AS degree_min, max(degree) AS degree_max, round(avg(degree), 6) AS degree_mean,
      round(stddev_pop(degree), 6) AS degree_std, round(median(degree), 6) AS degree_median FROM deg GROUP BY 1""",
)
def degree_metrics(spark, d):
    return rounded(M.degree_metrics(*user_graph(spark, d)).withColumn("degree_median", F.col("degree_median").cast("double")))


@query(
    "degree_centrality",
    f"WITH {GRAPH_SQL}, {DEG_SQL} SELECT series_id, node, round(degree / (n - 1), 6) AS centrality FROM deg JOIN size USING (series_id)",
)
def degree_centrality(spark, d):
    return rounded(M.degree_centrality(*user_graph(spark, d)))


@query(
    "degree_histogram",
    f"""WITH {GRAPH_SQL}, {DEG_SQL}, s AS (SELECT min(degree) AS lo, max(degree) AS hi FROM deg)
      SELECT 'all' AS panel, CAST(least(floor((degree - lo) * 1.0::DOUBLE / (hi - lo) * 10), 9) AS INTEGER) AS bin, count(*) AS count FROM deg, s GROUP BY ALL""",
)
def degree_histogram(spark, d):
    deg = M.degrees(*user_graph(spark, d)).withColumn("panel", F.lit("all")).withColumn("degree", F.col("degree").cast("double"))
    return A.histogram(deg, "degree", 10, keys=("panel",), t="node")


LABEL_SQL = """reach AS (SELECT series_id, node AS s, node AS v FROM kept UNION SELECT r.series_id, r.s, a.dst FROM reach r JOIN arc a ON a.series_id = r.series_id AND a.src = r.v),
  lab AS MATERIALIZED (SELECT series_id, s AS node, min(v) AS label, count(*) AS sz FROM reach GROUP BY ALL)"""


@query("connected_components", f"WITH RECURSIVE {GRAPH_SQL}, {LABEL_SQL} SELECT series_id, node, label FROM lab")
def connected_components(spark, d):
    return M.component_labels(*user_graph(spark, d))


@query(
    "component_metrics",
    f"""WITH RECURSIVE {GRAPH_SQL}, {LABEL_SQL} SELECT series_id, count(DISTINCT label) AS components, max(sz) AS largest FROM lab GROUP BY 1""",
)
def component_metrics(spark, d):
    return M.component_metrics(M.component_labels(*user_graph(spark, d)))


CLUST_SQL = f"""{DEG_SQL}, tri AS (SELECT a.series_id, a.src AS node, count(*) AS t FROM arc a JOIN arc b ON b.series_id = a.series_id AND b.src = a.src AND b.dst > a.dst
    JOIN arc c ON c.series_id = a.series_id AND c.src = a.dst AND c.dst = b.dst GROUP BY ALL),
  clust AS MATERIALIZED (SELECT d.series_id, d.node, CASE WHEN degree < 2 THEN 0 ELSE 2.0::DOUBLE * coalesce(t, 0) / (degree * (degree - 1)) END AS clustering
    FROM deg d LEFT JOIN tri ON tri.series_id = d.series_id AND tri.node = d.node)"""


@query("clustering", f"WITH {GRAPH_SQL}, {CLUST_SQL} SELECT series_id, node, round(clustering, 6) AS clustering FROM clust")
def clustering(spark, d):
    return rounded(M.clustering(*user_graph(spark, d)))


@query(
    "clustering_distribution",
    f"""WITH {GRAPH_SQL}, {CLUST_SQL} SELECT series_id, round(avg(clustering), 6) AS clustering_mean, round(min(clustering), 6) AS clustering_min, round(max(clustering), 6) AS clustering_max,
      round(stddev_pop(clustering), 6) AS clustering_std, round(median(clustering), 6) AS clustering_median FROM clust GROUP BY 1""",
)
def clustering_distribution(spark, d):
    return rounded(M.distribution(M.clustering(*user_graph(spark, d)), "clustering"))


BFS_SQL = """bfs(series_id, s, v, d) USING KEY (series_id, s, v) AS (SELECT series_id, node, node, 0 FROM kept
    UNION SELECT b.series_id, b.s, a.dst, b.d + 1 FROM bfs b JOIN arc a ON a.series_id = b.series_id AND a.src = b.v
      LEFT JOIN recurring.bfs r ON r.series_id = b.series_id AND r.s = b.s AND r.v = a.dst WHERE r.v IS NULL),
  dist AS MATERIALIZED (SELECT series_id, s, v, CAST(d AS INTEGER) AS d FROM bfs)"""


@query(
    "distance_counts",
    f"WITH RECURSIVE {GRAPH_SQL}, {BFS_SQL} SELECT series_id, s AS source, d, count(*) AS cnt FROM dist WHERE d > 0 GROUP BY ALL",
)
def distance_counts(spark, d):
    return M.distance_counts(*user_graph(spark, d))


BIG_SQL = """big AS MATERIALIZED (SELECT series_id, s AS node, min(v) AS label, count(*) AS sz FROM dist GROUP BY ALL),
  core AS MATERIALIZED (SELECT b.series_id, b.node FROM big b JOIN (SELECT series_id, label FROM big QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY sz DESC, label) = 1) c USING (series_id, label))"""


@query(
    "distance_metrics",
    f"""WITH RECURSIVE {GRAPH_SQL}, {BFS_SQL}, {BIG_SQL}, ecc AS (SELECT c.series_id, c.node, max(d) AS e FROM core c JOIN dist ON dist.series_id = c.series_id AND dist.s = c.node GROUP BY ALL)
      SELECT series_id, false AS distances_skipped, max(e) AS diameter, min(e) AS radius, round(avg(e), 6) AS ecc_mean FROM ecc GROUP BY 1""",
)
def distance_metrics(spark, d):
    return rounded(M.distance_metrics(*user_graph(spark, d)))


SWEEP_SQL = """one AS (SELECT series_id, min(node) AS node FROM {src} GROUP BY 1),
  far AS (SELECT o.series_id, arg_min(v, {{'d': -d, 'v': v}}) AS node, count(*) AS r FROM one o JOIN dist ON dist.series_id = o.series_id AND dist.s = o.node GROUP BY 1),
  two AS (SELECT f.series_id, any_value(r) AS r, max(d) AS d FROM far f JOIN dist ON dist.series_id = f.series_id AND dist.s = f.node GROUP BY 1)"""


@query(
    "diameter_two_sweeps",
    f"""WITH RECURSIVE {GRAPH_SQL}, {BFS_SQL}, {BIG_SQL}, {SWEEP_SQL.format(src='kept')},
      c1 AS (SELECT series_id, min(node) AS node, count(*) AS n FROM core GROUP BY 1),
      cf AS (SELECT o.series_id, arg_min(v, {{'d': -d, 'v': v}}) AS node FROM c1 o JOIN dist ON dist.series_id = o.series_id AND dist.s = o.node GROUP BY 1),
      c2 AS (SELECT f.series_id, max(d) AS d FROM cf f JOIN dist ON dist.series_id = f.series_id AND dist.s = f.node GROUP BY 1)
      SELECT two.series_id, CASE WHEN r = n THEN two.d END AS connected_only, c2.d AS largest FROM two JOIN size USING (series_id) JOIN c2 USING (series_id)""",
)
def diameter_two_sweeps(spark, d):
    n, e = user_graph(spark, d)
    a = M.two_sweep_diameter(n, e).withColumnRenamed("diameter_approx", "connected_only")
    return a.join(M.two_sweep_diameter(n, e, on="largest").withColumnRenamed("diameter_approx", "largest"), "series_id")


@query(
    "closeness",
    f"""WITH RECURSIVE {GRAPH_SQL}, {BFS_SQL} SELECT dist.series_id, s AS node, round(CASE WHEN sum(d) > 0 THEN ((count(*) - 1) * (count(*) - 1))::DOUBLE / (sum(d) * (any_value(n) - 1))::DOUBLE ELSE 0 END, 6) AS closeness
      FROM dist JOIN size ON size.series_id = dist.series_id GROUP BY ALL""",
)
def closeness(spark, d):
    return rounded(M.closeness(*user_graph(spark, d)))


@query("closeness_sampled")
def closeness_sampled(spark, d):
    n, e = user_graph(spark, d)
    return rounded(M.closeness(n, e, cut(M.hash_sample(n, 10))))


@query(
    "betweenness",
    f"""WITH RECURSIVE {GRAPH_SQL}, {BFS_SQL}, step AS MATERIALIZED (SELECT a.series_id, x.s, a.src AS u, a.dst AS v FROM dist x JOIN arc a ON a.series_id = x.series_id AND a.src = x.v
        JOIN dist y ON y.series_id = x.series_id AND y.s = x.s AND y.v = a.dst WHERE y.d = x.d + 1),
      path AS (SELECT series_id, node AS s, node AS v FROM kept UNION ALL SELECT p.series_id, p.s, t.v FROM path p JOIN step t ON t.series_id = p.series_id AND t.s = p.s AND t.u = p.v),
      sg AS MATERIALIZED (SELECT p.series_id, p.s, p.v, any_value(dist.d) AS d, count(*)::DOUBLE AS c FROM path p JOIN dist ON dist.series_id = p.series_id AND dist.s = p.s AND dist.v = p.v GROUP BY ALL),
      b AS (SELECT a.series_id, a.v AS node, sum(a.c * z.c / st.c) AS b FROM sg a JOIN sg z ON z.series_id = a.series_id AND z.s = a.v JOIN sg st ON st.series_id = a.series_id AND st.s = a.s AND st.v = z.v
        WHERE a.s <> a.v AND z.v <> a.v AND a.s <> z.v AND a.d + z.d = st.d GROUP BY ALL)
      SELECT k.series_id, k.node, round(coalesce(b / ((n - 1) * (n - 2)), 0), 6) AS betweenness FROM kept k JOIN size USING (series_id) LEFT JOIN b ON b.series_id = k.series_id AND b.node = k.node""",
)
def betweenness(spark, d):
    return rounded(M.betweenness(*user_graph(spark, d)))


@query("betweenness_sampled")
def betweenness_sampled(spark, d):
    n, e = user_graph(spark, d)
    return rounded(M.betweenness(n, e, cut(M.hash_sample(n, 10))))


def _power_sql(rounds: int, per: int = 5) -> str:
    out = ["p0 AS MATERIALIZED (SELECT series_id, node, 1 / sqrt(count(*) OVER (PARTITION BY series_id)) AS v FROM core)"]
    for i in range(1, rounds + 1):
        out.append(
            f"""q{i} AS (SELECT series_id, node, sum(v) AS v FROM (SELECT series_id, node, v FROM p{i - 1} UNION ALL SELECT a.series_id, a.dst, p.v FROM arc a JOIN p{i - 1} p ON p.series_id = a.series_id AND p.node = a.src) GROUP BY ALL),
            p{i} AS MATERIALIZED (SELECT series_id, node, v / sqrt(sum(v * v) OVER (PARTITION BY series_id)) AS v FROM q{i})"""
        )
    return ", ".join(out)


@query(
    "eigenvector_20_steps",
    f"WITH RECURSIVE {GRAPH_SQL}, {BFS_SQL}, {BIG_SQL}, {_power_sql(20)} SELECT series_id, node, round(v, 6) AS eigenvector FROM p20",
)
def eigenvector_20_steps(spark, d):
    n, e = user_graph(spark, d)
    core = cut(M.largest_component(M.component_labels(n, e)))
    return rounded(M.eigenvector(core, S.edges_within(e, core), rounds=20))


@query(
    "node_summary",
    f"""WITH {GRAPH_SQL}, {CLUST_SQL} SELECT series_id, round(avg(clustering), 6) AS clustering_mean, round(max(clustering), 6) AS clustering_max FROM clust GROUP BY 1""",
)
def node_summary(spark, d):
    return rounded(A.node_summary(M.clustering(*user_graph(spark, d)), "clustering"))


KIND_SQL = f"""{SQL_HOUR}, {HVG_BY_RUN.format(src='s_hour')}, {NVG_BY_RUN.format(src='s_hour')}, n AS (SELECT series_id, count(*) AS n FROM s_hour GROUP BY 1),
  sz AS (SELECT series_id, 'hvg' AS graph, any_value(n) AS n, count(*) AS m FROM hvg JOIN n USING (series_id) GROUP BY 1
    UNION ALL SELECT series_id, 'nvg', any_value(n), count(*) FROM nvg JOIN n USING (series_id) GROUP BY 1)"""


def hour_sizes(spark, d):
    nodes, edges, _ = G.all_graphs(cut(hour_series(spark, d)), ("hvg", "nvg"))
    return M.size_metrics(nodes, edges, keys=("series_id", "graph"))


@query(
    "metric_flags",
    f"""WITH {KIND_SQL} SELECT series_id, graph, n, m, round(2.0 * m / (n * (n - 1)), 6) AS density, round(2.0 * m / n, 6) AS mean_degree,
      graph = 'nvg' AND m > 400000 AS clustering_omitted, graph = 'nvg' AND m > 1500000 AS centrality_omitted,
      graph = 'nvg' AND m > 200000 AND m <= 1500000 AS betweenness_sampled, graph = 'nvg' AND m > 50000 AND m <= 1500000 AS closeness_sampled FROM sz""",
)
def metric_flags(spark, d):
    return rounded(M.metric_flags(hour_sizes(spark, d)))


@query(
    "metric_range",
    f"""WITH {KIND_SQL} SELECT graph, min(m) AS m_min, max(m) AS m_max, round(min(2.0 * m / n), 6) AS mean_degree_min, round(max(2.0 * m / n), 6) AS mean_degree_max FROM sz GROUP BY 1""",
)
def metric_range(spark, d):
    return rounded(A.metric_range(hour_sizes(spark, d), ["m", "mean_degree"]))


@query(
    "metric_panel",
    f"""WITH {KIND_SQL}, l AS (SELECT series_id, graph, 'density' AS metric, 2.0::DOUBLE * m / (n * (n - 1)) AS v FROM sz UNION ALL SELECT series_id, graph, 'mean_degree', 2.0::DOUBLE * m / n FROM sz)
      SELECT series_id, metric, max(printf('%.4f - %.4f', v, v)) FILTER (graph = 'hvg') AS hvg, max(printf('%.4f - %.4f', v, v)) FILTER (graph = 'nvg') AS nvg FROM l GROUP BY ALL""",
)
def metric_panel(spark, d):
    return M.panel(hour_sizes(spark, d), ["density", "mean_degree"], ("hvg", "nvg"))


@query("graph_metrics_table")
def graph_metrics_table(spark, d):
    s = cut(user_series(spark, d))
    nodes, edges, _ = G.all_graphs(s, ("hvg",))
    return rounded(M.graph_metrics(nodes, edges, keys=("series_id", "graph")))


@query("flagship_series_graph")
def flagship_series_graph(spark, d):
    from tidegraph.plans.panel import flagship

    return rounded(flagship(event_series(spark, d)))
