"""Checked queries on sources, shapes, windows and descriptive statistics, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions import signals
from tidegraph.functions.noise import uniform
from tidegraph.operators import aggregates as A
from tidegraph.operators import shape as S
from tidegraph.operators import windows as W
from tidegraph.operators.text import strip_latex
from tidegraph.plans.inputs import (
    SQL_EVENT, SQL_HOUR, SQL_ORDER, SQL_SHIP, SQL_USER, UNIT, event_series, hour_series, order_daily, order_series,
    ship_daily, ship_series, table, user_series,
)
from tidegraph.sources import readers as R

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; -0.0 becomes 0.0."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if d == "double" else F.col(c) for c, d in df.dtypes])


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


# ---------------------------------------------------------------- sources
@query("load_series", f"WITH {SQL_EVENT} SELECT series_id, t, x, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM s_event")
def load_series(spark, d):
    return event_series(spark, d).select("series_id", "t", "x", stamp("ts"))


@query(
    "parse_date",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS slash, CAST(o_orderdate AS DATE) AS dash FROM orders""",
)
def parse_date(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey",
        R.parse_date(F.date_format("o_orderdate", "yyyy/MM/dd")).alias("slash"),
        R.parse_date(F.date_format("o_orderdate", "dd-MM-yyyy"), year_first=False).alias("dash"),
    )


@query(
    "align_timestamps",
    """SELECT user_id, strftime(day, '%Y-%m-%d') AS day, value, event_id FROM (
         SELECT user_id, date_trunc('day', ts + INTERVAL 5 HOUR) AS day, value, event_id,
           row_number() OVER (PARTITION BY user_id, date_trunc('day', ts + INTERVAL 5 HOUR) ORDER BY ts DESC, event_id DESC) AS r
         FROM events) WHERE r = 1""",
)
def align_timestamps(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "value", "event_id")
    a = R.align_timestamps(e, "ts", zone="Etc/GMT+5", keys=("user_id",), tie="event_id")
    return a.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value", "event_id")


@query("read_edges", "SELECT l_partkey AS src, l_suppkey AS dst, count(*) AS n FROM lineitem GROUP BY ALL")
def read_edges(spark, d):
    return R.read_edges(spark, f"{d}/lineitem.parquet", "l_partkey", "l_suppkey").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- shapes
WIDE_SQL = """wide AS (SELECT l_orderkey AS k, l_linenumber AS t, l_quantity AS "IMF_2", l_discount AS "IMF_1",
  l_tax AS "IMF_10", l_extendedprice AS "Residuo" FROM lineitem)"""


def _wide(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("t"), F.col("l_quantity").alias("IMF_2"),
        F.col("l_discount").alias("IMF_1"), F.col("l_tax").alias("IMF_10"), F.col("l_extendedprice").alias("Residuo"),
    )


@query(
    "components_to_long",
    f"""WITH {WIDE_SQL} SELECT component, idx, CAST(count(*) AS BIGINT) AS n, round(sum(x), 2) AS total FROM (
      SELECT 'IMF_1' AS component, 1 AS idx, "IMF_1" AS x FROM wide UNION ALL SELECT 'IMF_2', 2, "IMF_2" FROM wide
      UNION ALL SELECT 'IMF_10', 3, "IMF_10" FROM wide UNION ALL SELECT 'Residuo', 4, "Residuo" FROM wide) GROUP BY ALL""",
)
def components_to_long(spark, d):
    long = S.to_long(_wide(spark, d), ids=("k", "t"))
    return long.groupBy("component", "idx").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 2).alias("total"))


@query(
    "long_to_wide",
    f"""WITH {SQL_SHIP} SELECT strftime(ts, '%Y-%m-%d') AS day, round(max(x) FILTER (series_id = 'A'), 6) AS "A",
      round(max(x) FILTER (series_id = 'N'), 6) AS "N", round(max(x) FILTER (series_id = 'R'), 6) AS "R" FROM s_ship GROUP BY ALL""",
)
def long_to_wide(spark, d):
    long = ship_daily(spark, d).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("l_returnflag").alias("component"), "x")
    return rounded(S.to_wide(long, ["A", "N", "R"], ids=("day",)))


@query(
    "cap_components",
    f"""WITH {WIDE_SQL}, long AS (SELECT k, t, 1 AS idx, "IMF_1" AS x FROM wide UNION ALL SELECT k, t, 2, "IMF_2" FROM wide)
      SELECT k, round(sum(x), 6) AS total, CAST(max(idx) AS INTEGER) AS modes, true AS has_residual FROM long GROUP BY k""",
)
def cap_components(spark, d):
    long = S.to_long(_wide(spark, d), ids=("k", "t"))
    kept, flags = S.cap_components(long, 2, keys=("k",))
    g = kept.groupBy("k").agg(F.sum("x").alias("total"), F.max("idx").alias("modes"))
    return rounded(g.join(flags, "k"))


@query(
    "scale_unscale",
    """SELECT event_id, round(y, 6) AS scaled, round(y * 80 + 20, 6) AS back FROM (
         SELECT event_id, (least(greatest(value, 20), 100) - 20) / 80 AS y FROM events)""",
)
def scale_unscale(spark, d):
    y = S.scale(F.col("value"), 20, 100)
    return rounded(table(spark, d, "events").select("event_id", y.alias("scaled"), S.unscale(y, 20, 100).alias("back")))


@query(
    "recode",
    """SELECT o_orderkey, CASE WHEN o_orderstatus IS NULL THEN 'none' WHEN o_orderstatus = 'F' THEN 'finished'
         WHEN o_orderstatus = 'O' THEN 'open' ELSE 'other' END AS status FROM orders""",
)
def recode(spark, d):
    status = S.recode(F.col("o_orderstatus"), {"F": "finished", "O": "open"}, other="other", null="none")
    return table(spark, d, "orders").select("o_orderkey", status.alias("status"))


@query(
    "positional_encoding",
    """WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS pos FROM events),
      e AS (SELECT event_id, i, pos / pow(10000.0::DOUBLE, 2.0 * (i // 2) / 6) AS a FROM p, range(6) r(i))
      SELECT event_id, i AS place, round(sin(a), 6) + 0.0 AS one, round(CASE WHEN i % 2 = 0 THEN sin(a) ELSE cos(a) END, 6) + 0.0 AS two FROM e""",
)
def positional_encoding(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("series_id"), "ts")
    from tidegraph.layout import ordered_position

    p = ordered_position(e, ["ts"], name="pos")
    both = F.arrays_zip(
        S.positional_encoding(F.col("pos"), 6, 1).alias("one"), S.positional_encoding(F.col("pos"), 6, 2).alias("two")
    )
    r = p.select("event_id", F.posexplode(both).alias("place", "v")).select(
        "event_id", F.col("place").cast("long").alias("place"), F.col("v.one").alias("one"), F.col("v.two").alias("two")
    )
    return rounded(r)


@query(
    "range_label",
    "SELECT event_type, printf('%.4f - %.4f', min(value), max(value)) AS label FROM events GROUP BY 1",
)
def range_label(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return g.select("event_type", S.range_label(F.col("lo"), F.col("hi")).alias("label"))


@query(
    "date_range",
    """SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1999-02-28'
       GROUP BY 1""",
)
def date_range(spark, d):
    li = table(spark, d, "lineitem")
    kept = S.date_range(li, dt.datetime(1996, 3, 1), dt.datetime(1999, 2, 28), "l_shipdate")
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


CAL_SQL = f"""{SQL_ORDER}, cal AS (SELECT DISTINCT l_shipdate AS ts FROM lineitem),
  grid AS (SELECT i.series_id, c.ts, s.x FROM (SELECT DISTINCT series_id FROM s_order) i CROSS JOIN cal c
    LEFT JOIN s_order s ON s.series_id = i.series_id AND s.ts = c.ts)"""


def _calendar(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_shipdate").alias("ts")).distinct()


@query(
    "missing_report",
    f"""WITH {CAL_SQL} SELECT series_id, count(*) AS rows, 'x' AS "column", CAST(count(*) - count(x) AS BIGINT) AS missing,
      round((count(*) - count(x)) * 100.0 / count(*), 6) AS missing_pct FROM grid GROUP BY 1""",
)
def missing_report(spark, d):
    g = S.align_to_calendar(order_daily(spark, d), _calendar(spark, d), drop_missing=False)
    return rounded(S.missing_report(g, ["x"]))


@query(
    "calendar_align",
    f"""WITH {CAL_SQL} SELECT series_id, strftime(ts, '%Y-%m-%d') AS day, round(x, 6) AS x FROM grid WHERE x IS NOT NULL""",
)
def calendar_align(spark, d):
    a = S.align_to_calendar(order_daily(spark, d), _calendar(spark, d))
    return rounded(a.select("series_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "x"))


@query(
    "calendar_gaps",
    f"""WITH {CAL_SQL} SELECT series_id, count(*) AS calendar_dates, count(x) AS found, CAST(count(*) - count(x) AS BIGINT) AS missing
      FROM grid GROUP BY 1""",
)
def calendar_gaps(spark, d):
    return S.calendar_gaps(order_daily(spark, d), _calendar(spark, d))


@query(
    "truncate_common_length",
    f"""WITH {SQL_ORDER}, n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM s_order GROUP BY series_id))
      SELECT s.series_id, count(*) AS rows, round(sum(x), 4) AS total FROM s_order s, n WHERE t < n GROUP BY 1""",
)
def truncate_common_length(spark, d):
    s = order_series(spark, d).withColumn("panel", F.lit("all"))
    c = S.truncate_to_common_length(s, keys=("panel",), within=("series_id",))
    return rounded(c.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("x").alias("total")), 4)


@query(
    "split_by_date",
    """SELECT o_orderstatus, CASE WHEN o_orderdate < TIMESTAMP '1999-06-01' THEN 'train' ELSE 'test' END AS part, count(*) AS n
       FROM orders GROUP BY ALL""",
)
def split_by_date(spark, d):
    train, test = S.split_by_date(table(spark, d, "orders"), dt.datetime(1999, 6, 1), "o_orderdate")
    both = S.stack({"train": train, "test": test}, "part")
    return both.groupBy("o_orderstatus", "part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stack_tables",
    """SELECT source, k, count(*) AS n, round(sum(v), 2) AS v FROM (
         SELECT 'orders' AS source, o_orderstatus AS k, o_totalprice AS v FROM orders
         UNION ALL SELECT 'lines', l_linestatus, l_extendedprice FROM lineitem) GROUP BY ALL""",
)
def stack_tables(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("k"), F.col("o_totalprice").alias("v"))
    li = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("k"), F.col("l_extendedprice").alias("v"))
    return S.stack({"orders": o, "lines": li}, "source").groupBy("source", "k").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("v")
    )


@query(
    "pivot_mean",
    """SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS "F_qty", round(avg(l_tax) FILTER (l_linestatus = 'F'), 6) AS "F_tax",
         round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS "O_qty", round(avg(l_tax) FILTER (l_linestatus = 'O'), 6) AS "O_tax"
       FROM lineitem GROUP BY 1""",
)
def pivot_mean(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("qty"), F.col("l_tax").alias("tax"))
    return rounded(S.pivot_mean(li, "l_returnflag", "l_linestatus", ["qty", "tax"], ["F", "O"]))


@query(
    "crosstab",
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
         count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""",
)
def crosstab(spark, d):
    return S.crosstab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query(
    "best_row",
    """SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority
         ORDER BY o_orderstatus, -o_totalprice, o_orderkey) AS r FROM orders) WHERE r = 1""",
)
def best_row(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice", "o_orderstatus")
    best = S.best_row(o, [F.col("o_orderstatus"), -F.col("o_totalprice"), F.col("o_orderkey")], keys=("o_orderpriority",))
    return best.drop("o_orderstatus")


@query("smallest_k", "SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 20")
def smallest_k(spark, d):
    return S.smallest(table(spark, d, "events").select("event_id", "value"), 20, F.col("value"), F.col("event_id"))


@query(
    "join_original",
    f"""WITH {SQL_EVENT}, c AS (SELECT series_id, t, x / 3 AS x FROM s_event)
      SELECT c.series_id, count(*) AS n, round(sum(abs(s.x - 3 * c.x)), 6) AS gap FROM c JOIN s_event s USING (series_id, t) GROUP BY 1""",
)
def join_original(spark, d):
    s = event_series(spark, d)
    j = S.with_original(s.select("series_id", "t", (F.col("x") / 3).alias("x")), s)
    return rounded(j.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(F.col("original") - 3 * F.col("x"))).alias("gap")))


@query(
    "side_by_side",
    """WITH m AS (SELECT event_type, date_part('hour', ts) AS h, avg(value) AS v FROM events GROUP BY ALL)
      SELECT CAST(a.h AS INTEGER) AS h, round(a.v, 6) AS v_a, round(b.v, 6) AS v_b FROM m a JOIN m b USING (h) WHERE a.event_type = 'click' AND b.event_type = 'view'""",
)
def side_by_side(spark, d):
    m = table(spark, d, "events").groupBy(F.col("event_type").alias("series_id"), F.hour("ts").alias("h")).agg(F.avg("value").alias("v"))
    return rounded(S.side_by_side(m, "click", "view", ["h"], ["v"]))


@query(
    "parameter_grid",
    f"""WITH {SQL_HOUR}, g AS (SELECT * FROM (VALUES (0, 0.1::DOUBLE), (1, 0.5::DOUBLE), (2, 0.9::DOUBLE)) v(point, w))
      SELECT series_id, point, w, round(sum(w * x), 4) AS total FROM s_hour, g GROUP BY ALL""",
)
def parameter_grid(spark, d):
    g = S.with_grid(hour_series(spark, d), [{"w": 0.1}, {"w": 0.5}, {"w": 0.9}])
    return rounded(g.groupBy("series_id", "point", "w").agg(F.sum(F.col("w") * F.col("x")).alias("total")), 4)


# ---------------------------------------------------------------- windows
@query(
    "returns",
    f"""WITH {SQL_SHIP} SELECT series_id, t, round((x / lag(x) OVER w - 1) * 100, 6) + 0.0 AS ret, round(ln(x / lag(x) OVER w) * 100, 6) + 0.0 AS log_ret,
      round(x - lag(x) OVER w, 6) + 0.0 AS d1, round((x - lag(x) OVER w) - (lag(x) OVER w - lag(x, 2) OVER w), 6) + 0.0 AS d2
      FROM s_ship WINDOW w AS (PARTITION BY series_id ORDER BY t)""",
)
def returns(spark, d):
    return rounded(W.change_columns(ship_series(spark, d)).select("series_id", "t", "ret", "log_ret", "d1", "d2"))


@query(
    "rolling_mean_std",
    f"""WITH {SQL_EVENT} SELECT series_id, t, CASE WHEN t >= 49 THEN round(avg(x) OVER a, 6) END AS mean_50,
      CASE WHEN t >= 199 THEN round(avg(x) OVER b, 6) END AS mean_200, CASE WHEN t >= 29 THEN round(stddev_samp(x) OVER c, 6) END AS std_30
      FROM s_event WINDOW a AS (PARTITION BY series_id ORDER BY t ROWS 49 PRECEDING), b AS (PARTITION BY series_id ORDER BY t ROWS 199 PRECEDING),
      c AS (PARTITION BY series_id ORDER BY t ROWS 29 PRECEDING)""",
)
def rolling_mean_std(spark, d):
    return rounded(W.rolling(event_series(spark, d), [50, 200], [30]).select("series_id", "t", "mean_50", "mean_200", "std_30"))


@query(
    "rolling_iqr",
    f"""WITH {SQL_SHIP} SELECT a.series_id, a.t, round(quantile_cont(b.x, 0.75) - quantile_cont(b.x, 0.25), 9) AS iqr
      FROM s_ship a JOIN s_ship b ON a.series_id = b.series_id AND b.t BETWEEN a.t - 251 AND a.t WHERE a.t >= 251 GROUP BY ALL""",
)
def rolling_iqr(spark, d):
    return rounded(W.rolling_iqr(ship_series(spark, d)).where(F.col("iqr").isNotNull()).select("series_id", "t", "iqr"), 9)


@query(
    "dispersion_variability",
    f"""WITH {SQL_SHIP}, q AS (SELECT a.series_id, a.t, quantile_cont(b.x, 0.75) - quantile_cont(b.x, 0.25) AS iqr
      FROM s_ship a JOIN s_ship b ON a.series_id = b.series_id AND b.t BETWEEN a.t - 251 AND a.t WHERE a.t >= 251 GROUP BY ALL)
      SELECT series_id, round(avg(iqr), 6) AS iqr_mean, round(stddev_samp(iqr), 6) AS iqr_std, round(stddev_samp(iqr) / avg(iqr), 6) AS iqr_cv FROM q GROUP BY 1""",
)
def dispersion_variability(spark, d):
    return rounded(W.dispersion_variability(ship_series(spark, d)))


@query(
    "amplitude_variability",
    f"""WITH {SQL_SHIP}, v AS (SELECT a.series_id, a.t, stddev_samp(b.x) AS s FROM s_ship a JOIN s_ship b
        ON a.series_id = b.series_id AND b.t BETWEEN a.t - 251 AND a.t WHERE a.t >= 251 GROUP BY ALL)
      SELECT series_id, round(avg(s), 6) AS vol_mean, round(stddev_samp(s), 6) AS vol_std, round(stddev_samp(s) / avg(s), 6) AS vol_cv,
        round(max(s) / min(s), 6) AS vol_max_min, CASE WHEN stddev_samp(s) / avg(s) > 0.3 THEN 'high' ELSE 'moderate' END AS amplitude FROM v GROUP BY 1""",
)
def amplitude_variability(spark, d):
    return rounded(W.amplitude_variability(ship_series(spark, d)))


@query(
    "frequency_variability",
    f"""WITH {SQL_SHIP}, m AS (SELECT a.series_id, a.t AS i, avg(b.x) AS m FROM s_ship a JOIN s_ship b
        ON a.series_id = b.series_id AND b.t BETWEEN a.t - 252 AND a.t - 1 WHERE a.t >= 252 GROUP BY ALL),
      g AS (SELECT m.series_id, m.i, sign(b.x - m.m) AS s, lag(sign(b.x - m.m)) OVER (PARTITION BY m.series_id, m.i ORDER BY b.t) AS p
        FROM m JOIN s_ship b ON b.series_id = m.series_id AND b.t BETWEEN m.i - 252 AND m.i - 1),
      c AS (SELECT series_id, i, CAST(count(*) FILTER (p IS NOT NULL AND s <> p) AS DOUBLE) AS c FROM g GROUP BY ALL),
      r AS (SELECT series_id, t, sign(x - avg(x) OVER (PARTITION BY series_id ORDER BY t ROWS 251 PRECEDING)) AS s FROM s_ship),
      rr AS (SELECT series_id, s, lag(s) OVER (PARTITION BY series_id ORDER BY t) AS p FROM r WHERE t >= 251),
      x AS (SELECT series_id, count(*) FILTER (p IS NOT NULL AND s <> p) AS crossings FROM rr GROUP BY 1)
      SELECT c.series_id, any_value(crossings) AS crossings, round(avg(c), 6) AS freq_mean, round(stddev_pop(c), 6) AS freq_std,
        round(stddev_pop(c) / avg(c), 6) AS freq_cv, CASE WHEN stddev_pop(c) / avg(c) > 0.3 THEN 'high' ELSE 'moderate' END AS frequency
      FROM c JOIN x USING (series_id) GROUP BY 1""",
)
def frequency_variability(spark, d):
    return rounded(W.frequency_variability(ship_series(spark, d)))


PEAKS = """SELECT series_id, a.lo AS lo, a.hi AS hi, a.x AS x FROM (
   SELECT series_id, g, min(t) AS lo, max(t) AS hi, any_value(x) AS x FROM (
     SELECT *, sum(brk) OVER (PARTITION BY series_id ORDER BY t) AS g FROM (
       SELECT *, CASE WHEN x = lag(x) OVER (PARTITION BY series_id ORDER BY t) THEN 0 ELSE 1 END AS brk FROM {src})) GROUP BY ALL) a
   QUALIFY a.x > lag(a.x) OVER (PARTITION BY series_id ORDER BY lo) AND a.x > lead(a.x) OVER (PARTITION BY series_id ORDER BY lo)"""


@query(
    "local_maxima",
    f"WITH {SQL_EVENT.replace('value AS x', 'round(value, -1) AS x')}, p AS ({PEAKS.format(src='s_event')}) SELECT series_id, CAST(floor((lo + hi) / 2) AS BIGINT) AS t, x FROM p",
)
def local_maxima(spark, d):
    s = event_series(spark, d).withColumn("x", F.round("x", -1) + 0.0)
    return W.local_maxima(s.select("series_id", "t", "x")).withColumn("t", F.col("t").cast("long"))


@query(
    "delay_embedding",
    f"""WITH {SQL_EVENT} SELECT a.series_id, a.t, a.x AS c0, b.x AS c1, c.x AS c2 FROM s_event a
      JOIN s_event b ON b.series_id = a.series_id AND b.t = a.t + 7 JOIN s_event c ON c.series_id = a.series_id AND c.t = a.t + 14""",
)
def delay_embedding(spark, d):
    e = W.delay_embedding(event_series(spark, d), 7, 3)
    return e.select("series_id", "t", *[F.get("vec", F.lit(i)).alias(f"c{i}") for i in range(3)])


@query(
    "lagged_pairs",
    f"""WITH {SQL_EVENT} SELECT a.series_id, b.t - a.t AS tau, count(*) AS n, round(sum(a.x * b.x), 4) AS s FROM s_event a JOIN s_event b
      ON a.series_id = b.series_id AND b.t BETWEEN a.t + 1 AND a.t + 10 GROUP BY ALL""",
)
def lagged_pairs(spark, d):
    p = W.lagged_pairs(event_series(spark, d), 10).withColumn("tau", F.col("tau").cast("long"))
    return p.groupBy("series_id", "tau").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x") * F.col("y")), 4).alias("s"))


@query(
    "random_windows",
    f"""WITH {SQL_USER}, n AS (SELECT series_id, max(t) + 1 AS n FROM s_user GROUP BY 1),
      w AS (SELECT *, range AS w FROM n, range(20480) WHERE range * 5 < n),
      z AS (SELECT *, 5 + CAST(floor((('0x' || substr(md5(series_id || '|0|' || w || '|7'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE * 16) AS BIGINT) AS size FROM w),
      e AS (SELECT *, CAST(sum(size) OVER (PARTITION BY series_id ORDER BY w) AS BIGINT) AS stop FROM z)
      SELECT e.series_id, w AS window_id, n - 1 - t - (stop - size) AS pos, t, x FROM e JOIN s_user s ON s.series_id = e.series_id
        AND n - 1 - t >= stop - size AND n - 1 - t < stop""",
)
def random_windows(spark, d):
    return W.random_windows(user_series(spark, d), 20, 5, seed=7)


@query(
    "random_windows_overlapping",
    f"""WITH {SQL_USER}, n AS (SELECT series_id, max(t) + 1 AS n FROM s_user GROUP BY 1), w AS (SELECT *, range AS window_id FROM n, range(5)),
      u AS (SELECT *, (('0x' || substr(md5('start|' || series_id || '|' || window_id || '|7'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS a,
        (('0x' || substr(md5('size|' || series_id || '|' || window_id || '|7'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS b FROM w),
      f AS (SELECT *, CAST(floor(a * n) AS BIGINT) AS f FROM u),
      z AS (SELECT *, least(5, n - f) + CAST(floor(b * (least(20, n - f) - least(5, n - f) + 1)) AS BIGINT) AS size FROM f)
      SELECT z.series_id, CAST(window_id AS INTEGER) AS window_id, n - 1 - f - t AS pos, t, x FROM z JOIN s_user s ON s.series_id = z.series_id
        AND n - 1 - t >= f AND n - 1 - t < f + size WHERE size > 1""",
)
def random_windows_overlapping(spark, d):
    return W.random_windows(user_series(spark, d), 20, 5, mode=2, count=5, seed=7)


@query(
    "window_split",
    """SELECT user_id, CASE WHEN (('0x' || substr(md5('split|' || user_id || '|0'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE < 0.8
         THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM events GROUP BY ALL""",
)
def window_split(spark, d):
    e = table(spark, d, "events").withColumn("part", W.split_windows(F.col("user_id")))
    return e.groupBy("user_id", "part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "pad_windows",
    f"""WITH {SQL_USER}, w AS (SELECT series_id, t // 12 AS window_id, t % 12 AS pos, x FROM s_user),
      full_w AS (SELECT series_id, window_id, range AS position FROM (SELECT DISTINCT series_id, window_id FROM w), range(12))
      SELECT f.series_id, f.window_id, CAST(position AS INTEGER) AS position, coalesce(x, 0) AS value, CASE WHEN x IS NULL THEN 0 ELSE 1 END AS mask
      FROM full_w f LEFT JOIN w ON w.series_id = f.series_id AND w.window_id = f.window_id AND w.pos = f.position""",
)
def pad_windows(spark, d):
    w = user_series(spark, d).select(
        "series_id", F.floor(F.col("t") / 12).alias("window_id"), (F.col("t") % 12).alias("pos"), "x"
    )
    p = W.pad_windows(w, 12)
    z = p.select("series_id", "window_id", F.explode(F.arrays_zip("values", "mask", "position")).alias("z"))
    return z.select("series_id", "window_id", "z.position", F.col("z.values").alias("value"), "z.mask")


@query(
    "masked_error",
    """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
      p AS (SELECT vec_id, CASE WHEN i % 3 = 0 THEN 0 ELSE v END AS y, v * 0.5 AS g FROM v)
      SELECT vec_id, round(avg((y - g) * (y - g)) FILTER (y <> 0), 9) AS err FROM p GROUP BY 1""",
)
def masked_error(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    y = F.transform("v", lambda v, i: F.when((i + 1) % 3 == 0, 0.0).otherwise(v))
    g = F.transform("v", lambda v: v * 0.5)
    return rounded(e.select("vec_id", W.masked_squared_error(y, g).alias("err")), 9)


# ---------------------------------------------------------------- aggregates
@query(
    "price_summary",
    f"""WITH {SQL_SHIP}, r AS (SELECT *, (x / lag(x) OVER (PARTITION BY series_id ORDER BY t) - 1) * 100 AS ret FROM s_ship),
      v AS (SELECT *, CASE WHEN t >= 30 THEN stddev_samp(ret) OVER (PARTITION BY series_id ORDER BY t ROWS 29 PRECEDING) END AS vol FROM r)
      SELECT series_id, count(x) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts,
        round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round((arg_max(x, t) / arg_min(x, t) - 1) * 100, 6) AS total_return,
        round(avg(ret), 6) AS ret_mean, round(stddev_samp(ret), 6) AS ret_std, round(avg(vol), 6) AS vol_mean, round(max(vol), 6) AS vol_max
      FROM v GROUP BY 1""",
)
def price_summary(spark, d):
    s = A.price_summary(ship_series(spark, d))
    return rounded(s.withColumns({"first_ts": stamp("first_ts"), "last_ts": stamp("last_ts")}))


@query(
    "yearly_returns",
    f"""WITH {SQL_SHIP}, r AS (SELECT *, (x / lag(x) OVER (PARTITION BY series_id ORDER BY t) - 1) * 100 AS ret FROM s_ship)
      SELECT series_id, CAST(year(ts) AS INTEGER) AS year, round(avg(ret), 4) AS mean, round(stddev_samp(ret), 4) AS std, round(sum(ret), 4) AS sum
      FROM r WHERE ret IS NOT NULL GROUP BY ALL""",
)
def yearly_returns(spark, d):
    return rounded(A.yearly_returns(ship_series(spark, d)), 4)


@query(
    "event_summary",
    """SELECT l_returnflag, count(*) FILTER (l_discount > 0) AS l_discount_count, round(sum(l_discount), 4) AS l_discount_sum,
         round(avg(l_discount) FILTER (l_discount > 0), 4) AS l_discount_mean, max(l_discount) AS l_discount_max,
         count(*) FILTER (l_tax > 0) AS l_tax_count, round(sum(l_tax), 4) AS l_tax_sum,
         round(avg(l_tax) FILTER (l_tax > 0), 4) AS l_tax_mean, max(l_tax) AS l_tax_max FROM lineitem GROUP BY 1""",
)
def event_summary(spark, d):
    return rounded(A.event_summary(table(spark, d, "lineitem"), ["l_discount", "l_tax"], keys=("l_returnflag",)), 4)


@query(
    "describe",
    """SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min,
         max(value) AS max, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
         round(quantile_cont(value, 0.75), 6) AS q75 FROM events GROUP BY 1""",
)
def describe(spark, d):
    return rounded(A.describe(table(spark, d, "events"), "value", keys=("event_type",)))


@query(
    "moments_jarque_bera",
    f"""WITH {SQL_EVENT}, m AS (SELECT series_id, avg(x) AS m FROM s_event GROUP BY 1),
      p AS (SELECT s.series_id, count(*)::DOUBLE AS n, avg(pow(x - m, 2)) AS m2, avg(pow(x - m, 3)) AS m3, avg(pow(x - m, 4)) AS m4
        FROM s_event s JOIN m USING (series_id) GROUP BY 1),
      g AS (SELECT *, m3 / pow(m2, 1.5) AS g1, m4 / (m2 * m2) - 3 AS g2 FROM p)
      SELECT series_id, CAST(n AS BIGINT) AS n, round(g1 * sqrt(n * (n - 1)) / (n - 2), 6) AS skew,
        round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6), 6) AS kurtosis, round(n / 6 * (g1 * g1 + g2 * g2 / 4), 3) AS jb,
        round(exp(-n / 12 * (g1 * g1 + g2 * g2 / 4)), 6) AS jb_p, exp(-n / 12 * (g1 * g1 + g2 * g2 / 4)) > 0.05 AS normal FROM g""",
)
def moments_jarque_bera(spark, d):
    return rounded(A.moments(event_series(spark, d)).withColumn("jb", F.round("jb", 3)))


@query(
    "histogram",
    f"""WITH {SQL_EVENT}, s AS (SELECT series_id, min(x) AS lo, max(x) AS hi FROM s_event GROUP BY 1)
      SELECT series_id, CAST(least(floor((x - lo) / (hi - lo) * 50), 49) AS INTEGER) AS bin, count(*) AS count FROM s_event JOIN s USING (series_id) GROUP BY ALL""",
)
def histogram(spark, d):
    return A.histogram(event_series(spark, d))


@query(
    "embedding_dispersion",
    f"""WITH {SQL_EVENT}, e AS (SELECT a.series_id, a.x AS c0, b.x AS c1 FROM s_event a JOIN s_event b ON b.series_id = a.series_id AND b.t = a.t + 3)
      SELECT series_id, round(var_samp(c0) + var_samp(c1), 4) AS dispersion, round(greatest(max(c0), max(c1)) - least(min(c0), min(c1)), 4) AS value_range
      FROM e GROUP BY 1""",
)
def embedding_dispersion(spark, d):
    return rounded(A.embedding_dispersion(W.delay_embedding(event_series(spark, d), 3, 2)), 4)


@query(
    "readout",
    """WITH v AS (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(0, 64)) AS f FROM embeddings)
      SELECT label, CAST(f AS INTEGER) AS feature, round(sum(v), 6) + 0.0 AS sum, round(avg(v), 6) + 0.0 AS mean, round(quantile_disc(v, 0.5), 6) + 0.0 AS median, round(max(v), 6) + 0.0 AS max,
        round(product(v), 6) + 0.0 AS mul, round(stddev_pop(v), 6) AS std, round(var_pop(v), 6) AS var FROM v GROUP BY ALL""",
)
def readout(spark, d):
    e = table(spark, d, "embeddings")
    n = e.select("label", F.col("vec_id").alias("node"), F.transform("embedding", lambda v: v.cast("double")).alias("features"))
    return rounded(A.readout(n, keys=("label",)))


@query(
    "probe_signals",
    f"""WITH {SQL_EVENT}, q AS (SELECT series_id, t, t / 500.0::DOUBLE AS s FROM s_event)
      SELECT series_id, t, round(2 * sin(2 * pi() * 3 * s + 0.5), 6) + 0.0 AS tone, round(sin(2 * pi() * 8 * s) + sin(2 * pi() * 9 * s), 6) + 0.0 AS beat,
        round(cos(2 * pi() * (1.5 + 1.2 * s) * s), 6) + 0.0 AS chirp,
        round(sin(2 * pi() * 2 * s) + CASE WHEN s BETWEEN 1 AND 3 THEN 0.6 * sin(2 * pi() * 20 * s) ELSE 0 END, 6) + 0.0 AS burst, round(8 * s / 5, 6) AS ramp FROM q""",
)
def probe_signals(spark, d):
    s = F.col("t") / 500.0
    return rounded(
        event_series(spark, d).select(
            "series_id", "t", signals.tone(s, 3, 2.0, 0.5).alias("tone"), signals.close_tones(s, 8, 9).alias("beat"),
            signals.chirp(s, 1.5, 1.2).alias("chirp"), signals.burst_on_carrier(s, 2, 20, 0.6, 1, 3).alias("burst"),
            signals.ramp(s, 8.0, 5.0).alias("ramp"),
        )
    )


@query(
    "hash_uniform",
    """SELECT event_id, round((('0x' || substr(md5('n|' || event_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE, 9) AS u FROM events""",
)
def hash_uniform(spark, d):
    return rounded(table(spark, d, "events").select("event_id", uniform("n", F.col("event_id")).alias("u")), 9)


# ---------------------------------------------------------------- text
# LaTeX markup put around the given texts, so that every rule has something to remove
LATEX_HEAD = "\\documentclass{article}\n\\begin{document}\n\\section{Part one}\n\\label{a}See \\textbf{bold}~\\ref{x} \\citep{y}\n"
LATEX_TAIL = (
    "\n\n\n\n\\begin{itemize}\n\\item first\n\\item \\textbf{second}\n\\end{itemize}\n\\begin{table}\na & b\n\\end{table}\n"
    "\\newblock \\emph{end}  \\alpha\n\\end{document}\nlost"
)


def _latex_sql() -> str:
    from tidegraph.operators.text import ENVIRONMENTS, LAST, LATEX_RULES

    document = ((r"(?s).*?\\begin\{document\}", ""), (r"(?s)\\end\{document\}.*", ""))
    whole = tuple((rf"(?s)\\begin\{{{n}\}}.*?\\end\{{{n}\}}", "") for n in ENVIRONMENTS)
    quote = lambda s: s.replace("'", "''")
    expr = f"'{quote(LATEX_HEAD)}' || text || '{quote(LATEX_TAIL)}'"
    for pattern, keep in (*document, *LATEX_RULES, *whole, *LAST):
        expr = f"regexp_replace({expr}, '{quote(pattern)}', '{quote(keep.replace('$', chr(92)))}', 'g')"
    lines = f"[y for y in [regexp_replace(s, '^\\s+|\\s+$', '', 'g') for s in string_split({expr}, chr(10))] if y <> '']"
    return f"SELECT doc_id, array_to_string({lines}, chr(10)) AS text FROM documents"


@query("strip_latex", _latex_sql())
def strip_latex_query(spark, d):
    raw = F.concat(F.lit(LATEX_HEAD), F.col("text"), F.lit(LATEX_TAIL))
    return table(spark, d, "documents").select("doc_id", strip_latex(raw).alias("text"))
