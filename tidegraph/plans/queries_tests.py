"""Checked queries on dependence and nonlinearity tests, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegraph.core import cut
from tidegraph.functions.closed import ADF_LARGE, ADF_SMALL, NORMAL_B, NORMAL_P  # noqa: F401
from tidegraph.operators import dependence as D
from tidegraph.operators import windows as W
from tidegraph.operators.decompose import band_split
from tidegraph.plans.inputs import SQL_EVENT, SQL_HOUR, SQL_SHIP, event_series, hour_series, ship_series
from tidegraph.plans.queries_series import rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


SQL_RET = f"""{SQL_SHIP}, s_ret AS (SELECT series_id, t - 1 AS t, r AS x FROM (SELECT series_id, t,
  (x / lag(x) OVER (PARTITION BY series_id ORDER BY t) - 1) * 100 AS r FROM s_ship) WHERE r IS NOT NULL)"""


def ship_returns(spark, d):
    r = W.change_columns(ship_series(spark, d)).where(F.col("ret").isNotNull())
    return r.select("series_id", (F.col("t") - 1).alias("t"), F.col("ret").alias("x"))


def _acf(src: str, top: int) -> str:
    return f"""c AS (SELECT s.series_id, t, x * x - m AS v, n FROM {src} s JOIN (SELECT series_id, avg(x * x) AS m, count(*) AS n FROM {src} GROUP BY 1) USING (series_id)),
      v AS (SELECT series_id, sum(v * v) AS v, any_value(n) AS n FROM c GROUP BY 1),
      rho AS (SELECT a.series_id, b.t - a.t AS tau, sum(a.v * b.v) / any_value(v.v) AS rho, any_value(v.n) AS n FROM c a JOIN c b
        ON a.series_id = b.series_id AND b.t BETWEEN a.t + 1 AND a.t + {top} JOIN v ON v.series_id = a.series_id GROUP BY ALL)"""


@query("autocorrelation", f"WITH {SQL_EVENT}, {_acf('s_event', 20)} SELECT series_id, tau, round(rho, 6) + 0.0 AS rho, n FROM rho")
def autocorrelation(spark, d):
    return rounded(D.autocorrelation(event_series(spark, d), 20).withColumn("tau", F.col("tau").cast("long")))


@query(
    "squares_ljung_box",
    f"""WITH {SQL_EVENT}, {_acf('s_event', 20)}, q AS (SELECT series_id, CAST(count(*) FILTER (abs(rho) > 1.96 / sqrt(n)) AS BIGINT) AS significant_lags, max(abs(rho)) AS max_rho,
        any_value(n * (n + 2)) * sum(CASE WHEN tau <= 10 THEN rho * rho / (n - tau) END) AS lb FROM rho GROUP BY 1)
      SELECT series_id, significant_lags, round(max_rho, 6) AS max_rho, round(lb, 6) AS lb,
        round(exp(-lb / 2) * (1 + lb / 2 + pow(lb / 2, 2) / 2 + pow(lb / 2, 3) / 6 + pow(lb / 2, 4) / 24), 6) AS lb_p,
        exp(-lb / 2) * (1 + lb / 2 + pow(lb / 2, 2) / 2 + pow(lb / 2, 3) / 6 + pow(lb / 2, 4) / 24) < 0.05 AS nonlinear FROM q""",
)
def squares_ljung_box(spark, d):
    return rounded(D.square_dependence(event_series(spark, d)))


@query("adf")
def adf(spark, d):
    return rounded(D.adf(hour_series(spark, d)))


@query(
    "kpss",
    f"""WITH {SQL_HOUR}, f AS (SELECT series_id, regr_slope(x, t) AS b, regr_intercept(x, t) AS a, count(*)::DOUBLE AS n FROM s_hour GROUP BY 1),
      r AS (SELECT s.series_id, t, x - a - b * t AS r, n FROM s_hour s JOIN f USING (series_id)),
      p AS (SELECT a.series_id, b.t - a.t AS k, sum(a.r * b.r) AS c, any_value(a.n) AS n FROM r a JOIN r b ON a.series_id = b.series_id AND b.t > a.t AND b.t <= a.t + 60 GROUP BY ALL),
      rr AS (SELECT series_id, sum(r * r) AS rr, any_value(n) AS n FROM r GROUP BY 1),
      g AS (SELECT p.series_id, any_value(rr) AS rr, any_value(p.n) AS n, any_value(rr / rr.n) + sum(c / (p.n / 2)) AS s0, sum(k * c / (p.n / 2)) AS s1 FROM p JOIN rr ON rr.series_id = p.series_id
        WHERE k <= floor(pow(p.n, 2 / 9::DOUBLE)) GROUP BY p.series_id),
      l AS (SELECT *, CAST(floor(1.1447 * pow(pow(s1 / s0, 2), 1 / 3::DOUBLE) * pow(n, 1 / 3::DOUBLE)) AS INTEGER) AS lags FROM g),
      w AS (SELECT p.series_id, any_value(lags) AS lags, any_value(l.rr) AS rr, any_value(l.n) AS n, sum(CASE WHEN k <= lags THEN (1 - k / (lags + 1.0::DOUBLE)) * c ELSE 0 END) AS w
        FROM l JOIN p ON p.series_id = l.series_id GROUP BY p.series_id),
      walk AS (SELECT series_id, sum(s * s) AS ss FROM (SELECT series_id, sum(r) OVER (PARTITION BY series_id ORDER BY t) AS s FROM r) GROUP BY 1),
      k AS (SELECT series_id, lags, (ss / (n * n)) / ((rr + 2 * w) / n) AS kpss FROM w JOIN walk USING (series_id)),
      pv AS (SELECT *, CASE WHEN kpss <= 0.119 THEN 0.10 WHEN kpss <= 0.146 THEN 0.10 - (kpss - 0.119) / 0.027 * 0.05 WHEN kpss <= 0.176 THEN 0.05 - (kpss - 0.146) / 0.03 * 0.025
        WHEN kpss <= 0.216 THEN 0.025 - (kpss - 0.176) / 0.04 * 0.015 ELSE 0.01 END AS p FROM k)
      SELECT series_id, lags, round(kpss, 6) AS kpss, CAST(round(p, 6) AS DOUBLE) AS kpss_p, p > 0.05 AS stationary FROM pv""",
)
def kpss(spark, d):
    return rounded(D.kpss(hour_series(spark, d)))


SQL_AR = f"""{SQL_HOUR}, lagd AS (SELECT series_id, t, x, lag(x) OVER (PARTITION BY series_id ORDER BY t) AS l FROM s_hour),
  ar AS (SELECT series_id, regr_slope(x, l) AS phi, regr_intercept(x, l) AS const, count(l) AS n FROM lagd WHERE l IS NOT NULL GROUP BY 1),
  resid AS (SELECT g.series_id, t - 1 AS t, x - const - phi * l AS x FROM lagd g JOIN ar USING (series_id) WHERE l IS NOT NULL)"""


@query("ar1_coefficients", f"WITH {SQL_AR} SELECT series_id, round(phi, 6) AS phi, round(const, 6) AS const, n FROM ar")
def ar1_coefficients(spark, d):
    return rounded(D.ar1(hour_series(spark, d))[0])


@query("ar1_residuals", f"WITH {SQL_AR} SELECT series_id, t, round(x, 6) + 0.0 AS x FROM resid")
def ar1_residuals(spark, d):
    return rounded(D.ar1(hour_series(spark, d))[1])


def _phi(z: str) -> str:
    k = f"(1 / (1 + {NORMAL_P} * {z}))"
    b = NORMAL_B
    return f"(exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {k} * ({b[0]} + {k} * ({b[1]} + {k} * ({b[2]} + {k} * ({b[3]} + {k} * {b[4]}::DOUBLE)))))"


@query(
    "bds",
    f"""WITH {SQL_AR}, e AS (SELECT series_id, 1.5 * stddev_samp(x) AS e, count(*)::DOUBLE AS n FROM resid GROUP BY 1),
      close AS MATERIALIZED (SELECT a.series_id, a.t AS i, b.t AS j FROM resid a JOIN resid b USING (series_id) JOIN e USING (series_id) WHERE a.t < b.t AND abs(a.x - b.x) < e.e),
      c AS (SELECT series_id, i, count(*) + 1 AS c FROM (SELECT series_id, i FROM close UNION ALL SELECT series_id, j FROM close) GROUP BY ALL),
      k AS (SELECT e.series_id, any_value(n) AS n, (sum(c * c) + (any_value(n) - count(*)) - 3 * (sum(c) + any_value(n) - count(*)) + 2 * any_value(n)) / (any_value(n) * (any_value(n) - 1) * (any_value(n) - 2)) AS k,
          (sum(c) - count(*)) / (any_value(n) * (any_value(n) - 1)) AS c1 FROM c JOIN e USING (series_id) GROUP BY 1),
      m2 AS MATERIALIZED (SELECT a.* FROM close a SEMI JOIN close b ON a.series_id = b.series_id AND b.i = a.i + 1 AND b.j = a.j + 1),
      m3 AS MATERIALIZED (SELECT a.* FROM m2 a SEMI JOIN close b ON a.series_id = b.series_id AND b.i = a.i + 2 AND b.j = a.j + 2),
      m4 AS MATERIALIZED (SELECT a.* FROM m3 a SEMI JOIN close b ON a.series_id = b.series_id AND b.i = a.i + 3 AND b.j = a.j + 3),
      m5 AS MATERIALIZED (SELECT a.* FROM m4 a SEMI JOIN close b ON a.series_id = b.series_id AND b.i = a.i + 4 AND b.j = a.j + 4),
      cm AS (SELECT series_id, 2 AS m, count(*) AS p FROM m2 GROUP BY 1 UNION ALL SELECT series_id, 3, count(*) FROM m3 GROUP BY 1
        UNION ALL SELECT series_id, 4, count(*) FROM m4 GROUP BY 1 UNION ALL SELECT series_id, 5, count(*) FROM m5 GROUP BY 1),
      tail AS (SELECT series_id, m, count(*) AS p FROM close, (VALUES (2), (3), (4), (5)) v(m) WHERE i >= m - 1 GROUP BY ALL),
      z AS (SELECT cm.series_id, cm.m, n - cm.m + 1 AS s, k, c1, cm.p AS pm, tail.p AS p1 FROM cm JOIN tail USING (series_id, m) JOIN k USING (series_id)),
      b AS (SELECT series_id, m, sqrt(s) * (pm / (s * (s - 1) / 2) - pow(p1 / (s * (s - 1) / 2), m)) /
        sqrt(4 * (pow(k, m) + 2 * (SELECT sum(pow(k, m - j) * pow(c1, 2 * j)) FROM range(1, 5) r(j) WHERE j < m) + (m - 1) * (m - 1) * pow(c1, 2 * m) - m * m * k * pow(c1, 2 * m - 2))) AS v FROM z)
      SELECT series_id, m, round(v, 5) + 0.0 AS bds, round(2 * {_phi('abs(v)')}, 5) AS bds_p FROM b""",
)
def bds(spark, d):
    _, resid = D.ar1(hour_series(spark, d))
    return rounded(D.bds(resid), 5)


@query(
    "close_counts",
    f"""WITH {SQL_EVENT} SELECT a.series_id, a.t, count(*) AS c FROM s_event a JOIN s_event b USING (series_id) WHERE b.x < a.x + 2.503 AND b.x > a.x - 2.503 GROUP BY ALL""",
)
def close_counts(spark, d):
    s = cut(event_series(spark, d))
    r = s.select("series_id").distinct().withColumn("r", F.lit(2.503))
    return D.close_counts(s, r)


GRID = [{"omega": o, "alpha": a, "beta": b} for o, a, b in ((0.9, 0.1, 0.0), (0.7, 0.3, 0.0), (0.5, 0.5, 0.0), (0.1, 0.1, 0.8), (0.05, 0.05, 0.9), (0.3, 0.2, 0.5))]
_GRID_SQL = ", ".join(f"({i}, {g['omega']}::DOUBLE, {g['alpha']}::DOUBLE, {g['beta']}::DOUBLE)" for i, g in enumerate(GRID))
SQL_VOL = f"""WITH RECURSIVE {SQL_RET}, g AS (SELECT * FROM (VALUES {_GRID_SQL}) v(point, omega, alpha, beta)),
  v AS (SELECT series_id, avg(x * x) AS v, count(*) AS n FROM s_ret GROUP BY 1),
  data AS MATERIALIZED (SELECT series_id, t, x * x AS s FROM s_ret),
  h AS (SELECT v.series_id, point, CAST(0 AS BIGINT) AS t, v AS h, omega * v AS w, alpha, beta FROM v, g
    UNION ALL SELECT h.series_id, point, h.t + 1, w + alpha * d.s + beta * h.h, w, alpha, beta FROM h JOIN data d ON d.series_id = h.series_id AND d.t = h.t),
  l AS (SELECT h.series_id, h.point, sum(-0.5 * (ln(2 * pi()) + ln(h2.h) + d.s / h2.h)) AS ll FROM (SELECT DISTINCT series_id, point FROM h) h
    JOIN h h2 USING (series_id, point) JOIN data d ON d.series_id = h2.series_id AND d.t = h2.t GROUP BY ALL),
  t AS (SELECT l.series_id, l.point, omega, alpha, beta, ll AS loglik, n, CASE WHEN beta = 0 THEN 'arch' ELSE 'garch' END AS model,
    CASE WHEN beta = 0 THEN 2 ELSE 3 END AS k FROM l JOIN g USING (point) JOIN v USING (series_id))"""


@query(
    "volatility_grid",
    f"""{SQL_VOL} SELECT series_id, CAST(point AS INTEGER) AS point, omega, alpha, beta, round(loglik, 4) AS loglik, n, model,
      round(2 * k - 2 * loglik, 4) AS aic, round(k * ln(n) - 2 * loglik, 4) AS bic FROM t""",
)
def volatility_grid(spark, d):
    return rounded(D.volatility_grid(ship_returns(spark, d), GRID), 4)


@query(
    "volatility_best",
    f"""{SQL_VOL} SELECT series_id, model, CAST(point AS INTEGER) AS point, omega, alpha, beta, round(loglik, 4) AS loglik, round(2 * k - 2 * loglik, 4) AS aic,
      round(k * ln(n) - 2 * loglik, 4) AS bic FROM t QUALIFY row_number() OVER (PARTITION BY series_id, model ORDER BY 2 * k - 2 * loglik, point) = 1""",
)
def volatility_best(spark, d):
    return rounded(D.best_volatility(D.volatility_grid(ship_returns(spark, d), GRID)), 4)


@query("verdict")
def verdict(spark, d):
    level = ship_series(spark, d)
    return D.verdict(D.adf(level), D.square_dependence(ship_returns(spark, d)))


def sql_mi(src: str, top: int) -> str:
    return f"""mm AS (SELECT series_id, min(x) AS lo, max(x) AS hi, count(*) AS n, CAST(floor(sqrt(count(*))) AS INTEGER) AS nb FROM {src} GROUP BY 1),
      edge AS (SELECT series_id, CASE WHEN k = nb - 1 THEN hi ELSE k * ((hi - lo) / (nb - 1)) + lo END AS edge FROM mm, range(0, 100000) r(k) WHERE k < nb),
      bin AS MATERIALIZED (SELECT s.series_id, s.t, (SELECT count(*) FROM edge e WHERE e.series_id = s.series_id AND e.edge <= s.x) AS b FROM {src} s),
      pr AS MATERIALIZED (SELECT a.series_id, b.t - a.t AS tau, a.b AS b, b.b AS c, count(*)::DOUBLE AS f FROM bin a JOIN bin b ON a.series_id = b.series_id AND b.t BETWEEN a.t + 1 AND a.t + {top}
        JOIN mm ON mm.series_id = a.series_id WHERE b.t - a.t <= n // 2 - 1 GROUP BY ALL),
      pm AS (SELECT *, sum(f) OVER (PARTITION BY series_id, tau, b) AS fb, sum(f) OVER (PARTITION BY series_id, tau, c) AS fc, sum(f) OVER (PARTITION BY series_id, tau) AS m FROM pr),
      mi AS MATERIALIZED (SELECT series_id, tau, sum(f / m * ln(f * m / (fb * fc))) AS mi FROM pm GROUP BY ALL),
      mil AS (SELECT series_id, tau, round(mi, 12) AS v, lag(round(mi, 12)) OVER w AS p, lead(round(mi, 12)) OVER w AS n FROM mi WINDOW w AS (PARTITION BY series_id ORDER BY tau)),
      tau AS MATERIALIZED (SELECT series_id, CASE WHEN count(*) <= 2 THEN min(tau) ELSE coalesce(min(tau) FILTER (v < p AND v < n), min(tau) FILTER (v > p), min(tau) + 1) END AS tau FROM mil GROUP BY 1)"""


@query("mutual_information", f"WITH {SQL_HOUR}, {sql_mi('s_hour', 50)} SELECT series_id, tau, round(mi, 6) AS mi FROM mi")
def mutual_information(spark, d):
    return rounded(D.mutual_information(hour_series(spark, d), 50).withColumn("tau", F.col("tau").cast("long")))


@query(
    "choose_tau",
    f"""WITH {SQL_HOUR}, {sql_mi('s_hour', 50)}, fr AS (SELECT series_id, min(tau) FILTER (v > p) - 2 AS first_rise FROM mil GROUP BY 1)
      SELECT series_id, tau, first_rise FROM tau JOIN fr USING (series_id)""",
)
def choose_tau(spark, d):
    mi = cut(D.mutual_information(hour_series(spark, d), 50).withColumn("tau", F.col("tau").cast("long")))
    return D.choose_tau(mi).join(D.choose_tau(mi, rule="first_rise").withColumnRenamed("tau", "first_rise"), "series_id")


def sql_fnn(src: str, dims: tuple[int, ...]) -> str:
    parts = []
    for dim in dims:
        joins = " ".join(f"JOIN {src} s{i} ON s{i}.series_id = s0.series_id AND s{i}.t = s0.t + {i} * tau.tau" for i in range(1, dim))
        coords = ", ".join(f"s{i}.x" for i in range(dim))
        parts.append(
            f"""SELECT s0.series_id, {dim} AS d, s0.t AS node, [{coords}] AS v, nx.x AS nxt FROM {src} s0 JOIN tau ON tau.series_id = s0.series_id {joins}
            LEFT JOIN {src} nx ON nx.series_id = s0.series_id AND nx.t = s0.t + {dim} * tau.tau"""
        )
    return f"""emb AS MATERIALIZED ({' UNION ALL '.join(parts)}),
      nn AS (SELECT a.series_id, a.d, a.node, arg_min({{'o': b.node, 'x': b.nxt}}, {{'d': sqrt(list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(a.v, b.v)])), 'o': b.node}}) AS o,
         min(sqrt(list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(a.v, b.v)]))) AS dist, any_value(a.nxt) AS nxt
         FROM emb a JOIN emb b ON a.series_id = b.series_id AND a.d = b.d AND a.node <> b.node GROUP BY ALL),
      fnn AS MATERIALIZED (SELECT series_id, d, avg(CASE WHEN dist > 1e-10 AND abs(nxt - o.x) / dist > 10 THEN 1.0::DOUBLE ELSE 0 END) AS ratio FROM nn GROUP BY ALL),
      dim AS MATERIALIZED (SELECT series_id, coalesce(min(d) FILTER (ratio < 0.1), arg_min(d, {{'r': ratio, 'd': d}})) AS d FROM fnn GROUP BY 1)"""


@query(
    "false_neighbours",
    f"WITH {SQL_HOUR}, {sql_mi('s_hour', 20)}, {sql_fnn('s_hour', (2, 3, 4))} SELECT series_id, d, round(ratio, 6) AS ratio FROM fnn",
)
def false_neighbours(spark, d):
    s = hour_series(spark, d)
    taus = cut(D.choose_tau(D.mutual_information(s, 20)))
    ratios, _ = D.false_neighbours(s, taus, 4)
    return rounded(ratios)


def sql_embed(src: str, dim: int) -> str:
    joins = " ".join(f"JOIN {src} s{i} ON s{i}.series_id = s0.series_id AND s{i}.t = s0.t + {i}" for i in range(1, dim))
    cols = ", ".join(f"s{i}.x AS c{i}" for i in range(dim))
    return f"emb AS MATERIALIZED (SELECT s0.series_id, s0.t AS node, {cols} FROM {src} s0 {joins})"


@query(
    "correlation_dimension",
    f"""WITH {SQL_HOUR}, {sql_embed('s_hour', 4)}, sd AS (SELECT series_id, stddev_samp(x) AS sd FROM s_hour GROUP BY 1),
      r AS (SELECT series_id, CAST(k AS INTEGER) AS k, sd * (0.1 * pow(1.25::DOUBLE, k)) AS r FROM sd, range(8) x(k)),
      pd AS (SELECT a.series_id, greatest(abs(a.c0 - b.c0), abs(a.c1 - b.c1), abs(a.c2 - b.c2), abs(a.c3 - b.c3)) AS dist FROM emb a JOIN emb b ON a.series_id = b.series_id AND a.node < b.node),
      m AS (SELECT series_id, count(*)::DOUBLE AS m FROM emb GROUP BY 1),
      c AS (SELECT r.series_id, r.k, r.r, count(*) FILTER (dist <= r.r) / any_value(m * (m - 1) / 2) AS c FROM pd JOIN r USING (series_id) JOIN m USING (series_id) GROUP BY ALL),
      sl AS (SELECT series_id, regr_slope(ln(c), ln(r)) AS dimension FROM c WHERE c > 0 GROUP BY 1)
      SELECT c.series_id, k, round(r, 6) AS r, round(c, 9) AS c, round(dimension, 6) AS dimension FROM c JOIN sl USING (series_id)""",
)
def correlation_dimension(spark, d):
    sums, slope = D.correlation_dimension(hour_series(spark, d), 4, step=1.25)
    return sums.join(slope, "series_id").select(
        "series_id", "k", F.round("r", 6).alias("r"), F.round("c", 9).alias("c"), F.round("dimension", 6).alias("dimension")
    )


@query(
    "lyapunov",
    f"""WITH {SQL_HOUR}, {sql_embed('s_hour', 3)}, top AS (SELECT series_id, max(node) AS top FROM emb GROUP BY 1),
      nn AS MATERIALIZED (SELECT a.series_id, a.node, arg_min(b.node, {{'d': sqrt((a.c0 - b.c0) * (a.c0 - b.c0) + (a.c1 - b.c1) * (a.c1 - b.c1) + (a.c2 - b.c2) * (a.c2 - b.c2)), 'n': b.node}}) AS o
        FROM emb a JOIN emb b USING (series_id) JOIN top USING (series_id) WHERE abs(a.node - b.node) > 5 AND a.node <= top - 7 AND b.node <= top - 7 GROUP BY ALL),
      nk AS MATERIALIZED (SELECT nn.series_id, CAST(k AS BIGINT) AS k, node + k AS i, o + k AS j FROM nn CROSS JOIN range(8) r(k)),
      f AS (SELECT nn.series_id, k, sqrt((p.c0 - q.c0) * (p.c0 - q.c0) + (p.c1 - q.c1) * (p.c1 - q.c1) + (p.c2 - q.c2) * (p.c2 - q.c2)) AS d FROM nk nn
        JOIN emb p ON p.series_id = nn.series_id AND p.node = nn.i JOIN emb q ON q.series_id = nn.series_id AND q.node = nn.j),
      c AS (SELECT series_id, k, avg(ln(d)) AS v FROM f WHERE d > 0 GROUP BY ALL)
      SELECT series_id, round(regr_slope(v, k), 6) AS exponent FROM c GROUP BY 1""",
)
def lyapunov(spark, d):
    _, slope = D.lyapunov(hour_series(spark, d), 3, 1, 5, 8)
    return rounded(slope)


BAND_SQL = f"""{SQL_SHIP}, av AS MATERIALIZED (SELECT series_id, t, x, x AS m0, avg(x) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m1,
    avg(x) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m2, avg(x) OVER (w ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS m3 FROM s_ship WINDOW w AS (PARTITION BY series_id ORDER BY t)),
  comps AS MATERIALIZED (SELECT series_id, t, 'IMF_1' AS component, 1 AS idx, m0 - m1 AS x FROM av UNION ALL SELECT series_id, t, 'IMF_2', 2, m1 - m2 FROM av
    UNION ALL SELECT series_id, t, 'IMF_3', 3, m2 - m3 FROM av UNION ALL SELECT series_id, t, 'Residuo', 4, m0 - ((m0 - m1) + (m1 - m2) + (m2 - m3)) FROM av)"""


def ship_bands(spark, d):
    return cut(band_split(ship_series(spark, d), 3, dc=0).withColumn("method", F.lit("band")))


@query(
    "pearson_summary",
    f"""WITH {BAND_SQL}, p AS (SELECT a.series_id, a.idx AS i, b.idx AS j, corr(a.x, b.x) AS r FROM comps a JOIN comps b ON a.series_id = b.series_id AND a.t = b.t AND a.idx < b.idx GROUP BY ALL)
      SELECT series_id, round(max(abs(r)), 6) AS max_abs, round(avg(abs(r)), 6) AS mean_abs, round(sqrt(2 * sum(r * r)), 6) AS frobenius, count(*) AS pairs FROM p GROUP BY 1""",
)
def pearson_summary(spark, d):
    return rounded(D.correlation_summary(ship_bands(spark, d)))


RANK_SQL = """rk AS MATERIALIZED (SELECT series_id, idx, t, rank() OVER (PARTITION BY series_id, idx ORDER BY x) + (count(*) OVER (PARTITION BY series_id, idx, x) - 1) / 2.0::DOUBLE AS r FROM comps)"""


@query(
    "spearman_pairs",
    f"""WITH {BAND_SQL}, {RANK_SQL} SELECT a.series_id, a.idx AS i, b.idx AS j, round(corr(a.r, b.r), 6) + 0.0 AS r, count(*) AS n FROM rk a JOIN rk b
      ON a.series_id = b.series_id AND a.t = b.t AND a.idx < b.idx GROUP BY ALL""",
)
def spearman_pairs(spark, d):
    return rounded(D.rank_correlation(ship_bands(spark, d)).drop("ci", "cj"))


@query(
    "correlation_flags",
    f"""WITH {BAND_SQL}, {RANK_SQL}, s AS (SELECT series_id, max(abs(r)) AS s FROM (SELECT a.series_id, corr(a.r, b.r) AS r FROM rk a JOIN rk b
        ON a.series_id = b.series_id AND a.t = b.t AND a.idx < b.idx GROUP BY a.series_id, a.idx, b.idx) GROUP BY 1),
      p AS (SELECT series_id, max(abs(r)) AS p FROM (SELECT a.series_id, corr(a.x, b.x) AS r FROM comps a JOIN comps b
        ON a.series_id = b.series_id AND a.t = b.t AND a.idx < b.idx GROUP BY a.series_id, a.idx, b.idx) GROUP BY 1)
      SELECT series_id, round(p, 6) AS max_pearson, round(s, 6) AS max_spearman, p < 1e-6 AS pearson_ok, s < 0.15 AS spearman_ok FROM p JOIN s USING (series_id)""",
)
def correlation_flags(spark, d):
    return rounded(D.correlation_flags(ship_bands(spark, d)))
