"""Checked queries on decomposition, component quality and reduction, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegraph.core import cut
from tidegraph.operators import aggregates as A
from tidegraph.operators import decompose as DC
from tidegraph.operators import reduce as R
from tidegraph.plans.inputs import SQL_EVENT, SQL_HOUR, SQL_SHIP, SQL_USER, embedding_matrix, event_series, hour_series, ship_series, table, user_series
from tidegraph.plans.queries_series import PEAKS, rounded
from tidegraph.plans.queries_tests import BAND_SQL, ship_bands

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


# ---------------------------------------------------------------- decomposition in SQL
def sift_sql(src: str, max_imf: int, sifts: int, keys: str, tag: str = "") -> tuple[str, str]:
    """(CTEs, name of the result) of envelope sifting, envelopes by ASOF joins to the knots."""
    out, rest, modes = [f"tol{tag} AS MATERIALIZED (SELECT {keys}, stddev_pop(x) * 1e-10 AS tol FROM {src} GROUP BY ALL)"], src, []
    p = f"PARTITION BY {keys} ORDER BY t"
    ks = [k.strip() for k in keys.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in ks)
    for k in range(1, max_imf + 1):
        q = f"{tag}{k}"
        out.append(
            f"""ct{q} AS (SELECT {keys}, count(*) FILTER (x - p > tol AND x - n >= -tol) AS mx, count(*) FILTER (p - x > tol AND n - x >= -tol) AS mn FROM (
              SELECT {keys}, x, lag(x) OVER ({p}) AS p, lead(x) OVER ({p}) AS n, tol FROM {rest} JOIN tol{tag} USING ({keys})) GROUP BY ALL),
            h{q}_0 AS MATERIALIZED (SELECT s.* FROM {rest} s JOIN ct{q} c ON {on('s', 'c')} WHERE mx >= 2 AND mn >= 2)"""
        )
        for j in range(sifts):
            h = f"h{q}_{j}"
            out.append(
                f"""x{q}_{j} AS MATERIALIZED (SELECT {keys}, t, x, CASE WHEN x - p > tol AND x - n >= -tol THEN 1 ELSE -1 END AS side FROM (
                  SELECT {keys}, t, x, lag(x) OVER ({p}) AS p, lead(x) OVER ({p}) AS n, tol FROM {h} JOIN tol{tag} USING ({keys})) WHERE (x - p > tol AND x - n >= -tol) OR (p - x > tol AND n - x >= -tol)),
                e{q}_{j} AS MATERIALIZED (SELECT {', '.join('s.' + a for a in ks)}, s.t, s.x, l.t AS lt, l.x AS lx, r.t AS rt, r.x AS rx, sd.side FROM {h} s CROSS JOIN (VALUES (1), (-1)) sd(side)
                  ASOF LEFT JOIN x{q}_{j} l ON {on('s', 'l')} AND l.side = sd.side AND s.t >= l.t
                  ASOF LEFT JOIN x{q}_{j} r ON {on('s', 'r')} AND r.side = sd.side AND s.t <= r.t),
                v{q}_{j} AS (SELECT {keys}, t, x, side, CASE WHEN lt IS NULL THEN rx WHEN rt IS NULL OR lt = rt THEN lx ELSE lx + (rx - lx) * ((t - lt) / (rt - lt)) END AS env FROM e{q}_{j}),
                h{q}_{j + 1} AS MATERIALIZED (SELECT {keys}, t, any_value(x) - (max(env) FILTER (side = 1) + max(env) FILTER (side = -1)) / 2.0 AS x FROM v{q}_{j} GROUP BY ALL)"""
            )
        modes.append((k, f"h{q}_{sifts}"))
        out.append(
            f"""r{q} AS MATERIALIZED (SELECT {', '.join('s.' + a for a in ks)}, s.t, CASE WHEN m.x IS NULL THEN s.x ELSE s.x - m.x END AS x FROM {rest} s LEFT JOIN h{q}_{sifts} m ON {on('s', 'm')} AND m.t = s.t)"""
        )
        rest = f"r{q}"
    parts = [f"SELECT {keys}, 'IMF_{k}' AS component, {k} AS idx, t, x FROM {m}" for k, m in modes]
    parts.append(f"SELECT {keys}, 'Residuo', {max_imf + 1}, t, x FROM {rest}")
    out.append(f"sifted{tag} AS MATERIALIZED ({' UNION ALL '.join(parts)})")
    return ", ".join(out), f"sifted{tag}"


_SIFT, _ = sift_sql("s_hour", 3, 5, "series_id")


@query("sift", f"WITH {SQL_HOUR}, {_SIFT} SELECT series_id, component, idx, t, round(x, 6) + 0.0 AS x FROM sifted")
def sift(spark, d):
    return rounded(DC.sift(hour_series(spark, d), 3))


def gauss_sql(key: str) -> str:
    u = lambda tag: f"((('0x' || substr(md5('{tag}|' || {key}), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
    return f"(sqrt(-2.0 * ln({u('u')})) * cos(2 * pi() * {u('v')}))"


_ENS, _ = sift_sql("noisy", 2, 3, "series_id, trial", "n")


@query(
    "ensemble_sift",
    f"""WITH {SQL_USER}, sd AS (SELECT series_id, stddev_pop(x) AS sd FROM s_user GROUP BY 1),
      noisy AS MATERIALIZED (SELECT s.series_id, trial, t, x + 0.2 * sd * {gauss_sql("s.series_id || '|' || trial || '|' || t || '|42'")} AS x FROM s_user s JOIN sd USING (series_id), range(4) r(trial)), {_ENS},
      mean AS (SELECT series_id, component, idx, t, sum(x) / 4 AS x FROM siftedn WHERE component <> 'Residuo' GROUP BY ALL),
      res AS (SELECT s.series_id, s.t, any_value(s.x) - coalesce(sum(m.x), 0) AS x FROM s_user s LEFT JOIN mean m ON m.series_id = s.series_id AND m.t = s.t GROUP BY ALL)
      SELECT series_id, component, idx, t, round(x, 5) + 0.0 AS x FROM mean UNION ALL SELECT series_id, 'Residuo', 3, t, round(x, 5) + 0.0 FROM res""",
)
def ensemble_sift(spark, d):
    return rounded(DC.ensemble_sift(user_series(spark, d), 4, 0.2, 42, 2, 3), 5)


@query("adaptive_noise_sift")
def adaptive_noise_sift(spark, d):
    return rounded(DC.adaptive_noise_sift(user_series(spark, d), 4, 0.2, 42, 2, 3))


@query("band_split", f"WITH {BAND_SQL} SELECT series_id, component, idx, t, round(x, 6) + 0.0 AS x FROM comps")
def band_split(spark, d):
    return rounded(DC.band_split(ship_series(spark, d), 3, dc=0))


_AV = """av AS MATERIALIZED (SELECT series_id, t, x, avg(x) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m1, avg(x) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m2,
    avg(x) OVER (w ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS m3, avg(x) OVER (w ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS m4 FROM {src} WINDOW w AS (PARTITION BY series_id ORDER BY t))"""


@query(
    "band_split_trend",
    f"""WITH {SQL_EVENT}, {_AV.format(src='s_event')} SELECT series_id, 'IMF_1' AS component, 1 AS idx, t, round(m2, 6) + 0.0 AS x FROM av UNION ALL SELECT series_id, 'IMF_2', 2, t, round(m1 - m2, 6) + 0.0 FROM av
      UNION ALL SELECT series_id, 'IMF_3', 3, t, round(x - m1, 6) + 0.0 FROM av UNION ALL SELECT series_id, 'Residuo', 4, t, round(x - (m2 + (m1 - m2) + (x - m1)), 6) + 0.0 FROM av""",
)
def band_split_trend(spark, d):
    return rounded(DC.band_split(event_series(spark, d), 3, dc=1))


def quality_sql(comps: str, src: str, keys: str) -> str:
    """Quality per ``keys`` (starting with series_id) as CTE ``qual``."""
    ks = [k.strip() for k in keys.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in ks)
    z = 1.959963985
    crit = f"({z} + ({z}**3 + {z}) / (4 * (n - 2)) + (5 * {z}**5 + 16 * {z}**3 + 3 * {z}) / (96 * (n - 2) * (n - 2)) + (3 * {z}**7 + 19 * {z}**5 + 17 * {z}**3 - 15 * {z}) / (384.0 * (n - 2) * (n - 2) * (n - 2)))"
    return f"""fit AS (SELECT {', '.join('c.' + k for k in ks)}, c.t, sum(c.x) AS s, any_value(o.x) AS o FROM {comps} c JOIN {src} o ON o.series_id = c.series_id AND o.t = c.t GROUP BY ALL),
      err AS (SELECT {keys}, sqrt(sum((s - o) * (s - o))) / (sqrt(sum(o * o)) + 1e-15) AS rel_rmse, var_pop(o) AS v FROM fit GROUP BY ALL),
      vc AS (SELECT {keys}, component, var_pop(x) AS v FROM {comps} GROUP BY ALL),
      en AS (SELECT {keys}, count(*) AS modes, sum(v) AS a, sum(v) FILTER (component = 'Residuo') AS r, sum(v) FILTER (component = 'IMF_1') AS i FROM vc GROUP BY ALL),
      pr AS (SELECT {', '.join('a.' + k for k in ks)}, a.idx AS i, b.idx AS j, corr(a.x, b.x) AS r, count(*)::DOUBLE AS n FROM {comps} a JOIN {comps} b ON {on('a', 'b')} AND a.t = b.t AND a.idx < b.idx AND b.component <> 'Residuo' GROUP BY ALL),
      pc AS (SELECT {keys}, avg(abs(r)) AS pair_corr, count(*) AS n_pairs, avg(CASE WHEN abs(r) * sqrt((n - 2) / (1 - r * r)) > {crit} THEN 1.0::DOUBLE ELSE 0 END) AS sig FROM pr WHERE r IS NOT NULL GROUP BY ALL),
      qual AS (SELECT {', '.join('err.' + k for k in ks)}, modes, rel_rmse, i / (err.v + 1e-15) AS imf1_share, r / (a + 1e-15) AS residual_share, coalesce(pair_corr, 0) AS pair_corr, coalesce(n_pairs, 0) AS n_pairs, sig
        FROM err JOIN en ON {on('err', 'en')} LEFT JOIN pc ON {on('pc', 'err')})"""


_QCOLS = """modes, round(rel_rmse, 6) AS rel_rmse, round(imf1_share, 6) AS imf1_share, round(residual_share, 6) AS residual_share, round(pair_corr, 6) AS pair_corr,
      n_pairs, round(sig, 6) AS significant_share"""


@query("decomposition_quality", f"WITH {BAND_SQL}, {quality_sql('comps', 's_ship', 'series_id')} SELECT series_id, 'band' AS method, {_QCOLS} FROM qual")
def decomposition_quality(spark, d):
    return rounded(A.quality(ship_bands(spark, d), ship_series(spark, d)))


@query(
    "pair_correlation",
    f"WITH {BAND_SQL}, {quality_sql('comps', 's_ship', 'series_id')} SELECT series_id, round(pair_corr, 6) AS pair_corr, n_pairs, round(sig, 6) AS significant_share FROM qual",
)
def pair_correlation(spark, d):
    return rounded(A.pair_correlation(ship_bands(spark, d).where("component <> 'Residuo'")))


@query(
    "component_metrics_table",
    f"""WITH {BAND_SQL}, cs AS (SELECT series_id || '/' || component AS series_id, t, x FROM comps), pk AS ({PEAKS.format(src='cs')}), c AS (SELECT series_id, count(*) AS cycles FROM pk GROUP BY 1)
      SELECT cs.series_id AS part, round(sum(x * x), 3) AS energy, round(var_samp(x), 6) AS variance, round(avg(abs(x)), 6) AS amplitude, any_value(cycles) AS cycles FROM cs JOIN c USING (series_id) GROUP BY 1""",
)
def component_metrics_table(spark, d):
    m = A.component_metrics(ship_bands(spark, d)).withColumn("energy", F.round("energy", 3))
    return rounded(m.withColumn("part", F.concat_ws("/", "series_id", "component")).drop("series_id", "component"))


@query(
    "variance_fraction",
    f"""WITH {BAND_SQL}, v AS (SELECT series_id, var_pop(x) AS v FROM s_ship GROUP BY 1) SELECT c.series_id, component, round(var_pop(x) / any_value(v), 6) AS fraction
      FROM comps c JOIN v USING (series_id) GROUP BY ALL""",
)
def variance_fraction(spark, d):
    return rounded(A.variance_fraction(ship_bands(spark, d), ship_series(spark, d)))


@query(
    "reconstruction_check",
    f"""WITH {BAND_SQL}, f AS (SELECT c.series_id, c.t, sum(c.x) AS s, any_value(o.x) AS x FROM comps c JOIN s_ship o ON o.series_id = c.series_id AND o.t = c.t WHERE idx > 1 GROUP BY ALL)
      SELECT series_id, 'band' AS method, round(sqrt(avg((s - x) * (s - x))), 6) AS rmse, round(sqrt(sum((s - x) * (s - x)) / sum(x * x)), 6) AS rel_rmse,
        round(max(abs(s - x)), 6) AS max_abs, round(avg(abs(s - x)), 6) AS mean_abs FROM f GROUP BY 1""",
)
def reconstruction_check(spark, d):
    return rounded(A.reconstruction(ship_bands(spark, d).where("idx > 1"), ship_series(spark, d)))


def trend_sql(src: str, name: str, tol: str = "1e-10") -> str:
    """Trend metrics of ``src`` (series_id, t, x) as CTE ``name``."""
    return f"""{name}_d AS (SELECT *, x - lag(x) OVER (PARTITION BY series_id ORDER BY t) AS d, rank() OVER (PARTITION BY series_id ORDER BY x) + (count(*) OVER (PARTITION BY series_id, x) - 1) / 2.0::DOUBLE AS rk FROM {src}),
      {name} AS (SELECT series_id, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, max(x) AS max, bool_and(d >= -{tol}) FILTER (d IS NOT NULL) AS rising, bool_and(d <= {tol}) FILTER (d IS NOT NULL) AS falling,
        regr_slope(x, t) AS slope, regr_r2(x, t) AS r2, corr(rk, t::DOUBLE) AS spearman FROM {name}_d GROUP BY 1)"""


@query(
    "residual_trend",
    f"""WITH {BAND_SQL}, res AS (SELECT series_id, t, x FROM comps WHERE component = 'Residuo'), {trend_sql('res', 'tm')},
      g AS (SELECT c.series_id, c.t, max(c.x) FILTER (component = 'Residuo') - (any_value(o.x) - sum(c.x) FILTER (component <> 'Residuo')) AS g FROM comps c JOIN s_ship o ON o.series_id = c.series_id AND o.t = c.t GROUP BY ALL),
      mg AS (SELECT series_id, max(abs(g)) AS g FROM g GROUP BY 1)
      SELECT tm.series_id, 'band' AS method, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, rising, falling, rising OR falling AS monotone,
        round(slope, 6) + 0.0 AS slope, round(r2, 6) AS r2, round(spearman, 6) + 0.0 AS spearman, round(g, 6) AS max_gap FROM tm JOIN mg USING (series_id)""",
)
def residual_trend(spark, d):
    return rounded(A.residual_trend(ship_bands(spark, d), ship_series(spark, d)))


@query(
    "residual_linearity",
    f"""WITH {BAND_SQL}, r AS (SELECT series_id, t, x, x - lag(x) OVER (PARTITION BY series_id ORDER BY t) AS d FROM comps WHERE component = 'Residuo'),
      f AS (SELECT series_id, regr_slope(x, t) AS b, regr_intercept(x, t) AS a, avg(x) AS m FROM r GROUP BY 1),
      s AS (SELECT r.series_id, any_value(b) AS slope, sum((x - a - b * t) * (x - a - b * t)) AS res, sum((x - m) * (x - m)) + 1e-15 AS tot, sum(x * x) AS xx,
        avg(CASE WHEN d > 1e-12 THEN 1.0::DOUBLE WHEN d IS NOT NULL THEN 0 END) AS up, avg(CASE WHEN d < -1e-12 THEN 1.0::DOUBLE WHEN d IS NOT NULL THEN 0 END) AS down FROM r JOIN f USING (series_id) GROUP BY 1)
      SELECT series_id, round(1 - res / tot, 6) AS r2, round(sqrt(res) / (sqrt(xx) + 1e-15), 6) AS line_rmse, round(slope, 6) + 0.0 AS slope, round(up, 6) AS rise_share, round(down, 6) AS fall_share,
        round(greatest(up, down), 6) AS same_sign_share, down < 1e-6 AS rising, up < 1e-6 AS falling FROM s""",
)
def residual_linearity(spark, d):
    return rounded(A.residual_linearity(ship_bands(spark, d).where("component = 'Residuo'").select("series_id", "t", "x")))


@query(
    "composite_trend",
    f"""WITH {BAND_SQL}, tr AS (SELECT series_id, t, sum(x) AS x FROM comps WHERE idx >= 2 GROUP BY ALL), res AS (SELECT series_id, t, x FROM comps WHERE component = 'Residuo'),
      {trend_sql('tr', 'a')}, {trend_sql('res', 'b')}, j AS (SELECT tr.series_id, corr(res.x, tr.x) AS rt, corr(o.x, res.x) AS xr, corr(o.x, tr.x) AS xt FROM tr JOIN res USING (series_id, t) JOIN s_ship o USING (series_id, t) GROUP BY 1)
      SELECT a.series_id, 'band' AS method, round(a.slope, 6) + 0.0 AS slope, round(a.r2, 6) AS r2, round(a.spearman, 6) + 0.0 AS spearman, a.rising OR a.falling AS monotone, round(b.slope, 6) + 0.0 AS res_slope, round(b.r2, 6) AS res_r2,
        round(b.spearman, 6) + 0.0 AS res_spearman, b.rising OR b.falling AS res_monotone, round(rt, 6) AS corr_residual_trend, round(xr, 6) AS corr_x_residual, round(xt, 6) AS corr_x_trend,
        round(a.r2 - b.r2, 6) + 0.0 AS gain_r2, round(xt - xr, 6) + 0.0 AS gain_corr_x FROM a JOIN b USING (series_id) JOIN j USING (series_id)""",
)
def composite_trend(spark, d):
    return rounded(A.composite_report(ship_bands(spark, d), ship_series(spark, d), 2))


# three methods' names on the same band components show the choice of the slow component
SLOW_SQL = """slow AS MATERIALIZED (SELECT c.series_id, c.t, m.method, CASE m.method WHEN 'adaptive' THEN max(c.x) FILTER (component = 'Residuo')
    WHEN 'ensemble' THEN abs(any_value(o.x) - sum(c.x) FILTER (component <> 'Residuo')) ELSE max(c.x) FILTER (component = 'IMF_1') END AS x, any_value(o.x) AS original
    FROM comps c JOIN s_ship o ON o.series_id = c.series_id AND o.t = c.t CROSS JOIN (VALUES ('adaptive'), ('ensemble'), ('band')) m(method) GROUP BY c.series_id, c.t, m.method)"""


def slow_components(spark, d):
    s = cut(ship_series(spark, d))
    names = F.explode(F.array(F.lit("adaptive"), F.lit("ensemble"), F.lit("band")))
    comps = ship_bands(spark, d).drop("method").withColumn("method", names)
    return A.trend_component(comps, s)


@query("trend_component", f"WITH {BAND_SQL}, {SLOW_SQL} SELECT series_id, method, t, round(x, 6) + 0.0 AS x, round(original, 6) AS original FROM slow")
def trend_component(spark, d):
    return rounded(slow_components(spark, d))


@query(
    "trend_purity",
    f"""WITH {BAND_SQL}, {SLOW_SQL}, f AS (SELECT series_id || '/' || method AS series_id, t, x, original FROM slow), {trend_sql('f', 'tm')},
      e AS (SELECT *, x - lag(x) OVER w AS d, x - 2 * lag(x) OVER w + lag(x, 2) OVER w AS d2 FROM f WINDOW w AS (PARTITION BY series_id ORDER BY t)),
      g AS (SELECT series_id, avg(CASE WHEN d > 1e-12 THEN 1.0::DOUBLE WHEN d IS NOT NULL THEN 0 END) AS up, avg(CASE WHEN d < -1e-12 THEN 1.0::DOUBLE WHEN d IS NOT NULL THEN 0 END) AS down,
        stddev_pop(d2) / stddev_pop(x) AS rough, corr(x, original) AS c FROM e GROUP BY 1)
      SELECT series_id AS part, round(up, 6) AS rise_share, round(down, 6) AS fall_share, round(rough, 6) AS roughness, round(c, 6) + 0.0 AS corr_original, round(slope, 6) + 0.0 AS slope, round(r2, 6) AS r2,
        round(spearman, 6) + 0.0 AS spearman, round(greatest(up, down), 6) AS same_sign_share FROM g JOIN tm USING (series_id)""",
)
def trend_purity(spark, d):
    p = A.trend_purity(cut(slow_components(spark, d)))
    return rounded(p.withColumn("part", F.concat_ws("/", "series_id", "method")).drop("series_id", "method"))


GAP_SQL = """gap AS MATERIALIZED (SELECT c.series_id, c.t, any_value(o.x) AS original, max(c.x) FILTER (idx = 1) AS first_mode, sum(c.x) AS mode_sum, sum(c.x) FILTER (idx > 1) AS osc,
    abs(any_value(o.x) - sum(c.x)) AS gap, abs(any_value(o.x) - sum(c.x) FILTER (idx > 1)) AS trend_gap FROM comps c JOIN s_ship o ON o.series_id = c.series_id AND o.t = c.t WHERE component <> 'Residuo' GROUP BY ALL)"""


@query(
    "mode_gaps",
    f"""WITH {BAND_SQL}, {GAP_SQL} SELECT series_id, 'band' AS method, t, round(original, 6) AS original, round(first_mode, 6) + 0.0 AS first_mode, round(mode_sum, 6) + 0.0 AS mode_sum,
      round(osc, 6) + 0.0 AS oscillating_sum, round(gap, 6) AS gap, round(trend_gap, 6) AS trend_gap FROM gap""",
)
def mode_gaps(spark, d):
    return rounded(A.mode_gaps(ship_bands(spark, d), ship_series(spark, d)))


@query(
    "gap_summary",
    f"""WITH {BAND_SQL}, {GAP_SQL} SELECT series_id, 'band' AS method, round(avg(gap), 6) AS gap_mean, round(max(gap), 6) AS gap_max, round(avg(trend_gap), 6) AS trend_gap_mean,
      round(stddev_pop(trend_gap), 6) AS trend_gap_std, round(corr(trend_gap, first_mode), 6) AS trend_gap_corr FROM gap GROUP BY 1""",
)
def gap_summary(spark, d):
    return rounded(A.gap_summary(A.mode_gaps(ship_bands(spark, d), ship_series(spark, d))))


BAND_GRID = [{"k": 2, "dc": 0}, {"k": 3, "dc": 0}, {"k": 3, "dc": 1}, {"k": 4, "dc": 1}]


def _grid_sql() -> str:
    parts = []
    m = ["x", "m1", "m2", "m3", "m4"]
    for i, g in enumerate(BAND_GRID):
        bands = g["k"] - g["dc"]
        band = [f"{m[j]} - {m[j + 1]}" for j in range(bands)]
        modes = [m[bands], *reversed(band)] if g["dc"] else band
        total = " + ".join(f"({e})" for e in modes)
        for j, e in enumerate(modes):
            parts.append(f"SELECT series_id, {i} AS point, 'IMF_{j + 1}' AS component, {j + 1} AS idx, t, {e} AS x FROM av")
        parts.append(f"SELECT series_id, {i}, 'Residuo', {g['k'] + 1}, t, x - ({total}) FROM av")
    return f"{_AV.format(src='s_ship')}, grid AS MATERIALIZED ({' UNION ALL '.join(parts)})"


_GQ = f"{SQL_SHIP}, {_grid_sql()}, {quality_sql('grid', 's_ship', 'series_id, point')}"


@query(
    "calibrate_decomposition",
    f"""WITH {_GQ} SELECT series_id, point, {_QCOLS} FROM qual WHERE rel_rmse < 1e-10 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(pair_corr, 9), round(residual_share, 9), point) = 1""",
)
def calibrate_decomposition(spark, d):
    return rounded(DC.calibrate(cut(ship_series(spark, d)), "band", BAND_GRID).drop("params"))


_LIN = """lin AS (SELECT series_id, point, 1 - sum(e * e) / (sum((x - m) * (x - m)) + 1e-15) AS r2, sqrt(sum(e * e)) / (sqrt(sum(x * x)) + 1e-15) AS line_rmse, any_value(b) AS slope,
    avg(CASE WHEN d > 1e-12 THEN 1.0::DOUBLE WHEN d IS NOT NULL THEN 0 END) AS up, avg(CASE WHEN d < -1e-12 THEN 1.0::DOUBLE WHEN d IS NOT NULL THEN 0 END) AS down FROM (
    SELECT g.*, b, m, x - a - b * t AS e, x - lag(x) OVER (PARTITION BY g.series_id, g.point ORDER BY t) AS d FROM grid g JOIN (SELECT series_id, point, regr_slope(x, t) AS b, regr_intercept(x, t) AS a, avg(x) AS m FROM grid
      WHERE component = 'Residuo' GROUP BY ALL) f USING (series_id, point) WHERE component = 'Residuo') GROUP BY ALL),
  al AS (SELECT qual.*, r2, line_rmse, slope, up, down, down < 1e-6 AS rising FROM qual JOIN lin USING (series_id, point))"""


@query(
    "calibrate_linear_residual",
    f"""WITH {_GQ}, {_LIN}, ch AS (SELECT 'linear_residual' AS choice, * FROM (SELECT * FROM al WHERE rel_rmse < 1e-10) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY (NOT rising)::INT, (slope <= 0)::INT, -modes, -round(r2, 9),
        -round(up, 9), round(line_rmse, 9), round(rel_rmse, 9), round(pair_corr, 9), point) = 1
      UNION ALL SELECT 'separation', * FROM (SELECT * FROM al WHERE rel_rmse < 1e-10) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(pair_corr, 9), round(residual_share, 9), point) = 1
      UNION ALL SELECT 'reference', * FROM al WHERE point = 0)
      SELECT series_id, choice, point, modes - 1 AS n_imfs, round(pair_corr, 6) AS pair_corr, round(r2, 6) AS r2, round(up, 6) AS rise_share, rising FROM ch""",
)
def calibrate_linear_residual(spark, d):
    c = DC.calibrate_linear_residual(cut(ship_series(spark, d)), "band", BAND_GRID)
    return rounded(c.select("series_id", "choice", "point", "n_imfs", "pair_corr", "r2", "rise_share", "rising"))


@query("compare_methods")
def compare_methods(spark, d):
    noisy = {"trials": 4, "max_imf": 2, "sifts": 3}
    methods = {"band": {"k": 3, "dc": 0}, "sift": {"max_imf": 2}, "ensemble": noisy, "adaptive": noisy}
    return rounded(DC.compare_methods(cut(hour_series(spark, d)), methods)[0])


@query(
    "compare_methods_wide",
    f"""WITH {SQL_HOUR}, {sift_sql('s_hour', 2, 5, 'series_id')[0]}, {_AV.format(src='s_hour')},
      comps AS MATERIALIZED (SELECT series_id, 'sift' AS method, component, idx, t, x FROM sifted UNION ALL SELECT series_id, 'band', 'IMF_1', 1, t, x - m1 FROM av UNION ALL SELECT series_id, 'band', 'IMF_2', 2, t, m1 - m2 FROM av
        UNION ALL SELECT series_id, 'band', 'IMF_3', 3, t, m2 - m3 FROM av UNION ALL SELECT series_id, 'band', 'Residuo', 4, t, x - ((x - m1) + (m1 - m2) + (m2 - m3)) FROM av), {quality_sql('comps', 's_hour', 'series_id, method')}
      SELECT series_id, round(max(rel_rmse) FILTER (method = 'band'), 6) AS band_rel_rmse, round(max(pair_corr) FILTER (method = 'band'), 6) AS band_pair_corr, round(max(residual_share) FILTER (method = 'band'), 6) AS band_residual_share,
        round(max(rel_rmse) FILTER (method = 'sift'), 6) AS sift_rel_rmse, round(max(pair_corr) FILTER (method = 'sift'), 6) AS sift_pair_corr, round(max(residual_share) FILTER (method = 'sift'), 6) AS sift_residual_share FROM qual GROUP BY 1""",
)
def compare_methods_wide(spark, d):
    return rounded(DC.compare_methods(cut(hour_series(spark, d)), {"band": {"k": 3, "dc": 0}, "sift": {"max_imf": 2}})[1])


# ---------------------------------------------------------------- reduction
EMB_SQL = """m AS MATERIALIZED (SELECT vec_id AS t, j, embedding[j]::DOUBLE AS x FROM embeddings, range(1, 65) r(j))"""
P = 64


@query(
    "standardise",
    f"""WITH {EMB_SQL}, s AS (SELECT j, avg(x) AS mu, stddev_pop(x) AS sd FROM m GROUP BY 1) SELECT t, CAST(j AS INTEGER) AS idx, round((x - mu) / sd, 6) + 0.0 AS x FROM m JOIN s USING (j)""",
)
def standardise(spark, d):
    z = R.as_components(R.standardise(embedding_matrix(spark, d), P))
    return rounded(z.select("t", "idx", "x"))


@query("pca_scores")
def pca_scores(spark, d):
    m = embedding_matrix(spark, d)
    model = R.pca_model(m, P, 3)
    return rounded(R.as_components(R.transform(m, model, P, 3)).select("t", "idx", "x"))


@query("pca_explained")
def pca_explained(spark, d):
    return rounded(R.explained(R.pca_model(embedding_matrix(spark, d), P)))


@query("pca_full_reconstruction", f"WITH {EMB_SQL} SELECT t, CAST(j AS INTEGER) AS idx, round(x, 6) + 0.0 AS x FROM m")
def pca_full_reconstruction(spark, d):
    """With k = p the inverse map gives the input back."""
    m = embedding_matrix(spark, d)
    model = R.pca_model(m, P, P)
    back = R.inverse(R.transform(m, model, P, P), model, P, P)
    return rounded(R.as_components(back).select("t", "idx", "x"))


@query(
    "reconstruction_metrics",
    f"""WITH {EMB_SQL}, c AS (SELECT j, sum((0.1 * x) * (0.1 * x)) AS res, var_pop(x) * count(*) AS tot, count(*) AS n, sum(x * x) AS ss FROM m GROUP BY 1)
      SELECT 'vectors' AS series_id, round(sqrt(sum(res) / sum(n)), 6) AS rmse, round(sqrt(sum(res)) / sqrt(sum(ss)), 6) AS frobenius, round(avg(1 - res / tot), 6) AS r2_mean FROM c""",
)
def reconstruction_metrics(spark, d):
    m = embedding_matrix(spark, d)
    hat = m.withColumn("vec", F.transform("vec", lambda v: v * 0.9))
    return rounded(R.reconstruction_metrics(R.reconstruction_by_column(m, hat, P)))


@query(
    "reconstruction_by_column",
    f"""WITH {EMB_SQL} SELECT 'vectors' AS series_id, CAST(j AS INTEGER) AS "column", round(1 - sum((0.1 * x) * (0.1 * x)) / (var_pop(x) * count(*)), 6) AS r2, round(sqrt(avg((0.1 * x) * (0.1 * x))), 6) AS rmse FROM m GROUP BY j""",
)
def reconstruction_by_column(spark, d):
    m = embedding_matrix(spark, d)
    hat = m.withColumn("vec", F.transform("vec", lambda v: v * 0.9))
    return rounded(R.reconstruction_by_column(m, hat, P).drop("ss_res", "ss", "n"))


@query("ica_sources")
def ica_sources(spark, d):
    m = embedding_matrix(spark, d)
    model = R.ica_model(m, P, 3, max_rounds=20)
    return rounded(R.as_components(R.transform(m, model, P, 3)).select("t", "idx", "x"))


@query("ica_grid")
def ica_grid(spark, d):
    first = embedding_matrix(spark, d).withColumn("vec", F.slice("vec", 1, 5))
    return rounded(R.ica_grid(first, 5, max_rounds=10))


@query("reduction_report")
def reduction_report(spark, d):
    m = embedding_matrix(spark, d)
    model = R.ica_model(m, P, 3, max_rounds=20)
    return rounded(R.reduction_report(R.as_components(m), R.as_components(cut(R.transform(m, model, P, 3)))))


# a grid per return flag over line numbers: cumulative shares stand in for quality, taxes for correlation
GRID_SQL = """g0 AS (SELECT l_returnflag AS series_id, l_linenumber + 1 AS k, count(*)::DOUBLE AS c, avg(l_tax) / 4 AS max_corr FROM lineitem GROUP BY ALL),
  g AS MATERIALIZED (SELECT series_id, k, round(sum(c) OVER (PARTITION BY series_id ORDER BY k) / sum(c) OVER (PARTITION BY series_id), 9) AS r2_mean,
    round(1 - 0.9 * sum(c) OVER (PARTITION BY series_id ORDER BY k) / sum(c) OVER (PARTITION BY series_id), 9) AS frobenius, round(max_corr, 9) AS max_corr FROM g0)"""
KNEE_SQL = """{n} AS (SELECT series_id, k AS knee FROM (SELECT v.series_id, k, round(abs((y - y0) / (y1 - y0 + 1e-12) - (k - k0) / (k1 - k0 + 1e-12)) / sqrt(2.0), 12) AS gap FROM {src} v JOIN (
    SELECT series_id, min(k) AS k0, max(k) AS k1, arg_min(y, k) AS y0, arg_max(y, k) AS y1 FROM {src} GROUP BY 1) e ON e.series_id = v.series_id) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY gap DESC, k) = 1)"""


def line_grid(spark, d):
    from pyspark.sql import Window

    g = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("series_id"), (F.col("l_linenumber") + 1).alias("k")).agg(
        F.count(F.lit(1)).cast("double").alias("c"), (F.avg("l_tax") / 4).alias("mc")
    )
    w = Window.partitionBy("series_id")
    share = F.sum("c").over(w.orderBy("k")) / F.sum("c").over(w)
    return cut(
        g.select("series_id", "k", F.round(share, 9).alias("r2_mean"), F.round(1 - 0.9 * share, 9).alias("frobenius"), F.round("mc", 9).alias("max_corr"))
    )


@query("knee", f"WITH {GRID_SQL}, v AS (SELECT series_id, k, r2_mean AS y FROM g), {KNEE_SQL.format(n='kn', src='v')} SELECT * FROM kn")
def knee(spark, d):
    return R.knee(line_grid(spark, d).withColumn("y", F.col("r2_mean")))


@query(
    "choose_k",
    f"""WITH {GRID_SQL}, rk AS (SELECT *, count(*) FILTER (max_corr < 0.01) OVER (PARTITION BY series_id) AS ok, greatest(count(*) OVER (PARTITION BY series_id) // 2, 1) AS half,
        row_number() OVER (PARTITION BY series_id ORDER BY max_corr, k) AS r FROM g),
      via AS MATERIALIZED (SELECT series_id, k, r2_mean, frobenius, max_corr, r2_mean AS y FROM rk WHERE CASE WHEN ok > 0 THEN max_corr < 0.01 ELSE r <= half END), {KNEE_SQL.format(n='kn', src='via')},
      tp AS (SELECT series_id, max(r2_mean) AS r2_max, max(frobenius) AS err_max FROM via GROUP BY 1), rf AS (SELECT v.series_id, knee, frobenius AS err_ref FROM via v JOIN kn USING (series_id) WHERE k = knee),
      pk AS (SELECT v.series_id, coalesce(min(k) FILTER (r2_mean >= 0.72 * r2_max AND frobenius <= 1.15 * err_ref), any_value(knee)) AS k, any_value(knee) AS knee, any_value(err_ref) AS err_ref, any_value(r2_max) AS r2_max, any_value(err_max) AS err_max
        FROM via v JOIN tp ON tp.series_id = v.series_id JOIN rf ON rf.series_id = v.series_id GROUP BY 1)
      SELECT pk.series_id, pk.k, knee, round(err_ref, 6) AS err_ref, round(r2_max, 6) AS r2_max, round(r2_mean, 6) AS r2_mean, round(frobenius, 6) AS frobenius, round(max_corr, 6) AS max_corr,
        round(0.45 * r2_mean / r2_max + 0.25 * (1 - frobenius / err_max) + 0.20 * CASE WHEN max_corr < 0.01 THEN 1.0 ELSE greatest(0, 1 - max_corr / 0.01) END + 0.10 * (1 - pk.k / 9.0::DOUBLE), 6) AS score
      FROM pk JOIN g ON g.series_id = pk.series_id AND g.k = pk.k""",
)
def choose_k(spark, d):
    return rounded(R.choose_k(line_grid(spark, d), 9))


@query(
    "choose_k_by_reference",
    f"""WITH {GRID_SQL}, r AS (SELECT series_id, min(k) FILTER (k = 4 AND max_corr < 0.0101) AS a, min(k) FILTER (r2_mean >= 0.9 * mx) AS b FROM (SELECT *, max(r2_mean) OVER (PARTITION BY series_id) AS mx FROM g) GROUP BY 1)
      SELECT series_id, coalesce(a, b) AS k, a IS NOT NULL AS is_reference FROM r""",
)
def choose_k_by_reference(spark, d):
    return R.choose_k_by_reference(line_grid(spark, d), 4, 9, limit=0.0101)
