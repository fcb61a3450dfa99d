import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import F1
from tidegraph.functions import signals
from tidegraph.functions.closed import adf_p, chi2_even_tail, t_critical
from tidegraph.operators import aggregates as A
from tidegraph.operators import decompose as DC
from tidegraph.operators import dependence as D
from tidegraph.operators import reduce as R
from tidegraph.operators import shape as S
from tidegraph.operators import windows as W
from tidegraph.operators.text import strip_latex
from tidegraph.plans import registry
from tidegraph.sources import readers, writers


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_closed_forms(spark):
    r = one(spark, adf_p(F.lit(-0.0783)), chi2_even_tail(F.lit(18.307), 10), t_critical(F.lit(10.0)))
    assert r[0] == pytest.approx(0.9516, abs=5e-5)
    assert r[1] == pytest.approx(0.05, abs=1e-5)
    assert r[2] == pytest.approx(2.228, abs=1e-3)
    with pytest.raises(ValueError):
        chi2_even_tail(F.lit(1.0), 3)


def test_signal_checks(spark):
    for call in (
        lambda: signals.chirp(F.lit(0.0), -1, 1), lambda: signals.chirp(F.lit(0.0), 1, 1, kind="tan"),
        lambda: signals.close_tones(F.lit(0.0), 0, 1), lambda: signals.burst_on_carrier(F.lit(0.0), 1, 2, 1, 3, 2),
        lambda: signals.burst_on_carrier(F.lit(0.0), 1, 2, -1, 1, 2),
    ):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(Exception, match="negative"):
        one(spark, signals.chirp(F.lit(5.0), 1, -1))


def test_f1_moments_and_trend(make):
    df = make(a=F1)
    m = A.moments(df).first()
    assert (m.skew, m.kurtosis, m.jb, m.jb_p) == pytest.approx((0.479922, -0.5645, 0.489127, 0.783046), abs=1e-6)
    t = A.trend_metrics(df).first()
    assert (t["mean"], t["std"], t.slope, t.r2, t.spearman) == pytest.approx((2.625, 1.407886, 0.22619, 0.154869, 0.33945), abs=1e-6)
    p = A.trend_purity(df.withColumn("method", F.lit("m")).withColumn("original", F.col("x"))).first()
    assert p.roughness == pytest.approx(2.787072, abs=1e-6)
    assert {r.t for r in W.local_maxima(df).collect()} == {3, 5}


def test_embedding_scale_split_knee(spark, make):
    e = {r.t: list(r.vec) for r in W.delay_embedding(make(a=range(10)), 2, 3).collect()}
    assert len(e) == 6 and e[0] == [0, 2, 4]
    with pytest.raises(ValueError):
        W.delay_embedding(make(a=range(10)), 2, 6, rows=10)
    y = [one(spark, S.scale(F.lit(float(v)), -500, 500), S.unscale(S.scale(F.lit(float(v)), -500, 500), -500, 500)) for v in (-600, 0, 600)]
    assert [tuple(r) for r in y] == [(0, -500), (0.5, 0), (1, 500)]
    days = spark.createDataFrame([(dt.datetime(2024, 1, i),) for i in (1, 2, 3, 4)], "ts timestamp_ntz")
    a, b = S.split_by_date(days, dt.datetime(2024, 1, 3))
    assert (a.count(), b.count()) == (2, 2)
    curve = spark.createDataFrame([("a", k, y) for k, y in zip(range(2, 7), (0.1, 0.7, 0.8, 0.85, 0.9))], "series_id string, k int, y double")
    assert R.knee(curve).first().knee == 3


def test_constant_series(make):
    df = make(c=[1.0] * 30)
    assert all(abs(r.mi) < 1e-12 for r in D.mutual_information(df, 5).collect())
    assert D.choose_tau(D.mutual_information(df, 5)).first().tau == 2


@pytest.mark.parametrize("method,params", [
    ("sift", {"max_imf": 4}), ("ensemble", {"trials": 3, "max_imf": 2}), ("adaptive", {"trials": 3, "max_imf": 2}),
    ("band", {"k": 4, "dc": 0}), ("band", {"k": 4, "dc": 1}),
])
def test_components_add_up(spark, make, method, params):
    t = np.arange(400) / 100
    df = make(a=np.sin(2 * np.pi * 10 * t) + np.sin(2 * np.pi * 2 * t) + t, b=t)
    c = DC.decompose(df, method, params)
    gap = c.groupBy("series_id", "t").agg(F.sum("x").alias("s")).join(df, ["series_id", "t"]).agg(F.max(F.abs(F.col("s") - F.col("x"))), F.count(F.lit(1))).first()
    assert gap[0] < 1e-9 and gap[1] == 800


def test_sift_separates_tones_and_small_blocks_agree(make):
    t = np.arange(500) / 250
    df = make(a=np.sin(2 * np.pi * 12 * t) + np.sin(2 * np.pi * 0.8 * t))
    whole = {(r.component, r.t): r.x for r in DC.sift(df, 2).collect()}
    first = [whole["IMF_1", i] for i in range(500)]
    assert np.corrcoef(first[50:450], np.sin(2 * np.pi * 12 * t)[50:450])[0, 1] > 0.99
    split = {(r.component, r.t): r.x for r in DC.sift(df, 2, block=64).collect()}
    assert whole.keys() == split.keys() and max(abs(whole[k] - split[k]) for k in whole) < 1e-9


def test_adf_equals_direct_regression(make):
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.standard_normal(300))
    got = D.adf(make(a=x), max_lag=3).first()
    best = None
    for k in range(4):
        d = np.diff(x)
        rows = range(3, len(d))
        z = np.array([[x[i], 1.0, *[d[i - j] for j in range(1, k + 1)]] for i in rows])
        y = d[3:]
        beta, rss = np.linalg.lstsq(z, y, rcond=None)[:2]
        aic = len(y) * (math.log(2 * math.pi * rss[0] / len(y)) + 1) + 2 * z.shape[1]
        if best is None or aic < best[0] - 1e-9:
            best = (aic, k)
    k = best[1]
    rows = range(k, len(x) - 1)
    d = np.diff(x)
    z = np.array([[x[i], 1.0, *[d[i - j] for j in range(1, k + 1)]] for i in rows])
    y = d[k:]
    beta, rss = np.linalg.lstsq(z, y, rcond=None)[:2]
    se = math.sqrt(rss[0] / (len(y) - z.shape[1]) * np.linalg.inv(z.T @ z)[0, 0])
    assert got.lag == k and got.adf == pytest.approx(beta[0] / se, abs=1e-6)


def test_pca_and_ica(spark):
    rng = np.random.default_rng(1)
    s = np.c_[np.sign(np.sin(np.arange(800) / 7)), rng.uniform(-1, 1, 800), np.sin(np.arange(800) / 31)]
    x = s @ rng.standard_normal((3, 4))
    m = spark.createDataFrame([("a", i, [float(v) for v in r]) for i, r in enumerate(x)], "series_id string, t long, vec array<double>")
    model = R.pca_model(m, 4, 4)
    z = (x - x.mean(0)) / x.std(0)
    vals = np.sort(np.linalg.eigvalsh(np.cov(z.T, bias=True)))[::-1]
    assert np.allclose([r.ratio for r in R.explained(model).orderBy("idx").collect()], vals / vals.sum())
    ica = R.ica_model(m, 4, 3)
    assert ica.first().converged
    src = np.array([r.vec for r in R.transform(m, ica, 4, 3).orderBy("t").collect()])
    c = np.abs(np.corrcoef(src.T, s.T)[:3, 3:])
    assert (c.max(axis=0) > 0.95).all()
    assert D.correlation_summary(R.as_components(R.transform(m, ica, 4, 3))).first().max_abs < 0.01
    back = np.array([r.vec for r in R.inverse(R.transform(m, ica, 4, 3), ica, 4, 3).orderBy("t").collect()])
    assert np.allclose(back, x, atol=1e-6)


def test_latex(spark):
    text = "\\documentclass{x}\n\\begin{document}\n\\section{One}\n\\textbf{bold} text~\\ref{a}\n\n\n\n\\begin{itemize}\n\\item first\n\\end{itemize}\n\\end{document} lost"
    assert one(spark, strip_latex(F.lit(text)))[0].split("\n") == ["One", "bold text~", "- first"]


def test_sources_and_sinks(spark, tmp_path, graph):
    (tmp_path / "oil.csv").write_text("DATE,value\n2024-01-01,1.5\n2024-01-02,.\n")
    r = readers.read_csv_series(spark, str(tmp_path / "oil.csv")).orderBy("ts").collect()
    assert [v.x for v in r] == [1.5, None] and r[0].ts == dt.datetime(2024, 1, 1)
    for g, head, row in (("hvg", "num_nodes,num_edges", "8,12"), ("recurrencia", "num_nodes,tau", "6,2")):
        p = tmp_path / "grafos" / g / "imf_1"
        p.mkdir(parents=True)
        (p / f"grafo_{g}_imf_1_metadata.csv").write_text(f"{head}\n{row}\n")
    c = readers.collect_table(spark, str(tmp_path / "grafos"), ("hvg", "recurrencia"))
    assert c.columns[:2] == ["component", "graph"]
    assert {(v.graph, v.component, v.num_nodes, v.num_edges, v.tau) for v in c.collect()} == {("hvg", "imf_1", 8, 12, None), ("recurrencia", "imf_1", 6, None, 2)}
    nodes, edges = graph(a=(3, [(0, 1), (1, 2)]))
    nodes, edges = nodes.withColumn("graph", F.lit("hvg")), edges.withColumn("graph", F.lit("hvg"))
    out = str(tmp_path / "out")
    writers.write_graph(nodes, edges, nodes.groupBy("graph").count(), out)
    assert readers.read_edges(spark, out + "/edges", "src", "dst").count() == 2
    writers.write_table(edges.limit(1), out + "/edges", force=False)
    assert spark.read.parquet(out + "/edges").count() == 2
    writers.write_report(nodes, out + "/report")
    assert spark.read.json(out + "/report").count() == 3
    with pytest.raises(ValueError):
        readers.load_series(nodes, "ts", "value")


def test_registry():
    assert {"hvg", "nvg", "recurrence"} <= set(registry.names())
    with pytest.raises(ValueError):
        registry.build("none", None)
    with pytest.raises(ValueError):
        registry.register("hvg", lambda s: s)


def test_queries_have_sql_keys():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_series_that_are_constant_zero_short_or_null(spark):
    rows = [("zero", t, 0.0) for t in range(30)] + [("same", t, 2.0) for t in range(30)] + [("two", 0, 1.0), ("two", 1, 0.0)]
    rows += [("null", t, None if t % 3 == 0 else float(t)) for t in range(30)] + [("fine", t, float((t * 7) % 5 + 1)) for t in range(30)]
    df = spark.createDataFrame(rows, "series_id string, t long, x double")
    from tidegraph.operators import aggregates, dependence, text, windows

    ret = {(r["series_id"], r["t"]): r["ret"] for r in windows.change_columns(df).collect()}
    assert ret["zero", 3] is None and ret["two", 1] == -100.0 and ret["same", 3] == 0.0
    full = df.where("x IS NOT NULL AND series_id IN ('zero', 'same', 'fine')")
    rho = dependence.autocorrelation(full, 3).collect()
    assert {r["series_id"] for r in rho if r["rho"] is None} == {"zero", "same"}
    stat = {r["series_id"]: r["kpss"] for r in dependence.kpss(full).collect()}
    assert stat["zero"] is None and stat["fine"] is not None
    comps = full.selectExpr("series_id", "'IMF_1' AS component", "t", "x", "'m' AS method", "1 AS idx")
    shares = {r["series_id"]: r["fraction"] for r in aggregates.variance_fraction(comps, full).collect()}
    assert shares["same"] is None and shares["fine"] == 1.0
    assert {r["series_id"]: r["rel_rmse"] for r in aggregates.reconstruction(comps, full).collect()}["zero"] is None
    doc = spark.createDataFrame([("p\\begin{document}one\\begin{document}two \\end{document}x",)], "s string")
    assert doc.select(text.strip_latex(doc["s"])).first()[0] == "two"
    summary = {r["series_id"]: r for r in aggregates.price_summary(full.withColumn("ts", F.timestamp_seconds("t")), 5).collect()}
    assert summary["zero"].total_return is None and summary["fine"].total_return is not None and len(summary) == len({*summary})


def test_latex_marks_that_stay_open(spark):
    """Each environment against the plain pattern, and many open marks in linear time."""
    import re
    import time

    from tidegraph.operators import text

    marks = ["\\begin{table}", "\\end{table}", "\\begin{tabular}", "\\end{tabular}", "\\begin{thebibliography}", "\\end{thebibliography}", "a", " b", "\n"]
    rng = np.random.default_rng(3)
    rows = [("".join(rng.choice(marks, 12)),) for _ in range(200)]
    for name in text.ENVIRONMENTS:
        got = [r[0] for r in spark.createDataFrame(rows, "s string").coalesce(1).select(text._without(F.col("s"), name)).collect()]
        assert got == [re.sub(rf"(?s)\\begin\{{{name}\}}.*?\\end\{{{name}\}}", "", r[0]) for r in rows]
    begin = time.time()
    open_marks = spark.createDataFrame([("\\begin{table} x " * 50_000,), ("word " * 400_000,), ("\\end{table}" * 50_000,)], "s string")
    assert [len(r[0]) > 0 for r in open_marks.select(text.strip_latex(F.col("s"))).collect()] == [True, True, False]
    assert time.time() - begin < 60


def test_grids_in_one_run_equal_single_runs(make):
    """Points of a grid with different numbers of modes, passes, trials and widths, each as if it ran alone."""
    from tidegraph.operators import decompose as DC

    t = np.arange(240)
    s = make(a=np.sin(t / 3) + np.sin(t / 17) + t / 100, b=np.cos(t / 5) * (1 + t / 60), flat=np.ones(240))
    grids = {
        "band": [{"k": 2, "dc": 0}, {"k": 4, "dc": 1}, {"k": 3}], "sift": [{"max_imf": 1, "sifts": 2}, {"max_imf": 3, "sifts": 1}, {"max_imf": 2}],
        "ensemble": [{"trials": 2, "max_imf": 2, "sifts": 2}, {"trials": 3, "noise_width": 0.2, "max_imf": 1, "sifts": 1, "seed": 7}],
    }
    for method, grid in grids.items():
        _, comps = DC.evaluate_grid(s, method, grid)
        got = {(r.series_id, r.point, r.component, r.idx, r.t): r.x for r in comps.collect()}
        want = {}
        for i, g in enumerate(grid):
            want |= {(r.series_id, i, r.component, r.idx, r.t): r.x for r in DC.decompose(s, method, g).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got), method
