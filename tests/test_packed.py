"""Small graphs solved whole in a task against plain searches and against the spread way."""

import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_distances import plain_betweenness, search, shapes

from tidegraph.operators import graphs as G
from tidegraph.operators import metrics as M
from tidegraph.operators import packed as P
from tidegraph.operators import text


def jobs_of(spark, group, fn):
    spark.sparkContext.setJobGroup(group, group)
    out = fn()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("rest", "others")
    return out, jobs


def test_labels_in_few_jobs(spark, graph):
    """Two shuffles, whatever the diameter; some graphs above the limit take the spread way."""
    n, e = graph(**shapes())
    got, jobs = jobs_of(spark, "labels", lambda: M.component_labels(n, e).collect())
    assert jobs <= 12, jobs
    mixed = M.component_labels(n, e, limit=30).collect()
    want = {(k, s): min(search(size, edges, s)) for k, (size, edges) in shapes().items() for s in range(size)}
    assert {(r.series_id, r.node): r.label for r in got} == want == {(r.series_id, r.node): r.label for r in mixed}
    assert len(got) == len(want) == len(mixed)


def test_distances_in_few_jobs(spark, graph):
    n, e = graph(**shapes())
    found, jobs = jobs_of(spark, "distances", lambda: M.closeness(n, e).collect())
    assert jobs <= 16, jobs
    d = P.KeyedDistances(n, e, keys=("series_id",))
    assert d.large is None
    sums = {(r.series_id, r.node): (r.reached, r.total, r.far) for r in d.sums().collect()}
    counts, pairs = {}, {}
    for r in d.counts().collect():
        counts.setdefault((r.series_id, r.source), {})[r.d] = r.cnt
    for r in d.pairs().collect():
        pairs.setdefault((r.series_id, r.source), {})[r.node] = r.d
    for k, (size, edges) in shapes().items():
        for s in range(size):
            want = search(size, edges, s)
            some = [x for x in want.values() if x]
            assert pairs[k, s] == want and sums[k, s] == (len(some), sum(some), max(some, default=0))
            assert counts.get((k, s), {}) == {x: some.count(x) for x in set(some)}
    assert len(found) == len(sums)


def test_listed_sources_and_mixed_sizes(graph):
    n, e = graph(**shapes())
    some = n.where("node % 23 = 1")
    d = P.KeyedDistances(n, e, some, keys=("series_id",), limit=30)
    assert d.large is not None and d.packed is not None
    got = {(r.series_id, r.source, r.node): r.d for r in d.pairs().collect()}
    assert got == {(k, s, v): x for k, (size, edges) in shapes().items() for s in range(1, size, 23) for v, x in search(size, edges, s).items()}


def test_small_betweenness_equals_plain(spark, graph):
    n, e = graph(**shapes())
    rows, jobs = jobs_of(spark, "between", lambda: M.betweenness(n, e).collect())
    assert jobs <= 14, jobs
    got = {(r.series_id, r.node): r.betweenness for r in rows}
    for k, (size, edges) in shapes().items():
        assert [got[k, i] for i in range(size)] == pytest.approx(plain_betweenness(size, edges), abs=1e-12), k


def test_spread_betweenness_equals_plain(graph):
    some = {k: shapes()[k] for k in ("grid", "loose")}
    n, e = graph(**some)
    got = {(r.series_id, r.node): r.betweenness for r in M.betweenness(n, e, limit=0).collect()}
    for k, (size, edges) in some.items():
        assert [got[k, i] for i in range(size)] == pytest.approx(plain_betweenness(size, edges), abs=1e-12), k


@pytest.mark.parametrize("rounds", [None, 20])
def test_small_eigenvector_equals_power_steps(spark, graph, rounds):
    some = {k: shapes()[k] for k in ("ladder", "star", "dense", "one")}
    n, e = graph(**some)
    rows, jobs = jobs_of(spark, f"eigen{rounds}", lambda: M.eigenvector(n, e, rounds=rounds).collect())
    assert jobs <= 8, jobs
    got = {(r.series_id, r.node): r.eigenvector for r in rows}
    assert len(rows) == len(got) == sum(size for size, _ in some.values())
    for k, (size, edges) in some.items():
        a = np.eye(size)
        for u, v in edges:
            a[u, v] = a[v, u] = 1
        x = np.ones(size)
        for _ in range(rounds or 3000):
            x = a @ x
            x /= np.linalg.norm(x)
        assert [got[k, i] for i in range(size)] == pytest.approx(x.tolist(), abs=1e-6), k


def test_natural_visibility_scans_few_rows(make, monkeypatch):
    """Hidden leaves go before the scan that carries rows across stretches."""
    scanned, scan = [], G.scan
    monkeypatch.setattr(G, "scan", lambda df, *a, **k: scanned.append(df.count()) or scan(df, *a, **k))
    edges = G.natural_visibility(make(a=np.random.default_rng(5).random(1500).tolist())).count()
    assert scanned[-1] == edges and max(scanned[:-1], default=0) < 5 * edges, (scanned, edges)


def test_latex_rules_stand_once_in_the_plan(spark):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        spark.createDataFrame([("a",)], "s string").select(text.strip_latex(F.col("s"))).explain()
    assert out.getvalue().count("subsubsection") <= 2
