"""Graph metrics per graph key, on the undirected simple view (src < dst) of the edges.

``nodes`` has (keys, node) with node = 0..n-1. Every loop keeps its state as a checkpointed
table and reads one scalar per round.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.core import KEYS, cut, cut_counted
from tidegraph.functions.noise import uniform
from tidegraph.layout import attach, ordered_position, quantiles, spread_join
from tidegraph.operators import packed
from tidegraph.operators.distances import WIDTH, arcs_of, numbered
from tidegraph.operators.packed import KeyedDistances

# Edge limits per graph type, for the report of metric_flags.
NVG_CLUSTERING_LIMIT = 400_000
NVG_CENTRALITY_LIMIT = 1_500_000
NVG_BETWEENNESS_LIMIT = 200_000
NVG_CLOSENESS_LIMIT = 50_000
RECURRENCE_LIMIT = 12_000
STATE_ROWS = 1 << 22  # rows of (node, batch of 64 sources) that betweenness holds at a time, about


def size_metrics(nodes: DataFrame, edges: DataFrame, *, keys=KEYS) -> DataFrame:
    """MET-1: nodes, edges, density, mean degree."""
    n = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    m = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    d = n.join(m, list(keys), "left").na.fill(0, ["m"])
    return d.select(
        *keys, "n", "m",
        F.when(F.col("n") > 1, 2.0 * F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("density"),
        (2.0 * F.col("m") / F.col("n")).alias("mean_degree"),
    )


def degrees(nodes: DataFrame, edges: DataFrame, *, keys=KEYS) -> DataFrame:
    """(keys, node, degree), isolated nodes included; ends are counted before the shuffle."""
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("node")).withColumn("_one", F.lit(1))
    all_nodes = nodes.select(*keys, "node").withColumn("_one", F.lit(0))
    return ends.unionByName(all_nodes).groupBy(*keys, "node").agg(F.sum("_one").alias("degree"))


def degree_metrics(nodes: DataFrame, edges: DataFrame, *, keys=KEYS) -> DataFrame:
    """MET-2: degree min, max, mean, median, population std."""
    d = degrees(nodes, edges, keys=keys)
    base = d.groupBy(*keys).agg(
        F.min("degree").alias("degree_min"), F.max("degree").alias("degree_max"),
        F.avg("degree").alias("degree_mean"), F.stddev_pop("degree").alias("degree_std"),
    )
    return base.join(quantiles(d, "degree", [0.5], keys=keys, names=["degree_median"]), list(keys))


def degree_centrality(nodes: DataFrame, edges: DataFrame, *, keys=KEYS) -> DataFrame:
    """MET-7: degree / (n - 1)."""
    d = degrees(nodes, edges, keys=keys)
    s = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("node").alias("_last"))
    return attach(d, s, keys=keys, t="node").select(
        *keys, "node", F.when(F.col("_n") > 1, F.col("degree") / (F.col("_n") - 1)).otherwise(1.0).alias("centrality")
    )


def component_labels(nodes: DataFrame, edges: DataFrame, *, keys=KEYS, max_rounds=200, limit: int = packed.NODES) -> DataFrame:
    """MET-3: (keys, node, label), label = smallest node of the connected component.

    Graphs of up to ``limit`` nodes are solved whole in a task, larger ones in rounds over all tasks.
    """
    small, rest = packed.divide(nodes, edges, keys, limit=limit)
    out = cut(packed.labels(small, keys)) if small is not None else None
    if rest is None:
        return out
    large = _star_labels(*rest[:2], keys, max_rounds)
    return large if out is None else out.unionByName(large)


def _star_labels(nodes: DataFrame, edges: DataFrame, keys, max_rounds: int) -> DataFrame:
    """Alternating large-star and small-star rounds; the number of rounds grows with the
    logarithm of the component size, not with its diameter."""
    e = cut(edges.select(*keys, F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        # large star: neighbours above u are linked to the smallest of u and its neighbours
        both = e.select(*keys, F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("_e")).select(*keys, "_e.a", "_e.b")
        low = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("_rows"))
        large = (
            spread_join(both.where(F.col("b") > F.col("a")), low, [*keys, "a"], "_rows")  # a hub is no task of its own
            .select(*keys, F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        )
        large = cut(large)
        # small star: neighbours below u, and u, are linked to the smallest of them
        low = large.groupBy(*keys, "u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_rows"))
        joined = spread_join(large, low, [*keys, "u"], "_rows")
        small = (
            joined.where(F.col("v") != F.col("m")).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select(*keys, "u", F.col("m").alias("v")))
            .distinct()
        )
        e = cut(small)
        now = e.agg(F.count(F.lit(1)), F.sum("v"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.select(*keys, "node").join(
        e.select(*keys, F.col("u").alias("node"), F.col("v").alias("_l")), [*keys, "node"], "left"
    ).select(*keys, "node", F.coalesce("_l", "node").alias("label"))


def component_metrics(labels: DataFrame, *, keys=KEYS) -> DataFrame:
    """MET-3: number of components and size of the largest."""
    sizes = labels.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_s"))
    return sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("components"), F.max("_s").alias("largest"))


def largest_component(labels: DataFrame, *, keys=KEYS) -> DataFrame:
    """(keys, node) of the largest component; ties go to the smallest label."""
    sizes = labels.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_s"), F.max("node").alias("_last"))
    best = sizes.groupBy(*keys).agg(F.min_by("label", F.struct((-F.col("_s")).alias("a"), "label")).alias("label"))
    big = best.join(sizes.select(*keys, "label", "_last"), [*keys, "label"])
    return attach(labels, big.withColumnRenamed("label", "_big"), keys=keys, t="node").where(
        F.col("label") == F.col("_big")
    ).select(*keys, "node")


def clustering(nodes: DataFrame, edges: DataFrame, *, keys=KEYS) -> DataFrame:
    """MET-4: (keys, node, clustering).

    Edges point from lower to higher degree, so no node has many out-edges and the wedge
    join stays near m * sqrt(m) even with hubs.
    """
    deg = cut(degrees(nodes, edges, keys=keys))
    a = deg.select(*keys, F.col("node").alias("src"), F.col("degree").alias("_ds"))
    b = deg.select(*keys, F.col("node").alias("dst"), F.col("degree").alias("_dd"))
    e = edges.select(*keys, "src", "dst").join(a, [*keys, "src"]).join(b, [*keys, "dst"])
    s_rank = F.struct(F.col("_ds").alias("deg"), F.col("src").alias("id"))
    d_rank = F.struct(F.col("_dd").alias("deg"), F.col("dst").alias("id"))
    up = s_rank < d_rank
    out = cut(
        e.select(
            *keys, F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v"),
            F.when(up, d_rank).otherwise(s_rank).alias("o"),
        )
    )
    one = out.select(*keys, "u", F.col("v").alias("v1"), F.col("o").alias("o1"))
    two = out.select(*keys, "u", F.col("v").alias("v2"), F.col("o").alias("o2"))
    wedges = one.join(two, [*keys, "u"]).where(F.col("o1") < F.col("o2")).select(*keys, "u", "v1", "v2")
    closing = out.select(*keys, F.col("u").alias("v1"), F.col("v").alias("v2"))
    triangles = wedges.join(closing, [*keys, "v1", "v2"])
    per = triangles.select(*keys, F.explode(F.array("u", "v1", "v2")).alias("node")).groupBy(*keys, "node").agg(
        F.count(F.lit(1)).alias("_t")
    )
    d = F.col("degree")
    coef = F.when(d >= 2, 2.0 * F.coalesce("_t", F.lit(0)) / (d * (d - 1))).otherwise(0.0)
    return deg.join(per, [*keys, "node"], "left").select(*keys, "node", coef.alias("clustering"))


def distribution(values: DataFrame, x: str, *, keys=KEYS, name: str | None = None) -> DataFrame:
    """Mean, median, min, max and population std of a node metric."""
    p = name or x
    base = values.groupBy(*keys).agg(
        F.avg(x).alias(f"{p}_mean"), F.min(x).alias(f"{p}_min"), F.max(x).alias(f"{p}_max"), F.stddev_pop(x).alias(f"{p}_std")
    )
    return base.join(quantiles(values, x, [0.5], keys=keys, names=[f"{p}_median"]), list(keys))


def distance_counts(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, *, keys=KEYS) -> DataFrame:
    """(keys, source, d, cnt): how many nodes lie at distance d >= 1 from each source.

    ``sources`` (keys, node) limits the sources. See ``distances`` for the two ways the distances are found.
    """
    return KeyedDistances(nodes, edges, sources, keys=keys).counts()


def eccentricity(dist: DataFrame, sources: DataFrame, *, keys=KEYS) -> DataFrame:
    """MET-5: (keys, node, eccentricity) within the component of each source."""
    e = dist.groupBy(*keys, F.col("source").alias("node")).agg(F.max("d").alias("_e"))
    return sources.select(*keys, "node").join(e, [*keys, "node"], "left").select(
        *keys, "node", F.coalesce("_e", F.lit(0)).alias("eccentricity")
    )


def distance_metrics(nodes: DataFrame, edges: DataFrame, *, keys=KEYS, node_limit: int | None = None) -> DataFrame:
    """MET-5: diameter, radius, mean eccentricity of the largest component; graphs above
    ``node_limit`` nodes get NULL and a flag."""
    size = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    big = F.col("_n") > node_limit if node_limit is not None else F.lit(False)
    skipped = cut(size.select(*keys, big.alias("distances_skipped")))
    todo = skipped.where(~F.col("distances_skipped")).select(*keys)
    n, e = nodes.join(todo, list(keys), "left_semi"), edges.join(todo, list(keys), "left_semi")
    core = cut(largest_component(component_labels(n, e, keys=keys), keys=keys))
    inside = e.join(core.withColumnRenamed("node", "src"), [*keys, "src"], "left_semi")
    far = F.col("far")
    g = KeyedDistances(core, inside, keys=keys).sums().groupBy(*keys).agg(F.max(far).alias("diameter"), F.min(far).alias("radius"), F.avg(far).alias("ecc_mean"))
    return skipped.join(g, list(keys), "left")


def bfs(edges: DataFrame, sources: DataFrame, *, keys=KEYS, nodes: DataFrame | None = None) -> DataFrame:
    """(keys, source, node, d): distances from a few listed sources a graph."""
    if nodes is None:
        nodes = edges.select(*keys, F.explode(F.array("src", "dst")).alias("node")).unionByName(sources.select(*keys, "node")).distinct()
    return KeyedDistances(nodes, edges, sources, keys=keys).pairs()


def two_sweep_diameter(nodes: DataFrame, edges: DataFrame, *, keys=KEYS, on="connected_only") -> DataFrame:
    """MET-6: lower bound of the diameter by two searches, from the smallest node and from the
    farthest node found. 0 without edges; NULL for a disconnected graph unless ``on='largest'``."""
    if on not in ("connected_only", "largest"):
        raise ValueError("on must be 'connected_only' or 'largest'")
    all_nodes = nodes.select(*keys, "node")
    if on == "largest":
        all_nodes = cut(largest_component(component_labels(nodes, edges, keys=keys), keys=keys))
    total = all_nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("node"))
    first = bfs(edges, total, keys=keys, nodes=all_nodes)
    far = first.groupBy(*keys).agg(
        F.min_by("node", F.struct((-F.col("d")).alias("a"), "node")).alias("node"), F.count(F.lit(1)).alias("_r")
    )
    far = cut(far)
    second = bfs(edges, far, keys=keys, nodes=all_nodes).groupBy(*keys).agg(F.max("d").alias("_d"))
    m = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    d = total.drop("node").join(far.drop("node"), list(keys)).join(second, list(keys)).join(m, list(keys), "left")
    value = F.when(F.coalesce("_m", F.lit(0)) == 0, 0).when(F.col("_r") == F.col("_n"), F.col("_d"))
    return d.select(*keys, value.alias("diameter_approx"))


def hash_sample(nodes: DataFrame, size: int, *, seed=42, keys=KEYS) -> DataFrame:
    """``size`` nodes per key in hash order (all of them when there are fewer)."""
    ident = [F.col(k).cast("string") for k in keys]
    d = nodes.select(*keys, "node").withColumn("_u", uniform("pivot", *ident, F.col("node"), F.lit(seed)))
    return ordered_position(d, ["_u", "node"], keys=keys, name="_pos").where(F.col("_pos") < size).select(*keys, "node")


def closeness(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, *, keys=KEYS) -> DataFrame:
    """MET-8: closeness with component correction, exact or for given sources."""
    g = KeyedDistances(nodes, edges, sources, keys=keys).sums()
    n = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("node").alias("_last"))
    d = attach(g, n, keys=keys, t="node")
    value = F.when(F.col("total") > 0, F.col("reached") * F.col("reached") / (F.col("total") * (F.col("_n") - 1))).otherwise(0.0)
    return d.select(*keys, "node", value.alias("closeness"))


def _added(rows: DataFrame, by, name: str) -> DataFrame:
    """Sums at each place of the arrays ``name`` over the rows of a group."""
    return rows.groupBy(*by).agg(F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(WIDTH)]).alias(name))


def _dependencies(arcs: DataFrame, start: DataFrame, keys) -> DataFrame:
    """(keys, node, delta): dependencies of all sources of ``start`` (keys, node, batch, bit), added up by node.

    A row is a node and a batch of 64 sources: an array of path counts. Forward, level by level: a node next to level d
    lies on level d - 1, d or d + 1, so the last two levels tell which counts are new. Backward, farthest level first,
    each level hands its dependencies to the level before.
    """
    by = (*keys, "batch", "node")
    one = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.when(i == F.col("bit"), 1.0).otherwise(0.0))
    levels = [cut(_added(start.select(*by, one.alias("sigma")), by, "sigma"))]
    before = levels[0].where(F.lit(False))
    while True:
        sent = levels[-1].join(arcs, [*keys, "node"]).select(*keys, "batch", F.col("dst").alias("node"), F.col("sigma").alias("got"))
        old = _added(levels[-1].unionByName(before).select(*by, F.col("sigma").alias("old")), by, "old")
        met = _added(sent, by, "got").join(old, list(by), "left")
        fresh = F.when(F.col("old").isNull(), F.col("got")).otherwise(F.zip_with("got", "old", lambda x, y: F.when(y > 0, 0.0).otherwise(x)))
        new, rows = cut_counted(met.select(*by, fresh.alias("sigma")).where(F.exists("sigma", lambda x: x > 0)))
        if rows == 0:
            break
        before = levels[-1]
        levels.append(new)
    total = start.select(*keys, "node", F.lit(0.0).alias("delta")).where(F.lit(False))
    here = levels[-1].withColumn("got", F.transform("sigma", lambda x: F.lit(0.0)))  # sigma, and what comes back to it
    for level in [*reversed(levels[:-1]), None]:
        delta = F.zip_with("got", "sigma", lambda x, y: x * y)
        here = here.select(*by, "sigma", delta.alias("delta"))
        if level is None:  # the sources themselves
            break
        summed = F.aggregate("delta", F.lit(0.0), lambda a, x: a + x)
        total = total.unionByName(here.select(*keys, "node", summed.alias("delta")))
        share = F.zip_with("delta", "sigma", lambda x, y: F.when(y > 0, (1 + x) / y).otherwise(0.0))
        back = here.select(*by, share.alias("got")).join(arcs, [*keys, "node"]).select(*keys, "batch", F.col("dst").alias("node"), "got")
        nothing = F.transform("sigma", lambda x: F.lit(0.0))
        here = cut(level.join(_added(back, by, "got"), list(by), "left").select(*by, "sigma", F.coalesce("got", nothing).alias("got")))
    return cut(total.groupBy(*keys, "node").agg(F.sum("delta").alias("delta")))


def betweenness(nodes: DataFrame, edges: DataFrame, pivots: DataFrame | None = None, *, keys=KEYS, at_once: int = STATE_ROWS, limit: int = packed.NODES) -> DataFrame:
    """MET-9: normalised betweenness, exact or from pivot sources scaled by n / k.

    Graphs of up to ``limit`` nodes are solved whole in a task. Of larger ones, batches of 64 sources a graph go through
    ``_dependencies`` together, as many at once as keep the state (nodes times batches) at about ``at_once`` rows.
    """
    small, rest = packed.divide(nodes, edges, keys, pivots, limit=limit)
    g = packed.dependencies(small, keys) if small is not None else None
    if rest is not None:
        large = _spread_dependencies(*rest, keys, at_once)
        g = large if g is None else g.unionByName(large)
    n = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("node").alias("_last"))
    k = (nodes if pivots is None else pivots).groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    d = attach(g, n.join(k, list(keys)), keys=keys, t="node")
    scale = (F.col("_n") / F.col("_k")) / ((F.col("_n") - 1.0) * (F.col("_n") - 2.0))
    return d.select(*keys, "node", F.when(F.col("_n") > 2, F.col("delta") * scale).otherwise(0.0).alias("betweenness"))


def _spread_dependencies(nodes: DataFrame, edges: DataFrame, pivots: DataFrame | None, keys, at_once: int) -> DataFrame:
    """(keys, node, delta) of graphs that are spread over the tasks."""
    arcs = cut(arcs_of(edges, keys, "node", "dst"))
    start = numbered(cut((nodes if pivots is None else pivots).select(*keys, "node")), keys)
    rows = nodes.count()
    batches = (start.agg(F.max("batch")).first()[0] or 0) + 1
    together = max(1, at_once // max(1, rows))
    total = nodes.select(*keys, "node", F.lit(0.0).alias("delta"))
    for first in range(0, batches, together):
        part = start.where((F.col("batch") >= first) & (F.col("batch") < first + together))
        total = total.unionByName(_dependencies(arcs, part, keys))
    return total.groupBy(*keys, "node").agg(F.sum("delta").alias("delta"))


def _power_steps(v: DataFrame, both: DataFrame, keys, steps: int) -> DataFrame:
    """(keys, node, last, ks): ks = [v, Bv, ..., B^steps v], last its final entry. One pass per step: the
    loop arc of a node carries the entries it already has."""
    cur = v.select(*keys, F.col("node").alias("from"), F.col("v").alias("last"), F.array("v").alias("ks"))
    for _ in range(steps):
        sent = both.join(cur, [*keys, "from"]).select(
            *keys, F.col("dst").alias("from"), "last", F.when(F.col("from") == F.col("dst"), F.col("ks")).alias("ks")
        )
        got = sent.groupBy(*keys, "from").agg(F.sum("last").alias("last"), F.first("ks", ignorenulls=True).alias("ks"))
        cur = got.select(*keys, "from", "last", F.concat("ks", F.array("last")).alias("ks"))
    return cur.withColumnRenamed("from", "node")


def eigenvector(
    nodes: DataFrame, edges: DataFrame, *, keys=KEYS, tol=1e-6, steps=10, max_cycles=100, rounds: int | None = None,
    limit: int = packed.NODES,
) -> DataFrame:
    """MET-10: eigenvector centrality, the leading eigenvector of A + I with unit L2 norm per key.

    ``nodes`` and ``edges`` should hold one component per key. ``rounds`` asks for that many plain power steps instead.
    Graphs of up to ``limit`` nodes are solved whole in a task, larger ones as ``_spread_eigenvector`` says.
    """
    small, rest = packed.divide(nodes, edges, keys, limit=limit)
    out = packed.leading(small, keys, rounds) if small is not None else None
    if rest is None:
        return out
    large = _spread_eigenvector(*rest[:2], keys, tol, steps, max_cycles, rounds)
    return large if out is None else out.unionByName(large)


def _spread_eigenvector(nodes: DataFrame, edges: DataFrame, keys, tol: float, steps: int, max_cycles: int, rounds: int | None) -> DataFrame:
    """A cycle does ``steps`` products in one job and restarts from the best combination of the vectors it saw: their
    inner products are one aggregate per key, the combination a steps x steps problem per
    key. Long thin graphs need a few cycles where plain power iteration needs hundreds of
    rounds. A key stops when its cycle started from a residual below ``tol`` times the
    eigenvalue; keys that have not after ``max_cycles`` raise an error.
    """
    loops = nodes.select(*keys, F.col("node").alias("from"), F.col("node").alias("dst"))
    both = cut(arcs_of(edges, keys, "from").unionByName(loops))
    last = cut(nodes.groupBy(*keys).agg(F.max("node").alias("_last"), F.count(F.lit(1)).alias("_n")))
    v = cut(attach(nodes.select(*keys, "node"), last, keys=keys, t="node").select(*keys, "node", (1 / F.sqrt("_n")).alias("v")))
    if rounds is not None:
        for done in range(0, rounds, 10):
            part = cut(_power_steps(v, both, keys, min(10, rounds - done)).select(*keys, "node", "last"))
            norm = part.groupBy(*keys).agg(F.sqrt(F.sum(F.col("last") ** 2)).alias("_norm")).join(last, list(keys))
            v = attach(part, norm, keys=keys, t="node").select(*keys, "node", (F.col("last") / F.col("_norm")).alias("v"))
        return v.select(*keys, "node", F.col("v").alias("eigenvector"))
    m = steps
    entry = lambda i: F.get("ks", F.lit(i))
    products = [F.sum(entry(i) * entry(j)) for i in range(m + 1) for j in range(i, m + 1)]

    @F.pandas_udf("c array<double>, resid double")
    def combine(gram: pd.Series) -> pd.DataFrame:
        out = []
        for flat in gram:
            g = np.zeros((m + 1, m + 1))
            g[np.triu_indices(m + 1)] = flat
            g = g + np.triu(g, 1).T
            d = np.sqrt(np.diag(g))
            gs = g / np.outer(d, d)
            small = gs[:m, :m]
            h = g[:m, 1:] / np.outer(d[:m], d[:m])
            w, u = np.linalg.eigh(small)
            keep = w > 1e-10 * w[-1]
            t = u[:, keep] / np.sqrt(w[keep])
            vals, vecs = np.linalg.eigh(t.T @ ((h + h.T) / 2) @ t)
            c = t @ vecs[:, -1] / d[:m]
            c = c * np.sign(c @ g[:m, 0])
            c = c / np.sqrt(c @ g[:m, :m] @ c)
            theta = g[0, 1] / g[0, 0]
            resid = np.sqrt(max(g[1, 1] / g[0, 0] - theta**2, 0.0)) / theta
            out.append((c.tolist(), float(resid)))
        return pd.DataFrame(out, columns=["c", "resid"])

    settled = None
    for _ in range(max_cycles):
        seen = cut(_power_steps(v, both, keys, m).drop("last"))
        best = cut(seen.groupBy(*keys).agg(F.array(*products).alias("gram")).select(*keys, combine("gram").alias("_s")).select(*keys, "_s.*"))
        new = F.col("c")[0] * entry(0)
        for i in range(1, m):
            new = new + F.col("c")[i] * entry(i)
        v = cut(attach(seen, best.join(last, list(keys)), keys=keys, t="node").select(*keys, "node", new.alias("v"), "resid"))
        ready = v.where(F.col("resid") <= tol).drop("resid")
        settled = ready if settled is None else settled.unionByName(ready)
        v = v.where(F.col("resid") > tol).drop("resid")
        if best.where(F.col("resid") > tol).isEmpty():
            break
    else:
        raise ArithmeticError(f"eigenvector: some graphs did not settle in {max_cycles} cycles of {steps} products")
    return settled.select(*keys, "node", F.abs("v").alias("eigenvector"))


def metric_flags(sizes: DataFrame) -> DataFrame:
    """MET-11: where a run on one machine would omit or sample, by graph type and number of edges (a report only)."""
    g, m = F.col("graph"), F.col("m")
    nvg, rec = g == "nvg", g == "recurrence"
    omitted = nvg & (m > NVG_CENTRALITY_LIMIT)
    return sizes.select(
        "*",
        (nvg & (m > NVG_CLUSTERING_LIMIT)).alias("clustering_omitted"),
        omitted.alias("centrality_omitted"),
        (~omitted & ((nvg & (m > NVG_BETWEENNESS_LIMIT)) | (rec & (m > RECURRENCE_LIMIT)))).alias("betweenness_sampled"),
        (~omitted & ((nvg & (m > NVG_CLOSENESS_LIMIT)) | (rec & (m > RECURRENCE_LIMIT)))).alias("closeness_sampled"),
    )


def graph_metrics(
    nodes: DataFrame, edges: DataFrame, *, keys=("series_id", "component", "graph"), pivots: int | None = None, sources: int | None = None
) -> DataFrame:
    """MET-12: one row per graph with structure, clustering and centralities; the flags of ``metric_flags`` are a report.

    Everything is exact for every graph, unless the caller asks for a sample of ``pivots`` (betweenness) or
    ``sources`` (closeness) per graph.
    """
    nodes, e = cut(nodes.select(*keys, "node")), cut(simple_edges_of(edges, keys))
    out = metric_flags(size_metrics(nodes, e, keys=keys)).join(degree_metrics(nodes, e, keys=keys), list(keys))
    labels = cut(component_labels(nodes, e, keys=keys))
    out = out.join(component_metrics(labels, keys=keys), list(keys))
    out = out.join(two_sweep_diameter(nodes, e, keys=keys), list(keys), "left")
    out = out.join(distribution(clustering(nodes, e, keys=keys), "clustering", keys=keys), list(keys), "left")
    out = out.join(distribution(degree_centrality(nodes, e, keys=keys), "centrality", keys=keys, name="degree_centrality"), list(keys), "left")

    def some(size: int | None) -> DataFrame:
        return nodes if size is None else cut(hash_sample(nodes, size, keys=keys))

    cl = closeness(nodes, e, some(sources), keys=keys)
    bt = betweenness(nodes, e, some(pivots), keys=keys)
    core = cut(largest_component(labels, keys=keys))
    inside = e.join(core.withColumnRenamed("node", "src"), [*keys, "src"], "left_semi")
    ev = eigenvector(core, inside, keys=keys)
    for df, name in ((cl, "closeness"), (bt, "betweenness"), (ev, "eigenvector")):
        out = out.join(distribution(cut(df), name, keys=keys), list(keys), "left")
    return out


def simple_edges_of(edges: DataFrame, keys) -> DataFrame:
    from tidegraph.operators.graphs import simple_edges

    return simple_edges(edges, keys=keys)


def panel(metrics: DataFrame, values: Sequence[str], graphs: Sequence[str] = ("hvg", "nvg", "recurrence"), *, by="series_id") -> DataFrame:
    """MET-13: per series and metric: 'min - max' over components for each graph type."""
    from tidegraph.operators.shape import range_label

    long = metrics.unpivot([by, "graph"], list(values), "metric", "value")
    lab = long.groupBy(by, "metric", "graph").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    lab = lab.select(by, "metric", "graph", range_label(F.col("lo"), F.col("hi")).alias("range"))
    return lab.groupBy(by, "metric").pivot("graph", list(graphs)).agg(F.first("range"))
