"""Series to graphs: horizontal and natural visibility, recurrence.

Nodes are positions. Horizontal visibility merges monotone stacks of blocks; natural visibility walks a tree of block
maxima (``FAN`` children per node) by equi-joins. No pair table is ever formed: work follows the number of edges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.core import KEYS, cut
from tidegraph.functions.noise import uniform
from tidegraph.layout import BLOCK, _div, attach, longest, ordered_position, quantiles, scan
from tidegraph.operators.dependence import choose_tau, embed_by, false_neighbours, mutual_information
from tidegraph.tiles import near_pairs, sample_neighbours

FAN = 8  # a wider node hands over more children that nothing hides yet
STACK = 1 << 14  # points of a block that horizontal visibility looks at in one go


def _tree(series: DataFrame, keys, t, x, levels: int, fan: int) -> list[DataFrame]:
    """For each level l = 0..levels-1: (keys, p, kids), p = node of level l + 1, kids = its
    children as (c, top, at, lo, hi): index at level l, maximum, its position, covered span."""
    node = F.struct(
        F.col(t).alias("c"), F.col(x).alias("top"), F.col(t).alias("at"), F.col(t).alias("lo"), F.col(t).alias("hi")
    )
    out, cur = [], series.select(*keys, node.alias("k"))
    for _ in range(levels):
        packed = cut(
            cur.groupBy(*keys, _div(F.col("k.c"), fan).alias("p")).agg(F.array_sort(F.collect_list("k")).alias("kids"))
        )
        out.append(packed)
        best = F.array_max(F.transform("kids", lambda k: F.struct(k["top"].alias("top"), (-k["at"]).alias("neg"))))
        cur = packed.select(
            *keys,
            F.struct(
                F.col("p").alias("c"), best["top"].alias("top"), (-best["neg"]).alias("at"),
                F.element_at("kids", 1)["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"),
            ).alias("k"),
        )
    return out


def _levels(rows: int, fan: int) -> int:
    levels, reach = 1, fan
    while reach < rows:
        levels, reach = levels + 1, reach * fan
    return levels


def _block_stack(ts: list, xs: list) -> tuple[list, list, list, list]:
    """Edges inside a block, and the places of the points that see its left and its right border."""
    src, dst, stack, records, top = [], [], [], [], None
    for j, v in enumerate(xs):
        while stack and xs[stack[-1]] < v:
            src.append(ts[stack.pop()])
            dst.append(ts[j])
        if stack:
            src.append(ts[stack[-1]])
            dst.append(ts[j])
            if xs[stack[-1]] == v:
                stack.pop()
        stack.append(j)
        if top is None or v > top:
            records.append(j)
            top = v
    return src, dst, records, stack


def _border_edges(left: list, right: list) -> tuple[list, list]:
    """Edges across a border: ``left`` (t, x) with falling x comes before it, ``right`` (t, x) with rising x behind it."""
    src, dst, stack = [], [], list(left)
    for t, v in right:
        while stack and stack[-1][1] < v:
            src.append(stack.pop()[0])
            dst.append(t)
        if not stack:
            break
        src.append(stack[-1][0])
        dst.append(t)
        if stack[-1][1] == v:
            stack.pop()
    return src, dst


def _stacked_blocks(base: DataFrame, keys, block: int) -> DataFrame:
    """(keys, blk, top, src, dst, left, right), one row for each block of ``base`` (keys, t, x).

    left and right: the points that see the border, as (t, x, nearer), nearer = x of the next such point towards it.
    """
    names = [*keys, "blk"]
    rows = base.withColumn("blk", _div(F.col("t"), block)).repartition(*names).sortWithinPartitions(*names, "t")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(key: tuple, ts: list, xs: list) -> tuple:
            src, dst, records, stack = _block_stack(ts, xs)
            left = [(ts[j], xs[j], xs[i] if i is not None else None) for i, j in zip([None, *records[:-1]], records, strict=True)]
            right = [(ts[j], xs[j], xs[i] if i is not None else None) for j, i in zip(stack, [*stack[1:], None], strict=True)]
            return (*key, max(xs), src, dst, left, right)

        key, ts, xs, out = None, [], [], []
        columns = [*names, "top", "src", "dst", "left", "right"]
        for batch in batches:
            if not len(batch):
                continue
            marks = list(zip(*(batch[c].tolist() for c in names), strict=True))
            t, x = batch["t"].tolist(), batch["x"].tolist()
            begin = 0
            for i, mark in enumerate(marks):
                if mark != key:
                    ts += t[begin:i]
                    xs += x[begin:i]
                    if ts:
                        out.append(done(key, ts, xs))
                    key, ts, xs, begin = mark, [], [], i
            ts += t[begin:]
            xs += x[begin:]
            if out:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if ts:
            yield pd.DataFrame([done(key, ts, xs)], columns=columns)

    kinds = dict(rows.dtypes)
    point = "array<struct<t: long, x: double, nearer: double>>"
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", top double, src array<long>, dst array<long>, `left` {point}, `right` {point}"
    return cut(rows.mapInPandas(blocks, schema))


def horizontal_visibility(series: DataFrame, *, keys=KEYS, t="t", x="x", block=STACK) -> DataFrame:
    """GRF-1: edges (keys, src < dst) of the horizontal visibility graph.

    Each block of a series keeps a monotone stack: its own edges, and the points that still see a border. Two points of
    different blocks see each other only if the blocks' maxima do, so the same question about the much shorter series of
    maxima names the pairs of blocks to merge, and a pair hands over only points between the highest block in between
    and the other block's maximum. Work and rows follow the length of the series, whatever its shape.
    """
    if block < 2:
        raise ValueError("a block holds at least two points")
    names = list(keys)
    base = series.select(*names, F.col(t).cast("long").alias("t"), F.col(x).cast("double").alias("x")).where("x IS NOT NULL")
    blocks = _stacked_blocks(base, names, block)

    def edges(rows: DataFrame) -> DataFrame:
        return rows.select(*names, F.explode(F.arrays_zip("src", "dst")).alias("_e")).select(*names, "_e.src", "_e.dst")

    inside = edges(blocks)
    if longest(blocks, "blk") <= 1:
        return inside
    pairs = horizontal_visibility(blocks.select(*names, F.col("blk").alias("t"), F.col("top").alias("x")), keys=names, block=block)
    ahead = Window.partitionBy(*names, "src").orderBy("dst")
    near = blocks.select(*names, F.col("blk").alias("src"), F.col("top").alias("top_a"), F.col("right").alias("a"))
    far = blocks.select(*names, F.col("blk").alias("dst"), F.col("top").alias("top_b"), F.col("left").alias("b"))
    tops = cut(pairs.join(far.drop("b"), [*names, "dst"]).withColumn("between", F.lag("top_b").over(ahead)))
    met = tops.join(near, [*names, "src"])

    def needed(points: str, other: str) -> Column:
        """Points above the blocks in between, up to the first that is above the other block."""
        low, high = F.col("between"), F.col(other)
        return F.filter(points, lambda p: (low.isNull() | (p["x"] > low)) & ((p["x"] <= high) | p["nearer"].isNull() | (p["nearer"] <= high)))

    met = met.select(*names, "src", "dst", "between", "top_a", needed("a", "top_b").alias("a"))
    met = met.join(far.drop("top_b"), [*names, "dst"]).select(*names, "a", needed("b", "top_a").alias("b"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_border_edges([(p["t"], p["x"]) for p in a], [(p["t"], p["x"]) for p in b]) for a, b in zip(batch["a"], batch["b"], strict=True)]
            out = batch[names].copy()
            out["src"], out["dst"] = [f[0] for f in found], [f[1] for f in found]
            yield out

    kinds = dict(met.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", src array<long>, dst array<long>"
    return inside.unionByName(edges(cut(met.mapInPandas(merge, schema))))


def natural_visibility(series: DataFrame, *, keys=KEYS, t="t", x="x", fan=FAN, block=BLOCK) -> DataFrame:
    """GRF-2: edges (keys, src < dst) of the natural visibility graph, without a span limit.

    j is visible from i if its slope exceeds all slopes before it. From the top of the tree
    downwards, a node of the tree stays in play for i only if an upper bound of its slope
    (its maximum at its nearest end) exceeds the best slope known to come before it (slopes
    at the maxima of earlier nodes). At the leaves bound and slope coincide, so the result
    is exact; work follows the number of visible pairs. A node hands the best slope before it to its children, so those
    below it go at once, without a shuffle.
    """
    levels = _levels(longest(series, t), fan)
    tree = _tree(series, keys, t, x, levels, fan)
    base = series.select(*keys, F.col(t).alias("i"), F.col(x).alias("v"), F.lit(None).cast("double").alias("best"))
    top = tree[levels - 1]
    state = base.withColumn("p", F.lit(0).cast("long"))
    for level in range(levels - 1, -1, -1):
        packed = top if level == levels - 1 else tree[level]
        if level == levels - 1:
            last = base.groupBy(*keys).agg(F.max("i").alias("_last"))
            joined = attach(state, packed.drop("p").join(last, list(keys)), keys=keys, t="i")
        else:
            joined = state.join(packed, [*keys, "p"])
        i, v = F.col("i"), F.col("v")
        kids = joined.select(*keys, "i", "v", "best", F.explode(F.filter("kids", lambda k: k["hi"] > F.col("i"))).alias("k"))
        reach = F.greatest(F.col("k.lo"), i + 1)
        rise = F.col("k.top") - v
        bound = F.when(rise >= 0, rise / (reach - i)).otherwise(rise / (F.col("k.hi") - i))
        known = F.when(F.col("k.at") > i, rise / (F.col("k.at") - i))
        kids = kids.select(
            *keys, "i", "v", "best", F.col("k.c").alias("c"),
            F.when(F.col("k.at") > i, bound).otherwise(F.lit(float("inf")) if level else bound).alias("bound"),
            known.alias("known"),
        )
        kids = kids.where(F.col("best").isNull() | (F.col("bound") > F.col("best")))  # before rows move: slopes of the level above
        if level == 0:  # bound and slope are one; most leaves are hidden by others of their stretch and go before the scan
            stretch = Window.partitionBy(*keys, "i", _div(F.col("c"), block)).orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
            kids = kids.select(*keys, "i", "c", "bound").withColumn("before", F.max("bound").over(stretch))
            kids = kids.where(F.col("before").isNull() | (F.col("bound") > F.col("before"))).drop("before")
            seen = scan(kids, {"before": ("max", F.col("bound"))}, keys=(*keys, "i"), t="c", exclusive=True, block=block)
            open_ones = seen.where(F.col("before").isNull() | (F.col("bound") > F.col("before")))
            return cut(open_ones.select(*keys, F.col("i").alias("src"), F.col("c").alias("dst")))
        seen = scan(kids, {"before": ("max", F.col("known"))}, keys=(*keys, "i"), t="c", exclusive=True, rows=block, block=block)
        state = cut(
            seen.where(F.col("before").isNull() | (F.col("bound") > F.col("before"))).select(
                *keys, "i", "v", F.greatest("best", "before").alias("best"), F.col("c").alias("p")
            )
        )
    raise AssertionError("a tree has at least one level")


def recurrence_threshold(
    cloud: DataFrame, *, sample: int | None = None, neighbours=99, percentile=0.10, seed: int = 42, keys=KEYS
) -> DataFrame:
    """GRF-3: (keys, epsilon): percentile of the distances from each point to its ``neighbours`` nearest points; on
    request only from ``sample`` points a key, in hash order."""
    if sample is None:
        return quantiles(sample_neighbours(cloud, cloud.select(*keys, "node", "vec"), neighbours, keys=keys), "dist", [percentile], keys=keys, names=["epsilon"])
    ident = [F.col(k).cast("string") for k in keys]
    drawn = cloud.withColumn("_u", uniform("sample", *ident, F.col("node"), F.lit(seed)))
    picked = ordered_position(drawn, ["_u", "node"], keys=keys, name="_pos").where(F.col("_pos") < sample)
    d = sample_neighbours(cloud, picked.select(*keys, "node", "vec"), neighbours, keys=keys)
    return quantiles(d, "dist", [percentile], keys=keys, names=["epsilon"])


def recurrence_edges(cloud: DataFrame, thresholds: DataFrame, *, keys=KEYS) -> DataFrame:
    """GRF-4: edges between embedded points at Euclidean distance <= epsilon, both directions."""
    pairs = near_pairs(cloud, thresholds.select(*keys, F.col("epsilon").alias("r")), keys=keys)
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return pairs.select(*keys, F.explode(both).alias("_e")).select(*keys, "_e.src", "_e.dst")


def recurrence_parameters(
    series: DataFrame, tau_max: int = 50, d_max: int = 10, *, keys=KEYS, t="t", x="x"
) -> tuple[DataFrame, DataFrame]:
    """GRF-5: (parameters: keys, tau, d, epsilon; embedded points: keys, node, vec)."""
    taus = cut(choose_tau(mutual_information(series, tau_max, keys=keys, t=t, x=x), keys=keys))
    _, chosen = false_neighbours(series, taus, d_max, keys=keys, t=t, x=x)
    chosen = cut(chosen)
    cloud = cut(embed_by(series, chosen, taus.agg(F.max("tau")).first()[0], d_max, keys=keys, t=t, x=x))
    eps = recurrence_threshold(cloud, keys=keys)
    return cut(chosen.join(eps, list(keys))), cloud


def recurrence_graph(series: DataFrame, tau_max: int = 50, d_max: int = 10, *, keys=KEYS, t="t", x="x"):
    """GRF-4: (nodes with features, edges, metadata) of the recurrence graphs of all keys."""
    params, cloud = recurrence_parameters(series, tau_max, d_max, keys=keys, t=t, x=x)
    edges = cut(recurrence_edges(cloud, params, keys=keys))
    meta = graph_counts(cloud, edges, keys=keys).join(params, list(keys)).withColumn("distance", F.lit("euclidean"))
    return cloud.select(*keys, "node", F.col("vec").alias("features")), edges, meta


def visibility_nodes(series: DataFrame, *, keys=KEYS, t="t", x="x") -> DataFrame:
    return series.select(*keys, F.col(t).alias("node"), F.array(x).alias("features"))


def graph_counts(nodes: DataFrame, edges: DataFrame, *, keys=KEYS) -> DataFrame:
    n = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    m = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("edges"))
    return n.join(m, list(keys), "left").na.fill(0, ["edges"])


def all_graphs(
    series: DataFrame, kinds: Sequence[str] = ("hvg", "nvg", "recurrence"), tau_max: int = 50, d_max: int = 10,
    *, keys=KEYS, t="t", x="x",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """GRF-6: (nodes, edges, counts) with a ``graph`` column; one keyed run per graph type."""
    nodes = edges = None
    for kind in kinds:
        if kind == "hvg":
            n, e = visibility_nodes(series, keys=keys, t=t, x=x), horizontal_visibility(series, keys=keys, t=t, x=x)
        elif kind == "nvg":
            n, e = visibility_nodes(series, keys=keys, t=t, x=x), natural_visibility(series, keys=keys, t=t, x=x)
        elif kind == "recurrence":
            n, e, _ = recurrence_graph(series, tau_max, d_max, keys=keys, t=t, x=x)
        else:
            raise ValueError(f"unknown graph type {kind}")
        n, e = n.withColumn("graph", F.lit(kind)), e.withColumn("graph", F.lit(kind))
        nodes = n if nodes is None else nodes.unionByName(n)
        edges = e if edges is None else edges.unionByName(e)
    return nodes, edges, graph_counts(nodes, edges, keys=(*keys, "graph"))


def simple_edges(edges: DataFrame, *, keys=KEYS) -> DataFrame:
    """GRF-7: undirected simple view, src < dst, no loops, no repeats."""
    return (
        edges.where(F.col("src") != F.col("dst"))
        .select(*keys, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .distinct()
    )


def neighbourhood_mean(nodes: DataFrame, edges: DataFrame, *, keys=KEYS) -> DataFrame:
    """GRF-8: one hop: per node, the mean features of the nodes that point to it."""
    at = nodes.select(*keys, F.col("node").alias("src"), F.posexplode("features").alias("f", "v"))
    per = edges.select(*keys, "src", "dst").join(at, [*keys, "src"]).groupBy(*keys, "dst", "f").agg(F.avg("v").alias("v"))
    return per.groupBy(*keys, F.col("dst").alias("node")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("f", "v"))), lambda s: s["v"]).alias("features")
    )
