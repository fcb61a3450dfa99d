"""Graphs of bounded size, one row a graph: Spark deals the graphs to tasks, a task solves many side by side in numpy.

``divide`` parts the graphs by size. A graph of at most ``NODES`` nodes and ``EDGES`` edges becomes a row of arrays, so it
is shuffled once, whatever its diameter; larger ones go to the operators that spread one graph over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.core import cut
from tidegraph.operators.distances import Distances

NODES = 512
EDGES = 2048
WORK = 1 << 21  # ways from sources over arcs that a stack of graphs may hold


def divide(nodes: DataFrame, edges: DataFrame, keys, sources: DataFrame | None = None, *, limit: int = NODES):
    """(packed graphs or None, (nodes, edges, sources) of the larger graphs or None). Packed: (keys, nodes, ends, sources),
    ``ends`` holds both ends of an edge in turn; without ``sources`` all nodes are."""
    if limit <= 0:
        return None, (nodes, edges, sources)
    keys, one, zero = list(keys), F.lit(1), F.lit(0)
    listed = [(nodes, "node", zero), (edges, "dst", one)] + ([(sources, "node", F.lit(2))] if sources is not None else [])
    rows = None
    for df, b, kind in listed:
        a = "src" if b == "dst" else "node"
        part = df.select(*keys, F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"), kind.alias("kind"))
        rows = part if rows is None else rows.unionByName(part)
    counts = [F.count(F.when(F.col("kind") == i, 1)) for i in range(3)]
    fits = (counts[0] <= limit) & (counts[1] <= EDGES) & (counts[2] <= limit)
    large = cut(rows.groupBy(*keys).agg(fits.alias("fits")).where(~F.col("fits")).select(*keys))
    rest = None
    if not large.isEmpty():
        rest = tuple(None if df is None else df.join(large, keys, "left_semi") for df in (nodes, edges, sources))
        rows = rows.join(large, keys, "left_anti")

    def held(kind: int, value):
        return F.collect_list(F.when(F.col("kind") == kind, value))

    packed = rows.groupBy(*keys).agg(
        held(0, F.col("a")).alias("nodes"), F.flatten(held(1, F.array("a", "b"))).alias("ends"), held(0 if sources is None else 2, F.col("a")).alias("sources")
    )
    return packed, rest


class Stack:
    """Graphs side by side. The vertices of all graphs, in order of graph and id, are numbered through; the arcs of vertex
    i are ``heads[starts[i] : starts[i] + counts[i]]``. A pair is a source and a vertex of its graph."""

    def __init__(self, nodes: Sequence, ends: Sequence, sources: Sequence):
        ids, listed, tips, roots, sizes, at = [], [], [], [], [], 0
        for n, e, s in zip(nodes, ends, sources, strict=True):
            own = np.unique(np.concatenate([n, e, s]).astype(np.int64))
            for out, values in ((listed, n), (tips, e), (roots, s)):
                out.append(np.searchsorted(own, values) + at)
            ids.append(own)
            sizes.append(len(own))
            at += len(own)
        self.ids, self.sizes = np.concatenate(ids), np.array(sizes, dtype=np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.graph = np.repeat(np.arange(len(sizes)), self.sizes)
        self.nodes, self.sources, tip = np.concatenate(listed).astype(np.int64), np.concatenate(roots).astype(np.int64), np.concatenate(tips).astype(np.int64)
        tail, head = np.concatenate([tip[::2], tip[1::2]]), np.concatenate([tip[1::2], tip[::2]])
        order = np.argsort(tail, kind="stable")
        self.tails, self.heads = tail[order], head[order]
        self.counts = np.bincount(tail, minlength=at)
        self.starts = np.cumsum(self.counts) - self.counts
        width = self.sizes[self.graph[self.sources]]
        self.rows = np.cumsum(width) - width  # first pair of a source
        self.pairs = int(width.sum())
        self.shift = self.rows - self.begin[self.graph[self.sources]]  # pair = shift of the source + vertex

    def search(self, sigma: np.ndarray | None = None) -> tuple[np.ndarray, list]:
        """(distance of each pair, -1 without a way; arcs of the shortest ways by distance). With ``sigma``, 1 at each
        source's own pair, also counts the ways."""
        dist, mark = np.full(self.pairs, -1, dtype=np.int32), np.empty(self.pairs, dtype=np.int64)
        at, vertex, d, steps = self.shift + self.sources, self.sources, 0, []
        dist[at] = 0
        while len(at):
            d += 1
            k = self.counts[vertex]
            arc = np.arange(k.sum()) + np.repeat(self.starts[vertex] - (np.cumsum(k) - k), k)
            head = self.heads[arc]
            pair = np.repeat(at - vertex, k) + head
            new = dist[pair] < 0
            head, pair = head[new], pair[new]
            dist[pair] = d
            if sigma is not None and len(pair):
                back = np.repeat(at, k)[new]
                np.add.at(sigma, pair, sigma[back])
                steps.append((back, pair))
            turn = np.arange(len(pair))
            mark[pair] = turn
            once = mark[pair] == turn
            at, vertex = pair[once], head[once]
        return dist, steps

    def labels(self) -> np.ndarray:
        """Smallest vertex of the component of each vertex."""
        label = np.arange(len(self.ids))
        while True:
            low = label.copy()
            np.minimum.at(low, self.heads, label[self.tails])
            np.minimum.at(low, label, low.copy())
            low = low[low]
            if np.array_equal(low, label):
                return label
            label = low

    def owner(self) -> np.ndarray:
        """Place of the source of each pair."""
        return np.repeat(np.arange(len(self.sources)), self.sizes[self.graph[self.sources]])


def solve(packed: DataFrame, keys, columns: str, work: Callable[[Stack], tuple[np.ndarray, dict]]) -> DataFrame:
    """(keys, columns): ``work`` gives the graph of each result row and the values."""
    names, kinds = list(keys), dict(packed.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            weight = [len(s) * (len(n) + len(e) + 1) for n, e, s in zip(batch["nodes"], batch["ends"], batch["sources"], strict=True)]
            stacks = (np.cumsum(weight) // WORK).tolist()
            for _, part in batch.groupby(stacks, sort=False):
                graph, values = work(Stack(part["nodes"], part["ends"], part["sources"]))
                yield pd.DataFrame({k: part[k].take(graph).array for k in names} | values)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in names)
    return packed.mapInPandas(run, f"{schema}, {columns}")


def labels(packed: DataFrame, keys) -> DataFrame:
    def work(s: Stack):
        return s.graph[s.nodes], {"node": s.ids[s.nodes], "label": s.ids[s.labels()[s.nodes]]}

    return solve(packed, keys, "node long, label long", work)


def _counts(s: Stack):
    dist, _ = s.search()
    far = dist > 0
    width = int(dist.max(initial=0)) + 1
    place, cnt = np.unique(s.owner()[far] * width + dist[far], return_counts=True)
    source = place // width
    vertex = s.sources[source]
    return s.graph[vertex], {"source": s.ids[vertex], "d": (place % width).astype(np.int32), "cnt": cnt}


def _sums(s: Stack):
    dist, _ = s.search()
    values = {"node": s.ids[s.sources]}
    for name, part, how in (("reached", dist > 0, np.add), ("total", np.maximum(dist, 0), np.add), ("far", dist, np.maximum)):
        values[name] = how.reduceat(part.astype(np.int64), s.rows) if len(s.rows) else np.zeros(0, np.int64)
    values["far"] = values["far"].astype(np.int32)
    return s.graph[s.sources], values


def _pairs(s: Stack):
    dist, _ = s.search()
    pair = np.flatnonzero(dist >= 0)
    source = s.owner()[pair]
    return s.graph[s.sources[source]], {"source": s.ids[s.sources[source]], "node": s.ids[pair - s.shift[source]], "d": dist[pair]}


class KeyedDistances:
    """``Distances`` of many graphs: small ones packed, larger ones spread."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, *, keys, limit: int = NODES):
        self.keys = tuple(keys)
        self.packed, rest = divide(nodes, edges, keys, sources, limit=limit)
        self.large = Distances(*rest, keys=keys) if rest is not None else None

    def _both(self, name: str, columns: str, work) -> DataFrame:
        parts = [] if self.packed is None else [solve(self.packed, self.keys, columns, work)]
        parts += [] if self.large is None else [getattr(self.large, name)()]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def counts(self) -> DataFrame:
        return self._both("counts", "source long, d int, cnt long", _counts)

    def sums(self) -> DataFrame:
        return self._both("sums", "node long, reached long, total long, far int", _sums)

    def pairs(self) -> DataFrame:
        return self._both("pairs", "source long, node long, d int", _pairs)


def dependencies(packed: DataFrame, keys) -> DataFrame:
    """(keys, node, delta): dependencies of all sources (Brandes), added up by node."""

    def work(s: Stack):
        sigma, got = np.zeros(s.pairs), np.zeros(s.pairs)
        own = s.shift + s.sources
        sigma[own] = 1.0
        _, steps = s.search(sigma)
        for back, pair in reversed(steps):
            np.add.at(got, back, (1.0 + got[pair] * sigma[pair]) / sigma[pair])
        delta = got * sigma
        delta[own] = 0.0
        total = np.bincount(np.arange(s.pairs) - s.shift[s.owner()], weights=delta, minlength=len(s.ids))
        return s.graph[s.nodes], {"node": s.ids[s.nodes], "delta": total[s.nodes]}

    return solve(packed, keys, "node long, delta double", work)


def leading(packed: DataFrame, keys, rounds: int | None = None) -> DataFrame:
    """(keys, node, eigenvector): leading eigenvector of A + I with unit norm, or ``rounds`` power steps from equal entries."""

    def work(s: Stack):
        if rounds is not None:
            loop = np.zeros(len(s.ids))
            loop[s.nodes] = 1.0

            def unit(x):
                return x / np.sqrt(np.bincount(s.graph, weights=x * x, minlength=len(s.sizes)))[s.graph]

            v = unit(loop)
            for _ in range(rounds):
                v = unit(loop * v + np.bincount(s.heads, weights=v[s.tails], minlength=len(v)))
            return s.graph[s.nodes], {"node": s.ids[s.nodes], "eigenvector": v[s.nodes]}
        v = np.empty(len(s.ids))
        for b, n, a, z in zip(s.begin, s.sizes, np.searchsorted(s.tails, s.begin), np.searchsorted(s.tails, s.begin + s.sizes), strict=True):
            m = np.zeros((n, n))
            np.add.at(m, (s.tails[a:z] - b, s.heads[a:z] - b), 1.0)
            values, vectors = np.linalg.eigh(m)
            lead = vectors[:, values >= values[-1] - 1e-9 * max(1.0, abs(values[-1]))]
            x = lead @ lead.sum(axis=0)  # equal entries, projected: where power steps end
            v[b : b + n] = np.abs(x) / np.linalg.norm(x)
        return s.graph[s.nodes], {"node": s.ids[s.nodes], "eigenvector": v[s.nodes]}

    return solve(packed, keys, "node long, eigenvector double", work)
