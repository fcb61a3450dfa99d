"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are dealt to pivots (far apart, from a bounded sample), a pivot's vectors to blocks of bounded size, and each block
becomes a cover tree: a node's children are centres more than the next scale apart, each point goes to the first
centre within the scale, and a node knows its covering radius. Queries get trees of the same kind. For nodes with
centres c, d and radii r, s no inner product exceeds <c,d> + |c| s + |d| r + r s. A first search of each query block in
one block of its own pivot gives every query group a worst kth score; pairs of blocks, then pairs of nodes, whose bound
is below it are pruned. Scores are whole numbers, so the result is exact, ties go to the smaller id.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.core import cut
from tidegraph.llm.common import filled, settings

BLOCK = 2048
QUERY_BLOCK = 512
MOST_PIVOTS = 256
SAMPLE = 2048
LEAF = 64
BASE = 1.3


def whole_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """vec_id and floor(scale * x) of every component; vectors that are null or hold null or non-finite components and rows
    without an id are left out, repeated rows count once."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    scaled = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return table.where(F.col(id_col).isNotNull() & v.isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("v")).dropDuplicates()


def _matrix(vectors, width: int) -> np.ndarray:
    if all(len(x) == width for x in vectors):
        return np.array(list(vectors), np.int64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), np.int64)  # a shorter vector counts as filled up with zeros
    for i, x in enumerate(vectors):
        out[i, : len(x)] = x
    return out


class CoverTree:
    """A cover tree over the rows of ``points``; every node is a contiguous range of ``order``."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.points = points.astype(np.float64)
        self.order: list[int] = []
        self.nodes: list[tuple] = []  # start, end, centre row, radius, children
        if len(ids):
            # the most central point is the root
            middle = self.points.mean(axis=0)
            root = int(np.argmin(((self.points - middle) ** 2).sum(axis=1)))
            self._grow(root, np.arange(len(ids)))
        order = np.array(self.order, int)
        self.ids, self.whole, self.points = ids[order], points[order], self.points[order]
        place = np.empty(len(order), int)
        place[order] = np.arange(len(order))
        self.start, self.end = (np.array([n[i] for n in self.nodes], int) for i in (0, 1))
        self.centre = self.points[place[[n[2] for n in self.nodes]]] if self.nodes else self.points
        self.radius = np.array([n[3] for n in self.nodes])
        self.children = [n[4] for n in self.nodes]
        self.norm = np.sqrt((self.centre**2).sum(axis=1))
        self.order = self.nodes = []

    def _grow(self, centre: int, rows: np.ndarray) -> int:
        me = len(self.nodes)
        far = np.sqrt(((self.points[rows] - self.points[centre]) ** 2).sum(axis=1))
        radius, begin = float(far.max()), len(self.order)
        self.nodes.append(())
        groups = self._split(centre, rows, far, radius)
        if groups is None:
            self.order.extend(rows.tolist())
            children = []
        else:
            children = [self._grow(c, r) for c, r in groups]
        self.nodes[me] = (begin, len(self.order), centre, radius, children)
        return me

    def _split(self, centre: int, rows: np.ndarray, far: np.ndarray, radius: float):
        if len(rows) <= LEAF or radius == 0.0:
            return None
        scale = BASE ** (np.ceil(np.log(radius) / np.log(BASE)) - 1)
        near = far <= scale
        groups, rest = [(centre, rows[near])], rows[~near]
        while len(rest):
            if len(groups) > max(16, len(rows) // 8):  # distances hardly differ: a finer level would be single points
                return None
            new = int(rest[0])
            near = ((self.points[rest] - self.points[new]) ** 2).sum(axis=1) <= scale * scale
            groups.append((new, rest[near]))
            rest = rest[~near]
        return groups if len(groups) > 1 else None


class Best:
    """The k best candidates of each query of a block so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min, np.int64)
        self.id = np.full((n, k), np.iinfo(np.int64).max, np.int64)
        self.full = np.zeros(n, np.int64)
        self.fresh = np.zeros((n, k), bool)  # found by the present search

    def worst(self, begin: int, end: int) -> float:
        """Worst kth score of a range of queries; minus infinity while one has fewer than k."""
        if (self.full[begin:end] < self.k).any():
            return -np.inf
        return float(self.score[begin:end, -1].min())

    def add(self, begin: int, end: int, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        usable = own[:, None] != ids[None, :]
        hopeful = (usable & ((scores >= self.score[begin:end, -1:]) | (self.full[begin:end, None] < self.k))).any(axis=1)
        rows = np.flatnonzero(hopeful)
        if not len(rows):
            return
        low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        s = np.concatenate([self.score[begin + rows], np.where(usable[rows], scores[rows], low)], axis=1)
        i = np.concatenate([self.id[begin + rows], np.where(usable[rows], ids, high)], axis=1)
        f = np.concatenate([self.fresh[begin + rows], usable[rows]], axis=1)
        top = np.lexsort((i, ~s), axis=1)[:, : self.k]  # ~s falls as s rises, without overflow
        self.score[begin + rows], self.id[begin + rows], self.fresh[begin + rows] = (np.take_along_axis(x, top, 1) for x in (s, i, f))
        self.full[begin + rows] = np.minimum(self.k, self.full[begin + rows] + usable[rows].sum(axis=1))


def dual_search(queries: CoverTree, data: CoverTree, best: Best, exact_floats: bool) -> None:
    """Add the best inner products of ``data`` to ``best``, pruning pairs of nodes by their covering radii."""
    if not len(queries.ids) or not len(data.ids):
        return

    def bounds(q, d) -> np.ndarray:
        if not exact_floats:  # sums may wrap around as long sums do: no bound holds
            return np.full(max(np.size(q), np.size(d)), np.inf)
        b = (queries.centre[q] * data.centre[d]).sum(axis=-1) + queries.norm[q] * data.radius[d] + data.norm[d] * queries.radius[q] + queries.radius[q] * data.radius[d]
        return b + 0.5 + 1e-9 * np.abs(b)

    stack = [(0, 0, np.inf)]
    while stack:
        q, d, bound = stack.pop()
        begin, end = queries.start[q], queries.end[q]
        if bound < best.worst(begin, end):
            continue
        below_q, below_d = queries.children[q], data.children[d]
        if not below_q and not below_d:
            own = slice(data.start[d], data.end[d])
            if exact_floats:
                scores = (queries.points[begin:end] @ data.points[own].T).astype(np.int64)
            else:
                scores = queries.whole[begin:end].astype(np.int64) @ data.whole[own].astype(np.int64).T
            best.add(begin, end, scores, data.ids[own], queries.ids[begin:end])
            continue
        if below_q and (not below_d or queries.radius[q] > data.radius[d]):
            pairs, b = [(c, d) for c in below_q], bounds(np.array(below_q), np.array([d]))
        else:
            pairs, b = [(q, c) for c in below_d], bounds(np.array([q]), np.array(below_d))
        for i in np.argsort(b):  # the most hopeful pair is looked at next
            stack.append((*pairs[i], float(b[i])))


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows of the sample far from one another."""
    points = sample.astype(np.float64)
    chosen, far = [0], None
    while len(chosen) < min(n, len(points)):
        d = ((points - points[chosen[-1]]) ** 2).sum(axis=1)
        far = d if far is None else np.minimum(far, d)
        if far.max() == 0:
            break
        chosen.append(int(np.argmax(far)))
    return points[chosen]


def _blocks(vectors: DataFrame, counts: dict[int, int], size: int, width: int) -> DataFrame:
    """One row for each block: pivot, block, tree (pickled), centre, radius."""
    parts = F.element_at(F.array(*[F.lit(max(1, -(-counts.get(p, 0) // size))) for p in range(max(counts, default=0) + 1)]), F.col("pivot") + 1)
    keyed = vectors.withColumn("salt", F.pmod(F.xxhash64("vec_id", "v"), parts).cast("int"))

    def grow(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        whole = _matrix(group["v"].tolist(), width)
        if len(whole) and np.abs(whole).max() < 1 << 15:
            whole = whole.astype(np.int16)
        tree = CoverTree(group["vec_id"].to_numpy(np.int64), whole)
        centre, radius = tree.centre[0].tolist(), float(tree.radius[0])
        keys = [hash(tuple(v)) for v in tree.whole.tolist()]
        tree.points = None  # made anew from the whole numbers
        return pd.DataFrame({"pivot": [int(key[0])], "salt": [int(key[1])], "tree": [pickle.dumps((tree, keys))], "centre": [centre], "radius": [radius]})

    return keyed.groupBy("pivot", "salt").applyInPandas(grow, "pivot int, salt int, tree binary, centre array<double>, radius double")


def _opened(blob: bytes) -> tuple[CoverTree, list[int]]:
    tree, keys = pickle.loads(blob)
    tree.points = tree.whole.astype(np.float64)
    return tree, keys


def top_inner_products(table: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` the ``k`` rows of ``table`` with the highest inner product.

    Vectors null, or with null or non-finite components, and rows with a null id take no part; repeated rows count
    once; a query passes over rows with its own id; a vector shorter than the longest counts as filled up with zeros;
    a query without any candidate has no rows; an empty table gives an empty result. Products beyond 2^53 are summed
    as long numbers (they wrap around), then without pruning.
    """
    spark = table.sparkSession
    data, asked = cut(whole_vectors(table, id_col, vector_col, scale)), cut(whole_vectors(queries, id_col, vector_col, scale))
    width, largest = data.unionByName(asked).agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.when(x < 0, -(x + 1)).otherwise(x))))).first()
    width, n_queries = width or 0, asked.count()
    exact = max(1, width) * (float(largest or 0) + 1) ** 2 < 2.0**53
    some = data.orderBy(F.xxhash64("v"), "vec_id").limit(SAMPLE).toPandas()
    pivots = _pivots(_matrix(some["v"].tolist(), width), min(MOST_PIVOTS, max(1, -(-n_queries // QUERY_BLOCK)))) if len(some) else np.zeros((1, width))
    shared = spark.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS vectors

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for batch in filled(batches):
            x = _matrix(batch["v"].tolist(), width).astype(np.float64)
            near = np.argmin((p**2).sum(axis=1)[None, :] - 2 * x @ p.T, axis=1) if len(x) else []
            yield batch.assign(pivot=np.array(near, np.int32))

    def dealt(vectors: DataFrame) -> tuple[DataFrame, dict[int, int]]:
        out = cut(vectors.mapInPandas(deal, "vec_id long, v array<long>, pivot int"))
        return out, {r["pivot"]: r["count"] for r in out.groupBy("pivot").count().collect()}  # a row for each pivot

    def searched(pairs: DataFrame) -> DataFrame:
        """Search each pair of blocks; with the least kth score of the query block, and all results."""

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in filled(batches):
                for row in batch.itertuples(index=False):
                    (q, keys), (d, _) = _opened(row.tree), _opened(row.data_tree)
                    best = Best(len(q.ids), k) if row.best is None else pickle.loads(row.best)
                    best.fresh[:] = False  # what the first search found is there already
                    dual_search(q, d, best, exact)
                    i, j = np.nonzero(best.fresh)
                    yield pd.DataFrame({
                        "pivot": row.pivot, "salt": row.salt, "worst": best.worst(0, len(q.ids)), "best": [pickle.dumps(best) if row.best is None else None],
                        "query_id": [q.ids[i].tolist()], "query_key": [[keys[x] for x in i]], "vec_id": [best.id[i, j].tolist()], "score": [best.score[i, j].tolist()],
                    })

        schema = "pivot int, salt int, worst double, best binary, query_id array<long>, query_key array<long>, vec_id array<long>, score array<long>"
        return pairs.mapInPandas(search, schema)

    data, data_counts = dealt(data)
    asked, asked_counts = dealt(asked)
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="4"):  # a row is a whole block here
        trees = cut(_blocks(data, data_counts, BLOCK, width))
        groups = cut(_blocks(asked, asked_counts, QUERY_BLOCK, width))
        home = trees.where("salt = 0").select("pivot", F.col("tree").alias("data_tree"))
        first = groups.join(home, "pivot", "left").where("data_tree IS NOT NULL").withColumn("best", F.lit(None).cast("binary"))
        first = cut(searched(first.repartition("pivot", "salt")))
        state = groups.select("pivot", "salt", "centre", "radius").join(first.select("pivot", "salt", "worst"), ["pivot", "salt"], "left")
        far = trees.select(F.col("pivot").alias("p"), F.col("salt").alias("s"), F.col("centre").alias("c"), F.col("radius").alias("r"))

        def dot(a: str, b: str):
            return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)

        bound = dot("centre", "c") + F.sqrt(dot("centre", "centre")) * F.col("r") + F.sqrt(dot("c", "c")) * F.col("radius") + F.col("radius") * F.col("r")
        other = ~((F.col("p") == F.col("pivot")) & (F.col("s") == 0))
        hopeful = (F.lit(not exact) | F.col("worst").isNull() | (bound + 0.5 + 1e-9 * F.abs(bound) >= F.col("worst")))
        # the stated queries against all rows, block by block
        pairs = cut(state.join(far, other & hopeful).select("pivot", "salt", "p", "s"))
        rest = (
            pairs.join(groups.select("pivot", "salt", "tree"), ["pivot", "salt"])
            .join(first.select("pivot", "salt", "best"), ["pivot", "salt"], "left")
            .join(trees.select(F.col("pivot").alias("p"), F.col("salt").alias("s"), F.col("tree").alias("data_tree")), ["p", "s"])
        )
        # a pair searched without a first result still starts from an empty list
        rest = cut(searched(rest.select("pivot", "salt", "tree", "data_tree", "best").repartition(F.xxhash64("p", "s", "pivot", "salt"))))
    found = first.drop("best").unionByName(rest.drop("best"))
    rows = found.select(F.explode(F.arrays_zip("query_id", "query_key", "vec_id", "score")).alias("x")).select("x.*")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
