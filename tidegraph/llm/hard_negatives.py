"""Hard negatives by segment summaries.

A vector is stored with the mean and the deviation of each of its segments, at several widths. Over a segment of width w
the inner product of two vectors is w times the product of the means, give or take w times the product of the
deviations, so summaries alone bound a score from both sides. A block of vectors meets a block of anchors in one task:
coarse segments first; vectors whose upper bound is below the kth lower bound, or whose bounds lie outside the wanted
range, are dropped; the others are bounded by finer segments, and only what is left is scored exactly.

Anchors are a stated set that meets all rows in blocks; each task gives back its k best for each anchor.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.core import cut
from tidegraph.llm.common import filled, settings

BLOCK = 32_768
ANCHORS = 1024
TILE = 32
FINEST = 4  # width of the finest segments


def labelled_vectors(table: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """at (a number for each row), vec_id, label, v (floor(scale * x) of each component), written once.

    Rows with a null id or label, a null vector or a null or non-finite component are left out. Repeated rows stay, each
    a row of its own.
    """
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    scaled = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    rows = table.where(F.col(id_col).isNotNull() & v.isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), scaled.alias("v"))
    return cut(rows.where("label IS NOT NULL").select(F.monotonically_increasing_id().alias("at"), "vec_id", "label", "v"))


class Summaries:
    """Vectors in rows, with means and deviations of their segments from coarse to fine."""

    def __init__(self, whole: np.ndarray):
        n, width = whole.shape
        padded = -(-max(width, 1) // FINEST) * FINEST
        while padded & (padded - 1):  # up to a power of two, so that segments halve and halve again
            padded += padded & -padded
        full = np.zeros((n, padded))
        full[:, :width] = whole
        self.levels, segments = [], 1
        while padded // segments >= FINEST:
            parts = full.reshape(n, segments, padded // segments)
            self.levels.append((padded // segments, parts.mean(axis=2), parts.std(axis=2)))
            segments *= 4

    def take(self, rows) -> list[tuple]:
        return [(w, m[rows], d[rows]) for w, m, d in self.levels]


class Wanted:
    """For each anchor of a tile the ranges of scores to fill, each with its k best."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k  # anchors x ranges

    def hopeful(self, lower: np.ndarray, upper: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """Pairs of anchor and vector that some range may still take, given bounds of their scores."""
        out = np.zeros(allowed.shape, bool)
        for j in range(self.low.shape[1]):
            low, high = self.low[:, j, None], self.high[:, j, None]
            some = allowed & (upper >= low) & (lower <= high)
            if allowed.shape[1] > self.k:
                sure = np.where(some & (lower >= low) & (upper <= high), lower, -np.inf)
                kth = np.partition(sure, -self.k, axis=1)[:, -self.k]
                some &= upper >= kth[:, None]
            out |= some
        return out

    def best(self, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(anchor, range, columns of its k best)"""
        for j in range(self.low.shape[1]):
            fits = allowed & (scores >= self.low[:, j, None]) & (scores <= self.high[:, j, None])
            for a in np.flatnonzero(fits.any(axis=1)):
                columns = np.flatnonzero(fits[a])
                own = scores[a, columns]
                if len(columns) > self.k:
                    keep = own >= np.partition(own, -self.k)[-self.k]
                    columns, own = columns[keep], own[keep]
                yield int(a), j, columns[np.lexsort((ids[columns], -own))[: self.k]]


class Block:
    """Rows of one block in order of label."""

    def __init__(self, rows: pd.DataFrame, width: int):
        rows = rows.sort_values(["label", "vec_id", "at"], kind="stable")
        self.at, self.ids, self.labels = (rows[c].to_numpy(np.int64) for c in ("at", "vec_id", "label"))
        whole = np.zeros((len(rows), width), np.int64)  # a shorter vector counts as filled up with zeros
        for i, v in enumerate(rows["v"]):
            whole[i, : len(v)] = v
        self.whole = whole.astype(np.int16) if not len(whole) or np.abs(whole).max() < 1 << 15 else whole
        self.summaries = Summaries(self.whole)
        self.ranges = list(zip(rows["lows"], rows["highs"], strict=True)) if "lows" in rows else None

    def label_runs(self) -> Iterator[tuple[int, int, int]]:
        """label, first row, row behind the last, at most TILE rows a run."""
        edges = np.flatnonzero(np.diff(self.labels)) + 1
        for begin, end in zip(np.append(0, edges), np.append(edges, len(self.labels)), strict=True):
            for i in range(begin, end, TILE):
                yield int(self.labels[i]), i, min(i + TILE, int(end))


class Search:
    """Anchors of a block against the rows of another."""

    def __init__(self, k: int, same: bool, exact: bool):
        self.k, self.same, self.exact = k, same, exact
        self.scored = self.pairs = 0

    def tile(self, anchors: Block, rows: slice, wanted: Wanted, data: Block, columns: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(anchor, range, rows of data, scores) of one tile."""
        allowed = anchors.at[rows, None] != data.at[columns]
        self.pairs += allowed.size
        if self.exact:
            for (w, m, d), (_, means, deviations) in zip(anchors.summaries.take(rows), data.summaries.levels, strict=True):
                middle, give = w * (m @ means[columns].T), w * (d @ deviations[columns].T)
                give = give + 0.5 + 1e-9 * (np.abs(middle) + give)
                left = wanted.hopeful(middle - give, middle + give, allowed).any(axis=0)
                if not left.all():
                    columns, allowed = columns[left], allowed[:, left]
                if not len(columns):
                    return
            scores = anchors.whole[rows].astype(np.float64) @ data.whole[columns].astype(np.float64).T
        else:  # sums may wrap around as long sums do: no bound holds
            scores = anchors.whole[rows].astype(np.int64) @ data.whole[columns].astype(np.int64).T
        self.scored += scores.size
        for a, j, best in wanted.best(scores, allowed, data.ids[columns]):
            yield a, j, columns[best], scores[a, best]

    def found(self, anchors: Block, data: Block) -> pd.DataFrame:
        out = []
        for label, begin, end in anchors.label_runs():
            first, last = np.searchsorted(data.labels, label), np.searchsorted(data.labels, label, "right")
            columns = np.arange(first, last) if self.same else np.append(np.arange(first), np.arange(last, len(data.labels)))
            if not len(columns):
                continue
            if anchors.ranges is None:
                shape = (end - begin, 1)
                wanted = Wanted(np.full(shape, -np.inf), np.full(shape, np.inf), self.k)
            else:
                own = anchors.ranges[begin:end]
                low, high = (np.full((end - begin, max(len(lows) for lows, _ in own)), f) for f in (np.inf, -np.inf))
                for i, (lows, highs) in enumerate(own):
                    low[i, : len(lows)], high[i, : len(highs)] = lows, highs
                wanted = Wanted(low, high, self.k)
            for a, j, rows, scores in self.tile(anchors, slice(begin, end), wanted, data, columns):
                out.append((np.full(len(rows), anchors.at[begin + a]), np.full(len(rows), j), data.at[rows], data.ids[rows], scores.astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[]] * 5
        return pd.DataFrame(dict(zip(("at", "place", "other", "vec_id", "score"), columns, strict=True)))


def _packed(rows: DataFrame, blocks: int, width: int) -> DataFrame:
    """block and its pickled ``Block``; at most as many rows a block as even dealing gives."""
    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "blob": [pickle.dumps(Block(group, width), protocol=5)]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("at"), F.lit(blocks)).cast("int"))
    return cut(dealt.groupBy("block").applyInPandas(pack, "block int, blob binary"))


def _searched(data: DataFrame, anchors: DataFrame, k: int, same: bool, exact: bool) -> DataFrame:
    """at, place, other, vec_id, score: the k best of every anchor and range in all blocks of ``data``.

    ``anchors`` meets each block of data as a stream behind it, one block at a time.
    """
    last = anchors.agg(F.max("block")).first()[0] or 0
    visits = data.select(F.col("block").alias("place"), F.explode(F.sequence(F.lit(0), F.lit(last))).alias("block"))
    stream = data.select(F.col("block").alias("place"), F.lit(-1).alias("block"), "blob").unionByName(visits.join(anchors, "block").select("place", "block", "blob"))
    stream = stream.repartition("place").sortWithinPartitions("place", "block")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = None
        for batch in filled(batches):
            for row in batch.itertuples(index=False):
                block = pickle.loads(row.blob)
                if row.block < 0:
                    here = block
                    continue
                yield Search(k, same, exact).found(block, here)

    with settings(data.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="2"):  # a row is a whole block here
        found = stream.mapInPandas(search, "at long, place int, other long, vec_id long, score long")
        order = Window.partitionBy("at", "place").orderBy(F.desc("score"), "vec_id", "other")
        return cut(found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k))


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, ratio: tuple[int, int] = (80, 100), block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: see ``labelled_vectors``; ``anchors``: which of them are anchors. An anchor's positives are the best
    ``positives`` other rows of its label; to each belong the best ``negatives`` rows of other labels that score at
    least ratio[0]/ratio[1] of the positive's score, and no more than it. Equal scores go to the smaller id. A repeated
    row is a row of its own, also beside the anchor. An anchor without positives, or a positive without negatives, gives
    no rows, and so does an empty table. A vector shorter than the longest counts as filled up with zeros. Products
    beyond 2^53 are summed as long numbers (they wrap around), then without bounds.
    """
    spark = rows.sparkSession
    largest = F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.when(x < 0, -(x + 1)).otherwise(x))))
    count, width, largest, asked = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), largest, F.count(F.when(anchors, 1))).first()
    width = width or 0
    exact = max(1, width) * (float(largest or 0) + 1) ** 2 < 2.0**53
    blocks = max(1, -(-count // block), min(spark.sparkContext.defaultParallelism, -(-count // 1024)))
    chosen = rows.where(anchors)
    asked_blocks = -(-max(asked, 1) // ANCHORS)
    data = _packed(rows, blocks, width)
    near = _searched(data, _packed(chosen, asked_blocks, width), positives, True, exact)
    near = near.select("at", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    low, high = F.ceil(F.col("positive_score") * ratio[0] / ratio[1]).cast("double"), F.col("positive_score").cast("double")
    ranges = near.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("place", low.alias("low"), high.alias("high")))).alias("r"))  # at most ``positives``
    again = chosen.join(ranges.select("at", F.col("r.low").alias("lows"), F.col("r.high").alias("highs")), "at")
    far = _searched(data, _packed(again, asked_blocks, width), negatives, False, exact)
    names = chosen.select("at", F.col("vec_id").alias("anchor_id"))
    pairs = near.join(far, ["at", "place"]).join(names, "at")
    return pairs.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
