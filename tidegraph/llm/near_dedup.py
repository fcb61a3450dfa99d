"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum, so 80 permutations make
160 values in 32 bands of 5. Equal shingle sets become one node first. In each bucket of a band every node is compared
with one centre, the least node, never with all others; the sizes of the sets rule a pair out where no
shared part could reach the threshold, the full shingle sets decide the rest. Connected components follow. Buckets whose
nodes are then in one component need nothing more. In the others the nodes with a partner in another component that the
sizes allow meet again with their texts, in blocks, and all pairs across components are compared inside the task: pairs
never become rows, and no link between components is lost to the choice of centres, however large a bucket is. A pair
that shares a bucket is never dropped by an estimate; only a pair of which all 32 bands differ is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.core import cut, cut_counted
from tidegraph.llm.common import filled, scanned, settings, text_of, whole_rows, with_locator

PERMUTATIONS = 80
ROWS = 5
BLOCK = 1024  # nodes of a block at most, on average
BLOCK_SHINGLES = 1 << 20  # and their shingles
BATCH = "256"  # texts handed to Python at once
NODES = 8192  # of a task that makes the rows of buckets, 32 each
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PARTS = 2048
#: Let Spark filter the texts by a Bloom filter of the wanted ids before it shuffles them (its own default waits for 10 GB).
BLOOM = {
    "spark__sql__optimizer__runtime__bloomFilter__enabled": "true",
    "spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold": "64m",
    "spark__sql__optimizer__runtime__bloomFilter__creationSideThreshold": "1g",
}

#: Rows of buckets are small when compressed: partitions merged by that size would sort twice as many rows in a task.
APART = {"spark__sql__adaptive__coalescePartitions__enabled": "false"}

ARROW = {"spark__sql__execution__arrow__maxRecordsPerBatch": BATCH}


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text; A-Z count as a-z."""
    import xxhash

    tokens = text.encode("utf-8", "replace").lower().split()  # bytes: only ASCII letters and white space are looked at
    if not tokens:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    if len(tokens) < words:
        return np.array([digest(b" ".join(tokens), 1)], np.uint64)
    h = np.array([digest(t) for t in tokens], np.uint64)
    n = len(h) - words + 1
    out = np.zeros(n, np.uint64)
    for i in range(words):
        out = _mixed(out + h[i : i + n])
    return np.unique(out)


class MinMax:
    """Signatures of shingle sets: the minimum and the maximum under each permutation."""

    def __init__(self, permutations: int = PERMUTATIONS, rows: int = ROWS):
        self.a, self.b, self.rows = _constants(permutations, 11), _constants(permutations, 13), rows
        self.places = np.arange(2 * permutations // rows, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    def values(self, shingles: np.ndarray) -> np.ndarray:
        least = most = None
        for i in range(0, len(shingles), _PARTS):
            x = np.multiply.outer(self.a, shingles[i : i + _PARTS])
            x += self.b[:, None]
            low, high = x.min(axis=1), x.max(axis=1)
            least = low if least is None else np.minimum(least, low)
            most = high if most is None else np.maximum(most, high)
        return np.concatenate([least, most])

    def bands(self, values: np.ndarray) -> np.ndarray:
        parts = values.reshape(-1, self.rows)
        out = self.places.copy()
        for i in range(self.rows):
            out = _mixed(out + parts[:, i])
        return out.view(np.int64)


def signatures(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, file, row, n_shingles, digest of the set and bands of each row; written once."""
    import xxhash

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashing = MinMax()
        for batch in filled(batches):
            rows = []
            for text in batch["text"]:
                s = shingle_set(text, words)
                if len(s):
                    v = hashing.values(s)
                    rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), hashing.bands(v)))
                else:
                    rows.append((0, None, None))
            out = pd.DataFrame(rows, columns=["n_shingles", "digest", "bands"])
            yield pd.concat([batch[["doc_id", "file", "row"]].reset_index(drop=True), out], axis=1)

    kind = dict(docs.dtypes)[id_col]
    rows = with_locator(docs, F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    schema = f"doc_id {kind}, file string, row long, n_shingles long, digest binary, bands array<long>"
    with settings(docs.sparkSession, **ARROW):
        return cut(rows.mapInPandas(sign, schema))


def _buckets(nodes: DataFrame, count: int) -> DataFrame:
    """node, key: each node once for each band; a task makes the rows of about ``NODES`` nodes, however the files of
    ``nodes`` are packed into tasks."""
    dealt = nodes.select("node", "bands").repartition(max(1, -(-count // NODES)), "node")
    return dealt.select("node", F.explode("bands").alias("key"))


def _centres(buckets: DataFrame) -> DataFrame:
    """key, centre (least node), m (nodes) of each bucket, summed by hash for ids of fixed width: nothing is sorted."""
    return buckets.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("m"))


def _size_matches(pairs: DataFrame, nodes: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs (a, b) whose set sizes do not rule out a similarity of ``threshold``."""
    size = nodes.select("node", "n_shingles")
    both = pairs.join(size.toDF("a", "n_a"), "a").join(size.toDF("b", "n_b"), "b")
    return both.where(F.least("n_a", "n_b") * threshold.denominator >= F.greatest("n_a", "n_b") * threshold.numerator).select("a", "b")


def confirm(docs: DataFrame, pairs: DataFrame, words: int, threshold: Fraction, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Those pairs (a, b) whose full shingle sets have at least the similarity ``threshold``.

    Texts travel once by id and once for each pair. All pairs with one ``a`` meet in order, ``a`` first, at most 256 in
    one key; a text of any length is one row of a sorted stream.
    """
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    salts = F.ceil(F.col("n") / 256).cast("int")
    heads = counts.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    tails = pairs.join(counts, "a").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"))
    roles = cut(heads.unionByName(tails))
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = texts.join(roles.where("salt >= 0"), "id").select("a", "salt", "id", "text").repartition("a", "salt")
    stream = rows.sortWithinPartitions("a", "salt", F.col("id") != F.col("a"))
    top, bottom = threshold.numerator, threshold.denominator

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, heads = None, []
        for batch in filled(batches):
            found = []
            for a, salt, node, text in zip(batch["a"], batch["salt"], batch["id"], batch["text"], strict=True):
                if (a, salt) != key:
                    key, heads = (a, salt), []
                own = shingle_set(text, words)
                if node == a:
                    heads.append(own)
                    continue
                for head in heads:
                    shared = len(np.intersect1d(head, own, assume_unique=True))
                    if shared and bottom * shared >= top * (len(head) + len(own) - shared):
                        found.append((a, node))
                        break
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    kind = dict(docs.dtypes)[id_col]
    with settings(docs.sparkSession, **BLOOM, **ARROW):
        return cut(stream.mapInPandas(compare, f"a {kind}, b {kind}"))


def components(links: DataFrame) -> DataFrame:
    """node, component (least node reachable) of all nodes in ``links`` (a, b).

    Least labels of neighbours and label of the label in turn, until nothing changes; joins on a node with many
    neighbours are split by the adaptive planner, sums are taken before the shuffle.
    """
    edges = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        heard = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(heard.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("component").alias("was"), F.least("component", "m").alias("component")
        )
        lower = cut(lower)
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = lower.join(jump, "component", "left").select("node", "was", F.coalesce("further", "component").alias("component"))
        moved = cut(moved)
        settled = moved.where("component != was").isEmpty()
        labels = moved.select("node", "component")
        if settled:
            return labels


def _keyed_groups(batches: Iterator[pd.DataFrame], held_of) -> Iterator[tuple[tuple, list]]:
    """Runs of rows with one (key, i, j) in a sorted stream; of a row only ``held_of(row)`` is kept."""
    key, held = None, []
    for batch in filled(batches):
        for row in batch.itertuples(index=False):
            if (row.key, row.i, row.j) != key:
                if held:
                    yield key, held
                key, held = (row.key, row.i, row.j), []
            held.append(held_of(row))
    if held:
        yield key, held


class _Member(NamedTuple):
    own: int
    node: object
    component: object
    shingles: np.ndarray


def _sides(rows: list, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    owns = np.array([r.own for r in rows])
    left = np.flatnonzero(owns == i)
    return left, left if i == j else np.flatnonzero(owns == j)


def _open_nodes(members: DataFrame, threshold: Fraction) -> DataFrame:
    """Rows of ``members`` with a node of another component in their bucket that set sizes do not rule out.

    ``members``: key, node, component, n_shingles, m and load (nodes of the bucket, and their shingles). A bucket of more
    than BLOCK nodes or BLOCK_SHINGLES shingles is split into blocks, and each pair of blocks (i, j) is a task's work of
    its own: what a task holds is bounded in bytes, whatever the length of the texts (one text alone may be longer).
    """
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.least(F.col("load") / BLOCK_SHINGLES, F.col("m")))).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(3)), blocks).cast("int")
    spread = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = spread.select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "n_shingles"
    )
    stream = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    top, bottom = threshold.numerator, threshold.denominator

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for (key, i, j), rows in _keyed_groups(batches, lambda row: row):
            comps = np.unique([r.component for r in rows], return_inverse=True)[1]
            sizes, wanted = np.array([r.n_shingles for r in rows]), np.zeros(len(rows), bool)
            left, right = _sides(rows, i, j)
            for k in range(0, len(left), 32):
                part = left[k : k + 32]
                ok = comps[part][:, None] != comps[right][None, :]
                ok &= bottom * np.minimum(sizes[part][:, None], sizes[right]) >= top * np.maximum(sizes[part][:, None], sizes[right])
                wanted[part] |= ok.any(axis=1)
                wanted[right] |= ok.any(axis=0)
            out += [(key, i, j, r.own, r.node, r.component) for r, w in zip(rows, wanted, strict=True) if w]
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["key", "i", "j", "own", "node", "component"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["key", "i", "j", "own", "node", "component"])

    kind = dict(members.dtypes)["node"]
    return stream.mapInPandas(find, f"key long, i int, j int, own int, node {kind}, component {kind}")


def _late_links(docs: DataFrame, rows: DataFrame, words: int, threshold: Fraction, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between components inside the groups of ``rows``, all pairs across components on full shingle sets.

    Pairs stay inside the task; a link that joins two components of a group is given once.
    """
    texts = docs.select(F.col(id_col).alias("node"), text_of(text_col).alias("text"))
    stream = texts.join(rows.where("own >= 0"), "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    top, bottom = threshold.numerator, threshold.denominator

    def links_of(rows: list, i: int, j: int) -> list[tuple]:
        sizes = np.array([len(r.shingles) for r in rows])
        left, right = _sides(rows, i, j)
        right = right[np.argsort(sizes[right], kind="stable")]
        known, ids = np.unique(np.concatenate([r.shingles for r in rows]), return_inverse=True)
        ids = np.split(ids.astype(np.int32), np.cumsum(sizes)[:-1])
        joined, begins = np.concatenate([ids[v] for v in right]), np.append(0, np.cumsum(sizes[right]))
        root = {r.component: r.component for r in rows}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        table, out = np.zeros(len(known), bool), []
        for u in left:
            near = np.flatnonzero((sizes[right] * bottom >= top * sizes[u]) & (sizes[u] * bottom >= top * sizes[right]) & (sizes[right] > 0))
            if not len(near):
                continue
            low, high = near[0], near[-1] + 1  # one range, as ``right`` is in order of size
            table[ids[u]] = True
            shared = np.add.reduceat(table[joined[begins[low] : begins[high]]], begins[low:high] - begins[low], dtype=np.int64)
            table[ids[u]] = False
            union = sizes[u] + sizes[right[low:high]] - shared
            for v in right[low:high][bottom * shared >= top * union]:
                x, y = find(rows[u].component), find(rows[v].component)
                if x != y:
                    root[x] = y
                    out.append((rows[u].node, rows[v].node))
        return out

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def hashed(row) -> _Member:  # the text goes, its shingles stay
            return _Member(row.own, row.node, row.component, shingle_set(row.text, words))

        for (_, i, j), rows in _keyed_groups(batches, hashed):
            if len(rows) > 1 and all(len(s) for s in _sides(rows, i, j)) and (found := links_of(rows, i, j)):
                yield pd.DataFrame(found, columns=["a", "b"])

    kind = dict(docs.dtypes)[id_col]
    with settings(docs.sparkSession, **BLOOM, **ARROW):
        return cut(stream.mapInPandas(link, f"a {kind}, b {kind}"))


def near_groups(
    docs: DataFrame, words: int = 5, threshold: Fraction = Fraction(8, 10), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept, file, row.

    Documents are linked when the similarity of their sets of word shingles is at least ``threshold``; a text with
    fewer words is one shingle. Null, empty and white texts have no shingles and are linked with nothing. Repeated rows
    of one id are one document; a row with a null id is linked with nothing and kept. An empty table gives an empty
    result. Other columns are not looked at.
    """
    docs = scanned(docs)
    rows = signatures(docs, words, id_col, text_col)
    nodes, count = cut_counted(
        rows.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    )
    buckets = _buckets(nodes, count)
    with settings(docs.sparkSession, **APART):
        members = cut(buckets.join(_centres(buckets).where("m > 1"), "key"))

    near_centre = members.where("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    tested = cut(_size_matches(near_centre, nodes, threshold))
    links = confirm(docs, tested, words, threshold, id_col, text_col)
    first = components(links)

    label = F.coalesce("component", "node")
    seen = members.select("key", "node", "m").join(first, "node", "left").select("key", "node", "m", label.alias("component"))
    seen = cut(seen)
    mixed = seen.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    across = cut(seen.join(mixed, "key").join(nodes.select("node", "n_shingles"), "node"))
    across = across.join(across.groupBy("key").agg(F.sum("n_shingles").alias("load")), "key")
    late = _late_links(docs, cut(_open_nodes(across, threshold)), words, threshold, id_col, text_col)
    if not late.isEmpty():
        first = components(links.unionByName(late))

    groups = nodes.select("digest", "node").join(first, "node", "left").select("digest", label.alias("component_id"))
    out = rows.select("doc_id", "file", "row", "n_shingles", "digest").join(groups, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "file", "row"
    )


def near_dedup(docs: DataFrame, words: int = 5, threshold: Fraction = Fraction(8, 10)) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever these are called: of each group those with the
    least id (repeated rows of it all stay).

    Null, empty and white texts and rows with a null id stay: they are linked with nothing. Whole texts of any length are
    compared. An empty table gives an empty result.
    """
    docs = scanned(docs)
    stays = near_groups(docs, words, threshold).where("kept").select(F.col("file").alias("_file"), F.col("row").alias("_row"))
    rows = whole_rows(docs)
    return rows.join(stays, (F.col("file") == F.col("_file")) & (F.col("row") == F.col("_row")), "left_semi").select("_doc.*")
