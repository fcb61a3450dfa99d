"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text is a row of tokens (words and runs of other characters). Features are hashed one- and two-grams of the tokens and
one- to three-grams of their shapes (case, digits, the characters of symbol runs, a token equal to the one before), each with
value sqrt(count / tokens), so a text of any length has the same norm. A score is the sparse dot product with the
weights through the logistic function. Training reads a bounded sample of labelled rows (``sample``), in an order fixed by hash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.core import cut
from tidegraph.llm.common import filled, fold_of, text_of

BITS = 18
SAMPLE = 8192
EPOCHS = 2
TOKEN = re.compile(r"\w+|[^\w\s]+")
CACHE = 1 << 16  # tokens a worker keeps, also through later stages
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(64 - BITS)


def _shape(token: str) -> int:
    if not (token[0].isalnum() or token[0] == "_"):
        return 16 + zlib.crc32(token.encode("utf-8", "replace")) % 1000
    if token.isdigit():
        return 1
    if any(c.isdigit() for c in token):
        return 2
    if len(token) == 1:
        return 3
    if token.isupper():
        return 4
    if token.istitle():
        return 5
    return 6 if token.islower() else 7


class _Tokens(dict):
    """Token to (hash of its lower case, shape) in one number; computed on the first look."""

    def __missing__(self, token: str) -> int:
        if len(self) > CACHE:  # only a cache: nothing is lost
            self.clear()
        value = self[token] = zlib.crc32(token.lower().encode("utf-8", "replace")) << 12 | _shape(token)
        return value


_TOKENS = _Tokens()


def _bucket(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x + np.uint64(seed)) * _MIX
    x ^= x >> np.uint64(29)
    return (x * _MIX >> _TOP).astype(np.int64)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers and their values; both empty for a text without tokens."""
    found = TOKEN.findall(text)
    if not found:
        return np.empty(0, np.int64), np.empty(0)
    packed = np.array([_TOKENS[t] for t in found], np.uint64)
    word, shape = packed >> np.uint64(12), packed & np.uint64(4095)
    shape[1:][word[1:] == word[:-1]] = 9
    step = np.uint64(4099)
    two = shape[1:] * step + shape[:-1]
    parts = [_bucket(word, 1), _bucket(word[1:] * step + word[:-1], 2), _bucket(shape, 3), _bucket(two, 4), _bucket(two[1:] * step + shape[:-2], 5)]
    ids, counts = np.unique(np.concatenate(parts), return_counts=True)
    return ids, np.sqrt(counts / len(found))


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss; the last weight is the intercept."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, ids=slice(None)) -> np.ndarray:
        z, n = self.z[ids], self.n[ids]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, ids: np.ndarray, values: np.ndarray, label: int) -> None:
        ids, values = np.append(ids, 1 << BITS), np.append(values, 1.0)
        w = self.weights(ids)
        gradient = (_logistic(w @ values) - label) * values
        n = self.n[ids]
        self.z[ids] += gradient - (np.sqrt(n + gradient**2) - np.sqrt(n)) / self.alpha * w
        self.n[ids] = n + gradient**2


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def train_quality(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 3, held: int = 1, sample: int = SAMPLE, epochs: int = EPOCHS
) -> np.ndarray:
    """Weights learnt from at most ``sample`` labelled rows outside the held-out fold, those with the least hash of the id.

    Rows with a null label, a null id or a text that ``docs`` lacks are passed over; without any row all weights are 0.
    """
    usable = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id", folds) != held))
    chosen = usable.select("doc_id", (F.col(label_col) > 0).cast("int").alias("label"), F.xxhash64("doc_id").alias("order")).orderBy("order", "doc_id", "label").limit(sample)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(cut(chosen)), "doc_id")  # bounded by sample

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Ftrl()
        for batch in filled(batches):
            for text, label in zip(batch["text"], batch["label"], strict=True):
                model.learn(*features(text), label)
        yield pd.DataFrame({"weights": [model.weights().astype(np.float32).tobytes()]})

    passes = rows.select("text", "label", "order", F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"))
    stream = passes.repartition(1).sortWithinPartitions("epoch", "order", "text").select("text", "label")
    model = cut(stream.mapInPandas(learn, "weights binary")).first()
    return np.frombuffer(bytes(model[0]), np.float32) if model else np.zeros((1 << BITS) + 1, np.float32)


def score_quality(docs: DataFrame, weights: np.ndarray, folds: int = 3, held: int = 1) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts have no features and get the score of the intercept; a null id is not held out; repeated rows
    get equal rows; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2^18 + 1 numbers

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value.astype(np.float64)
        for batch in filled(batches):
            scores = []
            for text in batch["text"]:
                ids, values = features(text)
                scores.append(_logistic(w[ids] @ values + w[-1]))
            out = batch[["doc_id", "held_out"]].copy()
            out["score"] = scores
            out["predicted"] = (out["score"] >= 0.5).astype("int32")
            yield out

    kind = dict(docs.dtypes)["doc_id"]
    held_out = F.coalesce(fold_of("doc_id", folds) == held, F.lit(False))
    return docs.select("doc_id", held_out.alias("held_out"), text_of().alias("text")).mapInPandas(
        score, f"doc_id {kind}, held_out boolean, score double, predicted int"
    )


def keep_good(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The rows of ``docs`` whose score is at least 0.5, with all their columns, whatever these are called; nothing is
    shuffled. Null texts score as empty ones; equal texts are kept or dropped together; whole texts of any length are
    scored. An empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        w = shared.value.astype(np.float64)
        out = []
        for text in texts:
            ids, values = features(text)
            out.append(w[ids] @ values + w[-1] >= 0)
        return pd.Series(out, dtype=bool)

    return docs.where(good(text_of()))
