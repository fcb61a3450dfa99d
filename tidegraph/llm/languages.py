"""Language of a text by multilingual mixture inference.

Each language has a distribution over hashed character one- to three-grams. A document is a mixture of languages; its
proportions are estimated by expectation-maximisation on its n-gram counts. The set of languages grows from the best
single one, as long as the gain in log-likelihood is above a penalty in the document's length. The language with the
largest proportion is the prediction, its proportion the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.core import cut
from tidegraph.llm.common import filled, fold_of, text_of

BITS = 15
PER_LANGUAGE = 2000
STEPS = 15
_P = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917)]


def _letters() -> np.ndarray:
    flags = np.zeros(0x110000, bool)
    flags[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return flags


_LETTER: list[np.ndarray] = []


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram numbers of a whole text and their counts; both empty for a text without letters."""
    if not _LETTER:
        _LETTER.append(_letters())
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _LETTER[0][codes]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0)
    codes = np.where(letter, codes, np.uint32(32))
    keep = np.ones(len(codes), bool)
    keep[1:] = letter[1:] | letter[:-1]
    c = np.concatenate([[np.uint32(32)], codes[keep], [np.uint32(32)]]).astype(np.uint32)
    shift = np.uint32(32 - BITS)
    one = (c * _P[0]) ^ np.uint32(1)
    two = (c[1:] * _P[1]) ^ one[:-1] * _P[2]
    three = (c[2:] * _P[0] + np.uint32(7)) ^ two[:-1] * _P[1]
    ids = np.concatenate([(x * _P[0]) >> shift for x in (one, two, three)])
    counts = np.bincount(ids, minlength=1 << BITS)
    found = np.flatnonzero(counts)
    return found, counts[found].astype(np.float64)


def _fit(p: np.ndarray, n: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the columns of ``p`` by expectation-maximisation, and the log-likelihood."""
    total, share = n.sum(), start
    for _ in range(STEPS):
        mixed = p @ share
        share = share * (p.T @ (n / mixed)) / total
    return share, float(n @ np.log(p @ share))


def mixture(p: np.ndarray, n: np.ndarray, penalty: float = 1.5) -> dict[int, float]:
    """Proportions of the chosen languages. ``p``: n-gram by language, ``n``: counts."""
    single = n @ np.log(p)
    chosen = [int(np.argmax(single))]
    share, best = np.ones(1), float(single[chosen[0]])
    price = penalty * 3 * np.log(n.sum() + 1)  # overlapping n-grams count each letter three times
    while len(chosen) < p.shape[1]:
        # slope of the log-likelihood towards each language: no gain can be larger, as it is concave
        slope = p.T @ (n / (p[:, chosen] @ share)) - n.sum()
        slope[chosen] = -np.inf
        new = int(np.argmax(slope))
        if slope[new] <= price:
            break
        wider, value = _fit(p[:, [*chosen, new]], n, np.append(share * 0.8, 0.2))
        if value - best <= price:
            break
        chosen, share, best = [*chosen, new], wider, value
    return dict(zip(chosen, share / share.sum(), strict=True))


def train_languages(docs: DataFrame, folds: int = 3, held: int = 1, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and their n-gram probabilities (language by n-gram), learnt outside the held-out fold.

    Of each language about ``per_language`` documents are read, those with a hash of the id below a bound that its
    number of documents sets. Null ids, null languages and texts without letters are passed over.
    """
    usable = docs.where(F.col("lang").isNotNull() & (fold_of("doc_id", folds) != held)).select("doc_id", F.col("lang").cast("string").alias("lang"), text_of().alias("text"))
    sizes = cut(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.join(F.broadcast(sizes), "lang").where(unit < per_language / F.col("n")).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in filled(batches):
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                ids, n = ngrams(text)
                if len(ids):
                    sums.setdefault(lang, np.zeros(1 << BITS))[ids] += n
        for lang, n in sums.items():
            ids = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "gram": ids.astype("int32"), "n": n[ids].astype("int64")})

    counts = cut(sample.mapInPandas(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    table = counts.toPandas()  # languages x 2^15 numbers at most
    langs = sorted(table["lang"].unique())
    dense = np.full((len(langs), 1 << BITS), 0.05)
    for i, lang in enumerate(langs):
        own = table[table["lang"] == lang]
        dense[i, own["gram"].to_numpy()] += own["n"].to_numpy()
    return langs, (dense / dense.sum(axis=1, keepdims=True)).astype(np.float32)


def predict_languages(docs: DataFrame, langs: list[str], probabilities: np.ndarray, folds: int = 3, held: int = 1) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score, languages (the chosen set, by share).

    A null or empty text, one without a letter, or any text when nothing was learnt gets ``und`` with score 0. A null
    id is not held out; repeated rows get equal rows; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast((langs, np.ascontiguousarray(probabilities.T)))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, p = shared.value
        for batch in filled(batches):
            rows = []
            for text in batch["text"]:
                ids, n = ngrams(text)
                if not len(ids) or not names:
                    rows.append(("und", 0.0, ""))
                    continue
                share = mixture(p[ids].astype(np.float64), n)
                order = sorted(share, key=lambda i: (-share[i], i))
                rows.append((names[order[0]], min(1.0, float(share[order[0]])), ",".join(f"{names[i]}:{share[i]:.3f}" for i in order)))
            out = pd.DataFrame(rows, columns=["lang_pred", "score", "languages"])
            out.insert(0, "held_out", batch["held_out"].to_numpy())
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    kind = dict(docs.dtypes)["doc_id"]
    held_out = F.coalesce(fold_of("doc_id", folds) == held, F.lit(False))
    return docs.select("doc_id", held_out.alias("held_out"), text_of().alias("text")).mapInPandas(
        predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double, languages string"
    )
