"""Log-likelihood of whole documents under a gated recurrent language model, and under smoothed unigrams.

Word counts cover all training documents. The most frequent words (at most ``MODEL_WORDS``) are the model's; any other
word is the model's unknown word times its share in the smoothed unigrams, so every text has a proper probability. Training
is local steps with averaging: in each round every partition of a part of the training documents starts from the same
weights and takes truncated backpropagation steps on every window of 32 words of every document (the state is carried from
window to window, gradients are not), then the weights are averaged by Spark, by trained words. Scoring carries the state
across the windows of a document to its end in the same way.
Counts of the ``HEAD`` most frequent words go to the workers; rarer words are joined with the counts by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.core import cut
from tidegraph.llm.common import filled, fold_of, text_of
from tidegraph.llm.gru import HIDDEN, WINDOW, Gru, word_classes

HEAD = 150_000
MODEL_WORDS = 4095
CLASSES = 64
ROUNDS = 2
TRAIN_ROWS = 128
SCORE_ROWS = 4096
PIECE = 16_384
GROUP = 16
RATE = 0.01
END = ""  # no word is empty, so the empty string stands for the end of a text


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()  # bytes: only ASCII letters and white space are looked at


def _split(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts laid end to end, and the text each belongs to: bytes are compared, as ``words_of`` does."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text))
    words = lists.flatten()
    owner = np.repeat(np.arange(len(text)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    real = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty piece
    return words.filter(real), owner[real.to_numpy(zero_copy_only=False)]


def word_counts(train: DataFrame) -> DataFrame:
    """word, c over all texts of ``train``; each text ends with END."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:  # sums of a batch: Spark adds them up
                found = pc.value_counts(_split(batch.column(0))[0])
                words, counts = found.field("values"), found.field("counts")
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([END])]), pa.concat_arrays([counts, pa.array([batch.num_rows])])], ["word", "c"])

    return cut(train.select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")))


class Vocabulary:
    """Counts of the head words, and their numbers in the model (0: unknown)."""

    def __init__(self, words: list[str], counts: list[int], total: int, distinct: int):
        self.total, self.floor = total, total + 0.5 * (distinct + 1)
        share = (np.array(counts, float) + 0.5) / self.floor
        self.base = np.append(np.log10(share), np.log10(0.5 / self.floor))  # last: a word never seen
        n = min(len(words), MODEL_WORDS)
        rest = max(1e-12, 1 - share[:n].sum())
        self.rest = float(np.log10(rest))
        mass = np.append(share[:n], rest)
        order = np.argsort(-mass, kind="stable")
        number = np.empty(n + 1, np.int64)
        number[order] = np.arange(n + 1)
        self.mass = mass[order]
        cls = word_classes(self.mass, CLASSES)
        self.bounds = np.append(np.searchsorted(cls, np.arange(cls.max() + 1)), n + 1)
        self.unknown = int(number[n])
        self.model = np.full(len(words) + 1, self.unknown, np.int64)
        self.model[:n] = number[:n]
        self.words = words
        self.end = words.index(END) if END in words else -1

    def new_model(self) -> Gru:
        return Gru(self.mass, self.bounds)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The head: the HEAD most frequent words, and the end. Whole bins of counts (a 32nd of a power of two wide) from the
    highest on, as long as they fit; of the first bin that doesn't, words in order of their hash."""
    total, distinct = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    step = F.floor(F.log2("c") * 32).cast("int")
    bins = sorted(((r["step"], r["n"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, room = 1 << 30, HEAD
    for at, n in bins:  # at most 32 x 63 bins
        if n > room:
            break
        least, room = at, room - n
    head = counts.where((step >= least) | (F.col("word") == END))
    if least == 1 << 30:  # one bin holds more words than the head
        head = head.unionByName(counts.where(F.col("word") != END).where(step == (bins[0][0] if bins else 0)).orderBy(F.xxhash64("word"), "word").limit(HEAD))
    table = head.toPandas().sort_values(["c", "word"], ascending=[False, True])
    return Vocabulary(table["word"].tolist(), table["c"].tolist(), total or 0, distinct)


class Rows:
    """Rows of model words laid end to end, longest first, and windows of them as step by row."""

    def __init__(self, rows: list[np.ndarray], first: int):
        self.order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
        self.lengths = np.array([len(rows[i]) for i in self.order])
        self.flat = np.concatenate([rows[i] for i in self.order]).astype(np.int32)
        self.offsets = np.append(0, np.cumsum(self.lengths)[:-1])
        self.first = first

    def longer(self, begin: int) -> int:
        return int(np.searchsorted(-self.lengths, -begin))

    def window(self, begin: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Words begin .. begin + WINDOW of the first ``n`` rows, and which of them are words."""
        t = begin + np.arange(WINDOW)[:, None]
        real = (t >= 0) & (t < self.lengths[:n])
        return np.where(real, self.flat[np.where(real, self.offsets[:n] + t, 0)], self.first), real


def learn_rows(model: Gru, rows: list[np.ndarray], first: int, rate: float) -> int:
    """A step on each window of ``rows``, the state carried over all windows of a row; words trained."""
    part, trained = Rows(rows, first), 0
    state = np.zeros((len(rows), HIDDEN), np.float32)
    for begin in range(0, int(part.lengths[0]), WINDOW):
        n = part.longer(begin)
        target, real = part.window(begin, n)
        state = model.learn(part.window(begin - 1, n)[0], target, real, state[:n], rate)
        trained += int(real.sum())
    return trained


def encoded(docs: DataFrame, vocab: Vocabulary, *keep: str) -> DataFrame:
    """``keep`` and, for each text, its model words (``codes``, packed), counts, the base score of its head words, what the
    model adds for unknown ones (``extra``) and the words that are not in the head; written once, read by every later step."""
    words = docs.sparkSession.sparkContext.broadcast(vocab)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = words.value
        head = pa.array(v.words, pa.string())
        # an end never seen in training counts as a word never seen
        known_end, end_score, end_code = (1, v.base[v.end], v.model[v.end]) if v.end >= 0 else (0, v.base[-1], v.unknown)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            found, owner = _split(batch.column("text"))
            place = pc.fill_null(pc.index_in(found, value_set=head), -1).to_numpy(zero_copy_only=False)
            model, met = v.model[place], place >= 0
            length = np.bincount(owner, minlength=n) + 1
            begins = np.append(0, np.cumsum(length))
            codes = np.empty(begins[-1], np.int16)
            codes[begins[1:] - 1] = end_code
            codes[np.arange(len(model)) + owner] = model
            unknown = model == v.unknown
            score = np.where(met, v.base[place], 0.0)
            extra = np.bincount(owner, np.where(unknown, score - v.rest, 0.0), minlength=n) + (end_score - v.rest if end_code == v.unknown else 0.0)
            tail = ~met
            ends = np.append(0, np.cumsum(np.bincount(owner[tail], minlength=n))).astype(np.int32)
            columns = {
                "codes": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * begins).astype(np.int32)), pa.py_buffer(codes)]),
                "n_tokens": pa.array(length), "known": pa.array(np.bincount(owner[met], minlength=n) + known_end),
                "base": pa.array(np.bincount(owner, score, minlength=n) + end_score), "extra": pa.array(extra),
                "tail": pa.ListArray.from_arrays(pa.array(ends), found.filter(pa.array(tail))),
            }
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(kept + list(columns.values()), [*keep, *columns])

    kinds = dict(docs.dtypes)
    schema = "".join(f"{c} {kinds[c]}, " for c in keep) + "codes binary, n_tokens long, known long, base double, extra double, tail array<string>"
    return cut(docs.select(*keep, "text").mapInArrow(encode, schema))


def _rows_of(codes: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int16) for x in codes]


def mean_weights(models: DataFrame) -> np.ndarray | None:
    """Mean of the rows (weights: packed, n: weight of the row). Sums are taken in groups of ``GROUP`` until one group
    is left; None without rows."""

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(w, np.float64) for w in group["weights"])
        return pd.DataFrame({"weights": [total.tobytes()], "n": [int(group["n"].sum())]})

    sums = cut(models)
    while (rows := sums.count()) > GROUP:
        part = F.pmod(F.xxhash64("n", "weights"), F.lit(-(-rows * 2 // GROUP))).alias("part")
        sums = cut(sums.groupBy(part).applyInPandas(add, "weights binary, n long"))
    table = sums.toPandas()  # at most GROUP models
    return sum(np.frombuffer(w, np.float64) for w in table["weights"]) / table["n"].sum() if len(table) else None


def train_encoded(train: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the model after ``rounds`` rounds, each over its own part of ``train`` (columns doc_id, codes)."""
    sc = train.sparkSession.sparkContext
    words = sc.broadcast(vocab)
    weights = vocab.new_model().flat()
    for turn in range(rounds):
        start = sc.broadcast(weights)
        rate = RATE * (1 - 0.5 * turn / rounds)

        def learn(batches: Iterator[pd.DataFrame], start=start, rate=rate) -> Iterator[pd.DataFrame]:
            v = words.value
            model, trained = v.new_model().load(start.value), 0
            first = int(v.model[v.end])
            for batch in filled(batches):
                rows = sorted(_rows_of(batch["codes"]), key=len, reverse=True)
                for k in range(0, len(rows), TRAIN_ROWS):
                    trained += learn_rows(model, rows[k : k + TRAIN_ROWS], first, rate)
            if trained:
                yield pd.DataFrame({"weights": [(model.flat().astype(np.float64) * trained).tobytes()], "n": [trained]})

        mine = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == turn).select("codes")
        mean = mean_weights(mine.mapInPandas(learn, "weights binary, n long"))
        weights = weights if mean is None else mean.astype(np.float32)
    return weights


def train_model(train: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """``train_encoded`` of texts (columns doc_id, text)."""
    return train_encoded(encoded(train, vocab, "doc_id"), vocab, rounds)


def document_log_probs(model: Gru, gates: np.ndarray, rows: list[np.ndarray], first: int) -> np.ndarray:
    """Natural log-probability of each row of model words, the state carried over all windows of the row."""
    packed = Rows(rows, first)
    total = np.zeros(len(rows))
    state = np.zeros((len(rows), model.hidden), np.float32)
    held: list[tuple] = []

    def add() -> None:
        if held:
            states, words, owner = (np.concatenate(x) for x in zip(*held, strict=True))
            for k in range(0, len(words), PIECE):
                part = slice(k, k + PIECE)
                total[:] += np.bincount(owner[part], model.log_prob(states[part], words[part]), minlength=len(total))
            held.clear()

    waiting = 0
    for begin in range(0, int(packed.lengths[0]), WINDOW):
        n = packed.longer(begin)
        target, real = packed.window(begin, n)
        states, state = model.forward(gates[packed.window(begin - 1, n)[0]], state[:n])
        t, i = np.nonzero(real)
        held.append((states[t, i], target[t, i], i))
        waiting += len(t)
        if waiting >= PIECE:
            add()
            waiting = 0
    add()
    out = np.empty(len(rows))
    out[packed.order] = total
    return out


def score_documents(docs: DataFrame, folds: int = 5, held: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are one token, the end. Null ids are neither held out nor learnt from. Repeated rows get equal
    rows. When nothing can be learnt from, every word is unknown with probability 1 (both scores 0). Other columns are
    not looked at.
    """
    fold = fold_of(id_col, folds)
    base = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(fold == held, F.lit(False)).alias("held_out"),
        (fold != held).alias("train"), text_of(text_col).alias("text"),
    )
    counts = word_counts(base.where("train"))
    vocab = vocabulary(counts)
    rows = encoded(base, vocab, "row", "doc_id", "held_out", "train")
    sc = docs.sparkSession.sparkContext
    words, trained = sc.broadcast(vocab), sc.broadcast(train_encoded(rows.where("train"), vocab))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = words.value
        model = v.new_model().load(trained.value)
        gates, first = model.projected(), int(v.model[v.end])
        for batch in filled(batches):
            codes = _rows_of(batch.pop("codes"))
            logs = [document_log_probs(model, gates, codes[k : k + SCORE_ROWS], first) for k in range(0, len(codes), SCORE_ROWS)]
            batch["model"] = np.concatenate(logs) / np.log(10) + batch.pop("extra")
            yield batch

    kind = dict(docs.dtypes)[id_col]
    kept = ("row", "doc_id", "held_out", "n_tokens", "known", "base")
    scored = rows.select(*kept, "extra", "codes").mapInPandas(score, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, model double")
    tail = rows.select("row", F.explode("tail").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("n"))
    floor = F.lit(float(vocab.floor))
    met = tail.join(counts, "word", "left").select(
        "row", F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).alias("k"), (F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / floor)).alias("s")
    )
    sums = met.groupBy("row").agg(F.sum("k").alias("k"), F.sum("s").alias("s"))
    more = F.coalesce("s", F.lit(0.0))
    return scored.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"),
    )
