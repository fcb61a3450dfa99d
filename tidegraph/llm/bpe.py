"""Byte-level BPE encoding and decoding with a sentencepiece model made from a rank file.

The rank file's tokens become the pieces of a sentencepiece BPE model: every byte as one printable character, score
minus the rank, identity normalisation, no word marks. Merging the best-scored neighbours is then merging by rank.
Each pre-token is encoded separately; decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import chain, islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import filled, text_of

STEP = 1 << 16  # words of a slice
CACHE = 1 << 16  # words a worker keeps, also through later stages
#: Java and Python disagree with the rank file's pattern about white space; this class is the Unicode property.
SPACE = r"\p{White_Space}"


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def load_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file (base64 token and rank on each line) by rank."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [token for _, token in pairs]


def _varint(n: int) -> bytes:
    out = b""
    n &= (1 << 64) - 1
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model. Piece 0 is the unknown piece, which no text reaches; piece r + 1 is rank r."""
    chars = byte_characters()
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    pieces = b"".join(
        _field(1, _field(1, "".join([chars[b] for b in token]).encode()) + _field(2, -float(rank)) + _field(3, 1))
        for rank, token in enumerate(tokens)
    )
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return unknown + pieces + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder of one worker process."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.tokens = tokens
        self.words = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", SPACE))
        self.chars = str.maketrans({i: c for i, c in enumerate(byte_characters())})
        self.known: dict[str, tuple[int, ...]] = {}

    def _learn(self, words: list[str]) -> None:
        new = list({w for w in words if w not in self.known})
        if len(self.known) + len(new) > CACHE:  # only a cache: nothing is lost
            self.known.clear()
            new = list(set(words))
        shown = [w.encode("utf-8", "replace").decode("latin-1").translate(self.chars) for w in new]
        for word, ids in zip(new, self.pieces.encode(shown, num_threads=1), strict=True):
            self.known[word] = tuple([i - 1 for i in ids])

    def encode(self, text: str) -> Iterator[list[int]]:
        """Ids of a whole text, in slices of bounded length."""
        found = (m.group() for m in self.words.finditer(text)) if len(text) > STEP else iter(self.words.findall(text))
        while words := list(islice(found, STEP)):
            try:
                parts = [self.known[w] for w in words]
            except KeyError:
                self._learn(words)
                parts = [self.known[w] for w in words]
            yield list(chain.from_iterable(parts))

    def decode(self, ids) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


_CODECS: dict[str, Codec] = {}


def _codec(name: str, shared, pattern: str) -> Codec:
    """The codec of this process, made once for each model."""
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(*shared.value, pattern)
    return _CODECS[name]


def bpe_codes(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids if ``with_ids``.

    Null counts as the empty text, which has no tokens; repeated rows give equal rows; a text of any length is encoded
    whole, in slices; other columns are not looked at. The model (about the size of the rank file) is all that is sent to the workers.
    """
    tokens, name = load_ranks(path), uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast((sentencepiece_model(tokens), tokens))
    names = [str(i) for i in range(len(tokens))]
    decimal = docs.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, text_of_id = _codec(name, shared, pattern), decimal.value
        for batch in filled(batches):
            rows = []
            for text in batch["text"]:
                ids_hash, bytes_hash, n, kept = hashlib.sha256(), hashlib.sha256(), 0, []
                for ids in codec.encode(text):
                    ids_hash.update(((" " if n else "") + " ".join([text_of_id[i] for i in ids])).encode())
                    bytes_hash.update(codec.decode(ids))
                    n += len(ids)
                    if with_ids:
                        kept.extend(ids)
                rows.append((n, ids_hash.hexdigest(), bytes_hash.hexdigest(), *([kept] if with_ids else [])))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInPandas(run, schema)
