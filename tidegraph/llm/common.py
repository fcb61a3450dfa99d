"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.core import cut

WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(text_col: str = "text") -> Column:
    """The text column as a string, null as the empty text."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, _UPPER, _UPPER.lower())


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` if it is a plain scan of files, else a copy written to the shared folder, so that a row's place is the
    same in every later read."""
    try:
        docs.metadataColumn("_metadata")
        return docs
    except AnalysisException:
        return cut(docs)


def with_locator(docs: DataFrame, *cols: Column | str) -> DataFrame:
    """``cols`` of ``docs`` (see ``scanned``) and where each row lies: columns ``file`` and ``row``."""
    meta = docs.metadataColumn("_metadata")
    return docs.select(*cols, meta["file_path"].alias("file"), meta["row_index"].alias("row"))


def whole_rows(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as the struct ``_doc``, and its locator."""
    return with_locator(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))


def filled(batches: Iterator) -> Iterator:
    """Batches with at least one row."""
    return (batch for batch in batches if len(batch))


@contextmanager
def settings(spark: SparkSession, **conf: str):
    """Set Spark SQL settings for a while; ``__`` in a name stands for a dot."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
