"""Exact deduplication by a stream with keyed state on disk.

Every text becomes a slim row: digest of the normalised text, stable identifier, content locator (file and row). The
rows run through a Structured Streaming aggregation whose state has one entry for each digest and never expires: the
smallest identifier with its locator, and the number of rows. The state store keeps it on disk (RocksDB) with its
checkpoint in the shared folder. On a hit (a digest seen more than once) the full bytes are compared: least and
greatest text of the digest must be equal. Texts whose digests collide are told apart by the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.core import cut, cut_counted, new_path
from tidegraph.llm.common import WHITE, scanned, settings, text_of, whole_rows, with_locator

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text_col: str = "text") -> Column:
    return F.regexp_replace(text_of(text_col), WHITE, " ")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def _first() -> Column:
    """Order of the rows of a group: smallest identifier, null last, then the locator."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row"))


def register(prints_path: str, schema, checkpoint: str, spark) -> DataFrame:
    """Run all rows under ``prints_path`` not yet seen by ``checkpoint`` through the keyed state; return the state.

    Called again with the same checkpoint it takes in new files only, so a corpus can grow by batches.
    """
    with settings(
        spark,
        spark__sql__streaming__stateStore__providerClass=STORE,
        spark__sql__streaming__stateStore__unloadOnCommit="true",  # a store's local files go when its task ends
        spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage="true",
        spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB="200",
    ):
        seen = (
            spark.readStream.schema(schema)
            .parquet(prints_path)
            .groupBy("digest")
            .agg(_first().alias("first"), F.count(F.lit(1)).alias("n"))
        )
        run = (
            seen.writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        return cut(
            state.select(
                F.col("key.digest").alias("digest"),
                F.col("value.min").alias("first"),
                F.col("value.count").alias("n"),
            )
        )


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_hex,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, digest, file, row.

    Texts are equal when identical after every run of white space became one space; null counts as empty. The row with
    the smallest id stays, null ids last; of repeated rows with one id the one with the first locator stays, so each
    group keeps exactly one row. An empty table gives an empty result. Other columns of ``docs`` are not looked at.
    ``digest`` may be any function of the normalised text: collisions cost time but change nothing.
    """
    spark, docs = docs.sparkSession, scanned(docs)
    located = with_locator(docs, F.col(id_col).alias("doc_id"), normalised(text_col).alias("body"))
    prints = located.select("doc_id", digest(F.col("body")).alias("digest"), "file", "row")
    path = new_path(spark)
    prints.write.parquet(path)
    prints = spark.read.schema(prints.schema).parquet(path)
    state = register(path, prints.schema, new_path(spark), spark)

    hits = prints.join(state.where("n > 1").select("digest"), "digest")
    bodies = located.select("body", "file", "row").join(hits, ["file", "row"])
    same = bodies.groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("most"))
    broken, count = cut_counted(same.where("least != most").select("digest"))

    if count == 0:
        found = prints.join(state, "digest")
    else:
        texts = cut(bodies.join(broken, "digest"))
        parts = texts.groupBy("digest", "body").agg(_first().alias("first"), F.count(F.lit(1)).alias("n"))
        apart = texts.join(parts, ["digest", "body"]).drop("body")
        whole = prints.join(state, "digest").join(broken, "digest", "left_anti")
        found = whole.unionByName(apart)
    return found.select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        ((F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))).alias("kept"),
        "digest",
        "file",
        "row",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever these are called.

    Of equal texts one row stays, of repeated rows of the least id too; null, empty and white texts are equal as
    ``exact_groups`` says. Texts of any length are compared whole. An empty table gives an empty result.
    """
    docs = scanned(docs)
    stays = exact_groups(docs, id_col, text_col).where("kept").select(F.col("file").alias("_file"), F.col("row").alias("_row"))
    rows = whole_rows(docs)
    return rows.join(stays, (F.col("file") == F.col("_file")) & (F.col("row") == F.col("_row")), "left_semi").select("_doc.*")
