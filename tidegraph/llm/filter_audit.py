"""How filters of documents act on one another, for every order of applying them.

A failure is an id and a bit. Filters that look at one text give their bits while the table is scanned. The filter for
copies is an existential self-join: a left-semi join of rows with the least id of each text on hash, exact text and a
smaller id. The ids it finds are united with the ids of the other failures, bits are added up by id, and from then on
only the number of documents for each combination of bits is needed: what each filter removes in each order follows
from these few numbers.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.core import cut
from tidegraph.llm.common import WORD, scanned, settings, text_of, with_locator
from tidegraph.llm.near_dedup import BLOOM

COPIES = "E"
#: A hash with more than 1/HOT of all rows is dealt to SALTS parts; there are fewer than HOT of them.
HOT = 1024
SALTS = 64
_LOCATOR = ("file", "row")


def text_failures(text: Column) -> dict[str, Column]:
    """Filters that look at one text: few words, repeated words, capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 10 * F.char_length(text).cast("long"),
        "D": F.rlike(text, F.lit("[#$%&*|]")),
    }


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text, F.lit(17))


def smaller_copies(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed=_text_hash) -> DataFrame:
    """Locators of the rows of ``docs`` whose whole text some row with a smaller id has as well.

    ``rows``: one row for each row of ``docs`` with ``doc_id`` and ``hash``. Only texts whose hash occurs under two ids
    are shuffled. Copies are brought down to one row a text before the shuffle; the other side is dealt to parts where
    a hash is hot.
    """
    met = rows.where("doc_id IS NOT NULL").groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    met = cut(met.where("lo < hi"))
    hot = met.where(F.col("n") * HOT > F.lit(rows.count())).select("hash", F.lit(SALTS).alias("salts"))  # fewer than HOT rows
    text = text_of(text_col)
    own = with_locator(docs, F.col(id_col).alias("doc_id"), text.alias("text")).where("doc_id IS NOT NULL").withColumn("hash", hashed(F.col("text")))
    own = own.join(F.broadcast(hot), "hash", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    first = (
        docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).where("doc_id IS NOT NULL")
        .withColumn("hash", hashed(F.col("text")))
        .join(met.select("hash"), "hash", "left_semi")
        .groupBy("hash", "text").agg(F.min("doc_id").alias("least"))
    )
    with settings(docs.sparkSession, **BLOOM):
        first = first.join(F.broadcast(hot), "hash", "left").select(
            "hash", "text", "least", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
        )
        first = cut(first)
        salted = own.withColumn("salt", F.pmod(F.xxhash64(*_LOCATOR), F.col("salts")).cast("int"))
        other = first.select(F.col("hash").alias("h"), F.col("text").alias("t"), "least", F.col("salt").alias("s")).where("s >= 0")
        same = (F.col("hash") == F.col("h")) & (F.col("salt") == F.col("s")) & (F.col("text") == F.col("t")) & (F.col("least") < F.col("doc_id"))
        return cut(salted.join(other, same, "left_semi").select(*_LOCATOR))


def failure_combinations(docs: DataFrame, labels: DataFrame, failures=text_failures, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", hashed=_text_hash) -> DataFrame:
    """part, bits, n, good, toxic: numbers of documents for each combination of failed filters.

    Bit i stands for the ith filter, in the order of ``failures``, the filter for copies last. Null texts count as
    empty; a row with a null id is a copy of nothing and has no label; repeated rows count each; an id that is labelled
    more than once counts as good, or toxic, if one of its labels says so. An empty table gives an empty result. Other
    columns are not looked at.
    """
    docs = scanned(docs)
    text = text_of(text_col)
    found = failures(text)
    bits = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(found.values())), F.lit(0))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = cut(with_locator(docs, F.col(id_col).alias("doc_id"), part.alias("part"), bits.cast("int").alias("bits"), hashed(text).alias("hash")))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    copies = smaller_copies(docs, rows, id_col, text_col, hashed)
    known = rows.join(marks, "doc_id", "left").select(*_LOCATOR, "part", "bits", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    nothing = [F.lit(None).cast("string").alias("part"), F.lit(1 << len(found)).alias("bits"), F.lit(0).alias("good"), F.lit(0).alias("toxic")]
    united = known.unionByName(copies.select(*_LOCATOR, *nothing))
    by_row = united.groupBy(*_LOCATOR).agg(F.max("part").alias("part"), *[F.sum(c).cast("int").alias(c) for c in ("bits", "good", "toxic")])
    return by_row.groupBy("part", "bits").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def audit_orders(combinations: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row for each part, order of the filters and step: see ``audit_filters``. At most 2^filters numbers a part are
    brought together, so a part of any size is one small row."""
    size = len(letters)
    cells = combinations.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("cells"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    places = F.transform(F.split("filter_order", ""), lambda c: F.position(c, F.lit(letters)) - 1)
    steps = cells.select("part", "cells", F.explode(orders).alias("filter_order"))
    steps = steps.select("part", "cells", "filter_order", places.alias("places"))
    steps = steps.select("part", "cells", "filter_order", "places", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step"))

    def mask(items: Column) -> Column:
        return F.aggregate(items, F.lit(0), lambda m, i: m.bitwiseOR(F.call_function("shiftleft", F.lit(1), i.cast("int"))))

    steps = steps.select(
        "part", "cells", "filter_order", "step",
        mask(F.slice("places", F.lit(1), F.col("step") - 1)).alias("before"), mask(F.slice("places", F.col("step"), F.lit(1))).alias("own"),
    )
    shares = F.array(F.lit(0), *[F.lit(factorial(size) // k) for k in range(1, size + 1)])  # of all orders, one in k has a filter first among k

    def total(value, wanted) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(wanted(c["bits"]), value(c)).otherwise(0).cast("long"))

    before, own = F.col("before"), F.col("own")

    def earlier(bits: Column) -> Column:
        return bits.bitwiseAND(before) != 0

    def fails(bits: Column) -> Column:
        return bits.bitwiseAND(own) != 0

    def removed(bits: Column) -> Column:
        return fails(bits) & ~earlier(bits)

    return steps.select(
        "part", "filter_order", "step",
        total(lambda c: c["n"], lambda b: ~fails(b) & ~earlier(b)).alias("kept"),
        total(lambda c: c["n"], removed).alias("removed"),
        total(lambda c: c["n"], lambda b: fails(b) & earlier(b)).alias("redundant"),
        total(lambda c: c["n"], lambda b: b == own).alias("unique_fails"),
        total(lambda c: c["good"], removed).alias("good_lost"),
        total(lambda c: c["toxic"], removed).alias("toxic_lost"),
        total(lambda c: c["n"] * F.get(shares, F.bit_count(c["bits"])), fails).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, failures=text_failures, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", hashed=_text_hash) -> DataFrame:
    """part, filter_order, step and counts for each part of ``docs``, each order of the filters and each step.

    kept after the step, removed by it, redundant (fails, removed earlier), unique_fails (fails nothing else), good_lost
    and toxic_lost (removed, so labelled), shapley (removed by this filter, over all orders). ``failures`` gives a
    letter and a condition for each filter that looks at one text; E is the filter for copies. Nulls, repeated rows and
    empty tables: see ``failure_combinations``; a null part counts as the empty string.
    """
    letters = "".join(failures(F.lit(""))) + COPIES
    return audit_orders(failure_combinations(docs, labels, failures, part_col, id_col, text_col, hashed), letters)
