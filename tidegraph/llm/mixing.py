"""Mixing sources to target weights by entropy balancing.

Targets: 150 % of all words are shared among the sources by weight; no source gets more than twice its own words, and
what is cut off is shared again. Rates: of all rates 0 <= r <= 2 that meet a source's target, entropy balancing takes
those closest to one copy each (relative entropy). Their dual is convex, with one multiplier for each source:
r = min(2, exp(lam * size / mean size)). Newton steps on all multipliers at once, safeguarded by brackets, each step one
distributed aggregation over a histogram (source, size) of all documents. Rates become copies: the whole part, and one
more copy for the documents first in the order of hash / fraction until the words reach the target; one last copy is
added or taken away where that comes closer. Sums are whole numbers, so reruns agree however tasks are ordered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.core import cut
from tidegraph.layout import ordered_position
from tidegraph.llm.common import WORD, scanned, text_of, whole_rows, with_locator

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
_UNIT = 1024
_BINS = 4096


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, skey (source, null told apart), size in words, hash, file and row of every document; written once."""
    source = F.col(source_col).cast("string")
    return cut(
        with_locator(
            docs,
            F.col(id_col).alias("doc_id"),
            F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source)).alias("skey"),
            F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(F.col(id_col)).alias("hash"),
        )
    )


def source_targets(histogram: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """skey, source_size, docs, least (smallest positive size), target. Sources in code point order, null last."""
    sizes = histogram.groupBy("skey").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"),
        F.sum("n").alias("docs"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
    )
    ranked = ordered_position(sizes.withColumn("all", F.lit(0)), [F.col("skey") == "n", "skey"], keys=("all",), name="rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.drop("all").withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most)))
    total, weight_sum = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    goal = share * (total or 0)
    level = goal / weight_sum if weight_sum else 0.0
    while True:  # the level only rises, and each turn but the last caps at least one more source
        full = F.col("cap") <= F.col("weight") * level
        capped, free = ranked.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        higher = (goal - (capped or 0.0)) / free if free else level
        if higher <= level:
            break
        level = higher
    return cut(
        ranked.select("skey", "source_size", "docs", "least", F.least("cap", F.col("weight") * level).alias("target"))
    )


def _rate(lam: Column, z: Column, most: float) -> Column:
    return F.when(lam.isNull(), F.lit(most)).otherwise(F.exp(F.least(lam * z, F.lit(math.log(most)))))


def solve_multipliers(histogram: DataFrame, targets: DataFrame, most: float = MOST, tolerance: float = 1e-7, steps: int = 60) -> DataFrame:
    """``targets`` with lam, the multiplier of each source; null where every document gets the most."""
    mean = F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9))
    state = cut(
        targets.withColumn("mean", mean)
        .withColumn("full", F.col("least").isNull() | (F.col("target") >= most * F.col("source_size") * (1 - 1e-12)))
        .withColumn("lo", F.when(~F.col("full"), F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size")) * F.col("mean") / F.col("least"))))
        .withColumn("hi", F.when(~F.col("full"), F.lit(math.log(most)) * F.col("mean") / F.col("least")))
        .withColumn("lam", F.when(~F.col("full"), F.lit(0.0)))
    )
    for _ in range(steps):
        z = F.col("size") / F.col("mean")
        rate = _rate(F.col("lam"), z, most)
        words = F.col("n") * F.col("size") * rate
        slope = F.when(F.col("lam") * z < math.log(most), words * z).otherwise(0.0)
        sums = (
            histogram.join(state.where(~F.col("full")).select("skey", "mean", "lam"), "skey")
            .groupBy("skey")
            .agg(
                (F.sum(F.round(words * _UNIT).cast("long")) / _UNIT).alias("got"),
                (F.sum(F.round(slope * _UNIT).cast("long")) / _UNIT).alias("slope"),
            )
        )
        gap = F.col("got") - F.col("target")
        stepped = (
            state.join(sums, "skey", "left")
            .withColumn("lo", F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")))
            .withColumn("hi", F.when(gap >= 0, F.col("lam")).otherwise(F.col("hi")))
            .withColumn("newton", F.col("lam") - F.try_divide(gap, F.col("slope")))
            .withColumn("done", F.col("full") | (F.abs(gap) <= F.greatest(F.lit(tolerance) * F.col("target"), F.lit(0.5))) | (F.col("hi") - F.col("lo") < 1e-12))
            .withColumn(
                "lam",
                F.when(F.col("done"), F.col("lam"))
                .when((F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi")), F.col("newton"))
                .otherwise((F.col("lo") + F.col("hi")) / 2),
            )
        )
        state = cut(stepped.drop("got", "slope", "newton", "done").join(stepped.select("skey", "done"), "skey"))
        open_sources = state.where(~F.col("done")).count()
        state = state.drop("done")
        if not open_sources:
            return state
    raise ArithmeticError(f"multipliers of {open_sources} sources did not settle in {steps} steps")


def _crossing(parts: DataFrame, by: list[str], rest: str) -> DataFrame:
    """In each source the bin in which the running sum of words reaches what is left, and what is left before it."""
    bins = parts.groupBy(*by, "bin").agg(F.sum("size").alias("words"))
    before = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = bins.withColumn("so_far", F.coalesce(F.sum("words").over(before), F.lit(0)))
    return sums.where((F.col("so_far") <= F.col(rest)) & (F.col("so_far") + F.col("words") > F.col(rest))).select(
        "skey", F.col("bin").alias("cut_bin"), (F.col(rest) - F.col("so_far")).alias("left")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, rate, copies (0, 1 or 2), taken, file, row.

    Null and empty texts have size 0 and one copy of nothing; a null source is a source of its own, last in order;
    repeated rows are documents each; ids that are null or repeated are told apart by their place in the files. An
    empty table gives an empty result. Other columns are not looked at.
    """
    slim = document_sizes(scanned(docs), id_col, text_col, source_col)
    histogram = cut(slim.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n")))
    solved = solve_multipliers(histogram, source_targets(histogram))

    rate = _rate(F.col("lam"), F.col("size") / F.col("mean"), MOST)
    rated = slim.join(solved.select("skey", "source_size", "target", "mean", "lam"), "skey").withColumn("rate", rate)
    whole = F.floor("rate").cast("int")
    part = F.col("rate") - whole
    unit = (F.shiftrightunsigned("hash", 12) + 1) / F.lit(float(1 << 52))
    order = unit / part
    key = F.shiftleft((order / (1 + order) * F.lit(float((1 << 40) - 1))).cast("long"), 20) + F.pmod(F.xxhash64("file", "row"), F.lit(1 << 20))
    rated = cut(
        rated.withColumn("whole", whole)
        .withColumn("key", F.when((part > 1e-9) & (F.col("size") > 0), key))
        .drop("mean", "lam", "hash")
    )
    rest = rated.groupBy("skey").agg(F.first("target").alias("target"), F.sum(F.col("size") * F.col("whole")).alias("sure")).select(
        "skey", (F.col("target") - F.col("sure")).alias("rest")
    )
    # a bin of 12 bits, then one of 12 more: what is left in a bin is a 2^-24 part of a source
    open_docs = rated.where(F.col("key").isNotNull()).select("skey", "size", "key", "file", "row").join(rest, "skey")
    first = cut(_crossing(open_docs.withColumn("bin", F.shiftright("key", 48)), ["skey", "rest"], "rest"))
    inside = open_docs.join(first, "skey").where(F.shiftright("key", 48) == F.col("cut_bin"))
    second = cut(_crossing(inside.withColumn("bin", F.shiftright("key", 36)), ["skey", "left"], "left"))
    last = open_docs.select("skey", "size", "key", "file", "row").join(second, "skey").where(F.shiftright("key", 36) == F.col("cut_bin"))
    running = Window.partitionBy("skey").orderBy("key", "file", "row").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("sum", F.sum("size").over(running))
    edge = cut(
        last.where(F.col("sum") - F.col("size") < F.col("left"))
        .groupBy("skey")
        .agg(F.max(F.struct("key", "file", "row")).alias("edge"))
    )
    limits = solved.select("skey").join(first.select("skey", F.col("cut_bin").alias("bin_a")), "skey", "left")
    limits = limits.join(second.select("skey", F.col("cut_bin").alias("bin_b")), "skey", "left").join(edge, "skey", "left")
    limits = limits.join(rest, "skey", "left")
    place = F.struct("key", "file", "row")
    more = (
        F.when(F.col("key").isNull() | (F.col("rest") <= 0), 0)
        .when(F.col("bin_a").isNull(), 1)  # every fraction fits
        .when(F.shiftright("key", 48) != F.col("bin_a"), (F.shiftright("key", 48) < F.col("bin_a")).cast("int"))
        .when(F.shiftright("key", 36) != F.col("bin_b"), (F.shiftright("key", 36) < F.col("bin_b")).cast("int"))
        .otherwise(F.coalesce((place <= F.col("edge")).cast("int"), F.lit(0)))
    )
    copied = cut(rated.join(limits, "skey").withColumn("copies", F.col("whole") + more).drop("bin_a", "bin_b", "edge", "rest", "key", "whole"))

    miss = copied.groupBy("skey").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("miss"))
    movable = copied.join(miss, "skey").where(
        (F.col("size") > 0) & F.when(F.col("miss") > 0, F.col("copies") < MOST).otherwise(F.col("copies") > 0)
    )
    off = F.abs(F.abs("miss") - F.col("size"))
    best = movable.groupBy("skey").agg(F.min(F.struct(off.alias("off"), F.xxhash64("doc_id").alias("h"), "file", "row")).alias("best"), F.first("miss").alias("miss"))
    best = best.where(F.col("best.off") < F.abs("miss")).select(
        "skey", F.col("best.file").alias("to_file"), F.col("best.row").alias("to_row"), F.signum("miss").cast("int").alias("step")
    )
    moved = F.when((F.col("file") == F.col("to_file")) & (F.col("row") == F.col("to_row")), F.col("step")).otherwise(0)
    return (
        copied.join(cut(best), "skey", "left")
        .withColumn("copies", F.col("copies") + moved)
        .select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "file", "row")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them (0, 1 or 2 times), with all their columns, whatever these are
    called. Null texts have size 0, null sources are a source of their own; see ``mix``. An empty table gives an empty
    result."""
    docs = scanned(docs)
    counts = mix(docs, id_col, text_col, source_col).where("copies > 0").select(
        F.col("file").alias("_file"), F.col("row").alias("_row"), F.col("copies").alias("_copies")
    )
    rows = whole_rows(docs)
    taken = rows.join(counts, (F.col("file") == F.col("_file")) & (F.col("row") == F.col("_row")))
    return taken.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select("_doc.*")
