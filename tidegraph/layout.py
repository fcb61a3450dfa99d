"""How rows of a series are laid out so that no series has to fit into one task.

Every operator on ordered series is built from these pieces:

``ordered_position``  exact 0-based rank inside a key, from a global range sort;
``over_time``         bounded window frames on fixed blocks of a series plus a halo;
``scan``              running sum / max / min over a whole series, in three levels;
``affine_scan``       running composition of affine maps, for recursions over a series;
``attach``            join per-series values to rows, in chunks of rows;
``spread_join``       join per-key values to rows, hot keys dealt to parts;
``deal``              large keys dealt to groups of bounded size;
``quantiles``         exact quantiles by rank selection over counted values.

A short series is one block, so the same plan serves millions of short series and one
series that holds a third of all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.core import KEYS, cut

BLOCK = 1 << 20
CHUNK = 1 << 22
HEAVY = 1024
PARTS = 64


def _div(c: Column, n: int) -> Column:
    return F.floor(c / F.lit(n)).cast("long")


def ordered_position(df: DataFrame, order: Sequence[Column | str], *, keys=KEYS, name="t") -> DataFrame:
    """Position of every row inside its key under a total order, as column ``name``.

    Rows are range-partitioned by (keys, order), so a hot key spreads over many
    partitions; one shift per (key, partition) turns partition row numbers into ranks.
    """
    cols = [F.col(k) for k in keys] + [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = cut(
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_row", 33))
    )
    parts = ranged.groupBy(*keys, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(
        *keys, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return (
        ranged.join(shifts, [*keys, "_part"])
        .withColumn(name, F.col("_row") + F.col("_shift"))
        .drop("_row", "_part", "_shift")
    )


def with_halo(df: DataFrame, *, t="t", before=0, after=0, block=BLOCK) -> tuple[DataFrame, Column | None]:
    """Add the block number ``_blk``, copy border rows into the neighbour block, and give the
    condition that tells own rows from copies (None when nothing was copied)."""
    size = max(block, before + after, 1)
    own = _div(F.col(t), size)
    offset = F.col(t) - own * size
    copies = [own]
    if before:
        copies.append(F.when(offset >= size - before, own + 1))
    if after:
        copies.append(F.when((offset < after) & (own > 0), own - 1))
    if len(copies) == 1:
        return df.withColumn("_blk", own), None
    wide = df.withColumn("_blk", F.explode(F.filter(F.array(*copies), lambda b: b.isNotNull())))
    return wide, F.col("_blk") == own


def over_time(
    df: DataFrame,
    *layers: Callable[[Window], dict[str, Column]],
    keys=KEYS,
    t="t",
    before=0,
    after=0,
    block=BLOCK,
    rows: int | None = None,
) -> DataFrame:
    """Add window columns whose frames reach at most ``before`` / ``after`` positions.

    Each block of a series is one window partition; rows near a block border are copied
    into the neighbour as halo and dropped again. ``layers`` are applied in turn, so a
    later layer may use columns of an earlier one; the reach must cover their sum. ``rows``
    (length of the longest series, when known) drops the blocks for tables whose series all
    fit one, so that further windows of the same series need no new shuffle.
    """
    if rows is not None and rows <= block:
        w = Window.partitionBy(*keys).orderBy(t)
        for layer in layers:
            df = df.withColumns(layer(w))
        return df
    wide, core = with_halo(df, t=t, before=before, after=after, block=block)
    w = Window.partitionBy(*keys, "_blk").orderBy(t)
    for layer in layers:
        wide = wide.withColumns(layer(w))
    if core is not None:
        wide = wide.where(core)
    return wide.drop("_blk")


def longest(df: DataFrame, t="t") -> int:
    """Largest position in the table plus one (one scalar)."""
    top = df.agg(F.max(t)).first()[0]
    return 0 if top is None else int(top) + 1


_OPS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def scan(
    df: DataFrame,
    specs: dict[str, tuple[str, Column]],
    *,
    keys=KEYS,
    t="t",
    block=BLOCK,
    reverse=False,
    exclusive=False,
    rows: int | None = None,
) -> DataFrame:
    """Running aggregate over a whole series: ``{name: (op, column)}``, op sum / max / min.

    Local running values per block, then a running value over the block totals (carried by
    the first row of each block), then the carry goes back to the rows of the block. No
    window partition exceeds ``max(block, n / block)`` rows and the plan stays linear.
    ``rows`` (length of the longest series, when known) skips the two upper levels for
    tables whose series all fit one block.
    """
    order = F.col(t).desc() if reverse else F.col(t)
    end = -1 if exclusive else 0
    if rows is not None and rows <= block:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, end)
        return df.withColumns({n: _OPS[op][0](c).over(w) for n, (op, c) in specs.items()})
    blk = Window.partitionBy(*keys, "_blk")
    local = blk.orderBy(order)
    run = local.rowsBetween(Window.unboundedPreceding, end)
    d = df.withColumn("_blk", _div(F.col(t), block))
    cols = {"_lead": F.row_number().over(local) == 1}
    for n, (op, c) in specs.items():
        cols[f"_loc_{n}"] = _OPS[op][0](c).over(run)
        cols[f"_tot_{n}"] = _OPS[op][0](c).over(blk)
    d = d.withColumns(cols).withColumn("_grp", F.when(F.col("_lead"), F.lit(-1)).otherwise(F.col("_blk")))
    blk_order = F.col("_blk").desc() if reverse else F.col("_blk")
    up = Window.partitionBy(*keys, "_grp").orderBy(blk_order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns(
        {f"_car_{n}": F.when(F.col("_lead"), _OPS[op][0](f"_tot_{n}").over(up)) for n, (op, _) in specs.items()}
    )
    out = {}
    for n, (op, _) in specs.items():
        out[n] = _OPS[op][1](F.col(f"_loc_{n}"), F.max(f"_car_{n}").over(blk))
    return d.withColumns(out).drop(
        "_blk", "_lead", "_grp", *[f"_{p}_{n}" for n in specs for p in ("loc", "tot", "car")]
    )


def affine_scan(df: DataFrame, add: str, mul: str, *, keys=KEYS, t="t", rows: int) -> DataFrame:
    """Running composition of the affine maps h -> add + mul * h of a series, in order of ``t``: columns ``add`` and
    ``mul`` become those of the whole chain up to the row.

    Composition is associative, so after a step with lag 1, 2, 4, ... a row holds the chain of its last 2, 4, 8, ... maps.
    All steps share one sort; ``rows``: the longest series. For long series, give one row a block of points.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    step = 1
    while step < rows:
        before_add, before_mul = F.coalesce(F.lag(add, step).over(w), F.lit(0.0)), F.coalesce(F.lag(mul, step).over(w), F.lit(1.0))
        df = df.withColumns({add: F.col(add) + F.col(mul) * before_add, mul: F.col(mul) * before_mul})
        step *= 2
    return df


def summarise(df: DataFrame, *aggs: Column, keys=KEYS, t="t") -> DataFrame:
    """Per-key aggregates plus ``_last``, the largest position, which ``attach`` needs."""
    return df.groupBy(*keys).agg(*aggs, F.max(t).alias("_last"))


def attach(df: DataFrame, stats: DataFrame, *, keys=KEYS, t="t", how="inner", chunk=CHUNK) -> DataFrame:
    """Join per-key values to rows. A key with n rows is split over ceil(n / chunk) join keys."""
    left = df.withColumn("_chunk", _div(F.col(t), chunk))
    right = stats.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), _div(F.col("_last"), chunk))))
    return left.join(right.drop("_last"), [*keys, "_chunk"], how).drop("_chunk")


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], rows: str, *, parts=PARTS, share=HEAVY) -> DataFrame:
    """Inner join of ``left`` with one row a key of ``right``, whose column ``rows`` counts the rows of ``left`` at the key.

    Keys with more than 1/share of all rows - there are fewer than ``share`` of them, so their list may be broadcast - are
    dealt to ``parts`` parts on both sides; no task gets a hot key alone. Column ``rows`` is dropped.
    """
    total = right.agg(F.sum(rows)).scalar()
    heavy = F.broadcast(right.where(F.col(rows) * share > total).select(*on, F.lit(parts).alias("_parts")))
    deal = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(*left.columns), F.lit(parts)).cast("int")).otherwise(0)
    dealt = left.join(heavy, list(on), "left").withColumn("_part", deal).drop("_parts")
    copies = right.drop(rows).join(heavy, list(on), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return dealt.join(copies.drop("_parts"), [*on, "_part"]).drop("_part")


def deal(df: DataFrame, most: int, *, keys=KEYS, t="t") -> DataFrame:
    """Add ``_part``: a key with more than ``most`` rows is dealt by the hash of ``t`` to parts of about that size, others are part 0.

    (keys, _part) names groups of bounded size, so a key is never one task; rows of one position stay together. There are
    fewer large keys than rows / most, so their list may be broadcast.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    large = F.broadcast(sizes.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.ceil(F.col("_n") / most).alias("_parts")))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    part = F.pmod(F.xxhash64(t), F.coalesce("_parts", F.lit(1))).cast("int")
    return df.join(large, same, "left").withColumn("_part", part).drop("_parts", *[f"_of_{k}" for k in keys])


def ranked_values(df: DataFrame, x: str, *, keys=KEYS) -> DataFrame:
    """Distinct values of each key with their ranks: keys, x, ``_lo`` <= rank < ``_hi``, ``_n`` (rows of the key).

    Equal values are counted before any sort, so a value that most rows share is one row. NULLs are ignored.
    """
    counted = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_rows"))
    placed = ordered_position(counted, [x], keys=keys, name="_at")
    running = scan(placed, {"_hi": ("sum", F.col("_rows"))}, keys=keys, t="_at")
    sizes = summarise(placed, F.sum("_rows").alias("_n"), keys=keys, t="_at")
    return attach(running, sizes, keys=keys, t="_at").select(*keys, x, (F.col("_hi") - F.col("_rows")).alias("_lo"), "_hi", "_n")


def quantiles(df: DataFrame, x: str, qs: Sequence[float], *, keys=KEYS, names: Sequence[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key. NULLs are ignored."""
    names = names or [f"q{round(q * 100)}" for q in qs]
    r = ranked_values(df, x, keys=keys)
    at = lambda rank: F.max(F.when((F.col("_lo") <= rank) & (rank < F.col("_hi")), F.col(x)))
    aggs = []
    for q, name in zip(qs, names):
        rank = (F.col("_n") - 1) * F.lit(float(q))
        lo, frac = F.floor(rank), rank - F.floor(rank)
        a, b, f = at(lo), at(lo + 1), F.max(frac)
        aggs.append(F.when(f > 0, a + (b - a) * f).otherwise(a).alias(name))
    return r.groupBy(*keys).agg(*aggs)
