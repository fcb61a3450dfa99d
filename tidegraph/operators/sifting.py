"""Sifting of series that fit one block: Spark deals whole series to tasks of bounded size, a task sifts many side by side
in numpy. The same arithmetic as the windows of ``decompose``, which longer series go through."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE = 1 << 18  # rows of a task, about; adaptive plans would merge partitions by compressed size


class Series:
    """Series side by side: ``starts`` of the series, positions ``t``, values ``x`` and which of them are not NULL."""

    def __init__(self, starts: np.ndarray, t: np.ndarray, x: np.ndarray, held: np.ndarray, flat: float):
        n = len(t)
        self.starts, self.t, self.x, self.held = starts, t, x, held
        self.of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        self.begin, self.end = starts[self.of], np.append(starts[1:], n)[self.of]
        self.row = np.arange(n)
        self.before, self.after = np.maximum(self.row - 1, self.begin), np.minimum(self.row + 1, self.end - 1)
        self.inner = (self.row > self.begin) & (self.row < self.end - 1)
        count = np.maximum(self.added(held), 1)
        mean = self.added(np.where(held, x, 0.0)) / count
        spread = np.sqrt(self.added(np.where(held, x - mean[self.of], 0.0) ** 2) / count)
        self.tol = (spread * flat)[self.of]

    def added(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts, dtype=np.int64 if values.dtype == bool else None)

    def turns(self, x: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is a maximum, is a minimum) against both neighbours."""
        p, n = x[self.before], x[self.after]
        known = self.inner & held & held[self.before] & held[self.after]
        return known & (x - p > self.tol) & (x - n >= -self.tol), known & (p - x > self.tol) & (n - x >= -self.tol)

    def envelope(self, x: np.ndarray, knots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piecewise-linear envelope through the knots, flat beyond the outer ones; where there is one)."""
        left = np.maximum.accumulate(np.where(knots, self.row, -1))
        right = np.minimum.accumulate(np.where(knots, self.row, len(x))[::-1])[::-1]
        has_left, has_right = left >= self.begin, right < self.end
        a, b = np.where(has_left, left, self.row), np.where(has_right, right, self.row)
        span = self.t[b] - self.t[a]
        frac = (self.t - self.t[a]) / np.where(span == 0, 1, span)
        between = np.where(~has_right | (span == 0), x[a], x[a] + (x[b] - x[a]) * frac)
        return np.where(has_left, between, x[b]), has_left | has_right

    def modes(self, most: np.ndarray, passes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(k, rows, x, held) of each mode and, as k = 0, of the rest."""
        r, kept = self.x, self.held
        for k in range(1, int(most.max()) + 1):
            top, low = self.turns(r, kept)
            go = (self.added(top) >= 2) & (self.added(low) >= 2) & (most >= k)
            if not go.any():
                break
            h, held = r, kept
            for done in range(int(passes[go].max())):
                top, low = self.turns(h, held)
                (up, has_up), (down, has_down) = self.envelope(h, top), self.envelope(h, low)
                on = (go & (passes > done))[self.of]
                h, held = np.where(on, h - (up + down) / 2.0, h), held & (~on | (has_up & has_down))
            live = go[self.of]
            yield k, np.flatnonzero(live), h, held
            r, kept = np.where(live, r - h, r), kept & (~live | held)
        yield 0, self.row, r, kept


def _changes(columns: list) -> np.ndarray:
    """Rows, beyond the first, whose key differs from the row before."""
    new = np.zeros(max(len(columns[0]) - 1, 0), dtype=bool)
    for c in columns:
        code = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new |= code[1:] != code[:-1]
    return np.flatnonzero(new) + 1


def sift_series(state: DataFrame, keys, t: str, rows: int, flat: float, residual: str) -> DataFrame:
    """(keys, component, idx, t, x) of the series in ``state`` (keys, t, _r, _most, _passes), a table of ``rows`` rows."""
    names, kinds = list(keys), state.schema
    tasks = max(state.sparkSession.sparkContext.defaultParallelism, -(-rows // SLICE))
    dealt = state.select(*names, t, "_r", "_most", "_passes").repartition(tasks, *names).sortWithinPartitions(*names, t)
    fields = [T.StructField("component", T.StringType()), T.StructField("idx", T.IntegerType()), kinds[t], T.StructField("x", T.DoubleType())]

    def solved(parts: list) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        column = lambda c: pa.concat_arrays(table.column(c).chunks)
        own = [column(c) for c in names]
        starts = np.append(0, _changes(own)) if own else np.zeros(1, dtype=np.int64)
        x, at = column("_r"), column(t)
        most, passes = (column(c).to_numpy(zero_copy_only=False)[starts] for c in ("_most", "_passes"))
        held = x.is_valid().to_numpy(zero_copy_only=False)
        with np.errstate(all="ignore"):
            series = Series(starts, at.to_numpy(zero_copy_only=False), x.fill_null(0.0).to_numpy(), held, flat)
            for k, found, value, known in series.modes(most, passes):
                pick, name = pa.array(found), f"IMF_{k}" if k else residual
                idx = np.full(len(found), k) if k else most[series.of] + 1
                out = [c.take(pick) for c in own]
                out += [pa.repeat(name, len(found)), pa.array(idx.astype(np.int32)), at.take(pick), pa.array(value[found], mask=~known[found])]
                yield pa.RecordBatch.from_arrays(out, [*names, "component", "idx", t, "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(batch.schema.get_field_index(c)) for c in names]
            turn = _changes(own) if own else np.zeros(0, dtype=np.int64)
            if parts and tuple(c[0].as_py() for c in own) != last:
                turn = np.append(0, turn)
            last = tuple(c[-1].as_py() for c in own)
            if len(turn):  # the last series may go on in the next batch
                begin = int(turn[-1])
                yield from solved([*parts, batch.slice(0, begin)])
                parts, batch = [], batch.slice(begin)
            parts.append(batch)
        if parts:
            yield from solved(parts)

    return dealt.mapInArrow(run, T.StructType([kinds[k] for k in names] + fields))
