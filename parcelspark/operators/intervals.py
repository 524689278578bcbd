"""Overlapping and gapped time intervals (problem 4).

The aggregate's state is a list of sorted, disjoint, half-open day ranges per entity. Two states combine by a linear merge,
so partial states can be made per Arrow batch, combined per (entity, salt) and again per entity: a reduction tree of fixed
depth. A state has at most half as many ranges as the calendar has days, whatever the number of rows, so an entity that
holds a third of all rows leaves each batch as a short list and is never gathered whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Day number of an end that is open. Real days are far below.
OPEN = 2**31 - 1
_STATE = "id string, lo int, hi int, salt int"


def merge_sorted(code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge ranges sorted by (code, lo) into disjoint ones; touching ranges join. Linear, without a loop over rows."""
    if not len(lo):
        return code, lo, hi
    top = np.maximum.accumulate(code.astype(np.int64) * 2**33 + hi) - code.astype(np.int64) * 2**33
    first = np.ones(len(lo), bool)
    first[1:] = (code[1:] != code[:-1]) | (lo[1:] > top[:-1])
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(lo)) - 1
    return code[at], lo[at], top[last]


def _columns(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    ids = batch.column("id").dictionary_encode()
    names = ids.dictionary
    code = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return names, code, batch.column("lo").to_numpy().astype(np.int64), batch.column("hi").to_numpy().astype(np.int64)


def _partial(salts: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(batches):
            names, code, lo, hi = _columns(b)
            order = np.lexsort((lo, code))
            seen = np.bincount(code, minlength=len(names))
            code, lo, hi = merge_sorted(code[order], lo[order], hi[order])
            salt = np.where(seen[code] > hot, k % salts + 1, 0) if salts else np.zeros(len(code), int)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(code)), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(salt, pa.int32())], names=["id", "lo", "hi", "salt"])

    return run


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Merged ranges of a partition sorted by (id, lo). The last range of a batch waits for the next; nothing else is held."""
    held: tuple[str, int, int] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        names, code, lo, hi = _columns(b)
        if held:
            names = pa.concat_arrays([names, pa.array([held[0]], names.type)])
            same = names[int(code[0])].as_py() == held[0]
            code = np.append(code[0] if same else len(names) - 1, code)
            lo, hi = np.append(held[1], lo), np.append(held[2], hi)
        # ids come in runs, so a run number is a code that rises
        run = np.cumsum(np.append(0, (code[1:] != code[:-1]).astype(np.int64)))
        at, lo, hi = merge_sorted(run, lo, hi)
        of = np.zeros(run[-1] + 1, np.int64)
        of[run] = code
        code = of[at]
        held = (names[int(code[-1])].as_py(), int(lo[-1]), int(hi[-1]))
        if len(code) > 1:
            yield names, code[:-1], lo[:-1], hi[:-1]
    if held:
        yield pa.array([held[0]], pa.string()), np.zeros(1, np.int64), np.array([held[1]]), np.array([held[2]])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for names, code, lo, hi in _streamed(batches):
        yield pa.RecordBatch.from_arrays([names.take(pa.array(code)), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(np.zeros(len(code)), pa.int32())], names=["id", "lo", "hi", "salt"])


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    prev_id, prev_hi = None, 0
    for names, code, lo, hi in _streamed(batches):
        ids = names.take(pa.array(code))
        gap = np.zeros(len(code), bool)
        gap[1:] = code[1:] == code[:-1]
        start = np.append(prev_hi, hi[:-1])
        gap[0] = prev_id is not None and ids[0].as_py() == prev_id
        prev_id, prev_hi = ids[-1].as_py(), int(hi[-1])
        at = np.flatnonzero(gap)
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([ids, ids.take(pa.array(at))]),
                pa.array(["period"] * len(ids) + ["gap"] * len(at)),
                pa.array(np.concatenate([lo, start[at]]), pa.int32()),
                pa.array(np.concatenate([hi, lo[at]]), pa.int32()),
            ],
            names=["id", "kind", "lo", "hi"],
        )


def _tree(rows: DataFrame, salts: int, hot: int) -> DataFrame:
    """Partial states of (id, lo, hi), combined per (id, salt), and sorted per id for the last merge."""
    part = rows.mapInArrow(_partial(salts, hot), _STATE)
    tree = part.repartition("id", "salt").sortWithinPartitions("id", "salt", "lo").mapInArrow(_combine_salted, _STATE)
    return tree.repartition("id").sortWithinPartitions("id", "lo")


def merged_ranges(rows: DataFrame, salts: int = 32, hot: int = 64) -> DataFrame:
    """Disjoint ranges (id, lo, hi) of ranges (id string, lo int, hi int) without nulls; touching ones join."""
    return _tree(rows, salts, hot).mapInArrow(_combine, _STATE).drop("salt")


def coverage(df: DataFrame, entity: str = "id", start: str = "valid_from", end: str = "valid_to", salts: int = 32, hot: int = 64) -> DataFrame:
    """Continuous periods and the gaps between them: (id, kind, date_from, date_to), dates as text, an open end empty.

    Rows: [start, end), a null end is open. Rows whose end isn't after the start cover nothing; rows without a start or an
    entity have no defined place and are ignored. Repeated, nested and touching rows join. An empty table gives no rows.
    Other columns of ``df`` are never read. ``salts`` and ``hot``: an entity with more than ``hot`` rows in one Arrow batch
    is combined in ``salts`` parts first.
    """
    rows = (
        df.select(
            F.col(entity).cast("string").alias("id"),
            F.unix_date(F.col(start).cast("date")).alias("lo"),
            F.coalesce(F.unix_date(F.col(end).cast("date")), F.lit(OPEN)).alias("hi"),
        )
        .filter(F.col("id").isNotNull() & F.col("lo").isNotNull() & (F.col("hi") > F.col("lo")))
    )
    out = _tree(rows, salts, hot).mapInArrow(_emit, "id string, kind string, lo int, hi int")
    day = lambda c: F.date_format(F.date_from_unix_date(c), "yyyy-MM-dd")
    return out.select("id", "kind", day(F.col("lo")).alias("date_from"), F.when(F.col("hi") == OPEN, "").otherwise(day(F.col("hi"))).alias("date_to"))


def _combine_salted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _combine, but ranges of different salts of an id stay apart (each is its own sorted run)."""

    def keyed() -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = pa.compute.binary_join_element_wise(b.column("id"), b.column("salt").cast(pa.string()), "\x00")
            yield pa.RecordBatch.from_arrays([key, b.column("lo"), b.column("hi")], names=["id", "lo", "hi"])

    for r in _combine(keyed()):
        yield pa.RecordBatch.from_arrays([pa.compute.replace_substring_regex(r.column("id"), "\x00[0-9]+$", ""), r.column("lo"), r.column("hi"), r.column("salt")], names=["id", "lo", "hi", "salt"])
