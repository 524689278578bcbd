"""References to records that do not exist (problem 6).

Keys are dictionary-encoded to dense integers per key range; parents and references become compressed bitmaps over those
integers, the references one per origin and period. ``references AND NOT parents`` leaves the orphans, whose bits are decoded
to keys again. Only distinct keys are shuffled, so a key named by a third of all rows is one row per task and period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Bitmap:
    """A set of integers in containers of 2^16: a sorted uint16 array while sparse, a bitset once that is smaller."""

    DENSE = 4096

    def __init__(self, containers: dict[int, np.ndarray] | None = None):
        self.containers = containers or {}

    @staticmethod
    def _pack(low: np.ndarray) -> np.ndarray:
        if len(low) <= Bitmap.DENSE:
            return low.astype(np.uint16)
        bits = np.zeros(1 << 16, np.uint8)
        bits[low] = 1
        return np.packbits(bits)

    @staticmethod
    def _low(c: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(c)).astype(np.uint16) if c.dtype == np.uint8 else c

    @classmethod
    def of(cls, values: np.ndarray) -> Bitmap:
        values = np.unique(values)
        high = values >> 16
        cut = np.flatnonzero(high[1:] != high[:-1]) + 1
        return cls({int(high[a]): cls._pack(values[a:b] & 0xFFFF) for a, b in zip([0, *cut], [*cut, len(values)]) if b > a})

    def and_not(self, other: Bitmap) -> Bitmap:
        out = {}
        for h, a in self.containers.items():
            b = other.containers.get(h)
            if b is None:
                out[h] = a
            elif a.dtype == b.dtype == np.uint8:
                low = self._low(a & ~b)
                if len(low):
                    out[h] = self._pack(low)
            else:
                low = np.setdiff1d(self._low(a), self._low(b), assume_unique=True)
                if len(low):
                    out[h] = self._pack(low)
        return Bitmap(out)

    def decode(self) -> np.ndarray:
        parts = [self._low(c).astype(np.int64) + (h << 16) for h, c in sorted(self.containers.items())]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.decode())


_ORPHAN = "key string, grp string"


def _ranges(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """A partition sorted by key, in ranges of about ``rows`` rows that never split a key."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            last = t["key"][t.num_rows - 1]
            cut = pc.index(pc.equal(t["key"], last), True).as_py()
            if cut:
                yield t.slice(0, cut)
            held = t.slice(cut).to_batches()
            n = t.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _and_not(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _ranges(batches, 1 << 18):
        enc = t["key"].combine_chunks().dictionary_encode()
        code = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        grp = t["grp"].combine_chunks().dictionary_encode()
        of = grp.indices.to_numpy(zero_copy_only=False)
        names = grp.dictionary.to_pylist()
        parents = Bitmap.of(code[of == names.index("")]) if "" in names else Bitmap()
        for g, name in enumerate(names):
            if name:
                left = Bitmap.of(code[of == g]).and_not(parents).decode()
                if len(left):
                    yield pa.RecordBatch.from_arrays([enc.dictionary.take(pa.array(left)), pa.array([name] * len(left))], names=["key", "grp"])


def _key(archive: Column, vec: Column, rty: Column, rid: Column) -> Column:
    """One text for the four parts. A null archive or file number equals nothing, so no parent has that form."""
    return F.concat_ws("\x1f", F.coalesce(archive, F.lit("\x00")), F.coalesce(vec.cast("string"), F.lit("\x00")), rty, rid)


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def reference_rows(references: DataFrame, objects: DataFrame) -> DataFrame:
    """All references: (origin, key_id, rid, key, period). Null or blank types, ids and arcs name nothing and are left out.

    ``reference``: link members. ``face``: each arc of a face that isn't deleted, which must be a PAR of its own file.
    """
    r = references.select(
        F.lit("reference").alias("origin"), F.col("ref_id").alias("key_id"), _trim(F.col("rid")).alias("rid"), "archive_name", "vec_seq", "rty", "loaded_at"
    ).filter((F.col("rid") != "") & (_trim(F.col("rty")) != ""))
    f = (
        objects.filter((F.col("rty") == "PFE") & F.col("deleted_at").isNull())
        .select(F.lit("face").alias("origin"), F.col("obj_id").alias("key_id"), F.explode("arcs").alias("rid"), "archive_name", "vec_seq", F.lit("PAR").alias("rty"), "loaded_at")
        .withColumn("rid", _trim(F.col("rid")))
        .filter(F.col("rid") != "")
    )
    period = F.coalesce(F.date_format("loaded_at", "yyyy-MM"), F.lit("none")).alias("period")
    return r.unionByName(f).select("origin", "key_id", "rid", _key(F.col("archive_name"), F.col("vec_seq"), F.col("rty"), F.col("rid")).alias("key"), period)


def orphan_references(references: DataFrame, objects: DataFrame) -> DataFrame:
    """(origin, key_id, rid, period) of references whose object doesn't exist, whenever it is loaded.

    An object exists if a row that isn't deleted has the same archive, VEC file, type and id, compared exactly. Loading
    order and repeated rows don't matter. Empty tables are empty sets.
    """
    refs = reference_rows(references, objects)
    parents = (
        objects.filter(F.col("deleted_at").isNull() & F.col("archive_name").isNotNull() & F.col("vec_seq").isNotNull() & F.col("rty").isNotNull() & F.col("rid").isNotNull())
        .select(_key(F.col("archive_name"), F.col("vec_seq"), F.col("rty"), F.col("rid")).alias("key"), F.lit("").alias("grp"))
        .distinct()
    )
    refs = refs.withColumn("grp", F.concat_ws("|", "origin", "period"))
    named = refs.select("key", "grp").distinct()
    gone = named.unionByName(parents).repartition("key").sortWithinPartitions("key").mapInArrow(_and_not, _ORPHAN)
    # the decoded bits of an origin and period are its orphaned keys, each once; the rows that name them are many or few
    return refs.join(gone, ["key", "grp"], "left_semi").select("origin", "key_id", "rid", "period").distinct()


def orphan_counts(references: DataFrame, objects: DataFrame) -> DataFrame:
    """(origin, period, orphans): orphaned references per table and month of loading; ``none`` where the time is missing."""
    return orphan_references(references, objects).groupBy("origin", "period").agg(F.count("*").alias("orphans"))
