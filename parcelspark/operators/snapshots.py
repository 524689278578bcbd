"""History from periodic snapshots (problem 5) and what changed between full snapshots (problem 7).

Both start from ``deliveries``: one row per (departement, vintage, id) with the ordinal of its vintage. Duplicates are
reduced by a map-side aggregate before any shuffle, so an id repeated a billion times is one row per task; afterwards an
entity has at most one row per vintage.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table_path, written

#: Day number that stands for "there is none".
NONE = 2**31 - 1


def clean_id(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def vintages(df: DataFrame) -> DataFrame:
    """(departement, valid_from, delivery_no, k, next): per departement its delivered vintages in order.

    All rows count, also those without a hash; ``delivery_no`` is the greatest, ``next`` the following vintage or null.
    The size is departements times vintages; it is written so that its true size decides whether Spark broadcasts it.
    """
    w = Window.partitionBy("departement").orderBy("valid_from")
    v = df.filter(F.col("valid_from").isNotNull()).groupBy("departement", "valid_from").agg(F.max("delivery_no").alias("last_no"))
    return written(v.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("valid_from").over(w)), "vintages")


def deliveries(df: DataFrame) -> DataFrame:
    """The rows that count, one per departement, vintage and cleaned id.

    Of a departement and vintage only the greatest delivery counts (a null ``delivery_no`` is the least), rows without a
    hash or an id don't, and of several rows of an id the latest ``created_at`` wins, then the greatest ``row_id``. Rows
    without ``valid_from`` belong to no vintage. A null departement is a departement of its own.
    """
    state = F.struct("delivery_no", "geometry_hash", "contenance", "section_id")
    rows = (
        df.filter(F.col("geometry_hash").isNotNull() & F.col("valid_from").isNotNull())
        .select("departement", "valid_from", clean_id(F.col("id")).alias("id"), state.alias("s"), F.struct("delivery_no", "created_at", "row_id").alias("o"))
        .filter(F.col("id").isNotNull())
        .groupBy("departement", "valid_from", "id")
        .agg(F.max_by("s", "o").alias("s"))
    )
    v = vintages(df)
    on = rows["departement"].eqNullSafe(v["departement"]) & (rows["valid_from"] == v["valid_from"]) & rows["s.delivery_no"].eqNullSafe(v["last_no"])
    return rows.join(v, on).select(rows["departement"], rows["id"], rows["valid_from"], "k", "next", "s.geometry_hash", "s.contenance", "s.section_id")


def _days(c: str) -> Column:
    return F.coalesce(F.unix_date(c), F.lit(NONE))


# ------------------------------------------------------------------------------------------------ history

_RUN = "departement string, id string, payload string, k0 int, k1 int, lo int, hi int"


def _tree(ent: np.ndarray, pay: np.ndarray, k0: np.ndarray, k1: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Coalesce runs sorted by (entity, k0): in round r, blocks of 2^r units join in pairs and only their seam can merge.

    ``ent`` and ``pay`` are codes. The number of rounds is the logarithm of the number of units; a round is vectorised.
    """
    block = np.arange(len(ent))
    first = np.arange(len(ent))  # index of the unit a run starts with; names the run
    while len(block) and block[-1] > 0:
        seam = (block[1:] != block[:-1]) & (block[1:] >> 1 == block[:-1] >> 1)
        seam &= (ent[1:] == ent[:-1]) & (pay[1:] == pay[:-1]) & (k1[:-1] + 1 == k0[1:])
        if seam.any():
            left = np.flatnonzero(seam)
            # a block that is one run can merge on both sides; only one side is a seam of this round
            k1[left], hi[left] = k1[left + 1], hi[left + 1]
            keep = np.ones(len(ent), bool)
            keep[left + 1] = False
            ent, pay, k0, k1, lo, hi, block, first = (a[keep] for a in (ent, pay, k0, k1, lo, hi, block, first))
        block = block >> 1
    return first, k0, k1, lo, hi


def _coalesce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a partition sorted by (departement, id, k0). The last run of a batch waits for the next one."""
    held: pa.RecordBatch | None = None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:  # the input's fields may be marked not null, the output's never are
            b = pa.Table.from_batches([held, b.cast(held.schema)]).combine_chunks().to_batches()[0]
        key = pc.binary_join_element_wise(pc.fill_null(b.column("departement"), "\x00"), b.column("id"), "\x1f")
        ent = key.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        pay = b.column("payload").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        first, *ints = _tree(ent, pay, *(b.column(c).to_numpy().copy() for c in ("k0", "k1", "lo", "hi")))
        out = b.take(pa.array(first))
        out = pa.RecordBatch.from_arrays([*(out.column(c) for c in ("departement", "id", "payload")), *(pa.array(x, pa.int32()) for x in ints)], names=["departement", "id", "payload", "k0", "k1", "lo", "hi"])
        held = out.slice(out.num_rows - 1)
        if out.num_rows > 1:
            yield out.slice(0, out.num_rows - 1)
    if held is not None:
        yield held


def history(df: DataFrame, attributes: tuple[str, ...] = ("geometry_hash", "contenance", "section_id")) -> DataFrame:
    """One version per unchanged stretch: (departement, id, valid_from, valid_to, version_hash).

    Every delivered row is a unit run [k, k]; neighbouring runs of an entity with equal payload merge pairwise. Equality is
    null-safe: null is a value like others. ``valid_to`` is the next delivered vintage after the last of the run, or null.
    An absence, however short, and a return to an earlier state start a new version. Empty input gives no rows.
    """
    payload = F.concat_ws("\x1f", *[F.coalesce(F.hex(c) if c == "geometry_hash" else F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in attributes])
    units = deliveries(df).select(
        "departement", "id", payload.alias("payload"), F.col("k").alias("k0"), F.col("k").alias("k1"), F.unix_date("valid_from").alias("lo"), _days("next").alias("hi")
    )
    runs = units.repartition("departement", "id").sortWithinPartitions("departement", "id", "k0").mapInArrow(_coalesce, _RUN)
    return runs.select(
        "departement",
        "id",
        F.date_from_unix_date("lo").alias("valid_from"),
        F.when(F.col("hi") != NONE, F.date_from_unix_date("hi")).alias("valid_to"),
        F.split("payload", "\x1f")[0].alias("version_hash"),
    )


def history_text(df: DataFrame) -> DataFrame:
    """``history`` in the form (id, valid_from, valid_to) with dates as text and an open end empty."""
    h = history(df)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return h.select("id", day("valid_from").alias("valid_from"), F.coalesce(day("valid_to"), F.lit("")).alias("valid_to")).distinct()


# ------------------------------------------------------------------------------------------------ snapshot diff


class SnapshotIndex:
    """A stored index key -> hash of the last snapshot, bucketed by key: a partition is a bucket.

    ``advance`` writes the new snapshot once, as the next index, and probes the one in force bucket by bucket: as both are stored
    in the same buckets, neither is shuffled. Old values are fetched only for keys that changed or went. Then the indexes are
    swapped by renaming a pointer of the next number into place: at any time one index is in force, and a run that dies before
    the swap changes nothing. ``carry``: columns kept with each key. The number of buckets is fixed when the index is made.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], hash_col: str, buckets: int = 64, carry: tuple[str, ...] = ()):
        self.spark, self.root, self.keys, self.hash, self.carry = spark, root.rstrip("/"), keys, hash_col, carry
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._names: list[str] = []
        now = self._current()
        self.buckets = now["buckets"] if now else buckets

    def _pointers(self) -> list[str]:
        root = self._path(self.root)
        names = [f.getPath().getName() for f in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(n for n in names if n.startswith("CURRENT-"))

    def _current(self) -> dict | None:
        """Path, schema and buckets of the index in force: the pointer of the highest number."""
        names = self._pointers()
        if not names:
            return None
        s = self._fs.open(self._path(f"{self.root}/{names[-1]}"))
        try:
            return json.loads(bytes(s.readAllBytes()).decode())
        finally:
            s.close()

    def _bucketed(self, at: str, schema: str) -> DataFrame:
        """The files at ``at`` as a bucketed table; its name is this session's, its data stay when the name is dropped."""
        name, keys = f"index_{uuid.uuid4().hex}", ", ".join(f"`{k}`" for k in self.keys)
        self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{at}'")
        self._names.append(name)
        return self.spark.table(name)

    def index(self) -> DataFrame | None:
        now = self._current()
        return None if now is None else self._bucketed(now["path"], now["schema"])

    def advance(self, snapshot: DataFrame, old_values: DataFrame | None = None) -> DataFrame:
        """Changes of ``snapshot`` against the last one: the keys, ``change``, the carried columns before and after as
        ``was_<name>`` and ``now_<name>`` and, with ``old_values``, its row as ``old``.

        One row per key is expected in ``snapshot``; rows with a null in a key are no objects and are left out. A null hash is a
        value like others. The first snapshot is all ``added``.
        """
        at = f"{self.root}/index-{uuid.uuid4().hex}"
        rows = snapshot.select(*self.keys, self.hash, *self.carry).dropna(subset=self.keys)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        name = f"index_{uuid.uuid4().hex}"
        rows.repartition(self.buckets, *self.keys).write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", at).saveAsTable(name)
        self._names.append(name)
        new, old = self.spark.table(name), self.index()
        n = new.select(*self.keys, F.col(self.hash).alias("_new"), F.lit(True).alias("_n"), *[F.col(c).alias(f"now_{c}") for c in self.carry])
        if old is None:
            changes = n.withColumn("change", F.lit("added"))
            for c in self.carry:
                changes = changes.withColumn(f"was_{c}", F.lit(None).cast(new.schema[c].dataType))
        else:
            o = old.select(*self.keys, F.col(self.hash).alias("_old"), F.lit(True).alias("_o"), *[F.col(c).alias(f"was_{c}") for c in self.carry])
            kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
            changes = n.hint("merge").join(o, self.keys, "full").withColumn("change", kind).filter(F.col("change").isNotNull())
        changes = changes.select(*self.keys, "change", *[f"{w}_{c}" for c in self.carry for w in ("was", "now")])
        at_changes = table_path(self.spark, "changes")
        changes.write.parquet(at_changes)
        changes = self.spark.read.schema(changes.schema).parquet(at_changes)
        for t in self._names:  # names of this session; the data stay
            self.spark.sql(f"DROP TABLE {t}")
        self._names = []
        names = self._pointers()
        number = int(names[-1].split("-")[1]) + 1 if names else 1
        tmp, to = self._path(f"{self.root}/_{uuid.uuid4().hex}"), self._path(f"{self.root}/CURRENT-{number:012d}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps({"path": at, "schema": schema, "buckets": self.buckets}).encode()))
        out.close()
        if self._fs.exists(to) or not self._fs.rename(tmp, to):
            raise RuntimeError(f"index {number} was swapped in by another run")
        if old_values is None:
            return changes
        touched = changes.filter(F.col("change") != "added")
        fetched = old_values.join(touched.select(*self.keys), self.keys, "left_semi").select(*self.keys, F.struct(*[F.col(c) for c in old_values.columns]).alias("old"))
        return changes.join(fetched, self.keys, "left")

    def vacuum(self) -> int:
        """Delete the indexes that aren't in force, once nothing reads them; how many there were."""
        names, now = self._pointers(), self._current()
        gone = [s.getPath() for s in (self._fs.listStatus(self._path(self.root)) if names else []) if s.getPath().getName().startswith("index-") and now["path"].rsplit("/", 1)[1] != s.getPath().getName()]
        for p in [*gone, *[self._path(f"{self.root}/{n}") for n in names[:-1]]]:
            self._fs.delete(p, True)
        return len(gone)


#: Rows of a vintage that a bucket should have.
BUCKET_ROWS = 1_000_000


def snapshot_changes(df: DataFrame, buckets: int | None = None) -> DataFrame:
    """(departement, id, valid_from, change) between each two consecutive delivered vintages of a departement.

    The vintages go through a ``SnapshotIndex`` in order, the first of all departements, then the second and so on: each becomes
    the index that the next is probed with. Only keys and hashes move, once. The first vintage gives no changes; one in which a
    departement has no valid row removes everything. ``buckets`` of the index: by the rows there are if None.
    """
    spark = df.sparkSession
    dep = F.coalesce("departement", F.lit("\x00")).alias("departement")
    rows = deliveries(df).select(dep, "id", "geometry_hash", "k", F.unix_date("valid_from").alias("at"), _days("next").alias("next"))
    at = table_path(spark, "vintages")
    rows.write.partitionBy("k").parquet(at)
    rows = spark.read.schema(rows.schema).parquet(at)
    n = rows.agg(F.max("k").alias("last"), F.count("*").alias("rows")).first()
    out = spark.createDataFrame([], "departement string, id string, day int, change string")
    if n["last"]:
        index = SnapshotIndex(spark, table_path(spark, "snapshots"), ["departement", "id"], "geometry_hash", buckets or max(4, -(-n["rows"] // n["last"] // BUCKET_ROWS)), ("at", "next"))
        for k in range(1, n["last"] + 1):  # as many as a departement has vintages
            changes = index.advance(rows.filter(F.col("k") == k))
            if k > 1:
                out = out.unionByName(changes.select("departement", "id", F.coalesce("now_at", "was_next").alias("day"), "change").filter(F.col("day") != NONE))
    return out.select(F.nullif("departement", F.lit("\x00")).alias("departement"), "id", F.date_from_unix_date("day").alias("valid_from"), "change")


def snapshot_changes_text(df: DataFrame) -> DataFrame:
    return snapshot_changes(df).select("id", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), "change").distinct()
