"""Processing only new or changed records (problem 3).

A table version is an immutable manifest: the data files it consists of and the deletion vectors on them. A commit writes only
what it changes (files added, files removed, a deletion vector as a Parquet file), so the difference of two versions is read from
the commits between them, and the record delta from the files and vectors they name. The version a consumer has processed is
stored in the same commit as its output, so a crash before the commit repeats the work and a crash after it does not.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_checksum(c: Column) -> Column:
    """Case and outer blanks don't count; a blank checksum is none."""
    t = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(t != "", t)


# ------------------------------------------------------------------------------------------------ archives

#: What the archives' table holds of listings and of the ledger; a data file that lacks a column has nulls there.
_ARCHIVES = "archive_name string, checksum string, file_seq long, delivered_at timestamp_ntz, imported_at timestamp_ntz, run_id long"


def archive_versions(source: VersionedTable, files: str, ledger: str, runs: DataFrame) -> None:
    """Put two versions of the archives into ``source``: what was imported last, and what is there now.

    Both consist of the Parquet files below ``ledger`` and ``files`` as they are; deletion vectors mark the rows that don't count.
    Of the ledger the latest row (``imported_at``, then ``run_id``, then checksum) of an archive that is of a ``Success`` run
    counts, of the listings the latest (``delivered_at``, then ``file_seq``). A null time comes first. Listings without a name are
    archives of their own. ``max_by`` aggregates on the map side, so an archive listed a billion times costs one row per task.
    """
    ok = runs.filter(F.col("status") == "Success").select("run_id").distinct()

    def superseded(rows: DataFrame | None, eligible: Callable[[DataFrame], DataFrame], order: tuple[str, ...]) -> DataFrame | None:
        if rows is None:
            return None
        name = F.coalesce("archive_name", F.concat(F.lit("\x00"), F.col("file_seq").cast("string")))
        place = F.struct("_file", "_pos")
        live = eligible(rows).groupBy(name.alias("n")).agg(F.max_by(place, F.struct(*order, place)).alias("p")).select("p.*")
        return rows.select("_file", "_pos").join(live, ["_file", "_pos"], "left_anti")

    if source.version() == 0:
        recorded = source.existing(ledger)
        source.commit(0, add=recorded, delete=superseded(source.scan(recorded), lambda r: r.join(ok, "run_id", "left_semi"), ("imported_at", "run_id", "checksum")))
    if source.version() == 1:
        listed = source.existing(files)
        source.commit(1, add=listed, remove=list(source.state(1).files), delete=superseded(source.scan(listed), lambda r: r, ("delivered_at", "file_seq")))


def due_archives(delta: DataFrame) -> DataFrame:
    """(archive_name, file_seq, change) of a delta's archives that must be taken: those that came without an equal row going.

    ``added`` if no row went, ``changed`` if its checksum is another or either is null or blank."""
    came = F.when(F.col("_change") == "insert", F.struct("archive_name", "file_seq", clean_checksum(F.col("checksum")).alias("c")))
    went = F.when(F.col("_change") == "delete", F.struct(clean_checksum(F.col("checksum")).alias("c")))
    name = F.coalesce("archive_name", F.concat(F.lit("\x00"), F.col("file_seq").cast("string")))
    both = delta.groupBy(name.alias("n")).agg(F.max(came).alias("i"), F.max(went).alias("d")).filter(F.col("i").isNotNull())
    change = F.when(F.col("d").isNull(), "added").when(F.col("i.c") == F.col("d.c"), "same").otherwise("changed")
    return both.select("i.archive_name", "i.file_seq", change.alias("change")).filter("change <> 'same'")


def archive_delta(spark: SparkSession, files: str, ledger: str, runs: DataFrame, root: str) -> DataFrame:
    """The archives that the next run must take, with the kind of change: (archive_name, file_seq, change).

    The successful imports are a consumer that has processed the version they left; it now processes the version of all
    listings. ``root``: folder of the versions and of the output, which is made once and then read.
    """
    source, out = VersionedTable(spark, f"{root}/archives", _ARCHIVES), VersionedTable(spark, f"{root}/due", "archive_name string, file_seq long, change string")
    archive_versions(source, files, ledger, runs)
    if out.version() == 0:
        out.commit(0, meta={"imports": 1})
    process_new(source, out, "imports", due_archives)
    return out.read()


def run_takes(files: DataFrame, ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """What each import run had to take: (run_id, file_seq, archive_name, change).

    For a run that started at t: the current file of each archive among those delivered up to t, against the latest ledger row
    of a run that succeeded and finished up to t. A file stays due, and is reported for each run, until a successful run has
    recorded its checksum. Rows without an archive name or a time are left out, as are runs without a start.

    Deliveries and imports are first reduced to the last of each archive between two starts, on the map side, so an archive
    has at most two rows per run whatever was listed; then states are carried forward in one window per archive. The starts
    come to the driver: one time per run.
    """
    starts = sorted({r[0] for r in runs.filter(F.col("started_at").isNotNull()).select("started_at").distinct().collect()})
    if not starts:
        return files.limit(0).select(F.lit(0).cast(runs.schema["run_id"].dataType).alias("run_id"), "file_seq", "archive_name", F.lit("").alias("change"))
    axis = F.array(*[F.lit(t) for t in starts])
    slot = lambda t: F.size(F.filter(axis, lambda s: s < t))  # noqa: E731 - the first start that isn't before t
    ok = runs.filter((F.col("status") == "Success") & F.col("finished_at").isNotNull()).select("run_id", "finished_at")
    d = (
        files.filter(F.col("archive_name").isNotNull() & F.col("delivered_at").isNotNull())
        .withColumn("slot", slot(F.col("delivered_at")))
        .groupBy("archive_name", "slot")
        .agg(F.max_by(F.struct("file_seq", clean_checksum(F.col("checksum")).alias("c")), F.struct("delivered_at", "file_seq")).alias("file"))
        .withColumn("imp", F.lit(None).cast("struct<c:string>"))
    )
    i = (
        ledger.filter(F.col("archive_name").isNotNull())
        .join(ok, "run_id")
        .withColumn("slot", slot(F.col("finished_at")))
        .groupBy("archive_name", "slot")
        .agg(F.max_by(F.struct(clean_checksum(F.col("checksum")).alias("c")), F.struct("finished_at", "imported_at", "checksum")).alias("imp"))
        .withColumn("file", F.lit(None).cast(d.schema["file"].dataType))
    )
    both = d.unionByName(i).groupBy("archive_name", "slot").agg(F.max("file").alias("file"), F.max("imp").alias("imp"))
    w = Window.partitionBy("archive_name").orderBy("slot")
    e = (
        both.withColumn("file", F.last("file", True).over(w))
        .withColumn("imp", F.last("imp", True).over(w))
        .withColumn("until", F.coalesce(F.lead("slot").over(w), F.lit(len(starts))))
        .filter(F.col("file").isNotNull())
        .withColumn("change", F.when(F.col("imp").isNull(), "added").when(F.col("file.c").isNull() | F.col("imp.c").isNull() | (F.col("file.c") != F.col("imp.c")), "changed"))
        .filter(F.col("change").isNotNull() & (F.col("slot") < F.col("until")))
        .select("archive_name", "file.file_seq", "change", F.explode(F.sequence(F.col("slot"), F.col("until") - 1)).alias("slot"))
    )
    r = runs.filter(F.col("started_at").isNotNull()).select("run_id", slot(F.col("started_at")).alias("slot"))
    return e.join(r, "slot").select("run_id", "file_seq", "archive_name", "change").distinct()


class Batch:
    """Writes to several tables that become visible together, or not at all.

    with Batch(ledger) as b: b.append(table, df); ... Data files are written at once, manifests when the block ends without an
    exception; ``ledger`` names the versions that belong together, and is committed last. ``counts`` are the rows per table,
    0 after a rollback.
    """

    def __init__(self, ledger: VersionedTable):
        self.ledger, self.staged, self.counts, self.status = ledger, [], {}, "open"
        self.ledger_rows: list[Entry] = []

    def append(self, table: VersionedTable, df: DataFrame) -> int:
        """Stage the rows of ``df``; how many there are."""
        new = table.write_files(df)
        if table.root == self.ledger.root:
            self.ledger_rows += new
        else:
            self.staged.append((table, new))
        n = sum(e.rows for e in new)
        self.counts[table.root] = self.counts.get(table.root, 0) + n
        return n

    def replace(self, table: VersionedTable, df: DataFrame) -> int:
        """Stage ``df`` in place of all that the table has."""
        self.staged.append((table, None))
        return self.append(table, df)

    def __enter__(self) -> Batch:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        if kind is not None:
            self.status, self.counts = "RolledBack", {t: 0 for t in self.counts}
            return
        versions: dict[str, int] = {}
        gone: dict[str, list[str]] = {}
        here = self.ledger.version()
        meta = self.ledger.state(here).meta
        for table, new in self.staged:
            base = visible_version(table, self.ledger)
            if table.root not in versions and table.version() != base:  # what a batch left that died before its last commit
                table.commit(table.version(), like=base)
            base = versions.get(table.root, table.version())
            if new is None:
                gone[table.root] = list(table.state(base).files)
            elif new or gone.get(table.root):
                versions[table.root] = table.commit(base, add=new, remove=gone.pop(table.root, ()))
        self.ledger.commit(here, add=self.ledger_rows, meta={"versions": {**meta.get("versions", {}), **versions}})
        self.status = "Success"


def visible_version(table: VersionedTable, ledger: VersionedTable) -> int:
    """The version of ``table`` that the last whole batch left; later manifests are of a batch that died half-way."""
    return ledger.state(ledger.version()).meta.get("versions", {}).get(table.root, 0)


# ------------------------------------------------------------------------------------------------ versioned tables


@dataclass(frozen=True)
class Entry:
    """A data file of a version: its rows, and how many of them deletion vectors mark."""

    path: str
    rows: int
    deleted: int = 0


@dataclass
class State:
    """A manifest in full: files by path, the folders of deletion vectors, and what consumers keep."""

    files: dict[str, Entry] = field(default_factory=dict)
    vectors: list[str] = field(default_factory=list)
    meta: dict = field(default_factory=dict)


class VersionedTable:
    """A Parquet table whose versions are immutable manifests under ``<root>/versions``.

    ``append`` adds files, ``delete`` adds a deletion vector (a Parquet file of places) without rewriting or collecting
    anything, ``changes`` gives the record delta of two versions. A version's file names what it changes; every ``CHECKPOINT``
    versions the whole manifest is stored beside it, so that few files are read. The driver holds the list of data files, never
    places in them. A version is written to a temporary name and renamed without overwriting, so of two writers one fails.
    ``schema``: of tables whose files may lack columns; None reads it from the files.
    """

    CHECKPOINT = 16

    def __init__(self, spark: SparkSession, root: str, schema: str | None = None):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- manifests
    def version(self) -> int:
        d = self._path(f"{self.root}/versions")
        if not self._fs.exists(d):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(d)]
        return max([0, *(int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit())])

    def _load(self, name: str) -> dict | None:
        at = self._path(f"{self.root}/versions/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _save(self, name: str, value: dict) -> bool:
        at, tmp = self._path(f"{self.root}/versions/{name}"), self._path(f"{self.root}/versions/_{uuid.uuid4().hex}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if self._fs.exists(at) or not self._fs.rename(tmp, at):
            self._fs.delete(tmp, False)
            return False
        return True

    def state(self, version: int) -> State:
        """The manifest of a version: the last stored whole and what the versions after it changed."""
        whole, first = None, version - version % self.CHECKPOINT
        while first > 0 and (whole := self._load(f"{first:012d}.whole")) is None:
            first -= self.CHECKPOINT
        s = State({e[0]: Entry(*e) for e in whole["files"]}, whole["vectors"], whole["meta"]) if whole else State()
        for v in range(first + 1, version + 1):
            c = self._load(f"{v:012d}.json")
            if c is None:
                raise ValueError(f"{self.root} has no version {v}")
            if c["like"] is not None:
                s = self.state(c["like"])
            for p in c["remove"]:
                s.files.pop(p, None)
            s.files.update({e[0]: Entry(*e) for e in c["add"]})
            if c["vector"]:
                s.vectors.append(c["vector"])
            for p, n in c["deleted"].items():
                e = s.files[p]
                s.files[p] = Entry(p, e.rows, e.deleted + n)
                if s.files[p].deleted >= e.rows:
                    del s.files[p]
            s.meta |= c["meta"]
        return s

    def entries(self, version: int) -> list[Entry]:
        return list(self.state(version).files.values())

    def commit(self, base: int, add: list[Entry] | tuple = (), remove: list[str] | tuple = (), delete: DataFrame | None = None, meta: dict | None = None, like: int | None = None) -> int:
        """Make version ``base + 1``: files added and removed, places (_file, _pos) deleted, ``meta`` put over what there is.
        ``like``: start from that version instead of ``base``."""
        vector, deleted = None, {}
        if delete is not None:
            vector = f"{self.root}/vectors/{uuid.uuid4().hex}"
            delete.select("_file", "_pos").write.parquet(vector)
            back = self.spark.read.schema("_file string, _pos long").parquet(vector)
            deleted = {r["_file"]: r["count"] for r in back.groupBy("_file").count().collect()}  # one row per file, as in the manifest
        done = {"add": [[e.path, e.rows, e.deleted] for e in add], "remove": list(remove), "vector": vector if deleted else None, "deleted": deleted, "meta": meta or {}, "like": like}
        if not self._save(f"{base + 1:012d}.json", done):
            raise RuntimeError(f"version {base + 1} was committed by another writer")
        if (base + 1) % self.CHECKPOINT == 0:
            s = self.state(base + 1)
            self._save(f"{base + 1:012d}.whole", {"files": [[e.path, e.rows, e.deleted] for e in s.files.values()], "vectors": s.vectors, "meta": s.meta})
        return base + 1

    # -- writes
    def existing(self, path: str) -> list[Entry]:
        """Entries for the Parquet files below ``path``, which stay where they are. No column is read."""
        counts = self.spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("p")).count().collect()  # one row per file
        return [Entry(r["p"], r["count"]) for r in counts]

    def write_files(self, df: DataFrame) -> list[Entry]:
        """Write ``df`` as data files of no version yet. Their rows are counted from the footers."""
        at = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(at)
        return [e for e in self.existing(at) if e.rows] if df.columns else []

    def append(self, df: DataFrame, meta: dict | None = None) -> int:
        base = self.version()
        return self.commit(base, add=self.write_files(df), meta=meta)

    def clear(self) -> int:
        """A version without rows; what consumers keep stays."""
        base = self.version()
        return self.commit(base, remove=list(self.state(base).files))

    def delete(self, condition: Column) -> int:
        """Mark the rows of ``condition`` as deleted; files without live rows leave the manifest."""
        base = self.version()
        s = self.state(base)
        return self.commit(base, delete=self.scan(list(s.files.values()), s.vectors).filter(condition) if s.files else None)

    # -- reads
    def _parquet(self, entries: list[Entry]) -> DataFrame:
        reader = self.spark.read.schema(self.schema) if self.schema else self.spark.read
        df = reader.parquet(*[e.path for e in entries])
        return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_pos"))

    def _vectors(self, vectors: list[str]) -> DataFrame:
        return self.spark.read.schema("_file string, _pos long").parquet(*vectors)

    def scan(self, entries: list[Entry], vectors: list[str] | tuple = ()) -> DataFrame | None:
        """Rows of ``entries`` with ``_file`` and ``_pos``, without those that ``vectors`` mark; only files with marks are joined."""
        whole, marked = [e for e in entries if not e.deleted or not vectors], [e for e in entries if e.deleted and vectors]
        parts = [self._parquet(whole)] if whole else []
        if marked:
            parts.append(self._parquet(marked).join(self._vectors(list(vectors)), ["_file", "_pos"], "left_anti"))
        return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version; without any an empty table if the schema is given, else None."""
        s = self.state(self.version() if version is None else version)
        df = self.scan(list(s.files.values()), s.vectors)
        if df is not None:
            return df.drop("_file", "_pos")
        return self.spark.createDataFrame([], T.StructType.fromDDL(self.schema)) if self.schema else None

    def changes(self, since: int, until: int) -> DataFrame | None:
        """Records that came and went between two versions, with ``_change`` ``insert`` or ``delete``; None if the manifests agree.

        Only files that differ are read, and of files with grown deletion vectors the rows these name. A file rewritten with the
        same rows shows as deletes and inserts of equal rows.
        """
        if until < since:
            back = self.changes(until, since)
            return None if back is None else back.withColumn("_change", F.when(F.col("_change") == "insert", "delete").otherwise("insert"))
        old, new = self.state(since), self.state(until)
        parts = [
            (self.scan([e for p, e in new.files.items() if p not in old.files], new.vectors), "insert"),
            (self.scan([e for p, e in old.files.items() if p not in new.files], old.vectors), "delete"),
        ]
        grown = [e for p, e in new.files.items() if p in old.files and e.deleted > old.files[p].deleted]
        if grown:
            fresh = self._vectors([v for v in new.vectors if v not in old.vectors])
            parts.append((self._parquet(grown).join(fresh, ["_file", "_pos"], "left_semi"), "delete"))
        out = None
        for df, what in parts:
            if df is not None:
                df = df.drop("_file", "_pos").withColumn("_change", F.lit(what))
                out = df if out is None else out.unionByName(df)
        return out


def process_new(source: VersionedTable, sink: VersionedTable, consumer: str, transform: Callable[[DataFrame], DataFrame]) -> int | None:
    """Run ``transform`` on what ``source`` gained or lost since ``consumer``'s last commit to ``sink``; None if nothing did.

    The processed version is part of the sink's manifest: output and progress become visible in one rename, or not at all.
    """
    base = sink.version()
    done, now = int(sink.state(base).meta.get(consumer, 0)), source.version()
    delta = source.changes(done, now) if now != done else None
    if delta is None:
        return None
    return sink.commit(base, add=sink.write_files(transform(delta)), meta={consumer: now})
