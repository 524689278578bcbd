"""Importing archives into versioned tables, and exporting them as GeoJSON."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, projection, text
from ..operators import versioning
from ..operators.incremental import Batch, VersionedTable, visible_version
from ..session import written
from ..sources import archives
from . import config as configs


@dataclass
class Report:
    """Counts of one import; ``by_type`` has inserted, duplicates, known and invalid features per table."""

    vintage: str
    status: str = "Success"
    duration_secs: float = 0.0
    archives_seen: int = 0
    archives_skipped: int = 0
    archives_processed: int = 0
    archives_failed: int = 0
    features: int = 0
    skipped_types: int = 0
    by_type: dict[str, dict[str, int]] = field(default_factory=dict)
    errors: list[dict] = field(default_factory=list)
    error_count: int = 0

    @property
    def imported(self) -> int:
        return sum(v["inserted"] for v in self.by_type.values())

    def finish(self, began: float) -> Report:
        self.duration_secs = time.time() - began
        good = self.imported + sum(v["known"] for v in self.by_type.values())
        self.status = "Success" if not self.error_count else "PartialSuccess" if good else "Failed"
        return self

    def summary(self) -> str:
        return f"{self.vintage}: {self.imported} imported, {sum(v['known'] for v in self.by_type.values())} unchanged, {self.error_count} errors"

    def to_json(self) -> str:
        return json.dumps(self.__dict__ | {"imported": self.imported}, indent=2, ensure_ascii=False)

    def display(self) -> str:
        out = [f"Import of {self.vintage}: {self.status} after {self.duration_secs:.2f} s", f"Archives: {self.archives_processed} processed, {self.archives_skipped} skipped, {self.archives_failed} failed"]
        out += [f"  {t}: " + ", ".join(f"{n} {k}" for k, n in v.items()) for t, v in sorted(self.by_type.items())]
        out += [f"  {e['level']} [{e['archive_name']}] {e['message']}" for e in self.errors[:20]]
        return "\n".join(out + ([f"  ... and {self.error_count - 20} more"] if self.error_count > 20 else []))


def reprojected(features: DataFrame, srid: int, codes: list[int] | None = None) -> DataFrame:
    """``geom`` from each row's ``epsg`` to ``srid``. Only the branches of codes that occur are in the plan (a few codes come to
    the driver). Rows whose code can't be transformed, or that come out infinite, get a null geometry."""
    codes = [r[0] for r in features.select("epsg").distinct().collect()] if codes is None else codes
    out = F.lit(None)
    for c in codes:
        try:
            f = projection.transformer(c, srid) if c is not None else None
        except ValueError:
            continue
        if c is not None:
            out = F.when(F.col("epsg") == c, geometry.map_vertices(F.col("geom"), f) if f else F.col("geom")).otherwise(out)
    g = features.withColumn("geom", out.cast(geometry.GEOM))
    finite = lambda v: (F.abs(v["x"]) < 1e300) & (F.abs(v["y"]) < 1e300)
    return g.withColumn("geom", F.when(F.forall(F.flatten(F.flatten(F.col("geom.parts"))), finite), F.col("geom")))


def archive_constants(features: DataFrame) -> DataFrame:
    """Per archive the IDU of its first commune and first section, in order of VEC member and link; '' if it has none."""
    kind = text.normal_type(F.col("feature_type"))
    first = lambda k: F.coalesce(F.min_by(F.when(kind == k, F.coalesce(F.col("properties")["IDU"], F.lit(""))), F.when(kind == k, F.struct("vec_seq", "link_pos"))), F.lit(""))
    return features.groupBy("path").agg(first("COMMUNE").alias("idu_commune"), first("SECTION").alias("idu_section"))


def encode(features: DataFrame, table: configs.Table) -> DataFrame:
    """Rows of one table: id, departement, geometry columns and the configured columns with prefix and cast."""
    cols: list[Column] = []
    for f in table.fields:
        v = F.col("idu_commune") if f.source == "IDU_COMMUNE" else F.col("idu_section") if f.source == "IDU_SECTION" else F.col("properties")[f.source]
        cols.append(text.cast_attribute(text.department_prefix(v, F.col("departement"), f.prefix_dep), f.data_type).alias(f.target))
    rows = features.filter(text.normal_type(F.col("feature_type")).isin(table.types))
    return rows.select(F.concat("departement", "feature_id").alias("id"), "departement", "geom", "geometry_hash", *cols)


def _skip_known(files: DataFrame, ledger: DataFrame | None, vintage: str, preset: str, srid: int, compat: bool, on: list[str]) -> DataFrame:
    if ledger is None:
        return files
    done = ledger if compat else ledger.filter((F.col("vintage") == vintage) & (F.col("config") == preset) & (F.col("srid") == srid))
    return files.join(done.select(*on).distinct(), on, "left_anti")


def import_archives(
    spark: SparkSession, path: str, date: str, root: str, config: str = "full", srid: int = 4326, digits: int | None = None,
    dep: str | None = None, drop_table: bool = False, drop_schema: bool = False, trust_stat: bool = False, compat: bool = False,
    hash: str = "sha2", mode: str = "append",
) -> Report:
    """Import the archives below ``path`` into tables under ``root`` as of the month ``date`` (yyyy-MM).

    Archives whose checksum is in the ledger for this vintage, configuration and SRID are skipped before they are unpacked
    (``compat``: whatever they were imported for). ``drop_table`` empties the configured tables and the ledger first,
    ``drop_schema`` all tables below ``root``; earlier versions stay readable by number. With ``trust_stat`` those of unchanged size and time aren't even read.

    All tables become visible with the ledger's commit, or none does: an import that dies is repeated and adds nothing twice.
    ``hash``: ``sha2`` in the JVM, ``blake3`` for exchange with stores that have such hashes. ``mode``: ``append`` adds geometries
    that aren't known yet; ``scd2`` closes the open row of a changed geometry and opens another; ``mark_upsert`` ends all open
    rows and reopens those that come again. The last two take an import as the whole of what there is.
    """
    if hash not in ("sha2", "blake3") or mode not in ("append", "scd2", "mark_upsert"):
        raise ValueError(f"unknown hash {hash!r} or mode {mode!r}")
    began = time.time()
    day = text.vintage(date)
    tables = configs.load(config)
    digits = projection.precision(srid) if digits is None else digits
    ledger = VersionedTable(spark, f"{root}/_ledger")
    stores = {t.name: VersionedTable(spark, f"{root}/{t.name}") for t in tables}
    if drop_schema or drop_table:
        gone = [VersionedTable(spark, f"{root}/{name}") for name in _tables_below(spark, root)] if drop_schema else list(stores.values())
        seen = {s.root: s.clear() for s in gone if s.root != ledger.root}
        here = ledger.version()
        state = ledger.state(here)
        ledger.commit(here, remove=list(state.files), meta={"versions": {**state.meta.get("versions", {}), **seen}})
    listed = archives.list_archives(spark, path)
    report = Report(day, archives_seen=listed.count())
    if not report.archives_seen:
        raise FileNotFoundError(f"no .bz2 archives below {path}")
    known = ledger.read()
    source: str | list[str] = path
    if trust_stat and known is not None:
        fresh = _skip_known(listed, known, day, config, srid, compat, ["archive_name", "length", "modificationTime"])
        # one path per changed archive, as the scan that reads them lists them anyway
        source = [r["path"] for r in fresh.select("path").collect()]
        if not source:
            report.archives_skipped = report.archives_seen
            return report.finish(began)
    todo = _skip_known(archives.read_files(spark, source).withColumn("checksum", archives.checksum()), known, day, config, srid, compat, ["archive_name", "checksum"])
    parsed = written(archives.parse_files(todo, configs.wanted_types(tables) | {"COMMUNE", "SECTION"}, dep).withColumnRenamed("department", "departement"), "parsed")
    bad, good = archives.only_errors(parsed), archives.only_features(parsed)
    whole = F.col("error").isNotNull() & F.col("vec_seq").isNull()
    n = parsed.agg(
        F.count_if("archive").alias("archives"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(whole).alias("failed"), F.count_if(F.col("feature_id").isNotNull()).alias("features"), F.collect_set("epsg").alias("codes")
    ).first()
    report.archives_processed, report.error_count, report.archives_failed, report.features = n["archives"], n["errors"], n["failed"], n["features"]
    report.archives_skipped = report.archives_seen - report.archives_processed
    batch = Batch(ledger)  # committed at the end; an exception before leaves files that no version names
    if n["errors"]:  # all of them are in the table _errors; the report shows the first
        batch.append(VersionedTable(spark, f"{root}/_errors"), bad.select("archive_name", "vec_seq", "error.*", F.lit(day).alias("vintage"), F.current_timestamp().alias("at")))
        report.errors = [{"archive_name": r["archive_name"], **r["error"].asDict()} for r in bad.select("archive_name", "error").limit(50).collect()]
    if n["features"]:
        rows = reprojected(good, srid, n["codes"]).withColumn("geom", geometry.rounded(F.col("geom"), digits)).withColumn("geometry_hash", (geometry.blake3_hash if hash == "blake3" else geometry.geometry_hash)(F.col("geom")))
        rows = written(rows.join(archive_constants(good), "path").withColumn("_valid", geometry.is_valid(F.col("geom"))).withColumn("_kind", text.normal_type(F.col("feature_type"))), "features")
        # as many rows as there are configured types
        counts = {(r["_kind"], r["_valid"]): r["count"] for r in rows.groupBy("_kind", "_valid").count().collect()}
        report.skipped_types = sum(c for (k, _), c in counts.items() if not any(k in t.types for t in tables))
        jobs = [t for t in tables if any((k, True) in counts or (k, False) in counts for k in t.types)]
        with ThreadPool(max(1, min(8, len(jobs)))) as pool:  # tables are independent, so their jobs overlap
            done = pool.map(lambda t: _store(rows.filter("_valid"), t, stores[t.name], day, mode, batch), jobs)
        for t, (inserted, unseen) in zip(jobs, done):
            staged, invalid = (sum(counts.get((k, v), 0) for k in t.types) for v in (True, False))
            unseen = staged if unseen is None else unseen
            report.by_type[t.name] = {"inserted": inserted, "duplicates": unseen - inserted, "known": staged - unseen, "invalid": invalid}
    failed = bad.filter(F.col("vec_seq").isNull()).select("path")
    ok = parsed.filter(F.col("archive") & F.col("checksum").isNotNull()).select("path", "archive_name", "checksum")
    ok = (ok.join(failed, "path", "left_anti") if n["failed"] else ok).join(listed.select("path", "length", "modificationTime"), "path")
    batch.append(ledger, ok.select("archive_name", "checksum", "length", "modificationTime", F.lit(day).alias("vintage"), F.lit(config).alias("config"), F.lit(srid).alias("srid"), F.current_timestamp().alias("imported_at")))
    batch.__exit__(None)
    return report.finish(began)


def _store(rows: DataFrame, t: configs.Table, store: VersionedTable, day: str, mode: str, batch: Batch) -> tuple[int, int | None]:
    """Stage the rows of one table that it doesn't have; (inserted, rows whose hash isn't known, None if that doesn't count)."""
    before = store.read(visible_version(store, batch.ledger))
    new = encode(rows, t).withColumn("valid_from", F.to_date(F.lit(day))).withColumn("valid_to", F.lit(None).cast("date")).withColumn("created_at", F.current_timestamp()).withColumn("bbox", geometry.bbox(F.col("geom")))
    laid = lambda df: df.repartition("departement", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("departement", "bbox.xmin", "bbox.ymin")
    if mode != "append" and before is not None:
        one = versioning.merge_absent(new, new.limit(0), key=("id",), order=("geometry_hash",)).drop("valid_from", "valid_to")
        step = versioning.close_and_insert if mode == "scd2" else versioning.mark_and_upsert
        after, actions = step(before.withColumnRenamed("geom", "geometry"), one.withColumnRenamed("geom", "geometry"), day)
        after = after.withColumnRenamed("geometry", "geom").withColumn("bbox", geometry.bbox(F.col("geom")))
        n = {r["action"]: r["entities"] for r in versioning.action_counts(actions).collect()}
        batch.replace(store, laid(after))
        return n.get("Inserted", 0) + n.get("Updated", 0), n.get("Inserted", 0) + n.get("Updated", 0)
    fresh = versioning.new_by_hash(new, before) if before is not None and t.hash_geom else new
    # the key has this month in it, so of the history only this month's files are looked at
    month = before.filter(F.col("valid_from") == F.to_date(F.lit(day))) if before is not None else new.limit(0)
    inserted = batch.append(store, laid(versioning.merge_absent(fresh, month, order=("geometry_hash",))))
    return inserted, (fresh.select("geometry_hash").count() if fresh is not new else None)


def _tables_below(spark: SparkSession, root: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """The rows of a table as the last whole import left them, or None."""
    t = VersionedTable(spark, f"{root}/{table}")
    return t.read(visible_version(t, VersionedTable(spark, f"{root}/_ledger")))


def geojson_features(features: DataFrame) -> DataFrame:
    """(path, feature_type, vec_seq, link_pos, json): one GeoJSON feature per row; properties are texts, sorted by name."""
    props = F.map_from_entries(F.array_sort(F.map_entries(F.coalesce("properties", F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))))))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    body = F.regexp_replace(F.to_json(props), r"^\{", "")
    rest = F.when(body == "}", "}").otherwise(F.concat(F.lit(","), body))
    text_ = F.concat(F.lit('{"type":"Feature","id":'), quoted(F.col("feature_id")), F.lit(',"geometry":'), geometry.to_geojson(F.col("geom")), F.lit(',"properties":{"_id":'), quoted(F.col("feature_id")), rest, F.lit("}"))
    return features.select("path", "archive_name", "feature_type", "epsg", "vec_seq", "link_pos", text_.alias("json"))


def export_geojson(spark: SparkSession, path: str, out: str, srid: int | None = None) -> dict[str, int]:
    """A FeatureCollection per archive and feature type below ``out``, a folder all executors see; counts of what was done.

    A single archive goes to ``out`` itself, a folder of them to a folder per archive. Files are written by the tasks, one
    feature after another, and appear under their names when they are complete.
    """
    from ..sources.sinks import write_collections

    parsed = written(archives.parse_files(archives.read_files(spark, path)), "parsed")
    bad, good = archives.only_errors(parsed), archives.only_features(parsed)
    if parsed.select("path").limit(1).count() == 0:
        raise FileNotFoundError(f"no archives below {path}")
    if srid is not None:
        good = reprojected(good, srid).withColumn("epsg", F.lit(srid)).filter(F.col("geom").isNotNull())
    single = path.endswith(".bz2")
    folder = F.lit("") if single else text.basename(F.col("archive_name"))
    rows = geojson_features(good).withColumn("folder", folder).withColumn("file", F.lower("feature_type"))
    written_files = write_collections(rows, out)
    n = written_files.agg(F.sum("features").alias("features"), F.count("*").alias("files")).first()
    return {"features": n["features"] or 0, "files": n["files"], "errors": bad.count()}
