import json
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from parcelspark.functions import geometry, records
from parcelspark.operators import versioning
from parcelspark.plans import config, importer
from parcelspark.sources import archives, sinks
from parcelspark.streaming import archives as streaming

H = [bytes([n]) * 32 for n in range(9)]
SCHEMA = "id string, departement string, geometry string, geometry_hash binary, valid_from date, valid_to date"


def test_configurations(tmp_path):
    full = config.load("full")
    assert len(full) == 10 and len(config.load("light")) == 3 and len(config.load("bati")) == 1
    parcels = next(t for t in full if t.name == "edi_parcelles")
    assert [(f.target, f.data_type, f.prefix_dep) for f in parcels.fields] == [("numero", "text", False), ("commune_id", "text", True), ("section_id", "text", True), ("contenance", "integer", False), ("indp", "integer", False)]
    own = {"A_id": {"table": "t", "fields": [{"source": "X", "target": "x"}, {"source": "I", "target": "id"}]}, "B": {"table": "t", "hash_geom": True, "fields": [{"source": "X", "target": "x"}]}}
    p = tmp_path / "c.json"
    p.write_text(json.dumps(own))
    (t,) = config.load(str(p))
    assert t.hash_geom and t.types == ["A", "B"] and [f.target for f in t.fields] == ["x"]
    own["B"]["fields"][0]["target"] = "y"
    p.write_text(json.dumps(own))
    with pytest.raises(ValueError):
        config.load(str(p))


def archive(path, n, grow=0.0, codec="latin-1"):
    arcs, faces, business = {}, {}, []
    for k in range(5):
        x, y = 652000.0 + n * 100 + k * 6, 6862000.0
        arcs |= {f"a{k}": [(x, y), (x + 4, y), (x + 4, y + 4 + grow)], f"b{k}": [(x, y), (x, y + 4 + grow), (x + 4, y + 4 + grow)]}
        faces[f"F{k}"] = [f"a{k}", f"b{k}"]
        kind = ["COMMUNE_id", "SECTION_id", "PARCELLE_id", "PARCELLE_id", "MURS_id"][k]
        business.append((f"Objet_{k}", kind, {"IDU": f"{n:03d}AA{k}", "TEX": f"é{k}", "TEX2": "L'Île", "SUPF": f"+{k}."}, "PFE", [f"F{k}"]))
    archives.write_archive(str(path), codec, 2024, "LAMB93", [records.write_vec(arcs, faces, business)])


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    (d / "deep").mkdir(parents=True)
    for n in range(3):
        archive(d / "deep" / f"edigeo-39{n:03d}000AA01.tar.bz2", n)
    (d / "broken.tar.bz2").write_bytes(b"no archive")
    (d / "ignored.BZ2").write_bytes(b"")
    return d


def test_import_skip_change_and_export(spark, folder, tmp_path):
    root = f"file://{tmp_path}/tables"
    r = importer.import_archives(spark, str(folder), "2024-01", root, srid=2154)
    assert (r.archives_seen, r.archives_processed, r.archives_failed, r.status, r.error_count) == (4, 4, 1, "PartialSuccess", 1)
    assert r.by_type["edi_parcelles"] == {"inserted": 6, "duplicates": 0, "known": 0, "invalid": 0} and r.imported == 12
    assert importer.read_table(spark, root, "_errors").count() == 1
    t = importer.read_table(spark, root, "edi_parcelles")
    row = t.filter("id = '39001AA3'").first()
    assert (row.numero, row.commune_id, row.section_id, row.contenance, row.valid_from, row.valid_to) == ("é3", "39001AA0", "39001AA1", 3, date(2024, 1, 1), None)
    again = importer.import_archives(spark, str(folder), "2024-01", root, srid=2154)
    assert (again.archives_skipped, again.imported, again.status) == (3, 0, "Failed")  # only the broken one is tried again
    os.remove(folder / "broken.tar.bz2")
    assert importer.import_archives(spark, str(folder), "2024-01", root, srid=2154, trust_stat=True).archives_skipped == 3
    archive(folder / "deep" / "edigeo-39001000AA01.tar.bz2", 1, 1.0)
    r = importer.import_archives(spark, str(folder), "2024-01", root, srid=2154)
    # same ids and vintage: new geometries don't replace what the key has
    assert (r.archives_processed, r.imported, r.by_type["edi_parcelles"]["duplicates"]) == (1, 0, 2)
    r = importer.import_archives(spark, str(folder), "2024-02", root, srid=2154)
    assert r.by_type["edi_parcelles"] == {"inserted": 2, "duplicates": 0, "known": 4, "invalid": 0} and r.status == "Success"
    assert json.loads(r.to_json())["imported"] == 4 and "imported" in r.summary() and "Success" in r.display()
    assert importer.read_table(spark, root, "edi_parcelles").count() == 8
    out = tmp_path / "geo"
    assert importer.export_geojson(spark, str(folder), str(out), 4326) == {"features": 15, "files": 12, "errors": 0}
    doc = json.loads((out / "edigeo-39000000AA01" / "parcelle_id.geojson").read_text())
    assert doc["crs"]["properties"]["name"] == "urn:ogc:def:crs:EPSG::4326" and len(doc["features"]) == 2
    assert doc["features"][0]["id"] == "000AA2" and doc["features"][0]["properties"] == {"_id": "000AA2", "IDU": "000AA2", "SUPF": "+2.", "TEX": "é2", "TEX2": "L'Île"}
    with pytest.raises(FileNotFoundError):
        importer.import_archives(spark, str(out), "2024-01", root)
    with pytest.raises(ValueError):
        importer.import_archives(spark, str(folder), "2024-1", root)


def test_lost_ledger_commit_adds_nothing_twice(spark, folder, tmp_path):
    root = f"file://{tmp_path}/tables"
    importer.import_archives(spark, str(folder), "2024-01", root)
    ledger = importer.VersionedTable(spark, f"{root}/_ledger")
    ledger.commit(ledger.version(), like=0)  # as if the run had died before it
    assert importer.read_table(spark, root, "edi_parcelles") is None
    r = importer.import_archives(spark, str(folder), "2024-01", root)
    assert r.archives_processed == 4 and r.imported == 12 and importer.read_table(spark, root, "edi_parcelles").count() == 6


@pytest.mark.parametrize("mode", ["scd2", "mark_upsert"])
def test_import_modes_and_blake3(spark, tmp_path, mode):
    (tmp_path / "in").mkdir()
    root, at = f"file://{tmp_path}/tables", tmp_path / "in" / "edigeo-39001000AA01.tar.bz2"
    take = lambda month: importer.import_archives(spark, str(tmp_path / "in"), month, root, srid=2154, hash="blake3", mode=mode)
    archive(at, 1)
    take("2024-01")
    t = importer.read_table(spark, root, "edi_parcelles").withColumn("again", geometry.blake3_hash(F.col("geom")))
    assert t.count() == 2 and t.filter("again = geometry_hash").count() == 2
    archive(at, 1, 1.0)
    r = take("2024-02")
    assert r.by_type["edi_parcelles"]["inserted"] == 2
    got = {(str(x.valid_from), x.valid_to and str(x.valid_to)) for x in importer.read_table(spark, root, "edi_parcelles").collect()}
    assert got == ({("2024-01-01", "2024-02-01"), ("2024-02-01", None)} if mode == "scd2" else {("2024-01-01", None)})
    with pytest.raises(ValueError):
        importer.import_archives(spark, str(at), "2024-03", root, mode="other")


def test_stream_equals_batch(spark, folder, tmp_path):
    sink, check = str(tmp_path / "sink"), str(tmp_path / "check")
    run = lambda: streaming.run_available(streaming.stream_features(spark, str(folder)), check, streaming.once_per_batch(sink)).awaitTermination(120)
    run()
    assert archives.only_features(spark.read.parquet(sink)).count() == 15 and archives.only_errors(spark.read.parquet(sink)).count() == 1
    archive(folder / "edigeo-39009000AA01.tar.bz2", 9)
    run()
    assert archives.only_features(spark.read.parquet(sink)).count() == 20


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def test_as_of_and_latest(spark):
    t = rows(spark, ("H", "39", "g1", H[1], date(2020, 1, 1), date(2022, 1, 1)), ("H", "39", "g2", H[2], date(2022, 1, 1), date(2024, 1, 1)))
    assert [[r.geometry for r in versioning.as_of(t, d).collect()] for d in ("2021-06-15", "2023-06-15", "2025-06-15", "2022-01-01")] == [["g1"], ["g2"], [], ["g2"]]
    assert versioning.latest(t).first().geometry == "g2" and versioning.active(t).count() == 0 and versioning.ended_at(t, "2022-01-01").count() == 1


def test_steps(spark):
    old = date(2024, 1, 1)
    t = rows(spark, ("same", "39", "g1", H[1], old, None), ("moved", "39", "g2", H[2], old, None), ("gone", "39", "g3", H[3], old, None), ("none", "39", None, None, old, None))
    new = t.filter("id in ('same', 'none')").unionByName(rows(spark, ("moved", "39", "g4", H[4], None, None), ("fresh", "39", "g5", H[5], None, None))).select("id", "departement", "geometry", "geometry_hash")
    marked, acts = versioning.mark_and_upsert(t, new, "2025-01-01")
    assert {tuple(r) for r in acts.collect()} == {("same", "Unchanged"), ("none", "Unchanged"), ("moved", "Updated"), ("fresh", "Inserted")}
    assert {(r.id, r.geometry, str(r.valid_from), r.valid_to and str(r.valid_to)) for r in marked.collect()} == {("same", "g1", "2024-01-01", None), ("none", None, "2024-01-01", None), ("moved", "g4", "2024-01-01", None), ("gone", "g3", "2024-01-01", "2025-01-01"), ("fresh", "g5", "2025-01-01", None)}
    closed, acts = versioning.close_and_insert(t, new, "2025-01-01")
    assert {(r.id, r.geometry, str(r.valid_from), r.valid_to and str(r.valid_to)) for r in closed.collect()} == {("same", "g1", "2024-01-01", None), ("none", None, "2024-01-01", None), ("moved", "g2", "2024-01-01", "2025-01-01"), ("moved", "g4", "2025-01-01", None), ("gone", "g3", "2024-01-01", None), ("fresh", "g5", "2025-01-01", None)}
    twice, _ = versioning.close_and_insert(t, new, "2024-01-01")
    assert twice.filter("id = 'moved'").count() == 1  # a version without length is dropped
    assert {tuple(r) for r in versioning.action_counts(acts).collect()} == {("Unchanged", 2), ("Updated", 1), ("Inserted", 1)}


def test_merge_and_hashes(spark):
    d = date(2024, 1, 1)
    t = rows(spark, ("a", "39", "g", H[1], d, None))
    new = rows(spark, ("a", "39", "x", H[2], d, None), ("b", "39", "y", H[3], d, None), ("b", "39", "z", H[4], d, None), (None, "39", "n", None, d, None), (None, "39", "n", None, d, None))
    got = sorted((r.id or "", r.geometry) for r in versioning.merge_absent(new, t, order=("geometry_hash",)).collect())
    assert got == [("", "n"), ("", "n"), ("b", "y")]
    assert versioning.new_by_hash(new, rows(spark, ("q", "1", "", H[3], d, None))).count() == 4
    assert versioning.append_versions(new, t, "2024-01-01").count() == 3


def test_status_and_rows_for_bulk_load(spark):
    s = lambda f, e, ok: spark.range(1).select(versioning.status(F.lit(f), F.lit(e), F.lit(ok))).first()[0]
    assert [s(0, 0, 1), s(0, 1, 1), s(0, 1, 0), s(1, 0, 5), s(0, 0, 0)] == ["Success", "PartialSuccess", "Failed", "Failed", "Success"]
    df = spark.createDataFrame([("a|b", None, "", 'q"', bytearray(b"\x01\xff"), 5)], "a string, b string, c string, d string, e binary, f int")
    assert sinks.delimited(df).first()[0] == '"a|b"||""|"q"""|\\x01ff|5'
    assert sinks.Database(host="h", ssl="require").options("t")["url"] == "jdbc:postgresql://h:5432/cadastre?sslmode=require"


def test_reprojection_errors_drop_the_geometry(spark, folder):
    good = archives.only_features(archives.parse_files(archives.read_files(spark, str(folder / "deep"))))
    assert importer.reprojected(good, 4326).filter("geom is null").count() == 0
    assert importer.reprojected(good.withColumn("epsg", F.lit(9)), 4326).filter("geom is null").count() == 15
