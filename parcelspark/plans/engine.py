"""Queries for the engine's own operators, over whole tables, with their SQL.

Geometries with closed forms come from orders: a square at 25.25 m steps, side 5 + o_orderkey % 17.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, projection, records, text
from ..functions.geometry import GEOM
from ..operators import references, topology, versioning
from ..session import table
from ..streaming.archives import events_by_window

_NAMES = list(text.PROJECTIONS)


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), (F.lit(600000) + k % 1000 * 25.25).alias("x"), (F.lit(6600000) + F.floor(k / 1000) * 25.25).alias("y"), (5 + k % 17).cast("double").alias("side"))


def _squares(spark: SparkSession, d: str) -> DataFrame:
    a = _anchors(spark, d)
    x, y, s = F.col("x"), F.col("y"), F.col("side")
    ring = F.array(*[F.struct(px.alias("x"), py.alias("y")) for px, py in ((x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y))])
    return a.withColumn("geom", F.struct(F.lit("Polygon").alias("kind"), F.array(F.array(ring)).alias("parts")))


# -- names and texts


def archive_names(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("archive_name")
    return table(spark, d, "archive_files").select("archive_name").distinct().select(
        "archive_name", text.department(n).alias("dep"), text.department_from_file(n).alias("dep_file"), text.basename(n).alias("base")
    )


def thf_records(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("BOMT 12:x\r\nCSETCC06:"), F.coalesce("encoding", F.lit("")), F.lit("\r\n"), F.coalesce(F.concat(F.lit("TDASDP08:"), F.col("year").cast("string"), F.lit("0101\r\n")), F.lit("")))
    return table(spark, d, "thf_data").select("archive_name", text.charset(t).alias("codec"), text.thf_year(t).alias("year"))


def geo_projections(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in [*_NAMES, "UNKNOWN"]])
    k = F.col("o_orderkey")
    n = F.element_at(names, (k % len([*_NAMES, 0]) + 1).cast("int"))
    geo = F.when(k % 3 == 0, F.concat(F.lit("BOMT 12:x\nRELSACC06:"), n, F.lit("\n"))).when(k % 3 == 1, F.concat(F.lit("RELSA:"), F.lower(n))).otherwise(F.concat(F.lit("TEXT\r\nSYS "), n, F.lit(" x\r\nOLD LAMB93\r\n")))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(text.epsg(geo), F.lit(0)).alias("epsg"))


def parse_references(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "vec_references")
    v = F.concat_ws(";", F.coalesce("sid", F.lit("")), F.coalesce("gid", F.lit("")), F.coalesce("rty", F.lit("")), F.coalesce("rid", F.lit("")))
    return r.select("ref_id", text.reference(v).alias("r")).select("ref_id", "r.*")


def parse_coordinates(spark: SparkSession, d: str) -> DataFrame:
    v = F.concat(F.lit("+"), F.col("x").cast("string"), F.when(F.col("id") % 5 == 0, ",").otherwise(";"), F.lit("+"), F.col("y").cast("string"), F.lit(";"))
    return _anchors(spark, d).select("id", text.coordinate(v).alias("c")).select("id", "c.x", "c.y")


def number_cleaning(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("properties")
    f = table(spark, d, "features").filter(p["SUPF"].isNotNull() | p["INDP"].isNotNull())
    return f.select("archive_name", "vec_seq", "feature_id", text.number(p["SUPF"]).alias("supf"), text.integer(p["INDP"]).cast("double").alias("indp"), text.number(F.concat(F.lit("+"), p["SUPF"], F.lit("."))).alias("signed")).distinct()


def type_routing(spark: SparkSession, d: str) -> DataFrame:
    from .config import load

    routes = spark.createDataFrame([(k, t.name) for t in load("full") for k in t.types], "kind string, table_name string")
    f = table(spark, d, "features").withColumn("kind", text.normal_type(F.col("feature_type")))
    return f.join(F.broadcast(routes), "kind", "left").groupBy(F.coalesce("table_name", F.lit("(none)")).alias("table_name"), text.legacy_table(F.col("feature_type")).alias("legacy")).agg(F.count("*").alias("features"))


def encoded_parcels(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows as table rows, with the archive's commune and section."""
    from .config import load
    from .importer import archive_constants, encode

    f = table(spark, d, "features").withColumn("path", F.col("archive_name"))
    f = f.withColumn("link_pos", F.regexp_extract("feature_id", "([0-9]+)$", 1).try_cast("int"))
    f = f.join(archive_constants(f), "path").withColumn("departement", text.department(F.col("archive_name"))).withColumn("geom", F.lit(None).cast(GEOM)).withColumn("geometry_hash", F.lit(None).cast("binary"))
    t = next(t for t in load("full") if t.name == "edi_parcelles")
    return encode(f, t).drop("geom", "geometry_hash").fillna(-1, ["contenance", "indp"]).distinct()


# -- projections


def _projected(source: int, target: int, dx: float = 0, dy: float = 0):
    def run(spark: SparkSession, d: str) -> DataFrame:
        px, py = projection.transformer(source, target)(F.col("x") + dx, F.col("y") + dy)
        digits = 6 if target == 4326 else 2
        return _anchors(spark, d).select("id", F.round(px, digits).alias("px"), F.round(py, digits).alias("py"))

    return run


def rounded_vertices(spark: SparkSession, d: str) -> DataFrame:
    g = geometry.rounded(geometry.map_vertices(F.col("geom"), lambda x, y: (x / 7, y / 7)), 2)
    v = F.flatten(F.flatten(g["parts"]))
    return _squares(spark, d).select("id", v[2]["x"].alias("x2"), v[2]["y"].alias("y2"))


# -- geometry


def square_texts(spark: SparkSession, d: str) -> DataFrame:
    return _squares(spark, d).select("id", geometry.to_ewkt(F.col("geom"), 2154).alias("ewkt"), geometry.to_geojson(F.col("geom")).alias("geojson"), geometry.area(F.col("geom")).alias("area"))


def parcel_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Kind, vertices, parts and bounding box of every parcel geometry, and whether it is valid."""
    g = table(spark, d, "parcelles").select("row_id", geometry.from_wkt(F.col("geometry")).alias("g")).filter(F.col("g").isNotNull())
    return g.select("row_id", "g.kind", geometry.vertices(F.col("g")).alias("vertices"), F.size("g.parts").alias("parts"), geometry.bbox(F.col("g")).alias("b"), geometry.is_valid(F.col("g")).alias("valid")).select("row_id", "kind", "vertices", "parts", "b.xmin", "b.ymax", "valid")


def hash_classes(spark: SparkSession, d: str) -> DataFrame:
    """Our hash against the delivered one: per commune, distinct shapes by either and by both together."""
    p = table(spark, d, "parcelles").filter(F.col("geometry_hash").isNotNull())
    p = p.select("commune_id", "geometry_hash", geometry.geometry_hash(geometry.rounded(geometry.from_wkt(F.col("geometry")), 2)).alias("own")).filter(F.col("own").isNotNull())
    return p.groupBy("commune_id").agg(F.count_distinct("geometry_hash").alias("delivered"), F.count_distinct("own").alias("computed"), F.count_distinct("own", "geometry_hash").alias("pairs"))


def interop_hashes(spark: SparkSession, d: str) -> DataFrame:
    """BLAKE3 hashes and EWKB of all parcels' geometries; SQL has neither."""
    p = table(spark, d, "parcelles").select("row_id", geometry.from_wkt(F.col("geometry")).alias("g")).filter(F.col("g").isNotNull())
    return p.select("row_id", F.hex(geometry.blake3_hash(F.col("g"))).alias("blake3"), F.hex(geometry.to_ewkb(F.col("g"), 2154)).alias("ewkb"))


def _built(holes: bool):
    """Write squares as archive text, one text per customer, parse it, build it; with ``holes`` each has a hole of half its side."""

    def build(batch: pa.Table) -> pa.Table:
        arcs: dict[str, list] = {}
        faces: dict[str, list[str]] = {}
        business = []
        for i, x, y, s in zip(*(batch[c].to_pylist() for c in ("id", "x", "y", "side"))):
            corners = [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
            names = []
            for k in range(4):  # every other arc runs backwards
                a = [corners[k], corners[(k + 1) % 4]]
                arcs[f"Arc_{i}_{k}"] = a[::-1] if (i + k) % 2 else a
                names.append(f"Arc_{i}_{k}")
            if holes:
                q = s / 4
                h = [(x + q, y + q), (x + 3 * q, y + q), (x + 3 * q, y + 3 * q), (x + q, y + 3 * q), (x + q, y + q)]
                arcs[f"Arc_{i}_h"] = h
                names.append(f"Arc_{i}_h")
            faces[f"Face_{i}"] = names[i % 4 :] + names[: i % 4]
            business.append((f"Objet_{i}", "PARCELLE_id", {"IDU": str(i), "SUPF": f"+{s * s:.0f}."}, "PFE", [f"Face_{i}"]))
        vec = records.parse_vec(records.write_vec(arcs, faces, business))
        rows = [{"id": int(f.id), "supf": f.properties["SUPF"], "geom": f.geom} for f in records.features(vec, {}) if isinstance(f, records.Feature)]
        vertex = pa.struct([("x", pa.float64()), ("y", pa.float64())])
        return pa.Table.from_pylist(rows, pa.schema([("id", pa.int64()), ("supf", pa.string()), ("geom", pa.struct([("kind", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(vertex))))]))]))

    def run(spark: SparkSession, d: str) -> DataFrame:
        # a text holds a thousand objects, as many as an archive may
        a = _anchors(spark, d).withColumn("archive", F.floor(F.col("id") / 1000))
        # little data, much work: a fixed number of partitions, which AQE leaves alone
        a = a.repartition(2 * spark.sparkContext.defaultParallelism, "archive")
        f = a.groupBy("archive").applyInArrow(build, f"id long, supf string, geom {GEOM}")
        return f.select("id", text.number(F.col("supf")).alias("supf"), "geom.kind", F.size(F.col("geom.parts")[0]).alias("rings"), geometry.vertices(F.col("geom")).alias("vertices"), F.round(geometry.area(F.col("geom")), 3).alias("area"))

    return run


def line_features(spark: SparkSession, d: str) -> DataFrame:
    """Multi-lines of the squares' sides: as many vertices and as long as they were."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, x, y, s in zip(*(b.column(c).to_pylist() for c in ("id", "x", "y", "side"))):
                g = topology.line([[(x, y), (x + s, y)], [(x, y)], [(x + s, y), (x + s, y + s), (x, y + s)]], False)
                out.append((i, g["kind"], len(g["parts"]), sum(len(p[0]) for p in g["parts"])))
            c = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, (pa.int64(), pa.string(), pa.int32(), pa.int32()))], names=["id", "kind", "lines", "vertices"])

    return _anchors(spark, d).mapInArrow(build, "id long, kind string, lines int, vertices int")


def endpoint_degrees(spark: SparkSession, d: str) -> DataFrame:
    """How many arc ends meet at a place, for the sides of all squares that touch."""
    x, y = F.col("x"), F.col("y")
    ends = _anchors(spark, d).select(F.explode(F.array(*[F.struct((x + 25.25 * a).alias("x"), (y + 25.25 * b).alias("y")) for a, b in ((0, 0), (1, 0), (1, 0), (1, 1), (1, 1), (0, 1), (0, 1), (0, 0))])).alias("e"))
    n = ends.groupBy(F.round("e.x", 6).alias("x"), F.round("e.y", 6).alias("y")).agg(F.count("*").alias("degree"))
    return n.groupBy("degree").agg(F.count("*").alias("places"))


# -- ledger and versions


def archive_skip(spark: SparkSession, d: str) -> DataFrame:
    """Listed files whose (name, checksum) the ledger doesn't have; without a checksum they are always taken."""
    return table(spark, d, "archive_files").join(table(spark, d, "archive_checksums").select("archive_name", "checksum").distinct(), ["archive_name", "checksum"], "left_anti").select("file_seq", "archive_name")


def _clean_parcels(spark: SparkSession, d: str) -> DataFrame:
    """One open row per parcel: the latest, with what versioning needs."""
    p = table(spark, d, "parcelles").filter(F.col("geometry_hash").isNotNull())
    return versioning.latest(p.select("id", "departement", "geometry", "geometry_hash", "contenance", "valid_from", "valid_to", "row_id"), "row_id").drop("row_id")


def _delivery(spark: SparkSession, d: str) -> DataFrame:
    """One row per id to import: of known parcels the first row that has an area, and all delivered ones.

    So some ids are unchanged, some changed, some new, and those without an area vanish."""
    p = table(spark, d, "parcelles").filter(F.col("geometry_hash").isNotNull() & F.col("contenance").isNotNull())
    cols = ["id", "departement", "geometry", "geometry_hash", "contenance"]
    first = p.groupBy("id").agg(F.min_by(F.struct(*cols), F.struct("valid_from", "row_id")).alias("r")).select("r.*")
    l = table(spark, d, "parcelles_livraisons").filter(F.col("geometry_hash").isNotNull())
    last = versioning.latest(l.select(F.upper(F.trim("id")).alias("id"), *cols[1:], "valid_from", "row_id"), "row_id").select(cols)
    return first.unionByName(last.join(first, "id", "left_anti"))


def hash_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return versioning.new_by_hash(table(spark, d, "parcelles_livraisons"), table(spark, d, "parcelles")).select("row_id")


def merge_absent(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "parcelles_livraisons").select("departement", "id", "valid_from", "row_id")
    return versioning.merge_absent(l, table(spark, d, "parcelles"), order=("row_id",)).withColumn("valid_from", F.date_format("valid_from", "yyyy-MM-dd"))


def append_versions(spark: SparkSession, d: str) -> DataFrame:
    return versioning.append_versions(_delivery(spark, d).drop("geometry"), table(spark, d, "parcelles"), "2030-01-01").select("id", "departement", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"))


def _step(way: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        step = versioning.mark_and_upsert if way == "mark" else versioning.close_and_insert
        rows, _ = step(_clean_parcels(spark, d), _delivery(spark, d), "2030-01-01")
        return rows.select("id", F.hex("geometry_hash").alias("hash"), F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"))

    return run


def upsert_actions(spark: SparkSession, d: str) -> DataFrame:
    return versioning.action_counts(versioning.mark_and_upsert(_clean_parcels(spark, d), _delivery(spark, d), "2030-01-01")[1])


def scd2_history(spark: SparkSession, d: str) -> DataFrame:
    """State per user and month from events: the last event type of the month, as history."""
    e = table(spark, d, "events").filter(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    m = e.groupBy("user_id", F.trunc(F.col("ts").cast("date"), "month").alias("month")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    h = versioning.scd2_history(m, ("user_id",), "state", "month")
    return h.withColumn("valid_from", F.date_format("valid_from", "yyyy-MM-dd")).withColumn("valid_to", F.date_format("valid_to", "yyyy-MM-dd"))


def as_of(spark: SparkSession, d: str) -> DataFrame:
    return versioning.as_of(table(spark, d, "parcelles"), "2023-06-15").groupBy("departement").agg(F.count("*").alias("rows_valid"), F.count_distinct("id").alias("parcels"))


def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    """For each day on which a row of a parcel was made, the versions valid that day, by id and day."""
    p = table(spark, d, "parcelles")
    l = p.filter(F.col("created_at").isNotNull()).select("id", F.col("created_at").cast("date").alias("day")).distinct()
    j = l.join(p.select("id", "valid_from", "valid_to", "row_id"), "id").filter((F.col("valid_from") <= F.col("day")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("day"))))
    return j.groupBy("id", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("versions"), F.max("row_id").alias("row_id"))


def latest_versions(spark: SparkSession, d: str) -> DataFrame:
    return versioning.latest(table(spark, d, "parcelles").select("id", "valid_from", "row_id", "numero"), "row_id").select("id", "row_id", "numero")


def ended_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows that end on a day, per table, and those open."""
    parts = [table(spark, d, t).select(F.lit(t).alias("table_name"), "valid_to") for t in ("parcelles", "sections", "communes")]
    return reduce(DataFrame.unionByName, parts).groupBy("table_name", F.coalesce(F.date_format("valid_to", "yyyy-MM-dd"), F.lit("open")).alias("ended")).agg(F.count("*").alias("n"))


def import_report(spark: SparkSession, d: str) -> DataFrame:
    """Per run: archives, departments, and the status that follows from its counts."""
    c = table(spark, d, "archive_checksums").groupBy("run_id").agg(F.count("*").alias("archives"), F.count_distinct(text.department(F.col("archive_name"))).alias("departments"))
    r = table(spark, d, "import_runs").join(c, "run_id", "left").fillna(0, ["archives", "departments"])
    failed = (F.coalesce("status", F.lit("Crashed")) != "Success").cast("int")
    return r.select("run_id", "archives", "departments", versioning.status(F.col("finished_at").isNull().cast("int"), failed, F.col("archives")).alias("outcome"))


def orphan_keys(spark: SparkSession, d: str) -> DataFrame:
    """Members that name an existing object, per type: what the links resolve to."""
    r = references.reference_rows(table(spark, d, "vec_references"), table(spark, d, "vec_objects"))
    lost = references.orphan_references(table(spark, d, "vec_references"), table(spark, d, "vec_objects")).select("origin", "key_id", "rid").distinct()
    return r.select("origin", "key_id", "rid").distinct().join(lost, ["origin", "key_id", "rid"], "left_anti").groupBy("origin").agg(F.count("*").alias("resolved"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    w = events_by_window(table(spark, d, "events"))
    return w.select(F.date_format("from_ts", "yyyy-MM-dd HH:mm:ss").alias("from_ts"), "event_type", "n", F.round("total", 4).alias("total"))


_PROJECTED = {
    "l93_to_wgs84": _projected(2154, 4326),
    "l93_to_mercator": _projected(2154, 3857),
    "cc46_to_wgs84": _projected(3946, 4326, 1000000, -1400000),
    "utm20n_to_wgs84": _projected(32620, 4326, 0, -5000000),
    "utm38s_to_wgs84": _projected(32738, 4326, 0, 1900000),
}
QUERIES = {
    f.__name__: f
    for f in (
        archive_names, thf_records, geo_projections, parse_references, parse_coordinates, number_cleaning, type_routing, encoded_parcels, rounded_vertices, square_texts, parcel_shapes, hash_classes, interop_hashes,
        line_features, endpoint_degrees, archive_skip, hash_antijoin, merge_absent, append_versions, upsert_actions, scd2_history, as_of, as_of_join, latest_versions, ended_counts, import_report, orphan_keys, event_windows,
    )
} | _PROJECTED | {"parse_faces": _built(False), "faces_with_holes": _built(True), "mark_and_upsert": _step("mark"), "close_and_insert": _step("close")}

# ------------------------------------------------------------------------------------------------ SQL

_A = "a as (select o_orderkey id, 600000 + (o_orderkey % 1000) * 25.25::double x, 6600000 + (o_orderkey // 1000) * 25.25::double y, (5 + o_orderkey % 17)::double side from orders)"


def _conic_sql(ell: projection.Ellipsoid, lat0: float, p1: float, p2: float, fe: float, fn: float, dx: float, dy: float, out: str) -> str:
    e = f"sqrt({ell.e2!r})"
    m = lambda p: f"(cos(radians({p})) / sqrt(1 - {ell.e2!r} * pow(sin(radians({p})), 2)))"
    t = lambda p: f"(tan(pi() / 4 - radians({p}) / 2) / pow((1 - {e} * sin(radians({p}))) / (1 + {e} * sin(radians({p}))), {e} / 2))"
    steps = "".join(f", s{i} as (select *, pi() / 2 - 2 * atan(q * pow((1 - {e} * sin(l{i - 1})) / (1 + {e} * sin(l{i - 1})), {e} / 2)) l{i} from s{i - 1})" for i in range(1, 8))
    return f"""with {_A}, k as (select *, {ell.a} * m1 / (n * pow(t1, n)) c from (select *, (ln(m1) - ln(m2)) / (ln(t1) - ln(t2)) n from
 (select {m(p1)} m1, {m(p2)} m2, {t(p1)} t1, {t(p2)} t2, {t(lat0)} t0))),
d as (select id, n, c, x + {dx} - {fe} dx, {fn} + c * pow(t0, n) - (y + {dy}) dy from a, k),
s0 as (select *, pi() / 2 - 2 * atan(q) l0 from (select id, degrees(atan2(dx, dy) / n + radians(3)) lon, pow(sqrt(dx * dx + dy * dy) / c, 1 / n) q from d)){steps}
{out.format(lat="degrees(l7)")} from s7"""


def _utm_sql(zone: int, south: bool, dy: float) -> str:
    """The series term by term, in the third flattening n."""
    f = 1 / projection.WGS84.inverse_flattening
    n = f / (2 - f)
    beta = (f"({n!r} / 2 - 2 * pow({n!r}, 2) / 3 + 37 * pow({n!r}, 3) / 96 - pow({n!r}, 4) / 360)", f"(pow({n!r}, 2) / 48 + pow({n!r}, 3) / 15 - 437 * pow({n!r}, 4) / 1440)", f"(17 * pow({n!r}, 3) / 480 - 37 * pow({n!r}, 4) / 840)", f"(4397 * pow({n!r}, 4) / 161280)")
    delta = (f"(2 * {n!r} - 2 * pow({n!r}, 2) / 3 - 2 * pow({n!r}, 3) + 116 * pow({n!r}, 4) / 45)", f"(7 * pow({n!r}, 2) / 3 - 8 * pow({n!r}, 3) / 5 - 227 * pow({n!r}, 4) / 45)", f"(56 * pow({n!r}, 3) / 15 - 136 * pow({n!r}, 4) / 35)", f"(4279 * pow({n!r}, 4) / 630)")
    cosh, sinh = "((exp({0}) + exp(-({0}))) / 2)", "((exp({0}) - exp(-({0}))) / 2)"
    u = "xi" + "".join(f" - {b} * sin({2 * k} * xi) * {cosh.format(f'{2 * k} * eta')}" for k, b in enumerate(beta, 1))
    v = "eta" + "".join(f" - {b} * cos({2 * k} * xi) * {sinh.format(f'{2 * k} * eta')}" for k, b in enumerate(beta, 1))
    lat = "chi" + "".join(f" + {d} * sin({2 * k} * chi)" for k, d in enumerate(delta, 1))
    return f"""with {_A}, r as (select id, (y + {dy} - {1e7 if south else 0.0}) / q xi, (x - 500000) / q eta from (select *, 0.9996 * 6378137.0 / (1 + {n!r}) * (1 + pow({n!r}, 2) / 4 + pow({n!r}, 4) / 64) q from a)),
u as (select id, {u} u, {v} v from r), c as (select *, asin(sin(u) / {cosh.format('v')}) chi from u)
select id, round(degrees(atan2({sinh.format('v')}, cos(u)) + radians({6 * zone - 183})), 6) px, round(degrees({lat}), 6) py from c"""


_DEG = "select id, round(lon, 6) px, round({lat}, 6) py"
_MERC = "select id, round(radians(lon) * 6378137.0, 2) px, round(ln(tan(pi() / 4 + radians({lat}) / 2)) * 6378137.0, 2) py"
_CLEAN = r"nullif(regexp_replace(regexp_replace(trim({0}), '^\++', ''), '\.$', ''), '')"
_KINDS = "('COMMUNE','edi_communes'),('SECTION','edi_sections'),('SUBDSECT','edi_subsections'),('PARCELLE','edi_parcelles'),('BATIMENT','edi_batiments'),('SUBDFISC','edi_subdivisions_fiscales'),('TSURF','edi_tsurf'),('TLINE','edi_tline'),('TPOINT','edi_tpoint'),('NUMVOIE','edi_numvoie')"
_CUR = "cur as (select id, departement, geometry_hash h, valid_from, valid_to from parcelles where geometry_hash is not null qualify row_number() over (partition by id order by valid_from desc, row_id desc) = 1)"
_DEL = """fst as (select id, departement, geometry_hash h from parcelles where geometry_hash is not null and contenance is not null qualify row_number() over (partition by id order by valid_from, row_id) = 1),
lst as (select upper(trim(id, ' ')) id, departement, geometry_hash h from parcelles_livraisons where geometry_hash is not null qualify row_number() over (partition by upper(trim(id, ' ')) order by valid_from desc, row_id desc) = 1),
del as (select * from fst union all select * from lst anti join fst using (id))"""
_HEX = "upper(hex({0}))"

ORACLE = {
    "archive_names": r"""select archive_name, coalesce(nullif(regexp_extract(regexp_replace(regexp_replace(archive_name, '\.[^.]*$', ''), '\.tar$', ''), 'EDIGEO-(..)', 1), ''), nullif(regexp_extract(archive_name, '^[^-]*-([0-9]{2}|2[AB])', 1), ''), '00') dep,
 coalesce(nullif(regexp_extract(archive_name, '^edigeo-(2[AB]|9[78][0-9]|[0-9]{2})', 1), ''), '00') dep_file, regexp_replace(archive_name, '\.(tar\.bz2|bz2|tar)$', '') base from (select distinct archive_name from archive_files)""",
    "thf_records": "select archive_name, case when upper(trim(encoding)) = '8859-9' then 'cp1254' when upper(trim(encoding)) in ('8859-2','8859-3','8859-4','8859-5','8859-6','8859-7','8859-8') then 'iso' || upper(trim(encoding)) else 'iso8859-15' end codec, coalesce(year, 2020) as year from thf_data",
    "geo_projections": "with n(i, name, code) as (values " + ",".join(f"({i},'{n}',{c})" for i, (n, c) in enumerate(text.PROJECTIONS.items())) + f") select o_orderkey, coalesce(code, case when o_orderkey % 3 = 2 then 2154 else 0 end) epsg from orders left join n on o_orderkey % {len(_NAMES) + 1} = i",
    "parse_references": "select ref_id, coalesce(sid, '') sid, coalesce(gid, '') gid, coalesce(rty, '') rty, coalesce(rid, '') rid from vec_references",
    "parse_coordinates": f"with {_A} select id, case when id % 5 <> 0 then x end x, case when id % 5 <> 0 then y end y from a",
    "number_cleaning": f"select distinct archive_name, vec_seq, feature_id, try_cast({_CLEAN.format("properties['SUPF']")} as double) supf, trunc(try_cast({_CLEAN.format("properties['INDP']")} as double)) indp, try_cast({_CLEAN.format("'+' || properties['SUPF'] || '.'")} as double) signed from features where properties['SUPF'] is not null or properties['INDP'] is not null",
    "type_routing": f"""with r(kind, table_name) as (values {_KINDS}) select coalesce(table_name, '(none)') table_name,
 case when upper(feature_type) like '%PARCELLE%' then 'parcelles' when upper(feature_type) like '%SECTION%' then 'sections' when upper(feature_type) like '%COMMUNE%' then 'communes' when upper(feature_type) like '%BATI%' then 'batiments'
 when upper(feature_type) like '%LIEU%' then 'lieux_dits' when upper(feature_type) like '%SUBDFISC%' then 'subdivisions_fiscales' else 'parcelles' end legacy, count(*) features
 from features f left join r on regexp_replace(upper(trim(feature_type)), '_ID$', '') = r.kind group by 1, 2""",
    "encoded_parcels": f"""with f as (select *, try_cast(regexp_extract(feature_id, '([0-9]+)$', 1) as int) pos, regexp_extract(archive_name, '^[^-]*-([0-9]{{2}}|2[AB])', 1) dep from features),
c as (select archive_name, coalesce(arg_min(coalesce(properties['IDU'], ''), (vec_seq, pos)) filter (feature_type = 'COMMUNE_id'), '') com, coalesce(arg_min(coalesce(properties['IDU'], ''), (vec_seq, pos)) filter (feature_type = 'SECTION_id'), '') sec from f group by 1)
select distinct dep || feature_id id, dep departement, regexp_replace(coalesce(properties['TEX'], ''), '[\\r\\n]', ' ', 'g') numero, case when com <> '' then dep || com else '' end commune_id, case when sec <> '' then dep || sec else '' end section_id,
 coalesce(cast(trunc(try_cast({_CLEAN.format("properties['SUPF']")} as double)) as int), -1) contenance, coalesce(cast(trunc(try_cast({_CLEAN.format("properties['INDP']")} as double)) as int), -1) indp
 from f join c using (archive_name) where feature_type = 'PARCELLE_id'""",
    "rounded_vertices": f"with {_A} select id, round((x + side) / 7 * 100.0) / 100.0 x2, round((y + side) / 7 * 100.0) / 100.0 y2 from a",
    "square_texts": f"""with {_A}, n as (select *, regexp_replace(regexp_replace(x::decimal(18,2)::varchar, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') x0, regexp_replace(regexp_replace((x + side)::decimal(18,2)::varchar, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') x1,
 regexp_replace(regexp_replace(y::decimal(18,2)::varchar, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') y0, regexp_replace(regexp_replace((y + side)::decimal(18,2)::varchar, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') y1 from a)
select id, 'SRID=2154;POLYGON((' || x0 || ' ' || y0 || ',' || x1 || ' ' || y0 || ',' || x1 || ' ' || y1 || ',' || x0 || ' ' || y1 || ',' || x0 || ' ' || y0 || '))' ewkt,
 '{{"type":"Polygon","coordinates":[[[' || x0 || ',' || y0 || '],[' || x1 || ',' || y0 || '],[' || x1 || ',' || y1 || '],[' || x0 || ',' || y1 || '],[' || x0 || ',' || y0 || ']]]}}' geojson, side * side area from n""",
    "parcel_shapes": r"""with g as (select row_id, upper(regexp_replace(geometry, '(?i)^\s*srid\s*=\s*[0-9]+\s*;\s*', '')) t from parcelles where geometry like '%(%'),
v as (select row_id, t, regexp_extract_all(t, '[-0-9.]+ +[-0-9.]+') p from g)
select row_id, case when t like 'MULTI%' then 'MultiPolygon' else 'Polygon' end kind, len(p) vertices, case when t like 'MULTI%' then len(regexp_extract_all(t, '\)\s*\)\s*,')) + 1 else 1 end parts,
 list_min(list_transform(p, lambda s: split_part(regexp_replace(s, ' +', ' '), ' ', 1)::double)) xmin, list_max(list_transform(p, lambda s: split_part(regexp_replace(s, ' +', ' '), ' ', 2)::double)) ymax, true as valid from v""",
    "hash_classes": "select commune_id, count(distinct geometry_hash) delivered, count(distinct geometry_hash) computed, count(distinct geometry_hash) pairs from parcelles where geometry_hash is not null and geometry like '%(%' group by 1",
    "line_features": "select o_orderkey id, 'MultiLineString' kind, 2 as lines, 5 as vertices from orders",
    "endpoint_degrees": f"""with {_A}, e as (select round(x + 25.25 * i, 6) ex, round(y + 25.25 * j, 6) ey from a, (values (0, 0), (1, 0), (1, 0), (1, 1), (1, 1), (0, 1), (0, 1), (0, 0)) t(i, j))
select degree, count(*) places from (select count(*) degree from e group by ex, ey) group by 1""",
    "archive_skip": "select file_seq, archive_name from archive_files f where not exists (select 1 from archive_checksums l where l.archive_name = f.archive_name and l.checksum = f.checksum)",
    "hash_antijoin": "select row_id from parcelles_livraisons l where not exists (select 1 from parcelles p where p.geometry_hash = l.geometry_hash)",
    "merge_absent": "select departement, id, strftime(valid_from, '%Y-%m-%d') valid_from, min(row_id) row_id from parcelles_livraisons l where not exists (select 1 from parcelles p where p.departement = l.departement and p.id = l.id and p.valid_from = l.valid_from) group by all",
    "append_versions": f"with {_DEL} select distinct id, departement, '2030-01-01' valid_from from del where not exists (select 1 from parcelles p where p.geometry_hash = del.h)",
    "upsert_actions": f"with {_CUR}, {_DEL} select case when cur.id is null then 'Inserted' when cur.h = del.h then 'Unchanged' else 'Updated' end as action, count(*) entities from del left join cur using (id) group by 1",
    "mark_and_upsert": f"""with {_CUR}, {_DEL} select cur.id, {_HEX.format("coalesce(del.h, cur.h)")} hash, strftime(cur.valid_from, '%Y-%m-%d') valid_from, case when del.id is null then coalesce(strftime(cur.valid_to, '%Y-%m-%d'), '2030-01-01') end valid_to from cur left join del using (id)
 union all select del.id, {_HEX.format("del.h")}, '2030-01-01', null from del where id not in (select id from cur)""",
    "close_and_insert": f"""with {_CUR}, {_DEL}, act as (select * from cur where valid_to is null)
select cur.id, {_HEX.format("cur.h")} hash, strftime(cur.valid_from, '%Y-%m-%d') valid_from, case when cur.valid_to is null and del.h <> cur.h then '2030-01-01' else strftime(cur.valid_to, '%Y-%m-%d') end valid_to from cur left join del using (id)
 union all select del.id, {_HEX.format("del.h")}, '2030-01-01', null from del left join act using (id) where act.id is null or act.h <> del.h""",
    "scd2_history": """with m as (select user_id, date_trunc('month', ts)::date as month, arg_max(event_type, (ts, event_id)) state from events where user_id is not null and ts is not null group by 1, 2),
c as (select * from m window w as (partition by user_id order by month) qualify lag(user_id) over w is null or lag(state) over w is distinct from state)
select user_id, strftime(month, '%Y-%m-%d') valid_from, state, strftime(lead(month) over (partition by user_id order by month), '%Y-%m-%d') valid_to from c""",
    "as_of": "select departement, count(*) rows_valid, count(distinct id) parcels from parcelles where valid_from <= date '2023-06-15' and (valid_to is null or valid_to > date '2023-06-15') group by 1",
    "as_of_join": "select l.id, strftime(l.day, '%Y-%m-%d') as day, count(*) versions, max(row_id) row_id from (select distinct id, created_at::date as day from parcelles where created_at is not null) l join parcelles p on p.id = l.id and p.valid_from <= l.day and (p.valid_to is null or p.valid_to > l.day) group by 1, 2",
    "latest_versions": "select id, row_id, numero from parcelles qualify row_number() over (partition by id order by valid_from desc, row_id desc) = 1",
    "ended_counts": "select table_name, coalesce(strftime(valid_to, '%Y-%m-%d'), 'open') ended, count(*) n from (select 'parcelles' table_name, valid_to from parcelles union all select 'sections', valid_to from sections union all select 'communes', valid_to from communes) group by 1, 2",
    "import_report": """with c as (select run_id, count(*) archives, count(distinct coalesce(nullif(regexp_extract(archive_name, '^[^-]*-([0-9]{2}|2[AB])', 1), ''), '00')) departments from archive_checksums group by 1)
select run_id, coalesce(archives, 0) archives, coalesce(departments, 0) departments, case when finished_at is null then 'Failed' when coalesce(status, '') = 'Success' then 'Success' when coalesce(archives, 0) > 0 then 'PartialSuccess' else 'Failed' end outcome from import_runs left join c using (run_id)""",
    "orphan_keys": r"""with live as (select distinct archive_name, vec_seq, rty, rid from vec_objects where deleted_at is null),
refs as (select distinct 'reference' origin, ref_id key_id, regexp_replace(rid, '^\s+|\s+$', '', 'g') rid, archive_name, vec_seq, rty from vec_references where trim(rty) <> ''
 union select 'face', obj_id, regexp_replace(a, '^\s+|\s+$', '', 'g'), archive_name, vec_seq, 'PAR' from (select obj_id, unnest(arcs) a, archive_name, vec_seq from vec_objects where rty = 'PFE' and deleted_at is null))
select origin, count(*) resolved from refs semi join live using (archive_name, vec_seq, rty, rid) where rid <> '' group by 1""",
    "event_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') from_ts, event_type, count(*) n, round(sum(value), 4) total from events where ts is not null group by 1, 2",
    "l93_to_wgs84": _conic_sql(projection.GRS80, 46.5, 44, 49, 700000, 6600000, 0, 0, _DEG),
    "l93_to_mercator": _conic_sql(projection.GRS80, 46.5, 44, 49, 700000, 6600000, 0, 0, _MERC),
    "cc46_to_wgs84": _conic_sql(projection.GRS80, 46, 45.25, 46.75, 1700000, 5200000, 1000000, -1400000, _DEG),
    "utm20n_to_wgs84": _utm_sql(20, False, -5000000),
    "utm38s_to_wgs84": _utm_sql(38, True, 1900000),
    "parse_faces": f"with {_A} select id, side * side supf, 'Polygon' kind, 1 as rings, 5 as vertices, side * side area from a",
    "faces_with_holes": f"with {_A} select id, side * side supf, 'Polygon' kind, 2 as rings, 10 as vertices, round(side * side * 0.75, 3) area from a",
}
