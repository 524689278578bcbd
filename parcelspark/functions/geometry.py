"""Geometries as struct<kind, parts: array<part: array<ring: array<vertex: struct<x, y>>>>> and functions on them.

Point [[[c]]], LineString [[cs]], MultiPoint and MultiLineString one part each, Polygon one part of rings, MultiPolygon parts.
Everything but EWKB and the BLAKE3 hash is a Column expression.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import topology
from .blake3 import blake3_many

GEOM = "struct<kind:string,parts:array<array<array<struct<x:double,y:double>>>>>"
# Names of the kinds, as text and as tags of the hash; codes of the binary form.
KINDS = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon"}
CODES = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once: inside higher-order functions nothing else shares subexpressions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(f: Callable[..., Column]) -> Callable[..., Column]:
    """Evaluate the geometry that a function is applied to once, however often the function names it."""

    @functools.wraps(f)
    def bound(geom: Column, *args, **kwargs) -> Column:
        return let(geom, lambda g: f(g, *args, **kwargs))

    return bound


def from_wkt(text: Column) -> Column:
    """A geometry of WKT or EWKT; null for null, empty, blank and unknown texts. Case and spacing don't matter."""
    t = F.upper(F.regexp_replace(text, r"(?i)^\s*(srid\s*=\s*[0-9]+\s*;\s*)?|\s+$", ""))
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r" ?([(),]) ?", "$1")
    names = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])

    def vertex(v: Column) -> Column:
        return let(F.split(v, " "), lambda c: F.struct(c[0].try_cast("double").alias("x"), F.try_element_at(c, F.lit(2)).try_cast("double").alias("y")))

    def build(t: Column) -> Column:
        kind = F.element_at(F.split(t, r"\("), 1)
        body = F.regexp_replace(t, r"^[A-Z]+\(+|\)+$", "")
        parts = (
            F.when(kind == "MULTIPOLYGON", F.split(body, r"\)\),\(\("))
            .when(kind == "MULTILINESTRING", F.split(body, r"\),\("))
            .when(kind == "MULTIPOINT", F.split(F.regexp_replace(body, "[()]", ""), ","))
            .otherwise(F.array(body))
        )
        nested = F.transform(parts, lambda p: F.transform(F.split(p, r"\),\("), lambda r: F.transform(F.split(r, ","), vertex)))
        return F.struct(F.try_element_at(names, kind).alias("kind"), nested.alias("parts"))

    known = t.rlike("^(" + "|".join(KINDS) + r")\(")
    return F.when(known, let(t, build))


@once
def map_vertices(geom: Column, f: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    def one(v: Column) -> Column:
        x, y = f(v["x"], v["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    parts = F.transform(geom["parts"], lambda p: F.transform(p, lambda r: F.transform(r, one)))
    return F.when(geom.isNotNull(), F.struct(geom["kind"].alias("kind"), parts.alias("parts")))


def round_half_away(v: Column, digits: int) -> Column:
    """round(v * 10^d) / 10^d in double arithmetic; halves go away from zero."""
    return _half_away(v * 10.0**digits) / 10.0**digits


def _half_away(v: Column) -> Column:
    """Whole number next to a double, halves away from zero; ``round`` would go through decimals."""
    return F.when(v < 0, -F.floor(F.lit(0.5) - v)).otherwise(F.floor(v + 0.5))


def rounded(geom: Column, digits: int) -> Column:
    return map_vertices(geom, lambda x, y: (round_half_away(x, digits), round_half_away(y, digits)))


@once
def is_valid(geom: Column) -> Column:
    """Points are valid, lines need two vertices, rings four and to be closed exactly. Null is invalid."""
    ring = lambda r: (F.size(r) >= 4) & (r[0] == F.element_at(r, -1))
    rings = F.forall(geom["parts"], lambda p: F.forall(p, ring))
    lines = F.forall(geom["parts"], lambda p: F.forall(p, lambda r: F.size(r) >= 2))
    return F.coalesce(F.when(geom["kind"].isin("Polygon", "MultiPolygon"), rings).when(geom["kind"].isin("LineString", "MultiLineString"), lines).otherwise(geom["kind"].isNotNull()), F.lit(False))


def _shoelace(r: Column) -> Column:
    """Twice over: sum of cross products of neighbouring vertices, taken from the first vertex so that no digits are lost."""
    first = lambda v: F.struct((v["x"] - r[0]["x"]).alias("x"), (v["y"] - r[0]["y"]).alias("y"))
    n = F.greatest(F.size(r) - 1, F.lit(0))
    pairs = let(F.transform(r, first), lambda q: F.zip_with(F.slice(q, F.lit(1), n), F.slice(q, F.lit(2), n), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v) / 2


@once
def area(geom: Column) -> Column:
    """Area of polygons, holes taken off; 0 for other kinds."""
    part = lambda p: F.aggregate(F.transform(p, lambda r, i: F.when(i == 0, F.abs(_shoelace(r))).otherwise(-F.abs(_shoelace(r)))), F.lit(0.0), lambda s, v: s + v)
    total = F.aggregate(F.transform(geom["parts"], part), F.lit(0.0), lambda s, v: s + v)
    return F.when(geom["kind"].isin("Polygon", "MultiPolygon"), total).otherwise(F.lit(0.0))


def vertices(geom: Column) -> Column:
    return F.size(F.flatten(F.flatten(geom["parts"])))


@once
def bbox(geom: Column) -> Column:
    v = F.flatten(F.flatten(geom["parts"]))
    xs, ys = F.transform(v, lambda c: c["x"]), F.transform(v, lambda c: c["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def made_valid(geom: Column) -> Column:
    """Polygons and multipolygons without crossings, see ``topology.make_valid``; other kinds as they are.

    Rows are handled in Python, so apply it to the rows that need it."""

    @F.arrow_udf(GEOM)
    def run(g: pa.Array) -> pa.Array:
        out = []
        for v in g.to_pylist():
            if v is not None and v["kind"] in ("Polygon", "MultiPolygon"):
                parts = topology.make_valid([[[(c["x"], c["y"]) for c in r] for r in p] for p in v["parts"]])
                v = {"kind": "Polygon" if len(parts) == 1 else "MultiPolygon", "parts": [[[{"x": x, "y": y} for x, y in r] for r in p] for p in parts]}
            out.append(v)
        return pa.array(out, g.type)

    return run(geom)


# ------------------------------------------------------------------------------------------------ text forms


def plain_number(v: Column) -> Column:
    """A number as the shortest plain decimal that reads back as it; beyond 1e7 and below 1e-3 with at most 9 decimals."""
    t = v.cast("string")
    far = F.regexp_replace(F.regexp_replace(v.cast("decimal(38,9)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(t.contains("E"), far).when(t.endswith(".0"), F.substring_index(t, ".", 1)).otherwise(t)


@once
def to_ewkt(geom: Column, srid: int) -> Column:
    vertex = lambda v: F.concat(plain_number(v["x"]), F.lit(" "), plain_number(v["y"]))
    ring = lambda r: F.array_join(F.transform(r, vertex), ",")
    rings = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, lambda r: F.concat(F.lit("("), ring(r), F.lit(")"))), ","), F.lit(")"))
    k = geom["kind"]
    flat = F.array_join(F.transform(geom["parts"], lambda p: ring(p[0])), ",")
    lines = F.array_join(F.transform(geom["parts"], lambda p: F.concat(F.lit("("), ring(p[0]), F.lit(")"))), ",")
    body = (
        F.when(k.isin("Point", "LineString", "MultiPoint"), F.concat(F.lit("("), flat, F.lit(")")))
        .when(k == "MultiLineString", F.concat(F.lit("("), lines, F.lit(")")))
        .when(k == "Polygon", rings(geom["parts"][0]))
        .otherwise(F.concat(F.lit("("), F.array_join(F.transform(geom["parts"], rings), ","), F.lit(")")))
    )
    return F.when(F.size(geom["parts"]) > 0, F.concat(F.lit(f"SRID={srid};"), F.upper(k), body)).when(geom.isNotNull(), F.concat(F.lit(f"SRID={srid};"), F.upper(k), F.lit(" EMPTY")))


@once
def to_geojson(geom: Column) -> Column:
    """GeoJSON geometry text."""
    vertex = lambda v: F.concat(F.lit("["), plain_number(v["x"]), F.lit(","), plain_number(v["y"]), F.lit("]"))
    joined = lambda a: F.concat(F.lit("["), F.array_join(a, ","), F.lit("]"))
    ring = lambda r: joined(F.transform(r, vertex))
    rings = lambda p: joined(F.transform(p, ring))
    k, p = geom["kind"], geom["parts"]
    body = (
        F.when(k == "Point", vertex(p[0][0][0]))
        .when(k == "LineString", ring(p[0][0]))
        .when(k == "MultiPoint", joined(F.transform(p, lambda q: vertex(q[0][0]))))
        .when(k == "MultiLineString", joined(F.transform(p, lambda q: ring(q[0]))))
        .when(k == "Polygon", rings(p[0]))
        .otherwise(joined(F.transform(p, rings)))
    )
    return F.when(geom.isNotNull(), F.concat(F.lit('{"type":"'), k, F.lit('","coordinates":'), body, F.lit("}")))


# ------------------------------------------------------------------------------------------------ hashes


def normal_ring(r: Column) -> Column:
    """A ring without its closing vertex, from its least (x, y) on, in its own direction.

    Of several equal least vertices the first counts, in order of the ring."""
    n = F.size(r)
    open_ = F.when((n > 1) & (r[0] == F.element_at(r, -1)), F.slice(r, F.lit(1), n - 1)).otherwise(r)

    def turned(o: Column) -> Column:
        at = F.array_position(o, F.array_min(o)).cast("int")
        return let(at, lambda k: F.concat(F.slice(o, k, F.size(o)), F.slice(o, F.lit(1), k - 1)))

    return F.when(n > 0, let(open_, turned)).otherwise(r)


@once
def canonical(geom: Column, oriented: bool = False) -> Column:
    """Text that is equal for equal geometries: kind, then each ring in normal form, in steps of a millionth.

    With ``oriented`` the direction of rings doesn't count either."""
    whole = lambda v: _half_away(v * 1e6).cast("string")
    step = lambda v: F.concat(whole(v["x"]), F.lit(" "), whole(v["y"]))
    poly = geom["kind"].isin("Polygon", "MultiPolygon")

    def ring(r: Column) -> Column:
        if oriented:
            r = F.when(poly & (_shoelace(r) < 0), F.reverse(r)).otherwise(r)
        return F.array_join(F.transform(F.when(poly, normal_ring(r)).otherwise(r), step), ",")

    parts = F.array_join(F.transform(geom["parts"], lambda p: F.array_join(F.transform(p, ring), "|")), "/")
    return F.concat(geom["kind"], F.lit(":"), parts)


def geometry_hash(geom: Column, oriented: bool = False) -> Column:
    """32 bytes, JVM-side: SHA-256 of the canonical text."""
    return F.unhex(F.sha2(canonical(geom, oriented), 256))


def _steps(ring: list, closed: bool) -> bytes:
    v = np.array([(c["x"], c["y"]) for c in ring], float).reshape(-1, 2)
    if closed and len(v) > 1 and (v[0] == v[-1]).all():
        v = v[:-1]
    if closed and len(v):
        v = np.roll(v, -int(np.lexsort((np.arange(len(v)), v[:, 1], v[:, 0]))[0]), axis=0)
    s = v * 1e6
    q = np.where(s < 0, np.ceil(s - 0.5), np.floor(s + 0.5))
    return np.clip(q, -(2.0**63), 2.0**63 - 1024).astype("<i8").tobytes()


def hash_bytes(geom: dict) -> bytes:
    """The bytes that the interoperable hash covers: tags of kind, part and ring, then quantised vertices."""
    kind, parts = geom["kind"], geom["parts"]
    out = [kind.upper().encode()]
    for p in parts:
        if kind in ("Polygon", "MultiPolygon"):
            out += [b"POLY"] if kind == "MultiPolygon" else []
            for i, r in enumerate(p):
                out += [b"INT" if i else b"EXT", _steps(r, True)]
        else:
            out += [b"LS"] if kind == "MultiLineString" else []
            out += [_steps(p[0], False)]
    return b"".join(out)


def blake3_hash(geom: Column) -> Column:
    """32 bytes for exchange with stores that hash with BLAKE3; Arrow batches in Python, so only where that is needed."""

    @F.arrow_udf("binary")
    def run(g: pa.Array) -> pa.Array:
        hashes = iter(blake3_many([hash_bytes(v) for v in g.to_pylist() if v is not None]))
        return pa.array([next(hashes) if v.is_valid else None for v in g], pa.binary())

    return run(geom)


# ------------------------------------------------------------------------------------------------ binary form


def ewkb(geom: dict, srid: int) -> bytes:
    """Little-endian WKB with the SRID flag on the outer type word."""

    def points(r: list) -> bytes:
        return np.array([(c["x"], c["y"]) for c in r], "<f8").tobytes()

    def head(kind: str, outer: bool) -> bytes:
        return struct.pack("<BI", 1, CODES[kind] | (0x20000000 if outer else 0)) + (struct.pack("<I", srid) if outer else b"")

    def part(kind: str, p: list, outer: bool) -> bytes:
        if kind == "Point":
            return head(kind, outer) + points(p[0])
        if kind == "LineString":
            return head(kind, outer) + struct.pack("<I", len(p[0])) + points(p[0])
        return head(kind, outer) + struct.pack("<I", len(p)) + b"".join(struct.pack("<I", len(r)) + points(r) for r in p)

    kind, parts = geom["kind"], geom["parts"]
    if kind.startswith("Multi"):
        return head(kind, True) + struct.pack("<I", len(parts)) + b"".join(part(kind[5:], p, False) for p in parts)
    return part(kind, parts[0], True)


def to_ewkb(geom: Column, srid: int) -> Column:
    @F.arrow_udf("binary")
    def run(g: pa.Array) -> pa.Array:
        return pa.array([None if v is None else ewkb(v, srid) for v in g.to_pylist()], pa.binary())

    return run(geom)


def add_srid(wkb: bytes, srid: int) -> bytes:
    """WKB of either byte order with an SRID put in; texts shorter than a header come back as they are."""
    if len(wkb) < 5:
        return wkb
    o = "<" if wkb[0] else ">"
    return wkb[:1] + struct.pack(o + "I", struct.unpack(o + "I", wkb[1:5])[0] | 0x20000000) + struct.pack(o + "I", srid) + wkb[5:]
