"""Points near other points or in regions (problem 1).

Locations get the code of their cell on a Z-order curve. A disc or a region is covered with ranges of codes; points whose
code lies in a range are candidates and are refined exactly, in integers. The range join sorts by code: points are cut into
pieces of equal size at quantiles of their codes, a range goes to each piece it overlaps, and inside a piece both sides are
matched by binary search. A town with a tenth of all points is spread over a tenth of the pieces.

Coordinates are integers: half centimetres, so that the middle of a bounding box with two decimals is exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Half centimetres in a metre.
UNIT = 200
#: Cell of the finest level: 2^13 half centimetres, about 41 m. Larger than twice 12 m, so a disc of 12 m touches 4 cells at most.
CELL_BITS = 13
#: Codes are made of this many bits per axis; coordinates may be negative.
AXIS_BITS = 30
_SHIFT = 1 << (AXIS_BITS + CELL_BITS - 1)


def spread(v: np.ndarray) -> np.ndarray:
    """Put a zero bit between the bits of non-negative integers below 2^32."""
    v = v.astype(np.uint64)
    for s, m in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(s))) & np.uint64(m)
    return v


def zcode(cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """Z-order codes of cells."""
    return (spread(cx) | (spread(cy) << np.uint64(1))).astype(np.int64)


def cell(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) + _SHIFT) >> CELL_BITS


def ranges_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes as inclusive runs of consecutive ones."""
    cut = np.flatnonzero(np.diff(codes) != 1) + 1
    return codes[np.append(0, cut)], codes[np.append(cut, len(codes)) - 1]


# ------------------------------------------------------------------------------------------------ geometry text

_NUMBER = r"[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


def bbox_middle(geometry: Column) -> Column:
    """struct<x, y> of the middle of a WKT text's bounding box in half centimetres; null for null, blank or empty geometries.

    Middle of (lo + hi) / 2 in centimetres is lo + hi in half centimetres: no rounding.
    """
    body = F.regexp_replace(geometry, r"(?i)^\s*srid\s*=\s*[0-9]+\s*;", "")
    n = F.regexp_extract_all(body, F.lit(f"({_NUMBER})"), F.lit(1))
    cm = F.transform(n, lambda s: F.round(s.cast("double") * 100).cast("long"))
    xs, ys = F.filter(cm, lambda _, i: i % 2 == 0), F.filter(cm, lambda _, i: i % 2 == 1)
    return F.when(F.size(n) >= 2, F.struct((F.array_min(xs) + F.array_max(xs)).alias("x"), (F.array_min(ys) + F.array_max(ys)).alias("y")))


def parse_area(wkt: str | None) -> list[list[np.ndarray]]:
    """Parts of a polygon or multipolygon, each a list of rings (n, 2) in half centimetres; the first ring is the outline."""
    if not wkt:
        return []
    body = re.sub(r"(?i)^\s*srid\s*=\s*\d+\s*;", "", wkt)
    parts: list[list[np.ndarray]] = []
    multi = "MULTI" in body.upper()[:20]
    for poly in re.findall(r"\(\s*\([^()]*\)(?:\s*,\s*\([^()]*\))*\s*\)", body) if multi else [body]:
        rings = []
        for ring in re.findall(r"\(([^()]*)\)", poly):
            v = np.array(re.findall(_NUMBER, ring), dtype=float)
            if len(v) >= 6:
                xy = np.rint(v[: len(v) // 2 * 2].reshape(-1, 2) * 100).astype(np.int64) * 2
                rings.append(xy if (xy[0] == xy[-1]).all() else np.vstack([xy, xy[:1]]))
        if rings:
            parts.append(rings)
    return parts


def inside(parts: list[list[np.ndarray]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points lie strictly inside: in a part's outline and in none of its holes. Exact; outlines belong to no area."""
    out = np.zeros(len(x), bool)
    for rings in parts:
        odd, edge = np.zeros(len(x), bool), np.zeros(len(x), bool)
        for r in rings:
            for s in range(0, len(r) - 1, 256):  # edges in blocks keep the matrix small
                a, b = r[s : s + 256], r[s + 1 : s + 257]
                a = a[: len(b)]
                ax, ay, bx, by = a[:, 0], a[:, 1], b[:, 0], b[:, 1]
                side = (bx - ax) * (y[:, None] - ay) - (by - ay) * (x[:, None] - ax)
                up = (ay <= y[:, None]) & (by > y[:, None]) & (side > 0)
                down = (by <= y[:, None]) & (ay > y[:, None]) & (side < 0)
                odd ^= ((up | down).sum(1) % 2).astype(bool)
                edge |= ((side == 0) & (np.minimum(ax, bx) <= x[:, None]) & (x[:, None] <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= y[:, None]) & (y[:, None] <= np.maximum(ay, by))).any(1)
        out |= odd & ~edge
    return out


def cover_area(parts: list[list[np.ndarray]], grid: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (lo, hi, sure) of finest codes that cover an area. ``sure`` ranges lie inside as a whole.

    The bounding box is laid out in at most ``grid`` x ``grid`` cells of one level; cells that no edge touches are judged by
    their middle. A larger area gets larger cells, so its ranges are as few.
    """
    pts = np.vstack([r for p in parts for r in p])
    lo, hi = cell(pts.min(0)), cell(pts.max(0))
    level = 0
    while ((hi >> level) - (lo >> level)).max() >= grid:
        level += 1
    lo, hi = lo >> level, hi >> level
    w, h = (hi - lo + 1).tolist()
    size = 1 << (CELL_BITS + level)
    touched = np.zeros((h, w), bool)
    x0, y0 = (lo * size - _SHIFT).tolist()
    for p in parts:
        for r in p:
            step = np.abs(np.diff(r, axis=0)).max(1)
            # points along each edge no further apart than a quarter cell, each marking its 3 x 3 neighbourhood's reach
            n = np.minimum(step // (size // 4) + 2, 4 * grid * 4)
            rep = np.repeat(np.arange(len(n)), n)
            t = (np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)) / np.repeat(n - 1, n)
            px, py = r[:-1, 0][rep] + t * (r[1:, 0] - r[:-1, 0])[rep] - x0, r[:-1, 1][rep] + t * (r[1:, 1] - r[:-1, 1])[rep] - y0
            for dx in (-size / 4, size / 4):
                for dy in (-size / 4, size / 4):
                    i, j = np.clip(((px + dx) // size).astype(int), 0, w - 1), np.clip(((py + dy) // size).astype(int), 0, h - 1)
                    touched[j, i] = True
    gy, gx = np.mgrid[0:h, 0:w]
    kind = touched.astype(np.int8)  # 1: refine, 2: inside
    free = ~touched
    mid = inside(parts, x0 + gx[free] * size + size // 2, y0 + gy[free] * size + size // 2)
    kind[free] = np.where(mid, 2, 0)
    los, his, sure = [], [], []
    for k in (1, 2):
        at = kind == k
        if at.any():
            c = np.sort(zcode(gx[at] + lo[0], gy[at] + lo[1]))
            a, b = ranges_of(c)
            los.append(a << (2 * level))
            his.append(((b + 1) << (2 * level)) - 1)
            sure.append(np.full(len(a), k == 2))
    if not los:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(bool)
    return np.concatenate(los), np.concatenate(his), np.concatenate(sure)


# ------------------------------------------------------------------------------------------------ tables


def current_locations(parcels: DataFrame) -> DataFrame:
    """(id, x, y): the location of each id's current row, see p1_found. Null ids have no location.

    The geometry is reduced to two integers before the shuffle, and ``max_by`` keeps one row per id and task.
    """
    rows = (
        parcels.filter(F.col("valid_to").isNull() & F.col("geometry").isNotNull() & F.col("id").isNotNull())
        .select("id", bbox_middle(F.col("geometry")).alias("m"), F.struct("valid_from", "row_id").alias("o"))
        .filter(F.col("m").isNotNull())
    )
    return rows.groupBy("id").agg(F.max_by("m", "o").alias("m")).select("id", "m.x", "m.y")


def open_regions(regions: DataFrame, kind: str) -> DataFrame:
    """(kind, id, geometry) of a region table's open rows with a geometry."""
    return regions.filter(F.col("valid_to").isNull() & F.col("geometry").isNotNull() & F.col("id").isNotNull()).select(F.lit(kind).alias("kind"), "id", "geometry").distinct()


def _with_code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = b.column("x").to_numpy(), b.column("y").to_numpy()
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(zcode(cell(x), cell(y)))], names=[*b.schema.names, "code"])


def coded_points(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``points`` (id, x, y) as spots and members, both written once, as the pieces' bounds and the joins read them.

    A spot (id, x, y, code, n) is a location with the least of its ids and the number of them; members (spot, id) are the ids
    of spots that have several. However many points coincide, they are one row in the joins.
    """
    spots = written(points.groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "x", "y", "n").mapInArrow(_with_code, "id string, x long, y long, n long, code long"), "spots")
    several = spots.filter("n > 1").select(F.col("id").alias("spot"), "x", "y")
    return spots, written(points.join(several, ["x", "y"]).select("spot", "id"), "members")


def with_members(rows: DataFrame, members: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with each of ``columns`` as the ids of the spot it names; a spot without members is its own id."""
    for c in columns:
        m = members.select(F.col("spot").alias("_spot"), F.col("id").alias("_id"))
        rows = rows.join(m, rows[c] == m["_spot"], "left").withColumn(c, F.coalesce("_id", c)).drop("_spot", "_id")
    return rows


class Pieces:
    """How the curve is cut: ``cuts`` are codes, piece i is divided into ``splits[i]`` squared blocks.

    A piece is divided only if one cell alone holds more points than a piece should: then its points and its ranges are
    both split, and each block of points meets each block of ranges once. Size: a few numbers per piece.
    """

    def __init__(self, cuts: list[int], splits: list[int]):
        self.cuts, self.splits = np.array(cuts, np.int64), np.array(splits, np.int64)
        self.base = np.cumsum(self.splits**2) - self.splits**2
        self.blocks = int((self.splits**2).sum())

    def partitions(self, df: DataFrame) -> int:
        """Partitions for the blocks. A fixed number, as their work isn't seen in their bytes."""
        return max(2 * df.sparkSession.sparkContext.defaultParallelism, min(self.blocks, 20_000))

    def assign(self, first: np.ndarray, last: np.ndarray, salt: np.ndarray, points: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, block) for rows that span the pieces first..last."""
        n = last - first + 1
        row = np.repeat(np.arange(len(n)), n)
        piece = np.repeat(first, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        m = self.splits[piece]
        rep = np.repeat(np.arange(len(row)), m)
        k = np.arange(len(rep)) - np.repeat(np.cumsum(m) - m, m)
        row, piece, m = row[rep], piece[rep], m[rep]
        own = salt[row] % m
        return row, self.base[piece] + (own * m + k if points else k * m + own)


def pieces(points: DataFrame, rows: int) -> Pieces:
    """Cut the curve at quantiles of the points' codes so that a piece has about ``rows`` points."""
    n = points.count()
    k = max(1, -(-n // rows))
    if k == 1:
        return Pieces([], [1])
    cuts = points.agg(F.percentile_approx("code", [i / k for i in range(1, k)], max(10_000, 10 * k)).alias("c")).first()["c"]
    distinct = sorted(set(cuts))
    splits = [1] * (len(distinct) + 1)
    for i, c in enumerate(distinct):
        splits[i + 1] = max(1, cuts.count(c))  # a code that is several quantiles holds as many pieces
    return Pieces(distinct, splits)


def _salt(ids: pa.Array) -> np.ndarray:
    return (pd.util.hash_array(np.asarray(ids.to_pylist(), object)) >> np.uint64(1)).astype(np.int64)


def _pieces(cut: Pieces, points: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, last = (np.searchsorted(cut.cuts, b.column(c).to_numpy(), "right") for c in ("lo", "hi"))
            salt = _salt(b.column("id")) if (cut.splits > 1).any() else np.zeros(b.num_rows, np.int64)
            row, piece = cut.assign(first, last, salt, points)
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(row)).columns, pa.array(piece, pa.int32())], names=[*b.schema.names, "piece"])

    return run


def _discs(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, own = (b.column(c).to_numpy() for c in ("x", "y", "code"))
            cx0, cx1, cy0, cy1 = cell(x - radius), cell(x + radius), cell(y - radius), cell(y + radius)
            w, h = cx1 - cx0 + 1, cy1 - cy0 + 1
            rep = np.repeat(np.arange(len(x)), w * h)
            k = np.arange(len(rep)) - np.repeat(np.cumsum(w * h) - w * h, w * h)
            code = zcode(cx0[rep] + k % w[rep], cy0[rep] + k // w[rep])
            keep = code >= own[rep]  # each pair is found from the one with the lower cell, or from both in one cell
            rep, code = rep[keep], code[keep]
            order = np.lexsort((code, rep))
            rep, code = rep[order], code[order]
            start = np.ones(len(rep), bool)
            start[1:] = (rep[1:] != rep[:-1]) | (code[1:] != code[:-1] + 1)
            at = np.flatnonzero(start)
            hi = code[np.append(at[1:], len(code)) - 1] if len(code) else code
            yield pa.RecordBatch.from_arrays([*b.select(["id", "x", "y"]).take(pa.array(rep[at])).columns, pa.array(code[at]), pa.array(hi), pa.array(np.ones(len(at), bool))], names=["id", "x", "y", "lo", "hi", "disc"])

    return run


def _expand(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(range index, point index) of all points whose code is in a range, in blocks of bounded size; ``codes`` are sorted."""
    a, b = np.searchsorted(codes, lo, "left"), np.searchsorted(codes, hi, "right")
    n = b - a
    total = np.cumsum(n)
    s = 0
    while s < len(n):
        done = total[s - 1] if s else 0
        e = max(s + 1, int(np.searchsorted(total, done + block, "right")))
        for p in range(0, int(n[s]), block) if e == s + 1 else [None]:  # a range with more points than a block is cut itself
            if p is not None:
                yield np.full(min(block, int(n[s]) - p), s), np.arange(a[s] + p, min(a[s] + p + block, b[s]))
            else:
                rep = np.repeat(np.arange(s, e), n[s:e])
                if len(rep):
                    yield rep, a[rep] + np.arange(len(rep)) - (total[rep] - n[rep] - done)
        s = e


_SIDES = "id string, x long, y long, lo long, hi long, disc boolean, piece int"


def _near(radius: int):
    """Pairs of a partition sorted by (piece, disc): a piece's points are held, its discs stream past them."""
    limit = radius * radius

    def meet(points: pa.Table, discs: pa.Table) -> Iterator[pa.RecordBatch]:
        codes, px, py = (points[c].to_numpy() for c in ("lo", "x", "y"))
        qx, qy, lo, hi = (discs[c].to_numpy() for c in ("x", "y", "lo", "hi"))
        own = zcode(cell(qx), cell(qy))
        pid, qid = points["id"].combine_chunks(), discs["id"].combine_chunks()
        for r, p in _expand(codes, lo, hi):
            ok = (px[p] - qx[r]) ** 2 + (py[p] - qy[r]) ** 2 <= limit
            r, p = r[ok], p[ok]
            a, b = qid.take(pa.array(r)), pid.take(pa.array(p))
            less = pa.compute.less(a, b)
            # the lower cell owns a pair, in one cell the lower id
            keep = pa.compute.or_(less, pa.array(codes[p] > own[r]))
            yield pa.RecordBatch.from_arrays([pa.compute.if_else(less, a, b).filter(keep), pa.compute.if_else(less, b, a).filter(keep)], names=["id_a", "id_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held, points = None, [], None
        for b in batches:
            at = b.column("piece").to_numpy() * 2 + b.column("disc").to_numpy(zero_copy_only=False)
            cut = np.append(np.append(0, np.flatnonzero(at[1:] != at[:-1]) + 1), len(at)) if len(at) else []
            for s, e in zip(cut[:-1], cut[1:]):
                part, now = b.slice(s, e - s), int(at[s])
                if now // 2 != piece:
                    piece, held, points = now // 2, [], None
                if now % 2 == 0:
                    held.append(part)
                elif held:
                    if points is None:
                        points = pa.Table.from_batches(held).combine_chunks()
                        points = points.take(pa.array(np.argsort(points["lo"].to_numpy(), kind="stable")))
                    yield from meet(points, pa.Table.from_batches([part]))

    return run


def near(spots: DataFrame, radius_m: float, cut: Pieces) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of different spots at most ``radius_m`` apart; ``spots`` as from ``coded_points``.

    Each spot's disc is covered with ranges of cells, only those not below its own, and joined to the spots by code; a pair
    comes out once. One spot, or none, gives no pairs. Points of one spot are pairs too: see ``near_points``.
    """
    radius = int(round(radius_m * UNIT))
    p = spots.select("id", "x", "y", F.col("code").alias("lo"), F.col("code").alias("hi"), F.lit(False).alias("disc")).mapInArrow(_pieces(cut, True), _SIDES)
    d = spots.select("id", "x", "y", "code").mapInArrow(_discs(radius), _SIDES.replace(", piece int", "")).mapInArrow(_pieces(cut, False), _SIDES)
    return p.unionByName(d).repartition(cut.partitions(spots), "piece").sortWithinPartitions("piece", "disc").mapInArrow(_near(radius), "id_a string, id_b string")


def near_points(spots: DataFrame, members: DataFrame, radius_m: float, cut: Pieces) -> DataFrame:
    """All pairs of points, made from the pairs of spots and the points of each; ``near`` with the members is the same in short."""
    far = with_members(near(spots, radius_m, cut), members, "id_a", "id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    l, r = members.alias("l"), members.alias("r")
    return far.unionByName(l.join(r, (F.col("l.spot") == F.col("r.spot")) & (F.col("l.id") < F.col("r.id"))).select(F.col("l.id").alias("id_a"), F.col("r.id").alias("id_b")))


_COVER = "kind string, id string, geometry string, lo array<long>, hi array<long>, sure array<boolean>, piece int"


def _covers(cut: Pieces, grid: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for kind, rid, wkt in zip(*(b.column(c).to_pylist() for c in ("kind", "id", "geometry"))):
                parts = parse_area(wkt)
                if not parts:
                    continue
                lo, hi, sure = cover_area(parts, grid)
                salt = _salt(pa.array([rid] * len(lo)))
                row, piece = cut.assign(np.searchsorted(cut.cuts, lo, "right"), np.searchsorted(cut.cuts, hi, "right"), salt, False)
                order = np.argsort(piece, kind="stable")
                row, piece = row[order], piece[order]
                for idx in np.split(np.arange(len(row)), np.flatnonzero(np.diff(piece)) + 1):
                    if len(idx):
                        r = row[idx]
                        rows.append((kind, rid, wkt, lo[r].tolist(), hi[r].tolist(), sure[r].tolist(), int(piece[idx[0]])))
            for s in range(0, len(rows), 512):
                c = list(zip(*rows[s : s + 512]))
                types = (pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, types)], names=["kind", "id", "geometry", "lo", "hi", "sure", "piece"])

    return run


def _within(left: pa.Table, right: pa.Table) -> pa.Table:
    left = left.take(pa.array(np.argsort(left["lo"].to_numpy(), kind="stable")))
    codes, px, py = (left[c].to_numpy() for c in ("lo", "x", "y"))
    pid = left["id"].combine_chunks()
    out = []
    for kind, rid, wkt, lo, hi, sure in zip(*(right[c].to_pylist() for c in ("kind", "id", "geometry", "lo", "hi", "sure"))):
        parts, sure = None, np.array(sure)
        for r, p in _expand(codes, np.array(lo), np.array(hi)):
            ok = sure[r]
            if not ok.all():
                parts = parts or parse_area(wkt)
                ask = np.flatnonzero(~ok)
                for s in range(0, len(ask), 4096):
                    at = ask[s : s + 4096]
                    ok[at] = inside(parts, px[p[at]], py[p[at]])
            hit = pid.take(pa.array(p[ok]))
            n = len(hit)
            if n:
                out.append(pa.table({"kind": pa.array([kind] * n), "id_a": hit, "id_b": pa.array([rid] * n)}))
    return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.string()) for c in ("kind", "id_a", "id_b")})


def within(points: DataFrame, regions: DataFrame, cut: Pieces, grid: int = 32) -> DataFrame:
    """(kind, id_a, id_b): spots strictly inside a region; ``regions`` (kind, id, geometry).

    Points in cells that lie inside a region as a whole are never refined. Regions may overlap, and several rows of a region
    count together. Null, empty and unreadable geometries contain nothing.
    """
    n = cut.partitions(points)
    p = points.select("id", "x", "y", F.col("code").alias("lo"), F.col("code").alias("hi")).mapInArrow(_pieces(cut, True), "id string, x long, y long, lo long, hi long, piece int")
    c = regions.repartition(n, "id").mapInArrow(_covers(cut, grid), _COVER)
    return p.repartition(n, "piece").groupBy("piece").cogroup(c.repartition(n, "piece").groupBy("piece")).applyInArrow(_within, "kind string, id_a string, id_b string").distinct()


def parcel_neighbourhood(parcels: DataFrame, sections: DataFrame, communes: DataFrame, radius_m: float = 12, piece_rows: int = 50_000) -> DataFrame:
    """(kind, id_a, id_b): parcels near each other and the open sections and communes around each parcel's location."""
    spots, members = coded_points(current_locations(parcels))
    cut = pieces(spots, piece_rows)
    regions = open_regions(sections, "section").unionByName(open_regions(communes, "commune"))
    pairs = near_points(spots, members, radius_m, cut).select(F.lit("near").alias("kind"), "id_a", "id_b")
    return pairs.unionByName(with_members(within(spots, regions, cut), members, "id_a"))


def spot_report(parcels: DataFrame, radius_m: float = 12, piece_rows: int = 50_000) -> DataFrame:
    """(spot, parcels, spots_near, parcels_near): the neighbourhood of each location without a row per pair of its parcels.

    ``parcels_near`` counts those at the location itself but one."""
    spots, _ = coded_points(current_locations(parcels))
    pairs = near(spots, radius_m, pieces(spots, piece_rows))
    both = pairs.unionByName(pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    n = spots.select(F.col("id").alias("id_b"), "n")
    per = both.join(n, "id_b").groupBy(F.col("id_a").alias("id")).agg(F.count("*").alias("spots_near"), F.sum("n").alias("around"))
    return spots.join(per, "id", "left").select(F.col("id").alias("spot"), F.col("n").alias("parcels"), F.coalesce("spots_near", F.lit(0)).alias("spots_near"), (F.coalesce("around", F.lit(0)) + F.col("n") - 1).alias("parcels_near"))
