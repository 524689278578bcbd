import random

import numpy as np
from pyspark.sql import functions as F

from parcelspark.operators import spatial


def box(x0, y0, x1, y1):
    return f"({x0} {y0},{x1} {y0},{x1} {y1},{x0} {y1},{x0} {y0})"


def test_inside_is_strict_and_spares_holes():
    parts = spatial.parse_area(f"SRID=2154;polygon ({box(0, 0, 10, 10)}, {box(2, 2, 4, 4)})")
    xy = np.array([(5, 5), (3, 3), (0, 5), (10, 10), (2, 3), (11, 5), (1.5, 1.5)]) * 200
    assert spatial.inside(parts, xy[:, 0].astype(int), xy[:, 1].astype(int)).tolist() == [True, False, False, False, False, False, True]
    two = spatial.parse_area(f"MULTIPOLYGON(({box(0, 0, 1, 1)}), ({box(5, 5, 6, 6)},{box(5.2, 5.2, 5.8, 5.8)}))")
    assert [len(p) for p in two] == [1, 2]
    assert spatial.parse_area("POLYGON EMPTY") == [] and spatial.parse_area(None) == [] and spatial.parse_area("nonsense") == []


def test_cover_is_right():
    rng = random.Random(2)
    for _ in range(30):
        n = rng.randint(3, 9)
        pts = [(rng.uniform(-3000, 3000), rng.uniform(-3000, 3000)) for _ in range(n)]
        parts = spatial.parse_area("POLYGON((" + ",".join(f"{x:.2f} {y:.2f}" for x, y in [*pts, pts[0]]) + "))")
        lo, hi, sure = spatial.cover_area(parts, 16)
        q = (np.random.default_rng(1).uniform(-3500, 3500, (400, 2)) * 200).astype(np.int64)
        code = spatial.zcode(spatial.cell(q[:, 0]), spatial.cell(q[:, 1]))
        within = (code[:, None] >= lo) & (code[:, None] <= hi)
        true = spatial.inside(parts, q[:, 0], q[:, 1])
        assert not (true & ~within.any(1)).any()
        assert true[(within & sure).any(1)].all()


def frames(spark, parcels, sections=(), communes=()):
    s = "row_id long, id string, geometry string, valid_from date, valid_to date, kind string"
    return spark.createDataFrame(parcels, s), spark.createDataFrame(list(sections), s), spark.createDataFrame(list(communes), s)


def test_neighbourhood(spark):
    from datetime import date as D

    a, b = D(2020, 1, 1), D(2021, 1, 1)
    square = lambda x, y, s=2: f"POLYGON({box(x, y, x + s, y + s)})"
    parcels = [
        (1, "p1", square(0, 0), a, None, ""), (2, "p1", square(500, 0), b, b, ""), (3, "p2", square(12, 0), a, None, ""), (4, "p2", "POLYGON EMPTY", b, None, ""), (5, "p3", square(12.01, 0), a, None, ""),
        (6, "p4", square(0, 0), a, None, ""), (7, "p5", None, a, None, ""), (8, "p6", square(40, 0), a, None, ""), (9, "p6", square(0, -12), a, None, ""), (10, None, square(0, 0), a, None, ""), (11, "p7", "  ", a, None, ""),
    ]
    got = {tuple(r) for r in spatial.parcel_neighbourhood(*frames(spark, parcels, [(1, "s", f"POLYGON({box(-1, -1, 12, 2)},{box(0.5, 0.5, 1.5, 1.5)})", a, None, ""), (2, "t", square(0, 0, 50), a, b, "")], [(1, "c", square(-99, -99, 300), a, None, ""), (1, "c", square(-99, -99, 300), a, None, ""), (2, "d", None, a, None, "")])).collect()}
    assert got == {("near", "p1", "p2"), ("near", "p1", "p4"), ("near", "p2", "p3"), ("near", "p2", "p4"), ("near", "p1", "p6"), ("near", "p4", "p6"), *(("commune", f"p{n}", "c") for n in (1, 2, 3, 4, 6))}
    assert spatial.parcel_neighbourhood(*frames(spark, [])).count() == 0


def test_crowded_cell_and_pieces(spark):
    rng = random.Random(3)
    pts = [(f"a{n:04d}", rng.randint(0, 3000), rng.randint(0, 3000)) for n in range(600)] + [(f"b{n:04d}", rng.randint(-10**6, 10**6), rng.randint(-10**6, 10**6)) for n in range(600)]
    pts += [("c1", 77, 77), ("c2", 77, 77), ("c3", 77, 77)]
    points, members = spatial.coded_points(spark.createDataFrame(pts, "id string, x long, y long"))
    cut = spatial.pieces(points, 50)
    assert (cut.splits > 1).any() and len(cut.cuts) > 3
    got = [tuple(r) for r in spatial.near_points(points, members, 2, cut).collect()]
    assert len(got) == len(set(got))
    got = set(got)
    xy = np.array([p[1:] for p in pts])
    want = {(pts[i][0], pts[j][0]) for i in range(len(pts)) for j in np.flatnonzero(((xy - xy[i]) ** 2).sum(1) <= 400**2) if pts[i][0] < pts[j][0]}
    assert got == want
    region = spark.createDataFrame([("r", "R", f"POLYGON({box(-1, -1, 9, 9)})")], "kind string, id string, geometry string")
    inside = {r.id_a for r in spatial.with_members(spatial.within(points, region, cut, 8), members, "id_a").collect()}
    assert inside == {i for i, x, y in pts if -200 < x < 1800 and -200 < y < 1800}


def test_many_parcels_on_one_spot(spark):
    """Fifty thousand on one spot are one row, and so are two thousand on each of its neighbours."""
    square = lambda x: f"POLYGON({box(x, 0, x + 2, 2)})"
    at = F.when(F.col("id") < 50_000, square(0)).when(F.col("id") < 52_000, square(12)).otherwise(square(30))
    df = spark.range(52_003).select(F.col("id").alias("row_id"), F.format_string("p%06d", "id").alias("id"), at.alias("geometry"), F.lit("2020-01-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    got = {tuple(r) for r in spatial.spot_report(df).collect()}
    assert got == {("p000000", 50_000, 1, 51_999), ("p050000", 2000, 1, 51_999), ("p052000", 3, 0, 2)}
