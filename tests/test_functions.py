import hashlib
import math
import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelspark.functions import geometry, projection, records, text
from parcelspark.functions.blake3 import blake3, blake3_many
from parcelspark.operators import topology


def test_blake3_published_vectors():
    data = bytes(i % 251 for i in range(5000))
    assert blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3(data[:1]).hex().startswith("2d3adedff11b61f14c886e35afa03673")
    assert blake3(data[:1024]).hex().startswith("42214739f095a406f3fc83deb889744a")
    assert blake3(data[:2049]).hex().startswith("5f4d72f40d7a5f82b15ca2b2e44b1de3")
    texts = [data[:n] for n in (0, 1, 63, 64, 65, 1000, 1024, 1025, 4999)]
    assert blake3_many(texts) == [blake3(t) for t in texts] and blake3_many([]) == []


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_names(spark):
    names = ["EDIGEO-380910000C01.tar.bz2", "edigeo-39001000AB01.tar.bz2", "EDIGEO-2A0010001A01.tar.bz2", "edigeo-2B033000AA01.tar.bz2", "edigeo-97101000AB01.tar.bz2", "fichier-invalide.txt"]
    got = [tuple(one(spark, text.department(F.lit(n)), text.department_from_file(F.lit(n)))) for n in names]
    assert got == [("38", "38"), ("39", "39"), ("2A", "2A"), ("2B", "2B"), ("97", "971"), ("00", "00")]
    bases = {"edigeo-39001000AH01.tar.bz2": "edigeo-39001000AH01", "archive.bz2": "archive", "file.tar": "file", "noextension": "noextension"}
    assert all(one(spark, text.basename(F.lit(k)))[0] == v for k, v in bases.items())
    tables = {"PARCELLE_1": "parcelles", "SECTION_A": "sections", "BATI_DUR": "batiments", "LIEUDIT": "lieux_dits", "UNKNOWN": "parcelles"}
    assert all(one(spark, text.legacy_table(F.lit(k)))[0] == v for k, v in tables.items())


def test_vintage():
    for good in ("2024-01", "1900-01", "2100-12"):
        assert text.vintage(good) == good + "-01"
    for bad in ("2024", "2024-1", "24-01", "2024/01", "2024-00", "2024-13", "1899-01", "2101-01"):
        with pytest.raises(ValueError):
            text.vintage(bad)


def test_numbers(spark):
    for raw, n, i in (("+1895.", 1895.0, 1895), ("01", 1.0, 1), ("+45.5", 45.5, 45), ("", None, None), ("-3.7", -3.7, -3), ("1d", None, None), ("nan", None, None), ("1e3", 1000.0, 1000), ("1e30", 1e30, None)):
        assert tuple(one(spark, text.number(F.lit(raw)), text.integer(F.lit(raw)))) == (n, i), raw
    assert tuple(one(spark, text.cast_attribute(F.lit(None).cast("string"), "text"), text.cast_attribute(F.lit("a\r\nb"), "what"), text.cast_attribute(F.lit("x"), "date"), text.cast_attribute(F.lit("70000"), "smallint"))) == ("", "a  b", None, None)


def test_record_texts(spark):
    for said, codec in (("CSETCC:8859-1", "iso8859-15"), ("CSET:8859-1", "iso8859-15"), ("CSETCC:IRV", "iso8859-15"), ("x", "iso8859-15"), ("CSETCC06: 8859-9 \r\n", "cp1254"), ("CSETCC:8859-2", "iso8859-2")):
        assert records.parse_thf(said.encode())[0] == codec == one(spark, text.charset(F.lit(said)))[0]
    assert records.parse_thf(b"TDASDP:20260115")[1] == 2026 == one(spark, text.thf_year(F.lit("TDASDP:20260115")))[0]
    assert records.parse_thf(b"")[1] == 2020
    for geo, code in (("RELSACC:LAMB93", 2154), ("RELSACC:RGF93CC46", 3946), ("X\nSYS RGF93CC50 y", 3950), ("GUAD48UTM20", 2970), ("SYS RGF93CC42\nOLD LAMB93", 3942), ("LAMB93X\r\nRGR92UTM LAMB93\r\n", 2154), ("RELSA\n12:RGM04\n", 32738)):
        assert records.parse_geo(geo.encode())[0] == code == one(spark, text.epsg(F.lit(geo)))[0]
    for bad in ("RELSACC:UNKNOWN_PROJ", "", "LAMB93X"):
        with pytest.raises(records.RecordError):
            records.parse_geo(bad.encode())
        assert one(spark, text.epsg(F.lit(bad)))[0] is None
    q = records.parse_qal(b"RTYSA03:QUP\r\nRIDSA:Objet_123\r\nODASA:20260115\r\nUDASA:20260120\r\nRTYSA03:XXX\r\nRIDSA:no\r\n")
    assert q == {"Objet_123": records.Quality("20260115", "20260120", None)}
    assert records.parse_reference("EDAB01;SeSD;PGE;Noeud_123;x") == ("EDAB01", "SeSD", "PGE", "Noeud_123") and records.parse_reference("a") == ("a", "", "", "")
    for c in ("+881824.53;+6663821.17;", "881824.53;6663821.17"):
        assert records.parse_coordinate(c) == (881824.53, 6663821.17) == tuple(one(spark, text.coordinate(F.lit(c)))[0])
    assert records.parse_coordinate("12") is None and records.parse_coordinate("a;b") is None


def test_vec_blocks():
    vec = records.parse_vec("head\r\nRTYSA03:FEA\r\nRIDSA07:Objet_1\r\nSCPCP:E;SeSD;OBJ;PARCELLE_id\r\nATPCP:E;SeSD;ATT;IDU_id_id\r\nTEXT06:8859-1\r\nATVST:é\r\nATVST:lost\r\nATPCP:E;SeSD;ATT;TEX_id\r\nATVST: x \r\nQAPCP:E;SeSD;QUP;Q1\r\nRTYSA03:FEA\r\nnothing\r\nRTYSA03:PNO\r\nRIDSA:N\r\nCORCC:+1.00;+2.00;\r\nRTYSA03:PNO\r\nRIDSA:N\r\nCORCC:3;4;\r\nRTYSA03:LNK\r\nRIDSA:L\r\nSCPCP:E;SeSD;REL;X\r\nFTPCP:E;SeSD;FEA;Objet_1\r\nFTPCP:E;SeSD;PNO;N\r\n")
    assert vec.business["Objet_1"] == records.Business("PARCELLE_id", {"IDU": "é", "TEX": "x"}, "Q1") and vec.nodes == {"N": [(3.0, 4.0)]}
    f = list(records.features(vec, {"Q1": records.Quality("20200101", None)}))
    assert [(x.id, x.kind, x.geom["kind"], x.properties) for x in f] == [("é", "PARCELLE_id", "Point", {"IDU": "é", "TEX": "x", "createDate": "20200101"})]


def test_scheme_type(spark):
    vec = "RIDSA07:Objet_1\r\nSCPCP27:EDAB01;SeSD;OBJ;PARCELLE_id\r\n"
    got = one(spark, *[text.scheme_type(F.lit(vec), F.lit(i)) for i in ("Objet_1", "Objet_2")])
    assert tuple(got) == ("PARCELLE_id", None)


def test_make_valid():
    bow = [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]
    parts = topology.make_valid([[bow]])
    area = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:]))) / 2
    assert len(parts) == 2 and sum(area(p[0]) for p in parts) == 8 and all(p[0][0] == p[0][-1] for p in parts)
    good = [[[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]]]
    (p,) = topology.make_valid(good)
    assert len(p) == 2 and area(p[0]) == 81 and area(p[1]) == 0.5
    # parts that overlap are put together by the even-odd rule
    a, b = ([(x, 0.0), (x + 4, 0.0), (x + 4, 4.0), (x, 4.0), (x, 0.0)] for x in (0.0, 2.0))
    assert sum(area(q[0]) for q in topology.make_valid([[a], [b]])) == 16
    assert topology.make_valid([[[(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]]]) == []


SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
SIDES = [[SQUARE[i], SQUARE[(i + 1) % 4]] for i in range(4)]


@given(st.permutations(range(4)), st.lists(st.booleans(), min_size=4, max_size=4))
def test_ring_of_shuffled_and_reversed_arcs(order, back):
    (ring,) = topology.rings([SIDES[i][::-1] if b else SIDES[i] for i, b in zip(order, back)])
    assert len(ring) == 5 and ring[0] == ring[-1] and set(ring) == set(SQUARE)


def test_rings_holes_and_hull():
    closed = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    assert topology.rings([closed(0.0, 0.0, 5.0)]) == [closed(0.0, 0.0, 5.0)]
    assert len(topology.rings([[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]])[0]) == 5
    with pytest.raises(topology.TopologyError):
        topology.rings([[(0.0, 0.0), (1.0, 1.0)]])
    a, b, c, far = closed(0.0, 0.0, 10.0), closed(1.0, 1.0, 5.0), closed(2.0, 2.0, 1.0), closed(50.0, 50.0, 1.0)
    assert topology.nest([a, b, c]) == [[a, b, c]] and topology.nest([b, a, c]) == [[a, b]]
    assert topology.polygon([a, far])["kind"] == "MultiPolygon" and topology.polygon([a, b])["kind"] == "Polygon"
    assert topology.polygon([[(0.0, 0.0), (4.0, 0.0)], [(9.0, 9.0), (0.0, 3.0)]])["parts"][0][0][0] == {"x": 0.0, "y": 0.0}
    assert topology.polygon([[(0.0, 0.0), (4.0, 0.0)]]) is None and topology.polygon([]) is None
    line = lambda n, single: topology.line([[(0.0, 0.0), (1.0, 1.0)]] * n + [[(5.0, 5.0)]], single)
    assert line(1, True)["kind"] == "LineString" and line(1, False)["kind"] == "MultiLineString" and len(line(2, False)["parts"]) == 2 and line(0, True) is None
    assert topology.without_dead_ends([*SIDES, [(0.0, 0.0), (-5.0, 0.0)], [(-5.0, 0.0), (-6.0, 0.0)]]) == SIDES


POINTS = [
    (2154, 652381, 6862047, 2.3509991, 48.8566991), (2154, 648237, 6862107, 2.2945159, 48.8569190), (2154, 893193, 6245829, 5.3792348, 43.2854368), (2154, 700000, 6600000, 3.0, 46.5),
    (32620, 708000, 1615000, -61.0691127, 14.6002829), (32740, 338000, 7691000, 55.4426869, -20.8741123), (32622, 352000, 546000, -52.3348414, 4.9383678), (32738, 520000, 8580000, 45.1843175, -12.8449809),
    (3946, 1700000, 5200000, 3.0, 46.0), (3942, 1700000, 1200000, 3.0, 42.0), (3950, 1700000, 9200000, 3.0, 50.0),
]


def test_projections(spark):
    for code, x, y, lon, lat in POINTS:
        got = one(spark, *projection.transformer(code, 4326)(F.lit(float(x)), F.lit(float(y))))
        assert tuple(got) == pytest.approx((lon, lat), abs=1e-7), code
    x, y = one(spark, *projection.mercator_forward(F.lit(2.35), F.lit(48.85)))
    assert (x, y) == pytest.approx((261600.8034, 6249447.7528), abs=1e-3)
    assert tuple(one(spark, *projection.mercator_inverse(F.lit(x), F.lit(y)))) == pytest.approx((2.35, 48.85), abs=1e-9)
    assert one(spark, projection.mercator_forward(F.lit(0.0), F.lit(89.0))[1])[0] == pytest.approx(19971868.8804, abs=1e-3)
    assert projection.transformer(2154, 2154) is None and projection.transformer(4326, 4326) is None
    with pytest.raises(ValueError):
        projection.transformer(99999, 4326)
    # the old island datums move by hundreds of metres, not more
    for code in (2970, 2973):
        a, b = one(spark, *projection.transformer(code, 4326)(F.lit(650000.0), F.lit(1790000.0))), one(spark, *projection.transformer(32620, 4326)(F.lit(650000.0), F.lit(1790000.0)))
        assert 50 < math.dist(a, b) * 111000 < 800
    assert projection.precision(4326) == 7 and projection.precision(2154) == 2


def wkt(spark, s):
    return spark.range(1).select(geometry.from_wkt(F.lit(s)).alias("g"))


FORMS = ["POINT(1 2)", "LINESTRING(0 0,1 1.5)", "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 1))", "MULTIPOLYGON(((0 0,4 0,4 4,0 0)),((9 9,10 9,10 10,9 9),(9.1 9.1,9.2 9.1,9.2 9.2,9.1 9.1)))", "MULTIPOINT(1 2,3 4)", "MULTILINESTRING((0 0,1 1),(2 2,3 3))"]


@pytest.mark.parametrize("form", FORMS)
def test_text_forms_come_back(spark, form):
    spaced = "  srid=2154; " + form.lower().replace("(", " ( ").replace(",", " , ")
    for s in (form, spaced, "SRID=2154;" + form):
        assert wkt(spark, s).select(geometry.to_ewkt(F.col("g"), 2154)).first()[0] == "SRID=2154;" + form
    assert '"coordinates":' in wkt(spark, form).select(geometry.to_geojson(F.col("g"))).first()[0]


def test_missing_and_invalid_geometries(spark):
    for s in (None, "", "  ", "POLYGON EMPTY", "CIRCLE(1)", "SRID=2154;"):
        df = spark.createDataFrame([(s,)], "s string").select(geometry.from_wkt(F.col("s")).alias("g"))
        assert df.first()[0] is None and df.select(geometry.is_valid(F.col("g")), geometry.geometry_hash(F.col("g")), geometry.to_ewkt(F.col("g"), 1)).first()[:] == (False, None, None)
    for s, ok in (("POLYGON((0 0,1 0,0 0))", False), ("POLYGON((0 0,1 0,1 1,0 1))", False), ("LINESTRING(0 0)", False), ("POINT(0 0)", True), (FORMS[3], True)):
        assert wkt(spark, s).select(geometry.is_valid(F.col("g"))).first()[0] is ok


def test_made_valid_keeps_valid_areas(spark):
    g = F.col("g")
    for form in FORMS:
        df = wkt(spark, form).select("g", geometry.made_valid(g).alias("v"))
        r = df.select(geometry.area(g), geometry.area(F.col("v")), F.col("g.kind") == F.col("v.kind"), geometry.is_valid(F.col("v"))).first()
        assert abs(r[0] - r[1]) < 1e-9 and r[2] and r[3], form


def test_measures_and_rounding(spark):
    g = F.col("g")
    r = wkt(spark, FORMS[2]).select(geometry.area(g), geometry.vertices(g), geometry.bbox(g)).first()
    assert r[0] == 15.5 and r[1] == 9 and tuple(r[2]) == (0.0, 0.0, 4.0, 4.0)
    got = one(spark, *[geometry.round_half_away(F.lit(v), d) for v, d in ((2.5, 0), (-2.5, 0), (1.005, 2), (-0.125, 2))])
    assert tuple(got) == (3.0, -3.0, 1.0, -0.13)
    assert tuple(one(spark, *[geometry.plain_number(F.lit(v)) for v in (1895.0, 12345678.5, -0.25, 1e-5, 0.1)])) == ("1895", "12345678.5", "-0.25", "0.00001", "0.1")


def test_hash_ignores_start_but_not_direction(spark):
    ring = ["0 0", "4 0", "4 4", "0 3"]
    turned = [ring[k:] + ring[:k] for k in range(4)]
    text_of = lambda r: f"POLYGON(({','.join([*r, r[0]])}))"
    h = lambda s, o=False: wkt(spark, s).select(geometry.geometry_hash(F.col("g"), o), geometry.blake3_hash(F.col("g"))).first()
    first = h(text_of(ring))
    assert len(first[0]) == len(first[1]) == 32 and all(h(text_of(r)) == first for r in turned)
    back = h(text_of(ring[::-1]))
    assert back[0] != first[0] and back[1] != first[1]
    assert h(text_of(ring), True)[0] == h(text_of(ring[::-1]), True)[0]
    assert first[0] == hashlib.sha256(b"Polygon:0 0,4000000 0,4000000 4000000,0 3000000").digest()
    want = b"POLYGONEXT" + struct.pack("<8q", 0, 0, 4000000, 0, 4000000, 4000000, 0, 3000000)
    assert first[1] == blake3(want)


def test_ewkb(spark):
    p = wkt(spark, "POINT(1 2)").select(geometry.to_ewkb(F.col("g"), 2154)).first()[0]
    assert bytes(p) == struct.pack("<BIIdd", 1, 0x20000001, 2154, 1, 2)
    plain = struct.pack("<BIdd", 1, 1, 1, 2)
    assert geometry.add_srid(plain, 2154) == bytes(p) and geometry.add_srid(b"\x01", 1) == b"\x01"
    assert geometry.add_srid(struct.pack(">BI", 0, 3), 4326) == struct.pack(">BII", 0, 0x20000003, 4326)
    for form, code in zip(FORMS, (1, 2, 3, 6, 4, 5)):
        b = bytes(wkt(spark, form).select(geometry.to_ewkb(F.col("g"), 4326)).first()[0])
        assert struct.unpack("<I", b[1:5])[0] == 0x20000000 | code
