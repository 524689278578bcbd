import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from parcelspark.operators.references import Bitmap, orphan_counts, orphan_references

NUMBERS = st.one_of(st.lists(st.integers(0, 300_000), max_size=50), st.integers(5000, 9000).map(lambda n: list(range(0, n))))


@given(NUMBERS, NUMBERS)
def test_bitmap(a, b):
    x, y = Bitmap.of(np.array(a, np.int64)), Bitmap.of(np.array(b, np.int64))
    assert x.decode().tolist() == sorted(set(a))
    assert x.and_not(y).decode().tolist() == sorted(set(a) - set(b))


def frames(spark, refs, objects):
    r = spark.createDataFrame(refs, "ref_id long, archive_name string, vec_seq int, rty string, rid string, loaded_at timestamp, key string")
    o = spark.createDataFrame(objects, "obj_id long, archive_name string, vec_seq int, rty string, rid string, arcs array<string>, loaded_at timestamp, deleted_at timestamp, grp string")
    return r, o


def test_orphans(spark):
    from datetime import datetime as D

    t = D(2024, 5, 6)
    objects = [(1, "a", 1, "PAR", "Arc_1", None, t, None, ""), (2, "a", 1, "PAR", "Arc_2", None, t, t, ""), (3, "a", 1, "PFE", "F", [" Arc_1", "Arc_2", None, " ", "arc_1"], t, None, ""),
               (4, "a", 1, "PFE", "G", ["nope"], t, t, ""), (5, "a", 2, "PAR", "Arc_2", None, t, None, ""), (6, "a", 1, "PAR", "Arc_2 ", None, None, t, "")]
    refs = [(1, "a", 1, "PAR", "\tArc_1 ", t, ""), (2, "a", 1, "PAR", "Arc_2", t, ""), (2, "a", 1, "PAR", "Arc_2", t, ""), (3, "a", 1, None, "x", t, ""), (4, "a", 1, "PAR", "  ", t, ""), (5, "a", 1, "PAR", None, t, ""), (6, None, 1, "PAR", "Arc_1", None, ""), (7, "a", 1, "PFE", "Arc_1", t, "")]
    r, o = frames(spark, refs, objects)
    got = {tuple(x) for x in orphan_references(r, o).collect()}
    assert got == {("reference", 2, "Arc_2", "2024-05"), ("reference", 6, "Arc_1", "none"), ("reference", 7, "Arc_1", "2024-05"), ("face", 3, "Arc_2", "2024-05"), ("face", 3, "arc_1", "2024-05")}
    assert {tuple(x) for x in orphan_counts(r, o).collect()} == {("reference", "2024-05", 2), ("reference", "none", 1), ("face", "2024-05", 2)}
    e = frames(spark, [], [])
    assert orphan_references(*e).collect() == [] and orphan_references(r, e[1]).count() == 4


def test_hot_key(spark):
    refs = [(n, "a", 1, "PAR", "gone" if n % 3 else f"Arc_{n}", None, "") for n in range(30_000)]
    objects = [(n, "a", 1, "PAR", f"Arc_{n}", None, None, None, "") for n in range(0, 30_000, 6)]
    got = orphan_references(*frames(spark, refs, objects))
    assert got.count() == sum(1 for n in range(30_000) if n % 3 or n % 6)
