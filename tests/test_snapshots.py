import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from parcelspark.operators import snapshots

SCHEMA = "row_id long, id string, departement string, delivery_no int, contenance int, section_id string, valid_from date, geometry_hash binary, created_at timestamp_ntz, k string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute(rows):
    clean = lambda s: None if s is None else s.strip().upper()
    deps = {}
    for r in rows:
        if r[6] is not None:
            v = deps.setdefault(r[2], {}).setdefault(r[6], [])
            v.append(r)
    history, changes = set(), set()
    for vs in deps.values():
        order = sorted(vs)
        state = []
        for v in order:
            top = max((-1 if r[3] is None else r[3]) for r in vs[v])
            now = {}
            for r in sorted(vs[v], key=lambda r: (r[8] is not None, r[8] or datetime.min, r[0])):
                if (-1 if r[3] is None else r[3]) == top and r[7] is not None and r[1] is not None:
                    now[clean(r[1])] = (bytes(r[7]), r[4], r[5])
            state.append(now)
        for k in range(1, len(order)):
            a, b = state[k - 1], state[k]
            changes |= {(i, str(order[k]), "added") for i in b.keys() - a.keys()} | {(i, str(order[k]), "removed") for i in a.keys() - b.keys()}
            changes |= {(i, str(order[k]), "changed") for i in a.keys() & b.keys() if a[i][0] != b[i][0]}
        for i in {i for s in state for i in s}:
            run = None
            for k in range(len(order) + 1):
                now = state[k].get(i) if k < len(order) else None
                if run and (now is None or now != run[1]):
                    history.add((i, str(order[run[0]]), str(order[k]) if k < len(order) else ""))
                    run = None
                if now is not None and run is None:
                    run = (k, now)
    return history, changes


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for n in range(1500):
        i = rng.choice(["p1", "P1 ", "\tp2", "P3", "P4", "p5", None if rng.random() < 0.05 else "P6"])
        rows.append((n, i, rng.choice(["01", "02"]), rng.choice([1, 1, 1, 2]), rng.choice([5, 5, None]), rng.choice(["s", None]), date(2024, rng.randint(1, 12), 1) if rng.random() > 0.02 else None,
                     None if rng.random() < 0.1 else rng.choice([b"a" * 32, b"b" * 32]), None if rng.random() < 0.1 else datetime(2024, 1, 1, rng.randint(0, 23)), "x"))
    h, c = brute(rows)
    df = frame(spark, rows).repartition(5)
    assert {tuple(r) for r in snapshots.history_text(df).collect()} == h
    assert {tuple(r) for r in snapshots.snapshot_changes_text(df).collect()} == c


def test_many_rows_cross_batches(spark):
    rows = [(n, f"P{n % 9000:05d}", "01", 1, 1, "s", date(2024, 1 + n // 9000, 1), bytes([n % 7 // 6]) * 32, datetime(2024, 1, 1), "x") for n in range(36_000)]
    h, c = brute(rows)
    df = frame(spark, rows).coalesce(1)
    assert {tuple(r) for r in snapshots.history_text(df).collect()} == h
    assert {tuple(r) for r in snapshots.snapshot_changes_text(df).collect()} == c


def test_empty(spark):
    df = frame(spark, [])
    assert snapshots.history_text(df).collect() == [] and snapshots.snapshot_changes_text(df).collect() == []


def test_stored_index(spark, tmp_path):
    at = f"file://{tmp_path}/ix"
    ix = snapshots.SnapshotIndex(spark, at, ["id"], "h", 4, ("v",))
    s = lambda rows: spark.createDataFrame(rows, "id string, h string, v int, change string")
    one = s([("a", "1", 1, "x"), ("b", "1", 1, "x"), ("c", None, 1, "x"), (None, "1", 1, "x")])
    assert {(r["id"], r["change"], r["now_v"]) for r in ix.advance(one).collect()} == {("a", "added", 1), ("b", "added", 1), ("c", "added", 1)}
    two = s([("a", "2", 2, "x"), ("c", None, 1, "x"), ("d", "1", 1, "x")])
    ix = snapshots.SnapshotIndex(spark, at, ["id"], "h", 99, ("v",))  # another run: the buckets are those it was made with
    got = {(r["id"], r["change"], r["old"]["v"] if r["old"] else None, r["was_v"]) for r in ix.advance(two, one).collect()}
    assert ix.buckets == 4 and got == {("a", "changed", 1, 1), ("b", "removed", 1, 1), ("d", "added", None, None)}
    assert ix.advance(two).collect() == [] and ix.vacuum() == 2 and sorted(r.id for r in ix.index().collect()) == ["a", "c", "d"]


def test_index_is_probed_without_a_shuffle(spark, tmp_path, monkeypatch):
    ix = snapshots.SnapshotIndex(spark, f"file://{tmp_path}/ix", ["id"], "h", 4)
    df = spark.range(100).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("h"))
    ix.advance(df)
    plans = []
    monkeypatch.setattr(snapshots, "table_path", lambda s, t: f"file://{tmp_path}/{t}")
    write = type(df.write).parquet
    monkeypatch.setattr(type(df.write), "parquet", lambda w, at: (plans.append(w._df._jdf.queryExecution().executedPlan().toString()), write(w, at)))
    assert ix.advance(df).count() == 0
    assert "Exchange" not in plans[0] and "SortMergeJoin" in plans[0]


def test_died_before_the_swap(spark, tmp_path, monkeypatch):
    ix = snapshots.SnapshotIndex(spark, f"file://{tmp_path}/ix", ["id"], "h", 4)
    one, two = (spark.createDataFrame([(i, h) for i, h in rows], "id string, h string") for rows in ([("a", "1")], [("a", "2"), ("b", "1")]))
    ix.advance(one)
    with monkeypatch.context() as m, pytest.raises(ZeroDivisionError):
        m.setattr(snapshots, "table_path", lambda *_: 1 / 0)
        ix.advance(two)
    assert {tuple(r) for r in ix.advance(two).collect()} == {("a", "changed"), ("b", "added")}
