from datetime import datetime

import pytest
from pyspark.sql import functions as F

from parcelspark.operators import incremental as inc


def test_versions_and_deltas(spark, tmp_path):
    t = inc.VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.version() == 0 and t.read() is None
    df = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    t.append(df(1, 2, 3))
    t.append(df(4))
    t.delete(F.col("v") == 2)
    assert sorted(r.v for r in t.read().collect()) == [1, 3, 4]
    assert sorted(r.v for r in t.read(2).collect()) == [1, 2, 3, 4]
    assert {(r.v, r._change) for r in t.changes(1, 3).collect()} == {(4, "insert"), (2, "delete")}
    assert {(r.v, r._change) for r in t.changes(3, 2).collect()} == {(2, "insert")}
    assert t.changes(3, 3) is None
    t.delete(F.lit(True))
    assert t.entries(t.version()) == [] and {(r.v, r._change) for r in t.changes(3, 4).collect()} == {(1, "delete"), (3, "delete"), (4, "delete")}


def test_two_writers_one_fails(spark, tmp_path):
    t = inc.VersionedTable(spark, f"file://{tmp_path}/t")
    t.commit(0)
    with pytest.raises(RuntimeError):
        t.commit(0)


def test_manifests_are_incremental(spark, tmp_path):
    t = inc.VersionedTable(spark, f"file://{tmp_path}/t")
    t.CHECKPOINT = 4
    for k in range(9):
        t.append(spark.range(k, k + 1), {"k": k})
    t.delete(F.col("id") == 5)
    assert sorted(r.id for r in t.read().collect()) == [0, 1, 2, 3, 4, 6, 7, 8] and t.state(10).meta == {"k": 8}
    assert len(t._load(f"{9:012d}.json")["add"]) == 1 and len(t._load(f"{8:012d}.whole")["files"]) == 8
    assert sorted(r.id for r in t.read(t.commit(10, like=3)).collect()) == [0, 1, 2]
    assert t.read(t.clear()) is None and t.state(12).meta["k"] == 2


@pytest.mark.parametrize("step", ["changes", "transform", "write_files", "_save"])
def test_failure_neither_skips_nor_repeats(spark, tmp_path, monkeypatch, step):
    """Killed at each step and run again: what is there comes out once."""
    src, out = (inc.VersionedTable(spark, f"file://{tmp_path}/{n}", "v int") for n in ("src", "out"))
    df = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    take = lambda d: d.filter("_change = 'insert'").select("v")
    src.append(df(1, 2))
    inc.process_new(src, out, "job", take)
    src.append(df(3))
    src.delete(F.col("v") == 1)

    def dies(*_):
        raise ZeroDivisionError

    if step == "transform":
        with pytest.raises(ZeroDivisionError):
            inc.process_new(src, out, "job", dies)
    else:
        with monkeypatch.context() as m, pytest.raises(ZeroDivisionError):
            m.setattr(src if step == "changes" else out, step, dies)
            inc.process_new(src, out, "job", take)
    assert sorted(r.v for r in out.read().collect()) == [1, 2]
    inc.process_new(src, out, "job", take)
    assert inc.process_new(src, out, "job", dies) is None
    assert sorted(r.v for r in out.read().collect()) == [1, 2, 3]


def test_archive_delta(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1, h)
    files = spark.createDataFrame([(1, "a", " AB ", at(1)), (2, "a", "cd", at(1)), (3, "b", "x", at(2)), (4, "c", None, at(1)), (5, "d", "n", None), (6, "e", "ok", at(1)), (7, "f", "old", at(3)), (8, "f", "new", at(2)), (9, None, "q", at(1)), (10, None, "q", at(2))], "file_seq long, archive_name string, checksum string, delivered_at timestamp_ntz")
    ledger = spark.createDataFrame([("a", "CD\t", at(1), 1), ("b", "y", at(1), 1), ("b", "x", at(2), 2), ("c", "z", at(1), 1), ("e", "no", at(1), 1), ("e", "OK", at(2), 1), ("e", "OK", at(2), 1), ("f", "new", at(9), 3)], "archive_name string, checksum string, imported_at timestamp_ntz, run_id long")
    runs = spark.createDataFrame([(1, "Success"), (2, "Failed"), (3, None)], "run_id long, status string")
    files.write.parquet(f"file://{tmp_path}/files")
    files.limit(0).write.parquet(f"file://{tmp_path}/none")
    ledger.write.parquet(f"file://{tmp_path}/ledger")
    take = lambda a, b: inc.archive_delta(spark, f"file://{tmp_path}/{a}", f"file://{tmp_path}/{b}", runs, f"file://{tmp_path}/{a}-{b}")
    got = {(r.file_seq, r.change) for r in take("files", "ledger").collect()}
    assert got == {(3, "changed"), (4, "changed"), (5, "added"), (7, "added"), (9, "added"), (10, "added")}
    assert take("files", "ledger").count() == 6  # made once, then read
    assert take("none", "ledger").count() == 0


def test_batch_is_all_or_nothing(spark, tmp_path):
    a, b, ledger = (inc.VersionedTable(spark, f"file://{tmp_path}/{n}") for n in "abl")
    df = spark.range(3)
    with inc.Batch(ledger) as t:
        t.append(a, df)
        t.append(b, df)
        t.append(a, df)
    assert t.status == "Success" and t.counts[a.root] == 6 and a.read(inc.visible_version(a, ledger)).count() == 6
    with pytest.raises(ZeroDivisionError), inc.Batch(ledger) as t:
        t.append(a, df)
        1 / 0  # noqa: B018
    assert t.status == "RolledBack" and t.counts[a.root] == 0 and a.read(inc.visible_version(a, ledger)).count() == 6


def test_runs(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    files = spark.createDataFrame([(1, "a", "x", at(1)), (2, "a", "y", at(5)), (3, "b", None, at(2)), (4, None, "z", at(1)), (5, "c", "q", None)], "file_seq long, archive_name string, checksum string, delivered_at timestamp_ntz")
    runs = spark.createDataFrame([(1, at(1), at(2), "Success"), (2, at(3), None, None), (3, at(4), at(6), "Success"), (4, at(6), at(7), "Failed"), (5, None, None, "Success")], "run_id long, started_at timestamp_ntz, finished_at timestamp_ntz, status string")
    ledger = spark.createDataFrame([("a", "X ", at(2), 1), ("b", "w", at(5), 3), ("a", "y", at(6), 4)], "archive_name string, checksum string, imported_at timestamp_ntz, run_id long")
    got = {(r.run_id, r.file_seq, r.change) for r in inc.run_takes(files, ledger, runs).collect()}
    assert got == {(1, 1, "added"), (2, 3, "added"), (3, 3, "added"), (4, 2, "changed"), (4, 3, "changed")}
    assert inc.run_takes(files, ledger, runs.limit(0)).count() == 0 and inc.run_takes(files.limit(0), ledger, runs).count() == 0
