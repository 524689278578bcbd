from datetime import date, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from parcelspark.operators.intervals import coverage, merged_ranges

D0 = date(2020, 1, 1)


def brute(rows):
    out = []
    ids = {}
    for i, a, b in rows:
        if i is not None and a is not None and (b is None or b > a):
            ids.setdefault(i, []).append((a, b or date.max))
    for i, spans in ids.items():
        days, merged = sorted(spans), []
        for a, b in days:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for k, (a, b) in enumerate(merged):
            out.append((i, "period", str(a), "" if b == date.max else str(b)))
            if k:
                out.append((i, "gap", str(merged[k - 1][1]), str(a)))
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, a, b, "x") for i, a, b in rows], "id string, valid_from date, valid_to date, lo string")
    return sorted(tuple(r) for r in coverage(df.repartition(3), **kw).collect())


def test_cases(spark):
    d = lambda n: D0 + timedelta(n)
    rows = [("a", d(0), d(5)), ("a", d(5), d(7)), ("a", d(1), d(2)), ("a", d(9), None), ("a", d(9), None), ("b", d(3), d(3)), ("b", d(4), d(2)), ("c", None, d(1)), (None, d(0), d(1)), ("d", d(-9000), d(-8000))]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_hot_entity(spark):
    rows = [("hot", D0 + timedelta(k % 400 * 2), D0 + timedelta(k % 400 * 2 + 1)) for k in range(30_000)] + [(f"i{k}", D0, None) for k in range(100)]
    assert run(spark, rows, hot=16, salts=4) == brute(rows)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "é"]), st.integers(0, 60), st.one_of(st.none(), st.integers(0, 60))), max_size=40))
def test_random(spark, raw):
    rows = [(i, D0 + timedelta(a), None if b is None else D0 + timedelta(b)) for i, a, b in raw]
    assert run(spark, rows) == brute(rows)


def test_merged_ranges(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 3, 9), ("b", 1, 2), ("a", 20, 21)], "id string, lo int, hi int")
    assert sorted(tuple(r) for r in merged_ranges(df).collect()) == [("a", 0, 9), ("a", 20, 21), ("b", 1, 2)]
