"""Time conditions as a table against a plain loop."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from visitlake import api
from visitlake.operators import filter_time_condition_table, filter_time_conditions
from visitlake.operators.intervals import coalesced_bins

START = dt.datetime(2024, 1, 1)
SCHEMA = "timestamp timestamp_ntz, bin int, spans string, _row int"


def moment(rng, days=3):
    return START + dt.timedelta(seconds=rng.randrange(days * 86400), microseconds=rng.choice((0, 1, 999_999)))


def plain(rows, conditions, op):
    def inside(ts, lo, hi):
        return ts is not None and (lo is None or ts >= lo) and (hi is None or ts <= hi)

    if not conditions:
        return set(rows)
    if op == "OR":
        return {r for r in rows if any(inside(r[0], *c) or c == (None, None) for c in conditions)}
    return {r for r in rows if all(inside(r[0], *c) or c == (None, None) for c in conditions)}


CASES = {
    "many": lambda rng: [(a, a + dt.timedelta(seconds=rng.randrange(4000))) for a in (moment(rng) for _ in range(300))],
    "open": lambda rng: [(None, START + dt.timedelta(hours=2)), (START + dt.timedelta(days=2), None), (moment(rng), moment(rng)), (None, START)],
    "long": lambda rng: [(START - dt.timedelta(days=90), START + dt.timedelta(hours=7)), (START + dt.timedelta(hours=7), START + dt.timedelta(hours=8))],
    "reversed": lambda rng: [(START + dt.timedelta(days=2), START)],
    "points": lambda rng: [(START + dt.timedelta(hours=i), START + dt.timedelta(hours=i)) for i in range(50)] * 3,
    "all": lambda rng: [(None, None), (START, START)],
    "none": lambda rng: [],
    "narrowing": lambda rng: [(START, None), (None, START + dt.timedelta(days=1)), (START + dt.timedelta(hours=3), START + dt.timedelta(days=9))],
}


@pytest.mark.parametrize("op", ["OR", "AND"])
@pytest.mark.parametrize("case", CASES)
def test_conditions_as_a_table(spark, case, op):
    rng = random.Random(len(case))
    rows = [(moment(rng), i % 3, "x", 1) for i in range(400)] + [(START + dt.timedelta(hours=i), 0, None, None) for i in range(30)] + [(None, 1, "n", 2)]
    rows += rows[:40]
    conditions = CASES[case](rng)
    df = spark.createDataFrame(rows, SCHEMA)
    table = spark.createDataFrame(conditions, "dateFrom timestamp_ntz, dateTo timestamp_ntz")
    for most in (200_000, 0):  # broadcast, and by shuffle
        got = filter_time_condition_table(df, table, op, bin_seconds=3600, max_broadcast_rows=most)
        assert got.columns == df.columns
        found = [tuple(r) for r in got.collect()]
        assert len(found) == len(set(found)) and set(found) == plain(rows, conditions, op)
    if conditions and len(conditions) < 10 and (None, None) not in conditions:
        assert {tuple(r) for r in filter_time_conditions(df, conditions, op).collect()} == set(found)


def test_spans_of_a_bin_are_disjoint(spark):
    rng = random.Random(4)
    ranges = [(a, a + dt.timedelta(seconds=rng.randrange(9000))) for a in (moment(rng) for _ in range(500))]
    for r in coalesced_bins(spark.createDataFrame(ranges, "lo timestamp_ntz, hi timestamp_ntz"), 3600).collect():
        ends = [x for s in r.spans for x in (s.lo, s.hi)]
        assert all(a <= b for a, b in zip(ends[::2], ends[1::2])) and all(a < b for a, b in zip(ends[1::2], ends[2::2]))


def test_plan_does_not_grow_with_the_conditions(spark, tmp_path):
    rng = random.Random(5)
    spark.createDataFrame([(moment(rng), 1, "x", 1) for _ in range(200)], SCHEMA).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    sizes = []
    for n in (10, 10_000):
        path = str(tmp_path / f"conditions{n}")
        spark.createDataFrame(CASES["many"](rng)[:10] * (n // 10), "dateFrom timestamp_ntz, dateTo timestamp_ntz").write.parquet(path)
        plan = filter_time_condition_table(df, spark.read.parquet(path))._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert "GreaterThanOrEqual(timestamp" in plan.split("PushedFilters")[1] or "GreaterThanOrEqual(timestamp" in plan
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        sizes.append(plan.count("\n"))
    assert sizes[0] == sizes[1]


def test_logs_endpoint_with_conditions(spark, micro):
    day = [{"dateFrom": "2024-01-01 05:00:00", "dateTo": "2024-01-01 07:00:00"}, ("2024-01-02", None)]
    got = api.logs(micro, day).collect()
    assert sorted((r.userId, r.timestamp[:16]) for r in got) == [(2, "2024-01-02T00:10"), (9, "2024-01-01T06:00")]
    assert all(len(r.full_session) == 1 for r in got)
    table = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 1, 7)), (dt.datetime(2024, 1, 2), None)], "dateFrom timestamp_ntz, dateTo timestamp_ntz")
    assert sorted(map(str, api.logs(micro, table).collect())) == sorted(map(str, got))
    assert api.logs(micro, day, "AND").count() == 0 and api.logs(micro, day, as_json=True).columns == ["json"]
