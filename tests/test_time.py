"""Time semantics: whole-second gaps, local wall time, bounds, leap day, session zone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from conftest import T
from visitlake.functions import local_time, local_time_range, seconds_text, iso_utc_text, trailing_year_bounds
from visitlake.operators import sessionize, visitors_by_source_date
from visitlake.sources.tables import SCHEMAS


def _one_user(spark, times):
    rows = [(T(t), 1, 1, "g", "/a", None) for t in times]
    return spark.createDataFrame(rows, SCHEMAS["logs"])


def test_gap_uses_whole_seconds(spark):
    s = sessionize(_one_user(spark, ["2024-01-01 00:00:00", "2024-01-01 00:30:00.900000"])).collect()
    assert sorted((r.time_diff if r.time_diff is not None else -1, r.session_id) for r in s) == [(-1, 1), (1800, 1)]
    s = sessionize(_one_user(spark, ["2024-01-01 00:30:00", "2024-01-01 01:00:01.100000"])).collect()
    assert sorted(((r.time_diff or 0), r.session_id) for r in s) == [(0, 1), (1801, 2)]


def test_local_time_dst(spark):
    df = spark.createDataFrame([(T("2024-03-28 23:59:59"),), (T("2024-03-29 00:00:00"),)], "ts timestamp_ntz")
    got = [r.l for r in df.select(local_time("ts", "Asia/Jerusalem").alias("l")).orderBy("l").collect()]
    assert got == [T("2024-03-29 01:59:59"), T("2024-03-29 03:00:00")]


def test_date_only_upper_bound_is_midnight(spark):
    df = spark.createDataFrame([(T("2024-01-01 22:00:00"),), (T("2024-01-01 22:00:01"),)], "ts timestamp_ntz")
    # 22:00Z is 00:00 local on 2 Jan; 22:00:01Z is after the bound
    out = local_time_range(df, "ts", "2024-01-01", "2024-01-02", "Asia/Jerusalem").collect()
    assert [r.ts for r in out] == [T("2024-01-01 22:00:00")]


def test_open_bounds(spark):
    df = spark.createDataFrame([(T("2020-01-01 00:00:00"),), (T("2030-01-01 00:00:00"),)], "ts timestamp_ntz")
    assert local_time_range(df, "ts", None, None).count() == 2
    assert local_time_range(df, "ts", "2025-01-01", None).count() == 1


def test_dst_overlap_rows_are_kept(spark):
    # 22:30Z and 23:30Z on 2024-10-26 both read 01:30 local (clocks go back)
    df = spark.createDataFrame([(T("2024-10-26 22:30:00"),), (T("2024-10-26 23:30:00"),)], "ts timestamp_ntz")
    out = local_time_range(df, "ts", "2024-10-27 01:30:00", "2024-10-27 01:30:00", "Asia/Jerusalem")
    assert out.count() == 2


def test_leap_day_minus_a_year(spark):
    lo, hi = trailing_year_bounds("2024-02-29")
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert (r.lo, r.hi) == (dt.date(2023, 2, 28), dt.date(2024, 2, 29))


def test_text_forms(spark):
    df = spark.createDataFrame([(T("2024-01-01 01:02:03.456000"),)], "ts timestamp_ntz")
    r = df.select(seconds_text("ts").alias("s"), iso_utc_text("ts").alias("i")).first()
    assert (r.s, r.i) == ("2024-01-01 01:02:03", "2024-01-01T01:02:03.456000Z")


def test_results_do_not_depend_on_session_zone(spark, micro):
    base = sorted(visitors_by_source_date(micro.logs, micro.sources, "2024-02-01").collect())
    sess = sorted((r.userId, r.timestamp, r.session_id) for r in sessionize(micro.logs).collect())
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert sorted(visitors_by_source_date(micro.logs, micro.sources, "2024-02-01").collect()) == base
        assert sorted((r.userId, r.timestamp, r.session_id) for r in sessionize(micro.logs).collect()) == sess
        df = spark.createDataFrame([(T("2024-03-10 02:30:00"),)], "ts timestamp_ntz")
        assert df.select(seconds_text("ts").alias("s")).first().s == "2024-03-10 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_registered_time_queries_do_not_depend_on_session_zone(spark):
    from __spark_entry__ import queries

    names = ["conversions_by_date", "last_touch_conversions", "local_time_range", "rebuild_sessions", "tz_local_date",
             "date_format_second", "visitors_once_per_session"]
    sf = "/root/testdata/sf0.001"

    def rows(name):
        return sorted(repr(r) for r in queries()[name](spark, sf).collect())

    base = {n: rows(n) for n in names}
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        for n in names:
            assert rows(n) == base[n], n
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
