"""Streaming session summary equals the batch one (file source -> parquet sink)."""

from __future__ import annotations

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from conftest import T
from test_scale_forms import _logs
from visitlake.operators import session_summary
from visitlake.sources.tables import SCHEMAS
from visitlake.streaming import run_session_stream, stream_session_summary

COLS = ["userId", "session_start", "session_end", "duration_seconds", "entries", "first_page", "last_page", "first_source_id"]


def _rows(df):
    return sorted(tuple(r[c] for c in COLS) for r in df.collect())


def test_batch_form_matches_session_summary(spark):
    df = spark.createDataFrame(_logs(500, seed=21), SCHEMAS["logs"])
    assert _rows(stream_session_summary(df)) == _rows(session_summary(df))


def test_file_stream_emits_closed_sessions(spark):
    rows = _logs(300, seed=4)
    last = max(r[0] for r in rows)
    flush = (last + dt.timedelta(days=1), 0, 999, None, "/flush", None)  # moves the watermark past every session
    src = tempfile.mkdtemp(prefix="visitlake-src-")
    out = tempfile.mkdtemp(prefix="visitlake-out-")
    ckpt = tempfile.mkdtemp(prefix="visitlake-ck-")
    df = spark.createDataFrame(rows, SCHEMAS["logs"])
    df.repartition(3).write.mode("append").parquet(src)
    spark.createDataFrame([flush], SCHEMAS["logs"]).write.mode("append").parquet(src)
    q = run_session_stream(spark, src, out + "/sessions", ckpt + "/c", max_files_per_trigger=2)
    q.awaitTermination(300)
    got = spark.read.parquet(out + "/sessions").where(F.col("userId") != 999)
    assert _rows(got) == _rows(session_summary(df))


def test_whole_second_gap_rule(spark):
    df = spark.createDataFrame(
        [(T("2024-01-01 00:00:00.500000"), 1, 1, None, "/a", None), (T("2024-01-01 00:30:00.900000"), 1, 1, None, "/b", None),
         (T("2024-01-01 01:00:01.100000"), 1, 1, None, "/c", None)],
        SCHEMAS["logs"],
    )
    assert sorted(r.entries for r in stream_session_summary(df).collect()) == [1, 2]


def test_visitors_stream_equals_batch(spark):
    from visitlake.operators import visitors_by_source_date
    from visitlake.streaming import run_visitors_stream

    rows = _logs(400, seed=31)
    last = max(r[0] for r in rows)
    flush = (last + dt.timedelta(days=2), 0, 999, None, "/flush", None)
    sources = spark.createDataFrame([(s, f"s{s}") for s in range(3)], SCHEMAS["sources"])
    src = tempfile.mkdtemp(prefix="visitlake-vsrc-")
    out = tempfile.mkdtemp(prefix="visitlake-vout-")
    ckpt = tempfile.mkdtemp(prefix="visitlake-vck-")
    df = spark.createDataFrame(rows, SCHEMAS["logs"])
    df.repartition(2).write.mode("append").parquet(src)
    spark.createDataFrame([flush], SCHEMAS["logs"]).write.mode("append").parquet(src)
    q = run_visitors_stream(spark, src, out + "/v", sources, ckpt + "/c")
    q.awaitTermination(300)
    got = sorted(tuple(r) for r in spark.read.parquet(out + "/v").select("date", "source_name", "visitors").collect())
    want = sorted(tuple(r) for r in visitors_by_source_date(df, sources, "2024-12-31").select("date", "source_name", "visitors").collect())
    assert got == want and got
