"""Null elements, tied times, text keys, zone offsets, salted joins and flat paths."""

from __future__ import annotations

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF001
from visitlake.operators import (
    flatten_sessions,
    last_touch_attribution,
    log_paths_by_campaign,
    order_counts_per_user,
    orders_per_user,
    page_counts_per_user,
    pages_per_user,
    path_summary,
    sessionize,
)
from visitlake.operators.dims import has_at_most, join_dimension, salted_join
from visitlake.operators.paths import flatten_entries, named_by_campaign
from visitlake.plans.registry import QUERIES
from visitlake.sources import load_tables, testdata
from visitlake.sources.tables import LOGS_SCHEMA, SCHEMAS, normalise, utc_ntz
from visitlake.streaming.visitors import run_visitors_stream

NOON = dt.datetime(2024, 1, 1, 12)


@pytest.mark.parametrize("page_size", [1, 2, 100])
def test_users_with_null_elements_only_stay(spark, page_size):
    users = spark.createDataFrame([(1,), (2,), (3,)], "userId bigint")
    orders = spark.createDataFrame([(1, 5), (1, None), (1, 6), (2, None), (2, None)], "userId bigint, orderId bigint")
    rows = orders_per_user(users, orders, page_size=page_size).collect()
    ids: dict = {}
    for r in sorted(rows, key=lambda r: (r.userId, r.page)):
        ids.setdefault(r.userId, []).extend(r.order_ids)
    assert ids == {1: [5, 6], 2: []}
    assert {(r.userId, r.order_count) for r in rows if r.page == 0} == {(1, 2), (2, 0)}
    assert sum(r.order_count or 0 for r in rows) == 2
    assert {tuple(r) for r in order_counts_per_user(users, orders).collect()} == {(1, 2), (2, 0)}
    logs = orders.select("userId", F.col("orderId").cast("string").alias("landing_url"))
    for split in (True, False):
        rows = pages_per_user(users, logs, page_size=page_size, split_heavy=split).collect()
        assert {(r.userId, r.page_count, r.visit_count) for r in rows if r.page == 0} == {(1, 2, 2), (2, 0, 0)}
        assert [r.pages_visited for r in rows if r.userId == 2] == [[]]
        assert sum(r.visit_count or 0 for r in rows) == 2
    assert {tuple(r) for r in page_counts_per_user(users, logs).collect()} == {(1, 2, 2), (2, 0, 0)}


def test_summaries_agree_with_lists_of_small_pages(spark):
    t = testdata.tables(spark, SF001, purchase_orders=True)
    users = t.users.union(t.users.limit(5))  # repeated users multiply counts, as the join does
    lists = orders_per_user(users, t.orders, page_size=2).where("page = 0").select("userId", "order_count")
    assert lists.exceptAll(order_counts_per_user(users, t.orders)).isEmpty()
    assert order_counts_per_user(users, t.orders).count() == lists.count()
    named = named_by_campaign(t.logs, t.campaigns)
    cols = path_summary(named).columns
    paths = log_paths_by_campaign(t.logs, t.campaigns, page_size=2)
    assert paths.where("page > 0 and entries_count is not null").isEmpty()
    assert sorted(map(repr, paths.where("page = 0").select(*cols).collect())) == sorted(map(repr, path_summary(named).collect()))


def test_broadcast_probe_counts_bytes(spark):
    rows = spark.createDataFrame([(i, "x" * 100, ["y" * 50]) for i in range(10)], "k bigint, s string, a array<string>")
    assert has_at_most(rows, 10) and not has_at_most(rows, 9)
    assert has_at_most(rows, 10, 2_500) and not has_at_most(rows, 10, 1_500)
    assert has_at_most(rows.where("k < 0"), 0, 0)


@pytest.mark.parametrize("hot_rows", [None, 10**9])
def test_tied_times_do_not_depend_on_input_order(spark, hot_rows):
    rows = [(NOON, s, 1, None, f"/{s % 3}", None) for s in range(8)] + [(NOON + dt.timedelta(hours=1), 3, 1, None, "/x", None)]
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = sorted(map(repr, sessionize(spark.createDataFrame(rows, LOGS_SCHEMA).repartition(3), hot_rows=hot_rows).collect()))
        want = want or got
        assert got == want


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_are_read_as_utc_in_any_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2024-01-01T02:00:00+02:00", "2024-01-01 00:00:00", "2023-12-31T19:00:00-0500", "2024-01-01T00:00:00Z", "1704067200"]
        got = spark.createDataFrame([(t,) for t in texts], "t string").select(utc_ntz(F.col("t"), T.StringType()).alias("u"))
        assert {r.u for r in got.collect()} == {dt.datetime(2024, 1, 1)}
        # both passes of a repeated hour, and a fraction
        epochs = spark.createDataFrame([(0.0,), (1730611800.0,), (1730615400.25,)], "t double")
        got = [r.u for r in epochs.select(utc_ntz(F.col("t"), T.DoubleType()).alias("u")).collect()]
        want = [dt.datetime(1970, 1, 1), dt.datetime(2024, 11, 3, 5, 30), dt.datetime(2024, 11, 3, 6, 30, 0, 250_000)]
        assert got == want
        instants = epochs.select(F.timestamp_micros((F.col("t") * 1_000_000).cast("bigint")).alias("t"))
        assert [r.u for r in instants.select(utc_ntz(F.col("t"), T.TimestampType()).alias("u")).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_absent_required_column_is_an_error(spark):
    with pytest.raises(ValueError, match="userId"):
        normalise(spark.range(1), SCHEMAS["users"])


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_text_keys_through_the_operators(spark, fmt):
    t = testdata.tables(spark, "/root/testdata/sf0.001", purchase_orders=True)
    root = tempfile.mkdtemp(prefix="visitlake-keys-")
    key = {"userId": "u-", "orderId": "o-", "source_id": "uuid-", "uuid": "uuid-"}
    for name in SCHEMAS:
        df = getattr(t, name)
        df = df.select(*[F.concat(F.lit(key[c]), F.col(c)).alias(c) if c in key else F.col(c) for c in df.columns])
        df.write.format(fmt).save(f"{root}/{name}")
    s = load_tables(spark, fmt, {n: f"{root}/{n}" for n in SCHEMAS}, key_type="string")
    for name in SCHEMAS:
        assert getattr(s, name).count() == getattr(t, name).count()
    pages = [orders_per_user(s.users, s.orders, page_size=n).select(F.explode("order_ids").alias("o")) for n in (3, 10_000)]
    plain = orders_per_user(t.users, t.orders).select(F.explode("order_ids").alias("o")).count()
    assert [p.distinct().count() for p in pages] == [plain, plain]
    assert log_paths_by_campaign(s.logs, s.campaigns).count() == log_paths_by_campaign(t.logs, t.campaigns).count()
    want = {(r.orderId, r.source_id) for r in last_touch_attribution(t.logs, t.orders, t.sources).collect()}
    for hot in (10**9, 5):
        got = last_touch_attribution(s.logs, s.orders, s.sources, hot_rows=hot).collect()
        assert {(int(r.orderId[2:]), r.source_id and int(r.source_id[5:])) for r in got} == want


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_the_join(spark, how):
    fact = spark.range(500).select((F.col("id") % 7).alias("k"), "id")
    dim = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (9, "d")], "k bigint, v string")
    want = sorted(map(repr, fact.join(dim, "k", how).collect()))
    assert sorted(map(repr, salted_join(fact, dim, ["k"], how).collect())) == want
    past = join_dimension(fact, dim, "k", how, max_rows=0, hot_rows=5, max_hot_keys=1)
    assert sorted(map(repr, past.collect())) == want


def test_stream_joins_a_dimension_above_the_bound(spark):
    from visitlake.streaming import visitors

    logs = spark.createDataFrame([], LOGS_SCHEMA)
    root = tempfile.mkdtemp(prefix="visitlake-stream-")
    logs.write.parquet(f"{root}/logs")
    stream = spark.readStream.schema(LOGS_SCHEMA).parquet(f"{root}/logs")
    sources = spark.createDataFrame([(1, "a")], SCHEMAS["sources"])
    assert visitors.stream_visitors_by_source_date(stream, sources, max_broadcast_rows=0).isStreaming
    assert callable(run_visitors_stream)


def test_flat_entries_equal_the_exploded_paths(spark):
    t = testdata.tables(spark, SF001)
    a = flatten_sessions(log_paths_by_campaign(t.logs, t.campaigns))
    b = flatten_entries(named_by_campaign(t.logs, t.campaigns)).select(*a.columns)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("name,shuffles", [("filter_outer_timestamp", 0), ("rebuild_sessions", 0), ("filter_time_conditions", 1)])
def test_path_filters_reach_the_scan(spark, name, shuffles):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert plan.count("Exchange hashpartitioning") == shuffles
    scan = [line for line in plan.splitlines() if "events.parquet" in line]
    assert scan and all("GreaterThanOrEqual(ts," in line for line in scan)
