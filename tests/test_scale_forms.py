"""The skew-safe forms (bucketed scans, paged lists) against plain brute force.

Data has one hot user holding about half of all rows; buckets and pages are
made tiny so that carries across buckets and multi-page groups are exercised.
"""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from visitlake.operators import last_touch_attribution, orders_per_user, pages_per_user, sessionize
from visitlake.operators.pages import paged_sorted_list, time_bucket
from visitlake.sources.tables import SCHEMAS

BASE = dt.datetime(2024, 1, 1)


def _logs(n=600, seed=7):
    rnd = random.Random(seed)
    rows, t = [], {}
    for i in range(n):
        u = 0 if rnd.random() < 0.5 else rnd.randint(1, 8)
        step = rnd.choice([5, 60, 1799, 1800, 1801, 2500, 7200, 1800.4, 1800.9])
        t[u] = t.get(u, 0) + step
        ts = BASE + dt.timedelta(seconds=t[u], microseconds=rnd.randint(0, 999_999) if u else 0)
        rows.append((ts, rnd.randint(0, 3), u, rnd.choice(["g", None]), f"/p/{rnd.randint(0, 4)}", None))
    return rows


def _brute_sessions(rows, gap=1800):
    by = {}
    for ts, _s, u, *_ in rows:
        by.setdefault(u, []).append(ts)
    out = {}
    for u, tss in by.items():
        sid, prev = 1, None
        for ts in sorted(tss):
            sec = int((ts - dt.datetime(1970, 1, 1)).total_seconds() // 1)
            if prev is not None and sec - prev > gap:
                sid += 1
            out[(u, ts)] = sid
            prev = sec
    return out


# hot_rows: None = every user bucketed; 100 = only the hot user 0 bucketed; 10**9 = one window per user
@pytest.mark.parametrize("bucket_seconds,hot_rows", [(600, None), (3600, None), (86400 * 30, None), (600, 100), (600, 10**9)])
def test_sessionize_matches_brute_force(spark, bucket_seconds, hot_rows):
    rows = _logs()
    df = spark.createDataFrame(rows, SCHEMAS["logs"])
    out = sessionize(df, bucket_seconds=bucket_seconds, hot_rows=hot_rows)
    got = {(r.userId, r.timestamp): r.session_id for r in out.collect()}
    assert got == _brute_sessions(rows)
    assert out.count() == len(rows)


def _burst(n=400, seed=17):
    """User 0 sends most rows inside one hour (sub-second to 40 s gaps); others are sparse."""
    rnd = random.Random(seed)
    rows, t = [], {0: 0.0}
    for _ in range(n):
        u = 0 if rnd.random() < 0.7 else rnd.randint(1, 4)
        if u == 0:
            t[0] += rnd.choice([0.2, 1, 3, 40])
        else:
            t[u] = t.get(u, 0) + rnd.choice([600, 1801, 5000])
        ts = BASE + dt.timedelta(seconds=t[u])
        rows.append((ts, rnd.randint(0, 2), u, "g", "/a", None))
    return rows


@pytest.mark.parametrize("hot_rows", [20, 5])
def test_sessionize_splits_hot_user_hour_per_second(spark, hot_rows):
    rows = _burst()
    df = spark.createDataFrame(rows, SCHEMAS["logs"])
    out = sessionize(df, hot_rows=hot_rows)
    got = {(r.userId, r.timestamp): (r.session_id, r.prev_timestamp) for r in out.collect()}
    want = _brute_sessions(rows)
    assert {k: v[0] for k, v in got.items()} == want
    prev = {}
    for ts, _s, u, *_ in sorted(rows, key=lambda r: (r[2], r[0])):
        assert got[(u, ts)][1] == prev.get(u)
        prev[u] = ts


def test_last_touch_with_hot_user_hour(spark):
    logs = _burst(300, seed=23)
    rnd = random.Random(3)
    orders = [(rnd.choice([0, 0, 0, 1, 2]), 500 + i, BASE + dt.timedelta(seconds=rnd.uniform(0, 20000))) for i in range(80)]
    sources = spark.createDataFrame([(s, f"s{s}") for s in range(3)], SCHEMAS["sources"])
    got = {
        r.orderId: (r.touch_timestamp, r.source_id)
        for r in last_touch_attribution(
            spark.createDataFrame(logs, SCHEMAS["logs"]), spark.createDataFrame(orders, SCHEMAS["orders"]), sources,
            hot_rows=10,
        ).collect()
    }
    for u, oid, ots in orders:
        cands = [(ts, s) for ts, s, lu, *_ in logs if lu == u and ts <= ots]
        assert got[oid] == (max(cands) if cands else (None, None))


def test_sessionize_mixed_split_uses_both_plans(spark):
    df = spark.createDataFrame(_logs(), SCHEMAS["logs"])
    plan = sessionize(df, bucket_seconds=600, hot_rows=100)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan and "Union" in plan
    light_only = sessionize(df, hot_rows=10**9)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in light_only and "_bkt" not in light_only


def test_sessionize_equals_single_window(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame(_logs(seed=11), SCHEMAS["logs"])
    w = Window.partitionBy("userId").orderBy("timestamp")
    sec = F.unix_timestamp("timestamp")
    plain = df.withColumn("d", sec - F.lag(sec).over(w)).withColumn(
        "sid", 1 + F.sum(F.when(F.col("d") > 1800, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    a = sorted((r.userId, r.timestamp, r.d, r.sid) for r in plain.collect())
    b = sorted(
        (r.userId, r.timestamp, r.time_diff, r.session_id)
        for r in sessionize(df, bucket_seconds=900, hot_rows=None).collect()
    )
    assert a == b


@pytest.mark.parametrize("page_size,split_heavy", [(1, True), (3, True), (50, True), (3, False), (10**6, True)])
def test_paged_list_matches_brute_force(spark, page_size, split_heavy):
    rows = _logs(300, seed=3)
    df = spark.createDataFrame(rows, SCHEMAS["logs"])
    out = paged_sorted_list(
        df, ["userId", "referrer"], F.col("timestamp"), time_bucket("timestamp", 600), "items",
        page_size=page_size, total_name="total", last_name="last", split_heavy=split_heavy,
    ).collect()
    groups = {}
    for ts, _s, u, ref, *_ in rows:
        groups.setdefault((u, ref), []).append(ts)
    want = {}
    for k, v in groups.items():
        v = sorted(v)
        for p in range(0, len(v), page_size):
            want[k + (p // page_size,)] = (v[p:p + page_size], None if p else len(v), v[-1])
    got = {(r.userId, r.referrer, r.page): (list(r.items), r.total, r.last) for r in out}
    assert got == want
    assert max(len(r.items) for r in out) <= page_size


def test_orders_and_pages_paged(spark):
    rnd = random.Random(5)
    orders = [(0 if rnd.random() < 0.6 else rnd.randint(1, 5), i * 37, BASE) for i in range(400)]
    users = spark.createDataFrame([(u,) for u in range(6)], SCHEMAS["users"])
    o = spark.createDataFrame(orders, SCHEMAS["orders"])
    got = orders_per_user(users, o, page_size=7).collect()
    by = {}
    for u, oid, _ in orders:
        by.setdefault(u, []).append(oid)
    for r in got:
        ids = sorted(by[r.userId])
        assert list(r.order_ids) == ids[r.page * 7:(r.page + 1) * 7]
        assert r.order_count == (len(ids) if r.page == 0 else None)
    assert sum(len(r.order_ids) for r in got) == len(orders)

    logs = spark.createDataFrame(_logs(300, seed=9), SCHEMAS["logs"])
    pv = pages_per_user(users, logs, page_size=5).collect()
    assert sorted(map(repr, pv)) == sorted(map(repr, pages_per_user(users, logs, page_size=5, split_heavy=False).collect()))
    assert sorted(map(repr, pages_per_user(users, logs, page_size=10**6).collect())) == sorted(
        map(repr, pages_per_user(users, logs, page_size=10**6, split_heavy=False).collect())
    )
    for u in {r.userId for r in pv}:
        pages = [x for r in sorted((r for r in pv if r.userId == u), key=lambda r: r.page) for x in r.pages_visited]
        want = sorted(row[4] for row in _logs(300, seed=9) if row[2] == u)
        assert pages == want
        assert all(len(r.pages_visited) <= 5 for r in pv)
        assert {r.page_count for r in pv if r.userId == u and r.page == 0} == {len(set(want))}


@pytest.mark.parametrize("hot_rows", [None, 50, 10**9])
def test_last_touch_matches_brute_force(spark, hot_rows):
    rnd = random.Random(13)
    logs = _logs(400, seed=13)
    orders = []
    for i in range(150):
        u = 0 if rnd.random() < 0.5 else rnd.randint(1, 9)  # user 9 has no logs
        orders.append((u, 10_000 + i, BASE + dt.timedelta(seconds=rnd.randint(0, 400 * 2000))))
    sources = spark.createDataFrame([(s, f"s{s}") for s in range(3)], SCHEMAS["sources"])
    got = {
        r.orderId: (r.touch_timestamp, r.source_id)
        for r in last_touch_attribution(
            spark.createDataFrame(logs, SCHEMAS["logs"]), spark.createDataFrame(orders, SCHEMAS["orders"]), sources,
            bucket_seconds=1800, hot_rows=hot_rows,
        ).collect()
    }
    for u, oid, ots in orders:
        cands = [(ts, s) for ts, s, lu, *_ in logs if lu == u and ts <= ots]
        want = max(cands) if cands else (None, None)
        assert got[oid] == want, oid


def test_time_buckets_refine_only_heavy_hours(spark):
    from visitlake.operators.skew import time_buckets

    df = spark.createDataFrame(_burst(), SCHEMAS["logs"]).withColumn("_sec", F.unix_timestamp("timestamp"))
    tb, split = time_buckets(df, "userId", "_sec", 3600, hot_rows=20)
    assert split
    b = tb.select("userId", "_sec", "_bkt.b", "_bkt.s").collect()
    hot = [r for r in b if r.userId == 0]
    assert any(r.s == r._sec for r in hot) and all(r.s in (None, r._sec) for r in hot)
    assert all(r.s is None for r in b if r.userId != 0)
    tb, split = time_buckets(df, "userId", "_sec", 3600, hot_rows=None)
    assert not split and [r.s for r in tb.select("_bkt.s").distinct().collect()] == [None]


@pytest.mark.parametrize("hot_bucket_rows", [None, 3, 10**9])
def test_paged_list_with_fine_buckets(spark, hot_bucket_rows):
    rows = _burst(300, seed=29)
    df = spark.createDataFrame(rows, SCHEMAS["logs"])
    out = paged_sorted_list(
        df, ["userId"], F.struct("timestamp", "source_id"), time_bucket("timestamp", 3600), "items",
        page_size=7, total_name="total", fine_bucket=F.unix_timestamp("timestamp"), hot_bucket_rows=hot_bucket_rows,
    ).collect()
    by = {}
    for ts, s_, u, *_ in rows:
        by.setdefault(u, []).append((ts, s_))
    for r in out:
        v = sorted(by[r.userId])
        assert [tuple(e) for e in r.items] == v[r.page * 7:(r.page + 1) * 7] and r.total == (None if r.page else len(v))
    assert sum(len(r.items) for r in out) == len(rows)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_dimension_splits_hot_fact_keys(spark, how):
    from visitlake.operators.dims import join_dimension

    rnd = random.Random(41)
    fact = spark.createDataFrame(
        [(0 if rnd.random() < 0.6 else rnd.choice([1, 2, 3, None]), i) for i in range(300)], "k bigint, v bigint"
    )
    dim = spark.createDataFrame([(0, "a"), (0, "a2"), (1, "b"), (2, "c"), (9, "z")], "k bigint, name string")
    plain = sorted(map(repr, fact.join(dim, "k", how).collect()))
    split = join_dimension(fact, dim, "k", how, max_rows=0, hot_rows=10)
    assert sorted(map(repr, split.collect())) == plain
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Union" in plan


def test_overflowing_heavy_lists_fall_back_to_safe_routes(spark):
    # max_hot_keys=1 makes every heavy-key list overflow: all users bucketed, every
    # busy bucket split per second, every group paged by rank, every join key shuffled
    from visitlake.operators.dims import join_dimension

    rows = _burst(300, seed=43)
    df = spark.createDataFrame(rows, SCHEMAS["logs"])
    got = {(r.userId, r.timestamp): r.session_id for r in sessionize(df, hot_rows=5, max_hot_keys=1).collect()}
    assert got == _brute_sessions(rows)

    out = paged_sorted_list(
        df, ["userId"], F.col("timestamp"), time_bucket("timestamp", 3600), "items", page_size=4,
        max_hot_keys=1, fine_bucket=F.unix_timestamp("timestamp"), hot_bucket_rows=2,
    ).collect()
    by = {}
    for ts, _s, u, *_ in rows:
        by.setdefault(u, []).append(ts)
    assert {(r.userId, r.page): list(r.items) for r in out} == {
        (u, p // 4): sorted(v)[p:p + 4] for u, v in by.items() for p in range(0, len(v), 4)
    }

    dim = spark.createDataFrame([(0, "a"), (1, "b")], "userId bigint, name string")
    plain = sorted(map(repr, df.join(dim, "userId", "left").collect()))
    assert sorted(map(repr, join_dimension(df, dim, "userId", "left", max_rows=0, hot_rows=1, max_hot_keys=1).collect())) == plain
