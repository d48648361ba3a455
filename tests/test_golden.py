"""Golden micro-fixture: expected rows worked out by hand (FIXTURES.md §3)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from conftest import T
from visitlake.operators import (
    conversions_by_date,
    last_touch_attribution,
    log_paths_by_campaign,
    orders_per_user,
    pages_per_user,
    session_summary,
    sessionize,
    visitors_by_source_date,
    visitors_once_per_session,
    visits_by_user_source_date,
)

AS_OF = "2024-02-01"
D1 = dt.date(2024, 1, 1)


def test_orders_per_user(micro):
    rows = orders_per_user(micro.users, micro.orders).collect()
    got = sorted((r.userId, r.order_count, list(r.order_ids), r.page) for r in rows)
    assert got == [(1, 2, [100, 101], 0), (2, 1, [102], 0), (3, 1, [103], 0)]


def test_pages_per_user(micro):
    rows = pages_per_user(micro.users, micro.logs).collect()
    got = sorted((r.userId, r.page_count, list(r.pages_visited), r.visit_count) for r in rows)
    assert got == [(1, 2, ["/a", "/a", "/b"], 3), (2, 1, ["/a", "/a"], 2)]


def test_visits_by_user_source_date(micro):
    rows = visits_by_user_source_date(micro.logs, micro.sources, AS_OF).collect()
    got = sorted(((r.date, r.source_name, r.userId, r.visits) for r in rows), key=repr)
    want = [(D1, "google", None, 1), (D1, "google", 1, 2), (D1, "google", 2, 1), (D1, "google", 9, 2), (D1, "mail", 1, 1)]
    assert got == sorted(want, key=repr)


def test_visitors_by_source_date(micro):
    rows = visitors_by_source_date(micro.logs, micro.sources, AS_OF).collect()
    assert sorted((r.date, r.source_name, r.visitors) for r in rows) == [(D1, "google", 3), (D1, "mail", 1)]


def test_visitors_as_of_excludes_old(micro):
    assert visitors_by_source_date(micro.logs, micro.sources, "2025-06-01").count() == 0


def test_session_ids(micro):
    rows = sessionize(micro.logs).orderBy("userId", "timestamp").collect()
    got = {}
    for r in rows:
        got.setdefault(r.userId, []).append(r.session_id)
    assert got == {1: [1, 1, 2], 2: [1, 1], 9: [1, 2]}
    first = [r for r in rows if r.userId == 1][0]
    assert first.prev_timestamp is None and first.time_diff is None and first.session_break == 0


def test_sessionize_keeps_null_user_partition(micro):
    rows = sessionize(micro.logs, drop_null_users=False).where(F.col("userId").isNull()).collect()
    assert [r.session_id for r in rows] == [1]


def test_log_paths_by_campaign(micro):
    rows = log_paths_by_campaign(micro.logs, micro.campaigns).collect()
    got = sorted(
        ((r.userId, r.source_id, r.referrer, r.landing_url, r.campaign_name, r.entries_count, r.timestamp) for r in rows),
        key=repr,
    )
    want = [
        (1, 10, None, "/a", "Google ads", 1, T("2024-01-01 00:00:00")),
        (1, 10, "g", "/b", "Google ads", 1, T("2024-01-01 00:30:00")),
        (1, 11, "g", "/a", "Unknown", 1, T("2024-01-01 01:00:01")),
        (2, 10, "g", "/a", "Google ads", 1, T("2024-01-01 23:50:00")),
        (2, 99, "g", "/a", "Unknown", 1, T("2024-01-02 00:10:00")),
        (9, 10, "g", "/a", "Google ads", 2, T("2024-01-01 08:00:00")),
    ]
    assert got == sorted(want, key=repr)
    nine = [r for r in rows if r.userId == 9][0]
    assert [e.timestamp for e in nine.full_session] == [T("2024-01-01 06:00:00"), T("2024-01-01 08:00:00")]
    assert nine.full_session[0].asDict() == {
        "timestamp": T("2024-01-01 06:00:00"), "source_id": 10, "referrer": "g",
        "landing_url": "/a", "campaign_name": "Google ads", "userId": 9,
    }


def test_conversions_by_date_no_range(micro):
    rows = conversions_by_date(micro.logs, micro.orders, micro.sources).collect()
    got = sorted(((r.date_only, r.source_name, r.conversion_count, [c.orderId for c in r.conversions]) for r in rows), key=repr)
    want = [(dt.date(2024, 1, 1), "mail", 1, [101]), (dt.date(2024, 1, 2), None, 1, [102])]
    assert got == sorted(want, key=repr)
    mail = [r for r in rows if r.source_name == "mail"][0]
    assert mail.conversions[0].date_time == "2024-01-01 03:00:01"  # Jerusalem is UTC+2 in January


def test_visitors_once_per_session(micro):
    rows = visitors_once_per_session(micro.logs, micro.sources, AS_OF).collect()
    assert sorted((r.date, r.source_name, r.visitors) for r in rows) == [(D1, "google", 4), (D1, "mail", 1)]


def test_last_touch_attribution(micro):
    rows = last_touch_attribution(micro.logs, micro.orders, micro.sources).collect()
    assert {r.orderId: r.source_id for r in rows} == {100: 10, 101: 11, 102: 10, 103: None, 104: None}


def test_session_summary(micro):
    rows = session_summary(micro.logs).collect()
    got = {(r.userId, r.session_id): r.entries for r in rows}
    assert got == {(1, 1): 2, (1, 2): 1, (2, 1): 2, (9, 1): 1, (9, 2): 1}
    s = [r for r in rows if (r.userId, r.session_id) == (1, 1)][0]
    assert (s.first_page, s.last_page, s.first_source_id, s.duration_seconds) == ("/a", "/b", 10, 1800)
