"""Properties on the sf0.01 tables plus the loader and JSON sink."""

from __future__ import annotations

import datetime as dt
import json
import tempfile

from pyspark.sql import functions as F

from conftest import SF001, T
from visitlake.operators import (
    conversions_by_date,
    conversions_by_datetime,
    flatten_sessions,
    last_touch_attribution,
    log_paths_by_campaign,
    orders_per_user,
    pages_per_user,
    recent_source_conversions,
    sessionize,
)
from visitlake.sources import json_records, load_tables, testdata, write_json
from visitlake.sources.tables import SCHEMAS


def test_order_count_sums_to_matching_orders(spark):
    t = testdata.tables(spark, SF001)
    got = orders_per_user(t.users, t.orders).agg(F.sum("order_count")).first()[0]
    assert got == t.orders.join(t.users, "userId").count()


def test_visits_at_least_distinct_pages(spark):
    t = testdata.tables(spark, SF001)
    rows = pages_per_user(t.users, t.logs).collect()
    assert rows and all(r.visit_count >= r.page_count and len(r.pages_visited) == r.visit_count for r in rows)


def test_session_ids_start_at_one_and_rise_by_at_most_one(spark):
    t = testdata.tables(spark, SF001)
    rows = sessionize(t.logs).select("userId", "timestamp", "session_id").collect()
    by = {}
    for r in rows:
        by.setdefault(r.userId, []).append((r.timestamp, r.session_id))
    for seq in by.values():
        ids = [s for _, s in sorted(seq)]
        assert ids[0] == 1 and all(0 <= b - a <= 1 for a, b in zip(ids, ids[1:]))


def test_flatten_row_count(spark):
    t = testdata.tables(spark, SF001)
    flat = flatten_sessions(log_paths_by_campaign(t.logs, t.campaigns))
    expected = t.logs.where(F.col("userId").isNotNull()).join(
        t.campaigns.select(F.col("uuid").alias("source_id")), "source_id", "left"
    ).count()
    assert flat.count() == expected


def test_one_conversion_per_user(spark):
    t = testdata.tables(spark, SF001, purchase_orders=True)
    conv = recent_source_conversions(t.logs, t.orders, t.sources, "2024-01-05", "2024-01-20")
    assert conv.count() == conv.select("userId").distinct().count()
    total = conversions_by_datetime(t.logs, t.orders, t.sources, "2024-01-05", "2024-01-20").agg(F.sum("conversion_count")).first()[0]
    by_date = conversions_by_date(t.logs, t.orders, t.sources, "2024-01-05", "2024-01-20").agg(F.sum("conversion_count")).first()[0]
    assert total == by_date == conv.count()


def test_last_touch_keeps_every_order(spark):
    t = testdata.tables(spark, SF001, purchase_orders=True)
    att = last_touch_attribution(t.logs, t.orders, t.sources)
    assert att.count() == t.orders.count()
    assert att.where(F.col("touch_timestamp") > F.col("order_timestamp")).count() == 0


def test_load_tables_normalises_types(spark):
    root = tempfile.mkdtemp(prefix="visitlake-load-")
    # string keys, an instant-typed timestamp, no utm_source column, extra columns
    spark.createDataFrame([("7",)], "userId string").write.json(f"{root}/users")
    spark.createDataFrame([("7", "70", "2024-01-01 10:00:00")], "userId string, orderId string, timestamp string") \
        .write.json(f"{root}/orders")
    spark.createDataFrame(
        [(dt.datetime(2024, 1, 1, 10, 0, 0), "3", "7", "g", "/a", "x")],
        "timestamp timestamp, source_id string, userId string, referrer string, landing_url string, other string",
    ).write.parquet(f"{root}/logs")
    spark.createDataFrame([("3", "S")], "source_id string, source_name string").write.json(f"{root}/sources")
    spark.createDataFrame([("3", "t", "d", "/a")], "uuid string, type string, description string, params string") \
        .write.json(f"{root}/campaigns")
    t = load_tables(spark, "json", {n: f"{root}/{n}" for n in SCHEMAS}, formats={"logs": "parquet"})
    logs = t.logs
    assert t.users.schema["userId"].dataType == SCHEMAS["users"]["userId"].dataType
    assert t.orders.first().asDict() == {"userId": 7, "orderId": 70, "timestamp": T("2024-01-01 10:00:00")}
    assert logs.columns == ["timestamp", "source_id", "userId", "referrer", "landing_url"]  # no utm_source
    assert logs.first().timestamp == T("2024-01-01 10:00:00")  # session zone is UTC in tests
    assert t.campaigns.first().uuid == 3


def test_json_records(spark):
    df = spark.createDataFrame(
        [(1, None, T("2024-01-01 01:02:03.456000"), "Google ads")],
        "userId bigint, referrer string, timestamp timestamp_ntz, campaign_name string",
    )
    rec = json.loads(json_records(df).first().json)
    assert rec == {"userId": 1, "timestamp": "2024-01-01T01:02:03.456Z", "Campaign name": "Google ads"}
    rec = json.loads(json_records(df, keep_nulls=True).first().json)
    assert rec["referrer"] is None
    out = tempfile.mkdtemp(prefix="visitlake-json-") + "/o"
    write_json(df, out)
    assert json.loads(spark.read.text(out).first().value)["Campaign name"] == "Google ads"


def test_json_renames_nested_fields(spark):
    df = spark.sql("SELECT 1 AS id, array(named_struct('campaign_name', 'x', 't', 1)) AS full_session")
    assert json.loads(json_records(df).first().json) == {"id": 1, "full_session": [{"Campaign name": "x", "t": 1}]}
