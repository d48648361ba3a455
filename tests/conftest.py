from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

from visitlake.session import ensure_checkpoint_dir  # noqa: E402
from visitlake.sources.tables import SCHEMAS, Tables  # noqa: E402

SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .appName("visitlake-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


def T(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def micro_tables(spark) -> Tables:
    """The golden micro-fixture (times UTC)."""
    logs = [
        (T("2024-01-01 00:00:00"), 10, 1, None, "/a", None),
        (T("2024-01-01 00:30:00"), 10, 1, "g", "/b", None),
        (T("2024-01-01 01:00:01"), 11, 1, "g", "/a", None),
        (T("2024-01-01 23:50:00"), 10, 2, "g", "/a", None),
        (T("2024-01-02 00:10:00"), 99, 2, "g", "/a", None),
        (T("2024-01-01 05:00:00"), 10, None, "g", "/z", None),
        (T("2024-01-01 06:00:00"), 10, 9, "g", "/a", None),
        (T("2024-01-01 08:00:00"), 10, 9, "g", "/a", None),
    ]
    orders = [
        (1, 100, T("2024-01-01 00:40:00")),
        (1, 101, T("2024-01-01 02:00:00")),
        (2, 102, T("2024-01-02 00:05:00")),
        (3, 103, T("2024-01-01 12:00:00")),
        (7, 104, T("2024-01-01 12:00:00")),
    ]
    return Tables(
        users=spark.createDataFrame([(1,), (2,), (3,)], SCHEMAS["users"]),
        orders=spark.createDataFrame(orders, SCHEMAS["orders"]),
        logs=spark.createDataFrame(logs, SCHEMAS["logs"]),
        sources=spark.createDataFrame([(10, "google"), (11, "mail")], SCHEMAS["sources"]),
        campaigns=spark.createDataFrame(
            [(10, "search", "Google ads", None), (99, "x", None, None)], SCHEMAS["campaigns"]
        ),
    )


@pytest.fixture(scope="session")
def micro(spark) -> Tables:
    return micro_tables(spark)
