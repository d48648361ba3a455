"""O11/O12 conversions by most recent source, O14 latest row per key, I2 last-touch attribution."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitlake.functions.timefn import DEFAULT_ZONE, local_time, local_time_range, seconds_text
from visitlake.operators.dims import DEFAULT_MAX_BROADCAST_ROWS, join_dimension
from visitlake.operators.pages import DEFAULT_PAGE_SIZE, paged_sorted_list, time_bucket
from visitlake.operators.sessions import DEFAULT_HOT_ROWS
from visitlake.operators.skew import DEFAULT_MAX_HOT_KEYS, heavy_keys, split_keys, time_buckets


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """One row per key -- the row with the greatest ``order`` tuple.

    ``max(struct(order..., payload...))`` is a partial aggregate, so a key with
    a huge number of rows is reduced map-side instead of ranked in one task.
    Ties on ``order`` are broken by the payload columns, in order.
    """
    fields = list(order) + [c for c in payload if c not in order]
    best = F.max(F.struct(*[F.col(c) for c in fields])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in fields])


def _in_range(df: DataFrame, start, end, zone: str) -> DataFrame:
    return local_time_range(df.where(F.col("userId").isNotNull()), "timestamp", start, end, zone, local_col="local_ts")


def recent_source_conversions(
    logs: DataFrame,
    orders: DataFrame,
    sources: DataFrame,
    start=None,
    end=None,
    zone: str = DEFAULT_ZONE,
    max_broadcast_rows: int | None = DEFAULT_MAX_BROADCAST_ROWS,
) -> DataFrame:
    """One row per converting user: latest in-range log (local time) and one in-range order.

    The reference joins every log of a user to every order and keeps one row;
    the same pick is made linearly: latest log per user (ties: higher
    source_id), latest order per user (ties: higher orderId), then a 1-1 join.
    Users need at least one log and one order in the range.
    """
    latest_log = latest_per_key(_in_range(logs, start, end, zone), ["userId"], ["local_ts"], ["source_id"])
    latest_log = latest_log.withColumnRenamed("local_ts", "log_local_ts")
    chosen = latest_per_key(_in_range(orders, start, end, zone), ["userId"], ["local_ts", "orderId"], [])
    conv = latest_log.join(chosen.select("userId", "orderId"), "userId")
    conv = join_dimension(conv, sources.select("source_id", "source_name"), "source_id", "left", max_broadcast_rows)
    return conv.withColumn("date_time", seconds_text("log_local_ts"))


def conversions_by_datetime(logs, orders, sources, start=None, end=None, zone: str = DEFAULT_ZONE, **kw) -> DataFrame:
    """Conversions per (local log time to the second, source_name); unknown source = null group."""
    conv = recent_source_conversions(logs, orders, sources, start, end, zone, **kw)
    return conv.groupBy("date_time", "source_name").agg(F.count("orderId").alias("conversion_count"))


def conversions_by_date(
    logs,
    orders,
    sources,
    start=None,
    end=None,
    zone: str = DEFAULT_ZONE,
    page_size: int = DEFAULT_PAGE_SIZE,
    bucket_seconds: int = 3600,
    **kw,
) -> DataFrame:
    """Per (local date, source_name) the sorted {date_time, source_name, orderId} list and its size.

    ``source_name`` is kept as a column (the reference drops it, which makes
    rows of one date indistinguishable). The size stands on page 0 only; ``conversion_counts_by_date`` gives it alone.
    """
    conv = recent_source_conversions(logs, orders, sources, start, end, zone, **kw).withColumn(
        "date_only", F.to_date("log_local_ts")
    )
    item = F.struct("date_time", "source_name", "orderId")
    return paged_sorted_list(
        conv,
        ["date_only", "source_name"],
        item,
        time_bucket("log_local_ts", bucket_seconds),
        "conversions",
        page_size=page_size,
        total_name="conversion_count",
        fine_bucket=F.unix_timestamp("log_local_ts"),
    )


def conversion_counts_by_date(logs, orders, sources, start=None, end=None, zone: str = DEFAULT_ZONE, **kw) -> DataFrame:
    """O12 without the lists: one row (date_only, source_name, conversion_count) per day and source."""
    conv = recent_source_conversions(logs, orders, sources, start, end, zone, **kw)
    by_day = conv.groupBy(F.to_date("log_local_ts").alias("date_only"), "source_name")
    return by_day.agg(F.count(F.lit(1)).alias("conversion_count"))


def last_touch_attribution(
    logs: DataFrame,
    orders: DataFrame,
    sources: DataFrame,
    start=None,
    end=None,
    zone: str = DEFAULT_ZONE,
    bucket_seconds: int = 3600,
    max_broadcast_rows: int | None = DEFAULT_MAX_BROADCAST_ROWS,
    hot_rows: int | None = DEFAULT_HOT_ROWS,
    max_hot_keys: int = DEFAULT_MAX_HOT_KEYS,
) -> DataFrame:
    """Every order (in the local range, if given) credited to the user's newest log at or before it.

    An as-of join written as a scan: logs and orders of a user are unioned
    and ordered by (time, logs first); ``last(touch, ignorenulls)`` carries
    the newest log. Users with at most ``hot_rows`` events scan in one window
    each; heavier users (found by a bounded pre-pass) scan per (user, time
    bucket) with a carry of the last log of earlier buckets taken from a
    per-bucket summary, as in sessionize. A log whose source is null still
    wins (the touch is kept as a struct). Orders with no earlier log, or
    without a user, keep a null source.
    """
    o = orders if start is None and end is None else local_time_range(orders, "timestamp", start, end, zone)
    l = logs.where(F.col("userId").isNotNull())
    if end is not None:
        l = local_time_range(l, "timestamp", None, end, zone)
    ev = l.select(
        "userId", "timestamp", F.lit(0).alias("_kind"), "source_id", F.lit(None).cast(o.schema["orderId"].dataType).alias("orderId")
    ).unionByName(
        o.select("userId", "timestamp", F.lit(1).alias("_kind"), F.lit(None).cast(l.schema["source_id"].dataType).alias("source_id"), "orderId")
    )
    touch = F.when(F.col("_kind") == 0, F.struct(F.col("timestamp").alias("t"), F.col("source_id").alias("s")))
    ev = ev.withColumn("_uk", F.struct(F.col("userId").alias("u"))).withColumn("_touch", touch)
    heavy = None if hot_rows is None else heavy_keys(ev, "_uk", hot_rows, max_hot_keys)
    bkt = (bucket_seconds, hot_rows, max_hot_keys)
    if heavy is None:
        placed = _asof_bucketed(ev, *bkt)
    elif not heavy:
        placed = _asof_single_window(ev)
    else:
        light, hot = split_keys(ev, "_uk", heavy)
        placed = _asof_single_window(light).unionByName(_asof_bucketed(hot, *bkt))
    out = placed.select(
        "orderId",
        "userId",
        F.col("timestamp").alias("order_timestamp"),
        F.col("_credit.t").alias("touch_timestamp"),
        F.col("_credit.s").alias("source_id"),
    )
    return join_dimension(out, sources.select("source_id", "source_name"), "source_id", "left", max_broadcast_rows)


_ASOF_ORDER = ("timestamp", "_kind", "source_id")


def _asof_single_window(ev: DataFrame) -> DataFrame:
    w = Window.partitionBy("_uk").orderBy(*_ASOF_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    credit = F.last("_touch", ignorenulls=True).over(w)
    return ev.withColumn("_credit", credit).where(F.col("_kind") == 1).select(
        "orderId", "userId", "timestamp", "_credit"
    )


def _asof_bucketed(ev: DataFrame, bucket_seconds: int, hot_rows, max_hot_keys) -> DataFrame:
    """Per (user, time bucket) scan; the newest earlier log is carried in two levels:
    sub-buckets within an hour (at most 3600), then the user's hours."""
    ev, split = time_buckets(
        ev.withColumn("_sec", F.unix_timestamp("timestamp")), "_uk", "_sec", bucket_seconds, hot_rows, max_hot_keys
    )
    w = Window.partitionBy("_uk", "_bkt").orderBy(*_ASOF_ORDER)
    ev = ev.withColumn(
        "_local", F.last("_touch", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    sub = ev.groupBy("_uk", "_bkt").agg(F.max("_touch").alias("_bucket_last")).withColumn("_b", F.col("_bkt.b"))
    if split:
        summary = _touch_carries_two_level(sub)
    else:
        ws = Window.partitionBy("_uk").orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
        summary = sub.select("_uk", "_bkt", F.last("_bucket_last", ignorenulls=True).over(ws).alias("_carry"))
    placed = ev.where(F.col("_kind") == 1).join(summary, ["_uk", "_bkt"])
    return placed.select(
        "orderId", "userId", "timestamp", F.coalesce(F.col("_local"), F.col("_carry")).alias("_credit")
    )


def _touch_carries_two_level(sub: DataFrame) -> DataFrame:
    wh = Window.partitionBy("_uk", "_b").orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    sub = sub.withColumn("_carry_in", F.last("_bucket_last", ignorenulls=True).over(wh))
    hour = sub.groupBy("_uk", "_b").agg(F.max("_bucket_last").alias("_hour_last"))
    ws = Window.partitionBy("_uk").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hour = hour.select("_uk", "_b", F.last("_hour_last", ignorenulls=True).over(ws).alias("_h_carry"))
    return sub.join(hour, ["_uk", "_b"]).select(
        "_uk", "_bkt", F.coalesce(F.col("_carry_in"), F.col("_h_carry")).alias("_carry")
    )


def last_touch_conversions(logs, orders, sources, start=None, end=None, zone: str = DEFAULT_ZONE, **kw) -> DataFrame:
    """I2 report: attributed orders per (local order date, source_name)."""
    att = last_touch_attribution(logs, orders, sources, start, end, zone, **kw)
    return att.groupBy(F.to_date(local_time("order_timestamp", zone)).alias("date"), "source_name").agg(
        F.count("orderId").alias("conversion_count")
    )
