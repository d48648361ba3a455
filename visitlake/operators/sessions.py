"""O6 sessionize, I3 session summary / paths.

Sessionization rule (as in the reference): entries of one user ordered by
time; an entry opens a new session when the gap to the previous entry, in
whole seconds after truncation, is greater than ``gap_seconds`` (1800).
Session ids start at ``base`` (1) and rise by one per break.

Scale: a single ``Window.partitionBy(user)`` puts all entries of a user in one
task, so a user holding a third of the data would stall the job. A bounded
pre-pass (``skew.heavy_keys``) finds users with more than ``hot_rows`` entries;
all other users -- proven small -- get the one-window plan, and the heavy
users get a two-pass scan:

* pass 1 -- window over (user, time bucket): previous entry, local break flags
  and a running break count inside the bucket; bucket sizes are bounded by
  ``bucket_seconds`` of one user's traffic;
* pass 2 -- a per-(user, bucket) summary (first/last time, break count) gets
  windows that carry the last entry of the previous bucket and the number of
  breaks before the bucket, over the hours of one user (bounded by time span,
  not by row count); an hour that is itself heavy is split per second and
  then a second level carries over the seconds of that hour (at most 3600);
* the summary is joined back on (user, bucket); the rows side is already
  clustered on that key, so only the small summary is shuffled.

The result equals ``lag`` + running ``sum`` over ``partitionBy(user)``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlake.fixed import SESSION_GAP_SECONDS as DEFAULT_GAP_SECONDS
from visitlake.operators.pages import DEFAULT_PAGE_SIZE, paged_sorted_list, time_bucket
from visitlake.operators.skew import DEFAULT_MAX_HOT_KEYS, heavy_keys, split_keys, time_buckets

DEFAULT_BUCKET_SECONDS = 3600
# Users with more entries than this are scanned in time buckets (one window
# task per user-hour); lighter users in one window task each.
DEFAULT_HOT_ROWS = 1_000_000


def sessionize(
    logs: DataFrame,
    gap_seconds: int = DEFAULT_GAP_SECONDS,
    user: str = "userId",
    ts: str = "timestamp",
    base: int = 1,
    drop_null_users: bool = True,
    bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
    tie_break: Sequence[str] | None = None,
    hot_rows: int | None = DEFAULT_HOT_ROWS,
    max_hot_keys: int = DEFAULT_MAX_HOT_KEYS,
) -> DataFrame:
    """Add prev_timestamp, time_diff (s, null for a user's first entry), session_break (0/1), session_id.

    Users with at most ``hot_rows`` entries are scanned by one window per
    user; heavier users by the bucketed two-pass scan (``hot_rows=None``: all
    users bucketed). Both give the same rows. Entries of equal time are ordered by
    ``tie_break``, by default all other (orderable) columns of ``logs`` in their order, so the
    answer does not depend on the order of the input.
    """
    df = logs.where(F.col(user).isNotNull()) if drop_null_users else logs
    if tie_break is None:
        tie_break = [f.name for f in df.schema.fields if f.name not in (user, ts) and _orderable(f.dataType)]
    order = [F.col(ts)] + [F.col(f"`{c}`") for c in tie_break]
    x = df.withColumn("_uk", F.struct(F.col(user).alias("u"))).withColumn("_sec", F.unix_timestamp(ts))
    args = (df.columns, ts, order, gap_seconds, base)
    bkt = (bucket_seconds, hot_rows, max_hot_keys)
    if hot_rows is None:
        return _bucketed(x, *args, *bkt)
    heavy = heavy_keys(x, "_uk", hot_rows, max_hot_keys)
    if heavy is None:
        return _bucketed(x, *args, *bkt)
    if not heavy:
        return _single_window(x, *args)
    light, hot = split_keys(x, "_uk", heavy)
    return _single_window(light, *args).unionByName(_bucketed(hot, *args, *bkt))


def _orderable(dtype: T.DataType) -> bool:
    text = dtype.simpleString()
    return "map<" not in text and "variant" not in text


def _finish(rows: DataFrame, cols, prev_ts, time_diff, brk, session_id) -> DataFrame:
    return rows.select(
        *[F.col(f"`{c}`") for c in cols],
        prev_ts.alias("prev_timestamp"),
        time_diff.alias("time_diff"),
        brk.cast("int").alias("session_break"),
        session_id.cast("bigint").alias("session_id"),
    )


def _single_window(x: DataFrame, cols, ts, order, gap_seconds, base) -> DataFrame:
    """One window per user: for users proven to have at most ``hot_rows`` entries."""
    w = Window.partitionBy("_uk").orderBy(*order)
    prev_sec = F.lag("_sec").over(w)
    y = x.withColumn("_prev_ts", F.lag(ts).over(w)).withColumn("_diff", F.col("_sec") - prev_sec)
    y = y.withColumn("_brk", F.when(F.col("_diff") > gap_seconds, 1).otherwise(0))
    sid = F.lit(base) + F.sum("_brk").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return _finish(y, cols, F.col("_prev_ts"), F.col("_diff"), F.col("_brk"), sid)


def _bucketed(x: DataFrame, cols, ts, order, gap_seconds, base, bucket_seconds, hot_rows, max_hot_keys) -> DataFrame:
    """Two-pass scan over (user, time bucket) with a carry across buckets (see module doc).

    A user-hour holding more than ``hot_rows`` entries is split per second
    (``skew.time_buckets``). Carries are then taken in two levels so that no
    window sees more than one key's hours, or one hour's seconds: sub-buckets
    within an hour (partition (user, hour)), then hours (partition user).
    """
    x, split = time_buckets(x, "_uk", "_sec", bucket_seconds, hot_rows, max_hot_keys)
    w = Window.partitionBy("_uk", "_bkt").orderBy(*order)
    x = (
        x.withColumn("_prev_ts", F.lag(ts).over(w))
        .withColumn("_prev_sec", F.lag("_sec").over(w))
        .withColumn(
            "_brk",
            F.when(F.col("_prev_sec").isNotNull() & ((F.col("_sec") - F.col("_prev_sec")) > gap_seconds), 1).otherwise(0),
        )
        .withColumn("_cum", F.sum("_brk").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    sub = x.groupBy("_uk", "_bkt").agg(
        F.min("_sec").alias("_first_sec"),
        F.max("_sec").alias("_last_sec"),
        F.max(ts).alias("_last_ts"),
        F.sum("_brk").alias("_brk_in"),
    ).withColumn("_b", F.col("_bkt.b"))
    summary = _carries_two_level(sub, gap_seconds) if split else _carries_one_level(sub, gap_seconds)
    joined = x.join(summary, ["_uk", "_bkt"])
    first_in_bucket = F.col("_prev_sec").isNull()
    prev_ts = F.coalesce(F.col("_prev_ts"), F.col("_carry_ts"))
    return _finish(
        joined,
        cols,
        prev_ts,
        F.col("_sec") - F.unix_timestamp(prev_ts),
        F.when(first_in_bucket, F.col("_first_brk")).otherwise(F.col("_brk")),
        F.lit(base) + F.col("_offset") + F.col("_first_brk") + F.col("_cum"),
    )


def _carries_one_level(sub: DataFrame, gap_seconds: int) -> DataFrame:
    """Per (user, bucket): last entry before it, break at its first entry, breaks before it."""
    ws = Window.partitionBy("_uk").orderBy("_bkt")
    prev_sec = F.lag("_last_sec").over(ws)
    sub = sub.select(
        "_uk",
        "_bkt",
        "_brk_in",
        F.lag("_last_ts").over(ws).alias("_carry_ts"),
        F.when(prev_sec.isNotNull() & ((F.col("_first_sec") - prev_sec) > gap_seconds), 1).otherwise(0).alias("_first_brk"),
    )
    before = F.sum(F.col("_brk_in") + F.col("_first_brk")).over(ws.rowsBetween(Window.unboundedPreceding, -1))
    return sub.select("_uk", "_bkt", "_carry_ts", "_first_brk", F.coalesce(before, F.lit(0)).alias("_offset"))


def _carries_two_level(sub: DataFrame, gap_seconds: int) -> DataFrame:
    """As ``_carries_one_level`` when buckets are split: sub-buckets within an hour, then hours."""
    wh = Window.partitionBy("_uk", "_b").orderBy("_bkt")
    prev_sec = F.lag("_last_sec").over(wh)
    sub = sub.select(
        "_uk", "_bkt", "_b", "_first_sec", "_last_sec", "_last_ts", "_brk_in",
        F.lag("_last_ts").over(wh).alias("_carry_in"),
        prev_sec.isNull().alias("_first_of_hour"),
        F.when(prev_sec.isNotNull() & ((F.col("_first_sec") - prev_sec) > gap_seconds), 1).otherwise(0).alias("_fbw"),
    )
    sub = sub.withColumn(
        "_off_in",
        F.coalesce(F.sum(F.col("_brk_in") + F.col("_fbw")).over(wh.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    # level 1: hours of one user
    hour = sub.groupBy("_uk", "_b").agg(
        F.min("_first_sec").alias("_h_first_sec"),
        F.max("_last_sec").alias("_h_last_sec"),
        F.max("_last_ts").alias("_h_last_ts"),
        F.sum(F.col("_brk_in") + F.col("_fbw")).alias("_h_brk"),
    )
    ws = Window.partitionBy("_uk").orderBy("_b")
    prev_hour_sec = F.lag("_h_last_sec").over(ws)
    hour = hour.select(
        "_uk", "_b", "_h_brk",
        F.lag("_h_last_ts").over(ws).alias("_h_carry"),
        F.when(prev_hour_sec.isNotNull() & ((F.col("_h_first_sec") - prev_hour_sec) > gap_seconds), 1)
        .otherwise(0)
        .alias("_h_first_brk"),
    )
    hour = hour.withColumn(
        "_h_off",
        F.coalesce(
            F.sum(F.col("_h_brk") + F.col("_h_first_brk")).over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    )
    first = F.col("_first_of_hour")
    return sub.join(hour, ["_uk", "_b"]).select(
        "_uk",
        "_bkt",
        F.when(first, F.col("_h_carry")).otherwise(F.col("_carry_in")).alias("_carry_ts"),
        F.when(first, F.col("_h_first_brk")).otherwise(F.col("_fbw")).alias("_first_brk"),
        (F.col("_h_off") + F.when(first, 0).otherwise(F.col("_h_first_brk") + F.col("_off_in"))).alias("_offset"),
    )


def session_summary(
    logs: DataFrame,
    gap_seconds: int = DEFAULT_GAP_SECONDS,
    user: str = "userId",
    ts: str = "timestamp",
    bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
    **kw,
) -> DataFrame:
    """One row per (user, session): start, end, entries, first/last page, first source.

    Every aggregate here is partial-aggregable (min/max of structs for the
    first/last entry), so a long session never sits in one task.
    """
    s = sessionize(logs, gap_seconds, user, ts, bucket_seconds=bucket_seconds, **kw)
    first = F.min(F.struct(F.col(ts).alias("t"), F.col("landing_url").alias("u"), F.col("source_id").alias("s")))
    last = F.max(F.struct(F.col(ts).alias("t"), F.col("landing_url").alias("u")))
    return s.groupBy(user, "session_id").agg(
        F.min(ts).alias("session_start"),
        F.max(ts).alias("session_end"),
        F.count(F.lit(1)).alias("entries"),
        first.getField("u").alias("first_page"),
        last.getField("u").alias("last_page"),
        first.getField("s").alias("first_source_id"),
    ).select(
        user,
        "session_id",
        "session_start",
        "session_end",
        (F.unix_timestamp("session_end") - F.unix_timestamp("session_start")).alias("duration_seconds"),
        "entries",
        "first_page",
        "last_page",
        "first_source_id",
    )


def session_paths(
    logs: DataFrame,
    gap_seconds: int = DEFAULT_GAP_SECONDS,
    user: str = "userId",
    ts: str = "timestamp",
    bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
    page_size: int = DEFAULT_PAGE_SIZE,
    **kw,
) -> DataFrame:
    """I3 path: per (user, session, page) the time-ordered (timestamp, landing_url) entries."""
    s = sessionize(logs, gap_seconds, user, ts, bucket_seconds=bucket_seconds, **kw)
    item = F.struct(F.col(ts).alias("timestamp"), F.col("landing_url").alias("landing_url"))
    return paged_sorted_list(
        s,
        [user, "session_id"],
        item,
        time_bucket(ts, bucket_seconds),
        "path",
        page_size=page_size,
        total_name="entries",
        fine_bucket=F.unix_timestamp(ts),
    )
