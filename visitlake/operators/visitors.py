"""O3 visits per (date, source, user), O4 visitors per (date, source), O5 range, I1 per session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlake.functions.timefn import trailing_year
from visitlake.operators.dims import DEFAULT_MAX_BROADCAST_ROWS, join_dimension
from visitlake.operators.sessions import DEFAULT_BUCKET_SECONDS, DEFAULT_GAP_SECONDS, sessionize


def _dim(sources: DataFrame) -> DataFrame:
    return sources.select("source_id", "source_name")


def dated_visits(logs: DataFrame, sources: DataFrame, as_of, max_broadcast_rows=DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Trailing-year logs (UTC date) joined to their source; unknown sources drop out."""
    recent = trailing_year(logs.select("timestamp", "source_id", "userId"), "timestamp", as_of)
    return join_dimension(recent, _dim(sources), "source_id", "inner", max_broadcast_rows)


def visits_by_user_source_date(logs: DataFrame, sources: DataFrame, as_of, **kw) -> DataFrame:
    """O3: number of log rows per (date, source_name, userId); a null user is its own group."""
    return dated_visits(logs, sources, as_of, **kw).groupBy("date", "source_name", "userId").agg(
        F.count(F.lit(1)).alias("visits")
    )


def visitors_by_source_date(logs: DataFrame, sources: DataFrame, as_of, **kw) -> DataFrame:
    """Distinct users per (date, source_name) over the trailing year ending ``as_of``."""
    return dated_visits(logs, sources, as_of, **kw).groupBy("date", "source_name").agg(
        F.count_distinct("userId").alias("visitors")
    )


def visitors_in_range(logs: DataFrame, sources: DataFrame, as_of, start=None, end=None, **kw) -> DataFrame:
    """O4 limited to dates in [start, end] (None = open), ascending by date then source.

    The date filter sits below the aggregate (date is a grouping key) and
    reaches the Parquet scan as a timestamp range.
    """
    v = dated_visits(logs, sources, as_of, **kw)
    if start is not None:
        v = v.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        v = v.where(F.col("date") <= F.lit(end).cast("date"))
    return (
        v.groupBy("date", "source_name")
        .agg(F.count_distinct("userId").alias("visitors"))
        .orderBy("date", "source_name")
    )


def visitors_once_per_session(
    logs: DataFrame,
    sources: DataFrame,
    as_of,
    gap_seconds: int = DEFAULT_GAP_SECONDS,
    bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
    max_broadcast_rows=DEFAULT_MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Per (date, source_name) the number of distinct (user, session) pairs.

    Sessions are cut on all of a user's logs (a log with an unknown source
    still bridges a gap); the source join comes after. The trailing-year cut
    is a contiguous time range, so applying it first keeps the same session
    grouping and lets the scan skip old data.
    """
    recent = trailing_year(logs.select("timestamp", "source_id", "userId"), "timestamp", as_of)
    s = sessionize(recent, gap_seconds, bucket_seconds=bucket_seconds)
    j = join_dimension(s, _dim(sources), "source_id", "inner", max_broadcast_rows)
    return j.groupBy("date", "source_name").agg(F.count_distinct("userId", "session_id").alias("visitors"))
