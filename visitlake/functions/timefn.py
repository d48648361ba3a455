"""Time helpers: whole-second clocks, local wall time, trailing year, text forms.

All timestamps inside the engine are UTC wall clock ``timestamp_ntz``; these
helpers never depend on the session time zone.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlake.fixed import REPORT_ZONE as DEFAULT_ZONE
from visitlake.fixed import TRAILING_MONTHS


def whole_seconds(ts: Column | str) -> Column:
    """Epoch seconds after truncation (the gap test compares these)."""
    return F.unix_timestamp(F.col(ts) if isinstance(ts, str) else ts)


def local_time(ts: Column | str, zone: str = DEFAULT_ZONE) -> Column:
    """UTC wall clock -> wall clock in ``zone`` (DST aware), still ``timestamp_ntz``."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), col)


def parse_bound(value) -> Column | None:
    """A range bound as a ``timestamp_ntz`` literal; ``None`` means open.

    Date-only text means midnight at the start of that day.
    """
    if value is None:
        return None
    if isinstance(value, Column):
        return value
    if isinstance(value, _dt.datetime):
        return F.lit(value.replace(tzinfo=None)).cast("timestamp_ntz")
    if isinstance(value, _dt.date):
        return F.lit(value).cast("timestamp_ntz")
    return F.to_timestamp_ntz(F.lit(str(value)))


def _between(col: Column, lo: Column | None, hi: Column | None) -> Column:
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (col >= lo)
    if hi is not None:
        cond = cond & (col <= hi)
    return cond


def local_time_range(
    df: DataFrame,
    ts: str,
    start=None,
    end=None,
    zone: str = DEFAULT_ZONE,
    local_col: str | None = None,
    slack_hours: int = 3,
) -> DataFrame:
    """Keep rows whose local wall time in ``zone`` is within [start, end].

    The exact test is on the local time. A second, wider predicate on the raw
    column (bounds converted to UTC, widened by ``slack_hours`` to cover DST
    overlaps and gaps) lets Parquet skip row groups; it never drops a row the
    exact test keeps.
    """
    lo, hi = parse_bound(start), parse_bound(end)
    local = local_time(ts, zone)
    raw = F.col(ts)
    slack = F.make_dt_interval(F.lit(slack_hours))
    push_lo = None if lo is None else F.convert_timezone(F.lit(zone), F.lit("UTC"), lo) - slack
    push_hi = None if hi is None else F.convert_timezone(F.lit(zone), F.lit("UTC"), hi) + slack
    out = df.where(_between(raw, push_lo, push_hi)).where(_between(local, lo, hi))
    if local_col:
        out = out.withColumn(local_col, local)
    return out


def trailing_year_bounds(as_of) -> tuple[Column, Column]:
    """[as_of - 12 months, as_of] as dates; 29 Feb maps to 28 Feb."""
    end = F.lit(as_of).cast("date") if not isinstance(as_of, Column) else as_of.cast("date")
    return F.add_months(end, -TRAILING_MONTHS), end


def trailing_year(df: DataFrame, ts: str, as_of, date_col: str | None = "date") -> DataFrame:
    """Rows whose UTC date is within the trailing year ending ``as_of`` (inclusive)."""
    lo, hi = trailing_year_bounds(as_of)
    d = F.to_date(F.col(ts))
    out = df.where(d.between(lo, hi))
    return out.withColumn(date_col, d) if date_col else out


def seconds_text(ts: Column | str) -> Column:
    """SECOND_TEXT_FORMAT ('yyyy-MM-dd HH:mm:ss') of a timestamp_ntz, fraction truncated.

    Cut from the zone-free text form; ``date_format`` would pass through the
    session zone.
    """
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.substring(col.cast("string"), 1, 19)


def iso_utc_text(ts: Column | str) -> Column:
    """ISO-8601 text with microseconds and a Z suffix: 2024-01-01T01:02:03.456000Z."""
    col = F.col(ts) if isinstance(ts, str) else ts
    text = col.cast("string")
    secs = F.format_string("%09.6f", F.extract(F.lit("SECOND"), col).cast("double"))
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 6), secs, F.lit("Z"))
