"""Column-level helpers (built-in Spark expressions only, no UDFs)."""

from visitlake.functions.columns import optional_column, with_campaign_default
from visitlake.functions.timefn import (
    local_time,
    local_time_range,
    parse_bound,
    seconds_text,
    iso_utc_text,
    trailing_year,
    trailing_year_bounds,
    whole_seconds,
)

__all__ = [
    "optional_column",
    "with_campaign_default",
    "local_time",
    "local_time_range",
    "parse_bound",
    "seconds_text",
    "iso_utc_text",
    "trailing_year",
    "trailing_year_bounds",
    "whole_seconds",
]
