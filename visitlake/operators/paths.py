"""Log paths: O8 by campaign, O9 by utm, O10 by URL params; O15-O18 flat/filter/rebuild.

A path groups a user's log entries by (userId, source_id, referrer,
landing_url, campaign_name). Entries of one group differ only in their time,
so ``full_session`` is sorted by time and paged (see ``pages``); the outer
``timestamp`` is the group's latest entry, on every page, and ``entries_count`` its size, on page 0
(``path_summary`` gives both alone, one row per path).
"""

from __future__ import annotations

from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlake.fixed import CAMPAIGN_NAME_SEPARATOR, PARENT_PREFIX
from visitlake.functions.columns import UNKNOWN, optional_column
from visitlake.functions.timefn import iso_utc_text, parse_bound
from visitlake.operators.dims import DEFAULT_MAX_BROADCAST_ROWS, join_dimension
from visitlake.operators.pages import DEFAULT_PAGE_SIZE, paged_sorted_list, time_bucket

PATH_KEYS = ("userId", "source_id", "referrer", "landing_url", "campaign_name")
ENTRY_FIELDS = ("timestamp", "source_id", "referrer", "landing_url", "campaign_name", "userId")
PARENT_FIELDS = ("campaign_name", "landing_url", "referrer", "userId")
DEFAULT_PATH_BUCKET_SECONDS = 3600


def _user_logs(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("userId").isNotNull())


def group_paths(
    named: DataFrame,
    page_size: int = DEFAULT_PAGE_SIZE,
    bucket_seconds: int = DEFAULT_PATH_BUCKET_SECONDS,
) -> DataFrame:
    """Group entries carrying ``campaign_name`` into paths (shared by O8, O9, O10)."""
    entry = F.struct(*[F.col(c) for c in ENTRY_FIELDS])
    paged = paged_sorted_list(
        named,
        list(PATH_KEYS),
        entry,
        time_bucket("timestamp", bucket_seconds),
        "full_session",
        page_size=page_size,
        total_name="entries_count",
        last_name="_last",
        fine_bucket=F.unix_timestamp("timestamp"),
    )
    return paged.select(
        *PATH_KEYS, "page", "full_session", "entries_count", F.col("_last.timestamp").alias("timestamp")
    )


def path_summary(named: DataFrame) -> DataFrame:
    """O8-O10 without the entries: one row per path with ``entries_count`` and the last ``timestamp``."""
    return named.groupBy(*PATH_KEYS).agg(F.count(F.lit(1)).alias("entries_count"), F.max("timestamp").alias("timestamp"))


def log_paths_by_campaign(
    logs: DataFrame,
    campaigns: DataFrame,
    page_size: int = DEFAULT_PAGE_SIZE,
    max_broadcast_rows: int | None = DEFAULT_MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Campaign name = description of the campaign whose uuid is the log's source_id, else "Unknown".

    A left join: logs without a campaign keep "Unknown"; a uuid listed twice
    yields the entry twice (as the reference's join does).
    """
    return group_paths(named_by_campaign(logs, campaigns, max_broadcast_rows), page_size)


def named_by_campaign(
    logs: DataFrame, campaigns: DataFrame, max_broadcast_rows: int | None = DEFAULT_MAX_BROADCAST_ROWS
) -> DataFrame:
    """The log entries of known users with their ``campaign_name`` (O8 before grouping)."""
    base = _user_logs(logs).select("timestamp", "source_id", "userId", "referrer", "landing_url")
    dim = campaigns.select(F.col("uuid").alias("source_id"), F.col("description"))
    joined = join_dimension(base, dim, "source_id", "left", max_broadcast_rows)
    return joined.withColumn("campaign_name", F.coalesce(F.col("description"), F.lit(UNKNOWN))).drop("description")


def log_paths_by_utm(logs: DataFrame, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Campaign name = utm_source (or "Unknown" when null or when the column is absent)."""
    return group_paths(named_by_utm(logs), page_size)


def named_by_utm(logs: DataFrame) -> DataFrame:
    """The log entries of known users with their ``campaign_name`` (O9 before grouping)."""
    base = _user_logs(logs)
    return base.select(
        "timestamp", "source_id", "userId", "referrer", "landing_url",
        optional_column(base, "utm_source", UNKNOWN).cast("string").alias("campaign_name"),
    )


def _campaign_urls(campaigns: DataFrame) -> DataFrame:
    """(url, uuid, type, description) of every URL of every campaign's comma list."""
    items = campaigns.select(
        "uuid", "type", "description", F.explode(F.split(F.lower(F.col("params")), ",")).alias("_p")
    ).select(F.trim("_p").alias("url"), "uuid", "type", "description")
    return items.where(F.length("url") > 0)


def campaign_url_map(campaigns: DataFrame) -> DataFrame:
    """Each lower-cased, trimmed URL of a campaign's comma list -> the first (lowest uuid) campaign.

    Empty items never match. Result: (url, uuid, type, description).
    """
    first = _campaign_urls(campaigns).groupBy("url").agg(
        F.min(F.struct("uuid", "type", "description")).alias("_c")
    )
    return first.select("url", "_c.uuid", "_c.type", "_c.description")


def campaign_by_url_params(
    logs: DataFrame,
    campaigns: DataFrame,
    page_size: int = DEFAULT_PAGE_SIZE,
    max_broadcast_rows: int | None = DEFAULT_MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Name the campaign by matching lower(landing_url) against campaign URL lists.

    The list-membership join is rewritten as explode + equi join (no nested
    loop). Name = "type - description" when both exist, else utm_source,
    else "Unknown"; then paths are grouped as in O8.
    """
    return group_paths(named_by_url_params(logs, campaigns, max_broadcast_rows), page_size)


def named_by_url_params(
    logs: DataFrame, campaigns: DataFrame, max_broadcast_rows: int | None = DEFAULT_MAX_BROADCAST_ROWS
) -> DataFrame:
    """The log entries of known users with their ``campaign_name`` (O10 before grouping)."""
    base = _user_logs(logs)
    base = base.select(
        "timestamp", "source_id", "userId", "referrer", "landing_url",
        optional_column(base, "utm_source").cast("string").alias("_utm"),
        F.lower(F.col("landing_url")).alias("url"),
    )
    url_map = campaign_url_map(campaigns).select("url", "type", "description")
    urls = _campaign_urls(campaigns).select("url", "type", "description")
    joined = join_dimension(base, url_map, "url", "left", max_broadcast_rows, probe=urls)
    from_campaign = F.when(
        F.col("type").isNotNull() & F.col("description").isNotNull(),
        F.concat(F.col("type"), F.lit(CAMPAIGN_NAME_SEPARATOR), F.col("description")),
    )
    return joined.withColumn("campaign_name", F.coalesce(from_campaign, F.col("_utm"), F.lit(UNKNOWN))).drop(
        "url", "type", "description", "_utm"
    )


def flatten_sessions(paths: DataFrame) -> DataFrame:
    """One row per ``full_session`` entry; path fields prefixed ``parent_``."""
    parents = [F.col(c).alias(PARENT_PREFIX + c) for c in PARENT_FIELDS]
    exploded = paths.select(*parents, F.explode("full_session").alias("_e"))
    return exploded.select(*[F.col(f"_e.{c}").alias(c) for c in ENTRY_FIELDS], *[PARENT_PREFIX + c for c in PARENT_FIELDS])


def flatten_entries(named: DataFrame) -> DataFrame:
    """O15 straight from the named entries: the rows of ``flatten_sessions(group_paths(named))``.

    Grouping and flattening again give back the same entries, so nothing is
    shuffled and time filters on the result reach the scan.
    """
    return named.select(*ENTRY_FIELDS, *[F.col(c).alias(PARENT_PREFIX + c) for c in PARENT_FIELDS])


def _range(col: Column, lo, hi) -> Column:
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (col >= lo)
    if hi is not None:
        cond = cond & (col <= hi)
    return cond


def filter_time_conditions(
    df: DataFrame,
    conditions: Iterable[Mapping[str, object] | Sequence[object]],
    operator: str = "OR",
    ts: str = "timestamp",
    dedupe: bool = True,
) -> DataFrame:
    """Keep rows whose ``ts`` is within [dateFrom, dateTo] of the conditions (inclusive).

    Conditions combine with OR (default) or AND in one predicate; equal rows
    are then removed, as the reference's concat + drop_duplicates does.
    """
    op = operator.upper()
    if op not in ("OR", "AND"):
        raise ValueError(f"operator must be OR or AND, not {operator!r}")
    preds = []
    for cond in conditions:
        lo, hi = (cond.get("dateFrom"), cond.get("dateTo")) if isinstance(cond, Mapping) else tuple(cond)
        preds.append(_range(F.col(ts), parse_bound(lo), parse_bound(hi)))
    if not preds:
        return df.dropDuplicates() if dedupe else df
    pred = preds[0]
    for p in preds[1:]:
        pred = (pred | p) if op == "OR" else (pred & p)
    out = df.where(pred)
    return out.dropDuplicates() if dedupe else out


def filter_outer_timestamp(flat: DataFrame, start=None, end=None, ts: str = "timestamp") -> DataFrame:
    """Add ``parent_timestamp`` (the UTC entry time) and keep rows within [start, end]."""
    out = flat.withColumn("parent_timestamp", F.col(ts))
    return out.where(_range(F.col("parent_timestamp"), parse_bound(start), parse_bound(end)))


def rebuild_sessions(flat: DataFrame) -> DataFrame:
    """Each flat row back to a record with a one-entry ``full_session`` and ISO ``timestamp`` text."""
    parent_ts = F.col("parent_timestamp") if "parent_timestamp" in flat.columns else F.col("timestamp")
    entry = F.struct("campaign_name", "landing_url", "referrer", "timestamp", "userId")
    return flat.select(
        "campaign_name",
        F.array(entry).alias("full_session"),
        "landing_url",
        "referrer",
        iso_utc_text(parent_ts).alias("timestamp"),
        "userId",
    )
