"""Single-primitive queries: one Spark primitive each, on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitlake.functions import local_time, seconds_text
from visitlake.operators import campaign_url_map, latest_per_key, log_paths_by_campaign, sessionize
from visitlake.operators.dims import join_dimension
from visitlake.operators.pages import DEFAULT_PAGE_SIZE
from visitlake.operators.paths import PATH_KEYS, filter_time_conditions
from visitlake.operators.ranks import sorted_list_with_repeats
from visitlake.plans.registry import CONDITIONS, ZONE, _t, q_flatten_sessions, q_orders_per_user
from visitlake.sources import preview
from visitlake.streaming import stream_visitors_by_source_date


REPEATS_PAGE = 100  # of agg_collect_repeats_paged


def p_filter_not_null_user(spark, sf_dir):
    return _t(spark, sf_dir).logs.where(F.col("userId").isNotNull()).select("userId", "timestamp", "source_id")


def p_join_inner_dim(spark, sf_dir):
    t = _t(spark, sf_dir)
    return join_dimension(t.logs.select("userId", "timestamp", "source_id"), t.sources, "source_id", "inner")


def p_join_left_dim_unmatched(spark, sf_dir):
    t = _t(spark, sf_dir)
    return join_dimension(t.logs.select("userId", "timestamp", "source_id"), t.sources, "source_id", "left")


def p_agg_count_distinct(spark, sf_dir):
    logs = _t(spark, sf_dir).logs
    return logs.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("entries"), F.count_distinct("userId").alias("users")
    )


def p_agg_collect_sorted(spark, sf_dir):
    pairs = _t(spark, sf_dir).logs.select("source_id", "landing_url").distinct()
    out = sorted_list_with_repeats(pairs, ["source_id"], F.col("landing_url"), "urls", DEFAULT_PAGE_SIZE, "url_count")
    return out.select("source_id", "page", "urls", "url_count")


def p_agg_collect_repeats_paged(spark, sf_dir):
    """Every visited URL of a source, repeats kept, in pages of ``REPEATS_PAGE``: most groups have many pages."""
    logs = _t(spark, sf_dir).logs
    return sorted_list_with_repeats(logs, ["source_id", "referrer"], F.col("landing_url"), "urls", REPEATS_PAGE, "url_count", "distinct_urls")


def p_window_lag_gap(spark, sf_dir):
    s = sessionize(_t(spark, sf_dir).logs.select("userId", "timestamp"))
    return s.select("userId", "timestamp", "prev_timestamp", "time_diff")


def p_window_running_session(spark, sf_dir):
    s = sessionize(_t(spark, sf_dir).logs.select("userId", "timestamp"))
    return s.select("userId", "timestamp", "session_break", "session_id")


def p_top1_per_user(spark, sf_dir):
    orders = _t(spark, sf_dir, purchases=True).orders
    return latest_per_key(orders, ["userId"], ["timestamp", "orderId"], [])


def p_tz_local_date(spark, sf_dir):
    logs = _t(spark, sf_dir).logs
    return logs.select("userId", "timestamp", F.to_date(local_time("timestamp", ZONE)).alias("local_date"))


def p_date_format_second(spark, sf_dir):
    logs = _t(spark, sf_dir).logs
    return logs.select("userId", "timestamp", seconds_text(local_time("timestamp", ZONE)).alias("date_time"))


def p_struct_last_element(spark, sf_dir):
    """The last element of every page's sorted list, and that of the path's whole list on each of its pages."""
    t = _t(spark, sf_dir)
    paths = log_paths_by_campaign(t.logs, t.campaigns)
    last = F.element_at("full_session", -1).getField("timestamp")
    return paths.select(*PATH_KEYS, "page", last.alias("last_entry_ts"), F.col("timestamp").alias("path_last_ts"))


def p_url_list_explode_join(spark, sf_dir):
    t = _t(spark, sf_dir)
    logs = t.logs.select("userId", "timestamp", "landing_url", F.lower("landing_url").alias("url"))
    url_map = campaign_url_map(t.campaigns).select("url", "uuid")
    return join_dimension(logs, url_map, "url", "left").drop("url")


def p_sort_by_date(spark, sf_dir):
    logs = _t(spark, sf_dir).logs
    return logs.groupBy(F.to_date("timestamp").alias("date")).agg(F.count(F.lit(1)).alias("entries")).orderBy("date")


def p_union_dedupe(spark, sf_dir):
    flat = q_flatten_sessions(spark, sf_dir)
    parts = [filter_time_conditions(flat, [c], dedupe=False) for c in CONDITIONS]
    return parts[0].unionByName(parts[1]).dropDuplicates()


def p_preview(spark, sf_dir):
    return preview(q_orders_per_user(spark, sf_dir), 50, ["userId", "page"])


def p_daily_visitors_windowed(spark, sf_dir):
    # the streaming daily-visitors query (chained window aggregations), run as a batch
    t = _t(spark, sf_dir)
    return stream_visitors_by_source_date(t.logs, t.sources)


PRIMITIVES = {
    "filter_not_null_user": p_filter_not_null_user,
    "join_inner_dim": p_join_inner_dim,
    "join_left_dim_unmatched": p_join_left_dim_unmatched,
    "agg_count_distinct": p_agg_count_distinct,
    "agg_collect_sorted": p_agg_collect_sorted,
    "agg_collect_repeats_paged": p_agg_collect_repeats_paged,
    "window_lag_gap": p_window_lag_gap,
    "window_running_session": p_window_running_session,
    "top1_per_user": p_top1_per_user,
    "tz_local_date": p_tz_local_date,
    "date_format_second": p_date_format_second,
    "struct_last_element": p_struct_last_element,
    "url_list_explode_join": p_url_list_explode_join,
    "sort_by_date": p_sort_by_date,
    "union_dedupe": p_union_dedupe,
    "preview": p_preview,
    "daily_visitors_windowed": p_daily_visitors_windowed,
}
