"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame; building some runs bounded probe jobs.

They run the operators over the tables derived from the shared test parquet
(``visitlake.sources.testdata``), whole tables, with fixed parameters that
match ``visitlake.plans.oracle``.
"""

from __future__ import annotations

from typing import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlake.fixed import REPORT_ZONE, UNKNOWN_CAMPAIGN
from visitlake.operators.daily import append_logs, daily_results, read_daily, refresh_daily, returning_visitors, stored_visitors_in_range
from visitlake.operators.paths import flatten_entries
from visitlake.operators.ranks import stored
from visitlake.functions import local_time_range, optional_column, trailing_year
from visitlake.operators import (
    campaign_by_url_params,
    conversion_counts_by_date,
    conversions_by_date,
    conversions_by_datetime,
    filter_outer_timestamp,
    filter_time_condition_table,
    filter_time_conditions,
    last_touch_attribution,
    last_touch_conversions,
    latest_per_key,
    log_paths_by_campaign,
    log_paths_by_utm,
    named_by_campaign,
    named_by_url_params,
    named_by_utm,
    order_counts_per_user,
    orders_per_user,
    page_counts_per_user,
    pages_per_user,
    path_summary,
    rebuild_sessions,
    session_paths,
    session_summary,
    sessionize,
    visitors_by_source_date,
    visitors_in_range,
    visitors_once_per_session,
    visits_by_user_source_date,
)
from visitlake.session import ensure_checkpoint_dir
from visitlake.sources import document_columns, documents, json_records, load_sampled, load_tables, testdata
from visitlake.sources.dumps import read_dump, write_dump, write_dump_index
from visitlake.sources.tables import SCHEMAS, normalise

# Fixed parameters of the registered queries (the oracle SQL uses the same).
AS_OF = "2024-02-01"
ZONE = REPORT_ZONE
RANGE_START = "2024-01-05 00:00:00"
RANGE_END = "2024-01-20 00:00:00"
DATE_START = "2024-01-05"
DATE_END = "2024-01-20"
CONDITIONS = [{"dateFrom": "2024-01-05", "dateTo": "2024-01-08"}, {"dateFrom": "2024-01-07", "dateTo": "2024-01-10"}]
AFTER_SECONDS = 20  # of the conditions after purchases
OUTER_START = "2024-01-05"
OUTER_END = "2024-01-08"

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark, sf_dir, purchases=False, utm=True):
    return testdata.tables(spark, sf_dir, purchase_orders=purchases, with_utm=utm)


def q_orders_per_user(spark, sf_dir):
    t = _t(spark, sf_dir)
    return orders_per_user(t.users, t.orders)


def q_pages_per_user(spark, sf_dir):
    t = _t(spark, sf_dir)
    return pages_per_user(t.users, t.logs)


def q_visits_by_user_source_date(spark, sf_dir):
    t = _t(spark, sf_dir)
    return visits_by_user_source_date(t.logs, t.sources, AS_OF)


def q_visitors_by_source_date(spark, sf_dir):
    t = _t(spark, sf_dir)
    return visitors_by_source_date(t.logs, t.sources, AS_OF)


def q_visitors_in_range(spark, sf_dir):
    t = _t(spark, sf_dir)
    return visitors_in_range(t.logs, t.sources, AS_OF, DATE_START, DATE_END)


def q_sessionize(spark, sf_dir):
    t = _t(spark, sf_dir)
    s = sessionize(t.logs.select("userId", "timestamp", "source_id"))
    return s.select("userId", "timestamp", "source_id", "prev_timestamp", "time_diff", "session_break", "session_id")


def q_trailing_year_filter(spark, sf_dir):
    t = _t(spark, sf_dir)
    return trailing_year(t.logs.select("userId", "timestamp", "source_id"), "timestamp", AS_OF)


def q_log_paths_by_campaign(spark, sf_dir):
    t = _t(spark, sf_dir)
    return log_paths_by_campaign(t.logs, t.campaigns)


def q_log_paths_by_utm(spark, sf_dir):
    t = _t(spark, sf_dir)
    return log_paths_by_utm(t.logs)


def q_campaign_by_url_params(spark, sf_dir):
    t = _t(spark, sf_dir)
    return campaign_by_url_params(t.logs, t.campaigns)


def q_conversions_by_datetime(spark, sf_dir):
    t = _t(spark, sf_dir, purchases=True)
    return conversions_by_datetime(t.logs, t.orders, t.sources, RANGE_START, RANGE_END, ZONE)


def q_conversions_by_date(spark, sf_dir):
    t = _t(spark, sf_dir, purchases=True)
    return conversions_by_date(t.logs, t.orders, t.sources, RANGE_START, RANGE_END, ZONE)


def q_local_time_range(spark, sf_dir):
    t = _t(spark, sf_dir)
    logs = t.logs.select("userId", "timestamp", "source_id")
    return local_time_range(logs, "timestamp", RANGE_START, RANGE_END, ZONE, local_col="local_ts")


def q_latest_row_per_key(spark, sf_dir):
    t = _t(spark, sf_dir)
    logs = t.logs.where(F.col("userId").isNotNull())
    return latest_per_key(logs, ["userId"], ["timestamp"], ["source_id", "landing_url"])


def q_flatten_sessions(spark, sf_dir):
    t = _t(spark, sf_dir)
    return flatten_entries(named_by_campaign(t.logs, t.campaigns))


def q_filter_time_conditions(spark, sf_dir):
    return filter_time_conditions(q_flatten_sessions(spark, sf_dir), CONDITIONS, "OR")


def q_filter_time_conditions_and(spark, sf_dir):
    return filter_time_conditions(q_flatten_sessions(spark, sf_dir), CONDITIONS, "AND")


def q_filter_outer_timestamp(spark, sf_dir):
    return filter_outer_timestamp(q_flatten_sessions(spark, sf_dir), OUTER_START, OUTER_END)


def q_rebuild_sessions(spark, sf_dir):
    return rebuild_sessions(q_filter_outer_timestamp(spark, sf_dir))


def q_optional_column(spark, sf_dir):
    t = _t(spark, sf_dir)
    return t.logs.select("userId", "timestamp", optional_column(t.logs, "utm_source", UNKNOWN_CAMPAIGN).alias("campaign_name"))


def q_optional_column_absent(spark, sf_dir):
    t = _t(spark, sf_dir, utm=False)
    return t.logs.select("userId", "timestamp", optional_column(t.logs, "utm_source", UNKNOWN_CAMPAIGN).alias("campaign_name"))


def q_json_records(spark, sf_dir):
    # page is kept: a user with more than one page of orders has one record per page
    return json_records(q_orders_per_user(spark, sf_dir).select("userId", "page", "order_count", "order_ids"))


def q_load_tables(spark, sf_dir):
    """All five tables written as a foreign source (text keys, times with an offset; JSON and Parquet), loaded back."""
    t = _t(spark, sf_dir)
    root = f"{ensure_checkpoint_dir(spark)}/load-{uuid4().hex}"
    for name in SCHEMAS:
        frame = getattr(t, name)
        foreign = frame.select(*[
            F.concat(F.col(f.name).cast("string"), F.lit("Z" if f.name == "timestamp" else "")).alias(f.name) for f in frame.schema.fields
        ])
        foreign.write.format("json" if name in ("logs", "campaigns") else "parquet").save(f"{root}/{name}")
    formats = {name: "parquet" for name in ("users", "orders", "sources")}
    got = load_tables(spark, "json", {name: f"{root}/{name}" for name in SCHEMAS}, formats=formats)
    none, text, time = F.lit(None).cast("bigint"), F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz")

    def part(name: str, key, other, at, *texts) -> DataFrame:
        texts = [*texts, *[text] * (3 - len(texts))]
        named = [t.alias(f"text{i}") for i, t in enumerate(texts, 1)]
        return getattr(got, name).select(F.lit(name).alias("table_name"), key.alias("key"), other.alias("other_key"), at.alias("timestamp"), *named)

    c = F.col
    return (
        part("users", c("userId"), none, time)
        .unionByName(part("orders", c("userId"), c("orderId"), c("timestamp")))
        .unionByName(part("logs", c("userId"), c("source_id"), c("timestamp"), c("referrer"), c("landing_url"), c("utm_source")))
        .unionByName(part("sources", c("source_id"), none, time, c("source_name")))
        .unionByName(part("campaigns", c("uuid"), none, time, c("type"), c("description"), c("params")))
    )


def q_filter_time_condition_table(spark, sf_dir):
    """O16 with a condition for every purchase: the entries from a purchase on until ``AFTER_SECONDS`` later."""
    bought = _t(spark, sf_dir, purchases=True).orders.select(F.col("timestamp").alias("dateFrom"))
    until = F.col("dateFrom") + F.make_dt_interval(secs=F.lit(AFTER_SECONDS))
    return filter_time_condition_table(q_flatten_sessions(spark, sf_dir), bought.withColumn("dateTo", until))


def q_filter_time_condition_table_and(spark, sf_dir):
    """O16, AND: the entries between the newest first purchase and the oldest last purchase of any user."""
    orders = _t(spark, sf_dir, purchases=True).orders.where(F.col("userId").isNotNull())
    spans = orders.groupBy("userId").agg(F.min("timestamp").alias("dateFrom"), F.max("timestamp").alias("dateTo")).where("dateFrom < timestamp_ntz '2024-01-10' and dateTo > timestamp_ntz '2024-01-20'")
    return filter_time_condition_table(q_flatten_sessions(spark, sf_dir), spans, "AND")


def _log_documents(spark, sf_dir) -> str:
    """The logs as a document store would hold them: JSON lines in which null fields are absent, every fifth source is text, and
    some lines are cut off."""
    logs = _t(spark, sf_dir).logs
    fields = [F.col(f.name).cast("string").alias(f.name) if f.name == "timestamp" else F.col(f.name) for f in logs.schema.fields]
    plain = F.to_json(F.struct(*fields))
    text = F.to_json(F.struct(*[F.col("source_id").cast("string").alias("source_id") if f.name == "source_id" else x for f, x in zip(logs.schema.fields, fields, strict=True)]))
    lines = logs.select(F.when(F.second("timestamp") % 5 == 0, text).otherwise(plain).alias("value"), F.second("timestamp").alias("s"))
    broken = lines.where("s = 7").select(F.substring("value", 1, 30).alias("value"))
    path = f"{ensure_checkpoint_dir(spark)}/documents-{uuid4().hex}"
    lines.select("value").unionByName(broken).write.text(path)
    return path


def q_load_sampled_schema(spark, sf_dir):
    """The log documents with a schema sampled from them; sources of mixed types are text, broken lines are left out."""
    got = load_sampled(spark, _log_documents(spark, sf_dir), corrupt="drop")
    return normalise(got, SCHEMAS["logs"])


def q_variant_log_paths_by_utm(spark, sf_dir):
    """O9 over documents kept as one VARIANT column in (shredded) Parquet; rows without ``utm_source`` have no such field."""
    path = f"{ensure_checkpoint_dir(spark)}/variants-{uuid4().hex}"
    documents(spark, _log_documents(spark, sf_dir), "drop").select("doc").write.parquet(path)
    types = {f.name: "string" if f.name == "timestamp" else f.dataType.simpleString() for f in SCHEMAS["logs"].fields}
    return log_paths_by_utm(normalise(document_columns(spark.read.parquet(path), types), SCHEMAS["logs"]))


def q_load_document_dump(spark, sf_dir):
    """The logs of a time range, from a collection dump that is indexed by time: files are split, blocks outside the range are not read."""
    path = f"{ensure_checkpoint_dir(spark)}/dump-{uuid4().hex}"
    write_dump(_t(spark, sf_dir).logs, path)
    write_dump_index(spark, path, on=["timestamp"], every=1 << 16)
    logs = read_dump(spark, path, SCHEMAS["logs"], split_bytes=1 << 18)
    return logs.where(F.col("timestamp").between(F.lit(RANGE_START).cast("timestamp_ntz"), F.lit(RANGE_END).cast("timestamp_ntz")))


LATE = "second(timestamp) = 7 and timestamp < timestamp_ntz '2024-01-12'"
BEFORE = ("2024-01-01", "2024-01-04")


def q_daily_visitors_incremental(spark, sf_dir):
    """O5 from a store of daily results: all logs but the late ones, a refresh, the late ones, and a refresh of their dates."""
    t = _t(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark)}/daily-{uuid4().hex}"
    late = F.coalesce(F.expr(LATE), F.lit(False))
    append_logs(t.logs.where(~late), path, "first")
    refresh_daily(spark, path, t.sources)
    append_logs(t.logs.where(late), path, "late")
    refresh_daily(spark, path, t.sources)
    return stored_visitors_in_range(read_daily(spark, path), AS_OF, DATE_START, DATE_END)


def q_returning_visitors(spark, sf_dir):
    """Per source the visitors of the report's range, and how many of them came in the days before, from stored daily sketches."""
    t = _t(spark, sf_dir)
    visits = t.logs.select(F.to_date("timestamp").alias("date"), "source_id", "userId").where(F.col("date").isNotNull())
    daily = stored(daily_results(visits, t.sources), "sketches")
    return returning_visitors(daily, BEFORE, (DATE_START, DATE_END))


def q_order_counts_per_user(spark, sf_dir):
    t = _t(spark, sf_dir)
    return order_counts_per_user(t.users, t.orders)


def q_page_counts_per_user(spark, sf_dir):
    t = _t(spark, sf_dir)
    return page_counts_per_user(t.users, t.logs)


def q_path_summary_by_campaign(spark, sf_dir):
    t = _t(spark, sf_dir)
    return path_summary(named_by_campaign(t.logs, t.campaigns))


def q_path_summary_by_utm(spark, sf_dir):
    return path_summary(named_by_utm(_t(spark, sf_dir).logs))


def q_path_summary_by_url_params(spark, sf_dir):
    t = _t(spark, sf_dir)
    return path_summary(named_by_url_params(t.logs, t.campaigns))


def q_conversion_counts_by_date(spark, sf_dir):
    t = _t(spark, sf_dir, purchases=True)
    return conversion_counts_by_date(t.logs, t.orders, t.sources, RANGE_START, RANGE_END, ZONE)


def q_json_log_paths(spark, sf_dir):
    """Log paths as JSON text, ``Campaign name`` spelled as the service does at both levels."""
    return json_records(q_log_paths_by_campaign(spark, sf_dir).select(
        "userId", "page", "entries_count", "campaign_name",
        F.transform("full_session", lambda e: F.struct(e["campaign_name"].alias("campaign_name"), e["landing_url"].alias("landing_url"))).alias("full_session"),
    ))


def q_visitors_once_per_session(spark, sf_dir):
    t = _t(spark, sf_dir)
    return visitors_once_per_session(t.logs, t.sources, AS_OF)


def q_last_touch_attribution(spark, sf_dir):
    t = _t(spark, sf_dir, purchases=True)
    return last_touch_attribution(t.logs, t.orders, t.sources)


def q_last_touch_conversions(spark, sf_dir):
    t = _t(spark, sf_dir, purchases=True)
    return last_touch_conversions(t.logs, t.orders, t.sources, RANGE_START, RANGE_END, ZONE)


def q_session_summary(spark, sf_dir):
    t = _t(spark, sf_dir)
    return session_summary(t.logs)


def q_session_paths(spark, sf_dir):
    t = _t(spark, sf_dir)
    return session_paths(t.logs)


QUERIES: dict[str, Query] = {
    "orders_per_user": q_orders_per_user,                      # O1
    "pages_per_user": q_pages_per_user,                        # O2
    "visits_by_user_source_date": q_visits_by_user_source_date,  # O3
    "visitors_by_source_date": q_visitors_by_source_date,      # O4
    "visitors_in_range": q_visitors_in_range,                  # O5
    "sessionize": q_sessionize,                                # O6
    "trailing_year_filter": q_trailing_year_filter,            # O7
    "log_paths_by_campaign": q_log_paths_by_campaign,          # O8
    "log_paths_by_utm": q_log_paths_by_utm,                    # O9
    "campaign_by_url_params": q_campaign_by_url_params,        # O10
    "conversions_by_datetime": q_conversions_by_datetime,      # O11
    "conversions_by_date": q_conversions_by_date,              # O12
    "local_time_range": q_local_time_range,                    # O13
    "latest_row_per_key": q_latest_row_per_key,                # O14
    "flatten_sessions": q_flatten_sessions,                    # O15
    "filter_time_conditions": q_filter_time_conditions,        # O16 (OR)
    "filter_time_conditions_and": q_filter_time_conditions_and,  # O16 (AND)
    "filter_outer_timestamp": q_filter_outer_timestamp,        # O17
    "rebuild_sessions": q_rebuild_sessions,                    # O18
    "optional_column": q_optional_column,                      # O19 (present)
    "optional_column_absent": q_optional_column_absent,        # O19 (absent)
    "json_records": q_json_records,                            # O20
    "load_tables": q_load_tables,                              # O21
    "visitors_once_per_session": q_visitors_once_per_session,  # I1
    "last_touch_attribution": q_last_touch_attribution,        # I2 (per order)
    "last_touch_conversions": q_last_touch_conversions,        # I2 (report)
    "session_summary": q_session_summary,                      # I3
    "session_paths": q_session_paths,                          # I3 (paths)
    "filter_time_condition_table": q_filter_time_condition_table,  # O16 (any number of conditions, OR)
    "filter_time_condition_table_and": q_filter_time_condition_table_and,  # O16 (any number of conditions, AND)
    "daily_visitors_incremental": q_daily_visitors_incremental,  # O4, O5 (daily results that follow late logs)
    "returning_visitors": q_returning_visitors,                # O4 over ranges (sketches)
    "load_document_dump": q_load_document_dump,                # O21 (collection dump)
    "load_sampled_schema": q_load_sampled_schema,              # O21 (sampled schema)
    "variant_log_paths_by_utm": q_variant_log_paths_by_utm,    # O9, O19 (fields that vary by document)
    "order_counts_per_user": q_order_counts_per_user,          # O1 (summary)
    "page_counts_per_user": q_page_counts_per_user,            # O2 (summary)
    "path_summary_by_campaign": q_path_summary_by_campaign,    # O8 (summary)
    "path_summary_by_utm": q_path_summary_by_utm,              # O9 (summary)
    "path_summary_by_url_params": q_path_summary_by_url_params,  # O10 (summary)
    "conversion_counts_by_date": q_conversion_counts_by_date,  # O12 (summary)
    "json_log_paths": q_json_log_paths,                        # O20 (nested)
}
