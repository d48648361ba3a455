"""Independent SQL (DuckDB dialect) for every registered query.

Written the plain way -- windows over whole groups, ``ASOF`` joins, lists
built in one piece -- so it checks the distributed forms in the operators.
The base tables are the pre-registered parquet views; the five logical
tables are derived with the same expressions as ``visitlake.sources.testdata``.
"""

from __future__ import annotations

from visitlake.operators.pages import DEFAULT_PAGE_SIZE as PAGE
from visitlake.plans import registry as R
from visitlake.plans.primitives import REPEATS_PAGE

_LOCAL_ZONE = R.ZONE

BASE = """
t_users AS (SELECT CAST(c_custkey AS BIGINT) AS userId FROM customer),
t_orders AS (
  SELECT CAST(o_custkey AS BIGINT) AS userId, CAST(o_orderkey AS BIGINT) AS orderId, o_orderdate AS "timestamp"
  FROM orders),
t_purchases AS (
  SELECT CAST(user_id AS BIGINT) AS userId, CAST(event_id AS BIGINT) AS orderId, ts AS "timestamp"
  FROM events WHERE event_type = 'purchase'),
t_ev AS (
  SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k FROM events WHERE event_type <> 'purchase'),
t_logs AS (
  SELECT ts AS "timestamp",
         CAST(k % 6 AS BIGINT) AS source_id,
         CAST(CASE WHEN event_type = 'signup' AND k % 10 = 0 THEN NULL ELSE user_id END AS BIGINT) AS userId,
         CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS referrer,
         concat('/p/', CAST(k % 20 AS VARCHAR)) AS landing_url,
         CASE WHEN k % 3 = 0 THEN NULL ELSE concat('utm_', CAST(k % 3 AS VARCHAR)) END AS utm_source
  FROM t_ev),
t_sources AS (SELECT CAST(r_regionkey AS BIGINT) AS source_id, r_name AS source_name FROM region),
t_campaigns AS (
  SELECT CAST(n_nationkey + 2 AS BIGINT) AS uuid,
         concat('T', CAST(n_regionkey AS VARCHAR)) AS type,
         CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE n_name END AS description,
         CASE WHEN n_nationkey % 5 = 4 THEN ''
              ELSE concat('/P/', CAST(n_nationkey AS VARCHAR), ', /p/', CAST(n_nationkey + 1 AS VARCHAR)) END AS params
  FROM nation)"""


def _with(*ctes: str) -> str:
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {BASE}{extra}\n"


def _local(col: str) -> str:
    return f"(({col} AT TIME ZONE 'UTC') AT TIME ZONE '{_LOCAL_ZONE}')"


def _sec(col: str) -> str:
    return f"(epoch_us({col}) // 1000000)"


def _page(rn: str = "rn") -> str:
    return f"CAST(floor(({rn} - 1) / {PAGE}) AS INTEGER)"


YEAR = f"CAST(\"timestamp\" AS DATE) BETWEEN CAST(DATE '{R.AS_OF}' - INTERVAL 12 MONTH AS DATE) AND DATE '{R.AS_OF}'"
LOCAL_RANGE = f"BETWEEN TIMESTAMP '{R.RANGE_START}' AND TIMESTAMP '{R.RANGE_END}'"

SESS = """sess AS (
  SELECT *, CAST(1 + sum(session_break) OVER (PARTITION BY userId ORDER BY "timestamp"{ties}
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_id
  FROM (
    SELECT *, CAST({sec_ts} - {sec_prev} AS BIGINT) AS time_diff,
           CAST(CASE WHEN {sec_ts} - {sec_prev} > 1800 THEN 1 ELSE 0 END AS INTEGER) AS session_break
    FROM (SELECT *, lag("timestamp") OVER (PARTITION BY userId ORDER BY "timestamp"{ties}) AS prev_timestamp
          FROM {src})))""".format(sec_ts=_sec('"timestamp"'), sec_prev=_sec("prev_timestamp"), src="{src}", ties="{ties}")


def _sess(src: str, *ties: str) -> str:
    return SESS.replace("{src}", src).replace("{ties}", "".join(f", {c} NULLS FIRST" for c in ties))


PATH_KEYS = "userId, source_id, referrer, landing_url, campaign_name"


def _paths(named_cte: str) -> str:
    return _with(
        named_cte,
        f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {PATH_KEYS} ORDER BY "timestamp") AS rn,
         count(*) OVER (PARTITION BY {PATH_KEYS}) AS total,
         max("timestamp") OVER (PARTITION BY {PATH_KEYS}) AS last_ts
  FROM named)""",
    ) + f"""SELECT {PATH_KEYS}, {_page()} AS page,
  list_sort(list(struct_pack("timestamp" := "timestamp", source_id := source_id, referrer := referrer,
                             landing_url := landing_url, campaign_name := campaign_name, userId := userId))) AS full_session,
  CAST(max(total) FILTER (rn <= {PAGE}) AS BIGINT) AS entries_count, max(last_ts) AS "timestamp"
FROM ranked GROUP BY {PATH_KEYS}, {_page()}"""


PATH_SUMMARY = f"""SELECT {PATH_KEYS}, CAST(count(*) AS BIGINT) AS entries_count, max("timestamp") AS "timestamp"
FROM named GROUP BY {PATH_KEYS}"""

NAMED_CAMPAIGN = """named AS (
  SELECT l."timestamp", l.source_id, l.userId, l.referrer, l.landing_url,
         coalesce(c.description, 'Unknown') AS campaign_name
  FROM t_logs l LEFT JOIN t_campaigns c ON l.source_id = c.uuid
  WHERE l.userId IS NOT NULL)"""

NAMED_UTM = """named AS (
  SELECT "timestamp", source_id, userId, referrer, landing_url, coalesce(utm_source, 'Unknown') AS campaign_name
  FROM t_logs WHERE userId IS NOT NULL)"""

NAMED_PARAMS = """items AS (
  SELECT trim(p) AS url, uuid, type, description
  FROM (SELECT uuid, type, description, unnest(string_split(lower(params), ',')) AS p FROM t_campaigns)),
first_campaign AS (
  SELECT url, type, description FROM (
    SELECT *, row_number() OVER (PARTITION BY url ORDER BY uuid) AS rn FROM items WHERE length(url) > 0)
  WHERE rn = 1),
named AS (
  SELECT l."timestamp", l.source_id, l.userId, l.referrer, l.landing_url,
         coalesce(CASE WHEN f.type IS NOT NULL AND f.description IS NOT NULL
                       THEN concat(f.type, ' - ', f.description) END,
                  l.utm_source, 'Unknown') AS campaign_name
  FROM t_logs l LEFT JOIN first_campaign f ON lower(l.landing_url) = f.url
  WHERE l.userId IS NOT NULL)"""

FLAT = """flat AS (
  SELECT "timestamp", source_id, referrer, landing_url, campaign_name, userId,
         campaign_name AS parent_campaign_name, landing_url AS parent_landing_url,
         referrer AS parent_referrer, userId AS parent_userId
  FROM named)"""

OUTER = f"""outer_rows AS (
  SELECT *, "timestamp" AS parent_timestamp FROM flat
  WHERE "timestamp" BETWEEN TIMESTAMP '{R.OUTER_START}' AND TIMESTAMP '{R.OUTER_END}')"""

CONV = f"""lr AS (
  SELECT userId, source_id, {_local('"timestamp"')} AS local_ts FROM t_logs
  WHERE userId IS NOT NULL AND {_local('"timestamp"')} {LOCAL_RANGE}),
latest AS (
  SELECT userId, source_id, local_ts FROM (
    SELECT *, row_number() OVER (PARTITION BY userId ORDER BY local_ts DESC, source_id DESC) AS rn FROM lr)
  WHERE rn = 1),
po AS (
  SELECT userId, orderId, {_local('"timestamp"')} AS local_ts FROM t_purchases
  WHERE userId IS NOT NULL AND {_local('"timestamp"')} {LOCAL_RANGE}),
chosen AS (
  SELECT userId, orderId FROM (
    SELECT *, row_number() OVER (PARTITION BY userId ORDER BY local_ts DESC, orderId DESC) AS rn FROM po)
  WHERE rn = 1),
conv AS (
  SELECT strftime(l.local_ts, '%Y-%m-%d %H:%M:%S') AS date_time, CAST(l.local_ts AS DATE) AS date_only,
         s.source_name, c.orderId
  FROM latest l JOIN chosen c ON l.userId = c.userId LEFT JOIN t_sources s ON l.source_id = s.source_id)"""

ORDERS_PER_USER_BODY = f"""SELECT userId, page, coalesce(list_sort(list(orderId) FILTER (orderId IS NOT NULL)), []) AS order_ids,
       CAST(max(total) FILTER (rn <= {PAGE}) AS BIGINT) AS order_count
FROM (
  SELECT userId, orderId, total, rn, CASE WHEN total = 0 THEN 0 ELSE {_page()} END AS page
  FROM (
    SELECT o.userId, o.orderId,
           row_number() OVER (PARTITION BY o.userId ORDER BY o.orderId NULLS LAST) AS rn,
           count(o.orderId) OVER (PARTITION BY o.userId) AS total
    FROM t_orders o JOIN t_users u ON o.userId = u.userId)
  WHERE orderId IS NOT NULL OR total = 0)
GROUP BY userId, page"""
ORDERS_PER_USER = _with() + ORDERS_PER_USER_BODY

SQL: dict[str, str] = {
    "orders_per_user": ORDERS_PER_USER,
    "pages_per_user": _with(
        """j AS (SELECT l.userId, l.landing_url FROM t_logs l JOIN t_users u ON l.userId = u.userId)""",
        """d AS (SELECT userId, CAST(count(DISTINCT landing_url) AS BIGINT) AS page_count FROM j GROUP BY userId)""",
    )
    + f"""SELECT p.*, d.page_count FROM (
  SELECT userId, page, coalesce(list_sort(list(landing_url) FILTER (landing_url IS NOT NULL)), []) AS pages_visited,
         CAST(max(total) FILTER (rn <= {PAGE}) AS BIGINT) AS visit_count
  FROM (SELECT userId, landing_url, total, rn, CASE WHEN total = 0 THEN 0 ELSE {_page()} END AS page
        FROM (SELECT userId, landing_url,
                     row_number() OVER (PARTITION BY userId ORDER BY landing_url NULLS LAST) AS rn,
                     count(landing_url) OVER (PARTITION BY userId) AS total
              FROM j)
        WHERE landing_url IS NOT NULL OR total = 0)
  GROUP BY userId, page) p JOIN d ON p.userId = d.userId""",
    "visits_by_user_source_date": _with()
    + f"""SELECT CAST(l."timestamp" AS DATE) AS date, s.source_name, l.userId, CAST(count(*) AS BIGINT) AS visits
FROM t_logs l JOIN t_sources s ON l.source_id = s.source_id
WHERE {YEAR.replace('"timestamp"', 'l."timestamp"')}
GROUP BY 1, 2, 3""",
    "visitors_by_source_date": _with()
    + f"""SELECT CAST(l."timestamp" AS DATE) AS date, s.source_name, CAST(count(DISTINCT l.userId) AS BIGINT) AS visitors
FROM t_logs l JOIN t_sources s ON l.source_id = s.source_id
WHERE {YEAR.replace('"timestamp"', 'l."timestamp"')}
GROUP BY 1, 2""",
    "visitors_in_range": _with()
    + f"""SELECT CAST(l."timestamp" AS DATE) AS date, s.source_name, CAST(count(DISTINCT l.userId) AS BIGINT) AS visitors
FROM t_logs l JOIN t_sources s ON l.source_id = s.source_id
WHERE {YEAR.replace('"timestamp"', 'l."timestamp"')}
  AND CAST(l."timestamp" AS DATE) BETWEEN DATE '{R.DATE_START}' AND DATE '{R.DATE_END}'
GROUP BY 1, 2
ORDER BY 1, 2""",
    "sessionize": _with(_sess('(SELECT userId, "timestamp", source_id FROM t_logs WHERE userId IS NOT NULL)', "source_id"))
    + """SELECT userId, "timestamp", source_id, prev_timestamp, time_diff, session_break, session_id FROM sess""",
    "trailing_year_filter": _with()
    + f"""SELECT userId, "timestamp", source_id, CAST("timestamp" AS DATE) AS date FROM t_logs WHERE {YEAR}""",
    "log_paths_by_campaign": _paths(NAMED_CAMPAIGN),
    "log_paths_by_utm": _paths(NAMED_UTM),
    "campaign_by_url_params": _paths(NAMED_PARAMS),
    "conversions_by_datetime": _with(CONV)
    + """SELECT date_time, source_name, CAST(count(orderId) AS BIGINT) AS conversion_count
FROM conv GROUP BY date_time, source_name""",
    "conversions_by_date": _with(
        CONV,
        """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY date_only, source_name ORDER BY date_time, orderId) AS rn,
         count(*) OVER (PARTITION BY date_only, source_name) AS total
  FROM conv)""",
    )
    + f"""SELECT date_only, source_name, {_page()} AS page,
       list_sort(list(struct_pack(date_time := date_time, source_name := source_name, orderId := orderId))) AS conversions,
       CAST(max(total) FILTER (rn <= {PAGE}) AS BIGINT) AS conversion_count
FROM ranked GROUP BY date_only, source_name, {_page()}""",
    "local_time_range": _with()
    + f"""SELECT userId, "timestamp", source_id, local_ts FROM (
  SELECT userId, "timestamp", source_id, {_local('"timestamp"')} AS local_ts FROM t_logs)
WHERE local_ts {LOCAL_RANGE}""",
    "latest_row_per_key": _with()
    + """SELECT userId, "timestamp", source_id, landing_url FROM (
  SELECT userId, "timestamp", source_id, landing_url,
         row_number() OVER (PARTITION BY userId ORDER BY "timestamp" DESC, source_id DESC, landing_url DESC) AS rn
  FROM t_logs WHERE userId IS NOT NULL)
WHERE rn = 1""",
    "flatten_sessions": _with(NAMED_CAMPAIGN, FLAT) + "SELECT * FROM flat",
    "filter_time_conditions": _with(NAMED_CAMPAIGN, FLAT)
    + """SELECT DISTINCT * FROM flat
WHERE ("timestamp" >= TIMESTAMP '2024-01-05' AND "timestamp" <= TIMESTAMP '2024-01-08')
   OR ("timestamp" >= TIMESTAMP '2024-01-07' AND "timestamp" <= TIMESTAMP '2024-01-10')""",
    "filter_time_conditions_and": _with(NAMED_CAMPAIGN, FLAT)
    + """SELECT DISTINCT * FROM flat
WHERE ("timestamp" >= TIMESTAMP '2024-01-05' AND "timestamp" <= TIMESTAMP '2024-01-08')
  AND ("timestamp" >= TIMESTAMP '2024-01-07' AND "timestamp" <= TIMESTAMP '2024-01-10')""",
    "filter_time_condition_table": _with(NAMED_CAMPAIGN, FLAT)
    + f"""SELECT DISTINCT f.* FROM flat f
WHERE EXISTS (SELECT 1 FROM t_purchases p WHERE f."timestamp" >= p."timestamp" AND f."timestamp" <= p."timestamp" + INTERVAL {R.AFTER_SECONDS} SECOND)""",
    "filter_time_condition_table_and": _with(
        NAMED_CAMPAIGN,
        FLAT,
        """spans AS (SELECT min("timestamp") AS lo, max("timestamp") AS hi FROM t_purchases WHERE userId IS NOT NULL GROUP BY userId
  HAVING min("timestamp") < TIMESTAMP '2024-01-10' AND max("timestamp") > TIMESTAMP '2024-01-20')""",
    )
    + """SELECT DISTINCT * FROM flat
WHERE "timestamp" >= (SELECT max(lo) FROM spans) AND "timestamp" <= (SELECT min(hi) FROM spans)""",
    "load_document_dump": _with()
    + f"""SELECT date_trunc('millisecond', "timestamp") AS "timestamp", source_id, userId, referrer, landing_url, utm_source FROM t_logs
WHERE date_trunc('millisecond', "timestamp") {LOCAL_RANGE}""",
    "load_sampled_schema": _with() + """SELECT "timestamp", source_id, userId, referrer, landing_url, utm_source FROM t_logs""",
    "variant_log_paths_by_utm": _paths(NAMED_UTM),
    "filter_outer_timestamp": _with(NAMED_CAMPAIGN, FLAT, OUTER) + "SELECT * FROM outer_rows",
    "rebuild_sessions": _with(NAMED_CAMPAIGN, FLAT, OUTER)
    + """SELECT campaign_name,
       [struct_pack(campaign_name := campaign_name, landing_url := landing_url, referrer := referrer,
                    "timestamp" := "timestamp", userId := userId)] AS full_session,
       landing_url, referrer, strftime(parent_timestamp, '%Y-%m-%dT%H:%M:%S.%fZ') AS "timestamp", userId
FROM outer_rows""",
    "optional_column": _with()
    + """SELECT userId, "timestamp", coalesce(utm_source, 'Unknown') AS campaign_name FROM t_logs""",
    "optional_column_absent": _with() + """SELECT userId, "timestamp", 'Unknown' AS campaign_name FROM t_logs""",
    "json_records": _with("o1 AS (" + ORDERS_PER_USER_BODY + ")")
    + """SELECT to_json(struct_pack(userId := userId, page := page, order_count := order_count, order_ids := order_ids)) AS json
FROM o1""",
    "load_tables": _with()
    + """SELECT 'users' AS table_name, userId AS key, CAST(NULL AS BIGINT) AS other_key, CAST(NULL AS TIMESTAMP) AS "timestamp",
       CAST(NULL AS VARCHAR) AS text1, CAST(NULL AS VARCHAR) AS text2, CAST(NULL AS VARCHAR) AS text3 FROM t_users
UNION ALL SELECT 'orders', userId, orderId, "timestamp", NULL, NULL, NULL FROM t_orders
UNION ALL SELECT 'logs', userId, source_id, "timestamp", referrer, landing_url, utm_source FROM t_logs
UNION ALL SELECT 'sources', source_id, NULL, NULL, source_name, NULL, NULL FROM t_sources
UNION ALL SELECT 'campaigns', uuid, NULL, NULL, type, description, params FROM t_campaigns""",
    "order_counts_per_user": _with()
    + """SELECT o.userId, CAST(count(o.orderId) AS BIGINT) AS order_count
FROM t_orders o JOIN t_users u ON o.userId = u.userId GROUP BY o.userId""",
    "page_counts_per_user": _with()
    + """SELECT l.userId, CAST(count(l.landing_url) AS BIGINT) AS visit_count, CAST(count(DISTINCT l.landing_url) AS BIGINT) AS page_count
FROM t_logs l JOIN t_users u ON l.userId = u.userId GROUP BY l.userId""",
    "path_summary_by_campaign": _with(NAMED_CAMPAIGN) + PATH_SUMMARY,
    "path_summary_by_utm": _with(NAMED_UTM) + PATH_SUMMARY,
    "path_summary_by_url_params": _with(NAMED_PARAMS) + PATH_SUMMARY,
    "conversion_counts_by_date": _with(CONV)
    + """SELECT date_only, source_name, CAST(count(*) AS BIGINT) AS conversion_count FROM conv GROUP BY date_only, source_name""",
    "json_log_paths": _with(
        NAMED_CAMPAIGN,
        f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {PATH_KEYS} ORDER BY "timestamp") AS rn,
         count(*) OVER (PARTITION BY {PATH_KEYS}) AS total
  FROM named)""",
    )
    + f"""SELECT '{{"userId":' || userId || ',"page":' || {_page()} || coalesce(',"entries_count":' || max(total) FILTER (rn <= {PAGE}), '')
  || ',"Campaign name":' || to_json(campaign_name) || ',"full_session":['
  || string_agg('{{"Campaign name":' || to_json(campaign_name) || coalesce(',"landing_url":' || to_json(landing_url), '') || '}}', ',') || ']}}' AS json
FROM ranked GROUP BY {PATH_KEYS}, {_page()}""",
    "visitors_once_per_session": _with(
        f"""recent AS (
  SELECT userId, "timestamp", source_id FROM t_logs WHERE userId IS NOT NULL AND {YEAR})""",
        _sess("recent"),
    )
    + """SELECT CAST(x."timestamp" AS DATE) AS date, s.source_name,
       CAST(count(DISTINCT (x.userId, x.session_id)) AS BIGINT) AS visitors
FROM sess x JOIN t_sources s ON x.source_id = s.source_id
GROUP BY 1, 2""",
    "last_touch_attribution": _with()
    + """SELECT o.orderId, o.userId, o."timestamp" AS order_timestamp, l."timestamp" AS touch_timestamp,
       l.source_id, s.source_name
FROM t_purchases o
ASOF LEFT JOIN (SELECT * FROM t_logs WHERE userId IS NOT NULL) l
  ON o.userId = l.userId AND o."timestamp" >= l."timestamp"
LEFT JOIN t_sources s ON l.source_id = s.source_id""",
    "last_touch_conversions": _with()
    + f"""SELECT CAST({_local('o."timestamp"')} AS DATE) AS date, s.source_name,
       CAST(count(o.orderId) AS BIGINT) AS conversion_count
FROM (SELECT * FROM t_purchases WHERE {_local('"timestamp"')} {LOCAL_RANGE}) o
ASOF LEFT JOIN (SELECT * FROM t_logs WHERE userId IS NOT NULL) l
  ON o.userId = l.userId AND o."timestamp" >= l."timestamp"
LEFT JOIN t_sources s ON l.source_id = s.source_id
GROUP BY 1, 2""",
    "session_summary": _with(_sess("(SELECT * FROM t_logs WHERE userId IS NOT NULL)"))
    + f"""SELECT userId, session_id, min("timestamp") AS session_start, max("timestamp") AS session_end,
       CAST({_sec('max("timestamp")')} - {_sec('min("timestamp")')} AS BIGINT) AS duration_seconds,
       CAST(count(*) AS BIGINT) AS entries,
       arg_min(landing_url, "timestamp") AS first_page, arg_max(landing_url, "timestamp") AS last_page,
       arg_min(source_id, "timestamp") AS first_source_id
FROM sess GROUP BY userId, session_id""",
    "session_paths": _with(
        _sess("(SELECT * FROM t_logs WHERE userId IS NOT NULL)"),
        """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY userId, session_id ORDER BY "timestamp", landing_url) AS rn,
         count(*) OVER (PARTITION BY userId, session_id) AS total
  FROM sess)""",
    )
    + f"""SELECT userId, session_id, {_page()} AS page,
       list_sort(list(struct_pack("timestamp" := "timestamp", landing_url := landing_url))) AS path,
       CAST(max(total) FILTER (rn <= {PAGE}) AS BIGINT) AS entries
FROM ranked GROUP BY userId, session_id, {_page()}""",
    # fewer users than a sketch's entries: the estimates are exact
    "returning_visitors": _with()
    + f"""SELECT source_name, CAST(count(*) FILTER (after) AS BIGINT) AS visitors,
       CAST(count(*) FILTER (after AND before) AS BIGINT) AS returning, CAST(count(*) FILTER (after AND NOT before) AS BIGINT) AS first_time
FROM (
  SELECT s.source_name, l.userId,
         bool_or(CAST(l."timestamp" AS DATE) BETWEEN DATE '{R.DATE_START}' AND DATE '{R.DATE_END}') AS after,
         bool_or(CAST(l."timestamp" AS DATE) BETWEEN DATE '{R.BEFORE[0]}' AND DATE '{R.BEFORE[1]}') AS before
  FROM t_logs l JOIN t_sources s ON l.source_id = s.source_id
  WHERE l.userId IS NOT NULL
  GROUP BY 1, 2)
GROUP BY 1
HAVING count(*) FILTER (after) > 0""",
}
SQL["daily_visitors_incremental"] = SQL["visitors_in_range"]

FIRST_CAMPAIGN = """items AS (
  SELECT trim(p) AS url, uuid
  FROM (SELECT uuid, unnest(string_split(lower(params), ',')) AS p FROM t_campaigns)),
first_campaign AS (
  SELECT url, uuid FROM (
    SELECT *, row_number() OVER (PARTITION BY url ORDER BY uuid) AS rn FROM items WHERE length(url) > 0)
  WHERE rn = 1)"""

PRIMITIVE_SQL: dict[str, str] = {
    "daily_visitors_windowed": _with()
    + """SELECT CAST(l."timestamp" AS DATE) AS date, s.source_name, CAST(count(DISTINCT l.userId) AS BIGINT) AS visitors
FROM t_logs l JOIN t_sources s ON l.source_id = s.source_id
GROUP BY 1, 2""",
    "preview": _with("o1 AS (" + ORDERS_PER_USER_BODY + ")") + "SELECT * FROM o1 ORDER BY userId, page LIMIT 50",
    "filter_not_null_user": _with()
    + """SELECT userId, "timestamp", source_id FROM t_logs WHERE userId IS NOT NULL""",
    "join_inner_dim": _with()
    + """SELECT l.userId, l."timestamp", l.source_id, s.source_name
FROM t_logs l JOIN t_sources s ON l.source_id = s.source_id""",
    "join_left_dim_unmatched": _with()
    + """SELECT l.userId, l."timestamp", l.source_id, s.source_name
FROM t_logs l LEFT JOIN t_sources s ON l.source_id = s.source_id""",
    "agg_count_distinct": _with()
    + """SELECT source_id, CAST(count(*) AS BIGINT) AS entries, CAST(count(DISTINCT userId) AS BIGINT) AS users
FROM t_logs GROUP BY source_id""",
    "agg_collect_sorted": _with()
    + f"""SELECT source_id, {_page()} AS page, list_sort(list(landing_url)) AS urls, CAST(max(total) FILTER (rn <= {PAGE}) AS BIGINT) AS url_count
FROM (SELECT source_id, landing_url,
             row_number() OVER (PARTITION BY source_id ORDER BY landing_url) AS rn,
             count(*) OVER (PARTITION BY source_id) AS total
      FROM (SELECT DISTINCT source_id, landing_url FROM t_logs WHERE landing_url IS NOT NULL))
GROUP BY source_id, {_page()}""",
    "window_lag_gap": _with(_sess('(SELECT userId, "timestamp" FROM t_logs WHERE userId IS NOT NULL)'))
    + """SELECT userId, "timestamp", prev_timestamp, time_diff FROM sess""",
    "window_running_session": _with(_sess('(SELECT userId, "timestamp" FROM t_logs WHERE userId IS NOT NULL)'))
    + """SELECT userId, "timestamp", session_break, session_id FROM sess""",
    "top1_per_user": _with()
    + """SELECT userId, "timestamp", orderId FROM (
  SELECT *, row_number() OVER (PARTITION BY userId ORDER BY "timestamp" DESC, orderId DESC) AS rn FROM t_purchases)
WHERE rn = 1""",
    "tz_local_date": _with()
    + f"""SELECT userId, "timestamp", CAST({_local('"timestamp"')} AS DATE) AS local_date FROM t_logs""",
    "date_format_second": _with()
    + f"""SELECT userId, "timestamp", strftime({_local('"timestamp"')}, '%Y-%m-%d %H:%M:%S') AS date_time FROM t_logs""",
    "struct_last_element": _with(
        NAMED_CAMPAIGN,
        f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {PATH_KEYS} ORDER BY "timestamp") AS rn FROM named)""",
    )
    + f"""SELECT {PATH_KEYS}, {_page()} AS page, max("timestamp") AS last_entry_ts,
       max(max("timestamp")) OVER (PARTITION BY {PATH_KEYS}) AS path_last_ts
FROM ranked GROUP BY {PATH_KEYS}, {_page()}""",
    "agg_collect_repeats_paged": _with()
    + f"""SELECT source_id, referrer, CAST((rn - 1) // {REPEATS_PAGE} AS INTEGER) AS page, list(landing_url ORDER BY landing_url) AS urls,
       CAST(max(total) FILTER (rn <= {REPEATS_PAGE}) AS BIGINT) AS url_count, CAST(max(d) FILTER (rn <= {REPEATS_PAGE}) AS BIGINT) AS distinct_urls
FROM (SELECT source_id, referrer, landing_url,
             row_number() OVER (PARTITION BY source_id, referrer ORDER BY landing_url) AS rn,
             count(*) OVER (PARTITION BY source_id, referrer) AS total,
             count(DISTINCT landing_url) OVER (PARTITION BY source_id, referrer) AS d
      FROM t_logs WHERE landing_url IS NOT NULL)
GROUP BY 1, 2, 3""",
    "url_list_explode_join": _with(FIRST_CAMPAIGN)
    + """SELECT l.userId, l."timestamp", l.landing_url, f.uuid
FROM t_logs l LEFT JOIN first_campaign f ON lower(l.landing_url) = f.url""",
    "sort_by_date": _with()
    + """SELECT CAST("timestamp" AS DATE) AS date, CAST(count(*) AS BIGINT) AS entries
FROM t_logs GROUP BY 1 ORDER BY 1""",
    "union_dedupe": _with(NAMED_CAMPAIGN, FLAT)
    + """SELECT * FROM flat WHERE "timestamp" >= TIMESTAMP '2024-01-05' AND "timestamp" <= TIMESTAMP '2024-01-08'
UNION
SELECT * FROM flat WHERE "timestamp" >= TIMESTAMP '2024-01-07' AND "timestamp" <= TIMESTAMP '2024-01-10'""",
}
