"""DataFrame -> DataFrame operators (see README for the list)."""

from visitlake.operators.conversions import (
    conversion_counts_by_date,
    conversions_by_date,
    conversions_by_datetime,
    last_touch_attribution,
    last_touch_conversions,
    latest_per_key,
    recent_source_conversions,
)
from visitlake.operators.dims import join_dimension, salted_join
from visitlake.operators.intervals import filter_time_condition_table
from visitlake.operators.pages import paged_sorted_list
from visitlake.operators.paths import (
    campaign_by_url_params,
    campaign_url_map,
    filter_outer_timestamp,
    filter_time_conditions,
    flatten_sessions,
    log_paths_by_campaign,
    log_paths_by_utm,
    named_by_campaign,
    named_by_url_params,
    named_by_utm,
    path_summary,
    rebuild_sessions,
)
from visitlake.operators.sessions import sessionize, session_paths, session_summary
from visitlake.operators.users import order_counts_per_user, orders_per_user, page_counts_per_user, pages_per_user
from visitlake.operators.visitors import (
    visitors_by_source_date,
    visitors_in_range,
    visitors_once_per_session,
    visits_by_user_source_date,
)

__all__ = [
    "campaign_by_url_params",
    "campaign_url_map",
    "conversion_counts_by_date",
    "conversions_by_date",
    "conversions_by_datetime",
    "filter_outer_timestamp",
    "filter_time_condition_table",
    "filter_time_conditions",
    "flatten_sessions",
    "join_dimension",
    "last_touch_attribution",
    "last_touch_conversions",
    "latest_per_key",
    "log_paths_by_campaign",
    "log_paths_by_utm",
    "named_by_campaign",
    "named_by_url_params",
    "named_by_utm",
    "order_counts_per_user",
    "orders_per_user",
    "page_counts_per_user",
    "paged_sorted_list",
    "pages_per_user",
    "path_summary",
    "rebuild_sessions",
    "recent_source_conversions",
    "session_paths",
    "session_summary",
    "sessionize",
    "salted_join",
    "visitors_by_source_date",
    "visitors_in_range",
    "visitors_once_per_session",
    "visits_by_user_source_date",
]
