"""The reference service's five endpoints as DataFrame functions (no web server).

Each takes the ``Tables`` catalog and the endpoint's request parameters and
returns a DataFrame (building some runs bounded probe jobs); ``as_json=True`` gives the endpoint's JSON records
(one ``json`` text column, null fields omitted, ``Campaign name`` spelled as
the service spells it). ``as_of=None`` means the query's current date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlake.functions.timefn import DEFAULT_ZONE
from visitlake.operators import (
    conversions_by_date, filter_time_condition_table, filter_time_conditions, log_paths_by_campaign, named_by_campaign, orders_per_user,
    pages_per_user, rebuild_sessions, visitors_in_range,
)
from visitlake.operators.paths import flatten_entries
from visitlake.sources import Tables, json_records


def _out(df: DataFrame, as_json: bool) -> DataFrame:
    return json_records(df) if as_json else df


def orders(t: Tables, as_json: bool = False) -> DataFrame:
    """GET /orders: orders per user."""
    return _out(orders_per_user(t.users, t.orders), as_json)


def pages_visit(t: Tables, as_json: bool = False) -> DataFrame:
    """GET /pagesvisit: pages per user."""
    return _out(pages_per_user(t.users, t.logs), as_json)


def visitors(t: Tables, date_from=None, date_to=None, as_of=None, as_json: bool = False) -> DataFrame:
    """GET /visitors?dateFrom&dateTo: distinct visitors per (date, source) in the trailing year."""
    as_of = F.current_date() if as_of is None else as_of
    return _out(visitors_in_range(t.logs, t.sources, as_of, date_from, date_to), as_json)


def logs(t: Tables, conditions=None, operator: str = "OR", as_json: bool = False) -> DataFrame:
    """GET /logs: log paths named by campaign; with time ``conditions``, one record per entry within them.

    ``conditions``: a list of {dateFrom, dateTo}, or a DataFrame with these columns for any number of them. The records then have one-entry
    ``full_session`` lists, and the filter reaches the scan.
    """
    if conditions is None:
        return _out(log_paths_by_campaign(t.logs, t.campaigns), as_json)
    flat = flatten_entries(named_by_campaign(t.logs, t.campaigns))
    keep = filter_time_condition_table if isinstance(conditions, DataFrame) else filter_time_conditions
    return _out(rebuild_sessions(keep(flat, conditions, operator)), as_json)


def conversions(t: Tables, date_from=None, date_to=None, zone: str = DEFAULT_ZONE, as_json: bool = False) -> DataFrame:
    """GET /conversions?dateFrom&dateTo: conversions by most recent source per local date."""
    return _out(conversions_by_date(t.logs, t.orders, t.sources, date_from, date_to, zone), as_json)
