"""O1 orders per user, O2 pages per user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlake.operators.dims import DEFAULT_MAX_BROADCAST_ROWS, join_dimension
from visitlake.operators.pages import DEFAULT_PAGE_SIZE, paged_sorted_list, prefix_bucket
from visitlake.operators.ranks import sorted_list_with_repeats
from visitlake.operators.skew import DEFAULT_MAX_HOT_KEYS, heavy_keys, split_keys

# Order ids are bucketed in ranges of this width for paging (ids are unique,
# so a bucket -- one task's share of a user -- holds at most this many orders).
ORDER_ID_BUCKET = 1 << 20


def _with_known_users(fact: DataFrame, users: DataFrame, max_rows: int | None) -> DataFrame:
    """fact ⨝ users on userId (inner; a repeated user repeats the fact rows)."""
    return join_dimension(fact, users.select("userId"), "userId", "inner", max_rows)


def orders_per_user(
    users: DataFrame,
    orders: DataFrame,
    page_size: int = DEFAULT_PAGE_SIZE,
    max_broadcast_rows: int | None = DEFAULT_MAX_BROADCAST_ROWS,
) -> DataFrame:
    """O1: users ⨝ orders (inner); per user ``order_count`` and sorted ``order_ids`` (paged).

    Users without orders and orders of unknown users drop out; a repeated
    userId in ``users`` repeats that user's orders, as an inner join does. A
    user whose order ids are all null stays, with count 0 and an empty list.
    The count stands on page 0 only; ``order_counts_per_user`` gives the counts alone.
    """
    joined = _with_known_users(orders.select("userId", "orderId"), users, max_broadcast_rows)
    if isinstance(joined.schema["orderId"].dataType, T.StringType):
        bucket, fine = prefix_bucket("orderId"), F.col("orderId")
    else:
        bucket, fine = F.floor(F.col("orderId") / F.lit(ORDER_ID_BUCKET)), None
    return paged_sorted_list(
        joined,
        ["userId"],
        F.col("orderId"),
        bucket,
        "order_ids",
        page_size=page_size,
        total_name="order_count",
        fine_bucket=fine,
    )


def _repeats(users: DataFrame) -> DataFrame:
    return users.where(F.col("userId").isNotNull()).groupBy("userId").agg(F.count(F.lit(1)).alias("_repeats"))


def order_counts_per_user(users: DataFrame, orders: DataFrame) -> DataFrame:
    """O1 without the lists: one row (userId, order_count) per user at every size.

    Orders are counted per user before the join (partial aggregation), so no key is heavy in it and
    nothing runs while the query is built. A repeated userId multiplies the count, as an inner join does.
    """
    counts = orders.groupBy("userId").agg(F.count("orderId").alias("_n"))
    return counts.join(_repeats(users), "userId").select("userId", (F.col("_n") * F.col("_repeats")).alias("order_count"))


def page_counts_per_user(users: DataFrame, logs: DataFrame) -> DataFrame:
    """O2 without the lists: one row (userId, visit_count, page_count) per user, reduced before the join."""
    counts = logs.groupBy("userId").agg(F.count("landing_url").alias("_n"), F.count_distinct("landing_url").alias("page_count"))
    joined = counts.join(_repeats(users), "userId")
    return joined.select("userId", (F.col("_n") * F.col("_repeats")).alias("visit_count"), "page_count")


def pages_per_user(
    users: DataFrame,
    logs: DataFrame,
    page_size: int = DEFAULT_PAGE_SIZE,
    max_broadcast_rows: int | None = DEFAULT_MAX_BROADCAST_ROWS,
    split_heavy: bool = True,
    max_hot_keys: int = DEFAULT_MAX_HOT_KEYS,
) -> DataFrame:
    """O2: users ⨝ logs; per user distinct ``page_count`` and every visit in ``pages_visited``.

    ``pages_visited`` keeps repeats (``visit_count >= page_count``). A sorted
    list with repeats is a sequence of runs, so it is paged from per
    (user, url) counts -- a partial aggregate, however hot the user or the
    URL -- and rebuilt with ``array_repeat``; no per-visit window or shuffle
    of visits is needed. Offsets come from range partitions of (user, URL) (``ranks``), so no
    task holds all URLs of a user. Users proven to have at most one page of visits (bounded
    pre-pass) skip the runs: one ``collect_list`` each. A user whose pages
    are all null stays, with counts 0 and an empty list. Counts stand on page 0 only;
    ``page_counts_per_user`` gives them alone.
    """
    joined = _with_known_users(logs.select("userId", "landing_url"), users, max_broadcast_rows)
    visits = joined.withColumn("_uk", F.struct(F.col("userId").alias("u")))
    known = F.col("landing_url").isNotNull()
    heavy = heavy_keys(visits.where(known), "_uk", page_size, max_hot_keys) if split_heavy else None
    if heavy is None:
        blank = visits.groupBy("userId").agg(F.max("landing_url").alias("landing_url")).where(~known)
        return _pages_from_runs(visits.where(known), page_size).unionByName(_pages_one_list(blank))
    if not heavy:
        return _pages_one_list(visits)
    light, hot = split_keys(visits, "_uk", heavy)
    return _pages_one_list(light).unionByName(_pages_from_runs(hot.where(known), page_size))


def _pages_one_list(visits: DataFrame) -> DataFrame:
    out = visits.groupBy("userId").agg(F.array_sort(F.collect_list("landing_url")).alias("pages_visited"))
    return out.select(
        "userId",
        F.lit(0).alias("page"),
        "pages_visited",
        F.size("pages_visited").cast("bigint").alias("visit_count"),
        F.size(F.array_distinct("pages_visited")).cast("bigint").alias("page_count"),
    )


def _pages_from_runs(visits: DataFrame, page_size: int) -> DataFrame:
    out = sorted_list_with_repeats(visits, ["userId"], F.col("landing_url"), "pages_visited", page_size, "visit_count", "page_count")
    return out.select("userId", "page", "pages_visited", "visit_count", "page_count")
