"""Sorted lists per group, split into bounded pages.

The reference returns one unbounded list per group (orders of a user, entries
of a session path, conversions of a day). Building such a list in one task
does not survive a hot group, so every list column here is paged: page ``p``
of a group holds elements ``p*page_size .. (p+1)*page_size - 1`` of the
group's list in ascending element order. A group that fits one page gives one
row with ``page = 0`` -- the reference's shape.

How the rank is found without putting a group in one task:

1. each element gets a *bucket* that is monotone in element order (a time
   bucket, an id range, a string prefix);
2. per (group, bucket) counts are aggregated (partial aggregation, no skew);
3. running sums over the bucket counts give the offset of each bucket --
   in two levels (sub-buckets of a coarse bucket, then the group's coarse
   buckets), so a window sees one row per bucket, never per element;
4. a ``row_number`` inside (group, bucket) plus the offset is the exact rank;
5. ``groupBy(group, page)`` builds the lists; every group of that aggregate
   has at most ``page_size`` elements.

Only groups that need more than one page take that path: a bounded pre-pass
(``skew.heavy_keys``) lists the groups with more than ``page_size`` elements,
and every other group -- proven to fit one page -- is a single
``collect_list`` with ``page = 0``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitlake.operators.skew import DEFAULT_MAX_HOT_KEYS, heavy_keys, refine_buckets, split_keys

# A (group, bucket) of a multi-page group with more elements than this is
# split by the caller's finer bucket (for time-ordered lists: one per second).
DEFAULT_HOT_BUCKET_ROWS = 1_000_000

DEFAULT_PAGE_SIZE = 10_000

_K = "_grp"


def group_key(cols: Sequence[str]) -> Column:
    """One struct column for a composite key; nulls inside compare equal (null-safe)."""
    return F.struct(*[F.col(f"`{c}`") for c in cols])


def paged_sorted_list(
    df: DataFrame,
    keys: Sequence[str],
    item: Column,
    bucket: Column,
    list_name: str,
    page_size: int = DEFAULT_PAGE_SIZE,
    total_name: str | None = None,
    page_name: str = "page",
    last_name: str | None = None,
    split_heavy: bool = True,
    max_hot_keys: int = DEFAULT_MAX_HOT_KEYS,
    fine_bucket: Column | None = None,
    hot_bucket_rows: int | None = DEFAULT_HOT_BUCKET_ROWS,
) -> DataFrame:
    """One row per (keys, page) with the sorted elements of that page.

    ``item`` is the element (any orderable type, nulls are skipped like
    ``collect_list``; a group of nulls only keeps one row with an empty list); ``bucket`` must be non-decreasing in element order.
    ``total_name`` adds the group's element count to its first page (null on the others, so that
    sums over rows are sums over groups) and ``last_name`` the group's greatest element
    (the end of its last page) to every page.
    ``split_heavy=False`` sends every group through the ranked path.
    ``fine_bucket`` (non-decreasing in element order, refining ``bucket``)
    splits a bucket holding more than ``hot_bucket_rows`` elements.
    """
    if page_size <= 0:
        raise ValueError("page_size must be positive")
    cols = [group_key(keys).alias(_K), bucket.alias("_b"), item.alias("_item")]
    if fine_bucket is not None:
        cols.append(fine_bucket.alias("_f"))
    rows = df.select(*cols)
    present = rows.where(F.col("_item").isNotNull())
    names = (list_name, total_name, last_name, page_name)
    ranked = dict(page_size=page_size, hot_bucket_rows=hot_bucket_rows, max_hot_keys=max_hot_keys)
    heavy = heavy_keys(present, _K, page_size, max_hot_keys) if split_heavy else None
    if heavy is None:
        out = _ranked_pages(present, *names, **ranked).unionByName(_one_page(_of_nulls_only(rows), *names))
    elif not heavy:
        out = _one_page(rows, *names)
    else:
        light, hot = split_keys(rows, _K, heavy)
        hot = hot.where(F.col("_item").isNotNull())
        out = _one_page(light, *names).unionByName(_ranked_pages(hot, *names, **ranked))
    key_cols = [F.col(f"{_K}.`{c}`").alias(c) for c in keys]
    rest = [c for c in out.columns if c != _K]
    return out.select(*key_cols, *rest)


def _of_nulls_only(rows: DataFrame) -> DataFrame:
    """One row with a null element for each group that has no other element."""
    return rows.groupBy(_K).agg(F.max("_item").alias("_item")).where(F.col("_item").isNull())


def _one_page(rows: DataFrame, list_name, total_name, last_name, page_name) -> DataFrame:
    """Groups proven to hold at most one page: one partial-aggregated ``collect_list``."""
    aggs = [F.array_sort(F.collect_list("_item")).alias(list_name)]
    if total_name:
        aggs.append(F.count("_item").alias(total_name))
    if last_name:
        aggs.append(F.max("_item").alias(last_name))
    out = rows.groupBy(_K).agg(*aggs).withColumn(page_name, F.lit(0))
    return out.select(_K, page_name, *[n for n in (list_name, total_name, last_name) if n])


def _ranked_pages(
    rows: DataFrame, list_name, total_name, last_name, page_name, page_size, hot_bucket_rows, max_hot_keys
) -> DataFrame:
    """Exact pages of any group size (steps 1-5 of the module doc)."""
    # The bucket is a non-nullable struct: no null-filter is inferred on one
    # side of the self-join below, so both sides share one exchange.
    split = False
    if "_f" in rows.columns:
        rows, split = refine_buckets(rows, _K, F.col("_b"), F.col("_f"), hot_bucket_rows, max_hot_keys)
        rows = rows.drop("_b", "_f")
    else:
        rows = rows.withColumn("_bkt", F.struct(F.col("_b").alias("b"))).drop("_b")
    # The summary is taken from the ranked rows (already clustered by group and
    # bucket), so the input is scanned and shuffled once.
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(_K, "_bkt").orderBy("_item")))
    sub = ranked.groupBy(_K, "_bkt").agg(F.max("_rn").alias("_n"), F.max("_item").alias("_bmax"))
    summary = _offsets_two_level(sub) if split else _offsets_one_level(sub)
    placed = ranked.join(summary, [_K, "_bkt"])
    page = F.floor((F.col("_before") + F.col("_rn") - 1) / F.lit(page_size)).cast("int")
    aggs = [F.array_sort(F.collect_list("_item")).alias(list_name)]
    if total_name:
        aggs.append(F.max(F.when(page == 0, F.col("_total"))).cast("bigint").alias(total_name))
    if last_name:
        aggs.append(F.max("_last").alias(last_name))
    out = placed.groupBy(_K, page.alias(page_name)).agg(*aggs)
    return out.select(_K, page_name, *[n for n in (list_name, total_name, last_name) if n])


def _offsets_one_level(sub: DataFrame) -> DataFrame:
    """Per (group, bucket): elements before it, group total, group maximum."""
    by_group = Window.partitionBy(_K)
    before = F.sum("_n").over(by_group.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1))
    return sub.select(
        _K,
        "_bkt",
        F.coalesce(before, F.lit(0)).alias("_before"),
        F.sum("_n").over(by_group).alias("_total"),
        F.max("_bmax").over(by_group).alias("_last"),
    )


def _offsets_two_level(sub: DataFrame) -> DataFrame:
    """As ``_offsets_one_level`` for split buckets: sub-buckets within a coarse
    bucket, then the group's coarse buckets -- no window sees more than one of those lists."""
    sub = sub.withColumn("_b", F.col("_bkt.b"))
    wh = Window.partitionBy(_K, "_b").orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    sub = sub.withColumn("_off_in", F.coalesce(F.sum("_n").over(wh), F.lit(0)))
    coarse = sub.groupBy(_K, "_b").agg(F.sum("_n").alias("_cn"), F.max("_bmax").alias("_cmax"))
    by_group = Window.partitionBy(_K)
    coarse = coarse.select(
        _K,
        "_b",
        F.coalesce(F.sum("_cn").over(by_group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("_c_off"),
        F.sum("_cn").over(by_group).alias("_total"),
        F.max("_cmax").over(by_group).alias("_last"),
    )
    return sub.join(coarse, [_K, "_b"]).select(
        _K, "_bkt", (F.col("_c_off") + F.col("_off_in")).alias("_before"), "_total", "_last"
    )


def time_bucket(ts: Column | str, seconds: int) -> Column:
    """Bucket number of a timestamp: floor(epoch seconds / width)."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_timestamp(col) / F.lit(seconds))


def prefix_bucket(value: Column | str, length: int = 8) -> Column:
    """Bucket for lists of strings sorted by value: the first ``length`` characters.

    A string's prefix is non-decreasing in string order, so prefixes are valid
    buckets; a heavy prefix can be refined by the full value (``fine_bucket``).
    """
    col = F.col(value) if isinstance(value, str) else value
    return F.substring(col, 1, length)
