"""Ranks in sorted groups of any size, without a window over a group.

Values of a group are rows (group, value, count): a value that occurs a billion times is one row. The rows are range
partitioned by (group, value), which deals a hot group over as many partitions as it needs, and stored. The place of a value in its
group's sorted list is then a sum of three things: the counts before it in its partition (a window over a partition's rows of one group),
the counts of the group in earlier partitions (a window over one row per partition), and its own copies.
"""

from __future__ import annotations

from typing import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitlake.session import ensure_checkpoint_dir

GROUP, VALUE, COUNT = "_grp", "_value", "_n"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that all readers see the same partitions and rows."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """(group, value, count) of the non-null values of each group; null keys are keys."""
    group = F.struct(*[F.col(f"`{k}`") for k in keys])
    return df.select(group.alias(GROUP), value.alias(VALUE)).where(F.col(VALUE).isNotNull()).groupBy(GROUP, VALUE).agg(F.count(F.lit(1)).alias(COUNT))


def placed(counts: DataFrame, partitions: int | None = None) -> DataFrame:
    """``counts`` with ``_before`` (elements of the group that are less), ``_total`` and ``_distinct`` (of the group)."""
    n = partitions or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(counts.repartitionByRange(n, GROUP, VALUE).withColumn("_part", F.spark_partition_id()), "ranks")
    inside = Window.partitionBy("_part", GROUP).orderBy(VALUE).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("_in", F.coalesce(F.sum(COUNT).over(inside), F.lit(0)))
    whole = Window.partitionBy(GROUP)  # a row for each partition that the group reaches
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part", GROUP).agg(F.sum(COUNT).alias("_s"), F.count(F.lit(1)).alias("_d")).select(
        "_part", GROUP, F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_gone"),
        F.sum("_s").over(whole).alias("_total"), F.sum("_d").over(whole).alias("_distinct"))
    met = rows.join(parts, ["_part", GROUP])
    return met.select(GROUP, VALUE, COUNT, (F.col("_gone") + F.col("_in")).alias("_before"), "_total", "_distinct")


def pages(counts: DataFrame, list_name: str, page_size: int, total_name: str, distinct_name: str, partitions: int | None = None) -> DataFrame:
    """One row per (group, page): the page's elements of the group's sorted list, copies repeated.

    Totals stand on page 0 only. A page has at most ``page_size`` elements, whatever a group or one value's count is.
    """
    if page_size <= 0:
        raise ValueError("page_size must be positive")
    size = F.lit(page_size)
    first, last = F.floor(F.col("_before") / size), F.floor((F.col("_before") + F.col(COUNT) - 1) / size)
    spans = placed(counts, partitions).withColumn("page", F.explode(F.sequence(first, last)))
    low, high = F.greatest("_before", F.col("page") * size), F.least(F.col("_before") + F.col(COUNT), (F.col("page") + 1) * size)
    spans = spans.withColumn("_copies", (high - low).cast("int"))
    out = spans.groupBy(GROUP, F.col("page").cast("int").alias("page")).agg(
        F.array_sort(F.collect_list(F.struct(VALUE, "_copies"))).alias("_runs"),
        F.max(F.when(F.col("page") == 0, F.col("_total"))).cast("bigint").alias(total_name),
        F.max(F.when(F.col("page") == 0, F.col("_distinct"))).cast("bigint").alias(distinct_name),
    )
    elements = F.flatten(F.transform("_runs", lambda r: F.array_repeat(r[VALUE], r["_copies"])))
    return out.select(F.col(f"{GROUP}.*"), "page", elements.alias(list_name), total_name, distinct_name)


def sorted_list_with_repeats(
    df: DataFrame, keys: Sequence[str], value: Column, list_name: str, page_size: int, total_name: str = "total", distinct_name: str = "distinct_total",
    partitions: int | None = None,
) -> DataFrame:
    """``collect_list`` of a group's values, sorted, in pages, with its size and number of distinct values; one shape for groups of any size.

    Null values are not listed, and a group of nulls alone has no row; null keys are a group. The input is read once, into counts.
    """
    return pages(counted(df, keys, value), list_name, page_size, total_name, distinct_name, partitions)
