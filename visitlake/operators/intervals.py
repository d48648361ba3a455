"""O16 for any number of time conditions: the conditions are a table, not a predicate.

``filter_time_conditions`` writes its conditions into one predicate, so the plan grows with their number. Here they
are rows (dateFrom, dateTo; null is open):

* AND: the intersection is one range, the greatest start to the least end, found by one aggregate; the range is a literal
  filter, which reaches the scan.
* OR: every condition is cut at the edges of fixed time bins, and the pieces of a bin are coalesced where they touch, in a window over the bin's
  pieces. A bin is then one row with its disjoint spans, ascending, and a row of data looks its bin up in an equi join: no row is
  compared with all conditions and none matches twice. The whole range of the conditions is a literal filter on the scan.
  Starts and ends that are open are two more literals: everything up to the greatest end without a start, and from the least start without an end.

The bins' table goes through ``join_dimension``: broadcast behind a check of its size, else by shuffle with hot bins dealt out.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitlake.operators.dims import DEFAULT_MAX_BROADCAST_ROWS, join_dimension

DEFAULT_BIN_SECONDS = 3600


def _bin(at: Column | str, seconds: int) -> Column:
    return F.floor(F.unix_timestamp(at) / F.lit(seconds))


def coalesced_bins(conditions: DataFrame, bin_seconds: int = DEFAULT_BIN_SECONDS) -> DataFrame:
    """(bin, spans): the closed, non-empty conditions (lo, hi) cut to time bins; a bin's spans are disjoint and ascending.

    A span that goes on past its bin's last whole second keeps its own end: all rows of the bin are before it.
    """
    closed = conditions.where(F.col("lo") <= F.col("hi"))
    cut = closed.select("lo", "hi", F.explode(F.sequence(_bin("lo", bin_seconds), _bin("hi", bin_seconds))).alias("bin"))
    by_bin = Window.partitionBy("bin").orderBy("lo", "hi")
    reached = F.max("hi").over(by_bin.rowsBetween(Window.unboundedPreceding, -1))
    first = F.when(reached.isNull() | (F.col("lo") > reached), 1).otherwise(0)
    # equal pieces count once, so a condition that is repeated any number of times is one
    pieces = cut.groupBy("bin", "lo", "hi").agg(F.lit(1).alias("_")).withColumn("first", first)
    span = F.sum("first").over(by_bin.rowsBetween(Window.unboundedPreceding, 0))
    spans = pieces.withColumn("span", span).groupBy("bin", "span").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return spans.groupBy("bin").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def filter_time_condition_table(
    df: DataFrame,
    conditions: DataFrame,
    operator: str = "OR",
    ts: str = "timestamp",
    dedupe: bool = True,
    bin_seconds: int = DEFAULT_BIN_SECONDS,
    max_broadcast_rows: int | None = DEFAULT_MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Rows whose ``ts`` is within the conditions (dateFrom, dateTo), inclusive; equal rows are then removed.

    As ``filter_time_conditions``: no conditions keep all rows, a null ``ts`` is in no range, and a range whose end is before its start holds nothing.
    The plan is the same for any number of conditions; two small aggregates over them run when it is built.
    """
    op = operator.upper()
    if op not in ("OR", "AND"):
        raise ValueError(f"operator must be OR or AND, not {operator!r}")
    ranges = conditions.select(F.col("dateFrom").cast("timestamp_ntz").alias("lo"), F.col("dateTo").cast("timestamp_ntz").alias("hi"))
    at, lo, hi = F.col(ts), F.col("lo"), F.col("hi")
    if op == "AND":
        found = ranges.agg(F.max("lo").alias("lo"), F.min("hi").alias("hi")).first()
        out = df
        if found["lo"] is not None:
            out = out.where(at >= F.lit(found["lo"]).cast("timestamp_ntz"))
        if found["hi"] is not None:
            out = out.where(at <= F.lit(found["hi"]).cast("timestamp_ntz"))
        return out.dropDuplicates() if dedupe else out
    closed = lo.isNotNull() & hi.isNotNull() & (lo <= hi)
    edge = ranges.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(lo.isNull() & hi.isNull(), 1)).alias("all"),
        F.max(F.when(lo.isNull(), hi)).alias("until"),
        F.min(F.when(hi.isNull(), lo)).alias("since"),
        F.min(F.when(closed, lo)).alias("first"),
        F.max(F.when(closed, hi)).alias("last"),
    ).first()
    if edge["n"] == 0 or edge["all"]:
        return df.dropDuplicates() if dedupe else df
    literal = {k: F.lit(edge[k]).cast("timestamp_ntz") for k in ("until", "since", "first", "last") if edge[k] is not None}

    def open_ended(col: Column) -> list[Column]:
        return [col <= literal[k] if k == "until" else col >= literal[k] for k in ("until", "since") if k in literal]

    inside = [at.between(literal["first"], literal["last"])] if "first" in literal else []
    reach = [*open_ended(at), *inside]
    near = df.where(reduce(or_, reach) if reach else F.lit(False))
    if not inside:
        return near.dropDuplicates() if dedupe else near
    bins = coalesced_bins(ranges, bin_seconds)
    keyed = near.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), _bin(at, bin_seconds).alias("bin"))
    met = join_dimension(keyed, bins, "bin", "left", max_broadcast_rows)
    here = F.col("_row").getField(ts)
    held = F.coalesce(F.exists("spans", lambda s: here.between(s["lo"], s["hi"])), F.lit(False))
    kept = met.where(reduce(or_, [*open_ended(here), held]))
    out = kept.select(*[F.col("_row").getField(c).alias(c) for c in df.columns])
    return out.dropDuplicates() if dedupe else out
