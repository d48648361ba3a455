"""Streaming O4: distinct visitors per (UTC date, source) over a stream of log entries.

Exact distinct counting in two chained event-time aggregations:

1. (day window, source, user) -- one state row per visitor and day, however
   many entries the visitor sends;
2. (day window, source) counts the rows of step 1 as they are finalised.

The watermark bounds both states; a day is emitted (append mode) once the
watermark passes its end. Dates are UTC days, as in the batch operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from visitlake.operators.dims import DEFAULT_MAX_BROADCAST_ROWS, join_dimension
from visitlake.sources.tables import LOGS_SCHEMA
from visitlake.streaming.sessions import whole_second

_DAY = "1 day"


def stream_visitors_by_source_date(
    logs: DataFrame,
    sources: DataFrame,
    watermark: str = "1 hour",
    max_broadcast_rows: int | None = DEFAULT_MAX_BROADCAST_ROWS,
) -> DataFrame:
    """(date, source_name, visitors) per closed UTC day; ``sources`` is a static dimension."""
    x = logs.withColumn("_t", whole_second("timestamp"))
    if x.isStreaming:
        x = x.withWatermark("_t", watermark)
    x = join_dimension(x.select("_t", "source_id", "userId"), sources.select("source_id", "source_name"),
                       "source_id", "inner", max_broadcast_rows)
    per_visitor = x.groupBy(F.window("_t", _DAY).alias("_w"), "source_name", "userId").agg(F.count(F.lit(1)).alias("_n"))
    per_day = per_visitor.groupBy(F.window(F.window_time("_w"), _DAY).alias("_d"), "source_name").agg(
        F.count("userId").alias("visitors")  # a day and source seen by null users only counts 0, as in the batch operator
    )
    day = F.date_from_unix_date(F.floor(F.unix_timestamp("_d.start") / 86400).cast("int"))
    return per_day.select(day.alias("date"), "source_name", "visitors")


def run_visitors_stream(
    spark: SparkSession,
    source_dir: str,
    sink_dir: str,
    sources: DataFrame,
    checkpoint: str,
    watermark: str = "1 hour",
    available_now: bool = True,
) -> StreamingQuery:
    """Read log parquet files as they arrive; write each closed day's counts as parquet."""
    logs = spark.readStream.schema(LOGS_SCHEMA).parquet(source_dir)
    out = stream_visitors_by_source_date(logs, sources, watermark)
    writer = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(sink_dir)
