"""Streaming session summary: the I3 per-session rollup over a stream of log entries.

``session_window`` with a 30-minute gap is Spark's native form of the
sessionization rule. Entries are truncated to whole seconds first, so the
merge test is the reference's: a gap of at most 1800 whole seconds keeps the
session open (``session_window`` merges at exactly the gap), 1801 splits it.
State is bounded by the watermark: a session is emitted (append mode) once
the watermark passes its end, then dropped from state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from visitlake.operators.sessions import DEFAULT_GAP_SECONDS
from visitlake.sources.tables import LOGS_SCHEMA


def whole_second(ts: str) -> F.Column:
    """The UTC instant of a timestamp_ntz, truncated to the second.

    Watermarks need an instant (``timestamp``); epoch seconds of the UTC wall
    clock give it without any session-zone conversion.
    """
    return F.timestamp_seconds(F.unix_timestamp(ts))


def stream_session_summary(
    logs: DataFrame,
    gap_seconds: int = DEFAULT_GAP_SECONDS,
    watermark: str = "1 hour",
    user: str = "userId",
    ts: str = "timestamp",
) -> DataFrame:
    """Per (user, session): start, end, entries, first/last page, first source.

    Works on a streaming or a batch DataFrame. Sessions are identified by
    (user, session_start) -- a stream has no global running session number.
    """
    x = logs.where(F.col(user).isNotNull()).withColumn("_t", whole_second(ts))
    if x.isStreaming:
        x = x.withWatermark("_t", watermark)
    first = F.min(F.struct(F.col(ts).alias("t"), F.col("landing_url").alias("u"), F.col("source_id").alias("s")))
    last = F.max(F.struct(F.col(ts).alias("t"), F.col("landing_url").alias("u")))
    agg = x.groupBy(F.col(user), F.session_window("_t", f"{gap_seconds} seconds").alias("_w")).agg(
        F.min(ts).alias("session_start"),
        F.max(ts).alias("session_end"),
        F.count(F.lit(1)).alias("entries"),
        first.alias("_first"),
        last.alias("_last"),
    )
    return agg.select(
        user,
        "session_start",
        "session_end",
        (F.unix_timestamp("session_end") - F.unix_timestamp("session_start")).alias("duration_seconds"),
        "entries",
        F.col("_first.u").alias("first_page"),
        F.col("_last.u").alias("last_page"),
        F.col("_first.s").alias("first_source_id"),
    )


def run_session_stream(
    spark: SparkSession,
    source_dir: str,
    sink_dir: str,
    checkpoint: str,
    gap_seconds: int = DEFAULT_GAP_SECONDS,
    watermark: str = "1 hour",
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Read log parquet files as they arrive, write closed sessions as parquet (exactly once).

    ``checkpoint`` is this stream's own folder on shared storage.
    """
    reader = spark.readStream.schema(LOGS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    logs = reader.parquet(source_dir)
    out = stream_session_summary(logs, gap_seconds, watermark)
    writer = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(sink_dir)
