"""The five input tables and their loader (scan side of every operator).

Tables are plain DataFrames. The loader reads any Spark data source with an
explicit schema (no sampling-based inference), normalises join keys to one
type and timestamps to UTC wall-clock ``timestamp_ntz`` so that every
operator behaves the same whatever the session time zone is. Join keys are
bigint, or text with ``key_type="string"``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import and_
from typing import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Logical schemas, known from column use. Keys are bigint after loading.
USERS_SCHEMA = T.StructType([T.StructField("userId", T.LongType(), False)])
ORDERS_SCHEMA = T.StructType([
    T.StructField("userId", T.LongType(), True),
    T.StructField("orderId", T.LongType(), False),
    T.StructField("timestamp", T.TimestampNTZType(), False),
])
LOGS_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("source_id", T.LongType(), True),
    T.StructField("userId", T.LongType(), True),
    T.StructField("referrer", T.StringType(), True),
    T.StructField("landing_url", T.StringType(), True),
    T.StructField("utm_source", T.StringType(), True),
])
SOURCES_SCHEMA = T.StructType([
    T.StructField("source_id", T.LongType(), False),
    T.StructField("source_name", T.StringType(), False),
])
CAMPAIGNS_SCHEMA = T.StructType([
    T.StructField("uuid", T.LongType(), False),
    T.StructField("type", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("params", T.StringType(), True),
])

SCHEMAS: Mapping[str, T.StructType] = {
    "users": USERS_SCHEMA,
    "orders": ORDERS_SCHEMA,
    "logs": LOGS_SCHEMA,
    "sources": SOURCES_SCHEMA,
    "campaigns": CAMPAIGNS_SCHEMA,
}

# The only column that may be missing from a source (checked at plan time, O19).
OPTIONAL_COLUMNS = ("utm_source",)
KEY_COLUMNS = ("userId", "orderId", "source_id", "uuid")

# What becomes of malformed JSON records.
JSON_MODES = {"fail": "FAILFAST", "drop": "DROPMALFORMED"}

# Text times with a zone offset, and epoch seconds written as text.
_OFFSET = r"\d\d:\d\d.*(Z|[+-]\d\d:?\d\d)$"
_EPOCH = r"^-?\d{5,}(\.\d+)?$"


@dataclass(frozen=True)
class Tables:
    """The catalog: one lazily loaded DataFrame per collection."""

    users: DataFrame
    orders: DataFrame
    logs: DataFrame
    sources: DataFrame
    campaigns: DataFrame

    def with_(self, **changes: DataFrame) -> "Tables":
        return replace(self, **changes)


def _from_epoch(seconds: Column) -> Column:
    """UTC wall clock of epoch seconds; plain arithmetic, so no session zone and no repeated hour is involved."""
    zero = F.lit(0)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))


def _from_instant(instant: Column) -> Column:
    return _from_epoch(F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)"))


def utc_ntz(col: Column, dtype: T.DataType) -> Column:
    """A timestamp column as UTC wall clock without zone (what every operator expects)."""
    if isinstance(dtype, T.TimestampNTZType):
        return col
    if isinstance(dtype, T.TimestampType):
        return _from_instant(col)
    if isinstance(dtype, T.StringType):
        # a zone offset makes the text an instant; without one it is UTC already
        instant = F.regexp_replace(col, r"([+-]\d\d)(\d\d)$", "$1:$2").cast("timestamp")
        return (
            F.when(col.rlike(_OFFSET), _from_instant(instant))
            .when(col.rlike(_EPOCH), _from_epoch(col))
            .otherwise(F.to_timestamp_ntz(col))
        )
    if isinstance(dtype, T.DateType):
        return F.to_timestamp_ntz(col)
    if isinstance(dtype, (T.NumericType,)):
        return _from_epoch(col)
    raise TypeError(f"cannot read {dtype} as a timestamp")


def normalise(df: DataFrame, schema: T.StructType, key_type: str = "bigint") -> DataFrame:
    """Project ``df`` onto ``schema``: cast keys, convert times, keep optional columns optional.

    Raises ``ValueError`` if a column other than the optional ones is absent.
    """
    present = {f.name: f.dataType for f in df.schema.fields}
    absent = [f.name for f in schema.fields if f.name not in present and f.name not in OPTIONAL_COLUMNS]
    if absent:
        raise ValueError(f"required columns are absent: {absent}")
    cols = []
    for field in schema.fields:
        if field.name not in present:
            continue  # optional column absent; operators test for it (O19)
        src = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampNTZType):
            cols.append(utc_ntz(src, present[field.name]).alias(field.name))
        elif field.name in KEY_COLUMNS and present[field.name].simpleString() != key_type:
            cols.append(src.cast(key_type).alias(field.name))
        elif field.name in KEY_COLUMNS or present[field.name] == field.dataType:
            cols.append(src)
        else:
            cols.append(src.cast(field.dataType).alias(field.name))
    return df.select(*cols)


def _require_fields(name: str, raw: DataFrame, required: list[str]) -> None:
    """Raise ``ValueError`` if the records of ``raw``, if any, all lack one of the required fields."""
    there = [F.col(f"`{c}`").isNotNull() for c in required]
    if raw.where(reduce(and_, there)).take(1):
        return
    lacking = [c for c, present in zip(required, there, strict=True) if not raw.where(present).take(1)]
    if lacking and raw.select(*[F.col(f"`{c}`") for c in raw.columns]).take(1):
        raise ValueError(f"{name}: no record has the required fields {lacking}")


def load_tables(
    spark: SparkSession,
    fmt: str,
    paths: Mapping[str, str] | None = None,
    options: Mapping[str, Mapping[str, str]] | None = None,
    common_options: Mapping[str, str] | None = None,
    formats: Mapping[str, str] | None = None,
    key_type: str = "bigint",
    corrupt: str = "fail",
) -> Tables:
    """Load the five collections from any Spark source.

    ``paths[name]`` is passed to ``load``; ``options[name]`` (for example a
    connector's database/collection/uri) and ``common_options`` go to the
    reader; ``formats[name]`` overrides ``fmt`` for one table. Reads are lazy;
    only the columns an operator uses are scanned. ``key_type="string"`` keeps
    the join keys as text (uuids, document ids). JSON is read with a schema of text columns, so it is
    not read to infer one. A malformed JSON record fails the read (``corrupt="fail"``) or is left out
    (``corrupt="drop"``); a required field that no record has raises ``ValueError``, found by a probe that stops at
    the first complete record. Other sources state their columns.
    """
    if corrupt not in JSON_MODES:
        raise ValueError(f"corrupt must be one of {sorted(JSON_MODES)}, not {corrupt!r}")
    paths = paths or {}
    options = options or {}
    frames = {}
    for name, schema in SCHEMAS.items():
        source = (formats or {}).get(name, fmt)
        reader = spark.read.format(source)
        if source == "json":
            text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
            reader = reader.schema(text).option("mode", JSON_MODES[corrupt])
        reader = reader.options(**(common_options or {})).options(**options.get(name, {}))
        path = paths.get(name)
        raw = reader.load(path) if path is not None else reader.load()
        if source == "json":
            _require_fields(name, raw, [f.name for f in schema.fields if not f.nullable])
        frames[name] = normalise(raw, schema, key_type)
    return Tables(**frames)
