"""O20 JSON records and file sinks; results stay distributed (no collect)."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlake.fixed import CAMPAIGN_NAME_FIELD, PREVIEW_ROWS

JSON_RENAMES = {"campaign_name": CAMPAIGN_NAME_FIELD}

# UTC wall-clock timestamps are written with a Z suffix, as the reference's records show them.
_TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSS]'Z'"


def _json_options(keep_nulls: bool) -> dict[str, str]:
    return {
        "ignoreNullFields": "false" if keep_nulls else "true",
        "timestampNTZFormat": _TS_FORMAT,
        "timestampFormat": _TS_FORMAT,
    }


def _named(kind: T.DataType, renames: Mapping[str, str]) -> T.DataType:
    """``kind`` with the struct fields of every level renamed."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(renames.get(f.name, f.name), _named(f.dataType, renames), f.nullable) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_named(kind.elementType, renames), kind.containsNull)
    return kind


def _renamed(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    out = []
    for f in df.schema.fields:
        kind = _named(f.dataType, renames)
        value = F.col(f"`{f.name}`")
        out.append((value if kind == f.dataType else value.cast(kind)).alias(renames.get(f.name, f.name)))
    return df.select(*out)


def json_records(df: DataFrame, keep_nulls: bool = False, renames: Mapping[str, str] = JSON_RENAMES) -> DataFrame:
    """One JSON text per row in column ``json``; null fields omitted unless ``keep_nulls``.

    Columns and the fields of nested structs and arrays are renamed by ``renames``
    (``campaign_name`` -> ``Campaign name``).
    """
    out = _renamed(df, renames)
    return out.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in out.columns]), _json_options(keep_nulls)).alias("json"))


def write_json(df: DataFrame, path: str, keep_nulls: bool = False, mode: str = "errorifexists",
               renames: Mapping[str, str] = JSON_RENAMES) -> None:
    """Write result rows as JSON lines from the executors (one file per partition)."""
    _renamed(df, renames).write.mode(mode).options(**_json_options(keep_nulls)).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by=None) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def preview(df: DataFrame, n: int = PREVIEW_ROWS, order_by=None) -> DataFrame:
    """Console-style preview: the first ``n`` rows (a limit is the feature here).

    With ``order_by`` the rows are a deterministic top-n (TakeOrderedAndProject,
    no full sort); without it Spark returns any ``n`` rows, as ``show`` does.
    """
    return (df.orderBy(*order_by) if order_by else df).limit(n)
