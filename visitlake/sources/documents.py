"""Collections of JSON documents whose fields vary: sampled schemas, and documents kept as VARIANT columns.

A document store states no schema. Two ways to read such a collection:

* ``sampled_fields``, over a bounded number of documents per partition, merges what it sees, per field, over all
  partitions: a partial aggregate over (field, type), so neither the number of documents nor of partitions
  matters to a task or the driver, which gets one row per field and type. ``merged_type`` is the lattice that
  turns a field's types into one column type; types without a common one become text and are reported.
* ``documents`` keeps each document as one VARIANT; ``document_columns`` reads typed fields from it row by row, so a field may
  be absent, or of another type, in any document. Written as Parquet, Spark shreds the common fields into
  columns of their own, which later reads push down.

Lines that are no JSON are never read as rows of nulls: they fail the query, are left out, or are kept beside.
"""

from __future__ import annotations

from typing import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents looked at per partition, and levels of nested objects.
SAMPLE_PER_PARTITION, DEPTH = 1000, 4

_NUMBERS = ("BIGINT", "DECIMAL", "FLOAT", "DOUBLE")
_PLAIN = {"BIGINT": T.LongType(), "DECIMAL": T.DoubleType(), "FLOAT": T.DoubleType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType()}


def documents(spark: SparkSession, path: str, corrupt: str = "fail", per_partition: int | None = None) -> DataFrame:
    """(doc variant, line string) of every non-blank line of the JSON lines at ``path``, or of the first ``per_partition`` of each partition.

    A line that is no JSON object raises when it is read (``corrupt="fail"``), is left out (``"drop"``), or stays with
    a null ``doc`` (``"keep"``).
    """
    if corrupt not in ("fail", "drop", "keep"):
        raise ValueError(f"corrupt must be fail, drop or keep, not {corrupt!r}")
    lines = spark.read.text(path).where(F.trim("value") != "")
    if per_partition is not None:  # before parsing: the other lines are only skipped
        number = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        lines = lines.withColumn("_at", number).where(F.col("_at") < per_partition).drop("_at")
    parsed = lines.select(F.try_parse_json("value").alias("doc"), F.col("value").alias("line"))
    is_object = F.col("doc").isNotNull() & F.schema_of_variant("doc").startswith("OBJECT")
    if corrupt == "drop":
        return parsed.where(is_object)
    if corrupt == "keep":
        return parsed.select(F.when(is_object, F.col("doc")).alias("doc"), "line")
    broken = F.raise_error(F.concat(F.lit("malformed record: "), F.substring("line", 1, 200)))
    return parsed.where(F.when(is_object, F.lit(True)).otherwise(broken.cast("boolean")))


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """The lines (``line``) that are no JSON objects."""
    return documents(spark, path, "keep").where("doc is null").select("line")


def _kind(value: Column) -> Column:
    """The outer type of a variant: OBJECT, ARRAY, BIGINT, DECIMAL, ... (a JSON null is VOID)."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z_]+", 0)


def sampled_fields(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(field, kind, documents, sampled): per dotted field and type, in how many of the ``sampled`` documents it has that type.

    Fields of objects nested up to ``depth`` levels are listed by their own paths. No documents give no rows.
    """
    session = docs.sparkSession
    level = docs.where("doc is not null").select(F.lit("").alias("path"), F.col("doc").alias("value"))
    found = level.select(F.lit("").alias("field"), F.lit("OBJECT").alias("kind"))
    for _ in range(depth):
        inner = level.withColumnRenamed("value", "_outer").lateralJoin(session.tvf.variant_explode(F.col("_outer").outer()))
        level = inner.where("key is not null").select(F.concat(F.col("path"), F.lit("."), F.col("key")).alias("path"), "value")
        found = found.unionByName(level.select(F.substring("path", 2, 1 << 30).alias("field"), _kind(F.col("value")).alias("kind")))
        level = level.where(_kind(F.col("value")) == "OBJECT")
    counts = found.groupBy("field", "kind").agg(F.count(F.lit(1)).alias("documents"))
    total = counts.where("field = ''").select(F.col("documents").alias("sampled"))
    return counts.where("field <> ''").join(F.broadcast(total))  # one row


def merged_type(kinds: Iterable[str]) -> tuple[T.DataType, bool]:
    """The column type of a field with these types, and whether they conflict: nulls go with any type, whole numbers with
    fractions; other mixtures are text. Objects and arrays stay documents (VARIANT)."""
    seen = {k for k in kinds if k != "VOID"}
    if not seen:
        return T.StringType(), False
    if len(seen) == 1:
        kind = seen.pop()
        return (T.VariantType(), False) if kind in ("OBJECT", "ARRAY") else (_PLAIN.get(kind, T.StringType()), False)
    if seen <= set(_NUMBERS):
        return T.DoubleType(), False
    return T.StringType(), True


def sampled_schema(docs: DataFrame) -> tuple[T.StructType, dict[str, list[str]]]:
    """The merged schema of the documents' top-level fields, by name, and the types of fields that conflict (nested ones too)."""
    kinds: dict[str, list[str]] = {}
    for r in sampled_fields(docs).select("field", "kind").collect():  # one row a field and type
        kinds.setdefault(r["field"], []).append(r["kind"])
    conflicts = {f: sorted(k) for f, k in kinds.items() if merged_type(k)[1]}
    fields = [T.StructField(f, merged_type(k)[0]) for f, k in sorted(kinds.items()) if "." not in f]
    return T.StructType(fields), conflicts


def document_columns(docs: DataFrame, schema: T.StructType | Mapping[str, str]) -> DataFrame:
    """The fields of ``schema`` (by name) read from ``doc`` row by row: null where a document lacks the field or has another type."""
    types = {f.name: f.dataType for f in schema.fields} if isinstance(schema, T.StructType) else dict(schema)
    out = []
    for name, kind in types.items():
        path = "$." + name if name.isidentifier() else f"$['{name}']"
        whole = kind if isinstance(kind, str) else kind.simpleString()
        out.append(F.try_variant_get("doc", path, whole).alias(name))
    return docs.select(*out)


def load_sampled(spark: SparkSession, path: str, corrupt: str = "fail", per_partition: int = SAMPLE_PER_PARTITION) -> DataFrame:
    """The JSON lines at ``path`` with a sampled schema; conflicting fields are text."""
    schema, _ = sampled_schema(documents(spark, path, "drop", per_partition))
    return document_columns(documents(spark, path, corrupt), schema)
