"""JSON collections whose fields vary: sampled schemas, VARIANT documents, malformed records, required fields."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlake.session import ensure_checkpoint_dir
from visitlake.sources import document_columns, documents, load_sampled, load_tables, malformed, merged_type, sampled_fields, sampled_schema
from visitlake.sources.tables import SCHEMAS

ROWS = [
    {"userId": 1, "source_id": 10, "amount": 1, "deep": {"a": {"b": 1}}, "tags": ["x"]},
    {"userId": 2, "source_id": "11", "amount": 2.5, "flag": True, "deep": {"a": None}},
    {"userId": 3, "source_id": None, "deep": {"a": {"b": "text"}}},
    {"userId": 4, "odd name": "z"},
]


def lines(spark, rows, tag):
    path = f"{ensure_checkpoint_dir(spark)}/{tag}"
    spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string").repartition(2).write.mode("overwrite").text(path)
    return path


def test_sampled_schema(spark):
    path = lines(spark, [*ROWS, "{broken", "", "[1]", '"text"'], "sampled")
    docs = documents(spark, path, "drop")
    assert docs.count() == 4 and sorted(r.line for r in malformed(spark, path).collect()) == ['"text"', "[1]", "{broken"]
    schema, conflicts = sampled_schema(docs)
    kinds = {f.name: f.dataType for f in schema.fields}
    assert kinds == {
        "userId": T.LongType(), "source_id": T.StringType(), "amount": T.DoubleType(), "flag": T.BooleanType(), "deep": T.VariantType(),
        "tags": T.VariantType(), "odd name": T.StringType(),
    }
    assert conflicts == {"source_id": ["BIGINT", "STRING", "VOID"], "deep.a.b": ["BIGINT", "STRING"]}
    found = {(r.field, r.kind): (r.documents, r.sampled) for r in sampled_fields(docs).collect()}
    assert found["userId", "BIGINT"] == (4, 4) and found["deep.a", "OBJECT"] == (2, 4) and found["deep.a", "VOID"] == (1, 4)
    got = {r.userId: r for r in load_sampled(spark, path, "drop").select("userId", "source_id", "amount", "flag", "odd name").collect()}
    assert (got[1].source_id, got[2].source_id, got[3].source_id) == ("10", "11", None)
    assert (got[1].amount, got[2].amount, got[4].amount, got[2].flag, got[4]["odd name"]) == (1.0, 2.5, None, True, "z")


def test_sample_is_bounded_per_partition(spark):
    path = lines(spark, [{"a": i} for i in range(400)], "bounded")
    parts = spark.read.text(path).rdd.getNumPartitions()
    assert documents(spark, path, "drop", per_partition=3).count() <= 3 * parts
    assert sampled_schema(documents(spark, lines(spark, [""], "none")))[0] == T.StructType([])


def test_types_of_a_document_do_not_fail_others(spark):
    path = lines(spark, [{"n": 1}, {"n": "x"}, {"n": {"m": 1}}, {}], "varied")
    assert sorted(str(r.n) for r in document_columns(documents(spark, path), {"n": "bigint"}).collect()) == ["1", "None", "None", "None"]


def test_malformed_lines_fail_unless_dropped(spark):
    path = lines(spark, [{"a": 1}, "{broken"], "malformed")
    with pytest.raises(Exception, match="malformed record"):
        documents(spark, path).collect()
    with pytest.raises(ValueError, match="corrupt"):
        documents(spark, path, "skip")


def test_merged_types():
    assert merged_type(["VOID"]) == (T.StringType(), False)
    assert merged_type(["BIGINT", "VOID"]) == (T.LongType(), False)
    assert merged_type(["BIGINT", "DECIMAL", "DOUBLE"]) == (T.DoubleType(), False)
    assert merged_type(["OBJECT", "ARRAY"]) == (T.StringType(), True)
    assert merged_type(["BOOLEAN", "BIGINT"]) == (T.StringType(), True)


def _json_tables(spark, tag, **changed):
    rows = {
        "users": [{"userId": "1"}], "orders": [{"userId": "1", "orderId": "5", "timestamp": "2024-01-01T00:00:00Z"}],
        "logs": [{"timestamp": "2024-01-01T00:00:00Z", "userId": "1"}], "sources": [{"source_id": "1", "source_name": "a"}],
        "campaigns": [{"uuid": "1"}],
    } | changed
    return {name: lines(spark, rows[name], f"{tag}-{name}") for name in SCHEMAS}


def test_json_loader_rejects_what_it_cannot_read(spark):
    with pytest.raises(ValueError, match="users: no record has the required fields"):
        load_tables(spark, "json", _json_tables(spark, "absent", users=[{"user": 1}, {"name": "x"}]), corrupt="drop")
    paths = _json_tables(spark, "broken", sources=["{broken", {"source_id": "1", "source_name": "a"}])
    assert load_tables(spark, "json", paths, corrupt="drop").sources.collect() == [(1, "a")]
    with pytest.raises(Exception, match="(?i)malformed"):
        load_tables(spark, "json", paths).sources.collect()
    with pytest.raises(ValueError, match="corrupt"):
        load_tables(spark, "json", paths, corrupt="skip")
    empty = load_tables(spark, "json", _json_tables(spark, "empty", users=[]))
    assert empty.users.count() == 0 and empty.logs.select(F.col("source_id")).collect() == [(None,)]


def test_variants_are_shredded(spark):
    path = f"{ensure_checkpoint_dir(spark)}/shredded"
    documents(spark, lines(spark, [{"n": i, "s": "x"} for i in range(50)], "to-shred")).select("doc").write.mode("overwrite").parquet(path)
    import pyarrow.dataset as dataset

    schema = str(dataset.dataset(path.removeprefix("file:"), format="parquet").schema)
    assert "typed_value" in schema
