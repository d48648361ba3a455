"""The data source of length-prefixed documents: every record once at any split size, pruned blocks, odd records."""

from __future__ import annotations

import datetime as dt
import random
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from visitlake.session import ensure_checkpoint_dir
from visitlake.sources import dumps
from visitlake.sources.dumps import DumpReader, encoded, fields, read_dump, write_dump, write_dump_index

SCHEMA = "n bigint, at timestamp_ntz, s string, x double, flag boolean"
START = dt.datetime(2024, 1, 1)


def folder(spark):
    return f"{ensure_checkpoint_dir(spark)}/dump-{uuid4().hex}"


def write(spark, path, files):
    store, plain = dumps.file_system(path)
    store.create_dir(plain, recursive=True)
    for name, raw in files.items():
        with store.open_output_stream(f"{plain}/{name}") as f:
            f.write(raw)


def documents(n, seed=1):
    rng = random.Random(seed)
    return [{"n": i, "at": START + dt.timedelta(minutes=i), "s": "x" * rng.randrange(200), "x": i / 2, "flag": i % 2 == 0} for i in range(n)]


def test_layout():
    doc = {"a": 1, "b": None, "c": "é\0x", "d": {"e": [1, "x", {"f": 2.5}]}, "g": True, "h": dt.datetime(2024, 1, 1, 1, 2, 3, 4000)}
    assert fields(encoded(doc)) == doc and fields(encoded(doc), frozenset("ag")) == {"a": 1, "g": True}
    assert fields(encoded({})) == {}
    assert encoded({"a": 1}).hex() == "10000000126100010000000000000000"  # as the public layout says
    with pytest.raises(ValueError):
        fields(encoded(doc)[:-1])


@pytest.mark.parametrize("every,split", [(1, 1), (300, 1000), (5000, 5000), (1 << 20, 1 << 26), (None, 100)])
def test_every_record_once(spark, every, split, monkeypatch):
    path, docs = folder(spark), documents(400)
    write(spark, path, {"a.bson": b"".join(map(encoded, docs[:250])), "b.bson": b"".join(map(encoded, docs[250:])), "c.bson": b"", "other.txt": b"no"})
    if every:
        write_dump_index(spark, path, ["n"], every)
    got = read_dump(spark, path, SCHEMA, split)
    assert sorted(map(tuple, got.collect())) == [tuple(d.values()) for d in docs]
    assert sorted(r.n for r in got.select("n").collect()) == list(range(400))
    parts = got.rdd.getNumPartitions()
    assert parts == (3 if every is None else parts) and (every != 1 or parts == 400)


def test_pushed_filters_drop_blocks(spark):
    path, docs = folder(spark), documents(400)
    write(spark, path, {"a.bson": b"".join(map(encoded, docs))})
    write_dump_index(spark, path, ["n", "at", "s"], 500)
    df = read_dump(spark, path, SCHEMA, 500)
    whole = df.rdd.getNumPartitions()
    for cond, want in (
        (F.col("n").between(100, 120), range(100, 121)), (F.col("at") < F.lit(START + dt.timedelta(minutes=30)).cast("timestamp_ntz"), range(30)),
        (F.col("n").isin(5, 399), (5, 399)), (F.col("n") > 1000, ()), ((F.col("x") < 3) & (F.col("n") >= 2), range(2, 6)),
    ):
        found = df.where(cond)
        assert sorted(r.n for r in found.collect()) == list(want)
        parts = found.rdd.getNumPartitions()
        assert parts < whole / 2 or "x" in str(cond)
    assert "PushedFilters" in df.where("n = 5")._jdf.queryExecution().executedPlan().toString() or df.where("n = 5").rdd.getNumPartitions() == 1


def test_odd_records(spark):
    path = folder(spark)
    odd = [{"n": "text", "s": 5}, {"n": 2**70 % 2**62, "x": 3, "flag": "no"}, {}, {"s": {"deep": [1]}, "n": None}, {"n": 1.5, "s": True}]
    write(spark, path, {"a.bson": b"".join(map(encoded, odd))})
    write_dump_index(spark, path, ["n", "s"])
    got = {(r.n, r.s, r.x, r.flag) for r in read_dump(spark, path, SCHEMA).collect()}
    assert got == {(None, "5", None, None), (2**70 % 2**62, None, 3.0, None), (None, None, None, None), (None, '{"deep": [1]}', None, None), (None, "true", None, None)}
    assert read_dump(spark, path, "s string").where("s = '5'").count() == 1  # a mixed field has no range
    broken = folder(spark)
    write(spark, broken, {"a.bson": encoded({"n": 1}) + encoded({"n": 2})[:-3]})
    with pytest.raises(Exception, match="cut off"):
        read_dump(spark, broken, SCHEMA).collect()
    with pytest.raises(Exception, match="no record"):
        write(spark, broken, {"a.bson": b"\1\0\0\0\0\0\0\0"})
        read_dump(spark, broken, SCHEMA).collect()
    empty = folder(spark)
    write(spark, empty, {"other.txt": b""})
    write_dump_index(spark, empty)
    assert read_dump(spark, empty, SCHEMA).count() == 0


def test_written_dump(spark):
    path, docs = folder(spark), documents(100)
    write_dump(spark.createDataFrame([tuple(d.values()) for d in docs] + [(None,) * 5], SCHEMA).repartition(3), path)
    assert sorted(map(str, read_dump(spark, path, SCHEMA).collect())) == sorted([str(r) for r in read_dump(spark, path, SCHEMA).collect()])
    assert read_dump(spark, path, SCHEMA).where("n is not null").count() == 100 and read_dump(spark, path, SCHEMA).count() == 101


def test_reader_keeps_blocks_it_cannot_judge():
    reader = DumpReader(None, "", 1)
    block = {"at": 0, "low": {"n": 5, "s": "b"}, "high": {"n": 9, "s": "d"}, "open": ["s"]}
    for test, value, want in (("=", 7, True), ("=", 4, False), ("<", 5, False), ("<=", 5, True), (">", 9, False), (">=", 9, True), ("in", (1, 9), True),
                              ("in", (1, 2), False), ("there", None, True), ("=", "x", True)):
        reader._tests = [(test, "n", value)]
        assert reader._may_hold(block, ["n", "s"]) is want
    reader._tests = [("=", "s", "z")]
    assert reader._may_hold(block, ["n", "s"])  # two kinds of values
    reader._tests = [("=", "m", 1)]
    assert not reader._may_hold(block, ["m"]) and reader._may_hold(block, ["n"])
