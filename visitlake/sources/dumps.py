"""Dumps of document collections: files of length-prefixed binary records, as a splittable Spark data source.

A dump file is a sequence of documents in the public BSON layout, each beginning with its own length, so it can only be read from a
known record start. ``write_dump_index`` walks over the files once, hopping from length to length, and writes a sparse index beside
them: every ``every`` bytes the offset of a record, and for chosen top-level fields the least and greatest value of the block up to the next offset.
The source ``document_dump`` then

* makes partitions of whole blocks, of about ``splitBytes`` each (a file without index is one partition);
* drops blocks whose value ranges can't meet the filters that Spark pushes (=, <, <=, >, >=, IN, IS NOT NULL on indexed fields); Spark still
  applies the filters to the rows;
* decodes only the fields of the schema, record by record, and skips the others by their sizes.

Values that don't have the field's type are null. Files are opened through pyarrow's file systems, from tasks too, so they must lie on a
path that all executors see. A record that is cut off or malformed raises.
"""

from __future__ import annotations

import datetime as dt
import json
import struct
import sys
from collections.abc import Iterator, Sequence
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)
from pyspark.sql.pandas.types import to_arrow_schema

FORMAT, INDEX_SUFFIX = "document_dump", ".index.json"
DEFAULT_EVERY, DEFAULT_SPLIT = 1 << 20, 64 << 20
#: Rows of an Arrow batch, and bytes that are read at once.
BATCH, READ = 4096, 1 << 22

# Fixed values of the layout: element types by number. Sizes of those without a length of their own, in bytes.
_FIXED = {0x01: 8, 0x06: 0, 0x07: 12, 0x08: 1, 0x09: 8, 0x0A: 0, 0x10: 4, 0x11: 8, 0x12: 8, 0x13: 16, 0x7F: 0, 0xFF: 0}
_EPOCH = dt.datetime(1970, 1, 1)


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _size(kind: int, raw: bytes, at: int) -> int:
    """Bytes of the value of an element at ``at``."""
    if kind in _FIXED:
        return _FIXED[kind]
    if kind in (0x02, 0x0D, 0x0E):
        return 4 + struct.unpack_from("<i", raw, at)[0]
    if kind in (0x03, 0x04, 0x0F):
        return struct.unpack_from("<i", raw, at)[0]
    if kind == 0x05:
        return 5 + struct.unpack_from("<i", raw, at)[0]
    if kind == 0x0B:  # two strings, each up to a zero byte
        return raw.index(0, raw.index(0, at) + 1) + 1 - at
    raise ValueError(f"element type 0x{kind:02x} is not supported")


def _value(kind: int, raw: bytes, at: int, size: int):
    if kind == 0x01:
        return struct.unpack_from("<d", raw, at)[0]
    if kind == 0x02:
        return raw[at + 4 : at + size - 1].decode("utf-8")
    if kind in (0x03, 0x04):
        inner = fields(raw[at : at + size])
        return inner if kind == 0x03 else list(inner.values())
    if kind == 0x07:
        return raw[at : at + 12].hex()
    if kind == 0x08:
        return raw[at] == 1
    if kind == 0x09:
        return _EPOCH + dt.timedelta(milliseconds=struct.unpack_from("<q", raw, at)[0])
    if kind == 0x10:
        return struct.unpack_from("<i", raw, at)[0]
    if kind in (0x11, 0x12):
        return struct.unpack_from("<q", raw, at)[0]
    return None


def fields(record: bytes, wanted: frozenset[str] | None = None) -> dict[str, object]:
    """The values of a record's top-level fields, all or the ``wanted`` ones; the last of fields with one name."""
    out, at, end = {}, 4, len(record) - 1
    if end < 4 or record[end]:
        raise ValueError("a record does not end with a zero byte")
    while at < end:
        kind = record[at]
        stop = record.index(0, at + 1)
        name = record[at + 1 : stop].decode("utf-8")
        at = stop + 1
        size = _size(kind, record, at)
        if at + size > end:
            raise ValueError("a field reaches beyond its record")
        if wanted is None or name in wanted:
            out[name] = _value(kind, record, at, size)
        at += size
    return out


def records(store, path: str, start: int, stop: int | None) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the records that begin in [start, stop)."""
    with store.open_input_file(path) as f:
        whole = f.size()
        held, at, base = b"", 0, start
        stop = whole if stop is None else min(stop, whole)
        while base + at < stop:
            if len(held) - at < 4 or len(held) - at < struct.unpack_from("<i", held, at)[0]:
                need = 4 if len(held) - at < 4 else struct.unpack_from("<i", held, at)[0]
                base, held, at = base + at, held[at:], 0
                more = f.read_at(max(READ, need), base + len(held)) if base + len(held) < whole else b""
                held += more
                if len(held) < 4 or len(held) < struct.unpack_from("<i", held, 0)[0]:
                    if not more:
                        raise ValueError(f"{path}: the record at {base} is cut off")
                    continue
            n = struct.unpack_from("<i", held, at)[0]
            if n < 5:
                raise ValueError(f"{path}: no record at {base + at}")
            yield base + at, held[at : at + n]
            at += n


def dump_files(path: str) -> list[str]:
    """The dump files (``*.bson``) of a folder, or the file itself, with the path's own scheme."""
    from pyarrow import fs

    store, plain = file_system(path)
    prefix = path[: len(path) - len(plain)] if path.endswith(plain) else ""
    info = store.get_file_info(plain)
    if info.type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(plain, recursive=True))
    return sorted(prefix + i.path for i in found if i.type == fs.FileType.File and PurePosixPath(i.path).suffix == ".bson")


def _plain(value):
    """What an index keeps of a value, so that it can be ordered in JSON; None if it has no such form."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, dt.datetime):
        return value.isoformat(timespec="microseconds")
    return value if isinstance(value, (int, float, str)) and value == value else None


def write_dump_index(spark: SparkSession, path: str, on: Sequence[str] = (), every: int = DEFAULT_EVERY) -> None:
    """Write the sparse index of every dump file under ``path``; one task a file. ``on``: fields whose ranges are kept."""
    files = dump_files(path)
    wanted = frozenset(on)

    def index(paths: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in paths:
            for file in batch.column("file").to_pylist():
                store, plain = file_system(file)
                blocks: list[dict] = []
                for offset, record in records(store, plain, 0, None):
                    if not blocks or offset - blocks[-1]["at"] >= every:
                        blocks.append({"at": offset, "low": {}, "high": {}, "open": []})
                    block = blocks[-1]
                    for name, value in fields(record, wanted).items() if wanted else ():
                        kept = _plain(value)
                        if kept is None:
                            continue
                        low = block["low"].get(name)
                        if low is not None and isinstance(low, str) != isinstance(kept, str):
                            block["open"].append(name)  # two kinds of values have no range
                            continue
                        block["low"][name] = kept if low is None else min(low, kept)
                        block["high"][name] = kept if low is None else max(block["high"][name], kept)
                with store.open_output_stream(plain + INDEX_SUFFIX) as out:
                    out.write(json.dumps({"on": sorted(wanted), "blocks": blocks}).encode("utf-8"))
                yield pa.RecordBatch.from_pylist([{"file": file, "blocks": len(blocks)}])

    if files:
        frame = spark.createDataFrame([(f,) for f in files], "file string").repartition(len(files))
        frame.mapInArrow(index, "file string, blocks long").collect()  # one row a file


class _Blocks(InputPartition):
    def __init__(self, file: str, start: int, stop: int | None):
        self.file, self.start, self.stop = file, start, stop


class DumpReader(DataSourceReader):
    def __init__(self, schema: T.StructType, path: str, split: int):
        self._schema, self._path, self._split = schema, path, split
        self._tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take what block ranges can answer; Spark applies every filter to the rows itself."""
        names = {EqualTo: "=", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">=", In: "in", IsNotNull: "there"}
        for f in filters:
            if type(f) in names and len(f.attribute) == 1:
                self._tests.append((names[type(f)], f.attribute[0], getattr(f, "value", None)))
            yield f

    def _may_hold(self, block: dict, on: list[str]) -> bool:
        for test, name, value in self._tests:
            if name not in on or name in block["open"]:
                continue
            low, high = block["low"].get(name), block["high"].get(name)
            if low is None:
                return False  # every test needs a value
            values = [_plain(v) for v in value] if test == "in" else [_plain(value)]
            if test == "there" or any(v is None or isinstance(v, str) != isinstance(low, str) for v in values):
                continue
            if test in ("=", "in") and not any(low <= v <= high for v in values):
                return False
            v = values[0]
            if (test == "<" and not low < v) or (test == "<=" and not low <= v) or (test == ">" and not high > v) or (test == ">=" and not high >= v):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        out: list[InputPartition] = []
        for file in dump_files(self._path):
            store, plain = file_system(file)
            if store.get_file_info(plain + INDEX_SUFFIX).type != fs.FileType.File:
                out.append(_Blocks(file, 0, None))
                continue
            with store.open_input_stream(plain + INDEX_SUFFIX) as f:
                index = json.loads(f.read())
            start = None
            for block, end in zip(index["blocks"], [b["at"] for b in index["blocks"][1:]] + [None]):
                holds = self._may_hold(block, index["on"])
                if start is not None and (not holds or block["at"] - start >= self._split):
                    out.append(_Blocks(file, start, block["at"]))
                    start = None
                if holds and start is None:
                    start = block["at"]
                if end is None and start is not None:
                    out.append(_Blocks(file, start, None))
        return out or [_Blocks("", 0, 0)]

    def read(self, partition: _Blocks) -> Iterator[pa.RecordBatch]:
        schema, wanted = to_arrow_schema(self._schema), frozenset(self._schema.names)
        rows: list[dict] = []
        if partition.file:
            store, plain = file_system(partition.file)
            for _, record in records(store, plain, partition.start, partition.stop):
                rows.append(fields(record, wanted))
                if len(rows) >= BATCH:
                    yield _batch(rows, schema)
                    rows = []
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([_as(r.get(f.name), f.type) for r in rows], f.type) for f in schema], schema=schema)


def _as(value, kind: pa.DataType):
    """The value if it has the column's type (whole numbers as fractions too, anything as text), else null."""
    if value is None:
        return None
    if pa.types.is_string(kind):
        if isinstance(value, dt.datetime):
            return value.isoformat(timespec="milliseconds") + "Z"
        return value if isinstance(value, str) else json.dumps(value, default=str)
    if pa.types.is_boolean(kind):
        return value if isinstance(value, bool) else None
    if pa.types.is_integer(kind):
        return value if isinstance(value, int) and not isinstance(value, bool) and -(1 << kind.bit_width - 1) <= value < 1 << kind.bit_width - 1 else None
    if pa.types.is_floating(kind):
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    if pa.types.is_timestamp(kind):
        return value if isinstance(value, dt.datetime) else None
    return None


class DocumentDump(DataSource):
    """Options: ``path``, ``splitBytes``. The schema must be given; nested values can be read as text (JSON)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return DumpReader(schema, self.options["path"], int(self.options.get("splitbytes", DEFAULT_SPLIT)))


def read_dump(spark: SparkSession, path: str, schema: T.StructType | str, split_bytes: int = DEFAULT_SPLIT) -> DataFrame:
    """The records under ``path`` with ``schema``."""
    spark.dataSource.register(DocumentDump)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).schema(schema).option("splitBytes", split_bytes).load(path)


def encoded(document: dict) -> bytes:
    """A document in the layout: None, bool, int (64 bits), float, str, datetime (UTC), dict and list values."""
    parts = []
    for name, value in document.items():
        key = name.encode("utf-8") + b"\0"
        if value is None:
            parts.append(b"\x0a" + key)
        elif isinstance(value, bool):
            parts.append(b"\x08" + key + bytes([value]))
        elif isinstance(value, int):
            parts.append(b"\x12" + key + struct.pack("<q", value))
        elif isinstance(value, float):
            parts.append(b"\x01" + key + struct.pack("<d", value))
        elif isinstance(value, str):
            raw = value.encode("utf-8") + b"\0"
            parts.append(b"\x02" + key + struct.pack("<i", len(raw)) + raw)
        elif isinstance(value, dt.datetime):
            parts.append(b"\x09" + key + struct.pack("<q", (value - _EPOCH) // dt.timedelta(milliseconds=1)))
        elif isinstance(value, dict):
            parts.append(b"\x03" + key + encoded(value))
        elif isinstance(value, list):
            parts.append(b"\x04" + key + encoded({str(i): v for i, v in enumerate(value)}))
        else:
            raise TypeError(f"no form for {type(value)}")
    body = b"".join(parts) + b"\0"
    return struct.pack("<i", len(body) + 4) + body


def write_dump(df: DataFrame, path: str) -> None:
    """Write the rows as dump files, one a partition; null fields are left out. Names are new, and a retried task's file replaces its own."""
    folder = path.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, plain = file_system(folder)
        store.create_dir(plain, recursive=True)
        part, n = TaskContext.get().partitionId(), 0
        with store.open_output_stream(f"{plain}/part-{part:05d}.bson") as out:
            for batch in batches:
                for row in batch.to_pylist():
                    out.write(encoded({k: v for k, v in row.items() if v is not None}))
                    n += 1
        yield pa.RecordBatch.from_pylist([{"part": part, "records": n}])

    df.mapInArrow(write, "part long, records long").collect()  # one row a partition


# Tasks and Spark's planning worker get this module by value: they need not find the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
