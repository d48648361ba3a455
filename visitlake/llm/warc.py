"""WARC archives with a two-level capture index.

Archives: one gzip member per record; of records with equal payloads one is a response and the
others are revisits that refer to it. Index: captures sorted by reversed-host URL key, cut into
compressed blocks of ``BLOCK_LINES`` lines; a sparse directory holds each block's first key and place.
A lookup finds the index shard by its key range, binary-searches the shard's directory,
reads and decompresses the block by a range read, and then range-reads the records.

One archive or index shard per task; names are unique to the writing attempt and count
only by being in the stored result. A key with any number of captures spans shards, since the sort is by
(key, page_id).
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlake.llm.common import Ranges, new_file, shared_folder, ship, spark_partitions, split_join, stored, text_of

BLOCK_LINES = 3000
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"

CAPTURE = "surt string, page_id long, file string, at long, length long"
SHARD = "part int, blocks string, directory string, first string, last string, captures long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def surt(url: str | None) -> str:
    """The URL's key: host labels reversed, then port, path and query; scheme, user and fragment are left out."""
    try:
        parts = urlsplit(url or "")
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return quote(url or "", safe="/:?=&%+,;@~!$*()[]'")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")"
    key += (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return quote(key, safe="/:?=&%+,;@~!$*()[]'")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<{URN}{'' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    text = name.strip("<>").removeprefix(URN)
    return int(text) if text else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit holds the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "", safe="/:?#=&%+,;@~!$*()[]'")),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        *([("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", REVISIT_PROFILE)] if revisit else []),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def parse(member: bytes) -> dict:
    """The record of one gzip member; a response's digest is checked against its payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("no whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
    named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or digest(payload) != named):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    return {
        "page_id": _page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": named,
        "record_type": fields["WARC-Type"], "refers_to": _page(fields["WARC-Refers-To"]) if revisit else None, "payload": payload,
    }


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_CAPTURE = pa.schema([("surt", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("length", pa.int64())])
_SHARD = pa.schema([("part", pa.int32()), ("blocks", pa.string()), ("directory", pa.string()), ("first", pa.string()), ("last", pa.string()), ("captures", pa.int64())])
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives of ``folder``; the stored captures, one row per record.

    Of equal payloads of at least ``least`` bytes the largest page_id is the response (null lowest; rows
    that repeat that page_id are responses too), the others revisit it; null html counts as empty.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    rows = rows.withColumn("payload", F.unhex(F.sha2("html", 256)))
    groups = stored(
        rows.where(F.octet_length("html") >= least).groupBy("payload").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("top")).where("n > 1"),
        "warc-payloads",
    )
    total = int(groups.agg(F.sum("n")).first()[0] or 0)
    told = split_join(rows, groups, "payload", "n", total, F.struct("page_id", "url"))
    top = F.col("group.top")
    told = told.select("page_id", "url", "html", F.when(F.col("group").isNotNull() & ~F.col("page_id").eqNullSafe(top), top).alias("refers_to"),
                       (F.col("group").isNotNull() & ~F.col("page_id").eqNullSafe(top)).alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        out: list[dict] = []
        with new_file(folder, f"archive-{TaskContext.get().partitionId():06d}", ".warc.gz") as (name, stream):
            at = 0
            for batch in chain([first], batches):
                for row in range(batch.num_rows):
                    page_id, url, html, refers_to, revisit = (batch.column(c)[row].as_py() for c in ("page_id", "url", "html", "refers_to", "revisit"))
                    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = pack.compress(record(page_id, url, html.encode("utf-8"), refers_to, revisit)) + pack.flush()
                    stream.write(member)
                    out.append({"surt": surt(url), "page_id": page_id, "file": name, "at": at, "length": len(member)})
                    at += len(member)
        for a in range(0, len(out), 10_000):
            yield _table(out[a : a + 10_000], _CAPTURE)

    return stored(told.mapInArrow(write, CAPTURE), "warc-captures")


def write_index(captures: DataFrame, folder: str, lines: int = BLOCK_LINES) -> DataFrame:
    """Sort the captures by key into index shards of ``folder``; the stored list of shards, in key order by ``part``."""
    spark = captures.sparkSession
    ship(spark)
    ordered = captures.repartitionByRange(spark_partitions(spark), "surt", "page_id").sortWithinPartitions("surt", "page_id", "file", "at")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        head = next((b for b in batches if b.num_rows), None)
        if head is None:
            return
        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        state = {"at": 0, "n": 0, "first": None, "last": None}
        with new_file(folder, f"index-{part:06d}", ".cdx.gz") as (blocks, out), new_file(folder, f"index-{part:06d}", ".idx") as (directory, sparse):

            def flush() -> None:
                text = "".join("\t".join("" if v is None else str(v) for v in r) + "\n" for r in held)
                pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                block = pack.compress(text.encode()) + pack.flush()
                out.write(block)
                sparse.write(f"{held[0][0]}\t{state['at']}\t{len(block)}\n".encode())
                state["at"] += len(block)
                state["n"] += len(held)
                state["first"] = held[0][0] if state["first"] is None else state["first"]
                state["last"] = held[-1][0]
                held.clear()

            for batch in chain([head], batches):
                for r in zip(*(batch.column(c).to_pylist() for c in _CAPTURE.names), strict=True):
                    held.append(r)
                    if len(held) == lines:
                        flush()
            if held:
                flush()
        yield _table([{"part": part, "blocks": blocks, "directory": directory, "first": state["first"], "last": state["last"], "captures": state["n"]}], _SHARD)

    return stored(ordered.mapInArrow(write, SHARD), "warc-shards")


class CaptureIndex:
    """Lookups in one index shard: binary search of the directory, then a range read of the block."""

    def __init__(self, files: Ranges, blocks: str, directory: str):
        self._files, self._blocks = files, blocks
        text = files.read(directory, 0, files.size(directory)).decode()
        entries = [x.rsplit("\t", 2) for x in text.splitlines()]
        self._first = [e[0].encode() for e in entries]
        self._place = [(int(e[1]), int(e[2])) for e in entries]
        self._held, self._lines = -1, []
        self.blocks_read = 0

    def _block(self, k: int) -> list[list[str]]:
        if k != self._held:
            text = zlib.decompress(self._files.read(self._blocks, *self._place[k]), 31).decode()
            self._held, self._lines = k, [x.split("\t") for x in text.split("\n")[:-1]]
            self._keys = [x[0].encode() for x in self._lines]
            self.blocks_read += 1
        return self._lines

    def lookup(self, key: str) -> Iterator[dict]:
        raw = key.encode()
        k = max(0, bisect_left(self._first, raw) - 1)
        while k < len(self._first) and self._first[k] <= raw:
            lines = self._block(k)
            for s, page_id, file, at, length in lines[bisect_left(self._keys, raw) : bisect_right(self._keys, raw)]:
                yield {"surt": s, "page_id": int(page_id) if page_id else None, "file": file, "at": int(at), "length": int(length)}
            k += 1


def lookup(urls: DataFrame, shards: DataFrame, folder: str) -> DataFrame:
    """Captures of the URLs (column url; repeated and equivalent URLs count once) by the index of ``folder``."""
    spark = urls.sparkSession
    ship(spark)
    # one row per index shard
    known = sorted((r["part"], r["first"], r["last"], r["blocks"], r["directory"]) for r in shards.collect())
    ends = ([x[1].encode() for x in known], [x[2].encode() for x in known])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in batch.column("url").to_pylist()], pa.string())], names=["key"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"shard": [], "key": []}
            for key in batch.column("key").to_pylist():
                raw = key.encode()
                for i in range(bisect_left(ends[1], raw), bisect_right(ends[0], raw)):
                    out["shard"].append(i)
                    out["key"].append(key)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("shard", pa.int32()), ("key", pa.string())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at, index = Ranges(folder), None, None
        for batch in batches:
            out: list[dict] = []
            for shard, key in zip(batch.column("shard").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if shard != at:
                    at, index = shard, CaptureIndex(files, known[shard][3], known[shard][4])
                out.extend(index.lookup(key))
            yield _table(out, _CAPTURE)
        files.close()

    distinct = urls.select("url").mapInArrow(keys, "key string").distinct()
    placed = distinct.mapInArrow(place, "shard int, key string")
    dealt = placed.repartition(max(1, len(known)), "shard").sortWithinPartitions("shard", "key")
    return dealt.mapInArrow(find, CAPTURE)


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """The records of the captures, read from the archives of ``folder`` by range reads, file by file."""
    ship(captures.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Ranges(folder)
        for batch in batches:
            places = zip(*(batch.column(c).to_pylist() for c in ("file", "at", "length")), strict=True)
            yield _table([{k: v for k, v in parse(files.read(*p)).items() if k != "payload"} for p in places], _RECORD)
        files.close()

    dealt = captures.repartition(spark_partitions(captures.sparkSession), "file").sortWithinPartitions("file", "at")
    return dealt.select("file", "at", "length").mapInArrow(read, RECORD)


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` as archives with their index, look every page's URL up and read the records back.

    One row per row of ``pages``: page_id, url, payload_bytes, payload_digest, record_type, refers_to. Repeated
    rows are records of their own; null URLs share the empty key; other columns are ignored; an empty table gives no rows.
    """
    folder = shared_folder(pages.sparkSession, "warc")
    shards = write_index(write_archives(pages, folder, least), folder)
    return read_records(lookup(pages.select(F.col("url").cast("string").alias("url")), shards, folder), folder)
