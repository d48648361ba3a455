"""Byte-level BPE over overlapping chunks.

A long text is cut into overlapping chunks that are pre-tokenised in parallel, each as if the
text began there. A match of the pattern depends only on what follows its start, so where two neighbouring
chunks have a boundary in common they agree from there on: the chunks are stitched at the first
common boundary of each overlap, every chunk encodes the pieces between its two seams, and a document's ids
are its chunks' in order. A document with an overlap that holds no common boundary (one match as long as
the overlap) is pre-tokenised whole. Texts of at most one chunk stay in the scan's tasks, without a shuffle.

The pattern's character classes are the tiktoken library's: code points on which it and the regex library
differ (their Unicode tables have different ages) are read as a stand-in of the library's class.

Decoding concatenates the tokens' raw bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import uuid
from array import array
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlake.llm.common import ship, stored, text_of

#: Code points of a chunk without its overlap, and of the overlap.
CHUNK, OVERLAP = 1 << 15, 1 << 10
#: A match that ends so many code points before its chunk's end does not depend on what follows: the
#: pattern looks one code point past a match, and three past its start.
GUARD = 4
#: Pieces whose ids a worker keeps at most, and the longest that it keeps (bytes).
CACHE, KEPT_BYTES = 1 << 19, 64
#: Rows that are worked on at once.
STEP = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file (a line has the bytes in base64, and the id)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}


def class_differences(pattern: str) -> tuple[str, dict[int, int]]:
    """Code points on which the tiktoken and regex libraries differ about the pattern's classes, as a regex set (empty
    if there are none), and for each a code point of the same classes on which they agree."""
    import tiktoken

    every = "".join(map(chr, chain_points()))
    single = {bytes([i]): i for i in range(256)}
    theirs, mine = ({c: 0 for c in every} for _ in range(2))
    for bit, name in enumerate(sorted(set(re.findall(r"\\[pP]\{\w+\}|\\[swd]", pattern)))):
        library = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        for c in bytes(library.encode_ordinary(every)).decode("utf-8"):
            theirs[c] |= 1 << bit
        for c in regex.findall(name, every):
            mine[c] |= 1 << bit
    stand_in = {theirs[c]: c for c in every if theirs[c] == mine[c]}  # the last of each kind: none that a pattern names
    swap = {ord(c): ord(stand_in[theirs[c]]) for c in every if theirs[c] != mine[c]}
    points = np.array(sorted(swap))
    runs = np.split(points, np.flatnonzero(np.diff(points) > 1) + 1) if len(points) else []
    return "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs), swap


def chain_points() -> Iterator[int]:
    """All code points that a text can hold."""
    yield from range(0xD800)
    yield from range(0xE000, 0x110000)


class PreTokens:
    """Matches of a pattern, which must tile every text."""

    def __init__(self, pattern: str, odd: str, swap: dict[int, int]):
        self._find = regex.compile(pattern).findall
        self._odd = re.compile(f"[{odd}]").search if odd else None
        self._swap = swap

    def lengths(self, text: str) -> np.ndarray:
        plain = text.isascii() or self._odd is None or not self._odd(text)
        found = self._find(text if plain else text.translate(self._swap))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        if sizes.sum() != len(text):
            raise ValueError("the pattern leaves a part of a text out")
        return sizes

    def pieces(self, text: str) -> list[str]:
        if text.isascii() or self._odd is None or not self._odd(text):
            found = self._find(text)
            if sum(map(len, found)) != len(text):
                raise ValueError("the pattern leaves a part of a text out")
            return found
        return cut(text, self.lengths(text))


def cut(text: str, sizes: np.ndarray) -> list[str]:
    ends = np.cumsum(sizes).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


class Merges(dict):
    """Ids of a piece by the merge ranks, as packed 32-bit integers; kept, up to a bound, from the first use on."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        if any(bytes([i]) not in ranks for i in range(256)):
            raise ValueError("the ranks have no token for some byte")
        self._ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        own = self._ranks.get(raw)
        ids = array("I", self.merged(raw) if own is None else [own]).tobytes()
        if len(raw) <= KEPT_BYTES:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids

    def merged(self, raw: bytes) -> list[int]:
        """Join the neighbours of the lowest rank, leftmost first, until no pair is a token; n log n in the piece's bytes."""
        rank, n = self._ranks.get, len(raw)
        end = list(range(1, n + 1))  # of the part that starts at an index
        before = list(range(-1, n - 1))  # start of the part before
        alive = [True] * n
        waiting = [(r, i, i + 2) for i in range(n - 1) if (r := rank(raw[i : i + 2])) is not None]
        heapq.heapify(waiting)
        while waiting:
            _, a, c = heapq.heappop(waiting)
            b = end[a]
            if not alive[a] or b >= c or end[b] != c:
                continue  # one of the two has grown
            end[a], alive[b] = c, False
            if c < n:
                before[c] = a
                if (r := rank(raw[a : end[c]])) is not None:
                    heapq.heappush(waiting, (r, a, end[c]))
            p = before[a]
            if p >= 0 and (r := rank(raw[p:c])) is not None:
                heapq.heappush(waiting, (r, p, c))
        return [self._ranks[raw[i : end[i]]] for i in compress(range(n), alive)]

    def encode(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, pieces))


class Vocabulary:
    """What the encoding tasks need: pre-tokens and merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, odd: str, swap: dict[int, int]):
        self.pre, self.merges = PreTokens(pattern, odd, swap), Merges(ranks)

    def encode(self, text: str) -> bytes:
        return self.merges.encode(self.pre.pieces(text))


_LOADED: dict[str, Vocabulary] = {}
_DIFFERENCES: dict[str, tuple[str, dict[int, int]]] = {}


class _Told:
    """A vocabulary by broadcast; loaded once per worker. Its size is bounded by the rank file's."""

    def __init__(self, docs: DataFrame, path: str, pattern: str):
        ship(docs.sparkSession)
        if pattern not in _DIFFERENCES:
            _DIFFERENCES[pattern] = class_differences(pattern)
        with open(path, "rb") as f:
            self.key = hashlib.sha256(f.read() + pattern.encode("utf-8")).hexdigest()
        self._sent = docs.sparkSession.sparkContext.broadcast((read_ranks(path), pattern, *_DIFFERENCES[pattern]))

    def __call__(self) -> Vocabulary:
        if self.key not in _LOADED:
            _LOADED[self.key] = Vocabulary(*self._sent.value)
        return _LOADED[self.key]


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, STEP):
        yield batch.slice(a, STEP)


def _whole(texts: DataFrame, told: _Told) -> DataFrame:
    """``texts`` with ``ids`` for ``text``, pre-tokenised as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = told()
        for batch in (b for whole in batches for b in _steps(whole)):
            ids = [vocabulary.encode(t.as_py()) for t in batch.column("text")]
            others = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in others], pa.array(ids, pa.binary())], names=[*others, "ids"])

    others = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
    return texts.mapInArrow(run, f"{others}, ids binary")


def _slices(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row, doc_id, chunk, last, start, text): overlapping chunks, under one new ``row`` name a document.

    A document's chunks come from one task into one file, so all have the same name whichever attempt is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, row = batch.column("text")[i].as_py(), uuid.uuid4().hex
                starts = list(range(0, max(len(text), 1), chunk))
                for a in range(0, len(starts), STEP):
                    part = starts[a : a + STEP]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([row] * len(part)), batch.column("doc_id").take(pa.array([i] * len(part))),
                        pa.array([s // chunk for s in part], pa.int64()), pa.array([s == starts[-1] for s in part]),
                        pa.array(part, pa.int64()), pa.array([text[s : s + chunk + overlap] for s in part], pa.string()),
                    ], names=["row", "doc_id", "chunk", "last", "start", "text"])

    kind = long.schema["doc_id"].dataType.simpleString()
    return stored(long.mapInArrow(run, f"row string, doc_id {kind}, chunk long, last boolean, start long, text string"), "bpe-slices")


def _pretokens(slices: DataFrame, told: _Told, chunk: int, overlap: int) -> DataFrame:
    """The slices with ``sizes`` (of the pieces, packed) and the boundaries in the overlaps with the chunk before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = told().pre
        for batch in (b for whole in batches for b in _steps(whole)):
            sizes, head, tail = [], [], []
            for text, start, last in zip(*(batch.column(n).to_pylist() for n in ("text", "start", "last")), strict=True):
                size = pre.lengths(text)
                at = np.concatenate([[0], np.cumsum(size)])
                safe = at if last else at[at <= len(text) - GUARD]
                sizes.append(size.astype("<u4").tobytes())
                head.append(start + safe[safe < overlap])
                tail.append(start + safe[safe >= chunk])
            lists = pa.list_(pa.int64())
            columns = [*batch.columns, pa.array(sizes, pa.binary()), pa.array(head, lists), pa.array(tail, lists)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "sizes", "head", "tail"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slices.schema)
    spread = slices.repartition(F.col("row"), F.col("chunk"))
    return stored(spread.mapInArrow(run, f"{schema}, sizes binary, head array<long>, tail array<long>"), "bpe-pretokens")


def _encoded(parts: DataFrame, told: _Told) -> DataFrame:
    """(row, doc_id, chunk, ids): each chunk's pieces from its seam ``seam`` to the next one, ``until`` (null: the end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = told().merges
        for batch in (b for whole in batches for b in _steps(whole)):
            ids = []
            for text, start, sizes, seam, until in zip(*(batch.column(n).to_pylist() for n in ("text", "start", "sizes", "seam", "until")), strict=True):
                size = np.frombuffer(sizes, "<u4").astype(np.int64)
                at = start + np.concatenate([[0], np.cumsum(size)])
                a = np.searchsorted(at, seam)
                b = len(size) if until is None else np.searchsorted(at, until)
                ids.append(merges.encode(cut(text[at[a] - start : at[b] - start], size[a:b])))
            columns = [batch.column(n) for n in ("row", "doc_id", "chunk")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], names=["row", "doc_id", "chunk", "ids"])

    kind = parts.schema["doc_id"].dataType.simpleString()
    return parts.mapInArrow(run, f"row string, doc_id {kind}, chunk long, ids binary")


def _long_ids(long: DataFrame, told: _Told, chunk: int, overlap: int) -> DataFrame:
    slices = _slices(long, chunk, overlap)
    pre = _pretokens(slices, told, chunk, overlap)
    # the first boundary that a chunk and the one before it have in common
    before = pre.where(~F.col("last")).select("row", (F.col("chunk") + 1).alias("chunk"), F.col("tail").alias("theirs"))
    seams = before.join(pre.select("row", "chunk", "head"), ["row", "chunk"]).select(
        "row", "chunk", F.array_min(F.array_intersect("theirs", "head")).alias("seam"))
    seams = stored(seams, "bpe-seams")
    apart = seams.where("seam is null").select("row").distinct()
    named = seams.unionByName(pre.where("chunk = 0").select("row", "chunk", F.lit(0).cast("long").alias("seam")))
    nexts = seams.select("row", (F.col("chunk") - 1).alias("chunk"), F.col("seam").alias("until"))
    ranges = named.join(nexts, ["row", "chunk"], "left").join(apart, "row", "left_anti")
    parts = _encoded(pre.drop("head", "tail", "last").join(ranges, ["row", "chunk"]), told)
    # a document's chunks: as many as its own text has
    ordered = F.array_sort(F.collect_list(F.struct("chunk", F.hex("ids").alias("part"))))
    stitched = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), ordered.alias("parts")).select(
        "doc_id", F.unhex(F.array_join(F.col("parts.part"), "")).alias("ids"))
    texts = F.array_sort(F.collect_list(F.struct("chunk", F.substring("text", 1, chunk).alias("part"))))
    rest = slices.join(apart, "row").groupBy("row").agg(F.first("doc_id").alias("doc_id"), texts.alias("parts"))
    return stitched.unionByName(_whole(rest.select("doc_id", F.array_join(F.col("parts.part"), "").alias("text")), told))


def encode_texts(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row (doc_id, ids) per row of ``docs`` (doc_id, text); ids are packed little-endian unsigned 32-bit integers.

    Every match of ``pattern`` in the whole text is encoded by itself with the ranks of the file ``path``, without special
    tokens; their strings are ordinary text. Null counts as empty, an empty text has no ids. Repeated rows give
    repeated results, a null doc_id stays null, other columns are ignored, and an empty table gives no rows.
    Texts of over ``chunk`` code points go through the stored tables of their chunks.
    """
    if not GUARD < overlap <= chunk:
        raise ValueError("an overlap is longer than the guard, and no longer than a chunk")
    told = _Told(docs, path, pattern)
    rows = docs.select("doc_id", text_of().alias("text"))
    short = _whole(rows.where(F.length("text") <= chunk), told)
    return short.unionByName(_long_ids(rows.where(F.length("text") > chunk), told, chunk, overlap))


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (with packed ``ids``) and the bytes ``decoded``: the tokens' own, one after the other. Null ids are none."""
    ship(encoded.sparkSession)
    sent = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))  # bounded by the file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = {i: b for b, i in sent.value.items()}.__getitem__
        for batch in (b for whole in batches for b in _steps(whole)):
            ids = (np.frombuffer(i.as_py() or b"", "<u4").tolist() for i in batch.column("ids"))
            decoded = [b"".join(map(raw, i)) for i in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=[*batch.schema.names, "decoded"])

    rows = encoded.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, decoded binary")
