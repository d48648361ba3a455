"""Token ids in files of independent zstandard frames with a seek table.

A file holds whole documents in ascending doc_id order::

    frame 0, frame 1, ...          zstandard frames (with content checksum) of the ids of whole documents
    skippable frame "index"        zstandard-compressed arrays: doc_id, id count and frame number of each document
    skippable frame "seek table"   per frame: compressed size, raw size, low 32 bits of the raw XXH64
    footer                         number of frames, flags, magic

which is the seekable zstandard layout: any zstandard reader can decompress the
whole, and a reader of some documents reads footer, seek table and index, and then
decompresses only the frames that hold them, verifying their checksums. Ids are
little-endian, 2 bytes each if the vocabulary allows, else 4.

Files follow from a range-partitioned sort, one per partition; their names are unique to
the writing attempt and count only by being in the stored manifest, so lost
executors and repeated tasks leave at most unread files.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlake.llm.common import Ranges, new_file, shared_folder, ship, spark_partitions, stored, text_of

# Fixed values of the seekable zstandard format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_BYTES = 1 << 18
LEVEL = 3
#: Id that ends every document.
END_ID = 0
#: Chunks whose ids a worker keeps at most, and the longest that it keeps.
CACHE, KEPT_CHARS = 1_000_000, 64

#: A run of white space and what follows it; no match of the byte-level pre-tokenizer spans such a cut.
CHUNK = re.compile(r"\s*\S+|\s+")
#: Here Python and the tokenizer disagree on what is white space: texts with these are not cut.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")

#: Marks that a match of the pre-tokenizer never joins with a letter before it (an apostrophe would).
MARKS = frozenset(".,;:!?")

MANIFEST = "file string, documents long, tokens long, frames int, width int"


def _visible(text: str) -> str:
    """The text's UTF-8 bytes as the byte-level alphabet writes them."""
    return text.encode("utf-8").decode("latin-1").translate(_ALPHABET)


def _alphabet() -> dict[int, str]:
    """Printable Latin-1 bytes stand for themselves, the others in order for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


_ALPHABET = _alphabet()


class _Chunks(dict):
    """Ids of ``lead + word``, computed at the first use of a word; bounded."""

    def __init__(self, encode: Callable[[str], bytes], lead: str):
        super().__init__()
        self._encode, self._lead = encode, lead

    def __missing__(self, word: str) -> bytes:
        ids = self._encode(self._lead + word)
        if len(word) <= KEPT_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids
        return ids


class ByteBpe:
    """Ids of texts by a byte-level BPE file of the tokenizers library.

    The pre-tokenizer never joins a non-blank with white space after it, so a text is cut
    there and a word's ids are computed once per worker. The string of a special token in a text is
    ordinary text, or with ``specials`` that token, as in the library's own call.
    """

    def __init__(self, path: str, specials: bool = False):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = not specials
        self.width = 2 if self._tokenizer.get_vocab_size() <= 1 << 16 else 4
        self._type = "H" if self.width == 2 else "I"
        self._plain, self._spaced, self._broken = (_Chunks(self._ids, lead) for lead in ("", " ", "\n"))

    def _ids(self, text: str) -> bytes:
        word = text[1:]
        if text[:1] == " " and word.isalpha():  # one match of the pre-tokenizer: straight to its merges
            seen = ("Ġ" + word) if word.isascii() else _visible(text)
            return self._pack([t.id for t in self._tokenizer.model.tokenize(seen)])
        if text[:1] == " " and word[-1:] in MARKS and word[:-1].isalpha():  # ends before the mark
            return self._spaced[word[:-1]] + self._plain[word[-1:]]
        return self._pack(self._tokenizer.encode(text, add_special_tokens=False).ids)

    def _pack(self, ids: list[int]) -> bytes:
        return array(self._type, ids).tobytes()

    def encode(self, text: str) -> bytes:
        lines = text.split("\n")
        words = [line.split(" ") for line in lines]
        if any(c in text for c in SEPARATORS):
            return self._ids(text)
        if not all(map(all, words)) or sum(map(len, words)) != len(text.split()):  # runs of white space, or other than these
            return b"".join(map(self._plain.__getitem__, CHUNK.findall(text)))
        spaced, parts = self._spaced.__getitem__, []
        for first, (head, *rest) in enumerate(words):
            parts.append((self._broken if first else self._plain)[head])
            parts.extend(map(spaced, rest))
        return b"".join(parts)


class FrameWriter:
    """Writes documents in order into one file of seekable frames."""

    def __init__(self, out, width: int, frame_bytes: int = FRAME_BYTES):
        self._out, self._width, self._most = out, width, frame_bytes
        self._pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self._raw: list[bytes] = []
        self._size = 0
        self.frames: list[tuple[int, int, int]] = []
        self._ids: list[int] = []
        self._null: list[bool] = []
        self._counts: list[int] = []
        self._frame: list[int] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self._raw and self._size + len(ids) > self._most:
            self._flush()
        self._raw.append(ids)
        self._size += len(ids)
        count = len(ids) // self._width
        self._ids.append(doc_id or 0)
        self._null.append(doc_id is None)
        self._counts.append(count)
        self._frame.append(len(self.frames))
        self.tokens += count

    def _flush(self) -> None:
        raw = b"".join(self._raw)
        packed = self._pack.compress(raw)
        self._out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self._raw, self._size = [], 0

    def close(self) -> None:
        if self._raw:
            self._flush()
        arrays = (np.array(self._ids, "<i8"), np.array(self._null, "u1"), np.array(self._counts, "<u4"), np.array(self._frame, "<u4"))
        index = struct.pack("<II", len(self._ids), self._width) + b"".join(a.tobytes() for a in arrays)
        index = self._pack.compress(index)
        self._out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self._out.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(entries) + len(footer)) + entries + footer)


class FrameReader:
    """Reads documents of one file; only frames that hold wanted documents are read and decompressed."""

    def __init__(self, files: Ranges, name: str):
        self._files, self._name = files, name
        size = files.size(name)
        frames, flags, magic = struct.unpack("<IBI", files.read(name, size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError(f"{name}: no seek table with checksums")
        table = frames * 12
        self.frames = np.frombuffer(files.read(name, size - 9 - table, table), "<u4").reshape(-1, 3).astype(np.int64)
        self._starts = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        at = int(self._starts[-1])
        magic, length = struct.unpack("<II", files.read(name, at, 8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError(f"{name}: no document index")
        self._unpack = zstandard.ZstdDecompressor()
        index = self._unpack.decompress(files.read(name, at + 8, length))
        n, self.width = struct.unpack_from("<II", index)
        parts, at = [], 8
        for kind, wide in (("<i8", 8), ("u1", 1), ("<u4", 4), ("<u4", 4)):
            parts.append(np.frombuffer(index, kind, n, at))
            at += n * wide
        self.doc_ids, self.null, self.counts, self.frame = parts
        self.read_frames = 0

    def _raw(self, k: int) -> bytes:
        packed, size, check = (int(x) for x in self.frames[k])
        raw = self._unpack.decompress(self._files.read(self._name, int(self._starts[k]), packed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"{self._name}: frame {k} is damaged")
        self.read_frames += 1
        return raw

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, position of its first id in the file, ids) in file order; of all, or of the wanted doc_ids."""
        pick = np.ones(len(self.doc_ids), bool) if wanted is None else np.isin(self.doc_ids, np.array(list(wanted), np.int64)) & (self.null == 0)
        first = np.concatenate([[0], np.cumsum(self.counts, dtype=np.int64)])
        starts = np.searchsorted(self.frame, np.arange(len(self.frames)))
        held, raw = -1, b""
        for i in np.flatnonzero(pick):
            k = int(self.frame[i])
            if k != held:
                held, raw = k, self._raw(k)
            at = int(first[i] - first[starts[k]]) * self.width
            ids = np.frombuffer(raw, f"<u{self.width}", int(self.counts[i]), at)
            yield (None if self.null[i] else int(self.doc_ids[i])), int(first[i]), ids


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, frame_bytes: int = FRAME_BYTES, specials: bool = False) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files of ``folder``; returns the stored manifest, one row per file.

    ``specials``: strings of special tokens in a text are these tokens, as the library's default has it, else ordinary text.
    Every document's ids are followed by ``END_ID``; a null or empty text is that id alone.
    Documents are in ascending doc_id order (null first) over all files, as the
    manifest's ``first`` order gives it; rows with equal ids are ordered by the text's hash.
    Other columns are ignored. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange(spark_partitions(spark), F.col("doc_id").asc_nulls_first(), "tie")
    ranged = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        head = next((b for b in batches if b.num_rows), None)
        if head is None:
            return
        part = TaskContext.get().partitionId()
        bpe = _bpe(tokenizer, specials)
        end = np.array([END_ID], f"<u{bpe.width}").tobytes()
        with new_file(folder, f"tokens-{part:06d}", ".zst") as (name, out):
            writer = FrameWriter(out, bpe.width, frame_bytes)
            count = 0
            for batch in chain([head], batches):
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    writer.add(doc_id, bpe.encode(text.as_py()) + end)
                    count += 1
            writer.close()
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "file": name, "documents": count, "tokens": writer.tokens, "frames": len(writer.frames), "width": bpe.width}],
            pa.schema([("part", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()),
                       ("frames", pa.int32()), ("width", pa.int32())]),
        )

    return stored(ranged.mapInArrow(write, f"part int, {MANIFEST}"), "token-manifest")


_LOADED: dict[tuple[str, bool], ByteBpe] = {}


def _bpe(path: str, specials: bool) -> ByteBpe:
    """The tokenizer of this Python worker; workers serve many tasks."""
    if (path, specials) not in _LOADED:
        _LOADED[path, specials] = ByteBpe(path, specials)
    return _LOADED[path, specials]


def read_token_files(manifest: DataFrame, folder: str, doc_ids: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as 32-bit numbers).

    Files are read one per task. ``doc_ids`` (one column doc_id), a bounded list of
    requested documents, restricts reading to the frames that hold them.
    """
    spark = manifest.sparkSession
    ship(spark)
    wanted = None if doc_ids is None else sorted({r[0] for r in doc_ids.distinct().collect()})
    # offsets of the files: one row per file
    sizes = sorted((r["part"], r["file"], r["tokens"]) for r in manifest.select("part", "file", "tokens").collect())
    before = 0
    bases = []
    for _, file, tokens in sizes:
        bases.append((file, before))
        before += tokens
    files = spark.createDataFrame(bases, "file string, base long").repartition(max(1, len(bases)), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Ranges(folder)
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                for doc_id, at, ids in FrameReader(store, file).documents(wanted):
                    out["doc_id"].append(doc_id)
                    out["start"].append(base + at)
                    out["n_tokens"].append(len(ids))
                    out["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_pydict(out, pa.schema([(k, pa.int64()) for k in out]))
        store.close()

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` as token files under the shared folder and read them back, one row per document.

    Ids are those of the tokenizers library with ``add_special_tokens=False`` and no other setting.
    """
    folder = shared_folder(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, tokenizer, folder, specials=True), folder)
