"""Scores of a Brown class-based bigram model.

Each word belongs to one class; the probability of a word after another is that of its class after
the other's class times that of the word within its class, both smoothed. Every word that the training
texts hold ``LEAST`` times or more is assigned by exchange clustering: from the class of its frequency rank modulo
``CLASSES``, each word moves to the class that raises the likelihood of the class bigrams most; every
round half of the words (by their rank's hash) move against the others' classes. Rarer words, and unseen ones, belong to one of
``ENDINGS`` classes by their last two bytes, so every word has a class without a lookup.

Counts cover all training texts and all pairs of neighbours. The ranks of the frequent words, the head, go to the tasks: those
that make up one in ``SHARE`` tokens or more, so there are at most ``SHARE``. The other words, however many there are, meet
their pairs and their documents in joins by hash, where none of them is frequent. What is in the head changes no result.

The pairs are turned, once, into neighbour lists: words are dealt into buckets by their rank, and a bucket's packed lists lie
together, split by the neighbour's group of buckets. A pass reads the lists where they lie, names the neighbours by
the class file of their group (16 MB at most in a task), and adds up the words' counts beside each class; only these
sums travel, by bucket, to where the words choose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as dataset
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlake.llm.common import TEXTS, _filesystem, lean, ship, shared_folder, slices, spark_partitions, stored, text_of
from visitlake.llm.wordhash import blank_class, blocks, mix, word_hashes

CLASSES, ENDINGS, ROUNDS = 32, 64, 6
#: A word that the training texts hold so often is clustered.
LEAST = 3
#: Words that make up at least one in SHARE of the training tokens (at most SHARE words, 21 bytes each) go to the tasks.
SHARE = 1 << 24
GROUPS = CLASSES + ENDINGS + 1
END_CLASS = GROUPS - 1
END = np.uint64(0xE703_7ED1_A0B4_28DB)
#: Words of a bucket, and buckets of a group.
BUCKET, SPAN = 1 << 13, 1 << 11
#: A neighbour in a list: an ending class, or PLACED + its place in its group. A code of a pair: a rank, or -1 - ending class, or
#: from OPEN down a word by 62 bits of its hash.
PLACED, OPEN = 1 << 7, -(1 << 62)
#: Bits of a neighbour in an entry of a list: side, word's place in its bucket, neighbour.
CODE = 25
#: Entries of one step of the choice, entries that are added up at once.
STEP, ENTRIES = 1 << 13, 1 << 20
#: Counts below this are looked up in the choice.
COMMON = 1 << 6
#: Tokens whose words, and whose pairs, are counted at once.
COUNTED, PAIRED = 1 << 20, 1 << 19
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def tokens(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """Per slice of the texts: token hashes, their ending classes (offset CLASSES), text numbers, slice bounds.

    A text's tokens are its words (ASCII letters lower-cased) and one end.
    """
    raw = [t.encode("utf-8").translate(_LOWER) for t in texts]
    for a, b in blocks(raw):
        value, start, end, which = word_hashes(raw[a:b], blank_class())
        buffer = np.frombuffer(b" ".join(raw[a:b]) + b" ", np.uint8)
        last = buffer[end - 1].astype(np.int64)
        before = np.where(end - start > 1, buffer[np.maximum(end - 2, 0)], 0)
        group = CLASSES + (last * 31 + before) % ENDINGS
        cuts = np.searchsorted(which, np.arange(b - a), side="right")
        yield np.insert(value, cuts, END), np.insert(group, cuts, END_CLASS), np.insert(which, cuts, np.arange(b - a)), a, b


class Places:
    """Ranks of the head words, looked up by the first bits of their hashes."""

    def __init__(self, words: np.ndarray):
        order = np.argsort(words)
        self.words, self.rank = np.append(words[order], np.uint64((1 << 64) - 1)), order.astype(np.int32)
        self.shift = np.uint64(64 - max(1, len(words).bit_length()))
        first = np.arange(1 << int(np.uint64(64) - self.shift), dtype=np.uint64) << self.shift
        self.start = np.searchsorted(words[order], first).astype(np.int32)

    def of(self, value: np.ndarray) -> np.ndarray:
        """Rank of each token among the head words, or -1."""
        at = self.start[(value >> self.shift).astype(np.int64)]
        before = np.flatnonzero(self.words[at] < value)
        while len(before):
            at[before] += 1
            before = before[self.words[at[before]] < value[before]]
        found = (self.words[at] == value) & (at < len(self.rank))
        out = np.full(len(value), -1)
        out[found] = self.rank[at[found]]
        return out


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), text_of().alias("text"), held_out(F.col("doc_id")).alias("held_out"))


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and ending classes of about ``most`` tokens of whole texts at once."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in slices(batches, TEXTS):
        for value, group, _, _, _ in tokens(batch.column("text").to_pylist()):
            held.append((value, group))
            if sum(len(v) for v, _ in held) >= most:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held = []
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def word_counts(train: DataFrame) -> DataFrame:
    """(word, group, n): count and ending class of every training token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for value, group in _gathered(batches, COUNTED):
            words, first, n = np.unique(value, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(group[first].astype(np.int32)), pa.array(n)], names=["word", "group", "n"])

    found = train.select("text").mapInArrow(lean(run), "word long, group int, n long")
    return stored(found.groupBy("word").agg(F.first("group").alias("group"), F.sum("n").alias("n")), "brown-words")


def ranked_words(counts: DataFrame) -> DataFrame:
    """(id, word, group, n) of every training word but the end: id 0 is the most frequent one, ties by hash."""
    order = [F.desc("n"), F.asc("word")]
    only = counts.where(F.col("word") != int(END.view(np.int64)))
    placed = only.repartitionByRange(spark_partitions(counts.sparkSession), *order).sortWithinPartitions(*order)
    placed = stored(placed.withColumn("_number", F.monotonically_increasing_id()), "brown-ranks")
    part = F.shiftright("_number", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a partition
    before, starts = 0, []
    for r in sorted(sizes):
        starts.append((r["part"], before))
        before += r["n"]
    columns = [pa.array(x, pa.int64()) for x in (list(zip(*starts, strict=True)) or [(), ()])]
    # from an Arrow table: a list would pass through Python workers of its own, which stay
    start = F.broadcast(counts.sparkSession.createDataFrame(pa.Table.from_arrays(columns, names=["_part", "_start"])))
    at = F.col("_number").bitwiseAND((1 << 33) - 1)
    return placed.join(start, part == F.col("_part")).select((F.col("_start") + at).alias("id"), "word", "group", "n")


def _open_code(word: Column) -> Column:
    return F.bitwise_not(word.bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))


def _pack(key: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending keys and their counts: steps and counts, byte by byte of their 64 bits, compressed."""
    planes = [np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for x in (np.diff(key, prepend=0), n)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(2, 8, -1)
    steps, n = (np.ascontiguousarray(x.T).view("<i8").reshape(-1) for x in raw)
    return np.cumsum(steps), n


def _added(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the sums of their counts."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


LISTS = "part long, bucket long, data binary, i int, j int, n long"


def _listed(a: np.ndarray, b: np.ndarray, n: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows ``LISTS`` of distinct pairs (a, b): packed entries of one bucket and group, and counts of pairs without a clustered word."""
    out: dict[str, list] = {k: [] for k in ("part", "bucket", "data", "i", "j", "n")}
    keys, counts = [], []
    for mine, other, side in ((a, b, 0), (b, a, 1)):
        here = mine >= 0
        w, e = mine[here], other[here]
        place = e % buckets
        part = np.where(e < 0, 0, place // SPAN)
        code = np.where(e < 0, -1 - e, PLACED + place % SPAN * BUCKET + e // buckets)
        keys.append((part * buckets + w % buckets, (side * BUCKET + w // buckets) << CODE | code))
        counts.append(n[here])
    (list_of, key), m = (np.concatenate(x) for x in zip(*keys, strict=True)), np.concatenate(counts)
    order = np.lexsort((key, list_of))
    list_of, key, m = list_of[order], key[order], m[order]
    cuts = np.flatnonzero(np.diff(list_of, prepend=-1, append=-1)).tolist() if len(list_of) else [0]
    for x, y in zip(cuts, cuts[1:]):
        out["part"].append(int(list_of[x]) // buckets)
        out["bucket"].append(int(list_of[x]) % buckets)
        out["data"].append(_pack(key[x:y], m[x:y]))
    made, both = len(out["data"]), (a < 0) & (b < 0)
    cell, total = _added((-1 - a[both]) * GROUPS + (-1 - b[both]), n[both])
    out["part"] += [None] * len(cell)
    out["bucket"] += (-1 - cell).tolist()  # spread like the lists
    out["data"] += [None] * len(cell)
    out["i"], out["j"], out["n"] = ([None] * made + x.tolist() for x in (cell // GROUPS, cell % GROUPS, total))
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))


def _after(x: np.ndarray, first: int) -> np.ndarray:
    return np.concatenate([[first], x[:-1]])


def neighbour_lists(train: DataFrame, words: np.ndarray, clustered: int, beyond: DataFrame | None, buckets: int) -> DataFrame:
    """Rows ``LISTS`` of all pairs of neighbouring tokens of the training texts, an end before the first and after each.

    ``words``: the head by rank; ``beyond``: (id, word) of clustered words outside it, None if the head holds all words. An entry
    is a word, what follows it (side 0) or goes before (side 1), and a count; a word has one entry for each other word and side
    in a row, so no bucket is much longer than others.
    """
    known = train.sparkSession.sparkContext.broadcast(Places(words))
    outside = beyond is not None
    waiting = ("a", "b", "ga", "gb")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for value, group in _gathered(batches, PAIRED):
            at = known.value.of(value)
            code = np.where((at >= 0) & (at < clustered), at, -1 - group)
            key = (_after(code, -1 - END_CLASS) + 128) << 32 | (code + 128)
            waits = (at < 0) & (group != END_CLASS) & outside
            open_ = waits | _after(waits, False)
            found, n = np.unique(key[~open_], return_counts=True)
            lists = _listed((found >> 32) - 128, (found & 0xFFFFFFFF) - 128, n, buckets)
            if not outside:
                yield lists
                continue
            nothing = [pa.nulls(lists.num_rows, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*lists.columns, *nothing], names=[*lists.schema.names, *waiting])
            code = np.where(waits, ~((value & np.uint64((1 << 62) - 1) | np.uint64(1 << 62)).view(np.int64)), code)
            late = np.flatnonzero(open_)
            columns = [pa.array(x[late]) for x in (_after(code, -1 - END_CLASS), code, _after(group, END_CLASS), group)]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(late), f.type) for f in lists.schema], *columns], names=[*lists.schema.names, *waiting])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _listed(*(batch.column(x).to_numpy() for x in ("a", "b", "n")), buckets)

    packed = train.select("text").mapInArrow(lean(count), LISTS + (", a long, b long, ga long, gb long" if outside else ""))
    if outside:
        # none of these words is frequent; those below LEAST are in no list and have their ending's code
        named = beyond.select(_open_code(F.col("word")).alias("_w"), F.col("id").alias("_id"))
        packed = stored(packed, "brown-counted")
        late = packed.where("a is not null").select(*waiting)
        for side in ("a", "b"):
            met = late.where(F.col(side) <= OPEN).join(named, F.col(side) == F.col("_w"), "left")
            met = met.withColumn(side, F.coalesce(F.col("_id"), -1 - F.col(f"g{side}"))).drop("_w", "_id")
            late = late.where(F.col(side) > OPEN).unionByName(met)
        late = late.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).mapInArrow(lean(pack), LISTS)
        packed = packed.where("a is null").drop(*waiting).unionByName(late)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now, size = None, 0

        def closed() -> pa.RecordBatch:
            key, n = _added(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_pylist([{"part": now[0], "bucket": now[1], "data": _pack(key, n)}], schema=batch.schema)

        for batch in batches:
            plain = batch.filter(batch.column("data").is_null())
            if plain.num_rows:
                yield plain
            batch = batch.filter(batch.column("data").is_valid())
            for part, bucket, data in zip(*(batch.column(x) for x in ("part", "bucket", "data")), strict=True):
                at = (part.as_py(), bucket.as_py())
                if held and (at != now or size > ENTRIES):
                    yield closed()
                    held, size = [], 0
                now = at
                held.append(_unpack(data.as_py()))
                size += len(held[-1][0])
        if held:
            yield closed()

    by_bucket = packed.repartition("part", "bucket").sortWithinPartitions("part", "bucket")
    return stored(by_bucket.mapInArrow(lean(merge), LISTS), "brown-lists")


class _Classes:
    """Classes of the words of a group of buckets, read from the shared class file; keeps two groups."""

    def __init__(self, folder: str):
        self._folder, self._kept = folder, {}

    def group(self, part: int) -> np.ndarray:
        """Class by a neighbour's place in the list."""
        if part not in self._kept:
            store, path = _filesystem(self._folder)
            rows = dataset.dataset(path, filesystem=store, format="parquet").to_table(filter=dataset.field("part") == part)
            found = np.zeros(PLACED + rows.num_rows * BUCKET, np.uint8)
            found[:GROUPS] = np.arange(GROUPS)
            for bucket, classes in zip(rows.column("bucket").to_pylist(), rows.column("classes").to_pylist(), strict=True):
                found[PLACED + bucket % SPAN * BUCKET :][:BUCKET] = np.frombuffer(classes, np.uint8)
            while len(self._kept) > 1:
                del self._kept[next(iter(self._kept))]
            self._kept[part] = found
        return self._kept[part]

    def own(self, bucket: int) -> np.ndarray:
        at = PLACED + bucket % SPAN * BUCKET
        return self.group(bucket // SPAN)[at : at + BUCKET]


_READ: dict[str, _Classes] = {}


def _classes_of(folder: str) -> _Classes:
    """One reader per worker and class file; the files of earlier rounds are forgotten."""
    if folder not in _READ:
        _READ.clear()
        _READ[folder] = _Classes(folder)
    return _READ[folder]


def _class_file(rows: DataFrame) -> str:
    """The folder of the stored (part, bucket, classes); one file a group."""
    folder = shared_folder(rows.sparkSession, "brown-classes")
    rows.repartition("part").write.parquet(folder)
    return folder


def _moves(bucket: int, buckets: int, k: int) -> np.ndarray:
    """Whether the words of the bucket move in round ``k``."""
    rank = np.arange(BUCKET, dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket)
    return (mix(rank) >> np.uint64(32)) & np.uint64(1) == np.uint64(k % 2)


def neighbours(lists: DataFrame, folder: str, buckets: int, k: int | None) -> DataFrame:
    """Rows (bucket, data): packed counts of the words that move in round ``k`` beside each class; and class bigrams (cells)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, matrix = _classes_of(folder), np.zeros((GROUPS, GROUPS), np.int64)
        names = ["bucket", "data", "cells"]
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()))

        def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
            at, n = (np.concatenate(x) for x in zip(*held, strict=True))
            return np.bincount(at, n, 2 * BUCKET * GROUPS)

        def closed(bucket: int, total: np.ndarray) -> pa.RecordBatch:
            own, total = told.own(bucket), total.reshape(2, BUCKET, GROUPS)
            for c in range(CLASSES):
                mine = own == c
                matrix[c] += total[0, mine].sum(axis=0).astype(np.int64)
                matrix[CLASSES:, c] += total[1, mine, CLASSES:].sum(axis=0).astype(np.int64)
            data = None
            if k is not None:
                total[:, ~_moves(bucket, buckets, k)] = 0
                at = np.flatnonzero(total)
                data = _pack(at, total.reshape(-1)[at])
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((bucket, data, None), kinds, strict=True)], names=names)

        held: list[tuple[np.ndarray, np.ndarray]] = []
        now, size, total = None, 0, None
        for batch in batches:
            for part, bucket, data in zip(*(batch.column(x) for x in ("part", "bucket", "data")), strict=True):
                part, bucket = part.as_py(), bucket.as_py()
                if now is not None and (bucket != now or size > ENTRIES):
                    total = summed(held) if total is None else total + summed(held)
                    held, size = [], 0
                    if bucket != now:
                        yield closed(now, total)
                        total = None
                now, (key, n) = bucket, _unpack(data.as_py())
                held.append(((key >> CODE) * GROUPS + told.group(part)[key & ((1 << CODE) - 1)], n))
                size += len(n)
        if now is not None:
            yield closed(now, summed(held) if total is None else total + summed(held))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, matrix.reshape(-1).tolist()), kinds, strict=True)], names=names)

    return lists.where("data is not null").select("part", "bucket", "data").mapInArrow(lean(run), "bucket long, data binary, cells array<long>")


def _matrix(found: DataFrame, fixed: np.ndarray) -> np.ndarray:
    """The class bigrams: the sum of the passes' cells and of the pairs without a clustered word."""
    out = fixed.copy().reshape(-1)
    cells = found.where("cells is not null").select(F.posexplode("cells").alias("at", "n")).where("n > 0")
    rows = cells.groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most GROUPS^2 rows
    out[rows.column("at").to_numpy()] += rows.column("n").to_numpy()
    return out.reshape(GROUPS, GROUPS)


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best_classes(matrix: np.ndarray, own: np.ndarray, which: np.ndarray, entry: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each word the class whose bigram likelihood gains most by the word; its own on a tie.

    ``n[i]``: the count of word ``which[i]`` (ascending) before class ``entry[i]``, or after class ``entry[i] - 128``.
    """
    right, left = (np.zeros((len(own), GROUPS)) for _ in range(2))
    after = entry < 128
    np.add.at(right, (which[after], entry[after]), n[after])
    np.add.at(left, (which[~after], entry[~after] - 128), n[~after])
    return _best(matrix, own, right, left)


def _best(matrix: np.ndarray, own: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """``best_classes`` by the words' whole counts before (``right``) and after (``left``) each class."""
    words = np.arange(len(own))
    gain = np.zeros((len(own), CLASSES))
    # without the word: its row and column leave its own class
    for mine, other, m in ((right, left, matrix), (left, right, matrix.T)):
        cells = np.ascontiguousarray(m[:CLASSES].T)
        # what so many tokens more add to each cell
        more = _phi(cells[None] + np.arange(COMMON)[:, None, None]) - _phi(cells)[None]
        w, j = np.nonzero(mine)
        x = mine[w, j]
        for a in range(0, len(w), STEP):
            i, at, count = w[a : a + STEP], j[a : a + STEP], x[a : a + STEP]
            add = more[np.minimum(count, COMMON - 1).astype(np.int64), at]
            here = own[i]
            kept = np.maximum(cells[at, here] - count, 0)
            add[np.arange(len(i)), here] = _phi(kept + count) - _phi(kept)
            odd = np.flatnonzero((at == here) | (count >= COMMON))
            cell = cells[at[odd]]
            cell[np.arange(len(odd)), here[odd]] -= count[odd]
            cell -= np.where((at == here)[odd, None], other[i[odd], :CLASSES], 0)
            cell = np.maximum(cell, 0)
            add[odd] = _phi(cell + count[odd, None]) - _phi(cell)
            starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            gain[i[starts]] += np.add.reduceat(add, starts, axis=0)
        size = m[:CLASSES].sum(axis=1) - other[:, :CLASSES]
        both = matrix[own, own] - right[words, own] - left[words, own]
        size[words, own] += np.maximum(0, -both) - mine.sum(axis=1)
        gain -= _phi(size + mine.sum(axis=1)[:, None]) - _phi(size)
    best = gain.argmax(axis=1)
    return np.where(gain[words, best] > gain[words, own] + 1e-9, best, own)


def best_class(matrix: np.ndarray, own: int, left: np.ndarray, right: np.ndarray) -> int:
    """``best_classes`` of one word; ``left`` and ``right``: its counts after and before each class."""
    entry = np.concatenate([np.arange(GROUPS), 128 + np.arange(GROUPS)])
    return int(best_classes(matrix, np.array([own]), np.zeros(len(entry), np.int64), entry, np.concatenate([right, left]))[0])


def buckets_of(clustered: int) -> int:
    return max(1, -(-clustered // BUCKET))


def exchange(lists: DataFrame, clustered: int, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The stored (part, bucket, classes) of ``clustered`` words, and the class bigram matrix."""
    spark, buckets = lists.sparkSession, buckets_of(clustered)
    schema = "part long, bucket long, classes binary"

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = batch.column("id").to_numpy()
            classes = [((np.arange(BUCKET) * buckets + x) % CLASSES).astype(np.uint8).tobytes() for x in bucket]
            yield pa.RecordBatch.from_arrays([pa.array(bucket // SPAN), batch.column("id"), pa.array(classes, pa.binary())], names=["part", "bucket", "classes"])

    folder = _class_file(spark.range(buckets).mapInArrow(lean(start), schema))
    fixed = np.zeros((GROUPS, GROUPS))
    for r in lists.where("data is null").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # at most ENDINGS^2 rows
        fixed[r["i"], r["j"]] = r["n"]
    for k in range(rounds if clustered else 0):
        found = stored(neighbours(lists, folder, buckets, k), "brown-neighbours")
        matrix = _matrix(found, fixed)

        def choose(batches: Iterator[pa.RecordBatch], matrix: np.ndarray = matrix, folder: str = folder, k: int = k) -> Iterator[pa.RecordBatch]:
            told = _classes_of(folder)

            def chosen(bucket: int, total: np.ndarray) -> pa.RecordBatch:
                classes = told.own(bucket).copy()
                right, left = total.reshape(2, BUCKET, GROUPS)
                seen = np.flatnonzero(right.any(axis=1))  # the words that move: each is followed by something
                for a in range(0, len(seen), STEP // 2):
                    w = seen[a : a + STEP // 2]
                    classes[w] = _best(matrix, classes[w].astype(np.int64), right[w], left[w])
                return pa.RecordBatch.from_arrays([pa.array([bucket // SPAN]), pa.array([bucket]), pa.array([classes.tobytes()], pa.binary())], names=["part", "bucket", "classes"])

            now, total = None, np.zeros(2 * BUCKET * GROUPS)
            for batch in batches:
                for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    if now is not None and bucket != now:
                        yield chosen(now, total)
                        total[:] = 0
                    now, (at, n) = bucket, _unpack(data)
                    total[at] += n
            if now is not None:
                yield chosen(now, total)

        by_bucket = found.where("data is not null").select("bucket", "data").repartition("bucket").sortWithinPartitions("bucket")
        folder = _class_file(by_bucket.mapInArrow(lean(choose), schema))
    matrix = _matrix(stored(neighbours(lists, folder, buckets, None), "brown-neighbours"), fixed)
    return spark.read.schema(schema).parquet(folder), matrix


def class_rows(classes: DataFrame, clustered: int, first: int = 0) -> DataFrame:
    """(id, c) of the clustered words from rank ``first`` on."""
    buckets = buckets_of(clustered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, row in zip(batch.column("bucket").to_pylist(), batch.column("classes").to_pylist(), strict=True):
                rank = np.arange(BUCKET) * buckets + bucket
                here = (rank >= first) & (rank < clustered)
                c = np.frombuffer(row, np.uint8)[here].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(rank[here]), pa.array(c)], names=["id", "c"])

    return classes.select("bucket", "classes").mapInArrow(lean(run), "id long, c int")


def brown_scores(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    The model learns from the rows that are not ``held_out``. Null counts as empty; an empty text is one
    end token. Repeated rows count and are scored each. Without training rows all counts are 0 and only the
    smoothing remains. Words are told apart by a 64-bit hash, by 62 bits of it among the neighbours of words outside
    the head. ``share`` bounds the words that go to the tasks; it changes no result. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = _rows(docs)
    train = rows.where(~F.col("held_out"))
    counts = word_counts(train)
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"])
    end_count = int(counts.where(F.col("word") == int(END.view(np.int64))).agg(F.sum("n")).first()[0] or 0)
    ranked = ranked_words(counts)
    clustered = ranked.where(F.col("n") >= LEAST).count()
    # no more than ``share`` words
    first = ranked.where(F.col("n") >= -(-n // share)).select("id", "word", "group", "n").toArrow().sort_by("id")
    words = first.column("word").to_numpy().view(np.uint64)
    groups, seen = first.column("group").to_numpy().astype(np.int64), first.column("n").to_numpy()
    beyond = ranked.where(F.col("id") >= len(words)) if v > len(words) + 1 else None
    met = None if beyond is None else beyond.where(F.col("n") >= LEAST)
    lists = neighbour_lists(train, words, clustered, met, buckets_of(clustered))
    classes, matrix = exchange(lists, clustered)
    class_of = groups.copy()
    top = class_rows(classes, clustered).where(F.col("id") < len(words)).toArrow()  # no more than the head
    class_of[top.column("id").to_numpy()] = top.column("c").to_numpy()
    # sizes of the classes: tokens and distinct words
    tokens_in, words_in = matrix.sum(axis=0), np.zeros(GROUPS)
    clear = ranked.groupBy("group").agg(F.count(F.when(F.col("n") < LEAST, 1)).alias("v"))
    for r in [*clear.collect(), *class_rows(classes, clustered).groupBy(F.col("c").alias("group")).agg(F.count(F.lit(1)).alias("v")).collect()]:
        words_in[r["group"]] += r["v"]
    words_in[END_CLASS] += end_count > 0
    prior = (tokens_in + 1) / (tokens_in.sum() + GROUPS)
    move = np.log10((matrix + prior) / (matrix.sum(axis=1, keepdims=True) + 1))
    inside = np.log10(tokens_in + words_in + 1)
    base = float(np.log10(n + v + 1))
    model = spark.sparkContext.broadcast((Places(words), seen, class_of.astype(np.uint8), move, inside))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, seen, class_of, move, inside = model.value
        for batch in slices(batches, TEXTS):
            out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base_score", "score", "words", "ends", "times", "steps")}
            for value, group, which, a, b in tokens(batch.column("text").to_pylist()):
                at = places.of(value)
                told, is_end = at >= 0, group == END_CLASS
                count, c = np.zeros(len(value)), group.copy()
                count[told], c[told] = seen[at[told]], class_of[at[told]]
                count[is_end] = end_count
                before = np.concatenate([[END_CLASS], c[:-1]])
                # words outside the head, and steps from or to one, wait for the join
                open_ = ~told & ~is_end
                waits = open_ | np.concatenate([[False], open_[:-1]])
                k = b - a
                gain = np.where(open_, 0.0, np.log10(count + 1) - inside[c])
                out["n_tokens"].append(np.bincount(which, minlength=k))
                out["n_known"].append(np.bincount(which, count > 0, minlength=k).astype(np.int64))
                out["base_score"].append(np.bincount(which, np.log10(count + 1) - base, minlength=k))
                out["score"].append(np.bincount(which, gain + np.where(waits, 0.0, move[before, c]), minlength=k))
                cuts = np.searchsorted(which, np.arange(k + 1))
                for i in range(k):
                    part = slice(cuts[i], cuts[i + 1])
                    mine = open_[part]
                    found, first, place, times = np.unique(value[part][mine], return_index=True, return_inverse=True, return_counts=True)
                    code = c[part].copy()
                    code[mine] = GROUPS + place
                    steps = (np.concatenate([[END_CLASS], code[:-1]]) << 32 | code)[waits[part]]
                    out["words"].append(found.view(np.int64))
                    out["ends"].append(group[part][mine][first])
                    out["times"].append(times)
                    out["steps"].append(steps)
            names = ["doc_id", "held_out", *out]
            arrays = [pa.array(np.concatenate(out[k])) if out[k] else pa.array([], pa.int64()) for k in ("n_tokens", "n_known")]
            arrays += [pa.array(np.concatenate(out[k])) if out[k] else pa.array([], pa.float64()) for k in ("base_score", "score")]
            arrays += [pa.array(out[k], pa.list_(pa.int64())) for k in ("words", "ends", "times", "steps")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *arrays], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    lists = ", ".join(f"{k} array<long>" for k in ("words", "ends", "times", "steps"))
    sums = "n_tokens long, n_known long, base_score double, score double"
    part = rows.mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, {sums}, {lists}")
    part = stored(part.withColumn("row", F.monotonically_increasing_id()), "brown-parts")
    if beyond is not None:
        # words outside the head, once a document: no training word is frequent here
        met = beyond.where(F.col("n") >= LEAST).join(class_rows(classes, clustered, len(words)), "id")
        rare = beyond.where(F.col("n") < LEAST).select("word", "n", F.col("group").cast("int").alias("c"))
        told = met.select("word", "n", "c").unionByName(rare)
        rest = part.select("row", F.posexplode("words").alias("j", "word"))
        more = rest.join(told, "word").groupBy("row").agg(F.collect_list(F.struct("j", "n", "c")).alias("told"))
        part = part.drop("words").join(more, "row", "left")
    else:
        part = part.drop("words").withColumn("told", F.lit(None).cast("array<struct<j:int,n:bigint,c:int>>"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, _, move, inside = model.value
        for batch in batches:
            sums = {k: batch.column(k).to_numpy().copy() for k in ("n_known", "base_score", "score")}
            lists = {k: batch.column(k) for k in ("ends", "times", "steps", "told")}
            for i in range(batch.num_rows):
                ends, times, steps = (lists[k][i].values.to_numpy() for k in ("ends", "times", "steps"))
                if not len(ends):
                    continue
                c, count = ends.copy(), np.zeros(len(ends))
                found = lists["told"][i].values
                if found is not None:
                    j = found.field("j").to_numpy()
                    c[j], count[j] = found.field("c").to_numpy(), found.field("n").to_numpy()
                gain, code = np.log10(count + 1), np.concatenate([np.arange(GROUPS), c])
                sums["n_known"][i] += int(times[count > 0].sum())
                sums["base_score"][i] += float((times * gain).sum())
                sums["score"][i] += float((times * (gain - inside[c])).sum() + move[code[steps >> 32], code[steps & 0xFFFFFFFF]].sum())
            columns = [pa.array(sums[k]) if k in sums else batch.column(k) for k in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = part.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "ends", "times", "steps", "told").mapInArrow(lean(finish), f"doc_id {kind}, held_out boolean, {sums}")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
