"""Benchmark decontamination by size-partitioned MinHash containment search.

Short items are looked for inside long documents. The items are partitioned by the
number of their word shingles; for a partition of items of up to 2^k shingles every document is
covered by windows of 2^(k+1) shingles, one every 2^k, so that a passage of an item's size lies
whole in some window, and item and window are of like size. That bounds their
resemblance from below wherever containment holds, which a MinHash of the document as a whole
would not. Items and windows that agree in one of ``HASHES`` minima are
candidates, and each is verified by the exact share of the item's shingles in the whole document.
Items of up to ``DIRECT`` shingles are candidates wherever one of their shingles is, without MinHash: none is missed.

At containment 0.8 a longer item's resemblance with the best window is 0.19 at least, so a
contiguous passage of it is missed with probability below 0.81^64 = 2e-6; an item that is scattered over
the document gives candidates from every window that holds some of it.

The items are the stated query set: they are taken in blocks of ``BLOCK`` items, each
searched against all documents within the scan's tasks. No shuffle of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlake.llm.common import TEXTS, lean, ship, slices, text_of
from visitlake.llm.wordhash import mix, shingles, words_by_text

WORDS = 5
CONTAINMENT = 0.8
HASHES = 64
#: Items of so many shingles or fewer are looked up by their shingles.
DIRECT = 8
#: Items searched in one pass over the documents.
BLOCK = 20_000
FOUND = "item_id long, containment double, item_shingles int, hits int"

#: One odd multiplier for each hash function: a bijection of the (already mixed) shingle hashes.
_FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Bits of the table that tells most keys which no item has.
_SIEVE_BITS = 20


def _minima(values: np.ndarray, starts: np.ndarray | None) -> np.ndarray:
    """Per hash function the least hash of each run of ``values`` (of all, without ``starts``)."""
    out = np.empty((HASHES, 1 if starts is None else len(starts)), np.uint64)
    for i, factor in enumerate(_FACTORS):
        h = values * factor
        out[i] = h.min() if starts is None else np.minimum.reduceat(h, starts)
    return out


def _sieve(keys: np.ndarray) -> np.ndarray:
    return ((keys >> np.uint64(6)) & np.uint64((1 << _SIEVE_BITS) - 1)).astype(np.int64)


def _index(keys: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys, their item numbers, and the sieve of the keys."""
    order = np.argsort(keys, kind="stable")
    sieve = np.zeros(1 << _SIEVE_BITS, bool)
    sieve[_sieve(keys)] = True
    return keys[order], which[order], sieve


def _looked_up(index: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray) -> Iterator[int]:
    """Item numbers of the keys among ``at``."""
    keys, which, sieve = index
    at = at[sieve[_sieve(at)]]
    low = np.searchsorted(keys, at)
    low[low == len(keys)] = 0
    for key in np.unique(at[keys[low] == at]):
        yield from which[np.searchsorted(keys, key) : np.searchsorted(keys, key, side="right")].tolist()


class Items:
    """The search structure of one block of items."""

    def __init__(self, items: list[tuple[int, str]], words: int = WORDS):
        kept = [(i, np.unique(shingles(w, words))) for (i, _), w in zip(items, words_by_text([t or "" for _, t in items]), strict=True)]
        kept = [(i, s) for i, s in kept if len(s)]
        self.words = words
        self.ids = [i for i, _ in kept]
        self.sizes = np.array([len(s) for _, s in kept], np.int64)
        self.shingles = np.unique(np.concatenate([s for _, s in kept])) if kept else np.zeros(0, np.uint64)
        self.places = [np.searchsorted(self.shingles, s) for _, s in kept]
        self.partitions: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        short = np.flatnonzero(self.sizes <= DIRECT)
        self.direct = _index(np.concatenate([kept[j][1] for j in short]), np.repeat(short, self.sizes[short])) if len(short) else None
        level = np.array([int(n - 1).bit_length() for n in self.sizes], np.int64)
        for k in sorted(set(level[self.sizes > DIRECT].tolist())):
            mine = np.flatnonzero(level == k)
            keys = np.stack([_tagged(_minima(kept[j][1], None)[:, 0]) for j in mine])
            self.partitions[k] = _index(keys.ravel(), np.repeat(mine, HASHES))

    def search(self, found: np.ndarray) -> list[tuple[int, int]]:
        """(item number, shingles of it that the document holds) of the candidates for one document's shingles."""
        if not len(self.shingles) or not len(found):
            return []
        candidates: set[int] = set()
        cells: dict[int, np.ndarray] = {}
        if self.direct is not None:
            candidates.update(_looked_up(self.direct, found))
        for k, index in self.partitions.items():
            step = 1 << k
            finer = max((j for j in cells), default=None)
            if finer is None:
                mins = _minima(found, np.arange(0, len(found), step))
            else:
                mins = np.minimum.reduceat(cells[finer], np.arange(0, cells[finer].shape[1], step >> finer), axis=1)
            cells[k] = mins
            windows = np.minimum(mins[:, :-1], mins[:, 1:]) if mins.shape[1] > 1 else mins
            candidates.update(_looked_up(index, _tagged(windows.T).ravel()))
        if not candidates:
            return []
        place = np.searchsorted(self.shingles, found)
        place[place == len(self.shingles)] = 0
        held = np.zeros(len(self.shingles), bool)
        held[place[self.shingles[place] == found]] = True
        return [(j, int(held[self.places[j]].sum())) for j in sorted(candidates)]


def _tagged(minima: np.ndarray) -> np.ndarray:
    """Minima with their hash function's number in the low 6 bits (the last axis runs over the functions)."""
    return (minima & ~np.uint64(HASHES - 1)) | np.arange(HASHES, dtype=np.uint64)


def contained_items(
    docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, words: int = WORDS, block: int = BLOCK
) -> DataFrame:
    """(doc_id, item_id, containment, item_shingles, hits): items of which a document holds that share or more.

    ``docs``: doc_id, text; ``items``: item_id, text; other columns are ignored. Words are
    lower-cased runs of letters and digits; an item of fewer than ``words`` words is one
    shingle of all its words and is found only in a document of just these words.
    Null and empty texts, and texts without words, hold nothing and are never found. Repeated rows
    give repeated results. Without documents or items the result is empty.
    """
    return _contained(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), items, containment, words, block)


def _contained(rows: DataFrame, items: DataFrame, containment: float = CONTAINMENT, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """``contained_items`` of rows (doc_id of any type, text)."""
    ship(rows.sparkSession)
    ranked = items.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"))
    total, found = ranked.count(), []
    ends = [None]
    if total > block:  # cut the item ids into ranges of about a block each
        shares = [i * block / total for i in range(1, -(-total // block))]
        ends = [*ranked.approxQuantile("item_id", shares, 1 / (100 * len(shares))), None]
    low = None
    for high in dict.fromkeys(ends):
        part = ranked if low is None else ranked.where(F.col("item_id") > low)
        part = part if high is None else part.where((F.col("item_id") <= high) | (F.lit(low is None) & F.col("item_id").isNull()))
        found.append(_search(rows, [(r["item_id"], r["text"]) for r in part.collect()], containment, words))
        low = high
    return reduce(DataFrame.unionByName, found)


def _search(rows: DataFrame, items: list[tuple[int, str]], containment: float, words: int) -> DataFrame:
    index = rows.sparkSession.sparkContext.broadcast(Items(items, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = index.value
        for batch in slices(batches, TEXTS):
            out: list[tuple] = []
            ids = batch.column("doc_id").to_pylist()
            for doc_id, w in zip(ids, words_by_text(batch.column("text").to_pylist()), strict=True):
                for j, hits in items.search(shingles(w, items.words)):
                    if hits >= containment * items.sizes[j] - 1e-9:
                        out.append((doc_id, items.ids[j], hits / int(items.sizes[j]), int(items.sizes[j]), hits))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.float64(), pa.int32(), pa.int32())
            names = ("doc_id", "item_id", "containment", "item_shingles", "hits")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {FOUND}")


def without_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` (all columns) without the documents that hold an item; rows with a null doc_id are judged by their text."""
    # all 128 bits, so that no clean document goes with another's hash; a null doc_id is not an empty one
    key = F.md5(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text_of()))
    keyed = docs.select(F.struct("*").alias("_row"), key.alias("_key"))
    plain = keyed.select(F.col("_key").alias("doc_id"), F.coalesce(F.col("_row")["text"].cast("string"), F.lit("")).alias("text"))
    # at most one row for each item and document, far fewer than documents
    bad = _contained(plain, items).select(F.col("doc_id").alias("_bad")).distinct()
    clean = keyed.join(bad, F.col("_key") == F.col("_bad"), "left_anti")
    return clean.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
