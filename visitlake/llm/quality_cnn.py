"""Document quality by a byte-level convolutional network in numpy.

Every byte has a learned embedding; learned filters look at ``WIDTH`` bytes every ``STRIDE``
bytes. Their greatest responses within a chunk of two cells (chunks overlap by one
cell and cover the whole document) feed a hidden layer, whose units are max-pooled over all
chunks and combined into one probability.

The network is fitted on the driver on a bounded sample of labelled rows (``SAMPLE_ROWS`` whole texts, in the order of a
hash, until they have ``SAMPLE_BYTES`` together) and scores every whole text within the
scan's tasks: no shuffle, memory bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlake.llm.common import lean, ship, text_of
from visitlake.llm.wordhash import blocks

EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 8, 12, 4, 32, 16
#: Bytes of a cell; a chunk is two neighbouring cells.
CELL = 128
#: Bounds of the fitting sample: rows, and bytes of all their texts (the last text may go beyond).
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 1 << 26
EPOCHS, BATCH, RATE, SEED = 10, 32, 0.01, 7
#: Score from which a document counts as good.
GOOD = 0.3


class ByteCnn:
    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        if weights is None:
            rng = np.random.default_rng(SEED)
            shape = {"embed": (256, EMBED), "conv": (WIDTH * EMBED, FILTERS), "hidden": (FILTERS, HIDDEN), "out": (HIDDEN,)}
            weights = {k: rng.normal(0, 1 / np.sqrt(s[0] if k != "embed" else 4), s).astype(np.float32) for k, s in shape.items()}
            weights |= {"conv_b": np.zeros(FILTERS, np.float32), "hidden_b": np.full(HIDDEN, 0.1, np.float32), "out_b": np.zeros(1, np.float32)}
        self.w = weights

    def _forward(self, texts: list[bytes], keep: bool = False):
        """Logits of the texts; with ``keep`` also what the gradient needs."""
        w = self.w
        padded = [t + bytes(WIDTH + -(len(t) + WIDTH) % CELL) for t in texts]
        cells = np.array([len(t) // CELL for t in padded])
        raw = np.frombuffer(b"".join(padded) + bytes(WIDTH), np.uint8)
        steps, windows = CELL // STRIDE, int(cells.sum()) * (CELL // STRIDE)
        top = np.empty((int(cells.sum()), FILTERS), np.float32)
        where = np.empty(top.shape, np.int64) if keep else None
        for a in range(0, windows, steps * 256):
            b = min(windows, a + steps * 256)
            x = w["embed"][raw[a * STRIDE : (b - 1) * STRIDE + WIDTH]]
            view = np.lib.stride_tricks.as_strided(x, (b - a, WIDTH * EMBED), (STRIDE * EMBED * 4, 4))
            r = (np.ascontiguousarray(view) @ w["conv"]).reshape(-1, steps, FILTERS)
            part = slice(a // steps, b // steps)
            if keep:
                best = r.argmax(axis=1)
                top[part] = np.take_along_axis(r, best[:, None], 1)[:, 0]
                where[part] = best + np.arange(part.start, part.stop)[:, None] * steps
            else:
                top[part] = r.max(axis=1)
        top = top + w["conv_b"]
        last = np.zeros(len(top), bool)
        last[np.cumsum(cells) - 1] = True  # the last cell of a text is a chunk of its own
        after = np.where(last, np.arange(len(top)), np.arange(len(top)) + 1)
        other = top[after]
        chunk = np.maximum(np.maximum(top, other), 0)
        hidden = chunk @ w["hidden"] + w["hidden_b"]
        starts = np.cumsum(cells) - cells
        pooled = np.maximum(np.maximum.reduceat(hidden, starts, axis=0), 0)
        logits = pooled @ w["out"] + w["out_b"][0]
        if not keep:
            return logits
        return logits, (raw, cells, starts, top, other, after, where, chunk, hidden, pooled)

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = [1 / (1 + np.exp(-self._forward(texts[a:b]).astype(float))) for a, b in blocks(texts, 1 << 20)]
        return np.concatenate(out) if out else np.zeros(0)

    def _gradient(self, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        logits, (raw, cells, starts, top, other, after, where, chunk, hidden, pooled) = self._forward(texts, keep=True)
        d = ((1 / (1 + np.exp(-logits)) - y) / len(y)).astype(np.float32)
        g = {"out": pooled.T @ d, "out_b": np.array([d.sum()], np.float32)}
        dp = d[:, None] * w["out"] * (pooled > 0)
        # the chunk that gave each hidden unit its maximum
        pick = np.stack([s + hidden[s : s + n].argmax(axis=0) for s, n in zip(starts, cells, strict=True)])
        dh = np.zeros_like(hidden)
        np.add.at(dh, (pick, np.arange(HIDDEN)), dp)
        used = np.flatnonzero(dh.any(axis=1))
        dh = dh[used]
        g["hidden"], g["hidden_b"] = chunk[used].T @ dh, dh.sum(axis=0)
        dc = (dh @ w["hidden"].T) * (chunk[used] > 0)
        cell = np.where(top[used] >= other[used], used[:, None], after[used][:, None])
        at = where[cell, np.arange(FILTERS)]
        k, f = np.nonzero(dc)
        grad, window = dc[k, f], at[k, f]
        codes = raw[window[:, None] * STRIDE + np.arange(WIDTH)]
        x = w["embed"][codes].reshape(len(window), -1)
        g["conv"], g["conv_b"] = np.zeros_like(w["conv"]), np.zeros(FILTERS, np.float32)
        g["embed"] = np.zeros_like(w["embed"])
        np.add.at(g["conv_b"], f, grad)
        for j in range(FILTERS):
            mine = f == j
            g["conv"][:, j] = grad[mine] @ x[mine]
        dx = (grad[:, None] * w["conv"].T[f]).reshape(-1, EMBED)
        np.add.at(g["embed"], codes.ravel(), dx)
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS) -> ByteCnn:
        """Adam on the logistic loss; the rate falls to zero. Without both labels only the share of good texts is learned."""
        share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
        self.w["out_b"][0] = np.log(share / (1 - share))
        if not 0 < share < 1 or len(set(labels.tolist())) < 2:
            self.w["out"][:] = 0
            return self
        rng = np.random.default_rng(SEED)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        total, t = epochs * -(-len(texts) // BATCH), 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), BATCH):
                mine = order[a : a + BATCH]
                t += 1
                rate = RATE * (1 - (t - 1) / total)
                for k, g in self._gradient([texts[i] for i in mine], labels[mine]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    step = m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                    self.w[k] = (self.w[k] - rate * step).astype(np.float32)
        return self


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the doc_id as text, modulo ``folds``; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> ByteCnn:
    """Fit on labelled documents outside fold 0, on whole texts of any length; rows with a null doc_id or quality are left out.

    The sample: the first ``rows`` labelled documents in the order of a hash, as long as those before have less than ``most_bytes``.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    # at most 2 * rows labels: small enough to broadcast whatever the table holds
    chosen = known.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id", "_y").limit(2 * rows)
    texts = docs.select("doc_id", text_of().alias("text"))
    sized = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select(
        "_id", "_y", F.xxhash64("text").alias("_h"), F.octet_length("text").cast("long").alias("_n"))
    kept, used = [], 0
    for r in sized.orderBy(F.xxhash64("_id"), "_id", "_h", "_y").limit(rows).collect():
        if used < most_bytes:
            kept.append((r["_id"], r["_h"], r["_y"]))
            used += r["_n"]
    if not kept:
        return ByteCnn().fit([], np.zeros(0, np.float32))
    kind = texts.schema["doc_id"].dataType.simpleString()
    columns = [pa.array(x) for x in zip(*sorted({k[:2] for k in kept}), strict=True)]
    # from an Arrow table: a list would pass through Python workers of its own, which stay
    named = F.broadcast(docs.sparkSession.createDataFrame(pa.Table.from_arrays(columns, names=["_id", "_h"]), f"_id {kind}, _h long"))
    found = texts.join(named, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_h"))).select("_id", "_h", "text").distinct().collect()
    whole = {(r["_id"], r["_h"]): r["text"].encode("utf-8") for r in found}
    return ByteCnn().fit([whole[k[:2]] for k in kept], np.array([k[2] for k in kept], np.float32))


def quality_scores(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None) -> DataFrame:
    """All columns of ``docs`` and ``quality_score`` (0 to 1, higher is better).

    Null and empty texts are scored like a text of zero bytes; equal texts have equal scores. Only the
    text is an input. Documents without labels are scored like any other; an empty table gives no rows.
    ``train_docs`` holds the labelled documents if they are not in ``docs``.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(fit_quality(docs if train_docs is None else train_docs, labels).w)
    rows = docs.select(F.struct("*").alias("_row"), text_of().alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cnn = ByteCnn(model.value)
        for batch in batches:
            texts = [t.as_py().encode("utf-8") for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(cnn.score(texts))], names=["_row", "quality_score"])

    schema = T.StructType([rows.schema["_row"], T.StructField("quality_score", T.DoubleType())])
    scored = rows.mapInArrow(lean(run), schema)
    return scored.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c != "quality_score"], "quality_score")
