"""Near-duplicate classes by DartMinHash signatures and banded joining.

Darts are thrown by hashing into the region (element, weight, rank): every unit of area
holds a Poisson(1) number of them, the same ones for every document. A document owns the
darts below its elements' weights; of those, the earliest (least rank) in each of ``COORDINATES``
coordinates is its signature. Two documents agree in a coordinate with the probability of
their weighted Jaccard similarity. Only ranks up to about ``k log k / total weight`` are looked at,
so the cost is of the order of elements plus darts.

Signatures are cut into bands. Documents that share a band are candidates:

1. equal word sequences are one node, so copies are never paired;
2. stars: in every bucket each node is compared with one centre only, the member with the most
   company over all its bands (the hub of a group of near copies lies in nearly all its buckets),
   and verified exactly against the most alike of its centres; verified links give components;
3. buckets that still hold several components: the nodes outside the bucket's largest component
   meet the others in blocks, first each with its ``FIRST`` most alike partners, which joins most of
   them, then with all partners in other components that a longer signature leaves over. So no link between
   classes is lost to the choice of a centre, and no pairs are made within a component.

Candidates whose signatures agree ``ERRORS`` standard errors less than the threshold are
dropped before the exact check (3e-5 of the pairs just at the threshold). A pair at similarity 0.8
shares no band with probability (1 - 0.8^5)^32 = 3e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlake.llm.common import TEXTS, lean, ship, slices, split_join, stored, text_of
from visitlake.llm.wordhash import mix, shingles, words_by_text

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
COORDINATES = BANDS * ROWS
#: Standard errors by which a signature may fall short of the threshold.
ERRORS = 4.0
#: Coordinates (of one byte) of the longer signature of nodes that the stars leave open.
LONG = 512
#: Partners of the first pass over buckets with several components; nodes of a block on either side.
FIRST, LEFT, RIGHT = 4, 64, 256

_U = np.uint64
_UNIT = 2.0**-64
#: P(Poisson(1) <= n) for n = 0, 1, ...; the rest beyond 12 is below 1e-10.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 13)]))


def weighted_shingles(words: np.ndarray, k: int = WORDS, counted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their weights: 1 each, or with ``counted`` the number of occurrences."""
    found, counts = np.unique(shingles(words, k), return_counts=True)
    return found, counts.astype(float) if counted else np.ones(len(found))


def dart_signature(elements: np.ndarray, weights: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """The identity of the earliest dart in each of ``k`` coordinates.

    The weight axis is cut at 0, 1, 2, 4, ...; a cell is one such slab times the rank span that
    makes its area 1. Elements have positive weights; no elements give no signature.
    """
    if not len(elements):
        return np.zeros(0, np.uint64)
    wanted = k * np.log(k) + 2 * k
    bound = wanted / weights.sum()
    slab = np.ceil(np.log2(np.maximum(weights, 1.0))).astype(np.int64)
    which = np.repeat(np.arange(len(elements)), slab + 1)
    level = np.arange(len(which)) - np.repeat(np.cumsum(slab + 1) - (slab + 1), slab + 1)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, low)
    region = mix(elements[which] + level.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    top = weights[which]
    while True:
        cells = np.ceil(bound * width).astype(np.int64)
        r = np.repeat(np.arange(len(which)), cells)
        cell = np.arange(len(r)) - np.repeat(np.cumsum(cells) - cells, cells)
        seed = mix(region[r] ^ (cell.astype(np.uint64) * _U(0xD6E8FEB86659FD93) + _U(1)))
        darts = np.searchsorted(_POISSON, seed * _UNIT, side="right")
        d = np.repeat(np.arange(len(r)), darts)
        nth = np.arange(len(d)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix(seed[d] + (nth.astype(np.uint64) + _U(1)) * _U(0xA0761D6478BD642F))
        at = r[d]
        rank = (cell[d] + mix(dart ^ _U(0x8EBC6AF09C88C6E3)) * _UNIT) / width[at]
        weight = low[at] + mix(dart ^ _U(0x589965CC75374CC3)) * _UNIT * width[at]
        inside = (weight < top[at]) & (rank <= bound)
        dart, rank = dart[inside], rank[inside]
        order = np.argsort(rank, kind="stable")
        coordinate, first = np.unique((dart[order] >> _U(32)) % _U(k), return_index=True)
        if len(coordinate) == k:
            return dart[order][first]
        bound *= 2  # a coordinate without a dart: look at later ranks


def band_keys(signature: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in signature.reshape(BANDS, ROWS).T:
        key = mix(key * _U(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: sum of the lesser weights over sum of the greater ones."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


def _features(rows: DataFrame, words: int, counted: bool) -> DataFrame:
    """doc_id, text_key, node (the word sequence), band keys and a short signature (a byte a coordinate) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TEXTS):
            texts = batch.column("text").to_pylist()
            nodes, bands, short = [], [], []
            for text, w in zip(texts, words_by_text(texts), strict=True):
                if len(w):
                    sig = dart_signature(*weighted_shingles(w, words, counted))
                    nodes.append(hashlib.blake2b(w.tobytes(), digest_size=16).digest())
                    bands.append(band_keys(sig).tobytes())
                    short.append(sig.astype("u1").tobytes())
                else:  # no words: alike only if equal
                    nodes.append(hashlib.blake2b(text.encode(), digest_size=16, key=b"text").digest())
                    bands.append(b"")
                    short.append(b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(nodes, pa.binary()), pa.array(bands, pa.binary()), pa.array(short, pa.binary())],
                names=["doc_id", "text_key", "node", "keys", "short"],
            )

    return rows.mapInArrow(lean(run), "doc_id long, text_key binary, node binary, keys binary, short binary")


def _least(threshold: float, coordinates: int) -> float:
    return threshold - ERRORS * (threshold * (1 - threshold) / coordinates) ** 0.5


def _alike(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, agreement) of the pairs (a, b, a_short, b_short) whose signatures may reach the threshold."""
    least = _least(threshold, COORDINATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), "u1").reshape(batch.num_rows, -1)
                for c in ("a_short", "b_short")
            )
            agreement = (x == y).mean(axis=1) if batch.num_rows else np.zeros(0)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(agreement)], names=["a", "b", "agreement"])
            yield out.filter(pa.array(agreement >= least))

    return pairs.mapInArrow(lean(run), "a binary, b binary, agreement double")


def _across(crowd: DataFrame, labels: DataFrame, signs: DataFrame, threshold: float, first: int | None) -> DataFrame:
    """Pairs (a, b) of nodes that share a bucket, lie in different components and may reach the threshold.

    ``signs``: node, sign (a signature of bytes), keys (its band keys). With ``first``, of each node outside its
    bucket's largest component only that many partners, the most alike ones.
    """
    named = crowd.select("bucket", "band", "node").join(labels, "node", "left")
    named = named.select("bucket", "band", "node", F.coalesce("label", "node").alias("label"))
    sizes = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("main"))
    rows = named.join(mixed.where("most < all"), "bucket").join(signs, "node")
    entry = F.struct("node", "label", "sign", "keys")
    outside = rows.where("label != main").groupBy("bucket", "band", "main", "all", F.pmod(F.xxhash64("node"), F.ceil((F.col("all") - F.col("most")) / LEFT)).alias("y"))
    blocks = F.ceil(F.col("all") / RIGHT).cast("long")
    members = rows.groupBy(F.col("bucket").alias("_bucket"), F.pmod(F.xxhash64("node"), blocks).alias("_x")).agg(F.collect_list(entry).alias("xs"))
    # the few outside nodes go to the members' blocks, which stay where they were gathered
    sent = outside.agg(F.collect_list(entry).alias("ys")).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    met = sent.join(members, (F.col("bucket") == F.col("_bucket")) & (F.col("x") == F.col("_x")))

    def stacked(entries: list[dict], name: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(e[name] for e in entries), kind).reshape(len(entries), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"a": [], "b": [], "agreement": []}
            for row in range(batch.num_rows):
                band, main, ys, xs = (batch.column(c)[row].as_py() for c in ("band", "main", "ys", "xs"))
                nodes, names = [x["node"] for x in xs], np.array([x["label"] for x in xs], object)
                signs, keys = stacked(xs, "sign", "u1"), stacked(xs, "keys", "<i8")
                least = _least(threshold, signs.shape[1])
                for y in ys:
                    agreement = (np.frombuffer(y["sign"], "u1") == signs).mean(axis=1)
                    # a pair counts in the first band it shares, and once if both lie outside the main component
                    own = (np.frombuffer(y["keys"], "<i8") == keys).argmax(axis=1) == band
                    wanted = np.flatnonzero(own & (agreement >= least) & (names != y["label"]))
                    wanted = [i for i in wanted if names[i] == main or y["node"] < nodes[i]]
                    if first:
                        wanted = sorted(wanted, key=lambda i: -agreement[i])[:first]
                    for i in wanted:
                        out["a"].append(y["node"])
                        out["b"].append(nodes[i])
                        out["agreement"].append(float(agreement[i]))
            yield pa.RecordBatch.from_arrays([pa.array(out["a"], pa.binary()), pa.array(out["b"], pa.binary()), pa.array(out["agreement"], pa.float64())], names=list(out))

    pairs = met.select("band", "main", "ys", "xs").mapInArrow(lean(run), "a binary, b binary, agreement double")
    if first:
        ranked = F.slice(F.sort_array(F.collect_list(F.struct("agreement", "b")), False), 1, first)
        pairs = pairs.groupBy("a").agg(ranked.alias("p")).select("a", F.explode("p.b").alias("b"))
    return pairs.select("a", "b")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float, words: int, counted: bool) -> DataFrame:
    """The pairs (a, b) of nodes whose texts reach the threshold exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TEXTS):
            left, right = (
                [weighted_shingles(w, words, counted) for w in words_by_text(batch.column(c).to_pylist())] for c in ("a_text", "b_text")
            )
            linked = [similarity(x, y) >= threshold - 1e-9 for x, y in zip(left, right, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    texts = stored(_texts(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), nodes, docs), "near-texts")
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(lean(run), "a binary, b binary")


def _texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes, the text of the row that stands for the node."""
    ids = wanted.join(nodes, "node").select("node", F.col("rep.doc_id").alias("i"), F.col("rep.text_key").alias("k"))
    rows = docs.join(ids, (docs.text_key == F.col("k")) & docs.doc_id.eqNullSafe(F.col("i")))
    return rows.select("node", "text").dropDuplicates(["node"])


def _long_signatures(texts: DataFrame, words: int, counted: bool) -> DataFrame:
    """(node, sign) of the texts (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TEXTS):
            found = [
                dart_signature(*weighted_shingles(w, words, counted), LONG).astype("u1").tobytes()
                for w in words_by_text(batch.column("text").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], names=["node", "sign"])

    return texts.mapInArrow(lean(run), "node binary, sign binary")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of the nodes of the links (a, b): label is the least node it is connected with.

    Least labels are spread over the links and then to the label's own label, until nothing
    changes; every round is stored in the shared folder.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "near-links")
    labels = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), "near-labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(seen, labels.node == seen.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("_at"), F.col("label").alias("_next"))
        spread = spread.join(jump, F.col("label") == F.col("_at"), "left")
        new = stored(spread.select("node", "old", F.least("label", "_next").alias("label")), "near-labels")
        labels = new.select("node", "label")
        if new.where("old != label").isEmpty():
            return labels


def near_duplicate_classes(
    docs: DataFrame, threshold: float = SIMILARITY, words: int = WORDS, counted: bool = False
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text_key, class_id, class_size, kept_key, kept.

    Documents are linked if the (weighted) Jaccard similarity of their word shingles reaches
    ``threshold``; classes are the connected components. ``class_id`` is the least doc_id of the class
    (null only if it has no other), and the document with that id is kept; rows that repeat that id and
    its text tie and are marked alike. Words are lower-cased runs of letters and digits; a text of fewer
    than ``words`` words is one shingle. Texts without words (null counts as empty) are linked only to
    equal texts. Other columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("text_key", F.unhex(F.md5("text")))
    features = stored(_features(rows, words, counted), "near-features")
    first = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_key")
    nodes = stored(
        features.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("rep"), F.first("short").alias("short"), F.first("keys").alias("keys")),
        "near-nodes",
    )
    short = nodes.select("node", "short")
    key = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring(F.col("keys"), i * 8 + 1, F.lit(8)))
    bucket = nodes.where(F.octet_length("keys") > 0).select("node", F.posexplode(key).alias("band", "key"))
    bucket = bucket.select("node", "band", F.xxhash64("band", "key").alias("bucket"))
    sizes = bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    crowd = split_join(bucket, sizes, "bucket", "members", int(nodes.count()) * BANDS, F.col("node")).where("group is not null")
    crowd = stored(crowd.select("bucket", "band", "node", "group.members"), "near-buckets")

    # stars
    company = crowd.groupBy("node").agg(F.sum("members").alias("company"))
    centres = crowd.join(company, "node").groupBy("bucket").agg(F.max_by("node", F.struct("company", "node")).alias("centre"))
    stars = crowd.join(centres, "bucket").where("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    a_short = short.select(F.col("node").alias("a"), F.col("short").alias("a_short"))
    b_short = short.select(F.col("node").alias("b"), F.col("short").alias("b_short"))
    near = _alike(stars.join(a_short, "a").join(b_short, "b"), threshold)
    best = stored(near.groupBy("a").agg(F.max_by("b", F.struct("agreement", "b")).alias("b")), "near-stars")
    links = stored(_verified(best, nodes, rows, threshold, words, counted), "near-verified")
    labels = components(links)

    # buckets with several components
    some = stored(_across(crowd, labels, nodes.select("node", F.col("short").alias("sign"), "keys"), threshold, FIRST), "near-some")
    if not some.isEmpty():
        links = links.unionByName(stored(_verified(some, nodes, rows, threshold, words, counted), "near-verified"))
        labels = components(links)
        open_ = crowd.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
        mixed = open_.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y")
        texts = _texts(open_.join(mixed, "bucket").select("node").distinct(), nodes, rows)
        signs = stored(_long_signatures(texts, words, counted).join(nodes.select("node", "keys"), "node"), "near-long")
        rest = stored(_across(crowd, labels, signs, threshold, None), "near-rest")
        if not rest.isEmpty():
            links = links.unionByName(stored(_verified(rest, nodes, rows, threshold, words, counted), "near-verified"))
            labels = components(links)

    known = nodes.join(labels, "node", "left").select("node", "n", "rep", F.coalesce("label", "node").alias("label"))
    classes = known.groupBy("label").agg(F.min("rep").alias("kept"), F.sum("n").alias("size"))
    told = known.join(classes, "label").select("node", "n", "kept", "size")
    out = split_join(features.select("doc_id", "text_key", "node"), told, "node", "n", int(nodes.agg(F.sum("n")).first()[0] or 0), F.struct("doc_id", "text_key"))
    keep: Column = F.col("group.kept")
    return out.select(
        "doc_id", "text_key", keep["doc_id"].alias("class_id"), F.col("group.size").alias("class_size"), keep["text_key"].alias("kept_key"),
        (F.col("doc_id").eqNullSafe(keep["doc_id"]) & (F.col("text_key") == keep["text_key"])).alias("kept"),
    )


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """``docs`` (all columns) with one row of each near-duplicate class."""
    kept = near_duplicate_classes(docs).where("kept").select(F.col("doc_id").alias("_i"), F.col("text_key").alias("_k"))
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.unhex(F.md5(text_of())).alias("_text"))
    # rows that repeat the kept id and text: the join's partitioning serves the removal too
    joined = keyed.join(kept.distinct(), (F.col("_text") == F.col("_k")) & F.col("_doc").eqNullSafe(F.col("_i")), "left_semi")
    single = joined.dropDuplicates(["_text", "_doc"])
    return single.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
