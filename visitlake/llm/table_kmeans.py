"""Centroid clustering of integer vectors by scalar lookup tables.

Components become integers, so a dimension takes few values. The vectors are stored once as codes: per block of rows,
the values that occur in each dimension, ascending, and for each component its place among them. A round
tabulates, per dimension, occurring value and centroid, the squared difference; a vector's distances are gathered from the
tables by its codes and summed. All numbers are integers, so results do not depend on partitions or order.

A round reads the codes where they lie and sends back, per partition and centroid, a count and a sum per
dimension, added up by Spark; the driver holds the centroids alone (their number times the dimensions). Tables and codes
are bounded by a block's rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlake.llm.common import ship, stored

DIMENSIONS, CENTROIDS, ROUNDS, SEED = 64, 8, 10, 3
SCALE = 1024.0
#: Rows of a block.
BLOCK = 4096
#: Components are less than this in size, so that a squared distance is a 64-bit integer.
LARGEST = 1 << 27


def integer_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, v array<long>) of the vectors with exactly ``dimensions`` components, none null or non-finite: floor(1024 * x)."""
    x = F.transform(F.col("embedding"), lambda e: e.cast("double"))
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    kept = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == dimensions) & ~F.coalesce(odd, F.lit(True)))
    # beyond the largest size all is one value, which the coding refuses
    bound = float(LARGEST)
    whole = F.transform(x, lambda e: F.floor(F.greatest(F.least(e * SCALE, F.lit(bound)), F.lit(-bound - 1))).cast("long"))
    return kept.select("vec_id", whole.alias("v"))


def _codes(vectors: DataFrame, dimensions: int) -> DataFrame:
    """Blocks (vec_ids, codes, values, sizes): packed places of the components, packed occurring values, their number by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                flat = part.column("v").flatten().to_numpy().reshape(part.num_rows, dimensions)
                if np.abs(flat).max(initial=0) >= LARGEST:
                    raise ValueError(f"a component of a vector is {LARGEST / SCALE:.0f} or more in size")
                codes, values = np.empty((dimensions, part.num_rows), "<u2"), []
                for d in range(dimensions):
                    occurring, codes[d] = np.unique(flat[:, d], return_inverse=True)
                    values.append(occurring.astype("<i8"))
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("vec_id"))
                sizes = pa.array([[len(x) for x in values]], pa.list_(pa.int32()))
                packed = [pa.array([x], pa.binary()) for x in (codes.tobytes(), np.concatenate(values).tobytes())]
                yield pa.RecordBatch.from_arrays([ids, *packed, sizes], names=["vec_ids", "codes", "values", "sizes"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return stored(vectors.mapInArrow(run, f"vec_ids array<{kind}>, codes binary, values binary, sizes array<int>"), "kmeans-codes")


class Block:
    """One block's codes and occurring values."""

    def __init__(self, codes: bytes, values: bytes, sizes: list[int]):
        self.codes = np.frombuffer(codes, "<u2").reshape(len(sizes), -1)
        cuts = np.cumsum([0, *sizes])
        every = np.frombuffer(values, "<i8")
        self.values = [every[a:b] for a, b in zip(cuts, cuts[1:])]

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector (the smaller number on a tie) and its squared distance."""
        total = np.zeros((self.codes.shape[1], len(centroids)), np.int64)
        for d, values in enumerate(self.values):
            table = (values[:, None] - centroids[None, :, d]) ** 2
            total += table[self.codes[d]]
        best = total.argmin(axis=1)
        return best, total[np.arange(len(best)), best]

    def sums(self, best: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Count and componentwise sum of the vectors of each of ``k`` centroids: occurrences of each value times the value."""
        sums = np.empty((k, len(self.values)), np.int64)
        for d, values in enumerate(self.values):
            seen = np.bincount(best * len(values) + self.codes[d], minlength=k * len(values))
            sums[:, d] = seen.reshape(k, -1) @ values
        return np.bincount(best, minlength=k), sums


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, pa.Array]]:
    for batch in batches:
        for i in range(batch.num_rows):
            cell = {n: batch.column(n)[i] for n in batch.schema.names}
            yield Block(cell["codes"].as_py(), cell["values"].as_py(), cell["sizes"].as_py()), cell["vec_ids"].values


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:vec_id``, in that order; ties by their components, null vec_ids last."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(name.alias("name"), "v").orderBy(F.col("name").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def moved(codes: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of each one's mean vector; those without vectors stay."""
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), object)
        for block, _ in _blocks(batches):
            n, s = block.sums(block.nearest(centroids)[0], k)
            counts += n
            sums += s
        if counts.any():
            kind = pa.list_(pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([
                pa.array(range(k), pa.int32()), pa.array(counts), pa.array([[Decimal(int(x)) for x in s] for s in sums], kind),
            ], names=["c", "n", "s"])

    found = codes.select("codes", "values", "sizes", "vec_ids").mapInArrow(run, "c int, n long, s array<decimal(38,0)>")
    total = [F.sum(F.get("s", F.lit(d))).alias(f"s{d}") for d in range(dimensions)]
    after = centroids.copy()
    for row in found.groupBy("c").agg(F.sum("n").alias("n"), *total).collect():  # one row a centroid
        if row["n"]:
            after[row["c"]] = [int(row[f"s{d}"]) // int(row["n"]) for d in range(dimensions)]
    return after


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS) -> DataFrame:
    """One row (vec_id, cluster, distance, cluster_inertia, inertia, centroid) per kept vector of ``vectors`` (vec_id, embedding).

    Kept are vectors of exactly ``dimensions`` components, none null or non-finite. With fewer than ``k`` of them
    there are as many centroids; without any, no rows. ``distance`` is squared; the inertias are its sums over the cluster and
    over all; ``centroid`` has the final components. Repeated rows count and are returned each, a null vec_id stays
    null, other columns are ignored. Components of 131072 or more in size are an error: their distances are no longs.
    Rounds that change nothing end the work early, as all later ones would change nothing either.
    """
    spark = vectors.sparkSession
    ship(spark)
    whole = integer_vectors(vectors, dimensions)
    kind = whole.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(whole, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    codes = _codes(whole, dimensions)
    for _ in range(rounds):
        after = moved(codes, centroids)
        if (after == centroids).all():
            break
        centroids = after

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids in _blocks(batches):
            best, distance = block.nearest(centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    assigned = stored(codes.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "kmeans-assigned")
    per = {r["cluster"]: int(r["i"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("i")).collect()}
    told = spark.createDataFrame(
        [(c, i, sum(per.values()), centroids[c].tolist()) for c, i in per.items()],
        "_cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return assigned.join(F.broadcast(told), F.col("cluster") == F.col("_cluster")).drop("_cluster")
