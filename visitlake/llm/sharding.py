"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Every source partition permutes its rows locally; how many of them go to each
shard is one row of a matrix drawn from the multivariate hypergeometric law, so
that the row sums are the partition sizes and the column sums the shard sizes.
The rows are exchanged and every shard is permuted again. The result is
a uniform random permutation cut into shards whose sizes are exact.

DataFrame operations only. Besides the rows, only the matrix (partitions x shards
counts) and the partitions' sizes exist. No window or task holds a shard: slots
come from a range-partitioned sort and per-partition offsets.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlake.llm.common import spark_partitions, stored

#: Terms of the hypergeometric law below this share of its mode are left out of a draw.
NEGLIGIBLE = 1e-18


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Counts at most one apart; the first shards take the remainder."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def hypergeometric(good: int, bad: int, draws: int, u: float) -> int:
    """The ``u`` quantile of the number of good items among ``draws``; any size, no approximation.

    Weights follow from the mode by the ratios of neighbouring terms, so no
    large logarithm of a factorial is needed.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    sd = (draws * good * bad / max(1, good + bad) / max(1, good + bad)) ** 0.5
    reach = int(10 * sd) + 40
    up = np.arange(mode, min(high, mode + reach), dtype=float)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=float)
    right = np.cumprod((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)))
    left = np.cumprod(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)))
    weights = np.concatenate([left[::-1], [1.0], right])
    weights[weights < NEGLIGIBLE] = 0.0
    steps = np.cumsum(weights)
    return mode - len(left) + bisect_left(steps, u * steps[-1])


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """A random matrix with these row and column sums, as a uniform permutation would give it."""
    if sum(rows) != sum(columns):
        raise ValueError("row and column sums differ")
    rng, left, out = np.random.default_rng(seed), list(columns), []
    for n in rows:
        rest, need, counts = sum(left), n, []
        for have in left:
            k = hypergeometric(have, rest - have, need, float(rng.random()))
            counts.append(k)
            rest, need = rest - have, need - k
        left = [a - b for a, b in zip(left, counts, strict=True)]
        out.append(counts)
    return out


def _numbered(df: DataFrame, tag: str) -> DataFrame:
    """``df`` stored with its physical partition ``part`` and the row's number ``at`` in it."""
    number = F.monotonically_increasing_id()
    kept = stored(df.withColumn("_number", number), tag)
    return kept.withColumn("_part", F.shiftright("_number", 33)).withColumn("_at", F.col("_number").bitwiseAND((1 << 33) - 1))


def hypergeometric_shards(df: DataFrame, shards: int, by: list[Column], seed: int = 1) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Shard sizes are at most one apart whatever the rows hold; equal rows are spread
    like any others. ``by`` are the columns whose hash with ``seed`` gives the two
    permutations; rows equal in all of them may stand for each other. Null values are
    hashed like any value. Fewer rows than shards leave some shards empty; an empty
    table gives no rows. The columns shard and slot of the input, if any, are replaced.
    """
    rows = df.select(F.struct("*").alias("_row"), *[c.alias(f"_by{i}") for i, c in enumerate(by)])
    names = [f"_by{i}" for i in range(len(by))]

    def order(k: int) -> Column:
        return F.xxhash64(F.lit(f"{seed}/{k}"), *names)

    # local permutation
    local = _numbered(rows.sortWithinPartitions(order(1), *names), "shards-local")
    parts = sorted((r["_part"], r["n"]) for r in local.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    sizes = [n for _, n in parts]
    matrix = communication_matrix(sizes, shard_sizes(sum(sizes), shards), seed)
    # exchange: the first counts[0] rows of a partition go to shard 0, the next counts[1] to shard 1, ...
    bounds = df.sparkSession.createDataFrame(
        [(p, [int(x) for x in np.cumsum(counts)]) for (p, _), counts in zip(parts, matrix, strict=True)],
        "_of long, _bounds array<long>",
    )
    sent = local.join(F.broadcast(bounds), F.col("_part") == F.col("_of")).select(
        "_row", *names, F.size(F.filter("_bounds", lambda b: b <= F.col("_at"))).alias("_shard")
    )
    # second permutation
    n = spark_partitions(df.sparkSession)
    keys = [F.col("_shard"), order(2), *map(F.col, names)]
    dealt = _numbered(sent.repartitionByRange(n, *keys[:2]).sortWithinPartitions(*keys), "shards-dealt")
    runs = sorted(
        (r["_shard"], r["_part"], r["first"], r["n"])
        for r in dealt.groupBy("_shard", "_part").agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    )
    starts, before, last = [], 0, None
    for shard, part, first, count in runs:
        before = before if shard == last else 0
        starts.append((shard, part, before - first))
        before, last = before + count, shard
    shift = df.sparkSession.createDataFrame(starts, "_s int, _p long, _shift long")
    return dealt.join(F.broadcast(shift), (F.col("_shard") == F.col("_s")) & (F.col("_part") == F.col("_p"))).select(
        *[F.col("_row").getField(c).alias(c) for c in df.columns if c not in ("shard", "slot")],
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_at") + F.col("_shift")).cast("long").alias("slot"),
    )
