"""Heavy-key split: route only the keys that need it through a skew-safe plan.

Single-pass plans (one window per user, one ``collect_list`` per group) are
the fastest, but they put all rows of a key into one task. They are safe for
keys with at most ``threshold`` rows -- a proven bound. A bounded pre-pass
finds the heavier keys; those take the bucketed / paged plan, every other key
takes the single-pass plan.

The list holds 64-bit hashes of keys, so it is bounded in bytes too: at most
``max_keys`` longs are fetched (``count > threshold`` implies at most
rows/threshold of them). Keys that share a hash are counted together, so a light
key may take the skew-safe plan, which is right at every size, and no heavy
key takes the other one. With more heavy keys ``None`` is returned and the caller uses
the skew-safe plan for all keys. When no key is heavy the heavy branch is an empty local
relation and Catalyst removes it from the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_HOT_KEYS = 100_000

KEY_HASH = "_key_hash"


def heavy_keys(df: DataFrame, key: str, threshold: int, max_keys: int = DEFAULT_MAX_HOT_KEYS) -> list | None:
    """Hashes of the keys ``df[key]`` with more than ``threshold`` rows (at most ``max_keys`` of them).

    ``None`` when more than ``max_keys`` keys are heavy.
    """
    counts = df.groupBy(F.xxhash64(key).alias(KEY_HASH)).agg(F.count(F.lit(1)).alias("_rows"))
    found = counts.where(F.col("_rows") > threshold).select(KEY_HASH).limit(max_keys + 1).collect()
    return None if len(found) > max_keys else found


def hash_list(df: DataFrame, heavy: list) -> DataFrame:
    """The heavy-key hashes as a frame of one long column, small enough to broadcast."""
    return df.sparkSession.createDataFrame(heavy, f"{KEY_HASH} bigint")


def split_keys(df: DataFrame, key: str, heavy: list) -> tuple[DataFrame, DataFrame]:
    """(rows of light keys, rows of heavy keys); the bounded list of hashes is broadcast."""
    hashed = df.withColumn(KEY_HASH, F.xxhash64(key))
    b = F.broadcast(hash_list(df, heavy))
    return hashed.join(b, KEY_HASH, "left_anti").drop(KEY_HASH), hashed.join(b, KEY_HASH, "left_semi").drop(KEY_HASH)


def refine_buckets(
    df: DataFrame,
    key: str,
    coarse: F.Column,
    fine: F.Column,
    hot_rows: int | None,
    max_keys: int = DEFAULT_MAX_HOT_KEYS,
) -> tuple[DataFrame, bool]:
    """Add ``_bkt = struct(b = coarse, s = fine or null)``, ordered like the rows it holds.

    ``fine`` must be non-decreasing in the same order as ``coarse``. A (key,
    coarse bucket) holding more than ``hot_rows`` rows (found by a bounded
    pre-pass) is split by ``fine``; other buckets stay whole (``s`` null).
    With more than ``max_keys`` heavy buckets every bucket is split;
    ``hot_rows=None`` never splits. Returns the frame and whether any bucket
    was split (if not, callers need only one summary level).
    """
    x = df.withColumn("_cb", coarse).withColumn("_fb", fine)
    x = x.withColumn("_hk", F.struct(F.col(key).alias("k"), F.col("_cb").alias("b")))
    heavy = [] if hot_rows is None else heavy_keys(x, "_hk", hot_rows, max_keys)
    if heavy is None:
        split = F.col("_fb")
    elif not heavy:
        split = F.lit(None).cast(x.schema["_fb"].dataType)
    else:
        marks = hash_list(df, heavy).withColumn("_split", F.lit(True))
        x = x.withColumn(KEY_HASH, F.xxhash64("_hk")).join(F.broadcast(marks), KEY_HASH, "left")
        split = F.when(F.col("_split"), F.col("_fb"))
    out = x.withColumn("_bkt", F.struct(F.col("_cb").alias("b"), split.alias("s")))
    return out.drop(*[c for c in ("_hk", KEY_HASH, "_split", "_cb", "_fb") if c in out.columns]), heavy is None or bool(heavy)


def time_buckets(
    df: DataFrame,
    key: str,
    sec: str,
    bucket_seconds: int,
    hot_rows: int | None,
    max_keys: int = DEFAULT_MAX_HOT_KEYS,
) -> tuple[DataFrame, bool]:
    """Add ``_bkt``: ``bucket_seconds``-wide time buckets per key; a heavy (key,
    bucket) -- a burst -- is split into one bucket per whole second, so it is
    spread over many tasks."""
    return refine_buckets(df, key, F.floor(F.col(sec) / F.lit(bucket_seconds)), F.col(sec), hot_rows, max_keys)
