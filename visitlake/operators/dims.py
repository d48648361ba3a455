"""Dimension lookups (sources, campaigns, URL maps) with a checked broadcast.

A dimension is broadcast only after a bounded probe proves it has at most
``max_rows`` rows and ``max_bytes`` bytes: ``take(max_rows + 1)`` of the rows' sizes (one
long each) scans partitions incrementally and stops as soon as the row bound is
exceeded.
Beyond the bound the dimension is joined by shuffle, and hot fact keys are
split off explicitly (not left to the cluster's AQE settings): a bounded
pre-pass lists fact keys with more than ``hot_rows`` rows; their dimension
rows -- a slice bounded by the key count -- are broadcast to the hot fact rows,
and every other key takes the shuffled join, where no key is heavy. With more hot
keys than the pre-pass lists, and on streams (which cannot be counted beforehand),
fact rows are salted and the dimension is repeated once per salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlake.operators.skew import DEFAULT_MAX_HOT_KEYS, KEY_HASH, hash_list, heavy_keys, split_keys

# Broadcast bound for narrow dimension projections (a few short columns).
DEFAULT_MAX_BROADCAST_ROWS = 200_000
# Broadcast bound on the bytes of those rows.
DEFAULT_MAX_BROADCAST_BYTES = 64 << 20
# Fact rows per key above which a shuffled join would concentrate a key in one task.
DEFAULT_JOIN_HOT_ROWS = 1_000_000
# Parts of a key, and copies of the dimension, in a salted join.
DEFAULT_SALTS = 16


def _bytes(field: T.StructField) -> Column:
    """Size of a value: 8 bytes, and the length of texts and of nested values as JSON."""
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        col = F.to_json(F.struct(col))
    elif not isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.lit(8)
    return F.coalesce(F.octet_length(col), F.lit(0)) + F.lit(8)


def has_at_most(df: DataFrame, max_rows: int, max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> bool:
    """True when ``df`` has no more than ``max_rows`` rows and ``max_bytes`` bytes (bounded probe job)."""
    size = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        size = size + _bytes(field)
    found = df.select(size.alias("_")).take(max_rows + 1)
    return len(found) <= max_rows and sum(r[0] for r in found) <= max_bytes


def salted_join(fact: DataFrame, dim: DataFrame, keys: list[str], how: str, salts: int = DEFAULT_SALTS) -> DataFrame:
    """``fact`` joined to ``dim`` with every key in ``salts`` parts (by the row's content)."""
    spread = [F.col(f"`{f.name}`") for f in fact.schema.fields if "map<" not in f.dataType.simpleString()]
    left = fact.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def join_dimension(
    fact: DataFrame,
    dim: DataFrame,
    on,
    how: str = "inner",
    max_rows: int | None = DEFAULT_MAX_BROADCAST_ROWS,
    hot_rows: int | None = DEFAULT_JOIN_HOT_ROWS,
    max_hot_keys: int = DEFAULT_MAX_HOT_KEYS,
    probe: DataFrame | None = None,
    max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Join a fact table to a dimension on key column name(s).

    A proven-small dimension is broadcast. ``probe`` is what the probe looks at instead of an
    aggregated ``dim`` (the rows it is aggregated from, so that the probe stops early). Otherwise fact keys with more than
    ``hot_rows`` rows are joined against a broadcast slice of the dimension
    (their rows only, size-probed) and the rest by shuffle.
    """
    if max_rows is not None and max_rows > 0 and has_at_most(dim if probe is None else probe, max_rows, max_bytes):
        return fact.join(F.broadcast(dim), on, how)
    if hot_rows is None or how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        return fact.join(dim, on, how)
    keys = [on] if isinstance(on, str) else list(on)
    if fact.isStreaming:
        return salted_join(fact, dim, keys, how)
    jk = F.struct(*[F.col(f"`{k}`") for k in keys]).alias("_jk")
    keyed = fact.withColumn("_jk", jk)
    heavy = heavy_keys(keyed, "_jk", hot_rows, max_hot_keys)
    if heavy is None:
        return salted_join(fact, dim, keys, how)
    if not heavy:
        return fact.join(dim, on, how)
    light, hot = split_keys(keyed, "_jk", heavy)
    hashed = dim.withColumn(KEY_HASH, F.xxhash64(jk))
    hot_dim = hashed.join(F.broadcast(hash_list(dim, heavy)), KEY_HASH, "left_semi").drop(KEY_HASH)
    if not has_at_most(hot_dim, max(max_rows or 0, max_hot_keys), max_bytes):
        return salted_join(fact, dim, keys, how)
    return light.drop("_jk").join(dim, on, how).unionByName(hot.drop("_jk").join(F.broadcast(hot_dim), on, how))
