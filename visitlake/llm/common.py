"""Helpers shared by the operators: table access, shared folders, skew-safe joins, file handles."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlake.session import ensure_checkpoint_dir

#: A key with more rows than max(this, rows / HOT_KEYS) counts as hot; by pigeonhole at most HOT_KEYS keys are.
HOT_FLOOR = 1000
HOT_KEYS = 1000
SALTS = 1 << 20
#: Texts of a record batch that are worked on at once.
TEXTS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder name under the folder that driver and executors share (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a lost executor re-reads it, nothing is computed twice."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_join(left: DataFrame, groups: DataFrame, key: str, count: str, total: int, spread: Column) -> DataFrame:
    """``left`` with the struct ``group`` of its key's row in ``groups`` (null if there is none).

    ``groups`` has one row per key and the key's number of ``left`` rows in ``count``;
    ``total`` is at least the sum of those counts. Keys above ``max(HOT_FLOOR, total / HOT_KEYS)``
    rows number at most ``HOT_KEYS``, so their group rows are broadcast and their ``left`` rows
    are dealt out by ``spread``; all other keys meet in a shuffle join where no key is hot.
    """
    limit = max(HOT_FLOOR, -(-total // HOT_KEYS))
    packed = groups.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(count).alias("_n"), F.struct(*groups.columns).alias("_g"))
    hot = packed.where(F.col("_n") > limit).select(F.col("_key").alias("_hk"), F.col("_g").alias("_hg"))
    # one struct as the key: a literal salt as a key of its own would be folded into the condition, and the key dealt alone
    cold = packed.where(F.col("_n") <= limit).select(F.struct(F.col("_key").alias("k"), F.lit(0).alias("s")).alias("_at"), F.col("_g").alias("_cg"))
    tagged = left.join(F.broadcast(hot), left[key] == F.col("_hk"), "left")
    salted = tagged.withColumn(
        "_salt", F.when(F.col("_hk").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(SALTS))).cast("int")
    )
    dealt = salted.withColumn("_to", F.struct(F.col(key).alias("k"), F.col("_salt").alias("s")))
    joined = dealt.join(cold, F.col("_to") == F.col("_at"), "left")
    return joined.select(*[left[c] for c in left.columns], F.coalesce("_hg", "_cg").alias("group"))


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, as ``--py-files`` would; once per context."""
    sc = spark.sparkContext
    if _SHIPPED.get("context") == sc.applicationId:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="visitlake-py-")) / "visitlake.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    _SHIPPED["context"] = sc.applicationId


_SHIPPED: dict[str, str] = {}


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``; at its end the worker returns its free memory, which else stays with it for all tasks to come."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def slices(batches: Iterator, rows: int) -> Iterator:
    """The record batches in slices of at most ``rows`` rows, so that what is made of them is held for so many at once."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def give_back() -> None:
    """Return what this process has freed to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def spark_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _filesystem(uri: str):
    from pyarrow import fs

    for mine, theirs in (("s3a://", "s3://"), ("s3n://", "s3://")):
        uri = uri.replace(mine, theirs, 1) if uri.startswith(mine) else uri
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@contextmanager
def new_file(folder: str, stem: str, suffix: str) -> Iterator[tuple[str, object]]:
    """Open a new file of ``folder`` for writing; yields (its name, the stream).

    The name is unique to the attempt, so retried and speculative tasks never
    write the same file; a file counts only once its name is in a stored result.
    """
    name = f"{stem}-{uuid.uuid4().hex}{suffix}"
    store, path = _filesystem(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}", compression=None) as out:
        yield name, out


class Ranges:
    """Range reads of the files of one folder; keeps the last file open."""

    def __init__(self, folder: str):
        self._store, self._path = _filesystem(folder)
        self._name, self._file = None, None

    def open(self, name: str):
        if name != self._name:
            self.close()
            self._name, self._file = name, self._store.open_input_file(f"{self._path}/{name}")
        return self._file

    def size(self, name: str) -> int:
        return self.open(name).size()

    def read(self, name: str, offset: int, length: int) -> bytes:
        data = self.open(name).read_at(length, offset)
        if len(data) != length:
            raise OSError(f"{name}: {len(data)} of {length} bytes at {offset}")
        return data

    def close(self) -> None:
        if self._file is not None:
            self._file.close()
        self._name, self._file = None, None
