"""Exact deduplication by a stateful stream.

A streaming aggregation keyed by the text digest keeps, in the disk-backed
(RocksDB) state store and without expiry, one state row per digest: the digest,
the identifier of the row that stays and the locator of its content (file and
row number), plus the number of rows seen. Rows whose digest was hit more than
once are then checked byte by byte against the content at the locator; rows that
differ in spite of an equal digest are grouped by their whole text.

DataFrame operations only. A group may hold any share of the rows: the state is
aggregated before the shuffle, group facts reach the rows by ``split_join``, and
the content of a large group is replicated to salted keys for the byte check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlake.llm.common import shared_folder, split_join, stored, text_of

#: Rows of one group that one salted key of the byte check takes.
ROWS_PER_SALT = 500

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # many small stores: without this each one sets aside megabytes of disk for its log
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
_LOCATOR = ("_metadata.file_path", "_metadata.row_index")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(df: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """doc_id, text, digest and locator (file, row) of each row."""
    return df.select(
        F.col("doc_id"), text_of().alias("text"), F.col(_LOCATOR[0]).alias("file"), F.col(_LOCATOR[1]).alias("row")
    ).withColumn("digest", digest(F.col("text")))


def duplicate_state(
    spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None
) -> DataFrame:
    """Run the stream over the parquet table at ``path``; the state as (digest, n, rep).

    ``rep`` (doc_id, file, row) is the row with the largest doc_id (null lowest; of
    equal ids the last by file and row). ``files_per_batch`` bounds a micro-batch.
    """
    whole = spark.read.parquet(path).schema
    schema = T.StructType([whole["doc_id"], whole["text"]])
    folder = shared_folder(spark, "exact-dedup")
    source = spark.readStream.schema(schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    # as a pattern (its last character in brackets): a plain path would have to be a folder
    pattern = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    seen = _rows(source.parquet(pattern), digest).groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "file", "row")).alias("rep")
    )
    fields = [T.StructField(f.name, f.dataType, True) for f in seen.schema]
    spark.createDataFrame([], T.StructType(fields)).write.parquet(f"{folder}/state/batch=-1")

    def changed(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/state/batch={batch}")

    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        query = (
            seen.writeStream.outputMode("update").foreachBatch(changed)
            .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    updates = spark.read.schema(T.StructType(fields)).parquet(f"{folder}/state")
    # n grows with every update of a digest, so the largest n is the last state
    last = updates.groupBy("digest").agg(F.max(F.struct("n", "rep")).alias("s"))
    return last.select("digest", "s.n", "s.rep")


def exact_duplicates(
    spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None
) -> DataFrame:
    """One row per row of the parquet table at ``path`` (doc_id, text; other columns are ignored).

    doc_id, keep_id (doc_id of the row of the group that stays), group_size, kept,
    text_sha256, and the locator (keep_file, keep_row) of the kept content.

    Texts are equal when their bytes are; null counts as empty, and empty texts are one
    group. Of equal texts the largest doc_id stays (null is the lowest); rows that repeat
    the largest doc_id tie, and exactly one of them, the last by file and row, stays.
    An empty table gives no rows.
    """
    groups = stored(duplicate_state(spark, path, digest, files_per_batch), "exact-dedup-state")
    total = int(groups.agg(F.sum("n")).first()[0] or 0)
    docs = _rows(spark.read.parquet(path), digest)
    many = groups.where("n > 1")
    spread = F.struct("file", "row")

    # the byte check: members of groups against the content at the group's locator
    members = stored(
        split_join(docs, many, "digest", "n", total, spread).where("group is not null")
        .select("doc_id", "file", "row", "text", "digest", "group.n", "group.rep"),
        "exact-dedup-members",
    )
    is_rep = (F.col("file") == F.col("rep.file")) & (F.col("row") == F.col("rep.row"))
    salts = F.ceil(F.col("n") / ROWS_PER_SALT).cast("int")
    content = members.where(is_rep).select(
        F.col("digest").alias("c_digest"), F.col("text").alias("c_text"),
        F.explode(F.sequence(F.lit(0), salts - 1)).alias("c_salt"),
    )
    hits = members.where(~is_rep).withColumn("salt", F.pmod(F.xxhash64(spread), salts).cast("int"))
    differs = stored(
        hits.join(content, (hits.digest == content.c_digest) & (hits.salt == content.c_salt))
        .where(F.col("text") != F.col("c_text")).select("doc_id", "file", "row", "text", "digest"),
        "exact-dedup-differs",
    )
    strays = differs.groupBy("digest", "text").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "file", "row")).alias("rep")
    )
    stray_rows = differs.join(strays, ["digest", "text"]).select(
        F.col("file").alias("s_file"), F.col("row").alias("s_row"), F.struct("n", "rep").alias("stray")
    )

    wrong = differs.groupBy("digest").agg(F.count(F.lit(1)).alias("wrong"))
    groups = groups.join(wrong, "digest", "left").select(
        "digest", F.col("n").alias("rows"), (F.col("n") - F.coalesce("wrong", F.lit(0))).alias("n"), "rep"
    )
    narrow = docs.select("doc_id", "file", "row", "digest", F.sha2("text", 256).alias("text_sha256"))
    told = split_join(narrow, groups, "digest", "rows", total, spread)
    told = told.join(stray_rows, (told.file == F.col("s_file")) & (told.row == F.col("s_row")), "left")
    own = F.coalesce(F.col("stray"), F.struct(F.col("group.n"), F.col("group.rep")))
    return told.withColumn("own", own).select(
        "doc_id",
        F.col("own.rep.doc_id").alias("keep_id"),
        F.col("own.n").cast("long").alias("group_size"),
        ((F.col("file") == F.col("own.rep.file")) & (F.col("row") == F.col("own.rep.row"))).alias("kept"),
        "text_sha256",
        F.col("own.rep.file").alias("keep_file"),
        F.col("own.rep.row").alias("keep_row"),
    )
