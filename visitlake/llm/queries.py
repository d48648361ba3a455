"""The registered queries ``opN_<name>``: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlake.llm import (
    brown_lm, capture_fim, chunk_bpe, dart_minhash, decontaminate, exact_dedup, line_dedup, prefix_bpe, quality_cnn, sharding,
    table_kmeans, token_frames, warc,
)
from visitlake.llm.common import table, text_of

SHARDS = 24
PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"
MULTI_RANKS = "byte_bpe_multi_50k.tiktoken"


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(F.col("text")), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
    )
    dealt = sharding.hypergeometric_shards(rows, SHARDS, [F.col("doc_id"), F.col("size"), F.col("text_crc32")])
    return dealt.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.brown_scores(table(spark, sf_dir, "documents"))


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archived(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality_cnn.quality_scores(docs.select("doc_id", "text"), labels)
    score = F.col("quality_score")
    return scored.select(
        "doc_id", (quality_cnn.fold(F.col("doc_id")) == 0).alias("held_out"), score.alias("score"),
        (score >= quality_cnn.GOOD).cast("int").alias("predicted"),
    )


def op6_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.piece_ids(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_boilerplate_lines(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", F.col("line_dedup.n_lines").alias("n_lines"), F.col("line_dedup.n_removed").alias("n_removed"),
        F.sha2(text_of(), 256).alias("text_sha256"),
    )


def op9_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_frames.token_files(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_MODEL))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dart_minhash.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "kept")


def op11_capture_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = capture_fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(capture_fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_table_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table_kmeans.clusters(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest)


def op13_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = tokenizer_path(MULTI_RANKS)
    encoded = chunk_bpe.encode_texts(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    decoded = chunk_bpe.decode_ids(encoded, ranks)
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_hypergeometric_shards": op2_hypergeometric_shards,
    "op3_brown_classes": op3_brown_classes,
    "op4_warc_index": op4_warc_index,
    "op5_quality_cnn": op5_quality_cnn,
    "op6_prefix_table": op6_prefix_table,
    "op7_decontaminate": op7_decontaminate,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_frames": op9_token_frames,
    "op10_dart_minhash": op10_dart_minhash,
    "op11_capture_fim": op11_capture_fim,
    "op12_table_kmeans": op12_table_kmeans,
    "op13_chunk_bpe": op13_chunk_bpe,
}
