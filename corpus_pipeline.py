"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of ``documents``. ``run`` writes every stage's result as
Parquet to the shared folder and reads it again for the next.

Nulls, empty texts and repeated rows follow the stages' operators: a null text counts as empty and
stays null where it is returned; an empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlake.llm import dart_minhash, decontaminate, line_dedup, prefix_bpe, quality_cnn
from visitlake.llm.common import shared_folder, stored, table
from visitlake.llm.queries import PIECE_MODEL, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of ``sf_dir``, does not reject."""
    scored = quality_cnn.quality_scores(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))
    return scored.where(F.col("quality_score") >= quality_cnn.GOOD).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated lines that spread over many sites; ``n_chars`` follows the text."""
    done = line_dedup.drop_boilerplate_lines(docs)
    changed = F.when(F.col("line_dedup.n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", changed).select(*docs.columns) if "n_chars" in docs.columns else done.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return dart_minhash.one_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to; the ids lie in the Parquet table ``tokens_path`` (doc_id, n_tokens, ids)."""
    path = shared_folder(spark, "pipeline-tokens")
    prefix_bpe.piece_ids(docs, tokenizer_path(PIECE_MODEL), keep_ids=True, keep_decoded=False).write.parquet(path)
    return spark.read.parquet(path).drop("ids").withColumn("tokens_path", F.lit(path))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL cannot express the classifier, the signatures or the encoder; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
