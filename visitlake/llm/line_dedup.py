"""Removal of lines that spread over many sites.

Per line hash, a HyperLogLog sketch of the sites that hold the line is merged by
aggregation. Lines whose estimate is clearly below the threshold stay, lines clearly
above are boilerplate; those near it get an exact distinct count. Every occurrence of a
boilerplate line goes but the first (smallest doc_id, then position), so the corpus
still holds the line once.

DataFrame operations only. Texts are shuffled once, at the end, and only those that
lose lines are rebuilt; a line that a third of all documents hold is aggregated before
the shuffle and meets its documents through ``split_join``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlake.llm.common import split_join, stored, text_of

#: A line on half of all distinct sites is boilerplate, but not below the first and always from the second number on.
FEW_SITES, MIN_SITES = 3, 10
#: log2 of the sketch's registers: a standard error of 1.04 / sqrt(2^12), 1.6 percent.
LG_K = 12
#: Estimates within this share of the threshold (12 standard errors) are counted exactly.
NEAR = 0.2


def line_of(line: Column) -> Column:
    """What makes lines equal: their characters without leading and trailing spaces."""
    return F.trim(line)


def sites_needed(docs: DataFrame, site: str = "source") -> int:
    """Distinct sites from which a line of ``docs`` is boilerplate: half of them, at least ``FEW_SITES`` and at most ``MIN_SITES``."""
    n = docs.select(F.coalesce(F.col(site).cast("string"), F.lit("")).alias("s")).distinct().limit(2 * MIN_SITES).count()
    return min(MIN_SITES, max(FEW_SITES, -(-n // 2)))


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes of the lines on at least ``min_sites`` sites, with their number of occurrences and the first one.

    ``lines``: hash, site, doc_id, pos.
    """
    first = F.min(F.struct("doc_id", "pos", "row_key")).alias("first")
    spread = lines.groupBy("hash").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.count(F.lit(1)).alias("n"), first
    )
    # a line can't be on more sites than it has occurrences
    spread = stored(spread.where(F.col("n") >= min_sites), "line-spread")
    far = spread.where(F.col("sites") > min_sites * (1 + NEAR)).select("hash", "n", "first")
    near = spread.where(F.col("sites").between(min_sites * (1 - NEAR), min_sites * (1 + NEAR)))
    total = int(near.agg(F.sum("n")).first()[0] or 0)
    exact = (
        split_join(lines.select("hash", "site", "pos", "row_key"), near.select("hash", "n"), "hash", "n", total,
                   F.struct("row_key", "pos"))
        .where("group is not null").select("hash", "site").distinct()
        .groupBy("hash").agg(F.count(F.lit(1)).alias("exact"))
    )
    close = near.join(exact.where(F.col("exact") >= min_sites), "hash").select("hash", "n", "first")
    return far.unionByName(close)


def drop_boilerplate_lines(docs: DataFrame, min_sites: int | None = None, site: str = "source") -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; all rows and columns stay.

    Adds the struct ``line_dedup`` (n_lines, n_removed). Lines are cut at newlines and
    compared without surrounding spaces; lines that are empty then never go. A null text
    or site is read as empty. Documents may end up empty. Rows with the same doc_id and text
    are treated alike: both keep the first occurrence if one does. An empty table gives no rows.
    ``min_sites``: distinct sites of a boilerplate line, by ``sites_needed`` if None.
    """
    min_sites = sites_needed(docs, site) if min_sites is None else min_sites
    text = text_of()
    row_key = F.md5(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                                F.coalesce(F.col(site).cast("string"), F.lit("")), text))
    cut = docs.select(
        "doc_id", row_key.alias("row_key"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"),
        F.posexplode(F.split(text, "\n")).alias("pos", "line"),
    ).withColumn("line", line_of(F.col("line")))
    lines = cut.where("line != ''").select("doc_id", "row_key", "site", "pos", F.unhex(F.md5("line")).alias("hash"))
    lines = stored(lines, "lines")
    found = stored(boilerplate_lines(lines, min_sites), "line-boilerplate")
    total = int(found.agg(F.sum("n")).first()[0] or 0)
    hit = split_join(lines, found, "hash", "n", total, F.struct("row_key", "pos")).where("group is not null")
    first = F.col("group.first")
    gone = hit.where((F.col("row_key") != first["row_key"]) | (F.col("pos") != first["pos"]))
    per_doc = gone.groupBy(F.col("row_key").alias("_gone_key")).agg(F.collect_set("pos").alias("_gone"))

    # the split lines travel instead of the text, so that the rebuild reads them by position
    others = [c for c in docs.columns if c not in ("text", "line_dedup")]
    rows = docs.select(
        F.struct(*others).alias("_row"), row_key.alias("_key"), F.split(F.col("text").cast("string"), "\n").alias("_lines")
    )
    both = rows.join(per_doc, F.col("_key") == F.col("_gone_key"), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_gone", F.array().cast("array<int>")))
    new = F.array_join(F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(F.transform(left, lambda i: F.get("_lines", i))), "\n")
    counts = F.struct(
        F.when(F.col("_lines").isNull(), 1).otherwise(F.size("_lines")).alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).alias("n_removed"),
    )
    return both.select(
        *[new.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns if c != "line_dedup"],
        counts.alias("line_dedup"),
    )
