"""Hot keys are dealt out, whatever adaptive execution does."""

import contextlib

from pyspark.sql import functions as F

from visitlake.llm.common import split_join


@contextlib.contextmanager
def plain_shuffles(spark):
    """Shuffle joins without adaptive execution and without broadcasts that the optimiser chooses."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def most_over_mean(df):
    sizes = [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / (sum(sizes) / int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def test_split_join_deals_a_hot_key(spark):
    n = 100_000
    left = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 5000).cast("string"))).alias("k"), "id")
    groups = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("most"))
    with plain_shuffles(spark):
        done = split_join(left, groups, "k", "n", n, F.col("id"))
        assert most_over_mean(done) < 2
        rows = done.select("k", "id", "group.most").collect()
    want = {r.k: r.most for r in groups.collect()}
    assert len(rows) == n and all(r.most == want[r.k] for r in rows)


def test_split_join_without_groups(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("b", 3), ("b", 3)], "k string, id int")
    groups = spark.createDataFrame([("b", 2), (None, 1)], "k string, n long")
    got = split_join(left, groups, "k", "n", 4, F.col("id")).collect()
    assert sorted((r.id, r.group is not None) for r in got) == [(1, False), (2, False), (3, True), (3, True)]
