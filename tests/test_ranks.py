"""Ranks by range partitions against plain sorting."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from visitlake.operators.ranks import counted, placed, sorted_list_with_repeats


def rows(n=900, seed=3):
    rng = random.Random(seed)
    # a hot group with two thirds of the rows, one value of it with half of these; shared prefixes; nulls
    out = [(rng.choice(("hot", "hot", "a", None)), rng.choice((f"/same/prefix/{rng.randrange(80)}", "/same/prefix/1", None))) for _ in range(n)]
    return out + [("nulls", None)] * 5


def lists(data):
    want = {}
    for k, v in data:
        if v is not None:
            want.setdefault(k, []).append(v)
    return {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("page,partitions", [(1, 7), (10, 7), (64, 1), (100, 40), (10**6, 3)])
def test_pages_of_sorted_lists(spark, page, partitions):
    df = spark.createDataFrame(rows(), "k string, v string").repartition(5)
    got = sorted_list_with_repeats(df, ["k"], F.col("v"), "vs", page, partitions=partitions).collect()
    want = {}
    for k, v in lists(rows()).items():
        for p in range(0, len(v), page):
            want[k, p // page] = (v[p:p + page], None if p else len(v), None if p else len(set(v)))
    assert {(r.k, r.page): (list(r.vs), r.total, r.distinct_total) for r in got} == want and len(got) == len(want)


def test_a_hot_group_is_dealt_out(spark):
    df = spark.range(40_000).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    done = placed(counted(df, ["k"], F.col("v")), 8)
    assert [r[0] for r in done.orderBy("_value").select("_before").collect()] == list(range(40_000))
    plan = done._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    over_values = [line for line in windows if "_value" in line]
    assert over_values and all("windowspecdefinition(_part" in line for line in over_values)  # none over all values of a group


def test_empty(spark):
    df = spark.createDataFrame([], "k string, v string")
    assert sorted_list_with_repeats(df, ["k"], F.col("v"), "vs", 3).count() == 0
    with pytest.raises(ValueError, match="page_size"):
        sorted_list_with_repeats(df, ["k"], F.col("v"), "vs", 0)
