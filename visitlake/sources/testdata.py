"""The five tables derived from the shared test parquet (``/root/testdata/sf*``).

The mapping is fixed so that the SQL oracle (``visitlake.plans.oracle``)
derives exactly the same rows with the same expressions:

* users      <- customer (userId = c_custkey)
* orders     <- orders   (userId = o_custkey, orderId = o_orderkey, timestamp = o_orderdate)
* purchases  <- events where event_type = 'purchase' (orders that overlap the logs in time)
* logs       <- events where event_type <> 'purchase', fields derived from props' k
* sources    <- region   (source_id = r_regionkey, source_name = r_name)
* campaigns  <- nation   (uuid = n_nationkey + 2, ...)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlake.sources.tables import Tables, normalise, SCHEMAS


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _k() -> F.Column:
    return F.regexp_extract("props", "[0-9]+", 0).cast("int")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("userId")), SCHEMAS["users"])


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("userId"),
        F.col("o_orderkey").alias("orderId"),
        F.col("o_orderdate").alias("timestamp"),
    )
    return normalise(src, SCHEMAS["orders"])


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = (
        read(spark, sf_dir, "events")
        .where(F.col("event_type") == "purchase")
        .select(F.col("user_id").alias("userId"), F.col("event_id").alias("orderId"), F.col("ts").alias("timestamp"))
    )
    return normalise(src, SCHEMAS["orders"])


def logs(spark: SparkSession, sf_dir: str, with_utm: bool = True) -> DataFrame:
    ev = read(spark, sf_dir, "events").where(F.col("event_type") != "purchase")
    k = _k()
    cols = [
        F.col("ts").alias("timestamp"),
        (k % 6).alias("source_id"),
        F.when((F.col("event_type") == "signup") & (k % 10 == 0), F.lit(None)).otherwise(F.col("user_id")).alias("userId"),
        F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("event_type")).alias("referrer"),
        F.concat(F.lit("/p/"), (k % 20).cast("string")).alias("landing_url"),
    ]
    if with_utm:
        cols.append(
            F.when(k % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("utm_"), (k % 3).cast("string"))).alias("utm_source")
        )
    return normalise(ev.select(*cols), SCHEMAS["logs"])


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = read(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("source_id"), F.col("r_name").alias("source_name")
    )
    return normalise(src, SCHEMAS["sources"])


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    src = read(spark, sf_dir, "nation").select(
        (n + 2).alias("uuid"),
        F.concat(F.lit("T"), F.col("n_regionkey").cast("string")).alias("type"),
        F.when(n % 4 == 3, F.lit(None)).otherwise(F.col("n_name")).alias("description"),
        F.when(n % 5 == 4, F.lit("")).otherwise(
            F.concat(F.lit("/P/"), n.cast("string"), F.lit(", /p/"), (n + 1).cast("string"))
        ).alias("params"),
    )
    return normalise(src, SCHEMAS["campaigns"])


def tables(spark: SparkSession, sf_dir: str, purchase_orders: bool = False, with_utm: bool = True) -> Tables:
    """All five tables; ``purchase_orders`` swaps in the event-time purchases as orders."""
    return Tables(
        users=users(spark, sf_dir),
        orders=purchases(spark, sf_dir) if purchase_orders else orders(spark, sf_dir),
        logs=logs(spark, sf_dir, with_utm=with_utm),
        sources=sources(spark, sf_dir),
        campaigns=campaigns(spark, sf_dir),
    )
