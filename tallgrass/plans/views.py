"""Logical relations of rollouts and tokens over the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Number columns of a token, as (name, modulus, scale, offset): (event_id % modulus) / scale + offset.
NUMBERS = (("v", 17, 10, 0.0), ("logp", 5, -10, -1.0), ("old", 7, -10, -1.0), ("roll", 6, -10, -1.0), ("ref", 3, -10, -1.0), ("adv", 11, 5, -1.0), ("pi2", 4, 10, 0.0), ("entropy", 13, 10, 0.0), ("vpred", 19, 10, 0.0), ("ret", 23, 10, 0.0))

TOK = (
    "SELECT user_id AS row_id, user_id % 20 AS uid, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, sqrt(value) / 10 AS r, (event_type <> 'error')::INT AS m, "
    + ", ".join(f"(event_id % {mod})::DOUBLE / {scale} + {offset} AS {name}" for name, mod, scale, offset in NUMBERS)
    + " FROM events"
)
ROLL = "SELECT *, sqrt(l_extendedprice * (1 - l_discount)) AS score, l_orderkey AS uid, l_quantity AS length FROM lineitem"
LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf}/events.parquet")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    numbers = [((F.col("event_id") % mod).cast("double") / scale + offset).alias(name) for name, mod, scale, offset in NUMBERS]
    return ev.select(F.col("user_id").alias("row_id"), (F.col("user_id") % 20).alias("uid"), "event_id", pos.cast("long").alias("pos"), (F.sqrt("value") / 10).alias("r"), (F.col("event_type") != "error").cast("int").alias("m"), *numbers)


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each sequence, with arrays in order of position."""
    cols = ["pos", "r", "m", "v", "logp", "old", "ref", "adv"]
    packed = tokens(spark, sf).groupBy("row_id", "uid").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("x"))
    return packed.select("row_id", "uid", F.col("x.r").alias("token_level_rewards"), F.col("x.m").alias("response_mask"), F.col("x.v").alias("values"), F.col("x.logp").alias("logp"), F.col("x.old").alias("old"), F.col("x.ref").alias("ref"))


def rollouts(spark: SparkSession, sf: str) -> DataFrame:
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.withColumn("score", F.sqrt(F.col("l_extendedprice") * (1 - F.col("l_discount")))).withColumn("uid", F.col("l_orderkey")).withColumn("length", F.col("l_quantity"))


def r6(c, digits: int = 6):
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + 0.0
