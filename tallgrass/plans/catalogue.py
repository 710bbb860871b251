"""Named queries over the driver's tables, each beside its reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that gives the same rows where there is one."""

    def put(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return put


def _load() -> None:
    """Modules of queries register theirs when they are imported."""
    from tallgrass.plans import data, rows, training  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


@query(
    "adv_grpo",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
              round(CASE WHEN n = 1 THEN score ELSE score - mean END / (coalesce(sd, 1) + 1e-6), 4) + 0.0 AS advantage
       FROM (SELECT *, l_extendedprice * (1 - l_discount) AS score,
                    count(*) OVER w AS n, avg(l_extendedprice * (1 - l_discount)) OVER w AS mean,
                    stddev_samp(l_extendedprice * (1 - l_discount)) OVER w AS sd
             FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))""",
)
def adv_grpo(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey")
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("score", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    n, mean, sd = F.count("*").over(w), F.avg("score").over(w), F.stddev_samp("score").over(w)
    adv = F.when(n == 1, F.col("score")).otherwise(F.col("score") - mean) / (F.coalesce(sd, F.lit(1.0)) + 1e-6)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.round(adv, 4) + 0.0).alias("advantage"))
