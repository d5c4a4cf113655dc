"""Tables of a data folder, and inputs derived from them with the same SQL in both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = """SELECT c_custkey AS pt_id, CAST((c_custkey * 7919) % 36000 AS DOUBLE) / 100 - 180 AS x,
 CAST((c_custkey * 6007) % 16000 AS DOUBLE) / 100 - 80 AS y, c_acctbal AS v FROM customer"""
AREAS = """SELECT s_suppkey AS area_id, s_suppkey % 5 AS grp, CAST(s_suppkey % 45 AS DOUBLE) * 8 - 180 AS xmin, CAST(s_suppkey % 45 AS DOUBLE) * 8 - 172 AS xmax,
 CAST((FLOOR(CAST(s_suppkey AS DOUBLE) / 45) + 10) % 20 AS DOUBLE) * 8 - 80 AS ymin, CAST((FLOOR(CAST(s_suppkey AS DOUBLE) / 45) + 10) % 20 AS DOUBLE) * 8 - 72 AS ymax FROM supplier"""
ORDERS_N = """SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price_n,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS prio_n, CAST(o_custkey AS VARCHAR(20)) AS cust_txt,
 CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR(20)) END AS mixed_txt FROM orders"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def derived(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    name = re.search(r"FROM (\w+)\s*$", sql)[1]
    df = table(spark, sf, name)
    return spark.sql(re.sub(r"FROM \w+\s*$", "FROM {source}", sql), source=df)


def points(spark, sf) -> DataFrame:
    return derived(spark, sf, POINTS)


def areas(spark, sf) -> DataFrame:
    """One rectangle per supplier, 45 side by side in each of 20 rows; xmin etc. as doubles."""
    df = derived(spark, sf, AREAS)
    return df.select("area_id", "grp", *[F.col(c).cast("double").alias(c) for c in ("xmin", "xmax", "ymin", "ymax")])


def orders_n(spark, sf) -> DataFrame:
    return derived(spark, sf, ORDERS_N)


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded for comparison."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
