"""Access to the driver's tables, and the footprints derived from them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Footprints are integer boxes computed from orders; the extent grows with the root of their number, so that
#: overlaps are as frequent at any size (small tables keep the least extent).
LEAST, PER_ROOT = (3001, 3011), (20.64, 20.68)

#: The same for SQL: table b(k, c, x0, y0, w, h).
BOXES_SQL = """m AS (
  SELECT greatest(3001, floor(sqrt(count(*)) * 20.64::DOUBLE)::BIGINT) AS mx, greatest(3011, floor(sqrt(count(*)) * 20.68::DOUBLE)::BIGINT) AS my FROM orders
), b AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS price, o_orderkey * 7919 % mx AS x0, o_orderkey * 104729 % my AS y0,
         6 + o_orderkey % 19 AS w, 6 + o_custkey % 17 AS h
  FROM orders, m
), osm AS (
  SELECT 'way/' || k::VARCHAR AS id, k, c, x0, y0, x0 + w AS x1, y0 + h AS y1, w * h AS area FROM b WHERE k % 3 <> 0
), gob AS (
  SELECT 'gob/' || k::VARCHAR AS id, k, c, x0 + c % 9 - 4 AS x0, y0 + c % 7 - 3 AS y0, x0 + w + c % 9 - 4 AS x1, y0 + h + c % 7 - 3 AS y1,
         w * h AS area, 0.5 + (c % 50) / 100.0 AS confidence
  FROM b WHERE k % 4 <> 0
)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("price"))
    n = orders.count()  # from the footer
    mx, my = (max(least, math.floor(math.sqrt(n) * per)) for least, per in zip(LEAST, PER_ROOT))
    return orders.select("k", "c", "price", (F.col("k") * 7919 % mx).alias("x0"), (F.col("k") * 104729 % my).alias("y0"), (6 + F.col("k") % 19).alias("w"), (6 + F.col("c") % 17).alias("h"))


def _corners(df: DataFrame, dx=0, dy=0) -> list:
    x, y = F.col("x0") + dx, F.col("y0") + dy
    return [x.alias("x0"), y.alias("y0"), (x + F.col("w")).alias("x1"), (y + F.col("h")).alias("y1"), (F.col("w") * F.col("h")).alias("area")]


def osm_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).where("k % 3 <> 0")
    return b.select(F.concat(F.lit("way/"), F.col("k").cast("string")).alias("id"), "k", "c", *_corners(b))


def gob_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).where("k % 4 <> 0")
    return b.select(
        F.concat(F.lit("gob/"), F.col("k").cast("string")).alias("id"), "k", "c", *_corners(b, F.col("c") % 9 - 4, F.col("c") % 7 - 3), (0.5 + F.col("c") % 50 / 100.0).alias("confidence")
    )
