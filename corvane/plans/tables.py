"""Input tables, and the relations that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, w): line items by the nations of their supplier and customer. Line items are counted by
    order and supplier nation before they meet the orders."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    items = table(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey", "src").agg(F.count("*").alias("w"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def top_trade(spark: SparkSession, sf_dir: str, k: int = 2) -> DataFrame:
    """The k heaviest edges of every nation, without self loops."""
    w = Window.partitionBy("src").orderBy(F.desc("w"), "dst")
    return trade(spark, sf_dir).filter("src != dst").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("grp"))


TRADE_SQL = """trade AS (
  SELECT s.s_nationkey AS src, c.c_nationkey AS dst, count(*)::BIGINT AS w
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2)"""
TOP_SQL = TRADE_SQL + """, top2 AS (
  SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM trade WHERE src <> dst) WHERE r <= 2)"""
