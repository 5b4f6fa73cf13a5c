"""The driver's tables, and series made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from seriesforge.functions.scalars import rounded

#: A month of events is ten minutes of axis.
MICROS_A_MINUTE = 259_200_000_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices (chart, t, v, seq) of one series a user; values are not clamped."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value", micros.alias("us"))
    since = (F.col("us") - F.min("us").over(W.partitionBy("user_id"))) / F.lit(MICROS_A_MINUTE)
    return events.select(F.col("user_id").alias("chart"), rounded(since, 4).alias("t"), F.col("value").alias("v"), F.col("event_id").alias("seq"))


POINTS_SQL = """points AS (
  SELECT user_id AS chart, event_id AS seq, value AS v,
    floor((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / CAST(259200000000 AS DOUBLE) * 1e4 + 5e-1) / 1e4 AS t
  FROM events)"""

CURVES_SQL = (
    POINTS_SQL
    + """, curves AS (
  SELECT chart, t, median(least(greatest(v, 0e0), 1e2)) AS v, count(*) AS vertices FROM points GROUP BY chart, t)"""
)
