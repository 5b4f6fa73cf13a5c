"""Session files as a stream: points of curves, aggregated as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seriesforge.sources.files import CURVE, NAME, session_file


def session_points(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    """New files of a folder as they come: (animal_id, date_iso, curve, t, v)."""
    rows = spark.readStream.schema(CURVE).option("header", True).option("maxFilesPerTrigger", files_a_trigger).csv(folder)
    name = session_file()
    return rows.select(F.regexp_extract(name, NAME, 1).alias("animal_id"), F.regexp_extract(name, NAME, 2).alias("date_iso"), "curve", F.col("time_min").alias("t"), F.col("value").alias("v"))


def running_peaks(points: DataFrame) -> DataFrame:
    """Points, last time and peak of each session so far: a small state for each session."""
    return points.groupBy("animal_id", "date_iso", "curve").agg(F.count("*").alias("points"), F.max("t").alias("t_max"), F.max("v").alias("peak"))
