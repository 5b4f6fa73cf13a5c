"""Files of curves: one CSV a session, and truth as nested JSON; writers of both kinds of output.

Schemas are explicit. A session's identity is in its file's name: ``animal_{id}_{date}[_{time}].csv``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from seriesforge.operators import matching

CURVE = "curve STRING, time_min DOUBLE, value DOUBLE"
_POINTS = "STRUCT<time_min ARRAY<DOUBLE>, value ARRAY<DOUBLE>>"
_META = "STRUCT<animal_id STRING, date_it STRING, date_iso STRING, time_full STRING, time_hhmm STRING, milk_kg DOUBLE, bimo STRING, le STRING, gnr STRING, farm STRING>"
TRUTH_CHART = f"STRUCT<page INT, chart INT, metadata {_META}, flusso {_POINTS}, pressione {_POINTS}>"
NAME = r"animal_([^_/]+)_([0-9]{4}-[0-9]{2}-[0-9]{2})(?:_([0-9]{4}))?\.csv$"
#: Names of the curves.
FLOW, PRESSURE = "Flusso_kg_min", "Pressione_assoluta_0.1bar"


def session_file() -> Column:
    """The session file that a row was read from: the folder's name where sessions are folders, as
    ``write_sessions`` makes them, else the file's own."""
    path = F.col("_metadata.file_path")
    folder = F.regexp_extract(path, r"/csv_name=([^/]+)/[^/]*$", 1)
    return F.when(folder != "", F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))).otherwise(F.col("_metadata.file_name"))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(animal_id, date_iso, time_hhmm, curve, t, v, file) of all session files under ``path``. By itself Spark starts
    a task for every four files, however small; here a task takes eight times as many. It can't take any
    number, as Spark keeps what it read each file with until the task ends."""
    rows = spark.read.schema(CURVE).option("header", True).csv(path).withColumn("file", session_file())
    rows = rows.coalesce(max(8 * spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions() // 8))
    part = lambda k: F.nullif(F.regexp_extract("file", NAME, k), F.lit(""))
    return rows.select(part(1).alias("animal_id"), part(2).alias("date_iso"), part(3).alias("time_hhmm"), "curve", F.col("time_min").alias("t"), F.col("value").alias("v"), "file")


def read_truth(spark: SparkSession, path: str, datasets: list[str] | None = None) -> DataFrame:
    """(dataset, page, chart, animal_id, curve, t, v) of truth files: data set -> list of charts, whatever the
    data sets are called; ``datasets`` keeps some of them."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"MAP<STRING, ARRAY<{TRUTH_CHART}>>").alias("m"))
    charts = whole.select(F.explode("m").alias("dataset", "charts")).select("dataset", F.explode("charts").alias("c"))
    if datasets is not None:
        charts = charts.where(F.col("dataset").isin(*datasets))
    kinds = F.array(*[F.struct(F.lit(n).alias("curve"), F.col(f"c.{f}").alias("p")) for n, f in ((FLOW, "flusso"), (PRESSURE, "pressione"))])
    long = charts.select("dataset", "c.page", "c.chart", "c.metadata.animal_id", F.explode(kinds).alias("k"))
    points = F.explode(F.arrays_zip(F.col("k.p.time_min").alias("t"), F.col("k.p.value").alias("v"))).alias("p")
    return long.select("dataset", "page", "chart", "animal_id", "k.curve", points).select("dataset", "page", "chart", "animal_id", "curve", "p.t", "p.v")


def write_sessions(curves: DataFrame, path: str) -> None:
    """Sessions as CSV, a folder for each ``csv_name``; rows go to their session's task first."""
    rows = curves.select("csv_name", "curve", F.col("t").alias("time_min"), F.col("v").alias("value"))
    rows.repartition("csv_name").sortWithinPartitions("csv_name", "curve", "time_min").write.partitionBy("csv_name").option("header", True).csv(path)


def write_named_sessions(curves: DataFrame, folder: str, waiting: str) -> None:
    """Sessions as CSV under their own names in ``folder``, which as ``waiting`` is a path that all tasks can open. Spark
    makes each session's text; a task writes it in ``waiting`` and renames it, so a name is whole or absent
    whatever becomes of the task. Spark's own writer makes a folder for each session and, in a local file
    system, starts several processes to set rights."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = f"{waiting}/{uuid4().hex}"
                with open(own, "x", encoding="utf-8", newline="") as out:
                    out.write(text)
                os.replace(own, f"{folder}/{name}")
            yield batch.select([0])

    os.makedirs(folder, exist_ok=True)
    os.makedirs(waiting, exist_ok=True)
    rows = curves.select("csv_name", "curve", F.col("t").alias("time_min"), F.col("v").alias("value"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("curve", "time_min", "value"))), lambda s: F.to_csv(s))
    texts = rows.groupBy("csv_name").agg(F.concat(F.array_join(F.concat(F.array(F.lit("curve,time_min,value")), lines), "\n"), F.lit("\n")).alias("text"))
    texts.mapInArrow(write, "csv_name string").write.format("noop").mode("overwrite").save()


def write_report(summary: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    summary.write.json(path)


def by_prefix(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted session (animal_id, date_iso) the files whose name starts with ``animal_{id}_{date}``, with
    their place in order; null where there is none."""
    prefix = F.concat(F.lit("animal_"), "animal_id", F.lit("_"), "date_iso")
    found = matching.prefix_matches(wanted.withColumn("__prefix", prefix), files.select("file").distinct(), "__prefix", "file").drop("__prefix")
    return found.withColumn("place", F.row_number().over(W.partitionBy("animal_id", "date_iso").orderBy("file")))
