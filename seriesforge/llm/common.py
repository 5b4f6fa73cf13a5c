"""What several operators share: written tables in the shared folder, and connected components."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from seriesforge.sources.shared import shared_folder, written, written_at

__all__ = ["components", "removed", "shared_folder", "small_batches", "whole_groups", "written", "written_at"]


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to at most 2,000 rows and 8 MB, as texts are large and both
    sides of a Python task hold a batch. It stays set: results are lazy, and run with the settings
    of the time at which they are asked for. Smaller values of the caller's are left alone."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= 2000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    size = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m")))
    if not 0 < size <= 8 << 20:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 1 << 19) -> Iterator[list[np.ndarray]]:
    """A task's sorted rows as arrays, in pieces of about ``rows`` rows that never cut a group of equal values in
    the first ``keys`` columns: memory follows the piece and the largest group, not the partition."""
    held: list[list[np.ndarray]] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy() for c in batch.columns])
        n += batch.num_rows
        if n < rows:
            continue
        columns = [np.concatenate(c) for c in zip(*held)]
        last = np.ones(n, bool)
        for c in columns[:keys]:
            last &= c == c[-1]
        cut = n - int(last[::-1].argmin()) if not last.all() else 0
        if cut:
            yield [c[:cut] for c in columns]
        held, n = [[c[cut:] for c in columns]], n - cut
    if n:
        yield [np.concatenate(c) for c in zip(*held)]


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): rows (node, component), component being
    the smallest node reachable. Nodes without an edge don't appear.

    Alternating large-star and small-star steps: every node hands its larger (then its smaller)
    neighbours to the smallest one it knows, which flattens all trees in a logarithmic number of
    rounds; the loop ends when a round changes nothing. Only minima are aggregated, so a node with
    many links is reduced before each shuffle. A round's table is deleted once the next is written.
    """
    spark = edges.sparkSession
    root, k = f"{shared_folder(spark)}/links-{uuid4().hex}", 0
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    pairs, seen = written_at(pairs, f"{root}/0"), None
    while True:
        state = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or state.n < 2:
            break
        seen = state
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("b", "m").union(small.select(F.col("a").alias("b"), "m")).where("b <> m")
        pairs, k = written_at(small.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), f"{root}/{k + 1}"), k + 1
        removed(spark, f"{root}/{k - 1}")
    flat = pairs.groupBy("a").agg(F.min("b").alias("b"))
    tops = flat.select(F.col("b").alias("node")).distinct()
    return flat.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops.select("node", F.col("node").alias("component")))
