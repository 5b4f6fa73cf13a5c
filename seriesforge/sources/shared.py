"""Tables written in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Only where that is unset and all
    runs on one machine (a ``local`` master, as in tests), a folder of our own; elsewhere executors
    couldn't see each other's files, so an unset folder is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: it is computed once, its lineage ends there, and a
    lost executor costs no more than reading it again."""
    return written_at(df, f"{shared_folder(df.sparkSession)}/{name}-{uuid4().hex}")


def written_at(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table at ``path``."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
