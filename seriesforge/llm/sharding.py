"""Versioned shards with size-tiered compaction (operator 7; DataFrame functions only).

A store is a folder: ``runs/<name>`` holds immutable Parquet shards, ``manifest/version=<n>`` one
row for each live run (name, tier: how many merges deep, rows, bytes, settled). Arrivals are
appended as small runs. Runs of like size (the largest within (fanout + 1) / 2 times the smallest;
empty ones count with the smallest) share a bucket; once it has ``fanout`` runs they are merged into
one, so each row is rewritten a number of times logarithmic in the store's size. A run whose files
average half the target size or more is settled and isn't rewritten.

A merge needs no shuffle: the scan packs small files into partitions of the target size, and each
partition becomes one file. Run bytes are those of the columns, so buckets don't depend on codecs.

A commit writes the manifest under a hidden name and renames it to its version, which fails if that
version exists: a reader sees the old set or the new one, a writer that dies leaves nothing that
blocks, and of two writers one gets ``FileExistsError``, calls ``refresh`` and appends again.
``clean`` removes old versions and runs that no version kept names. A store needs a file system whose
rename is atomic; object stores without one aren't covered.

Defined results: rows come back as they were appended, nulls, repeated rows and extra columns
included; an empty arrival is committed as a run without rows; an empty store has version 0; columns
named ``__shard`` or ``__tier`` are replaced in ``read`` by its own.
"""

from __future__ import annotations

import time
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from seriesforge.llm.common import removed, shared_folder

MANIFEST = "run string, tier int, n_rows long, n_bytes long, settled boolean"


class ShardStore:
    """Append, compact and read a folder of shards."""

    def __init__(self, spark: SparkSession, root: str, schema, target_bytes: int = 128 << 20, fanout: int = 4):
        self.spark, self.root, self.schema, self.target, self.fanout = spark, root, schema, target_bytes, fanout
        self.version = 0

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live runs of a version (by default the last committed one)."""
        version = self.version if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/version={version}")

    def refresh(self) -> int:
        """Takes up the last version that any writer has committed."""
        listed = self.spark.read.schema(MANIFEST + ", version int").parquet(f"{self.root}/manifest")
        self.version = listed.agg(F.max("version")).first()[0] or 0
        return self.version

    def commit(self, live: list[tuple]) -> None:
        """Makes ``live`` the next version; raises ``FileExistsError`` if another writer has taken it."""
        hidden, wanted = f"{self.root}/manifest/_{uuid4().hex}", f"{self.root}/manifest/version={self.version + 1}"
        self.spark.createDataFrame(live, MANIFEST).coalesce(1).write.parquet(hidden)
        hadoop, gateway = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        source, goal = hadoop.Path(hidden), hadoop.Path(wanted)
        files = hadoop.FileContext.getFileContext(goal.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            if files.util().exists(goal):
                raise FileExistsError(f"{wanted} exists")
            # rename without overwriting: the losing one of two writers fails here at the latest
            files.rename(source, goal, gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
        except Py4JJavaError as failed:
            if files.util().exists(goal):
                raise FileExistsError(f"{wanted} exists") from failed
            raise
        finally:
            removed(self.spark, hidden)
        self.version += 1

    def live(self) -> list[tuple]:
        """The runs of this version: a few of each size, and the settled ones."""
        return [tuple(r) for r in self.manifest().orderBy("tier", "run").collect()]

    def _measured(self, rows: DataFrame, name: str, tier: int) -> tuple:
        """Writes a run, and counts its rows and bytes on the way."""
        n_bytes = sum(
            (F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.lit(8) for f in self.schema.fields),
            F.lit(0),
        )
        seen = Observation()
        rows = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(n_bytes), F.lit(0)).cast("long").alias("n_bytes"))
        rows.write.option("compression", "zstd").parquet(f"{self.root}/runs/{name}")
        return name, tier, seen.get["n"], seen.get["n_bytes"], self._settled(name)

    def _settled(self, name: str) -> bool:
        """Whether the stored files of a run average half the target size or more."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/runs/{name}")
        held = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(at)
        return held.getLength() >= self.target / 2 * max(held.getFileCount() - 1, 1)  # one file marks the end of the write

    def append(self, rows: DataFrame) -> None:
        """An arrival becomes a run; then buckets that are full are merged."""
        name = f"tier0-{uuid4().hex}"
        self.commit([*self.live(), self._measured(rows, name, 0)])
        self.compact()

    def due(self, live: list[tuple]) -> list[tuple]:
        """The runs of the first full bucket, by size; none if no bucket is full."""
        bucket: list[tuple] = []
        for run in sorted((r for r in live if not r[4]), key=lambda r: (r[3], r[0])):
            least = next((r[3] for r in bucket if r[3]), run[3])
            if run[3] > least * (self.fanout + 1) / 2:
                if len(bucket) >= self.fanout:
                    break
                bucket = []
            bucket.append(run)
        return bucket if len(bucket) >= self.fanout else []

    def compact(self) -> None:
        """Merges full buckets, from the smallest runs up, until none is full."""
        live = self.live()
        while due := self.due(live):
            tier = max(r[1] for r in due) + 1
            name = f"tier{tier}-{uuid4().hex}"
            packing = self.spark.newSession()  # its settings are its own
            for k, v in (("maxPartitionBytes", self.target), ("minPartitionNum", 1), ("openCostInBytes", 0)):
                packing.conf.set(f"spark.sql.files.{k}", str(v))
            merged = packing.read.schema(self.schema).parquet(*[f"{self.root}/runs/{r[0]}" for r in due])
            merged.write.option("compression", "zstd").parquet(f"{self.root}/runs/{name}")
            run = name, tier, sum(r[2] for r in due), sum(r[3] for r in due), self._settled(name)
            live = [*(r for r in live if r not in due), run]
            self.commit(live)

    def clean(self, keep: int = 10, older_seconds: float = 7 * 86400) -> None:
        """Removes versions before the last ``keep``, and runs and hidden manifests that those kept
        don't name and that are older than any write or read now going on."""
        paths = self.spark._jvm.org.apache.hadoop.fs.Path
        files = paths(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        listed = {f: {s.getPath().getName(): s for s in files.listStatus(paths(f"{self.root}/{f}"))} for f in ("manifest", "runs")}
        versions = sorted(int(n.partition("=")[2]) for n in listed["manifest"] if n.startswith("version="))[-keep:]
        named = {r.run for v in versions for r in self.manifest(v).select("run").collect()}
        kept = named | {f"version={v}" for v in versions}
        for name, status in [*listed["manifest"].items(), *listed["runs"].items()]:
            if name not in kept and status.getModificationTime() / 1000 <= time.time() - older_seconds:
                files.delete(status.getPath(), True)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with ``__shard`` (file) and ``__tier``."""
        runs = [r.run for r in self.manifest(version).select("run").collect()]
        if not runs:
            return self.spark.createDataFrame([], self.schema).withColumns({"__shard": F.lit(None).cast("string"), "__tier": F.lit(None).cast("int")})
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.root}/runs/{r}" for r in runs])
        tier = F.regexp_extract("_metadata.file_path", "/runs/tier([0-9]+)-", 1).cast("int")
        return rows.withColumns({"__shard": F.col("_metadata.file_name"), "__tier": tier})


def op7_sharding(spark, sf_dir: str, arrivals: int = 8) -> DataFrame:
    """All ``documents`` appended in eight arrivals, compacted, and read back by the manifest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_folder(spark)}/store-{uuid4().hex}"
    store = ShardStore(spark, root, docs.schema)
    # The table is split into its arrivals once; each is then read where it lies.
    docs.withColumn("__arrival", F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))).write.option("compression", "zstd").partitionBy("__arrival").parquet(f"{root}/arrivals")
    split = spark.read.parquet(f"{root}/arrivals")
    for k in range(arrivals):
        store.append(split.where(F.col("__arrival") == k).select(docs.columns))
    removed(spark, f"{root}/arrivals")
    out = store.read()
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", "lang", "source", n_bytes.alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("__tier").alias("tier"), F.lit(store.version).alias("version"))


OP7_SQL = """
SELECT doc_id, lang, source, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, md5(text) AS text_md5,
       CAST(1 AS INTEGER) AS tier, CAST(10 AS INTEGER) AS version
FROM documents
"""
