"""The corpus pipeline: documents are judged, deduplicated, cut, mixed and encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``. A stage
works on all that its predecessor kept, and its decisions take effect. An empty table stays empty;
rows without an id are never joined by it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from seriesforge.llm import bpe, mixing, ngram_join, quality, substring_dedup
from seriesforge.llm.common import written

#: A whole document, in the integers that its shares are added up in (a power of two: exact as doubles).
ONE = 1 << 24


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, fitted on the labels of ``sf_dir``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels).where("kept").select(docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document of the
    smallest id; documents without an id stay. Of rows that share an id and a text, one stays."""
    gone = ngram_join.jaccard_components(docs).where("component_id <> doc_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id is null")).select(docs.columns)


def cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that a smaller document has are cut out. A document that loses nothing
    keeps its text as it is; one that loses every word goes."""
    out = substring_dedup.dedup_substrings(docs)
    out = out.where("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumns({"text": text, "n_chars": n_chars}).select(docs.columns)


def copies(taken: DataFrame, seed: int = 23) -> DataFrame:
    """(__row, __times) for the (__row, source, size, source_size, taken) of a mix. The documents of a source
    stand in lines, each a share of its rows by hash; along a line the taken documents
    (``taken / size``) are added up from a seeded start, and a document comes as often as the sum
    passes a whole number there. So no share is rounded away, whatever its size; lines are in order
    of size, which keeps the words that come close to those taken."""
    share = F.floor(F.col("taken") * ONE / F.col("size") + 0.5).cast("long")
    rows = taken.where("size > 0").select("__row", "source", "source_size", "size", share.alias("__share"))
    rows = rows.groupBy("__row", "source", "source_size", "size").agg(F.sum("__share").alias("__share"))
    lines = F.least(F.greatest(F.ceil(F.col("source_size") / mixing.SHARD_WORDS), F.lit(1)), F.lit(mixing.MAX_SHARDS))
    rows = rows.withColumn("__line", F.pmod(F.xxhash64(F.lit(seed), "__row"), lines))
    start = F.pmod(F.xxhash64(F.lit(seed), "source", "__line"), F.lit(ONE))
    line = W.partitionBy("source", "__line").orderBy("size", "__row").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum("__share").over(line) + start
    rows = rows.withColumn("__end", end)
    times = F.floor(F.col("__end") / ONE) - F.floor((F.col("__end") - F.col("__share")) / ONE)
    return rows.select("__row", times.cast("int").alias("__times")).where("__times > 0")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 3, 1, 2 with 150% of all words: a document comes as often as the words
    taken from it make whole documents, fractions being passed on to the next of its source;
    documents without words don't come."""
    # Rows are told apart by two hashes and the id: equal ones are one document, no other is lost.
    rows = docs.withColumn("__row", F.concat_ws(":", F.xxhash64(*docs.columns), F.xxhash64(F.lit(1), *docs.columns), "doc_id"))
    times = copies(mixing.mix(rows, (3, 1, 2), 1.5))
    once = rows.dropDuplicates(["__row"]).join(times, "__row")
    return once.withColumn("__k", F.explode(F.sequence(F.lit(1), "__times"))).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text's ids in the 49k word vocabulary, and the text decoded from them."""
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"), keep_text=False)
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", "lang", "source", n_tokens.alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_classifier", good),
    ("ngram_jaccard_join", distinct),
    ("substring_dedup", cut),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: SQL can express neither the classifier nor the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
