"""Mixing sources to target weights by Sainte-Laguë apportionment (operator 4).

Words are laid out in blocks of equal size. The whole mix is a number of blocks; the highest
quotients ``target / (2k - 1)`` give every source its whole number of blocks, the same rule divides
a source's blocks among its shards, and within a shard a seeded start picks the blocks. A document
takes from the mix what its words share with the picked blocks.

Shards come from a hash of the document, so a source with a third of all rows has many; their
number grows with the source up to ``MAX_SHARDS``, which bounds the tables of quotas. Only those
tables (one row a source, or a shard) meet in windows without the documents.

Defined results: a null text has size 0 and takes nothing; a null source is a source of its own,
the last in order; repeated rows are separate documents (which of several equal rows takes more is
fixed by their order in the shard); an empty table gives no rows. Reruns agree: nothing depends on
partitioning. A source's words come within a block a shard of its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seriesforge.llm.common import written

BLOCK = 16
SHARD_WORDS = 1 << 16
MAX_SHARDS = 4096
#: Fixed value: a word of the contract.
WORD = r"[^\x20\x09-\x0D]+"


def seats(parties: DataFrame, by: list[str], name: str, weight: str, house: str, most: str) -> DataFrame:
    """Sainte-Laguë: rows of ``parties`` with ``seats`` for ``house`` seats in each group ``by``.

    The seats that every party is sure of come from a divisor that is too large for any more to
    fit; those left, fewer than the parties, go to the highest remaining quotients (ties to the
    first ``name``). ``most`` caps a party's seats.
    """
    group = W.partitionBy(*by)
    total, count = F.sum(weight).over(group), F.count("*").over(group)
    sure = F.floor((F.col(weight) * F.greatest(2 * F.col(house) - F.col("__m"), F.lit(0)) / F.col("__t") + 1) / 2)
    base = parties.withColumns({"__t": total, "__m": count})
    base = base.withColumn("__sure", F.when((F.col("__t") > 0) & (F.col(weight) > 0), F.least(sure, F.col(most))).otherwise(0).cast("long"))
    base = base.withColumn("__left", F.col(house) - F.sum("__sure").over(group))
    reach = F.when((F.col("__t") > 0) & (F.col(weight) > 0), F.ceil(F.col(weight) / F.col("__t") * F.col("__m")) + 1).otherwise(0)
    last = F.least(F.col("__sure") + reach, F.col(most)).cast("long")
    bids = base.where(last > F.col("__sure")).withColumn("__k", F.explode(F.sequence(F.col("__sure") + 1, last)))
    bids = bids.withColumn("__rank", F.row_number().over(group.orderBy(F.desc(F.col(weight) / (2 * F.col("__k") - 1)), *[F.col(n) for n in name.split(",")])))
    won = bids.where(F.col("__rank") <= F.col("__left")).groupBy(*by, *name.split(",")).agg(F.count("*").alias("__won"))
    keys = [*by, *name.split(",")]
    out = base.join(won, keys, "left")
    return out.withColumn("seats", F.col("__sure") + F.coalesce("__won", F.lit(0))).drop("__t", "__m", "__sure", "__left", "__won")


def taken_until(x: Column) -> Column:
    """Words that the picked blocks of a shard hold before word ``x``: block b is taken
    ``((b + 1 + start) * quota) div blocks - ((b + start) * quota) div blocks`` times."""
    b = F.floor(x / BLOCK)
    upto = lambda i: F.floor((i + F.col("start")) * F.col("quota") / F.col("blocks"))
    whole = upto(b) - upto(F.lit(0))
    return F.when(F.col("blocks") > 0, whole * BLOCK + (x - b * BLOCK) * (upto(b + 1) - upto(b))).otherwise(0).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...], share: float, most: float = 2.0, source: str = "source", text: str = "text", seed: int = 17) -> DataFrame:
    """The columns of ``docs`` but its text, with ``size``, ``source_size``, ``target`` and
    ``taken`` (words, repeats counted). Texts are read once, to count their words.

    ``weights`` repeat over the sources in order; the mix has ``share`` times all words; a source's
    target stops at ``most`` times its size, and what it leaves goes to the others by weight.
    """
    results = ("size", "source_size", "target", "taken")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text and c not in results]
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    rows = docs.select(F.struct(*rest).alias("__rest"), F.col(source).alias("source"), size)
    rows = written(rows.withColumn("__key", F.xxhash64(F.lit(seed), "__rest", "size")), "sizes")
    source = "source"
    sizes = rows.groupBy(source).agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col(source).asc_nulls_last())
    index = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (index % len(weights) + 1).cast("int"))
    table = sizes.select(source, "source_size", index.alias("source_no"), weight.alias("weight"))
    # Water filling: in the order of cap over weight, the level is right where no later cap is under it.
    cap, by_cap = most * F.col("source_size"), W.orderBy(most * F.col("source_size") / F.col("weight"), "source_no")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, W.unboundedFollowing)
    level = (share * F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    table = table.withColumn("__level", level).withColumn("__level", F.max(F.when(cap / F.col("weight") >= F.col("__level"), F.col("__level"))).over(W.partitionBy()))
    table = table.withColumn("target", F.least(cap, F.coalesce(F.col("weight") * F.col("__level"), cap)).cast("double"))
    shards = F.least(F.greatest(F.ceil(F.col("source_size") / SHARD_WORDS), F.lit(1)), F.lit(MAX_SHARDS)).cast("int")
    table = table.withColumns({"shards": shards, "__most": F.ceil(most * F.col("source_size") / BLOCK).cast("long"), "__all": F.lit(1)})
    table = table.withColumn("__house", F.round(F.sum("target").over(W.partitionBy()) / BLOCK).cast("long"))
    table = seats(table, ["__all"], "source_no", "target", "__house", "__most").select(source, "source_no", "source_size", "target", "shards", F.col("seats").alias("source_seats"))

    placed = rows.join(table.withColumnRenamed(source, "__source"), F.col(source).eqNullSafe(F.col("__source"))).drop("__source")
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("__key"), F.col("shards")).cast("int"))
    parts = placed.groupBy("source_no", "source_seats", "shard").agg(F.sum("size").alias("shard_size"))
    parts = parts.withColumn("blocks", F.ceil(F.col("shard_size") / BLOCK).cast("long"))
    parts = parts.withColumn("__most", (F.col("blocks") * F.lit(int(most))).cast("long"))
    quotas = seats(parts, ["source_no"], "shard", "shard_size", "source_seats", "__most")
    start = F.when(F.col("blocks") > 0, F.pmod(F.xxhash64(F.lit(seed), "source_no", "shard"), F.col("blocks"))).otherwise(0)
    quotas = quotas.select("source_no", "shard", "blocks", F.col("seats").alias("quota"), start.alias("start"))

    line = W.partitionBy("source_no", "shard").orderBy("__key").rowsBetween(W.unboundedPreceding, 0)
    out = placed.withColumn("__end", F.sum("size").over(line)).join(quotas, ["source_no", "shard"])
    taken = taken_until(F.col("__end")) - taken_until(F.col("__end") - F.col("size"))
    return out.select("__rest.*", "size", "source_size", "target", taken.alias("taken"))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """All ``documents``: weights 3, 1, 2 in the order of the sources, 150% of all words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs, (3, 1, 2), 1.5).select("doc_id", "size", "source_size", "target", "taken")
