"""How five filters interact, in every order (operator 12).

Native expressions turn a text into a mask of the filters that it fails (bit 0 is A, bit 4 is E):

* A: under 200 words; B: fewer than half of the words are distinct; C: over 3 % of the code points
  are A-Z; D: holds any of ``#$%&*|``; E: a smaller id has the same text, anywhere in the table.

E comes from a groupBy on the text's SHA-256, whose least id is joined back by hash and id. All
that the audit needs of a part are then the rows of its 32 masks: every prefix of every order, and
the Shapley sums, are added up from these cells, so no permutation touches a document.

Defined results: a null text is the empty text; a null id is neither smaller nor larger than
another, so its row neither fails E nor makes others fail it; rows that share an id and a text
don't fail E through each other; a null part is the empty string; several labels of an id count if
any says so, labels of unknown ids and null ids count nowhere; an empty table has no parts. Other
columns of the input are ignored.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from seriesforge.llm.common import written

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    points = F.length(whole)
    fails = (
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * (points - F.length(F.translate(whole, UPPER, ""))) > 3 * points,
        whole.rlike("[#$%&*|]"),
    )
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def masked(docs: DataFrame, part: str = "lang", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, part, mask, n): how many rows have an id and a mask. Texts are read once; what is shuffled
    are their hashes. The rows of a text's least id are found by hash and id, so the copies of a
    text don't meet in one task."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(part), F.lit("")).alias("part"),
        F.unhex(F.sha2(whole, 256)).alias("digest"),
        text_mask(F.col(text)).alias("mask"),
    )
    rows = written(rows, "masks")
    named = rows.where("doc_id is not null")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    same = named.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    late = F.when(F.col("first"), 0).otherwise(1 << FILTERS.index("E"))
    judged = same.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + late).alias("mask"), "n")
    unnamed = rows.where("doc_id is null").groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    return judged.unionByName(unnamed)


def cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, n, good, toxic): for each part arrays of its rows by mask, all of them, those labelled
    good and those labelled toxic."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"),
    )
    every = rows.groupBy("part", "mask").agg(F.sum("n").alias("n")).withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    known = rows.join(marks, "doc_id").groupBy("part", "mask").agg(F.lit(0).alias("none"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")).withColumnRenamed("none", "n")
    both = every.unionByName(known)
    count = lambda c: F.array(*[F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)).cast("long") for m in range(CELLS)])
    return both.groupBy("part").agg(count("n").alias("n"), count("good").alias("good"), count("toxic").alias("toxic"))


def steps() -> list[dict]:
    """The steps of all orders: the filter's bit, and the bits of those applied before it."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    return [{"filter_order": o, "step": k + 1, "bit": bit[o[k]], "before": sum(bit[f] for f in o[:k])} for o in ORDERS for k in range(len(o))]


def audit(counts: DataFrame) -> DataFrame:
    """Of the cells of each part, a row for every step of every order."""
    table = F.from_json(F.lit(json.dumps(steps())), "array<struct<filter_order string, step int, bit int, before int>>")
    rows = counts.select("*", F.inline(table))
    bit, before = F.col("bit"), F.col("before")

    def total(column: str, wanted) -> Column:
        """The rows of a column's cells whose mask ``wanted`` accepts."""
        kept = F.transform(F.col(column), lambda n, m: F.when(wanted(m), n).otherwise(F.lit(0).cast("long")))
        return F.aggregate(kept, F.lit(0).cast("long"), lambda a, n: a + n)

    def removed(m: Column) -> Column:
        return (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) == 0)

    out = rows.select(
        "part", "filter_order", "step", "bit",
        total("n", lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
    )
    shapley = out.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return out.join(shapley, ["part", "bit"]).drop("bit")


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """All 120 orders of the five filters over whole ``documents``, for each ``lang``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(cells(masked(docs), labels))


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), rows AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
       + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
       + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
       + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM words
), marks AS (
  SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM rows LEFT JOIN marks USING (doc_id) GROUP BY part, mask
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), steps AS (
  SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INTEGER AS before FROM orders, range(1, 6) r(k)
), every AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM every
"""
