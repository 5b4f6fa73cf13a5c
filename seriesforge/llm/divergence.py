"""How the sources of a language differ in their words (operator 11).

Terms are runs of letters and non-ASCII characters, A-Z in lower case; a language keeps those that
at least ``LEAST_DOCUMENTS`` of its documents hold, V of them. A source's share of a term that it
holds ``c`` times is the integer ``1 + floor(10**9 * (c + 1) / (N + V))``, N being its kept terms in
all; ``f(p, q) = floor((p - q)**2 / q)``. Part ``pair`` sums f over all kept terms for every two
sources of a language, part ``term`` lists the terms in which a source stands out from its language.

The sum of a pair is split by how many sources hold a term, the boundary chosen by cost:

* Heavy terms fill dense tiles (terms x sources) in NumPy, which sum f for all pairs at once.
* For the other, light terms, most sources hold none and have their base share b. A pair starts
  from ``n_light * f(b_g, b_h)``; terms that g holds replace b_g, and terms that h holds replace
  b_h, both added up from histograms of equal shares; where both hold a term, the posting pair is
  corrected by ``f(p_g, p_h) - f(p_g, b_h) - f(b_g, p_h) + f(b_g, b_h)``.

All are integers, so the partial sums add up exactly, however rows are dealt.

Tasks count their own documents before anything is shuffled; a source's terms are never brought
together. Tiles have a bounded number of cells: they are cut by terms and by stripes of sources.

Defined results: null texts, languages and sources are the empty string; a source without terms has
its pairs (0 if the language keeps no term); a language of one source has no pairs; repeated rows
and ids count as documents of their own; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seriesforge.llm.common import small_batches, written

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
GAP = re.compile("[\x00-\x40\x5b-\x60\x7b-\x7f]")
LEAST_DOCUMENTS = 3
TOP_TERMS = 200

#: Characters that a task takes terms from at a time, and terms that it holds before it sends them.
PIECE, HELD = 1 << 20, 1 << 19
#: A posting pair costs as much as so many cells of a tile; sources that a light term has at most.
PAIR_COST, MOST_POSTINGS = 8, 512
#: Cells of a tile, and the sources whose rows of pairs it sums.
TILE, STRIPE = 1 << 15, 256


def lower(text: str) -> str:
    """A-Z in lower case, nothing else changed."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A text in pieces that cut no term."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + size) if at + size < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's rows of (lang, source, text): counts and documents of
    each term; the term '' with zeros stands for the source itself."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            own = pa.array(["", *n], pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())
            for a in range(0, len(n) + 1, 10_000):
                terms, counts, in_docs = (c.slice(a, 10_000) for c in own)
                names = (pa.repeat(pa.scalar(x, pa.string()), len(terms)) for x in (lang, source))
                yield pa.RecordBatch.from_arrays([*names, terms, counts, in_docs], ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            own: set[str] = set()
            for piece in pieces(text):
                terms = TERM.findall(lower(piece))
                n.update(terms)
                own.update(terms)
            docs.update(own)
        if sum(len(n) for n, _ in held.values()) + len(held) > HELD:
            yield from sent()
    yield from sent()


def share(n: Column, total: Column) -> Column:
    """``1 + floor(10**9 * (n + 1) / total)``, exactly."""
    return 1 + F.call_function("div", F.lit(10**9).cast("decimal(10,0)") * (n + 1).cast("decimal(25,0)"), total.cast("decimal(25,0)"))


def f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def postings(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, n_lang, k, once) of the terms that each language keeps: the source's count, the
    language's, how many sources hold the term, and 1 in one of the term's rows. Rows of the term ''
    stand for the sources themselves."""
    small_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = rows.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    found = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    found = found.select(
        "lang", "source", "term", "n",
        F.sum("n").over(term).alias("n_lang"),
        F.count("*").over(term).cast("int").alias("k"),
        F.sum("docs").over(term).alias("docs"),
        ((F.col("source") == F.min("source").over(term)) & (F.col("term") != "")).cast("int").alias("once"),
    )
    return found.where((F.col("docs") >= least) | (F.col("term") == "")).drop("docs")


def roster(rows: DataFrame) -> DataFrame:
    """(lang, source, g, groups, total, total_lang, base) of every source: its number in the language, the
    language's number of sources, N + V of both, and its share of a term that it doesn't hold."""
    own = rows.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("once").alias("v"))
    lang = W.partitionBy("lang")
    own = own.select(
        "lang", "source",
        (F.row_number().over(lang.orderBy("source")) - 1).alias("g"),
        F.count("*").over(lang).cast("int").alias("groups"),
        (F.col("n") + F.sum("v").over(lang)).alias("total"),
        F.sum(F.col("n") + F.col("v")).over(lang).alias("total_lang"),
        F.sum("v").over(lang).alias("kept"),
    )
    return own.withColumn("base", F.when(F.col("kept") > 0, share(F.lit(0), F.greatest("total", F.lit(1)))).otherwise(1))


def corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, g, h, value): what posting pairs of light terms add, from rows (lang, held), ``held`` being a
    term's bounded list of (g, p, base)."""
    for batch in batches:
        lists = batch.column("held")
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        flat = lists.flatten()
        g, p, b = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("g", "p", "base"))
        names, lang = np.unique(batch.column("lang").to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
        sizes = np.diff(lists.offsets.to_numpy())
        term, lang = np.repeat(np.arange(len(sizes)), sizes), np.repeat(lang, sizes)
        keys, values = [], []
        for d in range(1, int(sizes.max(initial=0))):
            i = np.flatnonzero(term[d:] == term[:-d])
            for x, y in ((i, i + d), (i + d, i)):
                value = whole(p[x], p[y]) - whole(p[x], b[y]) - whole(b[x], p[y]) + whole(b[x], b[y])
                keys.append(np.stack([lang[x], g[x], g[y]]))
                values.append(value)
        if not values:
            continue
        key, at = np.unique(np.concatenate(keys, 1), axis=1, return_inverse=True)
        sums = np.zeros(key.shape[1], np.int64)
        np.add.at(sums, at.ravel(), np.concatenate(values))
        yield pa.RecordBatch.from_arrays([pa.array(names[key[0]], pa.string()), pa.array(key[1]), pa.array(key[2]), pa.array(sums)], ["lang", "g", "h", "value"])


def whole(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """f on arrays: squares are at most 10**18."""
    return (p - q) ** 2 // q


def tile_sums(width: int):
    """The function that gives (lang, g, h, value) of a tile's terms for its stripe of ``width`` sources. Rows
    without a term give the base share of every source."""

    def sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lang, _, stripe = key
        bases, held = rows[rows.term.isna()].sort_values("g"), rows[rows.term.notna()]
        at, _ = pd.factorize(held.term)
        cells = np.repeat(bases.p.to_numpy()[None, :], at.max(initial=-1) + 1, 0)
        cells[at, held.g.to_numpy()] = held.p.to_numpy()
        groups, first = len(bases), int(stripe) * width
        found = [whole(cells[:, g : g + 1], cells).sum(0) for g in range(first, min(first + width, groups))]
        g = np.repeat(np.arange(first, first + len(found)), groups)
        out = pd.DataFrame({"lang": lang, "g": g, "h": np.tile(np.arange(groups), len(found)), "value": np.concatenate(found)})
        return out[out.g != out.h]

    return sums


def pair_sums(rows: DataFrame, groups: DataFrame, pair_cost: int = PAIR_COST, most_postings: int = MOST_POSTINGS, tile: int = TILE, stripe: int = STRIPE) -> DataFrame:
    """(lang, source, item, value) of every two sources. ``rows`` are postings with the roster's columns and
    p; each pair's sum comes from the heavy terms' tiles and the light terms' parts, and doesn't
    depend on the other parameters."""
    rows = rows.where("term <> ''")
    heavy = (F.col("k").cast("long") * F.col("k") * pair_cost > F.col("groups").cast("long") * F.col("groups")) | (F.col("k") > most_postings)
    light = rows.where(~heavy)

    # Dense: tiles of heavy terms, with all sources' base shares in each.
    tiles = F.ceil(F.col("kept") * F.col("groups") / tile).cast("long")
    stripes = F.explode(F.sequence(F.lit(0), F.floor((F.col("groups") - 1) / stripe).cast("int"))).alias("stripe")
    cells = rows.where(heavy).select("lang", F.pmod(F.xxhash64("term"), tiles).alias("tile"), stripes, "term", "g", "p")
    used = cells.select("lang", "tile", "stripe").distinct()
    bases = used.join(groups.select("lang", "g", F.col("base").alias("p")), "lang").select("lang", "tile", "stripe", F.lit(None).cast("string").alias("term"), "g", "p")
    dense = cells.unionByName(bases).groupBy("lang", "tile", "stripe").applyInPandas(tile_sums(stripe), "lang string, g long, h long, value long")

    # Sparse: pairs of postings that both differ from their sources' base shares.
    lists = light.where("k > 1").groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "base")).alias("held")).select("lang", "held")
    sparse = lists.mapInArrow(corrections, "lang string, g long, h long, value long")

    # What one source's light terms change against another's base share, by equal shares.
    bins = light.groupBy("lang", "g", "base", "p").agg(F.count("*").alias("n"))
    other = groups.select("lang", F.col("g").alias("h"), F.col("base").alias("base_h"))
    met = bins.join(other, "lang").where("g <> h")
    row = met.select("lang", "g", "h", (F.col("n") * (f(F.col("p"), F.col("base_h")) - f(F.col("base"), F.col("base_h")))).alias("value"))
    column = met.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), (F.col("n") * (f(F.col("base_h"), F.col("p")) - f(F.col("base_h"), F.col("base")))).alias("value"))

    # Where every pair starts.
    count = light.groupBy("lang").agg(F.sum("once").alias("n"))
    own = groups.select("lang", "g", "source", "base").join(count, "lang", "left")
    start = own.join(other.join(groups.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"]), "lang").where("g <> h")
    start = start.select("lang", "g", "h", (F.coalesce("n", F.lit(0)) * f(F.col("base"), F.col("base_h"))).alias("value"), "source", "item")

    parts = start
    for x in (row, column, sparse, dense):
        parts = parts.unionByName(x, allowMissingColumns=True)
    sums = parts.groupBy("lang", "g", "h").agg(F.max("source").alias("source"), F.max("item").alias("item"), F.sum(F.col("value").cast("decimal(25,0)")).alias("value"))
    return sums.select("lang", "source", "item", F.col("value").cast("long").alias("value"))


def divergence(docs: DataFrame, top_terms: int = TOP_TERMS, **split: int) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents with ``lang``, ``source`` and ``text``; ``split`` are
    parameters of ``pair_sums``."""
    rows = written(postings(docs), "postings")
    groups = written(roster(rows), "roster")
    rows = rows.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.greatest("total", F.lit(1))))
    pairs = pair_sums(rows, groups, **split).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    own = rows.where("term <> ''").withColumn("q", share(F.col("n_lang"), F.greatest("total_lang", F.lit(1)))).where("p > q")
    terms = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), f(F.col("p"), F.col("q")).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(order)) for x in (pairs, terms)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top_terms))


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    """All pairs of sources, and each source's outstanding terms, over whole ``documents``."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


OP11_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM docs) GROUP BY lang, term HAVING count(*) >= 3
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM docs) SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), groups AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counts USING (lang, source) GROUP BY lang, source
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + s.v) AS p
  FROM groups g JOIN sizes s USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), langs AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term) JOIN sizes USING (lang)
), terms AS (
  SELECT c.lang, c.source, 'term' AS part, c.term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value
  FROM cells c JOIN langs l ON l.lang = c.lang AND l.term = c.term WHERE c.n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200
"""
