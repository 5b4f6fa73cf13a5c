"""Removal of repeated passages, with a count-min prefilter (operator 5).

A window is ``size`` consecutive words. Pass 1 sketches the windows: each is counted under its
anchor, the smallest hash among its runs of ``ANCHOR`` words, so that neighbours share one entry
and equal windows always count together. Every partition sends its own sketch's cells; the merged
counters can only overestimate. Pass 2 takes the windows whose every cell was met at least twice,
groups them exactly by a 95-bit hash of their words, and removes those that also start in a
document with a smaller id. The sketch never loses a repeated window; its width follows the input
up to ``MAX_CELLS``, beyond which more windows are grouped, with the same result.

What a task has read is decided within the task first: a window that a smaller document of the
same block holds is removed at once, and each block sends one document at most for a window, in one
row for all its starts there. So a passage in a third of all documents, or one that repeats itself
within a document, is a row a block, not a hot key.

Defined results: a null or empty text has no words; documents shorter than a window lose nothing;
windows are judged on the input; a null id ranks after all others; rows with the same id don't
remove each other's words; extra columns pass through (one
named like a result gives way to it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql import Window as W

from seriesforge.llm.common import small_batches
from seriesforge.llm.words import mixed, windows, word_hashes

ANCHOR = 16
ROWS = 2
MIN_CELLS, MAX_CELLS = 1 << 20, 1 << 29
BLOCK_WINDOWS = 1_000_000
NO_ID = (1 << 63) - 1


def least_over(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of every ``n`` consecutive values, in log2(n) steps."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if width < n else x


def anchors(hashes: np.ndarray, size: int) -> np.ndarray:
    """The anchor of each window of one text."""
    run = min(ANCHOR, size)
    return least_over(windows(hashes, run, 1), size - run + 1)


def cells(anchor: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each anchor in each row of the sketch."""
    return [(mixed(anchor ^ np.uint64(0x5851F42D4C957F2D * (r + 1) & (1 << 64) - 1)) % np.uint64(width)).astype(np.int64) + r * width for r in range(ROWS)]


def sketch(docs: DataFrame, text: str, size: int, width: int) -> bytes:
    """One bit a cell, packed: whether the merged counters hold at least two. Its size is bounded
    by ``ROWS * MAX_CELLS / 8`` bytes whatever the input."""
    blocks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, min(blocks, ROWS * width // 8))
    span = (ROWS * width // blocks // 8 + 1) * 8

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells that this partition met, once or more often."""
        found: list[np.ndarray] = []

        def sent():
            cell, n = np.unique(np.concatenate(found), return_counts=True)
            found.clear()
            block = cell // span
            edge = np.flatnonzero(np.diff(block, prepend=-1))
            for a, b in zip(edge, [*edge[1:], len(cell)]):
                yield int(block[a]), (cell[a:b] - block[a] * span).astype(np.uint32).tobytes(), np.minimum(n[a:b], 2).astype(np.uint8).tobytes()

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["block", "cell", "n"])

        held = 0
        for batch in batches:
            for _, bounds, h, _, _ in word_hashes(batch.column(0)):
                for a, b in zip(bounds[:-1], bounds[1:]):
                    if b - a >= size:
                        own = anchors(h[a:b], size)
                        own = own[np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))]
                        found.extend(cells(own, width))
                        held += ROWS * len(own)
                if held > 2_000_000:
                    yield batch_of(sent())
                    held = 0
        if held:
            yield batch_of(sent())

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of the partitions' counters, block by block."""
        counters: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cell, n in zip(*(c.to_pylist() for c in batch.columns)):
                own = counters.setdefault(block, np.zeros(span, np.uint8))
                cell = np.frombuffer(cell, np.uint32)
                own[cell] = np.minimum(own[cell] + np.frombuffer(n, np.uint8), 2)
        for block, own in counters.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(own > 1).tobytes()], pa.binary())], ["block", "bits"])

    parts = docs.select(text).mapInArrow(partial, "block int, cell binary, n binary")
    bits = np.zeros(span * blocks // 8, np.uint8)
    for row in parts.repartition(blocks, "block").mapInArrow(merged, "block int, bits binary").toLocalIterator():
        bits[row.block * span // 8 : (row.block + 1) * span // 8] = np.frombuffer(row.bits, np.uint8)
    return bits.tobytes()


def removals(docs: DataFrame, text: str, size: int, width: int, bits) -> DataFrame:
    """Windows of ``docs`` (columns id, row, text) that go, as (id, row, lo, hi, more): ranges of
    window starts, hi exclusive, and further starts (packed 32-bit integers). ``row`` is the text's
    64-bit hash, which tells rows of one id apart."""

    def found_rows(h1, h2, doc, row, at, n, more, n_more):
        ends = np.concatenate([[0], np.cumsum(4 * n_more)]).astype(np.int32)
        packed = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(more.astype(np.int32))])
        columns = [h1.view(np.int64), h2.astype(np.int32), doc, row, at.astype(np.int32), n.astype(np.int32)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), packed], ["h1", "h2", "id", "row", "at", "n", "more"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = np.frombuffer(bits.value, np.uint8)
        held: list[tuple] = []
        n = 0

        def flush():
            h1, h2, doc, row, at = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((at, row, doc, h2, h1))
            h1, h2, doc, row, at = (x[order] for x in (h1, h2, doc, row, at))
            # Copies of a row without an id, or of one that is there twice, are one text.
            own = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1])])
            h1, h2, doc, row, at = (x[own] for x in (h1, h2, doc, row, at))
            fresh = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            least = doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
            gone = doc > least
            d, r, p = doc[gone], row[gone], at[gone]
            order = np.lexsort((p, r, d))
            d, r, p = d[order], r[order], p[order]
            cut = np.concatenate([[True], (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)]) if len(r) else np.zeros(0, bool)
            first = np.flatnonzero(cut)
            n = np.diff(first, append=len(r))
            d, r, p = d[first], r[first], p[first]
            none = np.zeros(len(d), np.int64)
            yield found_rows(mixed(d.view(np.uint64) ^ mixed(r.view(np.uint64) ^ mixed(p.view(np.uint64)))), none, d, r, p, n, none[:0], none)
            h1, h2, doc, row, at = (x[~gone] for x in (h1, h2, doc, row, at))
            # All starts of one window in one text are neighbours now, the first of them in front.
            front = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])])
            first = np.flatnonzero(front)
            n_more = np.diff(first, append=len(at)) - 1
            for a in range(0, len(first), 200_000):
                k = first[a : a + 200_000]
                part = slice(k[0], k[-1] + n_more[a + len(k) - 1] + 1)
                yield found_rows(h1[k], h2[k], doc[k], row[k], at[k], np.zeros(len(k)), at[part][~front[part]], n_more[a : a + 200_000])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            rows = batch.column(1).to_numpy(zero_copy_only=False)
            for i, bounds, h, _, _ in word_hashes(batch.column(2)):
                for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                    if b - a < size:
                        continue
                    own = anchors(h[a:b], size)
                    hit = np.ones(len(own), bool)
                    for c in cells(own, width):
                        hit &= (repeated[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
                    at = np.flatnonzero(hit)
                    if len(at):
                        held.append((windows(h[a:b], size)[at], (windows(h[a:b], size, 7)[at] >> np.uint64(33)).astype(np.int64), np.full(len(at), ids[i + k]), np.full(len(at), rows[i + k]), at))
                        n += len(at)
                if n > BLOCK_WINDOWS:
                    yield from flush()
                    n = 0
        if held:
            yield from flush()

    found = docs.select("id", "row", text).mapInArrow(judged, "h1 long, h2 int, id long, row long, at int, n int, more binary")
    # n is 0 for a window that is still open; ranges already decided pass under keys of their own.
    gone = found.withColumn("least", F.min("id").over(W.partitionBy("h1", "h2"))).where("n > 0 OR id > least")
    return gone.select("id", "row", F.col("at").alias("lo"), (F.col("at") + F.greatest("n", F.lit(1))).alias("hi"), "more")


def cut(texts: pa.Array, ranges: pa.Array, size: int) -> pa.Array:
    """The words of each text that no range of windows covers, and how many there were and went."""
    kept, words, gone = [], [], []
    ranges = ranges.to_pylist()
    whole = pa.array(texts)
    if isinstance(whole, pa.ChunkedArray):
        whole = whole.combine_chunks()
    for i, bounds, _, s, e in word_hashes(whole):
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            raw = memoryview((whole[i + k].as_py() or "").encode())
            base = int(s[a]) - (len(raw) - len(bytes(raw).lstrip(b" \t\n\v\f\r"))) if b > a else 0
            stay = np.ones(b - a, bool)
            for r in ranges[i + k] or ():
                stay[r["lo"] : r["hi"] - 1 + size] = False
                for start in np.frombuffer(r["more"], np.int32).tolist():
                    stay[start : start + size] = False
            s_k, e_k = s[a:b] - base, e[a:b] - base
            kept.append(b" ".join([raw[x:y] for x, y in zip(s_k[stay].tolist(), e_k[stay].tolist())]).decode())
            words.append(int(b - a))
            gone.append(int((~stay).sum()))
    return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(words, pa.int64()), pa.array(gone, pa.int64())], ["kept", "n_words", "n_removed"])


def dedup_substrings(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 50) -> DataFrame:
    """``docs`` with ``kept`` (the words that stay, joined by one space), ``n_words`` and
    ``n_removed``."""
    small_batches(docs.sparkSession)
    own_id = F.coalesce(F.col(id).cast("long"), F.lit(NO_ID))
    row = F.xxhash64(text)
    keyed = docs.select(own_id.alias("id"), row.alias("row"), F.col(text))
    n_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    width = MIN_CELLS
    while width < min(n_bytes // 14, MAX_CELLS):  # some eight cells for each anchor that prose has
        width *= 2
    bits = docs.sparkSession.sparkContext.broadcast(sketch(docs, text, size, width))
    gone = removals(keyed, text, size, width, bits)
    # What several tasks found in copies of one row is kept once, in the exchange that collects a row's ranges.
    gone = gone.repartition("id", "row").dropDuplicates(["id", "row", "lo", "hi", "more"])
    gone = gone.groupBy(F.col("id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_list(F.struct("lo", "hi", "more")).alias("__ranges"))

    @F.arrow_udf(T.StructType([T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]))
    def cut_all(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        return cut(texts, ranges, size)

    # A filter on the results would run a deterministic function a second time, in two more Python workers an executor.
    cut_all = cut_all.asNondeterministic()
    joined = docs.withColumns({"__id": own_id, "__row": row}).join(gone, ["__id", "__row"], "left")
    made = joined.withColumn("__cut", cut_all(F.col(text), F.col("__ranges")))
    results = ("kept", "n_words", "n_removed")
    return made.select(*[F.col(f"`{c}`") for c in docs.columns if c not in results], "__cut.kept", "__cut.n_words", "__cut.n_removed")


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated windows of 50 words removed from every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_substrings(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
