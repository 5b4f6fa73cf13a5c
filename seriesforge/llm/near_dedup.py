"""Near-duplicate vectors with an inverted multi-index (operator 9).

Two codebooks, one for each half of a normalised vector, form a grid of cells; every vector lies in
the cell of its nearest codewords. A vector visits cells by the multi-sequence order of its bounds
(the distances of both halves to the codewords' Voronoi regions) until the target recall is
reached, and verifies what it meets in doubles. How far that is, is measured first: the true links
of ``PROBES`` vectors against all others, found by brute force in blocks, show at which bound the
target share of them has been met, each probe that has links counting alike; the traversal goes
twice as far, and at least ``LEAST`` of the way at which no link at all could be missed. Where too few
probes have links to tell, and they aren't all vectors, or with a target recall of 1, it goes all
that way: the exact result. A link found from either side counts for both.

The codebooks are fitted on at most ``SAMPLE`` vectors; all are indexed. Equal vectors are one node
with a count. A grid row is one piece of work, cut by a hash into pieces of about ``MEMBERS``
vectors where it holds more; a piece takes its own vectors and those that visit them, as packed
matrices, and returns counts and a spanning forest of its links, not the pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing; shorter vectors count as filled up with zeros; rows of one id are one node for the
components; a null id takes no part (0 links, null component and kept); extra columns aren't read.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from seriesforge.llm.common import components, written
from seriesforge.llm.vectors import packs, usable, width_of
from seriesforge.llm.words import mixed

SAMPLE = 16_384
#: Vectors probed; the larger number if under ENOUGH of the smaller one have links.
PROBES, ENOUGH = (1000, 8000), 200
STEPS = 1000
TARGET_RECALL = 0.999
LEAST = 0.02
PACK = 512
MEMBERS = 8192
PER_CELL = 4
#: Codewords a half: the sample has eight vectors for each at least.
MOST_WORDS = SAMPLE // 8

log = logging.getLogger(__name__)


def codebook(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from evenly picked points."""
    points = np.unique(points, axis=0)
    centers = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)]
    for _ in range(rounds):
        near = nearest(points, centers)
        n = np.bincount(near, minlength=len(centers))
        sums = np.stack([np.bincount(near, x, len(centers)) for x in points.T], 1) if points.shape[1] else np.zeros_like(centers)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def squares(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((points**2).sum(1)[:, None] + (centers**2).sum(1) - 2 * points @ centers.T, 0)


def nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The index of the nearest center."""
    return np.concatenate([squares(points[a : a + 2048], centers).argmin(1) for a in range(0, len(points), 2048)])


def bounds(points: np.ndarray, centers: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance from each point that no point of a center's Voronoi region undercuts, and
    the point's own center; ``apart``: the centers' distances."""
    d = squares(points, centers)
    own = d.argmin(1)
    gap, to = d - d[np.arange(len(d)), own][:, None], apart[own]
    return np.maximum(np.where(to > 1e-12, gap / (2 * np.maximum(to, 1e-12)), 0), 0) ** 2, own


def traversal(first: np.ndarray, second: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multi-sequence traversal of one batch: (vector, i, j) of every cell whose bound, the sum of
    both halves', is within ``reach``. Along each vector's sorted first sequence, as far as that
    alone allows, the sorted second is followed as far as the sum allows."""
    one, two = np.argsort(first, 1), np.argsort(second, 1)
    a, b = np.take_along_axis(first, one, 1), np.take_along_axis(second, two, 1)
    v, at = np.nonzero(a <= reach)
    m = np.concatenate([(b[v[k : k + PACK]] <= (reach - a[v[k : k + PACK], at[k : k + PACK]])[:, None]).sum(1) for k in range(0, len(v), PACK)] or [v])
    v, i = np.repeat(v, m), np.repeat(one[v, at], m)
    steps = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    return v, i, two[v, steps]


def forest(n: int, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node of the links (p, q) among ``n`` nodes that isn't its tree's root,
    the smallest node of its component."""
    top = np.arange(n)
    while True:
        least = np.minimum(top[p], top[q])
        after = top.copy()
        np.minimum.at(after, p, least)
        np.minimum.at(after, q, least)
        np.minimum.at(after, top[p], least)
        np.minimum.at(after, top[q], least)
        after = after[after]
        if (after == top).all():
            node = np.flatnonzero(top != np.arange(n))
            return node, top[node]
        top = after


def near_duplicates(df: DataFrame, id: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, target_recall: float = TARGET_RECALL) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``df``. With a ``target_recall`` of 1 no
    link is missed."""
    spark = df.sparkSession
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    nonzero = F.exists("v", lambda x: x != 0)
    ok = F.col("id").isNotNull() & usable("v") & F.coalesce(nonzero, F.lit(False))
    rows = rows.withColumn("h1", F.when(ok, F.xxhash64("v"))).withColumn("h2", F.when(ok, F.xxhash64(F.lit(7), "v")))
    copies = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("v").alias("v"))
    copies = written(copies, "vectors")
    n, width = copies.count(), width_of(copies, "v")
    if n:
        kind = np.float32 if df.schema[vector].dataType == T.ArrayType(T.FloatType()) else np.float64
        found = links(copies.select("node", "copies", "v"), n, width, cosine, kind, target_recall)
    else:
        found = spark.createDataFrame([], "a long, b long, n long")
    counts = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    own = rows.join(copies.select("h1", "h2", "node", "copies"), ["h1", "h2"], "left").select("id", "node", "copies")
    own = written(own, "members")
    same = own.where("node is not null and id <> node").select(F.col("id").alias("a"), F.col("node").alias("b")).distinct()
    groups = components(found.where("n is null").select("a", "b").union(same))
    out = own.join(counts, "node", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    n_links = F.coalesce(F.col("n") + F.col("copies") - 1, F.col("copies") - 1, F.lit(0)).cast("long")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id), n_links.alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows as doubles of length one, whatever their size."""
    v = v.astype(float)
    v /= np.abs(v).max(1)[:, None]
    return v / np.sqrt((v**2).sum(1))[:, None]


class Grid:
    """The codebooks with their centers' distances, made once in each task."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], half: int):
        self.half, self.books, self.width = half, books, len(books[1])
        self.apart = [np.sqrt(squares(b, b)) for b in books]

    def cells(self, unit_vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of each vector's own cell."""
        return nearest(unit_vectors[:, : self.half], self.books[0]), nearest(unit_vectors[:, self.half :], self.books[1])

    def bounds(self, unit_vectors: np.ndarray):
        """((bounds to rows, own row), (bounds to columns, own column))."""
        return tuple(bounds(x, b, a) for x, b, a in zip((unit_vectors[:, : self.half], unit_vectors[:, self.half :]), self.books, self.apart))


def traversal_reach(nodes: DataFrame, n: int, width: int, cosine: float, books, half: int, target_recall: float) -> float:
    """The bound at which the traversal ends (see above)."""
    whole = 2 - 2 * cosine + 1e-9
    if target_recall >= 1:
        return whole
    for wanted in PROBES:
        by_step, linked = probed(nodes, wanted, width, cosine, books, half)
        if linked >= ENOUGH or wanted >= n:
            break
    else:
        log.info("under %d of %d probes have links: the traversal goes the whole way", ENOUGH, wanted)
        return whole
    so_far, share = 0.0, 0.0
    for step in sorted(by_step):
        so_far += by_step[step] / linked
        share = 2 * (step + 1) / STEPS
        if so_far >= target_recall:
            break
    reach = min(max(share, LEAST), 1) * whole
    there = sum(v for k, v in by_step.items() if (k + 1) / STEPS * whole <= reach) / max(linked, 1)
    log.info("of %d probes with links %.5f of each one's links lie within the traversal", linked, there)
    return reach


def probed(nodes: DataFrame, wanted: int, width: int, cosine: float, books, half: int) -> tuple[dict[int, float], int]:
    """({step: share}, probes): the links of ``wanted`` vectors, found by brute force, by the thousandth of the
    whole way at which they are met. Each probe that has links counts alike, however many they are,
    so one large group doesn't outvote the sparse pairs."""
    spark, whole = nodes.sparkSession, 2 - 2 * cosine + 1e-9
    probes = nodes.orderBy(F.xxhash64(F.lit(3), "node"), "node").limit(wanted).select("node", "copies", "v")
    ids, _, v = next(packs(probes.toArrow().combine_chunks().to_batches(), width, wanted))
    held = spark.sparkContext.broadcast((ids, unit(v)))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, (own, probe) = Grid(books.value, half), held.value
        (first, _), (second, _) = grid.bounds(probe)
        for ids, _, v in packs(batches, width, PACK):
            u = unit(v)
            p, q = np.nonzero((probe @ u.T >= cosine) & (own[:, None] != ids))
            i, j = grid.cells(u)
            at = np.minimum((first[p, i[q]] + second[p, j[q]]) / whole * STEPS, STEPS).astype(np.int64)
            key, count = np.unique(p * (STEPS + 1) + at, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key // (STEPS + 1)), pa.array(key % (STEPS + 1)), pa.array(count)], ["probe", "step", "n"])

    found = nodes.mapInArrow(met, "probe long, step long, n long").groupBy("probe", "step").agg(F.sum("n").alias("n"))
    shares = found.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("probe")))
    by_step = {r.step: r.share for r in shares.groupBy("step").agg(F.sum("share").alias("share")).collect()}  # at most STEPS + 1 rows
    return by_step, round(sum(by_step.values()))


def links(nodes: DataFrame, n: int, width: int, cosine: float, kind: type, target_recall: float) -> DataFrame:
    """For nodes (node, copies, v): rows (a, null, links of a) and forest edges (a, b, null).
    Vectors move as ``kind``, the type they came in."""
    spark = nodes.sparkSession
    half = (width + 1) // 2
    k = max(4, min(MOST_WORDS, int(np.sqrt(n / PER_CELL) + 0.5)))
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("node", "copies", "v")
    sample = unit(next(packs(sample.toArrow().combine_chunks().to_batches(), width, SAMPLE))[2])
    books = spark.sparkContext.broadcast((codebook(sample[:, :half], k), codebook(sample[:, half:], k) if width > 1 else np.zeros((1, 0))))
    reach = traversal_reach(nodes, n, width, cosine, books, half, target_recall)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many vectors of a task lie in each grid row."""
        found, grid = np.zeros(len(books.value[0]), np.int64), Grid(books.value, half)
        for _, _, v in packs(batches, width, 2048):
            found += np.bincount(nearest(unit(v)[:, :half], grid.books[0]), minlength=len(found))
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["i", "n"])

    pieces = np.ones(k, np.int64)
    for r in nodes.mapInArrow(rows_of, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # a row a codeword
        pieces[r.i] = -(-r.n // MEMBERS)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs of the vectors that visit a piece of a grid row: its own (guest 0), each with all
        the cells it visits, and guests with the columns they visit in this row."""
        grid = Grid(books.value, half)
        for ids, copies, v in packs(batches, width, PACK):
            (first, own_i), (second, own_j) = grid.bounds(unit(v))
            at, i, j = traversal(first, second, reach)
            home = (mixed(ids.astype(np.int64).view(np.uint64)) % pieces[own_i].astype(np.uint64)).astype(np.int64)
            order = np.argsort(i, kind="stable")
            at, i, j = at[order], i[order], j[order]
            cell, out = own_i * grid.width + own_j, []

            def pack(row: int, piece: int, guest: int, who: np.ndarray, of: np.ndarray, seen: np.ndarray):
                """``seen`` of vectors ``of`` (places in ``who``), in any order."""
                packed = ids[who], copies[who], cell[who], np.bincount(of, minlength=len(who)), seen[np.argsort(of, kind="stable")]
                out.append((int(row), int(piece), guest, *(x.astype(np.int64).tobytes() for x in packed), v[who].astype(kind).tobytes()))

            edge = np.flatnonzero(np.diff(i, prepend=-1))
            for a, b in zip(edge, [*edge[1:], len(i)]):
                row = i[a]
                who, back = np.unique(at[a:b], return_inverse=True)
                for piece in range(pieces[row]):
                    guests = (own_i[who] != row) | (home[who] != piece)
                    if guests.any():
                        keep = guests[back]
                        pack(row, piece, 1, who[guests], (np.cumsum(guests) - 1)[back[keep]], j[a:b][keep])
            for row, piece in np.unique(np.stack([own_i, home], 1), axis=0).tolist():
                who = np.flatnonzero((own_i == row) & (home == piece))
                keep = np.isin(at, who)
                pack(row, piece, 0, who, np.searchsorted(who, at[keep]), i[keep] * grid.width + j[keep])
            types = pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], ["i", "piece", "guest", "ids", "copies", "cell", "n_seen", "seen", "v"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each piece's own vectors come first; then every pack of it meets them."""
        size = len(books.value[1])

        def unpacked(r):
            ids, copies, cell, n_seen, seen = (np.frombuffer(x.as_buffer(), np.int64) for x in r[:5])
            return ids, copies, cell, np.repeat(np.arange(len(ids)), n_seen), seen, unit(np.frombuffer(r[5].as_buffer(), kind).reshape(len(ids), -1))

        def joined(parts):
            """Own packs as one."""
            shift = np.cumsum([0, *(len(p[0]) for p in parts)])
            whole = [np.concatenate([p[k] + (shift[x] if k == 3 else 0) for x, p in enumerate(parts)]) for k in range(6)]
            column = whole[2] % size
            order = np.argsort(column, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            ids, copies, cell, v = whole[0][order], whole[1][order], whole[2][order], whole[5][order]
            return ids, copies, cell, np.sort(place[whole[3]] * (k * size) + whole[4]), v, np.searchsorted(column[order], np.arange(size + 1))

        def met(own, guest, row):
            """One pack against a piece's own vectors, column by column."""
            ids, copies, cell, visited, v, column = own
            to_ids, to_copies, to_cell, of, seen, to_v = guest
            seen_column = seen % size if row is None else seen[seen // size == row] % size
            of = of if row is None else of[seen // size == row]
            order = np.argsort(seen_column, kind="stable")
            of, seen_column = of[order], seen_column[order]
            ps, qs = [], []
            edge = np.flatnonzero(np.diff(seen_column, prepend=-1))
            for a, b in zip(edge, [*edge[1:], len(of)]):
                lo, hi = column[seen_column[a]], column[seen_column[a] + 1]
                if lo < hi:
                    who = of[a:b]
                    for x in range(lo, hi, MEMBERS):
                        y = min(hi, x + MEMBERS)
                        p, q = np.nonzero((to_v[who] @ v[x:y].T >= cosine) & (to_ids[who][:, None] != ids[x:y]))
                        ps.append(who[p])
                        qs.append(q + x)
            if not ps:
                return None
            p, q = np.concatenate(ps), np.concatenate(qs)
            # Unless the member visits this vector's cell too, the link is met only here.
            code = q * (k * size) + to_cell[p]
            at = np.minimum(np.searchsorted(visited, code), max(len(visited) - 1, 0))
            once = visited[at] != code
            total = np.bincount(p, copies[q], len(to_ids)).astype(np.int64)
            back = np.bincount(q[once], to_copies[p[once]], len(ids)).astype(np.int64)
            names, place = np.unique(np.concatenate([to_ids, ids]), return_inverse=True)
            node, root = forest(len(names), place[p], place[len(to_ids) + q])
            some, more = np.flatnonzero(total), np.flatnonzero(back)
            none = len(some) + len(more)
            a = pa.array(np.concatenate([to_ids[some], ids[more], names[node]]))
            b = pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(names[root])])
            n = pa.concat_arrays([pa.array(np.concatenate([total[some], back[more]])), pa.nulls(len(node), pa.int64())])
            return pa.RecordBatch.from_arrays([a, b, n], ["a", "b", "n"])

        piece, parts, own = None, [], None
        for batch in batches:
            for r in zip(*(batch.column(x) for x in range(batch.num_columns))):
                at, guest = (r[0].as_py(), r[1].as_py()), r[2].as_py()
                if at != piece:
                    if parts:
                        own = joined(parts)
                        yield from filter(None, (met(own, p, piece[0]) for p in parts))
                    piece, parts, own = at, [], None
                if not guest:
                    parts.append(unpacked(r[3:]))
                    continue
                if parts:
                    own = joined(parts)
                    yield from filter(None, (met(own, p, piece[0]) for p in parts))
                    parts = []
                if own and (found := met(own, unpacked(r[3:]), None)):
                    yield found
        if parts:
            own = joined(parts)
            yield from filter(None, (met(own, p, piece[0]) for p in parts))

    schema = "i int, piece int, guest int, ids binary, copies binary, cell binary, n_seen binary, seen binary, v binary"
    work = nodes.mapInArrow(visits, schema).repartition("i", "piece").sortWithinPartitions("i", "piece", "guest")
    return written(work.mapInArrow(compared, "a long, b long, n long"), "vector-links")


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    """All rows of ``embeddings``, linked at a cosine of 0.95."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
