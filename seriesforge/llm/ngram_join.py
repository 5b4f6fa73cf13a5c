"""Jaccard join on word shingles, size-aware (operator 6).

Two sets of sizes a and b link when they share c(a, b) = ceil(4 (a + b) / 9) shingles. Light sets,
those up to a boundary, enumerate their subsets of just the sizes c that a partner can ask for:
whoever meets in the list of a subset of that size is linked, so a list needs no pairs and no
check, only its smallest member, to which all that may link through it are tied. Heavy sets are
found by scanning inverted lists: sets that link share one of their first ``n - ceil(0.8 n) + 1``
shingles in any common order, here the rare before the frequent. The boundary is the one that costs
least by counts over all texts.

A heavy list first compares all its members with one of them only, its pivot (equal sets are one
node, so copies never meet here). What the pivots have brought together need not be compared any
more; then each set scans its lists for members that still lie in another component, and those
that share as many lists with it as a link takes are compared, in blocks where a list is long. All
pairs are verified on the whole sets. So a group of thousands of near copies costs a comparison for
each member and list, and no link between different components is lost.

Defined results: a null or empty text has no shingles and links with nothing; a null id takes no
part (component null); rows of one id are one node, as far as they have words; copies link; extra
columns are not read. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seriesforge.llm.common import components, small_batches, whole_groups, written
from seriesforge.llm.words import mixed, windows, word_hashes

SHINGLE = 5
#: The largest boundary: beyond it subsets of 0.8 of a set are too many for any list to be worse.
MOST_LIGHT = 16
#: Entries of the broadcast order (16 bytes each). Shingles without one count as rare: only the order depends on it.
FREQUENT = 1 << 18
#: Rows of a list that one piece of work takes; longer ones are cut into parts.
LIST_ROWS = 8192
BLOCK_SHINGLES = 1_000_000
PAIRS = 1 << 20
PLACE = (1 << 32) - 1

log = logging.getLogger(__name__)


class Block:
    """Some documents of a task: ids, sizes, and their distinct shingles, text after text."""

    def __init__(self, ids: list, sets: list[np.ndarray]):
        self.ids = np.asarray(ids, np.int64)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.shingles = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)

    def prints(self) -> np.ndarray:
        """A fingerprint of each set."""
        sums = np.zeros(len(self.shingles) + 1, np.uint64)
        np.cumsum(mixed(self.shingles ^ np.uint64(0x2545F4914F6CDD1D)), out=sums[1:])
        ends = np.cumsum(self.sizes)
        return mixed(sums[ends] - sums[ends - self.sizes] + self.sizes.astype(np.uint64)).view(np.int64)

    def distinct(self) -> "Block":
        """One document for each set, its id the fingerprint."""
        prints, mask = self.prints(), np.zeros(len(self.ids), bool)
        first = np.unique(prints, return_index=True)[1]
        mask[first] = self.sizes[first] > 0
        new = Block.__new__(Block)
        new.ids, new.sizes, new.shingles = prints[mask], self.sizes[mask], self.shingles[mask[self.owner]]
        new.owner = np.repeat(np.arange(len(new.ids)), new.sizes)
        return new


def set_of(hashes: np.ndarray) -> np.ndarray:
    """Distinct shingles of one text; one for the whole sequence if it has fewer words."""
    if len(hashes) >= SHINGLE:
        return np.unique(windows(hashes, SHINGLE))
    return windows(hashes, len(hashes), len(hashes) + 1) if len(hashes) else np.zeros(0, np.uint64)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """The documents (id, text) of a task in blocks of bounded size."""
    ids: list = []
    sets: list = []
    held = 0
    for batch in batches:
        own = batch.column(0).to_pylist()
        for i, bounds, h, _, _ in word_hashes(batch.column(1), lower=True):
            for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                ids.append(own[i + k])
                sets.append(set_of(h[a:b]))
                held += len(sets[-1])
                if held > BLOCK_SHINGLES:
                    yield Block(ids, sets)
                    ids, sets, held = [], [], 0
    if ids:
        yield Block(ids, sets)


def common(a, b):
    """How many shingles sets of sizes a and b share at least if they link."""
    return -(-4 * (a + b) // 9)


def prefix(size):
    """How many first shingles of a set, in the common order, surely hold one of any set it links with."""
    return size - (4 * size + 4) // 5 + 1


def subset_sizes(size: int, light: int) -> list[int]:
    """Sizes of the subsets by which a set meets its partners, where one of the two is light."""
    return sorted({common(size, p) for p in range((4 * size + 4) // 5, 5 * size // 4 + 1) if min(size, p) <= light})


def boundary(costs: dict[int, tuple[int, int]]) -> int:
    """The largest light size, by {size: (sets, rows of their lists)}: a light set costs the subsets
    it lists, a heavy one its prefix and the rows it meets there; equal costs are for subsets, which
    need no check."""

    def total(light: int) -> int:
        heavy = sum(n * prefix(s) + met for s, (n, met) in costs.items() if s > light)
        return heavy + sum(n * sum(comb(s, c) for c in subset_sizes(s, light)) for s, (n, _) in costs.items())

    return min(range(MOST_LIGHT + 1), key=lambda light: (total(light), -light))


def survey(docs: DataFrame) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray], int]:
    """Over all texts: (id, node, n); the frequent shingles, in order of their hash, with their
    counts; and the boundary between light and heavy."""
    most = MOST_LIGHT * 5 // 4

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind, *columns):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *(pa.array(np.asarray(c, np.int64)) for c in columns)], ["kind", "a", "b", "n"])

        for block in blocks(batches):
            yield rows(0, block.ids, block.prints(), block.sizes)
            block = block.distinct()
            shingle, place, n = np.unique(block.shingles, return_inverse=True, return_counts=True)
            often = n >= 3
            yield rows(1, shingle[often].view(np.int64), n[often], n[often])
            counts, ends = n[place], np.cumsum(block.sizes)
            cost = np.zeros((most + 1, 2), np.int64)
            for d in np.flatnonzero(block.sizes <= most):
                s = int(block.sizes[d])
                cost[s] += 1, (np.sort(counts[ends[d] - s : ends[d]])[: prefix(s)] - 1).sum()
            some = np.flatnonzero(cost[:, 0])
            yield rows(2, some, cost[some, 0], cost[some, 1])
            yield rows(3, [0], [1], [1])

    found = written(docs.mapInArrow(seen, "kind int, a long, b long, n long"), "survey")
    sets = found.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("node"), "n")
    often = found.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a").limit(FREQUENT).toPandas()
    shingle = often["a"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(shingle)
    counts = {(r.kind, r.a): (r.b, r.n) for r in found.where("kind >= 2").groupBy("kind", "a").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).collect()}
    blocks_ = counts.get((3, 0), (1, 1))[0]
    costs = {s: (n, met * blocks_) for (kind, s), (n, met) in counts.items() if kind == 2}
    light = boundary(costs)
    log.info("sets of up to %d shingles are light", light)
    return sets, (shingle[order], often["n"].to_numpy(np.int64)[order]), light


def ranks(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How often each shingle was counted; 0 for those that aren't frequent."""
    shingle, count = frequent
    if not len(shingle):
        return np.zeros(len(shingles), np.int64)
    at = np.minimum(np.searchsorted(shingle, shingles), len(shingle) - 1)
    return np.where(shingle[at] == shingles, count[at], 0)


def postings(docs: DataFrame, frequent, light: int) -> DataFrame:
    """(key, part, node, at): the prefix lists of heavy sets, part 0, ``at`` being size << 32 | place
    in the order; and the lists of subsets of light sets, part -1, at being size << 32 | size of the
    subset. Lists of frequent shingles have parts from 1 or from -2 on, which tasks share."""

    def parts(node: np.ndarray, salt: np.ndarray, rank: np.ndarray) -> np.ndarray:
        lists = 1 + rank // LIST_ROWS
        spread = mixed(node.view(np.uint64) ^ mixed(salt.view(np.uint64))) % lists.astype(np.uint64)
        return spread.astype(np.int32) + (lists > 1)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            salt = block.ids[:1]  # copies of a set in several blocks go to several parts
            block = block.distinct()
            rank = ranks(block.shingles, frequent.value)
            order = np.lexsort((block.shingles, rank, block.owner))
            place = np.arange(len(order)) - np.repeat(np.cumsum(block.sizes) - block.sizes, block.sizes)
            chosen = (place < prefix(block.sizes)[block.owner]) & (block.sizes > light)[block.owner]
            place, taken = place[chosen], order[chosen]
            owner = block.owner[taken]
            columns = [[block.shingles[taken]], [parts(block.ids[owner], salt, rank[taken])], [owner], [block.sizes[owner] << 32 | place]]
            ends = np.cumsum(block.sizes)
            for d in np.flatnonzero((4 * block.sizes + 4) // 5 <= light):
                s = int(block.sizes[d])
                own = mixed(block.shingles[ends[d] - s : ends[d]] ^ np.uint64(0xA0761D6478BD642F)).tolist()
                often = rank[ends[d] - s : ends[d]].tolist()
                for c in subset_sizes(s, light):
                    subsets = list(combinations(range(s), c))
                    sums = mixed(np.array([sum(map(own.__getitem__, x)) + c & (1 << 64) - 1 for x in subsets], np.uint64))
                    most = np.array([min(map(often.__getitem__, x)) for x in subsets])  # a list is no longer than that
                    part = -1 - parts(np.full(len(sums), block.ids[d]), salt, most)
                    for held, x in zip(columns, (sums, part, np.full(len(sums), d), np.full(len(sums), s << 32 | c))):
                        held.append(x)
            key, part, owner, at = (np.concatenate(c) for c in columns)
            for a in range(0, len(key), 200_000):
                k = slice(a, a + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[k].view(np.int64)), pa.array(part[k].astype(np.int32)), pa.array(block.ids[owner[k]]), pa.array(at[k])], ["key", "part", "node", "at"])

    return docs.mapInArrow(made, "key long, part int, node long, at long")


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's postings those whose list has two nodes or is shared with other tasks, with the
    list's pivot: in a light list its smallest set, in a heavy one the set that has the shingle
    earliest in the order, as it has the fewest rare ones of its own (an original among its copies).
    Postings come sorted, and are worked on some lists at a time."""
    for columns in whole_groups(batches, 2):
        yield from met_lists(*columns)


def met_lists(key: np.ndarray, part: np.ndarray, node: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``met`` of whole lists, each sorted by size or place in the order, then node."""
    same = (key[1:] == key[:-1]) & (part[1:] == part[:-1])
    stay = np.concatenate([[True], ~same | (node[1:] != node[:-1])])
    key, part, node, at = key[stay], part[stay], node[stay], at[stay]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
    n = np.diff(first, append=len(key))
    pivot, pivot_at = np.repeat(node[first], n), np.repeat(at[first], n)
    some = np.flatnonzero((np.repeat(n, n) > 1) | (part > 0) | (part < -1))
    for a in range(0, len(some), 200_000):
        k = some[a : a + 200_000]
        yield pa.RecordBatch.from_arrays([pa.array(c[k]) for c in (key, part, node, at, pivot, pivot_at)], ["key", "part", "node", "at", "pivot", "pivot_at"])


def near_sizes(a, b):
    """Whether sets of sizes a and b can link. On columns or arrays."""
    return (5 * a >= 4 * b) & (5 * b >= 4 * a)


def shared_lists(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many lists sets of sizes a and b share at least if they link: what they have in common
    beyond the prefix that ends first in the order is no more than what that set has there."""
    return np.maximum(common(a, b) - np.maximum(a - prefix(a), b - prefix(b)), 1)


def across(lists: DataFrame) -> DataFrame:
    """Pairs (x, y) of nodes with different labels that share as many lists (rows key, node, size,
    label) as a link takes. Long lists are worked on in pairs of parts; a set's partners travel
    packed, a row for each set and list, and are counted set by set."""
    several = lists.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"))
    several = written(several.where("low < high").select("key", F.ceil(F.col("n") / LIST_ROWS).cast("int").alias("parts")), "mixed-lists")
    rows = lists.join(several, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
    rows = rows.select("key", "node", "size", "label", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rows = rows.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "size", "label", "own")

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each set of a list with those of the same size or larger that have another label. Lists come sorted."""
        for columns in whole_groups(batches, 3):
            yield from pairs_of(*columns)

    def pairs_of(key, low, high, node, size, label, own):
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
        out: list[tuple] = []
        held = 0

        def sent():
            types = pa.int64(), pa.int64(), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], ["x", "size", "partners", "sizes"])

        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(key)]):
            reach = np.searchsorted(size[a:b], size[a:b] * 5 // 4, "right") + a  # sorted by size
            whole = low[a] == high[a]
            for i in range(a, b - 1):
                j = np.arange(i + 1, reach[i - a])
                j = j[label[j] != label[i]] if whole else j[(label[j] != label[i]) & (own[j] != own[i])]
                if len(j):
                    out.append((int(node[i]), int(size[i]), node[j].tobytes(), size[j].astype(np.int32).tobytes()))
                    held += len(j)
                if held > PAIRS or len(out) > 20_000:
                    yield sent()
                    out, held = [], 0
        if out:
            yield sent()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The partners of each set (its rows are neighbours) that share enough lists with it."""

        def enough(x: int, size: int, partners: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
            names, first, n = np.unique(np.concatenate(partners), return_index=True, return_counts=True)
            return names[n >= shared_lists(np.int64(size), np.concatenate(sizes)[first].astype(np.int64))]

        now, partners, sizes = None, [], []
        for batch in batches:
            out = []
            for x, size, some, their in zip(*(batch.column(c) for c in range(4))):
                own = x.as_py(), size.as_py()
                if own != now:
                    if partners:
                        out.append((now[0], enough(*now, partners, sizes)))
                    now, partners, sizes = own, [], []
                partners.append(np.frombuffer(some.as_buffer(), np.int64))
                sizes.append(np.frombuffer(their.as_buffer(), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([x for x, _ in out], np.int64), [len(y) for _, y in out])), pa.array(np.concatenate([np.zeros(0, np.int64), *(y for _, y in out)]))], ["x", "y"])
            partners, sizes = [p.copy() for p in partners], [p.copy() for p in sizes]
        if partners:
            y = enough(*now, partners, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), now[0])), pa.array(y)], ["x", "y"])

    ordered = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "size", "node")
    packed = ordered.mapInArrow(paired, "x long, size long, partners binary, sizes binary")
    return packed.repartition("x").sortWithinPartitions("x", "size").mapInArrow(counted, "x long, y long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (x, y) of ``pairs`` that link, by their whole ``sets`` (node, shingles). Each pair meets
    its two sets by joins, so no set is held with more than one other."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                x, y = (x, y) if len(x) < len(y) else (y, x)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(9 * both >= 4 * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"{k}_set")) for k in ("x", "y"))
    both = pairs.join(one, "x").join(two, "y").select("x", "y", "x_set", "y_set")
    return both.mapInArrow(shared, "a long, b long").distinct()


def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingles) of documents (id, text)."""
    for batch in batches:
        for i, bounds, h, _, _ in word_hashes(batch.column(1), lower=True):
            sets = [set_of(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            if sets:
                block = Block(list(range(len(sets))), sets)
                yield pa.RecordBatch.from_arrays([pa.array(block.prints()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])


def sets_of(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes of ``pairs``, from one row of ``docs`` for each id and text."""
    named = pairs.select("x").union(pairs.select("y")).distinct().join(nodes, F.col("x") == F.col("node")).select("node", "id")
    named = written(named, "named")
    # Texts and ids both grow with the input: they are shuffled at any size.
    wanted = docs.join(named.select("id").distinct().hint("merge"), "id", "left_semi").groupBy("id", F.xxhash64("text")).agg(F.first("text").alias("text"))
    sets = wanted.select("id", "text").mapInArrow(shingled, "node long, shingles binary")
    return written(sets.join(named.select("node"), "node", "left_semi"), "sets")


def links(docs: DataFrame, nodes: DataFrame, frequent, light: int) -> DataFrame:
    """Edges (a, b) between nodes of ``docs`` (id, text) that connect all that links; ``nodes``
    (node, id): one document for each set."""
    place_in_list = F.when(F.col("part") < 0, F.shiftright("at", 32)).otherwise(F.col("at").bitwiseAND(F.lit(PLACE)))
    lists = postings(docs, frequent, light).repartition("key", "part").sortWithinPartitions("key", "part", place_in_list, "node").mapInArrow(met, "key long, part int, node long, at long, pivot long, pivot_at long")
    lists = written(lists, "lists").withColumn("light", F.col("part") < 0)
    # Pivots of lists in parts meet in the smallest of them; a light list needs that for all its members.
    split = lists.where("part > 0 OR part < -1")
    smallest = F.min(F.struct(F.when(F.col("light"), F.shiftright("at", 32)).otherwise(F.col("at").bitwiseAND(F.lit(PLACE))), F.col("node").alias("pivot"), F.col("at").alias("pivot_at")))
    top = split.where("node = pivot").groupBy("key", "light").agg(smallest.alias("top")).select("key", "light", "top.pivot", "top.pivot_at")
    top = written(top, "tops")
    heads = split.where("light OR node = pivot").select("key", "light", "node", "at").join(top, ["key", "light"])
    met_once = lists.where("part >= -1").select("key", "light", "node", "at", "pivot", "pivot_at")
    met_once = met_once.union(lists.where("part > 0").select(*met_once.columns)).union(heads).where("node <> pivot")
    size, other, place, spot = F.shiftright("at", 32), F.shiftright("pivot_at", 32), F.col("at").bitwiseAND(F.lit(PLACE)), F.col("pivot_at").bitwiseAND(F.lit(PLACE))
    met_once = met_once.select("light", F.col("node").alias("x"), F.col("pivot").alias("y"), size.alias("a"), other.alias("b"), place.alias("c"), spot.alias("d"))
    found = written(met_once.where("light AND 9 * c >= 4 * (a + b)").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "light-links")
    # A pivot may change from list to list: larger sets must meet one twice, and once where all before may differ.
    stars = met_once.where(~F.col("light") & near_sizes(F.col("a"), F.col("b")))
    stars = stars.groupBy("x", "y").agg(F.count("*").alias("n"), F.max(F.least(F.expr("a - c"), F.expr("b - d"))).alias("left"), F.min(F.expr("a + b")).alias("both"))
    stars = written(stars.where("9 * left >= 4 * both AND n >= IF(both < 80, 1, 2)").select("x", "y"), "stars")
    near = written(verified(stars, sets_of(stars, docs, nodes)), "star-links").union(found)
    label = components(near).withColumnRenamed("component", "label")
    heavy = lists.where(~F.col("light")).select("key", "node", F.shiftright("at", 32).alias("size")).distinct()
    heavy = heavy.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    pairs = written(across(heavy), "pairs")
    return near.union(written(verified(pairs, sets_of(pairs, docs, nodes)), "cross-links"))


def jaccard_components(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row: documents link where the Jaccard similarity of
    their shingle sets is 0.8 or more."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    known = docs.where("id is not null")
    sets, often, light = survey(known)
    filled = sets.where("n > 0")
    nodes = written(filled.groupBy("node").agg(F.min("id").alias("id"), F.max("id").alias("last")), "nodes")
    found = links(known, nodes.select("node", "id"), spark.sparkContext.broadcast(often), light)
    # Rows of one id are one node.
    several = filled.groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("high")).where("b < high").select("id", "b")
    found = found.union(filled.join(several, "id").select(F.col("node").alias("a"), "b").where("a <> b").distinct())
    groups = written(components(found), "groups")
    least = groups.join(nodes, "node").groupBy("component").agg(F.min("id").alias("component_id"))
    grouped = groups.join(least, "component").select("node", "component_id")
    copies = nodes.where("id < last").join(groups, "node", "left_anti").select("node", F.col("id").alias("component_id"))
    places = written(grouped.union(copies), "places")
    out = sets.join(places, "node", "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, bounds, h, _, _ in word_hashes(batch.column(0), lower=True):
                n = [len(set_of(h[a:b])) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int64())], ["id", "n_shingles", "component_id"])

    nameless = docs.where("id is null").select("text").mapInArrow(sizes, "id long, n_shingles long, component_id long")
    return out.union(nameless).withColumnRenamed("id", id)


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Components of all ``documents`` whose five-word shingles have a similarity of 0.8."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
