"""Charts on a page: reading order, row extent, and joins of what lies inside a window.

The range joins have an equi key (the page, or the page and a cell of it) and a residual predicate,
so they plan as hash or merge joins with a condition, never as nested loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def reading_order(heads: DataFrame, page: str, x: str, y: str, order: str, middle: float, bucket: float = 20.0) -> DataFrame:
    """Adds ``row_top`` (y in buckets) and ``chart``: the rank by row, left half before right."""
    top = F.bround(F.col(y) / F.lit(bucket)) * F.lit(bucket)
    made = heads.withColumn("row_top", top)
    by = W.partitionBy(page).orderBy("row_top", F.col(x) > F.lit(middle), order)
    return made.withColumn("chart", (F.row_number().over(by) - 1).cast("int"))


def row_extent(heads: DataFrame, page: str, height: float, pad: float = 6.0, top: str = "row_top") -> DataFrame:
    """(page, ``top``, row_bottom): a row ends above the next one, the last at the page's end."""
    rows = heads.select(page, top).distinct()
    following = F.lead(top).over(W.partitionBy(page).orderBy(top))
    return rows.withColumn("row_bottom", F.coalesce(following - F.lit(pad), F.lit(height)))


def inside(windows: DataFrame, items: DataFrame, on: list[str], holds: Column) -> DataFrame:
    """Items with the windows of their page that hold them."""
    return windows.join(items, on).where(holds)


def inside_cells(windows: DataFrame, items: DataFrame, on: list[str], box: tuple[Column, Column, Column, Column], point: tuple[Column, Column], holds: Column, cell: tuple[float, float] = (150.0, 40.0)) -> DataFrame:
    """``inside`` as an indexed range join. The plane is cut into cells; a window (``box`` of x0, x1, y0, y1,
    which must hold all that ``holds`` accepts) is entered in each cell that it meets, an item in
    the one of its ``point``. Both join by ``on`` and cell, so an item meets the windows near it
    only, a pair meets once, and one page's items are dealt over its cells. Windows are entered many
    times, which no estimate of sizes sees, so they are dealt out and never broadcast. Windows without
    bounds hold nothing. Columns that both sides have besides ``on`` must not be used in ``holds``."""
    (x0, x1, y0, y1), (w, h) = box, cell
    index = lambda v, size: F.floor(v / F.lit(size)).cast("long")
    spread = windows.withColumn("__cx", F.explode(F.sequence(index(x0, w), F.greatest(index(x0, w), index(x1, w)))))
    spread = spread.withColumn("__cy", F.explode(F.sequence(index(y0, h), F.greatest(index(y0, h), index(y1, h)))))
    placed = items.withColumns({"__cx": index(point[0], w), "__cy": index(point[1], h)})
    return spread.hint("merge").join(placed, [*on, "__cx", "__cy"]).where(holds).drop("__cx", "__cy")


def padded(rows: DataFrame, groups: DataFrame, keys: list[str], slots: int, slot: str = "slot") -> DataFrame:
    """Every group with all its slots, missing ones as nulls."""
    grid = groups.select(*keys).distinct().withColumn(slot, F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    return grid.join(rows, [*keys, slot], "left")


def merged_ahead(blocks: DataFrame, page: str, order: str, y: str, text: str, ahead: int = 2, within: float = 20.0) -> DataFrame:
    """Adds ``merged``: a block's text and that of each of the next ``ahead`` blocks of its page whose
    ``y`` is less than ``within`` from its own, joined by spaces; a null text adds nothing."""
    w = W.partitionBy(page).orderBy(order)
    following = [F.when(F.abs(F.lead(y, k).over(w) - F.col(y)) < F.lit(within), F.lead(text, k).over(w)) for k in range(1, ahead + 1)]
    return blocks.withColumn("merged", F.concat_ws(" ", F.col(text), *following))


def page_windows(headers: DataFrame, pages: DataFrame, y: str, rows: int = 4, columns: int = 2) -> DataFrame:
    """(page, chart, x0, x1, y0, y1): the pixel windows of the charts of ``pages`` (page, width and height in pixels,
    points: the page's height, scale: pixels a point). The distinct tops ``y`` of ``headers`` (page), to a point,
    begin the rows, each ending 2 points above the next, the last at the page's end; a page with
    fewer header rows than ``rows`` is cut into an even grid within its margins instead."""
    c = F.col
    tops = headers.select("page", F.bround(y).alias("top")).distinct()
    w = W.partitionBy("page").orderBy("top")
    tops = tops.select("page", "top", (F.row_number().over(w) - 1).alias("row"), F.lead("top").over(w).alias("below"), F.count("*").over(W.partitionBy("page")).alias("found"))
    grid = pages.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    both = grid.join(tops.where(c("row") < rows), ["page", "row"], "left")
    by_header = F.coalesce(F.max("found").over(W.partitionBy("page")) >= rows, F.lit(False))
    px = lambda points: (points * c("scale")).cast("int")
    part = lambda size, share: (size * F.lit(share)).cast("int")
    high = F.floor((c("height") - part(c("height"), 0.015) - part(c("height"), 0.005)) / rows).cast("int")
    wide = F.floor((c("width") - 2 * part(c("width"), 0.005)) / columns).cast("int")
    half = F.floor(c("width") / columns).cast("int")
    both = both.withColumn("by_header", by_header)
    x0 = F.when(c("by_header"), c("column") * half).otherwise(part(c("width"), 0.005) + c("column") * wide)
    y0 = F.when(c("by_header"), F.greatest(F.lit(0), px(c("top") - 2))).otherwise(part(c("height"), 0.015) + c("row") * high)
    y1 = F.when(c("by_header"), F.least(c("height"), px(F.coalesce(c("below") - 2, c("points"))))).otherwise(part(c("height"), 0.015) + (c("row") + 1) * high)
    return both.select("page", (c("row") * columns + c("column")).cast("int").alias("chart"), x0.alias("x0"), (x0 + F.when(c("by_header"), half).otherwise(wide)).alias("x1"), y0.alias("y0"), y1.alias("y1"))
