"""Runs of neighbouring positions (gaps and islands), and sums along rows and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seriesforge.functions.scalars import pixel_to_data
from seriesforge.operators.series import at_times


def runs(points: DataFrame, keys: list[str], y: str, gap: float = 2) -> DataFrame:
    """One row a run of distinct positions at most ``gap`` apart: its number, ends and mean."""
    w = W.partitionBy(*keys).orderBy(y)
    made = points.select(*keys, y).distinct()
    made = made.withColumn("run", F.sum(F.when(F.col(y) - F.lag(y).over(w) <= gap, 0).otherwise(1)).over(w))
    return made.groupBy(*keys, "run").agg(F.min(y).alias("low"), F.max(y).alias("high"), F.count("*").alias("n"), F.avg(y).alias("middle"))


def last_run(points: DataFrame, keys: list[str], y: str, gap: float = 2) -> DataFrame:
    """The mean position of each group's last run."""
    return runs(points, keys, y, gap).groupBy(*keys).agg(F.max_by("middle", "run").alias("middle"), F.count("*").alias("runs"))


def opened(points: DataFrame, keys: list[str], y: str, least: int) -> DataFrame:
    """Opening by a line: the positions in runs of at least ``least`` neighbours."""
    w = W.partitionBy(*keys).orderBy(y)
    made = points.select(*keys, y).distinct().withColumn("__run", F.sum(F.when(F.col(y) - F.lag(y).over(w) <= 1, 0).otherwise(1)).over(w))
    return made.withColumn("__n", F.count("*").over(W.partitionBy(*keys, "__run"))).where(F.col("__n") >= least).drop("__run", "__n")


def projection(cells: DataFrame, keys: list[str], along: str, value: str, share: float = 0.3) -> DataFrame:
    """Sums along one axis, and whether each reaches a share of its group's largest."""
    sums = cells.groupBy(*keys, along).agg(F.sum(value).alias("total"))
    return sums.withColumn("strong", F.col("total") >= F.lit(share) * F.max("total").over(W.partitionBy(*keys)))


def column_rows(pixels: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(keys, col, row): of each pixel column the median row, cut to a whole number."""
    return pixels.groupBy(*keys, F.col(x).cast("int").alias("col")).agg(F.median(y).cast("int").alias("row"))


def pixels_to_curve(pixels: DataFrame, boxes: DataFrame, keys: list[str], x_max: float, y_max: float, samples: int = 300, anchor_origin: bool = True, anchor_end: bool = False) -> DataFrame:
    """(keys, col, t, v): pixels (keys, x, y, counted from the plot's corner) as a curve. Each column's median
    row counts; ``anchor_origin`` puts the curve's start at the plot's lower left corner, and
    ``anchor_end`` its end at the lower right one if the last row seen is in the lowest eighth or so
    (0.88 of the height). Rows between known columns are interpolated; at most ``samples`` evenly
    spaced columns are taken, the first and the last among them, and mapped to the axes. ``boxes`` are
    (keys, left, right, top, bottom); plots of under two columns have no curve."""
    c = F.col
    seen = column_rows(pixels, keys)
    size = seen.groupBy(*keys).agg(F.count("*").alias("n"), F.min("col").alias("first"), F.max("col").alias("last"), F.max_by("row", F.when(c("col") > 0, c("col"))).alias("last_row"))
    plots = size.where("n > 1").join(boxes, keys).withColumns({"w": c("right") - c("left"), "h": c("bottom") - c("top")})
    to_end = F.lit(anchor_end) & (c("w") > 0) & (c("h") > 0) & (c("last_row") >= 0.88 * c("h"))
    plots = plots.withColumns({"first": F.lit(0) if anchor_origin else c("first"), "last": F.when(to_end, c("w").cast("int")).otherwise(c("last")), "to_end": to_end})
    corner = lambda when, col: F.when(when, F.struct(col.cast("int").alias("col"), c("h").cast("int").alias("row")))
    pinned = F.array_compact(F.array(corner(F.lit(anchor_origin), F.lit(0)), corner(c("to_end"), c("w"))))
    pinned = plots.select(*keys, F.explode(pinned).alias("p")).select(*keys, "p.col", "p.row")
    known = seen.join(pinned, [*keys, "col"], "left_anti").unionByName(pinned)
    k = F.least(F.lit(samples), c("last") - c("first") + 1)
    step = (c("last") - c("first")) / (k - 1)
    at = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.when(j == k - 1, c("last")).otherwise(c("first") + F.floor(j * step)).cast("double"))
    probes = plots.where("last >= first").select(*keys, F.explode(at).alias("t"))
    rows = at_times(known.select(*keys, c("col").cast("double").alias("t"), c("row").cast("double").alias("v")), probes, keys)
    made = rows.join(boxes, keys)  # probes are of plots only, so this needs no sizes
    t, v = pixel_to_data(c("t") + c("left"), c("v") + c("top"), c("left"), c("right"), c("top"), c("bottom"), x_max, y_max)
    return made.select(*keys, c("t").cast("int").alias("col"), t.alias("t"), v.alias("v"))
