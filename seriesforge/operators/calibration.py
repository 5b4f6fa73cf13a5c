"""Axis calibration: grouped least squares on tick labels, tick pitch, grid frames, label rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seriesforge.functions.scalars import channels, in_closed_window, is_near, is_tick_label, rounded


def first_of_each(ticks: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """One row for each value of a group: the first in order."""
    rank = F.row_number().over(W.partitionBy(*keys, value).orderBy(order))
    return ticks.withColumn("__r", rank).where("__r = 1").drop("__r")


def leftmost(ticks: DataFrame, keys: list[str], x: str, within: float = 6.0) -> DataFrame:
    """Rows whose ``x`` lies near the smallest of their group: one column of numerals."""
    least = F.min(x).over(W.partitionBy(*keys))
    return ticks.withColumn("__least", least).where(F.col(x) - F.col("__least") < F.lit(within)).drop("__least")


def fit(ticks: DataFrame, keys: list[str], position: str, value: str, least: int = 3) -> DataFrame:
    """Least-squares line value ~ position with its largest absolute residual; groups with fewer
    than ``least`` distinct values are left out. One exchange: the residual is a window's."""
    w = W.partitionBy(*keys)
    p, v = F.col(position), F.col(value)
    made = ticks.withColumn("slope", F.regr_slope(v, p).over(w)).withColumn("intercept", F.regr_intercept(v, p).over(w))
    out = made.groupBy(*keys).agg(
        F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.count("*").alias("n"), F.countDistinct(value).alias("distinct_values"),
        F.max(F.abs(F.col("slope") * p + F.col("intercept") - v)).alias("residual"),
    )
    return out.where((F.col("distinct_values") >= least) & F.col("slope").isNotNull()).select(*keys, "slope", "intercept", "n", "residual")


def value_range(ticks: DataFrame, keys: list[str], value: str, least: int = 3) -> DataFrame:
    """Smallest and largest tick of groups with enough rows."""
    return ticks.groupBy(*keys).agg(F.min(value).alias("v_bottom"), F.max(value).alias("v_top"), F.count("*").alias("n")).where(F.col("n") >= least)


def pitch(ticks: DataFrame, keys: list[str], x: str, least: int = 5, tolerance: float = 0.25) -> DataFrame:
    """First and last of the distinct tick positions, if their gaps agree: no gap may be further
    from the median gap than ``tolerance`` of it."""
    w = W.partitionBy(*keys)
    gaps = ticks.select(*keys, rounded(F.col(x), 2).alias("x")).distinct().withColumn("gap", F.col("x") - F.lag("x").over(w.orderBy("x")))
    gaps = gaps.withColumn("middle", F.median("gap").over(w))
    out = gaps.groupBy(*keys).agg(F.min("x").alias("x_first"), F.max("x").alias("x_last"), F.count("*").alias("n"), F.first("middle").alias("pitch"), F.max(F.abs(F.col("gap") - F.col("middle"))).alias("off"))
    return out.where((F.col("n") >= least) & (F.col("pitch") > 0) & (F.col("off") <= F.col("pitch") * F.lit(tolerance))).drop("off")


def frame(lines: DataFrame, keys: list[str], start: str, end: str, least: int = 3) -> DataFrame:
    """The plot's left and right edge: medians of where its grid lines start and end."""
    return lines.groupBy(*keys).agg(F.median(start).alias("x_left"), F.median(end).alias("x_right"), F.count("*").alias("n")).where(F.col("n") >= least)


def is_label_row(numbers: Column, width: Column, least: int = 5, wide: float = 100.0) -> Column:
    """A wide row of at least ``least`` numbers, each larger than the one before."""
    n = F.size(numbers)
    rising = F.forall(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get(numbers, i - 1) < F.get(numbers, i))
    return (width >= F.lit(wide)) & (n >= least) & F.coalesce(rising, F.lit(False))


def lowest(rows: DataFrame, keys: list[str], y: str, order: str) -> DataFrame:
    """Of each group the row of the largest y, the first in order of those."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(y), order))
    return rows.withColumn("__r", rank).where("__r = 1").drop("__r")


def is_tick_stroke(r: Column, g: Column, b: Column, x0: Column, y0: Column, x1: Column, y1: Column, base: Column) -> Column:
    """A short dark upright stroke that hangs from the base line of an axis."""
    length, top = F.abs(y0 - y1), F.least(y0, y1)
    return (F.greatest(r, g, b) <= 0.25) & (F.abs(x0 - x1) < 0.3) & (length > 0.4) & (length < 7.0) & (top >= base - 8.0) & (top <= base + 4.0)


def is_grid_line(r: Column, g: Column, b: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A long grey level stroke."""
    grey = [F.abs(c - 0.75) < 0.08 for c in (r, g, b)]
    return grey[0] & grey[1] & grey[2] & (F.abs(y0 - y1) < 0.25) & (F.abs(x0 - x1) > 40.0)


def label_numbers(text: Column) -> Column:
    """The numbers of a block of lines; null if a line that isn't blank is something else."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.forall(lines, lambda s: s.rlike("^[0-9]+$")), F.transform(lines, lambda s: s.try_cast("double")))


def x_anchor(ticks: Column, lines: Column, labels: Column, least: float = 40.0) -> tuple[Column, Column]:
    """(anchor, source): tick strokes, then grid lines, then labels; the first wide enough wins.
    Each is a struct (left, right)."""
    ok = lambda s: s.isNotNull() & (s["right"] - s["left"] > F.lit(least))
    anchor = F.when(ok(ticks), ticks).when(ok(lines), lines).otherwise(labels)
    return anchor, F.when(ok(ticks), "ticks").when(ok(lines), "grid").when(labels.isNotNull(), "labels")


def colour_fit(spans: DataFrame, keys: list[str], box: tuple[Column, Column, Column, Column], target: tuple, order: str, tolerance: float = 0.08) -> DataFrame:
    """The axis whose numerals are printed in a colour of their own: the line through the tick labels
    of ``spans`` (keys, text, color, x, y and ``order``) that have it (``target``, numbers or columns of
    the span) and lie in ``box`` (x0, x1, y0, y1). Of labels that show one value, the first in order counts."""
    colour = tuple(c / F.lit(255.0) for c in channels(F.col("color")))
    ticks = spans.where(is_tick_label(F.col("text")) & is_near(colour, target, tolerance) & in_closed_window(F.col("x"), F.col("y"), *box))
    ticks = ticks.groupBy(*keys, F.trim("text").cast("double").alias("value")).agg(F.min_by("y", order).alias("y"))
    return fit(ticks, keys, "y", "value")


def box_fractions(window: tuple[Column, Column, Column, Column], labels: tuple[Column, Column], slope: Column, intercept: Column, v_bottom: Column, v_top: Column, room: float = 4.0, top: float = 9.0) -> Column:
    """Where a chart's plot box lies in its window (x0, x1, y0, y1), as fractions of the window widened to
    hold its tick ``labels`` (left, right): a struct of left, right, top, bottom and the values
    at top and bottom (0 and the default top where unknown); null where the window or axis is flat."""
    x0, x1, y0, y1 = window
    x0, x1 = F.least(x0, labels[0] - F.lit(room)), F.greatest(x1, labels[1] + F.lit(room))
    w, h, low, high = x1 - x0, y1 - y0, F.coalesce(v_bottom, F.lit(0.0)), F.coalesce(v_top, F.lit(top))
    across, down = (lambda x: rounded((x - x0) / w, 6)), (lambda v: rounded(((v - intercept) / slope - y0) / h, 6))
    box = F.struct(
        across(labels[0]).alias("left"), across(labels[1]).alias("right"), down(high).alias("top"), down(low).alias("bottom"),
        high.alias("v_top"), low.alias("v_bottom"),
    )
    return F.when((w > 0) & (h > 0) & (slope != 0), box)
