"""Charts drawn as page geometry: text blocks and line strokes, without a PDF library.

The inverse of the extraction, for round trips: eight charts a page, two columns and four rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Page and plot geometry in points, and the axes' ends.
PAGE_WIDTH, PAGE_HEIGHT = 595.32, 841.92
LEFTS, TOPS = (41.76, 316.92), (14.8, 213.8, 412.8, 611.7)
PLOT_TOP, PLOT_WIDTH, PLOT_HEIGHT = 28.0, 252.0, 120.0
T_MAX, V_MAX = 10.0, 9.0
FLOW_INK, TICK_INK, GRID_INK, PRESSURE_INK = (0.10, 0.10, 0.90), (0.0, 0.0, 0.0), (0.75, 0.75, 0.75), (0.0, 0.6, 0.0)

BLOCKS = "page long, seq int, x0 double, y0 double, x1 double, y1 double, text string"
SEGMENTS = "page long, r double, g double, b double, x0 double, y0 double, x1 double, y1 double"


def box(slot: Column) -> tuple[Column, Column]:
    """Left and top of a chart's plot by its place on the page."""
    left = F.element_at(F.array(*map(F.lit, LEFTS)), (slot % 2 + 1).cast("int"))
    top = F.element_at(F.array(*map(F.lit, TOPS)), (F.floor(slot / 2) + 1).cast("int")) + F.lit(PLOT_TOP)
    return left, top


def blocks(charts: DataFrame, header: Column) -> DataFrame:
    """Text blocks of ``charts`` (page, slot): header, value ticks 0 to 9, and the time labels."""
    left, top = box(F.col("slot"))
    base = top + F.lit(PLOT_HEIGHT)
    at = lambda k, x0, y0, x1, y1, text: F.struct((F.col("slot") * 20 + k).cast("int").alias("seq"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), text.alias("text"))
    head = [at(F.lit(0), left, top - F.lit(PLOT_TOP), left + F.lit(200.0), top - F.lit(PLOT_TOP - 20.0), header)]
    y = lambda v: base - F.lit(v / V_MAX * PLOT_HEIGHT)
    ticks = [at(F.lit(1 + v), left - F.lit(12.0), y(v) - F.lit(3.0), left - F.lit(6.0), y(v) + F.lit(3.0), F.lit(f" {v} ")) for v in range(10)]
    labels = [at(F.lit(15), left, base + F.lit(4.0), left + F.lit(PLOT_WIDTH), base + F.lit(12.0), F.lit("\n".join(map(str, range(11)))))]
    return charts.select("page", F.explode(F.array(*head, *ticks, *labels)).alias("s")).select("page", "s.*")


def strokes(curves: DataFrame, charts: DataFrame) -> DataFrame:
    """Line strokes: the curves (page, slot, t, v), 21 ticks under each plot, and five grid lines."""
    left, top = box(F.col("slot"))
    x, y = left + F.col("t") / F.lit(T_MAX) * F.lit(PLOT_WIDTH), top + F.lit(PLOT_HEIGHT) - F.col("v") / F.lit(V_MAX) * F.lit(PLOT_HEIGHT)
    w = W.partitionBy("page", "slot").orderBy("x0")
    ink = lambda c: [F.lit(v).alias(n) for v, n in zip(c, "rgb")]
    line = curves.select("page", "slot", x.alias("x0"), y.alias("y0")).withColumn("x1", F.lead("x0").over(w)).withColumn("y1", F.lead("y0").over(w))
    line = line.where("x1 is not null").select("page", *ink(FLOW_INK), "x0", "y0", "x1", "y1")
    base = top + F.lit(PLOT_HEIGHT)
    tick = [F.struct((left + F.lit(PLOT_WIDTH * k / 20)).alias("x0"), base.alias("y0"), (left + F.lit(PLOT_WIDTH * k / 20)).alias("x1"), (base + F.lit(4.0)).alias("y1")) for k in range(21)]
    grid = [F.struct(left.alias("x0"), (top + F.lit(PLOT_HEIGHT * k / 5)).alias("y0"), (left + F.lit(PLOT_WIDTH)).alias("x1"), (top + F.lit(PLOT_HEIGHT * k / 5)).alias("y1")) for k in range(5)]
    marks = charts.select("page", F.explode(F.array(*tick)).alias("s")).select("page", *ink(TICK_INK), "s.*")
    lines = charts.select("page", F.explode(F.array(*grid)).alias("s")).select("page", *ink(GRID_INK), "s.*")
    return line.unionByName(marks).unionByName(lines)


def polyline(curves: DataFrame, ink: tuple[float, float, float], low: float, high: float) -> DataFrame:
    """Strokes of ``curves`` (page, slot, t, v) in an ink, on an axis from ``low`` to ``high``."""
    left, top = box(F.col("slot"))
    x = left + F.col("t") / F.lit(T_MAX) * F.lit(PLOT_WIDTH)
    y = top + F.lit(PLOT_HEIGHT) - (F.col("v") - F.lit(low)) / F.lit(high - low) * F.lit(PLOT_HEIGHT)
    w = W.partitionBy("page", "slot").orderBy("x0")
    line = curves.select("page", "slot", x.alias("x0"), y.alias("y0")).withColumn("x1", F.lead("x0").over(w)).withColumn("y1", F.lead("y0").over(w))
    return line.where("x1 is not null").select("page", *[F.lit(v).alias(n) for v, n in zip(ink, "rgb")], "x0", "y0", "x1", "y1")


def inner_digits(charts: DataFrame) -> DataFrame:
    """Blocks of single digits inside the plots, before all others in the text."""
    left, top = box(F.col("slot"))
    x, y = left + F.lit(PLOT_WIDTH / 3), top + F.lit(PLOT_HEIGHT / 2)
    marks = F.explode(F.sequence(F.lit(0), F.lit(6), F.lit(2))).alias("k")
    rows = charts.select("page", "slot", marks).withColumns({"x0": x + F.col("k") * 8, "y0": y})
    return rows.select("page", (F.col("slot") * 10 + F.col("k") - 1000).cast("int").alias("seq"), "x0", "y0", (F.col("x0") + 4.0).alias("x1"), (F.col("y0") + 6.0).alias("y1"), F.col("k").cast("string").alias("text"))


def coloured_axes(charts: DataFrame) -> DataFrame:
    """Spans of two axes right of each plot, violet from 2 to 9 and red from 10 to 45 by fives."""
    left, top = box(F.col("slot"))
    base, right = top + F.lit(PLOT_HEIGHT), left + F.lit(PLOT_WIDTH)
    axes = [(v, 0x6407A5, 2.0, (v - 2) / 7, 0) for v in range(2, 10)] + [(v, 0xFF0000, 8.0, (v - 10) / 35, 20) for v in range(10, 46, 5)]
    at = lambda v, color, x, part, k: F.struct((F.col("slot") * 40 + F.lit(k + v)).cast("int").alias("seq"), F.lit(f" {v} ").alias("text"), F.lit(color).alias("color"), (right + x).alias("x0"), (base - F.lit(part * PLOT_HEIGHT) - 3.0).alias("y0"), (right + x + 4.0).alias("x1"), (base - F.lit(part * PLOT_HEIGHT) + 3.0).alias("y1"))
    return charts.select("page", F.explode(F.array(*[at(*a) for a in axes])).alias("s")).select("page", "s.*")
