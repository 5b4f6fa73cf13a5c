"""From page geometry to calibrated curves, for all charts of all pages in one plan.

Input are text blocks (page, seq, x0, y0, x1, y1, text), strokes (page, r, g, b and the ends x0, y0,
x1, y1 of each) and, for traces on axes of their own, coloured text spans (page, seq, text, color, x0,
y0, x1, y1). Headers give the charts and their windows; the text inside a window gives the header's
fields and the axis ticks; strokes give the axes' ends and, by their ink, the curves. Blocks, spans
and strokes meet the windows through cells of the page, so each is compared with those near it only.
The inputs are read more than once: give tables, not plans that are costly to compute again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from seriesforge.functions.scalars import clip, header_fields, in_plot, in_window, is_blue, is_green, is_near, is_tick_label, rounded
from seriesforge.operators import calibration, geometry, series

CHART = ["page", "chart"]
TRACE = [*CHART, "curve"]
#: Names of the curves, and the colours of those that have an axis of their own.
FLOW, PRESSURE, CONDUCTIVITY, TEMPERATURE = "Flusso_kg_min", "Pressione_assoluta_0.1bar", "Conducibilita_mS_cm", "Temperatura_C"
OWN_AXIS = {CONDUCTIVITY: (0.392, 0.027, 0.647), TEMPERATURE: (1.0, 0.0, 0.0)}
#: A value axis whose ticks miss their line by more is reported; how far a chart's geometry reaches
#: over the page's middle; the space above a header.
RESIDUAL, OVERLAP, HEADER_PAD = 0.05, 14.0, 6.0


@dataclass
class Extracted:
    """``charts``: windows and header fields; ``axes``: calibrations with the plot's box; ``traces``: axes that are
    printed in a curve's colour; ``curves``: (page, chart, curve, t, v); ``warnings``."""

    charts: DataFrame
    axes: DataFrame
    traces: DataFrame
    curves: DataFrame
    warnings: DataFrame


def charts_of(blocks: DataFrame, width: float, height: float) -> DataFrame:
    """A chart for each block that holds an animal's number: its strict window (cx0, cx1), which text is
    read in, the one widened over the page's middle (x0, x1) for geometry, and y0, y1: rows end
    above the next distinct header, tops taken to a point."""
    heads = blocks.where(header_fields(F.col("text"))["animal_id"].isNotNull())
    heads = geometry.reading_order(heads, "page", "x0", "y0", "seq", width / 2).withColumn("top", F.bround("y0"))
    rows = geometry.row_extent(heads, "page", height, HEADER_PAD, "top")
    middle, left = F.lit(width / 2), F.col("x0") < F.lit(width / 2)
    cx0, cx1 = F.when(left, F.lit(0.0)).otherwise(middle), F.when(left, middle).otherwise(F.lit(width))
    return heads.join(rows, ["page", "top"]).select(
        *CHART, F.col("seq").alias("head"), F.col("text").alias("head_text"), cx0.alias("cx0"), cx1.alias("cx1"),
        F.when(left, cx0).otherwise(cx0 - OVERLAP).alias("x0"), F.when(left, cx1 + OVERLAP).otherwise(cx1).alias("x1"),
        (F.col("y0") - F.lit(HEADER_PAD)).alias("y0"), F.col("row_bottom").alias("y1"),
    )


def text_of(charts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks with the chart whose strict window holds their middle."""
    c = F.col
    middles = blocks.select("page", "seq", "text", ((c("x0") + c("x1")) / 2).alias("x"), ((c("y0") + c("y1")) / 2).alias("y"), (c("x1") - c("x0")).alias("width"), c("x0").alias("left"), c("x1").alias("right"), c("y0").alias("top"))
    windows = charts.select(*CHART, "head", "cx0", "cx1", c("y0").alias("w0"), c("y1").alias("w1"))
    box = (c("cx0"), c("cx1"), c("w0"), c("w1"))
    return geometry.inside_cells(windows, middles, ["page"], box, (c("x"), c("y")), in_window(c("x"), c("y"), *box))


def headers_of(charts: DataFrame, text: DataFrame) -> DataFrame:
    """Header fields of each chart: its own header's text first, then the other text in its window."""
    others = text.where("seq <> head").groupBy(*CHART).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]).alias("others"))
    whole = F.concat_ws("\n", F.array("head_text"), F.col("others"))
    return charts.join(others, CHART, "left").select(*CHART, *[f.alias(n) for n, f in header_fields(whole).items()])


def value_ticks(text: DataFrame) -> DataFrame:
    """The numerals of each chart's value axis: the leftmost column of them, so digits inside the plot don't
    count, whatever their place in the text."""
    ticks = text.where(is_tick_label(F.col("text"))).withColumn("value", F.trim("text").cast("int"))
    return calibration.leftmost(ticks, CHART, "left")


def calibrated(charts: DataFrame, text: DataFrame, strokes: DataFrame) -> DataFrame:
    """Per chart: value axis (slope, intercept, ticks, residual, the printed range), time axis (left, right,
    ends) with its source, and the plot's box as fractions of the window. Charts whose ticks or
    time labels can't be read are absent."""
    c = F.col
    ticks = value_ticks(text)
    axis = calibration.fit(calibration.first_of_each(ticks, CHART, "value", "seq"), CHART, "y", "value")
    ends = calibration.value_range(ticks, CHART, "value").select(*CHART, c("v_bottom").cast("double").alias("v_bottom"), c("v_top").cast("double").alias("v_top"))
    rows = text.withColumn("numbers", calibration.label_numbers(c("text"))).where(calibration.is_label_row(c("numbers"), c("width")))
    labels = calibration.lowest(rows, CHART, "top", "seq").select(*CHART, "left", "right", F.element_at("numbers", 1).alias("t_min"), F.element_at("numbers", -1).alias("t_max"))
    made = axis.join(labels, CHART).join(ends, CHART, "left").join(charts.select(*CHART, "cx0", "cx1", c("x0").alias("wx0"), c("x1").alias("wx1"), c("y0").alias("wy0"), c("y1").alias("wy1")).hint("merge"), CHART)
    made = made.withColumn("base", F.coalesce(-c("intercept") / F.when(c("slope") != 0, c("slope")), c("wy1")))

    ends_of = [c(n) for n in ("r", "g", "b", "x0", "y0", "x1", "y1")]
    windows = made.select(*CHART, "left", "right", "base", "wx0", "wx1", "wy0", "wy1")
    upright = strokes.where((F.abs(c("x0") - c("x1")) < 0.3) & (F.greatest("r", "g", "b") <= 0.25))
    below = (c("wx0"), c("wx1"), c("base") - 8.0, c("base") + 4.0)
    marks = geometry.inside_cells(windows, upright, ["page"], below, (c("x0"), F.least("y0", "y1")), calibration.is_tick_stroke(*ends_of, c("base")) & c("x0").between(c("wx0"), c("wx1")))
    marks = marks.withColumn("x", rounded(c("x0"), 2)).where(c("x").between(c("left") - 3.0, c("right") + 3.0))
    pitch = calibration.pitch(marks, CHART, "x").select(*CHART, F.struct(c("x_first").alias("left"), c("x_last").alias("right")).alias("ticks_at"))
    level = strokes.where(calibration.is_grid_line(*ends_of)).withColumns({"sx0": F.least("x0", "x1"), "sx1": F.greatest("x0", "x1")})
    whole = (c("wx0"), c("wx1"), c("wy0"), c("wy1") + 4.0)
    lines = geometry.inside_cells(windows, level, ["page"], whole, (c("sx0"), c("y0")), (c("sx0") >= c("wx0")) & (c("sx1") <= c("wx1") + 1.0) & c("y0").between(c("wy0"), c("wy1") + 4.0))
    frame = calibration.frame(lines, CHART, "sx0", "sx1").select(*CHART, F.struct(c("x_left").alias("left"), c("x_right").alias("right")).alias("lines_at"))

    made = made.join(pitch, CHART, "left").join(frame, CHART, "left")
    anchor, source = calibration.x_anchor(c("ticks_at"), c("lines_at"), F.struct("left", "right"))
    made = made.withColumns({"x_left": anchor["left"], "x_right": anchor["right"], "x_source": source})
    box = calibration.box_fractions((c("cx0"), c("cx1"), c("wy0"), c("wy1")), (c("x_left"), c("x_right")), c("slope"), c("intercept"), c("v_bottom"), c("v_top"))
    return made.select(*CHART, "slope", "intercept", "n", "residual", "v_bottom", "v_top", "t_min", "t_max", "base", "x_left", "x_right", "x_source", box.alias("box"), "wx0", "wx1", "wy0", "wy1")


def ink_of(r: Column, g: Column, b: Column, curves: tuple[str, ...]) -> Column:
    """The names of the wanted curves that are drawn in a colour, tested once for all of them."""
    tests = {FLOW: is_blue(r, g, b), PRESSURE: is_green(r, g, b)} | {n: is_near((r, g, b), rgb) for n, rgb in OWN_AXIS.items()}
    return F.array_compact(F.array(*[F.when(tests[n], F.lit(n)) for n in curves]))


def own_axes(axes: DataFrame, spans: DataFrame, curves: tuple[str, ...]) -> DataFrame:
    """(page, chart, curve, slope, intercept, n, residual) of axes whose numerals are printed in their curve's
    colour, all colours in one pass over the spans."""
    c = F.col
    inks = F.array(*[F.struct(F.lit(n).alias("curve"), *[F.lit(v).alias(k) for k, v in zip(("r", "g", "b"), OWN_AXIS[n])]) for n in curves])
    middles = spans.select("page", "seq", "text", "color", ((c("x0") + c("x1")) / 2).alias("x"), ((c("y0") + c("y1")) / 2).alias("y")).where(is_tick_label(c("text")))
    windows = axes.select(*CHART, "wx0", "wx1", "wy0", "wy1")
    box = (c("wx0"), c("wx1"), c("wy0"), c("wy1"))
    held = geometry.inside_cells(windows, middles, ["page"], box, (c("x"), c("y")), c("x").between(box[0], box[1]) & c("y").between(box[2], box[3]))
    held = held.withColumn("ink", F.explode(inks)).withColumn("curve", c("ink.curve"))
    return calibration.colour_fit(held, TRACE, box, (c("ink.r"), c("ink.g"), c("ink.b")), "seq")


def traced(axes: DataFrame, strokes: DataFrame, traces: DataFrame | None = None, curves: tuple[str, ...] = (FLOW,)) -> DataFrame:
    """(page, chart, curve, t, v): the vertices of each wanted curve's strokes around each plot, on its axes, one
    value a time. Curves on the chart's own axis are clamped to its printed range (an unknown end doesn't
    clamp); those on ``traces`` aren't, and are absent where their axis is."""
    c = F.col
    ink = strokes.select("page", "x0", "y0", "x1", "y1", F.explode(ink_of(c("r"), c("g"), c("b"), curves)).alias("curve"))
    vertices = ink.select("page", "curve", F.explode(F.array(F.struct(c("x0").alias("x"), c("y0").alias("y")), F.struct(c("x1").alias("x"), c("y1").alias("y")))).alias("p")).select("page", "curve", "p.x", "p.y")
    plots = axes.where("x_right > x_left")
    if traces is None:
        plots = plots.withColumn("traces", F.lit(None).cast("map<string, struct<slope: double, intercept: double>>"))
    else:
        plots = plots.join(traces.groupBy(*CHART).agg(F.map_from_entries(F.collect_list(F.struct("curve", F.struct("slope", "intercept")))).alias("traces")).hint("merge"), CHART, "left")
    plots = plots.withColumns({"gx0": c("x_left") - 1.0, "gx1": c("x_right") + 1.0})
    box = (c("gx0"), c("gx1") + 1.0, c("wy0"), c("wy1") + 2.0)
    held = geometry.inside_cells(plots, vertices, ["page"], box, (c("x"), c("y")), in_plot(c("x"), c("y"), c("gx0"), c("gx1"), c("wy0"), c("wy1")))
    t = clip(c("t_min") + (c("x") - c("x_left")) / (c("x_right") - c("x_left")) * (c("t_max") - c("t_min")), c("t_min"), c("t_max"))
    own = c("axis").isNull()
    v = F.when(own, clip(c("slope") * c("y") + c("intercept"), c("v_bottom"), c("v_top"))).otherwise(c("axis.slope") * c("y") + c("axis.intercept"))
    held = held.withColumn("axis", c("traces")[c("curve")]).where(~own | ~c("curve").isin(*OWN_AXIS))
    points = held.select(*TRACE, "x", "y", t.alias("t"), v.alias("v")).dropDuplicates([*TRACE, "x", "y"])
    return series.collapse_anchored(points, TRACE).select(*TRACE, "t", "v")


def warnings_of(charts: DataFrame, axes: DataFrame, flow: DataFrame) -> DataFrame:
    """(page, chart, warning): why a chart has no curve, or how far to trust it. A chart whose axes
    can't be read, or have no width, is skipped and gets that warning alone."""
    c = F.col
    found = flow.select(*CHART).distinct().withColumn("has_flow", F.lit(True))
    seen = charts.select(*CHART).join(axes.select(*CHART, "residual", "x_left", "x_right"), CHART, "left").join(found, CHART, "left")
    flat, high = c("x_right") <= c("x_left"), c("residual") > RESIDUAL
    notes = F.array_compact(F.array(
        F.when(high, F.format_string("Y calibration residual high (%.3f)", c("residual"))),
        F.when(flat, F.lit("Degenerate X axis: chart skipped")).when(c("has_flow").isNull(), F.lit("Flusso curve not present in vector layer")),
    ))
    failed = F.array(F.lit("Axis calibration failed: chart skipped"))
    return seen.select(*CHART, F.explode(F.when(c("x_left").isNull() | c("x_right").isNull(), failed).otherwise(notes)).alias("warning"))


def extract(
    blocks: DataFrame, strokes: DataFrame, width: float, height: float, spans: DataFrame | None = None, curves: tuple[str, ...] = (FLOW,),
    keep: Callable[[DataFrame, str], DataFrame] = lambda made, name: made,
) -> Extracted:
    """All of the above. Curves with an axis of their own need ``spans``. ``keep`` gets what is read more than once
    and its name, and may return it as a table; as plans alone all is computed again at each place."""
    charts = keep(charts_of(blocks, width, height), "charts")
    text = keep(text_of(charts, blocks), "text")
    axes = keep(calibrated(charts, text, strokes), "axes")
    extra = tuple(n for n in curves if n in OWN_AXIS)
    traces = keep(own_axes(axes, spans, extra), "traces") if extra and spans is not None else None
    found = traced(axes, strokes, traces, curves)
    warnings = warnings_of(charts, axes, found.where(F.col("curve") == FLOW))
    return Extracted(charts.join(headers_of(charts, text), CHART), axes, traces, found, warnings)


def page_metadata(blocks: DataFrame, width: float, slots: int = 8) -> DataFrame:
    """(page, chart, animal_id, date_iso, time_hhmm): the first ``slots`` headers of each page that has blocks, in
    reading order, fields looked for in a header's block and the next two near it; missing ones are
    null."""
    c = F.col
    merged = geometry.merged_ahead(blocks, "page", "seq", "y0", "text")
    own = F.regexp_extract("text", r"(?iU)animale[:\s]*([0-9]+)", 1)
    heads = geometry.reading_order(merged.withColumn("animal_id", own).where("animal_id <> ''"), "page", "x0", "y0", "seq", width / 2)
    fields = header_fields(c("merged"))
    found = heads.where(c("chart") < slots).select(*CHART, "animal_id", fields["date_iso"].alias("date_iso"), fields["time_hhmm"].alias("time_hhmm"))
    return geometry.padded(found, blocks, ["page"], slots, "chart")
