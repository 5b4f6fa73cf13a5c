"""Queries from drawn pages to axes, curves, warnings and session files, with their SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, functions as F

from seriesforge.functions.scalars import rounded
from seriesforge.operators import extraction, series
from seriesforge.operators.extraction import CHART, CONDUCTIVITY, FLOW, PRESSURE, RESIDUAL, TEMPERATURE, calibrated, charts_of, headers_of, text_of, traced, warnings_of
from seriesforge.plans.series_queries import curves
from seriesforge.sources import drawn, files, run
from seriesforge.sources.shared import shared_folder, written
from seriesforge.sources.tables import CURVES_SQL

SIZE = drawn.PAGE_WIDTH, drawn.PAGE_HEIGHT


def drawn_curves(spark, d: str) -> DataFrame:
    """All users' curves as (page, slot, t, v), eight a page."""
    c = curves(spark, d).select(F.floor(F.col("chart") / 8).alias("page"), (F.col("chart") % 8).alias("slot"), "t", rounded(F.col("v") * F.lit(0.09), 4).alias("v"))
    return c.where("t <= 10")


def printed(weight: Column) -> Column:
    """A header that states a weight."""
    return F.concat(F.lit("Numero Azienda 07010142 Animale: "), F.col("page") * 8 + F.col("slot"), F.lit(" Quantità di latte: "), weight, F.lit(" kg Data: 12.05.2025 Ora: 03:58:23"))


def pages(spark, d: str, drawn_where: str = "true") -> tuple[DataFrame, DataFrame]:
    """Blocks and strokes of all curves; charts outside ``drawn_where`` have axes only."""
    c = written(drawn_curves(spark, d), "curves")
    charts = c.select("page", "slot").distinct()
    return written(drawn.blocks(charts, printed(F.lit("5,52"))), "blocks"), written(drawn.strokes(c.where(drawn_where), charts), "strokes")


def extract_axes(spark, d):
    blocks, strokes = pages(spark, d)
    charts = charts_of(blocks, *SIZE)
    text = text_of(charts, blocks)
    made = calibrated(charts, text, strokes).join(headers_of(charts, text).select(*CHART, "animal_id", "milk_kg", "date_iso"), CHART)
    whole = [F.col(n).cast("int").alias(n) for n in ("t_min", "t_max", "v_bottom", "v_top")]
    return made.select("page", "chart", "animal_id", "date_iso", "milk_kg", "n", *whole, "x_source", (F.col("residual") < RESIDUAL).alias("within_residual"))


def extract_curves(spark, d):
    blocks, strokes = pages(spark, d)
    return extraction.extract(blocks, strokes, *SIZE).curves.select("page", "chart", "t", "v")


def extract_warnings(spark, d):
    """Charts made faulty on purpose, by their place on the page: the third has no value ticks, the
    sixth no curve, and in the seventh one tick is out of line."""
    blocks, strokes = pages(spark, d, "slot <> 5")
    blocks = blocks.where("seq NOT BETWEEN 41 AND 50")
    moved = F.when(F.col("seq") == 130, F.lit(6.0)).otherwise(F.lit(0.0))
    blocks = blocks.withColumns({"y0": F.col("y0") + moved, "y1": F.col("y1") + moved})
    charts = charts_of(blocks, *SIZE)
    axes = calibrated(charts, text_of(charts, blocks), strokes)
    found = warnings_of(charts, axes, traced(axes, strokes))
    return found.select("page", "chart", F.regexp_replace("warning", r" \([0-9.]+\)$", "").alias("warning"))


def hard_pages(spark, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, strokes and coloured spans of pages with four traces and with what makes them hard to read:
    digits inside the plots that come first in the text; every third page without tick strokes, every
    third without grid lines as well; and on each fourth page the right column's headers 3 points
    lower, which leaves the left charts no room."""
    c = written(drawn_curves(spark, d), "curves")
    charts = c.select("page", "slot").distinct()
    blocks = drawn.blocks(charts, printed(F.lit("5.52"))).unionByName(drawn.inner_digits(charts))
    lower = F.when((F.col("page") % 4 == 3) & (F.col("x0") > drawn.PAGE_WIDTH / 2) & F.col("text").contains("Animale"), F.lit(3.0)).otherwise(F.lit(0.0))
    blocks = blocks.withColumns({"y0": F.col("y0") + lower, "y1": F.col("y1") + lower})
    scaled = lambda k, low: c.withColumn("v", rounded(F.col("v") * F.lit(k) + F.lit(low), 4))
    strokes = drawn.strokes(c, charts)
    ticks, lines = F.col("r") == drawn.TICK_INK[0], F.col("r") == drawn.GRID_INK[0]
    strokes = strokes.where(~((ticks & (F.col("g") == 0.0) & (F.col("page") % 3 > 0)) | (lines & (F.col("page") % 3 == 2))))
    strokes = strokes.unionByName(drawn.polyline(scaled(0.5, 0.0), drawn.PRESSURE_INK, 0.0, 9.0))
    strokes = strokes.unionByName(drawn.polyline(scaled(0.8, 2.0), extraction.OWN_AXIS[CONDUCTIVITY], 2.0, 9.0))
    strokes = strokes.unionByName(drawn.polyline(scaled(3.5, 10.0), extraction.OWN_AXIS[TEMPERATURE], 10.0, 45.0))
    return written(blocks, "blocks"), written(strokes, "strokes"), written(drawn.coloured_axes(charts), "spans")


def extract_traces(spark, d):
    """Four curves of every chart that can be read, two of them on axes in their own colour."""
    blocks, strokes, spans = hard_pages(spark, d)
    return extraction.extract(blocks, strokes, *SIZE, spans, (FLOW, PRESSURE, CONDUCTIVITY, TEMPERATURE), written).curves


def extract_sources(spark, d):
    """Where each readable chart's time axis comes from, and its plot's box."""
    blocks, strokes, _ = hard_pages(spark, d)
    charts = charts_of(blocks, *SIZE)
    axes = calibrated(charts, text_of(charts, blocks), strokes)
    return axes.select(*CHART, "x_source", F.col("n").alias("ticks"), *[F.col(f"box.{k}").alias(f"box_{k}") for k in ("left", "right", "top", "bottom")])


def page_metadata(spark, d):
    """Headers of every page in order, padded to eight."""
    blocks, _, _ = hard_pages(spark, d)
    return extraction.page_metadata(blocks, drawn.PAGE_WIDTH)


def session_files(spark, d):
    """The run from pages to session files, read back: each chart's flow on the grid, by the file's name.
    Every seventh weight is not printed, others are off by up to 3 %; charts 3 and 5 of a page share
    the animal of chart 1."""
    c = written(drawn_curves(spark, d), "curves")
    charts = c.select("page", "slot").distinct()
    area = series.metrics(c, ["page", "slot"]).select("page", "slot", F.col("integral").alias("kg"))
    chart = F.col("page") * 8 + F.col("slot")
    weight = F.format_string("%.2f", rounded(F.col("kg") * (F.lit(1.0) + (chart % 7 - 3) * F.lit(0.01)), 2))
    animal = F.when(F.col("slot").isin(3, 5), F.col("page") * 8 + 1).otherwise(chart)
    text = F.concat(F.lit("Animale: "), animal, F.when(chart % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(" Quantità di latte: "), weight, F.lit(" kg"))), F.lit(" Data: 12.05.2025 Ora: 0"), F.col("slot"), F.lit(":58:23"))
    blocks = written(drawn.blocks(charts.join(area, ["page", "slot"]), text), "blocks")
    goal = f"{shared_folder(spark)}/report-{uuid4().hex}"
    run.run_pages(blocks, written(drawn.strokes(c, charts), "strokes"), *SIZE, goal)
    return files.read_sessions(spark, f"{goal}/sessions").select("file", "curve", "t", "v")


QUERIES = {f.__name__: f for f in (extract_axes, extract_curves, extract_warnings, extract_traces, extract_sources, page_metadata, session_files)}
DRAWN_SQL = f"{CURVES_SQL}, drawn AS (SELECT chart // 8 AS page, chart % 8 AS slot, chart, t, floor(v * CAST(0.09 AS DOUBLE) * 1e4 + 5e-1) / 1e4 AS v FROM curves WHERE t <= 10)"
PLACES_SQL = "k AS (SELECT page, slot, CAST(row_number() OVER (PARTITION BY page ORDER BY slot) - 1 AS INTEGER) AS chart FROM (SELECT DISTINCT page, slot FROM drawn))"
#: Left charts of a page whose right headers are 3 points lower end above them, where their row has a right chart.
READABLE_SQL = f"""{DRAWN_SQL}, {PLACES_SQL}, readable AS (
  SELECT * FROM k a WHERE NOT (page % 4 = 3 AND slot % 2 = 0 AND EXISTS (SELECT 1 FROM k b WHERE b.page = a.page AND b.slot = a.slot + 1)))"""
ORACLE_SQL = {
    "extract_axes": f"""WITH {DRAWN_SQL} SELECT DISTINCT page, CAST(row_number() OVER (PARTITION BY page ORDER BY slot) - 1 AS INTEGER) AS chart, CAST(chart AS VARCHAR) AS animal_id, '2025-05-12' AS date_iso, 552e-2 AS milk_kg,
      CAST(10 AS BIGINT) AS n, 0 AS t_min, 10 AS t_max, 0 AS v_bottom, 9 AS v_top, 'ticks' AS x_source, true AS within_residual FROM (SELECT DISTINCT page, slot, chart FROM drawn)""",
    "extract_curves": f"WITH {DRAWN_SQL}, {PLACES_SQL} SELECT d.page, k.chart, d.t, d.v FROM drawn d JOIN k ON d.page = k.page AND d.slot = k.slot",
    "extract_warnings": f"""WITH {DRAWN_SQL}, {PLACES_SQL}
      SELECT page, chart, CASE slot WHEN 2 THEN 'Axis calibration failed: chart skipped' WHEN 5 THEN 'Flusso curve not present in vector layer' ELSE 'Y calibration residual high' END AS warning
      FROM k WHERE slot IN (2, 5, 6)""",
    "extract_traces": f"""WITH {READABLE_SQL}, scales AS (SELECT * FROM (VALUES ('{FLOW}', 1e0, 0e0), ('{PRESSURE}', 5e-1, 0e0), ('{CONDUCTIVITY}', 8e-1, 2e0), ('{TEMPERATURE}', 35e-1, 1e1)) s(curve, scale, low))
      SELECT r.page, r.chart, curve, t, CASE WHEN curve = '{FLOW}' THEN v ELSE floor((v * scale + low) * 1e4 + 5e-1) / 1e4 END AS v
      FROM drawn d JOIN readable r ON d.page = r.page AND d.slot = r.slot, scales""",
    "extract_sources": f"""WITH {READABLE_SQL}, tops AS (SELECT *, [CAST(14.8 AS DOUBLE), CAST(213.8 AS DOUBLE), CAST(412.8 AS DOUBLE), CAST(611.7 AS DOUBLE)][slot // 2 + 1] AS top,
        CASE WHEN slot % 2 = 0 THEN CAST(41.76 AS DOUBLE) ELSE CAST(316.92 AS DOUBLE) END AS x FROM readable),
      every AS (SELECT k.page, round_even([CAST(14.8 AS DOUBLE), CAST(213.8 AS DOUBLE), CAST(412.8 AS DOUBLE), CAST(611.7 AS DOUBLE)][slot // 2 + 1] + CASE WHEN page % 4 = 3 AND slot % 2 = 1 THEN 3e0 ELSE 0e0 END, 0) AS head FROM k),
      windows AS (SELECT t.*, top + CASE WHEN page % 4 = 3 AND slot % 2 = 1 THEN 3e0 ELSE 0e0 END - 6e0 AS y0,
        coalesce((SELECT min(head) FROM every e WHERE e.page = t.page AND e.head > round_even(top + CASE WHEN t.page % 4 = 3 AND t.slot % 2 = 1 THEN 3e0 ELSE 0e0 END, 0)) - 6e0, CAST(841.92 AS DOUBLE)) AS y1,
        least(CASE WHEN slot % 2 = 0 THEN 0e0 ELSE CAST(297.66 AS DOUBLE) END, x - 4e0) AS c0, greatest(CASE WHEN slot % 2 = 0 THEN CAST(297.66 AS DOUBLE) ELSE CAST(595.32 AS DOUBLE) END, x + 252e0 + 4e0) AS c1 FROM tops t)
      SELECT page, chart, CASE page % 3 WHEN 0 THEN 'ticks' WHEN 1 THEN 'grid' ELSE 'labels' END AS x_source, CAST(10 AS BIGINT) AS ticks,
        floor((x - c0) / (c1 - c0) * 1e6 + 5e-1) / 1e6 AS box_left, floor((x + 252e0 - c0) / (c1 - c0) * 1e6 + 5e-1) / 1e6 AS box_right,
        floor((top + 28e0 - y0) / (y1 - y0) * 1e6 + 5e-1) / 1e6 AS box_top, floor((top + 148e0 - y0) / (y1 - y0) * 1e6 + 5e-1) / 1e6 AS box_bottom FROM windows""",
    "page_metadata": f"""WITH {DRAWN_SQL}, {PLACES_SQL}, slots AS (SELECT DISTINCT page, CAST(s AS INTEGER) AS chart FROM k, range(0, 8) r(s))
      SELECT s.page, s.chart, CAST(k.page * 8 + k.slot AS VARCHAR) AS animal_id, CASE WHEN k.page IS NOT NULL THEN '2025-05-12' END AS date_iso, CASE WHEN k.page IS NOT NULL THEN '0358' END AS time_hhmm
      FROM slots s LEFT JOIN k ON s.page = k.page AND s.chart = k.chart""",
    "session_files": f"""WITH {DRAWN_SQL}, {PLACES_SQL}, area AS (SELECT page, slot, chart AS id, t, v, (v + lag(v) OVER w) / 2e0 * (t - lag(t) OVER w) AS a FROM drawn WINDOW w AS (PARTITION BY chart ORDER BY t)
      ), sums AS (SELECT page, slot, id, count(*) AS n, sum(a) AS area, max(t) AS t9, max(t) - min(t) AS span FROM area GROUP BY ALL
      ), stated AS (SELECT *, CASE WHEN id % 7 <> 0 THEN floor(floor(coalesce(area, 0e0) * 1e4 + 5e-1) / 1e4 * (1e0 + (id % 7 - 3) * CAST(0.01 AS DOUBLE)) * 1e2 + 5e-1) / 1e2 END AS kg FROM sums
      ), scales AS (SELECT *, CASE WHEN n >= 2 AND kg > 0 AND area > 0 AND abs(kg - area) <= CAST(9e0 / 12e1 * CAST(0.72 AS DOUBLE) AS DOUBLE) * span * CAST(1.15 AS DOUBLE) THEN kg / area END AS scale FROM stated WHERE n > 1 AND t9 > 0
      ), curves2 AS (SELECT d.chart, t, v * coalesce(scale, 1e0) AS v FROM drawn d JOIN scales s ON d.chart = s.id
      ), bound AS (SELECT chart, min(t) AS t0, max(t) AS t9 FROM curves2 GROUP BY chart
      ), probes AS (SELECT chart, i * CAST(0.02 AS DOUBLE) AS t FROM bound, unnest(range(0, CAST(floor(t9 / CAST(0.02 AS DOUBLE)) AS BIGINT) + 2)) AS r(i) WHERE i * CAST(0.02 AS DOUBLE) < t9 - 1e-9 UNION SELECT chart, t9 FROM bound
      ), grid AS (SELECT p.chart, floor(p.t * 1e4 + 5e-1) / 1e4 AS t, CASE WHEN a.t IS NULL THEN b.v WHEN b.t IS NULL THEN a.v WHEN a.t = p.t OR a.t = b.t THEN a.v ELSE a.v + (b.v - a.v) * (p.t - a.t) / (b.t - a.t) END AS v
        FROM probes p ASOF LEFT JOIN curves2 a ON p.chart = a.chart AND p.t >= a.t ASOF LEFT JOIN curves2 b ON p.chart = b.chart AND p.t <= b.t
      ), ga AS (SELECT chart, (v + lag(v) OVER w) / 2e0 * (t - lag(t) OVER w) AS a FROM grid WINDOW w AS (PARTITION BY chart ORDER BY t)
      ), gs AS (SELECT chart, sum(a) AS area FROM ga GROUP BY chart
      ), named AS (SELECT s.*, CASE WHEN s.slot IN (3, 5) THEN s.page * 8 + 1 ELSE s.id END AS animal, row_number() OVER (PARTITION BY CASE WHEN s.slot IN (3, 5) THEN s.page * 8 + 1 ELSE s.id END ORDER BY s.slot) AS k FROM scales s)
      SELECT 'animal_' || animal || '_2025-05-12' || CASE WHEN k > 1 THEN '_0' || slot || '58' ELSE '' END || '.csv' AS file, '{FLOW}' AS curve, t,
        floor(CASE WHEN scale IS NOT NULL AND gs.area > 0 AND abs(kg / gs.area - 1e0) <= 1e-3 THEN v * (kg / gs.area) ELSE v END * 1e4 + 5e-1) / 1e4 AS v
      FROM grid JOIN gs USING (chart) JOIN named n ON n.id = grid.chart""",
}
