"""The run from pages to files: every chart's session as one CSV, and a report of all charts.

The extraction's curves are written once; scales, metrics, grids, names and the report all start from
that table. Files are made in hidden folders, get their names there and appear together: a run that
dies leaves nothing that a reader sees. In a file system that all machines open, tasks write sessions under
their names; in other stores Spark writes them, and they are renamed.

Of sessions that share an animal and a date, the first (by page and chart) has the plain name, later
ones the time, or a number where none is printed. Where even that name is taken, a number is put
behind it, so no session replaces another.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, Window as W, functions as F

from seriesforge.functions.scalars import rounded
from seriesforge.operators import extraction, matching, series
from seriesforge.operators.extraction import CHART, FLOW, TRACE
from seriesforge.sources.files import write_named_sessions, write_report, write_sessions
from seriesforge.sources.publish import hidden_beside, local_path, publish
from seriesforge.sources.shared import written


def scaled(curves: DataFrame, charts: DataFrame, axes: DataFrame) -> DataFrame:
    """(page, chart, milk_kg, milk_scale, milk_calibrated, reason, measured_kg, pct_of_printed): how each chart's
    flow is scaled to its printed weight, or why it isn't."""
    flow = curves.where(F.col("curve") == FLOW).withColumn("__a", series.trapezoid(CHART))
    area = flow.groupBy(*CHART).agg(F.sum("__a").alias("area"), F.count("*").alias("points"), (F.max("t") - F.min("t")).alias("duration"))
    known = charts.select(*CHART, "milk_kg").join(axes.select(*CHART, "slope"), CHART, "left").join(area, CHART, "left")
    scale, reason = series.scaled_to_total(F.col("area"), F.col("milk_kg"), F.col("duration"), F.coalesce("points", F.lit(0)), F.col("slope"))
    made = known.withColumns({"scale": scale, "reason": reason})
    beyond = F.col("reason") == "exceeds_pen_width"
    printed_scale = F.when(beyond, F.col("milk_kg") / F.col("area")).otherwise(F.col("scale"))
    return made.select(
        *CHART, "milk_kg", "scale", rounded(printed_scale, 4).alias("milk_scale"), (F.col("reason") == "applied").alias("milk_calibrated"),
        F.when(F.col("reason") != "applied", F.col("reason")).alias("reason"),
        F.when(beyond, rounded(F.col("area"), 3)).alias("measured_kg"), F.when(beyond, rounded(100.0 * F.col("area") / F.col("milk_kg"), 1)).alias("pct_of_printed"),
    )


def named(charts: DataFrame) -> DataFrame:
    """(page, chart, csv_name) of charts (page, chart, animal_id, date_iso, time_hhmm)."""
    animal = F.coalesce("animal_id", F.concat(F.lit("unknown_"), F.col("chart")))
    rows = charts.select(*CHART, "time_hhmm", F.concat(F.lit("animal_"), animal, F.lit("_"), F.coalesce("date_iso", F.lit("unknown_date"))).alias("base"))
    rows = matching.session_names(rows, ["base"], CHART, F.col("base"), F.col("time_hhmm"))
    again = F.row_number().over(W.partitionBy("csv_name").orderBy(*CHART)) - 1
    other = F.concat(F.regexp_replace("csv_name", r"\.csv$", "_"), F.lpad(F.col("again").cast("string"), 4, "0"), F.lit(".csv"))
    return rows.withColumn("again", again).select(*CHART, F.when(F.col("again") > 0, other).otherwise(F.col("csv_name")).alias("csv_name"))


def run_pages(blocks: DataFrame, strokes: DataFrame, width: float, height: float, goal: str, spans: DataFrame | None = None, curves: tuple[str, ...] = (FLOW,)) -> list[str]:
    """Writes the new folder ``goal``: ``sessions`` with a CSV (curve, time_min, value) for each chart that has a
    curve, and ``report`` with a JSON line for each chart. Returns the files' names. Raises
    ``FileExistsError`` if the folder exists."""
    found = extraction.extract(blocks, strokes, width, height, spans, curves, written)
    charts, axes, rows = written(found.charts, "charts"), found.axes, written(found.curves, "curves")
    weights = written(scaled(rows, charts, axes), "weights")

    fitted = rows.join(weights.select(*CHART, "scale"), CHART).withColumn("v", F.when(F.col("curve") == FLOW, F.col("v") * F.col("scale")).otherwise(F.col("v"))).drop("scale")
    totals = weights.where("milk_calibrated").select(*CHART, F.col("milk_kg").alias("total"))
    table = written(series.long_table(fitted, TRACE, totals, flow=FLOW), "sessions")
    sizes = table.groupBy(*CHART).agg(F.count("*").alias("csv_rows"))
    names = written(named(charts.join(sizes.select(*CHART), CHART, "left_semi")), "names")

    hidden, staged = hidden_beside(goal), hidden_beside(goal)
    spark, files = blocks.sparkSession, table.join(names, CHART)
    if (folder := local_path(spark, f"{staged}/sessions")) is not None:
        write_named_sessions(files, folder, local_path(spark, f"{hidden}/waiting"))
        sessions = [f"sessions/{r.csv_name}" for r in names.select("csv_name").distinct().collect()]
    else:
        write_sessions(files, f"{hidden}/sessions")
        sessions = []
    metrics = series.metrics(fitted, TRACE)
    summary = metrics.groupBy(*CHART).agg(F.map_from_entries(F.collect_list(F.struct("curve", F.struct("points", "t_min", "t_max", "v_min", "v_max", "v_mean", "integral")))).alias("metrics"), F.max(F.when(F.col("curve") == FLOW, F.col("integral"))).alias("integral"))
    ends = rows.where(F.col("curve") == FLOW).join(axes.select(*CHART, "t_max"), CHART)
    ends = series.tail_mean(ends, [*CHART, "t_max"], 0.0).select(*CHART, ((F.col("t_last") >= F.col("t_max") - 1e-6) & (F.col("tail_mean") > 0.10)).alias("reaches_axis_end"))
    warnings = extraction.warnings_of(charts, axes, rows.where(F.col("curve") == FLOW)).groupBy(*CHART).agg(F.array_sort(F.collect_list("warning")).alias("warnings"))
    calibration = F.struct("slope", "intercept", F.col("n").alias("ticks"), rounded(F.col("residual"), 5).alias("residual"), "x_left", "x_right", "t_min", "t_max", "x_source", "box").alias("calibration")
    report = charts.drop("head", "head_text", "x0", "x1", "milk_kg")
    for part in (axes.select(*CHART, calibration), weights.drop("scale"), summary, ends, warnings, sizes, names.withColumnRenamed("csv_name", "csv_file")):
        report = report.join(part, CHART, "left")
    report = report.withColumns({
        "source": F.when(F.col("calibration.x_right") > F.col("calibration.x_left"), "vector").otherwise("none"),
        "warnings": F.coalesce("warnings", F.array().cast("array<string>")),
        "reaches_axis_end": F.coalesce("reaches_axis_end", F.lit(False)),
        "yield_ratio": F.when((F.col("milk_kg") > 0) & (F.col("integral") > 0), rounded(F.col("integral") / F.col("milk_kg"), 4)),
    })
    write_report(report.drop("integral"), f"{hidden}/report")

    def name(path: str) -> str | None:
        session = re.match(r"sessions/csv_name=([^/]+)/part-", path)
        if session:
            return f"sessions/{unquote(session[1])}"
        part = re.match(r"report/part-(\d+)-.*\.json$", path)
        return f"report/report-{part[1]}.json" if part else None

    return sorted([*sessions, *publish(spark, hidden, goal, name, staged=staged)])
