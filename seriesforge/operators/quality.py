"""How well curves agree: errors on shared grids, gates, pooled and two-level statistics, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seriesforge.functions.scalars import GATE, accuracy_pct, rounded
from seriesforge.operators.selection import middle, selected, upper
from seriesforge.operators.series import both_at_times, trapezoid


def even_times(spans: DataFrame, keys: list[str], start: Column, end: Column, n: int) -> DataFrame:
    """``n`` evenly spaced times from start to end for each row of ``spans``."""
    times = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + (end - start) * i / F.lit(float(n - 1)))
    return spans.select(*keys, F.explode(times).alias("t"))


def errors_at(truth: DataFrame, found: DataFrame, probes: DataFrame, keys: list[str], outside: str = "clamp") -> DataFrame:
    """|truth - found| at the probes: (keys, t, v, w, error), a row for each probe. Both sides are
    interpolated by one exchange."""
    return both_at_times(truth, found, probes, keys, outside).withColumn("error", F.abs(F.col("v") - F.col("w")))


def error_stats(errors: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, median and largest error and how many probes had one."""
    return errors.groupBy(*keys).agg(rounded(F.avg("error"), 4).alias("mean"), rounded(F.median("error"), 4).alias("median"), rounded(F.max("error"), 4).alias("max"), F.count("error").alias("n"))


def gated(stats: DataFrame, top: Column, bottom: Column, gate: float = GATE) -> DataFrame:
    """Adds ``accuracy_pct`` and whether it passes."""
    made = stats.withColumn("accuracy_pct", accuracy_pct(F.col("median"), top, bottom))
    return made.withColumn("passed", F.coalesce(F.col("accuracy_pct") >= F.lit(gate), F.lit(False)))


def pooled(rows: DataFrame, mae: str, coverage: str) -> DataFrame:
    """Over charts: a missing error is left out of the errors, but counts in the coverage."""
    return rows.agg(
        F.count("*").alias("charts"), rounded(F.avg(mae), 4).alias("mae_mean"), rounded(F.median(mae), 4).alias("mae_median"), rounded(F.max(mae), 4).alias("mae_max"), rounded(F.avg(coverage), 4).alias("coverage_mean")
    )


def accuracy_report(rows: DataFrame) -> DataFrame:
    """Errors of charts (dataset, chart, curve, found, mae, coverage) for every chart, every data set and over all, in
    one aggregation: (level, dataset, chart, curve) with how many charts there are, were found and have
    an error, and the mean, median and largest error and mean coverage of the found ones. Where a
    found chart lacks the curve, its error is left out and its coverage counts as 0."""
    none = F.lit(None).cast("string")
    levels = [("chart", F.col("dataset"), F.col("chart").cast("string")), ("dataset", F.col("dataset"), none), ("all", none, none)]
    spread = F.inline(F.array(*[F.struct(F.lit(n).alias("level"), d.cast("string").alias("dataset"), c.alias("chart")) for n, d, c in levels]))
    mae, coverage = F.when(F.col("found"), F.col("mae")), F.when(F.col("found"), F.coalesce(F.col("coverage"), F.lit(0.0)))
    keys = ["level", "dataset", "chart", "curve"]
    long = rows.select("curve", "found", mae.alias("mae"), coverage.alias("coverage"), spread)
    sums = long.groupBy(*keys).agg(
        F.count("*").alias("charts"), F.count_if("found").alias("found"), F.count("mae").alias("detected"),
        rounded(F.avg("mae"), 4).alias("mae_mean"), rounded(F.max("mae"), 4).alias("mae_max"), rounded(F.avg("coverage"), 4).alias("coverage_mean"),
    )
    medians = middle(long, keys, "mae").select(*[F.col(k).alias(f"m_{k}") for k in keys], rounded(F.col("median"), 4).alias("mae_median"))
    same = [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in keys]
    return sums.join(medians, same, "left").drop(*[f"m_{k}" for k in keys])


def session_scores(truth: DataFrame, found: DataFrame, stated: DataFrame, keys: list[str], probes: int = 200) -> DataFrame:
    """How well sessions were recovered: curves ``truth`` and ``found`` (keys, t, v) and what is ``stated`` of the
    true ones (keys, milk_kg). Errors are taken at even times from 0 to the earlier of both ends; with them
    those of the peak and the end, and the found area in percent of the stated weight (0 without
    one). Sessions that weren't found have nulls."""
    sizes = lambda rows, n: rows.groupBy(*keys).agg(F.max("t").alias(f"end_{n}"), F.max("v").alias(f"peak_{n}"))
    area = found.withColumn("__a", trapezoid(keys)).groupBy(*keys).agg(F.coalesce(F.sum("__a"), F.lit(0.0)).alias("area"))
    both = sizes(truth, 1).join(sizes(found, 2), keys, "left").join(area, keys, "left").join(stated, keys, "left")
    grid = even_times(both.where("end_2 is not null"), keys, F.lit(0.0), F.least("end_1", "end_2"), probes)
    errors = errors_at(truth, found, grid, keys).groupBy(*keys).agg(F.avg("error").alias("mean"), F.max("error").alias("max"))
    pct = F.when(F.col("area").isNotNull(), F.coalesce(F.when(F.col("milk_kg") != 0, 100.0 * F.col("area") / F.col("milk_kg")), F.lit(0.0)))
    made = both.join(errors, keys, "left")
    return made.select(
        *keys, F.col("end_2").isNotNull().alias("found"), rounded(F.col("mean"), 4).alias("curve_mean"), rounded(F.col("max"), 4).alias("curve_max"),
        rounded(F.abs(F.col("peak_2") - F.col("peak_1")), 4).alias("peak_error"), rounded(F.abs(F.col("end_2") - F.col("end_1")), 4).alias("end_error"), rounded(pct, 2).alias("milk_pct"),
    )


def report_summary(charts: DataFrame, keys: list[str], gate: float = GATE) -> DataFrame:
    """One row a report. Medians are upper medians; if any chart has a score, one without counts as
    failing; totals of printed and measured weight are over charts that have both."""
    complete = ~F.col("reaches_axis_end") & F.col("printed").isNotNull() & (F.col("printed") > 0)
    scored = F.count("accuracy_pct")
    ratio = F.when(F.col("printed") > 0, F.col("measured") / F.col("printed"))
    values = F.inline(F.array(*[F.struct(F.lit(n).alias("of"), x.alias("x")) for n, x in (("accuracy", F.col("accuracy_pct")), ("yield", ratio))]))
    medians = selected(charts.select(*keys, values), [*keys, "of"], "x", {"median": upper})
    pick = lambda n, places: rounded(F.max(F.when(F.col("of") == n, F.col("median"))), places)
    medians = medians.groupBy(*keys).agg(pick("accuracy", 2).alias("accuracy_median"), pick("yield", 4).alias("yield_median"))
    failing = F.coalesce(F.col("accuracy_pct"), F.lit(0.0)) < F.lit(gate)
    sums = charts.groupBy(*keys).agg(
        F.count("*").alias("charts"), scored.alias("scored"), F.min("accuracy_pct").alias("accuracy_worst"),
        F.when(scored > 0, F.count_if(failing)).otherwise(F.lit(0)).alias("below_gate"),
        F.when(scored > 0, F.array_sort(F.collect_list(F.when(failing, F.col("chart"))))).alias("failing"),
        F.count_if(F.col("reason") == "applied").alias("calibrated"), F.count_if(F.col("reason") == "exceeds_pen_width").alias("refused"),
        rounded(F.coalesce(F.sum(F.when(complete, F.col("measured"))), F.lit(0.0)) / F.sum(F.when(complete, F.col("printed"))) * 100, 2).alias("milk_pct_complete"),
    )
    return sums.join(medians, keys, "left")
