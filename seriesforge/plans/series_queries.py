"""Queries on curves, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from seriesforge.functions.scalars import STEP, clip, pixel_to_data, rounded
from seriesforge.operators import quality, series
from seriesforge.sources.shared import written
from seriesforge.sources.tables import CURVES_SQL, POINTS_SQL, points, table

KEY = ["chart"]
METRICS_SQL = """area AS (
  SELECT *, (v + lag(v) OVER w) / 2e0 * (t - lag(t) OVER w) AS a FROM curves WINDOW w AS (PARTITION BY chart ORDER BY t)
), metrics AS (
  SELECT chart, count(*) AS points, min(t) AS t_min, max(t) AS t_max, min(v) AS v_min, max(v) AS v_max,
    floor(avg(v) * 1e4 + 5e-1) / 1e4 AS v_mean, floor(coalesce(sum(a), 0e0) * 1e4 + 5e-1) / 1e4 AS integral
  FROM area GROUP BY chart)"""
#: A second version of every curve, a little off, to compare with.
OFF_SQL = "off AS (SELECT chart, t, v * (1e0 + (chart % 7) * 1e-2) AS v FROM curves WHERE chart % 10 <> 9)"
PROBE_SQL = """
  SELECT p.chart, p.t, CASE WHEN a.t IS NULL THEN b.v WHEN b.t IS NULL THEN a.v WHEN a.t = p.t OR a.t = b.t THEN a.v
    ELSE a.v + (b.v - a.v) * (p.t - a.t) / (b.t - a.t) END AS {out}
  FROM probes p ASOF LEFT JOIN {curve} a ON p.chart = a.chart AND p.t >= a.t ASOF LEFT JOIN {curve} b ON p.chart = b.chart AND p.t <= b.t"""


def curves(spark, d: str) -> DataFrame:
    return series.collapse(points(spark, d), KEY, low=0.0, high=100.0)


def off(curve: DataFrame) -> DataFrame:
    return curve.where("chart % 10 <> 9").select("chart", "t", (F.col("v") * (F.lit(1.0) + (F.col("chart") % 7) * F.lit(0.01))).alias("v"))


def curve_metrics(spark, d):
    return series.metrics(curves(spark, d), KEY)


def curve_resample(spark, d):
    return series.resample(curves(spark, d), KEY, STEP)


def curve_point_collapse(spark, d):
    p = points(spark, d).withColumn("t", rounded(F.col("t"), 1))
    return series.collapse(p, KEY, low=0.0, high=100.0)


def curve_clamp(spark, d):
    p = points(spark, d)
    return p.select("chart", "seq", clip(F.col("t"), F.lit(1.0), F.lit(9.0)).alias("t"), clip(F.col("v"), F.lit(0.0), F.lit(100.0)).alias("v"))


def axis_transform(spark, d):
    rows = table(spark, d, "lineitem")
    right = F.when(F.col("l_linenumber") % 5 == 0, F.lit(0.0)).otherwise(F.lit(50.0))
    t, v = pixel_to_data(F.col("l_quantity"), F.col("l_discount") * F.lit(1000.0), F.lit(0.0), right, F.lit(10.0), F.lit(90.0), 10.0, 9.0)
    return rows.select("l_orderkey", "l_linenumber", t.alias("time_min"), v.alias("value"))


def weighed(spark, d) -> DataFrame:
    """Metrics with a printed total: off by up to 3 %, sometimes missing or zero."""
    m = series.metrics(curves(spark, d), KEY)
    printed = F.when(F.col("chart") % 11 == 0, None).when(F.col("chart") % 13 == 0, F.lit(0.0)).otherwise(F.col("integral") * (F.lit(1.0) + (F.col("chart") % 7 - 3) * F.lit(0.0005)))
    return m.withColumn("printed", printed)


WEIGHED_SQL = """weighed AS (
  SELECT *, CASE WHEN chart % 11 = 0 THEN NULL WHEN chart % 13 = 0 THEN 0e0 ELSE integral * (1e0 + (chart % 7 - 3) * 5e-4) END AS printed FROM metrics
), reasons AS (
  SELECT *, CASE WHEN points < 2 OR printed IS NULL OR printed <= 0 THEN 'no_printed_weight' WHEN integral <= 0 THEN 'no_area'
    WHEN abs(printed - integral) > 389e-4 * (t_max - t_min) * 115e-2 THEN 'exceeds_pen_width' ELSE 'applied' END AS reason FROM weighed
), scaled AS (SELECT *, CASE WHEN reason = 'applied' THEN printed / integral ELSE 1e0 END AS scale FROM reasons)"""


def scaled(spark, d) -> DataFrame:
    m = weighed(spark, d)
    scale, reason = series.scaled_to_total(F.col("integral"), F.col("printed"), F.col("t_max") - F.col("t_min"), F.col("points"))
    return m.withColumns({"scale": scale, "reason": reason})


def printed_weight_calibration(spark, d):
    m = scaled(spark, d)
    measured = F.col("integral") * F.col("scale")
    known = F.col("printed") > 0
    return m.select(
        "chart", rounded(F.col("scale"), 6).alias("scale"), "reason", rounded(measured, 3).alias("measured_kg"),
        F.when(known, rounded(F.col("integral") / F.col("printed") * F.lit(100.0), 1)).alias("pct_of_printed"),
        F.when(known, rounded(measured / F.col("printed"), 4)).alias("yield_ratio"),
    )


def grid_refit(spark, d):
    grid = series.resample(curves(spark, d), KEY, STEP)
    area = grid.withColumn("a", series.trapezoid(KEY)).groupBy("chart").agg(F.sum("a").alias("grid_area"))
    k = F.when(F.col("grid_area") > 0, F.col("printed") / F.col("grid_area"))
    both = scaled(spark, d).join(area, "chart").withColumn("k", k * F.lit(1.0))
    near = F.coalesce((F.col("reason") == "applied") & (F.abs(F.col("k") / F.col("scale") - 1) <= 1e-3), F.lit(False))
    return both.select("chart", rounded(F.col("grid_area"), 4).alias("grid_area"), near.alias("refit"), rounded(F.when(near, F.col("k")).otherwise(F.col("scale")), 5).alias("k"))


def axis_end_flag(spark, d):
    return series.tail_mean(curves(spark, d), KEY, 9.9)


def session_threshold_stats(spark, d):
    return series.threshold_stats(curves(spark, d), KEY, 20.0)


def even_index_sample(spark, d):
    return series.even_sample(curves(spark, d), KEY, 30).select("chart", "t", "v")


def probes(curve: DataFrame, n: int, inner: float = 0.05) -> DataFrame:
    """Even times in the middle of each series."""
    spans = curve.groupBy("chart").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    width = F.col("b") - F.col("a")
    return quality.even_times(spans, KEY, F.col("a") + width * F.lit(inner), F.col("b") - width * F.lit(inner), n)


def probes_sql(n: int, inner: str = "5e-2") -> str:
    return f"""spans AS (SELECT chart, min(t) AS a, max(t) AS b FROM curves GROUP BY chart
), probes AS (
  SELECT chart, (a + (b - a) * {inner}) + ((b - (b - a) * {inner}) - (a + (b - a) * {inner})) * i / CAST({n - 1} AS DOUBLE) AS t FROM spans, unnest(range(0, {n})) AS r(i))"""


def fidelity(spark, d) -> DataFrame:
    c = curves(spark, d)
    return quality.error_stats(quality.errors_at(c, off(c), probes(c.where("chart % 10 <> 9"), 40), KEY), KEY)


FIDELITY_SQL = f"""{CURVES_SQL}, {OFF_SQL}, {probes_sql(40).replace("FROM curves GROUP", "FROM curves WHERE chart % 10 <> 9 GROUP")},
one AS ({PROBE_SQL.format(curve="curves", out="v")}), two AS ({PROBE_SQL.format(curve="off", out="w")}),
errors AS (SELECT one.chart, one.t, abs(v - w) AS error FROM one JOIN two ON one.chart = two.chart AND one.t = two.t),
fidelity AS (SELECT chart, floor(avg(error) * 1e4 + 5e-1) / 1e4 AS mean, floor(median(error) * 1e4 + 5e-1) / 1e4 AS median,
  floor(max(error) * 1e4 + 5e-1) / 1e4 AS max, count(error) AS n FROM errors GROUP BY chart)"""


def fidelity_stats(spark, d):
    return fidelity(spark, d)


def gate(spark, d) -> DataFrame:
    f = fidelity(spark, d)
    return quality.gated(f, F.when(F.col("chart") % 5 == 0, F.lit(0.0)).otherwise(F.lit(100.0)), F.lit(0.0))


GATE_SQL = """gated AS (
  SELECT *, floor(greatest(0e0, 1e2 * (1e0 - median / (coalesce(nullif(CASE WHEN chart % 5 = 0 THEN 0e0 ELSE 1e2 END, 0e0), 9e0) - 0e0))) * 1e2 + 5e-1) / 1e2 AS accuracy_pct FROM fidelity
), judged AS (SELECT *, coalesce(accuracy_pct >= 98e0, false) AS passed FROM gated)"""


def accuracy_gate(spark, d):
    return gate(spark, d).select("chart", "accuracy_pct", "passed")


def mae(spark, d) -> DataFrame:
    """Error and coverage of every true curve; one that was not found has no error and coverage 0."""
    c = curves(spark, d)
    found = off(c)
    e = quality.errors_at(c, found, c.select("chart", "t"), KEY).groupBy("chart").agg(rounded(F.avg("error"), 4).alias("mae"))
    span = c.groupBy("chart").agg(F.max("t").alias("truth_end")).join(found.groupBy("chart").agg(F.max("t").alias("found_end")), "chart", "left")
    coverage = F.coalesce(F.least(F.col("found_end") / F.col("truth_end"), F.lit(1.0)), F.lit(0.0))
    return span.join(e.where("chart % 10 <> 9"), "chart", "left").select("chart", "mae", rounded(coverage, 4).alias("coverage"))


MAE_SQL = f"""{CURVES_SQL}, {OFF_SQL}, probes AS (SELECT chart, t FROM curves),
two AS ({PROBE_SQL.format(curve="off", out="w")}),
e AS (SELECT c.chart, floor(avg(abs(c.v - w)) * 1e4 + 5e-1) / 1e4 AS mae FROM curves c JOIN two ON c.chart = two.chart AND c.t = two.t WHERE c.chart % 10 <> 9 GROUP BY c.chart),
mae AS (SELECT s.chart, e.mae, floor(coalesce(least(f.found_end / s.truth_end, 1e0), 0e0) * 1e4 + 5e-1) / 1e4 AS coverage
  FROM (SELECT chart, max(t) AS truth_end FROM curves GROUP BY chart) s LEFT JOIN (SELECT chart, max(t) AS found_end FROM off GROUP BY chart) f USING (chart) LEFT JOIN e USING (chart))"""


def mae_coverage(spark, d):
    return mae(spark, d)


def pooled_accuracy(spark, d):
    return quality.pooled(mae(spark, d), "mae", "coverage")


def two_level_error(spark, d):
    f = fidelity(spark, d).withColumn("report", F.floor(F.col("chart") / 8))
    return f.groupBy("report").agg(rounded(F.avg("mean"), 4).alias("mean_of_means"), rounded(F.median("median"), 4).alias("median_of_medians"), F.max("max").alias("max_of_max"), F.sum("n").alias("n"))


def yield_check(spark, d):
    m = scaled(spark, d).where("printed > 0").withColumn("ratio", F.col("integral") / F.col("printed"))
    return m.agg(rounded(F.median("ratio"), 4).alias("median_ratio"), F.count_if(F.abs(F.col("ratio") - 1) <= 0.001).alias("near"), F.count("*").alias("charts"))


def worst_signed_deviation(spark, d):
    m = scaled(spark, d).where("printed > 0").withColumn("milk", rounded(F.col("integral") / F.col("printed") * 100, 4)).withColumn("report", F.floor(F.col("chart") / 8))
    return m.groupBy("report").agg(F.max_by("milk", F.struct(F.abs(F.col("milk") - 100), -F.col("chart"))).alias("worst_milk_pct"))


def asof_outside_null(spark, d):
    c = curves(spark, d)
    spans = c.groupBy("chart").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    p = quality.even_times(spans, KEY, F.lit(-1.0), F.lit(11.0), 60)
    return series.at_times(c, p, KEY, "null")


def demo_score(spark, d):
    """Errors on a shared grid of 200 times, and those of peak and end."""
    c = curves(spark, d)
    o = off(c)
    e = quality.errors_at(c, o, probes(c.where("chart % 10 <> 9"), 200, 0.0), KEY).groupBy("chart").agg(rounded(F.avg("error"), 4).alias("mean_error"), rounded(F.max("error"), 4).alias("max_error"))
    ends = lambda x, n: x.groupBy("chart").agg(F.max("v").alias(f"peak_{n}"), F.max("t").alias(f"end_{n}"))
    both = ends(c, 1).join(ends(o, 2), "chart").join(e, "chart")
    return both.select("chart", "mean_error", "max_error", rounded(F.abs(F.col("peak_1") - F.col("peak_2")), 4).alias("peak_error"), F.abs(F.col("end_1") - F.col("end_2")).alias("end_error"))


def report_summary(spark, d):
    m = scaled(spark, d).join(gate(spark, d).select("chart", "accuracy_pct"), "chart", "left")
    m = m.join(series.tail_mean(curves(spark, d), KEY, 9.9).select("chart", "reaches_axis_end"), "chart")
    m = m.withColumn("report", F.floor(F.col("chart") / 8)).withColumn("measured", F.col("integral") * F.col("scale"))
    m = written(m.select("report", "chart", "accuracy_pct", "reaches_axis_end", "printed", "measured", "reason"), "report-charts")  # read four times
    return quality.report_summary(m, ["report"]).withColumn("failing", F.concat_ws(",", F.col("failing").cast("array<string>")))


TAIL_SQL = """ends AS (SELECT *, max(t) OVER (PARTITION BY chart) AS t_last FROM curves),
tails AS (SELECT chart, max(t_last) AS t_last, avg(v) FILTER (t >= t_last - 1e0) AS tail FROM ends GROUP BY chart),
flags AS (SELECT chart, t_last, floor(tail * 1e8 + 5e-1) / 1e8 AS tail_mean, t_last >= CAST(9.9 - 1e-6 AS DOUBLE) AND tail > 1e-1 AS reaches_axis_end FROM tails)"""


def warning_list(spark, d):
    m = scaled(spark, d)
    words = F.array(F.when(F.col("points") < 60, F.lit("few points")), F.when(F.col("reason") == "exceeds_pen_width", F.lit("weight beyond pen width")), F.when(F.col("printed").isNull(), F.lit("no printed weight")))
    m = m.select("chart", F.filter(words, lambda x: x.isNotNull()).alias("w")).where("size(w) > 0")
    label = F.concat(F.lit("Page "), F.floor(F.col("chart") / 8) + 1, F.lit(" Chart "), F.col("chart") % 8 + 1)
    return m.select("chart", label.alias("label"), F.concat_ws("; ", "w").alias("warnings"))


def has_vector_curves(spark, d):
    """A report counts as drawn if its first page has twenty flow strokes; the scan may stop there."""
    p = points(spark, d).where("chart < 8 AND v > 20").limit(20)
    return p.agg((F.count("*") >= 20).alias("is_vector"))


def flow_only(spark, d):
    """Series pruning by configuration: the second kind of curve isn't read unless wanted."""
    kinds = table(spark, d, "events").withColumn("curve", F.when(F.col("event_type") == "purchase", F.lit("pressure")).otherwise(F.lit("flow")))
    return kinds.where("curve = 'flow'").groupBy("curve", "event_type").agg(F.count("*").alias("n"), rounded(F.sum("value"), 2).alias("total"))


GRID_SQL = """bound AS (SELECT chart, min(t) AS t0, max(t) AS t9 FROM curves GROUP BY chart
), probes AS (
  SELECT chart, i * CAST(0.02 AS DOUBLE) AS t FROM bound, unnest(range(0, CAST(floor(t9 / CAST(0.02 AS DOUBLE)) AS BIGINT) + 2)) AS r(i) WHERE i * CAST(0.02 AS DOUBLE) <= t9
  UNION SELECT chart, t9 FROM bound)"""

QUERIES = {f.__name__: f for f in (
    curve_metrics, curve_resample, curve_point_collapse, curve_clamp, axis_transform, printed_weight_calibration, grid_refit, axis_end_flag, session_threshold_stats,
    even_index_sample, fidelity_stats, accuracy_gate, mae_coverage, pooled_accuracy, two_level_error, yield_check, worst_signed_deviation, asof_outside_null, demo_score, report_summary, warning_list, has_vector_curves, flow_only,
)}

ORACLE_SQL = {
    "curve_metrics": f"WITH {CURVES_SQL}, {METRICS_SQL} SELECT * FROM metrics",
    "curve_resample": f"WITH {CURVES_SQL}, {GRID_SQL}, grid AS ({PROBE_SQL.format(curve='curves', out='v')}) SELECT chart, t, v FROM grid",
    "curve_point_collapse": f"WITH {POINTS_SQL} SELECT chart, floor(t * 1e1 + 5e-1) / 1e1 AS t, median(least(greatest(v, 0e0), 1e2)) AS v, count(*) AS vertices FROM points GROUP BY 1, 2",
    "curve_clamp": f"WITH {POINTS_SQL} SELECT chart, seq, least(greatest(t, 1e0), 9e0) AS t, least(greatest(v, 0e0), 1e2) AS v FROM points",
    "axis_transform": """SELECT l_orderkey, l_linenumber,
      floor(CASE WHEN l_linenumber % 5 = 0 THEN 0e0 ELSE least(greatest((l_quantity - 0e0) / 5e1 * 1e1, 0e0), 1e1) END * 1e4 + 5e-1) / 1e4 AS time_min,
      floor(least(greatest((9e1 - l_discount * 1e3) / 8e1 * 9e0, 0e0), 9e0) * 1e4 + 5e-1) / 1e4 AS value FROM lineitem""",
    "printed_weight_calibration": f"""WITH {CURVES_SQL}, {METRICS_SQL}, {WEIGHED_SQL}
      SELECT chart, floor(scale * 1e6 + 5e-1) / 1e6 AS scale, reason, floor(integral * scale * 1e3 + 5e-1) / 1e3 AS measured_kg,
        CASE WHEN printed > 0 THEN floor(integral / printed * 1e2 * 1e1 + 5e-1) / 1e1 END AS pct_of_printed,
        CASE WHEN printed > 0 THEN floor(integral * scale / printed * 1e4 + 5e-1) / 1e4 END AS yield_ratio FROM scaled""",
    "grid_refit": f"""WITH {CURVES_SQL}, {METRICS_SQL}, {WEIGHED_SQL}, {GRID_SQL}, grid AS ({PROBE_SQL.format(curve='curves', out='v')}),
      ga AS (SELECT chart, (v + lag(v) OVER w) / 2e0 * (t - lag(t) OVER w) AS a FROM grid WINDOW w AS (PARTITION BY chart ORDER BY t)),
      g AS (SELECT chart, sum(a) AS grid_area FROM ga GROUP BY chart),
      k AS (SELECT *, CASE WHEN grid_area > 0 THEN printed / grid_area END AS k0 FROM scaled JOIN g USING (chart)),
      n AS (SELECT *, coalesce(reason = 'applied' AND abs(k0 / scale - 1) <= 1e-3, false) AS refit FROM k)
      SELECT chart, floor(grid_area * 1e4 + 5e-1) / 1e4 AS grid_area, refit, floor(CASE WHEN refit THEN k0 ELSE scale END * 1e5 + 5e-1) / 1e5 AS k FROM n""",
    "axis_end_flag": f"WITH {CURVES_SQL}, {TAIL_SQL} SELECT * FROM flags",
    "session_threshold_stats": f"""WITH {CURVES_SQL} SELECT chart, max(v) AS peak, min(t) FILTER (v = top) AS peak_t,
      coalesce(max(t) FILTER (v >= 2e1) - min(t) FILTER (v >= 2e1), 0e0) AS duration, count(*) FILTER (v >= 2e1) AS points_above
      FROM (SELECT *, max(v) OVER (PARTITION BY chart) AS top FROM curves) GROUP BY chart""",
    "even_index_sample": f"""WITH {CURVES_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY chart ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY chart) AS n FROM curves),
      picks AS (SELECT DISTINCT chart, CASE WHEN n = 1 THEN 0 ELSE j * (n - 1) // (least(n, 30) - 1) END AS i FROM (SELECT DISTINCT chart, n FROM ranked), unnest(range(0, 30)) AS r(j) WHERE j < n)
      SELECT chart, t, v FROM ranked JOIN picks USING (chart, i)""",
    "fidelity_stats": f"WITH {FIDELITY_SQL} SELECT * FROM fidelity",
    "accuracy_gate": f"WITH {FIDELITY_SQL}, {GATE_SQL} SELECT chart, accuracy_pct, passed FROM judged",
    "mae_coverage": f"WITH {MAE_SQL} SELECT * FROM mae",
    "pooled_accuracy": f"""WITH {MAE_SQL} SELECT count(*) AS charts, floor(avg(mae) * 1e4 + 5e-1) / 1e4 AS mae_mean, floor(median(mae) * 1e4 + 5e-1) / 1e4 AS mae_median,
      floor(max(mae) * 1e4 + 5e-1) / 1e4 AS mae_max, floor(avg(coverage) * 1e4 + 5e-1) / 1e4 AS coverage_mean FROM mae""",
    "two_level_error": f"""WITH {FIDELITY_SQL} SELECT chart // 8 AS report, floor(avg(mean) * 1e4 + 5e-1) / 1e4 AS mean_of_means, floor(median(median) * 1e4 + 5e-1) / 1e4 AS median_of_medians,
      max(max) AS max_of_max, CAST(sum(n) AS BIGINT) AS n FROM fidelity GROUP BY 1""",
    "yield_check": f"""WITH {CURVES_SQL}, {METRICS_SQL}, {WEIGHED_SQL} SELECT floor(median(integral / printed) * 1e4 + 5e-1) / 1e4 AS median_ratio,
      count(*) FILTER (abs(integral / printed - 1) <= 1e-3) AS near, count(*) AS charts FROM scaled WHERE printed > 0""",
    "worst_signed_deviation": f"""WITH {CURVES_SQL}, {METRICS_SQL}, {WEIGHED_SQL}, m AS (SELECT chart, chart // 8 AS report, floor(integral / printed * 100 * 1e4 + 5e-1) / 1e4 AS milk FROM scaled WHERE printed > 0)
      SELECT report, arg_max(milk, (abs(milk - 100), -chart)) AS worst_milk_pct FROM m GROUP BY report""",
    "asof_outside_null": f"""WITH {CURVES_SQL}, spans AS (SELECT DISTINCT chart FROM curves), probes AS (SELECT chart, -1e0 + (11e0 - -1e0) * i / CAST(59 AS DOUBLE) AS t FROM spans, unnest(range(0, 60)) AS r(i))
      SELECT p.chart, p.t, CASE WHEN a.t = p.t THEN a.v WHEN a.t IS NULL OR b.t IS NULL THEN NULL WHEN a.t = b.t THEN a.v ELSE a.v + (b.v - a.v) * (p.t - a.t) / (b.t - a.t) END AS v
      FROM probes p ASOF LEFT JOIN curves a ON p.chart = a.chart AND p.t >= a.t ASOF LEFT JOIN curves b ON p.chart = b.chart AND p.t <= b.t""",
    "demo_score": f"""WITH {CURVES_SQL}, {OFF_SQL}, {probes_sql(200, '0e0').replace("FROM curves GROUP", "FROM curves WHERE chart % 10 <> 9 GROUP")},
      one AS ({PROBE_SQL.format(curve="curves", out="v")}), two AS ({PROBE_SQL.format(curve="off", out="w")}),
      e AS (SELECT one.chart, floor(avg(abs(v - w)) * 1e4 + 5e-1) / 1e4 AS mean_error, floor(max(abs(v - w)) * 1e4 + 5e-1) / 1e4 AS max_error FROM one JOIN two ON one.chart = two.chart AND one.t = two.t GROUP BY one.chart)
      SELECT chart, mean_error, max_error, floor(abs(a.peak - b.peak) * 1e4 + 5e-1) / 1e4 AS peak_error, abs(a.ends - b.ends) AS end_error
      FROM (SELECT chart, max(v) AS peak, max(t) AS ends FROM curves GROUP BY chart) a JOIN (SELECT chart, max(v) AS peak, max(t) AS ends FROM off GROUP BY chart) b USING (chart) JOIN e USING (chart)""",
    "report_summary": f"""WITH {FIDELITY_SQL}, {GATE_SQL}, {METRICS_SQL}, {WEIGHED_SQL}, {TAIL_SQL},
      m AS (SELECT s.*, s.chart // 8 AS report, j.accuracy_pct, f.reaches_axis_end, integral * scale AS measured,
        NOT f.reaches_axis_end AND printed IS NOT NULL AND printed > 0 AS complete FROM scaled s LEFT JOIN judged j USING (chart) JOIN flags f USING (chart)),
      l AS (SELECT report, count(*) AS charts, count(accuracy_pct) AS scored, list_sort(list(accuracy_pct) FILTER (accuracy_pct IS NOT NULL)) AS acc, min(accuracy_pct) AS accuracy_worst,
        count(*) FILTER (coalesce(accuracy_pct, 0) < 98) AS bad, list_sort(list(chart) FILTER (coalesce(accuracy_pct, 0) < 98)) AS bads,
        count(*) FILTER (reason = 'applied') AS calibrated, count(*) FILTER (reason = 'exceeds_pen_width') AS refused,
        coalesce(sum(measured) FILTER (complete), 0e0) / sum(printed) FILTER (complete) AS pct, list_sort(list(measured / printed) FILTER (printed > 0)) AS y FROM m GROUP BY report)
      SELECT report, charts, scored, floor(acc[len(acc) // 2 + 1] * 1e2 + 5e-1) / 1e2 AS accuracy_median, accuracy_worst, CASE WHEN scored > 0 THEN bad ELSE 0 END AS below_gate,
        CASE WHEN scored > 0 THEN coalesce(array_to_string(bads, ','), '') ELSE '' END AS failing, calibrated, refused, floor(pct * 100 * 1e2 + 5e-1) / 1e2 AS milk_pct_complete,
        floor(y[len(y) // 2 + 1] * 1e4 + 5e-1) / 1e4 AS yield_median FROM l""",
    "warning_list": f"""WITH {CURVES_SQL}, {METRICS_SQL}, {WEIGHED_SQL} SELECT chart, 'Page ' || (chart // 8 + 1) || ' Chart ' || (chart % 8 + 1) AS label,
      concat_ws('; ', CASE WHEN points < 60 THEN 'few points' END, CASE WHEN reason = 'exceeds_pen_width' THEN 'weight beyond pen width' END, CASE WHEN printed IS NULL THEN 'no printed weight' END) AS warnings
      FROM scaled WHERE points < 60 OR reason = 'exceeds_pen_width' OR printed IS NULL""",
    "has_vector_curves": "SELECT count(*) >= 20 AS is_vector FROM events WHERE user_id < 8 AND value > 20",
    "flow_only": "SELECT 'flow' AS curve, event_type, count(*) AS n, floor(sum(value) * 1e2 + 5e-1) / 1e2 AS total FROM events WHERE event_type <> 'purchase' GROUP BY event_type",
}
