"""Queries on page geometry and axis calibration, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from seriesforge.functions import scalars
from seriesforge.functions.scalars import rounded
from seriesforge.operators import calibration, geometry, runs
from seriesforge.sources.tables import POINTS_SQL, points, table

ORDER = ["l_orderkey"]


def tick_calibration(spark, d):
    fit = calibration.fit(table(spark, d, "lineitem"), ORDER, "l_extendedprice", "l_linenumber")
    return fit.select("l_orderkey", rounded(F.col("slope"), 9).alias("slope"), rounded(F.col("intercept"), 5).alias("intercept"), "n")


def tick_residual(spark, d):
    fit = calibration.fit(table(spark, d, "lineitem"), ORDER, "l_extendedprice", "l_linenumber")
    return fit.select("l_orderkey", rounded(F.col("residual"), 5).alias("residual"))


def tick_range(spark, d):
    return calibration.value_range(table(spark, d, "lineitem"), ORDER, "l_quantity")


def leftmost_column(spark, d):
    return calibration.leftmost(table(spark, d, "lineitem"), ORDER, "l_quantity").select("l_orderkey", "l_linenumber", "l_quantity")


def first_tick_of_each_value(spark, d):
    rows = table(spark, d, "lineitem").withColumn("tick", (F.col("l_quantity") % 10).cast("int"))
    return calibration.first_of_each(rows, ORDER, "tick", "l_linenumber").select("l_orderkey", "tick", "l_linenumber")


def tick_pitch(spark, d):
    return calibration.pitch(table(spark, d, "lineitem"), ORDER, "l_linenumber", least=3, tolerance=0.25)


def frame_median(spark, d):
    rows = table(spark, d, "lineitem").withColumn("x1", F.col("l_quantity") + F.col("l_extendedprice"))
    return calibration.frame(rows, ORDER, "l_quantity", "x1")


def label_row_pick(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))), lambda s: s["q"]).alias("numbers"), F.max("l_extendedprice").alias("y")
    )
    rows = rows.where(calibration.is_label_row(F.col("numbers"), F.col("y"), least=2))
    return calibration.lowest(rows, ORDER, "y", "l_returnflag").select("l_orderkey", "l_returnflag", "y")


def x_anchor(spark, d):
    """Anchors by ticks, else grid lines, else labels."""
    line = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("a"), F.max("l_quantity").alias("b"), F.min("l_linenumber").alias("c"), F.count("*").alias("n"))
    span = lambda left, right: F.struct(left.cast("double").alias("left"), right.cast("double").alias("right"))
    ticks = F.when(F.col("n") >= 3, span(F.col("a"), F.col("b")))
    lines = F.when(F.col("n") >= 2, span(F.col("a") - 10, F.col("b") + 10))
    labels = F.when(F.col("a") > 5, span(F.lit(0), F.col("b")))
    anchor, source = calibration.x_anchor(ticks, lines, labels)
    return line.select("l_orderkey", anchor["left"].alias("x_left"), anchor["right"].alias("x_right"), source.alias("x_source"))


def heads(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 10).alias("y"))
    return geometry.reading_order(part, "p_brand", "x", "y", "p_partkey", 25.0)


def reading_order(spark, d):
    return heads(spark, d).select("p_partkey", "p_brand", "row_top", "chart")


def row_extent(spark, d):
    return geometry.row_extent(heads(spark, d), "p_brand", 841.92)


def eight_charts_a_page(spark, d):
    return heads(spark, d).where("chart < 8").select("p_partkey", "p_brand", "chart")


def window_text_join(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 100.0).alias("y0"))
    text = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", "c_acctbal")
    held = geometry.inside(nation, text, ["n_nationkey"], F.col("c_acctbal").between(F.col("y0"), F.col("y0") + 3000.0))
    return held.groupBy("n_nationkey").agg(F.count("*").alias("blocks"), F.min("c_custkey").alias("first_block"), F.max("c_custkey").alias("last_block"))


def vertex_in_plot_join(spark, d):
    p = points(spark, d)
    box = p.groupBy("chart").agg((F.min("t") + 1).alias("x0"), (F.max("t") - 2).alias("x1"), F.lit(10.0).alias("y0"), F.lit(80.0).alias("y1"))
    c = F.col
    return geometry.inside(box, p, ["chart"], scalars.in_plot(c("t"), c("v"), c("x0"), c("x1"), c("y0"), c("y1"))).select("chart", "seq", "t", "v")


def half_open_window(spark, d):
    """Positions in a window that is half open in x and closed in y."""
    rows = table(spark, d, "lineitem")
    c, lit = F.col, F.lit
    hit = scalars.in_window(c("l_quantity"), c("l_discount"), lit(10.0), lit(20.0), lit(0.02), lit(0.05))
    return rows.where(hit).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


def rescaled(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", *[F.least(F.greatest(F.element_at("embedding", k + 1).cast("double") * 2.0 + 0.5, F.lit(0.0)), F.lit(1.0)).alias(n) for k, n in enumerate("rgb")])


def colour_classify(spark, d):
    r, g, b = (F.col(n) for n in "rgb")
    near = scalars.is_near((r, g, b), (0.5, 0.5, 0.5))
    return rescaled(spark, d).select("vec_id", scalars.is_blue(r, g, b).alias("blue"), scalars.is_green(r, g, b).alias("green"), near.alias("near_grey"))


def colour_unpack(spark, d):
    packed = (F.col("o_custkey") * 7919 % 16777216).cast("int")
    r, g, b = scalars.channels(packed)
    o = table(spark, d, "orders").select("o_orderkey", r.alias("r"), g.alias("g"), b.alias("b"))
    r, g, b = (F.col(n) for n in "rgb")
    return o.select(
        "o_orderkey", "r", "g", "b", scalars.blue_pixel(r, g, b).alias("blue_pixel"), scalars.green_pixel(r, g, b).alias("green_pixel"),
        scalars.plain_blue(r, g, b).alias("blue_plain"), scalars.plain_green(r, g, b).alias("green_plain"),
    )


def tick_strokes(spark, d):
    """Short upright dark strokes near a base line."""
    c = F.col
    rows = table(spark, d, "lineitem")
    keep = (c("l_tax") <= 0.05) & (F.abs(c("l_discount") - 0.05) < 0.03) & (c("l_quantity") > 0.4) & (c("l_quantity") < 7) & (c("l_linenumber") >= 1) & (c("l_linenumber") <= 4)
    return rows.where(keep).groupBy("l_orderkey").agg(F.countDistinct("l_quantity").cast("long").alias("ticks"))


def run_points(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("y"))


def run_probe(spark, d):
    return runs.last_run(run_points(spark, d), ["k"], "y").select("k", rounded(F.col("middle"), 4).alias("middle"), "runs")


def day_cells(spark, d):
    day = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date"))
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("k"), day.alias("y"), F.col("l_quantity").alias("q"))


def run_opening(spark, d):
    return runs.opened(day_cells(spark, d), ["k"], "y", 3).groupBy("k").agg(F.count("*").alias("cells"), F.min("y").alias("low"), F.max("y").alias("high"))


def projection_sums(spark, d):
    return runs.projection(day_cells(spark, d).withColumn("month", F.floor(F.col("y") / 30)), ["k"], "month", "q")


def curve_coverage(spark, d):
    """Charts whose points span at least a tenth of the axis."""
    p = points(spark, d).groupBy("chart").agg(F.max("t").alias("b"), F.min("t").alias("a"), F.count("*").alias("n"))
    return p.where(((F.col("b") - F.col("a")) / 10.0 >= 0.1) & (F.col("n") >= 5)).select("chart", ((F.col("b") - F.col("a")) / 10.0).alias("coverage"))


def column_median(spark, d):
    """Per column the median row, cut to a whole number."""
    cells = day_cells(spark, d)
    return cells.groupBy("k").agg(F.median("y").cast("int").alias("row"), F.count("*").alias("n"))


def pad_grid(spark, d):
    rows = table(spark, d, "nation").withColumn("slot", (F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).cast("int"))
    rows = rows.select(F.col("n_regionkey").alias("r_regionkey"), "slot", "n_name")
    return geometry.padded(rows, table(spark, d, "region"), ["r_regionkey"], 8)


QUERIES = {f.__name__: f for f in (
    tick_calibration, tick_residual, tick_range, leftmost_column, first_tick_of_each_value, tick_pitch, frame_median, label_row_pick, x_anchor, reading_order, row_extent, eight_charts_a_page,
    window_text_join, vertex_in_plot_join, half_open_window, colour_classify, colour_unpack, tick_strokes, run_probe, run_opening, projection_sums, curve_coverage, column_median, pad_grid,
)}

FIT_SQL = """fit AS (
  SELECT l_orderkey, regr_slope(l_linenumber, l_extendedprice) AS slope, regr_intercept(l_linenumber, l_extendedprice) AS intercept, count(*) AS n
  FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) >= 3 AND regr_slope(l_linenumber, l_extendedprice) IS NOT NULL)"""
HEADS_SQL = """tops AS (SELECT p_partkey, p_brand, CAST(p_size AS DOUBLE) AS x, round_even(p_retailprice / 10 / 2e1, 0) * 2e1 AS row_top FROM part),
heads AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY row_top, x > 25, p_partkey) - 1 AS INTEGER) AS chart FROM tops)"""
DAYS_SQL = "cells AS (SELECT l_suppkey % 50 AS k, CAST(datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS y, l_quantity AS q FROM lineitem)"
RGB_SQL = "c AS (SELECT vec_id, least(greatest(CAST(embedding[1] AS DOUBLE) * 2e0 + 5e-1, 0e0), 1e0) AS r, least(greatest(CAST(embedding[2] AS DOUBLE) * 2e0 + 5e-1, 0e0), 1e0) AS g, least(greatest(CAST(embedding[3] AS DOUBLE) * 2e0 + 5e-1, 0e0), 1e0) AS b FROM embeddings)"

ORACLE_SQL = {
    "tick_calibration": f"WITH {FIT_SQL} SELECT l_orderkey, floor(slope * 1e9 + 5e-1) / 1e9 AS slope, floor(intercept * 1e5 + 5e-1) / 1e5 AS intercept, n FROM fit",
    "tick_residual": f"WITH {FIT_SQL} SELECT l_orderkey, floor(max(abs(slope * l_extendedprice + intercept - l_linenumber)) * 1e5 + 5e-1) / 1e5 AS residual FROM fit JOIN lineitem USING (l_orderkey) GROUP BY l_orderkey",
    "tick_range": "SELECT l_orderkey, min(l_quantity) AS v_bottom, max(l_quantity) AS v_top, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3",
    "leftmost_column": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY l_quantity - min(l_quantity) OVER (PARTITION BY l_orderkey) < 6",
    "first_tick_of_each_value": "SELECT l_orderkey, CAST(l_quantity % 10 AS INTEGER) AS tick, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2",
    "tick_pitch": """WITH x AS (SELECT DISTINCT l_orderkey, floor(l_linenumber * 1e2 + 5e-1) / 1e2 AS x FROM lineitem), g AS (SELECT *, x - lag(x) OVER (PARTITION BY l_orderkey ORDER BY x) AS gap FROM x),
      m AS (SELECT *, median(gap) OVER (PARTITION BY l_orderkey) AS middle FROM g)
      SELECT l_orderkey, min(x) AS x_first, max(x) AS x_last, count(*) AS n, any_value(middle) AS pitch FROM m GROUP BY l_orderkey HAVING count(*) >= 3 AND any_value(middle) > 0 AND max(abs(gap - middle)) <= any_value(middle) * 25e-2""",
    "frame_median": "SELECT l_orderkey, median(l_quantity) AS x_left, median(l_quantity + l_extendedprice) AS x_right, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3",
    "label_row_pick": """WITH g AS (SELECT l_orderkey, l_returnflag, list(CAST(l_quantity AS INTEGER) ORDER BY l_linenumber, CAST(l_quantity AS INTEGER)) AS a, max(l_extendedprice) AS y FROM lineitem GROUP BY ALL)
      SELECT l_orderkey, l_returnflag, y FROM g WHERE y >= 100 AND len(a) >= 2 AND len(list_filter(range(1, len(a)), lambda i: a[i] >= a[i + 1])) = 0
      QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY y DESC, l_returnflag) = 1""",
    "x_anchor": """WITH l AS (SELECT l_orderkey, min(l_quantity) AS a, max(l_quantity) AS b, count(*) AS n FROM lineitem GROUP BY l_orderkey), s AS (
      SELECT *, CASE WHEN n >= 3 AND b - a > 40 THEN 'ticks' WHEN n >= 2 AND b + 10 - (a - 10) > 40 THEN 'grid' WHEN a > 5 THEN 'labels' END AS x_source FROM l)
      SELECT l_orderkey, CASE x_source WHEN 'ticks' THEN a WHEN 'grid' THEN a - 10 WHEN 'labels' THEN 0e0 END AS x_left, CASE x_source WHEN 'ticks' THEN b WHEN 'grid' THEN b + 10 WHEN 'labels' THEN b END AS x_right, x_source FROM s""",
    "reading_order": f"WITH {HEADS_SQL} SELECT p_partkey, p_brand, row_top, chart FROM heads",
    "row_extent": f"WITH {HEADS_SQL}, r AS (SELECT DISTINCT p_brand, row_top FROM heads) SELECT p_brand, row_top, coalesce(lead(row_top) OVER (PARTITION BY p_brand ORDER BY row_top) - 6e0, CAST(841.92 AS DOUBLE)) AS row_bottom FROM r",
    "eight_charts_a_page": f"WITH {HEADS_SQL} SELECT p_partkey, p_brand, chart FROM heads WHERE chart < 8",
    "window_text_join": """SELECT n_nationkey, count(*) AS blocks, min(c_custkey) AS first_block, max(c_custkey) AS last_block FROM nation JOIN customer ON c_nationkey = n_nationkey
      AND c_acctbal BETWEEN n_nationkey * 1e2 AND n_nationkey * 1e2 + 3e3 GROUP BY n_nationkey""",
    "vertex_in_plot_join": f"""WITH {POINTS_SQL}, box AS (SELECT chart, min(t) + 1 AS x0, max(t) - 2 AS x1 FROM points GROUP BY chart)
      SELECT chart, seq, t, v FROM points JOIN box USING (chart) WHERE t >= x0 AND t <= x1 + 1e0 AND v >= 10 AND v <= 82""",
    "half_open_window": "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_discount >= 2e-2 AND l_discount <= 5e-2",
    "colour_classify": f"""WITH {RGB_SQL} SELECT vec_id, b > 55e-2 AND r < 45e-2 AND g < 45e-2 AND b - r > 5e-1 AS blue, g > 35e-2 AND r < 45e-2 AND b < 45e-2 AND g - r > 5e-1 AS green,
      abs(r - 5e-1) <= 12e-2 AND abs(g - 5e-1) <= 12e-2 AND abs(b - 5e-1) <= 12e-2 AS near_grey FROM c""",
    "colour_unpack": """WITH p AS (SELECT o_orderkey, CAST(o_custkey * 7919 % 16777216 AS INTEGER) AS c FROM orders), q AS (SELECT o_orderkey, (c >> 16) & 255 AS r, (c >> 8) & 255 AS g, c & 255 AS b FROM p),
      m AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM q),
      h AS (SELECT *, CASE WHEN v = 0 THEN 0e0 ELSE d * 255e0 / v END AS s, CASE WHEN d = 0 THEN 0e0 WHEN v = r THEN 6e1 * (g - b) / d WHEN v = g THEN 12e1 + 6e1 * (b - r) / d ELSE 24e1 + 6e1 * (r - g) / d END AS h0 FROM m),
      z AS (SELECT *, CASE WHEN h0 < 0 THEN h0 + 36e1 ELSE h0 END / 2e0 AS hue FROM h)
      SELECT o_orderkey, r, g, b, hue BETWEEN 95 AND 135 AND s >= 60 AND v >= 60 AS blue_pixel, hue BETWEEN 40 AND 90 AND s >= 40 AND v >= 40 AS green_pixel, b > 150 AND r < 90 AND g < 90 AS blue_plain, g > 90 AND r < 90 AND b < 90 AS green_plain FROM z""",
    "tick_strokes": "SELECT l_orderkey, count(DISTINCT l_quantity) AS ticks FROM lineitem WHERE l_tax <= 5e-2 AND abs(l_discount - 5e-2) < 3e-2 AND l_quantity > 4e-1 AND l_quantity < 7 AND l_linenumber BETWEEN 1 AND 4 GROUP BY l_orderkey",
    "run_probe": """WITH p AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS y FROM lineitem), s AS (SELECT *, CASE WHEN y - lag(y) OVER w <= 2 THEN 0 ELSE 1 END AS f FROM p WINDOW w AS (PARTITION BY k ORDER BY y)),
      r AS (SELECT k, y, sum(f) OVER (PARTITION BY k ORDER BY y) AS run FROM s), m AS (SELECT k, run, avg(y) AS middle FROM r GROUP BY k, run)
      SELECT k, floor(arg_max(middle, run) * 1e4 + 5e-1) / 1e4 AS middle, count(*) AS runs FROM m GROUP BY k""",
    "run_opening": f"""WITH {DAYS_SQL}, p AS (SELECT DISTINCT k, y FROM cells), s AS (SELECT *, y - row_number() OVER (PARTITION BY k ORDER BY y) AS run FROM p),
      n AS (SELECT *, count(*) OVER (PARTITION BY k, run) AS n FROM s) SELECT k, count(*) AS cells, min(y) AS low, max(y) AS high FROM n WHERE n >= 3 GROUP BY k""",
    "projection_sums": f"""WITH {DAYS_SQL}, s AS (SELECT k, CAST(floor(y / CAST(30 AS DOUBLE)) AS BIGINT) AS month, sum(q) AS total FROM cells GROUP BY 1, 2)
      SELECT k, month, total, total >= 3e-1 * max(total) OVER (PARTITION BY k) AS strong FROM s""",
    "curve_coverage": f"WITH {POINTS_SQL} SELECT chart, (max(t) - min(t)) / 1e1 AS coverage FROM points GROUP BY chart HAVING (max(t) - min(t)) / 1e1 >= 1e-1 AND count(*) >= 5",
    "column_median": f"WITH {DAYS_SQL} SELECT k, CAST(floor(median(y)) AS INTEGER) AS row, count(*) AS n FROM cells GROUP BY k",
    "pad_grid": """WITH n AS (SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS slot, n_name FROM nation)
      SELECT r_regionkey, CAST(g.slot AS INTEGER) AS slot, n_name FROM region, unnest(range(0, 8)) AS g(slot) LEFT JOIN n ON n_regionkey = r_regionkey AND n.slot = g.slot""",
}
