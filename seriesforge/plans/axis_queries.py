"""Queries on coloured axes, plot boxes, merged header blocks and strict header fields, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesforge.functions.scalars import in_closed_window, rounded, strict_fields
from seriesforge.operators import calibration, geometry
from seriesforge.plans.record_queries import headers
from seriesforge.sources.tables import table

#: An axis colour of the stand-in spans, packed and as fractions.
AMBER, AMBER_RGB = 0xE08A00, (0.88, 0.54, 0.0)


def closed_window(spark, d):
    """Positions in a window that is closed on all sides."""
    hit = in_closed_window(F.col("l_quantity"), F.col("l_discount"), F.lit(10.0), F.lit(20.0), F.lit(0.02), F.lit(0.05))
    return table(spark, d, "lineitem").where(hit).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


def coloured_axis(spark, d):
    """Of each supplier the axis that its amber labels give; every second line is printed in blue."""
    spans = table(spark, d, "lineitem").select(
        "l_suppkey",
        F.format_string(" %d ", F.floor("l_quantity").cast("int")).alias("text"),
        F.when(F.col("l_linenumber") % 2 == 0, F.lit(AMBER)).otherwise(F.lit(0x0000FF)).alias("color"),
        F.col("l_discount").alias("x"),
        F.col("l_extendedprice").alias("y"),
        F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("seq"),
    )
    box = tuple(F.lit(v) for v in (0.02, 0.08, 1000.0, 80000.0))
    made = calibration.colour_fit(spans, ["l_suppkey"], box, AMBER_RGB, "seq")
    return made.select("l_suppkey", rounded(F.col("slope"), 9).alias("slope"), rounded(F.col("intercept"), 5).alias("intercept"), "n", rounded(F.col("residual"), 5).alias("residual"))


def box_fractions(spark, d):
    """Plot boxes of windows made of parts, some of them flat or without known values."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    part = table(spark, d, "part").select("p_partkey", size.alias("x0"), (size + 250.0).alias("x1"), (k % 300).cast("double").alias("y0"))
    part = part.withColumns({"y1": F.col("y0") + (k % 5) * 50.0, "slope": (k % 4) / F.lit(-16.0), "intercept": F.col("y0") / 16.0 + 9.0})
    window, labels = (F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1")), (F.col("x0") + k % 7, F.col("x1") - 8.0 + k % 11)
    bottom, top = F.when(k % 6 != 0, (k % 3).cast("double")), F.when(k % 10 != 0, (k % 8 + 5).cast("double"))
    box = calibration.box_fractions(window, labels, F.col("slope"), F.col("intercept"), bottom, top)
    return part.select("p_partkey", box.alias("box")).where("box is not null").select("p_partkey", "box.*")


def header_merge(spark, d):
    """Blocks of a page with the next two, where they are close."""
    part = table(spark, d, "part").select("p_partkey", "p_brand", (F.col("p_size") * 5.0).alias("y"), "p_name")
    return geometry.merged_ahead(part, "p_brand", "p_partkey", "y", "p_name").select("p_partkey", "merged")


def strict_header_parse(spark, d):
    """Headers that print animal, date, time and weight in the report's own form."""
    made = headers(spark, d).select("o_orderkey", *[c.alias(n) for n, c in strict_fields(F.col("text")).items()])
    return made.dropna(subset=["animal_id", "date_iso", "time_full", "milk_kg"])


QUERIES = {f.__name__: f for f in (closed_window, coloured_axis, box_fractions, header_merge, strict_header_parse)}

ORACLE_SQL = {
    "closed_window": """SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
      WHERE l_quantity >= 10 AND l_quantity <= 20 AND l_discount >= 2e-2 AND l_discount <= 5e-2""",
    "coloured_axis": """WITH t AS (SELECT l_suppkey, floor(l_quantity) AS v, l_extendedprice AS y FROM lineitem
        WHERE l_linenumber % 2 = 0 AND l_discount >= 2e-2 AND l_discount <= 8e-2 AND l_extendedprice >= 1000 AND l_extendedprice <= 80000
        QUALIFY row_number() OVER (PARTITION BY l_suppkey, floor(l_quantity) ORDER BY l_orderkey, l_linenumber, l_extendedprice) = 1),
      f AS (SELECT l_suppkey, regr_slope(v, y) AS slope, regr_intercept(v, y) AS intercept, count(*) AS n FROM t GROUP BY l_suppkey HAVING count(*) >= 3)
      SELECT l_suppkey, floor(any_value(slope) * 1e9 + 5e-1) / 1e9 AS slope, floor(any_value(intercept) * 1e5 + 5e-1) / 1e5 AS intercept, any_value(n) AS n,
        floor(max(abs(slope * y + intercept - v)) * 1e5 + 5e-1) / 1e5 AS residual FROM t JOIN f USING (l_suppkey) GROUP BY l_suppkey""",
    "box_fractions": """WITH p AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS x0, p_size + 250e0 AS x1, CAST(p_partkey % 300 AS DOUBLE) AS y0 FROM part),
      q AS (SELECT k, least(x0, x0 + k % 7 - 4e0) AS a, greatest(x1, x1 - 8e0 + k % 11 + 4e0) AS b, x0 + k % 7 AS l, x1 - 8e0 + k % 11 AS r, y0, (k % 5) * 50e0 AS tall,
        (k % 4) / -16e0 AS slope, y0 / 16e0 + 9e0 AS intercept, CASE WHEN k % 6 <> 0 THEN CAST(k % 3 AS DOUBLE) ELSE 0e0 END AS v_bottom,
        CASE WHEN k % 10 <> 0 THEN CAST(k % 8 + 5 AS DOUBLE) ELSE 9e0 END AS v_top FROM p)
      SELECT k AS p_partkey, floor((l - a) / (b - a) * 1e6 + 5e-1) / 1e6 AS "left", floor((r - a) / (b - a) * 1e6 + 5e-1) / 1e6 AS "right",
        floor(((v_top - intercept) / slope - y0) / tall * 1e6 + 5e-1) / 1e6 AS top, floor(((v_bottom - intercept) / slope - y0) / tall * 1e6 + 5e-1) / 1e6 AS bottom, v_top, v_bottom
      FROM q WHERE tall > 0 AND slope <> 0""",
    "header_merge": """SELECT p_partkey, concat_ws(' ', p_name, CASE WHEN abs(lead(p_size, 1) OVER w - p_size) * 5 < 20 THEN lead(p_name, 1) OVER w END,
      CASE WHEN abs(lead(p_size, 2) OVER w - p_size) * 5 < 20 THEN lead(p_name, 2) OVER w END) AS merged FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)""",
    "strict_header_parse": """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS animal_id, strftime(o_orderdate, '%Y-%m-%d') AS date_iso, strftime(o_orderdate, '%d.%m.%Y') AS date_printed,
        CAST(o_custkey % 24 AS VARCHAR) || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || ':05' AS time_full,
        CAST(CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) || '.' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS DOUBLE) AS milk_kg,
        '07010142' AS farm, '0' || CAST(o_orderkey % 1000 AS VARCHAR) AS gnr, '1' AS bimo, '0' AS le
      FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 3 = 0 AND o_custkey % 24 >= 10 AND (o_orderkey % 7 = 0 OR o_orderkey % 23 <> 0)""",
}
