"""Queries on order statistics, accuracy reports, header lines, near times, names and pixel curves, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesforge.functions.scalars import accepted_upload, header_fields, rounded, strict_fields
from seriesforge.operators import geometry, matching, quality, runs, selection, series
from seriesforge.plans import axis_queries, record_queries
from seriesforge.plans.record_queries import SESSIONS_SQL, headers, sessions
from seriesforge.plans.series_queries import KEY, MAE_SQL, METRICS_SQL, OFF_SQL, PROBE_SQL, curves, mae, off
from seriesforge.sources.tables import CURVES_SQL, POINTS_SQL, points, table


def upper_median(spark, d):
    """Upper median and median of the prices, for each part's brand and over all."""
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    keys = ["l_returnflag", "l_linestatus"]
    whole = rows.withColumns({"l_returnflag": F.lit("all"), "l_linestatus": F.lit(None).cast("string")})
    both = rows.unionByName(whole)
    found = selection.selected(both, keys, "l_extendedprice", {"lower": selection.lower, "upper": selection.upper, "tenth": lambda n: F.lit(10)})
    return found.withColumn("l_linestatus", F.coalesce("l_linestatus", F.lit("")))


def accuracy_report(spark, d):
    """Errors of two curves of every chart in three data sets; some charts have no file, some no second curve."""
    m, chart = mae(spark, d), F.col("chart")
    flow = m.select((chart % 3).cast("string").alias("dataset"), "chart", F.lit("flow").alias("curve"), (chart % 13 != 0).alias("found"), "mae", "coverage")
    second = flow.withColumns({"curve": F.lit("pressure"), "mae": F.when(chart % 5 != 0, F.col("mae") * 2), "coverage": F.when(chart % 5 != 0, F.col("coverage")).otherwise(0.0)})
    return quality.accuracy_report(flow.unionByName(second))


def header_line_scan(spark, d):
    """Pages of header lines made of a customer's orders, read line by line."""
    key = F.col("o_orderkey")
    second = F.when(key % 4 == 0, F.lit("Animale: 7 again")).otherwise(F.concat(F.lit("Data: "), F.date_format("o_orderdate", "d.M.yy")))
    third = F.when(key % 5 == 0, F.lit("no time")).otherwise(F.concat(F.lit("Ora: "), key % 24, F.lit(":"), F.lpad((key % 60).cast("string"), 2, "0")))
    lines = F.concat_ws("\n", F.concat(F.when(key % 6 == 0, F.lit("header ")).otherwise(F.lit("Animale: ")), key), second, third, F.when(key % 3 == 0, F.lit("")))
    pages = table(spark, d, "orders").select("o_custkey", F.struct(key.alias("k"), lines.alias("s")).alias("l"))
    pages = pages.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda l: l["s"]), "\n").alias("text"))
    return pages.select("o_custkey", F.posexplode(matching.header_lines(F.col("text"))).alias("chart", "h")).select("o_custkey", "chart", "h.*")


def anchored_collapse(spark, d):
    """Points in chains of near times: each a third of the tolerance after the one before."""
    p = points(spark, d).withColumn("t", rounded(F.col("t"), 1) + (F.col("seq") % 7) * F.lit(0.0004))
    return series.collapse_anchored(p, KEY, 0.001, 6)


def two_curves_at_probes(spark, d):
    """Two versions of each curve at times that are asked twice."""
    c = curves(spark, d)
    probes = c.select("chart", "t").where("t <= 5")
    return series.both_at_times(c, off(c), probes.unionByName(probes), KEY)


def session_prefix_match(spark, d):
    """For each order the file whose name starts with its customer and day."""
    files = sessions(spark, d).select(F.col("csv_name").alias("file"))
    key = F.col("o_orderkey")
    wanted = sessions(spark, d).select("o_orderkey", F.concat(F.lit("animal_"), "o_custkey", F.lit("_"), F.when(key % 10 == 9, F.lit("1999")).otherwise(F.col("day"))).alias("prefix"), F.lpad((key % 2400).cast("string"), 4, "0").alias("hhmm"))
    return matching.session_file(wanted, files, ["o_orderkey"], "prefix", "hhmm").select("o_orderkey", "file", "matches", "priority")


def pixel_curves(spark, d):
    """Pixels of each supplier's lines as curves, pinned to the corners of the plot."""
    pixels = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 290 + 3).alias("x"), F.floor(F.col("l_quantity") * 2 + F.col("l_suppkey") % 3).alias("y"))
    boxes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(10.0).alias("left"), (F.lit(310.0) + F.col("s_suppkey") % 5).alias("right"), F.lit(5.0).alias("top"), (F.lit(55.0) + F.col("s_suppkey") % 60).alias("bottom"))
    return runs.pixels_to_curve(pixels, boxes, ["l_suppkey"], 10.0, 9.0, 120, anchor_end=True)


def metadata_check(spark, d):
    """What headers were read as against what they print in the report's own form."""
    texts = headers(spark, d)
    pick = lambda fields: texts.select("o_orderkey", *[c.alias(n) for n, c in fields.items()])
    found = matching.metadata_check(pick(header_fields(F.col("text"))), pick(strict_fields(F.col("text"))), ["o_orderkey"], "o_orderkey")
    return found.withColumn("differs", F.concat_ws(",", "differs"))


def session_scores(spark, d):
    """Curves against a version that is a little off, and areas against a weight that isn't always printed."""
    c = curves(spark, d)
    m = series.metrics(c, KEY)
    stated = m.select("chart", F.when(F.col("chart") % 6 == 0, F.lit(0.0)).otherwise(F.col("integral")).alias("milk_kg"))
    return quality.session_scores(c, off(c).where("t <= 8"), stated, KEY)


def session_stats(spark, d):
    """Peak, duration and yield of flow, and mean pressure, of each user's purchases and other events."""
    e = points(spark, d).join(table(spark, d, "events").select(F.col("event_id").alias("seq"), "event_type"), "seq")
    kind = F.when(F.col("event_type") == "purchase", F.lit("pressure")).otherwise(F.lit("flow"))
    c = series.collapse(e.withColumn("curve", kind).where("chart % 9 <> 0 OR curve = 'flow'"), ["chart", "curve"], low=0.0, high=100.0)
    return series.session_stats(c, KEY, "flow", "pressure", 20.0)


def page_windows(spark, d):
    """Chart windows of pages made of brands: header rows from prices, and pages of few rows as a grid."""
    part = table(spark, d, "part").select(F.col("p_brand").alias("page"), (F.col("p_retailprice") / 2.5).alias("y"), "p_partkey", "p_size")
    heads = part.where(F.when(F.length("page") % 2 == 0, F.col("p_partkey") % 40 == 0).otherwise(F.col("p_size") < 45))
    pages = part.groupBy("page").agg((F.lit(1200) + F.max("p_size")).alias("width"), F.lit(1754).alias("height"), F.lit(841.92).alias("points"), F.lit(150 / 72.0).alias("scale"))
    return geometry.page_windows(heads, pages, "y")


def accepted_uploads(spark, d):
    """Files by whether their names' endings are those of reports."""
    key = F.col("o_orderkey")
    endings = ("pdf", "PNG", "jpeg", "tar.gz", "pdf.exe", "Jpg")
    end = F.element_at(F.array(*map(F.lit, endings)), (key % 6 + 1).cast("int"))
    name = F.when(key % 11 == 0, F.concat(F.lit("."), end)).when(key % 13 == 0, None).otherwise(F.concat(F.lit("in.d/r"), key, F.lit("."), end))
    return table(spark, d, "orders").select(name.alias("name")).groupBy(accepted_upload(F.col("name")).alias("accepted")).agg(F.count("*").alias("n"), F.max("name").alias("last"))


QUERIES = {f.__name__: f for f in (metadata_check, session_scores, session_stats, page_windows, accepted_uploads, upper_median, accuracy_report, header_line_scan, anchored_collapse, two_curves_at_probes, session_prefix_match, pixel_curves)}

LEVELS_SQL = ", ".join(
    f"""{n} AS (SELECT '{n}' AS level, {d} AS dataset, {c} AS chart, curve, count(*) AS charts, count(*) FILTER (found) AS found, count(mae) FILTER (found) AS detected,
      floor(avg(mae) FILTER (found) * 1e4 + 5e-1) / 1e4 AS mae_mean, floor(max(mae) FILTER (found) * 1e4 + 5e-1) / 1e4 AS mae_max, floor(avg(coverage) FILTER (found) * 1e4 + 5e-1) / 1e4 AS coverage_mean,
      floor(median(mae) FILTER (found) * 1e4 + 5e-1) / 1e4 AS mae_median FROM both_curves GROUP BY ALL)"""
    for n, d, c in (("chart", "dataset", "CAST(chart AS VARCHAR)"), ("dataset", "dataset", "NULL"), ("all", "NULL", "NULL"))
).replace("all AS", "every AS")

ORACLE_SQL = {
    "upper_median": """WITH rows AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS x FROM lineitem UNION ALL SELECT 'all', '', l_extendedprice FROM lineitem),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM rows)
      SELECT l_returnflag, l_linestatus, max(x) FILTER (i = (n - 1) // 2) AS lower, max(x) FILTER (i = n // 2) AS upper, max(x) FILTER (i = 10) AS tenth FROM ranked GROUP BY 1, 2""",
    "accuracy_report": f"""WITH {MAE_SQL}, flow AS (SELECT CAST(chart % 3 AS VARCHAR) AS dataset, chart, 'flow' AS curve, chart % 13 <> 0 AS found, mae, coverage FROM mae),
      both_curves AS (SELECT * FROM flow UNION ALL SELECT dataset, chart, 'pressure', found, CASE WHEN chart % 5 <> 0 THEN mae * 2 END, CASE WHEN chart % 5 <> 0 THEN coverage ELSE 0 END FROM flow), {LEVELS_SQL}
      SELECT * FROM chart UNION ALL SELECT * FROM dataset UNION ALL SELECT * FROM every""",
    "header_line_scan": r"""WITH RECURSIVE lines AS (SELECT o_custkey, string_split(string_agg(CASE WHEN o_orderkey % 6 = 0 THEN 'header ' ELSE 'Animale: ' END || o_orderkey || chr(10)
          || CASE WHEN o_orderkey % 4 = 0 THEN 'Animale: 7 again' ELSE 'Data: ' || strftime(o_orderdate, '%-d.%-m.%y') END || chr(10)
          || CASE WHEN o_orderkey % 5 = 0 THEN 'no time' ELSE 'Ora: ' || o_orderkey % 24 || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') END || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) ELSE '' END, chr(10) ORDER BY o_orderkey), chr(10)) AS l FROM orders GROUP BY o_custkey),
      scan AS (SELECT o_custkey, l, 1 AS i, 0 AS k, CAST(NULL AS INTEGER) AS hit FROM lines
        UNION ALL SELECT o_custkey, l, CASE WHEN k < 8 AND l[i] LIKE 'Animale: %' THEN i + 2 ELSE i + 1 END, CASE WHEN k < 8 AND l[i] LIKE 'Animale: %' THEN k + 1 ELSE k END, CASE WHEN k < 8 AND l[i] LIKE 'Animale: %' THEN i END FROM scan WHERE i <= len(l)),
      found AS (SELECT o_custkey, k - 1 AS chart, regexp_extract(l[hit], 'Animale: ([0-9]+)', 1) AS animal_id, array_to_string(l[hit:hit + 2], ' ') AS b FROM scan WHERE hit IS NOT NULL),
      parts AS (SELECT *, regexp_extract(b, 'Data: ([0-9]+)\.([0-9]+)\.([0-9]+)', ['d', 'm', 'y']) AS p, regexp_extract(b, 'Ora: ([0-9]+):([0-9]+)', ['h', 'n']) AS o FROM found)
      SELECT c.o_custkey, CAST(s AS INTEGER) AS chart, animal_id, CASE WHEN p.y <> '' THEN '20' || p.y || '-' || lpad(p.m, 2, '0') || '-' || lpad(p.d, 2, '0') END AS date_iso, CASE WHEN o.h <> '' THEN lpad(o.h, 2, '0') || o.n END AS time_hhmm
      FROM (SELECT o_custkey FROM lines) c CROSS JOIN range(0, 8) r(s) LEFT JOIN parts ON parts.o_custkey = c.o_custkey AND parts.chart = s""",
    "anchored_collapse": f"""WITH RECURSIVE {POINTS_SQL}, near AS (SELECT chart, floor(t * 1e1 + 5e-1) / 1e1 + (seq % 7) * CAST(0.0004 AS DOUBLE) AS t, v FROM points),
      times AS (SELECT DISTINCT chart, t FROM near), opened AS (SELECT chart, min(t) AS a FROM times GROUP BY chart
        UNION ALL SELECT o.chart, (SELECT min(x.t) FROM times x WHERE x.chart = o.chart AND x.t - o.a >= 1e-3) FROM opened o WHERE EXISTS (SELECT 1 FROM times x WHERE x.chart = o.chart AND x.t - o.a >= 1e-3))
      SELECT n.chart, floor(o.a * 1e6 + 5e-1) / 1e6 AS t, floor(median(v) * 1e6 + 5e-1) / 1e6 AS v, count(*) AS vertices FROM near n ASOF JOIN opened o ON n.chart = o.chart AND n.t >= o.a GROUP BY n.chart, o.a""",
    "two_curves_at_probes": f"""WITH {CURVES_SQL}, off AS (SELECT chart, t, v * (1e0 + (chart % 7) * 1e-2) AS v FROM curves WHERE chart % 10 <> 9)
      SELECT c.chart, c.t, c.v, o.v AS w FROM curves c LEFT JOIN off o USING (chart, t), range(0, 2) WHERE c.t <= 5""",
    "session_prefix_match": f"""WITH {SESSIONS_SQL}, wanted AS (SELECT o_orderkey, 'animal_' || o_custkey || '_' || CASE WHEN o_orderkey % 10 = 9 THEN '1999' ELSE day END AS prefix, lpad(CAST(o_orderkey % 2400 AS VARCHAR), 4, '0') AS hhmm FROM sessions),
      files AS (SELECT DISTINCT csv_name AS file, o_custkey FROM sessions), met AS (SELECT w.*, f.file, count(f.file) OVER (PARTITION BY w.o_orderkey) AS matches
        FROM wanted w LEFT JOIN files f ON f.o_custkey = CAST(string_split(w.prefix, '_')[2] AS BIGINT) AND starts_with(f.file, w.prefix)),
      judged AS (SELECT *, CASE WHEN file IS NULL THEN 4 WHEN matches = 1 OR ends_with(file, '_' || hhmm || '.csv') THEN 1 WHEN file = prefix || '.csv' THEN 2 ELSE 3 END AS priority FROM met)
      SELECT o_orderkey, file, matches, CAST(priority AS INTEGER) AS priority FROM judged QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY priority, file) = 1""",
    "pixel_curves": """WITH seen AS (SELECT l_suppkey AS k, CAST(l_partkey % 290 + 3 AS INTEGER) AS col, CAST(floor(median(floor(l_quantity * 2 + l_suppkey % 3))) AS INTEGER) AS row FROM lineitem GROUP BY 1, 2),
      size AS (SELECT k, count(*) AS n, max(col) AS last, arg_max(row, col) AS last_row, 300e0 + any_value(s_suppkey) % 5 AS w, 50e0 + any_value(s_suppkey) % 60 AS h FROM seen JOIN supplier ON s_suppkey = k GROUP BY k HAVING count(*) > 1),
      plots AS (SELECT *, last_row >= 88e-2 * h AS to_end, CASE WHEN last_row >= 88e-2 * h THEN CAST(w AS INTEGER) ELSE last END AS stop FROM size),
      known AS (SELECT k, CAST(col AS DOUBLE) AS t, CAST(row AS DOUBLE) AS v FROM seen UNION ALL SELECT k, 0e0, h FROM plots UNION ALL SELECT k, w, h FROM plots WHERE to_end),
      probes AS (SELECT k, CASE WHEN j = least(120, stop + 1) - 1 THEN stop ELSE floor(j * (CAST(stop AS DOUBLE) / (least(120, stop + 1) - 1))) END AS t FROM plots, range(0, 120) r(j) WHERE j < stop + 1),
      rows AS (SELECT p.k, p.t, CASE WHEN a.t IS NULL THEN b.v WHEN b.t IS NULL THEN a.v WHEN a.t = p.t OR a.t = b.t THEN a.v ELSE a.v + (b.v - a.v) * (p.t - a.t) / (b.t - a.t) END AS v
        FROM probes p ASOF LEFT JOIN known a ON p.k = a.k AND p.t >= a.t ASOF LEFT JOIN known b ON p.k = b.k AND p.t <= b.t)
      SELECT k AS l_suppkey, CAST(t AS INTEGER) AS col, floor(least(greatest((t + 1e1 - 1e1) / w * 1e1, 0e0), 1e1) * 1e4 + 5e-1) / 1e4 AS t,
        floor(least(greatest((5e0 + h - (v + 5e0)) / h * 9e0, 0e0), 9e0) * 1e4 + 5e-1) / 1e4 AS v FROM rows JOIN plots USING (k)""",
    "metadata_check": f"""WITH found AS ({record_queries.ORACLE_SQL["header_parse"]}), strict AS ({axis_queries.ORACLE_SQL["strict_header_parse"]}),
      known AS (SELECT *, substr(time_full, 1, 2) || substr(time_full, 4, 2) AS time_hhmm FROM strict QUALIFY row_number() OVER (PARTITION BY animal_id, substr(time_full, 1, 5) ORDER BY o_orderkey DESC) = 1)
      SELECT f.o_orderkey, f.animal_id, f.time_full, k.o_orderkey IS NOT NULL AS matched, CASE WHEN k.o_orderkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN f.farm IS DISTINCT FROM k.farm THEN 'farm' END,
        CASE WHEN f.date_iso IS DISTINCT FROM k.date_iso THEN 'date_iso' END, CASE WHEN f.date_printed IS DISTINCT FROM k.date_printed THEN 'date_printed' END, CASE WHEN f.time_full IS DISTINCT FROM k.time_full THEN 'time_full' END,
        CASE WHEN f.milk_kg IS NULL OR abs(f.milk_kg - k.milk_kg) > 1e-9 THEN 'milk_kg' END, CASE WHEN f.gnr IS DISTINCT FROM k.gnr THEN 'gnr' END, CASE WHEN f.bimo IS DISTINCT FROM k.bimo THEN 'bimo' END, CASE WHEN f.le IS DISTINCT FROM k.le THEN 'le' END) END AS differs
      FROM found f LEFT JOIN known k ON f.animal_id = k.animal_id AND f.time_hhmm = k.time_hhmm""",
    "session_scores": f"""WITH {CURVES_SQL}, {OFF_SQL.replace("chart % 10 <> 9", "chart % 10 <> 9 AND t <= 8")}, {METRICS_SQL},
      ends AS (SELECT a.chart, a.t9, a.v9, b.t9 AS t8, b.v9 AS v8 FROM (SELECT chart, max(t) AS t9, max(v) AS v9 FROM curves GROUP BY chart) a LEFT JOIN (SELECT chart, max(t) AS t9, max(v) AS v9 FROM off GROUP BY chart) b USING (chart)),
      probes AS (SELECT chart, 0e0 + (least(t9, t8) - 0e0) * i / CAST(199 AS DOUBLE) AS t FROM ends, range(0, 200) r(i) WHERE t8 IS NOT NULL),
      one AS ({PROBE_SQL.format(curve="curves", out="v")}), two AS ({PROBE_SQL.format(curve="off", out="w")}),
      e AS (SELECT one.chart, avg(abs(v - w)) AS mean, max(abs(v - w)) AS top FROM one JOIN two ON one.chart = two.chart AND one.t = two.t GROUP BY one.chart),
      oa AS (SELECT chart, (v + lag(v) OVER w) / 2e0 * (t - lag(t) OVER w) AS a FROM off WINDOW w AS (PARTITION BY chart ORDER BY t)), os AS (SELECT chart, coalesce(sum(a), 0e0) AS area FROM oa GROUP BY chart)
      SELECT chart, t8 IS NOT NULL AS found, floor(mean * 1e4 + 5e-1) / 1e4 AS curve_mean, floor(top * 1e4 + 5e-1) / 1e4 AS curve_max, floor(abs(v8 - v9) * 1e4 + 5e-1) / 1e4 AS peak_error, floor(abs(t8 - t9) * 1e4 + 5e-1) / 1e4 AS end_error,
        CASE WHEN area IS NOT NULL THEN floor(CASE WHEN chart % 6 <> 0 AND integral <> 0 THEN 1e2 * area / integral ELSE 0e0 END * 1e2 + 5e-1) / 1e2 END AS milk_pct
      FROM ends LEFT JOIN e USING (chart) LEFT JOIN os USING (chart) LEFT JOIN metrics USING (chart)""",
    "session_stats": f"""WITH {POINTS_SQL}, kinds AS (SELECT p.chart, p.t, p.v, CASE WHEN event_type = 'purchase' THEN 'pressure' ELSE 'flow' END AS curve FROM points p JOIN events ON event_id = seq),
      c AS (SELECT chart, curve, t, median(least(greatest(v, 0e0), 1e2)) AS v FROM kinds WHERE chart % 9 <> 0 OR curve = 'flow' GROUP BY 1, 2, 3), a AS (SELECT *, (v + lag(v) OVER w) / 2e0 * (t - lag(t) OVER w) AS a FROM c WINDOW w AS (PARTITION BY chart, curve ORDER BY t))
      SELECT chart, max(v) FILTER (curve = 'flow') AS peak, CASE WHEN count(*) FILTER (curve = 'flow') > 0 THEN coalesce(max(t) FILTER (curve = 'flow' AND v >= 2e1) - min(t) FILTER (curve = 'flow' AND v >= 2e1), 0e0) END AS duration,
        floor(sum(coalesce(a, 0e0)) FILTER (curve = 'flow') * 1e4 + 5e-1) / 1e4 AS estimated_yield, floor(avg(v) FILTER (curve = 'pressure') * 1e4 + 5e-1) / 1e4 AS mean_pressure FROM a GROUP BY chart""",
    "page_windows": """WITH heads AS (SELECT DISTINCT p_brand AS page, round_even(p_retailprice / 25e-1, 0) AS top FROM part WHERE CASE WHEN length(p_brand) % 2 = 0 THEN p_partkey % 40 = 0 ELSE p_size < 45 END),
      tops AS (SELECT *, row_number() OVER w - 1 AS row, lead(top) OVER w AS below, count(*) OVER (PARTITION BY page) AS found FROM heads WINDOW w AS (PARTITION BY page ORDER BY top)),
      cells AS (SELECT p.page, w, r.row, c.col FROM (SELECT p_brand AS page, 1200 + max(p_size) AS w FROM part GROUP BY 1) p, range(0, 4) r(row), range(0, 2) c(col)),
      made AS (SELECT c.page, c.row, c.col, w, top, below, coalesce(found >= 4, false) AS by_header, CAST(trunc(w * 5e-3) AS INTEGER) AS mx, CAST(trunc(1754 * 15e-3) AS INTEGER) AS my FROM cells c LEFT JOIN tops t ON t.page = c.page AND t.row = c.row),
      boxes AS (SELECT *, (w - 2 * mx) // 2 AS wide, w // 2 AS half, (1754 - my - CAST(trunc(1754 * 5e-3) AS INTEGER)) // 4 AS high FROM made)
      SELECT page, CAST(row * 2 + col AS INTEGER) AS chart, CAST(CASE WHEN by_header THEN col * half ELSE mx + col * wide END AS INTEGER) AS x0, CAST(CASE WHEN by_header THEN (col + 1) * half ELSE mx + (col + 1) * wide END AS INTEGER) AS x1,
        CAST(CASE WHEN by_header THEN greatest(0, trunc((top - 2) * (15e1 / 72e0))) ELSE my + row * high END AS INTEGER) AS y0,
        CAST(CASE WHEN by_header THEN least(1754, trunc(coalesce(below - 2, CAST(841.92 AS DOUBLE)) * (15e1 / 72e0))) ELSE my + (row + 1) * high END AS INTEGER) AS y1 FROM boxes""",
    "accepted_uploads": """WITH n AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN '.' || e WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'in.d/r' || o_orderkey || '.' || e END AS name, o_orderkey % 11 = 0 AS dot, o_orderkey % 6 AS k
        FROM (SELECT *, ['pdf', 'PNG', 'jpeg', 'tar.gz', 'pdf.exe', 'Jpg'][o_orderkey % 6 + 1] AS e FROM orders))
      SELECT name IS NOT NULL AND NOT dot AND k IN (0, 1, 2, 5) AS accepted, count(*) AS n, max(name) AS last FROM n GROUP BY 1""",
}
