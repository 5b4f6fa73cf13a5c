import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge.functions import scalars
from seriesforge.operators import calibration, matching, quality, runs, series
from seriesforge.plans import extract, series_queries
from seriesforge.sources import files, pages
from seriesforge.streaming import sessions
from tests import synthetic

K = ["chart"]


def curve(spark, rows):
    return spark.createDataFrame(rows, "chart int, t double, v double")


def test_metrics_are_numpys(spark):
    rng = np.random.default_rng(2)
    t = np.cumsum(rng.random(50))
    v = rng.random(50) * 9
    m = series.metrics(curve(spark, [(1, float(a), float(b)) for a, b in zip(t, v)]), K).first()
    assert m.points == 50 and abs(m.integral - np.trapezoid(v, t)) < 1e-4 and m.v_max == v.max()


def test_one_point_has_no_area(spark):
    m = series.metrics(curve(spark, [(1, 2.0, 5.0)]), K).first()
    assert (m.points, m.integral) == (1, 0.0)


def test_resample_and_probes_are_numpys(spark):
    rng = np.random.default_rng(3)
    t, v = np.sort(rng.random(20) * 3).round(3), rng.random(20)
    c = curve(spark, [(7, float(a), float(b)) for a, b in zip(t, v)])
    got = sorted((r.t, r.v) for r in series.resample(c, K, 0.02).collect())
    grid = np.array([g for g, _ in got])
    assert np.allclose([x for _, x in got], np.interp(grid, t, v), atol=1e-12) and grid[0] == 0 and grid[-1] == t[-1]
    p = spark.createDataFrame([(7, float(x)) for x in np.linspace(-1, 4, 33)], "chart int, t double")
    for outside, ends in (("clamp", {}), ("null", {"left": np.nan, "right": np.nan})):
        got = sorted((r.t, np.nan if r.v is None else r.v) for r in series.at_times(c, p, K, outside).collect())
        assert np.allclose([x for _, x in got], np.interp([x for x, _ in got], t, v, **ends), atol=1e-12, equal_nan=True)


def test_points_past_the_axis_collapse_at_its_end(spark):
    c = curve(spark, [(1, 9.0, 1.0), (1, 10.5, 2.0), (1, 11.0, 8.0), (1, 12.0, 4.0)])
    got = series.collapse(c, K, scalars.clip(F.col("t"), F.lit(0.0), F.lit(10.0)), low=0.0, high=9.0)
    assert sorted((r.t, r.v) for r in got.collect()) == [(9.0, 1.0), (10.0, 4.0)]


@pytest.mark.parametrize("area,printed,reason", [(10.0, 10.2, "applied"), (10.0, 12.0, "exceeds_pen_width"), (10.0, None, "no_printed_weight"), (10.0, 0.0, "no_printed_weight"), (0.0, 3.0, "no_area")])
def test_scaling_reasons(spark, area, printed, reason):
    row = spark.createDataFrame([(area, printed)], "a double, p double")
    scale, why = series.scaled_to_total(F.col("a"), F.col("p"), F.lit(10.0), F.lit(5))
    got = row.select(scale.alias("s"), why.alias("w")).first()
    assert got.w == reason and got.s == (printed / area if reason == "applied" else 1.0)


def test_upper_median(spark):
    assert spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0)], "x double").agg(scalars.upper_median(F.col("x"))).first()[0] == 3.0


def test_header_variants(spark):
    texts = {
        "Animale: 1001 Data: 7/3/24 Ora: 3:58 latte: 1.234,5 kg": ("1001", "2024-03-07", "0358", None),
        "ID 9 12.05.2025 04:10 Latte 5,52 kg": ("9", "2025-05-12", "0410", 5.52),
        "nothing here": (None, None, None, None),
    }
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in rows.select("text", *[c.alias(n) for n, c in scalars.header_fields(F.col("text")).items()]).collect():
        assert (r.animal_id, r.date_iso, r.time_hhmm, r.milk_kg) == texts[r.text]


def test_header_codes_are_word_characters(spark):
    text = "Numero Azienda IT07A Animale: 3 Data: 7/3/24 Ora: 3:58:09 GNR: A12 BIMO = x1 LE = B"
    r = spark.createDataFrame([(text,), (None,)], "text string").select(*[c.alias(n) for n, c in scalars.header_fields(F.col("text")).items()]).collect()
    assert (r[0].farm, r[0].gnr, r[0].bimo, r[0].le) == ("IT07A", "A12", "x1", "B")
    assert (r[0].date_printed, r[0].time_full, r[0].time_hhmm) == ("07.03.2024", "03:58:09", "0358")
    assert set(r[1]) == {None}


def test_charts_that_cannot_be_read_are_reported(spark):
    charts = spark.createDataFrame([(1, k) for k in range(5)], "page long, chart int")
    axes = spark.createDataFrame([(1, 0, 0.01, 1.0, 50.0), (1, 1, 0.2, 1.0, 50.0), (1, 2, 0.01, 9.0, 9.0), (1, 3, 0.3, 1.0, 50.0)], "page long, chart int, residual double, x_left double, x_right double")
    flow = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 0.0, 1.0), (1, 1, 1.0, 1.0)], "page long, chart int, t double, v double")
    got = sorted((r.chart, r.warning) for r in extract.warnings_of(charts, axes, flow).collect())
    assert got == [
        (1, "Y calibration residual high (0.200)"),
        (2, "Degenerate X axis: chart skipped"),
        (3, "Flusso curve not present in vector layer"),
        (3, "Y calibration residual high (0.300)"),
        (4, "Axis calibration failed: chart skipped"),
    ]


def test_last_run_and_fit(spark):
    p = spark.createDataFrame([(1, y) for y in (3, 4, 9, 10, 12, 30, 31)], "chart int, y int")
    assert [(r.middle, r.runs) for r in runs.last_run(p, K, "y").collect()] == [(30.5, 3)]
    ticks = spark.createDataFrame([(1, 100.0 - 10 * v, v) for v in range(5)], "chart int, y double, v int")
    f = calibration.fit(ticks, K, "y", "v").first()
    assert abs(f.slope + 0.1) < 1e-12 and f.residual < 1e-9
    assert calibration.fit(ticks.limit(2), K, "y", "v").count() == 0


def test_perfect_match_is_full_accuracy(spark):
    c = curve(spark, [(1, float(k), float(k % 3)) for k in range(11)])
    probes = quality.even_times(c.groupBy("chart").agg(F.max("t").alias("b")), K, F.lit(0.5), F.col("b"), 40)
    stats = quality.gated(quality.error_stats(quality.errors_at(c, c, probes, K), K), F.lit(9.0), F.lit(0.0)).first()
    assert (stats.accuracy_pct, stats.passed, stats.n) == (100.0, True, 40)


def test_sessions_round_trip_and_stream(spark, tmp_path):
    c = synthetic.flow_curves(spark, 5).withColumn("csv_name", F.concat(F.lit("animal_"), F.col("chart"), F.lit("_2024-03-07.csv"))).withColumn("curve", F.lit(files.FLOW))
    files.write_sessions(c, str(tmp_path / "out"))
    assert spark.read.schema(files.CURVE).option("header", True).csv(str(tmp_path / "out")).count() == c.count()
    folder = tmp_path / "in"
    folder.mkdir()
    for chart in (1, 2):
        rows = c.where(F.col("chart") == chart).orderBy("t").collect()
        (folder / f"animal_{chart}_2024-03-07.csv").write_text("curve,time_min,value\n" + "".join(f"{r.curve},{r.t},{r.v}\n" for r in rows))
    got = files.read_sessions(spark, str(folder))
    assert {(r.animal_id, r.date_iso, r.time_hhmm) for r in got.collect()} == {("1", "2024-03-07", None), ("2", "2024-03-07", None)}
    query = sessions.running_peaks(sessions.session_points(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("peaks").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("peaks").count() == 2
    assert synthetic.pressure_curves(spark, 2).where("v < 0").count() == 0


def test_truth_json(spark, tmp_path):
    chart = {"page": 0, "chart": 1, "metadata": {"animal_id": "07"}, "flusso": {"time_min": [0.0, 1.0], "value": [2.0, 3.0]}, "pressione": {"time_min": [0.5], "value": [4.0]}}
    (tmp_path / "t.json").write_text(json.dumps({"baseline": [chart], "edge": []}))
    got = sorted((r.dataset, r.animal_id, r.curve, r.t, r.v) for r in files.read_truth(spark, str(tmp_path / "t.json"), ["baseline", "edge"]).collect())
    assert got == [("baseline", "07", files.FLOW, 0.0, 2.0), ("baseline", "07", files.FLOW, 1.0, 3.0), ("baseline", "07", files.PRESSURE, 0.5, 4.0)]


def test_page_source_takes_a_reader(spark):
    pages.READERS["one"] = lambda path, kind: iter([(0, 1, 0.0, 0.0, 1.0, 1.0, path)])
    spark.dataSource.register(pages.PageSource)
    assert pages.PageSource({"kind": "strokes"}).schema() == pages.SEGMENTS
    reader = pages.PageSource({"kind": "blocks", "reader": "one", "path": "a,b"}).reader(None)
    assert [r for p in reader.partitions() for r in reader.read(p)] == [(0, 1, 0.0, 0.0, 1.0, 1.0, "a"), (0, 1, 0.0, 0.0, 1.0, 1.0, "b")]
    with pytest.raises(ValueError, match="no reader"):
        list(pages.PageSource({"path": "a"}).reader(None).read(reader.partitions()[0]))


def test_written_sessions_keep_their_names(spark, tmp_path):
    c = synthetic.flow_curves(spark, 3).withColumn("csv_name", F.concat(F.lit("animal_"), F.col("chart"), F.lit("_2024-03-07_0815.csv"))).withColumn("curve", F.lit(files.FLOW))
    files.write_sessions(c, str(tmp_path / "store"))
    got = files.read_sessions(spark, str(tmp_path / "store"))
    want = {(str(r.chart), "2024-03-07", "0815", r.t, r.v) for r in c.collect()}
    assert {(r.animal_id, r.date_iso, r.time_hhmm, r.t, r.v) for r in got.collect()} == want


def test_each_header_pattern_is_matched_once(spark):
    texts = spark.createDataFrame([("Animale: 3 Data: 7/3/24 Ora: 3:58:09",)], "text string").select(F.concat("text", F.lit(" GNR: 1")).alias("text"))
    code = lambda fields: spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(texts.select(*[c.alias(n) for n, c in fields.items()])._jdf.queryExecution().executedPlan())
    # Once for all groups of a pattern and for the test whether it met anything; the rest are over the few characters found.
    assert code(scalars.header_fields(F.col("text"))).count(".matcher(") <= 21
    assert code(scalars.strict_fields(F.col("text"))).count(".matcher(") <= 13


def test_header_dates_and_times_in_odd_forms(spark):
    texts = {
        "Data:\n7-3-2024 Ora: :3:58": ("2024-03-07", "07.03.2024", "0358", "03:58", None),
        "1.2.024 and 12.10.2023, 9:05 then 10:15:30": ("024-02-01", "01.02.024", "0905", "09:05", None),
        "1.2.2025 DATA 31/12/99 10:15 ORA 4:05:06": ("2099-12-31", "31.12.2099", "0405", "04:05:06", "06"),
        "Data: 1.2.3 Ora: 4:5": (None, None, None, None, None),
        "": (None,) * 5,
        None: (None,) * 5,
    }
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in rows.select("text", *[c.alias(n) for n, c in scalars.header_fields(F.col("text")).items()]).collect():
        assert (r.date_iso, r.date_printed, r.time_hhmm, r.time_full, r.seconds) == texts[r.text]
    strict = {"Data: 7.3.2024": ("2024-03-07", "07.03.2024"), "Data: 7.3.24": (None, None), "data: 7.3.2024": (None, None), None: (None, None)}
    rows = spark.createDataFrame([(t,) for t in strict], "text string")
    for r in rows.select("text", *[c.alias(n) for n, c in scalars.strict_fields(F.col("text")).items()]).collect():
        assert (r.date_iso, r.date_printed) == strict[r.text]


def test_metadata_check_takes_the_last_complete_truth(spark):
    names = ("o", *matching.FIELDS)
    row = lambda o, **own: tuple(({"o": o, "farm": "F", "animal_id": "1", "date_iso": "2024-03-07", "date_printed": "07.03.2024", "time_full": "03:58:09", "milk_kg": 5.0, "gnr": "1", "bimo": "1", "le": "0"} | own)[n] for n in names)
    kind = "o long, " + ", ".join(f"{n} {'double' if n == 'milk_kg' else 'string'}" for n in matching.FIELDS)
    truth = [
        row(1), row(2, gnr="2"), row(2, gnr="2"), row(3, milk_kg=None), row(4, milk_kg=float("nan")), row(5, date_iso=None), row(None, gnr="9"), row(6, animal_id=None), row(7, time_full=None),
        row(8, animal_id="2", milk_kg=float("nan")), row(None, animal_id="3"),
    ]
    read = spark.createDataFrame([row(10), row(10), row(11, animal_id="2"), row(12, animal_id="3", milk_kg=None), row(13, animal_id=None), row(14, time_full=None)], kind)
    read = read.withColumn("time_hhmm", F.replace(F.substring("time_full", 1, 5), F.lit(":"), F.lit("")))
    found = matching.metadata_check(read, spark.createDataFrame(truth, kind), ["o"], "o")
    assert sorted((r.o, r.matched, r.differs) for r in found.collect()) == [(10, True, ["gnr"]), (10, True, ["gnr"]), (11, False, []), (12, True, ["milk_kg"]), (13, False, []), (14, False, [])]
    # All four fields at once would read a text in full before it is given up.
    assert "atleastnnonnulls" not in found._jdf.queryExecution().executedPlan().toString().lower()


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_two_curves_are_dealt_out_once_and_without_points(spark):
    c = curve(spark, [(1, 0.0, 1.0), (1, 2.0, 5.0), (2, 1.0, None), (2, 3.0, 4.0), (None, 0.0, 7.0)])
    o = curve(spark, [(1, 1.0, 3.0), (1, 1.0, 3.0), (2, None, 9.0)])
    p = spark.createDataFrame([(1, 0.5), (1, 0.5), (1, 1.0), (1, 9.0), (1, -1.0), (1, None), (2, 2.0), (2, 3.0), (3, 1.0), (None, 5.0)], "chart int, t double")
    made = series.both_at_times(c, o, p, K)
    plan = plan_of(made)
    # A frame to the window's end is read anew for each row; structs under the exchange would be shuffled.
    assert "unboundedfollowing" not in plan and "struct(" not in plan[plan.index("Exchange hashpartitioning") :] and plan.count("Exchange hashpartitioning") == 1
    want = [(1, None, 1.0, 3.0), (1, -1.0, 1.0, 3.0), (1, 0.5, 2.0, 3.0), (1, 0.5, 2.0, 3.0), (1, 1.0, 3.0, 3.0), (1, 9.0, 5.0, 3.0), (2, 2.0, None, 9.0), (2, 3.0, 4.0, 9.0), (3, 1.0, None, None), (None, 5.0, 7.0, None)]
    key = lambda r: tuple((x is not None, x) for x in r[:2])
    assert sorted(((r.chart, r.t, r.v, r.w) for r in made.collect()), key=key) == sorted(want, key=key)


def test_report_summary_works_out_its_charts_once(spark):
    assert "events" not in plan_of(series_queries.report_summary(spark, "/root/testdata/sf0.001"))


def test_probes_read_a_series_once(spark):
    c = curve(spark, [(1, 0.0, 1.0), (1, 2.0, 5.0), (1, 2.0, 5.0), (2, 1.0, None), (2, 3.0, 4.0), (4, None, 6.0), (None, 0.0, 7.0)])
    p = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 2.0), (1, 9.0), (1, -1.0), (1, None), (2, 2.0), (3, 1.0), (4, 1.0), (None, 5.0)], "chart int, t double")
    clamped = [(1, None, 1.0), (1, -1.0, 1.0), (1, 1.0, 3.0), (1, 1.0, 3.0), (1, 2.0, 5.0), (1, 9.0, 5.0), (2, 2.0, None), (3, 1.0, None), (4, 1.0, 6.0), (None, 5.0, 7.0)]
    inside = [(1, None, None), (1, -1.0, None), (1, 1.0, 3.0), (1, 1.0, 3.0), (1, 2.0, 5.0), (1, 9.0, None), (2, 2.0, None), (3, 1.0, None), (4, 1.0, None), (None, 5.0, None)]
    key = lambda r: tuple((x is not None, x) for x in r[:2])
    for outside, want in (("clamp", clamped), ("null", inside)):
        made = series.at_times(c, p, K, outside)
        plan = plan_of(made)
        assert "unboundedfollowing" not in plan and "struct(" not in plan[plan.index("Exchange hashpartitioning") :] and plan.count("Exchange hashpartitioning") == 1
        assert sorted(((r.chart, r.t, r.v) for r in made.collect()), key=key) == sorted(want, key=key)


def test_pixel_curves_meet_their_boxes_without_another_count(spark):
    pixels = spark.createDataFrame([(1, x, 5 + x % 2) for x in range(1, 9)] + [(2, 3, 4), (None, 1, 1), (3, 1, None), (3, 2, None), (4, 1, 2), (4, 3, 4)], "chart int, x int, y int")
    boxes = spark.createDataFrame([(1, 0.0, 10.0, 0.0, 6.0), (2, 0.0, 10.0, 0.0, 6.0), (None, 0.0, 1.0, 0.0, 1.0), (4, 0.0, 10.0, 0.0, 20.0), (4, 0.0, 10.0, 0.0, 20.0)], "chart int, left double, right double, top double, bottom double")
    made = runs.pixels_to_curve(pixels, boxes, K, 10.0, 9.0, 4)
    # The points, the columns that pins replace, the pins and the probes.
    assert len(re.findall(r"Scan ExistingRDD\[chart#\d+,x#", plan_of(made))) == 4
    got = sorted((r.chart, r.col, r.t, r.v) for r in made.collect())
    one = [(1, 0, 0.0, 0.0), (1, 2, 2.0, 1.5), (1, 5, 5.0, 0.0), (1, 8, 8.0, 1.5)]
    # A box that is there twice asks twice, and each answer meets both.
    four = [(4, 0, 0.0, 0.0), (4, 1, 1.0, 8.1), (4, 2, 2.0, 7.65), (4, 3, 3.0, 7.2)]
    assert got == sorted(one + four * 4)
