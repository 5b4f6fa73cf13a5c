import csv
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge.operators import extraction, geometry, matching, runs, selection, series
from seriesforge.sources import drawn, files, publish, run, shared

K = ["chart"]
SIZE = drawn.PAGE_WIDTH, drawn.PAGE_HEIGHT


def page(spark, n=8, headers=None):
    """Blocks and strokes of one page of straight lines v = t / 2."""
    charts = spark.createDataFrame([(0, s) for s in range(n)], "page long, slot int")
    texts = headers or [f"Animale: {s} latte: 25,00 kg Data: 1.2.2024 Ora: 03:58:23" for s in range(n)]
    header = F.element_at(F.array(*map(F.lit, texts)), F.col("slot") + 1)
    points = charts.select("page", "slot", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k")).select("page", "slot", (F.col("k") / 2.0).alias("t"), (F.col("k") / 4.0).alias("v"))
    return drawn.blocks(charts, header), drawn.strokes(points, charts)


def test_digits_in_the_plot_are_no_ticks(spark):
    blocks, strokes = page(spark, 2)
    inner = drawn.inner_digits(spark.createDataFrame([(0, 0)], "page long, slot int"))
    found = extraction.extract(blocks.unionByName(inner), strokes, *SIZE)
    axes = {r.chart: r for r in found.axes.collect()}
    assert axes[0].n == 10 and abs(axes[0].slope - axes[1].slope) < 1e-12 and axes[0].residual < 1e-9
    assert (axes[0].v_bottom, axes[0].v_top) == (0.0, 9.0) and found.warnings.count() == 0
    assert sorted((r.t, r.v) for r in found.curves.where("chart = 0").collect()) == [(k / 2, k / 4) for k in range(21)]


def test_text_is_read_from_its_own_half_of_the_page(spark):
    """A label of the left chart just left of the middle doesn't become the right chart's leftmost column."""
    blocks, strokes = page(spark, 2)
    middle = drawn.PAGE_WIDTH / 2
    stray = spark.createDataFrame([(0, -k, middle - 8, 40.0 + 9 * k, middle - 2, 46.0 + 9 * k, str(k)) for k in range(4)], drawn.BLOCKS)
    axes = {r.chart: r for r in extraction.extract(blocks.unionByName(stray), strokes, *SIZE).axes.collect()}
    assert axes[1].n == 10 and axes[1].residual < 1e-9


def test_rows_a_few_points_apart_are_rows_of_their_own(spark):
    blocks, _ = page(spark, 2)
    low = F.when(F.col("seq") == 20, F.lit(3.0)).otherwise(F.lit(0.0))
    charts = {r.chart: r for r in extraction.charts_of(blocks.withColumn("y0", F.col("y0") + low), *SIZE).collect()}
    assert charts[0].y1 == 18.0 - 6.0 and charts[1].y1 == drawn.PAGE_HEIGHT


def test_headers_need_an_animal(spark):
    blocks, _ = page(spark, 3, ["Animale: 5", "Numero Azienda 07010142", "ID: 9"])
    assert [r.chart for r in extraction.charts_of(blocks, *SIZE).orderBy("chart").collect()] == [0, 1]


def test_values_without_a_printed_range_are_not_clamped(spark):
    blocks, strokes = page(spark, 1)
    axes = extraction.extract(blocks, strokes, *SIZE).axes
    high = drawn.polyline(spark.createDataFrame([(0, 0, 1.0, 9.5), (0, 0, 2.0, 9.5)], "page long, slot int, t double, v double"), drawn.FLOW_INK, 0.0, 9.0)
    assert {r.v for r in extraction.traced(axes, high).collect()} == {9.0}
    open_top = axes.withColumn("v_top", F.lit(None).cast("double"))
    assert {r.v for r in extraction.traced(open_top, high).collect()} == {9.5}


def test_cells_join_once(spark):
    rng = random.Random(4)
    windows = spark.createDataFrame([(i % 2, i, x := rng.uniform(-50, 500), x + rng.uniform(0, 400), y := rng.uniform(-50, 800), y + rng.uniform(0, 90)) for i in range(30)], "page int, w int, x0 double, x1 double, y0 double, y1 double")
    items = spark.createDataFrame([(i % 2, i, rng.uniform(-60, 900), rng.uniform(-60, 900)) for i in range(400)] + [(0, 999, 150.0, 40.0)], "page int, i int, x double, y double")
    c = F.col
    box, holds = tuple(c(n) for n in ("x0", "x1", "y0", "y1")), c("x").between(c("x0"), c("x1")) & c("y").between(c("y0"), c("y1"))
    got = sorted((r.w, r.i) for r in geometry.inside_cells(windows, items, ["page"], box, (c("x"), c("y")), holds).collect())
    assert got == sorted((r.w, r.i) for r in geometry.inside(windows, items, ["page"], holds).collect()) and len(got) > 30


def test_windows_in_cells_are_never_broadcast(spark):
    """However small the windows are thought to be; and strokes meet the plots once, whatever curves are wanted."""
    blocks, strokes = page(spark, 2)
    charts = extraction.charts_of(blocks, *SIZE)
    axes = shared.written(extraction.calibrated(charts, extraction.text_of(charts, blocks), strokes), "axes")
    traces = spark.createDataFrame([(0, 1, extraction.TEMPERATURE, -1.0, 400.0)], "page long, chart int, curve string, slope double, intercept double")
    red = drawn.polyline(spark.createDataFrame([(0, s, t, 20.0) for s in range(2) for t in (1.0, 2.0)], "page long, slot int, t double, v double"), extraction.OWN_AXIS[extraction.TEMPERATURE], 10.0, 45.0)
    windows = axes.select("page", "wx0", "wx1", "wy0", "wy1")
    found = geometry.inside_cells(windows, strokes, ["page"], tuple(F.col(n) for n in windows.columns[1:]), (F.col("x0"), F.col("y0")), F.lit(True))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    both = extraction.traced(axes, strokes.unionByName(red), traces, (extraction.FLOW, extraction.TEMPERATURE))
    got = sorted((r.chart, r.curve, r.t, r.v) for r in both.where(F.col("curve") != extraction.FLOW).collect())
    y = float(drawn.TOPS[0] + drawn.PLOT_TOP + drawn.PLOT_HEIGHT * (1 - 10 / 35))
    assert got == [(1, extraction.TEMPERATURE, t, pytest.approx(400 - y, abs=1e-4)) for t in (1.0, 2.0)]
    flow = sorted((r.chart, r.t, r.v) for r in both.where(F.col("curve") == extraction.FLOW).collect())
    assert flow == [(s, k / 2, k / 4) for s in range(2) for k in range(21)]


def test_a_run_leaves_named_files_or_nothing(spark, tmp_path, monkeypatch):
    headers = ["Animale: 1 latte: 24,9 kg Data: 1.2.2024 Ora: 03:58:23", "Animale: 1 Data: 1.2.2024 Ora: 04:10", "Animale: 1 Data: 1.2.2024 Ora: 04:10", "Animale: 1 Data: 1.2.2024", "Animale: 2 latte: 99 kg Ora: 1:02"]
    blocks, strokes = page(spark, 5, headers)
    blocks, strokes = blocks.cache(), strokes.cache()
    goal = f"file://{tmp_path}/out"
    with monkeypatch.context() as m:
        m.setattr(run, "write_report", lambda *_: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError):
            run.run_pages(blocks, strokes, *SIZE, goal)
    assert all(p.name.startswith("_") for p in tmp_path.iterdir())
    names = run.run_pages(blocks, strokes, *SIZE, goal)
    want = ["animal_1_2024-02-01.csv", "animal_1_2024-02-01_0003.csv", "animal_1_2024-02-01_0410.csv", "animal_1_2024-02-01_0410_0001.csv", "animal_2_unknown_date.csv"]
    assert sorted(p.name for p in tmp_path.glob("out/sessions/*.csv")) == want and [n for n in names if n.startswith("sessions/")] == [f"sessions/{n}" for n in want]
    rows = list(csv.DictReader((tmp_path / "out/sessions/animal_1_2024-02-01_0410.csv").open()))
    assert len(rows) == 501 and rows[0]["curve"] == files.FLOW and float(rows[-1]["time_min"]) == 10.0 and float(rows[-1]["value"]) == 5.0
    scaled = list(csv.DictReader((tmp_path / "out/sessions/animal_1_2024-02-01.csv").open()))
    assert abs(np.trapezoid([float(r["value"]) for r in scaled], [float(r["time_min"]) for r in scaled]) - 24.9) < 1e-3
    report = {r["chart"]: r for p in tmp_path.glob("out/report/*.json") for r in map(json.loads, p.open())}
    assert [report[k]["csv_file"] for k in range(5)] == [want[0], want[2], want[3], want[1], want[4]]
    assert report[0]["milk_calibrated"] and report[0]["yield_ratio"] == 1.0 and report[1]["reason"] == "no_printed_weight"
    assert report[4]["reason"] == "exceeds_pen_width" and report[4]["measured_kg"] == 25.0 and report[4]["pct_of_printed"] == 25.3
    assert report[0]["reaches_axis_end"] and report[0]["csv_rows"] == 501 and report[0]["calibration"]["x_source"] == "ticks" and report[0]["warnings"] == []
    with pytest.raises(FileExistsError):
        run.run_pages(blocks, strokes, *SIZE, goal)
    back = files.read_sessions(spark, f"{goal}/sessions")
    assert {(r.animal_id, r.date_iso, r.time_hhmm) for r in back.select("animal_id", "date_iso", "time_hhmm", "file").where("file like '%0410.csv'").collect()} == {("1", "2024-02-01", "0410")}


def test_sessions_are_written_under_their_names_where_tasks_can_open_them(spark, tmp_path, monkeypatch):
    """Without a folder and a renaming for each; in other stores Spark's writer makes the same files."""
    blocks, strokes = page(spark, 3, ["Animale: 1 Data: 1.2.2024", "Animale: 1 Data: 1.2.2024", "Animale: 2 latte: 25 kg"])
    blocks, strokes = shared.written(blocks, "blocks"), shared.written(strokes, "strokes")
    made = {}
    for way, closed in (("open", "write_sessions"), ("other", "write_named_sessions")):
        with monkeypatch.context() as m:
            m.setattr(run, closed, lambda *_: (_ for _ in ()).throw(RuntimeError(closed)))
            if way == "other":
                m.setattr(run, "local_path", lambda *_: None)
            names = run.run_pages(blocks, strokes, *SIZE, f"file://{tmp_path}/{way}")
        assert sorted(f"sessions/{p.name}" for p in tmp_path.glob(f"{way}/sessions/*.csv")) == [n for n in names if n.startswith("sessions/")]
        made[way] = {p.name: p.read_text() for p in tmp_path.glob(f"{way}/sessions/*") if not p.name.startswith(".")}
    assert made["open"] == made["other"] and len(made["open"]) == 3 and made["open"]["animal_2_unknown_date.csv"].startswith("curve,time_min,value\n")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["open", "other"]


def test_files_below_are_listed_whole(spark, tmp_path):
    for n in ("top", "a/x, y", "a/b/c/caf\u00e9", "a/b/.hidden", "a/_c"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("")
    (tmp_path / "a/empty").mkdir()
    assert publish.files_below(spark, f"file://{tmp_path}") == ["a/_c", "a/b/.hidden", "a/b/c/caf\u00e9", "a/x, y", "top"]
    assert publish.files_below(spark, f"file://{tmp_path}/a/empty") == []


def test_publish_refuses_two_files_of_one_name(spark, tmp_path):
    hidden = publish.hidden_beside(f"file://{tmp_path}/goal")
    spark.range(10).repartition(2).write.csv(hidden)
    with pytest.raises(ValueError):
        publish.publish(spark, hidden, f"file://{tmp_path}/goal", lambda f: "one.csv" if f.startswith("part-") else None)
    assert not (tmp_path / "goal").exists()


def anchored(times, within):
    out, a = {}, None
    for t in sorted(times):
        if a is None or t - a >= within:
            a = t
        out[t] = a
    return out


def test_near_times_belong_to_their_groups_first(spark):
    rng = random.Random(8)
    rows = [(c, round(rng.choice([0.0, 1.0, 2.0]) + rng.randrange(60) * 1e-7, 7), rng.random()) for c in range(4) for _ in range(150)] + [(9, 10.0, 1.0)] * 5
    made = series.anchors(spark.createDataFrame(rows, "chart int, t double, v double"), K)
    want = {c: anchored({t for k, t, _ in rows if k == c}, 1e-6) for c in {r[0] for r in rows}}
    got = made.collect()
    assert len(got) == len(rows) and all(r.anchor == want[r.chart][r.t] for r in got)
    assert series.collapse_anchored(spark.createDataFrame(rows[-5:], "chart int, t double, v double"), K).collect()[0][1:] == (10.0, 1.0, 5)
    assert series.collapse_anchored(spark.createDataFrame([], "chart int, t double, v double"), K).count() == 0


@pytest.mark.parametrize("outside", ["clamp", "null"])
def test_two_curves_in_one_pass_are_two_passes(spark, outside):
    rng = random.Random(3)
    one = spark.createDataFrame([(c, float(t), rng.random()) for c in (1, 2) for t in range(2, 9)], "chart int, t double, v double")
    two = spark.createDataFrame([(1, t / 3, rng.random()) for t in range(3, 20)], "chart int, t double, v double")
    probes = spark.createDataFrame([(c, t / 4) for c in (1, 2, 3) for t in [*range(40), 7, 7]], "chart int, t double")
    got = series.both_at_times(one, two, probes, K, outside).collect()
    assert len(got) == 3 * 42  # a probe asked three times comes back three times
    for curve, column in ((one, "v"), (two, "w")):
        want = sorted((r.chart, r.t, r.v) for r in series.at_times(curve, probes, K, outside).fillna(-1.0).collect())
        assert sorted((r.chart, r.t, -1.0 if r[column] is None else r[column]) for r in got) == want


def test_selection_of_any_group(spark):
    rng = random.Random(6)
    rows = [("a", rng.gauss(0, 1e-9)) for _ in range(301)] + [("b", 5.0)] * 50 + [("c", float(i)) for i in range(4)] + [("d", None), ("d", float("nan"))] + [(None, 1e300), (None, -1e300)]
    rows += [("e", rng.choice([0.0, 1e-300, 1e300])) for _ in range(99)]
    table = spark.createDataFrame(rows, "k string, x double")
    for buckets in (1, 7, 1 << 16):
        got = {r.k: (r.low, r.high) for r in selection.selected(table, ["k"], "x", {"low": selection.lower, "high": selection.upper}, buckets).collect()}
        want = {}
        for k in {"a", "b", "c", None, "e"}:
            x = sorted(v for n, v in rows if n == k)
            want[k] = x[(len(x) - 1) // 2], x[len(x) // 2]
        assert got == want
    assert {r.k: r.median for r in selection.middle(table, ["k"], "x").collect()}["c"] == 1.5
    assert selection.middle(table.limit(0), ["k"], "x").collect() == []


def test_header_lines_look_ahead_and_skip(spark):
    text = "title\nAnimale: 1\nAnimale: 2 Data: 3/4/25\nOra: 5:06\nID 8 1.2.24 7:08\n\nAnimale: 9"
    rows = spark.createDataFrame([(text,), (None,), ("",), ("\n".join(f"Animale: {k}\n" for k in range(12)),)], "text string").select(matching.header_lines(F.col("text")).alias("h")).collect()
    assert [tuple(h) for h in rows[0].h if h] == [("1", "2025-04-03", "0506"), ("8", "2024-02-01", "0708"), ("9", None, None)]
    assert all(len(r.h) == 8 for r in rows) and [sum(h is not None for h in r.h) for r in rows] == [3, 0, 0, 8]


def test_files_by_prefix(spark):
    names = ["animal_1_2024-03-07_x.csv", "animal_1_2024-03-07.csv", "animal_12_2024-03-07.csv", "animal_1_2024-03-07_0815.csv", "animal_3_2024-03-07_y.csv", "zebra.csv"]
    listed = spark.createDataFrame([(n,) for n in names], "file string")
    wanted = spark.createDataFrame([("1", "2024-03-07"), ("12", "2024-03-07"), ("4", "2024-03-07")], "animal_id string, date_iso string")
    got = [(r.animal_id, r.file, r.place) for r in files.by_prefix(listed, wanted).orderBy("animal_id", "place").collect()]
    assert got == [("1", names[1], 1), ("1", names[3], 2), ("1", names[0], 3), ("12", names[2], 1), ("4", None, 1)]
    asked = spark.createDataFrame([(1, "animal_1_2024-03-07", "0815"), (2, "animal_1_2024-03-07", "0900"), (3, "animal_3_2024-03-07", None), (4, "animal_4", "1"), (5, "animal_1_2024-03-07_", None)], "id int, prefix string, time string")
    got = {r.id: (r.file, r.priority) for r in matching.session_file(asked, listed, ["id"], "prefix", "time").collect()}
    assert got == {1: (names[3], 1), 2: (names[1], 2), 3: (names[4], 1), 4: (None, 4), 5: (names[3], 3)}


def test_beginnings_of_names_are_never_broadcast(spark):
    """However small the names are thought to be, and only beginnings as long as a prefix are made."""
    names = spark.createDataFrame([("ab.csv",), ("àb.csv",), ("ab_1.csv",), ("",), (None,)], "file string")
    wanted = spark.createDataFrame([(1, ""), (2, "ab"), (3, "ab_1.csv"), (4, "ab_1.csv2"), (5, None), (6, "à"), (7, "ab")], "id int, prefix string")
    met = matching.prefix_matches(wanted, names, "prefix", "file")
    got = sorted((r.id, r.file or ("" if r.id == 1 else "none")) for r in met.collect())
    assert got == sorted([*[(1, n) for n in ("ab.csv", "àb.csv", "ab_1.csv", "")], *[(i, n) for i in (2, 7) for n in ("ab.csv", "ab_1.csv")], (3, "ab_1.csv"), (4, "none"), (5, "none"), (6, "àb.csv")])
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "Generate" not in plan


def test_truth_of_any_data_sets(spark, tmp_path):
    chart = {"page": 0, "chart": 1, "metadata": {"animal_id": "07"}, "flusso": {"time_min": [0.0], "value": [2.0]}, "pressione": {"time_min": [], "value": []}}
    (tmp_path / "t.json").write_text(json.dumps({"a b": [chart], "any": [chart, chart], "none": []}, indent=1))
    got = files.read_truth(spark, str(tmp_path / "t.json"))
    assert sorted(r.dataset for r in got.collect()) == ["a b", "any", "any"]


def pixel_curve(points, left, right, top, bottom, n, end):
    """One plot's curve in plain Python."""
    cols = {}
    for x in {p[0] for p in points}:
        cols[x] = int(np.median([q[1] for q in points if q[0] == x]))
    if len(cols) < 2:
        return []
    w, h, last = right - left, bottom - top, max(cols)
    low = cols[max(k for k in cols if k > 0)] >= 0.88 * h
    cols[0] = int(h)
    if end and low:
        last = int(w)
        cols[last] = int(h)
    known = sorted(cols)
    rows = np.interp(np.arange(last + 1), known, [cols[k] for k in known])
    at = np.linspace(0, last, min(n, last + 1), dtype=int)
    return [(round(min(max(c / w * 10, 0), 10), 4), round(min(max((h - rows[c]) / h * 9, 0), 9), 4)) for c in at]


def test_pixels_to_a_curve(spark):
    rng = random.Random(12)
    points = {k: [(rng.randrange(1, 200), rng.randrange(0, 101)) for _ in range(300)] for k in range(3)}
    points[1] += [(199, 99)] * 5 + [(250, 60)]
    points[2] = [(260, 97)] * 3 + [(5, 10), (261, 98)]
    points[3] = [(4, 4)]
    pixels = spark.createDataFrame([(k, x, y) for k, v in points.items() for x, y in v], "chart int, x int, y int")
    boxes = spark.createDataFrame([(k, 10.0, 310.0, 5.0, 105.0) for k in points], "chart int, left double, right double, top double, bottom double")
    got = runs.pixels_to_curve(pixels, boxes, K, 10.0, 9.0, 50, anchor_end=True).orderBy("chart", "col").collect()
    for k, v in points.items():
        mine = [(r.t, r.v) for r in got if r.chart == k]
        assert np.allclose(np.array(mine), np.array(pixel_curve(v, 10, 310, 5, 105, 50, True)), atol=1.01e-4) if mine else k == 3
    assert sum(r.chart == 2 for r in got) == 50 and max(r.t for r in got if r.chart == 2) == 10.0


def test_page_metadata_is_padded_and_reads_ahead(spark):
    rows = [(0, 0, 300.0, 14.0, 310.0, 20.0, "Animale: 2"), (0, 1, 300.0, 20.0, 310.0, 25.0, "Data: 1/2/24"), (0, 2, 10.0, 12.0, 20.0, 18.0, "Animale: 1 Ora: 3:04"), (0, 3, 10.0, 200.0, 20.0, 206.0, "Ora: 9:09"), (1, 0, 0.0, 0.0, 1.0, 1.0, "nothing")]
    got = extraction.page_metadata(spark.createDataFrame(rows, drawn.BLOCKS), drawn.PAGE_WIDTH).collect()
    assert len(got) == 16
    named = {(r.page, r.chart): (r.animal_id, r.date_iso, r.time_hhmm) for r in got if r.animal_id}
    assert named == {(0, 0): ("1", None, "0304"), (0, 1): ("2", "2024-02-01", "0304")}
