"""Curves in long form: (keys, t, v). Collapse, metrics, resampling, scaling to a stated total.

Each operator needs one exchange by the series' keys; windows over (keys, t) share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seriesforge.functions.scalars import END_OF_FLOW, HALF_PEN_KG, HALF_PEN_POINTS, PEN_SLACK, STEP, clip, rounded


def collapse(points: DataFrame, keys: list[str], t: Column | None = None, v: Column | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """Vertices to a series: clamp, then one value a time (the median of its vertices)."""
    t, v = F.col("t") if t is None else t, F.col("v") if v is None else v
    v = clip(v, None if low is None else F.lit(low), None if high is None else F.lit(high))
    return points.select(*keys, t.alias("t"), v.alias("v")).groupBy(*keys, "t").agg(F.median("v").alias("v"), F.count("*").alias("vertices"))


def anchors(points: DataFrame, keys: list[str], within: float = 1e-6) -> DataFrame:
    """Adds ``anchor``: the time that stands for a point's own. Going up, a time opens a group unless it is
    less than ``within`` after the one that opened the last, so a chain of near times is cut
    anew at each anchor. A gap of ``within`` or more always opens a group; between two of them all times
    mostly fit one. Only where they don't are the distinct times folded in order."""
    w = W.partitionBy(*keys).orderBy("t")
    island = F.sum(F.when(F.col("t") - F.lag("t").over(w) < F.lit(within), 0).otherwise(1)).over(w.rangeBetween(W.unboundedPreceding, 0))
    made = points.withColumn("__island", island)
    own = W.partitionBy(*keys, "__island")
    made = made.withColumns({"anchor": F.min("t").over(own), "__end": F.max("t").over(own)})
    short = made.where(F.col("__end") - F.col("anchor") < F.lit(within))
    long = made.where(F.col("__end") - F.col("anchor") >= F.lit(within)).drop("anchor")
    opened = F.aggregate(
        F.array_sort(F.collect_set("t")), F.array().cast("array<double>"),
        lambda a, t: F.when((F.size(a) > 0) & (t - F.element_at(a, -1) < F.lit(within)), a).otherwise(F.concat(a, F.array(t))),
    )
    folded = long.groupBy(*keys, "__island").agg(opened.alias("__opened"))
    long = long.join(folded, [*keys, "__island"]).withColumn("anchor", F.array_max(F.filter("__opened", lambda a: a <= F.col("t")))).drop("__opened")
    return short.unionByName(long).drop("__island", "__end")


def collapse_anchored(points: DataFrame, keys: list[str], within: float = 1e-6, places: int = 4) -> DataFrame:
    """Points (keys, t, v) to a series: those of one anchor become its time and the median of their values,
    both rounded. Equal times can remain after rounding, as groups are made before it."""
    made = anchors(points.select(*keys, "t", "v"), keys, within)
    made = made.groupBy(*keys, "anchor").agg(F.median("v").alias("v"), F.count("*").alias("vertices"))
    return made.select(*keys, rounded(F.col("anchor"), places).alias("t"), rounded(F.col("v"), places).alias("v"), "vertices")


def trapezoid(keys: list[str], t: str = "t", v: str = "v") -> Column:
    """The area between a point and the one before it; its sum is the integral."""
    w = W.partitionBy(*keys).orderBy(t)
    return (F.col(v) + F.lag(v).over(w)) / F.lit(2.0) * (F.col(t) - F.lag(t).over(w))


def metrics(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Points, ranges, mean and trapezoid integral of each series."""
    return curve.withColumn("__a", trapezoid(keys)).groupBy(*keys).agg(
        F.count("*").alias("points"), F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.min("v").alias("v_min"), F.max("v").alias("v_max"),
        rounded(F.avg("v"), 4).alias("v_mean"), rounded(F.coalesce(F.sum("__a"), F.lit(0.0)), 4).alias("integral"),
    )


def segments(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Each point with its successor: (keys, t, v, t1, v1); the last one's successor is itself."""
    w = W.partitionBy(*keys).orderBy("t")
    return curve.select(*keys, "t", "v", F.coalesce(F.lead("t").over(w), F.col("t")).alias("t1"), F.coalesce(F.lead("v").over(w), F.col("v")).alias("v1"), F.lead("t").over(w).isNull().alias("last"))


def between(t: Column) -> Column:
    """The value at ``t`` on the segment of the row."""
    return F.when(F.col("t1") == F.col("t"), F.col("v")).otherwise(F.col("v") + (F.col("v1") - F.col("v")) * (t - F.col("t")) / (F.col("t1") - F.col("t")))


def resample(curve: DataFrame, keys: list[str], step: float) -> DataFrame:
    """Values on an even grid 0, step, 2 step ... up to the last time, which ends the grid even when
    it isn't on it; before the first point its value holds. Each segment makes its own grid points,
    so there is no join: one exchange by the keys."""
    ends = W.partitionBy(*keys)
    seg = segments(curve, keys).withColumn("first", F.col("t") == F.min("t").over(ends))
    lo = F.when(F.col("first"), F.lit(0)).otherwise(F.floor(F.col("t") / F.lit(step)))
    hi = F.floor(F.col("t1") / F.lit(step)) + 1
    grid = F.transform(F.sequence(lo.cast("long"), hi.cast("long")), lambda i: i * F.lit(step))
    inside = F.filter(grid, lambda g: ((g >= F.col("t")) | F.col("first")) & ((g < F.col("t1")) | (F.col("last") & (g <= F.col("t1")))))
    end = F.when(F.col("last") & ~F.array_contains(inside, F.col("t1")), F.array(F.col("t1"))).otherwise(F.array().cast("array<double>"))
    made = seg.where("t1 >= 0").withColumn("g", F.explode(F.concat(inside, end)))
    value = F.when(F.col("g") <= F.col("t"), F.col("v")).otherwise(between(F.col("g")))
    return made.select(*keys, F.col("g").alias("t"), value.alias("v"))


def next_known(name: str) -> Column:
    """The next row's value that isn't null, over a window in order. Of rows where it is null it is the first from there on, but
    a frame to the window's end would be read anew for each row."""
    return F.expr(f"lead(`{name}`) IGNORE NULLS")


def at_times(curve: DataFrame, probes: DataFrame, keys: list[str], outside: str = "clamp") -> DataFrame:
    """As-of interpolation: ``probes`` (keys, t) with ``v`` of the curve there. Outside the curve:
    its end values (clamp) or null. One union and one exchange by the keys, no range join."""
    both = curve.select(*keys, "t", "v", F.lit(0).alias("p")).unionByName(probes.select(*keys, "t", F.lit(None).cast("double").alias("v"), F.lit(1).alias("p")))
    # Dealt out here, rows travel without the points, which repeat their times and values.
    both = both.repartition(*keys).withColumn("point", F.when(F.col("p") == 0, F.struct("t", "v")))
    # A curve point at the probe's own time sorts before it.
    w = W.partitionBy(*keys).orderBy("t", "p")
    made = both.withColumns({"a": F.last("point", True).over(w.rowsBetween(W.unboundedPreceding, 0)), "b": next_known("point").over(w)}).where("p = 1")
    inner = F.when((F.col("a.t") == F.col("t")) | (F.col("b.t") == F.col("a.t")), F.col("a.v")).otherwise(
        F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
    )
    if outside == "clamp":
        value = F.when(F.col("a").isNull(), F.col("b.v")).when(F.col("b").isNull(), F.col("a.v")).otherwise(inner)
    else:
        value = F.when(F.col("a").isNotNull() & (F.col("b").isNotNull() | (F.col("a.t") == F.col("t"))), inner)
    return made.select(*keys, "t", value.alias("v"))


def both_at_times(one: DataFrame, two: DataFrame, probes: DataFrame, keys: list[str], outside: str = "clamp") -> DataFrame:
    """``probes`` (keys, t) with the values ``v`` of curve ``one`` and ``w`` of curve ``two`` there, as
    ``at_times`` gives them: a union of all three, one exchange and one sort. A probe comes back as
    often as it was asked, one of a series that a curve lacks with null."""
    tagged = lambda rows, v, p: rows.select(*keys, "t", v.alias("v"), F.lit(p).alias("p"))
    rows = tagged(one, F.col("v"), 0).unionByName(tagged(two, F.col("v"), 1)).unionByName(tagged(probes, F.lit(None).cast("double"), 2))
    # Dealt out here, rows travel without the points, which repeat their times and values.
    rows = rows.repartition(*keys).withColumns({f"__{p}": F.when(F.col("p") == p, F.struct("t", "v")) for p in (0, 1)})
    w = W.partitionBy(*keys).orderBy("t", "p")
    for p, name in ((0, "v"), (1, "w")):
        rows = rows.withColumns({f"__a{name}": F.last(f"__{p}", True).over(w.rowsBetween(W.unboundedPreceding, 0)), f"__b{name}": next_known(f"__{p}").over(w)})

    def value(a: Column, b: Column) -> Column:
        t = F.col("t")
        inner = F.when((a["t"] == t) | (b["t"] == a["t"]), a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (t - a["t"]) / (b["t"] - a["t"]))
        if outside == "clamp":
            return F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(inner)
        return F.when(a.isNotNull() & (b.isNotNull() | (a["t"] == t)), inner)

    made = rows.where("p = 2")
    return made.select(*keys, "t", value(F.col("__av"), F.col("__bv")).alias("v"), value(F.col("__aw"), F.col("__bw")).alias("w"))


def long_table(curves: DataFrame, keys: list[str], totals: DataFrame | None = None, step: float = STEP, flow: str | None = None) -> DataFrame:
    """(keys, t, v) on an even grid, rounded to four places: series of under two points or without a time
    over 0 are left out. ``totals`` (keys but the curve's name, ``total``) are stated totals that curves
    of the name ``flow`` have been scaled to: where a curve's area on the grid is within a thousandth
    of it, its values take up the rest."""
    known = W.partitionBy(*keys)
    worth = curves.withColumns({"__n": F.count("*").over(known), "__end": F.max("t").over(known)}).where("__n > 1 AND __end > 0").drop("__n", "__end")
    grid = resample(worth, keys, step)
    last = F.max("t").over(known)
    grid = grid.withColumn("__last", last).where(~((F.col("t") < F.col("__last")) & (F.col("__last") - F.col("t") <= 1e-9))).drop("__last")
    grid = grid.withColumn("t", rounded(F.col("t"), 4))
    if totals is not None:
        area = grid.withColumn("__a", trapezoid(keys)).withColumn("__area", F.sum("__a").over(known)).drop("__a")
        k = F.when((F.col("curve") == F.lit(flow)) & (F.col("__area") > 0), F.col("total") / F.col("__area"))
        grid = area.join(totals, [c for c in keys if c != "curve"], "left")
        grid = grid.withColumn("v", F.when(F.abs(k - 1.0) <= 1e-3, F.col("v") * k).otherwise(F.col("v")))
    return grid.select(*keys, "t", rounded(F.col("v"), 4).alias("v"))


def scaled_to_total(area: Column, printed: Column, duration: Column, points: Column, slope: Column | None = None, enabled: bool = True) -> tuple[Column, Column]:
    """(scale, reason): a curve is scaled to its printed total if the difference is within what half
    the pen's width can explain; else the reason says why not."""
    half_pen = F.lit(HALF_PEN_KG) if slope is None else F.coalesce(F.abs(slope) * F.lit(HALF_PEN_POINTS), F.lit(HALF_PEN_KG))
    reason = (
        F.when((points < 2) | printed.isNull() | (printed <= 0), "no_printed_weight")
        .when(area.isNull() | (area <= 0), "no_area")
        .when(F.lit(not enabled), "disabled")
        .when(F.abs(printed - area) > half_pen * duration * F.lit(PEN_SLACK), "exceeds_pen_width")
        .otherwise("applied")
    )
    return F.when(reason == "applied", printed / area).otherwise(F.lit(1.0)), reason


def tail_mean(curve: DataFrame, keys: list[str], axis_end: float, width: float = 1.0, above: float = 0.10) -> DataFrame:
    """Whether a series is still above a level where the axis ends."""
    last = F.max("t").over(W.partitionBy(*keys))
    made = curve.withColumn("__last", last)
    made = made.groupBy(*keys).agg(F.max("__last").alias("t_last"), F.avg(F.when(F.col("t") >= F.col("__last") - F.lit(width), F.col("v"))).alias("tail"))
    return made.select(*keys, "t_last", rounded(F.col("tail"), 8).alias("tail_mean"), ((F.col("t_last") >= F.lit(axis_end - 1e-6)) & (F.col("tail") > F.lit(above))).alias("reaches_axis_end"))


def threshold_stats(curve: DataFrame, keys: list[str], threshold: float = END_OF_FLOW) -> DataFrame:
    """Peak, its time (the first), and how long the series lasts above a threshold."""
    over = F.when(F.col("v") >= F.lit(threshold), F.col("t"))
    return curve.groupBy(*keys).agg(
        F.max("v").alias("peak"), F.min_by("t", F.struct(-F.col("v"), F.col("t"))).alias("peak_t"), F.coalesce(F.max(over) - F.min(over), F.lit(0.0)).alias("duration"), F.count(over).alias("points_above")
    )


def session_stats(curves: DataFrame, keys: list[str], flow: str, pressure: str, threshold: float = END_OF_FLOW) -> DataFrame:
    """Of each session's curves (keys, curve, t, v): the flow's peak, how long it lasts above the threshold and its
    area (the estimated yield), and the pressure's mean. A session without one of them has nulls."""
    is_flow, is_pressure = F.col("curve") == F.lit(flow), F.col("curve") == F.lit(pressure)
    over = F.when(is_flow & (F.col("v") >= F.lit(threshold)), F.col("t"))
    made = curves.withColumn("__a", trapezoid([*keys, "curve"]))
    return made.groupBy(*keys).agg(
        F.max(F.when(is_flow, F.col("v"))).alias("peak"), F.when(F.count(F.when(is_flow, 1)) > 0, F.coalesce(F.max(over) - F.min(over), F.lit(0.0))).alias("duration"),
        rounded(F.sum(F.when(is_flow, F.coalesce("__a", F.lit(0.0)))), 4).alias("estimated_yield"), rounded(F.avg(F.when(is_pressure, F.col("v"))), 4).alias("mean_pressure"),
    )


def even_sample(curve: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most ``most`` points at evenly spaced ranks, the first and the last among them."""
    w = W.partitionBy(*keys)
    made = curve.withColumn("__i", F.row_number().over(w.orderBy("t")) - 1).withColumn("__n", F.count("*").over(w))
    k = F.least(F.col("__n"), F.lit(most))
    # Rank i is picked when some sample number j has floor(j (n - 1) / (k - 1)) = i.
    j = F.ceil(F.col("__i") * (k - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
    picked = (F.col("__n") == 1) | ((j < k) & (F.floor(j * (F.col("__n") - 1) / F.greatest(k - 1, F.lit(1))) == F.col("__i")))
    return made.where(picked).drop("__i", "__n")
