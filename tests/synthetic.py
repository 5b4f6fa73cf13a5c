"""Made-up curves: sessions of several kinds as piecewise expressions over a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: For each kind, where flow has risen, begins to fall, and ends (minutes), and its height.
KINDS = {"normal": (1.0, 4.0, 7.5, 4.0), "short": (0.5, 1.5, 3.0, 3.0), "low": (1.5, 4.0, 7.0, 1.2), "long": (1.0, 6.5, 9.6, 3.5), "truncated": (1.0, 9.0, 14.0, 3.8)}


def flow_curves(spark: SparkSession, n: int, step: float = 0.0454, seed: int = 11) -> DataFrame:
    """``n`` sessions (chart, kind, t, v): a rise, a plateau and a fall with a little noise, cut at
    ten minutes."""
    names = list(KINDS)
    shape = F.element_at(F.array(*[F.struct(F.lit(k).alias("kind"), *[F.lit(v).alias(c) for c, v in zip(("up", "down", "end", "top"), KINDS[k])]) for k in names]), (F.col("chart") % len(names) + 1).cast("int"))
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(int(10 / step))), lambda i: i * F.lit(step))).alias("t")
    rows = spark.range(n).withColumnRenamed("id", "chart").select("chart", shape.alias("s"), grid)
    t, s = F.col("t"), F.col("s")
    level = F.when(t < s["up"], t / s["up"]).when(t <= s["down"], F.lit(1.0)).when(t < s["end"], (s["end"] - t) / (s["end"] - s["down"])).otherwise(F.lit(0.0))
    noise = (F.pmod(F.xxhash64(F.lit(seed), "chart", "t"), F.lit(2001)) - 1000) / 50_000.0
    return rows.select("chart", F.col("s.kind").alias("kind"), "t", F.greatest(level * s["top"] + F.when(level > 0, noise).otherwise(0.0), F.lit(0.0)).alias("v"))


def pressure_curves(spark: SparkSession, n: int, step: float = 0.1863, level: float = 4.4) -> DataFrame:
    """``n`` pressure series (chart, t, v): a fast rise to a level with a slow swing."""
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(int(10 / step))), lambda i: i * F.lit(step))).alias("t")
    rows = spark.range(n).withColumnRenamed("id", "chart").select("chart", grid)
    return rows.select("chart", "t", (F.least(F.col("t") * 10, F.lit(1.0)) * F.lit(level) + F.sin(F.col("t") + F.col("chart")) * 0.1).alias("v"))
