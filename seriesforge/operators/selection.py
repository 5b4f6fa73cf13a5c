"""Order statistics of groups of any size: exact, without collecting a group.

Equal values are counted first, so a group shrinks to its distinct values, dealt out by value. A histogram
over even buckets of a group's range says which bucket holds the wanted rank; only that bucket's
values are put in order. Every sum is over counts, and a group's values are never an array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BUCKETS = 1 << 16


def upper(n: Column) -> Column:
    """The rank (from 0) of the upper median of n values."""
    return F.floor(n / 2)


def lower(n: Column) -> Column:
    return F.floor((n - 1) / 2)


def selected(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], buckets: int = BUCKETS) -> DataFrame:
    """(keys, and a column for each of ``ranks``): of each group's values, in order, the one at the rank (from 0)
    that its function makes of their number; null where there is none. Null and NaN values don't
    count; groups without any are absent, null keys make a group."""
    same = {k: f"__k{i}" for i, k in enumerate(keys)}
    own = list(same.values())
    x = F.col(value).cast("double")
    counts = rows.select(*[F.struct(F.col(k)).alias(a) for k, a in same.items()], x.alias("__x")).where("__x is not null and not isnan(__x)")
    counts = counts.groupBy(*own, "__x").agg(F.count("*").alias("__n"))
    span = counts.groupBy(*own).agg(F.min("__x").alias("__low"), F.max("__x").alias("__high"), F.sum("__n").alias("__all"))
    part = F.when(F.col("__high") > F.col("__low"), (F.col("__x") - F.col("__low")) / (F.col("__high") - F.col("__low"))).otherwise(F.lit(0.0))
    placed = counts.join(span, own).withColumn("__bucket", F.least(F.floor(part * buckets), F.lit(buckets - 1)))
    before = lambda w: F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")
    filled = placed.groupBy(*own, "__bucket", "__all").agg(F.sum("__n").alias("__n"))
    filled = filled.withColumn("__before", before(W.partitionBy(*own).orderBy("__bucket")))
    wanted = F.inline(F.array(*[F.struct(F.lit(n).alias("__name"), f(F.col("__all")).cast("long").alias("__rank")) for n, f in ranks.items()]))
    hit = filled.select(*own, "__bucket", "__n", "__before", wanted).where("__rank >= __before AND __rank < __before + __n")
    inside = placed.select(*own, "__bucket", "__x", "__n").join(hit.drop("__n"), [*own, "__bucket"])
    order = W.partitionBy(*own, "__bucket", "__name").orderBy("__x")
    found = inside.withColumn("__upto", F.col("__before") + before(order)).where("__rank >= __upto AND __rank < __upto + __n")
    out = found.groupBy(*own).agg(*[F.max(F.when(F.col("__name") == n, F.col("__x"))).alias(n) for n in ranks])
    return out.select(*[F.col(a)[k].alias(k) for k, a in same.items()], *ranks)


def middle(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median): the mean of the two middle values, or the one in the middle."""
    both = selected(rows, keys, value, {"__lower": lower, "__upper": upper})
    return both.select(*keys, ((F.col("__lower") + F.col("__upper")) / 2).alias("median"))
