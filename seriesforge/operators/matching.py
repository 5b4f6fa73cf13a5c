"""Names, ranked and positional matches, differences and what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seriesforge.functions.scalars import header_fields


def session_names(rows: DataFrame, base: list[str], order: list[str], name: Column, suffix: Column) -> DataFrame:
    """Adds ``csv_name``: the first of a base gets its name, later ones a suffix (or a number)."""
    n = F.row_number().over(W.partitionBy(*base).orderBy(*order)) - 1
    tail = F.coalesce(suffix, F.lpad(n.cast("string"), 4, "0"))
    return rows.withColumn("csv_name", F.when(n == 0, F.concat(name, F.lit(".csv"))).otherwise(F.concat(name, F.lit("_"), tail, F.lit(".csv"))))


def best_match(wanted: DataFrame, candidates: DataFrame, on: list[str], key: list[str], priority: Column, order: str) -> DataFrame:
    """Left join that keeps, for each wanted row, the candidate of the lowest priority number."""
    both = wanted.join(candidates, on, "left").withColumn("priority", priority)
    rank = F.row_number().over(W.partitionBy(*key).orderBy("priority", order))
    return both.withColumn("__r", rank).where("__r = 1").drop("__r")


def positional(left: DataFrame, right: DataFrame, key: str, left_order: list[str], right_order: list[str], how: str = "inner") -> DataFrame:
    """The k-th row of a key on the left with the k-th on the right."""
    number = lambda order: F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("int")
    return left.withColumn("k", number(left_order)).join(right.withColumn("k", number(right_order)), [key, "k"], how)


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the last in order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("__r", rank).where("__r = 1").drop("__r")


def differing(pairs: list[tuple[str, Column, Column, float | None]]) -> Column:
    """Names of the fields that differ: texts unless equal or both null, numbers beyond a tolerance
    or missing on either side."""
    found = []
    for name, a, b, tolerance in pairs:
        same = a.eqNullSafe(b) if tolerance is None else F.coalesce(F.abs(a - b) <= F.lit(tolerance), F.lit(False))
        found.append(F.when(~same, F.lit(name)))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def missing(wanted: DataFrame, there: DataFrame, on: list[str]) -> DataFrame:
    """Rows that nothing answers: reported, never averaged away."""
    return wanted.join(there, on, "left_anti")


def prefix_matches(wanted: DataFrame, names: DataFrame, prefix: str, name: str) -> DataFrame:
    """Left join of ``wanted`` with the ``names`` that start with its ``prefix``. Each name is entered under those of
    its own beginnings that are as long as some prefix, so the join is on equal texts. Beginnings are
    many times the names, which no estimate of sizes sees, so they are dealt out and never broadcast.
    ``wanted`` is read twice."""
    lengths = wanted.select(F.length(prefix).alias("__n")).distinct()
    starts = names.join(F.broadcast(lengths), F.col("__n") <= F.length(name)).withColumn("__start", F.substring(F.col(name), F.lit(1), F.col("__n"))).drop("__n")
    return wanted.join(starts.hint("merge"), F.col(prefix) == F.col("__start"), "left").drop("__start")


def session_file(wanted: DataFrame, files: DataFrame, key: list[str], prefix: str, time: str, name: str = "file") -> DataFrame:
    """For each wanted session (``key``, ``prefix`` without the ending, ``time`` or null) its file: the only one that
    starts with the prefix; else the one that ends with the time; else the plain name; else the
    first in order. Null where there is none. Adds ``matches`` and ``priority`` (1 only or time, 2
    plain, 3 first, 4 none)."""
    both = prefix_matches(wanted, files.select(name).distinct(), prefix, name)
    n = F.count(name).over(W.partitionBy(*key))
    timed = F.endswith(F.col(name), F.concat(F.lit("_"), F.col(time), F.lit(".csv")))
    plain = F.col(name) == F.concat(F.col(prefix), F.lit(".csv"))
    priority = F.when(F.col(name).isNull(), 4).when((F.col("matches") == 1) | F.coalesce(timed, F.lit(False)), 1).when(plain, 2).otherwise(3)
    ranked = both.withColumn("matches", n).withColumn("priority", priority)
    rank = F.row_number().over(W.partitionBy(*key).orderBy("priority", name))
    return ranked.withColumn("__r", rank).where("__r = 1").drop("__r")


def header_lines(text: Column, most: int = 8, ahead: int = 3, skip: int = 2) -> Column:
    """Headers read line by line from a page's text: an array of at most ``most`` structs (animal_id, date_iso,
    time_hhmm), filled up with nulls. A line with an animal's number opens a header, whose other
    fields may be in it or the lines after it (``ahead`` in all); reading goes on ``skip`` lines below it.
    Lines are folded in order with the next line to look at as state; a null text has no header."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    marked = F.transform(lines, lambda s: header_fields(s)["animal_id"].isNotNull())
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("at"))

    def step(state: Column, i: Column) -> Column:
        opens = (i >= state["next"]) & (F.size(state["at"]) < most) & F.get(marked, i)
        return F.when(opens, F.struct((i + skip).alias("next"), F.concat(state["at"], F.array(i)).alias("at"))).otherwise(state)

    at = F.aggregate(F.sequence(F.lit(0), F.size(lines) - 1), start, step, lambda state: state["at"])

    def fields(i: Column) -> Column:
        block = header_fields(F.array_join(F.slice(lines, i + 1, ahead), " "))
        own = header_fields(F.get(lines, i))["animal_id"]
        return F.struct(own.alias("animal_id"), block["date_iso"].alias("date_iso"), block["time_hhmm"].alias("time_hhmm"))

    none = F.lit(None).cast("struct<animal_id string, date_iso string, time_hhmm string>")
    return F.concat(F.transform(at, fields), F.array_repeat(none, F.lit(most) - F.size(at)))


#: The fields that a report prints with a chart.
FIELDS = ("farm", "animal_id", "date_iso", "date_printed", "time_full", "milk_kg", "gnr", "bimo", "le")


def metadata_check(extracted: DataFrame, truth: DataFrame, key: list[str], order: str) -> DataFrame:
    """What was read of each chart (``key`` and ``header_fields``) against the printed text's own ``strict_fields``
    (``truth``, of which only complete ones count), by animal and time; of several true ones the last in
    ``order``. (key, animal_id, time_full, matched, differs): the names of the fields that differ, in order;
    a chart that nothing matches fails with none."""
    # Read in this order a text is given up at the first field that it lacks; a weight that is no number is none.
    complete = truth.where("animal_id IS NOT NULL AND time_full IS NOT NULL AND date_iso IS NOT NULL AND nanvl(milk_kg, NULL) IS NOT NULL")
    complete = complete.withColumn("time_hhmm", F.concat(F.substring("time_full", 1, 2), F.substring("time_full", 4, 2)))
    same = ["animal_id", "time_hhmm"]
    known = last_wins(complete, same, order).select(*same, F.struct(*FIELDS).alias("t"), F.lit(True).alias("matched"))
    both = extracted.join(known, same, "left")
    fields = differing([(n, F.col(n), F.col(f"t.{n}"), 1e-9 if n == "milk_kg" else None) for n in FIELDS])
    matched = F.coalesce("matched", F.lit(False))
    return both.select(*key, "animal_id", "time_full", matched.alias("matched"), F.when(matched, fields).otherwise(F.array().cast("array<string>")).alias("differs"))
