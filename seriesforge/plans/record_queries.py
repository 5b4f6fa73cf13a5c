"""Queries on headers, names, matches and what is missing, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from seriesforge.functions.scalars import header_fields, is_tick_label, rounded
from seriesforge.operators import matching
from seriesforge.sources.tables import table


def headers(spark, d):
    """Header texts made of orders, some of them in the other styles or damaged."""
    o = table(spark, d, "orders")
    kg = F.format_string("%d.%02d", F.floor(F.col("o_totalprice") / 1000).cast("int"), (F.col("o_orderkey") % 100).cast("int"))
    kg = F.when(F.col("o_orderkey") % 7 == 0, F.replace(kg, F.lit("."), F.lit(","))).when(F.col("o_orderkey") % 23 == 0, F.lit("1.234,5")).otherwise(kg)
    day, hour = F.date_format("o_orderdate", "dd.MM.yyyy"), F.format_string("%d:%02d", (F.col("o_custkey") % 24).cast("int"), (F.col("o_orderkey") % 60).cast("int"))
    label = F.when(F.col("o_orderkey") % 5 == 0, F.lit("ID: ")).when(F.col("o_orderkey") % 17 == 0, F.lit("Capo: ")).otherwise(F.lit("Animale: "))
    when = F.when(F.col("o_orderkey") % 3 == 0, F.concat(hour, F.lit(":05"))).otherwise(hour)
    text = F.concat(F.lit("Numero Azienda 07010142  "), label, F.col("o_custkey"), F.lit("\nData: "), day, F.lit(" Ora: "), when, F.lit(" Quantita di latte: "), kg, F.lit(" kg GNR: 0"), F.col("o_orderkey") % 1000, F.lit(" BIMO = 1 LE     = 0"))
    return o.select("o_orderkey", text.alias("text"))


def header_parse(spark, d):
    return headers(spark, d).select("o_orderkey", *[c.alias(n) for n, c in header_fields(F.col("text")).items()])


def header_scan_documents(spark, d):
    """Dates, times and weights that plain texts happen to hold."""
    t = F.coalesce("text", F.lit(""))
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("long")
    rows = table(spark, d, "documents").select("source", count(r"[0-9]{1,2}[.\-/][0-9]{1,2}[.\-/][0-9]{2,4}").alias("a"), count(r"[0-9]{1,2}:[0-9]{2}").alias("b"), count(r"[0-9.,]+ kg").alias("c"))
    return rows.groupBy("source").agg(F.sum("a").alias("dates"), F.sum("b").alias("times"), F.sum("c").alias("weights"))


def header_lookahead(spark, d):
    """A turn is joined with the next one or two when they follow at once."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    one, two = F.lead("n", 1).over(w), F.lead("n", 2).over(w)
    total = F.col("n") + F.coalesce(one, F.lit(0)) + F.when(F.col("turn") % 2 == 0, F.coalesce(two, F.lit(0))).otherwise(F.lit(0))
    return rows.select("conv_id", "turn", total.cast("long").alias("n_merged"))


def tick_labels(spark, d):
    """Rows whose text is one or two digits once trimmed."""
    o = table(spark, d, "orders").withColumn("label", F.concat(F.lit(" "), (F.col("o_orderkey") % 250).cast("string"), F.lit("  ")))
    return o.where(is_tick_label(F.col("label"))).select("o_orderkey", F.trim("label").cast("int").alias("tick"))


def perturbed(orders):
    """Every 9th order in another status, every 12th dearer, every 15th without a price."""
    price = F.when(F.col("o_orderkey") % 15 == 0, None).when(F.col("o_orderkey") % 12 == 0, F.col("o_totalprice") + 0.01).otherwise(F.col("o_totalprice"))
    status = F.when(F.col("o_orderkey") % 9 == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))
    return orders.where("o_orderkey % 31 <> 0").select("o_orderkey", status.alias("status"), price.alias("price"))


def metadata_diff(spark, d):
    o = table(spark, d, "orders")
    both = o.join(matching.last_wins(perturbed(o), ["o_orderkey"], "price"), "o_orderkey", "left")
    fields = matching.differing([("status", F.col("o_orderstatus"), F.col("status"), None), ("price", F.col("o_totalprice"), F.col("price"), 1e-9)])
    made = both.select("o_orderkey", F.array_join(fields, ",").alias("differs"))
    return made.where("differs <> ''")


def sessions(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", day.alias("day"))
    hhmm = F.when(F.col("o_orderkey") % 2 == 0, F.lpad((F.col("o_orderkey") % 2400).cast("string"), 4, "0"))
    name = F.concat(F.lit("animal_"), F.col("o_custkey"), F.lit("_"), F.col("day"))
    return matching.session_names(o, ["o_custkey", "day"], ["o_orderkey"], name, hhmm)


def session_naming(spark, d):
    return sessions(spark, d).select("o_orderkey", "csv_name")


def best_match_file(spark, d):
    """For each order the file of its customer and day: its own time's, else the plain name, else
    the first."""
    files = sessions(spark, d).select("o_custkey", "day", "csv_name")
    wanted = sessions(spark, d).select("o_orderkey", "o_custkey", "day", F.concat(F.lit("_"), F.lpad((F.col("o_orderkey") % 2400).cast("string"), 4, "0"), F.lit(".csv")).alias("tail"))
    priority = F.when(F.col("csv_name").isNull(), 4).when(F.endswith(F.col("csv_name"), F.col("tail")), 1).when(F.length("csv_name") == F.length(F.concat(F.lit("animal_"), F.col("o_custkey"), F.lit("_"), F.col("day"), F.lit(".csv"))), 2).otherwise(3)
    return matching.best_match(wanted, files, ["o_custkey", "day"], ["o_orderkey"], priority, "csv_name").select("o_orderkey", "csv_name", "priority")


def positional_match(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    left = o.select("o_custkey", "o_orderkey")
    right = o.where("o_orderkey % 4 <> 0").select("o_custkey", F.col("o_orderkey").alias("result"), "o_orderdate")
    return matching.positional(left, right, "o_custkey", ["o_orderkey"], ["o_orderdate", "result"], "left").select("o_custkey", "k", "o_orderkey", "result")


def missing_sessions(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return matching.missing(c, o, ["c_custkey"]).select("c_custkey", "c_name")


def file_or_fallback(spark, d):
    """The named file, else the timed one, else missing."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    base = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.concat(F.lit("base_"), "o_orderkey").alias("base"))
    timed = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.concat(F.lit("timed_"), "o_orderkey").alias("timed"))
    return o.join(base, "o_orderkey", "left").join(timed, "o_orderkey", "left").select("o_orderkey", F.coalesce("base", "timed", F.lit("MISSING")).alias("file"))


def files_on_disk(spark, d):
    """Names that exist; if none does, all that exist."""
    named, there = table(spark, d, "labels").select("doc_id").distinct(), table(spark, d, "documents").where("doc_id % 2 = 0").select("doc_id").distinct()
    both = named.join(there, "doc_id", "left_semi")
    some = both.limit(1).agg((F.count("*") > 0).alias("some"))  # one row
    return both.unionByName(there.join(F.broadcast(some), ~F.col("some")).drop("some"))


def progress(spark, d):
    """How far a set of reports is: files of all expected, eight a page."""
    o = sessions(spark, d).withColumn("report", F.col("o_custkey") % 10)
    return o.groupBy("report").agg(F.count("*").alias("files"), (F.countDistinct("day") * 8).alias("expected"))


def file_types(spark, d):
    """Uploads by what their name ends in."""
    u = table(spark, d, "pages").select(F.lower(F.regexp_extract("url", r"\.([A-Za-z]{2,4})(?:[/?#]|$)", 1)).alias("ext"))
    return u.groupBy("ext").agg(F.count("*").alias("n"), F.max(F.col("ext").isin("com", "org")).alias("accepted"))


def results_payload(spark, d):
    """Projection of results with defaults for what is absent."""
    o = table(spark, d, "orders")
    source = F.when(F.col("o_orderkey") % 4 == 0, None).otherwise(F.lit("vector"))
    return o.select("o_orderkey", F.coalesce(source, F.lit("cv")).alias("source"), F.coalesce(F.when(F.col("o_orderkey") % 6 == 0, None).otherwise(rounded(F.col("o_totalprice"), 1)), F.lit(0.0)).alias("value"))


def union_of_curves(spark, d):
    """One long table of two kinds of curve."""
    li = table(spark, d, "lineitem")
    flow = li.where("l_returnflag = 'R'").select(F.lit("Flusso_kg_min").alias("curve"), F.col("l_quantity").alias("value"))
    pressure = li.where("l_returnflag <> 'R'").select(F.lit("Pressione_assoluta_0.1bar").alias("curve"), F.col("l_discount").alias("value"))
    return flow.unionByName(pressure).groupBy("curve").agg(F.count("*").alias("n"), F.min("value").alias("v_min"), F.max("value").alias("v_max"))


QUERIES = {f.__name__: f for f in (
    header_parse, header_scan_documents, header_lookahead, tick_labels, metadata_diff, session_naming, best_match_file, positional_match, missing_sessions, file_or_fallback, files_on_disk,
    progress, file_types, results_payload, union_of_curves,
)}

SESSIONS_SQL = """o AS (SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m-%d') ORDER BY o_orderkey) - 1 AS n FROM orders),
sessions AS (SELECT o_orderkey, o_custkey, day, 'animal_' || o_custkey || '_' || day || CASE WHEN n = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN '_' || lpad(CAST(o_orderkey % 2400 AS VARCHAR), 4, '0') ELSE '_' || lpad(CAST(n AS VARCHAR), 4, '0') END || '.csv' AS csv_name FROM o)"""

ORACLE_SQL = {
    "header_parse": """WITH h AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN 1 WHEN o_orderkey % 23 = 0 THEN 2 ELSE 0 END AS style FROM orders)
      SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 17 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS animal_id, strftime(o_orderdate, '%Y-%m-%d') AS date_iso,
        strftime(o_orderdate, '%d.%m.%Y') AS date_printed,
        lpad(CAST(o_custkey % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || CASE WHEN o_orderkey % 3 = 0 THEN ':05' ELSE '' END AS time_full,
        lpad(CAST(o_custkey % 24 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS time_hhmm, CASE WHEN o_orderkey % 3 = 0 THEN '05' END AS seconds,
        CASE WHEN style < 2 THEN CAST(CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) || '.' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS DOUBLE) END AS milk_kg,
        '07010142' AS farm, '0' || CAST(o_orderkey % 1000 AS VARCHAR) AS gnr, '1' AS bimo, '0' AS le FROM h""",
    "header_scan_documents": r"""SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[0-9]{1,2}[.\-/][0-9]{1,2}[.\-/][0-9]{2,4}'))) AS BIGINT) AS dates,
      CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[0-9]{1,2}:[0-9]{2}'))) AS BIGINT) AS times, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[0-9.,]+ kg'))) AS BIGINT) AS weights FROM documents GROUP BY source""",
    "header_lookahead": """SELECT conv_id, turn, CAST(length(text) + coalesce(lead(length(text), 1) OVER w, 0) + CASE WHEN turn % 2 = 0 THEN coalesce(lead(length(text), 2) OVER w, 0) ELSE 0 END AS BIGINT) AS n_merged
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "tick_labels": "SELECT o_orderkey, CAST(o_orderkey % 250 AS INTEGER) AS tick FROM orders WHERE o_orderkey % 250 < 100",
    "metadata_diff": """WITH p AS (SELECT o_orderkey, o_orderkey % 31 <> 0 AS there FROM orders), x AS (SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 9 = 0 AND o_orderstatus <> 'X' OR NOT there THEN 'status' END,
      CASE WHEN o_orderkey % 15 = 0 OR o_orderkey % 12 = 0 OR NOT there THEN 'price' END) AS differs FROM orders JOIN p USING (o_orderkey)) SELECT * FROM x WHERE differs <> ''""",
    "session_naming": f"WITH {SESSIONS_SQL} SELECT o_orderkey, csv_name FROM sessions",
    "best_match_file": f"""WITH {SESSIONS_SQL}, m AS (SELECT a.o_orderkey, b.csv_name, CASE WHEN ends_with(b.csv_name, '_' || lpad(CAST(a.o_orderkey % 2400 AS VARCHAR), 4, '0') || '.csv') THEN 1
      WHEN b.csv_name = 'animal_' || a.o_custkey || '_' || a.day || '.csv' THEN 2 ELSE 3 END AS priority FROM sessions a JOIN sessions b ON a.o_custkey = b.o_custkey AND a.day = b.day)
      SELECT o_orderkey, csv_name, CAST(priority AS INTEGER) AS priority FROM m QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY priority, csv_name) = 1""",
    "positional_match": """WITH l AS (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS k FROM orders),
      r AS (SELECT o_custkey, o_orderkey AS result, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS k FROM orders WHERE o_orderkey % 4 <> 0)
      SELECT l.o_custkey, l.k, l.o_orderkey, r.result FROM l LEFT JOIN r ON l.o_custkey = r.o_custkey AND l.k = r.k""",
    "missing_sessions": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)",
    "file_or_fallback": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'base_' || o_orderkey WHEN o_orderkey % 2 = 0 THEN 'timed_' || o_orderkey ELSE 'MISSING' END AS file FROM orders",
    "files_on_disk": "SELECT DISTINCT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)",
    "progress": f"WITH {SESSIONS_SQL} SELECT o_custkey % 10 AS report, count(*) AS files, count(DISTINCT day) * 8 AS expected FROM sessions GROUP BY 1",
    "file_types": r"WITH u AS (SELECT lower(regexp_extract(url, '\.([A-Za-z]{2,4})(?:[/?#]|$)', 1)) AS ext FROM pages) SELECT ext, count(*) AS n, max(ext IN ('com', 'org')) AS accepted FROM u GROUP BY ext",
    "results_payload": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'cv' ELSE 'vector' END AS source, CASE WHEN o_orderkey % 6 = 0 THEN 0e0 ELSE floor(o_totalprice * 1e1 + 5e-1) / 1e1 END AS value FROM orders",
    "union_of_curves": """SELECT CASE WHEN l_returnflag = 'R' THEN 'Flusso_kg_min' ELSE 'Pressione_assoluta_0.1bar' END AS curve, count(*) AS n,
      min(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE l_discount END) AS v_min, max(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE l_discount END) AS v_max FROM lineitem GROUP BY 1""",
}
