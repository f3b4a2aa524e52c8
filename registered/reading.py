from __future__ import annotations

from pyspark.sql import functions as F

from registered import joined, query, rounded
from registered.profiles import union
from registered.tables import EVENTS_WITH_GAPS, events_with_gaps, place
from seriesloom.functions import text
from seriesloom.operators import profile
from seriesloom.sources import catalog, evidence, files, increments, runlog
from seriesloom.streaming import alerts, jobs, sketches


def orders_csv(t) -> tuple:
    orders = t("orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    path = place(orders.sparkSession, "orders-csv")
    files.write_cleaned(orders, path, "csv")
    return orders.sparkSession, path


@query("scan_csv", "SELECT * FROM orders")
def scan_csv(t):
    spark, path = orders_csv(t)
    return files.scan_csv(spark, path).withColumns({
        "o_orderkey": F.col("o_orderkey").cast("long"), "o_custkey": F.col("o_custkey").cast("long"), "o_orderdate": F.col("o_orderdate").cast("timestamp_ntz")})


@query("scan_uploaded_csv", "SELECT 'o_totalprice' AS \"column\", 'numeric' AS kind, count(DISTINCT o_totalprice) AS unique_values FROM orders UNION ALL SELECT 'o_orderpriority', 'categorical', count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'o_orderdate', 'datetime', count(DISTINCT o_orderdate) FROM orders")
def scan_uploaded_csv(t):
    spark, path = orders_csv(t)
    found = profile.column_profile(files.scan_csv(spark, path), "upload").select("column", "kind", "unique_values")
    return found.where(F.col("column").isin("o_totalprice", "o_orderpriority", "o_orderdate"))


def folders(t) -> tuple:
    """Three dataset folders of several CSV files each, written from the tables."""
    spark = t("orders").sparkSession
    root = place(spark, "datasets")
    for name, table in (("acme__daily-store-orders", "orders"), ("acme__big_customer-list", "customer"), ("shop--energy-parts", "part")):
        t(table).repartition(3).write.option("header", True).csv(f"{root}/{name}")
    return spark, root


@query("largest_file", """SELECT 'acme__daily-store-orders' AS folder, count(*) > 0 AS has_bytes, count(*) * 20 < 1000000000000 AS bounded FROM orders""")
def largest_file(t):
    spark, root = folders(t)
    return files.largest_file(spark, root).select(
        F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("folder"), (F.col("length") > 0).alias("has_bytes"), (F.col("length") < 1000000000000).alias("bounded"))


@query("file_shape", "SELECT 'orders' AS name, 6 AS columns, count(*) AS rows FROM orders UNION ALL SELECT 'customer', 5, count(*) FROM customer UNION ALL SELECT 'part', 6, count(*) FROM part")
def file_shape(t):
    spark, root = folders(t)
    name = F.when(F.col("path").contains("orders"), "orders").when(F.col("path").contains("customer"), "customer").otherwise("part")
    return files.file_shapes(spark, root).groupBy(name.alias("name")).agg(F.max("columns").alias("columns"), F.sum("rows").alias("rows"))


@query("file_shape_quoted", """SELECT 3 AS columns, count(*) AS rows FROM documents""")
def file_shape_quoted(t):
    """Texts with line breaks, commas and quotes, below a header with a comma."""
    docs = t("documents").select("doc_id", F.col("text").alias("text, as it stands"), "source")
    path = place(docs.sparkSession, "quoted")
    docs.write.option("header", True).option("escape", '"').csv(path)
    return files.file_shapes(docs.sparkSession, path).agg(F.max("columns").alias("columns"), F.sum("rows").alias("rows"))


@query("scan_csv_mixed", """SELECT doc_id, lang, source, n_chars FROM documents""")
def scan_csv_mixed(t):
    """Two folders of one table in two encodings, read as one."""
    docs = t("documents").select("doc_id", F.concat("lang", F.lit("-caf\u00e9")).alias("lang"), "source", "n_chars")
    path = place(docs.sparkSession, "mixed")
    docs.where("doc_id % 2 = 0").write.option("header", True).csv(path)
    docs.where("doc_id % 2 = 1").write.option("header", True).option("encoding", "ISO-8859-1").mode("append").csv(path)
    return files.scan_csv(docs.sparkSession, path).withColumn("lang", F.regexp_replace("lang", "-caf\u00e9$", ""))


@query("build_catalog", """SELECT 'acme--daily-store-orders' AS id, 'acme/daily-store-orders' AS ref, 'Daily Store Orders' AS title, 'finance' AS domain, true AS is_time_series, count(*) > 0 AS whole, 6 AS column_count FROM orders
UNION ALL SELECT 'acme--big_customer-list', 'acme/big_customer-list', 'Big Customer List', 'general', false, count(*) > 0, 5 FROM customer UNION ALL SELECT 'shop--energy-parts', 'shop/energy-parts', 'Energy Parts', 'finance', false, count(*) > 0, 6 FROM part""")
def build_catalog(t):
    """The row count is that of the folder's largest file, one of three."""
    spark, root = folders(t)
    sizes = {n: t(n).count() for n in ("orders", "customer", "part")}
    rows = F.when(F.col("id").contains("orders"), sizes["orders"]).when(F.col("id").contains("customer"), sizes["customer"]).otherwise(sizes["part"])
    whole = F.abs(F.col("row_count") * 3 / rows - 1) < 0.2
    return catalog.build_catalog(spark, root).select("id", "ref", "title", "domain", "is_time_series", whole.alias("whole"), "column_count")


@query("load_frame_cached", "SELECT o_orderpriority, count(*) AS rows, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def load_frame_cached(t):
    spark, path = orders_csv(t)
    cache = files.FrameCache(spark)
    first, again = cache.load(f"{path}/*.csv"), cache.load(f"{path}/*.csv")
    assert first is again
    out = first.groupBy("o_orderpriority").agg(F.count("*").alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return out


@query("write_cleaned", f"SELECT * FROM {EVENTS_WITH_GAPS}")
def write_cleaned(t):
    frame = events_with_gaps(t)
    path = place(frame.sparkSession, "cleaned")
    files.write_cleaned(frame, path)
    return frame.sparkSession.read.parquet(path)


@query("write_report", f"""SELECT 'events' AS meta_dataset, c AS "column", m AS missing FROM (SELECT 'user_id' AS c, count(*) - count(user_id) AS m FROM {EVENTS_WITH_GAPS} UNION ALL SELECT 'event_type', count(*) - count(event_type) FROM {EVENTS_WITH_GAPS} UNION ALL SELECT 'value', count(*) - count(value) FROM {EVENTS_WITH_GAPS})""")
def write_report(t):
    frame = events_with_gaps(t)
    path = place(frame.sparkSession, "report")
    files.write_report(profile.missing_report(frame), path, dataset="events")
    return files.read_report(frame.sparkSession, path).select("meta_dataset", "column", "missing")


@query("write_evidence", """SELECT lang, count(*) AS chunks FROM documents GROUP BY 1""")
def write_evidence(t):
    docs = t("documents")
    path = place(docs.sparkSession, "evidence")
    chunks = docs.select(F.concat(F.lit("docs-"), "lang").alias("evidence_id"), F.col("doc_id").cast("string").alias("kind"), "text")
    evidence.write_evidence(chunks, path)
    stored = evidence.read_evidence(docs.sparkSession, path)
    return stored.groupBy(F.substring("evidence_id", 6, 10).alias("lang")).agg(F.count("*").alias("chunks"))


@query("clear_evidence", "SELECT 'before' AS state, count(*) AS chunks FROM documents UNION ALL SELECT 'after', 0")
def clear_evidence(t):
    docs = t("documents")
    spark, path = docs.sparkSession, place(docs.sparkSession, "evidence")
    evidence.write_evidence(docs.select(F.concat(F.lit("docs-"), "lang").alias("evidence_id"), F.col("doc_id").cast("string").alias("kind"), "text"), path)
    before = spark.createDataFrame([("before", evidence.read_evidence(spark, path).count())], "state string, chunks long")
    evidence.clear_evidence(spark, path)
    return before.unionByName(spark.read.parquet(path).agg(F.lit("after").alias("state"), F.count("*").alias("chunks")))


@query("append_run", """SELECT event_type AS model, count(*) AS runs, sum(CASE WHEN event_id % 2 = 1 THEN 1 ELSE 0 END) AS second FROM events GROUP BY 1""")
def append_run(t):
    """Two appends to one log; both are there afterwards."""
    runs = t("events").select(F.col("event_id").cast("string").alias("run_id"), F.col("event_type").alias("model"), F.col("value").alias("mape"), "ts", (F.col("event_id") % 2).alias("half"))
    path = place(runs.sparkSession, "runs")
    for half in (0, 1):
        runlog.append_run(runs.where(F.col("half") == half), path)
    return runs.sparkSession.read.parquet(path).groupBy("model").agg(F.count("*").alias("runs"), F.sum("half").alias("second"))


@query("read_runs", "SELECT CAST(event_id AS VARCHAR) AS run_id, event_type AS model, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def read_runs(t):
    rows = t("events").select(F.col("event_id").cast("string").alias("run_id"), F.col("user_id").cast("string").alias("dataset"), F.col("event_type").alias("model"), F.col("value").alias("mape"), "ts")
    path = place(rows.sparkSession, "runs")
    runlog.append_run(rows, path)
    return runlog.read_runs(rows.sparkSession, path).select("run_id", "model", "ts")


def event_stream(t):
    """The events table as a stream of its own files."""
    events = t("events")
    listed = events.inputFiles()
    folder, name = listed[0].rsplit("/", 1)
    pattern = name if len(listed) == 1 else "*.parquet"
    reader = events.sparkSession.readStream.schema(events.schema).option("pathGlobFilter", pattern)
    return events.sparkSession, reader.parquet(folder)


@query("stream_batch_profile", "\nUNION ALL\n".join(f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS missing, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS lowest, CAST(max({c}) AS DOUBLE) AS highest FROM events""" for c in ("user_id", "value")))
def stream_batch_profile(t):
    spark, stream = event_stream(t)
    out = place(spark, "stream-profile")
    jobs.stream_batch_profile(stream, ["user_id", "value"], out, place(spark, "stream-state")).awaitTermination()
    return rounded(jobs.reconcile_profile(spark, out), 4, "mean", "std")


SKETCHED = ("user_id", "value", "event_type")


def _full_profile_sql() -> str:
    """Exact parts from SQL; the sketches' errors are judged against exact counts of the same table."""
    one = """SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS unique_values,
 (SELECT string_agg(CAST(x AS VARCHAR), '|' ORDER BY n DESC, x) FROM (SELECT {c} AS x, count(*) AS n FROM events WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, x LIMIT 3)) AS top_values, true AS distinct_close, true AS quartiles_close FROM events"""
    return "\nUNION ALL\n".join(one.format(c=c) for c in SKETCHED)


@query("stream_full_profile", _full_profile_sql())
def stream_full_profile(t):
    """Five batches, merged: exact counts, and sketches within their stated errors."""
    spark = t("events").sparkSession
    source, out = place(spark, "stream-source"), place(spark, "stream-full")
    slim = t("events").select(*SKETCHED)
    slim.repartition(5, F.xxhash64(*SKETCHED)).write.parquet(source)
    stream = spark.readStream.schema(slim.schema).option("maxFilesPerTrigger", 1).parquet(source)
    sketches.stream_profile(stream, SKETCHED, out, place(spark, "stream-state")).awaitTermination()
    found = sketches.reconcile(spark, out, 3)
    bounds = {r["column"]: (r.q1, r.median, r.q3) for r in found.where("median IS NOT NULL").collect()}  # one row per column
    # a quantile is right when its share lies between the shares of the values below it and up to it
    ranked = slim.agg(*[F.struct(*[x for i, v in enumerate(q) for x in (F.avg((F.col(c) < v).cast("double")).alias(f"below{i}"), F.avg((F.col(c) <= v).cast("double")).alias(f"upto{i}"))]).alias(c) for c, q in bounds.items()]).first()
    close = [c for c in bounds if all(ranked[c][f"below{i}"] - sketches.RANK_ERROR <= p <= ranked[c][f"upto{i}"] + sketches.RANK_ERROR for i, p in enumerate((0.25, 0.5, 0.75)))]
    off = F.abs(F.col("distinct_estimate") / F.col("unique_values") - 1)
    return found.select("column", "rows", "missing", "unique_values", joined("top_values").alias("top_values"), (off <= sketches.DISTINCT_ERROR).alias("distinct_close"),
                        (F.col("median").isNull() | F.col("column").isin(close)).alias("quartiles_close"))


@query("stream_shifted_profile", """SELECT 'value' AS "column", count(*) AS rows, round(stddev_pop(value), 4) AS std FROM events""")
def stream_shifted_profile(t):
    """The deviation of values around a billion, merged from several batches."""
    spark = t("events").sparkSession
    parts = [jobs.partial_profile(t("events").where(F.col("event_id") % 5 == i).select((F.col("value") + 1e9).alias("value")), ["value"]) for i in range(5)]
    path = place(spark, "shifted")
    for part in parts:
        part.write.mode("append").parquet(path)
    return rounded(jobs.reconcile_profile(spark, path).select("column", "rows", "std"), 4, "std")


@query("stream_run_monitor", """WITH h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type AS kind, count(*) AS events, avg(value) AS mean_value FROM events GROUP BY 1, 2)
SELECT window_start, kind, events, round(mean_value, 6) AS mean_value, round(least(0.95, 0.12 + mean_value / 10), 6) AS drift_score FROM h
WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_run_monitor(t):
    spark, stream = event_stream(t)
    out = place(spark, "stream-monitor")
    jobs.stream_run_monitor(stream, "ts", "event_type", "value", out, place(spark, "stream-state")).awaitTermination()
    return rounded(spark.read.parquet(out), 6, "mean_value", "drift_score")


@query("stream_alerts", """WITH h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type AS kind, avg(value) AS value FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2 HAVING avg(value) IS NOT NULL),
c AS (SELECT *, value > 50 AS above FROM h WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR),
g AS (SELECT *, lead(hour) OVER w AS next, lag(hour) OVER w + INTERVAL 3 HOUR >= hour AND lag(above) OVER w AS was FROM c WINDOW w AS (PARTITION BY kind ORDER BY hour))
SELECT kind, hour, CASE WHEN above THEN 'raised' ELSE 'cleared' END AS alert, round(value, 6) AS value FROM g WHERE above <> coalesce(was, false)
UNION ALL SELECT kind, hour, 'silent', NULL FROM g WHERE hour + INTERVAL 3 HOUR < next""")
def stream_alerts(t):
    """Events come in four parts, with a restart before each. Silence that no later hour of its kind has ended yet is left out: whether it is due depends on the watermark."""
    events = t("events").select("ts", "event_type", "value")
    spark = events.sparkSession
    source, out, state = (place(spark, f"alerts-{name}") for name in ("source", "out", "state"))
    span = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    cuts = [span.low + (span.high - span.low) * i / 4 for i in range(1, 4)]
    part = sum([(F.col("ts") >= F.lit(c)).cast("int") for c in cuts], F.lit(0))
    for i in range(4):
        events.where(part == i).write.mode("append").parquet(source)
        alerts.stream_alerts(spark.readStream.schema(events.schema).parquet(source), "ts", "event_type", "value", 50.0, out, state, silence_hours=3).awaitTermination()
    found = spark.read.parquet(f"{out}/alerts").withColumn("hour", F.col("hour").cast("timestamp_ntz"))
    closed = t("events").where(F.col("ts") < F.date_trunc("hour", F.lit(span.high) - F.expr("INTERVAL 1 HOUR"))).where("value IS NOT NULL").groupBy(F.col("event_type").alias("kind")).agg(F.date_trunc("hour", F.max("ts")).cast("timestamp_ntz").alias("last"))
    ended = found.join(closed, "kind").where((F.col("alert") != "silent") | (F.col("hour") < F.col("last"))).drop("last")
    return rounded(ended, 6, "value")


@query("hourly_monitor", """SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type AS kind, count(*) AS events, round(avg(value), 6) AS mean_value, round(least(0.95, 0.12 + avg(value) / 10), 6) AS drift_score FROM events GROUP BY 1, 2""")
def hourly_monitor(t):
    return rounded(jobs.hourly_monitor(t("events"), "ts", "event_type", "value"), 6, "mean_value", "drift_score")


@query("incremental_profile", union(
    f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS unique_values, 1 AS files_read FROM {EVENTS_WITH_GAPS}""" for c in ("event_id", "user_id", "event_type", "value")))
def incremental_profile(t):
    """Three files profiled, a fourth one added: only that one is read, and the profile is that of all rows."""
    events = events_with_gaps(t).select("event_id", "user_id", "event_type", "value")
    spark = events.sparkSession
    folder, store = place(spark, "arriving"), place(spark, "profile")
    read = lambda paths: spark.read.schema(events.schema).parquet(*paths)
    events.where("event_id % 4 < 3").repartition(3).write.parquet(f"{folder}/first")
    increments.refresh_profile(spark, folder, store, read)
    events.where("event_id % 4 = 3").coalesce(1).write.parquet(f"{folder}/second")
    added = increments.refresh_profile(spark, folder, store, read)
    return increments.folder_profile(spark, store).select("column", "rows", "missing", "unique_values", F.lit(len(added)).alias("files_read"))


@query("scan_csv_rejects", """SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'bad value' WHEN o_orderkey % 50 = 1 THEN 'bad width' ELSE 'read' END AS outcome,
 count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1""")
def scan_csv_rejects(t):
    """A folder with broken lines: each is in exactly one of the two results."""
    key = F.col("o_orderkey")
    price = F.when(key % 50 == 0, "n/a").when(key % 50 == 1, F.concat(F.col("o_totalprice").cast("string"), F.lit(",extra"))).otherwise(F.col("o_totalprice").cast("string"))
    line = F.concat_ws(",", key, F.concat(F.lit('"'), "o_orderpriority", F.lit(', x"')), price)
    path = place(t("orders").sparkSession, "broken-csv")
    # Whole lines as the only column, so that nothing is quoted anew.
    lines = t("orders").select(line.alias("key,priority,price"))
    lines.repartition(4).write.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    read, rejects = files.scan_csv_rejects(lines.sparkSession, path, "key long, priority string, price double")
    both = read.select(F.lit("read").alias("outcome"), "key").unionByName(
        rejects.select(F.col("reason").alias("outcome"), F.regexp_extract("record", "^[0-9]+", 0).cast("long").alias("key")))
    return both.groupBy("outcome").agg(F.count("*").alias("rows"), F.sum("key").alias("keys"))
