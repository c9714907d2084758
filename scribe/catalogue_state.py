"""Registered queries of what keeps state: versioned tables, the job store and streams with late rows."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scribe.catalogue import ORACLES, REQUESTS_SQL, epochs, query, requests, rounded
from scribe.catalogue_files import PART_SQL, parts
from scribe.operators import latency, quantiles, runs
from scribe.session import dealt, scratch, table
from scribe.sources import manifest_source as source
from scribe.sources import versions
from scribe.sources.history import History, place_of
from scribe.streaming import jobs, state

ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def store_of(spark: SparkSession, rows, key: str, files: int = 16) -> versions.VersionedTable:
    made = versions.VersionedTable(spark, scratch(spark, "versions"), key)
    made.create(rows.repartitionByRange(files, key))
    return made


@query(REQUESTS_SQL + "SELECT id, model_id, total_ms FROM q WHERE id NOT IN (SELECT event_id FROM (SELECT event_id FROM events ORDER BY event_id LIMIT 10)) AND id % 97 <> 5")
def versioned_delete(spark, sf_dir):
    """Two deletes, of ten neighbours and of ids all over, each a version; the newest one read back."""
    q = requests(spark, sf_dir).select("id", "model_id", "total_ms")
    made = store_of(spark, q, "id")
    versions.delete_ids(made, q.select("id").orderBy("id").limit(10), strict=True)
    versions.delete_ids(made, q.where("id % 97 = 5").select("id"))
    return made.read()


@query(REQUESTS_SQL + """, c AS (SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN '' ELSE 'cl ick' END AS new FROM events WHERE event_id % 5 = 0 AND event_id % 3 = 0)
SELECT q.id, CASE WHEN new = '' THEN NULL WHEN new IS NOT NULL THEN new WHEN q.id % 3 = 0 THEN 'truth' END AS ground_truth,
  round(CASE WHEN new = '' THEN NULL WHEN new IS NOT NULL THEN levenshtein(new, trim(regexp_replace(text, '\\s+', ' ', 'g'))) / length(new) ELSE cer END, 9) AS cer FROM q LEFT JOIN c ON q.id = c.id""")
def versioned_corrections(spark, sf_dir):
    q = requests(spark, sf_dir).withColumn("exact_match", F.lit(None).cast("boolean"))
    made = store_of(spark, q, "id")
    e = table(spark, sf_dir, "events").where("event_id % 15 = 0")
    versions.correct(made, e.select(F.col("event_id").alias("id"), "ts", F.when(F.col("event_id") % 10 == 0, " ").otherwise("cl ick").alias("ground_truth")), runs.apply_corrections)
    return rounded(made.read().select("id", "ground_truth", "cer"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 = 0)")
def versioned_cascade(spark, sf_dir):
    made = store_of(spark, table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey")
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_orderkey % 5 = 0")
    versions.cascade(made, gone.select(F.col("o_orderkey").alias("l_orderkey")))
    return made.read()


@query(REQUESTS_SQL + "SELECT id, created_at FROM q WHERE created_at >= TIMESTAMP '2024-01-20'")
def versioned_prune(spark, sf_dir):
    made = store_of(spark, requests(spark, sf_dir).select("id", "created_at"), "id")
    versions.prune(made, lambda rows: rows.where("created_at < timestamp '2024-01-20'"))
    return made.read()


@query("SELECT user_id AS job_id, arg_max(event_type, (event_id % 4, ts, event_id)) AS status, arg_max(event_id, (event_id % 4, ts, event_id)) AS epoch, count(*) AS entries, sum(event_id)::BIGINT AS total FROM events GROUP BY user_id")
def job_store(spark, sf_dir):
    """Events in four micro-batches; a later batch is later for a job's state, and its history has every entry once."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "ts", F.struct("ts", "event_id", "event_type").alias("last"), F.col("event_id").cast("string").alias("history_entry"))
    # several events of a job may bear one time, so the last of a batch goes with every row of it
    part = (F.col("last.event_id") % 4).alias("part")
    latest = e.groupBy("job_id", part).agg(F.max("last").alias("last"))
    rows = e.select("job_id", "ts", "history_entry", part).join(latest, ["job_id", "part"])
    path = scratch(spark, "job_store")
    rows.write.partitionBy("part").parquet(f"{path}/in")
    kind = rows.drop("part").schema
    for k in range(4):
        stream = spark.readStream.schema(kind).parquet(f"{path}/in/part={{{','.join(map(str, range(k + 1)))}}}")
        jobs_ = state.track_jobs(stream, f"{path}/store", buckets=16)
        jobs_.option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start().awaitTermination()
    out = state.JobStore(spark, f"{path}/store").jobs()
    total = F.aggregate("history", F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    return out.select("job_id", F.col("last.event_type").alias("status"), F.col("last.event_id").alias("epoch"), F.size("history").cast("long").alias("entries"), total.alias("total"))


@query(f"SELECT run_name::VARCHAR AS run_name, stop_epoch, best FROM ({ORACLES['early_stop']}) WHERE stop_epoch IS NOT NULL")
def stream_early_stop(spark, sf_dir):
    """early_stop's alerts from a stream whose epochs are shuffled over six micro-batches."""
    rows = epochs(spark, sf_dir).select(F.col("run").cast("string").alias("run_name"), "epoch", "value", F.timestamp_seconds(F.col("epoch")).alias("ts"))
    far = rows.agg(F.max("epoch")).first()[0] + 10 * 86_400
    path = scratch(spark, "early_stop")
    rows.withColumn("part", F.pmod(F.xxhash64("run_name", "epoch"), F.lit(6))).write.partitionBy("part").parquet(f"{path}/in")
    spark.range(1).select(F.lit("~").alias("run_name"), F.lit(1).cast("long").alias("epoch"), F.lit(0.0).alias("value"), F.timestamp_seconds(F.lit(far)).alias("ts")).write.parquet(f"{path}/in/part=6")
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        for k in range(7):
            stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in/part={{{','.join(map(str, range(k + 1)))}}}")
            alerts = jobs.early_stop_in_any_order(stream, 20, late="9 days", idle_days=30)
            running = alerts.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/c").outputMode("append").trigger(availableNow=True).start()
            running.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema("run_name string, stop_epoch long, best double").parquet(f"{path}/out")


# --- exact percentiles ---------------------------------------------------------------------------------------------

@query("""WITH b AS (SELECT event_type, event_id % 5 = 0 AS warm, value AS ms, event_id % 4 + 1 AS size, value / 10 AS load_ms, event_id % 11 = 0 AS failed FROM events), t AS (SELECT * FROM b WHERE NOT warm),
e AS (SELECT event_type, ms / size AS each, unnest(range(size)) FROM t),
q AS (SELECT event_type, quantile_cont(each, 0.5) AS median_ms, quantile_cont(each, 0.95) AS p95_ms FROM e GROUP BY event_type)
SELECT event_type, sum(size)::BIGINT AS timed_samples, round(sum(ms) / sum(size), 6) AS avg_ms, round(any_value(median_ms), 6) AS median_ms, round(any_value(p95_ms), 6) AS p95_ms, round(sum(size) * 1000 / sum(ms), 6) AS throughput_per_s,
  round(avg(load_ms) / 32, 6) AS avg_load_ms, count(*) FILTER (failed) AS failed FROM t JOIN q USING (event_type) GROUP BY event_type""")
def latency_by_type(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    b = e.select("event_type", (k % 5 == 0).alias("warm"), F.col("value").alias("ms"), (k % 4 + 1).alias("size"), (F.col("value") / 10).alias("load_ms"), (k % 11 == 0).alias("failed"))
    return rounded(latency.latency_stats(b, "event_type"), 6)


@query("""WITH e AS (SELECT l_returnflag, l_extendedprice AS v, unnest(range(l_quantity::INT)) FROM lineitem)
SELECT l_returnflag, round(quantile_cont(v, 0.01), 4) AS p01, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.999), 4) AS p999 FROM e GROUP BY l_returnflag""")
def weighted_percentiles(spark, sf_dir):
    out = quantiles.exact_percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_extendedprice"), F.col("l_quantity").cast("int"), {"p01": 0.01, "p50": 0.5, "p999": 0.999})
    return rounded(out, 4)


# --- pages and search of the history -------------------------------------------------------------------------------

def history_of(spark: SparkSession, sf_dir: str) -> History:
    made = History(spark, scratch(spark, "history"))
    made.create(requests(spark, sf_dir), 12)
    return made


@query(REQUESTS_SQL + "SELECT id, created_at, model_id FROM q ORDER BY created_at DESC, id DESC LIMIT 150 OFFSET 400")
def history_keyset_page(spark, sf_dir):
    """Three pages of fifty rows, each from the cursor that the one before ended with, behind a page by its number."""
    made = history_of(spark, sf_dir)
    first = made.page(399, 1).select("id", "created_at")
    cursor = first.select(place_of(F.col("created_at"), F.col("id")).alias("place")).first()["place"]
    out = None
    for _ in range(3):
        rows, _files = made.after(cursor, 50)
        cursor = rows.agg(F.min("place")).first()[0]
        out = rows if out is None else out.unionByName(rows)
    return out.select("id", "created_at", "model_id")


@query(REQUESTS_SQL + "SELECT id, model_id, text FROM q WHERE lower(text) LIKE '%purch_se%' OR lower(original_filename) LIKE '%purch_se%' UNION ALL SELECT id, model_id, text FROM q WHERE lower(original_filename) LIKE '%\"k\": 42}%'")
def history_trigram_search(spark, sf_dir):
    made = history_of(spark, sf_dir)
    return made.search("Purch_se").select("id", "model_id", "text").unionByName(made.search('"K": 42}').select("id", "model_id", "text"))


# --- sliding statistics --------------------------------------------------------------------------------------------

@query("""WITH e AS (SELECT date_trunc('day', ts) AS day, 'user-' || user_id AS model_id, value, event_id FROM events), w AS (SELECT day - to_days(k::INT) AS start, model_id, value FROM e, range(7) t(k))
SELECT start::TIMESTAMP AS start, (start + INTERVAL 7 DAY)::TIMESTAMP AS "end", model_id, count(*) AS requests, round(avg(value), 6) AS avg_total_ms FROM w GROUP BY ALL""")
def stream_sliding_statistics(spark, sf_dir):
    """Seven-day windows of all requests, some a day late but before the watermark; rows that come too late count nowhere."""
    rows = requests(spark, sf_dir).select(F.col("created_at").cast("timestamp").alias("created_at"), "model_id", "total_ms", "confidence")
    rows, path = dealt(rows, "model_id"), scratch(spark, "sliding")
    last = rows.agg(F.max("created_at")).first()[0]
    at = lambda days: F.lit(last) + F.make_dt_interval(F.lit(days))
    mark = rows.limit(1).select(at(60).alias("created_at"), F.lit("~").alias("model_id"), F.lit(0.0).alias("total_ms"), F.lit(0.0).alias("confidence"))
    late = rows.withColumn("total_ms", F.lit(1e9))  # behind the mark's watermark: nothing of them may count
    parts = [rows.where("pmod(unix_micros(created_at), 2) = 0"), rows.where("pmod(unix_micros(created_at), 2) <> 0"), mark, late, mark.withColumn("created_at", at(120))]
    for k, part in enumerate(parts):
        part.write.parquet(f"{path}/in/part={k}")
    for k in range(len(parts)):
        source = spark.readStream.schema(rows.schema).parquet(f"{path}/in/part={{{','.join(map(str, range(k + 1)))}}}")
        running = jobs.sliding_statistics(source, late="40 days").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/c").outputMode("append").trigger(availableNow=True).start()
        running.awaitTermination()
    out = spark.read.parquet(f"{path}/out").where("model_id <> '~'")
    return rounded(out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "model_id", "requests", "avg_total_ms"), 6)


# --- manifests as a data source ------------------------------------------------------------------------------------

@query(PART_SQL + "SELECT path, label FROM p UNION ALL SELECT path, label FROM p WHERE split = 'val' UNION ALL SELECT path, label FROM p WHERE path LIKE 'img/1%'")
def manifest_source(spark, sf_dir):
    """Parts written as a manifest, more rows appended, read back in small splits, and once more with a filter on paths."""
    path, p = scratch(spark, "manifest_source"), parts(spark, sf_dir)
    source.write_rows(p.withColumn("path", F.replace("path", F.lit("/"), F.lit("\\"))), path)
    source.write_rows(p.where("split = 'val'"), path, "append")
    read = lambda: spark.read.format("manifest").option("split", 5000).load(path)
    some = read().where(F.col("path").startswith("img/1")).select("path", "label").distinct()
    return read().select("path", "label").unionByName(some)
