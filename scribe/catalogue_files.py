"""Registered queries of the sources, sinks, streams and whole jobs.

Each writes a given table out in a format, reads it back by the library's source and is compared with SQL on the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribe.catalogue import CHARSET, evaluation_runs, latest_runs, query, requests, rounded, word_boxes
from scribe.functions import geometry, scoring, text
from scribe.operators import corpus, layout, metrics, runs, sequence
from scribe.plans import prepare, recognise, reports
from scribe.session import dealt, scratch, table
from scribe.sources import labels, manifests, store
from scribe.streaming import jobs

# --- manifests and label sources -----------------------------------------------------------------------------------

PART_SQL = "WITH p AS (SELECT p_partkey, 'img/' || p_partkey || '.png' AS path, p_name AS label, CASE WHEN p_partkey % 10 < 8 THEN 'train' WHEN p_partkey % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM part) "


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as labelled images: (p_partkey, path, label, split)."""
    k = F.col("p_partkey") % 10
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("img/"), "p_partkey", F.lit(".png")).alias("path"), F.col("p_name").alias("label"), F.when(k < 8, "train").when(k == 8, "val").otherwise("test").alias("split"))


@query(PART_SQL + "SELECT path, label FROM p")
def manifest_round_trip(spark, sf_dir):
    path = scratch(spark, "manifest")
    manifests.write_manifest(parts(spark, sf_dir).withColumn("path", F.replace("path", F.lit("/"), F.lit("\\"))), path)
    return manifests.read_manifest(spark, path)[0].select("path", "label")


@query(PART_SQL + "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'no tab ' || p_partkey ELSE 'img/' || p_partkey || '.png' || chr(9) END AS value FROM p WHERE p_partkey % 3 < 2")
def manifest_malformed(spark, sf_dir):
    """Lines without a tab, with an empty label, comments, blanks and good ones; the malformed are kept apart."""
    p, path = parts(spark, sf_dir), scratch(spark, "malformed")
    k = F.col("p_partkey") % 3
    line = F.when(k == 0, F.concat(F.lit("no tab "), "p_partkey")).when(k == 1, F.concat("path", F.lit("\t"))).otherwise(F.concat_ws("\t", "path", "label"))
    p.select(F.explode(F.array(line, F.lit("# a comment"), F.lit("  "))).alias("value")).write.text(path)
    return manifests.read_manifest(spark, path, strict=False)[1].select("value")


@query(PART_SQL + "SELECT path FROM p WHERE split = 'test'")
def unlabeled_round_trip(spark, sf_dir):
    path = scratch(spark, "unlabeled")
    manifests.write_unlabeled(parts(spark, sf_dir).where("split = 'test'").select("path"), path)
    return manifests.read_unlabeled(spark, path).select("path")


@query(PART_SQL + "SELECT 'parts' AS dataset, split, count(*) AS rows, min(path) AS first FROM p GROUP BY split")
def manifest_table(spark, sf_dir):
    path = scratch(spark, "table")
    manifests.write_manifest_table(parts(spark, sf_dir).select(F.lit("parts").alias("dataset"), "split", F.col("p_partkey").alias("ord"), "path", "label"), path)
    return spark.read.parquet(path).groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("rows"), F.min("path").alias("first"))


@query("SELECT n_nationkey::VARCHAR AS rows, n_name AS name FROM nation")
def provenance_files(spark, sf_dir):
    """A provenance file for each nation, beside one that is no JSON."""
    path = scratch(spark, "info")
    info = F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("rows"), F.col("n_name").alias("at")))
    table(spark, sf_dir, "nation").select(info.alias("value"), F.col("n_nationkey").alias("k")).unionByName(spark.range(1).select(F.lit("not json").alias("value"), F.lit(-1).alias("k"))).write.partitionBy("k").text(path)
    rows = manifests.read_info(spark, path)
    return rows.select(F.get_json_object("value", "$.rows").alias("rows"), F.get_json_object("value", "$.name").alias("name"))


@query("SELECT DISTINCT p_type AS word FROM part")
def word_list(spark, sf_dir):
    path = scratch(spark, "words")
    table(spark, sf_dir, "part").select(F.col("p_type").alias("value")).distinct().write.text(path)
    return manifests.read_word_list(spark, path)


@query(PART_SQL + """SELECT split, path, CASE WHEN p_partkey % 5 = 0 THEN 'a "quoted", label' ELSE label END AS label FROM p WHERE split <> 'val'""")
def csv_labels(spark, sf_dir):
    p, path = parts(spark, sf_dir).withColumn("label", F.when(F.col("p_partkey") % 5 == 0, 'a "quoted", label').otherwise(F.col("label"))), scratch(spark, "csv")
    for split in ("train", "test"):
        p.where(F.col("split") == split).select(F.col("path").alias("FILENAME"), F.col("label").alias("IDENTITY")).write.option("header", True).option("escape", '"').csv(f"{path}/{split}")
    return labels.read_csv_splits(spark, {s: f"{path}/{s}" for s in ("train", "test")})


@query("""SELECT CASE WHEN p_partkey % 7 = 0 THEN 'short' WHEN p_partkey % 5 = 0 THEN 'segmentation_error' END AS reason, count(*) AS rows FROM part GROUP BY ALL""")
def line_index_rejects(spark, sf_dir):
    """An index of lines in its text form: those of too few fields and with segmentation errors are told apart and counted."""
    p, path = table(spark, sf_dir, "part"), scratch(spark, "lines")
    status = F.when(F.col("p_partkey") % 5 == 0, "err").otherwise("ok")
    whole = F.concat_ws(" ", F.concat_ws("-", F.lit("a01"), "p_partkey", F.lit("00")), status, F.lit("154 19 408 746 1661 89"), F.replace("p_name", F.lit(" "), F.lit("|")))
    p.select(F.when(F.col("p_partkey") % 7 == 0, F.concat_ws(" ", F.lit("a01-1-00"), status)).otherwise(whole).alias("value")).write.text(path)
    return reports.rejects_of(labels.read_line_index(spark, path))


@query("SELECT p_name AS label, count(*) AS rows FROM part WHERE p_partkey % 7 > 0 AND p_partkey % 5 > 0 GROUP BY ALL")
def line_index_labels(spark, sf_dir):
    p, path = table(spark, sf_dir, "part"), scratch(spark, "lines")
    status = F.when(F.col("p_partkey") % 5 == 0, "err").otherwise("ok")
    p.where("p_partkey % 7 > 0").select(F.concat_ws(" ", F.concat_ws("-", F.lit("a01"), "p_partkey", F.lit("00")), status, F.lit("154 19 408 746 1661 89"), F.replace("p_name", F.lit(" "), F.lit("|"))).alias("value")).write.text(path)
    return labels.read_line_index(spark, path).where("reason is null").groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT 'a/b/' || p_partkey || '.jpg' AS path, p_name AS label FROM part")
def annotation_table(spark, sf_dir):
    return labels.from_annotations(table(spark, sf_dir, "part").select(F.concat(F.lit("a\\b\\"), "p_partkey", F.lit(".jpg")).alias("ImgName"), F.col("p_name").alias("GroundTruth")))


@query("SELECT item_id || '.png' AS file, CASE item_id % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'scan' ELSE 'photo' END AS capture, len(string_split(text, chr(10)))::BIGINT AS lines, text FROM benchmark WHERE item_id % 3 < 2")
def benchmark_files(spark, sf_dir):
    """Benchmark items as JSON files of several entries, of two captures."""
    b, path = table(spark, sf_dir, "benchmark"), scratch(spark, "benchmark")
    capture = F.element_at(F.array(F.lit("clean"), F.lit("scan"), F.lit("photo")), (F.col("item_id") % 3 + 1).cast("int"))
    entry = F.struct(F.concat("item_id", F.lit(".png")).alias("file"), F.col("item_id").cast("int").alias("page"), capture.alias("capture"), F.split("text", "\n").alias("lines"), "text")
    b.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(16)).alias("k")).agg(F.to_json(F.struct(F.collect_list(entry).alias("entries"))).alias("value")).write.partitionBy("k").text(path)
    return labels.read_benchmark(spark, path).where(F.col("capture").isin("clean", "scan")).select("file", "capture", F.size("lines").cast("long").alias("lines"), "text")


@query("SELECT 'user' || user_id AS run, count(*) AS epochs, round(sum(value), 6) AS total, round(max(value), 6) AS worst FROM events GROUP BY user_id")
def history_files(spark, sf_dir):
    """A history file for each run, one with broken JSON and one with values that are no numbers."""
    # a null run has the folder without a name
    e, path = table(spark, sf_dir, "events").select(F.coalesce(F.concat(F.lit("user"), "user_id"), F.lit("")).alias("run"), "user_id", "event_id", "value"), scratch(spark, "history")
    epoch = F.create_map(F.lit("epoch"), F.col("event_id").cast("string"), F.lit("loss"), F.col("value").cast("string"), F.lit("note"), F.lit("text"))
    # dealt by run, so that all tasks write files: a file costs the more, the fewer epochs it has
    rows = dealt(e, "run").groupBy("run").agg(F.to_json(F.struct(F.first("user_id").cast("string").alias("run_name"), F.lit("loss").alias("monitor"), F.lit("min").alias("monitor_mode"), F.collect_list(epoch).alias("epochs"))).alias("value"))
    labels.write_histories(rows.unionByName(spark.range(1).select(F.lit("broken").alias("run"), F.lit('{"run_name": "b", "epochs": [').alias("value"))), path)
    h = labels.read_histories(spark, path).withColumn("run", F.nullif(F.regexp_replace("run", "^run=(__HIVE_DEFAULT_PARTITION__$)?", ""), F.lit("")))
    loss = F.try_element_at("metrics", F.lit("loss"))
    return rounded(h.groupBy("run").agg(F.count(F.lit(1)).alias("epochs"), F.sum(loss).alias("total"), F.max(loss).alias("worst")), 6)


@query("SELECT id, model_id, cer FROM (SELECT event_id AS id, 'user-' || user_id AS model_id, CASE WHEN event_id % 3 = 0 THEN (props->>'$.k')::DOUBLE / 200 END AS cer FROM events) ORDER BY id DESC LIMIT 100")
def store_tables(spark, sf_dir):
    """Requests appended to the run store in two parts, the second with a column more, and read as one."""
    root, r = scratch(spark, "store"), requests(spark, sf_dir)
    store.append(r.where("id % 2 = 0"), root, "ocr_requests")
    store.append(r.where("id % 2 = 1").withColumn("note", F.lit("later")), root, "ocr_requests")
    return store.read(spark, root, "ocr_requests").orderBy(F.desc("id")).limit(100).select("id", "model_id", "cer")


@query("SELECT s_suppkey AS id, s_name AS name, round(s_acctbal, 2) AS balance FROM supplier")
def json_reports(spark, sf_dir):
    path = scratch(spark, "reports")
    store.write_report(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.round("s_acctbal", 2).alias("balance")), path)
    return spark.read.schema("id long, name string, balance double").json(path)


@query(r"SELECT conv_id, string_agg('===== turn' || lpad(turn::VARCHAR, 6, '0') || ' =====' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL) GROUP BY conv_id")
def joined_export(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    return store.joined_export(c.select("conv_id", F.concat(F.lit("turn"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("name"), "text"), "conv_id")


@query("SELECT n_name AS name, count(*) AS lines FROM nation, range(2) GROUP BY ALL")
def text_export(spark, sf_dir):
    """A text file for each nation with two lines, Windows line endings and a byte order mark."""
    path = scratch(spark, "texts")
    store.export_texts(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat("n_name", F.lit("\nsecond line")).alias("text")), path)
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.regexp_extract("value", "^\\ufeff(.*?)\r\n", 1).alias("name"), F.size(F.filter(F.split("value", "\r\n"), lambda x: F.trim(x) != "")).cast("long").alias("lines"))


# --- corpora and functions -----------------------------------------------------------------------------------------


@query("SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS label FROM documents WHERE length(text) < 400 AND text IS NOT NULL")
def labels_only(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("length(text) < 400")
    return corpus.labels_only(d.select(F.col("text").alias("label")))


@query("SELECT doc_id FROM documents WHERE regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[^ -~]', '', 'g') <> '' OR trim(regexp_replace(text, '\\s+', ' ', 'g')) = ''")
def encodable_rows(spark, sf_dir):
    return corpus.encodable(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("label")), CHARSET).select("doc_id")


@query("SELECT lang, count(*) AS rows FROM documents GROUP BY lang")
def category_counts(spark, sf_dir):
    return corpus.category_counts(table(spark, sf_dir, "documents"), "lang")


@query("SELECT doc_id FROM documents WHERE doc_id < 300")
def prefix_cap(spark, sf_dir):
    return corpus.prefix_cap(table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("ord")), 300).select("doc_id")


@query("SELECT doc_id, doc_id < greatest(64, floor((SELECT count(*) FROM documents) * 0.05::DOUBLE)) AS held_out FROM documents")
def prefix_hold_out(spark, sf_dir):
    return corpus.prefix_hold_out(table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("ord")), 64).select("doc_id", "held_out")


@query("SELECT doc_id AS path FROM (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY md5('42:' || doc_id), doc_id LIMIT 50)")
def pool_draw(spark, sf_dir):
    path = lambda name: table(spark, sf_dir, name).select(F.col("doc_id").alias("path"))
    return corpus.draw_pool(path("documents"), path("labels"), 50)


@query("SELECT doc_id AS path FROM documents WHERE lang <> 'en'")
def leftover(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "lang")
    return corpus.leftover(d, d.where("lang = 'en'")).select("path")


@query("""WITH s AS (SELECT l_orderkey AS batch, l_linenumber AS item, l_quantity::INT * 40 AS width, 32 + l_linenumber AS height FROM lineitem),
n AS (SELECT *, greatest(1, round_even(width * 64 / height, 0))::BIGINT AS w FROM s), c AS (SELECT *, least(greatest(ceil(max(w) OVER (PARTITION BY batch) / 4) * 4, 128), 2048)::BIGINT AS canvas FROM n)
SELECT batch, item, canvas, round(least(w, canvas) / canvas, 9) AS content_ratio, w > canvas AS compressed FROM c""")
def shared_canvas(spark, sf_dir):
    """Line items as line images, an order being a batch."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("item"), (F.col("l_quantity").cast("int") * 40).alias("width"), (F.col("l_linenumber") + 32).cast("int").alias("height"))
    out = geometry.shared_canvas(s, "batch")
    return rounded(out.select("batch", "item", F.col("canvas").cast("long").alias("canvas"), "content_ratio", "compressed"))


@query("""WITH s AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity::INT * 40 AS width, 32 + l_linenumber AS height FROM lineitem), t AS (SELECT *, greatest(1, round_even(width * 64 / height, 0))::BIGINT AS w FROM s)
SELECT k, n, w AS "natural", least(w, 512) AS scaled, round(least(w, 512) / 512, 9) AS content_ratio, w > 512 AS truncated, round(CASE WHEN w > 512 THEN 1 - 512 / w ELSE 0 END, 9) AS lost_fraction FROM t""")
def line_geometry(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_quantity").cast("int") * 40).alias("width"), (F.col("l_linenumber") + 32).cast("int").alias("height"))
    g = s.select("k", "n", geometry.line_geometry(F.col("width"), F.col("height"), compress=False).alias("g"))
    return rounded(g.select("k", "n", F.col("g.natural").cast("long").alias("natural"), F.col("g.scaled").cast("long").alias("scaled"), "g.content_ratio", "g.truncated", "g.lost_fraction"))


@query("SELECT event_id, CASE WHEN value >= 85 THEN 'high' WHEN value >= 60 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN value <= 5 THEN 'good' WHEN value <= 20 THEN 'fair' ELSE 'poor' END AS error FROM events")
def bands(spark, sf_dir):
    share = F.col("value") / 100
    return table(spark, sf_dir, "events").select("event_id", scoring.confidence_band(share).alias("confidence"), scoring.error_band(share).alias("error"))


@query("SELECT a.vec_id, round(list_dot_product(list_transform(a.embedding, lambda v: v::DOUBLE), list_transform(b.embedding, lambda v: v::DOUBLE)) / sqrt(list_dot_product(list_transform(a.embedding, lambda v: v::DOUBLE), list_transform(a.embedding, lambda v: v::DOUBLE)) * list_dot_product(list_transform(b.embedding, lambda v: v::DOUBLE), list_transform(b.embedding, lambda v: v::DOUBLE))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return rounded(e.join(following, "vec_id").select("vec_id", scoring.cosine(F.col("embedding"), F.col("next")).alias("cosine")), 6)


@query("SELECT o_orderkey AS id, greatest(0, epoch(coalesce(l.s, TIMESTAMP '1999-01-01')) - epoch(o_orderdate))::DOUBLE AS seconds FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate)::TIMESTAMP AS s FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL) l ON l_orderkey = o_orderkey")
def durations(spark, sf_dir):
    """Orders as jobs that end with their first shipment, if there is one."""
    last = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").cast("timestamp").alias("s"))
    o = table(spark, sf_dir, "orders").join(last, "o_orderkey", "left")
    return o.select(F.col("o_orderkey").alias("id"), scoring.duration_seconds(F.col("o_orderdate").cast("timestamp"), F.col("s"), F.lit("1999-01-01").cast("timestamp")).alias("seconds"))


# --- run store -----------------------------------------------------------------------------------------------------

REGISTRY_SQL = """WITH r AS (SELECT o_orderkey AS id, 'model-' || (o_custkey % 40) AS model_id, o_orderpriority AS dataset, o_custkey % 40 AS m FROM orders) """


@query(REGISTRY_SQL + "SELECT id, CASE WHEN m < 30 THEN 'arch-' || (m % 3) ELSE 'unknown' END AS architecture, CASE WHEN m < 30 THEN CASE WHEN m % 2 = 0 THEN '1-URGENT' ELSE dataset END ELSE 'unknown' END AS trained_on, m < 30 AND m % 2 = 0 AND dataset <> '1-URGENT' AS cross_domain FROM r WHERE m % 2 = 0 OR m >= 30")
def cross_domain(spark, sf_dir):
    """Runs joined with a registry of thirty of their forty models."""
    r = evaluation_runs(spark, sf_dir)
    m = F.regexp_extract("model_id", r"(\d+)$", 1).cast("int")
    registry = r.select("model_id").distinct().where(m < 30).select("model_id", F.concat(F.lit("arch-"), m % 3).alias("architecture"), F.lit("1-URGENT").alias("trained_on"))
    out = runs.cross_domain(runs.with_registry(r.where((m % 2 == 0) | (m >= 30)), registry.where(m % 2 == 0)))
    return out.select("id", "architecture", "trained_on", "cross_domain")


@query(REGISTRY_SQL + "SELECT id, CASE WHEN m < 10 THEN 'control' WHEN m < 20 THEN 'treatment' ELSE 'other' END AS experiment_arm, CASE WHEN m < 20 THEN 'Model ' || m ELSE model_id END AS display_name FROM r")
def names_of_models(spark, sf_dir):
    r = evaluation_runs(spark, sf_dir)
    m = F.regexp_extract("model_id", r"(\d+)$", 1).cast("int")
    names = r.select("model_id").distinct().where(m < 20).select("model_id", F.when(m < 10, "control").otherwise("treatment").alias("experiment_arm"), F.concat(F.lit("Model "), m).alias("display_name"))
    return runs.with_names(r, names).select("id", "experiment_arm", "display_name")


@query("SELECT o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def recent_jobs(spark, sf_dir):
    return runs.recent_jobs(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))).select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O'")
def active_jobs(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "running").otherwise("done")
    return runs.active(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"))).select("id")


@query("SELECT 'user-' || user_id AS model_id, count(*) AS n, max(event_id) AS last FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 300) GROUP BY user_id")
def recent_by_model(spark, sf_dir):
    out = runs.recent_by_model(requests(spark, sf_dir))
    return out.select("model_id", F.size("recent").cast("long").alias("n"), F.array_max(F.transform("recent", lambda r: r["id"])).alias("last"))


@query("SELECT o_orderkey AS id, count(l_orderkey) AS results, coalesce(min(l_linenumber), 0)::BIGINT AS first FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def comparison_results(spark, sf_dir):
    results = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("id"), "l_quantity")
    out = runs.comparisons(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), results)
    return out.select("id", F.coalesce(F.size("results"), F.lit(0)).cast("long").alias("results"), F.coalesce(F.get("results", F.lit(0))["id"], F.lit(0)).cast("long").alias("first"))


@query("""SELECT user_id AS doc, count(*) FILTER (last < 50) AS marked, count(*) AS lines FROM (SELECT user_id, arg_max(value, event_id) OVER (PARTITION BY user_id, event_type) AS last FROM events) GROUP BY user_id""")
def low_confidence(spark, sf_dir):
    """Events as lines of their user: the last confidence of a text holds for all its lines of the document."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("ord"), F.col("event_type").alias("text"), F.col("value").alias("confidence"))
    return runs.marked_count(runs.line_confidences(rows.select("doc", "ord", "text"), rows, 50))


@query("SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY n) - 1 AS index, text FROM (SELECT user_id AS doc, event_id AS n, CASE WHEN event_id % 4 = 0 THEN '  ' ELSE event_type END AS text, value AS c FROM events) WHERE trim(text) <> '' AND c >= 30")
def line_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("index"), F.when(F.col("event_id") % 4 == 0, "  ").otherwise(F.col("event_type")).alias("text"), F.col("value").alias("confidence"))
    return runs.filter_lines(rows, 30).select("doc", F.col("index").cast("long").alias("index"), "text")


@query("SELECT doc_id AS doc, round(sum(length(l) * ((i % 10) / 10)) / nullif(sum(length(l)), 0), 9) AS confidence FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) GROUP BY doc_id HAVING sum(length(l)) > 0")
def document_confidence(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("i", "text")).withColumn("confidence", F.col("i") % 10 / 10)
    return rounded(runs.document_confidence(d.groupBy("doc", "i", "text", "confidence").agg(F.count(F.lit(1))).where("length(text) > 0")))


@query("SELECT count(*) AS images, sum(CASE WHEN value < 400 THEN event_id % 5 END)::BIGINT AS lines, round(avg(CASE WHEN value < 400 THEN value / 1000 END), 6) AS mean_confidence, round(sum(CASE WHEN value < 400 THEN value END), 4) AS total_ms, count(*) FILTER (value >= 400) AS failures, sum(CASE WHEN value < 400 THEN length(event_type) END)::BIGINT AS characters FROM events")
def batch_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("text"), (F.col("value") / 1000).alias("confidence"), F.col("value").alias("total_ms"), (F.col("event_id") % 5).alias("line_count"), F.when(F.col("value") >= 400, "fault").alias("error"))
    out = runs.batch_summary(e)
    return out.select("images", "lines", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("total_ms", 4).alias("total_ms"), "failures", "characters")


@query("WITH l AS (SELECT 'model-' || (o_custkey % 40) || '|' || o_orderpriority || '|' || o_orderstatus AS k, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id FROM orders GROUP BY ALL), r AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 40 < 20 THEN 0 ELSE 1 END AS p, CASE WHEN o_orderkey % 11 > 0 THEN (o_orderkey * 7919 % 10007) / 10007 END AS cer FROM orders WHERE o_orderkey IN (SELECT id FROM l)) SELECT id, round(cer, 6) AS cer, row_number() OVER (ORDER BY p, cer NULLS LAST, id) AS place FROM r")
def comparison_table(spark, sf_dir):
    return reports.comparison_table(latest_runs(spark, sf_dir)).select("id", "cer", F.col("place").cast("long").alias("place"))


# --- jobs ----------------------------------------------------------------------------------------------------------


def spoiled(items: list) -> list[tuple[str, float]]:
    """A recogniser for texts as images: it reads th as t and is sure of short ones."""
    return [(x.replace("th", "t"), 1.0 if len(x) < 400 else 0.5) for x in items]


LETTERS = "array_to_string(list_transform(string_split({0}, ''), lambda z: chr((33 + list_position(letters, z))::INT)), '')"


@query(rf"""WITH p AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS a, trim(regexp_replace(replace(text, 'th', 't'), '\s+', ' ', 'g')) AS b, length(replace(text, 'th', 't')) AS n, length(text) AS m FROM benchmark),
t AS (SELECT *, list_distinct(string_split(a || b, '')) AS letters FROM p),
e AS (SELECT levenshtein({LETTERS.format("a")}, {LETTERS.format("b")}) AS edits, length(a) AS chars, a = b AS same, CASE WHEN m < 400 THEN 1 ELSE 0.5 END AS confidence FROM t)
SELECT count(*) AS num_samples, sum(edits)::BIGINT AS total_char_edits, round(sum(edits) / sum(chars), 6) AS cer, round(avg(same::INT), 6) AS sequence_accuracy, round(avg(confidence), 6) AS mean_confidence, 0::BIGINT AS failed_samples, (count(*) - 32 * least(2, ceil(count(*) / 32) - 1))::BIGINT AS timed_samples, 'spoiled' AS model_id FROM e""")
def benchmark_run(spark, sf_dir):
    """The benchmark job over items as images: recognised in batches, scored, timed, one run."""
    images = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.col("text").alias("label"), F.col("text").alias("image"))
    run, _ = recognise.benchmark(images, spoiled, "spoiled", "benchmark", "test")
    return rounded(run.select("num_samples", F.col("total_char_edits").cast("long").alias("total_char_edits"), "cer", "sequence_accuracy", "mean_confidence", "failed_samples", F.col("timed_samples").cast("long").alias("timed_samples"), "model_id"), 6)


@query("SELECT count(*) AS num_samples, sum(n)::BIGINT AS total_ref_chars, count(*) FILTER (a = b) / count(*) AS sequence_accuracy FROM (SELECT length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS a, trim(regexp_replace(replace(text, ' of', ''), '\\s+', ' ', 'g')) AS b FROM benchmark)")
def evaluate(spark, sf_dir):
    """Predictions and references as two tables, paired and scored in one call."""
    b = table(spark, sf_dir, "benchmark")
    total, _ = metrics.evaluate(b.select(F.col("item_id").alias("sample_id"), F.replace("text", F.lit(" of"), F.lit("")).alias("prediction")), b.select(F.col("item_id").alias("sample_id"), F.col("text").alias("reference")))
    return total.select("num_samples", F.col("total_ref_chars").cast("long").alias("total_ref_chars"), "sequence_accuracy")


@query(PART_SQL + """, c AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('42:' || path), path) AS k FROM p WHERE p_partkey % 6 > 0) SELECT 'parts' AS dataset, split, path, label FROM c WHERE k <= CASE split WHEN 'train' THEN 60 WHEN 'val' THEN 10 ELSE 1000000000 END""")
def prepared_corpus(spark, sf_dir):
    """Official splits with caps; parts whose number is a multiple of six have no file."""
    p = parts(spark, sf_dir)
    return prepare.prepare_corpus(p.select("split", "path", "label"), p.where("p_partkey % 6 > 0").select("path"), CHARSET, {"train": 60, "val": 10}, 76, dataset="parts")["manifest"].select("dataset", "split", "path", "label")


@query(PART_SQL + """, r AS (SELECT path, label, row_number() OVER (ORDER BY md5('42:' || path), path) - 1 AS k, count(*) OVER () AS n FROM p) SELECT path, label, CASE WHEN k < floor(n * 0.8::DOUBLE) THEN 'train' WHEN k < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r""")
def prepared_unsplit(spark, sf_dir):
    p = parts(spark, sf_dir)
    return prepare.prepare_unsplit(p.select("path", "label"), p.select("path"), CHARSET, 76)["manifest"].select("path", "label", "split")


@query(r"""WITH l AS (SELECT item_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM benchmark)
SELECT item_id AS page_id, string_agg('line ' || (i * 1000), chr(10) ORDER BY i) AS text FROM l WHERE trim(t) <> '' GROUP BY item_id""")
def reading_order(spark, sf_dir):
    """The layout job: words are merged into regions, regions grouped into rows, and the rows' texts put together."""
    boxes, texts = word_boxes(spark, sf_dir)
    pages = boxes.select("page_id").distinct().withColumns({"page_width": F.lit(10**6), "char_height": F.lit(20.0)})
    return layout.reading_order(boxes, texts.select("page_id", "idx", F.concat(F.lit("line "), "idx").alias("text")), pages)


# --- streams -------------------------------------------------------------------------------------------------------


def streamed(spark: SparkSession, rows: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Rows written as files and read as a stream, and a folder for its checkpoint."""
    path = scratch(spark, tag)
    rows.write.parquet(f"{path}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{path}/in"), path


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, 'user-' || user_id AS model_id, count(*) AS requests, round(avg(value), 6) AS avg_total_ms FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL")
def stream_daily_statistics(spark, sf_dir):
    """Days that the watermark, a day behind the newest request, has closed."""
    source, path = streamed(spark, requests(spark, sf_dir).select(F.col("created_at").cast("timestamp").alias("created_at"), "model_id", "total_ms", "confidence"), "daily")
    done = jobs.daily_statistics(source).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/c").outputMode("append").trigger(availableNow=True).start()
    done.awaitTermination()
    return rounded(spark.read.parquet(f"{path}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "model_id", "requests", "avg_total_ms"), 6)


@query("SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status, max(event_id) AS epoch, count(*) AS entries FROM events GROUP BY user_id")
def stream_job_progress(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "ts", F.struct("ts", "event_id", "event_type").alias("status"), F.col("event_id").alias("epoch"), F.concat(F.lit("entry "), "event_id").alias("history_entry"))
    latest = e.groupBy("job_id").agg(F.max("epoch").alias("top"))
    source, path = streamed(spark, e.join(latest, "job_id").select("job_id", "ts", "status", F.col("top").alias("epoch"), "history_entry"), "jobs")
    jobs.job_progress(source, f"{path}/out").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start().awaitTermination()
    return jobs.read_jobs(spark, f"{path}/out").select("job_id", F.col("status.event_type").alias("status"), "epoch", F.size("history").cast("long").alias("entries"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS label FROM documents), c AS (SELECT doc_id, label, trim(regexp_replace(label, '\\s+', ' ', 'g')) AS clean FROM l),
e AS (SELECT doc_id, CASE WHEN lower(clean) IN ('unreadable', 'nan', 'none', 'null', '', '#', '?') THEN 'unreadable' WHEN length(clean) <> length(regexp_replace(clean, '[^ -~]', '', 'g')) THEN 'unsupported_chars' WHEN length(clean) > 76 THEN 'too_long' END AS reason FROM c)
SELECT doc_id AS path, reason, count(*) AS rows FROM e GROUP BY ALL""")
def stream_ingest(spark, sf_dir):
    """Lines cleaned as they come, into good rows and rejects."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.explode(F.split("text", "\n")).alias("label"))
    source, path = streamed(spark, d, "ingest")
    jobs.ingest(source, CHARSET, 76, f"{path}/good", f"{path}/bad").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start().awaitTermination()
    good = spark.read.parquet(f"{path}/good").select("path", F.lit(None).cast("string").alias("reason"))
    return good.unionByName(spark.read.parquet(f"{path}/bad").select("path", "reason")).groupBy("path", "reason").agg(F.count(F.lit(1)).alias("rows"))


@query("""SELECT seq, least(1, greatest(0, round(exp(sum(CASE WHEN token <> 0 THEN logp ELSE 0 END) / greatest(1, count(*) FILTER (token <> 0))), 9))) AS confidence FROM (SELECT l_orderkey AS seq, l_suppkey % 3 AS token, -l_discount AS logp FROM lineitem) GROUP BY seq""")
def token_confidence(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq"), (F.col("l_suppkey") % 3).alias("token"), (-F.col("l_discount")).alias("logp"))
    return rounded(sequence.token_confidence(t, 0))


@query("SELECT user_id AS run, round(sum(CASE WHEN value <= 400 THEN value * size END) / sum(CASE WHEN value <= 400 THEN size END), 6) AS loss, count(*) FILTER (value > 400) AS skipped FROM (SELECT *, event_id % 8 + 1 AS size FROM events) GROUP BY user_id")
def loss_summary(spark, sf_dir):
    """Weighted mean losses of runs; losses that are not finite are skipped."""
    b = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.when(F.col("value") > 400, F.lit(float("inf"))).otherwise(F.col("value")).alias("loss"), (F.col("event_id") % 8 + 1).alias("size"))
    return rounded(sequence.loss_summary(b, "run"), 6)


@query("SELECT conv_id, turn, replace(replace(text, chr(13) || chr(10), chr(10)), chr(10), chr(13) || chr(10)) AS text FROM conversations")
def windows_lines(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.line_endings(F.col("text"), mark=False).alias("text"))
