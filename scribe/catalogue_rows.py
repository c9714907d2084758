"""Registered queries of smaller operators: look-ups, discovery, labels, summaries of runs, boxes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scribe.catalogue import CHARSET, REQUESTS_SQL, RUNS_SQL, epochs, evaluation_runs, query, requests, rounded
from scribe.functions import geometry, text
from scribe.operators import layout, runs
from scribe.session import table


@query(r"SELECT doc_id, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS label FROM documents")
def sanitised_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.sanitise_label(F.col("text")).alias("label"))


@query(r"SELECT doc_id, regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '[^ -~]', '', 'g') AS text FROM documents WHERE doc_id % 2 = 0 OR text IS NOT NULL")
def encoded_and_decoded(spark, sf_dir):
    """Texts as classes and back: what is outside the alphabet is gone."""
    d = table(spark, sf_dir, "documents").where("doc_id % 2 = 0 or text is not null")
    return d.select("doc_id", CHARSET.decode(CHARSET.encode(text.collapse(F.coalesce("text", F.lit(""))))).alias("text"))


@query("SELECT l_orderkey, l_linenumber, least(greatest(ceil(l_discount * 10 * 32)::INT, l_linenumber, 1), 32)::INT AS steps FROM lineitem")
def valid_steps(spark, sf_dir):
    ratio = (F.col("l_discount").cast("double") * 10).alias("ratio")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geometry.valid_steps(ratio, 32, F.col("l_linenumber").cast("int")).cast("int").alias("steps"))


@query(REQUESTS_SQL + "SELECT id, model_id, total_ms FROM q WHERE id = 17")
def request_by_id(spark, sf_dir):
    return runs.by_id(requests(spark, sf_dir), 17).select("id", "model_id", "total_ms")


@query(RUNS_SQL + "SELECT id, model_id, cer FROM r WHERE dataset = '1-URGENT' AND split = 'O'")
def selected_runs(spark, sf_dir):
    return runs.select_runs(evaluation_runs(spark, sf_dir), dataset="1-URGENT", split="O", model_id=None).select("id", "model_id", "cer")


@query("""WITH f AS (SELECT 'runs/' || (p_partkey // 4) AS run_dir, ['best.pt', 'last.pt', 'history.json', 'encoder.pt'][CASE WHEN p_partkey % 4 = 3 AND p_partkey % 8 <> 7 THEN 2 ELSE p_partkey % 4 END + 1] AS name FROM part)
SELECT run_dir, bool_or(name = 'best.pt') AS best, bool_or(name = 'last.pt') AS last, bool_or(name = 'history.json') AS history FROM f GROUP BY run_dir HAVING bool_or(name IN ('best.pt', 'last.pt')) AND NOT bool_or(name = 'encoder.pt')""")
def discovered_runs(spark, sf_dir):
    k = F.col("p_partkey")
    at = F.when((k % 4 == 3) & (k % 8 != 7), 2).otherwise(k % 4)
    names = F.array(*[F.lit(n) for n in ("best.pt", "last.pt", "history.json", "encoder.pt")])
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("runs/"), F.floor(k / 4).cast("string"), F.lit("/"), F.element_at(names, (at + 1).cast("int"))).alias("path"))
    return runs.discover_runs(files).select("run_dir", "best", "last", "history")


@query("SELECT 'img/' || p_partkey AS path, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '' END AS text, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE 'printed' END AS kind FROM part")
def files_with_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("path", F.concat(F.lit("img/"), "p_partkey"))
    return runs.files_with_labels(p.select("path"), p.where("p_partkey % 3 = 0").select("path", F.col("p_name").alias("text"), F.col("p_type").alias("kind")))


@query("""SELECT run, epoch, loss FROM (SELECT user_id AS run, epoch, value AS loss, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN epoch % 3 = 0 THEN 1 ELSE 0 END, value, epoch) AS k FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events)) WHERE k = 1""")
def run_summaries(spark, sf_dir):
    """The best epoch of each run; every third epoch has no monitored value and cannot be it."""
    h = epochs(spark, sf_dir)
    monitored = F.when(h["epoch"] % 3 == 0, F.create_map(F.lit("loss"), "value")).otherwise(F.create_map(F.lit("loss"), "value", F.lit("val"), "value"))
    out = runs.run_summary(h.select("run", "epoch", monitored.alias("metrics")), "val")
    return out.select("run", "epoch", F.try_element_at("metrics", F.lit("loss")).alias("loss"))


@query("""SELECT page_id, idx, x, y, width, height FROM (SELECT l_orderkey AS page_id, l_linenumber AS idx, l_partkey % 1000 AS x, l_suppkey % 100 AS y, l_quantity::INT AS width, l_linenumber + 5 AS height,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity::INT * (l_linenumber + 5) DESC, l_suppkey % 100, l_partkey % 1000, l_linenumber) AS k FROM lineitem) WHERE k <= 3""")
def largest_boxes(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("idx"), (F.col("l_partkey") % 1000).alias("x"), (F.col("l_suppkey") % 100).alias("y"), F.col("l_quantity").cast("int").alias("width"), (F.col("l_linenumber") + 5).alias("height"))
    return layout.largest_boxes(b, 3).select("page_id", "idx", "x", "y", "width", "height")


@query("SELECT p_partkey, p_brand || '|' || p_type || '|m' || (p_partkey % 2) AS ids FROM part")
def requested_models(spark, sf_dir):
    told = F.concat(F.lit(" "), "p_brand", F.lit(", ,"), "p_type", F.lit(",m"), F.col("p_partkey") % 2, F.lit(", "), "p_brand", F.lit(" ,"))
    return runs.requested_models(table(spark, sf_dir, "part").withColumn("models", told)).select("p_partkey", F.array_join("model_ids", "|").alias("ids"))


@query("SELECT 'user-' || user_id AS model_id, round(sum(value) / count(*), 6) AS seconds_per_page FROM events GROUP BY user_id")
def seconds_per_page(spark, sf_dir):
    return rounded(runs.seconds_per_page(requests(spark, sf_dir).withColumn("elapsed_s", F.col("total_ms"))), 6)


@query(RUNS_SQL + "SELECT split, CASE WHEN count(DISTINCT n) = 1 THEN max(n)::VARCHAR ELSE 'differ' END AS samples FROM (SELECT split, CASE WHEN split = 'O' THEN 7 ELSE num_samples END AS n FROM r) GROUP BY split")
def sample_counts(spark, sf_dir):
    r = evaluation_runs(spark, sf_dir).withColumn("num_samples", F.when(F.col("split") == "O", 7).otherwise(F.col("num_samples")))
    each = [runs.sample_counts_agree(r.where(F.col("split") == s)).select(F.lit(s).alias("split"), "samples") for s in ("F", "O", "P")]  # the statuses of orders
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("SELECT model_id, row_number() OVER (ORDER BY CASE s % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, model_id) AS place FROM (SELECT s_suppkey AS s, s_name AS model_id FROM supplier)")
def registry_places(spark, sf_dir):
    m = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("model_id"), F.element_at(F.array(F.lit("project"), F.lit("pretrained"), F.lit("other")), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("provenance"))
    return m.select("model_id", F.row_number().over(Window.orderBy(*runs.registry_order(m))).cast("long").alias("place"))


@query("SELECT count(*) AS deleted, 0::BIGINT AS remaining FROM events")
def cleared_history(spark, sf_dir):
    empty, deleted = runs.clear_all(requests(spark, sf_dir), confirm=True)
    return empty.agg(F.count(F.lit(1)).alias("remaining")).select(F.lit(deleted).cast("long").alias("deleted"), "remaining")
