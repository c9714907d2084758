"""The registered queries of the library and their DuckDB counterparts.

All run over whole tables. Some score texts as lines of forty words, which is what a line recogniser gives; the whole_text
queries score whole texts. DuckDB's edit distance counts bytes, so its side writes each distinct character of a pair as
one byte; word distances of whole texts have more distinct words than that and are tested against a plain table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribe.functions import scoring, text
from scribe.operators import contrastive, corpus, latency, layout, metrics, runs, sequence
from scribe.plans import reports
from scribe.session import dealt, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


CHARSET = text.Charset()

# --- scoring -------------------------------------------------------------------------------------------------------

PAIRS_SQL = r"""
WITH s AS (SELECT doc_id, lang, string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' ') AS w FROM documents),
l AS (SELECT doc_id, lang, w, unnest(range(0, len(w), 40)) AS at_ FROM s),
p AS (SELECT doc_id * 1000000 + at_ AS sample_id, lang, array_to_string(w[at_ + 1:at_ + 40], ' ') AS reference FROM l),
q AS (SELECT *, trim(regexp_replace(replace(replace(reference, 'th', 't'), ' of', ''), '\s+', ' ', 'g')) AS prediction FROM p WHERE reference <> ''),
t AS (SELECT *, string_split(reference, ' ') AS a, CASE WHEN prediction = '' THEN [] ELSE string_split(prediction, ' ') END AS b, list_distinct(string_split(reference || prediction, '')) AS letters,
  lower(regexp_replace(reference, '[^0-9a-zA-Z]+', '', 'g')) AS x, lower(regexp_replace(prediction, '[^0-9a-zA-Z]+', '', 'g')) AS y FROM q),
u AS (SELECT *, list_distinct(list_concat(a, b)) AS names FROM t),
m AS (SELECT sample_id, lang, reference, prediction, length(reference) AS ref_chars,
  levenshtein(array_to_string(list_transform(string_split(reference, ''), lambda z: chr((33 + list_position(letters, z))::INT)), ''), CASE WHEN prediction = '' THEN '' ELSE array_to_string(list_transform(string_split(prediction, ''), lambda z: chr((33 + list_position(letters, z))::INT)), '') END) AS char_edits,
  levenshtein(array_to_string(list_transform(a, lambda z: chr((33 + list_position(names, z))::INT)), ''), array_to_string(list_transform(b, lambda z: chr((33 + list_position(names, z))::INT)), '')) AS word_edits,
  len(a) AS ref_words, reference = prediction AS exact_match, levenshtein(x, y) AS norm_edits, length(x) AS norm_chars, x = y AS norm_match FROM u),
v AS (SELECT *, char_edits / ref_chars AS cer, word_edits / ref_words AS wer FROM m)
"""
TOTALS_SQL = """count(*) AS num_samples, round(sum(char_edits) / sum(ref_chars), 9) AS cer, round(sum(word_edits) / sum(ref_words), 9) AS wer,
  round(avg(cer), 9) AS cer_macro, round(avg(wer), 9) AS wer_macro, round(avg(exact_match::DOUBLE), 9) AS sequence_accuracy,
  round(greatest(0, 1 - sum(char_edits) / sum(ref_chars)), 9) AS character_accuracy, sum(char_edits)::BIGINT AS total_char_edits,
  sum(ref_chars)::BIGINT AS total_ref_chars, sum(word_edits)::BIGINT AS total_word_edits, sum(ref_words)::BIGINT AS total_ref_words"""


def scoring_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of forty words; they are cut inside the row, so that no line carries its whole text along."""
    d = dealt(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    words = F.array(F.struct(F.split(text.collapse(F.coalesce("text", F.lit(""))), " ").alias("w")))
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.size(x["w"]) - 1, F.lit(40)), lambda at: F.struct(at.alias("at"), F.array_join(F.slice(x["w"], at + 1, F.lit(40)), " ").alias("line")))
    lines = d.select("doc_id", "lang", F.explode(F.transform(words, cut)[0]).alias("l"))
    p = lines.select((F.col("doc_id") * 1000000 + F.col("l.at")).alias("sample_id"), "lang", F.col("l.line").alias("reference")).where("reference <> ''")
    return p.withColumn("prediction", F.replace(F.replace("reference", F.lit("th"), F.lit("t")), F.lit(" of"), F.lit("")))


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@query(PAIRS_SQL + f"SELECT {TOTALS_SQL} FROM v")
def corpus_metrics(spark, sf_dir):
    return rounded(metrics.corpus_metrics(metrics.sample_metrics(scoring_pairs(spark, sf_dir), normalise=False), normalise=False))


@query(PAIRS_SQL + "SELECT count(*) AS num_samples, round(sum(norm_edits) / sum(norm_chars), 9) AS cer_normalized, round(avg(norm_match::DOUBLE), 9) AS sequence_accuracy_normalized FROM v")
def normalized_metrics(spark, sf_dir):
    out = metrics.corpus_metrics(metrics.sample_metrics(scoring_pairs(spark, sf_dir)))
    return rounded(out.select("num_samples", "cer_normalized", "sequence_accuracy_normalized"))


@query(PAIRS_SQL + f"SELECT lang, grouping(lang)::BIGINT AS level, {TOTALS_SQL} FROM v GROUP BY ROLLUP (lang)")
def metrics_by_lang(spark, sf_dir):
    return rounded(metrics.grouped_metrics(metrics.sample_metrics(scoring_pairs(spark, sf_dir), normalise=False), "lang", normalise=False))


@query(PAIRS_SQL + "SELECT sample_id, reference, prediction, round(cer, 9) AS cer, round(wer, 9) AS wer, char_edits FROM v ORDER BY char_edits / ref_chars DESC, char_edits DESC, sample_id LIMIT 20")
def worst_samples(spark, sf_dir):
    out = metrics.worst_samples(metrics.sample_metrics(scoring_pairs(spark, sf_dir), normalise=False), 20)
    return rounded(out.select("sample_id", "reference", "prediction", "cer", "wer", F.col("char_edits").cast("long").alias("char_edits")))


WHOLE_SQL = r"""
WITH p AS (SELECT doc_id, lang, trim(regexp_replace(text, '\s+', ' ', 'g')) AS reference,
  trim(regexp_replace(replace(replace(replace(replace(replace(text, 'th', 't'), ' of', ''), 'é', 'e'), 'ß', 'ss'), 'ñ', 'n'), '\s+', ' ', 'g')) AS prediction FROM documents WHERE text IS NOT NULL),
l AS (SELECT *, list_distinct(string_split(reference || prediction, '')) AS letters FROM p),
m AS (SELECT doc_id, lang, reference, prediction, length(reference) AS ref_chars, levenshtein(array_to_string(list_transform(string_split(reference, ''), lambda z: chr(list_position(letters, z)::INT)), ''),
  CASE WHEN prediction = '' THEN '' ELSE array_to_string(list_transform(string_split(prediction, ''), lambda z: chr(list_position(letters, z)::INT)), '') END) AS char_edits FROM l WHERE reference <> '')
"""


def whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with predictions that lose letters, words and accents."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("sample_id"), "lang", F.col("text").alias("reference"))
    d = dealt(d, "sample_id")
    lost = F.col("reference")
    for said, read in (("th", "t"), (" of", ""), ("é", "e"), ("ß", "ss"), ("ñ", "n")):
        lost = F.replace(lost, F.lit(said), F.lit(read))
    return d.where(text.collapse(F.col("reference")) != "").withColumn("prediction", lost)


@query(WHOLE_SQL + """SELECT lang, count(*) AS num_samples, sum(char_edits)::BIGINT AS total_char_edits, sum(ref_chars)::BIGINT AS total_ref_chars, round(sum(char_edits) / sum(ref_chars), 9) AS cer,
  round(avg(char_edits / ref_chars), 9) AS cer_macro, round(avg((reference = prediction)::DOUBLE), 9) AS sequence_accuracy FROM m GROUP BY lang""")
def whole_text_metrics(spark, sf_dir):
    out = metrics.grouped_metrics(metrics.sample_metrics(whole_texts(spark, sf_dir), normalise=False), "lang", normalise=False).where("level = 0")
    return rounded(out.select("lang", "num_samples", "total_char_edits", "total_ref_chars", "cer", "cer_macro", "sequence_accuracy"))


@query(None)
def whole_text_words(spark, sf_dir):
    """Word and normalised figures of every whole text; a test holds them against a plain table."""
    return metrics.sample_metrics(whole_texts(spark, sf_dir)).select("sample_id", "word_edits", "ref_words", "norm_edits", "norm_chars")


# --- corpora -------------------------------------------------------------------------------------------------------

LINES_SQL = r"""
WITH r AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, source, unnest(lines) AS label, unnest(range(len(lines))) AS ord FROM r),
c AS (SELECT *, trim(regexp_replace(label, '\s+', ' ', 'g')) AS clean FROM l),
e AS (SELECT *, length(regexp_replace(clean, '[^ -~]', '', 'g')) AS encoded_length, CASE WHEN label IS NULL THEN 'empty'
  WHEN lower(clean) IN ('unreadable', 'nan', 'none', 'null', '', '#', '?') THEN 'unreadable' WHEN length(clean) <> encoded_length THEN 'unsupported_chars'
  WHEN encoded_length > 76 THEN 'too_long' WHEN encoded_length = 0 THEN 'empty' END AS reason FROM c)
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("ord", "label"))


@query(LINES_SQL + "SELECT source, count(*) AS total, count(*) FILTER (reason IS NULL) AS written, " + ", ".join(f"count(*) FILTER (reason = '{r}') AS skipped_{r}" for r in corpus.REASONS) + " FROM e GROUP BY source")
def label_rejects(spark, sf_dir):
    return corpus.reject_report(corpus.clean_labels(lines(spark, sf_dir), CHARSET, 76), "source")


@query(LINES_SQL + ", o AS (SELECT DISTINCT doc_id, ord, unnest(string_split(regexp_replace(clean, '[ -~]', '', 'g'), '')) AS character FROM e) SELECT character, count(*) AS rows FROM o WHERE character <> '' GROUP BY character")
def char_histogram(spark, sf_dir):
    return corpus.unsupported_histogram(lines(spark, sf_dir), CHARSET)


@query(LINES_SQL + "SELECT min(encoded_length)::BIGINT AS label_length_min, max(encoded_length)::BIGINT AS label_length_max, round(avg(encoded_length), 9) AS label_length_mean FROM e WHERE reason IS NULL")
def label_lengths(spark, sf_dir):
    out = rounded(corpus.label_lengths(corpus.clean_labels(lines(spark, sf_dir), CHARSET, 76)))
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("label_length_min", "label_length_max")], "label_length_mean")


@query("SELECT string_agg(c, '' ORDER BY c) AS alphabet FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> ''")
def alphabet(spark, sf_dir):
    return corpus.observed_alphabet(table(spark, sf_dir, "documents").withColumnRenamed("text", "label"))


@query(r"""WITH m AS (SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM labels) AS gone, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean, length(regexp_replace(clean, '[^ -~]', '', 'g')) AS n FROM documents),
f AS (SELECT count(*) AS total, count(*) FILTER (gone) AS missing, count(*) FILTER (NOT gone AND clean = '') AS empty_labels,
  count(*) FILTER (NOT gone AND clean <> '' AND length(clean) <> n) AS unsupported, count(*) FILTER (NOT gone AND clean <> '' AND n > 2000) AS too_long FROM m)
SELECT *, total - missing - empty_labels - too_long AS usable, (usable = total AND unsupported = 0 AND total > 0) AS ok FROM f""")
def manifest_validate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("label"))
    files = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"))
    out = corpus.validate_manifest(d, files, CHARSET, 2000)
    return out.select("total", "missing", "empty_labels", "unsupported", "too_long", "usable", "ok")


DRAW_SQL = "WITH r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS place, count(*) OVER () AS n FROM documents) "


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "lang")


@query(DRAW_SQL + "SELECT doc_id AS id, CASE WHEN place < floor(n * 0.8::DOUBLE) THEN 'train' WHEN place < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r")
def split_80_10_10(spark, sf_dir):
    return corpus.split_by_ratio(ids(spark, sf_dir)).select("id", "split")


@query(DRAW_SQL + "SELECT doc_id AS id FROM r WHERE place < 100")
def seeded_subset(spark, sf_dir):
    return corpus.seeded_subset(ids(spark, sf_dir), 100).select("id")


@query("SELECT id, split FROM (SELECT doc_id AS id, lang AS split, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS k FROM documents) WHERE k <= CASE split WHEN 'en' THEN 200 WHEN 'de' THEN 50 ELSE 1000000000 END")
def split_caps(spark, sf_dir):
    return corpus.split_caps(ids(spark, sf_dir).withColumnRenamed("lang", "split"), {"en": 200, "de": 50}).select("id", "split")


@query(DRAW_SQL + "SELECT doc_id AS id, CASE WHEN place < greatest(1, floor(n * 0.1::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM r")
def val_carve(spark, sf_dir):
    return corpus.carve_validation(ids(spark, sf_dir)).select("id", "split")


@query(DRAW_SQL + "SELECT doc_id AS id, CASE WHEN place < round_even(n * 0.3::DOUBLE, 0) THEN 'handwritten' ELSE 'printed' END AS category FROM r")
def quota_assign(spark, sf_dir):
    return corpus.assign_quota(ids(spark, sf_dir), 0.3, "handwritten", "printed").select("id", "category")


@query("SELECT doc_id AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabeled_pool(spark, sf_dir):
    path = lambda name: table(spark, sf_dir, name).select(F.col("doc_id").alias("path"))
    return corpus.unlabeled_pool(path("documents"), path("labels"))


@query("SELECT count(*) AS shared, count(*) = 0 AS disjoint FROM (SELECT text FROM documents INTERSECT SELECT text FROM benchmark)")
def leakage_check(spark, sf_dir):
    return corpus.leakage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "text")


@query("SELECT source_name, count(*) AS rows, sum(length(text))::BIGINT AS characters FROM (SELECT text, 'documents' AS source_name FROM documents UNION ALL SELECT text, 'benchmark' FROM benchmark UNION ALL SELECT text, 'conversations' FROM conversations) GROUP BY ALL")
def combined_corpus(spark, sf_dir):
    parts = {n: table(spark, sf_dir, n).select("text") for n in ("documents", "benchmark", "conversations")}
    return corpus.combined(parts).groupBy("source_name").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("characters"))


@query("SELECT source AS dataset, count(*) FILTER (k < 8) AS train, count(*) FILTER (k = 8) AS val, count(*) FILTER (k = 9) AS test, 0::BIGINT AS unlabeled, count(*) > 0 AS ready, (train > 0 AND val > 0) AS trainable FROM (SELECT source, doc_id % 10 AS k FROM documents) GROUP BY source")
def dataset_catalogue(spark, sf_dir):
    k = F.col("doc_id") % 10
    split = F.when(k < 8, "train").when(k == 8, "val").otherwise("test")
    return corpus.dataset_catalogue(table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"), split.alias("split")))


@query("SELECT doc_id, batch FROM (SELECT doc_id, doc_id // 32 AS batch, count(*) OVER (PARTITION BY doc_id // 32) AS n FROM documents) WHERE n = 32")
def minibatches(spark, sf_dir):
    return corpus.minibatches(table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("ord")), 32, drop_last=True).select("doc_id", "batch")


@query("SELECT lang, source, ord FROM (SELECT lang, source, doc_id AS ord, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 3")
def first_per_category(spark, sf_dir):
    return corpus.first_per_category(table(spark, sf_dir, "documents").select("lang", "source", F.col("doc_id").alias("ord")), "lang", 3)


# --- text functions ------------------------------------------------------------------------------------------------

SPACED = (r"([,.;:!?])", r" \1 ")


@query(r"""WITH t AS (SELECT conv_id, turn, string_split(regexp_replace(regexp_replace(text, '[^\x00-\x7F]', '?', 'g'), '([,.;:!?])', ' \1 ', 'g'), chr(10)) AS l FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(l, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x,
  '(\d)\s+\.\s+(\d)', '\1.\2', 'g'), '\s+([,;:!?%])', '\1', 'g'), '\s+\.', '.', 'g'), '([(\[{$])\s+', '\1', 'g'), '\s+([)\]}])', '\1', 'g'),
  '(\w)\s*''\s*(\w)', '\1''\2', 'g'), '(\w)\s+-\s+(\w)', '\1-\2', 'g'), '(\d),\s+(\d)', '\1,\2', 'g'), '[ \t]{2,}', ' ', 'g'))), chr(10)) AS text FROM t""")
def detokenize(spark, sf_dir):
    spaced = F.regexp_replace(F.regexp_replace("text", r"[^\x00-\x7F]", "?"), SPACED[0], " $1 ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.detokenize(spaced).alias("text"))


@query(r"""SELECT page_id, coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(trim(coalesce(url, '')), '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), 1, 60), '[-._]+$', ''), ''), 'extracted-text') AS file FROM pages""")
def safe_filename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.safe_filename(F.col("url")).alias("file"))


@query(r"SELECT doc_id, length(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[^ -~]', '', 'g'))::BIGINT AS encoded_length FROM documents")
def encode_len(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", CHARSET.encoded_length(F.col("text")).cast("long").alias("encoded_length"))


@query(r"""WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^ -~]', '', 'g'), '\s+', ' ', 'g')) AS c, substr(c, 1, 76) AS h FROM documents)
SELECT doc_id, trim(CASE WHEN length(c) > 76 AND instr(h, ' ') > 0 AND 76 - instr(reverse(h), ' ') >= 3 THEN substr(h, 1, 76 - instr(reverse(h), ' ')) WHEN length(c) > 76 THEN h ELSE c END) AS label FROM c""")
def clip_label(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clip_label(F.col("text")).alias("label"))


@query(r"SELECT doc_id, length(text)::BIGINT AS characters, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))::BIGINT AS words, len(string_split(text, chr(10)))::BIGINT AS lines FROM documents")
def text_counts(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("doc_id", text.text_counts(F.col("text")).alias("c"))
    return c.select("doc_id", *[F.col(f"c.{x}").cast("long").alias(x) for x in ("characters", "words", "lines")])


# --- run store -----------------------------------------------------------------------------------------------------

REQUESTS_SQL = """
WITH q AS (SELECT event_id AS id, ts AS created_at, 'user-' || user_id AS model_id, event_type AS text, props AS original_filename, value AS total_ms,
  (props->>'$.k')::DOUBLE AS k, k / 100 AS confidence, CASE WHEN event_id % 3 = 0 THEN k / 200 END AS cer FROM events)
"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognition requests: users are models, values are times, k is the size and a hundredth of it the confidence."""
    k = scoring.json_number(F.col("props"), "$.k")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.concat(F.lit("user-"), "user_id").alias("model_id"), F.col("event_type").alias("text"), F.col("props").alias("original_filename"),
        F.col("value").alias("total_ms"), k.cast("long").alias("character_count"), (k / 100).alias("confidence"), F.when(F.col("event_id") % 3 == 0, k / 200).alias("cer"), F.when(F.col("event_id") % 3 == 0, k / 100).alias("wer"), F.when(F.col("event_id") % 3 == 0, F.lit("truth")).alias("ground_truth"),
    )


@query(REQUESTS_SQL + "SELECT id, created_at, model_id, total_ms FROM q ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100")
def history_page(spark, sf_dir):
    return runs.page(requests(spark, sf_dir), 100, 50).select("id", "created_at", "model_id", "total_ms")


@query(REQUESTS_SQL + "SELECT id, model_id, text FROM q WHERE id % 3 = 0 AND (lower(text) LIKE '%cl_ck%' OR lower(original_filename) LIKE '%cl_ck%')")
def history_search(spark, sf_dir):
    return runs.search(requests(spark, sf_dir), scored=True, text="CL_CK").select("id", "model_id", "text")


@query(REQUESTS_SQL + "SELECT count(*) AS total, sum(k)::BIGINT AS total_characters, round(avg(confidence), 6) AS avg_confidence, round(avg(total_ms), 6) AS avg_total_ms, count(cer) AS scored, round(avg(cer), 6) AS avg_cer, round(avg(cer * 2), 6) AS avg_wer, count(*) FILTER (created_at >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS) AS recent FROM q")
def history_stats(spark, sf_dir):
    r = requests(spark, sf_dir)
    last = r.agg(F.max("created_at").alias("as_of"))
    out = runs.history_statistics(r.crossJoin(F.broadcast(last)), F.col("as_of"))  # one row is broadcast
    return rounded(out, 6)


@query(REQUESTS_SQL + "SELECT model_id, count(*) AS requests FROM q GROUP BY model_id")
def requests_by_model(spark, sf_dir):
    return runs.requests_by_model(requests(spark, sf_dir))


RUNS_SQL = """
WITH r AS (SELECT o_orderkey AS id, o_orderdate AS created_at, 'model-' || (o_custkey % 40) AS model_id, CASE WHEN o_custkey % 40 < 20 THEN 'project' ELSE 'pretrained' END AS provenance,
  o_orderpriority AS dataset, o_orderstatus AS split, ['control', 'treatment', 'other'][o_custkey % 3 + 1] AS experiment_arm, o_orderkey % 997 AS num_samples,
  CASE WHEN o_orderkey % 11 > 0 THEN (o_orderkey * 7919 % 10007) / 10007 END AS cer, (o_orderkey * 104729 % 10009) / 10009 AS sequence_accuracy FROM orders),
g AS (SELECT *, row_number() OVER (PARTITION BY model_id, dataset, split ORDER BY created_at DESC, id DESC) AS k FROM r),
l AS (SELECT * EXCLUDE k FROM g WHERE k = 1)
"""


def evaluation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), F.col("o_orderdate").alias("created_at"), F.concat(F.lit("model-"), cust % 40).alias("model_id"), F.when(cust % 40 < 20, "project").otherwise("pretrained").alias("provenance"),
        F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("split"), F.element_at(F.array(F.lit("control"), F.lit("treatment"), F.lit("other")), (cust % 3 + 1).cast("int")).alias("experiment_arm"), (key % 997).alias("num_samples"),
        F.when(key % 11 > 0, key * 7919 % 10007 / 10007).alias("cer"), (key * 104729 % 10009 / 10009).alias("sequence_accuracy"),
    )


def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each model's newest run on each dataset and split."""
    r = evaluation_runs(spark, sf_dir).withColumn("model", F.col("model_id")).withColumn("model_id", F.concat_ws("|", "model_id", "dataset", "split"))
    return runs.latest_per_model(r).withColumn("model_id", F.col("model")).drop("model")


@query(RUNS_SQL + "SELECT id, model_id, dataset, split FROM l")
def latest_per_model(spark, sf_dir):
    return latest_runs(spark, sf_dir).select("id", "model_id", "dataset", "split")


@query(RUNS_SQL + "SELECT id, row_number() OVER (ORDER BY CASE provenance WHEN 'project' THEN 0 ELSE 1 END, cer NULLS LAST, id) AS place FROM l")
def comparison_order(spark, sf_dir):
    from pyspark.sql import Window

    r = latest_runs(spark, sf_dir)  # one row for each model, dataset and split
    return r.select("id", F.row_number().over(Window.orderBy(*runs.comparison_order(r))).cast("long").alias("place"))


PAIR_SQL = RUNS_SQL + """, o AS (SELECT *, row_number() OVER (ORDER BY CASE provenance WHEN 'project' THEN 0 ELSE 1 END, cer NULLS LAST, id) AS place FROM l WHERE experiment_arm IN ('control', 'treatment')),
p AS (SELECT dataset, split, min(place) AS first, arg_min(model_id, place) FILTER (experiment_arm = 'control') AS control_id, arg_min(model_id, place) FILTER (experiment_arm = 'treatment') AS treatment_id,
  min_by(struct_pack(c := cer, s := sequence_accuracy, n := num_samples), place) FILTER (experiment_arm = 'control') AS c, min_by(struct_pack(c := cer, s := sequence_accuracy, n := num_samples), place) FILTER (experiment_arm = 'treatment') AS t FROM o GROUP BY ALL),
w AS (SELECT *, least(c.n, t.n) AS samples FROM p WHERE c IS NOT NULL AND t IS NOT NULL)
"""
GAIN_SQL = "dataset, split, control_id, treatment_id, round(c.c - t.c, 9) AS absolute, round(CASE WHEN c.c > 0 THEN (c.c - t.c) / c.c ELSE 0 END, 9) AS relative, round(t.s - c.s, 9) AS accuracy_delta, CASE WHEN c.c - t.c > 0 THEN 'improved' ELSE 'not improved' END AS verdict"


@query(PAIR_SQL + "SELECT dataset, split, control_id, treatment_id, samples FROM w ORDER BY samples DESC, first LIMIT 1")
def experiment_pair(spark, sf_dir):
    p = runs.experiment_pair(latest_runs(spark, sf_dir))
    return p.select("dataset", "split", F.col("control.model_id").alias("control_id"), F.col("treatment.model_id").alias("treatment_id"), "samples")


@query(PAIR_SQL + f"SELECT {GAIN_SQL} FROM w")
def improvement(spark, sf_dir):
    return rounded(runs.arm_improvement(runs.experiment_pairs(latest_runs(spark, sf_dir))))


@query("""WITH r AS (SELECT l_orderkey AS run_id, l_linenumber AS ord, 'm' || (l_suppkey % 7) AS model_id, l_extendedprice AS total_ms, CASE WHEN l_tax > 0.02 THEN l_discount END AS cer, CASE WHEN l_returnflag = 'R' THEN 'failed' END AS error, l_shipdate::VARCHAR AS text FROM lineitem)
SELECT run_id, arg_min(model_id, (total_ms, ord, model_id)) FILTER (error IS NULL) AS fastest_model_id, arg_min(model_id, (cer, ord, model_id)) FILTER (error IS NULL AND cer IS NOT NULL) AS most_accurate_model_id FROM r GROUP BY run_id""")
def fastest_model(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("m"), F.col("l_suppkey") % 7).alias("model_id"), F.col("l_extendedprice").alias("total_ms"), F.when(F.col("l_tax") > 0.02, F.col("l_discount")).alias("cer"), F.when(F.col("l_returnflag") == "R", "failed").alias("error"), F.col("l_shipdate").cast("string").alias("text"))
    return runs.fastest_and_best(r, "run_id")


@query(REQUESTS_SQL + r""", c AS (SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN '' ELSE 'cl  ick' END AS new FROM events WHERE event_id % 5 = 0)
SELECT q.id, CASE WHEN new = '' THEN NULL WHEN new IS NOT NULL THEN new WHEN q.id % 3 = 0 THEN 'truth' END AS ground_truth,
  round(CASE WHEN new = '' THEN NULL WHEN new IS NOT NULL THEN levenshtein(regexp_replace(new, '\s+', ' ', 'g'), trim(regexp_replace(text, '\s+', ' ', 'g'))) / length(regexp_replace(new, '\s+', ' ', 'g')) ELSE cer END, 9) AS cer FROM q LEFT JOIN c ON q.id = c.id""")
def apply_corrections(spark, sf_dir):
    r = requests(spark, sf_dir).withColumn("exact_match", F.lit(None).cast("boolean"))
    e = table(spark, sf_dir, "events").where("event_id % 5 = 0")
    changes = e.select(F.col("event_id").alias("id"), "ts", F.when(F.col("event_id") % 10 == 0, "  ").otherwise(" cl  ick ").alias("ground_truth"))
    older = changes.withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 DAY")).withColumn("ground_truth", F.lit("an older one"))
    return rounded(runs.apply_corrections(r, changes.unionByName(older)).select("id", "ground_truth", "cer"))


@query(REQUESTS_SQL + "SELECT id, model_id FROM q WHERE id NOT IN (SELECT o_orderkey FROM orders)")
def delete_ids(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return runs.delete_ids(requests(spark, sf_dir), gone).select("id", "model_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def cascade(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    return runs.cascade(table(spark, sf_dir, "lineitem"), parents, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-20') AS deleted, (sum(event_id) FILTER (ts < TIMESTAMP '2024-01-20'))::BIGINT AS freed_bytes, count(*) FILTER (ts >= TIMESTAMP '2024-01-20') AS kept FROM events")
def retention_prune(spark, sf_dir):
    files = table(spark, sf_dir, "events").select(F.col("ts").alias("modificationTime"), F.col("event_id").alias("length"))
    return runs.retention(files, F.lit("2024-01-30").cast("timestamp"), 10)[1]


EPOCHS_SQL = "WITH h AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value, event_type FROM events) "


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), e.alias("epoch"), "value", "event_type")


@query(EPOCHS_SQL + "SELECT run, arg_min(epoch, (value, epoch)) AS best_epoch, min(value) AS best_value FROM h GROUP BY run")
def best_epoch(spark, sf_dir):
    return runs.best_epoch(epochs(spark, sf_dir))


@query(EPOCHS_SQL + "SELECT run, event_type AS metric, len(list(epoch)) AS known, (SELECT count(*) FROM events WHERE user_id = run) AS epochs, round(sum(value), 6) AS total FROM h GROUP BY ALL")
def metric_series(spark, sf_dir):
    history = epochs(spark, sf_dir).select("run", "epoch", F.create_map("event_type", "value").alias("metrics"))
    return runs.metric_points(history).groupBy("run", "metric").agg(F.count("value").alias("known"), F.count(F.lit(1)).alias("epochs"), F.round(F.sum("value"), 6).alias("total"))


@query("""WITH RECURSIVE h AS (SELECT user_id AS run_name, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value FROM events),
f AS (SELECT run_name, epoch, value AS best, epoch AS best_epoch, 0 AS waited, NULL::BIGINT AS stop_epoch FROM h WHERE epoch = 1
  UNION ALL SELECT f.run_name, h.epoch, CASE WHEN h.value < f.best - 1e-5 THEN h.value ELSE f.best END, CASE WHEN h.value < f.best - 1e-5 THEN h.epoch ELSE f.best_epoch END,
    CASE WHEN h.value < f.best - 1e-5 THEN 0 ELSE f.waited + 1 END, CASE WHEN NOT h.value < f.best - 1e-5 AND f.waited + 1 >= 20 THEN h.epoch END
  FROM f JOIN h ON h.run_name = f.run_name AND h.epoch = f.epoch + 1 WHERE f.stop_epoch IS NULL)
SELECT run_name, arg_max(best, epoch) AS best, arg_max(best_epoch, epoch) AS best_epoch, max(stop_epoch) AS stop_epoch FROM f GROUP BY run_name""")
def early_stop(spark, sf_dir):
    return sequence.early_stop(epochs(spark, sf_dir).withColumnRenamed("run", "run_name"), 20)


@query("""WITH a AS (SELECT p_size, map_from_entries([('brand', min(p_brand)), ('type', min(p_type)), ('price', (min(p_retailprice))::INT::VARCHAR)]) AS m FROM part GROUP BY p_size),
x AS (SELECT unnest(map_keys(m)) AS key, unnest(map_values(m)) AS v FROM a WHERE p_size = 1), y AS (SELECT unnest(map_keys(m)) AS key, unnest(map_values(m)) AS v FROM a WHERE p_size = 2)
SELECT key, x.v AS "left", y.v AS "right", key = 'price' AS allowed FROM x FULL JOIN y USING (key) WHERE x.v IS DISTINCT FROM y.v""")
def run_config_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy("p_size").agg(F.create_map(F.lit("brand"), F.min("p_brand"), F.lit("type"), F.min("p_type"), F.lit("price"), F.rint(F.min("p_retailprice")).cast("int").cast("string")).alias("m"))
    flat = lambda size: p.where(F.col("p_size") == size).select(F.explode("m").alias("key", "value"))
    return runs.config_diff(flat(1), flat(2), ["price"])


# --- latency, sequences, embeddings, layout ------------------------------------------------------------------------

@query("""WITH o AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS ord FROM events),
b AS (SELECT ord // 32 AS batch, sum(value) AS ms, count(*) AS size FROM o GROUP BY ALL), t AS (SELECT * FROM b WHERE batch >= least(2, (SELECT max(batch) FROM b))),
e AS (SELECT ms / size AS each, unnest(range(size)) FROM t)
SELECT (SELECT sum(size)::BIGINT FROM t) AS timed_samples, round((SELECT sum(ms) / sum(size) FROM t), 6) AS avg_ms, round(quantile_cont(each, 0.5), 6) AS median_ms, round(quantile_cont(each, 0.95), 6) AS p95_ms, round((SELECT sum(size) * 1000 / sum(ms) FROM t), 6) AS throughput_per_s FROM e""")
def latency_stats(spark, sf_dir):
    return rounded(latency.latency_stats(reports.timed_batches(table(spark, sf_dir, "events"), 32, 2)), 6)


@query("""WITH f AS (SELECT vec_id AS sample_id, unnest(range(16)) AS t, embedding FROM embeddings),
b AS (SELECT sample_id, t, embedding[t * 4 + 1:t * 4 + 4] AS z, list_position(z, list_max(z)) - 1 AS class, list_max(z)::DOUBLE AS logp FROM f),
c AS (SELECT *, lag(class) OVER (PARTITION BY sample_id ORDER BY t) AS before FROM b), k AS (SELECT * FROM c WHERE class <> 0 AND (before IS NULL OR before <> class))
SELECT e.vec_id AS sample_id, coalesce(string_agg(substr('abc', class::INT, 1), '' ORDER BY t), '') AS text, round(coalesce(exp(avg(ln(greatest(least(exp(logp), 1), 1e-12)))), 0), 9) AS confidence FROM embeddings e LEFT JOIN k ON k.sample_id = e.vec_id GROUP BY e.vec_id""")
def ctc_greedy(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("i", "z"))
    frames = e.select("sample_id", F.floor(F.col("i") / 4).alias("t"), (F.col("i") % 4).alias("class"), F.col("z").cast("double").alias("logp"))
    return rounded(sequence.greedy_decode(frames, text.Charset("abc")).select("sample_id", "text", "confidence"))


@query("""WITH e AS (SELECT vec_id // 64 AS batch, vec_id // 2 AS img, vec_id % 2 AS view, list_transform(embedding, lambda v: v::DOUBLE) AS z FROM embeddings WHERE vec_id < (SELECT count(*) // 64 * 64 FROM embeddings)),
u AS (SELECT batch, img, view, list_transform(z, lambda v: v / sqrt(list_sum(list_transform(z, lambda w: w * w)))) AS u FROM e),
p AS (SELECT a.batch, a.img, a.view, a.img = b.img AS pos, list_dot_product(a.u, b.u) AS s FROM u a JOIN u b ON a.batch = b.batch AND (a.img <> b.img OR a.view <> b.view)),
r AS (SELECT batch, img, view, max(s) AS top, ln(sum(exp(s / 0.5))) AS lse, max(s) FILTER (pos) AS positive, sum(s) FILTER (NOT pos) AS neg, count(*) FILTER (NOT pos) AS n FROM p GROUP BY ALL)
SELECT batch, round(avg(lse - positive / 0.5), 4) AS loss, round(avg((positive >= top)::INT), 4) AS accuracy, round(avg(positive), 4) AS positive_similarity, round(sum(neg) / sum(n), 4) AS negative_similarity FROM r GROUP BY batch""")
def contrastive_batches(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.floor(F.count(F.lit(1)) / 64) * 64)
    full = e.crossJoin(F.broadcast(n.toDF("full"))).where("vec_id < full")  # whole batches only, as in training; one row is broadcast
    emb = full.select(F.floor(F.col("vec_id") / 64).alias("batch"), F.floor(F.col("vec_id") / 2).alias("img"), (F.col("vec_id") % 2).alias("view"), F.col("embedding").alias("z"))
    return rounded(contrastive.contrastive_metrics(emb), 4)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink profiles: a document is a page, a line of it three rows of pixels and a blank one."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("line", "t"))
    rows = d.select("page_id", "line", F.length("t").alias("ink"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    return rows.select("page_id", (F.col("line") * 4 + F.col("k")).alias("row"), F.when(F.col("k") < 3, F.col("ink")).otherwise(0).alias("ink"))


@query("""WITH d AS (SELECT doc_id AS page_id, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT page_id, unnest(l) AS t, unnest(range(len(l))) AS line FROM d)
SELECT page_id, line * 4 AS begin, line * 4 + 3 AS "end" FROM x WHERE length(t) >= 2""")
def row_bands(spark, sf_dir):
    # rows are drawn six times as high, with gaps too wide to be closed
    wide = profiles(spark, sf_dir)
    spread = wide.select("page_id", (F.floor(F.col("row") / 4) * 24 + F.col("row") % 4 * 4).alias("from"), "ink").select("page_id", F.explode(F.sequence("from", F.col("from") + 3)).alias("row"), "ink")
    bands = layout.row_bands(spread, 400)
    return bands.select("page_id", (F.col("begin") / 6).cast("long").alias("begin"), ((F.col("begin") / 6) + 3).cast("long").alias("end"))


def word_boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(boxes, texts): the first words of each line of the benchmark items as boxes of a page, in a scattered order."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page_id"), F.posexplode(F.transform(F.split("text", "\n"), lambda l: F.filter(F.split(F.trim(l), r"\s+"), lambda w: w != ""))).alias("line", "w"))
    rows = items.select("page_id", "line", F.posexplode("w").alias("k", "text")).withColumn("idx", (F.col("line") * 1000 + F.col("k")).cast("int"))
    boxes = rows.select("page_id", "idx", (F.col("k") * 100 + 10).alias("x"), (F.col("line") * 40 + F.col("idx") * 7 % 5).alias("y"), F.lit(80).alias("width"), F.lit(24).alias("height"))
    return boxes, rows.select("page_id", "idx", "text")


@query(r"""WITH l AS (SELECT item_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM benchmark)
SELECT item_id AS page_id, string_agg(trim(regexp_replace(t, '\s+', ' ', 'g')), chr(10) ORDER BY i) AS text FROM l WHERE trim(t) <> '' GROUP BY item_id""")
def assemble_text(spark, sf_dir):
    boxes, texts = word_boxes(spark, sf_dir)
    none = F.array().cast("array<struct<a:int,b:int>>")
    laid = layout.group_rows(layout.boxes_of(boxes).withColumn("gutters", none))
    words = texts.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "text"))).alias("texts"))
    return layout.assemble_text(laid.join(words, "page_id")).select("page_id", "text")


@query(r"""WITH l AS (SELECT item_id AS page_id, unnest(string_split(text, chr(10))) AS t FROM benchmark)
SELECT page_id, count(*) AS rows, sum(len(string_split_regex(trim(t), '\s+')))::BIGINT AS boxes FROM l WHERE trim(t) <> '' GROUP BY page_id""")
def group_rows(spark, sf_dir):
    laid = layout.group_rows(layout.boxes_of(word_boxes(spark, sf_dir)[0]).withColumn("gutters", F.array().cast("array<struct<a:int,b:int>>")))
    return laid.select("page_id", F.size("rows").cast("long").alias("rows"), F.size(F.flatten("rows")).cast("long").alias("boxes"))


@query("""WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents),
g AS (SELECT doc_id, count(*) AS n, 240 + 20 * (doc_id % 3) AS a, 290 + 30 * (doc_id % 5) AS b FROM d GROUP BY doc_id),
f AS (SELECT *, n >= 4 AND 2 * n - n // 4 >= 6 AND n // 4 <= greatest(1, floor(n * 0.2::DOUBLE)) AND b - a >= 30 AND n - n // 4 >= n * 0.6::DOUBLE AS ok FROM g)
SELECT doc_id AS page_id, ok::BIGINT AS gutters, CASE WHEN ok THEN a END AS a, CASE WHEN ok THEN b END AS b FROM f""")
def gutters(spark, sf_dir):
    """Two columns of boxes for each document, a row for each line; every fourth row is one box across both."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("line", "t"))
    right = (F.col("page_id") % 5 * 30 + 290).cast("int")
    box = lambda side, x, width: F.struct(F.lit(side).alias("side"), x.alias("x"), width.cast("int").alias("width"))
    both = F.array(box(0, F.lit(40), F.col("page_id") % 3 * 20 + 200), box(1, right, F.lit(260)))
    boxes = d.select("page_id", "line", F.explode(F.when(F.col("line") % 4 == 3, F.array(box(0, F.lit(40), right + 220))).otherwise(both)).alias("b"))
    boxes = boxes.select("page_id", (F.col("line") * 2 + F.col("b.side")).alias("idx"), "b.x", (F.col("line") * 40).alias("y"), "b.width", F.lit(24).alias("height"))
    pages = d.select("page_id").distinct().withColumns({"page_width": F.lit(800), "char_height": F.lit(20.0)})
    found = layout.find_gutters(boxes, pages)
    return found.select("page_id", F.size("gutters").cast("long").alias("gutters"), F.get("gutters", F.lit(0))["a"].alias("a"), F.get("gutters", F.lit(0))["b"].alias("b"))


@query("""WITH l AS (SELECT doc_id AS page_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS t FROM documents),
k AS (SELECT page_id, i * 40 AS y, length(t) % 4 AS k FROM l)
SELECT page_id, CASE WHEN k = 2 THEN y ELSE y + 5 + 4 * (k = 0)::INT END AS begin, y + 25 + 4 * (k = 0)::INT AS "end" FROM k
UNION ALL SELECT page_id, y, y + 3 FROM k WHERE k = 0""")
def row_bands_joined(spark, sf_dir):
    """A thick run of rows for each line; where the length is even a thin one stands over it, near enough to be joined or not."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("line", "t"))
    kind, y = F.length("t") % 4, F.col("line") * 40
    run = lambda a, b: F.sequence(y + a, y + b - 1)
    rows = F.when(kind == 2, F.concat(run(0, 3), run(5, 25))).when(kind == 0, F.concat(run(0, 3), run(9, 29))).otherwise(run(5, 25))
    return layout.row_bands(d.select("page_id", F.explode(rows).alias("row"), F.lit(50).alias("ink")), 400)


@query(r"""WITH l AS (SELECT item_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line FROM benchmark),
w AS (SELECT item_id, line, string_split_regex(trim(t), '\s+') AS w FROM l WHERE trim(t) <> ''),
b AS (SELECT item_id, line, len(w) AS n, unnest(range(len(w))) AS k FROM w),
y AS (SELECT item_id, line, n, line * 40 + (line * 1000 + k) * 7 % 5 AS y FROM b),
m AS (SELECT item_id, line, any_value(n) AS n, min(y) AS y0, max(y) + 24 AS y1, floor((max(y) + 24 - min(y)) * 0.18::DOUBLE)::BIGINT AS pad FROM y GROUP BY item_id, line)
SELECT item_id AS page_id, line * 1000 AS idx, 10 - pad AS x, greatest(0, y0 - pad) AS y, (n - 1) * 100 + 80 + 2 * pad AS width, y1 + pad - greatest(0, y0 - pad) AS height FROM m""")
def regions(spark, sf_dir):
    """The words of a line are near enough to be one region, which is then grown."""
    boxes, _ = word_boxes(spark, sf_dir)
    pages = boxes.select("page_id").distinct().withColumns({"page_width": F.lit(10**6), "char_height": F.lit(20.0)})
    out = layout.regions(boxes, pages).select("page_id", F.explode("boxes").alias("b"))
    return out.select("page_id", *[F.col(f"b.{c}").cast("long").alias(c) for c in ("idx", "x", "y", "width", "height")])
