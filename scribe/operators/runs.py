"""The run store: histories, statistics, comparisons of runs, corrections and deletions as new snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from scribe.functions import scoring

ARMS = ("control", "treatment")


class NotFound(LookupError):
    """No row has the id that was asked for."""


def history_list(requests: DataFrame) -> DataFrame:
    """The columns of a history list; nested details stay in the store."""
    heavy = ("lines", "segmentation", "preprocessing_meta", "preprocess_options", "stored_filename")
    has_image = F.coalesce(F.col("stored_filename") != "", F.lit(False)) if "stored_filename" in requests.columns else F.lit(False)
    return requests.select(*[c for c in requests.columns if c not in heavy], has_image.alias("has_image"))


def search(requests: DataFrame, model_id: str | None = None, scored: bool = False, text: str | None = None) -> DataFrame:
    """Rows of a model, with a reference, whose text or file name contains a string in any case; % and _ are wildcards."""
    if model_id is not None:
        requests = requests.where(F.col("model_id") == model_id)
    if scored:
        requests = requests.where(F.col("ground_truth").isNotNull())
    if text:
        pattern = "%" + text.lower().replace("\\", "\\\\") + "%"
        requests = requests.where(F.lower("text").like(pattern) | F.lower("original_filename").like(pattern))
    return requests


def select_runs(runs: DataFrame, **wanted: str | None) -> DataFrame:
    """Evaluation runs by model_id, dataset or split, each optional."""
    for column, value in wanted.items():
        if value is not None:
            runs = runs.where(F.col(column) == value)
    return runs


def page(rows: DataFrame, offset: int, size: int, most: int = 200) -> DataFrame:
    """Newest first, ids descending; the size is clamped to 1..most. The total is rows.count(), apart from paging."""
    return rows.orderBy(F.desc("created_at"), F.desc("id")).offset(max(0, offset)).limit(min(max(1, size), most))


def by_id(rows: DataFrame, key) -> DataFrame:
    found = rows.where(F.col("id") == key)
    if found.isEmpty():
        raise NotFound(f"no row has the id {key!r}")
    return found


def active(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin("queued", "running"))


def recent_jobs(jobs: DataFrame, n: int = 50) -> DataFrame:
    """The newest jobs first."""
    return jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def history_statistics(requests: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """One row; averages of scores are over scored rows only and null without any."""
    recent = F.col("created_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")
    return requests.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum("character_count"), F.lit(0)).alias("total_characters"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.avg("total_ms"), F.lit(0.0)).alias("avg_total_ms"),
        F.count_if(F.col("cer").isNotNull()).alias("scored"),
        F.avg("cer").alias("avg_cer"),
        F.avg("wer").alias("avg_wer"),
        F.count_if(recent).alias("recent"),
    )


def requests_by_model(requests: DataFrame) -> DataFrame:
    return requests.groupBy("model_id").agg(F.count(F.lit(1)).alias("requests")).orderBy(F.desc("requests"), "model_id")


def latest_per_model(runs: DataFrame, **wanted: str | None) -> DataFrame:
    """Each model's newest run among those selected.

    A maximum of structs: map-side partial, so a model with most of the runs costs no task more than the others.
    """
    rows = select_runs(runs, **wanted)
    newest = F.max(F.struct("created_at", "id", F.struct(*[c for c in rows.columns if c not in ("created_at", "id")]).alias("r")))
    out = rows.groupBy(F.col("model_id").alias("_model")).agg(newest.alias("n"))
    return out.select(*[F.col(f"n.{c}" if c in ("created_at", "id") else f"n.r.{c}") for c in rows.columns])


def comparison_order(runs: DataFrame) -> list[Column]:
    """Project-trained runs first, then by CER, nulls last, then id."""
    return [F.when(F.col("provenance") == "project", 0).otherwise(1), F.col("cer").asc_nulls_last(), F.col("id")]


def with_registry(runs: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds architecture and trained_on from registry(model_id, ...); unknown models get 'unknown'."""
    out = runs.join(registry.select("model_id", "architecture", "trained_on"), "model_id", "left")
    return out.na.fill("unknown", ["architecture", "trained_on"])


def cross_domain(runs: DataFrame) -> DataFrame:
    known = F.col("trained_on") != "unknown"
    return runs.withColumn("cross_domain", known & (F.col("trained_on") != F.col("dataset")))


def comparisons(comparison_runs: DataFrame, results: DataFrame) -> DataFrame:
    """Each run with its results in order of their ids."""
    each = results.groupBy(F.col("run_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in results.columns if c not in ("id", "run_id")]))).alias("results"))
    return comparison_runs.join(each, "id", "left")


def fastest_and_best(results: DataFrame, *keys: str) -> DataFrame:
    """results(model_id, total_ms, cer, error, text, ord): the fastest and the most accurate model; ties to the first."""
    ok = F.col("error").isNull() & (F.coalesce("text", F.lit("")) != "")
    pick = lambda metric, when: F.min(F.when(when, F.struct(F.col(metric), F.col("ord"), F.col("model_id"))))["model_id"]
    return results.groupBy(*keys).agg(pick("total_ms", ok).alias("fastest_model_id"), pick("cer", ok & F.col("cer").isNotNull()).alias("most_accurate_model_id"))


def experiment_pairs(runs: DataFrame) -> DataFrame:
    """(dataset, split, control, treatment, samples, first): groups with both arms, each arm's first run in order."""
    order = Window.orderBy(*comparison_order(runs))
    # one row per model, as latest_per_model() gives them
    rows = runs.where(F.col("experiment_arm").isin(*ARMS)).withColumn("place", F.row_number().over(order))
    arm = lambda a: F.min(F.when(F.col("experiment_arm") == a, F.struct("place", F.struct(*runs.columns).alias("run"))))["run"]
    groups = rows.groupBy("dataset", "split").agg(arm("control").alias("control"), arm("treatment").alias("treatment"), F.min("place").alias("first"))
    groups = groups.where("control is not null and treatment is not null")
    return groups.withColumn("samples", F.least("control.num_samples", "treatment.num_samples"))


def experiment_pair(runs: DataFrame, preferred: str | None = None) -> DataFrame:
    """The pair to report: of the preferred dataset if complete, else with most samples, ties to the earliest group."""
    pairs = experiment_pairs(runs)
    by_size = [F.desc("samples"), F.col("first")]
    if preferred is None:
        return pairs.orderBy(*by_size).limit(1)
    liked = F.col("dataset") == preferred
    return pairs.orderBy(F.when(liked, 0).otherwise(1), F.when(~liked, -F.col("samples")), "first").limit(1)


def arm_improvement(pairs: DataFrame) -> DataFrame:
    gain = scoring.improvement(F.col("control.cer"), F.col("treatment.cer"), F.col("control.sequence_accuracy"), F.col("treatment.sequence_accuracy"))
    return pairs.withColumn("gain", gain).select("dataset", "split", F.col("control.model_id").alias("control_id"), F.col("treatment.model_id").alias("treatment_id"), "gain.*")


def config_diff(a: DataFrame, b: DataFrame, allowed: list[str]) -> DataFrame:
    """a, b(key, value): keys whose values differ, with whether the difference is allowed."""
    both = a.select("key", F.col("value").alias("left")).join(b.select("key", F.col("value").alias("right")), "key", "full_outer")
    return both.where(~F.col("left").eqNullSafe(F.col("right"))).withColumn("allowed", F.col("key").isin(*allowed) if allowed else F.lit(False))


def line_confidences(lines: DataFrame, confidences: DataFrame, threshold: float, default: float = 0.0) -> DataFrame:
    """lines(doc, ord, text) with confidences(doc, text, confidence, ord) of the same text, the last one winning; adds marked."""
    last = confidences.groupBy("doc", "text").agg(F.max(F.struct("ord", F.coalesce("confidence", F.lit(default)).alias("confidence")))["confidence"].alias("confidence"))
    out = lines.join(last, ["doc", "text"], "left")
    return out.withColumn("marked", F.lit(threshold > 0) & F.coalesce(F.col("confidence") < threshold, F.lit(False)))


def files_with_labels(files: DataFrame, labels: DataFrame) -> DataFrame:
    """Files with their sidecar labels; without one, an empty text of kind 'printed'."""
    return files.join(labels.select("path", "text", "kind"), "path", "left").na.fill({"text": "", "kind": "printed"})


def marked_count(lines: DataFrame) -> DataFrame:
    """How many lines of each document are marked as of low confidence."""
    return lines.groupBy("doc").agg(F.count_if("marked").alias("marked"), F.count(F.lit(1)).alias("lines"))


def with_names(runs: DataFrame, names: DataFrame) -> DataFrame:
    """Adds experiment_arm and display_name from names(model_id, ...); models that are not listed are 'other' under their id."""
    out = runs.drop("experiment_arm", "display_name").join(names.select("model_id", "experiment_arm", "display_name"), "model_id", "left")
    return out.withColumns({"experiment_arm": F.coalesce("experiment_arm", F.lit("other")), "display_name": F.coalesce("display_name", "model_id")})


def filter_lines(lines: DataFrame, least: float, doc: str = "doc") -> DataFrame:
    """Lines with text and, if least > 0, enough confidence, numbered anew from 0 in each document."""
    kept = lines.where(F.trim("text") != "")
    kept = kept.where(F.col("confidence") >= least) if least > 0 else kept
    return kept.withColumn("index", F.row_number().over(Window.partitionBy(doc).orderBy("index")) - 1)


def document_confidence(lines: DataFrame, doc: str = "doc") -> DataFrame:
    n = F.length("text")
    return lines.groupBy(doc).agg(F.coalesce(F.try_divide(F.sum(F.col("confidence") * n), F.sum(n)), F.lit(0.0)).alias("confidence"))


def batch_summary(rows: DataFrame) -> DataFrame:
    """rows(text, confidence, total_ms, line_count, error): what a batch extraction did."""
    ok = F.col("error").isNull()
    return rows.agg(
        F.count(F.lit(1)).alias("images"),
        F.coalesce(F.sum(F.when(ok, F.col("line_count"))), F.lit(0)).alias("lines"),
        F.coalesce(F.avg(F.when(ok, F.col("confidence"))), F.lit(0.0)).alias("mean_confidence"),
        F.coalesce(F.sum(F.when(ok, F.col("total_ms"))), F.lit(0.0)).alias("total_ms"),
        F.count_if(~ok).alias("failures"),
        F.coalesce(F.sum(F.when(ok, F.length("text"))), F.lit(0)).alias("characters"),
    )


def retention(files: DataFrame, as_of: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """(files that stay, one row: deleted, freed_bytes, kept) for files(modificationTime, length)."""
    old = F.col("modificationTime") < as_of - F.expr(f"INTERVAL {days} DAYS")
    summary = files.agg(F.count_if(old).alias("deleted"), F.coalesce(F.sum(F.when(old, F.col("length"))), F.lit(0)).alias("freed_bytes"), F.count_if(~old).alias("kept"))
    return files.where(~old), summary


def metric_points(history: DataFrame) -> DataFrame:
    """history(run, epoch, metrics map) -> (run, metric, epoch, value) on all epochs of the run, value null where absent.

    The series as rows, however long a run is; each epoch of a run is met by the run's few metrics.
    """
    long = history.select("run", "epoch", F.explode("metrics").alias("metric", "value")).where(~F.col("metric").isin("epoch", "timestamp"))
    every = history.select("run", "epoch").distinct().join(long.select("run", "metric").distinct(), "run")
    last = long.groupBy("run", "metric", "epoch").agg(F.max("value").alias("value"))
    return every.join(last, ["run", "metric", "epoch"], "left")


def metric_series(history: DataFrame) -> DataFrame:
    """history(run, epoch, metrics map): for each run and metric the values on all epochs of the run, null where absent.

    One array for each metric of a run, made for charts; metric_points() has the same as rows.
    """
    long = history.select("run", "epoch", F.explode("metrics").alias("metric", "value")).where(~F.col("metric").isin("epoch", "timestamp"))
    epochs = history.groupBy("run").agg(F.array_sort(F.collect_set("epoch")).alias("epochs"))
    values = long.groupBy("run", "metric").agg(F.map_from_entries(F.collect_list(F.struct("epoch", "value"))).alias("at"))
    return values.join(epochs, "run").select("run", "metric", "epochs", F.transform("epochs", lambda e: F.try_element_at("at", e)).alias("values"))


def best_epoch(history: DataFrame, mode: str = "min", run: str = "run") -> DataFrame:
    """history(run, epoch, value): the first epoch with the best value; rows without one are passed over."""
    sign = 1 if mode == "min" else -1
    good = history.where(F.col("value").isNotNull() & ~F.isnan("value"))
    best = F.min(F.struct((F.col("value") * sign).alias("key"), F.col("epoch"), F.col("value")))
    return good.groupBy(run).agg(best.alias("b")).select(run, F.col("b.epoch").alias("best_epoch"), F.col("b.value").alias("best_value"))


def run_summary(history: DataFrame, monitor: str, mode: str = "min") -> DataFrame:
    """history(run, epoch, metrics map): the metrics of the best epoch by the monitor, else of the last epoch."""
    sign = 1 if mode == "min" else -1
    value = F.try_element_at("metrics", F.lit(monitor))
    entries = F.map_entries("metrics")
    best = F.min(F.when(value.isNotNull() & ~F.isnan(value), F.struct((value * sign).alias("key"), "epoch", entries.alias("m"))))
    last = F.max(F.struct("epoch", entries.alias("m")))
    out = history.groupBy("run").agg(best.alias("b"), last.alias("l"))
    return out.select("run", F.coalesce("b.epoch", "l.epoch").alias("epoch"), F.map_from_entries(F.coalesce("b.m", "l.m")).alias("metrics"))


def sample_counts_agree(runs: DataFrame) -> DataFrame:
    return runs.agg(F.when(F.countDistinct("num_samples") == 1, F.max("num_samples").cast("string")).otherwise("differ").alias("samples"))


def seconds_per_page(pages: DataFrame) -> DataFrame:
    return pages.groupBy("model_id").agg((F.sum("elapsed_s") / F.count(F.lit(1))).alias("seconds_per_page"))


def recent_by_model(requests: DataFrame, n: int = 300) -> DataFrame:
    newest = requests.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    return newest.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "total_ms"))).alias("recent"))


def job_progress(events: DataFrame) -> DataFrame:
    """events(job_id, ts, epoch, total): each job's latest epoch over its total, at most 1."""
    last = events.groupBy("job_id").agg(F.max(F.struct("ts", "epoch", "total")).alias("l"))
    return last.select("job_id", F.col("l.epoch").alias("epoch"), F.least(F.lit(1.0), F.col("l.epoch") / F.greatest(F.lit(1), F.col("l.total"))).alias("progress"))


def requested_models(requests: DataFrame, column: str = "models", most: int = 6) -> DataFrame:
    """A comma list as distinct trimmed ids in order; more than `most` raise an error."""
    ids = F.array_distinct(F.filter(F.transform(F.split(column, ","), lambda x: F.trim(x)), lambda x: x != ""))
    return requests.withColumn("model_ids", F.when(F.size(ids) > most, F.raise_error(F.lit(f"at most {most} models can be compared")).cast("array<string>")).otherwise(ids))


def registry_order(models: DataFrame) -> list[Column]:
    rank = F.when(F.col("provenance") == "project", 0).when(F.col("provenance") == "pretrained", 1).otherwise(2)
    return [rank, F.col("model_id")]


def default_model(models: DataFrame, preferred: list[str]) -> DataFrame:
    """The first available model of the preferred list, else the first of all in registry order."""
    at = F.array_position(F.array(*[F.lit(m) for m in preferred]), F.col("model_id"))
    return models.where("available").orderBy(F.when(at > 0, at).otherwise(len(preferred) + 1), *registry_order(models)).limit(1)


def discover_runs(files: DataFrame) -> DataFrame:
    """files(path) -> directories with a best or last checkpoint that are not runs of an encoder alone."""
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    seen = files.groupBy(folder.alias("run_dir")).agg(F.bool_or(name == "best.pt").alias("best"), F.bool_or(name == "last.pt").alias("last"), F.bool_or(name == "encoder.pt").alias("encoder"), F.bool_or(name == "history.json").alias("history"))
    return seen.where("(best or last) and not encoder")


def apply_corrections(requests: DataFrame, corrections: DataFrame) -> DataFrame:
    """A new snapshot: corrections(id, ts, ground_truth), the latest of each id; a blank reference clears the scores."""
    last = corrections.groupBy("id").agg(F.max(F.struct("ts", F.coalesce(F.trim("ground_truth"), F.lit("")).alias("new")))["new"].alias("new"))
    out = requests.join(last, "id", "left")
    new = F.nullif("new", F.lit(""))
    result = scoring.score(new, F.coalesce("text", F.lit("")))  # null without a reference
    changed = F.col("new").isNotNull()
    fields = {"ground_truth": new, "cer": result["cer"], "wer": result["wer"], "exact_match": result["exact_match"]}
    return out.withColumns({c: F.when(changed, v).otherwise(F.col(c)) for c, v in fields.items()}).drop("new")


def delete_ids(rows: DataFrame, ids: DataFrame, strict: bool = False) -> DataFrame:
    """A new snapshot without the ids; with `strict` an id that has no row is an error."""
    if strict and not ids.join(rows, "id", "left_anti").isEmpty():
        raise NotFound("an id to delete has no row")
    return rows.join(ids, "id", "left_anti")


def cascade(children: DataFrame, parents: DataFrame, parent_key: str, key: str = "id") -> DataFrame:
    """Children whose parents are still there."""
    return children.join(parents.select(F.col(key).alias(parent_key)), parent_key, "left_semi")


def clear_all(rows: DataFrame, confirm: bool = False) -> tuple[DataFrame, int]:
    """(the empty snapshot, how many rows go); refused unless confirmed."""
    if not confirm:
        raise ValueError("clearing the history must be confirmed")
    return rows.limit(0), rows.count()


def upsert_jobs(events: DataFrame) -> DataFrame:
    """events(job_id, ts, field..., history_entry): the last value of each field that is not null, and all entries in order."""
    fields = [c for c in events.columns if c not in ("job_id", "ts", "history_entry")]
    latest = [F.max(F.when(F.col(c).isNotNull(), F.struct("ts", F.col(c))))[c].alias(c) for c in fields]
    entries = F.transform(F.array_sort(F.collect_list(F.when(F.col("history_entry").isNotNull(), F.struct("ts", "history_entry")))), lambda e: e["history_entry"])
    return events.groupBy("job_id").agg(*latest, F.max("ts").alias("ts"), entries.alias("history"))
