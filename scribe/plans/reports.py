"""Reports over the run store: comparisons with their outcomes, chart data, document benchmarks, timed batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribe.operators import latency, metrics, runs


def timed_batches(events: DataFrame, size: int, warmup: int) -> DataFrame:
    """events(ts, event_id, value) in order of time -> batches (batch, ms, size, warm).

    The place of an event is counted by minutes first, so no task orders more than a minute of events.
    """
    from pyspark.sql import Window

    e = events.select("value", "ts", "event_id", F.date_trunc("minute", "ts").alias("minute"))
    minutes = e.groupBy("minute").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("minute").orderBy("ts", "event_id")) - 1
    ordered = e.withColumn("place", place).join(minutes.select("minute", before.alias("before")), "minute").withColumn("ord", F.col("place") + F.col("before"))
    numbered = latency.number_batches(ordered, size, warmup)
    return numbered.groupBy("batch", "warm").agg(F.sum("value").alias("ms"), F.count(F.lit(1)).alias("size"))


def build_comparison(evaluations: DataFrame, registry: DataFrame | None = None, preferred: str | None = None, **wanted: str | None) -> DataFrame:
    """One row: outcome (comparable, different_setting, missing_arm), the pair and its gain, and the lone arms if any."""
    latest = runs.latest_per_model(evaluations, **wanted)
    if registry is not None:
        latest = runs.cross_domain(runs.with_registry(latest, registry))
    pair = runs.experiment_pair(latest, preferred)
    gain = runs.arm_improvement(pair)
    arms = latest.where(F.col("experiment_arm").isin(*runs.ARMS)).agg(F.countDistinct("experiment_arm").alias("arms"), *[F.min(F.when(F.col("experiment_arm") == a, F.struct(F.when(F.col("provenance") == "project", 0).otherwise(1).alias("rank"), F.col("cer").isNull().alias("unscored"), "cer", "id", "model_id")))["model_id"].alias(f"lone_{a}") for a in runs.ARMS])
    outcome = F.when(F.col("dataset").isNotNull(), "comparable").when(F.col("arms") == 2, "different_setting").otherwise("missing_arm")
    return arms.join(gain, F.lit(True), "left").withColumn("outcome", outcome)


def model_comparison(latest: DataFrame) -> DataFrame:
    """Chart data: models in comparison order with accuracy and cost."""
    return latest.select("model_id", "provenance", "cer", "wer", "sequence_accuracy", "avg_inference_ms", "id").orderBy(*runs.comparison_order(latest))


def accuracy_against_cost(latest: DataFrame) -> DataFrame:
    return latest.where((F.col("avg_inference_ms") > 0) & F.col("cer").isNotNull()).select("model_id", "cer", "avg_inference_ms", "parameter_count")


def learning_curves(history: DataFrame, monitor: str, mode: str = "min") -> DataFrame:
    """history(run, epoch, metrics map): series of each metric with the best epoch of the monitor marked."""
    value = F.try_element_at("metrics", F.lit(monitor))
    best = runs.best_epoch(history.select("run", "epoch", value.alias("value")), mode)
    return runs.metric_series(history).join(best, "run", "left")


def contrastive_progress(history: DataFrame, batch_size: int) -> DataFrame:
    """Accuracy by epoch beside the accuracy of chance, one in the 2 * batch - 1 others."""
    return history.select("run", "epoch", F.try_element_at("metrics", F.lit("accuracy")).alias("accuracy"), F.lit(1.0 / (2 * batch_size - 1)).alias("chance"))


def document_benchmark(entries: DataFrame, predictions: DataFrame, capture: str | None = None) -> DataFrame:
    """entries(file, capture, text) and predictions(model_id, file, text, elapsed_s, error) -> totals by model and capture.

    Of one capture, or of all. Failed pages are left out of the figures and counted; models come by CER.
    """
    entries = entries if capture is None else entries.where(F.col("capture") == capture)
    both = predictions.join(entries.select("file", "capture", F.col("text").alias("reference")), "file")
    good = both.where("error is null").withColumnRenamed("text", "prediction")
    samples = metrics.sample_metrics(good.withColumn("sample_id", F.col("file")))
    scores = metrics.grouped_metrics(samples, "model_id", "capture").where("model_id is not null")
    cost = both.groupBy("model_id").agg(F.count_if(F.col("error").isNotNull()).alias("failed"), (F.sum("elapsed_s") / F.count(F.lit(1))).alias("seconds_per_page"))
    return scores.join(cost, "model_id").orderBy(F.col("cer").asc_nulls_last(), "model_id", "level")


#: Decimals of reports; figures are rounded where they leave, never before.
DECIMALS = {"cer": 6, "wer": 6, "cer_macro": 6, "wer_macro": 6, "cer_normalized": 6, "sequence_accuracy": 6, "sequence_accuracy_normalized": 6, "character_accuracy": 6, "avg_inference_ms": 3, "median_inference_ms": 3, "p95_inference_ms": 3, "throughput_images_per_s": 2, "peak_memory_mb": 2, "model_size_mb": 2}


def report_rows(rows: DataFrame, decimals: dict[str, int] = DECIMALS) -> DataFrame:
    """Rows as a report has them: known figures rounded."""
    return rows.select(*[F.round(c, decimals[c]).alias(c) if c in decimals else F.col(c) for c in rows.columns])


def comparison_table(latest: DataFrame) -> DataFrame:
    """The latest runs as a table with their place: project models first, then by CER, runs without one last."""
    from pyspark.sql import Window

    # one row for each model
    place = F.row_number().over(Window.orderBy(*runs.comparison_order(latest)))
    return report_rows(latest.withColumn("place", place))


def rejects_of(rows: DataFrame) -> DataFrame:
    """rows(reason?) of a source that marks its lines: how many were read, kept and left out by reason."""
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
