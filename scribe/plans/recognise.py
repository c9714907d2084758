"""Running a recogniser over tables of images, with failures kept apart from results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scribe.functions import scoring
from scribe.operators import latency, metrics, runs
from scribe.session import scratch


def recognise(images: DataFrame, recogniser: Callable[[list], list[tuple[str, float]]], column: str = "image", batch: int = 16) -> DataFrame:
    """Adds text, confidence, inference_ms and error to images; `recogniser` takes a list of crops.

    Crops go in batches of at most `batch`. A batch that fails is tried crop by crop, and a crop that fails becomes a
    row with its error; the others go on.
    """
    keep = [f for f in images.schema.fields if f.name != column]
    out = StructType(keep).add("text", "string").add("confidence", "double").add("inference_ms", "double").add("error", "string")

    return images.mapInPandas(lambda batches: _recognised(batches, recogniser, column, batch, out), out)


def _recognised(batches: Iterator[pd.DataFrame], recogniser: Callable, column: str, batch: int, out: StructType) -> Iterator[pd.DataFrame]:
    import time

    for rows in batches:
        got: list[tuple] = []
        for i in range(0, len(rows), batch):
            crops = list(rows[column].iloc[i : i + batch])
            began = time.perf_counter()
            try:
                answers = [(t, float(c), None) for t, c in recogniser(crops)]
            except Exception:  # noqa: BLE001  any fault of a recogniser is a row's error
                answers = []
                for crop in crops:
                    try:
                        t, c = recogniser([crop])[0]
                        answers.append((t, float(c), None))
                    except Exception as fault:  # noqa: BLE001
                        answers.append((None, None, f"{type(fault).__name__}: {fault}"))
            each = (time.perf_counter() - began) * 1000 / max(1, len(crops))
            got += [(t, c, each, e) for t, c, e in answers]
        result = rows.drop(columns=[column]).reset_index(drop=True)
        for k, name in enumerate(("text", "confidence", "inference_ms", "error")):
            result[name] = pd.Series([g[k] for g in got], dtype="object" if k in (0, 3) else "float64")
        yield result[[f.name for f in out.fields]]


def require_success(results: DataFrame) -> DataFrame:
    """The results, or an error if there are some and all of them failed.

    They are written to the shared folder first, so that the recogniser runs once for this check and for what is done
    with them after it, whatever executors are lost.
    """
    path = scratch(results.sparkSession, "recognised")
    results.write.parquet(path)
    results = results.sparkSession.read.parquet(path)
    n, good = results.agg(F.count(F.lit(1)), F.count_if(F.col("error").isNull())).first()
    if n and not good:
        raise RuntimeError("every recognition failed")
    return results


def benchmark(images: DataFrame, recogniser: Callable[[list], list[tuple[str, float]]], model_id: str, dataset: str, split: str, provenance: str = "project", experiment_arm: str = "other", max_samples: int | None = None, batch_size: int = 32, warmup: int = 2, column: str = "image") -> tuple[DataFrame, DataFrame]:
    """images(ord, label, image, error?) -> (one evaluation run, its scored samples).

    The first `max_samples` rows by the 0-based `ord` go through the recogniser in batches of that order; rows that could
    not be read or recognised are counted as failed and not scored. Warm-up batches are scored but not timed.
    """
    rows = images if max_samples is None else images.where(F.col("ord") < max_samples)
    rows = latency.number_batches(rows, batch_size, warmup)
    unread = F.col("error").isNotNull() if "error" in images.columns else F.lit(False)
    rows = rows.withColumn("unread", unread).drop("error")
    readable = rows.where(~F.col("unread")).drop("unread")
    out = StructType([f for f in readable.schema.fields if f.name != column]).add("text", "string").add("confidence", "double").add("inference_ms", "double").add("error", "string")
    done = readable.groupBy("batch").applyInPandas(lambda part: next(_recognised(iter([part.sort_values("ord")]), recogniser, column, batch_size, out)), out).persist()
    samples = metrics.sample_metrics(done.where("error is null").select(F.col("ord").alias("sample_id"), "batch", F.col("label").alias("reference"), F.coalesce("text", F.lit("")).alias("prediction"), "confidence"))
    batches = done.groupBy("batch", "warm").agg(F.sum("inference_ms").alias("ms"), F.count(F.lit(1)).alias("size"))
    cost = latency.latency_stats(batches)
    failed = rows.agg(F.count_if("unread").alias("unread")).crossJoin(done.agg(F.count_if(F.col("error").isNotNull()).alias("faults")))
    run = metrics.validation_metrics(samples).crossJoin(cost).crossJoin(failed).withColumn("failed_samples", F.col("unread") + F.col("faults")).drop("unread", "faults")  # one row each
    fixed = {"model_id": model_id, "dataset": dataset, "split": split, "provenance": provenance, "experiment_arm": experiment_arm, "batch_size": batch_size}
    return run.withColumns({k: F.lit(v) for k, v in fixed.items()}), samples


def score_results(results: DataFrame, reference: str = "ground_truth") -> DataFrame:
    """Adds cer, wer and exact_match where there is a reference and no error."""
    s = scoring.score(F.when(F.col("error").isNull(), F.col(reference)), F.coalesce("text", F.lit("")))
    return results.withColumns({c: s[c] for c in ("cer", "wer", "exact_match")})


def compare_models(images: DataFrame, recognisers: dict[str, Callable], column: str = "image", most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(results of every model, one row: fastest and most accurate); one failing model does not stop the others."""
    if len(recognisers) > most:
        raise ValueError(f"at most {most} models can be compared")
    out = None
    for k, (name, f) in enumerate(recognisers.items()):
        part = recognise(images, f, column).withColumn("model_id", F.lit(name)).withColumn("ord", F.lit(k)).withColumn("total_ms", F.col("inference_ms"))
        out = part if out is None else out.unionByName(part)
    out = score_results(out) if "ground_truth" in images.columns else out.withColumn("cer", F.lit(None).cast("double"))
    return out, runs.fastest_and_best(out)


def extract_pages(lines: DataFrame, least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Recognised lines (page_id, index, text, confidence, inference_ms, error) -> (texts of pages, one row of totals)."""
    good = runs.filter_lines(lines.where("error is null"), least, "page_id")
    pages = good.groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda x: x["text"]), "\n").alias("text"),
        F.coalesce(F.try_divide(F.sum(F.col("confidence") * F.length("text")), F.sum(F.length("text"))), F.lit(0.0)).alias("confidence"),
        F.sum("inference_ms").alias("total_ms"),
        F.count(F.lit(1)).alias("line_count"),
    )
    failed = lines.groupBy("page_id").agg(F.min("error").alias("error"))
    pages = failed.join(pages, "page_id", "left").na.fill({"text": "", "confidence": 0.0, "total_ms": 0.0, "line_count": 0})
    return pages, runs.batch_summary(pages)
