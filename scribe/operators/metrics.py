"""Scoring predictions against references: rows, totals, groups, worst samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from scribe.functions import scoring, text


def pair(predictions: DataFrame, references: DataFrame, key: str = "sample_id") -> DataFrame:
    """predictions(key, prediction) with references(key, reference), one to one.

    A key that is missing on one side or repeated raises an error when the result is used; the check is part of the join.
    """
    p = predictions.groupBy(key).agg(F.first("prediction").alias("prediction"), F.count(F.lit(1)).alias("np"))
    r = references.groupBy(key).agg(F.first("reference").alias("reference"), F.count(F.lit(1)).alias("nr"))
    both = p.join(r, key, "full_outer")
    odd = F.col("np").isNull() | F.col("nr").isNull() | (F.col("np") > 1) | (F.col("nr") > 1)
    checked = F.when(odd, F.raise_error(F.concat(F.lit("predictions and references do not match at "), F.col(key).cast("string"))).cast("string")).otherwise(F.col("prediction"))
    return both.select(key, "reference", checked.alias("prediction"))


def sample_metrics(pairs: DataFrame, normalise: bool = True, compose: bool = True) -> DataFrame:
    """pairs(..., reference, prediction) with the edits, lengths, rates and matches of each sample, strict and normalised.

    The normalised figures compare ASCII letters and digits in lower case. A narrow step.
    """
    ref, pred = text.normalize_text(F.col("reference"), compose=compose), text.normalize_text(F.col("prediction"), compose=compose)
    rows = pairs.withColumns({"reference": ref, "prediction": pred})
    a, b = F.col("reference"), F.col("prediction")
    rows = rows.withColumns({
        "char_edits": scoring.char_edits(a, b),
        "ref_chars": F.length(a),
        "word_edits": scoring.word_edits(a, b),
        "ref_words": F.size(scoring.words(a)),
        "exact_match": a == b,
    })
    rows = rows.withColumns({
        "cer": scoring.rate(F.col("char_edits"), F.col("ref_chars"), b == ""),
        "wer": scoring.rate(F.col("word_edits"), F.col("ref_words"), F.size(scoring.words(b)) == 0),
    })
    if normalise:
        # white space goes with all that is no letter or digit
        x, y = (text.normalize_text(c, lower=True, whitespace=False, alnum_only=True, compose=False) for c in (a, b))
        rows = rows.withColumns({"norm_edits": scoring.norm_edits(a, b), "norm_chars": F.length(x), "norm_match": x == y})
    return rows


def totals(normalise: bool = True) -> list[Column]:
    """Aggregates of sample_metrics(): micro and macro rates, matches, totals; zeros where there is no row."""
    micro = lambda e, n: F.coalesce(F.try_divide(F.sum(e), F.sum(n)), F.lit(0.0))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    share = lambda c: mean(F.col(c).cast("double"))
    out = [
        F.count(F.lit(1)).alias("num_samples"),
        micro("char_edits", "ref_chars").alias("cer"),
        micro("word_edits", "ref_words").alias("wer"),
        mean("cer").alias("cer_macro"),
        mean("wer").alias("wer_macro"),
        share("exact_match").alias("sequence_accuracy"),
        F.greatest(F.lit(0.0), 1 - micro("char_edits", "ref_chars")).alias("character_accuracy"),
        F.coalesce(F.sum("char_edits"), F.lit(0)).alias("total_char_edits"),
        F.coalesce(F.sum("ref_chars"), F.lit(0)).alias("total_ref_chars"),
        F.coalesce(F.sum("word_edits"), F.lit(0)).alias("total_word_edits"),
        F.coalesce(F.sum("ref_words"), F.lit(0)).alias("total_ref_words"),
    ]
    if normalise:
        out += [micro("norm_edits", "norm_chars").alias("cer_normalized"), share("norm_match").alias("sequence_accuracy_normalized")]
    return out


def corpus_metrics(samples: DataFrame, normalise: bool = True) -> DataFrame:
    return samples.agg(*totals(normalise))


def grouped_metrics(samples: DataFrame, *keys: str, normalise: bool = True) -> DataFrame:
    """Totals by the keys and by each prefix of them; a key is null in the rows that sum over it, `level` counts those."""
    return samples.rollup(*keys).agg(F.grouping_id().alias("level"), *totals(normalise))


def worst_samples(samples: DataFrame, k: int, *by: str, order: str = "sample_id") -> DataFrame:
    """The k samples with the highest CER, then most edits, then input order; of each group if `by` is given."""
    worst = [F.col("cer").desc(), F.col("char_edits").desc(), F.col(order)]
    if not by:
        return samples.orderBy(*worst).limit(k)
    return samples.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*worst))).where(F.col("place") <= k)


def evaluate(predictions: DataFrame, references: DataFrame, key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """predictions(key, prediction) and references(key, reference) -> (one row of totals, the samples)."""
    samples = sample_metrics(pair(predictions, references, key))
    return corpus_metrics(samples), samples


def validation_metrics(samples: DataFrame) -> DataFrame:
    """Totals of samples that also have a confidence, with its mean; 0 without samples."""
    return samples.agg(*totals(), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"))
