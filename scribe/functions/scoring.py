"""Scores of a transcription against its reference, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scribe.functions.distance import char_distance, norm_distance, word_distance
from scribe.functions.text import normalize_text

#: Pairs with so many cells in their table are left to the built-in distance.
SHORT = 1 << 12


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def char_edits(reference: Column, prediction: Column) -> Column:
    """Edit distance in code points, of texts of any length.

    The built-in is quadratic, so only pairs of some sixty characters stay with it; the others go through Arrow.
    """
    long = F.length(reference) * F.length(prediction).cast("long") > SHORT
    return F.coalesce(char_distance(F.when(long, reference), F.when(long, prediction)), F.when(~long, F.levenshtein(reference, prediction)))


def word_edits(reference: Column, prediction: Column) -> Column:
    """Edit distance between word lists of any length."""
    return word_distance(reference, prediction)


def norm_edits(reference: Column, prediction: Column) -> Column:
    """Edit distance between the ASCII letters and digits of both, in lower case."""
    return norm_distance(reference, prediction)


def rate(edits: Column, length: Column, empty: Column) -> Column:
    """edits / length, not clamped; an empty reference counts 0 if the prediction is empty too, else 1."""
    return F.when(length > 0, edits / length).otherwise(F.when(empty, 0.0).otherwise(1.0))


def cer(reference: Column, prediction: Column) -> Column:
    return rate(char_edits(reference, prediction), F.length(reference), prediction == "")


def wer(reference: Column, prediction: Column) -> Column:
    return rate(word_edits(reference, prediction), F.size(words(reference)), F.size(words(prediction)) == 0)


def score(reference: Column, prediction: Column) -> Column:
    """struct(cer, wer, exact_match) of both texts after normalize_text(); all null where there is no reference."""
    reference, prediction = normalize_text(reference), normalize_text(prediction)
    return F.when(reference.isNotNull(), F.struct(cer(reference, prediction).alias("cer"), wer(reference, prediction).alias("wer"), (reference == prediction).alias("exact_match")))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "high").when(confidence >= 0.6, "medium").when(confidence.isNotNull(), "low")


def error_band(error: Column) -> Column:
    return F.when(error <= 0.05, "good").when(error <= 0.2, "fair").when(error.isNotNull(), "poor")


def improvement(control_cer: Column, treatment_cer: Column, control_accuracy: Column, treatment_accuracy: Column) -> Column:
    """struct(absolute, relative, accuracy_delta, verdict) of the treatment over the control."""
    absolute = control_cer - treatment_cer
    relative = F.when(control_cer > 0, absolute / control_cer).otherwise(0.0)
    verdict = F.when(absolute > 0, "improved").otherwise("not improved")
    return F.struct(absolute.alias("absolute"), relative.alias("relative"), (treatment_accuracy - control_accuracy).alias("accuracy_delta"), verdict.alias("verdict"))


def model_size_mb(size_mb: Column, parameters: Column) -> Column:
    """The size that was measured, else four bytes a parameter."""
    return F.coalesce(size_mb, parameters * 4 / 1048576)


def json_number(text: Column, path: str) -> Column:
    return F.get_json_object(text, path).cast("double")


def duration_seconds(started: Column, finished: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(finished, as_of).cast("double") - started.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
