"""Frame tables and epoch series: arg-max, collapse, greedy decoding, confidences, early stopping."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from scribe.functions.text import Charset


def best_classes(frames: DataFrame) -> DataFrame:
    """frames(sample_id, t, class, logp) -> the best class of each frame; ties go to the lowest class."""
    place = F.row_number().over(Window.partitionBy("sample_id", "t").orderBy(F.desc("logp"), "class"))
    return frames.withColumn("place", place).where("place = 1").drop("place")


def clip_frames(frames: DataFrame, lengths: DataFrame) -> DataFrame:
    """Frames below the sample's valid length, which lies between 1 and all frames."""
    return frames.join(lengths, "sample_id").where(F.col("t") < F.greatest(F.lit(1), F.col("length"))).drop("length")


def collapse(best: DataFrame, blank: int = 0) -> DataFrame:
    """Repeated neighbours become one, then blanks go."""
    before = F.lag("class").over(Window.partitionBy("sample_id").orderBy("t"))
    return best.withColumn("before", before).where((F.col("class") != blank) & (F.col("before").isNull() | (F.col("before") != F.col("class")))).drop("before")


def collapse_array(classes: Column, blank: int = 0) -> Column:
    changed = F.filter(F.transform(classes, lambda c, i: F.when((i == 0) | (c != F.get(classes, i - 1)), c)), lambda c: c.isNotNull())
    return F.filter(changed, lambda c: c != blank)


def geometric_mean(p: Column) -> Column:
    return F.exp(F.avg(F.ln(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12)))))


def greedy_decode(frames: DataFrame, charset: Charset) -> DataFrame:
    """(sample_id, text, confidence, char_confidences, timesteps); samples of blanks alone have '' and 0."""
    letters = F.array(*[F.lit(c) for c in charset.alphabet])
    kept = collapse(best_classes(frames)).where(F.col("class") < charset.num_classes)
    marks = F.array_sort(F.collect_list(F.struct("t", F.element_at(letters, F.col("class").cast("int")).alias("letter"), F.exp("logp").alias("p"))))
    decoded = kept.groupBy("sample_id").agg(marks.alias("marks"), geometric_mean(F.exp("logp")).alias("confidence"))
    out = frames.select("sample_id").distinct().join(decoded, "sample_id", "left")
    empty = F.array().cast("array<struct<t:bigint,letter:string,p:double>>")
    marks = F.coalesce("marks", empty)
    return out.select(
        "sample_id",
        F.array_join(F.transform(marks, lambda m: m["letter"]), "").alias("text"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.transform(marks, lambda m: m["p"]).alias("char_confidences"),
        F.transform(marks, lambda m: m["t"]).alias("timesteps"),
    )


def token_confidence(tokens: DataFrame, pad: int) -> DataFrame:
    """tokens(seq, token, logp) -> the mean log-probability of what is not padding, as a probability in [0, 1]."""
    real = F.col("token") != pad
    mean = F.coalesce(F.sum(F.when(real, F.col("logp"))), F.lit(0.0)) / F.greatest(F.count_if(real), F.lit(1))
    return tokens.groupBy("seq").agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(mean))).alias("confidence"))


def beam_confidence(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(score)))


def weighted_mean(value: Column, weight: Column) -> Column:
    """The mean over finite values only; 0 if there is none."""
    good = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.coalesce(F.try_divide(F.sum(F.when(good, value * weight)), F.sum(F.when(good, weight))), F.lit(0.0))


def usable_loss(loss: Column, most: float = 1e4) -> Column:
    return loss.isNotNull() & ~F.isnan(loss) & (F.abs(loss) <= most)


def loss_summary(batches: DataFrame, *keys: str) -> DataFrame:
    """batches(loss, size): weighted mean of the usable losses and how many batches were skipped."""
    good = usable_loss(F.col("loss"))
    return batches.groupBy(*keys).agg(weighted_mean(F.when(good, F.col("loss")), F.col("size")).alias("loss"), F.count_if(~F.coalesce(good, F.lit(False))).alias("skipped"))


def early_stop(epochs: DataFrame, patience: int, mode: str = "min", min_delta: float = 1e-5, run: str = "run_name") -> DataFrame:
    """epochs(run, epoch, value) -> (run, best, best_epoch, stop_epoch): a fold over each run's epochs in order.

    An epoch improves if it beats the last accepted best by more than min_delta; after `patience` others in a row the
    run stops there (null: it never does, as with a patience under 1). Null and non-finite values are passed over.
    Rows are sorted within the partitions and folded as they come, so a run of any length is three values in memory.
    """
    sign = 1 if mode == "min" else -1
    kind = epochs.schema[run].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, now, best, at, waited, stop = True, None, None, None, 0, None
        for rows in batches:
            done = []
            for name, epoch, value in zip(rows["run"].tolist(), rows["epoch"].tolist(), rows["value"].tolist()):
                if first or name != now:
                    if not first:
                        done.append((now, best, at, stop))
                    first, now, best, at, waited, stop = False, name, None, None, 0, None
                if stop is not None or value is None or not abs(value) < float("inf"):
                    continue
                if best is None or sign * value < sign * best - min_delta:
                    best, at, waited = value, epoch, 0
                else:
                    waited += 1
                    stop = epoch if 1 <= patience <= waited else None
            yield frame(done)
        if not first:
            yield frame([(now, best, at, stop)])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[run, "best", "best_epoch", "stop_epoch"])
        return out.astype({"best": "float64", "best_epoch": "Int64", "stop_epoch": "Int64"})

    rows = epochs.select(F.col(run).alias("run"), F.col("epoch").cast("long").alias("epoch"), F.col("value").cast("double").alias("value"))
    return rows.repartition("run").sortWithinPartitions("run", "epoch", "value").mapInPandas(fold, f"{run} {kind}, best double, best_epoch long, stop_epoch long")
