"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let_go
from .textbytes import mixed, pieces, texts_of, words_of

BITS = 18
#: What a byte is, as a bit of its word's shape.
KIND = np.full(256, 128, np.uint8)
KIND[:0x80] = 64
KIND[[0x20, *range(0x09, 0x0E)]] = 0
KIND[0x61:0x7B], KIND[0x41:0x5B], KIND[0x30:0x3A] = 1, 2, 4
KIND[[ord(c) for c in "#*$%&|<>"]], KIND[[ord(c) for c in "!?"]], KIND[[ord(c) for c in ".,;:"]] = 8, 16, 32


def ngram_slots(buf: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, document, words of each document): one slot for each word 1- and 2-gram, and each 1- and 2-gram of word shapes.

    A shape says which kinds of bytes a word has; a word that repeats its neighbour gives one fixed 2-gram.
    """
    w = words_of(buf, offsets, lower=True)
    count = np.diff(w.first)
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), count
    shape = np.bitwise_or.reduceat(KIND[buf], w.start).astype(np.uint64)
    pair = w.doc[1:] == w.doc[:-1]
    a, b, s, t = w.hash[:-1][pair], w.hash[1:][pair], shape[:-1][pair], shape[1:][pair]
    two = np.where(a == b, np.uint64(1), mixed(a * np.uint64(3) + b))
    grams = np.concatenate([w.hash, two, mixed(shape + np.uint64(1 << 20)), mixed((s << np.uint64(8)) + t + np.uint64(1 << 40))])
    doc = np.concatenate([w.doc, w.doc[:-1][pair]] * 2)
    return (1 + mixed(grams) % np.uint64((1 << bits) - 1)).astype(np.int64), doc, count


def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, shard, at, text) -> (y, shard, at, slots, values), values being SCALE times a slot's share of the words."""
    for batch in batches:
        buf, offsets = texts_of(batch.column("text"))
        slots, values = [], []
        for i, j in pieces(offsets):
            slot, doc, count = ngram_slots(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            key, n = np.unique(doc << 32 | slot, return_counts=True)
            cuts = np.searchsorted(key, np.arange(1, j - i) << 32)
            value = n * SCALE / np.maximum(count, 1)[key >> 32]
            slots += np.split((key & 0xFFFFFFFF).astype(np.int32), cuts)
            values += np.split(value.astype(np.float32), cuts)
        yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("shard"), batch.column("at"), pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["y", "shard", "at", "slots", "values"])
    let_go()


SCALE = 4.0


def ftrl(rows: list[tuple[float, np.ndarray, np.ndarray]], bits: int = BITS, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> np.ndarray:
    """Weights of a logistic regression over (label, slots, values); slot 0 is the bias."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) > l1, (np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    rows = [(y, np.r_[0, s], np.r_[1.0, v]) for y, s, v in rows]
    for _ in range(epochs):
        for y, at, x in rows:
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(np.arange(1 << bits))


def train_shard(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("at")
    w = ftrl([(y, np.asarray(s, np.int64), np.asarray(v, np.float64)) for y, s, v in zip(rows["y"], rows["slots"], rows["values"])])
    at = np.flatnonzero(w)
    del rows
    let_go()
    # slot -1 counts the tasks that had rows
    return pd.DataFrame({"slot": np.r_[-1, at].astype(np.int32), "weight": np.r_[1.0, w[at]]})


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit_quality(documents: DataFrame, labels: DataFrame, bound: int = 20000, shards: int = 8) -> np.ndarray:
    """Weights fitted on labelled documents that are not held out: all of them, or about `bound` if there are more.

    The sample takes documents whose hash is below bound / all, so no row order matters. Each of `shards` tasks runs
    the updates over its part and the sparse weights are averaged over the tasks that had any, at most 2 ** BITS rows. Documents with several
    labels take their mean's side; null labels and ids are left out; without any label all weights are 0.
    """
    y = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("float").alias("y"))
    n = y.count()
    key = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(1 << 40))
    y = y.where(key < int(min(1.0, bound / max(n, 1)) * (1 << 40))).withColumn("at", key)
    # at most about `bound` rows of 20 bytes
    rows = documents.select("doc_id", "text").join(F.broadcast(y), "doc_id").select("y", (F.col("at") % shards).cast("int").alias("shard"), "at", "text")
    sparse = rows.mapInArrow(featurise, "y float, shard int, at long, slots array<int>, values array<float>")
    fitted = sparse.groupBy("shard").applyInPandas(train_shard, "slot int, weight double").groupBy("slot").agg(F.sum("weight").alias("weight")).toPandas()
    slot, weight = fitted["slot"].to_numpy(), fitted["weight"].to_numpy()
    weights = np.zeros(1 << BITS, np.float32)
    weights[slot[slot >= 0]] = weight[slot >= 0] / max(1.0, weight[slot < 0].sum())
    return weights


def score_quality(documents: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """All columns of documents and the score, named `name`, which none of them may be; a narrow step.

    Null and empty texts score by the bias alone.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(weights)  # 1 MB, fixed by BITS
    if free_name(documents.columns, name) != name:
        raise ValueError(f"documents have a column {name!r} already")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            buf, offsets = texts_of(batch.column("text"))
            out = np.zeros(len(batch))
            for i, j in pieces(offsets):
                slot, doc, count = ngram_slots(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                out[i:j] = np.bincount(doc, w[slot], j - i) * SCALE / np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(out + w[0], -500, 500))))], [*batch.schema.names, name])
        let_go()

    from pyspark.sql.types import DoubleType, StructType

    return documents.mapInArrow(score, StructType([*documents.schema.fields]).add(name, DoubleType()))


def quality_scores(documents: DataFrame, labels: DataFrame, bound: int = 20000) -> DataFrame:
    """documents(doc_id, text, ...) and labels(doc_id, quality) -> (doc_id, held_out, score, predicted).

    Only the text makes the score. Repeated rows are scored each; an empty table gives no row; other columns are ignored.
    """
    scored = score_quality(documents.select("doc_id", "text"), fit_quality(documents, labels, bound))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
