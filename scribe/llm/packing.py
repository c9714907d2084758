"""Packing documents into training sequences: a cutting-stock problem solved by column generation over length classes."""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import let_go, saved

END_ID = 1
#: The vocabulary's added token; the library that reads JSON finds it inside texts, its id is the first free one.
ADDED = "<|endoftext|>"


def load_encoder(vocabulary: str | None = None):
    """The byte_bpe_50k vocabulary, by the faster of the two libraries that give the same ids (tests compare them)."""
    import public_tokenizers
    import tiktoken

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={ADDED: len(ranks)})


def tokenise(documents: DataFrame, length: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """documents(doc_id, text, ...) -> pieces (doc_id, start, length, ids_crc32, doc_tokens), a narrow step.

    A document's ids and the end id are cut into full pieces from the start and one rest. The string of the added token
    becomes its id, as `tokenizers` has it with add_special_tokens=False alone. Nulls count as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(vocabulary)
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for i, text in enumerate(batch.column("text")):
                ids = np.array([*encoder.encode(text.as_py() or "", allowed_special="all", disallowed_special=()), END_ID], "<u4")
                rows += [(i, s, len(part := ids[s : s + length]), zlib.crc32(part.tobytes()), len(ids)) for s in range(0, len(ids), length)]
            t = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(t[:, 0])), *[pa.array(t[:, k]) for k in range(1, 5)]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        del encoder
        let_go()

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def best_fills(price: np.ndarray, sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the highest price for every width up to `room`, and the size put in last."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(sizes, np.arange(room + 1), "right")
    for w in range(int(sizes[0]), room + 1):
        offer = best[w - sizes[: fits[w]]] + price[: fits[w]]
        k = int(offer.argmax())
        if offer[k] > best[w - 1] + 1e-12:
            best[w], last[w] = offer[k], k
        else:
            best[w] = best[w - 1]
    return best, last


def filled(last: np.ndarray, sizes: np.ndarray, width: int, first: int) -> np.ndarray:
    """Counts of the sizes in the best fill of `width` by best_fills(), `first` put in before."""
    counts = np.zeros(len(sizes))
    counts[first], left = 1, width - int(sizes[first])
    while left > 0:
        if last[left] < 0:
            left -= 1
        else:
            counts[last[left]] += 1
            left -= int(sizes[last[left]])
    return counts


def fullest(left: np.ndarray, sizes: np.ndarray, room: int) -> np.ndarray:
    """Counts of what is left that fill `room` best, the largest piece among them: subset sums as the bits of an integer."""
    counts = np.zeros(len(sizes), np.int64)
    k = int(np.flatnonzero(left)[-1])
    counts[k], free = 1, room - int(sizes[k])
    items = [j for j in range(k, -1, -1) for _ in range(min(int(left[j] - counts[j]), free // int(sizes[j])))]
    reach, mask = [1], (1 << (free + 1)) - 1
    for j in items:
        reach.append((reach[-1] | reach[-1] << int(sizes[j])) & mask)
        if reach[-1] >> free:
            break
    at = reach[-1].bit_length() - 1
    for i in range(len(reach) - 1, 0, -1):
        if not reach[i - 1] >> at & 1:
            counts[items[i - 1]] += 1
            at -= int(sizes[items[i - 1]])
    return counts


def cutting_patterns(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 0.0003, rounds: int | None = None) -> list[tuple[np.ndarray, int]]:
    """[(pieces of each size, how many sequences)], together exactly the demand.

    Column generation: the linear program (cover every size's demand by as few patterns as can be) starts from patterns
    of one size each and is kept as an explicit basis inverse. A pool holds the columns found so far: at first those
    that fill sequence after sequence as full as can be; each round adds what a knapsack prices highest, the best
    pattern with each size in it, under prices half way between the program's and those of the best bound. Of the pool
    the best column enters until none prices above 1 + gap / 4; where a size's price turns negative its surplus enters
    instead, at no cost. It ends when the value is within `gap` of the best bound, value / best price and the total
    size being two, or the knapsack finds no column. `rounds` limits the columns that enter, for tests. Patterns are
    rounded down and what is left, less than one sequence for each pattern, is packed sequence by sequence, each as full
    as can be.
    """
    m = len(sizes)
    if not m:
        return []
    each = (room // sizes).astype(float)
    basis, inverse, cost = np.diag(each), np.diag(1 / each), np.ones(m)
    price, x, entered = 1 / each, demand / each, 0
    most_entered = 60 * m + 60 if rounds is None else rounds

    def enter(column: np.ndarray, own: float) -> bool:
        nonlocal price, x, entered
        used = np.flatnonzero(column)
        step = inverse[:, used] @ column[used]
        ok = step > 1e-9
        if not ok.any():
            return False
        out = int(np.argmin(np.where(ok, x / np.where(ok, step, 1), np.inf)))
        row, many = inverse[out] / step[out], x[out] / step[out]
        price = price + (own - price[used] @ column[used]) * row
        x = np.maximum(x - many * step, 0)
        x[out] = many
        basis[:, out], cost[out] = column, own
        step[out] -= 1
        np.subtract(inverse, step[:, None] * row, out=inverse)
        entered += 1
        if entered % 1000 == 0:  # against drift
            inverse[:] = np.linalg.inv(basis)
            price, x = cost @ inverse, np.maximum(inverse @ demand, 0)
        return True

    left, pool = demand.astype(np.int64), []
    while left.any():
        counts = fullest(left, sizes, room)
        left = left - counts * int((left[counts > 0] // counts[counts > 0]).min())
        pool.append(counts)
    pool = np.array(pool, float)
    centre, bound, weight = sizes / room, float(sizes @ demand / room), 0.5
    while entered < most_entered:
        smooth = weight * centre + (1 - weight) * np.maximum(price, 0)
        best, last = best_fills(smooth, sizes, room)
        if smooth @ demand / best[room] > bound:
            bound, centre = float(smooth @ demand / best[room]), smooth / best[room]
        columns = np.array([filled(last, sizes, room, j) for j in np.argsort(-(smooth + best[room - sizes]))[:100].tolist()])
        new = columns[columns @ price > 1 + gap / 2]
        if not len(new):
            if not weight:
                break
            weight = weight / 2 if weight > 0.05 else 0.0
        pool = np.concatenate([pool, new])
        while entered < most_entered and float(cost @ x) > bound * (1 + gap):
            offers, low = pool @ price, int(np.argmin(price))
            k = int(np.argmax(offers))
            if price[low] < -1e-7 and -price[low] > offers[k] - 1:
                if not enter(-np.eye(m)[low], 0.0):
                    break
            elif offers[k] <= 1 + gap / 4 or not enter(pool[k], 1.0):
                break
        if float(cost @ x) <= bound * (1 + gap):
            break
    x = np.where(cost > 0, np.linalg.solve(basis, demand), 0)
    plan, left = [], demand.astype(np.int64).copy()
    for j in np.argsort(-x):
        column = np.rint(basis[:, j]).astype(np.int64)
        used = column > 0
        n = min(int(max(0, math.floor(x[j] + 1e-6))), int((left[used] // column[used]).min())) if used.any() else 0
        if n > 0:
            plan.append((column, n))
            left -= column * n
    while left.any():  # at most a few pieces for each pattern
        counts = fullest(left, sizes, room)
        n = int((left[counts > 0] // counts[counts > 0]).min())
        plan.append((counts, n))
        left -= counts * n
    return plan


def pack(documents: DataFrame, length: int = 2048, unit: int = 4, vocabulary: str | None = None) -> DataFrame:
    """documents(doc_id, text, ...) -> pieces with sequence_id, offset and padded, one row per piece.

    Pieces are classed by length, rounded up to `unit` tokens. The counts by class, at most length / unit of them, go
    to the driver, which plans patterns; a class's pieces are ranked and the rank decides pattern, sequence and place,
    by a join on the class with the few ranges that the patterns make. Ranks come from counts by (class, bucket) and
    windows in a bucket, so a hot class is ranked in many tasks. Offsets are the pieces' true lengths, so a sequence
    ends early by less than unit - 1 tokens a piece; `padded` is its length with padding, `length` except at a power of
    two. Null texts are the end id alone; repeated rows are packed each; an empty table gives no row.
    """
    pieces = saved(tokenise(documents, length, vocabulary), "pieces")
    spark = pieces.sparkSession
    class_of = F.ceil(F.col("length") / unit).cast("long")
    # the row's number is part of the key, so that equal rows are dealt to all buckets; the saved table numbers rows alike again
    keyed = pieces.select("*", class_of.alias("class"), F.monotonically_increasing_id().alias("row"))
    keyed = keyed.withColumn("key", F.xxhash64("doc_id", "start", "ids_crc32", "row"))
    counts = keyed.groupBy("class").count().orderBy("class").collect()
    if not counts:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(length).cast("long").alias("padded"))
    sizes, demand = np.array([r["class"] for r in counts]), np.array([r["count"] for r in counts], float)
    plan = cutting_patterns(sizes, demand, length // unit)

    # ranges of ranks: class, from rank, how many a sequence, first sequence
    ranges, used, sequence = [], np.zeros(len(sizes), np.int64), 0
    for column, n in plan:
        for k in np.flatnonzero(column):
            ranges.append((int(sizes[k]), int(used[k]), int(used[k] + column[k] * n), int(column[k]), sequence))
            used[k] += column[k] * n
        sequence += n
    most = int(demand.max())
    buckets = max(1, math.ceil(most / 2000))
    keyed = keyed.withColumn("bucket", F.pmod("key", F.lit(buckets)))
    within = Window.partitionBy("class", "bucket").orderBy("key", "row")
    sums = keyed.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("class", "bucket", before.alias("before"))
    ranked = keyed.withColumn("place", F.row_number().over(within) - 1).join(sums, ["class", "bucket"]).withColumn("rank", F.col("place") + F.col("before"))
    r = spark.createDataFrame(ranges, "class long, low long, high long, each long, first long")
    by_class = r.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("low", "high", "each", "first"))).alias("ranges"))
    # one row per class, at most length / unit, with all ranges of at most 2 * length / unit patterns
    placed = ranked.join(F.broadcast(by_class), "class")
    hit = F.filter("ranges", lambda x: (x["low"] <= F.col("rank")) & (F.col("rank") < x["high"]))[0]
    placed = placed.withColumn("hit", hit).select(*pieces.columns, "key", "row", (F.col("hit.first") + F.floor((F.col("rank") - F.col("hit.low")) / F.col("hit.each"))).alias("sequence_id"))
    line = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "key", "row")
    total = F.sum("length").over(Window.partitionBy("sequence_id"))
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", total)
    power = (F.col("total").bitwiseAND(F.col("total") - 1)) == 0
    return placed.select(*pieces.columns, "sequence_id", "offset", F.when(power, F.col("total")).otherwise(length).cast("long").alias("padded"))
