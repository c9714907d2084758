"""Suffix dedup by prefix-free parsing: rolling-hash triggers cut phrases, a dictionary's suffixes are sorted, places come from the parse."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, saved
from .textbytes import BASE, UNBASE, mixed, pieces, powers, texts_of

#: Bytes whose rolling hash decides on a trigger.
TRIGGER = 48
#: Bits that a trigger's hash is cut to: it only chooses what is looked at, never what is removed.
SHORT = np.uint64(16)
#: Phrases whose suffixes are sorted together.
GROUP = 20000


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each x[i : i + width], by doubling."""
    size = 1
    while size * 2 <= width:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def phrases_of(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, document, trigger hash) of each phrase: its strings of `size` bytes start at low, ..., high.

    A string's trigger is its place with the least rolling hash, the leftmost of several; a phrase is a maximal run of
    strings with the same trigger and the byte after it. So each string of a text lies in one phrase, phrases overlap by
    `size` bytes, and equal runs of strings are cut into equal phrases wherever they stand. No phrase is the beginning of
    another: a string more, which its last byte completes, has another trigger, or the text ends.
    """
    n, none = len(buf), np.zeros(0, np.int64)
    if n < size:
        return none, none, none, none.astype(np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers("up", BASE, n), out=sums[1:])
    h = mixed((sums[TRIGGER:] - sums[:-TRIGGER]) * powers("down", UNBASE, n + 1)[: n - TRIGGER + 1])
    bits = np.uint64(n.bit_length())
    key = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    at = (sliding_least(key, size - TRIGGER + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    fits = np.arange(len(at)) + size <= np.repeat(offsets[1:], np.diff(offsets))[: len(at)]
    other = at[1:] != at[:-1]
    low = np.flatnonzero(fits & np.r_[True, ~fits[:-1] | other])
    high = np.flatnonzero(fits & np.r_[~fits[1:] | other, True])
    return low, high, np.searchsorted(offsets, low, "right") - 1, h[at[low]] >> SHORT


def digests(data: memoryview, low: np.ndarray, high: np.ndarray, ended: np.ndarray | None = None) -> np.ndarray:
    """128-bit digests of data[low:high] as two longs each; `ended` tells apart those that a text's end cuts."""
    hash_of = hashlib.blake2b
    if ended is None:
        out = [hash_of(data[a:b], digest_size=16).digest() for a, b in zip(low.tolist(), high.tolist())]
    else:
        out = [hash_of(data[a:b], digest_size=16, person=b"end" if e else b"").digest() for a, b, e in zip(low.tolist(), high.tolist(), ended.tolist())]
    return np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)


def trigger_counts(texts: DataFrame, size: int) -> DataFrame:
    """(h, n): how often triggers' hashes occur, counted by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = texts_of(batch.column("text"))
            for i, j in pieces(offsets):
                h, n = np.unique(phrases_of(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], ["h", "n"])

    return texts.select("text").mapInArrow(run, "h long, n int")


def parse(texts: DataFrame, size: int) -> DataFrame:
    """texts(doc, text) -> the parse: (h, c0, c1, doc, low, more), c being the phrase's digest and more = high - low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = texts_of(batch.column("text"))
            for i, j in pieces(offsets):
                part, ends = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                low, high, doc, h = phrases_of(part, ends, size)
                end = ends[doc + 1]
                c = digests(memoryview(np.ascontiguousarray(part)), low, np.minimum(high + size + 1, end), high + size + 1 > end)
                columns = [pa.array(h.view(np.int64)), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy()), batch.column("doc").take(pa.array(doc + i)), pa.array((low - ends[doc]).astype(np.int32)), pa.array((high - low).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["h", "c0", "c1", "doc", "low", "more"])

    return texts.mapInArrow(run, f"h long, c0 long, c1 long, doc {texts.schema['doc'].dataType.simpleString()}, low int, more int")


def phrase_bytes(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """wanted(doc, low, more) -> (doc, low, bytes); a document's phrases are one list, as long as the document at most."""
    lists = wanted.groupBy("doc").agg(F.collect_list("low").alias("low"), F.collect_list("more").alias("more"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, lows, out = [], [], []
            for i, (text, low, more) in enumerate(zip(*(batch.column(k) for k in ("text", "low", "more")))):
                text, low = (text.as_py() or "").encode(), low.as_py()
                doc += [i] * len(low)
                lows += low
                out += [text[a : a + m + size] for a, m in zip(low, more.as_py())]
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(doc, pa.int64())), pa.array(lows, pa.int32()), pa.array(out, pa.binary())], ["doc", "low", "bytes"])

    return texts.join(lists.hint("merge"), "doc").mapInArrow(run, f"doc {texts.schema['doc'].dataType.simpleString()}, low int, bytes binary")


def sorted_suffixes(rows: pa.Table, size: int) -> pa.RecordBatch:
    """Phrases in the order of their places -> their strings: (w0, w1, doc, low, high).

    The phrases' suffixes, cut at `size` bytes, are sorted by their bytes, equal ones by place. Where the longest common
    prefix with the one before is all of `size`, a string has been seen: it is a repeat for sure and given by its ends.
    Each other one is the first of its kind here and is given by its digest, to be compared with those of other tasks.
    """
    data = rows.column("bytes").combine_chunks()
    offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    buf = np.frombuffer(data.buffers()[2], np.uint8)
    n = np.diff(offsets) - size + 1
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    string = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buf, size)[offsets[row] + step])
    order = np.argsort(string.view(f"S{size}").ravel(), kind="stable")
    string = string[order]
    seen = np.r_[False, (string[1:] == string[:-1]).all(1)]
    start = rows.column("low").to_numpy().astype(np.int64)[row] + step
    # repeats in runs: of one phrase, one after the other
    again = np.zeros(len(order), bool)
    again[order[seen]] = True
    head = np.flatnonzero(again & ~(np.r_[False, again[:-1]] & (step > 0)))
    tail = np.flatnonzero(again & ~np.r_[(again[1:] & (step[1:] > 0)), False])
    first = order[~seen]
    at = np.arange(int((~seen).sum())) * size
    w = digests(memoryview(string[~seen].tobytes()), at, at + size)
    # runs meet nothing in the shuffle; their keys only spread them
    keys = mixed(start[head].astype(np.uint64) * BASE + head.astype(np.uint64)).view(np.int64)
    doc = rows.column("doc").combine_chunks().take(pa.array(row[np.r_[first, head]]))
    high = pa.array(np.r_[start[first], start[tail] + size], pa.int64(), mask=np.r_[np.ones(len(first), bool), np.zeros(len(head), bool)])
    columns = [pa.array(np.r_[w[:, 0], keys]), pa.array(np.r_[w[:, 1], keys]), doc, pa.array(np.r_[start[first], start[head]]), high]
    return pa.RecordBatch.from_arrays(columns, ["w0", "w1", "doc", "low", "high"])


def repeats(texts: DataFrame, size: int) -> DataFrame:
    """texts(doc, text) -> (doc, low, high): for each text with any, arrays of byte ranges whose strings also start earlier.

    1. A repeated string has a repeated trigger: triggers are counted, and the parse is kept where they occur again.
    2. The dictionary is the distinct phrases, each with its first place; later copies are covered whole. 3. Strings of
    the dictionary can only repeat those of another phrase with the same trigger. The bytes of such phrases are fetched
    and their suffixes sorted in every task; phrases hold their strings whole, so the order of the parse's own suffixes
    decides nothing beyond first places. What a task has not seen goes on by digest, one row for each string and group of
    phrases, and the least place is a string's first. All steps deal rows by hash or by joins that Spark splits; the
    rows of one string are as many as the groups that hold it, however many phrases do.
    """
    size_ = F.lit(size)
    often = saved(trigger_counts(texts, size).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "triggers")
    again = saved(parse(texts, size).join(often.hint("merge"), "h", "left_semi"), "parse")
    dictionary = saved(again.groupBy("h", "c0", "c1").agg(F.min(F.struct("doc", "low", "more")).alias("first"), F.count(F.lit(1)).alias("n")), "dictionary")
    copied = dictionary.where("n > 1").select("c0", "c1", F.col("first.doc").alias("d"), F.col("first.low").alias("l"))
    copies = again.join(copied.hint("merge"), ["c0", "c1"]).where((F.col("doc") != F.col("d")) | (F.col("low") != F.col("l")))
    whole = saved(copies.select("doc", F.col("low").cast("long").alias("low"), (F.col("low") + F.col("more") + size_).cast("long").alias("high")), "copies")
    forget(often, again)

    shared = saved(dictionary.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "shared")
    wanted = dictionary.join(shared.hint("merge"), "h", "left_semi").select("first.doc", "first.low", "first.more")
    fetched = saved(phrase_bytes(texts, wanted, size), "phrases")
    forget(dictionary, shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + len(batch)
            if n >= GROUP:
                yield sorted_suffixes(pa.Table.from_batches(held), size)
                held, n = [], 0
        if n:
            yield sorted_suffixes(pa.Table.from_batches(held), size)

    kind = texts.schema["doc"].dataType.simpleString()
    strings = fetched.sortWithinPartitions("doc", "low").mapInArrow(run, f"w0 long, w1 long, doc {kind}, low long, high long")
    place = F.struct("doc", "low")
    first = F.min(F.when(F.col("high").isNull(), place)).over(Window.partitionBy("w0", "w1"))
    later = strings.withColumn("first", first).where(F.col("high").isNotNull() | (place != F.col("first"))).select("doc", "low", F.coalesce("high", F.col("low") + size_).alias("high"))
    spans = whole.unionByName(later).groupBy("doc").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))
    found = saved(spans, "spans")
    forget(whole, fetched)
    return found


def remove_repeats(documents: DataFrame, size: int = 100) -> DataFrame:
    """documents(doc_id, text, ...) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256).

    Removes each UTF-8 byte of a string of `size` bytes that also starts earlier: in a smaller doc_id, or earlier in the
    same text. Ids may be of any type that has an order. Null texts are empty. Rows that repeat an id and its text get the
    same result; of rows that repeat an id with another text, the one with the smaller hash of its text counts as
    earlier. Rows with null ids keep their texts and are compared with nothing; an empty table gives no row; other
    columns are ignored.
    """
    repeated = not documents.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    key = F.struct("doc_id", F.xxhash64("text").alias("text")) if repeated else F.col("doc_id")
    texts = documents.select(F.when(F.col("doc_id").isNotNull(), key).alias("doc"), "text")
    compared = texts.where("doc is not null")
    found = repeats(compared.dropDuplicates(["doc"]) if repeated else compared, size)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, low, high in zip(*(batch.column(k) for k in ("text", "low", "high"))):
                data = (text.as_py() or "").encode()
                if low.is_valid:
                    edge = np.zeros(len(data) + 1, np.int64)
                    np.add.at(edge, low.values.to_numpy(), 1)
                    np.add.at(edge, high.values.to_numpy(), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    n, spans = int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                else:
                    n, spans, kept = 0, 0, data
                out.append((len(data), n, spans, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = texts.join(found.hint("merge"), "doc", "left").select(F.col("doc.doc_id" if repeated else "doc").alias("doc_id"), "text", "low", "high")
    return rows.mapInArrow(cut_out, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


SQL = """
WITH n AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
w AS (SELECT doc_id, s, md5(substr(x, 2 * s + 1, 200)) AS w FROM (SELECT doc_id, x, unnest(range(n - 99)) AS s FROM n WHERE n >= 100)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, s, sum(CASE WHEN s <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS g
  FROM (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM r)),
z AS (SELECT doc_id, min(s) AS low, max(s) + 100 AS high FROM g GROUP BY doc_id, g),
k AS (SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS since FROM z),
t AS (SELECT doc_id, string_agg(substr(x, 2 * since + 1, 2 * (low - since)), '' ORDER BY low) AS head, max(high) AS high, sum(high - low) AS removed, count(*) AS spans FROM k JOIN n USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(high, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN t USING (doc_id)
"""
