"""Ranked lexical search: an impact-sorted index in blocks of documents, read with no random access (NRA)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, hash_filter, in_filter, saved
from .textbytes import LOWER, span_hashes, stretches, texts_of, words_of

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = np.zeros(256, bool)
BETWEEN[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
UPPER_CASE, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FILTER_BITS = 22
INDEX = "ids array<bigint>, words binary, holding bigint, length bigint, terms array<string>, sizes array<bigint>, at binary, tf binary"


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER_CASE, LOWER_CASE), F.lit(TERM), F.lit(0))


def term_hashes(terms: DataFrame) -> DataFrame:
    """terms(term) -> (h), the hashes that index_blocks() gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(span_hashes(data, offsets[:-1], offsets[1:]).view(np.int64))], ["h"])

    return terms.select("term").mapInArrow(run, "h long")


def asked_terms(items: DataFrame) -> DataFrame:
    """items(item_id, text) -> (item, item_id, term, times); rows that repeat an id and its text are one item."""
    numbered = items.select(F.col("item_id"), "text").distinct().select(F.xxhash64("item_id", "text").alias("item"), "item_id", F.explode(terms_of(F.col("text"))).alias("term"))
    return numbered.groupBy("item", "item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def index_blocks(documents: DataFrame, wanted: np.ndarray, block: int = 8 << 20) -> DataFrame:
    """documents(doc_id, text, ...) -> one row for each `block` bytes of text, or longer document: its index.

    A narrow step. `ids` are the documents' ids, `words` their terms with repeats, `terms` the distinct terms that the
    filter `wanted` lets through, with the numbers of their postings in `sizes`, and `at` and `tf` the postings: places
    in `ids` and occurrences. Texts are read in pieces of a megabyte, so a long one needs no more memory than its postings.
    """
    shared = documents.sparkSession.sparkContext.broadcast(wanted)  # 2 ** FILTER_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = texts_of(batch.column("text"))
            first = 0
            while first < len(batch):
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + block, "right")) - 1)
                yield one(batch.column("doc_id").slice(first, last - first), buf[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                first = last

    def one(ids: pa.Array, buf: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        docs, words, doc, hashes, start, end = len(ids), np.zeros(len(ids), np.int64), [], [], [], []
        for a, b in stretches(buf, BETWEEN):
            w = words_of(buf[a:b], np.clip(offsets, a, b) - a, True, BETWEEN)
            words += np.diff(w.first)
            keep = np.flatnonzero(in_filter(shared.value, w.hash))
            for out, x in ((doc, w.doc[keep]), (hashes, w.hash[keep]), (start, w.start[keep] + a), (end, w.end[keep] + a)):
                out.append(x)
        if doc:
            _, at, term = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
            spans = zip(np.concatenate(start)[at].tolist(), np.concatenate(end)[at].tolist())
            terms = [LOWER[buf[a:b]].tobytes().decode() for a, b in spans]
            posting, tf = np.unique(term * docs + np.concatenate(doc), return_counts=True)
            term, at = posting // docs, posting % docs
        else:
            terms, term, at, tf = [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        values = [ids.cast(pa.int64()), words.tobytes(), int((words > 0).sum()), int(words.sum()), terms, np.bincount(term, minlength=len(terms)), at.astype("<i4").tobytes(), tf.astype("<i4").tobytes()]
        kinds = [pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) if not isinstance(v, pa.Array) else pa.ListArray.from_arrays([0, docs], v) for v, k in zip(values, kinds)], [c.split()[0] for c in INDEX.split(", ")])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


@dataclass
class Postings:
    """A term's documents in a block, highest impact first."""

    docs: np.ndarray
    impact: np.ndarray


def postings_of(at: np.ndarray, tf: np.ndarray, weight: int, m: np.ndarray) -> Postings:
    impact = weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[at]))
    order = np.argsort(-impact, kind="stable")
    return Postings(at[order], impact[order])


def read_in_turn(lists: list[Postings], times: list[int], docs: int, k: int, least: int = 1, depth: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores): all that score at least `least` and the k-th best, with their whole scores.

    Every list is read in order of impact to the same depth, which doubles from round to round. What a document has been
    seen with is its lower bound; with the next impact of each list that it has not been seen in, it is the upper one. It
    ends when no document that could still be among the best, ties included, has bounds that differ.
    """
    lower, read = np.zeros(docs, np.int64), [0] * len(lists)
    while True:
        ahead = [int(x.impact[r]) * t if r < len(x.docs) else 0 for x, r, t in zip(lists, read, times)]
        unseen = np.full(docs, sum(ahead), np.int64)
        for x, r, next_ in zip(lists, read, ahead):
            if next_ and r:
                unseen[x.docs[:r]] -= next_
        best = max(least, int(np.partition(lower, docs - k)[docs - k]) if docs >= k else 1)
        able = lower + unseen >= best
        if not (unseen[able] > 0).any():
            found = np.flatnonzero(able & (lower > 0))
            return found, lower[found]
        for j, (x, r, t) in enumerate(zip(lists, read, times)):
            lower[x.docs[r:depth]] += x.impact[r:depth] * t
            read[j] = min(depth, len(x.docs))
        depth *= 2


def search_blocks(index: DataFrame, asked: list, holding: int, length: int, k: int) -> DataFrame:
    """An index and items' terms [(item, term, times, weight)] -> (item, doc_id, score): each task's best k for every item.

    A task reads one block after another; an item's k-th best score so far is what documents of later blocks must reach.
    """
    wanted: dict[int, list[tuple[str, int]]] = {}
    for item, term, times, _ in asked:
        wanted.setdefault(item, []).append((term, times))
    shared = index.sparkSession.sparkContext.broadcast((wanted, {term: weight for _, term, _, weight in asked}))  # bounded by search()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights = shared.value
        best: dict[int, list[tuple[int, bool, int]]] = {}
        for batch in batches:
            for row in range(len(batch)):
                ids, terms = (batch.column(c)[row].as_py() for c in ("ids", "terms"))
                words, at, tf = (np.frombuffer(batch.column(c)[row].as_py(), kind).astype(np.int64) for c, kind in (("words", "<i8"), ("at", "<i4"), ("tf", "<i4")))
                m = 75 + (25 * words * holding) // max(1, length)
                ends = np.cumsum([0, *batch.column("sizes")[row].as_py()])
                lists = {t: postings_of(at[a:b], tf[a:b], weights[t], m) for t, a, b in zip(terms, ends[:-1].tolist(), ends[1:].tolist()) if t in weights}
                for item, its in wanted.items():
                    own = [(lists[t], n) for t, n in its if t in lists]
                    before = best.get(item, [])
                    least = max(1, -before[-1][0]) if len(before) == k else 1
                    if own:
                        docs, scores = read_in_turn([x for x, _ in own], [n for _, n in own], len(ids), k, least)
                        if len(docs):
                            best[item] = sorted(before + [(-s, ids[d] is None, ids[d] or 0) for d, s in zip(docs.tolist(), scores.tolist())])[:k]
        rows = [(item, None if none else id_, -score) for item, found in best.items() for score, none, id_ in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item long, doc_id long, score long")


def search(documents: DataFrame, items: DataFrame, k: int = 20, at_once: int = 100_000) -> DataFrame:
    """documents(doc_id, text, ...), items(item_id, text, ...) -> (item_id, rank, doc_id, score): each item's k best documents.

    One pass over the texts writes the index of the terms that items ask for (a filter of 2 ** FILTER_BITS bits leaves the
    others out, a join on the terms decides); document counts come from it. Then every block of the index is searched
    for every item, `at_once` terms of items at a time, and the best of the tasks are merged, first in 64 parts, then
    whole. Blocks are bounded in bytes and results in rows, so no item, term or document makes a task larger.

    Null and empty texts have no terms: such documents count nowhere, such items have no row, and neither have items
    without a match. Equal scores are ranked by id, null ids last; repeated documents are ranked each; other columns are
    ignored. Without documents or items there is no row.
    """
    asked = saved(asked_terms(items), "asked")
    index = saved(index_blocks(documents, hash_filter(term_hashes(asked), "h", FILTER_BITS)), "index")
    holding, length = index.agg(F.coalesce(F.sum("holding"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    df = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.sizes").alias("df"))
    weight = F.floor(1000 * F.ln((2 * F.lit(float(holding)) + 2) / (2 * F.col("df").cast("double") + 1))).cast("long")
    weighted = saved(asked.join(df, "term").select("item", "term", "times", weight.alias("weight")), "weighted")
    parts = max(1, math.ceil(weighted.count() / at_once))
    found = None
    for part in range(parts):
        rows = weighted.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).select("item", "term", "times", "weight").collect()
        own = search_blocks(index, [tuple(r) for r in rows], holding, length, k)
        found = own if found is None else found.unionByName(own)
    forget(weighted)
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item", F.pmod(F.xxhash64("doc_id"), F.lit(64))], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= k)
    names = asked.select("item", "item_id").distinct()
    return found.join(names, "item").select("item_id", "rank", "doc_id", "score")


SQL = rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER_CASE}', '{LOWER_CASE}'), '{TERM}')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY ALL),
s AS (SELECT count(*) AS holding, sum(n)::BIGINT AS length FROM n),
w AS (SELECT term, floor(1000 * ln((2 * holding + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, holding),
m AS (SELECT doc_id, 75 + (25 * n * holding) // length AS m FROM n, s),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER_CASE}', '{LOWER_CASE}'), '{TERM}')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
f AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM f WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
"""
