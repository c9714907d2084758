"""Quality rules: base counts, and repeated substrings of words found by suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbytes import pieces, texts_of, words_of

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def longest_repeats(token: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position the length of the longest substring that starts there and also elsewhere in its document.

    `token` holds 64-bit token values, `doc` the ascending document of each position. A suffix array over all documents
    of the batch by prefix doubling (ties only are sorted again), then the longest common prefixes of neighbours from
    the ranks kept at each doubling; the longer of a suffix's two is the length asked for.
    """
    n = len(token)
    if not n:
        return np.zeros(0, np.int64)
    after = np.searchsorted(doc, doc, "right")  # where the document ends
    order = np.lexsort((token, doc))
    new = np.r_[True, (token[order][1:] != token[order][:-1]) | (doc[order][1:] != doc[order][:-1])]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    levels, size = [rank], 1
    while True:
        shared = np.bincount(rank, minlength=n)[rank] > 1
        at = np.flatnonzero(shared)
        if not len(at) or size > n:
            break
        to = at + size
        second = np.where(to < after[at], rank[np.minimum(to, n - 1)], -1)
        o = np.lexsort((second, rank[at]))
        at, first, second = at[o], rank[at][o], second[o]
        group = np.r_[True, first[1:] != first[:-1]]
        new = group | np.r_[True, second[1:] != second[:-1]]
        place = np.arange(len(at))
        offset = np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        rank = rank.copy()
        rank[at] = first + offset
        levels.append(rank)
        size *= 2
    # ties that are left are equal to the ends of their documents' runs; any order among them will do
    suffix = np.argsort(rank, kind="stable")
    a, b = suffix[:-1], suffix[1:]
    near = levels[0][a] == levels[0][b]
    i, j = a[near], b[near]
    length = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = i + length, j + length
        inside = (x < after[i]) & (y < after[j])
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        same = inside & (levels[k][x] == levels[k][y]) & (x + (1 << k) <= after[i]) & (y + (1 << k) <= after[j])
        length[same] += 1 << k
    lcp = np.zeros(n + 1, np.int64)
    lcp[1:n][near] = length
    out = np.empty(n, np.int64)
    out[suffix] = np.maximum(lcp[:-1], lcp[1:])
    return out


def covered(length: np.ndarray, least: int, most: int | None = None) -> np.ndarray:
    """Which positions lie in a span [i, i + length[i]) with length[i] >= least; spans are cut to `most`."""
    n = len(length)
    i = np.flatnonzero(length >= least)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, i, 1)
    np.add.at(edge, i + (length[i] if most is None else most), -1)
    return np.cumsum(edge[:-1]) > 0


def repeated_lines(text: bytes) -> int:
    seen, n = set(), 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line.strip(b" \t\n\v\f\r"):
                n += line in seen
                seen.add(line)
    return n


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def measure(buf: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """NAMES as rows, documents as columns."""
    docs = len(offsets) - 1
    w = words_of(buf, offsets, lower=False)
    sums = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][offsets])
    word = np.zeros(len(buf) + 1, np.int64)
    word[w.start] += 1
    np.add.at(word, w.end, -1)
    inside = np.cumsum(word[:-1]) > 0
    length = longest_repeats(w.hash, w.doc)
    by = lambda x: np.bincount(w.doc, x, docs) if len(w.doc) else np.zeros(docs)
    longest = np.zeros(docs, np.int64)
    np.maximum.at(longest, w.doc, length)
    lines = [repeated_lines(buf[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
    return np.array([np.diff(w.first), sums(inside & ((buf & 0xC0) != 0x80)), sums(SYMBOL[buf]), lines, by(covered(length, 3, 3)), by(covered(length, least)), longest], np.int64)


def quality_rules(documents: DataFrame, least_words: int = 10, most_covered: float = 0.2, most_repeat: int = 100) -> DataFrame:
    """documents(doc_id, text, ...) -> (doc_id, NAMES..., base_failed, kept).

    A word substring of `least_words` words or more that occurs twice in a text is a repeat; the union of all repeats'
    spans may cover at most `most_covered` of the words, and none may be longer than `most_repeat` words. All copies
    count as covered, so a fifth is a tenth beyond the first of two copies; the base rules alone allow up to a half.
    A narrow step. Null texts have no words and fail the base rules; repeated rows are
    judged each; an empty table gives no row; other columns are ignored.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = texts_of(batch.column("text"))
            m = np.zeros((len(NAMES), len(batch)), np.int64)
            for i, j in pieces(offsets):
                m[:, i:j] = measure(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], least_words)
            n, repeat, cover, longest = m[0], m[4], m[5], m[6]
            failed = (n < 50) | (100 * repeat > 50 * n)
            kept = ~failed & (cover <= most_covered * n) & (longest <= most_repeat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x) for x in m], pa.array(failed), pa.array(kept)], ["doc_id", *NAMES, "base_failed", "kept"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(judge, f"doc_id {kind}, {', '.join(f'{n} long' for n in NAMES)}, base_failed boolean, kept boolean")
