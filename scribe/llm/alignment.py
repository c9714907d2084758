"""Alignment of two tokenizers' tokens over the same bytes: covering tokens by merge_asof, groups, links and their counts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .common import forget, saved
from .packing import load_encoder
from .textbytes import decimals, pieces, texts_of

#: Before a blank between other plain characters both vocabularies begin a new token, so long texts are cut there.
CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")


class Pieces:
    """The piece_bpe_32k vocabulary: ids of texts and the bytes of every id."""

    def __init__(self, model: str | None = None):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model or public_tokenizers.path("piece_bpe_32k.model"))
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size()))]
        if any(b" " in x.lstrip(b" ") for x in self.bytes):
            raise ValueError("texts are cut before blanks, so no piece may hold a blank behind other bytes")
        self.length = np.array([len(x) for x in self.bytes])

    def encode(self, stretches: list[str]) -> list[np.ndarray] | None:
        """Ids of each stretch (blank + text); None if the bytes of all together are not those of the stretches."""
        out = self.model.encode([s[1:] for s in stretches], num_threads=1)
        if any(b"".join([self.bytes[i] for i in ids]) != s.encode() for ids, s in zip(out, stretches)):
            return None
        return [np.array(ids, np.int64) for ids in out]


class ByteLevel:
    """The byte_bpe_50k vocabulary, strings of its added token being plain text."""

    def __init__(self, vocabulary: str | None = None):
        self.encoder = load_encoder(vocabulary)
        n = self.encoder.max_token_value
        self.length = np.array([len(self.encoder.decode_single_token_bytes(i)) for i in range(n)] + [0])

    def encode(self, stretches: list[str]) -> list[np.ndarray] | None:
        out = [self.encoder.encode_to_numpy(s, disallowed_special=()).astype(np.int64) for s in stretches]
        return out if all(self.length[ids].sum() == len(s.encode()) for ids, s in zip(out, stretches)) else None


def stretches_of(text: str, limit: int = 1 << 20) -> list[str]:
    """blank + text, cut before blanks about every `limit` characters, so that each stretch begins with a blank."""
    text, out, at = " " + text, [], 0
    while len(text) - at > limit:
        cut = CUT.search(text, at + limit)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def spans(ids: list[np.ndarray], length: np.ndarray, name: str) -> pd.DataFrame:
    """Tokens of stretches with start, end and `at`, the start under the stretch's number, by which they are sorted."""
    flat, sizes = np.concatenate(ids), np.array([len(x) for x in ids])
    number = np.repeat(np.arange(len(ids), dtype=np.int64), sizes)
    end = np.cumsum(length[flat])
    base = np.concatenate([[0], end[np.cumsum(sizes) - 1][:-1]])[number]
    end = end - base
    start = end - length[flat]
    return pd.DataFrame({"at": (number << 40) | start, name: np.arange(len(flat)), f"end_{name}": (number << 40) | end})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """All pairs of an a and a b token that share bytes.

    Of two such tokens the one that starts later starts inside the other, so the pairs are those of every token start
    with the other side's covering token, both ways; equal starts would come twice.
    """
    one = pd.merge_asof(a, b.assign(start=b["at"]), on="at")
    two = pd.merge_asof(b, a.assign(start=a["at"]), on="at")
    return pd.concat([one, two[two["start"] < two["at"]]], ignore_index=True)[["a", "end_a", "b", "end_b"]]


@dataclass
class Aligned:
    """What align() finds in a list of stretches: per stretch the overlaps and groups, its part of the digest, links in order."""

    n_overlaps: np.ndarray
    n_groups: np.ndarray
    written: list[bytes]
    pairs: np.ndarray  # a id << 16 | b id of each link
    n_links: np.ndarray


def align(a_ids: list[np.ndarray], b_ids: list[np.ndarray], a_length: np.ndarray, b_length: np.ndarray) -> Aligned:
    a, b = spans(a_ids, a_length, "a"), spans(b_ids, b_length, "b")
    n = len(a_ids)
    both = overlaps(a, b)
    per = lambda key: np.bincount(key.to_numpy() >> 40, minlength=n)
    links = both[both["end_a"] == both["end_b"]].sort_values("end_a")
    flat_a, flat_b = np.concatenate(a_ids), np.concatenate(b_ids)
    common = links["end_a"].to_numpy()
    group_a, group_b = np.searchsorted(common, a["end_a"].to_numpy()), np.searchsorted(common, b["end_b"].to_numpy())
    after = np.concatenate([np.where(common[group_a] == a["end_a"].to_numpy(), ord("|"), ord(",")), np.where(common[group_b] == b["end_b"].to_numpy(), ord(";"), ord(","))])
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    data, ends = decimals(np.concatenate([flat_a, flat_b])[order], after[order])
    tokens = np.cumsum([0, *(len(x) + len(y) for x, y in zip(a_ids, b_ids))])
    at = np.concatenate([[0], ends])[tokens].tolist()
    pairs = flat_a[links["a"].to_numpy()] << 16 | flat_b[links["b"].to_numpy()]
    return Aligned(per(both["end_a"]), np.bincount(common >> 40, minlength=n), [data[x:y].tobytes() for x, y in zip(at[:-1], at[1:])], pairs, per(links["end_a"]))


@dataclass
class Document:
    n_a: int = 0
    n_b: int = 0
    n_overlaps: int = 0
    n_groups: int = 0
    n_links: int = 0
    open: bytes = b""
    digest: object = field(default_factory=hashlib.sha256)

    def add(self, n_a: int, n_b: int, n_overlaps: int, n_groups: int, n_links: int, written: bytes) -> None:
        self.n_a, self.n_b, self.n_overlaps, self.n_groups, self.n_links = self.n_a + n_a, self.n_b + n_b, self.n_overlaps + n_overlaps, self.n_groups + n_groups, self.n_links + n_links
        self.digest.update(self.open + written[:-1])
        self.open = written[-1:]

    @property
    def sha256(self) -> str:
        return self.digest.hexdigest() if self.n_a else ""


COUNTS = ["n_a", "n_b", "n_overlaps", "n_groups", "n_links"]
LISTS = pa.struct([("pair", pa.int64()), ("n", pa.int64())])


def align_blocks(documents: DataFrame, vocabulary: str | None = None, model: str | None = None, block: int = 2 << 20) -> DataFrame:
    """documents(doc_id, text, ...) -> one row for each `block` bytes of text, or longer document: what it holds.

    `docs` has a document's id, counts and digest, `pairs` the block's distinct id pairs with how many links hold them,
    `links` the links of all documents in order as numbers of pairs. A narrow step; long texts are aligned in stretches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = ByteLevel(vocabulary), Pieces(model)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = texts_of(batch.column("text"))
            for first, last in pieces(offsets, block):
                yield one(left, right, batch.slice(first, last - first), number)
                number += 1

    def one(left: ByteLevel, right: Pieces, rows: pa.RecordBatch, number: int) -> pa.RecordBatch:
        docs, links, waiting, size = [Document() for _ in range(len(rows))], [], [], 0

        def settle() -> None:
            nonlocal waiting, size
            if waiting:
                got = align([a for _, a, _ in waiting], [b for _, _, b in waiting], left.length, right.length)
                for k, (doc, a, b) in enumerate(waiting):
                    docs[doc].add(len(a), len(b), int(got.n_overlaps[k]), int(got.n_groups[k]), int(got.n_links[k]), got.written[k])
                links.append(got.pairs)
            waiting, size = [], 0

        for doc, text in enumerate(rows.column("text")):
            text = text.as_py()
            if text:
                parts = stretches_of(text)
                a, b = left.encode(parts), right.encode(parts)
                for x, y in zip(a, b) if a and b else ():
                    waiting.append((doc, x, y))
                    size += len(x) + len(y)
                    if size > 1_000_000:
                        settle()
        settle()
        pair, place, n = np.unique(np.concatenate(links) if links else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
        said = pa.StructArray.from_arrays([rows.column("doc_id"), *[pa.array([getattr(d, c) for d in docs], pa.int64()) for c in COUNTS], pa.array([d.sha256 for d in docs], pa.string())], ["doc_id", *COUNTS, "groups_sha256"])
        counts = pa.StructArray.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])
        packed = pa.compress(place.astype("<i4"), "zstd", asbytes=True)
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.ListArray.from_arrays([0, len(docs)], said), pa.ListArray.from_arrays([0, len(pair)], counts), pa.array([packed], pa.binary()), pa.array([len(place)])], ["block", "docs", "pairs", "links", "n_links"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"block long, docs array<struct<doc_id:{kind},{','.join(f'{c}:bigint' for c in COUNTS)},groups_sha256:string>>, pairs array<struct<pair:bigint,n:bigint>>, links binary, n_links long")


def align_tokens(documents: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """documents(doc_id, text, ...) -> (doc_id, n_a, n_b, n_overlaps, n_groups, n_links, n_best, count_sum, groups_sha256).

    Two tokens overlap if they share bytes; those that also end together are linked, and where they end a group of tokens
    of both sides ends. An id pair's count is the number of links that hold it in all documents; a link is best if no
    other pair of its second id has a higher count.

    Texts are tokenised once, in blocks of documents. Of a block its distinct pairs are shuffled, each once, to be counted;
    the counts come back to the block, which alone adds them up over its links. So a pair that most documents hold has no
    more rows than there are blocks. Null and empty texts, and those that the second vocabulary does not give back byte
    by byte, have no tokens: zeros and ''. Repeated rows have a row each; other columns are ignored; without documents there is no row.
    """
    blocks = saved(align_blocks(documents, vocabulary, model), "blocks")
    pairs = blocks.select("block", F.explode("pairs").alias("p")).select("block", "p.pair", "p.n")
    counts = saved(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "counts")
    other = F.col("pair").bitwiseAND(F.lit(0xFFFF))
    highest = counts.groupBy(other.alias("b")).agg(F.max("count").alias("highest"))
    judged = saved(counts.withColumn("b", other).join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best")), "judged")
    forget(counts)
    known = pairs.select(F.col("block").alias("of"), "pair").join(judged, "pair")

    def add_up(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("pair")
        count, best = right["count"].to_numpy(), right["best"].to_numpy().astype(np.int64)
        out = []
        for row in range(left.num_rows):
            docs = left["docs"].chunk(0).flatten() if left["docs"].num_chunks == 1 else left["docs"].combine_chunks().flatten()
            docs = pa.Table.from_struct_array(docs)
            n = left["n_links"][row].as_py()
            place = np.frombuffer(pa.decompress(left["links"][row].as_buffer(), 4 * n, "zstd"), "<i4") if n else np.zeros(0, np.int32)
            ends = np.cumsum([0, *docs["n_links"].to_pylist()])
            for name, value in (("n_best", best), ("count_sum", count)):
                total = np.concatenate([[0], np.cumsum(value[place])]) if n else np.zeros(1, np.int64)
                docs = docs.append_column(name, pa.array(total[ends[1:]] - total[ends[:-1]]))
            out.append(docs)
        return pa.concat_tables(out).select(names)

    names = ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"]
    kind = documents.schema["doc_id"].dataType
    schema = StructType([StructField("doc_id", kind), *_parse_datatype_string(", ".join(f"{c} long" for c in names[1:-1])).fields, *_parse_datatype_string("groups_sha256 string").fields])
    return blocks.select("block", "docs", "links", "n_links").groupBy("block").cogroup(known.groupBy("of")).applyInArrow(add_up, schema)
