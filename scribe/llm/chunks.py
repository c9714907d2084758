"""BPE encoding and decoding with reuse: chunks that documents share are encoded once, and their joins mended."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_filter, in_filter, saved
from .packing import load_encoder
from .textbytes import BASE, UNBASE, decimals, mixed, powers, texts_of

#: A chunk ends behind a window of so many bytes whose hash begins with so many zero bits, and so far from the last such place.
WINDOW, ZEROS, LEAST = 24, 9, 64
FILTER_BITS = 26
#: Places where a token ends whatever stands around: before blanks, and between a letter and a mark. The pattern that
#: splits texts into words takes blanks only at the front of a match and marks never into a run of letters; none of these
#: places lies in the string of the added token. Of letters beyond ASCII only those count that every version knows.
BREAK = re.compile(rb"(?:(?<=[!-~])|(?<=[\xc3-\xdf][\x80-\xbf])|(?<=[\xe4-\xef][\x80-\xbf][\x80-\xbf]))(?=[ \t\r\n])|(?<=[A-Za-z])(?=[-.,;:!?)\"'])|(?<=[\xe5-\xe8][\x80-\xbf][\x80-\xbf])(?=\xe3\x80[\x81\x82]|\xef\xbc\x8c)")


def chunk_ends(buf: np.ndarray, offsets: np.ndarray, limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(ends of all chunks, first chunk of each document and the end): a rolling hash of the last WINDOW bytes decides.

    Windows lie within a document, and ends are moved on to the next whole character, so equal stretches of text have
    equal chunks but at their edges. The last chunk of a document ends with it; an empty document has none.
    """
    found = [np.zeros(0, np.int64)]
    for at in range(0, max(0, len(buf) - WINDOW + 1), limit):
        part = buf[at : at + limit + WINDOW - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers("up", BASE, len(part)), out=sums[1:])
        h = mixed((sums[WINDOW:] - sums[:-WINDOW]) * powers("down", UNBASE, len(part) + 1)[: len(part) + 1 - WINDOW])
        found.append(np.flatnonzero(h >> np.uint64(64 - ZEROS) == 0) + at + WINDOW)
    ends = np.concatenate(found)
    for _ in range(3):
        inside = ends < len(buf)
        ends[inside] += (buf[ends[inside]] & 0xC0) == 0x80
    ends = np.unique(ends)
    start = offsets[np.searchsorted(offsets, ends - 1, "right") - 1]
    ends, start = ends[ends - start >= WINDOW], start[ends - start >= WINDOW]
    ends = ends[(np.diff(ends, prepend=-LEAST) >= LEAST) | (np.diff(start, prepend=-1) > 0)]
    ends = np.unique(np.concatenate([ends, offsets[1:][np.diff(offsets) > 0]]))
    return ends, np.searchsorted(ends, offsets, "right")


def keys_of(data: bytes, ends: np.ndarray, start: int = 0) -> list[bytes]:
    """128-bit digests of the chunks of data that end at `ends`."""
    out = []
    for end in ends.tolist():
        out.append(hashlib.blake2b(data[start:end], digest_size=16).digest())
        start = end
    return out


def short(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8")[::2]


def chunked(column: pa.Array) -> Iterator[tuple[int, bytes, np.ndarray, list[bytes]]]:
    """(document, bytes, ends, keys) of every text of a column; nulls are empty."""
    buf, offsets = texts_of(column)
    ends, first = chunk_ends(buf, offsets)
    for doc, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        own, data = ends[first[doc] : first[doc + 1]] - a, buf[a:b].tobytes()
        yield doc, data, own, keys_of(data, own)


def repeated_chunks(documents: DataFrame) -> DataFrame:
    """documents(text, ...) -> (h): the first halves of the digests of chunks that stand in more than one place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(short(keys) for *_, keys in chunked(batch.column("text")))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return documents.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


class Codec:
    """The byte_bpe_50k vocabulary; the string of the added token is its id, as `tokenizers` has it."""

    def __init__(self, vocabulary: str | None = None):
        self.encoder = load_encoder(vocabulary)
        n = self.encoder.max_token_value + 1
        self.length = np.array([len(self.encoder.decode_bytes([i])) for i in range(n)])

    def encode(self, data: bytes) -> np.ndarray:
        return self.encoder.encode_to_numpy(data.decode(), allowed_special="all", disallowed_special=()).astype(np.int64)

    def digests(self, ids: np.ndarray) -> tuple[int, str, str]:
        """(how many, digest of the decimal ids, digest of the decoded text)"""
        written = decimals(ids, ord(","))[0]
        return len(ids), hashlib.sha256(written[:-1].tobytes()).hexdigest(), hashlib.sha256(self.encoder.decode_bytes(ids.tolist())).hexdigest()


def last_break(data: bytes, at: int) -> int:
    """The last place up to `at` where a token ends whatever stands around; the start if there is none."""
    reach = 256
    while True:
        low = max(0, at - reach)
        places = [m.start() for m in BREAK.finditer(data, low, min(len(data), at + 3)) if m.start() <= at]
        if places or not low:
            return places[-1] if places else 0
        reach *= 4


def next_break(data: bytes, at: int) -> int:
    m = BREAK.search(data, at)
    return m.start() if m else len(data)


def joined(codec: Codec, data: bytes, parts: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Ids of the whole text from the ids of its parts (start, end, ids), each encoded alone.

    Around a join the ids may differ. What stands between the last break before it and the first one behind is encoded
    anew; the result counts only where both ends of that window are ends of tokens of the parts, too, else the window
    grows by a break on the side that disagrees. Windows that meet are one.
    """
    ends = [start + np.cumsum(codec.length[ids]) for start, _, ids in parts]
    starts = [p[0] for p in parts]

    def agrees(at: int) -> bool:
        k = int(np.searchsorted(starts, at, "right")) - 1
        if at in (0, len(data)) or starts[k] == at:
            return True
        i = int(np.searchsorted(ends[k], at))
        return i < len(ends[k]) and int(ends[k][i]) == at

    windows: list[list[int]] = []
    for join in starts[1:]:
        low, high = last_break(data, join), next_break(data, join)
        while not agrees(low):
            low = last_break(data, low - 1)
        while not agrees(high):
            high = next_break(data, high + 1)
        if windows and low < windows[-1][1]:
            windows[-1] = [min(low, windows[-1][0]), max(high, windows[-1][1])]
        elif low < high:
            windows.append([low, high])
    out: list[np.ndarray] = []

    def kept(low: int, high: int) -> None:
        for start, end, own, (_, _, ids) in zip(starts, (p[1] for p in parts), ends, parts):
            if start < high and end > low:
                a, b = np.searchsorted(own, [max(low, start), min(high, end)], "right") if len(own) else (0, 0)
                out.append(ids[a:b])

    at = 0
    for low, high in windows:
        kept(at, low)
        out.append(codec.encode(data[low:high]))
        at = high
    kept(at, len(data))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def encode_with(codec: Codec, data: bytes, ends: np.ndarray, known: dict[int, np.ndarray]) -> np.ndarray:
    """Ids of a text whose chunks `known` (by number) have been encoded; what lies between is encoded here."""
    parts: list[tuple[int, int, np.ndarray]] = []
    start = open_ = 0
    for k, end in enumerate(ends.tolist()):
        ids = known.get(k)
        if ids is not None and codec.encoder.decode_bytes(ids.tolist()) == data[start:end]:
            if open_ < start:
                parts.append((open_, start, codec.encode(data[open_:start])))
            parts.append((start, end, ids))
            open_ = end
        start = end
    if open_ < len(data):
        parts.append((open_, len(data), codec.encode(data[open_:])))
    return joined(codec, data, parts)


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def scan(documents: DataFrame, repeated: np.ndarray, vocabulary: str | None = None) -> DataFrame:
    """(row, doc_id, text, digests): documents without a repeated chunk are done, the others keep their texts."""
    shared = documents.sparkSession.sparkContext.broadcast(repeated)  # 2 ** FILTER_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, row = Codec(vocabulary), TaskContext.get().partitionId() << 36
        for batch in batches:
            rest, done = [], []
            for _, data, _, keys in chunked(batch.column("text")):
                again = bool(keys) and in_filter(shared.value, short(keys)).any()
                rest.append(not again)
                done.append((None, None, None) if again else codec.digests(codec.encode(data)))
            text = pa.compute.if_else(pa.array(rest, pa.bool_()), pa.scalar(None, batch.column("text").type), batch.column("text"))
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(rest)), pa.int64()), batch.column("doc_id"), text, *[pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)]], ["row", "doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256"])
            row += len(rest)

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, text string, {DIGESTS}")


def uses_of(waiting: DataFrame, repeated: np.ndarray) -> DataFrame:
    """(row, text) -> (row, place, key, chunk): the chunks that may be repeated; their bytes stand once in a batch."""
    shared = waiting.sparkSession.sparkContext.broadcast(repeated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seen, numbers = [], set(), batch.column("row").to_pylist()
            for doc, data, ends, keys in chunked(batch.column("text")):
                for k in np.flatnonzero(in_filter(shared.value, short(keys))).tolist() if keys else ():
                    start = int(ends[k - 1]) if k else 0
                    rows.append((numbers[doc], k, keys[k], None if keys[k] in seen else data[start : int(ends[k])]))
                    seen.add(keys[k])
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["row", "place", "key", "chunk"])

    return waiting.select("row", "text").mapInArrow(run, "row long, place long, key binary, chunk binary")


def encode_chunks(chunks: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(key, chunk) -> (key, ids), ids in two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([codec.encode(c.as_py()).astype("<u2").tobytes() for c in batch.column("chunk")], pa.binary())], ["key", "ids"])

    return chunks.select("key", "chunk").mapInArrow(run, "key binary, ids binary")


def assemble(parts: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(row, place, doc_id, text, ids), sorted by row and place, the text at place -1 -> the documents' digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        row, doc_id, text, known = None, None, "", {}

        def done() -> tuple:
            data = pa.array([text], pa.string())
            _, raw, ends, _ = next(chunked(data))
            return doc_id, *codec.digests(encode_with(codec, raw, ends, known))

        def frame(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            kinds = (kind, pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        kind = None
        for batch in batches:
            rows, kind = [], batch.schema.field("doc_id").type
            for r, place, id_, said, ids in zip(*(batch.column(c) for c in ("row", "place", "doc_id", "text", "ids"))):
                if r.as_py() != row:
                    if row is not None:
                        rows.append(done())
                    row, known = r.as_py(), {}
                if place.as_py() < 0:
                    doc_id, text = id_.as_py(), said.as_py()
                else:
                    known[place.as_py()] = np.frombuffer(ids.as_py(), "<u2").astype(np.int64)
            yield frame(rows, kind)
        if row is not None:
            yield frame([done()], kind)

    kind = parts.schema["doc_id"].dataType.simpleString()
    return parts.select("row", "place", "doc_id", "text", "ids").mapInArrow(run, f"doc_id {kind}, {DIGESTS}")


def encode_documents(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """documents(doc_id, text, ...) -> (doc_id, n_tokens, ids_sha256, decoded_sha256), ids as of the whole text.

    A first pass finds the chunks that stand in more than one place, as a filter of 2 ** FILTER_BITS bits; a second one
    encodes the documents that have none. Of the others, every chunk that the filter lets through is encoded once, sent
    to the documents that hold it, and joined with what stands between, which each document encodes itself. A full filter
    lets more chunks through and changes no result. A hot chunk is one row of a join that Spark can split; a document is
    put together from a sorted stream. Ids of a chunk are taken only if they give its bytes back.

    Null and empty texts have no ids: 0 and digests of ''. Repeated rows are encoded each; other columns are ignored;
    without documents there is no row.
    """
    repeated = hash_filter(repeated_chunks(documents), "h", FILTER_BITS)
    scanned = saved(scan(documents, repeated, vocabulary), "scanned", "zstd")
    waiting = scanned.where("text is not null")
    uses = saved(uses_of(waiting, repeated), "uses", "zstd")
    chunks = uses.where("chunk is not null").dropDuplicates(["key"])
    known = saved(encode_chunks(chunks, vocabulary), "chunks")
    sent = uses.select("row", "place", "key").join(known, "key")
    texts = waiting.select("row", F.lit(-1).cast("long").alias("place"), "doc_id", "text", F.lit(None).cast("binary").alias("ids"))
    both = texts.unionByName(sent.select("row", "place", "ids"), allowMissingColumns=True)
    put = assemble(both.repartition("row").sortWithinPartitions("row", "place"), vocabulary)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return scanned.where("text is null").select(*names).unionByName(put)
