"""Alignment, ranked search and encoding by chunks against plain Python with the tokenizers' own libraries."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from scribe.llm import alignment, chunks, search
from scribe.llm.packing import load_encoder

DOC = "doc_id long, text string, row string, block string, term string, item string, rank int, score string, h long, key string"
SYLLABLES = ["the", "and", "'s", " ", "  ", "\n", "<|endoftext|>", "é", "東京", "。", "1", "23", "!", "'ll", "ing", " ", "　", "<|", "|>", "endoftext", "-", "😀", "\t", ", ", "▁", "<0x41>", "\x00"]


def byte_level(plain):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = plain
    return t


def noise(r, n):
    return "".join(r.choice(SYLLABLES) for _ in range(n))


def frame(spark, rows):
    """(doc_id, text) rows with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, *["x"] * 4, 1, "x", 2, "x") for i, t in rows], DOC)


def byte_symbols():
    """Byte of each symbol of the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


def plain_alignment(text, a_model, b_model, symbols):
    if not text:
        return None
    a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
    sides = [[bytes(symbols[c] for c in a_model.id_to_token(i)) for i in a], [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]]
    if any(b"".join(s) != (" " + text).encode() for s in sides):
        return None
    (x, y) = ([(end - len(t), end) for t, end in zip(s, np.cumsum([len(t) for t in s]).tolist())] for s in sides)
    links = [(a[i], b[j]) for i, p in enumerate(x) for j, q in enumerate(y) if p[1] == q[1]]
    shared = sum(max(p[0], q[0]) < min(p[1], q[1]) for p in x for q in y)
    groups, low = [], 0
    for end in sorted({p[1] for p in x} & {q[1] for q in y}):
        groups.append("|".join(",".join(str(ids[k]) for k, p in enumerate(spans) if low < p[1] <= end) for ids, spans in ((a, x), (b, y))))
        low = end
    return len(a), len(b), shared, len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


@pytest.mark.parametrize("limit", [1 << 20, 7])
def test_alignment_like_plain_python(spark, monkeypatch, limit):
    monkeypatch.setattr(alignment.stretches_of, "__defaults__", (limit,))  # in this process only
    r = random.Random(3)
    texts = [None, "", " ", "  a b", "it's <|endoftext|> é", "<s> </s> <0x41>\n\n\t x", "x▁y", "naïve café 東京、日本 😀 ", "\x00 a", *["word " * 50] * 2, "a" * 3000] + [noise(r, r.randrange(60)) for _ in range(60)]
    a, b, symbols = byte_level(True), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), byte_symbols()
    expected = [plain_alignment(t, a, b, symbols) for t in texts]
    count = Counter(x for e in expected if e for x in e[4])
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    rows = [(-1 if i % 9 == 0 else i, *((0,) * 7 + ("",) if e is None else (*e[:4], len(e[4]), sum(count[x] == best[x[1]] for x in e[4]), sum(count[x] for x in e[4]), e[5]))) for i, e in enumerate(expected)]
    names = ["n_a", "n_b", "n_overlaps", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    documents = frame(spark, [(None if i % 9 == 0 else i, t) for i, t in enumerate(texts)])
    got = [(-1 if x["doc_id"] is None else x["doc_id"], *(x[n] for n in names)) for x in alignment.align_tokens(documents).collect()]
    assert sorted(got) == sorted(rows)
    assert alignment.align_tokens(documents.limit(0)).count() == 0


def test_stretches_align_as_the_whole_text():
    r = random.Random(5)
    left, right = alignment.ByteLevel(), alignment.Pieces()
    for _ in range(200):
        text = noise(r, r.randrange(1, 120)).replace("▁", "")
        parts = alignment.stretches_of(text, r.randrange(1, 40))
        assert "".join(parts) == " " + text
        for side in (left, right):
            cut, whole = side.encode(parts), side.encode([" " + text])  # None where the bytes do not come back
            assert (cut is None) == (whole is None) and (cut is None or np.concatenate(cut).tolist() == whole[0].tolist())


def test_long_text_is_aligned_in_bounded_pieces():
    text = " ".join(f"word{i % 977}" for i in range(700_000))
    parts = alignment.stretches_of(text)
    assert len(parts) > 4 and max(map(len, parts)) < 1_100_000 and "".join(parts) == " " + text


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(documents, items, k=20):
    counts = [(i, Counter(plain_terms(t))) for i, t in documents]
    holding, length = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counts:
            m = 75 + (25 * sum(c.values()) * holding) // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * holding + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, rank + 1, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("settings", [(8 << 20, 100_000), (300, 7)])
def test_search_like_plain_python(spark, monkeypatch, settings):
    r = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["Über", "naïve", "x_y", "A1", "İ"]
    texts = [" ".join(r.choice(words[: r.choice([3, 10, 45])]) for _ in range(r.choice([0, 1, 5, 30, 200]))) for _ in range(150)]
    texts += [None, "", " .,- ", *["w1 w2 w3"] * 40, "W1 w1," * 3000]
    documents = [(None if i in (7, 160) else i // 2 if i > 180 else i, t) for i, t in enumerate(texts)]
    items = [(1, "w1 w2 w1 w44"), (2, "nothing, here"), (3, None), (4, ""), (5, "W0-w0 über ÜBER NAÏVE"), (None, "w3 w39 x_y"), (6, " ".join(words)), (6, " ".join(words)), (7, "w1")]
    block, at_once = settings
    monkeypatch.setattr(search.index_blocks, "__defaults__", (block,))
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string")
    got = [tuple(x) for x in search.search(frame(spark, documents), asked, at_once=at_once).collect()]
    order = lambda rows: sorted(rows, key=repr)
    assert order(got) == order(plain_search(documents, dict.fromkeys(items)))
    assert search.search(frame(spark, documents).limit(0), asked).count() == 0
    assert search.search(frame(spark, documents), asked.limit(0)).count() == 0


def test_lists_are_read_only_as_far_as_needed():
    class Watched(np.ndarray):
        most = 0

        def __getitem__(self, key):
            if isinstance(key, slice):
                Watched.most = max(Watched.most, min(key.stop, len(self)))
            return super().__getitem__(key)

    impact = np.r_[np.full(30, 1000), np.full(99_970, 1)]
    lists = [search.Postings(np.arange(100_000).view(Watched), impact), search.Postings(np.arange(100_000).view(Watched), impact)]
    docs, scores = search.read_in_turn(lists, [1, 2], 100_000, 20)
    assert docs.tolist() == list(range(30)) and set(scores.tolist()) == {3000} and Watched.most <= 64
    docs, scores = search.read_in_turn(lists, [1, 2], 100_000, 20, least=3001)
    assert len(docs) == 0


def test_joined_parts_are_the_whole_encoding():
    r, codec, whole = random.Random(3), chunks.Codec(), byte_level(False)
    for _ in range(1500):
        text = noise(r, r.randrange(0, 120))
        data = text.encode()
        cuts = sorted({0, len(data), *[len(text[: r.randrange(len(text) + 1)].encode()) for _ in range(r.randrange(0, 6))]})
        parts = [(a, b, codec.encode(data[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]
        assert chunks.joined(codec, data, parts).tolist() == whole.encode(text, add_special_tokens=False).ids


def plain_digests(whole, text):
    ids = whole.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encoding_by_chunks_like_the_library(spark):
    r, whole = random.Random(4), byte_level(False)
    shared = [noise(r, 600) for _ in range(5)]
    texts = [None, "", " ", "a" * 5000, "a" * 5000, shared[0], shared[0], " " * 30_000 + "x", "word " * 100_000]
    texts += [noise(r, r.randrange(300)) + r.choice(shared) + noise(r, r.randrange(300)) + r.choice(shared) for _ in range(60)] + [noise(r, r.randrange(900)) for _ in range(40)]
    documents = frame(spark, [(None if i % 9 == 0 else i, t) for i, t in enumerate(texts)])
    got = [(-1 if x["doc_id"] is None else x["doc_id"], x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in chunks.encode_documents(documents).collect()]
    assert sorted(got) == sorted((-1 if i % 9 == 0 else i, *plain_digests(whole, t)) for i, t in enumerate(texts))
    assert chunks.encode_documents(documents.limit(0)).count() == 0


def test_chunks_follow_the_text_and_are_sent_once(spark):
    r = random.Random(6)
    passage = noise(r, 3000)
    texts = [noise(r, r.randrange(200)) + passage + noise(r, r.randrange(200)) for _ in range(20)]
    seen = [[k for *_, keys in chunks.chunked(chunks.pa.array([t])) for k in keys] for t in texts]
    common = set.intersection(*map(set, seen))
    assert len(common) >= 0.6 * len(seen[0])
    full = np.full(1 << (chunks.FILTER_BITS - 3), 255, np.uint8)
    uses = chunks.uses_of(spark.createDataFrame(list(enumerate(texts)), "row long, text string").coalesce(1), full).collect()
    assert len(uses) == sum(map(len, seen)) and sum(u["chunk"] is not None for u in uses) == len(set().union(*seen))


def test_both_libraries_give_the_same_ids_on_odd_texts():
    r, whole, fast = random.Random(9), byte_level(False), load_encoder()
    points = [*range(1, 0xD800), *range(0xE000, 0x11000), *range(0x1F000, 0x20000)]
    texts = ["é" * 100_000, " " * 100_000, "\n" * 50_000 + "x", "^" * 100_000, "a" * 100_000, "".join(map(chr, r.choices(points, k=100_000)))]
    for text in texts:
        assert fast.encode(text, allowed_special="all", disallowed_special=()) == whole.encode(text, add_special_tokens=False).ids
