"""Small fixtures against plain Python: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scribe.llm import chat, embeddings, mixing, neardup, packing, pii, quality, repetition, suffixes, urls
from scribe.llm.common import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n, vocabulary=400):
    return " ".join(f"w{int(vocabulary * r.random() ** 2)}" + ("." if r.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    rows = {i: prose(r, r.choice([0, 1, 2, 30, 80, 200, 400])) for i in range(60)}
    base = prose(r, 300, 5000)
    passage = prose(r, 40, 5000)
    for i in range(60, 90):  # near copies
        words = base.split()
        for _ in range(r.randrange(0, 14)):
            words[r.randrange(len(words))] = "other"
        rows[i] = " ".join(words)
    for i in range(90, 100):
        rows[i] = rows[i - 60]
    for i in range(100, 110):
        rows[i] = prose(r, 50, 3000) + "\n" + passage + "\n" + prose(r, 60, 3000)
    rows |= {110: None, 111: "", 112: "é" * 300, 113: "Der " * 4000, 114: "\n".join(["one line of words here"] * 40), 115: " \t\n ", 116: "ß ÄÖ &&& $$$ <>|"}
    return rows


@pytest.fixture(scope="module")
def documents(spark, texts):
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or "")) for i, t in texts.items()]
    return spark.createDataFrame(rows, DOC).withColumns({"component": F.lit("x"), "h": F.lit(1), "score": F.lit("clash"), "id": F.lit(2), "bucket": F.lit(0)})


def empty(spark):
    return spark.createDataFrame([], DOC)


def sets_of(texts, k):
    out = {}
    for i, t in texts.items():
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = set(zip(*(w[j:] for j in range(k)))) if len(w) >= k else ({tuple(w)} if w else set())
    return out


def components(ids, linked):
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


def test_connected_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    ids = {x for p in pairs for x in p}
    expected = components(ids, pairs)
    got = {x["id"]: x["component"] for x in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got.get(i, i) == expected[i] for i in ids)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_learns_held_out_labels(spark):
    r = random.Random(2)
    rows = [(i, prose(r, 80) if i % 3 else " ".join(w + "$$$" for w in prose(r, 80).split())) for i in range(600)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))  # op1's own columns
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(None, 1), (3, None), (4, 1)], "doc_id long, quality int")
    out = quality.quality_scores(docs, labels).toPandas().set_index("doc_id")
    assert len(out) == 602 and out.score.between(0, 1).all()
    assert all(out.held_out[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in out.index)
    held = out[out.held_out & (out.index < 600)]
    assert (held.predicted == [int(i % 3 > 0) for i in held.index]).mean() > 0.95
    assert out.score[1000] == out.score[1001] and (out.predicted == (out.score >= 0.5)).all()
    assert quality.quality_scores(empty(spark), labels).count() == 0
    assert set(quality.quality_scores(docs, labels.limit(0)).select("score").distinct().toPandas().score) == {0.5}


def test_updates_and_scores_like_plain_python(spark):
    """Follow-the-regularised-leader by dictionaries, and a dot product by a loop, over the same features."""
    import math

    r = random.Random(20)
    rows = [(float(r.random() < 0.5), np.array(sorted(r.sample(range(1, 60), r.randrange(0, 12))), np.int64)) for _ in range(120)]
    rows = [(y, s, np.array([r.uniform(0.1, 2) for _ in s])) for y, s in rows]
    alpha, beta, l1, l2, z, n = 0.3, 1.0, 0.02, 0.01, Counter(), Counter()
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(4):
        for y, slots, values in rows:
            x = {0: 1.0, **dict(zip(slots.tolist(), values.tolist()))}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    mine = quality.ftrl(rows)
    assert np.allclose(mine[:60], [weight(i) for i in range(60)]) and not mine[60:].any()
    weights = np.random.default_rng(21).normal(size=1 << quality.BITS).astype(np.float32)
    texts = ["one two two three", "", "Ünï $$$ x", None]
    out = quality.score_quality(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), weights).orderBy("doc_id").collect()
    for row, text in zip(out, texts):
        buf = np.frombuffer((text or "").encode(), np.uint8)
        slots, _, count = quality.ngram_slots(buf, np.array([0, len(buf)]))
        total = float(weights[0]) + sum(float(weights[s]) * quality.SCALE / max(1, len((text or "").split())) for s in slots)
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-5)


def test_quality_scores_are_the_same_in_any_batch(spark, documents):
    documents = documents.drop("score")
    weights = np.random.default_rng(3).normal(size=1 << quality.BITS).astype(np.float32)
    a = quality.score_quality(documents, weights).select("doc_id", "score").toPandas().set_index("doc_id").score
    b = quality.score_quality(documents.repartition(7), weights).select("doc_id", "score").toPandas().set_index("doc_id").score
    assert np.allclose(a, b.loc[a.index])


@pytest.mark.parametrize("k,settings", [(2, {}), (5, {"small": 2, "depth": 3})])
def test_near_documents(spark, texts, documents, k, settings):
    sets = sets_of(texts, k)
    ids = list(texts)
    linked = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    least = components(ids, linked)
    rows = documents.unionByName(documents.where("doc_id = 61")).unionByName(documents.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    out = neardup.near_documents(rows, words=k, **settings).toPandas()
    assert len(out) == len(ids) + 1
    for row in out.itertuples():
        assert (row.n_shingles, row.component_id, row.kept) == (len(sets[row.doc_id]), least[row.doc_id], least[row.doc_id] == row.doc_id)
    assert neardup.near_documents(empty(spark)).count() == 0


def test_keep_first_keeps_columns(spark, documents):
    kept = neardup.keep_first(documents)
    assert kept.columns == documents.columns
    assert {60, 110, 111} <= {r["doc_id"] for r in kept.collect()} and kept.where("doc_id between 90 and 99 and length(text) > 50").count() == 0


def test_keep_first_with_null_and_repeated_ids(spark):
    r = random.Random(11)
    a, b, c, d, e = (prose(r, 100, 9000) for _ in range(5))
    rows = [(None, a, 1), (1, b, 2), (1, b, 3), (1, c, 4), (0, c + " more", 5), (None, d, 6), (9, d, 7), (None, None, 8), (2, "", 9), (None, e, 10), (None, e, 11)]
    for kind in ("long", "string"):
        df = spark.createDataFrame(rows, "doc_id long, text string, tag long").withColumn("doc_id", F.col("doc_id").cast(kind))
        kept = neardup.keep_first(df)
        assert kept.columns == df.columns
        tags = {x["tag"] for x in kept.collect()}
        assert tags - {2, 3, 10, 11} == {1, 5, 7, 8, 9} and len(tags & {2, 3}) == len(tags & {10, 11}) == 1


def test_blocks_pass_on_true_links(spark):
    """Class 2 shares only the upper halves of its hashes with 9, class 3 all of them; both are in one part."""
    shared = [k << 32 for k in range(1, 11)]
    sets = spark.createDataFrame([(2, [x + 5 for x in shared]), (3, shared), (9, shared)], "id long, set array<long>")
    rows = spark.createDataFrame([(7, 2, 2), (7, 3, 2), (7, 9, 9)], "node long, id long, part long")
    nodes = spark.createDataFrame([(7, 3, 1, 2)], "node long, m long, rest long, main long")
    assert [tuple(x) for x in neardup.compared_in_blocks(rows, nodes, sets, 80).collect()] == [(3, 9)]


def test_url_rules(spark):
    pages = [
        (1, "http://A.Example.COM/en/1?x", ""), (2, "https://www.example.com/en/2#f", None), (3, "https://x.www.example.com/en/", ""), (4, "http://example.com", ""),
        (5, "ftp://b.net/es/3", ""), (6, "http://b.net/de/3", ""), (7, None, "<a href='http://q.net/'>"), (8, "no scheme", ""), (9, "http://notexample.com/en/", ""), (9, "http://notexample.com/en/", ""), (10, "://h.net?a/b", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"host": F.lit(1), "rule": F.lit(2)})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(df).collect()}
    assert urls.judge_urls(df).count() == len(pages)
    assert got[1] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[2] == ("www.example.com", "/en/2", "www.example.com/en/", "allow")
    assert got[3][2:] == ("www.example.com/en/", "allow") and got[4] == ("example.com", "", None, "allow")
    assert got[5][2:] == ("net/es/", "block") and got[7][:3] == ("", "", None) and got[8][:3] == ("", "", None)
    assert got[9][2] == "com/" and got[10][:3] == ("h.net", "", None)
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_distrust_follows_links_backwards(spark):
    pages = [(k, f"http://bad.net/es/{k}", "") for k in range(5)] + [(9, "http://feeder.org/a", '<a href="http://bad.net/es/1">'), (10, "http://clean.org/a", '<a href="/b"> <a href="//good.com/">'), (11, "http://good.com/", "")]
    out = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out[9]["verdict"] == "block" and out[10]["verdict"] == "allow"
    # the same by a dense matrix
    hosts = ["bad.net", "feeder.org", "clean.org", "good.com"]
    links = np.array([[0, 0, 0, 0], [1, 0, 0, 0], [0, 0, 1, 1], [0, 0, 0, 0]], float)
    back = links.T
    back = back / np.maximum(back.sum(1, keepdims=True), 1)
    seed = np.array([5.0, 0, 0, 0])
    x = seed
    for _ in range(10):
        x = 0.85 * x @ back + 0.15 * seed
    by_host = {out[i]["host"]: out[i]["distrust"] for i in out}
    assert [by_host[h] for h in hosts] == pytest.approx(x.tolist(), abs=1e-4)


def test_url_query_on_a_linked_graph(spark, tmp_path):
    """Dangling seeds, a small host that links to one, a chain longer than ten hops, links to hosts without pages."""
    from scribe.llm.catalogue import QUERIES

    to = lambda *hosts: " ".join(f'<a href="http://{h}/">' for h in hosts)
    pages = [(f"http://seed.net/es/{k}", "") for k in range(100)] + [("http://seed.net/de/1", "")]  # dangling, 99 % blocked
    pages += [(f"http://alone.net/fr/{k}", "") for k in range(100)] + [("http://alone.net/de/1", "")]  # without any edge
    pages += [(f"http://small.org/{k}", to("seed.net") if k == 0 else "") for k in range(5)]
    pages += [("http://mixed.net/es/1", to("c0.org", "nowhere.org")), ("http://mixed.net/2", to("good.com", "mixed.net")), ("http://good.com/", to("good.com", "mixed.net", "c3.org"))]
    pages += [(f"http://c{k}.org/", to(f"c{k + 1}.org")) for k in range(15)] + [("http://c15.org/", to("mixed.net"))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    out = QUERIES["op3_url_filters"](spark, str(tmp_path)).collect()
    assert len(out) == len(pages)
    by_host = {r["host"]: r for r in out}
    verdict = {r["host"]: r["verdict"] for r in out if r["rule"] is None}
    # by a dense matrix for each seed host, mass at dead ends going back to it
    links = {(h, d) for u, x in pages for h in [u.split("/")[2]] for d in re.findall("http://([^/]*)/", x)}
    weight = Counter((u.split("/")[2], d) for u, x in pages for d in set(re.findall("http://([^/]*)/", x)))
    hosts = sorted({h for e in links for h in e} | set(by_host))
    a = np.array([[weight[s, d] for d in hosts] for s in hosts], float)
    for kind, m, counted in (("trust", a, "com/"), ("distrust", a.T, "net/")):
        score = np.zeros(len(hosts))
        for k, h in enumerate(hosts):
            n = sum(r["host"] == h and (r["rule"] or "").startswith(counted) for r in out)
            one = np.eye(len(hosts))[k]
            walk = np.where(m.sum(1, keepdims=True) > 0, m / np.maximum(m.sum(1, keepdims=True), 1), one)
            score += n * 0.15 * np.linalg.solve(np.eye(len(hosts)) - 0.85 * walk.T, one)
        expected = dict(zip(hosts, score.tolist()))
        assert {h: r[kind] for h, r in by_host.items()} == pytest.approx({h: expected[h] for h in by_host}, abs=1.1e-4)
    assert verdict["seed.net"] == verdict["alone.net"] == verdict["small.org"] == "block"
    assert by_host["c0.org"]["distrust"] > 0 and by_host["c15.org"]["trust"] > 0
    assert by_host["alone.net"]["distrust"] == 100


def repeats_removed(rows, size=100):
    """(bytes, removed, runs, digest of what is left) of each text, in the order given."""
    seen, out = set(), []
    for text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - size + 1):
            if data[k : k + size] in seen:
                gone[k : k + size] = True
            seen.add(data[k : k + size])
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((len(data), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [20000, 7])
def test_suffix_dedup(spark, texts, documents, group, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP", group)
    ids = sorted(texts)
    expected = dict(zip(ids, repeats_removed([texts[i] for i in ids])))
    out = suffixes.remove_repeats(documents.repartition(5)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in out} == expected


def test_suffix_dedup_with_repeated_null_and_text_ids(spark, texts, documents):
    assert suffixes.remove_repeats(empty(spark)).count() == 0
    r = random.Random(13)
    a, b, c = (prose(r, 60, 5000) for _ in range(3))
    rows = [("x", a + " " + b), ("x", a + " " + b), ("x", b + " " + c), ("w", c), (None, a), (None, a), ("z", None), ("y", "")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    order = {t: h for t, h in df.select("text", F.xxhash64("text")).distinct().collect()}
    first, second = sorted([a + " " + b, b + " " + c], key=order.get)
    expected = dict(zip([("w", c), ("x", first), ("x", second), ("y", ""), ("z", None)], repeats_removed([c, first, second, "", None])))
    out = Counter(tuple(x) for x in suffixes.remove_repeats(df).collect())
    none = (None, len(a.encode()), 0, 0, hashlib.sha256(a.encode()).hexdigest())
    assert out == Counter([(i, *expected[i, t]) for i, t in rows if i] + [none, none])


def test_phrases_are_prefix_free_and_hold_each_string_once():
    r = np.random.default_rng(14)
    texts = ["".join(r.choice(list("ab "), int(n))) for n in r.integers(0, 900, 40)] + ["ab" * 300, "x" * 400, "short"]
    data = [t.encode() for t in texts]
    buf, offsets = np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(d) for d in data])]
    low, high, doc, _ = suffixes.phrases_of(buf, offsets, 100)
    starts = sorted(int(s) for a, b in zip(low, high) for s in range(a, b + 1))
    assert starts == [s for i in range(len(data)) for s in range(offsets[i], offsets[i + 1] - 99)]
    whole = {buf[a : b + 101].tobytes() for a, b, d in zip(low, high, doc) if b + 101 <= offsets[d + 1]}
    assert not any(x != y and y.startswith(x) for x in whole for y in whole)


@pytest.mark.parametrize("block", [512, 16])
def test_near_vectors(spark, block):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, 16))
    x = np.concatenate([base, base[:40] + rng.normal(size=(40, 16)) * 0.08, np.repeat(base[:1], 30, 0) + rng.normal(size=(30, 16)) * 0.05, base[5:9]]).astype(np.float32)
    label = rng.integers(0, 2, len(x))
    label[160:190] = label[0]
    rows = [(i, [float(v) for v in r], int(y)) for i, (r, y) in enumerate(zip(x, label))]
    odd = [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] + [1.0] * 15, 1), (503, [None] + [1.0] * 15, 1), (504, rows[0][1], None), (505, [], 0), (506, [1.0] * 3, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumns({"links": F.lit(0), "list": F.lit("x")})
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)
    least = components(range(len(x)), list(zip(*np.nonzero(linked))))
    out = embeddings.near_vectors(df, block=block, per_list=20).toPandas().set_index("vec_id")
    assert len(out) == len(rows) + len(odd)
    assert (out.n_links.loc[: len(x) - 1].sort_index() == linked.sum(1)).all()
    assert all(out.component_id[i] == least[i] for i in range(len(x)))
    assert (out.loc[500:].n_links == 0).all() and out.loc[500:].kept.all()
    assert embeddings.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("settings", [{"per_list": 4, "centres": 5, "block": 64}, {}])
def test_near_vectors_of_several_lengths_and_many_lists(spark, settings):
    """Rare lengths link as common ones do; lists of two levels lose no link near the threshold."""
    rng = np.random.default_rng(19)
    rows, vectors = [], []
    for dims, n in ((8, 40), (3, 6), (32, 500), (1, 3)):
        base = rng.normal(size=(n, dims))
        near = base[: n // 2] + rng.normal(size=(n // 2, dims)) * 0.36 * np.linalg.norm(base[: n // 2], axis=1, keepdims=True) / np.sqrt(dims)
        vectors += [*base, *near]
    rows = [(i, [float(v) for v in x], int(i % 2)) for i, x in enumerate(vectors)]
    out = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), **settings).toPandas().set_index("vec_id")
    linked = [(i, j) for i, x in enumerate(vectors) for j, y in enumerate(vectors) if i != j and i % 2 == j % 2 and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93]
    n, least = Counter(i for i, _ in linked), components(range(len(rows)), linked)
    assert {len(vectors[i]) for i, _ in linked} == {1, 3, 8, 32}
    assert all((out.n_links[i], out.component_id[i]) == (n[i], least[i]) for i in range(len(rows)))


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", r"<\s> <\\/s> [\INST] [/INST", "[SEP]x<s>", "", None, "é\n[INST]", "<", "[", "\\"]
    rows = [(1, t, "user" if t % 2 else "assistant", s) for t, s in enumerate(odd)] + [(2, 0, "assistant", "a"), (2, 1, "assistant", "[SEP]"), (2, 2, None, "<"), (2, 2, "[/INST] x", "y"), (3, 5, "user", "same"), (3, 5, "user", "same"), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    chats = chat.format_chats(df)
    for r in chats.select("conv_id", "formatted", "n_blocks", chat.read_turns(F.col("formatted")).alias("turns")).collect():
        want = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == r["conv_id"]))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [w[1:] for w in want]
        assert r["n_blocks"] == 1 + sum(a[1] != b[1] for a, b in zip(want, want[1:]))
    digest = {r["conv_id"]: r for r in chat.chat_digest(chats).collect()}
    assert digest[2]["loss_sha256"] == hashlib.sha256(b"a[SEP]").hexdigest() and digest[2]["loss_chars"] == 6
    assert digest[2]["turns_sha256"] == hashlib.sha256("assistant\na\nassistant\n[SEP]\n\n<\n[/INST] x\ny\n".encode()).hexdigest()
    assert chat.format_chats(df.limit(0)).count() == 0


def test_repetition_rules(spark, texts, documents):
    out = repetition.quality_rules(documents).toPandas().set_index("doc_id")
    for i, t in texts.items():
        t = t or ""
        w = WORD.findall(t)

        def cover(k, w=w):
            c, hit = Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)), [False] * len(w)
            for j in range(len(w) - k + 1):
                if c[tuple(w[j : j + k])] > 1:
                    hit[j : j + k] = [True] * k
            return sum(hit)

        seen, lines = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                lines += line in seen
                seen.add(line)
        got = out.loc[i]
        assert tuple(got[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words"]]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), lines, cover(3), cover(10))
        assert got.base_failed == (len(w) < 50 or 100 * cover(3) > 50 * len(w)) and not (got.base_failed and got.kept)
    assert not out.kept[113] and not out.kept[114]
    assert repetition.quality_rules(empty(spark)).count() == 0


def test_repeats_act_beyond_the_base_rules(spark):
    fresh = iter(range(10**6))
    new = lambda n: " ".join(f"u{next(fresh)}" for _ in range(n))
    block, long, line, passage = new(60), new(1000), new(10), new(101)
    bad = {
        1: " ".join([new(70), block, new(75), block, new(75), block]),  # 45 % covered
        2: " ".join([new(5000), long, new(5000), long]),  # under a fifth covered, a repeat of 1,000 words
        3: " ".join([passage, new(3000), passage]),
        4: " ".join([line, new(70), line]),  # 22 % covered
    }
    clean = {
        11: new(500),
        12: " ".join([line, new(100), line]),  # 17 % covered
        13: " ".join([new(600), block, new(600), block]),  # 9 % covered, within 100 words
        14: " ".join([line[: line.rindex(" ")], new(30), line[: line.rindex(" ")], new(20)]),  # nine words are no repeat
    }
    rows = spark.createDataFrame([*bad.items(), *clean.items()], "doc_id long, text string")
    out = {r["doc_id"]: r for r in repetition.quality_rules(rows).collect()}
    assert not any(r["base_failed"] for r in out.values())
    assert {i for i, r in out.items() if r["kept"]} == set(clean)


def test_longest_repeats_by_brute_force():
    r = np.random.default_rng(6)
    for _ in range(30):
        n = int(r.integers(1, 60))
        token, doc = r.integers(0, 3, n).astype(np.uint64), np.sort(r.integers(0, 3, n))
        expected = []
        for i in range(n):
            best = 0
            for j in range(n):
                k = 0
                while i != j and doc[i] == doc[j] and i + k < n and j + k < n and doc[i + k] == doc[i] and doc[j + k] == doc[j] and token[i + k] == token[j + k]:
                    k += 1
                best = max(best, k)
            expected.append(best)
        assert repetition.longest_repeats(token, doc).tolist() == expected


def test_mixing(spark, texts, documents):
    out = mixing.mix_digest(mixing.mix(documents)).toPandas()
    size = {i: len(WORD.findall(t or "")) for i, t in texts.items()}
    assert len(out) == len(texts) and all(r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size for r in out[["doc_id", "size", "taken"]].itertuples(index=False) for r in [r])
    by = out.assign(source=out.source.fillna("~")).groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-6 and (abs(by.taken - by.target) <= 3 * 64 + 0.02 * by.target).all()
    again = mixing.mix_digest(mixing.mix(documents.repartition(3))).toPandas()
    assert out.set_index("doc_id").taken.sort_index().equals(again.set_index("doc_id").taken.sort_index())
    mixed = mixing.mixed_documents(documents)
    assert mixed.columns == documents.columns
    words = Counter()
    for r in mixed.collect():
        w = WORD.findall(r["text"])
        words[r["doc_id"]] += len(w)
        assert not Counter(w) - Counter(WORD.findall(texts[r["doc_id"]] or "")) and r["n_chars"] == len(r["text"])
    assert all(words[i] == t for i, t in zip(out.doc_id, out.taken))
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0
    # ids that repeat
    assert mixing.mix(documents.unionByName(documents)).count() == 2 * len(texts)


def test_mixing_draws_shards_and_permutes_blocks(spark):
    """Numbers go to each block once a pass, in no regular order; shards get what the digest says."""
    for blocks in (1, 2, 3, 5, 17, 64, 1000):
        rows = spark.range(2 * blocks).select(F.lit("s").alias("source"), F.col("id").alias("number"), F.lit(blocks).cast("long").alias("blocks"))
        got = {r["number"]: r["index"] for r in mixing.permuted(rows, 7).collect()}
        assert sorted(got[i] for i in range(blocks)) == sorted(got[i] for i in range(blocks, 2 * blocks)) == list(range(blocks))
        steps = Counter((got[i + 1] - got[i]) % blocks for i in range(blocks - 1))
        assert blocks < 1000 or max(steps.values()) < 8 and [got[i] for i in range(blocks)] != [got[i] for i in range(blocks, 2 * blocks)]
    r = random.Random(15)
    docs = spark.createDataFrame([(i, prose(r, 500), f"s{i % 2}") for i in range(300)], "doc_id long, text string, source string")
    digest = mixing.mix_digest(mixing.mix(docs)).collect()
    words = Counter()
    for x in digest:
        parts = [tuple(map(int, y.split(":"))) for y in x["shards"].split(",") if y]
        assert sum(n for _, n in parts) == x["taken"] and len({k for k, _ in parts}) == len(parts)
        words.update({(k, x["source"]): n for k, n in parts})
    out = mixing.mixed_shards(docs).groupBy("shard", "source").agg(F.sum("words").alias("n"), F.sum(mixing.word_count(F.col("text"))).alias("counted")).collect()
    assert {(x["shard"], x["source"]): x["n"] for x in out} == words and all(x["n"] == x["counted"] for x in out)
    # multinomial: counts vary as they should around slots / shards
    for source in ("s0", "s1"):
        per = np.array([words[k, source] / 64 for k in range(64)])
        assert 0.5 * per.mean() < per.var() < 2 * per.mean()


def test_mixed_documents_with_clashing_names_null_and_repeated_ids(spark):
    r = random.Random(16)
    full = prose(r, 700)
    rows = [(1, "", "a", 10), (1, full, "a", 11), (None, full, "a", 12), (None, None, None, 13), (2, "word " * 128, None, 14)]
    names = ("size", "spans", "nth", "row", "words", "copy", "turn", "_row", "index", "k")
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, tag long").select("*", *[F.concat(F.lit(n), "tag").alias(n) for n in names])
    mixed = mixing.mixed_documents(df, share=2.0)
    assert mixed.columns == df.columns
    got = mixed.collect()
    assert {x["tag"] for x in got} == {11, 12, 14} and all(x[n] == f"{n}{x['tag']}" for x in got for n in names)
    assert Counter(x["tag"] for x in got) == {11: 2, 12: 2, 14: 2} and all(x["text"].split() == full.split() for x in got if x["tag"] < 13)
    assert mixing.mixed_documents(df.limit(0)).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, said):
    digits = re.sub("[^0-9]", "", said)
    if kind == "ip":
        return all(int(p) <= 255 for p in said.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_pii_base_by_plain_patterns(spark):
    r = random.Random(7)
    pieces = ["a.b@c.d", "@", "x@y", "a@b.c@d.e", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "1234567890123456", "+1 (555) 010-9999", "+1((", "+123456789012345678", "é", " ", "\n", "7", ".", "-", "+", "0012.003.4.5", "%+-@a-b.c"]
    rows = [(i, "".join(r.choice(pieces) for _ in range(r.randrange(30)))) for i in range(300)] + [(900, None), (901, ""), (902, "1" * 20000), (903, "a" * 50000 + "@b.c"), (904, "+1" + "(" * 20000)]
    out = {x["doc_id"]: x for x in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(1))).collect()}
    for i, t in rows:
        spans = [(k, m.start(), m.end()) for k, p in PATTERNS.items() if i not in (902, 903) or k in ("phone",) for m in re.finditer(p, t or "") if passes(k, m[0])]
        if i == 903:
            spans = [("email", 0, 50004)]
        assert out[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest(), (i, t)
        assert out[i]["n_email"] == sum(k == "email" for k, _, _ in spans) and out[i]["spans"].startswith(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
    assert pii.find_pii(empty(spark)).count() == 0


def test_pii_adds_what_several_labelers_support(spark):
    clean = [(i, f"order number {i}-12-{1000 + i} of version 1.2 and 12 apples") for i in range(200)]
    private = [(1000 + i, f"please call my phone 555-{200 + i}-{4000 + i} today, ssn 123-45-{6000 + i} ok") for i in range(150)]
    docs = spark.createDataFrame(clean + private, "doc_id long, text string")
    out = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs).collect()}
    assert all("phone_local:" in out[i] and "ssn:" in out[i] for i, _ in private) and not any(out[i] for i, _ in clean)
    red = {r["doc_id"]: r["text"] for r in pii.redact(docs.withColumn("n_chars", F.length("text").cast("long"))).collect()}
    assert red[1000] == "please call my phone <phone_local> today, ssn <ssn> ok" and red[0] == clean[0][1]


def test_pii_finds_secrets_and_leaves_clean_texts_alone(spark):
    r = random.Random(17)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    private = {i: f'{prose(r, 20)} token = "{hexes(40)}" {prose(r, 20)}' for i in range(80)} | {i: f"{prose(r, 9)} password: {hexes(6)}Z{i} {prose(r, 9)}" for i in range(80, 120)}
    clean = {1000 + i: f"{prose(r, 30)} order {r.randrange(10**15, 10**16)} in build-2019-release-{i} of {'abcdefgh' * 4} {prose(r, 9)}" for i in range(200)}
    docs = spark.createDataFrame([*private.items(), *clean.items(), (5000, None), (5001, "")], "doc_id long, text string")
    out = {x["doc_id"]: x for x in pii.find_pii(docs).collect()}
    base = {i: sum(out[i][f"n_{k}"] for k in pii.KINDS) for i in out}
    for i, text in private.items():
        found = [x.split(":") for x in out[i]["spans"].split(",")]
        assert out[i]["n_spans"] == base[i] + 1 and any(k == "secret" and re.search(rf'(token = "|password: ){re.escape(text[int(a) : int(b)])}["\s]', text) for k, a, b in found)
    assert all(out[i]["n_spans"] == base[i] for i in [*clean, 5000, 5001])


def test_pii_classifier_accepts_what_no_labeler_decides(spark):
    """Every labeler abstains on the last span; its characters and the word before it are those of the others' secrets."""
    r = random.Random(18)
    code = lambda: "".join(r.sample("abcdef23", 8)) + "".join(r.sample("abcdef23", 8))
    rows = [(i, f"my wachtwoord token {code()} there") for i in range(150)] + [(1000 + i, f"see revision build-of-{r.randrange(10**6)}-commit-notes here") for i in range(150)]
    silent = "my wachtwoord 23abcdef32fedcba there"
    ((kind, start, end, strict),) = pii.loose(silent, pii.matches(silent))
    assert (np.array([pii.votes(silent, kind, start, end, strict)]) // 3 ** np.arange(len(pii.LABELERS)) % 3 == 1).all()
    out = {x["doc_id"]: x["spans"] for x in pii.find_pii(spark.createDataFrame([*rows, (5000, silent)], "doc_id long, text string")).collect()}
    assert out[5000] == f"secret:{start}:{end}" and not any(out[i] for i in range(1000, 1150))


def test_packing(spark, texts, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = packing.pack(documents).toPandas()
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        mine = out[out.doc_id == i].sort_values("start")
        assert (mine.doc_tokens == len(ids)).all() and mine.start.tolist() == np.r_[0, np.cumsum(mine.length)[:-1]].tolist() and mine.length.sum() == len(ids)
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(mine.start, mine.length)] == mine.ids_crc32.tolist()
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == np.r_[0, np.cumsum(g.length)[:-1]].tolist() and g.length.sum() <= 2048
    assert packing.pack(empty(spark)).count() == 0


def test_packing_finds_the_added_token_in_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert tokenizer.encode("end of one <|endoftext|> start", add_special_tokens=False).ids == [437, 286, 530, 220, 50256, 923]
    r = random.Random(10)
    parts = ["<|endoftext|>", "<|endoftext|>", "<|endoftext", "|>", "<|", "<|ENDOFTEXT|>", " ", "  ", "\n", "\t ", "word", " it's", "12", "é", "漢字", "🙂", "...", "\u00a0", "e\u0301"]
    rows = [(0, "end of one <|endoftext|> start"), (1, "<|endoftext|>"), (2, "<|endoftext|>" * 3000)] + [(i, "".join(r.choice(parts) for _ in range(r.randrange(40)))) for i in range(3, 400)]
    out = {i: g.sort_values("start") for i, g in packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().groupby("doc_id")}
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert (out[i].doc_tokens == len(ids)).all() and out[i].length.sum() == len(ids)
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(out[i].start, out[i].length)] == out[i].ids_crc32.tolist()


def test_cutting_patterns_meet_the_demand():
    r = np.random.default_rng(8)
    for n in (1, 3, 40, 5000):
        sizes, demand = np.unique(r.integers(1, 257, n), return_counts=True)
        plan = packing.cutting_patterns(sizes, demand.astype(float), 256)
        assert sum(c * k for c, k in plan).tolist() == demand.tolist() and all((c @ sizes) <= 256 for c, _ in plan)
        if n == 5000:
            assert sum(k for _, k in plan) <= 1.01 * np.ceil(sizes @ demand / 256)


def test_columns_that_enter_save_sequences():
    """The same code with the loop switched off keeps the patterns of one size and the fill of what they leave."""
    r = np.random.default_rng(12)
    sizes, demand = np.unique(np.clip(r.lognormal(4.6, 0.9, 20000).astype(int), 1, 512), return_counts=True)
    n = {rounds: sum(k for _, k in packing.cutting_patterns(sizes, demand.astype(float), 512, rounds=rounds)) for rounds in (0, 300, None)}
    bound = int(np.ceil(sizes @ demand / 512))
    assert bound <= n[None] < n[300] < n[0] and n[0] > 1.15 * bound and n[None] <= 1.03 * bound


def tables(spark, path, docs, labels):
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline_with_clashing_columns_null_and_repeated_ids(spark, tmp_path):
    from scribe.llm import pipeline

    r = random.Random(22)
    a, b, c = (prose(r, 200, 4000) for _ in range(3))
    rows = [(None, a, "s0", 1), (None, b, "s0", 2), (5, c, None, 3), (5, c, None, 4), (6, None, "s1", 5), (7, "", "s1", 6), (8, a + " more", "s1", 7)]
    names = ("score", "size", "nth", "spans", "kept_id", "row", "_row", "component_id", "words", "found", "id")
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tag long").select("*", *[F.concat(F.lit(n), "tag").alias(n) for n in names])
    where = tables(spark, tmp_path, docs, spark.createDataFrame([(5, 1), (8, 1), (6, 1)], "doc_id long, quality int"))
    now, tags = docs, {}
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, now, where).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        got = now.collect()
        assert now.columns == docs.columns and all(x[n] == f"{n}{x['tag']}" for x in got for n in names)
        tags[name] = Counter(x["tag"] for x in got)
    assert set(tags["quality"]) == {1, 2, 3, 4, 5, 6, 7}
    assert set(tags["near_dedup"]) - {3, 4} == {2, 5, 6, 7} and len(set(tags["near_dedup"]) & {3, 4}) == 1  # 1 is a near copy of 7, whose id is not null
    assert tags["pii"] == tags["near_dedup"] and set(tags["mixing"]) == set(tags["pii"]) - {5, 6}
    assert pipeline.STAGES[-1][1](spark, now, where).count() >= len(now.collect())


def test_pipeline_keeps_what_it_should(spark, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "none", docs=empty(spark), labels=empty(spark).selectExpr("doc_id", "1 as quality"))).count() == 0
    r = random.Random(9)
    rows = [(i, prose(r, 120, 3000) if i % 4 else " ".join(w + "%%%" for w in prose(r, 120).split()), "en", f"s{i % 2}") for i in range(240)]
    rows += [(300 + k, rows[1][1].replace(" w", " w", 1) + (" end" if k else ""), "en", "s0") for k in range(3)] + [(400, "write to a.b@c.de now " + prose(r, 90, 3000), "en", "s1"), (401, None, None, None)]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], DOC)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names, at = [n for n, _ in corpus_pipeline.STAGES], {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = at[name] = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == names[-1] or now.columns == docs.columns
    good = {x["doc_id"] for x in at["quality"].collect()}
    assert not {i for i in range(0, 240, 4)} & good and {i for i in range(240) if i % 4} <= good
    kept = {x["doc_id"] for x in at["near_dedup"].collect()}
    assert 1 in kept and not kept & {300, 301, 302} and 400 in kept
    assert at["pii"].where("doc_id = 400 and text like 'write to <email> now%'").count() == 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at["packing"].count()
