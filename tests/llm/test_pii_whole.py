"""Personal data: whole secrets, many candidates in one text, and the label model and classifier against plain Python."""

import math
import random
import time

import numpy as np

from scribe.llm import packing, pii


def test_secrets_are_whole_whatever_their_length():
    r = random.Random(4)
    value = "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789.$!/") for _ in range(5000))
    hexed = "".join(r.choice("0123456789abcdef") for _ in range(6000))
    for text, secret in ((f"password = {value} and more", value), (f'token="{hexed}" x', hexed), (f"see {hexed}.", hexed)):
        (kind, start, end, _), *rest = pii.loose(text, [])
        assert (kind, text[start:end]) == ("secret", secret) and not rest
    local = "name." * 2000 + "x"
    text = f"write to {local} [at] {'sub [dot] ' * 50}example [dot] com now"
    assert [(k, text[a:b]) for k, a, b, _ in pii.loose(text, [])] == [("email_spelled", text[9:-4])]


def test_redaction_leaves_nothing_of_a_long_secret(spark):
    r = random.Random(5)
    rows = [(i, f'config {i}: token = "{"".join(r.choice("0123456789abcdef") for _ in range(r.choice([40, 150, 3000])))}" end of it', "en") for i in range(120)]
    rows += [(i, "plain words without anything to hide in them", "en") for i in range(120, 200)]
    out = {x["doc_id"]: x["text"] for x in pii.redact(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i] == f'config {i}: token = "<secret>" end of it' for i in range(120)) and all(out[i] == t for i, t, _ in rows[120:])


def test_a_hundred_thousand_candidates_take_seconds():
    text = " ".join(f"call {200 + i % 700}-{200 + i % 600}-{1000 + i % 9000}" for i in range(100_000))
    began = time.process_time()
    assert len(pii.loose(text, pii.matches(text))) == 100_000
    assert time.process_time() - began < 20
    for text in ("a" * 300_000, "1-" * 150_000, "x.y" * 100_000 + " (at) ", "token=" * 50_000, "a1/" * 100_000):
        began = time.process_time()
        pii.loose(text, pii.matches(text))
        assert time.process_time() - began < 10


def test_touching_candidates_come_once():
    text = "reach me at 415-555-0123 or token: 415-555-0199aaaa1111bbbb"
    spans = sorted((a, b) for _, a, b, _ in pii.loose(text, []))
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    base = [("card", 12, 24, True), ("phone", 12, 30, True)]
    assert all(b <= 12 or a >= 30 for _, a, b, _ in pii.loose(text, base))


def plain_model(patterns, counts, known, rounds):
    """Expectation-maximisation by loops over candidates' patterns and labelers."""
    p = [k if k is not None else 1 / (1 + math.exp(-sum(v - 1 for v in x))) for x, k in zip(patterns, known)]
    for _ in range(rounds):
        tables = []
        for j in range(len(patterns[0])):
            yes, no = [1.0] * 3, [1.0] * 3
            for x, n, q in zip(patterns, counts, p):
                yes[x[j]] += n * q
                no[x[j]] += n * (1 - q)
            yes = [v / sum(yes) + w for v, w in zip(yes, (0.01, 0.03, 0.06))]
            no = [v / sum(no) + w for v, w in zip(no, (0.06, 0.03, 0.01))]
            yes, no = [v / sum(yes) for v in yes], [v / sum(no) for v in no]
            if yes[2] * no[0] < yes[0] * no[2]:
                yes = no = [(a + b) / 2 for a, b in zip(yes, no)]
            tables.append((yes, no))
        for i, x in enumerate(patterns):
            if known[i] is None:
                odds = sum(math.log(yes[v]) - math.log(no[v]) for v, (yes, no) in zip(x, tables))
                p[i] = 1 / (1 + math.exp(-odds))
    return p


def test_label_model_like_plain_python():
    r = random.Random(7)
    patterns = sorted({tuple(r.choice([0, 1, 1, 2]) for _ in pii.LABELERS) for _ in range(60)})
    counts = [r.randrange(1, 400) for _ in patterns]
    known = [r.choice([None, None, 0.0, 1.0]) for _ in patterns]
    for rounds in (1, 2, 50):
        got = pii.expectation_maximisation(np.array(patterns), np.array(counts, float), np.array([np.nan if k is None else k for k in known]), rounds)
        assert np.allclose(got, plain_model(patterns, counts, known, rounds), atol=1e-9)


def plain_classifier(slots, p, rounds, rate, l2):
    """Logistic regression with per-weight rates on dictionaries."""
    w, h = {}, {}
    for _ in range(rounds):
        g = {k: l2 * v for k, v in w.items()}
        for own, q in zip(slots, p):
            at = [*own, pii.SLOTS]
            value = 1 / math.sqrt(len(at))
            score = 1 / (1 + math.exp(-max(-30, min(30, sum(w.get(k, 0.0) for k in at) * value))))
            for k in at:
                g[k] = g.get(k, 0.0) + (score - q) * value / len(slots)
        for k, v in g.items():
            h[k] = h.get(k, 1e-8) + v * v
            w[k] = w.get(k, 0.0) - rate * v / math.sqrt(h[k])
    return w


def test_span_classifier_like_plain_python():
    r = random.Random(8)
    slots = [sorted(r.sample(range(200), r.randrange(1, 9))) for _ in range(80)]
    p = [min(1.0, max(0.0, sum(s % 3 == 0 for s in x) / len(x))) for x in slots]
    w, plain = pii.span_classifier(slots, np.array(p), 40, 0.5, 1e-4), plain_classifier(slots, p, 40, 0.5, 1e-4)
    assert all(abs(w[k] - v) < 1e-6 for k, v in plain.items()) and np.count_nonzero(w) <= len(plain)
    for own in slots:
        at = [*own, pii.SLOTS]
        assert abs(pii.span_score(w, own) - 1 / (1 + math.exp(-sum(plain[k] for k in at) / math.sqrt(len(at))))) < 1e-6


def test_equal_empty_rows_are_dealt_out(spark):
    rows = spark.range(50_000).selectExpr("cast(null as long) as doc_id", "'' as text")
    got = packing.pack(rows, length=64, unit=1)
    assert got.count() == 50_000 and got.where("length <> 1 or padded <> 64").count() == 50_000 - got.where("length = 1 and padded = 64").count()
    most = got.groupBy("sequence_id").count().agg({"count": "max"}).first()[0]
    assert most == 64 and got.select("sequence_id", "offset").distinct().count() == 50_000
