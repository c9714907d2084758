"""The library's operators on small literal cases."""

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scribe import catalogue, catalogue_files, catalogue_rows, catalogue_state  # noqa: F401
from scribe.functions import distance, geometry, scoring, sweep, text
from scribe.operators import contrastive, corpus, latency, layout, metrics, runs, sequence
from scribe.plans import prepare, recognise, reports
from scribe.sources import images, labels, manifests, store
from scribe.streaming import jobs

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def texts(spark, rows, *names):
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def test_edit_distances(spark):
    rows = [("kitten", "sitting", 3), ("", "", 0), ("abc", "", 3), ("", "abc", 3), ("same", "same", 0), ("ab", "ba", 2)]
    for a, b, n in rows:
        assert one(spark, scoring.char_edits(F.lit(a), F.lit(b))) == n
    assert one(spark, scoring.cer(F.lit("hello"), F.lit("hallo"))) == pytest.approx(0.2)
    assert one(spark, scoring.cer(F.lit("a"), F.lit("abcde"))) == 4.0
    assert one(spark, scoring.cer(F.lit(""), F.lit(""))) == 0 and one(spark, scoring.cer(F.lit(""), F.lit("text"))) == 1
    assert one(spark, scoring.wer(F.lit("the quick brown fox"), F.lit("the quick brown dog"))) == 0.25


def test_word_edits_like_a_plain_table(spark):
    r = random.Random(1)
    rows = [(" ".join(r.choice("abcde") for _ in range(r.randrange(8))), " ".join(r.choice("abcde") for _ in range(r.randrange(8)))) for _ in range(80)]

    def plain(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            p, d[0] = d[0], i + 1
            for j, y in enumerate(b):
                p, d[j + 1] = d[j + 1], min(d[j + 1] + 1, d[j] + 1, p + (x != y))
        return d[-1]

    got = texts(spark, rows, "a", "b").select("a", "b", scoring.word_edits(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(g["n"] == plain(g["a"].split(), g["b"].split()) for g in got)


def plain_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        p, d[0] = d[0], i + 1
        for j, y in enumerate(b):
            p, d[j + 1] = d[j + 1], min(d[j + 1] + 1, d[j] + 1, p + (x != y))
    return d[-1]


def test_alike_pairs_are_followed_along_diagonals():
    """Each way of weighing gives the plain distance, also of runs, periods, empty sides and items beyond one byte."""
    r, many = random.Random(11), []
    for k in range(300):
        a = "".join(r.choice("ab"[: 1 + k % 2] + "c\U0001f600") for _ in range(r.randrange(0, 90)))
        b = "".join(r.choice(["", x, x, x, x, x + "d"]) for x in a) if k % 3 else a[r.randrange(0, 5) :] + a[:3]
        many += [(a, b), (b, a)]
    words = [([f"w{r.randrange(400)}" for _ in range(60)], [f"w{r.randrange(400)}" for _ in range(50)]) for _ in range(20)]
    long = "".join(r.choice("abcdefgh ") for _ in range(40_000))
    for pairs_ in (many, words + [(a, a[:20] + ["new"] + a[21:]) for a, _ in words]):
        assert distance.similar_distances(list(pairs_)) == [plain_distance(a, b) for a, b in pairs_]
        for spare in (0, 3, 200):
            ordered = [(a, b) if len(a) >= len(b) else (b, a) for a, b in pairs_ if len(a) and len(b)]
            want = [d if d - len(a) + len(b) <= spare else -1 for a, b in ordered for d in [plain_distance(a, b)]]
            assert distance._along_diagonals(ordered, spare) == want
    # 40,000 characters and a few edits: a few rounds, where a table by columns takes seconds
    began = time.perf_counter()
    assert distance.similar_distances([(long, long[:9] + "X" + long[10:20_000] + long[20_003:] + "Y")]) == [5]
    assert time.perf_counter() - began < 0.5


def test_scoring_rows_are_dealt_to_all_cores(spark):
    """One row group of documents must not be one task."""
    assert catalogue.whole_texts(spark, SF).rdd.getNumPartitions() >= 8 and catalogue.scoring_pairs(spark, SF).rdd.getNumPartitions() >= 8


def test_edit_distance_of_long_texts(spark):
    r = random.Random(2)
    for _ in range(1500):
        a, b = ("".join(r.choice("aéß ") for _ in range(r.randrange(40))) for _ in range(2))
        if r.random() < 0.4:
            b = a[: r.randrange(len(a) + 1)] + b[:4] + a[r.randrange(len(a) + 1) :]
        for strip in (1, 3, 7, 64):
            assert distance.edit_distance(a, b, strip) == plain_distance(a, b)
    many = []
    for _ in range(900):
        a, b = ("".join(r.choice("abé ") for _ in range(r.choice([0, 1, 5, 30, 63, 64, 65, 200]))) for _ in range(2))
        many.append((a, b if r.random() < 0.5 else a[3:50] + "x" + a[60:]))
    many += [("a" * 3000 + "b", "a" * 1500 + "c" * 20), ([1, 2, 3] * 40, [3, 2, 1] * 50)]
    assert distance.edit_distances(many) == [distance.edit_distance(a, b) for a, b in many]
    words = [f"w{i}" for i in range(60_000)]  # more distinct words than there are letters to stand for them
    changed = [w for i, w in enumerate(words) if i % 20_000 != 7] + ["end"]
    assert distance.edit_distance(words, changed) == 4
    long = "".join(r.choice("abcdé ") for _ in range(3000))
    other = long[:500] + "x" + long[520:2000] + long[2001:]
    row = texts(spark, [(long, other), (None, "a"), ("", "b")], "a", "b").select(scoring.char_edits(F.col("a"), F.col("b")).alias("c"), scoring.word_edits(F.col("a"), F.col("b")).alias("w")).collect()
    assert row[0]["c"] == plain_distance(long, other) and row[0]["w"] == plain_distance(long.split(), other.split())
    assert (row[1]["c"], row[1]["w"]) == (None, None) and (row[2]["c"], row[2]["w"]) == (1, 1)


def test_whole_texts_like_a_plain_table(spark):
    kept = catalogue.whole_texts(spark, SF).where("length(reference) < 1500")
    got = metrics.sample_metrics(kept).collect()
    clean = lambda t: "".join(c for c in t.lower() if c.isascii() and c.isalnum())
    assert len(got) > 50
    for x in got[:60]:
        a, b = x["reference"], x["prediction"]
        assert x["char_edits"] == plain_distance(a, b) and x["word_edits"] == plain_distance(a.split(), b.split()) and x["norm_edits"] == plain_distance(clean(a), clean(b))
    assert any(not x["reference"].isascii() and x["char_edits"] for x in got)


def pairs(spark, rows):
    return texts(spark, rows, "reference", "prediction").withColumn("sample_id", F.monotonically_increasing_id())


def test_corpus_metrics(spark):
    m = metrics.corpus_metrics(metrics.sample_metrics(pairs(spark, [("hello world", "hello wordl"), ("abc", "abc"), ("Test", "test")]))).first()
    assert (m["total_char_edits"], m["total_ref_chars"], m["wer"]) == (3, 18, 0.5)
    m = metrics.corpus_metrics(metrics.sample_metrics(pairs(spark, [("Hello, World!", "hello world")]))).first()
    assert m["sequence_accuracy"] == 0 and m["sequence_accuracy_normalized"] == 1
    m = metrics.corpus_metrics(metrics.sample_metrics(pairs(spark, [("a" * 100, "a" * 100), ("xy", "zz")]))).first()
    assert m["cer"] == pytest.approx(2 / 102) and m["cer_macro"] == 0.5
    m = metrics.corpus_metrics(metrics.sample_metrics(pairs(spark, [("a", "abcdefgh")]))).first()
    assert m["cer"] > 1 and m["character_accuracy"] == 0
    assert metrics.corpus_metrics(metrics.sample_metrics(pairs(spark, [("  hello   world  ", "hello world")]))).first()["cer"] == 0
    assert metrics.corpus_metrics(metrics.sample_metrics(pairs(spark, [("ﬁne", "fine")]))).first()["cer"] == 0
    none = metrics.corpus_metrics(metrics.sample_metrics(pairs(spark, [("a", "a")]).limit(0))).first()
    assert none["num_samples"] == 0 and none["cer"] == 0
    worst = metrics.worst_samples(metrics.sample_metrics(pairs(spark, [("abcd", "abcd"), ("abcd", "abXd"), ("abcd", "XXXX")])), 1).first()
    assert worst["prediction"] == "XXXX"


def test_pairs_must_match(spark):
    p, r = spark.createDataFrame([(1, "a")], "sample_id int, prediction string"), spark.createDataFrame([(1, "a"), (2, "b")], "sample_id int, reference string")
    assert metrics.pair(p, r.where("sample_id = 1")).count() == 1
    with pytest.raises(Exception, match="do not match"):
        metrics.pair(p, r).collect()


def test_charset(spark):
    assert text.Charset().num_classes == 96
    c = text.Charset("abc")
    assert one(spark, c.unsupported(F.lit("abcd"))) == ["d"] and one(spark, c.encode(F.lit("abdc"))) == [1, 2, 3]
    assert one(spark, c.decode(F.array(*map(F.lit, [1, 0, 2, 9, 3])))) == "abc" and one(spark, c.encoded_length(F.lit("abdc"))) == 3
    assert text.Charset("aAbB", lowercase=True).alphabet == "ab"
    with pytest.raises(ValueError):
        text.Charset("aab")
    with pytest.raises(Exception, match="outside"):
        one(spark, c.encode(F.lit("abd"), strict=True))
    assert corpus.observed_alphabet(texts(spark, [("cab",), ("bac",)], "label")).first()["alphabet"] == "abc"


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("Total 1 , 250 . 00", "Total 1,250.00"), ("USB - C cable 18 . 00", "USB-C cable 18.00"), ("don ' t stop", "don't stop"), ("( aside )", "(aside)"), ("[ ref ]", "[ref]"),
        ("really ?\nTax at 18 % 20 . 12", "really?\nTax at 18% 20.12"), ("Date : 22 March", "Date: 22 March"), ("", ""),
    ],
)
def test_detokenize(spark, raw, expected):
    got = one(spark, text.detokenize(F.lit(raw)))
    assert got == expected and "".join(got.split()) == "".join(raw.split()) and one(spark, text.detokenize(F.lit(raw), "none")) == raw
    with pytest.raises(ValueError):
        text.detokenize(F.lit(raw), "other")


def test_small_text_functions(spark):
    for raw, name in [("report 2026", "report-2026"), ("../../etc/passwd", "etc-passwd"), ("a:b*c?d", "a-b-c-d"), ("", "extracted-text"), ("  ", "extracted-text")]:
        assert one(spark, text.safe_filename(F.lit(raw))) == name
    assert one(spark, text.line_endings(F.lit("a\r\nb\nc"), mark=True)) == "﻿a\r\nb\r\nc"
    assert one(spark, text.sanitise_label(F.lit(" two\t words\n"))) == "two words" and one(spark, text.sanitise_label(F.lit("  "))) is None
    assert one(spark, text.line_image_path(F.lit("a01-000u-00"))) == "lines/a01/a01-000u/a01-000u-00.png"
    assert one(spark, text.clip_label(F.lit("one two three"), most=9)) == "one two" and one(spark, text.clip_label(F.lit("abcdefghijk"), most=5)) == "abcde"
    assert one(spark, scoring.confidence_band(F.lit(0.7))) == "medium" and one(spark, scoring.error_band(F.lit(0.01))) == "good"
    g = one(spark, geometry.line_geometry(F.lit(2000), F.lit(100), 64, 512, compress=False))
    assert (g["natural"], g["scaled"], g["truncated"]) == (1280, 512, True) and g["lost_fraction"] == pytest.approx(0.6)
    assert geometry.time_steps(512) == 127 and geometry.max_label_length(512) == 76 and one(spark, geometry.canvas_width(F.lit(301))) == 304


def test_label_cleaning(spark):
    rows = spark.createDataFrame([(1, "train", "good label"), (2, "train", "UNREADABLE"), (3, "train", None), (4, "train", "x" * 11), (5, "val", "hé"), (6, "val", " "), (7, "val", "ok")], "id int, split string, label string")
    cleaned = corpus.clean_labels(rows, text.Charset(), 10)
    assert {r["id"]: r["reason"] for r in cleaned.collect()} == {1: None, 2: "unreadable", 3: "empty", 4: "too_long", 5: "unsupported_chars", 6: "unreadable", 7: None}
    report = {r["split"]: r for r in corpus.reject_report(cleaned, "split").collect()}
    assert report["train"]["written"] == 1 and report["train"]["total"] == 4 and report["val"]["skipped_unsupported_chars"] == 1
    lenient = {r["id"]: r["reason"] for r in corpus.clean_labels(rows, text.Charset(), 10, strict=False).collect()}
    assert lenient[5] is None


def test_validate_manifest(spark):
    m = texts(spark, [("a", "abc"), ("b", "xyz"), ("c", "x" * 50), ("d", "gone")], "path", "label")
    files = texts(spark, [("a",), ("b",), ("c",)], "path")
    v = corpus.validate_manifest(m, files, text.Charset("xyz"), 10).first()
    assert (v["total"], v["missing"], v["unsupported"], v["too_long"], v["usable"], v["ok"]) == (4, 1, 1, 1, 2, False) and v["missing_examples"] == ["d"]


def test_samples_and_splits(spark):
    rows = spark.range(1000).withColumnRenamed("id", "id")
    parts = {r["split"]: r["count"] for r in corpus.split_by_ratio(rows).groupBy("split").count().collect()}
    assert parts == {"train": 800, "val": 100, "test": 100}
    again = corpus.split_by_ratio(rows.repartition(7))
    assert corpus.split_by_ratio(rows).exceptAll(again).count() == 0
    a = [r["id"] for r in corpus.seeded_subset(rows, 7).collect()]
    assert len(a) == 7 and a == [r["id"] for r in corpus.seeded_subset(rows.repartition(3), 7).collect()]
    with pytest.raises(ValueError):
        corpus.seeded_subset(rows, 0)
    assert corpus.assign_quota(rows.limit(5), 0.5, "y", "n").where("category = 'y'").count() == 2
    assert corpus.carve_validation(rows.limit(4)).where("split = 'val'").count() == 1
    ord_ = rows.withColumnRenamed("id", "ord")
    assert corpus.minibatches(ord_, 32, True).count() == 992 and corpus.minibatches(ord_, 32, False).count() == 1000
    assert corpus.prefix_hold_out(ord_, 32).where("held_out").count() == 50 and corpus.prefix_cap(ord_, 9).count() == 9
    paths = rows.select(F.col("id").cast("string").alias("path"))
    pool = corpus.draw_pool(paths, paths.limit(900), 20)
    assert pool.count() == 20 and corpus.leakage(pool, paths.limit(900)).first()["disjoint"]


def test_manifest_files(spark, folder):
    with open(f"{folder}/a.tsv", "w") as f:
        f.write("# a comment\n\nimages/a.png\ttwo words\tand a tab\nimages/b.png no tab here\n")
    good, bad = manifests.read_manifest(spark, f"{folder}/a.tsv", strict=False)
    assert [(r["path"], r["label"]) for r in good.collect()] == [("images/a.png", "two words\tand a tab")] and bad.count() == 1
    with pytest.raises(manifests.MalformedManifest):
        manifests.read_manifest(spark, f"{folder}/a.tsv")
    manifests.write_manifest(texts(spark, [("x\\y.png", " a  b ")], "path", "label"), f"{folder}/out")
    again, _ = manifests.read_manifest(spark, f"{folder}/out")
    assert [(r["path"], r["label"]) for r in again.collect()] == [("x/y.png", "a b")]
    with pytest.raises(Exception, match="empty"):
        manifests.write_manifest(texts(spark, [("x", "  ")], "path", "label"), f"{folder}/out2")
    manifests.write_info(spark, {"seed": 1}, f"{folder}/info")
    assert manifests.read_info(spark, f"{folder}/info").count() == 1
    manifests.write_unlabeled(texts(spark, [("p1",), ("p2",)], "path"), f"{folder}/un")
    assert manifests.read_unlabeled(spark, f"{folder}/un").count() == 2


def test_label_sources(spark, folder):
    with open(f"{folder}/t.csv", "w") as f:
        f.write("FILENAME,IDENTITY\na.png,ANNA\nb.png,\n")
    assert labels.read_csv_splits(spark, {"train": f"{folder}/t.csv"}).where("label is null").count() == 1
    with open(f"{folder}/lines.txt", "w") as f:
        f.write("# c\na01-000u-00 ok 154 19 408 746 1661 89 A|MOVE|to\na01-000u-01 err 1 1 1 1 1 1 x\nshort line\n")
    got = {(r["label"], r["reason"]) for r in labels.read_line_index(spark, f"{folder}/lines.txt").collect()}
    assert got >= {("A MOVE to", None), ("x", "segmentation_error")} and any(r == "short" for _, r in got)
    with open(f"{folder}/bench.json", "w") as f:
        f.write('{"entries": [{"file": "a.png", "page": 1, "capture": "scan", "lines": ["x", "y"], "text": "x\\ny"}]}')
    assert labels.read_benchmark(spark, f"{folder}/bench.json").first()["lines"] == ["x", "y"]
    import os

    os.makedirs(f"{folder}/runs/r1")
    with open(f"{folder}/runs/r1/history.json", "w") as f:
        f.write('{"run_name": "r1", "epochs": [{"epoch": 1, "val_cer": 0.5, "note": "x", "timestamp": 3}, {"epoch": 2, "val_cer": 0.25}]}')
    os.makedirs(f"{folder}/runs/r2")
    with open(f"{folder}/runs/r2/history.json", "w") as f:
        f.write("not json")
    h = labels.read_histories(spark, f"{folder}/runs/*/history.json")
    assert [(r["run"], r["epoch"], r["metrics"]) for r in h.orderBy("epoch").collect()] == [("r1", 1, {"val_cer": 0.5}), ("r1", 2, {"val_cer": 0.25})]


def png(path, width, height, flat=False):
    import struct
    import zlib

    raw = b"".join(b"\0" + bytes((0 if flat else x * 7 % 256) for x in range(width)) for _ in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, folder):
    png(f"{folder}/good.png", 40, 20)
    png(f"{folder}/tiny.png", 3, 3)
    png(f"{folder}/flat.png", 40, 20, flat=True)
    for name, data in (("bad.png", b"junk"), ("empty.png", b""), ("note.txt", b"x")):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    files = images.discover(spark, [folder])
    assert files.count() == 4  # Spark passes over files without a byte
    decoded = images.decode(spark, folder)
    reasons = {r["origin"].rsplit("/", 1)[1]: r["reason"] for r in images.screen(decoded).collect()}
    assert {k: reasons[k] for k in ("good.png", "tiny.png", "flat.png", "bad.png")} == {"good.png": None, "tiny.png": "too_small", "flat.png": "flat", "bad.png": "undecodable"}
    admitted = {r["path"].rsplit("/", 1)[1]: r["reject_reason"] for r in images.admit(files, decoded).collect()}
    assert admitted["good.png"] is None and admitted["bad.png"] == "undecodable" and "empty.png" not in admitted


def requests(spark):
    t = dt.datetime(2026, 1, 10)
    rows = [(1, t, "m1", "hello", "a.png", 0.9, 10.0, 5, None, None, None, None), (2, t + dt.timedelta(days=1), "m2", "World", "b_%.png", None, 20.0, 5, "World", 0.0, 0.0, True), (3, t - dt.timedelta(days=30), "m1", "x", "c.png", 0.5, 30.0, 1, None, None, None, None)]
    return spark.createDataFrame(rows, "id long, created_at timestamp, model_id string, text string, original_filename string, confidence double, total_ms double, character_count long, ground_truth string, cer double, wer double, exact_match boolean")


def test_history(spark):
    r = requests(spark)
    assert [x["id"] for x in runs.page(r, 0, 2).collect()] == [2, 1] and runs.search(r, text="WOR").count() == 1 and runs.search(r, scored=True).count() == 1
    assert runs.search(r, text="\\").count() == 0 and runs.search(r, model_id="m1").count() == 2
    s = runs.history_statistics(r, F.lit("2026-01-11").cast("timestamp")).first()
    assert (s["total"], s["total_characters"], s["scored"], s["recent"]) == (3, 11, 1, 2) and s["avg_cer"] == 0
    assert runs.history_statistics(r.limit(0), F.current_timestamp()).first()["avg_cer"] is None
    with pytest.raises(runs.NotFound):
        runs.by_id(r, 99)
    t = dt.datetime(2026, 1, 12)
    c = spark.createDataFrame([(1, t, "hallo"), (2, t, "old"), (2, t + dt.timedelta(1), "  ")], "id long, ts timestamp, ground_truth string")
    out = {x["id"]: x for x in runs.apply_corrections(r, c).collect()}
    assert out[1]["cer"] == pytest.approx(0.2) and out[1]["exact_match"] is False and out[2]["ground_truth"] is None and out[2]["cer"] is None and out[3]["cer"] is None
    assert runs.delete_ids(r, spark.createDataFrame([(1,)], "id long"), strict=True).count() == 2
    with pytest.raises(runs.NotFound):
        runs.delete_ids(r, spark.createDataFrame([(9,)], "id long"), strict=True)
    with pytest.raises(ValueError):
        runs.clear_all(r)
    assert runs.clear_all(r, confirm=True)[1] == 3
    kept, summary = runs.retention(r.select(F.col("created_at").alias("modificationTime"), F.col("id").alias("length")), F.lit("2026-01-12").cast("timestamp"), 10)
    assert kept.count() == 2 and summary.first()["freed_bytes"] == 3


def evaluations(spark, rows):
    return spark.createDataFrame([(i, dt.datetime(2026, 1, 1 + i), *r) for i, r in enumerate(rows)], "id int, created_at timestamp, model_id string, provenance string, experiment_arm string, dataset string, split string, num_samples int, cer double, sequence_accuracy double")


def test_comparisons(spark):
    rows = [("c1", "project", "control", "A", "test", 100, 0.4, 0.1), ("t1", "project", "treatment", "A", "test", 90, 0.1, 0.6), ("c2", "project", "control", "B", "test", 300, 0.5, 0.1), ("t2", "project", "treatment", "B", "test", 300, 0.6, 0.2), ("x", "pretrained", "other", "A", "test", 9, 0.01, 0.9)]
    e = evaluations(spark, rows)
    best = reports.build_comparison(e).first()
    assert (best["outcome"], best["control_id"], best["treatment_id"], best["verdict"]) == ("comparable", "c2", "t2", "not improved")
    liked = reports.build_comparison(e, preferred="A").first()
    assert liked["control_id"] == "c1" and liked["absolute"] == pytest.approx(0.3) and liked["relative"] == pytest.approx(0.75)
    assert reports.build_comparison(e.where("experiment_arm <> 'treatment'")).first()["outcome"] == "missing_arm"
    assert reports.build_comparison(e.where("model_id in ('c1', 't2')")).first()["outcome"] == "different_setting"
    assert reports.build_comparison(e.limit(0)).first()["outcome"] == "missing_arm"
    newer = e.unionByName(e.where("model_id = 'c1'").withColumn("id", F.lit(77)).withColumn("cer", F.lit(None).cast("double")))
    assert runs.latest_per_model(newer).where("model_id = 'c1'").first()["id"] == 77
    both = runs.config_diff(texts(spark, [("a", "1"), ("b", "2")], "key", "value"), texts(spark, [("a", "1"), ("b", "3"), ("c", "4")], "key", "value"), ["b"])
    assert {(r["key"], r["allowed"]) for r in both.collect()} == {("b", True), ("c", False)}
    picks = spark.createDataFrame([("m1", 5.0, 0.2, None, "x", 0), ("m2", 5.0, 0.1, None, "x", 1), ("m3", 1.0, 0.0, "boom", "x", 2), ("m4", 1.0, 0.0, None, "", 3)], "model_id string, total_ms double, cer double, error string, text string, ord int")
    p = runs.fastest_and_best(picks).first()
    assert (p["fastest_model_id"], p["most_accurate_model_id"]) == ("m1", "m2")
    asked = runs.requested_models(texts(spark, [(" a, b,,a ",)], "models")).first()["model_ids"]
    assert asked == ["a", "b"]


def test_early_stop_is_not_a_running_minimum(spark):
    values = [1.0, 0.9, 0.9 - 0.6e-5, 0.9 - 1.2e-5, float("nan"), 0.95, 0.96, 0.97]
    df = spark.createDataFrame([("r", i + 1, v) for i, v in enumerate(values)], "run_name string, epoch int, value double")
    s = sequence.early_stop(df, 3).first()
    assert s["best_epoch"] == 4 and s["stop_epoch"] == 8 and sequence.early_stop(df, 0).first()["stop_epoch"] is None


@pytest.mark.parametrize("frames,expected", [([1, 1, 0, 1], [1, 1]), ([1, 1, 1], [1]), ([0, 1, 0, 2, 0], [1, 2]), ([0, 0, 0], [])])
def test_collapse(spark, frames, expected):
    assert one(spark, sequence.collapse_array(F.array(*map(F.lit, frames)))) == expected
    df = spark.createDataFrame([(1, t, c) for t, c in enumerate(frames)], "sample_id int, t int, class int")
    assert [r["class"] for r in sequence.collapse(df).orderBy("t").collect()] == expected


def test_greedy_decode(spark):
    planted = {1: [0, 8, 8, 0, 5, 12, 0, 12, 15], 2: [1, 0, 1], 3: [0, 0]}
    rows = [(s, t, c, 0.0 if c == k else -5.0) for s, ks in planted.items() for t, k in enumerate(ks) for c in range(27)]
    out = {r["sample_id"]: r for r in sequence.greedy_decode(spark.createDataFrame(rows, "sample_id int, t long, class int, logp double"), text.Charset("abcdefghijklmnopqrstuvwxyz")).collect()}
    assert (out[1]["text"], out[2]["text"], out[3]["text"]) == ("hello", "aa", "") and out[1]["confidence"] == 1 and out[3]["confidence"] == 0 and out[1]["timesteps"] == [1, 4, 5, 7, 8]


CASES = [
    ([(40, 100, 120, 24), (240, 100, 20, 24), (320, 100, 70, 24), (40, 150, 110, 24)], [], [[0, 1, 2], [3]]),
    ([(320, 100, 70, 24), (40, 100, 120, 24), (240, 100, 20, 24)], [], [[1, 2, 0]]),
    ([(40, 300, 100, 24), (40, 100, 100, 24), (40, 200, 100, 24)], [], [[1], [2], [0]]),
    ([(40, 100, 200, 24), (520, 100, 200, 24)], [(300, 500)], [[0], [1]]),
]


def pages(spark, boxes, gutters):
    rows = [(p, i, *b) for p, bs in enumerate(boxes) for i, b in enumerate(bs)]
    df = layout.boxes_of(spark.createDataFrame(rows, "page_id int, idx int, x int, y int, width int, height int"))
    g = spark.createDataFrame([(p, [tuple(x) for x in gs]) for p, gs in enumerate(gutters)], "page_id int, gutters array<struct<a:int,b:int>>")
    return df.join(g, "page_id")


def test_group_rows(spark):
    out = layout.group_rows(pages(spark, [c[0] for c in CASES], [c[1] for c in CASES])).orderBy("page_id").collect()
    assert [[[b["idx"] for b in row] for row in r["rows"]] for r in out] == [c[2] for c in CASES]


def overlap(a, b):
    over = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return over > 0 and over >= 0.5 * min(a[3], b[3])


def parted(a, b, gutters):
    left, right = (a, b) if a[0] <= b[0] else (b, a)
    return any(s < right[0] and e > left[0] + left[2] for s, e in gutters)


def test_rows_and_merges_on_random_pages(spark):
    r = random.Random(3)
    boxes = [[(r.randrange(0, 700), r.randrange(0, 300), r.randrange(10, 120), r.randrange(8, 40)) for _ in range(20)] for _ in range(25)]
    gutters = [[(300, 330)] if k % 2 else [] for k in range(25)]
    grouped = layout.group_rows(pages(spark, boxes, gutters)).orderBy("page_id").collect()
    merged = layout.merge_boxes(pages(spark, boxes, gutters), 16.0).orderBy("page_id").collect()
    for p, (bs, gs) in enumerate(zip(boxes, gutters)):
        rows = []
        for i in sorted(range(20), key=lambda i: (bs[i][1], bs[i][0], i)):
            row = next((w for w in rows if overlap(bs[w[-1]], bs[i]) and not parted(bs[w[-1]], bs[i], gs)), None)
            rows.append([i]) if row is None else row.append(i)
        members = sorted(sorted(w) for w in rows)
        assert sorted(sorted(b["idx"] for b in w) for w in grouped[p]["rows"]) == members
        tops = [min(b["y"] for b in w) for w in grouped[p]["rows"]]
        assert tops == sorted(tops) and all([b["x"] for b in w] == sorted(b["x"] for b in w) for w in grouped[p]["rows"])
        now = sorted(bs, key=lambda b: (b[1], b[0]))
        for _ in range(4):
            state = []
            for b in now:
                for k, e in enumerate(state):
                    left, right = (e, b) if e[0] <= b[0] else (b, e)
                    if overlap(e, b) and right[0] - left[0] - left[2] <= 48 and not parted(e, b, gs):
                        x, y = min(e[0], b[0]), min(e[1], b[1])
                        state[k] = (x, y, max(e[0] + e[2], b[0] + b[2]) - x, max(e[1] + e[3], b[1] + b[3]) - y)
                        break
                else:
                    state.append(b)
            now = sorted(state, key=lambda b: (b[1], b[0]))
        assert sorted((b["x"], b["y"], b["width"], b["height"]) for b in merged[p]["boxes"]) == sorted(now)


def test_a_page_of_fifty_thousand_boxes(spark):
    import time

    r = random.Random(6)
    boxes = sorted((r.randrange(0, 60_000), r.randrange(0, 3000), i, r.randrange(10, 60), r.randrange(10, 30)) for i in range(50_000))
    gutters = [(700, 730), (1500, 1540)]
    began = time.process_time()
    rows, whole = sweep.grouped(boxes, gutters), sweep.merged(boxes, gutters, 40.0)
    assert time.process_time() - began < 20
    assert sum(map(len, rows)) == 50_000 and sorted(b[2] for row in rows for b in row) == list(range(50_000))
    for a, b in zip(rows, rows[1:]):
        assert min(x[0] for x in a) <= min(x[0] for x in b)
    few = boxes[:400]  # against every row and box so far, not only those beside
    plain = []
    for box in few:
        hit = next((row for row in plain if sweep.same_row(row[-1], box) and not sweep.parted(row[-1], box, gutters)), None)
        plain.append([box]) if hit is None else hit.append(box)
    assert sorted(sorted(row) for row in sweep.grouped(few, gutters)) == sorted(sorted(row) for row in plain)
    assert len(whole) < 50_000 and sweep.merged(whole, gutters, -1e9) == whole
    page = spark.createDataFrame([(1, [dict(zip(sweep.FIELDS, b)) for b in boxes[:3000]])], "page_id long, boxes array<struct<y:int,x:int,idx:int,width:int,height:int>>").withColumn("gutters", F.array().cast("array<struct<a:int,b:int>>"))
    assert layout.group_rows(page).select(F.aggregate("rows", F.lit(0), lambda n, row: n + F.size(row))).first()[0] == 3000


def test_gutters_and_reading_order(spark):
    boxes = [(1, 2 * k + s, 40 + 460 * s, 40 * k, 260, 24) for k in range(6) for s in (0, 1)]
    df = spark.createDataFrame(boxes, "page_id int, idx int, x int, y int, width int, height int")
    page = spark.createDataFrame([(1, 800, 20.0), (2, 800, 20.0)], "page_id int, page_width int, char_height double")
    found = {r["page_id"]: [tuple(g) for g in r["gutters"]] for r in layout.find_gutters(df, page).collect()}
    assert found == {1: [(300, 500)], 2: []}
    names = df.select("page_id", "idx", F.concat(F.lit("t"), "idx").alias("text"))
    out = layout.reading_order(df, names, page).first()["text"].split("\n")
    assert len(out) == 12 and out[0] == "t0" and out[1] == "t1"


def test_row_bands_join_thin_runs(spark):
    ink = [0] * 60
    for a, b in ((5, 7), (8, 28), (35, 55), (57, 58)):
        ink[a:b] = [50] * (b - a)
    df = spark.createDataFrame([(1, r, i) for r, i in enumerate(ink)], "page_id int, row int, ink int")
    assert [(b["begin"], b["end"]) for b in layout.row_bands(df, 400).orderBy("begin").collect()] == [(5, 28), (35, 55)]


def test_latency_like_numpy(spark):
    r = np.random.default_rng(5)
    ms, size = r.uniform(5, 50, 30), np.r_[np.full(29, 32), 7]
    df = spark.createDataFrame([(float(m), int(s), k < 2) for k, (m, s) in enumerate(zip(ms, size))], "ms double, size int, warm boolean")
    each = np.repeat(ms[2:] / size[2:], size[2:])
    out = latency.latency_stats(df).first()
    assert out["avg_ms"] == pytest.approx(each.mean()) and out["median_ms"] == pytest.approx(np.median(each)) and out["p95_ms"] == pytest.approx(np.percentile(each, 95))
    none = latency.latency_stats(df.where("warm")).first()
    assert none["timed_samples"] == 0 and none["p95_ms"] == 0


def test_contrastive_like_numpy(spark):
    r = np.random.default_rng(6)
    z = r.normal(size=(10, 8))
    df = spark.createDataFrame([(0, i % 5, i // 5, [float(v) for v in row]) for i, row in enumerate(z)], "batch int, img int, view int, z array<double>")
    u = z / np.linalg.norm(z, axis=1, keepdims=True)
    s = u @ u.T / 0.5
    np.fill_diagonal(s, -np.inf)
    target = np.r_[np.arange(5, 10), np.arange(5)]
    loss = np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(10), target])
    out = contrastive.contrastive_metrics(df).first()
    assert out["loss"] == pytest.approx(loss) and out["accuracy"] == pytest.approx((s.argmax(1) == target).mean())
    with pytest.raises(Exception, match="two images"):
        contrastive.contrastive_metrics(df.where("img = 0")).collect()


def test_recognisers_fail_apart(spark):
    df = spark.createDataFrame([(i, "bad" if i == 3 else f"line {i}", f"line {i}") for i in range(40)], "id int, image string, ground_truth string")

    def read(crops):
        if "bad" in crops:
            raise ValueError("cannot read")
        return [(c, 0.5) for c in crops]

    def broken(crops):
        raise RuntimeError("no")

    out = recognise.require_success(recognise.recognise(df, read, batch=16))
    assert out.where("error is not null").select("id").collect() == [(3,)] and out.count() == 40
    with pytest.raises(RuntimeError):
        recognise.require_success(recognise.recognise(df, broken))
    _, best = recognise.compare_models(df, {"broken": broken, "read": read})
    assert best.first()["most_accurate_model_id"] == "read"
    lines = out.withColumn("page_id", F.lit(1)).withColumn("index", F.col("id"))
    pages_, summary = recognise.extract_pages(lines)
    assert pages_.first()["text"].startswith("line 0\nline 1") and summary.first()["images"] == 1


def test_prepare(spark):
    files = spark.range(300).select(F.concat(F.lit("f"), "id").alias("path"))
    rows = files.where("path not like '%9'").select(F.when(F.hash("path") % 4 == 0, "val").otherwise("train").alias("split"), "path", F.lit("label").alias("label"))
    out = prepare.prepare_corpus(rows, files, text.Charset(), {"train": 50, "val": 10}, 20, unlabeled=12)
    assert out["manifest"].groupBy("split").count().orderBy("split").collect() == [("train", 50), ("val", 10)] and out["unlabeled"].count() == 12
    assert out["report"].agg(F.sum("total") - F.sum("written")).first()[0] == 0
    assert prepare.prepare_unsplit(rows.drop("split"), files, text.Charset(), 20)["manifest"].count() == 270
    three = prepare.prepare_train_test(rows.withColumn("split", F.when(F.col("split") == "val", "test").otherwise("train")), files, text.Charset(), 20)
    assert three["manifest"].select("split").distinct().count() == 3


def test_store(spark, folder):
    store.append(requests(spark), folder, "ocr_requests")
    store.append(requests(spark).limit(1), folder, "ocr_requests")
    assert store.read(spark, folder, "ocr_requests").count() == 4
    with pytest.raises(ValueError):
        store.append(requests(spark), folder, "other")
    store.export_texts(texts(spark, [("a b", "x\ny")], "name", "text"), f"{folder}/export")
    with open(__import__("glob").glob(f"{folder}/export/file=a-b/part*")[0], newline="", encoding="utf-8") as f:
        assert f.read() == "﻿x\r\ny\n"
    joined = store.joined_export(texts(spark, [("b", "2", "d"), ("a", "1", "d")], "name", "text", "doc"), "doc").first()["text"]
    assert joined == "===== a =====\n1\n\n===== b =====\n2"


def test_streams(spark, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = requests(spark).select("created_at", "model_id", "total_ms", "confidence")
    r.write.parquet(f"{folder}/in")
    q = jobs.daily_statistics(spark.readStream.schema(r.schema).parquet(f"{folder}/in")).writeStream.format("memory").queryName("daily").outputMode("append").option("checkpointLocation", f"{folder}/c1").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("daily").agg(F.sum("requests")).first()[0] >= 1

    e = spark.createDataFrame([("j1", dt.datetime(2026, 1, 1, k), "running" if k < 3 else "done", k, f"epoch {k}") for k in range(4)], "job_id string, ts timestamp, status string, epoch int, history_entry string")
    for k in range(2):
        e.where(F.floor(F.col("epoch") / 2) == k).write.mode("append").parquet(f"{folder}/jobs")
        q = jobs.job_progress(spark.readStream.schema(e.schema).parquet(f"{folder}/jobs"), f"{folder}/snap").option("checkpointLocation", f"{folder}/c2").start()
        q.processAllAvailable()
        q.stop()
    last = spark.read.parquet(f"{folder}/snap/batch=1").first()
    assert last["status"] == "done" and last["epoch"] == 3 and last["history"] == [f"epoch {k}" for k in range(4)]

    rows = spark.createDataFrame([("p1", "good"), ("p2", "unreadable")], "path string, label string")
    rows.write.parquet(f"{folder}/labels")
    q = jobs.ingest(spark.readStream.schema(rows.schema).parquet(f"{folder}/labels"), text.Charset(), 20, f"{folder}/good", f"{folder}/bad").option("checkpointLocation", f"{folder}/c3").start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{folder}/good").count() == 1 and spark.read.parquet(f"{folder}/bad").first()["reason"] == "unreadable"


def test_early_stop_stream_matches_the_batch(spark, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = random.Random(8)
    rows = [(f"r{k}", e, r.random()) for k in range(5) for e in range(1, 30)]
    df = spark.createDataFrame(rows, "run_name string, epoch int, value double")
    df.write.parquet(f"{folder}/epochs")
    q = jobs.early_stop_alerts(spark.readStream.schema(df.schema).parquet(f"{folder}/epochs"), 4).writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    stream = {x["run_name"]: x["stop_epoch"] for x in spark.table("alerts").collect()}
    batch = {x["run_name"]: x["stop_epoch"] for x in sequence.early_stop(df, 4).where("stop_epoch is not null").collect()}
    assert stream == batch


@pytest.fixture(scope="module")
def duck():
    import duckdb
    import os

    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_queries_match_duckdb(spark, duck, name):
    out = catalogue.QUERIES[name](spark, SF)
    mine = [tuple(r) for r in out.collect()]
    assert mine or name == "delete_ids"  # the smallest table has an order for every id
    if name in catalogue.ORACLES:
        theirs = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in out.columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
        plain = lambda rows: sorted(repr(tuple(float(f"{x:.6g}") if isinstance(x, float) else x for x in r)) for r in rows)
        assert plain(mine) == plain(theirs)


def test_corrections_score_normalised_text(spark):
    r = spark.createDataFrame([(1, "ab  cd", None), (2, "\ufb01n x", "old")], "id int, text string, ground_truth string").withColumns({"cer": F.lit(None).cast("double"), "wer": F.lit(None).cast("double"), "exact_match": F.lit(None).cast("boolean")})
    c = spark.createDataFrame([(1, 1, "ab cd "), (2, 1, "fin  x")], "id int, ts int, ground_truth string")
    got = {x["id"]: (x["ground_truth"], x["cer"], x["wer"], x["exact_match"]) for x in runs.apply_corrections(r, c).collect()}
    assert got == {1: ("ab cd", 0.0, 0.0, True), 2: ("fin  x", 0.0, 0.0, True)}


def test_accents_count_as_code_points(spark):
    m = metrics.corpus_metrics(metrics.sample_metrics(pairs(spark, [("élève à", "eleve à"), ("naïve", "naïve")]))).first()
    assert (m["total_char_edits"], m["total_ref_chars"]) == (2, 12)


def test_regions_merge_before_the_cap(spark):
    """Two columns of words: gutters part them, words of a line merge, and only then the largest are taken, grown and clamped."""
    rows = [(1, 10 * k + s, x, 40 * k, 60, 20) for k in range(6) for s, x in ((0, 2), (1, 70), (2, 500), (3, 568))]
    boxes = spark.createDataFrame(rows, "page_id int, idx int, x int, y int, width int, height int")
    page = spark.createDataFrame([(1, 640, 230, 20.0)], "page_id int, page_width int, page_height int, char_height double")
    out = layout.regions(boxes, page, max_lines=11).first()
    assert [tuple(g) for g in out["gutters"]] == [(130, 500)]
    got = [(b["idx"], b["x"], b["y"], b["width"], b["height"]) for b in out["boxes"]]
    assert len(got) == 11 and got[0] == (0, 0, 0, 133, 23) and got[1] == (2, 497, 0, 134, 23)
    assert got[2] == (10, 0, 37, 133, 26) and got[-1] == (50, 0, 197, 133, 26)
    assert layout.regions(boxes.withColumn("height", F.lit(2)).withColumn("width", F.lit(2)), page.withColumn("char_height", F.lit(0.1)), padding_ratio=0.0).first()["boxes"] == []


def test_shared_canvas(spark):
    rows = spark.createDataFrame([(1, 100, 32), (1, 301, 64), (2, 9000, 64), (2, 64, 64), (3, 3, 0)], "batch int, width int, height int")
    got = {(r["batch"], r["width"]): (r["canvas"], round(r["content_ratio"], 4), r["compressed"]) for r in geometry.shared_canvas(rows, "batch").collect()}
    assert got == {(1, 100): (304, 0.6579, False), (1, 301): (304, 0.9901, False), (2, 9000): (2048, 1.0, True), (2, 64): (2048, 0.0312, False), (3, 3): (192, 1.0, False)}


def test_checks_of_requests_and_alphabets(spark):
    known = spark.createDataFrame([("a",), ("b",)], "model_id string")
    assert corpus.known_ids(known.limit(1), known, "model_id").count() == 1
    with pytest.raises(LookupError, match="available: \\['a', 'b'\\]"):
        corpus.known_ids(spark.createDataFrame([("z",)], "model_id string"), known, "model_id")
    rows = texts(spark, [("abc",), ("日本",), ("x日",)], "label")
    assert sorted(r["label"] for r in corpus.encodable(rows, text.Charset()).collect()) == ["abc", "x日"]
    with pytest.raises(Exception, match="no label is left"):
        corpus.encodable(rows.where("label = '日本'"), text.Charset()).collect()


def test_subset_comes_in_its_own_order(spark):
    rows = spark.range(50).select(F.col("id"), (50 - F.col("id")).alias("ord"))
    got = [r["ord"] for r in corpus.seeded_subset(rows, 10, order="ord").collect()]
    assert len(got) == 10 and got == sorted(got)


def test_benchmark_counts_failures_and_leaves_warm_up_untimed(spark):
    def reader(items):
        if any(x == "bad" for x in items):
            raise ValueError("cannot read")
        return [(x.upper(), 0.5) for x in items]

    rows = [(i, "AB", "bad" if i == 3 else "ab", "broken" if i == 7 else None) for i in range(10)]
    run, samples = recognise.benchmark(spark.createDataFrame(rows, "ord int, label string, image string, error string"), reader, "m", "d", "test", batch_size=3, warmup=1, max_samples=9)
    r = run.first()
    assert (r["num_samples"], r["failed_samples"], r["cer"], r["mean_confidence"]) == (7, 2, 0.0, 0.5) and r["model_id"] == "m"
    assert r["timed_samples"] == 5 and samples.count() == 7


def test_portable_and_tiff_images(spark, folder):
    import struct

    def tiff(w, h, pixels):
        tags = [(256, 3, 1, w), (257, 3, 1, h), (258, 3, 1, 8), (259, 3, 1, 1), (262, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (278, 3, 1, h), (279, 4, 1, w * h)]
        body = pixels + b"\0" * (len(pixels) % 2)
        return struct.pack("<2sHI", b"II", 42, 8 + len(body)) + body + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)

    grey = bytes(range(0, 160, 2))
    files = {"a.pgm": b"P5\n# made by hand\n10 8\n255\n" + grey, "b.ppm": b"P3 6 6 255\n" + b"10 20 30 " * 36, "c.ppm": b"P6 10 10 255 short", "d.tif": tiff(10, 8, grey), "e.webp": b"RIFF", "f.pgm": b"P2 2 2 255 1 2 3 400"}
    for name, data in files.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    out = {r["origin"].rsplit("/", 1)[1]: r for r in images.screen(images.decode(spark, folder)).collect()}
    assert {n: r["reason"] for n, r in out.items()} == {"a.pgm": None, "b.ppm": None, "c.ppm": "undecodable", "d.tif": None, "e.webp": "unsupported_format", "f.pgm": "undecodable"}
    assert (out["a.pgm"]["height"], out["a.pgm"]["width"], bytes(out["a.pgm"]["data"])) == (8, 10, grey) and bytes(out["b.ppm"]["data"])[:3] == bytes([30, 20, 10])
    assert (out["d.tif"]["height"], out["d.tif"]["width"]) == (8, 10)
