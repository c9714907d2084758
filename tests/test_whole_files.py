"""History files of many runs: who writes and reads them, odd files, patterns, and the registered query on odd rows."""

import math
import os

import pytest
from pyspark.sql import functions as F

from scribe import catalogue, catalogue_files
from scribe.sources import labels, whole_files


def put(folder, name, content):
    os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
    with open(f"{folder}/{name}", "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())


def got(rows):
    return sorted((r["run"], r["epoch"], r["metrics"]) for r in rows.collect())


def test_small_files_do_not_become_a_task_each(spark, folder):
    for i in range(300):
        put(folder, f"runs/r{i:03d}/history.json", f'{{"epochs": [{{"epoch": {i}, "loss": {i}.5}}]}}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        for path in (f"{folder}/runs", f"file://{folder}/runs", f"{folder}/runs/*/history.json", f"{folder}/r*/r???"):
            h = labels.read_histories(spark, path)
            assert h.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
            assert got(h) == [(f"r{i:03d}", i, {"loss": i + 0.5}) for i in range(300)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_odd_files(spark, folder):
    put(folder, "h/a/history.json", '\ufeff{"epochs": [{"epoch": 1, "x": 0.5}]}')
    put(folder, "h/b c%20/history.json", '{"epochs": [{"epoch": 1, "x": "é"}, {"epoch": 2, "x": 2}]}'.encode("utf-16"))
    put(folder, "h/c/history.json", '[{"epochs": [{"epoch": 1, "x": 1}]}, {"epochs": [{"epoch": 2, "x": 2}]}]')
    put(folder, "h/d/history.json", '{"epochs": [{"epoch": 3, "up": Infinity, "down": -Infinity, "no": NaN, "far": 1e400, "long": 12345678901234567890}]}')
    put(folder, "h/deep/e/history.json", '{\n  "epochs": [\n    {"epoch": 4, "timestamp": 5}\n  ]\n}\n')
    for name, content in (("cut", '{"epochs": [{"epoch": 1, "x": 1}], "monitor": '), ("none", ""), ("bytes", b'{"epochs": [{"epoch": 1, "x": "\xff"}]}'), ("_hidden", '{"epochs": [{"epoch": 1}]}')):
        put(folder, f"h/{name}/history.json", content)
    put(folder, "h/a/.other.json", '{"epochs": [{"epoch": 7}]}')
    rows = {(run, epoch): metrics for run, epoch, metrics in got(labels.read_histories(spark, f"{folder}/h"))}
    odd = rows.pop(("d", 3))
    assert math.isnan(odd.pop("no")) and odd == {"up": float("inf"), "down": float("-inf"), "far": float("inf"), "long": 12345678901234567890.0}
    assert rows == {("a", 1): {"x": 0.5}, ("b c%20", 1): {}, ("b c%20", 2): {"x": 2.0}, ("c", 1): {"x": 1.0}, ("c", 2): {"x": 2.0}, ("e", 4): {}}
    assert got(labels.read_histories(spark, f"{folder}/h/a/history.json")) == [("a", 1, {"x": 0.5})]
    os.mkdir(f"{folder}/nothing")
    assert got(labels.read_histories(spark, f"{folder}/nothing")) == []
    with pytest.raises(Exception, match="missing"):
        labels.read_histories(spark, f"{folder}/missing").collect()


def test_paths_that_arrow_does_not_know_are_read_by_spark(spark, folder):
    put(folder, "x/a/history.json", '{"epochs": [{"epoch": 1, "x": NaN}, {"epoch": 2, "x": 1}]}')
    for path, known in ((f"{folder}/x/a", True), (f"file:{folder}/x/*", True), (f"{folder}/{{x,y}}/a", False), (f"{folder}/[x]/a", False), ("nowhere://host/x", False)):
        assert whole_files.known(spark, path) == known
        if "nowhere" not in path:
            assert [(r, e) for r, e, _ in got(labels.read_histories(spark, path))] == [("a", 1), ("a", 2)]


def test_a_name_that_is_no_folder_is_an_error(spark, folder):
    one = lambda run: spark.createDataFrame([(run, "{}")], "run string, value string")
    for k, run in enumerate(("a/b", None)):
        with pytest.raises(Exception, match="no folder can have the name"):
            labels.write_histories(one(run), f"{folder}/{k}")
    labels.write_histories(one("a"), f"{folder}/w")
    with pytest.raises(FileExistsError):
        labels.write_histories(one("b"), f"{folder}/w")


def test_all_tasks_write_and_odd_rows_count(spark, folder, monkeypatch):
    """The query writes by all cores, and gives SQL's rows for users and values that are null or no finite numbers."""
    import duckdb

    rows = [(i, i % 97, float(i % 13)) for i in range(2000)] + [(3000, None, 1.0), (3001, None, 2.0), (3002, 500, None), (3003, 501, float("inf")), (3004, 501, 1.0), (3005, 502, None), (3006, 502, 4.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    frames, write = [], labels.write_histories
    monkeypatch.setattr(labels, "write_histories", lambda rows, path: (frames.append((rows, path)), write(rows, path)))
    out = sorted(map(tuple, catalogue_files.history_files(spark, folder).collect()), key=str)
    want = duckdb.sql(catalogue.ORACLES["history_files"].replace("events", f"'{folder}/events.parquet/*.parquet'")).fetchall()
    assert out == sorted(want, key=str) and len(out) == 101
    written, path = frames[0]
    assert written.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    assert files.count() == 102 and files.where(~F.col("path").rlike(r"/\d{3}/run=(user\d+|broken|)/history\.json$")).count() == 0
