"""The manifest format: splits, filters, malformed lines, commits and aborts."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, StringStartsWith

from scribe.sources import manifest_source as source


def files(path):
    return sorted(f for f in os.listdir(path) if not f.startswith("_"))


def test_round_trip_in_any_splits(spark, folder):
    rows = spark.createDataFrame([(f"a\\{i}.png", f"label ß {i}" * (i % 5 + 1)) for i in range(500)], "path string, label string")
    source.write_rows(rows.repartition(3), f"{folder}/m")
    names = files(f"{folder}/m")
    assert len(names) == 3 and not [f for f in os.listdir(f"{folder}/m") if f.startswith("_")]
    assert all(open(f"{folder}/m/{f}", encoding="utf-8").readline() == source.HEADER for f in names)
    want = sorted((f"a/{i}.png", f"label ß {i}" * (i % 5 + 1)) for i in range(500))
    for split in (1, 7, 100, 1 << 20):
        reader = source.ManifestReader({"path": f"{folder}/m", "split": split})
        assert sorted(r[1:3] for p in reader.partitions() for r in reader.read(p)) == want
    got = spark.read.format("manifest").option("split", 900).load(f"{folder}/m")
    assert got.rdd.getNumPartitions() > 3 and sorted(map(tuple, got.select("path", "label").collect())) == want
    source.write_rows(rows.limit(4), f"{folder}/m", "append")
    assert spark.read.format("manifest").load(f"{folder}/m").count() == 504
    source.write_rows(rows.limit(4), f"{folder}/m")
    assert spark.read.format("manifest").load(f"{folder}/m").count() == 4


def test_small_splits_do_not_become_a_task_each(folder):
    os.mkdir(f"{folder}/m")
    rows = [(f"{i}.png", f"label {i}") for i in range(20_000)]
    with open(f"{folder}/m/one.txt", "w", encoding="utf-8") as f:
        f.writelines(f"{p}\t{t}\n" for p, t in rows)
    reader = source.ManifestReader({"path": f"{folder}/m", "split": 100})
    parts = reader.partitions()
    assert 200 < len(parts) <= source.SPLITS + 1
    assert [r[1:3] for p in parts for r in reader.read(p)] == rows


def test_malformed_lines_are_named(spark, folder):
    os.mkdir(f"{folder}/m")
    with open(f"{folder}/m/one.txt", "w", encoding="utf-8") as f:
        f.write("# comment\n\na.png\tone\r\nno tab here\nb.png\t\n\tc\n  # more\nd.png\ttwo\twith a tab")
    source.register(spark)
    with pytest.raises(Exception, match=r"one\.txt:[456]: no path"):  # whichever split fails first
        spark.read.format("manifest").option("split", 10).load(f"{folder}/m").collect()
    with pytest.raises(ValueError, match=r"one\.txt:4: no path"):
        reader = source.ManifestReader({"path": f"{folder}/m"})
        list(reader.read(reader.partitions()[0]))
    got = spark.read.format("manifest").option("mode", "permissive").load(f"{folder}/m").collect()
    assert [(r["path"], r["label"]) for r in got if r["path"]] == [("a.png", "one"), ("d.png", "two\twith a tab")]
    assert [r["malformed"] for r in got if r["malformed"]] == ["no tab here", "b.png\t", "\tc"]
    os.mkdir(f"{folder}/none")
    assert spark.read.format("manifest").load(f"{folder}/none").isEmpty()


def test_filters_leave_files_and_lines_out(spark, folder):
    source.write_rows(spark.createDataFrame([(f"{'ab'[i % 2]}/{i}", "x") for i in range(40)], "path string, label string").repartition(4), f"{folder}/m")
    reader = source.ManifestReader({"path": f"{folder}/m"})
    one = reader.partitions()[0].file
    left = list(reader.pushFilters([EqualTo(("file",), one), StringStartsWith(("path",), "a/"), EqualTo(("label",), "x")]))
    assert left == [EqualTo(("label",), "x")] and [p.file for p in reader.partitions()] == [one]
    assert all(r[1].startswith("a/") for p in reader.partitions() for r in reader.read(p))
    got = spark.read.format("manifest").load(f"{folder}/m").where(F.col("path").startswith("a/"))
    assert got.count() == 20


def test_a_failed_task_leaves_nothing(spark, folder):
    good = spark.createDataFrame([("a", "one")], "path string, label string")
    source.write_rows(good, f"{folder}/m")
    before = files(f"{folder}/m")
    bad = spark.range(40).select(F.concat(F.lit("p"), "id").alias("path"), F.when(F.col("id") == 37, F.raise_error(F.lit("no label")).cast("string")).otherwise("x").alias("label")).repartition(4)
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="no label"):
            source.write_rows(bad, f"{folder}/m", mode)
        assert files(f"{folder}/m") == before and spark.read.format("manifest").load(f"{folder}/m").count() == 1
