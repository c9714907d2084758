"""Versioned tables, the job store and the early-stop stream: what they rewrite, keep and forget."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scribe.operators import quantiles, runs, sequence
from scribe.sources import history, versions
from scribe.streaming import jobs, state


def names(table, version):
    return {r["file"] for r in table.files(version).collect()}


@pytest.fixture
def table(spark, folder):
    made = versions.VersionedTable(spark, f"{folder}/t", "id")
    made.create(spark.range(10_000).withColumn("x", F.col("id") % 7).repartitionByRange(10, "id"))
    return made


def test_a_delete_rewrites_only_the_files_that_hold_its_ids(spark, table):
    assert len(names(table, 0)) == 10
    versions.delete_ids(table, spark.range(4000, 4010), strict=True)
    before, after = names(table, 0), names(table, 1)
    assert len(before - after) <= 2 and len(before & after) >= 8
    for row in table.files(0).where(~F.col("file").isin(list(after))).collect():
        assert int(row["low"]) <= 4009 and int(row["high"]) >= 4000
    assert table.read().count() == 9990 and table.read(0).count() == 10_000
    assert table.read().where("id between 4000 and 4009").isEmpty()
    assert sum(r["rows"] for r in table.files(1).collect()) == 9990


def test_ids_without_a_row_rewrite_nothing(spark, table):
    with pytest.raises(runs.NotFound):
        versions.delete_ids(table, spark.range(9999, 10_001), strict=True)
    assert table.numbers() == [0]
    versions.delete_ids(table, spark.range(20_000, 20_005))
    versions.delete_ids(table, spark.range(0))
    assert names(table, 1) == names(table, 0) == names(table, 2)


def test_of_two_writers_one_wins_and_a_failed_change_leaves_no_version(spark, table):
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        table.commit(0, table.files(0))
    with pytest.raises(Exception, match="no good"):
        table.rewrite(spark.range(5), lambda rows: rows.withColumn("x", F.when(F.col("id") == 3, F.raise_error(F.lit("no good")).cast("long")).otherwise(F.col("x"))))
    assert table.numbers() == [0] and table.read().count() == 10_000


def test_versions_go_with_the_files_that_no_other_names(spark, table):
    for k in range(3):
        versions.delete_ids(table, spark.range(10 * k, 10 * k + 5))
    assert table.expire(2) > 0 and table.numbers() == [2, 3]
    assert table.read(2).count() == 9990 and table.read().count() == 9985
    versions.prune(table, lambda rows: rows.where("x = 3 and id < 1000"))
    left = table.read()
    assert left.where("x = 3 and id < 1000").isEmpty() and left.where("x = 3").count() > 1000
    assert len(names(table, 3) & names(table, 4)) >= 8


def events(spark, rows):
    return spark.createDataFrame(rows, "job_id string, ts timestamp, status string, epoch int, history_entry string")


def test_fifty_batches_rewrite_only_their_buckets(spark, folder):
    store, told, last, held = state.JobStore(spark, f"{folder}/jobs", buckets=8, keep=4, block=16), [], {}, []
    r = random.Random(3)
    for k in range(50):
        batch = []
        for job in r.sample([f"j{i}" for i in range(20)], 2):
            status = r.choice([None, "running", "done"])
            batch.append((job, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=r.randrange(10_000)), status, k, f"{job} {k}"))
            last[job] = (status or last.get(job, (None,))[0], k)
            told.append((job, f"{job} {k}"))
        before = names(store.table, k - 1) if k else set()
        store.merge(events(spark, batch), k)
        after = names(store.table, k)
        assert len(after - before) <= 2 and len(before - after) <= 2 and len(after) <= 8
        held.append(sum(1 for _ in store._folders()))
        if k in (20, 31):  # a batch that is run again changes nothing
            kept = sorted(map(str, store.jobs().collect()))
            store.merge(events(spark, batch), k)
            assert sorted(map(str, store.jobs().collect())) == kept
    got = {x["job_id"]: (x["status"], x["epoch"], x["history"]) for x in store.jobs().collect()}
    assert {j: x[:2] for j, x in got.items()} == last
    assert {j: x[2] for j, x in got.items()} == {j: [e for i, e in told if i == j] for j in last}
    assert max(held) <= 16 + 3 and len(store.table.numbers()) == 4


def test_the_job_store_takes_empty_batches_and_nulls(spark, folder):
    store = state.JobStore(spark, f"{folder}/jobs", buckets=4)
    store.merge(events(spark, []), 0)
    assert store.jobs().isEmpty()
    at = dt.datetime(2026, 1, 1)
    store.merge(events(spark, [("a", at, None, None, None), (None, at, "running", 1, "x")]), 1)
    store.merge(events(spark, [("a", at, "done", None, None)]), 2)
    got = {x["job_id"]: (x["status"], x["epoch"], x["history"]) for x in store.jobs().collect()}
    assert got["a"] == ("done", None, []) and got[None][:2] == ("running", 1)


def test_a_large_batch_of_history_is_not_one_task(spark, folder):
    store = state.JobStore(spark, f"{folder}/jobs", buckets=4)
    many = spark.range(0, 4000, 1, 6).select(F.concat(F.lit("j"), F.col("id") % 50).alias("job_id"), F.timestamp_seconds("id").alias("ts"), F.lit("running").alias("status"), F.col("id").cast("int").alias("epoch"), F.col("id").cast("string").alias("history_entry"))
    store.merge(many, 0)
    assert len(store.history().inputFiles()) == 6
    assert sum(len(x["history"]) for x in store.jobs().collect()) == 4000


class Value:
    def __init__(self):
        self.now = None

    exists, get, update, clear = (lambda s: s.now is not None), (lambda s: s.now), (lambda s, v: setattr(s, "now", v)), (lambda s: setattr(s, "now", None))


class Map(dict):
    updateValue, removeKey, iterator = dict.__setitem__, dict.__delitem__, (lambda s: iter(list(s.items())))


class Handle:
    """A stand-in for one run's state."""

    def __init__(self):
        self.timers, self.value, self.map = set(), Value(), Map()

    getValueState, getMapState = (lambda s, *a: s.value), (lambda s, *a: s.map)
    registerTimer, deleteTimer = (lambda s, t: s.timers.add(t)), (lambda s, t: s.timers.discard(t))


class Times:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def alerts(order, patience, mark_every=3, lag=40):
    """Alerts of one run whose (epoch, value) come in some order, the watermark `lag` epochs behind the newest."""
    work, handle, out = jobs.EarlyStopInOrder(patience, "min", 1e-5, 1_000_000), Handle(), []
    work.init(handle)

    def fire(now):
        for t in sorted(t for t in handle.timers if t <= now):
            handle.timers.discard(t)
            out.extend(x for part in work.handleExpiredTimer(("r",), Times(now), None) for x in part.itertuples(index=False, name=None))

    mark = 0
    for k in range(0, len(order), mark_every):
        part = order[k : k + mark_every]
        rows = pd.DataFrame({"ts": [pd.Timestamp(1000 * e, unit="ms") for e, _ in part], "epoch": [e for e, _ in part], "value": [v for _, v in part]})
        list(work.handleInputRows(("r",), iter([rows]), Times(mark)))
        mark = max(mark, 1000 * (max(e for e, _ in order[: k + mark_every]) - lag))
        fire(mark)
    for now in (1000 * 10_000, 1000 * 20_000, 1000 * 30_000):
        fire(now)
    return out, handle


def test_shuffled_epochs_give_the_alerts_of_the_batch(spark):
    r = random.Random(5)
    for trial in range(40):
        values = [(e, r.choice([r.random(), float("nan"), 0.5])) for e in range(1, 80)]
        order = sorted(values, key=lambda x: x[0] + r.random() * r.choice([0, 5, 39]))
        got, handle = alerts(order, 4)
        df = spark.createDataFrame([("r", e, v) for e, v in values], "run_name string, epoch long, value double")
        if trial < 6:
            want = [(x["run_name"], x["stop_epoch"], x["best"]) for x in sequence.early_stop(df, 4).where("stop_epoch is not null").collect()]
            assert got == want
        assert len(got) <= 1
        assert handle.value.now is None and not handle.map and not handle.timers  # nothing is left of a run that is over


def test_epochs_wait_in_pieces():
    """A batch of a run's epochs is an entry of the state, not one for each; a later value of an epoch counts."""
    work, handle = jobs.EarlyStopInOrder(3, "min", 1e-5, 10**9), Handle()
    work.init(handle)
    batch = lambda es, v: iter([pd.DataFrame({"ts": [pd.Timestamp(1000 * e, unit="ms") for e in es], "epoch": es, "value": [v(e) for e in es]})])
    list(work.handleInputRows(("r",), batch(list(range(2, 9000, 2)), lambda e: 1.0), Times(0)))
    assert len(handle.map) == 2
    list(work.handleInputRows(("r",), batch([*range(1, 9000, 2), 4], lambda e: 0.5 if e == 4 else 1.0), Times(0)))
    assert len(handle.map) == 4
    out = [x for now in (3000, 5000, 9000) for part in work.handleExpiredTimer(("r",), Times(now), None) for x in part.itertuples(index=False, name=None)]
    assert out == [("r", 7, 0.5)]


def test_page_ten_thousand_opens_two_files_at_most(spark, folder):
    made = history.History(spark, f"{folder}/h")
    rows = spark.range(20_000).select("id", F.timestamp_seconds(F.col("id") % 5000 + 1_700_000_000).alias("created_at"), F.concat(F.lit("Text "), "id").alias("text"), F.lit("a%b.png").alias("original_filename"))
    made.create(rows, 16)
    order = [r["id"] for r in rows.orderBy(F.desc("created_at"), F.desc("id")).collect()]
    for offset, size in ((0, 2), (19_998, 2), (10_000, 50), (1249, 3), (19_999, 10), (20_000, 5), (30_000, 5)):
        page = made.page(offset, size)
        assert [r["id"] for r in page.collect()] == order[offset : offset + size]
        assert len(page.inputFiles()) <= 2
    cursor, seen = None, []
    for _ in range(4):
        page, files = made.after(cursor, 200)
        got = page.collect()
        cursor, seen = got[-1]["place"], seen + [r["id"] for r in got]
        assert len(files) <= 2
    assert seen == order[:800]
    page, files = made.after(history_place(order[10_000], rows), 200)
    assert [r["id"] for r in page.collect()] == order[10_001:10_201] and len(files) <= 2
    assert made.after(history_place(order[-1], rows), 5)[0].isEmpty()


def history_place(id_, rows):
    return rows.where(F.col("id") == id_).select(history.place_of(F.col("created_at"), F.col("id")).alias("p")).first()["p"]


def test_search_skips_files_without_the_trigrams(spark, folder):
    made = history.History(spark, f"{folder}/h")
    word = F.when(F.col("id") == 4321, "needle ÄÖ").when(F.col("id") % 1000 == 7, "ab").otherwise("plain hay")
    rows = spark.range(8000).select("id", F.timestamp_seconds("id").alias("created_at"), F.concat(word, F.lit(" of "), F.col("id")).alias("text"), F.lit(None).cast("string").alias("original_filename"))
    made.create(rows, 16)
    for text in ("NEEDLE", "n__dle", "eed%äö", "ab o", "4321", "ab", "%", "no such thing", "7999"):
        got = sorted(r["id"] for r in made.search(text).collect())
        assert got == sorted(r["id"] for r in runs.search(rows, text=text).collect()), text
    assert len(made.candidates("needle")) == 1 and made.candidates("no such thing") == [] and made.candidates("ab") is None


def test_percentiles_like_the_built_in(spark):
    r = random.Random(4)
    values = [r.choice([r.lognormvariate(0, 9), r.gauss(0, 1), float(r.randrange(5)), -1e308, 1e308, 5e-324, -0.0, 0.0]) for _ in range(4000)]
    rows = [(r.choice(["a", "b", None]), v, r.randrange(0, 6)) for v in values] + [("one", 3.5, 1), ("none", None, 4), ("none", 1.0, 0), ("two", 1.0, 1), ("two", 2.0, 1)]
    df = spark.createDataFrame(rows, "k string, v double, w int")
    at = {"low": 0.0, "q": 0.123, "mid": 0.5, "high": 0.95, "top": 1.0}
    got = {x["k"]: tuple(x[n] for n in at) for x in quantiles.exact_percentiles(df, ["k"], F.col("v"), F.col("w"), at).collect()}
    want = df.where("v is not null and w > 0").groupBy("k").agg(*[F.percentile("v", p, F.col("w")).alias(n) for n, p in at.items()]).collect()
    assert set(got) == {x["k"] for x in want} and "none" not in got
    for x in want:
        assert got[x["k"]] == pytest.approx(tuple(x[n] for n in at), rel=1e-12, abs=1e-300)
    whole = quantiles.exact_percentiles(df, [], F.col("v"), F.col("w"), {"mid": 0.5}).first()["mid"]
    assert whole == pytest.approx(df.where("w > 0").agg(F.percentile("v", 0.5, F.col("w"))).first()[0])
    assert quantiles.exact_percentiles(df.limit(0), [], F.col("v"), F.col("w"), {"mid": 0.5}).first()["mid"] is None
    assert quantiles.exact_percentiles(df.limit(0), ["k"], F.col("v"), F.col("w"), {"mid": 0.5}).count() == 0


def test_the_input_of_sliding_statistics_is_not_one_task(spark, monkeypatch):
    from scribe import catalogue_state

    paths = []
    monkeypatch.setattr(catalogue_state, "scratch", lambda spark, tag, real=catalogue_state.scratch: paths.append(real(spark, tag)) or paths[-1])
    catalogue_state.stream_sliding_statistics(spark, "/root/testdata/sf0.001")
    assert len(spark.read.parquet(f"{paths[0]}/in/part=0").inputFiles()) > 1
