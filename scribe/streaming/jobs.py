"""Streaming forms of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from scribe.functions.text import Charset
from scribe.operators import corpus, runs


def rolling_statistics(requests: DataFrame, length: str = "7 days", slide: str | None = "1 day", late: str = "1 day") -> DataFrame:
    """requests(created_at, model_id, total_ms, confidence) -> counts and means by window and model, for append mode."""
    window = F.window("created_at", length, slide) if slide else F.window("created_at", length)
    out = requests.withWatermark("created_at", late).groupBy(window.alias("window"), "model_id")
    return out.agg(F.count(F.lit(1)).alias("requests"), F.avg("total_ms").alias("avg_total_ms"), F.avg("confidence").alias("avg_confidence")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "model_id", "requests", "avg_total_ms", "avg_confidence")


def daily_statistics(requests: DataFrame, late: str = "1 day") -> DataFrame:
    return rolling_statistics(requests, "1 day", None, late)


def sliding_statistics(requests: DataFrame, days: int = 7, late: str = "1 day") -> DataFrame:
    """The counts and means of rolling_statistics() over `days` days that end with each day.

    Requests are added up by day first; a closed day's one row for each model then goes to the `days` windows that hold
    it. So no request is copied, and the state is a row for each open day and for each open window.
    """
    part = requests.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day").alias("day"), "model_id")
    sums = [F.count(F.lit(1)).alias("requests"), F.sum("total_ms").alias("ms"), F.count("total_ms").alias("timed"), F.sum("confidence").alias("sure"), F.count("confidence").alias("rated")]
    by_day = part.agg(*sums).select(F.window_time("day").alias("at"), "model_id", "requests", "ms", "timed", "sure", "rated")
    out = by_day.groupBy(F.window("at", f"{days} days", "1 day").alias("window"), "model_id")
    mean = lambda a, b: F.try_divide(F.sum(a), F.sum(b))
    out = out.agg(F.sum("requests").alias("requests"), mean("ms", "timed").alias("avg_total_ms"), mean("sure", "rated").alias("avg_confidence"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "model_id", "requests", "avg_total_ms", "avg_confidence")


def job_progress(events: DataFrame, path: str) -> DataStreamWriter:
    """Keeps the latest state of every job: each micro-batch writes the states of the jobs that it touches, merged.

    Parts are numbered by micro-batch and a merge reads earlier ones only, so a batch that is run again writes the same
    part again. read_jobs() takes each job's newest state.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fields = [c for c in batch.columns if c not in ("job_id", "ts", "history_entry")]
        now = runs.upsert_jobs(batch).select("job_id", "ts", *fields, "history")
        if number > 0:
            before = newest(spark.read.parquet(path).where(F.col("batch") < number).join(batch.select("job_id").distinct(), "job_id", "left_semi"))
            both = before.withColumn("new", F.lit(0)).unionByName(now.withColumn("new", F.lit(1)))
            latest = [F.max(F.when(F.col(c).isNotNull(), F.struct("new", "ts", F.col(c))))[c].alias(c) for c in fields]
            history = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("new", "history"))), lambda h: h["history"]))
            now = both.groupBy("job_id").agg(F.max("ts").alias("ts"), *latest, history.alias("history"))
        now.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(merge)


def newest(states: DataFrame) -> DataFrame:
    """states(job_id, batch, ...) -> each job's row of its last batch."""
    held = [c for c in states.columns if c not in ("job_id", "batch")]
    last = states.groupBy("job_id").agg(F.max_by(F.struct(*held), "batch").alias("s"))
    return last.select("job_id", *[F.col(f"s.{c}").alias(c) for c in held])


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of every job that job_progress() has written."""
    return newest(spark.read.parquet(path))


class EarlyStop(StatefulProcessor):
    """One run's best value and how many epochs have passed without a better one; says once when to stop."""

    def __init__(self, patience: int, mode: str = "min", min_delta: float = 1e-5):
        self.patience, self.mode, self.min_delta = patience, mode, min_delta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "best double, waited int, stopped boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, waited, stopped = self.state.get() if self.state.exists() else (None, 0, False)
        out, sign = [], 1 if self.mode == "min" else -1
        for epoch, value in sorted((int(e), v) for part in rows for e, v in zip(part["epoch"], part["value"])):
            if stopped or value is None or not abs(value) < float("inf"):
                continue
            if best is None or sign * value < sign * best - self.min_delta:
                best, waited = float(value), 0
            else:
                waited += 1
                if self.patience >= 1 and waited >= self.patience:
                    stopped = True
                    out.append((key[0], epoch, best))
        self.state.update((best, waited, stopped))
        if out:
            yield pd.DataFrame(out, columns=["run_name", "stop_epoch", "best"])

    def close(self) -> None:
        pass


def early_stop_alerts(epochs: DataFrame, patience: int, mode: str = "min", min_delta: float = 1e-5) -> DataFrame:
    """epochs(run_name, epoch, value) -> (run_name, stop_epoch, best), one row when a run should stop.

    Epochs of a run must come in order across micro-batches. The state is three values for each run. The session needs
    the RocksDB state store.
    """
    return epochs.groupBy("run_name").transformWithStateInPandas(EarlyStop(patience, mode, min_delta), "run_name string, stop_epoch long, best double", "Append", "None")


class EarlyStopInOrder(StatefulProcessor):
    """EarlyStop for epochs that come in any order: each waits until event time has passed it.

    State of a run: its epochs that wait (a map of sorted pieces by their earliest time), the values of the fold, and one
    timer. When the watermark passes the earliest waiting epoch, all epochs that it has passed are folded in order. A run
    of which nothing has come for `idle` milliseconds leaves no state.
    """

    #: Epochs in one entry of the map; an entry costs a round trip to the state store.
    PIECE = 4096

    def __init__(self, patience: int, mode: str, min_delta: float, idle: int):
        self.fold, self.idle = (patience, mode, min_delta), idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", "best double, waited int, stopped boolean, last long, timer long, pieces long")
        self.held = handle.getMapState("held", "least long, piece long", "at array<long>, epoch array<long>, value array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, waited, stopped, last, timer, pieces = self.state.get() if self.state.exists() else (None, 0, False, 0, 0, 0)
        new = []
        for part in rows:
            for at, epoch, value in zip(part["ts"], part["epoch"], part["value"]):
                at = int(at.timestamp() * 1000)
                last = max(last, at)
                if not stopped and value is not None and abs(value) < float("inf"):
                    new.append((at, int(epoch), float(value)))
        pieces = self.hold(new, pieces)
        self.state.update((best, waited, stopped, last, self.wake(timer, last, timerValues), pieces))
        yield from ()

    def hold(self, new: list[tuple[int, int, float]], pieces: int) -> int:
        """Puts (at, epoch, value) into the map; a later piece counts if an epoch comes twice."""
        new.sort(key=lambda x: x[0])  # stable: of a time and epoch the last that came stays last
        for k in range(0, len(new), self.PIECE):
            at, epoch, value = map(list, zip(*new[k : k + self.PIECE]))
            self.held.updateValue((at[0], pieces), (at, epoch, value))
            pieces += 1
        return pieces

    def wake(self, timer: int, last: int, timerValues) -> int:
        """Sets the timer to the earliest waiting epoch, or to where the run has been idle for long enough."""
        waiting = [at for at, _ in self.held.keys()]
        due = max(min(waiting) if waiting else last + self.idle, timerValues.getCurrentWatermarkInMs() + 1)
        if timer != due:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        return due

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        now = timerValues.getCurrentWatermarkInMs()
        best, waited, stopped, last, _, pieces = self.state.get()
        (patience, mode, min_delta), out = self.fold, []
        sign = 1 if mode == "min" else -1
        waiting: dict = {}
        opened = sorted(((piece, least), held) for (least, piece), held in self.held.iterator() if least <= now)
        for (piece, least), held in opened:
            self.held.removeKey((least, piece))
            rows = list(zip(*held))
            waiting.update({(epoch, at): value for at, epoch, value in rows if at <= now})
            later = [x for x in rows if x[0] > now]
            if later and not stopped:  # under its own number, so that later pieces still count before it
                self.held.updateValue((later[0][0], piece), tuple(map(list, zip(*later))))
        passed = sorted(waiting.items())
        for (epoch, _), value in passed:
            if stopped:
                break
            if best is None or sign * value < sign * best - min_delta:
                best, waited = value, 0
            else:
                waited += 1
                if 1 <= patience <= waited:
                    stopped = True
                    out.append((key[0], epoch, best))
        if not passed and now >= last + self.idle:
            self.state.clear()
        else:
            self.state.update((best, waited, stopped, last, self.wake(0, last, timerValues), pieces))
        if out:
            yield pd.DataFrame(out, columns=["run_name", "stop_epoch", "best"])

    def close(self) -> None:
        pass


def early_stop_in_any_order(epochs: DataFrame, patience: int, mode: str = "min", min_delta: float = 1e-5, late: str = "1 hour", idle_days: float = 7) -> DataFrame:
    """epochs(run_name, epoch, value, ts) -> (run_name, stop_epoch, best), one row when a run should stop.

    Within `late` epochs may come in any order, also over micro-batches; those that come later still are left out. Times
    must rise with epochs. An alert comes when the watermark has passed its epoch. The session needs the RocksDB state store.
    """
    rows = epochs.select("run_name", "epoch", "value", "ts").withWatermark("ts", late)
    work = EarlyStopInOrder(patience, mode, min_delta, int(idle_days * 86_400_000))
    return rows.groupBy("run_name").transformWithStateInPandas(work, "run_name string, stop_epoch long, best double", "Append", "EventTime")


def ingest(labels: DataFrame, charset: Charset, most: int, good: str, rejected: str) -> DataStreamWriter:
    """Cleans labels(path, label) as they come, with the batch rules, into a table of good rows and one of rejects."""
    cleaned = corpus.clean_labels(labels, charset, most)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        corpus.accepted(batch).write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.where("reason is not null").select("path", "label", "reason").write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        batch.unpersist()

    return cleaned.writeStream.foreachBatch(write)


