"""Streams (T01-T12): keyed state, a notified ledger, delayed promotion, and catch-up by a pure function of the clock."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STREAK = "variable string, run_ts timestamp, consecutive int, close boolean"


def due_runs(tasks: DataFrame, as_of: Column) -> DataFrame:
    """Tasks whose latest due time has come since their last run, each once however many ticks were missed.

    tasks: (task, at 'HH:mm', last_run timestamp or null).
    """
    today = F.to_timestamp(F.concat(F.date_format(as_of, "yyyy-MM-dd"), F.lit(" "), F.col("at")), "yyyy-MM-dd HH:mm")
    latest = F.when(today <= as_of, today).otherwise(today - F.expr("interval 1 day"))
    return tasks.withColumn("due", latest).where(F.col("last_run").isNull() | (F.col("last_run") < F.col("due")))


def gated(rows: DataFrame, cheap: Column, heavy) -> DataFrame:
    """The heavy stage over what a cheap filter leaves."""
    return heavy(rows.where(cheap))


def streak_stream(probes: DataFrame, needed: int = 3) -> DataFrame:
    """The count of LIKELY_DEAD in a row of each variable, kept over batches that bring the runs in order (late_streak_stream: in any).

    probes: a stream of (variable, run_ts, verdict). A failed probe (null) leaves the count, any other
    verdict resets it. State is one number per variable.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        count = state.get[0] if state.exists else 0
        out = []
        for row in pd.concat(list(frames)).sort_values("run_ts").itertuples():
            if row.verdict is None or pd.isna(row.verdict):
                continue
            count = count + 1 if row.verdict == "LIKELY_DEAD" else 0
            if count:
                out.append((key[0], row.run_ts, count, count >= needed))
        state.update((count,))
        yield pd.DataFrame(out, columns=["variable", "run_ts", "consecutive", "close"])

    return probes.groupBy("variable").applyInPandasWithState(step, STREAK, "n int", "append", "NoTimeout")


#: Keyed state with timers needs this provider of the session (spark.sql.streaming.stateStore.providerClass).
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = pd.Timestamp("1970-01-01", tz="UTC")


def _millis(ts: pd.Timestamp) -> int:
    """Milliseconds of a UTC time since 1970, rounded up, so that a timer never fires before it."""
    ts = pd.Timestamp(ts)
    ts = ts.tz_localize("UTC") if ts.tzinfo is None else ts.tz_convert("UTC")
    return -int((_EPOCH - ts) // pd.Timedelta(milliseconds=1))


class _Streaks(StatefulProcessor):
    """Holds a key's probes until the watermark has passed them, then counts them in order of their time."""

    def __init__(self, needed: int):
        self.needed = needed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "run_ts timestamp, verdict string")
        self.count = handle.getValueState("count", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            told = frame[frame["verdict"].notna()]
            if len(told):
                self.held.appendList([(ts.to_pydatetime(), verdict) for ts, verdict in zip(told["run_ts"], told["verdict"])])
                self.handle.registerTimer(_millis(told["run_ts"].min()))
        yield from ()  # an empty frame for each key costs more than its rows

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, count = timerValues.getCurrentWatermarkInMs(), (self.count.get() or (0,))[0]
        upto = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=now)
        passed = lambda ts: ts <= upto if ts.tzinfo is None else _millis(ts) <= now
        held, out = list(self.held.get()), []
        due = sorted(r for r in held if passed(r[0]))
        if due:
            left = [r for r in held if not passed(r[0])]
            self.held.put(left) if left else self.held.clear()
            if left:
                self.handle.registerTimer(min(_millis(r[0]) for r in left))
            for ts, verdict in due:
                count = count + 1 if verdict == "LIKELY_DEAD" else 0
                if count:
                    out.append((key[0], ts, count, count >= self.needed))
            self.count.update((count,))
        if out:
            yield pd.DataFrame(out, columns=["variable", "run_ts", "consecutive", "close"])

    def close(self) -> None:
        pass


def late_streak_stream(probes: DataFrame, needed: int = 3, late: str = "7 days") -> DataFrame:
    """The streaks of streak_stream(), whatever order batches bring the runs in.

    probes: a stream of (variable, run_ts, verdict). A run is held until the watermark, `late` behind the latest, has
    passed it, and is then counted in its place; so runs that come late across batches count as in the batch operator. A
    failed probe (null) leaves the count, any other verdict resets it. State is one number a variable and the runs of
    `late`. A run later than that is dropped; the last runs of a stream are counted once later ones of any variable come.
    """
    rows = probes.withWatermark("run_ts", late)
    return rows.groupBy("variable").transformWithStateInPandas(_Streaks(needed), STREAK, "Append", "EventTime")


def notified_once(reminders: DataFrame, key: str = "reminder", ts: str = "ts", within: str = "7 days") -> DataFrame:
    """Each reminder at most once within a watermark, which bounds the state; notify_once() remembers without end."""
    return reminders.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def append_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that a replay leaves as it was: each batch has a folder of its own, written over when it comes again."""

    def batch(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return batch


def notify_once(ledger: str, key: str = "reminder", ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps, batch by batch, the reminders never notified before, however long ago.

    The ledger is a table partitioned by batch. A batch is held against earlier batches alone and written over when it is
    replayed, so a replay leaves one copy; of rows of one key the earliest stays. What it has written is what may be sent.
    """

    def batch(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rows.columns), ts).alias("row")).select("row.*")
        rows.limit(0).write.mode("overwrite").parquet(f"{ledger}/batch=-1")  # there is always something to read
        before = spark.read.schema(f"`{key}` {rows.schema[key].dataType.simpleString()}, batch long").option("basePath", ledger).parquet(ledger).where(F.col("batch") < n)
        append_batch(ledger)(first.join(before.select(key), key, "left_anti").select(*rows.columns), n)

    return batch


class _Promotion(StatefulProcessor):
    """Remembers when a candidate was first seen; a timer promotes it, a kind that needs no waiting goes at once."""

    def __init__(self, days: int, at_once: tuple[str, ...]):
        self.wait, self.at_once = pd.Timedelta(days=days), at_once

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first_seen timestamp, done boolean")

    def _promoted(self, key, first, at) -> pd.DataFrame:
        self.seen.update((first, True))
        return pd.DataFrame([(key[0], first, at)], columns=["candidate", "first_seen", "promote_at"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, done = self.seen.get() if self.seen.exists() else (None, False)
        for frame in rows:
            if done or not len(frame):
                continue
            least = frame["ts"].min().to_pydatetime()
            if frame["kind"].isin(self.at_once).any():
                done, first = True, least if first is None else min(first, least)
                now = min(frame[frame["kind"].isin(self.at_once)]["ts"].min(), pd.Timestamp(first) + self.wait).to_pydatetime()
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                yield self._promoted(key, first, now)
            elif first is None or least < first:
                for timer in list(self.handle.listTimers()) if first is not None else ():
                    self.handle.deleteTimer(timer)
                first = least
                self.seen.update((first, False))
                self.handle.registerTimer(_millis(pd.Timestamp(first) + self.wait))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, done = self.seen.get()
        if not done:
            yield self._promoted(key, first, (pd.Timestamp(first) + self.wait).to_pydatetime())

    def close(self) -> None:
        pass


def promotion_stream(sightings: DataFrame, days: int = 14, at_once: tuple[str, ...] = ("event",), late: str = "7 days") -> DataFrame:
    """(candidate, first_seen, promote_at), once for each candidate, when the watermark passes `days` after its first sighting.

    sightings: a stream of (candidate, kind, ts). A sighting that comes late moves the first one, and its timer, back; a kind
    of at_once is promoted with its first sighting, if that comes before the wait is over. State is one time and a mark a candidate, kept so that none is promoted twice.
    """
    rows = sightings.where("candidate is not null and ts is not null").withWatermark("ts", late)
    return rows.groupBy("candidate").transformWithStateInPandas(_Promotion(days, at_once), "candidate string, first_seen timestamp, promote_at timestamp", "Append", "EventTime")


def promoted_later(sightings: DataFrame, days: int = 14) -> DataFrame:
    """Candidates with when they may be promoted; a late sighting moves the first one back, none is dropped."""
    return sightings.groupBy("candidate").agg(F.min("ts").alias("first_seen"), F.count("*").alias("sightings")).withColumn("promote_at", F.col("first_seen") + F.expr(f"interval {days} days"))


def change_stream(changes: DataFrame, path: str, checkpoint: str):
    """Changes appended to a table; what has arrived is processed, then the query ends."""
    return changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def by_priority(changes: DataFrame, urgent: Callable, daily: Callable, checkpoint: str, closing: Callable | None = None):
    """Urgent changes to one sink at once, the others to a daily one; `closing` then works across the items of the batch.

    All are called with (rows, batch id) and, as append_batch() does, must leave a batch that comes again as it was.
    """

    def batch(rows: DataFrame, n: int) -> None:
        rows = rows.persist()
        urgent(rows.where("priority = 'P0'"), n)
        daily(rows.where("priority <> 'P0'"), n)
        if closing is not None:
            closing(rows, n)
        rows.unpersist()

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def carried(states: DataFrame, results: DataFrame, key: str = "variable") -> DataFrame:
    """States with this run's results; what failed keeps its state and is tried again."""
    rows = states.join(results.select(key, F.col("state").alias("_new")), key, "left")
    return rows.withColumn("retry", F.col("_new").isNull()).withColumn("state", F.coalesce("_new", "state")).drop("_new")
