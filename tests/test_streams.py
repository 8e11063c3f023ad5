"""Streams over several micro-batches, late and replayed rows among them, against the batch rules."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessellum.operators import windows as W
from tessellum.streaming import state as T

DAY0 = dt.datetime(2026, 1, 1)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", T.ROCKSDB)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def fed(spark, tmp_path, schema, batches, made, out):
    """One micro-batch for each list of rows."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
        made(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out).parquet(str(tmp_path / "out"))


def test_streaks_of_shuffled_batches(rocks, tmp_path):
    rng = random.Random(1)
    rows = [(v, DAY0 + dt.timedelta(hours=h), rng.choice(["LIKELY_DEAD", "LIKELY_DEAD", "NO_CHANGE", None])) for v in ("a", "b", "c") for h in range(24)]
    early = rows[:]
    rng.shuffle(early)
    batches = [early[:30], early[30:50], early[50:], [("z", DAY0 + dt.timedelta(days=30), "NO_CHANGE")]]
    found = fed(rocks, tmp_path, "variable string, run_ts timestamp, verdict string", batches, T.late_streak_stream, T.STREAK)
    expected = W.closing(rocks.createDataFrame(rows, "variable string, run_ts timestamp, verdict string"))
    key = lambda r: (r["variable"], r["run_ts"], r["consecutive"], r["close"])
    assert sorted(map(key, found.collect())) == sorted(map(key, expected.where("consecutive > 0 and verdict is not null").collect()))


def test_promotion_by_timer(rocks, tmp_path):
    at = lambda d: DAY0 + dt.timedelta(days=d)
    batches = [[("slow", "state", at(5)), ("quick", "event", at(5)), ("mixed", "state", at(5))], [("slow", "state", at(1)), ("mixed", "event", at(8)), ("quick", "event", at(9))], [("late", "state", at(12))], [("slow", "state", at(16)), ("clock", "state", at(30))], [("slow", "state", at(40)), ("clock", "state", at(41))]]
    found = fed(rocks, tmp_path, "candidate string, kind string, ts timestamp", batches, lambda s: T.promotion_stream(s, late="10 days"), "candidate string, first_seen timestamp, promote_at timestamp")
    assert sorted(map(tuple, found.collect())) == [("late", at(12), at(26)), ("mixed", at(5), at(8)), ("quick", at(5), at(5)), ("slow", at(1), at(15))]


def test_notified_once_for_good(spark, tmp_path):
    sink = T.notify_once(str(tmp_path / "ledger"))
    frame = lambda rows: spark.createDataFrame(rows, "reminder string, ts timestamp")
    years = lambda n: DAY0 + dt.timedelta(days=365 * n)
    sink(frame([("a", years(0)), ("a", years(1)), ("b", years(0)), (None, years(0))]), 0)
    sink(frame([("a", years(12)), ("c", years(12))]), 1)
    sink(frame([("c", years(30)), ("d", years(30))]), 2)
    for n, rows in ((1, [("a", years(12)), ("c", years(12))]), (0, [("a", years(0)), ("a", years(1)), ("b", years(0))])):
        sink(frame(rows), n)  # replays
    found = spark.read.option("basePath", str(tmp_path / "ledger")).parquet(str(tmp_path / "ledger"))
    assert sorted((r["reminder"], r["ts"], r["batch"]) for r in found.collect()) == [("a", years(0), 0), ("b", years(0), 0), ("c", years(12), 1), ("d", years(30), 2)]


def test_replayed_batch_leaves_one_copy(spark, tmp_path):
    rows = spark.createDataFrame([(1, "P0"), (2, "P2"), (3, "P2")], "id long, priority string")
    rows.write.parquet(str(tmp_path / "in"))
    sinks = [T.append_batch(str(tmp_path / name)) for name in ("urgent", "daily", "closing")]
    across = lambda batch, n: sinks[2](batch.groupBy("priority").agg(F.count("*").alias("n")), n)
    for check in ("first", "again"):  # a new checkpoint gives the same rows the same batch id: a replay
        T.by_priority(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), *sinks[:2], str(tmp_path / check), across).awaitTermination()
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    assert [r["id"] for r in read("urgent").collect()] == [1] and sorted(r["id"] for r in read("daily").collect()) == [2, 3]
    assert sorted((r["priority"], r["n"]) for r in read("closing").collect()) == [("P0", 1), ("P2", 2)]
