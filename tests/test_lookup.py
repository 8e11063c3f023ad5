"""The search index against a scan, the walk against a slow one, spoken times and changelogs by example."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from tessellum.functions import scalar as X
from tessellum.operators import graph as G
from tessellum.operators import index as I
from tessellum.operators import ranking as R
from tessellum.operators import sinks as K

AREA = "path string, tags array<string>, title string, body string"


def scan(areas, words):
    return sorted((r["area"], r["path"], r["score"]) for r in R.search(areas, words).collect())


def test_index_equals_scan(spark, tmp_path):
    rng = random.Random(3)
    bits = ["alpha", "Alphabet", "beta", "x" * 40 + "needle" + "y" * 40, "水位上升明显高于往年同期", "abc水位", "铁矿石", "tail,", " ", "é"]
    text = lambda n: "".join(rng.choice(bits) + rng.choice([" ", " ", "\n", ""]) for _ in range(rng.randint(0, n)))
    rows = [(f"p{i:02d}", [rng.choice(["alpha", "水位", "z"])], text(2), text(12)) for i in range(40)] + [("q1", None, None, None), ("q2", [], "", ""), ("q3", ["z", None], None, "beta " * 30_000 + "end")]
    areas = {"a": spark.createDataFrame(rows[:25], AREA), "b": spark.createDataFrame(rows[25:], AREA), "empty": spark.createDataFrame([], AREA)}
    folder = str(tmp_path / "index")
    I.build({"a": areas["a"].withColumn("body", F.lit("alpha beta 水位")), "gone": areas["b"]}, folder, "2026-01-01")
    I.build({"gone": areas["b"].withColumns({"tags": F.lit(None).cast("array<string>"), "title": F.lit(""), "body": F.lit("")})}, folder, "2026-01-02")
    for _ in range(2):  # the same day again leaves one copy
        I.build(areas, folder, "2026-01-03")
    for words in (["alpha"], ["lph", "水位"], ["z"], ["needle", "beta"], ["end"], ["无"]):
        assert sorted((r["area"], r["path"], r["score"]) for r in I.find(spark, folder, words).collect()) == scan(areas, words), words
    for words in (["alpha beta"], ["位上升明显高于"], ["c水"], ["x" * 30 + "needle"], ["tail, ", "alpha"], ["水位上升明显高于往年同期abc"]):
        assert sorted((r["area"], r["path"], r["score"]) for r in I.find(spark, folder, words, areas=areas).collect()) == scan(areas, words), words
        with pytest.raises(ValueError):
            I.find(spark, folder, words)
    with pytest.raises(ValueError):
        I.find(spark, folder, [" "])
    size = lambda names: sum(os.path.getsize(os.path.join(d, f)) for n in names for d, _, fs in os.walk(f"{folder}/postings/day=2026-01-03/{n}") for f in fs)
    read = {r["bucket"] for r in I.looked_up(spark, folder, ["needle"]).collect()}
    assert 0 < size([f"bucket={b}" for b in read]) < size([""]) / 3


def slow_walk(edges, anchors, soft, hard):
    """Every path, a hop at a time."""
    best = {(a, "anchor"): (0, [(a, "anchor")]) for a in anchors}
    now, left = dict(best), {}
    for hop in range(1, hard + 2):
        new = {}
        for (node, _), (_, path) in now.items():
            for src, dst, way, reason in edges:
                if src == node:
                    key, to = (dst, way), path + [(dst, way)]
                    if hop > hard or (hop > soft and reason is None):
                        clue = (hop, to, reason or "", "hard" if hop > hard else "soft")
                        left[key] = min(left.get(key, clue), clue)
                    elif key not in best:
                        new[key] = min(new.get(key, (hop, to)), (hop, to))
        best.update(new)
        now = new
    return best, {k: v for k, v in left.items() if k not in best}


def test_walk(spark):
    rng = random.Random(4)
    ways, schema = ("up", "down", "parallel"), "src long, dst long, way string, reason string"
    edges = sorted({(rng.randrange(30), rng.randrange(30), rng.choice(ways)) for _ in range(55)})
    edges = [(*e, rng.choice([None, None, "why"])) for e in edges] + [(i, i + 1, "up", "far") for i in range(100, 115)]
    frame = spark.createDataFrame(edges + [edges[0][:3] + (None,), (None, 1, "up", "r"), (1, None, "up", "r"), (1, 2, None, "r")], schema)
    anchors = spark.createDataFrame([(0,), (1,), (100,), (0,), (None,)], "node long")
    for soft, hard in ((5, 10), (1, 3), (0, 1)):
        states, clues = G.walk(frame, anchors, soft, hard)
        best, left = slow_walk(edges, (0, 1, 100), soft, hard)
        assert {(r["node"], r["way"]): (r["hop"], [tuple(p) for p in r["path"]]) for r in states.collect()} == best
        assert {(r["node"], r["way"]): (r["hop"], [tuple(p) for p in r["path"]], r["reason"] or "", r["stop"]) for r in clues.collect()} == left
        assert states.count() == len(best) and left
    for states in (*G.walk(frame.limit(0), anchors), *G.walk(frame, anchors.limit(0))):
        assert states.where("hop > 0").count() == 0


def test_reminders_said(spark):
    said = {"下午 3 点": ("15:00", False), "15 点": ("15:00", False), "9点": ("09:00", True), "明天上午 10 点": ("5/18 10:00", False), "后天 9 点": ("5/19 09:00", False), "大后天 9 点 5 分": ("5/20 09:05", False), "下周三 14 点": ("5/20 14:00", False)}
    said |= {"下周日 14 点": ("5/24 14:00", False), "每周五 9 点": ("Fri 09:00", False), "每星期天 9 点半": ("Sun 09:30", False), "每天 8 点": ("08:00", False), "tomorrow at 12:30 am": ("5/18 00:30", False), "day after tomorrow 12 pm": ("5/19 12:00", False)}
    said |= {"every Monday 7pm": ("Mon 19:00", False), "next Sunday 08:15": ("5/24 08:15", False), "every day 6 a.m": ("06:00", False), "27 点": None, "10:75": None, "tomorrow": None, "": None, None: None}
    rows = spark.createDataFrame([(t,) for t in said], "said string").select("said", X.reminder(F.col("said"), F.lit("2026-05-17 14:00:00").cast("timestamp")).alias("x")).collect()
    assert {r["said"]: r["x"] and tuple(r["x"]) for r in rows} == said


def test_changelog_lines(spark):
    changes = spark.createDataFrame([("r1", "P0", "auto-state", "a", None, "y", "T"), ("r1", "P0", "auto-state", "b", "x", "y", None), ("r1", "P2", "fix", "c", "63", "67", None), ("r2", "P9", None, None, None, None, None)], "run_ts string, priority string, action string, entity string, old string, new string, impact string")
    waiting = spark.createDataFrame([("r3", "V302", 2)], "run_ts string, entity string, streak int")
    found = K.changelog_lines(changes, waiting).orderBy("run_ts", "section", F.col("entity").asc_nulls_first()).collect()
    expected = [("r1", "## r1 · sweep\n\n**汇总**：变更 3 条（P0 ×2，P1 ×0，P2 ×1）"), ("r1", "#### P0 实时推送"), ("r1", "- `auto-state a`\n  旧: - / 新: y\n  影响: T"), ("r1", "- `auto-state b`\n  旧: x / 新: y"), ("r1", "#### P2 仅 changelog"), ("r1", "- `fix c` 63 → 67")]
    expected += [("r2", "## r2 · sweep\n\n**汇总**：变更 1 条（P0 ×0，P1 ×0，P2 ×0）"), ("r3", "## r3 · sweep\n\n**汇总**：变更 0 条（P0 ×0，P1 ×0，P2 ×0）"), ("r3", "#### 待二次确认"), ("r3", "- V302（连续 2 次判定失效，待第 3 次确认）")]
    assert [(r["run_ts"], r["line"]) for r in found] == expected
    assert K.changelog_lines(changes.limit(0), waiting.limit(0)).count() == 0


def test_push_tells_outcomes(spark, tmp_path):
    answers = {"a": [200], "b": [500, 201], "c": [500, 500], "d": [403]}
    rows, log, left = spark.createDataFrame([(t,) for t in answers], "text string"), str(tmp_path / "log"), {}
    for _ in range(2):  # a batch that comes again leaves one copy
        left.update({k: list(v) for k, v in answers.items()})
        K.push(lambda text: left[text].pop(0), 0.0, log)(rows, 7)
    assert sorted((r["text"], r["attempts"], r["outcome"]) for r in spark.read.parquet(log).collect()) == [("a", 1, "sent"), ("b", 2, "sent"), ("c", 2, "failed"), ("d", 1, "refused")]


def test_closed_week(spark):
    todos = spark.createDataFrame([(1, True, False, "2026-05-01"), (2, False, False, "2026-05-17"), (3, False, False, "2026-05-18"), (4, False, True, "2026-01-01"), (5, None, None, None)], "id long, done boolean, long_term boolean, created string")
    at, names = F.lit("2026-05-20").cast("date"), spark.createDataFrame([("2026-W21-2",), ("2026-W21-99999999999",), (None,)], "name string")
    found = {r["id"]: (r["place"], r["file"]) for r in K.closed_week(todos, names, at).collect()}
    assert found == {1: ("done", "2026-W21"), 2: ("deferred", "2026-W21"), 3: ("active", None), 4: ("active", None), 5: ("active", None)}
    assert {r["place"] for r in K.closed_week(todos.where("id > 1"), names, at).collect()} == {"active"}
    assert K.closed_week(todos.limit(0), names, at).count() == 0


def test_texts_are_dealt_not_postings(spark, tmp_path):
    """Every word of every document was shuffled to its bucket, several times the texts."""
    docs = spark.createDataFrame([(f"p{i}", ["t"], "alpha", " ".join(f"w{i % 7}x{k}" for k in range(100))) for i in range(200)] + [(None, ["t"], "alpha", "beta")], AREA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        I.build({"a": docs}, str(tmp_path), "2026-01-01")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = spark.read.schema(I.POSTINGS).parquet(f"{tmp_path}/postings")
    assert found.count() == 200 * 102
    # a document's postings are written by one task, whatever their buckets
    tasks = found.select("path", F.regexp_extract(F.input_file_name(), "part-([0-9]+)-", 1).alias("task")).distinct()
    assert tasks.count() == 200 and tasks.select("task").distinct().count() > 1
