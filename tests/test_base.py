"""Readers, scalars, filters, joins, windows, sinks and streams on small fixtures."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessellum.functions import scalar as X
from tessellum.operators import aggregates as A
from tessellum.operators import filters as FL
from tessellum.operators import graph as G
from tessellum.operators import joins as J
from tessellum.operators import ranking as R
from tessellum.operators import sinks as K
from tessellum.operators import windows as W
from tessellum.plans import verbs
from tessellum.sources import markdown as M
from tessellum.streaming import state as T

D = dt.date
CARD = "---\ntitle: \"A Card\"\ndate: 2026-01-05\ntags: [ai, chips]\nstatus: open\n---\nAbove\n## One\ntext [[alpha]] and [b](raw/b.md)\n### Two\nmore\n"


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("base")
    for path, text in {"wiki/sources/a.md": CARD, "decisions/d.md": "no header", "todos/active.md": "# Work\n- [ ] call Bob `created: 2026-01-02` `remind: 09:30`\n- [x] done\n## Home\n- ⏰ wake `alarm: Mon 07:00`\n"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return M.scan(spark, str(root))


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_scan_and_headers(base):
    parsed = M.headers(base)
    assert sorted(values(parsed, "kind")) == [("decision",), ("source",), ("todo",)]
    meta = M.meta(parsed.where("kind = 'source'"), "title", "tags", "missing").select("title", M.list_of(F.col("tags")), "missing").first()
    assert tuple(meta) == ("A Card", ["ai", "chips"], None)
    assert values(M.sections(parsed.where("kind = 'source'")).orderBy("ord"), "ord", "level", "heading") == [(0, 0, None), (1, 2, "One"), (2, 3, "Two")]


def test_tasks(base):
    rows = values(M.tasks(M.headers(base).where("kind = 'todo'")).orderBy("ord"), "section", "checked", "text", "remind", "created")
    assert rows == [("Work", False, "call Bob", "09:30", "2026-01-02"), ("Work", True, "done", None, None), ("Home", None, "wake", "Mon 07:00", None)]


def test_state_and_settings(spark):
    docs = spark.createDataFrame([('{"pending_close": [{"variable_id": "V1", "consecutive_likely_dead": 2}]}',), ("{broken",)], "text string")
    assert values(M.staging(docs), "variable_id", "consecutive_likely_dead") == [("V1", 2)]
    lines = spark.createDataFrame([("A=1 # x",), ("# B=2",), ('export C="q"',), ("A=3",)], "value string").coalesce(1)
    assert sorted(values(M.settings(lines, {"D": "9", "A": "0"}), "key", "value")) == [("A", "3"), ("C", "q"), ("D", "9")]
    assert values(M.last_runs(spark.createDataFrame([("t=5 # a",), ("t=9",), ("bad",)], "value string")), "task", "epoch") == [("t", 9)]


def test_handover(spark, tmp_path):
    (tmp_path / "x").write_text("p|t|2026-01-02\nbad|line|nodate\n")
    assert values(M.handed_over(spark, str(tmp_path / "x")), "path", "review_date") == [("p", D(2026, 1, 2))]
    (tmp_path / "y").write_text("bad|line|nodate\n")
    with pytest.raises(ValueError):
        M.handed_over(spark, str(tmp_path / "y"))


def test_chapters(spark):
    rows = spark.createDataFrame([("# A\nx\n# B\ny",), ("plain",)], "text string")
    spark.udtf.register("chapters", M.Chapters)
    rows.createOrReplaceTempView("books")
    assert [tuple(r) for r in spark.sql("select number, title from books, lateral chapters(text) order by title").collect()] == [("000", "A"), ("001", "B"), ("000", "plain")]


def test_scalars(spark):
    one = spark.range(1)
    get = lambda *e: tuple(one.select(*e).first())
    day = F.lit("2027-01-01").cast("date")
    assert get(X.slug(F.lit("The Big, New Chip of 2026!")), X.slug_any(F.lit("芯片 2026"))) == ("the-big-new-chip", "芯片-2026")
    assert get(X.iso_week(day), X.week_start(day), X.weekday(day)) == ("2026-W53", D(2026, 12, 28), "Fri")
    assert get(X.wiki_links(F.lit("[[a|b]] [[c]]")), X.markdown_links(F.lit("[t](p)"))) == (["a", "c"], ["p"])
    assert [len(get(X.cut(F.lit("x" * n)))[0]) for n in (4096, 4097)] == [4096, 4096]
    assert get(X.toggled(F.lit("- [ ] a")), X.toggled(F.lit("- [x] a")), X.is_checked(F.lit("text"))) == ("- [x] a", "- [ ] a", None)
    assert get(X.resolve_day(F.lit("next Wednesday"), day), X.resolve_day(F.lit("tomorrow"), day)) == (D(2027, 1, 6), D(2027, 1, 2))
    assert get(X.change(F.lit(3.0), F.lit(0.0)), X.progress_bar(F.lit(4), F.lit(10))) == (None, "####------ 4/10")
    assert get(X.verdict_of(F.lit("{bad")))[0]["verdict"] is None
    assert get(X.enum_of(F.lit(" Open "), {"open": "open"}), X.enum_of(F.lit("x"), {"open": "open"})) == ("open", None)


def test_filters(spark):
    rows = spark.createDataFrame([(1, "open", D(2026, 1, 5), ["work"]), (2, "open", D(2026, 1, 6), ["x"]), (3, None, None, ["x"])], "id int, status string, review_date date, tags array<string>")
    day = F.lit("2026-01-05").cast("date")
    assert values(FL.due(rows, day), "id") == [(1,)]
    assert values(FL.due_by_tag(rows, day, ["none"]), "id") == [(1,)]
    assert values(FL.due_by_tag(rows.withColumn("tags", F.lit(None).cast("array<string>")), day, ["none"]), "id") == [(1,)]
    whole, bad = FL.quarantined(rows)
    assert whole.count() == 2 and values(bad, "lacking") == [(["status", "review_date"],)]
    guards = spark.createDataFrame([(n,) for n in (99, 100, 499, 500, 10000, 10001)], "n int")
    assert [r[0] for r in guards.select(FL.content_guard(F.col("n"), F.lit(True))).collect()] == ["confirm", "suspicious", "suspicious", "normal", "normal", "long"]
    now = F.lit("2026-01-05 09:30:00").cast("timestamp")
    specs = spark.createDataFrame([("09:30",), ("Mon 09:30",), ("Tue 09:30",), ("1/5 09:30",), ("soon",)], "s string")
    assert [r[0] for r in specs.select(FL.reminder_due(F.col("s"), now)).collect()] == [True, True, False, True, None]
    routed = FL.routed(spark.createDataFrame([("LIKELY_DEAD", "low"), ("STATE_CHANGED", "high"), ("STATE_CHANGED", "low")], "verdict string, confidence string"))
    assert [r[0] for r in routed.select("route").collect()] == ["staging", "deep_first", "deep"]
    reports = spark.createDataFrame([("r", {"topic": "t", "direction": "up"}, ["A", "C"])], "slug string, fields map<string,string>, sections array<string>")
    assert sorted(values(FL.violations(reports, ["topic", "status"], ["A", "B"]), "kind", "what")) == [("direction", "up"), ("header", "status"), ("section_foreign", "C"), ("section_missing", "B")]
    pool = spark.createDataFrame([("a", 2, 0, 0, True, False, "state", D(2026, 1, 1)), ("b", 2, 0, 0, True, False, "state", D(2026, 1, 2)), ("c", 1, 1, 1, True, False, "event", D(2026, 1, 15))], "name string, sources int, authoritative int, community int, quantifiable boolean, covered boolean, lifecycle string, first_seen date")
    assert values(FL.promoted(pool, F.lit("2026-01-15").cast("date")).orderBy("name"), "name") == [("a",), ("c",)]
    changes = spark.createDataFrame([("raw/a", "edit"), ("wiki/a", "edit"), ("wiki/b", "delete")], "path string, action string")
    assert [r[0] for r in FL.allowed_changes(changes).select("rejected").collect()] == [True, False, True]


def test_joins(spark):
    items = spark.createDataFrame([("http://x.org/a/?q",), ("http://x.org/b",)], "url string")
    assert J.known_urls(items, spark.createDataFrame([("http://x.org/a",)], "origin string")).count() == 1
    cards = spark.createDataFrame([(1, "en", "a title of some length"), (2, "en", "a title of sone length!!"), (3, "de", "a title of some length")], "id int, lang string, title string")
    assert J.near_titles(cards, block="lang").count() == 1
    links = spark.createDataFrame([("a.md",), ("gone.md",)], "target string")
    assert values(J.broken_links(links, spark.createDataFrame([("a.md",)], "path string")), "target") == [("gone.md",)]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    assert sorted(values(G.hops(edges, spark.createDataFrame([(1,)], "node int")), "node", "hop")) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    near = G.hops(edges, spark.createDataFrame([(1,)], "node int"), hard=2)
    assert values(G.pending(edges, near, hard=2), "node") == [(4,)]
    assert sorted(values(G.acyclic(edges), "src")) == [(1,), (2,), (3,)]
    assert tuple(spark.range(1).select(X.characters(F.lit(None).cast("string")), X.overlap(F.expr("array('a')"), F.expr("array('a', 'b')"))).first()) == (0, True)
    membership = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "y"), (3, "x")], "member int, item string")
    assert values(J.cross_pairs(membership), "i", "j", "shared") == [(1, 2, 2)]
    user = spark.createDataFrame([("p", "u")], "path string, v string")
    engine = spark.createDataFrame([("p", "e"), ("q", "e")], "path string, v string")
    assert sorted(values(J.settled(user, engine), "path", "v")) == [("p", "u"), ("q", "e")]


def test_windows(spark):
    probes = spark.createDataFrame([("v", i, s) for i, s in enumerate(["LIKELY_DEAD", "LIKELY_DEAD", "ALIVE", "LIKELY_DEAD", None, "LIKELY_DEAD", "LIKELY_DEAD"])], "variable string, run_ts int, verdict string")
    assert values(W.closing(probes).where("close"), "run_ts", "consecutive") == [(6, 3)]
    prices = spark.createDataFrame([("t", D(2026, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate([10, 11, 12, 6])], "target string, day date, value double")
    assert values(W.range_52_weeks(prices, "target").orderBy("day"), "band")[-1] == ("collapse",)
    assert W.moving_average(prices, "target", rows=4).where("mean is not null").count() == 1
    assert values(W.rsi(prices, "target", rows=3).where("rsi is not null"), "rsi") == [(25.0,)]
    days = spark.createDataFrame([(D(2026, 1, 1) + dt.timedelta(i),) for i in range(100)], "day date")
    kept = values(W.retained(days, daily=3, weekly=2, monthly=2), "day")
    assert len(kept) == 5


def test_sinks(spark):
    cards = spark.createDataFrame([(1, "A B", D(2026, 1, 1)), (2, "a b", D(2026, 1, 1))], "id int, title string, date date")
    assert values(K.card_keys(cards).orderBy("id"), "name") == [("2026-01-01-a-b",), ("2026-01-01-a-b-2",)]
    held = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    assert sorted(values(K.upserted(held, spark.createDataFrame([("b", 2), ("c", 3)], "k string, v int"), "k"), "k", "v")) == [("a", 1), ("b", 2), ("c", 3)]
    events = spark.createDataFrame([(1, 1, 1, "add", "x", "low"), (1, 2, 2, "edit", None, "high"), (2, 1, 3, "add", "y", None), (2, 2, 4, "delete", None, None)], "todo int, ts int, seq int, action string, text string, rank string")
    assert values(K.latest_state(events), "todo", "text", "rank", "done") == [(1, "x", "high", False)]
    decisions = spark.createDataFrame([("t", "open", D(2026, 1, 1), "c"), ("u", "closed", D(2026, 1, 1), "c")], "target string, status string, review_date date, context string")
    news = spark.createDataFrame([("t", "n", D(2026, 2, 1)), ("w", "m", D(2026, 2, 1))], "target string, note string, day date")
    assert sorted(values(K.decision_upsert(decisions, news), "target", "review_date", "context")) == [("t", D(2026, 5, 1), "c\nn"), ("u", D(2026, 1, 1), "c"), ("w", D(2026, 5, 1), "m")]
    assert K.notify_line(spark.createDataFrame([], "title string"), "due").count() == 0
    one = spark.range(1)
    assert tuple(one.select(K.retry(F.lit(500), F.lit(1)), K.retry(F.lit(401), F.lit(1)), K.retry(F.lit(500), F.lit(2))).first()) == ("retry_in_3s", "refused", "failed")


def test_push_sends_all(spark):
    sent = []
    K.push(lambda text: sent.append(text) or 200)(spark.range(150).select(F.col("id").cast("string").alias("text")), 0)
    assert sorted(sent, key=int) == [str(i) for i in range(150)]


def test_aggregates_and_search(spark):
    rows = spark.createDataFrame([(i, 10) for i in range(100)], "id int, cost int")
    assert A.within_budget(rows, "cost", "id", 255, width=7).count() == 25
    sightings = spark.createDataFrame([("a", "s1", "authoritative"), ("a", "s1", "community"), ("b", "s1", "x"), ("c", "s1", "x"), ("c", "s2", "x")], "candidate string, source string, kind string")
    assert sorted(values(A.independent_sources(sightings).where("strong"), "candidate")) == [("a",), ("c",)]
    tags = spark.createDataFrame([("AI chips",), ("ai-chips",), ("other",)], "tag string")
    assert values(A.fragmented(tags), "spellings") == [(["AI chips", "ai-chips"],)]
    area = spark.createDataFrame([("p", ["chip"], "a chip", "x"), ("q", ["x"], "y", "chip"), ("r", ["x"], "y", "z")], "path string, tags array<string>, title string, body string")
    assert values(verbs.ask({"a": area}, ["chip"]).orderBy("rank"), "path", "score", "relevance") == [("p", 5, "high"), ("q", 1, "low")]
    assert tuple(spark.range(1).select(R.best_tags(F.expr("array('a','b','c')"), F.expr("map('c', 2.0D, 'a', 1.0D)"), 2)).first()) == (["c", "a"],)


def test_streams(spark, tmp_path):
    rows = [("v", dt.datetime(2026, 1, 1, i), s) for i, s in enumerate(["LIKELY_DEAD", "ALIVE", "LIKELY_DEAD", "LIKELY_DEAD", None, "LIKELY_DEAD"])]
    spark.createDataFrame(rows, "variable string, run_ts timestamp, verdict string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = T.streak_stream(spark.readStream.schema("variable string, run_ts timestamp, verdict string").parquet(str(tmp_path / "in")))
    T.change_stream(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out"))
    batch = W.closing(spark.read.parquet(str(tmp_path / "in")))
    assert sorted(values(found, "consecutive", "close")) == sorted(values(batch, "consecutive", "close"))
    tasks = spark.createDataFrame([("a", "09:00", None), ("b", "23:00", dt.datetime(2026, 1, 4, 23)), ("c", "09:00", dt.datetime(2026, 1, 5, 9, 1))], "task string, at string, last_run timestamp")
    assert sorted(values(T.due_runs(tasks, F.lit("2026-01-05 10:00:00").cast("timestamp")), "task")) == [("a",)]
