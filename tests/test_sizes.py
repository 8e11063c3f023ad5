"""What grows with the square of a group, one key or one task, is dealt out: results against brute force, and where the work goes."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from tessellum.operators import graph as G
from tessellum.operators import joins as J
from tessellum.operators import text as N
from tessellum.plans import hygiene
from tests.test_matching import slow_components


def tasks_of(df):
    """How many tasks put rows out."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_siblings_lack(spark):
    groups = [(m, m % 2) for m in range(150)] + [(0, 0), (None, 1), (400, None)]  # a member told twice, one unknown, one of no group
    has = [(m, i) for m in range(150) for i in range(9) if (m * i) % 7 == 1] + [(0, None), (400, 77), (None, 5)]
    items = defaultdict(set)
    for m, i in has:
        if m is not None and m < 400:
            items[m % 2].add(i)
    expected = [(m, i) for m, g in set(groups) if g is not None for i in items[g] if m is None or i is None or (m, i) not in set(has)]
    found = J.sibling_gap(spark.createDataFrame(has, "member long, item long"), spark.createDataFrame(groups, "member long, grp long"))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected, key=key) and tasks_of(found) > 8


def test_siblings_come_out_in_runs(spark, monkeypatch):
    """An item met all bunches before the next item did, and a task's items were too many for a file's dictionary, so what was written grew to 0.7 bytes a row."""
    groups = [(m, "g") for m in range(600)] + [(None, "g"), (700, None)]
    has = [(i % 600, i) for i in range(500)] + [(m, 900) for m in range(300)] + [(9, 3), (700, 5)]
    held = set(has)
    expected = Counter(m for m, g in groups if g for i in {i for m, i in has if m != 700} if (m, i) not in held)
    a, b = spark.createDataFrame(has, "member long, item long"), spark.createDataFrame(groups, "member long, grp string")
    found = J.sibling_gap(a, b).select("member", "item", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
    spans = found.groupBy("p", "member").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.count("*").alias("n"), F.count_distinct("item").alias("d")).collect()
    counts, stretches = Counter(), defaultdict(list)
    for r in sorted(spans, key=lambda r: r["a"]):
        counts[r["member"]] += r["n"]
        assert r["n"] == r["d"]
        own = stretches[r["p"]]  # members whose rows lie between each other's
        own.append(r["b"]) if not own or r["a"] > own[-1] else own.append(max(own.pop(), r["b"]))
    assert counts == expected and max(map(len, stretches.values())) >= 4
    monkeypatch.setattr(J, "ITEMS", 8, raising=False)
    assert J.sibling_gap(a, b).rdd.getNumPartitions() >= 100


def test_decisions_that_share_tags(spark):
    rows = [(i, [f"t{i % 3}", "all"] if i % 5 else ["all", "all", None]) for i in range(120)] + [(7, ["late"]), (900, []), (901, None), (None, ["all"]), (902, ["late"])]
    tags = defaultdict(set)
    for i, own in rows:
        tags[i] |= {t for t in own or [] if t is not None}
    expected = {(a, b): len(tags[a] & tags[b]) for a in tags for b in tags if None not in (a, b) and a != b and tags[a] & tags[b]}
    found = J.related_decisions(spark.createDataFrame(rows, "id long, tags array<string>"))
    assert {(r["id"], r["other"]): r["shared"] for r in found.collect()} == expected and found.count() == len(expected) and tasks_of(found) > 8


def test_sections_of_one_book(spark):
    lenses = spark.createDataFrame([("b", "s", i) for i in range(200)] + [(None, "s", 900), ("c", "s", 901)], "book string, skill string, lens long")
    sections = spark.createDataFrame([("b", "s", i) for i in range(30)] + [(None, "s", 900)], "book string, skill string, section long")
    found = J.deep_sections(lenses, sections)
    assert sorted((r["lens"], r["section"]) for r in found.collect()) == [(i, j) for i in range(200) for j in range(30)] and tasks_of(found) > 8


def test_words_of_texts_stay_where_they_are(spark):
    """Names made on the driver have no size for Spark, so texts, of a small file, were given to every task word by word."""
    texts = spark.createDataFrame([(i, f"the price of w{i % 7} rose in place {i}") for i in range(300)], "id long, text string")
    found = N.occurrences(texts, spark.createDataFrame([("w3",), ("price of w4",), ("place 5",), ("none of it",)], "name string"))
    expected = {(i, "w3") for i in range(300) if i % 7 == 3} | {(i, "price of w4") for i in range(300) if i % 7 == 4} | {(5, "place 5")}
    assert {tuple(r) for r in found.collect()} == expected
    plan = found._jdf.queryExecution().toString()
    assert "explode(array_distinct" not in plan  # words were met by a stored table's keys, before anything is shuffled or broadcast


def test_many_names_meet_in_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(N, "FEW", 0)
    texts = spark.createDataFrame([(i, f"a b c{i}") for i in range(40)], "id long, text string")
    found = N.occurrences(texts, spark.createDataFrame([("c7",), ("b c8",), ("a b c9",)], "name string"))
    assert sorted(map(tuple, found.collect())) == [(7, "c7"), (8, "b c8"), (9, "a b c9")]


def test_topics_of_one_name_are_dealt(spark):
    todos = spark.createDataFrame([(i, "work", "rain today") for i in range(30)], "todo long, section string, text string")
    topics = spark.createDataFrame([(t, "rain") for t in range(40)] + [(t, "today") for t in range(20, 60)] + [(None, "today"), (99, None), (98, "snow")], "topic long, name string")
    found = N.misfiled(todos, topics, ("work",))
    assert {(r["todo"], r["topic"]) for r in found.collect()} == {(i, t) for i in range(30) for t in (*range(60), None)} and found.count() == 30 * 61 and tasks_of(found) > 8


def test_todos_meet_a_name_once(spark, monkeypatch):
    """Each topic had a longer name of its own beside a common one, so each was a class, and all pairs of todos and classes were shuffled to be told apart."""
    dealt, seen = N.dealt, []
    monkeypatch.setattr(N, "dealt", lambda rows, *a, **b: seen.append(rows.count()) or dealt(rows, *a, **b))
    texts = [(i, "work", f"Rain w{i}, fog today") for i in range(30)] + [(30, "work", None), (31, "work", "fog"), (None, "work", "x1 snow"), (32, "life", "rain")]
    names = [(t, n) for t in range(200) for n in ("rain", f"rain w{t}", f"big rain w{t}")] + [(None, "rain"), (None, "fog"), (None, "today"), (None, "fog today"), (300, "--"), (300, "w3"), (301, None), (302, "snow"), (302, "fog")]
    names += [(303, f"x{i}") for i in range(90)] + [(303, f"x{i} snow") for i in range(90)] + [(304, "snow"), (304, "fog")]
    found = N.misfiled(spark.createDataFrame(texts, "todo long, section string, text string"), spark.createDataFrame(names, "topic long, name string"), ("work",))
    form = lambda t: f" {' '.join(re.findall(r'[^\W_]+', t.lower()))} "
    expected = {(i, s, t) for i, s, x in texts if s == "work" and x for t, n in names if n and form(n).strip() and form(n) in form(x)}
    assert {tuple(r) for r in found.collect()} == expected and found.count() == len(expected) and seen[0] < 200


def test_one_row_moves_the_clock(spark, tmp_path):
    """It was one row for each event, all of one key, so half of a stream was one task's."""
    events = spark.createDataFrame([(i, i % 5) for i in range(50)], "event_id long, user_id long").selectExpr("event_id", "user_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, event_id) as ts")
    events.write.parquet(str(tmp_path / "events.parquet"))
    rows = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events.parque[t]")).select(F.col("user_id").cast("string").alias("candidate"), F.lit("view").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    found = hygiene._drained(spark, hygiene._with_clock(spark, str(tmp_path), rows, "candidate", "kind"), "candidate string, kind string, ts timestamp")
    clock = found.where("candidate = 'clock'").selectExpr("kind", "cast(ts as string)").collect()
    assert found.count() == 51 and [tuple(r) for r in clock] == [("clock", "2024-03-03 01:00:00")]


def test_cycles_behind_long_tails(spark, monkeypatch):
    """Each node has one edge out: tails go by doubled steps, without colours spread over all of them."""
    rng = random.Random(5)
    edges = [(i, rng.randrange(400)) for i in range(400)] + [(1000 + i, 1001 + i) for i in range(70)] + [(2000 + i, 2000 + (i + 1) % 30) for i in range(30)]
    monkeypatch.setattr(G, "spread", lambda *_: 1 / 0)
    found = G.strongly_connected(spark.createDataFrame(edges, "src long, dst long"), small=60)
    assert {r["node"]: r["component"] for r in found.collect()} == slow_components(edges)
    ring = spark.createDataFrame([(i, (i + 1) % 33) for i in range(33)] + [(50, 3), (51, 50), (60, 61)], "src long, dst long")
    assert sorted(r["src"] for r in G.recurring(ring).collect()) == list(range(33))


def test_hops_join_what_is_stored(spark):
    """Edges were kept as rows without a size that Spark can go by, so each round sorted all of them."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(3, 40), (3, 40), (7, 7)], "src long, dst long")
    found = G.hops(edges, spark.createDataFrame([(0,)], "node long"), 6)
    assert {r["node"]: r["hop"] for r in found.collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 40: 4, 5: 5, 41: 5, 6: 6, 42: 6}
    assert "ExistingRDD" not in found._jdf.queryExecution().executedPlan().toString()


def test_terms_of_a_long_run(spark):
    """Each place of a run was cut by counting from the run's beginning, and all runs of characters were shuffled."""
    rng = random.Random(7)
    texts = ["".join(rng.choices("水位天气铁矿", k=3000)), "水位", "天x气", "", None]
    words = ["水位", "天气", "铁矿水", "水水水水", "气"]
    found = N.post_terms(spark.createDataFrame(list(enumerate(texts)), "post long, text string"), spark.createDataFrame([(w,) for w in words], "term string"))
    assert {tuple(r) for r in found.collect()} == {(i, w) for i, t in enumerate(texts) for w in words if len(w) > 1 and w in (t or "")} and found.count() == len(found.collect())
    assert "sequence(1" not in found._jdf.queryExecution().toString()


def test_pairs_are_counted_where_they_are_made(spark, monkeypatch):
    """Each pair that met was a row of a shuffle, as often as it met; now an item's members are shuffled, not their pairs."""
    monkeypatch.setattr(J, "HOT", 6)
    monkeypatch.setattr(J, "MEETINGS", 400)
    rng = random.Random(3)
    rows = [(m, i) for m in range(90) for i in range(40) if rng.random() < 0.12] + [(m, 100) for m in range(90)] + [(m, 101) for m in range(0, 90, 2)] + [(m, 102) for m in range(0, 90, 3)] + [(200, 1), (None, 1), (3, None), (4, 100)]
    edges = [(5, 6), (9, 2), (7, 7), (1, 500), (None, 3)]
    held = defaultdict(set)
    for m, i in rows:
        if m is not None and i is not None:
            held[m].add(i)
    for least in (1, 3):
        expected = {(f"{a:03}", f"{b:03}"): n for a in held for b in held if a < b and (a, b) not in ((5, 6), (2, 9)) and (n := len(held[a] & held[b])) >= least}
        name = lambda df, *columns: df.select(*(F.lpad(F.col(c).cast("string"), 3, "0").alias(c) if c in columns else c for c in df.columns))
        found = J.cross_pairs(name(spark.createDataFrame(rows, "member long, item long"), "member"), name(spark.createDataFrame(edges, "src long, dst long"), "src", "dst"), least)
        assert {(r["i"], r["j"]): r["shared"] for r in found.collect()} == expected and found.count() == len(expected)
    found = J.cross_pairs(spark.createDataFrame([(m, i) for m in range(60) for i in range(5)], "member long, item long"), at_least=1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 60 * 59 // 2 and "hashpartitioning(i#" not in plan


def shuffled_rows(plan):
    """The most rows that one exchange of an executed plan wrote."""
    name = plan.nodeName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().size())]
    written = plan.metrics().get("shuffleRecordsWritten")
    return max([written.get().value() if written.isDefined() else 0, *map(shuffled_rows, inner)])


def test_a_member_goes_once_for_each_of_its_items(spark, monkeypatch):
    """It went once for each chunk of blocks besides, so that more rows were shuffled than an item's pairs need."""
    monkeypatch.setattr(J, "MEETINGS", 1000)  # many blocks, so that each holds few members
    rng = random.Random(5)
    rows = [(10 * m - 400, i) for m in range(120) for i in rng.sample(range(60), 12)]
    held = defaultdict(set)
    for m, i in rows:
        held[m].add(i)
    found = J.cross_pairs(spark.createDataFrame(rows, "member long, item long"))
    assert {(r["i"], r["j"]): r["shared"] for r in found.collect()} == {(a, b): n for a in held for b in held if a < b and (n := len(held[a] & held[b])) >= 2}
    assert 0 < shuffled_rows(found._jdf.queryExecution().executedPlan()) <= len(rows)


def test_pairs_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(J, "HELD", 7)  # so that rows are cut and counts put together
    rng = random.Random(6)
    rows = [(f"i{i}", m, m // 5) for m in range(40) for i in rng.sample(range(12), 5)]
    rng.shuffle(rows)
    runs = list(J._runs(iter([pa.record_batch(list(map(pa.array, zip(*part, strict=True))), ["item", "m", "block"]) for part in (rows[:90], rows[90:])])))
    known = pa.record_batch([pa.array([0]), pa.array([0]), pa.array([[3, 17]])], ["block", "own", "others"])
    held = defaultdict(set)
    for i, m, _ in rows:
        held[m].add(i)
    expected = {(a, b): n for a in held for b in held if a < b and (a, b) != (3, 17) and (n := len(held[a] & held[b])) >= 2}
    assert len(runs) > 2 and {(r["a"], r["b"]): r["n"] for part in J._counted(iter([*runs, known]), 40, 2) for r in part.to_pylist()} == expected
    assert list(J._runs(iter([]))) == list(J._counted(iter([]), 1, 2)) == []
