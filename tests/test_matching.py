"""Names, terms, near texts and cycles against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessellum.operators import aggregates as A
from tessellum.operators import graph as G
from tessellum.operators import joins as J
from tessellum.operators import similar as S
from tessellum.operators import text as N
from tests.test_queries import edits

HAN = "水位天气铁矿石油价格涨跌库存"


def form(text):
    apart = re.sub("([぀-ヿ㐀-䶿一-鿿豈-﫿])", r" \1 ", text.lower())
    return f" {' '.join(re.findall(r'[^\W_]+', apart))} "


def test_occurrences(spark):
    rng = random.Random(1)
    bits = ["Henry", "Hub", "hub", "LNG", "the", "price", *HAN[:6], "，", "-", " ", "  ", "é", "7"]
    texts = [(i // 2, "".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 25)))) for i in range(200)] + [(900, None), (901, ""), (902, "the " * 20_000 + "end mark")]
    names = [("".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(1, 4))),) for _ in range(80)] + [(None,), ("--",), ("",), ("end mark",), ("the the the",), ("the the end mark",)]
    ours = N.occurrences(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(names, "name string"))
    expected = {(i, n) for i, t in texts if t is not None for (n,) in names if n and form(n).strip() and form(n) in form(t)}
    assert {tuple(r) for r in ours.collect()} == expected and len(expected) > 300 and ours.count() == len(expected)
    todos = spark.createDataFrame([(1, "work", "看水位上升"), (2, "tracked", "水位"), (3, "work", "water level"), (4, "life", "Water-Level rises")], "todo long, section string, text string")
    topics = spark.createDataFrame([("w", "水位"), ("w", "water level"), ("x", "上")], "topic string, name string")
    assert sorted(map(tuple, N.misfiled(todos, topics, ("work", "life")).collect())) == [(1, "work", "w"), (1, "work", "x"), (3, "work", "w"), (4, "life", "w")]


def slow_words(texts, longest, at_least, cohesion, freedom):
    counts = Counter()
    for run in (f"^{r}$" for t in texts for r in re.findall(f"[{HAN}]+", t or "")):
        counts.update(run[i : i + m] for m in range(1, longest + 2) for i in range(len(run) - m + 1))
    total, found = sum(n for g, n in counts.items() if len(g) == 1 and g not in "^$"), {}
    bits = lambda cs: math.log2(sum(cs)) - sum(c * math.log2(c) for c in cs) / sum(cs)
    right, left = defaultdict(list), defaultdict(list)
    for g, n in counts.items():
        right[g[:-1]].append(n)
        left[g[1:]].append(n)
    for g, n in counts.items():
        if 2 <= len(g) <= longest and not set(g) & set("^$") and n >= at_least and min(n * total / counts[g[:i]] / counts[g[i:]] for i in range(1, len(g))) >= cohesion and min(bits(right[g]), bits(left[g])) >= freedom:
            found[g] = n
    return found


def test_discovered_terms(spark):
    rng = random.Random(2)
    words = ["水位", "天气", "铁矿石", "油价"]
    texts = ["，".join("".join(rng.choice(words) if rng.random() < 0.5 else rng.choice(HAN) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 6))) for _ in range(300)] + [None, "", "only latin words"]
    posts = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "post long, text string")
    found = {r["term"]: r["n"] for r in N.discovered(posts, at_least=20, cohesion=3.0, freedom=2.0).collect()}
    assert found == slow_words(texts, 4, 20, 3.0, 2.0) and set(words) <= set(found)
    counted = {r["term"]: r["posts"] for r in A.term_posts(posts, 1, spark.createDataFrame([(w,) for w in words], "term string")).collect()}
    expected = {w: len({i // 2 for i, t in enumerate(texts) if w in (t or "")}) for w in words}
    assert counted == expected | {"only": 1, "latin": 1, "words": 1}
    assert N.discovered(posts.limit(0)).collect() == []


@pytest.mark.parametrize(("most", "crowd"), [(1, 64), (2, 0), (5, 64), (4, 0), (5, 0)])
def test_near_texts(spark, most, crowd, monkeypatch):
    monkeypatch.setattr(S, "CROWD", crowd)
    rng = random.Random(most)
    texts = sorted({"".join(rng.choices("ab漢", k=rng.randint(0, 13))) for _ in range(120)})
    frame = spark.createDataFrame([(None if i % 9 == 0 else 0, t, i) for i, t in enumerate(texts)], "b int, t string, i int")
    found = sorted((*sorted((r["t1"], r["t2"])), r["b"]) for r in S.near(frame, most).collect())
    blocks = {t: None if i % 9 == 0 else 0 for i, t in enumerate(texts)}
    assert found == sorted((a, b, blocks[a]) for a in texts for b in texts if a < b and blocks[a] == blocks[b] and edits(a, b) <= most)


def test_few_texts_are_looked_at(spark, monkeypatch):
    """All titles begin alike: far fewer pairs meet than there are, and none that is near is lost."""
    monkeypatch.setattr(S, "CROWD", 4)
    rng = random.Random(4)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(4, 9))) for _ in range(150)]
    titles = [f"note on {' '.join(rng.sample(words, 5))} {rng.randint(0, 10**6)}" for _ in range(600)]
    titles += [t.replace("note", "mote") for t in titles[:20]]
    frame = spark.createDataFrame([(0, t, i) for i, t in enumerate(titles)], "b int, t string, i int")
    met = S.met(frame, 5).select("t1", "t2").distinct()
    assert S.near(frame, 5).count() == sum(edits(a, b) <= 5 for i, a in enumerate(titles) for b in titles[max(i + 1, 600) :]) and met.count() < 0.05 * 620 * 619 / 2


@pytest.mark.parametrize("crowd", [64, 0])
def test_nearest_path(spark, crowd, monkeypatch):
    monkeypatch.setattr(S, "CROWD", crowd)
    rng = random.Random(5)
    files = [("".join(rng.choices("abc/", k=rng.randint(1, 12))),) for _ in range(150)] + [("report.md",), (None,)]
    targets = [("".join(rng.choices("abc/", k=rng.randint(1, 12))),) for _ in range(60)] + [("Xeport.md",), ("",), (None,), ("nothing like it, and long" * 3,)]
    found = {r["target"]: (r["repair"], r["score"] and round(r["score"], 9)) for r in J.repairs(spark.createDataFrame(targets, "target string"), spark.createDataFrame(files, "path string")).collect()}
    expected = {}
    for (t,) in targets:
        if t is not None:
            s, p = max((1 - edits(t, f) / max(len(t), len(f), 1), f) for (f,) in files if f is not None)
            expected[t] = (p, round(s, 9)) if s >= 0.7 else (None, None)
    assert found == expected and found["Xeport.md"][0] == "report.md"


def slow_components(edges):
    out, reach = defaultdict(set), {}
    for a, b in edges:
        out[a].add(b)
    for n in {x for e in edges for x in e}:
        seen, left = set(), [n]
        while left:
            for y in out[left.pop()] - seen:
                seen.add(y)
                left.append(y)
        reach[n] = seen
    return {n: min(m for m in reach[n] if n in reach[m]) for n in reach if n in reach[n]}


def test_components(spark):
    rng = random.Random(6)
    ring = [(i, (i + 1) % 1000) for i in range(1000)]
    linked = [(1000 + i, 1000 + (i + 1) % 7) for i in range(7)] + [(1010 + i, 1010 + (i + 1) % 5) for i in range(5)] + [(5, 1003), (1003, 1011)]
    some = [(rng.randint(2000, 2030), rng.randint(2000, 2030)) for _ in range(40)] + [(3000, 3000), (3001, 3002)]
    edges = ring + linked + some
    frame = spark.createDataFrame([*edges, (None, 1), (1, None), *edges[:3]], "src long, dst long")
    expected = slow_components(linked + some) | dict.fromkeys(range(1000), 0)
    found = G.strongly_connected(frame).collect()
    assert {r["node"]: r["component"] for r in found} == expected and len(found) == len(expected)
    few = frame.where("src < 90 or src >= 999").union(spark.createDataFrame([(90, 999)], frame.schema))  # a ring of 92
    found = G.strongly_connected(few, small=0).collect()
    assert {r["node"]: r["component"] for r in found} == {n: c for n, c in expected.items() if n <= 90 or n >= 999} and len(found) == len({n for n in expected if n <= 90 or n >= 999})
    assert G.acyclic(frame.where("src >= 3001")).collect() == []
    text = frame.where("src between 1010 and 1014").select(F.col("src").cast("string"), F.col("dst").cast("string"))
    assert {r[0] for r in G.acyclic(text).collect()} == {str(n) for n in range(1010, 1015)}


def test_budget_of_null_costs(spark):
    rows = spark.createDataFrame([(i, None if i % 2 == 0 else 3) for i in range(10)], "id long, cost long")
    for width in (2, 3, 5, 100):
        assert sorted(r["id"] for r in A.within_budget(rows, "cost", "id", 9, width).collect()) == [0, 1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("least", [1, 2, 3])
def test_pairs_that_share(spark, least):
    """One item is common to all members and makes no pair by itself."""
    rng = random.Random(least)
    rows = [(m, i) for m in range(150) for i in {0, *rng.sample(range(1, 200), rng.randint(0, 6))}]
    held = defaultdict(set)
    for m, i in rows:
        held[m].add(i)
    expected = {(a, b): len(held[a] & held[b]) for a in held for b in held if a < b and len(held[a] & held[b]) >= least and (a, b) not in ((0, 1), (2, 9))}
    edges = spark.createDataFrame([(1, 0), (2, 9)], "src long, dst long")
    found = J.cross_pairs(spark.createDataFrame([*rows, rows[0], (None, 0), (5, None)], "member long, item long"), edges, least)
    assert {(r["i"], r["j"]): r["shared"] for r in found.collect()} == expected
