"""Operators 11 to 13 against brute force, and on odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellum.llm import clusters, conversations, license_rules, licenses

# ---- 11


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm == 1:
            text = ""
        elif harm == 2:
            text = re.sub("[.!?]", "", text)
        elif harm == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(harm, 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        said = text.strip(" \t\n\v\f\r")
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def slow_repair(rows):
    """rows (turn, role, text) of a conversation in order: every way to edit them with at most two inserts between rows."""
    found = faults(rows)
    ends = {("", 0, "")}  # (role initials, cost, audit)

    def inserted(ways):
        return {(r + more, c + 3 * len(more), a + "I" * len(more)) for r, c, a in ways for more in ("", "u", "a", "ua", "au")}

    ends = {w for w in inserted(ends) if re.fullmatch("s?(ua)*u?", w[0])}
    for (_, role, _), fault in zip(rows, found, strict=True):
        more, out = (3 if fault == "truncated" else 0), set()
        for r, c, a in ends:
            out.add((r, c + 4, a + "D"))
            if fault not in ("blank", "duplicate"):
                out.add((r + (role[:1] or "?"), c + more, a + "K"))
                out |= {(r + x, c + 3 + more, a + "R") for x in "ua"}
        ends = {w for w in inserted(out) if re.fullmatch("s?(ua)*u?", w[0])}
    cost, audit = min((c, a) for r, c, a in ends if re.fullmatch("(s?(ua)+)?", r))
    at, last, lines = 0, "", []
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at][1:]
        at += edit != "I"
        if edit != "D":
            role = role if edit == "K" else "assistant" if last == "u" else "user"
            last = role[:1]
            lines.append(f"{role}:{text}")
    turns = [t for t, *_ in rows if t is not None]
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))


def talk(rng, n, longest):
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, longest)):
            rows.append((conv, rng.choice([None, turn, turn, turn, turn + 2]), rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]), rng.choice(["Yes.", "No.", "And then", " \n", "", None, "Ends. ", "Well? \n", "é!"])))
    return rows


def test_conversations(spark):
    rows = talk(random.Random(5), 80, 5)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("copies", "mark", "n", "head", "place", "k")})
    found = conversations.repair(conversations.damaged(df.repartition(3))).collect()
    left, expected = slow_damage(rows), {}
    for conv in {r[0] for r in rows}:
        expected[conv] = slow_repair(in_order([r[1:] for r in left if r[0] == conv]))
    assert len(found) == len(expected) and {r[0]: tuple(r[1:]) for r in found} == expected


def test_hot_conversation(spark):
    rng = random.Random(6)
    rows = [(7, t // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"text {t}.", f"text {t}"])) for t in range(3000)] + [(7, 5, "user", "same.")] * 40 + [(c, 0, "user", "Hi.") for c in (6, 8, 9)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, copies int")
    found = {r[0]: r for r in conversations.repair(df).collect()}
    ordered = in_order([r[1:] for r in rows if r[0] == 7])
    way = conversations.Way(conversations.first_layer())
    for (_, role, _), fault in zip(ordered, faults(ordered), strict=True):
        way.step(role[:1], fault in ("blank", "duplicate"), fault == "truncated")
    cost, audit = conversations.cheapest(way.layer)
    assert (found[7]["cost"], found[7]["audit"]) == (cost, "".join(way.settled) + audit)
    assert found[7]["duplicate"] == faults(ordered).count("duplicate") and found[7]["gaps"] == 0
    assert [found[c]["audit"] for c in (6, 8, 9)] == ["KI"] * 3
    turns = conversations.repaired(df).where("conv_id = 7").orderBy("place").collect()
    assert re.fullmatch("s?(ua)*", "".join(t["role"][0] for t in turns)) and hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in turns).encode()).hexdigest() == found[7]["repaired_sha256"]


def test_conversations_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(conversations.damaged(none)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "x" * 100_000)], none.schema)
    assert [tuple(r) for r in conversations.repair(conversations.damaged(one)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# ---- 12


def slow_clusters(rows, k, rounds):
    kept = [(i, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    centroids = [v for i, v in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for c in set(own):
            held = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            centroids[c] = [sum(x) // len(held) for x in zip(*held, strict=True)]
    each = [(i, *nearest(v)) for i, v in kept]
    whole = sum(d for _, d, _ in each)
    return sorted(((i, c, d, sum(e for _, e, f in each if f == c), whole, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in each), key=str)


def test_clusters(spark):
    rng = np.random.default_rng(8)
    middles = rng.normal(0, 0.3, (5, 64))
    rows = [(i, [float(x) for x in (middles[i % 5] + rng.normal(0, 0.05, 64)).astype(np.float32)]) for i in range(120)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (900, None), (901, [0.0] * 63), (902, [None, *[0.0] * 63]), (903, [float("nan")] * 64), (904, [float("inf")] * 64), (905, [0.0] * 64), (906, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("cluster", "distance", "x", "vector", "c")})
    for k, rounds in ((7, 3), (40, 5), (500, 1)):
        found, centroids = clusters.cluster(df, k=k, rounds=rounds)
        assert sorted(map(tuple, found.collect()), key=str) == slow_clusters(rows, k, rounds)
        assert len(centroids) == min(k, 124)
    assert clusters.cluster(df.limit(0))[0].collect() == [] and clusters.cluster(df.where("vec_id >= 903 and vec_id < 905"))[0].collect() == []
    with pytest.raises(Exception, match="would not fit a long"):
        clusters.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>"))


def test_screening():
    rng = np.random.default_rng(9)
    for spread in (1, 40, 1 << 25):
        vectors, centroids = (rng.integers(-spread, spread + 1, (n, 64)) for n in (300, 40))
        centroids[7] = centroids[3]
        vectors[:40] = centroids
        best, distance, _ = clusters.nearest(vectors, clusters.block_norms(vectors), centroids)
        slow = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
        assert (best == slow.argmin(axis=1)).all() and (distance == slow.min(axis=1)).all()
    # blocks of different size tell far centroids apart, so most are never measured
    scale = rng.choice([1, 200], (40, 16)).repeat(4, axis=1)
    centroids = rng.integers(-9, 10, (40, 64)) * scale
    vectors = centroids[rng.integers(0, 40, 2000)] + rng.integers(-3, 4, (2000, 64))
    assert clusters.nearest(vectors, clusters.block_norms(vectors), centroids)[2] < 2000 * 4


# ---- 13


def slow_scan(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    spaced, spans = "".join(f" {w} " for w in words), []
    for n, r in enumerate(license_rules.RULES):
        for m in re.finditer(license_rules.compiled(r.pattern), spaced):
            spans.append((spaced[: m.start()].count(" ") // 2, spaced[: m.end()].count(" ") // 2, r.level, n, r.label, r.base))
    stays = [a for a in spans if not any(b[2] <= a[2] and b[0] <= a[0] and b[1] >= a[1] and (b[1] - b[0] > a[1] - a[0] or b[2] < a[2] or b[3] < a[3]) for b in spans)]
    base = [(i, label) for i in range(len(words)) for phrase, label in license_rules.BASE if words[i : i + len(phrase.split())] == phrase.split()]
    labels = {s[4] for s in stays} | {b[1] for b in base}
    return (len(words), len(base), min((b[0] for b in base), default=None), max((b[0] for b in base), default=None), ",".join(sorted({b[1] for b in base})), ",".join(sorted(labels)), max((license_rules.SURE[s[2]] for s in stays), default=0.0))


def example(rng, pattern):
    out = []
    for word, optional in license_rules.parsed(pattern):
        if optional and rng.random() < 0.5:
            continue
        word = rng.choice(word.split("|")) if "(" not in word else word
        word = re.sub(r"\((\w+)\|(\w+)\)", r"\1", word)
        word = re.sub(r"\[(.)(.*?)\]", r"\1", word).replace(".*", "the owner").replace("\\d", "4")
        out.append(re.sub(r"(\w)\?", lambda m: m[1] if rng.random() < 0.5 else "", word))
    return " ".join(out)


def test_every_rule_has_its_keyword():
    rng = random.Random(10)
    assert len(license_rules.RULES) > 300 and {(r.pattern, r.label) for r in license_rules.RULES if r.base} == set(license_rules.BASE)
    for r in license_rules.RULES:
        for _ in range(6):
            text = example(rng, r.pattern)
            assert re.fullmatch(license_rules.compiled(r.pattern), "".join(f" {w} " for w in text.split())), (r, text)
            assert set(license_rules.keywords(r.pattern)) & set(text.split()), (r, text)


def test_licenses(spark):
    rng = random.Random(11)
    texts = [None, "", " \n", "no license here", "CC BY cc-by CC BY-SA 4.0, cc by", "MIT License mit license", "a" * 50_000, "the GNU GENERAL public\nlicense " * 3000, "İ木兰宽松许可证 x", "SPDX-License-Identifier: Apache-2.0"]
    for _ in range(400):
        parts = [rng.choice([example(rng, rng.choice(license_rules.RULES).pattern).title(), "foo", "public", "license", "GNU general", "the", "é"]) for _ in range(rng.randint(1, 7))]
        texts.append(rng.choice([" ", ", ", "\n", "-"]).join(parts))
    rows = [(None if i % 50 == 3 else i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n_words", "spans", "labels", "_words", "base", "score")})
    found = licenses.scan(df.coalesce(1)).collect()
    assert [tuple(r)[0] for r in found] == [r[0] for r in rows]
    for (_, text), r in zip(rows, found, strict=True):
        if text and len(text) > 60_000:
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (15000, 3000, 1, 14996, "gpl")
        else:
            assert tuple(r)[1:] == slow_scan(text), text
    assert licenses.scan(df.limit(0)).collect() == []
    plan = licenses.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_license_order(spark):
    """A stronger or equal rule hides what it contains; a weaker one hides nothing."""
    rules = [license_rules.Rule("long", 3, "big tree house"), license_rules.Rule("short", 3, "tree"), license_rules.Rule("strong", 1, "house"), license_rules.Rule("same", 3, "big tree house")]
    df = spark.createDataFrame([(1, "big tree house"), (2, "tree big tree house"), (3, "house tree")], "doc_id long, text string")
    found = {r[0]: r["labels"] for r in licenses.scan(df, rules=rules).collect()}
    assert found == {1: "long,strong", 2: "long,short,strong", 3: "short,strong"}


def test_minhashes_carry_no_places(spark, monkeypatch):
    """A place is a decimal of 38 digits, which took part in every row of shingles."""
    from tessellum.llm import lines

    monkeypatch.setattr(lines, "store", lambda df, codec="zstd": df)
    docs = spark.createDataFrame([(1, "a line of one text\nand one more")], "doc_id long, text string").withColumn("row", F.lit(None).cast("long"))
    cut = lines.split_lines(docs, "doc_id", "text", "row")
    plan = lines.signatures(cut, cut.select("doc_id", "r", "line_no", "c", "e"))._jdf.queryExecution().optimizedPlan().toString()
    hashed = [row for row in plan.split("\n") if "Aggregate" in row and "AS m0" in row]
    assert hashed and all("place" not in row for row in hashed)


def test_a_shingle_is_one_update_of_a_sketch(spark, monkeypatch):
    """Every shingle updated all numbers of its line's sketch."""
    from tessellum.llm import lines

    monkeypatch.setattr(lines, "store", lambda df, codec="zstd": df)
    texts = spark.createDataFrame([(1, "a line that says so, a line that says so"), (2, "short"), (3, "another line of some length")], "n long, line string")
    sketch = lines.sketched(texts)
    updates = [row.count("bit_xor(") for row in sketch._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in row and "bit_xor(" in row]
    assert len(updates) == 2 and updates[1] == 1  # a line's numbers, and below them one number of 64 bits
    grams = [(n, g) for n, x in texts.collect() for g in {x[k : k + lines.WIDTH] for k in range(max(1, len(x) - lines.WIDTH + 1))}]
    hashed = spark.createDataFrame(grams, "n long, g string").selectExpr("n", "xxhash64(encode(g, 'UTF-16BE')) as h").collect()
    for row in sketch.collect():
        own, bits = [r["h"] for r in hashed if r["n"] == row["o"]], {}
        for h in own:
            k = (h >> 6) % (lines.SKETCH // 64)
            bits[k] = bits.get(k, 0) ^ (1 << (h & 63))
        assert row["size"] == len(own) and all(row[f"s{k}"] % (1 << 64) == bits.get(k, 0) for k in range(lines.SKETCH // 64))
