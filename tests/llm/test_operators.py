"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd inputs."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessellum.llm import common, embeddings, huffman, lines, minhash, mixing, packing, quality, queries, toxicity, urls, warc
from tessellum.llm.tokens import Encoder, tokenizer_path
from tests.conftest import DATA

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 977}" for i in range(12000))
#: id, text, source: nulls, empty and very long texts, ties and repeated rows.
ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, LONG, "b"), (4, LONG, "b"), (5, LONG + " tail", "b"), (None, "no id here", "a"), (None, None, None), (6, "one", "a"), (7, "a b\nc d\na b\n\na b", "ü"), (8, "İstanbul ΑΣ  x\u3000y\x1c. <|endoftext|> z<|startoftext|>", "b")]


def frame(spark, rows=ODD, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(1) for c in ("size", "c", "key", "n", "component", "kept", "ids", "line", "h", "k", "a", "b")}) if extra else df


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def union_find(n, pairs):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


# ---- tokens, 2 and 8


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_library(spark, path):
    rng = random.Random(1)
    alphabet = ["a", "B", " ", "  ", "\n", ".", ",", "'s", "é", "é", "Σ", "İ", "1", "\u00a0", "\x1c", "\t", "$", "<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", "ß", "中", "\r\n"]
    texts = [r[0] for r in documents(spark).select("text").limit(100).collect()] + ["".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(3000)]
    for as_text in (False, True):
        own, plain = Encoder(path, specials_as_text=as_text), Tokenizer.from_file(path)
        if as_text:
            plain.encode_special_tokens = True
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_code_lengths():
    rng = np.random.default_rng(0)
    for n, limit in ((1, 4), (2, 4), (9, 4), (16, 4), (500, 12)):
        counts = (rng.pareto(0.3, n) * 10 + 1).astype(np.int64)
        lengths = huffman.code_lengths(counts, limit)
        assert lengths.max() <= limit and sum(2.0 ** -int(x) for x in lengths) <= 1
    best = min((sum(int(c) * l for c, l in zip((60, 20, 10, 5), ls, strict=True)) for ls in itertools.product(range(1, 4), repeat=4) if sum(2.0**-x for x in ls) <= 1))
    assert (huffman.code_lengths(np.array([60, 20, 10, 5]), 3) * np.array([60, 20, 10, 5])).sum() == best
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(17, np.int64), 4)


def test_code_round_trip():
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.geometric(0.02, 5000), 999).astype(np.uint32)
    sizes = np.array([0, 1, 700, 256, 257, 5000 - 1214], np.int64)
    code = huffman.Code(huffman.code_lengths(np.bincount(ids, minlength=1000)))
    bits, _, at = code.encode(ids, sizes)
    doc, lengths = huffman.stretches(sizes)
    starts = (np.cumsum(sizes) - sizes)[doc] + (np.arange(len(doc)) - np.searchsorted(doc, doc)) * huffman.STRIDE
    assert (code.decode(bits, at[starts], lengths) == ids).all()


def test_huffman_files(spark):
    common.narrow_batches(spark)
    plain = Tokenizer.from_file(BYTE)
    for df in (frame(spark), frame(spark, extra=False).limit(0), documents(spark).select("doc_id", "text")):
        rows = sorted(((r[0], r[1]) for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        found = sorted((tuple(r) for r in huffman.read(huffman.write(df, tokenizer=BYTE)).collect()), key=lambda r: r[1])
        assert [r[0] for r in found] == [r[0] for r in rows]
        at = 0
        for doc_id, start, n, ids in found:
            assert (start, 4 * n) == (at, len(ids)) and np.frombuffer(ids[-4:], "<u4")[0] == 2
            at += n
        expected = Counter((i, tuple([*plain.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows)
        assert Counter((r[0], tuple(np.frombuffer(r[3], "<u4").tolist())) for r in found) == expected


def test_packer():
    rng = random.Random(3)
    sizes = [rng.randint(1, 50) for _ in range(3000)]
    for bins in (1, 4, 64):
        packer, used = packing.Packer(50, bins, 0), defaultdict(int)
        for s in sizes:
            b, offset = packer.place(s)
            assert used[b] == offset and offset + s <= 50
            used[b] += s
            assert packer.count <= bins
    assert len(used) <= 1.05 * sum(sizes) / 50


def test_packing(spark):
    common.narrow_batches(spark)
    plain = Tokenizer.from_file(WORD)
    df = frame(spark)
    rows = packing.pack(df, tokenizer=WORD).collect()
    total = sum(len(plain.encode(r[0] or "", add_special_tokens=False).ids) + 1 for r in df.select("text").collect())
    assert sum(r["length"] for r in rows) == total
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"] <= 4 * 2048 and (r["length"] == 2048 or r["start"] % 2048 == 0)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    one = sorted((r for r in rows if r["doc_id"] == 5), key=lambda r: r["piece"])
    assert b"".join(r["ids"] for r in one) == np.array([*plain.encode(LONG + " tail", add_special_tokens=False).ids, 0], "<u4").tobytes()
    assert packing.pack(df.limit(0), tokenizer=WORD).count() == 0


# ---- 1


def test_warc(spark):
    big = "x" * 1500
    pages = spark.createDataFrame([(1, "http://a.org/1", big), (2, "http://b.a.org/2?q", big), (3, None, big), (4, "no scheme", "small"), (5, "http://a.org/1", "small"), (6, "http://a.org/6", None), (7, "http://A.org/7", "é" * 600), (7, "http://A.org/7", "é" * 600), (None, "http://a.org/n", big), (8, "http://x/\r\nbad", "y" * 1000)], "page_id long, url string, html string").withColumn("key", F.lit(1))
    archives = warc.write(pages)
    found = warc.lookup(archives, pages.select("url", "page_id")).collect()
    assert len(found) == pages.count() == archives.agg(F.sum("records")).first()[0]
    for r in found:
        body = {4: "small", 5: "small", 6: "", 7: "é" * 600, 8: "y" * 1000}.get(r["page_id"], big).encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
        again = r["page_id"] in (1, 2, None)
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if again else ("response", None))
    assert warc.lookup(archives, spark.createDataFrame([("http://a.org/1", 99), ("http://zzz.org/", 1)], "url string, page_id long")).count() == 0
    assert warc.write(pages.limit(0)).count() == 0
    assert warc.lookup(warc.write(pages.limit(0)), pages.select("url", "page_id")).count() == 0


# ---- 3


def test_lines(spark):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("ba", "ko", "mi", "tre", "lu") for b in ("n", "sta", "r", "", "gel")]
    sentences = [" ".join(rng.choices(vocabulary, k=25)) for _ in range(60)]
    near = [s[:40] + "X" + s[41:] for s in sentences[:20]]
    rows = [(i, "\n".join(rng.sample(sentences + near, 4) + ["", "ab"]), "s") for i in range(60)] + [(None, sentences[0], "s"), (100, None, "s"), (101, "\n \n", "s"), (102, LONG, "s")]
    df = frame(spark, rows)
    occurrences = [(i, k, x) for i, t, _ in rows if t for k, x in enumerate(t.split("\n")) if x.strip()]
    texts = sorted({x for *_, x in occurrences})
    grams = [{x[k : k + 8] for k in range(max(1, len(x) - 7))} for x in texts]
    alike = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b])]
    group = dict(zip(texts, union_find(len(texts), alike), strict=True))
    first = {}
    for i, k, x in sorted((o for o in occurrences if o[0] is not None)):
        first.setdefault(group[x], (i, k))
    expected = sorted(((i, k, *first[group[x]], (i, k) == first[group[x]]) for i, k, x in occurrences), key=str)
    found = sorted((tuple(r) for r in lines.line_components(df).collect()), key=str)
    assert found == expected
    kept = {r["doc_id"]: r["text"] for r in lines.dedupe(df).collect()}
    assert kept[100] is None and kept[101] == "\n \n" and kept[102] == LONG and None not in kept
    assert sorted(x for t in kept.values() if t for x in t.split("\n") if x.strip()) == sorted(x for i, k, x in occurrences if first[group[x]] == (i, k))
    assert lines.line_components(df.limit(0)).count() == 0 and lines.dedupe(df.limit(0)).count() == 0


def test_sketches_lose_no_lines(spark):
    rng = random.Random(5)
    wholes = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n + 7)) for n in (10, 20, 40, 60, 80) for _ in range(60)]
    pairs = [(x[: (len(x) - 7) * 4 // 5 + 7], x) for x in wholes]  # 0.8 exactly, as the first is a piece of the second
    texts = spark.createDataFrame([(2 * i + k, pair[k]) for i, pair in enumerate(pairs) for k in range(2)], "n long, line string")
    signed = texts.select("n", F.array(F.expr("n div 40"), *(F.expr(f"1000 * n + {b}") for b in range(1, len(lines.BANDS)))).alias("keys"))
    named = signed.select(F.col("keys")[0].alias("key"), "n", F.col("n").alias("g"))
    found = {(r["a"], r["b"]) for r in lines.across(named, signed, texts, 80).collect()}
    assert {(2 * i, 2 * i + 1) for i in range(len(pairs))} <= found and len(found) < 2 * len(pairs)


def test_lines_go_by_row(spark):
    line = ["".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=60)) for k in range(6)]
    rows = [(1, line[0], "s"), (None, line[0] + "\n" + line[1], "s"), (None, line[2] + "\n" + line[3], "s"), (None, line[4], "s"), (2, line[0], "s"), (2, line[5], "s")]
    left = sorted(((r["doc_id"], r["text"]) for r in lines.dedupe(frame(spark, rows)).collect()), key=str)
    clashing = dict.fromkeys(("doc", "r", "row", "key", "gone", "own", "parts", "new", "line", "line_no", "c", "e", "place"), F.lit(1))
    wide = lines.dedupe(frame(spark, rows).withColumns(clashing))
    assert wide.count() == len(left) and set(clashing) < set(wide.columns)
    assert left == sorted([(1, line[0]), (None, line[1]), (None, line[2] + "\n" + line[3]), (None, line[4]), (2, line[5])], key=str)


def test_one_line_of_a_component(spark):
    """Rows that repeat, share an id or have none keep one line of each component among them."""
    line = ["".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=60)) for k in range(6)]
    near = "X" + line[2][1:]
    rows = [(1, line[0], "s")] * 3 + [(None, line[1] + "\n" + line[1], "s")] * 3 + [(None, line[2], "s"), (None, near, "s"), (None, line[3], "s")]
    rows += [(4, line[4], "s"), (4, "X" + line[4][1:], "s"), (4, line[5] + "\n" + line[4], "s"), (5, line[5], "s"), (None, "alone " + line[0][::-1], "s")]
    found = lines.line_components(frame(spark, rows)).collect()
    assert len(found) == sum(len(t.split("\n")) for _, t, _ in rows)
    left = [(r["doc_id"], x) for r in lines.dedupe(frame(spark, rows)).collect() for x in r["text"].split("\n")]
    assert len(left) == sum(r["kept"] for r in found) == 7
    alike = lambda x: next((whole for whole in line if x[1:] == whole[1:]), x)
    expected = [(1, line[0]), (None, line[1]), (None, line[2]), (None, line[3]), (4, line[4]), (4, line[5]), (None, "alone " + line[0][::-1])]
    assert sorted(((i, alike(x)) for i, x in left), key=str) == sorted(expected, key=str)


def test_lines_recall(spark):
    """Of pairs right at 0.8, of 10 to 80 shingles, nine in ten at least share a band."""
    rng = random.Random(6)
    wholes = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n + 7)) for n in (10, 20, 40, 80) for _ in range(250)]
    rows = [(2 * i + k, x if k else x[: (len(x) - 7) * 4 // 5 + 7], "s") for i, x in enumerate(wholes) for k in range(2)]
    found = {r["doc_id"]: r["first_doc"] for r in lines.line_components(frame(spark, rows)).collect()}
    missed = sum(found[2 * i + 1] != 2 * i for i in range(len(wholes)))
    assert missed <= 30, missed


# ---- 4


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([centres[rng.integers(0, 40, 300)] + rng.normal(size=(300, 16)) * 0.28, centres[:5], 7 * centres[:5], centres[:5]])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] + [1.0] * 15), (1005, [float("inf")] + [1.0] * 15), (1006, [1.0, 2.0]), (None, [float(v) for v in centres[0]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("c", F.lit(1)).withColumn("label", F.lit(0))
    x = np.concatenate([x, centres[:1]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    assert near.sum() > 500
    root = union_find(len(x), zip(*np.nonzero(near), strict=True))
    found = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    for i in range(len(x) - 1):
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (near[i].sum(), root[i], root[i] == i)
    assert all((found[i]["n_links"], found[i]["component_id"]) == (0, i) for i in range(1000, 1007))
    assert found[None]["component_id"] == root[len(x) - 1] and not found[None]["kept"]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_least_count():
    need = embeddings.least_count(32, 2.0, 1 - 1e-6)
    rng = np.random.default_rng(6)
    hits = (np.abs(rng.normal(size=(200000, 32))) <= 2.0).sum(1)
    assert (hits < need).mean() < 1e-4 and need > 20


# ---- 5


def test_urls(spark):
    rows = [("http://www.example.com/en/1", "allow", "www.example.com/en/"), ("http://x.example.com/en/1", "block", "example.com/en/"), ("http://EXAMPLE.com/de/1?a#b", "allow", "com/"), ("http://notexample.com/en/1", "allow", "com/"), ("http://com", None, None), ("https://a.net/es/1", "block", "net/es/"), ("https://a.net/es", None, None), (None, None, None), ("", None, None), ("no scheme", None, None), ("a://b://c/d", None, None), ("http://h.org?x", None, None), ("http://h.org/" + "d/" * 3000, None, None), ("http://ünï.net/fr/é", "block", "net/fr/")]
    pages = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "page_id long, url string").withColumn("template", F.lit(1))
    found = {r["page_id"]: r for r in urls.judge(pages).collect()}
    for i, (_, verdict, rule) in enumerate(rows):
        assert found[i]["rule"] == rule and (verdict is None or found[i]["verdict"] == verdict), rows[i]
    assert [(found[i]["host"], found[i]["path"]) for i in (2, 4, 7, 9, 10, 11)] == [("example.com", "/de/1"), ("com", ""), ("", ""), ("", ""), ("b:", "//c/d"), ("h.org", "")]
    assert found[12]["template"].endswith("/**")
    assert urls.judge(pages.limit(0)).count() == 0


def slow_purities(host_templates, prior=urls.PRIOR, weight=urls.WEIGHT, least=urls.LEAST, z=1.96):
    """One host's templates by a walk over a tree in memory."""
    good: dict[str, float] = {}
    labelled: dict[str, float] = {}
    children: dict[str, set[str]] = {}
    for template, g, n in zip(host_templates["template"], host_templates["good"], host_templates["labelled"], strict=True):
        parts = template.split("/")
        for k in range(len(parts)):
            node = "/".join(parts[: k + 1])
            good[node], labelled[node] = good.get(node, 0) + g, labelled.get(node, 0) + n
            if k:
                children.setdefault("/".join(parts[:k]), set()).add(node)
    purity: dict[str, float] = {}
    waiting = [([""], prior)]
    while waiting:
        merged, above = waiting.pop()
        own = (sum(good.get(c, 0) for c in merged) + weight * above) / (sum(labelled.get(c, 0) for c in merged) + weight)
        purity.update(dict.fromkeys(merged, own))
        branches: dict[str, list[str]] = {}
        for child in sorted(c for node in merged for c in children.get(node, ())):
            branches.setdefault(child.rpartition("/")[2], []).append(child)
        sums = {name: (sum(good[c] for c in nodes), sum(labelled[c] for c in nodes)) for name, nodes in branches.items()}
        groups: list[list[str]] = []
        for name in sorted((x for x in sums if sums[x][1]), key=lambda x: (-sums[x][0] / sums[x][1], x)):
            g1, n1 = sums[name]
            if groups:
                g0, n0 = (sum(sums[x][k] for x in groups[-1]) for k in (0, 1))
                p = (g0 + g1) / (n0 + n1)
                if abs(g0 / n0 - g1 / n1) <= z * math.sqrt(max(p * (1 - p), 1e-9) * (1 / n0 + 1 / n1)):
                    groups[-1].append(name)
                    continue
            groups.append([name])
        waiting += [([c for name in group for c in branches[name]], (own + prior) / 2) for group in groups]
        told = [sums[name][0] / sums[name][1] for name in sums if sums[name][1]]
        beside = (math.fsum(told) + weight * prior) / (len(told) + weight) if told else own
        waiting += [(branches[name], beside) for name in sums if not sums[name][1]]
    out = host_templates[["host", "template"]].copy()
    out["purity"] = [purity[t] for t in out["template"]]
    out["rejected"] = out["purity"] < least
    return out


def test_template_tree(spark):
    rows = spark.createDataFrame([("h", "/ads/*", 0, 40), ("h", "/spam/*", 1, 60), ("h", "/news/*", 50, 50), ("h", "/blog/*", 48, 50), ("h", "/new/*", 0, 0), ("h", "", 0, 0)], "host string, template string, good long, labelled long")
    found = urls.purities(rows).toPandas().set_index("template")
    assert found["rejected"].to_dict() == {"/ads/*": True, "/spam/*": True, "/news/*": False, "/blog/*": False, "/new/*": False, "": False}
    assert abs(found["purity"]["/news/*"] - found["purity"]["/blog/*"]) < 0.02  # merged, as their purities do not differ significantly
    assert urls.purities(rows.limit(0)).count() == 0


def test_unlabelled_branches(spark):
    bad = [(f"h{k}", f"/b{i}/*", 0, 500) for k in (1, 2, 7) for i in range(k)]
    rows = [(h, t, 0, 0) for h in ("h1", "h2", "h7") for t in ("/new", "/new/*/**")] + [("g", "/new/*", 0, 0)] + bad + [("m", f"/b{i}", 500 * (i % 2), 500) for i in range(8)] + [("m", "/new", 0, 0)]
    found = urls.purities(spark.createDataFrame(rows, "host string, template string, good long, labelled long")).where("template like '/new%'").toPandas()
    assert {(r.host, r.template): r.rejected for r in found.itertuples()} == {(h, t): h == "h7" for h, t in found[["host", "template"]].itertuples(index=False)} and len(found) == 8


def test_purities_equal_a_slow_tree(spark):
    rng = random.Random(12)
    rows = {}
    for _ in range(400):
        labelled = rng.choice([0, 0, 3, 20, 60])
        rows[rng.choice(["", "g", "h", "é.net"]), "".join("/" + rng.choice(["a", "b", "0", "u", "*", "**", "ü"]) for _ in range(rng.randint(0, 5)))] = (round(labelled * rng.choice([0, 0.1, 0.5, 0.9, 1])), labelled)
    frame = pd.DataFrame([(*k, *v) for k, v in rows.items()], columns=["host", "template", "good", "labelled"])
    slow = pd.concat([slow_purities(group) for _, group in frame.groupby("host")])
    found = urls.purities(spark.createDataFrame(frame)).toPandas()
    assert len(found) == len(slow) and 0 < slow["rejected"].sum() < len(slow)
    expected = {(r.host, r.template): r for r in slow.itertuples()}
    for r in found.itertuples():
        assert r.rejected == expected[r.host, r.template].rejected and abs(r.purity - expected[r.host, r.template].purity) < 1e-12


def test_wildcards(spark):
    rows = [(i, "h", f"/user/{i}/{'posts' if i % 2 else 'likes'}/{i % 7}x{i}") for i in range(200)]
    found = urls.templates(spark.createDataFrame(rows, "page_id long, host string, path string"))
    assert {r[0] for r in found.select("template").distinct().collect()} == {"/user/*/posts/*", "/user/*/likes/*"}


def slow_templates(rows, support, share):
    """Templates by a recursive walk over lists of rows."""
    found = {}

    def walk(here, level, template):
        on = [(i, s) for i, s in here if len(s) > level]
        found.update({i: template for i, s in here if len(s) <= level})
        if len(on) < support:
            found.update({i: template + "/**" for i, _ in on})
            return
        counts = Counter(s[level] for _, s in on)
        groups = defaultdict(list)
        for i, s in on:
            common = counts[s[level]] >= support and counts[s[level]] >= share * len(on) and not s[level].isdigit()
            groups[s[level] if common else "*"].append((i, s))
        for name, group in groups.items():
            walk(group, level + 1, f"{template}/{name}")

    hosts = defaultdict(list)
    for i, host, path in rows:
        hosts[host].append((i, [x for x in path.split("/") if x]))
    for group in hosts.values():
        walk(group, 0, "")
    return found


def test_templates_equal_a_slow_tree(spark):
    rng = random.Random(3)
    words = ["a", "b", "c", "7", "é", "x y"]
    rows = [(i, f"h{rng.randint(0, 2)}", "/" + "/".join(rng.choice(words[: 2 + k]) if rng.random() < 0.8 else f"r{i}" for k in range(rng.randint(0, 5)))) for i in range(300)]
    rows += [(300 + i, "deep", "/d" * 14 + f"/{i}") for i in range(9)] + [(310, "deep", "/d" * 40)]
    found = urls.templates(spark.createDataFrame(rows, "page_id long, host string, path string"), 5, 1 / 8)
    slow = slow_templates(rows, 5, 1 / 8)
    assert {r["page_id"]: r["template"] for r in found.collect()} == slow
    assert slow[300] == "/d" * 14 + "/*" and slow[310] == "/d" * 14 + "/*/**"


# ---- 6


def test_share_out():
    assert mixing.share_out([100, 100], [3, 1], 200, 2) == [150, 50]
    assert mixing.share_out([10, 100, 0], [3, 1, 2], 165, 2) == [20, 145, 0]
    assert mixing.share_out([], [], 0, 2) == []


def test_fit_is_exact():
    rng = random.Random(7)
    for _ in range(60):
        sizes = sorted(rng.sample(range(0, 40), rng.randint(1, 6)))
        counts = [rng.randint(1, 4) for _ in sizes]
        budget = rng.randint(0, sum(s * c for s, c in zip(sizes, counts, strict=True)) + 5)
        taken = mixing.fit(sizes, counts, budget, 1)
        assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
        got = sum(s * t for s, t in zip(sizes, taken, strict=True))
        total = sum(s * c for s, c in zip(sizes, counts, strict=True))
        if budget >= total:
            assert got == total
            continue
        part = [c * budget // max(1, total) if s else 0 for s, c in zip(sizes, counts, strict=True)]
        sums = {sum(s * t for s, t in zip(sizes, ts, strict=True)) for ts in itertools.product(*(range(p, c + 1) for p, c in zip(part, counts, strict=True)))}
        assert got == min(sums, key=lambda v: (abs(v - budget), v))


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["b", "a", "ä", None])) for i in range(800)] + ODD
    df = frame(spark, rows)
    found = mixing.mix(df).collect()
    assert len(found) == len(rows) and sorted(map(str, found)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    targets = mixing.share_out([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(size.values()), 2)
    taken = Counter()
    for r in found:
        taken[r["source"]] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 2 and r["source_size"] == size[r["source"]]
    for s, t in zip(order, targets, strict=True):
        assert abs(taken[s] - t) <= 60 + max(len(words(x)) for _, x, z in rows if z == s) / 2
    assert mixing.mix(df.limit(0)).count() == 0
    assert sum(len(words(r["text"])) for r in mixing.mixed(frame(spark, rows[:800])).collect()) > 1.4 * sum(len(words(t)) for _, t, _ in rows[:800])


# ---- 7


@pytest.mark.parametrize("width", [2, 5])
def test_minhash(spark, width):
    common.narrow_batches(spark)
    rng = random.Random(9)
    base = [[f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(3, 150))] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for _ in range(4):
            c = list(b)
            for _ in range(rng.randint(0, max(1, len(c) // 25))):
                c[rng.randrange(len(c))] = "changed"
            texts.append("  ".join(c).upper() if rng.random() < 0.3 else " ".join(c))
    rows = [(i + 10, t, "s") for i, t in enumerate(texts)] + [(1, None, "s"), (2, "", "s"), (3, LONG, "s"), (3, LONG, "s"), (4, LONG + " more", "s"), (None, LONG, "s"), (5, "single", "s"), (6, "SINGLE", "s")]
    sets = []
    for _, t, _ in rows:
        w = words(t)
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    ids = [r[0] for r in rows]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = union_find(len(rows), pairs)
    least = {}
    for i, r in zip(ids, root, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    expected = sorted(((i, len(s), least[r], i == least[r]) for i, s, r in zip(ids, sets, root, strict=True)), key=str)
    df = frame(spark, rows)
    found = sorted((tuple(r) for r in minhash.near_duplicates(df, width=width).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    assert sum(a != b for a, b in zip(found, expected, strict=True)) == 0
    left = [r[0] for r in minhash.keep_one(df, width=width).select("doc_id").collect()]
    assert sorted(left) == sorted(set(least.values()))
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_sketches_lose_no_documents(spark):
    words = [[f"w{i}x{k}" for k in range(101)] for i in range(1000)]
    sets = [[" ".join(w[:n]) for n in (81, 101)] for w in words]  # 80 of 100 pairs of words: 0.8 exactly
    own = [[minhash.shingles(t, 2) for t in pair] for pair in sets]
    numbers = [[minhash.set_id(s) for s in pair] for pair in own]
    key = lambda i: spark.range(1).select(F.xxhash64(*(F.lit(x).cast(t) for x, t in ((0, "int"), (i, "long"), (0, "int"), (i, "long"))))).first()[0]
    keys = [key(g) for g in range(20)]
    rows = [(c, [i % 20, *(c // 2 + j for j in range(1, minhash.FIRST[0]))], [i % 20, *(c // 2 + j for j in range(1, minhash.SECOND[0]))]) for i, pair in enumerate(numbers) for c in pair]
    classes = spark.createDataFrame(rows, "c long, first array<long>, second array<long>")
    texts = spark.createDataFrame([(c, t) for pair, ts in zip(numbers, sets, strict=True) for c, t in zip(pair, ts, strict=True)], "c long, text string")
    named = spark.createDataFrame([(keys[i % 20], c, c) for i, pair in enumerate(numbers) for c in pair], "key long, c long, g long")
    found = {(r["a"], r["b"]) for r in minhash.across(named, classes, texts, 2, 80).collect()}
    assert {tuple(sorted(pair)) for pair in numbers} <= found and len(found) < 2000


def test_minhash_decides_by_row(spark):
    common.narrow_batches(spark)
    text = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(5)]
    rows = [(1, text[0], "s"), (None, text[0], "s"), (None, text[1], "s"), (2, text[0], "s"), (2, text[2], "s"), (3, text[3], "s"), (3, text[3] + " end", "s"), (3, text[4], "s"), (3, text[4], "s")]
    left = [(r["doc_id"], r["text"]) for r in minhash.keep_one(frame(spark, rows)).collect()]
    near = [t for i, t in left if i == 3 and t != text[4]]
    assert len(near) == 1 and near[0].startswith(text[3])
    assert sorted((i for i in left if i[1] not in near), key=str) == sorted([(1, text[0]), (None, text[1]), (2, text[2]), (3, text[4])], key=str)


def test_components(spark):
    rng = random.Random(10)
    for edges in ([(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 200)], [(rng.randrange(300), rng.randrange(300)) for _ in range(200)], []):
        n = 1 + max((max(e) for e in edges), default=0)
        root = union_find(n, edges)
        found = {r[0]: r[1] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert all(found.get(i, i) == root[i] for i in range(n))


# ---- 9 and 10


def test_toxicity(spark):
    rng = random.Random(11)
    syllables = ["an", "the", "or", "ti", "re", "sho", "lin", "mar"]
    insults = ["blorkhead", "snivelwit", "grotmouth"]

    def text(bad):
        w = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(5, 60))]
        if bad:
            word = rng.choice(insults)
            w[rng.randrange(len(w))] = rng.choice([word, word, word, word + "s", word[:4] + "*" + word[4:], ".".join(word)])
        return " ".join(w)

    rows = [(i, text(i % 5 == 0), "s") for i in range(1500)]
    docs = spark.createDataFrame([*rows, *[(i + 10000, t, s) for i, t, s in ODD if i]], "doc_id long, text string, source string").withColumn("score", F.lit(9.0))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, *_ in rows] + [(3, None), (99999, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model).collect()
    assert len(found) == len(rows) + sum(1 for r in ODD if r[0]) and all(0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["doc_id"] < 1500 and toxicity.held_out(r["doc_id"])]
    good = [(r["score"] >= 0.7) == (r["doc_id"] % 5 == 0) for r in held]
    assert sum(good) / len(good) > 0.95
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_long_texts_end_no_sample(spark):
    ids = [i for i in range(120) if not toxicity.held_out(i)]
    first = spark.createDataFrame([(i,) for i in ids if i % 2], "i long").orderBy(F.xxhash64(F.lit(11), "i"), "i").first()[0]
    docs = spark.createDataFrame([(i, "word " * 2000 if i == first else "a blorkhead here" if i % 2 else "the sholin marti") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    found = toxicity.score(docs.where(F.col("doc_id") != first), toxicity.fit(docs, labels, max_chars=6000)).collect()
    assert len({round(r["score"], 6) for r in found}) > 1


def test_kernel_is_the_weights():
    words_ = ["insult", "i.n.sult", "übel", "", "a", "w" * 40]
    phi = toxicity.features(["insult", "clean"])
    weights = np.array([2.0, -1.0]) @ phi.astype(np.float64)
    assert np.allclose(toxicity.kernel(words_, phi) @ np.array([2.0, -1.0]), toxicity.word_scores(words_, weights), atol=1e-5)
    slow = Counter()
    coded = [30, *(ord(c) - 96 for c in "abc"), 31]
    for i, j, k in itertools.combinations(range(5), 3):
        if k - i < toxicity.SPAN:
            slow[(coded[i], coded[j], coded[k])] += toxicity.DECAY ** (k - i + 1)
    row = toxicity.features(["abc"])[0] * toxicity.norms(["abc"])[0]
    assert np.isclose(sum(v * v for v in slow.values()), float((row * row).sum()), rtol=1e-4)


def slow_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def test_quality(spark):
    common.narrow_batches(spark)
    rng = random.Random(12)
    texts = [r[0] for r in documents(spark).select("text").collect()] + ["".join(rng.choices(["a", "b ", " ", "\n", "#", "é", "\u00a0", "\t"], k=rng.randint(0, 40))) for _ in range(500)] + [t for _, t, _ in ODD]
    for t in texts:
        assert quality.counts(t)[:5] == slow_counts(t)
    docs, labels = documents(spark), spark.read.parquet(f"{DATA}/labels.parquet")
    judged = quality.judge(frame(spark), quality.fit(docs, labels)).collect()
    assert len(judged) == len(ODD) and not any(r["kept"] for r in judged if r["base_failed"])
    assert quality.judge(frame(spark).limit(0), []).count() == 0 and quality.fit(docs.limit(0), labels) == []


def test_decision_list(spark):
    rng = np.random.default_rng(13)
    x = pd.DataFrame(rng.random((3000, 3)), columns=["symbol_rate", "repeat_rate", "upper_rate"])
    bad = ((x["symbol_rate"] > 0.8) | ((x["repeat_rate"] > 0.6) & (x["upper_rate"] <= 0.3))).to_numpy()
    rules = quality.learn(x[:2000], bad[:2000])
    hit = np.zeros(1000, bool)
    for r in rules:
        hit |= r.holds(x[2000:])
    assert (hit == bad[2000:]).mean() > 0.97
    case = quality.as_case(rules)
    df = spark.createDataFrame(x[2000:].rename(columns=lambda c: f"r_{c}"))
    assert [not r[0] for r in df.select(F.expr(case)).collect()] == hit.tolist()
    assert quality.as_case([]) == "true" and quality.learn(x[:0], bad[:0]) == []


# ---- queries and the pipeline


def test_queries_have_rows(spark):
    for name, query in queries.QUERIES.items():
        assert query(spark, DATA).count() > 0, name


def test_warc_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{DATA}/pages.parquet'")
    found = queries.QUERIES["op1_warc"](spark, DATA)
    theirs = con.execute(queries.ORACLE["op1_warc"])
    order = [d[0] for d in theirs.description]
    assert sorted(map(str, theirs.fetchall())) == sorted(str(tuple(r[c] for c in order)) for r in found.collect())


def test_pipeline(spark):
    import corpus_pipeline

    docs = documents(spark)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.store(stage(spark, docs, DATA))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        assert 0 < out.count()
        docs = out
    assert zlib.crc32(b"") == 0 and corpus_pipeline.run(spark, DATA).count() > 0


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    full = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in ODD], documents(spark).schema)
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (full, full.limit(0)):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = common.store(stage(spark, docs, str(tmp_path)))
            assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == full.columns, name
