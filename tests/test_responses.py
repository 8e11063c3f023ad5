"""Stored responses: every line once however files are cut, damaged ones marked, tools in their order."""

from __future__ import annotations

import json

import pytest

from tessellum.sources import responses as N


def test_every_line_once(spark, tmp_path):
    lines = [json.dumps({"url": f"http://a/{i}", "status": 200 if i % 4 else 503, "body": "é" * (i % 7) + "\n" * (i % 3)}, ensure_ascii=i % 2 == 0) for i in range(60)]
    lines += ["", "not json", "[1]", json.dumps({"url": 5, "status": "200", "body": None}), json.dumps({"url": "http://long", "status": 200, "body": "x" * 3_000_000})]
    for tool, text in (("primary", "\n".join(lines)), ("fallback", "\n".join(lines[:3]) + "\n"), ("other", lines[0])):
        (tmp_path / f"tool={tool}").mkdir()
        (tmp_path / f"tool={tool}" / "part.json").write_text(text, encoding="utf-8")
    (tmp_path / "tool=primary" / "_SUCCESS").write_text("x")
    (tmp_path / "tool=primary" / "empty.json").write_text("")
    row = lambda tool, line: (tool, *N.parsed(line.encode()))
    expected = sorted([row("primary", x) for x in lines if x] + [row("fallback", x) for x in lines[:3]], key=str)
    assert expected.count(("primary", None, None, "not json")) == 1 and ("primary", None, None, None) in expected
    for split in (N.SPLIT, 400_001):
        assert sorted(map(tuple, N.stored(spark, str(tmp_path), split=split).collect()), key=str) == expected
    for start in range(40):  # each cut of a small file
        whole = [*N.lines_of(N.file_system("/")[0], f"{tmp_path}/tool=fallback/part.json", 0, start), *N.lines_of(N.file_system("/")[0], f"{tmp_path}/tool=fallback/part.json", start, 10_000)]
        assert [x.decode() for x in whole if x] == lines[:3]
    assert N.stored(spark, str(tmp_path / "nothing")).count() == 0


def test_off_by_default(spark, tmp_path):
    spark.dataSource.register(N.StoredResponses)
    with pytest.raises(Exception, match="fetching is off"):
        spark.read.format("stored_responses").load(str(tmp_path)).collect()


def test_tools_in_order(spark):
    found = [("primary", "a", 503, "no"), ("fallback", "a", 200, "yes"), ("primary", "b", 200, "z"), ("primary", "b", 204, "y"), ("fallback", "b", 200, "a"), ("primary", "c", 200, None), ("other", "d", 200, "x"), ("primary", None, 200, "x")]
    answers = spark.createDataFrame(found, N.SCHEMA)
    urls = spark.createDataFrame([(u, 1) for u in ("a", "a", "b", "c", "d", "e", None)], "url string, body int")
    rows = {r["url"]: (r["tool"], r["body"], r["failed"]) for r in N.chosen(urls, answers).collect()}
    assert rows == {"a": ("fallback", "yes", False), "b": ("primary", "y", False), **dict.fromkeys(["c", "d", "e", None], (None, None, True))}
    assert N.chosen(urls.limit(0), answers).count() == 0 and N.chosen(urls, answers.limit(0)).where("not failed").count() == 0
