"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from tests.conftest import DATA
from tessellum.plans import hygiene, lookup, matching, notes, queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_equals_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, DATA)
    cols = sorted(found.columns)
    ours = [tuple(plain(r[c]) for c in cols) for r in found.collect()]
    result = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    theirs = [tuple(plain(r[names.index(c)]) for c in cols) for r in result.fetchall()]
    assert ordered(ours) == ordered(theirs)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_titles_of_all_languages(spark, tmp_path):
    rows = [(lang, "".join("éüñ漢a"[(i * k) % 5] if k % 4 == 0 else c for k, c in enumerate("a title of some length, no more"))[: 28 + i % 3]) for lang in ("en", "fr", "de", "es") for i in range(12)]
    spark.createDataFrame([(i, t + "\ntext", lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    expected = sorted((g, a, b) for g, a in set(rows) for h, b in set(rows) if g == h and a < b and edits(a, b) <= 5)
    found = queries.QUERIES["near_dup_title_langs"](spark, str(tmp_path)).select("lang", "first_title", "second_title").collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert {g for g, *_ in expected} == {"en", "fr", "de", "es"}
    assert sorted(map(tuple, found)) == expected == sorted(con.execute(queries.ORACLE["near_dup_title_langs"]).fetchall())
