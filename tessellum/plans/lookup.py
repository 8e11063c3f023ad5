"""Search by an index, walks that know their direction, times as people say them and changelogs, on the relational tables; each query with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessellum.functions import scalar as X
from tessellum.operators import graph as G
from tessellum.operators import index as I
from tessellum.operators import sinks as K
from tessellum.plans import verbs
from tessellum.plans.matching import spaced_sql
from tessellum.plans.notes import folder
from tessellum.plans.queries import HIT, day, query, table
from tessellum.sources import responses as N
from tessellum.streaming import state as T

SOUGHT = ("that", "src3", "tion the", "conversation about something")


def score_sql(tags: str, title: str, body: str) -> str:
    return " + ".join(HIT.format(t=tags, h=title, b=body, w=w) for w in SOUGHT)


@query(f"""WITH r AS (SELECT 'documents' AS area, CAST(doc_id AS VARCHAR) AS path, {score_sql('source', "split_part(text, chr(10), 1)", 'text')} AS score FROM documents
UNION ALL SELECT 'talk', conv_id || '/' || turn, {score_sql('role', "''", 'text')} FROM conversations)
SELECT area, path, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY score DESC, path) AS k FROM r WHERE score > 0) WHERE k <= 5""")
def search_indexed(spark, sf_dir):
    """The hits of a scan, from an index that a first day filled with other texts of the documents and a second brought up to date."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.array("source").alias("tags"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"))
    talk = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("path"), F.array("role").alias("tags"), F.lit("").alias("title"), F.col("text").alias("body"))
    areas, path = {"documents": docs, "talk": talk}, folder(spark)
    I.build({"documents": docs.withColumns({"title": F.lit("that of src3"), "body": F.lit("not that any more")})}, path, "2026-01-01")
    I.build(areas, path, "2026-01-02")
    return I.find(spark, path, list(SOUGHT), areas=areas).select("area", "path", F.col("score").cast("long").alias("score"))


@query("""WITH RECURSIVE n AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem), c AS (SELECT src, dst, count(*) AS n FROM n WHERE dst IS NOT NULL GROUP BY 1, 2),
e AS MATERIALIZED (SELECT src, dst, way, CASE WHEN (src + dst) % 3 = 0 THEN 'sum ' || (src + dst) END AS reason FROM (
SELECT src, dst, 'up' AS way FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r FROM c) WHERE r = 1
UNION ALL SELECT dst, src, 'down' FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY n DESC, src) AS r FROM c) WHERE r = 1
UNION ALL SELECT p_partkey, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey), 'parallel' FROM part) WHERE dst IS NOT NULL),
a AS (SELECT l_partkey AS node FROM lineitem GROUP BY 1 ORDER BY sum(l_quantity) DESC, 1 LIMIT 5),
w(node, way, hop, path) AS (SELECT node, 'anchor', 0, [{'n': node, 'w': 'anchor'}] FROM a
UNION ALL SELECT node, way, hop, path FROM (SELECT *, row_number() OVER (PARTITION BY node, way ORDER BY path) AS r FROM (SELECT e.dst AS node, e.way, w.hop + 1 AS hop, list_append(w.path, {'n': e.dst, 'w': e.way}) AS path FROM w JOIN e ON e.src = w.node WHERE w.hop < 6 AND (w.hop < 3 OR e.reason IS NOT NULL))) WHERE r = 1),
s AS MATERIALIZED (SELECT node, way, min(hop) AS hop, arg_min(path, hop) AS path FROM w GROUP BY 1, 2),
k AS (SELECT e.dst AS node, e.way, s.hop + 1 AS hop, list_append(s.path, {'n': e.dst, 'w': e.way}) AS path, e.reason, CASE WHEN s.hop = 6 THEN 'hard' ELSE 'soft' END AS stop FROM s JOIN e ON e.src = s.node WHERE s.hop = 6 OR (s.hop >= 3 AND e.reason IS NULL)),
f AS (SELECT node, way, hop, path, reason, stop FROM (SELECT k.*, row_number() OVER (PARTITION BY node, way ORDER BY hop, path, reason) AS r FROM k ANTI JOIN s USING (node, way)) WHERE r = 1)
SELECT node, way, CAST(hop AS INTEGER) AS hop, array_to_string([x.w || ' ' || x.n FOR x IN path], ' > ') AS path, reason, stop FROM (SELECT node, way, hop, path, NULL AS reason, NULL AS stop FROM s UNION ALL SELECT * FROM f)""")
def chain_walk(spark, sf_dir):
    """From the five parts of the largest quantity: up to what mostly follows a part in orders, down to what mostly precedes it, parallel to the next of its brand; soft stop 3 and hard stop 6, as these chains are dense."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    items = table(spark, sf_dir, "lineitem")
    pairs = items.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst")).where("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))
    up = pairs.groupBy("src").agg(F.max_by("dst", F.struct("n", (-F.col("dst")).alias("least"))).alias("dst")).withColumn("way", F.lit("up"))
    down = pairs.groupBy(F.col("dst").alias("from")).agg(F.max_by("src", F.struct("n", (-F.col("src")).alias("least"))).alias("to")).selectExpr("from as src", "to as dst", "'down' as way")
    beside = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), F.lead("p_partkey").over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("dst"), F.lit("parallel").alias("way"))
    edges = up.unionByName(down).unionByName(beside).where("dst is not null").withColumn("reason", F.expr("if((src + dst) % 3 = 0, concat('sum ', src + dst), null)"))
    anchors = items.groupBy(F.col("l_partkey").alias("node")).agg(F.sum("l_quantity").alias("q")).orderBy(F.col("q").desc(), "node").limit(5)
    states, clues = G.walk(edges, anchors, 3, 6)
    rows = states.unionByName(clues, allowMissingColumns=True)
    return rows.select("node", "way", "hop", F.array_join(F.transform("path", lambda x: F.concat(x["way"], F.lit(" "), x["node"])), " > ").alias("path"), "reason", "stop")


#: What is said by each tenth of the events.
SAID = ("下午 3 点", "明天上午 10 点", "后天 9 点半", "下周三 14 点", "每周五 9 点", "每天 8 点", "tomorrow 7:05 pm", "next Wednesday at 12 am", "every Monday 25:00", "some time")


@query("""WITH e AS (SELECT event_id, ts, CAST(ts AS DATE) AS d, event_id % 10 AS k FROM events)
SELECT event_id, CASE k WHEN 0 THEN '15:00' WHEN 1 THEN strftime(d + 1, '%-m/%-d') || ' 10:00' WHEN 2 THEN strftime(d + 2, '%-m/%-d') || ' 09:30' WHEN 3 THEN strftime(CAST(date_trunc('week', d) AS DATE) + 9, '%-m/%-d') || ' 14:00' WHEN 4 THEN 'Fri 09:00' WHEN 5 THEN '08:00'
WHEN 6 THEN strftime(d + 1, '%-m/%-d') || ' 19:05' WHEN 7 THEN strftime(d + CAST((9 - isodow(d)) % 7 + 1 AS INTEGER), '%-m/%-d') || ' 00:00' END AS spec,
CASE WHEN k = 0 THEN strftime(ts, '%H:%M') > '15:00' WHEN k < 8 THEN false END AS passed FROM e""")
def reminders_said(spark, sf_dir):
    """Times as people say them, from each event's own clock."""
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.col("event_id") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", X.reminder(said, F.col("ts")).alias("x")).select("event_id", "x.spec", "x.passed")


@query("""WITH c AS (SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS run_ts, o_orderkey % 4 AS p, 'v' || o_orderkey AS entity, o_orderstatus AS old, coalesce(nullif(o_orderpriority, '5-LOW'), '-') AS new, o_custkey, o_orderkey % 7 = 0 AS waits FROM orders),
r AS (SELECT run_ts, count(*) AS n, count(*) FILTER (p = 0) AS p0, count(*) FILTER (p = 1) AS p1, count(*) FILTER (p = 2) AS p2, count(*) FILTER (waits) AS w FROM c GROUP BY 1)
SELECT run_ts, 0 AS section, NULL AS entity, '## ' || run_ts || ' · sweep' || chr(10) || chr(10) || '**汇总**：变更 ' || n || ' 条（P0 ×' || p0 || '，P1 ×' || p1 || '，P2 ×' || p2 || '）' AS line FROM r
UNION ALL SELECT run_ts, 1, NULL, '#### P0 实时推送' FROM r WHERE p0 > 0 UNION ALL SELECT run_ts, 2, NULL, '#### P1 日报告' FROM r WHERE p1 > 0 UNION ALL SELECT run_ts, 3, NULL, '#### P2 仅 changelog' FROM r WHERE p2 > 0 UNION ALL SELECT run_ts, 4, NULL, '#### 待二次确认' FROM r WHERE w > 0
UNION ALL SELECT run_ts, 1, entity, '- `auto-state ' || entity || '`' || chr(10) || '  旧: ' || old || ' / 新: ' || new || chr(10) || '  影响: ' || o_custkey FROM c WHERE p = 0
UNION ALL SELECT run_ts, p + 1, entity, '- `auto-state ' || entity || '` ' || old || ' → ' || new FROM c WHERE p IN (1, 2)
UNION ALL SELECT run_ts, 4, entity, '- ' || entity || '（连续 2 次判定失效，待第 3 次确认）' FROM c WHERE waits""")
def changelog_sections(spark, sf_dir):
    """The lines of a run's paragraph, section by section."""
    rows = table(spark, sf_dir, "orders").selectExpr("date_format(o_orderdate, 'yyyy-MM-dd') as run_ts", "concat('P', o_orderkey % 4) as priority", "'auto-state' as action", "concat('v', o_orderkey) as entity", "o_orderstatus as old", "nullif(o_orderpriority, '5-LOW') as new", "cast(o_custkey as string) as impact", "o_orderkey % 7 = 0 as waits")
    return K.changelog_lines(rows.drop("waits"), rows.where("waits").select("run_ts", "entity", F.lit(2).alias("streak"))).withColumn("section", F.col("section").cast("int"))


@query(f"""WITH e AS (SELECT doc_id AS event, lang, {spaced_sql('text')} AS t FROM documents), l(lens, domain, word) AS (VALUES ('a', 'en', 'the'), ('a', 'en', 'of the'), ('b', 'en', 'tion'), ('c', 'en', 'ing'), ('d', 'fr', 'que'), ('d', 'fr', 'er'), ('e', 'de', 'ed')),
m AS (SELECT event, lang, lens, domain, count(*) AS met FROM e JOIN l ON contains(t, ' ' || word || ' ') GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY met DESC, lens) AS k FROM m),
f AS (SELECT event, min(k) AS first FROM r WHERE domain IS DISTINCT FROM lang GROUP BY 1)
SELECT event, lens, met FROM r LEFT JOIN f USING (event) WHERE k <= CASE WHEN coalesce(first <= 2, true) THEN 2 ELSE 1 END OR (first > 2 AND k = first)""")
def lens_of_other_domain(spark, sf_dir):
    """The verb's two best lenses of a document, one at least of another language than its own."""
    lenses = spark.createDataFrame([("a", "en", ["the", "of the"]), ("b", "en", ["tion"]), ("c", "en", ["ing"]), ("d", "fr", ["que", "er"]), ("e", "de", ["ed"])], "lens string, domain string, signals array<string>")
    return verbs.lens(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event"), "text", F.col("lang").alias("domain")), lenses, 2).select("event", "lens", "met")


@query("""WITH t AS (SELECT o_orderkey AS id, o_orderstatus = 'F' AS done, o_orderkey % 5 = 0 AS long_term, CAST(o_orderdate AS DATE) AS created FROM orders)
SELECT id, CASE WHEN done THEN 'done' WHEN NOT long_term AND created < DATE '1998-06-29' THEN 'deferred' ELSE 'active' END AS place, CASE WHEN done OR (NOT long_term AND created < DATE '1998-06-29') THEN '1998-W27-3' END AS file FROM t""")
def week_closed(spark, sf_dir):
    """Orders as todos; the week's first two names are taken, and a later one."""
    todos = table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "o_orderstatus = 'F' as done", "o_orderkey % 5 = 0 as long_term", "to_date(o_orderdate) as created")
    taken = spark.createDataFrame([("1998-W27",), ("1998-W27-2",), ("1998-W27-4",), ("1998-W26-3",), ("notes",)], "name string")
    return K.closed_week(todos, taken, day("1998-07-01")).select("id", "place", "file")


@query("""WITH a AS (SELECT url, html, CASE WHEN page_id % 3 = 0 THEN 1 WHEN page_id % 5 <> 0 THEN 2 WHEN page_id % 2 = 0 THEN 3 END AS rank FROM pages WHERE html IS NOT NULL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY rank, html) AS k FROM a WHERE rank IS NOT NULL) WHERE k = 1)
SELECT p.url, CASE rank WHEN 1 THEN 'primary' WHEN 2 THEN 'fallback' WHEN 3 THEN 'later fallback' ELSE 'waiting' END AS state, rank IS NULL AS retry, length(html) AS n_chars FROM (SELECT DISTINCT url FROM pages) p LEFT JOIN b USING (url)""")
def fetched_by_tools(spark, sf_dir):
    """Pages as the tools stored them in two runs; what both tools failed at in the first is asked for again in the second."""
    pages, path = table(spark, sf_dir, "pages"), folder(spark)
    answer = lambda tool, status, some: pages.where(some).selectExpr(f"'{tool}' as tool", "url", f"cast({status} as int) as status", "html as body")
    first = answer("primary", "if(page_id % 3 = 0, 200, 503)", "page_id % 3 < 2").unionByName(answer("fallback", "if(page_id % 5 = 0, 404, 200)", "page_id % 3 > 0"))
    first.write.partitionBy("tool").json(f"{path}/1")
    answer("fallback", "200", "page_id % 3 > 0 and page_id % 5 = 0 and page_id % 2 = 0").write.partitionBy("tool").json(f"{path}/2")
    one = N.chosen(pages, N.stored(spark, f"{path}/1"))
    two = N.chosen(one.where("failed"), N.stored(spark, f"{path}/2"))
    waiting = pages.select("url", F.lit("waiting").alias("state")).distinct()
    states = T.carried(waiting, one.where("not failed").select("url", F.col("tool").alias("state")), "url")
    again = T.carried(states.where("retry").drop("retry"), two.where("not failed").select("url", F.concat(F.lit("later "), "tool").alias("state")), "url")
    sizes = one.unionByName(two).where("not failed").select("url", F.length("body").alias("n_chars"))
    return states.where("not retry").unionByName(again).join(sizes, "url", "left").select("url", "state", "retry", "n_chars")
