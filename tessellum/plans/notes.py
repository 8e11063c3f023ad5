"""Operators on texts, states and change rows, on notes rendered from the relational tables; each query with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.functions import scalar as X
from tessellum.operators import aggregates as A
from tessellum.operators import filters as FL
from tessellum.operators import graph as G
from tessellum.operators import joins as J
from tessellum.operators import ranking as R
from tessellum.operators import sinks as K
from tessellum.operators import windows as W
from tessellum.operators.graph import dropped_at_end, shared_folder
from tessellum.plans import verbs
from tessellum.plans.queries import QUERIES, day, query, table
from tessellum.sources import markdown as M
from tessellum.streaming import state as T

#: A part as a note: nine in ten have a header; every body has an intro, a task and an alarm.
NOTE = r"""concat(if(p_partkey % 10 = 0, '', concat('---\nname: ', p_name, '\nbrand: "', p_brand, '"\ntags: [', p_type, ', s', p_size, ']\nsize: 0\nsize: ', p_size, '\n---\n')),
'Intro of ', p_partkey, '\n## Work\n- [', if(p_size % 2 = 0, 'x', ' '), '] check ', p_name, ' `created: 2001-02-03` `cadence: weekly`\nplain line\n### Lens\n- ⏰ look `remind: Mon 09:30`\n')"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.expr("concat('/base/wiki/variables/', p_partkey, '.md')").alias("path"), F.expr(NOTE).alias("text")).withColumn("kind", M.kind_of(F.col("path")))


def number():
    """The number in a note's path."""
    return F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long").alias("id")


def folder(spark: SparkSession) -> str:
    return dropped_at_end(spark, f"{shared_folder(spark).rstrip('/')}/notes-{uuid.uuid4().hex}")


def orders(spark, sf_dir, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*columns)


def part(spark, sf_dir, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*columns)


@query("""SELECT p_partkey AS id, 'variable' AS kind, CASE WHEN p_partkey % 10 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 10 <> 0 THEN p_brand END AS brand,
CASE WHEN p_partkey % 10 <> 0 THEN CAST(p_size AS VARCHAR) END AS size, CASE WHEN p_partkey % 10 <> 0 THEN p_type || '/s' || p_size ELSE '' END AS tags, CAST(NULL AS VARCHAR) AS lacking FROM part""")
def note_headers(spark, sf_dir):
    """Of a repeated key the last holds; a missing one is null."""
    rows = M.headers(notes(spark, sf_dir))
    whole = M.meta(rows.withColumn("tags", F.array_join(M.list_of(X.header(F.col("fields"), "tags")), "/")), "name", "brand", "size", "lacking")
    tags = rows.select("path", F.array_join(M.list_of(X.header(F.col("fields"), "tags")), "/").alias("tags"))
    return whole.join(tags, "path").select(number(), "kind", "name", "brand", "size", "tags", "lacking")


@query(r"""SELECT p_partkey AS id, 0 AS ord, 0 AS level, CAST(NULL AS VARCHAR) AS heading, 'Intro of ' || p_partkey || chr(10) AS section FROM part
UNION ALL SELECT p_partkey, 1, 2, 'Work', '- [' || CASE WHEN p_size % 2 = 0 THEN 'x' ELSE ' ' END || '] check ' || p_name || ' `created: 2001-02-03` `cadence: weekly`' || chr(10) || 'plain line' || chr(10) FROM part
UNION ALL SELECT p_partkey, 2, 3, 'Lens', '- ⏰ look `remind: Mon 09:30`' || chr(10) FROM part""")
def note_sections(spark, sf_dir):
    """S11."""
    return M.sections(M.headers(notes(spark, sf_dir))).select(number(), "ord", "level", "heading", "section")


@query("""SELECT p_partkey AS id, 2 AS ord, 'Work' AS section, p_size % 2 = 0 AS checked, 'check ' || p_name AS text, '2001-02-03' AS created, 'weekly' AS cadence, CAST(NULL AS VARCHAR) AS remind FROM part
UNION ALL SELECT p_partkey, 5, 'Lens', NULL, 'look', NULL, NULL, 'Mon 09:30' FROM part""")
def note_tasks(spark, sf_dir):
    """S12, W18, X05, X27."""
    return M.tasks(M.headers(notes(spark, sf_dir))).select(number(), "ord", "section", "checked", "text", "created", "cadence", "remind")


@query("""SELECT p_partkey AS id, '000' AS number, 'One ' || p_name AS title FROM part UNION ALL SELECT p_partkey, '001', 'Chapter 2' FROM part WHERE p_size % 2 = 0""")
def book_chapters(spark, sf_dir):
    """S09, V06."""
    spark.udtf.register("note_chapters", M.Chapters)
    part(spark, sf_dir, "p_partkey as id", r"concat('# One ', p_name, '\nwords\n', if(p_size % 2 = 0, 'Chapter 2\nmore\n', '')) as text").createOrReplaceTempView("note_books")
    return spark.sql("select id, number, title from note_books, lateral note_chapters(text)")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS variable_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS first_detected, o_orderkey % 4 AS n FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey % 7 > 0""")
def closing_queue(spark, sf_dir):
    """Damaged and empty state files give no rows."""
    row = "named_struct('variable_id', cast(o_custkey as string), 'first_detected', to_date(o_orderdate), 'consecutive_likely_dead', o_orderkey % 4)"
    text = f"""case when o_orderkey % 5 = 0 then '{{"pending_close": [' when o_orderkey % 7 = 0 then '{{}}' else to_json(named_struct('pending_close', array({row}))) end"""
    return M.staging(orders(spark, sf_dir, f"{text} as text")).select("variable_id", F.col("first_detected").cast("string").alias("first_detected"), F.col("consecutive_likely_dead").cast("long").alias("n"))


@query("SELECT 'K_' || n_nationkey AS key, n_name AS value FROM nation WHERE n_nationkey % 5 > 0 UNION ALL SELECT 'K_' || n_nationkey, 'default' FROM nation WHERE n_nationkey % 5 = 0")
def settings_lines(spark, sf_dir):
    """Assignments over defaults; comments and blank lines aside."""
    keys = table(spark, sf_dir, "nation").orderBy("n_nationkey")
    lines = keys.selectExpr("""case when n_nationkey % 5 = 0 then concat('# K_', n_nationkey, '=no') when n_nationkey % 2 = 0 then concat('export K_', n_nationkey, '="', n_name, '"') else concat('K_', n_nationkey, '=', n_name, '   # why') end as value""")
    return M.settings(lines, {f"K_{k}": "default" for k in range(0, 25)})


@query("SELECT event_type || '-' || user_id AS task, CAST(max(floor(epoch(ts))) AS BIGINT) AS epoch FROM events WHERE event_id % 9 > 0 GROUP BY 1")
def last_run_lines(spark, sf_dir):
    """The latest run of each task; damaged lines aside."""
    rows = table(spark, sf_dir, "events").withColumn("at", X.epoch(F.col("ts").cast("timestamp")))
    return M.last_runs(rows.selectExpr("if(event_id % 9 = 0, 'damaged line', concat(event_type, '-', user_id, '=', at, ' # run')) as value"))


@query("""SELECT o_orderkey AS path, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1999-12-16' AND DATE '2000-01-15' ORDER BY 2 DESC, 1 LIMIT 50""")
def recent_cards(spark, sf_dir):
    """At most 50 cards of the last 30 days."""
    return M.recent(orders(spark, sf_dir, "o_orderkey as path", "to_date(o_orderdate) as date"), "2000-01-15").select("path", F.col("date").cast("string").alias("date"))


@query("SELECT o_orderkey AS id, o_custkey AS target, o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS is_holding FROM orders")
def holdings_marked(spark, sf_dir):
    """S04."""
    held = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").selectExpr("c_custkey as target")
    return M.holdings_first(orders(spark, sf_dir, "o_orderkey as id", "o_custkey as target"), held).select("id", "target", "is_holding")


@query("SELECT s_suppkey AS id FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE lower(n_name) = (SELECT lower(n_name) FROM nation WHERE n_nationkey = 3) OR n_nationkey = 3)")
def rows_of_target(spark, sf_dir):
    """By any of a target's names, case aside."""
    nations = table(spark, sf_dir, "nation")
    aliases = nations.selectExpr("n_name as alias", "n_nationkey as target").unionByName(nations.selectExpr("concat('ticker', n_nationkey) as alias", "n_nationkey as target"))
    return M.of_target(table(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "s_nationkey as target"), aliases, "TICKER3").select("id")


@query("SELECT url, CASE WHEN page_id % 3 = 0 THEN 'primary' ELSE 'fallback' END AS tool FROM pages")
def fetched_pages(spark, sf_dir):
    """The first tool's pages, the second's for the rest."""
    rows = table(spark, sf_dir, "pages").select("url", "page_id")
    return M.fetched(rows, rows.where("page_id % 3 = 0")).select("url", "tool")


@query("""SELECT p_partkey AS id, s.sectors, coalesce(e.edges, 0) AS edges FROM part LEFT JOIN (SELECT l_partkey, string_agg(DISTINCT c_mktsegment, '/' ORDER BY c_mktsegment) AS sectors FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_returnflag = 'R' GROUP BY 1) s ON s.l_partkey = p_partkey
LEFT JOIN (SELECT l_partkey, count(*) AS edges FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) e ON e.l_partkey = p_partkey""")
def variable_catalogue(spark, sf_dir):
    """S15."""
    items = table(spark, sf_dir, "lineitem")
    sector = items.where("l_returnflag = 'R'").selectExpr("l_partkey as id", "l_orderkey as o_orderkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").join(table(spark, sf_dir, "customer").selectExpr("c_custkey as o_custkey", "c_mktsegment as sector"), "o_custkey").select("id", "sector")
    edges = items.where("l_linenumber = 1").selectExpr("l_partkey as src")
    return M.catalogue(part(spark, sf_dir, "p_partkey as id"), sector, edges).select("id", F.array_join("sectors", "/").alias("sectors"), "edges")


@query("SELECT o_orderkey AS path, 'T' || o_custkey AS title, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS review_date FROM orders WHERE o_orderkey % 6 > 0")
def hand_over(spark, sf_dir):
    """Lines without a date are dropped."""
    path = folder(spark)
    orders(spark, sf_dir, "concat(o_orderkey, '|T', o_custkey, '|', if(o_orderkey % 6 = 0, 'no day', cast(to_date(o_orderdate) as string))) as value").write.text(path)
    return M.handed_over(spark, path).select(F.col("path").cast("long").alias("path"), "title", F.col("review_date").cast("string").alias("review_date"))


@query("SELECT user_id AS target, strftime(ts, '%Y-%m-%d %H') AS hour, max(value) AS value FROM events GROUP BY 1, 2")
def hourly_quotes(spark, sf_dir):
    """Of several values of one time the greatest holds."""
    rows = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "value")
    return M.quotes(rows, "user_id", "hour").select("target", F.col("ts").alias("hour"), "value")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN c_mktsegment END AS note FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def personal_context(spark, sf_dir):
    """For personal questions alone."""
    context = table(spark, sf_dir, "customer").selectExpr("c_custkey as owner", "c_mktsegment as note")
    return M.with_context(orders(spark, sf_dir, "o_orderkey as id", "o_custkey as owner"), context, F.col("id") % 2 == 0).select("id", "note")


@query("SELECT n.o_orderstatus AS kind, n.o_orderkey AS id FROM orders n")
def index_fallback(spark, sf_dir):
    """The index lacks rows, so the folders hold."""
    rows = orders(spark, sf_dir, "o_orderstatus as kind", "o_orderkey as id")
    return M.index_or_scan(rows.where("id % 2 = 0"), rows)


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'lens' ELSE 'skill' END AS family FROM part WHERE p_size % 2 = 0 AND p_partkey % 3 = 0 OR p_size % 2 = 1 AND p_partkey % 3 = 1")
def lens_section_families(spark, sf_dir):
    """S22, U03."""
    rows = part(spark, sf_dir, "concat(if(p_size % 2 = 0, '/base/lenses/', '/base/skills/'), p_partkey, '.md') as path", "case p_partkey % 3 when 0 then 'Lens' when 1 then 'Method' else 'Other' end as heading")
    return M.lens_sections(rows).select(number(), "family")


@query("SELECT p_partkey AS id FROM part WHERE p_brand IN (SELECT 'Brand#' || s_nationkey FROM supplier)")
def distilled_books(spark, sf_dir):
    """S23."""
    return M.distilled(part(spark, sf_dir, "p_partkey as id", "p_brand as book"), table(spark, sf_dir, "supplier").selectExpr("concat('Brand#', s_nationkey) as book")).select("id")


@query("SELECT o_orderkey AS id, '1998-W53' AS week FROM orders WHERE o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1998-12-28' AND DATE '1999-01-03'")
def archived_week(spark, sf_dir):
    """A week that belongs to the year before in part."""
    archive = K.weekly_archive(orders(spark, sf_dir, "o_orderkey as id", "to_date(o_orderdate) as completed", "o_orderstatus = 'F' as done"))
    return M.archive_week(archive, 1998, 53).select("id", "week")


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1")
def inbox_files(spark, sf_dir):
    """Files that have arrived, as a stream that ends when all are read."""
    path = folder(spark)
    table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").cast("string")).repartition(4).write.text(path)
    T.change_stream(M.inbox_stream(spark, path).select("text"), f"{path}-out", f"{path}-checkpoint").awaitTermination()
    lines = spark.read.schema("text string").parquet(f"{path}-out").select(F.explode(F.split(F.rtrim("text"), "\n")).alias("line")).where("line <> ''")
    return lines.groupBy(F.col("line").cast("long").alias("user_id")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def raw_archive(spark, sf_dir):
    """Originals by month, read back; a second run adds, and overwrites nothing, a third, of all rows, adds none."""
    path, rows = folder(spark), orders(spark, sf_dir, "o_orderkey as id", "to_date(o_orderdate) as fetched")
    for some in ("id % 2 = 0", "id % 2 = 1", "true"):
        K.archive_raw(rows.where(some).select("id", "fetched"), path, key="id")
    return spark.read.schema("id long, month string").parquet(path)


@query("SELECT o_orderstatus AS kind, count(*) AS recorded, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS updated FROM orders GROUP BY 1")
def index_counters(spark, sf_dir):
    """K03."""
    return K.index_view(orders(spark, sf_dir, "o_orderstatus as kind", "to_date(o_orderdate) as date")).select("kind", "recorded", F.col("updated").cast("string").alias("updated"))


@query("SELECT event_type, count(*) * 2 AS n FROM events GROUP BY 1")
def processing_log(spark, sf_dir):
    """Appended twice, both stay."""
    path, rows = folder(spark), table(spark, sf_dir, "events").select("event_type")
    K.append_log(rows, path)
    K.append_log(rows, path)
    return A.counted(spark.read.schema(rows.schema).parquet(path), "event_type")


@query("""WITH c AS (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS run_ts, 'P' || (o_orderkey % 3) AS p, '- [P' || (o_orderkey % 3) || '] v' || o_orderkey || ': ' || o_orderstatus || ' -> ' || coalesce(nullif(o_orderpriority, '5-LOW'), '-') AS line, o_orderkey % 7 = 0 AS pending FROM orders)
SELECT run_ts, 'P0 ' || count(*) FILTER (p = 'P0') || ', P1 ' || count(*) FILTER (p = 'P1') || ', P2 ' || count(*) FILTER (p = 'P2') || ', pending ' || count(*) FILTER (pending) || chr(10) || string_agg(line, chr(10) ORDER BY line) AS text FROM c GROUP BY 1""")
def changelogs(spark, sf_dir):
    """A text per run."""
    return K.changelog(orders(spark, sf_dir, "cast(to_date(o_orderdate) as string) as run_ts", "concat('P', o_orderkey % 3) as priority", "concat('v', o_orderkey) as entity", "o_orderstatus as old", "nullif(o_orderpriority, '5-LOW') as new", "o_orderkey % 7 = 0 as pending"))


@query("SELECT p_type AS relation, string_agg(p_name, '/' ORDER BY p_name) AS items FROM part GROUP BY 1")
def connection_index(spark, sf_dir):
    """K06, A22, A23."""
    return A.grouped_index(part(spark, sf_dir, "p_type as relation", "p_name"), "relation", "p_name").select("relation", F.array_join("items", "/").alias("items"))


@query("SELECT l_orderkey AS id, l_partkey AS issue FROM lineitem WHERE l_returnflag = 'R' AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def issues_to_write(spark, sf_dir):
    """K07, U05."""
    found = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").selectExpr("l_orderkey as id", "l_partkey as issue")
    return K.new_issues(found, part(spark, sf_dir, "p_partkey as issue", "p_size").where("p_size < 25")).select("id", "issue")


@query("SELECT p_partkey AS variable, CASE WHEN p_size % 3 = 0 THEN -1 ELSE p_size END AS n FROM part UNION ALL SELECT p_partkey + 1000000000, -1 FROM part WHERE p_size % 3 = 0")
def staging_upsert(spark, sf_dir):
    """K08, K16, K25."""
    held = part(spark, sf_dir, "p_partkey as variable", "p_size as n")
    news = held.where("n % 3 = 0").select(F.explode(F.expr("array(variable, variable + 1000000000)")).alias("variable"), F.lit(-1).alias("n"))
    return K.upserted(held, news, "variable").select("variable", "n")


@query("SELECT p_partkey AS notice FROM part WHERE p_size % 4 > 0")
def unread_notices(spark, sf_dir):
    """K10."""
    rows = part(spark, sf_dir, "p_partkey as notice", "p_size")
    return K.mailbox(rows.select("notice"), rows.where("p_size % 4 = 0"))


@query("SELECT p_partkey AS id FROM part WHERE p_size % 3 = 1")
def drafts_with_sources(spark, sf_dir):
    """K13."""
    return K.sourced_drafts(part(spark, sf_dir, "p_partkey as id", "case p_size % 3 when 0 then cast(array() as array<string>) when 1 then array(p_brand) end as sources")).select("id")


@query("SELECT p_brand AS plan, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 4 + 1, p_partkey) AS place, p_size % 4 + 1 AS stage, p_name AS title, false AS done FROM part")
def learning_plans(spark, sf_dir):
    """The nested items of each plan, in their order."""
    plans = K.learning_plan(part(spark, sf_dir, "p_brand as plan", "p_size % 4 + 1 as stage", "p_partkey as ord", "p_name as title", "cast(p_partkey as string) as path"))
    return plans.select("plan", F.posexplode("items").alias("p", "i")).select("plan", (F.col("p") + 1).cast("long").alias("place"), "i.stage", "i.title", "i.done")


@query("SELECT p_partkey AS id, p_brand || '-v2' AS slug FROM part")
def topic_backup(spark, sf_dir):
    """K19."""
    return K.backup(part(spark, sf_dir, "p_partkey as id", "p_brand as slug"), 2)


@query("""SELECT coalesce(a.id, b.id) AS item, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'gone' WHEN a.v <> b.v THEN 'revised' ELSE 'valid' END AS status
FROM (SELECT p_partkey AS id, p_size AS v FROM part WHERE p_size % 5 > 0) a FULL JOIN (SELECT p_partkey AS id, p_size + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS v FROM part WHERE p_size % 7 > 0) b ON a.id = b.id""")
def verb_by_name(spark, sf_dir):
    """An entry verb by its registered name."""
    rows = part(spark, sf_dir, "p_partkey as item", "p_size as value")
    return verbs.invoke("refresh", rows.where("value % 5 > 0"), rows.where("value % 7 > 0").withColumn("value", F.expr("value + if(item % 4 = 0, 1, 0)"))).select("item", "status")


@query("SELECT d.doc_id AS id, l.toxic AS verdict FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def judged_cards(spark, sf_dir):
    """Verdicts are given; without one, null."""
    return verbs.judged(table(spark, sf_dir, "documents").selectExpr("doc_id as id"), table(spark, sf_dir, "labels").selectExpr("doc_id as id", "toxic as verdict"), "id").select("id", "verdict")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O'")
def active_followups(spark, sf_dir):
    """F04."""
    return FL.active(orders(spark, sf_dir, "o_orderkey as id", "if(o_orderstatus = 'O', 'active', 'closed') as status")).select("id")


@query("SELECT page_id, page_id % 3 > 0 AS checked FROM pages")
def links_to_check(spark, sf_dir):
    """the raw area is left out."""
    return table(spark, sf_dir, "pages").select("page_id", FL.checkable(F.expr("concat(if(page_id % 3 = 0, 'raw/', 'wiki/raw/'), page_id)")).alias("checked"))


@query("SELECT event_id, event_id % 7 IN (0, 1, 3) AS rings, event_id % 7 <> 3 AS remains FROM events")
def alarms_after_firing(spark, sf_dir):
    """of those that ring, one-off alarms go."""
    remind = "case event_id % 7 when 0 then '09:30' when 1 then 'Mon 09:30' when 2 then 'Tue 09:30' when 3 then '1/15 09:30' when 4 then '1/16 09:30' when 5 then 'some day' end as remind"
    rows = table(spark, sf_dir, "events").selectExpr("event_id", remind)
    fired, left = FL.alarms_left(rows, F.lit("2024-01-15 09:30:20").cast("timestamp"))
    both = rows.select("event_id").join(fired.select("event_id", F.lit(True).alias("f")), "event_id", "left").join(left.select("event_id", F.lit(True).alias("l")), "event_id", "left")
    return both.select("event_id", F.coalesce("f", F.lit(False)).alias("rings"), F.coalesce("l", F.lit(False)).alias("remains"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'restart' WHEN p_partkey % 6 = 0 THEN 'resume' WHEN p_partkey % 3 = 0 OR p_partkey % 5 = 0 THEN 'refresh' ELSE 'new' END AS mode FROM part")
def research_modes(spark, sf_dir):
    """F13, J33, X02."""
    slug = "concat('topic-', p_partkey) as slug"
    requests = part(spark, sf_dir, "p_partkey as id", "concat('Topic: ', p_partkey) as topic", "if(p_partkey % 7 = 0, 'please Restart', 'go on') as text")
    reports = part(spark, sf_dir, slug, "if(p_partkey % 2 = 0, 'in_progress', 'done') as status", "p_partkey").where("p_partkey % 3 = 0")
    return FL.research_mode(requests, reports, part(spark, sf_dir, slug, "p_partkey").where("p_partkey % 5 = 0")).select("id", "mode")


@query("""SELECT p_partkey AS id, (p_size % 2 = 0 OR p_size % 3 = 0) AND p_size % 5 >= 2 OR p_size % 5 >= 3 AS wanted, p_type = 'ECONOMY' AND p_size > 10 AS distilled,
CASE p_size % 3 WHEN 0 THEN 'knowledge' WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'decision' ELSE 'knowledge' END ELSE 'decision' END AS output, p_size % 4 > 0 OR p_size % 3 = 0 AND p_partkey % 2 = 0 AS conforms,
CASE WHEN p_size % 4 = 0 THEN 'intact' WHEN p_size % 4 = 1 THEN 'repairable' ELSE 'rebuild' END AS damage FROM part""")
def note_gates(spark, sf_dir):
    """F21, F22, F24, F33, F30."""
    rows = part(spark, sf_dir, "p_partkey as id", "array(p_size % 2 = 0, p_size % 3 = 0) as flags", "p_size % 5 as related", "if(p_type = 'ECONOMY', 'book', 'card') as kind", "p_size > 10 as confirmed", "case p_size % 3 when 0 then 'knowledge' when 2 then 'decision' end as verdict",
                "p_partkey % 2 = 0 as even", "p_size % 3 = 0 as counter", "if(p_size % 4 = 0, 'buy', 'hold') as status", "case p_size % 4 when 0 then array('Work', 'More', 'Lens') when 1 then array('Lens') else array('More') end as headings")
    return rows.select("id", FL.topic_wanted(F.col("flags"), F.col("related")).alias("wanted"), FL.distillable(F.col("kind"), F.col("confirmed")).alias("distilled"), FL.output_type(F.col("verdict"), F.col("even")).alias("output"),
                       FL.position_conforms(F.col("status"), F.col("counter"), F.col("even")).alias("conforms"), FL.damage(F.col("headings"), ["Work", "Lens"]).alias("damage"))


@query("""SELECT p_partkey AS slug, 'header' AS kind, 'date' AS what FROM part WHERE p_size % 4 = 0 UNION ALL SELECT p_partkey, 'section_missing', 'View' FROM part WHERE p_size % 5 = 0
UNION ALL SELECT p_partkey, 'section_foreign', 'Extra' FROM part WHERE p_size % 5 = 0 UNION ALL SELECT p_partkey, 'direction', 'up' FROM part WHERE p_size % 3 = 1""")
def report_violations(spark, sf_dir):
    """F23, U07, X22."""
    fields = "map('title', p_name, 'date', if(p_size % 4 = 0, cast(null as string), '2001'), 'direction', case p_size % 3 when 0 then 'bullish' when 1 then 'up' end) as fields"
    return FL.violations(part(spark, sf_dir, "p_partkey as slug", fields, "if(p_size % 5 = 0, array('Facts', 'Extra'), array('View', 'Facts')) as sections"), ["title", "date"], ["Facts", "View"])


@query("SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag <> 'R' AND l_partkey % 10 > 0 AND l_linenumber <> 3")
def edges_in_order(spark, sf_dir):
    """F26."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as src", "if(l_partkey % 10 = 0, null, l_partkey) as dst", "nullif(l_returnflag, 'R') as mechanism", "nullif(l_linenumber, 3) as trap_source")
    return FL.sound_edges(rows).select("src", "dst")


@query("SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 200000 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def untracked_decisions(spark, sf_dir):
    """A quantified expectation without tracking."""
    return J.missing(orders(spark, sf_dir, "o_orderkey as id", "o_totalprice").where("o_totalprice > 200000"), table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").selectExpr("l_orderkey as id"), "id").select("id")


@query("SELECT l_orderkey AS tracker, l_linenumber AS line FROM lineitem WHERE l_linenumber = 2 OR l_partkey * 2 NOT IN (SELECT p_partkey FROM part)")
def unknown_variables(spark, sf_dir):
    """References without a registered variable; a null is none."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as tracker", "l_linenumber as line", "if(l_linenumber = 2, null, l_partkey * 2) as variable")
    return J.missing(rows, part(spark, sf_dir, "p_partkey as variable"), "variable").select("tracker", "line")


@query("SELECT p_partkey AS variable_id, s_suppkey + k AS target FROM part JOIN supplier ON s_suppkey = p_partkey // 20 CROSS JOIN (VALUES (0), (1)) v(k) WHERE p_size < 20")
def affected_targets(spark, sf_dir):
    """A list of affected targets, one row each."""
    listed = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as k", "explode(array(s_suppkey, s_suppkey + 1)) as target")
    return J.fan_out(part(spark, sf_dir, "p_partkey as variable_id", "p_partkey div 20 as k", "p_size").where("p_size < 20"), listed, "k").select("variable_id", "target")


@query("SELECT a.p_partkey AS lens, b.p_partkey AS section FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type WHERE b.p_size < 3")
def deep_sections(spark, sf_dir):
    """J31."""
    sections = part(spark, sf_dir, "p_brand as book", "p_type as skill", "p_partkey as section", "p_size").where("p_size < 3")
    return J.deep_sections(part(spark, sf_dir, "p_brand as book", "p_type as skill", "p_partkey as lens"), sections).select("lens", "section")


@query("SELECT o_orderkey AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'user' ELSE 'engine' END AS version FROM orders")
def settled_versions(spark, sf_dir):
    """J32."""
    rows = orders(spark, sf_dir, "o_orderkey as path")
    return J.settled(rows.where("path % 3 = 0").withColumn("version", F.lit("user")), rows.withColumn("version", F.lit("engine")))


@query("SELECT o_orderkey AS path, 'stale' AS why FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') > 30 UNION ALL SELECT o_orderkey, 'no_lens' FROM orders WHERE o_orderkey % 5 > 0")
def stale_connections(spark, sf_dir):
    """J34."""
    rows = orders(spark, sf_dir, "o_orderkey as path", "to_date(o_orderdate) as data_as_of")
    return J.stale_connections(rows, rows.where("path % 5 = 0"), day("2001-08-01"))


@query("WITH h AS (SELECT p_partkey AS path FROM part WHERE p_size = 7) SELECT path, 1 AS score FROM h UNION ALL SELECT DISTINCT path // 2, 0 FROM h WHERE path // 2 NOT IN (SELECT path FROM h)")
def neighbours_of_weak_hits(spark, sf_dir):
    """Few strong hits, so neighbours join."""
    rows = part(spark, sf_dir, "p_partkey as path", "p_size")
    return J.with_neighbours(rows.where("p_size = 7").select("path", F.lit(1).alias("score")), rows.selectExpr("path as src", "path div 2 as dst"))


@query("WITH t AS (SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS n, count(*) FILTER (o_orderstatus = 'O') AS u, count(*) FILTER (o_orderstatus = 'F') AS r FROM orders GROUP BY 1) SELECT o_custkey AS topic FROM t WHERE n < 3 AND u > r")
def insufficient_topics(spark, sf_dir):
    """A18."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("topic")).agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("materials"), F.count_if(F.col("o_orderstatus") == "O").alias("unresolved"), F.count_if(F.col("o_orderstatus") == "F").alias("resolved"))
    return A.insufficient(rows).select("topic")


@query("SELECT l_orderkey AS report, CAST(sum(l_quantity) AS DOUBLE) AS total, sum(l_quantity) = 100 AS sound FROM lineitem GROUP BY 1")
def scenario_totals(spark, sf_dir):
    """A28."""
    return A.scenarios(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as report", "l_quantity as probability"))


@query("SELECT event_type || user_id AS lesson, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def common_lessons(spark, sf_dir):
    """A30."""
    return A.common_lessons(table(spark, sf_dir, "events").selectExpr("concat(event_type, user_id) as lesson"))


@query("WITH f AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d FROM orders ORDER BY d, id LIMIT 20) SELECT (SELECT count(*) FROM orders) AS total, string_agg('T' || id, '/' ORDER BY d, id) AS titles FROM f")
def review_titles(spark, sf_dir):
    """The total, and the first twenty titles."""
    return A.review_summary(orders(spark, sf_dir, "o_orderkey as id", "to_date(o_orderdate) as date", "concat('T', o_orderkey) as title")).select("total", F.array_join("titles", "/").alias("titles"))


@query("""WITH m AS (SELECT p_name || p_partkey AS name, 'a' AS k, p_size % 5 AS hop FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_name || p_partkey, 'b', p_size % 7 FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_name || p_partkey, 'c', NULL FROM part WHERE p_size % 5 = 0)
SELECT name, count(DISTINCT k) AS mechanisms, min(hop) AS hop FROM m GROUP BY 1 ORDER BY 2 DESC, min(m.hop) IS NOT NULL DESC, coalesce(min(m.hop) < 2, false) DESC, name LIMIT 30""")
def ranked_candidates(spark, sf_dir):
    """Candidates of three mechanisms by name, the best thirty."""
    rows = part(spark, sf_dir, "concat(p_name, p_partkey) as name", "p_size")
    mined = [rows.where(f"p_size % {k} = 0").selectExpr("name", f"'{m}' as mechanism", *([f"p_size % {hop} as hop"] if hop else [])) for k, m, hop in ((2, "a", 5), (3, "b", 7), (5, "c", 0))]
    merged = R.merged(mined).withColumn("mechanisms", F.size("mechanisms")).withColumns({"quantifiable": F.col("hop").isNotNull(), "valid": F.expr("coalesce(hop < 2, false)")})
    return R.ranked_candidates(merged).limit(30).select("name", F.col("mechanisms").cast("long").alias("mechanisms"), "hop")


@query("SELECT event, lens, stars FROM (SELECT l_orderkey AS event, l_partkey AS lens, l_linenumber % 5 AS stars, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 5 DESC, l_partkey) AS n FROM lineitem) WHERE n <= 2")
def deep_dives(spark, sf_dir):
    """O02."""
    return R.deep_dives(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as event", "l_partkey as lens", "l_linenumber % 5 as stars")).select("event", "lens", "stars")


@query("SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS created FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25")
def oldest_items(spark, sf_dir):
    """The first twenty-five by creation."""
    return R.by_creation(orders(spark, sf_dir, "o_orderkey as id", "cast(to_date(o_orderdate) as string) as created")).limit(25)


@query("SELECT o_orderkey AS path, CAST(CAST(o_orderdate + CASE WHEN o_orderkey % 3 = 0 THEN INTERVAL 40 DAY ELSE INTERVAL 0 DAY END AS DATE) AS VARCHAR) AS at FROM orders ORDER BY 2 DESC, 1 LIMIT 5")
def newest_cards(spark, sf_dir):
    """By the index's date, else the card's."""
    rows = orders(spark, sf_dir, "o_orderkey as path", "to_date(o_orderdate) as date")
    return R.newest(rows.where("path % 3 = 0").withColumn("date", F.date_add("date", 40)), rows).select("path", F.col("at").cast("string").alias("at"))


@query("""WITH t AS (SELECT DISTINCT p_partkey AS id, unnest([p_type, p_brand, 's' || p_size]) AS tag, unnest([CAST(p_size % 3 AS DOUBLE), 1.5, 0.0]) AS score FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, tag) AS n FROM t)
SELECT id, string_agg(tag, '/' ORDER BY n) AS tags FROM r WHERE n <= 2 GROUP BY 1""")
def best_tags(spark, sf_dir):
    """Tags without a score count 0."""
    rows = part(spark, sf_dir, "p_partkey as id", "array(p_type, p_brand, concat('s', p_size), p_type) as tags", "map(p_type, cast(p_size % 3 as double), p_brand, 1.5D) as scores")
    return rows.select("id", F.array_join(R.best_tags(F.col("tags"), F.col("scores"), 2), "/").alias("tags"))


@query("""SELECT coalesce(e.src, u.src) AS src, coalesce(e.kind, u.kind) AS kind, CASE WHEN e.status = 'verified' THEN 'verified' ELSE coalesce(u.status, e.status) END AS status FROM (SELECT p_partkey AS src, p_type AS kind, CASE WHEN p_size % 2 = 0 THEN 'verified' ELSE 'pending' END AS status FROM part) e
FULL JOIN (SELECT p_partkey + k * 1000000000 AS src, p_type AS kind, 'rejected' AS status FROM part CROSS JOIN (VALUES (0), (1)) v(k) WHERE p_size % 3 = 0) u ON e.src = u.src AND e.kind = u.kind""")
def edge_ledger(spark, sf_dir):
    """Verified stays; new edges join."""
    edges = part(spark, sf_dir, "p_partkey as src", "p_partkey + 1 as dst", "p_type as kind", "if(p_size % 2 = 0, 'verified', 'pending') as status", "p_size")
    updates = edges.where("p_size % 3 = 0").select(F.explode(F.expr("array(0L, 1L)")).alias("k"), "src", "dst", "kind").selectExpr("src + k * 1000000000 as src", "dst + k * 1000000000 as dst", "kind", "'rejected' as status")
    return G.ledger(edges.drop("p_size"), updates).select("src", "kind", "status")


@query("""WITH RECURSIVE w(node, hop) AS (SELECT p_partkey, 0 FROM part WHERE p_size = 50 UNION SELECT node // 2, hop + 1 FROM w WHERE node > 0 AND hop < 10)
SELECT p_brand AS target, min(hop) AS hop FROM w JOIN part ON p_partkey = node GROUP BY 1""")
def reached_targets(spark, sf_dir):
    """G03, G01."""
    rows = part(spark, sf_dir, "p_partkey as node", "p_brand as target", "p_size")
    return G.impact(rows.where("p_size = 50").select("node"), rows.where("node > 0").selectExpr("node as src", "node div 2 as dst"), rows.select("node", "target"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS src, (n_nationkey * n_nationkey + 1) % 25 AS dst FROM nation), w(src, dst, n) AS (SELECT src, dst, 1 FROM e UNION SELECT w.src, e.dst, n + 1 FROM w JOIN e ON w.dst = e.src WHERE n < 11) SELECT DISTINCT src FROM w WHERE src = dst""")
def call_cycles(spark, sf_dir):
    """What reaches itself through calls."""
    return G.acyclic(table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as long) as src", "cast((n_nationkey * n_nationkey + 1) % 25 as long) as dst"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(lower(source || ': ' || lang || ' é漢-' || doc_id || '!'), '[^\p{L}\p{N}]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents""")
def slugs_of_any_script(spark, sf_dir):
    """X02."""
    return table(spark, sf_dir, "documents").select("doc_id", X.slug_any(F.expr("concat(source, ': ', lang, ' é漢-', doc_id, '!')")).alias("slug"))


@query("SELECT p_partkey AS id, p_name || '/' || p_brand AS wiki, 'a/' || p_size || '.md' AS files FROM part")
def link_targets(spark, sf_dir):
    """X03, X04."""
    text = F.expr("concat('see [[', p_name, '|shown]] and [[ ', p_brand, ' ]], or [this](a/', p_size, '.md).')")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(X.wiki_links(text), "/").alias("wiki"), F.array_join(X.markdown_links(text), "/").alias("files"))


@query("SELECT conv_id, turn, coalesce(length(nullif(text, '')), 0) AS n FROM conversations")
def turn_lengths(spark, sf_dir):
    """X07."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.characters(F.expr("nullif(text, '')")).cast("long").alias("n"))


@query("""SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN d WHEN 1 THEN d + 1 WHEN 2 THEN d - 1 WHEN 3 THEN d + CAST((9 - isodow(d)) % 7 + 1 AS INTEGER) END AS VARCHAR) AS day FROM (SELECT event_id, CAST(ts AS DATE) AS d FROM events)""")
def days_named(spark, sf_dir):
    """X10."""
    word = F.expr("case event_id % 5 when 0 then 'today' when 1 then 'tomorrow' when 2 then 'yesterday' when 3 then 'next Wednesday' else 'some day' end")
    return table(spark, sf_dir, "events").select("event_id", X.resolve_day(word, F.col("ts")).cast("string").alias("day"))


@query("SELECT l_orderkey AS id, l_linenumber AS line, l_extendedprice / nullif(l_tax, 0) - 1 AS changed, coalesce(abs(l_extendedprice / nullif(l_tax, 0) - 1) > 0.2, NULL) OR sign(l_extendedprice) <> sign(l_tax) AS significant FROM lineitem")
def changes_guarded(spark, sf_dir):
    """No change from 0."""
    new, old = F.col("l_extendedprice"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), X.change(new, old).alias("changed"), FL.significant(new, old).alias("significant"))


@query("SELECT p_partkey AS id, CASE WHEN p_type = 'SMALL' THEN 'SMALL/' || p_brand || '/x' ELSE p_type || '/' || p_brand || '/SMALL' END AS tags, p_type IN ('ECONOMY', 'SMALL') OR p_size % 2 = 0 AS overlaps FROM part")
def tags_capped(spark, sf_dir):
    """X20, X21."""
    rows = part(spark, sf_dir, "p_partkey as id", "array(p_type, p_brand, p_type, 'SMALL', 'x') as tags", "if(p_size % 2 = 0, array('x', 'y'), array('ECONOMY', 'SMALL')) as other", "p_type")
    other = F.when(F.col("p_type").isin("ECONOMY", "SMALL"), F.col("tags")).otherwise(F.expr("array(p_type)"))
    return rows.select("id", F.array_join(X.capped(F.col("tags"), 3), "/").alias("tags"), X.overlap(F.when(F.col("id") % 2 >= 0, F.concat(other, F.expr("if(other[0] = 'x', array('y'), array('z'))"))), F.col("other")).alias("overlaps"))


@query("""SELECT conv_id, turn, '{"chat_id":"c' || conv_id || '","text":' || CAST(to_json(t) AS VARCHAR) || '}' AS body FROM (SELECT conv_id, turn, CASE WHEN length(t) > 4096 THEN substr(t, 1, 4096 - 12) || chr(10) || chr(10) || '[消息过长已截断]' ELSE t END AS t FROM (SELECT conv_id, turn, '"' || text || chr(9) || chr(92) AS t FROM conversations))""")
def push_bodies(spark, sf_dir):
    """Escaped and cut."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.push_body(F.expr("concat('c', conv_id)"), F.expr("concat('\"', text, char(9), char(92))")).alias("body"))


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'reviewed' END AS status FROM orders")
def enum_names(spark, sf_dir):
    """X25."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), X.enum_of(F.expr("concat(' ', o_orderstatus, ' ')"), {"o": "open", "f": "reviewed"}).alias("status"))


@query("SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS checked, CASE p_size % 3 WHEN 0 THEN '- [ ] ' || p_name WHEN 1 THEN '  - [x] ' || p_name ELSE p_name END AS turned FROM part")
def boxes_turned(spark, sf_dir):
    """X27."""
    line = F.expr("concat(case p_size % 3 when 0 then '- [X] ' when 1 then '  - [ ] ' else '' end, p_name)")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.is_checked(line).alias("checked"), X.toggled(line).alias("turned"))


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def heavy_stage(spark, sf_dir):
    """The heavy stage sees what the cheap filter leaves."""
    return T.gated(table(spark, sf_dir, "events"), F.col("event_type") == "error", lambda rows: A.counted(rows, "user_id"))


@query("SELECT user_id AS candidate, strftime(min(ts), '%Y-%m-%d') AS first_seen, strftime(min(ts) + INTERVAL 14 DAY, '%Y-%m-%d') AS promote_at, count(*) AS sightings FROM events GROUP BY 1")
def promotion_days(spark, sf_dir):
    """T05, T10."""
    found = T.promoted_later(table(spark, sf_dir, "events").select(F.col("user_id").alias("candidate"), "ts"))
    return found.select("candidate", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"), F.date_format("promote_at", "yyyy-MM-dd").alias("promote_at"), "sightings")


@query("SELECT event_id AS id, event_type AS topic, row_number() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE) DESC, event_id) AS rank FROM events WHERE date_diff('day', CAST(ts AS DATE), DATE '2024-01-25') BETWEEN 0 AND 14")
def recent_topics(spark, sf_dir):
    """The last two weeks alone."""
    return W.recent_topics(table(spark, sf_dir, "events").selectExpr("event_id as id", "event_type as topic", "to_date(ts) as day"), day("2024-01-25")).select("id", "topic", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_custkey AS target, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE -1 END * (o_orderkey % 100)) AS net FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '2000-08-15' AND CAST(o_orderdate AS DATE) <= DATE '2001-02-15' GROUP BY 1")
def insider_net(spark, sf_dir):
    """The last six months."""
    trades = orders(spark, sf_dir, "o_custkey as target", "to_date(o_orderdate) as day", "if(o_orderstatus = 'O', 'buy', 'sell') as side", "o_orderkey % 100 as shares")
    return W.insider_net(trades, day("2001-02-15"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_type = 'SMALL' THEN 'high' ELSE 'low' END AS relevance FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN p_type = 'SMALL' THEN 3 ELSE 0 END + CASE WHEN p_name LIKE '%small%' THEN 2 ELSE 0 END DESC, CAST(p_partkey AS VARCHAR)) AS n FROM part WHERE p_type = 'SMALL' OR p_name LIKE '%small%') WHERE n <= 5")
def asked(spark, sf_dir):
    """The best hits, with how relevant they are."""
    area = part(spark, sf_dir, "cast(p_partkey as string) as path", "array(lower(p_type)) as tags", "p_name as title", "p_brand as body")
    return verbs.ask({"parts": area}, ["small"]).select("path", "relevance")


@query("SELECT event_id, event_type = 'error' AS urgent FROM events")
def priority_stream(spark, sf_dir):
    """Urgent changes to one sink, the others to a daily one."""
    path, rows = folder(spark), table(spark, sf_dir, "events")
    stream = spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/events.parque[t]").select("event_id", F.when(F.col("event_type") == "error", "P0").otherwise("P2").alias("priority"))
    sinks = [T.append_batch(f"{path}-{name}") for name in ("urgent", "daily")]
    T.by_priority(stream, *sinks, f"{path}-checkpoint").awaitTermination()
    urgent, daily = (spark.read.schema("event_id long").parquet(f"{path}-{name}").select("event_id") for name in ("urgent", "daily"))
    return urgent.withColumn("urgent", F.lit(True)).unionByName(daily.withColumn("urgent", F.lit(False)))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) <= DATE '2000-06-30'")
def reviews_due(spark, sf_dir):
    """F32: open decisions whose day has come."""
    rows = orders(spark, sf_dir, "o_orderkey as id", "if(o_orderstatus = 'O', 'open', 'reviewed') as status", "to_date(o_orderdate) as review_date")
    return FL.due(rows, day("2000-06-30")).select("id")


@query("SELECT p_partkey AS report FROM part WHERE p_size >= 40 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1)")
def findings_without_followup(spark, sf_dir):
    """J13."""
    return J.missing(part(spark, sf_dir, "p_partkey as report", "p_size").where("p_size >= 40"), table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_linenumber = 1").selectExpr("l_partkey as report"), "report").select("report")


__all__ = ["QUERIES"]
