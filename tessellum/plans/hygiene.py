"""More operators on the relational tables: hygiene rules, review, planning and streams, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessellum.functions import scalar as X
from tessellum.operators import aggregates as A
from tessellum.operators import filters as FL
from tessellum.operators import joins as J
from tessellum.operators import ranking as R
from tessellum.operators import sinks as K
from tessellum.operators import windows as W
from tessellum.operators.graph import dropped_at_end, shared_folder
from tessellum.plans import verbs
from tessellum.plans.queries import ORACLE, QUERIES, RETURNED, daily, day, decisions, query, shipped, table
from tessellum.streaming import state as T


@query("SELECT CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS newest, date_diff('day', max(CAST(ts AS DATE)), DATE '2024-02-10') > 7 AS stale FROM events")
def recency_flag(spark, sf_dir):
    """F05."""
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"))
    return FL.recency_flag(rows, day("2024-02-10")).select(F.col("newest").cast("string").alias("newest"), "stale")


@query("SELECT o_orderkey AS id, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS age, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') > CASE o_orderstatus WHEN 'O' THEN 31 WHEN 'F' THEN 92 END AS stale FROM orders")
def staleness(spark, sf_dir):
    """F06, X13."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("data_as_of"), F.when(F.col("o_orderstatus") == "O", "macro").when(F.col("o_orderstatus") == "F", "company").alias("kind"))
    return FL.staleness(rows, day("2001-08-01")).select("id", F.col("age").cast("long").alias("age"), "stale")


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'B' WHEN user_id % 2 = 0 THEN 'C' ELSE 'A' END AS mode FROM events")
def sweep_mode(spark, sf_dir):
    """F12."""
    trigger, target = F.when(F.col("event_type") == "view", "cron").otherwise("manual"), F.when(F.col("user_id") % 2 == 0, F.col("user_id"))
    return table(spark, sf_dir, "events").select("event_id", FL.sweep_mode(trigger, target).alias("mode"))


@query("""SELECT DISTINCT l_partkey AS variable_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
WHERE c_mktsegment = 'BUILDING' AND l_partkey % 3 = 0 AND l_partkey % 2 = 0""")
def urgent_changes(spark, sf_dir):
    """F15, J09, S04."""
    verdicts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("variable_id"), F.when(F.col("p_partkey") % 3 == 0, "STATE_CHANGED").otherwise("NO_CHANGE").alias("verdict"), F.when(F.col("p_partkey") % 2 == 0, "high").otherwise("low").alias("confidence"))
    references = shipped(spark, sf_dir).select(F.col("variable").alias("variable_id"), F.col("target").alias("o_orderkey")).join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("target")), "o_orderkey").select("variable_id", "target")
    holdings = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("target"))
    return FL.urgent(verdicts, references, holdings).select("variable_id")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 'unquantifiable' WHEN p_partkey % 3 < 2 AND NOT (p_partkey % 2 = 1 AND p_partkey % 5 > 1) AND p_size >= 14 THEN 'isolated' WHEN p_partkey % 7 = 0 THEN 'covered' WHEN p_size % 13 > 10 THEN 'too_far' END AS stop, p_size % 13 > 5 AS warned FROM part""")
def stop_rules(spark, sf_dir):
    """F19, J22."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey as id", "cast(p_partkey as string) as name", "p_partkey % 11 <> 0 as quantifiable", "p_partkey % 3 as sources", "p_partkey % 2 as authoritative", "if(p_partkey % 5 > 1, 1, 0) as community", "date_sub(date'2001-06-01', cast(p_size as int)) as first_seen", "p_size % 13 as hop")
    known = rows.where("id % 7 = 0").select("name")
    return FL.stopped(rows, known, day("2001-06-01")).select("id", "stop", "warned")


@query("""SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 1000 AND CAST(o_orderdate AS DATE) <= DATE '2001-06-01' AND (o_orderstatus = 'F' OR date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-06-01') >= 14) AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def promotion_gate(spark, sf_dir):
    """F20, W13."""
    rows = table(spark, sf_dir, "orders").where("o_orderdate < timestamp_ntz'2001-06-02'")
    rows = rows.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 2).otherwise(1).alias("sources"), F.lit(0).alias("authoritative"), F.lit(0).alias("community"), (F.col("o_totalprice") > 1000).alias("quantifiable"), F.lit(False).alias("covered"), F.when(F.col("o_orderstatus") == "F", "event").otherwise("state").alias("lifecycle"), F.to_date("o_orderdate").alias("first_seen"))
    return FL.promoted(rows, day("2001-06-01")).select("id")


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'the ') THEN 'work' WHEN contains(lower(text), 'der ') THEN 'personal' ELSE 'ask' END AS class FROM documents""")
def todo_classes(spark, sf_dir):
    """F29, F38."""
    return table(spark, sf_dir, "documents").select("doc_id", FL.todo_class(F.col("text"), {"work": ["the "], "personal": ["der "]}).alias("class"))


@query("""SELECT p_partkey AS path, p_partkey % 5 = 0 OR p_size > 45 AS rejected FROM part""")
def protected_areas(spark, sf_dir):
    """F35."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 == 0, "raw/x").otherwise("wiki/x").alias("path"), F.when(F.col("p_size") > 45, "delete").otherwise("edit").alias("action"))
    return FL.allowed_changes(rows).select(F.col("id").alias("path"), "rejected")


@query(f"""SELECT p_partkey AS conclusion, coalesce(n, 0) AS points, CASE WHEN n >= 1 THEN 'actionable' ELSE 'to_be_quantified' END AS status FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE {RETURNED} GROUP BY 1) ON l_partkey = p_partkey""")
def quantified_support(spark, sf_dir):
    """F36."""
    evidence = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("conclusion"), F.expr(RETURNED).alias("verifiable"))
    return FL.actionable(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("conclusion")), evidence)


@query("""SELECT doc_id, length(text) BETWEEN 300 AND 600 AND NOT contains(lower(text), 'idiot') AND NOT contains(lower(text), '最近') AND NOT starts_with(ltrim(lower(text), ' '), 'in') AND NOT contains(string_split(rtrim(lower(text), ' '), chr(10))[-1], 'und ') AS conforms FROM documents""")
def draft_conformance(spark, sf_dir):
    """F37."""
    return FL.draft_conforms(table(spark, sf_dir, "documents").withColumn("sources", F.array("source")), ["idiot"], openings=("in",), closings=("und ",)).select("doc_id", "conforms")


@query("""SELECT c_custkey AS card FROM customer WHERE c_acctbal < 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def orphans(spark, sf_dir):
    """Urgent orders are links."""
    cards = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("card"), F.when(F.col("c_acctbal") < 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("t"))).alias("tags"))
    links = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("src"), F.lit(-1).cast("long").alias("dst"))
    return J.orphans(cards, links, cards.where("card < 0")).select("card")


@query("""SELECT o_orderkey AS event FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01')""")
def overdue_events(spark, sf_dir):
    """J21."""
    calendar = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), F.to_date("o_orderdate").alias("event_date"))
    outcomes = shipped(spark, sf_dir, "l_shipdate < timestamp_ntz'1997-01-01'").select(F.col("target").alias("event"))
    return J.overdue_events(calendar, outcomes, day("1995-06-01")).select("event")


@query("""SELECT source AS topic, count(*) FILTER (contains(text, 'that')) AS first, count(*) FILTER (NOT contains(text, 'that') AND contains(text, 'que')) AS second FROM documents GROUP BY 1 HAVING count(*) FILTER (contains(text, 'that')) > 0 AND count(*) FILTER (NOT contains(text, 'that') AND contains(text, 'que')) > 0""")
def both_concepts(spark, sf_dir):
    """J28."""
    hits = table(spark, sf_dir, "documents").select(F.col("source").alias("topic"), F.when(F.col("text").contains("that"), "that").when(F.col("text").contains("que"), "que").alias("concept"))
    return J.both_concepts(hits, "that", "que")


@query("""SELECT n_nationkey AS topic, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS followups, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS decisions, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < 0) AS context, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0) AS todos FROM nation""")
def topic_chain(spark, sf_dir):
    """J29."""
    c, s = table(spark, sf_dir, "customer").withColumn("topic", F.col("c_nationkey")), table(spark, sf_dir, "supplier").withColumn("topic", F.col("s_nationkey"))
    return J.topic_chain(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("topic")), c, s, c.where("c_acctbal < 0"), s.where("s_acctbal < 0"))


@query("SELECT r_regionkey AS event, domain FROM region, (VALUES ('cost'), ('demand'), ('policy')) d(domain)")
def domain_expansion(spark, sf_dir):
    """J30."""
    return J.over_domains(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("event")), ["cost", "demand", "policy"])


@query("""SELECT a.s_suppkey AS id, b.s_suppkey AS other, CAST(1 AS BIGINT) AS shared FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey""")
def related_decisions(spark, sf_dir):
    """J35, J17."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array("s_nationkey").alias("tags"))
    return J.related_decisions(rows)


@query("""SELECT lang AS kind, count(*) AS found, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN count(*) ELSE count(*) - 1 END AS recorded FROM documents WHERE lang <> 'fr' GROUP BY 1""")
def index_drift(spark, sf_dir):
    """A01, S20: 'en' was never recorded, 'fr' is right, others are one short."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("kind"))
    index = docs.where("kind <> 'en'").groupBy("kind").agg((F.count("*") - F.when(F.col("kind") == "fr", 0).otherwise(1)).alias("recorded"))
    return A.index_drift(index, docs)


@query("""SELECT o_orderpriority AS category, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus <> 'F') AS deferred FROM orders GROUP BY 1""")
def archive_totals(spark, sf_dir):
    """A10, A08."""
    return A.archive_totals(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), (F.col("o_orderstatus") == "F").alias("done")))


@query("""SELECT lower(replace(p_brand, '#', '')) AS concept, CAST(2 AS BIGINT) AS n FROM part GROUP BY 1""")
def tag_fragments(spark, sf_dir):
    """Each brand is spelled in two ways."""
    brands = table(spark, sf_dir, "part").select(F.regexp_replace("p_brand", "#", "").alias("tag")).distinct()
    return A.fragmented(brands.unionByName(brands.select(F.lower("tag").alias("tag")))).select("concept", F.size("spellings").cast("long").alias("n"))


@query("""SELECT layer, coalesce(terms, 0) AS terms, coalesce(terms, 0) >= 2 AND coalesce(languages, 0) >= 2 AS covered FROM (VALUES ('src0'), ('src1'), ('none')) l(layer) LEFT JOIN (SELECT source, count(DISTINCT n_chars) AS terms, count(DISTINCT lang) AS languages FROM documents GROUP BY 1) ON source = layer""")
def search_coverage(spark, sf_dir):
    """A24, S21."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("layer"), F.col("n_chars").alias("term"), F.col("lang").alias("language"))
    return A.coverage(rows, ["src0", "src1", "none"]).select("layer", "terms", "covered")


@query("""SELECT user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS event, count(*) AS lenses, count(*) BETWEEN 3 AND 60 AND count(*) FILTER (event_type = 'view') >= 1 AND count(*) <= 5 AS good FROM events GROUP BY 1""")
def lens_quality(spark, sf_dir):
    """A25."""
    rows = table(spark, sf_dir, "events").select(F.concat_ws("/", "user_id", F.to_date("ts")).alias("event"), (F.col("event_type") == "view").alias("cross"))
    return A.lens_quality(rows).select("event", "lenses", "good")


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS week, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last, count(*) AS n FROM orders GROUP BY 1""")
def archive_history(spark, sf_dir):
    """A27, S24, X16."""
    rows = table(spark, sf_dir, "orders").select(X.month_of(F.col("o_orderdate")).alias("week"), F.to_date("o_orderdate").alias("day"))
    return A.archive_history(rows).select("week", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), "n")


@query("""SELECT user_id AS target, CASE WHEN event_type = 'purchase' THEN 'add' ELSE 'reduce' END AS action, count(*) FILTER (value > 90) >= CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS confirmed FROM events WHERE event_type IN ('purchase', 'click') GROUP BY 1, 2, event_type""")
def confirmed_actions(spark, sf_dir):
    """A29."""
    rows = table(spark, sf_dir, "events").where("event_type in ('purchase', 'click')").select(F.col("user_id").alias("target"), F.when(F.col("event_type") == "purchase", "add").otherwise("reduce").alias("action"), (F.col("value") > 90).alias("met"))
    return A.confirmed_actions(rows).select("target", "action", "confirmed")


@query("""SELECT s_suppkey AS target, n, CAST(n - lag(n) OVER (PARTITION BY s_suppkey ORDER BY q) AS BIGINT) AS moved FROM (SELECT l_suppkey AS s_suppkey, strftime(date_trunc('quarter', l_shipdate), '%Y-%m') AS q, count(*) AS n FROM lineitem GROUP BY 1, 2)""")
def quarterly_change(spark, sf_dir):
    """W15."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("target"), F.date_format(F.date_trunc("quarter", "l_shipdate"), "yyyy-MM").alias("quarter")).agg(F.count("*").alias("shares"))
    return W.quarterly_change(rows).select("target", F.col("shares").alias("n"), "moved")


@query("""SELECT n_name AS target FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS r, count(*) OVER () AS n FROM nation) WHERE 37 % n = r - 1""")
def rotation(spark, sf_dir):
    """W16."""
    return W.rotation(table(spark, sf_dir, "nation").select(F.col("n_name").alias("target")), 37)


@query("""SELECT 'holding' AS kind, n_name AS target FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS r, count(*) OVER () AS n FROM nation) WHERE 27 % n = r - 1 UNION ALL SELECT 'watching', s_name FROM supplier UNION ALL SELECT 'sector', r_name FROM region""")
def study_turns(spark, sf_dir):
    """2002-07-01 is a Monday and begins a half-year."""
    kinds = (("nation", "n_name", "holding"), ("supplier", "s_name", "watching"), ("region", "r_name", "sector"))
    targets = [table(spark, sf_dir, t).select(F.lit(kind).alias("kind"), F.col(name).alias("target")) for t, name, kind in kinds]
    return W.turns(targets[0].unionByName(targets[1]).unionByName(targets[2]), day("2002-07-01"), 27)


@query("""WITH m AS (SELECT p_partkey % 40 AS event, p_partkey AS lens, p_size % 4 AS tier, CASE WHEN p_size % 9 = 0 THEN 'war' ELSE 'money' END AS domain FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY tier DESC, lens) AS rank FROM m), f AS (SELECT event, min(rank) AS first FROM r WHERE domain <> 'money' GROUP BY 1)
SELECT event, lens, rank FROM r LEFT JOIN f USING (event) WHERE rank <= CASE WHEN coalesce(first <= 5, true) THEN 5 ELSE 4 END OR (first > 5 AND rank = first)""")
def foreign_lens(spark, sf_dir):
    """F25, O09."""
    matches = table(spark, sf_dir, "part").selectExpr("p_partkey % 40 as event", "p_partkey as lens", "p_size % 4 as tier", "if(p_size % 9 = 0, 'war', 'money') as domain", "'money' as own")
    return R.across_domains(matches).select("event", "lens", "rank")


@query("SELECT doc_id AS reminder FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unsent_reminders(spark, sf_dir):
    """W17, K10, K07."""
    return W.unsent(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("reminder")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("reminder")))


@query(f"""SELECT p_partkey AS path FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE {RETURNED}) ORDER BY p_retailprice DESC, p_partkey LIMIT 5""")
def suggestions(spark, sf_dir):
    """O03, J16, W19."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_retailprice").alias("created"))
    return R.suggestions(rows, shipped(spark, sf_dir, RETURNED).select(F.col("variable").alias("path"))).select("path")


@query("""SELECT topic, min(place) AS place FROM (SELECT r_name AS topic, 0 AS place FROM region UNION ALL SELECT n_name, 1 FROM nation UNION ALL SELECT s_name, 2 FROM supplier) GROUP BY 1 ORDER BY place, topic LIMIT 3""")
def offered_topics(spark, sf_dir):
    """O04."""
    return R.offered(table(spark, sf_dir, "region").select(F.col("r_name").alias("topic")), table(spark, sf_dir, "nation").select(F.col("n_name").alias("topic")), table(spark, sf_dir, "supplier").select(F.col("s_name").alias("topic")))


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 4 END AS stage FROM documents""")
def plan_stages(spark, sf_dir):
    """O07."""
    kind = F.expr("case lang when 'en' then 'source' when 'fr' then if(doc_id % 2 = 0, 'topic', 'report') when 'de' then 'connection' else 'question' end")
    return R.staged(table(spark, sf_dir, "documents").withColumn("kind", kind)).select("doc_id", "stage")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 4 = 0 THEN 'reviewed' WHEN o_orderstatus = 'O' THEN 'open' WHEN o_orderstatus = 'F' THEN 'reviewed' END AS status FROM orders""")
def reviewed_decisions(spark, sf_dir):
    """K26."""
    rows = decisions(spark, sf_dir)
    return K.reviewed(rows, rows.where("id % 4 = 0").select("id", F.lit("2001-01-01").cast("date").alias("day"))).select("id", "status")


@query("""SELECT c_custkey AS variable, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS state, c_custkey % 3 <> 0 AS retry FROM customer""")
def carried_states(spark, sf_dir):
    """T12, K15."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("variable"), F.col("c_mktsegment").alias("state"))
    return T.carried(rows, rows.where("variable % 3 = 0").withColumn("state", F.lit("new")))


@query("""SELECT n_nationkey AS task FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey % 3 = 1 AND n_nationkey < 10""")
def due_runs(spark, sf_dir):
    """T01, T02, S19."""
    late = F.when(F.col("n_nationkey") % 3 == 1, F.lit("2026-01-04 08:00:00")).when(F.col("n_nationkey") % 3 == 2, F.lit("2026-01-05 09:30:00")).cast("timestamp")
    at = F.when(F.col("n_nationkey") < 10, "09:00").when(F.col("n_nationkey") % 3 == 1, "23:00").otherwise("09:00")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("task"), at.alias("at"), F.when((F.col("n_nationkey") % 3 == 1) & (F.col("n_nationkey") >= 10), F.lit("2026-01-04 23:00:00").cast("timestamp")).otherwise(late).alias("last_run"))
    return T.due_runs(rows, F.lit("2026-01-05 10:00:00").cast("timestamp")).select("task")


@query("""SELECT strftime(day, '%Y') AS year, count(*) FILTER (value > 1.2 * previous) AS up, count(*) FILTER (value < 0.8 * previous) AS down FROM (SELECT CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS value, lag(round(sum(o_totalprice), 2)) OVER (ORDER BY CAST(o_orderdate AS DATE)) AS previous FROM orders GROUP BY 1) GROUP BY 1""")
def yearly_moves(spark, sf_dir):
    """W03, A11."""
    rows = W.with_previous(daily(spark, sf_dir), "target", ["day"], "value")
    return rows.groupBy(F.date_format("day", "yyyy").alias("year")).agg(F.count_if(F.expr("value > 1.2 * previous")).alias("up"), F.count_if(F.expr("value < 0.8 * previous")).alias("down"))


def _folder(spark) -> str:
    return dropped_at_end(spark, f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}")


def _stream(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/events.parque[t]")


def _drained(spark, rows, schema):
    folder = _folder(spark)
    T.change_stream(rows, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


@query("SELECT DISTINCT user_id, event_type FROM events")
def streaming_dedup(spark, sf_dir):
    """Each (user, kind) once, as a stream that ends when all is read."""
    rows = T.notified_once(_stream(spark, sf_dir).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("/", "user_id", "event_type").alias("reminder")), within="3650 days")
    return _drained(spark, rows.select("user_id", "event_type"), "user_id long, event_type string")


@query("""WITH d AS (SELECT user_id, ts, event_id, event_type, sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS alive FROM events)
SELECT user_id, max(n) AS longest FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id, alive ORDER BY ts, event_id) AS n FROM d WHERE event_type = 'view') GROUP BY 1 HAVING max(n) >= 3""")
def streaming_streak(spark, sf_dir):
    """The batch operator's streaks, from keyed state; a user has one event at a time."""
    rows = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("variable"), F.col("ts").cast("timestamp").alias("run_ts"), F.when(F.col("event_type") == "view", "LIKELY_DEAD").otherwise("ALIVE").alias("verdict"))
    found = _drained(spark, T.streak_stream(rows), T.STREAK)
    return found.groupBy(F.col("variable").cast("long").alias("user_id")).agg(F.max("consecutive").cast("long").alias("longest")).where("longest >= 3")


def _with_clock(spark, sf_dir, rows, key, *columns):
    """A stream of events and one row of a key named clock, 60 days after the last of them, which moves the watermark past all."""
    folder = _folder(spark)
    last = table(spark, sf_dir, "events").agg((F.max(F.col("ts").cast("timestamp")) + F.expr("interval 60 days")).alias("ts"))
    last.select(F.lit("clock").alias(key), *(F.lit("clock").alias(c) for c in columns), "ts").write.parquet(f"{folder}/clock")
    clock = spark.readStream.schema(f"{key} string, {''.join(f'{c} string, ' for c in columns)}ts timestamp").parquet(f"{folder}/clock")
    return rows.select(key, *columns, "ts").unionByName(clock)


def _with_timers(spark, rows, schema):
    """_drained() with the state store that timers need, for this stream alone."""
    name, held = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, T.ROCKSDB)
    try:
        return _drained(spark, rows, schema)
    finally:
        spark.conf.set(name, held)


@query(ORACLE["streaming_streak"])
def late_streaks(spark, sf_dir):
    """The batch operator's streaks from runs that are held until the watermark has passed them."""
    rows = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("variable"), F.when(F.col("event_type") == "view", "LIKELY_DEAD").otherwise("ALIVE").alias("verdict"), F.col("ts").cast("timestamp").alias("ts"))
    found = _with_timers(spark, T.late_streak_stream(_with_clock(spark, sf_dir, rows, "variable", "verdict").withColumnRenamed("ts", "run_ts"), late="0 seconds"), T.STREAK).where("variable <> 'clock'")
    return found.groupBy(F.col("variable").cast("long").alias("user_id")).agg(F.max("consecutive").cast("long").alias("longest")).where("longest >= 3")


@query("""SELECT user_id, epoch_us(min(ts)) AS first_seen, epoch_us(least(min(ts) + INTERVAL 14 DAY, min(ts) FILTER (event_type = 'purchase'))) AS promote_at FROM events GROUP BY 1""")
def promoted_candidates(spark, sf_dir):
    """Users as candidates, promoted by a timer two weeks after they were first seen, or with a purchase before."""
    rows = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("candidate"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    found = _with_timers(spark, T.promotion_stream(_with_clock(spark, sf_dir, rows, "candidate", "kind"), at_once=("purchase",), late="0 seconds"), "candidate string, first_seen timestamp, promote_at timestamp")
    return found.where("candidate <> 'clock'").select(F.col("candidate").cast("long").alias("user_id"), F.unix_micros("first_seen").alias("first_seen"), F.unix_micros("promote_at").alias("promote_at"))


@query("SELECT event_type, user_id, epoch_us(min(ts)) AS first_sent FROM events GROUP BY 1, 2")
def reminders_once(spark, sf_dir):
    """(user, kind) notified once for good, by a ledger of batches, the first of them replayed."""
    ledger = _folder(spark)
    sink = T.notify_once(f"{ledger}/ledger")
    rows = _stream(spark, sf_dir).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("/", "user_id", "event_type").alias("reminder"))
    for turn in ("first", "again"):  # a new checkpoint brings the same rows as the same batch
        rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{ledger}/{turn}").trigger(availableNow=True).start().awaitTermination()
    sent = spark.read.schema("user_id long, event_type string, ts timestamp, reminder string, batch long").option("basePath", f"{ledger}/ledger").parquet(f"{ledger}/ledger")
    return sent.select("event_type", "user_id", F.unix_micros("ts").alias("first_sent"))


__all__ = ["QUERIES"]
