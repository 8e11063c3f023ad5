"""The operators on the relational tables: one query and its DuckDB SQL each.

orders stand for decisions, parts for variables, line items for references, events for observations,
documents for cards, pages for fetched items, conversations for utterances, labels for judgements.
"""

from __future__ import annotations

from collections.abc import Callable

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

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CUT_OFF = "1998-01-01"


def query(sql: str | None = None):
    """Register a query by its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "reviewed")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("target"), status.alias("status"), F.to_date("o_orderdate").alias("review_date"), F.array("o_orderpriority").alias("tags"))


def day(text: str):
    return F.lit(text).cast("date")


DECISIONS = "(SELECT o_orderkey AS id, o_custkey AS target, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'reviewed' END AS status, CAST(o_orderdate AS DATE) AS review_date, o_orderpriority AS tag FROM orders)"


@query(f"SELECT id, target, CAST(review_date AS VARCHAR) AS review_date FROM {DECISIONS} WHERE status = 'open' AND review_date <= DATE '{CUT_OFF}'")
def due_decisions(spark, sf_dir):
    """F01."""
    return FL.due(decisions(spark, sf_dir), day(CUT_OFF)).select("id", "target", F.col("review_date").cast("string").alias("review_date"))


@query(f"SELECT id, tag FROM {DECISIONS} WHERE status = 'open' AND review_date <= DATE '{CUT_OFF}' AND tag IN ('1-URGENT', '2-HIGH')")
def due_by_tag(spark, sf_dir):
    """F02."""
    return FL.due_by_tag(decisions(spark, sf_dir), day(CUT_OFF), ["1-URGENT", "2-HIGH"]).select("id", F.col("tags")[0].alias("tag"))


@query(f"SELECT id, tag FROM {DECISIONS} WHERE status = 'open' AND review_date <= DATE '{CUT_OFF}'")
def due_by_unknown_tag(spark, sf_dir):
    """without a match, all due rows."""
    return FL.due_by_tag(decisions(spark, sf_dir), day(CUT_OFF), ["no such tag"]).select("id", F.col("tags")[0].alias("tag"))


@query(f"SELECT id, 'status' AS lacking FROM {DECISIONS} WHERE status IS NULL")
def quarantine(spark, sf_dir):
    """F03."""
    return FL.quarantined(decisions(spark, sf_dir))[1].select("id", F.array_join("lacking", ",").alias("lacking"))


@query("SELECT doc_id, CASE WHEN n_chars < 100 THEN 'confirm' WHEN n_chars < 500 AND source = 'src1' THEN 'suspicious' WHEN n_chars > 10000 THEN 'long' ELSE 'normal' END AS guard FROM documents")
def content_guards(spark, sf_dir):
    """F07."""
    return table(spark, sf_dir, "documents").select("doc_id", FL.content_guard(F.col("n_chars"), F.col("source") == "src1").alias("guard"))


@query("SELECT lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1")
def url_host_profile(spark, sf_dir):
    """F08, X09."""
    return table(spark, sf_dir, "pages").groupBy(X.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("SELECT page_id FROM pages WHERE regexp_extract(url, '://([^/?#:]+)', 1) = 'example.net' OR regexp_extract(url, '://([^/?#:]+)', 1) LIKE '%.example.net'")
def of_host(spark, sf_dir):
    """F08."""
    return table(spark, sf_dir, "pages").where(FL.of_host(F.col("url"), "example.net")).select("page_id")


@query("SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dup(spark, sf_dir):
    """Groups of one text; the text itself isn't shuffled, its digest is."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("k")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").select("first_id", "copies")


def titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.substring_index("text", "\n", 1).alias("title"))


#: Titles alike; the SQL engine counts edits of bytes, so it numbers a pair's characters first, and their numbers are one byte each.
ALIKE = """t AS (SELECT lang, split_part(text, chr(10), 1) AS title, min(doc_id) AS id FROM documents WHERE length(split_part(text, chr(10), 1)) >= 20 GROUP BY 1, 2),
p AS (SELECT a.lang, a.title AS first_title, b.title AS second_title, a.id AS first_id, b.id AS second_id FROM t a JOIN t b ON a.lang = b.lang AND a.title < b.title AND abs(length(a.title) - length(b.title)) <= 5 AND levenshtein(a.title, b.title) <= 20),
c AS (SELECT *, list_transform(range(1, length(first_title) + 1), lambda i: substr(first_title, i, 1)) AS l1, list_transform(range(1, length(second_title) + 1), lambda i: substr(second_title, i, 1)) AS l2 FROM p),
u AS (SELECT *, list_distinct(list_concat(l1, l2)) AS u FROM c),
alike AS (SELECT * FROM u WHERE levenshtein(array_to_string(list_transform(l1, lambda x: chr(CAST(list_position(u, x) AS INTEGER))), ''), array_to_string(list_transform(l2, lambda x: chr(CAST(list_position(u, x) AS INTEGER))), '')) <= 5)"""


@query(f"WITH {ALIKE} SELECT lang, least(first_id, second_id) AS first_id, greatest(first_id, second_id) AS second_id FROM alike")
def near_dup_title(spark, sf_dir):
    """The least ids of each two titles that are alike, in all languages."""
    found = J.near_titles(titles(spark, sf_dir), block="lang")
    return found.select("lang", F.least("i1", "i2").alias("first_id"), F.greatest("i1", "i2").alias("second_id"))


@query(f"WITH {ALIKE} SELECT lang, first_title, second_title FROM alike")
def near_dup_title_langs(spark, sf_dir):
    """The titles themselves."""
    found = J.near_titles(titles(spark, sf_dir), block="lang")
    return found.select("lang", F.least("t1", "t2").alias("first_title"), F.greatest("t1", "t2").alias("second_title"))


@query("""SELECT doc_id, CASE WHEN n = 1 THEN title ELSE title || '-' || n END AS name FROM (SELECT doc_id, title, row_number() OVER (PARTITION BY title ORDER BY doc_id) AS n FROM (SELECT doc_id, split_part(text, chr(10), 1) AS title FROM documents))""")
def title_collision_suffix(spark, sf_dir):
    """K01."""
    return K.suffixed(titles(spark, sf_dir), "title", "id").select(F.col("id").alias("doc_id"), "name")


@query("SELECT source, lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1, 2 HAVING count(*) >= 6")
def unlinked_topic(spark, sf_dir):
    """J03, A03."""
    rows = J.missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")
    return A.crowded(rows, ["source", "lang"], 6)


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) >= 3")
def tag_threshold(spark, sf_dir):
    """A02."""
    return A.crowded(table(spark, sf_dir, "documents"), ["source", "lang"], 3)


@query("""SELECT target, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages)
WHERE target NOT IN (SELECT coalesce(regexp_extract(url, '://[^/]*(/[^?#]*)', 1), '') FROM pages) GROUP BY 1""")
def broken_links(spark, sf_dir):
    """J04."""
    pages = table(spark, sf_dir, "pages")
    links = pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'))).alias("target"))
    files = pages.select(F.regexp_extract("url", "://[^/]*(/[^?#]*)", 1).alias("path"))
    return J.broken_links(links, files).groupBy("target").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '2000-07-01')")
def inactive_entities(spark, sf_dir):
    """J06."""
    late = table(spark, sf_dir, "orders").where("o_orderstatus = 'O' and o_orderdate >= timestamp_ntz'2000-07-01'").select(F.col("o_custkey").alias("c_custkey"))
    return J.missing(table(spark, sf_dir, "customer"), late, "c_custkey").select("c_custkey")


#: Large returns: what a tracker holds of variables.
RETURNED = "l_returnflag = 'R' and l_quantity >= 45"


@query(f"SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE {RETURNED})")
def uncovered_variable(spark, sf_dir):
    """J06, J23."""
    used = shipped(spark, sf_dir, RETURNED).select(F.col("variable").alias("p_partkey"))
    return J.missing(table(spark, sf_dir, "part"), used, "p_partkey").select("p_partkey")


def shipped(spark, sf_dir, where="true"):
    rows = table(spark, sf_dir, "lineitem").where(where)
    return rows.select(F.col("l_suppkey").alias("member"), F.col("l_partkey").alias("variable"), F.col("l_orderkey").alias("target"))


@query("""WITH has AS (SELECT DISTINCT l_suppkey AS member, l_partkey AS item FROM lineitem),
g AS (SELECT s_suppkey AS member, s_nationkey AS grp FROM supplier)
SELECT DISTINCT m.member, h.item FROM g m JOIN g p ON m.grp = p.grp JOIN has h ON h.member = p.member WHERE NOT EXISTS (SELECT 1 FROM has o WHERE o.member = m.member AND o.item = h.item)""")
def sibling_gap(spark, sf_dir):
    """J07, U04."""
    groups = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("member"), F.col("s_nationkey").alias("grp"))
    return J.sibling_gap(shipped(spark, sf_dir).select("member", F.col("variable").alias("item")), groups)


QUARTERS = "SELECT l_partkey, sum(CASE WHEN l_shipdate < TIMESTAMP '2001-04-01' THEN l_extendedprice END) AS a, sum(CASE WHEN l_shipdate >= TIMESTAMP '2001-04-01' THEN l_extendedprice END) AS b FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01' AND l_shipdate < TIMESTAMP '2001-07-01' GROUP BY 1"


@query(f"""WITH ch AS (SELECT l_partkey FROM ({QUARTERS}) WHERE abs(round(b, 2) / round(a, 2) - 1) > 0.2)
SELECT DISTINCT o_custkey AS target, l.l_partkey AS variable FROM lineitem l JOIN ch USING (l_partkey) JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'""")
def change_fanout(spark, sf_dir):
    """All references to variables that moved between two quarters."""
    rows = table(spark, sf_dir, "lineitem")
    half = rows.where("l_shipdate >= timestamp_ntz'2001-01-01' and l_shipdate < timestamp_ntz'2001-07-01'").groupBy(F.col("l_partkey").alias("variable")).agg(F.round(F.sum(F.expr("case when l_shipdate < timestamp_ntz'2001-04-01' then l_extendedprice end")), 2).alias("a"), F.round(F.sum(F.expr("case when l_shipdate >= timestamp_ntz'2001-04-01' then l_extendedprice end")), 2).alias("b"))
    changes = half.where(F.abs(X.change(F.col("b"), F.col("a"))) > 0.2).select("variable")
    references = rows.select(F.col("l_partkey").alias("variable"), F.col("l_orderkey").alias("o_orderkey")).join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("target")), "o_orderkey")
    holdings = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("target"))
    return J.fan_out(changes, references, "variable").join(holdings, "target", "left_semi").select("target", "variable").distinct()


@query("""SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'right_only' WHEN d.doc_id IS NULL THEN 'left_only' WHEN l.n = 1 AND d.n = 1 THEN 'ok' ELSE 'repeated' END AS verdict
FROM (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l FULL JOIN (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1) d ON l.doc_id = d.doc_id""")
def full_outer_audit(spark, sf_dir):
    """J11, J25."""
    return J.audit(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "verdict")


@query("""SELECT p.event_id, round(max_by(v.value, struct_pack(t := v.ts, i := v.event_id)), 6) AS previous FROM (SELECT * FROM events WHERE event_type = 'purchase') p
JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = p.user_id AND v.ts < p.ts GROUP BY 1""")
def asof_previous(spark, sf_dir):
    """Each purchase with the user's latest view before it."""
    events = table(spark, sf_dir, "events")
    before = events.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value"))
    found = J.as_of_previous(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), before, "user_id")
    return found.where("prev_ts is not null").select("event_id", F.round("prev_value", 6).alias("previous"))


@query("""WITH m AS (SELECT DISTINCT l_suppkey AS member, l_partkey AS item FROM lineitem)
SELECT a.member AS i, b.member AS j, count(*) AS shared FROM m a JOIN m b ON a.item = b.item AND a.member < b.member GROUP BY 1, 2 HAVING count(*) >= 2""")
def cross_topic_pairs(spark, sf_dir):
    """J14."""
    return J.cross_pairs(shipped(spark, sf_dir).select("member", F.col("variable").alias("item")))


def nation_edges(spark, sf_dir):
    rows = shipped(spark, sf_dir).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("member"), F.col("s_nationkey").alias("src")), "member")
    rows = rows.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("target"), "o_custkey"), "target").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst")), "o_custkey")
    return rows.select("src", "dst").distinct()


EDGES = "SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey"


@query(f"WITH e AS ({EDGES}) SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src WHERE x.src <> y.dst AND x.src <> x.dst AND y.src <> y.dst")
def chain_two_hop(spark, sf_dir):
    """J15, G03."""
    return J.two_hops(nation_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE e AS ({EDGES}), w AS (SELECT 0 AS node, 0 AS hop UNION SELECT e.dst, w.hop + 1 FROM w JOIN e ON e.src = w.node WHERE w.hop < 10)
SELECT node, min(hop) AS hop FROM w GROUP BY 1""")
def bfs_hops_all(spark, sf_dir):
    """The fewest hops between nations that trade."""
    return G.hops(nation_edges(spark, sf_dir), spark.createDataFrame([(0,)], "node int"))


@query("""WITH RECURSIVE l AS (SELECT DISTINCT l_suppkey AS a, -l_partkey AS b FROM lineitem), e AS (SELECT a AS src, b AS dst FROM l UNION ALL SELECT b, a FROM l),
w AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS hop UNION SELECT e.dst, w.hop + 1 FROM w JOIN e ON e.src = w.node WHERE w.hop < 10)
SELECT node, min(hop) AS hop FROM w GROUP BY 1""")
def bfs_hops(spark, sf_dir):
    """The fewest hops from the first supplier along suppliers and the parts (negative numbers) that they supply."""
    supply = shipped(spark, sf_dir).select("member", (-F.col("variable")).alias("part"))
    edges = supply.toDF("src", "dst").unionByName(supply.toDF("dst", "src"))
    return G.hops(edges, spark.createDataFrame([(1,)], "node long"))


@query(f"""WITH e AS ({EDGES}), f AS (SELECT n_nationkey AS path FROM nation WHERE n_regionkey <> 3)
SELECT path, (SELECT count(*) FROM e WHERE src = path) AS n_out, (SELECT count(*) FROM e WHERE dst = path) AS n_in, (SELECT count(*) FROM e WHERE src = path AND dst NOT IN (SELECT path FROM f)) AS broken, NOT EXISTS (SELECT 1 FROM e WHERE src = path OR dst = path) AS orphan FROM f""")
def link_degrees(spark, sf_dir):
    """The nations of one region are no files, so links to them are broken."""
    files = table(spark, sf_dir, "nation").where("n_regionkey <> 3").select(F.col("n_nationkey").alias("path"))
    return G.degrees(files, nation_edges(spark, sf_dir)).select("path", "n_out", "n_in", "broken", "orphan")


@query("""SELECT l_orderkey AS candidate, count(DISTINCT l_suppkey) AS sources, count(DISTINCT l_suppkey) >= 2 OR count(*) FILTER (l_returnflag = 'R') > 0 AND count(*) FILTER (l_returnflag = 'A') > 0 AS strong FROM lineitem GROUP BY 1""")
def independent_sources(spark, sf_dir):
    """A05."""
    kind = F.expr("case l_returnflag when 'R' then 'authoritative' when 'A' then 'community' else 'report' end")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("candidate"), F.col("l_suppkey").alias("source"), kind.alias("kind"))
    return A.independent_sources(rows).select("candidate", "sources", "strong")


@query("""SELECT user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS target, count(DISTINCT event_type) AS n FROM events GROUP BY 1 HAVING count(DISTINCT event_type) >= 3""")
def convergence(spark, sf_dir):
    """Kinds that meet at a user on a day."""
    rows = table(spark, sf_dir, "events").select(F.concat_ws("/", "user_id", F.to_date("ts")).alias("target"), "event_type")
    return A.converging(rows, "target", "event_type").select("target", F.col("n").cast("long").alias("n"))


@query("SELECT l_partkey AS variable, count(DISTINCT l_orderkey) AS targets FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 40")
def dossier_trigger(spark, sf_dir):
    """A07."""
    rows = shipped(spark, sf_dir).select("variable", "target", F.lit("all").alias("sector"))
    return A.dossier_due(rows, 40, 2).select("variable", "targets")


@query("""SELECT source, lang, count(*) AS n, CAST(min(quality) AS BIGINT) AS agreed FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2 HAVING count(*) >= 2 AND min(quality) = max(quality)""")
def unanimity_flag(spark, sf_dir):
    """A16."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    return A.unanimous(rows, ["source", "lang"], "quality").withColumn("agreed", F.col("agreed").cast("long"))


@query("SELECT doc_id, CAST(running AS BIGINT) AS running FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id) AS running FROM documents) WHERE running <= 200000")
def budget_cutoff(spark, sf_dir):
    """A15."""
    return A.within_budget(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 200_000, 256).select("doc_id", "running")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT o_orderstatus AS status, " + ", ".join(f"count(*) FILTER (o_orderpriority = '{p}') AS p{p[0]}" for p in PRIORITIES) + " FROM orders GROUP BY 1")
def change_summary(spark, sf_dir):
    """A11."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    found = A.by_priority(rows, "status", PRIORITIES)
    return found.select("status", *(F.col(f"`{p}`").alias(f"p{p[0]}") for p in PRIORITIES))


VERDICTS = "CASE event_type WHEN 'purchase' THEN 'STATE_CHANGED' WHEN 'view' THEN 'NO_CHANGE' WHEN 'click' THEN 'LIKELY_DEAD' WHEN 'error' THEN 'EVIDENCE_CONFLICT' ELSE 'UNKNOWN' END"
BANDS = "CASE WHEN value >= 60 THEN 'high' WHEN value >= 20 THEN 'medium' ELSE 'low' END"


@query(f"""SELECT event_type, CASE WHEN v = 'NO_CHANGE' THEN 'skip' WHEN v = 'STATE_CHANGED' AND c = 'high' THEN 'deep_first' WHEN v = 'STATE_CHANGED' THEN 'deep' WHEN v = 'EVIDENCE_CONFLICT' THEN 'deep_disputed' WHEN v = 'LIKELY_DEAD' THEN 'staging' ELSE 'unrouted' END AS route, count(*) AS n
FROM (SELECT event_type, {VERDICTS} AS v, {BANDS} AS c FROM events) GROUP BY 1, 2""")
def verdict_routing(spark, sf_dir):
    """F14."""
    rows = table(spark, sf_dir, "events").select("event_type", F.expr(VERDICTS).alias("verdict"), F.expr(BANDS).alias("confidence"))
    return FL.routed(rows).groupBy("event_type", "route").agg(F.count("*").alias("n"))


BUCKETS = "CASE WHEN p_partkey % 4 > 0 THEN 'strong' ELSE 'weak' END AS t, CASE WHEN p_size > 33 THEN 'fully' WHEN p_size > 16 THEN 'partly' ELSE 'unpriced' END AS v, CASE p_partkey % 3 WHEN 0 THEN 'vacant' WHEN 1 THEN 'fair' ELSE 'crowded' END AS c"


@query(f"""SELECT CASE WHEN t = 'weak' THEN 'drop' WHEN v = 'unpriced' AND c = 'vacant' THEN 'opportunity' WHEN v = 'partly' AND c = 'fair' THEN 'trend' WHEN v = 'fully' AND c = 'crowded' THEN 'negative' WHEN v = 'fully' AND c = 'vacant' THEN 'anomaly' ELSE 'unclear' END AS outcome, count(*) AS n FROM (SELECT {BUCKETS} FROM part) GROUP BY 1""")
def pricing_matrix(spark, sf_dir):
    """A20."""
    rows = table(spark, sf_dir, "part").selectExpr(*[x.strip() for x in BUCKETS.replace(", CASE", "| CASE").split("|")])
    return rows.groupBy(A.priced(F.col("t"), F.col("v"), F.col("c")).alias("outcome")).agg(F.count("*").alias("n"))


@query("""SELECT user_id AS target, CAST(sum(CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN -1 ELSE 0 END) AS BIGINT) AS net, count(*) FILTER (event_type = 'click' AND value > 40) >= 2 OR sum(CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN -1 ELSE 0 END) < 0 AS downgrade FROM events GROUP BY 1""")
def net_direction(spark, sf_dir):
    """A14."""
    side = F.when(F.col("event_type") == "purchase", "bull").when(F.col("event_type") == "click", "bear")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("target"), side.alias("side"), F.lit(1).cast("long").alias("weight"), (F.col("value") > 40).alias("hard"))
    return A.net_direction(rows).select("target", "net", "downgrade")


STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
TERMS = "SELECT DISTINCT {id} AS post, unnest(string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')) AS term FROM {t}"


@query(f"""WITH d AS ({TERMS.format(id='doc_id', t='documents')}), b AS ({TERMS.format(id='item_id', t='benchmark')})
SELECT term, count(*) AS posts FROM d WHERE length(term) >= 2 AND term NOT IN ({STOPS}) AND term NOT IN (SELECT term FROM b) GROUP BY 1 HAVING count(*) >= 12""")
def term_novelty(spark, sf_dir):
    """A04, J23, X28."""
    posts = A.term_posts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("post"), "text"), 12)
    known = table(spark, sf_dir, "benchmark").select(F.explode(X.terms(F.col("text"))).alias("term"))
    return J.missing(posts, known, "term").select("term", "posts")


@query("SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(DISTINCT value) AS n_values FROM events GROUP BY 1, 2, 3 HAVING count(DISTINCT value) > 1")
def conflict_keep_all(spark, sf_dir):
    """A26."""
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    return A.conflicts(rows, ["user_id", "day", "event_type"]).select("user_id", "day", "event_type", F.col("n_values").cast("long").alias("n_values"))


@query("""SELECT user_id, event_type, count(*) AS length FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM events) GROUP BY user_id, event_type, run HAVING count(*) >= 3""")
def streak_close(spark, sf_dir):
    """W01."""
    return W.streaks(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_type", "length")


@query("""SELECT event_id, event_type, previous FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE previous <> event_type""")
def state_changes(spark, sf_dir):
    """W02."""
    return W.state_changes(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "event_type", "previous")


@query("""SELECT event_id, round(100 * (value / nullif(previous, 0) - 1), 4) AS percent FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE abs(value / nullif(previous, 0) - 1) > 0.2""")
def prev_change(spark, sf_dir):
    """W03, F17."""
    rows = W.with_previous(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return rows.where(F.abs(X.change(F.col("value"), F.col("previous"))) > 0.2).select("event_id", F.round("percent", 4).alias("percent"))


def daily(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return rows.withColumn("target", F.lit("all"))


DAILY = "SELECT CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1"


@query(f"SELECT CAST(day AS VARCHAR) AS day, round(CASE WHEN n = 200 THEN mean END, 5) AS mean, round(CASE WHEN n = 200 THEN 100 * (value / mean - 1) END, 3) AS deviation, CASE WHEN n = 200 AND 100 * (value / mean - 1) > 20 THEN 'stretched' WHEN n = 200 AND 100 * (value / mean - 1) < -15 THEN 'broken' END AS flag FROM (SELECT day, value, avg(value) OVER w AS mean, count(*) OVER w AS n FROM ({DAILY}) WINDOW w AS (ORDER BY day ROWS 199 PRECEDING))")
def ma200(spark, sf_dir):
    """W05."""
    return W.moving_average(daily(spark, sf_dir), "target").select(F.col("day").cast("string").alias("day"), F.round("mean", 5).alias("mean"), F.round("deviation", 3).alias("deviation"), "flag")


@query(f"SELECT CAST(day AS VARCHAR) AS day, high, low, round((value - low) / nullif(high - low, 0), 5) AS place FROM (SELECT day, value, max(value) OVER w AS high, min(value) OVER w AS low FROM ({DAILY}) WINDOW w AS (ORDER BY day RANGE INTERVAL 363 DAYS PRECEDING))")
def range52w(spark, sf_dir):
    """W04."""
    return W.range_52_weeks(daily(spark, sf_dir), "target").select(F.col("day").cast("string").alias("day"), "high", "low", F.round("place", 5).alias("place"))


@query(f"SELECT CASE WHEN d <= -50 THEN 'collapse' WHEN d <= -20 THEN 'bear' WHEN d <= -10 THEN 'correction' ELSE 'normal' END AS band, count(*) AS n FROM (SELECT 100 * (value / max(value) OVER (ORDER BY day RANGE INTERVAL 363 DAYS PRECEDING) - 1) AS d FROM ({DAILY})) GROUP BY 1")
def drawdown(spark, sf_dir):
    """W07."""
    return W.range_52_weeks(daily(spark, sf_dir), "target").groupBy("band").agg(F.count("*").alias("n"))


@query(f"""SELECT day, round(r, 3) AS rsi, CASE WHEN r > 70 THEN 'overbought' WHEN r < 30 THEN 'oversold' WHEN r BETWEEN 40 AND 60 THEN 'neutral' END AS zone FROM (SELECT CAST(day AS VARCHAR) AS day, CASE WHEN n = 14 THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END AS r FROM (SELECT day, count(d) OVER w AS n, avg(greatest(d, 0)) OVER w AS g, avg(greatest(-d, 0)) OVER w AS l FROM (SELECT day, value - lag(value) OVER (ORDER BY day) AS d FROM ({DAILY})) WINDOW w AS (ORDER BY day ROWS 13 PRECEDING)))""")
def rsi14(spark, sf_dir):
    """W06."""
    return W.rsi(daily(spark, sf_dir), "target").select(F.col("day").cast("string").alias("day"), F.round("rsi", 3).alias("rsi"), "zone")


@query("SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 5")
def topk_per_group(spark, sf_dir):
    """W08."""
    found = W.top_per_group(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", F.col("n_chars").desc(), F.col("doc_id"))
    return found.select("source", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("""SELECT user_id AS plan, min_by(event_id, struct_pack(t := ts, i := event_id)) AS first_id FROM events WHERE event_type <> 'view' GROUP BY 1""")
def first_open_step(spark, sf_dir):
    """W09."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("plan"), F.col("event_id").alias("title"), F.col("ts").alias("stage"), F.col("event_id").alias("ord"), (F.col("event_type") == "view").alias("done"))
    return W.first_open(rows).select("plan", F.col("title").alias("first_id"))


@query("""WITH k AS (SELECT p_type, max(p_partkey) AS m FROM part WHERE p_partkey % 10 <> 0 GROUP BY 1)
SELECT p_partkey, coalesce(m, 0) + row_number() OVER (PARTITION BY p.p_type ORDER BY p_partkey) AS new_id FROM part p LEFT JOIN k ON k.p_type = p.p_type WHERE p_partkey % 10 = 0""")
def id_assignment(spark, sf_dir):
    """W10, W12."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return W.assigned_ids(rows.where("p_partkey % 10 = 0"), rows.where("p_partkey % 10 <> 0").withColumnRenamed("p_partkey", "id"), "p_type", "p_partkey").select("p_partkey", "new_id")


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) AS s FROM part)
SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_brand, p_partkey) AS t FROM a WHERE s <= 5) WHERE t <= 20""")
def stage_cap(spark, sf_dir):
    """W11."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("plan"), F.col("p_brand").alias("stage"), F.col("p_partkey").alias("ord"))
    return W.stage_capped(rows).select("p_partkey")


@query("""SELECT user_id AS candidate, CAST(min(ts) AS VARCHAR)[:10] AS first_day, coalesce(bool_or(date_diff('day', CAST(ts AS DATE), CAST(nxt AS DATE)) <= 1), false) AS again FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events WHERE event_type = 'purchase') GROUP BY 1""")
def seen_again(spark, sf_dir):
    """W13."""
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("candidate"), F.col("ts").alias("seen_at"))
    return W.seen_again(rows, 1).select("candidate", F.substring(F.col("first_seen").cast("string"), 1, 10).alias("first_day"), "again")


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT DISTINCT CAST(d AS VARCHAR) AS day FROM (SELECT d FROM (SELECT d FROM d ORDER BY d DESC LIMIT 14) UNION ALL SELECT d FROM (SELECT max(d) AS d FROM d GROUP BY date_trunc('week', d) ORDER BY d DESC LIMIT 8) UNION ALL SELECT d FROM (SELECT max(d) AS d FROM d GROUP BY date_trunc('month', d) ORDER BY d DESC LIMIT 6))""")
def retention(spark, sf_dir):
    """W14, K12."""
    return W.retained(daily(spark, sf_dir)).select(F.col("day").cast("string").alias("day"))


@query("""SELECT isoyear(o_orderdate) || '-W' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') AS week, count(*) AS n, count(*) FILTER (CAST(o_orderdate AS DATE) < DATE '1999-06-14') AS deferred FROM orders GROUP BY 1""")
def iso_week_archive(spark, sf_dir):
    """X11, X12, K17."""
    rows = table(spark, sf_dir, "orders")
    return rows.groupBy(X.iso_week(F.col("o_orderdate")).alias("week")).agg(F.count("*").alias("n"), F.count_if(X.deferred(F.col("o_orderdate"), day("1999-06-16"))).alias("deferred"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    """X23."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count("*").alias("n"))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01'), b AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01')
SELECT 'both' AS op, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_a', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def setops(spark, sf_dir):
    """U01-U06."""
    a, b = (shipped(spark, sf_dir, f"l_shipdate {when}").select("variable").distinct() for when in (">= timestamp_ntz'2001-06-01'", "< timestamp_ntz'1996-01-01'"))
    n = lambda name, rows: rows.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
    return n("both", R.shared(a, b)).unionByName(n("only_a", R.minus(a, b))).unionByName(n("either", a.unionByName(b).distinct()))


@query("""SELECT source, CAST(len(list_filter(['de', 'en', 'es', 'fr', 'it'], lambda x: NOT list_contains(l, x))) AS BIGINT) AS lacking FROM (SELECT source, list(DISTINCT lang) AS l FROM documents GROUP BY 1)""")
def lacking_sections(spark, sf_dir):
    """U07."""
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("l"))
    return rows.select("source", F.size(R.lacking(["de", "en", "es", "fr", "it"], F.col("l"))).cast("long").alias("lacking"))


HIT = "CASE WHEN {t} = '{w}' THEN 3 ELSE 0 END + CASE WHEN contains(lower({h}), '{w}') THEN 2 ELSE 0 END + CASE WHEN contains(lower({b}), '{w}') THEN 1 ELSE 0 END"


@query(f"""WITH r AS (SELECT 'documents' AS area, CAST(doc_id AS VARCHAR) AS path, {HIT.format(t='source', h="split_part(text, chr(10), 1)", b='text', w='that')} + {HIT.format(t='source', h="split_part(text, chr(10), 1)", b='text', w='src3')} AS score FROM documents
UNION ALL SELECT 'talk', conv_id || '/' || turn, {HIT.format(t='role', h="''", b='text', w='that')} + {HIT.format(t='role', h="''", b='text', w='src3')} FROM conversations)
SELECT area, path, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY score DESC, path) AS k FROM r WHERE score > 0) WHERE k <= 5""")
def search_rank(spark, sf_dir):
    """U02, O10, W08."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.array("source").alias("tags"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"))
    talk = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("path"), F.array("role").alias("tags"), F.lit("").alias("title"), F.col("text").alias("body"))
    return R.search({"documents": docs, "talk": talk}, ["that", "src3"]).select("area", "path", F.col("score").cast("long").alias("score"))


RULES = [("that", "todo", 3), ("from", "review", 2), ("with", "ask", 1)]


@query("""SELECT conv_id, turn, CASE WHEN contains(lower(text), 'that') THEN 'todo' WHEN contains(lower(text), 'from') THEN 'review' WHEN contains(lower(text), 'with') THEN 'ask' END AS operation,
CAST(contains(lower(text), 'that') AS BIGINT) + CAST(contains(lower(text), 'from') AS BIGINT) + CAST(contains(lower(text), 'with') AS BIGINT) AS fitting FROM conversations WHERE role = 'user'""")
def intent_route(spark, sf_dir):
    """F31, F34."""
    rows = FL.intents(table(spark, sf_dir, "conversations").where("role = 'user'"), RULES)
    return rows.select("conv_id", "turn", "operation", F.col("fitting").cast("long").alias("fitting"))


@query("""SELECT event_id FROM events WHERE strftime(ts, '%H:%M') = '09:30' AND event_id % 2 = 0 OR strftime(ts, '%a') = 'Wed' AND strftime(ts, '%H:%M') = '09:30' AND event_id % 2 = 1""")
def reminder_due(spark, sf_dir):
    """events whose own time meets a daily or a weekly reminder."""
    spec = F.when(F.col("event_id") % 2 == 0, "09:30").otherwise("Wed 09:30")
    return table(spark, sf_dir, "events").where(FL.reminder_due(spec, F.col("ts"))).select("event_id")


@query("""WITH d AS (SELECT user_id, ts, event_id, event_type, sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS alive FROM events)
SELECT user_id, max(n) AS longest FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id, alive ORDER BY ts, event_id) AS n FROM d WHERE event_type = 'view') GROUP BY 1 HAVING max(n) >= 3""")
def staging_streak(spark, sf_dir):
    """Longest run of one verdict, in batch."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("variable"), F.struct("ts", "event_id").alias("run_ts"), F.when(F.col("event_type") == "view", "LIKELY_DEAD").otherwise("ALIVE").alias("verdict"))
    return W.closing(rows).groupBy(F.col("variable").alias("user_id")).agg(F.max("consecutive").cast("long").alias("longest")).where("longest >= 3")


@query("""SELECT coalesce(a.k, b.k) AS item, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'gone' WHEN a.v <> b.v THEN 'revised' ELSE 'valid' END AS status
FROM (SELECT l_partkey AS k, count(*) AS v FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01' AND l_shipdate < TIMESTAMP '2001-02-01' GROUP BY 1) a FULL JOIN (SELECT l_partkey AS k, count(*) AS v FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-02-01' AND l_shipdate < TIMESTAMP '2001-03-01' GROUP BY 1) b ON a.k = b.k""")
def report_delta(spark, sf_dir):
    """K18."""
    month = lambda a, b: shipped(spark, sf_dir, f"l_shipdate >= timestamp_ntz'{a}' and l_shipdate < timestamp_ntz'{b}'").groupBy(F.col("variable").alias("item")).agg(F.count("*").alias("value"))
    return K.delta(month("2001-01-01", "2001-02-01"), month("2001-02-01", "2001-03-01")).select("item", "status")


@query("""SELECT c_custkey AS target, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') THEN 'update' ELSE 'insert' END AS action FROM customer""")
def upsert_kind(spark, sf_dir):
    """J24, K16."""
    return J.upsert_kind(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target")), decisions(spark, sf_dir)).select("target", "action")


@query("""SELECT user_id AS todo, last_action, done FROM (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'delete' ELSE 'edit' END AS last_action, event_type = 'purchase' AS done, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND last_action <> 'delete'""")
def todo_state(spark, sf_dir):
    """K25, K27."""
    action = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "delete").otherwise("edit")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("todo"), "ts", F.col("event_id").alias("seq"), action.alias("action"), "value")
    return K.latest_state(rows).select("todo", "last_action", "done")


@query(f"""SELECT 'NOTIFY: due ' || count(*) || ': ' || (SELECT string_agg(t, '; ' ORDER BY t) FROM (SELECT CAST(id AS VARCHAR) AS t FROM {DECISIONS} WHERE status = 'open' AND review_date <= DATE '{CUT_OFF}' ORDER BY t LIMIT 20)) AS line FROM {DECISIONS} WHERE status = 'open' AND review_date <= DATE '{CUT_OFF}' HAVING count(*) > 0""")
def notify_line(spark, sf_dir):
    """K11, A12."""
    return K.notify_line(FL.due(decisions(spark, sf_dir), day(CUT_OFF)).select(F.col("id").cast("string").alias("title")), "due")


INDICATORS = {"position_52w": "p_size / 50.0", "deviation_200d": "p_size - 25", "drawdown": "-(p_partkey % 60)", "rsi14": "p_partkey % 100", "institution_change": "p_partkey % 30 - 15", "insider_net_6m": "p_partkey % 7 - 3", "short_interest": "p_partkey % 25"}


@query(f"""WITH i AS (SELECT p_partkey AS target, {', '.join(f'CAST({sql} AS DOUBLE) AS {name}' for name, sql in INDICATORS.items())} FROM part)
SELECT target, unnest(list_filter([
  CASE WHEN position_52w >= 0.95 THEN 'near_high' WHEN position_52w <= 0.05 THEN 'near_low' END, CASE WHEN deviation_200d < 0 THEN 'below_mean' END,
  CASE WHEN drawdown <= -10 THEN 'correction' END, CASE WHEN drawdown <= -20 THEN 'bear' END, CASE WHEN drawdown <= -50 THEN 'collapse' END,
  CASE WHEN rsi14 > 70 THEN 'overbought' WHEN rsi14 < 30 THEN 'oversold' END, CASE WHEN deviation_200d > 20 THEN 'stretched' WHEN deviation_200d < -15 THEN 'stretched_down' END,
  CASE WHEN institution_change < -10 THEN 'institutions_leave' END, CASE WHEN insider_net_6m < 0 THEN 'insiders_sell' END,
  CASE WHEN short_interest > 10 THEN 'shorted' END, CASE WHEN short_interest > 20 THEN 'heavily_shorted' END], lambda x: x IS NOT NULL)) AS flag FROM i""")
def technical_flags(spark, sf_dir):
    """F16."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target"), *(F.expr(f"cast({sql} as double)").alias(name) for name, sql in INDICATORS.items()))
    return FL.red_flags(rows).select("target", "flag")


@query("""SELECT p_partkey AS variable, CASE p_partkey % 5 WHEN 0 THEN false WHEN 1 THEN p_size <= 25 WHEN 2 THEN p_partkey % 3 <> 0 AND p_partkey % 12 <= 2 ELSE p_partkey % 3 <> 0 END AS valid FROM part""")
def state_validity(spark, sf_dir):
    """F28."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey as variable", "element_at(array('pulse', 'event', 'seasonal', 'structural', 'cyclical'), cast(p_partkey % 5 + 1 as int)) as lifecycle", "p_size as snapshot", "p_size + if(p_partkey % 3 = 0, 1, 0) as current", "p_size > 25 as triggered", "p_partkey % 12 as months_ahead")
    return rows.select("variable", FL.still_valid(*(F.col(c) for c in ("lifecycle", "snapshot", "current", "triggered", "months_ahead"))).alias("valid"))


@query("""SELECT source AS judgement, count(*) AS items, count(*) FILTER (quality = 1) AS high, count(*) >= 2 AND count(*) FILTER (quality = 1) >= 1 AND count(*) FILTER (lang IS NULL) = 0 AS passed FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def evidence_gate(spark, sf_dir):
    """F18."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    return FL.evidence_gate(rows.select(F.col("source").alias("judgement"), F.when(F.col("quality") == 1, "high").otherwise("low").alias("credibility"), F.col("lang").alias("date"))).select("judgement", "items", "high", "passed")


@query("""SELECT l_returnflag AS event, count(*) AS n, count(DISTINCT l_linestatus) AS directions, CASE WHEN count(DISTINCT l_linestatus) = 1 AND count(*) >= 2 THEN 'converge' WHEN count(DISTINCT l_linestatus) = 2 THEN 'diverge' ELSE 'complement' END AS pattern FROM lineitem GROUP BY 1""")
def lens_agreement(spark, sf_dir):
    """A19, V08."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("event"), F.when(F.col("l_linestatus") == "O", "up").otherwise("down").alias("direction"))
    return A.lens_agreement(rows).select("event", "n", "directions", "pattern")


@query("""SELECT doc_id, left(array_to_string(list_slice(string_split(trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', ' ', 'g')), ' '), 1, 4), '-'), 200) AS slug FROM documents""")
def slugs(spark, sf_dir):
    """X01."""
    return table(spark, sf_dir, "documents").select("doc_id", X.slug(F.substring_index("text", "\n", 1)).alias("slug"))


@query("SELECT doc_id, CASE WHEN length(text) > 4096 THEN left(text, 4085) || chr(10) || chr(10) || '[消息过长已截断]' ELSE text END AS message FROM documents")
def messages(spark, sf_dir):
    """X06, K09, F27."""
    return table(spark, sf_dir, "documents").select("doc_id", K.message(F.col("text")).alias("message"))


@query("""SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS age, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS DATE) AS VARCHAR) AS review, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%a') AS weekday FROM orders""")
def date_parts(spark, sf_dir):
    """X13, X14, X16, X17."""
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.age_days(d, day("2001-08-01")).cast("long").alias("age"), X.next_review(d).cast("string").alias("review"), X.month_of(d).alias("month"), X.weekday(d).alias("weekday"))


@query("""SELECT user_id AS plan, count(*) FILTER (event_type = 'purchase') AS done, count(*) AS total, rpad(repeat('#', count(*) FILTER (event_type = 'purchase') * 10 // count(*)), 10, '-') || ' ' || count(*) FILTER (event_type = 'purchase') || '/' || count(*) AS bar FROM events GROUP BY 1""")
def plan_progress(spark, sf_dir):
    """A09, X19."""
    return A.progress(table(spark, sf_dir, "events").select(F.col("user_id").alias("plan"), (F.col("event_type") == "purchase").alias("done"))).select("plan", "done", "total", "bar")


@query("""SELECT c_nationkey AS target, n FROM (SELECT c_nationkey, count(*) FILTER (c_acctbal < -500) AS n FROM customer GROUP BY 1) WHERE n < 3""")
def cold_spots(spark, sf_dir):
    """A17."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("target"), "c_acctbal")
    return A.cold(rows.select("target").distinct(), rows.where("c_acctbal < -500"))


@query("""SELECT lower(replace(p_brand, '#', '')) AS concept, count(*) AS n FROM part GROUP BY 1""")
def grouped_counts(spark, sf_dir):
    """A08, A13, A22, A23."""
    return A.counted(table(spark, sf_dir, "part").select(F.lower(F.regexp_replace("p_brand", "#", "")).alias("concept")), "concept")
