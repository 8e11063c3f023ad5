"""Operators that find names, terms, near texts and cycles, on the relational tables; each query with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessellum.functions import scalar as X
from tessellum.functions.scalar import UNSEGMENTED
from tessellum.operators import aggregates as A
from tessellum.operators import filters as FL
from tessellum.operators import graph as G
from tessellum.operators import joins as J
from tessellum.operators import sinks as K
from tessellum.operators import text as N
from tessellum.operators.graph import stored
from tessellum.plans import verbs
from tessellum.plans.queries import EDGES, nation_edges, query, shipped, table

#: Turns name a Chinese and an English metric in running text.
SPOKEN = "coalesce(text, '') || CASE turn % 4 WHEN 1 THEN '，长江水位上升。' WHEN 2 THEN ' (henry-hub prices)' ELSE '' END"
#: Letters as characters of a script without spaces, so that documents become texts whose words nobody has cut.
HAN = "水位天气铁矿石油价格涨跌库存产能航运煤电光伏芯片锂钴"
UNCUT = f"replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '{HAN}'), ' ', '')"


def spaced_sql(text: str) -> str:
    return f"' ' || trim(regexp_replace(regexp_replace(lower({text}), '({UNSEGMENTED})', ' \\1 ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"


@query(f"""WITH a AS (SELECT conv_id || '/' || turn AS article, {spaced_sql(SPOKEN)} AS t, conv_id % 25 AS tag, role FROM conversations),
f AS (SELECT CAST(n_nationkey AS BIGINT) AS followup, {spaced_sql('n_name')} AS n FROM nation UNION ALL SELECT 100, {spaced_sql("'水位'")} UNION ALL SELECT 101, {spaced_sql("'Henry Hub'")} UNION ALL SELECT 102, {spaced_sql("'长江水位上升'")})
SELECT article, tag AS followup FROM a WHERE role = 'user' UNION SELECT article, followup FROM a JOIN f ON contains(t, n)""")
def followup_mentions(spark, sf_dir):
    """By tag, or by a metric of one word, of several, or in Chinese."""
    articles = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("article"), F.when(F.col("role") == "user", F.array((F.col("conv_id") % 25).cast("string"))).otherwise(F.array().cast("array<string>")).alias("tags"), F.expr(SPOKEN).alias("text"))
    more = spark.createDataFrame([(100, "水位"), (101, "Henry Hub"), (102, "长江水位上升")], "followup long, metric string")
    metrics = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("followup"), F.col("n_name").alias("metric")).unionByName(more)
    return J.mentions(articles, metrics.select("followup", "metric", F.lit("active").alias("status"), F.array(F.col("followup").cast("string")).alias("tags")))


@query(f"""WITH e AS (SELECT doc_id AS event, {spaced_sql('text')} AS t FROM documents), l(lens, word) AS (VALUES ('a', 'tion'), ('a', 'ing'), ('a', 'of the'), ('b', 'ed'), ('c', 'que'), ('c', 'er'), ('d', 'que la'), ('d', 'in die'), ('d', 'the thing that is'))
SELECT event, lens, met FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY met DESC, lens) AS r FROM (SELECT event, lens, count(*) AS met FROM e JOIN l ON contains(t, ' ' || word || ' ') GROUP BY 1, 2)) WHERE r <= 5""")
def lens_matches(spark, sf_dir):
    """Signals of one word and of several."""
    lenses = spark.createDataFrame([("a", ["tion", "ing", "of the"]), ("b", ["ed"]), ("c", ["que", "er"]), ("d", ["que la", "in die", "the thing that is"])], "lens string, signals array<string>")
    return verbs.lens(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event"), "text"), lenses).select("event", "lens", "met")


@query(f"""WITH n AS (SELECT doc_id AS topic, unnest([regexp_extract(text, '^(\\S+ \\S+)', 1), regexp_extract(text, '^(\\S+ \\S+ \\S+)', 1)]) AS name FROM documents UNION ALL SELECT -1, '水位' UNION ALL SELECT -2, '江水位上'),
k AS (SELECT topic, {spaced_sql('name')} AS n FROM n), s AS (SELECT conv_id || '/' || turn AS todo, role AS section, {spaced_sql(SPOKEN)} AS t FROM conversations WHERE role IN ('user', 'system'))
SELECT DISTINCT todo, section, topic FROM s JOIN k ON contains(t, n) WHERE trim(n) <> ''""")
def misfiled_todos(spark, sf_dir):
    """turns of users and the system as todos of general sections; documents, by their first words, as tracked topics."""
    todos = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("todo"), F.col("role").alias("section"), F.expr(SPOKEN).alias("text"))
    names = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("topic"), F.explode(F.array(F.regexp_extract("text", r"^(\S+ \S+)", 1), F.regexp_extract("text", r"^(\S+ \S+ \S+)", 1))).alias("name"))
    return N.misfiled(todos, names.unionByName(spark.createDataFrame([(-1, "水位"), (-2, "江水位上")], names.schema)), ("user", "system"))


@query(rf"""WITH d AS (SELECT doc_id AS post, {UNCUT} AS text FROM documents), r AS (SELECT '^' || unnest(regexp_extract_all(text, '{UNSEGMENTED}+')) || '$' AS run FROM d),
c AS MATERIALIZED (SELECT substr(run, i, m) AS gram, count(*) AS n FROM (SELECT run, unnest(range(1, length(run) + 1)) AS i FROM r), range(1, 6) t(m) WHERE i + m - 1 <= length(run) GROUP BY 1),
p AS (SELECT * FROM c WHERE NOT regexp_matches(gram, '[\^$]')), t AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM p WHERE length(gram) = 1), w AS (SELECT * FROM p WHERE length(gram) BETWEEN 2 AND 4 AND n >= 50),
s AS (SELECT gram, n, substr(gram, 1, i) AS a, substr(gram, i + 1) AS b FROM (SELECT gram, n, unnest(range(1, length(gram))) AS i FROM w)),
tied AS (SELECT s.gram FROM s JOIN p x ON x.gram = a JOIN p y ON y.gram = b, t GROUP BY 1 HAVING min((s.n * total) / (CAST(x.n AS DOUBLE) * y.n)) >= 3),
rights AS (SELECT substr(gram, 1, length(gram) - 1) AS gram FROM c WHERE length(gram) >= 3 GROUP BY 1 HAVING round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 9) >= 2),
lefts AS (SELECT substr(gram, 2) AS gram FROM c WHERE length(gram) >= 3 GROUP BY 1 HAVING round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 9) >= 2),
f AS MATERIALIZED (SELECT gram AS term, n FROM w WHERE gram IN (FROM tied) AND gram IN (FROM rights) AND gram IN (FROM lefts))
SELECT term, n, (SELECT count(DISTINCT post) FROM d WHERE contains(text, term)) AS posts FROM f""")
def discovered_terms(spark, sf_dir):
    """The words of documents written without spaces, and in how many different ones each occurs."""
    posts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("post"), F.expr(UNCUT).alias("text")).repartition("post")  # the given table is one split, and its runs of characters are many
    found = stored(N.discovered(posts, at_least=50, cohesion=3.0, freedom=2.0).select("term", "n"))
    return A.term_posts(posts, 1, found).join(found, "term").select("term", "n", "posts")


@query("""WITH f AS MATERIALIZED (SELECT DISTINCT 'wiki/' || p_name AS path FROM part), b AS (SELECT DISTINCT 'wiki/' || CASE p_partkey % 3 WHEN 0 THEN substr(p_name, 1, length(p_name) - 1) || 'x' WHEN 1 THEN 'X' || substr(p_name, 2) ELSE p_name || ' ' || p_type END AS target FROM part UNION SELECT 'wiki/zzz'),
p AS (SELECT target, path, 1 - levenshtein(target, path) / CAST(greatest(length(target), length(path)) AS DOUBLE) AS s FROM b, f), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY s DESC, path DESC) AS n FROM p WHERE s >= 0.7)
SELECT b.target, path AS repair, s AS score FROM b LEFT JOIN r ON r.target = b.target AND n = 1""")
def link_repairs(spark, sf_dir):
    """The nearest of all files, whatever letter it begins with."""
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("wiki/"), "p_name").alias("path"))
    broken = table(spark, sf_dir, "part").selectExpr("'wiki/' || CASE p_partkey % 3 WHEN 0 THEN substr(p_name, 1, length(p_name) - 1) || 'x' WHEN 1 THEN 'X' || substr(p_name, 2) ELSE p_name || ' ' || p_type END AS target")
    return J.repairs(broken.unionByName(table(spark, sf_dir, "region").selectExpr("'wiki/zzz' as target")), files)


@query("""WITH RECURSIVE n AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem), c AS (SELECT src, dst, count(*) AS n FROM n WHERE dst IS NOT NULL GROUP BY 1, 2),
e AS MATERIALIZED (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r FROM c) WHERE r = 1),
w AS (SELECT src AS node, dst AS cur FROM e UNION SELECT w.node, e.dst FROM w JOIN e ON e.src = w.cur)
SELECT node, min(cur) AS component FROM w GROUP BY 1 HAVING bool_or(cur = node)""")
def follower_cycles(spark, sf_dir):
    """Each part calls the one that most often follows it in orders; parts that reach themselves, with the least of their cycle."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst")).where("dst is not null")
    most = pairs.groupBy("src", "dst").agg(F.count("*").alias("n")).groupBy("src").agg(F.max_by("dst", F.struct("n", (-F.col("dst")).alias("least"))).alias("dst"))
    return G.strongly_connected(most)


@query("""WITH m AS (SELECT DISTINCT l_suppkey AS member, l_partkey AS item FROM lineitem UNION SELECT s_suppkey, -1 FROM supplier)
SELECT a.member AS i, b.member AS j, count(*) AS shared FROM m a JOIN m b ON a.item = b.item AND a.member < b.member WHERE b.member - a.member > 1 GROUP BY 1, 2 HAVING count(*) >= 3""")
def unrecorded_pairs(spark, sf_dir):
    """Suppliers that share three parts, one of which all have; neighbours by number are recorded already, in either direction."""
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("member"), F.lit(-1).cast("long").alias("item"))
    edges = table(spark, sf_dir, "supplier").selectExpr("if(s_suppkey % 2 = 0, s_suppkey, s_suppkey + 1) as src", "if(s_suppkey % 2 = 0, s_suppkey + 1, s_suppkey) as dst")
    return J.cross_pairs(shipped(spark, sf_dir).select("member", F.col("variable").alias("item")).unionByName(own), edges, 3)


@query("SELECT doc_id, CASE WHEN length(trim(coalesce(text, ''))) = 0 THEN 'reject' WHEN length(text) > 4096 THEN 'truncate' WHEN length(trim(text)) <= 50 THEN 'send' ELSE 'confirm' END AS guard FROM documents")
def pushes_guarded(spark, sf_dir):
    """F27."""
    return table(spark, sf_dir, "documents").select("doc_id", FL.push_guard(F.col("text")).alias("guard"))


@query("SELECT n_nationkey AS selector, CASE count(s_suppkey) WHEN 0 THEN 'list_all' WHEN 1 THEN 'act' ELSE 'list_matches' END AS action FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def selected_suppliers(spark, sf_dir):
    """a nation selects its suppliers."""
    counts = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("selector")).agg(F.count("*").alias("matches"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("selector")).join(counts, "selector", "left").select("selector", FL.selection(F.coalesce("matches", F.lit(0))).alias("action"))


@query("""WITH d AS (SELECT doc_id, lang, string_split(lower(text), ' ') AS w FROM documents)
SELECT doc_id, CASE WHEN list_contains(w, 'the') AND list_contains(w, 'onth') THEN 3 WHEN list_contains(w, 'the') OR list_contains(w, 'onth') THEN 2 WHEN lang = 'fr' THEN 1 ELSE 0 END AS tier FROM d""")
def lens_tiers(spark, sf_dir):
    """F25, O09."""
    signals = F.array(F.lit("the"), F.lit("onth"))
    return table(spark, sf_dir, "documents").select("doc_id", FL.lens_tier(signals, F.split(F.lower("text"), " "), F.col("lang"), F.lit("fr")).alias("tier"))


@query("SELECT o_orderkey AS id, CAST((2001 - year(o_orderdate)) * 12 + 1 - month(o_orderdate) - CASE WHEN day(o_orderdate) > 1 THEN 1 ELSE 0 END AS INTEGER) AS months FROM orders")
def ages_in_months(spark, sf_dir):
    """X13."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), X.age_months(F.to_date("o_orderdate"), F.lit("2001-01-01").cast("date")).alias("months"))


@query(f"""WITH RECURSIVE e AS ({EDGES}), w AS (SELECT 0 AS node, 0 AS hop UNION SELECT e.dst, w.hop + 1 FROM w JOIN e ON e.src = w.node WHERE w.hop < 10)
SELECT node, CASE WHEN min(hop) <= 1 THEN 'normal' ELSE 'needs_reason' END AS class FROM w GROUP BY 1""")
def hop_classes(spark, sf_dir):
    """Which nations a walk reaches only past its soft stop, here the first hop."""
    return G.hops(nation_edges(spark, sf_dir), spark.createDataFrame([(0,)], "node int")).select("node", G.hop_class(1).alias("class"))


@query("""WITH s AS (SELECT p_partkey AS variable, 'size ' || p_size AS state, DATE '2000-01-01' AS day FROM part), f AS (SELECT l_partkey AS variable, max(l_shipdate) AS ts, max_by(l_orderkey, {'t': l_shipdate, 'o': l_orderkey}) AS o FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT s.variable, coalesce('order ' || o, state) AS state, CAST(coalesce(CAST(ts AS DATE), day) AS VARCHAR) AS as_of, CASE WHEN o IS NOT NULL THEN '[auto: ' || strftime(ts, '%Y-%m-%d') || '] returned' END AS entry FROM s LEFT JOIN f USING (variable)""")
def tracked_states(spark, sf_dir):
    """A part's latest return replaces its state, and an entry is appended."""
    held = table(spark, sf_dir, "part").selectExpr("p_partkey as variable", "'size ' || p_size as state", "date'2000-01-01' as as_of")
    news = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("variable")).agg(F.max(F.struct("l_shipdate", "l_orderkey")).alias("x"))
    state, entries = K.tracker_update(held, news.selectExpr("variable", "'order ' || x.l_orderkey as new", "to_date(x.l_shipdate) as day", "'returned' as text"))
    return state.join(entries, "variable", "left").select("variable", "state", F.col("as_of").cast("string").alias("as_of"), "entry")
