"""One query per operator, over its whole table with production parameters, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.llm import clusters, common, conversations, embeddings, huffman, licenses, lines, minhash, mixing, packing, quality, toxicity, urls, warc
from tessellum.llm.license_rules import RULES, SURE, compiled, keywords
from tessellum.llm.tokens import tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's capture, as found through the index of the archives that were written."""
    common.narrow_batches(spark)
    pages = _table(spark, sf_dir, "pages")
    found = warc.lookup(warc.write(pages), pages.select("url", "page_id"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and digest of ids, as read back from the coded files."""
    common.narrow_batches(spark)
    files = huffman.write(_table(spark, sf_dir, "documents"), tokenizer=tokenizer_path("byte_bpe_50k.json"))
    return huffman.read(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of all documents with the first line of its component."""
    return lines.line_components(_table(spark, sf_dir, "documents"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings by a cosine of 0.9 or more."""
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return urls.judge(_table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, with its source's size and target."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", F.expr("size * copies").alias("taken"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles are alike by 0.8 or more."""
    common.narrow_batches(spark)
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset there."""
    common.narrow_batches(spark)
    packed = packing.pack(_table(spark, sf_dir, "documents"), tokenizer=tokenizer_path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document, by a machine that has not seen the labels of held-out ones."""
    common.narrow_batches(spark)
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.expr("pmod(crc32(cast(doc_id as string)), 3) = 1").alias("held_out"), "score", F.expr("cast(score >= 0.7 as int)").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the base rules and the learned list on every document."""
    common.narrow_batches(spark)
    docs = _table(spark, sf_dir, "documents")
    judged = quality.judge(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of every conversation, damaged and repaired."""
    common.narrow_batches(spark)
    return conversations.repair(conversations.damaged(_table(spark, sf_dir, "conversations")))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance, inertia and centroid digest of every whole embedding."""
    return clusters.cluster(_table(spark, sf_dir, "embeddings"))[0]


def _rounds(rounds: int) -> str:
    """CTEs a0, c1, a1, ...: nearest centroids of all vectors, then the centroids' exact floors of means."""
    ctes = []
    for n in range(rounds + 1):
        ctes.append(f"d{n} AS MATERIALIZED (SELECT v.r, c.cluster, CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{n} c)")
        ctes.append(f"a{n} AS MATERIALIZED (SELECT r, min({{'d': d, 'c': cluster}}) AS x FROM d{n} GROUP BY r)")
        if n < rounds:
            ctes.append(f"m{n} AS (SELECT x.c AS cluster, i, CAST(floor(sum(v.e[i]) / count(*)) AS BIGINT) AS e FROM a{n} JOIN v USING (r), range(1, 65) t(i) GROUP BY 1, 2)")
            ctes.append(f"c{n + 1} AS MATERIALIZED (SELECT cluster, coalesce(n.e, c.e) AS e FROM c{n} c LEFT JOIN (SELECT cluster, list(e ORDER BY i) AS e FROM m{n} GROUP BY 1) n USING (cluster))")
    return ",\n             ".join(ctes)


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, base phrases, labels and assurance of every whole document."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def _rule_rows() -> str:
    """The rules as SQL rows (rule, level, label, base, keys, pattern)."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({n}, {r.level}, {text(r.label)}, {str(r.base).lower()}, [{', '.join(map(text, keywords(r.pattern)))}], {text(compiled(r.pattern))})" for n, r in enumerate(RULES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_huffman": op2_huffman,
    "op3_lines": op3_lines,
    "op4_embeddings": op4_embeddings,
    "op5_urls": op5_urls,
    "op6_mixing": op6_mixing,
    "op7_minhash": op7_minhash,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_conversations": op11_conversations,
    "op12_clusters": op12_clusters,
    "op13_licenses": op13_licenses,
}

ORACLE: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
             d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
             m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN best END AS refers_to
        FROM m""",
    "op4_embeddings": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
             ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
             l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
             r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, min(r.b) AS component_id, vec_id = min(r.b) AS kept
        FROM v JOIN r ON r.a = vec_id GROUP BY vec_id""",
    "op7_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
             n AS (SELECT doc_id, len(s) AS n FROM s),
             x AS (SELECT doc_id, unnest(s) AS g FROM s),
             p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
             h AS (SELECT a, b FROM p JOIN n i ON i.doc_id = a JOIN n j ON j.doc_id = b WHERE 100 * c >= 80 * (i.n + j.n - c)),
             l AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
             r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n""",
    "op11_conversations": r"""
        WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
             r AS (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)) AS b FROM conversations),
             h AS (SELECT *, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[1 + (xor(c, x) & 255)], c >> 8)), 4294967295) % 20 AS harm FROM r, t),
             d AS (SELECT g, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
             o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM d),
             f AS (SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) || left(role, 1) AS pair FROM o),
             e(frm, edit, initial, too, cost) AS (VALUES (0, 'D', NULL, 0, 4), (1, 'D', NULL, 1, 4), (2, 'D', NULL, 2, 4), (3, 'D', NULL, 3, 4), (0, 'R', NULL, 2, 3), (1, 'R', NULL, 2, 3), (2, 'R', NULL, 3, 3), (3, 'R', NULL, 2, 3), (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (3, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0)),
             c(frm, too, cost, ins) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (1, 2, 3, 'I'), (2, 3, 3, 'I'), (3, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 3, 6, 'II')),
             m AS (SELECT e.frm, e.edit, e.initial, c.too, e.cost + c.cost AS cost, e.edit || c.ins AS letters FROM e JOIN c ON c.frm = e.too),
             w AS (SELECT g, CAST(0 AS BIGINT) AS i, too AS st, {'c': cost, 'a': ins} AS x FROM (SELECT DISTINCT g FROM r), c WHERE frm = 0
                   UNION ALL
                   SELECT w.g, f.i, m.too, min({'c': w.x.c + m.cost + CASE WHEN f.fault = 'truncated' AND m.edit <> 'D' THEN 3 ELSE 0 END, 'a': w.x.a || m.letters})
                   FROM w JOIN f ON f.g = w.g AND f.i = w.i + 1 JOIN m ON m.frm = w.st AND (m.initial IS NULL OR m.initial = f.initial) AND (m.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate')) GROUP BY w.g, f.i, m.too),
             n AS (SELECT g, count(i) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM (SELECT DISTINCT g FROM r) LEFT JOIN f USING (g) GROUP BY g),
             z AS (SELECT n.*, min(w.x) AS x FROM n JOIN w ON w.g = n.g AND w.i = n.n AND w.st IN (0, 3) GROUP BY ALL),
             l AS (SELECT g, unnest(range(1, length(x.a) + 1)) AS p, x.a AS a FROM z),
             q AS (SELECT g, p, substr(a, p, 1) AS edit, length(replace(substr(a, 1, p), 'I', '')) AS i, length(replace(substr(a, 1, p), 'D', '')) AS j FROM l),
             y AS (SELECT q.*, f.role, f.text, max(CASE WHEN q.j = 1 AND q.edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY q.g) AS sys FROM q LEFT JOIN f ON f.g = q.g AND f.i = q.i AND q.edit <> 'I'),
             v AS (SELECT g, string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS whole FROM y WHERE edit <> 'D' GROUP BY g)
        SELECT (SELECT min(conv_id) FROM r WHERE r.g = z.g) AS conv_id, gaps, blank, duplicate, truncated, illegal, CAST(x.c AS BIGINT) AS cost, x.a AS audit, sha256(coalesce(whole, '')) AS repaired_sha256 FROM z LEFT JOIN v USING (g)""",
    "op12_clusters": f"""
        WITH w AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
             v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(e, lambda x: CAST(floor(256 * x) AS BIGINT)) AS e FROM w WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST) - 1 AS cluster, e FROM v ORDER BY sha256('2:' || vec_id) NULLS LAST LIMIT 40),
             {_rounds(5)}
        SELECT vec_id, CAST(x.c AS INTEGER) AS cluster, x.d AS distance, CAST(sum(x.d) OVER (PARTITION BY x.c) AS BIGINT) AS cluster_inertia, CAST(sum(x.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
        FROM a5 JOIN v USING (r) JOIN c5 c ON c.cluster = a5.x.c""",
    "op13_licenses": rf"""
        WITH rules(rule, level, label, base, keys, pattern) AS (VALUES {_rule_rows()}),
             d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
             k AS (SELECT rule, unnest(keys) AS key FROM rules),
             g AS (SELECT DISTINCT r, rule FROM (SELECT r, unnest(list_distinct(w)) AS key FROM d) JOIN k USING (key)),
             t AS (SELECT r, ' ' || array_to_string(w, '  ') || ' ' AS t FROM d),
             m AS (SELECT r, rules.*, regexp_extract_all(t, pattern, 0) AS hits, string_split_regex(t, pattern) AS gaps FROM g JOIN rules USING (rule) JOIN t USING (r) WHERE regexp_matches(t, pattern)),
             u AS (SELECT r, rule, level, label, base, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap FROM m),
             n AS (SELECT *, (length(hit) - length(replace(hit, ' ', ''))) // 2 AS size, (length(gap) - length(replace(gap, ' ', ''))) // 2 AS skip FROM u),
             s AS MATERIALIZED (SELECT r, rule, level, label, base, size, CAST(sum(size + skip) OVER (PARTITION BY r, rule ORDER BY i) AS BIGINT) AS stop FROM n),
             stays AS (SELECT * FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.r = a.r AND b.level <= a.level AND b.stop - b.size <= a.stop - a.size AND b.stop >= a.stop AND (b.size > a.size OR b.level < a.level OR b.rule < a.rule))),
             b AS (SELECT r, count(*) AS n_base, min(stop - size) AS first_word, max(stop - size) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM s WHERE base GROUP BY r),
             c AS (SELECT r, list_distinct(list(label)) AS labels, max([{", ".join(map(str, SURE))}][level + 1]) AS score FROM stays GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(b.labels, ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(c.labels, [])))), ','), '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
        FROM d LEFT JOIN b USING (r) LEFT JOIN c USING (r)""",
}
