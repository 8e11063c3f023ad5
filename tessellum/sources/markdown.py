"""Readers of a file-based knowledge base (S01-S24): text files to typed DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tessellum.functions.scalar import inline_tag, is_checked

#: Folders of the base and the kind of what they hold, fixed values.
KINDS = {"wiki/sources": "source", "wiki/topics": "topic", "wiki/connections": "connection", "wiki/analysis": "report", "wiki/followups": "followup", "wiki/variables": "variable", "decisions": "decision", "todos": "todo", "inbox": "inbox", "raw": "raw", "context": "context"}
HEADER = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?(.*)\z"


def kind_of(path: Column) -> Column:
    """The kind that a path's folder says; 'other' elsewhere."""
    found = F.lit("other")
    for folder, kind in KINDS.items():
        found = F.when(path.contains(f"/{folder}/"), F.lit(kind)).otherwise(found)
    return found


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Every Markdown file below a root, (path, kind, modified, text)."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    path = F.col("_metadata.file_path")
    return files.select(path.alias("path"), kind_of(path).alias("kind"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))


def headers(docs: DataFrame) -> DataFrame:
    """(path, kind, fields, body): 'key: value' lines between --- become a map; without a header the map is empty.

    Lists in brackets stay text; list_of() splits them. Of a repeated key the last holds.
    """
    block = F.regexp_extract("text", HEADER, 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([\w-]+):", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[\w-]+:(.*)$", 1)), r'^"(.*)"$', "$1").alias("value")))
    merged = F.aggregate(pairs, F.expr("cast(map() as map<string,string>)"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x["key"]), F.map_from_entries(F.array(x))))
    body = F.when(F.col("text").rlike(HEADER), F.regexp_extract("text", HEADER, 2)).otherwise(F.col("text"))
    return docs.select("path", "kind", merged.alias("fields"), body.alias("body"))


def list_of(value: Column) -> Column:
    """Items of '[a, b]' or 'a, b'; null and empty give an empty array."""
    items = F.split(F.regexp_replace(F.coalesce(value, F.lit("")), r"^\[|\]$", ""), r"\s*,\s*")
    return F.filter(F.transform(items, lambda x: F.regexp_replace(F.trim(x), r'^["\']|["\']$', "")), lambda x: x != "")


def meta(parsed: DataFrame, *columns: str) -> DataFrame:
    """Header columns alone; bodies are not read further."""
    return parsed.select("path", "kind", *(F.try_element_at("fields", F.lit(c)).alias(c) for c in columns))


def recent(cards: DataFrame, as_of: str, days: int = 30, most: int = 50) -> DataFrame:
    """The newest cards of the last days, at most so many; ties by path."""
    day = F.lit(as_of).cast("date")
    return cards.where((F.col("date") >= F.date_sub(day, days)) & (F.col("date") <= day)).orderBy(F.col("date").desc(), "path").limit(most)


def holdings_first(rows: DataFrame, holdings: DataFrame, key: str = "target") -> DataFrame:
    """Rows with is_holding, those first."""
    marked = rows.join(holdings.select(key).distinct().withColumn("is_holding", F.lit(True)), key, "left").withColumn("is_holding", F.coalesce("is_holding", F.lit(False)))
    return marked.orderBy(F.col("is_holding").desc(), key)


def of_target(rows: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """Rows of one target, found by any of its names; aliases has (alias, target)."""
    return rows.join(aliases.where(F.lower("alias") == name.lower()).select("target").distinct(), "target", "left_semi")


def own_text(spark: SparkSession, title: str, body: str, day: str) -> DataFrame:
    """Pasted text as a card of one's own."""
    return spark.createDataFrame([(title, body, day, "self")], "title string, body string, date string, source string")


def inbox_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of pending files; none arrive, nothing runs."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


@udtf(returnType="number string, title string, body string")
class Chapters:
    """Chapters of a text at '# ' headings or 'Chapter n' lines, numbered from 000; without any, the whole text."""

    def eval(self, text: str) -> Iterator[tuple]:
        parts = re.split(r"(?m)^(?=# |Chapter \d+)", text or "")
        for i, part in enumerate(p for p in parts if p.strip()):
            yield f"{i:03d}", part.strip().split("\n")[0].lstrip("# "), part


def sections(parsed: DataFrame) -> DataFrame:
    """(path, ord, level, heading, section) by ## and ### headings; text above the first has ord 0 and no heading."""
    parts = parsed.select("path", F.posexplode(F.split("body", r"(?m)^(?=#{2,3} )")).alias("ord", "part"))
    marks = F.regexp_extract("part", r"\A(#{2,3}) ", 1)
    return parts.select("path", "ord", F.length(marks).alias("level"), F.nullif(F.trim(F.regexp_extract("part", r"\A#{2,3} ([^\n]*)", 1)), F.lit("")).alias("heading"), F.regexp_replace("part", r"\A#{2,3} [^\n]*\n?", "").alias("section"))


def tasks(parsed: DataFrame) -> DataFrame:
    """Task and alarm lines with the section they stand in, carried down from the last heading."""
    lines = parsed.select("path", F.posexplode(F.split("body", r"\r?\n")).alias("ord", "line"))
    heading = F.nullif(F.regexp_extract("line", r"^#+ (.*)$", 1), F.lit(""))
    above = Window.partitionBy("path").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    found = lines.withColumn("section", F.last(heading, ignorenulls=True).over(above)).where(F.col("line").rlike(r"^\s*- (\[[ xX]\]|⏰)"))
    text = F.trim(F.regexp_replace(F.regexp_replace("line", r"^\s*- (\[[ xX]\]|⏰)", ""), "`[^`]*`", ""))
    return found.select("path", "ord", "section", is_checked(F.col("line")).alias("checked"), text.alias("text"), *(inline_tag(F.col("line"), k).alias(k) for k in ("created", "completed", "cadence", "source")), F.coalesce(inline_tag(F.col("line"), "remind"), inline_tag(F.col("line"), "alarm")).alias("remind"))


STAGING = "variable_id string, first_detected date, last_check date, consecutive_likely_dead int, evidence string"


def staging(docs: DataFrame) -> DataFrame:
    """The closing queue of a JSON state file; damaged files give no rows."""
    queue = F.from_json("text", f"pending_close array<struct<{STAGING.replace(' string', ': string').replace(' date', ': date').replace(' int', ': int')}>>")
    return docs.select(F.explode(F.coalesce(queue["pending_close"], F.array())).alias("row")).select("row.*")


def settings(lines: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """KEY=value lines, comments aside, over defaults; of a repeated key the last line holds."""
    found = lines.select(F.monotonically_increasing_id().alias("n"), F.trim("value").alias("line")).where(F.col("line").rlike("^(export )?[A-Za-z_]\\w*="))
    found = found.select("n", F.regexp_extract("line", r"^(?:export )?(\w+)=", 1).alias("key"), F.regexp_replace(F.regexp_extract("line", r"^[^=]*=([^#]*)", 1), r'^\s*"?|"?\s*$', "").alias("value"))
    found = found.groupBy("key").agg(F.max_by("value", "n").alias("value"))
    given = lines.sparkSession.createDataFrame(list((defaults or {}).items()), "key string, value string")
    return given.join(found.select("key"), "key", "left_anti").unionByName(found)


def catalogue(variables: DataFrame, sector_variables: DataFrame, edges: DataFrame) -> DataFrame:
    """Variables with the sectors whose templates list them and their number of edges."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("edges"))
    listed = sector_variables.groupBy("id").agg(F.array_sort(F.collect_set("sector")).alias("sectors"))
    return variables.join(listed, "id", "left").join(out, "id", "left").fillna({"edges": 0})


def handed_over(spark: SparkSession, path: str) -> DataFrame:
    """path|title|review_date lines; bad lines are dropped, all bad is an error of format."""
    return checked_handover(spark.read.schema("path string, title string, review_date date").option("sep", "|").option("mode", "DROPMALFORMED").csv(path), spark.read.text(path))


def checked_handover(good: DataFrame, lines: DataFrame) -> DataFrame:
    if not good.take(1) and not lines.where(F.trim("value") != "").isEmpty():
        raise ValueError("no line of the hand-over has the form path|title|date")
    return good


def with_context(rows: DataFrame, context: DataFrame, personal: Column) -> DataFrame:
    """Personal context, joined to personal questions alone."""
    return rows.join(context, (rows["owner"] == context["owner"]) & personal, "left").drop(context["owner"])


def last_runs(lines: DataFrame) -> DataFrame:
    """task=epoch lines, the latest of each task."""
    found = lines.select(F.regexp_extract("value", r"^([\w-]+)=(\d+)", 1).alias("task"), F.expr("try_cast(regexp_extract(value, '^([\\\\w-]+)=([0-9]+)', 2) as bigint)").alias("epoch"))
    return found.where("task <> ''").groupBy("task").agg(F.max("epoch").alias("epoch"))


def index_or_scan(index: DataFrame, scanned: DataFrame) -> DataFrame:
    """The index where its counts agree with the folders, else what the folders hold."""
    drift = index.groupBy("kind").agg(F.count("*").alias("i")).join(scanned.groupBy("kind").agg(F.count("*").alias("s")), "kind", "full").where("not (i <=> s)")
    return scanned if not drift.isEmpty() else index


def lens_sections(found: DataFrame, markers: tuple[str, str] = ("Lens", "Method")) -> DataFrame:
    """Lens sections of both path families, by their marker headings."""
    first = found.where(F.col("path").contains("/lenses/") & (F.col("heading") == markers[0])).withColumn("family", F.lit("lens"))
    second = found.where(F.col("path").contains("/skills/") & (F.col("heading") == markers[1])).withColumn("family", F.lit("skill"))
    return first.unionByName(second)


def distilled(books: DataFrame, skills: DataFrame) -> DataFrame:
    """Books that have a distilled skill."""
    return books.join(skills, "book", "left_semi")


def archive_week(archive: DataFrame, iso_year: int, iso_week: int) -> DataFrame:
    """One week's archive, by partition."""
    return archive.where((F.col("iso_year") == iso_year) & (F.col("iso_week") == iso_week))


def fetched(pages: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """Pages already fetched, a first tool's results before a second's; nothing is fetched here."""
    if first is None:
        return pages.withColumn("tool", F.lit("fallback"))
    rest = pages.join(first.select("url"), "url", "left_anti").withColumn("tool", F.lit("fallback"))
    return first.withColumn("tool", F.lit("primary")).unionByName(rest)


def quotes(rows: DataFrame, target: str = "target", ts: str = "ts", value: str = "value") -> DataFrame:
    """Market data as an input table, (target, ts, value); of several values of one time the greatest holds. Nothing is fetched here."""
    plain = rows.select(F.col(target).alias("target"), F.col(ts).alias("ts"), F.col(value).cast("double").alias("value"))
    return plain.where("ts is not null").groupBy("target", "ts").agg(F.max("value").alias("value"))
