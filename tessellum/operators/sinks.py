"""Writers and change rows (K01-K29). Operators give the rows to be written; applying them is a step of its own."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.functions.scalar import cut, deferred, iso_week, month_of, next_review, report_line, slug


#: Fixed values, K05: the sections of a changelog by priority.
SECTIONS = {"P0": "实时推送", "P1": "日报告", "P2": "仅 changelog"}


def card_keys(cards: DataFrame, title: str = "title", day: str = "date", order: str = "id") -> DataFrame:
    """YYYY-MM-DD-slug names; of equal ones the second gets -2, and so on."""
    base = F.concat_ws("-", F.date_format(day, "yyyy-MM-dd"), slug(F.col(title)))
    return suffixed(cards.withColumn("_base", base), "_base", order).drop("_base")


def suffixed(rows: DataFrame, base: str, order: str) -> DataFrame:
    """A `name` of its own for each row: equal ones are numbered from the second on."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return rows.withColumn("name", F.when(n == 1, F.col(base)).otherwise(F.concat_ws("-", base, n)))


def archive_raw(rows: DataFrame, path: str, day: str = "fetched", key: str | None = None) -> None:
    """Append originals by month; nothing is overwritten. With a key, those whose key the archive holds stay out, so a rerun adds nothing."""
    if key is not None:
        rows = rows.dropDuplicates([key])
        try:
            held = rows.sparkSession.read.parquet(path).select(F.col(key).alias("_held")).distinct()
        except AnalysisException as error:  # the first run finds no archive
            if "PATH_NOT_FOUND" not in str(error.getCondition()) and "UNABLE_TO_INFER_SCHEMA" not in str(error.getCondition()):
                raise
        else:
            rows = rows.join(held, F.col(key) == F.col("_held"), "left_anti")
    rows.withColumn("month", month_of(F.col(day))).write.mode("append").partitionBy("month").parquet(path)


def index_view(cards: DataFrame) -> DataFrame:
    """The index with its counters, as a view of what is there."""
    return cards.groupBy("kind").agg(F.count("*").alias("recorded"), F.max("date").alias("updated"))


def append_log(rows: DataFrame, path: str) -> None:
    """Append-only records."""
    rows.write.mode("append").parquet(path)


def changelog(changes: DataFrame) -> DataFrame:
    """One text per run: changes by priority, a summary, what waits for confirmation."""
    line = report_line(F.col("priority"), F.col("entity"), F.col("old"), F.col("new"))
    rows = changes.groupBy("run_ts").agg(F.array_sort(F.collect_list(line)).alias("lines"), *(F.count_if(F.col("priority") == p).alias(p) for p in ("P0", "P1", "P2")), F.count_if("pending").alias("waiting"))
    head = F.format_string("P0 %d, P1 %d, P2 %d, pending %d", "P0", "P1", "P2", "waiting")
    return rows.select("run_ts", F.concat_ws("\n", head, F.array_join("lines", "\n")).alias("text"))


def changelog_lines(changes: DataFrame, waiting: DataFrame, title: str = "sweep") -> DataFrame:
    """A run's paragraph as (run_ts, section, entity, line), in that order; no run is gathered in one row.

    changes: (run_ts, priority, action, entity, old, new, impact); waiting: (run_ts, entity, streak), variables with one
    verdict fewer than it takes. Section 0 is the heading and the summary, 1 to 3 are the priorities, 4 is what waits;
    a section without entries has no heading. Changes of another priority count in the sum alone. A null old value is a dash.
    """
    counts = changes.groupBy("run_ts").agg(F.count("*").alias("n"), *(F.count_if(F.col("priority") == p).alias(p) for p in SECTIONS))
    waits = waiting.groupBy("run_ts").agg(F.count("*").alias("waits"))
    runs = counts.join(waits, "run_ts", "full").fillna(0, ["n", "waits", *SECTIONS])
    total = F.format_string("**汇总**：变更 %d 条（P0 ×%d，P1 ×%d，P2 ×%d）", "n", *SECTIONS)
    heads = [F.struct(F.lit(0).alias("section"), F.concat(F.lit("## "), "run_ts", F.lit(f" · {title}\n\n"), total).alias("line"))]
    heads += [F.when(F.col(p) > 0, F.struct(F.lit(i).alias("section"), F.lit(f"#### {p} {name}").alias("line"))) for i, (p, name) in enumerate(SECTIONS.items(), 1)]
    heads += [F.when(F.col("waits") > 0, F.struct(F.lit(4).alias("section"), F.lit("#### 待二次确认").alias("line")))]
    head = runs.select("run_ts", F.explode(F.array_compact(F.array(*heads))).alias("x")).select("run_ts", "x.section", F.lit(None).cast("string").alias("entity"), "x.line")
    old, new = (F.coalesce(c, F.lit("-")) for c in ("old", "new"))
    named = F.concat(F.lit("- `"), F.coalesce("action", F.lit("-")), F.lit(" "), F.coalesce("entity", F.lit("-")), F.lit("`"))
    urgent = F.concat(named, F.lit("\n  旧: "), old, F.lit(" / 新: "), new, F.coalesce(F.concat(F.lit("\n  影响: "), "impact"), F.lit("")))
    section = F.when(F.col("priority") == "P0", 1).when(F.col("priority") == "P1", 2).when(F.col("priority") == "P2", 3)
    body = changes.select("run_ts", section.alias("section"), "entity", F.when(F.col("priority") == "P0", urgent).otherwise(F.concat(named, F.lit(" "), old, F.lit(" → "), new)).alias("line")).where("section is not null")
    rest = waiting.select("run_ts", F.lit(4).alias("section"), "entity", F.format_string("- %s（连续 %d 次判定失效，待第 %d 次确认）", "entity", "streak", F.col("streak") + 1).alias("line"))
    return head.unionByName(body).unionByName(rest)


def new_issues(found: DataFrame, still_open: DataFrame) -> DataFrame:
    """Issues not open already."""
    return found.join(still_open.select("issue").distinct(), "issue", "left_anti")


def upserted(held: DataFrame, news: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of `held`, replaced by those of `news` with the same key, and the new ones; with an order, of several news of a key the last."""
    if order is not None:
        news = news.groupBy(key).agg(F.max_by(F.struct(*news.columns), order).alias("_last")).select("_last.*")
    return held.join(news.select(key).distinct(), key, "left_anti").unionByName(news)


def message(text: Column) -> Column:
    """What is pushed: null for an empty text, cut above the cap."""
    return F.when(F.length(F.trim(text)) > 0, cut(text))


def retry(status: Column, attempt: Column) -> Column:
    """One more attempt after 3 seconds, but not after a refusal."""
    return F.when(status.between(200, 299), "sent").when(status.isin(401, 403), "refused").when(attempt < 2, "retry_in_3s").otherwise("failed")


def push(send: Callable[[str], int] | None = None, wait: float = 3.0, log: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that tries once more after `wait` seconds unless refused (retry()); without a sender, and by default, nothing leaves.

    Into `log` go (text, attempts, outcome) of each message, in a folder for each batch, which a batch that comes again writes over;
    outcome is sent, refused or failed. Messages go out one by one, so a batch's outcomes are as few as its messages.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if send is None:
            return
        outcomes = []
        for row in rows.select("text").toLocalIterator():
            status, attempts = send(row["text"]), 1
            if status not in range(200, 300) and status not in (401, 403):
                time.sleep(wait)
                status, attempts = send(row["text"]), 2
            outcomes.append((row["text"], attempts, status))
        if log is not None:
            told = rows.sparkSession.createDataFrame(outcomes, "text string, attempts int, status int")
            told.select("text", "attempts", retry(F.col("status"), F.col("attempts")).alias("outcome")).write.mode("overwrite").parquet(f"{log}/batch={number}")

    return batch


def mailbox(notices: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Notices not acknowledged yet."""
    return notices.join(acknowledged.select("notice").distinct(), "notice", "left_anti")


def notify_line(rows: DataFrame, kind: str, most: int = 20) -> DataFrame:
    """K11: 'NOTIFY: kind n: titles'; no row when there is nothing. Titles are the first of their order, the count is of all."""
    titles = rows.select("title").orderBy("title").limit(most).agg(F.array_sort(F.collect_list("title")).alias("t"))
    found = rows.agg(F.count("*").alias("n")).where("n > 0").crossJoin(titles)
    return found.select(F.concat(F.lit(f"NOTIFY: {kind} "), F.col("n"), F.lit(": "), F.array_join("t", "; ")).alias("line"))


def sourced_drafts(drafts: DataFrame) -> DataFrame:
    """Drafts that say their sources."""
    return drafts.where(F.size("sources") > 0)


def learning_plan(docs: DataFrame) -> DataFrame:
    """Items by stage as a nested array, none done."""
    item = F.struct("stage", "ord", "title", "path", F.lit(False).alias("done"))
    return docs.groupBy("plan").agg(F.array_sort(F.collect_list(item)).alias("items"))


def tracker_update(snapshots: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshots, the new value over the old; analysis entries to append, marked with their day)."""
    state = found.select("variable", F.col("new").alias("state"), F.col("day").alias("as_of"))
    entry = found.select("variable", F.concat(F.lit("[auto: "), F.date_format("day", "yyyy-MM-dd"), F.lit("] "), F.col("text")).alias("entry"))
    return upserted(snapshots, state, "variable"), entry


def decision_upsert(decisions: DataFrame, found: DataFrame) -> DataFrame:
    """An open decision of the target gets a note and its review in three months; else a new one is opened."""
    note = found.select("target", "note", F.col("day").alias("_day"))
    rows = decisions.where("status = 'open'").join(note, "target", "full")
    review = next_review(F.coalesce("_day", "review_date"))
    rows = rows.select("target", F.lit("open").alias("status"), F.when(F.col("note").isNull(), F.col("review_date")).otherwise(review).alias("review_date"), F.concat_ws("\n", "context", "note").alias("context"))
    return rows.unionByName(decisions.where("status <> 'open'").select("target", "status", "review_date", "context"))


def weekly_archive(todos: DataFrame, day: str = "completed") -> DataFrame:
    """Finished items with their ISO year and week, to partition by."""
    done = todos.where("done")
    return done.withColumn("week", iso_week(F.col(day))).withColumn("iso_year", F.extract(F.lit("yearofweek"), F.col(day))).withColumn("iso_week", F.weekofyear(day))


def closed_week(todos: DataFrame, taken: DataFrame, as_of: Column) -> DataFrame:
    """Each item with its `place` when the week is closed, and the archive's `file`, null for what stays active.

    todos: (done, long_term, created and others); taken: (name) of archive files. Finished items go to the archive as done; unfinished ones
    that are not long-term go as deferred if created before this week's Monday; the rest stays active, as does everything where
    nothing is finished. The file is the week's name, or with the first of -2, -3 and so on that is not taken. Null flags are false,
    an item without a day of creation stays.
    """
    week, n = iso_week(as_of), F.nullif(F.regexp_extract("name", r"^\d{4}-W\d{2}-(\d{1,8})$", 1), F.lit("")).cast("int")
    held = taken.where(F.col("name").rlike(r"^\d{4}-W\d{2}(-\d{1,8})?$") & (F.substring("name", 1, 8) == week)).select(F.coalesce(n, F.lit(1)).alias("n")).distinct()
    free = held.selectExpr("n + 1 as n").unionByName(todos.sparkSession.range(1, 2).selectExpr("cast(id as int) as n")).join(held, "n", "left_anti").agg(F.min("n").alias("n"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    one = free.select(F.when(F.col("n") == 1, week).otherwise(F.concat_ws("-", week, "n")).alias("_file")).crossJoin(todos.agg(F.coalesce(F.bool_or("done"), F.lit(False)).alias("_any")))
    place = F.when(~F.col("_any"), "active").when(flag("done"), "done").when(~flag("long_term") & deferred(F.col("created"), as_of), "deferred").otherwise("active")
    rows = todos.crossJoin(F.broadcast(one)).withColumn("place", place)  # one row
    return rows.withColumn("file", F.when(F.col("place") != "active", F.col("_file"))).drop("_file", "_any")


def delta(previous: DataFrame, current: DataFrame, key: str = "item") -> DataFrame:
    """Each item of two reports: added, gone, revised or still valid."""
    both = previous.select(key, F.col("value").alias("old")).join(current.select(key, F.col("value").alias("new")), key, "full")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "gone").when(F.col("old") != F.col("new"), "revised").otherwise("valid")
    return both.withColumn("status", status)


def backup(topic: DataFrame, version: int = 1) -> DataFrame:
    """The topic's rows under a version's key."""
    return topic.withColumn("slug", F.concat(F.col("slug"), F.lit(f"-v{version}")))


def latest_state(events: DataFrame, key: str = "todo") -> DataFrame:
    """The last event of each item decides; deleted ones are gone; what an edit leaves out is kept."""
    w = Window.partitionBy(key).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = {c: F.last(c, ignorenulls=True).over(w) for c in events.columns if c not in (key, "ts", "seq", "action")}
    rows = events.withColumns({f"_{c}": e for c, e in kept.items()}).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col("seq").desc())))
    return rows.where("_n = 1 and action <> 'delete'").select(key, F.col("action").alias("last_action"), (F.col("action") == "complete").alias("done"), *(F.col(f"_{c}").alias(c) for c in kept))


def reviewed(decisions: DataFrame, answers: DataFrame) -> DataFrame:
    """Decisions become reviewed where a person answered, and stay as they are elsewhere."""
    rows = decisions.join(answers.select("id", F.col("day").alias("reviewed_date")), "id", "left")
    return rows.withColumn("status", F.when((F.col("status") == "open") & F.col("reviewed_date").isNotNull(), "reviewed").otherwise(F.col("status")))
