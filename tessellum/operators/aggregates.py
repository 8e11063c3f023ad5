"""Aggregates and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.functions.scalar import progress_bar, terms
from tessellum.operators.text import post_terms

#: How strong the logic, how far priced in and how crowded, to one of five outcomes, fixed values; None takes any.
PRICING = (("strong", "unpriced", "vacant", "opportunity"), ("strong", "partly", "fair", "trend"), ("strong", "fully", "crowded", "negative"), ("strong", "fully", "vacant", "anomaly"), ("weak", None, None, "drop"))


def index_drift(index: DataFrame, scanned: DataFrame) -> DataFrame:
    """Kinds whose recorded count differs from what is there; a kind that the index lacks counts 0."""
    return scanned.groupBy("kind").agg(F.count("*").alias("found")).join(index.select("kind", "recorded"), "kind", "full").fillna(0).where("found <> recorded")


def crowded(rows: DataFrame, by: list[str], at_least: int = 3, existing: DataFrame | None = None) -> DataFrame:
    """Groups of enough rows, without those that exist already."""
    found = rows.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= at_least)
    return found if existing is None else found.join(existing.select(*by).distinct(), by, "left_anti")


def term_posts(posts: DataFrame, at_least: int = 2, words: DataFrame | None = None) -> DataFrame:
    """Terms and the number of different posts that have them; with words (term), as text.discovered() finds them, those of unsegmented text too."""
    found = posts.select("post", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    if words is not None:
        found = found.unionByName(post_terms(posts, words))
    return found.distinct().groupBy("term").agg(F.count("*").alias("posts")).where(F.col("posts") >= at_least)


def independent_sources(sightings: DataFrame, key: str = "candidate") -> DataFrame:
    """Two different sources, or an authoritative and a community one."""
    found = sightings.groupBy(key).agg(F.countDistinct("source").alias("sources"), F.count_if(F.col("kind") == "authoritative").alias("authoritative"), F.count_if(F.col("kind") == "community").alias("community"))
    return found.withColumn("strong", (F.col("sources") >= 2) | ((F.col("authoritative") > 0) & (F.col("community") > 0)))


def converging(rows: DataFrame, key: str, kind: str, at_least: int = 3) -> DataFrame:
    """Keys on which enough different kinds meet, with the kinds."""
    found = rows.groupBy(key).agg(F.sort_array(F.collect_set(kind)).alias("kinds"))
    return found.withColumn("n", F.size("kinds")).where(F.col("n") >= at_least)


def dossier_due(references: DataFrame, targets: int = 3, sectors: int = 2) -> DataFrame:
    """Variables that enough targets or sectors refer to."""
    found = references.groupBy("variable").agg(F.countDistinct("target").alias("targets"), F.countDistinct("sector").alias("sectors"))
    return found.where((F.col("targets") >= targets) | (F.col("sectors") >= sectors))


def counted(rows: DataFrame, *by: str) -> DataFrame:
    """Rows per group."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def progress(items: DataFrame, by: str = "plan") -> DataFrame:
    """Done, total, and a bar."""
    found = items.groupBy(by).agg(F.count_if("done").alias("done"), F.count("*").alias("total"))
    return found.withColumn("bar", progress_bar(F.col("done"), F.col("total")))


def archive_totals(todos: DataFrame) -> DataFrame:
    """A10: done and deferred per category."""
    return todos.groupBy("category").agg(F.count_if("done").alias("done"), F.count_if(~F.col("done")).alias("deferred"))


def by_priority(changes: DataFrame, by: str, priorities: list[str]) -> DataFrame:
    """A column of counts per priority; given priorities spare a pass over the data."""
    return changes.groupBy(by).pivot("priority", priorities).agg(F.count(F.lit(1))).fillna(0)


def review_summary(reviews: DataFrame, most: int = 20) -> DataFrame:
    """Total, and the first titles in order of date and id, of those in question."""
    first = reviews.orderBy("date", "id").limit(most)
    titles = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "id", "title"))), lambda x: x["title"]).alias("titles"))
    return reviews.agg(F.count("*").alias("total")).crossJoin(titles).where("total > 0")


def net_direction(arguments: DataFrame) -> DataFrame:
    """Net sign per target, and a downgrade for two hard contradictions or a negative net."""
    sign = F.when(F.col("side") == "bull", 1).when(F.col("side") == "bear", -1).otherwise(0)
    found = arguments.groupBy("target").agg(F.sum(sign * F.col("weight")).alias("net"), F.count_if(F.col("hard") & (sign < 0)).alias("hard"))
    return found.withColumn("direction", F.signum("net").cast("int")).withColumn("downgrade", (F.col("hard") >= 2) | (F.col("net") < 0))


def within_budget(rows: DataFrame, cost: str, order: str, budget: int, width: int = 10_000) -> DataFrame:
    """Rows, in order of a number, while their running sum stays within the budget; a null cost is 0.

    Each stretch of `width` numbers has its own running sum, to which the sums of the stretches before
    are added, so no task sees more than a stretch, or one row per stretch.
    """
    parts, paid = rows.withColumn("_p", F.floor(F.col(order) / width)), F.coalesce(F.col(cost), F.lit(0))
    sums = parts.groupBy("_p").agg(F.sum(paid).alias("_s"))
    before = sums.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum(paid).over(Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("_own", own).join(before, "_p").withColumn("running", F.col("_own") + F.col("_before")).where(F.col("running") <= budget).drop("_p", "_own", "_before")


def unanimous(rows: DataFrame, by: list[str], value: str, at_least: int = 2) -> DataFrame:
    """Groups whose values all agree."""
    found = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    return found.where((F.col("low") == F.col("high")) & (F.col("n") >= at_least)).select(*by, "n", F.col("low").alias("agreed"))


def cold(targets: DataFrame, reports: DataFrame, below: int = 3) -> DataFrame:
    """Targets with few reports, none included."""
    return targets.join(reports.groupBy("target").agg(F.count("*").alias("n")), "target", "left").fillna({"n": 0}).where(F.col("n") < below)


def insufficient(topics: DataFrame) -> DataFrame:
    """Fewer than three materials and more questions open than answered."""
    return topics.where("materials < 3 and unresolved > resolved")


def lens_agreement(judgements: DataFrame) -> DataFrame:
    """Per event whether lenses converge, diverge or complement each other."""
    found = judgements.groupBy("event").agg(F.count("*").alias("n"), F.countDistinct("direction").alias("directions"), F.count_if(F.col("direction") == "up").alias("up"), F.count_if(F.col("direction") == "down").alias("down"))
    return found.withColumn("pattern", F.when((F.col("directions") == 1) & (F.col("n") >= 2), "converge").when((F.col("up") > 0) & (F.col("down") > 0), "diverge").otherwise("complement"))


def priced(logic: Column, pricing: Column, crowding: Column, rules=PRICING) -> Column:
    """The first rule that fits three levels; 'unclear' where none does."""
    found = F.lit("unclear")
    for *levels, outcome in reversed(rules):
        fits = F.lit(True)
        for column, level in zip((logic, pricing, crowding), levels, strict=True):
            fits = fits if level is None else fits & (column == level)
        found = F.when(fits, F.lit(outcome)).otherwise(found)
    return found


def fragmented(tags: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """Concepts with several spellings: case, spaces and hyphens aside, and synonyms if given."""
    plain = F.regexp_replace(F.lower("tag"), r"[\s_-]+", "")
    rows = tags.select("tag", plain.alias("concept")).distinct()
    if synonyms is not None:
        rows = rows.join(synonyms.select(F.col("word").alias("concept"), "means"), "concept", "left").select("tag", F.coalesce("means", "concept").alias("concept"))
    found = rows.groupBy("concept").agg(F.sort_array(F.collect_set("tag")).alias("spellings"))
    return found.where(F.size("spellings") > 1)


def grouped_index(rows: DataFrame, by: str, item: str) -> DataFrame:
    """Items per group, sorted."""
    return rows.groupBy(by).agg(F.sort_array(F.collect_list(item)).alias("items"))


def coverage(searches: DataFrame, layers: list[str], at_least: int = 2, languages: int = 2) -> DataFrame:
    """Each layer with its terms and languages, those never searched too."""
    wanted = searches.sparkSession.createDataFrame([(x,) for x in layers], "layer string")
    found = searches.groupBy("layer").agg(F.countDistinct("term").alias("terms"), F.countDistinct("language").alias("languages"))
    return wanted.join(found, "layer", "left").fillna(0).withColumn("covered", (F.col("terms") >= at_least) & (F.col("languages") >= languages))


def lens_quality(matches: DataFrame) -> DataFrame:
    """Three to five lenses per event, one of another domain."""
    found = matches.groupBy("event").agg(F.count("*").alias("lenses"), F.count_if("cross").alias("cross"))
    return found.withColumn("good", F.col("lenses").between(3, 5) & (F.col("cross") >= 1))


def conflicts(facts: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Facts on which sources disagree, all values kept."""
    found = facts.groupBy(*by).agg(F.sort_array(F.collect_set(value)).alias("values"))
    return found.withColumn("n_values", F.size("values")).where(F.col("n_values") > 1)


def archive_history(archive: DataFrame) -> DataFrame:
    """Weeks with their first and last day."""
    return archive.groupBy("week").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("n"))


def scenarios(rows: DataFrame) -> DataFrame:
    """Probabilities per report, and whether they make 100."""
    return rows.groupBy("report").agg(F.sum("probability").alias("total")).withColumn("sound", F.abs(F.col("total") - 100) < 1e-9)


def confirmed_actions(signals: DataFrame, needed: dict[str, int] | None = None) -> DataFrame:
    """Adding needs two signals together, reducing any."""
    found = signals.groupBy("target", "action").agg(F.count_if("met").alias("met"))
    least = F.lit(1)
    for action, k in (needed or {"add": 2, "reduce": 1}).items():
        least = F.when(F.col("action") == action, F.lit(k)).otherwise(least)
    return found.withColumn("confirmed", F.col("met") >= least)


def common_lessons(lessons: DataFrame) -> DataFrame:
    """How often each judged lesson occurs."""
    return lessons.groupBy("lesson").agg(F.count("*").alias("n")).where("n > 1")
