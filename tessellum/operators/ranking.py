"""Search, sorting and top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of a word met in the tags, the title and the body.
TAG, TITLE, BODY = 3, 2, 1
#: Stages of a learning plan by kind of document.
STAGE = {"source": 1, "topic": 2, "report": 2, "connection": 3}


def ranked_candidates(candidates: DataFrame) -> DataFrame:
    """By mechanisms, quantifiability and validity, ties by name."""
    return candidates.orderBy(F.col("mechanisms").desc(), F.col("quantifiable").desc(), F.col("valid").desc(), "name")


def deep_dives(matches: DataFrame, most: int = 2) -> DataFrame:
    """At most two lenses an event, by stars."""
    from tessellum.operators.windows import top_per_group

    return top_per_group(matches, "event", F.col("stars").desc(), F.col("lens"), most=most)


def suggestions(connections: DataFrame, drafts: DataFrame, most: int = 5) -> DataFrame:
    """The newest connections without a draft."""
    return connections.join(drafts.select("path").distinct(), "path", "left_anti").orderBy(F.col("created").desc(), "path").limit(most)


def offered(connections: DataFrame, reports: DataFrame, todos: DataFrame, most: int = 3) -> DataFrame:
    """Topics by source: connections, then reports, then todos."""
    rows = [x.select("topic", F.lit(i).alias("place")) for i, x in enumerate((connections, reports, todos))]
    return reduce(DataFrame.unionByName, rows).groupBy("topic").agg(F.min("place").alias("place")).orderBy("place", "topic").limit(most)


def by_creation(items: DataFrame) -> DataFrame:
    """O05."""
    return items.orderBy("created", "id")


def newest(index: DataFrame, cards: DataFrame, most: int = 5) -> DataFrame:
    """By the index's date, else the card's."""
    rows = cards.join(index.select("path", F.col("date").alias("_i")), "path", "left")
    return rows.withColumn("at", F.coalesce("_i", "date")).drop("_i").orderBy(F.col("at").desc(), "path").limit(most)


def staged(docs: DataFrame, stages: dict[str, int] | None = None) -> DataFrame:
    """The plan's stage of each kind; what is neither read nor linked belongs to the last, own questions."""
    found = F.lit(4)
    for kind, n in (stages or STAGE).items():
        found = F.when(F.col("kind") == kind, F.lit(n)).otherwise(found)
    return docs.withColumn("stage", found)


def best_tags(tags: Column, scores: Column, most: int = 5) -> Column:
    """The tags of the highest scores; scores is a map."""
    pairs = F.transform(F.array_distinct(tags), lambda t: F.struct((-F.coalesce(F.try_element_at(scores, t), F.lit(0.0))).alias("s"), t.alias("t")))
    return F.slice(F.transform(F.array_sort(pairs), lambda x: x["t"]), 1, most)


def search(areas: dict[str, DataFrame], words: list[str], most: int = 5) -> DataFrame:
    """The best hits of each area by weighted words; areas have (path, tags, title, body)."""
    from tessellum.operators.windows import top_per_group

    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (x.withColumn("area", F.lit(name)) for name, x in areas.items()))
    score = F.lit(0)
    for word in words:
        score = score + F.when(F.array_contains("tags", word), TAG).otherwise(0) + F.when(F.lower("title").contains(word), TITLE).otherwise(0) + F.when(F.lower("body").contains(word), BODY).otherwise(0)
    hits = rows.select("area", "path", score.alias("score")).where("score > 0")
    return top_per_group(hits, "area", F.col("score").desc(), F.col("path"), most=most)


def relevance(score: Column) -> Column:
    """High, low or none, by a score."""
    return F.when(score >= TAG, "high").when(score > 0, "low").otherwise("none")


def merged(mechanisms: list[DataFrame]) -> DataFrame:
    """Candidates of all mining mechanisms, merged by name."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), mechanisms)
    return rows.groupBy("name").agg(F.sort_array(F.collect_set("mechanism")).alias("mechanisms"), F.min("hop").alias("hop"))


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """U04, U05."""
    return a.exceptAll(b).distinct()


def shared(a: DataFrame, b: DataFrame) -> DataFrame:
    """U06."""
    return a.intersect(b)


def lacking(required: list[str], present: Column) -> Column:
    """U07."""
    return F.array_except(F.array(*map(F.lit, required)), present)


def across_domains(matches: DataFrame, most: int = 5) -> DataFrame:
    """Each event's best lenses, one at least of another domain than the event's if any fits; matches: (event, lens, tier, domain, own)."""
    best = Window.partitionBy("event").orderBy(F.col("tier").desc(), "lens")
    foreign = ~F.col("domain").eqNullSafe(F.col("own"))
    rows = matches.withColumn("rank", F.row_number().over(best)).withColumn("first_foreign", F.min(F.when(foreign, F.col("rank"))).over(Window.partitionBy("event")))
    enough = F.coalesce(F.col("first_foreign") <= most, F.lit(True))
    return rows.where((F.col("rank") <= F.when(enough, most).otherwise(most - 1)) | (~enough & (F.col("rank") == F.col("first_foreign")))).drop("first_foreign")
