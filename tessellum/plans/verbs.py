"""Entry verbs of the knowledge base (API surface), the registry of named functions (V03, V09), and judged inputs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.functions.scalar import cut
from tessellum.operators import aggregates, filters, graph, joins, ranking, sinks, windows

#: Functions by name, DataFrame to DataFrame.
REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, function: Callable[..., DataFrame]) -> None:
    """Make a function known by a name at run time."""
    REGISTRY[name] = function


def invoke(name: str, *args, **kwargs) -> DataFrame:
    """V03."""
    return REGISTRY[name](*args, **kwargs)


def register_sql(spark: SparkSession, name: str, function, returns: str) -> None:
    """A scalar function for SQL."""
    spark.udf.register(name, function, returns)


def judged(rows: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Rows with verdicts that a person or a model gave, as an input table; without one, nulls. None is made up."""
    return rows.join(verdicts, key, "left")


def collision(judgements: DataFrame) -> DataFrame:
    """How judgements of one event meet."""
    return aggregates.lens_agreement(judgements)


def ingest(items: DataFrame, cards: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """store / ingest: new items as cards with names and lengths guarded, known ones aside, and the change rows."""
    known = joins.known_urls(items, cards)
    new = items.join(known.select("url").distinct(), "url", "left_anti").withColumn("date", as_of.cast("date"))
    named = sinks.card_keys(new).withColumn("guard", filters.content_guard(F.length("body"), F.lit(False)))
    changes = named.select(as_of.alias("run_ts"), F.lit("P2").alias("priority"), F.lit("add").alias("action"), F.col("name").alias("entity"))
    return {"cards": named, "known": known, "changes": changes}


def ask(areas: dict[str, DataFrame], words: list[str], most: int = 5) -> DataFrame:
    """ask: the best hits of each area; read-only."""
    hits = ranking.search(areas, words, most)
    return hits.withColumn("relevance", ranking.relevance(F.col("score")))


def refresh(previous: DataFrame, current: DataFrame) -> DataFrame:
    """research / refresh: what two reports differ in."""
    return sinks.delta(previous, current)


def todo_view(events: DataFrame) -> DataFrame:
    """todo: items as their events leave them."""
    return sinks.latest_state(events)


def review(decisions: DataFrame, as_of: Column, synonyms: list[str] | None = None) -> DataFrame:
    """review: whole rows that are due, by tag if given."""
    whole, _ = filters.quarantined(decisions)
    return filters.due_by_tag(whole, as_of, synonyms) if synonyms else filters.due(whole, as_of)


def sweep(verdicts: DataFrame, references: DataFrame, holdings: DataFrame, probes: DataFrame) -> dict[str, DataFrame]:
    """sweep: routes, urgent changes, their fan-out, and variables to close."""
    return {"routes": filters.routed(verdicts), "urgent": filters.urgent(verdicts, references, holdings), "fan_out": joins.fan_out(verdicts.where("verdict = 'STATE_CHANGED'"), references), "closing": windows.closing(probes).where("close")}


def learn(docs: DataFrame) -> DataFrame:
    """learn: a plan of four stages, capped."""
    return sinks.learning_plan(windows.stage_capped(ranking.staged(docs)))


def lens(events: DataFrame, lenses: DataFrame, most: int = 5) -> DataFrame:
    """lens: lenses that an event's words call for, the best few; where both tables tell a `domain`, one at least is of another domain than the event's, if any fits."""
    met = joins.matched_lenses(events, lenses)
    if "domain" not in lenses.columns or "domain" not in events.columns:
        return windows.top_per_group(met, "event", F.col("met").desc(), F.col("lens"), most=most)
    met = met.join(lenses.groupBy("lens").agg(F.min("domain").alias("domain")), "lens").join(events.groupBy("event").agg(F.min("domain").alias("own")), "event")
    return ranking.across_domains(met.withColumnRenamed("met", "tier"), most).withColumnRenamed("tier", "met")


def mine(edges: DataFrame, anchors: DataFrame, mechanisms: list[DataFrame]) -> DataFrame:
    """mine: candidates of all mechanisms, the walk along the chain among them."""
    walked = graph.hops(edges, anchors).where("hop > 0").select(F.col("node").cast("string").alias("name"), F.lit("chain").alias("mechanism"), "hop")
    return ranking.merged([walked, *mechanisms])


def write(connections: DataFrame, drafts: DataFrame, most: int = 5) -> DataFrame:
    """write: topics to write about."""
    return ranking.suggestions(connections, drafts, most)


def format_message(text: Column) -> Column:
    """push: the text as it would be sent."""
    return cut(text)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


for _name, _function in (("ask", ask), ("review", review), ("sweep", sweep), ("learn", learn), ("lens", lens), ("mine", mine), ("write", write), ("refresh", refresh), ("todo", todo_view), ("ingest", ingest)):
    register(_name, _function)
