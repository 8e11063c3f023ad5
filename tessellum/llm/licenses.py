"""License scans by ordered signature rules, with DataFrame operations alone.

A document's words stand in one string, each with a space of its own on either side, so that an
expression made of whole words needs to look at nothing beside it. The different keywords that a document
holds choose the rules that are tried on it; a rule's matches are found by splitting the text at them, and
a match's place is the number of words before it. Everything happens within a row: nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.llm.common import fresh
from tessellum.llm.license_rules import RULES, SURE, Rule, compiled, keywords

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _rules_by_key(rules: Sequence[Rule]) -> Column:
    """A constant map from each keyword to the rules that it lets in; one literal, which the optimizer folds."""
    by_key: dict[str, list[dict]] = {}
    for n, r in enumerate(rules):
        for key in keywords(r.pattern):
            by_key.setdefault(key, []).append({"pattern": compiled(r.pattern), "rule": n, "level": r.level, "label": r.label, "base": r.base})
    return F.from_json(F.lit(json.dumps(by_key, ensure_ascii=False)), "map<string, array<struct<pattern: string, rule: int, level: int, label: string, base: boolean>>>")


def _count(spaced: Column) -> Column:
    """Words of a piece of a spaced text: half its spaces."""
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("int")


def _spans(text: Column, rule: Column) -> Column:
    """An array of (start, minus end, level, rule, label, base) of a rule's matches, in words; end is the place after the last."""
    hits, pieces = F.regexp_extract_all(text, rule["pattern"], F.lit(0)), F.split(text, rule["pattern"], -1)
    sized = F.zip_with(hits, F.slice(pieces, 1, F.size(hits)), lambda h, p: F.struct(_count(p).alias("gap"), _count(h).alias("length")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,behind:int,level:int,rule:int,label:string,base:boolean>>").alias("spans"))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        span = F.struct(start.alias("start"), (-(start + x["length"])).alias("behind"), rule["level"].alias("level"), rule["rule"].alias("rule"), rule["label"].alias("label"), rule["base"].alias("base"))
        return F.struct((start + x["length"]).alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    return F.aggregate(sized, empty, add, lambda s: s["spans"])


def _kept(spans: Column) -> Column:
    """The labels and the best assurance of spans that no span of the same or a stronger level contains.

    spans are sorted by start, then longest first, then by level and rule, so all that may contain a span
    come before it; for each level it is enough to know how far any span reached.
    """
    begin = F.struct(F.array(*[F.lit(-1)] * len(SURE)).alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))
    sure = F.array(*map(F.lit, SURE))

    def add(state: Column, x: Column) -> Column:
        end, covered = -x["behind"], F.array_max(F.slice(state["ends"], 1, x["level"] + 1)) >= -x["behind"]
        ends = F.transform(state["ends"], lambda e, i: F.when((i == x["level"]) & (end > e), end).otherwise(e))
        labels = F.when(covered, state["labels"]).otherwise(F.array_union(state["labels"], F.array(x["label"])))
        return F.struct(ends.alias("ends"), labels.alias("labels"), F.when(covered, state["score"]).otherwise(F.greatest(state["score"], F.get(sure, x["level"]))).alias("score"))

    return F.aggregate(spans, begin, add)


def detect(docs: DataFrame, *, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """docs with n_words, spans (start, behind, level, rule, label, base) of all matches, labels and score of those that none suppresses.

    Null texts are empty. The new columns take the place of others of their names.
    """
    words, present, spaced, found = fresh(docs, "_words", "_present", "_spaced", "_found")
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER)
    out = docs.withColumn(words, F.array_remove(F.split(text, NO_WORD), ""))
    keys = sorted({k for r in rules for k in keywords(r.pattern)})
    out = out.withColumn("n_words", F.size(words).cast("long")).withColumn(present, F.array_intersect(words, F.array(*map(F.lit, keys))))
    out = out.withColumn(spaced, F.when(F.size(present) > 0, F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" ")))).drop(words)
    by_key = _rules_by_key(rules)
    let_in = F.array_distinct(F.flatten(F.transform(present, lambda k: F.element_at(by_key, k))))
    tried = F.filter(let_in, lambda r: F.rlike(F.col(spaced), r["pattern"]))
    spans = F.when(F.size(present) > 0, F.sort_array(F.flatten(F.transform(tried, lambda r: _spans(F.col(spaced), r)))))
    out = out.withColumn("spans", spans).withColumn(found, _kept(F.coalesce("spans", F.array().cast(_SPANS)))).drop(present, spaced)
    return out.withColumn("labels", F.sort_array(F.col(found)["labels"])).withColumn("score", F.col(found)["score"]).drop(found)


_SPANS = "array<struct<start:int,behind:int,level:int,rule:int,label:string,base:boolean>>"


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per row of docs.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. n_base counts the places of
    the base phrases, first_word and last_word their first and last start (null without any). labels joins the
    base labels and those of the rules; score is the assurance of the strongest detection, 0 without one. A
    null, empty or wordless text has no words, no labels and score 0; null and repeated ids have a row each;
    texts of any length are read whole; an empty table gives no rows, and other columns play no part.
    """
    found = detect(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), rules=rules)
    base = F.filter(F.coalesce("spans", F.array().cast(_SPANS)), lambda s: s["base"])
    found = found.withColumn("base", base).drop("spans", "text")
    of_base = F.array_distinct(F.transform("base", lambda s: s["label"]))
    starts = F.transform("base", lambda s: s["start"].cast("long"))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), F.array_join(F.sort_array(of_base), ",").alias("base_labels"), F.array_join(F.sort_array(F.array_union("labels", of_base)), ",").alias("labels"), "score")
