"""Filters, guards and routing (F01-F38). Rules are data; the clock is an argument; judgements arrive as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.functions.scalar import change, slug_any, url_host, weekday

#: Verdict and confidence to route, fixed values.
ROUTES = (("NO_CHANGE", None, "skip"), ("STATE_CHANGED", "high", "deep_first"), ("STATE_CHANGED", "medium", "deep"), ("STATE_CHANGED", "low", "deep"), ("EVIDENCE_CONFLICT", None, "deep_disputed"), ("LIKELY_DEAD", None, "staging"))
#: Days that data of a kind stays fresh.
FRESH_DAYS = {"macro": 31, "company": 92}
#: F16: indicator, comparison, limit, flag, fixed values; a close below the 200-day mean is a deviation below 0. How near to the ends of the 52-week range is near is ours.
RED_FLAGS = (
    ("position_52w", ">=", 0.95, "near_high"), ("position_52w", "<=", 0.05, "near_low"), ("deviation_200d", "<", 0.0, "below_mean"), ("drawdown", "<=", -10.0, "correction"),
    ("drawdown", "<=", -20.0, "bear"), ("drawdown", "<=", -50.0, "collapse"), ("rsi14", ">", 70.0, "overbought"), ("rsi14", "<", 30.0, "oversold"), ("deviation_200d", ">", 20.0, "stretched"),
    ("deviation_200d", "<", -15.0, "stretched_down"), ("institution_change", "<", -10.0, "institutions_leave"), ("insider_net_6m", "<", 0.0, "insiders_sell"), ("short_interest", ">", 10.0, "shorted"), ("short_interest", ">", 20.0, "heavily_shorted"),
)
#: Fixed values: openings and closing words that a draft does not have, words of fear, and dates that say no day.
OPENINGS, CLOSINGS, FEAR, UNDATED = ("我们来聊聊", "今天想和大家分享"), ("总结一下", "总的来说"), ("崩盘", "灾难", "赶紧跑"), ("最近", "日前")


def due(decisions: DataFrame, as_of: Column) -> DataFrame:
    """Open and to be reviewed by now."""
    return decisions.where((F.col("status") == "open") & (F.col("review_date") <= as_of))


def due_by_tag(decisions: DataFrame, as_of: Column, synonyms: list[str]) -> DataFrame:
    """due rows with one of the tags; if there are none, all due rows."""
    rows = due(decisions, as_of).withColumn("hit", F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, synonyms))), F.lit(False)))
    some = rows.agg(F.max("hit").alias("some"))  # one row
    return rows.crossJoin(F.broadcast(some)).where(F.col("hit") | ~F.col("some")).drop("hit", "some")


def quarantined(decisions: DataFrame, required: tuple[str, ...] = ("status", "review_date")) -> tuple[DataFrame, DataFrame]:
    """(whole rows, rows that lack a required header, with the names of what they lack)."""
    lacking = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in required)))
    rows = decisions.withColumn("lacking", lacking)
    return rows.where(F.size("lacking") == 0).drop("lacking"), rows.where(F.size("lacking") > 0)


def active(followups: DataFrame) -> DataFrame:
    """F04."""
    return followups.where("status = 'active'")


def recency_flag(records: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """one row, whether the newest record is older than some days (or there is none)."""
    return records.agg(F.max("date").alias("newest")).withColumn("stale", F.coalesce(F.datediff(as_of, "newest") > days, F.lit(True)))


def staleness(data: DataFrame, as_of: Column, windows: dict[str, int] | None = None) -> DataFrame:
    """age in days and a mark beyond the window of the row's kind; unknown kinds have none."""
    limit = F.lit(None).cast("int")
    for kind, days in (windows or FRESH_DAYS).items():
        limit = F.when(F.col("kind") == kind, F.lit(days)).otherwise(limit)
    return data.withColumn("age", F.datediff(as_of, "data_as_of")).withColumn("stale", F.col("age") > limit)


def content_guard(length: Column, strict_host: Column) -> Column:
    """under 100 characters confirm, under 500 suspicious (for a strict host), over 10000 long form."""
    return F.when(length < 100, "confirm").when((length < 500) & strict_host, "suspicious").when(length > 10000, "long").otherwise("normal")


def of_host(url: Column, host: str) -> Column:
    """the URL's host is this or below it."""
    return (url_host(url) == host) | url_host(url).endswith(f".{host}")


def checkable(target: Column) -> Column:
    """links into the raw area are not checked."""
    return ~target.startswith("raw/")


def reminder_due(spec: Column, now: Column) -> Column:
    """daily 'HH:MM', weekly 'Ddd HH:MM' or one-off 'M/D HH:MM'; null for another form."""
    at = F.date_format(now, "HH:mm")
    return F.when(spec.rlike(r"^\d{2}:\d{2}$"), spec == at).when(spec.rlike(r"^[A-Z][a-z]{2} \d{2}:\d{2}$"), spec == F.concat(weekday(now), F.lit(" "), at)).when(spec.rlike(r"^\d{1,2}/\d{1,2} \d{2}:\d{2}$"), spec == F.date_format(now, "M/d HH:mm"))


def alarms_left(alarms: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(alarms that fire, alarms that remain): a one-off goes when it has fired."""
    rings = F.coalesce(reminder_due(F.col("remind"), now), F.lit(False))
    return alarms.where(rings), alarms.where(~(rings & F.col("remind").contains("/")))


def sweep_mode(trigger: Column, target: Column) -> Column:
    """F12."""
    return F.when(trigger == "cron", "B").when(target.isNotNull(), "C").otherwise("A")


def research_mode(requests: DataFrame, reports: DataFrame, followups: DataFrame) -> DataFrame:
    """Restart, resume, refresh, or new, by what exists under the topic's slug."""
    rows = requests.withColumn("slug", slug_any(F.col("topic")))
    rows = rows.join(reports.select("slug", F.col("status").alias("had")).dropDuplicates(["slug"]), "slug", "left").join(followups.select("slug").distinct().withColumn("tracked", F.lit(True)), "slug", "left")
    mode = F.when(F.lower("text").contains("restart"), "restart").when(F.col("had") == "in_progress", "resume").when(F.col("had").isNotNull() | F.col("tracked"), "refresh").otherwise("new")
    return rows.withColumn("mode", mode).drop("had", "tracked")


def routed(verdicts: DataFrame, routes=ROUTES) -> DataFrame:
    """route of a verdict and confidence; a rule without a confidence takes any."""
    found = F.lit("unrouted")
    for verdict, confidence, route in reversed(routes):
        fits = F.col("verdict") == verdict
        found = F.when(fits if confidence is None else fits & (F.col("confidence") == confidence), F.lit(route)).otherwise(found)
    return verdicts.withColumn("route", found)


def urgent(verdicts: DataFrame, references: DataFrame, holdings: DataFrame) -> DataFrame:
    """High-confidence changes of variables that a held target refers to."""
    held = references.join(holdings.select("target").distinct(), "target", "left_semi").select("variable_id")
    return verdicts.where("verdict = 'STATE_CHANGED' and confidence = 'high'").join(held, "variable_id", "left_semi")


def red_flags(indicators: DataFrame, flags=RED_FLAGS) -> DataFrame:
    """F16: one row per indicator beyond its limit."""
    each = [F.when(F.expr(f"`{name}` {op} {limit!r}D"), F.struct(F.lit(flag).alias("flag"), F.col(name).cast("double").alias("value"))) for name, op, limit, flag in flags if name in indicators.columns]
    return indicators.select("target", F.explode(F.array_compact(F.array(*each))).alias("f")).select("target", "f.*")


def significant(new: Column, old: Column, share: float = 0.2) -> Column:
    """more than a fifth away, or of another sign."""
    return (F.abs(change(new, old)) > share) | (F.signum(new) != F.signum(old))


def evidence_gate(evidence: DataFrame) -> DataFrame:
    """judgements with two items, one of high credibility, all dated."""
    found = evidence.groupBy("judgement").agg(F.count("*").alias("items"), F.count_if(F.col("credibility") == "high").alias("high"), F.count_if(F.col("date").isNull()).alias("undated"))
    return found.withColumn("passed", (F.col("items") >= 2) & (F.col("high") >= 1) & (F.col("undated") == 0))


def stopped(candidates: DataFrame, known: DataFrame, as_of: Column, days: int = 14, warn_hops: int = 5, most_hops: int = 10) -> DataFrame:
    """The reason why a candidate goes no further, null if none: the first that holds; and whether its hops are worth a warning.

    Isolated: two weeks after it was first seen there are neither two sources nor an authoritative one and one of the community.
    """
    alone = (F.col("sources") < 2) & ~((F.col("authoritative") >= 1) & (F.col("community") >= 1)) & (F.datediff(as_of, "first_seen") >= days)
    rows = candidates.join(known.select(F.lower("name").alias("known")).distinct(), F.lower("name") == F.col("known"), "left")
    reason = F.when(~F.col("quantifiable"), "unquantifiable").when(alone, "isolated").when(F.col("known").isNotNull(), "covered").when(F.col("hop") > most_hops, "too_far")
    return rows.withColumn("stop", reason).withColumn("warned", F.col("hop") > warn_hops).drop("known")


def promoted(candidates: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """enough sources, quantifiable, not covered, seen for two weeks (events at once)."""
    old = (F.col("lifecycle") == "event") | (F.datediff(as_of, "first_seen") >= days)
    strong = (F.col("sources") >= 2) | ((F.col("authoritative") >= 1) & (F.col("community") >= 1))
    return candidates.where(strong & F.col("quantifiable") & ~F.col("covered") & old)


def topic_wanted(flags: Column, related: Column, at_least: int = 3) -> Column:
    """any judged criterion with two related cards, or enough of them without."""
    return (F.exists(flags, lambda x: x) & (related >= 2)) | (related >= at_least)


def distillable(kind: Column, confirmed: Column) -> Column:
    """F22."""
    return (kind == "book") & confirmed


def violations(reports: DataFrame, fields: list[str], required: list[str], directions: tuple[str, ...] = ("bullish", "bearish", "neutral")) -> DataFrame:
    """One row per lacking header, lacking or foreign section, or direction out of the enum."""
    named = lambda kind, items: F.transform(items, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("what")))
    wanted = F.array(*map(F.lit, required))
    lacking = F.array_compact(F.array(*(F.when(F.try_element_at("fields", F.lit(c)).isNull(), F.lit(c)) for c in fields)))
    direction = F.when(F.coalesce(~F.try_element_at("fields", F.lit("direction")).isin(*directions), F.lit(False)), F.array(F.try_element_at("fields", F.lit("direction")))).otherwise(F.array().cast("array<string>"))
    found = F.concat(named("header", lacking), named("section_missing", F.array_except(wanted, "sections")), named("section_foreign", F.array_except("sections", wanted)), named("direction", direction))
    return reports.select("slug", F.explode(found).alias("v")).select("slug", "v.*")


def output_type(verdict: Column, names_holding: Column) -> Column:
    """the judged type, else a decision where a holding is named."""
    return F.coalesce(verdict, F.when(names_holding, "decision").otherwise("knowledge"))


def lens_tier(signals: Column, words: Column, domain: Column, own: Column) -> Column:
    """3 all signals met, 2 some, 1 the domain alone, 0 none."""
    met = F.size(F.array_intersect(signals, words))
    return F.when((met > 0) & (met == F.size(signals)), 3).when(met > 0, 2).when(domain == own, 1).otherwise(0)


def sound_edges(edges: DataFrame) -> DataFrame:
    """F26."""
    return edges.where("mechanism is not null and dst is not null and trap_source is not null")


def push_guard(text: Column, cap: int = 4096) -> Column:
    """empty is rejected, up to 50 characters need no confirmation, above the cap it is cut."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(n == 0, "reject").when(F.length(text) > cap, "truncate").when(n <= 50, "send").otherwise("confirm")


def still_valid(lifecycle: Column, snapshot: Column, current: Column, triggered: Column, months_ahead: Column) -> Column:
    """whether a state still holds, whatever its age: structural and cyclical ones while unchanged, seasonal
    ones also only from two months ahead of their season, events until they are triggered, pulses never."""
    same = snapshot.eqNullSafe(current)
    return F.when(lifecycle == "pulse", False).when(lifecycle == "event", ~triggered).when(lifecycle == "seasonal", same & months_ahead.between(0, 2)).otherwise(same)


def todo_class(text: Column, keywords: dict[str, list[str]]) -> Column:
    """the first class one of whose words the text has, else 'ask'."""
    found = F.lit("ask")
    for name, words in reversed(list(keywords.items())):
        fits = F.lit(False)
        for w in words:
            fits = fits | F.lower(text).contains(w)
        found = F.when(fits, F.lit(name)).otherwise(found)
    return found


def damage(headings: Column, required: list[str]) -> Column:
    """all headings there: intact; some: repairable; none: rebuild."""
    n = F.size(F.array_intersect(headings, F.array(*map(F.lit, required))))
    return F.when(n == len(required), "intact").when(n > 0, "repairable").otherwise("rebuild")


def intents(utterances: DataFrame, rules: list[tuple[str, str, int]]) -> DataFrame:
    """operation by the keyword rule of highest priority, and how many operations fit; rules: (keyword, operation, priority)."""
    hits = F.array_compact(F.array(*(F.when(F.lower("text").contains(k), F.struct(F.lit(-p).alias("p"), F.lit(op).alias("operation"))) for k, op, p in rules)))
    rows = utterances.withColumn("hits", F.array_sort(hits))
    return rows.withColumn("operation", F.try_element_at("hits", F.lit(1))["operation"]).withColumn("fitting", F.size(F.array_distinct(F.transform("hits", lambda x: x["operation"])))).drop("hits")


def position_conforms(status: Column, counter: Column, pricing: Column) -> Column:
    """'buy' needs both checks."""
    return (status != "buy") | (counter & pricing)


def selection(matches: Column) -> Column:
    """F34."""
    return F.when(matches == 1, "act").when(matches > 1, "list_matches").otherwise("list_all")


def allowed_changes(changes: DataFrame, protected: tuple[str, ...] = ("raw/", "context/")) -> DataFrame:
    """changes with a verdict: nothing is deleted, and protected areas are not touched."""
    touched = F.lit(False)
    for prefix in protected:
        touched = touched | F.col("path").startswith(prefix)
    return changes.withColumn("rejected", touched | (F.col("action") == "delete"))


def actionable(conclusions: DataFrame, evidence: DataFrame) -> DataFrame:
    """conclusions without a verifiable data point are to be quantified."""
    points = evidence.where("verifiable").groupBy("conclusion").agg(F.count("*").alias("points"))
    return conclusions.join(points, "conclusion", "left").withColumn("status", F.when(F.col("points") >= 1, "actionable").otherwise("to_be_quantified")).fillna({"points": 0})


def draft_conforms(drafts: DataFrame, banned: list[str], openings=OPENINGS, closings=CLOSINGS, fear=FEAR, undated=UNDATED) -> DataFrame:
    """300 to 600 characters, no banned wording or words of fear, no event without a date, sources given; no polite opening, and no summing up in the last paragraph."""
    clean, last = F.lit(True), F.element_at(F.split(F.rtrim(F.lower("text")), "\n"), -1)
    for word in (*banned, *fear, *undated):
        clean = clean & ~F.lower("text").contains(word)
    for word in openings:
        clean = clean & ~F.ltrim(F.lower("text")).startswith(word)
    for word in closings:
        clean = clean & ~last.contains(word)
    return drafts.withColumn("conforms", F.length("text").between(300, 600) & clean & (F.size("sources") > 0))
