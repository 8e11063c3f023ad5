"""Scalar column functions (X01-X28). All stay on the JVM; the clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The suffix of a message that was cut, its longest length, and the words that carry no topic.
CUT_SUFFIX, MESSAGE_CAP = "\n\n[消息过长已截断]", 4096
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


#: How halves of a day, near days and every day are said.
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
AFTER_NOON, BEFORE_NOON = r"下午|晚上|\d *p\.?m\b", r"上午|早上|凌晨|\d *a\.?m\b"
NEAR_DAYS = (("明天|\\btomorrow\\b", 1), ("后天|\\bday after tomorrow\\b", 2), ("大后天", 3))
EVERY_DAY = r"每天|\bevery day\b|\bdaily\b"

#: Characters of scripts written without spaces: kana and Han.
UNSEGMENTED = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"


def slug(title: Column, words: int = 4) -> Column:
    """The first words of a title, lower case, without special characters, joined by hyphens."""
    clean = F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))
    return F.array_join(F.slice(F.split(clean, " +"), 1, words), "-")


def slug_any(title: Column) -> Column:
    """Like slug over letters and digits of any script, all words."""
    return F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")


def wiki_links(text: Column) -> Column:
    """Targets of [[target]] and [[target|shown]]."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|]+)")), lambda x: F.trim(x))  # noqa: PLW0108  trim itself would take the place for characters


def markdown_links(text: Column) -> Column:
    """Paths of [shown](path)."""
    return F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(([^)]+)\)"))


def inline_tag(text: Column, key: str) -> Column:
    """The value of `key: value` in back quotes, null without one."""
    return F.nullif(F.regexp_extract(text, f"`{key}: *([^`]*)`", 1), F.lit(""))


def cut(text: Column, cap: int = MESSAGE_CAP, suffix: str = CUT_SUFFIX) -> Column:
    """A text of at most `cap` characters, a fixed suffix telling that it was cut."""
    return F.when(F.length(text) > cap, F.concat(F.substring(text, 1, cap - len(suffix)), F.lit(suffix))).otherwise(text)


def characters(text: Column) -> Column:
    """Length in characters, 0 for null."""
    return F.coalesce(F.length(text), F.lit(0))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; of two empty texts 1."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def url_host(url: Column) -> Column:
    """Host of a URL, null without one."""
    return F.nullif(F.lower(F.regexp_extract(url, "://([^/?#:]+)", 1)), F.lit(""))


def resolve_day(word: Column, as_of: Column) -> Column:
    """Today, tomorrow, yesterday or 'next <weekday>' from a given clock; else null."""
    day = as_of.cast("date")
    found = F.when(word == "today", day).when(word == "tomorrow", F.date_add(day, 1)).when(word == "yesterday", F.date_sub(day, 1))
    for name in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"):
        found = found.when(F.lower(word).startswith(f"next {name.lower()}"), F.next_day(day, name))
    return found


def reminder(said: Column, now: Column) -> Column:
    """(spec, passed) of a time as people say it, from a given clock; null without a time of day.

    spec is 'HH:MM' (each day), 'Ddd HH:MM' (each week) or 'M/D HH:MM' (once). passed tells that a time without a
    day has gone by today, so the user is to be asked. 'next Wednesday' is the first one after today, 下周三 that of the next week.
    """
    text, day = F.lower(said), now.cast("date")
    clock = r"(\d{1,2})(?::(\d{2})| *点 *(?:(\d{1,2}) *分|(半))?| *(?=[ap]\.?m\b))"
    hour, minute = F.nullif(F.regexp_extract(text, clock, 1), F.lit("")).cast("int"), F.coalesce(*(F.nullif(F.regexp_extract(text, clock, i), F.lit("")) for i in (2, 3)))
    minute = F.coalesce(minute.cast("int"), F.when(F.regexp_extract(text, clock, 4) != "", 30).otherwise(0))
    hour = F.when(text.rlike(AFTER_NOON) & (hour < 12), hour + 12).when(text.rlike(BEFORE_NOON) & (hour == 12), 0).otherwise(hour)
    at = F.when((hour < 24) & (minute < 60), F.format_string("%02d:%02d", hour, minute))
    once, weekly = F.lit(None).cast("date"), F.lit(None).cast("string")
    for i, (name, sign) in enumerate(zip(WEEKDAYS, "一二三四五六日", strict=True)):
        sign = f"[{sign}天]" if sign == "日" else sign
        once = F.when(text.rlike(f"下(周|星期){sign}"), F.date_add(week_start(day), 7 + i)).when(text.rlike(rf"\bnext {name.lower()}"), F.next_day(day, name)).otherwise(once)
        weekly = F.when(text.rlike(rf"每(周|星期){sign}|\bevery {name.lower()}"), F.lit(name)).otherwise(weekly)
    for pattern, days in NEAR_DAYS:  # the later pattern is asked first
        once = F.when(text.rlike(pattern), F.date_add(day, days)).otherwise(once)
    daily = text.rlike(EVERY_DAY)
    spec = F.when(daily, at).when(weekly.isNotNull(), F.concat_ws(" ", weekly, at)).when(once.isNotNull(), F.concat_ws(" ", F.date_format(once, "M/d"), at)).otherwise(at)
    passed = ~daily & weekly.isNull() & once.isNull() & (at < F.date_format(now, "HH:mm"))
    return F.when(at.isNotNull(), F.struct(spec.alias("spec"), passed.alias("passed")))


def iso_week(day: Column) -> Column:
    """X11: YYYY-Wnn by the ISO calendar, whose year may differ from the date's."""
    return F.format_string("%d-W%02d", F.extract(F.lit("yearofweek"), day), F.weekofyear(day))


def week_start(day: Column) -> Column:
    """X11: the Monday of a day's week."""
    return F.date_trunc("week", day).cast("date")


def deferred(created: Column, as_of: Column) -> Column:
    """Created before this week's Monday."""
    return created.cast("date") < week_start(as_of)


def age_days(day: Column, as_of: Column) -> Column:
    """X13."""
    return F.datediff(as_of, day)


def age_months(day: Column, as_of: Column) -> Column:
    """X13."""
    return F.floor(F.months_between(as_of, day)).cast("int")


def next_review(day: Column, months: int = 3) -> Column:
    """X14."""
    return F.add_months(day.cast("date"), months)


def epoch(ts: Column) -> Column:
    """X15."""
    return F.unix_timestamp(ts)


def month_of(day: Column) -> Column:
    """YYYY-MM."""
    return F.date_format(day, "yyyy-MM")


def weekday(day: Column) -> Column:
    """Mon to Sun."""
    return F.date_format(day, "E")


def change(new: Column, old: Column) -> Column:
    """Relative change; null where the old value is 0 or null."""
    return new / F.nullif(old, F.lit(0.0)) - 1


def progress_bar(done: Column, total: Column, width: int = 10) -> Column:
    """X19: '####------ 4/10'."""
    full = F.floor(F.coalesce(done / F.nullif(total, F.lit(0)), F.lit(0.0)) * width).cast("int")
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("-"), F.lit(width) - full), F.format_string(" %d/%d", done, total))


def capped(tags: Column, most: int = 5) -> Column:
    """Distinct tags in their order, the first few."""
    return F.slice(F.array_distinct(tags), 1, most)


def overlap(a: Column, b: Column) -> Column:
    """Whether two arrays of tags share one."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def header(fields: Column, key: str) -> Column:
    """A header's value, null where the key is missing."""
    return F.try_element_at(fields, F.lit(key))


#: What a probe answers.
VERDICT = "verdict string, confidence string, old_snapshot string, new_snapshot string, evidence_urls array<string>, needs_deep_research boolean"


def verdict_of(text: Column) -> Column:
    """A probe's JSON; damaged text gives nulls."""
    return F.from_json(text, VERDICT, {"mode": "PERMISSIVE"})


def push_body(chat: Column, text: Column) -> Column:
    """A message's JSON, escaped."""
    return F.to_json(F.struct(chat.alias("chat_id"), cut(text).alias("text")))


def enum_of(value: Column, known: dict[str, str]) -> Column:
    """Spellings to the one name of a value; unknown ones become null."""
    found = F.lit(None).cast("string")
    for spelling, name in known.items():
        found = F.when(F.lower(F.trim(value)) == spelling, F.lit(name)).otherwise(found)
    return found


def report_line(priority: Column, entity: Column, old: Column, new: Column) -> Column:
    """X26."""
    return F.format_string("- [%s] %s: %s -> %s", priority, entity, F.coalesce(old, F.lit("-")), F.coalesce(new, F.lit("-")))


def is_checked(line: Column) -> Column:
    """Whether a task line is ticked; null for other lines."""
    mark = F.regexp_extract(line, r"^\s*- \[([ xX])\]", 1)
    return F.when(mark != "", F.lower(mark) == "x")


def toggled(line: Column) -> Column:
    """The task line with its box turned over."""
    return F.when(is_checked(line), F.regexp_replace(line, r"^(\s*)- \[[xX]\]", "$1- [ ]")).otherwise(F.regexp_replace(line, r"^(\s*)- \[ \]", "$1- [x]"))


def terms(text: Column) -> Column:
    """Words of two letters or more, lower case, without stop words; unsegmented scripts have none here (aggregates.term_posts finds theirs)."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), UNSEGMENTED, " "), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS))
