"""Windows over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.functions.scalar import change


def streaks(rows: DataFrame, key: str, order: list[str], value: str, at_least: int = 3) -> DataFrame:
    """Runs of one value in a row, of some length at least, with their first and last place."""
    w, v = Window.partitionBy(key).orderBy(*order), Window.partitionBy(key, value).orderBy(*order)
    runs = rows.withColumn("_run", F.row_number().over(w) - F.row_number().over(v))
    found = runs.groupBy(key, value, "_run").agg(F.count("*").alias("length"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))
    return found.where(F.col("length") >= at_least).drop("_run")


def closing(probes: DataFrame, needed: int = 3) -> DataFrame:
    """Staging of variables: the count of LIKELY_DEAD in a row; a failed probe (null) leaves it, any other verdict resets it."""
    w = Window.partitionBy("variable").orderBy("run_ts")
    known = probes.where("verdict is not null").withColumn("alive", F.sum(F.when(F.col("verdict") != "LIKELY_DEAD", 1).otherwise(0)).over(w))
    dead = known.where("verdict = 'LIKELY_DEAD'").withColumn("n", F.row_number().over(Window.partitionBy("variable", "alive").orderBy("run_ts")))
    return dead.select("variable", "run_ts", F.col("n").alias("consecutive"), (F.col("n") >= needed).alias("close"))


def state_changes(states: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Rows whose state differs from the one before."""
    return states.withColumn("previous", F.lag(state).over(Window.partitionBy(key).orderBy(*order))).where(F.col("previous").isNotNull() & (F.col("previous") != F.col(state)))


def with_previous(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The value before, and the change in per cent."""
    rows = rows.withColumn("previous", F.lag(value).over(Window.partitionBy(key).orderBy(*order)))
    return rows.withColumn("percent", 100 * change(F.col(value), F.col("previous")))


def range_52_weeks(prices: DataFrame, key: str, day: str = "day", value: str = "value") -> DataFrame:
    """High and low of the 52 weeks up to a day, the place between, the drawdown and its band."""
    w = Window.partitionBy(key).orderBy(F.unix_date(F.col(day))).rangeBetween(-363, 0)
    rows = prices.withColumn("high", F.max(value).over(w)).withColumn("low", F.min(value).over(w))
    rows = rows.withColumn("place", (F.col(value) - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))).withColumn("drawdown", 100 * (F.col(value) / F.col("high") - 1))
    return rows.withColumn("band", F.when(F.col("drawdown") <= -50, "collapse").when(F.col("drawdown") <= -20, "bear").when(F.col("drawdown") <= -10, "correction").otherwise("normal"))


def moving_average(prices: DataFrame, key: str, day: str = "day", value: str = "value", rows: int = 200) -> DataFrame:
    """Mean of the last rows once there are so many, the deviation from it in per cent, and a flag."""
    w = Window.partitionBy(key).orderBy(day).rowsBetween(1 - rows, 0)
    out = prices.withColumn("mean", F.when(F.count("*").over(w) == rows, F.avg(value).over(w)))
    out = out.withColumn("deviation", 100 * (F.col(value) / F.col("mean") - 1))
    return out.withColumn("flag", F.when(F.col("deviation") > 20, "stretched").when(F.col("deviation") < -15, "broken"))


def rsi(prices: DataFrame, key: str, day: str = "day", value: str = "value", rows: int = 14) -> DataFrame:
    """Relative strength by simple means of gains and losses, once there are enough."""
    w = Window.partitionBy(key).orderBy(day)
    moved = prices.withColumn("_d", F.col(value) - F.lag(value).over(w))
    last = w.rowsBetween(1 - rows, 0)
    gain, loss = F.avg(F.greatest("_d", F.lit(0.0))).over(last), F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).over(last)
    out = moved.withColumn("_n", F.count("_d").over(last)).withColumn("_g", gain).withColumn("_l", loss)
    index = F.when(F.col("_l") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_g") / F.nullif(F.col("_l"), F.lit(0.0))))
    out = out.withColumn("rsi", F.when(F.col("_n") == rows, index)).drop("_d", "_n", "_g", "_l")
    return out.withColumn("zone", F.when(F.col("rsi") > 70, "overbought").when(F.col("rsi") < 30, "oversold").when(F.col("rsi").between(40, 60), "neutral"))


def top_per_group(rows: DataFrame, by: str, *order: Column, most: int = 5) -> DataFrame:
    """The first few of each group, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= most)


def first_open(items: DataFrame) -> DataFrame:
    """The first unfinished step of each plan; an aggregate, so no sort."""
    return items.where("not done").groupBy("plan").agg(F.min_by("title", F.struct("stage", "ord")).alias("title"), F.min(F.struct("stage", "ord")).alias("at")).select("plan", "title", "at.stage", "at.ord")


def assigned_ids(new: DataFrame, known: DataFrame, by: str, order: str) -> DataFrame:
    """Ids that go on after the greatest of each group."""
    greatest = known.groupBy(by).agg(F.max("id").alias("_max"))
    numbered = new.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    return numbered.join(greatest, by, "left").withColumn("new_id", F.coalesce("_max", F.lit(0)) + F.col("_n")).drop("_n", "_max")


def stage_capped(items: DataFrame, per_stage: int = 5, total: int = 20) -> DataFrame:
    """At most so many items a stage, and in all, in order."""
    first = items.withColumn("_s", F.row_number().over(Window.partitionBy("plan", "stage").orderBy("ord"))).where(F.col("_s") <= per_stage).drop("_s")
    return first.withColumn("_t", F.row_number().over(Window.partitionBy("plan").orderBy("stage", "ord"))).where(F.col("_t") <= total).drop("_t")


def seen_again(sightings: DataFrame, days: int = 14) -> DataFrame:
    """Candidates seen a second time within some days, and since when they are known."""
    w = Window.partitionBy("candidate").orderBy("seen_at")
    rows = sightings.withColumn("next", F.lead("seen_at").over(w))
    return rows.groupBy("candidate").agg(F.min("seen_at").alias("first_seen"), F.coalesce(F.max(F.datediff("next", "seen_at") <= days), F.lit(False)).alias("again"))


def retained(snapshots: DataFrame, day: str = "day", daily: int = 14, weekly: int = 8, monthly: int = 6) -> DataFrame:
    """Snapshots to keep: the last of each of the latest days, weeks and months.

    Days are first made distinct, so the windows see one row per day that has a snapshot.
    """
    days = snapshots.select(F.col(day).alias("d")).distinct()
    keep = days.orderBy(F.col("d").desc()).limit(daily)
    for unit, most in (("week", weekly), ("month", monthly)):
        keep = keep.unionByName(days.groupBy(F.date_trunc(unit, "d").alias("u")).agg(F.max("d").alias("d")).orderBy(F.col("u").desc()).limit(most).select("d"))
    return snapshots.join(keep.select(F.col("d").alias(day)).distinct(), day, "left_semi")


def quarterly_change(holdings: DataFrame) -> DataFrame:
    """Change of an institution's holding by quarter."""
    w = Window.partitionBy("target").orderBy("quarter")
    return holdings.withColumn("moved", F.col("shares") - F.lag("shares").over(w))


def insider_net(trades: DataFrame, as_of: Column, months: int = 6) -> DataFrame:
    """Net insider shares of the last months."""
    late = trades.where((F.col("day") > F.add_months(as_of, -months)) & (F.col("day") <= as_of))
    return late.groupBy("target").agg(F.sum(F.when(F.col("side") == "buy", F.col("shares")).otherwise(-F.col("shares"))).alias("net"))


def rotation(holdings: DataFrame, week: int) -> DataFrame:
    """The holding whose turn a week is; holdings are a short list."""
    ranked = holdings.withColumn("rank", F.row_number().over(Window.orderBy("target"))).crossJoin(F.broadcast(holdings.agg(F.count("*").alias("n"))))
    return ranked.where(F.pmod(F.lit(week), F.col("n")) == F.col("rank") - 1).select("target")


def turns(targets: DataFrame, as_of: Column, week: int) -> DataFrame:
    """What is to be studied again: on Mondays the holding whose turn the week is, watched targets on a quarter's and sectors on a half-year's first day; targets: (kind, target)."""
    first, month = F.dayofmonth(as_of) == 1, F.month(as_of)
    held = rotation(targets.where("kind = 'holding'").select("target"), week).where(F.dayofweek(as_of) == 2).select(F.lit("holding").alias("kind"), "target")
    due = ((F.col("kind") == "watching") & first & month.isin(1, 4, 7, 10)) | ((F.col("kind") == "sector") & first & month.isin(1, 7))
    return held.unionByName(targets.where(due).select("kind", "target"))


def unsent(reminders: DataFrame, ledger: DataFrame) -> DataFrame:
    """Reminders that were not pushed before."""
    return reminders.join(ledger.select("reminder").distinct(), "reminder", "left_anti")


def recent_topics(events: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Events of the last two weeks, the newest first, rank by topic."""
    late = events.where(F.datediff(as_of, "day").between(0, days))
    return late.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.col("day").desc(), "id")))
