"""Joins (J01-J35). Strategies are left to the optimizer and adaptive execution; fuzzy ones meet by equal pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.operators.graph import SHARES, TASKS, bunched, dealt, stored
from tessellum.operators.similar import near, nearest
from tessellum.operators.text import occurrences


#: How many rows of (member, item) are a task's at most, and how many holders of an item are looked through one by one.
ITEMS, FEW_HOLDERS = 1 << 15, 16
#: Ranges of members that pairs by shared items are split into at most.
BUNCHES = 64
#: Pairs by shared items: how many members make an item hot, how many meetings are a block's (pairs that one task holds), the fewest blocks, and how many rows or pairs a task makes at once.
HOT, MEETINGS, LEAST_BLOCKS, HELD = 256, 1 << 22, 8, 1 << 20


def known_urls(items: DataFrame, cards: DataFrame) -> DataFrame:
    """Items whose normalised URL a card has as its origin."""
    plain = lambda c: F.regexp_replace(F.lower(F.regexp_replace(c, r"[?#].*$", "")), "/$", "")
    return items.join(cards.select(plain(F.col("origin")).alias("_o")).distinct(), plain(F.col("url")) == F.col("_o"), "left_semi")


def near_titles(cards: DataFrame, *, block: str, most_edits: int = 5, least_length: int = 20) -> DataFrame:
    """(block, t1, t2, i1, i2): pairs of titles of a block at most `most_edits` apart, with the least id of each.

    Rows of one title are one; titles meet by an equal piece (similar.met), never all with all.
    """
    titles = cards.where(F.length("title") >= least_length).groupBy(block, "title").agg(F.min("id").alias("i"))
    found = near(titles.select(F.col(block).alias("b"), F.col("title").alias("t"), "i"), most_edits)
    return found.select(F.col("b").alias(block), "t1", "t2", "i1", "i2")


def unlinked(cards: DataFrame, topics: DataFrame, links: DataFrame) -> DataFrame:
    """Cards that have a topic's tag and no link to it."""
    tagged = cards.select("card", F.explode("tags").alias("tag")).distinct().join(topics.select("topic", "tag"), "tag")
    return tagged.join(links, ["card", "topic"], "left_anti")


def broken_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """Links whose target is no file."""
    return links.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_anti")


def repairs(broken: DataFrame, files: DataFrame, at_least: float = 0.7) -> DataFrame:
    """(target, repair, score): for each broken target the most similar file, of equal ones the last by name; both null, to unlink, where none is at_least as similar."""
    found = nearest(broken, files, at_least).withColumnsRenamed({"target": "t", "path": "repair"})
    targets = broken.select("target").where("target is not null").distinct()
    return targets.join(found, F.col("target") == F.col("t"), "left").select("target", "repair", "score")


def missing(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known; a null key is never known."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


def sibling_gap(has: DataFrame, groups: DataFrame) -> DataFrame:
    """(member, item) that peers of a member's group have and it lacks; has: (member, item), groups: (member, grp).

    An item's holders in a group meet the bunches of its members and are left out there, so what members lack, which is
    most of all pairs, comes out of the join and is never shuffled. A bunch meets all items of its share before the next
    one does, so rows come out as runs of an item over the same members again and again; with few enough items in a task
    for a file's dictionary, that is about a tenth of a byte a row. A null item is had for sure by none, a null member has none.
    """
    kind = has.schema["member"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")
    held = has.join(groups, "member").groupBy("grp", "item").agg(F.when(F.col("item").isNotNull(), F.collect_set("member")).otherwise(none).alias("holders"))
    bunches = bunched(groups.select("grp", "member").where("grp is not null").distinct(), "grp", "member")
    tasks = max(TASKS, -(-has.count() // ITEMS))
    largest, all_ = (n or 1 for n in bunches.groupBy("grp").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first())
    shares = max(SHARES, 2 * tasks * largest // all_)  # what is held again for each bunch is about half a task's items
    met = dealt(held, bunches, ["grp"], shares, tasks, again=True)
    few = F.size("holders") <= FEW_HOLDERS  # is looked through for each member, more are taken out at once
    lacking = F.when(few, F.col("values")).otherwise(F.array_except("values", "holders"))
    rows = met.select("item", F.when(few, F.col("holders")).otherwise(none).alias("holders"), F.explode(F.when(F.col("unknown"), F.concat(lacking, F.array(F.lit(None)))).otherwise(lacking)).alias("member"))
    return rows.where(~F.coalesce(F.array_contains("holders", F.col("member")), F.lit(False))).select("member", "item")


def fan_out(changes: DataFrame, references: DataFrame, key: str = "variable_id") -> DataFrame:
    """One row per change and reference to what changed."""
    return changes.join(references, key)


def mentions(articles: DataFrame, followups: DataFrame) -> DataFrame:
    """Articles that share a tag with an active follow-up or name its metric, in one word or several, of any script (text.occurrences)."""
    live = stored(followups.where("status = 'active'"))  # few, which Spark can't tell of rows that a driver made
    by_tag = articles.select("article", F.explode("tags").alias("k")).join(live.select("followup", F.explode("tags").alias("k")), "k")
    named = occurrences(articles, live, id_col="article", name_col="metric")
    by_name = named.join(live.select("followup", F.col("metric").alias("name")), "name").select(F.col("id").alias("article"), "followup")
    return by_tag.select("article", "followup").unionByName(by_name).distinct()


def audit(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Each key with how often it is on either side, and a verdict: ok means once on both."""
    a = left.groupBy(key).agg(F.count("*").alias("n_left"))
    b = right.groupBy(key).agg(F.count("*").alias("n_right"))
    both = a.join(b, key, "full").fillna({"n_left": 0, "n_right": 0})
    return both.withColumn("verdict", F.when(F.col("n_left") == 0, "right_only").when(F.col("n_right") == 0, "left_only").when((F.col("n_left") == 1) & (F.col("n_right") == 1), "ok").otherwise("repeated"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, own, others) of each item's members in each block: `others` are they, `own` of them, and the members that come after, ascending; of (item, m, block), all rows of an item together."""
    rows = pa.Table.from_batches(found) if (found := list(batches)) else None
    if rows is None or not rows.num_rows:
        return
    item = rows["item"].combine_chunks().dictionary_encode()
    item = (item.combine_chunks() if isinstance(item, pa.ChunkedArray) else item).indices.to_numpy()
    order = np.lexsort((rows["m"].to_numpy(), item))
    item, m, block = item[order], rows["m"].to_numpy()[order], rows["block"].to_numpy()[order]
    first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
    start = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (block[1:] != block[:-1])])
    own = np.diff(np.r_[start, len(m)])
    size = np.r_[first[1:], len(m)][np.searchsorted(first, start, "right") - 1] - start
    start, own, size = (x[size > 1] for x in (start, own, size))
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // HELD)) + 1
    for one in np.split(np.arange(len(start)), cuts):
        ends = np.cumsum(size[one])
        others = m[_places(start[one], size[one])]
        yield pa.record_batch([pa.array(block[start[one]]), pa.array(own[one]), pa.LargeListArray.from_arrays(pa.array(np.r_[0, ends]), pa.array(others)).cast(pa.list_(pa.int64()))], ["block", "own", "others"])


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def _counts(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each different key and how often it is there, or the sum of its n."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.diff(np.r_[first, len(keys)]) if n is None else np.add.reduceat(n, first)


def _counted(batches: Iterator[pa.RecordBatch], members: int, at_least: int) -> Iterator[pa.RecordBatch]:
    """(a, b, n): pairs a < b that meet n >= at_least times in rows of _runs(); a row whose `own` is 0 holds a pair that is left out."""
    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    known, held, waiting = [], [], 0

    def fold():
        more = _counts(np.concatenate(held))
        return _counts(np.concatenate([keys, more[0]]), np.concatenate([n, more[1]])) if len(keys) else more

    for batch in batches:
        own, others = batch["own"].to_numpy(), batch["others"]
        at, m = others.offsets.to_numpy(), others.values.to_numpy()
        known.append(m[at[:-1][own == 0]] * members + m[at[1:][own == 0] - 1])
        place = _places(at[:-1], own)
        size = np.repeat(at[1:], own) - place - 1
        for one in np.split(np.arange(len(place)), np.flatnonzero(np.diff(np.cumsum(size) // HELD)) + 1):
            held.append(np.repeat(m[place[one]] * members, size[one]) + m[_places(place[one] + 1, size[one])])
            waiting += len(held[-1])
            if waiting > 2 * HELD:
                keys, n = fold()
                held, waiting = [], 0
    if waiting:
        keys, n = fold()
    stay = n >= at_least
    keys, n = keys[stay], n[stay]
    if known and len(known := np.concatenate(known)):
        stay = ~np.isin(keys, known)
        keys, n = keys[stay], n[stay]
    for at in range(0, len(keys), 1 << 16):
        one = keys[at : at + (1 << 16)]
        yield pa.record_batch([pa.array(one // members), pa.array(one % members), pa.array(n[at : at + (1 << 16)])], ["a", "b", "n"])


def cross_pairs(membership: DataFrame, edges: DataFrame | None = None, at_least: int = 2) -> DataFrame:
    """(i, j, shared): pairs i < j that share at_least items and are no edge yet; membership: (member, item).

    Members that share c items share one outside the c - 1 items of each that most members have, so of items that
    more than HOT have, a member meets others by those outside alone: an item that all have makes no pairs. What is
    shared besides is added to the pairs that met.

    Members are numbered in order, up to three billion, and cut into blocks of about MEETINGS meetings. An item's members
    of one block and those after them go, as one row, to the task that counts the block's pairs as sorted numbers, so
    pairs are made where they are counted and never shuffled.
    """
    rows = stored(membership.select("member", "item").where("member is not null and item is not null").distinct())
    often = stored(rows.groupBy(F.col("item").alias("o")).agg(F.count("*").alias("n")))
    place = F.row_number().over(Window.partitionBy("member").orderBy(F.desc("n"), F.desc("item")))
    hot = stored(rows.join(often.where(F.col("n") > HOT), F.col("item") == F.col("o")).select("member", "item", (place < at_least).alias("common")))
    common = hot.where("common").select("member", "item")
    left = common.groupBy("member").agg(F.collect_set("item").alias("left"))
    mixed = stored(hot.where("not common").join(common.select(F.col("item").alias("o")).distinct(), F.col("item") == F.col("o"), "left_semi").select("member", "item"))
    some = not mixed.isEmpty()  # items by which some meet and others do not
    total, meetings = (x or 0 for x in often.agg(F.sum("n"), F.sum(F.col("n") * F.least("n", F.lit(HOT)))).first())
    blocks = max(LEAST_BLOCKS, meetings // MEETINGS)
    ranged = rows.groupBy("member").agg(F.count("*").alias("n")).join(left, "member", "left").repartitionByRange(min(blocks, BUNCHES), "member")
    ranged = stored(ranged.select("member", "n", F.coalesce("left", F.array().cast(left.schema["left"].dataType)).alias("left"), F.spark_partition_id().alias("range")))
    counts = {r["range"]: r for r in ranged.groupBy("range").agg(F.count("*").alias("members"), F.max(F.size("left")).alias("left")).collect()}
    sizes = [counts[r]["members"] if r in counts else 0 for r in range(min(blocks, BUNCHES))]
    least = 1 if some else at_least - max((r["left"] for r in counts.values()), default=0)
    own = Window.partitionBy("range").orderBy("member")
    before = F.sum("n").over(own) - F.col("n")
    block = F.shiftleft(F.col("range").cast("long"), 32) + F.floor(before * blocks / max(total, 1))
    m = F.element_at(F.array(*(F.lit(sum(sizes[:r])).cast("long") for r in range(len(sizes)))), F.col("range") + 1) + F.row_number().over(own) - 1
    members = stored(ranged.select("member", "left", block.alias("block"), m.alias("m")))
    held = rows.join(members, "member").where("not array_contains(left, item)").select("item", "m", "block").repartition(max(LEAST_BLOCKS, total // HELD), "item")
    meet = held.mapInArrow(_runs, "block long, own long, others array<long>")
    if edges is not None:
        ends = edges.select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).where("i < j").join(members.select(F.col("member").alias("i"), "block", "m"), "i").join(members.select(F.col("member").alias("j"), F.col("m").alias("m_")), "j")
        meet = meet.unionByName(ends.select("block", F.lit(0).cast("long").alias("own"), F.array("m", "m_").alias("others")))
    size = max(sum(sizes), 1)
    pairs = meet.repartition(2 * blocks, "block").select("own", "others").mapInArrow(lambda batches: _counted(batches, size, least), "a long, b long, n long")
    for side, name in (("a", "i"), ("b", "j")):
        pairs = pairs.join(members.select(F.col("m").alias(f"m{side}"), F.col("member").alias(name), F.col("left").alias(f"left{side}")), F.col(side) == F.col(f"m{side}"))
    besides = F.size(F.array_intersect("lefta", "leftb")) if common.take(1) else F.lit(0)
    pairs = pairs.select("i", "j", (F.col("n") + besides).alias("shared"))
    if some:
        pairs = stored(pairs)
        side = lambda of, name: of.select(F.col("member").alias(name), "item")
        more = [pairs.select("i", "j").join(side(common, a), a).join(side(mixed, b), [b, "item"]).select("i", "j", F.lit(1).cast("long").alias("shared")) for a, b in ("ij", "ji")]
        pairs = pairs.unionByName(more[0]).unionByName(more[1]).groupBy("i", "j").agg(F.sum("shared").alias("shared"))
    return pairs.where(F.col("shared") >= at_least)


def two_hops(edges: DataFrame) -> DataFrame:
    """A -> b -> c, with a, b and c different."""
    e = edges.select("src", "dst").distinct()
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(e.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b").where("a <> c and a <> b and b <> c").select("a", "b", "c")


def with_neighbours(hits: DataFrame, related: DataFrame, strong: int = 2) -> DataFrame:
    """The hits, and what they are related to where strong hits are fewer than two."""
    few = hits.agg((F.count_if(F.col("score") >= 3) < strong).alias("few"))
    more = hits.select(F.col("path").alias("src")).join(related, "src").select(F.col("dst").alias("path")).distinct().crossJoin(F.broadcast(few)).where("few").select("path", F.lit(0).alias("score"))
    return hits.select("path", "score").unionByName(more.join(hits.select("path"), "path", "left_anti"))


def matched_lenses(events: DataFrame, lenses: DataFrame) -> DataFrame:
    """(event, lens, met): how many of a lens's signals, of one word or several, an event's text names (text.occurrences)."""
    signals = stored(lenses.select("lens", F.explode("signals").alias("name")).distinct())
    found = occurrences(events, signals, id_col="event")
    return found.join(signals, "name").groupBy(F.col("id").alias("event"), "lens").agg(F.count("*").alias("met"))


def orphans(cards: DataFrame, links: DataFrame, topic_members: DataFrame) -> DataFrame:
    """Cards without tags, links in or out, or a topic."""
    linked = links.select(F.col("src").alias("card")).unionByName(links.select(F.col("dst").alias("card"))).unionByName(topic_members.select("card")).distinct()
    return cards.where(F.size("tags") <= 0).join(linked, "card", "left_anti")


def as_of_previous(now: DataFrame, before: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Each row with the latest earlier row of its key, in one pass over the sorted union, never a pair join.

    before: (key, ts, value). Ties in time do not count as earlier.
    """
    a = now.withColumn("_turn", F.lit(0)).withColumn("_prev", F.lit(None).cast("timestamp_ntz")).withColumn("_value", F.lit(None).cast(before.schema["value"].dataType))
    b = before.select(key, ts, F.lit(1).alias("_turn"), F.col(ts).alias("_prev"), F.col("value").alias("_value"))
    # of one time, rows that ask come first
    w = Window.partitionBy(key).orderBy(ts, "_turn").rowsBetween(Window.unboundedPreceding, -1)
    both = a.unionByName(b, allowMissingColumns=True)
    both = both.withColumn("prev_ts", F.last("_prev", ignorenulls=True).over(w)).withColumn("prev_value", F.last("_value", ignorenulls=True).over(w))
    return both.where("_turn = 0").drop("_turn", "_prev", "_value")


def overdue_events(calendar: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """Past events without an outcome."""
    return calendar.where(F.col("event_date") < as_of).join(outcomes.select("event").distinct(), "event", "left_anti")


def upsert_kind(targets: DataFrame, decisions: DataFrame) -> DataFrame:
    """Update where a target has an open decision, else insert."""
    held = decisions.where("status = 'open'").select("target").distinct().withColumn("_open", F.lit(True))
    return targets.join(held, "target", "left").withColumn("action", F.when(F.col("_open"), "update").otherwise("insert")).drop("_open")


def both_concepts(hits: DataFrame, first: str, second: str) -> DataFrame:
    """Topics hit by both concepts; hits: (topic, concept, path)."""
    found = hits.groupBy("topic").agg(F.count_if(F.col("concept") == first).alias("first"), F.count_if(F.col("concept") == second).alias("second"))
    return found.where("first > 0 and second > 0")


def topic_chain(reports: DataFrame, followups: DataFrame, decisions: DataFrame, context: DataFrame, todos: DataFrame) -> DataFrame:
    """Per topic how many of each; each side is counted before it is joined, so nothing multiplies."""
    out = reports.select("topic").distinct()
    for name, side in (("followups", followups), ("decisions", decisions), ("context", context), ("todos", todos)):
        out = out.join(side.groupBy("topic").agg(F.count("*").alias(name)), "topic", "left")
    return out.fillna(0)


def over_domains(events: DataFrame, domains: list[str]) -> DataFrame:
    """Each event with each of the few impact domains."""
    return events.withColumn("domain", F.explode(F.array(*map(F.lit, domains))))


def deep_sections(lenses: DataFrame, sections: DataFrame) -> DataFrame:
    """J31; what comes out of one book and skill is dealt to many tasks."""
    return dealt(lenses, sections, ["book", "skill"])


def settled(user: DataFrame, engine: DataFrame) -> DataFrame:
    """Of concurrent versions of a path, the user's."""
    return user.unionByName(engine.join(user.select("path"), "path", "left_anti"))


def stale_connections(connections: DataFrame, lens_sections: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Connections whose data are old, and those without a lens section."""
    old = connections.where(F.datediff(as_of, "data_as_of") > days).select("path", F.lit("stale").alias("why"))
    bare = connections.join(lens_sections.select("path").distinct(), "path", "left_anti").select("path", F.lit("no_lens").alias("why"))
    return old.unionByName(bare)


def related_decisions(decisions: DataFrame) -> DataFrame:
    """(id, other, shared tags) of decisions that share a tag.

    Decisions of the same tags are one class; shared tags are counted for pairs of classes, and pairs of decisions are only put out, never counted.
    """
    tags = decisions.select("id", F.explode("tags").alias("tag")).where("id is not null and tag is not null")
    of = tags.groupBy("id").agg(F.sort_array(F.collect_set("tag")).alias("own"))
    each = of.select("own").distinct().select("own", F.explode("own").alias("tag"))
    pairs = each.join(each.select(F.col("own").alias("others"), "tag"), "tag").groupBy("own", "others").agg(F.count("*").alias("shared"))
    return dealt(of.join(pairs, "own").drop("own"), of.select(F.col("id").alias("other"), F.col("own").alias("others")), ["others"]).where("id <> other").select("id", "other", "shared")
