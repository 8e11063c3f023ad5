"""Conversation structure repair: the cheapest edits that give roles `(s?(ua)+)?`, by a forward Viterbi pass.

The grammar has four states: nothing yet, after the system turn, after a user turn, after an assistant's.
A layer holds, for each state, the least (cost, audit) that reaches it, and is closed with inserts after
each row: user then assistant, or assistant then user; a third in a row never pays. An audit fixes its
cost and its roles, so no audit of a state is a prefix of an equally cheap one, and the least prefix stays
the least whole.

Rows are sorted by conversation in ranges, so a conversation of any length is split over tasks: one that
a range begins or ends within is followed from each state it may be entered in, and its parts are then
put together like matrices. Only marks of texts are sorted there; texts pass once, past a digest that must
read a conversation in order, one row at a time.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.llm.common import store

START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = ("su", "ua", "au")
RETYPE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: Rows after which the audits' common beginning is put aside.
SETTLE = 64
#: Rows of a result batch.
ROWS = 1024
WORD = r"[^\x20\x09-\x0D]"

Layer = list  # of (cost, audit) or None, by state


def closed(layer: Layer) -> Layer:
    """The layer after inserts, without states that can't be on a cheapest way: from the assistant's state all that others can do costs at most 4 more."""
    user = min((x for x in (layer[USER], *((x[0] + INSERT, x[1] + "I") for x in (layer[START], layer[SYSTEM], layer[ASSISTANT]) if x)) if x), default=None)
    done = layer[ASSISTANT]
    if user and (not done or (user[0] + INSERT, user[1] + "I") < done):
        done = (user[0] + INSERT, user[1] + "I")
    start, system = layer[START], layer[SYSTEM]
    if done:
        if start and start[0] > done[0] + DELETE:
            start = None
        if system and system[0] > done[0]:
            system = None
    return [start, system, user, done]


class Way:
    """The layer after the rows so far, from one layer before them."""

    def __init__(self, layer: Layer):
        self.layer, self.settled, self.rows = layer, [], 0

    def step(self, initial: str, must_go: bool, cut: bool) -> None:
        out: Layer = [None] * 4
        keeps, more = ({}, 0) if must_go else (KEEPS.get(initial, {}), CUT if cut else 0)
        for state, x in enumerate(self.layer):
            if not x:
                continue
            cost, audit = x
            ways = [(state, (cost + DELETE, audit + "D"))]
            if not must_go:
                ways.append((NEXT[state], (cost + RETYPE + more, audit + "R")))
                if state in keeps:
                    ways.append((keeps[state], (cost + more, audit + "K")))
            for to, y in ways:
                if not out[to] or y < out[to]:
                    out[to] = y
        self.layer = closed(out)
        self.rows += 1
        if self.rows % SETTLE == 0:
            self.settle()

    def settle(self) -> None:
        """Put aside what all audits begin with, so that they stay short."""
        audits = [x[1] for x in self.layer if x]
        n = len(os.path.commonprefix(audits))
        if n:
            self.settled.append(audits[0][:n])
            self.layer = [x and (x[0], x[1][n:]) for x in self.layer]

    def cells(self) -> list[tuple[int, int, str]]:
        """(state, cost, audit) of the states reached."""
        head = "".join(self.settled)
        return [(to, x[0], head + x[1]) for to, x in enumerate(self.layer) if x]


def unit(state: int) -> Layer:
    return [(0, "") if s == state else None for s in range(4)]


def first_layer() -> Layer:
    return closed(unit(START))


def cheapest(layer: Layer) -> tuple[int, str]:
    """Of the states that may end a conversation."""
    return min(x for x in (layer[START], layer[ASSISTANT]) if x)


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_PART = pa.schema([("conv_id", pa.int64()), ("at_turn", pa.int64()), ("at_role", pa.string()), ("at_mark", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("first_initial", pa.string()), ("last_initial", pa.string()), *((c, pa.int64()) for c in _COUNTS), ("cost", pa.int64()), ("audit", pa.string()), ("cells", pa.list_(pa.struct([("frm", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])
_PART_SQL = "conv_id long, at_turn long, at_role string, at_mark string, low long, high long, first_initial string, last_initial string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", cost long, audit string, cells array<struct<frm int, to int, cost long, audit string>>"


class Part:
    """The rows of one conversation within one range, and their ways."""

    def __init__(self, row: dict, whole: bool):
        self.head = {"conv_id": row["conv_id"], "at_turn": row["turn"], "at_role": row["role"], "at_mark": row["mark"]}
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.low = self.high = self.first = self.last = None
        self.ways = {START: Way(first_layer())} if whole else {s: Way(unit(s)) for s in range(4)}

    def add(self, row: dict) -> None:
        initial, counts = row["role"][:1], self.counts
        for copy in range(row["n"]):
            fault = "blank" if row["blank"] else "duplicate" if copy or not row["first"] else "truncated" if row["cut"] else None
            if fault:
                counts[fault] += 1
            if self.last is not None and self.last + initial not in LEGAL:
                counts["illegal"] += 1
            if self.first is None:
                self.first = initial
            self.last = initial
            for way in self.ways.values():
                way.step(initial, fault in ("blank", "duplicate"), fault == "truncated")
        if row["n"] and row["turn"] is not None and row["turn"] != self.high:
            counts["turns"] += 1
            self.low, self.high = row["turn"] if self.low is None else self.low, row["turn"]

    def done(self, open_end: bool) -> dict:
        out = {**self.head, **self.counts, "low": self.low, "high": self.high, "first_initial": self.first, "last_initial": self.last, "cost": None, "audit": None, "cells": None}
        if open_end or len(self.ways) > 1:
            out["cells"] = [{"frm": frm, "to": to, "cost": cost, "audit": audit} for frm, way in self.ways.items() for to, cost, audit in way.cells()]
            if len(self.ways) == 1:  # entered at the conversation's beginning, as closed() left it
                out["cost"] = 0
        else:
            way = self.ways[START]
            cost, audit = cheapest(way.layer)
            out["cost"], out["audit"] = cost, "".join(way.settled) + audit
        return out


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn to one part per conversation; the first and the last of a range stay open."""
    part, begun, out = None, False, []
    for batch in batches:
        for row in batch.to_pylist():
            if part is None or row["conv_id"] != part.head["conv_id"]:
                if part is not None:
                    out.append(part.done(False))
                part, begun = Part(row, begun), True
            part.add(row)
            if len(out) >= ROWS:
                yield pa.RecordBatch.from_pylist(out, schema=_PART)
                out = []
    if part is not None:
        out.append(part.done(True))
    yield pa.RecordBatch.from_pylist(out, schema=_PART)


def put_together(table: pa.Table) -> pa.Table:
    """The parts of one conversation as one whole part."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["at_turn"] is not None, r["at_turn"] or 0, r["at_role"], r["at_mark"]))
    counts, ends = dict.fromkeys(_COUNTS, 0), [r for r in rows if r["low"] is not None]
    for r in rows:
        for c in _COUNTS:
            counts[c] += r[c]
    for a, b in zip(ends, ends[1:]):
        counts["turns"] -= a["high"] == b["low"]
    said = [r for r in rows if r["first_initial"] is not None]
    for a, b in zip(said, said[1:]):
        counts["illegal"] += a["last_initial"] + b["first_initial"] not in LEGAL
    way = Way(first_layer())
    for r in rows:
        if r["cost"] is not None:  # begins the conversation
            way.layer = [None] * 4
            for cell in r["cells"]:
                way.layer[cell["to"]] = (cell["cost"], cell["audit"])
        else:
            out: Layer = [None] * 4
            for cell in r["cells"]:
                if x := way.layer[cell["frm"]]:
                    y = (x[0] + cell["cost"], x[1] + cell["audit"])
                    if not out[cell["to"]] or y < out[cell["to"]]:
                        out[cell["to"]] = y
            way.layer = out
        way.settle()
    cost, audit = cheapest(way.layer)
    whole = {**rows[0], **counts, "low": ends[0]["low"] if ends else None, "high": ends[-1]["high"] if ends else None, "cost": cost, "audit": "".join(way.settled) + audit, "cells": None}
    return pa.Table.from_pylist([whole], schema=_PART)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): each row as the test damage leaves it; a null role or text is one space.

    By crc32 of "conv_id:turn" (null: one space) modulo 20: 0 drops the row (no copies), 1 empties its
    text, 2 removes its `.`, `!` and `?`, 3 repeats it, 4 makes it a user's.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("harm", F.expr("crc32(concat(coalesce(cast(conv_id as string), ' '), ':', coalesce(cast(turn as string), ' '))) % 20"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("harm") == 0, 0).when(F.col("harm") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, mark, n, blank, cut, first): each different row without its text; first: its role and text stand in no earlier turn.

    The mark is the text's md5. Equal rows are counted before they are dealt out, and only those whose role
    and text come in several turns are looked up, so one text that fills a conversation does no harm.
    """
    slim = rows.select("conv_id", "turn", "role", F.md5(F.encode("text", "UTF-8")).alias("mark"), "copies", (~F.col("text").rlike(WORD)).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"))
    slim = store(slim.groupBy("conv_id", "turn", "role", "mark").agg(F.sum("copies").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut")))
    said = slim.where("n > 0").groupBy("conv_id", "role", "mark").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("least"), F.count("*").alias("c")).where("c > 1")
    said = said.select(F.xxhash64("conv_id", "role", "mark").alias("k"), F.col("conv_id").alias("c_"), F.col("role").alias("r_"), F.col("mark").alias("m_"), F.col("least.turn").alias("first_turn"))
    same = (F.xxhash64("conv_id", "role", "mark") == F.col("k")) & F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("role") == F.col("r_")) & (F.col("mark") == F.col("m_"))
    found = slim.join(said, same, "left")
    return found.select("conv_id", "turn", "role", "mark", "n", "blank", "cut", (F.col("k").isNull() | F.col("turn").eqNullSafe(F.col("first_turn"))).alias("first"))


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    rows: (conv_id, turn, role, text, copies), copies 0 for rows that are gone. They are taken by turn, nulls
    first; rows of one turn by role, then by the md5 of their text. A null conv_id is a conversation too.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "mark"]
    ranged = store(marked(rows)).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = store(ranged.mapInArrow(parts_of, _PART_SQL))
    whole = parts.where("cells is null").unionByName(parts.where("cells is not null").groupBy("conv_id").applyInArrow(put_together, _PART_SQL))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long"))
    return whole.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")


_APPLIED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("head", pa.struct([*((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())]))])
_APPLIED_SQL = "conv_id long, place long, edit string, role string, text string, head struct<gaps: long, blank: long, duplicate: long, truncated: long, illegal: long, cost: long, audit: string>"


def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's head row and, behind it, its rows, to the head row (place 0) and the repaired ones (from 1 on)."""
    conv, audit, at, place, state, out = None, "", 0, 0, START, []

    def put(edit: str, role: str, text: str) -> None:
        nonlocal place, state
        place += 1
        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
        out.append({"conv_id": conv, "place": place, "edit": edit, "role": role, "text": text, "head": None})

    def inserts() -> None:
        nonlocal at
        while audit[at : at + 1] == "I":
            at += 1
            put("I", NAMES[NEXT[state]], "")

    for batch in batches:
        for row in batch.to_pylist():
            if row["head"]:
                conv, audit, at, place, state = row["conv_id"], row["head"]["audit"], 0, 0, START
                out.append({"conv_id": conv, "place": 0, "edit": None, "role": None, "text": None, "head": row["head"]})
                inserts()
            for _ in range(row["copies"] or 0):
                edit, at = audit[at], at + 1
                if edit != "D":
                    put(edit, row["role"] if edit == "K" else NAMES[NEXT[state]], row["text"])
                inserts()
            if len(out) >= ROWS:
                yield pa.RecordBatch.from_pylist(out, schema=_APPLIED)
                out = []
    yield pa.RecordBatch.from_pylist(out, schema=_APPLIED)


def with_heads(rows: DataFrame) -> DataFrame:
    """Head rows and repaired rows, those of a conversation one after the other in one partition."""
    heads = audits(rows)
    head = heads.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies"), F.struct(*heads.columns[1:]).alias("head"))
    both = head.unionByName(rows.where("copies > 0").withColumn("head", F.lit(None).cast(head.schema["head"].dataType)))
    both = both.withColumn("mark", F.md5(F.encode("text", "UTF-8")))
    order = ["conv_id", F.col("head").isNull(), F.col("turn").asc_nulls_first(), "role", "mark"]
    return both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text", "copies", "head").mapInArrow(applied, _APPLIED_SQL)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of all repaired conversations, from place 1 on; edit is K, R or I. rows as for audits()."""
    return with_heads(rows).where("place > 0").drop("head")


_SUMMED = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Head rows and repaired ones to one row per conversation, with the digest of its `role:text` lines."""
    head, digest, out = None, None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["place"] == 0:
                if head is not None:
                    out.append({**head, "repaired_sha256": digest.hexdigest()})
                head, digest = {"conv_id": row["conv_id"], **row["head"]}, hashlib.sha256()
            else:
                digest.update(f"{chr(10) if row['place'] > 1 else ''}{row['role']}:{row['text']}".encode())
        yield pa.RecordBatch.from_pylist(out, schema=_SUMMED)
        out = []
    if head is not None:
        yield pa.RecordBatch.from_pylist([{**head, "repaired_sha256": digest.hexdigest()}], schema=_SUMMED)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: audits() and repaired_sha256, the SHA-256 of the repaired `role:text` lines joined by line ends.

    rows: (conv_id, turn, role, text, copies), as from damaged(). A conversation all of whose rows are
    gone has zeros, an empty audit and the digest of the empty string. Null turns come first and count in
    no gap; rows that repeat are duplicates of the first; an empty table gives no rows; other columns
    play no part. Texts of any length are digested whole.
    """
    return with_heads(rows).mapInArrow(summed, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
