"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact size, whole copies fill most of a source's target, and a bounded
knapsack over the counts says how many documents of each size fill the rest; those are drawn by a
seeded hash.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellum.llm.common import fresh, separate, store

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)


def word_count(text: str):
    """Words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def share_out(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Targets by weight that stop at cap times a source's size; the excess is shared anew by weight."""
    targets, free, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while free:
        weight = sum(weights[i] for i in sorted(free))
        over = {i for i in free if weight <= 0 or left * weights[i] / weight > cap * sizes[i]}
        for i in over or free:
            targets[i] = cap * sizes[i] if over else left * weights[i] / weight
        if not over:
            break
        left -= sum(targets[i] for i in sorted(over))
        free -= over
    return targets


def fit(sizes: list[int], counts: list[int], budget: int, seed: int) -> list[int]:
    """How many documents of each size make up the budget as nearly as can be; of equally near sums the lower.

    First every size gives its share of documents, rounded down; then sizes in seeded order give one
    more until what is left is a few documents' worth; that is solved by bounded knapsack over the
    documents left, as a set of reachable sums held in the bits of one number.
    """
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    taken = [0] * len(sizes)
    if budget <= 0 or not total:
        return taken
    if budget >= total:
        return list(counts)
    taken = [c * budget // total if s else 0 for s, c in zip(sizes, counts, strict=True)]
    left = budget - sum(s * t for s, t in zip(sizes, taken, strict=True))
    order = [i for i in range(len(sizes)) if sizes[i]]
    random.Random(seed).shuffle(order)
    window = 2 * max(sizes) + 4096
    for i in order:
        if left - sizes[i] >= window and taken[i] < counts[i]:
            taken[i] += 1
            left -= sizes[i]
    most = left + max(sizes)  # a sum above the budget may be the nearest
    reach, first = 1, np.full(most + 1, -1, np.int64)
    pieces: list[tuple[int, int]] = []
    mask = (1 << (most + 1)) - 1
    for i in order:
        free, part = min(counts[i] - taken[i], most // sizes[i]), 1
        while free > 0:
            n = min(part, free)
            new = (reach << (n * sizes[i])) & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(most // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits)] = len(pieces)
                pieces.append((i, n))
                reach |= new
            free, part = free - n, part * 2
        if reach >> left & 1:
            break
    at = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = reach >> left
    if above and (above & -above).bit_length() - 1 < left - at:
        at = left + (above & -above).bit_length() - 1
    while at:  # the piece that first reached a sum was added to a sum reached by earlier pieces
        i, n = pieces[first[at]]
        taken[i] += n
        at -= n * sizes[i]
    return taken


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """Copies of each document in the mix: (id, source, size, source_size, target, copies).

    Sources in code-point order, null last, weigh `weights`, repeating, and share `share` times all
    words; a target stops at `cap` times its source's words, the excess goes to the others.
    copies is between 0 and ceil(cap). Null text: size 0; documents of size 0 are taken as often as
    their source is in whole. Null ids are documents like any other; repeated rows count as often as
    they stand. Tie: documents of one size are drawn by a seeded hash of the id, then the id. An empty
    table gives an empty result. One row per source comes to the driver, nothing else.
    """
    spark = docs.sparkSession
    rows = store(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size")))
    by_size = store(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    totals = [(r["source"], int(r["s"] or 0)) for r in by_size.groupBy("source").agg(F.sum(F.expr("size * n")).alias("s")).collect()]
    totals.sort(key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8")))
    targets = share_out([s for _, s in totals], [weights[i % len(weights)] for i in range(len(totals))], share * sum(s for _, s in totals), cap)
    plan = pd.DataFrame({
        "source": pd.Series([x[0] for x in totals], dtype=object), "source_size": np.array([x[1] for x in totals], np.int64), "target": np.array(targets, np.float64),
        "whole": np.array([min(math.floor(t / s), math.floor(cap)) if s else 0 for t, (_, s) in zip(targets, totals, strict=True)], np.int64),
    })
    schema = "source string, source_size long, target double, whole long"
    plan_df = spark.createDataFrame(list(plan.itertuples(index=False, name=None)) if len(plan) else [], schema)

    def chosen(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        size, n = [int(x) for x in group["size"]], [int(x) for x in group["n"]]
        first = group.iloc[0]
        budget = math.floor(first["target"] + 1e-6) - int(first["whole"]) * int(first["source_size"])
        extra = fit(size, n, budget, seed)
        return pd.DataFrame({"source": group["source"], "size": size, "n": n, "source_size": group["source_size"], "target": group["target"], "whole": group["whole"], "extra": extra})

    # one row per source and distinct size: a group is bounded by how many different sizes documents have
    counts = by_size.join(plan_df, by_size["source"].eqNullSafe(plan_df["source"])).select(by_size["source"], "size", "n", "source_size", "target", "whole")
    counts = store(counts.groupBy("source").applyInPandas(chosen, "source string, size long, n long, source_size long, target double, whole long, extra long"))
    key = F.xxhash64(F.col("source"), F.col("source").isNull(), F.col("size"))
    rows = rows.withColumn("key", key).withColumn("u", F.xxhash64(F.lit(seed), F.col("doc_id")))
    counts = counts.withColumn("key", key)
    # documents of one size are split over about the root of their number of hash ranges: none is large
    rows = rows.join(counts.select(separate("key").alias("k"), F.col("source").alias("s"), F.col("size").alias("z"), "n", "source_size", "target", "whole", "extra"), (F.col("key") == F.col("k")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    rows = store(rows.select("doc_id", "source", "size", "source_size", "target", "whole", "extra", "n", "key", "u", F.expr("cast(case when extra > 0 and extra < n then pmod(u, ceil(sqrt(n))) end as long)").alias("part")))
    split = rows.where("part is not null").groupBy("key", "part").agg(F.count("*").alias("c"), F.max("extra").alias("extra"))
    split = split.withColumn("before", F.sum("c").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    split = split.select(F.col("key").alias("k2"), F.col("part").alias("p2"), F.expr("extra - coalesce(before, 0)").alias("need"), "c")
    draw = rows.where("part is not null").join(split, (F.col("key") == F.col("k2")) & (F.col("part") == F.col("p2")))
    whole = draw.where("need <= 0 or need >= c").withColumn("more", F.expr("case when need >= c then 1 else 0 end"))
    edge = draw.where("need > 0 and need < c").withColumn("r", F.row_number().over(Window.partitionBy("key", "part").orderBy("u", "doc_id")))
    edge = edge.withColumn("more", F.expr("case when r <= need then 1 else 0 end"))
    rest = rows.where("part is null").withColumn("more", F.expr("case when extra > 0 then 1 else 0 end"))
    out = ["doc_id", "source", "size", "source_size", "target", "whole", "more"]
    mixed = rest.select(*out).unionByName(whole.select(*out)).unionByName(edge.select(*out))
    return mixed.select(F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("whole") + F.col("more")).cast("int").alias("copies"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The rows of docs as often as the mix takes them; columns as before.

    Rows that repeat an id are taken for one document: each is taken as often as the mix takes the id's
    row of its source and size, at most. Null texts and texts without words have size 0; an empty table stays
    empty; other columns are kept, whatever their names.
    """
    copies = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **settings)
    doc, origin, size, times, words, turn = fresh(docs, "doc", "origin", "size", "times", "words", "turn")
    copies = copies.groupBy(F.col(id_col).alias(doc), F.col(source_col).alias(origin), F.col("size").alias(size)).agg(F.max("copies").alias(times)).where(F.col(times) > 0)
    rows = docs.withColumn(words, word_count(text_col))
    taken = rows.join(copies, F.col(id_col).eqNullSafe(F.col(doc)) & F.col(source_col).eqNullSafe(F.col(origin)) & (F.col(words) == F.col(size)))
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(turn)).drop(turn)
