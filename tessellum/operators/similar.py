"""Texts few edits apart, by pieces that must be equal.

Of a text cut into n + 1 pieces, n edits leave one whole. It then stands in the other text too, shifted by
no more than the edits before it, nor by more than the edits behind it allow; so texts few edits apart meet in
an equi join on (length, number of the piece, piece), and only those that meet are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.functions.scalar import similarity
from tessellum.operators.graph import stored


#: Texts that may share a piece before it counts as crowded.
CROWD = 64


def _start(length: str, k: str, pieces: str) -> str:
    """Where piece k (from 0) of a text begins, from 1 on; the last pieces are longer by one where they must."""
    return f"({k} * ({length} div ({pieces})) + greatest(0, {k} - ({pieces} - {length} % ({pieces}))) + 1)"


def _size(length: str, k: str, pieces: str) -> str:
    return f"({_start(length, f'({k} + 1)', pieces)} - {_start(length, k, pieces)})"


def _range(d: str, k: str, edits: str) -> str:
    """The shifts of piece k in a text longer by d: at most k edits before it, at most edits - k behind it."""
    first, last = f"greatest(-{k}, {d} - ({edits} - {k}))", f"least({k}, {d} + ({edits} - {k}))"
    return f"if({first} <= {last}, sequence({first}, {last}), array())"


def _own_pieces(edits: int) -> Column:
    """(k, at, size, key) of the pieces of text t of length n in block b."""
    at, size = (f("n", "k", str(edits + 1)) for f in (_start, _size))
    return F.expr(f"explode(transform(sequence(0, {edits}), k -> named_struct('k', k, 'at', {at}, 'size', {size}, 'key', xxhash64(b, n, k, substring(t, {at}, {size})))))")


def _others_pieces(edits: int, low: int, high: int) -> Column:
    """(k, at, size, d, o, key): where pieces of texts shorter than t by d, from low to high, can stand in it, shifted by o."""
    shifts = f"flatten(transform(sequence({low}, {high}), d -> flatten(transform(sequence(0, {edits}), k -> transform({_range('d', 'k', str(edits))}, o -> struct(d as d, k as k, o as o))))))"
    other = "(n - x.d)"
    at, size = f"({_start(other, 'x.k', str(edits + 1))} + x.o)", _size(other, "x.k", str(edits + 1))
    fits = f"filter({shifts}, x -> {other} >= 0 and {at} >= 1 and {at} + {size} - 1 <= n)"
    return F.expr(f"explode(transform({fits}, x -> named_struct('k', x.k, 'at', {at}, 'size', {size}, 'd', x.d, 'o', x.o, 'key', xxhash64(b, {other}, x.k, substring(t, {at}, {size})))))")


def _narrowed(rows: DataFrame, edits: int, others: bool) -> Column:
    """The keys of rows at a crowded piece: the piece and, with it, one of the pieces of what stands before or behind it.

    Where texts share piece k at their best place, at most k edits lie before it and at most edits - k behind, so the longer
    of the two sides is cut and looked up in the same way as a whole text is.
    """
    right = f"p.k <= {edits // 2}"
    rest, e = f"if({right}, substring(t, p.at + p.size), substring(t, 1, p.at - 1))", f"if({right}, {edits} - p.k, p.k)"
    rest_n = f"if({right}, n - p.at - p.size + 1, p.at - 1)"
    if not others:
        at, size = (f("y.m", "j", "y.e + 1") for f in (_start, _size))
        each = f"transform(sequence(0, y.e), j -> xxhash64(p.key, j, substring(y.rest, {at}, {size})))"
        return F.expr(f"flatten(transform(array(named_struct('rest', {rest}, 'm', {rest_n}, 'e', {e})), y -> {each}))")
    at, size = f"({_start('(y.m - y.d)', 'j', 'y.e + 1')} + o)", _size("(y.m - y.d)", "j", "y.e + 1")
    each = f"flatten(transform(sequence(0, y.e), j -> transform(filter({_range('y.d', 'j', 'y.e')}, o -> y.m >= y.d and {at} >= 1 and {at} + {size} - 1 <= y.m), o -> xxhash64(p.key, j, substring(y.rest, {at}, {size})))))"
    return F.expr(f"array_distinct(flatten(transform(array(named_struct('rest', {rest}, 'm', {rest_n}, 'e', {e}, 'd', if({right}, p.d - p.o, p.o))), y -> {each})))")


def meeting(own: DataFrame, others: DataFrame, edits: int, low: int, high: int) -> DataFrame:
    """(b, t1, i1, t2, i2) of own and other texts (b, t, i) of one block that share a piece; t1 is shorter than t2 by low to high. A pair may come more than once.

    A piece of more than CROWD own texts is narrowed by a second one. Both sides of the join come from an exchange
    of their own, so that adaptive execution splits what is still crowded.
    """
    mine = own.withColumn("n", F.length("t")).withColumn("p", _own_pieces(edits))
    asked = others.withColumn("n", F.length("t")).withColumn("p", _others_pieces(edits, low, high))
    crowded = stored(mine.groupBy(F.col("p.key").alias("crowded")).agg(F.count("*").alias("c")).where(F.col("c") > CROWD).select("crowded"))

    def keyed(rows: DataFrame, by_others: bool) -> DataFrame:
        marked = rows.join(crowded, F.col("p.key") == F.col("crowded"), "left")
        keys = F.when(F.col("crowded").isNull(), F.array("p.key")).otherwise(_narrowed(rows, edits, by_others))
        return marked.select("b", "t", "i", F.explode(keys).alias("key"))

    left = keyed(mine, False).select(F.col("b").alias("b1"), F.col("t").alias("t1"), F.col("i").alias("i1"), F.col("key").alias("key1"))
    right = keyed(asked, True).select("b", F.col("t").alias("t2"), F.col("i").alias("i2"), F.col("key").alias("key2"))
    return left.join(right, (F.col("key1") == F.col("key2")) & F.col("b1").eqNullSafe(F.col("b"))).select("b", "t1", "i1", "t2", "i2")


def met(texts: DataFrame, edits: int) -> DataFrame:
    """meeting() of the texts with each other: t1 no longer than t2, and the smaller of two of one length."""
    return meeting(texts, texts, edits, 0, edits).where((F.length("t1") < F.length("t2")) | (F.col("t1") < F.col("t2")))


def near(texts: DataFrame, edits: int) -> DataFrame:
    """(b, t1, i1, t2, i2): the pairs of different texts of a block that are at most `edits` apart, each once."""
    return met(texts, edits).where(F.levenshtein("t1", "t2", edits) >= 0).dropDuplicates(["b", "t1", "t2"])


def nearest(targets: DataFrame, files: DataFrame, at_least: float) -> DataFrame:
    """(target, path, score): the most similar path of each target, score at_least or more; of equal ones the last path.

    The search grows: within 1, 2, 4, ... edits all paths are found, and a target leaves once no path farther off can
    be as similar, or any that is left falls below at_least. One at d edits from a target of n characters is at
    most n / (n + d) similar, whatever its length.
    """
    paths = files.select("path").where("path is not null").distinct()
    left = stored(targets.select("target").where("target is not null").distinct().withColumn("n", F.length("target")))
    done, edits = None, 1
    while True:
        own = paths.select(F.lit(0).alias("b"), F.col("path").alias("t"), F.lit(0).alias("i"))
        asked = left.select(F.lit(0).alias("b"), F.col("target").alias("t"), F.lit(0).alias("i"))
        pairs = meeting(own, asked, edits, -edits, edits).select(F.col("t2").alias("target"), F.col("t1").alias("path")).distinct()
        pairs = pairs.where(F.levenshtein("target", "path", edits) >= 0).withColumn("s", similarity(F.col("target"), F.col("path")))
        best = pairs.where(F.col("s") >= at_least).groupBy(F.col("target").alias("t")).agg(F.max(F.struct("s", "path")).alias("best"))
        seen = stored(left.join(best, F.col("target") == F.col("t"), "left").select("target", "n", F.col("best.path").alias("path"), F.col("best.s").alias("score")))
        bound = F.col("n") / (F.col("n") + edits + 1)
        settled = (bound < at_least) | F.coalesce(F.col("score") > bound, F.lit(False))
        found = seen.where(settled & F.col("path").isNotNull()).select("target", "path", "score")
        done = found if done is None else done.unionByName(found)
        left = seen.where(~settled).select("target", "n")
        if left.isEmpty():
            return done
        edits *= 2
