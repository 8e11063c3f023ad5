"""Near-duplicate documents by MinHash with tensored banding, links confirmed on full sets.

Two small collections of hash tuples are computed per document; a table's key joins one tuple of the
first with one of the second, so the tables are as many as the product of the collections and the
minhashes as few as their sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.llm.common import components, fresh, ready_to_checkpoint, separate, store

#: Tuples and hashes a tuple of the two collections: 11 x 8 = 88 tables of 5 hashes from 49 minhashes.
#: At a similarity of 0.8 a pair meets in some table with probability 0.9993.
FIRST, SECOND = (11, 3), (8, 2)
#: Classes that each is compared with at first; a matter of speed alone, as the second step has all others.
LEADERS = 16
#: Bits of a sketch, and the numbers of 64 bits that it is folded to for a first, short comparison: long conditions are not compiled by the JVM.
BITS, FOLDED = 4096, 16
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2 to the 64th."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)
        self.inverse = pow(_BASE, -1, 1 << 64)

    def to(self, n: int) -> None:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, m, 1 << 64))])


_POWERS = _Powers()
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word, words being runs of bytes that are not ASCII white space."""
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    space = _SPACES[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    _POWERS.to(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _POWERS.up[: len(data)], dtype=np.uint64)])
    return _mix((total[ends] - total[starts]) * _POWERS.down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a whole text's runs of `width` words, A-Z lower-cased; of fewer words, the one sequence; of none, nothing."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    n = len(words) - width + 1
    if not len(words):
        return words
    if n < 1:
        n, width = 1, len(words)
    found = np.full(n, width, np.uint64)
    for k in range(width):
        found = _mix(found * np.uint64(_BASE) + words[k : k + n])
    return np.unique(found)


def _multipliers(seed: int) -> np.ndarray:
    n = FIRST[0] * FIRST[1] + SECOND[0] * SECOND[1]
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """One number for each tuple of minhashes, first collection first."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 8192):
        least = np.minimum(least, (hashes[at : at + 8192] * multipliers[:, None]).min(1))
    out = []
    for (tuples, width), mins in zip((FIRST, SECOND), np.split(least, [FIRST[0] * FIRST[1]]), strict=True):
        folded = np.zeros(tuples, np.uint64)
        for k in range(width):
            folded = _mix(folded * np.uint64(_BASE) + mins.reshape(tuples, width)[:, k])
        out.append(folded)
    return np.concatenate(out)


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit number for the whole set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def signatures(docs: DataFrame, width: int, id_col: str, text_col: str, seed: int) -> DataFrame:
    """(doc_id, t, n_shingles, c, first, second): the text's hash, the set's size and number, and its tuples; c and tuples are null for an empty set."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers, cut = _multipliers(seed), FIRST[0]
        for batch in batches:
            sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
            tuples = [signature(s, multipliers).astype(np.int64) if len(s) else None for s in sets]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.int64()), batch.column(2), pa.array(map(len, sets), pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([None if t is None else t[:cut] for t in tuples], longs), pa.array([None if t is None else t[cut:] for t in tuples], longs),
            ], ["doc_id", "t", "n_shingles", "c", "first", "second"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    return rows.mapInArrow(signed, "doc_id long, t long, n_shingles long, c long, first array<long>, second array<long>")


def sketched(texts: DataFrame, width: int) -> DataFrame:
    """(c, size, sketch): the set's size and the parity of the hashes that fall to each of BITS bits, in longs.

    Two sketches differ in at most as many bits as there are hashes in one set alone.
    """

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, sketches = [], [], []
            for c, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = shingles(text, width)
                if not len(own) or set_id(own) != c:
                    continue
                odd = np.bincount((own % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
                ids.append(c)
                sizes.append(len(own))
                sketches.append(np.packbits(odd.astype(np.uint8)).view("<i8"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))], ["c", "size", "sketch"])

    return texts.select("c", "text").mapInArrow(drawn, "c long, size long, sketch array<long>").dropDuplicates(["c"])


def across(named: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different components that share a key and whose sketches do not rule a link out; no link is lost.

    named: (key, c, g), the rows of keys that hold several components. A pair that shares several
    tables comes from the first tuples that it shares alone. Of a link, at most (100 - percent) / (100 + percent) of the two sizes
    are in one set alone.
    """
    own = named.select(F.col("c").alias("n")).distinct()
    held = store(classes.select("c", "first", "second").join(own, F.col("c") == F.col("n"), "left_semi"))
    sketch = sketched(texts.join(own, F.col("c") == F.col("n"), "left_semi"), width)
    folded = [" ^ ".join(f"sketch[{j}]" for j in range(k, BITS // 64, FOLDED)) + f" as f{k}" for k in range(FOLDED)]
    sketch = sketch.selectExpr("c as m", "size", "sketch", *folded)
    wide = store(held.join(sketch, F.col("c") == F.col("m")).drop("m").withColumnRenamed("c", "n"))
    places = held.select("c", F.posexplode("first").alias("i", "x"), "second").select("c", "i", "x", F.posexplode("second").alias("j", "y"))
    places = places.select(F.xxhash64("i", "x", "j", "y").alias("k"), F.col("c").alias("n"), "i", "j")
    rows = named.join(places, (F.col("key") == F.col("k")) & (F.col("c") == F.col("n"))).select("key", "c", "g", "i", "j")
    words = [f"f{k}" for k in range(FOLDED)]
    rows = rows.join(wide, F.col("c") == F.col("n")).selectExpr("key", "c", "g", "slice(first, 1, i) as first", "slice(second, 1, j) as second", "size", "sketch", *words)
    rows = store(rows)
    rows = rows.where(" and ".join(f"{c} is not null" for c in rows.columns))
    other = rows.select(*(F.col(c).alias(f"{c}_") for c in rows.columns))
    differ = " + ".join(f"bit_count({w} ^ {w}_)" for w in words)
    whole = "aggregate(zip_with(sketch, sketch_, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)"
    close = " and ".join(f"{100 + percent} * ({n}) <= {100 - percent} * (size + size_)" for n in (differ, whole))
    meets = f"key = key_ and c < c_ and g <> g_ and 100 * least(size, size_) >= {percent} * greatest(size, size_) and {close} and not arrays_overlap(first, first_) and not arrays_overlap(second, second_)"
    return rows.join(other, F.expr(meets)).selectExpr("c as a", "c_ as b")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike: 100 * intersection >= percent * union.

    texts: (c, text), any rows that have the set number c. The pairs of one a are dealt in groups of
    a few hundred; a task meets a's text first, then the others', one at a time.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).alias("parts"))
    pairs = pairs.join(sizes.select(separate("a").alias("k"), "parts"), F.col("a") == F.col("k")).select("a", "b", F.expr("pmod(xxhash64(b), parts)").alias("part"))
    pairs = store(pairs)
    heads = pairs.select("a", "part").distinct()
    heads = heads.join(texts, F.col("a") == F.col("c")).select("a", "part", F.lit(0).alias("turn"), F.col("a").alias("b"), "text")
    others = pairs.join(texts, F.col("b") == F.col("c")).select("a", "part", F.lit(1).alias("turn"), "b", "text")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            for a, part, turn, b, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                theirs = shingles(text, width)
                if turn == 0:
                    if set_id(theirs) == a:
                        key, own = (a, part), theirs
                elif key == (a, part) and set_id(theirs) == b:
                    both = len(np.intersect1d(own, theirs, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(theirs) - both):
                        found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], ["a", "b"])

    dealt = heads.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", "turn")
    return dealt.mapInArrow(compared, "a long, b long")


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", seed: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row: components of documents linked by similar sets.

    Documents with one set are one class and are compared once. Classes that share a table's key are
    compared with the LEADERS least of the least classes of their keys, and then, in keys that still hold
    several components, with all those of other components whose sketch does not rule a link out;
    pairs that a component already joins need no comparison.
    component_id is the smallest document id of the component. A document without words (null or empty
    text) is its own component. A null id takes part but never names a component that
    has ids; repeated rows are of one class. An empty table gives no rows.
    """
    return grouped(docs, width, percent, id_col, text_col, seed).select("doc_id", "n_shingles", "component_id", "kept")


def grouped(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, seed: int) -> DataFrame:
    """near_duplicates() with the text's hash t and the number g of each row's component, null for a document without words."""
    spark = docs.sparkSession
    ready_to_checkpoint(spark)
    signed = store(signatures(docs, width, id_col, text_col, seed))
    classes = store(signed.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"), F.min("t").alias("t"), F.first("first").alias("first"), F.first("second").alias("second")))
    tables = classes.select("c", F.posexplode("first").alias("i", "x"), "second").select("c", "i", "x", F.posexplode("second").alias("j", "y"))
    tables = tables.select(F.xxhash64("i", "x", "j", "y").alias("key"), "c")
    shared = tables.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
    # rows of keys that several classes share: few beside all rows
    members = store(tables.join(shared.select(separate("key").alias("k"), "low"), F.col("key") == F.col("k")).select("key", "c", "low"))
    ids = members.select("c").distinct().join(classes.select(F.col("c").alias("n"), "least", F.col("t").alias("u")), F.col("c") == F.col("n"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # classes that have ids are found by the least of them, the others by one of their texts' hashes
    texts = rows.join(ids.where("least is not null").select("c", "least"), F.col("doc_id") == F.col("least")).select("c", "text")
    nameless = rows.where("doc_id is null").join(ids.where("least is null").select("c", "u"), F.xxhash64("text") == F.col("u")).select("c", "text")
    texts = store(texts.unionByName(nameless.dropDuplicates(["c"])))
    links, groups = [], None
    for step in range(2):
        if step == 0:
            least = F.slice(F.array_sort(F.collect_set("low")), 1, LEADERS)
            pairs = members.where("low < c").groupBy(F.col("c").alias("b")).agg(least.alias("a")).select("b", F.explode("a").alias("a"))
        else:
            named = members.join(groups.select(F.col("node"), "component"), F.col("c") == F.col("node"), "left").select("key", "c", F.coalesce("component", "c").alias("g"))
            mixed = named.groupBy("key").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 < g1")
            named = store(named.join(mixed.select(separate("key").alias("k")), F.col("key") == F.col("k"), "left_semi"))
            pairs = across(named, classes, texts, width, percent)
        pairs = store(pairs.select("a", "b"))
        if pairs.isEmpty():
            break
        links.append(store(confirmed(pairs, texts, width, percent)))
        every = links[0]
        for more in links[1:]:
            every = every.unionByName(more)
        groups = store(components(every))
    named = classes.select("c", "least")
    if groups is not None:
        named = named.join(groups, F.col("c") == F.col("node"), "left").select("c", "least", F.coalesce("component", "c").alias("g"))
    else:
        named = named.withColumn("g", F.col("c"))
    named = store(named)
    least = named.groupBy("g").agg(F.min("least").alias("component_id")).select(separate("g").alias("h"), "component_id")
    named = named.join(least, F.col("g") == F.col("h")).select("c", "g", "component_id")
    joined = signed.select("doc_id", "t", "n_shingles", "c").join(named.select(separate("c").alias("k"), "g", "component_id"), F.col("c") == F.col("k"), "left")
    component = F.expr("case when c is null then doc_id else component_id end")
    return joined.select("doc_id", "t", "g", "n_shingles", component.alias("component_id")).withColumn("kept", F.expr("coalesce(doc_id = component_id, component_id is null)"))


def keep_one(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", seed: int = 3) -> DataFrame:
    """The rows of docs with one of each component left; columns as before.

    Rows are told apart by id and text. Of rows that repeat an id within a component, one stays. Rows without
    an id stay unless a row with an id is of their component.
    """
    found = grouped(docs, width, percent, id_col, text_col, seed)
    gone = found.where("not kept").select("doc_id", "t").distinct()
    repeated = store(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("r")))
    again = not repeated.isEmpty()
    if again:  # of several texts in one component, the one with the least hash stays
        several = store(found.where("kept").join(repeated, F.col("doc_id") == F.col("r")).select("doc_id", "g", "t").distinct())
        least = several.groupBy("doc_id", "g").agg(F.min("t").alias("u")).select(F.col("doc_id").alias("i"), "u")
        gone = gone.unionByName(several.join(least, (F.col("doc_id") == F.col("i")) & (F.col("t") == F.col("u")), "left_anti").select("doc_id", "t"))
    doc, left, own = fresh(docs, "doc", "gone", "own")
    gone = store(gone.select(F.col("doc_id").alias(doc), F.col("t").alias(left)))
    rows = docs.withColumn(own, F.xxhash64(text_col))
    rows = rows.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(left)), "left_anti")
    if again:
        rows = rows.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, own]).unionByName(rows.where(F.col(id_col).isNull()))
    return rows.drop(own)
