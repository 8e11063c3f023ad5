"""Search by an inverted index (U02, O10, W08, V10): postings by word and area, written by day, read by a question's words alone.

Texts are cut at white space and where scripts without spaces begin or end. Long pieces become overlapping
windows, so a word of at most the overlap and one character more is a part of some window if and only if it is a part of
the text: the index gives the hits of a scan of all texts. Words that are longer, or that hold several pieces,
find candidates by their pieces and are verified in the texts of these alone.

Layout below one folder: `postings/day=/bucket=` (area, path, term, field), sorted by term in each file; `terms/day=` the
different terms; `docs/day=` which documents a day brought. A later day's version of a document replaces earlier ones.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.functions.scalar import UNSEGMENTED
from tessellum.operators.graph import stored
from tessellum.operators.ranking import BODY, TAG, TITLE
from tessellum.operators.windows import top_per_group

#: Width and step of windows, of pieces in scripts without spaces and of others.
TIGHT, WIDE = (8, 4), (32, 16)
#: Buckets of terms.
BUCKETS = 64
#: Bits that one column of a document's marks holds.
BITS = 60
PIECE = rf"{UNSEGMENTED}+|[^\s{UNSEGMENTED[1:-1]}]+"
_PIECE = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), PIECE))
_TIGHT = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), UNSEGMENTED))
POSTINGS = "area string, path string, term string, field string, day string, bucket int"


def windows_of(text: Column) -> Column:
    """The different windows of a text's pieces, lower case."""

    def cut(piece: Column) -> Column:
        tight = piece.rlike(UNSEGMENTED)
        width, step = (F.when(tight, F.lit(a)).otherwise(F.lit(b)) for a, b in zip(TIGHT, WIDE, strict=True))
        last = F.greatest(F.ceil((F.length(piece) - width) / step), F.lit(0)).cast("int")
        windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(piece, i * step + 1, width))
        return F.when(F.length(piece) <= TIGHT[0], F.array(piece)).otherwise(windows)  # most are short, of any script their own window

    pieces = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(PIECE), F.lit(0)))
    return F.coalesce(F.array_distinct(F.flatten(F.transform(pieces, cut))), F.array().cast("array<string>"))


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(areas: dict[str, DataFrame], folder: str, day: str, buckets: int = BUCKETS) -> None:
    """Write a day's documents into the index; areas have (path, tags, title, body), any of the last three may be null.

    (area, path) names a document: rows that share it are one document with the words of all. A null path is no document. A document that comes
    without words replaces its earlier version all the same. The same day written again leaves one copy.
    """
    columns = ("path", "tags", "title", "body")
    rows = reduce(DataFrame.unionByName, (x.select(*columns).withColumn("area", F.lit(name)) for name, x in areas.items())).where("path is not null")

    def marked(terms: Column, field: str) -> Column:
        return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(field).alias("field")))

    tags = F.filter(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))), lambda t: t.isNotNull())
    found = F.concat(marked(tags, "tag"), marked(windows_of(F.col("title")), "title"), marked(windows_of(F.col("body")), "body"))
    spark = rows.sparkSession
    rows.select("area", "path").distinct().write.mode("overwrite").parquet(f"{folder}/docs/day={day}")
    # texts are dealt by document, not their postings, which are several times as large; a task writes a file of each bucket
    postings = rows.repartition("path").select("area", "path", F.explode(found).alias("x")).select("area", "path", "x.*").withColumn("bucket", bucket_of(F.col("term"), buckets))
    postings.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings/day={day}")
    spark.read.schema(POSTINGS).parquet(f"{folder}/postings").where((F.col("day") == day) & (F.col("field") != "tag")).select("term").distinct().write.mode("overwrite").parquet(f"{folder}/terms/day={day}")


def pieces_of(word: str) -> tuple[list[str], bool]:
    """The parts of a word to look up, and whether they tell for sure that a text holds it."""
    found, sure = [], True
    for piece in _PIECE.findall(word):
        width, step = TIGHT if _TIGHT.match(piece) else WIDE
        sure &= len(piece) <= width - step + 1
        found.append(piece[: width - step + 1])
    return found, sure and len(found) == 1 and found[0] == word


def looked_up(spark: SparkSession, folder: str, words: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(term, bucket, slot): the index's terms that hold a part of a word, parts of all words numbered from 0; read from the terms alone."""
    parts = [piece for word in words for piece in pieces_of(word)[0]]
    terms = spark.read.schema("term string, day string").parquet(f"{folder}/terms").select("term").distinct()
    held = F.array(*(F.when(F.col("term").contains(piece), F.lit(slot)) for slot, piece in enumerate(parts)))
    rows = terms.where(reduce(lambda a, b: a | b, (F.col("term").contains(piece) for piece in parts)))
    return rows.select("term", bucket_of(F.col("term"), buckets).alias("bucket"), F.explode(F.array_compact(held)).alias("slot"))


def marks(bits: list[int]) -> Column:
    """Whether all of these bits are set; BITS of them are in each of the columns m0, m1 and so on."""
    masks: dict[int, int] = {}
    for bit in bits:
        masks[bit // BITS] = masks.get(bit // BITS, 0) | 1 << bit % BITS
    return reduce(lambda x, y: x & y, (F.col(f"m{j}").bitwiseAND(F.lit(mask)) == mask for j, mask in masks.items()))


def find(spark: SparkSession, folder: str, words: list[str], most: int = 5, areas: dict[str, DataFrame] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """ranking.search() over an index: (area, path, score) and rank of the best hits of each area.

    Only the buckets that hold a word's terms are read, of which there are at most `buckets`. Words that the index cannot
    decide (longer than a window's overlap, or of several pieces) need the areas' texts for verification; without them they are an error.
    A word without any character but white space is an error too.
    """
    kinds = [pieces_of(word) for word in words]
    if not words or any(not parts for parts, _ in kinds):
        raise ValueError("a word to search for holds more than white space")
    unsure = [w for w, (_, sure) in enumerate(kinds) if not sure]
    if unsure and areas is None:
        raise ValueError(f"words that need the texts: {[words[w] for w in unsure]}")
    matched = stored(looked_up(spark, folder, words, buckets))
    tagged = spark.createDataFrame(list(enumerate(words)), "word int, tag string").select("word", "tag", bucket_of(F.col("tag"), buckets).alias("bucket"))
    read = sorted({r["bucket"] for r in matched.select("bucket").union(tagged.select("bucket")).distinct().collect()})  # at most `buckets` numbers
    postings = spark.read.schema(POSTINGS).parquet(f"{folder}/postings").where(F.col("bucket").isin(read))
    # each part of a word has a bit for titles and one for bodies, each word one for tags; a document's bits are gathered in one exchange
    first = [sum(len(parts) for parts, _ in kinds[:w]) for w in range(len(words) + 1)]
    bit = F.col("slot") * 2 + F.when(F.col("field") == "body", 1).otherwise(0)
    hits = postings.where("field <> 'tag'").join(matched, ["bucket", "term"]).select("area", "path", "day", bit.alias("bit"))
    by_tag = postings.where("field = 'tag'").join(tagged, F.col("term") == F.col("tag")).select("area", "path", "day", (F.col("word") + 2 * first[-1]).alias("bit"))
    set_ = [F.bit_or(F.expr(f"if(bit div {BITS} = {j}, shiftleft(1L, cast(bit % {BITS} as int)), 0L)")).alias(f"m{j}") for j in range((2 * first[-1] + len(words) - 1) // BITS + 1)]
    docs = current(spark, folder, hits.unionByName(by_tag).groupBy("area", "path", "day").agg(*set_))
    kept = [(w, field, weight, marks([2 * slot + (field == "body") for slot in range(first[w], first[w + 1])])) for w in range(len(words)) for field, weight in (("title", TITLE), ("body", BODY))]
    sure = [F.when(marks([2 * first[-1] + w]), TAG).otherwise(0) for w in range(len(words))] + [F.when(found, weight).otherwise(0) for w, _, weight, found in kept if w not in unsure]
    if unsure:
        docs = stored(docs)
    scored = docs.select("area", "path", reduce(lambda x, y: x + y, sure).alias("score"))
    if unsure:
        open_ = [F.when(found, F.struct(F.lit(field).alias("field"), F.lit(w).alias("word"))) for w, field, _, found in kept if w in unsure]
        candidates = docs.select("area", "path", F.explode(F.array_compact(F.array(*open_))).alias("x")).select("area", "path", "x.*")
        more = verified(candidates, words, areas).select("area", "path", F.when(F.col("field") == "title", TITLE).otherwise(BODY).alias("score"))
        scored = scored.where("score > 0").unionByName(more).groupBy("area", "path").agg(F.sum("score").cast("int").alias("score"))
    return top_per_group(scored.where("score > 0"), "area", F.col("score").desc(), F.col("path"), most=most)


def current(spark: SparkSession, folder: str, hits: DataFrame) -> DataFrame:
    """Hits of documents' last versions; only the documents of days after the first are looked at, as the first replaces none."""
    docs = spark.read.schema("area string, path string, day string").parquet(f"{folder}/docs")
    first = docs.agg(F.min("day")).first()[0]
    later = docs.where(F.col("day") > F.lit(first)).groupBy(F.col("area").alias("_a"), F.col("path").alias("_p")).agg(F.max("day").alias("_day"))
    same = (F.col("area") == F.col("_a")) & (F.col("path") == F.col("_p")) & (F.col("day") < F.col("_day"))
    return hits.join(later, same, "left_anti").drop("day")


def verified(candidates: DataFrame, words: list[str], areas: dict[str, DataFrame]) -> DataFrame:
    """Candidates (area, path, field, word) whose text holds the word."""
    texts = reduce(DataFrame.unionByName, (x.select(F.lit(name).alias("a"), F.col("path").alias("p"), "title", "body") for name, x in areas.items()))
    asked = F.element_at(F.array(*(F.lit(w) for w in words)), F.col("word") + 1)
    text = F.lower(F.when(F.col("field") == "title", F.col("title")).otherwise(F.col("body")))
    rows = candidates.join(texts, (F.col("area") == F.col("a")) & (F.col("path") == F.col("p"))).where(text.contains(asked))
    return rows.select("area", "path", "field", "word").distinct()
