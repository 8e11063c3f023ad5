"""Near-duplicate lines by MinHash, with DataFrame operations alone.

A line's shingles are its runs of WIDTH characters (UTF-16 units), as byte ranges of its UTF-16 form; of
a shorter line, the line itself. A minhash is the shingle hash nearest to a fixed number, distances being
exclusive ors. Lines that share a band are compared on their full sets of shingles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.llm.common import components, fresh, ready_to_checkpoint, separate, store

WIDTH, PERCENT = 8, 80
#: Bits by which a shingle's hash is turned; each of the three forms gives three minhashes.
TURNS = (0, 21, 42)
#: The 9 minhashes as points (x, y) of the affine plane of order 3, and its 12 lines as bands of 3: whichever 5 of
#: the 9 two lines share, 3 of them make a band. A pair with a similarity of 0.8 shares a band with probability 0.99.
BANDS = [[3 * x + (m * x + b) % 3 for x in range(3)] for m in range(3) for b in range(3)] + [[3 * x + y for y in range(3)] for x in range(3)]
#: Shingles hashed in one exploded row: for maps, and for minhashes (a power of two).
STEP, SIGNED = 4, 4
#: Bits of the map by which lines that are no candidates leave before a shuffle: a few MB at most.
MAP = 1 << 24
#: Bits of a sketch, 64 in a number. With many more the join's condition gets too long for the JVM to compile.
SKETCH = 1536
#: Pairs of lines that a task verifies, as far as 16 times the session's shuffle partitions allow.
PAIRS = 1024
_ODD = 0x9E3779B97F4A7C15


def points(n: int) -> list[int]:
    """Fixed numbers spread over the signed 64-bit range."""
    return [(_ODD * (2 * k + 1)) % (1 << 64) - (1 << 63) for k in range(n)]


def told_apart(docs: DataFrame, id_col: str, row: str) -> tuple[DataFrame, bool]:
    """docs with a column `row`, and whether any has one: null where a row's id is its own, else a number.

    Rows that share an id or have none are stored with their numbers, so that these hold for good.
    """
    key, own = fresh(docs, "key", "own")
    ids = docs.select(F.col(id_col).cast("long").alias(own))
    ids = store(ids.groupBy(own).agg(F.count("*").alias("rows")).where(F.col(own).isNull() | (F.col("rows") > 1)).select(F.col(own).alias(key)))
    if ids.isEmpty():
        return docs.withColumn(row, F.lit(None).cast("long")), False
    same = F.col(id_col).cast("long").eqNullSafe(F.col(key))
    shared = store(docs.join(ids, same, "left_semi").withColumn(row, F.monotonically_increasing_id()))
    return docs.join(ids, same, "left_anti").withColumn(row, F.lit(None).cast("long")).unionByName(shared), True


def split_lines(docs: DataFrame, id_col: str, text_col: str, row: str) -> DataFrame:
    """(doc_id, r, line_no, line, c, e), r being the row's number and c, e two hashes of the line, of lines that hold more than white space."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(row).alias("r"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    rows = rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return rows.withColumn("c", F.xxhash64("line")).withColumn("e", F.xxhash64(F.lit(7), "line"))


def place():
    """A line's place: its document's id, then its number there; null without an id."""
    return F.expr("cast(cast(doc_id as decimal(20, 0)) * 10000000000BD + line_no as decimal(38, 0))")


def signatures(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """(n, c, e, place, weight, keys) of each different line: a number of its own, its two hashes, first place, how often it occurs, and a key for each band.

    Places come from marks, a line once: among the rows of shingles a place of 38 digits costs a third of the minhashes.
    """
    last = F.expr(f"greatest(1, octet_length(u) - {2 * WIDTH - 1})")
    rows = lines.select("c", "e", F.encode("line", "UTF-16BE").alias("u")).withColumn("last", last)
    rows = rows.select("c", "e", "u", "last", F.expr(f"explode(sequence(1, last, {2 * SIGNED}))").alias("at"))
    hashes = [F.expr(f"xxhash64(substring(u, if(at + {2 * j} < last, at + {2 * j}, last), {2 * WIDTH}))").alias(f"h{j}") for j in range(SIGNED)]
    rows = rows.select("c", "e", *hashes)
    turned = [(F.expr(f"shiftleft(h{j}, {r}) | shiftrightunsigned(h{j}, {64 - r})") if r else F.col(f"h{j}")).alias(f"r{r}_{j}") for r in TURNS for j in range(SIGNED)]
    rows = rows.select("c", "e", *turned)
    rows = rows.select("c", "e", *(F.expr(f"r{r}_{j} ^ {p}L").alias(f"m{k}_{j}") for k, (r, p) in enumerate((r, p) for r in TURNS for p in points(3)) for j in range(SIGNED)))
    left = SIGNED
    while left > 1:  # two at a time: columns that cannot be null compare faster than least() does
        left //= 2
        rows = rows.select("c", "e", *(F.expr(f"if(m{k}_{j} < m{k}_{j + left}, m{k}_{j}, m{k}_{j + left})").alias(f"m{k}_{j}") for k in range(3 * len(TURNS)) for j in range(left)))
    nearest = [F.min(f"m{k}_0") for k in range(3 * len(TURNS))]
    hashed = rows.groupBy("c", "e").agg(*(m.alias(f"m{k}") for k, m in enumerate(nearest)))
    whole = hashed.join(marks.groupBy("c", "e").agg(F.min(place()).alias("place"), F.count("*").alias("weight")).hint("merge"), ["c", "e"])
    keys = F.array(*(F.xxhash64(F.lit(b), *(f"m{k}" for k in band)) for b, band in enumerate(BANDS)))
    return store(whole.select(F.monotonically_increasing_id().alias("n"), "c", "e", "place", "weight", keys.alias("keys")))


def shingle_hashes(units: str):
    """Explodes a column of UTF-16 bytes into (at, units); shingle_hash() of those is the shingle's hash."""
    return F.expr(f"explode(sequence(1, greatest(1, octet_length({units}) - {2 * WIDTH - 1}), 2))")


def shingle_hash(units: str):
    return F.expr(f"xxhash64(substring({units}, at, {2 * WIDTH}))")


def in_map(ids: DataFrame, rows: DataFrame, col: str) -> DataFrame:
    """Rows whose number in col may be among those of ids; a map of MAP bits, at most MAP / 64 rows of a number each, goes to every task."""
    bit = F.pmod(F.col(col), F.lit(MAP))
    words = ids.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    rows = rows.withColumn("bit", bit).withColumn("own", F.expr("bit div 64"))
    return rows.join(F.broadcast(words), F.col("own") == F.col("word")).where("(shiftright(bits, cast(bit % 64 as int)) & 1L) = 1L").drop("bit", "own", "word", "bits")


def mapped(texts: DataFrame) -> DataFrame:
    """(n, size, s0, s1, ...): each line's count of shingles, repeated ones too, and the bits, of SKETCH, to which one falls.

    Two maps differ in at most as many bits as there are shingles in one line alone, whatever the hashes are.
    """
    rows = texts.select("n", F.encode("line", "UTF-16BE").alias("u")).withColumn("last", F.expr(f"greatest(1, octet_length(u) - {2 * WIDTH - 1})"))
    rows = rows.select("n", "u", "last", F.expr(f"explode(sequence(1, last, {2 * STEP}))").alias("at"))
    rows = rows.select("n", "last", *(F.expr(f"xxhash64(substring(u, least(at + {2 * j}, last), {2 * WIDTH}))").alias(f"h{j}") for j in range(STEP)))
    at = [F.expr(f"pmod(shiftright(h{j}, 6), {SKETCH // 64})").alias(f"p{j}") for j in range(STEP)]
    rows = rows.select("n", "last", *at, *(F.expr(f"shiftleft(1L, cast(h{j} & 63 as int))").alias(f"b{j}") for j in range(STEP)))
    words = [F.bit_or(F.expr(" | ".join(f"if(p{j} = {k}, b{j}, 0L)" for j in range(STEP)))).alias(f"s{k}") for k in range(SKETCH // 64)]
    return store(rows.groupBy("n").agg(F.expr("cast(max(last + 1) div 2 as long)").alias("size"), *words))


def possible(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose maps do not rule a link out; no link is lost, as at most (100 - percent) / (100 + percent) of two linked sets' sizes are in one alone."""
    words = [f"s{k}" for k in range(SKETCH // 64)]
    left, right = (maps.select(F.col("n").alias(f"n{x}"), *(F.col(c).alias(f"{c}{x}") for c in ("size", *words))) for x in "ab")
    differ = " + ".join(f"bit_count({w}a ^ {w}b)" for w in words)
    both = pairs.join(left, F.col("a") == F.col("na")).join(right, F.col("b") == F.col("nb"))
    return both.where(f"{100 + percent} * ({differ}) <= {100 - percent} * (sizea + sizeb)").select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of lines whose full sets are alike: 100 * intersection >= percent * union."""
    left = texts.select(F.col("n").alias("na"), F.col("line").alias("la"))
    right = texts.select(F.col("n").alias("nb"), F.col("line").alias("lb"))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, min(16 * parts, -(-pairs.count() // PAIRS)))
    both = pairs.join(left, F.col("a") == F.col("na")).select("a", "b", "la").join(right, F.col("b") == F.col("nb")).select("a", "b", "la", "lb").repartition(parts, "a", "b")
    sides = both.select("a", "b", F.expr("explode(array(struct(1 as side, encode(la, 'UTF-16BE') as u), struct(2 as side, encode(lb, 'UTF-16BE') as u))) as s")).select("a", "b", "s.side", "s.u")
    each = sides.select("a", "b", "side", "u", shingle_hashes("u").alias("at")).select("a", "b", "side", shingle_hash("u").alias("h"))
    each = each.groupBy("a", "b", "h").agg(F.bit_or("side").alias("sides"))
    alike = each.groupBy("a", "b").agg(F.count_if(F.col("sides") == 3).alias("both"), F.count("*").alias("any"))
    return alike.where(100 * F.col("both") >= percent * F.col("any")).select("a", "b")


def sketched(texts: DataFrame) -> DataFrame:
    """(o, size, s0, s1, ...): how many different shingles each line has, and the parity of those that fall to each of SKETCH bits.

    Two sketches differ in at most as many bits as there are shingles in one line alone, whatever the hashes are.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, min(16 * parts, -(-texts.count() // PAIRS)))
    each = texts.repartition(parts, "n").select("n", F.encode("line", "UTF-16BE").alias("u")).select("n", "u", shingle_hashes("u").alias("at")).select("n", shingle_hash("u").alias("h")).distinct()
    # a number of 64 bits at a time, then a line's numbers side by side: a shingle costs one update instead of one for each number
    each = each.select("n", F.expr(f"pmod(shiftright(h, 6), {SKETCH // 64})").alias("place"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    each = each.groupBy("n", "place").agg(F.count("*").alias("held"), F.bit_xor("bit").alias("bits"))
    words = [F.bit_xor(F.expr(f"if(place = {k}, bits, 0L)")).alias(f"s{k}") for k in range(SKETCH // 64)]
    return store(each.groupBy(F.col("n").alias("o")).agg(F.sum("held").alias("size"), *words))


def across(named: DataFrame, signed: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of lines of different components that share a band and whose sketches do not rule a link out; no link is lost.

    named: (key, n, g), the rows, but for the leader's, of bands that hold several components. A pair comes from the first band that it shares.
    Of a link, at most (100 - percent) / (100 + percent) of the two sets' sizes are in one set alone. The
    sketches stand in columns that are never null, which keeps the join's condition short when compiled.
    """
    own = named.select(F.col("n").alias("o")).distinct()
    sketch = sketched(store(texts.join(own, F.col("n") == F.col("o"), "left_semi")))
    wide = signed.select(F.col("n").alias("p"), "keys").join(sketch, F.col("p") == F.col("o")).drop("p")
    words = [f"s{k}" for k in range(SKETCH // 64)]
    rows = store(named.join(wide, F.col("n") == F.col("o")).selectExpr("key", "n", "g", "slice(keys, 1, int(array_position(keys, key)) - 1) as earlier", "size", *words))
    rows = rows.where(" and ".join(f"{c} is not null" for c in rows.columns))
    other = rows.select(*(F.col(c).alias(f"{c}_") for c in rows.columns))
    differ = " + ".join(f"bit_count({w} ^ {w}_)" for w in words)
    meets = f"key = key_ and n < n_ and g <> g_ and {100 + percent} * ({differ}) <= {100 - percent} * (size + size_) and not arrays_overlap(earlier, earlier_)"
    return rows.join(other, F.expr(meets)).selectExpr("n as a", "n_ as b")


def linked(signed: DataFrame, lines: DataFrame, percent: int, shared: bool) -> DataFrame:
    """(node, component) of the lines that are linked with others; shared: several lines may have one place."""
    bands = signed.select(F.explode("keys").alias("key"), "n", "weight")
    ends = bands.groupBy("key").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max_by("n", "weight").alias("a"))
    leads = store(ends.where("low < high").select(F.col("key").alias("k"), "a"))
    met = in_map(leads.select(F.col("k").alias("key")), bands.select("key", "n"), "key")
    members = store(met.join(leads.select(separate("k").alias("k"), "a"), F.col("key") == F.col("k")).select("key", "n", "a"))
    own = members.select(F.col("n").alias("m")).distinct()
    ids = store(signed.select("n", "c", "e", "place").join(own, F.col("n") == F.col("m"), "left_semi").select("n", F.col("c").alias("c2"), F.col("e").alias("e2"), F.col("place").alias("first")))
    near = in_map(ids.select(F.col("c2").alias("c")), lines.select("c", "e", "line", "doc_id", "line_no"), "c").withColumn("place", place())
    near = near.join(ids, (F.col("c") == F.col("c2")) & (F.col("e") == F.col("e2")) & F.col("place").eqNullSafe(F.col("first")))
    near = near.select("n", "line")
    texts = store(near.dropDuplicates(["n"]) if shared else near)
    led = members.where("n <> a")
    pairs = store(led.select(F.least("a", "n").alias("a"), F.greatest("a", "n").alias("b")).distinct())
    links = store(confirmed(store(possible(pairs, mapped(texts), percent)), texts, percent))
    groups = store(components(links))
    named = led.join(groups, F.col("n") == F.col("node"), "left").select("key", "n", F.coalesce("component", "n").alias("g"))
    several = named.groupBy("key").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 < g1").select(separate("key").alias("k"))
    named = store(named.join(several, F.col("key") == F.col("k"), "left_semi"))
    before = pairs.select(separate("a").alias("a_"), separate("b").alias("b_"))
    others = store(across(named, signed, texts, percent).join(before, (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_")), "left_anti"))
    groups = store(components(links.unionByName(store(confirmed(others, texts, percent)))))
    return groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct())


def line_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, line_no, first_doc, first_no, kept) of every line that holds more than white space.

    Lines of one component are alike by `percent` or linked by lines that are; (first_doc, first_no) is
    the component's least (doc_id, line_no), and kept marks that line. Lines are numbered from 0.
    Lines that share a band are first compared with the most frequent line of each of their bands, and then, in bands
    that still hold several components, all those of different components whose sketches do not rule a link out. Null texts and blank lines give no rows.
    A line of a null id is never first unless all of its component are; of rows that share an id or have none, and
    of lines that share the first place through them, one line of one row is kept, never more. An empty table gives no
    rows; very long lines count whole, and other columns of docs play no part.
    """
    row = fresh(docs, "row")[0]
    told, shared = told_apart(docs.select(id_col, text_col), id_col, row)
    return grouped(told, id_col, text_col, percent, row, shared).drop("r")


def grouped(docs: DataFrame, id_col: str, text_col: str, percent: int, row: str, shared: bool) -> DataFrame:
    """line_components() of rows told apart, with each row's number r."""
    ready_to_checkpoint(docs.sparkSession)
    lines = split_lines(docs, id_col, text_col, row)
    marks = store(lines.select("doc_id", "r", "line_no", "c", "e"))
    signed = signatures(lines, marks)
    groups = store(linked(signed, lines, percent, shared))
    owned = store(signed.select("n", "c", "e", "place").join(groups, F.col("n") == F.col("node")).select("component", "c", "e", "place"))
    first = owned.groupBy("component").agg(F.min("place").alias("first")).select(separate("component").alias("k"), "first")
    moved = owned.join(first, F.col("component") == F.col("k")).select("c", "e", "component", "first")
    # lines that occur once and are linked with none are their own first
    rest = signed.where("weight > 1").select("n", "c", "e", "place").join(groups, F.col("n") == F.col("node"), "left_anti").select("c", "e", F.col("n").alias("component"), F.col("place").alias("first"))
    ten = "10000000000BD"
    named = moved.unionByName(rest).select(F.col("c").alias("c2"), F.col("e").alias("e2"), "component", F.expr(f"cast(floor(first / {ten}) as long)").alias("doc2"), F.expr(f"cast(pmod(first, {ten}) as int)").alias("no2"))
    if shared:
        named = store(named)
    found = placed(marks, named)
    kept = F.expr("doc_id <=> first_doc and (doc_id is null or line_no = first_no)")
    if shared:
        # the rows that share an id or have none may hold several lines of one first place
        turn = F.expr("cast(cast(r as decimal(20, 0)) * 10000000000BD + line_no as decimal(38, 0))")
        best = placed(marks.where("r is not null"), named).where(kept & F.col("component").isNotNull()).groupBy(F.col("component").alias("k")).agg(F.min(turn).alias("turn"))
        found = found.join(best, F.col("component") == F.col("k"), "left")
        kept = kept & F.coalesce(turn == F.col("turn"), F.lit(True))
    return found.select("doc_id", "r", "line_no", "first_doc", "first_no", kept.alias("kept"))


def placed(marks: DataFrame, named: DataFrame) -> DataFrame:
    """Marks of lines with their component (null of a line that is alone) and its first place; a line that is alone is its own, without arithmetic on places."""
    found = marks.select("c", "e", "doc_id", "r", "line_no").join(named, (F.col("c") == F.col("c2")) & (F.col("e") == F.col("e2")), "left")
    alone = F.col("c2").isNull()
    return found.withColumn("first_doc", F.when(alone, F.col("doc_id")).otherwise(F.col("doc2"))).withColumn("first_no", F.when(alone, F.when(F.col("doc_id").isNotNull(), F.col("line_no"))).otherwise(F.col("no2")))


def dedupe(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents with one line of each component left; columns as before, whatever their names.

    A document that had lines and keeps none goes; blank lines of others stay, as do documents without
    lines (null or empty texts). A column `n_chars`, if there, is counted anew. Rows that share an id, have none or
    repeat wholly are rows of their own: of each component one line of one row stays. An empty table stays empty.
    """
    doc, r, row, gone_lines, parts, new = fresh(docs, "doc", "r", "row", "gone", "parts", "new")
    told, shared = told_apart(docs, id_col, row)
    gone = grouped(told, id_col, text_col, percent, row, shared).where("not kept")
    gone = gone.groupBy(F.col("doc_id").alias(doc), F.col("r").alias(r)).agg(F.collect_set("line_no").alias(gone_lines))
    rows = told.withColumn(parts, F.split(text_col, "\n")).drop(text_col)
    rows = rows.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(doc)) & F.col(row).eqNullSafe(F.col(r)), "left")
    whole = F.col(gone_lines).isNull()
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone_lines))
    rows = rows.withColumn(new, F.array_join(F.when(whole, F.col(parts)).otherwise(F.transform(stay, lambda i: F.get(parts, i))), "\n")).where(whole | F.col(new).rlike(r"[^\x20\x09-\x0D]"))
    counted = {c: F.when(whole, F.col(c)).otherwise(F.length(new)).cast(docs.schema[c].dataType) for c in docs.columns if c == "n_chars"}
    return rows.select(*(F.col(new).alias(c) if c == text_col else counted.get(c, F.col(c)).alias(c) for c in docs.columns))
