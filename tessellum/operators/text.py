"""Terms and names in running text of any script: one normal form, discovered terms, and many names at once.

A text's normal form has a space on either side of every token: a word of letters and digits, or one
character of a script written without spaces. A name occurs in a text where its normal form is part of
the text's, which for words means whole words and for unsegmented scripts any place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.functions.scalar import UNSEGMENTED
from tessellum.operators.graph import bunched, dealt, stored


def spaced(text: Column) -> Column:
    """The normal form, ' ' for a text without tokens, null for null."""
    apart = F.regexp_replace(F.lower(text), f"({UNSEGMENTED})", " $1 ")
    inner = F.trim(F.regexp_replace(apart, r"[^\p{L}\p{N}]+", " "))
    return F.when(inner == "", " ").otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def _tokens(form: Column) -> Column:
    return F.filter(F.split(form, " "), lambda w: w != "")


def _pairs(tokens: Column) -> Column:
    return F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


#: Names of a topic that are held against each other, at most.
COMPARED = 64
#: Names up to so many keys are given to every task; more meet the texts in a shuffle.
FEW = 100_000


def _met(rows: DataFrame, keys: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined to stored keys: the sizes that Spark guesses for exploded texts are too small by far, so which side goes to all tasks is said here."""
    return rows.join(keys.hint("broadcast" if keys.count() <= FEW else "merge"), "key", how)


def occurrences(texts: DataFrame, names: DataFrame, *, id_col: str = "id", text_col: str = "text", name_col: str = "name") -> DataFrame:
    """(id, name) of every name that occurs in a text, each pair once.

    A name is looked up by one key: its token, or the pair of neighbouring tokens that the fewest texts have; a
    name with a pair that no text has is out at once. Names of one or two tokens are then found, longer
    ones are held against the texts that share their key. Keys meet in an equi join, so nothing is
    tried name by text; where names are few, by count, their keys go to all tasks and no word of a text is shuffled. Null texts,
    null names and names without tokens occur nowhere.
    """
    known = stored(names.select(F.col(name_col).alias("name"), spaced(F.col(name_col)).alias("form")).where("form <> ' '").distinct())
    return _present(texts, known.select("form").distinct(), id_col, text_col).join(known, "form").select("id", "name").distinct()


def _present(texts: DataFrame, forms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, form), each once, of the normal forms that occur in a text's; forms: (form), each once."""
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").withColumn("h", F.xxhash64("text"))
    tokens = _tokens(spaced(F.col("text")))
    keys = rows.select("id", "h", tokens.alias("w")).select("id", "h", F.explode(F.array_distinct(F.concat("w", _pairs(F.col("w"))))).alias("key"))
    forms = forms.withColumn("w", _tokens(F.col("form"))).withColumn("length", F.size("w"))
    forms = stored(forms.withColumn("keys", F.when(F.col("length") == 1, F.col("w")).otherwise(F.array_distinct(_pairs(F.col("w"))))).select("form", "length", "keys", F.size("keys").alias("n")))
    several = forms.where("n > 1").select("form", "length", "n", F.explode("keys").alias("key"))
    found = _met(keys, stored(several.select("key").distinct()), "left_semi").groupBy("key").agg(F.count("*").alias("texts"))
    rarest = several.join(found, "key").groupBy("form", "length", "n").agg(F.min_by("key", F.struct("texts", "key")).alias("key"), F.count("*").alias("met")).where("met = n")
    anchors = stored(forms.where("n = 1").select("form", "length", F.col("keys")[0].alias("key")).unionByName(rarest.select("form", "length", "key")))
    met = stored(_met(keys, anchors).select("id", "h", "form", "length"))
    tried = met.where("length > 2").groupBy("id", "h").agg(F.collect_set("form").alias("forms")).withColumnsRenamed({"id": "id_", "h": "h_"})
    held = rows.join(tried, F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_"))).withColumn("whole", spaced(F.col("text")))
    long = held.select("id", F.explode(F.filter("forms", lambda f: F.contains(F.col("whole"), f))).alias("form"))
    return met.where("length <= 2").select("id", "form").unionByName(long).distinct()


def misfiled(todos: DataFrame, topics: DataFrame, general: tuple[str, ...]) -> DataFrame:
    """(todo, section, topic) of todos that stand in a general section and name a tracked topic.

    todos: (todo, section, text); topics: (topic, name), several names of a topic allowed. It is advice: nothing is moved.
    A name that holds another one of its topic says nothing more. Topics left with one and the same name meet a todo by
    it, bunch by bunch, and are only put out, never shuffled or told apart; what several different names tell of a topic
    is made one for each todo and class, topics of the same names being one class.
    """
    place = F.struct("todo", "section")
    rows = todos.where(F.col("section").isin(*general)).select(place.alias("place"), "text")
    of = topics.select("topic", spaced(F.col("name")).alias("form")).where("form <> ' '").groupBy("topic").agg(F.sort_array(F.collect_set("form")).alias("forms"))
    shortest = F.filter("forms", lambda f: ~F.exists("forms", lambda g: (g != f) & F.contains(f, g)))
    forms = F.when(F.size("forms") <= COMPARED, shortest).otherwise(F.col("forms"))
    of = stored(of.select("topic", forms.alias("forms")).withColumn("key", F.when(F.size("forms") == 1, F.col("forms")[0]).otherwise(F.sha2(F.to_json("forms"), 256))))  # a form begins with a space
    found = stored(_present(rows, of.select(F.explode("forms").alias("form")).distinct(), "place", "text"))
    several = of.where("size(forms) > 1").groupBy("key").agg(F.first("forms").alias("forms")).select("key", F.explode("forms").alias("form"))
    places = found.select("id", F.col("form").alias("key")).unionByName(found.join(several, "form").select("id", "key").distinct())
    met = dealt(places, bunched(of.select("key", "topic"), "key", "topic"), ["key"], 8, again=True)  # most keys are of few topics
    return met.select("id.todo", "id.section", F.explode(F.when(F.col("unknown"), F.concat("values", F.array(F.lit(None)))).otherwise(F.col("values"))).alias("topic"))


def _runs(posts: DataFrame) -> DataFrame:
    """(post, run) of the stretches of unsegmented characters."""
    return posts.select("post", F.explode(F.regexp_extract_all("text", F.lit(f"({UNSEGMENTED}+)"))).alias("run"))


def _counted_grams(runs: DataFrame, longest: int) -> DataFrame:
    """(gram, n): how often each run of up to `longest` characters occurs. Places are counted by the longest run that begins there, and shorter ones are its beginnings."""
    # a look ahead at each place is one pass, where substring() counts a run's characters from its beginning for every place
    places = runs.select(F.explode(F.regexp_extract_all("run", F.lit(f"(?s)(?=(.{{1,{longest}}}))"))).alias("longest")).groupBy("longest").agg(F.count("*").alias("n"))
    begins = places.select("n", F.explode(F.expr("transform(sequence(1, length(longest)), m -> substring(longest, 1, m))")).alias("gram"))
    return begins.groupBy("gram").agg(F.sum("n").alias("n"))


def discovered(posts: DataFrame, *, longest: int = 4, at_least: int = 5, cohesion: float = 20.0, freedom: float = 1.0) -> DataFrame:
    """(term, n, tied, left, right): words of unsegmented text, found by counts alone.

    A term is a run of 2 to `longest` characters that occurs often enough; that occurs at least `cohesion` times as
    often as either way to cut it would by chance (`tied` is the least ratio); and whose neighbours on both sides
    have an entropy of at least `freedom` bits, the end of a run being a neighbour too. All numbers come from one
    table of counted runs of characters: the right neighbours of a run are the runs one longer that it begins.
    posts: (post, text); null texts have no runs.
    """
    marked = _runs(posts).select(F.concat(F.lit("^"), "run", F.lit("$")).alias("run"))
    counts = stored(_counted_grams(marked, longest + 1))
    plain = counts.where(~F.col("gram").rlike(r"[\^$]"))
    total = plain.where("length(gram) = 1").agg(F.sum("n").cast("double").alias("total"))
    words = plain.where((F.length("gram") >= 2) & (F.length("gram") <= longest) & (F.col("n") >= at_least))
    cuts = words.select("gram", "n", F.explode(F.expr("sequence(1, length(gram) - 1)")).alias("i")).select("gram", "n", F.expr("substring(gram, 1, i)").alias("a"), F.expr("substring(gram, i + 1)").alias("b"))
    parts = cuts.join(plain.select(F.col("gram").alias("a"), F.col("n").alias("na")), "a").join(plain.select(F.col("gram").alias("b"), F.col("n").alias("nb")), "b")
    tied = parts.crossJoin(F.broadcast(total)).groupBy("gram").agg(F.min(F.expr("(n * total) / (cast(na as double) * nb)")).alias("tied")).where(F.col("tied") >= cohesion)  # total is one row

    def entropy(side: str, core: str) -> DataFrame:
        beside = counts.where("length(gram) >= 3").select(F.expr(core).alias("gram"), F.col("n").cast("double").alias("n")).groupBy("gram")
        bits = F.round(F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n"), 9)
        return beside.agg(bits.alias(side)).where(F.col(side) >= freedom)

    found = words.join(tied, "gram").join(entropy("right", "substring(gram, 1, length(gram) - 1)"), "gram").join(entropy("left", "substring(gram, 2)"), "gram")
    return found.select(F.col("gram").alias("term"), "n", "tied", "left", "right")


def post_terms(posts: DataFrame, words: DataFrame) -> DataFrame:
    """(post, term), each once: which discovered words occur in which posts. words: (term)."""
    known = stored(words.select("term").where("length(term) >= 2").distinct())  # of known size: where it is small, what runs of characters it has not are never shuffled
    lengths = known.select(F.length("term").alias("m")).distinct().groupBy().agg(F.collect_list("m").alias("lengths"))  # one row, at most as many as the longest term
    rows = posts.select("post", "text").where(F.col("text").rlike(UNSEGMENTED)).crossJoin(F.broadcast(lengths)).select("post", "text", F.explode("lengths").alias("m"))
    pattern = F.concat(F.lit(f"(?=({UNSEGMENTED}{{"), F.col("m").cast("string"), F.lit("}))"))
    grams = rows.select("post", F.explode(F.array_distinct(F.regexp_extract_all("text", pattern))).alias("term"))
    return grams.join(known, "term").select("post", "term").distinct()
