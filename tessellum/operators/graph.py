"""Graph walks (G01-G05): loops of joins with a visited set, cut by reliable checkpoints."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables that stored() wrote, dropped when the application ends.
_STORED: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one of this machine only where executors run on it too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or "file://" + tempfile.mkdtemp(prefix="tessellum-")


def ready(spark: SparkSession) -> None:
    """See that checkpoint() has a folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: lineage ends, and with it the constraints that a checkpoint carries on, which joins of a table with itself double each time."""
    spark = df.sparkSession
    ready(spark)
    path = dropped_at_end(spark, f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/stored-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped_at_end(spark: SparkSession, path: str) -> str:
    """The path of a folder that goes when this application ends."""
    if not _STORED:
        atexit.register(_drop_stored)
    _STORED.append((spark, path))
    return path


def _drop_stored() -> None:
    for spark, path in _STORED:
        try:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        except Exception:  # noqa: BLE001  the JVM may be gone; the folder is the cluster's to clean
            return


#: Tasks that a join on few values is dealt to, and shares that the rows of one value are dealt to.
TASKS, SHARES = 64, 32


def dealt(rows: DataFrame, others: DataFrame, keys: list[str], shares: int = SHARES, tasks: int = TASKS, *, again: bool = False) -> DataFrame:
    """The inner join of keys that few values fill: rows of a value are dealt to shares that each meet all its others, so no value is one task's.

    The number of tasks is given, since sizes, which adaptive execution goes by, tell nothing of how many rows come out.
    A row meets all others of its share in turn, or, `again`, each of the others all rows of the share.
    """
    many = rows.withColumn("_share", F.pmod(F.xxhash64(*rows.columns), F.lit(shares)).cast("int")).repartition(tasks, *keys, "_share")
    few = others.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    if again:
        return few.join(many.hint("merge"), [*keys, "_share"]).drop("_share")
    return many.join(few.hint("merge"), [*keys, "_share"]).drop("_share")  # so many copies are not to be broadcast


#: How many values of a key are a bunch at most, and how many tasks gather them.
BUNCH, GATHERED = 128, 8


def bunched(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values, unknown): up to BUNCH of a key's values a row, `unknown` with a null, which no list holds; rows: (key, value), each once."""
    lists = rows.groupBy(key, F.pmod(F.xxhash64(value), F.lit(GATHERED)).alias("_part")).agg(F.collect_list(value).alias("_all"), F.max(F.col(value).isNull()).alias("_unknown"))
    sized = lists.withColumn("_n", F.greatest(F.lit(1), F.ceil(F.size("_all") / BUNCH)).cast("int")).withColumn("_size", F.ceil(F.size("_all") / F.col("_n")).cast("int"))
    cut = sized.select(key, "_all", "_unknown", "_size", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i"))
    return cut.select(key, F.slice("_all", F.col("_i") * F.col("_size") + 1, F.col("_size")).alias("values"), (F.col("_unknown") & (F.col("_i") == 0)).alias("unknown"))


def hops(edges: DataFrame, anchors: DataFrame, hard: int = 10) -> DataFrame:
    """(node, hop): the fewest hops from any anchor, up to `hard`; cycles end by the visited set.

    edges: (src, dst); anchors: (node). Each round joins the frontier alone.
    """
    plain = stored(edges.select("src", "dst").distinct())  # each round reads it in splits, none makes it again or sorts it for a small frontier
    seen = frontier = stored(anchors.select("node").distinct().withColumn("hop", F.lit(0)))
    for hop in range(1, hard + 1):
        reached = frontier.join(plain, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = stored(reached.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def pending(edges: DataFrame, walked: DataFrame, hard: int = 10) -> DataFrame:
    """Neighbours beyond the last hop, as clues to follow later."""
    last = walked.where(F.col("hop") == hard)
    return last.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.col("src").alias("via")).join(walked.select("node"), "node", "left_anti").distinct()


def hop_class(soft: int = 5):
    """Beyond the soft stop only strong paths go on."""
    return F.when(F.col("hop") <= soft, "normal").otherwise("needs_reason")


def ledger(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """Edges with a status; verified stays verified, else the update holds; new edges join."""
    both = edges.alias("e").join(updates.alias("u"), ["src", "dst", "kind"], "full")
    status = F.when(F.col("e.status") == "verified", "verified").otherwise(F.coalesce("u.status", "e.status"))
    return both.select("src", "dst", "kind", status.alias("status"))


def impact(events: DataFrame, edges: DataFrame, references: DataFrame, hard: int = 10) -> DataFrame:
    """Targets that an event's variables reach; events: (node), references: (node, target)."""
    return hops(edges, events, hard).join(references, "node").groupBy("target").agg(F.min("hop").alias("hop"))


def degrees(files: DataFrame, links: DataFrame) -> DataFrame:
    """Links out and in of every file, whether it is an orphan, and its broken links."""
    out = links.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("n_out"))
    into = links.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("n_in"))
    broken = links.join(files.select(F.col("path").alias("dst")), "dst", "left_anti").groupBy(F.col("src").alias("path")).agg(F.count("*").alias("broken"))
    return files.select("path").join(out, "path", "left").join(into, "path", "left").join(broken, "path", "left").fillna(0).withColumn("orphan", (F.col("n_in") == 0) & (F.col("n_out") == 0))


def spread(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, value): the largest value that reaches a node along edges (src, dst), its own included.

    nodes: (node, value). After each step along all edges a node points at the neighbour that gave it
    most, and pointers are followed to where they lead, twice as far with every join; so a value crosses a
    cycle or a chain of n nodes in about log n joins. No table is larger than nodes and edges.
    """
    now, jumps = stored(nodes), 0
    while True:
        given = edges.join(now, F.col("src") == F.col("node")).groupBy("dst").agg(F.max(F.struct("value", "src")).alias("m"))
        step = stored(now.join(given, F.col("node") == F.col("dst"), "left").select("node", F.col("value").alias("old"), F.greatest("value", "m.value").alias("value"), F.col("m.src").alias("to")))
        if step.where("value > old").isEmpty():
            return now
        for _ in range(jumps):
            there = step.select(F.col("node").alias("n"), F.col("value").alias("v"), F.col("to").alias("t"))
            step = stored(step.join(there, F.col("to") == F.col("n"), "left").select("node", F.greatest("value", "v").alias("value"), F.col("t").alias("to")))
        now, jumps = step.select("node", "value"), max(1, 2 * jumps)


def _small_components(edges: pa.Table) -> pa.Table:
    """(node, component) of nodes that reach each other, by depth-first search with low links; for a graph known to be small."""
    nodes = sorted({*(pairs := edges.select(["src", "dst"]).to_pydict())["src"], *pairs["dst"]})
    out = {n: [] for n in nodes}
    for a, b in zip(pairs["src"], pairs["dst"]):
        out[a].append(b)
    number, low, stack, held, found = {}, {}, [], set(), []
    for root in nodes:
        path = [] if root in number else [(root, iter(out[root]))]
        while path:
            node, left = path[-1]
            if node not in number:
                number[node] = low[node] = len(number)
                stack.append(node)
                held.add(node)
            for other in left:
                if other not in number:
                    path.append((other, iter(out[other])))
                    break
                if other in held:
                    low[node] = min(low[node], number[other])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == number[node]:
                    group = []
                    while not group or group[-1] != node:
                        group.append(stack.pop())
                    held.difference_update(group)
                    if len(group) > 1:
                        found += [(n, min(group)) for n in group]
    kind = edges.schema.field("src").type
    return pa.table({"node": pa.array([n for n, _ in found], kind), "component": pa.array([c for _, c in found], kind)})


def recurring(edges: DataFrame, small: int = 0) -> DataFrame:
    """Of edges (src, dst) with one of each src, those of nodes that some long enough path ends in, every cycle's among them; at most `small`, or cycles alone.

    Each round knows where twice as many steps lead and keeps the nodes that such a path reaches and that lead on. What is
    not on a cycle halves about with every round; a round that keeps all has only cycles left.
    """
    jump = stored(edges.select("src", "dst"))
    left = jump.count()
    while left > small:
        kept = jump.join(jump.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        jump = stored(kept.join(kept.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst")))
        now = jump.count()
        if now == left:
            break
        left = now
    return edges.join(jump.select("src"), "src", "left_semi").select("src", "dst")


def strongly_connected(edges: DataFrame, trims: int = 2, small: int = 100_000) -> DataFrame:
    """(node, component) of every node on a cycle, of whatever length; component is the least node of those that reach each other.

    Each round gives nodes a new random rank and colours each with the highest that reaches it. A colour's own
    node and those of the colour that reach it back are a component; edges between colours lead nowhere and go,
    as do, before, nodes without an edge in or out. Ranks being random, the rounds grow with the logarithm of
    what is left, until no more than `small` edges are, by count; those are searched in one task. Where every node has one
    edge out at most, what is on no cycle goes before by recurring(). Null ends of edges
    play no part; a loop is a cycle of one node.
    """
    ready(edges.sparkSession)
    plain = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    loops = plain.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    live, done, seed = stored(plain.where("src <> dst")), [], 0
    if live.count() > small and live.agg(F.count("*") == F.count_distinct("src")).first()[0]:
        live = stored(recurring(live, small))
    while not live.isEmpty():
        for _ in range(trims):
            live = live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            live = live.join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        live = stored(live)
        if live.count() <= small:
            kind = live.schema["src"].dataType.simpleString()
            rest = live.groupBy(F.lit(0).alias("all")).applyInArrow(_small_components, f"node {kind}, component {kind}")
            done.append(stored(rest.select("node", F.col("component").alias("colour"))))
            break
        nodes = live.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        ranked = nodes.select("node", F.struct(F.xxhash64(F.lit(seed), "node").alias("rank"), F.col("node").alias("top")).alias("value"))
        coloured = stored(spread(ranked, live).select("node", F.col("value.top").alias("colour")))
        ends = [coloured.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour")) for end in ("src", "dst")]
        inside = stored(live.join(ends[0], "src").join(ends[1], "dst").where("src_colour = dst_colour").select("src", "dst"))
        back = spread(coloured.select("node", F.expr("if(node = colour, 1, 0)").alias("value")), inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        whole = stored(back.where("value = 1").select("node").join(coloured, "node"))
        done.append(whole)
        gone = whole.select("node")
        live = stored(inside.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
        seed += 1
    if not done:
        return loops
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    least = found.groupBy("colour").agg(F.min("node").alias("component"), F.count("*").alias("n"))
    several = found.join(least.where("n > 1"), "colour").select("node", "component")
    return several.unionByName(loops.join(several.select("node"), "node", "left_anti"))


def acyclic(calls: DataFrame) -> DataFrame:
    """Functions that reach themselves through calls (src, dst), over cycles of any length; a sound call graph has none."""
    return strongly_connected(calls).select(F.col("node").alias("src"))


def walk(edges: DataFrame, anchors: DataFrame, soft: int = 5, hard: int = 10) -> tuple[DataFrame, DataFrame]:
    """(states, clues) of a walk that knows which way it goes.

    edges: (src, dst, way, reason), way being up, down or parallel and reason why such a step may find what a
    shorter one does not; anchors: (node). A state is a node with the way of the step that led to it. states:
    (node, way, hop, path); of the paths of the fewest hops the least is kept, from its anchor on. A step past
    `soft` hops needs a reason, none goes past `hard`. clues: (node, way, hop, path, reason, stop), the states
    that were left out, with the hop they would have had and the stop, soft or hard, that held them back.
    Edges with a null end or way are none; of repeated ones the greatest reason counts. Edges are dealt by no key, so
    a node with very many is no task of its own; each round joins the new states alone.
    """
    plain = stored(edges.where("src is not null and dst is not null and way is not null").groupBy("src", "dst", "way").agg(F.max("reason").alias("reason")))
    way = F.lit("anchor")
    seen = frontier = stored(anchors.where("node is not null").select("node", way.alias("way")).distinct().withColumn("hop", F.lit(0)).withColumn("path", F.array(F.struct("node", "way"))))
    left = None
    for hop in range(1, hard + 2):
        to = frontier.select(F.col("node").alias("_from"), "path").join(plain, F.col("_from") == F.col("src"))
        to = to.select(F.col("dst").alias("node"), "way", F.lit(hop).alias("hop"), F.concat("path", F.array(F.struct(F.col("dst").alias("node"), "way"))).alias("path"), "reason")
        if hop > soft:
            held = to if hop > hard else to.where("reason is null")
            held = stored(held.groupBy("node", "way", "hop").agg(F.min(F.struct("path", "reason")).alias("x")).select("node", "way", "hop", "x.path", "x.reason").withColumn("stop", F.lit("hard" if hop > hard else "soft")))
            left = held if left is None else left.unionByName(held)
            to = to.where("reason is not null")
        if hop > hard:
            break
        frontier = stored(to.groupBy("node", "way", "hop").agg(F.min("path").alias("path")).join(seen.select("node", "way"), ["node", "way"], "left_anti").select("node", "way", "hop", "path"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    if left is None:
        left = seen.where("false").select("*", F.lit(None).cast("string").alias("reason"), F.lit("soft").alias("stop"))
    first = left.groupBy("node", "way").agg(F.min(F.struct("hop", "path", "reason", "stop")).alias("x")).select("node", "way", "x.*")
    return seen, first.join(seen.select("node", "way"), ["node", "way"], "left_anti")
