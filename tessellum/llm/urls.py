"""URL filters: explicit rules, and a path-template tree that judges what no rule decides.

The tree is grown level by level over all rows at once, by counts: below each node of each host, path
segments that are common stay as they are, all others become a wildcard. Rules label the rows that they
decide; templates are rejected by their labelled purity, smoothed towards the node above.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.llm.common import separate, shared_dir, store

#: (verdict, host and path): a rule fits its host and all subdomains, where the path starts with the rule's.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: A literal segment has at least SUPPORT rows and SHARE of its node's.
SUPPORT, SHARE = 8, 1 / 64
#: Purity of what nothing is known about, rows that it weighs, and the purity below which a template is rejected.
PRIOR, WEIGHT, LEAST = 0.9, 4.0, 0.4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str):
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; '' without one."""
    return F.translate(F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str):
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: str, path: str, rules=RULES):
    """The longest rule that fits, else null; of equally long ones a block comes first."""
    found = F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):  # the last condition is asked first
        name, slash, rest = rule.partition("/")
        fits = ((F.col(host) == name) | F.col(host).endswith(f".{name}")) & F.col(path).startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def templates(rows: DataFrame, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """Rows with (host, path) gain `template`: their path with rare segments as wildcards.

    Where fewer than `support` rows go on below a node, nothing can be common any more and the rest of
    their paths is one `**`. A level sees only the rows that go on; those that ended stay where they were
    written, so the depth has no bound.
    """
    spark, path = rows.sparkSession, shared_dir(rows.sparkSession)
    rows = rows.withColumn("segments", F.expr("filter(split(path, '/'), x -> x <> '')")).withColumn("template", F.lit(""))
    rows = rows.withColumn("ended", F.size("segments") == 0)
    schema, parts = rows.schema, []

    def kept(found: DataFrame) -> DataFrame:
        parts.append(f"{path}/{len(parts)}")
        found.write.option("compression", "zstd").parquet(parts[-1])
        return spark.read.schema(schema).parquet(parts[-1])

    going = kept(rows).where("not ended")
    while not going.isEmpty():
        level = len(parts) - 1
        going = going.withColumn("segment", F.get("segments", F.lit(level))).withColumn("node", F.xxhash64("host", "template"))
        below = going.groupBy("node", "segment").agg(F.count("*").alias("n"))
        total = below.groupBy(F.col("node").alias("t")).agg(F.sum("n").alias("total")).where(F.col("total") >= support)
        # at most 1 / share of a node's children stay, whatever their number
        common = below.where((F.col("n") >= support) & ~F.col("segment").rlike("^[0-9]+$")).join(total, F.col("node") == F.col("t")).where(F.col("n") >= share * F.col("total"))
        common = common.groupBy(F.col("t").alias("c")).agg(F.collect_list("segment").alias("literals"))
        nodes = total.join(common, F.col("t") == F.col("c"), "left").select(separate("t").alias("k"), "literals")
        going = going.join(nodes, F.col("node") == F.col("k"), "left")
        step = F.expr("case when k is null then '/**' when array_contains(literals, segment) then concat('/', segment) else '/*' end")
        going = going.withColumn("template", F.concat("template", step)).withColumn("ended", F.col("k").isNull() | (F.size("segments") <= level + 1))
        going = kept(going.select(*schema.names)).where("not ended")
    return spark.read.schema(schema).parquet(*parts).where("ended").drop("segments", "ended")


def merged(branches: pd.DataFrame, prior: float, weight: float, z: float = 1.96) -> pd.DataFrame:
    """Numbers the groups of branches below one group of nodes, best to worst: a branch whose labelled purity does not differ significantly joins the group before it. `beside` is what they say of a branch without labels, each of them counting once."""
    rows = sorted(zip(branches["name"], branches["good"].tolist(), branches["labelled"].tolist(), strict=True), key=lambda x: (-x[1] / x[2], x[0]))
    number, g0, n0, groups = -1, 0, 0, []
    for _, g1, n1 in rows:
        p = (g0 + g1) / (n0 + n1)
        if number >= 0 and abs(g0 / n0 - g1 / n1) <= z * math.sqrt(max(p * (1 - p), 1e-9) * (1 / n0 + 1 / n1)):
            g0, n0 = g0 + g1, n0 + n1
        else:
            number, g0, n0 = number + 1, g1, n1
        groups.append(number)
    beside = (math.fsum(g / n for _, g, n in rows) + weight * prior) / (len(rows) + weight)
    return pd.DataFrame({"b": branches["b"].iloc[0], "name": [r[0] for r in rows], "number": groups, "beside": beside})


def purities(known: DataFrame, prior: float = PRIOR, weight: float = WEIGHT, least: float = LEAST) -> DataFrame:
    """(host, template, purity, rejected) of (host, template, good, labelled), level by level from the hosts' roots.

    A node has the labels of all templates below it. Siblings whose labelled purities do not differ
    significantly are merged, best to worst, with all that is below them; a branch without labels has
    none that could be compared, so it stays alone. A group's purity is smoothed towards the mean of the
    group above and the prior. A branch without labels is judged by its labelled siblings, each branch being one
    piece of evidence whatever its rows, with the prior; without such siblings it has the purity of the node above. One task of a level sees, of one group of nodes, the counts of its labelled
    branches by name: at most 1 / SHARE literals a node.
    """
    # in a group's name, / parts what a host and a segment cannot hold
    parts, up = F.split("template", "/"), F.col("level")
    rows = known.select("host", "good", "labelled", parts.alias("parts"), F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("level"))
    node, parent = (F.array_join(F.slice("parts", F.lit(1), n), "/") for n in (up + 1, up))
    rows = rows.select("host", "level", node.alias("node"), F.when(up > 0, parent).alias("parent"), F.get("parts", up).alias("name"), "good", "labelled", (F.size("parts") == up + 1).alias("whole"))
    tree = store(rows.groupBy("host", "level", "node", "parent", "name").agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled"), F.max("whole").alias("whole")))
    here = tree.where("level = 0").select("host", "node", "good", "labelled", "whole", F.concat("host", F.lit("/")).alias("g"), F.lit(prior).alias("above"))
    found, level = None, 0
    while True:
        own = here.groupBy(F.col("g").alias("k")).agg(((F.sum("good") + weight * F.first("above")) / (F.sum("labelled") + weight)).alias("purity"))
        done = store(here.join(own, F.col("g") == F.col("k")).select("host", "node", "g", "purity", "whole"))
        found = done if found is None else found.unionByName(done)
        level += 1
        above = done.select(F.col("host").alias("h"), F.col("node").alias("p"), "g", "purity")
        below = store(tree.where(F.col("level") == level).join(above, (F.col("host") == F.col("h")) & (F.col("parent") == F.col("p"))).select("host", "node", "name", "good", "labelled", "whole", "g", "purity"))
        if below.isEmpty():
            break
        branches = below.groupBy(F.col("g").alias("b"), "name").agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled")).where("labelled > 0")
        numbered = store(branches.groupBy("b").applyInPandas(lambda group: merged(group, prior, weight), "b string, name string, number long, beside double").withColumnRenamed("name", "branch"))
        siblings = numbered.groupBy(F.col("b").alias("s")).agg(F.max("beside").alias("told")).select("s", "told")
        group = F.when(F.col("number").isNull(), F.concat("g", F.lit("/u/"), "name")).otherwise(F.concat("g", F.lit("/"), "number"))
        above = F.when(F.col("number").isNotNull(), (F.col("purity") + prior) / 2).otherwise(F.coalesce("told", "purity"))
        below = below.join(numbered.drop("beside"), (F.col("g") == F.col("b")) & (F.col("name") == F.col("branch")), "left").join(siblings, F.col("g") == F.col("s"), "left")
        here = store(below.select("host", "node", "good", "labelled", "whole", group.alias("g"), above.alias("above")))
    return found.where("whole").select("host", F.col("node").alias("template"), "purity", (F.col("purity") < least).alias("rejected"))


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of each row.

    A null url, or one without ://, has an empty host and path. Without labels a template keeps the
    prior's purity and is allowed. Repeated rows are judged alike; an empty table gives no rows.
    """
    verdicts = {rule: verdict for verdict, rule in rules}
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    rows = rows.withColumn("rule", rule_of("host", "path", rules))
    said = F.lit(None).cast("string")
    for rule, verdict in verdicts.items():
        said = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(said)
    rows = templates(rows.withColumn("said", said))
    known = rows.groupBy("host", "template").agg(F.count_if(F.col("said") == "allow").alias("good"), F.count("said").alias("labelled"))
    judged = store(purities(known).withColumn("k", F.xxhash64("host", "template"))).select(separate("k").alias("k"), "purity", "rejected")
    rows = rows.withColumn("node", F.xxhash64("host", "template")).join(judged, F.col("node") == F.col("k"))
    verdict = F.coalesce("said", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return rows.select(F.col("page_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
