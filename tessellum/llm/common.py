"""What the operators share: the shared folder, stored tables, files, and connected components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Written tables of this application, dropped when it ends.
_SCRATCH: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder in the one that all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests, a laptop)
    a temporary folder of this machine is taken, and made the checkpoint folder too.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            base = own_dir(spark)
            spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/tessellum-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(_drop_all)
    _SCRATCH.append((spark, path))
    return path


def own_dir(spark: SparkSession) -> str:
    """A temporary folder of this machine, where executors run on it too; elsewhere the cluster must name a shared one."""
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="tessellum-")


def _drop_all() -> None:
    for spark, path in _SCRATCH:
        try:
            hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
        except Exception:  # noqa: BLE001  the JVM may be gone; the folder is the cluster's to clean
            return


def ready_to_checkpoint(spark: SparkSession) -> None:
    """See that ``checkpoint()`` has a folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own_dir(spark))


def store(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of one's own that no column of df has, in whatever case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def narrow_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of a few rows, so that batches of very long texts stay small in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def file_system(uri: str):
    """(pyarrow file system, path) of a URI of the shared folder; works on executors."""
    from pyarrow import fs

    uri = re.sub(r"^s3[an]:", "s3:", uri)
    if match := re.match(r"^(?:file:)?(?://)?(/.*)$", uri):
        return fs.LocalFileSystem(), match[1]
    return fs.FileSystem.from_uri(uri)


def separate(col: str):
    """The same number under an expression of its own.

    A join on it deals this side out anew, so that both sides come straight from an exchange and
    adaptive execution can split a partition that one key fills.
    """
    return F.col(col).bitwiseXOR(F.lit(0).cast("long"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph, (node, component); component is the smallest node.

    edges: (a long, b long), without nulls; loops and repeats do no harm. Nodes without an edge to
    another node are not returned. Alternates two steps that hang neighbours below the smallest of
    them, until the edges form stars. Edges between rounds are checkpointed, the smallest neighbour is
    taken before rows are joined, and a node with very many edges is split by adaptive execution.
    """
    ready_to_checkpoint(edges.sparkSession)
    stars = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    if stars.isEmpty():
        return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least.select(separate("a").alias("n"), "m"), F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").checkpoint()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.select(separate("a").alias("n"), "m"), F.col("a") == F.col("n"))
        stars = small.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct().checkpoint()
        ends = stars.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(stars.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    raise RuntimeError(f"components: no end after {max_rounds} rounds")
