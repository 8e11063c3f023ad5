"""Near-duplicate embeddings by collision-counting projections.

Every vector is projected on many random lines and each projection is sorted, so a place in the order
stands for a value. For a query, a window centred on it in each order holds the vectors that collide
with it there; pairs that collide often enough are verified by their cosine. The least count is
calibrated: a pair at the threshold reaches it with probability `recall`.
"""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.llm.common import components, file_system, ready_to_checkpoint, separate, shared_dir, store

#: Projections, and the half width of a window in standard deviations of a threshold pair's distance.
PROJECTIONS, WIDTH = 32, 2.0
#: Vectors in a block, and blocks that a task compares with one.
BLOCK, REACH = 2048, 4


def least_count(projections: int, width: float, recall: float) -> int:
    """The largest count that a pair at the threshold reaches with probability `recall` at least.

    On a Gaussian line the pair's difference is normal, so it collides with one and the same
    probability on each, and the count is binomial; a closer pair collides more often.
    """
    p = math.erf(width / math.sqrt(2))
    below = 0.0
    for k in range(projections + 1):
        below += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if below > 1 - recall:
            return k
    return projections


def classes_of(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, c, v): c numbers equal vectors alike and is null, as is v, for those that link with nothing."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    fit = F.expr("v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    return rows.withColumn("v", F.when(fit, F.expr("transform(v, x -> x + 0.0D)"))).withColumn("c", F.expr("case when v is not null then xxhash64(v) end"))


def links(blocks: DataFrame, threshold: float, projections: int, width: float, recall: float, seed: int) -> DataFrame:
    """What block files hold of links between classes: rows (a, n) add n links to class a; rows (a, b) join classes.

    blocks: (number, path, rows). Each task compares one block, as queries, with a few others, so all
    rows are compared in blocks; what it emits is a count per class and a forest of joins, never the
    pairs of a dense group.
    """
    listed = sorted((r["number"], r["path"]) for r in blocks.collect())  # one row per block
    n = len(listed)
    spark = blocks.sparkSession
    need, radius = least_count(projections, width, recall), width * math.sqrt(2 - 2 * threshold)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, first, last in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                queries = load(listed[i][1])
                lines = np.random.default_rng(seed).standard_normal((queries["x"].shape[1], projections))
                at = queries["x"] @ lines
                for j in range(first, last):
                    other = queries if j == i else load(listed[j][1])
                    a, b = candidates(at, other["x"] @ lines, radius, need)
                    if j == i:
                        a, b = a[a < b], b[a < b]
                    keep = exact(queries["x"], other["x"], a, b, threshold)
                    a, b = a[keep], b[keep]
                    if not len(a):
                        continue
                    # a class's links: the vectors of the classes it links with
                    mine = np.bincount(a, other["n"][b], len(queries["c"])).astype(np.int64)
                    theirs = np.bincount(b, queries["n"][a], len(other["c"])).astype(np.int64)
                    ca, cb = queries["c"][a], other["c"][b]
                    ends, root = forest(ca, cb)
                    for c, v in ((queries["c"], mine), (other["c"], theirs)):
                        on = np.flatnonzero(v)
                        yield pa.RecordBatch.from_arrays([pa.array(c[on]), pa.nulls(len(on), pa.int64()), pa.array(v[on])], ["a", "b", "n"])
                    yield pa.RecordBatch.from_arrays([pa.array(ends), pa.array(root), pa.nulls(len(ends), pa.int64())], ["a", "b", "n"])

    # pairs of blocks grow with the square of the blocks, so the executors list them
    pairs = spark.range(n).select(F.col("id").alias("i"), F.explode(F.expr(f"sequence(id, {n - 1}L, {REACH}L)")).alias("first"))
    pairs = pairs.withColumn("last", F.least(F.lit(n).cast("long"), F.col("first") + REACH))
    parts = min(sum(-(-(n - i) // REACH) for i in range(n)), max(256, 16 * spark.sparkContext.defaultParallelism))
    return pairs.repartition(max(1, parts)).mapInArrow(compared, "a long, b long, n long")


def load(path: str) -> dict[str, np.ndarray]:
    """A block: unit vectors x, class numbers c and sizes n."""
    system, at = file_system(path)
    with system.open_input_file(at) as source:
        found = np.load(io.BytesIO(source.read()))
        return {k: found[k] for k in ("x", "c", "n")}


def candidates(query: np.ndarray, data: np.ndarray, radius: float, need: int, step: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, data row) that collide on `need` lines at least.

    Each line's values are sorted; a query's window is a range of places in that order, found by binary
    search, and a row collides if its place is in the range.
    """
    n, lines = data.shape
    order = np.argsort(data, axis=0, kind="stable")
    place = np.empty((lines, n), np.uint16)
    low = np.empty((lines, len(query)), np.uint16)
    wide = np.empty((lines, len(query)), np.uint16)
    for k in range(lines):
        place[k, order[:, k]] = np.arange(n)
        values = data[order[:, k], k]
        begin = np.searchsorted(values, query[:, k] - radius, "left")
        low[k], wide[k] = begin, np.searchsorted(values, query[:, k] + radius, "right") - begin
    left, right = [], []
    inside, gap = np.empty((step, n), bool), np.empty((step, n), np.uint16)
    for at in range(0, len(query), step):
        m = min(step, len(query) - at)
        count = np.zeros((m, n), np.uint8)
        for k in range(lines):
            np.subtract(place[k], low[k, at : at + m, None], out=gap[:m])
            np.less(gap[:m], wide[k, at : at + m, None], out=inside[:m])
            count += inside[:m].view(np.uint8)
        a, b = np.nonzero(count >= need)
        left.append(a + at)
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def exact(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have a cosine of `threshold` at least, in double precision."""
    return np.concatenate([np.einsum("ij,ij->i", x[a[k : k + 65536]], y[b[k : k + 65536]]) >= threshold for k in range(0, len(a), 65536)] or [np.zeros(0, bool)])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the given edges join, one per node at most: each node and the least of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        new = np.minimum(new, new[root])
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", projections: int = PROJECTIONS, width: float = WIDTH, recall: float = 1 - 1e-6, seed: int = 29, path: str | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row, labels aside.

    Equal vectors are one class that is compared once and counted with its size. Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing; vectors of different lengths
    do not link either. component_id is the least id reachable by links. A null id never names a
    component that has ids. Repeated rows count as vectors of their own. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ready_to_checkpoint(spark)
    path = path or shared_dir(spark)
    rows = store(classes_of(vectors, id_col, vector_col))
    classes = store(rows.where("c is not null").groupBy("c").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("v").alias("v")))
    sizes = classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()  # one row per vector length

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def put() -> dict:
            name = f"{path}/block-{uuid.uuid4().hex}.npz"
            system, at = file_system(name)
            system.create_dir(at.rpartition("/")[0], recursive=True)
            x = np.array([h[2] for h in held], np.float64)
            x /= np.abs(x).max(1, keepdims=True)  # else squares of tiny or huge components are lost
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            data = io.BytesIO()
            np.savez(data, x=x, c=np.array([h[0] for h in held], np.int64), n=np.array([h[1] for h in held], np.int64))
            with system.open_output_stream(at, compression=None) as sink:
                sink.write(data.getvalue())
            row = {"path": name, "rows": len(held)}
            held.clear()
            return row

        schema = pa.schema([("path", pa.string()), ("rows", pa.int64())])
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                held.append(row)
                if len(held) >= BLOCK:
                    yield pa.RecordBatch.from_pylist([put()], schema)
        if held:
            yield pa.RecordBatch.from_pylist([put()], schema)

    found = None
    for size in sizes:
        own = classes.where(F.size("v") == size["d"]).select("c", "n", "v")
        blocks = store(own.repartitionById(n := max(1, math.ceil(size["n"] / BLOCK)), F.expr(f"cast(pmod(c, {n}) as int)")).mapInArrow(blocked, "path string, rows long"))
        blocks = blocks.withColumn("number", F.xxhash64("path"))
        part = links(blocks, threshold, projections, width, recall, seed)
        found = part if found is None else found.unionByName(part)
    named = classes.select("c", "n", "least")
    if found is None:
        named = named.withColumn("more", F.lit(0).cast("long")).withColumn("g", F.col("c"))
    else:
        found = store(found)
        counted = found.where("n is not null").groupBy(F.col("a").alias("ka")).agg(F.sum("n").alias("more"))
        groups = components(found.where("b is not null").select("a", "b"))
        named = named.join(counted, F.col("c") == F.col("ka"), "left").join(groups, F.col("c") == F.col("node"), "left")
        named = named.select("c", "n", "least", F.coalesce("more", F.lit(0)).alias("more"), F.coalesce("component", "c").alias("g"))
    named = store(named)
    lowest = named.groupBy("g").agg(F.min("least").alias("component_id"))
    named = named.join(lowest.select(separate("g").alias("k"), "component_id"), F.col("g") == F.col("k")).select("c", F.expr("n - 1 + more").alias("n_links"), "component_id")
    joined = rows.select("vec_id", "c").join(named.select(separate("c").alias("k"), "n_links", "component_id"), F.col("c") == F.col("k"), "left")
    joined = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.expr("case when c is null then vec_id else component_id end").alias("component_id"))
    return joined.withColumn("kept", F.expr("coalesce(vec_id = component_id, component_id is null)"))
