"""A connector to what fetching tools stored: a batch data source with partitions, and the choice among tools."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "tool string, url string, status int, body string"
TOOLS = ("primary", "fallback")
#: Bytes of a file that one task reads, and bytes of bodies that it hands over at once.
SPLIT, BATCH = 64 << 20, 8 << 20


def file_system(uri: str):
    """(pyarrow file system, path) of a folder that executors reach; a bare path is local."""
    from pyarrow import fs

    uri = re.sub(r"^s3[an]:", "s3:", uri)
    local = re.match(r"^(?:file:)?(?://)?(/.*)$", uri)
    return (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(uri)


class Stretch(InputPartition):
    """The lines of a tool's file that begin in [start, stop)."""

    def __init__(self, tool: str, path: str, start: int, stop: int):
        super().__init__(None)
        self.tool, self.path, self.start, self.stop = tool, path, start, stop


class StoredResponses(DataSource):
    """Format `stored_responses`: JSON lines {url, status, body} below `path`/tool=<tool>/, one row each.

    Options: `path`; `tools`, those to read, by commas (primary,fallback); `split`, bytes a task; `enabled`, which
    must be true, as nothing is read from outside by default. A tool without a folder and an empty file give no
    rows. A damaged line is a row without url and status, its body the line; a missing or odd field is null.
    """

    @classmethod
    def name(cls) -> str:
        return "stored_responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if str(self.options.get("enabled", "false")).lower() != "true":
            raise ValueError("fetching is off; set option enabled to true")
        return ResponseReader(self.options)


class ResponseReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"].rstrip("/")
        self.tools = [t.strip() for t in options.get("tools", ",".join(TOOLS)).split(",") if t.strip()]
        self.split = max(1, int(options.get("split", SPLIT)))

    def partitions(self):
        from pyarrow import fs

        system, root = file_system(self.folder)
        found = []
        for tool in self.tools:
            files = system.get_file_info(fs.FileSelector(f"{root}/tool={tool}", allow_not_found=True, recursive=True))
            for f in sorted(files, key=lambda f: f.path):
                if f.is_file and f.size and not f.base_name.startswith(("_", ".")):
                    found += [Stretch(tool, f.path, at, min(at + self.split, f.size)) for at in range(0, f.size, self.split)]
        return found or [Stretch("", "", 0, 0)]

    def read(self, partition):
        import pyarrow as pa

        if partition.start == partition.stop:
            return
        types = pa.schema([("tool", pa.string()), ("url", pa.string()), ("status", pa.int32()), ("body", pa.string())])
        rows, held = [], 0
        for line in lines_of(file_system(self.folder)[0], partition.path, partition.start, partition.stop):
            if line.strip():
                rows.append((partition.tool, *parsed(line)))
                held += len(line)
            if held >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)], schema=types)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)], schema=types)


def lines_of(system, path: str, start: int, stop: int):
    """The lines, as bytes, that begin in [start, stop) of a file; the last may end beyond."""
    with system.open_input_file(path) as file:
        at = max(0, start - 1)
        file.seek(at)
        rest, begun = b"", start == 0
        while at < stop or rest:
            block = file.read(1 << 20)
            pieces = (rest + block).split(b"\n")
            rest = pieces.pop() if block else b""
            for piece in pieces:
                if begun and at < stop:
                    yield piece
                at, begun = at + len(piece) + 1, True
            if not block or at >= stop:
                return


def parsed(line: bytes) -> tuple[str | None, int | None, str | None]:
    """(url, status, body) of a stored response."""
    text = line.decode("utf-8", "replace")
    try:
        row = json.loads(text)
    except ValueError:
        row = None
    if not isinstance(row, dict):
        return None, None, text
    url, status, body = (row.get(k) for k in ("url", "status", "body"))
    whole = isinstance(status, int) and not isinstance(status, bool) and abs(status) < 1 << 31
    return url if isinstance(url, str) else None, status if whole else None, body if isinstance(body, str) else None


def stored(spark: SparkSession, folder: str, tools: tuple[str, ...] = TOOLS, split: int = SPLIT) -> DataFrame:
    """All stored responses of the tools, (tool, url, status, body)."""
    spark.dataSource.register(StoredResponses)
    reader = spark.read.format("stored_responses").option("enabled", "true")
    return reader.option("tools", ",".join(tools)).option("split", str(split)).load(folder)


def chosen(urls: DataFrame, responses: DataFrame, tools: tuple[str, ...] = TOOLS) -> DataFrame:
    """(url, tool, body, failed) of each different url: the answer of the first tool, in the order given, that has a body and a status of 200 to 299.

    Of several such answers of one tool the least body holds. A url without any is marked failed, and so is a null one.
    """
    rank = F.array_position(F.lit(list(tools)), F.col("tool"))
    good = responses.where("status between 200 and 299 and body is not null").withColumn("rank", rank).where("rank > 0")
    best = good.groupBy(F.col("url").alias("asked")).agg(F.min(F.struct("rank", "body")).alias("best"))
    rows = urls.select("url").distinct().join(best, F.col("url") == F.col("asked"), "left")
    return rows.select("url", F.get(F.lit(list(tools)), F.col("best.rank").cast("int") - 1).alias("tool"), F.col("best.body").alias("body"), F.col("best").isNull().alias("failed"))
