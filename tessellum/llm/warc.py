"""WARC archives and a two-level capture index.

Captures are ordered by key: the URL with its host reversed, then the capture's number. Each task writes
one archive of gzip members, and beside it one index file: the captures' lines in compressed blocks, and
at its end a sparse directory of each block's first key. A lookup finds the index file by the first keys
of all files, the block by the file's directory, the line in the block, and reads the record's range.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.llm.common import file_system, shared_dir, store

MAGIC = b"CAPIDX01"
#: Captures in a block of the index; payloads of fewer bytes are always written in full.
BLOCK, SMALL = 512, 1000
#: Fixed values of the format, WARC 1.1.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: A reversed-host key in Spark SQL over a column `url`: com,example,www)/path?query; urls without a host keep their text.
KEY = r"""case when url is null then '' when url rlike '^[^/?#]*://' then concat(
    array_join(reverse(split(lower(regexp_extract(url, '://([^/?#]*)', 1)), '[.]')), ','), ')', regexp_replace(url, '(?s)^[^/?#]*://[^/?#]*', '')) else url end"""

CAPTURE = "key string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit that has the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    name = lambda i: f"<urn:capture:{'none' if i is None else i}>"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", name(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The capture that a record holds; sizes and digests of responses are taken from the payload itself."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: None if name in (None, "<urn:capture:none>") else int(name[len("<urn:capture:") : -1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    kind = fields["WARC-Type"]
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError("a payload differs from its digest")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To"))}


def sort_key(key: str, page_id: int | None) -> tuple[bytes, int]:
    """Order of captures: as Spark orders UTF-8 strings, then by number, none first."""
    return key.encode("utf-8", "surrogatepass"), -(1 << 63) if page_id is None else page_id


class IndexWriter:
    """Writes an index file: blocks of lines, then the directory."""

    def __init__(self, sink):
        self.sink, self.at, self.lines, self.directory = sink, 0, [], []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, key: str, page_id: int | None, at: int, length: int) -> None:
        self.lines.append([key, page_id, at, length])
        if len(self.lines) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.lines:
            data = zlib.compress("\n".join(map(json.dumps, self.lines)).encode())
            self.directory.append([*self.lines[0][:2], self.at, len(data)])
            self._put(data)
            self.lines = []

    def close(self) -> None:
        self.flush()
        foot = zlib.compress(json.dumps(self.directory).encode())
        self._put(foot + struct.pack("<Q", len(foot)) + MAGIC)
        self.sink.close()


class Index:
    """Looks captures up in one index file; remembers the last block."""

    def __init__(self, path: str):
        system, at = file_system(path)
        self.source = system.open_input_file(at)
        size = self.source.size()
        tail = self.source.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a capture index")
        n = struct.unpack("<Q", tail[:8])[0]
        self.directory = json.loads(zlib.decompress(self.source.read_at(n, size - 16 - n)))
        self.firsts = [sort_key(*row[:2]) for row in self.directory]
        self.block, self.keys, self.lines = -1, [], []

    def _load(self, block: int) -> None:
        if block != self.block:
            _, _, at, length = self.directory[block]
            self.lines = [json.loads(x) for x in zlib.decompress(self.source.read_at(length, at)).decode().split("\n")]
            self.block, self.keys = block, [sort_key(*x[:2]) for x in self.lines]

    def find(self, wanted: tuple[bytes, int]) -> Iterator[tuple[int, int]]:
        """(offset, length) of the records of all captures of a key."""
        block = max(0, bisect.bisect_left(self.firsts, wanted) - 1)
        while block < len(self.directory) and self.firsts[block] <= wanted:
            self._load(block)
            for i in range(bisect.bisect_left(self.keys, wanted), bisect.bisect_right(self.keys, wanted)):
                yield self.lines[i][2], self.lines[i][3]
            block += 1


def write(pages: DataFrame, *, path: str | None = None, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", small: int = SMALL) -> DataFrame:
    """Write one record per row and the index; one row per archive, (first_key, first_id, warc, index, records).

    Of rows with equal payloads of at least `small` bytes, that with the largest id is written as a
    response, the others as revisits of it. A null payload is empty, a null url has the key ''. A null id
    is never referred to unless all of its group are null; then all are responses. Repeated rows are
    written as often as they stand; those of the largest id are all responses. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = path or shared_dir(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(body_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.expr(KEY)).withColumn("size", F.octet_length("payload").cast("long"))
    facts = store(rows.where(F.col("size") >= small).select("key", "page_id", F.sha1("payload").alias("digest")))
    chosen = facts.groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1 and best is not null")
    chosen = chosen.select(F.expr("concat(digest, '')").alias("d"), "best")
    again = facts.join(chosen, F.col("digest") == F.col("d")).where("page_id is null or page_id <> best")
    # what a row refers to comes just before the row itself, by the same range of keys
    decided = again.select("key", "page_id", F.lit(0).alias("turn"), F.lit(None).cast("string").alias("url"), F.col("digest").cast("binary").alias("payload"), F.col("best"))
    both = decided.unionByName(rows.select("key", "page_id", F.lit(1).alias("turn"), "url", "payload", F.lit(None).cast("long").alias("best")))
    dealt = both.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "page_id").sortWithinPartitions("key", "page_id", "turn")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sinks, at, records, first, current, refers = None, 0, 0, None, None, {}
        for batch in batches:
            for key, page_id, turn, url, payload, best in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if current != (key, page_id):
                    current, refers = (key, page_id), {}
                if turn == 0:
                    refers[payload.decode()] = best
                    continue
                if sinks is None:  # names of their own for each attempt; only those of finished tasks are listed
                    name = f"{path}/{uuid.uuid4().hex}"
                    system, folder = file_system(path)
                    system.create_dir(folder, recursive=True)
                    sinks = [system.open_output_stream(file_system(f"{name}.{end}")[1], compression=None) for end in ("warc.gz", "index")]
                    index, first = IndexWriter(sinks[1]), current
                digest = hashlib.sha1(payload).hexdigest()
                refers_to = refers.get(digest)
                raw = record("response" if refers_to is None else "revisit", page_id, url, payload, digest, len(payload), refers_to)
                member = gzip.compress(raw, 5, mtime=0)
                sinks[0].write(member)
                index.add(key, page_id, at, len(member))
                at, records = at + len(member), records + 1
        if sinks is not None:
            sinks[0].close()
            index.close()
            schema = pa.schema([("first_key", pa.string()), ("first_id", pa.int64()), ("warc", pa.string()), ("index", pa.string()), ("records", pa.int64())])
            yield pa.RecordBatch.from_pylist([{"first_key": first[0], "first_id": first[1], "warc": f"{name}.warc.gz", "index": f"{name}.index", "records": records}], schema)

    return store(dealt.mapInArrow(written, "first_key string, first_id long, warc string, index string, records long"))


def lookup(archives: DataFrame, wanted: DataFrame) -> DataFrame:
    """The captures of wanted (url, page_id) pairs, as CAPTURE, read from the archives through the index.

    Keys without a capture give no row; a key wanted twice gives its captures once. Wanted keys are dealt
    by ranges, so a task reads neighbouring blocks and neighbouring records. archives has one row per
    archive, as many as `write` had tasks; their first keys go to every task.
    """
    listed = sorted((sort_key(r["first_key"], r["first_id"]), r["warc"], r["index"]) for r in archives.collect())
    firsts = [x[0] for x in listed]
    keys = wanted.select(F.expr(KEY).alias("key"), F.col("page_id").cast("long").alias("page_id")).distinct()
    parts = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index, source = -1, None, None
        schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            rows, held = [], 0
            for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key_bytes = sort_key(key, page_id)
                shard = max(0, bisect.bisect_left(firsts, key_bytes) - 1)
                while shard < len(listed) and firsts[shard] <= key_bytes:
                    if shard != at:
                        system, path = file_system(listed[shard][1])
                        at, index, source = shard, Index(listed[shard][2]), system.open_input_file(path)
                    for offset, length in index.find(key_bytes):
                        capture = parse(gzip.decompress(source.read_at(length, offset)))
                        rows.append({"key": key, **capture})
                        held += capture["payload_bytes"]
                    shard += 1
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)

    return keys.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(found, CAPTURE)


