"""Token ids in files of canonical length-limited Huffman codes, fitted to the counts of all ids.

A file is MAGIC, the lengths of all codes (zlib), and blocks that can be decoded alone. A block has its
documents' ids and lengths, the bit offset of a checkpoint every STRIDE ids of each document, and the
bits; each document begins at a whole byte. The file ends with the place of each block.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.llm.common import file_system, shared_dir, store
from tessellum.llm.tokens import encoder

MAGIC = b"IDHUFF01"
#: Longest code in bits, ids between checkpoints, ids a block has at least (but for the last).
LIMIT, STRIDE, BLOCK = 18, 256, 1 << 17
NO_ID = -(1 << 63)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits by package-merge; 0 for ids that do not occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids have no code of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    packages, own = np.zeros(0), []
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        rank = np.argsort(merged, kind="stable")
        own.append(rank < len(weights))
        merged = merged[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take, lengths = 2 * len(weights) - 2, np.zeros(len(weights), np.int64)
    for flags in reversed(own):
        mine = int(flags[:take].sum())
        lengths[:mine] += 1
        take = 2 * (take - mine)
    out[order] = lengths
    return out


@dataclass
class Code:
    """The canonical code of given lengths: codes in order of (length, id), and the table that decodes LIMIT bits at once."""

    lengths: np.ndarray

    def __post_init__(self):
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        wide = 1 << (LIMIT - self.lengths[order].astype(np.int64))
        first = np.concatenate([[0], np.cumsum(wide)])
        self.codes = np.zeros(len(self.lengths), np.uint64)
        self.codes[order] = first[:-1] >> (LIMIT - self.lengths[order].astype(np.int64))
        self.table = np.zeros(1 << LIMIT, np.uint32)  # id and length of the code that LIMIT bits begin with
        entries = order.astype(np.uint32) << np.uint32(6) | self.lengths[order].astype(np.uint32)
        self.table[: first[-1]] = np.repeat(entries, wide)

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(bits, byte offset of each document and the end, bit offset of each id) of documents one after another."""
        n_bits = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(sizes)
        total = np.concatenate([[0], np.cumsum(n_bits)])
        own = np.diff(total[np.concatenate([[0], ends])])
        begins = np.concatenate([[0], np.cumsum((own + 7) // 8)])
        at = total[:-1] + np.repeat(begins[:-1] * 8 - total[ends - sizes], sizes)
        words = np.zeros(int(begins[-1]) // 8 + 2, np.uint64)
        if len(ids):
            word, free = at >> 6, 64 - (at & 63) - n_bits
            code = self.codes[ids]
            high = np.where(free >= 0, code << np.maximum(free, 0).astype(np.uint64), code >> np.maximum(-free, 0).astype(np.uint64))
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[heads]] = np.bitwise_or.reduceat(high, heads)
            over = np.flatnonzero(free < 0)
            words[word[over] + 1] |= code[over] << (64 + free[over]).astype(np.uint64)
        return words.astype(">u8").tobytes()[: int(begins[-1])], begins, at

    def decode(self, bits: bytes, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids of stretches that begin at bits `at`, one after another; all stretches advance together."""
        data = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
        window = data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:]
        order = np.argsort(-sizes, kind="stable")
        at, left = at[order].astype(np.int64), sizes[order]
        to = (np.cumsum(sizes) - sizes)[order]
        out = np.zeros(int(sizes.sum()), np.uint32)
        mask = np.uint32((1 << LIMIT) - 1)
        alive = len(left)
        for k in range(int(left[0]) if len(left) else 0):
            while alive and left[alive - 1] <= k:
                alive -= 1
            pos = at[:alive]
            entry = self.table[window[pos >> 3] >> (32 - LIMIT - (pos & 7)).astype(np.uint32) & mask]
            out[to[:alive] + k] = entry >> np.uint32(6)
            pos += entry & np.uint32(63)
        return out


def stretches(n_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of documents of n ids: the document of each checkpoint, and the ids from each to the next."""
    parts = (n_ids + STRIDE - 1) // STRIDE
    doc = np.repeat(np.arange(len(n_ids)), parts)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    return doc, np.minimum(STRIDE, n_ids[doc] - k * STRIDE)


class Writer:
    """Writes a file block by block; documents come with their bits and the bit offsets of their checkpoints."""

    def __init__(self, sink, lengths: np.ndarray):
        book = zlib.compress(lengths.tobytes(), 9)
        self.sink, self.places, self.n_ids, self.n_docs = sink, [], 0, 0
        self.rows: list[tuple] = []
        self.waiting = 0
        self.at = self._put(MAGIC + struct.pack("<II", len(lengths), len(book)) + book)

    def _put(self, data: bytes) -> int:
        self.sink.write(data)
        return len(data)

    def add(self, doc_id: int | None, n_ids: int, bits: bytes, checkpoints: bytes) -> None:
        self.rows.append((doc_id, n_ids, bits, checkpoints))
        self.waiting += n_ids
        if self.waiting >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if not self.rows:
            return
        n_bytes = np.array([len(r[2]) for r in self.rows], np.int64)
        n_ids = np.array([r[1] for r in self.rows], "<u4")
        starts = np.cumsum(n_bytes) - n_bytes
        doc, _ = stretches(n_ids.astype(np.int64))
        marks = np.frombuffer(b"".join(r[3] for r in self.rows), "<i8") + starts[doc] * 8
        ids = np.array([NO_ID if r[0] is None else r[0] for r in self.rows], "<i8")
        body = struct.pack("<IIQ", len(ids), len(marks), int(n_bytes.sum())) + ids.tobytes() + n_ids.tobytes() + marks.astype("<u8").tobytes() + b"".join(r[2] for r in self.rows)
        self.places.append((self.at, len(body), self.n_ids))
        self.at += self._put(body)
        self.n_ids += self.waiting
        self.n_docs += len(ids)
        self.rows, self.waiting = [], 0

    def close(self) -> None:
        self.flush()
        foot = json.dumps({"blocks": self.places, "n_ids": self.n_ids, "n_docs": self.n_docs}).encode()
        self._put(foot + struct.pack("<Q", len(foot)) + MAGIC)
        self.sink.close()


def read_blocks(source) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """(document ids, ids of each, ordinal of the first, all ids) of each block of an open file."""
    size = source.size()
    tail = source.read_at(16, size - 16)
    if tail[8:] != MAGIC:
        raise ValueError("not a file of coded ids")
    n = struct.unpack("<Q", tail[:8])[0]
    foot = json.loads(source.read_at(n, size - 16 - n))
    head = source.read_at(16, 0)
    _, n_book = struct.unpack("<II", head[8:])
    code = Code(np.frombuffer(zlib.decompress(source.read_at(n_book, 16)), np.uint8))
    for at, length, start in foot["blocks"]:
        body = source.read_at(length, at)
        n_docs, n_marks, n_bytes = struct.unpack_from("<IIQ", body)
        ids = np.frombuffer(body, "<i8", n_docs, 16)
        n_ids = np.frombuffer(body, "<u4", n_docs, 16 + 8 * n_docs).astype(np.int64)
        marks = np.frombuffer(body, "<u8", n_marks, 16 + 12 * n_docs)
        _, lengths = stretches(n_ids)
        yield ids, n_ids, start, code.decode(body[len(body) - n_bytes :], marks, lengths)


def write(docs: DataFrame, *, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, files: int | None = None) -> DataFrame:
    """Encode all whole texts and write their ids in ascending order of id; (part, path, start, n_ids, n_docs) of each file.

    A document is the ids of its text (null: none) and `end_id`. Null ids come first; rows of one id
    stand together in the order of a hash of their text, and when they fill more than one file's share
    they go over as many files. files: how many at most, as many as shuffle partitions if not given.
    An empty table gives no files. `start` is the number of ids in all files before.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark)
    n_files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        narrow = "<u2" if enc.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(narrow).tobytes() for x in enc.encode(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([narrow] * len(ids)), pa.array(ids, pa.binary())], ["doc_id", "h", "kind", "ids"])

    raw = store(rows.mapInArrow(tokenized, "doc_id long, h long, kind string, ids binary"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for kind in set(batch.column(0).to_pylist()):
                got = np.bincount(np.frombuffer(b"".join(x for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if k == kind), kind))
                total = np.pad(total, (0, max(0, len(got) - len(total))))
                total[: len(got)] += got
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "n"])

    per_id = raw.select("kind", "ids").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row per id of the vocabulary
    shares = [k / n_files for k in range(1, n_files)]
    facts = raw.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", shares, 20 * n_files).alias("cuts") if shares else F.lit(None).alias("cuts")).first()
    counts = np.zeros(max([end_id, *(r["id"] for r in per_id)]) + 1, np.int64)
    counts[[r["id"] for r in per_id]] = [r["n"] for r in per_id]
    counts[end_id] += facts["n"]
    lengths = code_lengths(counts)
    cuts = np.array(facts["cuts"] or [], np.int64)
    sent = spark.sparkContext.broadcast((lengths, cuts))  # the vocabulary's lengths, and one number per file

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, bounds = Code(sent.value[0]), sent.value[1]
        end = np.array([end_id], np.uint32)
        for batch in batches:
            doc_ids, hashes, kinds, texts = (batch.column(i).to_pylist() for i in range(4))
            parts = [np.concatenate([np.frombuffer(x, k).astype(np.uint32), end]) for k, x in zip(kinds, texts, strict=True)]
            sizes = np.array([len(p) for p in parts], np.int64)
            bits, begins, at = code.encode(np.concatenate(parts) if parts else end[:0], sizes)
            firsts = np.cumsum(sizes) - sizes
            marks = [(at[f : f + n : STRIDE] - b * 8).astype("<i8").tobytes() for f, n, b in zip(firsts, sizes, begins, strict=False)]
            numbers = np.array([NO_ID if d is None else d for d in doc_ids], np.int64)
            low, high = np.searchsorted(bounds, numbers, "left"), np.searchsorted(bounds, numbers, "right")
            share = (np.array(hashes, np.float64) + 2.0**63) / 2.0**64  # rows of an id that is several bounds go over those files, by hash
            part = np.minimum(low + ((high - low) * share).astype(np.int64), high)
            yield pa.RecordBatch.from_arrays([
                pa.array(part, pa.int32()), batch.column(0), batch.column(1), pa.array(sizes, pa.int64()),
                pa.array([bits[begins[i] : begins[i + 1]] for i in range(len(sizes))], pa.binary()), pa.array(marks, pa.binary()),
            ], ["part", "doc_id", "h", "n_ids", "bits", "marks"])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name, part = None, "", 0
        for batch in batches:
            for part, doc_id, n_ids, bits, marks in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True):
                if writer is None:  # a name of its own for each attempt; only those of finished tasks are listed
                    name = f"{path}/ids-{part:06d}-{uuid.uuid4().hex}.huff"
                    system, at = file_system(name)
                    system.create_dir(at.rpartition("/")[0], recursive=True)
                    writer = Writer(system.open_output_stream(at, compression=None), sent.value[0])
                writer.add(doc_id, n_ids, bits, marks)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": name, "n_ids": writer.n_ids, "n_docs": writer.n_docs}], pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]))

    dealt = raw.mapInArrow(coded, "part int, doc_id long, h long, n_ids long, bits binary, marks binary").repartitionById(n_files, F.col("part")).sortWithinPartitions("doc_id", "h")
    listed = sorted(store(dealt.mapInArrow(written, "part int, path string, n_ids long, n_docs long")).collect())  # one row per file
    start, out = 0, []
    for part, name, n_ids, n_docs in listed:
        out.append((part, name, start, n_ids, n_docs))
        start += n_ids
    return spark.createDataFrame(out, "part int, path string, start long, n_ids long, n_docs long")


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of files that `write` listed; ids are little-endian unsigned 32-bit integers."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                system, at = file_system(path)
                with system.open_input_file(at) as source:
                    for doc_ids, n_ids, start, ids in read_blocks(source):
                        firsts = np.cumsum(n_ids) - n_ids
                        raw = ids.astype("<u4").tobytes()
                        yield pa.RecordBatch.from_arrays([
                            pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(base + start + firsts, pa.int64()), pa.array(n_ids, pa.int64()),
                            pa.array([raw[4 * f : 4 * (f + n)] for f, n in zip(firsts.tolist(), n_ids.tolist(), strict=True)], pa.binary()),
                        ], ["doc_id", "start", "n_tokens", "ids"])

    n_files = max(1, files.count())
    return files.repartitionById(n_files, F.expr(f"pmod(part, {n_files})")).mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids binary")
