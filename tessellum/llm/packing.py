"""Best-fit packing with a bounded number of open bins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.llm.tokens import encoder

PACKED = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


class Packer:
    """Online best fit over at most `bins` open bins.

    Open bins stand in one bit set keyed by their free space, so the fullest bin that still takes a
    piece is the lowest bit set at or above the piece's length. Where a new bin would be one too many,
    the fullest open bin closes.
    """

    def __init__(self, capacity: int, bins: int, first_id: int):
        self.capacity, self.bins, self.next_id = capacity, bins, first_id
        self.bits, self.count = 0, 0
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of the next piece."""
        above = self.bits >> length
        if length and above:
            free = length + (above & -above).bit_length() - 1
            bin_id = self._take(free)
        else:
            if length < self.capacity and self.count >= self.bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_id, free = self.next_id, self.capacity
            self.next_id += 1
        if rest := free - length:
            self.open[rest].append(bin_id)
            self.bits |= 1 << rest
            self.count += 1
        return bin_id, self.capacity - free

    def _take(self, free: int) -> int:
        bin_id = self.open[free].pop(0)
        if not self.open[free]:
            self.bits &= ~(1 << free)
        self.count -= 1
        return bin_id


def pack(docs: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, bins: int = 512) -> DataFrame:
    """Token sequences of at most `capacity` ids: one row per piece with its ids and its place.

    A document is the ids of its whole text (null: none) and `end_id`. Longer ones are cut into pieces
    of `capacity`; a last piece may be shorter. Each task packs what it reads by online best fit with
    at most `bins` open bins, the longest first within each Arrow batch, and emits each piece as it is
    placed, so memory is bounded by a batch. At most `bins` sequences per task stay partly filled at
    its end. sequence_id is unique over tasks; offsets in a sequence run gapless from 0. A null id
    stays null; repeated rows are packed as often as they stand; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(capacity, bins, TaskContext.get().partitionId() << 40)
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        wide = capacity * 4
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            pieces = []
            for doc_id, ids in zip(doc_ids, enc.encode(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), wide)):
                    pieces.append((doc_id, k, at // 4, ids[at : at + wide]))
            pieces.sort(key=lambda p: -len(p[3]))
            places = [packer.place(len(p[3]) // 4) for p in pieces]
            for at in range(0, len(pieces), 2000):
                part, where = pieces[at : at + 2000], places[at : at + 2000]
                yield pa.RecordBatch.from_arrays([
                    pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int32()), pa.array([p[2] for p in part], pa.int64()), pa.array([len(p[3]) // 4 for p in part], pa.int64()),
                    pa.array([p[3] for p in part], pa.binary()), pa.array([w[0] for w in where], pa.int64()), pa.array([w[1] for w in where], pa.int64()),
                ], ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    return rows.mapInArrow(packed, PACKED)
