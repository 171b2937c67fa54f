"""Bounded-space online packing of token sequences.

Every partition keeps a fixed number of open windows. A document is cut into full windows and a tail; the tail goes
to the open window that it fills best; when none has room, the fullest window is completed with the beginning of the
tail and emitted. What is still open at the end of a partition is merged in further passes, 32 partitions to one, and
the very last remainder is laid out in sequences of power-of-two length, so no sequence needs padding.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, materialize, tidy
from .tokens import crc32, tokenizer

#: Open windows of a partition.
OPEN_WINDOWS = 16
#: Partitions whose leftovers one task of the next pass merges.
MERGE = 32

_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("origin", pa.int64()), ("open", pa.bool_())])
_PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, origin long, open boolean"


class Windows:
    """The open windows of one partition. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, most: int, first_id: int, keep_ids: bool = False):
        self.size, self.most, self.next_id, self.keep_ids = size, most, first_id, keep_ids
        self.open: list[list] = []  # [filled, pieces]
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), crc32(ids), total, self.next_id, offset, ids.tobytes() if self.keep_ids else None, None, False))
            offset += len(ids)
        self.next_id += 1

    def document(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, size = len(ids), self.size
        full = n - n % size
        for i in range(0, full, size):
            self._emit([(doc_id, i, ids[i : i + size], n)])
        if n > full:
            self.place(doc_id, full, ids[full:], n)

    def place(self, doc_id: int | None, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids):
            free = [(self.size - w[0], k) for k, w in enumerate(self.open)]
            fits = [x for x in free if x[0] >= len(ids)]
            if fits:
                own = self.open[min(fits)[1]]
                taken = len(ids)
            elif len(self.open) < self.most:
                own, taken = [0, []], len(ids)
                self.open.append(own)
            else:  # none fits: complete the fullest
                room, k = min(free)
                own, taken = self.open[k], room
            own[0] += taken
            own[1].append((doc_id, start, ids[:taken], total))
            if own[0] == self.size:
                self.open.remove(own)
                self._emit(own[1])
            start, ids = start + taken, ids[taken:]

    def leave(self, origin: int) -> None:
        """The open windows' pieces, with their ids, for the next pass."""
        for _, pieces in sorted(self.open, key=lambda w: -w[0]):
            for doc_id, start, ids, total in pieces:
                self.rows.append((doc_id, start, len(ids), None, total, None, None, ids.tobytes(), origin, True))
        self.open = []

    def finish(self) -> None:
        """Everything that is open, joined and cut at the window size; the end in powers of two."""
        left = [p for _, pieces in sorted(self.open, key=lambda w: -w[0]) for p in pieces]
        self.open = []
        rest = sum(len(p[2]) for p in left)
        while rest:
            size = self.size if rest >= self.size else 1 << (rest.bit_length() - 1)
            rest -= size
            pieces = []
            while size:
                doc_id, start, ids, total = left[0]
                pieces.append((doc_id, start, ids[:size], total))
                size -= len(pieces[-1][2])
                if len(ids) == len(pieces[-1][2]):
                    left.pop(0)
                else:
                    left[0] = (doc_id, start + len(pieces[-1][2]), ids[len(pieces[-1][2]) :], total)
            self._emit(pieces)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECE)], schema=_PIECE)


def pack(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 0, open_windows: int = OPEN_WINDOWS, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), one row per piece.

    A document is the ids of its whole text followed by ``end_id``; a null or empty text is the end id alone. Every id
    lies in exactly one piece. Sequences hold ``size`` ids, apart from at most log2(size) of them, whose
    lengths are distinct powers of two; ``offset`` is gapless from 0 in each sequence. Repeated rows are documents of
    their own, a null doc_id stays null, an empty table gives no piece; other columns are ignored. ``size`` is a power
    of two. ``keep_ids`` adds the ids themselves (little-endian unsigned 32-bit).
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    docs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))

    def online(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = tokenizer(tokenizer_path), TaskContext.get().partitionId()
        w = Windows(size, open_windows, part << 32, keep_ids)
        end = np.array([end_id], np.uint32)
        for b in batches:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), own.encode_column(b.column("text"))):
                w.document(doc_id, np.concatenate([ids, end]))
            if w.rows:
                yield w.take()
        w.leave(part)
        if w.rows:
            yield w.take()

    def merging(level: int, last: bool):
        def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            w = Windows(size, open_windows, (level << 56) + (part << 32), keep_ids)
            for b in batches:
                for doc_id, start, ids, total in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))):
                    w.place(doc_id, start, np.frombuffer(ids, "<u4"), total)
                if w.rows:
                    yield w.take()
            if last:
                w.finish()
            else:
                w.leave(part)
            if w.rows:
                yield w.take()

        return merge

    table = materialize(docs.mapInArrow(tidy(online), _PIECE_DDL), "packed")
    done = [table.where("not open")]
    level = 1
    while True:
        left = table.where("open")
        origins = left.agg(F.countDistinct("origin")).first()[0]
        if not origins:
            break
        tasks = -(-origins // MERGE)
        table = materialize(left.repartition(tasks, F.floor(F.col("origin") / MERGE)).sortWithinPartitions("origin", "doc_id", "start").mapInArrow(merging(level, tasks == 1), _PIECE_DDL), "merged")
        done.append(table.where("not open"))
        level += 1
        if tasks == 1:
            break
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.drop("origin", "open", *([] if keep_ids else ["ids"]))


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
