"""Token ids in Re-Pair grammar files.

A shard file holds consecutive documents. Frequent pairs of ids are repeatedly replaced by nonterminals; the file has
the rules, the length of each nonterminal's expansion and, for each document, where its symbols begin, so any
document, or any range of its ids, is decoded without touching the rest.

Layout (little-endian): ``SLRP``, u32 vocabulary, u32 rules, u32 documents, u64 symbols; i64 doc ids; u8 null flags of
the ids; u64 first symbol of each document and the end; u32 ids per document; u16 left and u16 right of each rule;
u32 expansion length of each rule; u16 symbols.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import bounded_batches, materialize, shared_dir, shuffle_partitions, tidy
from .tokens import crc32, tokenizer

#: Ids in a shard, about; a longer document is a shard of its own.
SHARD_IDS = 2_000_000
#: Pairs replaced in one round at most, and occurrences that make a pair frequent.
ROUND_RULES, FREQUENT = 4_000, 8
SYMBOLS = 1 << 16
_MIX = np.uint32(0x9E3779B1)


def compress(ids: np.ndarray, vocabulary: int, barrier: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rule k is nonterminal ``vocabulary + k``. No rule contains ``barrier``, which ends documents.

    Rounds go on until no pair is frequent or the symbols run out. In a run of one id, pairs are taken left to right.
    """
    s = ids.astype(np.uint32)
    rules: list[tuple[int, int]] = []
    while (room := min(ROUND_RULES, SYMBOLS - vocabulary - len(rules))) > 0:
        key = (s[:-1] << np.uint32(16)) | s[1:]
        # pairs that can be replaced: without a barrier, and only every other one of a run
        inside = s != barrier
        fits = inside[:-1] & inside[1:]
        twin = np.flatnonzero(s[:-1] == s[1:])
        if len(twin):
            begins = np.diff(twin, prepend=-2) != 1
            fits[twin[(twin - twin[np.maximum.accumulate(np.where(begins, np.arange(len(twin)), 0))]) % 2 == 1]] = False
        order = key[fits]
        order.sort()
        first = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]])) if len(order) else np.zeros(0, np.int64)
        count = np.diff(first, append=len(order))
        first, count = first[count >= FREQUENT], count[count >= FREQUENT]
        pairs = order[first]
        lefts: set[int] = set()
        rights: set[int] = set()
        new: list[int] = []
        for x in pairs[np.argsort(-count, kind="stable")].tolist():
            a, b = x >> 16, x & 0xFFFF
            if a not in rights and b not in lefts:  # then no two occurrences overlap
                lefts.add(a)
                rights.add(b)
                new.append(x)
                if len(new) == room:
                    break
        if not new:
            break
        picked = np.array(new, np.uint32)
        # by a hash of 16 bits; a pair is sought among those that share its hash
        mixed = (picked * _MIX) >> np.uint32(16)
        up = np.argsort(mixed)
        picked, share = picked[up], np.bincount(mixed, minlength=1 << 16)
        is_left, is_right = np.zeros(SYMBOLS, bool), np.zeros(SYMBOLS, bool)
        is_left[picked >> 16] = is_right[picked & 0xFFFF] = True
        fits &= is_left[s[:-1]]
        fits &= is_right[s[1:]]
        at = np.flatnonzero(fits)
        key = key[at]
        q = np.minimum(np.cumsum(share) - share, len(picked) - 1)[(key * _MIX) >> np.uint32(16)]
        for _ in range(int(share.max()) - 1):
            other = np.flatnonzero(picked[q] != key)
            q[other] = np.minimum(q[other] + 1, len(picked) - 1)
        hit = picked[q] == key
        at = at[hit]
        s[at] = (vocabulary + len(rules) + up[q[hit]]).astype(np.uint32)
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s = s[keep]
        rules += [(x >> 16, x & 0xFFFF) for x in new]
    return s.astype(np.uint16), np.array(rules, np.uint16).reshape(-1, 2)


def lengths_of(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """Expansion length of every symbol; the children of a rule always come before it."""
    out = np.ones(vocabulary + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        out[vocabulary + k] = out[a] + out[b]
    return out


class Shard:
    """A file read back. ``document`` and ``ids`` decode only what is asked for."""

    def __init__(self, data: bytes):
        if data[:4] != b"SLRP":
            raise ValueError("not a grammar shard")
        self.vocabulary, n_rules, n, symbols = struct.unpack_from("<IIIQ", data, 4)
        at = 24

        def read(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.null_ids = read("<i8", n), read("u1", n)
        self.first, self.n_ids = read("<u8", n + 1).astype(np.int64), read("<u4", n)
        left, right = read("<u2", n_rules), read("<u2", n_rules)
        stored = read("<u4", n_rules).astype(np.int64)
        self.symbols = read("<u2", symbols)
        self.length = np.concatenate([np.ones(self.vocabulary, np.int64), stored])
        # the expansions of all nonterminals, one after the other
        self.flat_at = np.concatenate([np.zeros(self.vocabulary, np.int64), np.cumsum(stored) - stored])
        flat = np.zeros(int(stored.sum()), np.uint16)
        for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
            i = self.flat_at[self.vocabulary + k]
            for x in (a, b):
                m = self.length[x]
                flat[i : i + m] = x if x < self.vocabulary else flat[self.flat_at[x] : self.flat_at[x] + m]
                i += m
        self.flat = flat

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        if not len(symbols):
            return np.zeros(0, np.uint32)
        m = self.length[symbols]
        stop = np.cumsum(m)
        out = np.repeat(symbols.astype(np.uint32), m)
        inner = np.flatnonzero(out >= self.vocabulary)
        if len(inner):
            begin = np.repeat(stop - m, m)[inner]
            out[inner] = self.flat[self.flat_at[out[inner]] + inner - begin]
        return out

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.first[k] : self.first[k + 1]])

    def ids(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start:stop`` of document k; symbols outside the range are skipped by their lengths."""
        own = self.symbols[self.first[k] : self.first[k + 1]]
        ends = np.cumsum(self.length[own])
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        skip = int(ends[a - 1]) if a else 0
        return self.expand(own[a:b])[start - skip : max(start, stop) - skip]


def shard_bytes(doc_ids: list[int | None], docs: list[np.ndarray], vocabulary: int, barrier: int) -> bytes:
    """A shard file of the documents, each ending in ``barrier``."""
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    symbols, rules = compress(ids, vocabulary, barrier)
    length = lengths_of(rules, vocabulary)
    n_ids = np.array([len(d) for d in docs], np.int64)
    done = np.cumsum(length[symbols]) if len(symbols) else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.searchsorted(done, np.cumsum(n_ids), "left") + 1]) if docs else np.zeros(1)
    return b"".join([
        b"SLRP" + struct.pack("<IIIQ", vocabulary, len(rules), len(docs), len(symbols)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        first.astype("<u8").tobytes(), n_ids.astype("<u4").tobytes(),
        rules[:, 0].astype("<u2").tobytes(), rules[:, 1].astype("<u2").tobytes(),
        length[vocabulary:].astype("<u4").tobytes(), symbols.astype("<u2").tobytes(),
    ])


_SHARD = pa.schema([("part", pa.int64()), ("k", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
_SHARD_DDL = "part long, k long, path string, n_docs long, n_ids long, n_bytes long"


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, vocabulary: int = 49408, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the ids of all documents, in ascending doc_id order, as shard files under ``folder`` (a URI that all
    executors reach); returns the table of shards with ``base``, the ids in all shards before.

    A document is the ids of its whole text and ``end_id``; a null text is empty. Null ids come first, and rows that
    share an id follow each other in the order of their texts. A file appears under its name only when complete,
    so a task that runs again leaves the same files.
    """
    spark = docs.sparkSession
    # ids above the 16-bit range of symbols, or an end id inside a text, would not survive the format
    if vocabulary >= SYMBOLS:
        raise ValueError("the vocabulary does not fit 16-bit symbols")
    ordered = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).repartitionByRange(shuffle_partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = tokenizer(tokenizer_path), TaskContext.get().partitionId()
        where, root = fs.FileSystem.from_uri(folder)
        end = np.array([end_id], np.uint32)
        held: list[np.ndarray] = []
        names: list[int | None] = []
        size = k = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, names, size, k
            data = shard_bytes(names, held, vocabulary, end_id)
            path = f"{root}/shard-{part:06d}-{k:06d}.slrp"
            draft = f"{root}/.{uuid.uuid4().hex}"
            with where.open_output_stream(draft) as out:
                out.write(data)
            where.move(draft, path)
            row = [part, k, path, len(held), size, len(data)]
            held, names, size, k = [], [], 0, k + 1
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SHARD)], schema=_SHARD)

        for b in batches:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), own.encode_column(b.column("text"))):
                if size and size + len(ids) + 1 > shard_ids:
                    yield flush()
                held.append(np.concatenate([ids, end]))
                names.append(doc_id)
                size += len(ids) + 1
        if held:
            yield flush()

    where, root = fs.FileSystem.from_uri(folder)
    where.create_dir(root, recursive=True)
    shards = materialize(ordered.mapInArrow(tidy(write), _SHARD_DDL), "shards")
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return shards.join(parts.select("part", "before"), "part").withColumn("base", F.col("before") + inside).drop("before")


def read_shards(shards: DataFrame, folder: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the shard files."""
    spark = shards.sparkSession
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                with where.open_input_file(path) as f:
                    shard = Shard(f.read())
                n = shard.n_ids.astype(np.int64)
                docs = np.split(shard.expand(shard.symbols), np.cumsum(n)[:-1]) if len(n) else []
                columns = [pa.array(shard.doc_ids, pa.int64(), mask=shard.null_ids.astype(bool)), pa.array(base + np.cumsum(n) - n), pa.array(n), pa.array([crc32(d) for d in docs], pa.int64())]
                if keep_ids:
                    columns.append(pa.array([d.astype("<u4").tobytes() for d in docs], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ddl.split(", ")])

    return shards.select("path", "base").repartition(shuffle_partitions(spark), "path").mapInArrow(tidy(read), ddl)


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/sluice-grammar-{uuid.uuid4().hex}"
    shards = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_shards(materialize(shards, "shards"), folder)
