"""Shared ground of the training-data operators: shared-storage tables, Arrow batches, hashing, Bloom filters, components.

Nothing here is specific to one operator. Every helper keeps its memory bounded by a
documented parameter, and every intermediate table goes to the folder that the session
names in ``spark.checkpoint.dir`` so that a lost executor never loses data.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once by the vectorised kernels; larger documents are cut at white space.
CHUNK_BYTES = 1 << 20

ASCII_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(ASCII_SPACE)] = True
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

U64 = np.uint64


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of the data directory; only Spark touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A private one is made only where the session names none and the executors are
    threads of this process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sluice-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and return the written table: lineage ends here and nothing is computed twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sluice-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (out, path)
    return out


_written: dict[int, tuple[DataFrame, str]] = {}


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read again: what was derived from them must itself be written."""
    for df in tables:
        _, path = _written.pop(id(df), (None, None))
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


#: Bytes of Arrow data handed to a Python worker at once, unless the session has a setting of its own.
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """Hand texts to Python workers in batches bounded by bytes; the setting holds for the session."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) in ("67108864b", "67108864", "64MB", "64m"):  # the default
        conf.set(key, str(BATCH_BYTES))
    return df


#: What a worker process keeps from task to task, as long as they are tasks of one function.
kept: list[dict] = []
_last = [""]


def hand_back() -> None:
    """Free memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def begin(function: str) -> None:
    """Drop what the tasks of another function have left in this worker: what they kept, and what they held when their
    last task ended, such as models."""
    if function != _last[0]:
        _last[0] = function
        for cache in kept:
            cache.clear()
        gc.collect()
        hand_back()


def tidy(run):
    """An Arrow function that hands the memory it used back to the system when a task ends, and what it kept when tasks of
    another function begin: workers live on, and what one stage held would stand beside what the next one needs."""
    function = f"{run.__module__}.{run.__qualname__}"

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(function)
        try:
            yield from run(batches)
        finally:
            hand_back()

    return wrapped


#: Rows of two or three integers that are sent to every task at most (about 16 MB).
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcasting if a count shows it to be small; larger tables are joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- arrow


def int_list(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the row offsets into them; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.type in (pa.large_string(), pa.large_binary())
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    if column.null_count:  # a null row may own bytes in principle
        length = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(at))
        if length.sum() != at[-1]:
            keep = np.concatenate([np.arange(a, a + k) for a, k in zip(at[:-1], length)] or [np.zeros(0, np.int64)])
            body = body[keep]
        at = np.concatenate([[0], np.cumsum(length)])
    return body, at


def row_groups(at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of about ``limit`` bytes; a row above the limit stands alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


# ---------------------------------------------------------------- spans


class Spans:
    """Intervals [start, end) that can be asked, in logarithmic time, whether one of them meets another."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        own = sorted(spans)
        self.start = [a for a, _ in own]
        self.reach = list(accumulate((b for _, b in own), max))  # the farthest end of those up to here
        self.more: list[tuple[int, int]] = []

    def meets(self, a: int, b: int) -> bool:
        i = bisect_left(self.start, b)
        if i and self.reach[i - 1] > a:
            return True
        j = bisect_left(self.more, (b,))
        return j > 0 and self.more[j - 1][1] > a

    def add(self, a: int, b: int) -> None:
        """An interval that meets none of those already added."""
        insort(self.more, (a, b))


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit lanes."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}
kept.append(_powers)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(-(-max(n, 1) >> 16 << 16), base, U64)
        step[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[base] = np.cumprod(step)
    return have[:n]


def _words(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end of each maximal run of non-space bytes (never crossing a row), and the words per row."""
    solid = ~IS_SPACE[body]
    n = len(body)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid
    last[:-1] &= ~(solid[1:] & ~edge[1:n])
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.diff(np.searchsorted(start, at))


def word_spans(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _words(body, at)


def word_hashes(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` of each row, in order, and the number of words per row."""
    start, end, per_row = _words(body, at)
    if not len(start):
        return np.zeros(0, U64), per_row
    n = len(body)
    with np.errstate(over="ignore"):
        total = np.cumsum((body.astype(U64) + U64(1)) * powers(_BASE, n))
        got = total[end - 1].copy()
        inner = start > 0
        got[inner] -= total[start[inner] - 1]
        got *= powers(_INVERSE, n)[start]
        return mix(got ^ ((end - start).astype(U64) << U64(48))), per_row


def document_words(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of every row, whole texts; long rows are cut at white space only to bound memory."""
    body, at = text_bytes(column)
    for i, j in row_groups(at):
        part, own = body[at[i] : at[j]], at[i : j + 1] - at[i]
        if lower:
            part = np.frombuffer(part.tobytes().translate(LOWER), np.uint8)
        if j - i == 1 and len(part) > 2 * CHUNK_BYTES:
            yield i, np.concatenate([word_hashes(x, np.array([0, len(x)]))[0] for x in _cuts(part)])
            continue
        hashes, per_row = word_hashes(part, own)
        stop = np.cumsum(per_row)
        for k in range(j - i):
            yield i + k, hashes[stop[k] - per_row[k] : stop[k]]


def _cuts(part: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces of one long text, each ending at white space; a longer word stays whole."""
    i, n = 0, len(part)
    while i < n:
        j = min(n, i + CHUNK_BYTES)
        while j < n:
            space = np.flatnonzero(IS_SPACE[part[j : j + CHUNK_BYTES]])
            if len(space):
                j += int(space[0])
                break
            j = min(n, j + CHUNK_BYTES)
        yield part[i:j]
        i = j


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles in order; with fewer words the whole sequence is one; none without words."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for i in range(1, k):
            out = mix(out * U64(0xD6E8FEB86659FD93) + words[i : i + n])
        return mix(out + U64(k))


# ---------------------------------------------------------------- Bloom filters


class Bloom:
    """A Bloom filter over 64-bit integers of at most 32 MB, so it can always be sent to every task; when more keys
    enter than it can tell apart it only lets more rows through, which the exact join behind it drops."""

    def __init__(self, bits: int = 1 << 25, data: np.ndarray | None = None):
        self.bits = bits
        self.data = np.zeros(bits // 8, np.uint8) if data is None else data

    def _places(self, keys: np.ndarray) -> list[np.ndarray]:
        h = mix(keys.astype(np.int64).view(U64))
        step = (h >> U64(32)) | U64(1)
        with np.errstate(over="ignore"):
            return [((h + U64(i) * step) & U64(self.bits - 1)).astype(np.int64) for i in range(4)]

    def add(self, keys: np.ndarray) -> None:
        for p in self._places(keys):
            np.bitwise_or.at(self.data, p >> 3, (1 << (p & 7)).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for p in self._places(keys):
            out &= (self.data[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return out


#: Bits of a filter: BLOOM_BITS for each key, to a power of two, within these bounds.
BLOOM_BITS, BLOOM_LEAST, BLOOM_MOST = 12, 1 << 16, 1 << 28


def bloom_of(df: DataFrame, column: str) -> Bloom:
    """The filter of an integer column of a written table, as large as its number of rows asks for: partial filters on the
    executors, combined on the driver one after the other (16 at most)."""
    bits = min(max(1 << (BLOOM_BITS * df.count()).bit_length(), BLOOM_LEAST), BLOOM_MOST)

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Bloom(bits)
        for b in batches:
            f.add(int_list(b, column))
        yield pa.RecordBatch.from_pydict({"f": [f.data.tobytes()]}, schema=pa.schema([("f", pa.binary())]))

    out = Bloom(bits)
    for row in df.select(column).where(F.col(column).isNotNull()).coalesce(16).mapInArrow(partial, "f binary").toLocalIterator():
        out.data |= np.frombuffer(row.f, np.uint8)
    return out


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of an undirected graph given by (a, b) rows; ``comp`` is the smallest node reachable.

    Alternating large-star and small-star steps; each step is written to the shared folder.
    Hot nodes are combined on the map side, so no star is ever gathered in one task.
    Null or empty edges give an empty table; loops and repeated edges are harmless.
    """
    now = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = materialize(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    stars = now.groupBy("a").agg(F.min("b").alias("comp")).select(F.col("a").alias("node"), "comp")
    return stars.union(stars.select(F.col("comp").alias("node"), "comp").distinct())
