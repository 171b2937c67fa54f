"""Exact deduplication with a log-structured merge index.

* Memtable: each task holds the normalised texts it meets, keyed by digest. A hit in the memtable is
  verified byte by byte. At a bounded size the memtable is flushed as a run sorted by digest, one row per
  document, in which every local class of equal texts names its best row.
* Filters: every run has a Bloom filter of its digests, all of one size. They are merged into the places that
  two or more runs have set: a digest that several runs hold has all of its places there, so a class head that has not
  is alone and is never looked up again.
* Compaction: the heads that pass the filters are merged by digest over all runs. Digests that several runs do hold
  are hits: their texts are fetched and compared byte by byte, first among the texts of a share of the runs, then
  among the few that are left. Equal bytes make one class, of which the longest original text, then the smallest
  identifier, stays.

A class of any size meets the shuffle as one row per run, and its texts meet in SHARES tasks first, so a text shared by a
third of the corpus is never gathered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import U64, bloom_of, bounded_batches, discard, materialize, mix, shuffle_partitions, tidy

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Limits of a memtable: bytes of distinct normalised text, and rows.
MEMTABLE_BYTES = 32 << 20
MEMTABLE_ROWS = 200_000
#: Tasks over which the texts of one digest are dealt out when they are compared.
SHARES = 64
#: Places of a filter: FILTER_BITS for each row of the table, to a power of two, within these bounds (32 MB at most; a filter
#: that is too small only lets more heads through). Filters are merged in segments of so many bytes.
FILTER_BITS, FILTER_LEAST, FILTER_MOST, SEGMENT = 12, 1 << 16, 1 << 28, 1 << 16
_HASHES = 4

_RUN = pa.schema([("digest", pa.binary()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("run", pa.int64()), ("head", pa.bool_()), ("rep_id", pa.int64()), ("rep_chars", pa.int64()), ("rep_size", pa.int64()), ("probe", pa.int64())])
_RUN_DDL = "digest binary, doc_id long, n_chars long, run long, head boolean, rep_id long, rep_chars long, rep_size long, probe long"

_LOCAL = pa.schema([("digest", pa.binary()), ("share", pa.int32()), ("doc_id", pa.int64()), ("variant", pa.int32()), ("norm", pa.binary())])
_WHOLE = pa.schema([("digest", pa.binary()), ("share", pa.int32()), ("variant", pa.int32()), ("whole", pa.int32())])


def _digest(norm: bytes, bits: int) -> bytes:
    d = hashlib.sha256(norm).digest()
    return d if bits >= 256 else bytes(d[: max(1, bits // 8)])


def _probe(digest: bytes, doc_id: int | None) -> int:
    """What the filter holds of a class head."""
    return hash((int.from_bytes(digest[:7], "little"), -1 if doc_id is None else doc_id))


def _places(digests: list[bytes], bits: int) -> np.ndarray:
    """The places of each digest in a filter of ``bits`` places."""
    raw = np.frombuffer(b"".join([d.ljust(16, b"\0")[:16] for d in digests]), U64).reshape(-1, 2)
    h, step = mix(raw[:, 0]), mix(raw[:, 1] ^ raw[:, 0]) | U64(1)
    with np.errstate(over="ignore"):
        return np.stack([(h + U64(i) * step) & U64(bits - 1) for i in range(_HASHES)], 1).astype(np.int64)


def shared_places(runs: list[list[bytes]], bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(segment, places that a run has set, places that two or more have), of the filters of a task's runs: as places
    within the segment, for a run sets few of a large filter."""
    every = [np.unique(_places(digests, bits)) for digests in runs]
    place, n = np.unique(np.concatenate(every), return_counts=True)
    edge = np.flatnonzero(np.concatenate([[True], np.diff(place // (8 * SEGMENT)) != 0, [True]]))
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
        segment, own = int(place[i]) // (8 * SEGMENT), place[i:j]
        within = (own - segment * 8 * SEGMENT).astype(np.uint32)
        yield segment, within.tobytes(), within[n[i:j] > 1].tobytes()


class Memtable:
    """Classes of equal normalised texts seen since the last flush."""

    def __init__(self, bits: int):
        self.bits, self.rows, self.bytes = bits, 0, 0
        self.classes: dict[bytes, list[list]] = {}  # digest -> [norm, members]; several only if digests collide

    def add(self, doc_id: int | None, text: str | None) -> None:
        text = text or ""
        norm = text.encode("utf-8", "surrogatepass").translate(None, BLANKS)
        digest = _digest(norm, self.bits)
        found = self.classes.setdefault(digest, [])
        member = (-len(text), doc_id is None, doc_id or 0)
        self.rows += 1
        for own in found:
            if own[0] == norm:
                own[1].append(member)
                return
        found.append([norm, [member]])
        self.bytes += len(norm)

    def flush(self, run: int) -> pa.RecordBatch:
        """The sorted run: one row per document, the best of each class marked as its head."""
        out: list[tuple] = []
        for digest in sorted(self.classes):
            for _, members in self.classes[digest]:
                best = min(members)
                rep, seen = (None if best[1] else best[2]), False
                for m in members:
                    head = m == best and not seen
                    seen |= head
                    own = None if m[1] else m[2]
                    out.append((digest, own, -m[0], run, head, rep, -best[0], len(members), _probe(digest, rep)))
        self.classes, self.rows, self.bytes = {}, 0, 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _RUN)], schema=_RUN)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_chars), one row per input row.

    Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``; a null text is
    empty, and empty texts are equal to each other. The row with most code points in the original text stays,
    then the smallest id; a null id ranks after all others. Rows repeated with the same id and text form one
    class in which exactly one row is kept. An empty table gives an empty result; other columns are ignored.
    ``digest_bits`` below 256 is for tests: colliding digests are told apart by the byte verification
    (``text_sha256`` then holds the shortened digest).
    """
    spark = docs.sparkSession
    # only the two columns are read, under names of our own: columns of the input never clash
    docs = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bits, max_bytes, max_rows = digest_bits, MEMTABLE_BYTES, MEMTABLE_ROWS

    def to_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, flushed = Memtable(bits), 0
        part = TaskContext.get().partitionId() << 24
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                table.add(doc_id, text.as_py())
                if table.bytes >= max_bytes or table.rows >= max_rows:
                    yield table.flush(part + flushed)
                    flushed += 1
        if table.rows:
            yield table.flush(part + flushed)

    runs = materialize(docs.mapInArrow(tidy(to_runs), _RUN_DDL), "runs")
    heads = runs.where("head").select("digest", "rep_id", "rep_chars", "rep_size", "run", "probe")
    size = min(max(1 << (FILTER_BITS * runs.count()).bit_length(), FILTER_LEAST), FILTER_MOST)

    def filters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = []
        now = None
        for b in batches:
            for run, digest in zip(b.column("run").to_pylist(), b.column("digest").to_pylist()):
                if run != now:
                    now = run
                    held.append([])
                held[-1].append(digest)
        if held:
            rows = list(shared_places(held, size))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["segment", "once", "twice"])

    def merged_filters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs_at = None, np.zeros(8 * SEGMENT, np.uint8)

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(runs_at > 1, bitorder="little").tobytes()], pa.binary())], names=["segment", "twice"])

        for b in batches:
            for segment, once, twice in zip(*(b.column(c).to_pylist() for c in ("segment", "once", "twice"))):
                if segment != now:
                    if now is not None:
                        yield close()
                    now = segment
                    runs_at[:] = 0
                once, twice = np.frombuffer(once, np.uint32), np.frombuffer(twice, np.uint32)
                runs_at[once] = np.minimum(runs_at[once] + 1, 2)
                runs_at[twice] = 2
        if now is not None:
            yield close()

    made = heads.select("run", "digest").mapInArrow(tidy(filters), "segment int, once binary, twice binary")
    shared = np.zeros(max(size // 8, SEGMENT), np.uint8)  # 32 MB at most
    for row in made.repartition(shuffle_partitions(spark), "segment").sortWithinPartitions("segment").mapInArrow(tidy(merged_filters), "segment int, twice binary").toLocalIterator():
        shared[row.segment * SEGMENT : row.segment * SEGMENT + len(row.twice)] = np.frombuffer(row.twice, np.uint8)

    def passing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = _places(b.column("digest").to_pylist(), size)
                yield b.filter(pa.array(((shared[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)))

    # what passes the filters is merged by digest: one row per run and class
    asked = materialize(heads.mapInArrow(tidy(passing), heads.schema), "asked")
    several = asked.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    hits = materialize(asked.join(several, "digest"), "hits")
    discard(asked)
    keys = bloom_of(hits, "probe")

    def candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["digest", "doc_id", "norm"]
        for b in batches:
            rows, probes = [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                norm = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(None, BLANKS)
                digest = _digest(norm, bits)
                rows.append((digest, doc_id, norm))
                probes.append(_probe(digest, doc_id))
            hit = np.flatnonzero(keys.has(np.array(probes, np.int64))) if rows else []
            rows = [rows[i] for i in hit]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.binary()))], names=names)

    def verify(by: list[str], carried: str, out_schema: pa.Schema):
        """Rows come sorted by ``by``: equal bytes get the same number. One text per number is held, and handed on once if
        the schema has room for it."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, known = None, []
            for b in batches:
                out = []
                for digest, share, own, norm in zip(*(b.column(c).to_pylist() for c in ("digest", "share", carried, "norm"))):
                    key = (digest, share)[: len(by)]
                    if key != now:
                        now, known = key, []
                    k = next((i for i, v in enumerate(known) if v == norm), len(known))
                    new = k == len(known)
                    if new:
                        known.append(norm)
                    out.append((digest, share, own, k, norm if new else None)[: len(out_schema)])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), out_schema)], schema=out_schema)

        return run

    parts = shuffle_partitions(spark)
    texts = docs.mapInArrow(tidy(candidates), "digest binary, doc_id long, norm binary").withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)).cast("int"))
    by = ["digest", "share"]
    local = materialize(texts.repartition(parts, *by).sortWithinPartitions(*by, F.col("doc_id").asc_nulls_last()).mapInArrow(tidy(verify(by, "doc_id", _LOCAL)), "digest binary, share int, doc_id long, variant int, norm binary"), "variants")
    firsts = local.where("norm is not null").drop("doc_id").repartition(parts, "digest").sortWithinPartitions("digest", "share", "variant")
    whole = materialize(firsts.mapInArrow(tidy(verify(["digest"], "variant", _WHOLE)), "digest binary, share int, variant int, whole int"), "wholes")
    variants = local.select("digest", "share", "doc_id", "variant").join(whole, ["digest", "share", "variant"]).select("digest", "doc_id", F.col("whole").alias("variant")).distinct()
    v = variants.select(F.col("digest").alias("v_digest"), F.col("doc_id").alias("v_id"), "variant")
    known = hits.join(v, (hits.digest == v.v_digest) & hits.rep_id.eqNullSafe(v.v_id)).select("digest", "rep_id", "rep_chars", "rep_size", "run", "variant")
    known = materialize(known, "verified")
    discard(hits, local, whole)
    # compaction, second half: classes of equal bytes over all runs
    best = known.groupBy("digest", "variant").agg(F.min(F.struct(-F.col("rep_chars"), F.col("rep_id").isNull(), F.col("rep_id").alias("keep_id"), F.col("run").alias("keep_run"))).alias("b"), F.sum("rep_size").alias("size"))
    merged = known.join(best, ["digest", "variant"]).select(F.col("digest").alias("m_digest"), F.col("rep_id").alias("m_rep"), F.col("run").alias("m_run"), F.col("b.keep_id").alias("keep_id"), F.col("b.keep_run").alias("keep_run"), "size")
    r = runs.join(merged, (runs.digest == merged.m_digest) & (runs.run == merged.m_run) & runs.rep_id.eqNullSafe(merged.m_rep), "left")
    found = F.col("m_digest").isNotNull()
    return r.select(
        "doc_id",
        F.when(found, F.col("keep_id")).otherwise(F.col("rep_id")).alias("keep_id"),
        F.when(found, F.col("size")).otherwise(F.col("rep_size")).alias("group_size"),
        (F.col("head") & (~found | ((F.col("run") == F.col("keep_run")) & F.col("rep_id").eqNullSafe(F.col("keep_id"))))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_chars",
    )


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_chars")


_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"
OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_NORM} AS norm, length(coalesce(text, '')) AS n FROM documents),
h AS (SELECT doc_id, n, sha256(norm) AS text_sha256 FROM d)
SELECT doc_id,
  first_value(doc_id) OVER w AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept,
  text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
