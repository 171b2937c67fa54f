"""Removal of repeated substrings by longest-previous-factor arrays.

A byte is removed when a string of LENGTH bytes that covers it also starts earlier. The strings are first dealt out so
that equal ones meet: every string has a minimizer, the smallest hashed k-gram in it, and consecutive strings with
the same minimizer form a segment of the text.

* Segments are keyed by (hash of the minimizer, hash of their bytes). Of equal segments only the first needs to be looked
  at further; the bytes of all later ones are removed. Tasks do this among their own segments before the shuffle, so
  a passage that a third of the corpus holds crosses it once per task.
* Different segments that share a minimizer may still share strings. Their bytes are fetched, and for each group a suffix
  array of the strings is built, truncated at LENGTH bytes. The previous and next smaller positions in suffix order are the
  nearest earlier texts' strings; where the longest common prefix with one of them reaches LENGTH, the string has
  an earlier copy.
* A group with very many different segments is worked on in parts; strings that are first in their part then meet by
  their own hash, so no group is ever gathered whole.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import U64, Bloom, bloom_of, bounded_batches, discard, int_list, materialize, mix, powers, row_groups, shuffle_partitions, text_bytes, tidy

LENGTH = 100
K = 32
#: Bytes worked on at once; longer texts overlap by LENGTH - 1.
PIECE = 1 << 18
_POS = 20
#: Segments of one minimizer in a part at most, and bytes of segments under one suffix array, about.
PART, ARRAY_BYTES = 4096, 1 << 20
#: Bytes of text whose segments meet at once, about: a partition has as many buckets as it needs.
BUCKET_BYTES = 16 << 20
_BASE = 0xD1B54A32D192ED03
_INVERSE = pow(_BASE, -1, 2**64)
#: Stands for a null id, which is after all others.
_NULL = 2**63 - 1


def _prefix_sums(body: np.ndarray) -> np.ndarray:
    n = len(body)
    out = np.zeros(n + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum((body.astype(U64) + U64(1)) * powers(_BASE, n), out=out[1:])
    return out


def _hashes(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [a, b), given the prefix sums."""
    with np.errstate(over="ignore"):
        return mix((total[b] - total[a]) * powers(_INVERSE, len(total))[a] + mix((b - a).astype(U64)))


def text_key(body: np.ndarray) -> int:
    """Tells apart rows that share an id."""
    return int.from_bytes(hashlib.blake2b(body.tobytes(), digest_size=8).digest(), "little", signed=True)


def segments(body: np.ndarray, at: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of strings, minimizer hash, hash of the bytes) of the segments of the rows of ``body``."""
    n = len(body)
    start = np.zeros(n + 1, np.int32)  # +1 where strings begin to be possible, -1 where they end
    long = np.diff(at) >= length
    np.add.at(start, at[:-1][long], 1)
    np.add.at(start, at[1:][long] - length + 1, -1)
    valid = np.cumsum(start[:n]) > 0
    if not valid.any():
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U64),) * 2
    total = _prefix_sums(body)
    with np.errstate(over="ignore"):
        gram = mix((total[k:] - total[:-k]) * powers(_INVERSE, n + 1)[: n - k + 1])
    v = (gram & ~U64((1 << _POS) - 1)) | np.arange(len(gram), dtype=U64)  # ties: the leftmost
    width, have = length - k + 1, 1
    while 2 * have <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    if have < width:
        v = np.minimum(v[: len(v) - (width - have)], v[width - have :])
    mini = (v & U64((1 << _POS) - 1)).astype(np.int64)  # of the string that starts at each position
    valid = valid[: len(mini)]
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (mini[1:] != mini[:-1])
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first |= valid & edge[: len(valid)]
    begin = np.flatnonzero(first)
    stop = np.flatnonzero(np.append(valid[:-1] & (first[1:] | ~valid[1:]), valid[-1])) + 1
    return begin, stop - begin, gram[mini[begin]], _hashes(total, begin, stop + length - 1)


def smaller_neighbours(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the previous and the next strictly smaller value (-1 and len(v) where there is none)."""
    n = len(v)
    out = []
    for own in (v, v[::-1]):
        at = np.arange(n) - 1
        work = np.arange(n)
        while len(work):
            work = work[at[work] >= 0]
            work = work[own[at[work]] >= own[work]]
            at[work] = at[at[work]]
        out.append(at)
    return out[0], n - 1 - out[1][::-1]


def suffix_order(text: np.ndarray, own: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the strings of ``length`` bytes at ``own`` in suffix order, and for each whether the one before it
    is equal over the whole length (a longest common prefix truncated there: ``length``, else 0)."""
    if not len(own):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(U64)
    key = np.zeros(len(text), U64)
    for j in range(8):
        key |= padded[j : j + len(text)] << U64(8 * (7 - j))
    have = 8
    _, rank = np.unique(key, return_inverse=True)
    while 2 * have <= length:  # prefix doubling
        behind = np.zeros(len(rank), np.int64)
        behind[: len(rank) - have] = rank[have:]
        _, rank = np.unique(rank * (rank.max() + 1) + behind, return_inverse=True)
        have *= 2
    last = rank[own + length - have]
    _, rank = np.unique(rank[own] * (rank.max() + 1) + last, return_inverse=True)
    order = np.argsort(rank, kind="stable")
    sorted_ = rank[order]
    return order, np.concatenate([[0], np.where(sorted_[1:] == sorted_[:-1], length, 0)])


def longest_previous(position: np.ndarray, order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """The (truncated) longest-previous-factor array: for each string, the longest prefix that it shares with one at a
    smaller position. ``lcp`` has two values only, so the minimum over a range is whether a 0 lies in it."""
    p = position[order]
    before, after = smaller_neighbours(p)
    breaks = np.concatenate([[0], np.cumsum(lcp == 0)])  # breaks[j]: zeros among lcp[:j]
    n, here = len(p), np.arange(len(p))
    got = (before >= 0) & (breaks[here + 1] == breaks[before + 1])
    got |= (after < n) & (breaks[np.minimum(after, n - 1) + 1] == breaks[here + 1])
    out = np.empty(n, np.int64)
    out[order] = np.where(got, lcp.max(initial=0), 0)
    return out


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of maximal runs of consecutive integers in a sorted array."""
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) != 1)
    first = np.concatenate([[0], cut + 1])
    return at[first], np.concatenate([cut + 1, [len(at)]]) - first


def _later(group: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Which of the rows, sorted by group and then place, are not at the first place of their group."""
    if not len(group):
        return np.zeros(0, bool)
    new = np.concatenate([[True], group[1:] != group[:-1]])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    return np.any([p != p[head] for p in place], axis=0)


def _pieces(body: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    step = PIECE - length
    for i in range(0, max(1, len(body) - length + 1), step):
        yield i, body[i : i + step + length - 1]


_BUCKET = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
_FOUND_DDL = "part long, mini long, doc long, txt long, start long, n long"


def _pack(ids: np.ndarray, keys: np.ndarray, mini: np.ndarray, seg: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray, gone: np.ndarray) -> bytes:
    docs, at = np.unique(row, return_inverse=True)
    return b"".join([struct.pack("<II", len(docs), len(row)), ids[docs].tobytes(), keys[docs].tobytes(), mini.tobytes(), seg.tobytes(), at.astype("<u4").tobytes(), start.astype("<u4").tobytes(), n.astype("<u4").tobytes(), gone.tobytes()])


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    m, n = struct.unpack_from("<II", blob)
    at, out = 8, []
    for kind, count in (("<i8", m), ("<i8", m), ("<u8", n), ("<u8", n), ("<u4", n), ("<u4", n), ("<u4", n), ("u1", n)):
        out.append(np.frombuffer(blob, kind, count, at))
        at += out[-1].nbytes
    ids, keys, mini, seg, row, start, length, gone = out
    return ids[row], keys[row], mini, seg, start.astype(np.int64), length.astype(np.int64), gone


def _rows(part: np.ndarray, mini: np.ndarray, doc: np.ndarray, txt: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == U64 else x.astype(np.int64)) for x in (part, mini, doc, txt, start, n)], names=[c.split()[0] for c in _FOUND_DDL.split(", ")])


def substring_dedup(docs: DataFrame, length: int = LENGTH, keep_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]), one row per row of ``docs``.

    Texts are whole, as UTF-8; null is empty. A byte is removed when a string of ``length`` bytes covering it also
    starts earlier: in a smaller doc_id, or earlier in the same document; overlaps count, no string crosses documents.
    Rows with equal id and text are one document and get the same result; rows that share an id but not the text
    are in the order of a hash of their texts; a null id comes after all others. An empty table gives no row; other
    columns are ignored. Strings meet by 128 bits of hashes of their segment. ``keep_bytes`` adds the remaining bytes.
    """
    spark = docs.sparkSession
    docs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    parts = shuffle_partitions(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = parts * max(1, -(-total // (parts * BUCKET_BYTES)))
    k = min(K, max(8, length // 2))

    def ids_of(b: pa.RecordBatch) -> np.ndarray:
        return b.column("doc_id").fill_null(_NULL).to_numpy()

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body, at = text_bytes(b.column("text"))
            ids = ids_of(b)
            rows = np.flatnonzero(np.diff(at) >= length)
            if not len(rows):
                continue
            keys = np.zeros(len(ids), np.int64)
            for r in rows.tolist():
                keys[r] = text_key(body[at[r] : at[r + 1]])
            found: list[tuple] = []
            for i, j in row_groups(at, PIECE):
                if j - i == 1 and at[j] - at[i] > PIECE:
                    for off, piece in _pieces(body[at[i] : at[j]], length):
                        s = segments(piece, np.array([0, len(piece)]), length, k)
                        found.append((np.full(len(s[0]), i), s[0] + off, *s[1:]))
                else:
                    own = at[i : j + 1] - at[i]
                    s = segments(body[at[i] : at[j]], own, length, k)
                    row = np.searchsorted(own, s[0], "right") - 1
                    found.append((row + i, s[0] - own[row], *s[1:]))
            row, start, n, mini, seg = (np.concatenate(x) for x in zip(*found))
            # the first of equal segments of this batch goes on; the others' bytes are known to be removed
            with np.errstate(over="ignore"):
                both = mini * U64(0x9E3779B97F4A7C15) ^ seg
            order = np.lexsort((start, keys[row], ids[row], both))
            gone = np.zeros(len(row), np.uint8)
            gone[order] = _later(both[order], ids[row][order], keys[row][order], start[order])
            bucket = (mini % U64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
            names, blobs = [], []
            for q in np.flatnonzero(np.diff(edges)).tolist():
                own = by[edges[q] : edges[q + 1]]
                names.append(q)
                blobs.append(_pack(ids, keys, mini[own], seg[own], row[own], start[own], n[own], gone[own]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], schema=_BUCKET)

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """part -1: bytes to remove; else segments whose minimizer has several different ones."""

        def close(blobs: list[bytes]) -> pa.RecordBatch:
            doc, txt, mini, seg, start, n, gone = (np.concatenate(x) for x in zip(*map(_unpack, blobs)))
            lost = gone == 1
            out = [(np.full(lost.sum(), -1), mini[lost], doc[lost], txt[lost], start[lost], n[lost] + length - 1)]
            live = np.flatnonzero(~lost)
            order = live[np.lexsort((start[live], txt[live], doc[live], seg[live], mini[live]))]
            new = np.concatenate([[True], (mini[order][1:] != mini[order][:-1]) | (seg[order][1:] != seg[order][:-1])]) if len(order) else np.zeros(0, bool)
            later = _later(np.cumsum(new), doc[order], txt[order], start[order])
            x = order[later]
            out.append((np.full(len(x), -1), mini[x], doc[x], txt[x], start[x], n[x] + length - 1))
            x = order[new]
            first = np.concatenate([[True], mini[x][1:] != mini[x][:-1]]) if len(x) else np.zeros(0, bool)
            group = np.cumsum(first) - 1
            size = np.bincount(group) if len(x) else group
            many = size[group] > 1 if len(x) else first
            # parts by bytes, a segment counting as 1 / PART of them at least
            weight = np.maximum(n[x] + length - 1, ARRAY_BYTES // PART)
            upto = np.concatenate([[0], np.cumsum(weight)])
            own = upto[:-1] - upto[np.flatnonzero(first)][group] if len(x) else group
            part = np.where(np.bincount(group, weight)[group] > ARRAY_BYTES, 1 + own // ARRAY_BYTES, 0) if len(x) else group
            x, part = x[many], part[many]
            out.append((part, mini[x], doc[x], txt[x], start[x], n[x]))
            return _rows(*(np.concatenate(c) for c in zip(*out)))

        now, held = None, []
        for b in batches:
            for q, blob in zip(b.column("bucket").to_pylist(), b.column("blob").to_pylist()):
                if q != now and held:
                    yield close(held)
                    held = []
                now = q
                held.append(blob)
        if held:
            yield close(held)

    dealt = docs.mapInArrow(tidy(deal), "bucket int, blob binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = materialize(dealt.mapInArrow(tidy(meet), _FOUND_DDL), "segments")
    open_ = found.where("part >= 0")
    asked = open_.groupBy("doc", "txt").agg(F.collect_list(F.struct("part", "mini", "start", "n")).alias("s"))

    def texts_of(keys: Bloom):
        def wanted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hit = pa.array(keys.has(ids_of(b)))
                own = b.filter(hit)
                if own.num_rows:
                    body, at = text_bytes(own.column("text"))
                    txt = [text_key(body[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(ids_of(own)), pa.array(txt, pa.int64()), own.column("text")], names=["doc", "txt", "text"])

        return wanted

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j in row_groups(text_bytes(whole.column("text"))[1], ARRAY_BYTES):
                b = whole.slice(i, j - i)
                body, at = text_bytes(b.column("text"))
                s = b.column("s")
                owner = np.repeat(np.arange(b.num_rows), s.value_lengths().to_numpy())
                f = s.flatten()
                part, mini, start, n = (f.field(c).to_numpy() for c in ("part", "mini", "start", "n"))
                raw = body.tobytes()
                a = at[owner] + start
                pieces = [raw[x:y] for x, y in zip(a.tolist(), (a + n + length - 1).tolist())]
                doc, txt = int_list(b, "doc"), int_list(b, "txt")
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(mini), pa.array(doc[owner]), pa.array(txt[owner]), pa.array(start), pa.array(n), pa.array(pieces, pa.binary())], names=["part", "mini", "doc", "txt", "start", "n", "bytes"])

    def factors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans to remove (kind 0); of minimizers worked on in parts also the strings that are first in their part (1)."""

        def close(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            part, doc, txt, start, n = (t.column(c).to_numpy() for c in ("part", "doc", "txt", "start", "n"))
            text = np.frombuffer(b"".join(t.column("bytes").to_pylist()), np.uint8)
            seg_at = np.cumsum(n + length - 1) - (n + length - 1)
            owner = np.repeat(np.arange(len(n)), n)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            place = (doc[owner], txt[owner], start[owner] + inner)
            by = np.lexsort(place[::-1])
            rank = np.empty(len(owner), np.int64)  # repeated rows are at one place
            rank[by] = np.cumsum(np.concatenate([[0], np.any([p[by][1:] != p[by][:-1] for p in place], axis=0)]))
            order, lcp = suffix_order(text, seg_at[owner] + inner, length)
            known = longest_previous(rank, order, lcp) >= length
            # runs of strings with an earlier copy, per segment
            hit = np.flatnonzero(known)
            a, m = _runs(hit + owner[hit])  # the owner's number separates neighbouring segments
            i = hit[np.searchsorted(hit + owner[hit], a)]
            zero = np.zeros(len(i), np.int64)
            out = [(zero, zero, zero, doc[owner[i]], txt[owner[i]], start[owner[i]] + inner[i], m + length - 1)]
            rest = np.flatnonzero(~known & (part[owner] > 0))
            if len(rest):
                total = _prefix_sums(text)
                at = seg_at[owner[rest]] + inner[rest]
                h1 = _hashes(total, at, at + length)
                h2 = _hashes(total, at, at + length // 2) ^ mix(_hashes(total, at + length // 2, at + length))
                out.append((np.ones(len(rest), np.int64), h1.view(np.int64), h2.view(np.int64), doc[owner[rest]], txt[owner[rest]], start[owner[rest]] + inner[rest], np.full(len(rest), length)))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["kind", "h1", "h2", "doc", "txt", "start", "n"])

        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for b in batches:
            part, mini = int_list(b, "part"), int_list(b, "mini")
            new = np.flatnonzero(np.concatenate([[last is not None and (part[0], mini[0]) != last], (part[1:] != part[:-1]) | (mini[1:] != mini[:-1])])) if b.num_rows else []
            i = 0
            sizes = np.concatenate([[0], np.cumsum(int_list(b, "n") + length - 1)])
            for j in new:
                if size + sizes[j] - sizes[i] >= ARRAY_BYTES:
                    held.append(b.slice(i, j - i))
                    yield close(held)
                    held, size, i = [], 0, int(j)
            held.append(b.slice(i))
            size += int(sizes[-1] - sizes[i])
            if b.num_rows:
                last = (part[-1], mini[-1])
        if any(h.num_rows for h in held):
            yield close(held)

    texts = docs.mapInArrow(texts_of(bloom_of(open_, "doc")), "doc long, txt long, text string")
    pieces = texts.join(asked, ["doc", "txt"]).select("doc", "txt", "text", "s").mapInArrow(tidy(fetch), "part long, mini long, doc long, txt long, start long, n long, bytes binary")
    factor = materialize(pieces.repartition(parts, "mini", "part").sortWithinPartitions("mini", "part").mapInArrow(tidy(factors), "kind long, h1 long, h2 long, doc long, txt long, start long, n long"), "factors")
    single = factor.where("kind = 1")
    first = single.groupBy("h1", "h2").agg(F.min(F.struct("doc", "txt", "start")).alias("f"), F.count("*").alias("c")).where("c > 1").select("h1", "h2", "f")
    across = single.join(first, ["h1", "h2"]).where(F.struct("doc", "txt", "start") != F.col("f"))
    spans = found.where("part < 0").select("doc", "txt", "start", "n").union(factor.where("kind = 0").select("doc", "txt", "start", "n")).union(across.select("doc", "txt", "start", "n"))
    spans = materialize(spans.groupBy("doc", "txt").agg(F.collect_list(F.struct("start", "n")).alias("s")), "spans")
    discard(found, factor)
    touched = bloom_of(spans, "doc")
    out_ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without any span are done here; the others go to their spans."""
        for b in batches:
            body, at = text_bytes(b.column("text"))
            ids = ids_of(b)
            hit = touched.has(ids)
            bounds = list(zip(at[:-1].tolist(), at[1:].tolist()))
            sha = [None if h else hashlib.sha256(body[x:y]).hexdigest() for h, (x, y) in zip(hit.tolist(), bounds)]
            txt = [text_key(body[x:y]) if h else 0 for h, (x, y) in zip(hit.tolist(), bounds)]
            own = [body[x:y].tobytes() if h or keep_bytes else None for h, (x, y) in zip(hit.tolist(), bounds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids), pa.array(txt, pa.int64()), pa.array(np.diff(at)), pa.array(sha, pa.string()), pa.array(own, pa.binary())], names=["doc_id", "doc", "txt", "n_bytes", "sha", "body"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list] = [[] for _ in range(5 + keep_bytes)]
            for doc_id, n, sha, body, s in zip(*(b.column(c) for c in ("doc_id", "n_bytes", "sha", "body", "s"))):
                n, sha, removed, spans_ = n.as_py(), sha.as_py(), 0, 0
                raw = body.as_py()
                if sha is None:
                    flag = np.zeros(n + 1, np.int32)
                    if s.is_valid:
                        f = s.values
                        a, m = f.field("start").to_numpy(), f.field("n").to_numpy()
                        np.add.at(flag, a, 1)
                        np.add.at(flag, a + m, -1)
                    gone = np.cumsum(flag[:n]) > 0
                    removed, spans_ = int(gone.sum()), len(_runs(np.flatnonzero(gone))[0])
                    raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    sha = hashlib.sha256(raw).hexdigest()
                for c, v in zip(columns, (doc_id.as_py(), n, removed, spans_, sha, raw)):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in out_ddl.split(", ")])

    scanned = docs.mapInArrow(tidy(scan), "doc_id long, doc long, txt long, n_bytes long, sha string, body binary")
    return scanned.join(spans, ["doc", "txt"], "left").select("doc_id", "n_bytes", "sha", "body", "s").mapInArrow(tidy(cut), out_ddl)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
