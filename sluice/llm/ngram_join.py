"""Exact Jaccard self-join on word shingles by multiple-global-order filtering.

Two sets that are similar enough must share a token among the first few of each set, under *any* order of all tokens
(prefix filtering). Three orders are used: shingles that are known to be frequent come last in each, the others are ranked by
the frequencies of their words in three ways, and ties are broken by different hashes, so rare shingles come first. Postings of
the first order give candidates; a candidate must also share prefix tokens under the other two before its texts are
compared exactly.

A signature holds the parity of the number of tokens in each hash bucket; it has about as many buckets as the set has
tokens. The buckets in which two signatures differ are at most the tokens in which the sets differ, so pairs that differ in
too many are dropped without looking at the sets.

Equal sets are one node. Every node is first compared with the head of a posting list that it shares most tokens with; what
is linked then is one component. Only pairs of *different* components remain; those of a posting list are compared
inside tasks, in blocks of a list, by their signatures and then by their sets, and only links that join components become
rows. So no link between different components is lost, no list is gathered in one task, and a group of copies or near copies
costs about one row per member.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import U64, bloom_of, bounded_batches, components, discard, document_words, int_list, materialize, mix, shingles, shuffle_partitions, small, text_bytes, tidy

#: Words and shingles whose frequency is known to the token orders; all others count as rarer. The tables (3 MB) go to every
#: task. They decide about the orders only, never about the result.
FREQUENT_WORDS, FREQUENT_SHINGLES = 1 << 16, 1 << 18
_SEEDS = (U64(0x1D8E4E27C47D124F), U64(0xA5A3B1C9F0D4E6F7), U64(0x6C62272E07BB0142))

_ROW_DDL = "doc_id long, n long, s1 long, s2 long, p1 binary, p2 binary, p3 binary, sig binary"
#: Nodes of a batch with the same prefix token that make a list of their own.
LOCAL_LIST = 64
#: Words that are sorted at once when words are counted.
COUNT_WORDS = 1 << 20
#: Bytes of a signature, which has a bit for each hash bucket: as many as tokens, to a power of two, within these bounds.
SIGNATURE_BYTES = (32, 1024)
#: Members of a posting list that are compared with each other in one task; longer lists are dealt out in pairs of blocks.
BLOCK = 4096
#: Bytes of the sets of a block, about, where lists are compared exactly.
BLOCK_BYTES = 16 << 20
#: Pairs between two looks at the components that they join.
FOREST_PAIRS = 1 << 14
#: Tokens of the smallest that a node has in lists of several components: a pair that shares one of them is a row of the
#: list of the smallest only.
FIRST_TOKENS = 8
#: Pairs looked at in one step, and bytes of their signatures.
STEP_PAIRS, STEP_BYTES = 1 << 20, 32 << 20


def levels(docs: DataFrame, k: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(hashes, sorted; level = 4 log2 of the count) of the most frequent words of all texts, and of the most frequent
    shingles. What occurs once in COUNT_WORDS words is not counted there: a lower bound, good enough to order by."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size
            out = []
            for kind, own in enumerate(held):
                w, n = np.unique(np.concatenate(own), return_counts=True)
                w, n = w[n > 1], n[n > 1]
                out.append((np.full(len(w), kind, np.int32), w.view(np.int64), n.astype(np.int64)))
            held, size = ([], []), 0
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["kind", "w", "n"])

        for b in batches:
            for _, w in document_words(b.column("text")):
                held[0].append(w)
                held[1].append(np.unique(shingles(w, k)))
                size += len(w)
                if size >= COUNT_WORDS:
                    yield close()
        if held[0]:
            yield close()

    counted = materialize(docs.select("text").mapInArrow(tidy(count), "kind int, w long, n long").groupBy("kind", "w").agg(F.sum("n").alias("n")), "counts")
    out = []
    for kind, most in enumerate((FREQUENT_WORDS, FREQUENT_SHINGLES)):
        top = counted.where(F.col("kind") == kind).select("w", "n").orderBy(F.desc("n"), "w").limit(most).toArrow()
        w, n = top.column("w").to_numpy().view(U64), top.column("n").to_numpy()
        order = np.argsort(w)
        out.append((w[order], np.minimum(4 * np.log2(np.maximum(n[order], 1)), 255).astype(np.uint8)))
    discard(counted)
    return out[0], out[1]


def _level(keys: np.ndarray, values: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(of), U64)
    at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
    return np.where(keys[at] == of, values[at], 0).astype(U64)


class Orders:
    """Token sets of texts and their prefixes under the three orders."""

    def __init__(self, k: int, percent: int, words: np.ndarray, levels: np.ndarray, common: np.ndarray | None = None, common_levels: np.ndarray | None = None):
        self.k, self.percent, self.words, self.levels = k, percent, words, levels
        self.common = np.zeros(0, U64) if common is None else common
        self.common_levels = np.zeros(0, np.uint8) if common_levels is None else common_levels

    def prefixes(self, w: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(distinct shingles, for each order the tokens of its prefix). w: the words of a text."""
        tokens, first = np.unique(shingles(w, self.k), return_index=True)
        n = len(tokens)
        if not n:
            return tokens, [tokens] * 3
        k = min(self.k, len(w))
        lv = _level(self.words, self.levels, w)
        each = np.stack([lv[i + first] for i in range(k)])
        known = _level(self.common, self.common_levels, tokens) << U64(56)
        size = n - (self.percent * n + 99) // 100 + 1
        out = []
        for rank, seed in zip((each.sum(0), each.max(0), each.min(0)), _SEEDS):
            key = known | (np.minimum(rank.astype(U64), U64(4095)) << U64(44)) | (mix(tokens ^ seed) >> U64(20))
            out.append(tokens[np.argpartition(key, size - 1)[:size]] if size < n else tokens)
        return tokens, out


def signature(tokens: np.ndarray) -> bytes:
    """Parities of the hash buckets, as bytes: bucket i is bit i % 8, counted from the highest, of byte i // 8."""
    size = min(max(1 << max(len(tokens) - 1, 1).bit_length() >> 3, SIGNATURE_BYTES[0]), SIGNATURE_BYTES[1])
    return np.packbits((np.bincount((tokens & U64(8 * size - 1)).astype(np.int64), minlength=8 * size) & 1).astype(np.uint8)).tobytes()


def folded(sig: np.ndarray, size: int) -> np.ndarray:
    """Rows of signatures with fewer buckets: parities of merged buckets are the sums of theirs."""
    while sig.shape[1] > size:
        half = sig.shape[1] // 2
        sig = sig[:, :half] ^ sig[:, half:]
    return sig


def token_rows(docs: DataFrame, orders: Orders) -> DataFrame:
    """One row per document: number of distinct shingles, 128-bit digest of the set, prefixes (64 or 32 bits a token)."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for _, w in document_words(b.column("text")):
                tokens, p = orders.prefixes(w)
                with np.errstate(over="ignore"):
                    sums = [int(mix(x).sum(dtype=U64).view(np.int64)) for x in (tokens, tokens ^ _SEEDS[0])]
                out.append((len(tokens), *sums, p[0].tobytes(), p[1].astype(np.uint32).tobytes(), p[2].astype(np.uint32).tobytes(), signature(tokens)))
            kinds = [pa.int64()] * 3 + [pa.binary()] * 4
            columns = zip(*out) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=[c.split()[0] for c in _ROW_DDL.split(", ")])

    return docs.mapInArrow(tidy(rows), _ROW_DDL)


def _planes(x: np.ndarray) -> bytes:
    """Low and high halves of integers one after the other: the high ones, mostly equal, vanish in compression."""
    return np.ascontiguousarray(x).view(np.uint32).reshape(-1, 2).T.tobytes()


def _whole(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint32).reshape(2, -1).T).view(np.int64).ravel()


def _longs(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.int64)


def posting_lists(nodes: DataFrame) -> DataFrame:
    """(tok, rep, head): the nodes of each prefix token that several have, with the smallest of them.

    Postings cross the shuffle as packed arrays, not as rows. A token that many nodes of a batch have is a list of its own
    there, with a head of its own, of which only the head joins the others; so no list is gathered in one task, however
    many nodes it has.
    """
    parts = shuffle_partitions(nodes.sparkSession)
    buckets = 4 * parts

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p1, at = text_bytes(b.column("p1"))
            rep = np.repeat(int_list(b, "rep"), np.diff(at) // 8)
            tok = p1.view(np.int64)
            if not len(tok):
                continue
            order = np.lexsort((rep, tok))
            tok, rep = tok[order], rep[order]
            first = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
            n = np.diff(np.append(first, len(tok)))
            own = np.repeat(n >= LOCAL_LIST, n)
            head = np.repeat(rep[first], n)
            go = ~own | (np.arange(len(tok)) == np.repeat(first, n))
            rows: list[tuple] = []
            for kind, pick, place in ((0, go, tok), (1, own, rep)):
                t, r, h = tok[pick], rep[pick], head[pick]
                bucket = (mix(place[pick].view(U64)) % U64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                edge = np.searchsorted(bucket[by], np.arange(buckets + 1))
                for q in np.flatnonzero(np.diff(edge)).tolist():
                    x = by[edge[q] : edge[q + 1]]
                    rows.append((q, kind, t[x].tobytes(), _planes(r[x]), _planes(h[x]) if kind else b""))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "kind", "tok", "rep", "head"])

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tok", "rep", "head"]

        def close(held: list[tuple]) -> pa.RecordBatch:
            tok, rep = (np.concatenate([own(x[c]) for x in held]) for c, own in ((0, _longs), (1, _whole)))
            order = np.lexsort((rep, tok))
            tok, rep = tok[order], rep[order]
            first = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
            n = np.diff(np.append(first, len(tok)))
            several = np.repeat(n > 1, n)
            return pa.RecordBatch.from_arrays([pa.array(c[several]) for c in (tok, rep, np.repeat(rep[first], n))], names=names)

        now, held = None, []
        for b in batches:
            for q, kind, tok, rep, head in zip(*(b.column(c).to_pylist() for c in ("bucket", "kind", "tok", "rep", "head"))):
                if kind:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (_longs(tok), _whole(rep), _whole(head))], names=names)
                    continue
                if q != now and held:
                    yield close(held)
                    held = []
                now = q
                held.append((tok, rep))
        if held:
            yield close(held)

    dealt = nodes.select("rep", "p1").mapInArrow(tidy(deal), "bucket int, kind int, tok binary, rep binary, head binary")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(gather), "tok long, rep long, head long")


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The (x, y) of ``pairs`` whose texts are similar enough, compared exactly. Texts of documents outside the pairs
    stay in their tasks: a filter of the ids goes to the scan, the exact join follows."""
    keys = bloom_of(pairs.select(F.explode(F.array("x", "y")).alias("id")), "id")

    def wanted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = keys.has(int_list(b, "doc_id"))
            if hit.any():
                yield b.filter(pa.array(hit))

    texts = materialize(docs.where("doc_id is not null").mapInArrow(tidy(wanted), "doc_id long, text string"), "texts")
    tx = texts.select(F.col("doc_id").alias("x"), F.col("text").alias("tx"))
    ty = texts.select(F.col("doc_id").alias("y"), F.col("text").alias("ty"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for (_, v), (_, w) in zip(document_words(b.column("tx")), document_words(b.column("ty"))):
                a, c = np.unique(shingles(v, k)), np.unique(shingles(w, k))
                both = len(np.intersect1d(a, c, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(a) + len(c) - both))
            yield b.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    out = materialize(pairs.select("x", "y").join(tx, "x").join(ty, "y").select("x", "y", "tx", "ty").mapInArrow(tidy(compare), "x long, y long").distinct(), "links")
    discard(texts)
    return out


def near_pairs(key: np.ndarray, side: np.ndarray, rep: np.ndarray, comp: np.ndarray, n: np.ndarray, sig: list[bytes], percent: int, tok: np.ndarray | None = None, head: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers (a, b), rep[a] < rep[b], and buckets that differ, some at a time: the pairs of rows with the same key, of different components, whose sizes and signatures allow a link.
    Rows are sorted by key and side; where a key has two sides, only rows of different ones meet.

    ``head`` has the smallest of the tokens ``tok`` under which a row's node occurs, -1 where there are fewer. If two rows have
    one in common that is smaller than the token of their key, they meet there as well, and are left out here; so a
    pair is found under its smallest common token at least."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    stop = np.repeat(np.append(first[1:], len(key)), np.diff(np.append(first, len(key))))
    two = np.repeat(side[first] != side[stop[first] - 1], stop[first] - first)
    after = np.arange(len(key)) + 1
    if two.any():  # the first row of the other side
        turn = np.concatenate([[True], (key[1:] != key[:-1]) | (side[1:] != side[:-1])])
        ends = np.append(np.flatnonzero(turn)[1:], len(key))[np.cumsum(turn) - 1]
        after = np.where(two, ends, after)
    many = stop - after
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(x, len(number)) for x in sig], np.int64)  # rows that share an id may differ
    kinds = list(number)
    sizes = np.array([len(x) for x in kinds], np.int64)
    table, place = {}, np.zeros(len(kinds), np.int64)
    for w in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == w)
        place[own] = np.arange(len(own))
        table[w] = np.frombuffer(b"".join([kinds[i] for i in own.tolist()]), np.uint8).reshape(-1, w)
    width, place = sizes[which], place[which]
    upto = np.concatenate([[0], np.cumsum(many)])
    i = 0
    while i < len(key):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + STEP_PAIRS, "right")) - 1)
        c = many[i:j]
        a = np.repeat(np.arange(i, j), c)
        b = np.repeat(after[i:j] - (upto[i:j] - upto[i]), c) + np.arange(len(a))
        i = j
        ok = (comp[a] != comp[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
        a, b = a[ok], b[ok]
        a, b = np.where(rep[a] < rep[b], a, b), np.where(rep[a] < rep[b], b, a)
        if len(a):
            same = (rep[a], rep[b], which[a], which[b])
            order = np.lexsort((tok[a] if tok is not None else key[a], *same[::-1]))  # of equal pairs that under the smallest token
            new = np.concatenate([[True], np.any([c[order][1:] != c[order][:-1] for c in same], axis=0)])
            a, b = a[order][new], b[order][new]
        most = (100 - percent) * (n[a] + n[b]) // (100 + percent)
        for wa, wb in {*zip(width[a].tolist(), width[b].tolist())}:
            own = np.flatnonzero((width[a] == wa) & (width[b] == wb))
            step = max(1, STEP_BYTES // (wa + wb))
            for x in (own[q : q + step] for q in range(0, len(own), step)):
                size = min(wa, wb)
                differ = np.bitwise_count((folded(table[wa][place[a[x]]], size) ^ folded(table[wb][place[b[x]]], size)).view(U64)).sum(1, dtype=np.int64)
                near = differ <= most[x]
                x, differ = x[near], differ[near]
                if head is not None and len(x):
                    ha, hb = head[a[x]], head[b[x]]
                    before = (ha[:, :, None] == hb[:, None, :]) & (ha != -1)[:, :, None] & (ha < tok[a[x]][:, None])[:, :, None]
                    here = ~before.any((1, 2))
                    x, differ = x[here], differ[here]
                if len(x):
                    yield a[x], b[x], differ


class _Forest:
    """Components of some nodes, joined step by step."""

    def __init__(self, comp: np.ndarray):
        _, self.own = np.unique(comp, return_inverse=True)
        self.up = list(range(int(self.own.max(initial=-1)) + 1))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def tops(self) -> np.ndarray:
        """The component of each node."""
        return np.array([self.top(i) for i in range(len(self.up))], np.int64)[self.own]

    def join(self, a: int, b: int) -> None:
        self.up[self.top(int(self.own[a]))] = self.top(int(self.own[b]))

    def apart(self, a: int, b: int) -> bool:
        return self.top(int(self.own[a])) != self.top(int(self.own[b]))


def _similar(sets: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], third: tuple[np.ndarray, np.ndarray], percent: int) -> bool:
    """Whether two nodes share prefix tokens under the second and the third order, and enough of their sets."""
    if not all(len(np.intersect1d(*p, assume_unique=False)) for p in (second, third)):
        return False
    both = len(np.intersect1d(*sets, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both)


def _dealt(members: DataFrame, sides: DataFrame, columns: list[str]) -> DataFrame:
    """The members (tok, rep, comp, blocks) of lists with the ``columns`` of ``sides``, dealt out in pairs of blocks (i, j) and
    sorted by list, blocks and side."""
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = members.join(sides, "rep").withColumn("side", block).withColumn("other", other)
    dealt = dealt.select("tok", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "rep", "comp", *columns)
    by = ["tok", "i", "j"]
    return dealt.repartition(shuffle_partitions(members.sparkSession), *by).sortWithinPartitions(*by, "side")


def _whole_lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Some lists (tok, i, j) at a time, whole, of BLOCK rows or BLOCK_BYTES bytes and more."""
    held: list[pa.RecordBatch] = []
    rows, size, last = 0, 0, None
    for b in batches:
        if not b.num_rows:
            continue
        tok, i, j = (int_list(b, c) for c in ("tok", "i", "j"))
        key = (tok[0], i[0], j[0])
        turns = np.flatnonzero((tok[1:] != tok[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        cut = 0 if key != last else (int(turns[0]) if len(turns) else None)
        if held and (rows >= BLOCK or size >= BLOCK_BYTES) and cut is not None:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            b, held, rows, size = b.slice(cut), [], 0, 0
        held.append(b)
        rows += b.num_rows
        size += b.nbytes
        last = (tok[-1], i[-1], j[-1])
    if held:
        yield pa.Table.from_batches(held)


def _near_rows(t: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``near_pairs`` of whole lists."""
    tok, i, j, side, rep, comp, n = (t.column(c).to_numpy() for c in ("tok", "i", "j", "side", "rep", "comp", "n"))
    change = np.concatenate([[False], (tok[1:] != tok[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    lists_ = t.column("head").combine_chunks()
    size = lists_.value_lengths().to_numpy()
    head = np.full((len(size), FIRST_TOKENS), -1, np.int64)
    row = np.repeat(np.arange(len(size)), size)
    head[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = lists_.flatten().to_numpy()
    return near_pairs(np.cumsum(change), side, rep, comp, n, t.column("sig").to_pylist(), percent, tok, head)


def across(lists: DataFrame, forest: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (x, y) between nodes that share a posting list and are of different components (``forest``: node, comp; others are
    alone); a pair that is linked but missing is of one component by other links.

    Lists of one component go at once. A list of more than BLOCK members is dealt out in pairs of blocks, so a task holds
    two blocks at most. Sizes and signatures tell which members have a near one in their list; only these are dealt out
    again, with their sets and prefixes, and compared exactly inside the tasks. A task leaves only links that join
    components, fewer than it has members: no pair is a row before it is a link, however many members are near."""
    listed = lists.select("tok", "rep").join(small(forest.select(F.col("node").alias("rep"), "comp")), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    kinds = listed.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("tok", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    mixed = materialize(listed.join(kinds, "tok"), "mixed")
    firsts = mixed.where("tok <> -1").groupBy("rep").agg(F.slice(F.array_sort(F.collect_set("tok")), 1, FIRST_TOKENS).alias("head"))
    sides = nodes.join(firsts, "rep", "left").withColumn("head", F.coalesce("head", F.array().cast("array<bigint>")))

    def select(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_lists(batches):
            hit = np.zeros(t.num_rows, bool)
            for a, b, _ in _near_rows(t, percent):
                hit[a] = hit[b] = True
            yield from t.select(["tok", "rep", "comp", "n"]).filter(pa.array(hit)).combine_chunks().to_batches()

    near = _dealt(mixed, sides.select("rep", "n", "sig", "head"), ["n", "sig", "head"]).mapInArrow(tidy(select), "tok long, rep long, comp long, n long")
    near = materialize(near.groupBy("tok", "rep", "comp").agg(F.max("n").alias("n")), "near")
    keys = bloom_of(near, "rep")

    def token_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = keys.has(int_list(b, "doc_id"))
            if hit.any():
                b = b.filter(pa.array(hit))
                own = [np.unique(shingles(w, k)).tobytes() for _, w in document_words(b.column("text"))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(own, pa.binary())], names=["rep", "tokens"])

    sets = materialize(docs.where("doc_id is not null").mapInArrow(tidy(token_sets), "rep long, tokens binary"), "sets")
    blocks = near.groupBy("tok").agg(F.ceil(F.greatest(F.count("*") / BLOCK, 8 * F.sum("n") / BLOCK_BYTES)).cast("int").alias("blocks"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_lists(batches):
            rep = t.column("rep").to_numpy()
            own, second, third = ([np.frombuffer(x.as_py(), kind) for x in t.column(c)] for c, kind in (("tokens", U64), ("p2", np.uint32), ("p3", np.uint32)))
            joined = _Forest(t.column("comp").to_numpy())
            links: list[tuple[int, int]] = []
            for a, b, differ in _near_rows(t, percent):
                order = np.argsort(differ, kind="stable")  # the likeliest first: what they join need not be compared
                for at in (order[q : q + FOREST_PAIRS] for q in range(0, len(order), FOREST_PAIRS)):
                    tops = joined.tops()
                    for x, y in zip(*(z[at][tops[a[at]] != tops[b[at]]].tolist() for z in (a, b))):
                        if joined.apart(x, y) and _similar((own[x], own[y]), (second[x], second[y]), (third[x], third[y]), percent):
                            joined.join(x, y)
                            links.append((int(rep[x]), int(rep[y])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["x", "y"])

    sides = sides.join(sets, "rep")
    rows = _dealt(near.select("tok", "rep", "comp").join(blocks, "tok"), sides.select("rep", "n", "sig", "head", "p2", "p3", "tokens"), ["n", "sig", "head", "p2", "p3", "tokens"])
    links = materialize(rows.mapInArrow(tidy(compare), "x long, y long").distinct(), "rest")
    discard(mixed, near, sets)
    return links


def _filtered(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs whose sizes and signatures allow a link and which share prefix tokens under the second and the
    third order as well."""

    def check(names: list[str], test):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = [test(*row) for row in zip(*(b.column(c).to_pylist() for c in names))]
                yield b.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

        return run

    def close_enough(nx: int, ny: int, sx: bytes, sy: bytes) -> bool:
        if 100 * min(nx, ny) < percent * max(nx, ny):
            return False
        size = min(len(sx), len(sy))
        a, b = (folded(np.frombuffer(s, np.uint8)[None], size) for s in (sx, sy))
        return (100 + percent) * int(np.bitwise_count(a ^ b).sum()) <= (100 - percent) * (nx + ny)

    def meet(x2: bytes, y2: bytes, x3: bytes, y3: bytes) -> bool:
        return all(len(np.intersect1d(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32))) for a, b in ((x2, y2), (x3, y3)))

    def with_sides(pairs: DataFrame, columns: list[str]) -> DataFrame:
        own = nodes.select("rep", *columns).join(small(pairs.select(F.explode(F.array("x", "y")).alias("rep")).distinct()), "rep", "left_semi")
        side = lambda s: own.select(F.col("rep").alias(s), *[F.col(c).alias(s + c) for c in columns])
        return pairs.join(side("x"), "x").join(side("y"), "y")

    near = materialize(with_sides(pairs, ["n", "sig"]).select("x", "y", "xn", "yn", "xsig", "ysig").mapInArrow(tidy(check(["xn", "yn", "xsig", "ysig"], close_enough)), "x long, y long"), "near")
    kept = materialize(with_sides(near, ["p2", "p3"]).select("x", "y", "xp2", "yp2", "xp3", "yp3").mapInArrow(tidy(check(["xp2", "yp2", "xp3", "yp3"], meet)), "x long, y long"), "pairs")
    discard(near)
    return kept


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``.

    Words are maximal runs outside ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z. A text's set has its distinct k-word
    shingles; with fewer words, the whole sequence as one; without words (or text) it is empty and linked with nothing.
    Texts link when 100 * |intersection| >= percent * |union|. ``component_id`` is the smallest doc_id reachable by
    links, the row's own id included. Rows that share an id are one document; a row whose id is null has the component
    of the texts with an equal set, null if there are none. An empty table gives an empty result; other
    columns are ignored. Shingles are compared by 64-bit hashes.
    """
    docs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    words, common = levels(docs, k)
    rows = materialize(token_rows(docs, Orders(k, percent, *words, *common)), "sets")
    key = ["n", "s1", "s2"]
    keys = materialize(rows.select("doc_id", *key), "keys")
    classes = keys.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    # the representatives: rows less those that a smaller id with an equal set stands for
    others = materialize(keys.where("n > 0 and doc_id is not null").join(classes, key).where("doc_id <> rep").select("doc_id", "s1").distinct(), "others")
    nodes = rows.where("n > 0 and doc_id is not null").join(small(others), ["doc_id", "s1"], "left_anti").withColumnRenamed("doc_id", "rep")
    lists = materialize(posting_lists(nodes.select("rep", "p1")), "lists")

    shared = lists.where("rep <> head").groupBy("rep", "head").agg(F.count("*").alias("c"))
    first = shared.groupBy("rep").agg(F.max(F.struct("c", -F.col("head"))).alias("m")).select((-F.col("m.col2")).alias("x"), F.col("rep").alias("y"))
    first = materialize(first, "first")
    tried = _filtered(first, nodes, percent)
    linked = verified(tried, docs, k, percent)
    # what is linked by now is one component; every pair of nodes of different components remains
    more = across(lists, components(linked.select(F.col("x").alias("a"), F.col("y").alias("b"))), nodes, docs, k, percent)
    discard(lists, first, rows, others)

    comps = components(linked.union(more).select(F.col("x").alias("a"), F.col("y").alias("b")))
    named = classes.join(comps, classes.rep == comps.node, "left").select(*key, F.coalesce("comp", "rep").alias("component"))
    return keys.join(named, key, "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90)


_WORDS = r"list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda w: w <> '')"
OP4_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS t FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
  least(d.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = d.doc_id), d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
"""
