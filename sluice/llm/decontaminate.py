"""Benchmark decontamination by a BM25 index of the test items with block-max WAND.

Every passage of every document is a query. Items are indexed with their impacts divided by a threshold of their own,
so that a passage retrieves an item when the sum reaches 1. The threshold is the lowest score that a passage
with the wanted share of the item's shingles can have, so retrieval loses nothing that the verification would accept:
each missing shingle loses one word at most, and the threshold supposes that the heaviest words are lost.

As in WAND, a passage is looked at only if it has one of the item's essential terms (without all of which the rest
cannot reach the threshold); then the block maxima of its terms are added up per block of items, and only blocks whose
sum reaches the threshold are opened. All steps run over many passages at once.

A retrieved pair is verified on the words themselves: shared shingles (question), and shared words of the item's last
sentence (answer).
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, document_words, shingles, word_hashes, tidy

#: BM25 parameters.
K1, B = 1.2, 0.75
#: Items in a block of the index.
BLOCK = 16
#: Bytes of item texts under one index, which goes to every task; more items make more indexes, one after the other.
INDEX_BYTES = 8 << 20
_OUT = "doc_id long, item_id long, shared long, n_shingles long, answer_shared long, answer_words long"


class Item:
    """Words, shingles and answer of a test item."""

    def __init__(self, item_id: int | None, text: str | None, k: int):
        self.item_id = item_id
        raw = _split(text or "")
        self.words = _hash_words(raw)
        self.k = min(k, len(raw))
        self.shingles = np.unique(shingles(self.words, k))
        ends = [i for i, w in enumerate(raw[:-1]) if w.endswith((".", "?", "!"))]
        self.answer = np.unique(self.words[ends[-1] + 1 if ends else 0 :])


class Index:
    """Blocked inverted index. ``idf`` maps each term (sorted hashes) to its weight."""

    def __init__(self, items: list[Item], terms: np.ndarray, idf: np.ndarray, percent: int, stride: int = 16):
        self.items, self.terms, self.stride = items, terms, stride
        mean = sum(len(i.words) for i in items) / max(1, len(items))
        post: list[tuple[int, int, float]] = []
        essential = np.zeros(len(terms), bool)
        for n, item in enumerate(items):
            t, tf = np.unique(np.searchsorted(terms, item.words), return_counts=True)
            impact = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(item.words) / mean))
            lost = len(item.shingles) - (percent * len(item.shingles) + 99) // 100
            heavy = np.sort(impact)[::-1]
            least = impact.sum() - heavy[:lost].sum()
            impact = impact / (least * (1 - 1e-9))
            slack, order = impact.sum() - 1, np.argsort(-impact, kind="stable")
            missing = np.cumsum(impact[order])
            essential[t[order[: int(np.searchsorted(missing, slack, "right")) + 1]]] = True
            post += zip(t.tolist(), [n] * len(t), impact.tolist())
        post.sort()
        self.essential = essential
        self.term = np.array([p[0] for p in post], np.int64)
        self.item = np.array([p[1] for p in post], np.int64)
        self.impact = np.array([p[2] for p in post])
        # blocks: runs of postings of one term whose items are in one block
        new = np.flatnonzero(np.concatenate([[True], (np.diff(self.term) != 0) | (np.diff(self.item // BLOCK) != 0)])) if post else np.zeros(0, np.int64)
        self.block_at = np.append(new, len(post))
        self.block = self.item[new] // BLOCK if post else new
        self.block_max = np.maximum.reduceat(self.impact, new) if post else np.zeros(0)
        self.term_at = np.searchsorted(self.term[new], np.arange(len(terms) + 1)) if post else np.zeros(len(terms) + 1, np.int64)

    def retrieve(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (passage, item) whose score reaches the threshold; the input are distinct (passage, term) pairs."""
        n_blocks, none = len(self.items) // BLOCK + 1, (np.zeros(0, np.int64),) * 2
        pair, at = _expand(self.term_at[term], self.term_at[term + 1])
        if not len(at):
            return none
        key = passage[pair] * n_blocks + self.block[at]
        keys, slot = np.unique(key, return_inverse=True)
        bound = np.bincount(slot, self.block_max[at])
        hot = bound[slot] >= 1
        if not hot.any():
            return none
        pair, at = pair[hot], at[hot]
        opened, post = _expand(self.block_at[at], self.block_at[at + 1])
        key = passage[pair[opened]] * len(self.items) + self.item[post]
        keys, slot = np.unique(key, return_inverse=True)
        found = keys[np.bincount(slot, self.impact[post]) >= 1]
        return found // len(self.items), found % len(self.items)


def _expand(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) for the integers of each range [a, b)."""
    n = b - a
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + a[row]


def _split(text: str) -> list[str]:
    return [w.decode() for w in text.encode("utf-8", "surrogatepass").lower().split()]


def _hash_words(words: list[str]) -> np.ndarray:
    body = np.frombuffer(" ".join(words).encode(), np.uint8)
    return word_hashes(body, np.array([0, len(body)]))[0]


def _lookup(terms: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Term numbers of words, -1 where the index does not have them."""
    at = np.minimum(np.searchsorted(terms, w), len(terms) - 1)
    return np.where(terms[at] == w, at, -1)


def _matches(index: Index, w: np.ndarray, percent: int, k: int) -> dict[int, tuple[int, int]]:
    """Item number -> largest numbers of shared shingles and answer words in the passages that verify."""
    tid = _lookup(index.terms, w)
    s = index.stride
    at = np.flatnonzero(tid >= 0)
    tid = tid[at]
    # passage i has the words [i * s, (i + 2) * s); a word is in two of them
    n = len(w) // s + 1
    wanted = np.zeros(n, bool)
    hot = at[index.essential[tid]] // s
    wanted[hot] = True
    wanted[np.maximum(hot - 1, 0)] = True
    passage = np.concatenate([at // s, at // s - 1])
    term = np.concatenate([tid, tid])
    keep = (passage >= 0) & wanted[passage]
    if not keep.any():
        return {}
    keys = np.unique(passage[keep] * len(index.terms) + term[keep])
    found: dict[int, tuple[int, int]] = {}
    for i, m in zip(*(x.tolist() for x in index.retrieve(keys // len(index.terms), keys % len(index.terms)))):
        item, own = index.items[m], w[i * s : (i + 2) * s]
        if len(own) < item.k:
            continue
        shared = int(np.isin(item.shingles, shingles(own, item.k)).sum())
        answer = int(np.isin(item.answer, own).sum())
        if 100 * shared >= percent * len(item.shingles) and 2 * answer >= len(item.answer):
            had = found.get(m, (0, 0))
            found[m] = (max(had[0], shared), max(had[1], answer))
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, shared, n_shingles, answer_shared, answer_words): every document with every test item it leaks.

    Words are runs outside ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z. With s the words of the longest item of the
    whole benchmark (16 at least), the passages of a document are its words [i s, (i + 2) s), so any stretch as long as an item lies
    whole in one. A document leaks an item when one passage has ``percent`` % of the item's distinct k-word shingles (of
    an item of fewer words: the whole sequence) and half of the distinct words of its last sentence; ``shared`` and
    ``answer_shared`` are the largest over such passages. Documents and items without words leak nothing; rows with
    a null id take part and keep it; repeated rows give repeated results; an empty table on either side gives no row;
    other columns are ignored.
    """
    docs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    stride = max(16, longest(benchmark))
    parts = []
    for items in _item_groups(benchmark, k):
        parts.append(_against(docs, items, k, percent, stride))
    return functools.reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], _OUT)


def longest(benchmark: DataFrame) -> int:
    """Words of the longest item, over all of them: passages do not depend on how items are dealt over indexes."""

    def most(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([max((len(w) for _, w in document_words(b.column("text"))), default=0)], pa.int64())], names=["n"])

    return benchmark.select(F.col("text").alias("text")).mapInArrow(tidy(most), "n long").agg(F.max("n")).first()[0] or 0


def _item_groups(benchmark: DataFrame, k: int) -> Iterator[list[Item]]:
    held: list[Item] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).orderBy("item_id", "text").toLocalIterator():
        item = Item(r.item_id, r.text, k)
        if not len(item.words):
            continue
        if held and size + len(r.text) > INDEX_BYTES:
            yield held
            held, size = [], 0
        held.append(item)
        size += len(r.text)
    if held:
        yield held


def _against(docs: DataFrame, items: list[Item], k: int, percent: int, stride: int) -> DataFrame:
    terms = np.unique(np.concatenate([i.words for i in items]))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(terms) + 1, np.int64), 0
        for b in batches:
            for _, w in document_words(b.column("text")):
                total[np.unique(_lookup(terms, w))] += 1
                n += 1
        total[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(terms))), pa.array(np.roll(total, 1))], names=["t", "n"])

    # document frequency of each term over all documents; number -1 counts the documents
    table = docs.select("text").mapInArrow(tidy(count), "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(terms) + 1)
    df[table.column("t").to_numpy() + 1] = table.column("n").to_numpy()
    idf = np.log(1 + (df[0] - df[1:] + 0.5).clip(0.5) / (df[1:] + 0.5))
    index = Index(items, terms, idf, percent, stride)

    def query(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _OUT.split(", ")]
        for b in batches:
            ids, rows = b.column("doc_id").to_pylist(), []
            for r, w in document_words(b.column("text")):
                if len(w):
                    for m, (shared, answer) in sorted(_matches(index, w, percent, k).items()):
                        item = index.items[m]
                        rows.append((ids[r], item.item_id, shared, len(item.shingles), answer, len(item.answer)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    return docs.mapInArrow(tidy(query), _OUT)


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_W = r"list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda w: w <> '')"
OP9_SQL = f"""
WITH b AS (SELECT item_id, {_W} AS w FROM benchmark),
i AS (SELECT item_id, w, least(5, len(w)) AS k,
    coalesce(list_max(list_filter(range(1, len(w)), lambda p: regexp_matches(w[p], '[.?!]$'))), 0) AS e FROM b WHERE len(w) > 0),
st AS (SELECT greatest(16, max(len(w))) AS s FROM i),
sh AS (SELECT item_id, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p : p + k - 1], ' ')))) AS t FROM i),
ans AS (SELECT item_id, unnest(list_distinct(w[e + 1 :])) AS t FROM i),
d AS (SELECT doc_id, {_W} AS w FROM documents),
ps AS (SELECT doc_id, p, w[p * s + 1 : (p + 2) * s] AS w FROM (SELECT doc_id, w, s, unnest(range(0, len(w) // s + 1)) AS p FROM d, st)),
ks AS (SELECT DISTINCT k FROM i),
dsh AS (SELECT DISTINCT doc_id, p, k, t FROM (SELECT doc_id, p, k, unnest(list_transform(range(1, len(w) - k + 2), lambda q: array_to_string(w[q : q + k - 1], ' '))) AS t FROM ps, ks)),
shared AS (SELECT doc_id, p, item_id, count(*) AS shared FROM dsh JOIN sh USING (k, t) GROUP BY 1, 2, 3),
n AS (SELECT item_id, count(*) AS n FROM sh GROUP BY 1),
na AS (SELECT item_id, count(*) AS n FROM ans GROUP BY 1),
hit AS (SELECT doc_id, p, item_id, shared, n.n AS n_shingles FROM shared JOIN n USING (item_id) WHERE 100 * shared >= 80 * n.n),
full_ AS (SELECT h.*, (SELECT count(*) FROM ans a WHERE a.item_id = h.item_id AND list_contains(ps.w, a.t)) AS answer FROM hit h JOIN ps USING (doc_id, p))
SELECT doc_id, item_id, max(shared) AS shared, max(n_shingles) AS n_shingles, max(answer) AS answer_shared, max(na.n) AS answer_words
FROM full_ JOIN na USING (item_id) WHERE 2 * answer >= na.n GROUP BY 1, 2
"""
