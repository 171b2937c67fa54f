"""Text functions as column expressions, and the subword tokenizer."""

import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text) -> Column:
    """White-space tokens."""
    return F.filter(F.split(_c(text), r"\s+"), lambda w: w != "")


def alnum_runs(text) -> Column:
    """Alternating runs of letters or digits and of other characters; a lone space goes unless it comes first."""
    runs = F.expr(r"regexp_extract_all({}, '([\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+)', 1)".format(text))
    return F.filter(runs, lambda r, i: (r != " ") | (i == 0))


def join_runs(runs) -> Column:
    """Inverse of ``alnum_runs``: a space between two runs that both begin with a letter or digit."""
    a = _c(runs)
    alnum = lambda t: F.regexp_like(t, F.lit(r"^[\p{L}\p{N}]"))
    return F.array_join(F.transform(a, lambda t, i: F.when((i > 0) & alnum(t) & alnum(F.try_element_at(a, i)), F.concat(F.lit(" "), t)).otherwise(t)), "")


def replace_all(text, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, _c(text))


def escape_token(token) -> Column:
    """Backslash and underscore escaped, underscore at the end."""
    return F.concat(replace_all(token, [("\\", "\\\\"), ("_", "\\u"), ("\n", "\\10;")]), F.lit("_"))


def unescape_token(token) -> Column:
    c = _c(token)
    c = F.when(c.endswith("_"), c.substr(F.lit(1), F.length(c) - 1)).otherwise(c)
    return replace_all(c, [("\\\\", "\0"), ("\\u", "_"), ("\\10;", "\n"), ("\0", "\\")])


def join_bpe(tokens) -> Column:
    """Join pieces that end in ``@@`` with what follows."""
    return F.replace(F.concat_ws(" ", tokens), F.lit("@@ "), F.lit(""))


def join_spm(tokens) -> Column:
    return F.ltrim(F.replace(F.concat_ws("", tokens), F.lit("▁"), F.lit(" ")))


def cut_at(tokens, end: str) -> Column:
    """The tokens before the first ``end``."""
    a = _c(tokens)
    at = F.array_position(a, end)
    return F.when(at > 0, F.slice(a, F.lit(1), (at - 1).cast("int"))).otherwise(a)


# Entities of the tokenizer convention, in the order in which they are undone.
HTML = [("&bar;", "|"), ("&#124;", "|"), ("&lt;", "<"), ("&gt;", ">"), ("&bra;", "["), ("&ket;", "]"), ("&quot;", '"'), ("&apos;", "'"), ("&#91;", "["), ("&#93;", "]"), ("&amp;", "&")]


def deescape_html(text) -> Column:
    return replace_all(text, HTML)


def squeeze(text) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def tokenize_13a(text) -> Column:
    """The mteval 13a convention; its patterns are fixed values."""
    c = replace_all(text, [("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")])
    c = F.concat(F.lit(" "), c, F.lit(" "))
    c = F.regexp_replace(c, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    c = F.regexp_replace(c, r"([^0-9])([\.,])", "$1 $2 ")
    c = F.regexp_replace(c, r"([\.,])([^0-9])", " $1 $2")
    c = F.regexp_replace(c, r"([0-9])(-)", "$1 $2 ")
    return squeeze(c)


def tokenize_international(text) -> Column:
    """The mteval v14 convention: punctuation apart from digits, symbols apart; its patterns are fixed values."""
    c = F.regexp_replace(_c(text), r"(\P{N})(\p{P})", "$1 $2 ")
    c = F.regexp_replace(c, r"(\p{P})(\P{N})", " $1 $2")
    c = F.regexp_replace(c, r"(\p{S})", " $1 ")
    return squeeze(c)


def byte_ids(word, length: int, bow: int = 256, eow: int = 257, pad: int = 258) -> Column:
    """Bytes of a word between markers, cut and padded to ``length``; every id is one higher, 0 is left for masks."""
    w = _c(word)
    h = F.hex(F.encode(w, "UTF-8"))
    n = F.least(F.octet_length(w), F.lit(length - 2)).cast("int")
    body = F.transform(F.filter(F.sequence(F.lit(1), F.lit(length - 2)), lambda i: i <= n), lambda i: F.conv(F.substring(h, 2 * i - 1, F.lit(2)), 16, 10).cast("int"))
    ids = F.concat(F.array(F.lit(bow)), body, F.array(F.lit(eow)), F.array_repeat(F.lit(pad), F.lit(length - 2) - n))
    return F.transform(ids, lambda x: x + 1)


def with_ends(source, target, sos: int, eos: int, multi_host: bool = False) -> tuple[Column, Column, Column]:
    """(source, decoder input, decoder output); the multi-host variant leaves the source bare."""
    s, t = _c(source), _c(target)
    a, b = F.array(F.lit(sos)), F.array(F.lit(eos))
    return (s if multi_host else F.concat(a, s, b)), F.concat(a, t), F.concat(t, b)


def bucket_key(source_length, target_length, buckets: int, longest: int | None) -> Column:
    """Length bucket: ``buckets + 1`` keys are possible, as the index is capped at ``buckets``."""
    width = (longest + buckets - 1) // buckets if longest else 10
    return F.least(F.lit(buckets).cast("long"), F.greatest(F.floor(_c(source_length) / width), F.floor(_c(target_length) / width)))


def ngrams(tokens, n: int) -> Column:
    """n-grams of a token array, joined by spaces."""
    a = _c(tokens)
    size = F.size(a)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(a, i, n), " "))).otherwise(F.array().cast("array<string>"))


class SubwordTokenizer:
    """Greedy longest-match subword encoder over escaped tokens, with a memo; its vocabulary comes from ``learn``."""

    def __init__(self, vocabulary: list[str]):
        self.vocabulary = vocabulary
        self.ids = {p: i for i, p in enumerate(vocabulary)}
        self.longest = max(map(len, vocabulary), default=0)
        self._memo: dict[str, list[int]] = {}

    def encode_token(self, escaped: str) -> list[int]:
        out = self._memo.get(escaped)
        if out is None:
            out, i = [], 0
            while i < len(escaped):
                for j in range(min(len(escaped), i + self.longest), i, -1):
                    if escaped[i:j] in self.ids:
                        out.append(self.ids[escaped[i:j]])
                        i = j
                        break
                else:
                    raise ValueError(f"no piece covers {escaped[i]!r}")
            if len(self._memo) >= 1 << 20:
                self._memo.clear()
            self._memo[escaped] = out
        return out

    def decode(self, ids: list[int]) -> str:
        return "".join(self.vocabulary[i] for i in ids)

    @staticmethod
    def count_pieces(counts: dict[str, int], vocabulary: set[str] | None, longest: int) -> dict[str, int]:
        """Weighted counts of all prefixes from each piece's start; without a vocabulary every character starts a piece."""
        out: dict[str, int] = {}
        coder = SubwordTokenizer(sorted(vocabulary)) if vocabulary else None
        for token, n in counts.items():
            starts = range(len(token))
            if coder:
                starts, at = [], 0
                for k in coder.encode_token(token):
                    starts.append(at)
                    at += len(coder.vocabulary[k])
            for s in starts:
                for e in range(s + 1, min(len(token), s + longest) + 1):
                    out[token[s:e]] = out.get(token[s:e], 0) + n
        return out

    @staticmethod
    def discount(counts: dict[str, int], least: int) -> list[tuple[str, int]]:
        """Longest first: a piece frequent enough is taken, and its count leaves its prefixes."""
        counts = dict(counts)
        taken = []
        for piece in sorted(counts, key=lambda p: (-len(p), p)):
            n = counts[piece]
            if n < least:
                continue
            if len(piece) > 1:
                taken.append((piece, n))
            for k in range(1, len(piece)):
                if piece[:k] in counts:
                    counts[piece[:k]] -= n
        return taken

    @classmethod
    def learn(cls, counts: dict[str, int], least: int, rounds: int = 4, longest: int = 20) -> "SubwordTokenizer":
        """``rounds`` times: count prefixes of the present segmentation and keep the frequent ones. Characters always stay."""
        alphabet = {c for t in counts for c in t} | set("\\_u;0123456789")
        vocabulary: set[str] | None = None
        for _ in range(rounds):
            vocabulary = alphabet | {p for p, _ in cls.discount(cls.count_pieces(counts, vocabulary, longest), least)}
        return cls(sorted(vocabulary or alphabet, key=lambda p: (-len(p), p)))


#: Characters up to which pieces are counted one length after the other; longer ones in steps of double length.
FIRST_CHARS = 16
#: Counts that a task holds before it merges them.
HELD_COUNTS = 1 << 20


class PieceTree:
    """Pieces as a tree: node 0 is the empty one, and the beginnings of a piece are its ancestors."""

    def __init__(self, pieces: Iterable[str] = ()):
        self.pieces, self.parent = [""], [0]
        self.number: dict[str, int] | None = None
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # by length: (node before << 21 | character, sorted; node)
        by_length: dict[int, list[str]] = {}
        for p in pieces:
            by_length.setdefault(len(p), []).append(p)
        number = {"": 0}
        for _, own in sorted(by_length.items()):
            nodes = self.add(np.array([number[p[:-1]] << 21 | ord(p[-1]) for p in own], np.int64))
            number.update((self.pieces[k], k) for k in nodes)

    def add(self, key: np.ndarray) -> range:
        """One more length: the nodes of the keys (node before << 21 | character)."""
        key = np.sort(key)
        nodes = range(len(self.pieces), len(self.pieces) + len(key))
        before = (key >> 21).tolist()
        self.number = None
        self.pieces += [self.pieces[k] + chr(c) for k, c in zip(before, (key & 0x1FFFFF).tolist())]
        self.parent += before
        self.levels.append((key, np.arange(nodes.start, nodes.stop)))
        return nodes

    def walk(self, chars: np.ndarray, stop: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node of the longest piece that begins at each of the places ``at`` and ends before ``stop``, which of them got
        to the last length)."""
        node, on = np.zeros(len(at), np.int64), np.arange(len(at))
        for d, (keys, nodes) in enumerate(self.levels):
            on = on[at[on] + d < stop[on]]
            key = node[on] << 21 | chars[at[on] + d]
            q = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[q] == key
            on = on[hit]
            node[on] = nodes[q[hit]]
        return node, on

    def sums(self, counts: np.ndarray) -> np.ndarray:
        """Counts of the nodes with those of all nodes below them."""
        out, parent = counts.copy(), np.array(self.parent)
        for _, nodes in reversed(self.levels):
            np.add.at(out, parent[nodes], out[nodes])
        return out

    def longest(self, vocabulary: Iterable[str]) -> np.ndarray:
        """Length of the longest piece of ``vocabulary`` that each node begins with; 1 where there is none."""
        if self.number is None:
            self.number = {p: k for k, p in enumerate(self.pieces)}
        out, parent = np.zeros(len(self.pieces), np.int32), np.array(self.parent)
        own = np.array([k for p in vocabulary if (k := self.number.get(p))], np.int64)
        out[own] = 1
        for d, (_, nodes) in enumerate(self.levels):
            out[nodes] = np.where(out[nodes] > 0, d + 1, out[parent[nodes]])
        return np.maximum(out, 1)


def _characters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the words one after the other, and where each word ends."""
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return chars, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.diff(key, prepend=key[0] - 1)) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _counted(df: DataFrame, found) -> DataFrame:
    """(key, n): the sums by key of the (keys, counts) that ``found`` returns for the Arrow batches of ``df``."""

    def run(batches):
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for b in batches:
            key, count = _merged(*([x] for x in found(b)))
            keys.append(key)
            counts.append(count)
            if sum(map(len, keys)) > HELD_COUNTS and len(keys) > 1:
                key, count = _merged(keys, counts)
                if len(key) > HELD_COUNTS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(count)], names=["key", "n"])
                    keys, counts = [], []
                else:
                    keys, counts = [key], [count]
        key, count = _merged(keys, counts)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(count)], names=["key", "n"])

    return df.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _cut(stop: np.ndarray, nodes: np.ndarray, longest: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, words) at which the greedy segmentation of the words begins a piece: first ones, second ones and so on.
    ``nodes`` has the node at each place."""
    out = []
    at, word = np.concatenate([[0], stop[:-1]]).astype(np.int64), np.arange(len(stop))
    on = at < stop
    while on.any():
        at, word = at[on], word[on]
        out.append((at, word))
        at = at + longest[nodes[at]]
        on = at < stop[word]
    return out


def piece_counts(words: DataFrame, vocabulary: list[str] | None, least: int) -> dict[str, int]:
    """Pieces that occur ``least`` times or more: all prefixes from the start of each piece of the present segmentation (every
    character without a vocabulary) to the end of the word, weighted. ``words`` has the columns w, n.

    A piece is at most as frequent as its beginnings, so a length is counted only behind the frequent pieces of the length
    before, whose tree goes to the tasks; those above FIRST_CHARS in steps of double length. No word is ever unfolded
    into all its pieces. Only the frequent ones, at most the sum of all counts by ``least`` for each length, come to the
    driver."""
    whole = PieceTree(_closed(vocabulary)) if vocabulary is not None else None
    longest = whole.longest(vocabulary) if whole else None

    def starts(w: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        chars, stop = _characters(w)
        at, word = np.arange(len(chars)), np.repeat(np.arange(len(stop)), np.diff(stop, prepend=0))
        if whole:
            pieces = _cut(stop, whole.walk(chars, stop[word], at)[0], longest)
            at, word = (np.concatenate([p[k] for p in pieces] or [np.zeros(0, np.int64)]) for k in (0, 1))
        return chars, stop, at, word

    def longer(tree: PieceTree):
        def found(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            chars, stop, at, word = starts(b.column("w").to_pylist())
            d = len(tree.levels)
            node, on = tree.walk(chars, stop[word], at)
            on = on[at[on] + d < stop[word[on]]]
            return node[on] << 21 | chars[at[on] + d], b.column("n").to_numpy()[word[on]]

        return found

    words = words.select("w", F.col("n").cast("long").alias("n"))
    tree, out = PieceTree(), {}
    while len(tree.levels) < FIRST_CHARS:
        got = _counted(words, longer(tree)).where(F.col("n") >= least).orderBy("key").toArrow()
        if not got.num_rows:
            return out
        nodes = tree.add(got.column("key").to_numpy())
        out.update(zip((tree.pieces[k] for k in nodes), got.column("n").to_pylist()))

    # the rests of the words behind frequent beginnings
    def rests(batches):
        for b in batches:
            w, n = b.column("w").to_pylist(), b.column("n").to_numpy()
            chars, stop, at, word = starts(w)
            _, on = tree.walk(chars, stop[word], at)
            begin = np.concatenate([[0], stop])
            own = [w[k][i:] for k, i in zip(word[on].tolist(), (at[on] - begin[word[on]]).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(n[word[on]], pa.int64())], names=["rest", "n"])

    now = words.mapInArrow(rests, "rest string, n long").groupBy("rest").agg(F.sum("n").alias("n"))
    lo, hi = FIRST_CHARS, 2 * FIRST_CHARS
    while True:
        ends = F.sequence(F.lit(lo + 1), F.least(F.lit(hi), F.length("rest")))
        now = now.where(F.length("rest") > lo)
        got = now.select("n", "rest", F.explode(ends).alias("k")).groupBy(F.expr("substring(rest, 1, k)").alias("piece")).agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()
        out.update((r.piece, r.n) for r in got)
        more = [(r.piece,) for r in got if len(r.piece) == hi]
        if not more:
            return out
        frequent = words.sparkSession.createDataFrame(more, "piece string")
        now = now.join(F.broadcast(frequent), F.substring("rest", 1, hi) == F.col("piece"), "left_semi")
        lo, hi = hi, 2 * hi


def _closed(pieces: Iterable[str]) -> set[str]:
    """The pieces and all their beginnings."""
    return {p[:k] for p in pieces for k in range(1, len(p) + 1)}


#: Words whose pieces a task counts at once, and the least share of a count that they must have to tell which may be frequent.
CHUNK_WORDS, CHUNK_LEAST = 1 << 18, 8


def _chunk_pieces(w: list[str], n: np.ndarray, frequent) -> list[str]:
    """The pieces of some words, beginning and ending anywhere, for whose counts ``frequent`` holds; it must hold for their beginnings."""
    text = "".join(w)
    chars, stop = _characters(w)
    size = np.diff(stop, prepend=0)
    at, end, weight = np.arange(len(chars)), np.repeat(stop, size), np.repeat(n, size)
    node, d, out = np.zeros(len(at), np.int64), 0, []
    while len(at):
        key = node << 21 | chars[at + d]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        many = frequent(np.add.reduceat(weight[order], first))
        d += 1
        out += [text[i : i + d] for i in at[order[first[many]]].tolist()]
        number = np.repeat(np.where(many, np.cumsum(many) - 1, -1), np.diff(first, append=len(key)))
        on = order[(number >= 0) & (at[order] + d < end[order])]
        node = np.empty(len(at), np.int64)
        node[order] = number
        at, end, weight, node = at[on], end[on], weight[on], node[on]
    return out


def frequent_pieces(words: DataFrame, least: int) -> list[str]:
    """All pieces, beginning and ending anywhere in a word, that occur ``least`` times or more, their beginnings, and maybe others. The words
    are counted in chunks; a piece is kept that has, in some chunk, its share of ``least`` by words. One below its share in
    every chunk is below ``least`` in all. Where the shares are too small to tell, lengths are counted one by one."""
    total = words.count()
    if total > CHUNK_WORDS and least * CHUNK_WORDS < CHUNK_LEAST * total:
        return list(piece_counts(words, None, least))

    def run(batches):
        w: list[str] = []
        n: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            pieces = _chunk_pieces(w, np.concatenate(n), lambda count: count * total >= least * len(w))
            return pa.RecordBatch.from_arrays([pa.array(pieces, pa.string())], names=["piece"])

        for b in batches:
            w += b.column("w").to_pylist()
            n.append(b.column("n").to_numpy())
            if len(w) >= CHUNK_WORDS:
                yield close()
                w, n = [], []
        if w:
            yield close()

    found = words.select("w", F.col("n").cast("long").alias("n")).mapInArrow(run, "piece string").distinct()
    return found.toArrow().column("piece").to_pylist()


def _node_column(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of all words of a batch, and the offsets of the words in them."""
    column = b.column("nodes")
    _, at, flat = column.buffers()
    at = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    return np.frombuffer(flat, np.int32)[at[0] : at[-1]] if flat is not None else np.zeros(0, np.int32), at - at[0]


class _Segments:
    """All words as nodes: the longest piece at each place that is frequent anywhere. A piece of a segmentation is at most as
    frequent as it is at all places, so the nodes suffice to cut words by any vocabulary of frequent pieces and to count
    the pieces; words are not read again."""

    def __init__(self, words: DataFrame, least: int):
        from ..storage import materialize

        self.least, self.tree = least, PieceTree(frequent_pieces(words, least))
        tree = self.tree

        def nodes(batches):
            for b in batches:
                chars, stop = _characters(b.column("w").to_pylist())
                size = np.diff(stop, prepend=0)
                node, _ = tree.walk(chars, np.repeat(stop, size), np.arange(len(chars)))
                flat = pa.py_buffer(node.astype(np.int32).tobytes())
                at = pa.py_buffer(np.concatenate([[0], 4 * stop]).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(stop), [None, at, flat]), b.column("n")], names=["nodes", "n"])

        self.nodes = materialize(words.select("w", F.col("n").cast("long").alias("n")).mapInArrow(nodes, "nodes binary, n long"), "segments")
        self.counts = self._counts(None, least)
        if len(self.counts) + 1 == len(tree.pieces):
            return
        # nodes that are not frequent become their longest frequent beginnings
        self.tree = PieceTree(self.counts)
        number = {p: k for k, p in enumerate(self.tree.pieces)}
        now, parent = np.array([number.get(p, -1) for p in tree.pieces], np.int32), np.array(tree.parent)
        for _, own in tree.levels:
            now[own] = np.where(now[own] < 0, now[parent[own]], now[own])

        def renamed(batches):
            for b in batches:
                node, at = _node_column(b)
                flat, at = pa.py_buffer(now[node].tobytes()), pa.py_buffer((4 * at).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), b.num_rows, [None, at, flat]), b.column("n")], names=["nodes", "n"])

        self.nodes = materialize(self.nodes.mapInArrow(renamed, "nodes binary, n long"), "segments")

    def at_all(self, least: int) -> dict[str, int]:
        """The pieces that occur ``least`` times or more at any places."""
        return {p: n for p, n in self.counts.items() if n >= least}

    def cut_by(self, vocabulary: list[str], least: int) -> dict[str, int]:
        """Those that do where the words are cut by ``vocabulary``."""
        return self._counts(self.tree.longest(vocabulary), least)

    def _counts(self, longest: np.ndarray | None, least: int) -> dict[str, int]:
        def found(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            (node, at), n = _node_column(b), b.column("n").to_numpy()
            if longest is None:
                return node.astype(np.int64), np.repeat(n, np.diff(at))
            pieces = _cut(at[1:], node, longest)
            place, word = (np.concatenate([p[k] for p in pieces] or [np.zeros(0, np.int64)]) for k in (0, 1))
            return node[place].astype(np.int64), n[word]

        got = _counted(self.nodes, found).toArrow()
        counts = np.zeros(len(self.tree.pieces), np.int64)
        counts[got.column("key").to_numpy()] = got.column("n").to_numpy()
        counts = self.tree.sums(counts)
        return {self.tree.pieces[k]: int(counts[k]) for k in np.flatnonzero(counts >= least).tolist() if k}


def learn_subwords(words: DataFrame, target: int, threshold: int, rounds: int = 4, least: tuple[int, int] = (1, 1000)) -> list[str]:
    """A vocabulary of about ``target`` pieces, learned from all words (columns w, n; escaped). The least count of a piece is
    found by bisection within ``least``, until the size is closer than ``threshold``; of the sizes tried, the closest is
    taken. Characters always stay. An empty table gives the escape characters."""
    from ..storage import materialize

    words = materialize(words.select("w", "n"), "words")
    alphabet = {r.c for r in words.select(F.explode(F.split("w", "")).alias("c")).distinct().collect()} - {""} | set("\\_u;0123456789")
    segments: _Segments | None = None

    def generate(count: int) -> list[str]:
        nonlocal segments
        if rounds and (segments is None or count < segments.least):
            segments = _Segments(words, count)
        vocabulary: list[str] | None = None
        for _ in range(rounds):
            found = SubwordTokenizer.discount(segments.at_all(count) if vocabulary is None else segments.cut_by(vocabulary, count), count)
            now = sorted(alphabet | {p for p, _ in found}, key=lambda p: (-len(p), p))
            if now == vocabulary:  # the same again in every round that follows
                break
            vocabulary = now
        return vocabulary or []

    (lo, hi), best = least, None
    while True:
        count = (lo + hi) // 2
        now = generate(count)
        if best is None or abs(len(now) - target) < abs(len(best) - target):
            best = now
        if abs(len(now) - target) < threshold or lo >= hi or count < 2:
            return best
        lo, hi = (count + 1, hi) if len(now) > target else (lo, count - 1)


class _WordIds(dict):
    """Word -> number of its ids in a flat array; words are encoded when they are first asked for."""

    def __init__(self, vocabulary: list[str]):
        super().__init__()
        self.vocabulary = vocabulary
        self.start_anew()

    def start_anew(self) -> None:
        self.clear()
        self.coder, self.flat, self.at = SubwordTokenizer(self.vocabulary), array("i"), array("q", [0])

    def __missing__(self, word: str) -> int:
        self.flat.extend(self.coder.encode_token(word.replace("\\", "\\\\").replace("_", "\\u") + "_"))
        self.at.append(len(self.flat))
        self[word] = len(self.at) - 2
        return len(self.at) - 2

    def texts(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text."""
        if len(self) >= 1 << 20:
            self.start_anew()
        own = [np.fromiter(map(self.__getitem__, (t or "").split()), np.int64) for t in texts]
        word = np.concatenate(own) if own else np.zeros(0, np.int64)
        at, flat = np.array(self.at), np.array(self.flat, np.int32)
        n = at[word + 1] - at[word]
        stop = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(at[word] - stop[:-1], n) + np.arange(stop[-1])]
        ends = stop[np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))


#: Characters of the texts that are encoded at once.
ENCODE_CHARS = 1 << 20


def subword_encode(text, vocabulary: list[str]) -> Column:
    """Ids of each white-space token of a text by the greedy encoder, as an Arrow-batched function; a word is encoded once."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = _WordIds(vocabulary)
        for b in batches:
            out, held, size = [], [], 0
            for t in b.to_pylist():
                held.append(t)
                size += len(t or "")
                if size > ENCODE_CHARS:
                    out.append(words.texts(held))
                    held, size = [], 0
            yield pa.concat_arrays([*out, words.texts(held)])

    return run(_c(text))


# Marks of the detokenizing convention. Curly quotes count as the straight double one.
_OPENING, _CLOSING, _QUOTES = frozenset("([{"), frozenset(",.?!:;\\%}])"), frozenset("'\"„“”")


def _sticks(token: str, last: str, open_quotes: set[str]) -> tuple[bool, bool]:
    """Whether a token is written without a space before it, and without one behind it, unless its neighbour says so too.
    ``open_quotes`` has the quotes that are open, and is kept up."""
    if _OPENING.issuperset(token) or all(unicodedata.category(c) == "Sc" for c in token):
        return False, True
    if _CLOSING.issuperset(token):
        return True, False
    if token[0] in "'’|" and token[1:2].isascii() and token[1:2].isalpha() and last[-1:].isascii() and last[-1:].isalnum():
        return True, False  # the rest of a contraction
    if token not in _QUOTES:
        return False, False
    mark = "'" if token == "'" else '"'
    if mark in open_quotes:
        open_quotes.discard(mark)
        return True, False
    if mark == "'" and last.endswith("s"):
        return True, False  # of a plural
    open_quotes.add(mark)
    return False, True


def moses_join(tokens: list[str]) -> str:
    """The tokens as a sentence."""
    out, open_quotes, last, glue = [], set(), "", True
    for w in tokens:
        before, after = _sticks(w, last, open_quotes)
        out += [w] if before or glue else [" ", w]
        last, glue = w, after
    return "".join(out)


def moses_detokenize(text) -> Column:
    """The white-space tokens of a text put together as a sentence: no space before closing and behind opening marks, quotes in turn."""
    import pandas as pd

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else moses_join(t.split()))

    return run(_c(text))


def sentencepiece_encode(text, model: str, end: int = 2) -> Column:
    """Ids of a text by a sentencepiece model file, and the end id."""
    import pandas as pd

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=model)
        return s.map(lambda t: [*own.encode(t or ""), end])

    return run(_c(text))
