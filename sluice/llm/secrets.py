"""Secret scan with a character convolutional network.

Exact base patterns are always reported. Every other candidate token is scored, with the characters around it, by a
small convolutional network in numpy: all windows of a long token are, and its score is the highest, in training and
calibration too. The network is trained on all labelled findings: base findings against other tokens, each also
shown without its surroundings, so that it has to know secrets by their own characters. Tasks train beside each other,
each on its share, and their networks are averaged after every epoch. The probabilities are calibrated on all held-out
findings (a quarter by hash), and the threshold is the highest that keeps the wanted recall there.
"""

from __future__ import annotations

import copy
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Spans, bounded_batches, discard, materialize, tidy

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"(?:[Pp][Aa][Ss][Ss](?:[Ww][Oo][Rr][Dd]|[Ww][Dd])|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
_DIGIT = re.compile("[0-9]")

#: Kind of what the network adds.
ADDED = "token"
#: A candidate is a token of LONG characters, or of 8 with a digit.
LONG = 16
#: What the network sees at once: characters before, of the token, and after. A longer token has a window at each place.
BEFORE, BODY, AFTER = 16, 32, 16
WIDTH = BEFORE + BODY + AFTER
SYMBOLS, EMBED, KERNEL, FILTERS = 48, 6, 4, 16
#: Characters of the findings that one task trains on, about, and of those whose order it mixes at once; each is taken whole.
SHARE_CHARS, MIX_CHARS = 500_000, 500_000
#: Passes over all findings, and the step of Adam.
EPOCHS, RATE = 8, 0.01
#: Window places scored in one call.
PLACES = 50_000
#: Recall on held-out findings that the threshold keeps.
RECALL = 0.98


def _symbol_table() -> np.ndarray:
    """Code point below 128 -> symbol; letters keep their case apart by vowel and consonant classes only in part."""
    t = np.full(128, 1, np.int64)
    for i, c in enumerate("0123456789"):
        t[ord(c)] = 2 + i
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz"):
        t[ord(c)] = 12 + i
        t[ord(c.upper())] = 38
    for i, c in enumerate("+/_=-.:\"'"):
        t[ord(c)] = 39 + min(i, 7)
    t[ord(" ")] = 47
    return t


_TABLE = _symbol_table()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, in order."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans of the candidates: every token that is long, or shorter with a digit."""
    return [m.span() for m in _TOKEN.finditer(text) if m.end() - m.start() >= LONG or _DIGIT.search(text, m.start(), m.end())]


def strip(text: str, a: int, b: int) -> str:
    """The whole token, filled up to BODY, with what stands before and after it; its windows are those of WIDTH."""
    return text[max(0, a - BEFORE) : a].rjust(BEFORE, "\0") + text[a:b].ljust(BODY, "\0") + text[b : b + AFTER].ljust(AFTER, "\0")


def bare(strip: str) -> str:
    """The same finding without its surroundings."""
    return "\0" * BEFORE + strip[BEFORE:-AFTER] + "\0" * AFTER


def encode(text: str) -> np.ndarray:
    """Symbols; 0 is beyond the text, 1 any character outside ASCII or without a symbol of its own."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points == 0, 0, np.where(points < 128, _TABLE[np.minimum(points, 127)], 1)).astype(np.uint8)


def pieces(strips: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, places of windows in them, strip of each place) for all windows, about PLACES at once."""
    texts: list[str] = []
    owners: list[int] = []
    size = 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([len(t) for t in texts])
        own = n - WIDTH + 1
        first = np.repeat(np.cumsum(n) - n - np.cumsum(own) + own, own)
        return encode("".join(texts)), first + np.arange(own.sum()), np.repeat(owners, own)

    for k, t in enumerate(strips):
        for i in range(0, len(t) - WIDTH + 1, PLACES):
            texts.append(t[i : i + PLACES + WIDTH - 1])
            owners.append(k)
            size += len(texts[-1])
            if size >= PLACES:
                yield out()
                texts, owners, size = [], [], 0
    if texts:
        yield out()


class CharCnn:
    """Embedding, one convolution, maximum and mean over positions, logistic output; trained by Adam."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.3, (SYMBOLS, EMBED)),
            "k": r.normal(0, 0.2, (KERNEL * EMBED, FILTERS)), "b": np.zeros(FILTERS),
            "w": r.normal(0, 0.2, 2 * FILTERS), "c": np.zeros(1),
        }
        self.m, self.v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))  # Adam's means
        self.step = 0
        self.scale, self.shift, self.threshold = 1.0, 0.0, 1.1

    def _columns(self, x: np.ndarray) -> np.ndarray:
        e = self.p["e"].astype(np.float32)[x]
        n = WIDTH - KERNEL + 1
        return np.concatenate([e[:, i : i + n] for i in range(KERNEL)], axis=2)

    def _places(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Logits of the windows that begin at ``at``: one convolution over all symbols, pooled over each window."""
        e, k = self.p["e"].astype(np.float32), self.p["k"].astype(np.float32)
        n, span = len(symbols) - KERNEL + 1, WIDTH - KERNEL + 1
        h = np.zeros((n, FILTERS), np.float32)
        for i in range(KERNEL):
            h += (e @ k[i * EMBED : (i + 1) * EMBED])[symbols[i : i + n]]
        h = np.maximum(h + self.p["b"].astype(np.float32), 0)
        total = np.concatenate([np.zeros((1, FILTERS)), np.cumsum(h, 0, dtype=np.float64)])
        mean = (total[at + span] - total[at]) / span
        top, wide = h, 1
        while 2 * wide <= span:
            top, wide = np.maximum(top[:-wide], top[wide:]), 2 * wide
        top = np.maximum(top[at], top[at + span - wide])
        return np.concatenate([top, mean], axis=1) @ self.p["w"] + self.p["c"][0]

    def best(self, strips: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(highest logit over all windows of a strip, symbols of that window) of each strip."""
        top, shown = np.full(len(strips), -np.inf), np.zeros((len(strips), WIDTH), np.uint8)
        for symbols, at, owner in pieces(strips):
            z = self._places(symbols, at)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            own, high = owner[first], np.maximum.reduceat(z, first)
            hit = np.flatnonzero(z == np.repeat(high, np.diff(first, append=len(z))))
            hit = hit[np.flatnonzero(np.diff(owner[hit], prepend=-1))]
            better = high > top[own]
            top[own[better]] = high[better]
            shown[own[better]] = symbols[at[hit[better]][:, None] + np.arange(WIDTH)]
        return top, shown

    def windows(self, strips: list[str]) -> np.ndarray:
        """Symbols of the window with the highest score of each strip."""
        size = np.array([len(t) for t in strips])
        out = np.empty((len(strips), WIDTH), np.uint8)
        one = np.flatnonzero(size == WIDTH)
        if len(one):
            out[one] = encode("".join(strips[i] for i in one)).reshape(-1, WIDTH)
        more = np.flatnonzero(size > WIDTH)
        if len(more):
            out[more] = self.best([strips[i] for i in more])[1]
        return out

    def learn(self, strips: list[str], y: np.ndarray, weight: np.ndarray, n: np.ndarray, r: np.random.Generator) -> None:
        """One pass over the strips in a mixed order; a strip stands for its window with the highest score, and counts
        ``n`` times in the mean of its step."""
        x = self.windows(strips)
        order = r.permutation(len(x))
        for i in range(0, len(x), 128):
            own = order[i : i + 128]
            self.step += 1
            for k, g in self._gradients(x[own], y[own], weight[own] * n[own] / n[own].mean()).items():
                self.m[k] = 0.9 * self.m[k] + 0.1 * g
                self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
                self.p[k] -= RATE * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.999**self.step)) + 1e-8)

    def state(self) -> np.ndarray:
        """Parameters and Adam's means in one array."""
        return np.concatenate([d[k].ravel() for d in (self.p, self.m, self.v) for k in sorted(d)])

    def take(self, state: np.ndarray, step: int) -> None:
        at = 0
        for d in (self.p, self.m, self.v):
            for k in sorted(d):
                d[k] = state[at : at + d[k].size].reshape(d[k].shape).copy()
                at += d[k].size
        self.step = step

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        c = self._columns(x).astype(float)
        z = c @ self.p["k"] + self.p["b"]
        h = np.maximum(z, 0)
        top = h.argmax(1)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(1)], axis=1)
        d = weight * (1 / (1 + np.exp(-np.clip(pooled @ self.p["w"] + self.p["c"][0], -30, 30))) - y) / len(x)
        dp = d[:, None] * self.p["w"]
        dh = np.repeat(dp[:, None, FILTERS:] / h.shape[1], h.shape[1], 1)
        np.put_along_axis(dh, top[:, None], np.take_along_axis(dh, top[:, None], 1) + dp[:, None, :FILTERS], 1)
        dz = dh * (z > 0)
        dc = dz @ self.p["k"].T
        de = np.zeros_like(self.p["e"])
        n = c.shape[1]
        for i in range(KERNEL):
            np.add.at(de, x[:, i : i + n], dc[:, :, i * EMBED : (i + 1) * EMBED])
        return {"e": de, "k": c.reshape(-1, c.shape[2]).T @ dz.reshape(-1, FILTERS), "b": dz.sum((0, 1)), "w": pooled.T @ d, "c": np.array([d.sum()])}

    def calibrate(self, strips: list[str], y: np.ndarray) -> None:
        """Platt scaling on held-out findings, then the highest threshold that keeps the recall."""
        z = self.best(strips)[0]
        target = np.where(y == 1, *_targets(y.sum(), (1 - y).sum()))

        def sums(a: float, b: float) -> list[float]:
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            g, w = p - target, p * (1 - p) + 1e-9
            return [(w * z * z).sum(), (w * z).sum(), w.sum(), (g * z).sum(), g.sum()]

        self.scale, self.shift = _platt(sums)
        p = self._probability(z)
        self.threshold = float(np.quantile(p[y == 1], 1 - RECALL, method="lower"))

    def _probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))

    def probability(self, strips: list[str]) -> np.ndarray:
        return self._probability(self.best(strips)[0])


def _targets(positive: float, negative: float) -> tuple[float, float]:
    """What Platt scaling aims at for positives and for negatives."""
    return (positive + 1) / (positive + 2), 1 / (negative + 2)


def _platt(sums: Callable[[float, float], list[float]]) -> tuple[float, float]:
    """Scale and shift by Newton's method; ``sums`` gives those of the second and first derivatives at (scale, shift)."""
    a, b = 1.0, 0.0
    for _ in range(100):
        zz, z, one, gz, g = sums(a, b)
        s = np.linalg.solve([[zz + 1e-3, z], [z, one + 1e-3]], [gz, g])
        a, b = max(a - float(s[0]), 1e-3), b - float(s[1])
        if abs(s).max() < 1e-9:
            break
    return a, b


def _sortable(x: np.ndarray) -> np.ndarray:
    """Bits of doubles as integers in the same order; its own inverse on the bits."""
    return x ^ ((x >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def findings(docs: DataFrame) -> DataFrame:
    """All distinct labelled findings: (y, w, n, h), the class (1: meets a base finding, 0: any other candidate), the whole
    token with its surroundings, how often it occurs, and a hash of it."""

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            rows = [(y, w, n) for (y, w), n in held.items()]
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.int64()))], names=["y", "w", "n"])

        for b in batches:
            for x in b.column("text"):
                t = x.as_py()
                if not t:
                    continue
                base = Spans((s, f) for s, _, f in base_spans(t))
                for a, e in tokens(t):
                    key = (int(base.meets(a, e)), strip(t, a, e))
                    held[key] += 1
                    if held[key] == 1:
                        size += len(key[1])
                    if size > 8 * SHARE_CHARS:
                        yield flush()
        if held:
            yield flush()

    each = bounded_batches(docs).select("text").mapInArrow(tidy(label), "y int, w string, n long")
    return materialize(each.groupBy("y", "w").agg(F.sum("n").alias("n")).withColumn("h", F.xxhash64("w")), "findings")


def _shown(b: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Each finding twice, with its surroundings and bare: strips, classes, occurrences."""
    w = b.column("w").to_pylist()
    return w + [bare(x) for x in w], np.tile(b.column("y").to_numpy().astype(float), 2), np.tile(b.column("n").to_numpy().astype(float), 2)


def _groups(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows in groups of about ``most`` characters that do not depend on the batches."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        begin = 0
        for i, n in enumerate(pc.utf8_length(b.column("w")).to_pylist()):
            size += n
            if size >= most:
                yield pa.Table.from_batches([*held, b.slice(begin, i + 1 - begin)]).combine_chunks().to_batches()[0]
                held, size, begin = [], 0, i + 1
        if begin < b.num_rows:
            held.append(b.slice(begin))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _train(net: CharCnn, rows: DataFrame, weight: dict[int, float]) -> None:
    """EPOCHS passes over all findings, dealt by hash over as many tasks as their characters ask for, not by how the
    documents are dealt. Every task goes on from the same network, and the networks are averaged by their findings."""
    shares = max(1, -(-rows.agg(F.sum(F.length("w"))).first()[0] // SHARE_CHARS))
    dealt = rows.repartitionById(shares, F.pmod(F.shiftright("h", 2), F.lit(shares)).cast("int")).sortWithinPartitions("h", "w", "y").select("y", "w", "n")
    for epoch in range(EPOCHS):

        def train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            own, r, total = copy.deepcopy(net), np.random.default_rng((6, epoch, part)), 0
            for b in _groups(batches, MIX_CHARS):
                strips, y, n = _shown(b)
                total += int(n.sum())
                own.learn(strips, y, np.where(y == 1, weight[1], weight[0]), n, r)
            if total:
                yield pa.RecordBatch.from_pydict({"part": [part], "n": [total], "step": [own.step], "state": [own.state().tobytes()]})

        each = sorted(dealt.mapInArrow(tidy(train), "part long, n long, step long, state binary").collect())
        total = sum(x.n for x in each)
        net.take(sum(np.frombuffer(x.state) * (x.n / total) for x in each), max(x.step for x in each))


def _settle(net: CharCnn, rows: DataFrame) -> None:
    """As ``CharCnn.calibrate``, over all rows: sums by Spark, and the threshold selected by its bits, 16 at a time."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _groups(batches, MIX_CHARS):
            strips, y, n = _shown(b)
            z = net.best(strips)[0]
            yield pa.RecordBatch.from_pydict({"y": y, "n": n.astype(np.int64), "z": z, "bits": _sortable(z.view(np.int64))})

    scored = materialize(rows.select("y", "w", "n").mapInArrow(tidy(score), "y double, n long, z double, bits long"), "scored")
    size = {int(x.y): x.n for x in scored.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    up, down = _targets(size[1], size[0])

    def sums(a: float, b: float) -> list[float]:
        p = 1 / (1 + F.exp(-F.least(F.greatest(a * F.col("z") + b, F.lit(-30.0)), F.lit(30.0))))
        x = scored.select("n", "z", (p - F.when(F.col("y") == 1, up).otherwise(down)).alias("g"), (p * (1 - p) + 1e-9).alias("w"))
        return list(x.agg(*[F.sum(F.expr(f"n * {e}")) for e in ("w * z * z", "w * z", "w", "g * z", "g")]).first())

    net.scale, net.shift = _platt(sums)
    left, rank = scored.where("y = 1"), int((size[1] - 1) * (1 - RECALL))
    for shift in (48, 32, 16, 0):
        for found, n in sorted(left.groupBy(F.shiftright("bits", shift)).agg(F.sum("n")).collect()):
            if rank < n:
                break
            rank -= n
        left = left.where(F.shiftright("bits", shift) == found)
    net.threshold = float(net._probability(_sortable(np.array([found], np.int64)).view(np.float64))[0])
    discard(scored)


def fit_network(docs: DataFrame) -> CharCnn | None:
    """Train on all labelled findings, each as often as it occurs: a base finding is a positive, any other candidate a
    negative. A quarter of the distinct ones is held out by hash for calibration and threshold; where either part would
    lack a class, all findings serve for both. Only networks and sums go to the driver. None where a class has fewer than
    10 findings."""
    found = findings(docs)
    held = F.pmod("h", F.lit(4)) == 3
    n = {(x.y, x.held): x.n for x in found.groupBy("y", held.alias("held")).agg(F.sum("n").alias("n")).collect()}
    if any(n.get((y, False), 0) + n.get((y, True), 0) < 10 for y in (0, 1)):
        discard(found)
        return None
    split = len(n) == 4
    size = [n.get((y, False), 0) + (0 if split else n.get((y, True), 0)) for y in (0, 1)]
    net = CharCnn()
    _train(net, found.where(~held) if split else found, {y: 0.5 * sum(size) / size[y] for y in (0, 1)})
    _settle(net, found.where(held) if split else found)
    discard(found)
    return net


_OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame, net: CharCnn | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, base counts, digest of the base spans, and all spans.

    Positions are code points of the whole text, ends exclusive. A null text is empty and has no span; a null doc_id
    stays null; repeated rows give repeated results; other columns are ignored; an empty table gives no row.
    Candidates that meet a base span are not added; without a network nothing is added.
    """

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, bases, owner, spans, strips, hot = b.column("doc_id").to_pylist(), [], [], [], [], []
            size = 0

            def score() -> None:
                nonlocal size
                if strips:
                    hot.extend((net.probability(strips) >= net.threshold).tolist())
                    strips.clear()
                    size = 0

            for i, x in enumerate(b.column("text")):
                t = x.as_py() or ""
                base = base_spans(t)
                bases.append(base)
                if net is not None:
                    taken = Spans((s, f) for s, _, f in base)
                    for a, e in tokens(t):
                        if not taken.meets(a, e):
                            owner.append(i)
                            spans.append((a, e))
                            strips.append(strip(t, a, e))
                            size += len(strips[-1])
                    if size > 20_000 * WIDTH:
                        score()
            score()
            more: dict[int, list] = {}
            for i, s, h in zip(owner, spans, hot):
                if h:
                    more.setdefault(i, []).append((s[0], len(KINDS), s[1]))
            columns: list[list] = [[] for _ in range(6)]
            names = (*KINDS, ADDED)
            for i, base in enumerate(bases):
                n = Counter(k for _, k, _ in base)
                text = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in base)
                every = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(base + more.get(i, [])))
                for c, v in zip(columns, (ids[i], n[0], n[1], n[2], hashlib.sha256(text.encode()).hexdigest(), every)):
                    c.append(v)
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in _OUT.split(", ")])

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(find), _OUT)


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_secrets(docs, fit_network(docs))
