"""Personal data by weak supervision.

Exact base patterns are always reported. Looser candidates are judged by several labelers (regular expressions,
gazetteers of cue words, context and checksums), each of which votes for, against or abstains. Expectation-maximisation
over the counts of vote patterns of the whole corpus estimates how reliable each labeler is; the resulting
posteriors train a logistic span classifier, which decides about the candidates.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Spans, bounded_batches, tidy

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

# Cue words of the gazetteer labelers, lower case.
CUES_FOR = ("email", "e-mail", "mail", "phone", "tel", "call", "mobile", "fax", "card", "visa", "iban", "konto", "account", "ssn", "contact", "name", "born", "passport", "telefon", "correo", "courriel", "anruf", "llame")
CUES_AGAINST = ("order", "invoice", "version", "ref", "token", "sha", "isbn", "total", "price", "page", "chapter", "figure", "section", "released", "build", "commit", "seite", "precio", "prix")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sr", "Sra")

_FOR = re.compile(r"(?<![^\W_])(?:" + "|".join(CUES_FOR) + r")(?![^\W_])", re.I)
_AGAINST = re.compile(r"(?<![^\W_])(?:" + "|".join(CUES_AGAINST) + r")(?![^\W_])", re.I)

#: Candidates of the method: (kind, a test that is cheap, pattern). Bounded repetitions keep every search linear.
_LOOSE = (
    ("obfuscated", re.compile(r"[\[(]at[\])]", re.I), re.compile(r"[A-Za-z0-9._+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,64}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z]{2,12}){1,3}", re.I)),
    ("national", _DIGIT, re.compile(r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")),
    ("local_phone", _DIGIT, re.compile(r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])(?:[0-9]{2,4}[ .-]){0,3}[0-9]{3,4}(?![0-9A-Za-z.-]?[0-9])")),
    ("iban", _DIGIT, re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")),
    ("number", _DIGIT, re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{4}(?:[ -]?[0-9]{4}){2,3}(?:[ -]?[0-9]{1,3})?(?![0-9A-Za-z])")),
    ("person", re.compile("|".join(TITLES)), re.compile(r"(?<![A-Za-z])(?:" + "|".join(TITLES) + r")\.? [A-Z][a-zäöüéèáñ]{1,20}(?: [A-Z][a-zäöüéèáñ]{1,20})?")),
)
LOOSE_KINDS = tuple(k for k, _, _ in _LOOSE)
LABELERS = ("strict", "cue_for", "cue_against", "base", "checksum", "shape", "context")
#: Candidates whose classifier probability reaches this are reported.
THRESHOLD = 0.7
#: Values of each feature. All votes and features are discrete and most votes are features too, so no more than
#: 6 x 8 x 7 x 5 x 2 x 2 x 2 x 3 x 3 x 2 = 241,920 patterns of them exist; all that occur go to the driver, with their counts.
FEATURE_VALUES = (len(_LOOSE), 8, 7, 5, 2, 2, 2, 3)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, leftmost and non-overlapping per kind, in order."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:  # a match is the run of local characters before an @, and the domain behind it
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: Iterable[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, tuple[int, ...], tuple[int, ...]]]:
    """(start, loose kind, end, votes, features) of every looser candidate."""
    taken = Spans((x, y) for x, _, y in base)
    for k, (kind, cheap, pattern) in enumerate(_LOOSE):
        if not cheap.search(text):
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            before, after = text[max(0, a - 32) : a], text[b : b + 8]
            body = m[0]
            digits = "".join(c for c in body if "0" <= c <= "9")
            seps = sum(not c.isalnum() for c in body)
            overlap = taken.meets(a, b)
            votes = (
                1 if kind in ("obfuscated", "national", "iban", "person") else 0,
                1 if _FOR.search(before) else 0,
                -1 if _AGAINST.search(before) else 0,
                1 if overlap else 0,
                (1 if luhn(digits) else -1) if kind == "number" and 14 <= len(digits) <= 19 else (iban_ok(body) if kind == "iban" else 0),
                -1 if digits and len(set(digits)) <= 2 else (1 if digits and 1 <= seps <= 4 and kind != "number" else 0),
                -1 if re.match(r"\s*(?:%|€|\$|/)", after) or re.search(r"[=#$€]\s*$", before) else 0,
            )
            features = (k, min(len(body) // 4, 7), min(len(digits) // 3, 6), min(seps, 4), int(bool(_FOR.search(before))), int(bool(_AGAINST.search(before))), int(overlap), votes[4] + 1)
            yield a, k, b, votes, features


def iban_ok(body: str) -> int:
    s = body.replace(" ", "")
    s = s[4:] + s[:4]
    return 1 if int("".join(str(int(c, 36)) for c in s)) % 97 == 1 else -1


class WeakModel:
    """Reliabilities of the labelers and the classifier trained on what they agree on."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], tuple[int, ...], int]], rounds: int = 50):
        self.weights: np.ndarray | None = None
        if not patterns:
            return
        votes = np.array([p[0] for p in patterns])
        n = np.array([p[2] for p in patterns], float)
        # reliability of a labeler: the probability of each vote given the truth
        share = np.empty((2, votes.shape[1], 3))
        share[1], share[0] = (0.1, 0.5, 0.4), (0.4, 0.5, 0.1)
        prior = 0.5
        for _ in range(rounds):
            log = np.stack([np.log((1 - prior, prior)[y]) + sum(np.log(share[y, j, votes[:, j] + 1]) for j in range(votes.shape[1])) for y in (0, 1)])
            self.posterior = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
            for y, q in ((1, n * self.posterior), (0, n * (1 - self.posterior))):
                for j in range(votes.shape[1]):
                    # pseudo-counts keep a labeler better than chance and no probability at zero
                    s = np.array([q[votes[:, j] == v].sum() for v in (-1, 0, 1)]) + ((1, 4, 4) if y else (4, 4, 1))
                    share[y, j] = s / s.sum()
            prior = float(np.clip((n * self.posterior).sum() / n.sum(), 0.02, 0.98))
        self.share, self.prior = share, prior
        x = self._design(np.array([p[1] for p in patterns]))
        w = np.zeros(x.shape[1])
        for _ in range(30):  # Newton steps of the penalised likelihood
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
            step = np.linalg.solve(h, x.T @ (n * (self.posterior - p)) - w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    @staticmethod
    def _design(f: np.ndarray) -> np.ndarray:
        one = [np.ones((len(f), 1))]
        one += [(f[:, [c]] == np.arange(m)).astype(float) for c, m in enumerate(FEATURE_VALUES)]
        return np.hstack(one)

    def probability(self, features: list[tuple[int, ...]]) -> np.ndarray:
        if self.weights is None or not features:
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(self._design(np.array(features)) @ self.weights, -30, 30)))


def fit_weak_model(docs: DataFrame) -> WeakModel:
    """EM over the vote patterns of all candidates of all documents; only pattern counts leave the executors."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for x in b.column("text"):
                if t := x.as_py():
                    for _, _, _, votes, features in candidates(t, base_spans(t)):
                        seen[votes + features] += 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in seen], pa.list_(pa.int32())), pa.array(seen.values(), pa.int64())], names=["pattern", "n"])

    m = len(LABELERS)
    rows = bounded_batches(docs).select("text").mapInArrow(tidy(count), "pattern array<int>, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pattern").collect()
    return WeakModel([(tuple(r.pattern[:m]), tuple(r.pattern[m:]), r.n) for r in rows])


_OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_pii(docs: DataFrame, model: WeakModel, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, base counts, digest of the base spans, and all spans.

    Positions are code points of the whole text, ends exclusive. A null text is empty and has no span; a null doc_id
    stays null; repeated rows give repeated results; other columns are ignored; an empty table gives no row. A
    candidate that meets a base span is not added, and of overlapping candidates the most probable stays,
    then the earliest, then the kind listed first.
    """

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list] = [[] for _ in range(7)]
            for doc_id, x in zip(b.column("doc_id").to_pylist(), b.column("text")):
                t = x.as_py() or ""
                base = base_spans(t)
                named = [(s, KINDS[k], e) for s, k, e in base]
                found = list(candidates(t, base))
                more: list[tuple[int, str, int]] = []
                if found:
                    p = model.probability([c[4] for c in found])
                    taken = Spans((s, e) for s, _, e in base)
                    for i in sorted(range(len(found)), key=lambda i: (-p[i], found[i][:3])):
                        s, k, e = found[i][:3]
                        if p[i] >= threshold and not taken.meets(s, e):
                            taken.add(s, e)
                            more.append((s, LOOSE_KINDS[k], e))
                order = {k: i for i, k in enumerate(KINDS + LOOSE_KINDS)}
                kinds = Counter(k for _, k, _ in base)
                row = [doc_id, *(kinds[k] for k in range(4)), hashlib.sha256(joined(named).encode()).hexdigest(), joined(sorted(named + more, key=lambda s: (s[0], order[s[1]])))]
                for c, v in zip(columns, row):
                    c.append(v)
            types = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in _OUT.split(", ")])

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(find), _OUT)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_pii(docs, fit_weak_model(docs))
