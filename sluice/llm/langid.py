"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum
over all its segmentations into pieces, by the forward algorithm; a text is the product over its words. The piece
probabilities are fitted by expectation-maximisation (forward-backward over all segmentations) on the counts of
each language's words, gathered from a bounded sample of the labelled training documents. Predictions look at whole words of
any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import bounded_batches, tidy

#: Most frequent words of a language that the fit uses, of FIT_CHARS letters at most. The fit runs on the driver, one
#: language after the other.
WORDS_PER_LANGUAGE, FIT_CHARS = 20_000, 32
#: Labelled documents of a language that the fit uses, about.
SAMPLE_PER_LANGUAGE = 5_000
EM_ROUNDS = 3
#: Words above so many letters are scored with scaled sums, about LONG_LETTERS of them at once.
LONG_WORD, LONG_LETTERS = 24, 200_000
#: Distinct words whose scores are remembered by a task.
MEMO = 200_000
#: Texts scored in one call.
DOCS = 500
#: Probability mass of a character that no piece covers.
UNKNOWN = 1e-7

#: A text is implausible if its letters are, on average, worse than UNUSUAL times the mean log-likelihood per letter of
#: the words that its language was learned from, by EVIDENCE nats in all: short texts cannot be.
UNUSUAL, EVIDENCE = 4.0, 100.0

_SPLIT = re.compile(r"[^\W\d_]+")


def pieces_of(model_path: str) -> dict[str, int]:
    """The vocabulary: every letters-only piece of a sentencepiece model, lower-cased, without the word marker, as words
    are; single characters come in as they are met (see ``Forward``)."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    found = {sp.id_to_piece(i).replace("▁", "").lower() for i in range(sp.get_piece_size())}
    return {p: k for k, p in enumerate(sorted(p for p in found if _SPLIT.fullmatch(p)))}


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return _SPLIT.findall(text.lower())


class Forward:
    """Scores of words in all languages at once. ``p``: (pieces, languages) probabilities."""

    def __init__(self, vocabulary: dict[str, int], p: np.ndarray):
        self.vocabulary = vocabulary
        self.p = np.vstack([p, np.full((1, p.shape[1]), UNKNOWN)])
        self.unknown = len(p)
        self.longest = max(map(len, vocabulary), default=1)

    def lattice(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For words of one length, per end position: (word row, start, piece)."""
        n, get = len(words[0]), self.vocabulary.get
        out = []
        for end in range(1, n + 1):
            rows, starts, ids = [], [], []
            for start in range(max(0, end - self.longest), end):
                found = [get(w[start:end], -1) for w in words]
                if end - start == 1:
                    found = [self.unknown if k < 0 else k for k in found]
                ids_ = np.array(found)
                keep = np.flatnonzero(ids_ >= 0)
                rows.append(keep)
                starts.append(np.full(len(keep), start))
                ids.append(ids_[keep])
            out.append((np.concatenate(rows), np.concatenate(starts), np.concatenate(ids)))
        return out

    def _forward(self, lattice: list, m: int) -> np.ndarray:
        alpha = np.zeros((len(lattice) + 1, m, self.p.shape[1]))
        alpha[0] = 1
        for end, (rows, starts, ids) in enumerate(lattice, 1):
            for start in range(max(0, end - self.longest), end):
                k = starts == start
                alpha[end, rows[k]] += alpha[start, rows[k]] * self.p[ids[k]]
        return alpha

    def log_scores(self, words: list[str]) -> np.ndarray:
        """(words, languages): log of the probability summed over all segmentations."""
        out = np.empty((len(words), self.p.shape[1]))
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for n in [n for n in by_length if n <= LONG_WORD]:
            own = by_length.pop(n)
            for j in range(0, len(own), 20_000):
                part = own[j : j + 20_000]
                alpha = self._forward(self.lattice([words[i] for i in part]), len(part))
                out[part] = np.log(alpha[-1])
        held: list[int] = []
        for n in sorted(by_length):  # words of about the same length together
            for i in by_length[n]:
                held.append(i)
                if n * len(held) * self.p.shape[1] >= 4 * LONG_LETTERS or n > 2 * len(words[held[0]]):
                    out[held] = self._long(held, words)
                    held = []
        if held:
            out[held] = self._long(held, words)
        return out

    def _long(self, which: list[int], words: list[str]) -> np.ndarray:
        """As ``log_scores``, for long words, shortest first: only the sums that the longest piece can reach back to are
        kept, and each word's are scaled to 1 at every position, so that nothing vanishes."""
        own, get = [words[i] for i in which], self.vocabulary.get
        m, back = len(own), self.longest
        size = np.array([len(w) for w in own])
        out, scale = np.empty((m, self.p.shape[1])), np.zeros((m, self.p.shape[1]))
        window = np.zeros((back, m, self.p.shape[1]))  # window[end % back]: sums up to end
        window[0] = 1
        first = 0  # words before it have ended
        for end in range(1, int(size[-1]) + 1):
            rows, starts, ids = [], [], []
            for r in range(first, m):
                w = own[r]
                for start in range(max(0, end - back), end):
                    k = get(w[start:end])
                    if k is None:
                        if start < end - 1:
                            continue
                        k = self.unknown
                    rows.append(r)
                    starts.append(start % back)
                    ids.append(k)
            now = np.zeros((m, self.p.shape[1]))
            np.add.at(now, rows, window[starts, rows] * self.p[ids])
            top = np.where(now > 0, now, 1.0)
            window /= top
            window[end % back] = now > 0
            scale += np.log(top)
            done = int(np.searchsorted(size, end, "right"))
            out[first:done] = scale[first:done]
            first = done
        return out

    def expectation(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language; counts: (words, languages)."""
        out = np.zeros_like(self.p)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for n, own in by_length.items():
            lattice = self.lattice([words[i] for i in own])
            alpha = self._forward(lattice, len(own))
            beta = np.zeros_like(alpha)
            beta[n] = 1
            weight = counts[own] / alpha[n]
            for end in range(n, 0, -1):
                rows, starts, ids = lattice[end - 1]
                for start in range(max(0, end - self.longest), end):
                    k = starts == start
                    r, p = rows[k], ids[k]
                    through = beta[end, r] * self.p[p]
                    np.add.at(out, p, alpha[start, r] * through * weight[r])
                    beta[start, r] += through
        return out


class LanguageModel:
    """Piece probabilities per language and the prior of the languages; small enough for every task (pieces x languages doubles)."""

    def __init__(self, languages: list[str], vocabulary: dict[str, int], p: np.ndarray, usual: np.ndarray | None = None):
        self.languages, self.vocabulary, self.p = languages, vocabulary, p
        #: Mean log-likelihood per letter of each language's own words.
        self.usual = np.full(len(languages), -np.inf) if usual is None else usual
        self._forward: Forward | None = None
        self._memo: dict[str, int] = {}
        self._rows = np.zeros((0, len(languages)))

    def __getstate__(self):
        return (self.languages, self.vocabulary, self.p.astype(np.float32), self.usual)

    def __setstate__(self, state):
        self.__init__(state[0], state[1], state[2].astype(np.float64), state[3])

    @classmethod
    def fit(cls, counts: dict[str, dict[str, int]], vocabulary: dict[str, int], rounds: int = EM_ROUNDS) -> LanguageModel:
        """counts: language -> word -> number of times. Letters that the vocabulary lacks become pieces."""
        languages = sorted(counts)
        vocabulary = dict(vocabulary)
        for c in sorted({c for own in counts.values() for w in own for c in w}):
            vocabulary.setdefault(c, len(vocabulary))
        p, usual = np.full((len(vocabulary), len(languages)), 1 / max(1, len(vocabulary))), np.full(len(languages), -np.inf)
        for g, language in enumerate(languages):  # the languages do not depend on each other
            words = sorted(counts[language])
            if not words:
                continue
            n = np.array([[counts[language][w]] for w in words], float)
            # start: all pieces alike, so that no segmentation is excluded
            own = p[:, g : g + 1]
            for _ in range(rounds):
                uses = Forward(vocabulary, own).expectation(words, n)[:-1]
                uses += 0.01  # smoothing: every piece stays possible in every language
                own = uses / uses.sum(0)
            p[:, g : g + 1] = own
            score, letters = Forward(vocabulary, own).log_scores(words), np.array([len(w) for w in words])
            usual[g] = (n * score).sum() / max(1, letters @ n[:, 0])
        return cls(languages, vocabulary, p, usual)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language or ``und``, its posterior). Without letters, or without any language learned: ``und`` and 0."""
        return [x[:2] for x in self.judge(texts)]

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """As ``predict``, and whether the text can be one of a language: it has letters, and they are not implausible
        in the predicted language (UNUSUAL); where no language could be learned, letters are enough."""
        if self._forward is None or len(self._memo) > MEMO:
            self._forward, self._memo, self._rows = Forward(self.vocabulary, self.p), {}, np.zeros((0, len(self.languages)))
        split = [words_of(t) if t else [] for t in texts]
        new = list({w for own in split for w in own} - self._memo.keys())
        if new and self.languages:
            self._memo.update(zip(new, range(len(self._rows), len(self._rows) + len(new))))
            self._rows = np.concatenate([self._rows, self._forward.log_scores(new)])
        out = []
        for own in split:
            letters = any(c.isalpha() for w in own for c in w)
            if not self.languages or not letters:
                out.append(("und", 0.0, letters))
                continue
            total = self._rows[np.fromiter(map(self._memo.__getitem__, own), np.int64, len(own))].sum(0)
            best = int(total.argmax())
            plausible = bool(total[best] >= UNUSUAL * self.usual[best] * sum(map(len, own)) - EVIDENCE)
            out.append((self.languages[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum()), plausible))
        return out


def held_out(doc_id: int | None) -> bool:
    """crc32(doc_id as text) mod 4 is 2; a null id is not held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def _held(col="doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_language_model(docs: DataFrame, model_path: str, words_per_language: int = WORDS_PER_LANGUAGE, sample: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from ``text`` and non-null ``lang`` of documents that are not held out.

    The fit uses a bounded sample: about ``sample`` documents of each language, chosen by a hash of the id (all of
    them where a language has fewer), and of these the most frequent words of FIT_CHARS letters at most; so many rows a
    language at most go to the driver. Every label is a language, however rare; a task's memory grows with the number of
    labels (pieces x languages). Without any labelled document the model knows no language.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            rows = [(g, w, n) for g, c in total.items() for w, n in c.items()]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

        for b in batches:
            for text, lang in zip(b.column("text"), b.column("lang").to_pylist()):
                total.setdefault(lang, Counter()).update(w for w in words_of(text.as_py()) if len(w) <= FIT_CHARS)
            if sum(map(len, total.values())) > MEMO:
                yield flush()
        if any(total.values()):
            yield flush()

    labelled = bounded_batches(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~_held())
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return LanguageModel.fit({}, {})
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1.0, sample / r.n))])
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("text", "lang")
    words = chosen.mapInArrow(tidy(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    counts: dict[str, dict[str, int]] = {}
    for lang, word, n in words.withColumn("r", rank).where(F.col("r") <= words_per_language).select("lang", "word", "n").toLocalIterator():
        counts.setdefault(lang, {})[word] = n
    return LanguageModel.fit(counts, pieces_of(model_path))


def identify(docs: DataFrame, model: LanguageModel, names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs`` with the predicted language and its score (columns of those names are replaced). A third
    name adds whether the text is plausible (see ``LanguageModel.judge``).

    The language is ``und`` with score 0 where the text is null or has no letter. Only ``text`` is looked at, whole.
    """
    docs = bounded_batches(docs).drop(*names)
    kinds = [(T.StringType(), pa.string()), (T.DoubleType(), pa.float64()), (T.BooleanType(), pa.bool_())]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, (k, _) in zip(names, kinds)]])

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, DOCS):
                part = b.slice(i, DOCS)
                found = model.judge(part.column("text").to_pylist())
                more = [pa.array([x[j] for x in found], k) for j, (_, (_, k)) in enumerate(zip(names, kinds))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, *names])

    return docs.mapInArrow(tidy(predict), schema)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """Fit on the documents whose crc32 remainder is not 2, predict all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit_language_model(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", _held().alias("held_out"), "lang_pred", "score")
