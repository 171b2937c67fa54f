import itertools
import math

import numpy as np
import public_tokenizers
import pytest

from sluice.llm import langid as m

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(word, pieces):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            for rest in segmentations(word[n:], pieces):
                yield [word[:n], *rest]


def test_forward_sums_all_segmentations():
    pieces = {p: k for k, p in enumerate(["a", "b", "ab", "aba", "ba", "bb"])}
    p = np.random.default_rng(1).random((6, 2))
    words = ["".join(w) for n in range(1, 6) for w in itertools.product("ab", repeat=n)]
    got = m.Forward(pieces, p).log_scores(words)
    for w, row in zip(words, got):
        for g in range(2):
            want = sum(math.prod(p[pieces[x], g] for x in s) for s in segmentations(w, pieces))
            assert row[g] == pytest.approx(math.log(want))


def test_long_words_are_scored_whole():
    """Words of any length, by sums in logarithms over all segmentations."""
    r = np.random.default_rng(3)
    pieces = {p: k for k, p in enumerate(["a", "b", "ab", "aba", "ba", "bbabbabab", "c" * 30])}
    p = r.random((7, 3)) * 1e-3
    words = ["".join(r.choice(list("abcx"), n)) for n in (25, 25, 26, 40, 70, 300, 900)] + ["c" * 61, "ab" * 50]
    got = m.Forward(pieces, p).log_scores(words)
    for w, row in zip(words, got):
        for g in range(3):
            at = [0.0] + [-math.inf] * len(w)
            for end in range(1, len(w) + 1):
                parts = [at[s] + math.log(p[pieces[w[s:end]], g] if w[s:end] in pieces else m.UNKNOWN) for s in range(max(0, end - 30), end) if w[s:end] in pieces or s == end - 1]
                at[end] = max(parts) + math.log(sum(math.exp(x - max(parts)) for x in parts))
            assert row[g] == pytest.approx(at[-1])


def test_every_label_is_a_language(frame):
    texts = [f"{a}{b}ta {b}{a}no" for a in "bcdfghjklm" for b in "aeiou" for _ in range(6)]
    train = frame(texts).selectExpr("doc_id", "text", "concat('l', doc_id div 6) lang")
    model = m.fit_language_model(train.unionByName(train.selectExpr("doc_id + 1000 doc_id", "text", "lang")), MODEL)
    assert len(model.languages) == 50
    got = {r.doc_id: r.lang_pred for r in m.identify(train, model).collect()}
    assert sum(got[i] == f"l{i // 6}" for i in got) > 0.9 * len(got)


def test_expectation_by_enumeration():
    pieces = {p: k for k, p in enumerate(["a", "b", "ab", "aba", "ba", "bb"])}
    p = np.random.default_rng(2).random((6, 1))
    words, counts = ["abab", "bb", "abba", "a"], np.array([[3.0], [1], [2], [5]])
    want = np.zeros(6)
    for w, n in zip(words, counts[:, 0]):
        each = [(math.prod(p[pieces[x], 0] for x in s), s) for s in segmentations(w, pieces)]
        for q, s in each:
            for x in s:
                want[pieces[x]] += n * q / sum(e[0] for e in each)
    assert np.allclose(m.Forward(pieces, p).expectation(words, counts)[:-1, 0], want)


def test_held_out_accuracy(spark):
    rows = m.op6_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == m.held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in test) > 0.97 * len(test)


def test_lang_and_source_are_not_inputs(spark, frame):
    texts = ["the of and with that", "der die und nicht mit"] * 40
    train = frame(texts).selectExpr("doc_id", "text", "if(doc_id % 2 = 0, 'en', 'de') lang")
    model = m.fit_language_model(train, MODEL)
    a = {r.doc_id: r.lang_pred for r in m.identify(train, model).collect()}
    b = {r.doc_id: r.lang_pred for r in m.identify(train.selectExpr("doc_id + 1000 doc_id", "text"), model).collect()}
    assert a == {k - 1000: v for k, v in b.items()} == {i: "en" if i % 2 == 0 else "de" for i in range(80)}


def test_odd_rows(odd_frame):
    df = odd_frame(["the cat", "same text", None, "", "123 -- ²!", "é" * 70_000, "_"])
    model = m.fit_language_model(df, MODEL)
    rows = m.identify(df, model).collect()
    assert len(rows) == df.count() and set(df.columns) - {"score"} <= set(rows[0].asDict())
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (2, 3, 4, 6)} == dict.fromkeys((2, 3, 4, 6), "und")
    assert {r.lang_pred for r in rows if r.doc_id in (0, 1, 5)} == {"en"}
    none = m.fit_language_model(df.limit(0), MODEL)
    assert m.identify(df.limit(0), none).count() == 0 and {r.lang_pred for r in m.identify(df, none).collect()} == {"und"}
