import random
import re

import numpy as np
import pytest

from sluice.llm import decontaminate as m


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(texts, items, k=5, percent=80):
    own = {i: words(t) for i, t in enumerate(items) if words(t)}
    s = max([16, *map(len, own.values())])
    out = {}
    for d, t in enumerate(texts):
        w = words(t)
        for p in range(0, len(w) + 1, s):
            part = w[p : p + 2 * s]
            for i, q in own.items():
                n = min(k, len(q))
                grams = {tuple(q[j : j + n]) for j in range(len(q) - n + 1)}
                shared = len(grams & {tuple(part[j : j + n]) for j in range(len(part) - n + 1)})
                ends = [j for j, x in enumerate(q[:-1]) if x[-1] in ".?!"]
                answer = set(q[ends[-1] + 1 if ends else 0 :])
                both = len(answer & set(part))
                if 100 * shared >= percent * len(grams) and 2 * both >= len(answer):
                    a, b, *_ = out.get((d, i), (0, 0))
                    out[d, i] = (max(a, shared), max(b, both), len(grams), len(answer))
    return {k: (v[0], v[2], v[1], v[3]) for k, v in out.items()}


def case(seed):
    r = random.Random(seed)
    pool = ["the", "of", "and", "in"] * 12 + [f"w{i}" for i in range(120)]
    text = lambda n: " ".join(r.choice(pool) + ("." if r.random() < 0.1 else "") for _ in range(n))
    items = [text(r.choice((1, 2, 4, 6, 12, 30, 45))) for _ in range(50)] + [None, "", " \n", "the of the of the of the of"]
    texts = [text(r.randint(1, 300)) for _ in range(60)]
    for _ in range(150):
        w = r.choice(items[:50]).split()
        for _ in range(r.choice((0, 0, 1, 2, 3))):
            w[r.randrange(len(w))] = r.choice(pool)
        if r.random() < 0.3:
            del w[: len(w) // 5]
        if r.random() < 0.5:
            w = [x.upper() for x in w]
        texts.append(text(r.randint(0, 120)) + " " + "\n".join(w) + " " + text(r.randint(0, 120)))
    return texts, items


def test_the_answer_does_not_depend_on_the_indexes(spark, frame, monkeypatch):
    """Short items beside a long one, in one index and in many: the passages are those of the whole benchmark."""
    monkeypatch.setattr(m, "INDEX_BYTES", 200)
    texts, items = case(4)
    items.append(" ".join(f"q{i}" for i in range(400)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): tuple(r)[2:] for r in m.contaminated(frame(texts, 4), bench.where("item_id % 6 = 0 or item_id > 50"), percent=60).collect()}
    kept = [t if i % 6 == 0 or i > 50 else None for i, t in enumerate(items)]
    assert got == brute(texts, kept, percent=60) and len(got) > 5


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, frame, seed):
    texts, items = case(seed)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): tuple(r)[2:] for r in m.contaminated(frame(texts, 4), bench).collect()}
    want = brute(texts, items)
    assert got == want and len(want) > 40


def test_retrieval_equals_full_scores():
    r = np.random.default_rng(4)
    items = [m.Item(i, " ".join(f"w{x}" for x in r.zipf(1.6, r.integers(5, 40)) % 300), 5) for i in range(120)]
    terms = np.unique(np.concatenate([i.words for i in items]))
    index = m.Index(items, terms, r.random(len(terms)) * 5 + 0.1, 80)
    dense = np.zeros((len(terms), len(items)))
    dense[index.term, index.item] = index.impact
    pairs = [(p, t) for p in range(200) for t in sorted(set((r.zipf(1.6, 60) % len(terms)).tolist()) | set(np.flatnonzero(dense[:, p % 120] * (r.random(len(terms)) < 0.9))))]
    passage, term = np.array(pairs).T
    got = set(zip(*(x.tolist() for x in index.retrieve(passage, term))))
    score = np.zeros((200, len(items)))
    for p, t in pairs:
        score[p] += dense[t]
    assert got == {(p, i) for p, i in zip(*np.nonzero(score >= 1))}
    for p, i in got:  # no retrieved item lacks all its essential terms
        assert any(index.essential[t] and dense[t, i] for q, t in pairs if q == p)


def test_several_indexes_and_odd_rows(spark, odd_frame, monkeypatch):
    monkeypatch.setattr(m, "INDEX_BYTES", 10)
    item = "what is the answer to this long question of ours. it is forty two"
    df = odd_frame(["x " + item + " y", item.upper(), None, "", "nothing"])
    bench = spark.createDataFrame([(7, item, 1), (8, "nothing", 1), (None, None, 1), (9, "", 1), (None, item, 1)], "item_id long, text string, doc_id int")
    got = sorted(((r.doc_id, r.item_id) for r in m.contaminated(df, bench).collect()), key=str)
    assert got == sorted([(0, 7), (0, None), (4, 8)] + [(1, 7), (1, None)] * 3, key=str)
    assert m.contaminated(df, bench.limit(0)).count() == 0 and m.contaminated(df.limit(0), bench).count() == 0
