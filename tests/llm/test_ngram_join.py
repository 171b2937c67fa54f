import random
import re

import pytest

from sluice.llm import base
from sluice.llm import ngram_join as m


def sets(texts, k):
    out = []
    for t in texts:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute(texts, k, percent):
    own = sets(texts, k)
    up = list(range(len(own)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(own)):
        for j in range(i):
            both = len(own[i] & own[j])
            if both and 100 * both >= percent * len(own[i] | own[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(own[i]), top(i)) for i in range(len(own))}


def corpus(seed, n=40):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    out = []
    for _ in range(n):
        base_ = [r.choice(words) for _ in range(r.choice((1, 2, 3, 5, 12, 40, 120)))]
        out.append(" ".join(base_))
        for _ in range(r.randint(0, 8)):  # chains of near copies: some link, some miss the threshold by little
            w = list(base_)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(words)
            out.append(" ".join(w))
            if r.random() < 0.5:
                base_ = w
    r.shuffle(out)
    return out


@pytest.mark.parametrize("k, percent, seed", [(3, 90, 1), (5, 80, 2), (3, 60, 3)])
def test_against_brute_force(frame, k, percent, seed, prose):
    texts = corpus(seed) + prose(20, seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in m.ngram_join(frame(texts, 5), k, percent).collect()}
    assert got == brute(texts, k, percent)


def test_local_lists_lose_nothing(frame, monkeypatch):
    monkeypatch.setattr(m, "LOCAL_LIST", 2)
    texts = corpus(8, 30)
    assert {r.doc_id: r.component_id for r in m.ngram_join(frame(texts, 6), 3, 80).collect()} == {k: v[1] for k, v in brute(texts, 3, 80).items()}


def test_blocks_lose_nothing(frame, monkeypatch):
    """Long lists dealt out in pairs of blocks, pairs looked at in small steps, signatures of different sizes."""
    for name, value in (("BLOCK", 3), ("STEP_PAIRS", 5), ("STEP_BYTES", 200), ("SIGNATURE_BYTES", (8, 64))):
        monkeypatch.setattr(m, name, value)
    texts = corpus(9, 30)
    assert {r.doc_id: r.component_id for r in m.ngram_join(frame(texts, 6), 3, 80).collect()} == {k: v[1] for k, v in brute(texts, 3, 80).items()}


def test_near_copies_of_one_text(frame):
    """A large group of near copies, of which many miss the first of them, and a passage that all other texts share."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    base_ = [r.choice(words) for _ in range(120)]
    passage = [r.choice(words) for _ in range(40)]
    texts = []
    for _ in range(1500):
        w = list(base_)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(" ".join(w))
    for _ in range(300):
        texts.append(" ".join(passage + [r.choice(words) for _ in range(r.randint(1, 12))]))
    got = {x.doc_id: x.component_id for x in m.ngram_join(frame(texts, 12), 3, 90).collect()}
    assert got == {k: v[1] for k, v in brute(texts, 3, 90).items()}


def test_signatures_bound_differences():
    import numpy as np

    r = np.random.default_rng(1)
    for n in (1, 30, 300, 3000, 30_000):
        a = r.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: n - n // 7], r.integers(0, 2**63, n // 9).astype(np.uint64)])
        x, y = (np.frombuffer(m.signature(t), np.uint8)[None] for t in (a, b))
        size = min(x.shape[1], y.shape[1])
        differ = int(np.bitwise_count(m.folded(x, size) ^ m.folded(y, size)).sum())
        assert differ <= len(np.setxor1d(a, b)) and (n > 100) <= (differ > 0)


def test_prefixes_of_similar_sets_always_meet():
    import numpy as np

    r = np.random.default_rng(0)
    words = np.sort(r.integers(0, 2**63, 50).astype(np.uint64))
    orders = m.Orders(2, 80, words[:30], r.integers(0, 90, 30).astype(np.uint64))
    met = 0
    for _ in range(400):
        a = r.choice(words, r.integers(2, 60))
        b = a.copy()
        for _ in range(r.integers(0, 4)):
            b[r.integers(len(b))] = r.choice(words)
        (sa, pa_), (sb, pb) = orders.prefixes(a), orders.prefixes(b)
        both = len(np.intersect1d(sa, sb))
        if 100 * both >= 80 * (len(sa) + len(sb) - both):
            met += 1
            assert all(len(np.intersect1d(x, y)) for x, y in zip(pa_, pb))
    assert met > 50


def test_odd_rows(odd_frame):
    df = odd_frame(["a b c d", "same text", "A  b\tc d", None, "", "x " * 90_000])
    rows = m.ngram_join(df, 3, 90).collect()
    assert len(rows) == df.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert by[0] == [(2, 0)] and by[2] == [(2, 0)] and by[3] == [(0, 3)] and by[4] == [(0, 4)] and by[1] == [(1, 1)] * 3 and by[5] == [(1, 5)]
    assert m.ngram_join(df.limit(0), 3, 90).count() == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(50)] + [(5, 5)]
    got = {x.node: x.comp for x in base.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {v: v for e in edges for v in e}
    for _ in range(len(edges)):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    loops = {v for v in up if all(a == b for a, b in edges if v in (a, b))}
    assert got == {v: c for v, c in up.items() if v not in loops}


def test_pairs_of_a_near_group_are_no_rows(frame, spark, monkeypatch):
    """Many texts that are near each other, none of them a link: rows grow with the members, not with the pairs."""
    r = random.Random(4)
    base_ = [f"v{i}" for i in range(150)]
    texts = []
    for _ in range(60):
        w = list(base_)
        for p in r.sample(range(150), 2):
            w[p] = f"x{r.random()}"
        texts.append(" ".join(w))
    written, own = {}, m.materialize

    def count(df, name="step"):
        out = own(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(m, "materialize", count)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in m.ngram_join(frame(texts, 3), 5, 80).collect()}
    assert got == brute(texts, 5, 80)
    assert written["rest"] < 2 * len(texts) and written["pairs"] <= len(texts) and "near" in written
