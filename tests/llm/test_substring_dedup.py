import hashlib
import random

import numpy as np
import pytest

from sluice.llm import substring_dedup as m


def brute(texts, length=m.LENGTH):
    seen = {}
    out = {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = True
            else:
                seen[s] = i
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcde é") for _ in range(r.randint(1, 9))) for _ in range(200)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared = [text(k) for k in (25, 40, 80, 30)]
    out = []
    for _ in range(n):
        t = text(r.randint(1, 60))
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randrange(len(s) // 2)
            t += r.choice(["", " ", "x"]) + s[a : len(s) - r.randrange(20)] + text(r.randint(0, 10))
        out.append(t)
    out += [out[3], out[7] + out[8], out[9][5:], "ab" * 300, "ab" * 200 + "c", "a" * 1000, "a" * 99, "a" * 100, "Oi Oi " * 90]
    return out


def got(df, length=m.LENGTH):
    return {r.doc_id: tuple(r)[1:] for r in m.substring_dedup(df, length).collect()}


@pytest.mark.parametrize("seed, parts, length", [(1, 1, 100), (2, 6, 100), (3, 4, 40)])
def test_against_brute_force(frame, prose, seed, parts, length):
    texts = corpus(seed) + prose(30, seed)
    assert got(frame(texts, parts), length) == brute(texts, length)


def test_parts_and_long_texts(frame, monkeypatch):
    monkeypatch.setattr(m, "PART", 3)
    monkeypatch.setattr(m, "PIECE", 700)
    monkeypatch.setattr(m, "ARRAY_BYTES", 2000)
    monkeypatch.setattr(m, "BUCKET_BYTES", 300)
    texts = corpus(5, 40)
    assert got(frame(texts, 5)) == brute(texts)


def test_neighbours_and_factors():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 50):
        v = r.integers(0, max(1, n), n)
        before, after = m.smaller_neighbours(v)
        for i in range(n):
            assert before[i] == max([j for j in range(i) if v[j] < v[i]], default=-1)
            assert after[i] == min([j for j in range(i + 1, n) if v[j] < v[i]], default=n)
    text = r.integers(97, 99, 400).astype(np.uint8)
    raw = text.tobytes()
    own = np.arange(400 - 16)
    order, lcp = m.suffix_order(text, own, 16)
    assert [raw[i : i + 16] for i in own[order]] == sorted(raw[i : i + 16] for i in own)
    position = r.permutation(len(own))
    longest = m.longest_previous(position, order, lcp)
    for i in own:
        want = any(raw[i : i + 16] == raw[j : j + 16] and position[j] < position[i] for j in own)
        assert (longest[i] == 16) == want


def test_odd_rows(odd_frame):
    r = random.Random(1)
    long = "".join(r.choice("abcdefgh ") for _ in range(300))
    df = odd_frame([long, long + "x", None, "", "y" + long])
    rows = m.substring_dedup(df, keep_bytes=True).collect()
    assert len(rows) == df.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.n_removed, bytes(r.kept)))
    assert by[0] == [(0, long.encode())] and by[1] == [(300, b"x")] * 3 and by[4] == [(300, b"y")] and by[2] == by[3] == [(0, b"")]
    assert m.substring_dedup(df.limit(0)).count() == 0
