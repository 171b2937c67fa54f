import random
import re

import pytest

from sluice.llm import license_scan as m


def words(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_alignment():
    r = random.Random(1)
    for _ in range(300):
        b = [r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(1, 25))]
        a = list(b)
        for _ in range(r.randint(0, 8)):
            k = r.randrange(len(a) + 1)
            a[k : k + r.randint(0, 2)] = [r.choice("abcdefghijxyz")] * r.randint(0, 2)
        pairs = m.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        assert len(pairs) <= lcs(a, b)
        if a == b:
            assert len(pairs) == len(b)
        x, y = r.sample(range(30), 20), r.sample(range(30), 20)  # no word twice: the anchors alone are a longest common subsequence
        assert len(m.align(x, y)) == lcs(x, y)


def test_longest_increasing():
    r = random.Random(2)
    for _ in range(200):
        p = [(x, j) for j, x in enumerate(r.sample(range(30), r.randint(0, 9)))]
        got = m.increasing(p)
        subsets = [[x for i, (x, _) in enumerate(p) if k >> i & 1] for k in range(1 << len(p))]
        best = max(len(x) for x in subsets if x == sorted(x))
        assert len(got) == best and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(frame, prose, seed):
    r = random.Random(seed)
    texts = prose(20, seed)
    for name, t in m.TEMPLATES:
        for cut in (0, 0.1, 0.15, 0.3):
            w = t.split()
            for _ in range(int(cut * len(w))):
                w[r.randrange(len(w))] = r.choice(["other", "words", "the"])
            lead = " ".join(r.choice(["some", "the", "of", "text", "license"]) for _ in range(r.randint(0, 300)))
            texts.append(f"{lead}\n{' '.join(w).upper() if r.random() < 0.3 else ' '.join(w)}\n{lead}")
    got = {}
    for x in m.scan_licenses(frame(texts, 4)).collect():
        got[x.doc_id, x.license] = (x.aligned, x.words)
        own = words(texts[x.doc_id])
        assert own[x.start] in words(dict(m.TEMPLATES)[x.license]) and x.stop <= len(own)
    want = {}
    for d, t in enumerate(texts):
        own = words(t)
        for name, text in m.TEMPLATES:
            b = words(text)
            s = max(16, len(b))
            must, never = map(words, m.TELLING.get(name, ("", "")))
            n = 0
            for i in range(0, len(own), s):
                pairs = m.align(own[i : i + 2 * s], b)
                assert len(pairs) <= lcs(own[i : i + 2 * s], b) if len(b) < 20 else True
                if pairs and all(b.index(w) in [q for _, q in pairs] and b.count(w) == sum(b[q] == w for _, q in pairs) for w in must):
                    if not set(never) & set(own[i + pairs[0][0] : i + pairs[-1][0] + 1]):
                        n = max(n, len(pairs))
            if 100 * n >= 80 * len(b):
                want[d, name] = (n, len(b))
    assert got == want and {k for _, k in want} == {k for k, _ in m.TEMPLATES}


def test_clean_texts_and_odd_rows(odd_frame, frame, prose):
    assert m.scan_licenses(frame(prose(100))).count() == 0
    df = odd_frame(["Released under the MIT License.", "same. released under THE mit-license", None, "", "x " * 200_000])
    rows = [(r.doc_id, r.license, r.start, r.stop) for r in m.scan_licenses(df).collect()]
    assert sorted(rows) == [(0, "MIT-notice", 0, 5)] + [(1, "MIT-notice", 1, 6)] * 3
    assert m.scan_licenses(df.limit(0)).count() == 0 and m.scan_licenses(df, []).count() == 0


SENTENCES = [
    ("Released under the BSD License.", {"BSD-notice"}),
    ("Licensed under CC BY-SA 4.0.", {"CC-BY-SA-4.0-notice"}),
    ("This text is licensed under CC BY 4.0.", {"CC-BY-4.0-notice"}),
    ("Licensed under CC BY-NC 4.0.", {"CC-BY-NC-4.0-notice"}),
    ("Licensed under CC BY-NC-SA 4.0.", {"CC-BY-NC-SA-4.0-notice"}),
    ("Licensed under CC BY-NC-ND 4.0.", set()),
    ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0-notice"}),
    ("This work is licensed under the GNU General Public License, version 3.", {"GPL-3.0-notice"}),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", {"LGPL-3.0-notice"}),
    ("This work is licensed under the GNU Affero General Public License, version 3.", {"AGPL-3.0-notice"}),
    ("Licensed under the Eclipse License, Version 2.0.", {"EPL-2.0-notice"}),
    ("Licensed under the Mozilla Public License, Version 2.0.", {"MPL-2.0-notice"}),
    ("Licensed under the Apache License, Version 2.0.", {"Apache-2.0-notice"}),
    ("Licensed under the Apache License, Version 1.1.", set()),
    ("Licensed under the Example License, Version 2.0.", set()),
    ("Released under the Example License.", set()),
    ("RELEASED under the\n# MIT license", {"MIT-notice"}),
]


def test_the_license_that_is_named(frame):
    got = {i: set() for i in range(len(SENTENCES))}
    for x in m.scan_licenses(frame([t for t, _ in SENTENCES])).collect():
        got[x.doc_id].add(x.license)
    assert [got[i] for i in range(len(SENTENCES))] == [w for _, w in SENTENCES]


def test_gaps_of_any_size(frame):
    """No word is unique in doubled lines, so there is no anchor, and a window has more than 10,000 cells."""
    w = dict(m.TEMPLATES)["MIT"].split()
    lines = [" ".join(w[i : i + 9]) for i in range(0, len(w), 9)]
    texts = ["\n".join(f"- {x}\n+   {x}" for x in lines), "A short title\n" + "\n".join(f"{x}\n{x}" for x in lines)]
    got = {x.doc_id: (x.aligned, x.words) for x in m.scan_licenses(frame(texts)).collect() if x.license == "MIT"}
    assert got[0][0] >= 86 and got[1][0] >= 86 and got[0][1] == 87
    r = random.Random(5)
    for size in (3, 40, 150):
        for _ in range(10):
            a, b = ([r.choice("abcd") for _ in range(r.randint(0, 2 * size))] for _ in range(2))
            pairs = m.common(a, b)
            assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
            assert len(pairs) == lcs(a, b)
