import hashlib
from collections import defaultdict

import pytest

from sluice.llm import exact_dedup as m


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        norm = "".join(c for c in t or "" if c not in " \t\n\v\f\r")
        groups[norm].append((-len(t or ""), i))
    out = {}
    for norm, members in groups.items():
        for _, i in members:
            out[i] = (min(members)[1], len(members), i == min(members)[1], hashlib.sha256(norm.encode()).hexdigest())
    return out


def test_against_brute_force(frame, prose):
    texts = prose() + ["a b", "ab", "a  b ", " "]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in m.exact_dedup(frame(texts, 7)).collect()}
    assert got == brute(enumerate(texts))


@pytest.mark.parametrize("bits", [8, 16])
def test_bytes_decide_when_digests_collide(frame, prose, bits):
    texts = prose(200)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in m.exact_dedup(frame(texts, 5), digest_bits=bits).collect()}
    assert got == {k: v[:3] for k, v in brute(enumerate(texts)).items()}


def test_small_memtables_give_the_same(frame, prose, monkeypatch):
    monkeypatch.setattr(m, "MEMTABLE_ROWS", 3)
    texts = prose()
    assert {r.doc_id: r.keep_id for r in m.exact_dedup(frame(texts)).collect()} == {k: v[0] for k, v in brute(enumerate(texts)).items()}


def test_odd_rows_and_empty(odd_frame):
    df = odd_frame(["a b", "same text", "a b ", None, ""])
    rows = m.exact_dedup(df).collect()
    assert len(rows) == 9
    same = [r for r in rows if r.doc_id == 1]
    assert len(same) == 3 and sum(r.kept for r in same) == 1 and {r.group_size for r in same} == {3}
    blank = [r for r in rows if r.keep_id == 3]
    assert {r.doc_id for r in blank} == {3, 4, None} and sum(r.kept for r in blank) == 1
    assert m.exact_dedup(df.limit(0)).count() == 0
