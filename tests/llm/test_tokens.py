import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from sluice.llm import base, packing, repair, tokens

WORDS, BYTES = (public_tokenizers.path(f"{x}.json") for x in ("word_bpe_49k", "byte_bpe_50k"))
HARD = ["un.\nLe mot\nsuit", "a  b", " a", "a ", "\n\n x", "word\n next \n more", "it's  'tis 's", "x   y", "é ́x", "a　b c", "tab\tz  \t", "Σ ΑΣ ς", "<|endoftext|> a", "1234 5 6,7", "a\0b \0 c", "İ I i", "🙂 🙂🙂", "x" * 500 + " y"]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_chunks_equal_the_library(path, prose):
    texts = prose() + HARD
    texts = [t or "" for t in texts]
    library = Tokenizer.from_file(path)
    for _ in range(2):
        for t, ids in zip(texts, tokens.tokenizer(path).encode_batch(texts)):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t[:80]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_lone_line_breaks_and_long_texts(path):
    r = random.Random(2)
    loose = ["word", "un", ".", " ", "\n", "\n", "é", "日本", "🙂", "'s", "1", "12", ",", "B!", "\t"]
    plain = ["word", "un", ". ", " ", "\nLe", "\n", "é", "日本", " 🙂", " it's", " 12", ", ", "\na", " B!", "\n.", "\n12"]
    texts = ["un.\nLe", "a\nb", "\n", "a\n", "\na", "end.\n.\n"]
    texts += ["".join(r.choice(loose) for _ in range(r.randint(1, 60))) for _ in range(1500)]
    texts += ["x" + "".join(r.choice(plain) for _ in range(r.randint(1, 60))) + "y" for _ in range(1500)]
    texts += pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    words = ["".join(r.choice(plain[:14]).strip() or "z" for _ in range(3)) for _ in range(3000)]
    texts.append("x".join(r.choice(words) + r.choice(" \n") for _ in range(500_000)) + "y")  # above 4 MB, through pieces
    assert len(texts[-1].encode()) > 4 << 20
    library = Tokenizer.from_file(path)
    for t, ids in zip(texts, tokens.ChunkTokenizer(path).encode_column(pa.array(texts, pa.string())), strict=True):
        assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids, (t or "")[:80]


def test_workers_keep_nothing_of_another_stage():
    """A tokenizer and its memo serve the tasks of one function; the next function's tasks begin without them."""
    path, seen = BYTES, []

    def encodes(batches):
        seen.append(tokens.tokenizer(path))
        seen[-1].encode_batch(["some words"])
        yield from batches

    def another(batches):
        seen.append((dict(tokens._tokenizers), dict(base._powers)))
        yield from batches

    for f in (encodes, encodes, another):
        assert list(base.tidy(f)(iter([1]))) == [1]
    assert seen[0] is seen[1] and seen[2] == ({}, {})


def test_packing(frame, prose):
    texts = prose() + HARD
    library = Tokenizer.from_file(BYTES)
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    for parts in (1, 5, 40):
        docs, seqs = defaultdict(list), defaultdict(list)
        for r in packing.pack(frame(texts, parts), BYTES, size=64, open_windows=3, keep_ids=True).collect():
            docs[r.doc_id].append(r)
            seqs[r.sequence_id].append(r)
            part = np.frombuffer(r.ids, "<u4").tolist()
            assert part == ids[r.doc_id][r.start : r.start + r.length] and r.length == len(part) and r.doc_tokens == len(ids[r.doc_id])
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        for i, own in ids.items():
            at = 0
            for r in sorted(docs[i], key=lambda r: r.start):
                assert r.start == at
                at += r.length
            assert at == len(own)
        sizes = []
        for rows in seqs.values():
            at = 0
            for r in sorted(rows, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            sizes.append(at)
        short = [s for s in sizes if s != 64]
        assert len(short) == len(set(short)) and all(s & (s - 1) == 0 and s < 64 for s in short)


def test_packing_odd_rows(odd_frame):
    df = odd_frame(["a b", "same text", None, ""])
    rows = packing.pack(df, BYTES).collect()
    assert sum(r.doc_id == 1 and r.start == 0 for r in rows) == 3
    assert packing.pack(df.limit(0), BYTES).count() == 0


def test_grammar_files(frame, prose, tmp_path):
    texts = prose() + HARD
    folder = f"file://{tmp_path}"
    library = Tokenizer.from_file(WORDS)
    shards = repair.write_shards(frame(texts, 4), folder, WORDS, shard_ids=4000)
    got = sorted(repair.read_shards(shards, folder, keep_ids=True).collect())
    at = 0
    for (i, t), r in zip(enumerate(texts), got, strict=True):
        own = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(own))
        assert np.frombuffer(r.ids, "<u4").tolist() == own and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        at += len(own)


def test_grammar_random_access():
    r = np.random.default_rng(3)
    docs = [np.append(r.zipf(1.5, n) % 50 + 2, 1).astype(np.uint32) for n in (0, 1, 500, 3000, 2)]
    data = repair.shard_bytes([4, None, 6, 7, 8], docs, 60, 1)
    shard = repair.Shard(data)
    assert len(shard.symbols) < 0.7 * sum(map(len, docs))
    for k, d in enumerate(docs):
        assert shard.document(k).tolist() == d.tolist()
        for a, b in ((0, 1), (0, len(d)), (len(d) // 3, len(d) // 2), (5, 400), (len(d), len(d) + 3)):
            assert shard.ids(k, a, b).tolist() == d[a:b].tolist(), (k, a, b)
    assert shard.null_ids.tolist() == [0, 1, 0, 0, 0]


def frequent_pairs(symbols, barrier):
    """Occurrences that do not overlap, left to right, of each pair without a barrier."""
    n, last = defaultdict(int), {}
    for i, x in enumerate(zip(symbols, symbols[1:])):
        if barrier not in x and not (x[0] == x[1] and last.get(x) == i - 1):
            n[x] += 1
            last[x] = i
    return {x for x, k in n.items() if k >= repair.FREQUENT}


def test_grammar_leaves_no_frequent_pair():
    r = np.random.default_rng(4)
    passage = r.integers(2, 3000, 700)
    parts = [x for _ in range(60) for x in (passage, np.full(r.integers(1, 90), 5), r.zipf(1.3, 400) % 2000 + 2, [1])]
    ids = np.concatenate(parts).astype(np.uint32)
    for own in (ids, np.append(np.full(1000, 7), 1).astype(np.uint32), ids[:0], ids[:1], ids[:40]):
        symbols, rules = repair.compress(own, 3000, 1)
        assert len(rules) < repair.SYMBOLS - 3000 and not frequent_pairs(symbols.tolist(), 1)
        whole = {}
        for k, (a, b) in enumerate(rules.tolist()):
            whole[3000 + k] = whole.get(a, [a]) + whole.get(b, [b])
        assert [x for y in symbols.tolist() for x in whole.get(y, [y])] == own.tolist()
    symbols, rules = repair.compress(ids, 3000, 1)
    assert repair.lengths_of(rules, 3000).max() > 500


def test_grammar_odd_rows(odd_frame, tmp_path):
    df = odd_frame(["a b", "same text", None, ""])
    folder = f"file://{tmp_path}/x"
    rows = repair.read_shards(repair.write_shards(df, folder, WORDS), folder).collect()
    assert len(rows) == 8 and sorted(r.start for r in rows)[0] == 0
    assert sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)
    folder = f"file://{tmp_path}/y"
    assert repair.read_shards(repair.write_shards(df.limit(0), folder, WORDS), folder).count() == 0


def test_bare_words_equal_the_library():
    """Chunks of plain letters, signs and digits go to the merges alone; all others to the whole library."""
    library, own = Tokenizer.from_file(WORDS), tokens.ChunkTokenizer(WORDS)
    assert own.bare and not tokens.ChunkTokenizer(BYTES).bare
    r = random.Random(7)
    letters = [chr(c) for c in [*range(0x21, 0x7F), *range(0xA0, 0x100)]] + list("  \n\n'''aZéÉ12İΣςǅ日🙂²½Ÿſ\x01\x7f") + ["é"]
    parts = ["'s", "'LL", "É", "ß", "ÿ", "×", "÷", "12", " ", "\n", " A", " .", "!!", "</w>", "<", "|", ">", "THE", " ü.", "a."]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    texts += ["x".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(4000)]
    texts += [f"a{c}b {c}. x{c}1 {c}{c}" for c in map(chr, range(1, 0x3000))]
    for t, ids in zip(texts, own.encode_batch(texts), strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_plain_chunks_take_the_merges_only(monkeypatch):
    """The library's own steps cost most of the time of a new word; plain words do not pass them."""
    monkeypatch.setattr(tokens.ChunkTokenizer, "_learn", lambda self, chunks: pytest.fail(f"{chunks[:3]}"))
    own, library = tokens.ChunkTokenizer(WORDS), Tokenizer.from_file(WORDS)
    texts = ["Ünder the Façade, 12 mots.\nÀ suivre!!", "x" * 300 + " y$$$ " + "é" * 300] * 2
    for t, ids in zip(texts, own.encode_batch(texts), strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids


def test_rounds_replace_the_same_pairs():
    """A round's pairs are those of a plain count, the most frequent first; the next rounds follow from them."""
    r = np.random.default_rng(3)
    ids = np.concatenate([r.zipf(1.3, 20_000) % 500 + 2, [7] * 101, [1], [7] * 40, [1, 1]]).astype(np.uint32)
    ids[r.integers(0, len(ids), 300)] = 1
    symbols, rules = repair.compress(ids, 3000, 1)
    s, want = ids.tolist(), []
    while True:
        n, at, i = defaultdict(int), [], 0
        while i < len(s) - 1:
            if s[i] != 1 and s[i + 1] != 1:
                n[s[i], s[i + 1]] += 1
                at.append(i)
                if i + 2 < len(s) and s[i] == s[i + 1] == s[i + 2]:  # the next pair of the run overlaps
                    i += 1
            i += 1
        lefts, rights, new = set(), set(), {}
        for a, b in sorted((x for x in n if n[x] >= repair.FREQUENT), key=lambda x: (-n[x], x)):
            if a not in rights and b not in lefts:
                lefts.add(a)
                rights.add(b)
                new[a, b] = 3000 + len(want) + len(new)
        if not new:
            break
        gone = set()
        for i in at:
            if (s[i], s[i + 1]) in new:
                gone.add(i)
        s = [new[s[i], s[i + 1]] if i in gone else x for i, x in enumerate(s) if i - 1 not in gone]
        want += new
    assert symbols.tolist() == s and [tuple(x) for x in rules.tolist()] == want and len(want) > 100


def test_equal_chunks_share_a_key():
    """Keys depend on the bytes of a chunk only, wherever it stands; plain chunks of a word share one in any case."""
    r = random.Random(11)
    words = list({bytes(r.choices(b"ab\xc3\xa9", k=r.randint(1, 60))) for _ in range(3000)} | {b"x" * n for n in range(1, 60)})
    seen = {}
    for own in (words, words[::-1], words[:1], words[1::7]):
        body, size = np.frombuffer(b"".join(own), np.uint8), np.array([len(w) for w in own])
        stop = np.cumsum(size)
        for w, key in zip(own, tokens.chunk_keys(body, stop - size, stop).tolist(), strict=True):
            assert seen.setdefault(w, key) == key
    assert len({tuple(k) for k in seen.values()}) == len(words)
    one = tokens.ChunkTokenizer(WORDS)
    one.encode_batch(["Été été ÉTÉ\nété", "J̌a ǰa"])
    assert one.memo.n == 4  # of which a line break, and two that are not plain
