"""Token ids by the public tokenizers, with a bounded memo of chunks.

Both vocabularies used here split a text into pre-tokens before any merge, and no pre-token extends over the beginning
of a single space, or over a single line break, that stands between two characters that are not white space, nor over
the end of a word and a mark behind it. These therefore cut the text into chunks whose ids do not depend on each other:
each distinct chunk is sent through the tokenizers library once and its ids are reused. Chunks are found, keyed
(128 bits) and looked up by numpy over the bytes of many texts at once. Texts with any other white space around a cut,
or with special tokens, go through the library whole.

For the word vocabulary, what the library does to a text before its merges is simple where all letters are those of
ASCII and U+00C0 to U+00FF: numpy does it for many chunks at once (``BareWords``), and the library only merges.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallelism

from tokenizers import Tokenizer, pre_tokenizers  # noqa: E402

from .base import CHUNK_BYTES, U64, kept, mix, powers, row_groups, text_bytes  # noqa: E402

#: Distinct chunks whose ids are remembered; beyond it the memo starts anew.
MEMO = 1_000_000
#: Bytes of texts whose chunks are found at once.
GROUP_BYTES = 1 << 18
#: New chunks sent through the library in one text, and to its merges only.
JOINED, BARE = 500, 2000
_BASES = tuple((b, pow(b, -1, 2**64)) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))

_SPACE, _BREAK, _MARK, _LETTER, _ODD, _LEAD = 1, 2, 4, 8, 16, 32
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord(" ")], _CLASS[ord("\n")] = _SPACE, _BREAK
_CLASS[list(b".,;:!?")] = _MARK
_CLASS[list(range(65, 91)) + list(range(97, 123))] = _LETTER
_CLASS[[0, 9, 11, 12, 13, 28, 29, 30, 31]] = _ODD
_CLASS[[0xC2, 0xE1, 0xE2, 0xE3]] = _LEAD
_OTHER_SPACES = np.unique(np.array([int.from_bytes(c.encode().ljust(3, b"\0")[:3], "big") for c in map(chr, range(128, 0x3001)) if c.isspace()], np.uint32))

#: Steps before the merges that ``BareWords`` can take over.
_WORD_STEPS = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
)
#: Sorts of bytes in a pre-token. Letters are those of ASCII and, as two bytes, U+00C0 to U+00FF without the two signs among
#: them; an apostrophe may begin an ending such as 's.
_GAP, _WORD, _SIGN, _DIGIT, _HARD = range(5)
_SORT = np.full(256, _HARD, np.uint8)
_SORT[0x21:0x7F], _SORT[ord("'")] = _SIGN, _HARD
_SORT[0x30:0x3A] = _DIGIT
_SORT[list(b" \n")] = _GAP
_SORT[(_CLASS & _LETTER) != 0] = _SORT[0xC3] = _WORD
_SORT[0x80:0xC0], _SORT[[0x97, 0xB7]] = _WORD, _HARD
#: The character by which the vocabulary writes each byte, the same with white space as a space, and lower-case bytes.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_CHARACTER = np.zeros(256, np.uint16)
_CHARACTER[_PRINTED] = _PRINTED
_CHARACTER[[x for x in range(256) if x not in _PRINTED]] = np.arange(256, 512 - len(_PRINTED))
_CHARACTER_OR_SPACE = _CHARACTER.copy()
_CHARACTER_OR_SPACE[list(b" \n")] = 0x20
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[0x41:0x5B] += 0x20
_LOWERED[0x80:0x9F] += 0x20

_tokenizers: dict[str, ChunkTokenizer] = {}
kept.append(_tokenizers)


#: The lowest 0 to 8 bytes of a word.
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def chunk_keys(body: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of each chunk, two words: exact up to 16 bytes, which have no byte 0; hashes of longer ones."""
    size = end - begin
    padded = np.zeros(len(body) + 16, np.uint8)
    padded[: len(body)] = body
    word = np.ndarray(len(body) + 9, "<u8", padded, strides=(1,))
    key = np.empty((len(begin), 2), U64)
    key[:, 1] = mix(word[begin + 8] & _LOWEST[np.clip(size - 8, 0, 8)])
    key[:, 0] = mix((word[begin] & _LOWEST[np.minimum(size, 8)]) ^ key[:, 1])
    long = np.flatnonzero(size > 16)
    if len(long):
        size = size[long]
        stop = np.cumsum(size)
        at, n = stop - size, int(stop[-1])
        text = body[np.repeat(begin[long] - at, size) + np.arange(n)].astype(U64) + U64(1)
        total = np.zeros(n + 1, U64)
        with np.errstate(over="ignore"):
            for c, (base, inverse) in enumerate(_BASES):
                np.cumsum(text * powers(base, n), out=total[1:])
                key[long, c] = mix((total[stop] - total[at]) * powers(inverse, n)[at] + size.astype(U64))
    return key


class Memo:
    """128-bit chunk key -> ids, as arrays: an open-addressing table over one flat array of ids."""

    def __init__(self, most: int):
        self.bits = max(10, (2 * most).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.key = np.zeros((1024, 2), U64)
        self.at, self.n = np.zeros(1025, np.int64), 0
        self.flat = np.zeros(4096, np.uint32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Entry numbers, -1 where unknown."""
        out = np.full(len(key), -1, np.int64)
        open_ = np.arange(len(key))
        slot = (key[:, 0] >> U64(64 - self.bits)).astype(np.int64)
        while len(open_):
            entry = self.slots[slot]
            own = key[open_]
            there = entry >= 0
            known = self.key[entry]
            same = there & (known[:, 0] == own[:, 0]) & (known[:, 1] == own[:, 1])
            out[open_[same]] = entry[same]
            on = there & ~same
            open_, slot = open_[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, key: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Distinct unknown keys; their ids one after the other, and the numbers of these."""
        first, n = self.n, self.n + len(key)
        if n > len(self.key):
            self.key = np.concatenate([self.key, np.zeros((max(n, 2 * len(self.key)) - len(self.key), 2), U64)])
            self.at = np.concatenate([self.at, np.zeros(len(self.key) + 1 - len(self.at), np.int64)])
        self.key[first:n] = key
        self.at[first + 1 : n + 1] = self.at[first] + np.cumsum(size)
        if self.at[n] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(self.at[n], 2 * len(self.flat)) - len(self.flat), np.uint32)])
        self.flat[self.at[first] : self.at[n]] = ids
        self.n = n
        entry = np.arange(first, n)
        slot = (key[:, 0] >> U64(64 - self.bits)).astype(np.int64)
        while len(entry):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entry[free]
            on = self.slots[slot] != entry
            entry, slot = entry[on], (slot[on] + 1) & ((1 << self.bits) - 1)

    def gather(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries one after the other, and their numbers."""
        n = self.at[entry + 1] - self.at[entry]
        stop = np.cumsum(n)
        return self.flat[np.repeat(self.at[entry] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)], n


class BareWords:
    """Ids of chunks of plain letters, signs and digits by the merges of the library's own model alone.

    Such a chunk is its own composed form; its pre-tokens are runs of letters, runs of signs, and single digits. They are
    lower-cased (``same``), written in the vocabulary's characters and parted by spaces here. Each ends in the one id whose token
    has the suffix of a word's end, so no offsets are needed.
    """

    def __init__(self, library: Tokenizer, suffix: str):
        self.library = Tokenizer(library.model)  # the same model, not a copy
        self.library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = library.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True

    @staticmethod
    def of(library: Tokenizer) -> BareWords | None:
        """None where the library takes other steps, or lacks a byte."""
        normal, pre = (json.loads(x.__getstate__()) if x else {} for x in (library.normalizer, library.pre_tokenizer))
        if (normal.get("normalizers"), pre.get("pretokenizers")) != _WORD_STEPS or library.post_processor:
            return None
        model = library.model
        suffix = getattr(model, "end_of_word_suffix", None)
        if not suffix or model.dropout or model.continuing_subword_prefix or model.ignore_merges:
            return None
        letters = [chr(c) + x for c in _CHARACTER for x in ("", suffix)]
        return None if any(model.token_to_id(x) is None for x in letters) else BareWords(library, suffix)

    @staticmethod
    def same(body: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which chunks are plain; the bytes with these in lower case, and beginnings without the space before a word:
        plain chunks that are equal then have the same ids."""
        hard = np.zeros(len(body) + 1, np.int64)
        np.cumsum(_SORT[body] == _HARD, out=hard[1:])
        plain = hard[end] == hard[begin]
        lowered = np.where(np.repeat(plain, end - begin), _LOWERED[body], body)
        return plain, lowered, begin + (plain & (body[begin] == 0x20) & (end - begin > 1))

    def learn(self, body: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain chunks in lower case one after the other, and their numbers."""
        size = end - begin
        text = body[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        stop = np.cumsum(size)
        sort = _SORT[text]
        fresh = sort == _DIGIT
        fresh[1:] |= sort[1:] != sort[:-1]
        fresh[stop - size] = True
        fresh &= sort != _GAP
        # a space before each pre-token
        to = np.arange(len(text)) + np.cumsum(fresh)
        spaced = np.full(len(text) + int(fresh.sum()), 0x20, np.uint16)
        spaced[to] = _CHARACTER_OR_SPACE[text]
        to = np.concatenate([[0], to[stop - 1] + 1])
        words = np.diff(np.concatenate([[0], np.cumsum(fresh)])[np.concatenate([[0], stop])])
        ids, count = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(size), BARE):
            own = words[i : i + BARE]
            part = spaced[to[i] : to[i + len(own)]].tobytes().decode("utf-16-le")
            ids.append(np.array(self.library.encode_batch_fast([part], add_special_tokens=False)[0].ids, np.uint32))
            done = np.concatenate([[0], np.flatnonzero(self.last[ids[-1]]) + 1])
            if len(done) != own.sum() + 1 or done[-1] != len(ids[-1]):
                raise ValueError("the ids of words cannot be told apart")
            count.append(np.diff(done[np.concatenate([[0], np.cumsum(own)])]))
        return np.concatenate(ids), np.concatenate(count)


class ChunkTokenizer:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, most: int = MEMO):
        self.library, self.most = Tokenizer.from_file(path), most
        self.memo = Memo(most)
        self.bare = BareWords.of(self.library)
        ids, begin = self._encode("a\na")
        self.line_break = ids[np.searchsorted(begin, 1) : np.searchsorted(begin, 2)]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        return list(self.encode_column(pa.array(texts, pa.string())))

    def encode_column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each row in order; a null row is empty."""
        body, at = text_bytes(column)
        for i, j in row_groups(at, GROUP_BYTES):
            part, own = body[at[i] : at[j]], at[i : j + 1] - at[i]
            if j - i == 1 and len(part) > 4 * CHUNK_BYTES:
                yield self._long(part)
                continue
            yield from self._group(part, own)

    def _long(self, part: np.ndarray) -> np.ndarray:
        """One very long text, in pieces that begin at a cut."""
        if not self._plain(part, np.array([0, len(part)]))[0]:
            return self._whole(part)
        cuts = [0]
        while len(part) - cuts[-1] > 2 * CHUNK_BYTES:
            here = np.flatnonzero(part[cuts[-1] + CHUNK_BYTES :][:CHUNK_BYTES] == 32)
            if not len(here):
                return self._whole(part)
            cuts.append(cuts[-1] + CHUNK_BYTES + int(here[0]))
        return np.concatenate([self._chunks(part[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts, [*cuts[1:], len(part)])])

    def _whole(self, part: np.ndarray) -> np.ndarray:
        return np.array(self.library.encode(part.tobytes().decode(), add_special_tokens=False).ids, np.uint32)

    def _plain(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which rows have single spaces and line breaks inside as their only white space, and no special token."""
        n, rows = len(body), len(at) - 1
        bad = np.zeros(n + 1, bool)
        kind = _CLASS[body]
        cut = (kind & (_SPACE | _BREAK)) != 0
        bad[:n] |= kind == _ODD
        bad[1:n] |= cut[1:] & cut[:-1]
        bad[: n - 1] |= (body[:-1] == 0x3C) & (body[1:] == 0x7C)
        lead = np.flatnonzero(kind == _LEAD)
        if len(lead):
            b = [np.where(lead + k < n, body[np.minimum(lead + k, n - 1)], 0).astype(np.uint32) for k in range(3)]
            code = np.where(b[0] == 0xC2, (b[0] << 16) | (b[1] << 8), (b[0] << 16) | (b[1] << 8) | b[2])
            bad[lead[np.isin(code, _OTHER_SPACES)]] = True
        full = at[:-1] < at[1:]
        bad[at[:-1][full]] |= cut[at[:-1][full]]
        bad[at[1:][full] - 1] |= cut[at[1:][full] - 1]
        total = np.concatenate([[0], np.cumsum(bad[:n])])
        return total[at[1:]] == total[at[:rows]]

    def _group(self, body: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        plain = self._plain(body, at) if len(body) else np.ones(len(at) - 1, bool)
        if plain.all():
            yield from self._chunks(body, at)
            return
        size = np.diff(at)
        mine = np.concatenate([[0], np.cumsum(size[plain])])
        found = iter(self._chunks(body[np.repeat(plain, size)], mine))
        for k, ok in enumerate(plain.tolist()):
            yield next(found) if ok else self._whole(body[at[k] : at[k + 1]])

    def _chunks(self, body: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Ids of plain rows."""
        n = len(body)
        if not n:
            return [np.zeros(0, np.uint32) for _ in at[1:]]
        kind = _CLASS[body]
        start = np.zeros(n + 1, bool)
        start[at] = True
        brk = kind == _BREAK
        cut = (kind == _SPACE) | brk
        mark = (kind[1:] == _MARK) & (kind[:-1] == _LETTER)
        mark[:-1] &= cut[2:] | start[2:n]
        start[:n] |= cut
        start[1 : n + 1] |= brk
        start[1:n] |= mark
        begin = np.flatnonzero(start[:n])
        end = np.append(begin[1:], n)
        at = np.searchsorted(begin, at)
        if self.bare:
            plain, body, begin = self.bare.same(body, begin, end)
        key = chunk_keys(body, begin, end)
        if self.memo.n > self.most:
            self.memo = Memo(self.most)
        entry = self.memo.find(key)
        while len(miss := np.flatnonzero(entry < 0)):
            _, first = np.unique(key[miss, 0] ^ (key[miss, 1] << U64(1)), return_index=True)
            first = miss[first]
            if self.bare:
                own = first[plain[first]]
                self.memo.add(key[own], *self.bare.learn(body, begin[own], end[own]))
                first = first[~plain[first]]
            if len(first):
                raw = body.tobytes()
                own = self._learn([raw[a:b].decode() for a, b in zip(begin[first].tolist(), end[first].tolist())])
                self.memo.add(key[first], np.concatenate(own), np.array([len(x) for x in own]))
            entry[miss] = self.memo.find(key[miss])
        ids, per_chunk = self.memo.gather(entry)
        done = np.concatenate([[0], np.cumsum(per_chunk)])[at]
        return [ids[a:b] for a, b in zip(done[:-1].tolist(), done[1:].tolist())]

    def _learn(self, chunks: list[str]) -> list[np.ndarray]:
        """Ids of distinct chunks, many in one call: they are joined as in a text, a line break before those that do
        not begin with a space, and their ids told apart by the offsets. A line break that is a chunk itself stands
        between two letters. Where the ids between two chunks are not those of a line break, both are learned alone."""
        out: list[np.ndarray] = []
        for i in range(0, len(chunks), JOINED):
            own = chunks[i : i + JOINED]
            solid = [c for c in own if c != "\n"]
            size = np.array([len(c) for c in solid], np.int64)
            broken = np.array([c[0] != " " for c in solid], bool)
            stop = np.cumsum(size + broken)
            ids, begin = self._encode("".join([c if c[0] == " " else "\n" + c for c in solid]))
            a, b = np.searchsorted(begin, stop - size), np.searchsorted(begin, stop)
            before = np.concatenate([[0], b])[: len(a)]
            good = a - before == np.where(broken, len(self.line_break), 0)
            if len(good) and good[0] and broken[0]:
                good[0] = ids[: a[0]].tolist() == self.line_break.tolist()
            good[:-1] &= good[1:].copy()
            found = iter([ids[x:y] if ok else self._alone(c) for c, x, y, ok in zip(solid, a.tolist(), b.tolist(), good.tolist())])
            out += [self.line_break if c == "\n" else next(found) for c in own]
        return out

    def _encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the characters at which they begin."""
        e = self.library.encode(text, add_special_tokens=False)
        return np.array(e.ids, np.uint32), np.fromiter((o[0] for o in e.offsets), np.int64, len(e))

    def _alone(self, chunk: str) -> np.ndarray:
        """Ids of one chunk between two letters and line breaks: where it begins with a space, behind a letter."""
        head = "a" if chunk[0] == " " else "a\n"
        ids, begin = self._encode(head + chunk + "\na")
        return ids[np.searchsorted(begin, len(head)) : np.searchsorted(begin, len(head) + len(chunk))]


def tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer per worker process and file, for the tasks of one function."""
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def crc32(ids: np.ndarray) -> int:
    """CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
