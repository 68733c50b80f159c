"""Byte-level BPE ids of whole texts: the tokenizers library on each distinct word once, numpy for all else.

The library spends about a microsecond a character, most of it on words it has seen before.  The pre-tokenizer of
byte-level BPE cuts a text into words that are encoded apart from each other, so a text's ids are its words' ids in a row.
Here numpy finds the words of a batch of texts, a hash table gives the ids of known words (every word found is compared with
the one that was learned), and the library encodes those that are new, as pre-tokenized input.  Tests hold the ids against the library's own on random Unicode.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterable

import numpy as np

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
BATCH_CHARS = 300_000
#: Characters of all words of a table, beyond which it is thinned.
MOST_SIGNS = 1 << 24


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            table[a : b + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_starts(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Marks where the words of byte-level BPE start in a row of code points; doc_starts: where texts start.

    A word is a run of letters, of digits or of other signs, with the one space before it; a run of white space leaves its
    last character to what follows; an apostrophe that no space precedes takes the ending s, t, m, d, re, ve or ll.
    """
    n = len(points)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    run = np.empty(n, bool)
    run[0] = True
    np.not_equal(kind[1:], kind[:-1], out=run[1:])
    run |= first[:n]
    start = run.copy()
    after = np.flatnonzero(run & (kind != SPACE) & ~first[:n])
    after = after[kind[after - 1] == SPACE]
    start[after - 1] = True
    start[after] = points[after - 1] != 32
    q = np.flatnonzero(run & (points == 39))
    q = q[q + 1 < n]
    q = q[run[q + 1] & ~first[q + 1] & (kind[q + 1] == LETTER)]
    q = q[first[q] | (points[q - 1] != 32)]
    if len(q):
        a, b = points[q + 1], np.where((q + 2 < n) & ~first[q + 2], points[np.minimum(q + 2, n - 1)], 0)
        takes = np.where(np.isin(a, [ord(c) for c in "stmd"]), 1, 0)
        for pair in ("re", "ve", "ll"):
            takes[(a == ord(pair[0])) & (b == ord(pair[1]))] = 2
        q, takes = q[takes > 0], takes[takes > 0]
        start[q + 1] = False
        rest = q + 1 + takes
        start[rest[rest < n]] = True
    return start


def _places(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each of some runs, count places of each, all in a row."""
    ends = np.cumsum(count)
    return np.repeat(begin - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


class WordTokenizer:
    """encode(texts) gives the ids of all texts in one array and the number of each text's ids."""

    def __init__(self, path: str, most_words: int = 1 << 19):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)  # a sign of a byte-level token is a byte
        self.bytes[list(vocab.values())] = [len(x) for x in vocab]
        self.values = _mix(np.arange(1, 0x110001, dtype=np.uint64))
        self.most = most_words
        self._clear()

    def _clear(self) -> None:
        """An empty table; a full one is thinned, so that memory stays bounded."""
        self.bits = (2 * self.most - 1).bit_length()
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.begin = np.zeros(1 << self.bits, np.int32)
        self.count = np.zeros(1 << self.bits, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.spelt = np.zeros(1 << 16, np.uint32)  # the words themselves, to tell words of one key apart
        self.spelling = np.zeros(1 << self.bits, np.int32)
        self.met = np.zeros(1 << self.bits, bool)  # words met again since they were learned or the table was thinned
        self.used = self.words = self.signs = 0

    def _full(self, words: int, signs: int) -> bool:
        return self.words + words > self.most or self.signs + signs > MOST_SIGNS

    def _thin(self) -> None:
        """The table with the words alone that were met again; an empty one if they are more than half of what it may hold."""
        known = np.flatnonzero(self.keys)
        known = known[np.argsort(self.spelling[known])]  # the order in which they were learned
        length = np.diff(self.spelling[known], append=self.signs)
        stay = self.met[known]
        if 2 * int(stay.sum()) > self.most:
            return self._clear()
        known, length = known[stay], length[stay]
        keys, begin, count, spelling = self.keys[known], self.begin[known], self.count[known].astype(np.int64), self.spelling[known]
        ids, signs = self.pool[_places(begin, count)], self.spelt[_places(spelling, length)]
        self._clear()
        self._enter(keys, ids, count, signs, length)

    def _probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each key, and whether it is there; else an empty slot."""
        mask = (1 << self.bits) - 1
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.keys[slot]
        hit = found == keys
        todo = np.flatnonzero(~hit & (found != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            found = self.keys[slot[todo]]
            hit[todo] = found == keys[todo]
            todo = todo[(found != 0) & (found != keys[todo])]
        return slot, hit

    def _ids(self, words: list[str], signs: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row and how many each has.  The library's fast way doesn't say whose an id is; the bytes
        that ids stand for do, if they are as many as the words have."""
        ids = np.array(self.lib.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
        wide = np.cumsum(1 + (signs >= 0x80) + (signs >= 0x800).astype(np.int64) + (signs >= 0x10000))[ends - 1]
        reach = np.cumsum(self.bytes[ids])
        last = np.searchsorted(reach, wide)
        if len(ids) and reach[-1] == wide[-1] and (reach[last] == wide).all():
            return ids, np.diff(last, prepend=-1)
        plain = self.lib.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(plain.ids, np.uint32)
        return ids, np.bincount(np.array(plain.word_ids, np.int64), minlength=len(words)) if len(ids) else np.zeros(len(words), np.int64)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        signs = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.array([len(w) for w in words], np.int64)
        ids, count = self._ids(words, signs, np.cumsum(length))
        self._enter(keys, ids, count, signs, length)

    def _enter(self, keys: np.ndarray, ids: np.ndarray, count: np.ndarray, signs: np.ndarray, length: np.ndarray) -> None:
        """Puts words that the table doesn't hold into it."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        begin = self.used + np.cumsum(count) - count
        self.used += len(ids)
        while self.signs + len(signs) > len(self.spelt):
            self.spelt = np.concatenate([self.spelt, np.zeros(len(self.spelt), np.uint32)])
        self.spelt[self.signs : self.signs + len(signs)] = signs
        spelling = self.signs + np.cumsum(length) - length
        self.signs += len(signs)
        self.words += len(keys)
        left = np.arange(len(keys))
        while len(left):
            slot, _ = self._probe(keys[left])
            _, one = np.unique(slot, return_index=True)
            self.keys[slot[one]] = keys[left[one]]
            self.begin[slot[one]] = begin[left[one]]
            self.count[slot[one]] = count[left[one]]
            self.spelling[slot[one]] = spelling[left[one]]
            left = np.delete(left, one)

    def _batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n, begins = len(points), np.cumsum(sizes) - sizes
        s = np.flatnonzero(word_starts(points, begins))
        e = np.append(s[1:], n)
        power, inverse = _powers(1 << (n - 1).bit_length())
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[points] * power[:n], out=sums[1:])
        keys = _mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)) | np.uint64(1)
        slot, hit = self._probe(keys)
        self.met[slot[hit]] = True
        if not hit.all():
            new, at = np.unique(keys[~hit], return_index=True)
            at = np.flatnonzero(~hit)[at]
            if self._full(len(new), n):
                if len(new) > self.most and len(texts) > 1:
                    half = len(texts) // 2
                    (a, b), (c, d) = self._batch(texts[:half]), self._batch(texts[half:])
                    return np.concatenate([a, c]), np.concatenate([b, d])
                self._thin()
                slot, hit = self._probe(keys)
                new, at = np.unique(keys[~hit], return_index=True)
                at = np.flatnonzero(~hit)[at]
                if self._full(len(new), n):
                    new, at = np.unique(keys, return_index=True)
                    self.most = max(self.most, len(new))
                    self._clear()
            self._learn(new, [joined[a:b] for a, b in zip(s[at].tolist(), e[at].tolist(), strict=True)])
            slot, _ = self._probe(keys)
        same = self.spelt[np.repeat(self.spelling[slot] - s, e - s) + np.arange(n)] == points
        if not same.all():  # another word with the same key: the library alone does these texts
            each = [np.array(self.lib.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]
            return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        count = self.count[slot].astype(np.int64)
        ends = np.cumsum(count)
        total = int(ends[-1])
        ids = self.pool[np.repeat(self.begin[slot] - (ends - count), count) + np.arange(total)]
        word_of = np.append(np.searchsorted(s, begins), len(s))
        before = np.append(0, ends)[word_of]
        return ids, np.diff(before)

    def encode(self, texts: Iterable[str]) -> Iterable[tuple[np.ndarray, np.ndarray]]:
        """For batches of texts in order: their ids in one array, and how many each text has."""
        batch: list[str] = []
        chars = 0
        for t in texts:
            if any(x in t for x in self.special):
                if batch:
                    yield self._batch(batch)
                    batch, chars = [], 0
                ids = np.array(self.lib.encode(t, add_special_tokens=False).ids, np.uint32)
                yield ids, np.array([len(ids)])
                continue
            if batch and chars + len(t) > BATCH_CHARS:
                yield self._batch(batch)
                batch, chars = [], 0
            batch.append(t)
            chars += len(t)
        if batch:
            yield self._batch(batch)

    def each(self, texts: Iterable[str]) -> Iterable[np.ndarray]:
        """The ids of each text."""
        for ids, counts in self.encode(texts):
            at = 0
            for n in counts.tolist():
                yield ids[at : at + n]
                at += n


@functools.cache
def tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, so that its table serves all of the worker's tasks."""
    return WordTokenizer(path)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
