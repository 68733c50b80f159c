"""The whole analysis of a batch of documents in one pass, column by column.

The rules need a document's words in order and nothing of any other document, so a batch of documents is analysed where it is
read: no row is shuffled, whatever the corpus' size, and a single short document costs no more than a call.  Words of all
documents of the batch stand in one set of numpy columns; "the last one before" is a neighbour in a stable sort by (document,
key), "the first of the strongest" the head of a group in a sort with a total order.  Python loops remain where a rule is
sequential (greedy matches, joined phrase echoes, colours), over the few rows concerned.

operators/repetition.py, echo.py, weak.py and assemble.py say the same as relations on DataFrames, for use one by one and for
detectors of one's own; tests hold the two against each other.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd

from ..functions.text import PLAIN, TYPOGRAPHIC, ignored_spans
from ..language.base import LANGUAGES, Language, attributes_of
from ..settings import Settings, word_list
from ..sources.lexicon import Lexicon, element_table
from .colors import assign

FUNCTION, FULL, EXCLUDED = 0, 1, 2
MIN_WORD = 3
MIN_STEM = 4
FAR = 1 << 30
#: Signs that end a segment; how rare a word is said to be, by its level; colours of weak families.
BREAKS = ".!?…;:\n"
RARITY = ("très rare", "rare", "peu courant")
FAMILY_COLORS = (1, 3, 5, 7, 9, 10, 11, 6)
_PLAIN = tuple(zip(TYPOGRAPHIC, PLAIN, strict=True))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it belongs to a word, whether it is an upper-case letter."""
    import regex

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = []
    for pattern in (r"[\p{L}\p{N}\p{M}]+", r"\p{Lu}+"):
        table = np.zeros(0x110000, bool)
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            table[a : b + 1] = True
        table[0xD800:0xE000] = False
        out.append(table)
    return out[0], out[1]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _counted(marks: np.ndarray) -> np.ndarray:
    """Marks before each place."""
    out = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=out[1:])
    return out


class Vocabulary:
    """Numbers of strings, and what a language says of each; kept from batch to batch up to a bound."""

    def __init__(self, language: Language, settings: Settings, common: Mapping[str, int], lexicon: Lexicon, most: int = 1_000_000):
        self.language, self.common, self.most = language, common, most
        self.attributes = functools.partial(attributes_of, language.name) if LANGUAGES.get(language.name) is language else language.attributes
        self.ignored = word_list(settings.extra_ignored_words)
        self.entries = element_table(lexicon, language.verb_forms)
        self.clear()

    def clear(self) -> None:
        self.strings: list[str] = []
        self.known: dict[str, int] = {}
        self.norms: dict[str, int] = {}  # surface -> number of its norm
        self.rows: dict[int, tuple] = {}  # number of a norm -> its row of columns()
        self.starts: dict[int, list] = {}  # number of a norm -> lexicon entries that it can start

    def number(self, text: str) -> int:
        at = self.known.get(text)
        if at is None:
            at = self.known[text] = len(self.strings)
            self.strings.append(text)
        return at

    def norm(self, surface: str) -> int:
        at = self.norms.get(surface)
        if at is None:
            at = self.norms[surface] = self.number(unicodedata.normalize("NFC", surface.lower()))
        return at

    def row(self, norm: int) -> tuple:
        """base kind; whether a capital can make it a name; lemma; stem if long enough; keys 0 to 2; level of commonness."""
        row = self.rows.get(norm)
        if row is None:
            word = self.strings[norm]
            stop = word in self.language.stopwords
            long = len(word) >= MIN_WORD
            letter = any(unicodedata.category(c)[0] == "L" for c in word)
            kind = EXCLUDED if word in self.ignored else FULL if long and letter and not stop else FUNCTION
            lemma = stem = -1
            keys, level = [], 0
            if kind == FULL:
                own, alt, infinitive, plain = self.attributes(word)
                level = self.common.get(plain, 0)
                lemma = -1 if infinitive is None else self.number(infinitive)
                stem = self.number(own) if len(own) >= MIN_STEM else -1
                for key in (infinitive, own, alt):
                    if key is not None and len(key) >= MIN_STEM and self.number(key) not in keys:
                        keys.append(self.number(key))
            row = self.rows[norm] = (kind, long and not stop, lemma, stem, *(keys + [-1, -1, -1])[:3], level)
        return row

    def columns(self, norms: np.ndarray) -> np.ndarray:
        """The rows of norms, one column each."""
        distinct, at = np.unique(norms, return_inverse=True)
        table = np.array([self.row(n) for n in distinct.tolist()], np.int64).reshape(-1, 8)
        return table[at].T


@dataclass
class Words:
    """The words of a batch: number of the document, place in it, and what they are; source, plain: all texts as they came, and
    with plain apostrophes and spaces."""

    source: str
    plain: str
    base: np.ndarray
    doc: np.ndarray
    begin: np.ndarray
    stop: np.ndarray
    norm: np.ndarray
    capital: np.ndarray
    opens: np.ndarray
    segment: np.ndarray
    paragraph: np.ndarray

    def text(self, first: int, last: int) -> str:
        return self.source[self.begin[first] : self.stop[last]]


def words(texts: list[str], vocabulary: Vocabulary, dialogue: bool, mask: bool = True) -> Words:
    """The words outside zones that are no prose.  A word is a run of letters, digits and marks; a segment ends at a sign of
    BREAKS or a masked zone, a paragraph where the text itself has a newline between two words.  Offsets count in source; base
    is where each document starts in it."""
    source = "\n".join(texts)
    plain = functools.reduce(lambda t, pair: t.replace(*pair), _PLAIN, source)
    size = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(size + 1) - size - 1
    points = _points(plain)
    original = points
    masked = plain
    patterns = vocabulary.language.dialogue if dialogue else ()
    zones = [(a + b, a + e) for a, n in zip(base.tolist(), size.tolist(), strict=True) for b, e in (ignored_spans(plain[a : a + n], patterns) if mask else ())]
    if zones:
        points = points.copy()
        for a, b in zones:
            points[a:b] = 10
        masked = points.tobytes().decode("utf-32-le", "surrogatepass")
    in_word, upper = _tables()
    letter = np.zeros(len(points) + 2, np.int8)
    letter[1:-1] = in_word[points]
    edge = np.diff(letter)
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(base, begin, side="right") - 1
    first = np.ones(len(begin), bool)
    first[1:] = doc[1:] != doc[:-1]
    before = np.where(first, base[doc] if len(base) else 0, np.roll(stop, 1))
    has = lambda marks: marks[begin] - marks[before] > 0
    some = lambda signs: _counted(np.isin(points, [ord(c) for c in signs]))
    hard = has(some(BREAKS)) | first
    dashes = np.zeros(len(points), bool)
    dashes[:-1] = (points[:-1] == 45) & (points[1:] == 45)
    pairs = _counted(dashes)
    double = pairs[np.maximum(begin - 1, before)] - pairs[before] > 0
    opens = hard | has(some(vocabulary.language.openers)) | double
    broken = has(_counted(original == 10)) & ~first
    norm = np.array([vocabulary.norm(masked[a:b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], np.int64)
    return Words(source, plain, base, doc, begin, stop, norm, upper[points[begin]], opens, np.cumsum(hard), np.cumsum(broken))


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Of sorted rows, the first of each group that agrees in keys."""
    n = len(keys[0])
    out = np.ones(n, bool)
    if n:
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(out)


def _level(distance: np.ndarray, window: int) -> np.ndarray:
    ratio = distance.astype(np.float64) / float(window)
    return np.where(ratio <= 0.2, 3, np.where(ratio <= 0.5, 2, 1))


def _neighbours(places: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (earlier, later) of places that follow each other under one key."""
    order = np.argsort(keys, kind="stable")
    p, k = places[order], keys[order]
    same = k[1:] == k[:-1]
    return p[:-1][same], p[1:][same]


def _beside(places: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of n, the one before and the one after it under its key (-1: none)."""
    a, b = _neighbours(places, keys)
    before, after = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    before[b], after[a] = a, b
    return before, after


class Analysis:
    """All marks on the words of a batch."""

    def __init__(self, w: Words, vocabulary: Vocabulary, settings: Settings):
        self.w, self.v, self.s = w, vocabulary, settings
        n = self.n = len(w.norm)
        kind, nameable, self.lemma, self.stem, k0, k1, k2, self.common = vocabulary.columns(w.norm) if n else np.zeros((8, 0), np.int64)
        self.size = len(vocabulary.strings) + 1
        key = w.doc * self.size + w.norm
        if settings.ignore_proper_names:
            named = np.unique(key[w.capital & ~w.opens & (nameable == 1)])
            kind = np.where(np.isin(key, named), EXCLUDED, kind)
        self.kind = kind
        self.full = kind == FULL
        full = np.flatnonzero(self.full)
        self.word_level, self.word_other, self.word_same = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n, bool)
        self.p_level, self.p_size, self.p_start, self.p_other = (np.zeros(n, np.int64) for _ in range(4))
        stems = self._stem_events(full, (k0, k1, k2)) if settings.enabled and settings.use_stemming else None
        if settings.enabled:
            self._word_levels(*_neighbours(full, key[full]), stems)
            self._phrases()
        self.family = self._families(stems, key)
        self.echo_other = np.full(n, -1, np.int64)
        self.phrase_echoes: list[tuple[int, int, int, int]] = []
        if settings.echoes:
            self._word_echoes()
            self._phrase_echoes()

    # -- repetitions

    def _stem_events(self, full: np.ndarray, keys: tuple) -> tuple:
        """place, other, key: the nearest earlier word of another form under one of a word's keys, within half the window."""
        w = self.w
        place = np.concatenate([full] * 3)
        key = np.concatenate([k[full] for k in keys])
        rank = np.repeat(np.arange(3), len(full))
        some = key >= 0
        place, key, rank = place[some], key[some], rank[some]
        group = w.doc[place] * self.size + key
        order = np.lexsort((place, group))
        place, key, rank, group = place[order], key[order], rank[order], group[order]
        at = np.arange(len(place))
        new = np.ones(len(place), bool)
        new[1:] = group[1:] != group[:-1]
        switch = ~new
        switch[1:] &= w.norm[place[1:]] != w.norm[place[:-1]]
        start = np.maximum.accumulate(np.where(new, at, 0)) if len(at) else at
        last = np.maximum.accumulate(np.where(switch, at, -1)) if len(at) else at
        found = last > start - 1
        found &= last >= 0
        place, key, rank, other = place[found], key[found], rank[found], place[last[found] - 1]
        order = np.lexsort((rank, -other, place))
        place, key, other = place[order], key[order], other[order]
        head = _heads(place)
        place, key, other = place[head], key[head], other[head]
        near = place - other <= self.s.window / 2
        return place[near], other[near], key[near]

    def _word_levels(self, a: np.ndarray, b: np.ndarray, stems: tuple | None) -> None:
        near = b - a <= self.s.window
        a, b = a[near], b[near]
        level = _level(b - a, self.s.window)
        rows = [(b, a, level, np.ones_like(a), b), (a, b, level, np.ones_like(a), b)]
        if stems is not None:
            i, o, _ = stems
            level = np.where(_level(i - o, self.s.window) == 3, 2, 1)
            rows += [(i, o, level, np.full_like(i, 2), i), (o, i, level, np.full_like(i, 2), i)]
        target, other, level, phase, event = (np.concatenate(c) for c in zip(*rows, strict=True))
        order = np.lexsort((-other, event, phase, -level, target))
        order = order[_heads(target[order])]
        at = target[order]
        self.word_level[at], self.word_other[at], self.word_same[at] = level[order], other[order], phase[order] == 1

    def _phrases(self) -> None:
        """Runs of words that come again in their document, from short to long: only what begins with a repeated shorter run
        can be repeated itself."""
        w, n = self.w, self.n
        shut = _counted(self.kind == EXCLUDED)
        places, code = np.arange(n), w.doc * self.size + w.norm
        events = []
        for size in range(2, self.s.max_ngram + 1):
            end = places + size - 1
            ok = end < n
            ok[ok] = (w.segment[end[ok]] == w.segment[places[ok]]) & (shut[end[ok] + 1] == shut[places[ok]])
            places, code = places[ok], code[ok]
            _, code, count = np.unique(code * self.size + w.norm[places + size - 1], return_inverse=True, return_counts=True)
            again = count[code] > 1
            places, code = places[again], code[again]
            valid = np.ones(len(places), bool) if size > 2 else self.full[places] & self.full[places + 1]
            a, b = self._apart(places[valid], code[valid], size)
            near = b - a <= self.s.window
            a, b = a[near], b[near]
            level = np.minimum(3, _level(b - a, self.s.window) + (size >= 3))
            events += [(np.full_like(a, size), b, level, b, a), (np.full_like(a, size), b, level, a, b)]
        if not events:
            return
        size, event, level, start, other = (np.concatenate(c) for c in zip(*events, strict=True))
        row = np.repeat(np.arange(len(size)), size)
        at = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        order = np.lexsort((event[row], size[row], -level[row], at))
        order = order[_heads(at[order])]
        at, row = at[order], row[order]
        self.p_level[at], self.p_size[at], self.p_start[at], self.p_other[at] = level[row], size[row], start[row], other[row]

    @staticmethod
    def _apart(places: np.ndarray, code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences that follow each other, after those are left out that overlap the one kept before."""
        order = np.lexsort((places, code))
        p, c = places[order], code[order]
        same = c[1:] == c[:-1]
        tight = same & (p[1:] - p[:-1] < size)
        if tight.any():
            keep = np.ones(len(p), bool)
            for k in np.unique(c[1:][tight]).tolist():
                a, b = np.searchsorted(c, k, "left"), np.searchsorted(c, k, "right")
                last = -FAR
                for j in range(a, b):
                    if p[j] - last >= size:
                        last = p[j]
                    else:
                        keep[j] = False
            p, c = p[keep], c[keep]
            same = c[1:] == c[:-1]
        return p[:-1][same], p[1:][same]

    def _families(self, stems: tuple | None, key: np.ndarray) -> np.ndarray:
        """Number of each word's family: infinitive, else the linked family, else the stem, else the word itself."""
        w = self.w
        if not self.s.use_stemming:
            return w.norm
        family = np.where(self.full & (self.stem >= 0), self.stem, w.norm)
        if stems is not None and len(stems[0]):
            i, o, k = stems
            linked = np.where(self.lemma[i] >= 0, self.lemma[i], np.where(self.lemma[o] >= 0, self.lemma[o], k))
            form = np.concatenate([i, o])
            event, linked = np.concatenate([i, i]), np.concatenate([linked, linked])
            free = self.lemma[form] < 0
            form, event, linked = key[form[free]], event[free], linked[free]
            order = np.lexsort((-event, form))
            order = order[_heads(form[order])]
            forms, linked = form[order], linked[order]
            at = np.searchsorted(forms, key)
            hit = (at < len(forms)) & (forms[np.minimum(at, len(forms) - 1)] == key) if len(forms) else np.zeros(self.n, bool)
            hit &= self.full
            family[hit] = linked[at[hit]]
        return np.where(self.full & (self.lemma >= 0), self.lemma, family)

    # -- echoes

    def _word_echoes(self) -> None:
        reach = self.s.echo_reach or FAR
        rare = np.flatnonzero(self.full & (self.common < self.s.echo_rarity))
        a, b = _beside(rare, (self.w.doc * self.size + self.family)[rare], self.n)
        place = rare[(self.word_level[rare] == 0) & (self.p_level[rare] == 0)]
        before = np.where(a[place] >= 0, place - a[place], FAR + 1)
        after = np.where(b[place] >= 0, b[place] - place, FAR + 1)
        before[before > reach], after[after > reach] = FAR + 1, FAR + 1
        some = np.minimum(before, after) <= FAR
        self.echo_other[place[some]] = np.where(before <= after, a[place], b[place])[some]

    def _phrase_echoes(self) -> None:
        if self.s.max_ngram < 3:
            return
        w, n, reach = self.w, self.n, self.s.echo_reach or FAR
        part = np.where(self.full, self.family, w.norm)
        shut = _counted((self.kind == EXCLUDED) | (self.word_level > 0) | (self.p_level > 0) | (self.echo_other >= 0))
        common = np.where(self.full, self.common, 3)
        best: dict[int, tuple[int, int, int]] = {}
        for size in range(3, self.s.max_ngram + 1):
            places = np.flatnonzero(self.full)
            end = places + size - 1
            ok = end < n
            ok[ok] = (w.segment[end[ok]] == w.segment[places[ok]]) & (shut[end[ok] + 1] == shut[places[ok]]) & self.full[end[ok]]
            places = places[ok]
            rarest = functools.reduce(np.minimum, [common[places + k] for k in range(size)])
            places, rarest = places[rarest <= self.s.echo_rarity], rarest[rarest <= self.s.echo_rarity]
            if len(places) < 2:
                continue
            code = w.doc[places]
            for k in range(size):
                code = np.unique(code * self.size + part[places + k], return_inverse=True)[1]
            of = np.zeros(n, np.int64)
            of[places] = rarest
            a, b = _beside(places, code, n)
            a, b = a[places], b[places]
            fits = lambda d: (d > self.s.window) & (d <= reach)
            left, right = (a >= 0) & fits(places - a), (b >= 0) & fits(b - places)
            other, level = np.where(left, a, b), np.where(left, rarest, of[b])
            for i in np.flatnonzero(left | right).tolist():
                best[int(places[i])] = (size, int(other[i]), int(level[i]))
        open_ = None
        for start in sorted(best):  # neighbours that point to the same place are one range
            size, other, level = best[start]
            if open_ and w.doc[open_[0]] == w.doc[start] and start < open_[0] + open_[1]:
                ahead = start - open_[0]
                if other - open_[2] == ahead:
                    open_[1] = max(open_[1], ahead + size)
                continue
            open_ = [start, size, other, level]
            self.phrase_echoes.append(open_)


# -- ranges -------------------------------------------------------------------------------------------------------------

#: first, last: words; kind: same, stem, echo, phrase or weak; mine, other, size: the words that match; more: level of
#: commonness, or number of hits of a weak family; rank: a weak family's.
RANGE = ("first", "last", "category", "family", "intensity", "kind", "mine", "other", "size", "more", "rank")


def _spelt(w: Words, v: Vocabulary, first: int, size: int) -> str:
    return " ".join([v.strings[x] for x in w.norm[first : first + size].tolist()])


def ranges(a: Analysis) -> list[tuple]:
    """What the repetition detector shows."""
    w, v = a.w, a.v
    out: list[tuple] = []
    at = np.flatnonzero(a.p_level > 0)
    if len(at):
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (w.segment[at[1:]] != w.segment[at[:-1]])
        run = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        order = np.lexsort((at, -a.p_level[at], run))
        top = at[order[_heads(run[order])]]
        level = np.maximum.reduceat(np.maximum(a.p_level[at], a.word_level[at]), starts)
        lasts = at[np.append(starts[1:], len(at)) - 1]
        for f, t, b, x in zip(at[starts].tolist(), lasts.tolist(), top.tolist(), level.tolist(), strict=True):
            start, size = int(a.p_start[b]), int(a.p_size[b])
            out.append((f, t, "repetition", _spelt(w, v, start, size), x, "phrase", start, int(a.p_other[b]), size, None, None))
    one = np.flatnonzero((a.p_level == 0) & ((a.word_level > 0) | (a.echo_other >= 0)))
    columns = (c[one].tolist() for c in (a.word_level, a.word_other, a.word_same, a.echo_other, a.common, a.family))
    for i, level, other, same, far, common, family in zip(one.tolist(), *columns, strict=True):
        if level:
            out.append((i, i, "repetition", v.strings[family], level, "same" if same else "stem", i, other, 1, None, None))
        else:
            out.append((i, i, "echo", v.strings[family], 3 - common, "echo", i, far, 1, common, None))
    for start, size, other, level in a.phrase_echoes:
        out.append((start, start + size - 1, "echo", _spelt(w, v, start, size), max(1, 3 - level), "phrase", start, other, size, None, None))
    return out


def weak_ranges(a: Analysis, lexicon: Lexicon) -> list[tuple]:
    """Entries of the lexicon from left to right, each taking its words, where their family gathers in a paragraph."""
    w, v, s = a.w, a.v, a.s
    norms = np.unique(w.norm)
    for x in norms.tolist():
        if x not in v.starts:
            v.starts[x] = v.entries.starting(v.strings[x])
    begins = np.zeros(int(norms[-1]) + 1 if len(norms) else 1, bool)
    begins[[x for x in norms.tolist() if v.starts[x]]] = True
    off = {k for k, f in enumerate(lexicon.families) if f.id in s.weak_disabled}
    hits, free = [], 0
    for i in np.flatnonzero(begins[w.norm]).tolist():
        if i < free:
            continue
        best = None
        for entry in v.starts[int(w.norm[i])]:
            n = len(entry.elements)
            if i + n > a.n or w.segment[i + n - 1] != w.segment[i] or (best and entry.order <= best.order):
                continue
            if all(v.entries.fits(entry.elements[k], v.strings[int(w.norm[i + k])]) for k in range(1, n)):
                best = entry
        if best:
            free = i + len(best.elements)
            if best.rank not in off:
                hits.append((i, len(best.elements), best.rank))
    count: dict[tuple, int] = {}
    for i, _, rank in hits:
        group = (int(w.doc[i]), int(w.paragraph[i]), rank)
        count[group] = count.get(group, 0) + 1
    out = []
    for i, size, rank in hits:
        family = lexicon.families[rank]
        n, limit = count[int(w.doc[i]), int(w.paragraph[i]), rank], s.weak_threshold if family.threshold is None else family.threshold
        if n >= limit:
            level = 3 if n >= 2 * limit else 2 if n > limit else 1
            out.append((i, i + size - 1, "weak", f"faible:{family.id}", level, "weak", None, None, size, n, rank))
    return out


# -- explanations (fixed values: the French templates) --------------------------------------------------------------------


def _far(distance: int, before: bool) -> str:
    if distance == 1:
        return "juste avant" if before else "juste après"
    return f"{distance:,} mots plus ".replace(",", " ") + ("haut" if before else "loin")


def explain(a: Analysis, lexicon: Lexicon, row: tuple) -> tuple[str, int | None, int | None]:
    """Text, and the part of it that leads to the other occurrence."""
    first, last, _, _, _, kind, mine, other, size, more, rank = row
    w, v = a.w, a.v
    own = w.text(first, last)
    if kind == "weak":
        return f"« {own} » — {lexicon.families[rank].label} : {more} dans ce paragraphe.", None, None
    before = other < mine
    there = w.text(other, other + size - 1)
    again = " apparaît déjà " if before else " revient "
    if kind == "phrase":
        head = f"L'expression « {w.text(mine, mine + size - 1)} »{again}"
    elif kind == "same":
        head = f"« {own} »{again}"
    elif kind == "stem":
        lemma = int(a.lemma[first])
        if lemma >= 0 and lemma == a.lemma[other]:
            head = f"« {own} » et « {there} » sont deux formes de « {v.strings[lemma]} » ("
        else:
            head = f"« {own} » a la même racine que « {there} » ("
    else:
        head = f"« {own} », mot {RARITY[more]},"
        if w.norm[first] == w.norm[other]:
            head += again
        else:
            head += f"{' reprend ' if before else ' revient sous la forme '}« {there} » "
    place = _far(abs(mine - other), before)
    return f"{head}{place}{').' if kind == 'stem' else '.'}", len(head), len(head) + len(place)


class Analyser:
    """Highlights of batches of texts; made once for each task."""

    def __init__(self, settings: Settings, lexicon: Lexicon, language: Language, common: Mapping[str, int], color: bool, explain: bool):
        self.settings, self.lexicon, self.color, self.explain = settings, lexicon, color, explain
        self.vocabulary = Vocabulary(language, settings, common, lexicon if settings.weak_words else Lexicon([]))

    def __call__(self, texts: list[str]) -> pd.DataFrame:
        """doc (place in texts) and the columns of plans.analyze; document by document in the order of the text."""
        a = self._analysis(texts)
        w, found = a.w, ranges(a)
        if self.settings.weak_words and self.lexicon.families:
            taken = np.zeros(a.n + 1, bool)
            for r in found:
                taken[r[0] : r[1] + 1] = True
            taken = _counted(taken)
            found += [r for r in weak_ranges(a, self.lexicon) if taken[r[1] + 1] == taken[r[0]]]
        found.sort(key=lambda r: r[0])
        first, last = (np.array([r[k] for r in found], np.int64) for k in (0, 1))
        doc = w.doc[first] if len(found) else first
        base = w.base[doc] if len(found) else first
        match = np.array([-1 if r[7] is None else r[7] for r in found], np.int64)
        end = match + np.array([r[8] for r in found], np.int64) - 1
        linked = match >= 0
        fixed = [None if r[10] is None else FAMILY_COLORS[r[10] % len(FAMILY_COLORS)] for r in found]
        begin, stop = (w.begin[first] - base, w.stop[last] - base) if len(found) else (first, last)
        target = lambda c, at: pd.array(np.where(linked, c[at] - base, 0), "Int64").astype("Int32") if len(found) else pd.array([], "Int32")
        text = lambda values: pd.Series(list(values), dtype=object)
        out = pd.DataFrame({"doc": doc, "begin": begin.astype(np.int32), "stop": stop.astype(np.int32), "surface": text(w.text(r[0], r[1]) for r in found), "category": text(r[2] for r in found), "family": text(r[3] for r in found), "intensity": np.array([r[4] for r in found], np.int32)})
        out["color"] = pd.array(self._colors(doc, begin, stop, out["family"].tolist(), fixed) if self.color else fixed, "Int32")
        for name, c, at in (("target_begin", w.begin, match), ("target_stop", w.stop, end)):
            column = target(c, at)
            column[~linked] = pd.NA
            out[name] = column
        if self.explain:
            out["explanation"] = pd.Series([dict(zip(("text", "link_from", "link_to"), explain(a, self.lexicon, r), strict=True)) for r in found], dtype=object)
        return out

    def phrase_echoes(self, texts: list[str]) -> pd.DataFrame:
        """doc (place in texts), idx, size, other, rarest of the ranges of phrase echoes, as echo.extend gives them."""
        a = self._analysis(texts)
        start, size, other, rarest = np.array(a.phrase_echoes, np.int64).reshape(-1, 4).T
        doc = a.w.doc[start]
        before = np.searchsorted(a.w.doc, doc)  # words of the texts ahead
        return pd.DataFrame({"doc": doc} | {c: x.astype(np.int32) for c, x in (("idx", start - before), ("size", size), ("other", other - before), ("rarest", rarest))})

    def _analysis(self, texts: list[str]) -> Analysis:
        if len(self.vocabulary.strings) > self.vocabulary.most:
            self.vocabulary.clear()
        return Analysis(words(texts, self.vocabulary, self.settings.ignore_dialogue), self.vocabulary, self.settings)

    @staticmethod
    def _colors(doc: np.ndarray, begin: np.ndarray, stop: np.ndarray, family: list[str], fixed: list) -> list[int]:
        out: list[int] = []
        edges = [*_heads(doc).tolist(), len(doc)] if len(doc) else [0]
        for a, b in zip(edges, edges[1:], strict=False):
            out += assign(list(zip(begin[a:b].tolist(), stop[a:b].tolist(), family[a:b], fixed[a:b], strict=True)), {})
        return out
