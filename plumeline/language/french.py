"""French: verb tables, stems and the attributes of words."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Mapping

from .base import Language, register
from .french_words import AUXILIARIES, COMMON_WORDS, DEFAULT_LEXICON, ER_ENDINGS, FUTURE_ENDINGS, IMPERFECT_ENDINGS, IRREGULAR_VERBS, STOPWORDS
from .stemmer import stem

#: Lines that a dash opens, and what stands in quotation marks; what may open a sentence.
DIALOGUE = (re.compile(r"^[ \t]*(?:[—–]|--)[^\n]*", re.M), re.compile(r"«[^»\n]*»"))
OPENERS = "«“\"—–("

__all__ = ["DEFAULT_LEXICON", "FRENCH", "STOPWORDS", "alt_stem", "stem", "unligate", "verb_forms", "verb_table"]


def conjugated(verb: Mapping) -> list[str]:
    """Every form of a verb without prefix; the regular tenses from their stems."""
    listed = [f for part in ("infinitive", "present", "past", "subjunctive", "participles", "others") for f in verb.get(part, "").split()]
    imperfect = [s + e for s in verb.get("imperfect", "").split() for e in IMPERFECT_ENDINGS]
    future = [s + e for s in verb.get("future", "").split() for e in FUTURE_ENDINGS + IMPERFECT_ENDINGS]
    return listed + imperfect + future


def build_verb_table(verbs: Iterable[Mapping] = IRREGULAR_VERBS) -> tuple[dict[str, str], set[str]]:
    """Form -> infinitive, and the forms that two verbs claim, which belong to neither."""
    claims: dict[str, set[str]] = {}
    for verb in verbs:
        forms, key = conjugated(verb), verb["infinitive"].split()[0]
        nouns = set(verb.get("noun_like", "").split())
        prefixes = verb.get("compounds", "").split() + ([] if verb.get("bound") else [""])
        for prefix in prefixes:
            for form in forms:
                if prefix or form not in nouns:
                    claims.setdefault(prefix + form, set()).add(prefix + key)
    return {f: next(iter(c)) for f, c in claims.items() if len(c) == 1}, {f for f, c in claims.items() if len(c) > 1}


@functools.cache
def verb_table() -> dict[str, str]:
    return build_verb_table()[0]


@functools.cache
def _forms_by_infinitive() -> dict[str, frozenset[str]]:
    out: dict[str, set[str]] = {}
    for form, infinitive in verb_table().items():
        out.setdefault(infinitive, set()).add(form)
    return {k: frozenset(v) for k, v in out.items()}


def regular_forms(infinitive: str) -> frozenset[str] | None:
    """Forms of a regular verb in -er; c becomes ç and g becomes ge before a, o, â."""
    if len(infinitive) < 4 or not infinitive.endswith("er"):
        return None
    root = infinitive[:-2]
    soft = root[:-1] + "ç" if root.endswith("c") else root + "e" if root.endswith("g") else root
    return frozenset((soft if e[0] in "aoâ" else root) + e for e in ER_ENDINGS)


def verb_forms(infinitive: str) -> frozenset[str] | None:
    """All forms of a verb; None if it is not known how it is conjugated."""
    if infinitive in AUXILIARIES:
        return AUXILIARIES[infinitive]
    lemma = verb_table().get(infinitive)
    return _forms_by_infinitive()[lemma] if lemma else regular_forms(infinitive)


def alt_stem(word: str) -> str | None:
    """A second stem for first persons plural in -ons, which the stemmer leaves alone; None if it is no other."""
    if not word.endswith("ons") or word.endswith("ions") or word in verb_table():
        return None
    root = word[:-3]
    second = stem(root[:-1] + "c" if root.endswith("ç") else root)
    return second if second != stem(word) else None


def unligate(word: str) -> str:
    return word.replace("œ", "oe").replace("æ", "ae")


def common_stems() -> dict[str, int]:
    """Stem -> level of the words that are very common without any table; a full table replaces it (see sources.documents)."""
    return {stem(unligate(w)): 3 for w in COMMON_WORDS.split()}


FRENCH = register(
    Language(
        name="fr", stem=stem, stopwords=STOPWORDS, lemma=lambda word: verb_table().get(word), alt_stem=alt_stem, plain=unligate, common=common_stems(),
        verb_forms=verb_forms, lexicon=DEFAULT_LEXICON, dialogue=DIALOGUE, openers=OPENERS,
    )
)
