"""What the analysis asks of a language."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field


def _nothing(word: str) -> str | None:
    return None


@dataclass(frozen=True)
class Language:
    """Functions and word lists of a language.  What a language leaves out switches off what needs it: without lemma no
    irregular forms are linked, without a lexicon there are no weak words unless a note gives them."""

    name: str
    stem: Callable[[str], str]
    stopwords: frozenset[str]
    lemma: Callable[[str], str | None] = _nothing
    alt_stem: Callable[[str], str | None] = _nothing
    #: The form under which a frequency table knows a word (ligatures undone); its stem is looked up.
    plain: Callable[[str], str] = str
    #: Stem -> 1 to 3, how common it is, where no frequency table is given.
    common: Mapping[str, int] = field(default_factory=dict)
    #: All forms of a verb, for lexicon entries with @; None if not known.
    verb_forms: Callable[[str], frozenset[str] | None] = _nothing
    lexicon: str = ""
    dialogue: tuple[re.Pattern, ...] = ()
    #: Signs that may open a sentence inside a segment.
    openers: str = "«“\"—–("

    def attributes(self, word: str) -> tuple[str, str | None, str | None, str]:
        """Stem, second stem, infinitive and the stem that frequency tables know."""
        return self.stem(word), self.alt_stem(word), self.lemma(word), self.stem(self.plain(word))


LANGUAGES: dict[str, Language] = {}


@functools.lru_cache(1 << 20)
def attributes_of(name: str, word: str) -> tuple[str, str | None, str | None, str]:
    """Attributes of a word in a registered language; each different word is worked out once in a process."""
    return LANGUAGES[name].attributes(word)


def register(language: Language) -> Language:
    LANGUAGES[language.name] = language
    return language


def resolve(name: str | None = None) -> Language:
    """The language of a name; French for any other and for none."""
    from . import french

    return LANGUAGES.get(name or "", french.FRENCH)
