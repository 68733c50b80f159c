"""Settings of an analysis, and their sanitising."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields

#: Bounds and steps that a settings file must keep to.
WINDOW_RANGE = (20, 200)
NGRAM_RANGE = (1, 4)
ECHO_RARITY_RANGE = (1, 3)
WEAK_THRESHOLD_RANGE = (1, 6)
ECHO_REACHES = (1000, 2000, 5000, 10000, 0)
DEFAULT_WEAK_NOTE = "mots-faibles.md"


@dataclass(frozen=True)
class Settings:
    enabled: bool = True  # repetitions nearby
    window: int = 80  # words within which a repetition counts
    max_ngram: int = 4  # words of the longest phrase
    use_stemming: bool = True
    echoes: bool = True  # rare words from afar
    echo_rarity: int = 2
    echo_reach: int = 5000  # words; 0: the whole document
    weak_words: bool = True
    weak_threshold: int = 3
    weak_disabled: tuple[str, ...] = field(default=())
    weak_note: str = DEFAULT_WEAK_NOTE
    ignore_proper_names: bool = True
    ignore_dialogue: bool = False
    extra_ignored_words: str = ""
    included_folders: str = ""
    excluded_folders: str = ""

    @property
    def active(self) -> bool:
        """Whether there is anything to look for."""
        return self.enabled or self.echoes or self.weak_words

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, raw: Mapping | None) -> Settings:
        """Settings from a file that may be old or edited by hand: what cannot be read, or is 0 where 0 means nothing, is the
        default; numbers are rounded and held within their bounds."""
        d = cls()
        merged = asdict(d) | {k: v for k, v in (raw or {}).items() if k in {f.name for f in fields(cls)}}
        within = lambda name, low_high: min(low_high[1], max(low_high[0], _rounded(merged[name]) or getattr(d, name)))
        reach = _number(merged["echo_reach"])
        text = lambda name: "" if merged[name] is None else str(merged[name])
        disabled = merged["weak_disabled"]
        return cls(
            **{k: merged[k] for k in ("enabled", "use_stemming", "echoes", "weak_words", "ignore_proper_names", "ignore_dialogue")},
            window=within("window", WINDOW_RANGE), max_ngram=within("max_ngram", NGRAM_RANGE),
            echo_rarity=within("echo_rarity", ECHO_RARITY_RANGE), weak_threshold=within("weak_threshold", WEAK_THRESHOLD_RANGE),
            echo_reach=int(reach) if reach in ECHO_REACHES else d.echo_reach,
            weak_disabled=tuple(x for x in disabled if isinstance(x, str)) if isinstance(disabled, (list, tuple)) else (),
            weak_note=text("weak_note").strip() or DEFAULT_WEAK_NOTE,
            **{k: text(k) for k in ("extra_ignored_words", "included_folders", "excluded_folders")},
        )


def _number(value) -> float:
    """A number as a loosely typed file may hold it: null and blank are 0, what is no number is nan."""
    if value is None or (isinstance(value, str) and not value.strip()):
        return 0.0
    try:
        return float(value)
    except (TypeError, ValueError):
        return math.nan


def _rounded(value) -> int:
    x = _number(value)
    return math.floor(x + 0.5) if math.isfinite(x) else 0


def word_list(text: str) -> frozenset[str]:
    """Words apart by white space, commas or semicolons, in lower case and composed form."""
    return frozenset(unicodedata.normalize("NFC", w.lower()) for w in re.split(r"[\s,;]+", text) if w)


def folder_list(text: str) -> list[str]:
    """Folders, one a line, with single slashes and none at the ends, in composed lower case."""
    out = []
    for line in re.split(r"\r?\n", text):
        f = re.sub(r"/{2,}", "/", line.strip().replace("\\", "/"))
        f = re.sub(r"^(\./)+", "", f).strip("/").strip()
        if f:
            out.append(unicodedata.normalize("NFC", f).lower())
    return out
