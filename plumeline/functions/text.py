"""Scalar functions on text: typography, masking, offsets, numbers in French."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Typographic signs and the plain ones they stand for, one for one.
TYPOGRAPHIC = "\u2018\u2019\u02bc\u00a0\u202f\u2007\u2009"
PLAIN = "'''    "


def normalize(text: Column) -> Column:
    """Typographic apostrophes and spaces as plain ones; every sign stays at its place."""
    return F.translate(text, TYPOGRAPHIC, PLAIN)


def utf16_offset(text: Column, offset: Column) -> Column:
    """An offset in code points as one in UTF-16 units."""
    return (F.octet_length(F.encode(F.substring(text, F.lit(1), offset), "UTF-16BE")) / 2).cast("int")


def thousands(number: Column) -> Column:
    """A whole number with narrow no-break spaces between thousands."""
    return F.replace(F.format_number(number.cast("long"), 0), F.lit(","), F.lit("\u202f"))


# -- zones that are no prose ------------------------------------------------------------------------------------------

#: Inline zones, each looked for in the whole text by itself.
INLINE = tuple(
    re.compile(p)
    for p in (
        r"(`+)[^\n]*?\1",  # code
        r"\$\$[\s\S]*?\$\$",  # formula
        r"<!--[\s\S]*?-->",  # comment
        r"%%[\s\S]*?%%",  # comment
        r"!\[\[[^\]\n]*\]\]",  # embedded file
        r"\[\[[^\]|\n]*\|",  # target of a link with a text of its own
        r"\]\([^)\n]*\)",  # target of a link
        r"https?://[^\s)>\]]+",  # address
    )
)
FRONTMATTER = re.compile(r"---[ \t]*\n[\s\S]*?\n(?:---|\.\.\.)[ \t]*(?=\n|\Z)")
FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
SIGNS = ("---", "```", "~~~", "`", "$$", "<!--", "%%", "[[", "](", "http", "«", "—", "–", "--")


def _blocks(text: str) -> list[tuple[int, int]]:
    """The closed frontmatter, and fenced code: up to a fence of the same sign that is no shorter, else to the end."""
    spans, at = [], 0
    if head := FRONTMATTER.match(text):
        spans.append((0, head.end()))
        at = head.end()
    opened = None
    for line in re.finditer(r"[^\n]*(?:\n|\Z)", text[at:]):
        body = line.group().removesuffix("\n")
        start, stop = at + line.start(), at + line.start() + len(body)
        if opened:
            begin, sign, size = opened
            if re.fullmatch(rf"[ \t]{{0,3}}{re.escape(sign)}{{{size},}}[ \t]*", body):
                spans.append((begin, stop))
                opened = None
        elif m := FENCE.match(body):
            opened = (start, m.group(1)[0], len(m.group(1)))
    if opened:
        spans.append((opened[0], len(text)))
    return spans


def merge_spans(spans) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def ignored_spans(text: str, dialogue: Iterable[re.Pattern] = ()) -> list[tuple[int, int]]:
    """Zones of a normalised text that are no prose, in code points; dialogue: patterns of speech that is left out as well."""
    if not any(s in text for s in SIGNS):
        return []
    found = _blocks(text)
    for p in (*INLINE, *dialogue):
        found += [m.span() for m in p.finditer(text)]
    return merge_spans(found)
