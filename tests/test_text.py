from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumeline.functions.text import ignored_spans, merge_spans, normalize, thousands, utf16_offset
from plumeline.language.french import FRENCH
from plumeline.operators.colors import assign
from plumeline.operators.tokens import tokens
from plumeline.streaming.versions import map_offsets


def zones(t, **how):
    return [t[a:b] for a, b in ignored_spans(t, **how)]


def test_zones():
    assert zones("---\na: b\n---\ntexte") == ["---\na: b\n---"]
    assert zones("---\na: b\ntexte") == []
    assert zones("a\n```x\ncode\n````\nb") == ["```x\ncode\n````"]
    assert zones("a\n~~~\ncode") == ["~~~\ncode"]
    assert zones("a `c` b $$x$$ c %%y%% <!-- z -->") == ["`c`", "$$x$$", "%%y%%", "<!-- z -->"]
    assert zones("[[note]] [[cible|vu]] [mot](lien) ![[x.png]] https://a.b/c d") == ["[[cible|", "](lien)", "![[x.png]]", "https://a.b/c"]
    assert zones("— Oui.\n«non» et", dialogue=FRENCH.dialogue) == ["— Oui.", "«non»"] and zones("— Oui.") == []
    assert merge_spans([(5, 7), (0, 2), (2, 3), (1, 2)]) == [(0, 3), (5, 7)]


def test_tokens(spark):
    text = "L’homme dit-il : « Oui, Paul ! » %%caché\n%% Été\nfin"
    rows = tokens(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).orderBy("idx").collect()
    assert [r.norm for r in rows] == ["l", "homme", "dit", "il", "oui", "paul", "été", "fin"]
    assert all(text.replace("’", "'")[r.begin : r.stop] == r.surface for r in rows)
    assert [r.capitalized for r in rows] == [True, False, False, False, True, True, True, False]
    assert [r.sentence_start for r in rows] == [True, False, False, False, True, False, True, True]
    assert [r.segment for r in rows] == [1, 1, 1, 1, 2, 2, 3, 4] and [r.paragraph for r in rows] == [0, 0, 0, 0, 0, 0, 1, 2]


def test_columns(spark):
    d = spark.createDataFrame([("l’a b",)], "t string").select(normalize(F.col("t")).alias("n"), thousands(F.lit(2960)).alias("m"), utf16_offset(F.lit("a😀b"), F.lit(2)).alias("u")).first()
    assert (d.n, d.m, d.u) == ("l'a b", "2 960", 3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(1, 9), st.sampled_from("abcdefghijklmnopqrs")), max_size=40))
def test_colors(found):
    spans, at = [], 0
    for gap, size, family in found:
        spans.append((at + gap, at + gap + size, family, None))
        at += gap + size
    memory = {}
    first = assign(spans, memory)
    assert all(0 <= c < 12 for c in first) and len({f for *_, f, _ in spans}) == len({(f, c) for (*_, f, _), c in zip(spans, first, strict=True)})
    assert assign(spans[1:], memory) == first[1:]
    assert len(memory) > 12 or len(set(memory.values())) == len(memory)


def test_offsets():
    assert map_offsets([(5, 8)], [(0, 0, 3)]) == [(8, 11)]
    assert map_offsets([(5, 8), (20, 22)], [(4, 9, 0)]) == [None, (15, 17)]
