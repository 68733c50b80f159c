"""The analysis in one pass: cases, and the same rows as the relations on DataFrames."""

import itertools
import random
import time

import pytest

from plumeline.language.base import Language, resolve
from plumeline.language.french import FRENCH
from plumeline.operators.columnar import Analyser
from plumeline.plans.analyze import Relational, analyze, levels
from plumeline.settings import Settings
from plumeline.sources.lexicon import Lexicon, parse_lexicon
from plumeline.streaming import versions

FILL = ["".join(p) for p in itertools.product("bcdfgh", "aeiou", "lmnrt", "aeiou", "kvxz")]


def filler(n, start=0):
    return " ".join(FILL[start : start + n])


def found(text, common=None, lexicon=None, explain=True, language=FRENCH, **settings):
    lex = parse_lexicon(lexicon if lexicon is not None else FRENCH.lexicon)
    out = Analyser(Settings(**settings), lex, language, dict(FRENCH.common if common is None else common), True, explain)([text])
    return out.to_dict("records")


def marks(text, **how):
    return [(r["surface"], r["category"], r["intensity"]) for r in found(text, **how)]


def twice(word, category, level):
    return [(word, category, level)] * 2


CASES = [
    (f"fleuve {filler(15)} fleuve", {}, twice("fleuve", "repetition", 3)),
    (f"fleuve {filler(16)} fleuve", {"window": 80}, twice("fleuve", "repetition", 2)),
    (f"fleuve {filler(40)} fleuve", {}, twice("fleuve", "repetition", 1)),
    (f"fleuve {filler(79)} fleuve", {}, twice("fleuve", "repetition", 1)),
    (f"fleuve {filler(80)} fleuve", {}, twice("fleuve", "echo", 3)),
    (f"fleuve {filler(80)} fleuve", {"echoes": False}, []),
    (f"fleuve {filler(9)} fleuve", {"enabled": False, "echoes": False}, []),
    (f"fleuve {filler(9)} fleuve", {"enabled": False}, twice("fleuve", "echo", 3)),
    (f"fleuve {filler(9)} fleuve", {"extra_ignored_words": "Fleuve"}, []),
    (f"maison {filler(200)} maison", {}, []),
    (f"fleuve {filler(1200)} fleuve", {"echo_reach": 1000}, []),
    (f"fleuve {filler(1200)} fleuve", {"echo_reach": 0}, twice("fleuve", "echo", 3)),
    (f"mangeait {filler(9)} mangeons", {}, [("mangeait", "repetition", 2), ("mangeons", "repetition", 2)]),
    (f"mangeait {filler(9)} mangeons", {"use_stemming": False, "echoes": False}, []),
    (f"un fleuve {filler(3)} le fleuve", {"weak_words": False}, twice("fleuve", "repetition", 3)),
    ("à peine entré, à peine sorti", {"weak_words": False}, twice("à peine", "repetition", 3)[:0] + [("peine", "repetition", 3)] * 2),
    ("sur le grand pont. sur le grand pont", {"weak_words": False}, twice("sur le grand pont", "repetition", 3)),
    ("pont rouge pont rouge pont rouge", {"max_ngram": 2}, [("pont rouge pont rouge pont rouge", "repetition", 3)]),
    (f"elle vit Lausanne {filler(3)} puis Lausanne", {}, []),
    (f"elle vit Lausanne {filler(3)} puis Lausanne", {"ignore_proper_names": False}, twice("Lausanne", "repetition", 3)),
    (f"fleuve %% fleuve %% {filler(90)}", {}, []),
    (f"— Le fleuve.\n{filler(3)} fleuve", {"ignore_dialogue": True}, []),
    (f"— Le fleuve.\n{filler(3)} fleuve", {}, twice("fleuve", "repetition", 3)),
    ("truc et chose", {"weak_threshold": 1}, [("truc", "weak", 1), ("chose", "weak", 1)]),
    ("soudain, alors, puis, soudain", {}, [("soudain", "repetition", 3), ("alors", "weak", 2), ("puis", "weak", 2), ("soudain", "repetition", 3)]),
    ("lentement, doucement, rapidement", {}, [("lentement", "weak", 1), ("doucement", "weak", 1), ("rapidement", "weak", 1)]),
    ("lentement, vêtement, moment, ciment", {}, []),
    ("", {}, []),
    ("… !", {}, []),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_case(k):
    text, settings, expected = CASES[k]
    assert marks(text, **settings) == expected


def test_default_finds_echoes_whatever_stands_beside(spark):
    """Two uses of a rare word, 100 words apart, alone and among other documents."""
    text = f"Un reflet chatoyant. {filler(100)} Un tissu chatoyant."
    alone = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    first = analyze(alone).collect()
    assert [r.surface for r in first] == ["chatoyant"] * 2 and {r.category for r in first} == {"echo"} and time.time() - began < 20
    more = spark.createDataFrame([(1, text), (2, f"chatoyant {text}"), (3, None), (4, "")], "doc_id long, text string")
    assert sorted(r for r in analyze(more).collect() if r.doc_id == 1) == sorted(first)


def test_masked_text_costs_no_more():
    """A long text with code spans takes about as long as without (it was quadratic once)."""
    long = filler(3000) + " " + filler(3000)

    def seconds(text):
        began = time.time()
        found(text * 10, explain=False)
        return time.time() - began

    seconds(long)
    assert seconds(long + " `c` ") < 5 * seconds(long) + 1


def corpus(seed, n):
    r = random.Random(seed)
    pool = ["fleuve", "fleuves", "mange", "mangeait", "mangeons", "faire", "fait", "fera", "chose", "truc", "très", "plutôt", "Paul", "Été", "l’ombre", "cœur", "de", "la", "le", "un", "rouge", "lentement", "doucement", "quelque", "soudain", "tout", "coup", "à", "être", "en", "train"]
    rare = FILL[:300]
    out = []
    for _ in range(n):
        words = []
        for _ in range(r.randint(0, 260)):
            x = r.choice(pool) if r.random() < 0.4 else r.choice(rare)
            words.append(x + r.choice(["", "", "", "", ",", ".", "\n", " %%caché%%", " `a b`", " —", "…"]))
        if r.random() < 0.5 and len(words) > 5:
            at = r.randrange(len(words) - 4)
            words += [r.choice(rare) for _ in range(r.choice([5, 90]))] + words[at : at + 4]
        out.append(" ".join(words))
    return [*out, "", None, "---\ntags: a\n---\nfleuve fleuve", "fleuve"]


@pytest.mark.parametrize("settings", [Settings(), Settings(window=20, weak_threshold=1, max_ngram=3, weak_disabled=("mots-vagues",), echo_reach=0, ignore_dialogue=True), Settings(enabled=False, use_stemming=False)], ids=["default", "other", "echoes alone"])
def test_same_as_relations(spark, settings):
    docs = spark.createDataFrame(list(enumerate(corpus(11, 14))), "doc_id long, text string")
    common = {"fleuv": 2, "ombr": 3, "coeur": 3, "chos": 3, FILL[0]: 1, FILL[5]: 3}
    table = spark.createDataFrame(list(common.items()), "stem string, level int")
    with Relational(docs, settings, common=table) as plan:
        want = sorted(map(tuple, plan.highlights().select("doc_id", "begin", "stop", "surface", "category", "family", "intensity", "color", "target_begin", "target_stop", "explanation.text", "explanation.link_from", "explanation.link_to").collect()), key=str)
    rows = analyze(docs, settings, common=common)
    got = sorted(map(tuple, rows.select("doc_id", "begin", "stop", "surface", "category", "family", "intensity", "color", "target_begin", "target_stop", "explanation.text", "explanation.link_from", "explanation.link_to").collect()), key=str)
    assert got == want and len(got) > 50


def test_flags_and_scope(spark):
    docs = spark.createDataFrame([(1, "fleuve fleuve", "a/x.md", {"tags": ["plumeline-ignorer"]}), (2, "fleuve fleuve", "b/x.md", {}), (3, "fleuve fleuve", "a/y.md", None)], "doc_id long, text string, path string, fm map<string, array<string>>")
    assert analyze(docs, Settings(enabled=False, echoes=False, weak_words=False)).count() == 0
    assert {r.doc_id for r in analyze(docs, Settings(excluded_folders="b"), path="path", frontmatter="fm").collect()} == {3}
    assert {r.doc_id for r in analyze(docs, Settings(), frontmatter="fm").collect()} == {2, 3}


def test_language():
    plain = Language(name="xx", stem=lambda w: w, stopwords=frozenset({"the"}))
    rows = found(f"river {filler(3)} rivers {filler(3, 50)} the river the", lexicon="", common={}, language=plain)
    assert [r["surface"] for r in rows] == ["river", "river"] and resolve("xx") is FRENCH and levels(None, plain) == {}
    assert Lexicon([]).families == parse_lexicon(plain.lexicon).families


def test_stream(spark, tmp_path):
    """The last version of each document of a batch, in scope, with a lexicon that is read anew; nothing stays cached."""
    source = str(tmp_path / "in")
    rows = [(1, 1, "fleuve fleuve", "a/x.md"), (1, 2, "rivage rivage", "a/x.md"), (2, 1, "truc", "a/y.md"), (3, 1, "fleuve fleuve", "b/z.md")]
    schema = "doc_id long, version long, text string, path string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    seen, asked = [], []

    def lexicon():
        asked.append(1)
        return parse_lexicon("## Vague (seuil 1)\ntruc")

    def sink(df, number):
        seen.extend((r.doc_id, r.surface) for r in df.collect())

    query = versions.run(spark.readStream.schema(schema).parquet(source), sink, Settings(excluded_folders="b"), lexicon, checkpoint=str(tmp_path / "check"), trigger={"availableNow": True}, path="path")
    query.awaitTermination(120)
    assert sorted(seen) == [(1, "rivage"), (1, "rivage"), (2, "truc")] and asked
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_stable_colors(spark, tmp_path):
    """Families keep their colour from version to version; weak families keep the one they have."""
    source = str(tmp_path / "in")
    schema = "doc_id long, version long, begin int, stop int, family string, category string, color int"
    rows = [(1, 1, 0, 3, "a", "repetition", None), (1, 1, 5, 8, "b", "echo", None), (1, 1, 9, 12, "w", "weak", 7), (1, 2, 0, 3, "b", "echo", None), (1, 2, 4, 6, "c", "echo", None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    out = versions.stable_colors(spark.readStream.schema(schema).parquet(source))
    query = out.writeStream.format("memory").queryName("painted").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.version, r.family): r.color for r in spark.table("painted").collect()}
    assert got[1, "w"] == 7 and got[1, "b"] == got[2, "b"] and got[1, "a"] != got[1, "b"] != got[2, "c"]


def test_scope_changes(spark):
    seen = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "tag"), (2, 1, "folder")], "doc_id long, version long, exclusion string")
    assert sorted((r.doc_id, r.version) for r in versions.scope_changes(seen).collect()) == [(1, 1), (1, 3), (2, 1)]


def test_phrase_echoes_in_one_pass(spark, tmp_path):
    """The query finds in one pass, without a shuffle, what the relations find."""
    from plumeline.operators import echo
    from plumeline.plans import queries
    from plumeline.plans.analyze import marked_tokens, phrase_echoes

    far = " ".join(f"mot{i} autre{i}." for i in range(400))
    again = "le zibeline du crépuscule"
    rows = [(1, f"Voici {again} violet. {far} Encore {again} violet."), (2, None), (3, f"{far} {far}"), (4, ""), (5, f"Un mot. {again}. {far} {again}. {far} {again}.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = queries.docs(spark, str(tmp_path))
    got = queries.q_phrase_echoes(spark, str(tmp_path))
    want = echo.extend(echo.phrase_echo_starts(marked_tokens(docs, queries.S, None), queries.S)).select(*got.columns)
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "hashpartitioning" not in got._jdf.queryExecution().toString()
    # words as common as the rarity allows are no echoes of their own, yet make rare phrases
    known = {"zibelin": 2, "crépuscul": 2, "violet": 2}
    table = spark.createDataFrame(sorted(known.items()), "stem string, level int")
    mine = sorted(map(tuple, phrase_echoes(docs, queries.S, known).collect()))
    other = echo.extend(echo.phrase_echo_starts(marked_tokens(docs, queries.S, table), queries.S))
    assert len(mine) >= 4 and mine == sorted(map(tuple, other.select("doc_id", "idx", "size", "other", "rarest").collect()))
