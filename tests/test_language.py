import pytest

from plumeline.language import french
from plumeline.language.french import alt_stem, build_verb_table, regular_forms, stem, verb_forms, verb_table
from plumeline.settings import Settings, folder_list, word_list
from plumeline.sources.lexicon import compile_entries, default_lexicon, parse_lexicon, write_default_lexicon

STEMS = """regardait regard regarda regard regardèrent regard sourire sourir sourit sour souriait souri tellement tel
continuellement continuel heureusement heureux yeux yeux œil œil nationalité national nationalisme national chevaux cheval
bijoux bijou balais balais mauvais mauvais déplais déplais voyage voyag envoyer envoi payer pai quoique quoiqu équipe équip
vieille vieil tapis tapis colis colis paris paris parie pari niais niais nierais nier joyeuse joyeux naïve naïv aiguë aigu
maisonnette maisonnet conquérant conquer abaissement abaissement fabrication fabriqu logiquement logiqu activement activ
finissaient fin finissons fin chantons chanton chanteuse chanteux amoureusement amour pommier pommi fermeté fermet
question question quelle quel aujourd aujourd""".split()


@pytest.mark.parametrize(("word", "expected"), list(zip(STEMS[::2], STEMS[1::2], strict=True)))
def test_stems(word, expected):
    assert stem(word) == expected


def test_stem_never_fails():
    for w in ("", "a", "e", "s", "qu", "ïë", "y", "ss", "ment", "ions", "eais", "日本", "naïveté" * 50):
        assert isinstance(stem(w), str)


def test_second_stems():
    assert alt_stem("mangeons") == "mang"
    assert alt_stem("plaçons") == "plac"
    assert alt_stem("passions") is None and alt_stem("faisons") is None and alt_stem("maison") is None


def test_verbs():
    t = verb_table()
    assert {t[w] for w in ("fait", "faisons", "ferai", "fîmes")} == {"faire"}
    assert t["relit"] == "relire" and "lit" not in t and t["paraitre"] == "paraître" and t["écrivait"] == "écrire"
    table, clashes = build_verb_table([{"infinitive": "un", "present": "x y"}, {"infinitive": "deux", "present": "x z"}])
    assert clashes == {"x"} and table["y"] == "un" and "x" not in table
    assert "commençait" in verb_forms("commencer") and "mangeons" in regular_forms("manger") and verb_forms("finir") is None
    assert "suis" in verb_forms("être") and len(french.STOPWORDS) == 186


def test_settings():
    s = Settings.from_dict({"window": 5, "max_ngram": "9", "echo_rarity": None, "echo_reach": 0, "weak_threshold": "x", "weak_disabled": ["a", 3], "weak_note": "  "})
    assert (s.window, s.max_ngram, s.echo_rarity, s.echo_reach, s.weak_threshold, s.weak_disabled, s.weak_note) == (20, 4, 2, 0, 3, ("a",), "mots-faibles.md")
    assert Settings.from_dict({"window": 0}).window == 80 and Settings.from_dict({"echo_reach": 7}).echo_reach == 5000 and Settings.from_dict(None) == Settings()
    assert word_list("Un, deux;trois\n un") == {"un", "deux", "trois"}
    assert folder_list("  ./Roman//A/ \n\n\\B\\c\r\n/") == ["roman/a", "b/c"]


def test_lexicon(tmp_path):
    lex = parse_lexicon("---\na: b\n---\n# Titre\nmot\n## Été (seuil 2)\n> non\n- un, deux ; trois\nsauf: quatre\n### Été\ncinq\n## Vide\n")
    assert [(f.id, f.label, f.threshold, f.entries, f.exceptions) for f in lex.families] == [
        ("ete", "Été", 2, ["un", "deux", "trois"], ["quatre"]), ("ete-2", "Été", None, ["cinq"], [])
    ]
    d = default_lexicon()
    assert [len(f.entries) for f in d.families] == [10, 1, 10, 11, 8] and [f.threshold for f in d.families] == [None, 3, 6, 2, None] and len(d.families[1].exceptions) == 75
    assert max(len(e.elements) for e in compile_entries(d)) == 4
    assert write_default_lexicon(str(tmp_path / "a/note.md")) and not write_default_lexicon(str(tmp_path / "a/note.md"))
