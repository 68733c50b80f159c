"""Line dedup, mixing and sharding: brute force, edges, and no Python in the plan."""

import contextlib
import io
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumeline.llm import line_dedup, mixing, sharding

BASE = "the quick brown fox jumps over the lazy dog while seven wizards box with five dozen liquor jugs in the cold morning"
EDGES = [(1, None), (2, ""), (3, "\n\n"), (None, "abc"), (4, BASE), (4, BASE), (5, BASE + "\n" + BASE.replace("seven", "eight")), (6, "x" * 20000 + "\nhi\n" + "kept line of its own here"), (7, "日本語の文章がここにあります。日本語の文章")]


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def jaccard(a, b):
    x, y = ({s[i : i + 9] for i in range(len(s)) if i == 0 or s[i - 1] == " "} for s in (a, b))
    return len(x & y) / len(x | y)


def test_line_dedup(make):
    docs = make(EDGES)
    got = {(r.doc_id, r.n_lines): r.kept for r in line_dedup.decisions(docs).collect()}
    assert got[1, 0] == [] and got[2, 1] == [0] and got[3, 3] == [0, 1, 2] and got[None, 1] == [0] and got[4, 1] == [0]
    assert jaccard(BASE, BASE.replace("seven", "eight")) >= 0.8 and got[5, 2] == [] and got[6, 3] == [0, 1, 2] and got[7, 1] == [0]
    assert "Python" not in plan(line_dedup.verified_pairs(docs)) + plan(line_dedup.lines(docs))


def grams(text, n=5):
    return {text[i : i + n] for i in range(max(len(text) - n, 0) + 1)}


def test_line_dedup_verifies_every_position(make):
    """Two words of 23 differ: by pieces at word starts the lines are not alike, by all pieces of 5 characters they are."""
    one = "photographers everywhere celebrated extraordinary constellations while a an international correspondents documented unbelievable transformations throughout mountainous neighbourhoods"
    two = one.replace(" a an ", " i on ")
    x, y = grams(one), grams(two)
    assert len(x & y) / len(x | y) >= 0.8 and jaccard(one, two) < 0.8
    docs = make([(1, one), (2, two), (3, "日本語の文章がここにあります😀 \U0001f600x")])
    assert {r.doc_id: r.kept for r in line_dedup.decisions(docs).collect()} == {1: [0], 2: [], 3: [0]}
    for r in line_dedup.lines(docs).select("line", F.size(line_dedup.grams(F.col("line"))).alias("n")).collect():
        assert r.n == len(grams(r.line))


def test_line_dedup_reads_whole_words(make):
    """Lines without spaces that begin alike are different lines; a near copy of one, and of a short line, goes."""
    urls = ["https://www.alpha.org/a", "https://www.zeta.com/q?id=9", "https://www.museum-of-early-instruments.net/visit/opening-hours?season=winter"]
    rows = ["2024-01-03\t17\tparis\tcold", "2024-01-09\t4512\tlima\tdry and warm", "2024-01-0,1,2,3", "2024-01-0|alpha|beta|gamma"]
    docs = make([(i, x) for i, x in enumerate(urls + rows)] + [(20, urls[2] + "s"), (21, "abcdefghi"), (22, "abcdefghij")])
    got = {r.doc_id: r.kept for r in line_dedup.decisions(docs).collect()}
    assert got == {i: [0] for i in range(7)} | {20: [], 21: [0], 22: []}


def test_line_dedup_compares_all_of_a_bucket(make, monkeypatch):
    """Near copies behind an opening that all lines share are found, however many lines share it."""
    monkeypatch.setattr(line_dedup, "NEAR", 1)
    monkeypatch.setattr(line_dedup, "BLOCK", 16, raising=False)
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=7))
    opening = " ".join(word() for _ in range(45))
    rows = []
    for i in range(40):
        own = " ".join(word() for _ in range(25))
        rows += [(2 * i, f"{opening} {own}"), (2 * i + 1, f"{opening} {own} x{i}")]
    got = {r.doc_id: r.kept for r in line_dedup.decisions(make(rows)).collect()}
    assert got == {i: [0] if i % 2 == 0 else [] for i in range(80)}


def test_line_dedup_fetches_lines_with_candidates(make, monkeypatch):
    """Of a large bucket's lines only those with a candidate in it are fetched and sketched, and near copies among them are found."""
    monkeypatch.setattr(line_dedup, "NEAR", 1)
    made, cut = {}, line_dedup.cut

    def counting(df, name):
        out = cut(df, name)
        made[name] = out.where("size > 2").select("h").distinct().count() if name == "line-members" else out.count()
        return out

    monkeypatch.setattr(line_dedup, "cut", counting)
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=7))
    opening = " ".join(word() for _ in range(4))
    lines = [f"{opening} {' '.join(word() for _ in range(50))}" for _ in range(4000)]
    docs = make([*enumerate(lines), *((10000 + i, f"{lines[i]} and") for i in range(0, 4000, 100))])
    got = {x.doc_id: x.kept for x in line_dedup.decisions(docs).collect()}
    assert got == {i: [0] for i in range(4000)} | {10000 + i: [] for i in range(0, 4000, 100)}
    assert made["line-members"] > 200 and sum(made.get(name, 0) for name in ("line-texts", "line-texts-added")) < 0.95 * made["line-members"]


def test_line_dedup_pairs_of_a_family(make, monkeypatch):
    """Of lines with one origin that are not alike enough hardly a pair is left to verify, and sketches differ in no more bits
    than the sets have members apart."""
    counts, cut = {}, line_dedup.cut

    def counting(df, name):
        out = cut(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "cut", counting)
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=7))
    base = [word() for _ in range(60)]
    lines = [" ".join(word() if r.random() < 0.12 else w for w in base) for _ in range(60)]
    assert not any(len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b)) for i, a in enumerate(lines) for b in lines[:i])
    docs = make(list(enumerate(lines)))
    assert all(r.kept == [0] for r in line_dedup.decisions(docs).collect())
    assert counts["line-near"] > 60 and sum(counts.get(name, 0) for name in ("line-far", "line-best", "line-rest")) < 60
    found = line_dedup.lines(docs).select("h", "line").collect()
    sketch = {x.h: x for x in line_dedup._sketched(line_dedup.lines(docs).select("h", "line")).collect()}
    for x, y in zip(found, found[1:]):
        p, q = sketch[x.h], sketch[y.h]
        unlike = sum(((p[f"s{k}"] ^ q[f"s{k}"]) & (2**64 - 1)).bit_count() for k in range(line_dedup.WORDS))
        apart = len(grams(x.line) ^ grams(y.line))
        assert p.n == len(grams(x.line)) and 0.6 * apart < unlike <= apart


def test_line_dedup_verifies_few_pairs_of_copies(make, monkeypatch):
    """Of a family of near copies each line's likeliest pair is verified, then one of each two components, not all pairs."""
    pairs, close = [], line_dedup._close

    def counting(found, texts, threshold):
        pairs.append(found.count())
        return close(found, texts, threshold)

    monkeypatch.setattr(line_dedup, "_close", counting)
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=7))
    base = [word() for _ in range(80)]
    rows = []
    for i in range(60):
        words = list(base)
        words[r.randrange(80)] = word()
        rows.append((i, " ".join(words)))
    assert all(len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b)) for _, a in rows for _, b in rows)
    got = {x.doc_id: x.kept for x in line_dedup.decisions(make(rows)).collect()}
    assert got == {i: [0] if i == 0 else [] for i in range(60)} and sum(pairs) < 200


def test_line_dedup_codes(spark):
    """Codes of signatures lose no two that have enough values in common, and pass few others."""
    r = random.Random(9)
    rows, want = [], []
    for _ in range(400):
        a, b = ({k: r.randrange(1 << 27) for k in range(line_dedup.BINS) if r.random() < 0.8} for _ in "ab")
        b |= {k: a[k] for k in a if r.random() < 0.35}
        common = sum(a[k] == b.get(k) for k in a)
        want.append(common * (1 + line_dedup.AGREE) >= line_dedup.AGREE * (len(a) + len(b)) - 1e-9)
        rows.append([sum(1 + x[k] % 255 << 8 * (k // 2) for k in x if k % 2 == odd) for x in (a, b) for odd in (0, 1)])
    d = spark.createDataFrame(rows, "ac0 long, ac1 long, bc0 long, bc1 long")
    got = [x.ok for x in d.select(line_dedup._agree("a", "b").alias("ok")).collect()]
    assert 50 < sum(want) < 350 and all(g for g, w in zip(got, want) if w) and sum(g and not w for g, w in zip(got, want)) < 10


def test_line_dedup_documents(make):
    docs = make(EDGES).withColumn("h", F.lit("mine"))
    out = line_dedup.dedup(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert Counter(r.doc_id for r in rows) == Counter([1, 2, 3, None, 4, 4, 6, 7]) and all(r.h == "mine" for r in rows)
    assert line_dedup.decisions(make([]).limit(0)).count() == 0


def test_mix(make):
    rows = [(i, " ".join(["w"] * (i % 9)), None, s) for s, n in (("a", 300), ("b", 20), (None, 15)) for i in range(n)]
    docs = mixing.sized(make(rows))
    got = mixing.plan(docs, block=16).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    for s in ("a", "b", None):
        mine = [r for r in got if r.source == s]
        assert sum(r.taken for r in mine) == int(mine[0].target + 0.5) and mine[0].source_size == sum(r.size for r in mine)
    total = sum(r.size for r in got)
    targets = {r.source: r.target for r in got}
    assert sum(targets.values()) == pytest.approx(min(1.5 * total, 2 * total))
    assert targets["b"] == pytest.approx(2 * sum(r.size for r in got if r.source == "b"))
    again = mixing.plan(docs.repartition(5), block=16).collect()
    assert sorted((r.doc_id, r.source or "", r.taken) for r in got) == sorted((r.doc_id, r.source or "", r.taken) for r in again)
    assert mixing.plan(docs.limit(0)).count() == 0


def test_mix_schedule(make, monkeypatch):
    """The schedule decides: every prefix of the written rows holds the sources near their weights, and another sequence gives
    another order."""
    rows = [(i, " ".join(["w"] * 8), None, s) for k, s in enumerate("abc") for i in range(1000 * k, 1000 * k + 400)]
    docs = make(rows)
    order = [r.source for r in mixing.mix(docs, block=16).collect()]
    for end in range(100, len(order), 100):
        share = Counter(order[:end])
        assert all(abs(share[s] / end - order.count(s) / len(order)) < 0.03 for s in "abc")
    slots = {r.doc_id: (r.slot0, r.slot1) for r in mixing.plan(mixing.sized(docs), block=16).collect()}
    monkeypatch.setattr(mixing, "GOLDEN", 1)
    other = {r.doc_id: (r.slot0, r.slot1) for r in mixing.plan(mixing.sized(docs), block=16).collect()}
    assert slots.keys() == other.keys() and sum(slots[k] != other[k] for k in slots) > 1000


def test_mix_rows_alike(make):
    """Rows alike and null ids are rows apart."""
    docs = make([(None, "one two three", None, "a")] * 3 + [(1, "four", None, "b")])
    out = mixing.mix(docs, block=2).collect()
    taken = Counter(r.text.strip() for r in out)
    assert sum(len(r.text.split()) for r in out if r.source == "a") <= 18 and sum(len(r.text.split()) for r in out) == 15 and taken


def test_mix_documents(make):
    docs = make([(1, "one two  three\nfour", "en", "a"), (2, None, "en", "b"), (3, "", None, None)])
    out = mixing.mix(docs, block=2)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sum(len(r.text.split()) for r in rows) == 6 and [r.doc_id for r in mixing.mix(docs.selectExpr("*", "7 as from0", "8 as k1", "9 as place"), block=2).where("from0 = 7 and k1 = 8 and place = 9").collect()] == [1, 1] and {r.doc_id for r in rows} == {1} and any(r.text == "one two  three\nfour" for r in rows)


def test_shards(make):
    rows = [(i, f"text {i % 7}") for i in range(500)] + [(None, None), (3, "text 3")]
    d = make(rows).select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("c"))
    got = sharding.shard(d, "doc_id", [1.0] * 8, ["c"], cells=4).withColumn("g", sharding.rendezvous(F.col("doc_id"), [1.0] * 9)).collect()
    assert len(got) == len(rows) and all(r.g in (r.shard, 8) for r in got) and any(r.g == 8 for r in got)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    named = d.limit(5).selectExpr("*", "1 as start", "2 as cell", "3 as n")
    assert [(r.start, r.cell, r.n) for r in sharding.shard(named, "doc_id", [1.0] * 2).collect()] == [(1, 2, 3)] * 5
    nulls = make([(None, f"t{i}") for i in range(60)]).select("doc_id", F.crc32(F.col("text").cast("binary")).alias("c"))
    assert len({r.shard for r in sharding.shard(nulls, "doc_id", [1.0] * 8, ["c"]).collect()}) == 1
    heavy = Counter(r.s for r in d.select(sharding.rendezvous(F.col("doc_id"), [1.0, 3.0]).alias("s")).collect())
    assert 0.6 < heavy[1] / len(rows) < 0.9 and zlib.crc32(b"") == next(r.c for r in got if r.doc_id is None)
    assert sharding.shard(d.limit(0), "doc_id", [1.0]).count() == 0


def test_line_dedup_against_brute_force(make):
    """Components of random lines with scattered edits, short and long, repeated within and between documents."""
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghijklmnoprstuvw", k=r.randint(2, 9)))
    rows, texts = [], []
    for _ in range(60):
        base = " ".join(word() for _ in range(r.choice([1, 2, 4, 8, 20, 60])))
        for _ in range(r.randint(1, 4)):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 40))):
                t[r.randrange(len(t))] = r.choice("xyz ")
            texts.append("".join(t))
    texts += ["ha " * 15, "ha " * 60, "x" * 20, "x" * 200]
    r.shuffle(texts)
    rows = [(i, "\n".join(texts[i : i + 3])) for i in range(0, len(texts), 3)]
    sets = {t: grams(t) for t in texts if len(t) >= 5}
    links = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}
    root = {t: t for t in sets}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in links:
        root[top(a)] = top(b)
    want, seen = {}, set()
    for i, t in rows:
        keep = []
        for pos, line in enumerate(t.split("\n")):
            if line not in sets or top(line) not in seen:
                keep.append(pos)
                if line in sets:
                    seen.add(top(line))
        want[i] = keep
    got = {x.doc_id: x.kept for x in line_dedup.decisions(make(rows)).collect()}
    assert len(links) > 30 and sum(got[i] == want[i] for i in want) >= 0.97 * len(want)


def test_line_dedup_names(make):
    docs = make([(1, BASE), (2, BASE)]).selectExpr("*", "1 as h", "2 as kept", "3 as th", "4 as places")
    out = line_dedup.dedup(docs)
    assert out.columns == docs.columns and [(r.doc_id, r.h, r.kept, r.th, r.places) for r in out.collect()] == [(1, 1, 2, 3, 4)]
