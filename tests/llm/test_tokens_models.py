"""Token ids, files, packing, and the two classifiers."""

import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumeline.llm import bpe, packing, quality, simple8b, toxicity
from plumeline.llm.bpe import tokenizer, vocabulary

TEXTS = [None, "", "a", "Don't  stop\n\n now's 12 half ½", "naïve café 日本語 🙂", "<|endoftext|> as text", "word " * 3000, "x" * 5000, "a", "a"]


def ids_of(text):
    return tokenizer(vocabulary()).lib.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'stlrevmd  \n\té½1_!<|> ́漢🙂"), max_size=40), max_size=6))
def test_ids(texts):
    assert [x.tolist() for x in tokenizer(vocabulary()).each(texts)] == [ids_of(t) for t in texts]


@pytest.mark.parametrize("most_signs", [1 << 24, 400])
def test_ids_of_small_tables(monkeypatch, most_signs):
    """A table of few words or characters is thinned all the time; ids stay the library's."""
    monkeypatch.setattr(bpe, "MOST_SIGNS", most_signs)
    tok, rng = bpe.WordTokenizer(vocabulary(), most_words=64), random.Random(5)
    for k in range(60):
        texts = ["".join(rng.choice(" '\n\tab1é中😀.srevl~Ω") for _ in range(rng.choice((0, 1, 5, 40, 300)))) for _ in range(rng.randint(1, 12))]
        texts += ["x" * 5000 + "é" * 3000] * (k % 20 == 0)
        for text, ids in zip(texts, tok.each(texts), strict=True):
            assert ids.tolist() == tok.lib.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50256), st.integers(0, 2**64 - 1)), max_size=300), st.integers(1, 40))
def test_codec(ids, times):
    x = np.array(ids * times, np.uint64)
    assert (simple8b.decode(simple8b.encode(x)) == x).all()
    if len(x) > simple8b.BLOCK:
        assert (simple8b.decode(simple8b.encode(x), 1, 1) == x[simple8b.BLOCK : 2 * simple8b.BLOCK]).all()


def test_files(spark, make, tmp_path):
    rows = list(enumerate(TEXTS))
    random.Random(1).shuffle(rows)
    path = str(tmp_path / "ids")
    simple8b.write(make(rows).repartition(3), path, vocabulary(), chunk_ids=1000)
    got = {r.doc_id: r for r in simple8b.read(spark, path).collect()}
    at = 0
    for i, t in enumerate(TEXTS):
        ids = np.array([*ids_of(t), 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    simple8b.write(make(rows).limit(0), str(tmp_path / "none"), vocabulary())
    assert simple8b.read(spark, str(tmp_path / "none")).count() == 0


def test_packing(make):
    docs = make(list(enumerate(TEXTS)) + [(None, "no id")]).repartition(3)
    rows = packing.pack(docs, vocabulary(), length=64, most=2, fan=2).collect()
    for i, t in [*enumerate(TEXTS), (None, "no id")]:
        ids, at = np.array([*ids_of(t), 0], "<u4"), 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 64
    assert packing.pack(docs.limit(0), vocabulary()).count() == 0


def corpus(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = [r.choice(["tree", "house", "river", "stone", "cloud", "green", "walks", "under"]) for _ in range(r.randint(20, 150))]
        toxic = int(r.random() < 0.3)
        if toxic:
            words[r.randrange(len(words))] = "vile" + r.choice(["ness", "st", "ly", "r", ""])
        bad = int(r.random() < 0.3)
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words).capitalize() + "."
        out.append((i, text, "en", f"s{i % 3}", toxic, 1 - bad))
    return out


def labels(spark, rows):
    return spark.createDataFrame([(r[0], r[5], r[4]) for r in rows], "doc_id long, quality int, toxic int")


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data = toxicity.Indexed(["one two three four", "five six one"])
    rows, grams, owner = toxicity.features(data.words)
    y, w, keep = np.array([1.0, 0.0]), np.ones(2), np.ones(len(rows))

    def loss():
        x, mask = toxicity._laid(net.gates(net.word_vectors(rows, grams, owner, keep)), data.rows())
        p = toxicity._sigmoid(net.forward(x, mask)[0])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = net.gradients(rows, grams, owner, data.rows(), y, w, keep)
    for name in ("wx", "wh", "b", "att", "attv", "out"):
        at = tuple(rng.integers(0, s) for s in net.p[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-3
        up = loss()
        net.p[name][at] = old - 1e-3
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-3 - g[name][at]) < 1e-3, name


def test_toxicity_reads_long_runs_to_the_end():
    """What stands after the 40th character of a run without spaces is a word of its own."""
    run = "a" * 40 + "b" * 40 + "ccc"
    assert toxicity.Indexed([run]).words == ["a" * 40, "b" * 40, "ccc"]
    one, two = (set(toxicity.features(toxicity.Indexed([run + end]).words)[1].tolist()) for end in ("", "venomous"))
    assert len(two - one) > 5


def test_toxicity(spark, make):
    rows = corpus(400, 3)
    docs = make([r[:4] for r in rows] + [(9999, None, None, None), (9998, "", None, None)]).repartition(2)
    got = {r.doc_id: r for r in toxicity.score(docs, labels(spark, rows)).collect()}
    out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[r[0]].held_out for r in out) and len(got) == 402
    assert sum(got[r[0]].predicted == r[4] for r in out) >= 0.9 * len(out)
    assert got[9999].score == got[9998].score and got[9999].predicted == 0
    kept = toxicity.filtered(docs, labels(spark, rows))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted == 0}
    assert toxicity.score(docs.limit(0), labels(spark, rows)).count() == 0
    assert all(r.score < 0.01 for r in toxicity.score(docs, labels(spark, rows).limit(0)).collect())


def test_toxicity_trains_in_a_task(spark, make, monkeypatch):
    """The driver's process doesn't train: what that takes would stand beside a JVM that may have grown to its bound."""
    driver, train = os.getpid(), toxicity.train

    def elsewhere(texts, toxic):
        assert os.getpid() != driver
        return train(texts, toxic)

    rows = corpus(60, 3)
    docs = make([r[:4] for r in rows])
    sample = toxicity.labelled_sample(docs, labels(spark, rows), 1000)
    net, empty = train(*(sample.toPandas()[c].to_numpy() for c in ("text", "toxic")))
    monkeypatch.setattr(toxicity, "train", elsewhere)
    other, same = toxicity.trained(sample)
    assert same == empty and all(np.allclose(net.p[k], v, atol=1e-5) for k, v in other.p.items())
    assert toxicity.score(docs, labels(spark, rows)).count() == 60


def test_quality(spark, make):
    rows = corpus(300, 5)
    docs = make([r[:4] for r in rows] + [(9999, None, None, None)])
    got = {r.doc_id: r for r in quality.score(docs, labels(spark, rows).where("doc_id < 250")).collect()}
    out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(got) == 301 and sum(got[r[0]].predicted == r[5] for r in out) >= 0.9 * len(out)
    assert all(0 <= r.score <= 1 and 0 <= r.text_score <= 1 and 0 <= r.page_score <= 1 for r in got.values())
    assert quality.score(docs.limit(0), labels(spark, rows)).count() == 0
