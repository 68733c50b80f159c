"""Jaccard join, top-k and nearest neighbours against brute force."""

import random
from collections import Counter

import numpy as np

from plumeline.llm import hnsw, jaccard_join, topk_search


def brute(rows, threshold=0.8):
    s = jaccard_join.Shingler(5)
    sets = [set(s(t or "").tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [links[i] for i in range(len(rows))], [top(i) for i in range(len(rows))]


def test_links(make):
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [r.choice(words) for _ in range(120)]
    texts = [None, "", "!!!", "short one", "short one", "Short, one!"]
    for _ in range(150):  # a family of near copies, beyond one block
        t = list(base)
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice(words)
        texts.append(" ".join(t))
    texts += [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(60)]
    rows = list(enumerate(texts))
    links, root = brute(rows)
    got = {x.doc_id: x for x in jaccard_join.links(make(rows), bucket_block=40, cluster_block=32).collect()}
    assert len(got) == len(rows)
    assert [got[i].n_links for i in range(len(rows))] == links and [got[i].class_id for i in range(len(rows))] == root


def test_links_edges(make):
    rows = [(None, "a b c d e f g"), (5, "a b c d e f g"), (5, "a b c d e f g"), (6, "zz"), (7, None)]
    got = sorted((x.doc_id or -1, x.n_links) for x in jaccard_join.links(make(rows)).collect())
    assert got == [(-1, 2), (5, 2), (5, 2), (6, 0), (7, 0)]
    kept = jaccard_join.dedup(make(rows[1:]).repartition(2)).collect()
    assert sorted(x.doc_id for x in kept) == [5, 6, 7]
    long = "one two three four five six seven eight nine ten"
    rows = [(3, "a b c d e f g"), (5, "a b c d e f g"), (5, long), (8, "x y z u v w"), (8, "x y, z u v w"), (9, ""), (9, "")]
    docs = make(rows).selectExpr("*", "'mine' as k1", "1 as n", "true as once")
    kept = jaccard_join.dedup(docs)
    assert kept.columns == docs.columns and all(r.k1 == "mine" and r.n == 1 and r.once for r in kept.collect())
    assert sorted((x.doc_id, x.text[:3]) for x in kept.collect() if x.doc_id != 8) == [(3, "a b"), (5, "one"), (9, ""), (9, "")] and kept.where("doc_id = 8").count() == 1
    assert jaccard_join.links(make(rows).limit(0)).count() == 0


def vectors(spark, n, seed):
    x = np.random.default_rng(seed).standard_normal((n, 16))
    x[n // 2 : n // 2 + n // 4] = x[0]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(n, None), (n + 1, [float("nan")] * 16), (n + 2, [0.0] * 16), (None, [1.0] * 16), (n + 3, [1.0, 2.0])]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_top(spark):
    n = 400
    x, d = vectors(spark, n, 1)
    got = topk_search.search_top(d, d.where("vec_id % 20 = 0 and vec_id < 400"), 7, shard=120).collect()  # several shards
    z = np.vstack([np.floor(64 * x), np.zeros((1, 16))])
    ids = np.append(np.arange(n), n + 2)
    for q in range(0, n, 20):
        s = z @ z[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:7]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [(ids[i], s[i]) for i in order]


def test_neighbours(spark):
    n = 800
    x, d = vectors(spark, n, 2)
    got = hnsw.neighbours(d, d.where("vec_id % 50 = 0"), 10, shard=300).collect()  # several shards
    hits = 0
    for q in range(0, n, 50):
        s = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(n), s)) if i != q][:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert len(mine) == 10 and all(abs(r.score - s[r.vec_id]) < 1e-12 for r in mine)
        hits += len({r.vec_id for r in mine} & set(order))
    assert hits >= 0.9 * 10 * (n // 50)


def test_graph():
    """A search computes far fewer distances than there are nodes; level 0 is every id's, above it few are."""
    x = np.random.default_rng(3).standard_normal((3000, 8))
    index = hnsw.Index(hnsw.build(np.arange(3000), x))
    found = index.find(np.arange(0, 3000, 100), x[::100], 10)
    hits = sum(len(set(found[found["query_id"] == q]["vec_id"]) & set(np.argsort(((x - x[q]) ** 2).sum(axis=1))[1:11].tolist())) for q in range(0, 3000, 100))
    assert hits >= 0.95 * 300 and index.computed / 30 < 1000
    level = hnsw._levels(np.arange(100_000))
    assert level[0] < 4 and 0.05 < (level > 0).mean() < 0.08 and level.max() < 9


def test_stop_on_proof():
    """Where a few postings decide, a query stops before it has read all."""
    r = np.random.default_rng(2)
    x = np.zeros((4000, 16))
    x[:, :14] = r.integers(-2, 3, (4000, 14))
    x[np.arange(4000), r.integers(0, 16, 4000)] = r.integers(50, 4000, 4000)
    index = topk_search.Index(topk_search.build(np.arange(4000), x))
    got = index.find(np.arange(5), x[:5] / 64, 10)
    assert index.read < 0.9 * index.all
    for q in range(5):
        s = x @ x[q]
        assert got[got["query_id"] == q]["vec_id"].tolist() == [i for i in np.lexsort((np.arange(4000), -s)) if i != q][:10]


def test_levels_in_one_go(monkeypatch):
    """Behind the few queries that go ahead the others lay out no level for itself, and stop on the same proof."""
    r = np.random.default_rng(5)
    calls, between = [], topk_search.Index.between
    monkeypatch.setattr(topk_search.Index, "between", lambda self, j, k: calls.append((j, k)) or between(self, j, k))
    n = 100
    x = np.floor(64 * r.standard_normal((2000, 16)))  # no proof before the end
    index = topk_search.Index(topk_search.build(np.arange(2000), x))
    index.find(np.arange(n), x[:n] / 64, 10)
    ahead = len(calls)
    got = index.find(np.arange(n), x[:n] / 64, 10)
    assert index.levels == 16 and ahead <= 16 + 2 + 1 and len(calls) - ahead <= 16
    y = np.zeros((4000, 16))
    y[:, :14] = r.integers(-2, 3, (4000, 14))
    y[np.arange(4000), r.integers(0, 16, 4000)] = r.integers(50, 4000, 4000)
    few = topk_search.Index(topk_search.build(np.arange(4000), y))
    for v, found in ((x, got), (y, few.find(np.arange(n), y[:n] / 64, 10))):
        for q in range(n):
            s = v @ v[q]
            assert found[found["query_id"] == q]["vec_id"].tolist() == [i for i in np.lexsort((np.arange(len(v)), -s)) if i != q][:10]
    assert few.read < 0.9 * few.all
