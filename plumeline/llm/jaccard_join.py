"""Similarity join of documents on word n-grams: MinHash candidates, Bayesian pruning, exact Jaccard.

1. Each text becomes its set of 5-word shingles (64-bit hashes), the set's fingerprint and 128 MinHash values of 16 bits.
   Texts with one set are copies: they form a class and only one of them goes on.
2. Four values make a band, 32 bands a signature.  Classes that share a band's values meet in a bucket; buckets with a
   single class go.  A pair of similarity 0.8 misses all bands with probability 5e-8.
3. In a bucket (large ones in blocks) all pairs are compared by 16 values at a time, and a pair goes as soon as the
   posterior probability of similarity 0.8 falls below the tolerance.  Survivors give edges, edges give clusters.
4. In a cluster (large ones in blocks) pairs are pruned alike, and the rest are verified on the exact sets.  A block
   returns, for each of its classes, how many documents it links to and one edge of a spanning forest: never the pairs.
5. The components of these edges are the groups.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, drop_cut, fresh, row_key
from .components import components
from .groups import map_groups

WORDS = re.compile(r"[^\W_]+")
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 16
LEAN = "doc_id long, k1 long, k2 long, n int, fp long, fp2 long, sig array<long>"


@functools.cache
def _functions() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(9)
    return r.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, HASHES, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sorted distinct hashes of a text's word shingles; keeps the hashes of up to a million words."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, text: str) -> np.ndarray:
        """Words are runs of letters and digits in lower case.  A text with fewer words than the width has one shingle of
        all its words; one without words has none."""
        words = WORDS.findall(text.lower())
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                raw = w.encode("utf-8", "surrogatepass")
                h = known[w] = zlib.crc32(raw) << 32 | zlib.crc32(raw, 0x5BD1E995)
            out.append(h)
        h = _mix(np.array(out, np.uint64))
        k = min(self.width, len(h))
        total = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(total)])
        return np.unique(total)


def signature(s: np.ndarray) -> np.ndarray:
    """BANDS 64-bit values, each of ROWS 16-bit MinHash values.  Big sets go through in pieces."""
    a, b = _functions()
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 512):
        np.minimum(least, (s[i : i + 512, None] * a + b).min(axis=0), out=least)
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16).view(np.uint64)


@functools.cache
def needed(threshold: float, tolerance: float) -> list[int]:
    """How many of the first 16, 32, ... values must agree for a pair to stay: with m of n, and any similarity equally
    likely before, the posterior is Beta(m + 1, n - m + 1), whose tail from the threshold on is a binomial sum."""
    from math import comb

    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
        out.append(m)
    return out


def survivors(sig: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Of all pairs between rows left and right of sig (rows, HASHES), those that no step of the pruning drops.  left and
    right are alike (pairs inside, each once) or disjoint."""
    inside = len(left) == len(right) and left[0] == right[0]
    must = needed(threshold, tolerance)
    keep_i, keep_j = [], []
    for a in range(0, len(left), 128):
        part = left[a : a + 128]
        agree = np.zeros((len(part), len(right)), np.uint8)
        for k in range(STEP):
            agree += sig[part, k][:, None] == sig[right, k][None, :]
        ok = agree >= must[0]
        if inside:
            ok &= part[:, None] < right[None, :]
        i, j = np.nonzero(ok)
        count = agree[i, j].astype(np.int32)
        i, j = part[i], right[j]
        for s in range(1, len(must)):
            if not len(i):
                break
            count = count + (sig[i, s * STEP : (s + 1) * STEP] == sig[j, s * STEP : (s + 1) * STEP]).sum(axis=1)
            ok = count >= must[s]
            i, j, count = i[ok], j[ok], count[ok]
        keep_i.append(i)
        keep_j.append(j)
    return np.concatenate(keep_i), np.concatenate(keep_j)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Root (the smallest member) of each of n members under edges i, j."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (before == root).all():
            return root


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the exact Jaccard similarity of each pair reaches the threshold."""
    if not len(i):
        return np.zeros(0, bool)
    size = np.array([len(s) for s in sets], np.int64)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(size) - size
    mark = np.zeros(int(code.max()) + 1, bool)
    order = np.argsort(i, kind="stable")
    out = np.zeros(len(i), bool)
    cuts = np.append(np.flatnonzero(np.diff(i[order], prepend=-1)), len(order))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        x = int(i[order[a]])
        own = code[begin[x] : begin[x] + size[x]]
        mark[own] = True
        for c in range(a, b, 256):
            at = order[c : min(b, c + 256)]
            y = j[at]
            n = size[y]
            ends = np.cumsum(n)
            flat = np.repeat(begin[y] - (ends - n), n) + np.arange(int(ends[-1]))
            common = np.add.reduceat(mark[code[flat]].astype(np.int64), ends - n)
            out[at] = common >= threshold * (size[x] + n - common) - 1e-9
        mark[own] = False
    return out


def _lean(docs: DataFrame, width: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(width)
        for frame in frames:
            for a in range(0, len(frame), 1000):
                part = frame.iloc[a : a + 1000]
                sets = [shingles(t) for t in part["text"]]
                with np.errstate(over="ignore"):
                    one = [int(np.bitwise_xor.reduce(s).view(np.int64)) if len(s) else 0 for s in sets]
                    two = [int((s * np.uint64(0xD6E8FEB86659FD93) ^ (s >> np.uint64(32))).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
                sig = [signature(s).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "k1": part["k1"].to_numpy(), "k2": part["k2"].to_numpy(), "n": [len(s) for s in sets], "fp": one, "fp2": two, "sig": sig})

    one, two = row_key(F.col("doc_id"), F.col("text"))
    lean = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), one.alias("k1"), two.alias("k2"), F.coalesce("text", F.lit("")).alias("text"))
    return lean.mapInPandas(run, LEAN)


def _blocks(df: DataFrame, size: str, limit: int, keys: list[str]) -> DataFrame:
    """Deals each group's rows to blocks: a row of chunk x, of n chunks, goes to blocks (x, y) and (y, x) in their order."""
    chunks = F.ceil(F.col(size) / limit).cast("int")
    df = df.withColumn("chunks", chunks).withColumn("x", F.pmod(F.xxhash64("c"), F.col("chunks")).cast("int"))
    df = df.withColumn("y", F.explode(F.expr("sequence(0, chunks - 1)")))
    return df.withColumns({"bi": F.least("x", "y"), "bj": F.greatest("x", "y")}).drop("chunks", "y", size)


def _sides(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    bi, bj = int(frame["bi"].iloc[0]), int(frame["bj"].iloc[0])
    x = frame["x"].to_numpy()
    return np.flatnonzero(x == bi), np.flatnonzero(x == bj)


def links(docs: DataFrame, width: int = 5, threshold: float = 0.8, tolerance: float = 1e-9, bucket_block: int = 1024, cluster_block: int = 256) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, class_id, copy_id, n_links.

    n_links: other documents whose shingle sets have a Jaccard similarity of threshold or more with this one's, copies
    included; class_id: the smallest doc_id that a chain of links reaches (its own if it has none); copy_id: the smallest
    doc_id with the very same set.  Texts without words (null and empty ones too) have no set: they link to nothing, not to
    each other.  Rows with a null doc_id take part; theirs is the smallest id of their group (null).  Rows that repeat a
    doc_id are documents of their own.  An empty table gives an empty table.
    """
    found = _linked(docs, width, threshold, tolerance, bucket_block, cluster_block)
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return found.select(back("doc_id"), back("class_id"), back("copy_id"), "n_links")


def _linked(docs: DataFrame, width: int, threshold: float, tolerance: float, bucket_block: int, cluster_block: int) -> DataFrame:
    """links() with NULL_ID for null, the row's key (k1, k2: doc_id and text) and its group (null for texts without words)."""
    lean = cut(_lean(docs, width), "join-lean")
    some = lean.where("n > 0")
    classes = some.groupBy("fp", "fp2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = cut(classes.select(F.struct("rep", "fp", "fp2").alias("c"), "n", "copies"), "join-classes")
    one = some.join(classes.select(F.col("c.fp").alias("fp"), F.col("c.fp2").alias("fp2"), "n", "c", "copies"), ["fp", "fp2", "n"]).where("doc_id = c.rep")
    sigs = cut(one.groupBy("c").agg(F.first("sig").alias("sig"), F.first("copies").alias("copies")), "join-sigs")

    # buckets with two classes or more
    bands = sigs.select("c", F.posexplode("sig").alias("band", "key"))
    full = bands.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    members = bands.join(full, ["band", "key"]).join(sigs.select("c", "sig"), "c")
    schema = "u struct<rep: long, fp: long, fp2: long>, v struct<rep: long, fp: long, fp2: long>"

    def prune(frame: pd.DataFrame) -> pd.DataFrame | None:
        sig = np.stack(frame["sig"].to_numpy()).astype(np.int64).view(np.uint16)
        left, right = _sides(frame)
        if not len(left) or not len(right):
            return None
        i, j = survivors(sig, left, right, threshold, tolerance)
        root = forest(len(frame), i, j)
        moved = np.flatnonzero(root != np.arange(len(frame)))
        c = frame["c"].to_numpy()
        return pd.DataFrame({"u": c[moved], "v": c[root[moved]]})

    edges = map_groups(_blocks(members, "size", bucket_block, ["band", "key"]), ["band", "key", "bi", "bj"], prune, schema)
    cluster = cut(components(edges, "join-clusters"), "join-cluster")
    cluster = cluster.select(F.col("node").alias("c"), F.col("root").alias("cluster")).unionByName(cluster.select(F.col("root").alias("c"), F.col("root").alias("cluster")).distinct())
    sizes = cluster.groupBy("cluster").agg(F.count("*").alias("size"))
    cluster = cut(cluster.join(sizes, "cluster").join(sigs, "c"), "join-clustered")

    # the exact sets of clustered classes, from their representatives' texts
    wanted = cluster.select(F.col("c.rep").alias("rep"), "c", F.col("c.fp").alias("fp"), F.col("c.fp2").alias("fp2"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("rep"), "text").where("text is not null")
    texts = texts.join(wanted, "rep")

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(width)
        for frame in frames:
            for a in range(0, len(frame), 1000):
                part = frame.iloc[a : a + 1000]
                s = [shingles(t) for t in part["text"]]
                right = [len(x) > 0 and int(np.bitwise_xor.reduce(x).view(np.int64)) == f for x, f in zip(s, part["fp"], strict=True)]
                yield pd.DataFrame({"c": part["c"], "set": [x.tobytes() for x in s]})[right]

    sets_of = texts.mapInPandas(sets, "c struct<rep: long, fp: long, fp2: long>, set binary")
    sets_of = cut(sets_of.groupBy("c").agg(F.first("set").alias("set")), "join-sets")
    dealt = _blocks(cluster, "size", cluster_block, ["cluster"]).join(sets_of, "c")
    dealt = dealt.withColumns({"k1": F.col("cluster.rep"), "k2": F.col("cluster.fp")}).drop("cluster")

    def verify(frame: pd.DataFrame) -> pd.DataFrame | None:
        sig = np.stack(frame["sig"].to_numpy()).astype(np.int64).view(np.uint16)
        left, right = _sides(frame)
        if not len(left) or not len(right):
            return None
        i, j = survivors(sig, left, right, threshold, tolerance)
        ok = verified([np.frombuffer(s, np.uint64) for s in frame["set"]], i, j, threshold)
        i, j = i[ok], j[ok]
        copies = frame["copies"].to_numpy()
        count = np.bincount(i, copies[j], len(frame)) + np.bincount(j, copies[i], len(frame))
        root = forest(len(frame), i, j)
        some = np.flatnonzero(count > 0)
        c = frame["c"].to_numpy()
        return pd.DataFrame({"u": c[some], "v": c[root[some]], "linked": count[some].astype(np.int64)})

    found = cut(map_groups(dealt, ["k1", "k2", "bi", "bj"], verify, f"{schema}, linked long"), "join-found")
    linked = found.groupBy("u").agg(F.sum("linked").alias("linked")).withColumnRenamed("u", "c")
    group = components(found.select("u", "v"), "join-groups").select(F.col("node").alias("c"), "root")
    classes = classes.join(linked, "c", "left").join(group, "c", "left").withColumn("group", F.coalesce("root", "c"))
    classes = classes.select(F.col("c.fp").alias("fp"), F.col("c.fp2").alias("fp2"), "n", F.col("c.rep").alias("copy_id"), "group", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    row = ["doc_id", "k1", "k2"]
    with_set = some.select(*row, "n", "fp", "fp2").join(classes, ["fp", "fp2", "n"]).select(*row, F.col("group.rep").alias("class_id"), "copy_id", "n_links", "group")
    none = F.lit(None).cast(with_set.schema["group"].dataType)
    without = lean.where("n = 0").select(*row, F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), none.alias("group"))
    drop_cut(cluster, sigs, sets_of)
    return with_set.unionByName(without)


#: Stands for a null doc_id inside.
NULL_ID = -(1 << 63)


def dedup(docs: DataFrame, width: int = 5, threshold: float = 0.8, tolerance: float = 1e-9) -> DataFrame:
    """docs with one row of each group: the one with the smallest doc_id (null first), then by a hash of its text.  All rows
    without words stay.  Rows that repeat a doc_id are rows of their own: in one group one of them stays, in different groups
    one in each.  Rows alike in doc_id and text are one row read twice, whatever their other columns: one of them stays, the
    first in the order of their columns' hash.  Columns stay as they are, whatever their names."""
    from pyspark.sql import Window

    found = cut(_linked(docs, width, threshold, tolerance, 1024, 256), "join-linked")
    best = F.min(F.struct("doc_id", "k1", "k2"))
    keep = found.where("group is not null").groupBy("group").agg(best.alias("b")).select("b.k1", "b.k2", F.lit(True).alias("once"))
    keep = keep.unionByName(found.where("group is null").select("k1", "k2", F.lit(False).alias("once")).distinct())
    one, two, once, n = fresh(docs, "k1", "k2", "once", "n")
    keep = keep.select(F.col("k1").alias(one), F.col("k2").alias(two), F.col("once").alias(once))
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    stay = docs.withColumn(one, k1).withColumn(two, k2).join(keep, [one, two])
    place = Window.partitionBy(one, two).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if not t.startswith("map")]))
    return stay.withColumn(n, F.row_number().over(place)).where((F.col(n) == 1) | ~F.col(once)).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """All documents, five words, similarity 0.8: a row for each with its group and its number of links."""
    return links(documents(spark, sf_dir))
