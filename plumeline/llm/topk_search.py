"""Exact top-k by inner product over an impact-ordered index, score at a time."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import matrix, query_blocks, search, shard_list, sharded, usable

SCALE = 64
#: Rows of a shard, queries of a block, and levels of quantised impact.
SHARD, BLOCK, LEVELS = 8192, 256, 16
#: A query stops when at most so many times the wanted rows are possible.
FEW = 16
#: Queries of a block that go ahead level by level; the others read what these needed at least in one go.
AHEAD = 8


def build(ids: np.ndarray, x: np.ndarray) -> bytes:
    """A shard's index from whole-number vectors: its postings (dimension, vector, impact) in segments of one level and
    dimension, levels by descending size of impact, and after each level what is left of every vector's length."""
    rows, dim = x.shape
    size = np.abs(x)
    some = np.unique(size[size > 0])
    levels = min(LEVELS, len(some))
    # the square of impacts is dealt evenly: low levels hold many postings that can add little
    ordered = np.sort(size[size > 0])
    mass = np.cumsum(ordered**2)
    bounds = np.unique(ordered[np.searchsorted(mass, mass[-1] * np.arange(1, levels) / levels)])[::-1] if levels > 1 else np.zeros(0)
    levels = len(bounds) + 1 if levels else 0
    level = (size[..., None] <= bounds).sum(axis=-1) if levels else np.zeros(x.shape, np.int64)
    vec, d = np.nonzero(size)
    order = np.lexsort((vec, d, level[vec, d]))
    vec, d = vec[order], d[order]
    segment = level[vec, d] * dim + d
    rest = np.stack([np.sqrt((np.where(level > k, x, 0).astype(np.float64) ** 2).sum(axis=1)) for k in range(max(levels, 1))])
    out = io.BytesIO()
    np.savez(out, ids=ids, shape=np.array([rows, dim, levels]), vec=vec.astype(np.int32), impact=x[vec, d], starts=np.searchsorted(segment, np.arange(levels * dim + 1)), rest=rest)
    return out.getvalue()


class Index:
    """A shard's postings as they are read: each level's whole postings as columns by dimension."""

    def __init__(self, raw: bytes):
        z = np.load(io.BytesIO(raw))
        self.ids, (self.rows, self.dim, self.levels) = z["ids"], z["shape"].tolist()
        self.vec, self.impact, self.starts, self.rest = z["vec"], z["impact"], z["starts"], z["rest"]
        self.repeats = int(np.unique(self.ids, return_counts=True)[1].max(initial=1))
        self.largest = np.abs(self.impact).max(initial=0)
        #: Postings that queries read before they stopped, and those they would read without stopping.
        self.read = self.all = 0
        self.whole: np.ndarray | None = None
        self.kept: tuple = (None, None)

    def between(self, j: int, k: int) -> np.ndarray:
        """The postings of the levels from j to before k as columns by dimension (rows, dim), whole numbers as doubles."""
        a, b = self.starts[j * self.dim], self.starts[k * self.dim]
        d = np.repeat(np.tile(np.arange(self.dim), k - j), np.diff(self.starts[j * self.dim : k * self.dim + 1]))
        out = np.zeros((self.rows, self.dim))
        out[self.vec[a:b], d] = self.impact[a:b]
        return out

    def find(self, query_ids: np.ndarray, queries: np.ndarray, top: int) -> pd.DataFrame:
        """Each query's `top` best of a shard.

        Segments are read by descending level, and every level adds its part of all scores.  What a vector's unread postings
        can still add lies within |query| * |rest|, rest the length of what the vector has left; a query stops once this
        proves that all but a few vectors are out, and those few are scored exactly on their postings.  Reading all levels
        proves every score.  A few queries go ahead; the others read together the levels before the first at which one of
        these stopped, and look for their proof from there on.
        """
        q = np.floor(queries * SCALE)
        possible: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
        first = 0
        for part in (np.arange(min(AHEAD, len(q))), np.arange(AHEAD, len(q))):
            if len(part):
                first = self._scan(q, part, first, top, possible)
        self.all += len(q) * len(self.vec)
        if self.whole is None:
            self.whole = self.between(0, self.levels)
        exact = np.abs(q).max(initial=0) * self.largest * self.dim < 2**52
        ids, vecs, scores = [], [], []
        for i in range(len(q)):
            at = possible[i]
            at = at[self.ids[at] != query_ids[i]]
            if exact:
                score = (self.whole[at] @ q[i]).astype(np.int64)
            else:
                score = np.array([sum(int(a) * int(b) for a, b in zip(self.whole[j].tolist(), q[i].tolist(), strict=True)) for j in at], object)
            best = np.lexsort((self.ids[at], -score))[:top]
            ids.append(np.full(len(best), query_ids[i]))
            vecs.append(self.ids[at][best])
            scores.append(score[best])
        together = lambda parts: np.concatenate(parts) if parts else []
        return pd.DataFrame({"query_id": together(ids), "vec_id": together(vecs), "score": together(scores)})

    def _scan(self, q: np.ndarray, active: np.ndarray, first: int, top: int, possible: list[np.ndarray]) -> int:
        """Reads levels for the queries `active` of q until all have stopped, and puts the vectors that each leaves into
        possible.  The levels up to `first` are read in one go.  Returns the level at which the first query stopped."""
        rows, levels = self.rows, self.levels
        kind = np.float32 if np.abs(q).max(initial=0) * self.largest * self.dim < 2**23 else np.float64
        length = np.sqrt((q * q).sum(axis=1))
        keep = min(rows, top + self.repeats)  # the query's own rows may be among them
        acc, done, earliest = np.zeros((len(active), rows), kind), 0, None
        for k in range(first, max(levels, 1)):
            if levels:
                acc += q[active].astype(kind) @ self._columns(done, k + 1, kind).T
                self.read += len(active) * int(self.starts[(k + 1) * self.dim] - self.starts[done * self.dim])
                done = k + 1
            last = k >= levels - 1
            if last:
                bar = np.partition(acc, rows - keep, axis=1)[:, rows - keep]
                left = acc >= bar[:, None]
                stop = np.ones(len(active), bool)
            else:
                slack = (length[active][:, None] * self.rest[k][None, :]) * (1 + 1e-9) + 1e-6
                bar = np.partition(acc - slack, rows - keep, axis=1)[:, rows - keep]
                left = acc + slack >= bar[:, None]
                stop = left.sum(axis=1) <= FEW * keep
            for i in np.flatnonzero(stop).tolist():
                possible[active[i]] = np.flatnonzero(left[i])
            if stop.any() and earliest is None:
                earliest = k
            if stop.all():
                break
            if stop.any():
                active, acc = active[~stop], acc[~stop]
        return earliest

    def _columns(self, j: int, k: int, kind: type) -> np.ndarray:
        """between(j, k) as kind; that of the first levels is kept for the next block of queries."""
        if j or k == 1:  # a single level is quickly laid out
            return self.between(j, k).astype(kind)
        if (k, kind) != self.kept[0]:
            self.kept = ((k, kind), self.between(j, k).astype(kind))
        return self.kept[1]


def search_top(df: DataFrame, queries: DataFrame, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` rows of df with the greatest inner product with each row of queries, both
    after floor(64 * x); ties to the smaller vec_id.  Rows with the query's own id are no candidates.  Vectors that are
    null, empty or hold null or non-finite components, and rows without id, take no part; vectors of another length than
    the query's are not compared with it.  Candidates lie in shards of bounded size and meet the queries block by block."""
    x = usable(df, id_col, vector_col, nonzero=False)
    counts = shard_list(x, shard)
    index = sharded(x, counts, lambda f: build(f["vec_id"].to_numpy(np.int64), np.floor(matrix(f["vector"]) * SCALE)), "topk-index")
    blocks = query_blocks(usable(queries, id_col, vector_col, nonzero=False), counts, BLOCK)
    return search(index, blocks, Index, lambda i, n, q: i.find(n, q, top), top, F.col("score").desc(), "long")


def query(spark, sf_dir: str) -> DataFrame:
    """All embeddings; queries are the rows whose vec_id is divisible by 20."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search_top(e, e.where("vec_id % 20 = 0"))


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as x from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id and len(c.x) = len(q.x)),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
