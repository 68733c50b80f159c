"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, in flat arrays.

Nodes are inserted batch by batch.  A batch searches the graph built so far, level by level from the top, and links each of
its nodes to diverse ones among what the search found and its own mates; nodes that are linked to take the link back and, when
full, choose their links anew.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import matrix, query_blocks, search, shard_list, sharded, usable

#: Rows of a shard, queries of a block, nodes of an insertion batch; links of a node on the ground level and above; beam
#: widths of insertion and of search.
SHARD, BLOCK, BATCH, GROUND, UPPER, INSERTION, BEAM = 8192, 256, 256, 32, 16, 64, 96


def _hashed(ids: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) from ids."""
    x = (ids.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _levels(ids: np.ndarray) -> np.ndarray:
    """Each node's top level: geometric in UPPER, from a hash of its id, so that rebuilding gives the same graph."""
    return np.floor(-np.log(_hashed(ids)) / np.log(UPPER)).astype(np.int64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between rows of a and of b (leading axes alike)."""
    cross = np.matmul(a, np.swapaxes(b, -1, -2))
    return np.maximum((a * a).sum(-1)[..., :, None] + (b * b).sum(-1)[..., None, :] - 2 * cross, 0)


def _select(x: np.ndarray, candidates: np.ndarray, dist: np.ndarray, links: int) -> np.ndarray:
    """For every row, up to `links` of its candidates (-1: none) as columns sorted by distance: first those that are nearer to
    the row's node than to any link chosen before, which keeps links in all directions, then the nearest of the rest."""
    order = np.argsort(np.where(candidates >= 0, dist, np.inf), axis=1, kind="stable")
    candidates, dist = np.take_along_axis(candidates, order, 1), np.take_along_axis(dist, order, 1)
    rows, width = candidates.shape
    out = np.full((rows, links), -1, np.int32)
    for a in range(0, rows, 256):
        c, d = candidates[a : a + 256], dist[a : a + 256]
        between = _distances(x[c], x[c])
        taken = np.zeros(c.shape, bool)
        count = np.zeros(len(c), np.int64)
        nearest = np.full(c.shape, np.inf)  # of each candidate to a link chosen before
        for k in range(width):
            ok = (c[:, k] >= 0) & (count < links) & (d[:, k] < nearest[:, k])
            taken[:, k] = ok
            count += ok
            nearest[ok] = np.minimum(nearest[ok], between[ok, k])
        rest = (c >= 0) & ~taken
        room = links - count
        taken |= rest & (np.cumsum(rest, axis=1) <= room[:, None])
        r, k = np.nonzero(taken)
        place = np.cumsum(taken, axis=1)[r, k] - 1
        out[a + r, place] = c[r, k]
    return out


class Graph:
    """Links of every level; a node that a level doesn't have has none there."""

    def __init__(self, x: np.ndarray, level: np.ndarray):
        self.x, self.level = x, level
        self.links = [np.full((len(x), GROUND if k == 0 else UPPER), -1, np.int32) for k in range(int(level.max()) + 1)]

    def insert(self, batch: np.ndarray, entry: int) -> None:
        x = self.x
        at = np.full(len(batch), entry)
        mates = _distances(x[batch], x[batch])
        np.fill_diagonal(mates, np.inf)
        for k in range(len(self.links) - 1, -1, -1):
            here = np.flatnonzero(self.level[batch] >= k)
            beam, dist, _ = beam_search(x, self.links[k], x[batch], at, INSERTION if len(here) else 4)
            at = beam[:, 0]
            if not len(here):
                continue
            near = np.where(np.isfinite(mates[np.ix_(here, here)]), batch[here][None, :], -1)
            candidates = np.concatenate([beam[here], near], axis=1)
            both = np.concatenate([dist[here], mates[np.ix_(here, here)]], axis=1)
            width = min(both.shape[1], 2 * INSERTION)
            best = np.argsort(both, axis=1, kind="stable")[:, :width]
            chosen = _select(x, np.take_along_axis(candidates, best, 1), np.take_along_axis(both, best, 1), self.links[k].shape[1] // 2)
            self.links[k][batch[here], : chosen.shape[1]] = chosen
            r, c = np.nonzero(chosen >= 0)
            self._back(k, chosen[r, c].astype(np.int64), batch[here][r])

    def _back(self, k: int, target: np.ndarray, source: np.ndarray) -> None:
        """Adds the links target -> source."""
        links = self.links[k]
        known = (links[target] == source[:, None]).any(axis=1)
        order = np.argsort(target[~known], kind="stable")
        target, source = target[~known][order], source[~known][order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        if not len(nodes):
            return
        wide = np.full((len(nodes), links.shape[1] + int(count.max())), -1, np.int64)
        wide[:, : links.shape[1]] = links[nodes]
        wide[np.repeat(np.arange(len(nodes)), count), links.shape[1] + np.arange(len(target)) - np.repeat(first, count)] = source
        for a in range(0, len(nodes), 1024):
            part, mine = wide[a : a + 1024], nodes[a : a + 1024]
            dist = _distances(self.x[mine][:, None, :], self.x[part])[:, 0, :]
            links[mine] = _select(self.x, part, dist, links.shape[1])


def build(ids: np.ndarray, x: np.ndarray) -> bytes:
    """A shard's index.  Rows with the very same vector are one node that holds their ids."""
    nodes, of = np.unique(x, axis=0, return_inverse=True)
    of = of.ravel()
    order = np.lexsort((ids, of))
    held, starts = ids[order], np.searchsorted(of[order], np.arange(len(nodes) + 1))
    level = _levels(held[starts[:-1]])
    graph = Graph(nodes.astype(np.float32), level)
    turn = np.lexsort((_hashed(held[starts[:-1]]), -level))  # the highest first: it is the entry
    at = 1
    while at < len(turn):
        size = min(BATCH, at)
        graph.insert(turn[at : at + size], int(turn[0]))
        at += size
    arrays = {"nodes": nodes, "held": held, "starts": starts, "entry": turn[:1], "top": np.array(len(graph.links))}
    out = io.BytesIO()
    np.savez(out, **arrays, **{f"links{k}": v for k, v in enumerate(graph.links)})
    return out.getvalue()


def beam_search(nodes: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-first search of all queries in step: each keeps its `width` nearest nodes and opens the nearest four unopened
    ones, until none could improve it.  Returns nodes and squared distances, nearest first (-1 and inf: none), and how many
    distances were computed."""
    q, n = len(queries), len(nodes)
    beam = np.full((q, width), -1, np.int64)
    dist = np.full((q, width), np.inf)
    opened = np.ones((q, width), bool)
    seen = np.zeros((q, n), bool)
    rows = np.arange(q)
    beam[:, 0] = entry
    dist[:, 0] = ((nodes[entry] - queries) ** 2).sum(axis=1)
    opened[:, 0] = False
    seen[rows, entry] = True
    live, computed = rows, q
    while len(live):
        waiting = np.where(opened[live], np.inf, dist[live])
        pick = np.argsort(waiting, axis=1, kind="stable")[:, :4]
        real = np.isfinite(np.take_along_axis(waiting, pick, axis=1))
        going = real.any(axis=1)
        live, pick, real = live[going], pick[going], real[going]
        if not len(live):
            break
        opened[live[:, None], pick] = True
        node = beam[live[:, None], pick]
        near = np.where(real[..., None], links[node], -1).reshape(len(live), -1).astype(np.int64)
        fresh = (near >= 0) & ~seen[live[:, None], near]
        seen[live[:, None], np.where(near >= 0, near, node[:, :1])] = True
        ordered = np.sort(np.where(fresh, near, -1), axis=1)
        fresh = ordered >= 0
        fresh[:, 1:] &= ordered[:, 1:] != ordered[:, :-1]
        at, col = np.nonzero(fresh)
        computed += len(at)
        d = np.full(ordered.shape, np.inf)
        d[at, col] = ((nodes[ordered[at, col]] - queries[live[at]]) ** 2).sum(axis=1)
        all_d = np.concatenate([dist[live], d], axis=1)
        all_n = np.concatenate([beam[live], np.where(fresh, ordered, -1)], axis=1)
        all_o = np.concatenate([opened[live], ~fresh], axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        dist[live], beam[live], opened[live] = (np.take_along_axis(v, best, axis=1) for v in (all_d, all_n, all_o))
    return beam, dist, computed


class Index:
    """A shard's index as it is searched."""

    def __init__(self, raw: bytes):
        z = np.load(io.BytesIO(raw))
        self.nodes, self.held, self.starts, self.entry = z["nodes"], z["held"], z["starts"], int(z["entry"][0])
        self.links = [z[f"links{k}"] for k in range(int(z["top"]))]
        self.computed = 0

    def find(self, query_ids: np.ndarray, queries: np.ndarray, top: int) -> pd.DataFrame:
        nodes, held, starts = self.nodes, self.held, self.starts
        entry = np.full(len(queries), self.entry)
        for k in range(len(self.links) - 1, 0, -1):
            beam, _, n = beam_search(nodes, self.links[k], queries, entry, 4)
            entry = beam[:, 0]
            self.computed += n
        beam, _, n = beam_search(nodes, self.links[0], queries, entry, max(BEAM, 4 * top))
        self.computed += n
        at, col = np.nonzero(beam >= 0)
        node = beam[at, col]
        score = np.sqrt(((nodes[node] - queries[at]) ** 2).sum(axis=1))
        many = np.minimum(starts[node + 1] - starts[node], top + 1)
        flat = np.repeat(starts[node] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        out = pd.DataFrame({"query": np.repeat(at, many), "vec_id": held[flat], "score": np.repeat(score, many)})
        out["query_id"] = query_ids[out["query"]]
        out = out[out["vec_id"] != out["query_id"]].sort_values(["query_id", "score", "vec_id"])
        return out.groupby("query_id").head(top)[["query_id", "vec_id", "score"]]


def neighbours(df: DataFrame, queries: DataFrame, top: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` nearest rows of df found for each row of queries, by Euclidean distance in
    double precision (score, exact on the original vectors); ties to the smaller vec_id.

    Every row is indexed: in a graph per shard of about `shard` rows, shards by a hash of the id.  Rows with the query's own
    id are no candidates.  Vectors that are null, empty, zero or hold null or non-finite components, and rows without id,
    take no part; vectors of another length than the query's are not compared with it.  Tests measure recall by brute
    force."""
    x = usable(df, id_col, vector_col, nonzero=True)
    counts = shard_list(x, shard)
    index = sharded(x, counts, lambda f: build(f["vec_id"].to_numpy(np.int64), matrix(f["vector"])), "hnsw-index")
    blocks = query_blocks(usable(queries, id_col, vector_col, nonzero=True), counts, BLOCK)
    return search(index, blocks, Index, lambda i, n, q: i.find(n, q, top), top, F.col("score").asc(), "double")


def query(spark, sf_dir: str) -> DataFrame:
    """All embeddings; queries are the rows whose vec_id is divisible by 100."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours(e, e.where("vec_id % 100 = 0"))
