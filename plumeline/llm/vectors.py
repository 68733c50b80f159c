"""Vectors in shards and blocks of bounded size, and the merging of what shards find."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .groups import map_groups


def usable(df: DataFrame, id_col: str, vector_col: str, nonzero: bool) -> DataFrame:
    """vec_id, vector (array of doubles), dim of the rows that take part: id and vector not null, the vector not empty,
    without null or non-finite components, and if asked not zero."""
    v = F.col(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    out = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"), F.size(v).alias("dim"))
    out = out.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.col("dim") > 0) & ~F.exists("vector", bad))
    return out.where(F.exists("vector", lambda x: x != 0)) if nonzero else out


def shard_list(vectors: DataFrame, rows: int) -> DataFrame:
    """dim, shards: how many shards of about `rows` vectors each length of vectors needs."""
    return vectors.groupBy("dim").agg(F.ceil(F.count("*") / rows).cast("int").alias("shards"))


def sharded(vectors: DataFrame, counts: DataFrame, build: Callable[[pd.DataFrame], bytes], name: str) -> DataFrame:
    """dim, shard, shards, index: each shard's index, written to the shared folder."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        head = frame.iloc[0]
        return pd.DataFrame({"dim": [head["dim"]], "shard": [head["shard"]], "shards": [head["shards"]], "index": [build(frame.sort_values("vec_id", kind="stable"))]})

    placed = vectors.join(counts, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    return cut(map_groups(placed, ["dim", "shard"], work, "dim int, shard int, shards int, index binary", batch=0), name)


def query_blocks(queries: DataFrame, counts: DataFrame, rows: int) -> DataFrame:
    """dim, shard, query_ids, block: the queries in blocks of about `rows`, each block once for every shard of its length.
    Of rows that repeat a query's id the smallest vector counts."""
    q = queries.groupBy("dim", "vec_id").agg(F.min("vector").alias("vector"))
    blocks = q.groupBy("dim").agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks"))
    q = q.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int"))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id")
        return pd.DataFrame({"dim": [frame["dim"].iloc[0]], "query_ids": [frame["vec_id"].to_numpy(np.int64).tobytes()], "block": [matrix(frame["vector"]).tobytes()]})

    packed = map_groups(q, ["dim", "block"], work, "dim int, query_ids binary, block binary", batch=0)
    return cut(packed, "queries").join(counts, "dim").withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)"))).drop("shards")


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def search(index: DataFrame, blocks: DataFrame, load: Callable, find: Callable, top: int, score: Column, schema: str) -> DataFrame:
    """find(load(index), query_ids, queries) on every pair of shard and block; per query the first `top` by score, then vec_id.

    A shard's index goes to one task, ahead of the blocks of queries, is loaded once, and the blocks stream past it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = None
        for frame in frames:
            for r in frame.itertuples(index=False):
                if r.kind == 0:
                    current = load(r.payload)
                else:
                    ids = np.frombuffer(r.query_ids, np.int64)
                    yield find(current, ids, np.frombuffer(r.payload, np.float64).reshape(len(ids), -1))

    indexes = index.select("dim", "shard", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("query_ids"), F.col("index").alias("payload"))
    both = indexes.unionByName(blocks.select("dim", "shard", F.lit(1).alias("kind"), "query_ids", F.col("block").alias("payload")))
    both = both.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind")
    found = both.select("kind", "query_ids", "payload").mapInPandas(run, f"query_id long, vec_id long, score {schema}")
    place = Window.partitionBy("query_id").orderBy(score, "vec_id")
    out = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
