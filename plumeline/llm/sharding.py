"""Rendezvous (highest random weight) hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, documents, fresh


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard, from 0, with the highest score for a key.

    A shard's score is weight / -ln(u), u uniform from the md5 of key and shard number, so each shard gets keys in
    proportion to its weight and a shard that is added or removed moves only the keys it wins or loses.  Equal scores
    (never seen) go to the larger shard number.  A null key is a key like any other.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    text = F.coalesce(key.cast("string"), F.lit("null"))
    scores = []
    for i, w in enumerate(weights):
        digits = F.substring(F.md5(F.concat(text, F.lit(f"/{i}"))), 1, 13)
        u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(2.0**52)
        scores.append(F.struct((F.lit(float(w)) / -F.log(u)).alias("score"), F.lit(i).alias("shard")))
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def shard(df: DataFrame, key: str, weights: Sequence[float], order: Sequence[str] = (), cells: int = 4096) -> DataFrame:
    """Adds shard int and slot long (its place in the shard, gapless from 0) to df.

    Slots follow (cell of the key's hash, key, order).  Counts of `cells` cells a shard give each cell its first slot, so
    no task ever sorts a whole shard: a hot shard or a hot source is spread over all cells.  Rows of one key share a cell;
    repeated keys get a slot each, and null keys, of which there may be very many, are dealt to all cells of their shard by
    a hash of order.  Nulls sort first.  An empty table gives an empty table.  Columns of df named shard or slot are replaced;
    all others stay, whatever their names.  df is read twice: give a table that is cheap to read.
    """
    df = df.drop("shard", "slot")
    cell, start, n = fresh(df, "cell", "start", "n")
    spot = F.when(F.col(key).isNull(), F.xxhash64(F.lit(0), *order)).otherwise(F.xxhash64(key))
    placed = df.withColumns({"shard": rendezvous(df[key], weights), cell: F.pmod(spot, F.lit(cells))})
    counts = placed.groupBy("shard", cell).agg(F.count("*").alias(n))
    before = Window.partitionBy("shard").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", cell, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy("shard", cell).orderBy(key, *order)
    out = placed.join(starts, ["shard", cell]).withColumn("slot", F.col(start) + F.row_number().over(inside) - 1)
    return out.drop(cell, start)


def query(spark, sf_dir: str, shards: int = 8) -> DataFrame:
    """Law `key`: doc_id and the number of shards alone decide, for all documents.

    size: UTF-8 bytes of the text plus 1 (null text: 1); text_crc32: crc32 of those bytes (null or empty: 0).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lean = documents(spark, sf_dir).select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    lean = cut(lean, "op10")
    out = shard(lean, "doc_id", [1.0] * shards, order=["text_crc32", "size"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), rendezvous(F.col("doc_id"), [1.0] * (shards + 1)).cast("int").alias("grown_shard"),
    )
