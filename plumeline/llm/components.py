"""Connected components by alternating large-star and small-star steps, on DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def _state(edges: DataFrame) -> tuple:
    """Count and checksum of a set of edges."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(h, F.lit(1 << 40))), F.bit_xor(h)).first())


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """From edges (u, v) of any orderable type to (node, root): root is the smallest node of node's component.

    Roots have no row of their own; nodes without edges have none either.  Loops and repeated edges do no harm; edges with
    a null end are left out.  Each step takes minima by partial aggregation and joins them back, so a node with very many
    neighbours never meets them in one place but a join that Spark can split.  Every round is cut into the shared folder.
    """
    e = edges.where("u is not null and v is not null and u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(e, name)
    before = _state(e)
    for _ in range(most_rounds):
        if before[0] == 0:
            break
        # large star: u's larger neighbours go to the smallest of u and its neighbours
        low = e.groupBy("u").agg(F.min("v").alias("m"))  # neighbours below u
        up = e.select(F.col("v").alias("x"), F.col("u").alias("y"))
        large = up.join(low.withColumnRenamed("u", "x"), "x", "left")
        large = large.select(F.col("y").alias("u"), F.coalesce("m", "x").alias("v")).distinct()
        large = cut(large, name)
        # small star: u and its smaller neighbours go to the smallest of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        after = _state(nxt)
        drop_cut(e)
        drop_cut(large)
        e = nxt
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
