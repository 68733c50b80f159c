"""How documents lie in partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of a task's share below which a table is dealt anew: small tables come in few row groups, which only as many tasks read.
TASK_BYTES = 64 << 20


def spread(docs: DataFrame) -> DataFrame:
    """docs over all cores, if it is so small that its files may not reach them; a large table stays as it is read."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return docs.repartition(4 * cores) if size < cores * TASK_BYTES else docs
