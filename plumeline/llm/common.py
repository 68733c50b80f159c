"""What the operators of this subpackage share: cutting lineage, and names that cannot clash."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the mixing and sizing contracts: a run without space, tab, newline, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
#: Whether the files of a query's shuffles go when it ends, not when the driver's JVM happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir as the session has it.

    Only where the session has none and runs in one process (tests) a temporary folder is made and remembered; on a cluster
    without the setting this is an error, since a folder of the driver's own would not reach the executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            found = known.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            found = tempfile.mkdtemp(prefix="plumeline-")
            spark.sparkContext.setCheckpointDir(found)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: its lineage ends there, whoever is lost later, and the files
    of its shuffles go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumeline/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREED, before) if before is not None else spark.conf.unset(FREED)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(*tables: DataFrame) -> None:
    """Removes the files of tables made by cut() that nothing will read again."""
    for df in tables:
        for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, top)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever its letters' case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(*columns: Column) -> list[Column]:
    """Two 64-bit hashes of columns, nulls told from values: 128 bits that know equal rows."""
    parts = [x for c in columns for x in (c.isNull(), c)]
    return [F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)]


def word_count(text: Column) -> Column:
    """Number of words of WORD in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
