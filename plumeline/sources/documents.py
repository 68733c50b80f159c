"""Where documents come from and where highlights go."""

from __future__ import annotations

import json
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..settings import Settings


@F.pandas_udf(StringType())
def composed(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFC")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (hash of the path), path (composed) and text of each file; line ends are \\n, as an editor gives them."""
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    text = F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return d.select(F.xxhash64("path").alias("doc_id"), composed(F.expr("url_decode(path)")).alias("path"), text.alias("text"))


def read_table(spark: SparkSession, path: str, text: str = "text", key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Key columns and text of a Parquet table; only these are read."""
    return spark.read.parquet(path).select(*key, F.col(text).alias("text"))


def read_frequencies(spark: SparkSession, path: str, word: str = "ortho", figure: str = "freqlemlivres") -> DataFrame:
    """word, per_million from a table with a header and tabs (compressed or not)."""
    t = spark.read.csv(path, sep="\t", header=True)
    return t.select(composed(F.lower(word)).alias("word"), F.col(figure).cast("double").alias("per_million"))


def css_class(category: Column, intensity: Column, color: Column, prefix: str = "plume") -> Column:
    """The style classes of a highlight."""
    return F.concat_ws(" ", F.concat(F.lit(f"{prefix}-"), category), F.concat(F.lit(f"{prefix}-"), category, F.lit("-"), intensity), F.concat(F.lit(f"{prefix}-color-"), color))


def write_highlights(highlights: DataFrame, path: str) -> None:
    """Parquet in the order of the text inside each file."""
    ordered = highlights.withColumn("css_class", css_class(F.col("category"), F.col("intensity"), F.col("color")))
    ordered.repartition("doc_id").sortWithinPartitions("doc_id", "begin", "stop").write.mode("overwrite").parquet(path)


def load_settings(path: str) -> Settings:
    """Sanitised settings of a JSON file; the defaults if there is none."""
    file = Path(path)
    return Settings.from_dict(json.loads(file.read_text(encoding="utf-8")) if file.exists() else None)


def save_settings(settings: Settings, path: str) -> None:
    Path(path).write_text(json.dumps(settings.to_dict(), ensure_ascii=False, indent=2), encoding="utf-8")
