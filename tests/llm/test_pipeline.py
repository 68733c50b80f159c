"""The pipeline on a small table with planted cases."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumeline.llm import common


def test_pipeline(spark, make, tmp_path):
    r = random.Random(6)
    words = ["tree", "house", "river", "stone", "cloud", "green", "walks", "under", "light", "seven", "paper", "north", "glass", "candle", "window", "garden"]
    text = lambda n: "\n".join(" ".join(r.choice(words) + r.choice(["", "s", "ed", "ing"]) for _ in range(18)) for _ in range(n))
    rows = []
    for i in range(260):
        t = text(r.randint(1, 4))
        if r.random() < 0.25:
            t = t.replace(" ", " vileness ", 3)
        rows.append((i, t, "en", f"s{i % 3}"))
    copy = text(5)
    rows += [(1000, copy, "en", "s0"), (1001, copy, "en", "s1"), (1002, copy.replace("tree", "three", 1), "en", "s2"), (1003, None, None, None), (1004, "", "en", None)]
    docs = make(rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int("vileness" in t)) for i, t, *_ in rows[:200]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf_dir, at = str(tmp_path), docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = common.cut(stage(spark, at, sf_dir), name)
        assert at.columns == docs.columns, name
        kept[name] = {x.doc_id for x in at.collect()}
    toxic = {i for i, t, *_ in rows if "vileness" in (t or "")}
    assert len(toxic & kept["toxicity"]) <= 0.1 * len(toxic) and len(kept["toxicity"] - toxic) >= 0.95 * (len(rows) - len(toxic))
    assert {1000} == {1000, 1001, 1002} & kept["line_dedup"] and kept["ngram_jaccard_join"] <= kept["line_dedup"] and kept["mixing_sources"] <= kept["ngram_jaccard_join"]
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {x.doc_id for x in packed.select("doc_id").distinct().collect()} == kept["mixing_sources"]
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert used.where("n > 1024").count() == 0 and used.where("n < 512").count() <= 2


def test_cut_frees_its_shuffles(spark):
    """The files of a cut's shuffles go when it is written, whether or not the driver's JVM collects garbage meanwhile."""
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    held = lambda: {f for top in dirs for _, _, names in os.walk(top.getPath()) for f in names if f.startswith("shuffle_")}
    before, setting = held(), spark.conf.get(common.FREED)
    kept = common.cut(spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).count(), "freed")
    until = time.time() + 10
    while held() - before and time.time() < until:  # files go in the background
        time.sleep(0.1)
    assert not held() - before and kept.count() == 5000 and spark.conf.get(common.FREED) == setting


def test_shared_dir_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Session.conf)

            class _jsc:
                class sc:
                    class getCheckpointDir:
                        isDefined = staticmethod(lambda: False)

    with pytest.raises(RuntimeError):
        common.shared_dir(Session)
