"""Weak words: entries of a lexicon, found greedily, shown where a family gathers in a paragraph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..settings import Settings
from ..sources.lexicon import LEAST_BEFORE, Element, Lexicon, compile_entries

#: Colours of the families in the order of the lexicon.
FAMILY_COLORS = (1, 3, 5, 7, 9, 10, 11, 6)


#: Rows of the tables of forms that are broadcast; larger lexicons are joined by a shuffle.
BROADCAST_FORMS = 200_000


def _ends(element: Element, word: Column) -> Column:
    ok = (F.length(word) >= len(element.ending) + LEAST_BEFORE) & word.endswith(element.ending)
    return ok & ~word.isin(sorted(element.exceptions)) if element.exceptions else ok


def weak_candidates(t: DataFrame, lexicon: Lexicon, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """key, idx, size, rank, segment, paragraph: the best entry that starts at each word inside its segment: more words, then
    exact words before endings, then the earlier family.

    Entries whose first word is known are found by a join of the words with the table of first forms, their other words by
    joins with the forms at each place; entries that begin with an ending (few) are tried everywhere."""
    entries = compile_entries(lexicon)
    most = max((len(e.elements) for e in entries), default=1)
    w = Window.partitionBy(*key, "segment").orderBy("idx")
    t = t.select(*key, "idx", "segment", "paragraph", "norm", F.array(*[F.lead("norm", k).over(w) for k in range(most)]).alias("ahead"))
    word = lambda k: F.get("ahead", F.lit(k))

    def forms(place: int) -> DataFrame | None:
        rows = [(n, f) for n, e in enumerate(entries) if len(e.elements) > place for f in sorted(e.elements[place].forms)]
        table = t.sparkSession.createDataFrame(rows, "entry int, form string") if rows else None
        return F.broadcast(table) if rows and len(rows) <= BROADCAST_FORMS else table

    found = []
    first = forms(0)
    if first is not None:
        found.append(t.join(first.withColumnRenamed("form", "norm"), "norm"))
    for n, e in enumerate(entries):
        if e.elements[0].ending:
            found.append(t.where(_ends(e.elements[0], F.col("norm"))).withColumn("entry", F.lit(n)))
    if not found:
        return t.where(F.lit(False)).select(*key, "idx", F.lit(0).alias("size"), F.lit(0).alias("rank"), "segment", "paragraph")
    c = found[0].select(*key, "idx", "segment", "paragraph", "ahead", "entry")
    for more in found[1:]:
        c = c.unionByName(more.select(*c.columns))
    known = F.create_map(*[F.lit(x) for n, e in enumerate(entries) for x in (n, len(e.elements))])
    c = c.withColumn("words", known[F.col("entry")])
    for place in range(1, most):
        table = forms(place)
        ok = F.col("words") <= place
        for n, e in enumerate(entries):
            if len(e.elements) > place and e.elements[place].ending:
                ok = ok | ((F.col("entry") == n) & F.coalesce(_ends(e.elements[place], word(place)), F.lit(False)))
        if table is not None:
            table = table.select(F.col("entry").alias("of"), F.col("form").alias("then"), F.lit(True).alias("hit"))
            c = c.join(table, (F.col("entry") == F.col("of")) & (word(place) == F.col("then")), "left")
            ok = ok | F.coalesce("hit", F.lit(False))
        c = c.where(ok).drop("of", "then", "hit")
    score = F.create_map(*[F.lit(x) for n, e in enumerate(entries) for x in (n, e.order[0])])
    rank = F.create_map(*[F.lit(x) for n, e in enumerate(entries) for x in (n, e.rank)])
    best = F.max(F.struct(score[F.col("entry")].alias("score"), (-rank[F.col("entry")]).alias("rank"), "words"))
    c = c.groupBy(*key, "idx").agg(best.alias("b"), F.first("segment").alias("segment"), F.first("paragraph").alias("paragraph"))
    return c.select(*key, "idx", F.col("b.words").alias("size"), (-F.col("b.rank")).alias("rank"), "segment", "paragraph")


@F.pandas_udf(ArrayType(StructType([StructField(c, IntegerType()) for c in ("idx", "size", "rank", "paragraph")])))
def _greedy(candidates: pd.Series) -> pd.Series:
    out = []
    for row in candidates:
        end, kept = -1, []
        for c in row:
            if c["idx"] >= end:
                kept.append(dict(c))
                end = c["idx"] + c["size"]
        out.append(kept)
    return pd.Series(out)


def weak_hits(t: DataFrame, lexicon: Lexicon, settings: Settings, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """key, idx, size, rank, paragraph: candidates from left to right, each taking its words; families that are switched off
    take their words too, but show nothing.  A match never leaves its segment, so segments are worked on apart."""
    c = weak_candidates(t, lexicon, key)
    rows = F.sort_array(F.collect_list(F.struct("idx", "size", "rank", "paragraph")))
    hits = c.groupBy(*key, "segment").agg(rows.alias("c")).select(*key, F.explode(_greedy("c")).alias("h")).select(*key, "h.*")
    off = [k for k, f in enumerate(lexicon.families) if f.id in settings.weak_disabled]
    return hits.where(~F.col("rank").isin(off)) if off else hits


def weak_highlights(t: DataFrame, lexicon: Lexicon, settings: Settings, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Hits of families that reach their threshold in their paragraph: key, idx, size, rank, count, intensity."""
    hits = weak_hits(t, lexicon, settings, key)
    hits = hits.withColumn("count", F.count("*").over(Window.partitionBy(*key, "paragraph", "rank")).cast("int"))
    limits = [settings.weak_threshold if f.threshold is None else f.threshold for f in lexicon.families] or [settings.weak_threshold]
    limit = F.element_at(F.array(*[F.lit(x) for x in limits]), F.col("rank") + 1)
    level = F.when(F.col("count") >= 2 * limit, 3).when(F.col("count") > limit, 2).otherwise(1)
    return hits.where(F.col("count") >= limit).withColumn("intensity", level)
