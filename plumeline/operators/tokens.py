"""The ordered relation of words that every detector reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..language import french
from ..language.base import resolve
from ..settings import Settings, word_list
from ..sources.layout import spread
from ..sources.lexicon import Lexicon
from .columnar import EXCLUDED, FULL, FUNCTION, Vocabulary, words

TOKEN = "idx int, begin int, stop int, surface string, norm string, capitalized boolean, sentence_start boolean, segment int, paragraph int"
#: Characters of texts that are cut into words together (a longer text is taken alone).
BATCH_CHARS = 500_000
MIN_WORD = 3


def tokens(docs: DataFrame, key: tuple[str, ...] = ("doc_id",), mask: bool = True, dialogue: bool = False) -> DataFrame:
    """Words of docs (key columns, text): key, idx (from 0), begin, stop (code points), surface, norm, capitalized,
    sentence_start, segment (from 1) and paragraph (from 0).

    A word is a run of letters, digits and marks.  Zones that are no prose are masked by newlines; a paragraph ends where
    the text itself has a newline between two words.  Null text has no words.  Documents are cut where they are read, by the
    function that the whole analysis uses (columnar.words): no row is shuffled, and no word carries its document's text.
    """
    names = list(key)
    lean = spread(docs.select(*names, F.coalesce("text", F.lit("")).alias("text")))
    types = dict(lean.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(resolve(), Settings(), {}, Lexicon([]))
        for frame in frames:
            for _, part in frame.groupby(frame["text"].str.len().cumsum() // BATCH_CHARS, sort=False):
                if len(vocabulary.strings) > vocabulary.most:
                    vocabulary.clear()
                w = words(part["text"].tolist(), vocabulary, dialogue, mask)
                heads = np.flatnonzero(np.diff(w.doc, prepend=-1))
                of = np.repeat(heads, np.diff(np.append(heads, len(w.doc))))
                base = w.base[w.doc] if len(w.doc) else w.doc
                surface = [w.plain[a:b] for a, b in zip(w.begin.tolist(), w.stop.tolist(), strict=True)]
                out = part[names].iloc[w.doc].reset_index(drop=True)
                columns = {"idx": np.arange(len(of)) - of, "begin": w.begin - base, "stop": w.stop - base, "surface": pd.Series(surface, dtype=object), "norm": pd.Series([vocabulary.strings[x] for x in w.norm.tolist()], dtype=object), "capitalized": w.capital, "sentence_start": w.opens}
                first = w.paragraph[of] if len(of) else of
                yield out.assign(**columns, segment=w.segment - (w.segment[of] if len(of) else of) + 1, paragraph=w.paragraph - first)

    return lean.mapInPandas(run, ", ".join(f"`{c}` {types[c]}" for c in names) + ", " + TOKEN)


def stopword(norm: Column) -> Column:
    return norm.isin(sorted(french.STOPWORDS))


def named(t: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """t with name: whether the word is a proper name of its document: seen with a capital where no sentence starts."""
    seen = F.col("capitalized") & ~F.col("sentence_start") & (F.length("norm") >= MIN_WORD) & ~stopword(F.col("norm"))
    return t.withColumn("name", F.max(seen).over(Window.partitionBy(*key, "norm")))


def proper_names(t: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """key, norm of each document's proper names."""
    return named(t, key).where("name").select(*key, "norm").distinct()


def classified(t: DataFrame, settings: Settings, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """t with kind: EXCLUDED (proper names, the user's words), FULL (three signs or more, a letter, no function word) or
    FUNCTION.  The words of a document are brought together here, once: every later window by document and anything else
    finds them so."""
    t = t.repartition(*key)
    out = named(t, key) if settings.ignore_proper_names else t.withColumn("name", F.lit(False))
    ignored = sorted(word_list(settings.extra_ignored_words))
    excluded = F.col("name") | F.col("norm").isin(ignored) if ignored else F.col("name")
    full = (F.length("norm") >= MIN_WORD) & F.col("norm").rlike(r"\p{L}") & ~stopword(F.col("norm"))
    return out.withColumn("kind", F.when(excluded, EXCLUDED).when(full, FULL).otherwise(FUNCTION).cast("tinyint")).drop("name")
