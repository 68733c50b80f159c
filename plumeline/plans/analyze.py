"""The whole analysis: documents in, highlights out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..language.base import LANGUAGES, Language, resolve
from ..operators import assemble, colors, tokens
from ..operators.columnar import Analyser
from ..operators.scope import exclusion_of
from ..settings import Settings
from ..sources.layout import spread
from ..sources.lexicon import Lexicon, parse_lexicon

HIGHLIGHTS = "begin int, stop int, surface string, category string, family string, intensity int, color int, target_begin int, target_stop int"
EXPLANATION = "explanation struct<text: string, link_from: int, link_to: int>"
#: Characters of texts that one call of the analyser takes together (a longer text is taken alone).
BATCH_CHARS = 500_000
#: Stems of a frequency table that may go to every task (a table of a language has some ten thousand).
MOST_STEMS = 2_000_000


class Detector(Protocol):
    """Finds ranges of words in tokens that carry all marks; columns as assemble.word_ranges gives them, with color, rank and
    count where they mean something."""

    def __call__(self, marked: DataFrame, settings: Settings, lexicon: Lexicon, echoes: bool, key: tuple[str, ...]) -> DataFrame | None: ...


def repetitions(marked, settings, lexicon, echoes, key):
    return assemble.repetition_ranges(marked, settings, echoes, key)


def weak_words(marked, settings, lexicon, echoes, key):
    return assemble.weak_ranges(marked, lexicon, settings, key) if settings.weak_words and lexicon.families else None


#: In order of priority: a range that shares a word with one of an earlier detector is dropped.
DETECTORS: tuple[Detector, ...] = (repetitions, weak_words)


def levels(common: DataFrame | Mapping[str, int] | None, language: Language) -> dict[str, int]:
    """Stem -> level of a table (stem, level); without one, what the language knows by itself.  Never from the documents at
    hand: a text has the same highlights whatever it is analysed with."""
    if common is None:
        return dict(language.common)
    if isinstance(common, Mapping):
        return dict(common)
    rows = common.select("stem", F.col("level").cast("int")).where("level > 0").limit(MOST_STEMS + 1).collect()
    if len(rows) > MOST_STEMS:
        raise ValueError("a frequency table of a language is expected, not one row for every word of a corpus")
    return {r[0]: r[1] for r in rows}


def in_scope(docs: DataFrame, settings: Settings, path: str | None, frontmatter: str | None) -> DataFrame:
    """docs that no folder and no ignore tag leaves out; path and frontmatter name columns of docs."""
    if path is None and frontmatter is None:
        return docs
    where = F.col(path) if path else F.lit("")
    chosen = settings if path else Settings()
    return docs.where(exclusion_of(where, F.col(frontmatter) if frontmatter else None, chosen).isNull())


def analyze(
    docs: DataFrame, settings: Settings | None = None, lexicon: Lexicon | None = None, common: DataFrame | Mapping[str, int] | None = None,
    key: tuple[str, ...] = ("doc_id",), color: bool = True, explain: bool = True, language: Language | None = None,
    path: str | None = None, frontmatter: str | None = None,
) -> DataFrame:
    """Highlights of docs (key, text): key and HIGHLIGHTS, and with explain EXPLANATION (its link is the part of the text that
    leads to the other occurrence).  Ranges of a document never overlap; offsets count code points.

    One pass over the documents as they are read, without a shuffle (see operators.columnar).  lexicon: weak words, the
    language's own by default; common: stem, level of how common stems are (0 where absent); path, frontmatter: columns to
    apply the settings' folders and the ignore tag.  Null or empty text has no highlights; rows alike have like ones."""
    settings, language = settings or Settings(), language or resolve()
    lexicon = parse_lexicon(language.lexicon) if lexicon is None else lexicon
    known = levels(common, language) if settings.echoes else {}
    names = list(key)
    lean = spread(in_scope(docs, settings, path, frontmatter).select(*names, F.coalesce("text", F.lit("")).alias("text")))
    types = dict(lean.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in names] + [HIGHLIGHTS] + ([EXPLANATION] if explain else []))
    if not settings.active:
        return lean.sparkSession.createDataFrame([], schema)

    registered = LANGUAGES.get(language.name) is language
    make = lambda: Analyser(settings, lexicon, resolve(language.name) if registered else language, known, color, explain)
    return _one_pass(lean, names, make, lambda analyser, texts: analyser(texts), schema)


def phrase_echoes(docs: DataFrame, settings: Settings | None = None, common: DataFrame | Mapping[str, int] | None = None, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ranges of phrase echoes of docs (key, text): key, idx, size, other, rarest, as operators.echo gives them.  One pass
    over the documents as they are read, without a shuffle."""
    settings, language = settings or Settings(), resolve()
    known = levels(common, language) if settings.echoes else {}
    names = list(key)
    lean = spread(docs.select(*names, F.coalesce("text", F.lit("")).alias("text")))
    types = dict(lean.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in names] + ["idx int, size int, other int, rarest int"])
    make = lambda: Analyser(settings, Lexicon([]), resolve(), known, False, False)
    return _one_pass(lean, names, make, lambda analyser, texts: analyser.phrase_echoes(texts), schema)


def _one_pass(lean: DataFrame, names: list[str], make: Callable[[], Analyser], find: Callable[[Analyser, list[str]], pd.DataFrame], schema: str) -> DataFrame:
    """What find(make(), texts) returns of lean's texts, batch by batch, with the key of each row's document in place of doc."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        analyser = make()
        for frame in frames:
            size = frame["text"].str.len().cumsum() // BATCH_CHARS
            for _, part in frame.groupby(size, sort=False):
                found = find(analyser, part["text"].tolist())
                if not len(found):
                    continue
                keys = part[names].iloc[found.pop("doc").to_numpy()].reset_index(drop=True)
                yield pd.concat([keys, found], axis=1)

    return lean.mapInPandas(run, schema)


def marked_tokens(docs: DataFrame, settings: Settings, common: DataFrame | None, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The relation of words with all marks.  common: stem, level; by default what the language knows by itself."""
    t = tokens.classified(tokens.tokens(docs, key, dialogue=settings.ignore_dialogue), settings, key)
    return assemble.marked(t, settings, stem_levels(docs.sparkSession) if common is None and settings.echoes else common, key)


def stem_levels(spark: SparkSession, language: Language | None = None) -> DataFrame:
    """stem, level of what a language knows by itself."""
    return spark.createDataFrame(sorted((language or resolve()).common.items()), "stem string, level int")


class Relational:
    """The analysis as relations on DataFrames, for detectors of one's own.  Tables that several steps read are persisted;
    close() (or the end of a with block) lets them go once the result is written."""

    def __init__(self, docs: DataFrame, settings: Settings | None = None, lexicon: Lexicon | None = None, common: DataFrame | None = None, key: tuple[str, ...] = ("doc_id",), detectors: Sequence[Detector] = DETECTORS):
        self.docs, self.key, self.settings = docs, key, settings or Settings()
        self.lexicon = parse_lexicon(resolve().lexicon) if lexicon is None else lexicon
        self.kept: list[DataFrame] = []
        self.marked = self._keep(marked_tokens(docs, self.settings, common, key))
        self.ranges = self._ranges(detectors)

    def _keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df.persist())
        return self.kept[-1]

    def _ranges(self, detectors: Sequence[Detector]) -> DataFrame:
        """All ranges of words after arbitration."""
        taken = None
        for detect in detectors:
            found = detect(self.marked, self.settings, self.lexicon, self.settings.echoes, self.key)
            if found is None:
                continue
            found = self._keep(found)
            if taken is not None:
                found = assemble.without_overlap(found, taken, self.key)
            taken = found if taken is None else taken.unionByName(found, allowMissingColumns=True)
        for c in ("color", "rank", "count"):
            if c not in taken.columns:
                taken = taken.withColumn(c, F.lit(None).cast("int"))
        return taken

    def highlights(self, color: bool = True) -> DataFrame:
        out = assemble.explained(self.ranges, self.marked, self.docs, [f.label for f in self.lexicon.families], self.key)
        return colors.colored(out, self.key) if color else out

    def close(self) -> None:
        for df in self.kept:
            df.unpersist()
        self.kept.clear()

    def __enter__(self) -> Relational:
        return self

    def __exit__(self, *_) -> None:
        self.close()
