"""Analysis of documents while they are written: a stream of versions in, highlights of the latest out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..language.base import resolve
from ..operators.colors import assign
from ..plans.analyze import analyze, levels
from ..settings import Settings
from ..sources.lexicon import Lexicon

DEBOUNCE = "250 milliseconds"


def latest(versions: DataFrame, key: str = "doc_id", order: str = "version") -> DataFrame:
    """The last version of each document in a batch."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return versions.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def run(
    versions: DataFrame, sink: Callable[[DataFrame, int], None], settings: Settings | None = None, lexicon: Callable[[], Lexicon] | None = None,
    common: DataFrame | Mapping[str, int] | None = None, checkpoint: str | None = None, trigger: dict | None = None, path: str | None = None, frontmatter: str | None = None,
) -> StreamingQuery:
    """Analyses, batch by batch, the last version of every document of a stream (doc_id, version, text; path and frontmatter
    name columns to apply the settings' folders and the ignore tag).  lexicon is called for each batch, so that a changed note
    counts at once.  Nothing is kept from one batch to the next."""
    settings = settings or Settings()
    known = levels(common, resolve())

    def batch(frame: DataFrame, number: int) -> None:
        sink(analyze(latest(frame), settings, lexicon() if lexicon else None, known, path=path, frontmatter=frontmatter), number)

    writer = versions.writeStream.foreachBatch(batch).trigger(**(trigger or {"processingTime": DEBOUNCE}))
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


COLORED = "doc_id long, version long, begin int, stop int, family string, color int"


def stable_colors(highlights: DataFrame) -> DataFrame:
    """Colours of a stream of highlights (doc_id, version, begin, stop, family, category): state per document remembers each
    family's colour, so that an edit changes none that is there.  Weak families have fixed colours (column color) and take no
    part.  All highlights of a version come in one batch."""
    fixed = F.when(F.col("category") == "weak", F.col("color")).cast("int") if {"category", "color"} <= set(highlights.columns) else F.lit(None).cast("int")
    lean = highlights.select("doc_id", "version", "begin", "stop", "family", fixed.alias("fixed"))

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(frames))
        for version, frame in rows.groupby("version", sort=True):
            frame = frame.sort_values(["begin", "stop"])
            given = [None if pd.isna(x) else int(x) for x in frame["fixed"]]
            spans = list(zip(frame["begin"].tolist(), frame["stop"].tolist(), frame["family"].tolist(), given, strict=True))
            yield frame.assign(doc_id=key[0], version=version, color=assign(spans, memory))[["doc_id", "version", "begin", "stop", "family", "color"]]
        state.update((list(memory), list(memory.values())))

    return lean.groupBy("doc_id").applyInPandasWithState(step, COLORED, "families array<string>, colors array<int>", "append", GroupStateTimeout.NoTimeout)


def map_offsets(spans: Iterable[tuple[int, int]], changes: Iterable[tuple[int, int, int]]) -> list[tuple[int, int] | None]:
    """Spans of a text after changes (begin, stop, new length) to it, in its old offsets: what lies inside a change is lost
    (None), what lies beyond moves."""
    changes = sorted(changes)
    out: list[tuple[int, int] | None] = []
    for begin, stop in spans:
        ends = []
        for x, side in ((begin, 1), (stop, -1)):
            shift = 0
            for a, b, size in changes:
                if b <= x and (b < x or side == 1 or a < b) and not (a == b == x and side == -1):
                    shift += size - (b - a)
                elif a < x < b:
                    x = b if side == 1 else a
                    shift += size - (b - a) if side == 1 else 0
            ends.append(x + shift)
        out.append((ends[0], ends[1]) if ends[0] < ends[1] else None)
    return out


def scope_changes(seen: DataFrame) -> DataFrame:
    """doc_id, version, exclusion where it is not that of the version before (seen: doc_id, version, exclusion)."""
    w = Window.partitionBy("doc_id").orderBy("version")
    first = F.row_number().over(w) == 1
    changed = ~F.lag("exclusion").over(w).eqNullSafe(F.col("exclusion"))
    return seen.withColumns({"__first": first, "__changed": changed}).where("__first or __changed").drop("__first", "__changed")
