"""Colours of families: twelve of them, given so that neighbours differ, and kept from one version to the next."""

from __future__ import annotations

import bisect
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PALETTE = 12
MEMORY_LIMIT = 20_000


class Lane:
    """The spans that have a colour, by their beginning."""

    def __init__(self):
        self.spans: list[tuple[int, int]] = []

    def add(self, spans: Iterable[tuple[int, int]]) -> None:
        self.spans = sorted([*self.spans, *spans])

    def gap(self, spans: Iterable[tuple[int, int]]) -> float:
        """The least distance to any of spans: infinite without spans, 0 at least."""
        best = float("inf")
        for begin, stop in spans:
            at = bisect.bisect_right(self.spans, (begin, float("inf")))
            if at:
                best = min(best, begin - self.spans[at - 1][1])
            if at < len(self.spans):
                best = min(best, self.spans[at][0] - stop)
        return max(best, 0)


def assign(spans: list[tuple[int, int, str, int | None]], memory: dict[str, int], size: int = PALETTE) -> list[int]:
    """Colours of spans (begin, stop, family, fixed colour or None) in the order of the text; memory is read and written.

    Families that memory knows keep their colour; the others, as they come, take the colour whose nearest span is farthest,
    the lowest on a tie.  Spans with a fixed colour take no part.  A memory beyond its limit starts anew."""
    if len(memory) > MEMORY_LIMIT:
        memory.clear()
    families: dict[str, list[tuple[int, int]]] = {}
    for begin, stop, family, fixed in spans:
        if fixed is None:
            families.setdefault(family, []).append((begin, stop))
    lanes = [Lane() for _ in range(size)]
    chosen: dict[str, int] = {}
    known = [f for f in families if memory.get(f, size) < size]
    for family in [*known, *(f for f in families if f not in set(known))]:
        if family in memory and memory[family] < size:
            color = memory[family]
        else:
            gaps = [lane.gap(families[family]) for lane in lanes]
            color = gaps.index(max(gaps))
        lanes[color].add(families[family])
        chosen[family] = memory[family] = color
    return [chosen[family] if fixed is None else fixed for _, _, family, fixed in spans]


def colored(highlights: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """highlights (key, begin, stop, family, color or null, ...) with every colour given, document by document, from an empty
    memory.  Only what colouring reads goes through Python; a document's highlights are one group."""
    k = list(key)
    lean = highlights.select(*k, "begin", "stop", "family", F.col("color").cast("int").alias("fixed"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["begin", "stop"])
        fixed = [None if pd.isna(x) else int(x) for x in frame["fixed"]]
        spans = list(zip(frame["begin"].tolist(), frame["stop"].tolist(), frame["family"].tolist(), fixed, strict=True))
        return frame[[*k, "begin"]].assign(color=assign(spans, {}))

    types = dict(lean.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*k, "begin"]) + ", color int"
    given = lean.groupBy(*k).applyInPandas(run, schema)
    return highlights.drop("color").join(given, [*k, "begin"])
