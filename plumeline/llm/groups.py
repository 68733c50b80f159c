"""Python over groups of rows that arrive together, without a call for each small group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def map_groups(df: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str, batch: int = 2000) -> DataFrame:
    """Calls work with each group of rows that agree in keys (none of them null) and returns all it returns.

    Rows are dealt by keys and sorted; a task reads its rows in order and holds back the group at a batch's end until it is
    whole, so memory is bounded by the largest group.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        out: list[pd.DataFrame] = []
        rows = 0

        def groups():
            nonlocal held, last
            for frame in frames:
                if not len(frame):
                    continue
                k = [frame[c].to_numpy() for c in keys]
                change = np.flatnonzero(np.logical_or.reduce([a[1:] != a[:-1] for a in k])) + 1
                edges = [0, *change.tolist(), len(frame)]
                for a, b in zip(edges, edges[1:], strict=False):
                    key = tuple(x[a] for x in k)
                    if held and key != last:
                        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                        held = []
                    held.append(frame.iloc[a:b])
                    last = key
            if held:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]

        for g in groups():
            made = work(g)
            if made is not None and len(made):
                out.append(made)
                rows += len(made)
                if rows > batch:
                    yield pd.concat(out, ignore_index=True)
                    out, rows = [], 0
        if out:
            yield pd.concat(out, ignore_index=True)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)
