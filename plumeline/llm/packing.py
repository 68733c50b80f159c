"""Bounded-space online packing of token ids into windows of fixed length."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import tokenizer, vocabulary
from .common import cut, documents

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part int, ids binary"


class OpenWindows:
    """At most `most` open windows of `length` ids.  A piece goes to the window with the least room that holds it; when
    none does, the fullest is emitted if all are open, and the piece opens a new one."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.rooms: list[tuple[int, int]] = []  # (room left, window), sorted
        self.held: dict[int, list] = {}
        self.next = 0

    def place(self, piece, size: int) -> list[tuple[int, list]]:
        out = []
        at = bisect.bisect_left(self.rooms, (size, -1))
        if at < len(self.rooms):
            room, window = self.rooms.pop(at)
        else:
            if len(self.rooms) == self.most:
                out.append(self.emit())
            room, window = self.length, self.next
            self.next += 1
            self.held[window] = []
        self.held[window].append((piece, self.length - room))
        if room == size:
            out.append((window, self.held.pop(window)))
        else:
            bisect.insort(self.rooms, (room - size, window))
        return out

    def emit(self) -> tuple[int, list]:
        _, window = self.rooms.pop(0)
        return window, self.held.pop(window)


def _rows(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids"])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame


def _packer(vocabulary_path: str, length: int, most: int, end_id: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        windows = OpenWindows(length, most)
        out: list[tuple] = []
        waiting: list = []

        def texts():
            for frame in frames:
                for i, t in zip(frame["doc_id"].astype(object).where(frame["doc_id"].notna(), None), frame["text"], strict=True):
                    waiting.append(i)
                    yield t

        def put(window: int, pieces: list, left: bool = False) -> None:
            for (doc, start, ids, total), offset in pieces:
                raw = ids.astype("<u4").tobytes()
                out.append((doc, start, len(ids), zlib.crc32(raw), total, (part << 32) + window, offset, part, raw if left else None))

        done = 0
        for ids in tokenizer(vocabulary_path).each(texts()):
            doc, ids = waiting[done], np.append(ids, np.uint32(end_id))
            done += 1
            if done > 10_000:
                del waiting[:done]
                done = 0
            total, cutting = len(ids), len(ids) // length * length
            for a in range(0, cutting, length):  # full windows of its own
                put(windows.next, [((doc, a, ids[a : a + length], total), 0)])
                windows.next += 1
            if cutting < total:
                for window, pieces in windows.place((doc, cutting, ids[cutting:].copy(), total), total - cutting):
                    put(window, pieces)
            if len(out) > 5_000:
                yield _rows(out)
                out.clear()
        while windows.rooms:
            put(*windows.emit(), left=True)
        yield _rows(out)

    return run


def _merger(length: int, level: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["sequence_id", "offset"])
        base = ((level << 24) + int(key[0]) << 32) | (1 << 62)
        at, out = 0, []
        for r in frame.itertuples(index=False):
            ids, start = np.frombuffer(r.ids, "<u4"), r.start
            while len(ids):
                take = min(len(ids), length - at % length)
                raw = ids[:take].tobytes()
                doc = None if pd.isna(r.doc_id) else int(r.doc_id)
                out.append((doc, start, take, zlib.crc32(raw), r.doc_tokens, base + at // length, at % length, int(key[0]), raw))
                ids, start, at = ids[take:], start + take, at + take
        full = base + at // length
        return _rows([(*row[:-1], row[-1] if row[5] == full else None) for row in out])

    return run


def pack(docs: DataFrame, vocabulary_path: str, length: int = 1024, most: int = 64, end_id: int = 0, fan: int = 64) -> DataFrame:
    """Packs the ids of all texts of docs (doc_id, text), each with end_id behind it, into sequences of at most length ids.

    Each partition of the input keeps `most` open windows; a document's full windows go out as they are and its rest is
    placed best-fit (see OpenWindows), so nothing is shuffled and memory is bounded.  The windows that are left open, at
    most `most` a partition, are merged: those of `fan` partitions are laid end to end and cut anew, and so on until one
    group is left, which leaves one sequence that isn't full.

    Returns a row for each piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id,
    offset.  Null text is empty and so one id; rows alike are packed apart; an empty table gives an empty table.
    """
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed = cut(lean.mapInPandas(_packer(vocabulary_path, length, most, end_id), PIECE), "pack")
    done = [placed.where("ids is null")]
    left = placed.where("ids is not null")
    groups = (left.agg(F.max("part")).first()[0] or 0) + 1
    level = 0
    while True:
        level += 1
        grouped = left.withColumn("part", F.expr(f"cast(part div {fan} as int)"))
        merged = grouped.groupBy("part").applyInPandas(_merger(length, level), PIECE)
        groups = -(-groups // fan)
        if groups == 1:
            done.append(merged)
            break
        merged = cut(merged, "pack-merge")
        done.append(merged.where("ids is null"))
        left = merged.where("ids is not null")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("part", "ids")


def query(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 ids, id 0 behind each document."""
    return pack(documents(spark, sf_dir), vocabulary())
