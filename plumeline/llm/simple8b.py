"""Token ids in files of Simple-8b words: a selector says how many ids of how many bits a 64-bit word holds."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import tokenizer, vocabulary
from .common import cut, documents, remove, shared_dir

#: Selector (the word's top four bits) -> ids in a word and bits of each.  Selector 0 is the escape: one id of 64 bits
#: follows as a raw word.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], np.int64)
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60], np.int64)
ESCAPE, LAST = 0, 14
#: Ids in a block; a block starts with a word of its own, so blocks decode apart from each other.
BLOCK = 4096
MAGIC = b"S8B1"


def _bits(ids: np.ndarray) -> np.ndarray:
    """Number of significant bits of each id."""
    if ids.max(initial=0) < 1 << 53:  # exact as a float
        return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    high, low = ids >> np.uint64(32), ids & np.uint64(0xFFFFFFFF)
    return np.where(high > 0, 32 + _bits(high), _bits(low)).astype(np.uint8)


def _greedy(blocks: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of all blocks (rows, with zeros behind their ids) start in the flat array, and their selectors: each
    word takes as many ids as fit.  The blocks are walked abreast."""
    n = blocks.shape[1] - 64
    best = np.zeros((len(blocks), n), np.uint8)
    size, window = 1, _bits(blocks)  # zeros beyond the end cost nothing
    for s in range(LAST, 0, -1):
        while size < COUNTS[s]:
            step = min(size, int(COUNTS[s]) - size)
            window = np.maximum(window[:, : window.shape[1] - step], window[:, step:])
            size += step
        best[window[:, :n] <= WIDTHS[s]] = s
    flat, takes = best.ravel(), COUNTS[best.ravel()]
    start = np.zeros(len(flat), bool)
    at = np.arange(len(blocks)) * n
    end = at + lengths
    while len(at):
        start[at] = True
        at = at + takes[at]
        on = at < end
        if not on.all():
            at, end = at[on], end[on]
    found = np.flatnonzero(start)
    return found + found // n * 64, flat[found]


def encode(ids: np.ndarray) -> bytes:
    """One payload: magic, block size, ids, words; each block's first word; the words (all little-endian)."""
    ids = np.ascontiguousarray(ids, np.uint64)
    count = -(-len(ids) // BLOCK)
    blocks = np.zeros((count, BLOCK + 64), np.uint64)
    whole = len(ids) // BLOCK
    blocks[:whole, :BLOCK] = ids[: whole * BLOCK].reshape(whole, BLOCK)
    lengths = np.full(count, BLOCK, np.int64)
    if whole < count:
        lengths[-1] = len(ids) - whole * BLOCK
        blocks[-1, : lengths[-1]] = ids[whole * BLOCK :]
    starts, selectors = _greedy(blocks, lengths)
    flat = blocks.ravel()
    raw = selectors == ESCAPE
    place = np.arange(len(starts)) + np.cumsum(raw) - raw
    words = np.zeros(len(starts) + int(raw.sum()), "<u8")
    words[place[raw] + 1] = flat[starts[raw]]
    for s in np.unique(selectors):
        if s == ESCAPE:
            continue
        mine = np.flatnonzero(selectors == s)
        word = np.full(len(mine), np.uint64(s) << np.uint64(60), np.uint64)
        for k in range(int(COUNTS[s])):
            word |= flat[starts[mine] + k] << np.uint64(k * int(WIDTHS[s]))
        words[place[mine]] = word
    firsts = place[np.searchsorted(starts, np.arange(count) * (BLOCK + 64))].astype("<u8")
    return MAGIC + struct.pack("<IQQ", BLOCK, len(ids), len(words)) + firsts.tobytes() + words.tobytes()


def decode(payload: bytes, first_block: int = 0, blocks: int | None = None) -> np.ndarray:
    """The ids of a payload, or of some of its blocks.  Words of one selector are taken apart together."""
    if payload[:4] != MAGIC:
        raise ValueError("not a Simple-8b payload")
    size, n, total = struct.unpack_from("<IQQ", payload, 4)
    count = -(-n // size) if n else 0
    firsts = np.append(np.frombuffer(payload, "<u8", count, 24).astype(np.int64), total)
    words = np.frombuffer(payload, "<u8", total, 24 + 8 * count)
    last = count if blocks is None else min(count, first_block + blocks)
    out = []
    for b in range(first_block, last):
        part = words[firsts[b] : firsts[b + 1]]
        length = min(size, n - b * size)
        selectors = (part >> np.uint64(60)).astype(np.int64)
        if (selectors == ESCAPE).any() or len(part) < len(selectors):
            heads, i = [], 0
            while i < len(part):
                heads.append(i)
                i += 2 if selectors[i] == ESCAPE else 1
            heads = np.array(heads, np.int64)
        else:
            heads = np.arange(len(part))
        chosen = selectors[heads]
        takes = COUNTS[chosen]
        starts = np.cumsum(takes) - takes
        ids = np.zeros(int(takes.sum()) + 64, np.uint64)
        for s in np.unique(chosen):
            mine = chosen == s
            if s == ESCAPE:
                ids[starts[mine]] = part[heads[mine] + 1]
                continue
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            for k in range(int(COUNTS[s])):
                ids[starts[mine] + k] = (part[heads[mine]] >> np.uint64(k * int(WIDTHS[s]))) & mask
        out.append(ids[:length])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


FILE_SCHEMA = "part int, chunk int, n_ids long, doc_ids array<long>, n_tokens array<long>, payload binary"


def write(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = 2, chunk_ids: int = 1 << 20) -> None:
    """Writes the ids of all texts of docs (doc_id, text), each with end_id behind it, in ascending order of doc_id.

    The files are Parquet containers of payloads, so that any store that Spark reaches holds them and a lost task leaves no
    half-written file: part numbers the ranges of doc_id, chunk a range's payloads of about chunk_ids ids, doc_ids and
    n_tokens name the documents whose ids a payload holds.  Null text is empty; null doc_id comes first; rows that repeat a
    doc_id follow each other, in the order of their texts' hashes; an empty table gives no rows.
    """
    lean = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranged = lean.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, chunk = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        names: list = []
        waiting: list = []

        def flush() -> pd.DataFrame:
            nonlocal chunk
            ids = np.concatenate(held)
            row = {"part": [part], "chunk": [chunk], "n_ids": [len(ids)], "doc_ids": [list(names)], "n_tokens": [[len(x) for x in held]], "payload": [encode(ids)]}
            chunk += 1
            held.clear()
            names.clear()
            return pd.DataFrame(row)

        def texts():
            for frame in frames:
                for i, t in zip(frame["doc_id"].astype(object).where(frame["doc_id"].notna(), None), frame["text"], strict=True):
                    waiting.append(None if i is None else int(i))
                    yield t

        size, done = 0, 0
        for ids in tokenizer(vocabulary_path).each(texts()):
            held.append(np.append(ids, np.uint32(end_id)).astype(np.uint32))
            names.append(waiting[done])
            done += 1
            if done > 10_000:
                del waiting[:done]
                done = 0
            size += len(held[-1])
            if size >= chunk_ids:
                yield flush()
                size = 0
        if held:
            yield flush()

    ranged.mapInPandas(run, FILE_SCHEMA).write.option("compression", "none").option("parquet.block.size", 32 << 20).parquet(path)


def read(spark, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of its ids as little-endian
    unsigned 32-bit integers."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    sizes = files.select("part", "chunk", "n_ids")
    earlier = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each range: few
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    starts = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).join(parts, "part")
    starts = starts.select("part", "chunk", (F.col("base") + F.col("inside")).alias("first"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                ids = decode(r.payload).astype("<u4")
                ends = np.cumsum(np.asarray(r.n_tokens, np.int64))
                begins = ends - np.asarray(r.n_tokens, np.int64)
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pd.DataFrame({"part": r.part, "chunk": r.chunk, "doc_id": pd.array(list(r.doc_ids), "Int64"), "inside": begins, "n_tokens": ends - begins, "ids_crc32": crcs})

    out = files.select("part", "chunk", "doc_ids", "n_tokens", "payload").mapInPandas(run, "part int, chunk int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return out.join(starts, ["part", "chunk"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents and returns what the files say of each.  The files are the query's product; what it
    says of them is cut from them, and they are removed."""
    path = f"{shared_dir(spark)}/plumeline/op7-{uuid.uuid4().hex}"
    write(documents(spark, sf_dir), path, vocabulary())
    out = cut(read(spark, path), "op7-read")
    remove(spark, path)
    return out
