"""Toxicity of whole texts: a bidirectional gated recurrent network over words and their characters, trained in numpy.

A word enters as the sum of its own embedding and the mean of its character n-grams' embeddings (both in hashed tables), so
unseen forms of a known stem are understood.  Two GRUs read a window of words in both directions, attention pools their
states, and one unit gives the window's logit.  A document's score is that of its highest window; windows overlap by a third
and cover the whole text.  Labels hold for documents, so training takes, epoch by epoch, the window that the model itself
finds highest (after a first epoch on windows drawn at random).
"""

from __future__ import annotations

import pickle
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents

#: A run of letters and digits; a longer one than 40 is cut into successive words.
WORDS = re.compile(r"[^\W_]{1,40}")
WINDOW, STRIDE = 48, 32
WORD_ROWS, GRAM_ROWS, WIDTH, HIDDEN = 1 << 13, 1 << 14, 16, 12
GRAMS = (3, 5)
DECAY = 0.3
BATCH, LEAST_STEPS = 64, 300
#: Characters that are scored together (a longer text is scored alone), and characters of all texts that training takes.
BATCH_CHARS, SAMPLE_CHARS = 300_000, 60_000_000


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32(doc_id as text) mod 5 is 0.  A null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's row in the word table; all their n-grams' rows in the character table, word by word; the word that each
    n-gram belongs to.  n-grams are of GRAMS bytes of "<word>"; a word has one n-gram at least."""
    rows = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_ROWS for w in words], np.int64)
    coded = [f"<{w}>".encode("utf-8", "surrogatepass") for w in words]
    size = np.array([len(c) for c in coded], np.int64)
    raw = np.frombuffer(b"".join(coded) + bytes(max(GRAMS)), np.uint8).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), size)
    end = np.repeat(np.cumsum(size), size)
    at = np.arange(len(of))
    begin = end - np.repeat(size, size)
    grams, owner = [], []
    for n in GRAMS:
        h = np.full(len(of), n, np.uint64)
        for k in range(n):
            h = (h ^ np.where(at + k < end, raw[k : k + len(of)], 0)) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
        fits = (at + n <= end) | (at == begin)
        grams.append((h[fits] % np.uint64(GRAM_ROWS)).astype(np.int32))
        owner.append(of[fits].astype(np.int32))
    order = np.argsort(np.concatenate(owner), kind="stable")
    return rows, np.concatenate(grams)[order], np.concatenate(owner)[order]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters by name; both directions are stacked on the first axis, so one step moves both."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        n = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {
            "word": n(WORD_ROWS, WIDTH, scale=0.1), "gram": n(GRAM_ROWS, WIDTH, scale=0.1),
            "wx": n(2, WIDTH, 3 * HIDDEN, scale=WIDTH**-0.5), "wh": n(2, HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), "b": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "att": n(2 * HIDDEN, HIDDEN, scale=0.3), "attv": n(HIDDEN, scale=0.3), "out": n(2 * HIDDEN, scale=0.3), "bias": np.full(1, -1, np.float32),
        }

    def word_vectors(self, rows: np.ndarray, grams: np.ndarray, owner: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
        """rows: word row of each distinct word; grams: all their n-gram rows; owner: the word each n-gram belongs to."""
        count = np.bincount(owner, minlength=len(rows))
        at = np.cumsum(count) - count
        count = count.astype(np.float32)
        mean = np.add.reduceat(self.p["gram"][grams], at, axis=0) / count[:, None]
        own = self.p["word"][rows]
        return (own if keep is None else own * keep[:, None]) + 2 * mean

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x: (2, T, B, 3H) input gates, the second direction in reverse order; mask: (2, T, B, 1)."""
        _, steps, size, _ = x.shape
        h = np.zeros((2, size, HIDDEN), np.float32)
        states = np.empty((2, steps, size, HIDDEN), np.float32)
        tape = []
        for t in range(steps):
            g = h @ self.p["wh"]
            zr = 1 / (1 + np.exp(-(x[:, t, :, : 2 * HIDDEN] + g[..., : 2 * HIDDEN])))
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            n = np.tanh(x[:, t, :, 2 * HIDDEN :] + r * g[..., 2 * HIDDEN :])
            new = n + z * (h - n)
            if keep:
                tape.append((h, z, r, n, g[..., 2 * HIDDEN :]))
            h = np.where(mask[:, t], new, h)
            states[:, t] = h
        both = np.concatenate([states[0], states[1][::-1]], axis=-1)  # (T, B, 2H), in the text's order
        a = np.tanh(both @ self.p["att"])
        score = a @ self.p["attv"]
        score = np.where(mask[0, :, :, 0], score, -1e9)
        w = np.exp(score - score.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", w, both)
        logit = pooled @ self.p["out"] + self.p["bias"]
        return logit, (tape, both, a, w, pooled)

    def gates(self, vectors: np.ndarray) -> np.ndarray:
        """(2, words, 3H)"""
        return vectors @ self.p["wx"] + self.p["b"]

    def known_gates(self, rows: np.ndarray, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Gates of all words, 10,000 at a time; bounds: where each word's n-grams start, and their end."""
        out = np.empty((2, len(rows), 3 * HIDDEN), np.float32)
        for a in range(0, len(rows), 10_000):
            b = min(a + 10_000, len(rows))
            owner = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
            out[:, a:b] = self.gates(self.word_vectors(rows[a:b], grams[bounds[a] : bounds[b]], owner))
        return out

    def logits(self, gates: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """windows: (B, T) rows of gates, -1 beyond the window's end."""
        out = np.empty(len(windows), np.float32)
        for a in range(0, len(windows), 1024):
            x, mask = _laid(gates, windows[a : a + 1024])
            out[a : a + 1024] = self.forward(x, mask)[0]
        return out

    def gradients(self, rows, grams, owner, windows, labels, weights, keep) -> dict[str, np.ndarray]:
        p = self.p
        vectors = self.word_vectors(rows, grams, owner, keep)
        x, mask = _laid(self.gates(vectors), windows)
        logit, (tape, both, a, w, pooled) = self.forward(x, mask, keep=True)
        d = (_sigmoid(logit) - labels) * weights / weights.sum()
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "gram")}
        g["out"], g["bias"] = d @ pooled, np.array([d.sum()], np.float32)
        dpool = d[:, None] * p["out"]
        dw = np.einsum("bh,tbh->tb", dpool, both)
        ds = w * (dw - (w * dw).sum(axis=0))
        da = ds[..., None] * p["attv"] * (1 - a * a)
        g["attv"] = np.einsum("tb,tbh->h", ds, a)
        g["att"] = np.einsum("tbi,tbj->ij", both, da)
        dboth = w[..., None] * dpool + da @ p["att"].T
        dstates = np.stack([dboth[..., :HIDDEN], dboth[::-1, :, HIDDEN:]])
        dh = np.zeros_like(tape[0][0])
        dx = np.zeros_like(x)
        wt = p["wh"].transpose(0, 2, 1)
        for t in range(x.shape[1] - 1, -1, -1):
            h, z, r, n, gn = tape[t]
            dh = dh + dstates[:, t]
            live = dh * mask[:, t]
            dn = live * (1 - z) * (1 - n * n)
            dz = live * (h - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dg = np.concatenate([dz, dr, dn * r], axis=-1)
            dx[:, t] = np.concatenate([dz, dr, dn], axis=-1)
            g["wh"] += h.transpose(0, 2, 1) @ dg
            dh = np.where(mask[:, t], live * z + dg @ wt, dh)
        dgates = np.zeros((2, len(rows), 3 * HIDDEN), np.float32)
        order = np.stack([windows.T, windows.T[::-1]])
        for k in range(2):
            at = order[k].ravel()
            np.add.at(dgates[k], at[at >= 0], dx[k].reshape(-1, 3 * HIDDEN)[at >= 0])
        g["b"] = dgates.sum(axis=1, keepdims=True)
        g["wx"] = vectors.T @ dgates
        dv = (dgates @ p["wx"].transpose(0, 2, 1)).sum(axis=0)
        g["word"] = (rows, dv * keep[:, None])
        count = np.bincount(owner, minlength=len(rows)).astype(np.float32)
        g["gram"] = (grams, (2 * dv / count[:, None])[owner])
        return g


def _laid(gates: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.stack([windows.T, windows.T[::-1]])
    x = np.stack([gates[0][order[0]], gates[1][order[1]]])
    return x, (order >= 0)[..., None]


class Adam:
    """For tables of embeddings only the rows that a batch touches are moved."""

    def __init__(self, params: dict[str, np.ndarray], rate: float, decay: float = DECAY):
        self.rate, self.decay, self.t = rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, params, grads) -> None:
        self.t += 1
        c1, c2 = 1 - 0.9**self.t, 1 - 0.99**self.t
        for k, g in grads.items():
            if isinstance(g, tuple):
                at, inverse = np.unique(g[0], return_inverse=True)
                total = np.zeros((len(at), WIDTH), np.float32)
                np.add.at(total, inverse, g[1])
            else:
                at, total = ..., g
            m = self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * total
            v = self.v[k][at] = 0.99 * self.v[k][at] + 0.01 * total * total
            params[k][at] = (1 - self.decay * self.rate) * params[k][at] - self.rate * (m / c1) / (np.sqrt(v / c2) + 1e-7)


def windows_of(count: int) -> np.ndarray:
    """Starts of the overlapping windows of a text of count words; the last one ends with the text."""
    if count <= WINDOW:
        return np.zeros(min(count, 1), np.int64)
    return np.append(np.arange(0, count - WINDOW, STRIDE), count - WINDOW)


class Indexed:
    """Texts as rows of distinct words, and their windows."""

    def __init__(self, texts: Iterable[str]):
        known: dict[str, int] = {}
        flat = array("i")
        windows, owner = [], []
        for k, t in enumerate(texts):
            base = len(flat)
            flat.extend([known.setdefault(w, len(known)) for w in WORDS.findall((t or "").lower())])
            starts = windows_of(len(flat) - base) + base
            windows.append(np.stack([starts, np.minimum(starts + WINDOW, len(flat))], axis=1))
            owner.append(np.full(len(starts), k))
        self.words = list(known)
        self.flat = np.concatenate([np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32), np.full(WINDOW, -1, np.int32)])
        self.windows = np.concatenate(windows) if windows else np.zeros((0, 2), np.int64)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)

    def rows(self, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        """(B, T) word numbers of windows, -1 beyond their ends."""
        w = self.windows[which]
        at = w[:, :1] + np.arange(WINDOW)
        return np.where(at < w[:, 1:], self.flat[np.minimum(at, len(self.flat) - 1)], -1)


def train(texts: list[str], labels: np.ndarray, epochs: int = 6, seed: int = 5, rate: float = 0.01) -> tuple[Network, float]:
    """The network and the score of a text without words (the share of label 1).  Fixed seed, same rows: same network."""
    rng = np.random.default_rng(seed)
    net, data = Network(seed), Indexed(texts)
    labels = np.asarray(labels, np.float32)
    prior = float((labels.sum() + 0.5) / (len(labels) + 1)) if len(labels) else 0.0
    if not len(data.windows) or labels.min() == labels.max():
        net.p["out"][:] = 0
        net.p["bias"][:] = np.log(max(prior, 1e-3) / max(1 - prior, 1e-3)) if len(labels) else -5
        return net, prior
    parts = [features(data.words[a : a + 10_000]) for a in range(0, len(data.words), 10_000)]
    rows, grams = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.bincount(p[2], minlength=len(p[0])) for p in parts]))])
    del parts
    adam = Adam(net.p, rate)
    doc, first = np.unique(data.owner, return_index=True)
    last = np.append(first[1:], len(data.owner))
    epochs = max(epochs, min(40, -(-LEAST_STEPS * BATCH // (2 * len(doc)))))  # few documents: more rounds
    for epoch in range(epochs):
        draw = first + (rng.random(len(doc)) * (last - first)).astype(np.int64)
        if epoch == 0:
            more = first + (rng.random(len(doc)) * (last - first)).astype(np.int64)
            chosen = np.unique(np.concatenate([draw, more]))
        else:
            gates = net.known_gates(rows, grams, bounds)
            logit = np.concatenate([net.logits(gates, data.rows(slice(a, a + 4096))) for a in range(0, len(data.windows), 4096)])
            del gates
            top = np.lexsort((-logit, data.owner))
            top = top[np.searchsorted(data.owner[top], doc)]
            chosen = np.unique(np.concatenate([top, draw[labels[doc] == 0]]))
        rng.shuffle(chosen)
        if epoch == epochs - 2:
            adam.rate = rate / 4
        for a in range(0, len(chosen), BATCH):
            batch = chosen[a : a + BATCH]
            windows = data.rows(batch)
            here, local = np.unique(windows[windows >= 0], return_inverse=True)
            windows[windows >= 0] = local
            span = bounds[here + 1] - bounds[here]
            at = np.repeat(bounds[here] - np.cumsum(span) + span, span) + np.arange(span.sum())
            y = labels[data.owner[batch]]
            keep = (rng.random(len(here)) > 0.3).astype(np.float32)
            grads = net.gradients(rows[here], grams[at], np.repeat(np.arange(len(here)), span), windows, y, np.ones(len(y), np.float32), keep)
            adam.step(net.p, grads)
    return net, prior


class Scorer:
    """Scores texts with a network; keeps the input gates of up to `most` distinct words."""

    def __init__(self, net: Network, empty: float, most: int = 100_000):
        self.net, self.empty, self.most = net, empty, most
        self.known: dict[str, int] = {}
        self.gates = np.zeros((2, most, 3 * HIDDEN), np.float32)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Row of each word's gates."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = words
            if len(new) > self.most:
                self.most = len(new)
                self.gates = np.zeros((2, self.most, 3 * HIDDEN), np.float32)
        if new:
            base = len(self.known)
            self.known |= {w: base + k for k, w in enumerate(new)}
            for a in range(0, len(new), 10_000):
                part = new[a : a + 10_000]
                self.gates[:, base + a : base + a + len(part)] = self.net.gates(self.net.word_vectors(*features(part)))
        return np.array([self.known[w] for w in words], np.int64)

    def scores(self, texts: list[str]) -> np.ndarray:
        data = Indexed(texts)
        out = np.full(len(texts), self.empty)
        if len(data.windows):
            number = np.append(self._numbers(data.words), -1)
            best = np.full(len(texts), -np.inf)
            for a in range(0, len(data.windows), 2048):
                logit = self.net.logits(self.gates, number[data.rows(slice(a, a + 2048))])
                np.maximum.at(best, data.owner[a : a + 2048], logit)
            out = np.where(np.isfinite(best), _sigmoid(best), out)
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """At most `most` toxic rows and twice as many others (place, text, toxic), the first by a hash of doc_id and text, none of
    the held-out rows; of these, as many from the first on as have SAMPLE_CHARS characters together."""
    ids = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, most), (0, 2 * most))]
    chosen = parts[0].unionByName(parts[1])
    rows = ids.join(F.broadcast(chosen), "doc_id").withColumn("place", F.xxhash64("doc_id", "text"))
    places = rows.select("place", F.length("text").alias("n")).orderBy("place").limit(4 * most)
    places = places.withColumn("until", F.sum("n").over(Window.orderBy("place"))).where(F.col("until") <= SAMPLE_CHARS).select("place").distinct()
    return rows.join(F.broadcast(places), "place").orderBy("place", "text").limit(4 * most).select("place", "text", "toxic")


def trained(sample: DataFrame) -> tuple[Network, float]:
    """train() on a labelled sample, in one task: the driver gets the network, never the texts nor what training takes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"place": [], "text": [], "toxic": []}, dtype=object), *frames]).sort_values(["place", "text"], kind="stable")
        yield pd.DataFrame({"made": [pickle.dumps(train(rows["text"].tolist(), rows["toxic"].to_numpy(np.int64)))]})

    got = sample.coalesce(1).mapInPandas(run, "made binary").first()
    return pickle.loads(got["made"]) if got else train([], np.zeros(0))  # a plan that is empty runs no task


def _judged(docs: DataFrame, labels: DataFrame, most: int):
    """A function from texts to scores, made anew in each task."""
    net, empty = trained(labelled_sample(docs, labels, most))

    def start():
        mine = Scorer(net, empty)

        def scores(texts: list[str]) -> np.ndarray:
            out, a, size = [], 0, 0
            for b, t in enumerate(texts, 1):
                size += len(t)
                if size > BATCH_CHARS or b == len(texts):
                    out.append(mine.scores(texts[a:b]))
                    a, size = b, 0
            return np.concatenate(out) if out else np.zeros(0)

        return scores

    return start


def score(docs: DataFrame, labels: DataFrame, most: int = 1000) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on) of each row of docs, by its whole text.

    Learns from at most `most` toxic and twice as many other labelled rows, the first by a hash of doc_id.  Nothing but the
    text enters a score.  Null text is empty; a text without words gets the sample's share of toxic rows; an empty table
    gives an empty table; without labels of both kinds every score is the share known.  Rows alike get like scores.
    """
    start = _judged(docs, labels, most)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = start()
        for frame in frames:
            s = scores(frame["text"].tolist())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return lean.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def filtered(docs: DataFrame, labels: DataFrame, most: int = 1000, limit: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below limit.  See score for all else."""
    start = _judged(docs, labels, most)

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores = start()
        for texts in batches:
            yield pd.Series(scores(texts.tolist()))

    return docs.where(toxic(F.coalesce("text", F.lit(""))) < limit)


def query(spark, sf_dir: str) -> DataFrame:
    """All documents, learned from labels.toxic."""
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
