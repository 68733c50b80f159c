"""Quality of documents by co-training: a content view and a page view teach each other on unlabelled documents.

The content view sees what a text says: hashed runs of three bytes of the whole text, and how often it repeats itself.  The
page view sees only metadata of the page, nothing of its text: source, language and the length it is recorded with.  Each view
is a logistic regression.  Round by round all unlabelled documents are scored by both views, and those that a view is surest
of, as many of each class as the labelled rows' share calls for, are drawn from all of them for the other view to learn from.
At the end each view is calibrated on labelled rows that it did not learn from, and the calibrated log-odds are added up with
weights fitted on the same rows, so a view that knows little weighs little.

Texts stay on the executors: the driver gets the views' features of the rows that a fit takes, whose number is a parameter.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, drop_cut
from .toxicity import held_out

GRAMS, HASHED, LENGTHS = 2048, 64, 32


def content(text: str) -> np.ndarray:
    """Square roots of the shares of hashed three-byte runs, their entropy, the largest share, and the compressed size."""
    raw = text.encode("utf-8", "surrogatepass")
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    out = np.zeros(GRAMS + 3, np.float32)
    if len(a) < 3:
        return out
    h = (a[:-2] * np.uint32(0x9E3779B1)) ^ (a[1:-1] * np.uint32(0x85EBCA6B)) ^ (a[2:] * np.uint32(0xC2B2AE35))
    n = np.bincount((h >> np.uint32(16)) % GRAMS, minlength=GRAMS)
    share = n[n > 0] / len(h)
    out[:GRAMS] = np.sqrt(n / len(h))
    out[GRAMS:] = -(share * np.log(share)).sum() / np.log(len(h) + 1), share.max(), sum(len(zlib.compress(raw[i : i + (1 << 20)], 1)) for i in range(0, len(raw), 1 << 20)) / len(raw)
    return out


def page(lang: str | None, source: str | None, length: float | None) -> np.ndarray:
    """Hashed source and language, and the recorded length in powers of two (unknown: a power of its own)."""
    out = np.zeros(2 * HASHED + LENGTHS, np.float32)
    out[zlib.crc32((source or "").encode("utf-8", "surrogatepass")) % HASHED] = 0.3
    out[HASHED + zlib.crc32((lang or "").encode("utf-8", "surrogatepass")) % HASHED] = 0.3
    known = length is not None and np.isfinite(length)
    out[2 * HASHED + (min(int(np.log2(max(length, 0) + 1)), LENGTHS - 2) if known else LENGTHS - 1)] = 0.3
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Weights, intercept, and the means and scales by which columns are standardised; classes weigh alike."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.02 * (np.abs(x).max() or 1)
    z = (x - mean) / scale
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)) / len(y)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        d = (_sigmoid(z @ w + b) - y) * weight
        g = np.append(z.T @ d + penalty * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - step[-1]
    return w, b, mean, scale


def apply(model, x: np.ndarray) -> np.ndarray:
    w, b, mean, scale = model
    return ((x - mean) / scale) @ w + b


def _curve(x: np.ndarray, y: np.ndarray) -> tuple:
    """Weights, none negative, and intercept of a small logistic regression."""
    w, b = np.full(x.shape[1], 1.0 / x.shape[1]), 0.0
    for _ in range(400):
        d = (_sigmoid(x @ w + b) - y) / len(y)
        w, b = np.maximum(w - 0.3 * (x.T @ d + 1e-3 * w), 0), b - 0.3 * d.sum()
    return (*w, b)


class Pair:
    """Both views' models, their calibration and the weights of their log-odds."""

    def __init__(self, views: tuple[np.ndarray, np.ndarray], y: np.ndarray):
        self.views, self.y = views, y.astype(np.float32)
        self.prior = float(np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98))
        self.hold = np.arange(len(y)) % 4 == 3  # for the calibration
        self.known = len(np.unique(self.y[self.hold])) == 2 and len(np.unique(self.y[~self.hold])) == 2
        #: What each view was taught by the other: features and labels.
        self.taught = [(np.zeros((0, v.shape[1]), np.float32), np.zeros(0, np.float32)) for v in views]

    def teach(self, view: int, x: np.ndarray, y: np.ndarray) -> None:
        a, b = self.taught[view]
        self.taught[view] = np.concatenate([a, x]), np.concatenate([b, y.astype(np.float32)])

    def fit(self) -> None:
        own = ~self.hold
        self.models = [logistic(np.concatenate([self.views[k][own], self.taught[k][0]]), np.concatenate([self.y[own], self.taught[k][1]]), (2e-3, 1e-3)[k]) for k in (0, 1)]

    def calibrate(self) -> None:
        logits = np.stack([apply(self.models[k], self.views[k][self.hold]) for k in (0, 1)], axis=1)
        self.curves = [_curve(logits[:, k : k + 1], self.y[self.hold]) for k in (0, 1)]
        self.joint = _curve(np.stack([a * logits[:, k] + c for k, (a, c) in enumerate(self.curves)], axis=1), self.y[self.hold])
        self.views, self.taught = (), []

    def scores(self, views: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each view's and the joint probability of good quality."""
        if not self.known:
            return tuple(np.full(len(views[0]), self.prior) for _ in range(3))
        odds = [a * apply(self.models[k], views[k]) + c for k, (a, c) in enumerate(self.curves)]
        a, b, c = self.joint
        return _sigmoid(odds[0]), _sigmoid(odds[1]), _sigmoid(a * odds[0] + b * odds[1] + c)


def views_of(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    if not len(frame):
        return np.zeros((0, GRAMS + 3), np.float32), np.zeros((0, 2 * HASHED + LENGTHS), np.float32)
    clean = lambda c: frame[c].astype(object).where(frame[c].notna(), None)
    return np.stack([content(t) for t in frame["text"]]), np.stack([page(*r) for r in zip(clean("lang"), clean("source"), clean("length"), strict=True)])


def _mapped(df: DataFrame, work: Callable[[pd.DataFrame, tuple], dict], schema: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), 500):
                part = frame.iloc[a : a + 500]
                yield pd.DataFrame(work(part, views_of(part)))

    return df.mapInPandas(run, schema)


def _features(rows: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Views and labels of rows (a bounded number), worked out where the rows are; in the order of place."""
    made = _mapped(rows, lambda f, v: {"place": f["place"], "label": f["label"], "one": list(v[0]), "two": list(v[1])}, "place long, label int, one array<float>, two array<float>")
    got = made.toPandas().sort_values("place", kind="stable")
    stack = lambda c, width: np.stack([np.asarray(x, np.float32) for x in got[c]]) if len(got) else np.zeros((0, width), np.float32)
    return (stack("one", GRAMS + 3), stack("two", 2 * HASHED + LENGTHS)), got["label"].to_numpy()


def _co_trained(lean: DataFrame, known: DataFrame, labelled: int, rounds: int, each: int) -> Pair:
    chosen = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    chosen = chosen.select("doc_id", F.col("quality").cast("int").alias("label"))
    sample = lean.join(F.broadcast(chosen), "doc_id").withColumn("place", F.xxhash64("doc_id", "text")).orderBy("place").limit(2 * labelled)
    views, y = _features(sample)
    pair = Pair(views, y)
    if not pair.known:
        return pair
    pair.fit()
    pool = lean.withColumn("place", F.xxhash64("doc_id", "text"))
    done: list[set[int]] = [set(), set()]
    for _ in range(rounds):
        models = pair.models
        scored = _mapped(pool, lambda f, v, m=models: {"doc_id": f["doc_id"], "place": f["place"], "l0": apply(m[0], v[0]).astype(float), "l1": apply(m[1], v[1]).astype(float)}, "doc_id long, place long, l0 double, l1 double")
        # scores, not texts, are told from those of labelled documents
        scored = cut(scored.join(known.select("doc_id"), "doc_id", "left_anti").dropDuplicates(["place"]), "quality-pool")
        for k in (0, 1):
            logit, picks = F.col(f"l{k}"), []
            for label, most in ((1, round(each * pair.prior)), (0, round(each * (1 - pair.prior)))):
                sure = scored.where(logit > 1 if label else logit < -1).orderBy(logit.desc() if label else logit.asc(), "place")
                picks += [(r.place, label) for r in sure.limit(most + len(done[1 - k])).collect() if r.place not in done[1 - k]][:most]
            if picks:
                done[1 - k] |= {p for p, _ in picks}
                table = lean.sparkSession.createDataFrame(picks, "place long, label int")
                (one, two), labels = _features(pool.join(F.broadcast(table), "place").dropDuplicates(["place"]))
                pair.teach(1 - k, (one, two)[1 - k], labels)
        drop_cut(scored)
        pair.fit()
    return pair


def score(docs: DataFrame, labels: DataFrame, labelled: int = 3000, rounds: int = 2, each: int = 400) -> DataFrame:
    """doc_id, held_out, text_score, page_score, score (0 to 1, higher: better), predicted (1 from 0.5 on: keep), for each
    row of docs (doc_id, text, lang, source, and n_chars if it has it), by its whole text.

    Learns from at most `labelled` labelled documents, none of the held-out ones, the first by a hash of doc_id, and in each
    of `rounds` rounds from at most `each` unlabelled documents for each view, the surest of all.  Null text is empty; null
    source, language or length is one of its own; without labels of both classes every score is the share known; rows alike
    get like scores; an empty table gives an empty table; further columns of docs are not read.
    """
    length = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), length.alias("length"))
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    pair = _co_trained(lean, known, labelled, rounds, each)
    if pair.known:
        pair.calibrate()

    def work(frame: pd.DataFrame, views: tuple) -> dict:
        one, two, both = pair.scores(views)
        return {"doc_id": frame["doc_id"], "held_out": frame["held_out"], "text_score": one.astype(float), "page_score": two.astype(float), "score": both.astype(float), "predicted": (both >= 0.5).astype(np.int32)}

    return _mapped(lean.withColumn("held_out", held_out(F.col("doc_id"))), work, "doc_id long, held_out boolean, text_score double, page_score double, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    """All documents, learned from labels.quality."""
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
