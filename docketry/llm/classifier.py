"""Quality classifier: ordinal cumulative-link regression on hashed text.

P(grade >= k) = sigmoid(w . x - threshold_k): one weight per hashed feature, shared by
all grades, and ordered thresholds. Features are the distinct lower-case words of the
whole text, the beginnings of the longer ones, and a few coarse facts of its form (each in
bins), hashed to DIMENSIONS.

Grades come from the labels: one point for good quality and one for the lack of
toxicity, so 0, 1 or 2. The model is fitted on the driver on at most `sample` labelled
documents, those whose keys have the least seeded hash (the bound is a parameter; SAMPLE
rows of at most DIMENSIONS features); scoring covers every row.

Defined cases: a null or empty text has the features of form alone; a key labelled more
than once has its worst label; labels with nulls, and keys without a document, teach
nothing; without any usable label the expected grade is null and every row is kept; equal
texts get equal scores; an empty table gives an empty table. Only the named columns are
read, but `keep` hands every column through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 18
#: Labelled documents that the model is fitted on, at most.
SAMPLE = 10_000
#: Features that fewer of them have are left out.
MIN_DOCUMENTS = 4
GRADES = 3
#: A document is kept if its chance of the best grade is at least this.
THRESHOLD = 0.6
#: Bytes of a longer word's beginning, a feature of its own.
HEAD = 5
#: Standard deviations by which a feature must tell the grades apart.
SCORE = 4.5

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SYMBOLS = b"#*$%&|<>!"


def _form(raw: bytes, n_words: int, n_distinct: int) -> list[str]:
    """Facts about form, each a bin on a rough logarithmic scale."""
    size = max(len(raw), 1)
    codes = np.frombuffer(raw, np.uint8)
    capitals = int(((codes - 65) < 26).sum())
    symbols = sum(map(raw.count, (bytes([c]) for c in _SYMBOLS)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    bins = lambda part, whole: int(min(20 * part // max(whole, 1), 20))
    return [
        f"\x00words{n_words.bit_length()}",
        f"\x00capitals{bins(capitals, size)}",
        f"\x00symbols{bins(symbols, n_words)}",
        f"\x00distinct{bins(n_distinct, n_words)}:{min(n_words.bit_length(), 8)}",
        f"\x00lines{bins(len(set(lines)), len(lines))}",
        f"\x00length{min(size // max(n_words, 1), 20)}",
    ]


class Features:
    """Hashed features of texts; remembers the hashes of words it has met."""

    def __init__(self, dimensions: int = DIMENSIONS, remembered: int = 500_000):
        self.dimensions, self.remembered, self.known = dimensions, remembered, {}

    def __call__(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode()
        words = raw.translate(_FOLD).split()
        distinct = set(words)
        heads = {b"\x01" + w[:HEAD] for w in distinct if len(w) > HEAD}
        form, distinct = _form(raw, len(words), len(distinct)), distinct | heads
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        for w in distinct.difference(known):
            known[w] = zlib.crc32(w) % self.dimensions
        ids = np.fromiter(map(known.__getitem__, distinct), np.int32, len(distinct))
        more = [zlib.crc32(x.encode()) % self.dimensions for x in form]
        return np.unique(np.concatenate((ids, np.array(more, np.int32))))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, one per hashed feature
    thresholds: np.ndarray  # ascending, one per grade above 0

    def tails(self, ids: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        z = float(self.weights[ids].sum()) - self.thresholds
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def telling(rows: list[np.ndarray], grades: np.ndarray, dimensions: int, grade_count: int) -> np.ndarray:
    """Features whose score test against the model without weights exceeds SCORE: the
    thousands of words that tell nothing would add noise with the length of a text."""
    mean = np.array([(grades >= k).mean() for k in range(grade_count + 1)]).clip(1e-6, 1 - 1e-6)
    mean[0], mean[-1] = 1, 0
    slope = (mean * (1 - mean))[grades] / (mean[grades] - mean[grades + 1]) - (mean * (1 - mean))[grades + 1] / (mean[grades] - mean[grades + 1])
    sums, used = np.zeros(dimensions), np.zeros(dimensions)
    for r, s in zip(rows, slope, strict=True):
        sums[r] += s
        used[r] += 1
    spread = np.maximum(used * (1 - used / max(len(rows), 1)) * slope.var(), 1e-12)
    return np.flatnonzero((used >= MIN_DOCUMENTS) & (np.abs(sums - used * slope.mean()) >= SCORE * np.sqrt(spread)))


def fit(rows: list[np.ndarray], grades: np.ndarray, dimensions: int = DIMENSIONS, grade_count: int = GRADES, rounds: int = 400, rate: float = 0.05, ridge: float = 1.0) -> Model:
    """Maximum penalised likelihood by full-batch Adam; deterministic."""
    live = telling(rows, grades, dimensions, grade_count)
    place = np.full(dimensions, -1, np.int64)
    place[live] = np.arange(len(live))
    kept = [place[r][place[r] >= 0] for r in rows]
    sizes = np.array([len(k) for k in kept])
    flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(kept)), sizes)
    share = np.array([(grades >= k).mean() for k in range(1, grade_count)]).clip(1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    # thresholds: t_1 = b, t_k = t_(k-1) + exp(gap_k): ordered whatever the parameters
    theta = np.concatenate((np.zeros(len(live)), first[:1], np.log(np.maximum(np.diff(first), 1e-2))))
    n, m, v = len(live), np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for step in range(1, rounds + 1):
        gaps = np.exp(theta[n + 1 :])
        cuts = theta[n] + np.concatenate(([0.0], np.cumsum(gaps)))
        z = np.bincount(of, theta[:n][flat], len(kept))
        above = np.concatenate((np.ones((len(kept), 1)), sigmoid(z[:, None] - cuts), np.zeros((len(kept), 1))), axis=1)
        at = np.arange(len(kept))
        low, high = above[at, grades], above[at, grades + 1]  # P(grade >= y), P(grade >= y + 1)
        chance = np.maximum(low - high, 1e-12)
        d_low, d_high = low * (1 - low) / chance, high * (1 - high) / chance  # d log-likelihood by z at either cut
        slope = d_low - d_high
        grad = np.empty_like(theta)
        grad[:n] = np.bincount(flat, slope[of], n) - ridge * theta[:n]
        by_cut = np.array([-(d_low * (grades == k)).sum() + (d_high * (grades == k - 1)).sum() for k in range(1, grade_count)])
        grad[n] = by_cut.sum()
        grad[n + 1 :] = gaps * np.cumsum(by_cut[::-1])[::-1][1:]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(dimensions, np.float32)
    weights[live] = theta[:n]
    return Model(weights, theta[n] + np.concatenate(([0.0], np.cumsum(np.exp(theta[n + 1 :])))))


def graded(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, grade: the worst of a key's labels, quality + (1 - toxic)."""
    valid = labels.where(F.col(key).isNotNull() & F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1))
    return valid.groupBy(key).agg(F.min(F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, seed: int = 11) -> Model | None:
    """A model of the labels; None without any usable one."""
    chosen = graded(labels, key).orderBy(F.xxhash64(key, F.lit(seed)), key).limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [features(t.as_py()).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["key", "grade", "ids"])

    texts = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    joined = texts.join(F.broadcast(chosen), key).select(F.col(key).cast("long").alias("key"), "grade", "text")  # `sample` rows at most
    rows = joined.mapInArrow(run, "key long, grade int, ids binary").groupBy("key").agg(F.min("grade").alias("grade"), F.min("ids").alias("ids")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r["key"])
    return fit([np.frombuffer(r["ids"], np.int32) for r in rows], np.array([r["grade"] for r in rows]))


def scored(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`_row` (all columns of docs) and `_score` (expected_grade, tails: P(grade >= k), k = 1, 2)."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(text).cast("string").alias("_text"))
    if model is None:
        return rows.select("_row", F.lit(None).cast("struct<expected_grade:double,tails:array<double>>").alias("_score"))
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # DIMENSIONS numbers

    @F.pandas_udf("struct<expected_grade:double,tails:array<double>>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features, own = Features(), Model(*held.value)
        for texts in batches:
            tails = np.array([own.tails(features(t)) for t in texts]).reshape(-1, GRADES - 1)
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1), "tails": list(tails)})

    return rows.select("_row", score("_text").alias("_score"))


def accepted(threshold: float) -> Column:
    return F.coalesce(F.col("_score.tails")[GRADES - 2] >= threshold, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """key, expected_grade, p_grade_1, p_grade_2, kept (p_grade_2 >= threshold) for every row."""
    found = scored(docs.select(key, text), train(docs, labels, key, text, sample), text)
    tails = [F.col("_score.tails")[k - 1].alias(f"p_grade_{k}") for k in range(1, GRADES)]
    return found.select(F.col(f"_row.{key}").alias(key), F.col("_score.expected_grade").alias("expected_grade"), *tails, accepted(threshold).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that the model does not reject."""
    return scored(docs, train(docs, labels, key, text, sample), text).where(accepted(threshold)).select("_row.*")
