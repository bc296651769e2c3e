"""Operator 4: quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(theta_k - x w): one weight vector over hashed text for all grades, and thresholds in order. The
model gives the expected grade and the probability of the top grades, by which documents are selected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import packed, table, with_columns

#: Buckets of hashed byte trigrams, and bins of the share of distinct words.
BUCKETS, BINS = 2048, 16
#: Rated texts that are learnt from, at most; drawn by hash.
SAMPLE_TEXTS = 3_000
STEPS, RATE, L2 = 400, 0.05, 1e-4


def features(column: pa.Array) -> np.ndarray:
    """Per text: square roots of the shares of its hashed byte trigrams, and the bin of its share of distinct words."""
    data, offsets = tokens._bytes_of(column)
    base = int(offsets[0])
    data, offsets = data[base : int(offsets[-1])], offsets - base
    n = len(offsets) - 1
    x = np.zeros((n, BUCKETS + BINS), np.float32)
    if len(data) >= 3:
        d = data.astype(np.uint32)
        bucket = ((d[:-2] * 0x9E3779B1 ^ d[1:-1] * 0x85EBCA6B ^ d[2:] * 0xC2B2AE35) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 11)
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if b - a >= 3:
                x[i, :BUCKETS] = np.sqrt(np.bincount(bucket[a : b - 2], minlength=BUCKETS)[:BUCKETS] / (b - a - 2))
    word, starts = tokens.words(column, tokens.NOT_BLANK)
    for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        if b > a:
            x[i, BUCKETS + min(BINS - 1, int(BINS * len(np.unique(word[a:b])) / (b - a)))] = 1
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class CumulativeLink:
    grades: list[int]
    w: np.ndarray
    theta: np.ndarray  # one less than grades, increasing

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k]) for each k > 0."""
        return _sigmoid((x @ self.w)[:, None] - self.theta[None, :])

    def expected(self, tails: np.ndarray) -> np.ndarray:
        steps = np.diff(np.array(self.grades, float))
        return self.grades[0] + tails @ steps


def fit(x: np.ndarray, y: np.ndarray, grades: list[int]) -> CumulativeLink:
    """Maximum likelihood by Adam. y: places in grades. Thresholds are the first one and the logs of the steps between them, so they stay in order."""
    k = len(grades) - 1
    w = np.zeros(x.shape[1])
    share = np.array([(y > j).mean() for j in range(k)]).clip(1e-3, 1 - 1e-3)
    theta = -np.log(share / (1 - share))
    steps = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))])
    m = [np.zeros_like(w), np.zeros_like(steps)]
    v = [np.zeros_like(w), np.zeros_like(steps)]
    rows = np.arange(len(y))
    for t in range(1, STEPS + 1):
        theta = np.cumsum(np.concatenate([steps[:1], np.exp(steps[1:])]))
        tails = _sigmoid((x @ w)[:, None] - theta[None, :])
        full = np.concatenate([np.ones((len(y), 1)), tails, np.zeros((len(y), 1))], 1)
        p = np.maximum(full[rows, y] - full[rows, y + 1], 1e-9)
        slope = np.concatenate([np.zeros((len(y), 1)), tails * (1 - tails), np.zeros((len(y), 1))], 1)
        # d log p / d z of the row's own two tails
        dz = -(slope[rows, y] - slope[rows, y + 1]) / p
        d_theta = np.zeros((len(y), k + 2))
        d_theta[rows, y] += slope[rows, y] / p
        d_theta[rows, y + 1] -= slope[rows, y + 1] / p
        g_theta = d_theta[:, 1:-1].mean(0)
        g_steps = np.array([g_theta[j:].sum() * (1 if j == 0 else np.exp(steps[j])) for j in range(k)])
        for q, g, a, b in ((w, x.T @ dz / len(y) + L2 * w, m[0], v[0]), (steps, g_steps, m[1], v[1])):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            q -= RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
    return CumulativeLink(grades, w, np.cumsum(np.concatenate([steps[:1], np.exp(steps[1:])])))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for part in tokens.batches(rows, "text"):
            x = features(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("k"), part.column("grade"), pa.array([r.tobytes() for r in x], pa.binary())], ["k", "grade", "x"])


def learn(docs: DataFrame, ratings: DataFrame, texts: int = SAMPLE_TEXTS) -> CumulativeLink | None:
    """Fits grade (int) on text; docs has doc_id and text, ratings doc_id and grade. None unless there are two grades.

    Of several ratings of one doc_id the least counts; nulls don't. Ratings are drawn by hash, so that about `texts` texts are
    read, and twice as many at most; the driver gets their features.
    """
    known = ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    n = known.count()
    drawn = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < F.lit(min(1_000_000, texts * 1_000_000 // max(n, 1)))).limit(2 * texts)
    found = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select(F.xxhash64("doc_id", "text").alias("k"), "grade", "text")
    rows = sorted(found.mapInArrow(_sampled, "k long, grade int, x binary").limit(4 * texts).collect(), key=lambda r: (r["k"], r["grade"], bytes(r["x"])))
    grades = sorted({r["grade"] for r in rows})
    if len(grades) < 2:
        return None
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows])
    return fit(x, np.array([grades.index(r["grade"]) for r in rows]), grades)


def score_quality(docs: DataFrame, model: CumulativeLink | None, least: int | None = None) -> DataFrame:
    """docs' columns and expected_grade, p_tail (probability of a grade of at least `least`, by default the second grade), selected
    (p_tail >= 0.5); columns of those names are replaced.

    Null, empty and shortest texts have no features and get what the thresholds alone say. Without a model: nulls, and nothing is selected.
    """
    if model is None:
        return with_columns(docs.select(packed(docs).alias("row")), "row", expected_grade=F.lit(None).cast("double"), p_tail=F.lit(None).cast("double"), selected=F.lit(False))
    tail = next((i for i, g in enumerate(model.grades[1:]) if g >= (model.grades[1] if least is None else least)), len(model.grades) - 2)

    @F.arrow_udf("struct<expected:double,tail:double>")
    def score(text: pa.Array) -> pa.Array:
        own = pa.RecordBatch.from_arrays([text.cast(pa.string())], ["text"])
        tails = [model.tails(features(part.column("text"))) for part in tokens.batches(own, "text")]
        tails = np.concatenate(tails) if tails else np.zeros((0, len(model.theta)))
        return pa.StructArray.from_arrays([pa.array(model.expected(tails)), pa.array(tails[:, tail])], ["expected", "tail"])

    both = docs.select(packed(docs).alias("row"), score(docs["text"]).alias("s"))
    return with_columns(both, "row", expected_grade=F.col("s.expected"), p_tail=F.col("s.tail"), selected=F.col("s.tail") >= 0.5)


def grade() -> Column:
    """labels has two marks; together they grade a document 0 (poor), 1 (good but toxic) or 2 (good)."""
    return F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    model = learn(docs, table(spark, sf_dir, "labels").where(~held).select("doc_id", grade().alias("grade")))
    return score_quality(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "expected_grade", "p_tail", "selected")
