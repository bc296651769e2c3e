"""Operator 10: toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum of w_i + sum over pairs of <v_i, v_j>) over the distinct terms i, j of a text. The pairs
let two terms mean together what neither means alone. Terms are words, hashed to buckets.
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

BUCKET_BITS, FACTORS = 20, 4
#: Labelled rows that are learnt from, at most. The sample is drawn by hash from all that may be learnt from.
SAMPLE_ROWS = 12_000
#: Terms kept: in so many sampled texts, and so many deviations off the share of label 1.
MIN_TEXTS, MIN_DEVIATIONS = 4, 5.0
#: Terms that say nothing alone: of all terms of so many texts, all pairs are counted. Both terms of a pair in so many texts are kept if its share of
#: label 1 is so unlikely under what the two add up to that among all those pairs one like it would come by chance once in exp(PAIR_MARGIN).
MIN_PAIR_TEXTS, PAIR_MARGIN = 8, 7.0
#: Cells of the table of terms by terms that a task counts, and pairs that it adds, at once.
BLOCK_CELLS, BLOCK_PAIRS = 2_000_000, 1_000_000
EPOCHS, RATE, L1, L2 = 300, 0.2, 2e-4, 1e-3


def terms(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the distinct buckets of each text, sorted; of the wanted buckets (sorted) only, as their places, if given."""
    word, starts = tokens.words(column, tokens.ALNUM)
    bucket = (word >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    text = tokens.text_of(starts, len(word))
    if wanted is not None:
        place = np.searchsorted(wanted, bucket)
        known = np.zeros(len(bucket), bool) if not len(wanted) else wanted[place % len(wanted)] == bucket
        text, bucket = text[known], place[known]
    both = np.unique((text << BUCKET_BITS) | bucket)
    return both >> BUCKET_BITS, both & ((1 << BUCKET_BITS) - 1)


@dataclass
class FactorizationMachine:
    buckets: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, text: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Of n texts; (text, term) are the places of their distinct terms in buckets."""
        z = self.bias + np.bincount(text, self.w[term], n)
        for f in self.v.T:
            z += 0.5 * (np.bincount(text, f[term], n) ** 2 - np.bincount(text, f[term] ** 2, n))
        return z

    def scores(self, column: pa.Array) -> np.ndarray:
        text, term = terms(column, self.buckets)
        return _sigmoid(self.logits(text, term, len(column)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _deviations(n: np.ndarray, ones: np.ndarray, p: np.ndarray | float) -> np.ndarray:
    return np.abs(ones - n * p) / np.sqrt(np.maximum(n, 1) * p * (1 - p))


def chosen_terms(text: np.ndarray, bucket: np.ndarray, y: np.ndarray, spark: SparkSession | None = None) -> np.ndarray:
    """Buckets whose share of label 1 is far off the mean, and those of pairs whose share is far off what their two shares add up to.

    Pairs are counted block by block of the table of terms by terms, by Spark's tasks if there is a session.
    """
    known, at = np.unique(bucket, return_inverse=True)
    n = np.bincount(at, minlength=len(known))
    ones = np.bincount(at, y[text], len(known))
    p = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    alone = np.flatnonzero((n >= MIN_TEXTS) & (_deviations(n, ones, p) >= MIN_DEVIATIONS))
    asked = np.union1d(alone, np.flatnonzero(n >= MIN_PAIR_TEXTS))
    place = np.full(len(known), -1)
    place[asked] = np.arange(len(asked))
    term = place[at]
    held = np.flatnonzero(term >= 0)
    order = held[np.lexsort((term[held], text[held]))]
    sample = text[order].astype(np.int32), term[order].astype(np.int32), y, ones[asked] / np.maximum(n[asked], 1), p
    step = max(1, BLOCK_CELLS // max(1, len(asked)))
    blocks = [(a, min(a + step, len(asked))) for a in range(0, len(asked), step)]
    if spark is None or len(blocks) < 2:
        found = [_telling(sample, *x) for x in blocks]
    else:
        shared = spark.sparkContext.broadcast(sample)  # the sampled rows' terms
        each = spark.createDataFrame(blocks, "a int, b int").repartition(min(len(blocks), 64))
        found = [np.asarray(each.mapInArrow(lambda x: _telling_blocks(x, shared.value), "term int").distinct().toArrow()["term"])]
        shared.unpersist()
    return np.sort(known[np.union1d(alone, asked[np.unique(np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64))])])


def _telling(sample: tuple, a: int, b: int) -> np.ndarray:
    """Terms that a pair of one of the terms from a up to b, and of one behind it, needs. The sample is sorted by text and term."""
    text, term, y, share, p = sample
    size = len(share)
    ends = np.searchsorted(text, np.arange(len(y)), "right")
    at = np.flatnonzero((term >= a) & (term < b))
    behind = ends[text[at]] - at - 1  # terms of the same text
    both, toxic = (np.zeros((b - a) * size, np.int32) for _ in range(2))
    sums = np.cumsum(behind)
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(sums, (sums[i - 1] if i else 0) + BLOCK_PAIRS, "right")))
        n = behind[i:j]
        first = np.repeat(at[i:j], n)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        cell = (term[first].astype(np.int64) - a) * size + term[second]
        both += np.bincount(cell, minlength=len(both)).astype(np.int32)
        toxic += np.bincount(cell[y[text[first]] > 0], minlength=len(both)).astype(np.int32)
        i = j
    cell = np.flatnonzero(both >= MIN_PAIR_TEXTS)
    i, j = a + cell // size, cell % size
    m = both[cell].astype(float)
    k = np.clip(toxic[cell] / m, 1e-9, 1 - 1e-9)
    q = np.clip(share[i] + share[j] - p, 0.01, 0.99)
    unlikely = m * (k * np.log(k / q) + (1 - k) * np.log((1 - k) / (1 - q)))  # of a share so far off or farther, at least
    far = unlikely >= np.log(max(1, size * (size - 1) // 2)) + PAIR_MARGIN
    return np.union1d(i[far], j[far])


def _telling_blocks(batches: Iterator[pa.RecordBatch], sample: tuple) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for a, b in zip(rows.column("a").to_pylist(), rows.column("b").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(_telling(sample, a, b).astype(np.int32))], ["term"])


def fit(text: np.ndarray, bucket: np.ndarray, y: np.ndarray, seed: int = 7, spark: SparkSession | None = None) -> FactorizationMachine:
    """Logistic loss by AdaGrad over the whole sample; weights are drawn to 0 by L1, factors by L2. Without both labels, only a bias."""
    buckets = chosen_terms(text, bucket, y, spark)
    rng = np.random.Generator(np.random.PCG64(seed))
    share = (y.sum() + 0.5) / (len(y) + 1)
    m = FactorizationMachine(buckets, float(np.log(share / (1 - share))), np.zeros(len(buckets)), rng.normal(0, 0.05, (len(buckets), FACTORS)))
    if not len(buckets):
        return m
    place = np.searchsorted(buckets, bucket) % len(buckets)
    known = buckets[place] == bucket
    text, term, n = text[known], place[known], len(y)
    gw, gv, gb = np.full_like(m.w, 1e-8), np.full_like(m.v, 1e-8), 1e-8
    for _ in range(EPOCHS):
        e = (_sigmoid(m.logits(text, term, n)) - y) / n
        g = np.bincount(term, e[text], len(buckets))
        sums = np.stack([np.bincount(text, f[term], n) for f in m.v.T], 1)
        d = np.stack([np.bincount(term, e[text] * (sums[text, f] - m.v[term, f]), len(buckets)) for f in range(FACTORS)], 1) + L2 * m.v / len(buckets)
        gb += e.sum() ** 2
        m.bias -= RATE * e.sum() / np.sqrt(gb)
        gw += g**2
        step = RATE / np.sqrt(gw)
        m.w -= step * g
        m.w = np.sign(m.w) * np.maximum(0, np.abs(m.w) - step * L1 / 10)
        gv += d**2
        m.v -= RATE / np.sqrt(gv) * d
    return m


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """Fits label (0, or else 1) on the text of docs (doc_id, text); labels has doc_id and label.

    Where one doc_id has several labels, the greatest counts; null labels and ids don't. Labels are drawn first, by
    hash, so that `rows` is about what is read further. Statistics of the terms are made by Spark, and pairs of
    terms are counted by its tasks; the driver gets the terms of several sampled texts, and which of the texts have them.
    """
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("label") != 0).cast("int")).alias("y"))
    n = known.count()
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < F.lit(min(1_000_000, rows * 1_000_000 // max(n, 1)))
    drawn = known.where(drawn).limit(2 * rows)  # the draw has `rows` rows, give or take a few hundred
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    sampled = texts.select(F.xxhash64("doc_id", "text").alias("k"), "y", "text").mapInArrow(_sampled_terms, "k long, y int, bucket int").persist()
    try:
        total = sampled.where("bucket IS NULL").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).first()
        if not total["n"]:
            return FactorizationMachine(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, FACTORS)))
        p = min(max(total["ones"] / total["n"], 1e-6), 1 - 1e-6)
        by = sampled.where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).where(F.col("n") >= MIN_TEXTS)
        off = F.abs(F.col("ones") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
        wanted = by.where((off >= MIN_DEVIATIONS) | (F.col("n") >= MIN_PAIR_TEXTS)).select("bucket")  # 2**BUCKET_BITS rows at most
        rows_of = sampled.where("bucket IS NULL").select("k", "y").toArrow()
        seen = sampled.join(F.broadcast(wanted), "bucket").select("k", "bucket").toArrow()
    finally:
        sampled.unpersist()
    keys, y = np.asarray(rows_of["k"]), np.asarray(rows_of["y"])
    order = np.lexsort((y, keys))
    known, first = np.unique(keys[order], return_index=True)  # a row may stand twice in the table
    both = np.unique(np.stack([np.searchsorted(known, np.asarray(seen["k"])), np.asarray(seen["bucket"])], 1).astype(np.int64).reshape(-1, 2), axis=0)
    return fit(both[:, 0], both[:, 1], y[order][first].astype(float), spark=docs.sparkSession)


def _sampled_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k, y, bucket: a row for each distinct term of a text, and one without bucket for the text itself."""
    for rows in batches:
        for part in tokens.batches(rows, "text"):
            text, bucket = terms(part.column("text"))
            own = np.arange(part.num_rows)
            at = pa.array(np.concatenate([own, text]))
            buckets = pa.concat_arrays([pa.nulls(part.num_rows, pa.int32()), pa.array(bucket.astype(np.int32))])
            yield pa.RecordBatch.from_arrays([part.column("k").take(at), part.column("y").take(at), buckets], ["k", "y", "bucket"])


def score_toxicity(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """docs' columns and score (0 to 1); a column of that name is replaced. Null, empty and wordless texts get the share of label 1, about."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        own = pa.RecordBatch.from_arrays([text.cast(pa.string()) if text.type == pa.null() else text], ["text"])
        scores = [model.scores(part.column("text")) for part in tokens.batches(own, "text")]
        return pa.array(np.concatenate(scores) if scores else np.zeros(0))

    return with_columns(docs.select(packed(docs).alias("row"), score(docs["text"]).alias("score")), "row", score=F.col("score"))


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def learn_from_tables(spark: SparkSession, docs: DataFrame, sf_dir: str) -> FactorizationMachine:
    """From labels.toxic of documents whose crc32(doc_id) mod 5 is not 0."""
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    return learn(docs, labels)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_toxicity(docs.select("doc_id", "text"), learn_from_tables(spark, docs, sf_dir))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
