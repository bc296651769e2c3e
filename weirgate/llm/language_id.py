"""Operator 1: language identification by a bidirectional gated recurrent network over bytes.

Each byte is one step of both directions. A step's gate f and candidate c are (minimal gated unit, with the reset
applied after the recurrent product)

    f = sigmoid(X_f[byte] + U_f h),  c = tanh(X_c[byte] + f * (U_c h)),  h <- h + f * (c - h)

Both states at a position give the probabilities of the languages there; a text's are the mean over its positions.
Training is backpropagation through time in numpy, over windows drawn from a bounded sample of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import packed, table, with_columns

HIDDEN, WINDOW, TRAIN_WINDOW = 8, 128, 64
#: Texts that are learnt from, at most, and windows of each; drawn by hash, the same number of each language if there are enough.
SAMPLE_TEXTS, WINDOWS_OF_TEXT, LEAST_TEXTS = 4_000, 4, 20
STEPS, BATCH, RATE = 450, 160, 0.03
#: A byte that closes the gate: the state passes it unchanged. It fills the last window of a text.
PAD = 256
#: Windows that are read side by side.
LANES = 4096


def _direction(rng: np.random.Generator, hidden: int) -> dict[str, np.ndarray]:
    x = rng.normal(0, 0.1, (2 * hidden, PAD + 1)).astype(np.float32)
    x[:hidden] -= 1
    return {"x": x, "u": rng.normal(0, 0.3, (2 * hidden, hidden)).astype(np.float32)}


@dataclass
class ByteNetwork:
    langs: list[str]
    ahead: dict[str, np.ndarray]
    back: dict[str, np.ndarray]
    out: np.ndarray  # languages x (2 hidden)
    bias: np.ndarray

    @staticmethod
    def fresh(langs: list[str], hidden: int = HIDDEN, seed: int = 3) -> ByteNetwork:
        rng = np.random.Generator(np.random.PCG64(seed))
        return ByteNetwork(langs, _direction(rng, hidden), _direction(rng, hidden), rng.normal(0, 0.1, (len(langs), 2 * hidden)).astype(np.float32), np.zeros((len(langs), 1), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead["x"], self.ahead["u"], self.back["x"], self.back["u"], self.out, self.bias]


def _states(d: dict[str, np.ndarray], steps: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States after each of the steps (times x lanes), and if asked what backpropagation needs."""
    hidden = d["u"].shape[1]
    times, lanes = steps.shape
    # sigmoid(z) = (1 + tanh(z / 2)) / 2; a closed gate for PAD
    x, u = d["x"].copy(), d["u"].copy()
    x[:hidden] *= 0.5
    u[:hidden] *= 0.5
    x[:hidden, PAD] = -40
    h = np.zeros((hidden, lanes), np.float32)
    states, saved = np.empty((times, hidden, lanes), np.float32), []
    z, hu = np.empty((2 * hidden, lanes), np.float32), np.empty((2 * hidden, lanes), np.float32)
    for t in range(times):
        np.take(x, steps[t], axis=1, out=z, mode="clip")
        np.matmul(u, h, out=hu)
        f, c = z[:hidden], z[hidden:]
        f += hu[:hidden]
        np.tanh(f, out=f)
        f += 1
        f *= 0.5
        hu[hidden:] *= f
        c += hu[hidden:]
        np.tanh(c, out=c)
        if keep:
            saved.append((h.copy(), f.copy(), c.copy()))
        c -= h
        c *= f
        h += c
        states[t] = h
    return states, saved


def _gradient(d: dict[str, np.ndarray], steps: np.ndarray, saved: list, dstates: np.ndarray) -> list[np.ndarray]:
    hidden = d["u"].shape[1]
    gx, gu = np.zeros_like(d["x"]), np.zeros_like(d["u"])
    dh = np.zeros_like(dstates[0])
    for t in range(len(steps) - 1, -1, -1):
        h, f, c = saved[t]
        dh = dh + dstates[t]
        df, dc = dh * (c - h), dh * f
        dz = dc * (1 - c * c)
        hu = d["u"][hidden:] @ h
        df += dz * hu
        dhu, dfz = dz * f, df * f * (1 - f)
        both = np.concatenate([dfz, dz])
        for row, g in zip(gx, both, strict=True):
            row += np.bincount(steps[t], g, PAD + 1)
        gu[:hidden] += dfz @ h.T
        gu[hidden:] += dhu @ h.T
        dh = dh * (1 - f) + d["u"][:hidden].T @ dfz + d["u"][hidden:].T @ dhu
    gx[:, PAD] = 0
    return [gx, gu]


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=-2, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=-2, keepdims=True)
    return z


def train(windows: np.ndarray, y: np.ndarray, langs: list[str], steps: int = STEPS, seed: int = 5) -> ByteNetwork:
    """windows: n x TRAIN_WINDOW bytes (PAD after a text's end); y: places in langs. Every position learns its text's language; Adam."""
    net = ByteNetwork.fresh(langs)
    rng = np.random.Generator(np.random.PCG64(seed))
    m = [np.zeros_like(p) for p in net.parameters()]
    v = [np.zeros_like(p) for p in net.parameters()]
    for step in range(1, steps + 1):
        at = rng.integers(0, len(y), BATCH)
        x = np.ascontiguousarray(windows[at].T)
        ahead, saved_a = _states(net.ahead, x, True)
        back, saved_b = _states(net.back, x[::-1], True)
        both = np.concatenate([ahead, back[::-1]], axis=1)
        p = _softmax(net.out @ both + net.bias)
        p[:, y[at], np.arange(BATCH)] -= 1
        p *= (x != PAD)[:, None, :] / max(1, (x != PAD).sum())
        d = np.einsum("lh,tlb->thb", net.out, p)
        hidden = ahead.shape[1]
        grads = _gradient(net.ahead, x, saved_a, d[:, :hidden]) + _gradient(net.back, x[::-1], saved_b, d[::-1, hidden:])
        grads += [np.einsum("tlb,thb->lh", p, both), p.sum(axis=(0, 2))[:, None]]
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        for q, g, a, b in zip(net.parameters(), grads, m, v, strict=True):
            g = g / max(1.0, size)
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            q -= RATE * min(1, 2 - 2 * step / steps) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return net


def probabilities(net: ByteNetwork, column: pa.Array) -> np.ndarray:
    """Mean over each text's positions of the languages' probabilities there (texts x languages; 0 for an empty text).

    A text is read whole, in windows of WINDOW bytes that start from fresh states.
    """
    data, offsets = tokens._bytes_of(column)
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), counts)
    begin = offsets[:-1][text] + WINDOW * (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts))
    end = offsets[1:][text]
    total = np.zeros((len(sizes), len(net.langs)))
    for i in range(0, len(text), LANES):
        own = slice(i, i + LANES)
        at = begin[own][None, :] + np.arange(WINDOW)[:, None]
        inside = at < end[own][None, :]
        steps = np.where(inside, data[np.minimum(at, len(data) - 1)], PAD).astype(np.int64)
        ahead, _ = _states(net.ahead, steps, False)
        back, _ = _states(net.back, steps[::-1], False)
        hidden = ahead.shape[1]
        pooled = np.zeros((len(net.langs), steps.shape[1]), np.float32)
        for t in range(WINDOW):
            z = net.out[:, :hidden] @ ahead[t]
            z += net.out[:, hidden:] @ back[WINDOW - 1 - t]
            z += net.bias
            np.clip(z, -30, 30, out=z)
            np.exp(z, out=z)
            z *= inside[t] / z.sum(axis=0)
            pooled += z
        for k in range(len(net.langs)):
            total[:, k] += np.bincount(text[own], pooled[k], len(sizes))
    return total / np.maximum(sizes, 1)[:, None]


def _drawn_windows(batches: Iterator[pa.RecordBatch], width: int, windows: int) -> Iterator[pa.RecordBatch]:
    """lang, k, nth (number), bytes of some windows of each text, at places that the text's own hash picks."""
    for rows in batches:
        for part in tokens.batches(rows, "text"):
            data, offsets = tokens._bytes_of(part.column("text"))
            at, nth, cut = [], [], []
            for i, k in enumerate(part.column("k").to_pylist()):
                whole = data[offsets[i] : offsets[i + 1]]
                rng = np.random.Generator(np.random.PCG64(k & (2**63 - 1)))
                for n, begin in enumerate(rng.integers(0, max(1, len(whole) - width + 1), windows if len(whole) else 0)):
                    at.append(i)
                    nth.append(n)
                    cut.append(whole[begin : begin + width].tobytes())
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("lang").take(at), part.column("k").take(at), pa.array(nth, pa.int32()), pa.array(cut, pa.binary())], ["lang", "k", "nth", "bytes"])


def learn(docs: DataFrame, texts: int = SAMPLE_TEXTS) -> ByteNetwork | None:
    """Fits the network on docs (text, lang), null and empty ones left out; None if that leaves nothing.

    Of each language about texts / (number of languages) different texts are drawn by hash, LEAST_TEXTS at least, or all if there are no more,
    and WINDOWS_OF_TEXT windows of TRAIN_WINDOW bytes of each: that, and a count per language, is all that the driver gets.
    Copies of a text count as one, however many there are.
    """
    known = docs.where("lang IS NOT NULL AND text <> ''").select("text", "lang", F.xxhash64(F.lit("sample"), "text").alias("k"))
    different = known.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("k").alias("n"))
    counts = {r["lang"]: r["n"] for r in different.orderBy(F.desc("rows"), "lang").limit(texts).collect()}
    if not counts:
        return None
    each = max(LEAST_TEXTS, texts // len(counts))
    rates = docs.sparkSession.createDataFrame([(k, min(1_000_000, 6 * each * 1_000_000 // (5 * n) + 1)) for k, n in counts.items()], "lang string, rate long")
    drawn = known.join(F.broadcast(rates), "lang").where(F.pmod("k", F.lit(1_000_000)) < F.col("rate")).select("text", "lang", "k")
    # a text's windows follow from it, so those of its copies fall together; a short one has the same window several times, with as many numbers
    found = drawn.mapInArrow(lambda b: _drawn_windows(b, TRAIN_WINDOW, WINDOWS_OF_TEXT), "lang string, k long, nth int, bytes binary").distinct()
    rows = sorted(found.limit(4 * WINDOWS_OF_TEXT * each * len(counts)).collect())  # about 1.2 * each texts a language
    if not rows:
        return None
    windows = np.full((len(rows), TRAIN_WINDOW), PAD, np.int64)
    for x, r in zip(windows, rows, strict=True):
        x[: len(r["bytes"])] = np.frombuffer(r["bytes"], np.uint8)
    langs = sorted({r["lang"] for r in rows})
    # each language weighs the same: its windows are repeated until all have as many
    y = np.array([langs.index(r["lang"]) for r in rows])
    most = np.bincount(y).max()
    at = np.concatenate([np.resize(np.flatnonzero(y == k), most) for k in range(len(langs))])
    return train(windows[at], y[at], langs)


def identify(docs: DataFrame, net: ByteNetwork | None) -> DataFrame:
    """docs' columns and lang_pred, score (mean probability of lang_pred over the text's bytes); columns of those names are replaced.

    Null texts, and texts without a letter, get `und` and 0.0, and so do all if there is no network.
    """
    letters = F.coalesce(docs["text"].rlike(r"\p{L}"), F.lit(False)) if net else F.lit(False)

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(text: pa.Array) -> pa.Array:
        own = pa.RecordBatch.from_arrays([text.cast(pa.string())], ["text"])
        p = [probabilities(net, part.column("text")) for part in tokens.batches(own, "text")]
        p = np.concatenate(p) if p else np.zeros((0, len(net.langs)))
        best = p.argmax(axis=1)
        return pa.StructArray.from_arrays([pa.array(net.langs).take(pa.array(best)), pa.array(np.minimum(1.0, p[np.arange(len(p)), best]))], ["lang", "score"])

    found = predict(docs["text"]) if net else F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    both = docs.select(packed(docs).alias("row"), letters.alias("letters"), found.alias("found"))
    return with_columns(
        both,
        "row",
        lang_pred=F.when(F.col("letters"), F.col("found.lang")).otherwise("und"),
        score=F.when(F.col("letters"), F.col("found.score")).otherwise(0.0),
    )


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    net = learn(docs.where(~held))
    return identify(docs.select("doc_id", "text"), net).select("doc_id", held.alias("held_out"), "lang_pred", "score")
