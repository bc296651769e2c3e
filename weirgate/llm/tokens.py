"""Words and n-grams of Arrow string batches as 64-bit hashes, with numpy over the batch's own bytes.

A word's hash is a polynomial of its bytes modulo 2**64 over a table of random values, in which A-Z stand as a-z.
Prefix sums give the polynomials of all words of a slice at once; a finaliser mixes the bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18  # bytes that are hashed at once
_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_TABLE[65:91] = _TABLE[97:123]
_BASE = 0x9E3779B97F4A7C15
_ONE = np.ones(1, np.uint64)
_POWERS = np.concatenate([_ONE, np.cumprod(np.full(SLICE + 8, _BASE, np.uint64))])
_INVERSE = np.concatenate([_ONE, np.cumprod(np.full(SLICE + 8, pow(_BASE, -1, 2**64), np.uint64))])
_GRAM = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)  # two families

#: Bytes of words [^\x20\x09-\x0D]+
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text in lower case
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one more for the end). A null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def _hashes(data: np.ndarray, is_word: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: polynomial, begin, end. A word ends where a break (sorted positions) begins a new text."""
    inside = np.concatenate([[False], is_word[data], [False]])
    first = inside[1:] & ~inside[:-1]
    first[breaks[breaks < len(data)]] = inside[1:-1][breaks[breaks < len(data)]]
    last = inside[:-1] & ~inside[1:]
    last[breaks] |= inside[:-1][breaks]
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    sums = np.concatenate([_ONE - _ONE, np.cumsum(_TABLE[data] * _INVERSE[: len(data)])])
    return (sums[end] - sums[begin]) * _POWERS[end], begin, end


def _slices(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first text, its last + 1, first byte, last byte + 1), of SLICE bytes at most. A longer text goes in pieces, cut between words where it can be."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        a, b = int(offsets[i]), int(offsets[j])
        while b - a > SLICE:
            gaps = np.flatnonzero(~is_word[data[a : a + SLICE]])
            cut = a + (int(gaps[-1]) + 1 if len(gaps) else SLICE)  # a word of over SLICE bytes, which words() puts together
            yield i, i + 1, a, cut
            a = cut
        yield i, j, a, b
        i = j


def words(column: pa.Array, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and where each text's words begin (one more for the end)."""
    data, offsets = _bytes_of(column)
    parts, counts = [], np.zeros(len(offsets), np.int64)
    held = None  # polynomial and length so far of a word that goes on in the next piece
    with np.errstate(over="ignore"):
        for i, j, a, b in _slices(data, offsets, is_word):
            breaks = np.unique(np.clip(offsets[i : j + 1] - a, 0, b - a))
            h, begin, end = _hashes(data[a:b], is_word, breaks)
            size = (end - begin).astype(np.uint64)
            if held is not None:  # this piece begins within that word
                h[0] += held[0] * _POWERS[size[0]]
                size[0] += held[1]
                held = None
            if b < offsets[j] and is_word[data[b]] and len(end) and end[-1] == b - a:
                held = h[-1], size[-1]
                h, begin, size = h[:-1], begin[:-1], size[:-1]
            parts.append(mix(h + size))
            text = i + np.searchsorted(offsets[i + 1 : j + 1], a + begin, "right")
            counts[1:] += np.bincount(text, minlength=len(offsets) - 1)[: len(offsets) - 1] if len(text) else 0
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.cumsum(counts)


def grams(word: np.ndarray, k: int, family: int = 0) -> np.ndarray:
    """Hash of the k words from each place on (len(word) - k + 1 of them, across texts)."""
    n = max(0, len(word) - k + 1)
    with np.errstate(over="ignore"):
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h = h * _GRAM[family] + word[j : j + n]
        return mix(h)


def text_of(starts: np.ndarray, n: int) -> np.ndarray:
    """For each of n places, the text that it lies in."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:n]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = max(0, len(x) - w + 1)
    least = x[:n].copy()
    for j in range(1, w):
        np.minimum(least, x[j : j + n], out=least)
    return least


def winnow(gram: np.ndarray, text: np.ndarray, w: int) -> np.ndarray:
    """Places whose hash is the least of some w places in a row that all belong to one text. gram and text are of one length."""
    chosen = np.zeros(len(gram), bool)
    least = sliding_min(gram, w)
    whole = text[: len(least)] == text[len(gram) - len(least) :] if len(least) else np.zeros(0, bool)
    for j in range(w):
        part = slice(j, j + len(least))
        chosen[part] |= whole & (gram[part] == least)
    return chosen


def batches(rows: pa.RecordBatch, text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about so many bytes of text, one row at least."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(rows.column(text)), 0)))
    i = 0
    while i < rows.num_rows:
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + most, "right")))
        yield rows.slice(i, j - i)
        i = j
