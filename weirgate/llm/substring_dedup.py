"""Operator 3: fuzzy repeated passages by collinear chaining.

Seeds are k-word grams that winnowing keeps. Seeds that several documents share are matched with the first document that has
them, and where those matches leave less than a passage also with the previous one. Spans of seeds whose first documents differ
are matched as wholes, so that a passage that is made of other documents' stretches finds the document that has it whole.
Runs of matches on one diagonal make segments; per pair of documents, segments in the order of both texts are chained with gap
costs, by a Fenwick tree of prefix maxima. The words between and around a chain's segments are aligned, which decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, tokens
from .common import Scratch, small, table
from .runs import shared_rows

SEED_WORDS, SEED_WINDOW = 4, 4
#: Words that a passage must have in common, and the share of its aligned words.
MIN_WORDS, MIN_IDENTITY = 40, 0.7
#: Cost of each word between two segments, on either side.
GAP_COST = 0.1
#: What a chain must be worth to be aligned: two seeds that don't overlap.
LEAST_WORTH = 2 * SEED_WORDS
#: Words that a span of seeds covers at least.
SPANS = (16, 40)
#: Words beyond the ends of a chain that alignment looks at.
MARGIN = 40
#: Chains of a text that are cut out at once.
CHAINS = 1_000
#: Seeds that are found in over so many documents, which one block could not well hold, are dealt to SALTS groups; the most frequent HOT_SEEDS are told apart.
HOT_DOCS, HOT_SEEDS, SALTS = 50_000, 200_000, 32


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces with the hash, text and place of each seed."""
    for rows in batches:
        for part in tokens.batches(rows, "t"):
            word, starts = tokens.words(part.column("t"), tokens.ALNUM)
            text = tokens.text_of(starts, len(word))
            gram = tokens.grams(word, SEED_WORDS)
            own = text[: len(gram)].copy()
            across = np.flatnonzero(own != text[len(text) - len(gram) :])
            own[across] = -1 - across
            # a text of fewer grams than a window keeps them all
            few = np.diff(starts)[text[: len(gram)]] < SEED_WORDS + SEED_WINDOW - 1
            at = np.flatnonzero(tokens.winnow(gram, own, SEED_WINDOW) | (few & (own >= 0)))
            yield part, gram[at], text[at], at - starts[text[at]]


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds that several texts of a piece have, with their number, and the number of all seeds (s: null)."""
    for _, seed, text, _ in _seeds(batches):
        order = np.lexsort((text, seed))
        seed, text = seed[order], text[order]
        new = np.concatenate([[True], (seed[1:] != seed[:-1]) | (text[1:] != text[:-1])]) if len(seed) else np.zeros(0, bool)
        found, times = np.unique(seed[new], return_counts=True)
        found, times = found[times > 1].view(np.int64), times[times > 1]
        yield pa.RecordBatch.from_pydict({"s": pa.array([None, *found.tolist()], pa.int64()), "n": pa.array([len(seed), *times.tolist()], pa.int64())})


def _placed(batches: Iterator[pa.RecordBatch], hot: np.ndarray, count: int) -> Iterator[pa.RecordBatch]:
    """The seeds with their texts and places, in blocks; hot seeds in a block of each salt."""

    def parts():
        for part, seed, text, pos in _seeds(batches):
            ids = np.asarray(part.column("id"))[text]
            is_hot = hot[np.searchsorted(hot, seed) % len(hot)] == seed if len(hot) else np.zeros(len(seed), bool)
            yield seed, ids, pos, np.where(is_hot, 1 + (tokens.mix(ids.view(np.uint64)) % np.uint64(SALTS)).astype(np.int64), 0)

    return blocks.packed(parts(), count)


def _met(block: pa.Table, count: int) -> pa.Table:
    """Of a block's seeds that several documents have (or, of hot seeds, may have in other salts' blocks): each occurrence with the
    first of the seed, and the last before it in another document (or itself)."""
    salt = block.column("block")[0].as_py() // count
    seed, ids, pos = blocks.unpacked(block)
    begins, sizes = blocks.runs(seed)
    first = np.repeat(begins, sizes)
    own = np.arange(len(seed))
    lies = np.maximum.accumulate(np.where(np.concatenate([[True], (seed[1:] != seed[:-1]) | (ids[1:] != ids[:-1])]), own, 0))  # first occurrence in the document
    prev = np.where(lies > first, lies - 1, own)
    keep = np.flatnonzero(np.repeat((ids[begins] != ids[begins + sizes - 1]) | (salt > 0), sizes))
    at = {"": own[keep], "first_": first[keep], "prev_": prev[keep]}
    found = {"s": seed[keep].view(np.int64), "salt": np.full(len(keep), salt, np.int32)}
    return pa.table(found | {f"{p}id": ids[i] for p, i in at.items()} | {f"{p}pos": pos[i].astype(np.int32) for p, i in at.items()})


def _spans(seed: np.ndarray, salt: np.ndarray, ids: np.ndarray, pos: np.ndarray, joined: np.ndarray, same: np.ndarray, words: int) -> dict[str, np.ndarray]:
    """The spans of touching seeds of so many words whose seeds aren't all matched on one diagonal of one first document, or some of them
    are hot. joined, same: whether a seed touches the one before, and goes on its diagonal. Equal spans have equal words."""
    run = np.cumsum(~joined)
    # the first seed that ends so many words on; runs are told apart by steps of more words than any has
    step = int(pos.max()) + words + SEED_WORDS + 1
    to = np.searchsorted(run * step + pos, run * step + pos + words - SEED_WORDS)
    begin = np.flatnonzero((to < len(pos)) & (run[np.minimum(to, len(pos) - 1)] == run))
    to = to[begin]
    turns, hots = np.cumsum(~same), np.concatenate([[0], np.cumsum(salt > 0)])
    is_hot = hots[to + 1] > hots[begin]
    pick = is_hot | (turns[to] > turns[begin])
    begin, to, is_hot = begin[pick], to[pick], is_hot[pick]
    with np.errstate(over="ignore"):
        h = np.full(len(begin), words, np.uint64)
        for j in range(int((to - begin).max()) + 1 if len(begin) else 0):
            at = np.minimum(begin + j, to)
            more = tokens.mix(h + seed[at] + (pos[at] - pos[begin]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            h = np.where(begin + j <= to, more, h)
        dealt = 1 + (tokens.mix(ids[begin].view(np.uint64)) % np.uint64(SALTS)).astype(np.int64)
    return {"kind": np.full(len(begin), 1), "s": h.view(np.int64), "salt": np.where(is_hot, dealt, 0), "id": ids[begin], "pos": pos[begin], "n": pos[to] + SEED_WORDS - pos[begin], "other": ids[begin], "other_pos": pos[begin]}


def _matched(ids: np.ndarray, pos: np.ndarray, other: np.ndarray, other_pos: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Runs of touching seeds (sorted by id, pos) that go on one diagonal of one other document, each as one match; and each seed's run's words."""
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (np.diff(pos) > SEED_WORDS) | (other[1:] != other[:-1]) | (np.diff(other_pos) != np.diff(pos))])
    begin = np.flatnonzero(new)
    n = pos[np.concatenate([begin[1:], [len(pos)]]) - 1] + SEED_WORDS - pos[begin]
    none = np.zeros(len(begin), np.int64)
    return {"kind": none, "s": none, "salt": none, "id": ids[begin], "pos": pos[begin], "n": n, "other": other[begin], "other_pos": other_pos[begin]}, n[np.cumsum(new) - 1]


STRETCH = "kind int, s long, salt int, id long, pos int, n int, other long, other_pos int"


def _stretches(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (id, pos), documents whole: matches (kind 0), spans (kind 1), and the firsts of hot seeds' salt groups (kind 2)."""
    names = ["s", "salt", "id", "pos", "first_id", "first_pos", "prev_id", "prev_pos"]

    def found(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        new = np.concatenate([[True], (np.diff(x["id"]) != 0) | (np.diff(x["pos"]) != 0)])  # a row may stand twice in the table
        s, salt, ids, pos, first, first_pos, prev, prev_pos = (x[c][new] for c in names)
        joined = np.concatenate([[False], (ids[1:] == ids[:-1]) & (np.diff(pos) <= SEED_WORDS)])
        same = joined & np.concatenate([[False], (first[1:] == first[:-1]) & (np.diff(first_pos) == np.diff(pos))])
        firsts, words = _matched(ids, pos, first, first_pos)
        short = (prev != first) & (words < min_words)
        parts = [firsts]
        if short.any():
            parts.append(_matched(ids[short], pos[short], prev[short], prev_pos[short])[0])
        parts = [{c: v[p["id"] != p["other"]] for c, v in p.items()} for p in parts]
        parts += [_spans(s.view(np.uint64), salt, ids, pos, joined, same, n) for n in SPANS]
        at = np.flatnonzero((salt > 0) & (ids == first) & (pos == first_pos))
        parts.append({"kind": np.full(len(at), 2), "s": s[at], "salt": salt[at], "id": ids[at], "pos": pos[at], "n": np.full(len(at), SEED_WORDS), "other": ids[at], "other_pos": pos[at]})
        kinds = {"s": pa.int64(), "id": pa.int64(), "other": pa.int64()}
        yield pa.RecordBatch.from_pydict({c: pa.array(np.concatenate([p[c] for p in parts]), kinds.get(c, pa.int32())) for c in parts[0]})

    held: list[dict[str, np.ndarray]] = []  # rows of the last document so far
    for rows in batches:
        if not rows.num_rows:
            continue
        x = {c: np.asarray(rows.column(c)).astype(np.int64) for c in names}
        cut = int(np.searchsorted(x["id"], x["id"][-1]))
        if cut or (held and held[-1]["id"][-1] != x["id"][0]):
            held.append({c: v[:cut] for c, v in x.items()})
            yield from found({c: np.concatenate([h[c] for h in held]) for c in names})
            held = []
        held.append({c: v[cut:] for c, v in x.items()})
    if held:
        yield from found({c: np.concatenate([h[c] for h in held]) for c in names})


def segments(pos: np.ndarray, other: np.ndarray, words: np.ndarray | int = 8) -> np.ndarray:
    """Rows (start, end, other start, other end), ends excluded, of runs of matches (of so many words) on one diagonal that touch or overlap."""
    order = np.lexsort((pos, other - pos))
    end = (pos + words)[order]
    pos, diagonal = pos[order], (other - pos)[order]
    # ends so far, within the diagonal: diagonals are told apart by steps of more than any end
    nth = np.cumsum(np.concatenate([[0], np.diff(diagonal) != 0]))
    step = int(end.max()) + 1
    far = np.maximum.accumulate(nth * step + end) - nth * step
    new = np.concatenate([[True], (np.diff(nth) != 0) | (pos[1:] > far[:-1])])
    begin = np.flatnonzero(new)
    start, end = pos[begin], far[np.concatenate([begin[1:], [len(pos)]]) - 1]
    return np.stack([start, end, start + diagonal[begin], end + diagonal[begin]], 1)


def chains(segs: np.ndarray, least: float) -> list[np.ndarray]:
    """Chains of segments that follow each other in both texts, best first, until the best is worth less than least.

    A chain is worth the words of its segments less GAP_COST for each word between them on either side. That cost is a sum
    of the two ends' parts, so the best chain before a segment is a prefix maximum over the other text's places.
    """
    found: list[np.ndarray] = []
    left = segs[np.lexsort((segs[:, 2], segs[:, 0]))]
    while len(left):
        n = len(left)
        ranks = np.unique(left[:, 3])
        m = len(ranks)
        tree, of = [-math.inf] * (m + 1), [-1] * (m + 1)  # the best of each range of places, and whose it is
        worth, before = [0.0] * n, [-1] * n
        by_end = np.argsort(left[:, 1], kind="stable").tolist()
        where_end = (np.searchsorted(ranks, left[:, 3]) + 1).tolist()
        where_start = np.searchsorted(ranks, left[:, 2], "right").tolist()
        rows, inserted = left.tolist(), 0
        for i, (start, end, other, _) in enumerate(rows):
            while inserted < n and rows[by_end[inserted]][1] <= start:
                j = by_end[inserted]
                entry, k = worth[j] + GAP_COST * (rows[j][1] + rows[j][3]), where_end[j]
                while k <= m:
                    if tree[k] < entry:
                        tree[k], of[k] = entry, j
                    k += k & -k
                inserted += 1
            best, last, k = -math.inf, -1, where_start[i]
            while k:
                if tree[k] > best:
                    best, last = tree[k], of[k]
                k &= k - 1
            gain = best - GAP_COST * (start + other)
            worth[i], before[i] = (end - start + gain, last) if gain > 0 else (float(end - start), -1)
        i = int(np.argmax(worth))
        if worth[i] < least:
            break
        chain = []
        while i >= 0:
            chain.append(i)
            i = before[i]
        found.append(left[chain[::-1]])
        inside = (left[:, 0] < found[-1][-1, 1]) & (left[:, 1] > found[-1][0, 0])  # what else that part of the text matches
        left = left[~inside]
    return found


def _chained(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        pick, nths, found = [], [], []
        flat = rows.column("matches").flatten()
        ends = np.asarray(rows.column("matches").offsets)
        ends = ends - ends[0]
        pos, other, n = (np.asarray(flat.field(c)).astype(np.int64) for c in ("pos", "other_pos", "n"))
        size = np.diff(ends)
        worth = np.add.reduceat(n, ends[:-1]) if len(n) else n
        # of two matches that don't follow each other closely, none makes a chain of more than its own words
        at = ends[:-1][size == 2]
        gap = sum(np.maximum(0, np.abs(x[at + 1] - x[at]) - np.where(x[at + 1] > x[at], n[at], n[at + 1])) for x in (pos, other))
        worth = worth.astype(float)
        worth[size == 2] = np.maximum(worth[size == 2] - GAP_COST * gap, np.maximum(n[at], n[at + 1]))
        for i in np.flatnonzero(worth >= least).tolist():
            a, b = ends[i], ends[i + 1]
            one = [np.array([[pos[a], pos[a] + n[a], other[a], other[a] + n[a]]])]
            for nth, chain in enumerate(one if size[i] == 1 else chains(segments(pos[a:b], other[a:b], n[a:b]), least)):
                pick.append(i)
                nths.append(nth)
                found.append(chain.ravel())
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        segs = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([rows.column(c).take(pa.array(pick, pa.int64())) for c in ("id", "other")] + [pa.array(nths, pa.int32()), segs], ["id", "other", "nth", "segs"])


def _within(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places begin, begin + 1 .. of each stretch of so many."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _cut(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
    """The words of one side of each of a text's chains, MARGIN words around it; first: 0 or 2, that side's place in segs."""
    for rows in batches:
        for part in tokens.batches(rows, "t"):
            word, starts = tokens.words(part.column("t"), tokens.ALNUM)
            of = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(part.column("chains").offsets)))
            flat = part.column("chains").flatten()
            segs = flat.field("segs")
            ends, values = np.asarray(segs.offsets), np.asarray(segs.values)
            a = np.maximum(0, values[ends[:-1] + first] - MARGIN).astype(np.int64)
            b = np.minimum(np.diff(starts)[of], values[ends[1:] - 3 + first] + MARGIN).astype(np.int64)
            size = np.maximum(0, b - a)
            words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(word[_within(starts[of] + a, size)].view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(of)), flat.field("partner"), flat.field("nth"), segs, pa.array(a.astype(np.int32)), words], ["id", "partner", "nth", "segs", "begin", "words"])


def _common(x: list[int], y: list[int]) -> Iterator[tuple[int, int]]:
    """For the first 1, 2 .. words of x: a number whose bit j is 0 where the longest common subsequence with y grows by y's word j,
    and how many such bits there are. Whole rows of the table are one integer, so that a row takes a few operations."""
    places: dict[int, int] = {}
    for j, w in enumerate(y):
        places[w] = places.get(w, 0) | 1 << j
    full = row = (1 << len(y)) - 1
    n = 0
    for w in x:
        at = places.get(w, 0)
        if at:
            take = row & at
            row = ((row + take) | (row - take)) & full
            n = len(y) - row.bit_count()
        yield row, n


def common_words(x: list[int], y: list[int]) -> int:
    """Length of the longest common subsequence."""
    n = 0
    for _, n in _common(x, y):  # noqa: B007
        pass
    return n


def _extension(x: list[int], y: list[int]) -> tuple[int, int, int]:
    """How far both begin alike: the words of either, and in common, where those in common exceed half of the longer by most."""
    best, found, before = 0.0, (0, 0, 0), -1
    for i, (row, n) in enumerate(_common(x, y), 1):
        if n - 0.5 * max(i, n) > best and row != before:
            before, places = row, ~row & ((1 << len(y)) - 1)
            for common in range(1, n + 1):  # the last place of the row that has so many words in common is that of a bit
                j = (places & -places).bit_length()
                places &= places - 1
                score = common - 0.5 * max(j, i)
                if score > best:
                    best, found = score, (i, j, common)
    return found


def _passages(start: np.ndarray, end: np.ndarray, words: np.ndarray, min_words: int, min_identity: float) -> Iterator[tuple[int, int]]:
    """Stretches (first, last) of a chain's pieces with at least min_words words in common and min_identity of the longer side: the one
    with most words first, then those before and after it. start, end: of both sides, a row a piece; words: sums, of the words in common
    before each piece and up to its end."""
    todo = [(0, len(start) - 1)]
    while todo:
        a, b = todo.pop()
        best, most = None, min_words - 1
        for i in range(a, b + 1):
            if words[b, 1] - words[i, 0] <= most:
                break
            common = words[i : b + 1, 1] - words[i, 0]
            ok = np.flatnonzero((common > most) & (common >= min_identity * (end[i : b + 1] - start[i]).max(1)))
            if len(ok):
                best, most = (i, i + int(ok[-1])), int(common[ok[-1]])
        if best:
            yield best
            todo += [(a, best[0] - 1), (best[1] + 1, b)]


def _aligned(batches: Iterator[pa.RecordBatch], min_words: int, min_identity: float) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        found = []
        lists = {c: (np.asarray(rows.column(c).offsets), np.asarray(rows.column(c).values)) for c in ("words", "other_words", "segs")}
        plain = {c: np.asarray(rows.column(c)).tolist() for c in ("id", "other", "begin", "other_begin")}
        for i in range(rows.num_rows):
            x, y, segs = (values[ends[i] : ends[i + 1]] for ends, values in lists.values())
            x, y = x.tolist(), y.tolist()
            known = set(y)
            if len(y) < min_words or sum(w in known for w in x) < min_words:  # so many words in common at most
                continue
            r = {c: v[i] for c, v in plain.items()}
            segs = segs.astype(np.int64).reshape(-1, 4) - [r["begin"], r["begin"], r["other_begin"], r["other_begin"]]
            left, other_left, more = _extension(x[: segs[0, 0]][::-1], y[: segs[0, 2]][::-1])
            right, other_right, rest = _extension(x[segs[-1, 1] :], y[segs[-1, 3] :])
            if min(segs[-1, 1] - segs[0, 0], segs[-1, 3] - segs[0, 2]) + more + rest < min_words:
                continue
            own = segs[:, 1] - segs[:, 0]
            own[0] += more
            own[-1] += rest
            gaps = [common_words(x[a:b], y[c:d]) for (_, a, _, c), (b, _, d, _) in zip(segs[:-1], segs[1:], strict=True)]
            up_to = np.cumsum(own) + np.concatenate([[0], np.cumsum(np.array(gaps, np.int64))])
            start, end = segs[:, [0, 2]].copy(), segs[:, [1, 3]].copy()
            start[0] -= [left, other_left]
            end[-1] += [right, other_right]
            for k, j in _passages(start, end, np.stack([up_to - own, up_to], 1), min_words, min_identity):
                matched = int(up_to[j] - up_to[k] + own[k])
                identity = matched / (end[j] - start[k]).max()
                found.append({"doc_id": r["id"], "other_id": r["other"], "start": int(start[k, 0]) + r["begin"], "end": int(end[j, 0]) + r["begin"], "other_start": int(start[k, 1]) + r["other_begin"], "other_end": int(end[j, 1]) + r["other_begin"], "matched": matched, "identity": float(identity)})
        yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("doc_id", pa.int64()), ("other_id", pa.int64()), *[(c, pa.int32()) for c in ("start", "end", "other_start", "other_end", "matched")], ("identity", pa.float64())]))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> DataFrame:
    """doc_id, other_id, start, end, other_start, other_end (in words, ends excluded), matched, identity: passages of a document
    that an earlier one (by doc_id) has too, with at least min_words words in common and at least min_identity of them in line.

    Words are the runs of letters, digits and non-ASCII characters, A-Z as a-z. Each occurrence of a seed is matched with the first
    document that has it, and with the previous one where the first documents' matches go on for less than min_words; spans of SPANS
    words with several first documents, or with hot seeds, likewise (seeds in very many documents: the first and previous of one of
    SALTS groups, and the first of that with the first of all). So a passage in n documents gives some n rows, not one per pair. A chain
    of at least LEAST_WORTH is aligned; seeds that edits leave no SEED_WORDS + SEED_WINDOW - 1 words in a row can be missed.
    Repeats within one document aren't reported, nor is a row without doc_id. Null, empty and short texts have no passages.
    Rows of one doc_id should have one text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring-dedup")
    texts = docs.where("doc_id IS NOT NULL").select(docs["doc_id"].cast("long").alias("id"), docs["text"].alias("t"))
    counted = scratch.put(texts.mapInArrow(_frequent, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")))
    count = blocks.block_count(counted.where("s IS NULL").agg(F.sum("n")).first()[0] or 0)
    frequent = counted.where((F.col("n") > HOT_DOCS) & F.col("s").isNotNull()).orderBy(F.desc("n"), "s").limit(HOT_SEEDS)
    hot = spark.sparkContext.broadcast(np.sort(np.array([r["s"] for r in frequent.select("s").collect()], np.int64).view(np.uint64)))  # HOT_SEEDS at most
    seeds = texts.mapInArrow(lambda b: _placed(b, hot.value, count), blocks.SCHEMA)

    def linked(rows: DataFrame, names: list[str]) -> DataFrame:
        out = ", ".join(["s long", "salt int", *[f"{p}{c} {'long' if c == 'id' else 'int'}" for p in ("", "first_", "prev_") for c in names]])
        return rows.repartition("s", "salt").sortWithinPartitions("s", "salt", "id", "pos").mapInArrow(lambda b: shared_rows(b, names, True), out)

    def across(firsts: DataFrame) -> DataFrame:
        """Matches of the first of each salt group with the first of all."""
        least = firsts.groupBy("s").agg(F.min(F.struct("id", "pos")).alias("least"))
        return firsts.join(least, "s").where("id <> least.id").select("id", "pos", "n", F.col("least.id").alias("other"), F.col("least.pos").alias("other_pos"))

    met = ", ".join(["s long", "salt int", *[f"{p}id long" for p in ("", "first_", "prev_")], *[f"{p}pos int" for p in ("", "first_", "prev_")]])
    shared = seeds.groupBy("block").applyInArrow(lambda b: _met(b, count), met).repartition("id").sortWithinPartitions("id", "pos")
    stretches = scratch.put(shared.mapInArrow(lambda b: _stretches(b, min_words), STRETCH))
    spans = scratch.put(linked(stretches.where("kind = 1").select("s", "salt", "id", "pos", "n"), ["id", "pos", "n"]))
    match = ["id", "pos", "n", "other", "other_pos"]
    matches = stretches.where("kind = 0").select(*match)
    matches = matches.unionByName(across(stretches.where("kind = 2"))).unionByName(across(spans.where("salt > 0 AND id = first_id AND pos = first_pos")))
    for p in ("first", "prev"):
        other = spans.where(f"id <> {p}_id" + (" AND prev_id <> first_id" if p == "prev" else ""))
        matches = matches.unionByName(other.select("id", "pos", "n", F.col(f"{p}_id").alias("other"), F.col(f"{p}_pos").alias("other_pos")))
    matches = matches.groupBy("id", "other").agg(F.collect_list(F.struct("pos", "n", "other_pos")).alias("matches"), F.sum("n").alias("n"))
    matches = matches.where(F.col("n") >= LEAST_WORTH)
    found = scratch.put(matches.mapInArrow(lambda b: _chained(b, LEAST_WORTH), "id long, other long, nth int, segs array<int>"))

    def cut(side: str, partner: str, first: int) -> DataFrame:
        """The words of the chains' side: each text once for up to some CHAINS of its chains."""
        deal = found.groupBy(side).agg(F.ceil(F.count("*") / CHAINS).cast("int").alias("deals"))
        dealt = found.join(deal, side).withColumn("deal", F.pmod(F.xxhash64(partner, "nth"), F.col("deals")))
        dealt = dealt.groupBy(F.col(side).alias("id"), "deal").agg(F.collect_list(F.struct(F.col(partner).alias("partner"), "nth", "segs")).alias("chains"))
        kept = "id long, partner long, nth int, segs array<int>, begin int, words array<long>"
        return texts.join(small(scratch.put(dealt), 20_000), "id").mapInArrow(lambda b: _cut(b, first), kept)

    one = cut("id", "other", 0).withColumnRenamed("partner", "other")
    two = cut("other", "id", 2).select(F.col("partner").alias("id"), F.col("id").alias("other"), "nth", F.col("begin").alias("other_begin"), F.col("words").alias("other_words"))
    out = "doc_id long, other_id long, start int, end int, other_start int, other_end int, matched int, identity double"
    return one.join(two, ["id", "other", "nth"]).mapInArrow(lambda b: _aligned(b, min_words, min_identity), out)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
