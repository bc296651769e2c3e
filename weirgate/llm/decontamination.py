"""Operator 7: benchmark decontamination by winnowing.

Of every WINDOW_GRAMS k-grams in a row, texts and benchmark items keep the one of least hash. Two texts that share
k + WINDOW_GRAMS - 1 words in a row keep the same k-gram there, so joining the kept fingerprints misses no shared
span of that length. Each hit is extended to the windows around it, which are compared by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import Scratch, packed, small, small_bytes, table, with_columns

WINDOW_WORDS, GRAM_WORDS = 10, 5
#: Words of the text as it stands; A-Z count as their lower-case letters.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _rows(part: pa.RecordBatch, text: np.ndarray, **values: np.ndarray) -> pa.RecordBatch:
    """id and th of the given texts of part, and values; hashes as signed longs."""
    which = pa.array(text)
    columns = {c: part.column(c).take(which) for c in ("id", "th")} | {k: pa.array(v.view(np.int64) if v.dtype == np.uint64 else v.astype(np.int32)) for k, v in values.items()}
    return pa.RecordBatch.from_pydict(columns)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of the batches with their words' hashes, where each text's words begin, and the text of each word."""
    for rows in batches:
        for part in tokens.batches(rows, "t"):
            word, starts = tokens.words(part.column("t"), tokens.ALNUM)
            yield part, word, starts, tokens.text_of(starts, len(word))


def _fingerprints(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[pa.RecordBatch]:
    """id, th, pos, fp of the k-grams that winnowing keeps."""
    for part, word, starts, text in _parts(batches):
        gram = tokens.grams(word, k)
        own = text[: len(gram)].copy()
        across = np.flatnonzero(own != text[len(text) - len(gram) :])
        own[across] = -1 - across  # grams that reach into the next text belong to none
        at = np.flatnonzero(tokens.winnow(gram, own, window - k + 1))
        yield _rows(part, text[at], pos=at - starts[text[at]], fp=gram[at])


def _grams(batches: Iterator[pa.RecordBatch], lengths: list[int], whole_texts: bool) -> Iterator[pa.RecordBatch]:
    """id, th, pos, len, h1, h2 of the grams of the given lengths: all, or of texts that have just so many words (whole_texts)."""
    for part, word, starts, text in _parts(batches):
        for size in lengths:
            n = max(0, len(word) - size + 1)
            chosen = text[:n] == text[len(text) - n :]
            if whole_texts:
                chosen &= np.diff(starts)[text[:n]] == size
            at = np.flatnonzero(chosen)
            yield _rows(part, text[at], pos=at - starts[text[at]], len=np.full(len(at), size), h1=tokens.grams(word, size)[at], h2=tokens.grams(word, size, 1)[at])


def _extended(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[pa.RecordBatch]:
    """As _grams, of the windows that hold a hit k-gram (column hits has their places)."""
    for part, word, starts, text in _parts(batches):
        hits = part.column("hits")
        of = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(hits.offsets)))
        at = starts[of] + np.asarray(hits.flatten())
        near = at[:, None] - np.arange(window - k + 1)[None, :]
        inside = (near >= starts[of][:, None]) & (near <= starts[of + 1][:, None] - window)
        at = np.unique(near[inside])
        yield _rows(part, text[at], pos=at - starts[text[at]], len=np.full(len(at), window), h1=tokens.grams(word, window)[at], h2=tokens.grams(word, window, 1)[at])


_GRAM_ROW = "id long, th long, pos int, len int, h1 long, h2 long"


def mark_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, k: int = GRAM_WORDS) -> DataFrame:
    """docs' columns and n_words, n_hit, spans (array of start, end in words, merged), items (sorted ids), contaminated.

    A window is `window` words in a row of an item's text; an item of fewer words, but not none, is one window.
    A word of a document is hit if it lies in an occurrence of a window. Columns of the names above are replaced.
    Null and empty texts have no words and are never hit; items without words have no window, and items without an id
    have windows but aren't listed. Rows are kept one for one; repeated rows get the same result.

    Documents' fingerprints and windows meet those of the benchmark by joins, which broadcast a side only if its
    bytes, arrays included, were summed up to be few. Only documents with a hit are read again to extend it.
    """
    scratch = Scratch(docs.sparkSession, "decontamination")
    rows = docs.select(packed(docs).alias("row"), docs["doc_id"].alias("id"), docs["text"].alias("t")).withColumn("th", F.xxhash64("t"))
    items = benchmark.select(benchmark["item_id"].alias("id"), benchmark["text"].alias("t")).withColumn("th", F.xxhash64("t"))
    texts = rows.select("id", "th", "t")
    short = list(range(1, window))
    grams = items.mapInArrow(lambda b: _grams(b, [window], False), _GRAM_ROW).unionByName(items.mapInArrow(lambda b: _grams(b, short, True), _GRAM_ROW))
    sets = scratch.put(grams.groupBy("len", "h1", "h2").agg(F.array_sort(F.collect_set("id")).alias("items")))
    known = small(items.mapInArrow(lambda b: _fingerprints(b, window, k), "id long, th long, pos int, fp long").select("fp").distinct().transform(scratch.put))
    marks = texts.mapInArrow(lambda b: _fingerprints(b, window, k), "id long, th long, pos int, fp long")
    hits = marks.join(known, "fp", "left_semi").groupBy("id", "th").agg(F.collect_set("pos").alias("hits"))
    hits = small_bytes(scratch.put(hits.select(F.col("id").alias("hit_id"), F.col("th").alias("hit_th"), "hits")))
    near = texts.join(hits, texts["id"].eqNullSafe(hits["hit_id"]) & (texts["th"] == hits["hit_th"])).select("id", "th", "t", "hits")
    found = near.mapInArrow(lambda b: _extended(b, window, k), _GRAM_ROW)
    lengths = [r["len"] for r in sets.where(F.col("len") < window).select("len").distinct().collect()]  # fewer than `window` values
    if lengths:
        found = found.unionByName(texts.mapInArrow(lambda b: _grams(b, lengths, False), _GRAM_ROW))
    met = found.join(small_bytes(sets), ["len", "h1", "h2"]).groupBy("id", "th").agg(F.collect_set(F.struct("pos", "len")).alias("met"), F.collect_set("items").alias("sets"))
    met = met.select(F.col("id").alias("met_id"), F.col("th").alias("met_th"), merged("met").alias("spans"), F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items"))
    met = scratch.put(met)
    both = rows.join(met, rows["id"].eqNullSafe(met["met_id"]) & (rows["th"] == met["met_th"]), "left")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return with_columns(
        both,
        "row",
        n_words=F.coalesce(F.regexp_count("t", F.lit(WORD)), F.lit(0)).cast("long"),
        n_hit=F.coalesce(hit, F.lit(0)).cast("long"),
        spans=F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")),
        items=F.coalesce("items", F.array().cast("array<long>")),
        contaminated=F.coalesce(hit, F.lit(0)) > 0,
    )


def merged(spans: str) -> Column:
    """array of struct(pos, len) -> array of struct(start, end) that don't touch each other, in order; one pass over the sorted spans."""
    span = lambda start, end: F.struct(start.alias("start"), end.alias("end"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def take(acc: Column, x: Column) -> Column:
        end = x["pos"] + x["len"]
        apart = x["pos"] > acc["now"]["end"]
        done = F.when(apart & (acc["now"]["end"] >= 0), F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        now = F.when(apart, span(x["pos"], end)).otherwise(span(acc["now"]["start"], F.greatest(acc["now"]["end"], end)))
        return F.struct(done.alias("done"), now.alias("now"))

    start = F.struct(none.alias("done"), span(F.lit(-1), F.lit(-1)).alias("now"))
    return F.aggregate(F.array_sort(F.col(spans)), start, take, lambda acc: F.concat(acc["done"], F.array(acc["now"])))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mark_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")


OP7_SQL = r"""
WITH b AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(n, 10) AS k, array_to_string(w[i:i + least(n, 10) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(n - 9, 1) + 1)) AS i FROM b)),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
g AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT doc_id, i, g.k, item_id FROM g JOIN bw USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
