"""Operator 11: ranked lexical search by the Best Position Algorithm.

Documents become segments: for each query term that a segment's documents hold, its postings (document, frequency). A segment is read
by one task at a time. Within it, each term of an item is a list of documents by falling impact. Lists are read from the top in step;
a document that comes up is looked up in all other lists at once (direct access), which also marks its places there as seen. What no
one has seen yet lies behind every list's best position, the end of its unbroken run of seen places, so the impacts there add up to a
bound of all other scores: nearer than the last places read. A task goes on with the scores that its earlier segments gave,
and stops once the bound is strictly below the kth: a document of equal score might have a lesser id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import Scratch, table

TOP = 10
#: Items are answered in blocks of about so many terms, which are what goes to every task.
BLOCK_TERMS = 200_000
#: A segment ends with the piece of documents at which it has so many postings.
SEGMENT_POSTINGS = 1_000_000
#: Places that are read of each list at first; twice as many each time.
FIRST_READ, MOST_READ = 32, 4096
#: Fixed values of the score.
SCALE, LOG_SCALE, SATURATION, NORM, NORM_SHARE = 1_000_000_000, 1000, 8, 100, 90
_LAST = 2**63 - 1  # stands for a null id, behind all others

SEGMENT = "docs array<long>, lengths binary, term binary, doc binary, tf binary, terms array<int>, dfs array<long>, n_docs long, n_terms long"


def _segments(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of SEGMENT of rows (doc_id, text). Documents that hold no term of the vocabulary are counted only."""
    held: list[tuple[np.ndarray, ...]] = []
    ids: list[pa.Array] = []
    documents = occurrences = docs = postings = 0
    for batch in batches:
        for part in tokens.batches(batch, "text"):
            word, starts = tokens.words(part.column("text"), tokens.ALNUM)
            length = np.diff(starts)
            documents, occurrences = documents + int((length > 0).sum()), occurrences + len(word)
            at = np.minimum(np.searchsorted(vocabulary, word), len(vocabulary) - 1)
            known = np.flatnonzero(vocabulary[at] == word)
            key, tf = np.unique(tokens.text_of(starts, len(word))[known] * len(vocabulary) + at[known], return_counts=True)
            own, doc = np.unique(key // len(vocabulary), return_inverse=True)
            held.append(((key % len(vocabulary)).astype(np.int32), (doc + docs).astype(np.int32), tf.astype(np.int64), length[own]))
            ids.append(part.column("doc_id").cast(pa.int64()).take(pa.array(own)))
            docs, postings = docs + len(own), postings + len(key)
            if postings >= SEGMENT_POSTINGS:
                yield _segment(held, ids, documents, occurrences)
                held, ids, documents, occurrences, docs, postings = [], [], 0, 0, 0, 0
    if held:
        yield _segment(held, ids, documents, occurrences)


def _segment(held: list[tuple[np.ndarray, ...]], ids: list[pa.Array], documents: int, occurrences: int) -> pa.RecordBatch:
    term, doc, tf, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((doc, term))
    term, doc, tf = term[order], doc[order], tf[order]
    own, df = np.unique(term, return_counts=True)
    row = {"docs": pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64()))}
    row |= {k: pa.array([v.tobytes()], pa.binary()) for k, v in (("lengths", lengths.astype(np.int64)), ("term", term), ("doc", doc), ("tf", tf))}
    row |= {"terms": pa.array([own], pa.list_(pa.int32())), "dfs": pa.array([df], pa.list_(pa.int64())), "n_docs": pa.array([documents], pa.int64()), "n_terms": pa.array([occurrences], pa.int64())}
    return pa.RecordBatch.from_pydict(row)


class _List:
    """The postings of a term in a segment: documents in order, and their places by falling impact."""

    def __init__(self, doc: np.ndarray, impact: np.ndarray):
        self.doc, self.impact = doc, impact
        self.by_impact = np.argsort(-impact, kind="stable")
        self.place = np.empty(len(doc), np.int64)
        self.place[self.by_impact] = np.arange(len(doc))

    def find(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the documents are in the list, and where in order of documents."""
        at = np.minimum(np.searchsorted(self.doc, doc), len(self.doc) - 1)
        there = self.doc[at] == doc
        return there, at[there]


def best_positions(lists: list[_List], ids: np.ndarray, top: tuple[np.ndarray, np.ndarray], k: int) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """top (scores, ids; k at most) with the lists' documents taken in, and the number of places read in step. ids: of the segment's documents."""
    seen = [np.zeros(len(x.doc) + 1, bool) for x in lists]  # the last stays unseen
    best = [0] * len(lists)
    done = np.zeros(len(ids), bool)
    read, step = 0, FIRST_READ
    while True:
        bound = sum(int(x.impact[x.by_impact[b]]) for x, b in zip(lists, best, strict=True) if b < len(x.doc))
        if bound <= 0 or (len(top[0]) == k and bound < top[0][-1]):
            return top, read
        fresh = np.unique(np.concatenate([x.doc[x.by_impact[read : read + step]] for x in lists]))
        fresh = fresh[~done[fresh]]
        done[fresh] = True
        score = np.zeros(len(fresh), np.int64)
        for j, x in enumerate(lists):
            there, at = x.find(fresh)
            score[there] += x.impact[at]
            seen[j][x.place[at]] = True
            best[j] += int(np.argmin(seen[j][best[j] :]))
        top = _best(np.concatenate([top[0], score]), np.concatenate([top[1], ids[fresh]]), k)
        read, step = read + step, min(2 * step, MOST_READ)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(score) > k:  # only what reaches the kth score can be among them
        some = score >= np.partition(score, len(score) - k)[len(score) - k]
        score, ids = score[some], ids[some]
    some = np.flatnonzero(score > 0)
    order = some[np.lexsort((ids[some], -score[some]))][:k]
    return score[order], ids[order]


def norms(length: np.ndarray, documents: int, occurrences: int) -> np.ndarray:
    """m of documents of so many terms. Products may pass 64 bits, so Python's integers give the few different ones."""
    own, at = np.unique(length, return_inverse=True)
    return np.array([NORM - NORM_SHARE + NORM_SHARE * int(n) * documents // occurrences for n in own], np.int64)[at] if len(own) else own


def _answered(batches: Iterator[pa.RecordBatch], items: list[tuple[object, np.ndarray]], weight: np.ndarray, documents: int, occurrences: int, k: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """query, item_id, doc_id, score: of each item (id, its terms) the k best of all segments of this task."""
    tops = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
    for rows in batches:
        for i in range(rows.num_rows):
            x = {c: np.frombuffer(rows.column(c)[i].as_buffer(), t) for c, t in (("lengths", np.int64), ("term", np.int32), ("doc", np.int32), ("tf", np.int64))}
            ids = np.asarray(rows.column("docs")[i].values.fill_null(_LAST))
            m = norms(x["lengths"], documents, occurrences)
            impact = weight[x["term"]] * ((SCALE * x["tf"]) // (LOG_SCALE * x["tf"] + SATURATION * m[x["doc"]]))
            ends = np.searchsorted(x["term"], np.arange(len(weight) + 1))
            lists: dict[int, _List] = {}
            for q, (_, terms) in enumerate(items):
                for t in terms:
                    if t not in lists and ends[t] < ends[t + 1] and weight[t] > 0:
                        part = slice(ends[t], ends[t + 1])
                        lists[t] = _List(x["doc"][part], impact[part])
                own = [lists[t] for t in terms if t in lists]
                if own:
                    tops[q], _ = best_positions(own, ids, tops[q], k)
    query = np.repeat(np.arange(len(items)), [len(s) for s, _ in tops])
    score, doc = (np.concatenate(x) if tops else np.zeros(0, np.int64) for x in ([t[0] for t in tops], [t[1] for t in tops]))
    yield pa.RecordBatch.from_pydict({"query": pa.array(query, pa.int64()), "item_id": pa.array([items[q][0] for q in query], kind), "doc_id": pa.array(doc, pa.int64(), mask=doc == _LAST), "score": pa.array(score, pa.int64())})


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, np.ndarray]]]:
    """Items (id, hashes of their terms) in blocks, read a partition at a time."""
    block, terms = [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        own = np.unique(tokens.words(pa.array([r.text], pa.string()), tokens.ALNUM)[0])
        block.append((r.item_id, own))
        terms += len(own)
        if terms >= BLOCK_TERMS:
            yield block
            block, terms = [], 0
    if block:
        yield block


def search(documents: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: of each row of items (item_id, text) the k highest-scoring rows of documents (doc_id, text), from rank 1.

    Scores are as in the contract of the query: integers, above 0 only. Equal scores stand by ascending doc_id, nulls last. Null and
    empty texts have no terms: such documents aren't counted and never found, such items find nothing. Repeated rows are
    rows of their own on either side. Terms are 64-bit hashes: two different terms fall together with a chance of 1e-19 a pair.
    Other columns aren't read.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "lexical-search")
    kind = items.schema["item_id"].dataType
    schema = f"query long, item_id {kind.simpleString()}, doc_id long, score long"
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    texts, out = documents.select("doc_id", "text"), None
    for n, block in enumerate(_blocks(items)):
        vocabulary = np.unique(np.concatenate([own for _, own in block]))
        if not len(vocabulary):
            continue
        index = scratch.put(texts.mapInArrow(lambda b, v=vocabulary: _segments(b, v), SEGMENT))
        total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        counted = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df"))
        df = np.zeros(len(vocabulary), np.int64)
        for r in counted.toLocalIterator():  # one row a term of the block at most
            df[r.terms] = r.df
        weight = np.where(df, np.floor(LOG_SCALE * np.log((2.0 * total[0] + 2) / (2.0 * df + 1))), 0).astype(np.int64)
        asked = [(i, np.searchsorted(vocabulary, own).tolist()) for i, own in block]
        found = index.mapInArrow(lambda b, a=asked, w=weight, t=tuple(total): _answered(b, a, w, *t, k, arrow), schema)
        # a task gives k rows an item; they meet in 64 parts an item first
        part = Window.partitionBy("query", "part").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("part", F.spark_partition_id() % 64).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
        whole = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = scratch.put(found.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
        scratch.drop(index)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY ALL),
s AS (SELECT count(*) AS docs, sum(n) AS terms FROM n),
f AS (SELECT term, count(*) AS df FROM p GROUP BY ALL),
m AS (SELECT doc_id, CAST(10 + (CAST(90 AS HUGEINT) * n * docs) // terms AS BIGINT) AS m FROM n, s),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, s),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10
"""
