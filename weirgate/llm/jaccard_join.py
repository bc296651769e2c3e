"""Operator 2: n-gram Jaccard self-join as a blocked sparse product of the document by n-gram incidence matrix.

The product's entries are overlap counts. The matrix is dealt in blocks of columns (n-grams); a block leaves out the columns
that one document alone has, which add to no overlap, and gives the others their document frequency over the whole table.
Rows are then put in one global order of the columns, the rarest first. The block of a row's first columns, as many as a
document of similarity t can't miss all of, gives the pairs; the products of the other columns are added up, rarest first, for
the pairs that sizes and places leave, and a pair is discarded as soon as the columns that are left can't reach what t asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, tokens
from .common import Scratch, small, table
from .graph import components

SHINGLE_WORDS, PERCENT = 5, 75
#: Parts in which the products of a pair's columns are added up.
PARTS = 4
#: Words of 64 bits in which a row keeps, for each hashed group of its columns, whether their number is odd.
PARITY = [f"odd{i}" for i in range(8)]
#: Before all pairs that are left are counted, the rows of columns longer than LONG_COLUMN are compared with one of them, in up to ROUNDS rounds, as long as these find links.
LONG_COLUMN, ROUNDS = 16, 4


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's distinct k-grams as sorted hashes. Fewer words than k make one gram, none make none."""
    word, starts = tokens.words(column, tokens.NOT_BLANK)
    gram = tokens.grams(word, k)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        yield np.unique(gram[a : b - k + 1]) if b - a >= k else tokens.grams(word[a:b], b - a) if b > a else gram[:0]


def _profile(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of each text: id, th, n, and two hashes of its set."""
    for rows in batches:
        for part in tokens.batches(rows, "t"):
            sets = list(_sets(part.column("t"), k))
            n = np.array([len(x) for x in sets], np.int32)
            with np.errstate(over="ignore"):
                h1 = np.array([tokens.mix(x).sum(dtype=np.uint64) for x in sets], np.uint64)
                h2 = np.array([tokens.mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for x in sets], np.uint64)
            yield pa.RecordBatch.from_pydict({"id": part.column("id"), "th": part.column("th"), "n": pa.array(n), "h1": pa.array(h1.view(np.int64)), "h2": pa.array(h2.view(np.int64))})


def _entries(batches: Iterator[pa.RecordBatch], k: int, count: int) -> Iterator[pa.RecordBatch]:
    def parts():
        for rows in batches:
            for part in tokens.batches(rows, "t"):
                sets = list(_sets(part.column("t"), k))
                n = np.array([len(x) for x in sets])
                yield np.concatenate(sets), np.repeat(np.asarray(part.column("id")), n), np.zeros(0, np.int64)

    return blocks.packed(parts(), count)


def _shared(block: pa.Table) -> pa.Table:
    """The entries of columns that several documents have, with the column's document frequency."""
    column, ids, _ = blocks.unpacked(block)
    new = np.concatenate([[True], (column[1:] != column[:-1]) | (ids[1:] != ids[:-1])])  # a row may stand twice in the table
    column, ids = column[new], ids[new]
    _, df = blocks.runs(column)
    keep = np.repeat(df > 1, df)
    return pa.table({"id": ids[keep], "df": np.repeat(df, df)[keep].astype(np.int32), "s": column[keep].view(np.int64)})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, n, PARITY and columns of each document, of entries sorted by document, its size (df = 0, s = size) before its columns. They may lie in several batches."""
    held: list[tuple[np.ndarray, ...]] = []

    def out(x: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        ids, df, s = x
        at = blocks.runs(ids)[0]
        column = df > 0
        counts, bits = np.add.reduceat(column, at, dtype=np.int64), 64 * len(PARITY)
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        group = np.repeat(np.arange(len(at)), counts) * bits + ((s[column] >> 8) & (bits - 1))
        odd = np.packbits((np.bincount(group, minlength=len(at) * bits) & 1).astype(np.uint8)).view(np.int64).reshape(len(at), -1)
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(s[at].astype(np.int32)), *[pa.array(x) for x in odd.T.copy()], pa.ListArray.from_arrays(pa.array(ends), pa.array(s[column]))], ["id", "n", *PARITY, "columns"])

    for rows in batches:
        if not rows.num_rows:
            continue
        x = tuple(np.asarray(rows.column(c)) for c in ("id", "df", "s"))
        cut = int(np.searchsorted(x[0], x[0][-1]))
        if cut or (held and held[-1][0][-1] != x[0][0]):
            held.append(tuple(v[:cut] for v in x))
            yield out(tuple(np.concatenate(v) for v in zip(*held, strict=True)))
            held = []
        held.append(tuple(v[cut:] for v in x))
    if held:
        yield out(tuple(np.concatenate(v) for v in zip(*held, strict=True)))


def _asked(a: Column, b: Column, percent: int) -> Column:
    """The least overlap of two linked sets of these sizes: percent / (100 + percent) of both."""
    return F.ceil(percent * (a + b).cast("long") / (100 + percent)).cast("int")


def _may_link(percent: int) -> Column:
    """Whether sizes, and the places in the order of a column that both have, leave room for the overlap that is asked for. Columns that one
    document alone has (own) come before all others and are in no overlap."""
    a, b, i, j, x, y = (F.col(f"{p}{c}") for c in ("n", "pos", "own") for p in ("", "b_"))
    most = F.least(i - x, j - y) + 1 + F.least(a - i - 1, b - j - 1)
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (most >= _asked(a, b, percent))


def _linked(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose overlap reaches what is asked for; products are added up part by part, rarest columns first."""
    one, two = (rows.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n"), F.col("columns").alias(f"{c}_columns")) for c in "ab")
    both = pairs.join(one, "a").join(two, "b").withColumn("asked", _asked(F.col("a_n"), F.col("b_n"), percent))
    size = F.size("a_columns")
    step = F.ceil(size / PARTS).cast("int")

    def add(count: Column, i: Column) -> Column:
        left = F.least(size - i * step, F.size("b_columns") - count)
        product = F.size(F.array_intersect(F.slice("a_columns", i * step + 1, F.greatest(step, F.lit(1))), "b_columns"))
        return F.when(count + left < F.col("asked"), count).otherwise(count + product)

    overlap = F.aggregate(F.sequence(F.lit(0), F.lit(PARTS - 1)), F.lit(0), add)
    return both.where(overlap >= F.col("asked")).select("a", "b")


def _firsts(entries: DataFrame, parts: DataFrame | None, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of documents in different components: b is one document of a column, a is any other. Of a document's pairs, that of most columns."""
    if parts is None:  # the row that has fewest rarer columns: of a group of like texts, the one with fewest words of its own
        placed, order = entries.withColumn("part", F.col("id")), F.struct("pos", "id")
    else:
        placed = entries.join(parts, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
        order = F.struct(F.xxhash64(F.lit(turn), "part"), "pos", F.xxhash64(F.lit(turn), "id"))
    pick = F.min_by(F.struct("id", "n", "pos", "own", "part"), order).alias("p")
    columns = placed.groupBy("s").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("size"), pick)
    columns = columns.where("low < high" + ("" if parts is None else f" AND size > {LONG_COLUMN}"))
    columns = columns.select("s", *[F.col(f"p.{c}").alias(f"b_{c}") for c in ("id", "n", "pos", "own", "part")])
    met = placed.join(columns, "s").where(F.col("part") != F.col("b_part")).where(_may_link(percent))
    met = met.groupBy(F.col("id").alias("a"), F.col("b_id").alias("b")).agg(F.count("*").alias("times"))
    return met.groupBy("a").agg(F.max_by("b", F.struct("times", "b")).alias("b"))


def _rest(entries: DataFrame, parts: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of documents in different components that meet in a column of their first blocks and can still link. The number of
    columns that they meet in is their first blocks' overlap: it and the columns that either has beyond bound the whole. A group of columns
    whose number is odd in one row and even in the other holds a column that only one of the two has, which bounds what they can have in common."""
    placed = entries.join(parts, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
    columns = placed.groupBy("s").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("s")
    # sizes of linked sets lie in one band or in neighbours
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    mixed = placed.join(columns, "s", "left_semi").join(rows.select("id", *PARITY), "id").withColumn("band", band)
    names = ["id", "n", "pos", "own", "part", "first", *PARITY]
    mixed = mixed.select("s", "band", *names)
    other = mixed.select("s", *[F.col(c).alias(f"b_{c}") for c in names], F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"))
    smaller = (F.col("n") < F.col("b_n")) | ((F.col("n") == F.col("b_n")) & (F.col("id") < F.col("b_id")))
    apart = F.col("own") + F.col("b_own")
    for c in PARITY:
        apart = apart + F.bit_count(F.col(c).bitwiseXOR(F.col(f"b_{c}")))
    room = apart <= F.col("n") + F.col("b_n") - 2 * _asked(F.col("n"), F.col("b_n"), percent)
    met = mixed.join(other, ["s", "band"]).where(smaller & (F.col("part") != F.col("b_part")) & _may_link(percent) & room)
    pairs = met.groupBy(F.col("id").alias("a"), F.col("b_id").alias("b")).agg(F.count("*").alias("met"), F.first("n").alias("a_n"), F.first("b_n").alias("b_n"), F.first("first").alias("a_first"), F.first("b_first").alias("b_first"))
    # whose block ends first in the global order has no common column elsewhere in the other's block
    most = F.col("met") + F.greatest(F.col("a_n") - F.col("a_first"), F.col("b_n") - F.col("b_first"))
    return pairs.where(most >= _asked(F.col("a_n"), F.col("b_n"), percent)).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs (doc_id: long, text), in no order.

    Texts in which A-Z count as a-z are cut at [\\x20\\x09-\\x0D]; a document's set has its distinct k-word shingles, or
    all its words as one if they are fewer. Two documents link when 100 * overlap >= percent * union. component_id is
    the least doc_id that links reach. Null, empty and blank texts have no shingles and no links. Rows are kept
    one for one. doc_id should name one text: where it has several, each row gets the component of its own text.
    Rows without doc_id have no links and no component.

    Sets that are equal are one row of the matrix. In each column, all rows are first compared with one of them: a group of like
    texts takes a comparison per member, not one per pair. Only rows that meet in one column but are in different
    components after that are compared with each other, so no link between components is lost.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].alias("t")).withColumn("th", F.xxhash64("t"))
    seen = scratch.put(texts.mapInArrow(lambda b: _profile(b, k), "id long, th long, n int, h1 long, h2 long"))
    known = seen.where("n > 0 AND id IS NOT NULL")
    classes = scratch.put(known.groupBy("h1", "h2", "n").agg(F.min("id").alias("node"), F.count("*").alias("copies")))
    copies = known.join(classes.where("copies > 1"), ["h1", "h2", "n"]).where("id <> node").select("id", "th")
    nodes = texts.where("id IS NOT NULL").join(small(scratch.put(copies)), ["id", "th"], "left_anti")

    count = blocks.block_count(classes.agg(F.sum("n")).first()[0] or 0)
    matrix = nodes.mapInArrow(lambda b: _entries(b, k, count), blocks.SCHEMA)
    shared = matrix.groupBy("block").applyInArrow(_shared, "id long, df int, s long")
    shared = shared.unionByName(classes.select(F.col("node").alias("id"), F.lit(0).alias("df"), F.col("n").cast("long").alias("s")))
    rows = shared.repartition("id").sortWithinPartitions("id", "df", "s").mapInArrow(_rows, ", ".join(["id long", "n int", *[f"{c} long" for c in PARITY], "columns array<long>"]))
    rows = scratch.put(rows)

    # columns that no other document has come first in the order, and fill some of the first block
    first = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    own = F.col("n") - F.size("columns")
    entries = rows.withColumn("first", first).withColumn("own", own).where("first > own")
    entries = entries.select("id", "n", "first", "own", F.posexplode(F.slice("columns", F.lit(1), F.col("first") - F.col("own"))).alias("i", "s"))
    entries = scratch.put(entries.select("s", "id", "n", (F.col("own") + F.col("i")).alias("pos"), "own", "first"))

    links = scratch.put(_linked(scratch.put(_firsts(entries, None, 0, percent)), rows, percent))
    parts = components(links, scratch)
    for turn in range(1, ROUNDS + 1):
        pairs = scratch.put(_firsts(entries, parts, turn, percent))
        found = scratch.put(_linked(pairs, rows, percent))
        if 10 * found.count() < pairs.count() or found.isEmpty():  # what is left are few links among many pairs
            links = links.unionByName(found)
            break
        links = scratch.put(links.unionByName(found), instead_of=links)
        parts = components(links, scratch)
    links = links.unionByName(_linked(scratch.put(_rest(entries, parts, rows, percent)), rows, percent))
    parts = components(links, scratch)
    found = seen.join(classes.select("h1", "h2", "n", "node"), ["h1", "h2", "n"], "left").join(parts.select(F.col("id").alias("node"), "component"), "node", "left")
    return found.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "node", "id")).alias("component_id"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""
