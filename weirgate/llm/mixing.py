"""Operator 8: mixing sources to target weights, with DataFrame functions only.

Weighted fair queueing: the documents of each source stand in a shuffled queue, repeated as often as the mix may
repeat them. A queued document's virtual finish time is the words of its source up to and with it, divided by the
source's target. All queues are merged by that time. Words are summed by ranges of time, which finds the range in which
the budget of the whole mix ends; entries of earlier ranges are taken, and those of that range in their order, up to the budget.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, packed, small, table, with_columns

WEIGHTS, SHARE_PERCENT, MAX_EPOCHS = (5, 2, 1), 150, 2
#: Rows that one range of a queue is meant to hold, and parts that rows equal in id, source and size are dealt to.
RANGE_ROWS, SALTS = 2_000, 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target and the budget of all (in whole words), from source and size. One row a source from the first step on.

    Raising all uncapped sources together, by weight, until their sum is the budget gives the same as capping
    and resharing again and again. In order of cap / weight, the level over the sources from k on is
    (budget - caps before k) / weights from k on; the first k whose cap is at least at its level sets the level; it is the greatest of these, as levels fall from there on.
    A source without words has target 0.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = by_source.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("left", F.lit(share_percent) * F.sum("source_size").over(everything) - 100 * F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("at", F.col("left").cast("double") / (100 * F.sum("weight").over(onward)).cast("double"))
    fits = F.col("at") * F.col("weight") <= F.col("cap")
    s = s.withColumn("level", F.max(F.when(fits, F.col("at"))).over(everything))
    s = s.withColumn("target", F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    total = F.sum("source_size").over(everything)
    budget = F.least(F.floor(share_percent * total / 100), epochs * total)
    return s.select("source", "source_size", "target", budget.cast("long").alias("budget"))


def running(df: DataFrame, group: list[str], order: list[str], cell: str, value: str, out: str) -> DataFrame:
    """df with out: the sum of value before each row, per group in the given order. cell is a leading part of the order.

    Sums of cells come first (small, pre-aggregated), then sums within each cell: no task holds a whole group.
    """
    cells = df.groupBy(*group, cell).agg(F.sum(value).alias("cell_sum"))
    ahead = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*[F.col(c).alias(f"cell_{c}") for c in [*group, cell]], F.coalesce(F.sum("cell_sum").over(ahead), F.lit(0)).alias("ahead"))
    same = [df[c].eqNullSafe(cells[f"cell_{c}"]) for c in [*group, cell]]
    within = Window.partitionBy(*group, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = df.join(cells, same, "inner").withColumn(out, F.col("ahead") + F.coalesce(F.sum(value).over(within), F.lit(0)))
    return found.select(*df.columns, out)


def mix_sources(docs: DataFrame, size: Column | None = None, seed: str = "mix", weights=WEIGHTS, share_percent: int = SHARE_PERCENT, epochs: int = MAX_EPOCHS) -> DataFrame:
    """The merged queue: docs' columns and size, source_size, target, nth (tells rows that are equal in doc_id, source and
    size apart), epoch (1, 2 ..), finish and words (taken from this entry). size: n_words(text) unless it is given.

    Columns of those names are replaced. Documents are shuffled by md5 of seed and doc_id, so that reruns agree; rows of one
    doc_id stand by size, then by a hash of the row, and equal rows are interchangeable. Entries are taken in order of finish,
    then of that md5, epoch, size and source, until the budget is used up; of the last one, the mix takes the words that are left.
    So every entry that ends by its source's target is taken, and a source's words are less than one document off its target
    (more only by what others leave). A null source is a source of its own; a null text has no words, and such entries take none.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(packed(docs).alias("row"), docs["doc_id"].alias("id"), docs["source"], (n_words(docs["text"]) if size is None else size).alias("size"))
    rows = rows.withColumn("rh", F.xxhash64("row")).withColumn("salt", F.pmod("rh", F.lit(SALTS)).cast("int"))
    sizes = scratch.put(rows.select("id", "source", "size", "salt"))
    queue = queued(sizes, scratch, seed, weights, share_percent, epochs)
    queue = queue.select(*[F.col(c).alias(f"q_{c}") for c in ("id", "source", "size", "salt", "nth")], "epoch", "source_size", "target", "finish", "words")
    # equal rows are numbered, so that each meets its own queue entries
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("id", "source", "size", "salt").orderBy("rh")))
    on = [rows["id"].eqNullSafe(queue["q_id"]), rows["source"].eqNullSafe(queue["q_source"]), *[rows[c] == queue[f"q_{c}"] for c in ("size", "salt", "nth")]]
    both = rows.join(queue, on, "inner").withColumn("nth", F.col("nth").cast("long") * SALTS + F.col("salt"))
    return with_columns(both, "row", **{c: F.col(c) for c in ("size", "source_size", "target", "nth", "epoch", "finish", "words")})


def queued(sizes: DataFrame, scratch: Scratch, seed: str, weights, share_percent: int, epochs: int) -> DataFrame:
    """An entry for each row (id, source, size, salt), nth (of the rows equal in these) and epoch, with finish and words. sizes: a written table."""
    count = sizes.count()
    targets = scratch.put(source_targets(sizes, weights, share_percent, epochs))
    digits = max(1, math.ceil(math.log(max(count, 1) / RANGE_ROWS + 1, 16)))
    keys = sizes.groupBy("id", "source", "size", "salt").agg(F.count("*").alias("times"))
    keys = keys.withColumn("mark", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    keys = keys.withColumn("cell", F.substring("mark", 1, digits)).withColumn("all", F.col("size") * F.col("times"))
    ordered = running(keys, ["source"], ["mark", "size", "salt"], "cell", "all", "before")
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target", "budget")
    entries = ordered.join(small(t), ordered["source"].eqNullSafe(t["t_source"]), "inner")
    entries = entries.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    entries = entries.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    end = F.col("before") + F.col("nth") * F.col("size") + (F.col("epoch") - 1) * F.col("source_size")
    entries = entries.withColumn("finish", F.when(F.col("target") > 0, end / F.col("target")))
    # time 1 is when a source reaches its target; entries that end far beyond it share one range
    ranges = max(1, count // RANGE_ROWS)
    entries = entries.withColumn("range", F.floor(F.least("finish", F.lit(8.0)) * ranges))
    entries = scratch.put(entries.select("id", "source", "size", "salt", "nth", "epoch", "mark", "source_size", "target", "budget", "finish", "range"))

    words = entries.where("size > 0").groupBy("range").agg(F.sum("size").alias("words"), F.first("budget").alias("budget"))
    words = words.withColumn("ahead", F.sum("words").over(Window.partitionBy().orderBy("range")) - F.col("words"))
    last = words.where("ahead < budget AND budget <= ahead + words").select("range", "ahead", "budget").first()  # one row: the range in which the budget ends
    taken = F.when(F.col("range") < F.lit(last["range"]), F.col("size")).otherwise(F.lit(0)) if last else F.lit(0)
    within = (F.col("size") > 0) & (F.col("range") == F.lit(last["range"] if last else None).cast("long"))
    done = entries.where(~F.coalesce(within, F.lit(False))).withColumn("words", taken.cast("long"))
    order = Window.partitionBy("range").orderBy("finish", "mark", "epoch", "size", F.col("source").asc_nulls_last(), "salt")
    ahead = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.lit(last["ahead"] if last else 0)
    cut = entries.where(within).withColumn("words", F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - ahead)).cast("long"))
    return done.unionByName(cut).drop("mark", "budget", "range")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    queue = mix_sources(docs, size=docs["size"])
    return queue.groupBy("doc_id", "source", "size", "nth", "source_size", "target").agg(F.sum("words").alias("taken")).drop("source", "nth")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(2 * sum(size) AS BIGINT) AS cap,
      [5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] AS weight FROM d GROUP BY source),
r AS (SELECT *, CAST(150 * sum(source_size) OVER () - 100 * coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / CAST(100 * sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev FROM s),
v AS (SELECT source, source_size, least(max(CASE WHEN lev * weight <= cap THEN lev END) OVER () * weight, CAST(cap AS DOUBLE)) AS target FROM r),
q AS (SELECT d.doc_id, d.source, d.size, v.source_size, v.target, md5(concat('mix:', d.doc_id)) AS mark, row_number() OVER () AS nth, coalesce(sum(d.size) OVER (PARTITION BY d.source
        ORDER BY md5(concat('mix:', d.doc_id)), d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source),
e AS (SELECT q.*, epoch, CASE WHEN target > 0 THEN CAST(before + size + (epoch - 1) * source_size AS DOUBLE) / target END AS finish FROM q, (VALUES (1), (2)) t(epoch)),
m AS (SELECT *, coalesce(sum(size) OVER (ORDER BY finish NULLS LAST, mark, epoch, size, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM e),
b AS (SELECT least(150 * sum(size) // 100, 2 * sum(size)) AS budget FROM d)
SELECT doc_id, size, source_size, target, CAST(sum(greatest(0, least(size, budget - ahead))) AS BIGINT) AS taken FROM m, b GROUP BY nth, doc_id, size, source_size, target
"""
