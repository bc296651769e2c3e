"""Operator 6: line dedup, with DataFrame functions only.

Lines are exploded with their position, their normalised form is hashed to 128 bits, distinct documents are
counted per hash, lines whose hash reaches the threshold are dropped, and the rest is put together by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, ascii_lower, packed, small, table, with_columns

MIN_DOCS, MIN_CHARS = 10, 1


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, by_text: bool = False) -> DataFrame:
    """docs with text less its frequent lines, plus n_lines (before) and n_dropped; columns of those names are replaced.

    A null or empty text is one empty line and comes back as "". A text that loses all lines comes back as "".
    Rows are kept one for one: repeated rows get the same result, and count as one document per doc_id.
    Rows with a null doc_id lose frequent lines too, but don't count towards them.
    by_text: lines count once per distinct text instead, whatever the doc_ids, so that exact copies alone make no line frequent.

    Only hashes are shuffled to count lines: a hot line spreads by (hash, doc_id or text) before it is summed by hash.
    Texts are shuffled once, to meet the positions that they lose.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    rows = docs.select(packed(docs).alias("row"), docs["doc_id"].alias("id"), F.coalesce(docs["text"], F.lit("")).alias("t"))
    rows = rows.withColumn("th", F.xxhash64("t"))
    lines = rows.select("id", "th", F.posexplode(F.split("t", "\n")).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    lines = lines.where(F.char_length("key") >= min_chars)
    lines = scratch.put(lines.select("id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")))
    hot = lines.groupBy("h1", "h2").agg(F.count_distinct("th" if by_text else "id").alias("n")).where(F.col("n") >= min_docs).select("h1", "h2")
    hot = small(scratch.put(hot))
    lost = lines.join(hot, ["h1", "h2"], "left_semi").groupBy("id", "th").agg(F.collect_set("pos").alias("lost"))
    lost = lost.select(F.col("id").alias("lost_id"), F.col("th").alias("lost_th"), "lost")
    both = rows.join(lost, rows["id"].eqNullSafe(lost["lost_id"]) & (rows["th"] == lost["lost_th"]), "left")
    none = F.array().cast("array<int>")
    both = both.withColumn("lost", F.coalesce("lost", none))

    def rest(all_lines: Column) -> Column:
        # array_except() hashes, so that a text of many lines takes linear time
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("lost")), lambda i: F.get(all_lines, i)), "\n")

    # the lines are bound to a lambda's variable: split() runs once a text, not once a line
    kept = F.when(F.size("lost") == 0, F.col("t")).otherwise(F.get(F.transform(F.array(F.split("t", "\n")), rest), F.lit(0)))
    return with_columns(both, "row", text=kept, n_lines=F.size(F.split("t", "\n")).cast("long"), n_dropped=F.size("lost").cast("long"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AS hot FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hot) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT hot), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
