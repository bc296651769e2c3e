"""The corpus pipeline: five stages over documents, each written as Parquet and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.llm.common import Scratch, small, table
from weirgate.llm.decontamination import mark_contamination
from weirgate.llm.jaccard_join import near_duplicates
from weirgate.llm.line_dedup import dedup_lines
from weirgate.llm.mixing import mix_sources
from weirgate.llm.toxicity import learn_from_tables, score_toxicity

#: Documents are rejected from this score on.
TOXIC = 0.5


def _held(docs: DataFrame, *columns: str) -> DataFrame:
    """The given columns, and all of them as one struct, so that an operator's columns don't clash with the documents'."""
    return docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("document"), *columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under TOXIC. The model learns from the labelled rows of the documents table, op10's fold of them."""
    model = learn_from_tables(spark, table(spark, sf_dir, "documents"), sf_dir)
    return score_toxicity(_held(docs, "text"), model).where(F.col("score") < TOXIC).select("document.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their frequent lines, n_chars to match. All rows stay, and null texts stay null. Lines count by distinct texts:
    exact copies are left whole for the Jaccard join, which keeps one of them."""
    found = dedup_lines(_held(docs, "doc_id", "text"), by_text=True)
    text = F.when(F.col("document")["text"].isNotNull(), F.col("text"))
    changed = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return found.select(*[changed.get(c, F.col("document")[c]).alias(c) for c in docs.columns])


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row with the least doc_id; of rows that are equal in doc_id and text, or of one component and
    doc_id, the one whose text and then content has the least hash. Texts that share a doc_id are documents of their own: where nothing
    links them, all stay. Documents without shingles or doc_id are no duplicates of anything else, and stay."""
    scratch = Scratch(spark, "pipeline-jaccard")
    times = scratch.put(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1").select(F.col("doc_id").alias("repeated")))
    # a row of a repeated doc_id is known by a hash of doc_id and text instead
    own = F.xxhash64("document.doc_id", "document.text").bitwiseAND(F.lit(2**63 - 1).cast("long"))
    marked = _held(docs).join(small(times), F.col("document.doc_id") == F.col("repeated"), "left")
    marked = marked.select("document", F.when(F.col("repeated").isNotNull(), own).otherwise(F.col("document.doc_id")).alias("sid"), F.col("repeated").isNotNull().alias("again"))
    found = near_duplicates(marked.select(F.col("sid").alias("doc_id"), F.col("document.text").alias("text"))).where("doc_id IS NOT NULL")
    found = scratch.put(found.select(F.col("doc_id").alias("sid"), F.col("component_id").alias("part")).distinct())
    names = scratch.put(marked.where("again").select("sid", F.col("document.doc_id").alias("named")).distinct())
    named = found.join(small(names), "sid", "left").select("sid", "part", F.coalesce("named", "sid").alias("doc_id"))
    kept = named.groupBy("part").agg(F.min(F.struct("doc_id", "sid")).alias("least")).select("part", F.col("least.sid").alias("kept"))
    gone = small(scratch.put(named.join(kept, "part").where("sid <> kept").select("sid")))
    left = marked.join(gone, "sid", "left_anti")
    firsts = left.where("again").groupBy("sid").agg(F.min_by("document", F.xxhash64("document")).alias("document"))
    return left.where("NOT again").select("document.*").unionByName(firsts.select("document.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = mark_contamination(_held(docs, "doc_id", "text"), table(spark, sf_dir, "benchmark")).where("NOT contaminated")
    return found.select("document.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents' columns and size, source_size, target, nth, epoch, finish, words, a row for each time that a document is taken."""
    return mix_sources(docs).where("words > 0")


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("n-gram Jaccard join", jaccard_join), ("benchmark decontamination", decontamination), ("mixing", mixing)]

#: SQL can't express the factorization machine's fit.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir))
    return docs
