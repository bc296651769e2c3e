"""Helpers that the training-data operators share: tables, shared scratch space, size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The bytes of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: A side of at most so many rows may be broadcast; rows of the sides concerned take under 100 bytes.
BROADCAST_ROWS = 300_000
#: While a table is written, texts go to Python in small batches: buffers outside of the heap stay small on either side.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Parquet tables of one operator call in the folder that the cluster shares (spark.checkpoint.dir).

    A written table cuts the lineage: a lost executor costs the tasks that follow it only. Spark deletes
    the folder when the application ends; put(..., instead_of=old) deletes a table that is no longer read.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="weirgate-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.root = f"{root}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self._path(self.root).getFileSystem(self._hadoop()).deleteOnExit(self._path(self.root))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _hadoop(self):
        return self.spark._jsc.hadoopConfiguration()

    def put(self, df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}"
        before = {k: self.spark.conf.get(k, None) for k in ARROW}
        try:
            for k, v in ARROW.items():
                self.spark.conf.set(k, v)
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v) if v is not None else self.spark.conf.unset(k)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[len(self.paths)] = path
        out._scratch_path = path
        if instead_of is not None:
            self.drop(instead_of)
        return out

    def drop(self, df: DataFrame) -> None:
        path = self._path(df._scratch_path)
        path.getFileSystem(self._hadoop()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows. df is a written table, so the count reads footers only."""
    return F.broadcast(df) if df.count() <= rows else df


def small_bytes(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """df with a broadcast hint if its rows take at most so many bytes, about: 24 a row and column, and what strings, and arrays of numbers, hold."""
    held = [F.coalesce(F.octet_length(c) if t == "string" else F.size(c) * 16, F.lit(0)) for c, t in df.dtypes if t == "string" or t.startswith("array")]
    total = df.agg(F.coalesce(F.sum(sum(held, F.lit(24 * len(df.columns))).cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= most else df


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all else as it is. lower() has a fast way for pure ASCII, where the two are the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def with_columns(df: DataFrame, row: str, **values: Column) -> DataFrame:
    """The fields of the struct column row, then the given columns, which replace fields of the same name."""
    fields = [x for x in df.schema[row].dataType.names if x.lower() not in {k.lower() for k in values}]
    return df.select(*[F.col(row)[x].alias(x) for x in fields], *[v.alias(k) for k, v in values.items()])


def packed(df: DataFrame) -> Column:
    """All columns as one struct, so that no name of ours can clash with one of theirs."""
    return F.struct(*[df[f"`{c}`"].alias(c) for c in df.columns])
