"""Access logs, service logs, pipeline definitions and evaluation inputs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.net import canonical_ip
from .tail import AccessLogTail


def scan_access_logs(spark: SparkSession, root: str, domain_override: str = "", offsets: bool = True) -> DataFrame:
    """line, log_path, line_offset, log_source, domain of <root>/{nginx,apache}/*access.log; rotated files have other names and are left out.

    log_source is the folder. domain is the override, else the file's name without .access.log, else without .log. line_offset is the
    line's place in its file, in bytes: equal lines differ in it, and it is the same however the file is split and however often it is
    read. It takes a second pass that only adds up lengths; without offsets it is left out.
    """
    read = spark.read.text(f"{root}/{{nginx,apache}}/*access.log", lineSep="\n")
    lines = read.select(F.col("value").alias("line"), F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("log_path"), F.col("_metadata.file_block_start").alias("block"))
    if offsets:
        lines = with_offsets(lines)
    return _named(lines.drop("block").withColumn("line", F.rtrim("line", F.lit("\r"))), domain_override)


def with_offsets(lines: DataFrame) -> DataFrame:
    """lines (line, log_path, block: where the split begins, in the order of reading) and line_offset.

    The lines of all splits tile their file, so a split's first line lies behind what all splits before it have read: their lengths are
    summed by split, which are few rows, and by file. Within a split, lengths add up as its task reads; lines aren't shuffled.
    """
    sizes = lines.groupBy("log_path", "block").agg(F.sum(F.octet_length("line") + 1).cast("long").alias("size"))
    before = F.sum("size").over(Window.partitionBy("log_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("log_path").alias("b_path"), F.col("block").alias("b_block"), F.coalesce(before, F.lit(0)).alias("before"))
    placed = lines.select("line", "log_path", "block").mapInArrow(_places, "line string, log_path string, block long, place long")
    sizes = F.broadcast(sizes) if sizes.limit(200_001).count() <= 200_000 else sizes  # a row a split
    found = placed.join(sizes, (F.col("log_path") == F.col("b_path")) & (F.col("block") == F.col("b_block")))
    return found.withColumn("line_offset", F.col("before") + F.col("place")).drop("b_path", "b_block", "before", "place")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds place: bytes of the split's lines before this one. A task reads one split after the other."""
    split, read = None, 0
    for rows in batches:
        if not rows.num_rows:
            continue
        paths = rows.column("log_path").dictionary_encode()
        name, block = np.asarray(paths.indices), np.asarray(rows.column("block"))
        size = np.asarray(pc.binary_length(rows.column("line"))).astype(np.int64) + 1
        place = np.cumsum(size) - size
        begins = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (block[1:] != block[:-1])]))
        own = (paths.dictionary[int(name[0])].as_py(), int(block[0]))
        start = place[begins].copy()
        start[0] -= read if own == split else 0
        place = place - np.repeat(start, np.diff(np.append(begins, len(name))))
        split, read = (paths.dictionary[int(name[-1])].as_py(), int(block[-1])), int(place[-1] + size[-1])
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(place, pa.int64())], ["line", "log_path", "block", "place"])


def stream_access_logs(spark: SparkSession, root: str, domain_override: str = "", read_existing: bool = False) -> DataFrame:
    """The same, of lines as they are appended: growing, rotated and truncated files, as AccessLogTail says."""
    spark.dataSource.register(AccessLogTail)
    return _named(spark.readStream.format("access_log_tail").option("readExisting", str(read_existing).lower()).load(root), domain_override)


def stream_closed_logs(spark: SparkSession, root: str, domain_override: str = "") -> DataFrame:
    """The same, without offsets, of files of any store as they are closed or rotated in: Spark's file source reads each file once."""
    lines = spark.readStream.schema("value string").text(f"{root}/{{nginx,apache}}/*").select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("log_path"))
    return _named(lines, domain_override)


def _named(lines: DataFrame, override: str) -> DataFrame:
    name = F.regexp_extract("log_path", r"([^/]+)$", 1)
    plain = F.nullif(F.regexp_extract(name, r"^(.*?)(?:\.access)?\.log(?:\.\d+)?$", 1), F.lit(""))
    return lines.where("line <> ''").withColumns({"log_source": F.regexp_extract("log_path", r"([^/]+)/[^/]+$", 1), "domain": F.coalesce(F.nullif(F.lit(override), F.lit("")), plain, name)})


def raw_events(lines: DataFrame, collected_at: Column | None = None, address: Callable[[Column], Column] = canonical_ip) -> DataFrame:
    """lines and src_ip (first field in canonical form, if it is an address), key, request_id and collected_at (a given time, else now).

    request_id follows from the file, the line's place in it and the line: equal lines of one file have ids of their own, and a
    line has the same id from a scan, a stream and a replay of either. A file that took a rotated one's place differs by its lines.
    address: what the first field is as an address, or null; a source whose clients are named otherwise gives its own.
    """
    first = F.regexp_extract("line", r"^(\S+)", 1)
    ip = address(first)
    place = [F.col(c).cast("string") for c in ("log_path", "line_offset", "line_no") if c in lines.columns]
    x = lines.withColumn("src_ip", ip)
    key = F.when(F.col("src_ip").isNull(), F.lower("domain")).otherwise(F.concat_ws("|", F.lower("domain"), "src_ip"))
    return x.withColumns({"key": key, "request_id": F.md5(F.concat_ws("|", *place, "line")), "collected_at": F.current_timestamp() if collected_at is None else collected_at})


def service_logs(lines: DataFrame) -> DataFrame:
    """ts, level, service, msg of one-line JSON logs (column value); lines that aren't such are left out."""
    x = lines.select(F.from_json("value", "ts string, level string, service string, msg string").alias("j")).select("j.*")
    return x.where("service IS NOT NULL").withColumn("ts", F.try_to_timestamp("ts"))


def crs_flags(lines: DataFrame) -> DataFrame:
    """request_id, flagged, score, rule_ids of JSON audit logs (column value): flagged if rule 949110 is among the messages."""
    message = "struct<message:string,details:struct<ruleId:string,data:string>>"
    x = lines.select(F.from_json("value", f"transaction struct<request:struct<headers:map<string,string>>,messages:array<{message}>>").alias("j")).select("j.transaction.*")
    header = F.element_at(F.map_values(F.map_filter("request.headers", lambda k, _: F.lower(k) == "x-req-id")), 1)
    x = x.withColumn("request_id", F.when(F.exists(F.map_keys("request.headers"), lambda k: F.lower(k) == "x-req-id"), header)).where("request_id IS NOT NULL")
    messages = F.coalesce("messages", F.array().cast(f"array<{message}>"))
    totals = F.transform(messages, lambda m: F.regexp_extract(F.concat_ws(" ", m["message"], m["details"]["data"]), r"Total Score: (\d+)", 1).try_cast("int"))
    return x.select("request_id", F.exists(messages, lambda m: m["details"]["ruleId"] == "949110").alias("flagged"), F.coalesce(F.array_max(totals), F.lit(0)).alias("score"), F.array_distinct(F.transform(messages, lambda m: m["details"]["ruleId"])).alias("rule_ids"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def pipelines(spark: SparkSession, path: str) -> DataFrame:
    """pipeline, domain, stages of small `key: value` YAML files with a list of stages; a name falls back to the file's, a domain to the pipeline's name.

    Files without stages are passed over.
    """
    text = spark.read.text(path, wholetext=True).select("value", F.regexp_extract("_metadata.file_path", r"([^/]+)\.ya?ml$", 1).alias("stem"))
    field = lambda n: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{n}:[ \t]*[\"']?([^\"'#\n]*)", 1)), F.lit(""))
    stages = F.transform(F.regexp_extract_all(F.regexp_extract("value", r"(?m)^stages:[ \t]*\n((?:[ \t]*-[^\n]*\n?)+)", 1), F.lit(r"-[ \t]*(?:name:[ \t]*)?([^\n]+)"), F.lit(1)), lambda s: F.trim(s))
    x = text.withColumn("pipeline", F.coalesce(field("pipeline"), field("name"), "stem"))
    return x.select("pipeline", F.coalesce(field("domain"), "pipeline").alias("domain"), stages.alias("stages")).where(F.size("stages") > 0)
