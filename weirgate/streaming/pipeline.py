"""Streams: the batch operators per micro-batch, keyed window state in arrival order, tables with a ledger."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from ..config import DetectorConfig
from ..functions.net import client_key
from ..operators.alerting import upsert_once
from ..operators.detect import STATIC_ASSET
from ..sources.rules import SCHEMA, active_rules
from ..sources.shared import hadoop_path

OUT = "seq long, request_id string, client string, ts_ms long, requests long, errors long, distinct_paths long, late boolean, score int, alert boolean, suppressed boolean"
FLOOD_OUT = "seq long, request_id string, domain string, ts_s long, requests long, unique_ips long"
#: State that is held in cells needs this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: No time yet, or none at all.
NEVER = -(2**62)
#: Keys share a group of the state store by their hash, so that the groups of a batch are so many at most, however many keys it has.
BUCKETS = 1024
#: Rows that are turned to or from values of Python at once.
CHUNK = 10_000
COLUMNS = ("key", "seq", "request_id", "time", "flag", "value", "points")
HELD = "latest long, last_alert long, times array<long>, n array<long>, flagged array<long>, values array<string>, seen array<long>"


class _Cells:
    """One key's window: how many rows, and how many with a flag, each time has, and the latest time of each value. What enters or leaves costs
    a heap's step."""

    def __init__(self, cells: dict[int, tuple[int, int]], values: dict[str, int]):
        self.cells, self.values = cells, values
        self.times = list(cells)
        self.last = [(t, v) for v, t in values.items()]
        heapq.heapify(self.times)
        heapq.heapify(self.last)
        self.rows, self.flagged = (sum(x[i] for x in cells.values()) for i in (0, 1))

    def add(self, time: int, flag: bool, value: str | None) -> None:
        if time not in self.cells:
            heapq.heappush(self.times, time)
        n, flagged = self.cells.get(time, (0, 0))
        self.cells[time] = n + 1, flagged + flag
        self.rows, self.flagged = self.rows + 1, self.flagged + flag
        if value is not None and time > self.values.get(value, NEVER):
            self.values[value] = time
            heapq.heappush(self.last, (time, value))

    def drop(self, until: int) -> None:
        while self.times and self.times[0] <= until:
            time = heapq.heappop(self.times)
            n, flagged = self.cells.pop(time)
            self.rows, self.flagged = self.rows - n, self.flagged - flagged
        while self.last and self.last[0][0] <= until:
            time, value = heapq.heappop(self.last)
            if self.values.get(value) == time:
                del self.values[value]


class _Windowed(StatefulProcessor):
    """Keeps the windows of a bucket of keys as state: a key's entry has its latest time, the second of its last alert, its cells by time and its
    values by their latest time. An entry grows with the window's distinct times and values, not with its rows. It is read once and written
    once a batch, and rows come and go by the bucket, as each call of the store and each group has its price."""

    width: int

    def __init__(self, cfg: DetectorConfig, ttl_ms: int | None):
        self.cfg, self.ttl_ms = cfg, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "key string", HELD, self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        names = pd.factorize(batch["key"], use_na_sentinel=False)[0]
        batch = batch.iloc[np.lexsort((batch["seq"], names))]
        out = []
        for name, of_key in groupby(_tuples(batch), itemgetter(0)):
            out += self._of_key(name, of_key)
            while len(out) >= CHUNK:
                yield self._frame(out[:CHUNK])
                del out[:CHUNK]
        yield self._frame(out)

    def _of_key(self, name: str | None, rows: Iterator[tuple]) -> Iterator[tuple]:
        """What a key's rows give, in their order; the state is as they leave it."""
        latest, last_alert, times, n, flagged, values, seen = self.held.getValue((name,)) or (NEVER, NEVER, (), (), (), (), ())
        held = _Cells(dict(zip(times, zip(n, flagged, strict=True), strict=True)), dict(zip(values, seen, strict=True)))
        for _, seq, request_id, time, flag, value, points in rows:
            late = time <= latest - self.width if time > NEVER else None
            if late is False:
                held.add(time, flag, value)
                latest = max(latest, time)
                held.drop(latest - self.width)
            row, last_alert = self.judged((seq, request_id, name, time if time > NEVER else None), points, held, late, last_alert)
            if row:
                yield row
        counts = held.cells.values()
        self.held.updateValue((name,), (latest, last_alert, [*held.cells], [c[0] for c in counts], [c[1] for c in counts], [*held.values], [*held.values.values()]))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in self.out.split(", ")], dtype=object)

    def close(self) -> None:
        pass


def _tuples(batch: pd.DataFrame) -> Iterator[tuple]:
    """The rows, as values of Python; texts that are null are None."""
    for i in range(0, len(batch), CHUNK):
        x = batch.iloc[i : i + CHUNK]
        yield from zip(*(x[c].astype(object).where(x[c].notna(), None).tolist() if c in ("key", "request_id", "value") else x[c].tolist() for c in COLUMNS), strict=True)


class _ClientWindow(_Windowed):
    out = OUT

    @property
    def width(self) -> int:
        return self.cfg.window_ms

    def judged(self, row: tuple, points: int, held: _Cells, late: bool | None, last_alert: int) -> tuple[tuple | None, int]:
        cfg, time, n, errors, paths = self.cfg, row[-1], held.rows, held.flagged, len(held.values)
        score = points + cfg.burst_points * (n >= cfg.burst_requests) + cfg.flood_points * (n >= cfg.flood_requests) + cfg.error_points * (errors >= cfg.error_count) + cfg.path_points * (paths >= cfg.path_count)
        alert = score >= cfg.alert_score
        suppressed = alert and (time is None or time // 1000 - last_alert < cfg.alert_cooldown_s)
        return (*row, n, errors, paths, late, min(score, 100), alert, suppressed), time // 1000 if alert and not suppressed else last_alert


class _DomainFlood(_Windowed):
    out = FLOOD_OUT

    @property
    def width(self) -> int:
        return self.cfg.ddos_window_s

    def judged(self, row: tuple, points: int, held: _Cells, late: bool | None, last_alert: int) -> tuple[tuple | None, int]:
        cfg = self.cfg
        if late is not False or held.rows < cfg.ddos_requests or len(held.values) < cfg.ddos_ips or row[-1] - last_alert < cfg.ddos_cooldown_s:
            return None, last_alert
        return (*row, held.rows, len(held.values)), row[-1]


def _stateful(rows: DataFrame, processor: _Windowed) -> DataFrame:
    """What the processor makes of rows (key, seq, request_id, time, flag, value, points). They are grouped by BUCKETS of keys."""
    rows.sparkSession.conf.set(*STORE)
    known = rows.withColumns({"bucket": F.pmod(F.xxhash64("key"), F.lit(BUCKETS)), "time": F.coalesce("time", F.lit(NEVER))})
    return known.groupBy("bucket").transformWithStateInPandas(processor, processor.out, "append", "ProcessingTime" if processor.ttl_ms else "None")


def once_by_id(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of events (event_id, ts) without replays that come within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def counts_per(events: DataFrame, keys: list[str], period: str, delay: str = "10 minutes") -> DataFrame:
    """keys, period_start, n of each tumbling period, once the watermark has passed it."""
    counted = events.withWatermark("ts", delay).groupBy(*keys, F.window("ts", period).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(*keys, F.col("w.start").alias("period_start"), "n")


def windowed_requests(requests: DataFrame, cfg: DetectorConfig = DetectorConfig(), forget_idle: bool = True) -> DataFrame:
    """The client window of each request of a stream (domain, src_ip, path, status, ts_ms, seq, request_id, and rule_points if there are any),
    in order of arrival; score, whether it calls for an alert, and whether the client's cooldown suppresses that. The same rows as
    client_window(arrival=True) and what follows from it give.

    Arrival is seq within a micro-batch, and one batch after the other: a source owes that rows of a later batch come later. Spark's file
    source hands out files by their times of modification, so files are to be written one after the other. A batch's requests of one client are
    ordered in one task, so the source's limit for a batch (maxFilesPerTrigger, maxOffsetsPerTrigger) bounds its memory.

    A request that is a window or more behind its client's latest is late: it is scored by the window, but doesn't enter it. State is cells, in
    RocksDB, which the session is set to. With forget_idle they go when the client has been idle for two windows of the clock on the
    wall; replays, which run through past time, keep them.
    """
    counted = ~F.coalesce(F.col("path").rlike(STATIC_ASSET), F.lit(False))
    points = F.coalesce("rule_points", F.lit(0)) if "rule_points" in requests.columns else F.lit(0)
    x = requests.select("seq", "request_id", client_key(F.col("domain"), F.col("src_ip")).alias("key"), F.col("ts_ms").alias("time"), (counted & (F.coalesce("status", F.lit(0)) >= 400)).alias("flag"), F.when(counted, F.col("path")).alias("value"), points.alias("points"))
    return _stateful(x, _ClientWindow(cfg, 2 * cfg.window_ms if forget_idle else None))


def flood_alerts(requests: DataFrame, cfg: DetectorConfig = DetectorConfig(), forget_idle: bool = True) -> DataFrame:
    """The requests of a stream, by domain in any case and in arrival order, at which a flood from many addresses calls for an alert and the
    domain's cooldown is over. Requests a window or more behind their domain's latest are left out. Order and state as in windowed_requests()."""
    x = requests.select("seq", "request_id", F.lower("domain").alias("key"), F.floor(F.col("ts_ms") / 1000).alias("time"), F.lit(False).alias("flag"), F.col("src_ip").alias("value"), F.lit(0).alias("points"))
    return _stateful(x, _DomainFlood(cfg, 2000 * cfg.ddos_window_s if forget_idle else None))


def with_current_rules(snapshots: Callable[[SparkSession], DataFrame], then: Callable[[DataFrame, DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that calls then(batch, rules, batch_id) with the rules of the last valid snapshot (version, rules) at each
    batch's start. snapshots reads them anew; rules are collected again only if there is a new version, and a batch fails as long as there is none."""
    held: dict = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = snapshots(spark)
        version = found.agg(F.max("version")).first()[0]
        if version is not None and version != held.get("version"):
            held["version"], held["rules"] = version, active_rules(found).collect() or held.get("rules")  # a catalogue of a few dozen rows
        if not held.get("rules"):
            raise ValueError("there is no valid rule snapshot yet")
        then(batch, spark.createDataFrame(held["rules"], SCHEMA), batch_id)

    return write


def into_table(path: str, key: str = "event_id", by: str | None = None, writer: str = "stream") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds to the table at path the rows whose key it doesn't have. read_table() reads the table.

    A batch is a folder of its own, and a line in the ledger once it is whole. A batch that is run again is known by the ledger, without reading
    any data; one that broke off before its line replaces its folder. by: a column with few values a batch, such as a date, that
    follows from the row. Folders are partitioned by it, and a batch is compared with the parts of its own values (null is one) only;
    without it, with the whole table. writer: name of the stream, of which each has its own batch numbers.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, f"{writer}-{batch_id}"
        store, line = hadoop_path(spark, f"{path}/_ledger/{name}.json")
        if store.exists(line):
            return
        known, folder = read_table(spark, path, batch.schema), f"{path}/batch={name}"
        try:
            if known is not None and by:
                batch.persist()  # it is read twice, and its stream's state would be gone through twice
                values = [r[0] for r in batch.select(by).distinct().collect()]
                known = known.where(F.col(by).isin([v for v in values if v is not None]) | (F.col(by).isNull() if None in values else F.lit(False)))
            new = upsert_once(batch, known, key).write.mode("overwrite")
            (new.partitionBy(by) if by else new).parquet(folder)
        finally:
            batch.unpersist()
        _enter(spark, path, name, folder)

    return write


def _enter(spark: SparkSession, path: str, name: str, folder: str) -> None:
    """Puts a batch with its files into the ledger, by a rename: the line is whole or isn't there."""
    store, at = hadoop_path(spark, folder)
    files, found = [], store.listFiles(at, True)
    while found.hasNext():
        x = found.next().getPath()
        if not x.getName().startswith("_"):
            files.append(x.toString())
    _, draft = hadoop_path(spark, f"{path}/_ledger/.{name}")
    _, line = hadoop_path(spark, f"{path}/_ledger/{name}.json")
    out = store.create(draft, True)
    out.write(bytearray(json.dumps({"batch": name, "files": sorted(files)}).encode()))
    out.close()
    store.rename(draft, line)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """batch, files of the table at path."""
    return spark.read.schema("batch string, files array<string>").json(f"{path}/_ledger/*.json")


def read_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame | None:
    """The rows of the batches that the ledger names; None as long as there are none."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    store, lines = hadoop_path(spark, f"{path}/_ledger/*.json")
    if not store.globStatus(lines):
        return None
    whole = ledger(spark, path).select(F.col("batch").alias("_whole"))
    whole = F.broadcast(whole) if whole.limit(1_000_001).count() <= 1_000_000 else whole  # names of under 100 bytes
    named = StructType([*schema.fields, StructField("batch", StringType())])  # batches may be empty, all of them too
    rows = spark.read.schema(named).option("basePath", path).parquet(f"{path}/batch=*")
    return rows.join(whole, rows["batch"] == whole["_whole"], "left_semi").drop("batch")


def split_batch(split: Callable[[DataFrame], tuple[DataFrame, DataFrame]], good: Callable[[DataFrame, int], None], bad: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for two outputs of one input, such as valid rows and dead letters; the input is computed once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for part, sink in zip(split(batch), (good, bad), strict=True):
                sink(part, batch_id)
        finally:
            batch.unpersist()

    return write
