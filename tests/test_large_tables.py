"""Queries against their SQL on tables that are shaped as large ones are: many users, many events a second, times with fractions."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from weirgate.operators import detect, enrich, stats
from weirgate.plans import views
from weirgate.sources import logs
from weirgate.streaming import replay


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """A folder with events of 4,000 users and more than 64,000 between them; many fall into the last seconds and into those around a limit of time."""
    path = tmp_path_factory.mktemp("crowded")
    duckdb.sql(f"""COPY (SELECT i AS event_id, (i * 7919) % 4001 * 17 AS user_id, ['view', 'error', 'signup', 'cart'][1 + i % 4] AS event_type,
        CASE i % 3 WHEN 0 THEN TIMESTAMP '2024-01-30 23:59:40' WHEN 1 THEN TIMESTAMP '2024-01-20 00:04:55' ELSE TIMESTAMP '2024-01-19 23:00:00' END + to_microseconds((i * 48271) % 10000019) AS ts
        FROM range(3000) t(i)) TO '{path}/events.parquet' (FORMAT parquet)""")
    return str(path)


def same_rows(spark, name, folder):
    """Asserts that a query gives the rows of its SQL."""
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = db.sql(registered.oracle_sql()[name])
    rows = registered.queries()[name](spark, folder).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want.fetchall()))
    return rows


def test_a_page_behind_a_million_rows(spark):
    n = 1_050_100
    rows = spark.range(n).select(F.lpad(F.col("id").cast("string"), 8, "0").alias("event_id"), F.timestamp_seconds(2_000_000_000 - F.col("id")).alias("detected_at"))
    assert [int(r.event_id) for r in stats.history_page(rows, 3, 1_050_000).collect()] == [1_050_000, 1_050_001, 1_050_002]


def test_the_future_begins_at_a_microsecond(spark, crowded):
    """Half a second past the limit is past it."""
    same_rows(spark, "map_enriched", crowded)
    same_rows(spark, "map_rejected", crowded)
    same_rows(spark, "map_flat", crowded)
    times = spark.sql("SELECT 'x' AS event_id, 'd' AS domain, '1.1.1.1' AS src_ip, 'GET' AS method, '/' AS path, '' AS query_string, '' AS user_agent, '' AS referer, 200 AS status, timestamp'2024-01-20 00:05:00' + make_interval(0, 0, 0, 0, 0, 0, id * 0.000001) AS timestamp, CAST(NULL AS timestamp) AS request_ts FROM range(2)")
    good, bad = enrich.map_enriched(times, F.lit(views.NOW))
    assert (good.count(), [r.error for r in bad.collect()]) == (1, ["timestamp in the future"])


def test_addresses_that_count_users(spark, crowded):
    assert any(r.key.split("|10.0.")[-1] > "256" for r in same_rows(spark, "raw_event_keys", crowded))
    lines = spark.createDataFrame([("10.0.256.1 - -", "A"), ("1.2.3 - -", "A"), ("2001:DB8::1 -", "A")], "line string, domain string")
    assert [r.key for r in logs.raw_events(lines).collect()] == ["a", "a", "a|2001:db8::1"]
    assert [r.key for r in logs.raw_events(lines, address=views.client_text).collect()] == ["a|10.0.256.1", "a", "a|2001:db8::1"]


def test_lines_of_many_users(spark, crowded):
    same_rows(spark, "raw_event_ids", crowded)


def test_feed_by_the_nearest_second(spark, crowded):
    same_rows(spark, "recent_feed", crowded)


def test_a_hot_key_is_many_groups(spark):
    """One domain and 40 seconds, all in one slice: its rows lie in several partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(4000).select(F.col("id").alias("seq"), F.lit("d").alias("k"), F.floor(F.col("id") / 100).alias("t"), (F.col("id") % 300).cast("string").alias("v"))
        found = detect.sliding(rows, "k", "t", "seq", 10, {"n": F.lit(True)}, {"values": ("v", F.lit(True))}).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.part for r in found}) > 1
    assert all((r.n, r["values"]) == (min(r.seq + 1, 900 + r.seq % 100 + 1), min(r.seq + 1, 300)) for r in found)


def test_a_batch_of_many_rows_is_several_files(spark, monkeypatch):
    monkeypatch.setattr(replay, "FILE_ROWS", 10)
    rows, seen = spark.range(200), []
    path = replay.arrival_files(rows, "id")
    replay.run_to_end(replay.source(spark, path, rows.schema), lambda b, i: seen.append((b.agg(F.min("id"), F.max("id"), F.count("*")).first(), len(b.inputFiles()))), runs=1)
    assert len(seen) == 4 and sum(r[2] for r, _ in seen) == 200
    assert all(a[0][1] < b[0][0] for a, b in zip(seen, seen[1:], strict=False))
    assert spark.read.parquet(path).select(F.input_file_name()).distinct().count() == 20


def test_tasks_grow_in_number(spark, monkeypatch):
    """rows that are to be sorted are dealt to as many tasks as they need, whatever the shuffle's own number."""
    rows = spark.range(4000).select(F.col("id").alias("seq"), (F.col("id") % 200).cast("string").alias("k"), F.floor(F.col("id") / 100).alias("t"), (F.col("id") % 3).cast("string").alias("v"))
    window = lambda: detect.sliding(detect.latest_so_far(rows, "k", "t", "seq"), "k", "t", "seq", 10, {"n": F.lit(True)}, {"values": ("v", F.lit(True))}, "latest").withColumn("part", F.spark_partition_id()).collect()
    figures = lambda found: sorted((r.seq, r.latest, r.n, r["values"]) for r in found)
    few = window()
    monkeypatch.setattr(detect, "TASK_ROWS", 50, raising=False)
    many = window()
    sizes = Counter(r.part for r in many)
    assert len(sizes) > 40 and max(sizes.values()) < 400
    assert figures(many) == figures(few) and len(few) == 4000
