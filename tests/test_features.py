"""Deep pages, geography of both families, scope, history, attack rows, delays."""

import ipaddress
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weirgate.operators import alerting, enrich, stats

NOW = datetime(2026, 1, 10, 12)


def test_deep_pages_against_a_sort(spark):
    """Ties of one microsecond, rows without a time, pages over borders of days, offsets past the end."""
    rng = random.Random(7)
    rows = [(f"{rng.randrange(16**8):08x}", NOW - timedelta(seconds=rng.randrange(400_000))) for _ in range(700)]
    rows += [(f"{rng.randrange(16**8):08x}", NOW - timedelta(seconds=5)) for _ in range(400)] + [(f"{rng.randrange(16**8):08x}", None) for _ in range(150)]
    rows += [(f"{rng.randrange(16**8):08x}", NOW - timedelta(days=1, microseconds=rng.randrange(3000))) for _ in range(200)]
    df = spark.createDataFrame(rows, "event_id string, detected_at timestamp").repartition(3)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or NOW).timestamp(), r[0]))
    for limit, offset in ((20, 0), (20, 130), (50, 390), (300, 600), (100, len(rows) - 160), (30, len(rows) - 10), (10, len(rows) + 5)):
        got = [r.event_id for r in stats.history_page(df, limit, offset, most=40).collect()]
        assert got == [r[0] for r in want[offset : offset + limit]], (limit, offset)
    plan = stats.history_page(df, 20, 700, most=40)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan


@pytest.mark.parametrize("seed", range(2))
def test_geography_by_longest_prefix(spark, seed):
    rng = random.Random(seed)
    base = [int(ipaddress.ip_address(x)) for x in ("2001:4860::", "2606:4700::", "2a00::", "2400::ffff:0:0:0")]
    nets = []
    for i in range(60):
        bits = rng.choice([0, 3, 8, 32, 47, 48, 63, 64, 65, 96, 127, 128])
        at = rng.choice(base) | (rng.getrandbits(128) & rng.choice([0xFFFF, 0xFFFF << 60, 0xF << 90]))
        nets.append((ipaddress.ip_network((at, bits), strict=False), f"c{i:02d}"))
    ips = [str(ipaddress.ip_address(rng.choice(base) | (rng.getrandbits(128) & rng.choice([0xFFFF, 0xFFFF << 60, 0xF << 90])))) for _ in range(150)]
    ips += [str(n[0]) for n, _ in nets] + ["2001:4860:0:0:0:0:0:1", "fe80::1", "8.8.8.8", "nonsense", None]
    six = spark.createDataFrame([(f" {n}", "X", "x", c) for n, c in nets] + [("2001::/129", "X", "x", "bad"), (None, "X", "x", "bad"), ("8.8.8.0/24", "X", "x", "bad")], "network string, country_iso string, country string, city string")
    four = spark.createDataFrame([(134744064, 134744319, "US", "u", "four")], "start_ip long, end_ip long, country_iso string, country string, city string")
    got = {r.src_ip: r.geo and r.geo.city for r in enrich.geo_enrich(spark.createDataFrame([(i,) for i in ips], "src_ip string"), four, six).collect()}
    for ip in ips:
        want = None
        if ip == "8.8.8.8":
            want = "four"
        elif ip and ":" in ip and ipaddress.ip_address(ip).is_global:
            held = [(-n.prefixlen, c) for n, c in nets if ipaddress.ip_address(ip) in n]
            want = min(held)[1] if held else None
        assert got[ip] == want, ip
    assert sum(v is not None for v in got.values()) > 50


def test_scope_lists(spark):
    none = spark.createDataFrame([], "target string, target_type string, enabled boolean, note string, created_at timestamp")
    seeded = enrich.seeded_scope(none, "shop.local, Blog.local,shop-app,,shop.local")
    assert sorted((r.target, r.target_type, r.enabled, r.note) for r in seeded.collect()) == [("blog.local", "domain", True, "seeded"), ("shop-app", "app", True, "seeded"), ("shop.local", "domain", True, "seeded")]
    assert enrich.seeded_scope(seeded, "other.local").count() == 3
    assert [r.target for r in enrich.allowlist_list(seeded, q="SHOP").collect()] == ["shop-app", "shop.local"]
    assert [r.target for r in enrich.allowlist_list(seeded, q="seed", target_type="app", enabled=True).collect()] == ["shop-app"]
    assert enrich.allowlist_list(seeded, enabled=False).count() == 0


def test_without_a_table_of_alerts(spark):
    r = stats.alert_kpi(None, NOW, 24, spark).first()
    assert tuple(r) == (None, None, None)
    assert [tuple(r) for r in stats.alert_trend(None, NOW, 24, spark).orderBy("bucket").collect()] == [(i, 0) for i in range(24)]


def test_histogram_and_recent_alerts(spark):
    rows = [(f"e{i}", NOW - timedelta(minutes=m), "d") for i, m in enumerate((0, 1, 30, 31, 1439, 1440, 1441))]
    df = spark.createDataFrame(rows, "event_id string, detected_at timestamp, domain string")
    got = {r.bucket: r.n for r in stats.history_histogram(df, NOW).collect()}
    assert len(got) == 48 and {b: n for b, n in got.items() if n} == {0: 2, 46: 1, 47: 2}
    first = stats.history_histogram(df, NOW, 1).orderBy("bucket").first()
    assert (first.bucket_start, first.minutes) == (NOW - timedelta(hours=1), 2) and stats.history_histogram(df, NOW, 1).count() == 30
    alerts = df.withColumnRenamed("detected_at", "triggered_at")
    assert [(r.event_id, r.total) for r in stats.recent_alerts(alerts, 2).collect()] == [("e0", 7), ("e1", 7)]
    assert stats.recent_alerts(alerts, 0).count() == 1 and stats.recent_alerts(alerts, 9, "x").count() == 0


def test_attack_rows(spark):
    long = "x" * 700
    rows = [("1", long, long, " 12 ", "7"), ("2", None, "", "12.5", "-3"), ("3", "v", None, None, "x"), ("4", "", "ua", "99999999999", "+8")]
    got = {r.event_id: r for r in alerting.attack_rows(spark.createDataFrame(rows, "event_id string, matched_value string, user_agent string, status string, score string")).collect()}
    assert [(len(r.matched_value), r.user_agent and len(r.user_agent), r.status, r.score) for _, r in sorted(got.items())] == [(500, 500, 12, 7), (0, None, None, -3), (1, None, None, None), (0, 2, None, 8)]
    assert tuple(got["1"].asDict()) == alerting.ATTACK_COLUMNS
    typed = alerting.attack_rows(spark.createDataFrame([("1", 200, 12.9)], "event_id string, status int, score double")).first()
    assert (typed.status, typed.score, typed.matched_value) == (200, 12, "")


def test_delay_of_rows_and_of_a_stream(spark, tmp_path):
    from weirgate.streaming import replay

    rows = [(NOW, 100), (NOW + timedelta(seconds=1), 2500), (NOW + timedelta(seconds=9), -50), (NOW, None)]
    df = spark.createDataFrame(rows, "ts timestamp, ms long").withColumn("seen_at", F.timestamp_millis(F.unix_millis("ts") + F.col("ms")))
    r = stats.detection_delay(df).first()
    assert (r.n, r.latest_ms, r.average_ms, r.max_ms) == (3, 0, 2600 / 3, 2500)
    assert tuple(stats.detection_delay(df.limit(0)).first()) == (0, None, None, None)
    whole = df.where("ms IS NOT NULL")
    stream = replay.observed_delay(replay.source(spark, replay.arrival_files(whole, "ts", 1), whole.schema))
    q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    seen = [p["observedMetrics"]["detection_delay"] for p in (json.loads(p.json) for p in q.recentProgress) if p["observedMetrics"]]
    assert seen and (seen[0]["n"], seen[0]["max_ms"], seen[0]["latest_ms"]) == (3, 2500, 0)


def test_counts_that_merge(spark):
    """Rollups of two days, numbered one after the other, against counts over the rows."""
    from weirgate.operators import rollup

    rng = random.Random(5)
    rows = [(f"10.0.{rng.randrange(40)}.{rng.randrange(20)}", rng.choice(["a", "b", None]), rng.choice(["R1", "R2", "R3"]), NOW - timedelta(minutes=rng.randrange(4500))) for _ in range(3000)]
    rows += [(None, "a", "R1", NOW - timedelta(hours=1)), ("9.9.9.9", "c", "R4", None)]
    df = spark.createDataFrame(rows, "src_ip string, domain string, rule_id string, detected_at timestamp")
    parts = [df.where(F.col("detected_at") < NOW - timedelta(days=1)), df.where((F.col("detected_at") >= NOW - timedelta(days=1)) | F.col("detected_at").isNull())]
    tables, rolled = {}, None
    for part in parts:
        tables = {c: rollup.numbered(part, c, tables.get(c)).cache() for c in ("src_ip", "domain", "rule_id")}
        one = rollup.attack_rollup(part, tables)
        rolled = one if rolled is None else rolled.unionByName(one)
    n, least, most = tables["src_ip"].agg(F.count_distinct("number"), F.min("number"), F.max("number")).first()
    assert (least, most) == (0, n - 1) and n == tables["src_ip"].count() == len({r[0] for r in rows} - {None})
    names = ["attacks", "previous_attacks", "ips", "previous_ips", "attacks_pct", "ips_pct"]
    for hours in (24, 48):
        assert rollup.kpi_from_rollup(rolled, NOW, hours).select(*names).first() == stats.kpi_window(df, NOW, hours).select(*names).first()
        got, want = (sorted(map(tuple, x.select("bucket", "attacks", "ips", "domains", "rules").collect())) for x in (rollup.trend_from_rollup(rolled, NOW, hours), stats.attack_trend(df, NOW, hours)))
        assert got == want
    with pytest.raises(ValueError):
        rollup.kpi_from_rollup(rolled, NOW + timedelta(minutes=5))
    none = rollup.attack_rollup(df.limit(0), {"src_ip": rollup.numbered(df.limit(0), "src_ip")})
    assert tuple(rollup.kpi_from_rollup(none, NOW).select(*names).first()) == (0, 0, 0, 0, None, None)
