"""Cases of the operators with their expected values, and windows against a sequential model."""

import ipaddress
import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weirgate.config import DetectorConfig
from weirgate.functions.net import canonical_ip, public_ip
from weirgate.functions.regex import lint, to_java
from weirgate.functions.text import normalize_request, percent_decode, stable_event_id
from weirgate.operators import alerting, detect, evaluate, matching, parse, stats
from weirgate.sources import envelopes, logs
from weirgate.sources.rules import active_rules, default_rules, validate_rules

NGINX = '172.23.0.1 - - [16/Sep/2026:09:11:06 +0000] "GET /api/products?id=1%27%20OR%20%271%27%3D%271 HTTP/1.1" 200 15 "-" "curl/8.7.1" "shop.local" rt=0.123 sid="demo-1"'
APACHE = '172.23.0.1 - - [16/Sep/2026:09:11:06 +0000] "GET /x HTTP/1.1" 404 236 "-" "Mozilla/5.0" "blog.local" rt_us=863 sid="demo-2"'
PLAIN = '1.2.3.4 - bob [16/Sep/2026:09:11:06 +0000] "junk" - - "-" "-"'


def test_parse(spark):
    lines = spark.createDataFrame([(0, NGINX), (1, APACHE), (2, PLAIN), (3, "not a log line")], "n int, line string").withColumn("domain", F.lit("d.local"))
    good, bad = parse.parse_access_log(lines)
    a, b, c = good.orderBy("n").collect()
    assert (a.path, a.query_decoded, a.status, a.body_bytes, a.host, a.request_time, a.session_id) == ("/api/products", "id=1' OR '1'='1", 200, 15, "shop.local", 0.123, "demo-1")
    assert a.request_ts == datetime(2026, 9, 16, 9, 11, 6) and a.referer == ""
    assert b.request_time == pytest.approx(0.000863) and b.status == 404
    assert (c.method, c.path, c.status, c.body_bytes, c.host, c.request_time, c.session_id, c.remote_user) == ("", "junk", None, 0, "d.local", None, "", "bob")
    assert [r.n for r in bad.collect()] == [3]


def test_blocks(spark):
    raw = spark.createDataFrame([(0, f"{NGINX}\r\n\nbad\n{APACHE}\n"), (1, "bad\nworse")], "block_id int, raw string")
    good, rejected = parse.parse_blocks(raw)
    assert good.count() == 2 and [r.block_id for r in rejected.collect()] == [1]


def test_text(spark):
    row = spark.range(1).select(
        percent_decode(F.lit("a%2Bb+c%zz%")).alias("a"),
        percent_decode(F.lit("a+b%20c"), True).alias("b"),
        normalize_request(F.lit("%2527&amp;lt;"), True).alias("c"),
        stable_event_id(F.lit("attack.detected"), F.lit("x")).alias("d"),
        normalize_request(F.lit(None).cast("string")).alias("e"),
    ).first()
    assert (row.a, row.b, row.c, row.e) == ("a+b+c%zz%", "a b c", "'<", "")
    assert row.d[14] == "3" and row.d[19] in "89ab" and len(row.d) == 36


def test_ips(spark):
    ips = [("8.8.8.8", True), ("10.0.0.1", False), ("203.0.113.9", False), ("x", False), (None, False), ("256.1.1.1", False)]
    ips += [(x, not any(getattr(ipaddress.ip_address(x), f"is_{k}") for k in ("private", "loopback", "link_local", "reserved", "multicast", "unspecified"))) for x in V6]
    got = spark.createDataFrame(ips, "ip string, want boolean").select("ip", public_ip(F.col("ip")).alias("got"), "want", canonical_ip(F.col("ip")).alias("canonical")).collect()
    assert all(r.got == r.want for r in got)
    assert all(r.canonical == str(ipaddress.ip_address(r.ip)) for r in got if r.ip in V6)
    lines = [(f"{x} - - rest of a line", "D.local") for x in ("2001:0DB8::0001", "1.2.3.4", "1::2::3", "x")]
    keys = logs.raw_events(spark.createDataFrame(lines, "line string, domain string")).collect()
    assert [r.key for r in keys] == ["d.local|2001:db8::1", "d.local|1.2.3.4", "d.local", "d.local"]


V6 = ("::", "::1", "2001:4860:4860:0:0:0:0:8888", "FE80::1", "fc00::1", "2001:db8::1", "2002::1", "2001:20::1", "2001:3::5", "64:ff9b::8.8.8.8", "2606:4700:0:0:1:0:0:1", "2606:4700::0:1", "1:0:0:0:0:0:0:0", "2001:0:0:1:0:0:0:1", "ff02::1")


@pytest.mark.parametrize(("path", "query", "agent", "groups"), [
    ("/p", "id=1%2520UNION/**/SELECT%2520x", "", {"sql_injection"}), ("/p", "q=<svg onload=x", "", {"xss"}), ("/..%5Cx", "", "", {"path_traversal"}),
    ("/p", "", "sqlmap/1", {"scanner"}), ("/p", "a=;cat", "", {"command_injection"}), ("/p", "page=http://x", "", {"rfi"}),
    ("/p", "content=hello", "", set()), ("/item;id=42", "", "", set()), ("/p", "redirect_url=https://x", "", set()), ("/union", "select", "", set()),
    ("/p", "", "Mozilla (Android 9; SH-03K)", set()), ("/p", "condition=new&contact=1", "", set()),
])
def test_rules(spark, path, query, agent, groups):
    df = spark.createDataFrame([(path, query, agent)], "path string, query_string string, user_agent string")
    assert {r.rule_group for r in matching.rule_matches(df, default_rules(spark)).collect()} == groups


def test_rule_sample_and_lint(spark):
    df = spark.createDataFrame([("/api/users?id=1%20OR%201=1%20--",)], "sample string")
    r = matching.rule_test(default_rules(spark), df).where("rule_id = 'SQLI_BOOLEAN_TAUTOLOGY'").first()
    assert (r.field, r.matched_value.strip(), r.end) == ("query", "OR 1=1", 11)
    assert lint("(?=x)") and lint(r"(a)\1") and lint("a{2000}") and lint("(") and not lint(r"(?i)a\s*$")
    assert to_java(r"(?i)a[\s$]$") == r"(?d)(?iu)a[\t\n\f\r $]\z"
    good, bad = validate_rules(default_rules(spark).unionByName(default_rules(spark).limit(1)))
    assert good.count() == 19 and bad.count() == 2


def _requests(spark, rows):
    return spark.createDataFrame([(i, f"r{i}", t, "D.local", ip, p, s) for i, (t, ip, p, s) in enumerate(rows)], "seq long, request_id string, ts_ms long, domain string, src_ip string, path string, status int")


def test_window_against_model(spark):
    rng = random.Random(5)
    rows = sorted([(rng.randrange(400) * 1000, f"1.1.1.{rng.randrange(3)}", rng.choice(["/a", "/b", "/c", "/x.css"]), rng.choice([200, 404])) for _ in range(400)], key=lambda r: r[0])
    cfg = DetectorConfig(window_ms=5_000)
    got = {r.seq: (r.requests, r.errors, r.distinct_paths) for r in detect.client_window(_requests(spark, rows), cfg).collect()}
    for i, (t, ip, _, _) in enumerate(rows):
        near = [r for r in rows[: i + 1] if r[1] == ip and r[0] > t - 5_000]
        plain = [r for r in near if not r[2].endswith(".css")]
        assert got[i] == (len(near), sum(r[3] >= 400 for r in plain), len({r[2] for r in plain}))


def test_scores_and_cooldown(spark):
    rows = [(1000 * (i // 20), "9.9.9.9", f"/p{i}", 404) for i in range(21)]
    windowed = detect.client_window(_requests(spark, rows))
    none = matching.rule_matches(_requests(spark, rows).withColumn("query_string", F.lit("")), default_rules(spark))
    got = detect.alerts(detect.anomaly_scores(windowed, none)).orderBy("seq").collect()
    assert [(r.seq, r.suppressed) for r in got] == [(19, False), (20, True)]
    css = [(0, "9.9.9.9", "/a.css", 404)] * 26
    assert {(r.errors, r.distinct_paths) for r in detect.client_window(_requests(spark, css)).collect()} == {(0, 0)}


def test_ddos_fires_at_300(spark):
    rows = [(0, f"1.1.{i % 100}.1", "/", 200) for i in range(305)]
    assert [r.seq for r in detect.ddos_alerts(_requests(spark, rows)).collect()] == [299]


def test_cooldown_recurrence(spark):
    df = spark.createDataFrame([(i, "k", s) for i, s in enumerate([100, 159, 160, 161, 219, 220])], "seq long, k string, s long")
    assert [r.s for r in detect.with_cooldown(df, "k", "s", "seq", 60).where("fired").orderBy("s").collect()] == [100, 160, 220]
    assert detect.with_cooldown(df, "k", "s", "seq", 0).where("fired").count() == 6


def test_cooldown_over_batches(spark):
    """Keys whose seconds go over several Arrow batches, against the recurrence."""
    rng = random.Random(12)
    rows = [(i, rng.choice("ab"), 3 * rng.randrange(2000)) for i in range(3000)] + [(9000, None, 5), (9001, None, 6)]
    want, last = set(), {}
    for seq, k, s in sorted(rows, key=lambda r: (r[2], r[0])):
        if k not in last or s >= last[k] + 10:
            last[k] = s
            want.add(seq)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = {r.seq for r in detect.with_cooldown(spark.createDataFrame(rows, "seq long, k string, s long"), "k", "s", "seq", 10).where("fired").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want


def test_late_events_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(detect, "RANGE", 8)
    rng = random.Random(13)
    rows = [(rng.randrange(300) * 1000, f"1.1.1.{rng.randrange(2)}", "/", 200) for _ in range(200)]
    got = {r.seq: r.late for r in detect.late_events(_requests(spark, rows)).collect()}
    for i, (t, ip, _, _) in enumerate(rows):
        assert got[i] == (t <= max(r[0] for r in rows[: i + 1] if r[1] == ip) - 60_000)


def test_rule_snapshots(spark):
    one = ("GOOD_ID", "g", "d", True, ["url"], "x", 50, [])
    snapshots = [(1, [one]), (2, [("A", *one[1:])]), (150, [(None, *one[1:])]), (3, [one, one])]
    rule = "struct<id:string,group:string,description:string,enabled:boolean,targets:array<string>,pattern:string,score:int,normalizers:array<string>>"
    df = spark.createDataFrame(snapshots, f"version long, rules array<{rule}>")
    assert [r.id for r in active_rules(df).collect()] == ["GOOD_ID"]
    long = ("L" * 80, *one[1:])
    assert [r.id for r in active_rules(df.unionByName(spark.createDataFrame([(200, [long])], df.schema))).collect()] == ["L" * 80]


def test_parse_marks_and_odd_requests(spark):
    odd = NGINX.replace("curl", "cu\x01rl")
    lines = spark.createDataFrame([(0, odd), (1, NGINX.replace("GET ", "")), (2, "\x01" * 12 + "x"), (3, None)], "n int, line string").withColumn("domain", F.lit("d"))
    good, bad = parse.parse_access_log(lines)
    a, b = good.orderBy("n").collect()
    assert a.user_agent == "cu\x01rl/8.7.1" and a.path == "/api/products" and (b.method, b.protocol) == ("", "") and b.path.startswith("/api/products")
    assert sorted(r.n for r in bad.collect()) == [2, 3]


def test_thresholds(spark):
    t = alerting.parse_thresholds(spark, "shop.local:0.8, nope, bad:xx ,:0.5,*:3,*:4")
    assert {(r.domain, r.threshold) for r in t.collect()} == {("shop.local", 0.8), ("*", 4.0)}
    got = alerting.resolve_threshold(spark.createDataFrame([("shop.local",), ("x",)], "domain string"), t).collect()
    assert {r.domain: r.domain_threshold for r in got} == {"shop.local": 0.8, "x": 4.0}


def test_statistics(spark):
    now = datetime(2026, 1, 10, 12)
    ago = [5, 10, 70, 120, 1800, 1805]
    rows = [(f"e{i}", f"1.1.1.{i % 2}", "shop.local", "R", m) for i, m in enumerate(ago)]
    df = spark.createDataFrame(rows, "event_id string, src_ip string, domain string, rule_id string, m int").withColumn("detected_at", F.lit(now) - F.make_dt_interval(mins=F.col("m")))
    k = stats.kpi_window(df, now).first()
    assert (k.attacks, k.previous_attacks, k.attacks_pct) == (4, 2, 100.0)
    assert stats.attack_trend(df, now).agg(F.sum("attacks")).first()[0] == 4
    assert stats.attack_heatmap(df, now).agg(F.count("*"), F.sum("n")).first()[:] == (168, 6)
    found = df.withColumn("url", F.lit("/a?50%_")).transform(lambda x: stats.history_search(x, now, q="50%_"))
    assert found.count() == 6 and stats.history_search(df.withColumn("url", F.lit("/a")), now, q="5_%").count() == 0


def test_confusion_undefined(spark):
    r = evaluate.confusion_metrics(spark.createDataFrame([(True, False)], "positive boolean, detected boolean")).first()
    assert (r.precision, r.recall, r.fpr, r.f1) == (None, 0.0, None, 0.0)


def test_envelopes(spark):
    rows = [('{"event":"log.enriched","event_id":"1","schema_version":1,"request_id":"r","timestamp":"t","source":"s","domain":"D","data":{"src_ip":"1.1.1.1"}}', "d|1.1.1.1"), ("{bad", "k"), ('{"event":"nope","schema_version":1,"request_id":"r","timestamp":"t","source":"s","domain":"d","data":{}}', "d"), ('{"event":"log.enriched"}', "d")]
    good, bad = envelopes.validate_envelopes(envelopes.decode_envelopes(spark.createDataFrame(rows, "value string, key string"), "log.enriched"), keyed=True)
    assert good.count() == 1 and {r.error for r in bad.collect()} == {"invalid JSON", "unknown event", "missing schema_version"}


def test_scan_and_pipelines(spark, tmp_path):
    for name, text in (("nginx/shop.local.access.log", NGINX + "\n\n"), ("apache/blog.log", APACHE), ("nginx/shop.local.access.log.1", APACHE)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = logs.scan_access_logs(spark, str(tmp_path)).collect()
    assert {(r.domain, r.log_source) for r in got} == {("shop.local", "nginx")} and len(got) == 1
    (tmp_path / "p").mkdir()
    (tmp_path / "p/shop.yaml").write_text("pipeline: main\ndomain: shop.local\nstages:\n  - ingestion\n  - normalize\n")
    (tmp_path / "p/none.yaml").write_text("broken")
    assert [tuple(r) for r in logs.pipelines(spark, str(tmp_path / "p")).collect()] == [("main", "shop.local", ["ingestion", "normalize"])]


def test_stream_equals_batch(spark, tmp_path):
    from weirgate.streaming.pipeline import into_table, windowed_requests

    rng = random.Random(3)
    rows = sorted([(rng.randrange(100) * 1000, f"1.1.1.{rng.randrange(3)}", rng.choice(["/a", "/b"]), rng.choice([200, 404])) for _ in range(150)], key=lambda r: r[0])
    batch = _requests(spark, rows)
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windowed_requests(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), forget_idle=False)
    for _ in range(2):  # the second run has nothing new
        q = stream.writeStream.foreachBatch(into_table(str(tmp_path / "out"), "seq")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    names = ["seq", "requests", "errors", "distinct_paths"]
    got = spark.read.parquet(str(tmp_path / "out")).select(*names)
    want = detect.client_window(batch).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def in_order(batch, path, parts=2):
    """Writes the rows in files by seq, one after the other and with times to match, as windowed_requests() wants them of the file source."""
    rows = batch.orderBy("seq").collect()
    for n in range(parts):
        part = rows[len(rows) * n // parts : len(rows) * (n + 1) // parts]
        batch.sparkSession.createDataFrame(part, batch.schema).coalesce(1).write.mode("append").parquet(str(path))
        for f in path.glob("part-*"):
            if f.name not in in_order.seen:
                in_order.seen.add(f.name)
                os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))


in_order.seen = set()


def _replayed(spark, tmp_path, stream, out_schema, batch, by=None):
    """Rows that the stream made of the batch's rows makes, over two runs; the second has nothing new."""
    from weirgate.streaming.pipeline import into_table, read_table

    in_order(batch, tmp_path / "in")
    rows = stream(spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    for _ in range(2):
        q = rows.writeStream.foreachBatch(into_table(str(tmp_path / "out"), "seq", by)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    return read_table(spark, str(tmp_path / "out"), out_schema)


def test_stream_alerts_in_arrival_order(spark, tmp_path):
    """Cooldown and late rows, against a sequential model."""
    from weirgate.streaming.pipeline import OUT, windowed_requests

    rng = random.Random(31)
    cfg = DetectorConfig(window_ms=10_000, burst_requests=3, flood_requests=6, alert_cooldown_s=4)
    rows = [(1000 * max(0, i // 2 - (30 if rng.random() < 0.05 else 0)), "9.9.9.9", f"/p{rng.randrange(3)}", 200) for i in range(150)]
    df = _requests(spark, rows).withColumn("rule_points", F.when(F.col("seq") % 50 == 0, 80).otherwise(0))
    got = {r.seq: r for r in _replayed(spark, tmp_path, lambda x: windowed_requests(x, cfg, forget_idle=False), OUT, df).collect()}
    held, latest, last = [], -(10**9), -(10**9)
    for i, (t, _, path, _) in enumerate(rows):
        late = t <= latest - 10_000
        if not late:
            latest = max(latest, t)
            held = [h for h in [*held, (t, path)] if h[0] > latest - 10_000]
        score = (80 if i % 50 == 0 else 0) + 30 * (len(held) >= 3) + 40 * (len(held) >= 6)
        alert = score >= 70
        suppressed = alert and t // 1000 - last < 4
        last = t // 1000 if alert and not suppressed else last
        r = got[i]
        assert (r.requests, r.distinct_paths, r.late, r.score, r.alert, r.suppressed) == (len(held), len({p for _, p in held}), late, min(score, 100), alert, suppressed)
    assert len(got) == 150 and any(r.late for r in got.values()) and any(r.suppressed for r in got.values())


def test_stream_floods_equal_batch(spark, tmp_path):
    from weirgate.streaming.pipeline import FLOOD_OUT, flood_alerts

    cfg = DetectorConfig(ddos_requests=30, ddos_ips=5)
    rows = [(1000 * (i // 8), f"1.1.1.{i % 9}", "/", 200) for i in range(400)]
    df = _requests(spark, rows)
    names = ["seq", "domain", "ts_s", "requests", "unique_ips"]
    got = _replayed(spark, tmp_path, lambda x: flood_alerts(x, cfg, forget_idle=False), FLOOD_OUT, df, by="domain").select(*names)
    want = detect.ddos_alerts(df, cfg).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 2


def test_rules_are_read_again_for_each_batch(spark):
    from weirgate.streaming.pipeline import with_current_rules

    one = ("GOOD_ID", "g", "d", True, ["url"], "x", 50, [])
    rule = "struct<id:string,group:string,description:string,enabled:boolean,targets:array<string>,pattern:string,score:int,normalizers:array<string>>"
    snapshots, seen = [], []
    write = with_current_rules(lambda s: s.createDataFrame(snapshots, f"version long, rules array<{rule}>"), lambda batch, rules, i: seen.append([r.id for r in rules.collect()]))
    with pytest.raises(ValueError):
        write(spark.range(1), 0)
    for version, rules in ((1, [one]), (2, [("A", *one[1:])]), (3, [("OTHER_ID", *one[1:])])):
        snapshots.append((version, rules))
        write(spark.range(1), version)
    assert seen == [["GOOD_ID"], ["GOOD_ID"], ["OTHER_ID"]]


def test_stream_state_times_out(spark, tmp_path):
    """With the timer on, an idle client's state goes; its next request is the first of its window."""
    import time

    from weirgate.streaming.pipeline import windowed_requests

    cfg = DetectorConfig(window_ms=500)
    first = _requests(spark, [(0, "1.1.1.1", "/a", 200)] * 3)
    (tmp_path / "in").mkdir()
    first.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = windowed_requests(spark.readStream.schema(first.schema).parquet(str(tmp_path / "in")), cfg).writeStream.format("memory").queryName("timed").option("checkpointLocation", str(tmp_path / "cp")).start()

    def wait_for(rows):  # a query with timers is never idle
        until = time.time() + 60
        while spark.table("timed").count() < rows and time.time() < until:
            time.sleep(0.5)

    try:
        wait_for(3)
        time.sleep(4)
        first.withColumn("seq", F.col("seq") + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        wait_for(6)
    finally:
        q.stop()
    got = {r.seq: r.requests for r in spark.table("timed").collect()}
    assert got[2] == 3 and got[10] == 1 and got[12] == 3
