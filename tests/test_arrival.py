"""Windows, alerts and floods in order of arrival, against sequential models; streams that hold cells."""

import random

import pytest
from pyspark.sql import functions as F

from weirgate.config import DetectorConfig
from weirgate.operators import detect


def requests_of(spark, rows):
    """rows: (seq, ts_ms, ip, path, status), in any order."""
    return spark.createDataFrame([(q, f"r{q}", t, "D.local", ip, p, s) for q, t, ip, p, s in rows], "seq long, request_id string, ts_ms long, domain string, src_ip string, path string, status int")


def modelled(rows, cfg):
    """seq -> (requests, errors, distinct_paths, late) as one request after the other gives them."""
    held, latest, out = {}, {}, {}
    for q, t, ip, p, s in sorted(rows):
        h, top = held.setdefault(ip, []), latest.get(ip)
        late = top is not None and t <= top - cfg.window_ms
        if not late:
            latest[ip] = top = t if top is None else max(top, t)
            h.append((t, p, s))
            h[:] = [x for x in h if x[0] > top - cfg.window_ms]
        plain = [x for x in h if not (x[1] or "").endswith(".css")]
        out[q] = (len(h), sum((x[2] or 0) >= 400 for x in plain), len({x[1] for x in plain} - {None}), late)
    return out


def out_of_order(rng, n, spread, step=1):
    """Requests whose times run ahead and behind; seq has gaps."""
    times = [max(0, 1000 * (i // 3) + 1000 * rng.randrange(-spread, spread)) for i in range(n)]
    return [(step * i + (7 if i > n // 2 else 0), t, rng.choice(["1.1.1.1"] * 5 + ["2.2.2.2", "3.3.3.3"]), rng.choice(["/a", "/b", "/c", "/d", "/x.css", None]), rng.choice([200, 404, None])) for i, t in enumerate(times)]


@pytest.mark.parametrize(("seed", "spread", "slices", "rows_a_range"), [(1, 4, 60, 100_000), (2, 12, 1, 20), (3, 40, 2, 7), (4, 9, 3, 50)])
def test_arrival_window_against_model(spark, monkeypatch, seed, spread, slices, rows_a_range):
    monkeypatch.setattr(detect, "SLICE_WIDTHS", slices)
    monkeypatch.setattr(detect, "RANGE", rows_a_range)
    rng = random.Random(seed)
    cfg = DetectorConfig(window_ms=10_000)
    rows = out_of_order(rng, 500, spread, rng.choice([1, 1000]))
    shuffled = rng.sample(rows, len(rows))
    got = {r.seq: (r.requests, r.errors, r.distinct_paths, r.late) for r in detect.client_window(requests_of(spark, shuffled), cfg, arrival=True).collect()}
    want = modelled(rows, cfg)
    assert got == want and (spread < 10 or any(x[3] for x in want.values()))
    ordered = sorted(((q, t, *x) for q, (t, *x) in enumerate(sorted(r[1:] for r in [(0, r[1], r[2], r[3] or "/n", r[4] or 0) for r in rows]))), key=lambda r: r[0])
    names = ["seq", "requests", "errors", "distinct_paths"]
    by_time, by_arrival = (sorted(map(tuple, detect.client_window(requests_of(spark, ordered), cfg, arrival=a).select(*names).collect())) for a in (False, True))
    assert by_time == by_arrival  # where they come in order of time, both are the same


def test_arrival_alerts_and_floods_against_model(spark, monkeypatch):
    monkeypatch.setattr(detect, "RANGE", 40)
    rng = random.Random(8)
    cfg = DetectorConfig(window_ms=10_000, burst_requests=3, flood_requests=6, alert_cooldown_s=4, ddos_requests=5, ddos_ips=2, ddos_window_s=6, ddos_cooldown_s=5)
    rows = out_of_order(rng, 400, 12)
    df = requests_of(spark, rng.sample(rows, len(rows)))
    none = spark.createDataFrame([], "request_id string, rule_id string, rule_group string, rule_score int")
    scored = detect.anomaly_scores(detect.client_window(df, cfg, arrival=True), none, cfg)
    got = {r.seq: (r.score, r.suppressed, "late_event_outside_window" in r.reasons) for r in detect.alerts(scored, cfg, arrival=True).collect()}
    want, last = {}, {}
    window = modelled(rows, cfg)
    for q, t, ip, _, _ in sorted(rows):
        n, errors, paths, late = window[q]
        score = min(100, 30 * (n >= 3) + 40 * (n >= 6) + 25 * (errors >= cfg.error_count) + 25 * (paths >= cfg.path_count))
        if score >= cfg.alert_score:
            suppressed = ip in last and t // 1000 - last[ip] < 4
            last[ip] = last[ip] if suppressed else t // 1000
            want[q] = (score, suppressed, late)
    assert got == want and any(x[1] for x in want.values()) and any(x[2] for x in want.values())
    floods, held, latest, fired = [], [], None, None
    for q, t, ip, _, _ in sorted(rows):
        s = t // 1000
        if latest is not None and s <= latest - cfg.ddos_window_s:
            continue
        latest = s if latest is None else max(latest, s)
        held = [x for x in [*held, (s, ip)] if x[0] > latest - cfg.ddos_window_s]
        if len(held) >= 5 and len({x[1] for x in held}) >= 2 and (fired is None or s - fired >= 5):
            fired = s
            floods.append((q, len(held), len({x[1] for x in held})))
    assert sorted((r.seq, r.requests, r.unique_ips) for r in detect.ddos_alerts(df, cfg, arrival=True).collect()) == floods and len(floods) > 2


def test_arrival_of_odd_rows(spark):
    """Nulls in key and time, an empty table, one row."""
    df = requests_of(spark, [(1, 1000, None, "/a", 200), (2, None, "1.1.1.1", "/a", 200), (3, 2000, None, None, None)]).withColumn("domain", F.when(F.col("seq") > 1, F.col("domain")))
    got = {r.seq: (r.requests, r.late) for r in detect.client_window(df, arrival=True).collect()}
    assert got[1] == (1, False) and got[3] == (1, False)
    assert detect.client_window(df.limit(0), arrival=True).count() == 0 and detect.ddos_alerts(df.limit(0), arrival=True).count() == 0


def test_streams_equal_batch_on_unordered_times(spark, tmp_path):
    """The streams and the batch forms give the same rows, over several batches and restarts."""
    from test_library import _replayed

    from weirgate.streaming.pipeline import FLOOD_OUT, OUT, flood_alerts, windowed_requests

    rng = random.Random(6)
    cfg = DetectorConfig(window_ms=10_000, burst_requests=3, flood_requests=6, alert_cooldown_s=4, ddos_requests=5, ddos_ips=2, ddos_window_s=6, ddos_cooldown_s=5)
    df = requests_of(spark, out_of_order(rng, 300, 12))
    names = ["seq", "requests", "errors", "distinct_paths", "late", "score", "alert", "suppressed"]
    for part in ("a", "b"):
        (tmp_path / part).mkdir()
    got = _replayed(spark, tmp_path / "a", lambda x: windowed_requests(x, cfg, forget_idle=False), OUT, df).select(*names)
    none = spark.createDataFrame([], "request_id string, rule_id string, rule_group string, rule_score int")
    scored = detect.anomaly_scores(detect.client_window(df, cfg, arrival=True), none, cfg)
    fired = detect.alerts(scored, cfg, arrival=True).select("seq", "suppressed")
    want = scored.join(fired, "seq", "left").withColumns({"alert": F.col("suppressed").isNotNull(), "suppressed": F.coalesce("suppressed", F.lit(False))}).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.where("late").count() > 5
    names = ["seq", "domain", "ts_s", "requests", "unique_ips"]
    got = _replayed(spark, tmp_path / "b", lambda x: flood_alerts(x, cfg, forget_idle=False), FLOOD_OUT, df, by="domain").select(*names)
    want = detect.ddos_alerts(df, cfg, arrival=True).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 2


def test_cells_grow_with_times_and_values():
    from weirgate.streaming.pipeline import _Cells

    rng = random.Random(3)
    held, rows = _Cells({}, {}), []
    for i in range(5000):
        t, flag, value = i // 100 + rng.randrange(3), rng.random() < 0.3, rng.choice(["a", "b", "c", None])
        held.add(t, flag, value)
        rows = [x for x in [*rows, (t, flag, value)] if x[0] > i // 100 - 5]
        held.drop(i // 100 - 5)
        if i % 50 == 0:  # as if read from the state again
            held = _Cells(dict(held.cells), dict(held.values))
        assert (held.rows, held.flagged, set(held.values)) == (len(rows), sum(x[1] for x in rows), {x[2] for x in rows} - {None})
    assert len(held.cells) <= 8 and len(held.values) == 3


def test_table_with_a_ledger(spark, tmp_path, monkeypatch):
    """Replays, a null partition, a crash between the batch's files and its line, keys that come again."""
    from weirgate.streaming import pipeline

    path = str(tmp_path / "t")
    batches = [[("a", None), ("b", "x")], [("a", None), ("c", None), ("c", None)], [("d", "x"), ("b", "x"), (None, "y")]]
    frames = [spark.createDataFrame(b, "event_id string, day string") for b in batches]
    write = pipeline.into_table(path, by="day")
    assert pipeline.read_table(spark, path, frames[0].schema) is None
    write(frames[0], 0)
    write(frames[0], 0)
    whole = lambda: sorted(((r.event_id, r.day) for r in pipeline.read_table(spark, path, frames[0].schema).collect()), key=repr)
    assert whole() == [("a", None), ("b", "x")]
    enter = pipeline._enter

    def breaks(*_):
        raise OSError("lost")

    monkeypatch.setattr(pipeline, "_enter", breaks)
    with pytest.raises(OSError):
        write(frames[1], 1)
    assert whole() == [("a", None), ("b", "x")]  # what has no line is not read
    monkeypatch.setattr(pipeline, "_enter", enter)
    for n in (1, 1, 2, 0, 1, 2):
        write(frames[n], n)
    assert whole() == [("a", None), ("b", "x"), ("c", None), ("d", "x"), (None, "y")]
    lines = {r.batch: r.files for r in pipeline.ledger(spark, path).collect()}
    assert sorted(lines) == ["stream-0", "stream-1", "stream-2"] and all(lines.values())


class Store:
    """A map state in memory that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def getMapState(self, *_):
        return self

    def getValue(self, key):
        self.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value


def test_a_client_is_one_entry_of_the_store():
    """a batch reads and writes the store once a client, whatever its rows; null clients and times are rows too."""
    import pandas as pd

    from weirgate.streaming.pipeline import COLUMNS, NEVER, _ClientWindow

    rng, store, cfg = random.Random(4), Store(), DetectorConfig(window_ms=10_000)
    rows = [(q, t, f"1.1.1.{rng.randrange(40)}", p, s) for q, t, _, p, s in out_of_order(rng, 1500, 12)]
    processor, got = _ClientWindow(cfg, None), {}
    processor.init(store)
    as_input = lambda q, t, ip, p, s: (ip, q, f"r{q}", t, p != "/x.css" and (s or 0) >= 400, None if p == "/x.css" else p, 0)
    for part in (rows[:900], rows[900:]):
        store.calls, shuffled = 0, rng.sample(part, len(part))
        frames = [pd.DataFrame([as_input(*r) for r in shuffled[i::2]], columns=COLUMNS) for i in (0, 1)]
        for found in processor.handleInputRows((7,), iter(frames), None):
            got |= {r.seq: (r.requests, r.errors, r.distinct_paths, r.late) for r in found.itertuples()}
        assert store.calls == 2 * len({r[2] for r in part})
    assert got == modelled(rows, cfg) and any(x[3] for x in got.values())
    odd = pd.DataFrame([(None, 1, "r1", NEVER, False, "/a", 0), (None, 2, "r2", 5, False, None, 0)], columns=COLUMNS)
    assert [(r.client, r.requests, r.late) for f in processor.handleInputRows((8,), iter([odd]), None) for r in f.itertuples()] == [(None, 0, None), (None, 1, False)]


def test_a_batch_is_worked_out_once(spark, tmp_path):
    """the values of a batch's column are looked up without going through the stream's state again."""
    from weirgate.streaming import pipeline

    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for x in frames:
            seen.add(len(x))
            yield x

    write = pipeline.into_table(str(tmp_path / "t"), by="day")
    for n in (0, 1):
        batch = spark.range(50 * n, 50 * n + 100).select(F.col("id").cast("string").alias("event_id"), F.lit("x").alias("day"))
        write(batch.mapInPandas(counted, batch.schema), n)
    assert seen.value == 200 and pipeline.read_table(spark, str(tmp_path / "t"), batch.schema).count() == 150
