"""Access logs: places of lines, growing files; rule catalogues."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from weirgate.sources import logs, tail


def _write(path, text, mode="wb"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, mode) as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def test_line_offsets_over_splits(spark, tmp_path):
    """Offsets do not depend on how files are split; equal lines have ids of their own."""
    rng = random.Random(2)
    want = {}
    for name in ("nginx/a.local.access.log", "nginx/b.local.access.log", "apache/c.access.log"):
        lines = [rng.choice([b"1.2.3.4 same line", b"", "ü é".encode() * rng.randrange(9), b"x" * rng.randrange(300), b"bad \xff\xfe bytes", b"with return\r"]) for _ in range(400)]
        _write(tmp_path / name, b"\n".join(lines) + b"\n" * rng.randrange(2))
        at = 0
        for line in lines:
            text = line.rstrip(b"\r")
            if text:
                want[str(tmp_path / name), at] = text.decode("utf-8", "replace")
            at += len(line) + 1
    _write(tmp_path / "nginx/a.local.access.log.1", "rotated\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    ids = []
    try:
        for size, batch in (("128m", "10000"), ("3000", "7"), ("777", "50")):
            for k, v in zip(before, (size, "1", batch), strict=True):
                spark.conf.set(k, v)
            rows = logs.raw_events(logs.scan_access_logs(spark, str(tmp_path)))
            got = rows.select("log_path", "line_offset", "line", "request_id", "domain").collect()
            assert {(r.log_path, r.line_offset): r.line for r in got} == want and len(got) == len(want)
            assert len({r.request_id for r in got}) == len(want)
            ids.append({r.request_id for r in got})
        assert rows.rdd.getNumPartitions() > 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert ids[0] == ids[1] == ids[2] and {r.domain for r in got} == {"a.local", "b.local", "c"}


class Tailed:
    """A stream of a folder into memory, batch by batch."""

    def __init__(self, spark, root, name, checkpoint, **options):
        self.spark, self.name = spark, name
        self.out = []
        stream = logs.raw_events(logs.stream_access_logs(spark, str(root), **options))
        self.query = stream.writeStream.foreachBatch(lambda b, i: self.out.extend(b.select("line", "line_offset", "log_path", "domain", "request_id").collect())).option("checkpointLocation", str(checkpoint)).start()

    def lines(self):
        self.query.processAllAvailable()
        out, self.out[:] = [r.line for r in sorted(self.out, key=lambda r: (r.log_path, r.line_offset))], []
        return out


def test_growing_logs(spark, tmp_path, monkeypatch):
    """Append, half a line, rotation with a rest, truncation, new and broken files, a stop in between."""
    monkeypatch.setattr(tail, "RANGE_BYTES", 40)
    log, root = tmp_path / "in/nginx/shop.local.access.log", tmp_path / "in"
    _write(log, "one\ntwo\nhal")
    _write(tmp_path / "in/nginx/shop.local.access.log.3", "long ago\n")
    t = Tailed(spark, root, "all", tmp_path / "cp", read_existing=True)
    try:
        assert t.lines() == ["one", "two"]
        _write(log, "f\n\nthree \xe9\r\n".encode("latin-1"), "ab")
        assert t.lines() == ["half", "three �"]
        many = [f"line {i} {'x' * (i % 50)}" for i in range(200)]
        _write(log, "\n".join(many) + "\nlast of the old", "ab")
        assert t.lines() == many
        _write(log, "\n", "ab")
        os.rename(log, f"{log}.1")
        _write(log, "new one\n")
        _write(tmp_path / "in/apache/late.access.log", "late\n")
        assert sorted(t.lines()) == ["last of the old", "late", "new one"]
        _write(log, "x\n")  # shorter than before
        assert t.lines() == ["x"]
        _write(log, "")
        assert t.lines() == []
    finally:
        t.query.stop()
    _write(log, "while stopped\n", "ab")
    t = Tailed(spark, root, "again", tmp_path / "cp", read_existing=True)
    try:
        assert t.lines() == ["while stopped"]
        os.remove(log)
        os.remove(tmp_path / "in/apache/late.access.log")
        _write(tmp_path / "in/apache/other.log", "not an access log\n")
        assert t.lines() == []
    finally:
        t.query.stop()


def test_tail_starts_at_the_end(spark, tmp_path):
    log = tmp_path / "in/apache/blog.access.log"
    _write(log, "old\nold\nbegun")
    t = Tailed(spark, tmp_path / "in", "end", tmp_path / "cp")
    try:
        assert t.lines() == []
        _write(log, " line\nnew\n", "ab")
        _write(tmp_path / "in/nginx/new.access.log", "first\n")
        assert t.lines() == ["begun line", "new", "first"]
    finally:
        t.query.stop()


def test_scan_and_tail_give_the_same_ids(spark, tmp_path):
    log = tmp_path / "in/nginx/shop.local.access.log"
    _write(log, "same\nsame\n\nother\n" * 5)
    t = Tailed(spark, tmp_path / "in", "ids", tmp_path / "cp", read_existing=True)
    try:
        t.query.processAllAvailable()
    finally:
        t.query.stop()
    scanned = logs.raw_events(logs.scan_access_logs(spark, str(tmp_path / "in")), F.lit("2024-01-01").cast("timestamp"))
    assert sorted(r.request_id for r in t.out) == sorted(r.request_id for r in scanned.collect()) and len({r.request_id for r in t.out}) == 15
    assert hashlib.md5(f"{log}|5|same".encode()).hexdigest() in {r.request_id for r in t.out}


def test_a_file_that_goes_away(tmp_path):
    reader = tail.TailReader(str(tmp_path), True, True)
    _write(tmp_path / "nginx/a.access.log", "a\nb\n")
    parts = reader.partitions({}, reader.latestOffset())
    os.rename(tmp_path / "nginx/a.access.log", tmp_path / "nginx/a.access.log.1")
    assert [b.column("line").to_pylist() for b in reader.read(parts[0])] == [["a", "b"]]
    os.remove(tmp_path / "nginx/a.access.log.1")
    with pytest.raises(FileNotFoundError):
        list(reader.read(parts[0]))
    assert list(tail.TailReader(str(tmp_path), True, False).read(parts[0])) == []


def test_rule_documents(spark, tmp_path):
    """JSON and YAML give the same rules; a field that nobody knows is refused."""
    from weirgate.sources.rules import default_rules, load_rules, validate_rules

    yaml = pytest.importorskip("yaml")
    rules = [{**r.asDict(), "targets": list(r.targets)} for r in default_rules(spark).collect()]
    import json

    (tmp_path / "a.json").write_text(json.dumps({"schemaVersion": 1, "rules": rules}))
    (tmp_path / "b.yaml").write_text("# rules\n" + yaml.safe_dump({"schemaVersion": 1, "rules": rules}, allow_unicode=True))
    first, second = (load_rules(spark, str(tmp_path / n)) for n in ("a.json", "b.yaml"))
    assert first.collect() == second.collect() == default_rules(spark).collect() and validate_rules(second)[1].count() == 0
    (tmp_path / "c.yml").write_text("rules:\n  - {id: SOME_ID, group: g, targets: [url], pattern: 'a''b', score: 50}\n")
    r = load_rules(spark, str(tmp_path / "c.yml")).first()
    assert (r.id, r.pattern, r.enabled, r.normalizers) == ("SOME_ID", "a'b", True, None)
    for n, text in enumerate(("rules:\n  - {id: SOME_ID, patern: x}\n", "version: 1\nrules: []\n", "rules: 3\n", "- a\n")):
        (tmp_path / f"bad{n}.yaml").write_text(text)
        with pytest.raises(ValueError):
            load_rules(spark, str(tmp_path / f"bad{n}.yaml"))
