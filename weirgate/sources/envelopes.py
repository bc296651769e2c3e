"""Event envelopes: decode, validate, encode, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.net import client_key

# The events of the contract and the fields that each envelope must have.
EVENTS = ("log.raw.ingested", "log.normalized", "log.enriched", "attack.detected", "anomaly.scored", "alert.triggered", "stage.completed")
REQUIRED = ("event", "schema_version", "timestamp", "source", "domain", "data")
OUTER = "event string, event_id string, schema_version int, request_id string, session_id string, timestamp string, source string, domain string"
DATA = {
    "log.raw.ingested": "raw string, log_source string, log_path string, collected_at string",
    "log.enriched": "src_ip string, method string, path string, query_string string, status int, user_agent string, referer string, host string, request_ts string, session_id string, req_count_1m int, geo struct<country_iso:string,country:string,city:string>",
    "attack.detected": "attack_type string, severity string, rule_id string, rule_name string, src_ip string, method string, url string, host string, status int, user_agent string, score int, field string, matched_value string, evidence string",
    "anomaly.scored": "score int, threshold int, severity string, src_ip string, url string, host string, attack_types array<string>, reasons array<string>",
    "alert.triggered": "score int, threshold int, severity string, src_ip string, url string, host string, attack_types array<string>, rule_ids array<string>, reason string",
    "stage.completed": "pipeline string, stage string, processed long, window_seconds int",
}
MAX_ERROR = 500


def read_topic(spark: SparkSession, event: str, source: dict) -> DataFrame:
    """A stream of key, value of an event's topic. source: a reader's format and options; for Kafka, from the earliest offset on."""
    reader = spark.readStream.format(source.get("format", "kafka"))
    options = {"subscribe": event, "startingOffsets": "earliest", "maxOffsetsPerTrigger": "50000"} if source.get("format", "kafka") == "kafka" else {}
    for k, v in (options | source.get("options", {})).items():
        reader = reader.option(k, v)
    reader = reader.schema(source["schema"]) if "schema" in source else reader
    return reader.load(source["path"]) if "path" in source else reader.load()


def decode_envelopes(raw: DataFrame, event: str | None = None) -> DataFrame:
    """raw and e: the envelope in value (string), with typed data if an event is given. e._corrupt holds text that is no such JSON."""
    data = f"struct<{', '.join(f'{n}:{t}' for n, t in (x.strip().split(' ', 1) for x in _split(DATA[event])))}>" if event in DATA else "string"
    return raw.withColumn("e", F.from_json(F.col("value").cast("string"), f"{OUTER}, data {data}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))


def _split(fields: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(fields):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(fields[last:i])
            last = i + 1
    return [*out, fields[last:]]


def envelope_error() -> Column:
    """Why the envelope e breaks the contract; null if it doesn't."""
    e = F.col("e")
    missing = [F.when(e[c].isNull() if c in ("data", "schema_version") else F.coalesce(e[c], F.lit("")) == "", F.lit(f"missing {c}")) for c in REQUIRED]
    anonymous = (F.coalesce(e["request_id"], F.lit("")) == "") & (F.coalesce(e["session_id"], F.lit("")) == "") & (e["event"] != "stage.completed")
    return F.coalesce(F.when(e.isNull() | e["_corrupt"].isNotNull(), "invalid JSON"), *missing, F.when(~e["event"].isin(*EVENTS), "unknown event"), F.when(anonymous, "no request_id or session_id"))


def validate_envelopes(decoded: DataFrame, keyed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid, dead letters): one pass that marks, and two filters. keyed: the key must be what client_key gives, too."""
    error = envelope_error()
    if keyed:
        ip = F.get_json_object(F.col("value").cast("string"), "$.data.src_ip")
        error = F.coalesce(error, F.when(F.coalesce(F.col("key").cast("string"), F.lit("")) != client_key(F.col("e.domain"), ip), "key is not the client's"))
    marked = decoded.withColumn("error", error)
    return marked.where("error IS NULL").drop("error"), dead_letters(marked.where("error IS NOT NULL"))


def dead_letters(failed: DataFrame) -> DataFrame:
    """body, error (cut to 500) and where it came from, if known."""
    origin = [F.col(c) if c in failed.columns else F.lit(None).cast("string").alias(c) for c in ("topic", "partition", "offset")]
    return failed.select(F.col("value").cast("string").alias("body"), F.substring("error", 1, MAX_ERROR).alias("error"), *origin)


def encode_envelopes(rows: DataFrame, event: str, data: list[str]) -> DataFrame:
    """key, value, headers of rows with the outer columns; data names the columns that go into data."""
    outer = [F.lit(event).alias("event"), "event_id", F.lit(1).alias("schema_version"), "request_id", "session_id", F.col("timestamp").cast("string").alias("timestamp"), "source", "domain"]
    value = F.to_json(F.struct(*outer, F.struct(*data).alias("data")))
    ip = F.col("src_ip") if "src_ip" in rows.columns else F.lit(None).cast("string")
    header = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("binary").alias("value"))
    return rows.select(client_key(F.col("domain"), ip).alias("key"), value.alias("value"), F.array(header("event", F.lit(event)), header("event_id", F.col("event_id")), header("source", F.col("source"))).alias("headers"))


def all_events(*topics: DataFrame) -> DataFrame:
    out = topics[0]
    for t in topics[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
