"""Pipeline progress, counters and rates over envelopes and service logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The stage that an event counts for, and the bounds of the score histogram.
STAGES = {"log.raw.ingested": "ingestion", "log.normalized": "normalize", "log.enriched": "enrich", "attack.detected": "detect", "anomaly.scored": "score", "alert.triggered": "alert"}
SCORE_BOUNDS = (10, 20, 30, 40, 50, 60, 70, 80, 90, 100)


def _stage():
    chain = F.lit(None).cast("string")
    for event, stage in STAGES.items():
        chain = F.when(F.col("event") == event, stage).otherwise(chain)
    return chain


def _or_unknown(c: str):
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))


def stage_progress(events: DataFrame) -> DataFrame:
    """domain, stage, n, last_at of envelopes (event, event_id, domain, ts); an event_id counts once."""
    staged = events.withColumn("stage", _stage()).where("stage IS NOT NULL")
    once = staged.groupBy("event_id", "stage", F.coalesce("domain", F.lit("unknown")).alias("domain")).agg(F.max("ts").alias("ts"))
    return once.groupBy("domain", "stage").agg(F.count("*").alias("n"), F.max("ts").alias("last_at")).orderBy("domain", "stage")


def stage_completed(events: DataFrame, pipelines: DataFrame, seconds: int = 10) -> DataFrame:
    """pipeline, domain, stage, period_start, processed: what each stage did in each period in which it did something."""
    staged = events.withColumn("stage", _stage()).where("stage IS NOT NULL")
    counted = staged.groupBy(F.coalesce("domain", F.lit("unknown")).alias("domain"), "stage", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("processed"))
    named = pipelines.select(F.col("domain").alias("p_domain"), F.col("pipeline").alias("p_name"))
    found = counted.join(named, counted["domain"] == named["p_domain"], "left")
    return found.select(F.coalesce("p_name", "domain").alias("pipeline"), "domain", "stage", F.col("w.start").alias("period_start"), "processed")


def metrics_events(events: DataFrame) -> DataFrame:
    return events.groupBy("event", _or_unknown("domain").alias("domain")).agg(F.count("*").alias("n"))


def metrics_ingested(raw: DataFrame) -> DataFrame:
    return raw.groupBy(_or_unknown("domain").alias("domain"), F.coalesce("log_source", F.lit("")).alias("source")).agg(F.count("*").alias("n"))


def metrics_http(requests: DataFrame) -> DataFrame:
    cls = F.coalesce(F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx")), F.lit("unknown"))
    return requests.groupBy(_or_unknown("domain").alias("domain"), cls.alias("status_class")).agg(F.count("*").alias("n"))


def metrics_attacks(attacks: DataFrame) -> DataFrame:
    return attacks.groupBy(*[_or_unknown(c).alias(c) for c in ("domain", "attack_type", "severity", "rule_id")]).agg(F.count("*").alias("n"))


def attack_label_sets(attacks: DataFrame) -> DataFrame:
    """The label subsets that dashboards read, in one pass: by domain, by type, by severity, by rule, and all; level says which."""
    keys = [_or_unknown(c).alias(c) for c in ("domain", "attack_type", "severity", "rule_id")]
    x = attacks.select(*keys)
    return x.groupingSets([["domain"], ["attack_type"], ["severity"], ["rule_id"], []], "domain", "attack_type", "severity", "rule_id").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


def metrics_anomalies(scored: DataFrame) -> DataFrame:
    return scored.groupBy(_or_unknown("domain").alias("domain"), _or_unknown("severity").alias("severity")).agg(F.count("*").alias("n"))


def metrics_alerts(alerts: DataFrame) -> DataFrame:
    first = F.coalesce(F.try_element_at("attack_types", F.lit(1)), F.lit("unknown"))
    return alerts.groupBy(_or_unknown("domain").alias("domain"), _or_unknown("severity").alias("severity"), first.alias("attack_type")).agg(F.count("*").alias("n"))


def metrics_stages(completed: DataFrame) -> DataFrame:
    return completed.groupBy(_or_unknown("domain").alias("domain"), _or_unknown("stage").alias("stage")).agg(F.count("*").alias("n"))


def score_histogram(scored: DataFrame) -> DataFrame:
    """domain, le_10 .. le_100, le_inf (cumulative), score_sum of rows with a score."""
    known = scored.where("score IS NOT NULL")
    bounds = [F.count_if(F.col("score") <= b).alias(f"le_{b}") for b in SCORE_BOUNDS]
    return known.groupBy(_or_unknown("domain").alias("domain")).agg(*bounds, F.count("*").alias("le_inf"), F.sum("score").cast("double").alias("score_sum"))


def event_rates(rows: DataFrame, by: str, ts: str = "ts", window: str = "1 minute", slide: str | None = None, seconds: int = 60) -> DataFrame:
    """by, window_start, per_second of each (sliding) window that has rows."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    counted = rows.groupBy(by, w.alias("w")).agg(F.count("*").alias("n"))
    return counted.select(by, F.col("w.start").alias("window_start"), (F.col("n") / seconds).alias("per_second"))


def service_log_rates(logs: DataFrame) -> DataFrame:
    """service, minute, lines, errors of service logs (ts, service, msg)."""
    bad = F.coalesce(F.col("msg").rlike("(?i)error|fail|exception"), F.lit(False))
    return logs.groupBy("service", F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("lines"), F.count_if(bad).alias("errors"))


def error_rates(requests: DataFrame, seconds: int) -> DataFrame:
    """domain, client_errors and server_errors (4xx and 5xx a second, over so many seconds) and error_share of all requests."""
    status = F.coalesce("status", F.lit(0))
    x = requests.groupBy(F.lower("domain").alias("domain")).agg(F.count("*").alias("n"), F.count_if(status.between(400, 499)).alias("c"), F.count_if(status.between(500, 599)).alias("s"))
    return x.select("domain", (F.col("c") / seconds).alias("client_errors"), (F.col("s") / seconds).alias("server_errors"), ((F.col("c") + F.col("s")) / F.col("n")).alias("error_share"))


def monitored_domains(events: DataFrame) -> DataFrame:
    """domains: how many have events."""
    return events.agg(F.count_distinct(F.lower("domain")).alias("domains"))
