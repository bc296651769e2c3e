"""Detection quality against labelled requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DetectorConfig
from ..sources.shared import stored
from .detect import client_window, scored_by, with_matches, with_suppressed
from .matching import rule_matches

# Categories that are no payload.
NO_PAYLOAD = ("benign", "scan", "flood")


def ablation_replay(requests: DataFrame, rules: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Scored requests and alert (fired) under A rules only, B behaviour only, C both; config tells them apart. Each request is windowed and
    matched once, which is written to the shared folder, and then stands once for each config."""
    x = stored(with_matches(client_window(requests, cfg), rule_matches(requests, rules).select("request_id", "rule_id", "rule_group", "rule_score")), "ablation")
    x = x.withColumn("config", F.explode(F.array(*map(F.lit, "ABC"))))
    scored = scored_by(x, cfg, by_rules=F.col("config") != "B", by_behaviour=F.col("config") != "A")
    fired = with_suppressed(scored.withColumn("client", F.concat_ws("|", "config", "client")).where(F.col("score") >= cfg.alert_score), cfg).where("NOT suppressed").select("config", "request_id", F.lit(True).alias("alert"))
    return scored.join(fired, ["config", "request_id"], "left").withColumn("alert", F.coalesce("alert", F.lit(False)))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.bround(a / b, 4))


def confusion_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, fpr (4 places, null if undefined), f1 (0.0 if undefined) of positive and detected (booleans), per group."""
    p, d = F.col("positive"), F.col("detected")
    x = rows.groupBy(*by).agg(F.count_if(p & d).alias("tp"), F.count_if(~p & d).alias("fp"), F.count_if(p & ~d).alias("fn"), F.count_if(~p & ~d).alias("tn"))
    x = x.withColumns({"precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn")), "fpr": _ratio(F.col("fp"), F.col("fp") + F.col("tn"))})
    p, r = F.col("precision"), F.col("recall")
    return x.withColumn("f1", F.when((p > 0) & (r > 0), F.bround(2 * p * r / (p + r), 4)).otherwise(0.0))


def observed_labels(labels: DataFrame, enriched_ids: DataFrame) -> DataFrame:
    """Labels (request_id, category, label, status ..) with a status whose request reached enrichment."""
    return labels.where(F.coalesce(F.col("status"), F.lit(0)) != 0).join(enriched_ids.select("request_id").distinct(), "request_id", "left_semi")


def _marked(labels: DataFrame, detected: DataFrame) -> DataFrame:
    """Payload and benign labels for each config of detected (config, request_id), with positive and detected."""
    ids = detected.select("config", "request_id").distinct()
    configs = ids.select("config").distinct()
    known = labels.where((F.col("label") == "benign") | ~F.col("category").isin(*NO_PAYLOAD)).withColumn("positive", F.col("label") != "benign")
    # every label is judged under every config: a handful of rows that are exploded, not joined
    each = known.join(F.broadcast(configs.agg(F.collect_set("config").alias("configs"))), F.lit(True)).withColumn("config", F.explode("configs")).drop("configs")
    return each.join(ids.withColumn("hit", F.lit(True)), ["config", "request_id"], "left").withColumn("detected", F.coalesce("hit", F.lit(False)))


def eval_request_level(labels: DataFrame, detected: DataFrame) -> DataFrame:
    return confusion_metrics(_marked(labels, detected), "config")


def eval_by_category(labels: DataFrame, detected: DataFrame) -> DataFrame:
    """config, category, found, total, recall of payload categories."""
    x = _marked(labels, detected).where("positive").groupBy("config", "category").agg(F.count_if("detected").alias("found"), F.count("*").alias("total"))
    return x.withColumn("recall", _ratio(F.col("found"), F.col("total")))


# The order of the kinds and the addresses of crawlers and API pollers.
def actors(labels: DataFrame) -> DataFrame:
    """ip, actor, malicious: what kind of source the categories of its requests make it."""
    c = F.col("categories")
    kinds = labels.groupBy("ip").agg(F.collect_set("category").alias("categories"))
    last = F.regexp_extract("ip", r"^198\.51\.100\.(\d+)$", 1).try_cast("int")
    actor = (
        F.when(F.size(F.array_except(c, F.array(*map(F.lit, NO_PAYLOAD)))) > 0, "payload_attacker")
        .when(F.array_contains(c, "scan"), "scanner")
        .when(F.array_contains(c, "flood"), "flooder")
        .when(F.startswith("ip", F.lit("66.249.")), "benign_crawler")
        .when(last >= 200, "benign_api_poller")
        .otherwise("benign_visitor")
    )
    return kinds.select("ip", actor.alias("actor")).withColumn("malicious", ~F.startswith("actor", F.lit("benign")))


def eval_source_level(labels: DataFrame, alerted: DataFrame) -> DataFrame:
    """Confusion of sources per config; alerted has config, ip (one row an alert)."""
    hit = alerted.select("config", "ip").distinct().withColumn("hit", F.lit(True))
    configs = alerted.agg(F.collect_set("config").alias("configs"))
    each = actors(labels).join(F.broadcast(configs), F.lit(True)).withColumn("config", F.explode("configs"))
    return confusion_metrics(each.join(hit, ["config", "ip"], "left").select("config", F.col("malicious").alias("positive"), F.coalesce("hit", F.lit(False)).alias("detected")), "config")


def eval_by_actor(labels: DataFrame, alerted: DataFrame) -> DataFrame:
    """config, actor, share ("alerted/total")."""
    configs = alerted.agg(F.collect_set("config").alias("configs"))
    hit = alerted.select("config", "ip").distinct().withColumn("hit", F.lit(True))
    each = actors(labels).join(F.broadcast(configs), F.lit(True)).withColumn("config", F.explode("configs")).join(hit, ["config", "ip"], "left")
    x = each.groupBy("config", "actor").agg(F.count_if("hit").alias("found"), F.count("*").alias("total"))
    return x.select("config", "actor", F.concat_ws("/", F.col("found").cast("string"), F.col("total").cast("string")).alias("share"))


def eval_alert_delay(labels: DataFrame, alerted: DataFrame) -> DataFrame:
    """config, sources, median_seconds (the upper median) from a source's first malicious request to its first alert.

    labels have t (seconds); alerted has config, ip, request_id, seq, and its first alert of an ip, by seq, counts.
    """
    began = labels.where("label = 'attack'").groupBy("ip").agg(F.min("t").alias("began"))
    times = labels.select("request_id", "t")
    first = alerted.join(times, "request_id").join(began, "ip").groupBy("config", "ip").agg(F.min_by(F.bround(F.col("t") - F.col("began"), 1), "seq").alias("delay"))
    counted = first.groupBy("config", "delay").agg(F.count("*").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy("config").orderBy("delay"))
    ranked = counted.select("config", "delay", up_to.alias("up_to"), F.sum("n").over(Window.partitionBy("config")).alias("sources"))
    return ranked.groupBy("config").agg(F.max("sources").alias("sources"), F.min(F.when(F.col("up_to") > F.floor(F.col("sources") / 2), F.col("delay"))).alias("median_seconds"))


def eval_coverage(labels: DataFrame, enriched_ids: DataFrame) -> DataFrame:
    """requests, observed, coverage of labels with a status."""
    known = labels.where(F.coalesce(F.col("status"), F.lit(0)) != 0).select("request_id").distinct()
    x = known.join(enriched_ids.select("request_id").distinct().withColumn("seen", F.lit(True)), "request_id", "left")
    out = x.agg(F.count("*").alias("requests"), F.count_if("seen").alias("observed"))
    return out.withColumn("coverage", _ratio(F.col("observed"), F.col("requests")))


def requests_by_category(labels: DataFrame) -> DataFrame:
    return labels.groupBy("category").agg(F.count("*").alias("n"))


def external_detections(labels: DataFrame, flags: DataFrame, name: str = "CRS") -> DataFrame:
    """config (the name), ip, request_id of the labelled requests that an external detector flagged (flags: request_id, flagged): what
    eval_request_level(), eval_by_category(), eval_source_level() and eval_by_actor() take. A source counts as alerted with one flagged request."""
    hit = flags.where("flagged").select("request_id").distinct()
    return labels.join(hit, "request_id", "left_semi").select(F.lit(name).alias("config"), "ip", "request_id")


def flagged_scan_flood(labels: DataFrame, flags: DataFrame) -> DataFrame:
    """n: flagged requests of scans and floods, which are no payload."""
    return external_detections(labels.where(F.col("category").isin("scan", "flood")), flags).agg(F.count_distinct("request_id").alias("n"))
