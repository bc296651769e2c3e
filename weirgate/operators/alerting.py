"""Notification policy: thresholds of domains, cooldown, what is sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .detect import with_cooldown
from .enrich import checked_broadcast

# The columns of the attacks table, and the length to which its free texts are cut.
ATTACK_COLUMNS = ("event_id", "detected_at", "domain", "attack_type", "severity", "rule_id", "rule_name", "src_ip", "method", "url", "host", "field", "matched_value", "evidence", "request_id", "session_id", "status", "user_agent", "score")
MAX_TEXT = 500


def parse_thresholds(spark: SparkSession, text: str) -> DataFrame:
    """domain, threshold of "domain:score,domain:score": malformed items are passed over, of several for a domain the last holds."""
    items = spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("at", "item"))
    mark = F.instr("item", ":")
    x = items.select("at", F.trim(F.substring(F.col("item"), F.lit(1), mark - 1)).alias("domain"), F.trim(F.substring(F.col("item"), mark + 1, F.length("item"))).try_cast("double").alias("threshold"), mark.alias("mark"))
    good = x.where((F.col("mark") > 1) & (F.col("domain") != "") & F.col("threshold").isNotNull())
    return good.groupBy("domain").agg(F.max_by("threshold", "at").alias("threshold"))


def resolve_threshold(rows: DataFrame, thresholds: DataFrame, default: float | None = None) -> DataFrame:
    """rows and domain_threshold: of the domain, else of *, else default."""
    t = checked_broadcast(thresholds.select(F.col("domain").alias("_d"), F.col("threshold").alias("_t")))
    star = t.where("_d = '*'").agg(F.max("_t").alias("_star"))
    found = rows.join(t, rows["domain"] == t["_d"], "left")
    fallback = F.broadcast(star)  # one row
    return found.join(fallback, how="left", on=F.lit(True)).withColumn("domain_threshold", F.coalesce("_t", "_star", F.lit(default).cast("double"))).drop("_d", "_t", "_star")


def build_alert(rows: DataFrame) -> DataFrame:
    """Alert rows with their defaults and main_attack_type."""
    none = F.array().cast("array<string>")
    types = F.coalesce("attack_types", none)
    return rows.withColumns(
        {"attack_types": types, "main_attack_type": F.coalesce(F.try_element_at(types, F.lit(1)), F.lit("unknown")), "rule_ids": F.coalesce("rule_ids", none), "severity": F.coalesce(F.nullif("severity", F.lit("")), F.lit("unknown")), "src_ip": F.coalesce(F.nullif("src_ip", F.lit("")), F.lit("unknown"))}
    )


def notification_decisions(events: DataFrame, thresholds: DataFrame, cooldown_s: int = 60) -> DataFrame:
    """events (event, event_id, triggered_at, domain, src_ip, attack_types, score ..) and main_attack_type, threshold, disposition.

    event is anomaly.scored or alert.triggered. Of a domain with a threshold, both need a score that reaches it; without, alerts
    pass and anomalies are only counted. What passes is sent unless its (domain, src_ip, main type) was sent within the cooldown.
    disposition: sent, suppressed, below_threshold or counted.
    """
    x = resolve_threshold(build_alert(events), thresholds)
    is_alert, bound = F.col("event") == "alert.triggered", F.col("domain_threshold")
    numeric_below = F.coalesce(F.col("score") < bound, F.lit(False))
    passes = F.when(is_alert, ~numeric_below).otherwise(bound.isNotNull() & F.coalesce(F.col("score") >= bound, F.lit(False)))
    x = x.withColumn("passes", passes).withColumn("threshold", F.coalesce("domain_threshold", "threshold")).withColumn("key", F.concat_ws("|", "domain", "src_ip", "main_attack_type"))
    x = x.withColumn("second", F.unix_seconds("triggered_at"))
    order = F.struct(F.col("triggered_at"), F.when(is_alert, 1).otherwise(0).alias("kind"), F.col("event_id"))
    due = with_cooldown(x.where("passes").withColumn("order", order), "key", "second", "order", cooldown_s)
    decided = due.withColumn("disposition", F.when(F.col("fired"), "sent").otherwise("suppressed")).drop("fired", "order")
    rest = x.where(~F.col("passes")).withColumn("disposition", F.when(is_alert, "below_threshold").otherwise("counted"))
    return decided.unionByName(rest).drop("passes", "key", "second", "domain_threshold")


def alert_dispositions(decisions: DataFrame) -> DataFrame:
    """One row of counts: anomalies, flagged (anomalies that passed), alerts sent, suppressed, below_threshold."""
    d, anomaly = F.col("disposition"), F.col("event") == "anomaly.scored"
    return decisions.agg(
        F.count_if(anomaly).alias("anomalies"),
        F.count_if(anomaly & d.isin("sent", "suppressed")).alias("flagged"),
        F.count_if(d == "sent").alias("alerts"),
        F.count_if(d == "suppressed").alias("suppressed"),
        F.count_if(d == "below_threshold").alias("below_threshold"),
    )


def notifications(alerts: DataFrame) -> DataFrame:
    """event_id, subject, body (nine lines) of alerts."""
    listed = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("-"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    subject = F.concat(F.lit("["), F.upper("severity"), F.lit("] "), listed("attack_types"), F.lit(" on "), text("domain"))
    lines = [("Domain", text("domain")), ("Severity", text("severity")), ("Attack types", listed("attack_types")), ("Source", text("src_ip")), ("URL", text("url")), ("Score", F.concat_ws(" / ", text("score"), text("threshold"))), ("Rules", listed("rule_ids")), ("Reason", text("reason")), ("Time", text("triggered_at"))]
    return alerts.select("event_id", subject.alias("subject"), F.concat_ws("\n", *[F.concat(F.lit(f"{n}: "), v) for n, v in lines]).alias("body"))


def attack_rows(events: DataFrame) -> DataFrame:
    """Rows of the attacks table of attack.detected events (event_id, timestamp, domain, request_id, session_id and the fields of data; those
    that are missing are null): matched_value ('' if null) and user_agent (null if empty) cut to 500 characters, status and score as
    whole numbers, or null for what is none."""
    has = lambda c: F.col(c) if c in events.columns else F.lit(None)
    text = lambda c: has(c).cast("string")
    kinds = dict(events.dtypes)

    def whole(c: str) -> Column:
        if kinds.get(c, "string") == "string":
            return F.when(text(c).rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text(c)).try_cast("int"))
        return has(c).try_cast("int")

    cut = lambda c: F.substring(F.coalesce(text(c), F.lit("")), 1, MAX_TEXT)
    special = {"detected_at": has("timestamp").cast("timestamp"), "matched_value": cut("matched_value"), "user_agent": F.nullif(cut("user_agent"), F.lit("")), "status": whole("status"), "score": whole("score")}
    return events.select(*[special[c].alias(c) if c in special else text(c).alias(c) for c in ATTACK_COLUMNS])


def upsert_once(rows: DataFrame, known: DataFrame | None = None, key: str = "event_id") -> DataFrame:
    """One row for each key that the known table doesn't have; of equal keys the one that sorts first by its whole content."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*[c for c in rows.columns]))) == 1
    new = rows.withColumn("_first", first).where("_first").drop("_first")
    return new if known is None else new.join(known.select(key), key, "left_anti")
