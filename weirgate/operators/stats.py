"""Dashboard statistics over the attacks and alerts tables. now is an argument: results follow from the input alone."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import change_pct

TREND_BUCKETS, TIMELINE_BUCKETS, HEATMAP_DAYS, MAX_HOURS = 24, 48, 7, 720
SEVERITIES = ("critical", "high", "medium", "low")
#: Ranges by which deep pages are found: microseconds of a day, an hour, a minute, a second, one; then characters of an id.
TIME_LEVELS, ID_LEVELS = (86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1), (2, 4, 8)
#: So many rows may be sorted for a page.
SORTED_ROWS = 20_000


def _span(now: datetime, hours: int) -> tuple[datetime, datetime, datetime, int]:
    hours = min(max(int(hours), 1), MAX_HOURS)
    start = now - timedelta(hours=hours)
    return start - timedelta(hours=hours), start, now, hours


def in_window(rows: DataFrame, now: datetime, hours: int, ts: str = "detected_at") -> DataFrame:
    """A filter on the bare column, so that it reaches the scan."""
    _, start, end, _ = _span(now, hours)
    return rows.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))


def kpi_window(rows: DataFrame, now: datetime, hours: int = 24, ts: str = "detected_at") -> DataFrame:
    """attacks, previous_attacks, attacks_pct, ips, previous_ips, ips_pct of the window and the one before it, in one pass."""
    before, start, end, _ = _span(now, hours)
    seen = rows.where((F.col(ts) >= F.lit(before)) & (F.col(ts) < F.lit(end)))
    cur = F.col(ts) >= F.lit(start)
    out = seen.agg(F.count_if(cur).alias("attacks"), F.count_if(~cur).alias("previous_attacks"), F.count_distinct(F.when(cur, F.col("src_ip"))).alias("ips"), F.count_distinct(F.when(~cur, F.col("src_ip"))).alias("previous_ips"))
    return out.withColumns({"attacks_pct": change_pct(F.col("attacks"), F.col("previous_attacks")), "ips_pct": change_pct(F.col("ips"), F.col("previous_ips"))})


def bucket(start: datetime, seconds: float, ts: str = "detected_at") -> Column:
    return F.floor((F.unix_micros(ts) - F.unix_micros(F.lit(start))) / (seconds * 1_000_000)).cast("int")


def attack_trend(rows: DataFrame, now: datetime, hours: int = 24, ts: str = "detected_at") -> DataFrame:
    """bucket 0..23, attacks, ips, domains, rules; buckets without rows are there too."""
    _, start, _, hours = _span(now, hours)
    counted = in_window(rows, now, hours, ts).groupBy(bucket(start, hours * 3600 / TREND_BUCKETS, ts).alias("bucket")).agg(F.count("*").alias("attacks"), F.count_distinct("src_ip").alias("ips"), F.count_distinct("domain").alias("domains"), F.count_distinct("rule_id").alias("rules"))
    return _filled(rows, counted, TREND_BUCKETS)


def _filled(rows: DataFrame, counted: DataFrame, size: int) -> DataFrame:
    return rows.sparkSession.range(size).select(F.col("id").cast("int").alias("bucket")).join(counted, "bucket", "left").fillna(0)


def severity_timeline(rows: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    """bucket and a count for each severity, about 48 buckets; other severities are left out."""
    _, start, _, hours = _span(now, hours)
    minutes = max(1, math.ceil(hours * 60 / TIMELINE_BUCKETS))
    known = in_window(rows, now, hours).where(F.col("severity").isin(*SEVERITIES))
    counted = known.groupBy(bucket(start, minutes * 60).alias("bucket")).pivot("severity", list(SEVERITIES)).count()
    return _filled(rows, counted, math.ceil(hours * 60 / minutes))


def peak_bucket(timeline: DataFrame) -> DataFrame:
    total = sum((F.col(s) for s in SEVERITIES), F.lit(0))
    return timeline.agg(F.max_by("bucket", F.struct(total, -F.col("bucket"))).alias("bucket"), F.max(total).alias("total"))


def attack_types_count(rows: DataFrame, now: datetime, hours: int = 24, top: int = 6) -> DataFrame:
    """attack_type, n and share in percent among the top types."""
    counted = in_window(rows, now, hours).groupBy("attack_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "attack_type").limit(top)
    return counted.withColumn("share", F.bround(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 1))


def top_domains(rows: DataFrame, now: datetime, hours: int = 24, top: int = 6) -> DataFrame:
    return in_window(rows, now, hours).groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(top)


def top_rules(rows: DataFrame, now: datetime, hours: int = 24, top: int = 6) -> DataFrame:
    found = in_window(rows, now, hours).groupBy("rule_id").agg(F.count("*").alias("n"), F.max("rule_name").alias("rule_name"), F.max("attack_type").alias("attack_type"))
    return found.orderBy(F.desc("n"), "rule_id").limit(top)


def attack_heatmap(rows: DataFrame, now: datetime, tz: str = "UTC") -> DataFrame:
    """day, weekday (Monday 0), hour, n, level 0..4 of the last seven local days, today included; hours without rows are there too."""
    local = F.from_utc_timestamp("detected_at", tz)
    today = F.to_date(F.from_utc_timestamp(F.lit(now), tz))
    seen = rows.where((F.col("detected_at") >= F.lit(now - timedelta(days=HEATMAP_DAYS + 1))) & (F.col("detected_at") < F.lit(now + timedelta(days=2))))
    counted = seen.groupBy(F.to_date(local).alias("day"), F.hour(local).alias("hour")).agg(F.count("*").alias("n"))
    cells = rows.sparkSession.range(HEATMAP_DAYS * 24).select(F.date_sub(today, F.floor(F.col("id") / 24).cast("int")).alias("day"), (F.col("id") % 24).cast("int").alias("hour"))
    full = cells.join(counted, ["day", "hour"], "left").fillna(0, ["n"])
    most = F.max("n").over(Window.partitionBy())
    return full.select("day", F.weekday("day").alias("weekday"), "hour", "n", F.when(most == 0, 0).otherwise(F.least(F.lit(4), F.ceil(4 * F.col("n") / most))).cast("int").alias("level"))


def top_ips(rows: DataFrame, now: datetime, hours: int = 24, top: int = 5) -> DataFrame:
    """src_ip, n, share, main_type and trend (array of 24) of the busiest addresses. One count by address, type and bucket gives all parts."""
    _, start, _, hours = _span(now, hours)
    base = in_window(rows, now, hours).groupBy("src_ip", "attack_type", bucket(start, hours * 3600 / TREND_BUCKETS).alias("bucket")).agg(F.count("*").alias("b"))
    best = base.groupBy("src_ip").agg(F.sum("b").alias("n")).orderBy(F.desc("n"), "src_ip").limit(top)
    theirs = base.join(F.broadcast(best.select("src_ip")), "src_ip")  # `top` rows
    types = theirs.groupBy("src_ip", "attack_type").agg(F.sum("b").alias("t")).groupBy("src_ip").agg(F.min_by("attack_type", F.struct(-F.col("t"), "attack_type")).alias("main_type"))
    trend = theirs.groupBy("src_ip", "bucket").agg(F.sum("b").alias("b")).groupBy("src_ip").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "b"))).alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(TREND_BUCKETS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    total = base.agg(F.sum("b").alias("total")).scalar()
    return best.join(types, "src_ip").join(trend, "src_ip").select("src_ip", "n", F.bround(F.col("n") * 100.0 / total, 1).alias("share"), "main_type", filled.alias("trend"))


def _grouped(rows: DataFrame, key: str, now: datetime, hours: int) -> DataFrame:
    _, start, _, hours = _span(now, hours)
    per = in_window(rows, now, hours).groupBy(key, bucket(start, hours * 3600 / TREND_BUCKETS).alias("bucket")).agg(F.count("*").alias("b"))
    found = per.groupBy(key).agg(F.sum("b").alias("n"), F.map_from_entries(F.collect_list(F.struct("bucket", "b"))).alias("m"))
    return found.select(key, "n", F.transform(F.sequence(F.lit(0), F.lit(TREND_BUCKETS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("trend"))


def domain_stats(rows: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    """domain, n and trend of the window (0 if it had none then), last_attack of all time."""
    last = rows.groupBy("domain").agg(F.max("detected_at").alias("last_attack"))
    zeros = F.array(*[F.lit(0).cast("long")] * TREND_BUCKETS)
    return last.join(_grouped(rows, "domain", now, hours), "domain", "left").select("domain", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("trend", zeros).alias("trend"), "last_attack")


def rule_stats(rows: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    return _grouped(rows, "rule_id", now, hours)


def allowlist_overview(allowlist: DataFrame, stats: DataFrame) -> DataFrame:
    x = allowlist.join(stats, allowlist["target"] == stats["domain"], "left")
    return x.select("target", "enabled", F.coalesce("n", F.lit(0)).alias("n"), "last_attack")


def rule_overview(rules: DataFrame, stats: DataFrame) -> DataFrame:
    x = rules.select("id", "group", "enabled", "score").join(stats.select(F.col("rule_id").alias("id"), "n"), "id", "left")
    return x.select("id", "group", "enabled", "score", F.coalesce("n", F.lit(0)).alias("n"))


def alert_kpi(alerts: DataFrame | None, now: datetime, hours: int = 24, spark: SparkSession | None = None) -> DataFrame:
    """alerts, previous, pct of the window and the one before it. Without a table (alerts None; spark is needed then) they are null."""
    if alerts is None:
        return spark.createDataFrame([(None, None, None)], "alerts long, previous long, pct double")
    before, start, end, _ = _span(now, hours)
    seen = alerts.where((F.col("triggered_at") >= F.lit(before)) & (F.col("triggered_at") < F.lit(end)))
    cur = F.col("triggered_at") >= F.lit(start)
    out = seen.agg(F.count_if(cur).alias("alerts"), F.count_if(~cur).alias("previous"))
    return out.withColumn("pct", change_pct(F.col("alerts"), F.col("previous")))


def alert_trend(alerts: DataFrame | None, now: datetime, hours: int = 24, spark: SparkSession | None = None) -> DataFrame:
    """bucket 0..23, n of alerts by triggered_at; zeros without a table (alerts None; spark is needed then)."""
    if alerts is None:
        return spark.range(TREND_BUCKETS).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("n"))
    return count_trend(alerts, now, hours, "triggered_at")


def history_search(rows: DataFrame, now: datetime, hours: int | None = None, q: str | None = None, domain: str | None = None, attack_type: str | None = None, severity: str | None = None) -> DataFrame:
    """Attacks by time, equality, and a substring in any case of address, URL, rule or domain. No character of q is special."""
    x = in_window(rows, now, hours) if hours else rows
    for column, value in (("domain", domain), ("attack_type", attack_type), ("severity", severity)):
        if value:
            x = x.where(F.col(column) == value)
    if q:
        x = x.where(F.contains(F.lower(F.concat_ws("\n", "src_ip", "url", "rule_id", "domain")), F.lit(q.lower())))
    return x


def history_page(rows: DataFrame, limit: int = 50, offset: int = 0, most: int = SORTED_ROWS) -> DataFrame:
    """The rows from an offset on, newest first, without a time last, of one time by event_id.

    A shallow page is a top-k. For a deep one, rows are counted by day, hour and so on down to the microsecond, then by the beginning of
    event_id, each time only in the range in which the page lies, until at most `most` are left to sort. A count's rows are the ranges that occur.
    """
    offset, limit = max(offset, 0), min(max(limit, 1), 1000)
    order = [F.desc_nulls_last("detected_at"), F.asc("event_id")]
    part, skip, size = rows, offset, offset + limit
    for level in (*TIME_LEVELS, *ID_LEVELS) if size > most else ():
        by_time = level in TIME_LEVELS
        value = F.floor(F.unix_micros("detected_at") / level) if by_time else F.substring("event_id", 1, level)
        first = F.desc_nulls_last("b") if by_time else F.asc("b")
        up_to = F.sum("n").over(Window.orderBy(first).rowsBetween(Window.unboundedPreceding, 0))
        ranges = part.groupBy(value.alias("b")).agg(F.count("*").alias("n")).withColumn("up_to", up_to)
        page = ranges.where((F.col("up_to") > skip) & (F.col("up_to") - F.col("n") < skip + limit)).orderBy("up_to").collect()  # each range has rows of the page
        if not page:
            return part.limit(0)
        known = [r.b for r in page if r.b is not None]
        inside = F.lit(False)
        if known and by_time:
            inside = (F.col("detected_at") >= F.timestamp_micros(F.lit(min(known) * level))) & (F.col("detected_at") < F.timestamp_micros(F.lit((max(known) + 1) * level)))
        elif known:
            inside = (F.col("event_id") >= min(known)) & (F.substring("event_id", 1, level) <= max(known))
        part = part.where(inside | F.col("detected_at" if by_time else "event_id").isNull() if len(known) < len(page) else inside)
        skip -= page[0].up_to - page[0].n
        size = sum(r.n for r in page)
        if size <= most or (not by_time and len(page) > 1) or (level == 1 and by_time and len(page) > 1):
            break
    return part.orderBy(*order).offset(skip).limit(limit)


def history_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.count_distinct("src_ip").alias("ips"), F.min("detected_at").alias("first"), F.max("detected_at").alias("last"))


def export_history(rows: DataFrame, path: str, limit: int = 1000) -> None:
    """CSV of the newest attacks, all quoted, with times to the microsecond and blanks as they are."""
    names = ["detected_at", "domain", "severity", "attack_type", "rule_id", "src_ip", "method", "url", "status", "score", "matched_value"]
    rows.orderBy(F.desc_nulls_last("detected_at"), "event_id").limit(limit).select(*names).coalesce(1).write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", mode="overwrite")


def recent(rows: DataFrame, ts: str, n: int, domain: str | None = None) -> DataFrame:
    """The newest n rows, of one domain if given; ties by event_id."""
    x = rows.where(F.col("domain") == domain) if domain else rows
    return x.orderBy(F.desc_nulls_last(ts), "event_id").limit(n)


def recent_feed(events: DataFrame, n: int = 100) -> DataFrame:
    """event, event_id, ts, domain of the newest events; stage.completed is bookkeeping and left out."""
    return recent(events.where("event <> 'stage.completed'").select("event", "event_id", "ts", "domain"), "ts", n)


def live_feed(rows: DataFrame, domain: str | None = None, severity: str | None = None, attack_type: str | None = None, q: str | None = None) -> DataFrame:
    """Attacks, of a table or a stream, by equality and by a substring in any case of address or URL."""
    for column, value in (("domain", domain), ("severity", severity), ("attack_type", attack_type)):
        rows = rows.where(F.col(column) == value) if value else rows
    return rows.where(F.contains(F.lower(F.concat_ws(" ", "src_ip", "url")), F.lit(q.lower()))) if q else rows


def known_domains(allowlist: DataFrame, events: DataFrame) -> DataFrame:
    """domain: those allowed and those seen, in lower case."""
    return allowlist.select(F.lower("target").alias("domain")).union(events.select(F.lower("domain"))).where("domain IS NOT NULL").distinct()


def count_trend(rows: DataFrame, now: datetime, hours: int = 24, ts: str = "detected_at") -> DataFrame:
    """bucket 0..23 and n: of searched attacks, or of alerts by triggered_at; empty buckets are there too."""
    _, start, _, hours = _span(now, hours)
    return _filled(rows, in_window(rows, now, hours, ts).groupBy(bucket(start, hours * 3600 / TREND_BUCKETS, ts).alias("bucket")).agg(F.count("*").alias("n")), TREND_BUCKETS)


def history_histogram(rows: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    """bucket, bucket_start, minutes, n of searched attacks in the timeline's buckets: about 48, each of whole minutes; empty ones are there too."""
    _, start, _, hours = _span(now, hours)
    minutes = max(1, math.ceil(hours * 60 / TIMELINE_BUCKETS))
    counted = in_window(rows, now, hours).groupBy(bucket(start, minutes * 60).alias("bucket")).agg(F.count("*").alias("n"))
    full = _filled(rows, counted, math.ceil(hours * 60 / minutes))
    return full.select("bucket", F.timestamp_micros(F.unix_micros(F.lit(start)) + F.col("bucket").cast("long") * minutes * 60_000_000).alias("bucket_start"), F.lit(minutes).alias("minutes"), "n")


def recent_alerts(alerts: DataFrame, limit: int = 100, domain: str | None = None) -> DataFrame:
    """The newest alerts (1 to 500), of one domain if given, and total: the number of all alerts there are."""
    total = alerts.agg(F.count("*").alias("total"))  # one row
    return recent(alerts, "triggered_at", min(max(int(limit), 1), 500), domain).join(F.broadcast(total), F.lit(True))


def detection_delay(rows: DataFrame, ts: str = "ts", seen: str = "seen_at") -> DataFrame:
    """n, latest_ms (of the row seen last), average_ms, max_ms between a row's time and when it was seen, 0 at least. Rows without either are left out."""
    delay = F.greatest(F.lit(0), F.unix_millis(seen) - F.unix_millis(ts))
    return rows.where(F.col(ts).isNotNull() & F.col(seen).isNotNull()).agg(*delay_metrics(delay, F.struct(seen, ts)))


def delay_metrics(delay: Column, order: Column) -> list[Column]:
    return [F.count("*").alias("n"), F.max_by(delay, order).alias("latest_ms"), F.avg(delay).alias("average_ms"), F.max(delay).alias("max_ms")]


def traffic_per_minute(requests: DataFrame, ts: str = "ts", minutes: int = 60) -> DataFrame:
    """domain, minute, n: the last 60 minutes of each domain that had requests."""
    counted = requests.groupBy("domain", F.date_trunc("minute", ts).alias("minute")).agg(F.count("*").alias("n"))
    return counted.withColumn("r", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("minute")))).where(F.col("r") <= minutes).drop("r")


def top_attacks(rows: DataFrame, column: str, top: int = 10) -> DataFrame:
    """value, n of the most frequent attack types (null: unknown) or addresses (null: left out)."""
    value = F.coalesce(column, F.lit("unknown")) if column == "attack_type" else F.col(column)
    return rows.select(value.alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)


def rule_group_counts(rules: DataFrame) -> DataFrame:
    return rules.groupBy("group").agg(F.count("*").alias("rules"), F.count_if("enabled").alias("enabled"), F.count_if(~F.col("enabled")).alias("disabled"))


def rule_list(rules: DataFrame, q: str | None = None, group: str | None = None, enabled: bool | None = None) -> DataFrame:
    x = rules.where(F.contains(F.lower(F.concat_ws("\n", "id", "description")), F.lit(q.lower()))) if q else rules
    x = x.where(F.col("group") == group) if group else x
    return (x if enabled is None else x.where(F.col("enabled") == enabled)).orderBy(F.desc("score"), "id")


def live_rate(rows: DataFrame, now: datetime, ts: str = "ts") -> DataFrame:
    """last_60s, previous_60s and change_pct before a moment."""
    end, mid, start = now, now - timedelta(seconds=60), now - timedelta(seconds=120)
    seen = rows.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))
    out = seen.agg(F.count_if(F.col(ts) >= F.lit(mid)).alias("last_60s"), F.count_if(F.col(ts) < F.lit(mid)).alias("previous_60s"))
    return out.withColumn("change_pct", change_pct(F.col("last_60s"), F.col("previous_60s")))


def live_traffic(rows: DataFrame, now: datetime, seconds: int = 60, ts: str = "ts") -> DataFrame:
    """average and peak per second of the seconds before a moment, empty ones included."""
    seen = rows.where((F.col(ts) >= F.lit(now - timedelta(seconds=seconds))) & (F.col(ts) < F.lit(now)))
    per = seen.groupBy(F.unix_seconds(F.date_trunc("second", ts)).alias("s")).agg(F.count("*").alias("n"))
    return per.agg((F.coalesce(F.sum("n"), F.lit(0)) / seconds).alias("average"), F.coalesce(F.max("n"), F.lit(0)).alias("peak"))
