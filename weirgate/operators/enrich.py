"""Scope, geography, session: what joins to a request before detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import ipv4_number, ipv6_halves, ipv6_network, public_ip
from ..functions.text import blank_to

#: A dimension of at most so many rows is broadcast; counted, as these tables are small and read anyway.
BROADCAST_ROWS = 200_000


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def scope_gate(rows: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Rows whose domain, in lower case, is on the allowlist and enabled there. Null domains are out."""
    enabled = checked_broadcast(allowlist.where("enabled").select(F.lower("target").alias("_target")).distinct())
    return rows.join(enabled, F.lower(rows["domain"]) == enabled["_target"], "left_semi")


def out_of_scope_counts(rows: DataFrame, allowlist: DataFrame) -> DataFrame:
    enabled = checked_broadcast(allowlist.where("enabled").select(F.lower("target").alias("_target")).distinct())
    out = rows.join(enabled, F.lower(rows["domain"]) == enabled["_target"], "left_anti")
    return out.groupBy(F.coalesce(F.lower("domain"), F.lit("unknown")).alias("domain")).agg(F.count("*").alias("skipped"))


def apply_scope_changes(allowlist: DataFrame, changes: DataFrame) -> DataFrame:
    """The next allowlist, by target: changes has op ('upsert' or 'delete') and the allowlist's columns, one row a target."""
    new = changes.select("op", *[F.col(c).alias(f"n_{c}") for c in allowlist.columns])
    both = allowlist.join(new, F.col("target") == F.col("n_target"), "full").where(F.coalesce(F.col("op") != "delete", F.lit(True)))
    return both.select(*[F.when(F.col("op") == "upsert", F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in allowlist.columns]).orderBy("target")


def scope_targets(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of rows with target: in lower case, target_type app if it has no dot, else domain."""
    x = names.withColumn("target", F.lower(F.trim("target")))
    good = F.coalesce(F.col("target").rlike(r"^[a-z0-9]([a-z0-9.\-]{0,251}[a-z0-9])?$"), F.lit(False))
    typed = x.withColumn("target_type", F.when(F.contains("target", F.lit(".")), "domain").otherwise("app"))
    return typed.where(good), x.where(~good)


def seeded_scope(allowlist: DataFrame, seed: str) -> DataFrame:
    """The allowlist, or if it has no row that of the names in "a,b,c": in lower case, enabled, app if there is no dot, note "seeded"."""
    names = allowlist.sparkSession.range(1).select(F.explode(F.split(F.lit(seed), ",")).alias("target"))
    names = names.select(F.lower(F.trim("target")).alias("target")).where("target <> ''").distinct()
    known = {"target": F.col("target"), "target_type": F.when(F.contains("target", F.lit(".")), "domain").otherwise("app"), "enabled": F.lit(True), "note": F.lit("seeded")}
    rows = names.select(*[known.get(c, F.lit(None)).cast(t).alias(c) for c, t in allowlist.dtypes])
    empty = allowlist.agg((F.count("*") == 0).alias("_empty"))  # one row
    return allowlist.unionByName(rows.join(F.broadcast(empty), F.col("_empty"), "left_semi"))


def allowlist_list(allowlist: DataFrame, q: str | None = None, target_type: str | None = None, enabled: bool | None = None) -> DataFrame:
    """The allowlist by target: by a substring in any case of target and note, by type, by whether it is enabled."""
    x = allowlist.where(F.contains(F.lower(F.concat_ws(" ", "target", "note")), F.lit(q.lower()))) if q else allowlist
    x = x.where(F.col("target_type") == target_type) if target_type else x
    return (x if enabled is None else x.where(F.col("enabled") == enabled)).orderBy("target")


def geo_enrich(requests: DataFrame, networks: DataFrame, networks6: DataFrame | None = None) -> DataFrame:
    """requests and geo (struct country_iso, country, city): of the narrowest network that holds src_ip.

    networks: start_ip, end_ip (IPv4 as numbers) ..; networks6: network (IPv6, as address/length) ... Null if the address is not public or
    in no network. Addresses are looked up once each. Those of IPv4 meet the networks of their upper 16 bits only; those of IPv6 are cut
    to each prefix length that occurs, and looked up by equality. Networks that can't be read are left out.
    """
    asked = requests.select("src_ip").distinct().where(public_ip(F.col("src_ip")))
    n = networks.withColumn("block", F.explode(F.sequence(F.shiftright("start_ip", 16), F.shiftright("end_ip", 16))))
    ips = asked.select("src_ip", ipv4_number(F.col("src_ip")).alias("ip")).where("ip IS NOT NULL")
    met = ips.withColumn("block", F.shiftright("ip", 16)).join(n, "block").where(F.col("ip").between(F.col("start_ip"), F.col("end_ip")))
    best = met.groupBy("src_ip").agg(F.min_by(F.struct("country_iso", "country", "city"), F.struct(F.col("end_ip") - F.col("start_ip"), "start_ip")).alias("geo"))
    if networks6 is not None:
        best = best.unionByName(_geo6(asked, networks6))
    return requests.join(best, "src_ip", "left")


def _geo6(asked: DataFrame, networks: DataFrame) -> DataFrame:
    """src_ip, geo of IPv6 addresses in a network, by longest prefix."""
    text = F.trim("network")
    length = F.when(F.contains(text, F.lit("/")), F.substring_index(text, "/", -1).try_cast("int")).otherwise(128)
    n = networks.select(ipv6_halves(F.substring_index(text, "/", 1)).alias("at"), length.alias("bits"), F.struct("country_iso", "country", "city").alias("place"))
    n = n.where(F.col("at").isNotNull() & F.col("bits").between(0, 128)).select("bits", ipv6_network(F.col("at"), F.col("bits")).alias("net"), "place")
    n = n.groupBy("bits", "net.hi", "net.lo").agg(F.min("place").alias("place"))
    lengths = F.broadcast(n.agg(F.collect_set("bits").alias("lengths")))  # one row of 129 numbers at most
    ips = asked.where(F.contains("src_ip", F.lit(":"))).select("src_ip", ipv6_halves(F.col("src_ip")).alias("at"))
    probes = ips.join(lengths, F.lit(True)).select("src_ip", "at", F.explode("lengths").alias("bits"))
    probes = probes.select("src_ip", "bits", ipv6_network(F.col("at"), F.col("bits")).alias("net")).select("src_ip", "bits", "net.hi", "net.lo")
    return probes.join(n, ["bits", "hi", "lo"]).groupBy("src_ip").agg(F.max_by("place", "bits").alias("geo"))


def session_key(cookie: Column, ip: Column) -> Column:
    return blank_to(cookie, F.concat(F.lit("ip-"), blank_to(ip, F.lit("unknown"))))


def _behind(stamp: Column, now: Column, skew_s: int) -> Column:
    """Whether a time is no later than skew_s after now, to the microsecond."""
    return F.unix_micros(stamp) <= F.unix_micros(now) + skew_s * 1_000_000


def map_enriched(rows: DataFrame, now: Column, skew_s: int = 300) -> tuple[DataFrame, DataFrame]:
    """(detector events, rejected with error) of enriched requests with event_id, domain, timestamp and request_ts.

    Texts are cut to their limits, a status outside 100..599 is 0, the time is request_ts or else the envelope's.
    """
    stamp = F.coalesce("request_ts", "timestamp")
    status = F.col("status").try_cast("int")
    checks = [
        (F.coalesce(F.length(F.trim("event_id")).between(1, 128), F.lit(False)), "event_id"),
        (F.coalesce(F.length(F.trim("domain")).between(1, 255), F.lit(False)), "domain"),
        (F.coalesce(F.length(F.trim("src_ip")).between(1, 64), F.lit(False)), "src_ip"),
        (stamp.isNotNull(), "timestamp"),
        (F.coalesce(_behind(stamp, now, skew_s), F.lit(True)), "timestamp in the future"),
    ]
    cut = lambda c, n: F.substring(c, 1, n)
    x = rows.withColumn("error", F.coalesce(*[F.when(~ok, name) for ok, name in checks]))
    x = x.withColumns(
        {
            "event_ts": stamp,
            "method": cut(F.upper(blank_to(F.col("method"), F.lit("-"))), 16),
            "path": cut(blank_to(F.col("path"), F.lit("-")), 4096),
            "query_string": cut(F.coalesce("query_string", F.lit("")), 8192),
            "user_agent": cut(F.coalesce("user_agent", F.lit("")), 2048),
            "referer": cut(F.coalesce("referer", F.lit("")), 4096),
            "status": F.when(status.between(100, 599), status).otherwise(0),
        }
    )
    return x.where("error IS NULL").drop("error"), x.where("error IS NOT NULL")


def map_flat(rows: DataFrame, now: Column, skew_s: int = 300) -> tuple[DataFrame, DataFrame]:
    """As map_enriched, of flat requests with method, path, status, headers (map) and body, which are checked more strictly."""
    status = F.coalesce(F.col("status").try_cast("int"), F.lit(200))
    checks = [
        (F.coalesce(F.col("method").rlike("^[A-Z]{1,16}$"), F.lit(False)), "method"),
        (F.coalesce(F.startswith("path", F.lit("/")), F.lit(False)), "path"),
        (status.between(100, 599), "status"),
        (F.coalesce(F.size("headers") <= 100, F.lit(True)), "headers"),
        (F.coalesce(F.forall(F.map_keys("headers"), lambda k: F.length(k) <= 128), F.lit(True)), "header name"),
        (F.coalesce(F.length("body") <= 8192, F.lit(True)), "body"),
        (F.coalesce(_behind(F.col("timestamp"), now, skew_s), F.lit(False)), "timestamp"),
    ]
    lower = F.map_from_entries(F.transform(F.map_entries("headers"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    x = rows.withColumn("error", F.coalesce(*[F.when(~ok, name) for ok, name in checks])).withColumns({"status": status, "event_ts": F.col("timestamp")})
    good = x.where("error IS NULL").drop("error").withColumn("headers", F.when(F.col("headers").isNotNull(), lower))
    return good, x.where("error IS NOT NULL")
