"""Exact distinct counts that merge: bitmaps of numbered values by unit of time, one stored table for all panels.

count_distinct() reads rows again for each window and multiplies them where there are several. Here a value gets a number once; a unit's rows
of one column are bitmaps of 32,768 numbers each; a window, the one before it and each bucket of a trend are unions of units.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import change_pct
from .stats import TREND_BUCKETS, _span

#: Values are numbered in so many parts at once.
PARTS = 1024


def numbered(rows: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """value, number of the column's distinct values (null has none): whole numbers from 0 without gaps. known: such a table of earlier rows, which is
    kept, and whose numbers go on. Values are dealt to PARTS parts by hash, numbered within each, and the parts' sizes are added up."""
    values = rows.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL").distinct()
    start = F.lit(0).cast("long")
    if known is not None:
        values = values.join(known, "value", "left_anti")
        start = F.lit(known.agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]).cast("long")
    dealt = values.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(PARTS)))
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("size")).select("part", F.coalesce(before, F.lit(0)).alias("before"))  # PARTS rows
    nth = F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1
    new = dealt.withColumn("nth", nth).join(F.broadcast(sizes), "part").select("value", (start + F.col("before") + F.col("nth")).alias("number"))
    return new if known is None else known.select("value", "number").unionByName(new)


def attack_rollup(rows: DataFrame, numbers: dict[str, DataFrame], ts: str = "detected_at", minutes: int = 60) -> DataFrame:
    """unit (number of so many minutes since 1970), minutes, kind, part, bitmap, n: of each column of numbers (kind) the bitmaps of its values
    in the unit; and of kind '' the number of rows, n. Rollups of other rows add to it by union. Rows without a time are left out."""
    at = F.floor(F.unix_micros(ts) / (minutes * 60_000_000)).alias("unit")
    seen = rows.where(F.col(ts).isNotNull())
    none = F.lit(None)
    out = seen.groupBy(at).agg(F.count("*").alias("n")).select("unit", F.lit(minutes).alias("minutes"), F.lit("").alias("kind"), none.cast("long").alias("part"), none.cast("binary").alias("bitmap"), "n")
    for column, table in numbers.items():
        own = seen.select(at, F.col(column).cast("string").alias("value")).distinct().join(table, "value")
        maps = own.groupBy("unit", F.bitmap_bucket_number("number").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap"))
        out = out.unionByName(maps.select("unit", F.lit(minutes).alias("minutes"), F.lit(column).alias("kind"), "part", "bitmap", none.cast("long").alias("n")))
    return out


def merged_counts(rollup: DataFrame, label: Column) -> DataFrame:
    """label, kind, n: rows (kind '') or distinct values of all units that have the label; units whose label is null are left out."""
    x = rollup.withColumn("label", label).where("label IS NOT NULL")
    whole = x.groupBy("label", "kind", "part").agg(F.bitmap_or_agg("bitmap").alias("bitmap"), F.sum("n").alias("rows"))
    return whole.groupBy("label", "kind").agg(F.when(F.col("kind") == "", F.sum("rows")).otherwise(F.sum(F.bitmap_count("bitmap"))).alias("n"))


def _aligned(times: list[datetime], minutes: int) -> list[int]:
    units = [divmod(int((t - datetime(1970, 1, 1)).total_seconds()), minutes * 60) for t in times]
    if any(rest for _, rest in units):
        raise ValueError(f"times must be whole units of {minutes} minutes")
    return [n for n, _ in units]


def kpi_from_rollup(rollup: DataFrame, now: datetime, hours: int = 24, minutes: int = 60) -> DataFrame:
    """The row of stats.kpi_window(), from a rollup with src_ip. now is at the beginning of a unit."""
    first, start, end = _aligned([*_span(now, hours)[:3]], minutes)
    unit = F.col("unit")
    inside = rollup.where((unit >= first) & (unit < end) & F.col("kind").isin("", "src_ip"))
    counts = merged_counts(inside, F.when(unit >= start, "current").otherwise("previous"))
    of = lambda kind, label: F.coalesce(F.max(F.when((F.col("kind") == kind) & (F.col("label") == label), F.col("n"))), F.lit(0)).cast("long")
    out = counts.agg(of("", "current").alias("attacks"), of("", "previous").alias("previous_attacks"), of("src_ip", "current").alias("ips"), of("src_ip", "previous").alias("previous_ips"))
    return out.withColumns({"attacks_pct": change_pct(F.col("attacks"), F.col("previous_attacks")), "ips_pct": change_pct(F.col("ips"), F.col("previous_ips"))})


def trend_from_rollup(rollup: DataFrame, now: datetime, hours: int = 24, minutes: int = 60) -> DataFrame:
    """The rows of stats.attack_trend(), from a rollup with src_ip, domain and rule_id. Buckets begin at the beginnings of units."""
    _, start, _, hours = _span(now, hours)
    step = timedelta(hours=hours) / TREND_BUCKETS
    first, second, end = _aligned([start, start + step, now], minutes)
    inside = rollup.where((F.col("unit") >= first) & (F.col("unit") < end))
    counts = merged_counts(inside, F.floor((F.col("unit") - first) / (second - first)).cast("int"))
    names = {"": "attacks", "src_ip": "ips", "domain": "domains", "rule_id": "rules"}
    wide = counts.groupBy("label").pivot("kind", list(names)).agg(F.max("n"))
    every = rollup.sparkSession.range(TREND_BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    found = every.join(wide, F.col("bucket") == F.col("label"), "left")
    return found.select("bucket", *[F.coalesce(F.col(f"`{k}`"), F.lit(0)).cast("long").alias(n) for k, n in names.items()])
