"""Operator 9: URL filters by a temporal list join.

A list is a log of dated entries: on a day, a domain goes on it or off it. Entries become validity intervals of their
domain. A capture is listed if its host, or a domain above it, has an interval that holds the time of its fetch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, packed, small, table, with_columns

#: Intervals are cut at multiples of so many days, and joined by (domain, cut): neither a domain with many entries nor one
#: with many captures meets all of the other side in one place.
CUT_DAYS = 30


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user, port and final dot; null if it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """domain, listed_from, listed_until (null: open) of entries (domain, day, listed boolean).

    Of several entries of a domain on one day, going on the list wins. Entries that repeat the state in force change nothing;
    those with a null are left out.
    """
    known = entries.where("domain IS NOT NULL AND day IS NOT NULL AND listed IS NOT NULL")
    daily = known.groupBy(F.lower("domain").alias("domain"), "day").agg(F.max("listed").alias("listed"))
    order = Window.partitionBy("domain").orderBy("day")
    changes = daily.withColumn("before", F.lag("listed", 1, False).over(order)).where(F.col("listed") != F.col("before"))
    until = changes.withColumn("listed_until", F.lead("day").over(order))
    return until.where("listed").select("domain", F.col("day").alias("listed_from"), "listed_until")


def filter_captures(captures: DataFrame, entries: DataFrame, cut_days: int = CUT_DAYS) -> DataFrame:
    """captures' columns (url, fetched: date ..) and host, listed, domain (the longest listed one), listed_from; columns of those names are replaced.

    Rows are kept one for one. Captures whose URL has no host, or without a fetch time, are never listed.
    An interval holds its first day and not its last.
    """
    scratch = Scratch(captures.sparkSession, "url-filter")
    last = captures.agg(F.max("fetched").alias("d")).first()["d"]
    spans = intervals(entries).withColumn("last", F.coalesce(F.date_sub("listed_until", 1), F.greatest("listed_from", F.lit(last).cast("date"))))
    cut = lambda day: F.floor(F.unix_date(day) / cut_days)
    spans = spans.withColumn("cut", F.explode(F.sequence(cut(F.col("listed_from")), cut(F.col("last")))))
    spans = small(scratch.put(spans.select(F.col("domain").alias("on_domain"), F.col("cut").alias("on_cut"), "listed_from", "listed_until")))
    rows = captures.select(packed(captures).alias("row"), host_of(captures["url"]).alias("host"), captures["fetched"].alias("at"))
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    # hosts repeat: each (host, day) is looked up once, which also takes hot hosts together before any shuffle of rows
    asked = rows.where("host IS NOT NULL AND at IS NOT NULL").select("host", "at").distinct()
    asked = asked.select("host", "at", F.explode(above).alias("name"))
    met = asked.join(spans, (F.col("name") == F.col("on_domain")) & (cut(F.col("at")) == F.col("on_cut")) & (F.col("at") >= F.col("listed_from")) & (F.col("listed_until").isNull() | (F.col("at") < F.col("listed_until"))))
    best = met.groupBy("host", "at").agg(F.max_by(F.struct("name", "listed_from"), F.length("name")).alias("best"))
    best = small(scratch.put(best.select(F.col("host").alias("b_host"), F.col("at").alias("b_at"), "best")))
    both = rows.join(best, (rows["host"] == best["b_host"]) & (rows["at"] == best["b_at"]), "left")
    return with_columns(both, "row", host=F.col("host"), listed=F.col("best").isNotNull(), domain=F.col("best.name"), listed_from=F.col("best.listed_from"))


def demo_captures(pages: DataFrame) -> DataFrame:
    """page_id, url and a fetch day of its own: pages has none, so it follows from page_id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int")).alias("fetched"))


def demo_entries(pages: DataFrame) -> DataFrame:
    """A list that follows from the hosts of pages: the domain above each host whose md5 begins with 0-7 goes on it, off it
    and on it again, on days that the md5 gives."""
    domain = F.regexp_extract(host_of(F.col("url")), r"([^.]+\.[^.]+\.[^.]+)$", 1)
    names = pages.select(domain.alias("domain")).where("domain <> ''").distinct()
    digit = lambda i: F.conv(F.substring(F.md5(F.concat(F.lit("list:"), F.col("domain"))), i, 2), 16, 10).cast("int")
    start = F.lit("2023-11-01").cast("date")
    on, off, again = digit(3), F.lit(120) + F.pmod(digit(5), F.lit(120)), F.lit(260) + F.pmod(digit(7), F.lit(150))
    named = names.where(digit(1) < 128)
    events = F.array(*[F.struct(F.date_add(start, d.cast("int")).alias("day"), F.lit(x).alias("listed")) for d, x in ((on, True), (off, False), (again, True))])
    return named.select("domain", F.explode(events).alias("e")).select("domain", "e.*")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_captures(demo_captures(pages), demo_entries(pages)).select("page_id", "host", F.col("fetched").cast("string"), "listed", "domain", F.col("listed_from").cast("string"))


OP9_SQL = r"""
WITH c AS (SELECT page_id, DATE '2024-01-01' + CAST((page_id * 37) % 365 AS INTEGER) AS fetched,
             nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', ''), '') AS host FROM pages),
n AS (SELECT DISTINCT regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) AS domain FROM c WHERE regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) <> ''),
m AS (SELECT domain, md5(concat('list:', domain)) AS h FROM n),
x AS (SELECT domain, CAST(concat('0x', h[1:2]) AS INTEGER) AS d1, CAST(concat('0x', h[3:4]) AS INTEGER) AS d3, CAST(concat('0x', h[5:6]) AS INTEGER) AS d5, CAST(concat('0x', h[7:8]) AS INTEGER) AS d7 FROM m),
e AS (SELECT domain, DATE '2023-11-01' + d3 AS day, true AS listed FROM x WHERE d1 < 128
      UNION ALL SELECT domain, DATE '2023-11-01' + (120 + d5 % 120), false FROM x WHERE d1 < 128
      UNION ALL SELECT domain, DATE '2023-11-01' + (260 + d7 % 150), true FROM x WHERE d1 < 128),
y AS (SELECT domain, day, bool_or(listed) AS listed FROM e GROUP BY ALL),
w AS (SELECT *, lag(listed, 1, false) OVER (PARTITION BY domain ORDER BY day) AS before FROM y),
i AS (SELECT * FROM (SELECT domain, day AS listed_from, listed, lead(day) OVER (PARTITION BY domain ORDER BY day) AS listed_until FROM w WHERE listed <> before) WHERE listed),
j AS (SELECT c.page_id, i.domain, i.listed_from, row_number() OVER (PARTITION BY c.page_id ORDER BY length(i.domain) DESC) AS r FROM c JOIN i
      ON (c.host = i.domain OR c.host LIKE '%.' || i.domain) AND c.fetched >= i.listed_from AND (i.listed_until IS NULL OR c.fetched < i.listed_until))
SELECT c.page_id, c.host, CAST(c.fetched AS VARCHAR) AS fetched, j.domain IS NOT NULL AS listed, j.domain, CAST(j.listed_from AS VARCHAR) AS listed_from FROM c LEFT JOIN j ON j.page_id = c.page_id AND j.r = 1
"""
