"""Column functions over request text: decoding, canonical forms, ids, bands."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The entities that normalisation decodes, in this order, and its limits.
HTML_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&#x27;", "'"), ("&amp;", "&"))
MAX_NORMALIZED, MAX_EVIDENCE = 16_384, 200
SQL_COMMENT = r"/\*[^\r\n]{0,512}?\*/"


def percent_decode(value: Column, plus_as_space: bool = False) -> Column:
    """One layer of percent-encoding. A % without two hex digits stays, bad UTF-8 becomes U+FFFD."""
    guarded = F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(guarded if plus_as_space else F.replace(guarded, F.lit("+"), F.lit("%2B")))


def html_decode(value: Column) -> Column:
    return reduce(lambda c, pair: F.regexp_replace(c, f"(?i){pair[0]}", pair[1]), HTML_ENTITIES, value)


def normalize_request(value: Column, plus_as_space: bool = False) -> Column:
    """Two rounds of percent and HTML decoding; null is empty; cut to 16,384 characters. What holds no mark of either is left alone."""
    text = F.coalesce(value, F.lit(""))
    once = html_decode(percent_decode(text, plus_as_space))
    marked = reduce(or_, [F.contains(text, F.lit(c)) for c in ("%&+" if plus_as_space else "%&")])
    return F.substring(F.when(marked, html_decode(percent_decode(once, plus_as_space))).otherwise(text), 1, MAX_NORMALIZED)


def strip_sql_comments(value: Column) -> Column:
    return F.when(F.contains(value, F.lit("/*")), F.regexp_replace(value, SQL_COMMENT, " ")).otherwise(value)


def url_of(path: Column, query: Column) -> Column:
    return F.when(F.coalesce(query, F.lit("")) == "", path).otherwise(F.concat(path, F.lit("?"), query))


def severity(score: Column) -> Column:
    return F.when(score >= 90, "critical").when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def stable_event_id(*parts: Column) -> Column:
    """Name-based UUID (version 3, no namespace) of the parts joined by |. Null if a part is null."""
    h = F.md5(F.concat(*[x for p in parts for x in (F.lit("|"), p)][1:]))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    pieces = (F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
    return F.concat(*pieces)


def blank_to(value: Column, default: Column | None = None) -> Column:
    """value trimmed, or default if it is null or blank."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), default if default is not None else F.lit(None))


def change_pct(current: Column, previous: Column) -> Column:
    """Change in percent to one decimal, half to even; null if there was nothing before."""
    return F.when(previous != 0, F.bround((current - previous) * 100.0 / previous, 1))
