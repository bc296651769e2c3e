"""Rules against requests: one narrow pass, all rules in one array expression."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import needed_literals, to_java
from ..functions.text import MAX_EVIDENCE, normalize_request, strip_sql_comments

FIELDS = ("url", "query", "body")


def with_variants(requests: DataFrame) -> DataFrame:
    """Adds v_<field>_<raw|plain|sql> of url, query and body, and arrays of these for headers, user agent and referer; and l_.., the same in lower
    case, arrays as one text, null if they aren't all ASCII.

    Requests have path and query_string, and may have body, user_agent, referer and headers (map). Each variant is made once and
    serves all rules. Header values stand in the order user agent, referer, others by name; empty ones are left out.
    """
    has = lambda c: F.col(c) if c in requests.columns else F.lit(None).cast("string")
    raw = {"url": (F.col("path"), False), "query": (F.col("query_string"), True), "body": (has("body"), True)}
    out = requests
    for field, (value, plus) in raw.items():
        out = out.withColumn(f"v_{field}_raw", F.coalesce(value, F.lit(""))).withColumn(f"v_{field}_plain", normalize_request(value, plus))
    none = F.array().cast("array<string>")
    for field in ("user_agent", "referer"):  # one value or none each, so that no higher-order function is needed, which would be interpreted
        value = F.coalesce(has(field), F.lit(""))
        kinds = {"raw": value, "plain": normalize_request(value)}
        out = out.withColumns({f"h_{field}_{k}": v for k, v in kinds.items()}).withColumn(f"h_{field}_sql", strip_sql_comments(F.col(f"h_{field}_plain")))
        out = out.withColumns({f"v_{field}_{k}": F.when(value != "", F.array(f"h_{field}_{k}")).otherwise(none) for k in ("raw", "plain", "sql")}).drop(*[f"h_{field}_{k}" for k in ("raw", "plain", "sql")])
    if "headers" in requests.columns:
        named = F.map_filter("headers", lambda k, v: ~F.lower(k).isin("user-agent", "referer") & v.isNotNull() & (v != ""))
        out = out.withColumn("v_others_raw", F.coalesce(F.transform(F.array_sort(F.map_entries(named)), lambda e: e["value"]), none))
        out = out.withColumn("v_others_plain", F.transform("v_others_raw", lambda v: normalize_request(v))).withColumn("v_others_sql", F.transform("v_others_plain", strip_sql_comments))
    lists = ("user_agent", "referer", "headers")
    others = lambda k: [F.col(f"v_others_{k}")] if "headers" in requests.columns else []
    out = out.withColumns({f"v_headers_{k}": F.concat(F.col(f"v_user_agent_{k}"), F.col(f"v_referer_{k}"), *others(k)) for k in ("raw", "plain", "sql")})
    out = out.withColumns({f"v_{f}_sql": strip_sql_comments(F.col(f"v_{f}_plain")) for f in raw})
    joined = {(f, k): F.col(f"v_{f}_{k}") if f in raw else F.array_join(f"v_{f}_{k}", "\n") for f in (*raw, *lists) for k in ("raw", "plain", "sql")}
    return out.withColumns({f"l_{f}_{k}": F.when(F.octet_length(v) == F.char_length(v), F.lower(v)) for (f, k), v in joined.items()})


def _variant(normalizers: list[str]) -> str:
    return "sql" if "sql_canonical" in normalizers else "plain" if {"url_decode", "html_decode"} & set(normalizers) else "raw"


def _hit(rule, pattern: str, whole_value: bool) -> Column:
    kind = _variant(rule["normalizers"] or [])
    literals = needed_literals(rule["pattern"])

    def found(field: str, value: Column) -> Column:
        fields = [F.lit(field).alias("field"), F.regexp_extract(value, pattern, 0).alias("matched_value")]
        return F.struct(*fields, value.alias("value")) if whole_value else F.struct(*fields)

    def possible(field: str) -> Column:
        """Whether the field may match: it holds one of the texts that any match holds, or isn't ASCII. That is far cheaper than the pattern."""
        lower = F.col(f"l_{field}_{kind}")
        return lower.isNull() | reduce(or_, [F.contains(lower, F.lit(x)) for x in literals]) if literals else F.lit(True)

    hits = [F.when(possible(f) & F.col(f"v_{f}_{kind}").rlike(pattern), found(f, F.col(f"v_{f}_{kind}"))) for f in FIELDS if f in rule["targets"]]
    for target in ("headers", "user_agent", "referer"):
        if target in rule["targets"]:
            matching = F.filter(f"v_{target}_{kind}", lambda v: v.rlike(pattern))
            hits.append(F.when(possible(target), F.get(F.transform(matching, lambda v: found("headers", v)), F.lit(0))))
    return F.coalesce(*hits)


def rule_matches(requests: DataFrame, rules: DataFrame, whole_value: bool = False) -> DataFrame:
    """requests' columns and rule_id, rule_group, rule_name, rule_score, field, matched_value: a row for each enabled rule that matches.

    Only a rule's first field that matches counts. Rules are a catalogue of a few dozen rows, which the driver compiles to one
    array expression; requests aren't shuffled.
    """
    compiled = []
    for r in sorted(rules.where("enabled").collect()):
        hit = _hit(r, to_java(r["pattern"]), whole_value)
        named = [F.lit(r["id"]).alias("rule_id"), F.lit(r["group"]).alias("rule_group"), F.lit(r["description"]).alias("rule_name"), F.lit(r["score"]).alias("rule_score"), hit.alias("hit")]
        compiled.append(F.struct(*named))
    if not compiled:
        raise ValueError("no enabled rule")
    # the array is a column before it is exploded: a generator's own expressions are interpreted, as are those below a higher-order function.
    # outer, as the optimizer would else copy the whole array into a filter below
    found = with_variants(requests).select(*requests.columns, F.array(*compiled).alias("_hits"))
    found = found.select(*requests.columns, F.explode_outer("_hits").alias("m")).where("m.hit IS NOT NULL")
    extra = [F.col("m.hit.value").alias("value")] if whole_value else []
    return found.select(*requests.columns, "m.rule_id", "m.rule_group", "m.rule_name", "m.rule_score", "m.hit.field", F.substring("m.hit.matched_value", 1, MAX_EVIDENCE).alias("matched_value"), *extra)


def rule_test(rules: DataFrame, samples: DataFrame) -> DataFrame:
    """sample, rule_id, field, matched_value, start, end (in the normalised value): samples are `path?query`."""
    text = F.trim("sample")
    mark = F.instr(text, "?")
    requests = samples.select(
        "sample",
        F.when(mark > 0, F.substring(text, F.lit(1), mark - 1)).otherwise(text).alias("path"),
        F.when(mark > 0, F.substring(text, mark + 1, F.length(text))).otherwise("").alias("query_string"),
    )
    found = rule_matches(requests, rules, whole_value=True)
    start = F.call_function("locate", F.col("matched_value"), F.col("value")) - 1
    return found.select("sample", "rule_id", "field", "matched_value", start.alias("start"), (start + F.length("matched_value")).alias("end"))
