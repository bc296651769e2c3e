"""Rules against requests: what a pattern needs, and that looking for it first changes nothing."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from weirgate.functions.regex import lint, needed_literals, to_java
from weirgate.operators import matching
from weirgate.sources.rules import DEFAULT_RULES, SCHEMA, default_rules


@pytest.mark.parametrize(("pattern", "want"), [
    ("(?i)Union\\s+select\\b", ("select",)), ("abc", ("abc",)), ("a?b*", None), ("(?:cat|dog)+x", ("x",)), ("(?:cat|dog)+", ("cat", "dog")), ("(cat|[ab])", None),
    ("[abc]+", None), ("x{0,3}yz", ("yz",)), ("(?:ab){2}", ("ab",)), ("^/\\.env$", ("/.env",)), ("a.b", ("a",)), ("(", None), ("\\pN", None), ("é", None), ("é+abc", ("abc",)), ("", None),
])
def test_needed_literals(pattern, want):
    assert needed_literals(pattern) == want


def test_every_match_holds_a_needed_literal():
    rng, met = random.Random(1), set()
    pieces = ["union", " select ", "' or 1=1", "../", "..%2f", ";cat ", "{{x}}", "<script>", "onload=", "/etc/passwd", "nc -e", "file=http://", "/.git", ".bak", "sqlmap", "${jndi:ldap:", "php://input", "javascript:x", "sleep(", "'--", "a", " ", "=", "x" * 5]
    for *_, pattern in DEFAULT_RULES:
        literals = needed_literals(pattern)
        for _ in range(3000):
            text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6)))
            text = "".join(c.upper() if rng.random() < 0.3 else c for c in text)
            if re.search(pattern, text):
                met.add(pattern)
                assert literals is None or any(x in text.lower() for x in literals), (pattern, text)
    assert len(met) >= 18


def test_matches_with_and_without_literals(spark, monkeypatch):
    """The same rows as without the filter: odd cases of letters, values that aren't ASCII, headers in a map, nulls."""
    rng = random.Random(2)
    bits = ["union", "SELECT", "uNıon", "ſelect", "selECT", " ", "%20", "%2520", "/*x*/", "<Script>", "ſcript", "&lt;script&gt;", "../", "%2e%2e%2f", ";ls", "'--", "é", "K", "a", "=", "1", "or 1=1", "%27", "+", "{{", "}}", "nikto"]
    value = lambda: rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randrange(1, 7)))])
    rows = [(i, value() or "/", value(), value(), value(), value(), rng.choice([None, {"X-A": value(), "User-Agent": value(), "b": value()}])) for i in range(600)]
    df = spark.createDataFrame(rows, "request_id long, path string, query_string string, body string, user_agent string, referer string, headers map<string,string>")
    custom = [("ANY_LETTER", "g", "d", True, ["url", "referer"], "(?i)k[a-z]", 50, ["url_decode"]), ("IN_HEADERS", "g", "d", True, ["headers"], "(?i)select|nikto", 50, []), ("SQL_BODY", "g", "d", True, ["body", "user_agent"], "(?i)union ?select", 50, ["sql_canonical"])]
    rules = default_rules(spark).unionByName(spark.createDataFrame(custom, SCHEMA))
    found = lambda: sorted(map(tuple, matching.rule_matches(df, rules).select("request_id", "rule_id", "field", "matched_value").collect()))
    with_filter = found()
    monkeypatch.setattr(matching, "needed_literals", lambda p: None)
    assert with_filter == found() and len(with_filter) > 300 and {x[2] for x in with_filter} == {"url", "query", "body", "headers"}
    plain = matching.with_variants(df).select("request_id", "v_headers_raw", "v_user_agent_plain").orderBy("request_id").collect()
    for r, row in zip(plain, rows, strict=True):
        named = {k.lower(): v for k, v in (row[6] or {}).items()}
        assert r.v_headers_raw == [v for v in (row[4], row[5], named.get("x-a"), named.get("b")) if v] and len(r.v_user_agent_plain) == bool(row[4])


def test_only_enabled_rules(spark):
    df = spark.createDataFrame([(1, "/x", "sqlmap")], "request_id long, path string, user_agent string").withColumn("query_string", F.lit(None).cast("string"))
    with pytest.raises(ValueError):
        matching.rule_matches(df, default_rules(spark).withColumn("enabled", F.lit(False)))
    assert [r.rule_id for r in matching.rule_matches(df, default_rules(spark)).collect()] == ["SCANNER_TOOL_UA"]


PATTERNS = [
    r"(?i)a[\s$]$", r"(?m)^b$", "a{,2}", "b{x}", "x{", "[]a]+", "[a&&b]", "[a[b]", "[^]a]", r"(?P<one>a+)(?P<two_2>b)", r"\pN+", r"\p{Greek}", r"\PL", r"\p{^Lu}+", r"\P{^Lu}", r"\Qa.b*\E+", r"\Q(", r"a\Q\E*",
    "(?:a{100}){10}", "(a?){3}b", "a+?b", "a*?", "(?i:a)B", "(?i)a(?-i)b", "(?s).", "(?s:.)b", "a.b", r"\101", r"\x41\x{42}", "[[:alpha:]_]+", "[[:^digit:]]", "[[:word:]-]", r"\v", r"[\v\s]", r"a\z", r"\Aa", r"\bab\b", r"[\S]", r"\S", r"[^\s]b", r"\.", r"\-", r"[a\-z]", r"\_", "a|", "|a", "()", "(|b)", "é+", r"[à-ü]", "(?i)É", "(?i)k", "(?i)ſ", "~", "[~a]", "a#b", "(?i)straße", r"[\d\W]+", "(?P<1>x)", r"[\x41-\x43\d]", r"[+--]", r"[a-c-e]", r"[\t-\r]", r"\07", r"\n",
    # refused
    "a**", "a++", "a?+", "a{2}{3}", "(?:a{100}){11}", "(?:(?:a{10}){10}){11}", "a{1001}", "a{5,2}", "*a", "a|*", "(*a)", "(?=a)", "(?!a)", "(?<=a)b", "(?<!a)b", "(?>a)", r"(a)\1", r"\2", "(", ")", "(a", "a)", "[a", "[", "[z-a]", r"[a-\d]", r"[\x43-\x41]", "a\\", r"\h", r"\Z", r"\G", r"\R", r"\X", r"\K", r"\k<a>", r"\e", r"\cA", r"\u0041", r"\xZZ", r"\x{110000}", "[[:nope:]]", r"[\b]", r"[\z]", "(?P=a)", "(?x)a", "(?d)a", "(?u)a", "(?#c)", "(?", "(?i", r"[\Qa]",
]
TEXTS = ["", "a", "b", "ab", "aab", "AB", "a\nb", "b\n", "a\n", "x", "x{", "a{,2}", "b{x}", "]", "&", "[", "a.b*", "a.b**", "(", "\x0b", "\u2028", "a\u2028b", "a\rb", "A", "12", "١", "α", "Ω", "É", "é", "K", "k", "ſ", "s", "_", "-", "~", "#", "a#b", "a" * 1000, "STRASSE", "straße", "Lu", "\t", " ", "ü", "\x07", "aaab"]


def _re2(pattern):
    """What RE2 says, as DuckDB has it: None if it refuses the pattern, else the first match in each text, or None."""
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(?) AS x, generate_subscripts(?, 1) AS i", [TEXTS, TEXTS])
    quoted = "'" + pattern.replace("'", "''") + "'"
    try:
        rows = con.execute(f"SELECT CASE WHEN regexp_matches(x, {quoted}, 'c') THEN regexp_extract(x, {quoted}, 0, 'c') END FROM t ORDER BY i").fetchall()
    except duckdb.Error:
        return None
    return [r[0] for r in rows]


def test_dialect_against_re2(spark):
    """The same patterns are refused, and the same texts are found."""
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, x string").coalesce(1)
    odd, found, wanted = [], [], []
    for pattern in PATTERNS:
        want, error = _re2(pattern), lint(pattern)
        if (want is None) != (error is not None):
            odd.append((pattern, error, "refused" if want is None else "accepted"))
        elif error is None:
            java = to_java(pattern)
            found.append(F.when(F.col("x").rlike(java), F.regexp_extract("x", java, 0)).alias(f"p{len(found)}"))
            wanted.append((pattern, java, want))
    rows = df.orderBy("i").select(*found).collect()
    for (pattern, java, want), got in zip(wanted, zip(*rows, strict=True), strict=True):
        odd += [(pattern, java, t, g, w) for t, g, w in zip(TEXTS, got, want, strict=True) if g != w]
    assert not odd, "\n".join(map(repr, odd))


def test_dialect_beside_re2():
    assert lint("(?P<a>x)(?P<a>y)") == "name of two groups" and to_java("(?<n>a)") == "(?d)(a)"
    assert lint("x{2}{3}") == "repeat of a repeat" and lint(r"(a)\\1") is None and lint(r"(a)\1") == "back reference"
