"""Access-log lines to normalised requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent_decode

# The forms of a line and of its request.
#: One line of the combined format, with optional host, time taken and session id. Groups: 1 address, 2 user, 3 time,
#: 4 request, 5 status, 6 bytes, 7 referer, 8 user agent, 9 host, 10 seconds, 11 microseconds, 12 session id.
LINE = (
    r'^(\S+) \S+ (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}|-) (\d+|-) "((?:[^"\\]|\\.)*)" "((?:[^"\\]|\\.)*)"'
    r'(?: "([^"]*)")?(?: rt=([\d.]+)| rt_us=(\d+))?(?: sid="([^"]*)")?\s*$'
)
REQUEST = r"^([A-Z!-~]+) (\S+) (HTTP/[\d.]+)$"
#: Stands between the groups of a match while one regular expression a text takes them all apart.
MARK = "\x01"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def explode_raw_lines(raw: DataFrame, column: str = "raw") -> DataFrame:
    """raw's other columns, line_no and line: a row for each line of a block that isn't blank."""
    lines = raw.select(*[c for c in raw.columns if c != column], F.posexplode(F.split(column, LINE_BREAK)).alias("line_no", "line"))
    return lines.where(F.trim("line") != "")


def _dash(c: Column) -> Column:
    return F.when(c == "-", "").otherwise(c)


def _groups(text: Column, pattern: str, n: int) -> Column:
    """The n groups of an anchored pattern as an array, null if it doesn't match: one match a text, as long as MARK isn't in it."""
    marked = F.split(F.regexp_replace(text, pattern, MARK + MARK.join(f"${i}" for i in range(1, n + 1))), MARK)
    one_by_one = F.when(text.rlike(pattern), F.array(F.lit(""), *[F.regexp_extract(text, pattern, i) for i in range(1, n + 1)]))
    return F.when(F.contains(text, F.lit(MARK)), one_by_one).when(F.size(marked) == n + 1, marked)


def parse_access_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, invalid) of rows with line, and domain and log_source if there are any; their other columns stay.

    A request line of another form keeps the whole of it as path. A host that is missing is the domain.
    """
    # exploding an array of one value holds it: no later column or filter works it out again
    parts = lines.select("*", F.explode(F.array(_groups(F.col("line"), LINE, 12))).alias("_p"))
    invalid = parts.where("_p IS NULL").drop("_p").withColumn("error", F.lit("line does not match the combined log format"))
    g = lambda i: F.get("_p", F.lit(i))
    parts = parts.where("_p IS NOT NULL").select("*", F.explode(F.array(_groups(g(4), REQUEST, 3))).alias("_r"))
    r = lambda i: F.coalesce(F.get("_r", F.lit(i)), F.lit(""))
    parts = parts.withColumn("_target", F.coalesce(F.get("_r", F.lit(2)), g(4)))
    mark = F.instr("_target", "?")
    path = F.when(mark > 0, F.substring(F.col("_target"), F.lit(1), mark - 1)).otherwise(F.col("_target"))
    query = F.when(mark > 0, F.substring(F.col("_target"), mark + 1, F.length("_target"))).otherwise("")
    domain = F.col("domain") if "domain" in lines.columns else F.lit("")
    parsed = parts.withColumns(
        {
            "src_ip": g(1),
            "remote_user": _dash(g(2)),
            "method": r(1),
            "path": path,
            "query_string": query,
            "protocol": r(3),
            "status": F.try_to_number(g(5), F.lit("999")).cast("int"),
            "body_bytes": F.when(g(6) == "-", 0).otherwise(g(6).try_cast("long")).cast("long"),
            "referer": _dash(g(7)),
            "user_agent": _dash(g(8)),
            "host": F.coalesce(F.nullif(g(9), F.lit("")), domain),
            "request_time": F.coalesce(g(10).try_cast("double"), g(11).try_cast("double") / 1_000_000),
            "session_id": _dash(g(12)),
            "request_ts": F.try_to_timestamp(g(3), F.lit("dd/MMM/yyyy:HH:mm:ss Z")),
            "log_time_raw": g(3),
        }
    )
    decoded = parsed.withColumns({"path_decoded": percent_decode(F.col("path")), "query_decoded": percent_decode(F.col("query_string"))})
    return decoded.drop("_p", "_r", "_target"), invalid


def parse_blocks(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, rejected blocks) of rows with block_id and raw: a block is rejected only if none of its lines is valid."""
    parsed, invalid = parse_access_log(explode_raw_lines(raw))
    return parsed, invalid.select("block_id").distinct().join(parsed.select("block_id").distinct(), "block_id", "left_anti")
