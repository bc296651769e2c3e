"""DuckDB SQL of the registered queries. CTES names the common parts; with_() puts together what a query needs."""

from __future__ import annotations

from ..operators.metrics import SCORE_BOUNDS, STAGES
from ..sources.rules import DEFAULT_RULES
from .views import HOURS, NOW, REQUESTS


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _rules() -> str:
    rows = ", ".join(f"({_quote(i)}, {_quote(g)}, {_quote(d)}, {s}, {_quote(t)}, {_quote(n)}, {_quote(p)})" for i, g, d, t, s, n, p in DEFAULT_RULES)
    return f"SELECT * FROM (VALUES {rows}) AS r(rule_id, rule_group, rule_name, rule_score, targets, normalizers, pattern)"


def _html(x: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&#x27;", "''"), ("&amp;", "&")):
        x = f"regexp_replace({x}, '(?i){entity}', '{char}', 'g')"
    return x


def _plain(x: str, plus: bool) -> str:
    for _ in range(2):
        x = _html(f"url_decode({f'replace({x}, chr(43), chr(32))' if plus else x})")
    return x


def _variant(field: str, plus: bool) -> str:
    plain, sql = f"{field}_plain", f"{field}_sql"
    return f"CASE WHEN normalizers LIKE '%sql_canonical%' THEN {sql} WHEN normalizers <> '' THEN {plain} ELSE {field}_raw END"


def _uuid(parts: str) -> str:
    h = f"md5({parts})"
    return f"concat({h}[1:8], '-', {h}[9:12], '-3', {h}[14:16], '-', substr('89ab89ab89ab89ab', strpos('0123456789abcdef', {h}[17:17]), 1), {h}[18:20], '-', {h}[21:32])"


def _severity(x: str) -> str:
    return f"CASE WHEN {x} >= 90 THEN 'critical' WHEN {x} >= 70 THEN 'high' WHEN {x} >= 40 THEN 'medium' ELSE 'low' END"


_URL = "CASE WHEN query_string = '' THEN path ELSE concat(path, '?', query_string) END"
_SQLC = lambda x: rf"regexp_replace({x}, '/\*[^\r\n]{{0,512}}?\*/', ' ', 'g')"
_START, _BEFORE = f"(TIMESTAMP '{NOW}' - INTERVAL {HOURS} HOUR)", f"(TIMESTAMP '{NOW}' - INTERVAL {2 * HOURS} HOUR)"
_COOL = lambda src, key, gap: f"""{src}_f AS (SELECT {key} AS k, min(second) AS s FROM {src} GROUP BY 1
  UNION ALL SELECT f.k, (SELECT min(q.second) FROM {src} q WHERE q.{key} = f.k AND q.second >= f.s + {gap}) FROM {src}_f f
  WHERE EXISTS (SELECT 1 FROM {src} q WHERE q.{key} = f.k AND q.second >= f.s + {gap}))"""  # noqa: E731

CTES = {
    "requests": ([], REQUESTS.replace("{us}", "epoch_us(e.ts)").replace("{ts}", "e.ts").replace("{events}", "events")),
    "rules": ([], _rules()),
    "variants": (
        ["requests"],
        f"SELECT *, {_SQLC('url_plain')} AS url_sql, {_SQLC('query_plain')} AS query_sql, {_SQLC('ua_plain')} AS ua_sql FROM (SELECT *, path AS url_raw, query_string AS query_raw, user_agent AS ua_raw, {_plain('path', False)} AS url_plain, {_plain('query_string', True)} AS query_plain, {_plain('user_agent', False)} AS ua_plain FROM (SELECT DISTINCT path, query_string, user_agent FROM requests))",
    ),
    "pairs": (["variants", "rules"], f"SELECT path, query_string, user_agent, r.*, {_variant('url', False)} AS u, {_variant('query', True)} AS q, {_variant('ua', False)} AS a FROM variants, rules r"),
    "hits": (
        ["pairs"],
        """SELECT *, CASE field WHEN 'url' THEN u WHEN 'query' THEN q ELSE a END AS v FROM (SELECT *, CASE WHEN targets LIKE '%url%' AND regexp_matches(u, pattern) THEN 'url'
         WHEN targets LIKE '%query%' AND regexp_matches(q, pattern) THEN 'query' WHEN (targets LIKE '%headers%' OR targets LIKE '%user_agent%') AND a <> '' AND regexp_matches(a, pattern) THEN 'headers' END AS field FROM pairs) WHERE field IS NOT NULL""",
    ),
    "matches": (["hits", "requests"], "SELECT requests.*, rule_id, rule_group, rule_name, rule_score, field, left(regexp_extract(v, pattern), 200) AS matched_value FROM requests JOIN hits USING (path, query_string, user_agent)"),
    "attacks": (
        ["matches"],
        f"SELECT {_uuid("concat('attack.detected|', request_id, '|', rule_id)")} AS event_id, ts AS detected_at, lower(domain) AS domain, rule_group AS attack_type, {_severity('rule_score')} AS severity, rule_id, rule_name, src_ip, method, {_URL} AS url, lower(domain) AS host, status, user_agent, rule_score AS score, field, matched_value, request_id, session_id FROM matches",
    ),
    "windowed": (
        ["requests"],
        r"""SELECT r.*, concat(lower(r.domain), '|', r.src_ip) AS client, x.requests, x.errors, x.distinct_paths FROM requests r JOIN (
         SELECT a.seq, count(*) AS requests, count(*) FILTER (WHERE b.counted AND b.status >= 400) AS errors, count(DISTINCT b.path) FILTER (WHERE b.counted) AS distinct_paths
         FROM requests a JOIN (SELECT *, NOT regexp_matches(path, '(?i)\.(?:ico|css|js|mjs|png|jpe?g|gif|svg|webp|woff2?|ttf|eot|map|txt)$') AS counted FROM requests) b
         ON lower(a.domain) = lower(b.domain) AND a.src_ip = b.src_ip AND b.ts_s > a.ts_s - 60 AND (b.ts_s < a.ts_s OR b.ts_s = a.ts_s AND b.seq <= a.seq) GROUP BY a.seq) x ON x.seq = r.seq""",
    ),
    "scored": (
        ["windowed", "matches"],
        f"""SELECT *, {_severity('score')} AS severity, rules > 0 OR score >= 40 AS emitted FROM (SELECT w.*, coalesce(m.rules, 0) AS rules, m.rule_ids, m.groups,
         coalesce(m.top + 10 * (m.rules - 1), 0) AS by_rules, CASE WHEN requests >= 20 THEN 30 ELSE 0 END + CASE WHEN requests >= 100 THEN 40 ELSE 0 END + CASE WHEN errors >= 8 THEN 25 ELSE 0 END + CASE WHEN distinct_paths >= 12 THEN 25 ELSE 0 END AS by_behaviour, least(100, by_rules + by_behaviour) AS score,
         list_filter([CASE WHEN requests >= 20 THEN 'request_burst' END, CASE WHEN requests >= 100 THEN 'request_flood' END, CASE WHEN errors >= 8 THEN 'http_error_burst' END, CASE WHEN distinct_paths >= 12 THEN 'path_scan' END], lambda x: x IS NOT NULL) AS reasons
         FROM windowed w LEFT JOIN (SELECT request_id, max(rule_score) AS top, count(*) AS rules, list(DISTINCT rule_id ORDER BY rule_id) AS rule_ids, list(DISTINCT rule_group ORDER BY rule_group) AS groups FROM matches GROUP BY 1) m USING (request_id))""",
    ),
    "typed": (
        ["scored"],
        "SELECT *, CASE WHEN rules > 0 THEN groups ELSE list_filter([CASE WHEN list_contains(reasons, 'request_burst') OR list_contains(reasons, 'request_flood') THEN 'traffic_flood' END, CASE WHEN list_contains(reasons, 'http_error_burst') THEN 'error_scan' END, CASE WHEN list_contains(reasons, 'path_scan') THEN 'path_scan' END], lambda x: x IS NOT NULL) END AS attack_types FROM scored",
    ),
    "due": (["typed"], "SELECT *, ts_s AS second FROM typed WHERE score >= 70"),
    "due_f": (["due"], None),
    "alerts": (["due", "due_f"], "SELECT d.*, NOT (row_number() OVER (PARTITION BY d.client, d.second ORDER BY d.seq) = 1 AND f.s IS NOT NULL) AS suppressed FROM due d LEFT JOIN due_f f ON f.k = d.client AND f.s = d.second"),
    "sent": (["alerts"], "SELECT * FROM alerts WHERE NOT suppressed"),
    "labels_": (
        ["requests"],
        """SELECT *, CASE WHEN category = 'benign' THEN 'benign' ELSE 'attack' END AS label FROM (SELECT request_id, src_ip AS ip, CASE WHEN query_string LIKE '%UNION%' THEN 'sql_injection' WHEN query_string LIKE '%script%' THEN 'xss' WHEN query_string LIKE '%passwd%' THEN 'lfi'
         WHEN path LIKE '/old-%' THEN 'scan' WHEN query_string LIKE 'q=O%' THEN 'ssti' ELSE 'benign' END AS category, CASE WHEN seq % 50 = 0 THEN 0 ELSE status END AS status, CAST(ts_s AS DOUBLE) AS t FROM requests)""",
    ),
    "observed": (["labels_"], "SELECT * FROM labels_ WHERE status <> 0"),
    "ablated": (
        ["scored"],
        """SELECT 'A' AS config, request_id, client, src_ip, seq, ts_s AS second, rules, least(100, by_rules) AS score FROM scored
         UNION ALL SELECT 'B', request_id, client, src_ip, seq, ts_s, 0, least(100, by_behaviour) FROM scored
         UNION ALL SELECT 'C', request_id, client, src_ip, seq, ts_s, rules, score FROM scored""",
    ),
    "adue": (["ablated"], "SELECT *, concat(config, '|', client) AS k0 FROM ablated WHERE score >= 70"),
    "adue_f": (["adue"], None),
    "alerted": (["adue", "adue_f"], "SELECT config, src_ip AS ip, request_id, seq FROM (SELECT d.*, row_number() OVER (PARTITION BY k0, second ORDER BY seq) AS r FROM adue d) d JOIN adue_f f ON f.k = d.k0 AND f.s = d.second WHERE r = 1"),
    "detected": (["ablated"], "SELECT config, request_id FROM ablated WHERE rules > 0"),
    "marked": (["observed", "detected"], "SELECT c.config, o.category, o.label <> 'benign' AS positive, d.request_id IS NOT NULL AS detected FROM observed o CROSS JOIN (SELECT DISTINCT config FROM detected) c LEFT JOIN detected d ON d.config = c.config AND d.request_id = o.request_id WHERE o.label = 'benign' OR o.category NOT IN ('benign', 'scan', 'flood')"),
    "actors": (["observed"], "SELECT ip, CASE WHEN bool_or(category NOT IN ('benign', 'scan', 'flood')) THEN 'payload_attacker' WHEN bool_or(category = 'scan') THEN 'scanner' WHEN bool_or(category = 'flood') THEN 'flooder' WHEN ip LIKE '66.249.%' THEN 'benign_crawler' ELSE 'benign_visitor' END AS actor FROM observed GROUP BY ip"),
}


def with_(body: str, *names: str) -> str:
    order: list[str] = []

    def need(n: str) -> None:
        for d in CTES[n][0]:
            need(d)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    parts = [_COOL(n[:-2], "client" if n == "due_f" else "k0", 15) if n in ("due_f", "adue_f") else f"{n} AS ({CTES[n][1]})" for n in order]
    return f"WITH RECURSIVE {', '.join(parts)} {body}"


def confusion(source: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    r = lambda a, b: f"CASE WHEN ({b}) <> 0 THEN round_even(CAST({a} AS DOUBLE) / ({b}), 4) END"
    return f"""SELECT {key}tp, fp, fn, tn, precision, recall, fpr, CASE WHEN precision > 0 AND recall > 0 THEN round_even(2 * precision * recall / (precision + recall), 4) ELSE 0.0 END AS f1
    FROM (SELECT *, {r('tp', 'tp + fp')} AS precision, {r('tp', 'tp + fn')} AS recall, {r('fp', 'fp + tn')} AS fpr FROM (SELECT {key}count(*) FILTER (WHERE positive AND detected) AS tp, count(*) FILTER (WHERE NOT positive AND detected) AS fp,
    count(*) FILTER (WHERE positive AND NOT detected) AS fn, count(*) FILTER (WHERE NOT positive AND NOT detected) AS tn FROM {source} {f'GROUP BY {by}' if by else ''}))"""


IN_WINDOW = f"detected_at >= {_START} AND detected_at < TIMESTAMP '{NOW}'"
IN_BOTH = f"detected_at >= {_BEFORE} AND detected_at < TIMESTAMP '{NOW}'"
CURRENT = f"detected_at >= {_START}"
BUCKET = f"CAST(floor((epoch_us(detected_at) - epoch_us({_START})) / {HOURS * 3600 / 24 * 1e6}) AS INTEGER)"
HISTOGRAM = ", ".join(f"count(*) FILTER (WHERE score <= {b}) AS le_{b}" for b in SCORE_BOUNDS)
STAGE_CASE = "CASE event " + " ".join(f"WHEN '{e}' THEN '{s}'" for e, s in STAGES.items()) + " END"
