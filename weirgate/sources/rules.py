"""The rule catalogue: the default rules, loading, validation, snapshots and changes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import regex

SCHEMA = "id string, group string, description string, enabled boolean, targets array<string>, pattern string, score int, normalizers array<string>"

# Targets, normalizers, and the default rules (id, group, description, targets, score, normalizers, pattern).
TARGETS = ("url", "query", "body", "headers", "user_agent", "referer")
NORMALIZERS = ("url_decode", "html_decode", "sql_canonical")
DEFAULT_RULES = (
    ("SQLI_UNION_SELECT", "sql_injection", "UNION SELECT", "url query headers", 95, "url_decode html_decode sql_canonical", r"(?i)union[\s/*]+(?:all[\s/*]+)?select\b"),
    ("SQLI_BOOLEAN_TAUTOLOGY", "sql_injection", "OR or AND that is always true", "url query headers", 85, "url_decode html_decode sql_canonical", r"""(?i)['"\s](?:or|and)\s+(?:['"]?\d+['"]?\s*=\s*['"]?\d+|'[^']{0,32}'\s*=\s*'[^']{0,32}')"""),
    ("SQLI_TIME_BASED", "sql_injection", "delay functions or information_schema", "url query headers", 85, "url_decode html_decode sql_canonical", r"(?i)(?:sleep|benchmark|pg_sleep)\s*\(|waitfor\s+delay|information_schema"),
    ("SQLI_QUOTE_COMMENT", "sql_injection", "quote and comment", "url query", 65, "url_decode html_decode", r"'\s*(?:--|#|;|/\*)"),
    ("XSS_SCRIPT_TAG", "xss", "script tag", "url query headers", 85, "url_decode html_decode", r"(?i)<\s*script[\s>/]"),
    ("XSS_EVENT_HANDLER", "xss", "inline event handler", "url query headers", 65, "url_decode html_decode", r"(?i)\bon(?:error|load|click|dblclick|mouseover|mouseenter|mouseout|focus|blur|submit|change|input|keydown|keyup|keypress|toggle|animationstart|pointerover|begin)\s*="),
    ("XSS_JS_URI", "xss", "javascript: address", "url query headers", 65, "url_decode html_decode", r"(?i)javascript:\s*\w"),
    ("XSS_HTML_INJECTION", "xss", "tag that loads content", "url query headers", 65, "url_decode html_decode", r"(?i)<\s*(?:iframe|svg|img|body|object|embed)\b"),
    ("PT_DOTDOT_SLASH", "path_traversal", "../ or ..\\", "url query", 85, "url_decode", r"\.\.[\\/]"),
    ("PT_ENCODED_TRAVERSAL", "path_traversal", "encoded ../", "url query", 85, "", r"(?i)\.\.%2f|\.\.%5c|%2e%2e%2f|%2e%2e/|%2e%2e%5c"),
    ("CI_SHELL_METACHAR_CMD", "command_injection", "shell separator and command", "url query", 95, "url_decode", r"(?i)(?:;|\||\$\(|&&|`)\s*(?:cat|ls|id|whoami|uname|wget|curl|nc|bash|sh|ping|rm|chmod|nslookup|dig)(?:\s|$|[;|&`)])"),
    ("CI_SENSITIVE_CMD", "command_injection", "typical command lines", "url query headers", 85, "url_decode", r"(?i)cat\s+/etc/passwd|/bin/(?:ba)?sh\b|nc\s+-e|bash\s+-i|python\s+-c\b"),
    ("LOG4SHELL_JNDI", "log4shell", "JNDI lookup", "url query headers", 95, "url_decode", r"(?i)\$\{jndi:(?:ldaps?|rmi|dns|iiop|corba|nis):"),
    ("SSTI_EXPRESSION", "ssti", "template expression", "url query headers", 85, "url_decode", r"\{\{[^}]{1,100}\}\}"),
    ("LFI_SYSTEM_FILES", "lfi", "system files", "url query headers", 85, "url_decode", r"(?i)/etc/(?:passwd|shadow|hosts)|/proc/self/environ|boot\.ini|win\.ini"),
    ("LFI_PHP_WRAPPERS", "lfi", "stream wrappers", "url query headers", 85, "url_decode", r"(?i)php://(?:filter|input)|file://|expect://|data://text|zip://"),
    ("RFI_REMOTE_INCLUDE", "rfi", "remote file in a parameter", "query", 85, "url_decode", r"(?i)(?:^|&)(?:include|require|page|file|url|path|src|template|load|doc)=https?://"),
    ("SF_DOTFILES", "sensitive_file", "hidden files and directories", "url", 65, "url_decode", r"(?i)/\.(?:env|git|svn|htaccess|htpasswd|aws|ssh)\b"),
    ("SF_BACKUP_CONFIG", "sensitive_file", "backups and settings", "url", 65, "url_decode", r"(?i)wp-config\.php|/phpinfo\.php|\.(?:bak|old|sql|swp)$"),
    ("SCANNER_TOOL_UA", "scanner", "scanner's user agent", "user_agent", 65, "", r"(?i)sqlmap|havij|nikto|nmap|masscan|acunetix|nessus|dirbuster|gobuster|wpscan|nuclei|zgrab|fimap|w3af|hydra|zaproxy|arachni"),
)


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, g, d, True, t.split(), p, s, n.split()) for i, g, d, t, s, n, p in DEFAULT_RULES], SCHEMA)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a document {schemaVersion, rules: [..]} in JSON or YAML (by the file's name), of any store that Spark reads.

    A document is small: the driver reads it whole. One with another field, in it or in a rule, or without rules, is refused, as a field
    with a slip in its name would else be a rule that does less than it seems. enabled is true where it is left out.
    """
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    if path.rstrip("/").lower().endswith((".yaml", ".yml")):
        import yaml

        document = yaml.safe_load(text)
    else:
        document = json.loads(text)
    names = [x.split(" ", 1)[0] for x in SCHEMA.split(", ")]
    rules = document.get("rules") if isinstance(document, dict) else None
    if not isinstance(rules, list) or not all(isinstance(r, dict) for r in rules):
        raise ValueError(f"{path} has no list of rules")
    unknown = sorted({f"{k}" for k in document if k not in ("schemaVersion", "rules")} | {f"rules.{k}" for r in rules for k in r if k not in names})
    if unknown:
        raise ValueError(f"unknown fields in {path}: {', '.join(unknown)}")
    return spark.createDataFrame([tuple(r.get(n, True if n == "enabled" else None) for n in names) for r in rules], SCHEMA)


def validate_rules(rules: DataFrame, *within: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with error); ids are unique, or within the given columns. A catalogue is small; patterns are linted by a pandas UDF, a rule a row."""

    @F.pandas_udf("string")
    def lint(pattern):
        return pattern.map(lambda p: regex.lint(p or ""))

    listed = lambda c, known: F.forall(F.coalesce(F.col(c), F.array()), lambda x: x.isin(*known))
    copies = F.count("*").over(Window.partitionBy(*within, "id"))
    checks = [
        (F.coalesce(F.col("id").rlike(r"\A[A-Z0-9_]{3,80}\z"), F.lit(False)), "id"),
        (F.coalesce(F.trim("group") != "", F.lit(False)), "group"),
        (F.coalesce(F.col("score").between(1, 100), F.lit(False)), "score"),
        (F.coalesce(F.size("targets") > 0, F.lit(False)) & listed("targets", TARGETS), "targets"),
        (listed("normalizers", NORMALIZERS), "normalizers"),
        (F.coalesce(F.length("pattern").between(1, 2000), F.lit(False)), "pattern length"),
        (copies == 1, "duplicate id"),
    ]
    error = F.coalesce(*[F.when(~ok, name) for ok, name in checks])
    checked = rules.withColumn("error", error).withColumn("error", F.coalesce("error", lint("pattern")))
    return checked.where("error IS NULL").drop("error"), checked.where("error IS NOT NULL")


def active_rules(snapshots: DataFrame) -> DataFrame:
    """Rules of the last valid snapshot of (version long, rules array<struct>): an invalid one leaves the one before it in force."""
    _, rejected = validate_rules(snapshots.select("version", F.inline("rules")), "version")
    bad = rejected.select("version").distinct()
    newest = snapshots.where(F.size("rules") > 0).join(bad, "version", "left_anti").agg(F.max_by("rules", "version").alias("rules"))
    return newest.select(F.inline("rules")).orderBy("id")


def apply_rule_changes(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """The next snapshot, by id: changes has op ('upsert', 'create' or 'delete') and a rule's columns, one row an id.

    A create of a rule that exists does nothing, as does a delete that would leave no rule.
    """
    names = rules.columns
    new = changes.select("op", *[F.col(c).alias(f"n_{c}") for c in names])
    both = rules.withColumn("known", F.lit(True)).join(new, F.col("id") == F.col("n_id"), "full")
    change = F.col("op").isNotNull() & ~(F.col("known").isNotNull() & (F.col("op") == "create"))
    gone = F.coalesce(F.col("op") == "delete", F.lit(False))
    left = F.count_if(~gone).over(Window.partitionBy())
    both = both.withColumn("left", left).where(~gone | ((F.col("left") == 0) & F.col("known").isNotNull()))
    return both.select(*[F.when(change & ~gone, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in names]).orderBy("id")
