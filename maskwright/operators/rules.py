"""Rules as rows: the built-in set, custom files, precedence, switching on and off."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "rule_id string, name string, description string, pattern string, prefix string, severity string, enabled boolean, exceptions array<string>, ord int, seq int, source_rank int"
SEVERITIES = ("Low", "Medium", "High", "Critical")


@dataclass
class Rule:
    rule_id: str
    pattern: str
    prefix: str
    severity: str = "Medium"
    ord: int = 100
    enabled: bool = True
    exceptions: list[str] = field(default_factory=list)
    name: str = ""
    description: str = ""


# Ids, patterns, prefixes, severities and orders of the built-in rules.
BUILT_IN = (
    Rule("server_names", r"\b[A-Z][a-zA-Z]*DB\d*\b", "SERVER", "Medium", 10),
    Rule("prod_databases", r"\b[a-zA-Z]+[_-]?[Pp]rod(uction)?\b", "SERVER", "Medium", 11),
    Rule("table_names_prod", r"\b[a-z_]+_prod\b", "TABLE", "Medium", 12),
    Rule("table_names_users", r"\b(users?|accounts?|customers?)(_\w+)?\b", "TABLE", "Medium", 13),
    Rule("private_ip_10", r"\b10\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "IP", "High", 20),
    Rule("private_ip_172", r"\b172\.(1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}\b", "IP", "High", 21),
    Rule("private_ip_192", r"\b192\.168\.\d{1,3}\.\d{1,3}\b", "IP", "High", 22),
    Rule("connection_string", r"(?i)(server|data source|host)=[^;]+", "CONNSTR", "High", 30),
    Rule("windows_path", r"""[A-Za-z]:\\[^\s*?"<>|:]+""", "PATH", "Medium", 40),
    Rule("unc_path", r"\\\\[a-zA-Z0-9._-]+\\[^\s]+", "PATH", "Medium", 41),
    Rule("internal_hostname", r"\b[a-z][a-z0-9-]*\.(internal|local|corp|lan)\b", "HOST", "Medium", 50),
    Rule("email_addresses", r"[\w.+-]+@[\w.-]+\.\w{2,}", "EMAIL", "High", 55),
    Rule("mvs_dataset_quoted", r"'[A-Z][A-Z0-9]{0,7}(\.[A-Z0-9@#$]{1,8})+(\([^)]+\))?'", "DSN", "High", 56),
    Rule("mvs_dataset_bare", r"\b[A-Z]{2,8}\.[A-Z][A-Z0-9]{1,7}(\.[A-Z0-9]{1,8}){0,5}\b", "DSN", "Medium", 57),
)
# The rules that the SQL template adds.
SQL_TEMPLATE = (
    Rule("sql_database_names", r"(?i)(?<=FROM\s{1,100})[A-Za-z_][A-Za-z0-9_]*(?=\.)", "DATABASE", "High", 5),
    Rule("sql_schema_qualified", r"(?i)\b(dbo|staging|archive|etl)\.[A-Za-z_][A-Za-z0-9_]*\b", "TABLE", "High", 6),
    Rule("sql_linked_servers", r"\[[A-Za-z_][A-Za-z0-9_]*\]\.\[[A-Za-z_][A-Za-z0-9_]*\]", "SERVER", "Critical", 1),
    Rule("sql_server_names", r"(?i)\b[A-Z][A-Z0-9_-]*(?:SQL|DB|SERVER)[A-Z0-9_-]*\b", "SERVER", "High", 2),
)
BASIC_TEMPLATE = (Rule("custom_example", r"\bEXAMPLE_PATTERN\b", "CUSTOM", "Medium", 100, enabled=False, description="Shows the form of a rule; put a pattern of your own here"),)


def frame(spark: SparkSession, rules: Iterable[Rule], source_rank: int = 0) -> DataFrame:
    rows = [{**asdict(r), "seq": i, "source_rank": source_rank} for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, SCHEMA) if rows else spark.createDataFrame([], SCHEMA)


def merged(layers: DataFrame) -> DataFrame:
    """One row for each rule_id, in any case: that of the highest source_rank, the last within it.

    The winner takes the place (seq) of the first of its id, so a rule that replaces another keeps its turn among ties.
    """
    key = F.lower("rule_id")
    last = Window.partitionBy(key).orderBy(F.desc("source_rank"), F.desc("seq"))
    first = Window.partitionBy(key)
    place = F.min(F.struct("source_rank", "seq")).over(first)
    return (
        layers.withColumn("__rn", F.row_number().over(last)).withColumn("__place", place).where("__rn = 1")
        .withColumn("seq", (F.col("__place.source_rank") * 1_000_000 + F.col("__place.seq")).cast("int")).drop("__rn", "__place")
    )


def with_custom(built_in: DataFrame, custom: DataFrame) -> DataFrame:
    """Custom layers merged among themselves, disabled ones dropped, then set over the built-in rules: disabling one in a file
    does not switch a built-in rule off; `switched` does."""
    return merged(built_in.withColumn("source_rank", F.lit(0)).unionByName(merged(custom).where("enabled").withColumn("source_rank", F.lit(1))))


def active(rules: DataFrame) -> DataFrame:
    """Enabled rules by order; ties in the order they came."""
    return rules.where("enabled").orderBy("ord", "source_rank", "seq")


def switched(rules: DataFrame, rule_id: str, on: bool) -> DataFrame:
    return rules.withColumn("enabled", F.when(F.lower("rule_id") == rule_id.lower(), F.lit(on)).otherwise(F.col("enabled")))


def rule(rules: DataFrame, rule_id: str) -> DataFrame:
    return rules.where(F.lower("rule_id") == rule_id.lower())


def collected(rules: DataFrame) -> list[Rule]:
    """Active rules on the driver: a rule set is configuration, a few kilobytes."""
    return [Rule(r.rule_id, r.pattern, r.prefix, r.severity, r.ord, r.enabled, list(r.exceptions or []), r.name or "", r.description or "") for r in active(rules).collect()]


def combined_pattern(lines: Iterable[str]) -> str | None:
    """Patterns of a pattern file: blank and # lines dropped; several become one alternation; none: None."""
    kept = [x.strip() for x in lines if x.strip() and not x.strip().startswith("#")]
    return None if not kept else kept[0] if len(kept) == 1 else "(" + "|".join(kept) + ")"


def resolved_pattern(entry: dict, base: str, makers: dict[str, Callable[[], str]] | None = None) -> str | None:
    """The pattern of a rule entry by its type: Regex, RegexFile, or Python (a registered function that returns a pattern).

    Scripts are not run: where a rule names one, register a Python function under the script's file name instead.
    """
    kind = str(entry.get("type", "Regex")).lower()
    if kind == "regexfile":
        path = os.path.join(base, entry.get("patternFile") or "")
        if not os.path.isfile(path):
            return None
        with open(path, encoding="utf-8") as f:
            return combined_pattern(f)
    if kind in ("python", "javascript"):
        make = (makers or {}).get(os.path.basename(entry.get("scriptFile") or ""))
        return make() if make else None
    return entry.get("pattern") or None


def from_json(spark: SparkSession, path: str, source_rank: int = 1, keep_disabled: bool = True, makers: dict[str, Callable[[], str]] | None = None) -> DataFrame:
    """Rules of a JSON file (keys in any case); a missing or invalid file, and entries without a pattern, give no rows."""
    try:
        with open(path, encoding="utf-8") as f:
            body = json.load(f)
    except (OSError, ValueError):
        return frame(spark, [])
    lowered = {k.lower(): v for k, v in body.items()} if isinstance(body, dict) else {}
    names = {"ruleid": "ruleId", "patternfile": "patternFile", "scriptfile": "scriptFile"}
    out = []
    for raw in lowered.get("rules") or []:
        entry = {names.get(k.lower(), k.lower()): v for k, v in raw.items()}
        pattern = resolved_pattern(entry, os.path.dirname(path), makers)
        enabled = bool(entry.get("enabled", True))
        if not entry.get("ruleId") or not pattern or not entry.get("prefix") or not (enabled or keep_disabled):
            continue
        out.append(Rule(entry["ruleId"], pattern, entry["prefix"], entry.get("severity", "Medium"), int(entry.get("order", 100)), enabled, list(entry.get("exceptions") or []), entry.get("name", ""), entry.get("description", "")))
    return frame(spark, out, source_rank)


def template(sql: bool = False) -> str:
    """A rule file to start from."""
    rules = BASIC_TEMPLATE if not sql else SQL_TEMPLATE
    return json.dumps({"rules": [{"ruleId": r.rule_id, "type": "Regex", "pattern": r.pattern, "prefix": r.prefix, "severity": r.severity, "enabled": r.enabled, "order": r.ord, "description": r.description} for r in rules]}, indent=2)
