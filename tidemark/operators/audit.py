"""Audit trails, data-protection records, transaction reports and text scans."""

from __future__ import annotations

import functools
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Required events, retention years, blocking bases, duty conflicts, scan rules.
REQUIRED_EVENTS = ["api_call", "data_access", "system_change"]
RETENTION_YEARS = {"trading_data": 7, "user_profiles": 5, "model_predictions": 3, "system_logs": 2, "audit_trails": 10}
COUNTED_YEARS = [5, 7, 10]
DEFAULT_YEARS = 1
BLOCKING_BASES = ["legal_obligation", "public_task"]
DUTY_CONFLICTS = {
    "Developer cannot be approver": ("developer", "approver"),
    "Approver cannot be deployer": ("approver", "deployer"),
}
COMPLIANT_PERCENT = 90
SCAN_RULES = [
    ("injection", "Code Injection Risk", "high", r"eval\s*\("),
    ("injection", "Code Execution Risk", "high", r"exec\s*\("),
    ("injection", "Shell Injection Risk", "medium", r"subprocess\.call\([^)]*shell\s*=\s*True"),
    ("crypto", "Weak Hash Algorithm", "medium", r"hashlib\.md5\("),
    ("crypto", "Weak Hash Algorithm", "medium", r"hashlib\.sha1\("),
    ("crypto", "Weak Random Number Generation", "low", r"random\.random\("),
    ("auth", "Hardcoded Password", "critical", r"password\s*=\s*['\"][^'\"]+['\"]"),
    ("auth", "Hardcoded API Key", "high", r"api_key\s*=\s*['\"][^'\"]+['\"]"),
    ("auth", "Hardcoded Secret", "high", r"secret\s*=\s*['\"][^'\"]+['\"]"),
    ("data", "Unsafe Deserialization", "high", r"pickle\.loads?\("),
    ("data", "Unsafe YAML Loading", "medium", r"yaml\.load\("),
]


def search(
    events: DataFrame, event_type: str | None = None, user: str | None = None, start: str | None = None,
    end: str | None = None, limit: int = 100,
) -> DataFrame:
    """Matching events, newest first."""
    out = events
    if event_type:
        out = out.where(F.col("event_type") == event_type)
    if user:
        out = out.where(F.col("user_id") == user)
    if start:
        out = out.where(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end:
        out = out.where(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    return out.orderBy(F.col("timestamp").desc()).limit(limit)


def audit_summary(events: DataFrame, since: str | None = None) -> DataFrame:
    """Counts by type, by result and in total, with failed sign-ins and the success rate."""
    recent = events if since is None else events.where(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    failed = (F.col("event_type") == "auth") & F.col("result").isin("failure", "denied")
    # One shuffle of the small counts per (type, result) feeds all three groupings.
    counts = recent.groupBy("event_type", "result").agg(F.count("*").alias("_n"), F.count_if(failed).alias("_f"))
    n = F.sum("_n")
    return counts.groupingSets([["event_type"], ["result"], []], "event_type", "result").agg(
        n.alias("n"), F.sum("_f").alias("failed_auth"),
        (F.sum(F.when(F.col("result") == "success", F.col("_n")).otherwise(0)) / n * 100).alias("success_rate"),
    )


def trail_coverage(events: DataFrame, since: str, required: Sequence[str] = REQUIRED_EVENTS) -> DataFrame:
    cut = F.lit(since).cast("timestamp")
    seen = [F.coalesce(F.bool_or(F.col("event_type") == r), F.lit(False)) for r in required]
    found = sum((s.cast("int") for s in seen), F.lit(0))
    out = events.agg(F.count_if(F.col("timestamp") > cut).alias("n_recent"), found.cast("long").alias("n_required_seen"))
    return out.withColumn("complete", (F.col("n_recent") > 0) & (F.col("n_required_seen") == len(required)))


def retention(records: DataFrame, policies: Mapping[str, int] = RETENTION_YEARS) -> DataFrame:
    """Years a record is kept: the longest counted policy of its categories, else one."""
    counted = {c: y for c, y in policies.items() if y in COUNTED_YEARS}
    years = F.create_map(*[F.lit(x) for pair in counted.items() for x in pair])
    longest = F.array_max(F.transform("categories", lambda c: F.coalesce(F.try_element_at(years, c), F.lit(DEFAULT_YEARS))))
    kept = records.withColumn("retention_years", F.coalesce(longest, F.lit(DEFAULT_YEARS)))
    return kept.withColumn("expires_at", F.col("processed_at") + F.make_ym_interval(years=F.col("retention_years")))


def subject_records(processing: DataFrame, consents: DataFrame, requests: DataFrame) -> DataFrame:
    """All processing and consent rows of the requested persons, one row each."""
    shape = lambda df, kind, detail: df.join(requests, "subject", "left_semi").select(
        "subject", F.lit(kind).alias("kind"), "record_id", detail.alias("detail")
    )
    return shape(processing, "processing", F.concat_ws("|", "purpose", "legal_basis")).unionByName(
        shape(consents, "consent", F.col("purpose"))
    )


def erasure_decisions(processing: DataFrame, requests: DataFrame) -> DataFrame:
    """Rejected if a record has a blocking legal basis, else pending."""
    blocking = processing.where(F.col("legal_basis").isin(*BLOCKING_BASES)).groupBy("subject").agg(
        F.sort_array(F.collect_set("purpose")).alias("obligations")
    )
    out = requests.join(blocking, "subject", "left")
    status = F.when(F.col("obligations").isNotNull(), "rejected").otherwise("pending")
    return out.select("subject", status.alias("status"), F.coalesce("obligations", F.array().cast("array<string>")).alias("obligations"))


def transaction_report(transactions: DataFrame, start: str, end: str) -> DataFrame:
    """Count, algorithmic share and traded value per venue and in total (venue NULL)."""
    stamp = lambda s: F.lit(s).cast("timestamp")
    period = transactions.where(F.col("timestamp").between(stamp(start), stamp(end)))
    used = F.col("algorithm").isNotNull()
    return period.rollup("venue").agg(
        F.count("*").alias("n"), F.count_if(used).alias("n_algorithmic"), (F.count_if(used) / F.count("*") * 100).alias("algorithmic_percent"),
    )


def traded_value(transactions: DataFrame) -> DataFrame:
    return transactions.rollup("venue").agg(F.sum(F.col("quantity") * F.col("price")).alias("value"))


def duty_conflicts(roles: DataFrame) -> DataFrame:
    """Users who hold both roles of a conflicting pair."""
    names = sorted({r for pair in DUTY_CONFLICTS.values() for r in pair})
    held = roles.where(F.col("role").isin(*names)).groupBy("user").agg(*[F.bool_or(F.col("role") == r).alias(r) for r in names])
    found = F.array_compact(F.array(*[F.when(F.col(a) & F.col(b), text) for text, (a, b) in DUTY_CONFLICTS.items()]))
    return held.select("user", F.explode(found).alias("violation"))


def check_rollup(checks: DataFrame) -> DataFrame:
    """Passed, failed and warning checks per standard and in total (standard NULL)."""
    count = lambda s: F.count_if(F.col("status") == s)
    out = checks.rollup("standard").agg(
        F.count("*").alias("n_checks"), count("pass").alias("n_passed"), count("fail").alias("n_failed"), count("warning").alias("n_warnings")
    )
    percent = F.col("n_passed") / F.col("n_checks") * 100
    return out.withColumn("percent", percent).withColumn("compliant", percent >= COMPLIANT_PERCENT)


def required_literal(pattern: str) -> str:
    """The longest text, in lower case, that every match of a pattern contains; empty if none is sure."""
    runs, run = [], ""
    tokens = re.findall(r"\\.|\[\^?\]?(?:\\.|[^\]])*\]|[*+?]\??|\{[^}]*\}|.", pattern, re.DOTALL)
    if any(t in tokens for t in ("|", "(", ")")):
        return ""  # a part in brackets or a choice may be left out
    for token in tokens:
        if token[0] in "*?{" and run:
            run = run[:-1]  # the character before may be missing or repeated
        literal = token[1:] if len(token) == 2 and token[0] == "\\" and not token[1].isalnum() else token if len(token) == 1 and token not in "*+?.^$" else ""
        if literal:
            run += literal.lower()
        else:
            runs.append(run)
            run = ""
    return max([*runs, run], key=len)


def scan_text(texts: DataFrame, key: str, text: str, rules: Sequence[tuple[str, str, str, str]] = SCAN_RULES) -> DataFrame:
    """Every match of every rule, with its line number. Runs row by row without a shuffle.

    A rule's pattern is tried only on lines with its required literal, in texts with a required literal of some rule.
    """
    literals = [required_literal(r[3]) for r in rules]
    some = lambda lower: functools.reduce(lambda a, b: a | b, [F.contains(lower, F.lit(x)) for x in sorted(set(literals))])
    lines = texts.where(some(F.lower(text))).select(key, F.posexplode(F.split(text, "\n")).alias("_pos", "_line"))
    none = F.array().cast("array<string>")

    def matches(literal: str, category: str, title: str, severity: str, pattern: str) -> Column:
        found = F.regexp_extract_all("_line", F.lit(f"(?i){pattern}"), F.lit(0))
        found = F.when(F.contains(F.col("_lower"), F.lit(literal)), found).otherwise(none)
        return F.transform(found, lambda m: F.struct(
            F.lit(category).alias("category"), F.lit(title).alias("title"), F.lit(severity).alias("severity"), m.alias("matched")
        ))

    hits = F.concat(*[matches(x, *r) for x, r in zip(literals, rules, strict=True)])
    held = lines.withColumn("_lower", F.lower("_line")).where(some(F.col("_lower")))
    return held.select(key, "_pos", "_line", F.explode(hits).alias("x")).select(
        key, (F.col("_pos") + 1).cast("long").alias("line_number"), "x.category", "x.title", "x.severity", "x.matched",
        F.trim("_line").alias("snippet"),
    )


def finding_counts(findings: DataFrame) -> DataFrame:
    counts = findings.groupBy("severity", "category").agg(F.count("*").alias("_n"))
    return counts.groupingSets([["severity"], ["category"], []], "severity", "category").agg(F.sum("_n").alias("n"))
