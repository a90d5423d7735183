"""Tracked issues: flattening exported JSON, search, and confirmation of commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schema
from faultline.functions.messages import issue_confirms_fix, issue_keys, is_performance_issue


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    return flatten_issues(spark.read.schema(schema.ISSUES_RAW).json(path))


def flatten_issues(raw: DataFrame) -> DataFrame:
    """Nested export to one flat row per issue, with defaults for what is missing."""
    f = F.col("fields")
    no_strings = F.array().cast("array<string>")
    flat = raw.select(
        F.coalesce("key", F.lit("")).alias("key"),
        F.coalesce(f.summary, F.lit("")).alias("summary"),
        F.coalesce(f.description, F.lit("")).alias("description"),
        F.coalesce(f.issuetype["name"], F.lit("Unknown")).alias("issue_type"),
        F.coalesce(f.status["name"], F.lit("Unknown")).alias("status"),
        F.coalesce(f.priority["name"], F.lit("Unknown")).alias("priority"),
        F.coalesce(f.labels, no_strings).alias("labels"),
        F.coalesce(
            F.transform(f.components, lambda c: F.coalesce(c["name"], F.lit(""))), no_strings
        ).alias("components"),
        F.coalesce(f.created, F.lit("")).alias("created"),
        F.coalesce(f.updated, F.lit("")).alias("updated"),
        F.coalesce(f.resolutiondate, F.lit("")).alias("resolved"),
    )
    return with_performance_flag(flat)


def with_performance_flag(issues: DataFrame) -> DataFrame:
    return issues.withColumn(
        "is_performance_issue",
        is_performance_issue("summary", "description", "labels", "components", "issue_type"),
    )


def search_issues(
    issues: DataFrame,
    project: str | None = None,
    issue_type: str | None = None,
    status: str | None = None,
    max_results: int | None = None,
) -> DataFrame:
    """Issues meeting all given conditions, newest first."""
    out = issues
    if project:
        out = out.filter(F.substring_index("key", "-", 1) == project)
    if issue_type:
        out = out.filter(F.col("issue_type") == issue_type)
    if status:
        out = out.filter(F.col("status") == status)
    out = out.orderBy(F.desc("created"), "key")
    return out.limit(max_results) if max_results else out


def confirming_issues(issues: DataFrame) -> DataFrame:
    """Keys of the issues whose type and state confirm a fix."""
    return issues.filter(
        issue_confirms_fix("issue_type", "status", "is_performance_issue")
    ).select("key")


def commit_keys(commits: DataFrame, text: str = "subject") -> DataFrame:
    """One row per (commit, issue key) in order of appearance."""
    return commits.select("commit_hash", F.posexplode(issue_keys(text)).alias("key_pos", "key"))


def confirmed_commits(commits: DataFrame, issues: DataFrame, text: str = "subject") -> DataFrame:
    """Commits with the first of their keys that confirms a fix.

    The issue side is unique per key, so a key named by very many commits only skews the commit
    side, which adaptive execution splits.
    """
    return (
        commit_keys(commits, text)
        .join(confirming_issues(issues).distinct(), "key")
        .groupBy("commit_hash")
        .agg(F.min_by("key", "key_pos").alias("issue_key"))
    )


def reference_counters(commits: DataFrame, issues: DataFrame, text: str = "subject") -> DataFrame:
    """Issue keys found in messages and commits confirmed by one."""
    found = commits.agg(F.coalesce(F.sum(F.size(issue_keys(text))), F.lit(0)).alias("keys_found"))
    used = confirmed_commits(commits, issues, text).agg(F.count(F.lit(1)).alias("keys_used"))
    return found.crossJoin(used)  # one row each
