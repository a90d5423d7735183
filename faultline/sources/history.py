"""Commit history tables: log scan, filters, commit detail, file versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.functions.messages import parse_timestamp
from faultline.operators.ancestry import nearest_versions, walk
from faultline.operators.spread import ROWS_PER_BUCKET, previous_row, running_sum
from faultline.session import materialize

FILES_PER_PAGE = 1000


def parse_log(lines: DataFrame, value: str = "value", position: str | None = None) -> DataFrame:
    """Rows of an exported ``hash|author|date|subject`` log; the subject may hold further pipes.

    Lines with fewer than four parts or without a readable date are dropped.
    """
    parts = F.split(F.col(value), r"\|", 4)
    return (
        lines.filter(F.size(parts) == 4)
        .select(
            F.trim(parts[0]).alias("commit_hash"),
            F.trim(parts[1]).alias("author"),
            parse_timestamp(parts[2]).alias("commit_ts"),
            F.trim(parts[3]).alias("subject"),
            *([F.col(position).alias("log_pos")] if position else []),
        )
        .filter(F.col("commit_ts").isNotNull())
    )


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """Scan exported log files. ``log_pos`` increases along the files by name, and along each file.

    A file may be read in parts. Its part's first byte plus the row's place in the part never
    reaches the next part, since a line has at least one byte.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_scan"),
    )
    lines = materialize(lines, "log")
    parts = lines.groupBy("_file", "_start").agg(F.min("_scan").alias("_first"))  # a row a part of a file
    by_name = Window.orderBy("_file")
    parts = parts.withColumn("_rank", F.dense_rank().over(by_name).cast("long"))
    place = F.shiftleft("_rank", 44) + F.col("_start") + F.col("_scan") - F.col("_first")
    placed = lines.join(parts, ["_file", "_start"]).withColumn("log_pos", place)
    return parse_log(placed, position="log_pos")


def commit_history(
    commits: DataFrame,
    since=None,
    until=None,
    file_path: str | None = None,
    file_changes: DataFrame | None = None,
    max_count: int | None = None,
) -> DataFrame:
    """Commits in a time range, optionally touching one file, newest first."""
    out = commits
    if since is not None:
        out = out.filter(F.col("commit_ts") >= F.lit(since).cast("timestamp"))
    if until is not None:
        out = out.filter(F.col("commit_ts") <= F.lit(until).cast("timestamp"))
    if file_path is not None:
        touching = file_changes.filter(F.col("file_path") == file_path).select("commit_hash")
        out = out.join(touching, "commit_hash", "left_semi")
    if max_count:
        out = out.orderBy(F.desc("commit_ts"), "commit_hash").limit(max_count)
    return out


def serialized(commits: DataFrame) -> DataFrame:
    """The display projection: short hash, ISO date, defaults for missing texts."""
    return commits.select(
        F.col("commit_hash").alias("hash"),
        F.substring("commit_hash", 1, 7).alias("short_hash"),
        F.coalesce("author", F.lit("Unknown")).alias("author"),
        F.date_format("commit_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
        F.coalesce("message", F.lit("No message")).alias("message"),
    )


def commit_stats(file_changes: DataFrame) -> DataFrame:
    return file_changes.groupBy("commit_hash").agg(
        F.sum("added").alias("insertions"),
        F.sum("deleted").alias("deletions"),
        F.sum(F.col("added") + F.col("deleted")).alias("total"),
        F.count(F.lit(1)).alias("files"),
    )


def commit_detail(commits: DataFrame, file_changes: DataFrame, files_per_page: int = FILES_PER_PAGE) -> DataFrame:
    """Commits with totals and their changed files as an array of structs.

    A commit touching more than ``files_per_page`` files spreads over several rows (``page``), so
    no row and no task grows with the largest commit.
    """
    stats = commit_stats(file_changes)
    pages = F.ceil(F.col("files") / files_per_page).cast("int")
    listed = (
        file_changes.join(stats.select("commit_hash", "files"), "commit_hash")
        .withColumn("page", F.pmod(F.xxhash64("file_path", "pos"), pages).cast("int"))
        # the join leaves a commit's rows together; its pages are built apart
        .repartition("commit_hash", "page")
        .groupBy("commit_hash", "page")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("pos", F.col("file_path").alias("path"), "change_type", "added", "deleted")
                )
            ).alias("changed_files")
        )
    )
    return (
        commits.join(stats, "commit_hash", "left")
        .join(listed, "commit_hash", "left")
        .withColumn("short_hash", F.substring("commit_hash", 1, 7))
        .na.fill(0, ["insertions", "deletions", "total", "files", "page"])
    )


def changed_files(detail: DataFrame) -> DataFrame:
    """The flat form of the nested file list."""
    return detail.selectExpr("commit_hash", "inline(changed_files)")


def first_files(file_changes: DataFrame, n: int) -> DataFrame:
    """The first ``n`` changed files of each commit; the limit is applied before the shuffle too."""
    window = Window.partitionBy("commit_hash").orderBy("pos", "file_path")
    return (
        file_changes.withColumn("_rn", F.row_number().over(window))
        .filter(F.col("_rn") <= n)
        .drop("_rn")
    )


def content_at(file_versions: DataFrame, wanted: DataFrame, missing: str = "drop") -> DataFrame:
    """File text for (file_path, commit_hash); a null hash means the newest version of the file.

    A version that does not exist gives no row; with ``missing="keep"`` it gives one with null content and
    ``found`` false, with ``missing="error"`` the job fails and names the first such version it meets.
    """
    if missing not in ("drop", "keep", "error"):
        raise ValueError(f"missing is drop, keep or error, not {missing!r}")
    exact = wanted.filter(F.col("commit_hash").isNotNull())
    newest = wanted.filter(F.col("commit_hash").isNull()).select("file_path")
    known = newest_version(file_versions)
    if missing == "drop":
        resolved = exact.unionByName(newest.join(known, "file_path"))
        return resolved.join(file_versions, ["file_path", "commit_hash"])
    resolved = exact.unionByName(newest.join(known, "file_path", "left"))
    found = resolved.join(file_versions.withColumn("found", F.lit(True)), ["file_path", "commit_hash"], "left")
    found = found.withColumn("found", F.coalesce("found", F.lit(False)))
    if missing == "keep":
        return found
    message = F.concat(F.lit("File "), "file_path", F.lit(" not found at commit "), F.coalesce("commit_hash", F.lit("(newest)")))
    return found.filter(F.col("found") | F.raise_error(message).cast("boolean")).drop("found")


def newest_version(file_versions: DataFrame) -> DataFrame:
    """Hash of each file's newest version, found without moving any text."""
    return file_versions.groupBy("file_path").agg(
        F.max_by("commit_hash", F.struct("commit_ts", "commit_hash")).alias("commit_hash")
    )


def before_after(file_versions: DataFrame, first: str, second: str) -> DataFrame:
    """Text of every file at two commits; a side that does not exist is ''."""

    def side(commit, name):
        at = file_versions.filter(F.col("commit_hash") == commit)
        return at.select("file_path", F.col("content").alias(name))

    return (
        side(first, "before")
        .join(side(second, "after"), "file_path", "full")
        .na.fill("", ["before", "after"])
    )


def versions_before(
    changes: DataFrame, commits: DataFrame, file_versions: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """(commit_hash, file_path, before_hash): the newest version of each changed file at the commit's parent.

    Newest means by commit time, at or before the parent; an export that holds a version only where
    a file changed is enough. Root commits and files without such a version give no row. Versions
    are counted along time, and the parent's count is looked up among the version numbers, so that
    neither texts nor all versions of a file meet in one place.
    """
    times = commits.select("commit_hash", "commit_ts")
    known = file_versions.select("file_path", "commit_hash", *(["commit_ts"] if "commit_ts" in file_versions.columns else []))
    if "commit_ts" not in known.columns:
        known = known.join(times, "commit_hash")
    parents = times.select(F.col("commit_hash").alias("parent_hash"), F.col("commit_ts").alias("parent_ts"))
    probes = (
        changes.select("commit_hash", "file_path").distinct()
        .join(commits.select("commit_hash", "parent_hash", "commit_ts"), "commit_hash")
        .filter("parent_hash IS NOT NULL")
        .join(parents, "parent_hash", "left")
    )
    # a parent that was not exported lies somewhere before the commit
    at = F.when(F.col("parent_ts").isNull(), order_key(F.col("commit_ts"), F.col("commit_hash")) - 1).otherwise(
        order_key(F.col("parent_ts"), F.col("parent_hash"))
    )
    events = known.select(
        "file_path", "commit_hash", order_key(F.col("commit_ts"), F.col("commit_hash")).alias("_order"), F.lit(1).alias("_is")
    ).unionByName(probes.select("file_path", "commit_hash", at.alias("_order"), F.lit(0).alias("_is")))
    events = materialize(events, "version-order")
    counted = running_sum(events, ["file_path"], "_order", {"_n": F.col("_is")}, rows_per_bucket=rows_per_bucket)
    counted = materialize(counted, "version-numbers")
    numbers = counted.filter("_is = 1").groupBy("file_path", "_n").agg(F.max("commit_hash").alias("before_hash"))
    return counted.filter("_is = 0").join(numbers, ["file_path", "_n"]).select("commit_hash", "file_path", "before_hash")


def versions_at_parents(
    changes: DataFrame, commits: DataFrame, file_versions: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """(commit_hash, file_path, before_hash): each changed file's version at the first parent or its nearest ancestor.

    Versions of other branches do not count; a merge is expected to carry the files it changed against
    its first parent. A parent that was not exported has no known ancestors, so there, and only
    there, the newest version before the commit by time stands in.
    """
    parents = commits.select("commit_hash", "parent_hash").filter("parent_hash IS NOT NULL").dropDuplicates(["commit_hash"])
    probes = changes.select("commit_hash", "file_path").distinct().join(parents, "commit_hash")
    probes = materialize(probes, "parents-asked")
    exported = commits.select(F.col("commit_hash").alias("parent_hash")).distinct()
    wanted = probes.join(exported, "parent_hash", "left_semi")
    found = nearest_versions(
        wanted.select("file_path", F.col("parent_hash").alias("at_commit")), file_versions, walk(commits, rows_per_bucket), rows_per_bucket
    )
    found = found.withColumnsRenamed({"at_commit": "parent_hash", "version_hash": "before_hash"})
    inside = wanted.join(found, ["file_path", "parent_hash"]).select("commit_hash", "file_path", "before_hash")
    outside = probes.join(exported, "parent_hash", "left_anti")
    if outside.isEmpty():
        return inside
    return inside.unionByName(versions_before(outside, commits, file_versions, rows_per_bucket))


def consecutive_pairs(
    versions: DataFrame,
    file: str,
    version: str,
    content: str,
    keep: list[str] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Each version of a file with the text of the version before it ('' for the first).

    Only keys are ordered; the texts meet in an equi-join on the version id.
    """
    linked = previous_row(
        versions.select(file, version), [file], version, [version], rows_per_bucket=rows_per_bucket
    ).select(F.col(version), F.col(f"prev.{version}").alias("_prev"))
    texts = versions.select(F.col(version).alias("_prev"), F.col(content).alias("before"))
    return (
        versions.select(file, version, F.col(content).alias("after"), *(keep or []))
        .join(linked, version)
        .join(texts, "_prev", "left")
        .drop("_prev")
        .na.fill("", ["before", "after"])
    )


def union_commits(specific: DataFrame, recent: DataFrame) -> DataFrame:
    """A chosen commit plus recent ones, one row per hash; the chosen row wins."""
    tagged = specific.withColumn("_src", F.lit(0)).unionByName(recent.withColumn("_src", F.lit(1)))
    others = [c for c in recent.columns if c != "commit_hash"]
    return (
        tagged.groupBy("commit_hash")
        .agg(F.min_by(F.struct(*others), "_src").alias("_row"))
        .select("commit_hash", *[F.col(f"_row.{c}").alias(c) for c in others])
    )


def order_key(ts: Column, commit_hash: Column) -> Column:
    """A LONG ordering commits by second and then by the head of the hash."""
    head = F.conv(F.substring(commit_hash, 1, 6), 16, 10).cast("long")
    return F.unix_seconds(ts) * F.lit(1 << 24) + head
