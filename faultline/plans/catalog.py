"""Named queries over the test tables, each with the SQL that must give the same rows.

Every query reads whole tables through the adapters in ``sources.driver_tables``. Queries without
SQL use the random structure of model fitting or Python's parser; tests cover them by brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schema
from faultline.functions import code_text, diffs, extraction, messages
from faultline.functions.patterns import DIGIT, LINE_BREAK, NOT_SPACE, WORD, any_word, portable
from faultline.operators import (
    balance,
    evaluation,
    features,
    line_origins,
    neighbours,
    process,
    reporting,
    sampling,
    scaling,
    scoring,
    selection,
    szz,
    training,
)
from faultline.operators.spread import previous_row
from faultline.plans import mining
from faultline.plans import scoring as scoring_plan
from faultline.plans.training import TrainingConfig, run_training
from faultline.session import materialize, scratch, tune
from faultline.sources import datasets, driver_tables, files, history, issues, model_store
from faultline.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

NOW = "2001-08-01 00:00:00"


def query(name: str, sql: str | None = None):
    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(tune(spark), sf_dir)

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- SQL building blocks ----------------------------------------------------------------------

ISO = "'%Y-%m-%dT%H:%M:%S'"

ORDER_COMMITS = """
    SELECT o_orderkey, sha1(CAST(o_orderkey AS VARCHAR)) AS commit_hash, 'dev' || o_custkey AS author,
           o_orderdate AS commit_ts, o_custkey, o_orderstatus,
           CASE o_orderstatus WHEN 'F' THEN 'Fix order ' WHEN 'O' THEN 'Add order ' ELSE 'Change order ' END
             || o_orderkey || CASE WHEN o_orderkey % 5 = 0 THEN ' refs PART-' || o_custkey ELSE '' END AS subject,
           o_orderpriority
    FROM orders"""

FILE_CHANGES = """
    SELECT sha1(CAST(l_orderkey AS VARCHAR)) AS commit_hash, 'src/part' || l_partkey || '.py' AS file_path,
           l_linenumber AS pos, CAST(l_quantity AS BIGINT) AS added,
           CAST(floor(l_quantity * l_discount) AS BIGINT) AS deleted,
           'dev' || o_custkey AS author, o_orderdate AS commit_ts
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

EVENT_COMMITS = """
    SELECT event_id, sha1(CAST(event_id AS VARCHAR)) AS commit_hash, 'user' || user_id AS author, ts AS commit_ts,
           event_type || ' ' || props || CASE event_id % 8
             WHEN 0 THEN ' refs #' || event_id WHEN 1 THEN ' see proj-' || (event_id % 97)
             WHEN 2 THEN ' perf ' || user_id WHEN 3 THEN ' improve cache'
             WHEN 4 THEN ' PART-' || (event_id % 2000) || ' PART-' || user_id ELSE '' END AS message
    FROM events"""

ISSUES = f"""
    SELECT p_partkey, 'PART-' || p_partkey AS key, CASE WHEN p_type = 'SMALL' THEN 'Bug' ELSE p_type END AS issue_type,
           p_name || CASE WHEN p_partkey % 10 = 0 THEN ' slow' ELSE '' END AS summary,
           CASE WHEN p_size % 7 <> 0 THEN ['Open', 'Resolved', 'Closed', 'Done'][p_size % 4 + 1] ELSE 'Unknown' END AS status,
           p_brand AS component, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS created,
           regexp_matches(lower(concat_ws(' ', p_name || CASE WHEN p_partkey % 10 = 0 THEN ' slow' ELSE '' END, '',
             lower(p_brand), p_brand, CASE WHEN p_type = 'SMALL' THEN 'Bug' ELSE p_type END)),
             {quoted("|".join(schema.PERFORMANCE_ISSUE_SUBSTRINGS))}) AS is_performance_issue
    FROM part"""

CONFIRMING = f"""
    SELECT key FROM ({ISSUES}) WHERE status IN ('Resolved', 'Closed', 'Done')
      AND (issue_type = 'Bug' OR is_performance_issue)"""


def rule_sql(text: str) -> str:
    words = quoted("(?i)" + any_word(schema.BUG_FIX_WORDS))
    slow = quoted("(?i)" + any_word(schema.PERFORMANCE_WORDS))
    refs = quoted("(?i)(" + "|".join(portable(p) for p in schema.ISSUE_REFERENCES) + ")")
    perf = quoted("(?i)(" + "|".join(portable(p) for p in schema.PERFORMANCE_REFERENCES) + ")")
    return (
        f"CASE WHEN regexp_matches(lower({text}), {words}) THEN 'keyword' "
        f"WHEN regexp_matches(lower({text}), {slow}) THEN 'performance' "
        f"WHEN regexp_matches(lower({text}), {refs}) THEN 'reference' "
        f"WHEN regexp_matches(lower({text}), {perf}) THEN 'performance_reference' END"
    )


# --- messages and issues ----------------------------------------------------------------------


@query(
    "bug_fix_flags",
    f"SELECT commit_hash, rule IS NOT NULL AS is_bug_fix, rule AS matched_rule "
    f"FROM (SELECT commit_hash, {rule_sql('message')} AS rule FROM ({EVENT_COMMITS}))",
)
def _bug_fix_flags(spark, sf):
    return jobs.bug_fix_flags(driver_tables.event_commits(spark, sf)).select(
        "commit_hash", "is_bug_fix", "matched_rule"
    )


@query(
    "bug_fixes_by_day",
    f"SELECT strftime(commit_ts, '%Y-%m-%d') AS day, count(*) AS commits, "
    f"count(*) FILTER (WHERE rule IS NOT NULL) AS fixes, "
    f"round(count(*) FILTER (WHERE rule IS NOT NULL) / count(*), 6) AS fix_ratio "
    f"FROM (SELECT commit_ts, {rule_sql('message')} AS rule FROM ({EVENT_COMMITS})) GROUP BY 1",
)
def _bug_fixes_by_day(spark, sf):
    flagged = jobs.bug_fix_flags(driver_tables.event_commits(spark, sf))
    n, fixes = F.count(F.lit(1)), F.count_if("is_bug_fix")
    return flagged.groupBy(F.date_format("commit_ts", "yyyy-MM-dd").alias("day")).agg(
        n.alias("commits"), fixes.alias("fixes"), F.round(fixes / n, 6).alias("fix_ratio")
    )


@query(
    "issue_keys",
    f"""SELECT commit_hash, unnest(regexp_extract_all(message, '(?i)\\b([A-Z][A-Z0-9_]+-[0-9]+)\\b', 1)) AS key
        FROM ({EVENT_COMMITS})
        UNION
        SELECT commit_hash, upper(unnest(regexp_extract_all(message, '\\b([a-z][a-z0-9_]+-[0-9]+)\\b', 1))) AS key
        FROM ({EVENT_COMMITS})""",
)
def _issue_keys(spark, sf):
    return issues.commit_keys(driver_tables.event_commits(spark, sf)).select("commit_hash", "key")


def _issues(spark, sf):
    return issues.flatten_issues(driver_tables.part_issues_raw(spark, sf))


@query(
    "issues_flattened",
    f"""SELECT key, summary, '' AS description, issue_type, status, 'Unknown' AS priority, lower(component) AS labels,
               component AS components, is_performance_issue,
               status IN ('Resolved', 'Closed', 'Done') AND (issue_type = 'Bug' OR is_performance_issue) AS confirms_fix
        FROM ({ISSUES})""",
)
def _issues_flattened(spark, sf):
    return _issues(spark, sf).select(
        "key",
        "summary",
        "description",
        "issue_type",
        "status",
        "priority",
        F.array_join("labels", ",").alias("labels"),
        F.array_join("components", ",").alias("components"),
        "is_performance_issue",
        messages.issue_confirms_fix("issue_type", "status", "is_performance_issue").alias("confirms_fix"),
    )


@query(
    "issue_search",
    f"""SELECT key, created FROM ({ISSUES}) WHERE issue_type = 'Bug' AND status = 'Closed'
        ORDER BY created DESC, key LIMIT 50""",
)
def _issue_search(spark, sf):
    return issues.search_issues(_issues(spark, sf), "PART", "Bug", "Closed", max_results=50).select("key", "created")


EVENT_KEYS = f"""
    SELECT commit_hash, i, keys[i] AS key FROM (
      SELECT commit_hash, keys, unnest(range(1, len(keys) + 1)) AS i FROM (
        SELECT commit_hash, regexp_extract_all(message, '(?i)\\b([A-Z][A-Z0-9_]+-[0-9]+)\\b', 1) AS keys
        FROM ({EVENT_COMMITS})))"""


@query(
    "issue_confirmed_commits",
    f"""SELECT commit_hash, arg_min(key, i) AS issue_key FROM ({EVENT_KEYS})
        WHERE key IN ({CONFIRMING}) GROUP BY commit_hash""",
)
def _issue_confirmed_commits(spark, sf):
    return issues.confirmed_commits(driver_tables.event_commits(spark, sf), _issues(spark, sf))


@query(
    "issue_reference_counters",
    f"""SELECT (SELECT count(*) FROM (
                 SELECT commit_hash, unnest(regexp_extract_all(message, '(?i)\\b([A-Z][A-Z0-9_]+-[0-9]+)\\b', 1)) AS key
                 FROM ({EVENT_COMMITS})
                 UNION SELECT commit_hash, upper(unnest(regexp_extract_all(message, '\\b([a-z][a-z0-9_]+-[0-9]+)\\b', 1)))
                 FROM ({EVENT_COMMITS}))) AS keys_found,
               (SELECT count(DISTINCT commit_hash) FROM ({EVENT_KEYS}) WHERE key IN ({CONFIRMING})) AS keys_used""",
)
def _issue_reference_counters(spark, sf):
    return issues.reference_counters(driver_tables.event_commits(spark, sf), _issues(spark, sf))


@query(
    "message_metrics",
    f"""SELECT doc_id, length(text) AS commit_msg_length,
               len(regexp_extract_all(text, {quoted(NOT_SPACE + '+')})) AS commit_msg_word_count,
               length(replace(text, ' ', '')) AS commit_msg_char_count
        FROM documents""",
)
def _message_metrics(spark, sf):
    docs = driver_tables.table(spark, sf, "documents").select("doc_id", "text")
    return docs.select(
        "doc_id",
        messages.message_length("text").cast("long").alias("commit_msg_length"),
        messages.message_word_count("text").cast("long").alias("commit_msg_word_count"),
        messages.message_char_count("text").cast("long").alias("commit_msg_char_count"),
    )


# --- source text ------------------------------------------------------------------------------


@query(
    "text_metrics",
    f"""SELECT doc_id, len(regexp_extract_all(text, {quoted(WORD + '+')})) AS token_count,
               len(list_filter(string_split_regex(text, {quoted(LINE_BREAK)}),
                               lambda l: regexp_matches(l, {quoted(NOT_SPACE)}))) AS nloc
        FROM documents""",
)
def _text_metrics(spark, sf):
    docs = driver_tables.table(spark, sf, "documents").select("doc_id", "text")
    return docs.select(
        "doc_id",
        code_text.token_count("text").cast("long").alias("token_count"),
        code_text.nloc("text").cast("long").alias("nloc"),
    )


def _sync_sql(text: str) -> str:
    # RE2 knows only ASCII word boundaries, which is what the pages and source texts need here
    parts = [
        f"{w} * len(regexp_extract_all({text}, {quoted('(?i)' + p.replace('.*', '[^' + chr(92) + 'n]*'))}))"
        for p, w in code_text.sync_patterns().items()
    ]
    return " + ".join(parts)


def _nesting_sql(text: str) -> str:
    loop = quoted("(?i)(" + "|".join(schema.LOOP_PATTERNS) + ")")
    return (
        f"list_reduce(list_transform(string_split({text}, chr(10)), lambda l: "
        f"[CASE WHEN regexp_matches(l, {loop}) THEN 1 ELSE 0 END::BIGINT, "
        f"length(l) - length(replace(l, '{{', '')), length(l) - length(replace(l, '}}', '')), 0, 0, 0]), "
        f"lambda a, e: [0::BIGINT, 0, 0, "
        f"CASE WHEN a[4] + e[1] > 0 THEN greatest(0, a[4] + e[1] + e[2] - e[3]) ELSE 0 END::BIGINT, "
        f"CASE WHEN e[1] = 1 THEN greatest(a[5], a[4] + 1) ELSE a[5] END, "
        f"a[6] + CASE WHEN e[1] = 1 AND a[4] > 0 THEN 1 ELSE 0 END], [0::BIGINT, 0, 0, 0, 0, 0])"
    )


@query(
    "page_constructs",
    f"""SELECT page_id, CAST({_sync_sql('html')} AS BIGINT) AS sync_constructs_count,
               {_nesting_sql('html')}[5] AS max_loop_nesting_depth, {_nesting_sql('html')}[6] AS nested_loops_count
        FROM pages""",
)
def _page_constructs(spark, sf):
    pages = driver_tables.table(spark, sf, "pages").select("page_id", "html")
    return pages.withColumn("_n", code_text.brace_loop_nesting("html")).select(
        "page_id",
        code_text.sync_constructs("html").cast("long").alias("sync_constructs_count"),
        F.col("_n.max_depth").cast("long").alias("max_loop_nesting_depth"),
        F.col("_n.nested").cast("long").alias("nested_loops_count"),
    )


def _shape_sql(text: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches({text}, {quoted(p)}) THEN '{lang}'" for lang, p in schema.LANGUAGE_SHAPES
    )
    return f"CASE {cases} ELSE 'python' END"


@query(
    "page_languages",
    f"""SELECT page_id, {_shape_sql('html')} AS language, 'python' AS language_by_name FROM pages""",
)
def _page_languages(spark, sf):
    pages = driver_tables.table(spark, sf, "pages")
    return pages.select(
        "page_id",
        code_text.language_of("url", "html").alias("language"),
        code_text.language_by_name("url").alias("language_by_name"),
    )


@query(
    "source_languages",
    """SELECT 'src/order' || o_orderkey || ['.py', '.java', '.js'][o_orderkey % 3 + 1] AS file_path,
              ['python', 'java', 'javascript'][o_orderkey % 3 + 1] AS by_name,
              ['python', 'java', 'javascript'][o_orderkey % 3 + 1] AS by_shape
       FROM orders""",
)
def _source_languages(spark, sf):
    return driver_tables.source_changes(spark, sf).select(
        "file_path",
        code_text.language_by_name("file_path").alias("by_name"),
        code_text.language_of(F.lit("noext"), "after").alias("by_shape"),
    )


# --- history ----------------------------------------------------------------------------------


@query(
    "commit_log",
    f"""SELECT commit_hash, author,
               strftime(commit_ts - CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 2 HOURS ELSE INTERVAL 0 HOURS END, {ISO}) AS date,
               subject || ' a|b' AS subject
        FROM ({ORDER_COMMITS}) WHERE o_orderkey % 13 <> 0 AND o_orderkey % 11 <> 0""",
)
def _commit_log(spark, sf):
    parsed = history.parse_log(driver_tables.log_lines(spark, sf))
    return parsed.select(
        "commit_hash", "author", F.date_format("commit_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), "subject"
    )


@query(
    "commit_detail",
    f"""SELECT c.commit_hash, left(c.commit_hash, 7) AS short_hash, author, coalesce(insertions, 0) AS insertions,
               coalesce(deletions, 0) AS deletions, coalesce(total, 0) AS total, coalesce(files, 0) AS files,
               coalesce(files, 0) AS listed
        FROM ({ORDER_COMMITS}) c LEFT JOIN (
          SELECT commit_hash, CAST(sum(added) AS BIGINT) AS insertions, CAST(sum(deleted) AS BIGINT) AS deletions,
                 CAST(sum(added + deleted) AS BIGINT) AS total, count(*) AS files
          FROM ({FILE_CHANGES}) GROUP BY 1) s ON c.commit_hash = s.commit_hash""",
)
def _commit_detail(spark, sf):
    detail = history.commit_detail(
        driver_tables.order_commits(spark, sf), driver_tables.file_changes(spark, sf)
    )
    listed = F.coalesce(F.size("changed_files"), F.lit(0))
    return (
        detail.groupBy("commit_hash", "short_hash", "author", "insertions", "deletions", "total", "files")
        .agg(F.sum(F.greatest(listed, F.lit(0))).alias("listed"))
    )


@query(
    "changed_files",
    f"SELECT commit_hash, file_path AS path, pos, added, deleted FROM ({FILE_CHANGES})",
)
def _changed_files(spark, sf):
    changes = driver_tables.file_changes(spark, sf)
    return changes.select("commit_hash", F.col("file_path").alias("path"), "pos", "added", "deleted")


@query(
    "history_in_range",
    f"""SELECT commit_hash AS hash, left(commit_hash, 7) AS short_hash, author, strftime(commit_ts, {ISO}) AS date,
               subject || chr(10) || chr(10) || 'Priority ' || o_orderpriority AS message
        FROM ({ORDER_COMMITS}) WHERE commit_ts BETWEEN '1996-01-01' AND '1998-12-31'""",
)
def _history_in_range(spark, sf):
    commits = driver_tables.order_commits(spark, sf)
    return history.serialized(history.commit_history(commits, "1996-01-01", "1998-12-31"))


@query(
    "file_history",
    f"""SELECT commit_hash, strftime(commit_ts, {ISO}) AS date FROM ({ORDER_COMMITS})
        WHERE commit_hash IN (SELECT commit_hash FROM ({FILE_CHANGES}) WHERE file_path = 'src/part7.py')
        ORDER BY commit_ts DESC, commit_hash LIMIT 10""",
)
def _file_history(spark, sf):
    """The ten newest commits touching one file."""
    found = history.commit_history(
        driver_tables.order_commits(spark, sf),
        file_path="src/part7.py",
        file_changes=driver_tables.file_changes(spark, sf),
        max_count=10,
    )
    return found.select("commit_hash", F.date_format("commit_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("date"))


@query(
    "union_of_commits",
    f"""SELECT commit_hash, arg_min(origin, rank) AS origin FROM (
          SELECT commit_hash, 'chosen' AS origin, 0 AS rank FROM ({ORDER_COMMITS}) WHERE o_orderstatus = 'F'
          UNION ALL SELECT commit_hash, 'recent', 1 FROM ({ORDER_COMMITS}) WHERE commit_ts >= '1998-01-01')
        GROUP BY commit_hash""",
)
def _union_of_commits(spark, sf):
    commits = driver_tables.order_commits(spark, sf)
    chosen = commits.filter(F.col("subject").startswith("Fix")).select("commit_hash", F.lit("chosen").alias("origin"))
    recent = history.commit_history(commits, since="1998-01-01").select("commit_hash", F.lit("recent").alias("origin"))
    return history.union_commits(chosen, recent)


@query(
    "version_pairs",
    """SELECT doc_id, source, md5(coalesce(lag(text) OVER (PARTITION BY source ORDER BY doc_id), '')) AS before_md5,
              md5(text) AS after_md5 FROM documents""",
)
def _version_pairs(spark, sf):
    pairs = history.consecutive_pairs(driver_tables.document_versions(spark, sf), "source", "doc_id", "text")
    return pairs.select(
        "doc_id", "source", F.md5(F.encode("before", "UTF-8")).alias("before_md5"), F.md5(F.encode("after", "UTF-8")).alias("after_md5")
    )


def _file_versions(spark, sf):
    return driver_tables.table(spark, sf, "documents").select(
        F.col("source").alias("file_path"),
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("commit_hash"),
        F.timestamp_seconds("doc_id").alias("commit_ts"),
        F.col("text").alias("content"),
    )


@query(
    "newest_versions",
    "SELECT source AS file_path, max(doc_id) AS doc_id, md5(arg_max(text, doc_id)) AS content_md5 FROM documents GROUP BY 1",
)
def _newest_versions(spark, sf):
    versions = _file_versions(spark, sf)
    wanted = versions.select("file_path", F.lit(None).cast("string").alias("commit_hash")).distinct()
    return history.content_at(versions, wanted).select(
        "file_path", F.col("commit_hash").cast("long").alias("doc_id"), F.md5(F.encode("content", "UTF-8")).alias("content_md5")
    )


@query(
    "found_versions",
    """SELECT a.source AS file_path, a.doc_id + 1 AS doc_id, b.doc_id IS NOT NULL AS found, md5(b.text) AS content_md5
       FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1 AND b.source = a.source""",
)
def _found_versions(spark, sf):
    """The version of each file at the document after each of its own; mostly another file's, so not found."""
    versions = _file_versions(spark, sf)
    wanted = versions.select("file_path", (F.col("commit_hash").cast("long") + 1).cast("string").alias("commit_hash"))
    return history.content_at(versions, wanted, missing="keep").select(
        "file_path", F.col("commit_hash").cast("long").alias("doc_id"), "found",
        F.md5(F.encode("content", "UTF-8")).alias("content_md5"),
    )


@query(
    "first_files",
    f"""SELECT commit_hash, file_path, pos FROM (
          SELECT *, row_number() OVER (PARTITION BY commit_hash ORDER BY pos, file_path) AS rn FROM ({FILE_CHANGES}))
        WHERE rn <= 5""",
)
def _first_files(spark, sf):
    return history.first_files(driver_tables.file_changes(spark, sf), 5).select("commit_hash", "file_path", "pos")


# --- history metrics --------------------------------------------------------------------------

RECENT = f"commit_ts >= TIMESTAMP '{NOW}' - INTERVAL 30 DAYS AND commit_ts <= TIMESTAMP '{NOW}'"
ACTIVE = f"commit_ts >= TIMESTAMP '{NOW}' - INTERVAL 90 DAYS AND commit_ts <= TIMESTAMP '{NOW}'"

NOW_METRICS = f"""
    WITH c AS ({FILE_CHANGES}),
    lead AS (
      SELECT file_path, author FROM (
        SELECT file_path, author, row_number() OVER (
                 PARTITION BY file_path ORDER BY count(*) DESC, max(commit_ts) DESC, author) AS rn
        FROM c WHERE {ACTIVE} GROUP BY file_path, author) WHERE rn = 1),
    first AS (
      SELECT file_path, commit_ts, commit_hash FROM (
        SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY commit_ts, commit_hash) AS rn
        FROM c WHERE commit_ts <= TIMESTAMP '{NOW}') WHERE rn = 1),
    sums AS (
      SELECT file_path,
             CAST(coalesce(sum(added) FILTER (WHERE {RECENT}), 0) AS BIGINT) AS additions,
             CAST(coalesce(sum(deleted) FILTER (WHERE {RECENT}), 0) AS BIGINT) AS deletions,
             count(*) FILTER (WHERE {RECENT}) AS commit_count,
             count(DISTINCT author) FILTER (WHERE {ACTIVE}) AS developer_count
      FROM c GROUP BY file_path)
    SELECT s.file_path, additions + deletions AS churn, additions, deletions, additions - deletions AS net_churn,
           commit_count, developer_count, l.author AS most_active_developer,
           round(commit_count / 30.0, 6) AS commit_frequency, round(commit_count / (30 / 7.0), 6) AS commits_per_week,
           coalesce(CAST(floor(date_diff('second', f.commit_ts, TIMESTAMP '{NOW}') / 86400) AS BIGINT), 0) AS file_age_days,
           f.commit_hash AS first_commit_hash
    FROM sums s LEFT JOIN lead l ON s.file_path = l.file_path LEFT JOIN first f ON s.file_path = f.file_path"""


@query("process_metrics_now", NOW_METRICS)
def _process_metrics_now(spark, sf):
    return rounded(
        process.metrics_now(driver_tables.file_changes(spark, sf), NOW).drop("first_commit_ts"),
        "commit_frequency",
        "commits_per_week",
    )


@query(
    "process_features",
    f"""SELECT file_path, churn AS churn_30d, additions AS additions_30d, deletions AS deletions_30d,
               net_churn AS net_churn_30d, commit_count AS commit_count_30d, developer_count AS developer_count_90d,
               commit_frequency AS commit_frequency_30d, commits_per_week, file_age_days FROM ({NOW_METRICS})""",
)
def _process_features(spark, sf):
    metrics = process.metrics_now(driver_tables.file_changes(spark, sf), NOW)
    return rounded(process.as_features(metrics), "commit_frequency_30d", "commits_per_week")


@query(
    "developer_commits",
    f"SELECT file_path, author, count(*) AS commits FROM ({FILE_CHANGES}) WHERE {ACTIVE} GROUP BY 1, 2",
)
def _developer_commits(spark, sf):
    return process.developer_commits(driver_tables.file_changes(spark, sf), NOW)


AT_COMMITS = f"""
    WITH c AS ({FILE_CHANGES}), w AS (
      SELECT file_path, commit_ts, sum(added) OVER d30 AS a, sum(deleted) OVER d30 AS d, count(*) OVER d30 AS n,
             count(DISTINCT author) OVER (PARTITION BY file_path ORDER BY commit_ts
               RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW) AS devs,
             min(commit_ts) OVER (PARTITION BY file_path) AS first
      FROM c WINDOW d30 AS (PARTITION BY file_path ORDER BY commit_ts
               RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW))
    SELECT DISTINCT file_path, CAST(epoch(commit_ts) AS BIGINT) AS commit_second, CAST(a + d AS BIGINT) AS churn_30d,
           CAST(a AS BIGINT) AS additions_30d, CAST(d AS BIGINT) AS deletions_30d, CAST(a - d AS BIGINT) AS net_churn_30d,
           n AS commit_count_30d, devs AS developer_count_90d, round(n / 30.0, 6) AS commit_frequency_30d,
           round(n / (30 / 7.0), 6) AS commits_per_week,
           CAST(floor(date_diff('second', first, commit_ts) / 86400) AS BIGINT) AS file_age_days
    FROM w"""


@query("process_metrics_at_commits", AT_COMMITS)
def _process_metrics_at_commits(spark, sf):
    return rounded(
        process.metrics_at_commits(driver_tables.file_changes(spark, sf)), "commit_frequency_30d", "commits_per_week"
    )


# --- tracing ----------------------------------------------------------------------------------

TRACED = f"""
    commits AS (
      SELECT *, lag(commit_hash) OVER (PARTITION BY author ORDER BY commit_ts, commit_hash) AS parent_hash,
             o_orderstatus = 'F' OR o_orderkey % 5 = 0 AS is_bug_fix,
             o_orderkey % 5 = 0 AND 'PART-' || o_custkey IN ({CONFIRMING}) AS issue_confirmed
      FROM ({ORDER_COMMITS})),
    touches AS (
      SELECT *, lag(commit_hash) OVER (PARTITION BY file_path, line_no ORDER BY commit_ts, commit_hash) AS origin
      FROM (SELECT DISTINCT commit_hash, commit_ts, file_path, pos AS line_no FROM ({FILE_CHANGES}))),
    traced AS (
      SELECT t.commit_hash AS fix_hash, origin AS inducing_hash, file_path, line_no
      FROM touches t JOIN commits c ON t.commit_hash = c.commit_hash
      WHERE is_bug_fix AND parent_hash IS NOT NULL AND origin IS NOT NULL AND origin <> parent_hash)"""


def _history(spark, sf):
    commits = driver_tables.with_parents(driver_tables.order_commits(spark, sf))
    changes = driver_tables.file_changes(spark, sf).withColumnRenamed("pos", "line_no")
    return commits, changes


def _analysis(spark, sf, with_issues: bool = True):
    commits, changes = _history(spark, sf)
    return mining.analyze(commits, changes, issues=_issues(spark, sf) if with_issues else None)


@query(
    "commit_parents",
    f"WITH {TRACED} SELECT commit_hash, parent_hash FROM commits",
)
def _commit_parents(spark, sf):
    return _history(spark, sf)[0].select("commit_hash", "parent_hash")


@query(
    "bug_fix_commits",
    f"""WITH {TRACED} SELECT commit_hash, issue_confirmed,
          CASE WHEN issue_confirmed THEN 'PART-' || o_custkey END AS issue_key FROM commits WHERE is_bug_fix""",
)
def _bug_fix_commits(spark, sf):
    flagged = szz.identify_fixes(driver_tables.order_commits(spark, sf), _issues(spark, sf))
    return flagged.filter("is_bug_fix").select("commit_hash", "issue_confirmed", "issue_key")


@query(
    "strict_bug_fix_commits",
    f"""WITH {TRACED} SELECT commit_hash FROM commits WHERE o_orderstatus = 'F' OR issue_confirmed""",
)
def _strict_bug_fix_commits(spark, sf):
    flagged = szz.identify_fixes(driver_tables.order_commits(spark, sf), _issues(spark, sf), strict=True)
    return flagged.filter("is_bug_fix").select("commit_hash")


@query("inducing_lines", f"WITH {TRACED} SELECT fix_hash, inducing_hash, file_path, line_no FROM traced")
def _inducing_lines(spark, sf):
    commits, changes = _history(spark, sf)
    fixes = szz.identify_fixes(commits).filter("is_bug_fix")
    return szz.inducing_from_history(fixes, changes, ["file_path", "line_no"])


@query(
    "inducing_lines_from_blame",
    f"WITH {TRACED} SELECT fix_hash, inducing_hash, file_path, line_no FROM traced",
)
def _inducing_lines_from_blame(spark, sf):
    """The same trace through an exported blame table keyed by the fix's parent.

    Only parents of fixes are asked for a blame and only lines of fixes are looked up: both marks reach the line items
    where they are still keyed by order. Hashes are bytes until the end.
    """
    unit = ["file_path", "line_no"]
    flagged = szz.identify_fixes(driver_tables.with_parents(driver_tables.order_commits(spark, sf)))
    flagged = flagged.filter(F.col("parent_hash").isNotNull())
    packed = [F.unhex(c).alias(c) for c in ("commit_hash", "parent_hash")]
    commits = materialize(flagged.select("o_orderkey", *packed, "is_bug_fix"), "commits")
    fixes = commits.filter("is_bug_fix").select("commit_hash", "parent_hash")
    asked = commits.join(fixes.select("parent_hash"), "parent_hash", "left_semi")
    marks = asked.groupBy("o_orderkey").agg(F.collect_list("parent_hash").alias("parents"), F.max("is_bug_fix").alias("is_fix"))
    changes = driver_tables.file_changes(spark, sf, marks).withColumnRenamed("pos", "line_no")
    changes = changes.select(F.unhex("commit_hash").alias("commit_hash"), *unit, "commit_ts", "parents", "is_fix")
    changes = materialize(changes, "touches")
    origin = szz.previous_touch(changes, unit, kept=("parents",), written=True)
    blame = origin.select(*unit, F.explode("parents").alias("at_commit"), "origin_hash")
    # meeting the fixes by hash deals the lines out as their distinct rows and the next join need them
    lines = changes.filter("is_fix").select("commit_hash", *unit).join(fixes, "commit_hash", "left_semi").distinct()
    traced = szz.inducing_lines(fixes, lines, blame)
    return traced.withColumns({c: F.lower(F.hex(c)) for c in ("fix_hash", "inducing_hash")})


@query(
    "line_origins",
    """WITH v AS (SELECT doc_id, coalesce(source, '') AS f, text, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) AS n FROM documents),
       l AS (
         SELECT DISTINCT f, doc_id, n, line FROM (SELECT f, doc_id, n, unnest(string_split(text, chr(10))) AS line FROM v) WHERE line <> ''),
       p AS (
         SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS line_no,
                n - row_number() OVER (PARTITION BY f, line ORDER BY n) AS island FROM l)
       SELECT f AS file_path, CAST(doc_id AS VARCHAR) AS at_commit, CAST(line_no AS INTEGER) AS line_no,
              CAST(first_value(doc_id) OVER w AS VARCHAR) AS origin_hash, CAST(first_value(line_no) OVER w AS INTEGER) AS origin_line
       FROM p WINDOW w AS (PARTITION BY f, line, island ORDER BY n)""",
)
def _line_origins(spark, sf):
    """The document that brought each line, with the documents of a source as versions of one file."""
    versions = driver_tables.line_versions(spark, sf)
    named = F.col("doc_id").cast("string").alias("commit_hash")
    linked = previous_row(versions.select("file_path", "doc_id"), ["file_path"], "doc_id", ["doc_id"])
    before = linked.select("file_path", named, F.col("prev.doc_id").cast("string").alias("before_hash"))
    runs = line_origins.version_runs(versions.select("file_path", named, "content"), before.filter("before_hash IS NOT NULL"))
    return line_origins.origins(runs)


@query(
    "inducing_commits",
    f"""WITH {TRACED}, ordered AS (
          SELECT *, row_number() OVER (PARTITION BY inducing_hash ORDER BY fix_hash, file_path, line_no) AS rn FROM traced)
        SELECT inducing_hash, fix_hash, file_path, line_no FROM ordered WHERE rn = 1""",
)
def _inducing_commits(spark, sf):
    return _analysis(spark, sf, with_issues=False).inducing


@query(
    "commit_labels",
    f"""WITH {TRACED} SELECT commit_hash,
          CASE WHEN commit_hash IN (SELECT inducing_hash FROM traced) THEN 'BUGGY' ELSE 'CLEAN' END AS label FROM commits""",
)
def _commit_labels(spark, sf):
    return _analysis(spark, sf, with_issues=False).commits.select("commit_hash", "label")


@query(
    "clean_commits",
    f"WITH {TRACED} SELECT commit_hash FROM commits WHERE commit_hash NOT IN (SELECT inducing_hash FROM traced)",
)
def _clean_commits(spark, sf):
    commits, changes = _history(spark, sf)
    fixes = szz.identify_fixes(commits).filter("is_bug_fix")
    traced = szz.inducing_from_history(fixes, changes, ["file_path", "line_no"])
    return szz.clean_commits(commits, traced).select("commit_hash")


@query(
    "tracing_statistics",
    f"""WITH {TRACED}, l AS (SELECT *, commit_hash IN (SELECT inducing_hash FROM traced) AS buggy FROM commits)
        SELECT count(*) AS total_commits, count(*) FILTER (WHERE is_bug_fix) AS bug_fix_commits,
               count(*) FILTER (WHERE buggy) AS bug_inducing_commits, count(*) FILTER (WHERE buggy) AS buggy_labeled,
               count(*) FILTER (WHERE NOT buggy) AS clean_labeled,
               round(count(*) FILTER (WHERE is_bug_fix) / count(*), 6) AS bug_fix_ratio,
               round(count(*) FILTER (WHERE buggy) / count(*), 6) AS bug_inducing_ratio, true AS jira_enabled,
               count(*) FILTER (WHERE issue_confirmed) AS jira_enhanced_commits
        FROM l""",
)
def _tracing_statistics(spark, sf):
    return rounded(_analysis(spark, sf).statistics, "bug_fix_ratio", "bug_inducing_ratio")


# --- diffs ------------------------------------------------------------------------------------

PAIRS = """
    SELECT t.conv_id, t.turn, coalesce(b.text, '') AS before, t.text AS after,
           len(string_split(coalesce(b.text, ''), chr(10))) AS nb, len(string_split(t.text, chr(10))) AS na
    FROM conversations t LEFT JOIN conversations b ON t.conv_id = b.conv_id AND t.turn = b.turn + 1"""


@query(
    "changed_lines",
    f"""SELECT DISTINCT conv_id, turn, CAST(unnest(list_concat([1, turn * 20 + 703 + 1],
               range(turn * 20 + 3 + nb, turn * 20 + 3 + nb + na))) AS INTEGER) AS line_no FROM ({PAIRS})""",
)
def _changed_lines(spark, sf):
    return driver_tables.conversation_diffs(spark, sf).select(
        "conv_id", "turn", F.explode(diffs.changed_lines_literal("diff")).alias("line_no")
    )


@query(
    "deleted_lines",
    f"""SELECT DISTINCT conv_id, turn, CAST(unnest(list_concat([turn * 10 + 501],
               range(turn * 10 + 2, turn * 10 + 2 + nb))) AS INTEGER) AS line_no FROM ({PAIRS})""",
)
def _deleted_lines(spark, sf):
    return driver_tables.conversation_diffs(spark, sf).select(
        "conv_id", "turn", F.explode(diffs.deleted_lines_old_side("diff")).alias("line_no")
    )


@query(
    "blame_lines",
    """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS line_no,
              CASE i % 4 WHEN 0 THEN h WHEN 1 THEN left(h, 8) ELSE left(h, 7) END AS origin_hash
       FROM (SELECT doc_id, i, sha1(lines[i + 1]) AS h FROM (
               SELECT doc_id, lines, unnest(range(0, len(lines))) AS i FROM (
                 SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)))
       WHERE i % 4 <> 3""",
)
def _blame_lines(spark, sf):
    return diffs.blame_lines(driver_tables.blame_texts(spark, sf), "blame", ["doc_id"])


@query(
    "multiset_line_diff",
    f"""WITH p AS ({PAIRS}), l AS (
          SELECT conv_id, turn, 1 AS d, unnest(string_split(after, chr(10))) AS line FROM p WHERE after <> ''
          UNION ALL SELECT conv_id, turn, -1, unnest(string_split(before, chr(10))) FROM p WHERE before <> ''),
        n AS (SELECT conv_id, turn, line, sum(d) AS n FROM l GROUP BY 1, 2, 3)
        SELECT conv_id, turn, CAST(sum(greatest(n, 0)) AS BIGINT) AS added,
               CAST(sum(greatest(-n, 0)) AS BIGINT) AS deleted FROM n GROUP BY 1, 2""",
)
def _multiset_line_diff(spark, sf):
    pairs = driver_tables.conversation_diffs(spark, sf)
    return diffs.multiset_line_diff(pairs, ["conv_id", "turn"], "before", "text")


# --- source features --------------------------------------------------------------------------

# d loops nested, m branches and a lock for even j, as written by the source adapter
SOURCES = """
    o AS (
      SELECT o_orderkey AS k, o_orderkey % 3 AS lang, 1 + o_orderkey % 4 AS n,
             CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 4 = 0 THEN 1 ELSE o_orderkey % 4 END AS nb,
             sha1(CAST(o_orderkey AS VARCHAR)) AS commit_hash, 'dev' || o_custkey AS author, o_orderdate AS commit_ts,
             'src/order' || o_orderkey || ['.py', '.java', '.js'][o_orderkey % 3 + 1] AS file_path,
             CASE o_orderstatus WHEN 'F' THEN 'Fix order ' WHEN 'O' THEN 'Add order ' ELSE 'Change order ' END
               || o_orderkey || CASE WHEN o_orderkey % 5 = 0 THEN ' refs PART-' || o_custkey ELSE '' END
               || chr(10) || chr(10) || 'Priority ' || o_orderpriority AS message
      FROM orders),
    f AS (
      SELECT *, CASE lang WHEN 0 THEN 2 + d + 2 * m + 2 * lock WHEN 1 THEN 3 + 2 * d + lock ELSE 2 + d END AS len FROM (
        SELECT *, (k + j) % 4 AS d, (k * j) % 3 AS m, CASE WHEN j % 2 = 0 THEN 1 ELSE 0 END AS lock FROM (
          SELECT k, lang, n, unnest(range(1, n + 1)) AS j FROM o))),
    g AS (
      SELECT *, CAST(CASE lang WHEN 2 THEN 2 ELSE 3 END + coalesce(sum(len) OVER (
                  PARTITION BY k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
      FROM f)"""

FILE_FEATURES = f"""
    {SOURCES}, t AS (
      SELECT k, sum(len) AS lines, sum(lock) AS locks, sum(1 + d + m) AS score, max(d) AS deepest,
             sum(greatest(d - 1, 0)) AS inner_loops, arg_max(len, j) AS last_len,
             sum(CASE lang WHEN 0 THEN 6 + 5 * d + 4 * m + 4 * lock WHEN 1 THEN 9 + 7 * d + 4 * lock ELSE 3 + 3 * d END) AS tokens
      FROM f GROUP BY k),
    nest AS (
      SELECT k, list_reduce(list_transform(range(1, n + 1), lambda j: [(k + j) % 4, 0, 0, 0]::BIGINT[]), lambda a, e: [
          0, CASE WHEN lang = 1 THEN CASE WHEN a[2] > 0 THEN a[2] + e[1] ELSE greatest(0, e[1] - 1) END
                  ELSE greatest(0, CASE WHEN a[2] > 0 THEN a[2] + 1 ELSE 0 END + e[1] - 1) END,
          CASE WHEN e[1] = 0 THEN a[3] ELSE greatest(a[3], CASE WHEN a[2] > 0 THEN a[2] + 1 ELSE 0 END
               + CASE WHEN lang = 1 THEN 2 * (e[1] - 1) + 1 ELSE e[1] END) END,
          a[4] + CASE WHEN e[1] = 0 THEN 0 WHEN a[2] > 0 THEN e[1] ELSE e[1] - 1 END]::BIGINT[],
        [0, 0, 0, 0]::BIGINT[]) AS r FROM o),
    feat AS (
      SELECT o.*, lines + CASE lang WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS total, last_len, score, locks, tokens,
             deepest, inner_loops, r FROM o JOIN t ON o.k = t.k JOIN nest ON o.k = nest.k),
    features AS (
      SELECT file_path, commit_hash, message, author, commit_ts,
             CAST(CASE WHEN nb = 0 THEN total WHEN n = nb THEN 1 ELSE 1 + last_len END AS DOUBLE) AS added_lines,
             CAST(CASE WHEN nb = 0 THEN 0 ELSE 1 END AS DOUBLE) AS deleted_lines,
             CAST(total AS DOUBLE) AS nloc,
             round(CASE WHEN lang = 0 THEN (floor((1 + score) / n) + CASE WHEN n > 1 THEN 1 ELSE 0 END + score) / (n + 1) ELSE 0.0 END, 6) AS complexity,
             CAST(tokens + CASE lang WHEN 0 THEN 4 WHEN 1 THEN 5 ELSE 2 END AS DOUBLE) AS token_count,
             CAST(length(message) AS DOUBLE) AS commit_msg_length,
             CAST(len(regexp_extract_all(message, '[^ \\n]+')) AS DOUBLE) AS commit_msg_word_count,
             CAST(length(replace(message, ' ', '')) AS DOUBLE) AS commit_msg_char_count,
             CAST(CASE lang WHEN 0 THEN 3 * locks WHEN 1 THEN locks ELSE 0 END AS DOUBLE) AS sync_constructs_count,
             CAST(CASE WHEN lang = 0 THEN deepest ELSE r[3] END AS DOUBLE) AS max_loop_nesting_depth,
             CAST(CASE WHEN lang = 0 THEN inner_loops ELSE r[4] END AS DOUBLE) AS nested_loops_count
      FROM feat)"""

FEATURE_LIST = """added_lines, deleted_lines, nloc, complexity, token_count, commit_msg_length, commit_msg_word_count,
    commit_msg_char_count, added_lines + deleted_lines AS total_changes, added_lines - deleted_lines AS net_lines,
    added_lines + deleted_lines AS code_churn, sync_constructs_count, max_loop_nesting_depth, nested_loops_count"""


@query("file_features", f"WITH {FILE_FEATURES} SELECT file_path, {FEATURE_LIST} FROM features")
def _file_features(spark, sf):
    featured = features.file_features(driver_tables.source_changes(spark, sf))
    return rounded(featured.select("file_path", *schema.SAFE_FEATURES), "complexity")


FUNCTIONS = f"""
    {SOURCES}, all_functions AS (
      SELECT k, lang, j, 'step_' || j AS name, CASE WHEN lang = 1 THEN s - 1 ELSE s END AS start_line,
             CASE WHEN lang = 2 THEN s + len ELSE s + len - 1 END AS end_line,
             CASE lang WHEN 0 THEN 'self,n' WHEN 1 THEN 'n,s' ELSE '' END AS parameters FROM g
      UNION ALL
      SELECT k, lang, j, 'for', s + l - 1, s + d + 2 + d - l, 'i++' FROM (
        SELECT *, unnest(range(1, d + 1)) AS l FROM g WHERE lang = 1 AND d > 0)
      UNION ALL
      SELECT k, lang, j, 'synchronized', s + 2 * d + 1, s + 2 * d + 2, 'this' FROM g WHERE lang = 1 AND lock = 1),
    inventory AS (
      SELECT k, j, 'src/order' || k || ['.py', '.java', '.js'][lang + 1] AS file_path, name,
             CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, lang < 2 AS is_method,
             CASE WHEN lang < 2 THEN 'Order' || k END AS class_name, parameters
      FROM all_functions)"""


@query(
    "function_inventory",
    f"""WITH {FUNCTIONS} SELECT file_path, name, start_line, end_line, is_method, class_name, parameters FROM inventory""",
)
def _function_inventory(spark, sf):
    sources = driver_tables.source_changes(spark, sf).withColumn("language", code_text.language_by_name("file_path"))
    found = extraction.explode_functions(sources, "after", "language", ["file_path"])
    return found.select(
        "file_path", "name", "start_line", "end_line", "is_method", "class_name",
        F.array_join("parameters", ",").alias("parameters"),
    )


@query(
    "functions_on_both_sides",
    f"""WITH {FUNCTIONS}
        SELECT file_path, 'after' AS side, name, start_line, end_line, is_method, class_name FROM inventory
        UNION ALL SELECT inventory.file_path, 'before', name, start_line, end_line, is_method, class_name
        FROM inventory JOIN o ON inventory.k = o.k WHERE j <= nb""",
)
def _functions_on_both_sides(spark, sf):
    sources = driver_tables.source_changes(spark, sf).withColumn("language", code_text.language_by_name("file_path"))
    found = extraction.explode_both_sides(sources, "before", "after", "language", ["file_path"])
    return found.select("file_path", "side", "name", "start_line", "end_line", "is_method", "class_name")


@query("function_features")
def _function_features(spark, sf):
    sources = driver_tables.source_changes(spark, sf).withColumn("language", code_text.language_by_name("file_path"))
    return features.function_features(sources).select(
        "file_path", "function_name", "function_start_line", "function_end_line", "is_method", "class_name",
        *schema.SAFE_FEATURES,
    )


@query("document_line_changes")
def _document_line_changes(spark, sf):
    """Line changes and prose metrics between successive documents of a source."""
    pairs = history.consecutive_pairs(driver_tables.document_versions(spark, sf), "source", "doc_id", "text")
    return features.file_features(pairs.withColumn("message", F.lit("update"))).select("doc_id", *schema.SAFE_FEATURES)


def _labels(spark, sf):
    return _analysis(spark, sf, with_issues=False).commits.select("commit_hash", "label")


@query(
    "labelled_dataset",
    f"""WITH {FILE_FEATURES.strip()}, {TRACED}
        SELECT file_path, '' AS function_name, 0 AS function_start_line, 0 AS function_end_line, false AS is_method,
               '' AS class_name, f.commit_hash, f.message AS commit_message, f.author, strftime(f.commit_ts, {ISO}) AS date,
               {FEATURE_LIST},
               CASE WHEN f.commit_hash IN (SELECT inducing_hash FROM traced) THEN 'BUGGY' ELSE 'CLEAN' END AS label
        FROM features f""",
)
def _labelled_dataset(spark, sf):
    return rounded(mining.labelled_dataset(driver_tables.source_changes(spark, sf), _labels(spark, sf)), "complexity")


@query(
    "mined_dataset",
    f"""WITH {TRACED.strip()}, numbered AS (
          SELECT *, row_number() OVER (PARTITION BY author ORDER BY commit_ts, commit_hash) AS v, 8 + o_orderkey % 5 AS n,
                 subject || chr(10) || chr(10) || 'Priority ' || o_orderpriority AS message FROM commits),
        assigned AS (
          SELECT author, commit_hash, v, s, o_orderkey // s % 3 AS x FROM (SELECT *, unnest(range(1, n + 1)) AS s FROM numbered)),
        islands AS (SELECT *, v - row_number() OVER (PARTITION BY author, s, x ORDER BY v) AS island FROM assigned),
        lives AS (
          SELECT author, min(v) AS first_v, max(v) AS last_v, arg_min(commit_hash, v) AS origin, arg_max(commit_hash, v) AS last_hash
          FROM islands GROUP BY author, s, x, island),
        brought AS (
          SELECT DISTINCT origin FROM lives JOIN numbered ON numbered.author = lives.author AND v = last_v + 1
          WHERE is_bug_fix AND origin <> last_hash),
        came AS (SELECT author, first_v AS v, count(*) AS n FROM lives GROUP BY 1, 2),
        went AS (SELECT author, last_v + 1 AS v, count(*) AS n FROM lives GROUP BY 1, 2),
        features AS (
          SELECT c.*, CAST(coalesce(came.n, 0) AS DOUBLE) AS added_lines, CAST(coalesce(went.n, 0) AS DOUBLE) AS deleted_lines,
                 CAST(c.n AS DOUBLE) AS nloc, 0.0::DOUBLE AS complexity, CAST(2 * c.n AS DOUBLE) AS token_count,
                 CAST(length(message) AS DOUBLE) AS commit_msg_length,
                 CAST(len(regexp_extract_all(message, '[^ \n]+')) AS DOUBLE) AS commit_msg_word_count,
                 CAST(length(replace(message, ' ', '')) AS DOUBLE) AS commit_msg_char_count,
                 0.0::DOUBLE AS sync_constructs_count, 0.0::DOUBLE AS max_loop_nesting_depth, 0.0::DOUBLE AS nested_loops_count
          FROM numbered c LEFT JOIN came ON came.author = c.author AND came.v = c.v
          LEFT JOIN went ON went.author = c.author AND went.v = c.v)
        SELECT 'src/' || author || '.py' AS file_path, '' AS function_name, 0 AS function_start_line, 0 AS function_end_line,
               false AS is_method, '' AS class_name, commit_hash, message AS commit_message, author,
               strftime(commit_ts, {ISO}) AS date, {FEATURE_LIST},
               CASE WHEN commit_hash IN (SELECT origin FROM brought) THEN 'BUGGY' ELSE 'CLEAN' END AS label
        FROM features""",
)
def _mined_dataset(spark, sf):
    """From commits and file versions alone to the labelled dataset: fixes are traced through the texts."""
    commits = driver_tables.with_parents(driver_tables.order_commits(spark, sf))
    versions = driver_tables.customer_versions(spark, sf)
    dataset, _ = mining.mine(commits, versions.select("commit_hash", "file_path"), versions, trace_texts=True)
    return rounded(dataset, "complexity")


@query("labelled_functions")
def _labelled_functions(spark, sf):
    """The function-level dataset with point-in-time history metrics of the file."""
    changes = driver_tables.source_changes(spark, sf)
    touched = features.changed_lines(changes).select(
        "file_path", "commit_hash", "author", "commit_ts",
        F.col("added_lines").cast("int").alias("added"), F.col("deleted_lines").cast("int").alias("deleted"),
    )
    return mining.labelled_dataset(
        changes, _labels(spark, sf), function_level=True, process_metrics=process.metrics_at_commits(touched)
    )


# --- datasets ---------------------------------------------------------------------------------


@query(
    "aligned_union",
    """SELECT doc_id, n_chars, lang, 0 AS conv_id, '' AS file_path, CASE WHEN quality = 0 THEN 'BUGGY' ELSE 'CLEAN' END AS label
       FROM documents LEFT JOIN labels USING (doc_id)
       UNION ALL SELECT 0, turn, '', conv_id, role, 'CLEAN' FROM conversations""",
)
def _aligned_union(spark, sf):
    label = F.when(F.col("quality") == 0, "BUGGY").otherwise("CLEAN")
    base = (
        driver_tables.table(spark, sf, "documents")
        .select("doc_id", "n_chars", "lang")
        .join(driver_tables.table(spark, sf, "labels"), "doc_id", "left")
        .select("doc_id", "n_chars", "lang", label.alias("label"))
    )
    mined = driver_tables.table(spark, sf, "conversations").select(
        "conv_id", F.col("turn").alias("n_chars"), F.col("role").alias("file_path")
    )
    return datasets.aligned_union(base, mined)


def _line_rows(spark, sf):
    """Line items as labelled rows: returned ones are BUGGY."""
    lines = driver_tables.table(spark, sf, "lineitem")
    return lines.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_extendedprice").cast("long")).alias("row_id"),
        F.col("l_quantity").alias("added_lines"),
        F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.floor(F.col("l_quantity") * F.col("l_tax")).cast("double")).alias("deleted_lines"),
        F.when(F.col("l_linestatus") == "F", F.lit("n/a")).otherwise(F.col("l_linenumber").cast("string")).alias("nloc"),
        F.lit(1).alias("is_bug_fix"),
        F.when(F.col("l_returnflag") == "R", "BUGGY").when(F.col("l_returnflag") == "A", "CLEAN").alias("label"),
    )


LINE_ID = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT))"
PREPARED = f"""
    SELECT row_id, a AS added_lines, d AS deleted_lines, nloc, a + d AS total_changes, a - d AS net_lines, a + d AS code_churn, y
    FROM (SELECT {LINE_ID} AS row_id, l_quantity AS a,
                 CASE WHEN l_linenumber = 7 THEN 0.0 ELSE CAST(floor(l_quantity * l_tax) AS DOUBLE) END AS d,
                 CASE WHEN l_linestatus = 'F' THEN 0.0 ELSE CAST(l_linenumber AS DOUBLE) END AS nloc,
                 CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)"""


@query("prepared_features", PREPARED)
def _prepared_features(spark, sf):
    return datasets.prepare(_line_rows(spark, sf), keep=["row_id"])[0]


@query(
    "dataset_size",
    "SELECT count(*) AS n_rows, CASE WHEN count(*) < 20 THEN 'very small' WHEN count(*) < 100 THEN 'small' ELSE 'ok' END AS verdict FROM lineitem",
)
def _dataset_size(spark, sf):
    return datasets.size_warning(_line_rows(spark, sf))


@query(
    "label_distribution",
    """SELECT CASE l_returnflag WHEN 'R' THEN 'BUGGY' WHEN 'A' THEN 'CLEAN' END AS label, count(*) AS n
       FROM lineitem GROUP BY 1""",
)
def _label_distribution(spark, sf):
    return datasets.label_distribution(_line_rows(spark, sf))


LEARN = ["added_lines", "deleted_lines", "nloc", "total_changes", "net_lines"]


def _learning_rows(spark, sf):
    return datasets.prepare(_line_rows(spark, sf), keep=["row_id"])[0]


@query(
    "stratified_split",
    f"""SELECT row_id, y, rn <= round(n * 0.3) AS is_test FROM (
          SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || row_id)) AS rn,
                 count(*) OVER (PARTITION BY y) AS n FROM ({PREPARED}))""",
)
def _stratified_split(spark, sf):
    return sampling.stratified_split(_learning_rows(spark, sf).select("row_id", "y"), "y", "row_id", 0.3)


@query(
    "stratified_folds",
    f"""SELECT row_id, y, CAST(CASE WHEN rn <= floor(n * 1 / 5) THEN 0 WHEN rn <= floor(n * 2 / 5) THEN 1
               WHEN rn <= floor(n * 3 / 5) THEN 2 WHEN rn <= floor(n * 4 / 5) THEN 3 ELSE 4 END AS INTEGER) AS fold FROM (
          SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || row_id)) AS rn,
                 count(*) OVER (PARTITION BY y) AS n FROM ({PREPARED}))""",
)
def _stratified_folds(spark, sf):
    return sampling.stratified_folds(_learning_rows(spark, sf).select("row_id", "y"), "y", "row_id")


def _per_feature(expression: str) -> str:
    """One SELECT per feature, joined by UNION ALL; {f} is the feature and {i} its position."""
    return " UNION ALL ".join(expression.replace("{f}", f).replace("{i}", str(i)) for i, f in enumerate(LEARN))


@query(
    "anova_scores",
    f"WITH p AS ({PREPARED}) "
    + _per_feature(
        """SELECT {i} AS position, '{f}' AS feature, round((b / 1) / (w / (n - 2)), 4) AS score FROM (
             SELECT sum(cn * (cm - m) * (cm - m)) AS b, sum(cn * cv) AS w, sum(cn) AS n FROM (
               SELECT y, count(*) AS cn, avg({f}) AS cm, var_pop({f}) AS cv, (SELECT avg({f}) FROM p) AS m FROM p GROUP BY y))"""
    ),
)
def _anova_scores(spark, sf):
    return rounded(selection.anova_scores(_learning_rows(spark, sf), LEARN), "score", digits=4)


@query(
    "chi2_scores",
    f"WITH p AS ({PREPARED}) "
    + _per_feature(
        """SELECT {i} AS position, '{f}' AS feature, round(sum((o - e) * (o - e) / e), 4) AS score FROM (
             SELECT y, sum({f} - lo + 1) AS o, count(*) / any_value(n) * any_value(t) AS e
             FROM p, (SELECT min({f}) AS lo, count(*) AS n, sum({f}) - min({f}) * count(*) + count(*) AS t FROM p) GROUP BY y)"""
    ),
)
def _chi2_scores(spark, sf):
    return rounded(selection.chi2_scores(_learning_rows(spark, sf), LEARN), "score", digits=4)


@query(
    "mutual_information",
    f"WITH p AS ({PREPARED}) "
    + _per_feature(
        """SELECT {i} AS position, '{f}' AS feature, round(sum(nj / n * ln(nj * n / (nb * ny))), 6) AS score FROM (
             SELECT count(*) AS nj, sum(count(*)) OVER () AS n, sum(count(*)) OVER (PARTITION BY b) AS nb,
                    sum(count(*)) OVER (PARTITION BY y) AS ny FROM (
               SELECT y, least(31, floor(({f} - lo) / (hi - lo) * 32)) AS b
               FROM p, (SELECT min({f}) AS lo, max({f}) AS hi FROM p)) GROUP BY b, y)"""
    ),
)
def _mutual_information(spark, sf):
    return rounded(selection.mutual_information(_learning_rows(spark, sf), LEARN), "score")


MEASURED = ["price", "quantity", "charge"]


@query(
    "neighbour_information",
    """WITH f AS (
         SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, unnest([0, 1, 2]) AS position,
                unnest([l_extendedprice, l_quantity, l_quantity * 64 + l_linenumber]) AS x FROM lineitem),
       points AS (
         SELECT *, count(*) OVER (PARTITION BY position, y) AS class_rows, least(
             coalesce(lead(x, 3) OVER w, 'inf'::DOUBLE) - x,
             greatest(x - coalesce(lag(x) OVER w, '-inf'::DOUBLE), coalesce(lead(x, 2) OVER w, 'inf'::DOUBLE) - x),
             greatest(x - coalesce(lag(x, 2) OVER w, '-inf'::DOUBLE), coalesce(lead(x) OVER w, 'inf'::DOUBLE) - x),
             x - coalesce(lag(x, 3) OVER w, '-inf'::DOUBLE)) AS r
         FROM f WINDOW w AS (PARTITION BY position, y ORDER BY x)),
       sums AS (
         SELECT position, x, here, CAST(sum(here) OVER (PARTITION BY position ORDER BY x) AS BIGINT) AS upto
         FROM (SELECT position, x, count(*) AS here FROM f GROUP BY ALL)),
       psi AS (
         SELECT n, sum(CASE WHEN n = 1 THEN -0.5772156649015329::DOUBLE ELSE 1 / (n - 1)::DOUBLE END) OVER (ORDER BY n) AS v
         FROM (SELECT unnest(range(1, (SELECT count(*) + 1 FROM lineitem))) AS n)),
       inside AS (
         SELECT p.position, p.class_rows, CASE WHEN r > 0 THEN hi.upto - coalesce(lo.upto, 0) ELSE e.here END AS m
         FROM points p JOIN sums e ON e.position = p.position AND e.x = p.x
         ASOF LEFT JOIN sums hi ON p.position = hi.position AND p.x + p.r > hi.x
         ASOF LEFT JOIN sums lo ON p.position = lo.position AND p.x - p.r >= lo.x)
       SELECT i.position, ['price', 'quantity', 'charge'][i.position + 1] AS feature,
              round(greatest(0, (SELECT max(v) FROM psi) + (SELECT v FROM psi WHERE n = 3) - avg(c.v) - avg(m.v)), 6) AS score
       FROM inside i JOIN psi c ON c.n = i.class_rows JOIN psi m ON m.n = i.m GROUP BY i.position""",
)
def _neighbour_information(spark, sf):
    lines = driver_tables.table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_quantity") * 64 + F.col("l_linenumber")).alias("charge"),
    )
    return rounded(selection.neighbour_information(lines, MEASURED), "score")


@query(
    "scaling_moments",
    f"WITH p AS ({PREPARED}) "
    + _per_feature(
        "SELECT {i} AS position, '{f}' AS feature, round(avg({f}), 6) AS mean, "
        "round(CASE WHEN min({f}) = max({f}) THEN 1.0 ELSE stddev_pop({f}) END, 6) AS scale FROM p"
    ),
)
def _scaling_moments(spark, sf):
    return rounded(scaling.moments(_learning_rows(spark, sf), LEARN), "mean", "scale")


@query(
    "standardized_rows",
    f"""WITH p AS ({PREPARED}), m AS (
          SELECT avg(added_lines) AS am, stddev_pop(added_lines) AS sd, avg(nloc) AS nm, stddev_pop(nloc) AS ns FROM p)
        SELECT row_id, round((added_lines - am) / sd, 5) AS added_lines, round((nloc - nm) / ns, 5) AS nloc FROM p, m""",
)
def _standardized_rows(spark, sf):
    rows = _learning_rows(spark, sf)
    parameters = scaling.fitted(rows, ["added_lines", "nloc"])
    return rounded(
        scaling.standardize(rows, parameters).select("row_id", "added_lines", "nloc"), "added_lines", "nloc", digits=5
    )


@query(
    "class_ratio",
    f"""SELECT count(*) FILTER (WHERE y = 0) AS negatives, count(*) FILTER (WHERE y = 1) AS positives,
               round(count(*) FILTER (WHERE y = 0) / count(*) FILTER (WHERE y = 1), 6) AS ratio FROM ({PREPARED})""",
)
def _class_ratio(spark, sf):
    return rounded(evaluation.class_ratio(_learning_rows(spark, sf)), "ratio")


# --- evaluation and reports -------------------------------------------------------------------

PREDICTIONS = """
    SELECT 'order' || l_orderkey AS filename, 'item_' || l_linenumber AS function_name,
           l_partkey % 100 + 1 AS function_start_line, l_partkey % 100 + CAST(l_quantity AS BIGINT) AS function_end_line,
           CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, model_id, name,
           greatest(0.0, least(1.0, raw)) AS probability,
           CASE WHEN greatest(0.0, least(1.0, raw)) >= 0.5 THEN 'BUGGY' ELSE 'CLEAN' END AS label
    FROM (SELECT *, 'a_1' AS model_id, 'Quantity' AS name, l_quantity / 50 AS raw FROM lineitem
          UNION ALL SELECT *, 'b_1', 'Discount', l_discount * 10 FROM lineitem
          UNION ALL SELECT *, 'c_1', 'Price', l_extendedprice / 100000 FROM lineitem
          UNION ALL SELECT *, 'c_2', 'Price', l_extendedprice / 90000 FROM lineitem)"""

CONFUSION = f"""
    SELECT model_id, count(*) FILTER (WHERE y = 1 AND probability >= 0.5) AS tp,
           count(*) FILTER (WHERE y = 0 AND probability < 0.5) AS tn,
           count(*) FILTER (WHERE y = 0 AND probability >= 0.5) AS fp,
           count(*) FILTER (WHERE y = 1 AND probability < 0.5) AS fn
    FROM ({PREDICTIONS}) GROUP BY model_id"""

SCORES = f"""
    SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
           coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
           coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc
    FROM ({CONFUSION})"""


@query(
    "confusion_scores",
    f"""SELECT model_id, tp, tn, fp, fn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
               round(recall, 6) AS recall, round(f1, 6) AS f1, round(mcc, 6) AS mcc FROM ({SCORES})""",
)
def _confusion_scores(spark, sf):
    counts = evaluation.confusion(driver_tables.predictions(spark, sf), "model_id")
    return rounded(evaluation.with_scores(counts), "accuracy", "precision", "recall", "f1", "mcc")


@query(
    "roc_auc",
    f"""SELECT model_id, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM (
          SELECT model_id, pos, neg, coalesce(sum(neg) OVER (PARTITION BY model_id ORDER BY probability
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
            SELECT model_id, probability, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg
            FROM ({PREDICTIONS}) GROUP BY 1, 2)) GROUP BY model_id""",
)
def _roc_auc(spark, sf):
    return rounded(evaluation.roc_auc(driver_tables.predictions(spark, sf), "model_id"), "roc_auc")


@query(
    "roc_points",
    f"""SELECT model_id, threshold, round(fp / sum(neg) OVER (PARTITION BY model_id), 6) AS fpr,
               round(tp / sum(pos) OVER (PARTITION BY model_id), 6) AS tpr FROM (
          SELECT model_id, probability AS threshold, pos, neg,
                 sum(pos) OVER (PARTITION BY model_id ORDER BY probability DESC) AS tp,
                 sum(neg) OVER (PARTITION BY model_id ORDER BY probability DESC) AS fp FROM (
            SELECT model_id, probability, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg
            FROM ({PREDICTIONS}) GROUP BY 1, 2))""",
)
def _roc_points(spark, sf):
    return rounded(evaluation.roc_points(driver_tables.predictions(spark, sf), "model_id"), "fpr", "tpr")


@query(
    "confusion_share",
    f"""WITH c AS ({CONFUSION}), u AS (
          SELECT model_id, 'tn' AS cell, tn AS n, tp + tn + fp + fn AS t FROM c
          UNION ALL SELECT model_id, 'fp', fp, tp + tn + fp + fn FROM c
          UNION ALL SELECT model_id, 'fn', fn, tp + tn + fp + fn FROM c
          UNION ALL SELECT model_id, 'tp', tp, tp + tn + fp + fn FROM c)
        SELECT model_id, cell, n, round(n * 100.0 / t, 6) AS percent FROM u""",
)
def _confusion_share(spark, sf):
    counts = evaluation.confusion(driver_tables.predictions(spark, sf), "model_id")
    return rounded(evaluation.confusion_share(counts, "model_id"), "percent")


def _formula_metrics(spark, sf):
    """Metrics of the scoring formulas as if they were trained models, without the ranking by score."""
    measured = evaluation.with_scores(evaluation.confusion(driver_tables.predictions(spark, sf), "model_id"))
    measured = measured.withColumn("roc_auc", F.lit(None).cast("double"))
    return measured.withColumn("model_name", F.col("model_id")).withColumn("position", F.col("model_id"))


@query(
    "model_ranking",
    f"""SELECT model_id, round(f1, 6) AS f1, CAST(row_number() OVER (ORDER BY f1 DESC, model_id) AS INTEGER) AS rank,
               CASE WHEN f1 > 0.8 THEN 'excellent' WHEN f1 > 0.7 THEN 'very good' WHEN f1 > 0.6 THEN 'good' ELSE 'moderate' END AS verdict
        FROM ({SCORES})""",
)
def _model_ranking(spark, sf):
    ranked = evaluation.ranked_models(_formula_metrics(spark, sf))
    return ranked.select("model_id", F.round("f1", 6).alias("f1"), "rank", reporting.verdict("f1").alias("verdict"))


@query(
    "top_three_models",
    f"SELECT model_id FROM ({SCORES}) ORDER BY f1 DESC, model_id LIMIT 3",
)
def _top_three_models(spark, sf):
    return _formula_metrics(spark, sf).orderBy(F.desc("f1"), "model_id").limit(3).select("model_id")


@query(
    "training_summary",
    f"""SELECT arg_max(model_id, f1) AS best_model, round(max(f1), 6) AS best_f1,
               round(arg_max(accuracy, f1), 6) AS best_accuracy, count(*) AS total_models,
               string_agg(model_id, ',' ORDER BY f1 DESC, model_id) AS all_models FROM ({SCORES})""",
)
def _training_summary(spark, sf):
    metrics = _formula_metrics(spark, sf).withColumn("position", F.substring("model_id", 3, 1).cast("int"))
    names = F.array_join(F.transform("all_models", lambda m: m["name"]), ",")
    return reporting.summary(metrics).select(
        "best_model", F.round("best_f1", 6).alias("best_f1"), F.round("best_accuracy", 6).alias("best_accuracy"),
        "total_models", names.alias("all_models"),
    )


@query(
    "stored_confusion",
    f"SELECT concat_ws(',', tn, fp, fn, tp) AS confusion_matrix FROM ({CONFUSION}) WHERE model_id = 'a_1'",
)
def _stored_confusion(spark, sf):
    found = scoring.stored_confusion(_formula_metrics(spark, sf), "a_1")
    return found.select(F.array_join("confusion_matrix", ",").alias("confusion_matrix"))


FIRST = f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filename, function_name, name
                     ORDER BY model_id, function_start_line, function_end_line, probability) AS rn FROM ({PREDICTIONS})) WHERE rn = 1"""


def _first(spark, sf):
    return reporting.first_predictions(
        driver_tables.predictions(spark, sf).drop("y"),
        ["filename", "function_name", "name"],
        ["model_id", "function_start_line", "function_end_line", "probability"],
    )


@query(
    "first_predictions",
    f"SELECT filename, function_name, name, model_id, round(probability, 9) AS probability FROM ({FIRST})",
)
def _first_predictions(spark, sf):
    return rounded(_first(spark, sf), "probability", digits=9).select(
        "filename", "function_name", "name", "model_id", "probability"
    )


@query(
    "result_rows",
    f"""SELECT filename, function_name, function_start_line || '-' || CASE WHEN function_end_line = 0 THEN 'N/A' ELSE CAST(function_end_line AS VARCHAR) END AS function_lines,
               name AS model, round(probability, 9) AS probability, label,
               CASE WHEN probability >= 0.5 THEN 'red' WHEN probability >= 0.25 THEN 'yellow' ELSE 'green' END AS risk_band
        FROM ({FIRST}) WHERE label = 'BUGGY'""",
)
def _result_rows(spark, sf):
    shown = reporting.filter_results(reporting.result_rows(_first(spark, sf)), "buggy")
    shown = materialize(shown, "results")  # sorting reads its rows twice
    return rounded(reporting.sort_results(shown, "probability", ascending=False), "probability", digits=9)


@query(
    "predictions_by_function",
    f"""SELECT filename, function_name, min(function_start_line) FILTER (WHERE r = 1) AS function_start_line,
               string_agg(name || '=' || label, ',' ORDER BY name) AS predictions FROM (
          SELECT *, row_number() OVER (PARTITION BY filename, function_name ORDER BY model_id, function_start_line, function_end_line) AS r
          FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filename, function_name, name
                  ORDER BY model_id, function_start_line, function_end_line, y, label, probability) AS rn FROM ({PREDICTIONS})) WHERE rn = 1))
        GROUP BY 1, 2""",
)
def _predictions_by_function(spark, sf):
    # rows of one function and model that tie on everything else are told apart by label and score
    rows = driver_tables.predictions(spark, sf)
    grouped = reporting.by_function(
        rows, ["filename", "function_name"], ["function_start_line", "function_end_line", "y", "label", "probability"]
    ).drop("label")
    text = F.array_join(F.transform("predictions", lambda p: F.concat_ws("=", p["name"], p["label"])), ",")
    return grouped.select("filename", "function_name", "function_start_line", text.alias("predictions"))


@query(
    "prediction_counts",
    f"""SELECT count(*) AS prediction_count, count(DISTINCT filename || '/' || function_name) AS function_count FROM ({PREDICTIONS})""",
)
def _prediction_counts(spark, sf):
    return reporting.prediction_counts(driver_tables.predictions(spark, sf), ["filename", "function_name"])


@query(
    "ensemble_mean",
    f"""SELECT filename, function_name, round(avg(probability), 9) AS probability,
               CASE WHEN avg(probability) >= 0.5 THEN 'BUGGY' ELSE 'CLEAN' END AS label
        FROM ({FIRST}) GROUP BY 1, 2""",
)
def _ensemble_mean(spark, sf):
    mean = scoring.ensemble_mean(_first(spark, sf), ["filename", "function_name"], ["Quantity", "Discount", "Price"])
    return rounded(mean, "probability", digits=9)


@query(
    "model_options",
    f"SELECT min(model_id) AS id, name AS label FROM ({PREDICTIONS}) GROUP BY name",
)
def _model_options(spark, sf):
    return reporting.model_options(driver_tables.predictions(spark, sf), "model_id", "name")


@query(
    "model_keys",
    """SELECT p_partkey, CASE WHEN rn = 1 THEN base ELSE base || '_' || (rn - 1) END AS model_id, artifact FROM (
         SELECT p_partkey, base, artifact, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS rn FROM (
           SELECT p_partkey, regexp_replace(lower(name), '[^a-z0-9_]+', '_', 'g') AS base,
                  replace(replace(replace(replace(name, '(', ''), ')', ''), ' ', '_'), '-', '_') AS artifact FROM (
             SELECT p_partkey, p_name || ' (' || p_type || ')-' || p_brand AS name FROM part)))""",
)
def _model_keys(spark, sf):
    names = driver_tables.table(spark, sf, "part").select(
        "p_partkey", F.concat("p_name", F.lit(" ("), "p_type", F.lit(")-"), "p_brand").alias("name")
    )
    return model_store.with_model_keys(names, "name", "p_partkey").select(
        "p_partkey", "model_id", messages.artifact_name("name").alias("artifact")
    )


# --- neighbours and balancing -----------------------------------------------------------------


def _embeddings(spark, sf):
    """Embeddings as rows of 64 features; the class is whether the label is above 0."""
    vectors = driver_tables.table(spark, sf, "embeddings")
    return vectors.select(
        "vec_id",
        (F.col("label") % 3 == 0).cast("int").alias("y"),
        *[F.element_at("embedding", i + 1).cast("double").alias(f"e{i}") for i in range(64)],
    )


# Every pair once a query: the vectors are made once, and no list of all pairs is kept.
EMBEDDED = """
    SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN label % 3 = 0 THEN 1 ELSE 0 END AS y, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings"""


@query(
    "nearest_neighbours",
    f"""WITH e AS MATERIALIZED ({EMBEDDED}),
        n AS (SELECT a.id AS vec, min({{'d': array_distance(a.e, b.e), 'id': b.id}}, 5) AS near FROM e a JOIN e b ON a.id <> b.id GROUP BY a.id)
        SELECT vec, CAST(rank AS INTEGER) AS rank, near[rank].id AS neighbour, round(near[rank].d, 5) AS distance
        FROM n, range(1, 6) r(rank) WHERE rank <= len(near)""",
)
def _nearest_neighbours(spark, sf):
    names = [f"e{i}" for i in range(64)]
    vectors = neighbours.distinct_vectors(_embeddings(spark, sf), "vec_id", names)
    found = neighbours.nearest(vectors, 5)
    return found.select("vec", "rank", "neighbour", F.round(F.sqrt("squared_distance"), 5).alias("distance"))


@query(
    "tomek_links",
    f"""WITH e AS MATERIALIZED ({EMBEDDED}),
        n AS MATERIALIZED (
          SELECT a.id AS vec, any_value(a.y) AS y, min({{'d': array_distance(a.e, b.e), 'id': b.id}}).id AS neighbour
          FROM e a JOIN e b ON a.id <> b.id GROUP BY a.id)
        SELECT a.vec AS id, a.neighbour AS partner FROM n a JOIN n b ON a.neighbour = b.vec AND b.neighbour = a.vec
        WHERE a.y <> b.y AND a.vec < a.neighbour""",
)
def _tomek_links(spark, sf):
    return balance.tomek_links(_embeddings(spark, sf), "vec_id", [f"e{i}" for i in range(64)])


def _document_rows(spark, sf):
    """Documents as a labelled dataset: low quality is BUGGY, unlabelled ones are CLEAN.

    Texts are measured before labels are joined, so the join moves numbers only.
    """
    measured = driver_tables.table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"),
        (F.length("text") % 50).cast("double").alias("added_lines"),
        (F.length("text") % 7).cast("double").alias("deleted_lines"),
        code_text.nloc("text").cast("double").alias("nloc"),
        code_text.token_count("text").cast("double").alias("token_count"),
        messages.message_length("text").cast("double").alias("commit_msg_length"),
        messages.message_word_count("text").cast("double").alias("commit_msg_word_count"),
        messages.message_char_count("text").cast("double").alias("commit_msg_char_count"),
    )
    labels = driver_tables.table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), "quality")
    label = F.when(F.col("quality") == 0, "BUGGY").otherwise("CLEAN").alias("label")
    return measured.join(labels, "row_id", "left").select(*measured.columns, label)


@query("rebalanced_rows")
def _rebalanced_rows(spark, sf):
    rows, columns = datasets.prepare(_document_rows(spark, sf), keep=["row_id"])
    return balance.rebalance(rows, "row_id", columns)


# --- models -----------------------------------------------------------------------------------


def _trained(spark, sf):
    """All presets and the ensemble; the first query over a table trains them, the others load them."""
    rows, columns = datasets.prepare(_document_rows(spark, sf), keep=["row_id"])
    rows = materialize(rows, "learning")

    def train():
        split = materialize(sampling.stratified_split(rows, "y", "row_id"), "split")
        return training.train_and_measure(split.filter(~F.col("is_test")), split.filter("is_test"), columns)

    return model_store.trained_once(rows, "documents", train)


@query("trained_models")
def _trained_models(spark, sf):
    """All presets and the ensemble, measured on the test rows."""
    config = TrainingConfig(selection="selectkbest", max_fit_rows=20_000)
    return run_training(_document_rows(spark, sf), config).metrics.drop("training_time")


@query("best_feature_method")
def _best_feature_method(spark, sf):
    rows, columns = datasets.prepare(_document_rows(spark, sf), keep=["row_id"])
    method, chosen = selection.select_best_method(materialize(rows, "learning"), columns)
    return spark.createDataFrame([(method, c) for c in chosen], "method string, feature string")


@query("feature_importances")
def _feature_importances(spark, sf):
    rows, columns = datasets.prepare(_document_rows(spark, sf), keep=["row_id"])
    found = selection.forest_importances(sampling.bounded(rows, 20_000), columns)
    return reporting.top_importances(spark.createDataFrame(found, "feature string, importance double"))


@query("leakage_check")
def _leakage_check(spark, sf):
    rows, columns = datasets.prepare(_document_rows(spark, sf), keep=["row_id"])
    return evaluation.fold_summary(training.leakage_check(materialize(rows, "learning"), columns, "row_id"))


# Three models with fixed coefficients, so that storing, loading, scoring and averaging have exact SQL.
FIXED_MODELS = {
    "Linear A": "(added_lines + 0.5D) / 50.0D",
    "Linear B": "(deleted_lines + 0.5D) / 7.0D",
    "Linear C": "(added_lines + deleted_lines) / 55.0D",
}
FIXED_SCORES = """
    WITH d AS (SELECT doc_id, source, (length(text) % 50)::DOUBLE AS a, (length(text) % 7)::DOUBLE AS b FROM documents),
    p AS (SELECT doc_id, source, (a + 0.5) / 50 AS pa, (b + 0.5) / 7 AS pb, (a + b) / 55 AS pc FROM d),
    s AS (
      SELECT doc_id, source, 'linear_a' AS model_id, 'Linear A' AS name, pa AS probability FROM p
      UNION ALL SELECT doc_id, source, 'linear_b', 'Linear B', pb FROM p
      UNION ALL SELECT doc_id, source, 'linear_c', 'Linear C', pc FROM p
      UNION ALL SELECT doc_id, source, 'ensemble_top_3_', 'Ensemble (Top 3)', (pa + pb + pc) / 3 FROM p)
    SELECT doc_id AS row_id, source, model_id, name, round(probability, 9) AS probability,
           CASE WHEN round(probability, 12) >= 0.5 THEN 'BUGGY' ELSE 'CLEAN' END AS label FROM s"""


def _stored_fixed_models(spark, sf):
    """The fixed models and their ensemble, measured, saved and loaded again."""
    rows, columns = datasets.prepare(_document_rows(spark, sf), keep=["row_id"])
    models = [
        training.Trained(
            name,
            columns,
            PipelineModel(
                [
                    SQLTransformer(statement=f"SELECT *, round({formula}, 12) AS said FROM __THIS__"),
                    SQLTransformer(statement="SELECT *, 1.0D - said AS unsaid FROM __THIS__"),
                    VectorAssembler(inputCols=["unsaid", "said"], outputCol="probability"),
                ]
            ),
        )
        for name, formula in FIXED_MODELS.items()
    ]
    models = training.add_ensemble(rows, training.measure(rows, models))
    path = scratch(spark, "models")
    model_store.save_models(spark, models, path)
    sources = driver_tables.table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "source")
    return rows.join(sources, "row_id"), model_store.load_models(spark, path)


@query("fixed_model_scores", FIXED_SCORES)
def _fixed_model_scores(spark, sf):
    rows, models = _stored_fixed_models(spark, sf)
    return rounded(scoring.score(rows, models, keep=["row_id", "source"]), "probability", digits=9)


@query("chosen_model_scores", f"SELECT * FROM ({FIXED_SCORES}) WHERE model_id = 'ensemble_top_3_'")
def _chosen_model_scores(spark, sf):
    """Scores of one model, chosen by its key."""
    rows, models = _stored_fixed_models(spark, sf)
    return rounded(scoring.score(rows, models, "ensemble_top_3_", ["row_id", "source"]), "probability", digits=9)


@query(
    "scores_by_function",
    f"""SELECT source AS filename, 'doc_' || row_id AS function_name, row_id % 100 AS function_start_line,
               string_agg(name || '=' || label, ',' ORDER BY name) AS predictions
        FROM ({FIXED_SCORES}) GROUP BY source, row_id HAVING bool_or(label = 'BUGGY')""",
)
def _scores_by_function(spark, sf):
    """Functions that some stored model calls defective, with what every model says."""
    rows, models = _stored_fixed_models(spark, sf)
    named = rows.select(
        "*",
        F.col("source").alias("filename"),
        F.concat(F.lit("doc_"), "row_id").alias("function_name"),
        (F.col("row_id") % 100).alias("function_start_line"),
    )
    scores = scoring.score(named, models, keep=["filename", "function_name", "function_start_line"])
    found = reporting.by_function(scores, ["filename", "function_name"], ["function_start_line"])
    shown = found.filter(F.exists("predictions", lambda p: p["label"] == schema.BUGGY))
    text = F.array_join(F.transform("predictions", lambda p: F.concat_ws("=", p["name"], p["label"])), ",")
    return shown.select("filename", "function_name", "function_start_line", text.alias("predictions"))


@query(
    "stored_model_metrics",
    f"""SELECT model_name, tp::BIGINT AS tp, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn,
               round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy,
               round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
        FROM (SELECT name AS model_name, count_if(y AND label = 'BUGGY') AS tp, count_if(NOT y AND label = 'CLEAN') AS tn,
                     count_if(NOT y AND label = 'BUGGY') AS fp, count_if(y AND label = 'CLEAN') AS fn
              FROM (SELECT s.*, coalesce(l.quality = 0, false) AS y FROM ({FIXED_SCORES}) s LEFT JOIN labels l ON l.doc_id = s.row_id)
              GROUP BY name)""",
)
def _stored_model_metrics(spark, sf):
    """The comparison table of the stored models."""
    _, models = _stored_fixed_models(spark, sf)
    table = training.metrics_table(spark, models)
    return rounded(table.select("model_name", "tp", "tn", "fp", "fn", "accuracy", "f1"), "accuracy", "f1")


@query("saved_models")
def _saved_models(spark, sf):
    path = scratch(spark, "models")
    model_store.save_models(spark, _trained(spark, sf), path)
    return model_store.read_registry(spark, path).select("model_name", "rank", "features", "members", "model_id")


@query("scored_documents")
def _scored_documents(spark, sf):
    rows, _ = datasets.prepare(_document_rows(spark, sf), keep=["row_id"])
    return scoring.score(rows, _trained(spark, sf), keep=["row_id"])


@query("scored_functions")
def _scored_functions(spark, sf):
    return scoring_plan.score_changes(
        driver_tables.source_changes(spark, sf), _trained(spark, sf), training.ENSEMBLE, function_level=True
    )


@query("scored_files")
def _scored_files(spark, sf):
    return scoring_plan.score_changes(driver_tables.source_changes(spark, sf), _trained(spark, sf))


@query(
    "decoded_files",
    "SELECT 'page' || page_id || '.html' AS filename, md5(html) AS content_md5 FROM pages WHERE length(html) > 0",
)
def _decoded_files(spark, sf):
    """Pages as uploaded bytes, every second one in Latin-1 if it can be written so."""
    pages = driver_tables.table(spark, sf, "pages")
    latin = F.encode(F.regexp_replace("html", "[^\\x00-\\xff]", "?"), "ISO-8859-1")
    fits = ~F.col("html").rlike("[^\\x00-\\xff]") & (F.col("page_id") % 2 == 0)
    raw = pages.select(
        F.concat(F.lit("/up/page"), "page_id", F.lit(".html")).alias("path"),
        F.when(fits, latin).otherwise(F.encode("html", "UTF-8")).alias("content"),
    )
    return files.decode_files(raw).select("filename", F.md5(F.encode("content", "UTF-8")).alias("content_md5"))


FOREST = """
    SELECT o_orderkey AS k, CASE WHEN o_orderkey % 500 = 0 THEN NULL
             WHEN o_orderkey % 5 = 0 THEN o_orderkey - 1 - (o_orderkey // 5) % 4 ELSE o_orderkey - 1 END AS parent FROM orders"""


def _forest(spark, sf):
    """Orders as commits of a history with branches: every fifth starts from a commit some places back."""
    k = F.col("o_orderkey")
    back = F.when(k % 5 == 0, k - 1 - F.floor(k / 5) % 4).otherwise(k - 1)
    orders = driver_tables.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return orders.select(
        k.cast("string").alias("commit_hash"),
        F.when(k % 500 != 0, back.cast("string")).alias("parent_hash"),
        F.col("o_orderdate").cast("timestamp").alias("commit_ts"),
    )


@query(
    "versions_at_parents",
    f"""WITH RECURSIVE forest AS ({FOREST}),
        held AS (SELECT DISTINCT l_orderkey AS k, 'src/part' || (l_partkey % 50) || '.py' AS f FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
        back AS (
          SELECT h.k, h.f, p.parent AS at FROM held h JOIN forest p USING (k) JOIN forest q ON q.k = p.parent
          UNION ALL
          SELECT b.k, b.f, p.parent FROM back b JOIN forest p ON p.k = b.at JOIN forest q ON q.k = p.parent
          LEFT JOIN held v ON v.k = b.at AND v.f = b.f WHERE v.k IS NULL)
        SELECT b.k::VARCHAR AS commit_hash, b.f AS file_path, b.at::VARCHAR AS before_hash
        FROM back b JOIN held v ON v.k = b.at AND v.f = b.f""",
)
def _versions_at_parents(spark, sf):
    lines = driver_tables.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("commit_hash"),
        F.concat(F.lit("src/part"), F.col("l_partkey") % 50, F.lit(".py")).alias("file_path"),
    )
    commits = _forest(spark, sf)
    return history.versions_at_parents(lines, commits, lines)


# --- streams ----------------------------------------------------------------------------------


@query("stream_bug_fix_flags", ORACLE["bug_fix_flags"])
def _stream_bug_fix_flags(spark, sf):
    arriving = driver_tables.shape_events(jobs.read_table_stream(spark, sf, "events"))
    flagged = jobs.bug_fix_flags(arriving).select("commit_hash", "is_bug_fix", "matched_rule")
    return jobs.run_available(flagged, "flags")


DAILY = """
    SELECT date_trunc('day', ts) AS day, 'src/user' || user_id AS file_path, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS added,
           CAST(sum(event_id % 7) AS BIGINT) AS deleted, count(*) AS commits
    FROM events GROUP BY 1, 2"""


def _event_changes(events):
    return events.select(
        F.col("ts").cast("timestamp").alias("commit_ts"),
        F.concat(F.lit("src/user"), F.col("user_id")).alias("file_path"),
        F.floor("value").cast("long").alias("added"),
        (F.col("event_id") % 7).alias("deleted"),
    )


def _closed_stream(spark, sf, aggregate, name):
    """What ``aggregate`` makes of the events as a stream, the last days too: the given input has an end."""
    arriving = _event_changes(jobs.read_table_stream(spark, sf, "events"))
    return jobs.run_closed(arriving, aggregate, "commit_ts", name).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "stream_daily_changes",
    f"SELECT strftime(day, '%Y-%m-%d') AS day, file_path, added, deleted, commits FROM ({DAILY})",
)
def _stream_daily_changes(spark, sf):
    return _closed_stream(spark, sf, jobs.daily_changes, "daily")


@query(
    "stream_trailing_churn",
    f"""SELECT file_path, strftime(day, '%Y-%m-%d') AS day, CAST(sum(added + deleted) OVER w AS BIGINT) AS churn,
               CAST(sum(commits) OVER w AS BIGINT) AS commit_count, round(sum(commits) OVER w / 30.0, 6) AS commit_frequency
        FROM ({DAILY}) WINDOW w AS (PARTITION BY file_path ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)""",
)
def _stream_trailing_churn(spark, sf):
    return rounded(_closed_stream(spark, sf, jobs.trailing_churn, "trailing"), "commit_frequency")


@query("stream_scores")
def _stream_scores(spark, sf):
    """Arriving conversation turns scored with trained models."""
    turns = jobs.read_table_stream(spark, sf, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("file_path"),
        F.lit("").alias("before"),
        F.col("text").alias("after"),
        F.col("role").alias("message"),
    )
    return jobs.run_available(jobs.score_stream(turns, _trained(spark, sf)), "scores")
