"""Adapters: the generic test tables seen as change history, issues, source files and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators.spread import ROWS_PER_BUCKET, previous_row
from faultline.sources.history import order_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows that wide ones are made of, dealt out by ``key``.

    A file with one row group is one task; what is made of its rows (texts, parsing, many rows each)
    would all run there. Dealing out the narrow columns is one cheap shuffle at any size. The number
    of parts is given, as adaptive execution joins parts by their narrow size. Rows that already
    hold whole texts are not dealt out: large tables of them have many splits.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def order_hash(column: str):
    return F.sha1(F.col(column).cast("string").cast("binary"))


def order_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_orders(table(spark, sf_dir, "orders"))


def shape_orders(orders: DataFrame) -> DataFrame:
    """Orders as commits; fixes are the orders in state F."""
    action = (
        F.when(F.col("o_orderstatus") == "F", "Fix order ")
        .when(F.col("o_orderstatus") == "O", "Add order ")
        .otherwise("Change order ")
    )
    suffix = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit(" refs PART-"), F.col("o_custkey"))).otherwise("")
    subject = F.concat(action, F.col("o_orderkey"), suffix)
    return orders.select(
        "o_orderkey",
        order_hash("o_orderkey").alias("commit_hash"),
        F.concat(F.lit("dev"), F.col("o_custkey")).alias("author"),
        F.col("o_orderdate").cast("timestamp").alias("commit_ts"),
        subject.alias("subject"),
        F.concat(subject, F.lit("\n\nPriority "), F.col("o_orderpriority")).alias("message"),
    )


def with_parents(commits: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The parent of a commit is the author's commit before it."""
    keyed = commits.withColumn("_order", order_key(F.col("commit_ts"), F.col("commit_hash")))
    return (
        previous_row(keyed, ["author"], "_order", ["commit_hash"], ["commit_hash"], "_p", rows_per_bucket)
        .withColumn("parent_hash", F.col("_p.commit_hash"))
        .drop("_p", "_order")
    )


def file_changes(spark: SparkSession, sf_dir: str, marks: DataFrame | None = None) -> DataFrame:
    """Line items as changed files of their order, with the ``marks`` of an order if given (unique o_orderkey)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount")
    lines = spread(lines, "l_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if marks is not None:
        orders = orders.join(marks, "o_orderkey", "left")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        order_hash("l_orderkey").alias("commit_hash"),
        F.concat(F.lit("src/part"), F.col("l_partkey"), F.lit(".py")).alias("file_path"),
        F.col("l_linenumber").alias("pos"),
        F.lit("M").alias("change_type"),
        F.col("l_quantity").cast("long").alias("added"),
        F.floor(F.col("l_quantity") * F.col("l_discount")).cast("long").alias("deleted"),
        F.concat(F.lit("dev"), F.col("o_custkey")).alias("author"),
        F.col("o_orderdate").cast("timestamp").alias("commit_ts"),
        *([] if marks is None else [c for c in marks.columns if c != "o_orderkey"]),
    )


def event_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    return shape_events(spread(events, "event_id"))


def shape_events(events: DataFrame) -> DataFrame:
    """Events as message-rich commits; every eighth message carries one kind of reference."""
    kind = F.col("event_id") % 8
    suffix = (
        F.when(kind == 0, F.concat(F.lit(" refs #"), F.col("event_id")))
        .when(kind == 1, F.concat(F.lit(" see proj-"), F.col("event_id") % 97))
        .when(kind == 2, F.concat(F.lit(" perf "), F.col("user_id")))
        .when(kind == 3, F.lit(" improve cache"))
        .when(kind == 4, F.concat(F.lit(" PART-"), F.col("event_id") % 2000, F.lit(" PART-"), F.col("user_id")))
        .otherwise("")
    )
    message = F.concat("event_type", F.lit(" "), "props", suffix)
    return events.select(
        F.sha1(F.col("event_id").cast("string").cast("binary")).alias("commit_hash"),
        F.concat(F.lit("user"), F.col("user_id")).alias("author"),
        F.col("ts").cast("timestamp").alias("commit_ts"),
        message.alias("subject"),
        message.alias("message"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written the way a log export writes commits; some lines are damaged."""
    commits = order_commits(spark, sf_dir)
    date = F.date_format("commit_ts", "yyyy-MM-dd HH:mm:ss")
    broken = F.when(F.col("o_orderkey") % 11 == 0, F.lit("not a date")).otherwise(
        F.concat(date, F.when(F.col("o_orderkey") % 2 == 0, " +0200").otherwise(" +0000"))
    )
    line = F.concat_ws("|", "commit_hash", "author", broken, F.concat("subject", F.lit(" a|b")))
    return commits.select(
        F.when(F.col("o_orderkey") % 13 == 0, F.concat_ws("|", "commit_hash", "author"))
        .otherwise(line)
        .alias("value")
    )


def part_issues_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as exported issues."""
    key = F.col("p_partkey")
    status = F.element_at(
        F.array(*[F.lit(s) for s in ("Open", "Resolved", "Closed", "Done")]),
        (F.col("p_size") % 4 + 1).cast("int"),
    )
    name = lambda c: F.struct(c.alias("name"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("PART-"), key).alias("key"),
        F.struct(
            name(F.when(F.col("p_type") == "SMALL", "Bug").otherwise(F.col("p_type"))).alias("issuetype"),
            F.concat("p_name", F.when(key % 10 == 0, " slow").otherwise("")).alias("summary"),
            F.lit(None).cast("string").alias("description"),
            name(F.when(F.col("p_size") % 7 != 0, status)).alias("status"),
            name(F.lit(None).cast("string")).alias("priority"),
            F.array(F.lower("p_brand")).alias("labels"),
            F.array(name(F.col("p_brand"))).alias("components"),
            F.lpad(key.cast("string"), 10, "0").alias("created"),
            F.lit(None).cast("string").alias("updated"),
            F.lit(None).cast("string").alias("resolutiondate"),
        ).alias("fields"),
    )


def document_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one source as successive versions of one file."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text")


def line_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one source as versions of one file that holds the document's different lines in order."""
    lines = F.array_sort(F.array_remove(F.array_distinct(F.split("text", "\n")), ""))
    return table(spark, sf_dir, "documents").select(
        F.coalesce("source", F.lit("")).alias("file_path"), "doc_id", F.array_join(lines, "\n").alias("content")
    )


def customer_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as versions of one file of 8 to 12 assignments, some of which change with each order."""
    orders = order_commits(spark, sf_dir).select("o_orderkey", "commit_hash", "author", "commit_ts")
    lines = "transform(sequence(1, cast(8 + o_orderkey % 5 as int)), s -> concat('x', s, ' = ', (o_orderkey div s) % 3))"
    return spread(orders, "o_orderkey").select(
        F.concat(F.lit("src/"), "author", F.lit(".py")).alias("file_path"),
        "commit_hash",
        "commit_ts",
        F.expr(f"array_join({lines}, '\n')").alias("content"),
    )


def conversation_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the one before it ('' before the first), written as a unified diff."""
    turns = table(spark, sf_dir, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    prefixed = lambda c, mark: F.concat(F.lit(mark), F.replace(c, F.lit("\n"), F.lit("\n" + mark)))
    old, new = F.col("turn") * 10 + 1, F.col("turn") * 20 + 3
    diff = F.concat(
        F.lit("--- a/file\n+++ b/file\n@@ -"), old, F.lit(",5 +"), new, F.lit(",6 @@ part\n same\n"),
        prefixed(F.col("before"), "-"), F.lit("\n"), prefixed(F.col("text"), "+"),
        F.lit("\n same\n@@ -"), old + 500, F.lit(" +"), new + 700, F.lit(" @@\n-last\n+last"),
    )
    pairs = turns.join(before, ["conv_id", "turn"], "left").na.fill("", ["before"])
    return pairs.select("conv_id", "turn", "before", "text", diff.alias("diff"))


def blame_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as blame output: long, abbreviated and boundary hashes, and lines without one."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.concat(
            F.when(i % 4 == 0, F.sha1(line.cast("binary")))
            .when(i % 4 == 1, F.substring(F.sha1(line.cast("binary")), 1, 8))
            .when(i % 4 == 2, F.concat(F.lit("^"), F.substring(F.sha1(line.cast("binary")), 1, 7)))
            .otherwise(F.lit("no hash")),
            F.lit(" (dev 2024-01-01) "),
            line,
        ),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("blame"))


def _python_function(k, j) -> str:
    """SQL for function ``j`` of order ``k``: loops nested (k+j)%4 deep, (k*j)%3 branches, maybe a lock."""
    return (
        f"concat('    def step_', {j}, '(self, n):\\n', "
        f"array_join(transform(sequence(1, 4), d -> if(d <= ({k} + {j}) % 4, "
        f"concat(repeat('    ', d + 1), 'for i', d, ' in range(n):\\n'), '')), ''), "
        f"repeat('    ', cast(2 + ({k} + {j}) % 4 as int)), 'x = n\\n', "
        f"repeat('        if n:\\n            x = 1\\n', cast(({k} * {j}) % 3 as int)), "
        f"if({j} % 2 = 0, '        with lock:\\n            x = 2\\n', ''))"
    )


def _java_function(k, j) -> str:
    return (
        f"concat('    public int step_', {j}, '(int n, String s) {{\\n', "
        f"array_join(transform(sequence(1, 4), d -> if(d <= ({k} + {j}) % 4, "
        f"concat(repeat('    ', d + 1), 'for (int i = 0; i < n; i++) {{\\n'), '')), ''), "
        f"'        x = n;\\n', repeat('        }}\\n', cast(({k} + {j}) % 4 as int)), "
        f"if({j} % 2 = 0, '        synchronized (this) {{ x = 2; }}\\n', ''), '    }}\\n')"
    )


def _script_function(k, j) -> str:
    return (
        f"concat('function step_', {j}, '(n) {{\\n', "
        f"repeat('  while (n) {{ x(); }}\\n', cast(({k} + {j}) % 4 as int)), '}}\\n')"
    )


def _source_text(count: str, revision: str) -> str:
    k = "o_orderkey"

    def body(function):
        return f"array_join(transform(sequence(1, cast({count} as int)), j -> {function(k, 'j')}), '')"

    return (
        f"case o_orderkey % 3 "
        f"when 0 then concat('# rev ', {revision}, '\\nclass Order', {k}, ':\\n', {body(_python_function)}) "
        f"when 1 then concat('// rev ', {revision}, '\\npublic class Order', {k}, ' {{\\n', {body(_java_function)}, '}}\\n') "
        f"else concat('// rev ', {revision}, '\\n', {body(_script_function)}) end"
    ).replace("{{", "{").replace("}}", "}")


def source_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One changed source file per order: Python, Java or JavaScript by key, with before and after.

    The change appends the last function and rewrites the first line; orders divisible by 7 add
    the file (empty before).
    """
    count = "(1 + o_orderkey % 4)"
    extension = "element_at(array('.py', '.java', '.js'), cast(o_orderkey % 3 + 1 as int))"
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]
    commits = shape_orders(spread(table(spark, sf_dir, "orders").select(*columns), "o_orderkey"))
    return commits.select(
        "o_orderkey",
        "commit_hash",
        "author",
        "commit_ts",
        "message",
        F.expr(f"concat('src/order', o_orderkey, {extension})").alias("file_path"),
        F.expr(
            f"case when o_orderkey % 7 = 0 then '' "
            f"when o_orderkey % 4 = 0 then {_source_text('1', '1')} "
            f"else {_source_text(count + ' - 1', '1')} end"
        ).alias("before"),
        F.expr(_source_text(count, "2")).alias("after"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fixed scoring formulas over the line items, stored the way predictions are stored.

    Line items of one order play the functions of one file; a returned item is a true defect. They are dealt out by
    the file's name before they become several predictions each, so what is grouped by function needs no other shuffle.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"
    )
    files = lines.withColumn("filename", F.concat(F.lit("order"), F.col("l_orderkey"))).drop("l_orderkey")
    base = spread(files, "filename").select(
        "filename",
        F.concat(F.lit("item_"), F.col("l_linenumber")).alias("function_name"),
        (F.col("l_partkey") % 100 + 1).alias("function_start_line"),
        (F.col("l_partkey") % 100 + F.col("l_quantity").cast("long")).alias("function_end_line"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.explode(
            F.array(
                F.struct(F.lit("a_1").alias("model_id"), F.lit("Quantity").alias("name"), (F.col("l_quantity") / 50).alias("raw")),
                F.struct(F.lit("b_1").alias("model_id"), F.lit("Discount").alias("name"), (F.col("l_discount") * 10).alias("raw")),
                F.struct(F.lit("c_1").alias("model_id"), F.lit("Price").alias("name"), (F.col("l_extendedprice") / 100000).alias("raw")),
                F.struct(F.lit("c_2").alias("model_id"), F.lit("Price").alias("name"), (F.col("l_extendedprice") / 90000).alias("raw")),
            )
        ).alias("m"),
    )
    probability = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("m.raw")))
    return base.select(
        "filename",
        "function_name",
        "function_start_line",
        "function_end_line",
        "y",
        "m.model_id",
        "m.name",
        probability.alias("probability"),
        F.when(probability >= 0.5, "BUGGY").otherwise("CLEAN").alias("label"),
    )
