"""Chat formatting: link quoted passages to the messages they come from and order replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import LEAST_ID, SEPARATORS, join_groups, let, numbered, text_of
from faultline.llm.components import roots
from faultline.session import materialize

MARKS = r"^(?:[ \t]*>)+"
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>")
_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), _SPACE, " "))


def passage_hash(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _filled(text: Column) -> Column:
    """The normalised lines of a text that are not blank."""
    return F.filter(F.transform(F.split(text, "\n", -1), normalised), lambda line: line != "")


def _lines(text: Column) -> Column:
    """Each line's quote depth and its words without the marks."""
    def parse(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 0)
        depth = F.length(marks) - F.length(F.translate(marks, ">", ""))
        return F.struct(depth.alias("depth"), F.substring(line, F.length(marks) + 1, F.length(line)).alias("words"))

    return F.transform(F.split(text, "\n", -1), lambda line: let(line, parse))


def _runs(lines: Column) -> Column:
    """Passages: consecutive lines of one depth, joined."""
    def starts(k: Column) -> Column:
        return (k == 0) | (F.get(lines, k)["depth"] != F.get(lines, k - 1)["depth"])

    def cut(places: Column) -> Column:
        def run(start: Column, k: Column) -> Column:
            stop = F.coalesce(F.get(places, k + 1), F.size(lines))
            words = F.transform(F.slice(lines, start + 1, stop - start), lambda x: x["words"])
            return F.struct(F.get(lines, start)["depth"].alias("depth"), F.array_join(words, "\n").alias("text"))

        return F.transform(places, run)

    return let(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), starts), cut)


def parsed(messages: DataFrame) -> DataFrame:
    """Own text, quoted passages and the hashes under which each message can be quoted; a written table.

    A message can be quoted whole, by a passage between its own quotations, or by one line; a quotation
    also keeps its number of lines and the hash of the first, to be looked up among several lines.
    """
    blank = lambda t: F.length(F.translate(t, SEPARATORS, "")) == 0

    def quote(q: Column) -> Column:
        def described(filled: Column) -> Column:
            return F.struct(
                q["depth"].alias("depth"),
                passage_hash(q["text"]).alias("hash"),
                F.size(filled).alias("n_lines"),
                F.xxhash64(F.get(filled, F.lit(0))).alias("first"),
            )

        return let(_filled(q["text"]), described)

    def parts(lines: Column) -> Column:
        own = F.filter(lines, lambda x: x["depth"] == 0)
        body = F.array_join(F.transform(own, lambda x: x["words"]), "\n")

        def found(runs: Column) -> Column:
            quotes = F.filter(runs, lambda r: (r["depth"] > 0) & ~blank(r["text"]))
            own_runs = F.transform(F.filter(runs, lambda r: r["depth"] == 0), lambda r: r["text"])
            units = F.concat(F.array(body), own_runs, F.transform(own, lambda x: x["words"]))
            return F.struct(
                F.regexp_replace(body, rf"^{_SPACE}|{_SPACE}$", "").alias("body"),
                F.transform(quotes, quote).alias("quotes"),
                F.array_distinct(F.transform(F.filter(units, lambda u: ~blank(u)), passage_hash)).alias("units"),
            )

        return let(_runs(lines), found)

    rows = messages.select(
        "conv_id",
        "turn",
        "role",
        F.coalesce(F.col("conv_id").cast("long"), F.lit(LEAST_ID)).alias("_conv"),
        let(_lines(text_of()), parts).alias("_parts"),
        F.monotonically_increasing_id().alias("_scan"),
    )
    return materialize(rows.select("conv_id", "turn", "role", "_conv", "_parts.*", "_scan"), "messages")


def line_origins(rows: DataFrame, sought: DataFrame) -> DataFrame:
    """The first message with the lines of a passage one after another, by ``_conv`` and ``hash``.

    Blank lines do not count. The lines of a message are hashed together only where one is the first of
    a passage in ``sought`` (_conv, first, n_lines), and only as many as such a passage has, so common
    lines meet one row for each conversation, not one another.
    """
    lengths = sought.groupBy("_conv", "first").agg(F.collect_set("n_lines").alias("lengths"))
    dated = rows.filter("turn IS NOT NULL")
    places = dated.select("_conv", "row_no", F.posexplode(F.transform(_filled(F.col("body")), lambda line: F.xxhash64(line))).alias("at", "first"))
    starts = places.join(lengths, ["_conv", "first"]).groupBy("row_no").agg(F.collect_list(F.struct("at", "lengths")).alias("starts"))

    def windows(filled: Column) -> Column:
        def of(start: Column) -> Column:
            fits = F.filter(start["lengths"], lambda n: start["at"] + n <= F.size(filled))
            return F.transform(fits, lambda n: passage_hash(F.array_join(F.slice(filled, start["at"] + 1, n), " ")))

        return F.array_distinct(F.flatten(F.transform("starts", of)))

    found = dated.join(materialize(starts, "line-starts"), "row_no")
    hashes = found.select("_conv", "row_no", "turn", F.explode(let(_filled(F.col("body")), windows)).alias("hash"))
    origins = hashes.groupBy("_conv", "hash").agg(F.min("row_no").alias("line_origin"), F.min("turn").alias("line_turn"))
    return materialize(origins, "line-origins")


def link_quotes(messages: DataFrame, trimmed: bool = False) -> DataFrame:
    """One row a message: its own text, the turn it replies to and its place among the replies.

    A quoted passage is linked to the first message of the conversation that has it, as a whole, as
    a passage or as a line, if that is from an earlier turn; with ``trimmed`` else to the first earlier one
    that has its lines one after another, blank ones aside. A message replies to the latest message
    linked from its quotations of depth 1. ``position`` orders a conversation by threads: a message
    that replies to none opens a thread, threads follow their first message, and within a thread the
    turns keep their order, so that every reply comes after what it answers. ``parent_turn`` is -1 for a
    message that replies to none, ``chat`` is the own text in the chat template.

    A null text is empty, a null role counts as ``user``, rows without conv_id are one conversation,
    a null turn comes before all others and is never linked. Rows with the same conversation and
    turn all stay, in any order among them. Other columns are not read; no messages give no rows.

    Only hashes are joined, with one row for each passage of a conversation; a long conversation is
    ordered by range, never in one window.
    """
    rows = materialize(numbered(parsed(messages), ["_conv", "turn", "_scan"], "messages-order"), "messages-numbered")
    units = rows.select("_conv", F.explode("units").alias("hash"), "row_no", "turn").filter("turn IS NOT NULL")
    origins = units.groupBy("_conv", "hash").agg(F.min("row_no").alias("origin"), F.min("turn").alias("origin_turn"))
    origins = materialize(origins, "passages")
    quotes = rows.select("_conv", F.explode("quotes").alias("q"), "row_no", "turn").select("_conv", "q.*", "row_no", "turn")
    earlier = F.coalesce(F.col("origin_turn") < F.col("turn"), F.lit(False))
    quotes = materialize(quotes.join(origins, ["_conv", "hash"], "left"), "quotations")
    left = ~earlier & (F.col("n_lines") > 1)
    if trimmed and not quotes.filter(left).isEmpty():
        by_line = quotes.join(line_origins(rows, quotes.filter(left)), ["_conv", "hash"], "left")
        quotes = by_line.withColumns({
            "origin": F.when(left, F.col("line_origin")).otherwise(F.col("origin")),
            "origin_turn": F.when(left, F.col("line_turn")).otherwise(F.col("origin_turn")),
        })
    linked = quotes.groupBy("row_no").agg(
        F.count(F.lit(1)).alias("n_quotes"),
        F.count_if(earlier).alias("n_linked"),
        F.max(F.when(earlier & (F.col("depth") == 1), F.col("origin"))).alias("parent"),
        F.max(F.when(earlier & (F.col("depth") == 1), F.col("origin_turn"))).alias("parent_turn"),
    )
    linked = materialize(linked, "links")
    tops = roots(linked.filter("parent IS NOT NULL").select(F.col("row_no").alias("node"), "parent"))
    threaded = (
        rows.drop("quotes", "units")
        .join(linked, "row_no", "left")
        .join(tops.withColumnRenamed("node", "row_no"), "row_no", "left")
        .withColumn("_thread", F.coalesce("root", "row_no"))
    )
    ordered = numbered(materialize(threaded, "threads"), ["_conv", "_thread", "row_no"], "threads-order", "_place")
    ordered = materialize(ordered, "threads-numbered")
    firsts = materialize(ordered.groupBy("_conv").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n")), "conversations")
    before, middle, after = (F.lit(part) for part in TEMPLATE)
    return join_groups(ordered, firsts, "_conv", "_n").select(
        "conv_id",
        "turn",
        "role",
        (F.col("_place") - F.col("_first")).alias("position"),
        F.coalesce("parent_turn", F.lit(-1)).cast("long").alias("parent_turn"),
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "body",
        F.concat(before, F.coalesce("role", F.lit("user")), middle, "body", after).alias("chat"),
    )


def quoting(messages: DataFrame) -> DataFrame:
    """The messages as mail programs send them: above its text, each quotes the two turns before it."""
    texts = messages.groupBy("conv_id", "turn").agg(F.min(text_of()).alias("_quoted"))

    def quoted(back: int) -> DataFrame:
        lines = F.regexp_replace("_quoted", "(?m)^", "> " * back)
        return texts.select("conv_id", (F.col("turn") + back).alias("turn"), lines.alias(f"_quote{back}"))

    both = messages.join(quoted(1), ["conv_id", "turn"], "left").join(quoted(2), ["conv_id", "turn"], "left")
    return both.withColumn("text", F.concat_ws("\n", "_quote2", "_quote1", text_of())).drop("_quote1", "_quote2")
