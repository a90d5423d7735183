"""A Merkle manifest: aligned builders append nodes as they are completed, positions follow from sizes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from faultline.llm.common import join_groups, numbered
from faultline.session import materialize

ARITY = 3
REACH = 7  # levels one builder completes over its aligned leaves, of which it has 3^REACH
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]  # in the order they enter a leaf
PATH = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf_of(**changed: Column) -> Column:
    """Digest of a row; ``changed`` replaces fields by other values."""
    return F.sha2(F.concat(*(field(changed.get(name, F.col(name))) for name in FIELDS)), 256)


def _joined(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def height(leaves: int) -> int:
    """Levels above the leaves until one node is left."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // ARITY), levels + 1
    return levels


def postorder(leaves: list[str], top: int) -> list[str]:
    """All nodes up to level ``top`` in the order in which they are complete."""
    log, open_runs = [], [[] for _ in range(top + 1)]
    for i, node in enumerate(leaves):
        log.append(node)
        open_runs[0].append(node)
        for level in range(top):
            if len(open_runs[level]) < ARITY and i + 1 < len(leaves):
                break
            node = _joined(open_runs[level])
            open_runs[level] = []
            open_runs[level + 1].append(node)
            log.append(node)
    return log


def position(level: int, index: int, leaves: int, top: int) -> int:
    """Where the log holds a node.

    A node is written ``level`` places behind the last leaf below it; before leaf i come i leaves
    and, for each level k, the i // 3^k nodes whose subtrees ended earlier.
    """
    last = min((index + 1) * ARITY**level, leaves) - 1
    return last + sum(last // ARITY**k for k in range(1, top + 1)) + level


def siblings(log: list[str], leaves: int, top: int, above: list[dict]) -> list[list[dict]]:
    """For each leaf, level by level, the digests left and right of its node in the run; then ``above``."""
    paths = [above]
    for level in range(top - 1, -1, -1):
        count = -(-leaves // ARITY**level)
        nodes = [log[position(level, j, leaves, top)] for j in range(count)]
        below = []
        for j in range(count):
            start = j - j % ARITY
            step = {"left": "".join(nodes[start:j]), "right": "".join(nodes[j + 1 : start + ARITY])}
            below.append([step, *paths[j // ARITY]])
        paths = below
    return paths


def _top(leaves: int, reach: int) -> int:
    return min(height(leaves), reach)


def _segments(nodes: DataFrame, carried: list[str], reach: int) -> DataFrame:
    """One row a builder: the log over its up to 3^reach leaves, and what the leaves carry, in order.

    ``nodes`` has tree, index, leaves (in the tree), leaf and the carried columns.
    """
    placed = nodes.withColumn("block", F.expr(f"index div {ARITY**reach}"))
    held = F.array(F.struct(*(F.col(c) for c in carried))).alias("carried")
    schema = placed.select("tree", "block", "leaves", F.lit(b"").alias("log"), held).schema
    arrow = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("index").combine_chunks()
        total = table["leaves"][0].as_py()
        log = postorder(table["leaf"].to_pylist(), _top(total, reach))
        values = [table[c].combine_chunks() for c in carried]
        rows = pa.StructArray.from_arrays(values, fields=[pa.field(c, table.schema.field(c).type) for c in carried])
        columns = [
            table["tree"][:1], table["block"][:1], table["leaves"][:1],
            pa.array([bytes.fromhex("".join(log))], pa.binary()),
            pa.ListArray.from_arrays([0, len(table)], rows),
        ]
        return pa.table(columns, arrow.names).cast(arrow)

    return materialize(placed.groupBy("tree", "block").applyInArrow(run, schema), "manifest-log")


def _last_digest() -> Column:
    return F.lower(F.hex(F.substring("log", -32, 32)))


def _grown(nodes: DataFrame, carried: list[str], reach: int) -> list[DataFrame]:
    """Segments of all trees, round by round; the nodes of a round are the last ones of the round before."""
    rounds = [_segments(nodes, carried, reach)]
    while True:
        wide = rounds[-1].filter(F.col("leaves") > ARITY**reach)
        if wide.isEmpty():
            return rounds
        above = wide.select(
            "tree",
            F.col("block").alias("index"),
            F.expr(f"(leaves + {ARITY**reach - 1}) div {ARITY**reach}").alias("leaves"),
            _last_digest().alias("leaf"),
        )
        rounds.append(_segments(above, ["leaf"], reach))


def _roots(rounds: list[DataFrame], reach: int) -> DataFrame:
    """tree and the digest of its last remaining node."""
    found = None
    for segments in rounds:
        done = segments.filter(F.col("leaves") <= ARITY**reach).select("tree", _last_digest().alias("subroot"))
        found = done if found is None else found.unionByName(done)
    return found


def _extracted(segments: DataFrame, keep: list[str], reach: int) -> DataFrame:
    """One row a leaf: tree, index, the columns ``keep`` of its segment, leaf, path, and what it carries.

    ``segments`` has the column above: the path from the segment's last node to the root.
    """
    carried = segments.schema["carried"].dataType.elementType
    order = ["tree", "block", "leaves", "log", "carried", "above", *keep]
    rows = segments.select(*order)
    schema = rows.select(
        "tree", F.lit(0).cast("long").alias("index"), *keep, F.lit("").alias("leaf"), F.col("above").alias("path"),
        *(F.col("carried")[0][f.name].alias(f.name) for f in carried if f.name != "leaf"),
    ).schema
    extra = [f.name for f in carried if f.name != "leaf"]
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                tree, block, total, log, _, above = (batch.column(c)[k].as_py() for c in range(6))
                held = batch.column(4)[k].values
                digests = log.hex()
                nodes = [digests[a : a + 64] for a in range(0, len(digests), 64)]
                n, top = len(held), _top(total, reach)
                paths = siblings(nodes, n, top, above)
                start = block * ARITY**reach
                columns = [
                    pa.array([tree] * n, pa.string()),
                    pa.array(range(start, start + n), pa.int64()),
                    *(pa.repeat(batch.column(6 + c)[k], n) for c in range(len(keep))),
                    pa.array([nodes[position(0, j, n, top)] for j in range(n)], pa.string()),
                    pa.array(paths, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))),
                    *(held.field(name) for name in extra),
                ]
                yield pa.RecordBatch.from_arrays(columns, arrow.names).cast(arrow)

    return rows.mapInArrow(run, schema)


def _paths(rounds: list[DataFrame], keep: list[str], reach: int) -> DataFrame:
    """Rows of the first round's leaves with their whole paths; the rounds have ``above`` for a tree's last node."""
    upper = None
    for segments in reversed(rounds):
        if upper is not None:
            inner = upper.select("tree", F.col("index").alias("block"), F.col("path").alias("_inner"))
            segments = segments.join(inner, ["tree", "block"], "left")
            segments = segments.withColumn("above", F.coalesce("_inner", "above")).drop("_inner")
        upper = _extracted(segments, keep, reach)
    return upper


@dataclass
class Manifest:
    """Written logs of the trees of all sources and of the tree over their subroots; None is the root of no rows."""

    root: str | None
    sources: list[DataFrame]
    upper: list[DataFrame]
    sizes: DataFrame
    reach: int

    def proofs(self) -> DataFrame:
        """doc_id, source, index, leaf, subroot, path and the carried columns of every row.

        A path has a step a level up to the root: the digests left and right of the node in its run.
        """
        upper = [s.withColumn("above", F.array().cast(PATH)) for s in self.upper]
        subroots = _paths(upper, [], self.reach).select(
            F.col("of").alias("tree"), F.col("leaf").alias("subroot"), F.col("path").alias("above")
        )
        subroots = materialize(subroots.join(self.sizes, "tree"), "manifest-subroots")
        rounds = [join_groups(s, subroots, "tree", "rows_of_tree") for s in self.sources]
        source = F.when(F.col("tree") != "", F.expr("substring(tree, 2)")).alias("source")
        return _paths(rounds, ["subroot"], self.reach).select("*", source).drop("tree")


def build_manifest(docs: DataFrame, reach: int = REACH, **carried: Column) -> Manifest:
    """Manifest of every row of ``docs``; ``carried`` columns are computed where the row is read and come with its proof.

    Leaves of a source ascend by doc_id (null first), rows that repeat a doc_id by leaf. Null fields
    enter a leaf as ``-``, empty ones do not. A null source is a source of its own, before all
    others. An empty table has no root and no proofs. Only digests and the carried columns move;
    a source of any size is cut into aligned builders of 3^reach leaves. Columns besides FIELDS are
    not read, so their names do not matter.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    kept = {"doc_id": F.col("doc_id"), **carried}
    narrow = docs.select(
        tree.alias("tree"), leaf_of().alias("leaf"), *(c.alias(n) for n, c in kept.items()),
        F.monotonically_increasing_id().alias("_scan"),
    )
    narrow = materialize(narrow, "manifest-leaves")
    rows = numbered(narrow, ["tree", "doc_id", "leaf", "_scan"], "manifest-order")
    sizes = rows.groupBy("tree").agg(F.min("row_no").alias("_first"), F.count(F.lit(1)).alias("leaves"))
    sizes = materialize(sizes, "manifest-sources")
    placed = join_groups(rows, sizes, "tree", "leaves").withColumn("index", F.col("row_no") - F.col("_first"))
    sources = _grown(placed, list(kept), reach)

    subroots = materialize(_roots(sources, reach), "manifest-subroots")
    ordered = numbered(subroots, ["tree"], "manifest-subroots")
    top = ordered.select(
        F.lit("").alias("tree"), F.col("row_no").alias("index"), F.lit(subroots.count()).cast("long").alias("leaves"),
        F.col("subroot").alias("leaf"), F.col("tree").alias("of"),
    )
    upper = _grown(top, ["of"], reach)
    root = _roots(upper, reach).first()  # one row, or none
    sizes = sizes.select("tree", F.col("leaves").alias("rows_of_tree"))
    return Manifest(root and root["subroot"], sources, upper, sizes, reach)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of the siblings of all levels, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda step: F.concat(step["left"], step["right"]))), 256)
