"""A Merkle manifest of a dataset, in higher-order SQL.

Leaves are ordered in each tree and cut into blocks of a fixed size. A block is one row with an array of its nodes, and
`aggregate` over `sequence` collapses it level by level with `transform` and `slice`; block roots are the nodes of the
next round. On the way back each block hands its siblings down, so a document learns its proof from its block alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.runtime import Workspace

#: A block has 2**BLOCK_LEVELS nodes.
BLOCK_LEVELS = 8

#: All levels of a block's nodes, the nodes first, the level of `times` foldings last.
_LEVELS = """aggregate(filter(sequence(0, times), i -> i > 0), array(items.node), (a, i) -> concat(a, array(
    transform(sequence(0, cast((size(element_at(a, -1)) + 1) div 2 AS int) - 1), j -> sha2(array_join(slice(element_at(a, -1), 2 * j + 1, 2), ''), 256)))))"""
#: For each node of a block the sibling at each level, null where it has none, and whether it stands on the left. The levels are the
#: one element of an array, so that they are worked out once a block: an expression under a column's name would be put in for each node.
_PATHS = f"""element_at(transform(array({_LEVELS}), levels -> transform(items, (x, i) -> named_struct('item', x, 'path', transform(filter(sequence(0, times), l -> l < times),
    l -> named_struct('left', (shiftright(i, l) & 1) = 1, 'node', get(levels[l], shiftright(i, l) ^ 1)))))), 1)"""
_PATH = "array<struct<left: boolean, node: string>>"


def field(value: Column) -> Column:
    """A value with its length in bytes, or a dash: no two rows are written alike."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda a, s: F.sha2(F.when(s["node"].isNull(), a).when(s["left"], F.concat(s["node"], a)).otherwise(F.concat(a, s["node"])), 256))


def proof_digest(path: Column) -> Column:
    """A digest of all siblings on the way to the root."""
    return F.sha2(F.array_join(path["node"], ""), 256)


def _numbered(nodes: DataFrame, order: list[str], workspace: Workspace, name: str) -> DataFrame:
    """nodes (tree, node, ...) with `at`, the place within the tree from 0, and `total`, its number of nodes.

    Ranges of (tree, order) are dealt out, so that a tree with most of the rows lies in many of them; the counts of the ranges
    give the place of each one's first row.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = nodes.withColumn("tie", F.monotonically_increasing_id())
    dealt = workspace.table(tie.repartitionByRange(parts, "tree", *order, "tie").withColumn("part", F.spark_partition_id()), name)
    sizes = dealt.groupBy("tree", "part").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("tree", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("tree")).alias("total"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order, "tie")))
    return ranked.join(sizes, ["tree", "part"]).withColumn("at", F.col("before") + F.col("rank") - 1).drop("tie", "part", "before", "rank")


def _blocks(nodes: DataFrame, levels: int, *carry: str) -> DataFrame:
    """(tree, block, times, total, items): the nodes of each block in order. times: by how many levels it collapses, total: how
    many nodes its tree has then."""
    height = F.when(F.col("total") > 1, F.length(F.bin(F.col("total") - 1))).otherwise(0)
    rows = nodes.withColumns({"block": F.shiftright("at", levels), "times": F.least(F.lit(levels), height)})
    rows = rows.withColumn("total", F.expr("shiftright(total + shiftleft(1L, times) - 1, times)"))
    return rows.groupBy("tree", "block", "times", "total").agg(F.sort_array(F.collect_list(F.struct("at", "node", *carry))).alias("items"))


def _grow(nodes: DataFrame, levels: int, workspace: Workspace, name: str, *carry: str) -> tuple[list[DataFrame], DataFrame]:
    """(the blocks of all rounds, the root of each tree) of numbered nodes."""
    now, rounds = _blocks(nodes, levels, *carry), []
    while True:
        made = workspace.table(now, f"{name}-{len(rounds)}")
        rounds.append(made)
        up = made.select("tree", F.col("block").alias("at"), "total", F.expr(f"element_at({_LEVELS}, -1)[0]").alias("node"))
        if (made.agg(F.max("total")).first()[0] or 1) == 1:
            return rounds, up.select("tree", F.col("node").alias("root"))
        now = _blocks(up, levels)


def _descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The items of the first round's blocks with `path` to the top; above: (tree, path, and what else all nodes of a tree get)."""
    more = [c for c in above.columns if c not in ("tree", "path")]
    own = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        own = own.withColumnRenamed("path", "over")
        met = blocks.withColumn("paths", F.expr(_PATHS)).select("tree", "block", "paths").join(own, ["tree", "block"])
        each = met.select("tree", *more, "over", F.explode("paths").alias("x"))
        own = each.select("tree", F.col("x.item").alias("item"), *more, F.concat("x.path", "over").alias("path"), F.col("x.item.at").alias("block"))
    return own


def manifest(docs: DataFrame, *, columns: list[str] | None = None, id_col: str = "doc_id", tree_col: str = "lang", carry: dict[str, Column] | None = None, levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot of its tree, root of all, path (left, node) of its siblings up to the root, and
    carry, further columns over docs.

    A leaf is a digest of the columns, nulls marked. Each value of tree_col has a tree, null too, of leaves by id (null first) and, for
    rows with one id, by leaf; two nodes in a row make one, a last one alone makes one by itself. The trees' roots, by the bytes
    of their value and null first, are the leaves of the last tree. An empty table has no rows.
    """
    if not 1 <= levels <= 16:
        raise ValueError("a block has from 2 to 65536 nodes")
    columns = columns or ["doc_id", "source", "lang", "n_chars", "text"]
    workspace = Workspace(docs.sparkSession, "merkle")
    own, extra = F.col(f"`{tree_col}`").cast("string"), carry or {}
    leaves = docs.select(
        F.when(own.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), own)).alias("tree"),
        F.col(f"`{id_col}`").cast("long").alias("id"),
        leaf(*(F.col(f"`{c}`") for c in columns)).alias("node"),
        F.struct(F.lit(0).alias("none"), *(c.alias(name) for name, c in extra.items())).alias("rest"),
    )
    leaves = workspace.table(leaves, "leaves")
    rounds, roots = _grow(_numbered(leaves, ["id", "node"], workspace, "dealt"), levels, workspace, "blocks", "id", "rest")
    roots = workspace.table(roots, "roots")
    # The last tree: its nodes are the roots of the others.
    last = _numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("node")), ["of"], workspace, "dealt-roots")
    high, top = _grow(last, levels, workspace, "high", "of")
    over = _descend(high, top.withColumn("path", F.array().cast(_PATH)))
    over = workspace.table(over.select(F.col("item.of").alias("tree"), F.col("item.node").alias("subroot"), "root", "path"), "over")
    done = _descend(rounds, over)
    return done.select(F.col("item.id").alias("doc_id"), F.col("item.node").alias("leaf"), "subroot", "root", "path", *(F.col("item.rest")[name].alias(name) for name in extra))
