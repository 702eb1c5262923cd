"""A Merkle manifest of a data set, built by appends with incremental witnesses.

The rows of each source are the leaves of a ternary tree, the roots of the sources those of
one more. A tree grows by appends: a node that joins an open run gives the run's earlier
nodes its digest as a further sibling and takes theirs, so each node carries the partial
witness of all leaves below it. A complete run closes and its digest is appended one level
up. Trees are dealt out in aligned blocks of ``3 ** HEIGHT`` leaves, each appended by one
task as a stream; the roots of the blocks are appends to the next round in turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.ordered import with_rank
from plumbline.session import materialize

#: Children of a node, and levels of a block: 6,561 leaves.
ARITY, HEIGHT = 3, 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Per level, the digests of the siblings on either side, joined.
WITNESS = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))


class Node:
    """A node, its siblings so far, and the node it went into."""

    __slots__ = ("digest", "left", "right", "parent")

    def __init__(self, digest: str) -> None:
        self.digest, self.left, self.right, self.parent = digest, "", "", None


class Appender:
    """A growing tree; holds the open run of each level."""

    def __init__(self) -> None:
        self.open: list[list[Node]] = [[]]

    def append(self, node: Node, level: int = 0) -> None:
        """Add a node; its run and every run that this completes are closed."""
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        node.left = "".join(n.digest for n in run)
        for other in run:
            other.right += node.digest
        run.append(node)
        if len(run) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        parent = Node(sha256("".join(n.digest for n in run).encode()).hexdigest())
        for n in run:
            n.parent = parent
        self.append(parent, level + 1)

    def finish(self) -> tuple[str, int]:
        """Close the short runs from below; the root and its level."""
        level = 0
        while level < len(self.open) - 1 or len(self.open[level]) > 1:
            if self.open[level]:
                self._close(level)
            level += 1
        return self.open[level][0].digest, level


def witness(node: Node) -> list[dict[str, str]]:
    """The siblings of a leaf and of the nodes above it, up to the root."""
    levels = []
    while node.parent is not None:
        levels.append({"left": node.left, "right": node.right})
        node = node.parent
    return levels


def _append_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and place, with the witness inside the block, its root and height."""
    levels = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def finished() -> pa.RecordBatch:
        root, height = tree.finish()
        block = pa.Table.from_batches(held).combine_chunks()
        n = block.num_rows
        block = block.append_column("witness", pa.array([witness(x) for x in nodes], levels))
        block = block.append_column("block_root", pa.array([root] * n))
        return block.append_column("height", pa.array([height] * n, pa.int32())).to_batches()

    tree, nodes, held, at = Appender(), [], [], None
    for batch in batches:
        keys = list(zip(batch.column("_key").to_pylist(), batch.column("_block").to_pylist()))
        digests = batch.column("_node").to_pylist()
        start = 0
        for i, key in enumerate(keys):
            if key != at:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield from finished()
                tree, nodes, held, at, start = Appender(), [], [], key, i
            nodes.append(Node(digests[i]))
            tree.append(nodes[-1])
        if len(keys) > start:
            held.append(batch.slice(start, len(keys) - start))
    if held:
        yield from finished()


def appended(rows: DataFrame, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """Build the tree of every ``_key`` over ``_node`` in the order of the dense ``_place`` (from 0).

    Returns the rows with their ``witness`` inside their ``_block``, and the blocks (_key,
    _block) with ``above``, the rest of the witness, and ``root``, that of the whole tree.
    """
    blocked = rows.withColumn("_block", F.floor(F.col("_place") / F.lit(ARITY**height)).cast("long"))
    schema = T.StructType(blocked.schema.fields).add("witness", WITNESS).add("block_root", "string").add("height", "integer")
    dealt = blocked.repartition("_key", "_block").sortWithinPartitions("_key", "_block", "_place")
    done = materialize(dealt.mapInArrow(_append_blocks, schema), "witnesses")
    blocks = done.groupBy("_key", "_block").agg(F.min("block_root").alias("_node"), F.min("height").alias("height"))
    blocks = materialize(blocks, "blocks")
    nothing = F.array().cast(WITNESS)
    if blocks.where(F.col("_block") > 0).isEmpty():
        return done, blocks.select("_key", "_block", nothing.alias("above"), F.col("_node").alias("root"))
    # the last block of several is lifted to the height of the others, as a run of one
    last = blocks.groupBy("_key").agg(F.max("_block").alias("_last"))
    lift = F.when(F.col("_last") == 0, 0).otherwise(height - F.col("height"))
    lifted = F.aggregate(F.array_repeat(F.lit(0), F.col("_lift")), F.col("_node"), lambda node, _: F.sha2(node, 256))
    nodes = blocks.join(last, "_key").withColumn("_lift", lift).select("_key", F.col("_block").alias("_place"), lifted.alias("_node"), "_lift")
    inner, outer = appended(nodes, height)
    alone = F.array_repeat(F.struct(F.lit("").alias("left"), F.lit("").alias("right")), F.col("_lift"))
    above = F.concat(alone.cast(WITNESS), "witness", "above")
    joined = inner.join(outer, ["_key", "_block"])
    return done, joined.select("_key", F.col("_place").alias("_block"), above.alias("above"), "root")


def leaf(text: Column) -> Column:
    """The digest of a row whose text is ``text``: every field with its byte count, ``-`` for null."""

    def field(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[field(text if name == "text" else F.col(name)) for name in FIELDS]), 256)


def folded(node: Column, levels: Column) -> Column:
    """The root that follows from a leaf and its witness."""
    return F.aggregate(levels, node, lambda at, level: F.sha2(F.concat(level["left"], at, level["right"]), 256))


def proof(levels: Column) -> Column:
    """The digest of all siblings of a witness, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(levels, lambda level: F.concat(level["left"], level["right"])), ""), 256)


def manifest(docs: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs`` (the columns ``FIELDS``; others are ignored): doc_id, leaf, levels, subroot, root.

    ``levels`` is the whole witness, via the root of the source to the root of all. ``carry``
    names more columns to work out from the row. Leaves of a source ascend by doc_id, a null
    id first; rows with one id by their leaf. A null source is a source of its own, before
    the others. Any field may be null. No rows give no rows, a single row is its own root.
    Texts take part as digests only; a hot source is dealt out like any other rows.
    """
    more = carry or {}
    key = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit(""))
    rows = docs.select(*FIELDS).select(key.alias("_key"), "doc_id", leaf(F.col("text")).alias("_node"), *[c.alias(n) for n, c in more.items()])
    placed = with_rank(rows, ["_key"], ["doc_id", "_node", *more], "_rank")
    done, blocks = appended(placed.withColumn("_place", F.col("_rank") - 1).drop("_rank"))
    blocks = materialize(blocks, "sources")
    tops = blocks.where(F.col("_block") == 0).select(F.col("_key").alias("_source"), F.col("root").alias("_node"))
    tops = with_rank(tops, [], ["_source"], "_rank").select(F.lit("").alias("_key"), "_source", "_node", (F.col("_rank") - 1).alias("_place"))
    inner, outer = appended(tops)
    upper = inner.join(outer, ["_key", "_block"]).select(F.col("_source").alias("_key"), F.concat("witness", "above").alias("_upper"), F.col("root").alias("_root"))
    blocks = blocks.join(upper, "_key").select("_key", "_block", F.concat("above", "_upper").alias("_above"), "root", "_root")
    return done.join(blocks, ["_key", "_block"]).select(
        "doc_id", F.col("_node").alias("leaf"), F.concat("witness", "_above").alias("levels"), F.col("root").alias("subroot"), F.col("_root").alias("root"), *more
    )


def verify_tampered(docs: DataFrame) -> DataFrame:
    """Check every row against the manifest after line breaks are deleted from the texts of even id checksums.

    A row without an id is not tampered with; a null text stays null.
    """
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    shown = leaf(F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text")))
    out = manifest(docs, {"_shown": shown}).withColumn("folded_root", folded(F.col("_shown"), F.col("levels")))
    return out.select("doc_id", "leaf", "subroot", "root", proof(F.col("levels")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
