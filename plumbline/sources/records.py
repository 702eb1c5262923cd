"""Records that span lines or pieces of a split file.

Whether a line starts inside a quoted cell, or a piece of JSON inside a string and how
deep, depends on all that stands before it in its file. Each line or piece is first turned
into what it does to that state; the states then follow from running totals per block of
lines, of which one small row each is carried on. No task reads a whole file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.ordered import order_chunk, with_running_total
from plumbline.session import materialize
from plumbline.sources.lines import met_in_order, numbered_lines

_KEYS, _ORDER, _CHUNK = ["path"], "line_number", "_chunk"


def _open_cell(delimiter: str) -> re.Pattern:
    """Texts that, read from the start of a cell, end within a quoted cell."""
    other = f"[^{delimiter}]*+"
    closed = f'"(?:[^"]++|"")*+"{other}'
    bare = f'[^"{delimiter}]{other}'
    return re.compile(f'(?:(?:{closed}|{bare}|){delimiter})*+"(?:[^"]++|"")*+')


_OPEN = {False: _open_cell(","), True: _open_cell("\t")}


@F.pandas_udf(T.BooleanType())
def _ends_quoted(line: pd.Series, tab: pd.Series) -> pd.Series:
    return pd.Series([_OPEN[bool(t)].fullmatch(v) is not None for v, t in zip(line, tab)], dtype=bool)


_BLANKS = " \t\n\x0b\f\r"
_FACTS = [("open", "boolean"), ("first", "long"), ("closed", "long"), ("counted", "long"), ("rest", "long")]
_BLOCKS = ", ".join(["path string", "block long", "_end long", *[f"_{s}_{name} {kind}" for s in ("out", "in") for name, kind in _FACTS]])
_RECORDS = "path string, line_number long, line string, latin1 boolean"
_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _ARROW[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """(is the first line of its block, row) of the lines of a task, which hold their blocks one after another."""
    before = None
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            yield row[:2] != before, row
            before = row[:2]


def _open_after(line: str, number: int, tab: bool, inside: bool) -> bool:
    """Whether a file is inside a quoted cell after a line."""
    if '"' not in line:
        return inside
    text = '"' + line if inside else line[1:] if number == 1 and line.startswith("\ufeff") else line
    return _OPEN[tab].fullmatch(text) is not None


def _block_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block does to a file that comes to it outside (``_out``) or inside (``_in``) a quoted cell.

    ``open``: the state after the block; ``first`` and ``closed``: the first and the last line
    after which no cell is open, 0 without any; ``counted``: records that end up to ``closed``;
    ``rest``: lines after it that are not blank.
    """
    done, now = [], None
    for starts, (path, block, number, line, tab) in _in_order(batches):
        if starts:
            now = {"path": path, "block": block, "out": [False, 0, 0, 0, 0], "in": [True, 0, 0, 0, 0]}
            done.append(now)
        now["end"] = number
        counts = 1 if line.strip(_BLANKS) else 0
        for state in (now["out"], now["in"]):
            state[0] = _open_after(line, number, tab, state[0])
            if state[0]:
                state[4] += counts
            else:
                state[1:] = [state[1] or number, number, state[3] + counts, 0]
    rows = [(r["path"], r["block"], r["end"], *r["out"], *r["in"]) for r in done]
    yield _batch(rows, _BLOCKS)


def _block_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of blocks that each start outside a quoted cell; lines after ``_closed`` are records of their own."""
    inside, record, pieces, rows, held = False, 0, [], [], 0
    for starts, (path, block, number, line, tab, latin1, before, closed) in _in_order(batches):
        if starts:
            inside, record, pieces = False, before, []
        inside = _open_after(line, number, tab, inside)
        if inside and number <= closed:
            pieces.append(line)
        elif pieces or line.strip(_BLANKS):
            record += 1
            rows.append((path, record, "\n".join([*pieces, line]), latin1))
            held += len(rows[-1][2])
            pieces = []
        if len(rows) >= 10_000 or held >= 1 << 24:
            yield _batch(rows, _RECORDS)
            rows, held = [], 0
    yield _batch(rows, _RECORDS)


def _located_blocks(lines: DataFrame) -> DataFrame:
    """Each block of the files: the state it starts in, its bounds, and the records before it (``_before``).

    ``_first``, ``_last``: the first and last line of the block after which no cell is open;
    ``_counted``: the records that end up to the latter; ``_closed``: the last such line of the file.
    """
    numbered = lines.select("path", "block", _ORDER, "line", "_tab")
    blocks = materialize(numbered.mapInArrow(_block_states, _BLOCKS), "quote-blocks")
    ordered = Window.partitionBy("path").orderBy("block")
    so_far, earlier, whole = ordered.rowsBetween(Window.unboundedPreceding, 0), ordered.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("path")
    # a block keeps the state, swaps it or sets it; the state is that of the last block that
    # sets it, swapped as often as blocks after it swap
    odd = F.sum(F.when(F.col("_out_open") & ~F.col("_in_open"), 1).otherwise(0)).over(so_far) % 2 == 1
    states = blocks.withColumn("_odd", odd).withColumn("_set", F.when(F.col("_out_open") == F.col("_in_open"), F.col("_out_open") != F.col("_odd")))
    states = states.withColumn("_open", F.coalesce(F.last("_set", ignorenulls=True).over(so_far), F.lit(False)) != F.col("_odd"))
    states = states.withColumn("_inside", F.lag("_open", 1, False).over(ordered))

    def own(name):
        return F.when(F.col("_inside"), F.col(f"_in_{name}")).otherwise(F.col(f"_out_{name}"))

    states = states.select("path", "block", "_inside", "_end", own("first").alias("_first"), own("closed").alias("_last"), own("counted").alias("_counted"), own("rest").alias("_rest"))
    states = states.withColumns({"_closed": F.max("_last").over(whole), "_file_end": F.max("_end").over(whole)})
    records = F.col("_counted") + F.when(F.col("_closed") <= F.col("_end"), F.col("_rest")).otherwise(0)
    return states.withColumn("_before", F.coalesce(F.sum(records).over(earlier), F.lit(0))).drop("_rest", "_end")


def delimited_records(
    spark: SparkSession, paths: str | list[str], glob: str, tab: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, first, unclosed): ``path, line_number, line, latin1`` as :func:`numbered_lines` gives them, the first record of each file, and files with a stray quote.

    A quoted cell may span lines, blank ones too; its line breaks become one newline each.
    ``line_number`` counts the records that are not blank. Where the last quoted cell of a
    file is never closed, each of its lines is a record of its own and the file is listed in
    ``unclosed``, so that a stray quote does not swallow the rest of a file. Files in which
    no line opens such a cell are read as plain lines.

    Lines are read in their order, block by block: once for what each block does to the
    state, which then follows for all blocks from one small row each, and once for the
    records. Only the lines of records that cross blocks are shuffled, and no text is written.
    """
    every = numbered_lines(spark, paths, glob=glob, keep_block=True).withColumn("_tab", tab)
    clean = F.when(F.col(_ORDER) == 1, F.regexp_replace("line", "^﻿", "")).otherwise(F.col("line"))
    spanning = every.where(F.col("line").contains('"')).where(_ends_quoted(clean, F.col("_tab"))).select("path").distinct()
    plain = numbered_lines(spark, paths, keep_blank=False, glob=glob)
    spanning = materialize(spanning, "spanning-files")
    if spanning.isEmpty():
        return plain, plain.where(F.col(_ORDER) == 1), spanning
    states = materialize(_located_blocks(met_in_order(every, spanning, ["path"], _ORDER)), "quote-states")

    def records(blocks):
        placed = met_in_order(every, blocks, ["path", "block"], _ORDER)
        # a block may start with the end of a record and end with the start of one
        head = F.col("_inside") & (F.col("_first") > 0)
        tail = (F.col(_ORDER) > F.col("_last")) & (F.col(_ORDER) <= F.col("_closed"))
        crossing = F.when(head & (F.col(_ORDER) <= F.col("_first")), F.col("_before") + 1).when(tail, F.col("_before") + F.col("_counted") + 1)
        inner = placed.where(crossing.isNull()).select(
            "path", "block", _ORDER, "line", "_tab", "latin1", (F.col("_before") + head.cast("long")).alias("_before"), "_closed"
        )
        pieces = placed.select("path", crossing.alias("_record"), _ORDER, "line", "latin1").where(F.col("_record").isNotNull())
        pieces = pieces.groupBy("path", "_record").agg(F.sort_array(F.collect_list(F.struct(_ORDER, "line"))).alias("_lines"), F.max("latin1").alias("latin1"))
        joined = pieces.select("path", F.col("_record").alias(_ORDER), F.array_join(F.col("_lines.line"), "\n").alias("line"), "latin1")
        return inner.mapInArrow(_block_records, _RECORDS).unionByName(joined)

    others = plain.join(spanning, "path", "left_anti")
    # the first record lies in the blocks before any record has ended, or crosses into them
    first = others.unionByName(records(states.where("_before = 0"))).where(F.col(_ORDER) == 1)
    unclosed = states.where(F.col("_closed") < F.col("_file_end")).select("path").distinct()
    return others.unionByName(records(states)), first, unclosed


def _nesting(parts: Column, parity: int) -> Column:
    """Brackets opened less those closed, in every second part of a text that was split at its quotes."""
    text = F.array_join(F.filter(parts, lambda _, i: i % 2 == parity), "")
    return F.length(F.regexp_replace(text, r"[^\[{]", "")) - F.length(F.regexp_replace(text, r"[^\]}]", ""))


def json_objects(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, pos, text`` of the objects of JSON arrays, one array or one object per file.

    Files are read in pieces that end at a closing brace, so one array may span many splits.
    Strings hold what they like, braces and quotes too. ``pos`` counts from 0. An array
    that breaks off still gives the objects before the break; what is no valid object is
    passed over.
    """
    pieces = numbered_lines(spark, paths, separator="}").withColumn(_CHUNK, order_chunk(F.col(_ORDER)))
    parts = F.split(F.regexp_replace("line", r"(?s)\\.", ""), '"')
    tagged = pieces.select(
        "path", _ORDER, _CHUNK, "line",
        (F.size(parts) - 1).alias("_quotes"), _nesting(parts, 0).alias("_from_outside"), _nesting(parts, 1).alias("_from_string"),
    )
    staged = materialize(tagged, "json-pieces")
    # an array holds its objects at depth 1, a single object stands at depth 0
    base = staged.where(F.col(_ORDER) == 1).select("path", F.when(F.col("line").rlike("^[﻿\\s]*\\["), 1).otherwise(0).alias("_base"))
    quotes = with_running_total(staged, _KEYS, _ORDER, _CHUNK, F.col("_quotes"), "_total")
    starts_in_string = (F.col("_total") - F.col("_quotes")) % 2 == 1
    opened = F.when(starts_in_string, F.col("_from_string")).otherwise(F.col("_from_outside"))
    steps = quotes.withColumn("_brace", F.when(F.col("_total") % 2 == 0, 1).otherwise(0)).withColumn("_step", opened - F.col("_brace"))
    depths = with_running_total(steps, _KEYS, _ORDER, _CHUNK, F.col("_step"), "_depth").join(base, "path")
    ends = F.when((F.col("_brace") == 1) & (F.col("_depth") == F.col("_base")), 1).otherwise(0)
    ended = materialize(depths.select("path", _ORDER, _CHUNK, "line", ends.alias("_ends")), "json-ends")
    counted = with_running_total(ended, _KEYS, _ORDER, _CHUNK, F.col("_ends"), "_total")
    return (
        counted.groupBy("path", (F.col("_total") - F.col("_ends")).alias("pos"))
        .agg(F.sort_array(F.collect_list(F.struct(_ORDER, "line"))).alias("_pieces"), F.max("_ends").alias("_whole"))
        .where(F.col("_whole") == 1)
        .select("path", "pos", F.concat(F.array_join(F.col("_pieces.line"), "}"), F.lit("}")).alias("text"))
        .withColumn("text", F.regexp_replace("text", r"^[^{]*", ""))
        .where(F.json_object_keys("text").isNotNull())
    )
