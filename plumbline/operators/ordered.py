"""Ordered neighbours and running totals that survive one very large group.

A plain window over ``(group)`` puts a whole group into one task. Here each group is
cut into chunks of its order column; the window runs per chunk, and one small row per
chunk carries the state across the chunk borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 1 << 18


def order_chunk(order: Column, width: int = CHUNK_ROWS) -> Column:
    """Chunk number of a dense integer order column, such as line numbers; others take :func:`row_chunks`."""
    return F.floor(order / F.lit(width)).cast("long")


def _match(a: DataFrame, b: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    return a.join(b, on, how)


def with_previous(df: DataFrame, keys: list[str], order: str, chunk: str, carry: list[str], name: str) -> DataFrame:
    """Add ``name`` = struct of ``carry`` from the row before in its group.

    ``order`` must be unique within a group, and ``chunk`` must grow with it.
    """
    item = F.struct(*carry)
    within = Window.partitionBy(*keys, chunk).orderBy(order)
    across = Window.partitionBy(*keys).orderBy(chunk)
    tails = (
        df.groupBy(*keys, chunk)
        .agg(F.max_by(item, F.col(order)).alias("_tail"))
        .withColumn("_before", F.lag("_tail").over(across))
        .drop("_tail")
    )
    out = df.withColumn("_near", F.lag(item).over(within))
    out = _match(out, tails, [*keys, chunk])
    return out.withColumn(name, F.coalesce("_near", "_before")).drop("_near", "_before")


def with_next(df: DataFrame, keys: list[str], order: str, chunk: str, carry: list[str], name: str) -> DataFrame:
    """Add ``name`` = struct of ``carry`` from the row after in its group."""
    item = F.struct(*carry)
    within = Window.partitionBy(*keys, chunk).orderBy(order)
    across = Window.partitionBy(*keys).orderBy(chunk)
    heads = (
        df.groupBy(*keys, chunk)
        .agg(F.min_by(item, F.col(order)).alias("_head"))
        .withColumn("_after", F.lead("_head").over(across))
        .drop("_head")
    )
    out = df.withColumn("_near", F.lead(item).over(within))
    out = _match(out, heads, [*keys, chunk])
    return out.withColumn(name, F.coalesce("_near", "_after")).drop("_near", "_after")


def with_running_total(df: DataFrame, keys: list[str], order: str, chunk: str, amount: Column, name: str) -> DataFrame:
    """Add ``name`` = sum of ``amount`` from the start of the group up to and including the row."""
    within = Window.partitionBy(*keys, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    staged = df.withColumn("_amount", amount)
    totals = (
        staged.groupBy(*keys, chunk)
        .agg(F.sum("_amount").alias("_total"))
        .withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .drop("_total")
    )
    out = staged.withColumn("_local", F.sum("_amount").over(within))
    out = _match(out, totals, [*keys, chunk])
    return out.withColumn(name, F.col("_local") + F.col("_offset")).drop("_local", "_offset", "_amount")


def with_filled(df: DataFrame, keys: list[str], order: str, chunk: str, value: str, name: str, forward: bool = True) -> DataFrame:
    """Add ``name`` = nearest non-null ``value`` at or before the row (or at or after it)."""
    within = Window.partitionBy(*keys, chunk).orderBy(order)
    across = Window.partitionBy(*keys).orderBy(chunk)
    if forward:
        near = F.last(value, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))
        edge = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order)))
        carried = F.last("_edge", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    else:
        # read from the far end: a frame that ends at the last row is gone through anew for each row
        back = Window.partitionBy(*keys, chunk).orderBy(F.col(order).desc())
        near = F.last(value, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
        edge = F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order)))
        carried = F.first("_edge", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing))
    edges = df.groupBy(*keys, chunk).agg(edge.alias("_edge")).withColumn("_carried", carried).drop("_edge")
    out = _match(df.withColumn("_near", near), edges, [*keys, chunk])
    return out.withColumn(name, F.coalesce("_near", "_carried")).drop("_near", "_carried")


def islands(df: DataFrame, keys: list[str], order: str, chunk: str, value: str) -> DataFrame:
    """Runs of equal neighbouring values: one row per run with its length and bounds."""
    prev = with_previous(df.select(*keys, order, chunk, value), keys, order, chunk, [value], "_prev")
    starts = F.when(F.col("_prev").isNotNull() & (F.col(f"_prev.{value}").eqNullSafe(F.col(value))), 0).otherwise(1)
    numbered = with_running_total(prev, keys, order, chunk, starts, "run_no")
    return numbered.groupBy(*keys, "run_no").agg(
        F.count(F.lit(1)).alias("run_length"),
        F.min(order).alias("run_start"),
        F.max(order).alias("run_end"),
        F.min(value).alias("run_value"),
    )


def longest_island(df: DataFrame, keys: list[str], order: str, value: str, rows: int | None = None) -> DataFrame:
    """``keys``, ``max_run_length``: length of the longest run of equal neighbouring values of each group.

    A range partition is a chunk, of about ``CHUNK_ROWS`` rows at most where the number of
    ``rows`` is given. Runs are counted per chunk in one pass; only one row per chunk, with
    its longest, first and last run, meets those of the other chunks.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(rows or 0) // CHUNK_ROWS))
    ranged = df.select(*keys, order, value).repartitionByRange(parts, *keys, order).withColumn("_chunk", F.spark_partition_id())
    chunk = [*keys, "_chunk"]
    # as many tasks as chunks, so that what a task sorts does not grow with the rows
    ranged = ranged.repartition(parts, *chunk)
    within = Window.partitionBy(*chunk).orderBy(order)
    near = ranged.withColumns({"_prev": F.lag(F.struct(value)).over(within), "_row": F.row_number().over(within)})
    same = F.col("_prev").isNotNull() & F.col(f"_prev.{value}").eqNullSafe(F.col(value))
    began = F.max(F.when(~same, F.col("_row"))).over(within.rowsBetween(Window.unboundedPreceding, 0))
    sized = near.withColumn("_began", began).withColumn("_length", F.col("_row") - F.col("_began") + 1)
    chunks = sized.groupBy(*chunk).agg(
        F.max("_length").alias("_best"),
        F.min_by(value, order).alias("_first_v"),
        F.max(F.when(F.col("_began") == 1, F.col("_length"))).alias("_first_n"),
        F.max_by(value, order).alias("_last_v"),
        F.max_by("_length", order).alias("_last_n"),
        (F.max("_began") == 1).alias("_whole"),
    )
    # a run over a border: the last run of a chunk, chunks that are one run, the first run of the chunk after
    across = Window.partitionBy(*keys).orderBy("_chunk")
    chunks = chunks.withColumn("_tail", F.lag(F.struct("_last_v")).over(across))
    joins = F.col("_tail").isNotNull() & F.col("_tail._last_v").eqNullSafe(F.col("_first_v"))
    first = F.struct(F.lit(0).alias("at"), joins.alias("joins"), F.col("_first_n").alias("n"))
    last = F.struct(F.lit(1).alias("at"), F.lit(False).alias("joins"), F.col("_last_n").alias("n"))
    pieces = chunks.select(*keys, "_chunk", "_best", F.explode(F.when(F.col("_whole"), F.array(first)).otherwise(F.array(first, last))).alias("_p"))
    places = Window.partitionBy(*keys).orderBy("_chunk", "_p.at").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("_run", F.sum(F.when(F.col("_p.joins"), 0).otherwise(1)).over(places))
    joined = pieces.groupBy(*keys, "_run").agg(F.sum("_p.n").alias("_n"), F.max("_best").alias("_best"))
    return joined.groupBy(*keys).agg(F.max(F.greatest("_n", "_best")).cast("long").alias("max_run_length"))


def row_chunks(df: DataFrame, keys: list[str], order: list[str], name: str = "_chunk") -> DataFrame:
    """Add a chunk number that grows with ``order`` within a group; chunks hold about equally many rows.

    The bounds are sampled from the rows themselves (range partitioning), so neither
    sparse nor outlying values matter, and a group of any size spans several chunks.
    The rows are written to the shared folder once, which fixes their chunk.
    """
    from plumbline.session import materialize

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys, *order).withColumn(name, F.spark_partition_id())
    return materialize(ranged, "chunked")


def with_rank(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name`` = place of the row in its group, counted from 1.

    Rows are range-partitioned by group and order, so a large group spans several
    partitions. The result is written to the shared folder once, which fixes the
    partition of every row; places are then local places plus the rows before.
    """
    fixed = row_chunks(df, keys, order, "_part")
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        fixed.groupBy(*keys, "_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    local = fixed.withColumn("_local", F.row_number().over(within))
    return _match(local, offsets, [*keys, "_part"]).withColumn(name, F.col("_local") + F.col("_offset")).drop("_local", "_offset", "_part")
