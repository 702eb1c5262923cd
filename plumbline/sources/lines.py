"""Line-numbered text without a single-task pass over a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import materialize


#: Rows of a table of blocks or files, of some hundred bytes each, that is sent to all tasks.
FEW = 50_000


def met_in_order(lines: DataFrame, few: DataFrame, on: list[str], order: str) -> DataFrame:
    """``lines`` joined with the written rows of blocks or files; each block stays in one task and in its order.

    A broadcast leaves the lines as they are read. Only where there are too many rows for
    one, the lines are shuffled by block and sorted again.
    """
    if few.limit(FEW + 1).count() <= FEW:
        return lines.join(F.broadcast(few), on)
    return lines.join(few, on).repartition("path", "block").sortWithinPartitions("path", "block", order)


def numbered_lines(
    spark: SparkSession,
    paths: str | list[str],
    keep_blank: bool = True,
    only: str | None = None,
    separator: str | None = None,
    glob: str | None = None,
    keep_block: bool = False,
) -> DataFrame:
    """``path, line_number, line`` for text files that may be split over many tasks.

    Lines count up within a task, so the number of a line is its place within its
    file block plus the lines of the blocks before. Only one small row per block is
    grouped, ordered and written. Without ``keep_blank`` blank lines, and with ``only`` lines
    not matching that pattern, are left out before counting. Lines that are not valid
    UTF-8 turn their whole file to Latin-1, marked in ``latin1``. With ``keep_block`` the
    start of the file block is a column too, and the lines of a block stay in their order.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if separator:
        reader = reader.option("lineSep", separator)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(paths).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")
    )
    if not keep_blank:
        lines = lines.where(F.trim(F.regexp_replace("value", r"\s", "")) != "")
    if only:
        lines = lines.where(F.col("value").rlike(only))
    lines = lines.withColumn("_id", F.monotonically_increasing_id())
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    blocks = (
        lines.groupBy("path", "block")
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"), F.min(F.is_valid_utf8("value")).alias("_utf8"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("latin1", ~F.min("_utf8").over(whole))
        .select("path", "block", "_first", "_offset", "latin1")
    )
    text = F.when(F.col("latin1"), F.decode(F.col("value").cast("binary"), "ISO-8859-1")).otherwise(F.col("value"))
    # Spark then knows how few they are, and shuffles no text to meet them
    known, on = materialize(blocks, "line-blocks"), ["path", "block"]
    number = F.col("_id") - F.col("_first") + F.col("_offset") + 1
    placed = met_in_order(lines, known, on, "_id") if keep_block else lines.join(known, on)
    return placed.select(
        "path", number.alias("line_number"), text.alias("line"), "latin1", *(["block"] if keep_block else [])
    )


def file_name(path="path"):
    """Last part of a file path, with escapes such as %20 resolved."""
    return F.url_decode(F.regexp_replace(F.substring_index(path, "/", -1), r"\+", "%2B"))
