"""Delimited and Markdown table files as cells."""

from __future__ import annotations

import csv
import sys

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.schemas import CELLS
from plumbline.session import materialize
from plumbline.sources.lines import file_name, numbered_lines
from plumbline.sources.records import delimited_records


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split_record(line: pd.Series, tab: pd.Series) -> pd.Series:
    """Cells of one record, quoted as in spreadsheets; a cell may have any length."""
    csv.field_size_limit(sys.maxsize)
    return pd.Series(
        [[c.strip() for c in next(csv.reader([t], delimiter="\t" if is_tab else ","), [])] for t, is_tab in zip(line, tab)]
    )


def split_delimited(line: Column, tab: Column) -> Column:
    """Cells of a record; only records with a quote leave the JVM."""
    plain = F.transform(F.split(line, F.when(tab, "\t").otherwise(",")), lambda c: F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))
    return F.when(line.contains('"'), _split_record(line, tab)).otherwise(plain)


def _as_cells(rows: DataFrame, headers: DataFrame, package: str) -> DataFrame:
    """``rows`` has path, row_index, cells; ``headers`` has path, header. Extra cells are dropped."""
    return (
        rows.join(headers, "path")
        .select("path", "row_index", "header", F.posexplode("cells").alias("col_index", "value"))
        .where(F.col("col_index") < F.size("header"))
        .select(
            F.lit(package).alias("package_id"),
            F.regexp_replace(file_name(), r"\.[^.]*$", "").alias("table_id"),
            file_name().alias("source_file"),
            F.lit(None).cast("string").alias("sheet_name"),
            F.col("row_index").cast("long").alias("row_index"),
            F.col("col_index").cast("int").alias("col_index"),
            F.get("header", F.col("col_index")).alias("column_name"),
            F.col("value"),
        )
        .select(*CELLS.names)
    )


def read_delimited_cells(spark: SparkSession, paths: str | list[str], package_id: str = "") -> tuple[DataFrame, DataFrame]:
    """(cells, warnings) of CSV and TSV files.

    The first non-blank record is the header; a header cell belongs to its column by
    place. A quoted cell may hold line breaks. Large files are read in splits, so one file
    may be far larger than a task.
    """
    tab = F.lower("path").endswith(".tsv")
    lines, first, unclosed = delimited_records(spark, paths, "*.{csv,tsv,CSV,TSV}", tab)
    headers = first.select("path", split_delimited(F.regexp_replace("line", "^﻿", ""), tab).alias("header"), "latin1")
    # one row per file that is read three times; Spark then knows its size and the rows are not shuffled to meet it
    headers = materialize(headers, "headers")
    rows = lines.where(F.col("line_number") > 1).select(
        "path", (F.col("line_number") - 1).alias("row_index"), split_delimited(F.col("line"), tab).alias("cells")
    )
    cells = _as_cells(rows, headers.select("path", "header"), package_id)
    warnings = headers.where("latin1").select(
        file_name().alias("source_file"), F.lit("not valid UTF-8; read as Latin-1").alias("message")
    )
    stray = unclosed.select(file_name().alias("source_file"), F.lit("a quoted cell is never closed; its lines are read one by one").alias("message"))
    return cells, warnings.unionByName(stray).unionByName(_empty_files(spark, paths, headers))


def _empty_files(spark: SparkSession, paths, headers: DataFrame) -> DataFrame:
    """Files that hold no non-blank line."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{csv,tsv,CSV,TSV}")
        .load(paths)
        .select("path")
    )
    tail = F.substring_index("path", "/", -1)
    found = headers.select(tail.alias("_tail")).distinct()
    return (
        files.withColumn("_tail", tail)
        .join(found, "_tail", "left_anti")
        .select(file_name().alias("source_file"), F.lit("empty file").alias("message"))
    )


def read_markdown_cells(spark: SparkSession, paths: str | list[str], package_id: str = "") -> tuple[DataFrame, DataFrame]:
    """(cells, warnings) of the pipe table in each Markdown file.

    Short rows are padded, long ones cut to the header, both with a warning. A file
    needs at least three pipe lines and a separator as the second.
    """
    lines = numbered_lines(spark, paths, only=r"^\s*\|.*\|\s*$", glob="*.md")
    inner = F.regexp_replace(F.regexp_replace("line", r"^\s*\|", ""), r"\|\s*$", "")
    split = F.transform(F.split(inner, r"\|"), lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""))
    rows = lines.select("path", "line_number", "line", split.alias("cells"))
    separator = F.forall("cells", lambda c: F.replace(c, F.lit(" "), F.lit("")).rlike("^[-:]*$"))
    files = rows.groupBy("path").agg(
        F.max(F.when(F.col("line_number") == 1, F.col("cells"))).alias("header"),
        F.max(F.when(F.col("line_number") == 2, separator)).alias("_sep"),
        F.count(F.lit(1)).alias("_n"),
    )
    usable = files.where((F.col("_n") >= 3) & F.col("_sep"))
    bad = files.where(~((F.col("_n") >= 3) & F.col("_sep"))).select(
        file_name().alias("source_file"),
        F.when(F.col("_n") < 3, "no pipe table of at least three lines").otherwise("second row is not a separator").alias("message"),
    )
    width = F.size("header")
    body = rows.where(F.col("line_number") > 2).join(usable.select("path", "header"), "path")
    padded = F.concat(F.slice("cells", 1, width), F.array_repeat(F.lit(""), F.greatest(width - F.size("cells"), F.lit(0))))
    ragged = body.where(F.size("cells") != width).select(
        file_name().alias("source_file"), F.format_string("row %d has a different number of cells", "line_number").alias("message")
    )
    data = body.select("path", (F.col("line_number") - 2).alias("row_index"), padded.alias("cells"))
    return _as_cells(data, usable.select("path", "header"), package_id), bad.unionByName(ragged)
