"""Long-form cells and points from DataFrames of any width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.schemas import CELLS, POINTS


def cells_from_dataframe(
    df: DataFrame,
    table_id: Column,
    row_index: Column,
    columns: list[str],
    package_id: Column | None = None,
    source_file: Column | None = None,
) -> DataFrame:
    """One row per cell of the named columns, values as text.

    ``row_index`` must order the rows of a table and be unique in it.
    """
    base = df.select(
        F.coalesce(package_id if package_id is not None else F.lit(None), F.lit("")).cast("string").alias("package_id"),
        table_id.cast("string").alias("table_id"),
        F.coalesce(source_file if source_file is not None else table_id, F.lit("")).cast("string").alias("source_file"),
        row_index.cast("long").alias("row_index"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{i}") for i, c in enumerate(columns)],
    )
    items = F.array(
        *[
            F.struct(F.lit(i).alias("col_index"), F.lit(c).alias("column_name"), F.col(f"_{i}").alias("value"))
            for i, c in enumerate(columns)
        ]
    )
    return base.withColumn("c", F.explode(items)).select(
        "package_id",
        "table_id",
        "source_file",
        F.lit(None).cast("string").alias("sheet_name"),
        "row_index",
        F.col("c.col_index").alias("col_index"),
        F.col("c.column_name").alias("column_name"),
        F.col("c.value").alias("value"),
    ).select(*[F.col(f.name).cast(f.dataType) for f in CELLS.fields])


def points_from_dataframe(
    df: DataFrame,
    curve_id: Column,
    seq: Column,
    x: Column,
    y: Column,
    device_id: Column | None = None,
    source_file: Column | None = None,
    scan_direction: Column | None = None,
) -> DataFrame:
    """Curve points; ``seq`` orders the points of a curve and is unique in it."""
    unknown = F.lit("unknown")
    columns = {
        "curve_id": curve_id,
        "source_file": source_file if source_file is not None else curve_id,
        "device_id": device_id if device_id is not None else curve_id,
        "seq": seq,
        "x": x,
        "y": y,
        "scan_direction": scan_direction if scan_direction is not None else unknown,
    }
    return df.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in POINTS.fields])
