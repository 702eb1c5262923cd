"""Reading the given tables, and SQL fragments shared by the twin queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.frames import cells_from_dataframe


# Tables that grow with the scale factor.
SPREAD = {"customer", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, split as its files are.

    The local session of tests and bench sets ``spark.plumbline.spread``, since its tables are
    one file of one row group each, which a scan cannot split. A cluster does not set it.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spread = spark.conf.get("spark.plumbline.spread", None)
    return df.repartition(int(spread)) if spread and name in SPREAD else df


def map_text(c: Column) -> Column:
    """A map as ``key:value`` pairs in key order."""
    items = F.array_sort(F.map_entries(c))
    return F.concat_ws(",", F.transform(items, lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))))


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as one table: a price, a shifted price, a rounded price and a customer key."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").alias("price_a"),
        F.round(F.col("o_totalprice") + 5, 2).alias("price_b"),
        F.round(F.col("o_totalprice") * 2, 1).alias("price_doubled"),
        (F.col("o_custkey") * 4 % 640).alias("bin"),
    )
    columns = ["price_a", "price_b", "price_doubled", "bin"]
    return cells_from_dataframe(orders, F.lit("orders"), F.col("o_orderkey"), columns, F.lit("p1"))


ORDER_CELLS = """
 src as (select o_orderkey as row_index, o_totalprice as price_a, round(o_totalprice+5,2) as price_b,
   round(o_totalprice*2,1) as price_doubled, o_custkey*4 % 640 as bin from orders),
 cells as (
   select row_index, 0 as col_index, 'price_a' as column_name, cast(price_a as varchar) as value from src
   union all select row_index, 1, 'price_b', cast(price_b as varchar) from src
   union all select row_index, 2, 'price_doubled', cast(price_doubled as varchar) from src
   union all select row_index, 3, 'bin', cast(bin as varchar) from src)
"""

LINE_ROW = "((l_orderkey*8+l_linenumber)*1000000+l_partkey)"


def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as one table per return flag and status."""
    lines = table(spark, sf_dir, "lineitem").withColumn("_row", F.expr(LINE_ROW))
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return cells_from_dataframe(
        lines, F.concat("l_returnflag", F.lit("-"), "l_linestatus"), F.col("_row"), columns, F.col("l_returnflag")
    )


LINE_CELLS = f"""
 src as (select l_returnflag as package_id, l_returnflag || '-' || l_linestatus as table_id, {LINE_ROW} as row_index,
   l_quantity, l_extendedprice, l_discount, l_tax from lineitem),
 cells as (
   select package_id, table_id, row_index, 0 as col_index, 'l_quantity' as column_name, cast(l_quantity as varchar) as value from src
   union all select package_id, table_id, row_index, 1, 'l_extendedprice', cast(l_extendedprice as varchar) from src
   union all select package_id, table_id, row_index, 2, 'l_discount', cast(l_discount as varchar) from src
   union all select package_id, table_id, row_index, 3, 'l_tax', cast(l_tax as varchar) from src)
"""
