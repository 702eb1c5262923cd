"""Chunked neighbours, totals and ranks equal plain windows, whatever the chunk size."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import ordered

def plain():
    return Window.partitionBy("k").orderBy("o")



@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for key, n in (("hot", 900), ("b", 40), ("c", 1)):
        order = sorted(rng.sample(range(5000), n))
        data += [(key, o, rng.choice([1, 1, 2, 3]), rng.choice([None, 5, 6])) for o in order]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, o long, v int, w int").repartition(7)


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


@pytest.mark.parametrize("width", [1, 16, 300, 100000])
def test_neighbours_and_totals(rows, width):
    c = rows.withColumn("ch", ordered.order_chunk(F.col("o"), width))
    prev = ordered.with_previous(c, ["k"], "o", "ch", ["v"], "p").select("k", "o", F.col("p.v").alias("x"))
    same(prev, rows.select("k", "o", F.lag("v").over(plain()).alias("x")))
    nxt = ordered.with_next(c, ["k"], "o", "ch", ["v"], "p").select("k", "o", F.col("p.v").alias("x"))
    same(nxt, rows.select("k", "o", F.lead("v").over(plain()).alias("x")))
    total = ordered.with_running_total(c, ["k"], "o", "ch", F.col("v"), "s").select("k", "o", "s")
    same(total, rows.select("k", "o", F.sum("v").over(plain().rowsBetween(Window.unboundedPreceding, 0)).alias("s")))
    for forward in (True, False):
        filled = ordered.with_filled(c, ["k"], "o", "ch", "w", "f", forward).select("k", "o", "f")
        frame = plain().rowsBetween(Window.unboundedPreceding, 0) if forward else plain().rowsBetween(0, Window.unboundedFollowing)
        pick = F.last if forward else F.first
        same(filled, rows.select("k", "o", pick("w", ignorenulls=True).over(frame).alias("f")))


def test_runs_cross_chunk_borders(spark):
    data = [("a", i, v) for i, v in enumerate([7] * 10 + [8] * 3 + [7] * 2)]
    df = spark.createDataFrame(data, "k string, o long, v int").withColumn("ch", ordered.order_chunk(F.col("o"), 4))
    runs = ordered.islands(df, ["k"], "o", "ch", "v").orderBy("run_start").collect()
    assert [(r.run_value, r.run_length, r.run_start, r.run_end) for r in runs] == [(7, 10, 0, 9), (8, 3, 10, 12), (7, 2, 13, 14)]


def test_rank_spans_partitions(rows):
    ranked = ordered.with_rank(rows, ["k"], ["o"], "r").select("k", "o", "r")
    same(ranked, rows.select("k", "o", F.row_number().over(plain()).alias("r")))


@pytest.mark.parametrize("values", [[i * 10**9 for i in range(4000)], [*range(3999), 10**15]])
def test_row_chunks_are_even(spark, values):
    """Neither a sparse index nor an outlier makes many or uneven chunks."""
    df = spark.createDataFrame([("k", v) for v in values], "k string, o long").repartition(5)
    sizes = [r["count"] for r in ordered.row_chunks(df, ["k"], ["o"]).groupBy("_chunk").count().collect()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(sizes) == 4000 and len(sizes) <= parts and max(sizes) <= 2 * 4000 / parts
    runs = ordered.islands(ordered.row_chunks(df.withColumn("v", F.lit(1)), ["k"], ["o"]), ["k"], "o", "_chunk", "v").collect()
    assert [r["run_length"] for r in runs] == [4000]


def test_backward_fill_reads_each_row_once(rows):
    """No frame up to the last row of a chunk, which Spark goes through anew for each of its rows."""
    c = rows.withColumn("ch", ordered.order_chunk(F.col("o"), 300))
    filled = ordered.with_filled(c, ["k"], "o", "ch", "w", "f", forward=False).select("k", "o", "f")
    plan = filled._jdf.queryExecution().optimizedPlan().toString().replace("$", "").lower()
    assert "rowframe, currentrow" not in plan and "rowframe, 0, unboundedfollowing" not in plan


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_longest_island_equals_the_runs(spark, parts):
    rng = random.Random(5)
    data = [("mixed", i, rng.choice([1, 1, 1, 2, None])) for i in range(700)] + [("one", i * 9, 4) for i in range(300)]
    data += [("steps", i, i // 37) for i in range(400)] + [("nulls", i, None) for i in range(50)] + [("single", 5, 1)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, o long, v int").repartition(5)
    runs = ordered.islands(df.withColumn("ch", F.lit(0)), ["k"], "o", "ch", "v").groupBy("k").agg(F.max("run_length").alias("n"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        same(ordered.longest_island(df, ["k"], "o", "v"), runs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_longest_island_is_cut_by_rows(spark, monkeypatch):
    """Values are sorted in chunks whose number follows the rows, and none is shuffled again as a run."""
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 50)
    df = spark.range(1000).select(F.lit("a").alias("k"), F.col("id").alias("o"), F.floor(F.col("id") / 130).alias("v"))
    got = ordered.longest_island(df, ["k"], "o", "v", 1000)
    assert [tuple(r) for r in got.collect()] == [("a", 130)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and ", 20)" in plan[plan.index("rangepartitioning") :][:200]
