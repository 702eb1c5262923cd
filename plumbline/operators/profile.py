"""Column profiles and the value statistics that the numeric checks build on."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import cells as C
from plumbline.operators import ordered
from plumbline.session import materialize, staged

KEYS = ["package_id", "table_id", "source_file", "col_index", "column_name"]
TABLE = ["package_id", "table_id", "source_file"]


def table_manifest(cells: DataFrame) -> DataFrame:
    """Row count, column count and ordered header of every table."""
    columns = cells.groupBy(*KEYS).agg(F.max("row_index").alias("last_row"), F.count(F.lit(1)).alias("n_cells"))
    return columns.groupBy(*TABLE).agg(
        F.max("last_row").alias("last_row_index"),
        F.max("n_cells").alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        F.transform(F.array_sort(F.collect_list(F.struct("col_index", "column_name"))), lambda s: s["column_name"]).alias(
            "columns"
        ),
    )


def _histogram(items: Column, field: str) -> Column:
    """Sum of ``n`` per value of ``field`` over an array of structs, as an ordered map."""
    values = F.array_sort(F.array_distinct(F.filter(F.transform(items, lambda i: i[field]), lambda v: v.isNotNull())))

    def total(v):
        held = F.filter(items, lambda i: i[field] == v)
        return F.aggregate(held, F.lit(0).cast("long"), lambda acc, i: acc + i["n"])

    return F.map_from_arrays(values, F.transform(values, total))


def profile_columns(cells: DataFrame) -> DataFrame:
    """Missing, unique and typed counts, digit histograms, unit and precision hints per column.

    The first grouping is by (column, text), so repeated texts shrink before the
    shuffle and no single task holds a column.
    """
    text = F.trim("value")
    by_text = (
        cells.groupBy(*KEYS, F.coalesce(text, F.lit("")).alias("text"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("missing", C.is_missing(F.col("text")))
        .withColumn("numeric", ~F.col("missing") & C.is_number_text(F.col("text")))
        .withColumn("whole", F.col("numeric") & C.is_integer_text(F.col("text")))
        .withColumn("places", F.when(F.col("numeric"), C.decimal_places(F.col("text"))))
        .withColumn("digit", F.when(F.col("numeric"), C.last_digit(F.col("text")).cast("int")))
    )
    by_shape = by_text.groupBy(*KEYS, "missing", "numeric", "whole", "places", "digit").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")
    )

    def total(flag: Column, what: str = "n") -> Column:
        return F.coalesce(F.sum(F.when(flag, F.col(what))), F.lit(0)).cast("long")

    shapes = F.collect_list(F.when(F.col("numeric"), F.struct("places", "digit", "n")))
    out = by_shape.groupBy(*KEYS).agg(
        F.sum("n").alias("total_count"),
        total(F.col("missing")).alias("missing_count"),
        total(~F.col("missing"), "texts").alias("unique_count"),
        total(F.col("numeric")).alias("numeric_count"),
        total(F.col("whole")).alias("integer_count"),
        F.max("places").alias("max_places"),
        shapes.alias("_shapes"),
    )
    present = F.col("total_count") - F.col("missing_count")
    return out.select(
        *KEYS,
        F.when(present == 0, "string")
        .when(F.col("numeric_count") == present, F.when(F.col("integer_count") == present, "integer").otherwise("float"))
        .when(F.col("numeric_count") > 0, "mixed")
        .otherwise("string")
        .alias("inferred_type"),
        "total_count",
        "missing_count",
        "unique_count",
        "numeric_count",
        "integer_count",
        (F.col("numeric_count") - F.col("integer_count")).alias("float_count"),
        _histogram(F.col("_shapes"), "places").alias("decimal_places_observed"),
        _histogram(F.col("_shapes"), "digit").alias("terminal_digits_observed"),
        C.unit_hint(F.col("column_name")).alias("unit_hint"),
        F.pow(F.lit(10.0), -F.col("max_places")).alias("precision_hint"),
        "max_places",
    )


def numeric_values(cells: DataFrame) -> DataFrame:
    """Exact numbers of the numeric cells."""
    return (
        cells.select(*KEYS, "row_index", C.to_exact_decimal(F.col("value")).alias("v"), C.decimal_places(F.col("value")).alias("places"))
        .where(F.col("v").isNotNull())
    )


def value_counts(values: DataFrame) -> DataFrame:
    """Distinct values with frequency and first row."""
    return values.groupBy(*KEYS, "v").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_index").alias("first_row"), F.max("places").alias("places")
    )


def modal_value(counts: DataFrame) -> DataFrame:
    """Most frequent value and its share; a tie goes to the value seen first."""
    best = F.max(F.struct("n", (-F.col("first_row")).alias("neg_first"), "v"))
    return counts.groupBy(*KEYS).agg(best.alias("b"), F.sum("n").alias("total_count"), F.count(F.lit(1)).alias("unique_count")).select(
        *KEYS,
        F.col("b.v").alias("modal_value"),
        F.col("b.n").alias("modal_count"),
        (F.col("b.n") / F.col("total_count")).alias("modal_ratio"),
        "total_count",
        "unique_count",
    )


def run_lengths(values: DataFrame) -> DataFrame:
    """Runs of equal consecutive values per column; chunks hold about equally many rows, however sparse the index."""
    chunked = ordered.row_chunks(values.select(*KEYS, "row_index", "v"), KEYS, ["row_index"])
    return ordered.islands(chunked, KEYS, "row_index", "_chunk", "v")


def longest_runs(cells: DataFrame, columns: DataFrame, rows: int | None = None) -> DataFrame:
    """Length of the longest run of equal consecutive numbers of each listed column; ``rows``: about how many there are."""
    # two hashes stand for the column key where every value is sorted
    marks = [F.xxhash64(*KEYS, F.lit(seed)).alias(f"c{seed}") for seed in (1, 2)]
    listed = columns.select(*KEYS).distinct().select(*KEYS, *marks)
    own = cells.select(*KEYS, "row_index", "value").join(listed, KEYS).select("c1", "c2", "row_index", "value")
    # a generator: cells of other columns are not parsed, as they would be by a filter that moves before the join
    own = staged(own, v=C.to_exact_decimal(F.col("value"))).where(F.col("v").isNotNull())
    return ordered.longest_island(own, ["c1", "c2"], "row_index", "v", rows).join(listed, ["c1", "c2"]).drop("c1", "c2")


def _digits(v: Column) -> Column:
    """Unscaled digits of an exact decimal, 18 of them behind the point."""
    return F.replace(v.cast("string"), F.lit("."), F.lit(""))


def scaled_counts(counts: DataFrame) -> DataFrame:
    """Value counts with integer units ``k`` at the finest scale a column uses.

    ``k`` counts steps of ``10**-scale``. Whole-number arithmetic on it is exact and
    stays in one machine word unless the column is marked ``wide``.
    """
    # read twice; written once, the cells are not parsed and counted again
    counts = materialize(counts, "value-counts")
    fraction = F.substring_index(F.col("v").cast("string"), ".", -1)
    used = F.length(F.regexp_replace(fraction, "0+$", ""))
    whole = F.length(F.regexp_replace(F.substring_index(F.col("v").cast("string"), ".", 1), "^-?0*", ""))
    shape = counts.groupBy(*KEYS).agg(
        F.max(used).alias("scale"),
        F.max(whole).alias("whole"),
        F.max("places").alias("max_places"),
        F.sum("n").alias("total"),
        F.max("n").alias("modal_n"),
        F.count(F.lit(1)).alias("uniq"),
        F.min("v").alias("v0"),
        F.max("v").alias("v1"),
    )
    digits = _digits(F.col("v"))
    units = digits.substr(F.lit(1), F.length(digits) - (F.lit(18) - F.col("scale")))
    return (
        counts.select(*KEYS, "v", "n", "first_row")
        .join(shape, KEYS)
        .withColumn("wide", F.col("scale") + F.col("whole") + F.length(F.col("total").cast("string")) > 18)
        .withColumn("k", units.cast("decimal(38,0)"))
    )


def _neighbours(scaled: DataFrame) -> DataFrame:
    """Distinct values with the next smaller one; values chunked already (:func:`chunked_values`) are used as they are."""
    chunked = scaled if "_chunk" in scaled.columns else chunked_values(scaled)
    return ordered.with_previous(chunked, KEYS, "k", "_chunk", ["k"], "_prev").where(F.col("_prev").isNotNull())


def chunked_values(scaled: DataFrame) -> DataFrame:
    """Scaled counts in chunks of about equally many distinct values, written once for all that reads them."""
    return ordered.row_chunks(scaled, KEYS, ["k"])


def step_candidates(scaled: DataFrame) -> DataFrame:
    """Gaps between neighbouring distinct values, with count and first position."""
    return (
        _neighbours(scaled)
        .withColumn("step", F.col("k") - F.col("_prev.k"))
        .groupBy(*KEYS, "scale", "max_places", "wide", "total", "modal_n", "uniq", "v0", "v1", "step")
        .agg(F.count(F.lit(1)).alias("step_count"), F.min("k").alias("first_k"))
        .withColumn("step", F.col("step").cast("decimal(38,0)"))
    )


def step_profile(scaled: DataFrame) -> DataFrame:
    """Smallest gap and most frequent gap (first seen on a tie) between distinct values."""
    best = F.max(F.struct("step_count", (-F.col("first_k")).alias("neg"), "step"))
    unit = F.pow(F.lit(10.0), F.col("scale"))
    return (
        step_candidates(scaled)
        .groupBy(*KEYS, "scale")
        .agg(F.min("step").alias("min_k"), best.alias("b"))
        .select(
            *KEYS,
            (F.col("min_k").cast("double") / unit).alias("min_positive_step"),
            (F.col("b.step").cast("double") / unit).alias("modal_step"),
            F.col("b.step_count").alias("modal_step_count"),
        )
    )


def value_set_overlap(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """Jaccard share of the distinct values of two columns of one table.

    ``pairs`` has ``package_id, table_id, left_column, right_column``.
    """
    # grouping by the value first keeps a column with very many rows off one task
    sets = values.select("package_id", "table_id", "column_name", "v").distinct()
    sides = pairs.select(
        "package_id", "table_id", "left_column", "right_column", F.explode(F.array("left_column", "right_column")).alias("column_name")
    )
    by_value = (
        sets.join(sides, ["package_id", "table_id", "column_name"])
        .groupBy("package_id", "table_id", "left_column", "right_column", "v")
        .agg(F.count(F.lit(1)).alias("sides"))
    )
    return by_value.groupBy("package_id", "table_id", "left_column", "right_column").agg(
        F.count_if(F.col("sides") == 2).alias("shared_values"),
        F.count(F.lit(1)).alias("all_values"),
        (F.count_if(F.col("sides") == 2) / F.count(F.lit(1))).alias("overlap"),
    )


MIN_STEP_TO_PRECISION = 1.5
#: Gaps of a column that are tried first, those with the best bounds.
FIRST = 32


def _prime_powers(top: int) -> list[int]:
    """Prime powers up to ``top``."""
    primes = [p for p in range(2, top + 1) if all(p % k for k in range(2, int(p**0.5) + 1))]
    return sorted(p**e for p in primes for e in range(1, top.bit_length()) if p**e <= top)


#: Divisors whose multiples are counted: prime powers up to a byte.
DIVISORS = _prime_powers(255)


def _spacing() -> Column:
    """Units between two values of the column's precision."""
    return F.pow(F.lit(10.0), F.col("scale") - F.col("max_places"))


def with_bounds(scaled: DataFrame, steps: DataFrame) -> DataFrame:
    """Add ``bound``: no more rows than that can lie on the grid of a gap; and ``known``, the rows that do, where the counts tell.

    1. A grid of step ``s`` has at most ``range / s + 1`` places, and a place at most the
       values within its slack, each of them at most as often as the modal value.
    2. Where only exact multiples count as aligned, the multiples of a gap are multiples of
       every divisor of it. The rows at multiples of each prime power up to 255 are
       counted in one pass, so a gap has no more rows than its rarest such divisor.
    """
    span = (F.col("v1") - F.col("v0")).cast("double") * F.pow(F.lit(10.0), F.col("scale"))
    a_place = F.col("modal_n") * (F.floor(2 * F.col("slack") / _spacing()) + 1)
    room = F.ceil((span / F.col("step").cast("double") + 2.0) * a_place)
    exact = (F.col("step") < 1000000) & (F.col("scale") < 12) & (F.col("scale") <= F.col("max_places")) & ~F.col("wide")
    offset = (F.col("k") - _units_of_minimum()).cast("long")
    multiples = (
        scaled.where(~F.col("wide"))
        .withColumn("_offset", offset)
        .groupBy(*KEYS)
        .agg(F.array(*[F.sum(F.when(F.col("_offset") % d == 0, F.col("n")).otherwise(F.lit(0))) for d in DIVISORS]).alias("_multiples"))
    )
    held = F.zip_with("_multiples", F.array(*[F.lit(d) for d in DIVISORS]), lambda n, d: F.when(F.col("step").cast("long") % d == 0, n))
    rarest = F.when(exact, F.array_min(held))
    # the rarest prime power in a prime power is itself
    known = F.when(F.col("step").isin(DIVISORS), rarest)
    bounds = {"bound": F.least(F.col("total"), room.cast("long"), rarest), "known": known}
    return steps.join(multiples, KEYS, "left").withColumns(bounds).drop("_multiples")


def lattice_fit(scaled: DataFrame, min_overlap: float | None = None) -> DataFrame:
    """The gap on whose grid (from the minimum) most values lie.

    Candidates are the distinct gaps of at least 1.5 times the precision. Branch and bound:
    gaps whose bound (:func:`with_bounds`) is below the best known fit are left out; those
    with the best bounds are tried against every distinct value, then the others whose
    bound is not below the best fit found so far. ``min_overlap`` is a floor from the
    start. Nothing else is left out, so the fit is exact.
    """
    # tolerance: the largest of a quarter of the precision, a millionth of the step, 1e-12
    quarter = F.floor(_spacing() / 4.0)
    tiny = F.floor(F.pow(F.lit(10.0), F.col("scale") - 12))
    slack = F.greatest(quarter, tiny, F.floor(F.col("step") / F.lit(1000000)).cast("long")).cast("long")
    steps = step_candidates(scaled).where(F.col("step").cast("double") >= MIN_STEP_TO_PRECISION * _spacing())
    steps = with_bounds(scaled, steps.withColumn("slack", slack))
    if min_overlap is not None:
        steps = steps.where(F.col("bound") >= F.lit(min_overlap) * F.col("total") - 1e-6)
    # two hashes stand for the column key in the large joins
    marks = [F.xxhash64(*KEYS, F.lit(seed)).alias(f"c{seed}") for seed in (1, 2)]
    steps = steps.withColumn("_best", F.max("known").over(Window.partitionBy(*KEYS))).where(F.col("bound") >= F.coalesce("_best", F.lit(0)))
    promising = Window.partitionBy(*KEYS).orderBy(F.desc("bound"), "step")
    steps = steps.withColumn("_rank", F.row_number().over(promising)).select(*KEYS, *marks, "step", "slack", "bound", F.col("_rank") <= FIRST)
    # read by several branches below; the gaps are few, the windows behind them are not cheap
    steps = materialize(steps.toDF(*KEYS, "c1", "c2", "step", "slack", "bound", "first"), "gaps")
    offset = (F.col("k") - _units_of_minimum()).cast("decimal(38,0)")
    offsets = scaled.select(*marks, "n", "wide", "uniq", offset.alias("offset"))
    fits = materialize(_fit_blocks(offsets, steps.where("first")), "fits")
    reached = fits.groupBy("c1", "c2").agg(F.max("aligned").alias("_reached"))
    rest = materialize(steps.where(~F.col("first")).join(reached, ["c1", "c2"]).where(F.col("bound") >= F.col("_reached")).drop("_reached"), "gaps")
    if not rest.isEmpty():
        fits = fits.unionByName(_fit_blocks(offsets, rest))
    columns = scaled.select(*KEYS, "scale", "max_places", "total").distinct().select("*", *marks)
    scored = fits.join(columns, ["c1", "c2"]).withColumn(
        "residual", F.col("distance").cast("double") / F.col("total") / F.col("step").cast("double")
    )
    best = F.max(F.struct("aligned", (-F.col("residual")).alias("neg_residual"), "step", "scale", "max_places"))
    unit = F.pow(F.lit(10.0), F.col("b.scale"))
    return scored.groupBy(*KEYS, "total").agg(best.alias("b")).select(
        *KEYS,
        (F.col("b.step").cast("double") / unit).alias("lattice_step"),
        (F.col("b.aligned") / F.col("total")).alias("lattice_overlap"),
        (-F.col("b.neg_residual")).alias("lattice_residual"),
        (F.col("b.step").cast("double") / F.pow(F.lit(10.0), F.col("b.scale") - F.col("b.max_places"))).alias(
            "step_to_precision_ratio"
        ),
    )


def _units_of_minimum() -> Column:
    digits = _digits(F.col("v0"))
    return digits.substr(F.lit(1), F.length(digits) - (F.lit(18) - F.col("scale"))).cast("decimal(38,0)")


BLOCK = 512
FIT = "c1 long, c2 long, step decimal(38,0), aligned long, distance double"


def _fit_arrays(batches):
    """Aligned weight and summed distance of a block of values for every gap of a block."""
    for batch in batches:
        parts = []
        for c1, c2, wide, offsets, ns, steps, slacks in batch.itertuples(index=False):
            # units of more digits than a machine word holds are Python integers
            kind = object if wide else np.int64
            offsets, steps = (np.array([int(x) for x in a], dtype=kind) for a in (offsets, steps))
            ns, slacks = np.asarray(ns, dtype=kind), np.asarray(slacks, dtype=kind)
            rest = offsets[None, :] % steps[:, None]
            distance = np.minimum(rest, steps[:, None] - rest)
            aligned = np.where(distance <= slacks[:, None], ns[None, :], 0).sum(axis=1)
            size = len(steps)
            parts.append((np.full(size, c1), np.full(size, c2), [Decimal(int(s)) for s in steps], aligned, distance @ ns))
        if parts:
            c1, c2, steps, aligned, distance = zip(*parts)
            flat = {"aligned": np.concatenate(aligned).astype(np.int64), "distance": np.concatenate(distance).astype(float)}
            yield pd.DataFrame({"c1": np.concatenate(c1), "c2": np.concatenate(c2), "step": [s for part in steps for s in part], **flat})


def _fit_blocks(values: DataFrame, steps: DataFrame) -> DataFrame:
    """Every value against every gap of its column, in blocks of bounded size.

    Values and gaps are cut by hash into blocks of about ``BLOCK``; each pair of blocks
    is one row and one array operation. Pairs are spread evenly over the tasks, so one
    very large column uses all of them.
    """
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gaps = F.ceil(F.count(F.lit(1)) / F.lit(BLOCK))
    sizes = steps.groupBy("c1", "c2").agg(gaps.cast("int").alias("blocks"))
    # units travel as texts, which hold any number of digits
    value_block = F.pmod(F.xxhash64("offset"), F.ceil(F.col("uniq") / F.lit(BLOCK))).alias("b")
    left = (
        values.join(sizes, ["c1", "c2"])
        .groupBy("c1", "c2", "wide", "blocks", value_block)
        .agg(F.collect_list(F.struct(F.col("offset").cast("string").alias("o"), "n")).alias("v"))
        .withColumn("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    right = (
        steps.join(sizes, ["c1", "c2"])
        .groupBy("c1", "c2", F.pmod(F.xxhash64("step"), F.col("blocks")).cast("int").alias("g"))
        .agg(F.collect_list(F.struct(F.col("step").cast("string").alias("step"), "slack")).alias("s"))
    )
    pairs = left.join(right, ["c1", "c2", "g"]).select("c1", "c2", "wide", "v.o", "v.n", "s.step", "s.slack")
    return (
        pairs.repartition(tasks)
        .mapInPandas(_fit_arrays, FIT)
        .groupBy("c1", "c2", "step")
        .agg(F.sum("aligned").alias("aligned"), F.sum("distance").alias("distance"))
    )
