"""Mix sources to target weights along a time-varying curriculum, with SQL functions only.

Every source has a token target (a share of the mix, at most ``cap`` times its size) and a
schedule: its weight as a piecewise linear function of training time 0..1. The integral of
the schedule, scaled to the target, is the demand of the source up to a moment. A document
stands at a place of its source's demand, and the inverse of the integral gives its
training position. The training order is a range sort by position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ordered import with_rank
from plumbline.session import materialize

WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows of a source that one window of the running total should hold.
BUCKET_ROWS = 4_000
#: Schedule of the first, second, third weight: (time, weight); only the shape matters.
SCHEDULES = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
    ((0.0, 0.0), (1.0, 2.0)),
)


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _inverse(share: Column, knots) -> Column:
    """The time at which the integral of a schedule reaches ``share`` of its whole area."""
    if len(knots) < 2 or any(b[0] <= a[0] for a, b in zip(knots, knots[1:])) or any(w < 0 for _, w in knots):
        raise ValueError("a schedule needs two or more knots in order of time, with weights of 0 or more")
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    if sum(areas) <= 0:
        raise ValueError("a schedule needs some weight")
    done, out = 0.0, F.lit(float(knots[-1][0]))
    pieces = []
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
        rest = F.greatest(share * F.lit(sum(areas)) - F.lit(done), F.lit(0.0))
        root = F.lit(w0) + F.sqrt(F.lit(w0 * w0) + F.lit(2 * (w1 - w0) / (t1 - t0)) * rest)
        step = F.when(rest > 0, F.lit(2.0) * rest / root).otherwise(F.lit(0.0))
        done += area
        pieces.append((share * F.lit(sum(areas)) <= F.lit(done), F.lit(t0) + step))
    for test, value in reversed(pieces):
        out = F.when(test, value).otherwise(out)
    return F.least(F.greatest(out, F.lit(float(knots[0][0]))), F.lit(float(knots[-1][0])))


def source_targets(sizes: DataFrame, weights=(5, 2, 1), total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: its size, weight and target.

    ``total`` times all sizes are shared by weight. What exceeds ``cap`` times a source's
    size goes to the others, until none is above. One small row per source is kept on
    disk; each round of sharing reads them and returns two sums.
    """
    if not 0 <= total <= cap or not weights or any(w <= 0 for w in weights):
        raise ValueError("need 0 <= total <= cap and positive weights")
    grouped = sizes.groupBy("_null", "_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    ranked = with_rank(grouped, [], ["_null", "_source"], "_place")
    place = ((F.col("_place") - 1) % len(weights)).cast("int")
    sources = materialize(
        ranked.withColumn("_kind", place).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)),
        "sources",
    )
    whole = sources.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    budget, level = float(whole["s"] or 0) * total, 0.0
    while whole["w"]:
        full = F.col("weight") * F.lit(level) >= F.col("source_size") * F.lit(cap)
        now = sources.agg(
            F.sum(F.when(full, F.col("source_size") * F.lit(cap)).otherwise(0.0)).alias("kept"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("w"),
        ).first()
        if not now["w"]:
            break
        raised = (budget - now["kept"]) / now["w"]
        if raised <= level:
            break
        level = raised
    limit = F.col("source_size") * F.lit(cap)
    return sources.withColumn("target", F.round(F.least(F.col("weight") * F.lit(level), limit), 6))


def plan_mix(
    docs: DataFrame,
    weights=(5, 2, 1),
    total: float = 1.5,
    cap: float = 2.0,
    schedules=SCHEDULES,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: how many of its words the mix takes, and where.

    Columns: doc_id, source, size, source_size, target, taken, positions (one per copy
    taken, ascending). Within a source, documents are taken in the order of the MD5 of
    their id, again from the start for the next copy; the document at the end of the
    target gives the words still due, so a source's words sum up to its rounded target.

    A null or empty text has size 0 and is never taken. A null source is a source of its
    own, the last one. Rows with one doc_id are separate documents; equal ones may swap
    places, which changes no row of the result. A null doc_id counts as an id. The
    columns ``carry`` come along and break ties; other columns of ``docs`` are ignored. No documents give no rows.
    """
    sizes = materialize(
        docs.select(
            F.col("doc_id"),
            F.col("source").isNull().alias("_null"),
            F.coalesce(F.col("source"), F.lit("")).alias("_source"),
            word_count(F.col("text")).alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_draw"),
            *carry,
        ),
        "sizes",
    )
    targets = source_targets(sizes, weights, total, cap)
    rows = targets.agg(F.max("_rows")).first()[0] or 0
    digits = max(0, math.ceil(math.log(max(1, rows / BUCKET_ROWS), 16)))
    keys = ["_null", "_source"]
    placed = sizes.withColumn("_bucket", F.substring("_draw", 1, digits) if digits else F.lit(""))
    # words of a source before each bucket: one small row per source and bucket
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        placed.groupBy(*keys, "_bucket")
        .agg(F.sum("size").alias("_words"))
        .withColumn("_before", F.coalesce(F.sum("_words").over(earlier), F.lit(0)))
        .drop("_words")
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy("_draw", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = local.join(before, [*keys, "_bucket"]).join(targets.drop("_rows"), keys)
    due = F.round("target").cast("long")
    start = F.col("_before") + F.col("_within")
    copies = range(max(1, math.ceil(cap)))
    words = [F.greatest(F.least(due - start - F.col("source_size") * n, F.col("size")), F.lit(0)) for n in copies]
    place = F.lit(None).cast("double")
    positions = []
    for n in copies:
        share = (start + F.col("source_size") * n) / F.col("target")
        place = F.lit(None).cast("double")
        for kind in range(len(weights)):
            place = F.when(F.col("_kind") == kind, _inverse(share, schedules[kind % len(schedules)])).otherwise(place)
        positions.append(F.when(words[n] > 0, F.round(place, 9)))
    return out.select(
        "doc_id",
        F.when(~F.col("_null"), F.col("_source")).alias("source"),
        "size",
        "source_size",
        "target",
        sum(words[1:], words[0]).cast("long").alias("taken"),
        F.array_compact(F.array(*positions)).alias("positions"),
        *carry,
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, with the white space before and between."""
    pieces = F.split(text, "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def training_order(plan: DataFrame) -> DataFrame:
    """One row per copy taken, range-sorted by training position (ties by doc_id)."""
    copies = plan.select("*", F.posexplode("positions").alias("copy", "position")).drop("positions")
    return copies.orderBy("position", "doc_id", "copy")
