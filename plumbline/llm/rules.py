"""Quality rules whose cut-offs follow the data: fences from quantile sketches per language and source.

A sketch counts values by logarithmic bucket. Two sketches merge by adding counts, so it
needs one grouped count, gives the same result in any order and at any partitioning, and
holds every value to within ``ERROR`` of itself. Each measure of a document is compared
with the fences of its language and source; groups of few documents use the merged sketch
of their language, or of all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WHITE = [0x20, *range(0x09, 0x0E)]
SYMBOLS = list(b"#*$%&|<>")
#: Words of a window whose repeats count.
WIDTH = 8
#: Base rules: at least so many words, and at most so many percent of them in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Relative error of a sketch, and documents that a group needs for fences of its own.
ERROR, GROUP = 0.01, 200
GAMMA = (1 + ERROR) / (1 - ERROR)
#: Fences lie so many quartile spreads outside the quartiles.
SPREADS = 6.0
#: Each measure with the least quartile spread it is credited with, and whether low values fail too.
MEASURES = {
    "mean_word": (0.5, True),
    "symbol_ratio": (0.02, False),
    "duplicate_lines": (0.1, False),
    "repeated_words": (0.06, False),
    "capitals": (0.02, False),
    "marks": (0.03, False),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")


def repeated_words(ids: np.ndarray, width: int = WIDTH) -> int:
    """How many words lie in a window of ``width`` words that occurs twice or more.

    ``ids`` are the words as numbers; ``width`` is a power of two. Windows are named by
    doubling: equal names mean equal words, so nothing hangs on a hash.
    """
    if len(ids) <= width:
        return 0
    names, step = ids, 1
    while step < width:
        kinds, names = np.unique(names[:-step] * (int(names.max()) + 1) + names[step:], return_inverse=True)
        if len(kinds) == len(names):
            return 0
        step *= 2
    again = np.bincount(names)[names] > 1
    edges = np.zeros(len(ids) + 1, np.int64)
    edges[:-width] += again
    edges[width:] -= again
    return int((np.cumsum(edges) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """The counts ``COUNTS`` of one whole text."""
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(m.group(), len(seen)) for m in WORD.finditer(text)), np.int64)
    code = np.zeros(256, np.int64)
    for at in range(0, len(text), 1 << 20):
        code += np.bincount(np.frombuffer(text[at : at + (1 << 20)].encode("utf-8", "replace"), np.uint8), minlength=256)
    lines, kept, start = 0, set(), 0
    while start <= len(text):
        end = text.find("\n", start)
        end = len(text) if end < 0 else end
        if WORD.search(text, start, end):
            lines += 1
            kept.add(text[start:end])
        start = end + 1
    chars = len(text) - int(code[WHITE].sum())
    return len(ids), chars, int(code[SYMBOLS].sum()), lines - len(kept), repeated_words(ids), lines, int(code[65:91].sum()), int(code[33])


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([measure(t.as_py() or "") for t in batch.column("text")], np.int64).reshape(-1, len(COUNTS))
        arrays = [batch.column(n) for n in ("doc_id", "_group", "_lang")]
        yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(found[:, i]) for i in range(len(COUNTS))]], names=["doc_id", "_group", "_lang", *COUNTS])


def measured(docs: DataFrame) -> DataFrame:
    """``COUNTS`` and ``MEASURES`` of (doc_id, text, lang, source), with ``_group`` and ``_lang`` as keys."""
    named = lambda *c: F.to_json(F.struct(*c))
    rows = docs.select("doc_id", "text", named("lang", "source").alias("_group"), named("lang").alias("_lang"))
    schema = rows.drop("text").schema
    for name in COUNTS:
        schema = schema.add(name, "long")
    out = rows.mapInArrow(_measure_batches, schema)
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return out.select(
        "*",
        share("word_chars", "n_words").alias("mean_word"),
        share("n_symbols", "n_words").alias("symbol_ratio"),
        share("n_dup_lines", "n_lines").alias("duplicate_lines"),
        share("n_repeat_words", "n_words").alias("repeated_words"),
        share("n_capitals", "word_chars").alias("capitals"),
        share("n_marks", "n_words").alias("marks"),
    )


def sketch(rows: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """(keys, measure, bucket, n): how many values of a measure lie in a bucket; zero has the null bucket."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures]))
    bucket = F.when(F.col("_pair.value") > 0, F.ceil(F.log(F.col("_pair.value")) / F.log(F.lit(GAMMA))))
    return rows.select(*keys, pairs.alias("_pair")).groupBy(*keys, F.col("_pair.measure").alias("measure"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of coarser ``keys``."""
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, ``<measure>_low``, ``<measure>_high``): the fences of every sketch, from its quartiles."""
    order = Window.partitionBy(*keys, "measure").orderBy(F.col("bucket").asc_nulls_first())
    total = F.sum("n").over(Window.partitionBy(*keys, "measure"))
    value = F.coalesce(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1), F.lit(0.0))
    summed = sketches.select(*keys, "measure", value.alias("value"), F.sum("n").over(order).alias("upto"), total.alias("total"))
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("value")))
    found = summed.groupBy(*keys, "measure").agg(quartile(0.25).alias("a"), quartile(0.75).alias("b"), F.max("total").alias("n"))
    columns = [F.max("n").alias("n")]
    for name, (least, both) in MEASURES.items():
        spread = SPREADS * F.greatest(F.col("b") - F.col("a"), F.lit(least))
        mine = F.col("measure") == name
        columns.append(F.max(F.when(mine, F.col("a") - spread if both else F.lit(float("-inf")))).alias(f"{name}_low"))
        columns.append(F.max(F.when(mine, F.col("b") + spread)).alias(f"{name}_high"))
    return found.groupBy(*keys).agg(*columns)


def thresholds(rows: DataFrame) -> DataFrame:
    """The fences (_group, n, ...) of each language and source; few documents borrow from their language or from all."""
    bounds = [f"{m}_{end}" for m in MEASURES for end in ("low", "high")]
    own = materialize(sketch(rows, ["_lang", "_group"], list(MEASURES)), "sketches")
    # one row of numbers for all documents
    everyone = fences(merge(own, []).withColumn("_all", F.lit(1)), ["_all"]).select("n", *bounds).first()
    by_lang = fences(merge(own, ["_lang"]), ["_lang"])
    at = lambda name: F.when(F.col("n") >= GROUP, F.col(name)).otherwise(F.lit(everyone[name] if everyone else None).cast("double"))
    by_lang = by_lang.select("_lang", *[at(b).alias(f"lang_{b}") for b in bounds])
    groups = fences(own, ["_lang", "_group"]).join(by_lang, "_lang")
    return groups.select("_group", "n", *[F.when(F.col("n") >= GROUP, F.col(b)).otherwise(F.col(f"lang_{b}")).alias(b) for b in bounds])


def within_fences() -> Column:
    """Whether all measures of a row lie within its fences."""
    good = F.lit(True)
    for name in MEASURES:
        good = good & F.col(name).between(F.col(f"{name}_low"), F.col(f"{name}_high"))
    return good


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source; other columns are ignored).

    Gives ``COUNTS``, ``MEASURES``, ``base_failed`` and ``kept``: false where a base rule
    fails or a measure lies outside its fences. A null or empty text has no words and fails
    a base rule. Null languages and sources are groups like any other. Rows with one id are
    separate documents; a null id stays null. No rows give no rows.
    """
    rows = materialize(measured(docs), "measures")
    limits = materialize(thresholds(rows), "fences")
    # groups with a thousandth of all rows or more are a thousand at most, so their fences may be broadcast
    many = rows.count() / 1000
    hot = F.broadcast(limits.where(F.col("n") >= many))
    rest = rows.join(hot.select("_group"), "_group", "left_anti").join(limits.where(F.col("n") < many), "_group")
    judged = rows.join(hot, "_group").unionByName(rest)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return judged.select("doc_id", *COUNTS, *MEASURES, failed.alias("base_failed"), (~failed & within_fences()).alias("kept"))
