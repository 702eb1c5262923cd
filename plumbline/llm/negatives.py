"""Hard negatives for contrastive training, from exact integer scores.

Components are scaled to integers. A block of anchors is multiplied with a slab of rows
once per prime of a residue number system, in float32: with balanced residues below
``LIMIT`` / 2 and ``DEPTH`` products a sum, every sum is an integer below 2**24 and so exact. The
signed scores follow from the residues by Chinese remaindering (mixed radix). Selection is
by windows: the positives first, then the rows within each positive's range of scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import materialize

#: Products summed in float32 at once, and the bound of primes this allows: DEPTH * (LIMIT / 2)**2 <= 2**24.
DEPTH, LIMIT = 64, 1024
#: Anchors of a block, rows of a slab, at most and at least about, and scores held at once.
BLOCK, SLAB, LEAST, CELLS = 32768, 65536, 4096, 1 << 21
POSITIVES, NEGATIVES = 5, 10
#: A negative scores between these percentages of its positive.
LOW, HIGH = 30, 90


def primes() -> Iterator[int]:
    """Primes below ``LIMIT``, the largest first."""
    for n in range(LIMIT - 1, 2, -1):
        if all(n % k for k in range(2, math.isqrt(n) + 1)):
            yield n


def system(bound: int) -> list[int]:
    """So many primes that all integers from -bound to bound have residues of their own."""
    chosen, product = [], 1
    for p in primes():
        if product > 2 * bound:
            break
        chosen.append(p)
        product *= p
    return chosen


def largest_component(width: int) -> int:
    """Components end at this, so that 100 times any score of ``width`` components is a long."""
    return math.isqrt(((1 << 63) - 1) // (100 * max(1, width)))


def balanced(values: np.ndarray, p: int) -> np.ndarray:
    """Residues from -(p - 1) / 2 to (p - 1) / 2 of integers held in float64."""
    rest = np.fmod(values, p)  # exact for every float64
    rest[rest > p // 2] -= p
    rest[rest < -(p // 2)] += p
    return rest.astype(np.float32)


def residue_products(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """``a @ b.T`` modulo p, from 0 to p - 1; a and b are balanced residues."""
    total = np.zeros((len(a), len(b)), np.int64)
    for k in range(0, a.shape[1], DEPTH):
        total += (a[:, k : k + DEPTH] @ b[:, k : k + DEPTH].T).astype(np.int64)
    return total % p


def reconstruct(residues: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The signed integers with these residues, in mixed radix with balanced digits, which never overflow."""
    value, radix = np.zeros_like(residues[0]), 1
    for r, p in zip(residues, moduli):
        digit = (r - value) % p * pow(radix, -1, p) % p
        digit[digit > p // 2] -= p
        value += digit * radix
        radix *= p
    return value


def scaled(vectors: pd.Series, width: int) -> np.ndarray:
    """``floor(256 * x)`` of all components as float64, which is exact; short vectors end in zeros."""
    sizes, cap = vectors.map(len).to_numpy(int), float(largest_component(width))
    out = np.zeros((len(vectors), width))
    flat = np.concatenate([np.asarray(v, np.float64) for v in vectors])
    out[np.arange(width) < sizes[:, None]] = np.floor(256.0 * np.clip(flat, -cap, cap)).clip(-cap, cap)
    return out


def score_blocks(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The exact inner products of all rows of ``a`` and ``b``, some rows of ``a`` at a time."""
    top = lambda x: int(np.abs(x).max(initial=0.0))
    moduli = system(max(1, a.shape[1] * top(a) * top(b)))
    columns = [balanced(b, p) for p in moduli]
    step = max(1, CELLS // max(1, len(b)))
    for at in range(0, len(a), step):
        part = a[at : at + step]
        yield at, reconstruct([residue_products(balanced(part, p), c, p) for p, c in zip(moduli, columns)], moduli)


def best(scores: np.ndarray, ids: np.ndarray, unknown: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` of the places ``at``: higher score, then smaller id; a null id is the last."""
    if len(at) > n:
        at = at[scores[at] >= np.partition(scores[at], -n)[-n]]
    return at[np.lexsort((ids[at], unknown[at], -scores[at]))][:n]


ROWS = "anchor long, row long, id long, score long"


def _chosen(anchors: pd.DataFrame, rows: pd.DataFrame, width: int, choose) -> pd.DataFrame:
    """The rows that ``choose(i, scores, best)`` names for every anchor i of a block, with their scores."""
    ids, unknown = rows["vec_id"].fillna(0).to_numpy(np.int64), rows["vec_id"].isna().to_numpy()
    out = []
    for start, block in score_blocks(scaled(anchors["embedding"], width), scaled(rows["embedding"], width)):
        for i, scores in enumerate(block, start):
            at = choose(i, scores, lambda at, n: best(scores, ids, unknown, at, n))
            out.append((np.full(len(at), i), at, scores[at]))
    i, at, scores = (np.concatenate(part) for part in zip(*out))
    return pd.DataFrame(
        {"anchor": anchors["_row"].to_numpy()[i], "row": rows["_row"].to_numpy()[at], "id": rows["vec_id"].astype("Int64").array[at], "score": scores}
    )


def _positives(width: int):
    def of_block(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if anchors.empty or rows.empty:
            return pd.DataFrame(columns=["anchor", "row", "id", "score"])
        own, of_rows = anchors["_row"].to_numpy(), rows["_row"].to_numpy()
        return _chosen(anchors, rows, width, lambda i, scores, best: best(np.flatnonzero(of_rows != own[i]), POSITIVES))

    return of_block


def _negatives(width: int):
    def of_block(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if anchors.empty or rows.empty:
            return pd.DataFrame(columns=["anchor", "row", "id", "score"])
        label, labels = anchors["label"].to_numpy(), rows["label"].to_numpy()
        wanted = list(anchors["scores"])

        def choose(i, scores, best):
            found = []
            for p in np.unique(wanted[i]):
                inside = (100 * scores >= LOW * p) & (100 * scores <= HIGH * p) & (labels != label[i])
                found.append(best(np.flatnonzero(inside), NEGATIVES))
            return np.unique(np.concatenate(found))

        return _chosen(anchors, rows, width, choose)

    return of_block


def usable(vectors: DataFrame) -> DataFrame:
    """(_row, vec_id, embedding, label) of the rows that take part, labels as shifted."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    rows = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite))
    return rows.select(F.monotonically_increasing_id().alias("_row"), "vec_id", "embedding", shifted.cast("long").alias("label"))


def spread(name: str, parts: int) -> Column:
    """A block number that a row gets by the hash of its row number."""
    return F.pmod(F.xxhash64(F.lit(name), "_row"), F.lit(parts)).cast("int")


def dealt(rows: DataFrame, parts: int, name: str) -> DataFrame:
    """One copy of each row per number below ``parts``."""
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))


def first_by_score(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for (vec_id, embedding, label).

    Other columns are ignored. Rows with a null label or vector, or with a null or
    non-finite component, take no part. Anchors are the rows whose vec_id is divisible by
    100. Rows with one id are rows of their own, an anchor's twins included; a null id is
    no anchor and comes last among equal scores. Shorter vectors end in zeros, empty ones
    score 0. A component beyond ``largest_component`` (38 million for 64 components)
    counts as that, so that scores fit a long. No rows give no rows.

    The anchors meet all rows in blocks: a task holds up to ``BLOCK`` anchors and ``SLAB``
    rows and gives the few rows that each anchor may want from the slab.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors), "vectors")
    is_anchor = F.col("vec_id") % 100 == 0
    n, n_anchors, width = rows.agg(F.count(F.lit(1)), F.count_if(is_anchor), F.max(F.size("embedding"))).first()
    # a slab for each task, but none so small that most of its rows are wanted
    slabs = max(1, -(-n // SLAB), min(n // LEAST, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    blocks, width = max(1, -(-n_anchors // BLOCK)), width or 0
    # fresh column names, as both sides of the joins below come from one table
    anchors = rows.where(is_anchor).select(*[F.col(c).alias(c) for c in rows.columns], spread("block", blocks).alias("_block"))
    slabbed = dealt(rows.withColumn("_slab", spread("slab", slabs)), blocks, "_block")

    own = ["label", "_block", "_slab"]
    near = dealt(anchors, slabs, "_slab").groupBy(*own).cogroup(slabbed.groupBy(*own)).applyInPandas(_positives(width), ROWS)
    positives = materialize(first_by_score(near, ["anchor"], POSITIVES), "positives")

    wanted = positives.groupBy(F.col("anchor").alias("_row")).agg(F.collect_list("score").alias("scores"))
    all_labels = ["_block", "_slab"]
    asked = dealt(anchors.join(wanted, "_row"), slabs, "_slab").groupBy(*all_labels)
    found = asked.cogroup(slabbed.groupBy(*all_labels)).applyInPandas(_negatives(width), ROWS)
    pairs = positives.select("anchor", F.col("rank").alias("_place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    scored = found.join(pairs, "anchor")
    inside = (100 * F.col("score")).between(LOW * F.col("positive_score"), HIGH * F.col("positive_score"))
    ranked = first_by_score(scored.where(inside), ["anchor", "_place"], NEGATIVES)
    names = anchors.select(F.col("_row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return ranked.join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
