"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by naive Bayes.

A text is the set of its hashed n-grams: of characters (1 to 4 bytes) and of word shapes (1
to 3 words; the shape tells case, punctuation, length and whether the word repeats the one
before). An indicator is scaled by the log ratio of its class counts, which come from all
labelled rows; the linear model is fitted by dual coordinate descent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import textops
from plumbline.llm.logistic import fit_logistic

BITS = 16
#: About so many labelled rows per class fit the linear model and its calibration.
PER_CLASS = 1500
#: One in so many of them only calibrates the score.
CALIBRATE = 4
EPOCHS = 20
COST = 0.05
SMOOTH = 1.0
CHARACTERS = (1, 2, 3, 4)
SHAPES = (1, 2, 3)


def _shapes(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A small code for the shape of each word, with the first word of each text."""
    off = textops.WHITE[codes]
    change = np.flatnonzero(off[1:] != off[:-1]) + 1
    if not off[0]:
        change = np.concatenate([[0], change])
    starts, ends = change[0::2], change[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    hashes = textops.spans(textops.prefix(codes, textops.FOLDED), starts, ends)
    count = lambda mask: np.add.reduceat(mask[: ends[-1]].astype(np.int32), starts) if len(starts) else starts
    letters = ((codes >= 97) & (codes <= 122)) | (codes >= 128)
    upper = (codes >= 65) & (codes <= 90)
    digits = (codes >= 48) & (codes <= 57)
    low, high, number = count(letters), count(upper), count(digits)
    size = ends - starts
    other = size - low - high - number
    same = np.zeros(len(starts), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    first = np.searchsorted(starts, offsets)
    same[first[:-1][first[:-1] < first[1:]]] = False
    shape = np.where(high > low, 2, np.where(high > 0, 1, 0)) + 3 * np.minimum(other, 3) + 12 * (number > 0) + 24 * np.minimum(size // 6, 3) + 96 * same
    return shape.astype(np.uint64), first


def features(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct bucket numbers of each text."""
    codes, offsets = textops.joined(texts)
    sums = textops.prefix(codes)
    shift = np.uint64(64 - BITS)
    grams = [(textops.windows(sums, k) >> shift).astype(np.int32) for k in CHARACTERS]
    shape, first = _shapes(codes, offsets)
    rows = [(textops.mix(shape + np.uint64(977)) >> shift).astype(np.int32)]
    joint = shape
    for k in SHAPES[1:]:
        joint = joint[:-1] * np.uint64(1009) + shape[k - 1 :] if len(shape) >= k else joint[:0]
        rows.append((textops.mix(joint + np.uint64(977 * k)) >> shift).astype(np.int32))
    out = []
    mark = np.zeros(1 << BITS, bool)
    for i in range(len(texts)):
        lo, hi = offsets[i], offsets[i + 1] - 1
        mark[:] = False
        for k, g in zip(CHARACTERS, grams):
            mark[g[lo : max(lo, hi - k + 1)]] = True
        for k, g in zip(SHAPES, rows):
            mark[g[first[i] : max(first[i], first[i + 1] - k + 1)]] = True
        out.append(np.flatnonzero(mark).astype(np.int32))
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() / np.sqrt(max(1, len(r))) + self.bias for r in rows])

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -35, 35)))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights of the hinge-loss model over scaled indicators, by dual coordinate descent.

    Rows are scaled to the length of their indicators, ``cost`` bounds each row's dual
    variable, and a constant feature stands for the bias.
    """
    w, bias = np.zeros(len(ratio)), 0.0
    values = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    square = np.array([v @ v + 1 for v in values])
    alpha = np.zeros(len(rows))
    draw = np.random.default_rng(7)
    for _ in range(epochs):
        largest = 0.0
        for i in draw.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-4:
            break
    return w * ratio, bias


def _labelled_features(batches):
    for part, texts in textops.pieces(batches):
        rows = [r.tobytes() for r in features(texts)]
        yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(rows, pa.binary())], names=["label", "buckets"])


def _bucket_counts(batches):
    counts, rows = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for part, texts in textops.pieces(batches):
        for label, found in zip(part.column("label").to_pylist(), features(texts)):
            counts[label, found] += 1
            rows[label] += 1
    for label in (0, 1):
        if rows[label]:
            bucket = np.concatenate([[-1], np.flatnonzero(counts[label])])
            n = np.concatenate([[rows[label]], counts[label][bucket[1:]]])
            label_column = pa.array(np.full(len(bucket), label, np.int32))
            yield pa.RecordBatch.from_arrays([label_column, pa.array(bucket.astype(np.int32)), pa.array(n)], names=["label", "bucket", "n"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit the model on ``labels`` (doc_id, label): counts from all of them, weights from a bounded sample.

    Labels other than 0 and 1 and null ids are ignored. Without labels of both classes
    every score is the same.
    """
    usable = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("int").alias("label"))
    usable = usable.dropDuplicates(["doc_id"])
    texts = docs.select("doc_id", "text")
    # labels grow with the corpus: the join is by key at every size, never by a copy of the labels in each task
    counted = texts.join(usable.hint("merge"), "doc_id").select("label", "text").mapInArrow(_bucket_counts, "label int, bucket int, n long")
    table = counted.groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts, total = np.zeros((2, 1 << BITS)), np.zeros(2)
    for label in (0, 1):
        part = table[table["label"] == label]
        bucket, n = part["bucket"].to_numpy(np.int64), part["n"].to_numpy(float)
        total[label] = n[bucket < 0].sum()
        counts[label, bucket[bucket >= 0]] = n[bucket >= 0]
    share = (counts + SMOOTH) / (total[:, None] + 2 * SMOOTH)
    ratio = np.log(share[1]) - np.log(share[0])
    ids = F.broadcast(textops.bounded_sample(usable, "label", per_class))
    sample = texts.join(ids, "doc_id").select("label", "text").mapInArrow(_labelled_features, "label int, buckets binary").toPandas()
    rows = [(int(y), np.frombuffer(b, np.int32)) for y, b in zip(sample["label"], sample["buckets"])]
    rows = sorted(rows, key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    rows = [rows[i] for i in np.random.default_rng(1).permutation(len(rows))]
    fitted, checked = [r for i, r in enumerate(rows) if i % CALIBRATE], rows[::CALIBRATE]
    y = np.array([1.0 if r[0] else -1.0 for r in fitted])
    if not len(y) or y.min() == y.max():
        slope, offset = fit_logistic(np.zeros(len(y)), (y > 0).astype(float))
        return Model(np.zeros(1 << BITS), 0.0, slope, offset)
    cost = COST * len(y) / 2 / np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    model = Model(*dual_descent([r for _, r in fitted], y, ratio, cost))
    margin, truth = model.margin([r for _, r in checked]), np.array([r[0] for r in checked])
    weight = np.array([total[v] / max(1, (truth == v).sum()) for v in truth])
    model.slope, model.offset = fit_logistic(margin, truth, weight)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 likelier) to (doc_id, text, ...); all columns stay.

    Whole texts are scored. A null text counts as empty; an empty text has no n-grams and
    gets the score of the bias alone. Rows with one doc_id are scored each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c != "score"]
    kept = docs.select(*columns)

    def run(batches):
        for part, texts in textops.pieces(batches):
            found = shared.value.score(shared.value.margin(features(texts)))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(found, pa.float64())], names=[*columns, "score"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["score double"])
    return kept.mapInArrow(run, schema)
