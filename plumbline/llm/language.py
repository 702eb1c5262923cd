"""Language of a text from averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its subwords (hashed 1- to 4-byte windows over
case-folded letters, other ASCII characters count as space) and whole words. Embeddings
and softmax are trained together by stochastic gradient descent in numpy. A temperature
and a rejection threshold are calibrated on texts that the training did not see.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import textops

BITS = 15
DIMENSIONS = 16
GRAMS = (1, 2, 3, 4)
#: About so many rows per language train the model and its calibration.
PER_LANGUAGE = 1000
CALIBRATE = 5
EPOCHS = 6
RATE = 0.15
#: Bound of each parameter, so that no step diverges.
LARGEST = 10.0
#: Share of wrong answers that the accepted calibration texts may hold.
ERROR = 0.01
UNKNOWN = "und"

_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_ONLY_LETTERS = np.arange(256, dtype=np.uint8)
_ONLY_LETTERS[:128] = 32
_ONLY_LETTERS[97:123] = np.arange(97, 123)
_ONLY_LETTERS[65:91] = np.arange(97, 123)


def has_letter(text: bytes) -> bool:
    """Whether the text holds a letter of any script."""
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))


def histograms(texts: list[bytes]):
    """Yield the subword counts (a dense array by bucket) of each text."""
    codes, offsets = textops.joined(texts)
    codes = _ONLY_LETTERS[codes]
    sums = textops.prefix(codes)
    shift = np.uint64(64 - BITS)
    grams = [(textops.windows(sums, k) >> shift).astype(np.int32) for k in GRAMS]
    off = codes == 32
    change = np.flatnonzero(off[1:] != off[:-1]) + 1
    if not off[0]:
        change = np.concatenate([[0], change])
    starts, ends = change[0::2], change[1::2]
    words = (textops.spans(sums, starts, ends) >> shift).astype(np.int32)
    first = np.searchsorted(starts, offsets)
    for i in range(len(texts)):
        lo, hi = offsets[i], offsets[i + 1] - 1
        parts = [g[lo : max(lo, hi - k + 1)] for k, g in zip(GRAMS, grams)]
        yield np.bincount(np.concatenate([*parts, words[first[i] : first[i + 1]]]), minlength=1 << BITS)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # embedding times softmax weights, by bucket and language
    bias: np.ndarray
    scale: float = 1.0
    threshold: float = 0.0

    def probabilities(self, histogram: np.ndarray) -> np.ndarray:
        return softmax(self.scale * (histogram @ self.table / max(1, histogram.sum()) + self.bias))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_languages: int, epochs: int = EPOCHS, rate: float = RATE):
    """Embeddings and softmax weights from (buckets, counts) per text, by plain SGD with a falling rate."""
    draw = np.random.default_rng(5)
    embedding = draw.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BITS, DIMENSIONS))
    weights, bias = np.zeros((DIMENSIONS, n_languages)), np.zeros(n_languages)
    shares = [c / max(1, c.sum()) for _, c in rows]
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            step = rate * (1 - done / steps)
            done += 1
            bucket = rows[i][0]
            x = shares[i] @ embedding[bucket]
            error = softmax(x @ weights + bias)
            error[y[i]] -= 1
            back = weights @ error
            weights = np.clip(weights - step * 10 * np.outer(x, error), -LARGEST, LARGEST)
            bias -= step * 0.1 * error
            embedding[bucket] = np.clip(embedding[bucket] - step * 100 * shares[i][:, None] * back[None, :], -LARGEST, LARGEST)
    return embedding, weights, bias


def _sample_rows(batches):
    for part, texts in textops.pieces(batches):
        out = []
        for h in histograms(texts):
            bucket = np.flatnonzero(h)
            out.append(np.stack([bucket, h[bucket]]).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(out, pa.binary())], names=["lang", "counts"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on the rows of ``docs`` (doc_id, text, lang) with a language, on a bounded sample per language.

    Rows without a language or id are ignored; without any row the model has no language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang")
    ids = textops.bounded_sample(known, "lang", per_language).select("doc_id").distinct()
    sample = docs.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id")
    found = sample.select("lang", "text").mapInArrow(_sample_rows, "lang string, counts binary").toPandas()
    languages = sorted(set(found["lang"]))
    if not languages:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0))
    rows = [(languages.index(v), np.frombuffer(b, np.int32).reshape(2, -1)) for v, b in zip(found["lang"], found["counts"])]
    rows = sorted((r for r in rows if r[1].size), key=lambda r: (r[0], r[1].shape[1], r[1].tobytes()))
    rows = [rows[i] for i in np.random.default_rng(1).permutation(len(rows))]
    fitted, checked = [r for i, r in enumerate(rows) if i % CALIBRATE], rows[::CALIBRATE]
    embedding, weights, bias = train([(r[1][0], r[1][1]) for r in fitted], np.array([r[0] for r in fitted], int), len(languages))
    model = Model(languages, embedding @ weights, bias)
    if checked and len(languages) > 1:
        logits = np.stack([r[1][1] @ model.table[r[1][0]] / r[1][1].sum() + bias for r in checked])
        truth = np.array([r[0] for r in checked])
        loss = lambda s: -np.log(np.maximum(softmax(s * logits)[np.arange(len(truth)), truth], 1e-12)).mean()
        model.scale = float(min(np.geomspace(0.1, 2, 41), key=loss))
        p = softmax(model.scale * logits)
        best, right = p.max(1), p.argmax(1) == truth
        order = np.argsort(-best)
        wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
        allowed = np.flatnonzero(wrong <= ERROR)
        model.threshold = float(best[order][allowed[-1]]) if len(allowed) else 1.0
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``accepted`` to (doc_id, text, ...); all columns stay.

    Whole texts are read. A text that is null or has no letter is ``und`` with score 0 and
    not accepted, and so is every text when the model knows no language. Texts whose score
    is under the calibrated threshold keep their likeliest language but are not accepted.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = ["lang_pred", "score", "accepted"]
    columns = [c for c in docs.columns if c not in new]
    kept = docs.select(*columns)

    def run(batches):
        model = shared.value
        for part, texts in textops.pieces(batches):
            names, scores = [], []
            for text, h in zip(texts, histograms(texts)):
                if not model.languages or not has_letter(text):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = model.probabilities(h)
                best = int(p.argmax())
                names.append(model.languages[best])
                scores.append(float(p[best]))
            accepted = [n != UNKNOWN and s >= model.threshold for n, s in zip(names, scores)]
            arrays = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], *arrays], names=[*columns, *new])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["lang_pred string, score double, accepted boolean"]
    return kept.mapInArrow(run, ", ".join(schema))
