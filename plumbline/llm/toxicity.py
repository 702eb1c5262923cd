"""Toxicity by two class-conditional Kneser-Ney models that share their backoff counts.

Both models are interpolated bigram models over case-folded words, with modified Kneser-Ney
discounts from the counts of counts of each level. Bigrams count the labelled documents of
the class that hold them; they back off to the class's continuation counts (distinct words
before a word), and these to one distribution for both classes: the distinct words before
a word in all documents of the corpus. A rare expression thus weighs the same in both.
Bigrams in fewer than ``PAIR_DOCUMENTS`` documents of a class are pruned and leave their
whole mass to the backoff; so do those after a word that only one class has, as the other
has no distribution there to compare. The score of a text weighs two comparisons of its
likelihoods: that per word, and that of its most telling word, so that one or two toxic
words count in a text of any length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import textops
from plumbline.llm.logistic import fit_logistic

#: A bigram of fewer documents of a class is pruned, and a word of fewer in both tells nothing by itself.
PAIR_DOCUMENTS = 4
#: Discounts of counts 1, 2, and 3 and more where the counts of counts are too few to tell.
USUAL_DISCOUNTS = (0.75, 1.25, 1.5)
#: About so many labelled rows per class fit the class counts and the calibration.
PER_CLASS = 3000
#: One in so many of them only calibrates the score.
CALIBRATE = 4
#: Shared probability of a word outside the tables; the same in both models, so its size cancels.
SAME = 1e-9
_PAIR = np.uint64(0x9DDFEA08EB382D69)


def _pairs(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each word (0 before the first of a text), and the hash of both."""
    before = np.zeros_like(hashes)
    before[1:] = hashes[:-1]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    before[first] = 0
    return before, textops.mix(before * _PAIR + hashes)


def _places(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each key in a sorted table, and whether it is there."""
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


@dataclass
class Models:
    """Tables of both classes, sorted by hash; arrays of two columns are (ordinary, toxic).

    The vocabulary are the words of the labelled sample. Any other word has only the shared
    distribution in both models, so that its probability there cancels.
    """

    words: np.ndarray
    own: np.ndarray  # discounted relative frequency of a word
    rest: np.ndarray  # weight of the shared distribution
    contexts: np.ndarray
    back: np.ndarray  # weight of the word model after a context
    pairs: np.ndarray
    pair_own: np.ndarray  # discounted relative frequency of a bigram after its context
    shared: np.ndarray  # distinct words before the word in the whole corpus
    told: np.ndarray  # whether enough documents of a class hold the word for it to tell by itself
    slope: float = 1.0
    peak_slope: float = 0.0
    offset: float = 0.0

    def log_ratio(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Per text: how much likelier the toxic model finds its words, as a mean per word.

        The mean is that of the likelihood ratios, so that a few strong words count in a
        long text. Nothing is taken off that comes from the text itself: a text of toxic
        words only, or of one toxic phrase many times, keeps their whole ratio. A text
        without words gets 0, as both models find it equally likely.
        """
        return self.evidence(hashes, bounds)[0]

    def evidence(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text: ``log_ratio``, and the largest log ratio of one of its words by itself.

        The second has neither bigrams nor words of few documents in it, and is 0 at least.
        """
        before, keys = _pairs(hashes, bounds)
        at, known = _places(self.words, hashes)
        p = np.tile(self.rest * SAME, (len(hashes), 1))
        where = np.flatnonzero(known)
        share = np.maximum(self.shared, 0.5) / max(self.shared.sum(), 1)
        words = self.own + self.rest * share[:, None]
        p[where] = words[at[where]]
        single = np.zeros(len(hashes))
        single[where] = np.where(self.told, np.log(words[:, 1]) - np.log(words[:, 0]), 0.0)[at[where]]
        at, seen = _places(self.contexts, before)
        where = np.flatnonzero(seen)
        p[where] *= self.back[at[where]]
        at, hit = _places(self.pairs, keys)
        where = np.flatnonzero(hit)
        p[where] += self.pair_own[at[where]]
        ratio = np.log(p[:, 1]) - np.log(p[:, 0])
        counts = np.diff(bounds)
        mean = textops.sums_by_text(np.exp(np.clip(ratio, -60, 60)), bounds) / np.maximum(counts, 1)
        peak = np.zeros(len(counts))
        filled = np.flatnonzero(counts)
        if len(filled):
            peak[filled] = np.maximum(np.maximum.reduceat(single, bounds[filled]), 0.0)
        return np.where(counts > 0, np.log(np.maximum(mean, 1e-12)), 0.0), peak

    def score(self, ratio: np.ndarray, peak: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * ratio + self.peak_slope * peak + self.offset, -35, 35)))


def discounted(counts: np.ndarray) -> np.ndarray:
    """Counts less their modified Kneser-Ney discounts, which differ for 1, 2, and 3 and more."""
    of = np.bincount(np.minimum(counts, 5), minlength=6)[1:5]
    first = of[0] / (of[0] + 2 * of[1]) if of[0] and of[1] else 0.0
    steps = [0.0]
    for k in (1, 2, 3):
        told = first and of[k - 1] and of[k]
        steps.append(float(np.clip(k - (k + 1) * first * of[k] / of[k - 1], 0, k)) if told else USUAL_DISCOUNTS[k - 1])
    return counts - np.array(steps)[np.minimum(counts, 3)]


def _document_pairs(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bigrams: hash, documents that hold it, the word before, the word."""
    parts = [(np.zeros(0, np.uint64),) * 3]
    for hashes in texts:
        before, keys = _pairs(hashes, np.array([0, len(hashes)]))
        keys, at = np.unique(keys, return_index=True)
        parts.append((keys, before[at], hashes[at]))
    keys, before, words = (np.concatenate(column) for column in zip(*parts))
    keys, at, n = np.unique(keys, return_index=True, return_counts=True)
    return keys, n, before[at], words[at]


def count_classes(samples: list[tuple[np.ndarray, int]]) -> Models:
    """Both models from word hashes with their label; the shared counts are still missing."""
    sides = [_document_pairs([h for h, y in samples if y == label]) for label in (0, 1)]
    words = np.unique(np.concatenate([s[3] for s in sides]))
    own = np.zeros((len(words), 2))
    for c, (_, _, _, word) in enumerate(sides):
        own[:, c] = discounted(np.bincount(np.searchsorted(words, word), minlength=len(words))) / max(len(word), 1)
    rest = np.maximum(1 - own.sum(0), 1e-6)
    told = np.zeros(len(words), bool)
    for label in (0, 1):
        held_by = [np.unique(h) for h, y in samples if y == label]
        told |= np.bincount(np.searchsorted(words, np.concatenate([words[:0], *held_by])), minlength=len(words)) >= PAIR_DOCUMENTS

    both = np.intersect1d(sides[0][2], sides[1][2])
    held = [(n >= PAIR_DOCUMENTS) & np.isin(before, both) for _, n, before, _ in sides]
    pairs = np.unique(np.concatenate([s[0][h] for s, h in zip(sides, held)]))
    contexts = np.unique(np.concatenate([s[2][h] for s, h in zip(sides, held)]))
    pair_own = np.zeros((len(pairs), 2))
    back = np.ones((len(contexts), 2))
    for c, ((keys, n, before, _), kept) in enumerate(zip(sides, held)):
        at, hit = _places(contexts, before)
        seen = np.maximum(np.bincount(at[hit], n[hit], len(contexts)), 1)
        at = np.searchsorted(contexts, before[kept])
        part = discounted(n)[kept] / seen[at]
        pair_own[np.searchsorted(pairs, keys[kept]), c] = part
        back[:, c] -= np.bincount(at, part, len(contexts))
    return Models(words, own, rest, contexts, back, pairs, pair_own, np.zeros(len(words)), told)


def _word_bytes(batches):
    for part, texts in textops.pieces(batches):
        hashes, bounds = textops.words(texts, textops.OUTSIDE)
        rows = [hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(rows, pa.binary())], names=["label", "words"])


def continuation_counts(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Distinct words before each word of the vocabulary, in all documents.

    All words outside the vocabulary count as one, and so does the start of a text. A row is
    one number, made of the places of both words; equal bigrams of a task meet before the
    shuffle. The vocabulary is bounded by the sample of the classifier.
    """
    table = docs.sparkSession.sparkContext.broadcast(vocabulary)
    size = max(len(vocabulary), 1)

    def bigrams(batches):
        known = table.value
        for _, texts in textops.pieces(batches):
            hashes, bounds = textops.words(texts, textops.OUTSIDE)
            at, hit = _places(known, hashes)
            before = np.full(len(hashes), size, np.int64)
            before[1:][hit[:-1]] = at[:-1][hit[:-1]]
            before[bounds[:-1][bounds[:-1] < bounds[1:]]] = size + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.unique((before * size + at)[hit]), pa.int64())], names=["bigram"])

    found = docs.select("text").mapInArrow(bigrams, "bigram long").distinct()
    rows = found.groupBy((F.col("bigram") % size).alias("word")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    out = np.zeros(len(vocabulary))
    out[rows["word"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Models:
    """Fit both models and the calibration.

    ``labels`` has (doc_id, label) with 0 or 1; other labels and null ids are ignored, and an
    id with both labels is toxic.
    The class counts come from about ``per_class`` labelled documents a class, the shared
    counts from all documents. Without any labelled document every score is the same.
    """
    usable = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("int").alias("label"))
    usable = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = textops.bounded_sample(usable, "label", per_class)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("label", "text")
    rows = texts.mapInArrow(_word_bytes, "label int, words binary").toPandas()
    samples = [(np.frombuffer(w, np.uint64), int(y)) for y, w in zip(rows["label"], rows["words"])]
    order = np.random.default_rng(1).permutation(len(samples))
    # the collected order depends on the partitioning, so a fixed order comes first
    samples = sorted(samples, key=lambda s: (s[1], len(s[0]), s[0].tobytes()))
    samples = [samples[i] for i in order]
    checked, counted = samples[:: CALIBRATE], [s for i, s in enumerate(samples) if i % CALIBRATE]
    models = count_classes(counted)
    models.shared = continuation_counts(docs, models.words)
    if checked:
        bounds = np.concatenate([[0], np.cumsum([len(h) for h, _ in checked])]).astype(np.int64)
        evidence = np.stack(models.evidence(np.concatenate([h for h, _ in checked]), bounds), 1)
        y = np.array([y for _, y in checked])
        seen = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        weight = np.array([seen.get(int(v), 1) / max(1, (y == v).sum()) for v in y])
        (models.slope, models.peak_slope), models.offset = fit_logistic(evidence, y, weight)
    return models


def score(docs: DataFrame, models: Models) -> DataFrame:
    """Add ``score`` (0 to 1) and ``log_ratio`` to (doc_id, text, ...); all columns stay.

    Whole texts are scored. A null or empty text, and one without words, scores as a text
    whose two likelihoods are equal. Rows with one doc_id are scored each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)
    extra = "score double, log_ratio double"
    columns = [c for c in docs.columns if c not in ("score", "log_ratio")]
    kept = docs.select(*columns)

    def run(batches):
        for part, texts in textops.pieces(batches):
            ratio, peak = shared.value.evidence(*textops.words(texts, textops.OUTSIDE))
            arrays = [part.column(c) for c in columns] + [pa.array(shared.value.score(ratio, peak)), pa.array(ratio)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "score", "log_ratio"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [extra])
    return kept.mapInArrow(run, schema)
