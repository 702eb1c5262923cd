"""The two language models against Kneser-Ney probabilities in plain Python."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import textops, toxicity

WORDS = [f"w{k}" for k in range(40)]


def made(seed, n):
    draw = np.random.default_rng(seed)
    weights = 1 / np.arange(1, len(WORDS) + 1)
    texts = [" ".join(draw.choice(WORDS, draw.integers(0, 30), p=weights / weights.sum())) for _ in range(n)]
    return [(t + " bad phrase" * (k % 2), k % 2) for k, t in enumerate(texts)]


def discounts(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    out, first = {}, n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0
    for k in (1, 2, 3):
        told = first and n[k - 1] and n[k]
        out[k] = min(max(k - (k + 1) * first * n[k] / n[k - 1], 0), k) if told else toxicity.USUAL_DISCOUNTS[k - 1]
    return lambda c: out[min(c, 3)]


def bigrams(text):
    words = text.lower().split()
    return list(zip(["<s>", *words], words))


def plain_model(labelled, corpus, label):
    """P(word | word before) of one class, as a function."""
    pairs, other = (Counter(p for t, y in labelled if y == side for p in set(bigrams(t))) for side in (label, 1 - label))
    both = {v for v, _ in pairs} & {v for v, _ in other}
    before = Counter(w for _, w in pairs)
    vocabulary = {w for t, _ in labelled for w in t.lower().split()}
    known = lambda v: v if v in vocabulary or v == "<s>" else "<unknown>"
    shared = Counter(w for _, w in {(known(v), w) for t in corpus for v, w in bigrams(t)} if w in vocabulary)
    off_word, off_pair = discounts(before.values()), discounts(pairs.values())
    own = {w: (n - off_word(n)) / len(pairs) for w, n in before.items()}
    rest = 1 - sum(own.values())
    kept = {p: n - off_pair(n) for p, n in pairs.items() if n >= toxicity.PAIR_DOCUMENTS and p[0] in both}
    total, mass = defaultdict(float), defaultdict(float)
    for (v, _), n in pairs.items():
        total[v] += n
    for (v, _), n in kept.items():
        mass[v] += n

    def p(v, w):
        low = own.get(w, 0) + rest * (shared[w] / sum(shared.values()) if w in vocabulary else toxicity.SAME)
        return kept.get((v, w), 0) / (total[v] or 1) + (1 - mass[v] / (total[v] or 1)) * low

    return p, vocabulary


def test_scores_equal_plain_kneser_ney(spark):
    labelled = made(1, 120)
    corpus = [t for t, _ in labelled + made(2, 80)] + ["", "new words w1 w2", "other w1 unseen w1", None]
    samples = [(textops.words([t.encode()], textops.OUTSIDE)[0], y) for t, y in labelled]
    models = toxicity.count_classes(samples)
    docs = spark.createDataFrame([(t,) for t in corpus], "text string").repartition(4)
    models.shared = toxicity.continuation_counts(docs, models.words)
    corpus = [t or "" for t in corpus]
    sides = [plain_model(labelled, corpus, y)[0] for y in (0, 1)]
    asked = [t for t, _ in made(3, 40)] + ["", "bad", "bad phrase", "unknown words only", "w1 unknown bad phrase"]
    got = models.log_ratio(*textops.words([t.encode() for t in asked], textops.OUTSIDE))
    for text, ratio in zip(asked, got):
        each = [sides[1](v, w) / sides[0](v, w) for v, w in bigrams(text)]
        assert ratio == pytest.approx(math.log(sum(each) / len(each)) if each else 0.0, abs=1e-9), text
    assert len(models.pairs) > 10 and got[asked.index("bad phrase")] > 1 > abs(got[asked.index("unknown words only")])


def test_each_class_is_a_distribution():
    labelled = made(5, 200)
    texts = [t for t, _ in labelled]
    for label in (0, 1):
        p, vocabulary = plain_model(labelled, texts, label)
        for v in ("<s>", "w0", "bad", "never"):
            assert sum(p(v, w) for w in vocabulary) == pytest.approx(1, abs=1e-9)


def test_no_labels_one_class_and_conflicts(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (None, "a b"), (1, "a b c")], "doc_id long, text string")
    for rows in ([], [(1, 1)], [(1, 0), (1, 1), (None, 0), (2, None)]):
        models = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, label int"))
        out = toxicity.score(docs, models).collect()
        assert len(out) == 4 and all(0 <= r["score"] <= 1 for r in out)
    empty = toxicity.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, label int"))
    assert toxicity.score(docs.limit(0), empty).count() == 0
