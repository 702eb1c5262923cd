"""Short, dense and repetitive toxic texts keep what their words weigh."""

import numpy as np
import pyarrow.parquet as pq

from plumbline.llm import textops, toxicity

PLAIN = "the river runs past our town and many boats lie there".split()
TOXIC = ["vileword", "nastyword"]


def _models():
    draw = np.random.default_rng(4)
    samples = []
    for n in range(200):
        text = [PLAIN[k] for k in draw.integers(0, len(PLAIN), 30)]
        if n % 2:
            text[7], text[19] = TOXIC
        samples.append((textops.words([" ".join(text).encode()], textops.OUTSIDE)[0], n % 2))
    models = toxicity.count_classes(samples)
    words = [h for s, _ in samples for h in set(s.tolist())]
    models.shared = np.array([words.count(int(w)) for w in models.words], float)
    return models


def test_toxic_words_are_not_cancelled_by_their_own_text():
    one, two, long = "vileword", "vileword river", "vileword nastyword " * 500
    texts = ["", "river", "the river runs past", one, f"river {one}", two, "nastyword vileword", long, " ".join(PLAIN * 9)]
    empty, word, phrase, *toxic, plain = _models().log_ratio(*textops.words([t.encode() for t in texts], textops.OUTSIDE))
    assert empty == 0 and max(abs(word), abs(phrase), abs(plain)) < 0.5
    assert min(toxic) > 1.5
    assert max(toxic) - min(toxic) < 3


def test_two_toxic_words_of_many_forms_count_in_long_texts(spark):
    draw = np.random.default_rng(6)
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()[:4000]
    forms = [f"vile{k}" for k in range(60)]
    docs, labels = [], []
    for n, text in enumerate(texts):
        words, toxic = (text or "").split(), n % 5 == 0
        for form in draw.choice(forms, 2 * toxic):
            words.insert(int(draw.integers(0, len(words) + 1)), str(form))
        docs.append((n, " ".join(words)))
        labels.append((n, int(toxic)))
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    learned = spark.createDataFrame([r for r in labels if r[0] % 4], "doc_id long, label int")
    got = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.score(docs, toxicity.fit(docs, learned)).collect()}
    held = [(y, got[n]) for n, y in labels if n % 4 == 0]
    caught, wrong = (np.mean([hit for y, hit in held if y == label]) for label in (1, 0))
    assert caught >= 0.9 and wrong <= 0.03, (caught, wrong)
