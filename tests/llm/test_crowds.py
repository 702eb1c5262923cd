"""Crowded regions: many variants of one text, of which only planted pairs are alike enough."""

import random

import numpy as np
import pytest

from plumbline.llm import neardup


def family(members, pairs, changed, seed, length=150):
    """(texts): variants of one text with ``changed`` fresh words each, and a close copy of the first ``pairs``."""
    draw = random.Random(seed)
    core = [f"w{draw.randrange(10**6)}" for _ in range(length)]
    texts = []
    for m in range(members):
        words = list(core)
        for at in draw.sample(range(length), changed):
            words[at] = f"m{m}x{at}"
        texts.append(words)
    for m in range(pairs):
        words = list(texts[m])
        words[draw.randrange(length)] = f"c{m}"
        texts.append(words)
    order = list(range(len(texts)))
    draw.shuffle(order)
    return [" ".join(texts[i]) for i in order]


def by_brute_force(texts, width, percent):
    sets = neardup.shingle_sets([t.encode() for t in texts], width)
    names = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    sizes, root = np.diff(starts), list(range(len(texts)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    mark = np.zeros(names.max() + 1, bool)
    for i in range(len(texts)):
        own = names[starts[i] : starts[i + 1]]
        mark[own] = True
        both = np.add.reduceat(mark[names], starts[:-1], dtype=np.int64)
        mark[own] = False
        for j in np.flatnonzero(100 * both >= percent * (sizes + sizes[i] - both)):
            a, b = top(i), top(int(j))
            root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))]


@pytest.mark.parametrize("members,pairs,changed", [(1200, 600, 8), (300, 150, 5), (300, 150, 14)])
def test_no_link_of_a_crowd_is_lost(spark, members, pairs, changed):
    texts = family(members, pairs, changed, members + changed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, 3, 85).collect()}
    expected = by_brute_force(texts, 3, 85)
    assert len(set(expected)) > members / 2
    assert [got[i] for i in range(len(texts))] == expected


def test_common_shingles_are_worked_on_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "POSTINGS", 5)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    texts = family(120, 60, 5, 9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, 3, 85).collect()}
    assert [got[i] for i in range(len(texts))] == by_brute_force(texts, 3, 85)
