"""Adaptive rules, the manifest and hard negatives against plain Python, with their edge cases."""

import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
import pytest

from plumbline.llm import manifest, negatives, rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _group string, _key string, n long, kept boolean, root string, _row long"
LONG = " ".join(f"word{i % 977} and {i}." for i in range(20000)) + "\n\nsame line\nsame line\n"
TEXTS = [
    None, "", " \n\t ", "word", "word", "Tëxt ünd mehr Text, äöü! \U0001f600 #|<", LONG, LONG + "a b c d e f g h\n" * 3,
    "one two three four five six seven eight nine one two three four five six seven eight", "a\nb\na\n b\n\n\nb",
]


def table(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 6) for r in rows], SCHEMA).repartition(3)


# ---- rules ----


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_counts_of_whole_texts():
    draw = random.Random(3)
    more = ["".join(draw.choice("ab \n# é") for _ in range(draw.randrange(400))) for _ in range(200)]
    more += [" ".join(draw.choice("ab") for _ in range(n)) for n in range(60)]
    for text in [*TEXTS, *more]:
        assert rules.measure(text or "")[:5] == plain_counts(text)


def test_every_document_is_judged(spark):
    docs = table(spark, [(i if i else None, t, "en" if i % 2 else None, None if i == 3 else "s", 7) for i, t in enumerate(TEXTS)])
    found = {r["doc_id"]: r for r in rules.quality_rules(docs).collect()}
    assert set(found) == {None, *range(1, len(TEXTS))}
    for i, t in enumerate(TEXTS):
        r, counts = found[i or None], plain_counts(t)
        assert tuple(r[c] for c in rules.COUNTS[:5]) == counts
        assert r["base_failed"] == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert not (r["base_failed"] and r["kept"])
    assert rules.quality_rules(docs.where("doc_id > 99")).collect() == []


def test_fences_follow_language_and_source(spark):
    """What is usual in one source fails in another; a small source takes the fences of its language."""
    draw = random.Random(5)
    def text(size, symbols):
        return " ".join("x" * max(1, size + draw.randrange(-1, 2)) + ("#" if draw.random() < symbols else "") + str(i) for i in range(60))
    rows = [(i, text(5, 0.0), "en", "prose", 0) for i in range(400)] + [(1000 + i, text(5, 0.9), "en", "code", 0) for i in range(400)]
    rows += [(2000 + i, text(20, 0.0), "de", "prose", 0) for i in range(400)] + [(3000, text(20, 0.0), "de", "few", 0)]
    rows += [(9001, text(5, 0.9), "en", "prose", 0), (9002, text(20, 0.0), "en", "prose", 0), (9003, text(5, 0.0), "de", "few", 0)]
    kept = {r["doc_id"]: r["kept"] for r in rules.quality_rules(table(spark, rows)).collect()}
    assert [i for i, k in kept.items() if not k] and sorted(i for i, k in kept.items() if not k) == [9001, 9002, 9003]


def test_sketches_merge_and_hold_quantiles(spark):
    draw = np.random.default_rng(2)
    values = [0.0] * 50 + list(np.exp(draw.normal(0, 2, 2000)))
    rows = spark.createDataFrame([(i % 3, float(v)) for i, v in enumerate(values)], "k int, mean_word double")
    whole = {(r["bucket"], r["n"]) for r in rules.sketch(rows, [], ["mean_word"]).collect()}
    merged = {(r["bucket"], r["n"]) for r in rules.merge(rules.sketch(rows, ["k"], ["mean_word"]), []).collect()}
    assert whole == merged
    got = rules.fences(rules.sketch(rows.selectExpr("1 as k", "mean_word"), ["k"], ["mean_word"]), ["k"]).first()
    a, b = (sorted(values)[math.ceil(q * len(values)) - 1] for q in (0.25, 0.75))
    spread = rules.SPREADS * max(b - a, 0.5)
    assert got["n"] == len(values)
    assert abs(got["mean_word_high"] - (b + spread)) < 0.02 * (b + spread) and abs(got["mean_word_low"] - (a - spread)) < 0.02 * (b + spread)


# ---- manifest ----


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """Root, and the runs on the way up of every leaf."""
    paths, level = [[] for _ in nodes], nodes
    where = list(range(len(nodes)))
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for i, w in enumerate(where):
            paths[i].append((runs[w // 3], w % 3))
            where[i] = w // 3
        level = [H(*run) for run in runs]
    return level[0], paths


def plain_manifest(rows):
    leaf = lambda r, text: H(*map(field, (r[0], r[3], r[2], r[4], text)))
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    lower = {}
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        lower[s] = plain_tree([leaf(r, r[1]) for r in sources[s]])
    root, top = plain_tree([lower[s][0] for s in order])
    out = []
    for i, s in enumerate(order):
        for r, path in zip(sources[s], lower[s][1]):
            even = r[0] is not None and crc32(str(r[0]).encode()) % 2 == 0
            at, siblings = leaf(r, r[1].replace("\n", "") if even and r[1] else r[1]), []
            for run, k in path + top[i]:
                siblings += run[:k] + run[k + 1 :]
                at = H(*run[:k], at, *run[k + 1 :])
            out.append((r[0], leaf(r, r[1]), lower[s][0], root, H(*siblings), at, at == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", [1, 2, 8])
def test_manifest_is_the_tree(spark, height, monkeypatch):
    """Blocks of 3, 9 and 6,561 leaves give the same tree; small ones take several rounds."""
    appended = manifest.appended
    monkeypatch.setattr(manifest, "appended", lambda rows, h=height: appended(rows, h))
    sizes = {"a": 1, "b": 2, "c": 3, "é": 28, "z": 10, None: 4, "": 31}
    rows, i = [], 0
    for source, n in sizes.items():
        for k in range(n):
            rows.append((i, TEXTS[i % len(TEXTS)], "en" if i % 4 else None, source, None if i % 5 == 0 else i))
            i += 1
    rows += [(None, "x\ny", "en", "a", 1), (None, "x\ny", "en", "a", 1), (3, None, None, "b", 2), (4, "a\n", "de", "c", 1)]
    got = sorted((tuple(r) for r in manifest.verify_tampered(table(spark, rows)).collect()), key=str)
    assert got == plain_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):
    one = manifest.verify_tampered(table(spark, [(7, None, None, None, None)])).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] and one[0]["verified"]
    assert one[0]["proof_sha256"] == sha256(b"").hexdigest()
    assert manifest.verify_tampered(table(spark, [])).collect() == []


def test_witness_of_an_open_tree():
    """Witnesses grow with later siblings and are whole once the tree is finished."""
    for n in range(1, 40):
        tree, nodes = manifest.Appender(), [manifest.Node(H(str(i))) for i in range(n)]
        for node in nodes:
            tree.append(node)
        root, height = tree.finish()
        expected, paths = plain_tree([x.digest for x in nodes])
        assert root == expected and all(len(p) == height for p in paths)
        for node, path in zip(nodes, paths):
            assert [(x["left"], x["right"]) for x in manifest.witness(node)] == [("".join(r[:k]), "".join(r[k + 1 :])) for r, k in path]


# ---- hard negatives ----


def plain_negatives(rows):
    clean = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        clean.append((i, [math.floor(256 * float(x)) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    width = max([len(v) for _, v, _ in clean], default=0)
    padded = [(i, v + [0] * (width - len(v)), label) for i, v, label in clean]
    out = []
    for a, (i, v, label) in enumerate(padded):
        if i is None or i % 100:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), j is None, j or 0, other == label) for b, (j, w, other) in enumerate(padded) if b != a]
        for s, none, j, _ in sorted(x for x in scores if x[3])[:5]:
            found = sorted(x for x in scores if not x[3] and -30 * s <= -100 * x[0] <= -90 * s)[:10]
            out += [(i, None if none else j, k, None if x[1] else x[2], -s, -x[0]) for k, x in enumerate(found, 1)]
    return sorted(out, key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<float>, label int, anchor int, score int, _row string").repartition(4)


@pytest.mark.parametrize("width", [3, 64, 200])
def test_negatives_equal_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 3)
    monkeypatch.setattr(negatives, "LEAST", 20)
    monkeypatch.setattr(negatives, "CELLS", 50)
    draw = np.random.default_rng(width)
    centres = draw.normal(size=(5, width))
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(int(i) * 20, f32(centres[i % 5] + draw.normal(size=width)), int(i % 4)) for i in range(150)]
    rows += [(100, rows[0][1], 0), (100, rows[0][1], 0), (None, rows[1][1], 1), (None, rows[2][1], 2), (5, None, 1), (7, rows[3][1], None), (300, [], 3)]
    rows += [(11, [None, *rows[0][1][1:]], 1), (13, [float("nan"), 1.0], 1), (15, [float("inf")], 1), (17, rows[0][1][:2], 2), (200, [0.0] * width, 1)]
    rows += [(40001 + i, rows[4][1], i % 2) for i in range(60)]  # one very common vector
    got = sorted((tuple(r) for r in negatives.hard_negatives(vectors(spark, rows)).collect()), key=str)
    assert got == plain_negatives(rows) and len(got) > 100


def test_negatives_of_nothing(spark):
    assert negatives.hard_negatives(vectors(spark, [])).collect() == []
    assert negatives.hard_negatives(vectors(spark, [(100, [1.0], 1)])).collect() == []
    assert negatives.hard_negatives(vectors(spark, [(1, [1.0], 1), (3, [], 2)])).collect() == []


def test_residues_give_exact_scores():
    draw = np.random.default_rng(1)
    for width, size in ((1, 1), (64, 300), (65, 1 << 20), (130, negatives.largest_component(130))):
        a, b = (draw.integers(-size, size, (5, width), endpoint=True) for _ in range(2))
        a[0], b[0], b[1] = size, size, -size
        exact = a.astype(object) @ b.astype(object).T
        got = np.concatenate([s for _, s in negatives.score_blocks(a.astype(float), b.astype(float))])
        assert (got == exact).all() and abs(exact).max() * 100 < 1 << 63


def test_long_components_are_bounded():
    out = negatives.scaled(pd.Series([np.array([3e38, -3e38, 0.5])]), 64)
    assert out[0, 0] == negatives.largest_component(64) == -out[0, 1] and out[0, 2] == 128
