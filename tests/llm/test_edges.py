"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib

import numpy as np
import pytest

from plumbline.llm import decontaminate, dedup, extract, language, merkle, mixing, neardup, quality, secrets, toxicity

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, score double, label int, kept boolean,"
    " route long, ranges string, blob string, spans string, tree int, rep long, component long, target double, positions string"
)
LONG = " ".join(f"word{i % 977} and {i}." for i in range(20000))
TEXTS = [
    (None, None), (None, "no id"), (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "word"), (5, "word"),
    (6, "Tëxt ünd mehr, mit Umlauten: äöü! \U0001f600"), (7, LONG), (8, LONG + " end"), (9, "\x00 odd \x01 bytes"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if n % 2 else None, None if n == 3 else f"s{n % 2}", 7, *[None] * 13) for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 0), (5, 1), (5, 1), (6, 0), (7, 1), (None, 1), (99, 0), (3, 7)], "doc_id long, label int")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def complete(rows):
    return sum(map(len, rows.values())) == len(TEXTS) and set(rows) == {i for i, _ in TEXTS}


def test_dedup(docs):
    rows = by_id(dedup.remove_repeats(docs))
    assert complete(rows)
    assert rows[1][0]["n_bytes"] == 0 and rows[2][0]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[8][0]["n_removed"] == len(LONG) and rows[8][0]["kept"] == b" end" and rows[7][0]["n_removed"] == 0
    assert all(r["n_removed"] == 0 for r in rows[5])


def test_quality(docs, labels):
    rows = by_id(quality.score(docs, quality.fit(docs, labels)))
    assert complete(rows) and all(0 <= r["score"] <= 1 for part in rows.values() for r in part)


def test_quality_without_labels(docs, labels):
    scores = {r["score"] for r in quality.score(docs, quality.fit(docs, labels.where("label > 9"))).collect()}
    assert len(scores) == 1


def test_merkle(docs):
    rows = by_id(merkle.compare_edits(docs))
    assert complete(rows)
    assert rows[1][0]["fingerprint"] == rows[2][0]["fingerprint"] and rows[1][0]["n_chars"] == 0
    assert rows[4][0]["fingerprint"] == rows[5][0]["fingerprint"] != rows[6][0]["fingerprint"]
    # the document after 4 is 3, so a third of four letters gives way to its first character
    assert rows[4][0]["edited_sha256"] == hashlib.sha256(b"wor ").hexdigest()


def test_secrets(docs):
    rows = by_id(secrets.scan(docs))
    assert complete(rows) and all(r["spans"] is None for part in rows.values() for r in part)


def test_language(docs):
    rows = by_id(language.predict(docs, language.fit(docs)))
    assert complete(rows)
    for i in (1, 2, 3):
        assert rows[i][0]["lang_pred"] == "und" and rows[i][0]["score"] == 0 and not rows[i][0]["accepted"]
    assert rows[6][0]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in language.predict(docs, language.fit(docs.where("lang = 'x'"))).collect()} == {"und"}


def test_toxicity(docs, labels):
    rows = by_id(toxicity.score(docs, toxicity.fit(docs, labels)))
    assert complete(rows) and all(0 <= r["score"] <= 1 for part in rows.values() for r in part)
    assert rows[1][0]["score"] == rows[2][0]["score"] == rows[3][0]["score"]
    assert len({r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels.where("label > 9"))).collect()}) >= 1


def test_decontamination(spark, docs):
    items = [(1, None), (2, ""), (3, "word"), (None, LONG[5000:5200]), (4, LONG[5000:5200]), (4, LONG[5000:5200])]
    benchmark = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id long, text string, start long, doc_id long")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert found == {(7, None), (7, 4), (8, None), (8, 4)}
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0


def test_mixing(docs):
    rows = by_id(mixing.plan_mix(docs))
    assert complete(rows)
    assert all(r["size"] == 0 and r["taken"] == 0 for i in (1, 2, 3) for r in rows[i])
    flat = [r for part in rows.values() for r in part]
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in flat)
    for source in {r["source"] for r in flat}:
        part = [r for r in flat if r["source"] == source]
        assert sum(r["taken"] for r in part) == round(part[0]["target"])
    assert any(r["source"] is None for r in flat)


def test_near_duplicates(docs):
    rows = by_id(neardup.near_duplicates(docs, 3, 85))
    assert complete(rows)
    assert rows[5][0]["component_id"] == 4 and not rows[5][0]["kept"] and rows[4][0]["kept"]
    assert rows[8][0]["component_id"] == 7 and all(r["kept"] for r in rows[None])
    for i in (1, 2, 3):
        assert rows[i][0]["n_shingles"] == 0 and rows[i][0]["component_id"] == i


def test_extract(spark):
    pages = [(1, "u", None), (1, "u", ""), (None, None, "<p"), (2, "u", "<article><p>" + "so it is. " * 50000)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")
    assert sorted(r["n_chars"] for r in extract.extract(df).collect()) == [0, 0, 0, 499999]


def test_empty_tables(docs, labels):
    none, few = docs.limit(0), labels.limit(0)
    results = [
        dedup.remove_repeats(none), quality.score(none, quality.fit(none, few)), merkle.compare_edits(none), secrets.scan(none),
        language.predict(none, language.fit(none)), toxicity.score(none, toxicity.fit(none, few)), mixing.plan_mix(none),
        neardup.near_duplicates(none),
    ]
    assert all(r.count() == 0 for r in results)


def test_letters_are_those_of_the_letter_categories():
    assert not any(language.has_letter(t.encode()) for t in ("", "12 ²½①", "٣ _ – 😀", "ⅷ"))
    assert all(language.has_letter(t.encode()) for t in ("a", "1é", "²ß", "日", "ª"))


def test_dedup_of_rows_without_an_id(spark):
    """A repeat in one text without an id cuts nothing from the others."""
    draw = np.random.default_rng(8)

    def fresh(n):
        return "".join(chr(97 + c) for c in draw.integers(0, 26, n))

    shared, other = fresh(150), fresh(350)
    rows = [(1, shared), (None, shared + fresh(200)), (None, other), (None, other), (None, None), (2, "x" + other[:120])]
    got = dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    seen = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got)
    assert seen == [(0, 0, 0, 0), (0, 350, 120, 1), (0, 350, 120, 1), (0, 350, 150, 1), (1, 150, 0, 0), (2, 121, 0, 0)]
