"""Stages of the pipeline and a whole run on rows with null ids, against plain Python."""

import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = r"[^\x20\x09-\x0D]+"
SECRET = "password=hunter2222"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def item(spark):
    return max((r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r["text"]), key=len)


def test_leaks_without_id_go(spark, item):
    rows = [(None, f"some words {item} more", "a"), (None, "nothing of it", "a"), (None, None, "a"), (1, item, "a"), (2, "clean", "a")]
    kept = pipeline.drop_benchmark_leaks(spark, frame(spark, rows), SF).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(None, "nothing of it"), (None, None), (2, "clean")])


def test_secrets_without_id_are_masked(spark):
    rows = [(None, f"a {SECRET} b", "a"), (None, f"a {SECRET} b", "a"), (None, "clean", "a"), (None, None, "a"), (3, SECRET, "a")]
    out = Counter((r["doc_id"], r["text"], r["n_chars"]) for r in pipeline.mask_secrets(spark, frame(spark, rows), SF).collect())
    assert out == Counter({(None, "a [SECRET] b", 12): 2, (None, "clean", 5): 1, (None, None, None): 1, (3, "[SECRET]", 8): 1})


def test_training_order_has_the_texts(spark):
    rows = [(i if i % 3 else None, f" doc {i}\t" + "w " * (i % 7) + f"end{i}", f"s{i % 3}") for i in range(40)] + [(None, None, "s0")]
    out = pipeline.mix_sources(spark, frame(spark, rows), SF).collect()
    texts = {t for _, t, _ in rows}
    assert [r["position"] for r in out] == sorted(r["position"] for r in out)
    for r in out:
        assert len(re.findall(WORD, r["text"])) == r["words"] <= r["size"]
        assert r["text"] in texts if r["words"] == r["size"] else any(t and t.startswith(r["text"]) for t in texts)
    for s in {r["source"] for r in out}:
        part = [r for r in out if r["source"] == s]
        assert sum(r["words"] for r in part) == round(part[0]["target"])
        assert sum(r["words"] < r["size"] for r in part) <= 1


def test_run_with_null_ids(spark, item, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*pipeline.COLUMNS).where("doc_id % 5 = 0")
    marks = [(None, f"zebra{k} one two three {SECRET} four five six{k}", "web") for k in range(20)] + [(None, f"lead{k} {item}", "web") for k in range(3)]
    docs.unionByName(frame(spark, marks)).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert out and not any(SECRET in r["text"] or item in r["text"] for r in out)
    assert any("[SECRET]" in r["text"] for r in out if r["doc_id"] is None)
    assert all(len(re.findall(WORD, r["text"])) == r["words"] for r in out)
