"""The composed review: which checks it runs, and what it says about its modules."""

from plumbline.bindings.bibliography import order_references, supplier_works
from plumbline.plans import reviews

SF = "/root/testdata/sf0.001"


def test_checks_reach_the_ledger(spark, make_cells):
    cells = make_cells(["reading"], [["1" * 25], ["2"], ["3"]])
    hashes = spark.createDataFrame([("a.png", "s1", 0), ("b.png", "s2", 7), ("c.png", "s3", -1)], "image_id string, sha256 string, hash long")
    dois = order_references(spark, SF).selectExpr("doi", "index as seq")
    out = reviews.review_packages({"cells": cells, "image_hashes": hashes, "dois": dois, "works": supplier_works(spark, SF)})
    rules = {r["rule_id"]: r["n"] for r in out["ledger"].groupBy("rule_id").count().withColumnRenamed("count", "n").collect()}
    assert rules["precision_overflow"] == 1 and rules["image_perceptual_similarity_candidate"] == 1 and rules["status_enrichment"] > 0
    assert out["issues"].isEmpty()


def test_module_counts(spark):
    given = lambda *packages: spark.createDataFrame([(p,) for p in packages], "package_id string")
    nameless = spark.createDataFrame([(1,), (2,)], "row int")
    rows = reviews.module_counts([("tables", given("p", "p", "q"), given("p")), ("claims", given("q", None), given()), ("images", nameless, given("p"))])
    got = {(r.package_id, r.module): (r.status, r.input_rows, r.findings) for r in rows.collect()}
    assert got == {
        ("p", "tables"): ("success", 2, 1), ("q", "tables"): ("success", 1, 0), ("", "tables"): ("skipped", 0, 0),
        ("p", "claims"): ("skipped", 0, 0), ("q", "claims"): ("success", 1, 0), ("", "claims"): ("success", 1, 0),
        ("p", "images"): ("success", 0, 1), ("q", "images"): ("skipped", 0, 0), ("", "images"): ("success", 2, 0),
    }
