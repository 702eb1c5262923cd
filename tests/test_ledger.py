"""Ledger, claims and version rules on hand-made records."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import safety
from plumbline.functions.risk import cap_risk, resolve_bilingual
from plumbline.operators import claims as K
from plumbline.operators import ledger as L
from plumbline.operators import versions as V
from plumbline.schemas import CLAIMS, FINDINGS, VERSION_EVENTS
from plumbline.session import scratch_path
from plumbline.sources.ledgers import LedgerRejected, read_ledger, write_ledger


def finding(**over):
    base = dict(
        finding_id="f1", package_id="p", scope="research_integrity", rule_id="r", risk_level="medium", source_file="a.csv", table_id="t",
        evidence=[("a.csv", "row 1", None, None)], manual_requests=["ask"], safe_report_language="text", confidence=1.0, seq=1,
    )
    base.update(over)
    return tuple(base.get(n) for n in FINDINGS.names)


@pytest.fixture(scope="module")
def make(spark):
    return lambda *rows: spark.createDataFrame([finding(**r) for r in rows], FINDINGS)


def score(df):
    return {r.package_id: r.mrpi for r in L.mrpi(df).collect()}


def test_mrpi_groups_and_gates(make):
    assert score(make({}, {"finding_id": "f2"})) == {"p": 30.0}
    grouped = [{"finding_id": f"f{i}", "correlation_group": "g", "confidence": c} for i, c in enumerate([1.0, 0.2])]
    assert score(make(*grouped)) == {"p": 15.0}
    family = [{"finding_id": f"f{i}", "method_family": "m", "risk_level": r} for i, r in enumerate(["low", "medium"])]
    assert score(make(*family)) == {"p": 15.0}
    for closed in ({"scope": "engineering_plausibility"}, {"open_for_scoring": False}, {"mrpi_eligible": False}, {"resolution_status": "formally_corrected"}, {"finding_category": "method_card"}):
        assert score(make(closed)) == {"p": 0.0}
    assert score(make(*[{"finding_id": f"f{i}", "risk_level": "high"} for i in range(5)])) == {"p": 100.0}
    assert score(make({"risk_level": "odd", "confidence": 7.0})) == {"p": 5.0}


def test_unify_cap_dedupe_and_names(make):
    first = make({"risk_level": "high"}, {"finding_id": "x", "rule_id": "retracted_reference", "risk_level": "high"})
    second = make({"finding_id": "later"}, {"finding_id": None, "source_file": None, "rule_id": "s"})
    out = {r.rule_id: r for r in L.unify_findings(first, second).collect()}
    assert out["r"].finding_id == "f1" and out["r"].risk_level == "medium"
    assert out["retracted_reference"].risk_level == "high"
    assert out["s"].source_file == "a.csv" and out["s"].finding_id.startswith("unified-")


def test_validation_and_safety(make):
    bad = L.validate_ledger(
        make({}, {"finding_id": "m", "scope": "unsupported_motive"}, {"finding_id": "e", "evidence": []}, {"finding_id": "s", "safe_report_language": "This is proven fraud"}, {"finding_id": "k", "metadata": {"auth-token": "1"}})
    )
    kinds = {(r.finding_id, r.kind) for r in bad.collect()}
    assert kinds == {("m", "schema error"), ("e", "schema error"), ("s", "forbidden phrase"), ("k", "sensitive authentication material")}


def test_redaction(spark):
    text = 'cookie="a b" Bearer xyz see C:\\data\\x.csv and /home/me/x, https://h.org/a/b raw_metadata/z Guilty'
    out = spark.createDataFrame([(text,)], "t string").select(safety.redact_public_text(F.col("t")).alias("o")).first().o
    assert out == "<redacted-auth> Bearer <redacted-auth> see <local-path> and <local-path> https://h.org/a/b <private-path>/z <redacted-verdict-language>"


def test_write_and_read_back(spark, make):
    path = scratch_path(spark, "t")
    write_ledger(make({}, {"finding_id": "f2", "package_id": "q"}), path)
    kept, issues = read_ledger(spark, path)
    assert kept.count() == 2 and issues.count() == 0
    with pytest.raises(LedgerRejected):
        write_ledger(make({"evidence": []}), scratch_path(spark, "t"))


def test_old_keys_and_broken_lines(spark):
    lines = [json.dumps({"candidate_id": "c", "risk": "low", "rule_id": "r", "relative_path": "x.png", "summary": "s", "manual_verification": {"needed": True, "requests": ["q"]}}), "{broken", ""]
    path = scratch_path(spark, "t")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    kept, issues = read_ledger(spark, path)
    row = kept.collect()[0]
    assert (row.finding_id, row.risk_level, row.source_file, row.safe_report_language, row.manual_requests) == ("c", "low", "x.png", "s", ["q"])
    assert row.evidence[0].location == "r" and issues.count() == 1


def test_small_functions(spark):
    df = spark.createDataFrame([("high", "low"), ("low", "high"), ("high", "odd")], "r string, c string")
    assert [x[0] for x in df.select(cap_risk(F.col("r"), F.col("c"))).collect()] == ["low", "low", "medium"]
    m = spark.createDataFrame([({"zh": "z", "en": ""},), ({"zh": "", "en": ""},)], "m map<string,string>")
    assert [x[0] for x in m.select(resolve_bilingual(F.col("m"))).collect()] == ["z", ""]


def claim(cid, doc, value, unit="degC", kind="anneal_temperature", sample="s", context="c", confirmed=True, version="v1"):
    return (cid, kind, value, unit, "dev", sample, context, doc, version, "loc", "h", confirmed)


def conflicts(spark, *rows):
    return sorted((r.claim_a, r.claim_b, r.risk_level, r.comparison_kind) for r in K.claim_conflicts(spark.createDataFrame(list(rows), CLAIMS)).collect())


def test_claims(spark):
    assert conflicts(spark, claim("a", "main", "100"), claim("b", "si", "373.15", "K")) == []
    assert conflicts(spark, claim("a", "main", "100"), claim("b", "si", "120")) == [("a", "b", "medium", "numeric_value_change")]
    assert conflicts(spark, claim("a", "main", "100"), claim("b", "main", "120")) == []
    assert conflicts(spark, claim("a", "main", "100"), claim("b", "si", "120", confirmed=False)) == []
    assert conflicts(spark, claim("a", "main", "100"), claim("b", "si", "120", version="v2")) == []
    assert conflicts(spark, claim("a", "main", "100"), claim("b", "si", "120", sample=None)) == [("a", "b", "low", "missing_comparison_context")]
    assert conflicts(spark, claim("a", "main", "100", sample="x"), claim("b", "si", "120", sample="y", context=None)) == []
    assert conflicts(spark, claim("a", "main", "1", "pints", "concentration"), claim("b", "si", "1", "M", "concentration")) == [("a", "b", "low", "unit_review_question")]
    layer = lambda i, d, v: claim(i, d, v, "none", "layer_order")
    assert conflicts(spark, layer("a", "main", "ITO/C60"), layer("b", "si", "C60 > ito")) == [("a", "b", "medium", "layer_order_change")]
    assert conflicts(spark, layer("a", "main", "ITO/C60"), layer("b", "si", "ITO/Ag")) == [("a", "b", "medium", "layer_inventory_change")]
    mix = lambda i, d, v: claim(i, d, v, "none", "composition")
    assert conflicts(spark, mix("a", "main", "I:Br = 1:3"), mix("b", "si", "I : Br 2:6")) == []
    three = conflicts(spark, claim("a", "main", "1"), claim("b", "si", "2"), claim("c", "table", "3"))
    assert [(x[0], x[1]) for x in three] == [("a", "b"), ("a", "c")]


def event(eid, kind, status=None, version="v2", **links):
    base = dict(event_id=eid, package_id="p", target_doi="10.1000/x", source_version=version, source_type=kind, source_url="u", observed_at="2024-01-01", status="s", resolution_status=status)
    for n in ("related_finding_ids", "related_claim_ids", "resolves_event_ids", "resolves_finding_ids", "supersedes_versions"):
        base[n] = links.get(n, [])
    return base


@pytest.mark.parametrize(
    "events,expected",
    [
        ([], ("open", True, "E2", 0)),
        ([event("n", "publisher_correction", resolves_finding_ids=["f1"])], ("formally_corrected", False, "E4", 1)),
        ([event("n", "publisher_retraction", resolves_finding_ids=["f1"])], ("open", True, "E3", 1)),
        ([event("o", "original_public_version", version="v1", related_finding_ids=["f1"]), event("n", "current_publisher_si", "resolved_by_version", supersedes_versions=["v1"])], ("resolved_by_version", False, "E3", 1)),
        ([event("n", "author_response", related_claim_ids=["c1"])], ("partially_explained", True, "E3", 1)),
        ([event("n", "author_response", related_claim_ids=["c1"], related_finding_ids=["f1"])], ("open", True, "E2", 0)),
        ([event("n", "publisher_update", "formally_corrected")], ("open", True, "E2", 0)),
    ],
)
def test_reconciliation(spark, make, events, expected):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("package_id", T.StringType()), *VERSION_EVENTS.fields])
    df = spark.createDataFrame([tuple(e[n] for n in schema.names) for e in events], schema)
    row = V.reconcile_versions(make({"claim_ids": ["c1"], "source_versions": ["v1"]}), df).collect()[0]
    assert (row.resolution_status, row.open_for_scoring, row.evidence_tier, row.counter_events) == expected


def test_findings_with_equal_links_are_linked_once(spark):
    """One finding stands for many, and the pairs are those of each finding by itself."""
    import random

    from pyspark.sql import types as T

    rng = random.Random(3)
    pick = lambda prefix, top, most: [f"{prefix}{rng.randrange(top)}" for _ in range(rng.randint(0, most))]
    rows = [(f"p{n % 2}", None if n % 40 == 7 else f"f{n % 110}", pick("e", 60, 1) if n % 9 == 0 else [f"x{n}"], pick("c", 2, 1), ["v0"] if n % 5 else pick("v", 3, 2)) for n in range(120)]
    findings = spark.createDataFrame(rows, "package_id string, finding_id string, event_ids array<string>, claim_ids array<string>, source_versions array<string>")
    schema = T.StructType([T.StructField("package_id", T.StringType()), *VERSION_EVENTS.fields])
    links = lambda n: {"related_finding_ids": pick("f", 110, 1) if n % 4 == 0 else [], "related_claim_ids": pick("c", 2, 1), "resolves_event_ids": pick("e", 30, 1), "resolves_finding_ids": pick("f", 110, 1) if n % 6 == 0 else [], "supersedes_versions": pick("v", 3, 1)}
    made = [event(f"e{n}", "publisher_update", version=f"v{n % 3}", **links(n)) | {"package_id": f"p{n % 2}"} for n in range(30)]
    events = spark.createDataFrame([tuple(e[n] for n in schema.names) for e in made], schema)
    pairs = lambda df: sorted(tuple(map(str, r)) for r in df.select("package_id", "finding_id", "event_id", "role").collect())
    assert pairs(V.finding_events(findings, events)) == pairs(V._linked_events(V._links(findings), events))
    chosen, members = V._representatives(findings, events)
    assert chosen.count() < 110 and members.count() > 10


def test_publish_keeps_the_old_ledger_until_the_commit(spark, make, monkeypatch):
    from plumbline.sources import ledgers

    path = scratch_path(spark, "t")
    read = lambda: sorted(r.finding_id for r in read_ledger(spark, path)[0].collect())
    first = write_ledger(make({}, {"finding_id": "f2", "package_id": "q"}, {"finding_id": "f3", "package_id": None}), path)
    assert read() == ["f1", "f2", "f3"] and ledgers.damaged_files(spark, path).isEmpty()
    with pytest.raises(LedgerRejected):
        write_ledger(make({"finding_id": "bad", "evidence": []}), path)
    assert read() == ["f1", "f2", "f3"]
    # a write that breaks off after its data, before its commit
    with monkeypatch.context() as m:
        m.setattr(ledgers, "ledger_files", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            write_ledger(make({"finding_id": "half"}), path)
    assert read() == ["f1", "f2", "f3"] and ledgers.current_version(spark, path)["version"] == first
    write_ledger(make({"finding_id": "new"}), path)
    assert read() == ["new"] and ledgers.current_version(spark, path)["number"] == 2
    write_ledger(make({"finding_id": "again"}), path)
    assert read() == ["again"]
    write_ledger(make({}).limit(0), path)
    assert read() == []


def test_a_large_package_spreads_over_files(spark, make, monkeypatch):
    from plumbline.sources import ledgers

    monkeypatch.setattr(ledgers, "FILE_ROWS", 10)
    path = scratch_path(spark, "t")
    version = write_ledger(make(*[{"finding_id": f"f{i}", "package_id": "big" if i % 3 else f"p{i}"} for i in range(90)]), path)
    files = ledgers.ledger_files(spark, path, version).collect()
    assert sum(r.findings for r in files) == 90 and max(r.findings for r in files) <= 10
    lost = spark.read.schema("file string, findings long").json(f"{path}/_manifests/{version}").withColumn("findings", F.col("findings") + 1)
    lost.limit(1).write.mode("append").json(f"{path}/_manifests/{version}")
    assert ledgers.damaged_files(spark, path).count() == 1


def test_small_packages_share_files(spark, make, monkeypatch):
    """The number of files follows the findings; the manifest tells which packages a file holds."""
    from plumbline.sources import ledgers

    monkeypatch.setattr(ledgers, "FILE_ROWS", 20)
    path = scratch_path(spark, "t")
    version = write_ledger(make(*[{"finding_id": f"f{i}", "package_id": f"p{i:03d}"} for i in range(60)], {"finding_id": "n", "package_id": None}), path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/_versions/{version}").count()
    assert files <= 8
    listed = spark.read.json(f"{path}/_manifests/{version}").orderBy("first_package").collect()
    assert sum(r.findings for r in listed) == 61 and ledgers.damaged_files(spark, path).isEmpty()
    named = [r for r in listed if r.first_package]
    assert all(a.last_package <= b.first_package for a, b in zip(named, named[1:]))
    assert read_ledger(spark, path)[0].where("package_id is null").count() == 1


def test_the_cheap_test_passes_over_relative_paths_only(spark):
    """A text with an issue is always looked at; a plain relative path is not."""
    from plumbline.functions import safety

    bad = ["/home/u/x", "see (/etc/passwd)", "C:\\data\\x", "d:/data/x", "\\\\host\\share", "\\\\?\\C:\\x", "Private_Audio\\a", "a raw_metadata/b",
           "Authorization: x", "Bearer abc", "xsec-token=1", "QR: 3", "session-id: 4", "cookie=5", "author GUILTY", "作者造假", "a\u0002/b/c"]
    fine = ["data/file_1.csv", "https://example.org/a/b", "plain text", ""]
    rows = spark.createDataFrame([(t,) for t in bad + fine], "t string")
    got = rows.select("t", safety.suspicious(F.col("t")).alias("s"), F.size(safety.text_safety_issues(F.col("t"))).alias("n")).collect()
    assert all(r.n > 0 and r.s for r in got if r.t in bad)
    assert not any(r.n or r.s for r in got if r.t in fine), [r.t for r in got if r.t in fine and r.s]
