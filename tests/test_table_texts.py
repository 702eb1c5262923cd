"""Table checks of a review read each distinct text once, and only grids are looked through for runs."""

from pyspark.sql import functions as F

from plumbline.functions import cells as C
from plumbline.operators import numeric as N
from plumbline.operators import profile as P
from plumbline.plans import reviews


def _rows(n=60):
    return [[str(i % 7 * 5), f"{i * i % 97}.{i % 89:02d}", f"{i + 0.25}", f"1e{i % 30}", "" if i % 9 else "1" * 25] for i in range(n)]


def test_findings_from_texts_are_those_of_the_cells(spark, make_cells):
    cells = make_cells(["grid", "free", "fine", "long", "note_resolution"], _rows())
    texts = N.cell_texts(cells)
    found = lambda df: sorted(map(str, df.collect()))
    for check in (N.terminal_digit, N.quantization_grid):
        assert found(check(cells, texts=texts)) == found(check(cells))
    assert found(N.precision_overflow(cells, texts)) == found(N.precision_overflow(cells))
    assert N.precision_overflow(cells).count() == 2


def test_a_review_counts_runs_of_grids_only_and_texts_once(spark, make_cells, monkeypatch):
    looked, written = [], []
    runs, keep = P.longest_runs, N.materialize
    monkeypatch.setattr(P, "longest_runs", lambda cells, columns, rows=None: looked.extend(r["column_name"] for r in columns.collect()) or runs(cells, columns, rows))
    monkeypatch.setattr(N, "materialize", lambda df, label: written.append(label) or keep(df, label))
    out = reviews.review_packages({"cells": make_cells(["grid", "free"], [r[:2] for r in _rows()])})
    assert [r["rule_id"] for r in out["ledger"].select("rule_id").collect()].count("quantization_grid") == 1
    assert looked == ["grid"] and written.count("texts") == 1


def test_residues_are_exact(spark):
    texts = ["-5", "+5", "5.", ".5", "-.5", "-0.00", "1e3", "1E-18", "123456789012345678", "-1234567890123456789", "0.0000000000000001", "-0.123456789012345678", "0.000000000000000001"]
    from decimal import Decimal

    df = spark.createDataFrame([(t,) for t in [*texts, "", "5d", "1.2.3", "-", "1e400"]], "t string")
    for residue in (N._text_residue(F.col("t")), N._residue(C.to_exact_decimal(F.col("t")))):
        got = {r.t: r.r for r in df.select("t", residue.alias("r")).collect()}
        assert got == {t: int(Decimal(t).scaleb(18)) % N._PRIME for t in texts} | dict.fromkeys(["", "5d", "1.2.3", "-", "1e400"])


def test_fixed_difference_in_the_last_decimals(spark, make_cells):
    rows = [[f"0.{i:016d}", f"0.{i:016d}5"] for i in range(1, 30)]
    found = N.fixed_delta_classes(make_cells(["a", "b"], rows)).where("col_index = 1").collect()
    assert [float(r["offset"]) for r in found] == [5e-17]
