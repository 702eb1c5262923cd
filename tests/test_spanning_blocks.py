"""Spanning records are found block by block: no text is written or shuffled, and the order of lines holds."""

import csv
import random

import pytest

from plumbline.sources import lines, records
from plumbline.sources.tables import read_delimited_cells
from tests.test_records import _cells, _expected, small_splits


def _table(path, rows, seed=1):
    draw = random.Random(seed)
    with open(path, "w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(["long\n" * 30 + "head", "second"])
        for n in range(rows):
            out.writerow([n, "x\n" * draw.randrange(60) + draw.choice(['say "hi"', "", "a,b", '"'])])


@pytest.mark.parametrize("few", [0, 50_000])
def test_records_cross_many_blocks(spark, tmp_path, monkeypatch, few):
    """Of many blocks too, which are not sent to all tasks."""
    monkeypatch.setattr(lines, "FEW", few)
    for seed in (1, 2):
        _table(tmp_path / f"t{seed}.csv", 80, seed)
    with small_splits(spark, 90):
        found, warnings = _cells(spark, tmp_path)
    assert found == {**_expected(tmp_path / "t1.csv"), **_expected(tmp_path / "t2.csv")}
    assert warnings == []


def test_stray_quote_before_many_blocks(spark, tmp_path):
    body = "".join(f"{n},{n + 1}\n\n" for n in range(60))
    (tmp_path / "s.csv").write_text('h,i\n"two\n\nlines",1\n' + body + '"never closed,2\n' + body)
    with small_splits(spark, 40):
        found, warnings = _cells(spark, tmp_path)
    rows = [("two\n\nlines", "1"), *[(str(n), str(n + 1)) for n in range(60)], ("never closed,2",), *[(str(n), str(n + 1)) for n in range(60)]]
    assert found == {("s", i, c): v for i, r in enumerate(rows, 1) for c, v in enumerate(r)}
    assert len(warnings) == 1


def test_no_text_is_written_or_shuffled(spark, tmp_path, monkeypatch):
    written = {}
    for module in (lines, records):
        keep = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, label, keep=keep: written.update({label: df.columns}) or keep(df, label))
    _table(tmp_path / "t.csv", 50)
    cells, _ = read_delimited_cells(spark, str(tmp_path))
    assert not any("line" in columns for columns in written.values())
    plan = cells._jdf.queryExecution().executedPlan().toString()
    # only the pieces of records that cross blocks are grouped, by record
    exchanges = [row for row in plan.splitlines() if "Exchange hashpartitioning" in row]
    assert exchanges and all("_record" in row for row in exchanges) and "SortMergeJoin" not in plan
