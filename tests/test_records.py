"""Records that span lines and splits, against plain readers of the whole file."""

import csv
import json
import random
from contextlib import contextmanager

import pytest

from plumbline.sources.records import json_objects
from plumbline.sources.references import read_literature_csl
from plumbline.sources.tables import read_delimited_cells


@contextmanager
def small_splits(spark, size):
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name in names:
            spark.conf.unset(name)


def _cells(spark, path):
    cells, warnings = read_delimited_cells(spark, str(path))
    found = {(r["table_id"], r["row_index"], r["col_index"]): r["value"] for r in cells.collect()}
    return found, sorted((r["source_file"], r["message"]) for r in warnings.collect())


def _expected(path):
    """Cells by the reader of the standard library, over the whole file."""
    with open(path, newline="", encoding="utf-8-sig") as f:
        rows = [r for r in csv.reader(f, delimiter="\t" if path.suffix == ".tsv" else ",") if any(c.strip() for c in r) or len(r) > 1]
    return {(path.stem, i, c): v.strip() for i, r in enumerate(rows[1:], 1) for c, v in enumerate(r[: len(rows[0])])}


def test_quoted_cells_span_lines_and_splits(spark, tmp_path):
    draw = random.Random(3)
    values = ["plain", 'say "hi"', "two\nlines", "a,b\n\n\nc", '"\n"', '","\n', "", "tab\there", "x\n" * 20, 'odd"']
    for name, delimiter in (("a.csv", ","), ("b.tsv", "\t")):
        with open(tmp_path / name, "w", newline="") as f:
            out = csv.writer(f, delimiter=delimiter, lineterminator="\n")
            out.writerow(["first\nhead", "second", "third"])
            for n in range(200):
                out.writerow([n, draw.choice(values), draw.choice(values)])
                f.write("\n" * draw.randint(0, 2))
                f.write(f'{n}{delimiter}5" pipe{delimiter}"closed" then "open\n' if n % 7 == 0 else "")
    with small_splits(spark, 300):
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        found, warnings = _cells(spark, tmp_path)
    assert found == {**_expected(tmp_path / "a.csv"), **_expected(tmp_path / "b.tsv")}
    assert warnings == []


def test_stray_quote_does_not_swallow_the_file(spark, tmp_path):
    (tmp_path / "s.csv").write_text('h,i\n"two\nlines",1\n"never closed,2\n\n3,4\n5,6\n')
    found, warnings = _cells(spark, tmp_path)
    assert found == {
        ("s", 1, 0): "two\nlines", ("s", 1, 1): "1", ("s", 2, 0): "never closed,2", ("s", 3, 0): "3", ("s", 3, 1): "4", ("s", 4, 0): "5", ("s", 4, 1): "6",
    }
    assert warnings == [("s.csv", "a quoted cell is never closed; its lines are read one by one")]


def test_long_cell_and_empty_folder_of_rows(spark, tmp_path):
    (tmp_path / "l.csv").write_text('h\n"' + "word \n" * 60_000 + '"\n')
    (tmp_path / "e.csv").write_text("\n\n")
    found, warnings = _cells(spark, tmp_path)
    assert len(found) == 1 and len(found["l", 1, 0]) == 6 * 60_000 - 2
    assert warnings == [("e.csv", "empty file")]


@pytest.mark.parametrize("indent", [None, 2])
def test_json_array_larger_than_a_split(spark, tmp_path, indent):
    texts = ["plain", "a } b", "{[", '\\"}', "line\nbreak", "}" * 30, "\\", '"', "]"]
    entries = [
        {"id": f"e{n}", "DOI": f"10.1000/x{n}", "title": [texts[n % 9]] if n % 2 else texts[n % 9], "issued": {"date-parts": [[1990 + n % 30]]}, "author": [{"family": "A"}] * (n % 3)}
        for n in range(60)
    ]
    (tmp_path / "all.json").write_text(json.dumps(entries, indent=indent))
    (tmp_path / "one.json").write_text(json.dumps(entries[7]) + "\n")
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "cut.json").write_text(json.dumps(entries[:5])[:-30])
    with small_splits(spark, 900):
        rows = json_objects(spark, str(tmp_path)).collect()
        items = read_literature_csl(spark, str(tmp_path)).where("source_file = 'all.json'").collect()
    by_file = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["pos"])):
        by_file.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["pos"], json.loads(r["text"])))
    assert by_file == {"all.json": list(enumerate(entries)), "one.json": [(0, entries[7])], "cut.json": list(enumerate(entries[:4]))}
    assert {(r["item_id"], r["title"], r["year"]) for r in items} == {(f"e{n}", texts[n % 9], str(1990 + n % 30)) for n in range(60)}


def test_records_that_cross_chunks_are_joined_and_texts_not_carried(spark, tmp_path, monkeypatch):
    """With chunks of four lines; the steps that find the records hold marks only."""
    from plumbline.sources import records

    written = {}
    keep = records.materialize
    monkeypatch.setattr(records, "materialize", lambda df, label: written.update({label: df.columns}) or keep(df, label))
    monkeypatch.setattr(records, "order_chunk", lambda c: records.F.floor(c / 4).cast("long"))
    with open(tmp_path / "c.csv", "w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(["h", "i"])
        for n in range(40):
            out.writerow(["x\n" * (n % 11) + f'say "{n}"', n])
    cells, _ = read_delimited_cells(spark, str(tmp_path))
    got = {(r.row_index, r.col_index): r.value for r in cells.collect()}
    assert len(got) == 80
    assert all(got[n + 1, 0] == ("x\n" * (n % 11) + f'say "{n}"').strip() and got[n + 1, 1] == str(n) for n in range(40))
    assert "line" not in written["quote-states"]
