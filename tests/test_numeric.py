"""Numeric checks on small tables: thresholds, negative controls, brute force."""

import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.functions import cells as C
from plumbline.operators import numeric as N
from plumbline.operators import profile as P
from plumbline.sources.frames import cells_from_dataframe


def test_cell_functions(spark):
    texts = [" 1.50 ", "-3", "1e3", "5d", "NaN", "n/a", "", ".5", "1.2.3", "12345678901234567890", "abc7x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    got = df.select(
        C.to_exact_decimal(c), C.is_missing(c), C.decimal_places(c), C.terminal_digit(c), C.is_integer_text(c), C.precision_overflow(c)
    ).collect()
    rows = dict(zip(texts, got))
    assert rows[" 1.50 "][0] == Decimal("1.5") and rows[" 1.50 "][2] == 2 and rows[" 1.50 "][3] == "0"
    assert rows["1e3"][0] == Decimal(1000) and rows["1e3"][3] is None
    assert rows["5d"][0] is None and rows["NaN"][0] is None and rows["NaN"][1] and rows["n/a"][1] and rows[""][1]
    assert rows[".5"][3] == "5" and rows["1.2.3"][2] == 0
    assert rows["12345678901234567890"][0] is None and rows["12345678901234567890"][5]
    assert rows["-3"][4] and not rows[" 1.50 "][4]


def test_header_roles(spark):
    cases = {"Sample ID": "identifier", "row index": "identifier", "formula x": "declared_formula", "Computed y": "derived", "norm": "normalization", "signal": "unspecified"}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    assert {r.h: r.r for r in df.select("h", C.header_role(F.col("h")).alias("r")).collect()} == cases


@pytest.mark.parametrize("n,same,expected", [(15, 12, "medium"), (14, 12, "low"), (15, 11, None), (4, 4, None)])
def test_terminal_digit_thresholds(make_cells, n, same, expected):
    rows = [[f"{i}.5" if i < same else f"{i}.{i % 4}"] for i in range(n)]
    found = N.terminal_digit(make_cells(["m"], rows)).collect()
    assert [r.risk_level for r in found] == ([expected] if expected else [])


def test_terminal_digit_controls(spark, make_cells):
    rows = [[f"{i}.5", f"{i}.5"] for i in range(20)]
    cells = make_cells(["sample_id", "m"], rows)
    assert [r.metadata["column_name"] for r in N.terminal_digit(cells).collect()] == ["m"]
    declared = spark.createDataFrame([("t", "M", "0.5")], "table_id string, column_name string, declared_resolution string")
    low = N.terminal_digit(cells, declared).collect()
    assert low[0].risk_level == "low" and not low[0].open_for_scoring
    derived = spark.createDataFrame([(None, "m", "derived")], "table_id string, column_name string, role string")
    assert N.terminal_digit(cells, derived).count() == 0


def test_fixed_delta_brute_force(make_cells):
    rng = random.Random(5)
    base = [Decimal(rng.randint(0, 999)) / 10 for _ in range(30)]
    cols = {"a": base, "b": [v + 5 for v in base], "c": [v * 2 for v in base], "d": [v - Decimal("0.3") for v in base], "e": base[:-1] + [base[-1] + 1], "gap": base}
    rows = [[("" if name == "gap" and i == 3 else str(col[i])) for name, col in cols.items()] for i in range(30)]
    got = {(r.metadata["first_column"], r.metadata["second_column"]): Decimal(r.metadata["delta"]) for r in N.fixed_delta(make_cells(list(cols), rows)).collect()}
    assert got == {("a", "b"): Decimal(5), ("a", "d"): Decimal("-0.3")}


def test_fixed_delta_disclosures(spark, make_cells):
    rows = [[str(20 + i), str(Decimal(20 + i) + Decimal("273.15")), str(25 + i)] for i in range(16)]
    cells = make_cells(["temperature_c", "temperature_k", "other"], rows)
    got = {(r.metadata["first_column"], r.metadata["second_column"]) for r in N.fixed_delta(cells).collect()}
    assert got == {("temperature_c", "other")}
    pair = spark.createDataFrame([("OTHER", "temperature_k")], "first_column string, second_column string")
    scored = {(r.metadata["first_column"], r.metadata["second_column"]): r.risk_level for r in N.fixed_delta(cells, independent_pairs=pair).collect()}
    assert scored[("temperature_k", "other")] == "medium" and scored[("temperature_c", "other")] == "low"
    assert N.fixed_delta(make_cells(["a", "b"], [["1", "2"], ["2", "3"]])).count() == 0


def lattice_by_hand(texts):
    values = [Decimal(t) for t in texts]
    places = max(len(t.split(".")[1]) if "." in t else 0 for t in texts)
    precision = Decimal(1).scaleb(-places)
    unique = sorted(set(values))
    best = None
    for step in sorted({b - a for a, b in zip(unique, unique[1:])}):
        if step / precision < Decimal("1.5"):
            continue
        tol = max(precision / 4, step * Decimal("0.000001"), Decimal("1e-12"))
        dist = []
        for v in values:
            units = (v - unique[0]) / step
            dist.append(abs(units - units.to_integral_value()) * step)
        item = (sum(d <= tol for d in dist) / len(values), -float(sum(dist) / len(values) / step), step)
        best = item if best is None or item > best else best
    return best


@pytest.mark.parametrize("seed", range(4))
def test_lattice_brute_force(make_cells, seed):
    rng = random.Random(seed)
    step = rng.choice([5, 25, 7])
    texts = [f"{(rng.randint(0, 40) * step + (rng.random() < 0.05)) / 100:.2f}" for _ in range(120)]
    counts = P.scaled_counts(P.value_counts(P.numeric_values(make_cells(["s"], [[t] for t in texts]))))
    overlap, residual, best = lattice_by_hand(texts)
    got = P.lattice_fit(counts).collect()[0]
    assert got.lattice_step == pytest.approx(float(best)) and got.lattice_overlap == pytest.approx(overlap)
    assert got.lattice_residual == pytest.approx(-residual, abs=1e-12)
    pruned = P.lattice_fit(counts, min_overlap=0.9).collect()
    if overlap >= 0.9:
        assert pruned[0].lattice_step == got.lattice_step


@pytest.mark.parametrize("grid,span", [(1, 400000), (40, 8000000)])
def test_lattice_tries_few_gaps(make_cells, monkeypatch, grid, span):
    """Bounds leave out most gaps of scattered values and of a real grid, and never the best one."""
    rng = random.Random(grid)
    texts = [f"{(rng.randrange(span // grid) * grid + (rng.random() < 0.02) * rng.randrange(grid)) / 100:.2f}" for _ in range(1500)]
    counts = P.chunked_values(P.scaled_counts(P.value_counts(P.numeric_values(make_cells(["s"], [[t] for t in texts])))))
    tried, fit = [], P._fit_blocks
    monkeypatch.setattr(P, "_fit_blocks", lambda values, steps: (tried.append(steps.count()), fit(values, steps))[1])
    overlap, residual, best = lattice_by_hand(texts)
    got = P.lattice_fit(counts).collect()[0]
    assert got.lattice_step == pytest.approx(float(best)) and got.lattice_overlap == pytest.approx(overlap)
    assert got.lattice_residual == pytest.approx(-residual, abs=1e-12)
    gaps = P.step_candidates(counts).count()
    assert gaps > 250 and sum(tried) * 4 < gaps
    tried.clear()
    pruned = P.lattice_fit(counts, min_overlap=0.9).collect()
    assert sum(tried) < 100 and (grid == 1 or pruned[0].lattice_step == got.lattice_step)


def test_lattice_with_wide_numbers(make_cells):
    texts = [f"{i % 9 * 3}.{'0' * 17}{i % 2}" for i in range(40)] + ["1234567.000000000000000001"]
    counts = P.scaled_counts(P.value_counts(P.numeric_values(make_cells(["s"], [[t] for t in texts]))))
    assert counts.where("wide").count() == counts.count()
    overlap, residual, best = lattice_by_hand(texts)
    got = P.lattice_fit(counts).collect()[0]
    assert got.lattice_overlap == pytest.approx(overlap) and got.lattice_step == pytest.approx(float(best))


def test_grid_positive_and_controls(make_cells):
    signal = [f"{(i * 7 % 11) * 0.05:.3f}" for i in range(32)]
    rows = [[str(i), s] for i, s in enumerate(signal)]
    found = N.quantization_grid(make_cells(["time_s", "signal"], rows)).collect()
    assert [(r.metadata["column_name"], r.risk_level) for r in found] == [("signal", "medium")]
    declared = [[str(i), s, "0.050"] for i, s in enumerate(signal)]
    assert N.quantization_grid(make_cells(["time_s", "signal", "declared_resolution"], declared)).count() == 0
    assert N.quantization_grid(make_cells(["signal"], [[s] for s in signal[:7]])).count() == 0
    mixed = [[s if i else "text"] for i, s in enumerate(signal)]
    assert N.quantization_grid(make_cells(["signal"], mixed)).count() == 0


def test_profile_and_partition_independence(make_cells):
    rows = [["1.0", "x"], ["2.25", "3"], ["n/a", "4"], ["7", ""]]
    cells = make_cells(["Voc (V)", "b"], rows)
    got = {r.column_name: r for r in P.profile_columns(cells).collect()}
    a, b = got["Voc (V)"], got["b"]
    assert (a.inferred_type, a.missing_count, a.unique_count, a.integer_count, a.unit_hint) == ("float", 1, 3, 2, "V")
    assert a.decimal_places_observed == {0: 1, 1: 1, 2: 1} and a.terminal_digits_observed == {0: 1, 5: 1, 7: 1}
    assert b.inferred_type == "mixed" and a.precision_hint == pytest.approx(0.01)
    again = P.profile_columns(cells.repartition(5).orderBy(F.rand(1))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got.values()))


def test_mode_tie_goes_to_the_first_seen(make_cells):
    rows = [["9"], ["2"], ["2"], ["9"], ["5"]]
    m = P.modal_value(P.value_counts(P.numeric_values(make_cells(["v"], rows)))).collect()[0]
    assert (m.modal_value, m.modal_count) == (Decimal(9), 2) == (Counter([9, 2, 2, 9, 5]).most_common(1)[0][0], 2)


def test_empty_input(spark):
    from plumbline.schemas import CELLS, FINDINGS

    empty = spark.createDataFrame([], CELLS)
    for check in (N.terminal_digit, N.fixed_delta, N.quantization_grid):
        out = check(empty)
        assert out.schema.names == FINDINGS.names and out.count() == 0


def test_grid_reads_the_cells_few_times(spark):
    """Distinct texts are counted in one pass; bounds, runs and resolutions read the cells too."""
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    rows = spark.range(60).select("id", F.concat((F.col("id") % 7 * 5).cast("string"), F.lit(".00")).alias("m"))
    cells = cells_from_dataframe(rows, F.lit("t"), F.col("id"), ["m"])
    found = N.grid_metrics(cells.mapInArrow(seen, cells.schema)).select("candidate_risk").collect()
    assert [r.candidate_risk for r in found] == ["medium"]
    assert reads.value <= 5 * 60


def test_cells_are_counted_once_for_scale_and_units(make_cells):
    scaled = P.scaled_counts(P.value_counts(P.numeric_values(make_cells(["s"], [["1.5"], ["2.25"], ["1.50"]]))))
    plan = scaled._jdf.queryExecution().optimizedPlan().toString()
    assert "RDD" not in plan and "LocalRelation" not in plan
    assert sorted((str(r.k), r.n, r.scale) for r in scaled.collect()) == [("150", 2, 2), ("225", 1, 2)]


def test_overflow_of_short_and_long_texts(spark):
    """Texts of up to 18 characters without an exponent are passed over before any pattern is tried; nothing else is."""
    over = ["12345678901234567890", "1e20", "1E-19", "0.1234567890123456789", "-12345678901234567890.5"]
    fits = ["999999999999999999", "-.1234567890123456", "1e3", "1.5E-2", "0.1234567890123400000", "text", "a text of more than 18 characters", "", None]
    df = spark.createDataFrame([(t,) for t in [*over, *fits]], "t string")
    assert {r.t for r in df.where(C.precision_overflow(F.col("t"))).collect()} == set(over)
    codes = df.where(C.precision_overflow(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert codes.index("length(") < codes.index("RLIKE")


def test_columns_that_differ_are_found_without_reading_the_cells_again(make_cells, monkeypatch):
    plans, write = {}, N.materialize

    def kept(df, label):
        plans[label] = df._jdf.queryExecution().analyzed().toString()
        return write(df, label)

    monkeypatch.setattr(N, "materialize", kept)
    cells = make_cells(["a", "b", "c"], [[str(i * i), str(i * i + 5), str(i)] for i in range(20)])
    assert [(r.column_name, r.offset) for r in N.fixed_delta_classes(cells).where("col_index > 0").collect()] == [("b", Decimal(5))]
    assert "row_index" in plans["delta-sums"] and "row_index" not in plans["delta-members"]
