"""Curves, images and workbook cells against brute force and hand-made cases."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions.units import average_lifetime
from plumbline.operators import curve_compare as CC
from plumbline.operators import curves as C
from plumbline.operators import images as I
from plumbline.operators import ordered
from plumbline.operators import records as R
from plumbline.sources.curves import builtin_reference
from plumbline.schemas import POINTS


@pytest.fixture(scope="module")
def curve(spark):
    def make(points, name="c", direction="forward", device="dev1", file=None):
        return spark.createDataFrame([(name, file or f"{name}.csv", device, i, float(x), float(y), direction) for i, (x, y) in enumerate(points)], POINTS)

    return make


def test_jv_metrics_by_hand(curve):
    m = C.jv_metrics(curve([(0, 20), (0.5, 20), (1.0, 10), (1.2, -10)])).collect()[0]
    assert (m.jsc_ma_cm2, m.voc_v, m.pmp_mw_cm2) == (20.0, pytest.approx(1.1), 10.0)
    assert m.ff == pytest.approx(10 / 22) and m.pce_percent == pytest.approx(10.0) and m.warnings == ["too few points"]
    flipped = C.jv_metrics(curve([(0, -20), (0.5, -20), (1.0, -10), (1.2, 10), (1.3, 12)])).collect()[0]
    assert flipped.pce_percent == pytest.approx(10.0) and flipped.warnings == ["sign convention inferred"]
    none = C.jv_metrics(curve([(0.1, 5), (0.2, 4), (0.3, 3), (0.4, 2), (0.5, 1)])).collect()[0]
    assert (none.jsc_ma_cm2, none.voc_v) == (5.0, 0.5) and none.warnings == ["no voltage zero crossing", "no current zero crossing"]


def integrate_by_hand(points, ref):
    pts = sorted(points, key=lambda p: p[0])
    vals = []
    for w, irr in ref:
        e = 0.0
        if pts[0][0] <= w <= pts[-1][0]:
            for (x1, y1), (x2, y2) in zip(pts, pts[1:]):
                if x1 <= w <= x2:
                    e = y1 if x1 == x2 else y1 + (w - x1) * (y2 - y1) / (x2 - x1)
                    break
        vals.append(e * irr * w * 8.0655446e-5)
    return sum(0.5 * (a + b) * (w2 - w1) for (w1, _), (w2, _), a, b in zip(ref, ref[1:], vals, vals[1:]))


@pytest.mark.parametrize("chunk", [3, 1 << 18])
def test_integration_brute_force(spark, curve, monkeypatch, chunk):
    monkeypatch.setattr(ordered, "CHUNK_ROWS", chunk)
    rng = random.Random(1)
    points = [(rng.choice([300 + 50 * rng.randint(0, 12), rng.uniform(280, 1100)]), rng.random()) for _ in range(25)]
    # equal wavelengths keep their order of appearance
    ref = [(r.wavelength_nm, r.irradiance) for r in builtin_reference(spark).collect()]
    got = C.eqe_integration(curve(points), builtin_reference(spark)).collect()[0]
    assert got.integrated_jsc_ma_cm2 == pytest.approx(integrate_by_hand(points, ref), rel=1e-9)


def test_hysteresis_pairs_in_order(spark):
    data = [("f1", "a_fwd.csv", "d", "forward", 10.0), ("f2", "b_fwd.csv", "d", "forward", 10.0), ("r1", "a_rev.csv", "d", "reverse", 10.2), ("u", "x_fwd.csv", "unknown", "forward", 10.0), ("v", "x_rev.csv", "unknown", "reverse", 12.0)]
    df = spark.createDataFrame(data, "curve_id string, source_file string, device_id string, scan_direction string, pce_percent double")
    got = {(r.forward_curve, r.reverse_curve): r.risk_level for r in C.hysteresis_pairs(df).collect()}
    assert got == {("f1", "r1"): None, ("u", "v"): "medium"}


def test_average_lifetime(spark):
    df = spark.sql("select array(named_struct('amplitude', 1.0d, 'lifetime', '100', 'unit', 'ns'), named_struct('amplitude', 3.0d, 'lifetime', '0.2', 'unit', 'us')) c")
    a, b, c = df.select(*[average_lifetime(F.col("c"), F.lit(f)) for f in ("Amplitude_Weighted", "intensity weighted", "?")]).first()
    assert a == pytest.approx(175.0) and b == pytest.approx((100**2 + 3 * 200**2) / (100 + 600)) and c is None


@pytest.mark.parametrize("tol", ["0", "0.5"])
def test_coverage_brute_force(spark, tol):
    rng = random.Random(int(float(tol) * 10) + 2)
    source = [(i, round(i * 0.4 + rng.choice([0, 0.1]), 1)) for i in range(60)]
    plot = [(i, round(x + rng.choice([0, 0, 0.5, -0.5, 0.6]), 1)) for i, x in rng.sample(source, 30)]
    specs = spark.sql(f"""select 's' spec_id, true has_mapping, true context_matches, cast({tol} as decimal(37,18)) x_tolerance, 2 minimum_missing, false downsampling_disclosed,
      false filtering_disclosed, cast(null as decimal(37,18)) axis_low, cast(null as decimal(37,18)) axis_high, cast(null as array<struct<start:decimal(37,18),stop:decimal(37,18)>>) filtered""")
    points = lambda rows: spark.createDataFrame([("s", i, str(x)) for i, x in rows], "spec_id string, seq long, t string").select("spec_id", "seq", F.col("t").cast("decimal(37,18)").alias("x"), F.lit(1.0).alias("y"))
    _, intervals = CC.curve_point_coverage(specs, points(source), points(plot))
    xs = [x for _, x in plot]
    lost = [i for i, x in source if min(xs) < x < max(xs) and not any(abs(x - p) <= float(tol) + 1e-9 for p in xs)]
    runs, run = [], []
    for i in lost:
        if run and i != run[-1] + 1:
            runs.append(run)
            run = []
        run.append(i)
    runs.append(run)
    assert sorted((r.seq_start, r.point_count) for r in intervals.collect()) == [(r[0], len(r)) for r in runs if len(r) >= 2]


def test_coverage_questions(spark):
    dec = "decimal(37,18)"
    specs = spark.sql(f"""select id spec_id, id <> 'a' has_mapping, id <> 'b' context_matches, cast(0 as {dec}) x_tolerance, 2 minimum_missing, id = 'd' downsampling_disclosed, id = 'c' filtering_disclosed,
      cast(null as {dec}) axis_low, cast(null as {dec}) axis_high, cast(null as array<struct<start:{dec},stop:{dec}>>) filtered from values 'a', 'b', 'c', 'd', 'e', 'f' t(id)""")
    source = spark.sql(f"select s spec_id, id seq, cast(id as {dec}) x, 1.0d y from range(10), values 'd', 'e' t(s)")
    plot = spark.sql(f"select s spec_id, id seq, cast(id as {dec}) x, 1.0d y from range(10), values 'd', 'e', 'f' t(s) where id in (0, 5, 9)")
    got = {r.spec_id: r.kind for r in CC.curve_point_coverage(specs, source, plot)[0].collect()}
    assert got == {
        "a": "missing_source_mapping", "b": "sample_or_version_context_mismatch", "c": "filtering_disclosed_without_intervals",
        "e": "unexplained_contiguous_missing_interval", "f": "insufficient_finite_curve_points",
    }


def segments_by_hand(x1, y1, x2, y2):
    """Longest qualifying pair of segments among all starts and lengths."""

    def affine(a, b):
        n = len(a)
        ma, mb = sum(a) / n, sum(b) / n
        aa, bb = sum((v - ma) ** 2 for v in a), sum((v - mb) ** 2 for v in b)
        ab = sum((p - ma) * (q - mb) for p, q in zip(a, b))
        if aa <= 0 or bb <= 0:
            return None
        s = ab / aa
        o = mb - s * ma
        rmse = math.sqrt(sum((q - o - s * p) ** 2 for p, q in zip(a, b)) / n)
        return ab / math.sqrt(aa * bb), rmse / (max(b) - min(b)), s

    best = 0
    for i in range(len(x1)):
        for j in range(len(x2)):
            for n in range(8, min(len(x1) - i, len(x2) - j) + 1):
                y = affine(y1[i : i + n], y2[j : j + n])
                line = affine(x1[i : i + n], y1[i : i + n])
                if y and line and y[2] > 0 and y[0] >= 0.999 and y[1] <= 0.01 and line[0] ** 2 < 0.995:
                    best = max(best, n)
    return best


def test_segment_brute_force(spark):
    rng = np.random.default_rng(4)
    x = np.arange(24.0)
    y1 = rng.uniform(0, 100, 24)
    y2 = rng.uniform(0, 100, 24)
    y2[6:18] = 3 * y1[4:16] + 11
    rows = lambda name, y: pd.DataFrame({"spec_id": "s", "curve_id": name, "seq": range(24), "x": x, "y": y})
    specs = spark.createDataFrame([("s", True), ("n", False)], "spec_id string, human_confirmed_independent boolean")
    got = CC.curve_segment_similarity(specs, spark.createDataFrame(rows("a", y1)), spark.createDataFrame(rows("b", y2))).collect()
    assert [(r.first_start, r.second_start, r.window_length) for r in got] == [(4, 6, 12)]
    assert got[0].window_length == segments_by_hand(list(x), list(y1), list(x), list(y2)) and got[0].scale == pytest.approx(3.0)
    line = CC.curve_segment_similarity(specs, spark.createDataFrame(rows("a", x)), spark.createDataFrame(rows("b", 2 * x))).count()
    assert line == 0


def test_segment_of_long_curves(spark, monkeypatch):
    """A long segment is found whole, also when the comparison is split by diagonals."""
    rng = np.random.default_rng(5)
    x = np.arange(3000.0)
    y1, y2 = rng.uniform(0, 100, 3000), rng.uniform(0, 100, 3000)
    y2[1200:2900] = 2 * y1[100:1800] - 5
    specs = spark.createDataFrame([("s", True)], "spec_id string, human_confirmed_independent boolean")
    rows = lambda name, y: spark.createDataFrame(pd.DataFrame({"spec_id": "s", "curve_id": name, "seq": range(3000), "x": x, "y": y}))
    for pairs in (CC.PAIRS_PER_TASK, 1 << 20):
        monkeypatch.setattr(CC, "PAIRS_PER_TASK", pairs)
        got = CC.curve_segment_similarity(specs, rows("a", y1), rows("b", y2)).collect()
        assert [(r.first_start, r.second_start, r.window_length) for r in got] == [(100, 1200, 1700)]


def test_segment_within_one_curve(spark):
    rng = np.random.default_rng(6)
    y = rng.uniform(0, 100, 60)
    y[40:55] = y[5:20] * 0.5 + 1
    specs = spark.createDataFrame([("s", True)], "spec_id string, human_confirmed_independent boolean")
    one = spark.createDataFrame(pd.DataFrame({"spec_id": "s", "curve_id": "a", "seq": range(60), "x": np.arange(60.0), "y": y}))
    got = CC.curve_segment_similarity(specs, one, one).collect()
    assert [(r.first_start, r.second_start, r.window_length) for r in got] == [(5, 40, 15)]


@pytest.mark.parametrize("threshold,hot", [(3, 20000), (6, 20000), (9, 20000), (6, 0), (6, 3), (3, 2)])
def test_hash_pairs_brute_force(spark, threshold, hot):
    rng = random.Random(threshold)
    base = [rng.getrandbits(64) for _ in range(25)]
    values = base + [b ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 10))) for b in base for _ in range(3)] + [0, 0]
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    df = spark.createDataFrame([(f"i{n}", f"s{n}", v) for n, v in enumerate(signed)], "image_id string, sha256 string, hash long")
    got = [(min(r["hash"], r.other), max(r["hash"], r.other), r.distance) for r in I.hash_similarity_pairs(df, threshold, hot).collect()]
    mask = (1 << 64) - 1
    distinct = sorted(set(signed))
    expected = [(a, b, bin((a ^ b) & mask).count("1")) for n, a in enumerate(distinct) for b in distinct[n + 1 :]]
    expected = [e for e in expected if e[2] <= threshold] + [(v, v, 0) for v in distinct if signed.count(v) > 1]
    assert sorted(got) == sorted(expected)


def test_image_hashes(spark):
    pixels = [(i * 37) % 101 for i in range(72)]
    df = spark.createDataFrame([("a", pixels, pixels[:64])], "image_id string, pixels_9x8 array<int>, pixels_8x8 array<int>")
    row = I.image_hashes(df).select(I.hash_hex(F.col("dhash")).alias("d"), I.hash_hex(F.col("ahash")).alias("a")).first()
    bits = "".join("1" if pixels[r * 9 + c] > pixels[r * 9 + c + 1] else "0" for r in range(8) for c in range(8))
    mean = sum(pixels[:64]) / 64
    assert row.d == f"{int(bits, 2):016x}" and row.a == f"{int(''.join('1' if p >= mean else '0' for p in pixels[:64]), 2):016x}"


def test_formula_recompute(spark):
    data = [("w", "s", 1, 1, None, "4"), ("w", "s", 1, 2, None, "text"), ("w", "s", 10, 1, None, "2"), ("w", "s", 1, 27, None, "5"),
            ("w", "s", 2, 3, "=(A1+A10)*3-1", "17"), ("w", "s", 3, 3, "=a1/A10", "9"), ("w", "s", 4, 3, "=B1+1", "7"), ("w", "s", 5, 3, "=SUM(A1:A10)", "1"),
            ("w", "s", 6, 3, "=AA1-1e1", "3"), ("w", "s", 7, 3, "=A1/0", "3"), ("w", "s", 8, 3, "=2*3", "100")]
    df = spark.createDataFrame(data, "workbook string, sheet string, row long, col int, formula string, value string")
    got = {r.row: r.recomputed for r in R.formula_recompute(df).collect()}
    assert got == {3: 2.0, 6: -5.0, 8: 6.0}


def test_ranges_outside_tolerance_equal_all_pairs(spark, monkeypatch):
    """Counts and ends equal a comparison of every pair; one device holds most rows, spread over chunks."""
    rng = random.Random(8)
    device = lambda: rng.choice([" Dev1", "dev1", "dev1", "dev2", "unknown", None, "dev3"])
    value = lambda scale: rng.choice([None, 0.0, -1.0, *[round(rng.uniform(0, scale), 1) for _ in range(9)]])
    names = list(C.TOLERANCES)
    scales = [1.5, 30.0, 1.0, 25.0]
    measured = [(f"c{i}", device(), *[None if rng.random() < 0.1 else round(rng.uniform(0, s), 1) for s in scales]) for i in range(60)]
    reported = [(device(), *[value(s) for s in scales]) for _ in range(200)]
    schema = "device_id string, " + ", ".join(f"{n} double" for n in names)
    got = C.outside_tolerance(spark.createDataFrame(measured, "curve_id string, " + schema), spark.createDataFrame(reported, schema), C.TOLERANCES)
    got = {(r.curve_id, r.metric): (r.below, r.below_least, r.below_most, r.above, r.above_least, r.above_most) for r in got.collect()}
    expected = {}
    for curve, dev, *values in measured:
        if dev in (None, "unknown"):
            continue
        for name, m, k in zip(names, values, range(4)):
            if m is None:
                continue
            fixed, share = C.TOLERANCES[name]
            same = [r[k + 1] for r in reported if r[0] not in (None, "unknown") and r[0].strip().lower() == dev.strip().lower() and r[k + 1] is not None]
            same = [r for r in same if share is None or r > 0]
            below = [r for r in same if r < (min(m - fixed, m / (1 + share)) if share else m - fixed)]
            above = [r for r in same if r > (max(m + fixed, m / (1 - share)) if share else m + fixed)]
            if below or above:
                ends = lambda part: (len(part), min(part, default=None), max(part, default=None))
                expected[curve, name] = (*ends(below), *ends(above))
    assert got == expected and len(got) > 100
