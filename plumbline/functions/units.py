"""Unit conversion of claims, decay times and photovoltaic values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.cells import NUMBER, to_exact_decimal

# Unit -> (canonical unit, factor).
TIME_UNITS = {
    "ps": ("ns", "0.001"),
    "ns": ("ns", "1"),
    "us": ("ns", "1000"),
    "µs": ("ns", "1000"),
    "microsecond": ("ns", "1000"),
    "microseconds": ("ns", "1000"),
    "ms": ("ns", "1000000"),
    "s": ("ns", "1000000000"),
    "sec": ("ns", "1000000000"),
    "second": ("ns", "1000000000"),
    "seconds": ("ns", "1000000000"),
}
TEMPERATURE_UNITS = {
    "c": ("degC", "0"),
    "°c": ("degC", "0"),
    "degc": ("degC", "0"),
    "celsius": ("degC", "0"),
    "k": ("degC", "273.15"),
    "kelvin": ("degC", "273.15"),
}
CONCENTRATION_UNITS = {
    "mg/ml": ("mg/mL", "1"),
    "g/l": ("mg/mL", "1"),
    "ug/ml": ("mg/mL", "0.001"),
    "µg/ml": ("mg/mL", "0.001"),
    "m": ("M", "1"),
    "mol/l": ("M", "1"),
    "mol l-1": ("M", "1"),
    "mm": ("M", "0.001"),
    "mmol/l": ("M", "0.001"),
    "um": ("M", "0.000001"),
    "µm": ("M", "0.000001"),
    "umol/l": ("M", "0.000001"),
    "µmol/l": ("M", "0.000001"),
    "wt%": ("wt%", "1"),
    "w/w%": ("wt%", "1"),
    "vol%": ("vol%", "1"),
    "v/v%": ("vol%", "1"),
}
EFFICIENCY_UNITS = {
    "%": ("%", "1"),
    "percent": ("%", "1"),
    "percentage": ("%", "1"),
    "fraction": ("%", "100"),
}
UNITLESS = ["-", "none", "unitless", "dimensionless", "n/a", "na"]
OTHER_UNITS = ["%", "nm", "um", "µm", "mm", "cm", "m", "ev", "v", "mv", "ma/cm2", "a/m2", "h", "min", "s"]
DECAY_UNITS = {"ns": "1", "us": "1000", "µs": "1000", "ms": "1000000"}
FORMULA_ALIASES = {
    "amplitude_weighted": "amplitude_weighted",
    "amplitude-weighted": "amplitude_weighted",
    "amplitude weighted": "amplitude_weighted",
    "sum_ai_tau_i_over_sum_ai": "amplitude_weighted",
    "σaiτi/σai": "amplitude_weighted",
    "∑aiτi/∑ai": "amplitude_weighted",
    "intensity_weighted": "intensity_weighted",
    "intensity-weighted": "intensity_weighted",
    "intensity weighted": "intensity_weighted",
    "sum_ai_tau_i_squared_over_sum_ai_tau_i": "intensity_weighted",
    "σaiτi²/σaiτi": "intensity_weighted",
    "∑aiτi²/∑aiτi": "intensity_weighted",
}
TIME_CLAIMS = ["trpl_fit", "tpv_fit"]
NUMERIC_CLAIMS = TIME_CLAIMS + ["anneal_temperature", "concentration", "pce"]


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a small fixed table, NULL for an unknown key."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def _power(factor: str) -> str:
    """The exponent of a power of ten, as text."""
    return str(round(math.log10(float(factor))))


def shifted(c: Column, shift: Column) -> Column:
    """The double nearest to a numeric text times ten to the ``shift``."""
    text = F.trim(c)
    mantissa = F.regexp_extract(text, r"^([^eE]*)", 1)
    exponent = F.coalesce(F.regexp_extract(text, r"[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    moved = F.concat(mantissa, F.lit("E"), (exponent + shift.cast("int")).cast("string"))
    return F.when(text.rlike(NUMBER), moved.try_cast("double"))


def unit_key(c: Column) -> Column:
    text = F.trim(c)
    for old, new in (("μ", "µ"), ("℃", "°C"), ("⁻", "-"), ("²", "2")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def with_normalized_claim(df: DataFrame) -> DataFrame:
    """Add ``claim_value``, ``claim_number``, ``claim_unit`` and ``claim_error``.

    The value is in the canonical unit of the claim type. Every factor is a power of ten,
    so the decimal text is shifted before it becomes a double; equal quantities then
    compare equal whatever unit they were given in. The columns are added in stages, so
    that none of the steps is worked out twice.
    """
    kind, value, key = F.col("claim_type"), F.col("value"), F.col("_key")
    tables = [(TIME_CLAIMS, TIME_UNITS), (["concentration"], CONCENTRATION_UNITS), (["pce"], EFFICIENCY_UNITS)]
    shift = unit = None
    for types, table in tables:
        s = lookup({k: _power(v[1]) for k, v in table.items()}, key)
        u = lookup({k: v[0] for k, v in table.items()}, key)
        shift = F.when(kind.isin(types), s) if shift is None else shift.when(kind.isin(types), s)
        unit = F.when(kind.isin(types), u) if unit is None else unit.when(kind.isin(types), u)
    offset = lookup({k: v[1] for k, v in TEMPERATURE_UNITS.items()}, key).cast("decimal(5,2)")
    unit = (
        unit.when(kind == "anneal_temperature", F.when(key.isin(list(TEMPERATURE_UNITS)), "degC"))
        .when(kind.isin("layer_order", "composition"), F.when(key.isin(UNITLESS), "dimensionless"))
        .when(kind == "other", F.when(key.isin(UNITLESS), F.lit("dimensionless")).when(key.isin(OTHER_UNITS), key))
    )
    numeric = kind.isin(NUMERIC_CLAIMS)
    staged = df.withColumn("_key", unit_key(F.col("unit"))).withColumns(
        {
            "claim_unit": unit,
            "_number": F.when(kind == "anneal_temperature", (to_exact_decimal(value) - offset).cast("double")).otherwise(
                shifted(value, shift)
            ),
        }
    )
    known = kind.isin(NUMERIC_CLAIMS + ["layer_order", "composition", "other"])
    error = (
        F.when(~known, F.lit("unsupported claim type"))
        .when(F.col("claim_unit").isNull(), F.lit("unsupported unit"))
        .when(numeric & F.col("_number").isNull(), F.lit("value is not numeric"))
    )
    staged = staged.withColumn("claim_error", error)
    ok = F.col("claim_error").isNull()
    return staged.withColumns(
        {
            "claim_number": F.when(ok & numeric, F.col("_number")),
            "claim_unit": F.when(ok, F.col("claim_unit")),
            "claim_value": F.when(ok, F.when(numeric, F.col("_number").cast("string")).otherwise(value)),
        }
    ).drop("_key", "_number")


def normalize_decay_time(value: Column, unit: Column) -> Column:
    """Nanoseconds as a double; NULL for unknown units and non-positive values."""
    key = F.lower(F.replace(F.trim(unit), F.lit("μ"), F.lit("µ")))
    number = shifted(value.cast("string"), lookup({k: _power(v) for k, v in DECAY_UNITS.items()}, key))
    return F.when(number > 0, number)


def average_formula(c: Column) -> Column:
    return lookup(FORMULA_ALIASES, F.lower(F.trim(c)))


def average_lifetime(components: Column, formula: Column) -> Column:
    """Declared average of decay components, in ns.

    ``components`` is an array of ``struct(amplitude, lifetime, unit)``. The result is
    NULL for fewer than two components or any that is not positive.
    """
    items = F.transform(
        components,
        lambda c: F.struct(
            c["amplitude"].cast("double").alias("a"), normalize_decay_time(c["lifetime"], c["unit"]).alias("t")
        ),
    )
    zero = F.lit(0.0)
    start = F.struct(zero.alias("a"), zero.alias("at"), zero.alias("att"), F.lit(0).alias("n"), F.lit(True).alias("ok"))
    kind = average_formula(formula)

    def add(acc, c):
        return F.struct(
            (acc["a"] + c["a"]).alias("a"),
            (acc["at"] + c["a"] * c["t"]).alias("at"),
            (acc["att"] + c["a"] * c["t"] * c["t"]).alias("att"),
            (acc["n"] + 1).alias("n"),
            (acc["ok"] & F.coalesce((c["a"] > 0) & (c["t"] > 0), F.lit(False))).alias("ok"),
        )

    def finish(acc):
        return F.when(
            acc["ok"] & (acc["n"] >= 2),
            F.when(kind == "amplitude_weighted", F.try_divide(acc["at"], acc["a"])).when(
                kind == "intensity_weighted", F.try_divide(acc["att"], acc["at"])
            ),
        )

    return F.aggregate(items, start, add, finish)


def loose_number(c: Column) -> Column:
    """A double from a text after dropping everything but digits, points, signs and exponents."""
    cleaned = F.regexp_replace(F.trim(c), r"[^0-9.\-eE]", "")
    return F.when(cleaned.rlike(NUMBER), cleaned.try_cast("double"))


def normalize_pv_value(field: Column, raw: Column, hint: Column) -> Column:
    """``struct(value, warning)`` for one photovoltaic metric in its canonical unit."""
    v = loose_number(raw)
    hint = F.coalesce(hint, F.lit(""))
    jsc = F.when(hint == "a/m2", v * 0.1).when(hint == "a/cm2", v * 1000.0).otherwise(v)
    ff = F.when((hint == "%") | ((v > 1.0) & (v <= 100.0)), v / 100.0).otherwise(v)
    pce = F.when((hint == "fraction") | ((v >= 0.0) & (v <= 1.0)), v * 100.0).otherwise(v)
    light = F.when(hint == "w/m2", v * 0.1).otherwise(v)
    is_pce = field.isin(
        "pce_percent",
        "stabilized_pce_percent",
        "stabilized_power_output_percent",
        "reverse_scan_pce_percent",
        "forward_scan_pce_percent",
    )
    is_area = field.isin("active_area_cm2", "aperture_area_cm2", "mask_area_cm2")
    is_jsc = field.isin("jsc_ma_cm2", "eqe_jsc_ma_cm2")
    value = (
        F.when(field == "voc_v", F.when(hint == "mv", v / 1000.0).otherwise(v))
        .when(is_jsc, jsc)
        .when(field == "ff", ff)
        .when(is_pce, pce)
        .when(is_area, F.when(hint == "mm2", v * 0.01).otherwise(v))
        .when(field == "light_intensity_mw_cm2", F.when(light > 0, light))
        .otherwise(v)
    )
    warning = (
        F.when(v.isNull(), F.lit("not numeric"))
        .when((field == "voc_v") & (v > 20) & (hint == ""), "possible mV without a unit")
        .when(is_jsc & (hint == "a/m2"), "converted from A/m2")
        .when(is_jsc & (hint == "a/cm2"), "converted from A/cm2")
        .when((field == "ff") & (hint == "") & (v > 1.0) & (v <= 100.0), "percent taken as fraction")
        .when((field == "ff") & (hint != "%") & (v > 100.0), "fill factor above 100")
        .when(is_pce & ((hint == "fraction") | ((v >= 0.0) & (v <= 1.0))), "fraction taken as percent")
        .when(is_pce & (v > 100.0), "efficiency above 100 %")
        .when(is_area & (hint == "mm2"), "converted from mm2")
        .when((field == "light_intensity_mw_cm2") & (light <= 0), "intensity must be positive")
        .when((field == "light_intensity_mw_cm2") & (hint == "w/m2"), "converted from W/m2")
        .when((field == "bandgap_ev") & (hint == "nm"), "bandgap given in nm")
    )
    return F.struct(value.alias("value"), warning.alias("warning"))
