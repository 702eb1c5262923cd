"""Photovoltaic tables: typed metric rows, consistency checks and completeness checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import pv as V
from plumbline.functions.cells import is_missing, unit_hint
from plumbline.functions.risk import stable_id
from plumbline.functions.units import loose_number, normalize_pv_value
from plumbline.schemas import as_findings, evidence, metadata, text_list
from plumbline.session import materialize

TABLE = ["package_id", "table_id", "source_file"]


def map_headers(cells: DataFrame) -> DataFrame:
    """Meaning of every distinct header; patterns run once per name, not once per cell."""
    m = V.map_pv_header(F.col("column_name"))
    return (
        cells.select("column_name")
        .distinct()
        .select("column_name", m.alias("m"))
        .select(
            "column_name",
            F.col("m.field").alias("field"),
            F.col("m.confidence").alias("confidence"),
            F.coalesce("m.unit_hint", unit_hint(F.col("column_name"))).alias("unit_hint"),
            F.when(F.col("m").isNull(), V.header_role_pv(F.col("column_name"))).alias("role"),
            F.lower(F.trim("column_name")).rlike(V.any_pattern(V.LIGHT)).alias("is_light"),
        )
    )


def pv_metric_rows(cells: DataFrame) -> DataFrame:
    """One typed row per table row.

    A later column with the same meaning wins. ``raw_cells`` keeps the row as written.
    The only grouping is by table row, so its tasks are even whatever the table sizes.
    """
    value = F.trim("value")
    # as files: their small size is known before the cells move, which else meet by their few headers;
    # the cells of a row come together first, so that a file of few row groups is no few tasks either
    mapped = cells.repartition(*TABLE, "row_index").join(materialize(map_headers(cells), "headers"), "column_name", "left")
    norm = normalize_pv_value(F.col("field"), F.col("value"), F.col("unit_hint"))
    staged = mapped.select(
        *TABLE, "row_index", "col_index", "column_name", "value", "field", "role", "is_light",
        F.when(F.col("field").isin(V.NUMBER_FIELDS) & (value != ""), norm).alias("n"),
        F.when(F.col("field").isin(V.TEXT_FIELDS) & (value != ""), value).alias("t"),
        value.alias("stripped"),
    )

    def last(flag: Column, item: Column) -> Column:
        return F.max_by(item, F.when(flag, F.col("col_index")))

    numbers = [
        last((F.col("field") == f) & F.col("n").isNotNull(), F.col("n.value")).alias(f) for f in V.NUMBER_FIELDS
    ]
    texts = [last((F.col("field") == f) & F.col("t").isNotNull(), F.col("t")).alias(f) for f in V.TEXT_FIELDS]
    roles = [last(F.col("role") == r, F.col("stripped")).alias(r) for r, _, _ in V.ROLE_RULES]
    rows = staged.groupBy(*TABLE, "row_index").agg(
        *numbers,
        *texts,
        *roles,
        F.max(F.coalesce("is_light", F.lit(False))).alias("illumination_reported"),
        F.sort_array(F.collect_list(F.struct("col_index", "column_name", "value"))).alias("raw_cells"),
        F.sort_array(
            F.collect_list(F.when(F.col("n.warning").isNotNull(), F.struct("col_index", "field", F.col("n.warning").alias("warning"))))
        ).alias("warnings"),
    )
    device = F.coalesce(F.nullif(F.col("device_id"), F.lit("")), F.concat(F.lit("device-"), F.col("row_index").cast("string")))
    return rows.withColumn("device_id", device)


def _pv_findings(rows: DataFrame, rule: str, location: Column, note: Column, text, extra: dict | None = None, ids: list[str] | None = None):
    ids = ids or ["row_index"]
    return as_findings(
        rows,
        finding_id=stable_id("pv-", F.lit(rule), *[F.col(t) for t in TABLE], *[F.col(i) for i in ids], ordered=True),
        package_id=F.col("package_id"),
        finding_category="pv_consistency",
        type=F.col("kind"),
        rule_id=F.lit(rule) if isinstance(rule, str) else rule,
        risk_level=F.col("risk_level"),
        source_file=F.col("source_file"),
        table_id=F.col("table_id"),
        evidence=evidence(F.col("source_file"), location, note),
        manual_requests=text_list("Check the raw measurement, its units and the measurement protocol."),
        alternative_explanations=text_list("Rounding or a unit convention.", "Values of different scans or devices.", "A transcription error."),
        limitations=text_list("Uses only what the parsed table states."),
        safe_report_language=text,
        metadata=metadata(kind=F.col("kind"), **(extra or {})),
    )


def _row(c="row_index") -> Column:
    return F.concat(F.lit("row "), F.col(c).cast("string"))


def pce_consistency_rows(rows: DataFrame, tol_abs: float = 0.3, tol_rel: float = 0.03) -> DataFrame:
    """Rows whose efficiency departs from Voc x Jsc x FF / P, or whose illumination is unusable.

    100 mW/cm2 is assumed only where the table has no illumination column at all.
    """
    complete = rows.where(
        F.col("voc_v").isNotNull() & F.col("jsc_ma_cm2").isNotNull() & F.col("ff").isNotNull() & F.col("pce_percent").isNotNull()
    )
    light = F.col("light_intensity_mw_cm2")
    unusable = light.isNull() & F.col("illumination_reported")
    recomputed = F.col("voc_v") * F.col("jsc_ma_cm2") * F.col("ff") / F.coalesce(light, F.lit(100.0)) * 100.0
    gap = F.abs(F.col("pce_percent") - F.col("recomputed_pce"))
    relative = gap / F.greatest(F.abs("pce_percent"), F.lit(1e-6))
    return (
        complete.withColumn("recomputed_pce", F.when(~unusable, recomputed))
        .withColumn("kind", F.when(unusable, "missing_illumination").when((gap > tol_abs) | (relative > tol_rel), "pce_mismatch"))
        .where(F.col("kind").isNotNull())
        .withColumn("risk_level", F.when(F.col("kind") == "pce_mismatch", "medium").otherwise("low"))
    )


def pce_consistency(rows: DataFrame) -> DataFrame:
    found = pce_consistency_rows(rows)
    rule = "pv_pce_consistency"
    return _pv_findings(
        found, rule, _row(), F.concat_ws(" ", F.lit("reported"), F.col("pce_percent").cast("string"), F.lit("recomputed"), F.col("recomputed_pce").cast("string")),
        F.when(F.col("kind") == "pce_mismatch", F.format_string("Efficiency of row %d differs from Voc x Jsc x FF; check units and illumination.", "row_index"))
        .otherwise(F.format_string("Illumination of row %d cannot be used; efficiency was not recomputed.", "row_index")),
        {"recomputed_pce": F.col("recomputed_pce"), "device_id": F.col("device_id")},
    )


def eqe_jv_rows(rows: DataFrame, tol_abs: float = 1.0, tol_rel: float = 0.10, low_rel: float = 0.05) -> DataFrame:
    """Rows whose integrated current density departs from the J-V one."""
    jv, eqe = F.col("jsc_ma_cm2"), F.col("eqe_jsc_ma_cm2")
    gap = F.abs(jv - eqe)
    relative = gap / F.abs(jv)
    risk = F.when((gap > tol_abs) & (relative > tol_rel), "medium").when(relative > low_rel, "low")
    return (
        rows.where(F.abs(jv) >= 1e-6)
        .withColumns({"relative_gap": relative, "risk_level": risk, "kind": F.lit("eqe_jv_gap")})
        .where(F.col("risk_level").isNotNull())
    )


def eqe_jv_consistency(rows: DataFrame) -> DataFrame:
    return _pv_findings(
        eqe_jv_rows(rows), "pv_eqe_jv_jsc_consistency", _row(), F.concat(F.lit("relative gap "), F.col("relative_gap").cast("string")),
        F.format_string("EQE and J-V current densities of row %d differ; check spectrum and calibration.", "row_index"),
        {"relative_gap": F.col("relative_gap")},
    )


def voc_loss_rows(rows: DataFrame, high: float = 0.65, low: float = 0.05) -> DataFrame:
    """Rows with an implausible voltage, or a very small or large loss against the bandgap."""
    voc, loss = F.col("voc_v"), F.col("bandgap_ev") - F.col("voc_v")
    kind = F.when(voc > 10.0, "voltage_unit").when(loss < low, "small_loss").when(loss > high, "large_loss")
    return (
        rows.withColumns({"voc_loss": loss, "kind": kind})
        .where(F.col("kind").isNotNull())
        .withColumn("risk_level", F.when(F.col("kind") == "large_loss", "low").otherwise("medium"))
    )


def voc_loss(rows: DataFrame) -> DataFrame:
    return _pv_findings(
        voc_loss_rows(rows), "pv_voc_loss_consistency", _row(), F.concat(F.lit("loss "), F.col("voc_loss").cast("string")),
        F.format_string("Voltage loss of row %d (%s) should be checked.", F.col("row_index"), F.col("kind")),
        {"voc_loss": F.col("voc_loss")},
    )


# Header words of tandem tables.
TANDEM_WORDS = [
    "tandem", "2t", "4t", "top cell", "bottom cell", "subcell", "current matching", "filtered jsc", "iii-v", "si/perovskite",
    "perovskite/si", "gaas", "ge", "ingaas",
]


def tandem_rows(rows: DataFrame) -> DataFrame:
    """Tandem rows with their issues: 4T sum exceeded, 2T mismatch, 2T reporting gap.

    The state of a row comes from its cells in column order; all of it is array
    functions on the row itself.
    """
    names = F.transform("raw_cells", lambda c: F.lower(c["column_name"]))
    rows = rows.where(F.exists(names, lambda n: V.contains_any(n, TANDEM_WORDS)))
    filled = F.filter("raw_cells", lambda c: F.trim(c["value"]) != "")
    rows = rows.withColumn(
        "_c",
        F.transform(
            filled,
            lambda c: F.struct(
                F.lower(c["column_name"]).alias("h"), F.lower(c["value"]).alias("s"), loose_number(c["value"]).alias("x")
            ),
        ),
    )

    def wires(n):
        return lambda c: V.contains_any(c["h"], [f"{n}t", f"{n}-terminal"]) | V.contains_any(c["s"], [f"{n}t", f"{n}-terminal"])

    def top(c):
        return V.contains_any(c["h"], ["top", "front", "subcell1"])

    def bottom(c):
        return ~top(c) & V.contains_any(c["h"], ["bottom", "back", "rear", "subcell2"])

    def total(c):
        return ~top(c) & ~bottom(c) & V.contains_any(c["h"], ["total", "tandem"])

    def current(c):
        return V.contains_any(c["h"], ["jsc", "current"])

    def power(c):
        return V.contains_any(c["h"], ["pce", "eff", "eta", "η"])

    def last(condition):
        return F.try_element_at(F.filter("_c", condition), F.lit(-1))

    tags = F.filter(F.transform("_c", lambda c: F.when(wires(2)(c), "2t").when(wires(4)(c), "4t")), lambda t: t.isNotNull())
    totals = last(lambda c: total(c) & power(c))
    rows = rows.withColumns(
        {
            "top_jsc": last(lambda c: top(c) & current(c))["x"],
            "bottom_jsc": last(lambda c: bottom(c) & current(c))["x"],
            "top_pce": last(lambda c: top(c) & ~current(c) & power(c))["x"],
            "bottom_pce": last(lambda c: bottom(c) & ~current(c) & power(c))["x"],
            "total_pce": F.when(totals.isNotNull(), totals["x"]).otherwise(F.col("pce_percent")),
            "_four": F.array_contains(tags, "4t"),
            "_two": F.coalesce(F.try_element_at(tags, F.lit(-1)) == "2t", F.lit(False)),
            "_bias": F.exists("raw_cells", lambda c: V.contains_any(F.lower(c["column_name"]), ["bias", "filter"])),
        }
    )
    sums = F.col("top_pce") + F.col("bottom_pce")
    stated = F.col("_four") | F.col("_two")
    near_sum = F.coalesce(F.abs(F.col("total_pce") - sums) < 1.0, F.lit(False))
    rows = rows.withColumns({"is_4t": F.when(stated, F.col("_four")).otherwise(near_sum), "is_2t": F.when(stated, F.col("_two")).otherwise(~near_sum)})
    smaller = F.least("top_jsc", "bottom_jsc")
    both = F.col("top_jsc").isNotNull() & F.col("bottom_jsc").isNotNull()
    mismatch = F.when(both & (smaller > 0), F.abs(F.col("top_jsc") - F.col("bottom_jsc")) / smaller)
    no_current = F.col("top_jsc").isNull() & F.col("bottom_jsc").isNull()
    issues = F.array_compact(
        F.array(
            F.when(F.col("is_4t") & (F.col("total_pce") > sums + 0.3), F.lit("total_exceeds_sum")),
            F.when(F.col("is_2t") & (mismatch > 0.15), F.lit("current_mismatch")),
            F.when(F.col("is_2t") & (~F.col("_bias") | no_current), F.lit("reporting_gap")),
        )
    )
    return rows.withColumn("mismatch", mismatch).withColumn("kind", F.explode(issues)).withColumn(
        "risk_level", F.when(F.col("kind") == "reporting_gap", "low").otherwise("medium")
    ).drop("_c", "_four", "_two", "_bias")


def tandem_consistency(rows: DataFrame) -> DataFrame:
    return _pv_findings(
        tandem_rows(rows), "pv_tandem_current_matching", _row(), F.concat(F.lit("tandem "), "kind"),
        F.format_string("Tandem values of row %d (%s) should be checked.", F.col("row_index"), F.col("kind")),
        {"mismatch": F.col("mismatch"), "total_pce": F.col("total_pce")}, ["row_index", "kind"],
    )


def table_columns(cells: DataFrame) -> DataFrame:
    """Lower-case headers of each table with two flags: any text in it, any non-missing value."""
    return cells.groupBy(*TABLE, "col_index", "column_name").agg(
        F.max(F.trim("value") != "").alias("filled"), F.max(~is_missing(F.col("value"))).alias("valued")
    ).withColumn("h", F.lower("column_name"))


def _presence(rows: DataFrame, fields: list[str]) -> DataFrame:
    return rows.groupBy(*TABLE).agg(*[F.max(F.col(f).isNotNull()).alias(f"has_{f}") for f in fields])


def _any_header(words: list[str], extra: Column | None = None) -> Column:
    condition = V.contains_any(F.col("h"), words)
    return F.max(condition if extra is None else condition & extra)


PV_FIELDS = ["voc_v", "jsc_ma_cm2", "ff", "pce_percent", "eqe_jsc_ma_cm2", "bandgap_ev", "active_area_cm2", "aperture_area_cm2"]


def _has(*fields: str) -> Column:
    out = F.col(f"has_{fields[0]}")
    for f in fields[1:]:
        out = out | F.col(f"has_{f}")
    return out


# Header words that show which items a table reports.
REPORTING_WORDS = {
    "stability": ["stabil", "t80", "degrad", "retent", "isos", "aging"],
    "stats": ["std", "dev", "mean", "avg", "average", "error", "champion", "best", "number", "count"],
    "calib": ["calib", "ref cell", "simulator", "spectral mismatch"],
    "tandem": ["tandem", "2t", "4t", "subcell", "top cell", "bottom cell", "filter"],
    "bias": ["bias", "filtered"],
}


def table_completeness(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Recommended reporting items that a table with photovoltaic values leaves out."""
    fields = PV_FIELDS + [
        "mask_area_cm2", "scan_direction", "scan_rate", "temperature_c", "humidity_percent", "t80_h", "stabilized_pce_percent",
    ]
    heads = table_columns(cells).groupBy(*TABLE).agg(
        *[_any_header(words).alias(name) for name, words in REPORTING_WORDS.items()],
    )
    t = _presence(rows, fields).join(heads, TABLE).where(_has(*PV_FIELDS))
    missing = F.array_compact(
        F.array(
            F.when(~_has("active_area_cm2", "aperture_area_cm2", "mask_area_cm2"), F.lit("device area")),
            F.when(~_has("scan_direction"), F.lit("scan direction")),
            F.when(~_has("scan_rate"), F.lit("scan rate")),
            F.when(~_has("temperature_c", "humidity_percent"), F.lit("test environment")),
            F.when(~_has("eqe_jsc_ma_cm2"), F.lit("EQE-integrated Jsc")),
            F.when(F.col("stability") & ~_has("t80_h", "stabilized_pce_percent"), F.lit("stability details")),
            F.when(~F.col("stats"), F.lit("cell statistics")),
            F.when(~F.col("calib"), F.lit("light source calibration")),
            F.when(F.col("tandem") & ~F.col("bias"), F.lit("tandem bias")),
        )
    )
    return t.select(*TABLE, missing.alias("missing")).where(F.size("missing") > 0)


# Header words of stability tables.
STABILITY_WORDS = ["stability", "t80", "duration", "mpp", "isos", "degradation", "retention", "aging", "damp heat", "light soaking", "thermal"]

# Header words of each condition of a stress test, and conditions whose column must hold a value.
CONDITION_WORDS = {
    "duration": ["duration", "time", "hours", "t80"],
    "temp": ["temp", "temperature"],
    "humidity": ["humidity", "rh", "atmosphere", "nitrogen", "n2", "air", "ambient"],
    "light": ["light", "illumination", "soaking", "led", "suns", "am1.5", "dark"],
    "bias": ["bias", "mpp", "load", "open circuit", "short circuit", "voc", "jsc", "electrical"],
    "encap": ["encapsulation", "encap", "epoxy", "glass", "capsulation"],
    "retention": ["retention", "degradation", "ret", "pce", "efficiency", "drop", "decay", "initial", "final"],
}
VALUED_CONDITIONS = ["temp", "humidity"]


def stability_completeness(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Stress-test conditions that a table with stability data leaves out."""
    fields = [
        "t80_h", "stabilized_pce_percent", "stabilized_power_output_percent", "mpp_tracking", "isos_protocol", "stability_duration_h",
        "temperature_c", "humidity_percent", "encapsulation",
    ]
    valued = F.col("valued")
    heads = table_columns(cells).groupBy(*TABLE).agg(
        _any_header(STABILITY_WORDS).alias("stability"),
        *[_any_header(words, valued if name in VALUED_CONDITIONS else None).alias(name) for name, words in CONDITION_WORDS.items()],
    )
    t = _presence(rows, fields).join(heads, TABLE)
    t = t.where(F.col("stability") | _has(*fields[:6]))
    missing = F.array_compact(
        F.array(
            F.when(~(F.col("duration") | _has("t80_h", "stability_duration_h")), F.lit("duration")),
            F.when(~(F.col("temp") | _has("temperature_c")), F.lit("temperature")),
            F.when(~(F.col("humidity") | _has("humidity_percent")), F.lit("humidity or atmosphere")),
            F.when(~F.col("light"), F.lit("illumination")),
            F.when(~(F.col("bias") | _has("mpp_tracking")), F.lit("electrical bias")),
            F.when(~(F.col("encap") | _has("encapsulation")), F.lit("encapsulation")),
            F.when(~(F.col("retention") | _has("stabilized_pce_percent", "stabilized_power_output_percent")), F.lit("retention")),
        )
    )
    return t.select(*TABLE, missing.alias("missing")).where(F.size("missing") > 0)


# Method -> (trigger words as whole tokens, [(missing item, header words)]).
CHARACTERIZATION = {
    "XRD": (
        ["xrd", "2theta", "2-theta", "diffraction"],
        [("radiation source", ["source", "radiation", "cu", "ka", "wavelength"]), ("scan rate or step size", ["rate", "step", "speed"])],
    ),
    "XPS": (["xps", "binding energy", "photoelectron"], [("calibration reference", ["calib", "reference", "charge", "c1s", "fitting"])]),
    "PL/TRPL": (["pl", "trpl", "photoluminescence", "lifetime", "decay"], [("excitation", ["excitation", "laser", "fluence", "power"])]),
    "UV-vis/Absorbance": (
        ["uv-vis", "uv_vis", "absorbance", "absorption", "transmission"],
        [("baseline or substrate reference", ["baseline", "substrate", "reference", "blank"])],
    ),
    "SEM/TEM": (["sem", "tem", "micrograph", "transmission electron"], [("scale or voltage", ["scale", "bar", "magnification", "voltage", "kv"])]),
    "AFM": (["afm", "roughness", "rms", "microscopy"], [("scan size or roughness", ["size", "area", "roughness", "scan", "rms", "rq"])]),
    "GIWAXS": (["giwaxs", "grazing incidence"], [("incidence angle or beam", ["angle", "incidence", "wavelength", "beam"])]),
}


def _token_pattern(aliases: list[str]) -> str:
    """Whole-token match of an alias, with any separators between its tokens."""
    import re

    bodies = ["[^a-z0-9]+".join(re.findall("[a-z0-9]+", a)) for a in aliases]
    return "(?:^|[^a-z0-9])(?:" + "|".join(bodies) + ")(?:$|[^a-z0-9])"


def characterization_completeness(cells: DataFrame) -> DataFrame:
    """Measurement details that tables of a characterization method leave out."""
    aggregates, items = [], []
    for i, (method, (triggers, needs)) in enumerate(CHARACTERIZATION.items()):
        aggregates.append(F.max(F.col("h").rlike(_token_pattern(triggers))).alias(f"t{i}"))
        missing = []
        for j, (label, words) in enumerate(needs):
            aggregates.append(_any_header(words).alias(f"n{i}_{j}"))
            missing.append(F.when(~F.col(f"n{i}_{j}"), F.lit(label)))
        gone = F.array_compact(F.array(*missing))
        items.append(F.when(F.col(f"t{i}") & (F.size(gone) > 0), F.struct(F.lit(method).alias("method"), gone.alias("missing"))))
    t = table_columns(cells).groupBy(*TABLE).agg(*aggregates)
    return t.select(*TABLE, F.explode(F.array_compact(F.array(*items))).alias("i")).select(*TABLE, "i.method", "i.missing")


# Fixed values: (rule, category, required evidence, risk ceiling).
EVIDENCE_RULES = [
    ("pv_jv_scan_direction_completeness", "J-V reporting", ["scan_direction"], "low"),
    ("pv_jv_hysteresis_reporting", "J-V reporting", ["forward_scan_pce_percent", "reverse_scan_pce_percent"], "medium"),
    ("pv_jv_mask_area_completeness", "J-V reporting", ["mask_area_cm2"], "low"),
    ("pv_jv_light_intensity_completeness", "J-V reporting", ["light_intensity_mw_cm2"], "low"),
    ("pv_stabilized_power_output_reporting", "J-V reporting", ["stabilized_power_output_percent"], "low"),
    ("pv_mpp_tracking_completeness", "J-V reporting", ["mpp_tracking"], "low"),
    ("pv_eqe_integrated_jsc_consistency", "EQE/J-V", ["eqe_jsc_ma_cm2", "jsc_ma_cm2"], "high"),
    ("pv_eqe_spectrum_range_completeness", "EQE/J-V", ["eqe_spectrum_range"], "low"),
    ("pv_am15g_reference_completeness", "EQE/J-V", ["am15g_reference_standard"], "low"),
    ("pv_eqe_reflection_correction", "EQE/J-V", ["reflection_correction_applied"], "low"),
    ("pv_isos_condition_reporting", "Stability", ["isos_protocol"], "low"),
    ("pv_stability_uv_dose", "Stability", ["uv_exposure_dose"], "low"),
    ("pv_stability_humidity", "Stability", ["humidity_percent"], "low"),
    ("pv_stability_temperature", "Stability", ["temperature_c"], "low"),
    ("pv_stability_encapsulation", "Stability", ["encapsulation"], "low"),
    ("pv_stability_tracking_mode", "Stability", ["stability_tracking_mode"], "low"),
    ("pv_tandem_bandgap_completeness", "Tandem", ["bandgap_ev"], "low"),
    ("pv_tandem_current_matching", "Tandem", ["eqe_jsc_ma_cm2"], "medium"),
    ("pv_tandem_spectral_mismatch", "Tandem", ["spectral_mismatch_factor"], "low"),
    ("pv_tandem_aperture_area", "Tandem", ["aperture_area_cm2"], "low"),
    ("pv_tandem_shadow_mask", "Tandem", ["shadow_mask_present"], "low"),
    ("pv_tandem_connection_consistency", "Tandem", ["connection_type"], "medium"),
    ("pv_materials_composition", "Materials characterization", ["chemical_composition"], "low"),
    ("pv_materials_sam_interface", "Materials characterization", ["interface_treatment"], "low"),
    ("pv_materials_sputter_damage", "Materials characterization", ["deposition_damage_mitigation"], "low"),
    ("pv_materials_metadata", "Materials characterization", ["materials_characterization_metadata"], "low"),
]
# Other header words that count as an item of evidence.
EVIDENCE_ALIASES = {
    "eqe_spectrum_range": ["eqe_range", "wavelength", "nm", "spectral range"],
    "am15g_reference_standard": ["am1.5", "reference", "standard", "astm", "iec"],
    "reflection_correction_applied": ["reflection", "correction", "reflectance"],
    "uv_exposure_dose": ["uv", "dose", "exposure"],
    "stability_tracking_mode": ["tracking", "shelf", "continuous", "storage"],
    "spectral_mismatch_factor": ["mismatch", "smf", "calibration"],
    "shadow_mask_present": ["shadow", "mask", "aperture"],
    "connection_type": ["connection", "2t", "4t", "terminal"],
    "chemical_composition": ["composition", "stoichiometry", "halide", "ratio"],
    "interface_treatment": ["interface", "sam", "passivation", "treatment"],
    "deposition_damage_mitigation": ["sputter", "ald", "damage", "buffer"],
    "materials_characterization_metadata": ["metadata", "xrd", "sem", "pl", "ups", "xps"],
}


def evidence_ruleset(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Required evidence that a photovoltaic table lacks, per rule.

    An item is present with a value of its field, or with a filled header that holds
    one of its other words, that it contains, or that contains it. All items of a
    table are flags of one grouping.
    """
    names = sorted({e for _, _, needed, _ in EVIDENCE_RULES for e in needed})
    known = [f for f in names if f in V.NUMBER_FIELDS + V.TEXT_FIELDS]
    h = F.col("h")

    def by_header(name):
        loose = h.contains(name) | F.lit(name).contains(h)
        if name in EVIDENCE_ALIASES:
            loose = loose | V.contains_any(h, EVIDENCE_ALIASES[name])
        return F.max(loose & F.col("filled")).alias(f"head_{name}")

    heads = table_columns(cells).groupBy(*TABLE).agg(*[by_header(n) for n in names])
    any_pv = [
        f for f in V.NUMBER_FIELDS + V.TEXT_FIELDS if f != "stability_duration_h"
    ]
    t = _presence(rows, sorted(set(any_pv) | set(known))).join(heads, TABLE).where(_has(*any_pv))

    def absent(name):
        present = F.col(f"head_{name}")
        return ~(present | F.col(f"has_{name}")) if name in known else ~present

    rules = [
        F.struct(
            F.lit(rule).alias("rule_id"),
            F.lit(category).alias("category"),
            F.lit(ceiling).alias("risk_ceiling"),
            F.array_compact(F.array(*[F.when(absent(n), F.lit(n)) for n in needed])).alias("missing"),
        )
        for rule, category, needed, ceiling in EVIDENCE_RULES
    ]
    return t.select(*TABLE, F.explode(F.array(*rules)).alias("r")).select(*TABLE, "r.*").where(F.size("missing") > 0)


def completeness_findings(gaps: DataFrame, rule: str, category: str = "pv_evidence_completeness") -> DataFrame:
    """Findings from any of the completeness results; they carry a ``missing`` list."""
    has = set(gaps.columns)
    rule_col = F.col("rule_id") if "rule_id" in has else F.lit(rule)
    what = F.concat_ws(", ", "missing")
    part = F.col("method") if "method" in has else F.lit("")
    return as_findings(
        gaps,
        finding_id=stable_id("gap-", rule_col, part, *[F.col(t) for t in TABLE], ordered=True),
        package_id=F.col("package_id"),
        finding_category=category,
        type="reporting_gap",
        rule_id=rule_col,
        risk_level="low",
        source_file=F.col("source_file"),
        table_id=F.col("table_id"),
        evidence=evidence(F.col("source_file"), F.concat(F.lit("table "), "table_id"), what),
        manual_requests=text_list("Look for these items in the methods section or the supplement."),
        alternative_explanations=text_list("The items are reported outside the parsed table."),
        limitations=text_list("Headers and values of one table only."),
        safe_report_language=F.concat(F.lit("Not found in the table: "), what),
        metadata=metadata(missing=what, method=part),
    )


# Domain -> field -> header patterns.
DOMAIN_FIELDS = {
    "clinical": {
        "trial_id": [r"\btrial[_ -]?id\b", r"\bnct\b", r"registration"],
        "arm_name": [r"\barm\b", r"group", r"treatment"],
        "group_size": [r"\bn\b", r"sample[_ -]?size", r"group[_ -]?size"],
        "age_mean": [r"age.*mean", r"mean.*age"],
        "age_sd": [r"age.*sd", r"age.*standard deviation"],
        "p_val": [r"\bp[_ -]?val", r"\bp value\b"],
    },
    "biomedical": {
        "gene_symbol": [r"gene", r"symbol", r"target"],
        "expression_level": [r"expression", r"fold[_ -]?change", r"qpcr"],
        "band_intensity": [r"band.*intensity", r"western", r"blot"],
        "p_val": [r"\bp[_ -]?val", r"\bp value\b"],
        "sample_id": [r"sample[_ -]?id", r"specimen"],
    },
    "chemistry": {
        "peak_shift": [r"peak", r"shift", r"chemical shift", r"\bppm\b"],
        "multiplicity": [r"multiplicity", r"\bsinglet\b", r"\bdoublet\b"],
        "coupling_constant": [r"coupling", r"\bj\b.*hz", r"constant"],
        "element_percentage": [r"element", r"percent", r"analysis"],
    },
    "materials_characterization": {
        "characterization_method": [r"xrd", r"xps", r"sem", r"tem", r"method"],
        "instrument_model": [r"instrument", r"model", r"manufacturer"],
        "voltage": [r"voltage", r"\bkv\b", r"accelerating"],
        "pressure": [r"pressure", r"vacuum", r"\bpa\b", r"\btorr\b"],
    },
    "ai_ml": {
        "model_name": [r"model", r"architecture"],
        "dataset_name": [r"dataset", r"benchmark", r"corpus"],
        "metric": [r"metric", r"accuracy", r"f1", r"auc"],
        "reported_score": [r"score", r"reported", r"performance"],
    },
    "psychology_social_science": {
        "mean": [r"\bmean\b", r"\bm\b"],
        "std_dev": [r"std", r"standard deviation", r"\bsd\b"],
        "t_value": [r"\bt\b", r"t[_ -]?value"],
        "f_value": [r"\bf\b", r"f[_ -]?value"],
        "df": [r"\bdf\b", r"degrees of freedom"],
        "sample_size": [r"\bn\b", r"sample[_ -]?size"],
    },
}


def route_domain(cells: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Share of each domain's fields found among the headers of a table, best domain first.

    Patterns run once per distinct header name.
    """
    name = F.lower(F.trim("column_name"))
    fields = [(d, f, V.any_pattern(p)) for d, fs in DOMAIN_FIELDS.items() for f, p in fs.items()]
    hits = F.array_compact(F.array(*[F.when(name.rlike(p), F.lit(i)) for i, (_, _, p) in enumerate(fields)]))
    names = cells.select("column_name").distinct().select("column_name", hits.alias("hits")).where(F.size("hits") > 0)
    per_table = (
        cells.select(*TABLE, "column_name").distinct().join(names, "column_name").select(*TABLE, F.explode("hits").alias("hit")).distinct()
    )
    tables = cells.select(*TABLE).distinct()
    counts = per_table.groupBy(*TABLE).agg(F.collect_set("hit").alias("hits"))
    start, scores = 0, []
    for domain, fs in DOMAIN_FIELDS.items():
        first, end = start, start + len(fs)
        held = F.size(F.array_intersect(F.coalesce("hits", F.array().cast("array<int>")), F.array(*[F.lit(i) for i in range(first, end)])))
        scores.append(F.struct((-F.round(held / len(fs), 4)).alias("neg"), F.lit(domain).alias("domain_id")))
        start = end
    ranked = F.array_sort(F.array(*scores))
    out = tables.join(counts, TABLE, "left").select(*TABLE, F.posexplode(ranked).alias("pos", "s"))
    return out.select(*TABLE, (F.col("pos") + 1).alias("rank"), F.col("s.domain_id").alias("domain_id"), (-F.col("s.neg")).alias("score")).where(
        F.col("score") >= min_score
    )
