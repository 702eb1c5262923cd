"""Process lineage, workbook cells, case cards and rule candidates."""

from __future__ import annotations

import ast
import operator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import safety
from plumbline.functions.cells import NUMBER
from plumbline.functions.units import lookup
from plumbline.operators.versions import ISO_DATE

# Process stages with their rank, and older names.
STAGE_RANK = {"preparation": 0, "sonication": 1, "vortex": 1, "filtration": 2, "storage": 3, "dls": 4, "deposition": 5}
MEASUREMENT_ALIASES = {
    "pre_filtration": "before_filtration",
    "pre-filtration": "before_filtration",
    "before filtration": "before_filtration",
    "post_filtration": "after_filtration",
    "post-filtration": "after_filtration",
    "after filtration": "after_filtration",
}
BASIS_ALIASES = {
    "intensity": "intensity_weighted",
    "intensity-weighted": "intensity_weighted",
    "volume": "volume_weighted",
    "volume-weighted": "volume_weighted",
    "number": "number_weighted",
    "number-weighted": "number_weighted",
    "z-average": "z_average",
    "z average": "z_average",
}


def process_lineage(records: DataFrame, large_ratio: float = 3.0) -> DataFrame:
    """Questions on filtration and size records: bad stage order, missing context, large ratio.

    Only confirmed records count, and no outcome is ever scored.
    """
    stage = F.lower(F.trim("measurement_stage"))
    basis = F.lower(F.trim("distribution_basis"))
    rows = records.where("human_confirmed").withColumns(
        {"_stage": F.coalesce(lookup(MEASUREMENT_ALIASES, stage), stage), "_basis": F.coalesce(lookup(BASIS_ALIASES, basis), basis)}
    )
    names = F.transform("stages", lambda s: F.lower(F.trim(s)))
    ranks = F.transform(names, lambda s: lookup({k: str(v) for k, v in STAGE_RANK.items()}, s).cast("int"))
    broken = (
        F.exists(ranks, lambda r: r.isNull())
        | (ranks != F.array_sort(ranks))
        | (F.size(F.array_distinct(names)) != F.size(names))
    )
    missing = F.array_compact(
        F.array(
            F.when(F.coalesce("_stage", F.lit("unknown")) == "unknown", F.lit("measurement_stage")),
            F.when(F.coalesce("_basis", F.lit("unknown")) == "unknown", F.lit("distribution_basis")),
            F.when(F.coalesce("nominal_pore_nm", F.lit(0.0)) <= 0, F.lit("nominal_pore_nm")),
            F.when(F.coalesce("hydrodynamic_diameter_nm", F.lit(0.0)) <= 0, F.lit("hydrodynamic_diameter_nm")),
        )
    )
    ratio = F.try_divide(F.col("hydrodynamic_diameter_nm"), F.col("nominal_pore_nm"))
    kind = (
        F.when(F.coalesce(broken, F.lit(False)), "invalid_stages")
        .when(F.size(missing) > 0, "missing_context")
        .when((F.col("_stage") == "after_filtration") & (ratio >= large_ratio), "large_diameter_to_pore_ratio")
    )
    return (
        rows.withColumns({"missing": missing, "ratio": ratio, "kind": kind})
        .where(F.col("kind").isNotNull())
        .withColumn("risk_level", F.lit("low"))
        .drop("_stage", "_basis")
    )


# Volatile functions, and header words of calculated columns.
VOLATILE = ["NOW", "RAND", "RANDBETWEEN", "OFFSET", "INDIRECT"]
CALCULATED_WORDS = ["pce", "eff", "calculated", "recompute"]
SHEET = ["workbook", "sheet"]


def _numeric(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(NUMBER), F.lit(False))


def workbook_cell_audit(cells: DataFrame) -> DataFrame:
    """Review points of workbook cells: hidden parts, volatile or external formulas, typed-in numbers.

    ``cells``: ``workbook, sheet, row, col, formula, value, sheet_hidden, row_hidden, col_hidden``.
    Counts per row and per column are plain groupings with partial counts; only rows and
    columns that hold exactly one number among formulas join back.
    """
    is_formula = F.col("formula").startswith("=")
    c = cells.withColumn("is_formula", F.coalesce(is_formula, F.lit(False))).withColumn("is_number", ~F.col("is_formula") & _numeric(F.col("value")))

    def issue(df, kind, row, col, severity, detail):
        return df.select(
            *SHEET, F.lit(kind).alias("audit_type") if isinstance(kind, str) else kind.alias("audit_type"),
            row.cast("long").alias("row"), col.cast("long").alias("col"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"),
        )

    null = F.lit(None)
    upper = F.upper("formula")
    formulas = c.where("is_formula")
    volatile = F.array_compact(F.array(*[F.when(upper.contains(f"{v}("), F.lit(v)) for v in VOLATILE]))
    parts = [
        issue(c.where("sheet_hidden").select(*SHEET).distinct(), "hidden_sheet", null, null, "low", null),
        issue(c.where("row_hidden").select(*SHEET, "row").distinct(), "hidden_row", F.col("row"), null, "low", null),
        issue(c.where("col_hidden").select(*SHEET, "col").distinct(), "hidden_column", null, F.col("col"), "low", null),
        issue(formulas.withColumn("v", F.explode(volatile)), "volatile_function", F.col("row"), F.col("col"), "low", F.col("v")),
        issue(formulas.where(F.col("formula").rlike(r"[\[\]]")), "external_reference", F.col("row"), F.col("col"), "low", F.col("formula")),
    ]
    for axis, other in (("row", "col"), ("col", "row")):
        lines = c.groupBy(*SHEET, axis).agg(
            F.count_if("is_formula").alias("formulas"),
            F.count_if("is_number").alias("numbers"),
            F.min(F.when(F.col("is_number"), F.struct(other, "value"))).alias("n"),
        ).where((F.col("formulas") >= 2) & (F.col("numbers") == 1))
        place = {axis: F.col(axis), other: F.col(f"n.{other}")}
        parts.append(issue(lines, F.lit(f"hardcoded_in_{axis}"), place["row"], place["col"], "medium", F.col("n.value")))
    wordy = F.lit(False)
    for w in CALCULATED_WORDS:
        wordy = wordy | F.lower("value").contains(w)
    heads = c.where((F.col("row") == 1) & ~F.col("is_formula") & ~F.col("is_number") & wordy).select(*SHEET, "col")
    typed = c.where(F.col("is_number") & (F.col("row") > 1)).join(heads, [*SHEET, "col"], "left_semi")
    parts.append(issue(typed, "formula_overwrite_pattern", F.col("row"), F.col("col"), "medium", F.col("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_OPERATIONS = {
    ast.Add: operator.add,
    ast.Sub: operator.sub,
    ast.Mult: operator.mul,
    ast.Div: operator.truediv,
    ast.USub: operator.neg,
    ast.UAdd: operator.pos,
}


def _arithmetic(text: str) -> float | None:
    """Value of numbers joined by + - * / and parentheses; None for anything else."""

    def walk(node):
        if isinstance(node, ast.Expression):
            return walk(node.body)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return node.value
        if isinstance(node, ast.BinOp):
            return _OPERATIONS[type(node.op)](walk(node.left), walk(node.right))
        if isinstance(node, ast.UnaryOp):
            return _OPERATIONS[type(node.op)](walk(node.operand))
        raise ValueError("not arithmetic")

    try:
        return float(walk(ast.parse(text.strip(), mode="eval")))
    except (ValueError, KeyError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError):
        return None


@F.pandas_udf(T.DoubleType())
def _evaluate(expression: pd.Series) -> pd.Series:
    return expression.map(_arithmetic).astype(float)


CELL = r"(?i)\b([A-Z]+[0-9]+)\b"
ONLY_ARITHMETIC = r"(?i)^(?:[A-Z]+[0-9]+|[0-9]+\.?[0-9]*(?:E[+-]?[0-9]+)?|\.[0-9]+|[-+*/() ])+$"


def column_letters(c: Column) -> Column:
    """Spreadsheet letters of a 1-based column number up to 18278."""
    def letter(n):
        return F.char(n + 65)

    n = c.cast("int") - 1
    two = F.concat(letter(F.floor(n / 26) - 1), letter(n % 26))
    three = F.concat(letter(F.floor((n - 702) / 676)), letter(F.floor((n - 702) / 26) % 26), letter(n % 26))
    return F.when(n < 26, letter(n)).when(n < 702, two).otherwise(three)


def formula_recompute(cells: DataFrame, tol_abs: float = 0.05, tol_rel: float = 0.05) -> DataFrame:
    """Arithmetic formulas whose cached value departs from the recomputed one.

    References are exploded and joined to the cells by address; a formula is put together
    again from its own few references. Only the final arithmetic text leaves the JVM.
    """
    address = F.concat(column_letters(F.col("col")), F.col("row").cast("string"))
    values = cells.select(*SHEET, address.alias("ref"), F.trim("value").alias("ref_value"))
    body = F.trim(F.expr("substr(formula, 2)"))
    simple = cells.where(F.col("formula").startswith("=")).withColumn("body", F.upper(body)).where(
        ~F.col("body").rlike(r"[!\[\]:$]") & F.col("body").rlike(ONLY_ARITHMETIC)
    )
    simple = simple.select(*SHEET, "row", "col", "formula", "value", "body", F.array_distinct(F.regexp_extract_all("body", F.lit(CELL), 1)).alias("refs"))
    pairs = simple.select(*SHEET, "row", "col", F.explode("refs").alias("ref")).join(values, [*SHEET, "ref"])
    held = (
        pairs.where(_numeric(F.col("ref_value")))
        .groupBy(*SHEET, "row", "col")
        .agg(F.map_from_entries(F.collect_list(F.struct("ref", F.col("ref_value").cast("double").cast("string").alias("v")))).alias("m"))
    )
    ready = simple.join(held, [*SHEET, "row", "col"], "left").where(
        (F.size("refs") == 0) | (F.size(F.map_keys("m")) == F.size("refs"))
    )
    # longest addresses first, so that A1 does not touch A10
    longest = F.array_sort(
        F.transform("refs", lambda r: F.struct((-F.length(r)).alias("k"), r.alias("r")))
    )
    filled = F.aggregate(
        longest, F.col("body"), lambda acc, s: F.regexp_replace(acc, F.concat(F.lit(r"\b"), s["r"], F.lit(r"\b")), F.concat(F.lit("("), F.try_element_at("m", s["r"]), F.lit(")")))
    )
    out = ready.withColumn("recomputed", _evaluate(filled)).where(_numeric(F.col("value")))
    cached = F.col("value").cast("double")
    gap = F.abs(F.col("recomputed") - cached)
    share = F.when(cached != 0, gap / F.abs(cached)).otherwise(0.0)
    return out.where((gap > tol_abs) & (share > tol_rel)).select(*SHEET, "row", "col", "formula", cached.alias("cached"), "recomputed")


# The words a case card may use.
CARD_REQUIRED = [
    "case_id",
    "priority",
    "source_type",
    "source_url",
    "field",
    "public_status",
    "evidence_patterns",
    "detector_candidates",
    "manual_verification_needed",
    "false_positive_risks",
    "safe_report_language",
]
CARD_MODES = ["production", "toy", "draft"]
PUBLIC_STATUSES = [
    "confirmed_misconduct",
    "allegation",
    "investigation_started",
    "retracted",
    "mass_retraction",
    "settlement_or_legal_resolution",
    "published_method",
    "public_method_example",
    "methodology_only",
    "policy_resource",
    "unresolved",
]
METHOD_STATUSES = ["public_method_example", "unresolved"]
COUNTER_TYPES = ["author_response", "publisher_update", "correction", "raw_data_offer", "other"]
TIERS = ["E0", "E1", "E2", "E3", "E4"]
CARD_RESOLUTIONS = ["open", "partially_explained", "resolved_by_version", "formally_corrected", "unresolved"]
CARD_SCOPES = ["research_integrity", "engineering_plausibility", "unsupported_motive"]
METHOD_PROVENANCE = ["target_doi", "source_accessed_at", "evidence_tier", "resolution_status", "scope"]


def _iso(c: Column) -> Column:
    return F.coalesce(c.rlike(ISO_DATE) & F.substring(c, 1, 10).try_cast("date").isNotNull(), F.lit(False))


def case_card_issues(cards: DataFrame) -> DataFrame:
    """One row per broken rule of a case card: ``case_id, message``.

    Columns are the card fields; list fields are arrays, ``counter_sources`` an array of
    ``struct(url, source_type, observed_at)`` and ``version_timeline`` of
    ``struct(source_type, observed_at, source_url)``.
    """
    types = dict(cards.dtypes)

    def absent(name):
        return F.coalesce(F.size(name), F.lit(0)) <= 0 if types[name].startswith("array") else F.coalesce(F.col(name), F.lit("")) == ""

    mode = F.coalesce("validation_mode", F.lit("production"))
    status, scope, tier, resolution = (F.col(c) for c in ("public_status", "scope", "evidence_tier", "resolution_status"))
    method = F.coalesce(F.col("source_type") == "public_method", F.lit(False))
    closing = F.coalesce(resolution.isin("resolved_by_version", "formally_corrected"), F.lit(False))
    counters = F.coalesce(F.size("counter_sources"), F.lit(0))
    official = F.coalesce(F.exists("counter_sources", lambda s: s["source_type"].isin("publisher_update", "correction")), F.lit(False))

    def outside(c, allowed):
        return F.coalesce(~c.isin(allowed), F.lit(False))

    def some(name, test):
        return F.coalesce(F.exists(name, test), F.lit(False))

    checks = [
        (~mode.isin(CARD_MODES), "validation_mode is unknown"),
        *[((mode == "production") & absent(f), f"missing required field: {f}") for f in CARD_REQUIRED],
        (outside(status, PUBLIC_STATUSES), "public_status is unknown"),
        ((status == "confirmed_misconduct") & absent("official_or_institutional_source"), "confirmed status requires an official source"),
        *[(method & absent(f), f"public method requires {f}") for f in METHOD_PROVENANCE],
        (method & ~F.coalesce(status.isin(METHOD_STATUSES), F.lit(False)), "public method has an unsuitable public_status"),
        (outside(scope, CARD_SCOPES), "scope is unknown"),
        (F.coalesce(scope == "unsupported_motive", F.lit(False)), "unsupported motive cannot become a finding"),
        (F.col("target_doi").isNotNull() & ~F.trim("target_doi").rlike(r"^10\.[0-9]{4,9}/\S+$"), "target_doi is not a DOI"),
        (F.col("source_accessed_at").isNotNull() & ~_iso(F.col("source_accessed_at")), "source_accessed_at must be ISO-8601"),
        (outside(tier, TIERS), "evidence_tier is unknown"),
        (outside(resolution, CARD_RESOLUTIONS), "resolution_status is unknown"),
        (some("counter_sources", lambda s: ~F.coalesce(s["url"].rlike("^https?://"), F.lit(False))), "counter source needs a public URL"),
        (some("counter_sources", lambda s: ~F.coalesce(s["source_type"].isin(COUNTER_TYPES), F.lit(False))), "counter source type is unknown"),
        (some("counter_sources", lambda s: ~_iso(s["observed_at"])), "counter source date must be ISO-8601"),
        (some("version_timeline", lambda s: F.coalesce(F.trim(s["source_type"]), F.lit("")) == ""), "timeline source type is required"),
        (some("version_timeline", lambda s: ~_iso(s["observed_at"])), "timeline date must be ISO-8601"),
        (some("version_timeline", lambda s: s["source_url"].isNotNull() & ~s["source_url"].rlike("^https?://")), "timeline URL must be public"),
        (closing & (counters <= 0), "closed status requires a counter source"),
        (closing & (counters > 0) & ~official, "closed status requires a publisher counter source"),
    ]
    messages = F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in checks]))
    # every text on its own, nested ones and map keys too, so that one leak hides no other
    unsafe = F.flatten(F.transform(safety.texts_of(cards.schema), safety.text_safety_issues))
    unsafe = F.concat(unsafe, safety.auth_key_issues(safety.keys_of(cards.schema)))
    return cards.select("case_id", F.explode(F.concat(messages, unsafe)).alias("message")).distinct()


def rule_candidate_rollup(cards: DataFrame, library: DataFrame) -> DataFrame:
    """Cases and evidence patterns behind each rule candidate of a library.

    ``cards``: ``case_id, case_kind, detector_candidates, evidence_patterns``. A candidate
    without cases of its own stands on all methodology cases, else on all cases; those
    totals are two counts, not lists.
    """
    named = cards.select("case_id", "case_kind", "evidence_patterns", F.explode("detector_candidates").alias("candidate_id"))
    direct = named.groupBy("candidate_id").agg(F.countDistinct("case_id").alias("direct_cases"), F.min("case_id").alias("first_case"))
    patterns = named.select("candidate_id", F.explode("evidence_patterns").alias("p")).groupBy("candidate_id").agg(F.countDistinct("p").alias("patterns"))
    totals = cards.agg(
        F.countDistinct("case_id").alias("all_cases"),
        F.min("case_id").alias("all_first"),
        F.countDistinct(F.when(F.col("case_kind") == "methodology_note", F.col("case_id"))).alias("method_cases"),
        F.min(F.when(F.col("case_kind") == "methodology_note", F.col("case_id"))).alias("method_first"),
    ).withColumn("_one", F.lit(1))
    rows = (
        library.select("candidate_id").distinct().withColumn("_one", F.lit(1)).join(totals, "_one").drop("_one")
        .join(direct, "candidate_id", "left").join(patterns, "candidate_id", "left")
    )
    own = F.col("direct_cases").isNotNull()
    method = F.col("method_cases") > 0
    return rows.select(
        "candidate_id",
        F.when(own, F.col("direct_cases")).when(method, F.col("method_cases")).otherwise(F.col("all_cases")).alias("cases"),
        F.when(own, F.col("first_case")).when(method, F.col("method_first")).otherwise(F.col("all_first")).alias("first_case"),
        F.when(own, "direct").when(method, "methodology").otherwise("all").alias("relationship"),
        F.coalesce("patterns", F.lit(0).cast("long")).alias("patterns"),
    )
