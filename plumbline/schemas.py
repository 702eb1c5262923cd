"""Schemas shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Equal-comparison numbers: 37 digits, so that a difference of two keeps all 18 decimals.
EXACT = T.DecimalType(37, 18)

_S = T.StringType()
_SA = T.ArrayType(T.StringType())

CELLS = T.StructType(
    [
        T.StructField("package_id", _S),
        T.StructField("table_id", _S),
        T.StructField("source_file", _S),
        T.StructField("sheet_name", _S),
        T.StructField("row_index", T.LongType()),
        T.StructField("col_index", T.IntegerType()),
        T.StructField("column_name", _S),
        T.StructField("value", _S),
    ]
)

POINTS = T.StructType(
    [
        T.StructField("curve_id", _S),
        T.StructField("source_file", _S),
        T.StructField("device_id", _S),
        T.StructField("seq", T.LongType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("scan_direction", _S),
    ]
)

CLAIMS = T.StructType(
    [
        T.StructField("claim_id", _S),
        T.StructField("claim_type", _S),
        T.StructField("value", _S),
        T.StructField("unit", _S),
        T.StructField("device_variant", _S),
        T.StructField("sample_id", _S),
        T.StructField("measurement_context", _S),
        T.StructField("source_document", _S),
        T.StructField("source_version", _S),
        T.StructField("location", _S),
        T.StructField("source_hash", _S),
        T.StructField("human_confirmed", T.BooleanType()),
    ]
)

VERSION_EVENTS = T.StructType(
    [
        T.StructField("event_id", _S),
        T.StructField("target_doi", _S),
        T.StructField("source_version", _S),
        T.StructField("source_type", _S),
        T.StructField("source_url", _S),
        T.StructField("observed_at", _S),
        T.StructField("status", _S),
        T.StructField("resolution_status", _S),
        T.StructField("related_finding_ids", _SA),
        T.StructField("related_claim_ids", _SA),
        T.StructField("resolves_event_ids", _SA),
        T.StructField("resolves_finding_ids", _SA),
        T.StructField("supersedes_versions", _SA),
    ]
)

EVIDENCE = T.ArrayType(
    T.StructType(
        [
            T.StructField("source", _S),
            T.StructField("location", _S),
            T.StructField("quote", _S),
            T.StructField("metadata", T.MapType(_S, _S)),
        ]
    )
)

FINDINGS = T.StructType(
    [
        T.StructField("finding_id", _S),
        T.StructField("package_id", _S),
        T.StructField("scope", _S),
        T.StructField("finding_category", _S),
        T.StructField("type", _S),
        T.StructField("rule_id", _S),
        T.StructField("risk_level", _S),
        T.StructField("source_file", _S),
        T.StructField("table_id", _S),
        T.StructField("evidence", EVIDENCE),
        T.StructField("manual_requests", _SA),
        T.StructField("alternative_explanations", _SA),
        T.StructField("false_positive_risks", _SA),
        T.StructField("limitations", _SA),
        T.StructField("safe_report_language", _S),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("open_for_scoring", T.BooleanType()),
        T.StructField("mrpi_eligible", T.BooleanType()),
        T.StructField("resolution_status", _S),
        T.StructField("correlation_group", _S),
        T.StructField("method_family", _S),
        T.StructField("source_versions", _SA),
        T.StructField("claim_ids", _SA),
        T.StructField("event_ids", _SA),
        T.StructField("metadata", T.MapType(_S, _S)),
        T.StructField("seq", T.LongType()),
    ]
)


def text_list(*items: str) -> Column:
    """An array literal of strings."""
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast(_SA)


def evidence(source, location, quote=None, metadata=None) -> Column:
    """A one-element evidence array."""

    def as_col(v):
        return v if isinstance(v, Column) else F.lit(v)

    item = F.struct(
        as_col(source).cast("string").alias("source"),
        as_col(location).cast("string").alias("location"),
        as_col(quote).cast("string").alias("quote"),
        (metadata if metadata is not None else F.lit(None)).cast(T.MapType(_S, _S)).alias("metadata"),
    )
    return F.array(item)


def metadata(**items) -> Column:
    """A string map from named columns or literals."""
    pairs = []
    for key, value in items.items():
        value = value if isinstance(value, Column) else F.lit(value)
        pairs += [F.lit(key), value.cast("string")]
    return F.create_map(*pairs)


def as_findings(df: DataFrame, **columns) -> DataFrame:
    """Project ``df`` to the findings schema; fields not named get neutral defaults."""
    defaults = {
        "scope": F.lit("research_integrity"),
        "confidence": F.lit(1.0),
        "open_for_scoring": F.lit(True),
        "mrpi_eligible": F.lit(True),
        "manual_requests": text_list(),
        "alternative_explanations": text_list(),
        "false_positive_risks": text_list(),
        "limitations": text_list(),
    }
    unknown = set(columns) - set(FINDINGS.names)
    if unknown:
        raise ValueError(f"not findings columns: {sorted(unknown)}")
    out = []
    for field in FINDINGS.fields:
        value = columns.get(field.name, defaults.get(field.name, F.lit(None)))
        value = value if isinstance(value, Column) else F.lit(value)
        out.append(value.cast(field.dataType).alias(field.name))
    return df.select(*out)
