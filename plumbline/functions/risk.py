"""Risk ranks, stable ids and bilingual text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Score per risk level.
RISK_WEIGHTS = {"high": "0.35", "medium": "0.15", "low": "0.05"}
RISK_ORDER = ["low", "medium", "high"]
CLOSED_STATUSES = ["resolved_by_version", "formally_corrected"]
METHOD_CARD_TYPES = ["method_card", "public_method_card"]


def risk_rank(c: Column) -> Column:
    level = F.lower(c)
    return F.when(level == "high", 2).when(level == "medium", 1).otherwise(0)


def cap_risk(risk: Column, ceiling: Column) -> Column:
    """The lower of the two levels; an unknown ceiling means medium."""
    top = F.when(ceiling.isin(RISK_ORDER), ceiling).otherwise(F.lit("medium"))
    return F.when(risk_rank(risk) <= risk_rank(top), risk).otherwise(top)


def risk_weight(c: Column) -> Column:
    level = F.lower(c)
    weight = T.DecimalType(10, 8)
    return (
        F.when(level == "high", F.lit(RISK_WEIGHTS["high"]).cast(weight))
        .when(level == "medium", F.lit(RISK_WEIGHTS["medium"]).cast(weight))
        .otherwise(F.lit(RISK_WEIGHTS["low"]).cast(weight))
    )


def stable_id(prefix: str, *parts: Column, length: int = 12, ordered: bool = False) -> Column:
    """A content hash id; parts are sorted unless their order carries meaning."""
    items = F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    joined = F.concat_ws("|", items if ordered else F.array_sort(items))
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, length))


def resolve_bilingual(texts: Column, locale: str = "en") -> Column:
    """The text for a locale, else English, else the first non-empty one."""

    def non_empty(key):
        value = F.try_element_at(texts, F.lit(key))
        return F.when(value != "", value)

    first = F.try_element_at(F.filter(F.map_values(texts), lambda v: v.isNotNull() & (v != "")), F.lit(1))
    return F.coalesce(non_empty(locale), non_empty("en"), first, F.lit(""))
