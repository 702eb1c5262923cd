"""Column functions over raw table cells and column headers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.schemas import EXACT

# Cell texts that count as missing.
MISSING_TEXTS = ["", "na", "n/a", "nan", "null", "none"]

# Plain numbers, and numbers with an optional exponent.
PLAIN_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Header words that name a role.
IDENTIFIER_NAMES = ["id", "index", "row", "row_index", "record_number", "row_number"]
DERIVED_WORDS = ["derived", "calculated", "computed", "recomputed"]
NORMALIZATION_WORDS = ["normalized", "normalised", "normalization", "normalisation", "norm"]
EXCLUDED_ROLES = [
    "identifier",
    "row_index",
    "declared_formula",
    "derived",
    "normalization",
    "normalized",
    "unit_conversion",
]

# Unit hints, first match wins.
UNIT_HINTS = [
    (["ma/cm2", "ma/cm^2"], "mA/cm2"),
    (["%"], "%"),
    (["mv"], "mV"),
    (["ma"], "mA"),
    (["nm"], "nm"),
    (["ev"], "eV"),
    (["v"], "V"),
]


def is_missing(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(MISSING_TEXTS)


def is_number_text(c: Column) -> Column:
    return F.trim(c).rlike(NUMBER)


def to_exact_decimal(c: Column) -> Column:
    """The finite decimal behind a text cell, or NULL.

    The regex guard keeps texts such as ``5d`` out, which a plain cast accepts.
    """
    text = F.trim(c)
    return F.when(text.rlike(NUMBER), text.try_cast(EXACT))


def fits_word(text: Column) -> Column:
    """Up to 18 characters without an exponent: a number in them is exact, and its digits fit a machine word."""
    return (F.length(text) <= 18) & ~text.contains("e") & ~text.contains("E")


def precision_overflow(c: Column) -> Column:
    """True where a numeric text does not fit the exact type without loss.

    More than 19 integer digits become NULL, more than 18 decimals would be rounded.
    """
    text = F.trim(c)
    # up to 18 characters without an exponent always fit; nearly all cells go no further
    long = (F.length(text) > 18) | text.contains("e") | text.contains("E")
    decimals = F.length(F.regexp_replace(F.regexp_extract(text, r"\.([0-9]*)", 1), "0+$", ""))
    exponent = F.coalesce(F.regexp_extract(text, r"[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    return long & text.rlike(NUMBER) & (text.try_cast(EXACT).isNull() | (decimals - exponent > 18))


def is_integer_text(c: Column) -> Column:
    """Whole numbers; ``1.0`` counts, ``1e2`` without a point does not."""
    text = F.trim(c)
    number = text.try_cast("double")
    whole = text.rlike(NUMBER) & (number == F.floor(number))
    return F.when(text.contains("."), whole).otherwise(text.rlike(r"^[+-]?[0-9]+$"))


def decimal_places(c: Column) -> Column:
    """Digits after the only point; 0 with no point or with several."""
    parts = F.split(F.trim(c), r"\.")
    return F.when(F.size(parts) == 2, F.length(F.regexp_replace(parts[1], "[^0-9]", ""))).otherwise(F.lit(0))


def last_digit(c: Column) -> Column:
    """Last digit found anywhere in the text."""
    digit = F.regexp_extract(c, r"([0-9])[^0-9]*$", 1)
    return F.when(digit != "", digit)


def terminal_digit(c: Column) -> Column:
    """Last digit of a plain number; NULL for exponents and other text."""
    text = F.trim(c)
    return F.when(text.rlike(PLAIN_NUMBER), last_digit(text))


def normalized_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def header_role(c: Column) -> Column:
    """The role a header name states for itself."""
    name = normalized_name(c)
    words = F.split(name, "_")

    def any_word(listed):
        return F.arrays_overlap(words, F.array(*[F.lit(w) for w in listed]))

    identifier = (
        name.isin(IDENTIFIER_NAMES)
        | name.endswith("_id")
        | name.startswith("id_")
        | (F.array_contains(words, "row") & F.array_contains(words, "index"))
    )
    return (
        F.when(identifier, "identifier")
        .when(F.array_contains(words, "formula"), "declared_formula")
        .when(any_word(DERIVED_WORDS), "derived")
        .when(any_word(NORMALIZATION_WORDS), "normalization")
        .otherwise("unspecified")
    )


def temperature_scale(c: Column, unit: Column | None = None) -> Column:
    """``c`` or ``k`` for a temperature column, from its declared unit or its name."""
    name = normalized_name(c)
    words = F.split(name, "_")
    last = F.element_at(words, -1)
    from_name = F.when(
        F.array_contains(words, "temperature"),
        F.when(last.isin("c", "celsius", "degc"), "c").when(last.isin("k", "kelvin"), "k"),
    )
    if unit is None:
        return from_name
    stated = F.regexp_replace(F.lower(F.trim(unit)), "℃", "°c")
    from_unit = F.when(stated.isin("c", "°c", "degc", "celsius"), "c").when(stated.isin("k", "kelvin"), "k")
    return F.coalesce(from_unit, from_name)


def unit_hint(c: Column) -> Column:
    name = F.lower(c)

    def holds(texts):
        return reduce(lambda a, b: a | b, [name.contains(t) for t in texts])

    return F.coalesce(*[F.when(holds(texts), F.lit(unit)) for texts, unit in UNIT_HINTS])


def neutralize_formula(c: Column) -> Column:
    """Quote a text that a spreadsheet would take for a formula."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)
