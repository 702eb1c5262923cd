"""All registered queries and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ["numeric", "ledger", "claims", "bibliography", "pv", "curves", "compare", "composed"]


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"plumbline.bindings.{name}"), attribute)
        clash = set(out) & set(part)
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLES")


def flagship(spark, sf_dir):
    """Terminal-digit findings of all line-item tables, scored once per table and package."""
    from plumbline.bindings.common import line_cells
    from plumbline.operators import ledger, numeric

    return ledger.mrpi(numeric.terminal_digit(line_cells(spark, sf_dir)))
