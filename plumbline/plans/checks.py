"""User-supplied checks: functions that return findings, run together."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.risk import cap_risk
from plumbline.schemas import FINDINGS

Check = Callable[[Mapping[str, DataFrame], Mapping], DataFrame]
_CHECKS: dict[str, Check] = {}


def register_check(rule_id: str, fn: Check) -> None:
    """Register ``fn(inputs, rule) -> findings`` under a rule id; the last one wins."""
    _CHECKS[rule_id] = fn


def registered() -> list[str]:
    return sorted(_CHECKS)


def run_checks(rules: list[Mapping], inputs: Mapping[str, DataFrame]) -> DataFrame:
    """Findings of all active rules, risk capped at each rule's ceiling.

    A rule holds ``rule_id`` and may hold ``active``, ``risk_ceiling`` and anything its
    check reads. The result is one lazy plan.
    """
    parts = []
    for rule in rules:
        if not rule.get("active", True):
            continue
        if rule["rule_id"] not in _CHECKS:
            raise KeyError(f"no check registered for {rule['rule_id']}")
        found = _CHECKS[rule["rule_id"]](inputs, rule).select(*FINDINGS.names)
        ceiling = F.lit(rule.get("risk_ceiling", "medium"))
        parts.append(found.withColumns({"risk_level": cap_risk(F.col("risk_level"), ceiling), "rule_id": F.lit(rule["rule_id"])}))
    if not parts:
        raise ValueError("no active rule")
    return reduce(DataFrame.unionByName, parts)
