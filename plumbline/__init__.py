"""Deterministic consistency checks over research data, as Spark DataFrame plans."""
