"""Composed reviews over many packages."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import bibliography, claims, curve_compare, curves, images, ledger, numeric, pv, versions
from plumbline.session import materialize


def table_review(cells: DataFrame, contexts: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Terminal digits, fixed differences and value grids of all tables."""
    texts = numeric.cell_texts(cells) if texts is None else texts
    return reduce(
        DataFrame.unionByName,
        [
            numeric.terminal_digit(cells, contexts, texts=texts),
            numeric.fixed_delta(cells, contexts),
            numeric.quantization_grid(cells, contexts, texts=texts),
        ],
    )


def pv_review(cells: DataFrame) -> DataFrame:
    """Every photovoltaic table check."""
    # read by seven checks; written once, the cells are not typed again for each
    rows = materialize(pv.pv_metric_rows(cells), "pv-rows")
    return reduce(
        DataFrame.unionByName,
        [
            pv.pce_consistency(rows),
            pv.eqe_jv_consistency(rows),
            pv.voc_loss(rows),
            pv.tandem_consistency(rows),
            pv.completeness_findings(pv.table_completeness(cells, rows), "pv_reporting_completeness"),
            pv.completeness_findings(pv.stability_completeness(cells, rows), "pv_stability_completeness"),
            pv.completeness_findings(pv.characterization_completeness(cells), "pv_characterization_completeness"),
            pv.completeness_findings(pv.evidence_ruleset(cells, rows), "pv_ruleset"),
        ],
    )


def raw_pv_review(points: DataFrame, spectra: DataFrame, reference: DataFrame, reported: DataFrame) -> DataFrame:
    """Sweeps and spectra against reported values and each other."""
    metrics = curves.jv_metrics(points)
    eqe = curves.eqe_integration(spectra, reference)
    jv = curves.reconcile_jv_reported(metrics, reported)
    er = curves.reconcile_eqe_reported(eqe, reported)
    ej = curves.reconcile_eqe_jv(eqe, metrics)
    return reduce(
        DataFrame.unionByName,
        [
            curves.raw_pv_findings(jv, "raw_jv_reported", F.concat_ws(", ", "mismatches")),
            curves.raw_pv_findings(er, "raw_eqe_reported", F.concat(F.lit("reported "), F.col("reported_jsc").cast("string"))),
            curves.raw_pv_findings(ej, "raw_eqe_jv", F.concat(F.lit("sweep "), "jv_curve")),
        ],
    )


def module_counts(parts: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """``package_id, module, status, input_rows, findings`` for every package and module.

    ``parts``: name, input and findings of each module that ran. A module that had no rows
    of a package is skipped there; one that found nothing is a success. Inputs without a
    package count for the package without a name.
    """

    def per_package(name: str, df: DataFrame, column: str) -> DataFrame:
        package = F.coalesce("package_id", F.lit("")) if "package_id" in df.columns else F.lit("")
        counted = df.groupBy(package.alias("package_id")).agg(F.count(F.lit(1)).alias("_n"))
        own = lambda c: F.when(F.lit(c == column), F.col("_n")).otherwise(F.lit(0).cast("long")).alias(c)
        return counted.select("package_id", F.lit(name).alias("module"), own("input_rows"), own("findings"))

    counts = reduce(
        DataFrame.unionByName,
        [per_package(name, df, column) for name, given, found in parts for df, column in ((given, "input_rows"), (found, "findings"))],
    )
    names = F.array(*[F.lit(name) for name, _, _ in parts])
    none = F.lit(0).cast("long")
    every = counts.select("package_id").distinct().select("package_id", F.explode(names).alias("module"))
    every = every.select("*", none.alias("input_rows"), none.alias("findings"))
    summed = counts.unionByName(every).groupBy("package_id", "module").agg(F.sum("input_rows").alias("input_rows"), F.sum("findings").alias("findings"))
    ran = F.col("input_rows") + F.col("findings") > 0
    return summed.select("package_id", "module", F.when(ran, "success").otherwise("skipped").alias("status"), "input_rows", "findings")


def review_packages(inputs: Mapping[str, DataFrame], version_events: DataFrame | None = None) -> dict[str, DataFrame]:
    """All checks whose inputs are given, as one ledger with its issues, scores, summary and module status.

    Keys of ``inputs``: ``cells``, ``pv_cells``, ``references``, ``dois`` (both with
    ``works``), ``claims``, ``images`` (files), ``image_hashes``, ``curve_specs`` with
    ``curve_source`` and ``curve_plot``, ``raw_curves`` with ``raw_spectra``, ``spectrum``
    and ``reported``, ``ledgers``. Numbers that the exact checks cannot read are reported
    with the tables.
    """
    found: list[tuple[str, DataFrame, DataFrame]] = []

    def add(name: str, key: str, make) -> None:
        if key in inputs:
            found.append((name, inputs[key], make(inputs[key])))

    def curve_questions(specs: DataFrame) -> DataFrame:
        questions, _ = curve_compare.curve_point_coverage(specs, inputs["curve_source"], inputs["curve_plot"])
        return curve_compare.coverage_findings(questions)

    def tables(cells: DataFrame) -> DataFrame:
        # distinct texts, written once for three of the four checks
        texts = numeric.cell_texts(cells)
        return table_review(cells, texts=texts).unionByName(numeric.precision_overflow_findings(cells, texts))

    add("images", "images", images.duplicate_findings)
    add("image_similarity", "image_hashes", lambda df: images.similarity_findings(images.hash_similarity_pairs(df).where(F.col("distance") > 0)))
    add("tables", "cells", tables)
    add("pv", "pv_cells", pv_review)
    add("raw_curves", "raw_curves", lambda df: raw_pv_review(df, inputs["raw_spectra"], inputs["spectrum"], inputs["reported"]))
    add("references", "references", lambda df: bibliography.reference_scan(df, inputs["works"]))
    add("publication_status", "dois", lambda df: bibliography.status_findings(bibliography.publication_status(df, inputs["works"])))
    add("claims", "claims", claims.cross_document_claims)
    add("curves", "curve_specs", curve_questions)
    add("ledgers", "ledgers", lambda df: df)
    if not found:
        raise ValueError("no input given")
    # findings are few next to their inputs; written once, no check runs again for another output
    parts = [(name, given, materialize(df, name)) for name, given, df in found]
    unified = materialize(ledger.unify_findings(*[df for _, _, df in parts]), "unified")
    effective = versions.reconcile_versions(unified, version_events) if version_events is not None else unified
    return {
        "ledger": effective,
        "issues": ledger.validate_ledger(unified),
        "scores": ledger.mrpi(effective),
        "summary": ledger.findings_summary(effective),
        "modules": ledger.module_status(module_counts(parts)),
    }
