"""Operators over findings: validation, safety, union, scope, scoring, summaries, graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import safety
from plumbline.functions.risk import CLOSED_STATUSES, METHOD_CARD_TYPES, RISK_ORDER, risk_weight
from plumbline.schemas import FINDINGS
from plumbline.session import staged

# Scopes of a finding.
INTEGRITY = "research_integrity"
ENGINEERING = "engineering_plausibility"
MOTIVE = "unsupported_motive"
SCOPES = [INTEGRITY, ENGINEERING, MOTIVE]


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def _issues(*pairs: tuple[Column, str, str]) -> Column:
    """Array of ``struct(kind, message)`` for the conditions that hold."""
    return F.array_compact(
        F.array(*[F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(text).alias("message"))) for cond, kind, text in pairs])
    )


def schema_issues() -> Column:
    """Array of ``struct(kind, message)`` for the schema rules that a finding breaks."""
    sources_ok = F.forall("evidence", lambda e: ~_blank(e["source"]) & ~_blank(e["location"]))
    return _issues(
        (_blank(F.col("finding_id")), "schema error", "finding_id is required"),
        (F.col("scope") == MOTIVE, "schema error", "unsupported motive is not a finding scope"),
        (F.col("scope").isNotNull() & ~F.col("scope").isin(SCOPES), "schema error", "scope is unknown"),
        (F.col("risk_level").isNull() | ~F.col("risk_level").isin(RISK_ORDER), "schema error", "risk level is unknown"),
        (
            F.col("evidence").isNull() | (F.size("evidence") < 1),
            "schema error",
            "at least one evidence location is required",
        ),
        (~F.coalesce(sources_ok, F.lit(True)), "schema error", "evidence needs source and location"),
        (F.col("safe_report_language").isNull(), "schema error", "summary or safe report language is required"),
        ((F.col("confidence") < 0) | (F.col("confidence") > 1), "schema error", "confidence must lie in [0, 1]"),
        (
            F.coalesce(F.col("metadata")["needs_manual_review"], F.lit("")).isin("true", "false")
            & ((F.col("metadata")["needs_manual_review"] == "true") != (F.size("manual_requests") > 0)),
            "schema error",
            "review flag must match the manual requests",
        ),
    )


def validate_ledger(findings: DataFrame) -> DataFrame:
    """One row per broken rule of a record: ``package_id, finding_id, seq, kind, message``.

    Unsafe texts are looked for only in records that pass the schema rules.
    """
    rows = staged(_with_texts(findings), _schema=schema_issues())
    issues = F.when(F.size("_schema") > 0, F.col("_schema")).otherwise(_safety_found())
    return rows.select("package_id", "finding_id", "seq", F.explode(issues).alias("i")).select(
        "package_id", "finding_id", "seq", "i.kind", "i.message"
    )


def record_safety_issues(findings: DataFrame) -> DataFrame:
    """The distinct safety messages over every text and map key of a record, nested ones too."""
    return _with_texts(findings).select("package_id", "finding_id", "seq", F.explode(_safety_found()).alias("i")).select(
        "package_id", "finding_id", "seq", "i.kind", "i.message"
    )


def _with_texts(findings: DataFrame) -> DataFrame:
    """All texts and map keys of a record as two arrays, next to its own columns."""
    texts, keys = safety.texts_of(findings.schema), safety.keys_of(findings.schema)
    return staged(staged(findings), _texts=F.array_distinct(texts), _keys=keys)


def _safety_found() -> Column:
    """Array of ``struct(kind, message)`` for ``_texts`` and ``_keys``.

    One cheap test over the joined texts decides whether they are looked at one by one.
    """
    none = F.array().cast("array<string>")
    one_by_one = F.flatten(F.transform(F.filter("_texts", safety.suspicious), safety.text_safety_issues))
    found = F.when(safety.suspicious(F.concat_ws("\u0002", "_texts")), one_by_one).otherwise(none)
    messages = F.array_distinct(F.concat(found, safety.auth_key_issues(F.col("_keys"))))
    return F.transform(messages, lambda m: F.struct(_kind_of(m).alias("kind"), m.alias("message")))


def _kind_of(message: Column) -> Column:
    return (
        F.when(message.startswith("forbidden phrase"), "forbidden phrase")
        .when(message.startswith("private/local path"), "private path leak")
        .otherwise("sensitive authentication material")
    )


def safety_issues(records: DataFrame, key: str, text: str) -> DataFrame:
    """Safety messages in one text column, one row per record and message."""
    return records.select(key, F.explode(F.array_distinct(safety.text_safety_issues(F.col(text)))).alias("message")).select(
        key, _kind_of(F.col("message")).alias("kind"), "message"
    )


def resolve_source(findings: DataFrame) -> DataFrame:
    """Fill the source file from the first evidence location, else ``unknown_file``."""
    first = F.try_element_at("evidence", F.lit(1))["source"]
    named = F.when(~_blank(F.col("source_file")), F.col("source_file"))
    return findings.withColumn("source_file", F.coalesce(named, F.when(~_blank(first), first), F.lit("unknown_file")))


DEDUPE_KEY = ["package_id", "rule_id", "source_file", "safe_report_language"]


def prepare_unified(findings: DataFrame) -> DataFrame:
    """Source, rule and risk level of each record as the unified ledger has them."""
    rule = F.coalesce("rule_id", F.lit("unknown_rule"))
    level = F.coalesce(F.lower("risk_level"), F.lit("low"))
    status_rule = F.lower(rule).contains("retract") | F.lower(rule).contains("withdraw")
    return resolve_source(findings).withColumns(
        {
            "package_id": F.coalesce("package_id", F.lit("")),
            "rule_id": rule,
            "risk_level": F.when((level == "high") & ~status_rule, "medium").otherwise(F.col("risk_level")),
            "safe_report_language": F.coalesce("safe_report_language", F.lit("")),
        }
    )


def unify_findings(*ledgers: DataFrame, dedupe_key: list[str] | None = None) -> DataFrame:
    """One ledger per package out of many.

    High is kept only for retraction-type rules; records with the same rule, source
    and text collapse to the first in ledger order; the unnamed get content ids.
    Keeping the first is an aggregate, so copies shrink before the shuffle.
    """
    keys = dedupe_key or DEDUPE_KEY
    staged = prepare_unified(
        reduce(
            lambda a, b: a.unionByName(b, allowMissingColumns=True),
            [df.withColumn("_ledger", F.lit(i)) for i, df in enumerate(ledgers)],
        )
    )
    rest = [n for n in FINDINGS.names if n not in keys]
    kept = staged.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct("_ledger", F.coalesce("seq", F.lit(0)), F.coalesce("finding_id", F.lit("")))).alias("r")
    )
    out = kept.select(*keys, "r.*")
    named = F.coalesce(
        "finding_id", F.concat(F.lit("unified-"), F.substring(F.sha2(F.concat_ws("|", *keys), 256), 1, 16))
    )
    return out.withColumn("finding_id", named).select(*FINDINGS.names)


def split_scope(findings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(integrity findings, engineering questions, rows with an unknown scope).

    A record without a scope counts as integrity; unsupported motive is in none.
    """
    scope = F.coalesce("scope", F.lit(INTEGRITY))
    return (
        findings.where(scope == INTEGRITY),
        findings.where(scope == ENGINEERING),
        findings.where(~scope.isin(SCOPES)),
    )


def counts_for_score() -> Column:
    """Whether a finding counts for the score."""
    category = F.lower(F.coalesce("finding_category", "type", F.lit("")))
    source_type = F.lower(F.coalesce(F.col("metadata")["source_type"], F.lit("")))
    return (
        (F.coalesce("scope", F.lit(INTEGRITY)) == INTEGRITY)
        & ~category.isin(METHOD_CARD_TYPES)
        & (source_type != "public_method")
        & F.coalesce("open_for_scoring", F.lit(True))
        & F.coalesce("mrpi_eligible", F.lit(True))
        & ~F.lower(F.coalesce("resolution_status", F.lit(""))).isin(CLOSED_STATUSES)
    )


def correlation_key(findings: DataFrame) -> Column:
    """Explicit group, else source + table + method family, else NULL."""
    first = F.try_element_at("evidence", F.lit(1))["source"]
    source = F.coalesce(F.when(~_blank(F.col("source_file")), F.col("source_file")), first)
    explicit = F.when(~_blank(F.col("correlation_group")), F.concat(F.lit("explicit|"), F.col("correlation_group")))
    family = F.when(
        ~_blank(source) & ~_blank(F.col("table_id")) & ~_blank(F.col("method_family")),
        F.concat_ws("|", F.lit("family"), source, F.col("table_id"), F.col("method_family")),
    )
    return F.coalesce(explicit, family)


def score_expr() -> Column:
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(1.0))))
    return (risk_weight(F.col("risk_level")) * clamped.cast("decimal(10,8)")).cast("decimal(18,16)")


def mrpi(findings: DataFrame) -> DataFrame:
    """Review priority per package: one maximum per correlation key, the rest added.

    Scores are decimals, so the sum does not depend on the order of partitions. A package
    whose findings all do not count has the score 0.
    """
    counts = counts_for_score()
    per_key = (
        findings.select(
            "package_id", correlation_key(findings).alias("key"), F.when(counts, score_expr()).alias("score"), counts.alias("counts")
        )
        .groupBy("package_id", "key")
        .agg(F.max("score").alias("top"), F.sum("score").alias("all"), F.count_if("counts").alias("n"))
    )
    total = F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("all")).otherwise(F.col("top"))), F.lit(0).cast("decimal(18,16)"))
    return per_key.groupBy("package_id").agg(
        F.round(F.least(total, F.lit(1).cast("decimal(1,0)")).cast("double") * 100.0, 2).alias("mrpi"),
        F.sum("n").alias("scored_findings"),
    )


def findings_summary(findings: DataFrame) -> DataFrame:
    """Counts per risk level (unknown counts as low), per rule and overall."""
    level = F.lower(F.coalesce("risk_level", F.lit("low")))
    closed = F.lower(F.coalesce("resolution_status", F.lit(""))).isin(CLOSED_STATUSES)
    rows = findings.select(
        F.coalesce("finding_category", F.lit("general")).alias("finding_category"),
        F.coalesce("rule_id", F.lit("unknown_rule")).alias("rule_id"),
        F.when(level.isin(RISK_ORDER), level).otherwise("low").alias("level"),
        closed.alias("closed"),
    )
    return rows.rollup("finding_category", "rule_id").agg(
        F.count_if(F.col("level") == "low").alias("low"),
        F.count_if(F.col("level") == "medium").alias("medium"),
        F.count_if(F.col("level") == "high").alias("high"),
        F.count_if("closed").alias("historical"),
        F.count(F.lit(1)).alias("total"),
    )


def status_summary(records: DataFrame) -> DataFrame:
    """Records and records to review per publication status."""
    return records.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("risk_level").isin("medium", "high")).alias("needs_review")
    )


def review_queue(findings: DataFrame) -> DataFrame:
    """Distinct review texts per package and kind, with the findings behind each."""
    scope = F.coalesce("scope", F.lit(INTEGRITY))

    def exploded(column, kind):
        return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text")))

    safe = F.coalesce("safe_report_language", F.lit(""))
    items = F.when(
        scope == INTEGRITY,
        F.concat(
            exploded("manual_requests", "question"),
            exploded("limitations", "limitation"),
            exploded("alternative_explanations", "alternative"),
        ),
    ).when(scope == ENGINEERING, exploded(F.array(safe), "engineering_question"))
    return (
        findings.select("package_id", "risk_level", F.explode(items).alias("i"))
        .where(F.trim("i.text") != "")
        .groupBy("package_id", "i.kind", "i.text")
        .agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("risk_level") == "high").alias("high_findings"))
    )


def module_status(metrics: DataFrame) -> DataFrame:
    """Per package: counts over its modules and the worst status.

    ``metrics`` holds ``package_id, module, status, input_rows, findings``.
    """
    rank = F.when(F.col("status") == "failed", 3).when(F.col("status") == "warning", 2).otherwise(1)
    return metrics.groupBy("package_id").agg(
        F.count(F.lit(1)).alias("modules"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.sum("input_rows").alias("input_rows"),
        F.sum("findings").alias("findings"),
        F.element_at(F.array(F.lit("success"), F.lit("warning"), F.lit("failed")), F.max(rank)).alias("overall_status"),
    )


def provenance_graph(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) linking package, source, finding, rule and question.

    The first record of a finding id defines its node and edges.
    """
    named = findings.withColumns(
        {
            "package_id": F.coalesce("package_id", F.lit("")),
            "finding_id": F.coalesce("finding_id", F.lit("unknown_finding")),
            "rule_id": F.coalesce("rule_id", "type", F.lit("unknown_rule")),
        }
    )
    first = F.try_element_at("evidence", F.lit(1))["source"]
    source = F.coalesce(F.when(~_blank(F.col("source_file")), F.col("source_file")), first, F.lit("unknown_source"))
    rows = named.select(
        "package_id",
        F.concat(F.lit("source:"), F.substring_index(source, "/", -1)).alias("source_node"),
        F.concat(F.lit("rule:"), "rule_id").alias("rule_node"),
        F.concat(F.lit("finding:"), "finding_id").alias("finding_node"),
        F.coalesce("risk_level", F.lit("low")).alias("risk_level"),
        F.coalesce("manual_requests", F.array().cast("array<string>")).alias("requests"),
        F.coalesce("seq", F.lit(0).cast("long")).alias("seq"),
    )
    details = F.struct("source_node", "rule_node", "risk_level", "requests")
    unique = rows.groupBy("package_id", "finding_node").agg(
        F.min_by(details, F.struct("seq", details)).alias("d")
    ).select("package_id", "finding_node", "d.*")
    # sources and rules exist for every record, also for a repeated finding id
    seen = rows.select("package_id", "source_node", "rule_node").distinct()

    def node(c, kind, label):
        return F.struct(F.col(c).alias("node_id") if isinstance(c, str) else c.alias("node_id"), F.lit(kind).alias("node_type"), label.alias("label"))

    package = F.concat(F.lit("package:"), "package_id")
    fixed_nodes = (
        seen.select(
            "package_id",
            F.explode(
                F.array(
                    node(package, "package", F.col("package_id")),
                    node("source_node", "source_file", F.expr("substr(source_node, 8)")),
                    node("rule_node", "rule", F.expr("substr(rule_node, 6)")),
                )
            ).alias("n"),
        )
        .select("package_id", "n.*")
        .distinct()
    )
    bare = F.expr("substr(finding_node, 9)")
    questions = unique.select("package_id", "finding_node", bare.alias("_bare"), F.posexplode("requests").alias("pos", "text")).select(
        "package_id",
        "finding_node",
        F.concat(F.lit("question:"), F.col("_bare"), F.lit("-q"), (F.col("pos") + 1).cast("string")).alias("node_id"),
        F.lit("verification_question").alias("node_type"),
        F.col("text").alias("label"),
    )
    nodes = fixed_nodes.unionByName(
        unique.select("package_id", F.col("finding_node").alias("node_id"), F.lit("finding").alias("node_type"), bare.alias("label"))
    ).unionByName(questions.drop("finding_node"))

    def edge(a, b, kind):
        a = a if isinstance(a, Column) else F.col(a)
        return F.struct(a.alias("source"), F.col(b).alias("target"), F.lit(kind).alias("relation_type"))

    edges = (
        seen.select("package_id", "source_node")
        .distinct()
        .select("package_id", edge(package, "source_node", "contains").alias("e"))
        .unionByName(
            unique.select(
                "package_id",
                F.explode(
                    F.array(edge("source_node", "finding_node", "triggered_in"), edge("rule_node", "finding_node", "defined"))
                ).alias("e"),
            )
        )
        .unionByName(questions.select("package_id", edge("finding_node", "node_id", "verified_by").alias("e")))
        .select("package_id", "e.*")
    )
    return nodes, edges
