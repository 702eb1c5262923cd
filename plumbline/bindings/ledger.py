"""Ledger operators bound to findings built from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.bindings.common import table
from plumbline.functions import risk, safety
from plumbline.functions.cells import neutralize_formula
from plumbline.operators import ledger as L
from plumbline.schemas import as_findings, evidence, metadata
from plumbline.session import scratch_path
from plumbline.sources.ledgers import read_ledger, write_ledger


def event_findings(spark, sf):
    """One finding per event; users are packages, event types are rules."""
    e = table(spark, sf, "events")
    eid = F.col("event_id")
    rule = F.when(F.col("event_type") == "purchase", "retracted_reference").otherwise(F.concat(F.lit("rule_"), "event_type"))
    level = (
        F.when(F.col("value") > 60, "high").when(F.col("value") > 20, "medium").when(F.col("value") > 5, "low").otherwise("minor")
    )
    closed = F.when(eid % 17 == 0, "resolved_by_version").when(eid % 19 == 0, "partially_explained")
    return as_findings(
        e,
        finding_id=F.concat(F.lit("f"), eid.cast("string")),
        package_id=F.concat(F.lit("u"), F.col("user_id").cast("string")),
        scope=F.when(F.col("event_type") == "view", "engineering_plausibility")
        .when((F.col("event_type") == "signup") & (eid % 7 == 0), "unsupported_motive")
        .otherwise("research_integrity"),
        finding_category=F.when(eid % 23 == 0, "method_card").otherwise("rule"),
        type=F.col("event_type"),
        rule_id=rule,
        risk_level=level,
        source_file=F.when(eid % 5 > 0, F.concat(F.lit("data/file_"), (eid % 9).cast("string"), F.lit(".csv"))),
        table_id=F.when(eid % 4 > 0, F.concat(F.lit("t"), (eid % 6).cast("string"))),
        evidence=F.when(eid % 29 > 0, evidence(F.concat(F.lit("file_"), (eid % 11).cast("string")), "row 1", F.col("props"))),
        manual_requests=F.array(F.concat(F.lit("check "), "event_type"), F.concat(F.lit("ask "), (eid % 5).cast("string"))),
        limitations=F.array(F.lit("one event only")),
        safe_report_language=F.concat(F.lit("level "), level),
        confidence=(eid % 13) / 10.0,
        open_for_scoring=eid % 31 != 0,
        resolution_status=closed,
        correlation_group=F.when(eid % 3 == 0, F.concat(F.lit("g"), (eid % 8).cast("string"))),
        method_family=F.when(eid % 2 == 0, "numeric_pattern"),
        metadata=metadata(evidence_tier="E1"),
        seq=eid,
    )


FINDINGS_SQL = """
 f as (select event_id as seq, 'f' || event_id as finding_id, 'u' || user_id as package_id,
  case when event_type='view' then 'engineering_plausibility' when event_type='signup' and event_id%7=0 then 'unsupported_motive'
    else 'research_integrity' end as scope,
  case when event_id%23=0 then 'method_card' else 'rule' end as finding_category,
  case when event_type='purchase' then 'retracted_reference' else 'rule_' || event_type end as rule_id,
  case when value>60 then 'high' when value>20 then 'medium' when value>5 then 'low' else 'minor' end as risk_level,
  case when event_id%5>0 then 'data/file_' || (event_id%9) || '.csv' end as source_file,
  case when event_id%4>0 then 't' || (event_id%6) end as table_id,
  case when event_id%29>0 then 'file_' || (event_id%11) end as ev_source,
  'check ' || event_type as req1, 'ask ' || (event_id%5) as req2,
  (event_id%13)/10.0::double as confidence, event_id%31<>0 as open_for_scoring,
  case when event_id%17=0 then 'resolved_by_version' when event_id%19=0 then 'partially_explained' end as resolution_status,
  case when event_id%3=0 then 'g' || (event_id%8) end as correlation_group,
  case when event_id%2=0 then 'numeric_pattern' end as method_family, event_type
  from events)
"""


def mrpi_query(spark, sf):
    return L.mrpi(event_findings(spark, sf))


def unify_query(spark, sf):
    first = event_findings(spark, sf)
    second = first.withColumns({"source_file": F.lit(None).cast("string"), "finding_id": F.lit(None).cast("string")})
    out = L.unify_findings(first, second)
    return out.select(
        "package_id", "rule_id", "source_file", "safe_report_language", "risk_level", "seq",
        F.col("finding_id").startswith("unified-").alias("was_unnamed"),
    )


def validate_query(spark, sf):
    return L.validate_ledger(event_findings(spark, sf)).select("package_id", "finding_id", "kind", "message")


def nested_query(spark, sf):
    """Findings with leaks below their top level: in evidence metadata (key and value), a claim id and a version."""
    eid = F.col("seq")
    key = F.when(eid % 37 == 0, "session-id").otherwise("tier")
    value = F.when(eid % 41 == 0, "copied from /home/u/notes/x.txt").otherwise("E1")
    leaky = F.transform("evidence", lambda e: e.withField("metadata", F.create_map(key, value)))
    rows = event_findings(spark, sf).withColumns(
        {
            "evidence": leaky,
            "claim_ids": F.when(eid % 43 == 0, F.array(F.lit("c1"), F.lit("see D:\\data\\c2"))),
            "source_versions": F.when(eid % 47 == 0, F.array(F.lit("proven fake"))),
        }
    )
    return L.validate_ledger(rows).where("kind <> 'schema error'").select("package_id", "finding_id", "kind", "message")


def scope_query(spark, sf):
    integrity, engineering, unknown = L.split_scope(event_findings(spark, sf))
    parts = [(integrity, "integrity"), (engineering, "engineering"), (unknown, "unknown")]
    out = None
    for df, name in parts:
        part = df.select(F.lit(name).alias("part"), "package_id", "finding_id")
        out = part if out is None else out.unionByName(part)
    return out


def summary_query(spark, sf):
    return L.findings_summary(event_findings(spark, sf))


def queue_query(spark, sf):
    return L.review_queue(event_findings(spark, sf))


def graph_nodes_query(spark, sf):
    return L.provenance_graph(event_findings(spark, sf))[0]


def graph_edges_query(spark, sf):
    return L.provenance_graph(event_findings(spark, sf))[1]


def module_status_query(spark, sf):
    e = table(spark, sf, "events")
    status = F.when(F.max("value") > 200, "failed").when(F.max("value") > 80, "warning").otherwise("success")
    metrics = e.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("package_id"), F.col("event_type").alias("module")).agg(
        F.when(F.count(F.lit(1)) < 5, "skipped").otherwise(status).alias("status"),
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(F.col("value") > 20).alias("findings"),
    )
    return L.module_status(metrics)


def roundtrip_query(spark, sf):
    """Valid findings published as a ledger and read back."""
    good = event_findings(spark, sf)
    bad = L.validate_ledger(good).select("package_id", "finding_id").distinct()
    path = scratch_path(spark, "ledger")
    write_ledger(good.join(bad, ["package_id", "finding_id"], "left_anti"), path)
    kept, issues = read_ledger(spark, path)
    counted = kept.withColumn("n_requests", F.size("manual_requests"))
    # the package is a folder name, so it is counted through the findings themselves
    return counted.groupBy("rule_id", "risk_level").agg(
        F.count(F.lit(1)).alias("findings"), F.sum("n_requests").alias("requests"), F.sum("seq").alias("seq_sum")
    )


def issues_query(spark, sf):
    """Ledger lines from the events, some of them cut off: what is kept and what becomes an issue."""
    e = table(spark, sf, "events")
    line = F.to_json(F.struct(F.concat(F.lit("f"), "event_id").alias("candidate_id"), F.col("event_type").alias("rule_id"), F.lit("low").alias("risk")))
    cut = F.expr("substring(line, 1, length(line) - 1 - event_id % 5)")
    lines = e.select("event_id", line.alias("line")).select(F.when(F.col("event_id") % 7 == 0, cut).otherwise(F.col("line")).alias("value"))
    path = scratch_path(spark, "lines")
    lines.write.text(path)
    kept, issues = read_ledger(spark, path)
    return kept.select(F.lit("finding").alias("kind"), F.concat_ws(" ", "finding_id", "type", "risk_level").alias("text")).unionByName(
        issues.select("kind", F.col("message").alias("text"))
    )


# whole texts with a planted ending per source and language
_PLANTED = """concat(text, case source when 'src1' then ' session_id: abc' when 'src2' then ' Fraud Confirmed' when 'src3' then ' see /srv/data/x.csv'
  when 'src4' then ' in raw_metadata/a' when 'src5' then ' C:/Users/x.txt' else '' end, case lang when 'de' then ' bearer abc' else '' end)"""


def safety_query(spark, sf):
    docs = table(spark, sf, "documents").withColumn("text", F.expr(_PLANTED))
    return L.safety_issues(docs, "doc_id", "text")


def safety_turns_query(spark, sf):
    turns = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), F.expr("concat(text, ' ', role, '_token: c:/tmp/', turn)").alias("text"))
    return L.safety_issues(turns, "turn_id", "text")


def redact_query(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.col("text"), F.lit(" guilty at /home/"), F.col("source"), F.lit("/x.txt Bearer "), F.col("lang")).alias("text"),
    )
    out = docs.select("doc_id", safety.redact_public_text(F.col("text")).alias("t"))
    return out.select("doc_id", F.length("t").cast("long").alias("n"), F.sha2("t", 256).alias("digest"))


def neutral_query(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", neutralize_formula(F.col("c_acctbal").cast("string")).alias("cell"))


def risk_functions_query(spark, sf):
    f = event_findings(spark, sf)
    return f.select(
        "finding_id",
        risk.cap_risk(F.col("risk_level"), F.col("rule_id")).alias("capped_default"),
        risk.cap_risk(F.col("risk_level"), F.lit("low")).alias("capped_low"),
        risk.stable_id("x-", F.col("package_id"), F.col("rule_id"), F.col("risk_level")).alias("stable_id"),
        risk.resolve_bilingual(
            F.create_map(F.lit("zh"), F.col("type"), F.lit("en"), F.when(F.col("seq") % 2 == 0, F.col("rule_id")).otherwise(""))
        ).alias("text"),
    )


QUERIES = {
    "mrpi": mrpi_query,
    "unify_findings": unify_query,
    "validate_ledger": validate_query,
    "validate_ledger_nested": nested_query,
    "split_scope": scope_query,
    "findings_summary": summary_query,
    "review_queue": queue_query,
    "provenance_nodes": graph_nodes_query,
    "provenance_edges": graph_edges_query,
    "module_status": module_status_query,
    "ledger_roundtrip": roundtrip_query,
    "ledger_issues": issues_query,
    "safety_issues": safety_query,
    "safety_issues_conversations": safety_turns_query,
    "redact_public_text": redact_query,
    "neutralize_formula_cells": neutral_query,
    "risk_functions": risk_functions_query,
}

_SOURCE = "coalesce(source_file, ev_source)"
_SCHEMA = """
 i as (select package_id, finding_id, seq, rule_id, risk_level, unnest([
   case when scope='unsupported_motive' then 'unsupported motive is not a finding scope' end,
   case when risk_level='minor' then 'risk level is unknown' end,
   case when ev_source is null then 'at least one evidence location is required' end,
   case when confidence>1 then 'confidence must lie in [0, 1]' end]) as message from f)
"""
_PHRASES = "['" + "','".join(safety.VERDICT_PHRASES) + "']"
_AUTH = safety.AUTH_NAME.replace("'", "''")
_BEARER = safety.BEARER.replace("'", "''")
_WIN = r"(?:\\\\\?\\)?[A-Za-z]:[\\/][^\\/\s\"''<>|][^\s\"''<>|]*"
_UNC = safety.UNC_PATH.replace("'", "''").replace(r"(?!\?\\)", "")
_POSIX = r"(^|[^:\w/])(/(?:[^/\s\"''<>|]+/)+[^/\s\"''<>|]+)"


def _safety_sql(src: str, key: str, text: str) -> str:
    return f"""with t as (select {key} as k, {text} as text from {src}),
      m as (select k, 'sensitive authentication material' as kind, 'sensitive authentication material found in public record' as message
        from t where regexp_matches(text, '{_AUTH}') or regexp_matches(text, '{_BEARER}')
       union all select k, 'forbidden phrase', 'forbidden phrase found: ' || p from t, unnest({_PHRASES}) u(p) where contains(lower(text), p)
       union all select k, 'private path leak', 'private/local path fragment found: ' || coalesce(case when contains(lower(text),'raw_metadata/') then 'raw_metadata/' end, nullif(regexp_extract(text, '({_WIN})', 1),''),
         nullif(regexp_extract(text, '({_UNC})', 1),''), nullif(regexp_extract(text, '{_POSIX}', 2),'')) from t
         where regexp_matches(text, '{_WIN}') or regexp_matches(text, '{_UNC}') or regexp_matches(text, '{_POSIX}') or contains(lower(text), 'raw_metadata/'))
      select k as {'doc_id' if src == 'documents' else 'turn_id'}, kind, message from m"""


ORACLES = {
    "mrpi": f"""with {FINDINGS_SQL},
      s as (select package_id, case when correlation_group is not null then 'explicit|' || correlation_group
          when {_SOURCE} is not null and table_id is not null and method_family is not null
          then 'family|' || {_SOURCE} || '|' || table_id || '|' || method_family end as key,
        case when scope='research_integrity' and finding_category<>'method_card' and open_for_scoring
          and coalesce(resolution_status,'')<>'resolved_by_version'
          then (case risk_level when 'high' then 0.35 when 'medium' then 0.15 else 0.05 end)::decimal(10,8) * least(1.0, confidence)::decimal(10,8) end score
        from f),
      k as (select package_id, key, max(score) t, sum(score) a, count(score) n from s group by all)
      select package_id, round(least(coalesce(sum(case when key is null then a else t end)::double, 0), 1.0)*100, 2) mrpi, sum(n)::bigint scored_findings from k group by 1""",
    "unify_findings": f"""with {FINDINGS_SQL},
      u as (select 0 as l, package_id, rule_id, coalesce(source_file, ev_source, 'unknown_file') source_file, 'level ' || risk_level safe_report_language,
         case when risk_level='high' and rule_id not like '%retract%' then 'medium' else risk_level end risk_level, seq, false was_unnamed from f
       union all select 1, package_id, rule_id, coalesce(ev_source, 'unknown_file'), 'level ' || risk_level,
         case when risk_level='high' and rule_id not like '%retract%' then 'medium' else risk_level end, seq, true from f),
      r as (select *, row_number() over (partition by package_id, rule_id, source_file, safe_report_language order by l, seq) rn from u)
      select package_id, rule_id, source_file, safe_report_language, risk_level, seq, was_unnamed from r where rn=1""",
    "validate_ledger": f"""with {FINDINGS_SQL}, {_SCHEMA} select package_id, finding_id, 'schema error' as kind, message from i where message is not null""",
    "validate_ledger_nested": f"""with {FINDINGS_SQL}, ok as (select * from f where scope<>'unsupported_motive' and risk_level<>'minor' and ev_source is not null and confidence<=1)
      select package_id, finding_id, 'sensitive authentication material' as kind, 'sensitive authentication field found: session_id' as message from ok where seq%37=0
      union all select package_id, finding_id, 'private path leak', 'private/local path fragment found: /home/u/notes/x.txt' from ok where seq%41=0
      union all select package_id, finding_id, 'private path leak', 'private/local path fragment found: D:\\data\\c2' from ok where seq%43=0
      union all select package_id, finding_id, 'forbidden phrase', 'forbidden phrase found: proven fake' from ok where seq%47=0""",
    "split_scope": f"""with {FINDINGS_SQL} select case scope when 'research_integrity' then 'integrity' else 'engineering' end part, package_id, finding_id
      from f where scope<>'unsupported_motive'""",
    "findings_summary": f"""with {FINDINGS_SQL}
      select finding_category, rule_id, count(*) filter (risk_level in ('low','minor')) as low, count(*) filter (risk_level='medium') as medium,
      count(*) filter (risk_level='high') as high, count(*) filter (coalesce(resolution_status,'')='resolved_by_version') as historical, count(*) as total
      from f group by rollup (finding_category, rule_id)""",
    "review_queue": f"""with {FINDINGS_SQL},
      q as (select package_id, risk_level, 'question' as kind, unnest([req1, req2]) as text from f where scope='research_integrity'
       union all select package_id, risk_level, 'limitation', 'one event only' from f where scope='research_integrity'
       union all select package_id, risk_level, 'engineering_question', 'level ' || risk_level from f where scope='engineering_plausibility')
      select package_id, kind, text, count(*) findings, count(*) filter (risk_level='high') high_findings from q group by all""",
    "provenance_nodes": f"""with {FINDINGS_SQL},
      s as (select *, regexp_replace(coalesce(source_file, ev_source, 'unknown_source'), '^.*/', '') src from f)
      select distinct package_id, 'package:' || package_id as node_id, 'package' as node_type, package_id as label from s
      union all select distinct package_id, 'source:' || src, 'source_file', src from s
      union all select distinct package_id, 'rule:' || rule_id, 'rule', rule_id from s
      union all select package_id, 'finding:' || finding_id, 'finding', finding_id from s
      union all select package_id, 'question:' || finding_id || '-q1', 'verification_question', req1 from s
      union all select package_id, 'question:' || finding_id || '-q2', 'verification_question', req2 from s""",
    "provenance_edges": f"""with {FINDINGS_SQL},
      s as (select *, 'source:' || regexp_replace(coalesce(source_file, ev_source, 'unknown_source'), '^.*/', '') src from f)
      select distinct package_id, 'package:' || package_id as source, src as target, 'contains' as relation_type from s
      union all select package_id, src, 'finding:' || finding_id, 'triggered_in' from s
      union all select package_id, 'rule:' || rule_id, 'finding:' || finding_id, 'defined' from s
      union all select package_id, 'finding:' || finding_id, 'question:' || finding_id || '-q1', 'verified_by' from s
      union all select package_id, 'finding:' || finding_id, 'question:' || finding_id || '-q2', 'verified_by' from s""",
    "module_status": """with m as (select 'u' || user_id as package_id, event_type, case when count(*)<5 then 'skipped' when max(value)>200 then 'failed'
       when max(value)>80 then 'warning' else 'success' end status, count(*) n, count(*) filter (value>20) f from events group by all)
      select package_id, count(*) modules, count(*) filter (status='skipped') skipped, sum(n)::bigint input_rows, sum(f)::bigint findings,
      case when bool_or(status='failed') then 'failed' when bool_or(status='warning') then 'warning' else 'success' end overall_status from m group by 1""",
    "ledger_roundtrip": f"""with {FINDINGS_SQL}, {_SCHEMA}
      select rule_id, risk_level, count(*) findings, (count(*)*2)::bigint requests, sum(seq)::bigint seq_sum from f
      where finding_id not in (select finding_id from i where message is not null) group by all""",
    "ledger_issues": """with l as (select event_id, event_type, '{"candidate_id":"f' || event_id || '","rule_id":"' || event_type || '","risk":"low"}' as line from events)
      select case when event_id%7=0 then 'json error' else 'finding' end as kind,
      case when event_id%7=0 then substring(line, 1, length(line) - 1 - event_id%5) else 'f' || event_id || ' ' || event_type || ' low' end as text from l""",
    "safety_issues": _safety_sql("documents", "doc_id", _PLANTED),
    "safety_issues_conversations": _safety_sql(
        "conversations", "conv_id || '-' || turn", "concat(text, ' ', role, '_token: c:/tmp/', turn)"
    ),
    "redact_public_text": f"""with t as (select doc_id, text || ' guilty at /home/' || source || '/x.txt Bearer ' || lang as text from documents),
      a as (select doc_id, regexp_replace(regexp_replace(text, '{safety.AUTH_VALUE.replace("'", "''")}', '<redacted-auth>', 'g'), '{_BEARER}', 'Bearer <redacted-auth>', 'g') text from t),
      b as (select doc_id, regexp_replace(regexp_replace(text, '{_WIN}', '<local-path>', 'g'), '{_POSIX}', '\\1<local-path>', 'g') text from a),
      c as (select doc_id, regexp_replace(text, '(?i)({'|'.join(safety.VERDICT_PHRASES)})', '<redacted-verdict-language>', 'g') t from b)
      select doc_id, length(t)::bigint as n, sha256(t) as digest from c""",
    "neutralize_formula_cells": """select c_custkey, case when regexp_matches(c_acctbal::varchar, '^[=+@-]') then '''' || c_acctbal::varchar
      else c_acctbal::varchar end as cell from customer""",
    "risk_functions": f"""with {FINDINGS_SQL}
      select finding_id, case when risk_level='high' then 'medium' else risk_level end capped_default,
       case when risk_level in ('high','medium') then 'low' else risk_level end capped_low,
       'x-' || substr(sha256(array_to_string(list_sort([package_id, rule_id, risk_level]), '|')), 1, 12) stable_id,
       case when seq%2=0 then rule_id else event_type end as text from f""",
}
