"""Photovoltaic checks bound to metric rows derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.bindings.common import table
from plumbline.operators import pv as P
from plumbline.session import materialize
from plumbline.sources.frames import cells_from_dataframe

# (header, value); k is the order key, c the customer key. Both engines read the same text.
_COLUMNS = [
    ("Device ID", "concat('dev', k % 300)"),
    ("Voc (mV)", "cast(600 + c % 600 as varchar(20))"),
    ("Jsc (mA/cm2)", "cast((1500 + k * 7 % 1000) / 100.0e0 as varchar(20))"),
    ("FF (%)", "cast(60 + c % 25 as varchar(20))"),
    ("PCE (%)", "cast((500 + k * 13 % 1500) / 100.0e0 as varchar(20))"),
    ("EQE Jsc (mA/cm2)", "cast((1400 + k * 11 % 1100) / 100.0e0 as varchar(20))"),
    ("bandgap (eV)", "case when k % 9 = 0 then '' else cast((110 + c % 60) / 100.0e0 as varchar(20)) end"),
    ("light intensity (W/m2)", "case k % 10 when 0 then '' when 1 then 'n/a' when 2 then '0' when 3 then '800' else '1000' end"),
    ("Scan direction", "case when k % 2 = 0 then 'forward' else 'reverse' end"),
    ("temperature log", "'none'"),
    ("XRD angle", "'12'"),
    ("Sample group", "concat('g', k % 4)"),
]
_TANDEM = [
    ("architecture", "case k % 5 when 0 then '2T' when 1 then '4T' when 2 then '4-terminal' else 'stack' end"),
    ("Top Jsc", "cast(15 + k % 6 as varchar(20))"),
    ("Bottom Jsc", "case when k % 7 = 0 then '' else cast(15 + c % 6 as varchar(20)) end"),
    ("Top PCE", "cast(15 + k % 9 as varchar(20))"),
    ("Bottom PCE", "cast(8 + c % 5 as varchar(20))"),
    ("Tandem PCE", "cast(22 + k % 12 as varchar(20))"),
]


def pv_cells(spark, sf):
    """Five tables, one per order priority; every second one lacks some columns' values."""
    o = table(spark, sf, "orders").selectExpr("o_orderkey as k", "o_custkey as c", "o_orderpriority as p")
    cols = o.select("k", "p", *[F.expr(e.replace("varchar(20)", "string")).alias(h) for h, e in _COLUMNS])
    return cells_from_dataframe(cols, F.concat(F.lit("pv-"), "p"), F.col("k"), [h for h, _ in _COLUMNS])


def tandem_cells(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey as k", "o_custkey as c", "o_orderpriority as p")
    cols = o.select("k", "p", *[F.expr(e.replace("varchar(20)", "string")).alias(h) for h, e in _TANDEM])
    return cells_from_dataframe(cols, F.concat(F.lit("tandem-"), "p"), F.col("k"), [h for h, _ in _TANDEM])


# The SQL twin works on the numbers themselves.
_SQL = """
 o as (select o_orderkey k, o_custkey c, o_orderpriority p from orders),
 m as (select 'pv-' || p as table_id, k as row_index, 'dev' || (k%300) as device_id, (600 + c%600)/1000.0::double as voc_v,
   (1500 + k*7%1000)/100.0::double as jsc_ma_cm2, (60 + c%25)/100.0::double as ff,
   case when (500 + k*13%1500)/100.0::double <= 1.0 then (500 + k*13%1500)::double else (500 + k*13%1500)/100.0::double end as pce_percent,
   (1400 + k*11%1100)/100.0::double as eqe_jsc_ma_cm2, case when k%9=0 then null else (110 + c%60)/100.0::double end as bandgap_ev,
   case when k%10 in (0,1,2) then null when k%10=3 then 80.0::double else 100.0::double end as light_intensity_mw_cm2,
   case when k%2=0 then 'forward' else 'reverse' end as scan_direction, 'g' || (k%4) as condition_label from o)
"""


def rows_query(spark, sf):
    r = P.pv_metric_rows(pv_cells(spark, sf))
    return r.select(
        "table_id", "row_index", "device_id", *[F.round(c, 9).alias(c) for c in ("voc_v", "jsc_ma_cm2", "ff", "pce_percent", "eqe_jsc_ma_cm2", "bandgap_ev", "light_intensity_mw_cm2")],
        "scan_direction", "condition_label",
    )


def headers_query(spark, sf):
    m = P.map_headers(pv_cells(spark, sf).unionByName(tandem_cells(spark, sf)))
    return m.select("column_name", "field", "confidence", "unit_hint", "role")


def pce_query(spark, sf):
    r = P.pce_consistency_rows(P.pv_metric_rows(pv_cells(spark, sf)))
    return r.select("table_id", "row_index", F.round("recomputed_pce", 9).alias("recomputed_pce"), "kind", "risk_level")


def eqe_jv_query(spark, sf):
    r = P.eqe_jv_rows(P.pv_metric_rows(pv_cells(spark, sf)))
    return r.select("table_id", "row_index", F.round("relative_gap", 6).alias("relative_gap"), "risk_level")


def voc_query(spark, sf):
    r = P.voc_loss_rows(P.pv_metric_rows(pv_cells(spark, sf)))
    return r.select("table_id", "row_index", F.round("voc_loss", 6).alias("voc_loss"), "kind", "risk_level")


def tandem_query(spark, sf):
    r = P.tandem_rows(P.pv_metric_rows(tandem_cells(spark, sf)))
    return r.select("table_id", "row_index", "kind", "risk_level", "is_2t", "is_4t")


def _gaps(df, *extra):
    return df.select("table_id", *extra, F.concat_ws(", ", "missing").alias("missing"))


def completeness_query(spark, sf):
    cells = pv_cells(spark, sf)
    return _gaps(P.table_completeness(cells, P.pv_metric_rows(cells)))


def stability_query(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey as k", "o_orderpriority as p")
    cols = o.select(
        "k", "p", F.lit("120").alias("T80 (h)"), F.expr("case when p like '1%' then 'n/a' else '85' end").alias("stage temp"), F.lit("N/A").alias("atmosphere")
    )
    cells = cells_from_dataframe(cols, F.concat(F.lit("st-"), "p"), F.col("k"), ["T80 (h)", "stage temp", "atmosphere"])
    return _gaps(P.stability_completeness(cells, P.pv_metric_rows(cells)))


def characterization_query(spark, sf):
    return _gaps(P.characterization_completeness(pv_cells(spark, sf)), "method")


def ruleset_query(spark, sf):
    cells = pv_cells(spark, sf)
    return _gaps(P.evidence_ruleset(cells, P.pv_metric_rows(cells)), "rule_id", "category", "risk_ceiling")


def domain_query(spark, sf):
    o = table(spark, sf, "part").selectExpr("p_partkey as k", "p_type as p", "p_name as `model name`", "p_size as `sample size`", "p_retailprice as accuracy")
    cells = cells_from_dataframe(o, F.concat(F.lit("d-"), "p"), F.col("k"), ["model name", "sample size", "accuracy"])
    return P.route_domain(cells).select("table_id", "rank", "domain_id", "score")


def findings_query(spark, sf):
    """All photovoltaic checks of one job, as findings."""
    cells = pv_cells(spark, sf)
    # read by four checks; written once, the cells are not typed again for each
    rows = materialize(P.pv_metric_rows(cells), "pv-rows")
    parts = [
        P.pce_consistency(rows),
        P.eqe_jv_consistency(rows),
        P.voc_loss(rows),
        P.completeness_findings(P.table_completeness(cells, rows), "pv_reporting_completeness"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("rule_id", "type", "risk_level").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("finding_id").alias("ids"))


QUERIES = {
    "pv_metric_rows": rows_query,
    "map_pv_header": headers_query,
    "pce_consistency": pce_query,
    "eqe_jv_consistency": eqe_jv_query,
    "voc_loss": voc_query,
    "tandem_consistency": tandem_query,
    "table_completeness": completeness_query,
    "stability_completeness": stability_query,
    "characterization_completeness": characterization_query,
    "evidence_ruleset": ruleset_query,
    "route_domain": domain_query,
    "pv_findings": findings_query,
}

_PCE = """ q as (select *, case when light_intensity_mw_cm2 is null then null else voc_v*jsc_ma_cm2*ff/light_intensity_mw_cm2*100.0 end recomputed_pce from m),
 pce as (select table_id, row_index, round(recomputed_pce, 9) recomputed_pce, case when recomputed_pce is null then 'missing_illumination' else 'pce_mismatch' end kind,
   case when recomputed_pce is null then 'low' else 'medium' end risk_level from q
   where recomputed_pce is null or abs(pce_percent-recomputed_pce)>0.3 or abs(pce_percent-recomputed_pce)/greatest(abs(pce_percent),1e-6)>0.03),
 ej as (select table_id, row_index, round(abs(jsc_ma_cm2-eqe_jsc_ma_cm2)/abs(jsc_ma_cm2), 6) relative_gap,
   case when abs(jsc_ma_cm2-eqe_jsc_ma_cm2)>1.0 and abs(jsc_ma_cm2-eqe_jsc_ma_cm2)/abs(jsc_ma_cm2)>0.10 then 'medium' else 'low' end risk_level from m
   where abs(jsc_ma_cm2-eqe_jsc_ma_cm2)/abs(jsc_ma_cm2)>0.05),
 vl as (select table_id, row_index, round(bandgap_ev-voc_v, 6) voc_loss, case when bandgap_ev-voc_v<0.05 then 'small_loss' else 'large_loss' end kind,
   case when bandgap_ev-voc_v<0.05 then 'medium' else 'low' end risk_level from m where bandgap_ev-voc_v<0.05 or bandgap_ev-voc_v>0.65)
"""
_TABLES = "(select distinct o_orderpriority p from orders)"
# rules whose evidence the bound tables lack; "sam" of the sample group and the XRD column count as evidence
_MISSING = ",".join(
    f"('{rule}','{category}','{ceiling}','{', '.join(needed)}')"
    for rule, category, needed, ceiling in P.EVIDENCE_RULES
    if rule
    not in (
        "pv_jv_scan_direction_completeness",
        "pv_jv_light_intensity_completeness",
        "pv_eqe_integrated_jsc_consistency",
        "pv_tandem_bandgap_completeness",
        "pv_tandem_current_matching",
        "pv_materials_sam_interface",
        "pv_materials_metadata",
    )
)
ORACLES = {
    "pv_metric_rows": f"""with {_SQL} select table_id, row_index, device_id, round(voc_v,9) voc_v, round(jsc_ma_cm2,9) jsc_ma_cm2, round(ff,9) ff, round(pce_percent,9) pce_percent,
      round(eqe_jsc_ma_cm2,9) eqe_jsc_ma_cm2, round(bandgap_ev,9) bandgap_ev, round(light_intensity_mw_cm2,9) light_intensity_mw_cm2, scan_direction, condition_label from m""",
    "map_pv_header": """select column_name, field, confidence, unit_hint, role from (values
      ('Device ID',null,null,'eV','device_id'),('Voc (mV)','voc_v',0.95,'mv',null),('Jsc (mA/cm2)','jsc_ma_cm2',0.95,'ma/cm2',null),
      ('FF (%)','ff',0.95,'%',null),('PCE (%)','pce_percent',0.95,'%',null),('EQE Jsc (mA/cm2)','eqe_jsc_ma_cm2',0.95,'ma/cm2',null),
      ('bandgap (eV)','bandgap_ev',0.95,'ev',null),('light intensity (W/m2)','light_intensity_mw_cm2',0.95,'w/m2',null),
      ('Scan direction','scan_direction',0.95,null,null),('temperature log','temperature_c',0.95,null,null),('XRD angle',null,null,null,null),
      ('Sample group',null,null,null,'condition_label'),('architecture',null,null,null,'architecture'),('Top Jsc','jsc_ma_cm2',0.95,null,null),
      ('Bottom Jsc','jsc_ma_cm2',0.95,null,null),('Top PCE','pce_percent',0.95,null,null),('Bottom PCE','pce_percent',0.95,null,null),('Tandem PCE','pce_percent',0.95,null,null))
      t(column_name, field, confidence, unit_hint, role) where exists (select 1 from orders)""".replace("0.95", "0.95::double"),
    "pce_consistency": f"with {_SQL}, {_PCE} select * from pce",
    "eqe_jv_consistency": f"with {_SQL}, {_PCE} select * from ej",
    "voc_loss": f"with {_SQL}, {_PCE} select * from vl",
    "tandem_consistency": """with o as (select o_orderkey k, o_custkey c, o_orderpriority p from orders),
      t as (select 'tandem-' || p table_id, k row_index, k%5 a, 15+k%6 tj, case when k%7=0 then null else 15+c%6 end bj, 15+k%9 tp, 8+c%5 bp, 22+k%12 tot from o),
      w as (select *, case when a in (1,2) then true when a=0 then false else abs(tot-(tp+bp))<1.0 end f4,
        case when a in (1,2) then false when a=0 then true else abs(tot-(tp+bp))>=1.0 end f2 from t),
      i as (select *, unnest([case when f4 and tot>tp+bp+0.3 then 'total_exceeds_sum' end, case when f2 and abs(tj-bj)/least(tj,bj)::double>0.15 then 'current_mismatch' end,
        case when f2 then 'reporting_gap' end]) kind from w)
      select table_id, row_index, kind, case when kind='reporting_gap' then 'low' else 'medium' end risk_level, f2 as is_2t, f4 as is_4t from i where kind is not null""",
    "table_completeness": f"""select 'pv-' || p as table_id, 'device area, scan rate, test environment, light source calibration' as missing from {_TABLES}""",
    "stability_completeness": f"""select 'st-' || p as table_id, case when p like '1%' then 'temperature, ' else '' end || 'humidity or atmosphere, illumination, electrical bias, encapsulation, retention' as missing from {_TABLES}""",
    "characterization_completeness": f"""select 'pv-' || p as table_id, 'XRD' as "method", 'radiation source, scan rate or step size' as missing from {_TABLES}""",
    "evidence_ruleset": f"""select 'pv-' || p as table_id, rule_id, category, risk_ceiling, missing from {_TABLES},
      (values {_MISSING}) v(rule_id, category, risk_ceiling, missing)""",
    "route_domain": """with t as (select distinct 'd-' || p_type table_id from part),
      s(domain_id, score) as (values ('ai_ml',0.5::double),('clinical',0.1667),('psychology_social_science',0.1667),('materials_characterization',0.25),('biomedical',0.0),('chemistry',0.0)),
      r as (select *, row_number() over (order by score desc, domain_id) rk from s) select table_id, rk::int as "rank", domain_id, score from t, r""",
    "pv_findings": f"""with {_SQL}, {_PCE},
      a as (select 'pv_pce_consistency' rule_id, kind as "type", risk_level from pce union all select 'pv_eqe_jv_jsc_consistency', 'eqe_jv_gap', risk_level from ej
        union all select 'pv_voc_loss_consistency', kind, risk_level from vl union all select 'pv_reporting_completeness', 'reporting_gap', 'low' from {_TABLES})
      select rule_id, "type", risk_level, count(*) findings, count(*) ids from a group by all""",
}
