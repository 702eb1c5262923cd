"""Curve operators and readers bound to the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.bindings.common import table
from plumbline.bindings.files import write_each
from plumbline.operators import curves as C
from plumbline.session import scratch_path
from plumbline.sources import curves as R
from plumbline.sources.frames import points_from_dataframe

_X = "(event_id % 130) / 100.0e0 - 0.1e0"
_Y = "22.0e0 - value"
_CURVE = "concat('u', user_id, '_', event_id % 3)"
_DIRECTION = "case when event_id % 3 = 0 then 'forward' else 'reverse' end"
_DEVICE = "case when user_id % 40 = 7 then 'unknown' else concat('dev', user_id % 40) end"
_FILE = "concat('run', user_id % 40, '-', user_id, case when event_id % 3 = 0 then '_fwd' else '_rev' end, '.csv')"


def sweep_points(spark, sf):
    """Three sweeps per user; event order is the sweep order."""
    e = table(spark, sf, "events")
    return points_from_dataframe(
        e, F.expr(_CURVE), F.col("event_id"), F.expr(_X), F.expr(_Y), F.expr(_DEVICE), F.expr(_FILE), F.expr(_DIRECTION)
    )


def spectrum_points(spark, sf):
    e = table(spark, sf, "events")
    return points_from_dataframe(
        e, F.expr("concat('e', user_id)"), F.col("event_id"), F.expr("300.0e0 + event_id * 37 % 900"), F.expr("value / 500.0e0"), F.expr(_DEVICE)
    )


def reported_rows(spark, sf):
    """One reported row per customer of the first devices."""
    c = table(spark, sf, "customer")
    return c.select(
        F.concat(F.lit(" DEV"), (F.col("c_custkey") % 60).cast("string")).alias("device_id"),
        ((F.col("c_custkey") % 90) / 100.0).alias("voc_v"),
        (15.0 + F.col("c_custkey") % 7).alias("jsc_ma_cm2"),
        ((40.0 + F.col("c_custkey") % 50) / 100.0).alias("ff"),
        (5.0 + F.col("c_custkey") % 11).alias("pce_percent"),
        (10.0 + F.col("c_custkey") % 13).alias("eqe_jsc_ma_cm2"),
    )


def metrics_query(spark, sf):
    m = C.jv_metrics(sweep_points(spark, sf))
    return m.select(
        "curve_id", "device_id", "n_points",
        *[F.round(c, 6).alias(c) for c in ("jsc_ma_cm2", "voc_v", "vmp_v", "jmp_ma_cm2", "pmp_mw_cm2", "ff", "pce_percent")],
        F.concat_ws(";", "warnings").alias("warnings"),
    )


def integration_query(spark, sf):
    r = C.eqe_integration(spectrum_points(spark, sf), R.builtin_reference(spark))
    return r.select("curve_id", "n_points", F.round("integrated_jsc_ma_cm2", 6).alias("jsc"), F.concat_ws(";", "warnings").alias("warnings"))


def pairs_query(spark, sf):
    p = C.hysteresis_pairs(C.jv_metrics(sweep_points(spark, sf)))
    return p.select(
        "device_id", "place", "forward_curve", "reverse_curve", F.round("hysteresis_index", 6).alias("hysteresis_index"), F.round("abs_delta_pce", 6).alias("abs_delta_pce"), "risk_level"
    )


def jv_reported_query(spark, sf):
    r = C.reconcile_jv_reported(C.jv_metrics(sweep_points(spark, sf)), reported_rows(spark, sf))
    return r.select("curve_id", "reported_voc_v", "reported_jsc_ma_cm2", "reported_ff", "reported_pce_percent", "reported_rows", F.concat_ws(",", "mismatches").alias("mismatches"))


def eqe_reported_query(spark, sf):
    e = C.eqe_integration(spectrum_points(spark, sf), R.builtin_reference(spark))
    r = C.reconcile_eqe_reported(e, reported_rows(spark, sf))
    return r.select("curve_id", "reported_jsc", "reported_rows")


def jv_ranges_query(spark, sf):
    """Sweeps whose reported values lie outside the tolerances, as ranges."""
    r = C.outside_tolerance(C.jv_metrics(sweep_points(spark, sf)), reported_rows(spark, sf), C.TOLERANCES)
    return r.select("curve_id", "metric", *RANGE_COLUMNS)


def eqe_ranges_query(spark, sf):
    e = C.eqe_integration(spectrum_points(spark, sf), R.builtin_reference(spark)).withColumnRenamed("integrated_jsc_ma_cm2", "eqe_jsc_ma_cm2")
    r = C.outside_tolerance(e, reported_rows(spark, sf), C.EQE_TOLERANCE)
    return r.select("curve_id", "metric", *RANGE_COLUMNS)


RANGE_COLUMNS = ["below", "below_least", "below_most", "above", "above_least", "above_most"]


def eqe_jv_query(spark, sf):
    e = C.eqe_integration(spectrum_points(spark, sf), R.builtin_reference(spark))
    r = C.reconcile_eqe_jv(e, C.jv_metrics(sweep_points(spark, sf)))
    return r.select("curve_id", "jv_curve", F.round("relative_gap", 6).alias("relative_gap"))


# One fit record per order; every third brings parameters.
def decay_records(spark, sf):
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    part = lambda a, t, u: F.struct(a.cast("double").alias("amplitude"), t.cast("string").alias("lifetime"), F.lit(u).alias("unit"))
    return o.select(
        F.concat(F.lit("r"), F.lpad(k.cast("string"), 9, "0")).alias("record_id"),
        F.when(k % 2 == 0, "trpl").otherwise("tpv").alias("decay_type"),
        F.concat(F.lit("s"), (c % 200).cast("string")).alias("sample_id"),
        F.concat(F.lit("v"), (c % 3).cast("string")).alias("source_version"),
        F.when(k % 4 == 0, "si").when(k % 4 == 1, "Source_Data").otherwise("main").alias("source_document"),
        F.when(k % 5 > 0, (100 + k % 300).cast("double")).alias("reported_average"),
        F.when(k % 7 == 0, "us").otherwise("ns").alias("reported_unit"),
        F.when(k % 6 == 0, F.lit(None).cast("string")).when(k % 6 < 4, "Amplitude-Weighted").otherwise("intensity weighted").alias("declared_formula"),
        F.when(k % 3 == 0, F.array(part(1 + k % 4, 50 + c % 100, "ns"), part(2 + c % 3, 200 + k % 90, "ns"))).alias("components"),
        (k % 10 != 0).alias("human_confirmed"),
    )


def decay_query(spark, sf):
    r = C.decay_fit_consistency(decay_records(spark, sf))
    return r.select("record_id", "kind", "risk_level", "parameter_record", F.round("recomputed_ns", 6).alias("recomputed_ns"))


def _user_files(spark, sf, label, header, line, suffix, prefix):
    """One text file per user, lines in event order."""
    path = scratch_path(spark, label)
    e = table(spark, sf, "events")
    texts = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", F.expr(line).alias("t")))).alias("e"))
    body = F.concat(F.lit(header), F.concat_ws("\n", F.transform("e", lambda x: x["t"])), F.lit("\n\n"))
    write_each(texts.select(body.alias("value")), f"{path}/{prefix}", suffix)
    return path


def read_jv_query(spark, sf):
    path = _user_files(spark, sf, "jv", "#exported\nBias (V);J (mA/cm2)\n", "concat(cast(event_id % 130 as string), ';', cast(value as string))", "_fwd.csv", "jv")
    points, warnings = R.read_jv_points(spark, f"{path}/jv")
    return points.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("curve_id").alias("curves"), F.sum("x").alias("sum_x"), F.round(F.sum("y"), 3).alias("sum_y"), F.min("scan_direction").alias("direction")
    )


def read_eqe_query(spark, sf):
    path = _user_files(spark, sf, "eqe", "Wavelength (um)\tEQE (%)\n", "concat(cast((300 + event_id * 37 % 900) / 1000.0e0 as string), '\t', cast(value as string))", ".txt", "eqe")
    points, warnings = R.read_eqe_points(spark, f"{path}/eqe")
    return points.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("curve_id").alias("curves"), F.round(F.sum("x"), 3).alias("sum_x"), F.round(F.sum("y"), 4).alias("sum_y")
    )


def reference_query(spark, sf):
    """A reference spectrum with one row per nation-sized wavelength step, written and read back."""
    path = scratch_path(spark, "ref")
    s = table(spark, sf, "supplier").select((300 + F.col("s_suppkey")).cast("string").alias("wavelength_nm"), (F.col("s_nationkey") / 10.0).alias("spectral_irradiance"))
    s.write.option("header", "true").csv(path)
    r = R.read_reference_spectrum(spark, path)
    return r.agg(F.count(F.lit(1)).alias("n"), F.sum("wavelength_nm").alias("w"), F.round(F.sum("irradiance"), 3).alias("irr"))


def reported_query(spark, sf):
    path = scratch_path(spark, "reported")
    c = table(spark, sf, "customer").select(
        F.col("c_name").alias("Device ID"), (600 + F.col("c_custkey") % 500).alias("Voc (mV)"), (15 + F.col("c_custkey") % 7).alias("Jsc (mA/cm2)"), (60 + F.col("c_custkey") % 30).alias("FF (%)")
    )
    c.write.option("header", "true").csv(path)
    r = R.read_reported_metrics(spark, path)
    return r.select("device_id", F.round("voc_v", 6).alias("voc_v"), "jsc_ma_cm2", F.round("ff", 6).alias("ff"))


def manifest_query(spark, sf):
    path = _user_files(spark, sf, "raw", "v,j\n", "concat(event_id, ',', value)", "_dev7.csv", "jv")
    table(spark, sf, "nation").select("n_name").write.text(f"{path}/other")
    m = R.raw_measurement_manifest(spark, path)
    data = m.where(~F.col("source_file").startswith("_") & ~F.col("source_file").startswith("."))
    return data.where(F.col("size_bytes") > 0).groupBy("input_type", F.col("warning").isNotNull().alias("warned")).agg(F.count_if(F.col("device_id_guess") == "dev7").alias("named"))


def image_query(spark, sf):
    """Documents of the two shortest sources written as image-named files; equal texts give equal hashes."""
    path = scratch_path(spark, "images")
    html = F.coalesce(F.concat("html", F.lit("\n")), F.lit(""))
    write_each(table(spark, sf, "pages").select(F.concat(html, F.lit("\u0001")).alias("value")), path, ".png")
    m = R.image_manifest(spark, path)
    return m.groupBy("sha256").agg(F.count(F.lit(1)).alias("files"), F.min("file_ext").alias("file_ext"), F.countDistinct("image_id").alias("ids"))


QUERIES = {
    "jv_metrics": metrics_query,
    "eqe_integration": integration_query,
    "hysteresis_pairs": pairs_query,
    "reconcile_jv_reported": jv_reported_query,
    "reconcile_eqe_reported": eqe_reported_query,
    "reconcile_eqe_jv": eqe_jv_query,
    "outside_tolerance_jv": jv_ranges_query,
    "outside_tolerance_eqe": eqe_ranges_query,
    "decay_fit_consistency": decay_query,
    "read_jv_points": read_jv_query,
    "read_eqe_points": read_eqe_query,
    "read_reference_spectrum": reference_query,
    "read_reported_metrics": reported_query,
    "raw_measurement_manifest": manifest_query,
    "image_manifest": image_query,
}

POINTS_SQL = f""" p as (select {_CURVE} curve_id, {_DEVICE} device_id, {_FILE} source_file, {_DIRECTION} scan_direction, event_id seq, {_X} x, {_Y} y from events)"""
METRICS_SQL = f""" {POINTS_SQL},
 n as (select *, lead(x) over (partition by curve_id order by seq) nx, lead(y) over (partition by curve_id order by seq) ny from p),
 z as (select *, (x<=0 and nx>=0) or (nx<=0 and x>=0) vc, (y<=0 and ny>=0) or (ny<=0 and y>=0) jc,
   case when x=nx then y else y+(0.0-x)*(ny-y)/(nx-x) end jz, case when y=ny then x else x+(0.0-y)*(nx-x)/(ny-y) end vz,
   case when x>0 and y>0 then x*y else 0.0 end pp, case when x>0 and y<0 then -x*y else 0.0 end pd from n),
 a as (select curve_id, max(device_id) device_id, max(source_file) source_file, max(scan_direction) scan_direction, count(*) n_points, bool_and(x<=nx) up, bool_and(x>=nx) down,
   arg_min(jz, seq) filter (vc) j0, arg_min(vz, seq) filter (jc) v0, arg_min(y, seq) jf from z group by 1),
 nj as (select curve_id, y jn from (select *, row_number() over (partition by curve_id order by abs(x), seq) r from p) where r=1),
 nv as (select curve_id, x vn from (select *, row_number() over (partition by curve_id order by abs(y), seq) r from p) where r=1),
 bp as (select curve_id, x, y, pp from (select *, row_number() over (partition by curve_id order by pp desc, seq) r from z) where r=1),
 bd as (select curve_id, x, y, pd from (select *, row_number() over (partition by curve_id order by pd desc, seq) r from z) where r=1),
 b as (select a.*, abs(coalesce(j0, jn)) jsc, abs(coalesce(v0, vn)) voc, coalesce(j0, jf)<0 diode, case when coalesce(j0, jf)<0 then bd.x else bp.x end vmp,
   case when coalesce(j0, jf)<0 then bd.y else bp.y end jmp, case when coalesce(j0, jf)<0 then bd.pd else bp.pp end pmp
   from a join nj using (curve_id) join nv using (curve_id) join bp using (curve_id) join bd using (curve_id)),
 m as (select *, case when pmp>0 and voc*jsc>0 then pmp/(voc*jsc) else 0.0 end ff, case when pmp>0 then pmp/100.0*100.0 else 0.0 end pce from b)
"""
_REF = ",".join(f"({w}::double,{i}::double)" for w, i in R.REFERENCE_SPECTRUM)
EQE_SQL = f""" s as (select 'e' || user_id curve_id, {_DEVICE} device_id, event_id seq, 300.0e0 + event_id*37%900 x, value/500.0e0 y from events),
 sn as (select *, lead(x) over w nx, lead(y) over w ny, row_number() over w rn from s window w as (partition by curve_id order by x, seq)),
 ref(w, irr) as (values {_REF}), rw as (select *, lag(w) over (order by w) pw, lead(w) over (order by w) nw from ref),
 hit as (select curve_id, w, irr, pw, nw, case when x=nx then y else y+(w-x)*(ny-y)/(nx-x) end e,
    row_number() over (partition by curve_id, w order by rn) k from sn join rw on w>=x and w<=nx),
 eq as (select curve_id, sum(e*irr*w*8.0655446e-5*0.5*(coalesce(nw,w)-coalesce(pw,w))) jsc from hit where k=1 group by 1),
 ef as (select curve_id, max(device_id) device_id, count(*) n_points, min(x) mn, max(x) mx, bool_or(y<-0.05 or y>1.05) odd from s group by 1),
 er as (select ef.*, coalesce(jsc, 0.0) jsc from ef left join eq using (curve_id))
"""
REPORTED_SQL = """ rep as (select 'dev' || (c_custkey%60) device, (c_custkey%90)/100.0::double v, (15+c_custkey%7)::double j, (40+c_custkey%50)/100.0::double f,
   (5+c_custkey%11)::double p, (10+c_custkey%13)::double e from customer)"""
_WARN = """concat_ws(';', case when n_points<5 then 'too few points' end, case when not coalesce(up, true) and not coalesce(down, true) then 'non-monotonic voltage sweep' end,
   case when j0 is null then 'no voltage zero crossing' end, case when v0 is null then 'no current zero crossing' end, case when diode then 'sign convention inferred' end,
   case when pmp<=0 then 'no generated power' end, case when voc>3 or jsc>100 or ff>1 or pce>50 then 'unrealistic metric' end)"""

_RANGES = """ select curve_id, metric, count(*) filter (r<lo) below, min(r) filter (r<lo) below_least, max(r) filter (r<lo) below_most,
      count(*) filter (r>hi) above, min(r) filter (r>hi) above_least, max(r) filter (r>hi) above_most from x group by all having below+above>0"""

ORACLES = {
    "jv_metrics": f"""with {METRICS_SQL} select curve_id, device_id, n_points, round(jsc,6) jsc_ma_cm2, round(voc,6) voc_v, round(vmp,6) vmp_v, round(jmp,6) jmp_ma_cm2,
      round(pmp,6) pmp_mw_cm2, round(ff,6) ff, round(pce,6) pce_percent, {_WARN} warnings from m""",
    "eqe_integration": f"""with {EQE_SQL} select curve_id, n_points, round(jsc,6) jsc, concat_ws(';', case when n_points<15 then 'sparse wavelength grid' end,
      case when mn>350 or mx<900 then 'measured range narrower than reference range' end, case when odd then 'EQE values outside physical range' end,
      case when jsc<5 or jsc>50 then 'integrated current unusually high or low' end) warnings from er""",
    "hysteresis_pairs": f"""with {METRICS_SQL},
      r as (select *, case when device_id='unknown' then 'unknown:' || regexp_replace(lower(source_file), 'forward|fwd|reverse|rev', '', 'g') else device_id end k from m),
      o as (select *, row_number() over (partition by k, scan_direction order by source_file, curve_id) place from r),
      q as (select f.device_id, f.place, f.curve_id forward_curve, v.curve_id reverse_curve, case when greatest(f.pce,v.pce)>0 then (v.pce-f.pce)/greatest(f.pce,v.pce) else 0.0 end hi, abs(v.pce-f.pce) d
        from o f join o v on f.k=v.k and f.place=v.place where f.scan_direction='forward' and v.scan_direction='reverse')
      select device_id, place, forward_curve, reverse_curve, round(hi,6) hysteresis_index, round(d,6) abs_delta_pce,
      case when d>1.5 or (abs(hi)>0.1 and (d>1 or abs(hi)>0.05)) then 'medium' when d>1 or abs(hi)>0.05 then 'low' end risk_level from q""",
    "reconcile_jv_reported": f"""with {METRICS_SQL}, {REPORTED_SQL}, g as (select device, v, j, f, p, count(*) n from rep group by all),
      x as (select curve_id, v, j, f, p, n, concat_ws(',', case when abs(voc-v)>0.02 then 'voc' end, case when abs(jsc-j)>0.5 and abs(jsc-j)/j>0.03 then 'jsc' end,
        case when abs(ff-f)>0.03 then 'ff' end, case when abs(pce-p)>0.5 and abs(pce-p)/p>0.05 then 'pce' end) mismatches from m join g on g.device=lower(m.device_id) where device_id<>'unknown')
      select curve_id, v reported_voc_v, j reported_jsc_ma_cm2, f reported_ff, p reported_pce_percent, n reported_rows, mismatches from x where mismatches<>''""",
    "reconcile_eqe_reported": f"""with {EQE_SQL}, {REPORTED_SQL}, g as (select device, e, count(*) n from rep group by all)
      select curve_id, e reported_jsc, n reported_rows from er join g on g.device=er.device_id where er.device_id<>'unknown' and abs(jsc-e)>1.0 and abs(jsc-e)/e>0.10""",
    "outside_tolerance_jv": f"""with {METRICS_SQL}, {REPORTED_SQL}, k as (select curve_id, lower(device_id) device, unnest(['voc_v', 'jsc_ma_cm2', 'ff', 'pce_percent']) metric,
        unnest([voc-0.02e0, least(jsc-0.5e0, jsc/1.03e0), ff-0.03e0, least(pce-0.5e0, pce/1.05e0)]) lo,
        unnest([voc+0.02e0, greatest(jsc+0.5e0, jsc/0.97e0), ff+0.03e0, greatest(pce+0.5e0, pce/0.95e0)]) hi from m where device_id<>'unknown'),
      g as (select device, unnest(['voc_v', 'jsc_ma_cm2', 'ff', 'pce_percent']) metric, unnest([v, j, f, p]) r from rep),
      x as (select * from k join g using (device, metric)) {_RANGES}""",
    "outside_tolerance_eqe": f"""with {EQE_SQL}, {REPORTED_SQL},
      x as (select curve_id, 'eqe_jsc_ma_cm2' metric, least(jsc-1e0, jsc/1.1e0) lo, greatest(jsc+1e0, jsc/0.9e0) hi, e r from er join rep on rep.device=er.device_id where er.device_id<>'unknown') {_RANGES}""",
    "reconcile_eqe_jv": f"""with {EQE_SQL}, {METRICS_SQL.replace(" p as ", " p as ", 1)}, l as (select device_id, arg_max(curve_id, source_file || chr(1) || curve_id) c, arg_max(jsc, source_file || chr(1) || curve_id) j from m where device_id<>'unknown' group by 1)
      select curve_id, c jv_curve, round(abs(j-jsc)/j, 6) relative_gap from er join l using (device_id) where abs(j-jsc)/j>0.10 and abs(j-jsc)>1.0""",
    "decay_fit_consistency": """with r as (select 'r' || lpad(o_orderkey::varchar, 9, '0') id, o_orderkey k, case when o_orderkey%2=0 then 'trpl' else 'tpv' end dt, o_custkey%200 s, o_custkey%3 v,
       case o_orderkey%4 when 0 then 3 when 1 then 1 else 5 end pr, case when o_orderkey%5>0 then 100+o_orderkey%300 end * case when o_orderkey%7=0 then 1000 else 1 end rep,
       case when o_orderkey%6=0 then null when o_orderkey%6<4 then 'a' else 'i' end f, o_orderkey%3=0 has, 1+o_orderkey%4 a1, 50+o_custkey%100 t1, 2+o_custkey%3 a2, 200+o_orderkey%90 t2
       from orders where o_orderkey%10<>0),
      l as (select dt, s, v, arg_min(id, pr || id) lid from r where has group by all),
      j as (select r.*, case when has then id else lid end pid from r left join l using (dt, s, v) where rep is not null),
      x as (select j.id, j.f, j.rep, j.pid, case j.f when 'a' then (p.a1*p.t1+p.a2*p.t2)::double/(p.a1+p.a2) when 'i' then (p.a1*p.t1*p.t1+p.a2*p.t2*p.t2)::double/(p.a1*p.t1+p.a2*p.t2) end rc
        from j left join r p on p.id=j.pid),
      y as (select *, case when f is null then 'missing_formula' when pid is null then 'missing_parameters' when abs(rep-rc)>0.5 and abs(rep-rc)/rc>0.02 then 'lifetime_mismatch' end kind from x)
      select id record_id, kind, case when kind='lifetime_mismatch' then 'medium' else 'low' end risk_level, pid parameter_record, round(rc, 6) recomputed_ns from y where kind is not null""",
    "read_jv_points": "select count(*) n, count(distinct user_id) curves, sum(event_id%130)::double sum_x, round(sum(value),3) sum_y, 'forward' direction from events",
    "read_eqe_points": "select count(*) n, count(distinct user_id) curves, round(sum(300.0e0 + event_id*37%900),3) sum_x, round(sum(value/100.0e0),4) sum_y from events",
    "read_reference_spectrum": "select count(*) n, sum(300+s_suppkey)::double w, round(sum(s_nationkey/10.0e0),3) irr from supplier",
    "read_reported_metrics": """select c_name device_id, round((600+c_custkey%500)/1000.0e0,6) voc_v, (15+c_custkey%7)::double jsc_ma_cm2, round((60+c_custkey%30)/100.0e0,6) ff from customer""",
    "raw_measurement_manifest": """select 'jv_curve' input_type, false warned, count(distinct user_id) named from events union all select 'unknown', true, 0 where exists (select 1 from nation)""",
    "image_manifest": """select sha256(html || chr(10) || chr(1)) as sha256, count(*) files, '.png' file_ext, count(*) ids from pages group by 1""",
}
