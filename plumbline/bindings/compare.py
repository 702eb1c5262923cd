"""Curve comparison, images, phrases and record checks bound to the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.bindings.common import table
from plumbline.operators import curve_compare as CC
from plumbline.operators import images as I
from plumbline.operators import records as R


def _runs(spark, sf):
    """Orders as stretches of 50 rows: spec number n, place s."""
    o = table(spark, sf, "orders")
    return o.select(
        F.floor(F.col("o_orderkey") / 50).cast("long").alias("n"), (F.col("o_orderkey") % 50).alias("s"), F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("p")
    ).withColumn("spec_id", F.concat(F.lit("c"), F.col("n").cast("string")))


def coverage_inputs(spark, sf):
    r = _runs(spark, sf)
    n = F.col("n")
    dec = lambda e: F.expr(e).cast("decimal(37,18)")
    specs = r.select("spec_id", "n").distinct().select(
        "spec_id",
        (n % 11 != 0).alias("has_mapping"),
        (n % 13 != 0).alias("context_matches"),
        F.when(n % 2 == 1, F.lit("0.01")).otherwise("0").cast("decimal(37,18)").alias("x_tolerance"),
        F.lit(2).alias("minimum_missing"),
        (n % 5 == 0).alias("downsampling_disclosed"),
        (n % 7 == 0).alias("filtering_disclosed"),
        F.when(n % 3 == 0, dec("5")).alias("axis_low"),
        F.when(n % 3 == 0, dec("80")).alias("axis_high"),
        F.when((n % 7 == 0) & (n % 2 == 0), F.array().cast("array<struct<start:decimal(37,18),stop:decimal(37,18)>>"))
        .when(n % 7 == 0, F.array(F.struct(dec("10").alias("start"), dec("20").alias("stop"))))
        .alias("filtered"),
    )
    source = r.select("spec_id", F.col("s").alias("seq"), dec("s * 2").alias("x"), F.when(F.col("c") % 17 > 0, F.col("p")).alias("y"))
    plot = r.where(F.col("c") % 4 != 0).select(
        "spec_id", F.col("s").alias("seq"), dec("s * 2 + case when c % 3 = 0 then 0.004 else 0 end").alias("x"), F.col("p").alias("y")
    )
    return specs, source, plot


def coverage_query(spark, sf):
    return CC.curve_point_coverage(*coverage_inputs(spark, sf))[0]


def intervals_query(spark, sf):
    i = CC.curve_point_coverage(*coverage_inputs(spark, sf))[1]
    return i.select("spec_id", F.col("x_start").cast("double").alias("x_start"), F.col("x_end").cast("double").alias("x_end"), "seq_start", "point_count")


def segment_query(spark, sf):
    """Second curves repeat places 10 to 30 of the first one, scaled and shifted; long ones 100 to 1300."""
    r = _runs(spark, sf)
    orders = table(spark, sf, "orders")
    long = orders.select(
        F.concat(F.lit("long"), F.floor(F.col("o_orderkey") / 1500).cast("string")).alias("spec_id"),
        (F.col("o_orderkey") % 1500).alias("s"), F.col("o_totalprice").alias("p"),
    )
    r = r.select("spec_id", "s", "p", F.col("s").between(10, 30).alias("copied")).unionByName(
        long.withColumn("copied", F.col("s").between(100, 1300))
    )
    specs = r.select("spec_id").distinct().withColumn("human_confirmed_independent", F.lit(True))
    first = r.select("spec_id", F.concat("spec_id", F.lit("-a")).alias("curve_id"), F.col("s").alias("seq"), F.col("s").cast("double").alias("x"), F.col("p").alias("y"))
    copied = F.col("copied")
    second = r.select(
        "spec_id", F.concat("spec_id", F.lit("-b")).alias("curve_id"), F.col("s").alias("seq"), (F.col("s") * 3.0 + 1).alias("x"),
        F.when(copied, F.col("p") * 0.5 + 7).otherwise(F.lit(900000.0) - F.col("p")).alias("y"),
    )
    return CC.curve_segment_similarity(specs, first, second).select("spec_id", "status", "first_start", "second_start", "window_length", F.round("scale", 6).alias("scale"))


def pixel_arrays(spark, sf):
    e = table(spark, sf, "embeddings")
    eight = F.transform("embedding", lambda v: F.floor(v.cast("double") * 1000).cast("int"))
    return e.select(F.col("vec_id").cast("string").alias("image_id"), eight.alias("pixels_8x8"), F.concat(eight, F.slice(eight, 1, 8)).alias("pixels_9x8"))


def hashes_query(spark, sf):
    h = I.image_hashes(pixel_arrays(spark, sf))
    return h.select("image_id", I.hash_hex(F.col("dhash")).alias("dhash"), I.hash_hex(F.col("ahash")).alias("ahash"))


def _close_hashes(spark, sf):
    """Average hashes and, per image, two altered copies of them."""
    h = I.image_hashes(pixel_arrays(spark, sf))
    k = "cast(cast(image_id as bigint)"
    flips = F.expr(f"array(0L, shiftleft(1L, {k} % 60 as int)), shiftleft(21L, {k} % 50 as int)))")
    return h.select("image_id", "ahash", F.posexplode(flips).alias("v", "flip")).select(
        F.concat_ws("-", "image_id", F.col("v").cast("string")).alias("image_id"), F.concat_ws("-", "image_id", F.col("v").cast("string")).alias("sha256"), F.col("ahash").bitwiseXOR(F.col("flip")).alias("hash")
    )


def pairs_query(spark, sf):
    p = I.hash_similarity_pairs(_close_hashes(spark, sf), 6)
    return p.select(
        F.least(I.hash_hex(F.col("hash")), I.hash_hex(F.col("other"))).alias("hash_a"), F.greatest(I.hash_hex(F.col("hash")), I.hash_hex(F.col("other"))).alias("hash_b"), "distance"
    )


def duplicates_query(spark, sf):
    d = table(spark, sf, "documents").select(F.format_string("%012d", "doc_id").alias("image_id"), F.sha2("text", 256).alias("sha256"))
    return I.exact_duplicates(d)


def relabeled_query(spark, sf):
    d = table(spark, sf, "documents").select(F.sha2("text", 256).alias("content_hash"), F.col("source").alias("label"))
    quiet = table(spark, sf, "documents").where("doc_id % 10 = 0").select(F.sha2("text", 256).alias("content_hash"), F.col("source").alias("label")).distinct()
    return I.relabeled_source_data(d, quiet)


def phrases_query(spark, sf):
    """The first one to seven words of every benchmark text, by its number, looked up in all documents and benchmark texts."""
    b = table(spark, sf, "benchmark")
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    lexicon = b.select(F.concat_ws(" ", F.slice(words, F.lit(1), (F.col("item_id") % 7 + 1).cast("int"))).alias("phrase"), F.lit("usual term").alias("expected")).distinct()
    texts = table(spark, sf, "documents").select("doc_id", "text").unionByName(b.select((-F.col("item_id") - 1).alias("doc_id"), "text"))
    found = I.tortured_phrases(texts, lexicon)
    return found.groupBy("doc_id", "gram").agg(F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("sentences"))


def lineage_query(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    r = p.select(
        k.cast("string").alias("sample_id"),
        F.when(k % 5 == 0, F.array(F.lit("dls"), F.lit("filtration"))).when(k % 5 == 1, F.array(F.lit("Vortex"), F.lit("vortex"))).otherwise(F.array(F.lit("preparation"), F.lit("Filtration"), F.lit("dls"))).alias("stages"),
        F.when(k % 7 == 0, "unknown").when(k % 7 == 1, "Before filtration").otherwise("post-filtration").alias("measurement_stage"),
        F.when(k % 9 > 0, "Intensity").alias("distribution_basis"),
        (100.0 + F.col("p_size")).alias("nominal_pore_nm"),
        (50.0 + k % 900).alias("hydrodynamic_diameter_nm"),
        (k % 4 != 3).alias("human_confirmed"),
    )
    return R.process_lineage(r).select("sample_id", "kind", F.concat_ws(",", "missing").alias("missing"))


def workbook_cells(spark, sf):
    """One sheet per part size: a price, formulas on it, a sometimes typed-in result."""
    p = table(spark, sf, "part").select(F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("sheet"), (F.col("p_partkey") + 10).alias("row"), F.col("p_retailprice").alias("x"), "p_partkey")
    k, row = F.col("p_partkey"), F.col("row").cast("string")
    none = F.lit(None).cast("string")
    text = lambda c: c.cast("string")
    cells = F.array(
        F.struct(F.lit(1).alias("col"), none.alias("formula"), text(F.col("x")).alias("value")),
        F.struct(F.lit(2).alias("col"), F.concat(F.lit("=A"), row, F.lit("*2+(1-1)")).alias("formula"), text(F.when(k % 10 == 0, F.col("x") * 3).otherwise(F.col("x") * 2)).alias("value")),
        F.struct(F.lit(3).alias("col"), F.when(k % 3 == 0, F.concat(F.lit("=SUM(A1:A"), row, F.lit(")"))).when(k % 3 == 1, F.lit("=now()")).otherwise(F.lit("=[b.xlsx]S!A1")).alias("formula"), F.lit("1").alias("value")),
        F.struct(F.lit(28).alias("col"), none.alias("formula"), F.when(k % 7 == 0, "12.5").otherwise("text").alias("value")),
    )
    body = p.select("sheet", "row", "p_partkey", F.explode(cells).alias("c")).select(
        "sheet", "row", F.col("c.col").alias("col"), F.col("c.formula").alias("formula"), F.col("c.value").alias("value"), (F.col("p_partkey") % 100 == 0).alias("row_hidden")
    )
    heads = p.select("sheet").distinct().select("sheet", F.lit(1).cast("long").alias("row"), F.lit(28).alias("col"), none.alias("formula"), F.lit("Calculated PCE").alias("value"), F.lit(False).alias("row_hidden"))
    both = body.unionByName(heads)
    return both.select(F.lit("w").alias("workbook"), "*", (F.col("sheet") == "s7").alias("sheet_hidden"), ((F.col("col") == 3) & (F.col("sheet") == "s9")).alias("col_hidden"))


def audit_query(spark, sf):
    return R.workbook_cell_audit(workbook_cells(spark, sf)).groupBy("sheet", "audit_type", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.sum("row").alias("rows"), F.sum("col").alias("cols")
    )


def recompute_query(spark, sf):
    return R.formula_recompute(workbook_cells(spark, sf)).select("sheet", "row", "formula", F.round("cached", 6).alias("cached"), F.round("recomputed", 6).alias("recomputed"))


def case_cards(spark, sf):
    """One card per labelled document."""
    d = table(spark, sf, "labels")
    k = F.col("doc_id")
    strings = lambda *v: F.array(*[F.lit(x) for x in v])
    counter = F.struct(F.when(k % 4 == 0, "ftp://x").when(k % 7 == 3, "https://example.org/?access_token=abc").otherwise("https://example.org").alias("url"), F.when(k % 3 == 0, "correction").otherwise("other").alias("source_type"), F.lit("2024-05-06").alias("observed_at"))
    event = F.struct(F.lit("update").alias("source_type"), F.when(k % 8 == 0, "yesterday").otherwise("2024-01-01T10:00:00Z").alias("observed_at"), F.lit(None).cast("string").alias("source_url"))
    return d.select(
        F.concat(F.lit("case"), k.cast("string")).alias("case_id"),
        F.when(k % 5 == 0, "draft").alias("validation_mode"),
        F.lit("high").alias("priority"),
        F.when(k % 6 == 0, "public_method").otherwise("news").alias("source_type"),
        F.when(k % 7 > 0, "https://example.org/a").alias("source_url"),
        F.lit("chemistry").alias("field"),
        F.when(k % 9 == 0, "rumour").when(k % 9 == 1, "confirmed_misconduct").otherwise("unresolved").alias("public_status"),
        F.lit(None).cast("string").alias("official_or_institutional_source"),
        F.when(k % 2 == 0, strings("grid", "reuse")).otherwise(strings("grid")).alias("evidence_patterns"),
        F.when(F.col("quality") == 1, strings("cand_a", "cand_b")).otherwise(strings("cand_c")).alias("detector_candidates"),
        strings("raw data").alias("manual_verification_needed"),
        strings("rounding").alias("false_positive_risks"),
        # two leaks in one card: neither hides the other
        F.when(k % 11 == 0, "proven fraud").when(k % 11 == 1, "from /home/u/one.txt").otherwise("to be checked").alias("safe_report_language"),
        F.when(k % 11 == 1, "and /home/u/two.txt").alias("note"),
        F.when(k % 13 == 0, "unsupported_motive").otherwise("research_integrity").alias("scope"),
        F.when(k % 10 == 0, "doi").otherwise("10.1234/x").alias("target_doi"),
        F.lit("2024-02-03").alias("source_accessed_at"),
        F.lit("E2").alias("evidence_tier"),
        F.when(k % 12 == 0, "formally_corrected").otherwise("open").alias("resolution_status"),
        F.when(k % 24 != 0, F.array(counter)).alias("counter_sources"),
        F.array(event).alias("version_timeline"),
        F.when(F.col("toxic") == 1, "methodology_note").otherwise("case").alias("case_kind"),
    )


def cards_query(spark, sf):
    return R.case_card_issues(case_cards(spark, sf))


def rollup_query(spark, sf):
    library = case_cards(spark, sf).select(F.explode(F.array(F.lit("cand_a"), F.lit("cand_c"), F.lit("cand_z"))).alias("candidate_id")).distinct()
    return R.rule_candidate_rollup(case_cards(spark, sf), library)


QUERIES = {
    "curve_point_coverage": coverage_query,
    "curve_missing_intervals": intervals_query,
    "curve_segment_similarity": segment_query,
    "image_hashes": hashes_query,
    "hash_similarity_pairs": pairs_query,
    "exact_duplicates": duplicates_query,
    "relabeled_source_data": relabeled_query,
    "tortured_phrases": phrases_query,
    "process_lineage": lineage_query,
    "workbook_cell_audit": audit_query,
    "formula_recompute": recompute_query,
    "case_card_issues": cards_query,
    "rule_candidate_rollup": rollup_query,
}

COVERAGE_SQL = """
 r as (select o_orderkey//50 n, o_orderkey%50 s, o_custkey c, o_totalprice p from orders),
 sp as (select distinct n, n%2=1 tolerant, case when n%11=0 then 'missing_source_mapping' when n%13=0 then 'sample_or_version_context_mismatch'
    when n%7=0 and n%2=0 then 'filtering_disclosed_without_intervals' end early from r),
 src as (select r.n, s, s*2::double x, tolerant from r join sp using (n) where early is null and c%17>0),
 plt as (select r.n, s, s*2 + case when c%3=0 then 0.004 else 0 end x, tolerant from r join sp using (n) where early is null and c%4<>0),
 rng as (select n, min(x) lo, max(x) hi from plt group by 1),
 stray as (select distinct n from plt where not exists (select 1 from src where src.n=plt.n and abs(src.x-plt.x)<=case when plt.tolerant then 0.01 else 0 end)),
 act as (select sp.n, lo, hi from sp join rng using (n) where early is null and exists (select 1 from src where src.n=sp.n) and (n%5<>0 or n in (select n from stray))),
 mis as (select src.n, s, src.x from src join act using (n) where src.x>lo and src.x<hi and (src.n%3<>0 or src.x between 5 and 80) and not (src.n%7=0 and src.x between 10 and 20)
   and not exists (select 1 from plt where plt.n=src.n and abs(src.x-plt.x)<=case when src.tolerant then 0.01 else 0 end)),
 isl as (select *, s - row_number() over (partition by n order by s) g from mis),
 iv as (select n, min(x) x_start, max(x) x_end, min(s) seq_start, count(*) point_count from isl group by n, g having count(*)>=2)
"""
_PIX = "list_transform(embedding, lambda v: floor(v::double*1000)::int)"
# a 64-bit number as 16 hex digits
def _hex(flags: str) -> str:
    return f"lower(lpad(to_hex(list_sum(list_transform(range(1, 65), lambda i: case when {flags} then (1::ubigint << (64-i)::ubigint)::hugeint else 0::hugeint end))::ubigint), 16, '0'))"


_AHASH = _hex("px[i] >= list_avg(px)")
_DHASH = _hex("qx[((i-1)//8)*9 + (i-1)%8 + 1] > qx[((i-1)//8)*9 + (i-1)%8 + 2]")
_ABITS = "list_sum(list_transform(range(1, 65), lambda i: case when px[i] >= list_avg(px) then (1::ubigint << (64-i)::ubigint)::hugeint else 0::hugeint end))::ubigint"
HASH_SQL = f" e as (select vec_id, {_PIX} px from embeddings), q as (select vec_id, px, list_concat(px, px[1:8]) qx from e)"

WORKBOOK_SQL = """
 p as (select 's' || p_size sheet, p_partkey+10 as row, p_partkey k, p_retailprice x from part)
"""
ORACLES = {
    "curve_point_coverage": f"""with {COVERAGE_SQL}
      select 'c' || n spec_id, early as kind, 0::bigint intervals, 0::bigint points from sp where early is not null
      union all select 'c' || n, 'insufficient_finite_curve_points', 0, 0 from sp where early is null and (n not in (select n from src) or n not in (select n from plt))
      union all select 'c' || n, 'unexplained_contiguous_missing_interval', count(*), sum(point_count)::bigint from iv group by n""",
    "curve_missing_intervals": f"with {COVERAGE_SQL} select 'c' || n spec_id, x_start::double x_start, x_end::double x_end, seq_start, point_count from iv",
    "curve_segment_similarity": """select 'c' || (o_orderkey//50) spec_id, 'match' as status, 10::bigint first_start, 10::bigint second_start, 21::bigint window_length, 0.5::double as scale
      from orders group by o_orderkey//50 having count(*)>=31
      union all select 'long' || (o_orderkey//1500), 'match', 100, 100, 1201, 0.5 from orders group by o_orderkey//1500 having count(*)>=1301""",
    "image_hashes": f"with {HASH_SQL} select vec_id::varchar image_id, {_DHASH} dhash, {_AHASH} ahash from q",
    "hash_similarity_pairs": f"""with {HASH_SQL}, h as (select vec_id, {_ABITS} a from q),
      f as (select xor(a, unnest([0::ubigint, 1::ubigint << (vec_id%60)::ubigint, 21::ubigint << (vec_id%50)::ubigint])) b from h),
      d as (select b, count(*) n from f group by 1)
      select least(lower(lpad(to_hex(x.b),16,'0')), lower(lpad(to_hex(y.b),16,'0'))) hash_a, greatest(lower(lpad(to_hex(x.b),16,'0')), lower(lpad(to_hex(y.b),16,'0'))) hash_b,
        bit_count(xor(x.b, y.b))::int distance from d x join d y on x.b<y.b and bit_count(xor(x.b, y.b))<=6
      union all select lower(lpad(to_hex(b),16,'0')), lower(lpad(to_hex(b),16,'0')), 0 from d where n>1""",
    "exact_duplicates": """with d as (select printf('%012d', doc_id) image_id, sha256(text) sha256 from documents),
      g as (select sha256, count(*) group_size, min(image_id) first_id from d group by 1 having count(*)>1) select d.image_id, sha256, group_size, first_id from d join g using (sha256)""",
    "relabeled_source_data": """with d as (select sha256(text) content_hash, source as label, count(*) n from documents group by all),
      q as (select distinct sha256(text) content_hash, source as label from documents where doc_id%10=0)
      select content_hash, count(*) labels, sum(n)::bigint files, min(label) first_label, max(label) last_label from d anti join q using (content_hash, label) group by 1 having count(*)>1""",
    "tortured_phrases": """with bw as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x<>'') w from benchmark),
      lx as (select distinct array_to_string(w[1:(item_id%7+1)::int], ' ') ph, least(len(w), item_id%7+1) n from bw),
      t as (select doc_id, text from documents union all select -item_id-1, text from benchmark),
      s as (select doc_id, unnest(regexp_split_to_array(text, '[.!?]\\s+|\\n+')) st, generate_subscripts(regexp_split_to_array(text, '[.!?]\\s+|\\n+'), 1) sn from t),
      w as (select doc_id, sn, list_filter(regexp_split_to_array(lower(st), '[^\\p{L}\\p{N}]+'), lambda x: x<>'') w from s),
      z as (select distinct n from lx),
      g as (select doc_id, sn, unnest(list_transform(range(1, (len(w)-n+2)::bigint), lambda i: array_to_string(w[i:i+n-1], ' '))) gram from w, z where len(w)>=n)
      select doc_id, gram, count(*) uses, count(distinct sn) sentences from g join (select distinct ph from lx) lx on lx.ph=g.gram group by all""",
    "process_lineage": """with r as (select p_partkey k, p_size z from part where p_partkey%4<>3),
      x as (select k, concat_ws(',', case when k%7=0 then 'measurement_stage' end, case when k%9=0 then 'distribution_basis' end) mi, k%5 in (0,1) bad, (50.0+k%900)/(100.0+z) ratio from r)
      select k::varchar sample_id, case when bad then 'invalid_stages' when mi<>'' then 'missing_context' else 'large_diameter_to_pore_ratio' end kind, mi as missing
      from x where bad or mi<>'' or (k%7<>1 and ratio>=3)""",
    "workbook_cell_audit": f"""with {WORKBOOK_SQL},
      a as (select sheet, 'hidden_sheet' t, 'low' sev, null::bigint as r, null::bigint c from p where sheet='s7' group by sheet
       union all select sheet, 'hidden_row', 'low', row, null from p where k%100=0
       union all select sheet, 'hidden_column', 'low', null, 3 from p where sheet='s9' group by sheet
       union all select sheet, 'volatile_function', 'low', row, 3 from p where k%3=1
       union all select sheet, 'external_reference', 'low', row, 3 from p where k%3=2
       union all select sheet, 'hardcoded_in_row', 'medium', row, 1 from p where k%7<>0
       union all select sheet, 'formula_overwrite_pattern', 'medium', row, 28 from p where k%7=0)
      select sheet, t audit_type, sev severity, count(*) n, sum(r)::bigint as "rows", sum(c)::bigint as cols from a group by all""",
    "formula_recompute": f"with {WORKBOOK_SQL} select sheet, row, '=A' || row || '*2+(1-1)' as formula, round(x*3, 6) cached, round(x*2, 6) recomputed from p where k%10=0",
    "case_card_issues": """with l as (select doc_id k from labels),
      m as (select k, unnest([case when k%5<>0 and k%7=0 then 'missing required field: source_url' end, case when k%9=0 then 'public_status is unknown' end,
        case when k%9=1 then 'confirmed status requires an official source' end, case when k%6=0 and k%9 in (0,1) then 'public method has an unsuitable public_status' end,
        case when k%13=0 then 'unsupported motive cannot become a finding' end, case when k%10=0 then 'target_doi is not a DOI' end,
        case when k%4=0 and k%24<>0 then 'counter source needs a public URL' end, case when k%8=0 then 'timeline date must be ISO-8601' end,
        case when k%24=0 then 'closed status requires a counter source' end, case when k%12=0 and k%24<>0 and k%3<>0 then 'closed status requires a publisher counter source' end,
        case when k%11=0 then 'forbidden phrase found: proven fraud' end, case when k%11=1 then 'private/local path fragment found: /home/u/one.txt' end,
        case when k%11=1 then 'private/local path fragment found: /home/u/two.txt' end,
        case when k%4<>0 and k%7=3 then 'sensitive authentication material found in public record' end]) message from l)
      select 'case' || k case_id, message from m where message is not null""",
    "rule_candidate_rollup": """with a as (select count(*) filter (quality=1) q1, count(*) filter (quality<>1) q0, min('case' || doc_id) filter (quality=1) f1, min('case' || doc_id) filter (quality<>1) f0,
       count(*) filter (toxic=1) t1, min('case' || doc_id) filter (toxic=1) ft, count(distinct doc_id%2) filter (quality=1) p1, count(distinct doc_id%2) filter (quality<>1) p0,
       bool_or(doc_id%2=0) filter (quality=1) e1, bool_or(doc_id%2=0) filter (quality<>1) e0 from labels)
      select 'cand_a' candidate_id, q1 cases, f1 first_case, 'direct' relationship, (case when e1 then 2 else 1 end)::bigint patterns from a
      union all select 'cand_c', q0, f0, 'direct', case when e0 then 2 else 1 end from a union all select 'cand_z', t1, ft, 'methodology', 0 from a""",
}
