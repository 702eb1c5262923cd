"""Bibliography operators and readers bound to orders, parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.bindings.common import map_text, table
from plumbline.bindings.files import rename_suffix
from plumbline.functions import bibliography as B
from plumbline.operators import bibliography as O
from plumbline.operators import profile as P
from plumbline.session import scratch_path
from plumbline.sources import references as R
from plumbline.sources.tables import read_delimited_cells, read_markdown_cells

# One reference per order; DOIs repeat, are missing, malformed or prefixed by key arithmetic.
_TEXT = """case o_orderkey % 7 when 0 then concat('Smith ', o_orderkey % 90, '. A study of things, ', 1850 + o_orderkey % 200, '. https://doi.org/10.1000/P', o_orderkey % 400, '.')
   when 1 then concat('Doe ', o_orderkey % 300, ', short') when 2 then concat('Lee et al. Journal of Tests 10.12/bad', o_orderkey % 5, ' (1999)')
   when 3 then concat('Two works 10.1000/p', o_orderkey % 400, '; 10.1000/p', o_orderkey % 30, ' from 2001') else concat('Plain entry number ', o_orderkey % 2000, ' from 1995 here') end"""
_DOI = """case o_orderkey % 7 when 4 then concat('10.1000/p', o_orderkey % 400) when 5 then concat('https://doi.org/10.1000/p', o_orderkey % 9) else '' end"""

# One publication per supplier; notices by key arithmetic.
def supplier_works(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")

    def notice(kind, doi, month):
        return F.struct(
            kind.alias("type"),
            doi.alias("DOI"),
            F.lit("notice").alias("label"),
            F.struct(F.array(F.array((2000 + k % 20).cast("int"), month.cast("int"))).alias("date-parts")).alias("updated"),
        )

    kinds = (
        F.when(k % 6 == 0, "Retraction").when(k % 6 == 1, "withdrawal").when(k % 6 == 2, "expression_of_concern").when(k % 6 == 3, "Correction").otherwise("")
    )
    by = F.array(
        notice(kinds, F.concat(F.lit("10.2000/N"), k.cast("string")), k % 12 + 1),
        notice(F.lit("new_version"), F.concat(F.lit("10.2000/n"), k.cast("string")), k % 12 + 1),
    )
    to = F.when(k % 5 == 0, F.array(notice(F.lit("reinstatement"), F.concat(F.lit("10.2000/r"), k.cast("string")), F.lit(2))))
    return s.select(
        F.concat(F.lit("10.1000/P"), k.cast("string")).alias("DOI"),
        F.array("s_name").alias("title"),
        F.concat(F.lit("press "), F.col("s_nationkey").cast("string")).alias("publisher"),
        F.struct(F.array(F.array((1990 + k % 30).cast("int"))).alias("date-parts")).alias("issued"),
        F.when(k % 4 != 3, by).alias("updated-by"),
        to.alias("update-to"),
    )


WORKS_SQL = """
 notices as (
  select s_suppkey k, 1 pos, case s_suppkey%6 when 0 then 'retraction' when 1 then 'withdrawal' when 2 then 'expression_of_concern' when 3 then 'correction' else '' end raw_type,
    '10.2000/n' || s_suppkey related_doi, (2000 + s_suppkey%20) || '-' || lpad((s_suppkey%12+1)::varchar, 2, '0') updated_date, 'updated-by' relation from supplier where s_suppkey%4<>3
  union all select s_suppkey, 2, 'new_version', '10.2000/n' || s_suppkey, (2000 + s_suppkey%20) || '-' || lpad((s_suppkey%12+1)::varchar, 2, '0'), 'updated-by' from supplier where s_suppkey%4<>3
  union all select s_suppkey, 3, 'reinstatement', '10.2000/r' || s_suppkey, (2000 + s_suppkey%20) || '-02', 'update-to' from supplier where s_suppkey%5=0),
 upd as (select * from (select *, row_number() over (partition by k, related_doi order by pos) rn from notices where raw_type<>'') where rn=1),
 typed as (select *, case when contains(raw_type,'retraction') then 'retraction' when contains(raw_type,'withdrawal') then 'withdrawal' when contains(raw_type,'concern') then 'expression_of_concern'
    when contains(raw_type,'reinstatement') then 'reinstatement' when contains(raw_type,'correction') then 'correction'
    when contains(raw_type,'update') or contains(raw_type,'notice') then 'update_notice' else 'correction' end t from upd),
 works as (select '10.1000/p' || s_suppkey doi, s_name title, s_suppkey k, 'press ' || s_nationkey publisher, (1990 + s_suppkey%30)::varchar y from supplier),
 ws as (select w.*, coalesce((select case min(case t when 'reinstatement' then 1 when 'retraction' then 2 when 'withdrawal' then 3 when 'expression_of_concern' then 4
    when 'correction' then 5 else 6 end) when 1 then 'reinstatement' when 2 then 'retraction' when 3 then 'withdrawal' when 4 then 'expression_of_concern'
    when 5 then 'correction' when 6 then 'update_notice' end from typed where typed.k=w.k), 'no_known_update') status from works w)
"""


def order_references(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        F.concat(F.lit("list"), (F.col("o_custkey") % 40).cast("string")).alias("list_id"),
        F.col("o_orderkey").alias("index"),
        F.expr(_TEXT).alias("text"),
        F.expr(_DOI).alias("doi"),
    )


REFS_SQL = f" r as (select 'list' || (o_custkey%40) list_id, o_orderkey as idx, {_TEXT} as text, {_DOI} as doi from orders)"


def doi_functions_query(spark, sf):
    r = order_references(spark, sf)
    return r.select(
        "index",
        B.normalize_doi(F.col("doi")).alias("normalized"),
        B.is_valid_doi(F.col("doi")).alias("valid"),
        F.concat_ws(" ", B.extract_doi_candidates(F.col("text"))).alias("candidates"),
    )


def markers_query(spark, sf):
    d = table(spark, sf, "documents").withColumn(
        "body", F.concat("text", F.lit(" see Fig. "), F.col("doc_id") % 7, F.lit("b and figure 2, 图 3, "), F.lit("Fig. 2b; 10.1234/ab."), "source", F.lit("。 "), "lang")
    )
    return d.select(
        "doc_id",
        F.concat_ws("|", B.extract_figure_markers(F.col("body"))).alias("markers"),
        F.concat_ws("|", B.extract_mention_dois(F.col("body"))).alias("dois"),
    )


def updates_query(spark, sf):
    """Works written as JSON documents, read back and reduced to their notices."""
    path = scratch_path(spark, "works")
    supplier_works(spark, sf).select(F.struct("*").alias("message")).write.json(path)
    return R.read_publication_updates(R.read_works(spark, path), fold_withdrawal=False).select(
        "doi", "relation", "raw_type", "related_doi", "updated_date", "update_type"
    )


def status_query(spark, sf):
    refs = order_references(spark, sf).where(F.col("doi") != "").select("doi", F.col("index").alias("seq"))
    return O.publication_status(refs, supplier_works(spark, sf))


def status_summary_query(spark, sf):
    from plumbline.operators.ledger import status_summary

    refs = order_references(spark, sf).where(F.col("doi") != "").select("doi", F.col("index").alias("seq"))
    return status_summary(O.publication_status(refs, supplier_works(spark, sf)))


def scan_query(spark, sf):
    found = O.reference_issues(order_references(spark, sf), supplier_works(spark, sf))
    return found.select("list_id", "index", "rule_id", "risk_level", "detail")


def read_references_query(spark, sf):
    """References written as text and JSON lines and read back."""
    refs = order_references(spark, sf)
    path = scratch_path(spark, "refs")
    refs.where(F.col("doi") == "").select("text").write.text(f"{path}/plain")
    refs.where(F.col("doi") != "").select(F.to_json(F.struct(F.col("text").alias("citation"), F.col("doi").alias("DOI"))).alias("value")).write.text(
        f"{path}/json_raw"
    )
    plain = R.read_references(spark, f"{path}/plain")
    # JSON files carry the suffix that tells the two forms apart
    lines = spark.read.text(f"{path}/json_raw")
    lines.select(F.from_json("value", "citation string, DOI string").alias("j")).select("j.*").write.json(f"{path}/json")
    parsed = R.read_references(spark, f"{path}/json")
    both = plain.unionByName(parsed)
    per_list = both.groupBy("list_id").agg(F.max("index").alias("top"), F.count(F.lit(1)).alias("n"), F.countDistinct("index").alias("d"))
    dense = per_list.agg(F.bool_and((F.col("top") == F.col("n")) & (F.col("d") == F.col("n"))).alias("numbered"))
    check = dense.select(F.lit("lines numbered without gaps").alias("text"), F.col("numbered").cast("string").alias("doi"), F.lit(1).cast("long").alias("n"))
    return both.groupBy("text", "doi").agg(F.count(F.lit(1)).alias("n")).unionByName(check)


_PART_DOI = "case p_partkey % 6 when 0 then 'no doi' when 1 then concat('doi:10.1000/P', p_partkey % 300, '.') else concat('10.1000/p', p_partkey % 300) end"


def part_items(spark, sf):
    p = table(spark, sf, "part")
    return R._literature(
        p,
        "txt",
        item_id=F.col("p_partkey").cast("string"),
        source_file=F.concat(F.lit("batch"), (F.col("p_size") % 8).cast("string")),
        seq=F.col("p_partkey"),
        doi=F.expr(_PART_DOI),
        title=F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")),
        year=F.when(F.col("p_partkey") % 3 == 0, "1980"),
    )


ITEMS_SQL = f""" it as (select 'batch' || (p_size%8) source_file, p_partkey seq, p_partkey::varchar item_id,
   case p_partkey%6 when 0 then null else '10.1000/p' || (p_partkey%300) end nd, case when p_partkey%4=0 then p_name end title,
   case when p_partkey%3=0 then '1980' end yr from part)"""
ENRICHED_SQL = f""" {WORKS_SQL}, {ITEMS_SQL},
 fold as (select doi, w.title, publisher, y, coalesce((select case min(case when contains(raw_type,'reinstatement') then 1 when contains(raw_type,'retraction') or contains(raw_type,'withdrawal') then 2
   when contains(raw_type,'concern') then 4 else 5 end) when 1 then 'reinstatement' when 2 then 'retraction' when 4 then 'expression_of_concern' when 5 then 'correction' end
   from upd where upd.k=w.k), 'no_known_update') status from works w),
 fst as (select * from (select *, row_number() over (partition by source_file, nd order by seq) rn from it where nd is not null) where rn=1),
 fe as (select f.source_file, f.nd, f.seq fseq, coalesce(f.title, w.title) ft, coalesce(f.yr, w.y) fy, w.publisher fj, w.status from fst f left join fold w on w.doi=f.nd),
 en as (select it.item_id, it.source_file, it.nd normalized_doi, coalesce(ft, it.title) title, coalesce(fy, it.yr) as year, fj journal,
   case when it.nd is null then 'failed' when fe.status is null then 'offline' else 'success' end metadata_status, coalesce(fe.status, 'metadata_unavailable') update_status,
   coalesce(it.seq>fseq, false) is_duplicate from it left join fe on fe.source_file=it.source_file and fe.nd=it.nd)
"""


def enrich_query(spark, sf):
    e = O.literature_dedupe_enrich(part_items(spark, sf), supplier_works(spark, sf))
    return e.select(
        "item_id", "source_file", "normalized_doi", "title", "year", "journal", "metadata_status", "update_status", "is_duplicate"
    )


def batch_stats_query(spark, sf):
    return O.literature_batch_stats(O.literature_dedupe_enrich(part_items(spark, sf), supplier_works(spark, sf)))


def doi_list_query(spark, sf):
    """DOI lists written as text and CSV files and read back."""
    p = table(spark, sf, "part").withColumn("doi", F.expr(_PART_DOI))
    path = scratch_path(spark, "dois")
    p.where("p_partkey % 2 = 0").select("doi").write.text(f"{path}/a")
    p.where("p_partkey % 2 = 1").select(
        F.col("p_name").alias("Title"), F.col("doi").alias("DOI"), F.lit("2001").alias("Year"), F.concat(F.lit('J, "'), "p_brand", F.lit('"')).alias("journal")
    ).write.option("header", "true").option("escape", '"').csv(f"{path}/b")
    items = R.read_literature_doi_list(spark, path)
    return items.groupBy("source_format", "normalized_doi", "title", "year", "journal").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("warnings") > 0).alias("warned")
    )


def _one_file_per_nation(spark, sf, entry, joined, fmt, label):
    """Supplier entries joined into one file per nation."""
    path = scratch_path(spark, label)
    s = table(spark, sf, "supplier")
    texts = s.groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", entry.alias("t")))).alias("e"))
    texts.select(joined(F.transform("e", lambda x: x["t"])).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    if fmt:
        # Spark names text files .txt; the readers of this format go by suffix
        rename_suffix(spark, path, ".txt", fmt)
    return path


def csl_query(spark, sf):
    k = F.col("s_suppkey")
    entry = F.to_json(
        F.struct(
            F.concat(F.lit("id"), k.cast("string")).alias("id"),
            F.when(k % 5 > 0, F.concat(F.lit("10.1000/P"), k.cast("string"))).alias("DOI"),
            F.array("s_name").alias("title"),
            F.struct(F.array(F.array((1990 + k % 30).cast("int"), F.lit(2))).alias("date-parts")).alias("issued"),
            F.lit("Journal of Suppliers").alias("container-title"),
        )
    )
    path = _one_file_per_nation(spark, sf, entry, lambda t: F.concat(F.lit("["), F.concat_ws(",", t), F.lit("]")), None, "csl")
    return R.read_literature_csl(spark, path).select("item_id", "normalized_doi", "title", "year", "journal", F.size("warnings").cast("long").alias("warned"))


def ris_query(spark, sf):
    k = F.col("s_suppkey")
    entry = F.concat(
        F.lit("TY  - JOUR\nT1  - "), "s_name", F.lit("\nAU  - First, A\nAU  - Second, B\nPY  - "), (1990 + k % 30).cast("string"), F.lit("/03/\nJF  - Journal\nKW  - one\nKW  - two\nDO  - 10.1000/P"),
        k.cast("string"), F.when(k % 3 > 0, F.lit("\nER  - \n")).otherwise("\n"),
    )
    path = _one_file_per_nation(spark, sf, entry, lambda t: F.concat_ws("\n", t), None, "ris")
    out = R.read_literature_ris(spark, path)
    return out.select(
        "item_id", "normalized_doi", "title", "year", "journal", F.concat_ws("; ", "authors").alias("authors"), "reference_type", map_text(F.col("raw_tags")).alias("tags")
    )


def bibtex_query(spark, sf):
    k = F.col("s_suppkey")
    entry = F.concat(
        F.lit("@article{key"), k.cast("string"), F.lit(",\n  title = {{"), "s_name", F.lit("}},\n  note = {mail a@b.org},\n  year = "), (1990 + k % 30).cast("string"),
        F.lit(",\n  booktitle = \"Proc.  of\n Things\",\n  doi = {10.1000/P"), k.cast("string"), F.lit("}\n}\n"),
    )
    path = _one_file_per_nation(spark, sf, entry, lambda t: F.concat_ws("\n", t), ".bib", "bib")
    return R.read_literature_bibtex(spark, path).select("item_id", "normalized_doi", "title", "year", "journal")


def delimited_query(spark, sf):
    """Parts written as CSV and TSV files, read back as cells and profiled."""
    path = scratch_path(spark, "tables")
    p = table(spark, sf, "part").withColumn("quoted", F.concat(F.lit('a "b", '), "p_brand"))
    p.select("p_partkey", "p_size", "p_retailprice", "quoted").write.option("header", "true").option("escape", '"').csv(f"{path}/a")
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    o.write.option("header", "true").option("sep", "\t").csv(f"{path}/b")
    rename_suffix(spark, f"{path}/b", ".csv", ".tsv")
    cells, _ = read_delimited_cells(spark, path)
    return cells.groupBy("column_name", "col_index").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("distinct_values"), F.max("value").alias("top"),
        F.round(F.sum(F.col("value").try_cast("double")), 2).alias("total"),
    )


def spanning_query(spark, sf):
    """Documents written as CSV files whose quoted cells hold quotes, separators, blank lines and line breaks, read back as cells."""
    path = scratch_path(spark, "spanning")
    note = F.concat(F.lit('note "'), F.col("doc_id").cast("string"), F.lit('",\n\n'), F.coalesce("text", F.lit("")))
    d = table(spark, sf, "documents").select("doc_id", note.alias("body"), F.lit("end").alias("last"))
    d.write.option("header", "true").option("escape", '"').csv(path)
    cells, warnings = read_delimited_cells(spark, path)
    letters = F.regexp_replace("value", r"\s", "")
    read = cells.where("column_name = 'body'").select(F.md5(letters.cast("binary")).alias("digest"), F.length(letters).cast("long").alias("letters"))
    return read.groupBy("digest", "letters").agg(F.count(F.lit(1)).alias("n")).unionByName(
        warnings.select(F.col("message").alias("digest"), F.lit(0).cast("long").alias("letters"), F.lit(1).cast("long").alias("n"))
    )


def markdown_query(spark, sf):
    """One Markdown table per nation with its suppliers, read back as cells."""
    row = F.concat(F.lit("| "), F.col("s_suppkey").cast("string"), F.lit(" | "), "s_name", F.when(F.col("s_suppkey") % 4 == 0, " |").otherwise(F.concat(F.lit(" | "), F.col("s_acctbal").cast("string"), F.lit(" |"))))
    path = _one_file_per_nation(
        spark, sf, row, lambda t: F.concat(F.lit("# title\n\n| key | name | balance |\n|---|:--:|---|\n"), F.concat_ws("\n", t), F.lit("\nend\n")), ".md", "md"
    )
    cells, warnings = read_markdown_cells(spark, path)
    counted = cells.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") == "").alias("blank"), F.countDistinct("value").alias("distinct_values"), F.max("row_index").alias("last_row")
    )
    noted = warnings.groupBy("message").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"))
    zero = F.lit(0).cast("long")
    return counted.unionByName(
        noted.select(F.lit("(warnings)").alias("column_name"), "n", zero.alias("blank"), zero.alias("distinct_values"), zero.alias("last_row"))
    )


QUERIES = {
    "doi_functions": doi_functions_query,
    "extract_markers": markers_query,
    "publication_updates": updates_query,
    "publication_status": status_query,
    "status_summary": status_summary_query,
    "reference_scan": scan_query,
    "read_references": read_references_query,
    "literature_dedupe_enrich": enrich_query,
    "literature_batch_stats": batch_stats_query,
    "read_literature_doi_list": doi_list_query,
    "read_literature_csl": csl_query,
    "read_literature_ris": ris_query,
    "read_literature_bibtex": bibtex_query,
    "read_delimited_cells": delimited_query,
    "read_spanning_cells": spanning_query,
    "read_markdown_cells": markdown_query,
}

# candidates in order of appearance, stripped of closing punctuation, first copies only
CITED_SQL = f""" {REFS_SQL},
 cd as (select list_id, idx, text, doi, case when doi<>'' then [doi] else
    list_transform(regexp_extract_all(text, '10\\.[^\\s,;"]+'), lambda x: regexp_replace(x, '[.,;:)\\]]+$', '')) end c from r),
 ci as (select list_id, idx, text, generate_subscripts(c, 1) p, unnest(c) raw from cd),
 cited as (select list_id, idx, text, min(p) p, raw from ci group by all),
 good as (select *, lower(raw) d from cited where regexp_matches(raw, '^10\\.[0-9]{{4,9}}/[a-zA-Z0-9._;()/:~-]+$'))
"""
ORACLES = {
    "doi_functions": f"""with {CITED_SQL}
      select r.idx as "index", case when doi<>'' then lower(regexp_replace(doi, '^https://doi.org/', '')) end normalized,
      regexp_matches(doi, '^10\\.[0-9]{{4,9}}/[a-zA-Z0-9._;()/:~-]+$') as valid,
      coalesce((select string_agg(raw, ' ' order by p) from (select idx i2, raw, min(p) p from (select idx, generate_subscripts(cc,1) p, unnest(cc) raw from
        (select idx, list_transform(regexp_extract_all(text, '10\\.[^\\s,;"]+'), lambda x: regexp_replace(x, '[.,;:)\\]]+$', '')) cc from r)) group by all) q where q.i2=r.idx), '') candidates from r""",
    "extract_markers": """select doc_id, case when doc_id%7=2 then 'Fig. 2b|figure 2|图 3' else 'Fig. ' || (doc_id%7) || 'b|Fig. 2b|figure 2|图 3' end markers,
      '10.1234/ab.' || source as dois from documents""",
    "publication_updates": f"with {WORKS_SQL} select '10.1000/p' || k doi, relation, raw_type, related_doi, updated_date, t update_type from typed",
    "publication_status": f"""with {WORKS_SQL}, {REFS_SQL}, d as (select lower(regexp_replace(doi, '^https://doi.org/', '')) doi, idx from r where doi<>''),
      u as (select doi, min(idx) seq, count(*) mentions from d group by 1)
      select u.doi, seq, mentions, title, coalesce(status,'metadata_unavailable') status,
      case when status in ('retraction','withdrawal') then 'high' when status='expression_of_concern' then 'medium' else 'low' end risk_level,
      coalesce(status in ('retraction','withdrawal','expression_of_concern'), false) needs_manual_review from u left join ws on ws.doi=u.doi""",
    "status_summary": f"""with {WORKS_SQL}, {REFS_SQL}, u as (select distinct lower(regexp_replace(doi, '^https://doi.org/', '')) doi from r where doi<>'')
      select coalesce(status,'metadata_unavailable') status, count(*) records, count(*) filter (status in ('retraction','withdrawal','expression_of_concern')) needs_review
      from u left join ws on ws.doi=u.doi group by 1""",
    "reference_scan": f"""with {WORKS_SQL}, {CITED_SQL},
      bare as (select list_id, idx, text from cd where text<>'' and len(c)=0),
      yr as (select list_id, idx, text, len(list_filter(regexp_extract_all(text, '\\b[0-9]{{4}}\\b'), lambda y: y::int between 1900 and 2030))>0 has_year from r)
      select list_id, idx as "index", 'malformed_doi' as rule_id, 'low' as risk_level, raw as detail from cited where raw not in (select raw from good)
      union all select list_id, idx, 'missing_doi', 'low', '' from bare
      union all select list_id, idx, 'incomplete_reference_metadata', 'low', '' from yr where text<>'' and (length(text)<20 or not has_year)
      union all select list_id, idx, case when status in ('retraction','withdrawal') then 'retracted_reference' when status='expression_of_concern' then 'expression_of_concern_reference' else 'corrected_reference' end,
        case when status in ('retraction','withdrawal') then 'high' when status='expression_of_concern' then 'medium' else 'low' end, d || ' ' || status
        from good join ws on ws.doi=good.d where status in ('retraction','withdrawal','expression_of_concern','correction')
      union all select list_id, idx, 'duplicate_reference', 'low', d from (select *, row_number() over (partition by list_id, d order by idx, p) rn from good) where rn>1
      union all select list_id, idx, 'duplicate_reference', 'low', 'text' from (select *, row_number() over (partition by list_id, text order by idx) rn from bare) where rn>1""",
    "read_references": f"with {REFS_SQL} select text, doi, count(*) n from r group by all union all select 'lines numbered without gaps', 'true', 1",
    "literature_dedupe_enrich": f"with {ENRICHED_SQL} select * from en",
    "literature_batch_stats": f"""with {ENRICHED_SQL} select source_file, count(*) total_items, count(*) filter (normalized_doi is not null and not is_duplicate) valid_dois,
      count(*) filter (is_duplicate) duplicate_dois, count(*) filter (update_status='retraction') retractions, count(*) filter (update_status='correction') corrections,
      count(*) filter (update_status='expression_of_concern') expressions_of_concern, count(*) filter (normalized_doi is null) review_invalid_doi,
      count(*) filter (normalized_doi is not null and update_status in ('retraction','correction','expression_of_concern')) review_update_status,
      count(*) filter (normalized_doi is null or update_status in ('retraction','correction','expression_of_concern')) manual_review from en group by 1""",
    "read_literature_doi_list": """with p as (select p_partkey%2 odd, case p_partkey%6 when 0 then null else '10.1000/p' || (p_partkey%300) end nd, p_name, p_brand from part)
      select case odd when 1 then 'csv' else 'txt' end source_format, nd normalized_doi, case odd when 1 then p_name end title, case odd when 1 then '2001' end as year,
      case odd when 1 then 'J, "' || p_brand || '"' end journal, count(*) n, count(*) filter (nd is null) warned from p group by all""",
    "read_literature_csl": """select 'id' || s_suppkey item_id, case when s_suppkey%5>0 then '10.1000/p' || s_suppkey end normalized_doi, s_name title, (1990+s_suppkey%30)::varchar as year,
      'Journal of Suppliers' journal, (case when s_suppkey%5>0 then 0 else 1 end)::bigint warned from supplier""",
    "read_literature_ris": """select 'ris-R' || row_number() over (partition by s_nationkey order by s_suppkey) item_id, '10.1000/p' || s_suppkey normalized_doi, s_name title,
      (1990+s_suppkey%30)::varchar as year, 'Journal' journal, 'First, A; Second, B' authors, 'JOUR' reference_type, 'KW:one; two' tags from supplier""",
    "read_literature_bibtex": """select 'key' || s_suppkey item_id, '10.1000/p' || s_suppkey normalized_doi, '{' || s_name title, (1990+s_suppkey%30)::varchar as year, 'Proc. of Things' journal from supplier""",
    "read_delimited_cells": """with c as (select 'p_partkey' column_name, 0 col_index, p_partkey::varchar v from part union all select 'p_size', 1, p_size::varchar from part
      union all select 'p_retailprice', 2, p_retailprice::varchar from part union all select 'quoted', 3, 'a "b", ' || p_brand from part
      union all select 'o_orderkey', 0, o_orderkey::varchar from orders union all select 'o_totalprice', 1, o_totalprice::varchar from orders)
      select column_name, col_index, count(*) n, count(distinct v) distinct_values, max(v) top, round(sum(try_cast(v as double)), 2) total from c group by all""",
    "read_spanning_cells": r"""with d as (select regexp_replace('note "' || doc_id || '",' || coalesce(text, ''), '\s', '', 'g') t from documents)
      select md5(t) digest, length(t)::bigint letters, count(*) n from d group by all""",
    "read_markdown_cells": """with c as (select s_nationkey, row_number() over (partition by s_nationkey order by s_suppkey) rn, s_suppkey::varchar a, s_name b,
       case when s_suppkey%4=0 then '' else s_acctbal::varchar end c from supplier),
      l as (select 'key' column_name, a v, rn from c union all select 'name', b, rn from c union all select 'balance', c, rn from c)
      select column_name, count(*) n, count(*) filter (v='') blank, count(distinct v) distinct_values, max(rn) last_row from l group by 1
      union all select '(warnings)', count(*), 0, 0, 0 from supplier where s_suppkey%4=0""",
}
