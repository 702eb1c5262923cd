"""Numeric checks bound to the given tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.bindings.common import LINE_CELLS, ORDER_CELLS, line_cells, map_text, order_cells, table
from plumbline.operators import numeric as N
from plumbline.operators import profile as P
from plumbline.sources.frames import cells_from_dataframe


def cells_query(spark, sf):
    return order_cells(spark, sf).select("table_id", "row_index", "col_index", "column_name", "value")


def manifest_query(spark, sf):
    m = P.table_manifest(line_cells(spark, sf))
    return m.select("table_id", "row_count", "column_count", F.concat_ws(",", "columns").alias("columns"))


def profile_query(spark, sf):
    return P.profile_columns(line_cells(spark, sf)).select(
        "table_id",
        "column_name",
        "inferred_type",
        "missing_count",
        "unique_count",
        "numeric_count",
        "integer_count",
        "float_count",
        map_text(F.col("decimal_places_observed")).alias("decimal_places"),
        map_text(F.col("terminal_digits_observed")).alias("terminal_digits"),
        "max_places",
    )


def modal_query(spark, sf):
    counts = P.value_counts(P.numeric_values(line_cells(spark, sf)))
    return P.modal_value(counts).select(
        "table_id", "column_name", F.col("modal_value").cast("double").alias("modal_value"), "modal_count", "total_count", "unique_count"
    )


def runs_query(spark, sf):
    runs = P.run_lengths(P.numeric_values(order_cells(spark, sf)))
    return runs.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_runs"), F.max("run_length").alias("max_run"), F.sum(F.col("run_length") * F.col("run_start")).alias("weighted")
    )


def overflow_query(spark, sf):
    """Part keys with twenty zeros behind them or twenty before a last one, among plain quantities."""
    key = F.col("l_partkey").cast("string")
    five = F.col("l_orderkey") % 5
    text = (
        F.when(five == 0, F.concat(key, F.lit("0" * 20)))
        .when(five == 1, F.concat(F.lit("0."), key, F.lit("0" * 21 + "1")))
        .otherwise(F.col("l_quantity").cast("string"))
    )
    rows = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("_row"), text.alias("t"))
    cells = cells_from_dataframe(rows, F.lit("lines"), F.col("_row"), ["t"], F.col("l_returnflag"))
    return N.precision_overflow(cells).select("package_id", "overflowing", "first_row", "example")


def step_query(spark, sf):
    scaled = P.scaled_counts(P.value_counts(P.numeric_values(line_cells(spark, sf))))
    return P.step_profile(scaled).select(
        "table_id",
        "column_name",
        F.round("min_positive_step", 6).alias("min_positive_step"),
        F.round("modal_step", 6).alias("modal_step"),
        "modal_step_count",
    )


def overlap_query(spark, sf):
    values = P.numeric_values(line_cells(spark, sf))
    pairs = values.select("package_id", "table_id").distinct().select(
        "package_id", "table_id", F.lit("l_discount").alias("left_column"), F.lit("l_tax").alias("right_column")
    )
    return P.value_set_overlap(values, pairs).select("table_id", "shared_values", "all_values", F.round("overlap", 9).alias("overlap"))


def lattice_query(spark, sf):
    scaled = P.chunked_values(P.scaled_counts(P.value_counts(P.numeric_values(order_cells(spark, sf)))))
    return P.lattice_fit(scaled).select(
        "column_name",
        F.round("lattice_step", 6).alias("lattice_step"),
        F.round("lattice_overlap", 9).alias("lattice_overlap"),
        F.round("lattice_residual", 9).alias("lattice_residual"),
    )


def terminal_digit_query(spark, sf):
    found = N.terminal_digit_stats(line_cells(spark, sf))
    return found.select(
        "table_id", "column_name", "sample_size", "dominant_digit", "dominant_count",
        F.round("dominant_fraction", 9).alias("dominant_fraction"), "risk_level", "open_for_scoring",
    )


def fixed_delta_query(spark, sf):
    found = N.fixed_delta(order_cells(spark, sf))
    meta = F.col("metadata")
    return found.select(
        "table_id",
        meta["first_column"].alias("first_column"),
        meta["second_column"].alias("second_column"),
        F.round(meta["delta"].cast("double"), 6).alias("delta"),
        meta["sample_size"].cast("long").alias("sample_size"),
        "risk_level",
    )


def fixed_delta_independent_query(spark, sf):
    lines = table(spark, sf, "part").select(
        "p_partkey",
        "p_size",
        (F.col("p_size") + 7).alias("size_shifted"),
        (F.col("p_size") - 2).alias("size_lower"),
        F.col("p_retailprice").alias("temperature_c"),
        F.round(F.col("p_retailprice") + 273.15, 2).alias("temperature_k"),
        (F.col("p_size") + 1).alias("size_norm"),
    )
    names = ["p_size", "size_shifted", "size_lower", "temperature_c", "temperature_k", "size_norm"]
    cells = cells_from_dataframe(lines, F.lit("part"), F.col("p_partkey"), names)
    contexts = spark.createDataFrame(
        [(None, "size_shifted", "independent_measurement"), ("part", "size_lower", "independent_measurement")],
        "table_id string, column_name string, role string",
    )
    meta = F.col("metadata")
    return N.fixed_delta(cells, contexts).select(
        meta["first_column"].alias("first_column"),
        meta["second_column"].alias("second_column"),
        F.round(meta["delta"].cast("double"), 6).alias("delta"),
        "risk_level",
        "open_for_scoring",
    )


def grid_query(spark, sf):
    found = N.grid_metrics(line_cells(spark, sf).unionByName(order_cells(spark, sf)))
    return found.where(F.col("candidate_risk").isNotNull()).select(
        "table_id",
        "column_name",
        "total_count",
        "unique_count",
        F.round("lattice_step", 6).alias("lattice_step"),
        F.round("lattice_overlap", 9).alias("lattice_overlap"),
        F.round("lattice_residual", 9).alias("lattice_residual"),
        "max_run_length",
        "candidate_risk",
    )


QUERIES = {
    "cells_from_dataframe": cells_query,
    "table_manifest": manifest_query,
    "profile_columns": profile_query,
    "modal_value": modal_query,
    "run_lengths": runs_query,
    "precision_overflow": overflow_query,
    "step_profile": step_query,
    "value_set_overlap": overlap_query,
    "lattice_fit": lattice_query,
    "terminal_digit": terminal_digit_query,
    "fixed_delta": fixed_delta_query,
    "fixed_delta_independent": fixed_delta_independent_query,
    "quantization_grid": grid_query,
}

NUM = "regexp_matches(trim(value), '^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?$')"
PLACES = "case when len(string_split(trim(value),'.'))=2 then len(regexp_replace(string_split(trim(value),'.')[2],'[^0-9]','','g')) else 0 end"
LAST = "regexp_extract(value,'([0-9])[^0-9]*$',1)"

# values with their integer units at the finest scale of the column
FIT = f"""
 vals as (select table_id, column_name, row_index, try_cast(value as decimal(37,18)) v, {PLACES} places from cells where {NUM}),
 counts as (select table_id, column_name, v, count(*) n, min(row_index) first_row, max(places) places from vals group by all),
 shape as (select table_id, column_name,
    max(len(regexp_replace(string_split(cast(v as varchar),'.')[2],'0+$',''))) as scale, max(places) mp, sum(n)::bigint total,
    count(*) uniq, min(v) v0 from counts group by all),
 units as (select c.table_id, c.column_name, c.n, cast(round(c.v * power(10, s.scale)) as bigint) k,
    cast(round(s.v0 * power(10, s.scale)) as bigint) k0 from counts c join shape s using (table_id, column_name)),
 gaps as (select table_id, column_name, k, k - lag(k) over (partition by table_id, column_name order by k) g from units),
 steps as (select table_id, column_name, g as step, count(*) step_count, min(k) first_k from gaps where g is not null group by all)
"""
LATTICE = """
 cand as (select s.*, h.scale, h.mp, h.total from steps s join shape h using (table_id, column_name)
    where s.step >= 1.5 * power(10, h.scale - h.mp)),
 dist as (select c.table_id, c.column_name, c.step, c.scale, c.mp, c.total, u.n,
    least((u.k-u.k0) % c.step, c.step - (u.k-u.k0) % c.step) d from cand c join units u using (table_id, column_name)),
 scored as (select table_id, column_name, step, scale, mp, total,
    sum(case when d <= greatest(power(10, scale-mp)/4, step*0.000001, power(10, scale)*1e-12) then n else 0 end)::bigint aligned,
    sum(d*n)::double / total / step as residual from dist group by table_id, column_name, step, scale, mp, total),
 best as (select *, row_number() over (partition by table_id, column_name order by aligned desc, residual, step desc) rk from scored),
 fit as (select table_id, column_name, step / power(10, scale) lattice_step, aligned::double/total lattice_overlap,
    residual lattice_residual from best where rk=1)
"""

_PROFILE = f"""
with {LINE_CELLS},
 t as (select table_id, column_name, trim(value) v, count(*) n from cells group by all),
 f as (select *, lower(v) in ('','na','n/a','nan','null','none') miss, v as value from t),
 g as (select table_id, column_name, v, n, miss, {NUM} and not miss num, {PLACES} places, {LAST} digit,
   case when contains(v,'.') then {NUM} and try_cast(v as double) = floor(try_cast(v as double)) else regexp_matches(v,'^[+-]?[0-9]+$') end whole from f),
 a as (select table_id, column_name, sum(n)::bigint total, coalesce(sum(n) filter (miss),0)::bigint missing_count,
   count(*) filter (not miss) unique_count, coalesce(sum(n) filter (num),0)::bigint numeric_count,
   coalesce(sum(n) filter (num and whole),0)::bigint integer_count, max(places) filter (num) max_places from g group by all),
 dp as (select table_id, column_name, string_agg(places || ':' || c, ',' order by places) decimal_places from
   (select table_id, column_name, places, sum(n)::bigint c from g where num group by all) group by all),
 td as (select table_id, column_name, string_agg(digit || ':' || c, ',' order by digit) terminal_digits from
   (select table_id, column_name, digit, sum(n)::bigint c from g where num and digit<>'' group by all) group by all)
select table_id, column_name, case when numeric_count = total-missing_count and integer_count=numeric_count then 'integer'
   when numeric_count = total-missing_count then 'float' when numeric_count>0 then 'mixed' else 'string' end inferred_type,
   missing_count, unique_count, numeric_count, integer_count, numeric_count-integer_count as float_count,
   decimal_places, terminal_digits, max_places::int max_places
from a left join dp using (table_id, column_name) left join td using (table_id, column_name)
"""

_GRID_CELLS = LINE_CELLS.replace("cells as (", "cells_l as (").replace("src as", "src_l as").replace("from src", "from src_l") + "," + (
    ORDER_CELLS.replace("cells as (", "cells_o as (")
) + """,
 cells as (select table_id, row_index, column_name, value from cells_l
   union all select 'orders', row_index, column_name, value from cells_o)
"""

ORACLES = {
    "cells_from_dataframe": f"with {ORDER_CELLS} select 'orders' as table_id, row_index, col_index, column_name, value from cells",
    "table_manifest": f"""with {LINE_CELLS}
      select table_id, count(distinct row_index) filter (false) + count(*)//4 as row_count, count(distinct column_name) as column_count,
      'l_quantity,l_extendedprice,l_discount,l_tax' as columns from cells group by table_id""",
    "profile_columns": _PROFILE,
    "modal_value": f"""with {LINE_CELLS},
      c as (select table_id, column_name, try_cast(value as decimal(37,18)) v, count(*) n, min(row_index) f from cells group by all),
      r as (select *, row_number() over (partition by table_id, column_name order by n desc, f, v desc) rk,
        sum(n) over (partition by table_id, column_name) total, count(*) over (partition by table_id, column_name) uniq from c)
      select table_id, column_name, v::double modal_value, n modal_count, total::bigint total_count, uniq unique_count from r where rk=1""",
    "run_lengths": f"""with {ORDER_CELLS},
      p as (select column_name, row_index, value, lag(value) over (partition by column_name order by row_index) pv from cells),
      q as (select column_name, row_index, sum(case when value = pv then 0 else 1 end) over (partition by column_name order by row_index) run from p),
      r as (select column_name, run, count(*) run_length, min(row_index) run_start from q group by all)
      select column_name, count(*) n_runs, max(run_length) max_run, sum(run_length*run_start)::bigint weighted from r group by all""",
    "precision_overflow": """with v as (select l_returnflag g, l_orderkey*8+l_linenumber k, case when l_orderkey%5=0 and l_partkey>0 then l_partkey::varchar || '00000000000000000000'
        when l_orderkey%5=1 then '0.' || l_partkey::varchar || '0000000000000000000001' else l_quantity::varchar end t from lineitem)
      select g package_id, count(*) overflowing, min(k) first_row, arg_min(t, k) example from v where length(t)>20 group by 1""",
    "step_profile": f"""with {LINE_CELLS}, {FIT},
      m as (select table_id, column_name, min(step) mn from steps group by all),
      b as (select *, row_number() over (partition by table_id, column_name order by step_count desc, first_k, step desc) rk from steps)
      select b.table_id, b.column_name, round(m.mn/power(10,h.scale),6) min_positive_step, round(b.step/power(10,h.scale),6) modal_step,
      b.step_count modal_step_count from b join m using (table_id, column_name) join shape h using (table_id, column_name) where rk=1""",
    "value_set_overlap": f"""with {LINE_CELLS},
      d as (select table_id, value::decimal(37,18) v, count(distinct column_name) s from cells where column_name in ('l_discount','l_tax') group by all)
      select table_id, count(*) filter (s=2) shared_values, count(*) all_values, round(count(*) filter (s=2)/count(*)::double, 9) overlap from d group by all""",
    "lattice_fit": f"""with {ORDER_CELLS.replace("select row_index, 0 as col_index", "select 'orders' as table_id, row_index, 0 as col_index").replace("select row_index, 1", "select 'orders', row_index, 1").replace("select row_index, 2", "select 'orders', row_index, 2").replace("select row_index, 3", "select 'orders', row_index, 3")}, {FIT}, {LATTICE}
      select column_name, round(lattice_step,6) lattice_step, round(lattice_overlap,9) lattice_overlap, round(lattice_residual,9) lattice_residual from fit""",
    "terminal_digit": f"""with {LINE_CELLS},
      d as (select table_id, column_name, {LAST} digit, count(*) n, min(row_index) f from cells where {NUM} group by all),
      r as (select *, row_number() over (partition by table_id, column_name order by n desc, f, digit desc) rk,
        sum(n) over (partition by table_id, column_name) total from d)
      select table_id, column_name, total::bigint sample_size, digit dominant_digit, n dominant_count, round(n/total::double,9) dominant_fraction,
      case when total>=15 then 'medium' else 'low' end risk_level, total>=15 as open_for_scoring from r where rk=1 and n>=0.8*total""",
    "fixed_delta": f"""with {ORDER_CELLS},
      v as (select row_index, col_index, column_name, value::decimal(37,18) v from cells),
      p as (select a.column_name first_column, b.column_name second_column, count(*) n, min(b.v-a.v) d1, max(b.v-a.v) d2
        from v a join v b on a.row_index=b.row_index and a.col_index<b.col_index group by all)
      select 'orders' table_id, first_column, second_column, round(d1::double,6) delta, n sample_size, 'low' risk_level from p where d1=d2""",
    "fixed_delta_independent": """with s as (select count(*) n from part)
      select * from (values ('p_size','size_shifted',7.0::double,'low',false),('p_size','size_lower',-2.0::double,'low',false),
        ('size_shifted','size_lower',-9.0::double,'medium',true)) t(first_column, second_column, delta, risk_level, open_for_scoring)
      where (select n from s) >= 15""",
    "quantization_grid": f"""with {_GRID_CELLS}, {FIT}, {LATTICE},
      o as (select table_id, column_name, row_index, v, lag(v) over (partition by table_id, column_name order by row_index) pv from vals),
      q as (select table_id, column_name, sum(case when v = pv then 0 else 1 end) over (partition by table_id, column_name order by row_index) run from o),
      r as (select table_id, column_name, max(c) max_run_length from (select table_id, column_name, run, count(*) c from q group by all) group by all),
      m as (select table_id, column_name, max(n) modal_n from counts group by all)
      select f.table_id, f.column_name, h.total total_count, h.uniq unique_count, round(lattice_step,6) lattice_step, round(lattice_overlap,9) lattice_overlap,
      round(lattice_residual,9) lattice_residual, max_run_length, case when h.total>=20 then 'medium' else 'low' end candidate_risk
      from fit f join shape h using (table_id, column_name) join r using (table_id, column_name) join m using (table_id, column_name)
      where h.total>=8 and lattice_overlap>=0.9 and lattice_residual<=0.02 and (h.uniq/h.total::double<=0.75 or m.modal_n/h.total::double>=0.15 or max_run_length>=2)""",
}
