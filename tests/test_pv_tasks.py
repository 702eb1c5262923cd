"""Cells of very large tables are not gathered by their few headers."""

from plumbline.operators import pv
from plumbline.plans import reviews


def test_cells_are_not_shuffled_by_header(spark, make_cells):
    header = ["Device ID", "Voc (mV)", "Jsc (mA/cm2)", "FF (%)", "PCE (%)"]
    cells = make_cells(header, [[f"d{k}", "1100", "22", "80", "19.4"] for k in range(40)]).repartition(4)
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        rows = pv.pv_metric_rows(cells)
        plan = rows._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin [column_name" in plan and "SortMergeJoin" not in plan
        got = rows.select("device_id", "voc_v", "pce_percent").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert sorted(got) == sorted((f"d{k}", 1.1, 19.4) for k in range(40))


def test_metric_rows_are_typed_once_for_all_checks(spark, make_cells):
    header = ["Device ID", "Voc (mV)", "Jsc (mA/cm2)", "FF (%)", "PCE (%)"]
    found = reviews.pv_review(make_cells(header, [[f"d{k}", "1100", "22", "80", "12"] for k in range(4)]))
    assert "max_by" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.where("rule_id = 'pv_pce_consistency'").count() == 4
