"""Streams of large inputs are not squeezed into a few files or tasks."""

from pyspark.sql import functions as F

from plumbline.bindings import composed
from plumbline.bindings.ledger import event_findings
from plumbline.session import scratch_path
from plumbline.streaming import ledgers as S

SF = "/root/testdata/sf0.001"


def _files(spark, folder):
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    return [r["path"] for r in found.select("path").collect()]


def test_a_stream_has_the_files_of_its_rows(spark, monkeypatch):
    folders = []
    monkeypatch.setattr(composed, "scratch_path", lambda s, label: folders.append(scratch_path(s, label)) or folders[-1])
    rows = spark.range(0, 900, 1, 9)
    composed._file_stream(spark, rows, "wide")
    assert len(_files(spark, folders[0])) == 9
    composed._file_stream(spark, rows, "halves", parts=(F.col("id") % 2 == 0, F.col("id") % 2 == 1))
    assert len(_files(spark, folders[1])) == 18 and spark.read.parquet(folders[1]).distinct().count() == 900


def test_state_files_follow_tasks_and_buckets(spark, monkeypatch):
    """A task of a batch holds few buckets; more rows make more tasks."""
    findings = event_findings(spark, SF).withColumns({"ts": F.timestamp_seconds("seq"), "package_id": F.concat(F.lit("p"), F.col("seq").cast("string"))})
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for rows, tasks in ((100_000, parts), (50, 20)):
        monkeypatch.setattr(S, "TASK_ROWS", rows)
        source, folder = scratch_path(spark, "src"), scratch_path(spark, "state")
        findings.write.parquet(source)
        S.stream_mrpi(spark.readStream.schema(findings.schema).parquet(source), "ts", folder, scratch_path(spark, "check")).awaitTermination()
        files = _files(spark, f"{folder}/state/batch=0")
        assert S.BUCKETS <= len(files) <= S.BUCKETS + tasks
        assert S.current_scores(spark, folder).count() == 1000
    assert len({f.rsplit("/", 1)[1].split("-")[1] for f in files}) > parts
