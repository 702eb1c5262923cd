"""Many small files are written with their final names by the tasks."""

from plumbline.bindings import curves
from plumbline.bindings.files import write_each
from plumbline.session import scratch_path


def test_every_row_is_a_file_of_its_own(spark):
    folder = scratch_path(spark, "each")
    texts = ["a\n\u0001", "", None, "größe", "a\n\u0001"] * 20
    write_each(spark.createDataFrame([(t,) for t in texts], "value string").repartition(3), folder, "_x.png")
    read = spark.read.format("binaryFile").load(folder).select("path", "content").collect()
    # Spark's reader passes over empty files
    assert sorted(bytes(r["content"]).decode() for r in read) == sorted(t for t in texts if t)
    assert all(r["path"].endswith("_x.png") for r in read)


def test_no_file_is_renamed_by_the_driver():
    """One call per file to the file system of the driver takes hours for many files."""
    assert not hasattr(curves, "rename_suffix")
