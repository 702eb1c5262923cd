"""File helpers for queries that write derived data before reading it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_each(texts: DataFrame, folder: str, suffix: str) -> None:
    """Write the column ``value`` of every row as a file of its own, within the tasks.

    Files get their final names at once: no commit moves them and the driver touches none, so
    the time of many files is shared by all tasks. A name is made of the partition and the row,
    so a task that runs again writes the same files. ``folder`` lies in the shared folder.
    """

    def write(batches):
        import posixpath

        import pyarrow as pa
        import pyarrow.fs
        from pyspark import TaskContext

        files, root = pa.fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        number = 0
        for batch in batches:
            for value in batch.column(0):
                name = f"part-{TaskContext.get().partitionId():05d}-{number:07d}{suffix}"
                with files.open_output_stream(posixpath.join(root, name)) as out:
                    out.write(value.as_py())
                number += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([number], pa.int64())})

    values = texts.select(F.coalesce("value", F.lit("")).cast("binary").alias("value"))
    values.mapInArrow(write, "files long").agg(F.sum("files")).collect()


def rename_suffix(spark, path: str, old: str, new: str) -> None:
    """Give the files of a folder another suffix, through Spark's own file system."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        source = status.getPath()
        if source.getName().endswith(old):
            fs.rename(source, jvm.org.apache.hadoop.fs.Path(folder, source.getName()[: -len(old)] + new))
