"""Session defaults and the shared folder used to cut lineage or stage files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Scratch folders of local sessions without spark.checkpoint.dir, by application.
_LOCAL_SCRATCH: dict[str, str] = {}


def build_session(app: str = "plumbline", master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster supplies its own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.plumbline.spread", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach.

    Comes from ``spark.checkpoint.dir``. Only a local-mode session without that
    setting gets a scratch folder of its own, because there driver and executors
    share one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a plan reads one expensive intermediate several times, or where a
    partition-dependent column must keep its value. The files outlive a lost executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, worked out once per row.

    A generator of one struct makes plain columns out of them: the optimizer neither copies
    a long expression into each of its uses nor infers filters from it, which takes it
    minutes where hundreds of expressions build on each other.
    """
    every = [F.col(f"`{c}`") for c in df.columns] + [c.alias(name) for name, c in columns.items()]
    return df.select(F.inline(F.array(F.struct(*every))))
