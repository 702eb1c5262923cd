"""Continuous ledgers: unify, score, alert and digit checks as structured streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from plumbline.functions.cells import terminal_digit
from plumbline.operators import ledger as L
from plumbline.operators.numeric import DIGIT_SHARE, MEDIUM_SAMPLE
from plumbline.schemas import FINDINGS


def stream_unify(findings: DataFrame, event_time: str, delay: str = "1 day") -> DataFrame:
    """Valid findings of a stream, each dedupe key once per watermark period.

    State lives only as long as ``delay``: a copy that arrives later than that passes again.
    """
    valid = findings.where(F.size(L.schema_issues()) == 0)
    prepared = L.prepare_unified(valid)
    return prepared.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(L.DEDUPE_KEY)


def stream_status_alerts(updates: DataFrame, references: DataFrame, event_time: str, delay: str = "1 day") -> DataFrame:
    """Update notices of a stream for the works that reference lists cite.

    ``updates``: ``doi, related_doi, update_type`` and an event time; ``references`` is
    static: ``list_id, doi``. Repeated notices go before the join; equal citations of a
    list are one row.
    """
    fresh = updates.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["doi", "related_doi"])
    cited = references.groupBy("doi", "list_id").agg(F.count(F.lit(1)).alias("citations"))
    return fresh.join(cited, "doi")


def stream_terminal_digit(
    values: DataFrame, event_time: str, keys: list[str], value: str, width: str = "1 day", delay: str = "1 day", minimum: int = 5
) -> DataFrame:
    """Dominant last digit per time window and key, once the watermark has passed the window.

    Digit counts first, ten rows per window and key next; both groupings are stateful
    aggregations in append mode.
    """
    digits = (
        values.withColumn("digit", terminal_digit(F.col(value)))
        .where(F.col("digit").isNotNull())
        .withWatermark(event_time, delay)
        .groupBy(F.window(event_time, width).alias("w"), *keys, "digit")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.unix_micros(event_time)).alias("first"))
    )
    best = F.max(F.struct("n", (-F.col("first")).alias("neg"), "digit"))
    share = F.col("b.n") / F.col("sample_size")
    return (
        digits.groupBy(F.window(F.window_time("w"), width).alias("w"), *keys)
        .agg(F.sum("n").alias("sample_size"), best.alias("b"))
        .where((F.col("sample_size") >= max(5, minimum)) & (share >= DIGIT_SHARE))
        .select(
            F.col("w.start").alias("window_start"),
            *keys,
            "sample_size",
            F.col("b.digit").alias("dominant_digit"),
            share.alias("dominant_fraction"),
            F.when(F.col("sample_size") >= MEDIUM_SAMPLE, "medium").otherwise("low").alias("risk_level"),
        )
    )


BUCKETS = 64
#: Findings of one task of a batch, about.
TASK_ROWS = 100_000


def _bucket() -> Column:
    return F.pmod(F.xxhash64("package_id"), F.lit(BUCKETS)).cast("int")


def _load(spark: SparkSession, path: str, schema: T.StructType, before: int) -> DataFrame | None:
    """Newest version of every bucket from batches before ``before``; None for an empty folder.

    Batch and bucket are folders, so finding the newest batch of each of the ``BUCKETS``
    buckets reads no data, and only the files of those versions are read afterwards.
    """
    try:
        rows = spark.read.schema(schema).parquet(path).where(F.col("batch") < before)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    newest: dict[int, list[int]] = {}
    for r in rows.groupBy("bucket").agg(F.max("batch").alias("batch")).collect():
        newest.setdefault(r["batch"], []).append(r["bucket"])
    wanted = F.lit(False)
    for batch, buckets in newest.items():
        wanted = wanted | ((F.col("batch") == batch) & F.col("bucket").isin(buckets))
    return rows.where(wanted)


def _state_schema(event_time: str) -> T.StructType:
    return T.StructType(
        [*FINDINGS.fields, T.StructField(event_time, T.TimestampType()), T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())]
    )


SCORES = T.StructType(
    [
        T.StructField("package_id", T.StringType()),
        T.StructField("mrpi", T.DoubleType()),
        T.StructField("scored_findings", T.LongType()),
        T.StructField("batch", T.LongType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)


def stream_mrpi(findings: DataFrame, event_time: str, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep the newest state of every finding and the score of every package.

    State and scores are Parquet below ``folder``, one version per batch and only for
    the buckets a batch touches. A version is written from older ones alone, so a batch
    that is delivered again writes the same files again. A finding that is closed later
    stops counting, because the newest state replaces the older one.
    """
    state_path, score_path = f"{folder}/state", f"{folder}/scores"
    columns = [*FINDINGS.names, event_time]

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = _state_schema(event_time)
        incoming = batch.withColumn("package_id", F.coalesce("package_id", F.lit(""))).select(*columns).withColumn("bucket", _bucket())
        touched = incoming.select("bucket").distinct()
        stored = _load(spark, state_path, schema, batch_id)
        rows = incoming if stored is None else incoming.unionByName(stored.join(touched, "bucket", "left_semi").select(*columns, "bucket"))
        # as many tasks as the rows need; each holds few buckets, so it writes few files
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))
        rows = rows.repartitionByRange(tasks, "bucket", "package_id", "finding_id")
        rest = [c for c in columns if c not in ("package_id", "finding_id")]
        order = F.struct(event_time, F.xxhash64(F.to_json(F.struct(*rest))))
        newest = rows.groupBy("package_id", "finding_id", "bucket").agg(F.max_by(F.struct(*rest), order).alias("s"))
        merged = newest.select("package_id", "finding_id", "s.*", "bucket").select(*columns, "bucket")
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{state_path}/batch={batch_id}")
        written = spark.read.schema(schema).option("basePath", state_path).parquet(f"{state_path}/batch={batch_id}")
        scores = L.mrpi(written).withColumn("bucket", _bucket())
        scores.write.mode("overwrite").partitionBy("bucket").parquet(f"{score_path}/batch={batch_id}")

    writer = findings.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def current_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Newest score of every package, from the files of :func:`stream_mrpi`."""
    found = _load(spark, f"{folder}/scores", SCORES, 1 << 62)
    if found is None:
        return spark.createDataFrame([], SCORES).drop("batch", "bucket")
    return found.drop("batch", "bucket")
