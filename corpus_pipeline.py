"""From raw documents to a training mix, in five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``docs`` is the first input
or what the stage before has kept, written and read again. All but the last return the
columns of documents. The rows of ``run`` depend on fitted models and on similarity
search, which SQL cannot express.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, mixing, neardup, secrets, toxicity
from plumbline.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if its toxicity score is at least this.
TOXIC = 0.5
#: Shingles and percentage of the near-duplicate stage.
SHINGLE, PERCENT = 5, 80


def _id() -> Column:
    """Stands for the id in joins, so that rows without one find each other too."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def _blob() -> Column:
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the class-conditional language models do not call toxic."""
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    models = toxicity.fit(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs, models).where(F.col("score") < TOXIC).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near-duplicates.

    Rows that repeat the kept doc_id stay; a document without words or id stays.
    """
    gone = neardup.near_duplicates(docs, SHINGLE, PERCENT).where(~F.col("kept")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of a benchmark item.

    Rows with one doc_id are one document; a row without an id is named by its text.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    named = docs.select(*COLUMNS, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), _blob())).alias("_name"))
    found = decontaminate.leaks(named.select(F.col("_name").alias("doc_id"), "text"), benchmark)
    return named.join(found.select(F.col("doc_id").alias("_name")).distinct(), "_name", "left_anti").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts by a mark; all documents stay."""
    docs = docs.select(*COLUMNS)
    found = secrets.scan(docs).where(F.size("spans") > 0).select(_id().alias("_id"), "blob", "spans").dropDuplicates(["_id", "blob"])
    found = materialize(found, "secrets")
    named = docs.withColumn("_id", _id()).withColumn("blob", _blob()).join(found, ["_id", "blob"], "left")
    text = secrets.redact(F.col("text"), F.col("spans"))
    size = F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.char_length(text).cast("long"))
    return named.select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: one row per copy of a document that the mix takes, with its text.

    ``words`` of the text are taken; the text of the copy at the end of a source's target
    ends after them.
    """
    plan = mixing.plan_mix(docs.withColumn("_blob", _blob()), carry=("_blob",)).where(F.col("taken") > 0)
    texts = docs.select(_id().alias("_id"), _blob().alias("_blob"), "text").dropDuplicates(["_id", "_blob"])
    order = mixing.training_order(plan.withColumn("_id", _id()).join(texts, ["_id", "_blob"]).drop("_id", "_blob"))
    words = F.least(F.col("size"), F.col("taken") - F.col("size") * F.col("copy"))
    cut = F.when(words < F.col("size"), mixing.first_words(F.col("text"), words)).otherwise(F.col("text"))
    return order.withColumn("words", words).withColumn("text", cut)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
