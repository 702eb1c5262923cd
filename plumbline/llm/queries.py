"""Registered queries of the operators on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, dedup, extract, language, manifest, merkle, mixing, neardup, negatives, quality, rules, secrets, toxicity
from plumbline.llm.textops import held_out


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str, column: str, parts: int, part: int) -> DataFrame:
    """The labelled rows that a model may learn from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.where(~held_out(F.col("doc_id"), parts, part)).select("doc_id", F.col(column).alias("label"))


def op1_prefix_free_dedup(spark, sf_dir):
    return dedup.remove_repeats(_documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_naive_bayes_quality(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = quality.fit(docs, _labels(spark, sf_dir, "quality", 4, 2))
    predicted = (F.col("score") >= 0.7).cast("int").alias("predicted")
    return quality.score(docs, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", predicted)


def op3_merkle_fingerprints(spark, sf_dir):
    return merkle.compare_edits(_documents(spark, sf_dir))


def op4_secret_ledger(spark, sf_dir):
    count = lambda kind: F.coalesce(F.size(F.filter("spans", lambda s: s["kind"] == kind)), F.lit(0))
    found = secrets.scan(_documents(spark, sf_dir))
    return found.select(
        "doc_id",
        *[F.when(F.col("spans").isNull(), 0).otherwise(count(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(secrets.joined(F.col("spans"), secrets.KINDS), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def op5_language_id(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    out = held_out(F.col("doc_id"), 3, 1)
    model = language.fit(docs.where(~out), language.PER_LANGUAGE)
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "accepted")


def op6_kneser_ney_toxicity(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    models = toxicity.fit(docs, _labels(spark, sf_dir, "toxic", 5, 0))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return toxicity.score(docs, models).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", predicted)


def op7_qgram_decontamination(spark, sf_dir):
    return decontaminate.leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_curriculum_mix(spark, sf_dir):
    plan = mixing.plan_mix(_documents(spark, sf_dir))
    first = F.get("positions", F.lit(0))
    return plan.select("doc_id", "size", "source_size", "target", "taken", first.alias("position")).orderBy("position", "doc_id")


def op9_block_rules(spark, sf_dir):
    return extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_lsh_forest(spark, sf_dir):
    return neardup.near_duplicates(_documents(spark, sf_dir), width=3, percent=85)


def op11_adaptive_rules(spark, sf_dir):
    found = rules.quality_rules(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_merkle_manifest(spark, sf_dir):
    return manifest.verify_tampered(_documents(spark, sf_dir))


def op13_residue_negatives(spark, sf_dir):
    return negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_prefix_free_dedup": op1_prefix_free_dedup,
    "op2_naive_bayes_quality": op2_naive_bayes_quality,
    "op3_merkle_fingerprints": op3_merkle_fingerprints,
    "op4_secret_ledger": op4_secret_ledger,
    "op5_language_id": op5_language_id,
    "op6_kneser_ney_toxicity": op6_kneser_ney_toxicity,
    "op7_qgram_decontamination": op7_qgram_decontamination,
    "op8_curriculum_mix": op8_curriculum_mix,
    "op9_block_rules": op9_block_rules,
    "op10_lsh_forest": op10_lsh_forest,
    "op11_adaptive_rules": op11_adaptive_rules,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_residue_negatives": op13_residue_negatives,
}

ORACLES: dict[str, str] = {
    "op12_merkle_manifest": """
WITH RECURSIVE field AS (
  SELECT row_number() OVER () AS n, *,
    CASE WHEN hashed % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS shown
  FROM (
    SELECT doc_id, source, lang, n_chars, text,
      list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda crc, byte: list_reduce(
          list_prepend(xor(crc, byte), range(8)),
          lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS crc,
      xor(crc, 4294967295::BIGINT) AS hashed
    FROM documents)
), leaves AS (
  SELECT n, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(shown) || ':' || shown, '-')) AS shown_leaf
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM field)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
), lower_nodes AS (
  SELECT source, 0 AS level, place, leaf AS node, count(*) OVER (PARTITION BY source) AS width FROM placed
  UNION ALL
  SELECT source, level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place)), (any_value(width) + 2) // 3
  FROM lower_nodes WHERE width > 1 GROUP BY source, level, place // 3
), tops AS (
  SELECT source, node AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place, count(*) OVER () AS width
  FROM lower_nodes WHERE width = 1
), upper_nodes AS (
  SELECT 0 AS level, place, subroot AS node, width FROM tops
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place)), (any_value(width) + 2) // 3
  FROM upper_nodes WHERE width > 1 GROUP BY level, place // 3
), lower_climb AS (
  SELECT n, source, 0 AS level, place, shown_leaf AS folded, '' AS siblings FROM placed
  UNION ALL
  SELECT c.n, c.source, c.level + 1, c.place // 3,
    sha256(string_agg(CASE WHEN s.place = c.place THEN c.folded ELSE s.node END, '' ORDER BY s.place)),
    any_value(c.siblings) || coalesce(string_agg(s.node, '' ORDER BY s.place) FILTER (WHERE s.place <> c.place), '')
  FROM lower_climb c JOIN lower_nodes s
    ON c.source IS NOT DISTINCT FROM s.source AND c.level = s.level AND c.place // 3 = s.place // 3 AND s.width > 1
  GROUP BY c.n, c.source, c.level, c.place
), at_top AS (
  SELECT c.n, t.place, t.subroot, c.folded, c.siblings FROM lower_climb c
  JOIN lower_nodes r ON c.source IS NOT DISTINCT FROM r.source AND c.level = r.level AND r.width = 1
  JOIN tops t ON c.source IS NOT DISTINCT FROM t.source
), upper_climb AS (
  SELECT n, 0 AS level, place, folded, siblings FROM at_top
  UNION ALL
  SELECT c.n, c.level + 1, c.place // 3,
    sha256(string_agg(CASE WHEN s.place = c.place THEN c.folded ELSE s.node END, '' ORDER BY s.place)),
    any_value(c.siblings) || coalesce(string_agg(s.node, '' ORDER BY s.place) FILTER (WHERE s.place <> c.place), '')
  FROM upper_climb c JOIN upper_nodes s ON c.level = s.level AND c.place // 3 = s.place // 3 AND s.width > 1
  GROUP BY c.n, c.level, c.place
)
SELECT p.doc_id, p.leaf, a.subroot, r.node AS root, sha256(u.siblings) AS proof_sha256, u.folded AS folded_root, u.folded = r.node AS verified
FROM placed p JOIN at_top a USING (n) JOIN upper_climb u USING (n) JOIN upper_nodes r ON u.level = r.level AND r.width = 1
""",
    "op13_residue_negatives": """
WITH rows AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS scaled
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.n AS anchor, a.vec_id AS anchor_id, b.n, b.vec_id, a.label = b.label AS alike,
    list_inner_product(a.scaled, b.scaled)::BIGINT AS score
  FROM rows a JOIN rows b ON a.n <> b.n WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM scores WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
  row_number() OVER (PARTITION BY p.anchor, p.n ORDER BY s.score DESC, s.vec_id NULLS LAST)::INT AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scores s USING (anchor)
WHERE NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
""",
}
