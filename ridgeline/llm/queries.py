"""The queries opN_<name>, their SQL, and the parameters they run with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html, lines, minhash, mixing, packing, suffix, tokens, topk, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 85, 100)


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = lines.judge_lines(table(spark, sf_dir, "documents"), with_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_words", "kept")


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op4_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), 50, 5)


def op5_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages"))


def op6_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digest(tokens.token_store(table(spark, sf_dir, "documents"), tokens.vocabulary_path()))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_spans(table(spark, sf_dir, "documents"))


def op9_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokens.vocabulary_path())


def op10_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_forest,
        op2_line_rules,
        op3_url_templates,
        op4_threshold_topk,
        op5_tag_paths,
        op6_recurrent_toxicity,
        op7_orc_tokens,
        op8_suffix_array,
        op9_bm25_packing,
        op10_budget_mix,
    )
}

TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE_SQL: dict[str, str] = {"op2_line_rules": lines.ORACLE_SQL, "op3_url_templates": urls.ORACLE_SQL, "op4_threshold_topk": TOPK_SQL}
