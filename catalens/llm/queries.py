"""The registered queries of the llm operators, with their production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.llm._common import crc32_mod, scratch_scope, table
from catalens.llm.adaptive_quality import quality_verdicts, verdict_sql
from catalens.llm.cgk_decontam import find_items
from catalens.llm.hard_negatives import hard_negatives, hard_negatives_sql, whole_vectors
from catalens.llm.importance_resampling import resample, resample_sql
from catalens.llm.kd_sharding import kd_shards
from catalens.llm.kneser_ney import score_texts, train
from catalens.llm.ngram_join import jaccard_components
from catalens.llm.piece_spans import piece_digests
from catalens.llm.quartile_digest import edit_likeness
from catalens.llm.secret_forest import scan_secrets
from catalens.llm.token_frames import token_digests
from catalens.llm.warc_chain import warc_round_trip
from catalens.llm.zstd_language import learn_dictionaries, predict_languages


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_mod(F.col("doc_id"), 5) == 1
    with scratch_scope(spark) as keep:
        model = train(docs, ~held_out, order=3)
        return keep(score_texts(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text"), "scores")


def op3_cgk_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch_scope(spark) as keep:
        read = warc_round_trip(spark, table(spark, sf_dir, "pages"), min_payload=0)
        return keep(read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "pages-read")


def op5_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch_scope(spark) as keep:
        judged = quality_verdicts(table(spark, sf_dir, "documents"))
        return keep(judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"), "verdicts")


def op6_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_mod(F.col("doc_id"), 3) == 1
    dictionaries = learn_dictionaries(docs, ~held_out)
    return predict_languages(docs.select("doc_id", held_out.alias("held_out"), "text"), dictionaries).drop("text")


def op7_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch_scope(spark) as keep:
        found = scan_secrets(table(spark, sf_dir, "documents"))
        return keep(found.select("doc_id", "ordinal", F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").cast("long").alias("n_chars"), "score", "is_secret"), "secrets")


def op8_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch_scope(spark) as keep:
        return keep(token_digests(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), "digests")


def op9_piece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op10_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch_scope(spark) as keep:
        placed = kd_shards(table(spark, sf_dir, "documents"), n_shards=40)
        return keep(placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")), "shards")


def op11_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(whole_vectors(table(spark, sf_dir, "embeddings"), label=label), F.col("vec_id") % 100 == 0)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_kneser_ney": op2_kneser_ney,
    "op3_cgk_decontam": op3_cgk_decontam,
    "op4_warc_chain": op4_warc_chain,
    "op5_adaptive_quality": op5_adaptive_quality,
    "op6_zstd_language": op6_zstd_language,
    "op7_secret_forest": op7_secret_forest,
    "op8_token_frames": op8_token_frames,
    "op9_piece_spans": op9_piece_spans,
    "op10_kd_sharding": op10_kd_sharding,
    "op11_quartile_digest": op11_quartile_digest,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_importance_resampling": op13_importance_resampling,
}
#: Oracles of the queries that SQL can express on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op5_adaptive_quality": verdict_sql(),
    "op12_hard_negatives": hard_negatives_sql(),
    "op13_importance_resampling": resample_sql(),
}
