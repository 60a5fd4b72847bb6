"""The queries of this subpackage, by name, over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio_features, bpe, co_bucket, cws, html_extract, lang_id, license_scan, line_dedup, lm_scoring, packing, simhash, token_counts, whitening


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(_read(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents", "doc_id", "source", "text")
    return line_dedup.drop_boilerplate(documents, dropped_col="n_dropped").drop("source")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents", "doc_id", "text"), _vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_read(spark, sf_dir, "documents", "doc_id", "text"), _vocabulary("byte_bpe_50k.tiktoken"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text"), words=3, radius=2)


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.edit_likeness(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents", "doc_id", "text"), _vocabulary("byte_bpe_50k.json"), limit=512)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op9_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_features.media_digests(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op11_co_bucketed_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co_bucket.shop_pair(spark.read.parquet(f"{sf_dir}/sales.parquet"), spark.read.parquet(f"{sf_dir}/sale_lines.parquet"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings", "vec_id", "embedding"), k=16)


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_corpus(_read(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_token_counts": op7_token_counts,
    "op8_html_extraction": op8_html_extraction,
    "op9_audio_features": op9_audio_features,
    "op10_license_scans": op10_license_scans,
    "op11_co_bucketed_pair": op11_co_bucketed_pair,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_lm_scoring": op13_lm_scoring,
}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express; made when asked for, as one holds a trained model."""
    return {"op2_line_dedup": line_dedup.ORACLE_SQL, "op10_license_scans": license_scan.oracle_sql()}
