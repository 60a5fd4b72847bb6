"""The corpus pipeline: language identification, line dedup, near-dedup on shingles, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; every stage is written
as Parquet in the folder that the cluster shares and read again. All but the last return the columns of
`documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.llm import lang_id, line_dedup, packing, shingle_dedup
from cairn.tables import staged

def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be told: a text without a letter is rejected. A null `lang` takes the prediction; a given one stays.

    If no document has a label there is no model and nothing to predict: documents with a letter stay as they are.
    """
    model = lang_id.fit(docs)
    found = lang_id.language(docs, model, docs.columns)
    kept = found.where(F.col("lang_pred") != lang_id.UNDETERMINED)
    return kept.withColumn("lang", F.coalesce("lang", F.when(F.lit(model is not None), F.col("lang_pred")))).select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take boilerplate lines out of the texts, with n_chars to match; a text that was nothing else goes.

    With both guards of the operator: copies of a page count once, as the next stage keeps one of them whole, and a line has to be
    on five pages, so that a host of a few clean pages keeps them.
    """
    cut = line_dedup.drop_boilerplate(docs, least_pages=5, same_once=True, dropped_col="__cairn_dropped")
    changed = F.col("__cairn_dropped") > 0
    cut = cut.where(~changed | (F.trim("text") != ""))
    return cut.withColumn("n_chars", F.when(changed, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least doc_id: five-word shingles, similarity 0.8 or more.

    Candidates come from the SimHash trees, and from bands where fingerprints are too far apart for them; see shingle_dedup.py.
    """
    return shingle_dedup.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_stage),
    ("best_fit_packing", packing_stage),
]

#: Classifiers and tokenizers have no SQL form; tests/llm compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs, name)
    return docs
