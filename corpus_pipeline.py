"""A corpus pipeline of the operators in kairolog.llm: language identification, exact deduplication, near-duplicate
removal, mixing to target weights, packing. Each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kairolog.llm import exactdedup, langid, mixing, ngramjoin, packing
from kairolog.llm.shared import own, saved, small, workspace


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: those without a letter (null and empty texts too), or scored below the
    calibrated bound. Where no row can be learnt from, every row goes. Other columns, whatever their names, and repeated
    rows stay as they are; an empty table stays so."""
    return langid.accepted(docs, langid.fit(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null and empty ones are) the document with the largest doc_id stays; of repeated rows one. Other
    columns, whatever their names, stay as they are; an empty table stays so."""
    return exactdedup.deduplicated(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays. Texts without words, and rows without a
    doc_id, are linked with nothing and stay; rows of one doc_id stay or go together. Other columns, whatever their names,
    stay as they are; an empty table stays so."""
    found = ngramjoin.jaccard_components(docs.select("doc_id", "text"))
    gone = saved(found.filter("doc_id <> component_id").select("doc_id").distinct(), f"{workspace(spark, 'near')}/gone")
    return docs.join(small(gone), "doc_id", "left_anti").select(*own(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them. A null lang or source counts as `none`; a null text has no tokens;
    repeated rows are taken each. Other columns, whatever their names, stay as they are; an empty table stays so."""
    return mixing.sampled(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, as in op5_packing: of each row, repeated ones too; a null text is empty. An empty table gives
    none."""
    return packing.digests(packing.pack(docs))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("ngram_join", ngram_join), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

#: SQL can't express a trained classifier or the tokenizer; tests/llm/test_stages.py holds the rows of each stage against
#: a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), workspace(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"{folder}/{i}-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
