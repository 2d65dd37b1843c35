"""From raw documents to packed sequences: each stage takes what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import mixing, near_dedup, packing, quality, substring_dedup
from sparkloom.llm.common import read, written

#: No SQL: the stages learn a model, cut fuzzy passages, solve a flow and pack bins. tests/llm has brute-force versions.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are judged as an empty text; repeated rows are judged
    alike and stay or go together; rows without an id are judged like others; an empty table gives an empty one."""
    return quality.keep_quality(docs, read(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id. Rows are told apart by id and text; of
    rows repeated with both, one stays. Rows without words stay; a group without ids keeps one of its rows."""
    return near_dedup.one_of_each_group(docs)


def chained_substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has too are cut out; documents of which nothing is left go. Rows without an id and null or
    empty texts come through unchanged; rows repeated under one id are one document."""
    return substring_dedup.cut_passages(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their targets; a document is there as often as the mix takes it, three times at most. A null source is a
    source; rows without words, null texts among them, are never taken; repeated rows are decided one by one."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of documents; sizes are words. Rows without words are in no bin, null ids stay null in their bin, repeated rows are packed
    each time; an empty table gives no bins."""
    return packing.pack(docs, mixing.n_words(docs["text"]))


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("substring dedup", chained_substring_dedup),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
