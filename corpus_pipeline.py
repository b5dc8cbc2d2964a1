"""Training corpus pipeline: from documents to packed sequences.

Stages, each over all that its predecessor kept: documents without a
recognised language go; boilerplate lines of many sites stay once; one
document of each group of near-duplicates stays; benchmark passages are cut
out; what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hayrake.llm import decontam, langid, linededup, neardup, packing
from hayrake.session import materialise, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accept(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.remove_boilerplate(docs, "source", drop_emptied=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("best-fit packing", pack)]

#: Neither sketches nor the tokenizer can be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = materialise(docs, "stage")
    return docs
