"""A corpus pipeline of five stages; each reads what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weft.llm import chunks, decontam, packing, queries, simhash, toxicity
from weft.llm.common import delete_path, read_table, table_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is scored as toxic go, row by row; a null or empty text is clean."""
    return toxicity.keep_clean(docs, queries.toxic_model(docs, read_table(spark, sf_dir, "labels")))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, linked by SimHash, stays, the one with the smallest id. Rows that share an id are told apart by
    their texts, rows that repeat both are copies; all empty and null texts are copies of one another."""
    return simhash.keep_first(docs).select(docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document, or place, holds are cut out; every row stays."""
    return chunks.apply(docs).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds enough of benchmark items go; rows of one id are told apart by their texts. An empty
    benchmark, a null or an empty text contaminates nothing."""
    return decontam.keep_clean(docs, read_table(spark, sf_dir, "benchmark"), size=13, percent=5).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 2048 tokens; a null or empty text is one end id."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), True, 1, 2048), 2048)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("substrings", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: No stage can be written as SQL; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's documents. Columns of documents
    beside the id and the text come through the stages before packing as they are, whatever their names; an empty table
    gives no rows. A stage's table is deleted once the next one is written; the last one stays for the result."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = table_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                delete_path(spark, before)
            before = path
    return docs
