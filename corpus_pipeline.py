"""Corpus preparation: toxicity, language identification, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and read again before the
next stage. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgermark.llm import lang_id, mixing, near_dedup, packing, toxicity
from ledgermark.llm._spark import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at the toxicity threshold or above go. Null, empty and wordless texts score 0 and stay; rows
    that repeat go or stay together; without documents or labels nothing goes."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or without a language that is likelier than not, go. Rows that
    repeat go or stay together; if no document has a language, there is none to find and all go; an empty table stays empty."""
    return lang_id.keep_identified(docs, lang_id.learn(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 over five-word shingles the smallest doc_id stays, once.
    Texts without words are alone and stay; an empty table stays empty."""
    return near_dedup.drop_copies(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights holds them, 0 to 2 times. Texts without words are not taken; a null
    source is a source of its own; an empty table stays empty."""
    return mixing.draw(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in full windows. A null or empty text is its separator alone; copies that the mix
    drew are packed as documents like others; an empty table has no pieces."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("language_id", drop_unidentified), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]

#: The stages train models, solve for rates and run a tokenizer: not expressible in SQL (tested against brute force).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
