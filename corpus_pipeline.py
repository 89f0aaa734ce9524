"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

1. documents whose language is not found go;
2. of each group of near copies (SimHash by tiles over five-word shingles, then a Jaccard similarity of 0.8 or more)
   the document with the smallest id stays;
3. words covered by a 20-word run that occurs earlier are taken out;
4. documents that hold a benchmark passage go;
5. what is left is encoded and packed into windows of at most 4096 tokens.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontamination, language_id, near_dedup, packing, substring_dedup
from tessella.llm.common import materialise
from tessella.llm.queries import tokenizer


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def cut_repeated_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_runs),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL cannot express the first stage (a trained classifier), the second and the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
