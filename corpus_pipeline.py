"""Training-data pipeline over `documents`: STAGES in order, each over all that the one before kept.

1. quality rules       drops documents that the adaptive thresholds (or the base rules) reject
2. near duplicates     of each group of alike documents (five-word shingles, Jaccard 0.8 or more) the smallest id stays
3. decontamination     drops documents that hold a passage of `benchmark`
4. mixing              repeats or leaves out documents so that sources come near their target weights
5. token ids           writes the shards of the mix and returns where each document stands in them

All but the last return the columns of documents; run() writes each stage's rows as Parquet in the shared folder and reads
them again for the next. SQL can't express stages 2 and 5, so there is no ORACLE_SQL; tests hold run() against a brute-force
version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import decontamination, mixing, near_dups, quality_rules, tokens
from marketloom.llm.common import documents, stored

SHINGLE = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.one_of_each(docs, SHINGLE)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, documents(spark, sf_dir, "benchmark").select("item_id", "text"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.written(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token ids", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir).select(F.col("doc_id"), "start", "n_tokens", "ids_crc32")
