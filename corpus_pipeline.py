"""The training-data pipeline: five stages, each a table in, a table out.

Quality rules reject documents and take out lines that too many share; of near
duplicates one document stays; secrets are redacted; sources are mixed towards
even weights, every document used at least once; what is left is tokenised and
packed. All stages but the last return the columns of ``documents``; the last
returns packed pieces with their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlake.llm import mixing, packing, quality, secrets, simhash
from burstlake.llm.common import saved, table
from burstlake.llm.queries import tokenizer_path

#: Entropy of the mix as a share of the greatest, and passes over a source at most.
MIX_ENTROPY, MIX_REPEATS = 0.9, 2.0


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, MIX_ENTROPY, MIX_REPEATS, budget=None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
    ("packing", pack),
]

#: Fingerprints and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
