"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; what it returns is written as Parquet and read again as the next one's
docs. All but the last return the columns of ``documents``.

1. language: documents whose language can't be told go (null texts, texts
   without a letter, unsure predictions that differ from the given language); a
   null lang is filled, and one that a sure prediction contradicts is replaced.
   Without any lang no language is learnt, and all rows go.
2. quality_rules: documents that the base rules or the cutoffs chosen on
   ``labels`` reject go, each row by its own verdict; null and empty texts fail.
   Without labels, or with too few, the base rules alone decide.
3. near_dedup: one document of each group of near-duplicates (five-word
   shingles, similarity 0.8 or more) stays, that of the least id; of rows that
   repeat id and text one stays, and so does a null id's text, which links with
   nothing. Texts without words stay.
4. secrets: secrets in texts are masked, and n_chars follows; a null text stays
   null. No row goes.
5. packing: texts become token sequences of at most 1024 ids; each piece has
   its ids. A null or empty text is the single end id; repeated rows are packed
   each; a null id is carried as such.

An empty table goes through every stage as an empty table. Extra columns,
whatever their names, pass through the first four stages; the last ignores them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import language_id, near_dedup, packing, quality_rules, secret_scan
from cloakframe.llm.common import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.redact_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("secrets", secrets),
    ("packing", pack),
]

#: Models, hashes of shingles and token ids have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
