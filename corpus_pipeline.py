"""The corpus pipeline: language ID, exact dedup, near-dedup (SimHash and MinHash candidates, exact similarity), mixing, BPE.

STAGES names its steps. Each takes (spark, docs, sf_dir) and returns a DataFrame; all
but the last return the columns of docs. run() applies them to documents,
writing what each returns to the shared folder and reading it again.
In all stages a row is told by its id and its text, null ids come behind all others, an empty table gives no rows, texts of
any length are read whole, and extra columns are passed on, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemline.llm import bpe, exact_dedup, langid, mixing, near_dedup
from stemline.llm.common import shared_folder, unused


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a language can be told, the told one put in where lang is null.

    Texts that are null or without a letter go, and all do where no row is labelled. A given lang is kept, right or wrong; repeated
    rows are each kept; of equally likely languages the most frequent one is told.
    """
    name, kind = unused(docs, "told"), docs.schema["lang"].dataType
    told = langid.annotate(docs, langid.fit(docs), lang_as=name, score_as=unused(docs, "told_score")).where(F.col(name) != langid.UNDETERMINED)
    return told.select(*[F.coalesce("lang", F.col(name).cast(kind)).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null ones are empty) one row with the smallest id, of equal rows one; another text of the same id stays."""
    return exact_dedup.distinct_texts(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 or more of their five-word shingles, one row with the smallest id; texts without words are copies of each other."""
    return near_dedup.near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the epochs of its leaf take it; null languages and sources are names of their own, rows that repeat an id go together."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and what they decode to, as digests; null texts count as empty."""
    return bpe.bpe_digest(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither the language model nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
