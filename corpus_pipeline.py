"""From raw documents to packed sequences: language, exact and near copies, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and
read again as the next one's ``docs``. All but the last give the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, langid, packing, simhash
from tidemark.llm.common import crc_mod, shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text or no letter) go. Learned from two thirds of the rows."""
    model = langid.fit(docs.filter(crc_mod("doc_id", 3) != 1), public_tokenizers.path("piece_bpe_32k.model"))
    return langid.drop_unknown(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in lower case) the document with the largest id stays."""
    return exact_dedup.drop_exact_duplicates(docs, keep="max")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts alike to 0.8 or more in their five-word shingles the document
    with the smallest id stays. A null text counts as empty; an empty table stays empty."""
    return simhash.drop_like_texts(docs, words=5, similarity=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences of at most 1024 tokens; an empty text is one
    piece of the end alone, a very long one is cut into pieces, an empty table gives none."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 1024, 2)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("best_fit_packing", pack),
]

#: Language, fingerprints and packing are not for SQL; tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
