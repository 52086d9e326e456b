"""The numbered queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, digest, exact_dedup, fill_middle, html_extract, langid, license_scan, lm_score, packing, resample, simhash, token_output, url_filter
from .common import read


def _tokenizers():
    import public_tokenizers

    return public_tokenizers


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), words=3, max_bits=2)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.train_and_score(read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"), _tokenizers().path("piece_bpe_32k.model"))


def op5_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.edit_digests(read(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    public = _tokenizers()
    return bpe.encode_digests(read(spark, sf_dir, "documents"), public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    public = _tokenizers()
    return packing.pack(read(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.PATTERN, 1024, 2)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    public = _tokenizers()
    return token_output.shard_digests(read(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.PATTERN)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"), keep="max")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.round_trips(read(spark, sf_dir, "documents"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_license_scan, op3_lm_score, op4_language_id, op5_digest, op6_bpe, op7_packing, op8_token_output, op9_exact_dedup, op10_html_text, op11_fill_middle, op12_resample, op13_url_filter)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op11_fill_middle": fill_middle.oracle_sql(),
    "op12_resample": resample.oracle_sql(),
    "op2_license_scan": license_scan.oracle_sql(),
    "op9_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)
    """,
}
