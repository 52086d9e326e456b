"""Exact deduplication by content hash, with the bytes compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, text_of, unused


def _hash128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_duplicates(
    docs: DataFrame,
    keep: str = "min",
    id_col: str = "doc_id",
    text_col: str = "text",
    hash128: Callable[[Column], Column] = _hash128,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal
    texts the row with the smallest (``keep="min"``) or largest (``"max"``) id stays. Rows
    that repeat both id and text count in group_size and have the same ``kept``; a null id
    stays only if its whole group has no id (keep_id is null then). An empty table gives an
    empty one.

    Rows are grouped by (128-bit hash, text), which compares the bytes of what shares a
    hash. Copies are summed up before the shuffle, so a large group reaches a task as one
    row for each map task. What goes back to the rows is keyed by the hash alone; texts of
    a hash that has several texts are joined by their bytes instead.
    """
    best = {"min": F.min, "max": F.max}[keep]
    norm = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(text_of(text_col)).alias("norm"))
    keyed = norm.select("doc_id", "norm", hash128(F.col("norm")).alias("h"))
    groups = keyed.groupBy("h", "norm").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    per_hash = materialise(
        groups.groupBy("h").agg(
            F.count("*").alias("texts"), best("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
        ),
        "exact-groups",
    )
    out = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    rows = keyed.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256"))
    result = rows.join(per_hash.filter("texts = 1").drop("texts"), "h").select(*out)
    clash = per_hash.filter("texts > 1").select("h")
    if not clash.isEmpty():
        apart = keyed.join(clash, "h", "left_semi")
        result = result.union(
            apart.join(groups, ["h", "norm"]).withColumn("text_sha256", F.sha2("norm", 256)).select(*out)
        )
    return result


def drop_exact_duplicates(
    docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that stay, all columns. Of rows that repeat id and text one
    stays (any: they differ at most in other columns); so does one of a group without ids."""
    sha, kept_id, kept_sha, rows = (unused(docs, x) for x in ("sha", "kept_id", "kept_sha", "kept_rows"))
    kept = materialise(
        exact_duplicates(docs, keep, id_col, text_col)
        .filter("kept")
        .groupBy(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha))
        .agg(F.count("*").alias(rows)),
        "exact-kept",
    )
    keyed = docs.withColumn(sha, F.sha2(ascii_lower(text_of(text_col)), 256))
    same = F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(sha) == F.col(kept_sha))
    found = keyed.join(kept, same, "left_semi")
    if not kept.filter(F.col(rows) > 1).isEmpty():
        found = found.dropDuplicates([id_col, sha])
    return found.drop(sha)
