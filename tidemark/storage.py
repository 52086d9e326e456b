"""Written tables in the folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL = threading.local()


def _scopes() -> list[list[str]]:
    """The open scopes of ``intermediates`` of this thread."""
    if not hasattr(_LOCAL, "scopes"):
        _LOCAL.scopes = []
    return _LOCAL.scopes


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a temporary folder is taken if
    the master is this process (tests); elsewhere other machines would not see it, so it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialise(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: it cuts the lineage,
    survives a lost executor, and is computed once however often it is used."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    if _scopes():
        _scopes()[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, label: str) -> DataFrame:
    """Like ``materialise``, inside a scope of ``intermediates`` for what outlives it: it belongs to
    the scope around."""
    inner = _scopes().pop() if _scopes() else None
    try:
        return materialise(df, label)
    finally:
        if inner is not None:
            _scopes().append(inner)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Around work that leaves nothing to be computed later: tables written inside are deleted
    at its end."""
    _scopes().append([])
    try:
        yield
    finally:
        remove(spark, _scopes().pop())


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
