"""URL filters: rules on host and path, and for all other URLs boosted trees on lexical features.

Everything is columns, aggregates and Spark ML; no Python runs on the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .common import ascii_lower

#: (verdict, host/path)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: The trees are fitted on about this many distinct labelled URLs, or all if there are fewer.
SAMPLE = 20_000
#: A suffix has statistics of its own if it has at least one in so many URLs; so there are at most as many.
COMMON = 500
#: Labelled URLs that a suffix's share of blocked ones is drawn to the overall share by.
PRIOR = 20.0
FEATURES = ("length", "host_length", "host_labels", "depth", "digit_ratio", "symbol_ratio", "entropy", "parameters", "hyphens", "suffix_share", "suffix_blocked")
TREES, DEPTH = 12, 3


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule whose host is the URL's or one above it and whose path the URL's starts
    with; null if none fits. A list of rules is part of the plan, so it should stay short."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def verdict_of(rule: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    found = F.lit(None).cast("string")
    for verdict, text in rules:
        found = F.when(rule == text, F.lit(verdict)).otherwise(found)
    return found


def entropy_of(text: Column) -> Column:
    """Bits a character; a character's number is what its removal takes away. All characters
    beyond printable ASCII count as one."""
    n = F.length(text)
    ascii_ = F.array(*[F.lit(chr(c)) for c in range(33, 127)])
    counts = F.transform(ascii_, lambda c: n - F.length(F.replace(text, c, F.lit(""))))
    rest = n - F.aggregate(counts, F.lit(0), lambda a, c: a + c)
    share = lambda c: c.cast("double") / n
    bits = F.aggregate(F.concat(counts, F.array(rest)), F.lit(0.0), lambda a, c: F.when(c > 0, a - share(c) * F.log2(share(c))).otherwise(a))
    return F.when(n > 0, bits).otherwise(0.0)


def suffix_of(host: Column) -> Column:
    """The last label of the host."""
    return F.substring_index(host, ".", -1)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features that a URL has by itself; a null URL counts as empty."""
    url = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    without = lambda pattern: F.length(url) - F.length(F.regexp_replace(url, pattern, ""))
    of_host = lambda c: F.length(host) - F.length(F.replace(host, F.lit(c), F.lit("")))
    columns = {
        "length": F.length(url), "host_length": F.length(host), "host_labels": of_host(".") + 1, "depth": F.regexp_count(path, F.lit("[^/]+")),
        "digit_ratio": without("[0-9]") / n, "symbol_ratio": without("[^0-9A-Za-z]") / n, "entropy": entropy_of(url),
        "parameters": F.regexp_count(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("[^&]+")), "hyphens": of_host("-"),
    }
    return {name: F.coalesce(c, F.lit(0)).cast("double") for name, c in columns.items()}


@dataclass
class Model:
    """Trees and the statistics of common suffixes; without trees one share holds for all."""

    trees: GBTClassificationModel | None
    suffixes: DataFrame
    other: tuple[float, float]
    blocked: float


def with_features(urls: DataFrame, suffixes: DataFrame, other: tuple[float, float]) -> DataFrame:
    """``urls`` (url, host, path, ...) with FEATURES as ``features``. Suffixes without statistics of
    their own share one pair; at most COMMON rows are broadcast."""
    known = urls.join(F.broadcast(suffixes), suffix_of(F.col("host")) == F.col("suffix"), "left").drop("suffix")
    known = known.fillna(dict(zip(FEATURES[-2:], other)))
    known = known.withColumns(lexical(F.col("url"), F.col("host"), F.col("path")))
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(known).drop(*FEATURES)


def fit(urls: DataFrame, sample: int = SAMPLE, common: int = COMMON) -> Model:
    """From ``urls`` (url, host, path, label block | allow or null): statistics of the suffixes of
    all rows, and trees from about ``sample`` distinct labelled URLs, each weighted by its rows.
    Which URLs are in the sample depends on their hashes alone. With no labelled URL nothing is
    blocked, with one label that one holds for all."""
    labelled = F.col("label").isNotNull().cast("long")
    bad = (F.col("label") == "block").cast("long")
    counts = urls.groupBy(suffix_of(F.col("host")).alias("suffix")).agg(F.count("*").alias("n"), F.sum(labelled).alias("labelled"), F.coalesce(F.sum(bad), F.lit(0)).alias("bad"))
    counts = materialise(counts, "url-suffixes")
    totals = counts.agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).first()
    rows, known, blocked = (totals.n or 0), (totals.labelled or 0), (totals.bad or 0) / max(totals.labelled or 0, 1)
    share = (F.col("bad") + PRIOR * blocked) / (F.col("labelled") + PRIOR)
    often = counts.filter(F.col("n") * common >= rows)
    suffixes = often.select("suffix", (F.col("n") / max(rows, 1)).alias("suffix_share"), share.alias("suffix_blocked"))
    other = (0.0, blocked)
    if blocked in (0.0, 1.0):
        return Model(None, suffixes, other, blocked)
    distinct = urls.filter("label IS NOT NULL").groupBy("url", "host", "path", "label").agg(F.count("*").cast("double").alias("weight"))
    chosen = distinct.filter(F.pmod(F.xxhash64("url"), F.lit(known)) < sample) if known > sample else distinct
    given = materialise(with_features(chosen, suffixes, other).withColumn("target", (F.col("label") == "block").cast("double")).repartition(4, F.xxhash64("url")).sortWithinPartitions("url"), "url-sample")
    if given.select("target").distinct().count() < 2:
        return Model(None, suffixes, other, blocked)
    trees = GBTClassifier(featuresCol="features", labelCol="target", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, cacheNodeIds=False, checkpointInterval=-1)
    return Model(trees.fit(given), suffixes, other, blocked)


def scored(urls: DataFrame, model: Model) -> DataFrame:
    """``urls`` (url, host, path, ...) with ``score``, the probability that the URL is to be blocked."""
    if model.trees is None:
        return urls.withColumn("score", F.lit(model.blocked))
    found = model.trees.transform(with_features(urls, model.suffixes, model.other))
    return found.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def _judged(pages: DataFrame, row: Column, rules: Sequence[tuple[str, str]], sample: int, url_col: str) -> DataFrame:
    """(row, url, host, path, rule, label, score, verdict)"""
    url = F.col(url_col)
    given = pages.select(row.alias("row"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    given = given.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    given = given.withColumn("label", verdict_of(F.col("rule"), rules))
    found = scored(given, fit(given.select("url", "host", "path", "label"), sample))
    return found.withColumn("verdict", F.coalesce("label", F.when(F.col("score") >= 0.5, "block").otherwise("allow")))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, sample: int = SAMPLE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict allow | block, score) for each row.

    A rule's verdict holds where one fits. The URLs that rules judge are the labelled ones that
    the trees learn from, and these judge the rest: block from a score of 0.5 on. A null URL or
    one without ``://`` has an empty host and path, no rule, and is scored as it is. Repeated
    rows give equal rows, an empty table an empty one; a very long URL is read whole. No other
    column is read, so they may have any name.
    """
    found = _judged(pages, F.col(id_col), rules, sample, url_col)
    return found.select(F.col("row").alias("page_id"), "host", "path", "rule", "verdict", "score")


def drop_blocked(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, sample: int = SAMPLE, url_col: str = "url") -> DataFrame:
    """The rows of ``pages`` whose URLs are not blocked, all columns; nulls, repeats and empty
    tables as in ``judge``."""
    return _judged(pages, F.struct("*"), rules, sample, url_col).filter("verdict = 'allow'").select("row.*")
