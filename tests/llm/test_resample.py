import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text):
    return WORD.findall((text or "").translate(str.maketrans(UPPER, UPPER.lower())))


def features(text):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def brute(docs, target):
    """The contract's words, one by one."""
    s, t = (Counter(bucket(f) for x in texts for f in features(x)) for texts in ([d[1] for d in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        found = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = [r for r, d in zip(rows, docs) if len(words(d[1])) >= 20]
    able.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for place, row in enumerate(able[: 5 * len(able) // 100], 1):
        row[4] = place
    return sorted(map(tuple, rows), key=repr)


def plain(found):
    return sorted((tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab AB-é9\x00日", max_size=30), max_size=12), st.sampled_from([1, 2, 3, 5]))
def test_runs_have_the_buckets_of_their_words(texts, most):
    """Counts by runs of equal suffixes are those of all n-grams as text."""
    part = resample.Slice([t.encode() for t in texts], most)
    for k, found in enumerate(part.buckets(), 1):
        wanted = [[bucket(" ".join(w[i : i + k])) if i + k <= len(w) else -1 for i in range(len(w))] for w in map(words, texts)]
        assert found.tolist() == [b for row in wanted for b in row]


def test_common_prefixes():
    part = resample.Slice([b"a b a b c", b"a b", b"a b a"])
    order, common = part.suffixes()
    text = [w for t in ("a b a b c", "a b", "a b a") for w in t.split()]
    ends = [5] * 5 + [7] * 2 + [10] * 3
    suffix = [text[i : min(ends[i], i + 3)] for i in range(10)]
    for k in range(1, 10):
        a, b = suffix[order[k - 1]], suffix[order[k]]
        assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_many_words_need_more_than_one_key():
    """2^22 distinct words: three of them no longer fit into one 64-bit key."""
    part = resample.Slice([b"x y z x y z"], 3)
    columns = [np.array([2, 1, 2, 1]), np.array([1, 2, 1, 1]), np.array([0, 1, 3, 0])]
    part.crc = np.zeros(1 << 22, np.uint32)
    assert part._sorted(columns).tolist() == [3, 1, 0, 2]


def test_crc_of_appended_bytes():
    table = resample._zeros_table(5)
    for a, b in ((b"", b" word"), (b"some text", b" next"), (b"\xff" * 100, b"12345")):
        crc = zlib.crc32(a)
        shifted = zlib.crc32(b)
        for k in range(4):
            shifted ^= int(table[k, crc >> (8 * k) & 0xFF])
        assert shifted == zlib.crc32(a + b)


def test_as_word_by_word(spark, some_docs):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = [(r.doc_id, r.text) for r in some_docs.select("doc_id", "text").collect()]
    wanted = brute(docs, [r.text for r in target.collect()])
    assert plain(resample.resample(some_docs, target)) == wanted
    assert sum(r[4] is not None for r in wanted) == 5 * sum(len(words(t)) >= 20 for _, t in docs) // 100 > 0


def test_odd_texts(spark, odd_docs, no_docs):
    target = spark.createDataFrame([(1, "one two three"), (2, None), (3, "")], "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert plain(resample.resample(odd_docs, target)) == brute(docs, ["one two three"])
    assert plain(resample.resample(odd_docs, target.limit(0))) == brute(docs, [])
    assert resample.resample(no_docs, target).collect() == []


def test_ties_and_many_ranges(spark):
    """One text in a third of the rows, ids in any order, more ranges than rows in some."""
    rows = [(i, "the same words again and again " * 6 if i % 3 == 0 else f"word{i} other{i % 7} " * 15) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([(1, "again and again")], "item_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        found = plain(resample.resample(docs, target))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert found == brute(rows, ["again and again"])


@pytest.mark.parametrize("parts", [1, 3])
def test_rank_of_equal_scores(spark, parts):
    rows = [(i, 5 if i % 2 else 7, i % 5 > 0) for i in range(100)]
    scored = spark.createDataFrame(rows, "doc_id long, score long, eligible boolean").repartition(parts)
    able = sorted((r for r in rows if r[2]), key=lambda r: (-r[1], r[0]))
    found = {r.doc_id: r.rank for r in resample.ranked(scored, 60).collect()}
    assert found == {i: None for i in range(100)} | {r[0]: k for k, r in enumerate(able[:60], 1)}


def test_very_long_texts(spark):
    docs = [(1, "word other 9 " * 400_000), (2, "x" * 1_000_000), (3, "a b c " * 10)]
    target = spark.createDataFrame([(1, "word other")], "item_id long, text string")
    assert plain(resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), target)) == brute(docs, ["word other"])


def test_drawn_rows(spark, some_docs):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    ranks = {r.doc_id for r in resample.resample(some_docs, target).filter("rank IS NOT NULL").collect()}
    found = resample.selected(some_docs, target)
    assert found.columns == some_docs.columns and {r.doc_id for r in found.collect()} == ranks
