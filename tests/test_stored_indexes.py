"""Stored indexes: titles, searched text, zones of the map."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions.geo import within_box, within_radius
from tidemark.operators import block
from tidemark.operators.title_index import TitleIndex
from tidemark.plans import search_index, zones
from tidemark.plans.search_index import SearchIndex, event_text, literal_parts

WORDS = ["red", "blue", "ring", "rings", "bolt", "gear", "night", "the", "großer", "x", "harbour", "market", "日本祭り", "choir"]


def titles_of(rng, n):
    return sorted({" ".join(rng.choices(WORDS, k=rng.randint(1, 5))) for _ in range(n)} | {"", "!!!"})


def files(df):
    """The files that are read: partitions are left out by the plan, before any is opened."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"PartitionFilters: \[\]", plan) and "PartitionFilters: [" in plan
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def frame(spark, titles):
    return spark.createDataFrame([(t,) for t in titles], "title string")


def test_probe_finds_what_all_against_all_finds(spark, tmp_path):
    """Titles listed at first and added later, probes that are listed and that are not."""
    rng = random.Random(3)
    titles = titles_of(rng, 70)
    first, later, probes = titles[::2], [*titles[1::4], *titles[:10:2]], [*titles[::3], "ring of the harbour", "unheard of", None]
    index = TitleIndex(spark, str(tmp_path), 16)
    index.build(frame(spark, first))
    index.add(frame(spark, later))
    index.add(frame(spark, later))
    listed = sorted({*first, *later})
    whole = block.similar_titles(frame(spark, sorted({*listed, *[p for p in probes if p is not None]})))
    wanted = {tuple(r) for r in whole.collect() if r.l_title in probes and r.r_title in listed}
    got = [tuple(r) for r in index.probe(frame(spark, probes)).collect()]
    assert set(got) == wanted and len(got) == len(wanted) > 100
    stored = spark.read.parquet(f"{tmp_path}/postings")
    assert stored.count() == stored.dropDuplicates(["g", "title"]).count()


def test_one_title_reads_few_files(spark, tmp_path):
    rng = random.Random(4)
    names = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(400)]
    index = TitleIndex(spark, str(tmp_path), 64)
    index.build(frame(spark, names))
    one = index._placed(block.title_features(frame(spark, [names[0]])))
    read = files(index._read("postings", index._buckets_of(one)))
    every = spark.read.parquet(f"{tmp_path}/postings").inputFiles()
    assert len(every) >= 60 and 1 <= len(read) <= 8
    assert {r.r_title for r in index.probe(frame(spark, [names[0]])).collect()} >= {names[0]}


def test_filter_of_places_loses_none(spark):
    rng = random.Random(5)
    titles = titles_of(rng, 60)
    feats = {r.title: set(r.words) for r in block.title_features(frame(spark, titles)).collect()}
    got = {(r.l_title, r.r_title) for r in block.similar_titles(frame(spark, titles)).collect()}
    for a in titles:
        for b in titles:
            x, y = feats[a], feats[b]
            if x | y and 10 * len(x & y) >= 3 * len(x | y):
                assert (a, b) in got


# --- search
TEXTS = ["Harbour lights concert", "100% jazz", "jazz_night", "The ΟΔΟΣ walk", "Ärger im Hafen", "ab", None, "back\\slash", "harbour", "HARBOR LIGHT", "Straße İstanbul"]


@pytest.fixture(scope="module")
def searched(spark, tmp_path_factory):
    events = spark.createDataFrame([(str(i), t, None, "about " * (i % 3), None) for i, t in enumerate(TEXTS * 3)], "id string, title string, title_zh string, summary string, summary_zh string")
    index = SearchIndex(spark, str(tmp_path_factory.mktemp("index")), 16)
    index.build(events.filter("id < 20"))
    index.add(events.filter("id >= 20"))
    return events, index


@pytest.mark.parametrize("q", ["harbour", "HARB", "jazz", "z%n", "100% j", "jazz_n", "ab", "%", "__", "ΟΔΟΣ", "οδο", "ärger", "lights%about", "back\\\\slash", "none of it", "straße", "İstan"])
def test_search_by_index(searched, q):
    events, index = searched
    wanted = sorted(r.id for r in events.filter(event_text().ilike(f"%{q}%")).collect())
    assert sorted(r.id for r in index.search(events, q).collect()) == wanted


def test_candidates_are_few(searched):
    events, index = searched
    assert index.candidates("concert").count() == 3 and index.candidates("zz") is None
    assert literal_parts("a%bc_d\\%e") == ["a", "bc", "d%e"] and literal_parts("%_") == []


def test_a_gram_of_all_texts_is_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "SHARE", 100)
    none = F.lit(None).cast("string")
    events = spark.range(100).select(F.col("id").cast("string").alias("id"), F.lit("same").alias("title"), none.alias("title_zh"), none.alias("summary"), none.alias("summary_zh"))
    index = SearchIndex(spark, str(tmp_path), 2)
    index.build(events)
    held = spark.read.parquet(f"{tmp_path}/grams").filter("g = 'sam'").groupBy(F.input_file_name()).count().collect()
    assert len(held) > 2 and sum(r["count"] for r in held) == 100
    assert index.search(events, "SAME").count() == 100


# --- zones
@pytest.fixture(scope="module")
def zoned(spark, tmp_path_factory):
    rng = random.Random(6)
    points = [(rng.uniform(-47, -34), rng.uniform(166, 179)) for _ in range(400)] + [(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0), (float("nan"), 1.0)]
    rows = [(str(i), p, i) for i, p in enumerate(points)] + [("none", None, 1)]
    events = spark.createDataFrame(rows, "id string, point struct<lat:double,lng:double>, n int").withColumn("starts_at", F.timestamp_seconds("n"))
    path = str(tmp_path_factory.mktemp("zones"))
    zones.write(events, path)
    return events, path


def test_a_box_reads_its_zones(spark, zoned):
    events, path = zoned
    every = set(spark.read.parquet(path).inputFiles())
    rng = random.Random(7)
    for k in range(6):
        west, south = rng.uniform(166, 178), rng.uniform(-47, -36)
        box = (west, south, west + rng.uniform(0, 2), south + rng.uniform(0, 2))
        inside = within_box(F.col("point.lat"), F.col("point.lng"), box)
        held = zones.read(spark, path, box)
        assert sorted(r.id for r in held.filter(inside).collect()) == sorted(r.id for r in events.filter(inside).collect())
        assert len(files(held)) < len(every) // 4 and held.columns == events.columns
    assert zones.read(spark, path).count() == events.count()


@pytest.mark.parametrize("centre,km", [((-36.8509, 174.7645), 45.0), ((-45.0312, 168.6626), 40.0), ((-41.0, 172.0), 300.0), ((89.9, 0.0), 30.0)])
def test_a_radius_reads_the_box_around(spark, zoned, centre, km):
    events, path = zoned
    near = within_radius(F.col("point.lat"), F.col("point.lng"), centre, km)
    held = zones.read(spark, path, zones.box_around(centre, km))
    assert sorted(r.id for r in held.filter(near).collect()) == sorted(r.id for r in events.filter(near).collect())


def test_ranges_hold_the_cells_of_the_box():
    bits = 4
    spread = lambda v: int("".join(f"0{c}" for c in f"{v:04b}"), 2)
    rng = random.Random(8)
    for most in (4, 16, 1000):
        for _ in range(40):
            a, b = sorted(rng.uniform(-180, 180) for _ in "ab"), sorted(rng.uniform(-90, 90) for _ in "ab")
            found = zones.ranges((a[0], b[0], a[1], b[1]), bits, most)
            cells = {spread(x) | spread(y) << 1 for x in range(int((a[0] + 180) / 22.5), int((a[1] + 180) / 22.5) + 1) for y in range(int((b[0] + 90) / 11.25), int((b[1] + 90) / 11.25) + 1)}
            held = {z for lo, hi in found for z in range(lo, hi + 1)}
            assert cells <= held and (most < 1000 or cells == held) and len(found) <= most
    assert zones.ranges((10.0, 0.0, -10.0, 1.0)) == []
    assert re.match("-1$", str(zones.NOWHERE))
