import re
import unicodedata
from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import coerce, geo, localtime, text


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in rows], schema).select(column).collect()]


def test_fingerprint_ignores_noise_order_and_brackets(spark):
    rows = ["Reef9 Live in Concert — Nelson", "Nelson: REEF9 (concert)", "!!!", None, "[sold out] Ōtaki"]
    assert values(spark, text.title_fingerprint(F.col("x")), rows) == ["nelson reef9", "nelson reef9", "", None, "otaki"]


def test_cjk_runs_become_bigrams(spark):
    assert values(spark, text.title_tokens(F.col("x")), ["陶波市集", "集", "がぎ ok"]) == [["陶波", "波市", "市集"], ["集"], ["か", "き", "ok"]]


def test_deaccent_is_canonical_decomposition_without_marks(spark):
    rows = ["Dvořák", "Taupō", "straße", "ữ", "ぱが", "plain", "ÅÉÎõü", "", "x́"]
    plain = ["".join(c for c in unicodedata.normalize("NFD", x) if not "̀" <= c <= "ͯ") for x in rows]
    assert values(spark, text.deaccent(F.col("x")), rows) == plain


def test_hangul_falls_apart_like_all_else(spark):
    """All 11,172 syllables, alone and among others."""
    rows = [chr(c) for c in range(0xAC00, 0xD7A4)] + ["한국 Café ぱ", "각x간", "日本 뷁", "🎉힣"]
    plain = ["".join(c for c in unicodedata.normalize("NFD", x) if not "̀" <= c <= "ͯ") for x in rows]
    assert values(spark, text.deaccent(F.col("x")), rows) == plain


def test_labels_of_slugs(spark):
    from tidemark.dimensions import CATEGORY_LABELS, CITY_LABELS

    assert values(spark, text.label(F.col("x"), CITY_LABELS), ["taupo", "hokitika", None]) == ["Taupō", "hokitika", None]
    assert values(spark, text.label(F.col("x"), CATEGORY_LABELS, "zh"), ["food"]) == ["美食"]
    df = spark.createDataFrame([("Old walk", "老街"), ("Old walk", None)], "a string, b string")
    assert [r[0] for r in df.select(text.localized(F.col("a"), F.col("b"), "zh")).collect()] == ["老街", "Old walk"]
    assert values(spark, localtime.iso_millis(F.col("x").cast("timestamp")), ["2026-03-14 06:30:00.5"]) == ["2026-03-14T06:30:00.500Z"]


def test_similarities_of_known_pairs(spark):
    rows = [("Lantern parade", "Lantern parade (free entry)"), ("Old harbour walk", "The harbour walk"), ("Lantern parade", "Pottery class"), ("!!!", "???"), ("", "x")]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select(text.jaccard(text.title_tokens(a), text.title_tokens(b)), text.dice(text.title_grams(a), text.title_grams(b)), text.trigram_similarity(text.word_trigrams(a), text.word_trigrams(b))).collect()
    assert [round(r[0], 6) for r in got] == [1.0, round(2 / 3, 6), 0, 0, 0]  # harbour and walk of old, harbour, walk

    def grams(x):
        x = f"  {' '.join(re.sub('[^a-z]+', ' ', x.lower()).split())} "
        return {x[i : i + 3] for i in range(len(x) - 2)}

    def by_word(x):
        return {f"  {w} "[i : i + 3] for w in re.sub("[^a-z]+", " ", x.lower()).split() for i in range(len(w) + 1)}

    dice = [2 * len(grams(x) & grams(y)) / (len(grams(x)) + len(grams(y))) for x, y in rows]
    assert [r[1] for r in got] == pytest.approx(dice)
    union = [(by_word(x) & by_word(y), by_word(x) | by_word(y)) for x, y in rows[:3]]
    assert [r[2] for r in got[:3]] == pytest.approx([len(i) / len(u) for i, u in union])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=12), st.text(max_size=12)), min_size=1, max_size=8))
def test_title_similarity_is_symmetric_and_bounded(spark, pairs):
    df = spark.createDataFrame([tuple(x.encode("utf-8", "ignore").decode() for x in p) for p in pairs], "a string, b string")
    a, b = F.col("a"), F.col("b")
    f = lambda p, q: text.title_similarity(text.title_tokens(p), text.title_tokens(q), text.title_grams(p), text.title_grams(q))
    for x, y in df.select(f(a, b), f(b, a)).collect():
        assert x == y and 0 <= x <= 1


def test_single_precision_gate(spark):
    assert values(spark, (F.lit(3) / F.lit(10)).cast("float").cast("double") > 0.3, ["x"]) == [True]


def test_venue_key(spark):
    assert values(spark, text.venue_key(F.col("x")), ["The Powerstation", "Powerstation", " the café!"]) == ["powerstation", "powerstation", "the cafe"]


@pytest.mark.parametrize(
    "signals,slug", [(("Surf lesson", None), "water"), (("House party", ""), "arts"), (("OnlineEventAttendanceMode", None), "arts"), ((None, ""), "other"), (("Jazz night", None), "music")]
)
def test_categories(spark, signals, slug):
    assert spark.createDataFrame([signals], "a string, b string").select(text.infer_category(F.col("a"), F.col("b"))).first()[0] == slug


def test_small_text_helpers(spark):
    assert values(spark, text.content_hash(F.col("x")), [None]) == ["74234e98afe7498fb5daf1f36ac2d78a"]
    assert values(spark, text.summary_text(F.col("x"), tags=True), ["<p>a\n b</p>", "  ", "x" * 700]) == ["a b", None, "x" * 600]
    assert values(spark, text.host_slug(F.col("x")), ["https://www.venue.example.nz/a", "nonsense"]) == ["venue", None]
    assert values(spark, text.join_present(", ", F.col("x"), F.lit("b")), ["a", "", None]) == ["a, b", "b", "b"]
    assert values(spark, text.search_text(F.col("x"), F.lit(None), F.lit("z")), ["a"]) == ["a  z"]


def test_numbers_of_payloads(spark):
    assert values(spark, coerce.number(F.col("x")), ["25.00", "", " ", "x", None, "Infinity", "1e3"]) == [25.0, 0.0, 0.0, None, None, None, 1000.0]
    assert values(spark, coerce.truthy(F.col("x")), ["true", "1", "0", "false", None, "yes"]) == [True, True, False, False, False, False]


def test_distances(spark):
    point = [F.lit(x) for x in (-36.8476, 174.7842, -36.8748, 174.7449)]
    assert values(spark, F.round(geo.haversine_m(*point), 4), ["x"]) == [4623.0066]
    rows = [(0.0,), (150.0,), (325.0,), (500.0,), (None,)]
    assert values(spark, geo.decay(F.col("x"), 150, 500), rows, "x double") == [1, 1, 0.5, 0, None]


def test_nearest_city(spark):
    rows = [(-36.85, 174.76), (-45.03, 168.66), (-30.0, 170.0), (None, 1.0)]
    got = spark.createDataFrame(rows, "a double, b double").select(geo.nearest_city(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == ["auckland", "queenstown", None, None]


def utc(*x):
    return datetime(*x, tzinfo=timezone.utc)


SUMMER, WINTER, SATURDAY = utc(2026, 1, 15, 2), utc(2026, 7, 15, 2), utc(2026, 1, 17, 5)


def test_offsets_and_midnights(spark):
    got = spark.createDataFrame([(SUMMER,), (WINTER,)], "x timestamp").select(
        localtime.offset_hours(F.col("x")), localtime.local_weekday(F.col("x")), localtime.start_of_day(F.col("x"))
    ).collect()
    assert [(r[0], r[1]) for r in got] == [(13, 4), (12, 3)]
    assert got[1][2] == datetime(2026, 7, 14, 12)


@pytest.mark.parametrize("bucket,now,bounds", [
    ("today", SUMMER, (SUMMER, utc(2026, 1, 15, 11))), ("tomorrow", SUMMER, (utc(2026, 1, 15, 11), utc(2026, 1, 16, 11))),
    ("weekend", SUMMER, (utc(2026, 1, 16, 11), utc(2026, 1, 18, 11))), ("weekend", SATURDAY, (SATURDAY, utc(2026, 1, 18, 11))),
    ("weekend", utc(2026, 1, 18, 5), (utc(2026, 1, 18, 5), utc(2026, 1, 18, 11))), ("week", SUMMER, (SUMMER, utc(2026, 1, 22, 11))), ("all", SUMMER, (SUMMER, None)),
])
def test_buckets(spark, bucket, now, bounds):
    assert localtime.bucket_range(bucket, now) == bounds
    low, high = localtime.bucket_bounds(bucket, F.col("x"))
    row = spark.createDataFrame([(now,)], "x timestamp").select(low, high).first()
    assert tuple(x and x.replace(tzinfo=timezone.utc) for x in row) == bounds


def test_parse_local(spark):
    rows = ["2026-03-14 19:30:00", "2026-03-14T19:30:00+13:00", "2026-03-14", "2026-04-05 02:30", "2026-09-27 02:30", "2026-03-14T06:30:00Z", "2026-03-14T19:30:00+1300", "rubbish", "", None]
    got = values(spark, F.date_format(localtime.parse_local(F.col("x")), "yyyy-MM-dd HH:mm"), rows)
    half = "2026-03-14 06:30"
    assert got == [half, half, "2026-03-13 11:00", "2026-04-04 14:30", "2026-09-26 14:30", half, half, None, None, None]


def test_labels(spark):
    rows = [(SUMMER,), (utc(2026, 1, 16, 2),), (utc(2026, 1, 17, 6),)]
    df = spark.createDataFrame(rows, "x timestamp")
    now = F.lit(SUMMER)
    assert [r[0] for r in df.select(localtime.when_label(F.col("x"), now)).collect()] == ["Today 15:00", "Tomorrow 15:00", "Sat, 17 Jan 19:00"]
    assert [r[0] for r in df.select(localtime.when_label(F.col("x"), now, "zh")).collect()][2] == "1月17日周六 19:00"
