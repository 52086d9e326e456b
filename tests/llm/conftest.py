import pytest

LICENSE = "This is under the MIT License."
TEXTS = [
    None, "", " \n\t", "one", "one two", "ONE two", "Ünïcode Ärger straße", "123 !!! ---", "a" * 3000, "x y z " * 2000,
    "The quick brown fox jumps over the lazy dog " * 8, "the quick brown fox jumps over the lazy dog " * 8, LICENSE,
    "Apache License and GNU  General-Public LICENSE; cc by, CC-BY 4.0 mit\nlicense", "日本語のテキスト 🎉 mixed", "it's we'll  two  spaces\n\nand\ttabs",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty and long texts, ties, repeated rows, columns whose names the
    operators use inside."""
    rows = [(i * 10, t) for i, t in enumerate(TEXTS)] + [(None, "one two"), (None, None), (20, " \n\t"), (30, "one"), (30, "other"), (999, "one")]
    full = [(i, t, "en", "s", 0, "x", "x", 1, 2, "n", 5, 6, "k", "a", 1, "b", 2, 3) for i, t in rows]
    return spark.createDataFrame(
        full,
        "doc_id long, text string, lang string, source string, n_chars long, norm string, h string, fp long, row long, words string, slice int, part int, keep_id string, "
        "sha string, kept_id int, kept_sha string, kept_rows int, node int",
    ).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def some_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
