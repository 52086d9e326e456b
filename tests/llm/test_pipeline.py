import re

import corpus_pipeline
import public_tokenizers
from test_dedup import brute_exact, grouped

from tidemark.llm import langid
from tidemark.llm.common import crc_mod


def test_stages_are_those_of_brute_force(spark, some_docs, tmp_path):
    docs = some_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        path = str(tmp_path / name)
        stage(spark, docs, "unused").write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == some_docs.columns
        after = {r.doc_id for r in docs.collect()}
        rows = [(r[0], r[1]) for r in before]
        if name == "language_id":
            assert after == {i for i, t in rows if t and re.search(r"[^\W\d_]", t)}
        elif name == "exact_dedup":
            assert after == {i for i, _, _, kept, _ in brute_exact(rows) if kept}
        else:
            near, far = grouped(rows, 0.86), grouped(rows, 0.7)
            kept = [n for (i, _), n in zip(rows, near) if i in after]
            assert len(kept) == len(set(kept))  # of near copies one at most
            assert {f for (i, _), f in zip(rows, far) if i in after} == set(far)  # of others all
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "unused").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 100


def test_empty_input(spark, no_docs, tmp_path):
    docs = no_docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "unused").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 0


def test_language_stage_learns_from_labelled_rows_alone(some_docs):
    model = langid.fit(some_docs.filter(crc_mod("doc_id", 3) != 1), public_tokenizers.path("piece_bpe_32k.model"))
    assert model.langs == sorted(model.langs) and len(model.langs) > 1
