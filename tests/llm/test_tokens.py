import base64
import hashlib
import json
import struct
import zlib
from itertools import product
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, packing, token_output, tokens
from tidemark.storage import shared_dir

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(RANKS), P.PATTERN)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sabZ9é.!日 \u0085\x1c"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_encoding_is_that_of_ranks(codec, reference, text):
    want = reference.encode_ordinary(text)
    ids, data = next(codec.round_trips([text]))
    assert ids == ",".join(map(str, want)) and data == text.encode()
    assert codec.encode(text) == want


def test_encode_query(odd_docs, some_docs, no_docs, reference):
    for docs in (odd_docs, some_docs):
        want = []
        for r in docs.collect():
            ids = reference.encode_ordinary(r.text or "")
            want.append((str(r.doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        got = [(str(r[0]), *r[1:]) for r in bpe.encode_digests(docs, RANKS, P.PATTERN).collect()]
        assert sorted(got) == sorted(want)
    assert bpe.encode_digests(no_docs, RANKS, P.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(some_docs, RANKS, P.PATTERN), RANKS).join(some_docs, "doc_id").collect()
    assert all(bytes(r.data) == r.text.encode() for r in back)


def hf():
    loaded = Tokenizer.from_file(JSON)
    loaded.encode_special_tokens = True
    return loaded


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_fast_encoder_is_tokenizers(text):
    text = text.encode("utf-8", "ignore").decode()
    if not hasattr(test_fast_encoder_is_tokenizers, "both"):
        test_fast_encoder_is_tokenizers.both = (hf(), tokens.encoder(JSON, P.PATTERN))
    slow, fast = test_fast_encoder_is_tokenizers.both
    assert fast(text) == slow.encode(text, add_special_tokens=False).ids


def brute_pieces(docs):
    slow, out = hf(), {}
    for n, r in enumerate(docs.collect()):
        ids = [*slow.encode(r.text or "", add_special_tokens=False).ids, 2]
        starts = tokens.piece_starts(len(ids), 1024)
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            row = (str(r.doc_id), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
            out[row] = out.get(row, 0) + 1
    return out


def check_packing(docs):
    got = packing.pack(docs, JSON, P.PATTERN).collect()
    counts = {}
    for r in got:
        row = (str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)
        counts[row] = counts.get(row, 0) + 1
    assert counts == brute_pieces(docs)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    return bins, sum(r.length for r in got)


def test_packing(odd_docs, some_docs, no_docs):
    check_packing(odd_docs)
    bins, total = check_packing(some_docs)
    assert len(bins) <= 1.03 * -(-total // 1024) + 1
    assert packing.pack(no_docs, JSON, P.PATTERN).count() == 0


def test_fullest_is_the_best_subset():
    rng = np.random.default_rng(5)
    for _ in range(150):
        counts = {int(x): int(n) for x, n in zip(rng.integers(1, 12, 4), rng.integers(1, 4, 4))}
        room = int(rng.integers(0, 40))
        best = max(s for s in (sum(x * n for x, n in zip(counts, c)) for c in product(*(range(n + 1) for n in counts.values()))) if s <= room)
        chosen = packing.fullest(counts, room)
        assert sum(x * n for x, n in chosen.items()) == best and all(n <= counts[x] for x, n in chosen.items())


def test_bins_take_every_piece():
    rng = np.random.default_rng(6)
    counts = {int(x): int(n) for x, n in zip(rng.integers(1, 1025, 300), rng.integers(1, 50, 300))}
    bins = packing.minimum_bin_slack(counts, 1024)
    used = {}
    for chosen, times in bins:
        assert sum(x * n for x, n in chosen.items()) <= 1024
        for x, n in chosen.items():
            used[x] = used.get(x, 0) + n * times
    assert used == counts and packing.minimum_bin_slack({}, 1024) == []


def test_permutation():
    for n in (1, 2, 3, 5, 64, 65, 5000):
        got = token_output.permute(np.arange(n), n, 7)
        assert sorted(got.tolist()) == list(range(n))
    assert token_output.permute(np.arange(100), 100, 1).tolist() != token_output.permute(np.arange(100), 100, 2).tolist()


def shard_file(path, shard):
    (file,) = (path / "shards" / f"shard={shard}").glob("part-*")
    return file


def test_shards(spark, odd_docs, no_docs, tmp_path, monkeypatch):
    path = tmp_path / "shards"
    total = token_output.write_shards(odd_docs, str(path), JSON, P.PATTERN, shard_rows=4)
    m = token_output.read_manifest(spark, str(path))
    assert m["sequences"] == total and m["stride"] == 12 + 2048 + 1 and m["id_bytes"] == 2
    found, index = {}, spark.read.parquet(str(path / "index")).collect()
    filled = 0
    for s in range(total):  # by seeking alone
        with open(shard_file(path, s // 4), "rb") as f:
            f.seek(s % 4 * m["stride"])
            record = f.read(m["stride"])
        slot, used = struct.unpack_from("<qi", record)
        ids = np.frombuffer(record[12:-1], "<u2")
        assert slot == s and not ids[used:].any() and len(record) == m["stride"]
        filled += used
        at = 0
        for r in sorted((r for r in index if r.slot == s), key=lambda r: r.offset):
            assert r.offset == at
            row = (str(r.doc_id), r.piece, zlib.crc32(ids[at : at + r.length].astype("<u4").tobytes()))
            found[row] = found.get(row, 0) + 1
            at += r.length
        assert at == used
    want = {}
    for (i, k, _, _, crc), n in brute_pieces(odd_docs).items():
        want[i, k, crc] = want.get((i, k, crc), 0) + n
    assert found == want and filled > 0.9 * 1024 * (total - 1)
    all_rows = {r.slot: (r.length, bytes(r.tokens)) for r in token_output.read_slots(spark, str(path)).collect()}
    assert sorted(all_rows) == list(range(total)) and all(len(t) == 2 * n for n, t in all_rows.values())
    for first, count in ((0, 1), (3, 3), (5, None), (total, 4), (0, 0)):
        got = {r.slot: (r.length, bytes(r.tokens)) for r in token_output.read_slots(spark, str(path), first, count).collect()}
        last = total if count is None else min(total, first + count)
        assert got == {s: all_rows[s] for s in range(first, last)}
        with monkeypatch.context() as only_spark_reads:
            only_spark_reads.setattr(token_output, "_store", lambda uri: None)
            assert {r.slot: (r.length, bytes(r.tokens)) for r in token_output.read_slots(spark, str(path), first, count).collect()} == got
    monkeypatch.setattr(token_output, "BLOCK", 3)
    assert {r.slot: (r.length, bytes(r.tokens)) for r in token_output.read_slots(spark, str(path)).collect()} == all_rows
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("chunks_")]
    assert not list(Path(urlparse(shared_dir(spark)).path).glob("chunks_*"))
    assert token_output.write_shards(no_docs, str(tmp_path / "none"), JSON, P.PATTERN) == 0
    assert token_output.read_slots(spark, str(tmp_path / "none")).count() == 0


def test_a_cut_shard_is_an_error(spark, some_docs, tmp_path):
    total = token_output.write_shards(some_docs.limit(40), str(tmp_path / "out"), JSON, P.PATTERN)
    file = shard_file(tmp_path / "out", 0)
    file.write_bytes(file.read_bytes()[:-5])
    (tmp_path / "out" / "shards" / "shard=0" / f".{file.name}.crc").unlink(missing_ok=True)
    assert token_output.read_slots(spark, str(tmp_path / "out"), 0, total - 1).count() == total - 1
    with pytest.raises(PythonException, match="ends before record"):
        token_output.read_slots(spark, str(tmp_path / "out")).collect()


def test_tasks_of_several_chunks(spark, some_docs):
    long = some_docs.withColumn("text", F.concat(F.col("doc_id").cast("string"), F.repeat("text", 12))).coalesce(1)
    assert tokens.chunks(long, JSON, P.PATTERN).groupBy("slice").count().agg(F.max("count")).first()[0] > 2
    seen = [sorted(map(str, token_output.shard_digests(docs, JSON, P.PATTERN, shard_rows=256).collect())) for docs in (long, long.repartition(5))]
    assert seen[0] == seen[1] and sum(len(x) for x in seen[0]) > 0


def test_slots_depend_on_the_documents_alone(spark, some_docs, odd_docs):
    for docs in (some_docs, odd_docs.withColumn("doc_id", F.col("doc_id").cast("string"))):
        seen = [sorted(map(str, token_output.shard_digests(docs.repartition(n), JSON, P.PATTERN, shard_rows=32).collect())) for n in (1, 3, 7)]
        assert seen[0] == seen[1] == seen[2] and seen[0]


def test_wide_ids_survive(spark, tmp_path):
    with open(JSON, encoding="utf-8") as f:
        loaded = json.load(f)
    loaded["added_tokens"].append({"id": 70_000, "content": "zqx", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False})
    file = tmp_path / "wide.json"
    file.write_text(json.dumps(loaded), encoding="utf-8")
    assert tokens.id_bytes(str(file)) == 4
    docs = spark.createDataFrame([(1, "one two")], "doc_id int, text string")
    token_output.write_shards(docs, str(tmp_path / "out"), str(file), P.PATTERN, end_id=70_000)
    (row,) = token_output.read_slots(spark, str(tmp_path / "out")).collect()
    assert np.frombuffer(row.tokens, "<u4").tolist() == [*hf().encode("one two", add_special_tokens=False).ids, 70_000]
