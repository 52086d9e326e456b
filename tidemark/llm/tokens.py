"""Token ids of whole texts by a ``tokenizers`` vocabulary, cut into pieces."""

from __future__ import annotations

import json
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import small_batches


def encoder(vocabulary: str, pattern: str) -> Callable[[str], list[int]]:
    """Text to ids by a byte-level BPE of the ``tokenizers`` library, without special tokens.

    Where each merge's rank is the id of what it makes, tiktoken gives the same ids several
    times faster and is taken; otherwise the file is loaded as it is."""
    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)["model"]
    back = {c: b for b, c in enumerate(byte_alphabet())}
    vocab = model["vocab"]
    made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ids = [vocab[m] for m in made]
    merged = set(ids)
    plain = ids == sorted(ids) and all(c in back for t in made for c in t)
    ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if i in merged or len(t) == 1} if plain else {}
    if len(ranks) == 256 + len(ids) and min(ids) == 256:
        import tiktoken

        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(vocabulary)
    loaded.encode_special_tokens = True
    return lambda text: loaded.encode(text, add_special_tokens=False).ids


def piece_starts(n: int, capacity: int) -> list[int]:
    """Where the pieces of ``n`` tokens start: all but the first are full."""
    return [0, *range(n % capacity or capacity, n, capacity)]


def id_bytes(vocabulary: str) -> int:
    """2 where all ids of the vocabulary fit into 16 bits, else 4."""
    with open(vocabulary, encoding="utf-8") as f:
        loaded = json.load(f)
    ids = [*loaded["model"]["vocab"].values(), *(t["id"] for t in loaded.get("added_tokens") or ())]
    return 2 if max(ids) < 1 << 16 else 4


def pieces(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    capacity: int = 1024,
    end_id: int | None = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row for each piece of at most ``capacity`` tokens of each text's ids, then ``end_id``:
    (doc_id, piece, start, length, ids_crc32, slice, rank). ``slice`` numbers the task and
    ``rank`` the pieces of one length within it, so that global ranks need no sort: see
    ``packing``. They belong together only once written. Null is the empty text, which is one
    piece of ``end_id`` alone. A very long text is encoded as a whole. Repeated rows give their pieces each,
    an empty table none."""
    kind = docs.schema[id_col].dataType.simpleString()
    tail = [] if end_id is None else [end_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern)
        part = TaskContext.get().partitionId()
        ranks: Counter[int] = Counter()
        for batch in small_batches(batches, "text", 1 << 20):
            owner, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = array("I", encode(text or "") + tail)
                raw = np.frombuffer(ids, np.uint32).astype("<u4").tobytes()
                starts = piece_starts(len(ids), capacity) if ids else []
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    owner.append(i)
                    rows.append((k, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), part, ranks[b - a]))
                    ranks[b - a] += 1
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            arrays = [batch.column("doc_id").take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "slice", "rank"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, slice int, rank long"
    )


def chunks(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    capacity: int = 1024,
    end_id: int | None = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The same pieces with their ids, a row for about a megabyte of text: (slice, first, doc_id,
    piece, length, ids_crc32, ids). ``first`` is the place of the row's first piece among those of
    its task; then an array with an item for each piece, and the ids of all of them side by side,
    of ``id_bytes`` each, little-endian."""
    kind = docs.schema[id_col].dataType.simpleString()
    tail = [] if end_id is None else [end_id]
    width = id_bytes(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern)
        part, first = TaskContext.get().partitionId(), 0
        for batch in small_batches(batches, "text", 1 << 20):
            owner, piece, length, crc, data = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array(encode(text or "") + tail, "<u4")
                starts = piece_starts(len(ids), capacity) if len(ids) else []
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    owner.append(i)
                    piece.append(k)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                data.append(ids.astype(f"<u{width}").tobytes())
            ends = pa.array([0, len(owner)], pa.int32())
            lists = [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([first], pa.int64()), *(pa.ListArray.from_arrays(ends, x) for x in lists), pa.array([b"".join(data)], pa.binary())],
                ["slice", "first", "doc_id", "piece", "length", "ids_crc32", "ids"],
            )
            first += len(owner)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"slice int, first long, doc_id array<{kind}>, piece array<int>, length array<bigint>, ids_crc32 array<bigint>, ids binary"
    )
