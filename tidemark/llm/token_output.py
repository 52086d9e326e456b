"""Training-order materialisation: packed token sequences in raw fixed-stride shards."""

from __future__ import annotations

import json
import struct
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, intermediates, materialise, remove, shared_dir
from .packing import placed
from .tokens import chunks, id_bytes

ROUNDS = 6
#: A record: slot and number of tokens, the ids, and the byte that Spark's text writer ends each row with.
HEADER = "<qi"
END = b"\n"
#: Records that a reader takes at once.
BLOCK = 1024


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1: a Feistel network over the least even number of bits
    that holds them; values of n and over walk on until they fall below n."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key % (1 << 64)))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (_mix(right ^ k) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def ranked_by_id(pieces: DataFrame) -> DataFrame:
    """``pieces`` (slice, chunk, at, doc_id, piece, length, ids_crc32) with another slice and a rank: in
    the order of ids and pieces, whatever task they came from. Equal rows may change places."""
    kept = [f.name for f in pieces.schema.fields if f.name != "slice"]
    order = ["doc_id", "piece", "ids_crc32", "length"]
    dealt = pieces.withColumnRenamed("slice", "task").repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                ranks[rows] = seen[length] + np.arange(len(rows))
                seen[length] += len(rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(lengths), part, np.int32)), pa.array(ranks)], [*batch.schema.names, "slice", "rank"])

    dealt = dealt.select("task", *kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    return dealt.mapInArrow(run, f"{schema}, slice int, rank long")


def write_shards(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    pattern: str,
    capacity: int = 1024,
    end_id: int | None = 2,
    pad_id: int = 0,
    shard_rows: int = 1 << 15,
    key: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> int:
    """Write packed sequences of all rows' ids (see ``packing``) to their slots; gives their number.

    Sequences are packed and numbered in the order of ids and pieces, and the keyed permutation
    gives each number its slot; so where a token comes to stand depends on the documents, the key
    and the capacity alone. Folders of ``path``: ``shards/shard=k``, one raw file of ``shard_rows``
    records from slot k * shard_rows on, a record being ``stride`` bytes: slot (64 bits), number of
    tokens (32 bits), ``capacity`` ids of 16 bits (32 where the vocabulary has more), padded with
    ``pad_id``, and a line feed; ``index``, Parquet of (slot, offset, doc_id, piece, length); and
    ``manifest``, JSON of what a reader needs. So slot s stands at byte (s % shard_rows) * stride of
    its file. The default makes shards of 67 MB. Null is the empty text; rows that repeat an id
    are written each; a very long text is cut into pieces; an empty table writes no records.

    The ids are written once, in chunks of a megabyte of text, in buckets of the task that made
    them (their number follows the bytes of text). The places of a chunk's pieces, some bytes for
    each, come to its bucket as one row for each chunk; the ids are exchanged once, to their
    shards, and a task holds the pieces of one shard. The chunks are deleted at the end.
    """
    spark = docs.sparkSession
    name = f"chunks_{uuid.uuid4().hex}"
    with intermediates(spark):
        try:
            return _write_shards(docs, path, name, vocabulary, pattern, capacity, end_id, pad_id, shard_rows, key, id_col, text_col)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(spark, [f"{shared_dir(spark)}/{name}"])


@contextmanager
def _joined_in_buckets(spark: SparkSession) -> Iterator[None]:
    """A join on a bucket's column and another one keeps the buckets where they are."""
    option = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(option)
    spark.conf.set(option, "false")
    try:
        yield
    finally:
        spark.conf.set(option, before)


def _write_shards(
    docs: DataFrame, path: str, name: str, vocabulary: str, pattern: str, capacity: int, end_id: int | None, pad_id: int, shard_rows: int, key: int, id_col: str, text_col: str
) -> int:
    spark = docs.sparkSession
    buckets = buckets_for(spark, docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)
    width = id_bytes(vocabulary)
    made = chunks(docs, vocabulary, pattern, capacity, end_id, id_col, text_col)
    made.write.bucketBy(buckets, "slice").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    made = spark.table(name)
    each = F.arrays_zip("doc_id", "piece", "length", "ids_crc32")
    slim = made.select("slice", "first", F.posexplode(each).alias("at", "p")).select("slice", F.col("first").alias("chunk"), "at", "p.*")
    packed, total = placed(materialise(ranked_by_id(slim), "sequence-pieces"), capacity)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(permute(batch.column("sequence_id").to_numpy(), total, key))], [*batch.schema.names[:-1], "slot"])

    packed = packed.select("task", "chunk", "at", "doc_id", "piece", "length", "offset", "sequence_id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema.fields[:-1])
    packed = materialise(packed.mapInArrow(slots, f"{schema}, slot long"), "sequence-slots")
    packed.select("slot", "offset", "doc_id", "piece", "length").write.parquet(f"{path}/index")

    kind = packed.schema["doc_id"].dataType.simpleString()
    placing = packed.select(F.col("task").alias("slice"), F.col("chunk").alias("first"), "at", "slot", "offset").repartition(buckets, "slice")
    places = placing.groupBy("slice", "first").agg(F.sort_array(F.collect_list(F.struct("at", "slot", "offset"))).alias("places"))

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, mine = batch.column("ids")[i].as_py(), batch.column("places")[i].values
                lengths = batch.column("length")[i].values.to_numpy()
                ends = np.cumsum(lengths) * width
                slot, offset = mine.field("slot").to_numpy(), mine.field("offset").to_numpy()
                order = np.lexsort((offset, slot))
                shards, starts = np.unique(slot[order] // shard_rows, return_index=True)
                groups = [order[a:b] for a, b in zip(starts, [*starts[1:], len(order)])]
                data = [press.compress(b"".join(ids[int(ends[k] - lengths[k] * width) : int(ends[k])] for k in g)) for g in groups]
                cuts = pa.array([*starts, len(order)], pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x[order])) for x in (slot, offset, lengths)]
                yield pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int32)), *lists, pa.array(data, pa.binary())], ["shard", "slot", "offset", "length", "ids"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad = np.array([pad_id], f"<u{width}").tobytes()
        press = zstandard.ZstdDecompressor()
        pieces: list[tuple[int, int, bytes]] = []  # of one shard
        now = None

        def batch_of(made: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now] * len(made), pa.int32()), pa.array(made, pa.binary())], ["shard", "record"])

        def out() -> Iterator[pa.RecordBatch]:
            pieces.sort()
            made: list[bytes] = []
            for slot, parts in groupby(pieces, key=lambda p: p[0]):
                body = b"".join(p[2] for p in parts)
                used = len(body) // width
                made.append(struct.pack(HEADER, slot, used) + body + pad * (capacity - used))
                if len(made) == 1024:
                    yield batch_of(made)
                    made = []
            yield batch_of(made)
            pieces.clear()

        for batch in batches:
            for shard, slots, offsets, lengths, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "slot", "offset", "length", "ids"))):
                if now not in (None, shard):
                    yield from out()
                now, ids, at = shard, press.decompress(ids), 0
                for slot, offset, n in zip(slots, offsets, lengths):
                    pieces.append((slot, offset, ids[at : at + n * width]))
                    at += n * width
        if pieces:
            yield from out()

    placed_ids = made.select("slice", "first", "length", "ids").join(places, ["slice", "first"]).select("length", "ids", "places")
    shards = (
        placed_ids.mapInArrow(to_shards, "shard int, slot array<bigint>, offset array<bigint>, length array<bigint>, ids binary")
        .repartitionById(max(1, -(-total // shard_rows)), F.col("shard"))
        .sortWithinPartitions("shard")
        .mapInArrow(records, "shard int, record binary")
        .select("shard", F.col("record").cast("string").alias("value"))
    )
    with _joined_in_buckets(spark):
        shards.write.partitionBy("shard").option("compression", "none").option("lineSep", END.decode()).text(f"{path}/shards")
    manifest = {
        "sequences": total, "shard_rows": shard_rows, "stride": struct.calcsize(HEADER) + capacity * width + len(END), "header": struct.calcsize(HEADER), "id_bytes": width,
        "capacity": capacity, "pad_id": pad_id, "key": key, "id_type": kind,
    }
    spark.range(1).coalesce(1).select(F.lit(json.dumps(manifest)).alias("value")).write.text(f"{path}/manifest")
    return total


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first().value)


def _store(uri: str) -> tuple[pyarrow.fs.FileSystem, str] | None:
    """The file system in which a task can open ``uri`` at any byte, and the path there; None for
    stores that only Spark reads."""
    try:
        store, path = pyarrow.fs.FileSystem.from_uri(uri)
        with store.open_input_file(path):
            return store, path
    except (pa.ArrowException, OSError):
        return None


def read_slots(spark: SparkSession, path: str, first: int = 0, count: int | None = None) -> DataFrame:
    """(slot, length, tokens) of the sequences from slot ``first`` on, in their order within each
    shard; ``tokens`` are the bytes of the ids without padding. A reader that stopped goes on at any
    slot: only the shards asked for are opened, and of these the bytes of the records asked for are
    read, BLOCK records at once, by (file, first byte, records). In a store that only Spark reads
    its binary files come whole (a shard has a bounded size) and the records are cut from them."""
    m = read_manifest(spark, path)
    last = m["sequences"] if count is None else min(m["sequences"], first + count)
    schema = "slot long, length int, tokens binary"
    if last <= first:
        return spark.createDataFrame([], schema)
    rows, stride, width = m["shard_rows"], m["stride"], m["id_bytes"]
    record = np.dtype([("slot", "<i8"), ("length", "<i4"), ("ids", np.uint8, (m["capacity"] * width,)), ("end", np.uint8)])
    files = spark.read.format("binaryFile").load(f"{path}/shards").filter(F.col("shard").between(first // rows, (last - 1) // rows))
    base = F.col("shard").cast("long") * rows
    start, stop = F.greatest(F.lit(first), base) - base, F.least(F.lit(last), base + rows) - base
    seeks = _store(files.select("path").first().path) is not None
    if seeks:
        each = files.select("path", F.explode(F.sequence(start, stop - 1, F.lit(BLOCK).cast("long"))).alias("at"), stop.alias("stop"))
        asked = each.select("path", "at", F.least(F.lit(BLOCK).cast("long"), F.col("stop") - F.col("at")).alias("n"))
    else:
        asked = files.select("path", F.lit(0).cast("long").alias("at"), (stop - start).alias("n"), F.substring("content", (start * stride + 1).cast("int"), ((stop - start) * stride).cast("int")).alias("content"))

    def parsed(data: bytes) -> pa.RecordBatch:
        found = np.frombuffer(data, record)
        used = np.arange(record["ids"].shape[0]) < found["length"][:, None] * width
        ends = np.concatenate([[0], np.cumsum(found["length"] * width)]).astype(np.int32)
        tokens = pa.BinaryArray.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(found["ids"][used].tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(found["slot"].copy()), pa.array(found["length"].copy()), tokens], ["slot", "length", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, opened = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                uri, at, n = (batch.column(c)[i].as_py() for c in ("path", "at", "n"))
                if not seeks:
                    content = batch.column("content")[i].as_buffer()
                    yield from (parsed(content.slice(k * stride, min(BLOCK, n - k) * stride)) for k in range(0, n, BLOCK))
                    continue
                if uri != now:
                    if opened is not None:
                        opened.close()
                    store, inner = pyarrow.fs.FileSystem.from_uri(uri)
                    now, opened = uri, store.open_input_file(inner)
                data = opened.read_at(n * stride, at * stride)
                if len(data) != n * stride:
                    raise ValueError(f"{uri} ends before record {at + n}")
                yield parsed(data)
        if opened is not None:
            opened.close()

    return asked.mapInArrow(run, schema)


def shard_digests(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = 1024, shard_rows: int = 1 << 15, **options) -> DataFrame:
    """Write the shards in the shared folder and read them back: (slot, shard, byte_offset, length,
    tokens_crc32, doc_ids, pieces) for each sequence; the documents and their pieces in order."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/sequences-{uuid.uuid4().hex}"
    write_shards(docs, path, vocabulary, pattern, capacity, shard_rows=shard_rows, **options)
    stride = read_manifest(spark, path)["stride"]
    index = spark.read.parquet(f"{path}/index").groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece"))).alias("parts"))
    return read_slots(spark, path).select("slot", F.col("length").cast("long").alias("length"), F.crc32("tokens").alias("tokens_crc32")).join(index, "slot").select(
        "slot", F.floor(F.col("slot") / shard_rows).cast("int").alias("shard"), (F.col("slot") % shard_rows * stride).alias("byte_offset"),
        "length", "tokens_crc32", F.col("parts.doc_id").alias("doc_ids"), F.col("parts.piece").alias("pieces"),
    )
