"""Improbable-feature digests: rare byte windows in chained Bloom filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import small_batches, texts_of

WINDOW = 64
CLASSES = 1001
POPULAR = 16
FILTER_BITS = 2048
FILTER_BYTES = FILTER_BITS // 8
HASHES = 5
FULL = 160
BLOCK = 1 << 16
#: Bytes of text in a range of ids (more where there would be over MAX_RANGES).
RANGE_BYTES, MAX_RANGES = 32 << 20, 20_000
#: c * log2(c), scaled so that sums stay whole numbers of 32 bits.
_SCALE = 1 << 12
_CLOGC = np.array([0, *(round(_SCALE * c * np.log2(c)) for c in range(1, WINDOW + 1))], np.int32)
_STEP = np.diff(_CLOGC, prepend=_CLOGC[:1])  # what the c-th of equal bytes adds
_HIGHEST = int(_CLOGC[WINDOW])


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """The entropy of each 64-byte window, from 0 to 1000; a window is updated from the one
    before it by the counts of the byte that leaves and of the byte that enters."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int32)
    ahead = np.ones(n, np.uint8)  # times data[i] is in data[i : i + 64]
    behind = np.ones(n, np.uint8)  # times data[i] is in data[i - 63 : i + 1]
    for d in range(1, WINDOW):
        same = (data[:-d] == data[d:]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    sums = np.empty(n - WINDOW + 1, np.int32)
    sums[0] = _CLOGC[np.bincount(data[:WINDOW], minlength=256)].sum()
    sums[1:] = _STEP[behind[WINDOW:]] - _STEP[ahead[: n - WINDOW]]
    np.cumsum(sums, out=sums)
    return (_HIGHEST - sums) * np.int32(CLASSES - 1) // np.int32(_HIGHEST)


def _rarest(data: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each group of 64 neighbouring windows the place of the rarest, the leftmost of
    equals. rank: int32 for each class, 0 for the rarest."""
    groups = len(data) - 2 * WINDOW + 2
    out = np.empty(max(0, groups), np.int64)
    for start in range(0, groups, BLOCK):
        stop = min(start + BLOCK, groups)
        least = rank[entropy_classes(data[start : stop + 2 * WINDOW - 2])]
        least = least << np.int32(20) | np.arange(len(least), dtype=np.int32)
        width = 1
        while width < WINDOW:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        out[start:stop] = (least & np.int32((1 << 20) - 1)) + start
    return out


def features(texts: list[bytes], rank: np.ndarray) -> list[list[int]]:
    """For each text the 64-bit hashes of its selected windows in their order: those that are
    the rarest of at least 16 groups of 64 neighbours. A text of fewer than 127 bytes has one
    group of all its windows, one of fewer than 64 bytes is one feature (none if empty).
    All texts are gone through as one array; groups that touch two texts do not count."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    place = _rarest(data, rank)
    inside = np.zeros(len(data) + 1, np.int8)
    long = sizes >= 2 * WINDOW - 1
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, (starts + sizes - 2 * WINDOW + 2)[long], -1)
    place = place[np.cumsum(inside[: len(place)], dtype=np.int8).astype(bool)]
    edges = np.flatnonzero(np.diff(place, prepend=-1, append=-1))  # places never go back within a text
    at = place[edges[:-1]][np.diff(edges) >= POPULAR] if len(place) else place
    owner = np.searchsorted(starts, at, side="right") - 1
    found: list[list[int]] = [[] for _ in texts]
    for i, p in zip(owner.tolist(), at.tolist()):
        found[i].append(xxh64_intdigest(joined[p : p + WINDOW]))
    for i in np.flatnonzero(~long & (sizes > 0)).tolist():
        p = int(rank[entropy_classes(np.frombuffer(texts[i], np.uint8))].argmin()) if sizes[i] >= WINDOW else 0
        found[i].append(xxh64_intdigest(texts[i][p : p + WINDOW]))
    return found


def most_popular(text: bytes, rank: np.ndarray) -> list[int]:
    """The hashes of the windows of a text of 127 bytes or more that are the rarest of most groups."""
    places, times = np.unique(_rarest(np.frombuffer(text, np.uint8), rank), return_counts=True)
    return [xxh64_intdigest(text[p : p + WINDOW]) for p in places[times == times.max()].tolist()]


def digests_of(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """uint8 [filters, 256] for each text: a filter takes up to 160 distinct features, five
    bits each. Where no window is the rarest of 16 groups (texts of 127 to 141 bytes have fewer
    groups, texts of a short period as many equal windows) those of most groups stand in, so
    only the empty text has no filter."""
    out = []
    for text, found in zip(texts, features(texts, rank)):
        if text and not found:
            found = most_popular(text, rank)
        hashes = np.array(list(dict.fromkeys(found)), np.uint64)
        which = np.arange(len(hashes)) // FULL
        bits = np.zeros((-(-len(hashes) // FULL), FILTER_BITS), np.uint8)
        for k in range(HASHES):
            bits[which, (hashes >> np.uint64(11 * k) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
        out.append(np.packbits(bits, axis=1))
    return out


def _best_overlaps(a: np.ndarray, b: np.ndarray) -> float:
    """The mean over the filters of ``a`` of the best overlap with one of ``b``."""
    ones_a, ones_b = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b))
    total = 0.0
    for x, n in zip(a, ones_a):
        common = np.bitwise_count(x & b).sum(axis=1, dtype=np.int64)
        chance = n * ones_b / FILTER_BITS
        total += float(((common - chance) / np.maximum(np.minimum(n, ones_b) - chance, 1e-9)).max())
    return min(1.0, max(0.0, total / len(a)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1: for each filter of the shorter digest the best overlap with a filter of
    the other, beyond what chance gives, in parts of what is possible; then the mean (of both
    directions for digests of one length). Two digests without a feature are alike (1), one
    without is unlike any other (0)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) == len(b) > 1:
        return (_best_overlaps(a, b) + _best_overlaps(b, a)) / 2
    return _best_overlaps(a, b) if len(a) <= len(b) else _best_overlaps(b, a)


def class_ranks(docs: DataFrame, text_col: str = "text") -> list[int]:
    """The rank of each entropy class by the number of windows in all texts, the rarest
    first (ties: the lower class). Each task sums up its own counts: at most 1001 rows. Null and
    empty texts and an empty table have no windows; repeated rows count each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in small_batches(batches, "text"):
            texts = texts_of(batch, "text")
            data = np.frombuffer(b"".join(texts), np.uint8)
            ends = np.cumsum([len(t) for t in texts])
            across = np.zeros(len(data), bool)  # windows that reach into the next text
            for end in ends:
                across[max(0, end - WINDOW + 1) : end] = True
            for start in range(0, max(0, len(data) - WINDOW + 1), BLOCK):
                found = entropy_classes(data[start : start + BLOCK + WINDOW - 1])
                total += np.bincount(found[~across[start : start + len(found)]], minlength=CLASSES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["c", "n"])

    counts = np.zeros(CLASSES, np.int64)
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "c int, n long")
    for row in found.groupBy("c").agg(F.sum("n").alias("n")).collect():
        counts[row.c] = row.n
    ranks = np.empty(CLASSES, np.int64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(CLASSES)
    return ranks.tolist()


def digests(docs: DataFrame, ranks: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint): the digest of each whole text in hex; null and empty texts have
    the empty one, equal texts have equal ones."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.array(ranks, np.int32)
        for batch in small_batches(batches, "text"):
            found = [d.tobytes().hex() for d in digests_of(texts_of(batch, "text"), rank)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, fingerprint string"
    )


def range_cuts(docs: DataFrame, id_col: str, parts: int) -> list[int]:
    """At most ``parts`` - 1 ids of the table that cut it into ranges of about equal size: every
    so many-th of the ids whose hash falls into a thin class, so some 20 for each part come here."""
    n = docs.count()
    thin = max(1, n // (20 * parts))
    picked = sorted(
        r[0] for r in docs.filter(F.pmod(F.xxhash64(id_col), F.lit(thin)) == 0).select(id_col).distinct().toLocalIterator() if r[0] is not None
    )
    return sorted(set(picked[:: max(1, -(-len(picked) // parts))][1:]))


def with_next(docs: DataFrame, parts: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, ahead, doc_id, text): each row once (ahead 0) in the range of ids it belongs to,
    and the first id of each range once more (ahead 1) as the end of the range before, that
    of the table as the end of the last. Sorted by (ahead, doc_id, text) in each partition, which holds
    one range, so the next document is the next row. A null id comes first."""
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cuts = range_cuts(ids.select("doc_id"), "doc_id", parts)
    low = ids.agg(F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    starts = np.array(cuts, np.int64)

    @F.pandas_udf("long")
    def place(ids: pd.Series) -> pd.Series:
        """Twice the number of the range, and one more for its first id."""
        found = np.searchsorted(starts, ids.to_numpy(), side="right")
        at_cut = (found > 0) & (np.append(starts, 0)[found - 1] == ids.to_numpy())
        return pd.Series(2 * found + at_cut)

    number = (F.col("place") / 2).cast("int")
    first = F.col("doc_id").isNull() if low[1] else F.col("doc_id") == F.lit(low[0])
    back = F.when(first, F.lit(len(cuts))).when(F.col("place") % 2 == 1, number - 1)
    copies = F.array_compact(F.array(F.struct(number.alias("part"), F.lit(0).alias("ahead")), F.when(back.isNotNull(), F.struct(back.alias("part"), F.lit(1).alias("ahead")))))
    return (
        ids.withColumn("place", place(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))))
        .withColumn("at", F.explode(copies))
        .select(F.col("at.part").alias("part"), F.col("at.ahead").alias("ahead"), "doc_id", "text")
        .repartitionById(len(cuts) + 1, F.col("part"))
        .sortWithinPartitions("ahead", "doc_id", "text")
    )


def edited_text(text: str, following: str) -> str:
    """The text with its last half of code points replaced by the first as many of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_digests(docs: DataFrame, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next) for each row: how like its digest is to that of its edited text and of the
    next document. The next of a single document is itself. Null is the empty text; rows
    that repeat an id follow each other by text; an empty table gives an empty one.

    The text goes through one exchange, by ranges of ids (``parts``, by default by the bytes of
    text); a task keeps a slice of it, and of a very long text its digest's places alone. Ids are
    whole numbers.
    """
    import hashlib

    kind = docs.schema[id_col].dataType.simpleString()
    if parts is None:
        size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first().n or 0
        parts = min(MAX_RANGES, max(docs.sparkSession.sparkContext.defaultParallelism, size // RANGE_BYTES))
    ranks = class_ranks(docs, text_col)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.array(ranks, np.int32)
        held: tuple | None = None  # id, text and digest of the last row so far
        done = False
        for batch in small_batches(batches, "text"):
            if done:
                continue
            ahead = batch.column("ahead").to_pylist()
            count = ahead.index(1) + 1 if 1 in ahead else len(ahead)
            done = count < len(ahead) or bool(ahead[-1])
            texts = [t or "" for t in batch.column("text").slice(0, count).to_pylist()]
            prints = digests_of([t.encode() for t in texts], rank)
            ids = batch.column("doc_id").slice(0, count)
            if held:
                ids, texts, prints = pa.concat_arrays([held[0], ids]), [held[1], *texts], [held[2], *prints]
            held = (ids.slice(len(ids) - 1), texts[-1], prints[-1])
            others = [edited_text(a, b).encode() for a, b in zip(texts, texts[1:])]
            edited = digests_of(others, rank)
            if others:
                rows = [
                    (len(t), hashlib.sha256(o).hexdigest(), a.tobytes().hex(), e.tobytes().hex(), likeness(a, e), likeness(a, b))
                    for t, o, a, e, b in zip(texts, others, prints, edited, prints[1:])
                ]
                yield pa.RecordBatch.from_arrays([ids.slice(0, len(rows)), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names)

    return with_next(docs, parts, id_col, text_col).mapInArrow(
        run,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
