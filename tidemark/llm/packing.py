"""Best-fit packing of token pieces into sequences by minimum bin slack."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .tokens import pieces


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The lengths (and how often) whose sum comes closest to ``room`` from below, by a
    bitset of the sums that can be reached. Large lengths are tried first and the search
    ends once ``room`` itself is reached, so that small ones are left for later bins."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        steps.append((length, reach))
        left, block = min(counts[length], room // length), 1
        while left:
            take = min(block, left)
            reach |= (reach << (take * length)) & mask
            left, block = left - take, block * 2
        if reach >> room:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, before in reversed(steps):
        used = 0
        while not before >> total & 1:
            total, used = total - length, used + 1
        if used:
            chosen[length] = used
    return chosen


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths of a bin, number of such bins): each bin takes the largest length left and
    the fullest feasible combination with it; the combination is removed as often as the
    lengths last. Works on the number of pieces of each length, at most ``capacity`` numbers
    whatever the number of pieces."""
    counts = {x: n for x, n in counts.items() if n}
    bins = []
    while counts:
        largest = max(counts)
        counts[largest] -= 1
        chosen = fullest(counts, capacity - largest)
        counts[largest] += 1
        chosen[largest] = chosen.get(largest, 0) + 1
        times = min(counts[x] // n for x, n in chosen.items())
        for x, n in chosen.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        bins.append((chosen, times))
    return bins


def places(bins: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length rows (first rank, first sequence, bins, place of the first in a bin):
    the pieces of one length take the bins' places for it in the order of their ranks."""
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for chosen, times in bins:
        at = 0
        for length in sorted(chosen, reverse=True):
            table.setdefault(length, []).append((ranks.get(length, 0), first, times, at))
            ranks[length] = ranks.get(length, 0) + chosen[length] * times
            at += chosen[length] * length
        first += times
    return {length: np.array(rows, np.int64) for length, rows in table.items()}


def pack(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    capacity: int = 1024,
    end_id: int | None = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each
    row's ids (see ``tokens.pieces``); no sequence holds more than ``capacity`` tokens and
    offsets are gapless from 0. Null is the empty text; repeated rows (or ids) are packed each
    for itself; an empty table gives an empty one.

    The driver gets one number for each length and plans the bins from them. A piece's rank
    among its length is its rank in the task that made it plus what earlier tasks made, so
    nothing is sorted and a very common length is spread over all tasks.
    """
    made = materialise(pieces(docs, vocabulary, pattern, capacity, end_id, id_col, text_col), "pack-pieces")
    return placed(made, capacity)[0]


def placed(made: DataFrame, capacity: int = 1024) -> tuple[DataFrame, int]:
    """(``made`` with sequence_id and offset instead of slice and rank, number of sequences).
    ``made`` is a written table of pieces: ``rank`` counts those of one length within a slice."""
    per_task = made.groupBy("slice", "length").agg(F.count("*").alias("n")).checkpoint()
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}
    bins = minimum_bin_slack(counts, capacity)
    table = places(bins)
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_task.select("slice", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")).checkpoint()
    ranked = made.join(shifts, ["slice", "length"]).withColumn("rank", F.col("rank") + F.col("shift"))
    kept = [f for f in made.schema.fields if f.name not in ("slice", "rank")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("rank").to_numpy()
            sequence, offset = np.zeros_like(ranks), np.zeros_like(ranks)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                plan = table[int(length)]
                at = plan[np.searchsorted(plan[:, 0], ranks[rows], side="right") - 1]
                turn, which = np.divmod(ranks[rows] - at[:, 0], at[:, 2])
                sequence[rows] = at[:, 1] + which
                offset[rows] = at[:, 3] + turn * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return ranked.select(*names, "rank").mapInArrow(run, f"{schema}, sequence_id long, offset long"), sum(times for _, times in bins)
