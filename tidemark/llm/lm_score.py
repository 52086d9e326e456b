"""Language-model scores from n-gram tries in Elias-Fano code, one for each part of the contexts."""

from __future__ import annotations

import ctypes
import mmap
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import buckets_for, crc_mod, materialise, shared_dir, small_batches, texts_of
from .elias_fano import Level, dump, load

#: Bytes of text in a slice, whose n-grams are asked for together, and in a part of the contexts.
SLICE, PART = 10 << 20, 10 << 20
DISCOUNT, ADD = 0.75, 0.1
LEVELS = 255
#: Logarithms travel as 16-bit steps down from 0; 0 stands for what was never seen.
STEP = 4000.0
START, END = 1, 2  # hashes of the marks around a text
LOW32 = np.uint64((1 << 32) - 1)


def _give_back() -> None:
    """Give memory that was freed back to the system, where the C library can: a worker keeps it else,
    and lives on for other tasks."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


# --- arrays in bytes
def pack(arrays: list[np.ndarray]) -> bytes:
    """Whole numbers, none below zero, by byte planes, compressed."""
    head, planes = [len(arrays)], []
    for x in arrays:
        width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
        raw = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)
        planes += [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(width)]
        head += [len(x), width]
    return zstandard.ZstdCompressor(level=3).compress(np.array(head, "<u4").tobytes() + b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(data[:4], "little")
    head = np.frombuffer(data, "<u4", 2 * n, 4).tolist()
    at, out = 4 + 8 * n, []
    for size, width in zip(head[::2], head[1::2]):
        raw = np.zeros((size, 8), np.uint8)
        raw[:, :width] = np.frombuffer(data, np.uint8, size * width, at).reshape(width, size).T
        at += size * width
        out.append(raw.view("<u8")[:, 0].astype(np.int64) if width < 8 else raw.view("<u8")[:, 0])
    return out


# --- slices of the corpus
def slices(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, train) -> (slice, doc_id, train, sizes, hashes, tokens): a row for
    about SLICE bytes of text: ids and flags of its documents, their numbers of words, the 64-bit
    hashes of the distinct words and the words as places among them, both packed."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal number
            known: dict[bytes, int] = {}
            sizes, tokens = [], []
            for batch in held:
                for text in texts_of(batch, "text"):
                    words = text.lower().split()
                    sizes.append(len(words))
                    tokens.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
            tokens = np.concatenate(tokens)
            order = np.argsort(-np.bincount(tokens, minlength=len(known)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(known), np.int32)
            rank[order] = np.arange(len(known), dtype=np.int32)
            hashes = np.fromiter(map(xxh64_intdigest, known), np.uint64, len(known))[order]
            ends = pa.array([0, len(sizes)], pa.int32())
            lists = [pa.concat_arrays([b.column(c) for b in held]) for c in ("doc_id", "train")] + [pa.array(sizes, pa.int64())]
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), *(pa.ListArray.from_arrays(ends, x) for x in lists), pa.array([pack([hashes])], pa.binary()), pa.array([pack([rank[tokens]])], pa.binary())],
                ["slice", "doc_id", "train", "sizes", "hashes", "tokens"],
            )

        for batch in small_batches(batches, "text", SLICE):
            more = sum(map(len, texts_of(batch, "text")))
            if held and size + more > SLICE:
                yield out()
                held, size = [], 0
            held.append(batch)
            size += more
        if held:
            yield out()
        _give_back()

    return docs.select("doc_id", "text", "train").mapInArrow(
        run, f"slice long, doc_id array<{kind}>, train array<boolean>, sizes array<bigint>, hashes binary, tokens binary"
    )


@dataclass
class Shares:
    """How contexts are dealt out: ``parts`` in all; words that make up more than a part's share of
    the tokens, the mark of the start among them (by hash, with the times each occurs in training
    texts), go to ``spread`` parts each."""

    parts: int
    hashes: np.ndarray
    counts: np.ndarray
    spread: np.ndarray

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the words dealt out or -1, number of parts)."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hot = self.hashes[at] == hashes
        return np.where(hot, at, -1), np.where(hot, self.spread[at], 1)


def shares(parts: int, cut: DataFrame, train_docs: int) -> Shares:
    """Each slice names the words that have over half a part's share of its tokens. A word with more
    than 1 / ``parts`` of all tokens has more than half of its own in slices that name it, so
    only those are counted whose named tokens come to half a part's share of all: the driver
    gets fewer than 2 * parts rows, however many slices there are."""
    total = cut.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda n, x: n + x))).first()[0] or 0

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, tokens in zip(batch.column("hashes").to_pylist(), batch.column("tokens").to_pylist()):
                (h,), (t,) = unpack(hashes), unpack(tokens)
                n = np.bincount(t, minlength=len(h))
                some = np.flatnonzero(n * 2 * parts > len(t))
                yield pa.RecordBatch.from_arrays([pa.array(h[some].astype(np.uint64).view(np.int64)), pa.array(n[some])], ["h", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (h,), (t,) = (unpack(batch.column(c)[i].as_py()) for c in ("hashes", "tokens"))
                train = np.repeat(np.array(batch.column("train")[i].values.to_pylist(), bool), batch.column("sizes")[i].values.to_numpy())
                h = h.astype(np.uint64)
                place = np.flatnonzero(np.isin(h, names))
                n = np.bincount(t, minlength=len(h))[place], np.bincount(t[train], minlength=len(h))[place]
                yield pa.RecordBatch.from_arrays([pa.array(h[place].view(np.int64)), *map(pa.array, n)], ["h", "all", "train"])

    often = cut.mapInArrow(named, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") * 2 * parts > total)
    names = np.array([r.h for r in often.toLocalIterator()], np.int64).view(np.uint64)
    found = [(START, train_docs, parts)]
    if len(names):
        for r in cut.mapInArrow(counted, "h long, all long, train long").groupBy("h").agg(F.sum("all").alias("all"), F.sum("train").alias("train")).toLocalIterator():
            if r["all"] * parts > total:
                found.append((r.h % (1 << 64), r.train, min(parts, -(-2 * r["all"] * parts // total))))
    found.sort()
    return Shares(parts, *(np.array(x, t) for x, t in zip(zip(*found), (np.uint64, np.int64, np.int64))))


def _mix(x: np.ndarray) -> np.ndarray:
    return (x * 0x9E3779B1 & 0xFFFFFFFF) >> 15


def _unique(x: np.ndarray) -> np.ndarray:
    """The distinct values, sorted; by a plain sort, several times as fast as numpy's own for many."""
    x = np.sort(x)
    return x[_runs(x)]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, the place of each key among them as 32 bits)."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.empty(len(keys), bool)
    new[:1] = True
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], place


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a.astype(np.int64)
    out <<= 32
    out |= b
    return out


@dataclass
class Ngrams:
    """What a slice asks for. Words are places among the slice's words, the marks after them. Each
    token is asked for after the two before it: events (u, v, w); triples and pairs (v, w) and
    contexts (v, u) are the distinct ones, sorted, with the part that knows them."""

    event: np.ndarray  # of each event, its triple
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    triple_context: np.ndarray
    triple_pair: np.ndarray
    context_v: np.ndarray
    pair_v: np.ndarray
    pair_w: np.ndarray
    triple_part: np.ndarray
    context_part: np.ndarray
    pair_part: np.ndarray
    word_part: np.ndarray
    hot: np.ndarray

    @staticmethod
    def of(hashes: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, dealt: Shares) -> Ngrams:
        n = len(hashes)
        h = np.concatenate([hashes, np.array([START, END], np.uint64)])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        full = np.full(len(tokens) + 3 * len(sizes), n, np.int32)
        full[np.arange(len(tokens)) + 3 * doc + 2] = tokens
        full[np.cumsum(sizes + 3) - 1] = n + 1
        at = np.arange(len(tokens) + len(sizes)) + 2 * np.repeat(np.arange(len(sizes)), sizes + 1)
        contexts, context = _distinct(_both(full[at + 1], full[at]))
        w = full[at + 2]
        del full, at, doc
        triples, event = _distinct(_both(context, w))
        context, w = (triples >> 32).astype(np.int32), (triples & 0xFFFFFFFF).astype(np.int32)
        del triples
        v, u = ((x[context]).astype(np.int32) for x in (contexts >> 32, contexts & 0xFFFFFFFF))
        pairs, pair = _distinct(_both(v, w))
        upper = (h >> np.uint64(32)).astype(np.int64)
        hot, spread = dealt.of(h)
        home = upper % dealt.parts

        def part(v: np.ndarray, by: np.ndarray) -> np.ndarray:
            return (home[v] + _mix(upper[by]) % spread[v]) % dealt.parts

        context_part = part(contexts >> 32, contexts & 0xFFFFFFFF)
        return Ngrams(
            event, v, u, w, context, pair, contexts >> 32, pairs >> 32, pairs & 0xFFFFFFFF,
            context_part[context], context_part, part(pairs >> 32, pairs & 0xFFFFFFFF), home, hot,
        )


def _runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _by_part(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows by part, in their order; the parts in rising order)."""
    keys = np.sort(parts.astype(np.int64) << 32 | np.arange(len(parts)))
    return keys & 0xFFFFFFFF, keys >> 32


def requests(cut: DataFrame, dealt: Shares) -> DataFrame:
    """(part, slice, body): the distinct triples of each slice for each part, with how often they
    occur in training texts, and the pairs of the words that are dealt out to several parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (hashes,), (tokens,) = (unpack(batch.column(c)[i].as_py()) for c in ("hashes", "tokens"))
                hashes, sizes = hashes.astype(np.uint64), batch.column("sizes")[i].values.to_numpy()
                asked = Ngrams.of(hashes, tokens, sizes, dealt)
                train = np.repeat(np.array(batch.column("train")[i].values.to_pylist(), bool), sizes + 1)
                count = np.bincount(asked.event[train], minlength=len(asked.v))
                pair_count = np.bincount(asked.triple_pair, count, len(asked.pair_v)).astype(np.int64)
                h = np.concatenate([hashes, np.array([START, END], np.uint64)])
                rows, of_row = _by_part(asked.triple_part)
                hot_pairs = np.flatnonzero(asked.hot[asked.pair_v] >= 0)
                order, of_pair = _by_part(asked.pair_part[hot_pairs])
                hot_pairs = hot_pairs[order]
                parts = np.union1d(of_row, of_pair)
                bounds = [np.searchsorted(x, parts, side=s) for x in (of_row, of_pair) for s in ("left", "right")]
                bodies = []
                for a, b, c, d in zip(*bounds):
                    t, p = rows[a:b], hot_pairs[c:d]
                    v, u, w = asked.v[t], asked.u[t], asked.w[t]
                    words = _unique(np.concatenate([u, w, asked.pair_w[p]]))
                    v_runs, c_runs = _runs(v), _runs(asked.triple_context[t])
                    bodies.append(pack([
                        h[words] & LOW32, h[v[v_runs]], np.diff(np.append(np.searchsorted(c_runs, v_runs), len(c_runs))), np.searchsorted(words, u[c_runs]),
                        np.diff(np.append(c_runs, len(t))), np.searchsorted(words, w), count[t],
                        asked.hot[asked.pair_v[p]], np.searchsorted(words, asked.pair_w[p]), pair_count[p],
                    ]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(parts.astype(np.int32)), pa.array(np.full(len(parts), batch.column("slice")[i].as_py())), pa.array(bodies, pa.binary())], ["part", "slice", "body"]
                )
                del hashes, tokens, asked, train, count, h, bodies
                _give_back()

    return cut.select("slice", "train", "sizes", "hashes", "tokens").mapInArrow(run, "part int, slice long, body binary")


# --- a part's trie
def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one byte for each value, the value of each byte): the means of equally filled bins."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.float32)
    distinct = _unique(values)
    if len(distinct) > LEVELS:
        edges = np.unique(np.quantile(values, np.arange(1, LEVELS) / LEVELS))
        code = np.searchsorted(edges, values, side="right")
        sums, n = np.bincount(code, values, LEVELS), np.bincount(code, minlength=LEVELS)
        return code.astype(np.uint8), (sums / np.maximum(n, 1)).astype(np.float32)
    return np.searchsorted(distinct, values).astype(np.uint8), distinct.astype(np.float32)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    first = _runs(keys)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


@dataclass
class Trie:
    """Three levels below the sorted hashes of the context words v: the words w that follow each v
    (with the quantised logarithm of their discounted share), the words u before each v (with that
    of what the discount leaves to words never seen after u v), and for each such (v, u) what
    follows, w as its place among the followers of v alone (context-relative), with its share."""

    contexts: np.ndarray
    words: np.ndarray
    counts: np.ndarray  # of each context
    left: np.ndarray  # what the discount leaves, by context
    levels: list[Level]
    codes: list[np.ndarray]
    values: list[np.ndarray]

    @staticmethod
    def of_counts(contexts: np.ndarray, words: np.ndarray, v: np.ndarray, u: np.ndarray, w: np.ndarray, n: np.ndarray, extra: tuple, hot: np.ndarray, hot_counts: np.ndarray) -> Trie:
        """v, u, w: places among ``contexts`` and ``words``; n: how often. ``extra``: pairs (v, w)
        with their counts for the contexts that are dealt out; hot: of each context its place in
        ``hot_counts`` or -1. Only n-grams that occur (n > 0) are kept."""
        keep = n > 0
        v, u, w, n = v[keep], u[keep], w[keep], n[keep]
        del keep
        ev, ew, en = extra
        whole = hot[v] < 0
        follow, place = _distinct(np.concatenate([v << 32 | w, ev << 32 | ew]))
        times = np.bincount(place, np.concatenate([np.where(whole, n, 0), en]), len(follow)).astype(np.int64)
        fv, fw = follow >> 32, follow & 0xFFFFFFFF
        counts = np.bincount(fv, times, len(contexts)).astype(np.int64)
        successors = np.bincount(fv[times > 0], minlength=len(contexts))
        of_hot = np.flatnonzero(hot >= 0)
        totals = counts.copy()
        totals[of_hot] = hot_counts[hot[of_hot]]
        before, context = _distinct(v << 32 | u)
        c_total = np.bincount(context, n, len(before))
        first = np.searchsorted(fv, np.arange(len(contexts)))
        relative = place[: len(v)] - first[v]
        triple, m = _summed(_both(context, relative), n)
        del context, relative, place, v, u, w, n
        of, rel = triple >> 32, triple & 0xFFFFFFFF
        c_kinds = np.bincount(of, minlength=len(before))
        share2 = np.where(times > 0, np.log10(np.maximum(times - DISCOUNT, 0.1) / np.maximum(totals[fv], 1)), 0.0)
        share3 = np.log10((m - DISCOUNT) / c_total[of]) if len(m) else np.zeros(0)
        left3 = np.log10(DISCOUNT * c_kinds / c_total) if len(before) else np.zeros(0)
        left2 = np.where(hot >= 0, successors, DISCOUNT * successors / np.maximum(totals, 1))  # of those dealt out: only how many
        made = [quantise(x) for x in (share2, left3, share3)]
        levels = [
            Level.make(fv, fw, len(contexts)), Level.make(before >> 32, before & 0xFFFFFFFF, len(contexts)),
            Level.make(of, rel, len(before)),
        ]
        return Trie(contexts, words, counts, left2, levels, [x[0] for x in made], [x[1] for x in made])

    def dump(self) -> bytes:
        return dump(self.levels, [self.contexts, self.words, self.counts, self.left, *self.codes, *self.values])

    @staticmethod
    def load(data) -> Trie:
        levels, rest = load(data)
        return Trie(*rest[:4], levels, rest[4:7], rest[7:])

    @staticmethod
    def mapped(data: bytes) -> Trie:
        """The trie over a memory-mapped file in the task's own temporary folder; the file has no
        name any more once it is mapped, so nothing stays. The arrays are views of the map."""
        handle, path = tempfile.mkstemp()
        try:
            with os.fdopen(handle, "wb") as f:
                f.write(data)
            with open(path, "rb") as f:
                return Trie.load(memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)))
        finally:
            os.unlink(path)

    def _steps(self, level: int, at: np.ndarray) -> np.ndarray:
        """The values at these places as steps below 0 (see STEP); 0 for place -1."""
        if not len(self.codes[level]):
            return np.zeros(len(at), np.int64)
        value = self.values[level][self.codes[level][np.maximum(at, 0)]].astype(float)
        return np.where(at >= 0, np.rint(-value * STEP).astype(np.int64).clip(0, 65_534) + 1, 0)

    def answer(self, request: list[np.ndarray], hot: Shares) -> bytes:
        """For each triple, (v, u) and (v, w) of the request, in its order, the steps of its value;
        for each v its count and what it leaves; for each pair of a dealt-out word its steps."""
        words, v_hash, c_per_v, c_u, t_per_c, t_w, _, hot_v, hot_w, _ = request
        words = _places(self.words, words.astype(np.uint64))
        of_v = _places(self.contexts, v_hash.astype(np.uint64))
        c_v = np.repeat(np.arange(len(v_hash)), c_per_v)
        t_c = np.repeat(np.arange(len(c_v)), t_per_c)
        t_v = c_v[t_c]
        context = self.levels[1].find(of_v[c_v], words[c_u])
        pairs, pair = _distinct(t_v << 32 | t_w)
        p_v, p_w = of_v[pairs >> 32], words[pairs & 0xFFFFFFFF]
        place = self.levels[0].find(p_v, p_w)
        first = self.levels[0].starts(np.maximum(of_v, 0))
        relative = np.where(place[pair] >= 0, place[pair] - first[t_v], -1)
        triple = self.levels[2].find(context[t_c], relative)
        normal, _ = hot.of(v_hash.astype(np.uint64))
        mine = normal < 0
        left = np.where(of_v >= 0, self.left[np.maximum(of_v, 0)], 0.0)
        count = np.where(of_v >= 0, self.counts[np.maximum(of_v, 0)], 0)
        hot_at = self.levels[0].find(_places(self.contexts, hot.hashes)[hot_v], words[hot_w])
        return pack([
            self._steps(2, triple), self._steps(1, context), self._steps(0, place)[mine[pairs >> 32]], count[mine],
            np.where(left > 0, np.rint(-np.log10(np.where(left > 0, left, 1)) * STEP).clip(0, 65_534) + 1, 0)[mine].astype(np.int64), self._steps(0, hot_at),
        ])


def _places(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where each value is in the sorted array, or -1; looked up in rising order."""
    if not len(sorted_):
        return np.full(len(values), -1, np.int64)
    order = np.argsort(values)
    rising = values[order]
    at = np.minimum(np.searchsorted(sorted_, rising), len(sorted_) - 1)
    out = np.empty(len(values), np.int64)
    out[order] = np.where(sorted_[at] == rising, at, -1)
    return out


def _emptied(parts: list[np.ndarray]) -> np.ndarray:
    """The arrays as one; the list gives them up."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def trie_of(bodies: list[bytes], dealt: Shares) -> Trie:
    """The trie of all requests of a part."""
    asked = [unpack(b) for b in bodies]
    words = _unique(np.concatenate([x[0].astype(np.uint64) for x in asked]))
    hot_here = _unique(np.concatenate([x[7] for x in asked]))
    contexts = _unique(np.concatenate([*(x[1].astype(np.uint64) for x in asked), dealt.hashes[hot_here]]))
    columns: list[list[np.ndarray]] = [[] for _ in range(7)]
    for own, v_hash, c_per_v, c_u, t_per_c, t_w, n, hot_v, hot_w, hot_n in asked:
        word, v = _places(words, own.astype(np.uint64)), _places(contexts, v_hash.astype(np.uint64))
        c = np.repeat(np.arange(len(c_u)), t_per_c)
        seen = n > 0
        c, some = c[seen], hot_n > 0
        v_of_hot = np.searchsorted(contexts, dealt.hashes[hot_v[some]])
        for column, x in zip(columns, (np.repeat(v, c_per_v)[c], word[c_u][c], word[t_w[seen]], n[seen], v_of_hot, word[hot_w[some]], hot_n[some])):
            column.append(x)
    del asked, own, v_hash, c_per_v, c_u, t_per_c, t_w, n, hot_v, hot_w, hot_n, word, v, c, x  # a part's arrays are held once
    v, u, w, n, *extra = (_emptied(x) for x in columns)
    hot, _ = dealt.of(contexts)
    return Trie.of_counts(contexts, words, v, u, w, n, tuple(extra), hot, dealt.counts)


def answers(asked: DataFrame, dealt: Shares) -> DataFrame:
    """``asked`` (part, slice, body) -> (slice, part, body): the answers; and for each part a row
    without a slice: how many distinct words of training texts it knows, and for each dealt-out
    word how many followers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, bytes]] = []

        def out() -> Iterator[pa.RecordBatch]:
            trie = Trie.mapped(trie_of([r[2] for r in rows], dealt).dump())
            hot, _ = dealt.of(trie.contexts)
            known = np.array([np.count_nonzero(trie.counts[hot < 0])])
            some = np.flatnonzero(hot >= 0)
            stats = pack([known, hot[some], trie.left[some].astype(np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([rows[0][0]], pa.int32()), pa.array([stats], pa.binary())], ["slice", "part", "body"])
            for part, slice_, body in rows:
                yield pa.RecordBatch.from_arrays([pa.array([slice_], pa.int64()), pa.array([part], pa.int32()), pa.array([trie.answer(unpack(body), dealt)], pa.binary())], ["slice", "part", "body"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "slice", "body"))):
                if rows and rows[0][0] != row[0]:
                    yield from out()
                    rows = []
                rows.append(row)
        if rows:
            yield from out()
        rows.clear()
        _give_back()

    return asked.repartitionById(dealt.parts, F.col("part")).sortWithinPartitions("part").select("part", "slice", "body").mapInArrow(run, "slice long, part int, body binary")


# --- scores
@dataclass
class Totals:
    tokens: int
    distinct: int
    hot_left: np.ndarray


def totals(answered: DataFrame, dealt: Shares, tokens: int, train_docs: int) -> Totals:
    followers, distinct = np.zeros(len(dealt.hashes), np.int64), 0
    for row in answered.filter("slice IS NULL").select("body").toLocalIterator():
        known, hot, n = unpack(row.body)
        distinct += int(known[0])
        np.add.at(followers, hot, n)
    real = dealt.hashes != START
    distinct += int(np.count_nonzero(dealt.counts[real])) + (train_docs > 0)
    return Totals(tokens, distinct, DISCOUNT * followers / np.maximum(dealt.counts, 1))


def _shares_of(steps: np.ndarray) -> np.ndarray:
    return np.where(steps > 0, 10.0 ** ((1 - steps) / STEP), 0.0)


def slice_scores(hashes: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, parts: Iterable[tuple[int, bytes]], dealt: Shares, known: Totals, train_docs: int) -> tuple[np.ndarray, ...]:
    """(n_known, base, score) of each document of a slice from the answers of the parts."""
    asked = Ngrams.of(hashes, tokens, sizes, dealt)
    n = len(hashes)
    share3, left3, share2 = (np.zeros(len(x)) for x in (asked.v, asked.context_v, asked.pair_v))
    count, left2 = np.zeros(n + 2, np.int64), np.zeros(n + 2)
    rows = [_by_part(x) for x in (asked.triple_part, asked.context_part, asked.pair_part)]
    hot_pair = asked.hot[asked.pair_v] >= 0
    normal = _unique(asked.v[asked.hot[asked.v] < 0])
    of_word = _by_part(asked.word_part[normal])
    for part, body in parts:
        triples, contexts, pairs, counts, left, hot_pairs = unpack(body)
        t, c, p = (order[np.searchsorted(by, part) : np.searchsorted(by, part, side="right")] for order, by in rows)
        share3[t], left3[c] = _shares_of(triples), _shares_of(contexts)
        share2[p[~hot_pair[p]]], share2[p[hot_pair[p]]] = _shares_of(pairs), _shares_of(hot_pairs)
        order, by = of_word
        w = normal[order[np.searchsorted(by, part) : np.searchsorted(by, part, side="right")]]
        count[w], left2[w] = counts, _shares_of(left)
    hot = np.flatnonzero(asked.hot >= 0)
    count[hot], left2[hot] = dealt.counts[asked.hot[hot]], known.hot_left[asked.hot[hot]]
    count[n + 1] = train_docs
    base = (count + ADD) / (known.tokens + ADD * (known.distinct + 1))
    # what a context never seen leaves is all
    left3[left3 == 0], left2[count == 0] = 1.0, 1.0
    two = share2 + left2[asked.pair_v] * base[asked.pair_w]
    three = share3 + left3[asked.triple_context] * two[asked.triple_pair]
    first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    w = asked.w[asked.event]
    return tuple(np.add.reduceat(x, first) for x in ((count[w] > 0).astype(np.int64), np.log10(base)[w], np.log10(three)[asked.event]))


def scores(cut: DataFrame, answered: DataFrame, dealt: Shares, known: Totals, train_docs: int, kind: str) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score): the answers meet their slice again."""
    theirs = answered.filter("slice IS NOT NULL").groupBy("slice").agg(F.collect_list(F.struct("part", "body")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (hashes,), (tokens,) = (unpack(batch.column(c)[i].as_py()) for c in ("hashes", "tokens"))
                sizes, parts = batch.column("sizes")[i].values.to_numpy(), batch.column("parts")[i].values
                bodies = zip(*(parts.field(c).to_pylist() for c in ("part", "body")))
                found = slice_scores(hashes.astype(np.uint64), tokens, sizes, bodies, dealt, known, train_docs)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i].values, pa.array(sizes + 1), *map(pa.array, found)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])
                del hashes, tokens, sizes, parts, bodies, found
                _give_back()

    joined = cut.join(theirs, "slice").select("doc_id", "sizes", "hashes", "tokens", "parts")
    return joined.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def score_corpus(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``: learnt
    from the rows for which ``train`` is true, and all rows scored.

    base_score sums the smoothed unigram log10 probabilities of the tokens (words and one end);
    score those of the trigram model: absolute discounting (DISCOUNT), interpolated with pairs and
    down to the smoothed unigrams, every n-gram that occurs being kept. Null is the empty text, one
    end alone. Repeated rows come out as often as they came in; a null id is an id; a very long
    text is a slice of its own (memory in proportion to it); an empty table gives an empty one.

    Contexts are dealt out by hash, a part for each PART bytes of text, and each part keeps all
    statistics of its contexts in a trie that a task maps and reads in place. A word that is more
    frequent than a part's share is dealt out by its neighbours. Slices of the corpus send each part their
    distinct n-grams with counts, once, and get back what the trie says of them; so nothing is sent
    for each document, a frequent n-gram comes once from each slice, and what is kept grows with the
    corpus without a bound. Words are told apart by 64-bit hashes, as
    neighbours of one word by 32 bits of them (about one word in 5,000 shares them with another of its part).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    if parts is None:
        parts = max(spark.sparkContext.defaultParallelism, -(-size // PART))
    name = f"slices_{uuid.uuid4().hex}"  # in buckets, so that the answers come to the slices and not both to a third place
    buckets = buckets_for(spark, size)
    slices(rows).write.bucketBy(buckets, "slice").option("compression", "none").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    cut = spark.table(name)
    each = F.arrays_zip("train", "sizes")
    learnt = cut.select(F.explode(each).alias("d")).filter("d.train").agg(F.count("*").alias("docs"), F.coalesce(F.sum("d.sizes"), F.lit(0)).alias("words")).first()
    dealt = shares(parts, cut, learnt.docs)
    answered = materialise(answers(requests(cut, dealt), dealt), "lm-answers")
    known = totals(answered, dealt, learnt.docs + learnt.words, learnt.docs)
    kind = docs.schema[id_col].dataType.simpleString()
    found = scores(cut, answered, dealt, known, learnt.docs, kind)
    return found.select("doc_id", "n_tokens", "n_known", F.lit(known.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def train_and_score(docs: DataFrame, modulus: int = 10, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): learnt from the rows
    whose crc32 of the id mod ``modulus`` is not 0, all rows scored (see ``score_corpus``, also for
    nulls, repeats, long texts and empty tables)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = score_corpus(rows, crc_mod("doc_id", modulus) != 0, parts=parts)
    return found.select("doc_id", (crc_mod("doc_id", modulus) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
