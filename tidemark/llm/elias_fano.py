"""Rising sequences in Elias-Fano code, read in place from a buffer, and levels of a trie over them."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np

BLOCK = 64
QUERIES = 1 << 16


@dataclass
class EliasFano:
    """A sequence that never falls. The low bits of each value side by side, without gaps; the
    high bits in unary, with the number of ones before each BLOCK of bits. All arrays can be views
    of a memory map: nothing is decoded when it is loaded."""

    size: int
    low_bits: int
    low: np.ndarray  # bytes
    high: np.ndarray  # bytes, a whole number of blocks
    ones: np.ndarray  # before each block

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, (int(universe) // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        upper = (values >> np.uint64(bits)).astype(np.int64)
        length = n + (int(universe) >> bits) + 2
        unary = np.zeros(-(-length // BLOCK) * BLOCK, np.uint8)
        unary[upper + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(unary.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64))]).astype(np.uint32 if n < 1 << 32 else np.int64)
        low = np.zeros((n * bits + 7) // 8 + 8, np.uint8)
        if bits:
            lows = values & np.uint64((1 << bits) - 1)
            for at in range(0, n, 1 << 16):  # a multiple of 8 values, so parts begin at whole bytes
                part = lows[at : at + (1 << 16)]
                flat = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits]
                packed = np.packbits(flat.ravel(), bitorder="little")
                low[at * bits // 8 : at * bits // 8 + len(packed)] = packed
        return EliasFano(n, bits, low, high, ones)

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.int64) * self.low_bits
        words = np.ndarray((len(self.low) - 7,), "<u8", self.low.data, strides=(1,))
        return words[bit >> 3] >> (bit & 7).astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)

    def _select(self, which: np.ndarray, zeros: bool) -> np.ndarray:
        """The place of the which-th one (or zero) among the high bits: its block by the counts before
        the blocks, then by halves of the block's word."""
        before = self.ones[:-1].astype(np.int64)
        if zeros:
            before = np.arange(len(before)) * BLOCK - before
        words = self.high.view("<u8")
        out = np.empty(len(which), np.int64)
        for at in range(0, len(which), QUERIES):
            k = which[at : at + QUERIES]
            block = np.searchsorted(before, k, side="right") - 1
            word = words[block]
            if zeros:
                word = ~word
            left = (k - before[block]).astype(np.uint8)
            place = block * BLOCK
            for width in (32, 16, 8, 4, 2, 1):
                ones = np.bitwise_count(word & np.uint64((1 << width) - 1))
                beyond = ones <= left
                left -= ones * beyond
                step = beyond.astype(np.uint8) * np.uint8(width)
                place += step
                word = word >> step
            out[at : at + QUERIES] = place
        return out

    def _ones_from(self, bit: np.ndarray, zeros: np.ndarray) -> np.ndarray:
        """How many ones stand in a row from each bit on, before which there are so many zeros."""
        words = np.ndarray((len(self.high) - 7,), "<u8", self.high.data, strides=(1,))
        byte = np.minimum(bit >> 3, len(self.high) - 8)
        shift = bit - 8 * byte
        word = words[byte] >> shift.astype(np.uint64)
        run = np.bitwise_count(word ^ (word + np.uint64(1))).astype(np.int64) - 1
        long = np.flatnonzero(run >= 63 - shift)  # the word may end before the ones do
        if len(long):
            run[long] = self._select(zeros[long], True) - bit[long]
        return run

    def access(self, at: np.ndarray) -> np.ndarray:
        return (self._select(at, False) - at << self.low_bits) + self._lows(at).astype(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value (the first of equals), -1 where it is not in the sequence: the
        successor within the values that share its high bits."""
        if not self.size:
            return np.full(len(values), -1, np.int64)
        upper = values >> self.low_bits
        ok = (values >= 0) & (upper < int(len(self.high) * 8 - self.size))
        upper = np.where(ok, upper, 0)
        first = np.where(upper > 0, self._select(np.maximum(upper - 1, 0), True) + 1, 0)  # bit after the zero before
        a = first - upper
        b = np.where(ok, a + self._ones_from(first, upper), a)
        end, target = b.copy(), (values & ((1 << self.low_bits) - 1)).astype(np.uint64)
        open_ = np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) // 2
            less = self._lows(mid) < target[open_]
            a[open_[less]], b[open_[~less]] = mid[less] + 1, mid[~less]
            open_ = open_[a[open_] < b[open_]]
        hit = np.flatnonzero(a < end)
        hit = hit[self._lows(a[hit]) == target[hit]]
        out = np.full(len(values), -1, np.int64)
        out[hit] = a[hit]
        return out

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ones]


@dataclass
class Level:
    """The successors of each context. ``pointers`` rise: the place of each context's first
    successor. ``keys`` rise over all contexts: a successor's number, counted on from the last
    key of the contexts before (a context may be asked for any number below its own width)."""

    pointers: EliasFano
    keys: EliasFano

    @staticmethod
    def make(contexts: np.ndarray, numbers: np.ndarray, n_contexts: int) -> Level:
        """From pairs sorted by (context, number), each once."""
        first = np.searchsorted(contexts, np.arange(n_contexts + 1)).astype(np.int64)
        last = np.maximum(first[1:] - 1, 0)
        wide = np.where(first[1:] > first[:-1], numbers[last] + 1 if len(numbers) else 0, 0)
        base = np.concatenate([[0], np.cumsum(wide)])
        keys = numbers + base[contexts]
        return Level(EliasFano.encode(first, max(1, len(numbers))), EliasFano.encode(keys, max(1, int(base[-1]))))

    def starts(self, contexts: np.ndarray) -> np.ndarray:
        return self.pointers.access(contexts)

    def find(self, contexts: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """The place of each (context, number), -1 where it is not there; context -1 is none. Queries
        are looked up in rising order, so that memory is read from front to back, and each context's
        pointers once."""
        out = np.full(len(contexts), -1, np.int64)
        rows = np.flatnonzero((contexts >= 0) & (numbers >= 0))
        if not len(rows) or not self.keys.size:
            return out
        rows = rows[np.argsort(contexts[rows].astype(np.int64) << 32 | numbers[rows])]
        mine = contexts[rows]
        new = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        some = mine[new]
        first, end = self.pointers.access(some), self.pointers.access(some + 1)
        base = np.where(first > 0, self.keys.access(np.maximum(first - 1, 0)) + 1, 0)
        times = np.diff(np.append(new, len(mine)))
        first, end, base = (np.repeat(x, times) for x in (first, end, base))
        found = self.keys.find(base + numbers[rows])
        good = (found >= first) & (found < end)
        out[rows[good]] = found[good]
        return out


def dump(levels: list[Level], arrays: list[np.ndarray]) -> bytes:
    """All arrays in one block of bytes: a header of their kinds and sizes, then the data, each
    array aligned to eight bytes."""
    meta, flat = [], []
    for level in levels:
        for x in (level.pointers, level.keys):
            meta.append([x.size, x.low_bits])
            flat += x.arrays()
    flat += arrays
    head = json.dumps({"sequences": meta, "arrays": [[a.dtype.str, len(a)] for a in flat]}).encode()
    head += b" " * (-len(head) % 8)
    return len(head).to_bytes(8, "little") + head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in flat)


def load(data) -> tuple[list[Level], list[np.ndarray]]:
    """What was dumped, as views of ``data``."""
    size = int.from_bytes(data[:8], "little")
    meta = json.loads(bytes(data[8 : 8 + size]))
    at, flat = 8 + size, []
    for kind, n in meta["arrays"]:
        flat.append(np.frombuffer(data, kind, n, at))
        at += -(-flat[-1].nbytes // 8) * 8
    sequences = [EliasFano(n, bits, *flat[3 * i : 3 * i + 3]) for i, (n, bits) in enumerate(meta["sequences"])]
    levels = [Level(a, b) for a, b in zip(sequences[::2], sequences[1::2])]
    return levels, flat[3 * len(sequences) :]
