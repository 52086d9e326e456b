"""Language identification by unigram pieces, summed over all segmentations of a word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, materialise, small_batches

#: Longer words are summed one by one, rescaled as they go.
LONG = 96
SLICE = 8 << 20
CHUNK = 1 << 12
SPACE = "▁"
#: Tilt by the byte: keeps a word's probability in the range of a double; divided out again.
RATE = 3.0
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xD6E8FEB86659FD93)


def byte_pieces(model_file: str) -> list[bytes]:
    """All pieces of a sentencepiece vocabulary as bytes, every single byte among them."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    found = {bytes([b]) for b in range(256)}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            found.add(sp.id_to_piece(i).lower().encode())
    return sorted(found)


@dataclass
class Pieces:
    """A fixed vocabulary with all prefixes of its pieces, found by a 64-bit polynomial hash."""

    pieces: list[bytes]

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.pieces))
        number = {p: i for i, p in enumerate(self.pieces)}
        prefixes = sorted({p[:n] for p in self.pieces for n in range(1, len(p) + 1)})
        hashes = np.array([self.hash(p) for p in prefixes], np.uint64)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces share a hash")
        # open addressing by the high bits, at most a quarter full
        self.shift = np.uint64(64 - (4 * len(prefixes)).bit_length())
        slots = 1 << (64 - int(self.shift))
        self.key, self.piece = np.zeros(slots + 64, np.uint64), np.full(slots + 64, -2, np.int32)
        self.steps = 1
        for h, p in zip(hashes[:, None], prefixes):
            at = int(self.slots(h)[0])
            steps = 1
            while self.piece[at] != -2:
                at, steps = at + 1, steps + 1
            self.key[at], self.piece[at] = h[0], number.get(p, -1)
            self.steps = max(self.steps, steps)

    @staticmethod
    def hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(MULTIPLIER) + b + 1) % (1 << 64)
        return h

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes ^ hashes >> np.uint64(29)) * SPREAD >> self.shift).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers; -1 for a mere prefix of a piece, -2 for neither."""
        at = self.slots(hashes)
        out = np.where(self.key[at] == hashes, self.piece[at], -2)
        left = np.flatnonzero((out == -2) & (self.piece[at] != -2))
        for _ in range(self.steps - 1):
            if not len(left):
                break
            at[left] += 1
            hit = self.key[at[left]] == hashes[left]
            out[left[hit]] = self.piece[at[left[hit]]]
            left = left[~hit & (self.piece[at[left]] != -2)]
        return out


def _lattice(pieces: Pieces, words: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
    """words: uint8 [n, length], all of one length. For each end position the (start, rows,
    piece numbers) of the pieces that end there; a row is followed from a start only as long
    as it is a prefix of some piece."""
    n, length = words.shape
    out: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(length + 1)]
    bytes_of = np.ascontiguousarray(words.T).astype(np.uint64) + np.uint64(1)
    for start in range(length):
        rows, h = np.arange(n), np.zeros(n, np.uint64)
        for end in range(start + 1, min(length, start + pieces.longest) + 1):
            h = h * MULTIPLIER + bytes_of[end - 1][rows]
            found = pieces.find(h)
            alive = found > -2
            if not alive.all():
                rows, h, found = rows[alive], h[alive], found[alive]
            if not len(rows):
                break
            whole = found >= 0
            if whole.any():
                out[end].append((start, rows[whole], found[whole]))
    return out


def _forward(lattice: list, tilted: np.ndarray, n: int) -> np.ndarray:
    """alpha [position, word, language]: the summed probability of all segmentations of the
    first bytes. tilted: [piece, language] probabilities, tilted by the piece's length."""
    alpha = np.zeros((len(lattice), n, tilted.shape[1]))
    alpha[0] = 1
    for end in range(1, len(lattice)):
        for start, rows, found in lattice[end]:
            alpha[end, rows] += alpha[start, rows] * tilted[found]
    return alpha


def _tilted(pieces: Pieces, logp: np.ndarray) -> np.ndarray:
    return np.exp(logp + RATE * np.array([len(p) for p in pieces.pieces]))


def _matches(pieces: Pieces, word: bytes, ends: range) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """For each of the ``ends``, in their order, the (start, piece number) of the pieces of one
    long word that end there; a chunk of ends at a time."""
    step = 1 if ends.step > 0 else -1
    for at in range(0, len(ends), CHUNK):
        part = ends[at : at + CHUNK]
        low, high = min(part[0], part[-1]), max(part[0], part[-1])
        first = max(0, low - pieces.longest)
        data = np.frombuffer(word[first:high], np.uint8).astype(np.uint64) + np.uint64(1)
        rows, h = np.arange(len(data)), np.zeros(len(data), np.uint64)
        found: list[list[tuple[int, int]]] = [[] for _ in range(high - low + 1)]
        for size in range(1, pieces.longest + 1):
            inside = rows + size <= len(data)
            rows, h = rows[inside], h[inside]
            h = h * MULTIPLIER + data[rows + size - 1]
            piece = pieces.find(h)
            alive = piece > -2
            rows, h, piece = rows[alive], h[alive], piece[alive]
            whole = piece >= 0
            for start, p in zip((first + rows[whole]).tolist(), piece[whole].tolist()):
                if low <= start + size:
                    found[start + size - low].append((start, p))
            if not len(rows):
                break
        for end, here in zip(range(low, high + 1)[::step], found[::step]):
            yield end, here


def _long_score(pieces: Pieces, tilted: np.ndarray, word: bytes) -> np.ndarray:
    """The forward sums of one long word in each language; rescaled as they go, in memory of
    a chunk."""
    out = []
    for row in tilted.tolist():
        alpha, scale, keep = [1.0], 0.0, pieces.longest + 1
        for end, here in _matches(pieces, word, range(1, len(word) + 1)):
            base = end - len(alpha)
            now = sum(alpha[start - base] * row[p] for start, p in here)
            alpha.append(now)
            if len(alpha) > 4 * keep or not 1e-200 < now < 1e200:
                alpha = [a / now for a in alpha[-keep:]]
                scale += float(np.log(now))
        out.append(scale + float(np.log(alpha[-1])))
    return np.array(out)


def _long_counts(pieces: Pieces, row: list[float], word: bytes, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """(piece numbers, expected uses) of one long word in its language: forward and backward
    sums over all segmentations, each value beside the logarithm of what it was divided by."""
    size, keep = len(word), pieces.longest + 1

    def sums(ends: range) -> tuple[np.ndarray, np.ndarray]:
        """From the front (at the ends of pieces) or from the back (at their starts)."""
        back = ends.step < 0
        value, log = [0.0] * (size + 1), np.zeros(size + 1)
        value[size if back else 0] = 1.0
        scale = 0.0
        for end, here in _matches(pieces, word, ends):
            if back:
                for start, p in here:
                    value[start] += value[end] * row[p]
                done, around = end - 1, range(max(0, end - keep), end)
            else:
                value[end] = sum(value[start] * row[p] for start, p in here)
                done, around = end, range(max(0, end - keep), end + 1)
            top = value[done]
            log[done] = scale
            if not 1e-100 < top < 1e100:
                for i in around:
                    value[i] /= top
                    log[i] = scale + np.log(top)
                scale += float(np.log(top))
        return np.array(value), log

    alpha, alog = sums(range(1, size + 1))
    beta, blog = sums(range(size, 0, -1))
    with np.errstate(divide="ignore"):
        a, b, r = np.log(alpha) + alog, np.log(beta) + blog, np.log(row)
    uses: dict[int, float] = {}
    for end, here in _matches(pieces, word, range(1, size + 1)):
        for start, p in here:
            uses[p] = uses.get(p, 0.0) + float(np.exp(a[start] + r[p] + b[end] - a[size]))
    return np.fromiter(uses, np.int64, len(uses)), weight * np.fromiter(uses.values(), float, len(uses))


def word_scores(pieces: Pieces, logp: np.ndarray, words: list[bytes]) -> np.ndarray:
    """[word, language] natural log probabilities: each sums all segmentations of the word."""
    tilted = _tilted(pieces, logp)
    by_piece = np.ascontiguousarray(tilted.T)
    out = np.zeros((len(words), logp.shape[0]))
    sizes = np.array([len(w) for w in words], np.int64)
    for length in np.unique(sizes):
        at = np.flatnonzero(sizes == length)
        if not length:
            continue
        for part in np.array_split(at, len(at) * int(length) // 200_000 + 1) if length <= LONG else []:
            data = np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(len(part), length)
            alpha = _forward(_lattice(pieces, data), by_piece, len(part))
            out[part] = np.log(alpha[-1])
        for i in at if length > LONG else []:
            out[i] = _long_score(pieces, tilted, words[i])
    return out - RATE * sizes[:, None]


def expected_counts(pieces: Pieces, logp: np.ndarray, words: list[bytes], lang: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """[language, piece]: the expected uses of each piece, by forward and backward sums over
    all segmentations of each whole word in its language."""
    tilted = _tilted(pieces, logp)
    counts = np.zeros(logp.size)
    base = lang.astype(np.int64) * logp.shape[1]
    sizes = np.array([len(w) for w in words], np.int64)
    for i in np.flatnonzero(sizes > LONG):
        found, n = _long_counts(pieces, tilted[lang[i]].tolist(), words[i], weight[i])
        counts[base[i] + found] += n
    tilted = tilted.ravel()
    for length in np.unique(sizes[(sizes > 0) & (sizes <= LONG)]):
        whole = np.flatnonzero(sizes == length)
        for part in np.array_split(whole, len(whole) * int(length) // 200_000 + 1):
            data = np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(len(part), length)
            lattice = [[(s, rows, base[part[rows]] + found) for s, rows, found in x] for x in _lattice(pieces, data)]
            alpha = np.zeros((length + 1, len(part)))
            alpha[0] = 1
            for end in range(1, length + 1):
                for start, rows, at in lattice[end]:
                    alpha[end, rows] += alpha[start, rows] * tilted[at]
            beta = np.zeros_like(alpha)
            beta[-1] = weight[part] / alpha[-1]
            used, places = [], []
            for end in range(length, 0, -1):
                for start, rows, at in lattice[end]:
                    p = tilted[at] * beta[end, rows]
                    beta[start, rows] += p
                    used.append(p * alpha[start, rows])
                    places.append(at)
            counts += np.bincount(np.concatenate(places), np.concatenate(used), counts.size)
    return counts.reshape(logp.shape)


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(word numbers, the distinct words, words in each row) of the lower-cased texts; a word
    starts with the space mark of sentencepiece."""
    text = pc.utf8_trim_whitespace(pc.utf8_lower(batch.column("text")))  # no empty words at the ends
    lists = pc.utf8_split_whitespace(pc.if_else(pc.equal(text, ""), pa.scalar(None, pa.string()), text))
    flat = lists.flatten().dictionary_encode()
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    mark = SPACE.encode()
    return flat.indices.to_numpy(), [mark + w.encode() for w in flat.dictionary.to_pylist()], counts


@dataclass
class LanguageModel:
    pieces: list[bytes]
    langs: list[str]
    logp: np.ndarray


def fit(
    docs: DataFrame,
    model_file: str,
    rounds: int = 2,
    smoothing: float = 0.1,
    text_col: str = "text",
    lang_col: str = "lang",
) -> LanguageModel:
    """Piece probabilities for each language in ``docs``, by ``rounds`` of expectation
    maximisation over all texts with a language, on the counts of their distinct words. Only
    sums come to the driver: at most the size of the vocabulary for each language. Null and empty texts add nothing."""
    pieces = byte_pieces(model_file)
    train = docs.filter(F.col(lang_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    langs = sorted(r[0] for r in train.select("lang").distinct().collect())
    logp = np.full((len(langs), len(pieces)), -np.log(len(pieces)))
    number = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", SLICE):
            index, words, counts = _words(batch)
            of = np.repeat([number[x] for x in batch.column("lang").to_pylist()], counts)
            keys, n = np.unique(index.astype(np.int64) * len(langs) + of, return_counts=True)
            which = pa.array(keys // len(langs))
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()).take(which), pa.array((keys % len(langs)).astype(np.int32)), pa.array(n.astype(np.int64))], ["word", "k", "n"]
            )

    words = train.mapInArrow(count, "word binary, k int, n long").groupBy("word", "k").agg(F.sum("n").alias("n"))
    words = materialise(words, "language-words") if langs else words
    for _ in range(rounds if langs else 0):

        def run(batches: Iterator[pa.RecordBatch], logp: np.ndarray = logp) -> Iterator[pa.RecordBatch]:
            table = Pieces(pieces)
            total = np.zeros_like(logp)
            for batch in batches:
                lang, weight = batch.column("k").to_numpy(), batch.column("n").to_numpy().astype(float)
                total += expected_counts(table, logp, batch.column("word").to_pylist(), lang, weight)
            k, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[k, piece])], ["k", "piece", "n"]
            )

        sums = words.mapInArrow(run, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n"))
        counts = np.full(logp.shape, smoothing)
        for row in sums.toLocalIterator():
            counts[row.k, row.piece] += row.n
        logp = np.log(counts / counts.sum(axis=1, keepdims=True))
    return LanguageModel(pieces, langs, logp)


def _predictions(model: LanguageModel, pieces: Pieces, batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    langs = model.langs
    index, words, counts = _words(batch)
    letters = pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if not langs:
        return ["und"] * len(counts), np.zeros(len(counts))
    each = word_scores(pieces, model.logp, words)
    rows = np.repeat(np.arange(len(counts)), counts)
    sums = np.stack([np.bincount(rows, each[index, k], len(counts)) for k in range(len(langs))], axis=1)
    spread = np.maximum(1, counts / 10)[:, None]
    score = 1 / np.exp((sums - sums.max(axis=1, keepdims=True)) / spread).sum(axis=1)
    names = [langs[b] if ok else "und" for b, ok in zip(sums.argmax(axis=1), letters)]
    return names, np.where(letters, score, 0.0)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row: the language under which the text is most
    probable (ties: the first by name) and its share of the languages' probabilities, tempered
    by a tenth of the number of words so that long texts keep a graded score.
    ``und`` and 0 if the text is null or has no letter, or nothing was learned. Repeated rows
    come out as often as they came in; an empty table gives an empty one."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model.pieces)
        for batch in small_batches(batches, "text", SLICE):
            names, score = _predictions(model, pieces, batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double"
    )


def drop_unknown(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language (not ``und``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model.pieces)
        for batch in small_batches(batches, text_col, SLICE):
            text = pa.RecordBatch.from_arrays([batch.column(text_col)], ["text"])
            yield batch.filter(pa.array([n != "und" for n in _predictions(model, pieces, text)[0]]))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, model_file: str, modulus: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows whose crc32 of the id mod
    ``modulus`` is not ``held``, predicted for all (see ``predict`` for nulls, repeats and empty
    tables; a very long word takes some 10 microseconds a byte)."""
    out = crc_mod("doc_id", modulus) == held
    model = fit(docs.filter(~out), model_file)
    return predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
