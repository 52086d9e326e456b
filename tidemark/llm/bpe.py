"""Byte-level BPE: encoding by a sentencepiece model made straight from a rank file."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

CACHE = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file with one base64 token and rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def byte_alphabet() -> list[str]:
    """A printable character for each byte: the printable ones of Latin-1 stand for
    themselves, the others follow from U+0100 on."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    import struct

    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model of type BPE: each token is a piece, its bytes mapped
    to characters, its score the negative rank, its id the rank; the unknown piece comes
    last. Normalisation is the identity and spaces stay as they are."""
    alphabet = byte_alphabet()
    ordered = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = [
        _field(1, _field(1, "".join(alphabet[b] for b in t).encode()) + _field(2, -float(ranks[t])) + _field(3, 1))
        for t in ordered
    ]
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(ordered) + 1) + _field(24, 0) + _field(40, len(ordered))
    trainer += _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + unknown + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes and decodes whole texts. A text's matches of ``pattern`` are encoded apart, so
    what stands between single spaces and line feeds can be: such chunks are kept with their
    ids (up to CACHE of them); texts with other white space go through the pattern whole."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex
        import sentencepiece

        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.map = {b: c for b, c in enumerate(byte_alphabet())}
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        self.token = {i: t for t, i in ranks.items()}
        self.cache: dict[str, tuple[str, bytes]] = {}

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text. Distinct matches of the pattern are encoded once, in one call;
        a match that is a token itself takes that token's id."""
        matches = [[t] if t.isascii() and t.lstrip(" ").isalpha() and t[1:].isalpha() else self.pattern.findall(t) for t in texts]
        ids: dict[str, list[int]] = {}
        left, mapped = [], []
        for match in {m for found in matches for m in found}:
            data = match.encode()
            rank = self.ranks.get(data)
            if rank is not None:
                ids[match] = [rank]
            else:
                left.append(match)
                mapped.append(data.decode("latin-1").translate(self.map))
        ids.update(zip(left, self.sp.encode(mapped, num_threads=1) if left else []))
        return [[i for m in found for i in ids[m]] if len(found) != 1 else ids[found[0]] for found in matches]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def round_trips(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """For each text (the decimal ids joined by commas, the bytes decoded from them)."""
        parts = [chunks(t) for t in texts]
        new = list({c for p in parts for c in p} - self.cache.keys())
        known = {}
        for chunk, ids in zip(new, self.encode_all(new)):
            known[chunk] = ("," + ",".join(map(str, ids)) if ids else "", self.decode(ids))
        if len(self.cache) < CACHE:
            self.cache.update((c, v) for c, v in known.items() if len(c) < 64)
        kept = self.cache
        for p in parts:
            found = [kept.get(c) or known[c] for c in p]
            yield "".join([x[0] for x in found])[1:], b"".join([x[1] for x in found])


def chunks(text: str) -> list[str]:
    """Parts of a text that can be encoded apart and joined. Where words are set apart by
    single spaces or line feeds alone, each word (with the space before it) and line feed is
    a part: no match of the pattern reaches over those. Else the text is one part."""
    if " ".join(text.split()) != text.replace("\n", " "):
        return [text]
    lines = text.replace(" ", "\0 ").replace("\n", "\0\n\0")
    return lines.split("\0") if "\0" not in text else [text]


def encode_digests(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row. Null and empty texts have
    no tokens and the digests of nothing. Repeated rows come out as often as they came in; a very
    long text is matched whole; an empty table gives an empty one."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(read_ranks(vocabulary), pattern)
        for batch in small_batches(batches, "text"):
            rows = []
            for ids, data in codec.round_trips([t or "" for t in batch.column("text").to_pylist()]):
                rows.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(data).hexdigest()))
            n, a, b = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for each row; null and empty texts have no ids. Repeated rows come
    out as often as they came in; an empty table gives an empty one."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(read_ranks(vocabulary), pattern)
        for batch in small_batches(batches, "text"):
            ids = codec.encode_all([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids array<int>"
    )


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, data binary): the bytes of each row's ids; null ids give no bytes."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {i: t for t, i in read_ranks(vocabulary).items()}
        for batch in batches:
            data = [b"".join(map(token.__getitem__, ids or [])) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(
        run, f"doc_id {kind}, data binary"
    )
