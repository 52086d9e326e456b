"""Fill-in-the-middle: texts are cut in three at unit boundaries and written in another order.

A table-driven automaton reads the bytes of many texts once; each transition tells whether a
unit or a code point begins and whether a sentinel ends there. Counting those gives each
text's number of units; a second pass over the counted transitions locates the cuts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of, texts_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares of a hundred: documents that are left plain, and those of the others in the order suffix, prefix, middle.
PLAIN_FROM, SPM_BELOW = 90, 20

# Classes of bytes. A byte that no UTF-8 text holds stands between texts.
OTHER, LETTER, NAME, OPEN, CLOSE, FOLLOW, LEAD2, LEAD3, LEAD4, END = range(10)
# States: after something else, within letters, after "<", after "<" and a sentinel's letter,
# and with one to three bytes of a code point still to come.
START, WORD, OPENED, NAMED, MORE1, MORE2, MORE3 = range(7)
UNIT, POINT, SENTINEL = 1, 2, 4
BETWEEN = b"\xff"
LANE = 512


def _classes() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[[*range(65, 91), *range(97, 123)]] = LETTER
    kind[[ord(s[1]) for s in (PREFIX, SUFFIX, MIDDLE)]] = NAME
    kind[ord("<")], kind[ord(">")], kind[255] = OPEN, CLOSE, END
    kind[0x80:0xC0], kind[0xC0:0xE0], kind[0xE0:0xF0], kind[0xF0:0xF8] = FOLLOW, LEAD2, LEAD3, LEAD4
    return kind


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, what begins or ends) for each state and class."""
    after = {OTHER: START, LETTER: WORD, NAME: WORD, OPEN: OPENED, CLOSE: START, FOLLOW: START, LEAD2: MORE1, LEAD3: MORE2, LEAD4: MORE3, END: START}
    step, emit = np.zeros((7, 10), np.uint8), np.zeros((7, 10), np.uint8)
    for state in range(7):
        for kind, then in after.items():
            step[state, kind], emit[state, kind] = then, UNIT | POINT
            if kind in (LETTER, NAME) and state in (WORD, NAMED):
                emit[state, kind] = POINT
            if kind == END:
                emit[state, kind] = 0
    step[OPENED, NAME] = NAMED
    emit[NAMED, CLOSE] |= SENTINEL
    for state, then in ((MORE1, START), (MORE2, MORE1), (MORE3, MORE2)):
        step[state, FOLLOW], emit[state, FOLLOW] = then, 0
    return step, emit


CLASS = _classes()
STEP, EMIT = _tables()


def transitions(data: bytes) -> np.ndarray:
    """What each byte's transition emits, as the automaton started at the first byte has it.

    The bytes are laid in lanes that are read side by side: first from every state, which
    gives each lane as a map of states; these are chained to each lane's true first state,
    from which the states within the lanes follow.
    """
    n = len(data)
    lanes = max(1, -(-n // LANE))
    kinds = np.full(lanes * LANE, END, np.uint8)
    kinds[:n] = CLASS[np.frombuffer(data, np.uint8)]
    columns = np.ascontiguousarray(kinds.reshape(lanes, LANE).T)
    flat = STEP.ravel()
    at = np.tile(np.arange(7, dtype=np.uint8), (lanes, 1))
    for column in columns:
        at = flat[at * 10 + column[:, None]]
    state, first = START, np.empty(lanes, np.uint8)
    for lane, ends in enumerate(at.tolist()):
        first[lane] = state
        state = ends[state]
    states = np.empty((LANE, lanes), np.uint8)
    for i, column in enumerate(columns):
        states[i] = first
        first = flat[first * 10 + column]
    return EMIT.ravel()[states * 10 + columns].T.ravel()[:n]


def arranged(texts: list[bytes], hashes: list[list[int]]) -> list[tuple]:
    """(n, form, prefix_chars, middle_chars, output) of each text by its four numbers."""
    data = BETWEEN.join(texts) + BETWEEN
    emitted = transitions(data)
    units = np.flatnonzero(emitted & UNIT)
    points = np.concatenate([[0], np.cumsum((emitted & POINT) > 0)])
    sentinels = np.flatnonzero(emitted & SENTINEL)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    starts = ends - [len(t) for t in texts]
    first, last = np.searchsorted(units, starts), np.searchsorted(units, ends)
    marked = np.searchsorted(sentinels, starts) < np.searchsorted(sentinels, ends)
    rows: list[tuple] = []
    for text, (h1, h2, h3, h4), start, end, a, b, has in zip(texts, hashes, starts.tolist(), ends.tolist(), first.tolist(), last.tolist(), marked.tolist()):
        n = b - a
        if not n or has or h3 % 100 >= PLAIN_FROM:
            rows.append((n, "plain", None, None, text))
            continue
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        i, j = (int(units[a + k]) if k < n else end for k in (low, high))
        prefix, middle, suffix = text[: i - start], text[i - start : j - start], text[j - start :]
        chars = int(points[i] - points[start]), int(points[j] - points[i])
        if h4 % 100 < SPM_BELOW:
            rows.append((n, "spm", *chars, b"".join((SUFFIX.encode(), suffix, PREFIX.encode(), prefix, MIDDLE.encode(), middle))))
        else:
            rows.append((n, "psm", *chars, b"".join((PREFIX.encode(), prefix, SUFFIX.encode(), suffix, MIDDLE.encode(), middle))))
    return rows


def rearrange(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form plain | psm | spm, prefix_chars, middle_chars, output) for each row.

    n counts units: runs of A-Z and a-z, and every other code point. The cuts, whether a text
    is left plain and its order come from the hash of ``<seed>:<id>``, so a row's result depends
    on the row alone; a null id counts as empty there. An empty or null text and one that holds
    a sentinel are left plain, with null counts. A byte that is part of no code point counts as
    one. Repeated rows give equal rows; an empty table an empty one. A very long text is read
    whole, with some thirty bytes of memory for each of its bytes.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    numbers = F.array(*[F.conv(F.substring(digest, k, 8), 16, 10).cast("long") for k in (1, 9, 17, 25)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            rows = arranged(texts_of(batch, "text"), batch.column("numbers").to_pylist())
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
            )

    given = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), numbers.alias("numbers"))
    found = given.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return found.withColumn("output", F.col("output").cast("string"))


def restored(form: Column, output: Column) -> Column:
    """The text that ``rearrange`` was given (null texts as empty), from form and output alone."""
    one, two = F.lit(1), F.lit(2)
    part = lambda text, mark, k: F.split_part(text, F.lit(mark), k)
    after_first = {"psm": part(output, PREFIX, two), "spm": part(output, SUFFIX, two)}
    psm = part(after_first["psm"], SUFFIX, one), part(output, MIDDLE, two), part(part(output, SUFFIX, two), MIDDLE, one)
    spm = part(part(output, PREFIX, two), MIDDLE, one), part(output, MIDDLE, two), part(after_first["spm"], PREFIX, one)
    return F.when(form == "psm", F.concat(*psm)).when(form == "spm", F.concat(*spm)).otherwise(output)


def round_trips(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) for each row;
    nulls, repeats and empty tables as in ``rearrange``."""
    found = rearrange(docs, seed, id_col, text_col)
    back = restored(F.col("form"), F.col("output"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )


def oracle_sql(seed: int = 1) -> str:
    """DuckDB SQL for the rows of ``round_trips``: units as a list, cut and joined."""
    h = [f"CAST('0x' || substr(d, {k}, 8) AS BIGINT)" for k in (1, 9, 17, 25)]
    return f"""
        WITH u AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                   sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
            FROM documents
        ), c AS (
            SELECT doc_id, t, u, len(u) AS n, least({h[0]} % (len(u) + 1), {h[1]} % (len(u) + 1)) AS a, greatest({h[0]} % (len(u) + 1), {h[1]} % (len(u) + 1)) AS b,
                   CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR {h[2]} % 100 >= {PLAIN_FROM} THEN 'plain'
                        WHEN {h[3]} % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form
            FROM u
        ), p AS (
            SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n, form,
               CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p
    """
