"""SimHash near-duplicate detection with pigeonhole blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..operators.components import connected_components
from .common import intermediates, kept, materialise, small_batches, texts_of, unused

SEED = 42
CHUNK = 1 << 15


def fingerprint(text: bytes, words: int = 3) -> int:
    """The 64-bit SimHash of a text as an unsigned integer; 0 for a text without words."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = tokens[at : min(at + CHUNK, n) + words - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(words)))) if len(part) >= words else [b" ".join(part)]
        hashes = np.fromiter((xxh64_intdigest(g, SEED) for g in grams), dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the SimHash of each whole text, as a signed long. Null is the empty text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            fps = np.array([fingerprint(t, words) for t in texts_of(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, fp long"
    )


def block_masks(max_bits: int, blocks: int) -> list[int]:
    """Fingerprints that differ in at most ``max_bits`` bits differ in at most that many of
    ``blocks`` blocks, so they agree on the others: one mask for each choice of those."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    ones = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [sum(ones[i] for i in kept) for kept in combinations(range(blocks), blocks - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, max_bits: int = 2, blocks: int = 8) -> DataFrame:
    """``fps`` (fp, distinct) -> (a, b), a < b: every pair within ``max_bits`` bits.

    Each fingerprint goes out once for each mask; the self-join on the masked value keeps
    the pairs that pass the distance check. With 8 blocks and 2 bits a key fixes 48 of the 64 bits, so
    a key has few fingerprints even in a large group of near copies (equal fingerprints
    were made one row before). Spark sizes an exploded table by what it was made of, so it
    would send one of 28 times that to all tasks: the join is told to sort and merge.
    """
    masks = [_signed(m) for m in block_masks(max_bits, blocks)]
    keyed = fps.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])
        ).alias("b"),
    ).select("fp", F.col("b.m").alias("m"), F.col("b.k").alias("k"))
    other = keyed.select(F.col("fp").alias("b"), "m", "k")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return keyed.withColumnRenamed("fp", "a").hint("merge").join(other, ["m", "k"]).filter(F.col("a") < F.col("b")).filter(near).select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame,
    words: int = 3,
    max_bits: int = 2,
    blocks: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``.

    Texts are lower-cased in A-Z only and split at ASCII white space; the shingles of
    ``words`` words count with their repeats. A text of fewer words is one shingle, a text
    without words (or null) has fingerprint 0. Rows whose fingerprints differ in at most
    ``max_bits`` bits are linked; component_id is the smallest doc_id reachable. A row with
    a null doc_id takes part; repeated rows come out as often as they came in; component_id
    is null only if no row of its component has an id. An empty table gives an empty one.

    Rows with one fingerprint are made one class first, so copies never meet each other
    in a join; what is joined back on the class is (doc_id, fp) alone.
    """
    rows = materialise(fingerprints(docs, words, id_col, text_col), "simhash")
    classes = materialise(rows.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = connected_components(links(classes.select(F.col("node").alias("fp")), max_bits, blocks))
    component = named(classes, roots).withColumnRenamed("node", "fp")
    return rows.join(component, "fp").select("doc_id", "fp", "component_id")


def named(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """``classes`` (node, least) and ``roots`` (node, root; nodes without links may be left out)
    -> (node, component_id): the smallest ``least`` of each component. A component with more
    than a thousandth of all nodes (so at most a thousand of them) is sent to the tasks; the
    others are joined by root."""
    known = classes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    known = materialise(known, "rooted")
    names = materialise(known.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "named")
    large = F.col("n") > F.lit(known.count() / 1000)
    sent = names.filter(large).select("root", F.struct("component_id").alias("hit"))
    parted = known.join(F.broadcast(sent), "root", "left")
    return materialise(
        parted.filter("hit IS NOT NULL").select("node", "hit.component_id")
        .union(parted.filter("hit IS NULL").join(names.filter(~large), "root").select("node", "component_id")),
        "components",
    )


def drop_near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each component those with its smallest
    id (a row without an id stays only if its component has none). Nulls, repeats, long texts and
    empty tables as in ``near_duplicates``."""
    found = near_duplicates(docs, words, max_bits, id_col=id_col, text_col=text_col)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(kept_id := unused(docs, "kept_id"))).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)), "left_semi")


def hex_digits(fp: Column) -> Column:
    """A signed long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- groups of like texts: more bits, for similarities that a few bits of 64 cannot tell
WIDE = 24
#: Chance that a pair just alike enough shares a band.
RECALL = 0.99
#: How many standard deviations a pair's bits may differ more than expected before its sets are not compared.
SLACK = 4
#: Sets of at most so many shingles meet by their smallest hashes.
SHORT = 8
#: Below so many shingles bits say too little to rule a pair out.
FEW = 64
NEEDED_BITS = 24


def _differ(similarity: float) -> float:
    """The share of SimHash bits in which two sets of equal size and that Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _limit(bits: int, similarity: float) -> int:
    share = _differ(similarity)
    return math.ceil(bits * share + SLACK * math.sqrt(bits * share * (1 - share)))


def band_plan(nodes: int, similarity: float, recall: float = RECALL) -> np.ndarray:
    """[band, bit]: which bits make up each band, drawn once. A band has 20 bits, and more where
    there are more than 2^23 nodes, so that chance strangers in a block stay few; there are as
    many bands as the recall takes at any size."""
    size = min(48, max(20, (nodes - 1).bit_length() - 3))
    bands = math.ceil(math.log(1 - recall) / math.log(1 - (1 - _differ(similarity)) ** size))
    rng = np.random.default_rng(SEED)
    return np.stack([rng.choice(64 * WIDE, size, replace=False) for _ in range(bands)])


def shingle_hashes(text: bytes, words: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted."""
    tokens = text.lower().split()
    n = max(1, len(tokens) - words + 1)
    grams = map(b" ".join, zip(*(tokens[i:] for i in range(words)))) if len(tokens) >= words else [b" ".join(tokens)]
    return np.unique(np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64, n))


def wide_bits(hashes: np.ndarray) -> bytes:
    """64 * WIDE bits of SimHash over a set of hashes."""
    ones = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(hashes), 255):  # so that a byte holds the sum
        part = hashes[at : at + 255, None] + _STEPS[None, :]
        part = (part ^ part >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        part = (part ^ part >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        part ^= part >> np.uint64(31)
        ones += np.unpackbits(part.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def wide_fingerprint(text: bytes, words: int = 5) -> tuple[bytes, int]:
    """(64 * WIDE bits of SimHash over the distinct shingles, their number)."""
    hashes = shingle_hashes(text, words)
    return wide_bits(hashes), len(hashes)


_STEPS = np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _band_keys(prints: np.ndarray, plan: np.ndarray) -> np.ndarray:
    """[row, band] keys of uint8 [row, bytes]; a key tells its band."""
    bits = np.unpackbits(prints, axis=1)[:, plan].astype(np.int64)
    return (bits << np.arange(plan.shape[1])).sum(axis=2) * len(plan) + np.arange(len(plan))


def _node(hashes: np.ndarray) -> int:
    """A set of shingles by the 64-bit hash of its sorted hashes."""
    return _signed(xxh64_intdigest(hashes.tobytes(), SEED))


STARS = 3
#: Members of a block beyond which they are not compared each with each (see ``dense_pairs``).
DENSE = 8
#: Bits of the sketch that goes with each band: a long and half of one.
SKETCH = 96


def _block_keys(classes: DataFrame, plan: np.ndarray) -> DataFrame:
    """``classes`` (id, root, fp, prefix) -> (k, id, root, s, t): a row for each band of the plan
    with SKETCH bits to compare, and for each hash of the prefix (with none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 20) // plan.size)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                prints = part.column("fp").flatten().to_numpy().view(np.uint8).reshape(part.num_rows, -1)
                s, t = np.ascontiguousarray(prints[:, :8]).view(np.int64)[:, 0], np.ascontiguousarray(prints[:, 8:12]).view(np.uint32)[:, 0].astype(np.int64)
                prefix = [np.frombuffer(x, np.int64) for x in part.column("prefix").to_pylist()]
                n, m = np.full(part.num_rows, len(plan)), np.array([len(x) for x in prefix])
                columns = [
                    np.concatenate([_band_keys(prints, plan).ravel(), *prefix]),
                    *(np.concatenate([np.repeat(x, n), np.repeat(x, m)]) for x in (part.column(c).to_numpy() for c in ("id", "root"))),
                    *(np.concatenate([np.repeat(x, n), np.zeros(m.sum(), x.dtype)]) for x in (s, t)),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k", "id", "root", "s", "t"])

    return classes.select("id", "root", "fp", "prefix").mapInArrow(run, "k long, id long, root long, s long, t long")


def _distance(x: str, y: str) -> Column:
    differ = [F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in ("s", "t")]
    return differ[0] + differ[1]


def _near_bits(x: str, y: str, similarity: float) -> Column:
    return _distance(x, y) <= _limit(SKETCH, similarity)


def first_pairs(keyed: DataFrame, similarity: float) -> DataFrame:
    """(a, b): for each component (root) its closest meeting with the lowest member of a block that
    is in another one, so at most one row a component."""
    first = keyed.groupBy("k").agg(F.min_by(F.struct("id", "root", "s", "t"), "id").alias("f"), F.max("root").alias("last"), F.min("root").alias("low"))
    first = materialise(first.filter("low < last").select("k", "f.*"), "like-blocks")
    found = keyed.alias("x").join(first.alias("y"), F.col("x.k") == F.col("y.k")).filter("x.root <> y.root").filter(_near_bits("x", "y", similarity))
    pair = F.struct(_distance("x", "y").alias("d"), F.col("y.id").alias("a"), F.col("x.id").alias("b"))
    return found.groupBy(F.col("x.root").alias("root")).agg(F.min(pair).alias("p")).select("p.a", "p.b").distinct()


def block_pairs(keyed: DataFrame, classes: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame | None]:
    """((a, b), links): all pairs that share a block, but those already in one component (root), and
    those of the members of dense blocks that can be alike at all; links found on the way, if any.
    Blocks of one component alone, or of one member, are left out before: they meet nobody."""
    block = Window.partitionBy("k")
    mixed = keyed.select("*", F.min("root").over(block).alias("low"), F.max("root").over(block).alias("high"), F.count("*").over(block).alias("n"))
    mixed = materialise(mixed.filter("low < high").drop("low", "high"), "like-mixed")
    small, dense = mixed.filter(F.col("n") <= DENSE).drop("n"), mixed.filter(F.col("n") > DENSE)
    found = small.alias("x").join(small.alias("y"), F.col("x.k") == F.col("y.k"))
    found = found.filter("x.id < y.id and x.root <> y.root").filter(_near_bits("x", "y", similarity))
    pairs = found.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    if dense.isEmpty():
        return pairs.distinct(), None
    more, links = dense_pairs(dense, classes, sets, similarity)
    return pairs.union(more).distinct(), links


def dense_pairs(dense: DataFrame, classes: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """((a, b), links) of the blocks in ``dense`` (k, id, root, s, t, n: the block's members).

    The member of most and largest blocks is the hub of each; what is near a hub by its sketch is in one
    cluster with it. Pairs inside a cluster come from ``cluster_pairs``; a member of a block that is not in
    the hub's cluster (a stranger, by chance) is compared with all of the block."""
    members = dense.groupBy("id").agg(F.first("root").alias("root"), F.sum("n").alias("weight"))
    members = materialise(members, "like-members")
    dense = materialise(dense.join(members.select("id", "weight"), "id"), "like-dense")
    hubs = dense.groupBy("k").agg(F.max_by(F.struct("id", "s", "t"), F.struct("weight", "id")).alias("hub")).select("k", "hub.*")
    hubs = materialise(hubs, "like-hubs")
    reached = dense.alias("x").join(hubs.alias("y"), F.col("x.k") == F.col("y.k")).filter("x.id <> y.id").filter(_near_bits("x", "y", similarity))
    clusters = connected_components(reached.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))).select(F.col("node").alias("id"), F.col("root").alias("cluster"))
    of = lambda rows: rows.join(clusters, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    known = materialise(of(dense).join(of(hubs).select("k", F.col("cluster").alias("main")), "k"), "like-dense")
    others = known.filter("cluster <> main").alias("x").join(known.alias("y"), F.col("x.k") == F.col("y.k"))
    others = others.filter("x.cluster <> y.cluster and x.root <> y.root and (y.cluster = y.main or x.id < y.id)").filter(_near_bits("x", "y", similarity))
    pairs, links = cluster_pairs(members.join(clusters, "id").join(classes.select("id", "node"), "id"), sets, similarity)
    return others.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).union(pairs), links


def cluster_pairs(members: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """((a, b), links) of ``members`` (id, root, weight, cluster, node): every pair of a cluster that may be
    alike is among the pairs, in one component already, or joined by the links; none is lost.

    A cluster's pivot is its member of most weight. A member is held by what its set and the pivot's differ
    in. Two sets of m and n hashes are alike if they differ in at most (1 - s) / (1 + s) * (m + n) of them.
    What is so near the pivot is linked to it. Any other (far) differs from each set alike in less than both
    differ from the pivot together, so the two differ from the pivot in common hashes, at least

    * (d + e - (1 - s) / (1 + s) * (m + n)) / 2 of them, with d and e what they differ in from the pivot.

    So of the hashes by which one of them differs, rarest in the cluster first, all but so many less one are
    a prefix in which the first common one lies. In a text filled in or edited on its own most of those are
    nobody else's. The prefixes are cut for any partner in the join, for the very partner in its condition."""
    spread = (1 - similarity) / (1 + similarity)
    members = materialise(members, "like-members")
    made = _sets_of(members.select("node"), sets)
    top = F.max_by(F.struct("id", "node"), F.struct("weight", "id")).alias("top")
    pivots = members.groupBy("cluster").agg(top).select("cluster", F.col("top.id").alias("pivot"), F.col("top.node").alias("node"))
    pivots = materialise(pivots.join(made, "node").select("cluster", "pivot", F.col("set").alias("core")), "like-pivots")
    told = members.join(made, "node").join(pivots, "cluster").select(
        "id", "root", "cluster", "pivot", F.size("set").alias("size"), F.size("core").alias("core"),
        F.concat(F.array_except("set", "core"), F.array_except("core", "set")).alias("differ"),
    )
    told = told.withColumn("d", F.size("differ")).withColumn("far", ~_alike((F.col("size") + F.col("core") - F.col("d")) / 2, F.col("size") + F.col("core"), similarity))
    # how many hashes are shared at least: with a far one, of a near one; with one as far or farther, of a far one
    near_shares = F.floor((F.col("d") + spread * (F.col("core") - F.col("size"))) / 2 + 1e-9) + 1
    far_shares = F.ceil(F.col("d") - spread * (1 + 1 / similarity) / 2 * F.col("size") - 1e-6)
    told = told.withColumn("prefix", F.col("d") + 1 - F.greatest(F.lit(1), F.when(F.col("far"), far_shares).otherwise(near_shares)))
    told = materialise(told, "like-told")
    parts = told.select("id", "root", "cluster", "size", "d", "far", "prefix", F.explode("differ").alias("h"))
    shared = materialise(parts.groupBy("cluster", "h").agg(F.count("*").alias("n")).filter("n > 1"), "like-shared")
    ranked = parts.join(shared, ["cluster", "h"], "left")
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("n", F.lit(1)), "h")))
    ranked = materialise(ranked.filter("n > 1 and (far or place <= prefix)"), "like-ranked")
    met = ranked.filter("far").alias("x").join(ranked.filter("place <= prefix").alias("y"), ["cluster", "h"])
    met = met.filter("x.root <> y.root and (not y.far or x.d > y.d or x.d = y.d and x.id > y.id)")
    shares = (F.col("x.d") + F.col("y.d") - spread * (F.col("x.size") + F.col("y.size"))) / 2
    met = met.filter(F.least(F.col("x.d") - F.col("x.place"), F.col("y.d") - F.col("y.place")) + 1 >= shares - 1e-6)
    links = told.filter("not far and id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct(), links


def _with_prints(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b, na, nb): the pairs whose whole wide fingerprints do not rule the similarity out, with
    the hashes of their sets."""
    side = lambda s: classes.select(F.col("id").alias(s), *(F.col(c).alias(c[0] + s) for c in ("node", "fp", "size")))
    differ = F.aggregate(F.zip_with("fa", "fb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    return met.filter((F.least("sa", "sb") < FEW) | (differ <= _limit(64 * WIDE, similarity))).select("a", "b", "na", "nb")


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose ``sets`` (node, set) of shingle hashes have that Jaccard similarity. Only
    sets of nodes in pairs are dealt out: a bit map of fixed size tells them (and a few others)."""
    with intermediates(pairs.sparkSession):
        return kept(_counted(materialise(_with_prints(pairs, classes, similarity), "like-pairs"), sets, similarity), "like-links")


def _sets_of(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, set), once each, of ``nodes`` (node) and a few others."""
    node, size = F.col("node"), (1 << NEEDED_BITS) - 1
    word = F.shiftright(node.bitwiseAND(F.lit(size)), 6)
    bits = nodes.groupBy(word.alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(node & 63 as int))")).alias("m"))
    made = sets.join(F.broadcast(bits), word == F.col("w")).filter("shiftright(m, cast(node & 63 as int)) & 1 = 1")
    return materialise(made.groupBy("node").agg(F.first("set").alias("set")), "like-sets")


def _alike(common: Column, sizes: Column, similarity: float) -> Column:
    """Whether two sets with so many common members, and so many each together, have that Jaccard similarity."""
    return common >= similarity * (sizes - common) - 1e-9


def _counted(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    made = _sets_of(pairs.select(F.explode(F.array("na", "nb")).alias("node")), sets)
    side = lambda s: made.select(F.col("node").alias("n" + s), F.col("set").alias("s" + s))
    common = F.size(F.array_intersect("sa", "sb"))
    met = pairs.join(side("a"), "na").join(side("b"), "nb").select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), common.alias("common"))
    return met.filter(_alike(F.col("common"), F.col("n"), similarity)).select("a", "b")


def like_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """(doc_id, component_id) for each row of ``docs``: texts whose sets of ``words``-word
    shingles have a Jaccard similarity of ``similarity``, counted on their hashes, are
    linked; component_id is the smallest doc_id reachable. Nulls, repeats and empty tables as in
    ``near_duplicates``.

    Sets meet where they agree in one band of their 1536 SimHash bits. No number of blocks that
    is of use guarantees this for pairs that differ in 15 bits of 100, as pigeonhole blocks do
    for two of 64; the bands are as many as ``recall`` takes for pairs just alike enough (see
    ``band_plan``), and pairs more alike meet more surely. Sets of at most SHORT shingles meet by
    their smallest hashes instead, which loses none.

    No pair of a block is left out. So that a group of n copies does not give n * n pairs,
    components grow first: STARS times each component's closest meeting with the
    first of a block (in a quarter of the bands, dealt out over the times) is verified, and what is
    linked then is not compared again: its ends are in one component. Members of blocks of more than
    DENSE are told by what they differ in from one of them, so that of a large group alike, but not
    alike enough, only those meet that share differences (``cluster_pairs``; it loses no pair).

    Sets are held as 32-bit hashes: two sets of 400 have a chance of one in 25,000 to seem to share
    a shingle more than they do.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sets = [shingle_hashes(t, words) for t in texts_of(batch, "text")]
            prefix = [x[: len(x) - math.ceil(similarity * len(x) - 1e-9) + 1].tobytes() if len(x) <= SHORT / similarity else b"" for x in sets]
            bits = np.frombuffer(b"".join(map(wide_bits, sets)), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([_node(x) for x in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * WIDE), pa.array(bits)),
                 pa.array(prefix, pa.binary()), pa.array([np.unique((x >> np.uint64(32)).astype(np.uint32)).view(np.int32) for x in sets], pa.list_(pa.int32()))],
                ["doc_id", "node", "fp", "prefix", "set"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(prints, f"doc_id {kind}, node long, fp array<bigint>, prefix binary, set array<int>")
    rows = materialise(rows, "like-rows")
    sets = rows.select("node", "set")
    classes = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix"), F.first(F.size("set")).alias("size"))
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "like-classes")  # small numbers, fixed once written
    with intermediates(docs.sparkSession):
        plan = band_plan(classes.count(), similarity, recall)
        links = None
        known = _rooted(classes, None)
        for bands in [*np.array_split(plan[: -(-len(plan) // 4)], STARS), None]:
            if bands is None:
                pairs, sure = block_pairs(_block_keys(known, plan), classes, sets, similarity)
            else:
                pairs, sure = first_pairs(_block_keys(known, bands), similarity), None
            for more in (_verified(pairs, classes, sets, similarity), sure):
                if more is not None:
                    links = more if links is None else links.union(more)
            roots = connected_components(links)
            known = _rooted(classes, roots)
        names = named(classes.select(F.col("id").alias("node"), "least"), roots).withColumnRenamed("node", "id")
        component = kept(classes.select("id", "node").join(names, "id").select("node", "component_id"), "like-components")
    return rows.select("doc_id", "node").join(component, "node").select("doc_id", "component_id")


def _rooted(classes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(id, root, fp, prefix) of every class; one without links is its own root."""
    if roots is None:
        return classes.withColumn("root", F.col("id")).select("id", "root", "fp", "prefix")
    known = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    return materialise(known.select("id", "root", "fp", "prefix"), "like-known")


def drop_like_texts(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay of each group of like texts: those with
    its smallest id (a row without an id stays only if its group has none; rows that repeat that
    id all stay). A null or empty text is a set of one shingle, the empty one; a very long text is
    read whole. An empty table gives an empty one."""
    found = like_groups(docs, words, similarity, id_col=id_col, text_col=text_col)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(kept_id := unused(docs, "kept_id"))).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)), "left_semi")
