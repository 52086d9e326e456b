import hashlib
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, simhash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(UPPER)


def brute_fingerprint(text, n=3):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_near(rows):
    fps = {t: brute_fingerprint(t) for _, t in rows}
    found = sorted(set(fps.values()))
    parent = {f: f for f in found}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(found, 2):
        if (a ^ b).bit_count() <= 2:
            parent[root(a)] = root(b)
    least = {}
    for i, t in rows:
        r = root(fps[t])
        known = [x for x in (least.get(r), i) if x is not None]
        least[r] = min(known) if known else None
    return sorted(((i, f"{fps[t]:016x}", least[root(fps[t])]) for i, t in rows), key=repr)


def check_near(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits(F.col("fp")), "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_near(rows)


def test_near_duplicates_are_those_of_brute_force(some_docs):
    check_near(some_docs)


def test_near_duplicates_of_odd_rows(odd_docs):
    check_near(odd_docs)


def test_near_chain_and_empty(spark, no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    fps = [0, 3, 15, 63, 1 << 63, -1, 1 << 40]
    signed = [f - (1 << 64) if f >> 63 == 1 else f for f in fps]
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    want = {tuple(sorted((a, b))) for a, b in combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert {(r.a, r.b) for r in got} == want


def test_keyed_fingerprints_are_not_sent_out(spark, tmp_path):
    """A small table is 28 times as large once it is keyed, which Spark's sizes do not tell."""
    spark.range(300).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "fps"))
    plan = simhash.links(spark.read.parquet(str(tmp_path / "fps")))._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_one_row_of_each_near_group_stays(odd_docs):
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    got = {r.doc_id for r in kept.collect()}
    assert got == {c for _, _, c in brute_near([(r.doc_id, r.text) for r in odd_docs.collect()])}


def brute_exact(rows, best=max):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[lower(t)]
        known = [x for x in ids if x is not None]
        keep = best(known) if known else None
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_duplicates(odd_docs, some_docs, no_docs):
    for docs in (odd_docs, some_docs):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        for keep, best in (("max", max), ("min", min)):
            got = exact_dedup.exact_duplicates(docs, keep).collect()
            assert sorted(map(tuple, got), key=repr) == brute_exact(rows, best)
    assert exact_dedup.exact_duplicates(no_docs).count() == 0


def test_texts_that_share_a_hash_stay_apart(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = exact_dedup.exact_duplicates(odd_docs, "max", hash128=lambda t: F.substring(t, 1, 1)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_exact(rows)


def test_drop_exact_duplicates(odd_docs):
    kept = exact_dedup.drop_exact_duplicates(odd_docs, "max")
    assert kept.columns == odd_docs.columns
    got = sorted(((r.doc_id, lower(r.text)) for r in kept.collect()), key=repr)
    assert len(got) == len({t for _, t in got}) == len({lower(r.text) for r in odd_docs.collect()})
    assert (999, "one") in got and (120, "this is under the mit license.") in got


def shingles(text, n=5):
    words = lower(text).split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def grouped(rows, at_least):
    """Components of the pairs whose exact Jaccard similarity is at least so much."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if len(sets[a] & sets[b]) >= at_least * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    return [root(i) for i in range(len(rows))]


def check_alike(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    component = {(str(r.doc_id)): r.component_id for r in simhash.like_groups(docs).collect()}
    near, far = grouped(rows, 0.86), grouped(rows, 0.7)
    by_near, by_component = {}, {}
    for (i, _), n, f in zip(rows, near, far):
        if i not in (None, 20, 30):  # ids with several texts
            by_near.setdefault(n, set()).add(component[str(i)])
            by_component.setdefault(component[str(i)], set()).add(f)
    assert all(len(x) == 1 for x in by_near.values()) and all(len(x) == 1 for x in by_component.values())


def test_like_texts_are_grouped_and_others_are_not(some_docs, odd_docs, no_docs, spark):
    check_alike(some_docs)
    check_alike(odd_docs)
    assert simhash.like_groups(no_docs).count() == 0
    words = [f"w{i}" for i in range(300)]
    rows = [(7, " ".join(words)), (3, " ".join([*words[:100], "other", *words[101:]])), (5, " ".join(words[:40])), (9, " ".join(words).upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.like_groups(df).collect()} == {7: 3, 3: 3, 9: 3, 5: 5}
    assert sorted(r.doc_id for r in simhash.drop_like_texts(df).collect()) == [3, 5]
    assert simhash.drop_like_texts(odd_docs).columns == odd_docs.columns


def test_wide_bits_are_majorities_over_distinct_shingles():
    text = ("a b c d e f g h " * 3).encode()
    got, n = simhash.wide_fingerprint(text)
    hashes = {xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles(text.decode())}
    mask, want = (1 << 64) - 1, []
    for k in range(1, simhash.WIDE + 1):
        ones = [0] * 64
        for h in hashes:
            z = (h + k * 0x9E3779B97F4A7C15) & mask
            z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & mask
            z = ((z ^ z >> 27) * 0x94D049BB133111EB) & mask
            z ^= z >> 31
            for j, b in enumerate(z.to_bytes(8, "little")):
                for i in range(8):
                    ones[8 * j + i] += b >> (7 - i) & 1
        want += [2 * o > len(hashes) for o in ones]
    assert n == len(hashes) and [bool(int.from_bytes(got, "big") >> (64 * simhash.WIDE - 1 - i) & 1) for i in range(64 * simhash.WIDE)] == want


def templated(rng, base, at, changes):
    words = list(base)
    for i in rng.choice(at, changes, replace=False):
        words[i] = f"n{rng.integers(1 << 40)}"
    return words


def test_all_members_of_a_block_are_compared(spark):
    """Forms filled in differently share many blocks with each other; copies among them are
    found though a stranger is the first of most of their blocks."""
    import numpy as np

    rng = np.random.default_rng(3)
    form = [f"w{i}" for i in range(200)]
    strangers = [templated(rng, form, 200, 16) for _ in range(400)]
    pairs = [(words, templated(rng, words, 200, 3)) for words in (templated(rng, form, 200, 16) for _ in range(20))]
    texts = [" ".join(t) for t in strangers + [t for p in pairs for t in p]]
    rows = list(enumerate(texts))
    assert max(len(shingles(texts[0]) & shingles(x)) / len(shingles(texts[0]) | shingles(x)) for x in texts[1:]) < 0.75
    component = {r.doc_id: r.component_id for r in simhash.like_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [component[i] for i in range(401)] == list(range(401))
    assert [component[400 + 2 * i + 1] for i in range(20)] == [400 + 2 * i for i in range(20)]


def test_similarity_is_exact(spark):
    """Sets at 0.8 itself are linked, those just below are not, short ones as long ones."""
    base = [f"w{i}" for i in range(10)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:9], "other"]))]  # 5 of 7
    want = {1: 1, 2: 2}
    for k in range(40):  # 4 of 5, and 3 of 4
        short = [f"s{k}_{i}" for i in range(9)]
        other = [f"t{k}_{i}" for i in range(8)]
        rows += [(100 + 2 * k, " ".join(short)), (101 + 2 * k, " ".join(short[:8])), (300 + 2 * k, " ".join(other)), (301 + 2 * k, " ".join(other[:7]))]
        want |= {100 + 2 * k: 100 + 2 * k, 101 + 2 * k: 100 + 2 * k, 300 + 2 * k: 300 + 2 * k, 301 + 2 * k: 301 + 2 * k}
    for k in range(20):  # 200 of 250, and 199 of 250
        long = [f"l{k}_{i}" for i in range(254)]
        less = [f"m{k}_{i}" for i in range(254)]
        rows += [(500 + 2 * k, " ".join(long)), (501 + 2 * k, " ".join(long[:204])), (700 + 2 * k, " ".join(less)), (701 + 2 * k, " ".join(less[:203]))]
        want |= {500 + 2 * k: 500 + 2 * k, 501 + 2 * k: 500 + 2 * k, 700 + 2 * k: 700 + 2 * k, 701 + 2 * k: 701 + 2 * k}
    assert {r.doc_id: r.component_id for r in simhash.like_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_cluster_pairs_lose_none(spark):
    """Of edited sets, few and many edits, from few values and from many, short and long, all that are alike are
    found by what they differ in from any pivot."""
    import numpy as np

    rng = np.random.default_rng(5)
    for similarity in (0.8, 0.55):
        members, sets = [], {}
        for cluster in range(12):
            base, values = rng.choice(10_000, 40, replace=False), (30, 300, 1 << 30)[cluster % 3]
            for _ in range(60):
                own = set(base[rng.random(40) < 1 - 0.3 * rng.random()].tolist()) | set((20_000 + rng.integers(0, values, rng.integers(0, 14))).tolist())
                i = len(sets)
                sets[i] = own
                members.append((i, i, int(rng.integers(0, 9)), cluster, 1000 + i))
        pairs, links = simhash.cluster_pairs(
            spark.createDataFrame(members, "id long, root long, weight long, cluster long, node long"),
            spark.createDataFrame([(1000 + i, sorted(x)) for i, x in sets.items()], "node long, set array<int>"), similarity,
        )
        alike = lambda a, b: len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9
        every = [(m[0], n[0]) for m, n in combinations(members, 2) if m[3] == n[3]]
        pairs, links = [(r.a, r.b) for r in pairs.collect()], [(r.a, r.b) for r in links.collect()]
        assert all(alike(*p) for p in links) and len(set(pairs)) == len(pairs)

        def roots(found):
            parent = list(range(len(sets)))
            for a, b in found:
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                parent[max(a, b)] = min(a, b)
            for i in range(len(parent)):
                parent[i] = parent[parent[i]]
            return parent

        assert roots(links + [p for p in pairs if alike(*p)]) == roots([p for p in every if alike(*p)])


def test_pairs_of_a_large_group_are_few(spark, monkeypatch):
    """Texts edited from one, most of them not alike to 0.8 but in one block with many others: what is
    compared is a small multiple of the texts, and the groups are those of all pairs."""
    import numpy as np

    rng, compared, verified = np.random.default_rng(8), [], simhash._verified

    def counted(pairs, *more):
        compared.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(simhash, "_verified", counted)
    form = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(templated(rng, form, 150, int(rng.integers(1, 10))))) for i in range(600)]
    component = {r.doc_id: r.component_id for r in simhash.like_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    least = {}
    for i, n in enumerate(grouped(rows, 0.8 - 1e-9)):
        least.setdefault(n, []).append(i)
    assert component == {i: min(x) for x in least.values() for i in x}
    assert sum(compared) < 50 * len(rows), compared
