import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import digest


def brute_features(text, rank):
    from xxhash import xxh64_intdigest

    if len(text) < 64:
        return [xxh64_intdigest(text)] if text else []
    ranks = [rank[int(digest.entropy_classes(np.frombuffer(text[i : i + 64], np.uint8))[0])] for i in range(len(text) - 63)]
    if len(ranks) < 64:
        return [xxh64_intdigest(text[(p := ranks.index(min(ranks))) : p + 64])]
    times = {}
    for g in range(len(ranks) - 63):
        p = min(range(g, g + 64), key=lambda i: (ranks[i], i))
        times[p] = times.get(p, 0) + 1
    return [xxh64_intdigest(text[p : p + 64]) for p in sorted(times) if times[p] >= 16]


def test_entropy_and_features():
    rng = np.random.default_rng(4)
    rank = rng.permutation(1001).astype(np.int32)
    texts = [bytes(rng.integers(97, 97 + k, n).astype(np.uint8)) for k, n in ((3, 300), (20, 64), (5, 126), (9, 127), (2, 10), (26, 700))] + [b"", b"z" * 400]
    for t in texts:
        counts = [np.bincount(np.frombuffer(t[i : i + 64], np.uint8)) for i in range(len(t) - 63)]
        bits = [6 - sum(c * np.log2(c) for c in x if c) / 64 for x in counts]
        assert np.allclose(digest.entropy_classes(np.frombuffer(t, np.uint8)), np.array(bits) / 6 * 1000, atol=1.5)
    assert digest.features(texts, rank) == [brute_features(t, rank) for t in texts]
    assert digest.features(texts[::-1], rank)[::-1] == digest.features(texts, rank)


def test_likeness():
    rank = np.arange(1001, dtype=np.int32)
    rng = np.random.default_rng(5)
    long = bytes(rng.integers(32, 127, 60_000).astype(np.uint8))
    a, b, c, none = digest.digests_of([long, long[:30_000] + bytes(rng.integers(32, 127, 30_000).astype(np.uint8)), bytes(rng.integers(32, 127, 9000).astype(np.uint8)), b""], rank)
    assert len(a) > 2 and digest.likeness(a, a) == 1 and digest.likeness(none, none) == 1 and digest.likeness(a, none) == 0
    assert 0.3 < digest.likeness(a, b) < 0.9 and digest.likeness(a, c) < 0.2 and digest.likeness(b, a) == digest.likeness(a, b)


def test_texts_without_a_popular_window_have_digests():
    rank = np.arange(1001, dtype=np.int32)
    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in range(127, 142)]
    texts += [b"a" * 400, b"b" * 127, b"x y z " * 50, b"p q r " * 50, b"0123456789abcde" * 20]
    found = digest.digests_of([*texts, b""], rank)
    assert all(len(x) for x in found[:-1]) and not len(found[-1])
    assert all(digest.likeness(a, b) < 0.5 for i, a in enumerate(found) for b in found[:i])
    assert digest.likeness(*digest.digests_of([b"a" * 400, b"a" * 500], rank)) == 1


def check_edits(docs, parts):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, (r[1] is not None, r[1] or "")))
    want = []
    for (i, t), (_, following) in zip(rows, [*rows[1:], *rows[:1]]):
        edited = digest.edited_text(t or "", following or "")
        want.append((str(i), len(t or ""), hashlib.sha256(edited.encode()).hexdigest()))
    got = digest.edit_digests(docs, parts).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    return got


def test_edits_follow_the_ids_whatever_the_parts(odd_docs, some_docs, no_docs):
    seen = set()
    for parts in (1, 3, 8):
        got = check_edits(some_docs, parts)
        seen.add(hashlib.sha256(repr(sorted(map(tuple, got))).encode()).hexdigest())
        check_edits(odd_docs, parts)
    assert len(seen) == 1
    assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got]) + 0.3
    assert digest.edit_digests(no_docs, 4).count() == 0
    same = digest.digests(odd_docs, digest.class_ranks(odd_docs)).collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    prints = {}
    for r in same:
        if r.doc_id not in (None, 30):
            assert prints.setdefault(texts[r.doc_id] or "", r.fingerprint) == r.fingerprint


# --- the whole query, window by window
HIGH = 4096 * 64 * 6


def plain_classes(text):
    out = []
    for i in range(len(text) - 63):
        spent = sum(round(4096 * c * math.log2(c)) for c in Counter(text[i : i + 64]).values())
        out.append((HIGH - spent) * 1000 // HIGH)
    return out


def plain_filters(text, classes, rank):
    """The digest as a list of sets of bits."""
    from xxhash import xxh64_intdigest

    if not text:
        return []
    if len(text) < 64:
        chosen = [0]
    elif len(text) < 127:
        chosen = [min(range(len(classes)), key=lambda i: (rank[classes[i]], i))]
    else:
        order = [(rank[c], i) for i, c in enumerate(classes)]
        times = Counter(min(order[g : g + 64])[1] for g in range(len(order) - 63))
        enough = min(16, max(times.values()))
        chosen = sorted(i for i, n in times.items() if n >= enough)
    hashes = list(dict.fromkeys(xxh64_intdigest(text[i : i + 64]) for i in chosen))
    return [{h >> 11 * k & 2047 for h in hashes[a : a + 160] for k in range(5)} for a in range(0, len(hashes), 160)]


def plain_hex(filters):
    return "".join(f"{sum(1 << 2047 - b for b in bits):0512x}" for bits in filters)


def plain_likeness(a, b):
    def one_way(x, y):
        best = 0.0
        for f in x:
            best += max((len(f & g) - len(f) * len(g) / 2048) / max(min(len(f), len(g)) - len(f) * len(g) / 2048, 1e-9) for g in y)
        return min(1.0, max(0.0, best / len(x)))

    if not a or not b:
        return float(not a and not b)
    if len(a) == len(b) > 1:
        return (one_way(a, b) + one_way(b, a)) / 2
    return one_way(a, b) if len(a) <= len(b) else one_way(b, a)


@pytest.mark.parametrize("name", ["some_docs", "odd_docs"])
def test_the_query_is_that_of_plain_loops(name, request):
    docs = request.getfixturevalue(name)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, (r[1] is not None, r[1] or "")))
    texts = [(t or "").encode() for _, t in rows]
    classes = {t: plain_classes(t) for t in set(texts)}
    counts = Counter(c for t in texts for c in classes[t])
    rank = {c: i for i, c in enumerate(sorted(range(1001), key=lambda c: (counts[c], c)))}
    filters = {t: plain_filters(t, classes[t], rank) for t in classes}
    want = []
    for k, ((i, text), raw) in enumerate(zip(rows, texts)):
        following = texts[(k + 1) % len(texts)]
        whole, half = text or "", len(text or "") // 2
        edited = (whole[: len(whole) - half] + following.decode()[:half]).encode()
        changed = plain_filters(edited, plain_classes(edited), rank)
        want.append((str(i), plain_hex(filters[raw]), plain_hex(changed), plain_likeness(filters[raw], changed), plain_likeness(filters[raw], filters[following])))
    got = sorted((str(r.doc_id), r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in digest.edit_digests(docs, 3).collect())
    want.sort()
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3:] for x in got], [x[3:] for x in want])
