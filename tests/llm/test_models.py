import math
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import elias_fano, langid, license_scan, lm_score

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


# --- licenses
def brute_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    places = []
    for label, phrase in license_scan.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_phrases_are_those_of_brute_force(odd_docs, some_docs, no_docs):
    for docs in (odd_docs, some_docs.union(some_docs.limit(3))):
        got = license_scan.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(((r.doc_id, *brute_scan(r.text)) for r in docs.collect()), key=repr)
    assert license_scan.scan(no_docs).count() == 0


def test_templates_with_words_put_in_or_left_out(spark):
    mit = next(t for label, t in license_scan.TEMPLATES if label == "mit").replace("*", "").split()
    noisy = " ".join([*mit[:8], "extra", *mit[8:15], *mit[16:]]).upper()
    rows = [(1, "x " * 50 + noisy), (2, " ".join(mit[:5])), (3, "Licensed under CC BY-NC 4.0."), (4, "mit license mit license apache license")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "mit" and got[1].base_labels == "" and 0.8 < got[1].score < 1 and got[1].spans[0].start in (50, 51)
    assert got[2].labels == "" and got[3].labels == "cc-by,cc-by-nc" and got[3].base_labels == "cc-by"
    assert got[4].n_base == 3 and (got[4].first_word, got[4].last_word) == (0, 4) and got[4].score == 1


def fsf(what, name, version):
    return (
        f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; "
        f"either version {version} of the License, or (at your option) any later version.\n\nThis {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        f"without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU {name} for more details."
    )


def bsd(third):
    return (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
        + third + 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    )


CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
#: Notices as they stand in files, and the labels that each should get, written by hand.
NOTICES = [
    (fsf("program", "General Public License", 2), "gpl,gpl-2"), (fsf("program", "General Public License", 3), "gpl,gpl-3"),
    (fsf("library", "Lesser General Public License", "2.1"), "lgpl"), (fsf("program", "Lesser General Public License", 3), "lgpl"), (fsf("program", "Affero General Public License", 3), "agpl"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3"), ("This work is licensed under the GNU General Public License, version 2.", "gpl,gpl-2"),
    (CC.format(""), "cc-by"), (CC.format("-ShareAlike"), "cc-by-sa"), (CC.format("-NonCommercial"), "cc-by-nc"), (CC.format("-NoDerivatives"), "cc-by-nd"),
    (CC.format("-NonCommercial-ShareAlike"), "cc-by-nc-sa"), (CC.format("-NonCommercial-NoDerivatives"), "cc-by-nc-nd"),
    ("Licensed under CC BY 4.0.", "cc-by"), ("Licensed under CC BY-SA 4.0.", "cc-by,cc-by-sa"), ("Licensed under CC BY-NC-ND 4.0.", "cc-by,cc-by-nc-nd"), ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
    ("To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to this work.", "cc0"),
    ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without '
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.", "mit"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
     'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY '
     "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES", "isc"),
    (bsd(""), "bsd-2-clause"),
    (bsd("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"), "bsd-3-clause"),
    ('Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, '
     "execute, and transmit the Software", "boost"),
    ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software "
     "must not be misrepresented; you must not claim that you wrote the original software.", "zlib"),
    ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', "apache"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", "epl"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"), ("Released under the MIT License.", "mit"),
    ("The terms of the licence are as published. Software and permission notices may be used.", ""),
]


def test_notices_get_their_own_labels(spark):
    pairs = [(NOTICES[i][0] + "\n" + "words between the two that belong to none " * 3 + NOTICES[j][0], NOTICES[i][1], NOTICES[j][1]) for i, j in ((0, 3), (8, 7), (20, 21), (4, 1))]
    both = [(text, ",".join(sorted({*a.split(","), *b.split(",")}))) for text, a, b in pairs]
    rows = [*NOTICES, *both, (" ".join(n for n, _ in NOTICES[:8]) + " pad" * 200_000, "agpl,cc-by,gpl,gpl-2,gpl-3,lgpl")]
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.scan(docs).select("doc_id", "labels").collect()}
    assert {rows[i][0][:200]: labels for i, labels in got.items()} == {text[:200]: labels for text, labels in rows}
    assert [got[i] for i in range(len(rows))] == [labels for _, labels in rows]


def test_scan_runs_no_python(some_docs):
    plan = license_scan.scan(some_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- language model
def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def test_base_scores(odd_docs, some_docs, no_docs):
    for docs in (odd_docs, some_docs):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
        train = [words_of(t) for i, t in rows if not held(i)]
        c = Counter(w for t in train for w in t)
        c[None] = len(train)
        n, bottom = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
        want = []
        for i, t in rows:
            tokens = [*words_of(t), None]
            want.append((str(i), held(i), len(tokens), sum(c[w] > 0 for w in tokens), n, round(sum(math.log10((c[w] + 0.1) / bottom) for w in tokens), 5)))
        got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in lm_score.train_and_score(docs).collect()]
        assert sorted(got) == sorted(want)
    assert lm_score.train_and_score(no_docs).count() == 0


def naive_model(train):
    """Dictionaries instead of tries: the probability of a word after two others."""
    d, add = lm_score.DISCOUNT, lm_score.ADD
    texts = [["<s>", "<s>", *words_of(t), "</s>"] for t in train]
    c = Counter(w for t in texts for w in t[2:])
    n = sum(c.values())
    three = Counter(p for t in texts for p in zip(t, t[1:], t[2:]))
    two = Counter(p[1:] for p in three.elements())
    after1, after2, kinds1, kinds2 = Counter(), Counter(), Counter(), Counter()
    for (v, _), x in two.items():
        after1[v] += x
        kinds1[v] += 1
    for (u, v, _), x in three.items():
        after2[u, v] += x
        kinds2[u, v] += 1

    def p1(w):
        return (c[w] + add) / (n + add * (len(c) + 1))

    def p2(v, w):
        return (max(two[v, w] - d, 0) + d * kinds1[v] * p1(w)) / after1[v] if after1[v] else p1(w)

    def p3(u, v, w):
        return (max(three[u, v, w] - d, 0) + d * kinds2[u, v] * p2(v, w)) / after2[u, v] if after2[u, v] else p2(v, w)

    def score(text):
        t = ["<s>", "<s>", *words_of(text), "</s>"]
        return sum(math.log10(p3(*x)) for x in zip(t, t[1:], t[2:]))

    return score, p3


@pytest.mark.parametrize("parts,slice_bytes", [(1, 1 << 20), (7, 200), (40, 64)])
def test_scores_are_those_of_dictionaries(spark, parts, slice_bytes, monkeypatch):
    """Whatever the parts and slices: with 40 parts most words are dealt out by their neighbours."""
    monkeypatch.setattr(lm_score, "SLICE", slice_bytes)
    rng = np.random.default_rng(3)
    names = ["a", "b", "c", "d", "rare1", "rare2"]
    texts = [" ".join(rng.choice(names, p=[0.4, 0.3, 0.15, 0.13, 0.01, 0.01], size=rng.integers(0, 12))) for _ in range(60)]
    probe = ["a unseen b", "rare1 a b c", "", None, "unseen only", "d d d d d"]
    rows = [(i, t, True) for i, t in enumerate(texts)] + [(1000 + i, t, False) for i, t in enumerate(probe)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3)
    score, p3 = naive_model(texts)
    got = lm_score.score_corpus(docs, F.col("train"), parts=parts).collect()
    assert len(got) == len(rows)
    text_of = {i: t for i, t, _ in rows}
    for r in got:  # probabilities are kept in 255 levels
        assert r.score == pytest.approx(score(text_of[r.doc_id]), abs=1e-3 * r.n_tokens)
    for context in (("a", "b"), ("b", "rare1"), ("d", "c"), ("<s>", "a")):
        assert sum(p3(*context, w) for w in [*set(" ".join(texts).split()), "</s>", "new"]) == pytest.approx(1)


def test_model_beats_unigrams_on_held_out_text(some_docs):
    rows = lm_score.train_and_score(some_docs).filter("held_out").collect()
    assert len(rows) > 10 and sum(r.score for r in rows) > 1.02 * sum(r.base_score for r in rows)


def test_tries_are_read_in_place():
    """Few bytes for an n-gram, and nothing decoded beside the map."""
    rng = np.random.default_rng(4)
    tokens = (rng.zipf(1.25, 400_000) % 30_000).astype(np.int64)
    hashes = np.unique(rng.integers(3, 1 << 63, 30_000).astype(np.uint64))
    rng.shuffle(hashes)
    tokens %= len(hashes)
    dealt = lm_score.Shares(1, np.array([1], np.uint64), np.array([1]), np.array([1]))
    asked = lm_score.Ngrams.of(hashes, tokens, np.array([len(tokens)]), dealt)
    h = np.concatenate([hashes, np.array([1, 2], np.uint64)])
    contexts, words = np.unique(h), np.unique(h & lm_score.LOW32)
    v, u, w = (np.searchsorted(x, y) for x, y in ((contexts, h[asked.v]), (words, h[asked.u] & lm_score.LOW32), (words, h[asked.w] & lm_score.LOW32)))
    none = np.zeros(0, np.int64)
    trie = lm_score.Trie.of_counts(contexts, words, v, u, w, np.ones(len(v), np.int64), (none, none, none), np.full(len(contexts), -1), np.array([1]))
    read = lm_score.Trie.mapped(trie.dump())
    arrays = [x for level in read.levels for s in (level.pointers, level.keys) for x in s.arrays()] + [read.contexts, read.words, read.counts, read.left, *read.codes]
    assert all(x.base is not None and not x.flags.owndata and not x.flags.writeable for x in arrays)
    for level, order in zip(read.levels, (2, 2, 3)):
        assert sum(x.nbytes for s in (level.pointers, level.keys) for x in s.arrays()) < 3 * level.keys.size, order


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, universe in ((0, 1), (1, 1), (1, 5), (10, 10), (1000, 5000), (5000, 10**9), (3000, 3001)):
        values = np.sort(rng.integers(0, universe, n))
        code = elias_fano.EliasFano.encode(values, universe)
        assert code.access(np.arange(n)).tolist() == values.tolist()
        probe = np.concatenate([values, rng.integers(-2, universe + 5, 200)])
        first = {x: i for i, x in reversed(list(enumerate(values.tolist())))}
        assert code.find(probe).tolist() == [first.get(x, -1) for x in probe.tolist()]


def test_levels_of_a_trie():
    rng = np.random.default_rng(2)
    pairs = np.unique(rng.integers(0, (300, 500), (2000, 2)), axis=0)
    (level,), (extra,) = elias_fano.load(memoryview(elias_fano.dump([elias_fano.Level.make(pairs[:, 0], pairs[:, 1], 310)], [np.arange(3)])))
    place = {tuple(x): i for i, x in enumerate(pairs.tolist())}
    asked = rng.integers(-1, (310, 520), (5000, 2))
    assert level.find(asked[:, 0], asked[:, 1]).tolist() == [place.get(tuple(x), -1) for x in asked.tolist()] and extra.tolist() == [0, 1, 2]


def test_packed_arrays():
    given = [np.zeros(0, np.int64), np.array([0, 5, 1 << 40]), np.array([(1 << 64) - 1, 7], np.uint64), np.arange(300)]
    assert [x.tolist() for x in lm_score.unpack(lm_score.pack(given))] == [x.tolist() for x in given]


# --- language
def test_forward_sums_all_segmentations(monkeypatch):
    table = langid.Pieces(sorted({bytes([b]) for b in range(256)} | {b"ab", b"bc", b"abc", b"ca"}))
    rng = np.random.default_rng(0)
    logp = np.log(rng.dirichlet(np.ones(len(table.pieces)), 2))
    number = {p: i for i, p in enumerate(table.pieces)}

    def brute(word, k):
        total = 0.0
        for cuts in product([0, 1], repeat=len(word) - 1):
            parts, start = [], 0
            for i, cut in enumerate(cuts, 1):
                if cut:
                    parts.append(word[start:i])
                    start = i
            parts.append(word[start:])
            if all(p in number for p in parts):
                total += math.exp(sum(logp[k][number[p]] for p in parts))
        return math.log(total)

    words = [b"a", b"abc", b"abcabc", b"cab"]
    got = langid.word_scores(table, logp, words)
    assert np.allclose(got, [[brute(w, k) for k in (0, 1)] for w in words])
    long = b"abcab" * 60
    part = langid.word_scores(table, logp, [long[: langid.LONG], long])
    assert np.allclose(langid._long_score(table, langid._tilted(table, logp), long[: langid.LONG]) - langid.RATE * langid.LONG, part[0])
    assert part[1][0] < part[0][0]
    monkeypatch.setattr(langid, "CHUNK", 7)
    mixed, two, three = [b"abcab" * 30, b"cabca" * 25, bytes(rng.integers(0, 256, 130).astype(np.uint8))], np.array([0, 1, 1]), np.array([1.0, 2.0, 0.5])
    one_by_one = langid.word_scores(table, logp, mixed), langid.expected_counts(table, logp, mixed, two, three)
    monkeypatch.setattr(langid, "LONG", 1000)
    assert np.allclose(one_by_one[0], langid.word_scores(table, logp, mixed))
    assert np.allclose(one_by_one[1], langid.expected_counts(table, logp, mixed, two, three))
    lang, weight = np.array([0, 1, 0, 1]), np.array([1.0, 2.0, 1.0, 3.0])
    counts = langid.expected_counts(table, logp, words, lang, weight)
    assert np.allclose((counts * [len(p) for p in table.pieces]).sum(axis=1), [1 + 6, 2 * 3 + 3 * 3])
    p = np.exp(logp[1])  # of "abc": how often is it one piece?
    shares = {s: math.prod(p[number[x]] for x in s) for s in ((b"abc",), (b"ab", b"c"), (b"a", b"bc"), (b"a", b"b", b"c"))}
    assert np.isclose(counts[1][number[b"abc"]], 2 * shares[b"abc",] / sum(shares.values()))


def plain_sums(word, pieces, logp):
    """log of the sum over all segmentations from the left and from the right, and the pieces' places."""
    places = [(a, b, word[a:b]) for b in range(1, len(word) + 1) for a in range(max(0, b - LONGEST), b) if word[a:b] in pieces]
    left, right = [0.0] + [-math.inf] * len(word), [-math.inf] * len(word) + [0.0]
    for a, b, p in places:
        left[b] = np.logaddexp(left[b], left[a] + logp[p])
    for a, b, p in sorted(places, reverse=True):
        right[a] = np.logaddexp(right[a], right[b] + logp[p])
    return left, right, places


LONGEST = max(map(len, langid.byte_pieces(MODEL)))


@pytest.mark.parametrize("name", ["some_docs", "odd_docs"])
def test_languages_are_those_of_plain_loops(name, request):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, [("\u2581" + w).encode() for w in (r.text or "").lower().split()], r.lang, r.text or "") for r in docs.collect()]
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1 for i, *_ in rows}
    pieces = langid.byte_pieces(MODEL)
    known = set(pieces)
    langs = sorted({lang for i, _, lang, _ in rows if lang is not None and not held[i]})
    logp = {}
    for lang in langs:
        words = Counter(w for i, ws, x, _ in rows if x == lang and not held[i] for w in ws)
        now = dict.fromkeys(pieces, -math.log(len(pieces)))
        for _ in range(2):
            counts = dict.fromkeys(pieces, 0.1)
            for w, n in words.items():
                left, right, places = plain_sums(w, known, now)
                for a, b, p in places:
                    counts[p] += n * math.exp(left[a] + now[p] + right[b] - left[-1])
            total = sum(counts.values())
            now = {p: math.log(c / total) for p, c in counts.items()}
        logp[lang] = now
    totals = {lang: {w: plain_sums(w, known, logp[lang])[0][-1] for w in {w for _, ws, _, _ in rows for w in ws}} for lang in langs}
    want = []
    for i, ws, _, text in rows:
        sums = [sum(totals[lang][w] for w in ws) for lang in langs]
        share = 1 / sum(math.exp((x - max(sums)) / max(1, len(ws) / 10)) for x in sums)
        letter = any(c.isalpha() for c in text)
        want.append((str(i), held[i], langs[sums.index(max(sums))] if letter else "und", share if letter else 0.0))
    got = sorted((str(r.doc_id), r.held_out, r.lang_pred, r.score) for r in langid.identify(docs, MODEL).collect())
    want.sort()
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], atol=1e-6)


def test_white_space_at_the_ends_is_no_word(spark):
    rows = [(1, "der Hund", "de"), (2, "the dog", "en"), (3, "  the dog\n", "en"), (4, "", "de"), (5, None, "de"), (6, " ", "de")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    bare = langid.fit(docs.filter("doc_id < 4").withColumn("text", F.trim(F.regexp_replace("text", "\n", ""))), MODEL)
    model = langid.fit(docs, MODEL)
    assert np.allclose(model.logp, bare.logp)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert got[2] == got[3] and got[3][0] == "en" and all(got[i] == ("und", 0.0) for i in (4, 5, 6))


def test_held_out_accuracy(some_docs):
    rows = langid.identify(some_docs, MODEL).join(some_docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 40 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts_have_no_language(odd_docs, no_docs):
    got = {r.doc_id: r for r in langid.identify(odd_docs, MODEL).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und" and i is not None} == {0, 10, 20, 70}
    assert got[70].score == 0 and got[80].lang_pred == "en"
    assert langid.identify(no_docs, MODEL).count() == 0
    nothing = langid.fit(odd_docs.withColumn("lang", F.lit(None).cast("string")), MODEL)
    assert {r.lang_pred for r in langid.predict(odd_docs, nothing).collect()} == {"und"}
    model = langid.fit(odd_docs, MODEL)
    kept = langid.drop_unknown(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.filter("doc_id IN (0, 10, 20, 70)").count() == 0
    assert kept.count() == odd_docs.filter(r"text rlike '\\p{L}'").count()
