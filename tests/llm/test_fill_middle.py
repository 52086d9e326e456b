import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import fill_middle

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def brute(doc_id, text, seed=1):
    """(n, form, prefix_chars, middle_chars, output) by a regular expression."""
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = UNITS.findall(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def hashes(doc_id):
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aZP<>SM é日🎉\n1\x00", max_size=40), min_size=1, max_size=30), st.sampled_from([1, 2, 3, 7, 512]))
def test_as_by_regular_expression(texts, lane):
    """Lanes of any length: what stands at their seams is read as anywhere else."""
    old, fill_middle.LANE = fill_middle.LANE, lane
    try:
        found = fill_middle.arranged([t.encode() for t in texts], [hashes(i) for i in range(len(texts))])
    finally:
        fill_middle.LANE = old
    assert [(*r[:4], r[4].decode()) for r in found] == [brute(i, t) for i, t in enumerate(texts)]


def test_transitions_are_those_of_the_table_byte_by_byte():
    data = "a<P>b<M x>é🎉<<S>日PSM>".encode() * 300
    state, wanted = fill_middle.START, []
    for byte in data:
        kind = fill_middle.CLASS[byte]
        wanted.append(fill_middle.EMIT[state, kind])
        state = fill_middle.STEP[state, kind]
    assert fill_middle.transitions(data).tolist() == wanted


@pytest.mark.parametrize("text", ["<P", "P>", "<P>", "x<S>y", "<<M>", "<p>", "<P >", "<", "<P<S", "ab<S", "<PS>", "<é>"])
def test_sentinels(text):
    (row,) = fill_middle.arranged([text.encode()], [[1, 2, 0, 50]])
    assert (row[1] == "plain") == bool(re.search("<[PSM]>", text))


def test_odd_texts(spark, odd_docs, no_docs):
    found = fill_middle.rearrange(odd_docs).collect()
    wanted = [(r.doc_id, *brute(r.doc_id, r.text)) for r in odd_docs.collect()]
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)
    assert fill_middle.rearrange(no_docs).collect() == [] == fill_middle.round_trips(no_docs).collect()


def test_what_is_rebuilt_is_the_text(spark):
    """Texts whose ends look like the beginnings of sentinels, and ends of code points at cuts."""
    texts = ["<", "a<", "<S", "x<M", "<P<S<M", "<<<<<<<<", "é<é<P", "日本語 <S 🎉", " \n", None, "", "<M><P>", "P>S>M>"]
    docs = spark.createDataFrame([(i, texts[i % len(texts)]) for i in range(40 * len(texts))], "doc_id long, text string")
    kinds = set()
    for r in fill_middle.round_trips(docs).collect():
        kinds.add(r.form)
        assert r.restored_sha256 == hashlib.sha256((texts[r.doc_id % len(texts)] or "").encode()).hexdigest()
        assert r.output_sha256 == hashlib.sha256(brute(r.doc_id, texts[r.doc_id % len(texts)])[4].encode()).hexdigest()
    assert kinds == {"plain", "psm", "spm"}


def test_very_long_texts(spark):
    """A text of five million characters, a word of a million, ids of text."""
    texts = {"words": "word é 1 " * 555_556, "letters": "w" * 1_000_000, "points": "🎉" * 500_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    found = {r.doc_id: r for r in fill_middle.round_trips(docs).collect()}
    for name, text in texts.items():
        n, form, p, m, output = brute(name, text)
        r = found[name]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_another_seed_cuts_elsewhere(some_docs):
    one, two = ({r.doc_id: r.prefix_chars for r in fill_middle.rearrange(some_docs, seed).collect()} for seed in (1, 2))
    assert one != two
