"""Title and text functions as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dimensions import CATEGORY_RULES, LANGUAGES, NOISE_WORDS

#: White space as browsers define it; Java's \s knows ASCII alone.
WS = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
#: The characters of WS.
_BLANKS = " \t\n\v\f\r" + "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
_MARKS = "".join(map(chr, range(0x300, 0x370)))
_CJK = "[\\u3400-\\u9fff\\u3040-\\u30ff]"


def _strip_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not "̀" <= c <= "ͯ")


@cache
def _accents() -> tuple[str, str]:
    """Characters that lose their marks and stay one character, and what they become."""
    pairs = []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.decomposition(char) and not 0xAC00 <= code <= 0xD7A3:
            plain = _strip_marks(char)
            if len(plain) == 1 and plain != char:
                pairs.append((char, plain))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


@cache
def _voiced() -> dict[str, tuple[str, str]]:
    """Kana that fall apart into a plain one and a mark that stays: by mark, they and the plain."""
    found: dict[str, list[tuple[str, str]]] = {}
    for code in range(0x3040, 0x3100):
        plain = _strip_marks(chr(code))
        if len(plain) == 2:
            found.setdefault(plain[1], []).append((chr(code), plain[0]))
    return {mark: ("".join(p[0] for p in pairs), "".join(p[1] for p in pairs)) for mark, pairs in found.items()}


def _jamo(text: Column) -> Column:
    """Hangul syllables taken apart by arithmetic: of 11,172 in a row each 588 begin with the same
    consonant, each 28 of these have the same vowel, and the rest tells the last consonant."""

    def parts(char: Column) -> Column:
        s = F.ascii(char) - 0xAC00
        last = F.when(s % 28 > 0, _code(0x11A7 + s % 28)).otherwise("")
        whole = F.concat(_code(0x1100 + F.floor(s / 588)), _code(0x1161 + F.floor(s % 588 / 28)), last)
        return F.when((s >= 0) & (s < 11172), whole).otherwise(char)

    return F.array_join(F.transform(F.split(text, ""), parts), "")


def _code(point: Column) -> Column:
    """The character of a code point from U+0800 to U+FFFF, by its three bytes."""
    point = point.cast("int")
    at = lambda n, low: F.lpad(F.hex((F.shiftright(point, n).bitwiseAND(F.lit(0x3F)) + low).cast("long")), 2, "0")
    first = F.hex((F.shiftright(point, 12) + 0xE0).cast("long"))
    return F.unhex(F.concat(first, at(6, 0x80), at(0, 0x80))).cast("string")


def deaccent(text: Column) -> Column:
    """Canonical decomposition without the combining marks U+0300-036F. ``translate`` covers
    what stays one character, plain ASCII skips it; voiced kana get their own mark behind,
    Hangul syllables become their letters."""
    source, target = _accents()
    plain = F.translate(text, source + _MARKS, target)
    kana = text
    for mark, (voiced, _) in _voiced().items():
        kana = F.regexp_replace(kana, f"([{voiced}])", f"$1{mark}")
    voiced, base = ("".join(x) for x in zip(*_voiced().values()))
    kana = F.translate(kana, source + voiced + _MARKS, target + base)
    cjk = F.when(text.rlike("[\u3040-\u30ff]"), kana).otherwise(plain)
    return F.when(F.length(text) == F.octet_length(text), text).when(text.rlike("[\uac00-\ud7a3]"), _jamo(cjk)).otherwise(cjk)


def title_tokens(title: Column) -> Column:
    """The words of a title that tell which event it is; a run with CJK gives its bigrams."""
    text = deaccent(F.lower(title))
    for pattern in ("\\([^)]*\\)", "\\[[^\\]]*\\]", "[^\\p{L}\\p{N}]+"):
        text = F.regexp_replace(text, pattern, " ")
    chunks = F.filter(F.split(F.trim(text), " +"), lambda c: c != "")
    noise = F.array(*map(F.lit, NOISE_WORDS))

    def bigrams(chunk: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(chunk) - 1, F.lit(1))), lambda i: F.substring(chunk, i, 2))
        return F.when(F.length(chunk) == 1, F.array(chunk)).otherwise(pairs)

    empty = F.array().cast("array<string>")
    parts = F.transform(
        chunks, lambda c: F.when(c.rlike(_CJK), bigrams(c)).when(F.array_contains(noise, c), empty).otherwise(F.array(c))
    )
    return F.flatten(parts)


def fingerprint_of(tokens: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(tokens)), " ")


def title_fingerprint(title: Column) -> Column:
    """Distinct tokens in order; titles without tokens share the empty fingerprint."""
    return fingerprint_of(title_tokens(title))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def title_grams(title: Column) -> Column:
    """Distinct trigrams over the whole cleaned title with two blanks before and one behind."""
    text = F.trim(F.regexp_replace(deaccent(F.lower(title)), "[^\\p{L}\\p{N}]+", " "))
    padded = F.concat(F.lit("  "), text, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, 3)))


def dice(a: Column, b: Column) -> Column:
    """Of two gram arrays without repeats."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def title_similarity(tokens_a: Column, tokens_b: Column, grams_a: Column, grams_b: Column) -> Column:
    return F.greatest(jaccard(tokens_a, tokens_b), dice(grams_a, grams_b))


def word_trigrams(text: Column) -> Column:
    """Distinct trigrams by word, each word with two blanks before and one behind."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, 3))

    return F.array_distinct(F.flatten(F.transform(words, grams)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two gram arrays in single precision, as the database extension gives it; so
    an exact 3 of 10 is over a threshold of 0.3 in double."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both).cast("float")


def venue_key(name: Column) -> Column:
    """Name of a venue without marks, case, a leading article and punctuation."""
    text = F.regexp_replace(F.lower(deaccent(name)), f"^the{WS}+", "")
    return F.trim(F.regexp_replace(text, "[^\\p{L}\\p{N}]+", " "))


def search_text(*parts: Column) -> Column:
    """Parts joined by blanks; a null part leaves its blank."""
    joined = [F.coalesce(parts[0], F.lit(""))]
    for part in parts[1:]:
        joined += [F.lit(" "), F.coalesce(part, F.lit(""))]
    return F.concat(*joined)


def trim_ws(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def null_if_empty(text: Column) -> Column:
    return F.when(text != "", text)


def summary_text(text: Column, tags: bool = False) -> Column:
    """White space collapsed, at most 600 characters, null if nothing is left."""
    plain = F.regexp_replace(text, "<[^>]+>", " ") if tags else text
    return null_if_empty(F.substring(trim_ws(F.regexp_replace(plain, f"{WS}+", " ")), 1, 600))


def infer_category(*signals: Column) -> Column:
    """The first rule with a keyword anywhere in the signals, else other."""
    text = F.lower(F.array_join(F.filter(F.array(*signals), lambda s: s.isNotNull() & (s != "")), " "))

    def first_rule(t: Column) -> Column:
        out = F.when(t == "", F.lit("other"))
        for slug, keywords in CATEGORY_RULES:
            out = out.when(reduce(or_, (F.contains(t, F.lit(k)) for k in keywords)), F.lit(slug))
        return out.otherwise(F.lit("other"))

    # through an array, so that the text is put together and lower-cased once
    return F.element_at(F.transform(F.array(text), first_rule), 1)


def content_hash(raw: Column) -> Column:
    """Half a SHA-256 of the payload as it was read; null counts as the JSON null."""
    return F.left(F.sha2(F.coalesce(raw, F.lit("null")), 256), F.lit(32))


def join_present(separator: str, *parts: Column) -> Column:
    """Parts that are neither null nor empty, joined; null if there is none."""
    return null_if_empty(F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), separator))


def placeholder(text: Column, kinds: int = 6) -> Column:
    """A number below ``kinds`` from the characters of an id."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    return (F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(4294967295))) % kinds).cast("int")


def host_slug(url: Column) -> Column:
    """First label of the host, without www."""
    return F.regexp_replace(F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), "^www\\.", ""), "\\..*$", "")


def localized(title: Column, title_zh: Column, lang: str = "en") -> Column:
    """The title in a language, the plain one where there is no translation."""
    return F.coalesce(title_zh, title) if lang == "zh" else title


def label(slug: Column, labels: dict[str, tuple[str, str]], lang: str = "en") -> Column:
    """A slug's label in a language; a slug without one stays as it is."""
    which = LANGUAGES.index(lang)
    pairs = [F.lit(x) for k, v in labels.items() for x in (k, v[which])]
    return F.coalesce(F.element_at(F.create_map(*pairs), slug), slug)
