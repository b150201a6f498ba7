"""Text rules as column expressions; all of them run inside the JVM except ``collapsed``."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A number with its separators inside.
NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
#: A link in Markdown, and an address up to its last character that isn't punctuation.
LINK = r"\[([^\[\]]*)\]\(\s*[^\s()]+\s*\)"
ADDRESS = r"\b(?:[a-z]+://|www\.)\S*[^\s.,;:!?)\]]"
#: An amount: with a currency, a percentage, a fraction or at least three digits.
FIGURE = r"(?i)(?:₹|\brs\b\.?|\binr\b)\s*[0-9]|[0-9]\s*(?:%|per ?cent\b)|[0-9][.,][0-9]|[0-9]{3}"
#: Words that end with a stop inside a sentence, besides single letters.
SHORTENED = ("rs", "dr", "mr", "mrs", "ms", "shri", "smt", "no", "vs", "etc", "approx", "incl", "excl", "dept", "govt", "ltd")


def words(text: Column) -> Column:
    """The runs without white space, none for null and empty texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def spaced(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


@F.pandas_udf(T.StringType())
def collapsed(text: pd.Series) -> pd.Series:
    """NFKC with plain blanks, dashes and quotes; JVM-side SQL has no NFKC."""
    plain = {0xA0: " ", 0x200B: None, 0x2012: "-", 0x2013: "-", 0x2014: "-", 0x2018: '"', 0x2019: '"', 0x201C: '"', 0x201D: '"'}
    return text.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).translate(plain).split()))


def class_tokens(value: Column) -> Column:
    """The parts of a class or id attribute, in lower case, each once."""
    return F.array_distinct(F.filter(F.split(F.lower(value), r"[-_\s]+"), lambda w: w != ""))


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def normal_number(token: Column) -> Column:
    """Digits and decimal point only: the separators of thousands go."""
    return F.regexp_replace(token, "[^0-9.]", "")


def normal_answer(text: Column) -> Column:
    """The form in which answers are compared with what is expected: lower case, no currency, no separators of thousands, no
    zeros at the end of a fraction, single blanks."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"₹|\brs\b\.?|\binr\b", " ")
    low = F.regexp_replace(F.regexp_replace(low, r"(?<=[0-9]),(?=[0-9])", ""), r"([0-9]+)\.0+(?![0-9])|([0-9]+\.[0-9]*[1-9])0+(?![0-9])", "$1$2")
    return spaced(F.regexp_replace(low, r"(?<=[0-9])\s+%", "%"))


def answer_fits(answer: Column, expected: Column, forbidden: Column) -> Column:
    """Does the answer hold one of the expected texts (if there are any) and none of the forbidden ones?"""
    said = normal_answer(answer)
    holds = lambda x: F.contains(said, normal_answer(x))
    wanted, barred = F.coalesce(expected, F.array().cast("array<string>")), F.coalesce(forbidden, F.array().cast("array<string>"))
    return ((F.size(wanted) == 0) | F.exists(wanted, holds)) & ~F.exists(barred, holds)


def numbers_supported(answer: Column, evidence: Column) -> Column:
    """Is every number of the answer one of the evidence's numbers? Both are sets of whole numbers, so that a part of a
    longer number supports nothing."""
    found = lambda c: F.transform(number_tokens(F.coalesce(c, F.lit(""))), normal_number)
    return F.size(F.array_except(found(answer), found(evidence))) == 0


def sentences(text: Column) -> Column:
    """Sentences, with single blanks between words. They are parted by the white space after a word that ends with . ! ? (and
    a quote or bracket), unless it is a single letter, as in "p.a.", or one of SHORTENED."""
    gap = r"""(?i)(?<=[.!?]|[.!?]["”’)\]])(?<!\b(?:[a-z]|""" + "|".join(SHORTENED) + r""")\.)\s+"""
    return F.filter(F.transform(F.split(text, gap), spaced), lambda s: s != "")


def first_sentences(text: Column, n: int = 3) -> Column:
    """The text itself if it has at most n sentences, else the first n, ended by a stop."""
    parts = sentences(text)
    head = F.array_join(F.slice(parts, 1, n), " ")
    return F.when(F.size(parts) <= n, text).otherwise(F.when(head.rlike(r"[.!?]$"), head).otherwise(F.concat(head, F.lit("."))))


def without_urls(text: Column) -> Column:
    """Markdown links as their labels, bare addresses gone, blanks single."""
    out = F.regexp_replace(F.regexp_replace(text, LINK, "$1"), ADDRESS, "")
    return F.trim(F.regexp_replace(out, r"[ \t]{2,}", " "))


def has_figure(text: Column) -> Column:
    return text.rlike(FIGURE)


def rendered(template: str, **values: Column) -> Column:
    """A template with {placeholders}; unknown and missing names are errors when the query is built."""
    import string

    parts = list(string.Formatter().parse(template))
    names = {name for _, name, _, _ in parts if name is not None}
    if names != set(values):
        raise KeyError(f"placeholders {sorted(names)}, values {sorted(values)}")
    return F.concat(*[x for text, name, _, _ in parts for x in ([F.lit(text)] if text else []) + ([F.coalesce(values[name], F.lit(""))] if name is not None else [])])


def context(hits: Column) -> Column:
    """Numbered blocks of an array of hits with source_id, section, retrieved_at and text."""
    return F.array_join(
        F.transform(hits, lambda h, i: F.concat(F.format_string('[%d] source_id=%s section="%s" retrieved_at=%s\n', i + 1, F.coalesce(h["source_id"], F.lit("")), F.coalesce(h["section"], F.lit("")), F.coalesce(h["retrieved_at"], F.lit(""))), F.coalesce(h["text"], F.lit("")))), "\n\n"
    )
