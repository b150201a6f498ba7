"""Keyword-stuffed and link-list pages: phrases replicated on other hosts, joined with list density.

A document falls into lines, and lines without links into sentences. A sentence has the shape of a list if separators
(commas, bars, dots, arrows, hash marks) stand between few words each, or if it is a short line that doesn't end like a
sentence; a row of figures is neither. What has that shape is cut at its separators into segments, and segments into
phrase shingles of two words, numbers left out. A sentence that is made of pairs of words which come again in it is
stuffed, and gives these pairs. The shingles are exploded, and the distinct hosts of each are counted over all documents: a shingle
is stitched in if it stands on at least ``MIN_HOSTS`` hosts (on ``HOST_SHARE`` of all hosts where those are more), or
``MIN_REPEATS`` times in lists and stuffed sentences of the document itself. A document is spam if the words of its links with their titles and of its stitched shingles are most of its words.

The shape alone flags nothing but links: a glossary or a list of names that no other host has is no spam.
"""

from __future__ import annotations

import html
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import stage
from .spark import pandas_rows
from .words import codes_of, hashes_of_spans, kinds_of_chars, mix

SHARE = 0.5
MIN_HOSTS, HOST_SHARE = 3, 0.02
#: A phrase that comes so often in one document is stuffing on any host.
MIN_REPEATS = 3
#: A sentence is stuffed if pairs of words that come so often in it make up so much of it.
STUFFED = ((2, 0.5), (3, 0.3))
PHRASE = 2
#: Words for each separator, at most, in a list.
PER_SEPARATOR = 6
#: A sentence with fewer words is a list item; a line without an end is one up to the second figure.
SHORT, SHORT_OPEN = 6, 13
#: Words beside a link that count as its title.
TITLE = 15
#: Share of words without a letter from which a sentence is a row of figures.
FIGURES = 0.45

_UNITS = T.StructType([
    T.StructField("words", T.IntegerType()), T.StructField("link_words", T.IntegerType()), T.StructField("list_words", T.IntegerType()),
    T.StructField("phrases", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.FloatType())),
])


def _later(values: np.ndarray, j: int) -> np.ndarray:
    """The value j places on, 0 beyond the end."""
    return np.r_[values[j:], np.zeros(min(j, len(values)), dtype=values.dtype)]


def _sums(flags: np.ndarray, border: np.ndarray) -> np.ndarray:
    """How many flags are set between each two borders."""
    total = np.r_[0, np.cumsum(flags)]
    return total[border[1:]] - total[border[:-1]]


def _plain(text: str | None) -> str:
    """In lower case, without entities (escaped twice at most), a blank after commas between letters."""
    text = text or ""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    return _COMMA.sub(", ", text.lower())


def analyse(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Of each text: words, words of links, words of the shape of a list, and the shingles to look up, how often
    each comes and the words that it stands for."""
    n_texts = len(texts)
    codes, text_start = codes_of([_plain(t) for t in texts])
    kind = kinds_of_chars(codes)
    letter, digit, white = (kind == 1) | (kind == 3), kind == 2, kind == 4
    feed = codes == 10
    edge = np.diff(np.r_[True, white, True].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)  # runs without white space
    if not len(start):
        zero = np.zeros(n_texts, dtype=np.int64)
        return zero, zero, zero, *([np.zeros(0, kind)] * n_texts for kind in (np.int64, np.int32, np.float32))

    def held(flags: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags)]
        return total[end] - total[start]

    n_letters = held(letter)
    is_word = (n_letters > 0) | (held(digit) > 0)
    # a link: a scheme, "www.", or a dot between letters with a slash after it
    scheme = np.zeros(len(codes), dtype=bool)
    scheme[:-2] = (codes[:-2] == 58) & (codes[1:-1] == 47) & (codes[2:] == 47)
    web = np.zeros(len(codes), dtype=bool)
    web[:-3] = (codes[:-3] == 119) & (codes[1:-2] == 119) & (codes[2:-1] == 119) & (codes[3:] == 46)
    dot = np.zeros(len(codes), dtype=bool)
    dot[1:-2] = (codes[1:-2] == 46) & (letter | digit)[:-3] & letter[2:-1] & letter[3:]
    dots = np.r_[0, np.cumsum(dot)]
    path = np.flatnonzero(codes == 47)
    last = np.searchsorted(path, end) - 1
    slash = np.where(last >= 0, path[np.maximum(last, 0)] if len(path) else 0, -1)
    link = (held(scheme) > 0) | (held(web) > 0) | ((slash > start) & (dots[np.maximum(slash, start)] - dots[start] > 0))
    is_word |= link
    text = np.searchsorted(text_start, start, side="right") - 1

    # lines that have words, one after another
    line = np.r_[0, np.cumsum(feed)][start]
    use = is_word
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    border = np.r_[first, len(start)]
    words, links = _sums(use, border), _sums(link, border)
    some = words > 0
    owner = text[first]
    linked = (links > 0) & (words - links <= TITLE * links)
    bare = (links > 0) & (words == links)
    rows = np.flatnonzero(some)
    title = np.zeros(len(first), dtype=bool)  # the title of the link on the line below
    above, below = rows[:-1], rows[1:]
    title[above] = bare[below] & (links[above] == 0) & (words[above] <= TITLE) & (owner[above] == owner[below])
    in_line = np.repeat(np.arange(len(first)), np.diff(border))
    as_link = ((linked | title)[in_line] | link) & use

    # sentences of the other lines: they end where a line ends and after a stop
    rest = ~as_link
    tail = codes[end - 1]
    for _ in range(2):  # a quote or bracket after the stop
        closing = np.isin(tail, _CLOSING)
        tail = np.where(closing, codes[np.maximum(end - 2, start)], tail)
    stops = np.isin(tail, _STOPS) & use
    new = np.r_[True, (line[1:] != line[:-1]) | stops[:-1]]
    first = np.flatnonzero(new)
    border = np.r_[first, len(start)]
    sentence = np.repeat(np.arange(len(first)), np.diff(border))
    plain = rest & use
    n = _sums(plain, border)
    mark = rest & (np.isin(codes[end - 1], _AFTER) | np.isin(codes[start], _BEFORE) & (use | (end - start < 3)))
    inner = mark & ~np.r_[new[1:], True]  # none after the last word
    separators = _sums(inner, border) + _sums(held(codes == 35) > 0, border)
    ended = _sums(stops, border) > 0
    figures = _sums(plain & (n_letters == 0), border)
    row = figures >= FIGURES * n
    listed = (n > 0) & ~row & ((separators * PER_SEPARATOR >= n) & (separators > 0) | (n < np.where(ended, SHORT, SHORT_OPEN)))

    # words with letters, by segment; only lists are cut at their separators
    named = plain & (n_letters > 0)
    cut = new | (np.r_[False, mark[:-1]] | np.isin(codes[start], _BEFORE)) & listed[sentence]
    segment = np.cumsum(cut)[named]
    hashes = hashes_of_spans(codes, letter, start[named], end[named])
    seg_text, seg_list = text[named], listed[sentence][named]
    m = len(hashes)
    size = np.bincount(segment, minlength=1)[segment] if m else np.zeros(0, dtype=np.int64)
    place = np.arange(m) - np.searchsorted(segment, segment)
    run = mix(hashes)
    for j in range(1, PHRASE):
        run = np.where(place + j < size, mix(run + _later(hashes, j)), run)
    whole = (place + PHRASE <= size) | (place == 0)
    # a sentence is stuffed if pairs of words that come again in it make up much of it
    in_sentence = sentence[named]
    pair = np.flatnonzero((place + 1 < size) & ~seg_list & ~row[in_sentence])
    key = mix(mix(hashes) + _later(hashes, 1))[pair]
    order = np.lexsort((key, in_sentence[pair]))
    same = np.flatnonzero(np.r_[True, (key[order][1:] != key[order][:-1]) | (in_sentence[pair][order][1:] != in_sentence[pair][order][:-1])]) if len(pair) else pair
    times = np.diff(np.r_[same, len(pair)])
    count = np.zeros(m, dtype=np.int64)
    count[pair[order]] = np.repeat(times, times)
    again = count > 1
    stuffed = np.zeros(len(n), dtype=bool)
    for least, share in STUFFED:
        some = count >= least
        stuffed |= np.bincount(in_sentence, weights=some | np.r_[False, some[:-1]][:m], minlength=len(n)) >= np.maximum(4, share * n)
    # the words of a segment are shared out among its shingles, those of a stuffed sentence among the pairs that come again
    take = np.where(seg_list, whole, again & stuffed[in_sentence])
    run = np.where(seg_list, run, mix(mix(hashes) + _later(hashes, 1)))
    unit = np.where(seg_list, segment, in_sentence + int(segment.max() + 1 if m else 0))
    shares = np.bincount(unit[take], minlength=int(unit.max()) + 1 if m else 1)
    words_of = np.bincount(np.cumsum(cut)[plain], minlength=int(segment.max()) + 1 if m else 1)
    weight = np.where(seg_list, words_of[segment], n[in_sentence])[take] / shares[unit[take]] if m else np.zeros(0)
    run, seg_text = run[take], seg_text[take]
    # one row a text and shingle
    order = np.lexsort((run, seg_text))
    run, seg_text, weight = run[order], seg_text[order], weight[order]
    begin = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (seg_text[1:] != seg_text[:-1])]) if len(run) else np.zeros(0, dtype=np.int64)
    total = np.add.reduceat(weight, begin) if len(begin) else weight
    phrase, phrase_text, times = run[begin], seg_text[begin], np.diff(np.r_[begin, len(run)])
    parts = np.searchsorted(phrase_text, np.arange(1, n_texts))
    count = lambda flags: np.bincount(text[flags], minlength=n_texts)
    return count(use), count(as_link), count(plain & listed[sentence]), np.split(phrase.view(np.int64), parts), np.split(times.astype(np.int32), parts), np.split(total.astype(np.float32), parts)


_COMMA = re.compile(r"(?<=[^\W\d]),(?=[^\W\d])")
_STOPS = np.array([ord(c) for c in ".!?।॥…"], dtype=np.uint32)
_CLOSING = np.array([ord(c) for c in "\"')]”’»"], dtype=np.uint32)
_AFTER = np.array([ord(c) for c in ",;:|/·•»>→"], dtype=np.uint32)
_BEFORE = np.array([ord(c) for c in "#•·|»→"], dtype=np.uint32)


@F.pandas_udf(_UNITS)
def _analysed(text: pd.Series) -> pd.DataFrame:
    parts = []
    for rows in pandas_rows([text.to_frame("text")], 2000, "text", 1_000_000):
        parts.append(pd.DataFrame(dict(zip(_UNITS.names, analyse(rows["text"].tolist())))))
    return pd.concat(parts, ignore_index=True)


#: A filter on its result would otherwise be pushed below it and analyse every text a second time.
_analyse = _analysed.asNondeterministic()


def spam_evidence(documents: DataFrame) -> DataFrame:
    """``documents(doc_id, text, url, source)`` -> ``(doc_id, words, link_share, list_share, stitched_share, spam)``.

    Null and blank texts and null ids have no row. A document that comes several times with one id counts once, with the
    delivery of the smallest hash; the host is that of the url, else the source. Very long texts are taken whole.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://(?:www\.)?([^/:?#]+)", 1)), F.lit(""))
    site = F.when(host != "", host).otherwise(F.coalesce("source", F.lit("")))
    read = documents.where("doc_id IS NOT NULL AND text RLIKE '[^\\\\s]'").select("doc_id", F.xxhash64("text", "url", "source").alias("delivery"), site.alias("host"), _analyse("text").alias("u"))
    read = read.where("u.words > 0").select("doc_id", F.struct("delivery", "host", "u").alias("d"))  # no texts from here on
    units = stage(read.groupBy("doc_id").agg(F.min("d").alias("d")).select("doc_id", "d.host", "d.u.*"), "units")
    hosts = units.agg(F.countDistinct("host")).first()[0]
    least = max(MIN_HOSTS, math.ceil(HOST_SHARE * hosts))
    listed = units.select("doc_id", "host", F.explode(F.arrays_zip("phrases", "times", "weights")).alias("p")).select("doc_id", "host", F.col("p.phrases").alias("phrase"), F.col("p.times").alias("n"), F.col("p.weights").alias("w"))
    replicated = listed.select("phrase", "host").distinct().groupBy("phrase").agg(F.count(F.lit(1)).alias("hosts")).where(F.col("hosts") >= least).select("phrase", F.lit(True).alias("elsewhere"))
    stitched = listed.join(replicated, "phrase", "left").where(F.col("elsewhere") | (F.col("n") >= MIN_REPEATS)).groupBy("doc_id").agg(F.sum("w").alias("stitched"))
    share = lambda c: F.col(c) / F.col("words")
    out = units.join(stitched, "doc_id", "left").withColumn("stitched", F.round(F.coalesce("stitched", F.lit(0.0)), 3))
    out = out.select("doc_id", "words", share("link_words").alias("link_share"), share("list_words").alias("list_share"), share("stitched").alias("stitched_share"))
    return out.withColumn("spam", F.col("link_share") + F.col("stitched_share") > SHARE)


def spam_documents(documents: DataFrame) -> DataFrame:
    """``(doc_id)`` of the documents whose links and stitched phrases are most of their words."""
    return spam_evidence(documents).where("spam").select("doc_id")
