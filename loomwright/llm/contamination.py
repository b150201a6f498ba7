"""Evaluation texts leaking into training text: the q-gram lemma as a filter, banded alignment as the proof.

Both sides are cut into words (letters and digits of the folded text) and written with single blanks, so that spacing
and punctuation don't count. An edit is a whole word, so a stretch of L characters with at most e edits consists of
e + 1 equal pieces and e words of at most w characters with the blanks beside them. The longest piece has at least
(L - e (w + 2)) / (e + 1) characters, however long the document's own words are, and its runs of q characters all lie on
one diagonal (position in the document minus position in the passage). So

1. the runs of q characters of all passages become a table, and every run of every document is looked up in it;
2. hits are counted in overlapping bands of diagonals, by document and item;
3. bands with fewer hits than that piece has in any stretch of ``min_words`` words of the item are dropped (items whose
   pieces may be shorter than q take a smaller q);
4. what remains is aligned word by word within the band; a stretch of ``min_words`` words with at most ``max_edits``
   edited words is a leak, and its longest run of equal words is reported.

The items go to all executors, so their size is checked first; larger item sets are taken in several rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import pandas_rows
from .words import Words, mix

Q = 16
#: For items of very short words; powers of two.
SHORTER_Q = (8, 4, 2, 1)
MIN_WORDS = 12
MAX_EDITS = 1
BAND = 16
#: Characters of passages that one round sends to every executor.
ROUND_CHARS = 4_000_000
_TABLE_BITS = 22

LEAK = "doc_id bigint, item_id bigint, longest_run int, aligned_words int, edits int"


def _squeeze(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The same as one array of code points, each text ended by a line feed, and each text's start."""
    keep = np.zeros(len(words.codes) + 1, dtype=np.int32)
    keep[words.start] += 1
    keep[words.end] -= 1
    inside = np.cumsum(keep[:-1]) > 0
    gap = np.zeros(len(words.codes), dtype=bool)
    inner = np.setdiff1d(np.arange(len(words.start)), words.first, assume_unique=False)
    gap[words.start[inner] - 1] = True  # the character before a word that isn't its text's first
    stop = words.text_start[1:] - 1
    take = inside | gap
    take[stop] = True
    codes = np.where(gap, np.uint32(32), words.codes)
    place = np.cumsum(take)
    return codes[take], np.r_[0, place[stop]]


def _grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q characters from each position on; shorter by q - 1 than the text."""
    h, width = codes.astype(np.uint64) + np.uint64(1), 1
    base = 0x9E3779B97F4A7C15
    while width < q:  # q is a power of two
        if len(h) <= width:
            return h[:0]
        h = h[:-width] * np.uint64(base) + h[width:]
        base = base * base % (1 << 64)
        width *= 2
    return mix(h)


def _shortest_piece(length: np.ndarray, min_words: int, max_edits: int) -> int:
    """Characters that the longest equal piece of a stretch has at least, over all stretches of ``min_words`` words."""
    if len(length) < min_words:
        return 0
    windows = np.lib.stride_tricks.sliding_window_view(length, min_words)
    left = windows.sum(axis=1) + min_words - 1 - max_edits * (windows.max(axis=1) + 2)
    return int(-(-left // (max_edits + 1)).min())


class _Items:
    """Passages of one round that take the same q, with the table of their runs of q characters."""

    def __init__(self, ids: list[int], passages: list[str], min_words: int, max_edits: int, q: int):
        self.q = q
        words = Words(passages)
        self.ids = np.array(ids, dtype=np.int64)
        self.word_hash = [words.hash[words.first[k] : words.first[k + 1]] for k in range(len(ids))]
        codes, start = _squeeze(words)
        self.word_at, self.first_word, self.start = _word_starts(words, start), words.first, start
        grams = _grams(codes, q)
        at = np.arange(len(grams))
        item = np.searchsorted(start, at, side="right") - 1
        whole = at + q <= start[item + 1] - 1
        grams, at, item = grams[whole], at[whole], item[whole]
        order = np.argsort(grams, kind="stable")
        self.gram, self.place, self.item = grams[order], (at - start[item])[order], item[order]
        self.maybe = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.maybe[self.gram & np.uint64((1 << _TABLE_BITS) - 1)] = True
        length = words.end - words.start
        self.bound = np.full(len(ids), np.iinfo(np.int64).max)
        for k in range(len(ids)):
            a, b = words.first[k], words.first[k + 1]
            if b - a >= min_words:
                self.bound[k] = max(1, _shortest_piece(length[a:b], min_words, max_edits) - q + 1)

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in ``codes``, item and place in the item's passage of all equal runs."""
        grams = _grams(codes, self.q)
        at = np.flatnonzero(self.maybe[grams & np.uint64((1 << _TABLE_BITS) - 1)])
        lo, hi = np.searchsorted(self.gram, grams[at], side="left"), np.searchsorted(self.gram, grams[at], side="right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.item[entry], self.place[entry]


def _longest_run(equal: np.ndarray) -> int:
    edge = np.diff(np.r_[0, equal.astype(np.int8), 0])
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return int((end - start).max()) if len(start) else 0


def _align(doc: np.ndarray, item: np.ndarray, diagonals: list[int], min_words: int, max_edits: int) -> tuple[int, int, int]:
    """Within the band of word diagonals: longest run of equal words; words and edits of the longest stretch of the item
    that the document holds with at most ``max_edits`` edited, missing or added words."""
    run = 0
    equal = {}
    for d in diagonals:
        lo, hi = max(0, -d), min(len(item), len(doc) - d)
        if hi > lo:
            row = np.zeros(len(item), dtype=bool)
            row[lo:hi] = doc[lo + d : hi + d] == item[lo:hi]
            equal[d] = row
            run = max(run, _longest_run(row))
    best = (run, 0)
    if not equal or max_edits == 0:
        return run, run, 0
    # furthest reaching: from each start on each diagonal, slide over equal words, then pay one edit to go on
    reach = {d: _next_unequal(row) for d, row in equal.items()}
    for d, row in equal.items():
        for start in np.flatnonzero(row & ~np.r_[False, row[:-1]]):
            front = {d: int(reach[d][start])}
            for edits in range(1, max_edits + 1):
                new: dict[int, int] = {}
                for e, j in front.items():
                    for to, skip in ((e, 1), (e + 1, 0), (e - 1, 1)):  # replaced, added to the document, missing from it
                        if to in reach and j + skip < len(item) and reach[to][j + skip] > j + skip:
                            new[to] = max(new.get(to, 0), int(reach[to][j + skip]))
                if not new:
                    break
                front = new
                best = max(best, (max(front.values()) - int(start), edits), key=lambda x: (x[0], -x[1]))
    return run, best[0], best[1]


def _next_unequal(row: np.ndarray) -> np.ndarray:
    """For each place the first place from there on that isn't equal."""
    n = len(row)
    at = np.where(row, n, np.arange(n))
    return np.minimum.accumulate(at[::-1])[::-1]


def _classes(ids: list[int], passages: list[str], min_words: int, max_edits: int) -> list[_Items]:
    words = Words(passages)
    length = words.end - words.start
    piece = [_shortest_piece(length[words.first[k] : words.first[k + 1]], min_words, max_edits) for k in range(len(ids))]
    least = [next((q for q in (Q, *SHORTER_Q) if q <= n), 1) for n in piece]
    long_enough = np.diff(words.first) >= min_words
    out = []
    for q in (Q, *SHORTER_Q):
        some = [k for k in range(len(ids)) if least[k] == q and long_enough[k]]
        if some:
            out.append(_Items([ids[k] for k in some], [passages[k] for k in some], min_words, max_edits, q))
    return out


def _search(ids: list[int], passages: list[str], min_words: int, max_edits: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def found(frame: pd.DataFrame, words: Words, codes: np.ndarray, start: np.ndarray, items: _Items) -> list[tuple]:
        at, item, place = items.hits(codes)
        doc = np.searchsorted(start, at, side="right") - 1
        pair = doc * len(items.ids) + item
        diagonal = at - start[doc] - place + (1 << 31)
        near = np.zeros(len(at), dtype=bool)
        for half in (0, BAND // 2):  # every stretch of BAND / 2 diagonals lies whole in one of the bands
            _, inverse, count = np.unique((pair << 32) + (diagonal + half) // BAND, return_inverse=True, return_counts=True)
            near |= (count[inverse] >= items.bound[item]) if len(at) else near
        at, item, place, doc, pair = at[near], item[near], place[near], doc[near], pair[near]
        word = np.searchsorted(_word_starts(words, start), at, side="right") - 1 - words.first[doc]
        of_item = np.searchsorted(items.word_at, items.start[item] + place, side="right") - 1 - items.first_word[item]
        both = np.unique((pair << 32) + (word - of_item) + (1 << 31))
        pair, shift = both >> 32, (both & 0xFFFFFFFF) - (1 << 31)
        out = []
        for group in np.split(np.arange(len(pair)), np.flatnonzero(np.diff(pair)) + 1):
            if not len(group):
                continue
            a, b = divmod(int(pair[group[0]]), len(items.ids))
            diagonals = sorted({x + k for x in shift[group].tolist() for k in range(-max_edits, max_edits + 1)})
            longest, aligned, edits = _align(words.hash[words.first[a] : words.first[a + 1]], items.word_hash[b], diagonals, min_words, max_edits)
            if aligned >= min_words:
                out.append((frame["doc_id"].iat[a], int(items.ids[b]), longest, aligned, edits))
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = _classes(ids, passages, min_words, max_edits)
        for frame in pandas_rows(frames, 1000, "text"):
            words = Words(frame["text"].tolist())
            codes, start = _squeeze(words)
            out = []
            for items in classes:
                out += found(frame, words, codes, start, items)
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "longest_run", "aligned_words", "edits"])

    return run


def _word_starts(words: Words, start: np.ndarray) -> np.ndarray:
    """Where each word starts in the squeezed text."""
    length = words.end - words.start
    before = np.r_[0, np.cumsum(length + 1)][:-1]  # every word is followed by a blank or its text's line feed
    text = np.repeat(np.arange(len(words.texts)), np.diff(words.first))
    first = words.first[:-1][text]
    return start[text] + before - before[first]


def leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_edits: int = MAX_EDITS) -> DataFrame:
    """``documents(doc_id, text)``, ``items(item_id, passage)`` ->
    ``(doc_id, item_id, longest_run, aligned_words, edits)``: documents that hold a stretch of at least ``min_words``
    words of an item with at most ``max_edits`` edited words.

    Items with fewer words than ``min_words`` and null texts match nothing; equal documents are all reported; an item
    that comes twice counts once. The items are read to the driver in rounds of bounded size, the documents are not.
    """
    spark = documents.sparkSession
    clean = items.where("item_id IS NOT NULL AND passage IS NOT NULL").groupBy("item_id").agg(F.min("passage").alias("passage"))
    chars = clean.agg(F.sum(F.length("passage")).alias("n")).first()["n"] or 0
    rounds = max(1, -(-chars // ROUND_CHARS))
    text = documents.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text")
    found = spark.createDataFrame([], LEAK)
    for k in range(rounds):
        some = clean.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == k).orderBy("item_id").toPandas()
        part = text.mapInPandas(_search(some["item_id"].tolist(), some["passage"].tolist(), min_words, max_edits), LEAK)
        found = part if rounds == 1 else found.unionByName(part)
    return found.distinct()
