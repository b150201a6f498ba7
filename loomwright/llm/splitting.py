"""Splitting oversized items at natural boundaries, by ranges.

No task holds an item as a whole. An item is read in ranges of characters of a text (``text_ranges``) or of bytes of a
UTF-8 file (``file_ranges``). Then

1. for each range a task lists where words start and end in it, and how good a cut before each word is; the halo, a few
   characters before the range, tells words and sentence ends that lie on its border;
2. the lists of an item are stitched: prefix sums over its ranges number the words of the item;
3. words are dealt by their number into stretches of ``STRETCH`` words with the words that the neighbours share. A stretch
   begins with a cut at the first natural boundary after its first word, so stretches are cut independently, and
   where ranges begin doesn't change a piece;
4. pieces are numbered by prefix sums over stretches and given by offset; their text is cut out of the ranges they touch.

Prefix sums run in two levels, within groups of ranges and over the groups' totals, so that no task gets all ranges of a
giant item. An item of one range has its numbers at once and isn't shuffled; it is cut by the same rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.shared import one_delivery, stage
from .spark import pandas_rows
from .words import codes_of

MAX_WORDS = 256
OVERLAP = 40
#: Characters (or bytes) of a range, and what is seen before it.
RANGE = 4096
HALO = 4
#: Words of a stretch, in pieces; ranges of a group of the prefix sums.
STRETCH = 16
GROUP = 4096

#: How good a cut before a word is: 3 after an empty line, 2 after a line end, 1 after a sentence, 0 elsewhere.
_WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_LINE = [10, 11, 12, 13, 0x85, 0x2028, 0x2029]
_STOP = [ord(c) for c in ".!?।॥…。"]


def text_ranges(items: DataFrame, size: int = RANGE) -> DataFrame:
    """``items(item, text)`` -> ``(item, n, n_ranges, at, before, part)``: part is the text of range n, which starts at
    character ``at``, with up to HALO characters before it. Null texts and items have no range."""
    last = F.floor((F.length("text") - 1) / size).cast("int")
    ranged = items.where("item IS NOT NULL AND length(text) > 0").select("item", "text", (last + 1).alias("n_ranges"), F.explode(F.sequence(F.lit(0), last)).alias("n"))
    at = F.col("n").cast("long") * size
    before = F.least(at, F.lit(HALO)).cast("int")
    return ranged.select("item", "n", "n_ranges", at.alias("at"), before.alias("before"), F.substring("text", (at - before + 1).cast("int"), before + size).alias("part"))


def file_ranges(files: DataFrame, size: int = RANGE) -> DataFrame:
    """``files(item, path, bytes)`` of UTF-8 files on any file system that Arrow opens -> ``(item, n, n_ranges, at, before,
    part)``, ``at`` counting bytes. Each task reads the bytes of its ranges; a character belongs to the range in which its
    first byte lies, so that none is cut apart. Broken bytes count as one character each."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            rows = []
            for path, n in zip(frame["path"], frame["n"]):
                system, name = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
                with system.open_input_file(name) as f:
                    low = max(0, n * size - 4 * HALO)
                    f.seek(low)
                    raw = f.read(n * size + size + 3 - low)
                own, end = n * size - low, min(len(raw), n * size - low + size)
                while own < end and n and raw[own] & 0xC0 == 0x80:  # the rest of a character of the range before
                    own += 1
                while end < len(raw) and raw[end] & 0xC0 == 0x80:
                    end += 1
                first = next((k for k in range(own) if raw[k] & 0xC0 != 0x80), own)
                before = raw[first:own].decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode("utf-8")
                rows.append((low + own, len(before), before + raw[own:end].decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode("utf-8")))
            at, before, part = zip(*rows) if rows else ([], [], [])
            yield frame[["item", "n", "n_ranges"]].assign(at=list(at), before=list(before), part=list(part))

    last = F.floor((F.col("bytes") - 1) / size).cast("int")
    ranged = files.where("item IS NOT NULL AND bytes > 0").select("item", "path", (last + 1).alias("n_ranges"), F.explode(F.sequence(F.lit(0), last)).alias("n")).repartition("item", "n")
    return ranged.mapInPandas(read, f"item {dict(files.dtypes)['item']}, n_ranges int, n int, at long, before int, part string").select("item", "n", "n_ranges", "at", "before", "part")


def _table(points) -> np.ndarray:
    table = np.zeros(0x3004, dtype=bool)
    table[list(points)] = True
    return table


_IS_WHITE, _IS_LINE, _IS_STOP, _IS_CLOSING = _table(_WHITE), _table(_LINE), _table(_STOP), _table(ord(c) for c in "\"')]”’»")


def _list_words(parts: list[str], before: np.ndarray, at: np.ndarray, in_bytes: bool = False) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Starts and ends of the words of each range, as offsets in its item (in characters or in bytes of UTF-8), and the kind
    of cut before each start. All ranges of a batch are one array; the line feed that ``codes_of`` puts after each part is no part of any of them."""
    codes, first = codes_of(parts)
    place = np.r_[0, np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))] if in_bytes else np.arange(len(codes) + 1)
    codes = np.minimum(codes, 0x3003)
    white = _IS_WHITE[codes]
    prior = np.r_[True, white[:-1]]
    prior[first[:-1]] = True
    starts, ends = np.flatnonzero(~white & prior), np.flatnonzero(white & ~prior)
    start_part, end_part = (np.searchsorted(first, x, side="right") - 1 for x in (starts, ends))
    # what the halo shows belongs to the range before, and a word that runs to the end of its part may go on
    own, closed = starts >= first[start_part] + before[start_part], (ends >= first[end_part] + before[end_part]) & (ends < first[end_part + 1] - 1)
    starts, start_part, ends, end_part = starts[own], start_part[own], ends[closed], end_part[closed]
    line = _IS_LINE[codes] & ~((codes == 10) & np.r_[False, codes[:-1] == 13])
    line[first[1:] - 1] = False
    lines = np.r_[0, np.cumsum(line)]  # line ends before each place
    visible = np.r_[-1, np.maximum.accumulate(np.where(white, -1, np.arange(len(codes))))]
    last = visible[starts]  # the last visible character before each word
    known = last >= first[start_part]
    n_lines = lines[starts] - lines[np.where(known, last, first[start_part])]
    stop = known & _IS_STOP[codes[np.maximum(last, 0)]]
    stop |= known & _IS_CLOSING[codes[np.maximum(last, 0)]] & (last > first[start_part]) & _IS_STOP[codes[np.maximum(last - 1, 0)]]
    cut = np.where(n_lines >= 2, 3, np.where(n_lines == 1, 2, stop)).astype(np.uint8)
    shift = at - place[first[:-1] + before]
    split = np.searchsorted(start_part, np.arange(1, len(parts)))
    return np.split(place[starts] + shift[start_part], split), np.split(place[ends] + shift[end_part], np.searchsorted(end_part, np.arange(1, len(parts)))), np.split(cut, split)


def _cuts(cut: np.ndarray, first: int, stop: int, most: int, max_words: int) -> list[int]:
    """Where pieces start, from word ``first`` on; ``stop`` is where the next stretch starts. ``cut`` is by word from
    ``first`` on. The first piece holds up to ``max_words`` words, later ones ``most`` new ones."""
    at, out = 0, [0]
    n = stop - first
    room = max_words if first == 0 else most
    while n - at > room:
        window = cut[at + 1 : at + room + 1]
        best = int(window.max())
        # the latest of the best boundaries, if it leaves the piece half full; else the next best kind
        while best > 0:
            where = np.flatnonzero(window >= best)
            if len(where) and where[-1] + 1 >= room // 2:
                break
            best -= 1
        step = int(where[-1]) + 1 if best > 0 else room
        at += step
        out.append(at)
        room = most
    return out


def _pieces(j: int, total: int, base: int, starts: np.ndarray, cut: np.ndarray, end_base: int, ends: np.ndarray, stop_at: int, max_words: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces ``(start, end, words)`` of stretch j of an item of ``total`` words, from the offsets of its words from number
    ``base`` on and of word ends from ``end_base`` on; the item ends at ``stop_at``."""
    most = max_words - overlap
    size = STRETCH * most
    if total <= max_words:
        first, stop = 0, total if j == 0 else 0
        bounds = [0, total] if j == 0 else []
    else:
        first = j * size + (0 if j == 0 else _opening(cut[j * size - base :], most))
        stop = total if (j + 1) * size >= total else (j + 1) * size + _opening(cut[(j + 1) * size - base :], most)
        bounds = [first + x for x in _cuts(cut[first - base :], first, stop, most, max_words)] + [stop] if first < stop else []
    out = []
    for a, b in zip(bounds, bounds[1:]):
        from_ = max(0, a - overlap)
        k = b - 1 - end_base
        out.append((int(starts[from_ - base]), int(ends[k]) if k < len(ends) else stop_at, b - from_))
    return out


def _opening(cut: np.ndarray, most: int) -> int:
    """The word, counted from its first one, before which a stretch begins to cut."""
    natural = np.flatnonzero(cut[:most] > 0)
    return int(natural[0]) if len(natural) else 0


def _listed(max_words: int, overlap: int, in_bytes: bool):
    """Ranges -> of items of one range their pieces, with their text; of others the lists of each range."""
    size = STRETCH * (max_words - overlap)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pandas_rows(frames, 2000, "part", 1_000_000):
            before, at = (frame[c].to_numpy().astype(np.int64) for c in ("before", "at"))
            rows = []
            for item, n, n_ranges, part, lead, where, starts, ends, cut in zip(frame["item"], frame["n"], frame["n_ranges"], frame["part"], before, at, *_list_words(frame["part"].tolist(), before, at, in_bytes)):
                length = len(part[lead:].encode("utf-8", "replace")) if in_bytes else len(part) - lead
                if n_ranges > 1:
                    rows.append((item, n, -1, None, None, None, None, len(starts), len(ends), int(where) + int(length), starts.tobytes(), ends.tobytes(), cut.tobytes()))
                    continue
                found = [x for j in range(-(-len(starts) // size)) for x in _pieces(j, len(starts), 0, starts, cut, 0, ends, int(length), max_words, overlap)]
                rows += [(item, k, len(found), a, b, w, None if in_bytes else part[a:b], 0, 0, 0, None, None, None) for k, (a, b, w) in enumerate(found)]
            yield pd.DataFrame(rows, columns=_LISTED).astype({"char_start": "Int64", "char_end": "Int64", "n_words": "Int32"})

    return run


_LISTED = ["item", "n", "n_pieces", "char_start", "char_end", "n_words", "text", "k", "k_ends", "stop", "starts", "ends", "cut"]


def _running(rows: DataFrame, order: str, *values: str) -> DataFrame:
    """``rows(item, order, values)`` with ``value_before``: the sum over the rows of the item before, in two levels."""
    grouped = rows.withColumn("_g", F.floor(F.col(order) / GROUP))
    inner = W.partitionBy("item", "_g").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy("item").orderBy("_g").rowsBetween(W.unboundedPreceding, -1)
    totals = grouped.groupBy("item", "_g").agg(*[F.sum(v).alias(v) for v in values])
    totals = totals.select("item", "_g", *[F.coalesce(F.sum(v).over(outer), F.lit(0)).alias(f"_{v}") for v in values])
    within = grouped.select(*rows.columns, "_g", *[F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"_in_{v}") for v in values])
    return within.join(totals, ["item", "_g"]).select(*rows.columns, *[(F.col(f"_{v}") + F.col(f"_in_{v}")).alias(f"{v}_before") for v in values])


def _dealt(max_words: int, overlap: int):
    """Lists of ranges with their numbers -> the part of each stretch that lies in the range."""
    most = max_words - overlap
    size = STRETCH * most

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                a, b, x, y = int(r.k_before), int(r.k_before + r.k), int(r.k_ends_before), int(r.k_ends_before + r.k_ends)
                for j in range(max(0, (min(a, x) - most) // size), (max(b, y) + overlap) // size + 1):
                    low, high = max(a, j * size - overlap), min(b, (j + 1) * size + most)
                    e_low, e_high = max(x, j * size), min(y, (j + 1) * size + most)
                    if (low < high or e_low < e_high) and j * size < r.total:
                        rows.append((r.item, j, r.n, r.total, r.stop_at, low, r.starts[8 * (low - a) : 8 * max(low, high) - 8 * a], r.cut[low - a : max(low, high) - a], e_low, r.ends[8 * (e_low - x) : 8 * max(e_low, e_high) - 8 * x]))
            yield pd.DataFrame(rows, columns=["item", "j", "n", "total", "stop_at", "low", "starts", "cut", "e_low", "ends"])

    return run


def _stitched(max_words: int, overlap: int):
    """All rows of a stretch -> its pieces."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        words, ends = rows[rows["starts"].str.len() > 0], rows[rows["ends"].str.len() > 0]
        offsets = lambda c: np.frombuffer(b"".join(c), dtype=np.int64)
        cut = np.frombuffer(b"".join(words["cut"]), dtype=np.uint8)
        base, end_base = (int(x[c].iat[0]) if len(x) else 0 for x, c in ((words, "low"), (ends, "e_low")))
        j = int(rows["j"].iat[0])
        found = _pieces(j, int(rows["total"].iat[0]), base, offsets(words["starts"]), cut, end_base, offsets(ends["ends"]), int(rows["stop_at"].iat[0]), max_words, overlap) if len(words) else []
        return pd.DataFrame([(rows["item"].iat[0], j, k, a, b, w) for k, (a, b, w) in enumerate(found)], columns=["item", "j", "k", "char_start", "char_end", "n_words"])

    return run


def _found(ranges: DataFrame, max_words: int, overlap: int, in_bytes: bool) -> tuple[DataFrame, DataFrame]:
    """Pieces of items of one range, with their text, and of items of several."""
    kind = dict(ranges.dtypes)["item"]
    names = ["item", "piece", "n_pieces", "char_start", "char_end", "n_words"]
    listed = ranges.select("item", "n", "n_ranges", "before", "at", "part").mapInPandas(_listed(max_words, overlap, in_bytes), f"item {kind}, n int, n_pieces int, char_start long, char_end long, n_words int, text string, k long, k_ends long, stop long, starts binary, ends binary, cut binary")
    listed = stage(listed, "range-words")
    one = listed.where("n_pieces >= 0").select("item", (F.col("n") + 1).alias("piece"), *names[2:], "text")
    lists = listed.where("n_pieces = -1")
    numbered = _running(lists.select("item", "n", "k", "k_ends"), "n", "k", "k_ends")
    totals = lists.groupBy("item").agg(F.sum("k").alias("total"), F.max("stop").alias("stop_at"))
    rows = lists.select("item", "n", "starts", "ends", "cut").join(numbered, ["item", "n"]).join(totals, "item")
    dealt = rows.mapInPandas(_dealt(max_words, overlap), f"item {kind}, j long, n int, total long, stop_at long, low long, starts binary, cut binary, e_low long, ends binary")
    cut = stage(dealt.groupBy("item", "j").applyInPandas(_stitched(max_words, overlap), f"item {kind}, j long, k int, char_start long, char_end long, n_words int"), "stretch-pieces")
    each = _running(cut.groupBy("item", "j").agg(F.count(F.lit(1)).alias("m")), "j", "m")
    n_pieces = each.groupBy("item").agg(F.sum("m").cast("int").alias("n_pieces"))
    several = cut.join(each, ["item", "j"]).join(n_pieces, "item").withColumn("piece", (F.col("m_before") + F.col("k") + 1).cast("int"))
    return one, several.select(*names)


def piece_offsets(ranges: DataFrame, max_words: int = MAX_WORDS, overlap: int = OVERLAP, in_bytes: bool = False) -> DataFrame:
    """``(item, piece, n_pieces, char_start, char_end, n_words)`` of a table of ranges, offsets in what ``at`` counts.

    Every piece has at most ``max_words`` words and shares ``overlap`` of them with the piece before; the pieces of an
    item cover all its words. Items without a word have no piece. The size of the ranges doesn't change the pieces.
    """
    one, several = _found(ranges, max_words, overlap, in_bytes)
    return one.drop("text").unionByName(several)


def split_items(items: DataFrame, max_words: int = MAX_WORDS, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """``items(item, text)`` -> pieces with their text, ``(item, piece, n_pieces, char_start, char_end, n_words, text)``.

    An item that comes twice with the same text counts once; with other texts, that of the smallest hash is split. Null and
    blank texts have no pieces, a text of up to ``max_words`` words is one piece without the white space around it.
    """
    ranges = text_ranges(one_delivery(items.select("item", "text"), "item"), size)
    one, several = _found(ranges, max_words, overlap, False)
    touched = several.withColumn("n", F.explode(F.sequence(F.floor(F.col("char_start") / size).cast("int"), F.floor((F.col("char_end") - 1) / size).cast("int"))))
    parts = touched.join(ranges.where("n_ranges > 1").select("item", "n", "at", "before", "part"), ["item", "n"])
    low, high = F.greatest("char_start", "at"), F.least(F.col("char_end"), F.col("at") + size)
    parts = parts.withColumn("s", F.substring("part", (low - F.col("at") + F.col("before") + 1).cast("int"), (high - low).cast("int")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]), "")
    cut = parts.groupBy("item", "piece").agg(F.first("n_pieces").alias("n_pieces"), F.first("char_start").alias("char_start"), F.first("char_end").alias("char_end"), F.first("n_words").alias("n_words"), text.alias("text"))
    return one.unionByName(cut.select(*one.columns))
