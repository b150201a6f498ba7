"""Lines repeated across one source's documents.

Lines are masked (words with figures and capitalised words after the first become marks), the masked lines of a source are
clustered by locality-sensitive hashing of their letter runs, and clusters found in many of the source's documents are
dropped.

Only distinct lines are hashed: a line is first counted by (source, its letters), so a notice in a million pages is one
row. A masked line has 24 minimum hashes; three of them make a band, and lines of a source that share a band share a
bucket. Every line meets every other line of its buckets, in tiles of bounded size: their minimum hashes are compared
first, and pairs that agree in ``AGREE`` of them are verified on their full sets of letter runs. Two lines of similarity
0.8 agree in fewer with a chance below 1 in 5,000. Clusters are the connected components; a line that no other resembles
is a cluster of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..sources.shared import one_delivery, stage
from .spark import pandas_rows
from .words import codes_of, hashes_of_spans, is_upper, kinds_of_chars, mix, unfolded

MIN_DOCS = 5
MIN_SHARE = 0.2
SIMILARITY = 0.8
BANDS, ROWS = 8, 3
GRAM = 4
#: Minimum hashes of all 24 in which two lines must agree to be verified.
AGREE = 12
#: Lines of a bucket that are compared with as many others at once.
TILE = 512
#: Kinds of blocks that may be removed: headings, table rows and facts stay.
REMOVABLE = ("paragraph", "list_item", "footnote")

_KEYS = T.StructType([T.StructField("line", T.BinaryType()), T.StructField("masked", T.StringType())])


def line_keys(lines: list[str]) -> tuple[list[bytes | None], list[str]]:
    """Of each line a 128-bit hash of its letters (after NFKC, in lower case; none without letters) and its masked form.

    In the masked form a word with a digit is "0", a word that begins with a capital and isn't the first is "§", and marks
    in a row are one."""
    upper = [unfolded(x).replace("\n", " ") for x in lines]
    return letter_keys([x.lower() for x in upper]), masks(upper)


def letter_keys(folded: list[str]) -> list[bytes | None]:
    lowered, low_start = codes_of(folded)
    kind = kinds_of_chars(lowered)
    letter = kind == 1
    one = hashes_of_spans(lowered, letter, low_start[:-1], low_start[1:])
    two = mix(one ^ hashes_of_spans(mix(lowered.astype(np.uint64)).astype(np.uint32), letter, low_start[:-1], low_start[1:]))
    has = np.add.reduceat(letter.astype(np.int64), low_start[:-1]) > 0 if len(folded) else np.zeros(0, dtype=bool)
    both = np.stack([one, two], axis=1)
    return [both[k].tobytes() if has[k] else None for k in range(len(folded))]


def masks(lines: list[str]) -> list[str]:
    cased, start = codes_of(lines)
    kind = kinds_of_chars(cased)
    edge = np.diff(np.r_[True, kind == 4, True].astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    of = np.searchsorted(start, first, side="right") - 1
    digits = np.r_[0, np.cumsum(kind == 2)]
    opens = np.r_[True, of[1:] != of[:-1]]
    initial = cased[first]
    capital = (kind[first] == 1) & ~opens & is_upper(initial)
    mark = np.where(digits[last] > digits[first], 1, np.where(capital, 2, 0))
    again = np.r_[False, (mark[1:] == mark[:-1]) & (mark[1:] > 0)] & ~opens
    out: list[list[str]] = [[] for _ in lines]
    text = "\n".join(lines)
    for k, a, b, m, skip in zip(of.tolist(), first.tolist(), last.tolist(), mark.tolist(), again.tolist()):
        if not skip:
            out[k].append("0" if m == 1 else "§" if m == 2 else text[a:b])
    return [" ".join(x).lower() for x in out]


@F.pandas_udf(_KEYS)
def _keyed(text: pd.Series) -> pd.DataFrame:
    keys: list[bytes | None] = []
    masks: list[str] = []
    for rows in pandas_rows([text.to_frame("text")], 20_000, "text", 1_000_000):
        k, m = line_keys(rows["text"].tolist())
        keys, masks = keys + k, masks + m
    return pd.DataFrame({"line": pd.Series(keys, dtype=object), "masked": pd.Series(masks, dtype=object)})


#: A filter on its result would otherwise be pushed below it and key every line a second time.
_line_keys = _keyed.asNondeterministic()


def _gram_sets(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the GRAM-character runs of each line (the whole line if shorter), and borders."""
    padded = [x if len(x) >= GRAM else x.ljust(GRAM, "\0") for x in lines]
    codes, start = codes_of(padded)
    codes = codes.astype(np.uint64) + np.uint64(1)
    n = max(0, len(codes) - GRAM + 1)
    h = codes[:n].copy()
    for j in range(1, GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
    inside = np.ones(len(h), dtype=bool)
    for j in range(GRAM):  # runs that hold a line's end
        at = start[1:] - 1 - j
        inside[at[(at >= 0) & (at < len(h))]] = False
    size = start[1:] - start[:-1] - GRAM
    return mix(h[inside]), np.r_[0, np.cumsum(size)]


def minimum_hashes(lines: list[str]) -> np.ndarray:
    """(lines, BANDS * ROWS) minimum hashes of 32 bits."""
    hashes, border = _gram_sets(lines)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    seeds = (mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return np.stack([np.minimum.reduceat(short * seed, border[:-1]) for seed in seeds], axis=1) if len(lines) else np.zeros((0, BANDS * ROWS), dtype=np.uint32)


_SIGNED = T.StructType([T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])


@F.pandas_udf(_SIGNED)
def _signed(line: pd.Series) -> pd.DataFrame:
    """The bands of each line, and its minimum hashes as one byte each."""
    bands: list[np.ndarray] = []
    sigs: list[bytes] = []
    for rows in pandas_rows([line.to_frame("text")], 5000, "text", 500_000):
        low = minimum_hashes(rows["text"].tolist())
        out = np.zeros((len(low), BANDS), dtype=np.uint64)
        for j in range(low.shape[1]):
            out[:, j // ROWS] = mix(out[:, j // ROWS] + low[:, j].astype(np.uint64) + np.uint64(j))
        bands += list(out.view(np.int64))
        sigs += [x.tobytes() for x in (mix(low.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)]  # a minimum's own leading bits are all small
    return pd.DataFrame({"bands": pd.Series(bands, dtype=object), "sig": pd.Series(sigs, dtype=object)})


def _tiles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (tile, side, mask_id, sig), sorted by tile -> pairs of a tile that agree in AGREE minimum hashes. Rows of side 0
    meet those of side 1, or each other if the tile has one side. A frame's last tile is held back for the next frame."""
    held: pd.DataFrame | None = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        tile = frame["tile"].to_numpy()
        last = int(np.flatnonzero(tile != tile[-1]).max()) + 1 if len(tile) and (tile != tile[-1]).any() else 0
        held = frame.iloc[last:]
        yield _agreeing(frame.iloc[:last])
    if held is not None:
        yield _agreeing(held)


def _agreeing(rows: pd.DataFrame) -> pd.DataFrame:
    if len(rows) < 2:
        return pd.DataFrame({"a": np.zeros(0, dtype=np.int64), "b": np.zeros(0, dtype=np.int64)})
    tile, side, ids = (rows[c].to_numpy() for c in ("tile", "side", "mask_id"))
    sig = np.frombuffer(b"".join(rows["sig"]), dtype=np.uint8).reshape(len(rows), -1)
    first = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
    size = np.diff(np.r_[first, len(tile)])
    found = []
    for k in np.unique(size[(size > 1) & (size <= 24)]):  # all tiles of one size in one stroke
        left, right = np.triu_indices(k, 1)
        at = first[size == k]
        for lo in range(0, len(at), max(1, 400_000 // len(left))):
            some = at[lo : lo + max(1, 400_000 // len(left)), None]
            i, j = (some + left).ravel(), (some + right).ravel()
            near = (sig[i] == sig[j]).sum(axis=1) >= AGREE
            found.append((i[near], j[near]))
    for f, k in zip(first[size > 24], size[size > 24]):
        at = np.arange(f, f + k)
        zero, one = at[side[at] == 0], at[side[at] == 1]
        other = one if len(one) else zero
        for lo in range(0, len(zero), 64):
            some = zero[lo : lo + 64]
            i, j = np.nonzero((sig[some][:, None, :] == sig[other][None, :, :]).sum(axis=2) >= AGREE)
            found.append((some[i], other[j]))
    i, j = (np.concatenate(x) for x in zip(*found)) if found else (first[:0], first[:0])
    keep = ids[i] != ids[j]
    keep &= (side[i] != side[j]) | (side[i] == 0)
    pairs = pd.DataFrame({"a": np.minimum(ids[i], ids[j])[keep], "b": np.maximum(ids[i], ids[j])[keep]})
    return pairs.drop_duplicates()


def _similar(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if not len(frame):
            continue
        (x, p), (y, q) = _gram_sets(frame["line_a"].tolist()), _gram_sets(frame["line_b"].tolist())
        keep = np.zeros(len(frame), dtype=bool)
        for k in range(len(frame)):
            a, b = np.unique(x[p[k] : p[k + 1]]), np.unique(y[q[k] : q[k + 1]])
            common = len(np.intersect1d(a, b, assume_unique=True))
            keep[k] = common >= SIMILARITY * (len(a) + len(b) - common)
        yield frame.loc[keep, ["a", "b"]]


def lines_of(pages: DataFrame) -> DataFrame:
    """``clean_docs`` -> ``(doc_id, source_id, pos, kind, text)``, one row per block with text; pages without an id or
    source belong to no site and have none. A page that was delivered twice gives its rows once."""
    at_site = pages.where("doc_id IS NOT NULL AND source_id IS NOT NULL").select("doc_id", "source_id", F.explode("blocks").alias("b"))
    return at_site.where("b.text IS NOT NULL").select("doc_id", "source_id", F.col("b.pos").cast("long").alias("pos"), F.col("b.kind").alias("kind"), F.col("b.text").alias("text"))


def bucket_pairs(signed: DataFrame) -> DataFrame:
    """``(bucket, mask_id, sig)`` -> distinct ``(a, b)``, a < b: pairs that share a bucket and agree in AGREE minimum hashes.

    Buckets of more than ``TILE`` lines are dealt into groups, and each pair of groups is a tile, so that no task gets a
    large bucket whole; the lines of a bucket are counted before anything is shuffled for it."""
    large = signed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE)
    dealt = signed.join(large, "bucket", "left").withColumn("groups", F.ceil(F.coalesce("n", F.lit(1)) / TILE).cast("int")).withColumn("g", F.pmod(F.xxhash64("mask_id", F.lit(5)), F.col("groups")).cast("int"))
    with_group = F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda j: F.struct(F.least("g", j).alias("i"), F.greatest("g", j).alias("j"), (F.col("g") > j).cast("int").alias("side")))
    tiles = dealt.select("bucket", "mask_id", "sig", F.inline(with_group)).select(F.xxhash64("bucket", "i", "j").alias("tile"), "side", "mask_id", "sig")
    return tiles.repartition("tile").sortWithinPartitions("tile", "side").mapInPandas(_tiles, "a long, b long").distinct()


def repeated_lines(pages: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """``clean_docs`` -> lines ``(doc_id, source_id, pos, kind, line, masked)`` and statistics of the repeated ones
    ``(source_id, line, line_docs, cluster, cluster_docs, pages)``.

    ``line`` is a hash of the line's letters. Statistics have the lines whose cluster occurs in at least ``min_docs``
    pages and ``min_share`` of the pages of their source; a page without text counts as a page.
    """
    site = pages.where("doc_id IS NOT NULL AND source_id IS NOT NULL").groupBy("source_id").agg(F.countDistinct("doc_id").alias("pages"))
    keyed = lines_of(pages).withColumn("k", _line_keys("text")).where("k.line IS NOT NULL")
    lines = stage(keyed.select("doc_id", "source_id", "pos", "kind", "k.line", "k.masked"), "lines")
    by_doc = lines.groupBy("source_id", "line", "doc_id").agg(F.min("masked").alias("masked"))
    counted = by_doc.groupBy("source_id", "line").agg(F.count(F.lit(1)).alias("line_docs"), F.min("masked").alias("masked"))
    counted = stage(counted.withColumn("mask_id", F.xxhash64("source_id", "masked")), "counted-lines")
    masks = counted.groupBy("mask_id", "source_id").agg(F.min("masked").alias("masked"))
    signed = stage(masks.select("mask_id", "source_id", _signed("masked").alias("s")).select("mask_id", "source_id", "s.*"), "signed-lines")
    each = signed.select("mask_id", "source_id", "sig", F.posexplode("bands").alias("band", "h"))
    near = stage(bucket_pairs(each.select(F.xxhash64("source_id", "band", "h").alias("bucket"), "mask_id", "sig")), "line-pairs")
    text = masks.select("mask_id", "masked")
    pairs = near.join(text.withColumnsRenamed({"mask_id": "a", "masked": "line_a"}), "a").join(text.withColumnsRenamed({"mask_id": "b", "masked": "line_b"}), "b")
    links = pairs.select("a", "b", "line_a", "line_b").mapInPandas(_similar, "a long, b long")
    cluster = connected_components(links).select(F.col("node").alias("mask_id"), F.col("component").alias("cluster"))
    of_line = counted.join(cluster, "mask_id", "left").select("source_id", "line", "line_docs", F.coalesce("cluster", "mask_id").alias("cluster"))
    # a cluster's documents can't be more than the sum over its lines, so only clusters with enough are counted exactly
    hopeful = of_line.groupBy("source_id", "cluster").agg(F.sum("line_docs").alias("most"), F.count(F.lit(1)).alias("n_lines")).join(site, "source_id")
    hopeful = hopeful.where((F.col("most") >= min_docs) & (F.col("most") >= min_share * F.col("pages")))
    of_line = stage(of_line.join(hopeful, ["source_id", "cluster"]), "hopeful-lines")
    docs = lines.select("source_id", "line", "doc_id").join(of_line.where("n_lines > 1").select("source_id", "line", "cluster"), ["source_id", "line"]).select("source_id", "cluster", "doc_id").distinct()
    counts = docs.groupBy("source_id", "cluster").agg(F.count(F.lit(1)).alias("cluster_docs"))
    stats = of_line.join(counts, ["source_id", "cluster"], "left").withColumn("cluster_docs", F.coalesce("cluster_docs", "line_docs"))
    stats = stats.where((F.col("cluster_docs") >= min_docs) & (F.col("cluster_docs") >= min_share * F.col("pages")))
    return lines, stage(stats.select("source_id", "line", "line_docs", "cluster", "cluster_docs", "pages"), "repeated-lines")


def found_lines(pages: DataFrame) -> DataFrame:
    """``(doc_id, line_no)``: paragraphs, list items and notes whose very letters occur in at least 5 pages and a fifth
    of the pages of their source. Lines of the repeated clusters are checked one by one."""
    lines, stats = repeated_lines(pages)
    exact = stats.where((F.col("line_docs") >= MIN_DOCS) & (F.col("line_docs") * 5 >= F.col("pages"))).select("source_id", "line")
    kinds = lines.where(F.col("kind").isin(*REMOVABLE))
    return kinds.join(exact, ["source_id", "line"], "left_semi").select("doc_id", F.col("pos").alias("line_no")).distinct()


def cleaned_pages(pages: DataFrame) -> DataFrame:
    """``(doc_id, n_removed, text)``: every page with an id, without those paragraphs, list items and notes that belong to
    repeated clusters. Headings, table rows and facts stay, however often they recur.

    The blocks come in the order of pos, one per line. A page delivered twice comes once, with the delivery of the
    smallest hash of its blocks; pages without blocks have an empty text, pages without a source keep all their lines."""
    lines, stats = repeated_lines(pages)
    drop = lines.where(F.col("kind").isin(*REMOVABLE)).join(stats.select("source_id", "line"), ["source_id", "line"], "left_semi")
    gone = drop.groupBy("doc_id").agg(F.collect_set("pos").alias("gone"))
    kept = one_delivery(pages.where("doc_id IS NOT NULL").select("doc_id", "blocks"), "doc_id").join(gone, "doc_id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<bigint>")))
    blocks = F.array_sort(F.transform("blocks", lambda b: F.struct(b["pos"].cast("long").alias("pos"), b["text"].alias("text"), b["kind"].alias("kind"))))
    stays = lambda b: ~F.coalesce(F.array_contains("gone", b["pos"]) & b["kind"].isin(*REMOVABLE), F.lit(False))
    text = F.array_join(F.transform(F.filter(blocks, stays), lambda b: b["text"]), "\n")
    return kept.select("doc_id", F.size("gone").alias("n_removed"), F.coalesce(text, F.lit("")).alias("text"))
