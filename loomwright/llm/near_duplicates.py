"""Near-duplicate records with small edits: tiles of bit fingerprints compared by exclusive-or and bit counts.

The set of a text holds the hashes of its runs of three words. Texts with equal sets collapse into one class first, so
copies cost nothing later. A class has

* 90 minimum hashes, which give 30 keys of three: classes that share a key fall into one block. Two classes with
  similarity s miss each other in all blocks with probability (1 - s^3)^30, 1 in 1,500 at 0.6 and 1 in 100,000 at 0.69;
* a fingerprint of 128 bits, one bit of each of 128 minimum hashes. It differs in 64 (1 - s) bits on average.

A set is also a long string of bits, one for each possible run, whose bit count is the size of the set. Two strings of a
and b > a set bits differ in b - a bits at least, so that sets of similarity s need a >= s b. A block is cut into tiles by
this bit count, in steps of its logarithm; a pair of tiles whose bit counts are farther apart than that is skipped. The
fingerprints of the others are compared pairwise in numpy, by exclusive-or and bit counts, and what is within their
radius is verified on the full sets of hashes, exactly.

Blocks larger than one tile are spread: each row goes to the pairs of its tile with those tiles that the radius admits,
so that no task holds more than two tiles of a block, however large the block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..sources.shared import stage
from .spark import pandas_rows
from .words import Words, mix

RUN = 3
MIN_WORDS = 40
SIMILARITY = 0.6
KEYS, ROWS_PER_KEY = 30, 3
BITS = 128
#: Bits in which two classes of the least similarity may differ: their mean 64 (1 - s) = 25.6 and 4.5 deviations.
RADIUS = 46
TILE = 512
#: What the sizes of sets in one band of a large block may differ by, as a logarithm: bands farther apart than the least
#: similarity allows are never compared.
BAND = 0.05

_SKETCH = T.StructType([
    T.StructField("set_id", T.LongType()), T.StructField("n_set", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType())),
    T.StructField("bits_a", T.LongType()), T.StructField("bits_b", T.LongType()),
])


def _sets(texts: list[str | None], min_words: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct run hashes of all texts that are long enough, one after another; borders; the texts' numbers."""
    words = Words(texts)
    hashes, owner = words.runs(run)
    long = (np.diff(words.first) >= max(min_words, run))[owner] if len(owner) else np.zeros(0, dtype=bool)
    hashes, owner = hashes[long], owner[long]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    texts_, first = np.unique(owner, return_index=True)
    return hashes, np.append(first, len(hashes)), texts_


def _sketch(texts: list[str | None], min_words: int = MIN_WORDS, run: int = RUN) -> list[dict | None]:
    out: list[dict | None] = [None] * len(texts)
    hashes, border, which = _sets(texts, min_words, run)
    if not len(which):
        return out
    first = border[:-1]
    n_min = KEYS * ROWS_PER_KEY
    ids = mix(np.add.reduceat(mix(hashes), first) + np.diff(border).astype(np.uint64)).view(np.int64)
    seeds = mix(np.arange(1, max(n_min, BITS) + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    minima = np.empty((len(which), len(seeds)), dtype=np.uint64)
    for j, seed in enumerate(seeds):
        x = hashes * seed
        x ^= x >> np.uint64(32)
        minima[:, j] = np.minimum.reduceat(x, first)
    keys = np.zeros((len(which), KEYS), dtype=np.uint64)
    for j in range(ROWS_PER_KEY):
        keys = mix(keys + minima[:, j:n_min:ROWS_PER_KEY] + np.uint64(j))
    keys = keys.view(np.int64)
    bits = np.packbits((mix(minima[:, :BITS]) & np.uint64(1)).astype(np.uint8), axis=1).view(np.uint64)
    bits = bits.view(np.int64)
    for i, text in enumerate(which):
        out[text] = {"set_id": ids[i], "n_set": border[i + 1] - border[i], "keys": keys[i], "bits_a": bits[i, 0], "bits_b": bits[i, 1]}
    return out


@F.pandas_udf(_SKETCH)
def _sketched(text: pd.Series) -> pd.DataFrame:
    rows: list[dict | None] = []
    for part in pandas_rows([text.to_frame("text")], 250, "text", 500_000):
        rows += _sketch(part["text"].tolist())
    column = {name: [r and r[name] for r in rows] for name in _SKETCH.names}
    # as whole numbers from the start: through floating point, texts without a sketch would cost the others their last bits
    whole = {"set_id": "Int64", "n_set": "Int32", "bits_a": "Int64", "bits_b": "Int64"}
    return pd.DataFrame({name: pd.array(column[name], dtype=whole[name]) if name in whole else pd.Series(column[name], dtype=object) for name in _SKETCH.names})


#: A filter on its result would otherwise be pushed below it and sketch every text a second time.
_sketch_udf = _sketched.asNondeterministic()


def _blocks(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by block; yields whole blocks, a frame's last block being held back for the next frame."""
    held: pd.DataFrame | None = None
    for frame in rows:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        block = frame["block"].to_numpy()
        other = block[::-1] != block[-1] if len(block) else np.zeros(1, dtype=bool)
        last = len(block) - int(np.argmax(other)) if other.any() else 0
        yield frame.iloc[:last]
        held = frame.iloc[last:]
    if held is not None:
        yield held


def _compare(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of classes within the radius, of rows (block, side, set_id, bits_a, bits_b, n_set).

    Side 0 is compared with itself and side 1, side 1 with nothing else."""
    for frame in _blocks(rows):
        if not len(frame):
            continue
        block, side, ids, n = (frame[c].to_numpy() for c in ("block", "side", "set_id", "n_set"))
        a, b = (frame[c].to_numpy().view(np.uint64) for c in ("bits_a", "bits_b"))
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        size = np.diff(np.r_[first, len(block)])
        found = []
        # small blocks: all pairs of equally large blocks in one stroke
        for k in np.unique(size[(size > 1) & (size <= 32)]):
            left, right = np.triu_indices(k, 1)
            rows_ = first[size == k][:, None]
            i, j = (rows_ + left).ravel(), (rows_ + right).ravel()
            found.append((i, j))
        for f, k in zip(first[size > 32], size[size > 32]):
            at = np.arange(f, f + k)
            zero, one = at[side[at] == 0], at[side[at] == 1]
            other = one if len(one) else zero
            for lo in range(0, len(zero), 64):
                some = zero[lo : lo + 64]
                near = np.minimum(n[some][:, None], n[other][None, :]) >= SIMILARITY * np.maximum(n[some][:, None], n[other][None, :]) - 1e-9
                near &= np.bitwise_count(a[some][:, None] ^ a[other][None, :]).astype(np.int32) + np.bitwise_count(b[some][:, None] ^ b[other][None, :]) <= RADIUS
                i, j = np.nonzero(near)
                found.append((some[i], other[j]))
        if not found:
            continue
        i, j = (np.concatenate(x) for x in zip(*found))
        good = (ids[i] != ids[j]) & ~((side[i] == 1) & (side[j] == 1))
        good &= np.minimum(n[i], n[j]) >= SIMILARITY * np.maximum(n[i], n[j]) - 1e-9
        i, j = i[good], j[good]
        distance = np.bitwise_count(a[i] ^ a[j]).astype(np.int32) + np.bitwise_count(b[i] ^ b[j])
        i, j = i[distance <= RADIUS], j[distance <= RADIUS]
        if len(i):
            pairs = pd.DataFrame({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j])})
            yield pairs.drop_duplicates()


def _jaccard(left: list[str], right: list[str]) -> np.ndarray:
    """Similarity of each pair of texts; equal texts of a batch are cut into words once."""
    number: dict[str, int] = {}
    i = [number.setdefault(t, len(number)) for t in left]
    j = [number.setdefault(t, len(number)) for t in right]
    hashes, border, which = _sets(list(number), 0, RUN)
    at = {int(t): k for k, t in enumerate(which)}
    sets = {t: hashes[border[k] : border[k + 1]] for t, k in at.items()}
    none = hashes[:0]
    out = np.zeros(len(i))
    for k, (x, y) in enumerate(zip(i, j)):
        p, q = sets.get(x, none), sets.get(y, none)
        common = len(np.intersect1d(p, q, assume_unique=True))
        out[k] = common / max(1, len(p) + len(q) - common)
    return out


def _verify(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in pandas_rows(rows, 500, "text_a", 500_000):
        s = _jaccard(frame["text_a"].tolist(), frame["text_b"].tolist())
        frame = frame[["tab", "a", "b"]].assign(similarity=s)
        yield frame[s >= SIMILARITY]


def classes(records: DataFrame) -> DataFrame:
    """``records(tab, key, text)`` -> ``(tab, key, text_hash, set_id, sketch...)`` of the texts with enough words.

    Null keys and null or short texts have no row; a key that comes again with the same words counts once.
    """
    long = records.where("key IS NOT NULL AND length(text) >= 2").select("tab", "key", "text").withColumn("s", _sketch_udf("text")).where("s.set_id IS NOT NULL")
    return long.select("tab", "key", F.xxhash64("text").alias("text_hash"), "s.*").withColumn("set_id", F.xxhash64("tab", "set_id"))


def _blocks_of(sketched: DataFrame) -> DataFrame:
    return sketched.select("tab", "set_id", F.posexplode("keys").alias("k", "key")).select(F.xxhash64("tab", "k", "key").alias("block"), "set_id")


def candidate_pairs(sketched: DataFrame) -> DataFrame:
    """Sketches ``(tab, set_id, n_set, keys, bits_a, bits_b)`` -> ``(a, b)``: pairs of classes of one table that share a block and whose fingerprints are within the radius.

    Blocks of more than TILE rows are cut by bands of the sizes of their sets, and bands of more than TILE rows by a hash, from counts
    that are summed before they are shuffled: no task sees a block as a whole.
    """
    fingerprint = ["set_id", "n_set", "bits_a", "bits_b"]
    # copies of one class count here too: a block of nothing but copies is looked at in vain
    shared = _blocks_of(sketched).groupBy("block").agg(F.count(F.lit(1)).alias("n_block")).where("n_block > 1")
    keyed = _blocks_of(sketched.select("tab", "set_id", "keys").dropDuplicates(["set_id"]))
    # written, as small and large blocks and their counts would each work it out again
    rows = stage(keyed.join(shared, "block").join(sketched.select(*fingerprint).distinct(), "set_id"), "block-rows")
    small = rows.where(F.col("n_block") <= TILE).select("block", F.lit(0).alias("side"), *fingerprint)
    big = rows.where(F.col("n_block") > TILE).withColumn("band", F.floor(F.log(F.col("n_set")) / BAND))
    cells = big.groupBy("block", "band").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("parts"))
    big = big.join(cells, ["block", "band"]).withColumn("tile", F.col("band") * (1 << 32) + F.pmod(F.xxhash64("set_id"), "parts"))
    tiles = cells.select("block", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    left = tiles.select("block", (F.col("band") * (1 << 32) + F.col("part")).alias("tile"), F.col("band").alias("x"))
    right = left.withColumnsRenamed({"tile": "tile_b", "x": "y"})
    pairs = left.join(right, "block").where(f"tile <= tile_b AND (y - x - 1) * {BAND} <= {-math.log(SIMILARITY)}").select("block", "tile", "tile_b")
    one = big.join(pairs, ["block", "tile"]).withColumn("side", F.lit(0))
    two = big.withColumnRenamed("tile", "tile_b").join(pairs.where("tile < tile_b"), ["block", "tile_b"]).withColumn("side", F.lit(1))
    large = one.unionByName(two, allowMissingColumns=True).withColumn("block", F.xxhash64("block", "tile", "tile_b")).select("block", "side", *fingerprint)
    return small.unionByName(large).repartition("block").sortWithinPartitions("block", "side", "n_set").mapInPandas(_compare, "a long, b long").distinct()


def near_duplicate_links(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``records(tab, key, text)`` -> members ``(tab, key, set_id)`` and links ``(tab, a, b, similarity)``.

    a and b (a < b) are classes of texts with equal sets of runs; every two classes of one table whose sets have
    |A and B| / |A or B| >= 0.6 are linked, but for the chance of missing all blocks (1 in 1,500 at exactly 0.6).
    """
    sketched = stage(classes(records), "sketched")
    members = sketched.select("tab", "key", "set_id").distinct()
    pairs = stage(candidate_pairs(sketched), "pairs")
    # only the texts of classes that have a candidate are looked up again
    ends = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    first = sketched.groupBy("set_id").agg(F.min(F.struct("tab", "key", "text_hash")).alias("r")).select("set_id", "r.*")
    wanted = first.join(ends, "set_id", "left_semi")
    found = records.select("tab", "key", "text").withColumn("text_hash", F.xxhash64("text")).join(wanted, ["tab", "key", "text_hash"])
    texts = stage(found.groupBy("set_id").agg(F.min("tab").alias("tab"), F.min("text").alias("text")), "texts")
    left, right = texts.select("tab", F.col("set_id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b")
    links = both.select("tab", "a", "b", "text_a", "text_b").mapInPandas(_verify, "tab string, a long, b long, similarity double")
    return members, links


def near_duplicate_keys(records: DataFrame) -> DataFrame:
    """``(tab, key_a, key_b)``: all pairs of keys, key_a < key_b, with similarity of at least 0.6."""
    members, links = near_duplicate_links(records)
    a, b = members.withColumnsRenamed({"set_id": "a", "key": "x"}), members.withColumnsRenamed({"set_id": "b", "key": "y"})
    linked = links.select("tab", "a", "b").join(a, ["tab", "a"]).join(b, ["tab", "b"]).select("tab", "x", "y")
    same = members.withColumnRenamed("key", "x").join(members.withColumnRenamed("key", "y"), ["tab", "set_id"]).where("x < y").select("tab", "x", "y")
    return linked.unionByName(same).select("tab", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).where("key_a <> key_b").distinct()


def near_duplicate_groups(records: DataFrame) -> DataFrame:
    """``(tab, key, group_id, n_links)``: one row per key that has enough words; copies and linked keys share a group."""
    members, links = near_duplicate_links(records)
    links = stage(links, "links")
    found = connected_components(links.select("a", "b"))
    degree = links.select("tab", F.explode(F.array("a", "b")).alias("set_id")).groupBy("tab", "set_id").agg(F.count(F.lit(1)).alias("n_links"))
    grouped = members.join(found.select(F.col("node").alias("set_id"), "component"), "set_id", "left").join(degree, ["tab", "set_id"], "left")
    return grouped.select("tab", "key", F.coalesce("component", "set_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def without_source_line(text: Column) -> Column:
    return F.regexp_replace(text, r"\n?Source: [^\n]*\s*\z", "")


def corpus_records(chunks: DataFrame, clean_docs: DataFrame) -> DataFrame:
    """The texts of both tables: chunks without their last line, and blocks in pos order joined by a blank."""
    body = F.array_join(F.transform(F.array_sort(F.transform("blocks", lambda b: F.struct(b["pos"].alias("pos"), b["text"].alias("text")))), lambda b: b["text"]), " ")
    one = chunks.select(F.lit("chunks").alias("tab"), F.col("chunk_id").alias("key"), without_source_line(F.col("text")).alias("text"))
    return one.unionByName(clean_docs.select(F.lit("clean_docs").alias("tab"), F.col("doc_id").alias("key"), body.alias("text")))
