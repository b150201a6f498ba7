"""The most similar vectors for every vector: a hash-prefix forest.

Every vector gets a long hash string in each of several trees, one bit per hyperplane (Bawa, Condie and Ganesan, 2005: LSH
forest). A tree is the sorted array of its hash strings. A vector's neighbours in it are those that share a prefix: the
search descends to the longest match and ascends, in all trees at once, one bit at a time, until the prefixes that the
vector shares hold ``REACH`` candidates together. So prefixes are long where vectors are dense and short where they are
sparse. Candidates are compared exactly, in double precision, and the best k of all trees are merged.

The arrays are Spark's range partitions by (tree, string):

1. the strings alone are sorted; a partition counts for each of its vectors and each prefix length how many vectors
   share it, up to ``WIDTH`` places to either side of the vector;
2. the counts of a vector's trees are added up, which shows where its ascent stops;
3. the vectors go to the partitions found in 1, the first and last ``WIDTH`` of a partition to the one before or after it
   too, so that no neighbour is lost at a border, and are compared in blocks of the sorted array.

The planes of the trees follow the principal axes of a bounded sample (``SAMPLE`` vectors, by hash of the vector) and cut
at its medians; every vector is indexed. Neighbours are approximate: one is missed if no tree lets the two share a prefix
that is long enough. Equal vectors are one vector with the smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.shared import stage

K = 5
TREES, BITS = 16, 62
#: Candidates at which the ascent of a vector stops, summed over its trees.
REACH = 10_000
#: Places of a sorted array to either side of a vector that its ascent can see, and places of a partition.
WIDTH, PLACES = 4096, 32_768
#: Vectors that the planes are fitted on.
SAMPLE = 4096
SEED = 20_031
#: Vectors of a sorted array that are compared with their ranges in one product.
BLOCK = 128
#: Prefix lengths at which the ascent may stop.
LEVELS = (*range(1, 33), *range(34, BITS + 1, 4))


def usable(embedding: Column) -> Column:
    """Not null, without null or infinite components, and not all zero."""
    return embedding.isNotNull() & (F.size(embedding) > 0) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(embedding, lambda x: x != 0)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def planes(tree: int, dim: int, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, tree]).standard_normal((dim, bits))


def distinct_vectors(rows: DataFrame, id_: str, embedding: str, k: int = K) -> tuple[DataFrame, DataFrame]:
    """Members ``(id, vec)`` and vectors ``(vec, embedding, ids)`` of the usable rows, ids being the smallest k + 1 ids
    of the equal vectors. Vectors that are shorter or longer than most have no place in the space and take no part."""
    use = rows.where(F.col(id_).isNotNull() & usable(F.col(embedding))).select(F.col(id_).alias("id"), F.col(embedding).cast("array<float>").alias("embedding"))
    lengths = use.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    use = use.where(F.size("embedding") == (lengths["n"] if lengths else 0))
    members = stage(use.withColumn("vec", F.xxhash64("embedding")).distinct(), "vectors")
    low = members.withColumn("r", F.row_number().over(W.partitionBy("vec").orderBy("id"))).where(F.col("r") <= k + 1)
    vectors = low.groupBy("vec").agg(F.min("embedding").alias("embedding"), F.sort_array(F.collect_list("id")).alias("ids"))
    return members.select("id", "vec"), stage(vectors, "distinct-vectors")


def _fitted(vectors: DataFrame, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Planes (dim, trees * BITS) and where they cut, from a sample of at most SAMPLE vectors."""
    some = vectors.orderBy(F.xxhash64("vec", F.lit(SEED)), "vec").select("embedding").limit(SAMPLE).toPandas()
    x = _unit(some["embedding"])
    _, spread, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    axes = axes.T * np.sqrt(spread + 1e-9 * (spread.max() + 1))
    w = np.concatenate([axes @ np.random.default_rng([SEED, t]).standard_normal((axes.shape[1], BITS)) for t in range(trees)], axis=1)
    return w, np.median(x @ w, axis=0)


def _coded(w: np.ndarray, cut: np.ndarray, trees: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for frame in frames:
            bits = (_unit(frame["embedding"]) @ w > cut).reshape(len(frame), trees, BITS)
            vector = [np.asarray(v, dtype=np.float32).tobytes() for v in frame["embedding"]]
            yield pd.DataFrame({"vec": frame["vec"], "first": frame["first"], "vector": vector, "codes": list(bits @ powers)})

    return run


def _runs(tree: np.ndarray, code: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a sorted array where the run of strings with its prefix starts and ends."""
    prefix = code >> np.int64(BITS - level)
    new = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (tree[1:] != tree[:-1])])
    size = np.diff(np.r_[new, len(code)])
    return np.repeat(new, size), np.repeat(new + size, size)


def _counted(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of the strings of one partition, sorted: how many share each prefix, and the partitions to be compared in."""
        rows = list(frames)
        if not rows:
            return
        rows = pd.concat(rows, ignore_index=True)
        tree, code = rows["tree"].to_numpy(), rows["code"].to_numpy()
        at = np.arange(len(rows))
        counts = np.empty((len(rows), len(LEVELS)), dtype=np.uint16)
        for j, level in enumerate(LEVELS):
            start, end = _runs(tree, code, level)
            counts[:, j] = np.minimum(end, at + width + 1) - np.maximum(start, at - width) - 1
        edge = (at < width) + 2 * (at >= len(rows) - width)
        yield pd.DataFrame({"vec": rows["vec"], "tree": tree, "code": code, "place": TaskContext.get().partitionId() * 4 + edge, "counts": [c.tobytes() for c in counts]})

    return run


def _stops(reach: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of all trees of a vector -> one row with the prefix length at which its ascent stops."""
        rows = list(frames)
        if not rows:
            return
        rows = pd.concat(rows, ignore_index=True).sort_values(["vec", "tree"], kind="stable", ignore_index=True)
        first = np.flatnonzero(np.r_[True, np.diff(rows["vec"].to_numpy()) != 0])
        counts = np.frombuffer(b"".join(rows["counts"]), dtype=np.uint16).reshape(len(rows), -1)
        total = np.add.reduceat(counts.astype(np.int64), first, axis=0)
        stop = np.array([0, *LEVELS])[(total >= reach).sum(axis=1)]  # counts fall with the length
        border = first[1:]
        yield pd.DataFrame({"vec": rows["vec"].to_numpy()[first], "stop": stop, "codes": np.split(rows["code"].to_numpy(), border), "places": np.split(rows["place"].to_numpy(), border)})

    return run


def _compared(k: int, width: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        """One part of the sorted arrays with its edges: the best k of each own vector, compared in blocks."""
        part = part.sort_values(["tree", "code", "vec"], kind="stable", ignore_index=True)
        tree, code, stop, own = (part[c].to_numpy() for c in ("tree", "code", "stop", "own"))
        x = np.frombuffer(b"".join(part["vector"]), dtype=np.float32).reshape(len(part), -1).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        at = np.arange(len(part))
        low, high = np.zeros(len(part), dtype=np.int64), np.zeros(len(part), dtype=np.int64)
        for level in np.unique(stop):
            start, end = _runs(tree, code, int(level))
            low[stop == level], high[stop == level] = start[stop == level], end[stop == level]
        low, high = np.maximum(low, at - width), np.minimum(high, at + width + 1)
        rough, out = x.astype(np.float32), []
        for begin in range(0, len(part), BLOCK):
            block = np.arange(begin, min(begin + BLOCK, len(part)))
            for t in np.unique(tree[block]):
                q = block[own[block] & (tree[block] == t)]
                if len(q):
                    out.append(_best(q, int(low[q].min()), int(high[q].max()), rough, x, part["first"].to_numpy(), k))
        q, y, score = (np.concatenate(c) for c in zip(*out)) if out else (at[:0], at[:0], x[:0, 0])
        vec, first = part["vec"].to_numpy(), part["first"].to_numpy()
        return pd.DataFrame({"vec": vec[q], "other": vec[y], "other_first": first[y], "score": score})

    return run


def _best(q: np.ndarray, a: int, b: int, rough: np.ndarray, x: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each q among a to b: what single precision can't tell from the k-th best is compared in double."""
    s = rough[q] @ rough[a:b].T
    s[np.arange(len(q)), q - a] = -3
    least = np.partition(s, s.shape[1] - k, axis=1)[:, -k] - 1e-5 if s.shape[1] > k else np.full(len(q), -2.0)
    r, c = np.nonzero(s >= np.maximum(least, -2)[:, None])
    c += a
    exact = np.concatenate([np.einsum("ij,ij->i", x[q[r[i : i + 65_536]]], x[c[i : i + 65_536]]) for i in range(0, len(r), 65_536)] or [np.zeros(0)]).round(9)
    order = np.lexsort((first[c], -exact, r))
    r, c, exact = r[order], c[order], exact[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return q[r[keep]], c[keep], exact[keep]


def vector_neighbours(vectors: DataFrame, k: int = K, reach: int = REACH, trees: int = TREES) -> DataFrame:
    """``(vec, first, embedding)`` -> ``(vec, other, other_first, score)``: the k most similar others that each tree finds
    for each vector."""
    n = vectors.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "vec long, other long, other_first long, score double")
    w, cut = _fitted(vectors, trees)
    coded = stage(vectors.select("vec", "first", "embedding").mapInPandas(_coded(w, cut, trees), "vec long, first long, vector binary, codes array<bigint>"), "coded-vectors")
    parts = -(-n * trees // PLACES)
    order = ["tree", "code", "vec"]
    strings = coded.select("vec", F.posexplode("codes").alias("tree", "code")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    counted = strings.mapInPandas(_counted(WIDTH), "vec long, tree int, code long, place int, counts binary")
    stops = counted.repartition(parts, "vec").mapInPandas(_stops(reach), "vec long, stop int, codes array<bigint>, places array<int>")
    each = coded.drop("codes").join(stops, "vec").select("vec", "first", "vector", "stop", F.posexplode(F.arrays_zip("codes", "places")).alias("tree", "z"))
    part, edge = F.shiftright("z.places", 2), F.col("z.places").bitwiseAND(3)
    to = F.array(F.struct(part.alias("part"), F.lit(True).alias("own")), F.when(edge.bitwiseAND(1) > 0, F.struct((part - 1).alias("part"), F.lit(False).alias("own"))), F.when(edge.bitwiseAND(2) > 0, F.struct((part + 1).alias("part"), F.lit(False).alias("own"))))
    sent = each.select("vec", "first", "vector", "stop", "tree", F.col("z.codes").alias("code"), F.inline(F.filter(to, lambda p: p.isNotNull()))).where(F.col("part").between(0, parts - 1))
    return sent.repartition(2 * parts, "part").groupBy("part").applyInPandas(_compared(k, WIDTH), "vec long, other long, other_first long, score double")


def nearest(rows: DataFrame, id_: str = "hit_id", embedding: str = "embedding", k: int = K, reach: int = REACH) -> DataFrame:
    """``(id, other_id, score, rank)``: the k most similar other rows of every row with a usable vector, by cosine in
    double precision rounded to 9 digits, ties to the smaller id.

    Null, empty, all-zero and not finite vectors take no part; a row that comes twice with the same id and vector counts
    once. With fewer than k + 1 usable rows each row gets all others.
    """
    members, vectors = distinct_vectors(rows, id_, embedding, k)
    pairs = vector_neighbours(vectors.select("vec", F.element_at("ids", 1).alias("first"), "embedding"), k, reach)
    # one shuffle by vec serves both the removal of repeats and the ranking
    once = pairs.repartition("vec").dropDuplicates(["vec", "other"])
    best = once.withColumn("r", F.row_number().over(W.partitionBy("vec").orderBy(F.desc("score"), "other_first"))).where(F.col("r") <= k)
    ranked = best.select("vec", "other", "score").join(vectors.select(F.col("vec").alias("other"), "ids"), "other")
    near = ranked.groupBy("vec").agg(F.collect_list(F.struct("score", "ids")).alias("near"))  # at most k entries
    flat = F.flatten(F.transform("near", lambda n: F.transform(n["ids"], lambda i: F.struct((-n["score"]).alias("minus"), i.alias("id")))))
    own = F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("minus"), i.alias("id")))
    lists = vectors.select("vec", "ids").join(near, "vec", "left").select("vec", F.slice(F.sort_array(F.concat(own, F.coalesce(flat, F.array().cast("array<struct<minus:double,id:bigint>>")))), 1, 2 * k + 2).alias("list"))
    # a vector's own copies come first: its list holds the best k for each of its members, itself left out
    of_row = members.join(lists, "vec").select("id", F.posexplode(F.slice(F.filter("list", lambda e: e["id"] != F.col("id")), 1, k)).alias("pos", "e"))
    return of_row.select("id", F.col("e.id").alias("other_id"), (-F.col("e.minus")).alias("score"), (F.col("pos") + 1).alias("rank"))


def similar_pairs(rows: DataFrame, least: float = 0.85, k: int = K) -> DataFrame:
    """``(hit_a, hit_b)``, a < b: pairs of which one is among the other's k most similar, with cosine of at least 0.85."""
    near = nearest(rows, k=k).where(F.col("score") >= least)
    return near.select(F.least("id", "other_id").alias("hit_a"), F.greatest("id", "other_id").alias("hit_b")).distinct()
