"""Vector retrieval: products of blocks in Arrow batches, windows and array functions."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

POOL, KEEP, LAMBDA, TAU = 20, 5, 0.7, 0.35
DIM = 384
#: Rows of a cell, which is what a task compares with the queries of its category.
CELL = 50_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is null or has no length."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n > 0, dot(a, b) / n), F.lit(0.0))


def checked_unit(a: Column, tolerance: float = 1e-3) -> Column:
    """The vector itself if its length is 1, an error if it is not."""
    return F.when(F.abs(norm(a) - 1) <= tolerance, a).otherwise(F.raise_error(F.lit("a vector is not of unit length")).cast("array<float>"))


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    """Vectors scaled to length 1; null ones, and those of another length, are zero."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dim:
            out[i] = np.nan_to_num(np.asarray(v, dtype=np.float64))
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=out, where=length > 0)


def _cell_best(k: int, digits: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        dim = max((len(v) for v in queries["qvec"] if v is not None), default=1)
        y, ids, asked = _matrix(rows["vec"], dim), rows["id"].to_numpy(dtype=object), queries["qid"].to_numpy(dtype=object)
        place = np.empty(len(ids), dtype=np.int64)
        place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo in range(0, len(queries), 256):
            part = queries["qvec"].iloc[lo : lo + 256]
            s = (_matrix(part, dim) @ y.T).round(digits)
            least = np.partition(s, s.shape[1] - k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(part), -2.0)
            r, c = np.nonzero(s >= least[:, None])
            order = np.lexsort((place[c], -s[r, c], r))
            r, c = r[order], c[order]
            keep = np.arange(len(r)) - np.searchsorted(r, r) < k
            out.append((asked[lo + r[keep]], ids[c[keep]], s[r[keep], c[keep]]))
        qid, id_, score = (np.concatenate(x) for x in zip(*out)) if out else ([], [], [])
        return pd.DataFrame({"qid": pd.Series(qid, dtype=object), "id": pd.Series(id_, dtype=object), "score": score})

    return run


def knn(queries: DataFrame, rows: DataFrame, k: int = POOL, digits: int = 6) -> DataFrame:
    """``queries(qid, category, qvec)``, ``rows(id, category, vec)`` -> ``(qid, id, score, rank)``: the k most similar rows of
    the same category (a null category is one of its own), by cosine rounded to ``digits``.

    The rows of a category are dealt into cells of about ``CELL`` rows, however many there are, and its queries go to each
    of them; a cell compares blocks of both and hands on k rows a query. Ties go to the smaller id; null vectors score 0.
    """
    sizes = rows.groupBy("category").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells")).withColumnRenamed("category", "_c")
    same = F.col("category").eqNullSafe(F.col("_c"))
    left = queries.select("qid", "category", "qvec").join(sizes, same).select("qid", "category", "qvec", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    right = rows.select("id", "category", "vec").join(sizes, same).select("id", "category", "vec", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int").alias("cell"))
    kinds = dict(queries.dtypes)["qid"], dict(rows.dtypes)["id"]
    best = left.groupBy("category", "cell").cogroup(right.groupBy("category", "cell")).applyInPandas(_cell_best(k, digits), f"qid {kinds[0]}, id {kinds[1]}, score double")
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def _picked(k: int, weight: float, id_type: T.DataType):
    @F.pandas_udf(T.ArrayType(id_type))
    def run(pool: pd.Series) -> pd.Series:
        out = []
        for hits in pool:
            dim = max((len(h["vec"]) for h in hits if h["vec"] is not None), default=1)
            x = _matrix(pd.Series([h["vec"] for h in hits]), dim)
            alike = (x @ x.T).round(12)
            score = np.array([h["score"] for h in hits])
            taken = [0] if len(hits) else []
            while 0 < len(taken) < min(k, len(hits)):
                gain = weight * score - (1 - weight) * alike[:, taken].max(axis=1)
                gain[taken] = -np.inf
                taken.append(int(gain.argmax()))  # the first in pool order on ties
            out.append([hits[i]["id"] for i in taken])
        return pd.Series(out)

    return run


def mmr(hits: DataFrame, k: int = KEEP, weight: float = LAMBDA, pool: int = POOL) -> DataFrame:
    """``hits(qid, id, score, vec)`` -> ``(qid, id, pick)``: maximal marginal relevance, ``pick`` from 1.

    The pool of a question, its ``pool`` best hits, is one array of bounded size; the next pick has the largest
    weight * score - (1 - weight) * (its largest cosine with those picked), the first in pool order on ties. Null scores count
    as the lowest, hits without a vector resemble nothing.
    """
    ranked = hits.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc_nulls_last("score"), "id"))).where(F.col("r") <= pool)
    entry = F.struct("r", "id", F.coalesce("score", F.lit(-1.0)).alias("score"), "vec")
    pools = ranked.groupBy("qid").agg(F.array_sort(F.collect_list(entry)).alias("pool"))
    out = pools.select("qid", F.posexplode(_picked(k, weight, hits.schema["id"].dataType)("pool")).alias("pos", "id"))
    return out.select("qid", "id", (F.col("pos") + 1).alias("pick"))


def promoted(picked: DataFrame, pool: DataFrame, tau: float = TAU) -> DataFrame:
    """``picked(qid, id, score, pick)`` with the best hit of the pool in front, where the first pick scores below ``tau`` and
    the best of the pool doesn't; the grounding of a question, which is that of the pool, is the same."""
    best = pool.groupBy("qid").agg(F.min_by(F.struct("id", "score"), F.struct((-F.coalesce("score", F.lit(-1.0))).alias("minus"), "id")).alias("best"))
    first = picked.where("pick = 1").select("qid", F.col("score").alias("first"))
    weak = best.join(first, "qid").where((F.coalesce("first", F.lit(-1.0)) < tau) & (F.col("best.score") >= tau)).select("qid", "best")
    marked = picked.join(weak, "qid", "left")
    rest = marked.where("best IS NULL OR id <> best.id").select("qid", "id", "score", (F.col("pick") + F.col("best").isNotNull().cast("int")).alias("pick"))
    front = weak.select("qid", "best.id", "best.score", F.lit(1).alias("pick"))
    return front.unionByName(rest).withColumn("pick", F.row_number().over(W.partitionBy("qid").orderBy("pick")))


def hashed_embedding(texts: DataFrame, dim: int = DIM) -> DataFrame:
    """``texts(id, text)`` -> ``(id, bucket, weight)``: term counts in md5 buckets, scaled to length 1, in sparse form.

    Deterministic and the same in any engine with md5. Texts without a word have no row. Texts are shuffled by id, which
    serves counts and lengths alike; terms aren't shuffled."""
    term = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9]+"), F.lit(0)))
    buckets = texts.repartition("id").select("id", term.alias("t")).select("id", (F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("long") % dim).cast("int").alias("bucket"))
    counts = buckets.groupBy("id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy("id")))
    return counts.select("id", "bucket", (F.col("n") / length).alias("weight"))


_TERM = re.compile(r"[a-z0-9]+")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def dense_embedding(text: pd.Series) -> pd.Series:
    """The vectors of ``hashed_embedding`` in dense form; null for texts without a word."""
    of: dict[str, int] = {}
    out = []
    for x in text:
        at = []
        for t in _TERM.findall((x or "").lower()):
            if t not in of:
                of[t] = int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % DIM
            at.append(of[t])
        v = np.bincount(at, minlength=DIM).astype(np.float64) if at else None
        out.append(None if v is None else (v / np.linalg.norm(v)).astype(np.float32))
    return pd.Series(out)
