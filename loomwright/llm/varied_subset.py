"""Choosing a varied subset: inverse-density sampling with densities from locality-sensitive hash counts.

Every record falls into one bucket of each of several random hash tables, a bucket being the record's section together
with the sides of some random hyperplanes. The mean count of a record's buckets estimates how many records are like it;
its weight is one over that. A record's sampling key is -ln(u) / weight with u from a hash of its id, and the records with the
smallest keys are a weighted sample of fixed size without replacement (Efraimidis and Spirakis, 2006).

Bucket counts are summed before the shuffle, so a group with a third of all rows is a single count. The sample is cut without
a sort: keys are counted in a histogram of their leading bits, and only the bucket that holds the cut is looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.shared import stage
from .neighbours import _unit, planes, usable

SHARE = 0.02
TABLES = 12
TABLE_BITS = 10
SEED = 5_077


def _buckets(tables: int, bits: int, seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        for frame in frames:
            out: list = [[-1] * tables] * len(frame)
            for n, rows in frame.assign(n=frame["embedding"].map(lambda v: 0 if v is None else len(v)), i=range(len(frame))).groupby("n"):
                if n:
                    x = _unit(rows["embedding"])
                    codes = np.stack([((x @ planes(t, n, bits, seed)) > 0) @ weights for t in range(tables)], axis=1)
                    for i, code in zip(rows["i"], codes):
                        out[i] = code.tolist()
            yield frame[["id", "section"]].assign(codes=out)

    return run


def densities(rows: DataFrame, id_: str = "hit_id", embedding: str = "embedding", section: str = "section", tables: int = TABLES, bits: int = TABLE_BITS, seed: int = SEED) -> DataFrame:
    """``(id, section, density)``: the mean number of records in the hash buckets of each record, itself included.

    Sections are compared without case, spacing and punctuation, null and blank being one section. Records without a
    usable vector share one bucket per section. A repeated id counts once; null ids have no row.
    """
    name = F.regexp_replace(F.lower(F.coalesce(section, F.lit(""))), r"[^\p{L}\p{Nd}]+", "")
    vector = F.when(usable(F.col(embedding)), F.col(embedding).cast("array<float>"))
    once = rows.where(F.col(id_).isNotNull()).select(F.col(id_).alias("id"), name.alias("section"), vector.alias("embedding")).dropDuplicates(["id"])
    coded = stage(once.mapInPandas(_buckets(tables, bits, seed), f"id {dict(rows.dtypes)[id_]}, section string, codes array<bigint>"), "lsh-codes")
    each = coded.select("id", "section", F.posexplode("codes").alias("t", "code"))
    counts = each.groupBy("section", "t", "code").agg(F.count(F.lit(1)).alias("n"))
    # the mean of a record's counts, gathered by the record's own list of codes: buckets are few next to records
    return each.join(counts, ["section", "t", "code"]).groupBy("id", "section").agg(F.avg("n").alias("density"))


def smallest(keyed: DataFrame, n: int, key: str = "key", bits: int = 10, levels: int = 4) -> DataFrame:
    """The n rows with the smallest ``key`` (a double, not null), ties to the smaller ``id``.

    The cut is found level by level: a histogram of 2^bits equal steps between the least and the greatest key shows in
    which step it lies, and the next level looks inside that step only. Rows in the last step, as few as the
    data allow, are ranked exactly.
    """
    span = keyed.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if n <= 0 or span["n"] == 0:
        return keyed.limit(0)
    if n >= span["n"]:
        return keyed
    lo, hi, taken = span["lo"], span["hi"], 0
    for _ in range(levels):
        step = (hi - lo) / (1 << bits)
        if not step > 0:
            break
        place = F.least(F.floor((F.col(key) - lo) / step), F.lit((1 << bits) - 1))
        counts = dict(keyed.where(F.col(key).between(lo, hi)).groupBy(place.alias("p")).count().collect())  # 2^bits numbers
        for p in sorted(counts):
            if taken + counts[p] >= n:
                break
            taken += counts[p]
        inside = keyed.where(F.col(key).between(lo, hi) & (place == p)).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
        lo, hi = inside["lo"], inside["hi"]
    edge = keyed.where(F.col(key).between(lo, hi)).withColumn("r", F.row_number().over(W.orderBy(key, "id"))).where(F.col("r") <= n - taken).drop("r")
    return keyed.where(F.col(key) < lo).unionByName(edge)


def varied_subset(rows: DataFrame, share: float = SHARE, id_: str = "hit_id", **columns) -> DataFrame:
    """``(id, section, density, weight)``: round(share * records) records, drawn with probability inverse to density."""
    dense = stage(densities(rows, id_, **columns), "densities")
    n = round(share * dense.count())
    u = (F.shiftrightunsigned(F.xxhash64("id", F.lit(SEED)), 11).cast("double") + 1) / float(1 << 53)
    keyed = dense.withColumn("weight", 1 / F.col("density")).withColumn("key", -F.log(u) * F.col("density"))
    return smallest(keyed, n).drop("key")
