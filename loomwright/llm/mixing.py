"""Mixing sources to target weights, by hash-threshold histograms.

Every mix wants ``weight * size_factor * T`` tokens of each of its sources, T being the tokens of all documents. A
source with t tokens gives floor(wanted / t) whole copies, at most ``max_repeats``, and for the rest a part of its
documents. The part is the set of documents whose hash is below a threshold, so that the parts of all mixes are nested
and nothing is sorted: tokens are summed by source and hash bucket, a running sum over the buckets shows in which
bucket each budget runs out, and only the documents of those buckets are looked at again, one level finer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.shared import stage
from .words import WHITE

#: Buckets of a level of the histogram, as bits of the hash.
BUCKET_BITS = 10


def n_tokens(text: Column) -> Column:
    """Runs without Unicode white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WHITE}]+")), F.lit(0)).cast("long")


def sized_documents(documents: DataFrame) -> DataFrame:
    """``(doc_id, source, tokens, h)``, h being 40 bits of a hash of the id. Every row counts, repeated ids too."""
    h = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(9)), 24)
    return documents.select("doc_id", "source", n_tokens(F.col("text")).alias("tokens"), h.alias("h"))


def histogram(sized: DataFrame) -> DataFrame:
    """``(source, bucket, tokens, upto)``: tokens by the leading bits of the hash, and their running sum in the source. The
    last running sum is all that a source has, so plan and first level of the thresholds need one pass over the documents."""
    sums = sized.groupBy("source", F.shiftright("h", 40 - BUCKET_BITS).alias("bucket")).agg(F.sum("tokens").alias("tokens"))
    return stage(sums.withColumn("upto", F.sum("tokens").over(W.partitionBy("source").orderBy("bucket"))), "histogram")


def mix_plan(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """What each source of each mix has to give, from the histogram, one row per target:
    ``(mix_id, source, weight, max_repeats, wanted, available, copies, rest, reachable)``.

    A source that is named twice in one mix counts with the sum of its weights and the larger cap. Null weights, factors
    and caps count as 0; targets without a source or mix are dropped. Documents without a source count in the total only.
    """
    clean = targets.where("mix_id IS NOT NULL AND source IS NOT NULL").groupBy("mix_id", "source").agg(
        F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"), F.max(F.coalesce("size_factor", F.lit(0.0))).alias("size_factor")
    )
    per_source = counted.groupBy("source").agg(F.max("upto").alias("available"))
    total = per_source.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("total"))
    joined = clean.join(per_source, "source", "left").crossJoin(F.broadcast(total))  # one row
    wanted, have = F.col("weight") * F.col("size_factor") * F.col("total"), F.coalesce("available", F.lit(0))
    out = joined.select("mix_id", "source", "weight", "max_repeats", wanted.alias("wanted"), have.alias("available"))
    out = out.withColumn("reachable", F.col("wanted") <= F.col("max_repeats") * F.col("available"))
    copies = F.when(F.col("reachable"), F.floor(F.coalesce(F.try_divide("wanted", "available"), F.lit(0.0)))).otherwise(F.col("max_repeats")).cast("int")
    out = out.withColumn("copies", copies)
    return out.withColumn("rest", F.when(F.col("reachable"), F.col("wanted") - F.col("copies") * F.col("available")).otherwise(F.lit(0.0)))


def thresholds(sized: DataFrame, counted: DataFrame, plan: DataFrame) -> DataFrame:
    """``(mix_id, source, below)``: documents of the source with h < below make up the rest that the mix wants.

    The sum stays under the rest by less than one document (or by the documents that share one 40-bit hash).
    """
    levels = 40 // BUCKET_BITS
    open_ = plan.where("rest > 0").select("mix_id", "source", F.col("rest").alias("left"), F.lit(0).cast("long").alias("prefix"))
    for level in range(levels):
        bucket = F.shiftright("h", 40 - BUCKET_BITS * (level + 1))
        if level == 0:
            running = counted.where("source IS NOT NULL").select("source", F.lit(0).cast("long").alias("prefix"), "bucket", "upto")
        else:
            inside = sized.where("source IS NOT NULL").select("source", F.shiftright(bucket, BUCKET_BITS).alias("prefix"), bucket.alias("bucket"), "tokens")
            inside = inside.join(open_.select("source", "prefix").distinct(), ["source", "prefix"], "left_semi")
            sums = inside.groupBy("source", "prefix", "bucket").agg(F.sum("tokens").alias("tokens"))
            running = sums.withColumn("upto", F.sum("tokens").over(W.partitionBy("source", "prefix").orderBy("bucket")))
        held = open_.join(running, ["source", "prefix"])
        inside = held.groupBy("mix_id", "source", "prefix", "left").agg(
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto"))), F.lit(0)).alias("taken"),
            F.min(F.when(F.col("upto") > F.col("left"), F.col("bucket"))).alias("boundary"),
        )
        last = ((F.col("prefix") + 1) * (1 << BUCKET_BITS)) - 1
        open_ = inside.select("mix_id", "source", (F.col("left") - F.col("taken")).alias("left"), F.coalesce("boundary", last).alias("prefix"))
        open_ = stage(open_, "thresholds")
    return open_.select("mix_id", "source", F.col("prefix").alias("below"))


def mixed_documents(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``(mix_id, source, doc_id, copies)``: how often each document is used in each mix, if at all."""
    sized = stage(sized_documents(documents), "sized")
    counted = histogram(sized)
    plan = stage(mix_plan(counted, targets), "mix-plan")
    cut = thresholds(sized, counted, plan)
    rule = plan.select("mix_id", "source", "copies").join(cut, ["mix_id", "source"], "left")
    used = sized.join(rule, "source").withColumn("copies", F.col("copies") + F.when(F.col("h") < F.col("below"), 1).otherwise(0))
    return used.where("copies > 0").select("mix_id", "source", "doc_id", "copies", "tokens")


def mix_report(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Share wanted and reached by each source of each mix, in tokens."""
    sized = stage(sized_documents(documents), "sized")
    counted = histogram(sized)
    plan = stage(mix_plan(counted, targets), "mix-plan")
    cut = thresholds(sized, counted, plan)
    rule = plan.select("mix_id", "source", "copies").join(cut, ["mix_id", "source"], "left")
    used = sized.join(rule, "source").groupBy("mix_id", "source").agg(F.sum((F.col("copies") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)) * F.col("tokens")).alias("used"))
    out = plan.join(used, ["mix_id", "source"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
    share = F.try_divide(F.col("used").cast("double"), F.sum("used").over(W.partitionBy("mix_id")).cast("double"))
    return out.select("mix_id", "source", "weight", "max_repeats", "wanted", "available", "used", F.coalesce(share, F.lit(0.0)).alias("share"), "reachable")


def unreachable(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``(mix_id, source)`` of the targets that can't be reached within their cap of repeats: what they want is beyond the
    last running sum of their source's histogram, taken as often as the cap allows."""
    return mix_plan(histogram(sized_documents(documents)), targets).where("NOT reachable").select("mix_id", "source")
