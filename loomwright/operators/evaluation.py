"""Evaluation as aggregates over answers and hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as X

TAUS = tuple(round(0.30 + 0.05 * k, 2) for k in range(12))


def once(golden: DataFrame) -> DataFrame:
    """One row per question; of repeated rows the one with the smallest text."""
    rest = [c for c in golden.columns if c != "id"]
    return golden.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct(*rest)).alias("r")).select("id", "r.*")


def grounding(hits: DataFrame, tau: float) -> DataFrame:
    best = F.coalesce(F.max("score"), F.lit(0.0))
    return hits.where("qid IS NOT NULL").groupBy("qid").agg(best.alias("max_score"), F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("score").isNull()).alias("unscored")).withColumn("grounded", F.col("max_score") >= tau)


def tau_sweep(golden: DataFrame, hits: DataFrame, taus: tuple[float, ...] = TAUS) -> DataFrame:
    """Per threshold: answerable questions that stay, others that are held back, how many of either there are, and the ids
    of the answerable ones that are lost, in order."""
    best = hits.groupBy(F.col("qid").alias("id")).agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("best"))
    scored = once(golden).join(best, "id").select("id", (F.col("expected_kind") == "ANSWERED").alias("inside"), "best")
    each = scored.select("id", "inside", "best", F.explode(F.array(*[F.lit(t) for t in taus])).alias("tau"))
    return each.groupBy("tau").agg(
        F.round(F.try_divide(F.count_if(F.col("inside") & (F.col("best") >= F.col("tau"))), F.count_if("inside")), 4).alias("recall"),
        F.round(F.try_divide(F.count_if(~F.col("inside") & (F.col("best") < F.col("tau"))), F.count_if(~F.col("inside"))), 4).alias("gated"),
        F.count_if("inside").alias("n_inside"), F.count_if(~F.col("inside")).alias("n_outside"),
        F.array_sort(F.collect_list(F.when(F.col("inside") & (F.col("best") < F.col("tau")), F.col("id")))).alias("lost"),
    )


def retrieval_rates(golden: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """``ranked(qid, source_id, scheme_category, rank)`` -> share of questions whose source is in the first k, and of those
    whose first k are all of one category; null where there is nothing to count."""
    top = ranked.where(F.col("rank") <= k)
    asked = once(golden).where("expected_source_id IS NOT NULL").select("id", "expected_source_id")
    seen = asked.join(top, F.col("id") == F.col("qid"), "left").groupBy("id").agg(F.max(F.coalesce(F.col("source_id") == F.col("expected_source_id"), F.lit(False))).alias("found"), F.countDistinct("scheme_category").alias("categories"), F.count("qid").alias("n"))
    return seen.agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(F.col("found").cast("int")), 4).alias("recall_at_k"), F.round(F.try_divide(F.count_if((F.col("categories") == 1) & (F.col("n") > 0)), F.count_if(F.col("n") > 0)), 4).alias("isolation"))


def fact_ranks(golden: DataFrame, ranked: DataFrame) -> DataFrame:
    """``(id, fact, rank)``: the best rank at which a hit of the question holds the fact, null if none does."""
    asked = once(golden).select("id", F.explode("expected_facts").alias("fact")).where("fact IS NOT NULL").distinct()
    held = F.when(F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lower("fact")), F.col("rank"))
    return asked.join(ranked.select("qid", "rank", "text"), F.col("id") == F.col("qid"), "left").groupBy("id", "fact").agg(F.min(held).alias("rank"))


def visible_rates(golden: DataFrame, ranked: DataFrame, k: int, category) -> DataFrame:
    """Shares of answerable questions whose expected source is in the first k hits with an expected fact in its text, and
    of questions that name a category all of whose first k hits are of that category; and of all others, how many have no
    hit of ``tau`` or more."""
    q = once(golden).select("id", "expected_source_id", F.coalesce("expected_facts", F.array().cast("array<string>")).alias("facts"), category(F.col("query")).alias("category"))
    top = ranked.where(F.col("rank") <= k).select("qid", "source_id", "scheme_category", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    seen = q.join(top, F.col("id") == F.col("qid"))
    shown = (F.col("source_id") == F.col("expected_source_id")) & F.exists("facts", lambda f: F.contains(F.col("low"), F.lower(f)))
    each = seen.groupBy("id").agg(F.max(F.coalesce(shown, F.lit(False))).alias("shown"), F.first("expected_source_id").isNotNull().alias("expects"), F.first("category").alias("category"), F.array_sort(F.collect_set("scheme_category")).alias("of"))
    alone = F.col("of") == F.array("category")
    return each.agg(F.count_if("expects").alias("expecting"), F.count_if(F.col("expects") & F.col("shown")).alias("shown"), F.count_if(F.col("category").isNotNull()).alias("naming"), F.count_if(F.col("category").isNotNull() & alone).alias("isolated"))


def answer_checks(golden: DataFrame, answers: DataFrame, registry: DataFrame) -> DataFrame:
    """``answers(qid, status, text, url)`` against what the questions expect, one row a question.

    ``passed`` is: the expected status; for answers the expected text and no forbidden one, exactly one link in all, which is
    an official address of the registry; for refusals no figure and no link to a source."""
    text = F.coalesce("text", F.lit(""))
    official = registry.where("authority = 'official' AND url <> ''").select("url", F.lit(True).alias("is_official")).distinct()
    own = registry.where("url <> ''").groupBy("url").agg(F.collect_set("source_id").alias("of"))
    q = once(golden).select("id", "expected_kind", F.coalesce("expected_facts", F.array().cast("array<string>")).alias("facts"), F.coalesce("forbidden_terms", F.array().cast("array<string>")).alias("barred"), "expected_source_id")
    j = q.join(answers.withColumnRenamed("qid", "id"), "id").join(official, "url", "left").join(own, "url", "left")
    said = X.normal_answer(text)
    answered = F.col("status") == "ANSWERED"
    links = F.size(F.regexp_extract_all(text, F.lit(X.ADDRESS), F.lit(0))) + (F.coalesce("url", F.lit("")) != "").cast("int")
    out = j.select(
        "id", "expected_kind", "status", (F.col("expected_kind") == F.col("status")).alias("kind_ok"), F.forall("facts", lambda f: F.contains(said, X.normal_answer(f))).alias("all_facts"), X.answer_fits(text, F.col("facts"), F.col("barred")).alias("fits"),
        F.exists("barred", lambda f: F.contains(F.lower(text), F.lower(f))).alias("forbidden"), (~answered & X.has_figure(text)).alias("figure_in_refusal"), links.alias("links"),
        F.coalesce("is_official", F.lit(False)).alias("official"), F.coalesce(answered & F.col("expected_source_id").isNotNull() & ~F.array_contains("of", F.col("expected_source_id")), F.lit(False)).alias("foreign_url"),
    )
    good = F.when(answered, F.col("fits") & (F.col("links") == 1) & F.col("official")).otherwise(~F.col("figure_in_refusal") & (F.col("links") == 0))
    return out.withColumn("passed", F.col("kind_ok") & good)


def status_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("expected_kind", "status").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed"), F.count_if("forbidden").alias("forbidden"), F.count_if("foreign_url").alias("foreign"))


def report_lines(checks: DataFrame) -> DataFrame:
    """The evaluation as the numbered lines of a Markdown table, one row a pair of expected and actual status, so that the
    table doesn't grow with the questions."""
    counts = status_counts(checks).withColumn("n_line", F.row_number().over(W.orderBy("expected_kind", "status")) + 3)  # a handful of rows
    body = counts.select("n_line", F.format_string("| %s | %s | %d | %d | %d |", "expected_kind", "status", "n", "passed", "forbidden").alias("line"))
    total = checks.agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("p"))
    head = total.select(F.explode(F.array(F.struct(F.lit(1).alias("n_line"), F.format_string("Passed: %d of %d", "p", "n").alias("line")), F.struct(F.lit(2).alias("n_line"), F.lit("| expected | status | n | passed | forbidden |").alias("line")), F.struct(F.lit(3).alias("n_line"), F.lit("|---|---|---|---|---|").alias("line")))).alias("x")).select("x.*")
    return head.unionByName(body)


def store_parity(stored: DataFrame, produced: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row: how many keys are stored and produced, how many are missing from either side, and whether the store is STALE."""
    a, b = stored.select(key).distinct().withColumn("s", F.lit(True)), produced.select(key).distinct().withColumn("p", F.lit(True))
    both = a.join(b, key, "full_outer").agg(F.count("s").alias("stored"), F.count("p").alias("produced"), F.count_if(F.col("s").isNull()).alias("missing"), F.count_if(F.col("p").isNull()).alias("left_over"))
    return both.withColumn("state", F.when((F.col("missing") == 0) & (F.col("left_over") == 0), "CURRENT").otherwise("STALE"))
