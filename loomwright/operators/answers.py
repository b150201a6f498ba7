"""From retrieved hits to checked answers: an extractive generator, payload validation, and the gates after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.intent import performance_claim
from ..functions.pii import masked

# Common words that don't tell a sentence from another: fixed values.
STOP = ("the", "a", "an", "of", "in", "for", "to", "is", "are", "and", "or", "on", "at", "by", "my", "i", "do", "does", "what", "which", "how", "when", "there", "can", "after", "with", "fund")


def terms(text: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))), F.array(*[F.lit(w) for w in STOP]))


def extractive(questions: DataFrame) -> DataFrame:
    """``(qid, query, hits)`` -> the same with ``raw``, the JSON payload of the sentence that shares most terms with the
    question, ties to the earlier hit and sentence; off_topic where none shares any."""
    wanted = terms(F.col("query"))
    listed = F.flatten(F.transform("hits", lambda h, i: F.transform(X.sentences(F.regexp_replace(h["text"], r"(?m)^(?:#.*|Source: .*)$", "")), lambda s, k: F.struct((-F.size(F.array_intersect(terms(s), wanted))).alias("minus"), i.alias("hit"), k.alias("k"), s.alias("sentence"), h["source_id"].alias("source_id")))))
    best = F.array_min(listed)
    good = F.coalesce(F.col("best.minus") < 0, F.lit(False))
    payload = F.to_json(F.struct(F.when(good, F.col("best.sentence")).otherwise("").alias("answer"), F.when(good, F.col("best.source_id")).otherwise("").alias("source_id"), (~good).alias("off_topic")))
    return questions.withColumn("best", best).withColumn("raw", payload).drop("best")


def parsed_payload(raw: Column) -> Column:
    """struct(answer, source_id, off_topic, error); error is invalid_json or schema, null if the payload is sound.

    off_topic has to be a JSON boolean: the text "true" isn't one."""
    v = F.try_parse_json(raw)
    kind = F.schema_of_variant(F.try_variant_get(v, "$.off_topic", "variant"))
    answer, source = F.try_variant_get(v, "$.answer", "string"), F.try_variant_get(v, "$.source_id", "string")
    off = F.try_variant_get(v, "$.off_topic", "boolean")
    said = (F.trim(F.coalesce(answer, F.lit(""))) != "") & (F.trim(F.coalesce(source, F.lit(""))) != "")
    error = F.when(v.isNull(), "invalid_json").when(F.coalesce(kind != "BOOLEAN", F.lit(True)), "schema").when(~off & ~said, "schema")
    ok = error.isNull() & ~off
    return F.struct(F.when(ok, answer).otherwise("").alias("answer"), F.when(ok, source).otherwise("").alias("source_id"), F.coalesce(error.isNull() & off, F.lit(False)).alias("off_topic"), error.alias("error"))


def finalised(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """``answers(qid, query, hits, grounded, answer, source_id, off_topic, error)`` and citable ``sources(source_id, url,
    retrieved_at)`` -> ``(qid, status, text, url, retrieved_at, sources_consulted)``.

    The first gate that fails decides: generation, grounding, claims of performance, a source that may be cited, a hit of that
    source, and numbers that its hits hold. Then links and identifiers go and the registry's address is cited."""
    cited = answers.join(sources.select("source_id", "url", F.col("retrieved_at").alias("source_date")), "source_id", "left")
    own = F.filter("hits", lambda h: h["source_id"] == F.col("source_id"))
    evidence = F.array_join(F.transform(own, lambda h: F.coalesce(h["text"], F.lit(""))), "\n")
    short = X.first_sentences(F.col("answer"))
    staged = cited.withColumn("short", short).withColumn("own", own).withColumn("evidence", evidence)
    status = (
        F.when(F.col("error").isNotNull() | F.col("off_topic") | (F.coalesce("answer", F.lit("")) == ""), "NO_GROUNDING")
        .when((F.size("hits") <= 0) | ~F.coalesce("grounded", F.lit(False)), "NO_GROUNDING")
        .when(performance_claim(F.col("short")), "REFUSED_PERFORMANCE")
        .when(F.col("url").isNull() | (F.size("own") <= 0), "NO_GROUNDING")
        .when(~X.numbers_supported(F.col("short"), F.col("evidence")), "NO_GROUNDING")
        .otherwise("ANSWERED")
    )
    done = staged.withColumn("status", status)
    answered = F.col("status") == "ANSWERED"
    date = F.coalesce(F.when(F.col("source_date") != "", F.col("source_date")), F.element_at(F.transform("own", lambda h: h["retrieved_at"]), 1), F.lit("unknown"))
    return done.select("qid", "status", F.when(answered, masked(X.without_urls(F.col("short")))).alias("text"), F.when(answered, F.col("url")).alias("url"), F.when(answered, date).alias("retrieved_at"), F.size(F.array_distinct(F.transform("hits", lambda h: h["source_id"]))).alias("sources_consulted"))
