"""The two dataflows: building a corpus of chunks from pages, and answering a table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.intent import category, intent
from ..functions.pii import merged_masked
from ..operators import blocks as B
from ..operators import registry as R
from ..operators.answers import extractive, finalised, parsed_payload
from ..operators.chunking import chunked
from ..operators.evaluation import once
from ..operators.chunking import BODY, HARD, OVERLAP
from ..operators.vectors import DIM, KEEP, POOL, TAU, dense_embedding, knn, mmr, promoted
from ..sources.html import html_blocks
from ..sources.shared import one_delivery


def ingest(raw_docs: DataFrame) -> DataFrame:
    """``raw_docs`` -> chunks: usable pages are parsed, stripped, scrubbed of identifiers and packed.

    A page delivered twice counts once; pages without bytes, of failed fetches, have no chunk."""
    usable = raw_docs.where("raw_id IS NOT NULL AND raw_bytes IS NOT NULL AND length(raw_bytes) > 0 AND status IN ('ok', 'cached')")
    once = one_delivery(usable.select(F.col("raw_id").alias("doc_id"), "raw_bytes", "source_id", "url", "retrieved_at"), "doc_id")
    pages = once.select("doc_id", "source_id", "url", "retrieved_at", html_blocks.asNondeterministic()("raw_bytes").alias("blocks"))  # so that no filter reads a page again
    # the corpus rules: the digits of figures are no identifiers
    rows = pages.select("doc_id", F.inline("blocks")).withColumn("text", merged_masked.asNondeterministic()("text"))
    clean = B.paired_facts(B.before_footer(B.without_repeats(rows)))
    packed = clean.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((F.col("pos") * 2 + F.col("part")).cast("int").alias("pos"), "kind", "text", "level"))).alias("blocks"))
    return chunked(packed.join(pages.select("doc_id", "source_id", "url", "retrieved_at"), "doc_id"), unique=True)


def manifest(raw_docs: DataFrame, chunks: DataFrame, schema_version: int = 1) -> DataFrame:
    """One row per source: pages by status, bytes, characters, chunks; the JSON of the row beside it."""
    seen = raw_docs.where("raw_id IS NOT NULL").groupBy("raw_id").agg(F.min(F.struct("source_id", "status", F.coalesce(F.length("raw_bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.length("extracted_text"), F.lit(0)).alias("chars"))).alias("r")).select("r.*")
    per_page = seen.groupBy(F.lower("source_id").alias("source_id")).agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("status").isin("ok", "cached")).alias("usable"), F.count_if(F.col("status").isin("failed", "blocked")).alias("failed"), F.sum("bytes").alias("bytes"), F.sum("chars").alias("chars")
    )
    made = chunks.groupBy(F.lower("source_id").alias("source_id")).agg(F.count(F.lit(1)).alias("chunks"))
    out = per_page.join(made, "source_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    settings = F.struct(F.struct(F.lit("hashed").alias("name"), F.lit(DIM).alias("dimensions")).alias("model"), F.struct(F.lit(BODY).alias("body"), F.lit(OVERLAP).alias("overlap"), F.lit(HARD).alias("most")).alias("chunking"), F.struct(F.lit(schema_version).alias("schema_version")).alias("collection"))
    return out.withColumn("json", F.to_json(F.struct(*out.columns, settings.alias("settings"))))


def retrieved(golden: DataFrame, chunks: DataFrame, k: int = POOL, tau: float = TAU) -> DataFrame:
    """Hits of the factual questions among the citable chunks, in the form of the table of hits: ``(qid, hit_id, score, embedding,
    chunk_id, text, source_id, section, scheme_category, discover_only)``.

    Question and chunk become hashed term vectors; a question that names a category meets the chunks of that category, any
    other one all chunks, in cells of bounded size. A chunk that was loaded twice counts once."""
    q = once(golden).select(F.col("id").alias("qid"), F.coalesce("query", F.lit("")).alias("query")).where(intent(F.col("query")) == "FACTUAL")
    q = q.select("qid", F.coalesce(category(F.col("query")), F.lit("*")).alias("category"), dense_embedding("query").alias("qvec")).where("qvec IS NOT NULL")
    fields = ["text", "source_id", "section", "scheme_category"]
    c = chunks.where("chunk_id IS NOT NULL AND text IS NOT NULL AND NOT coalesce(discover_only, false)")
    c = one_delivery(c.select("chunk_id", *fields), "chunk_id").withColumn("vec", dense_embedding("text"))
    rows = c.select(F.col("chunk_id").alias("id"), "vec", F.explode(F.array_distinct(F.array(F.coalesce("scheme_category", F.lit("")), F.lit("*")))).alias("category"))
    near = knn(q, rows, k).where("score > 0").withColumnRenamed("id", "chunk_id")
    hit = near.join(c, "chunk_id").withColumn("hit_id", F.xxhash64("qid", "chunk_id"))
    return hit.select("qid", "hit_id", "score", F.col("vec").alias("embedding"), "chunk_id", *fields, F.lit(False).alias("discover_only"))


def answer_batch(golden: DataFrame, hits: DataFrame, chunks: DataFrame, registry: DataFrame, tau: float = TAU) -> DataFrame:
    """Every question with its status, text and citation.

    Questions are guarded first, and only factual ones meet the hits. Their candidates are the citable hits of the category
    that the question names, if any; five are picked for relevance and variety, the best score is the grounding gate, and
    the extractive answer passes the checks of ``finalised``."""
    q = once(golden).select(F.col("id").alias("qid"), "query").withColumn("query", F.coalesce("query", F.lit("")))
    routed = q.withColumn("intent", intent(F.col("query"))).withColumn("category", category(F.col("query")))
    refused = routed.where("intent <> 'FACTUAL'").select("qid", F.concat(F.lit("REFUSED_"), "intent").alias("status"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("retrieved_at"), F.lit(0).alias("sources_consulted"))
    factual = routed.where("intent = 'FACTUAL'")
    usable = hits.where("hit_id IS NOT NULL AND NOT coalesce(discover_only, false)").select("qid", F.col("hit_id").alias("id"), "score", F.col("embedding").alias("vec"), "chunk_id", "text", "source_id", "section", F.col("scheme_category").alias("hit_category"))
    pool = factual.select("qid", "category").join(usable, "qid").where("category IS NULL OR hit_category = category").drop("category", "hit_category")
    picked = mmr(pool.select("qid", "id", "score", "vec"), KEEP).join(pool.select("qid", "id", "score"), ["qid", "id"])
    picked = promoted(picked, pool.select("qid", "id", "score"), tau).drop("score")
    dates = chunks.where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.min("retrieved_at").alias("retrieved_at"))
    rows = picked.join(pool, ["qid", "id"]).join(dates, "chunk_id", "left")
    listed = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pick", "id", "score", "source_id", "section", "text", "retrieved_at"))).alias("hits"))
    grounded = pool.groupBy("qid").agg((F.coalesce(F.max("score"), F.lit(0.0)) >= tau).alias("grounded"))
    ready = factual.select("qid", "query").join(listed, "qid", "left").join(grounded, "qid", "left")
    empty = F.array().cast(dict(listed.dtypes)["hits"])
    ready = ready.withColumn("hits", F.coalesce("hits", empty)).withColumn("grounded", F.coalesce("grounded", F.lit(False)))
    generated = extractive(ready).withColumn("p", parsed_payload(F.col("raw"))).select("qid", "hits", "grounded", "p.*")
    return refused.unionByName(finalised(generated, R.citable(registry)))


def sources_consulted(hits: DataFrame) -> DataFrame:
    """``(qid, source_id, rank)``: each source of a question once, at its best rank."""
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc_nulls_last("score"), "hit_id"))
    first = hits.where("qid IS NOT NULL AND source_id IS NOT NULL").withColumn("rank", rank)
    return first.groupBy("qid", "source_id").agg(F.min("rank").alias("rank"))
