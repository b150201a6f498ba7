"""Queries of the library's own operators over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intent as I
from ..functions import pii as P
from ..functions import text as X
from ..operators import answers as A
from ..operators import blocks as B
from ..operators import chunking as C
from ..operators import evaluation as E
from ..operators import registry as R
from ..operators import store as S
from ..operators import vectors as V
from ..sources.html import html_blocks, html_text
from ..sources.shared import shared_dir, stage, table
from ..streaming import guard as G
from . import pipeline

HOSTS = ("www.larkstonefund.example", "files.larkstonefund.example", "board.fundregister.example", "plainfolio.example", "www.sip-atlas.example", "www.unitdesk-assoc.example", "fundlantern.example")
TAU = 0.6


def _golden(spark, d):
    return E.once(table(spark, d, "golden_qa"))


def _hit_ranks(spark, d):
    hits = table(spark, d, "hits").where("qid IS NOT NULL")
    rank = F.row_number().over(V.W.partitionBy("qid").orderBy(F.desc_nulls_last("score"), "hit_id"))
    return hits.withColumn("rank", rank)


# sources and registry


def registry_typed(spark, d):
    return R.typed(table(spark, d, "source_registry")).select("source_id", "url", "host", "discover_only", "enabled")


def registry_violations(spark, d):
    reg = table(spark, d, "source_registry")
    schemes = reg.where("scheme LIKE '% Fund'").select("scheme").distinct()
    return R.violations(reg, list(HOSTS), schemes)


def citable_sources(spark, d):
    return R.citable(table(spark, d, "source_registry")).select("source_id", "url", "scheme_category", "doc_type")


def preferred_urls(spark, d):
    return R.preferred_urls(table(spark, d, "source_registry"))


def fetch_summary(spark, d):
    raw = table(spark, d, "raw_docs").select("raw_id", "status", "http_status", "extracted_text").distinct()
    return raw.groupBy("status").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("extracted_text").isNull()).alias("without_text"), F.max(F.length("extracted_text")).alias("longest"))


def page_blocks(spark, d):
    pages = table(spark, d, "raw_docs").where("raw_bytes IS NOT NULL").select("raw_id", "raw_bytes").dropDuplicates(["raw_id"])
    return pages.select("raw_id", F.inline(html_blocks("raw_bytes")))


def chrome_retention(spark, d):
    pages = table(spark, d, "raw_docs").where("raw_bytes IS NOT NULL").select("raw_id", "raw_bytes").dropDuplicates(["raw_id"])
    sizes = pages.select("raw_id", F.length(html_text("raw_bytes")).alias("before"), F.length(F.array_join(F.transform(html_blocks("raw_bytes"), lambda b: b["text"]), "\n")).alias("after"))
    return sizes.withColumn("kept", F.round(F.try_divide("after", "before"), 4)).withColumn("warning", F.col("after") < 0.5 * F.col("before"))


# text rules


def question_pii(spark, d):
    q = table(spark, d, "golden_qa").select("id", "query").distinct()
    return q.select("id", P.first_label(F.col("query")).alias("label"), P.masked(F.col("query")).alias("masked"))


def question_traces(spark, d):
    q = table(spark, d, "golden_qa").select("id", "query").distinct()
    return q.select("id", P.first_masked(F.col("query")).alias("trace"))


def question_spans(spark, d):
    q = table(spark, d, "golden_qa").select("id", "query").distinct()
    return q.select("id", P.first_span(F.col("query")).alias("s")).select("id", "s.label", "s.start", "s.end")


def corpus_pii(spark, d):
    docs = table(spark, d, "raw_docs").where("extracted_text IS NOT NULL").select("raw_id", "extracted_text").distinct()
    return docs.select("raw_id", P.all_labels("extracted_text").alias("labels"), F.length(P.merged_masked("extracted_text")).alias("length"))


def question_intents(spark, d):
    q = table(spark, d, "golden_qa").select("id", "query").distinct()
    return q.select("id", I.intent(F.col("query")).alias("intent"), F.size(I.matched(F.col("query"), I.RULES.advice + I.RULES.performance)).alias("n_rules"))


def question_categories(spark, d):
    q = table(spark, d, "golden_qa").select("id", "query").distinct()
    return q.select("id", I.category(F.col("query")).alias("category"))


def document_numbers(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(X.number_tokens(F.col("text"))).alias("token"))
    return docs.select("doc_id", X.normal_number(F.col("token")).alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


def facts_supported(spark, d):
    facts = _golden(spark, d).where("expected_facts IS NOT NULL").select(F.col("id").alias("qid"), F.explode("expected_facts").alias("fact"))
    hits = table(spark, d, "hits").where("qid IS NOT NULL").select("qid", "hit_id", "text")
    return facts.join(hits, "qid").select("qid", "hit_id", "fact", X.numbers_supported(F.col("fact"), F.col("text")).alias("supported"))


def short_documents(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text").distinct()
    return docs.select("doc_id", F.size(X.sentences(F.col("text"))).alias("sentences"), X.first_sentences(F.col("text")).alias("short"))


def documents_without_urls(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text").distinct()
    return docs.select("doc_id", X.without_urls(F.col("text")).alias("text"))


def performance_claims(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text").distinct()
    return docs.select("doc_id", I.performance_claim(F.col("text")).alias("claims"), X.has_figure(F.col("text")).alias("figure"))


def word_counts(spark, d):
    chunks = table(spark, d, "chunks").select("chunk_id", "text", "token_count").distinct()
    return chunks.select("chunk_id", X.word_count(F.col("text")).alias("words"), "token_count")


def prose_slices(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.words(F.col("text")).alias("w")).distinct().where("size(w) > 0")
    at = F.explode(F.sequence(F.lit(0), ((F.size("w") - 1) / C.SLICE).cast("int"))).alias("slice")
    return docs.select("doc_id", "w", at).select("doc_id", "slice", F.array_join(F.slice("w", F.col("slice") * C.SLICE + 1, F.lit(C.SLICE)), " ").alias("text"))


def collapsed_text(spark, d):
    return B.exploded(table(spark, d, "clean_docs")).select("doc_id", "pos", X.collapsed("text").alias("text"))


# blocks and chunks


def chunk_ids(spark, d):
    c = table(spark, d, "chunks").select("source_id", "chunk_index", "text").distinct()
    return c.select("source_id", "chunk_index", C.chunk_id(F.col("source_id"), F.col("chunk_index"), F.col("text")).alias("chunk_id"))


def line_offsets(spark, d):
    return B.line_offsets(B.exploded(table(spark, d, "clean_docs")))


def block_sections(spark, d):
    return B.sections(B.exploded(table(spark, d, "clean_docs"))).select("doc_id", "pos", "section")


def blocks_once(spark, d):
    return B.without_repeats(B.exploded(table(spark, d, "clean_docs"))).select("doc_id", "pos", "text")


def blocks_before_footer(spark, d):
    return B.before_footer(B.exploded(table(spark, d, "clean_docs"))).select("doc_id", "pos", "kind")


def label_value_facts(spark, d):
    lines = table(spark, d, "raw_docs").where("extracted_text IS NOT NULL").select(F.col("raw_id").alias("doc_id"), "extracted_text").distinct()
    rows = lines.select("doc_id", F.posexplode(F.split("extracted_text", "\n")).alias("pos", "text")).withColumn("kind", F.lit("paragraph")).withColumn("level", F.lit(0))
    return B.paired_facts(rows).where("kind = 'fact'").select("doc_id", "pos", "text")


def documents_chunked(spark, d):
    return C.chunked(table(spark, d, "clean_docs"))


def chunk_invariants(spark, d):
    docs = table(spark, d, "clean_docs")
    return C.invariants(docs, stage(C.chunked(docs), "chunks"), table(spark, d, "source_registry"))


def block_coverage(spark, d):
    docs = table(spark, d, "clean_docs")
    return C.block_coverage(docs, C.chunked(docs))


def pages_ingested(spark, d):
    return pipeline.ingest(table(spark, d, "raw_docs"))


def ingest_manifest(spark, d):
    raw = table(spark, d, "raw_docs")
    return pipeline.manifest(raw, stage(pipeline.ingest(raw), "ingested"))


def page_warnings(spark, d):
    return B.warnings(table(spark, d, "clean_docs"))


def foreign_urls(spark, d):
    return C.foreign_urls(table(spark, d, "chunks"), table(spark, d, "source_registry"))


def chunks_by_authority(spark, d):
    reg = R.citable(table(spark, d, "source_registry")).select("source_id", F.col("doc_type").alias("registered_type"))
    chunks = table(spark, d, "chunks").select("chunk_id", "source_id", "authority").distinct()
    return chunks.join(reg, "source_id").groupBy("authority", "registered_type").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("source_id").alias("sources"))


def sources_without_chunks(spark, d):
    reg = table(spark, d, "source_registry").where("source_id IS NOT NULL AND source_id <> ''").select("source_id").distinct()
    return reg.join(table(spark, d, "chunks"), "source_id", "left_anti")


def store_metadata(spark, d):
    return S.metadata(table(spark, d, "chunks")).distinct()


def store_upsert(spark, d):
    chunks = table(spark, d, "chunks").select("chunk_id", "source_id", "text", F.coalesce("token_count", F.lit(0)).alias("token_count"))
    old = chunks.where("token_count < 120").groupBy("chunk_id").agg(F.min(F.struct("source_id", "text", "token_count")).alias("r")).select("chunk_id", "r.*")
    return S.upserted(old, chunks.where("token_count >= 100"))


def chunk_dump(spark, d):
    return S.chunk_lines(table(spark, d, "chunks"))


def embedding_preview(spark, d):
    return S.vector_preview(table(spark, d, "hits").where("hit_id IS NOT NULL"), "hit_id", "embedding")


def norm_stats(spark, d):
    return S.vector_stats(table(spark, d, "hits"), "embedding")


def store_parity(spark, d):
    """The chunks on hand against those that the documents give now: these come from elsewhere, so they are stale."""
    return E.store_parity(table(spark, d, "chunks").where("chunk_id IS NOT NULL"), C.chunked(table(spark, d, "clean_docs")))


def duplicate_chunks(spark, d):
    c = table(spark, d, "chunks")
    return c.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("token_count").alias("counts"), F.max("loaded_at").alias("last")).where("n > 1")


# retrieval


def knn_topk(spark, d):
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("category"), F.col("embedding").alias("qvec"))
    rows = e.select(F.col("vec_id").alias("id"), F.col("label").alias("category"), F.col("embedding").alias("vec"))
    return V.knn(queries, rows)


def mmr_picks(spark, d):
    hits = table(spark, d, "hits").where("qid IS NOT NULL").select("qid", F.col("hit_id").alias("id"), "score", F.col("embedding").alias("vec"))
    return V.mmr(hits)


def filtered_hits(spark, d):
    """Citable hits of the category that their question names, ranked within the question."""
    q = _golden(spark, d).select(F.col("id").alias("qid"), I.category(F.col("query")).alias("category"))
    hits = table(spark, d, "hits").where("NOT discover_only").join(q, "qid").where("category IS NULL OR scheme_category = category")
    rank = F.row_number().over(V.W.partitionBy("qid").orderBy(F.desc_nulls_last("score"), "hit_id"))
    return hits.select("qid", "hit_id", "scheme_category", rank.alias("rank"))


def grounding_gate(spark, d):
    return E.grounding(table(spark, d, "hits"), TAU).withColumn("max_score", F.round("max_score", 6))


def hit_traces(spark, d):
    preview = F.replace(F.substring("text", 1, 160), F.lit("\n"), F.lit(" "))
    return _hit_ranks(spark, d).select("qid", "rank", "hit_id", F.round("score", 4).alias("score"), preview.alias("preview"))


def sources_consulted(spark, d):
    return pipeline.sources_consulted(table(spark, d, "hits"))


def vector_norms(spark, d):
    e = table(spark, d, "hits").select("hit_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))
    return e.select("hit_id", "norm", (F.abs(F.col("norm") - 1) > 1e-3).alias("off"))


def hashed_documents(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.min("text").alias("text"))
    return V.hashed_embedding(docs).withColumn("weight", F.round("weight", 6))


def rendered_contexts(spark, d):
    rows = _hit_ranks(spark, d).where("rank <= 5").withColumn("retrieved_at", F.regexp_extract("text", r"\(retrieved ([^)]*)\)\s*$", 1))
    listed = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "source_id", "section", "retrieved_at", "text"))).alias("hits"))
    return listed.select("qid", X.context(F.col("hits")).alias("context"))


# evaluation and answers


def score_stats(spark, d):
    joined = _golden(spark, d).select("id", "expected_kind").join(table(spark, d, "hits").withColumnRenamed("qid", "id"), "id")
    return joined.groupBy("expected_kind").agg(F.count("score").alias("n"), F.round(F.min("score"), 6).alias("low"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.max("score"), 6).alias("high"))


def tau_sweep(spark, d):
    return E.tau_sweep(table(spark, d, "golden_qa"), table(spark, d, "hits"))


def retrieval_rates(spark, d):
    return E.retrieval_rates(table(spark, d, "golden_qa"), _hit_ranks(spark, d), 5)


def visible_rates(spark, d):
    return E.visible_rates(table(spark, d, "golden_qa"), _hit_ranks(spark, d), 5, I.category)


def fact_ranks(spark, d):
    return E.fact_ranks(table(spark, d, "golden_qa"), _hit_ranks(spark, d))


def questions_retrieved(spark, d):
    found = pipeline.retrieved(table(spark, d, "golden_qa"), table(spark, d, "chunks"))
    return found.select("qid", "chunk_id", "source_id", "score")


def answers_retrieved(spark, d):
    """The whole answer flow: questions are embedded, meet the chunks, and the best of them pass the gates."""
    golden, chunks = table(spark, d, "golden_qa"), table(spark, d, "chunks")
    return pipeline.answer_batch(golden, stage(pipeline.retrieved(golden, chunks), "retrieved"), chunks, table(spark, d, "source_registry"))


def _checks(spark, d):
    return E.answer_checks(table(spark, d, "golden_qa"), answer_batch(spark, d), table(spark, d, "source_registry"))


def answer_checks(spark, d):
    return _checks(spark, d)


def answer_statuses(spark, d):
    return E.status_counts(_checks(spark, d))


def eval_report(spark, d):
    return E.report_lines(stage(_checks(spark, d), "checks"))


def answer_batch(spark, d):
    return pipeline.answer_batch(table(spark, d, "golden_qa"), table(spark, d, "hits"), table(spark, d, "chunks"), table(spark, d, "source_registry"))


def answer_rates(spark, d):
    """Statuses by expected kind, and the share of questions answered with an expected fact."""
    answers = answer_batch(spark, d).withColumnRenamed("qid", "id")
    held = F.exists("expected_facts", lambda f: F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lower(f)))
    joined = _golden(spark, d).select("id", "expected_kind", "expected_facts").join(answers, "id")
    return joined.groupBy("expected_kind", "status").agg(F.count(F.lit(1)).alias("n"), F.count_if(held).alias("with_fact"), F.count_if(X.has_figure(F.coalesce("text", F.lit("")))).alias("with_figure"))


def payload_checks(spark, d):
    """Model payloads, sound and broken in turn, through the validation."""
    hits = table(spark, d, "hits").where("hit_id IS NOT NULL").select("hit_id", "text", "source_id")
    broken = F.col("hit_id") % 4
    raw = (
        F.when(broken == 0, F.to_json(F.struct(F.substring("text", 1, 80).alias("answer"), "source_id", F.lit(False).alias("off_topic"))))
        .when(broken == 1, F.to_json(F.struct(F.lit("").alias("answer"), F.lit("true").alias("off_topic"))))
        .when(broken == 2, F.concat(F.lit("no JSON: "), "text"))
        .otherwise(F.to_json(F.struct(F.lit(True).alias("off_topic"))))
    )
    return hits.select("hit_id", A.parsed_payload(raw).alias("p")).select("hit_id", "p.off_topic", "p.error", F.length("p.answer").alias("n"))


# streams


def stream_guard(spark, d):
    source = table(spark, d, "golden_qa").select(F.col("id").alias("qid"), "query")
    given = stage(source, "questions")
    base = given.inputFiles()[0].rsplit("/", 1)[0]
    out = f"{shared_dir(spark)}/guarded-{base.rsplit('/', 1)[1]}"
    G.run_to_end(G.guarded(spark.readStream.schema(source.schema).parquet(base)), out, out + "-checkpoint")
    return spark.read.parquet(out).distinct()


def event_windows(spark, d):
    return G.windowed_counts(table(spark, d, "events"))


def events_streamed(spark, d):
    source = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    given = stage(source, "events")
    base = given.inputFiles()[0].rsplit("/", 1)[0]
    out = f"{shared_dir(spark)}/windows-{base.rsplit('/', 1)[1]}"
    G.windows_to_end(spark.readStream.schema(source.schema).parquet(base), out, out + "-checkpoint")
    return spark.read.parquet(out).withColumn("start", F.col("start").cast("timestamp_ntz"))


_NAMED = [
    registry_typed, registry_violations, citable_sources, preferred_urls, fetch_summary, page_blocks, chrome_retention,
    question_pii, question_spans, question_traces, corpus_pii, question_intents, question_categories, document_numbers, facts_supported, short_documents, documents_without_urls, performance_claims, word_counts, prose_slices, collapsed_text,
    chunk_ids, line_offsets, block_sections, blocks_once, blocks_before_footer, label_value_facts, documents_chunked, chunk_invariants, block_coverage, pages_ingested, ingest_manifest, page_warnings, foreign_urls, chunks_by_authority, sources_without_chunks, store_metadata, store_upsert, chunk_dump, embedding_preview, norm_stats, store_parity, duplicate_chunks,
    knn_topk, mmr_picks, filtered_hits, grounding_gate, hit_traces, sources_consulted, vector_norms, hashed_documents, rendered_contexts,
    score_stats, tau_sweep, retrieval_rates, visible_rates, fact_ranks, questions_retrieved, answers_retrieved, answer_checks, answer_statuses, eval_report, answer_batch, answer_rates, payload_checks, stream_guard, event_windows, events_streamed,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _NAMED}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
