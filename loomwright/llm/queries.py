"""Queries of the training-data operators over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import one_delivery, table
from . import contamination, mixing, near_duplicates, neighbours, page_body, personal_data, repeated_lines, spam_pages, splitting, varied_subset

#: Key of the surrogates in the queries; a deployment passes its own secret.
EXAMPLE_KEY = "example key, replace in use"


def _pii(spark: SparkSession, d: str) -> DataFrame:
    return personal_data.corpus_texts(table(spark, d, "raw_docs"), table(spark, d, "golden_qa"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select(F.col("chunk_id").alias("item"), "text")


def p1_found(spark, d):
    return repeated_lines.found_lines(table(spark, d, "clean_docs"))


def p1_lines(spark, d):
    _, stats = repeated_lines.repeated_lines(table(spark, d, "clean_docs"))
    return stats.select("source_id", F.hex("line").alias("line"), "line_docs", "cluster_docs", "pages")


def p1_cleaned(spark, d):
    return repeated_lines.cleaned_pages(table(spark, d, "clean_docs"))


def p2_found(spark, d):
    # a chunk that was loaded with several texts has pieces of each
    items = _chunks(spark, d).where("item IS NOT NULL").select(F.concat_ws("\u0001", "item", F.xxhash64("text").cast("string")).alias("item"), "text")
    pieces = splitting.piece_offsets(splitting.text_ranges(one_delivery(items, "item"))).withColumn("item", F.element_at(F.split("item", "\u0001"), 1))
    return pieces.where("n_pieces > 1").select(F.col("item").alias("chunk_id")).distinct()


def p2_pieces(spark, d):
    return splitting.split_items(_chunks(spark, d)).withColumnRenamed("item", "chunk_id")


def p3_found(spark, d):
    return personal_data.replacements(_pii(spark, d), table(spark, d, "source_registry"), EXAMPLE_KEY).select("tab", "row_key", "label", "start_pos").distinct()


def p3_pseudonymised(spark, d):
    return personal_data.pseudonymised(_pii(spark, d), table(spark, d, "source_registry"), EXAMPLE_KEY)


def p4_found(spark, d):
    return neighbours.similar_pairs(table(spark, d, "hits"))


def p4_neighbours(spark, d):
    return neighbours.nearest(table(spark, d, "hits"))


def p5_subset(spark, d):
    return varied_subset.varied_subset(table(spark, d, "hits"))


def p6_found(spark, d):
    return near_duplicates.near_duplicate_keys(near_duplicates.corpus_records(table(spark, d, "chunks"), table(spark, d, "clean_docs")))


def p6_groups(spark, d):
    return near_duplicates.near_duplicate_groups(near_duplicates.corpus_records(table(spark, d, "chunks"), table(spark, d, "clean_docs")))


def p7_found(spark, d):
    return page_body.furniture_lines(table(spark, d, "raw_docs"), table(spark, d, "clean_docs"))


def p7_body(spark, d):
    return page_body.main_body(table(spark, d, "raw_docs"), table(spark, d, "clean_docs"))


def p8_found(spark, d):
    found = contamination.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.where(F.col("longest_run") >= contamination.MIN_WORDS).select("doc_id", "item_id").distinct()


def p8_leaks(spark, d):
    return contamination.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark, d):
    return mixing.unreachable(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark, d):
    return mixing.mix_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_documents(spark, d):
    return mixing.mixed_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark, d):
    return spam_pages.spam_documents(table(spark, d, "documents"))


def p10_evidence(spark, d):
    return spam_pages.spam_evidence(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [p1_found, p1_lines, p1_cleaned, p2_found, p2_pieces, p3_found, p3_pseudonymised, p4_found, p4_neighbours, p5_subset, p6_found, p6_groups, p7_found, p7_body, p8_found, p8_leaks, p9_found, p9_shares, p9_documents, p10_found, p10_evidence]
    return {f.__name__: f for f in named}


_TOKEN = r"[^\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_USABLE = """SELECT DISTINCT hit_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM hits
    WHERE hit_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0"""


def oracle_sql() -> dict[str, str]:
    near = f"""WITH u AS ({_USABLE}), n AS (SELECT hit_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM u),
        s AS (SELECT a.hit_id AS id, b.hit_id AS other_id, round(list_dot_product(a.v, b.v), 9) AS score FROM n a JOIN n b ON a.hit_id <> b.hit_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other_id) AS rank FROM s)"""
    return {
        "p2_found": f"SELECT DISTINCT chunk_id FROM chunks WHERE len(regexp_extract_all(text, '{_TOKEN}')) > 256",
        "p4_found": f"{near} SELECT DISTINCT least(id, other_id) AS hit_a, greatest(id, other_id) AS hit_b FROM r WHERE rank <= 5 AND score >= 0.85",
        "p9_found": f"""WITH d AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '{_TOKEN}')) AS n FROM documents),
            t AS (SELECT source, sum(n) AS t FROM d GROUP BY source), g AS (SELECT sum(n) AS g FROM d),
            m AS (SELECT mix_id, source, sum(weight) AS weight, max(max_repeats) AS max_repeats, max(size_factor) AS size_factor FROM mix_targets GROUP BY mix_id, source)
            SELECT m.mix_id, m.source FROM m LEFT JOIN t ON t.source = m.source, g WHERE weight * size_factor * g > max_repeats * coalesce(t, 0)""",
    }
