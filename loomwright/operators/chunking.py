"""Heading-aware chunks of bounded size with carried overlap, and the invariants a corpus of chunks must keep."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import one_delivery
from .blocks import METRIC, exploded

BODY, OVERLAP, HARD = 220, 40, 256
SLICE = max(40, BODY - OVERLAP)
ATOMIC = frozenset({"table_row", "fact"})
MIN_ALONE = 8

CHUNK = T.StructType([
    T.StructField("chunk_index", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("section", T.StringType()), T.StructField("faq_question", T.StringType()),
    T.StructField("block_kind", T.StringType()), T.StructField("token_count", T.IntegerType()), T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType()),
])

def chunk_id(source: Column, index: Column, text: Column) -> Column:
    """The first 32 hex digits of a hash of source, place and text: a repeated ingest gives the same ids."""
    return F.substring(F.sha2(F.concat_ws("|", source, index.cast("string"), text), 256), 1, 32)


def kind_of(kinds: set[str], faq: str) -> str:
    """The kind of a chunk by what it holds: a question, facts, rows, any heading, else prose."""
    return "faq" if faq else next((name for kind, name in (("fact", "fact"), ("table_row", "table"), ("heading", "section")) if kind in kinds), "prose")


class OversizedRow(ValueError):
    """A table row or fact has more words than a chunk may have."""


_LABELLED, _STOPPED, _SPACED = re.compile(METRIC), re.compile(r"[.!?।]\W*$"), re.compile(r"\S+")


def _records(blocks, room: int, strict: bool) -> list[dict]:
    """Lines ``(text, kind, words, at)`` of a document with what they open: 2 a section, 1 a group of its own, 0 nothing."""
    out, at = [], 0
    for b in blocks if blocks is not None else ():
        text, kind, level = b["text"] or "", b["kind"] or "paragraph", b["level"] or 0
        marks = "#" * max(1, level) + " " if kind == "heading" else ""
        spans = [m.span() for m in _SPACED.finditer(text)]
        if spans and kind == "heading":
            asks = text.rstrip().endswith("?") and len(spans) >= 3
            out.append({"text": marks + text, "kind": kind, "words": len(spans) + 1, "at": at, "opens": 1 if asks else 2 if level <= 2 else 0, "asks": text if asks else "", "section": text if level <= 2 and not asks else None})
        elif spans:
            most = room if kind in ATOMIC else SLICE
            if strict and kind in ATOMIC and len(spans) > room:
                raise OversizedRow(f"a {kind} of {len(spans)} words")
            opens = int(kind not in ATOMIC and len(spans) <= 12 and _LABELLED.search(text) is not None)
            for i in range(0, len(spans), most):
                part = spans[i : i + most]
                line = text if len(spans) <= most else text[part[0][0] : part[-1][1]]
                out.append({"text": line, "kind": kind, "words": len(part), "at": at + (0 if len(spans) <= most else part[0][0]), "opens": opens if i == 0 else 0, "asks": "", "section": None})
        at += len(marks) + len(text) + 1
    return out


def _spans(words: np.ndarray, is_head: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Where a group of lines is cut: spans of at most ``limit`` words, from prefix sums; each takes up the last lines of the
    one before, as far as they have OVERLAP words at most and no heading is among them."""
    total = np.concatenate(([0], np.cumsum(words)))
    heads = np.concatenate(([-1], np.maximum.accumulate(np.where(is_head, np.arange(len(words)), -1))))
    spans, begin, fresh = [], 0, 0
    while fresh < len(words):
        end = max(fresh + 1, int(np.searchsorted(total, total[begin] + limit, side="right")) - 1)
        if end == fresh + 1 and total[end] - total[begin] > limit:
            begin = fresh  # the shared lines leave no room
        spans.append((begin, end))
        fresh = end
        begin = max(int(np.searchsorted(total, total[end] - OVERLAP)), heads[end] + 1, spans[-1][0] + 1)
        begin = min(begin, fresh)
    return spans


def pack(blocks, footer: str, strict: bool = False) -> list[dict]:
    """Chunks of one document, given its blocks in order. Lines fall into groups at the records that open one; a group is
    cut by size; a thin group (few words, no sentence, row or fact) goes to the front of the next chunk, at the end of the
    document to the back of the last."""
    room = HARD - len(footer.split())
    records = _records(blocks, room, strict)
    if not records:
        return []
    group = np.cumsum([r["opens"] > 0 for r in records])
    borders = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    made: list[dict] = []
    held: list[dict] = []
    section = ""
    for a, b in zip(borders, [*borders[1:], len(records)]):
        lines = records[a:b]
        section = lines[0]["section"] if lines[0]["section"] is not None else section
        faq = lines[0]["asks"]
        body = [r for r in lines if r["kind"] != "heading"]
        thin = not any(r["kind"] in ATOMIC or _STOPPED.search(r["text"]) for r in body) and sum(r["words"] for r in body) < MIN_ALONE
        if thin and not (faq and body):
            held += lines
            continue
        for k, (x, y) in enumerate(_spans(np.array([r["words"] for r in lines]), np.array([r["kind"] == "heading" for r in lines]), min(BODY, room))):
            part = lines[x:y]
            if held and sum(r["words"] for r in held + part) <= room:
                part, held = held + part, []
            made.append({"lines": part, "section": section, "faq": faq if k == 0 else ""})
    if held and made and sum(r["words"] for r in made[-1]["lines"] + held) <= room:
        made[-1]["lines"], held = made[-1]["lines"] + held, []
    if held:
        made += [{"lines": held[x:y], "section": section, "faq": ""} for x, y in _spans(np.array([r["words"] for r in held]), np.array([True] * len(held)), room)]
    out = []
    for k, chunk in enumerate(made):
        lines = chunk["lines"]
        text = "\n".join([*(r["text"] for r in lines), *([footer] if footer else [])])
        out.append({
            "chunk_index": k, "text": text, "section": chunk["section"], "faq_question": chunk["faq"], "block_kind": kind_of({r["kind"] for r in lines}, chunk["faq"]),
            "token_count": len(text.split()), "char_start": min(r["at"] for r in lines), "char_end": max(r["at"] + len(r["text"]) for r in lines),
        })
    return out


@F.pandas_udf(T.ArrayType(CHUNK))
def _chunks(blocks: pd.Series, url: pd.Series, retrieved: pd.Series) -> pd.Series:
    return pd.Series([pack(doc, f"Source: {link or ''} (retrieved {date or 'unknown'})") for doc, link, date in zip(blocks, url, retrieved)])


def chunked(docs: DataFrame, unique: bool = False) -> DataFrame:
    """``clean_docs`` -> chunks ``(chunk_id, doc_id, source_id, url, chunk_index, text, ...)``.

    Every chunk has at most 256 words, its "Source:" line included; rows and facts longer than that are cut, all others stay
    whole. Documents without blocks have no chunk; a document delivered twice is chunked once
    (``unique``: there are none).
    """
    once = docs.where("doc_id IS NOT NULL") if unique else one_delivery(docs.select("doc_id", "blocks", "source_id", "url", "retrieved_at"), "doc_id")
    ordered = F.array_sort(F.transform("blocks", lambda b: F.struct(b["pos"].alias("pos"), b["kind"].alias("kind"), b["text"].alias("text"), b["level"].alias("level"))))
    made = once.select("doc_id", "source_id", "url", F.explode(_chunks(ordered, F.col("url"), F.col("retrieved_at"))).alias("c"))
    return made.select(chunk_id(F.col("doc_id"), F.col("c.chunk_index"), F.col("c.text")).alias("chunk_id"), "doc_id", "source_id", "url", "c.*")


def block_coverage(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per kind of block: how many there are and how many a chunk of their document holds, white space aside.

    Long paragraphs are cut into slices, which hold all their words: they count as covered if 99 % of their longer
    words are found."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    blobs = chunks.groupBy("doc_id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda c: F.regexp_replace(c["text"], r"\s+", " "))).alias("blob"))
    joined = exploded(docs).where(F.trim("text") != "").join(blobs, "doc_id", "left").withColumn("t", text).withColumn("blob", F.coalesce("blob", F.lit("")))
    longer = F.filter(F.split("t", " "), lambda w: F.length(w) > 3)
    share = F.size(F.filter(longer, lambda w: F.contains(F.col("blob"), w))) / F.greatest(F.size(longer), F.lit(1))
    covered = F.contains("blob", "t") | ((F.size(F.split("t", " ")) > SLICE) & (share >= 0.99))
    return joined.groupBy("kind").agg(F.count(F.lit(1)).alias("wanted"), F.count_if(covered).alias("found"))


def invariants(docs: DataFrame, chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """``(invariant, broken)``: chunks over the limit, repeated ids, documents with text but no chunk, chunks that name
    another source's address, and blocks that no chunk holds."""
    over = chunks.agg(F.count_if(F.col("token_count") > HARD).alias("n")).select(F.lit("too_long").alias("invariant"), F.col("n").alias("broken"))
    repeated = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("repeated_id"), "n")
    empty = exploded(docs).where(F.trim("text") != "").select("doc_id").distinct().join(chunks, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("no_chunk"), "n")
    foreign = foreign_urls(chunks, registry).agg(F.count(F.lit(1)).alias("n")).select(F.lit("foreign_url"), "n")
    missing = block_coverage(docs, chunks).where("kind <> 'heading'").agg(F.coalesce(F.sum(F.col("wanted") - F.col("found")), F.lit(0)).alias("n")).select(F.lit("block_lost"), "n")
    return over.union(repeated).union(empty).union(foreign).union(missing)


def foreign_urls(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """``(chunk_id, source_id, other_id)``: chunks whose text names the address of another source.

    The addresses are taken out of the text and joined by equality, so that no chunk meets every source."""
    urls = chunks.select("chunk_id", "source_id", "url", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"https?://[^\s)\]]+"), F.lit(0)))).alias("found"))
    own = registry.where("url IS NOT NULL AND url <> ''").groupBy(F.col("url").alias("found")).agg(F.min("source_id").alias("other_id"), F.collect_set("source_id").alias("ids"))
    return urls.join(own, "found").where(~F.array_contains("ids", F.col("source_id")) & (F.col("found") != F.coalesce("url", F.lit("")))).select("chunk_id", "source_id", "other_id").distinct()


def require_coverage(coverage: DataFrame, floor: float = 1.0) -> DataFrame:
    """``block_coverage`` as it is, with an error for a kind of block of which less than ``floor`` is in the chunks."""
    share = F.col("found") / F.greatest("wanted", F.lit(1))
    message = F.format_string("of %s blocks only %d of %d are in chunks", F.coalesce("kind", F.lit("other")), "found", "wanted")
    return coverage.select("kind", "wanted", F.when(share < floor, F.raise_error(message).cast("long")).otherwise(F.col("found")).alias("found"))
