"""Ordered blocks of documents: offsets, sections, duplicates, facts, footers. Order is always a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.shared import one_delivery

#: What marks the end of a page's own text, and notices that count as one per document: configuration, in the words of the
#: pages at hand; pass others for other pages.
FOOTER = ("helpline ", "data as on ", "page last refreshed", "reproduction needs", " rights reserved", "belong to ", "toll-free line")
DISCLAIMER = ("carry market risk", "can fall as well as rise", "promise nothing", "nothing here is advice")
#: Names of figures that pages give as label and value.
LABELS = ("aum", "benchmark", "cut-off time", "exit load", "expense ratio", "fund manager", "lock-in", "minimum sip", "minimum purchase", "nav", "riskometer", "stamp duty")
#: Of these the value may be a text; of all others it holds a figure or says that there is none.
OPEN_LABELS = ("benchmark", "fund manager", "riskometer")
MAX_VALUE = 60


def spelled(labels: tuple[str, ...]) -> str:
    """A pattern of the labels, however their words are joined."""
    return "(?:" + "|".join(r"[\s-]*".join(x.replace("-", " ").split()) for x in labels) + ")"


METRIC = rf"(?i)\b{spelled(LABELS)}\b"
FACT = rf"(?i)^{spelled(LABELS)}$"
FREE_FACT = rf"(?i)^{spelled(OPEN_LABELS)}$"
FIGURE_VALUE = r"(?i)^(?:\D{0,5}[0-9].*|nil|none|not applicable|-)$"


def exploded(docs: DataFrame) -> DataFrame:
    """``(doc_id, blocks)`` -> one row per block; a document that comes twice counts once, with its smallest blocks."""
    once = one_delivery(docs.select("doc_id", "blocks"), "doc_id")
    return once.select("doc_id", F.inline("blocks")).where("text IS NOT NULL")


def in_doc() -> W:
    return W.partitionBy("doc_id").orderBy("pos")


def flattened(text: Column, kind: Column, level: Column) -> Column:
    return F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(level, F.lit(1))), F.lit(" "), text)).otherwise(text)


def line_offsets(blocks: DataFrame) -> DataFrame:
    """Start and end of each block's line in the flattened document, lines being joined by one line feed."""
    line = flattened(F.col("text"), F.col("kind"), F.col("level"))
    start = F.coalesce(F.sum(F.length("line") + 1).over(in_doc().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("line", line).select("doc_id", "pos", "line", start.alias("char_start"), (start + F.length("line")).alias("char_end"))


def sections(blocks: DataFrame) -> DataFrame:
    """Each block with the last heading of level 1 or 2 at or before it."""
    head = F.when((F.col("kind") == "heading") & (F.col("level") <= 2), F.col("text"))
    return blocks.withColumn("section", F.last(head, ignorenulls=True).over(in_doc().rowsBetween(W.unboundedPreceding, 0)))


def is_disclaimer(text: Column) -> Column:
    low = F.lower(text)
    return F.lit(False) if not DISCLAIMER else _any_of(low, DISCLAIMER)


def _any_of(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.contains(text, F.lit(parts[0]))
    for p in parts[1:]:
        found = found | F.contains(text, F.lit(p))
    return found


def without_repeats(blocks: DataFrame) -> DataFrame:
    """Each text once per document, the first; headings stay, disclaimers are one per first 120 characters."""
    key = F.when(is_disclaimer(F.col("text")), F.substring(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), 1, 120)).otherwise(F.col("text"))
    rank = F.row_number().over(W.partitionBy("doc_id", "key").orderBy("pos"))
    return blocks.withColumn("key", key).withColumn("r", rank).where((F.col("kind") == "heading") | (F.col("r") == 1)).drop("key", "r")


def before_footer(blocks: DataFrame) -> DataFrame:
    """The blocks before the first one, headings aside, that holds a footer mark."""
    mark = F.when((F.col("kind") != "heading") & _any_of(F.lower("text"), FOOTER), F.col("pos"))
    return blocks.withColumn("stop", F.min(mark).over(W.partitionBy("doc_id"))).where("stop IS NULL OR pos < stop").drop("stop")


def paired_facts(blocks: DataFrame) -> DataFrame:
    """A label block followed by a fitting value becomes label and fact ("label: value"); the raw value goes."""
    nxt, nxt_kind = F.lead("text").over(in_doc()), F.lead("kind").over(in_doc())
    fits = (F.length(nxt) <= MAX_VALUE) & (F.col("text").rlike(FREE_FACT) | nxt.rlike(FIGURE_VALUE)) & ~nxt.rlike(FACT)
    pair = F.col("text").rlike(FACT) & fits & (nxt_kind != "heading") & ~F.col("kind").isin("fact", "table_row")
    marked = blocks.withColumn("value", F.when(pair, nxt)).withColumn("used", F.coalesce(F.lag(pair).over(in_doc()), F.lit(False)) & ~F.coalesce(pair, F.lit(False)))
    kept = marked.where("NOT used")
    fact = F.struct(F.lit("fact").alias("kind"), F.concat("text", F.lit(": "), "value").alias("text"), F.lit(0).alias("level"))
    own = F.struct("kind", "text", "level")
    return kept.select("doc_id", "pos", F.posexplode(F.when(F.col("value").isNotNull(), F.array(own, fact)).otherwise(F.array(own))).alias("part", "b")).select("doc_id", "pos", "part", "b.*")


def warnings(docs: DataFrame, shortest: int = 2000, longest: int = 8000) -> DataFrame:
    """``clean_docs`` -> ``(doc_id, warnings)``: what a reader should know of a cleaned page: no or little text, blocks that
    repeat, several copies of a notice, more than half of it behind the footer, blocks that are very long."""
    once = one_delivery(docs.select("doc_id", "blocks"), "doc_id")
    texts = F.filter(F.transform(F.coalesce("blocks", F.array().cast(dict(docs.dtypes)["blocks"])), lambda b: F.coalesce(b["text"], F.lit(""))), lambda t: F.trim(t) != "")
    ordered = F.array_sort(F.transform(F.filter(F.coalesce("blocks", F.array().cast(dict(docs.dtypes)["blocks"])), lambda b: b["text"].isNotNull()), lambda b: F.struct(b["pos"].alias("pos"), b["kind"].alias("kind"), b["text"].alias("text"))))
    chars = lambda xs, f: F.aggregate(xs, F.lit(0), lambda s, x: s + F.length(f(x)))
    at = F.array_min(F.transform(F.filter("ordered", lambda b: (F.coalesce(b["kind"], F.lit("")) != "heading") & _any_of(F.lower(b["text"]), FOOTER)), lambda b: b["pos"]))
    d = once.withColumn("texts", texts).withColumn("ordered", ordered).withColumn("total", chars(F.col("texts"), lambda x: x))
    d = d.withColumn("behind", F.when(at.isNotNull(), chars(F.filter("ordered", lambda b: b["pos"] >= at), lambda b: b["text"])).otherwise(0))
    notices = F.size(F.filter("texts", lambda t: is_disclaimer(t)))
    repeats = F.size("texts") - F.size(F.array_distinct("texts"))
    long = F.size(F.filter("texts", lambda t: F.length(t) > longest))
    found = F.array(
        F.when(F.col("total") < shortest, F.format_string("text shorter than %d", F.lit(shortest))), F.when(repeats > 0, F.format_string("%d duplicates collapsed", repeats)), F.when(notices > 1, F.format_string("%d notices", notices)),
        F.when(2 * F.col("behind") > F.col("total"), F.lit("more than half dropped")), F.when(long > 0, F.format_string("%d blocks truncated", long)),
    )
    return d.select("doc_id", F.filter(found, lambda x: x.isNotNull()).alias("warnings"))
