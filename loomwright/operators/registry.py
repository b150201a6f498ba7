"""The source registry: scan, typing, validation and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ("source_id", "url", "authority", "scheme", "scheme_category", "doc_type", "discover_only", "enabled", "retrieved_at", "fetch_status", "notes")
# Domains of the registry's columns.
AUTHORITIES = ("official", "aggregator")
DOC_TYPES = ("scheme_page", "factsheet", "fee_charges", "kim", "sid", "guide", "faq")
TRUE, FALSE = ("true", "yes", "1"), ("false", "no", "0", "")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, an empty cell staying empty; a missing, extra or moved column is an error."""
    header = spark.read.text(path).first()
    names = tuple(x.strip().strip('"') for x in (header[0] if header else "").split(","))
    if names != COLUMNS:
        raise ValueError(f"the registry has the columns {names}, not {COLUMNS}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST").fillna("")


def as_bool(cell: Column) -> Column:
    """True, false, or null for what can't be read."""
    low = F.lower(F.trim(F.coalesce(cell, F.lit(""))))
    return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#\s]*)", 1))


def typed(registry: DataFrame) -> DataFrame:
    """The registry with truth values and hosts; null cells are empty."""
    text = [F.coalesce(c, F.lit("")).alias(c) for c in COLUMNS if c not in ("discover_only", "enabled")]
    return registry.select(*text, as_bool(F.col("discover_only")).alias("discover_only"), as_bool(F.col("enabled")).alias("enabled"), host(F.col("url")).alias("host"))


def violations(registry: DataFrame, hosts: list[str], schemes: list[str] | DataFrame) -> DataFrame:
    """``(source_id, url, rule)``: the first broken rule of each row, no row for sound ones.

    Repeats of an id are found by a count that is joined back, so one id with many rows needs no window of its own.
    ``schemes`` are names, or a table of them in ``scheme``, of any size."""
    counts = registry.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    r = typed(registry).join(counts.select(F.coalesce("source_id", F.lit("")).alias("source_id"), "n").groupBy("source_id").agg(F.sum("n").alias("n")), "source_id")
    if isinstance(schemes, DataFrame):
        r = r.join(schemes.select("scheme", F.lit(True).alias("known")).distinct(), "scheme", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    else:
        r = r.withColumn("known", F.col("scheme").isin(schemes))
    rule = (
        F.when(F.trim("source_id") == "", "empty_id")
        .when(F.col("n") > 1, "repeated_id")
        .when(~F.col("host").isin(hosts), "host")
        .when(~F.col("authority").isin(*AUTHORITIES), "authority")
        .when(F.col("discover_only").isNull() | F.col("enabled").isNull(), "truth_value")
        .when((F.col("authority") == "aggregator") & ~F.col("discover_only"), "citable_aggregator")
        .when(~F.col("known"), "scheme")
        .when(~F.col("doc_type").isin(*DOC_TYPES), "doc_type")
    )
    return r.select("source_id", "url", rule.alias("rule")).where("rule IS NOT NULL")


def citable(registry: DataFrame) -> DataFrame:
    """Enabled rows that may be cited, one per id (of repeats the one with the smallest url)."""
    good = typed(registry).where("enabled AND NOT discover_only AND source_id <> ''")
    rest = [c for c in good.columns if c not in ("source_id", "url")]
    return good.groupBy("source_id").agg(F.min("url").alias("url"), *[F.min_by(c, F.struct("url", *rest)).alias(c) for c in rest])


def preferred_urls(registry: DataFrame, doc_type: str = "factsheet") -> DataFrame:
    """Per category the address of a page of the preferred type, else of any citable page."""
    return citable(registry).groupBy("scheme_category").agg(F.min_by("url", F.struct((F.col("doc_type") != doc_type).alias("other"), F.col("source_id").alias("id"))).alias("url"), F.count(F.lit(1)).alias("n_sources"))
