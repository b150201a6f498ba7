"""Snapshots of pages kept as files, and golden questions kept as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pii import merged_masked

GOLDEN = "id string, query string, expected_kind string, expected_facts array<string>, expected_source_id string, forbidden_terms array<string>, note string"


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Files ``<source_id>.<ending>`` -> pages as the fetcher would give them: status "cached", http 0, the file's date."""
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("source_id"), F.col("content").alias("raw_bytes"), F.lit("cached").alias("status"), F.lit(0).alias("http_status"), F.date_format("modificationTime", "yyyy-MM-dd").alias("retrieved_at"))


def scrubbed_snapshots(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """Write the text snapshots of a folder to another one with their identifiers masked -> ``(source_id, changed)``."""
    pages = read_snapshots(spark, folder).select("source_id", F.decode("raw_bytes", "UTF-8").alias("text"))
    done = pages.select("source_id", merged_masked("text").alias("clean"), "text")
    done.select("source_id", F.col("clean").alias("text"), (F.col("clean") != F.col("text")).alias("changed")).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target).select("source_id", "changed")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON array; an empty list, or one without an id, a query or an expected kind, is an error."""
    rows = spark.read.schema(GOLDEN).option("multiLine", True).option("mode", "FAILFAST").json(path)
    bad = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id").isNull() | F.col("query").isNull() | F.col("expected_kind").isNull()).alias("bad")).first()
    if not bad["n"] or bad["bad"]:
        raise ValueError(f"{bad['bad']} of {bad['n']} questions lack an id, a query or an expected kind")
    return rows
