"""A versioned chunk store on plain Parquet: idempotent upserts, a pointer file, readiness checks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


class StoreMissing(RuntimeError):
    """The store is absent, empty, unreadable or of another version."""


def upserted(existing: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of ``existing`` whose key isn't in ``new``, and ``new`` with one row per key (the smallest)."""
    rest = [c for c in new.columns if c != key]
    once = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")
    return existing.join(once, key, "left_anti").unionByName(once)


def metadata(chunks: DataFrame) -> DataFrame:
    """The columns stored beside a vector: no text and offsets, null text as empty."""
    text = ("chunk_id", "source_id", "source_title", "url", "authority", "scheme", "scheme_category", "doc_type", "section", "faq_question", "retrieved_at", "block_kind")
    return chunks.select(*[F.coalesce(c, F.lit("")).alias(c) for c in text], F.coalesce("discover_only", F.lit(False)).alias("discover_only"), F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), F.coalesce("token_count", F.lit(0)).alias("token_count"))


class Store:
    """Versions are folders below ``root``; the last line of the pointer table names the current one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _current(self) -> dict | None:
        """The last version of the pointer; none only if there is no pointer. Errors while reading it are errors."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/pointer")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        rows = self.spark.read.text(f"{self.root}/pointer").collect()  # one line a version
        return max((json.loads(r[0]) for r in rows), key=lambda v: v["n"], default=None)

    def read(self) -> DataFrame:
        """The current version, if it is ready."""
        v = self._current()
        if v is None:
            raise StoreMissing("there is no store")
        if v["schema_version"] != SCHEMA_VERSION:
            raise StoreMissing(f"the store has version {v['schema_version']}, not {SCHEMA_VERSION}")
        df = self.spark.read.parquet(f"{self.root}/{v['folder']}")
        if df.isEmpty():
            raise StoreMissing("the store is empty")
        return df

    def upsert(self, new: DataFrame, key: str = "chunk_id", force: bool = False) -> int:
        """Write a new version with ``new`` merged in (or alone, with ``force``), then move the pointer. Readers of the
        version before keep their files. Returns the number of rows."""
        v = self._current()
        empty = new.limit(0)
        existing = empty if force or v is None else self.spark.read.parquet(f"{self.root}/{v['folder']}").drop("discover_part")
        folder = f"v-{uuid.uuid4().hex}"
        upserted(existing, new, key).withColumn("discover_part", F.coalesce("discover_only", F.lit(False)) if "discover_only" in new.columns else F.lit(False)).write.partitionBy("discover_part").parquet(f"{self.root}/{folder}")
        n = self.spark.read.parquet(f"{self.root}/{folder}").count()
        line = json.dumps({"n": (v["n"] + 1) if v else 1, "folder": folder, "schema_version": SCHEMA_VERSION, "rows": n})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{self.root}/pointer")
        return n

    def count(self) -> int:
        return self.read().count()


# renderings of the stored rows, as lines that a distributed writer can take


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, line)``: every chunk as a readable record of fixed layout; the order is that of the ids."""
    once = chunks.where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.min(F.struct("source_id", "section", "block_kind", F.coalesce("token_count", F.lit(0)).alias("token_count"), "text")).alias("r"))
    cell = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(""))
    return once.select("chunk_id", F.concat(F.lit("== "), "chunk_id", F.lit(" | "), cell("source_id"), F.lit(" | "), cell("section"), F.lit(" | "), cell("block_kind"), F.lit(" | "), F.col("r.token_count").cast("string"), F.lit(" words\n"), cell("text")).alias("line"))


def vector_preview(rows: DataFrame, id_: str, embedding: str, dims: int = 12) -> DataFrame:
    """``(id, preview)``: the first components of each vector and its length, six digits each; null vectors have no row."""
    from .vectors import norm

    shown = F.array_join(F.transform(F.slice(F.col(embedding), 1, dims), lambda x: F.format_string("%.6f", x.cast("double"))), " ")
    return rows.where(F.col(embedding).isNotNull()).select(F.col(id_).alias("id"), F.concat(shown, F.format_string(" | %.6f", norm(F.col(embedding)))).alias("preview")).distinct()


def vector_stats(rows: DataFrame, embedding: str) -> DataFrame:
    """How many vectors there are, their least, mean and greatest length, and how far a length is from 1 at most."""
    from .vectors import norm

    n = rows.where(F.col(embedding).isNotNull()).select(norm(F.col(embedding)).alias("n"))
    return n.agg(F.count("n").alias("vectors"), F.round(F.min("n"), 6).alias("least"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.max("n"), 6).alias("greatest"), F.round(F.max(F.abs(F.col("n") - 1)), 6).alias("off_by"))


def write_lines(lines: DataFrame, path: str, order: str, column: str = "line") -> None:
    """Lines as text files, sorted over all files: as many writers as there are ranges."""
    lines.repartitionByRange(order).sortWithinPartitions(order).select(column).write.text(path)
