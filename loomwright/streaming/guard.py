"""The stateless guard over a stream of questions, and upserts of streamed chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intent import category, intent
from ..functions.pii import first_label, first_masked


def guarded(questions: DataFrame) -> DataFrame:
    """``(qid, query)`` -> label, intent, category and the query with its first identifier masked; batch or stream."""
    q = F.col("query")
    return questions.select("qid", first_label(q).alias("pii"), intent(q).alias("intent"), category(q).alias("category"), first_masked(q).alias("query"))


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process all there is of a stream into Parquet, exactly once per checkpoint."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def upsert_batches(stream: DataFrame, store, checkpoint: str, key: str = "chunk_id") -> None:
    """Merge every micro-batch into the store; a batch that is repeated after a failure changes nothing."""
    q = stream.writeStream.foreachBatch(lambda batch, _: store.upsert(batch, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of timestamped events per window and type, late rows being dropped after ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def windows_to_end(stream: DataFrame, out: str, checkpoint: str, width: str = "1 hour", late: str = "2 hours") -> None:
    """All there is of a stream of events, counted in windows with state and a watermark; ``out`` holds the counts as of the
    last micro-batch, which a repeated batch writes again."""
    counts = windowed_counts(stream, width, late)
    q = counts.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
