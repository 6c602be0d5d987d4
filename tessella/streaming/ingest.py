"""Documents that arrive as files, indexed as they come: an extension, not part of the batch index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import corpus


def stream_postings(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, key: str = "doc_id", text: str = "text", late: str | None = "received_at") -> StreamingQuery:
    """Passages and postings of new documents appended as Parquet; a document delivered twice within
    the watermark counts once."""
    docs = spark.readStream.schema(schema).parquet(folder)
    if late:
        docs = docs.withWatermark(late, "7 days").dropDuplicatesWithinWatermark([key])

    def write(batch: DataFrame, number: int) -> None:
        chunks = corpus.chunk_words(batch, key, text).persist()
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        corpus.term_counts(chunks).write.mode("overwrite").parquet(f"{out}/postings/batch={number}")
        chunks.unpersist()

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
