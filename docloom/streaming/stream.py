"""Chunking of files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.config import ChunkConfig
from docloom.plans.chunking import chunk_blocks
from docloom.sources.text import text_blocks


def chunk_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "doc_id long, text string", config: ChunkConfig = ChunkConfig(template="generic_structured"), prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Read Parquet files of (doc_id, text) under ``source`` as they come, write children under ``target`` by batch.

    A document is chunked by its own rows alone, so a batch needs no state.  Each batch overwrites its own folder, so a batch that is run
    again after a failure leaves no second copy.
    """

    def write(batch: DataFrame, number: int) -> None:
        docs = (prepare(batch) if prepare else batch).select(F.col("doc_id").cast("string").alias("document_id"), "text")
        chunk_blocks(text_blocks(docs), config)[1].drop("parent_order").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
