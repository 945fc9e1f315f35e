"""New crawl rows as a stream: files that arrive in a folder are chunked and appended to a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from siltmill.operators.chunking import page_chunks

PAGES = "key string, url string, title string, content_hash string, text string"


def read_pages(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_at_once).json(folder)


def chunk_stream(pages: DataFrame) -> DataFrame:
    """Chunks of streamed pages. A page is chunked within its row, so the stream keeps no state."""
    return page_chunks(pages.filter("key is not null and text is not null"), "key", "content_hash", "title", "text")


def append_chunks(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
