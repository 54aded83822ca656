"""Records of documents as they arrive in a folder: a file stream through the same steps as a batch.

No step keeps state from one document to the next, so that there is nothing to watermark; what has been read is in the
checkpoint folder, and a restarted stream goes on from there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docsift.plans.builder_queries import records
from docsift.sources.files import extract_text, listed

FILES = "path string, modificationTime timestamp, length long, content binary"


def incoming(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """A stream of files as files.list_files gives them."""
    return listed(lambda: spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_at_once), folder)


def stream_records(spark: SparkSession, folder: str, out: str, checkpoint: str, pdf_text: Callable[[bytes], str] | None = None, **trigger) -> StreamingQuery:
    """Appends JSON records, features included, of every readable file of a folder, and of the others path and error;
    ``status`` says of each whether it is ok.
    ``trigger``: as of DataStreamWriter.trigger; by default all that is there is read, then the stream ends."""
    texts = extract_text(incoming(spark, folder), pdf_text).withColumn("doc_id", F.xxhash64("path"))
    spread = records(spark, texts, keep=("path", "error")).drop("lines", "raw")
    return spread.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
