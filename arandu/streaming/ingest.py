"""New files of an inbox, parsed once each, by Structured Streaming with a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import is_ignored, parse_files


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of the files of a folder and its subfolders but those ignored."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    return files.where(~is_ignored(F.col("path")))


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, batch: str | None = None) -> StreamingQuery:
    """Parse what is new and append it as Parquet, with a batch column; ends when all files are read.

    The checkpoint remembers files and batches, so that a run that fails goes on where it was and no file comes twice.
    """
    documents = parse_files(inbox(spark, folder)).withColumn("batch", F.lit(batch) if batch else F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss"))
    return documents.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(spark: SparkSession, folder: str, collection: str, checkpoint: str, embeddings: bool = False) -> StreamingQuery:
    """Add what is new in a folder to a collection: each micro-batch is parsed and its tables are added; ends when all
    files are read. A batch that is run again replaces its own documents, so that it may fail and be tried anew."""
    from ..collection import Collection

    def add(batch: DataFrame, number: int) -> None:
        if batch.limit(1).count():
            Collection(batch.sparkSession, collection).add(batch, embeddings)

    return parse_files(inbox(spark, folder)).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
