"""Files of a folder as a stream: each arriving file is opened once, and fails alone.

The stream's own checkpoint says which files have been taken; a batch that runs again writes its folder anew, so a file
is in the result once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.images import image_pages
from ..sources.pdf import pdf_pages
from ..sources.tables import file_kind

#: What Spark's reader of binary files gives.
FILES = "path string, modificationTime timestamp, length bigint, content binary"


def opened_pages(files: DataFrame) -> DataFrame:
    """(path, kind, page_no, width, height, status, error): a row for each page of files (path, content); a file that can't be opened, or is of no known kind, is one row with status Failed."""
    kind = file_kind(F.col("path"))
    whole = lambda df: df.select("path", "content")
    pdf = pdf_pages(whole(files.where(kind == "pdf"))).select("path", F.lit("pdf").alias("kind"), "page_no", "width", "height", "error")
    image = image_pages(whole(files.where(kind == "image"))).select("path", F.lit("image").alias("kind"), "page_no", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"), F.lit(None).cast("string").alias("error"))
    rest = files.where(kind == "rejected").select("path", F.lit("rejected").alias("kind"), F.lit(None).cast("int").alias("page_no"), F.lit(None).cast("double").alias("width"), F.lit(None).cast("double").alias("height"), F.lit("Unsupported file type").alias("error"))
    rows = pdf.unionByName(image).unionByName(rest)
    return rows.select("path", "kind", "page_no", "width", "height", F.when(F.col("error").isNull(), "Done").otherwise("Failed").alias("status"), "error")


def ingest_files(spark: SparkSession, folder: str, out: str, checkpoint: str, files_a_batch: int = 1000) -> StreamingQuery:
    """Starts a stream that writes the pages of files in folder to out/batch=n and goes on with those that arrive; files_a_batch bounds the work of one batch, not of all."""
    source = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_a_batch).load(folder)

    def write(batch: DataFrame, n: int) -> None:
        opened_pages(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_once(spark: SparkSession, folder: str, out: str, checkpoint: str) -> DataFrame:
    """Takes what has arrived since the last time, and returns all pages so far."""
    ingest_files(spark, folder, out, checkpoint).awaitTermination()
    return spark.read.parquet(out)
