"""Readers: the page tables of a folder, and files as document rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import natural_key
from ..operators.ranking import ranked

# --- fixed values -------------------------------------------------------------------------------
IMAGE_ENDS = ("png", "jpg", "jpeg", "jpe", "bmp", "dib", "gif", "tif", "tiff", "ico", "emf", "wmf")
# ------------------------------------------------------------------------------------------------


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def once(df: DataFrame, key: list[str], first: list[str], partition: list[str] | None = None) -> DataFrame:
    """One row for each key, the first by the given columns; the exchange is on partition, which later windows can use again.

    Long strings are ordered by a hash taken before the exchange, so that a text nobody asks for doesn't travel.
    """
    order = [F.xxhash64(c) if c == "text" else F.col(c) for c in first]
    df = df.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    if partition:
        df = df.repartition(*partition)
    w = W.partitionBy(*key).orderBy(*[f"_o{i}" for i in range(len(order))])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", *[f"_o{i}" for i in range(len(order))])


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Each positioned line once, its box and style as flat columns, partitioned by page."""
    df = once(read(spark, folder, "text_lines").where("bounds is not null"), ["doc_id", "page_no", "line_id"], ["loaded_at", "text"], ["doc_id", "page_no"])
    box = [F.col(f"bounds.{f}").cast("double").alias(f) for f in "ltrb"]
    return df.select("doc_id", "page_no", "line_id", "text", "confidence", *box, F.col("style.size_pt").alias("size_pt"), F.col("style.bold").alias("bold"), F.col("style.italic").alias("italic"), F.col("style.color").alias("color"), F.col("style.family").alias("family"), "in_figure", "edited")


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Each layout block once, partitioned by page."""
    df = once(read(spark, folder, "layout_blocks").where("bounds is not null"), ["doc_id", "page_no", "block_no"], ["kind", "space_before"], ["doc_id", "page_no"])
    box = [F.col(f"bounds.{f}").cast("double").alias(f) for f in "ltrb"]
    return df.select("doc_id", "page_no", "block_no", "kind", "line_ids", *box, "heading_level", "list_marker", "ordered_list", "section_no", "column_no", "align", "space_before")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return once(read(spark, folder, "doc_pages"), ["doc_id", "page_no"], ["loaded_at"])


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))


def file_kind(path: Column) -> Column:
    """pdf, image, or rejected, by the lower-case extension."""
    ext = extension(path)
    return F.when(ext == "pdf", "pdf").when(ext.isin(*IMAGE_ENDS), "image").otherwise("rejected")


def image_sequences(files: DataFrame, path: str = "path") -> DataFrame:
    """Images of a folder as the pages of one document, in natural order: (folder, path, page_no)."""
    rows = files.where(file_kind(F.col(path)) == "image").select(folder(F.col(path)).alias("folder"), path)
    rows = rows.withColumn("_key", natural_key(file_name(F.col(path))))
    return ranked(rows, ["folder"], ["_key", path], "page_no").select("folder", path, F.col("page_no").cast("int").alias("page_no"))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)[\\\\/][^\\\\/]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^\\\\/]*)$", 1)


def workspace_documents(files: DataFrame, path: str = "path") -> DataFrame:
    """Files as documents of a workspace: (document, kind, path, page_no, error).

    The images of a folder are one sequence named as the folder, in natural order; each PDF is a document of its own; all else is a row with an error.
    """
    kind = file_kind(F.col(path))
    pdf = files.where(kind == "pdf").select(F.col(path).alias("document"), F.lit("Pdf").alias("kind"), path, F.lit(1).alias("page_no"), F.lit(None).cast("string").alias("error"))
    rest = files.where((kind == "rejected") | F.col(path).isNull()).select(F.col(path).alias("document"), F.lit("Rejected").alias("kind"), path, F.lit(None).cast("int").alias("page_no"), F.lit("unsupported file type").alias("error"))
    seq = image_sequences(files, path).select(F.col("folder").alias("document"), F.lit("ImageSequence").alias("kind"), path, "page_no", F.lit(None).cast("string").alias("error"))
    return seq.unionByName(pdf).unionByName(rest)


def binary_files(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """Files of a folder with their kind; rejected ones stay, as rows with an error."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    kind = file_kind(F.col("path"))
    return df.select("path", kind.alias("kind"), "length", "modificationTime", "content", F.when(kind == "rejected", "Unsupported file type").alias("error"))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(index, symbol) of a recogniser's dictionary file: blank first, a space last; carriage returns stripped."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\\n$", ""), "\n")).alias("i", "symbol"))
    rows = rows.select((F.col("i") + 1).alias("index"), F.regexp_replace("symbol", "\\r$", "").alias("symbol"))
    ends = rows.agg((F.max("index") + 1).alias("index")).select("index", F.lit(" ").alias("symbol"))
    return spark.createDataFrame([(0, "")], "index int, symbol string").unionByName(rows).unionByName(ends)


def memory_images(spark: SparkSession, images: list[tuple[str, int, int, bytes]], kind: str = "Clipboard") -> DataFrame:
    """Documents from images in memory, one page each: (document, kind, page_no, width, height, pixels)."""
    rows = [(name, kind, 1, w, h, bytearray(px)) for name, w, h, px in images]
    return spark.createDataFrame(rows, "document string, kind string, page_no int, width int, height int, pixels binary")


def settings(spark: SparkSession, path: str, defaults: dict[str, object], schema: str) -> DataFrame:
    """One row of settings from a JSON file; defaults for what is missing, for a broken file, and for no file at all."""
    base = spark.createDataFrame([tuple(defaults.values())], schema)
    try:
        found = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path).limit(1)
        found.schema  # noqa: B018
        found = found.select(*[F.col(c).alias(f"own_{c}") for c in base.columns])
        return base.join(found, F.lit(True), "left").select(*[F.coalesce(f"own_{c}", c).alias(c) for c in base.columns])
    except AnalysisException:
        return base


def save_settings(df: DataFrame, path: str) -> None:
    """One row of settings as a JSON file: written beside, then moved into its place."""
    import json
    import os

    row = df.limit(2).collect()
    if len(row) != 1:
        raise ValueError("settings are one row")
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(row[0].asDict(recursive=True), f, ensure_ascii=False, default=str)
    os.replace(f"{path}.tmp", path)
