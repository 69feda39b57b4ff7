"""Shared plumbing of the page-wise operators.

A page is the unit of work: its lines and its blocks are brought together by ONE exchange on
(doc_id, page_no) and a sort inside the partitions, and then streamed through an Arrow kernel.
No group is ever collected by the JVM, and a file of any number of pages spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_dir, staged  # noqa: F401

#: Rows of an Arrow batch that the kernels return, at least (but for the last batch of a task).
OUT_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_rows(lines: DataFrame, blocks: DataFrame, block_filter=None, extra: str | None = None) -> DataFrame:
    """Lines (typ 0) and blocks (typ 1) of each page next to each other, sorted by number.

    Rows with a null in their key and lines with a null text carry nothing and are left out
    before the exchange. Other columns are pruned away, but for the line column named as extra (a float).
    """
    left = lines.where("doc_id is not null and page_no is not null and line_id is not null and text is not null").select(
        "doc_id", "page_no", F.lit(0).alias("typ"), F.col("line_id").cast("int").alias("num"), "text",
        F.lit(None).cast("string").alias("kind"), F.lit(None).cast("array<int>").alias("ids"), *([F.col(extra).cast("float").alias("extra")] if extra else []),
    )
    right = blocks.where("doc_id is not null and page_no is not null and block_no is not null and line_ids is not null")
    if block_filter is not None:
        right = right.where(block_filter)
    right = right.select(
        "doc_id", "page_no", F.lit(1).alias("typ"), F.col("block_no").cast("int").alias("num"), F.lit(None).cast("string").alias("text"),
        "kind", F.col("line_ids").cast("array<int>").alias("ids"),
    )
    if extra:
        right = right.withColumn("extra", F.lit(None).cast("float"))
    both = left.unionByName(right)
    return both.repartition("doc_id", "page_no").sortWithinPartitions("doc_id", "page_no", "typ", "num", "text")


def page_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, dict[int, str], list[tuple[int, str, list[int]]]] | None]:
    """(doc_id, page_no, text by line, blocks in order) of each page of a sorted partition; None after each input batch.

    A repeated line or block counts once; where copies of a line differ, the smallest text holds.
    With an extra column, the value of a line is the pair (text, extra).
    """
    doc = page = None
    lines: dict[int, str] = {}
    blocks: list[tuple[int, str, list[int]]] = []
    last = None
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(7)]
        if batch.num_columns > 7:
            cols[4] = list(zip(cols[4], batch.column(7).to_pylist()))
        for d, p, typ, num, text, kind, ids in zip(*cols):
            if p != page or d != doc:
                if doc is not None:
                    yield doc, page, lines, blocks
                doc, page, lines, blocks, last = d, p, {}, [], None
            if typ == 0:
                if num not in lines:
                    lines[num] = text
            elif num != last:
                blocks.append((num, kind, ids))
                last = num
        yield None
    if doc is not None:
        yield doc, page, lines, blocks


def page_kernel(fn: Callable[[int, int, dict[int, str], list], Iterator[tuple]], schema: pa.Schema):
    """A mapInArrow function that calls fn for each page and returns its rows under schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for item in page_stream(batches):
            if item is not None:
                out.extend(fn(*item))
            elif len(out) >= OUT_ROWS:
                yield to_batch(out, schema)
                out = []
        if out:
            yield to_batch(out, schema)

    return run


def small_set(df: DataFrame, most: int) -> list:
    """Rows of a dimension table of fixed size, on the driver; more than most rows are refused, never cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a dimension table of more than {most} rows can't be sent to all tasks")
    return rows


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)
