"""Rendering of blocks, tables and documents as text and HTML, with expressions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLANK, flow, html_encode, marker_prefix

PAGE = ["doc_id", "page_no"]


def block_text(own: DataFrame) -> DataFrame:
    """(page, block_no, kind, text, flow): text is a block's lines by line feeds (a heading's by blanks, a table's by its cells), flow its flowing text; a list item's marker is taken off its first line and put before both."""
    lines = own.where("text is not null").groupBy(*PAGE, "block_no", "kind", "list_marker").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("own"))
    head = F.col("own")[0]
    first = F.regexp_replace(head.substr(marker_prefix(head) + 1, F.length(head)), f"^[{BLANK}]+", "")
    item = (F.col("kind") == "ListItem") & F.col("list_marker").isNotNull()
    body = F.when(item & (marker_prefix(head) > 0), F.concat(F.array(first), F.slice("own", 2, F.greatest(F.size("own") - 1, F.lit(0))))).otherwise(F.col("own"))
    lines = lines.withColumn("own", body)
    mark = F.when(item, F.concat("list_marker", F.lit(" "))).otherwise("")
    raw = F.array_join("own", "\n")
    cells = F.array_join(F.transform("own", lambda t: F.regexp_replace(t, CELL_GAP, "\t")), "\n")
    text = F.when(F.col("kind") == "Table", F.regexp_replace(cells, f"[{BLANK}]+$", "")).when(F.col("kind") == "Figure", "").otherwise(F.concat(mark, F.when(F.col("kind") == "Heading", F.array_join("own", " ")).otherwise(raw)))
    return lines.select(*PAGE, "block_no", "kind", text.alias("text"), F.when(F.col("kind").isin("Table", "Figure"), "").otherwise(F.concat(mark, flow(raw))).alias("flow"))


#: What ends a cell in the line of a table.
CELL_GAP = "\t| {2,}"


def split_cells(own: DataFrame) -> DataFrame:
    """Cells of tables whose lines are rows: (page, block_no, row, col, text)."""
    w = Window.partitionBy(*PAGE, "block_no").orderBy("pos")
    rows = own.select(*PAGE, "block_no", (F.row_number().over(w) - 1).alias("row"), "text")
    return rows.select(*PAGE, "block_no", "row", F.posexplode(F.split("text", CELL_GAP)).alias("col", "text"))


def page_text(blocks: DataFrame) -> DataFrame:
    """Texts of a page's blocks with a blank line between, trimmed at the end, and a line feed."""
    own = blocks.where("text != ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), "\n\n")
    return own.groupBy(*PAGE).agg(joined.alias("text")).select(*PAGE, F.concat(F.regexp_replace("text", f"[{BLANK}]+$", ""), F.lit("\n")).alias("text"))


def document_text(pages: DataFrame) -> DataFrame:
    """The text file of each document as parts in page order: a byte order mark before the first, a form feed and a line feed between.

    The pages stay apart, as a document has no bound; a writer puts them behind each other.
    """
    first = F.col("page_no") == F.col("_first")
    return pages.join(pages.groupBy("doc_id").agg(F.min("page_no").alias("_first")), "doc_id").select("doc_id", "page_no", F.concat(F.when(first, F.lit("\ufeff")).otherwise(F.lit("\f\n")), F.col("text")).alias("part"))


def block_html(blocks: DataFrame) -> DataFrame:
    text = html_encode(F.when(F.col("kind") == "Table", F.col("text")).otherwise(F.col("flow")))
    level = F.least(F.greatest(F.coalesce("heading_level", F.lit(1)), F.lit(1)), F.lit(3)).cast("string")
    html = (
        F.when(F.col("kind") == "Heading", F.concat(F.lit("<h"), level, F.lit(">"), text, F.lit("</h"), level, F.lit(">")))
        .when(F.col("kind") == "ListItem", F.concat(F.lit("<li>"), text, F.lit("</li>")))
        .when(F.col("kind") == "Table", F.concat(F.lit("<pre>"), text, F.lit("</pre>")))
        .otherwise(F.concat(F.lit("<p>"), F.replace(text, F.lit("\n"), F.lit("<br>")), F.lit("</p>")))
    )
    return blocks.where("kind != 'Figure'").select(*PAGE, "block_no", html.alias("html"))


def grid_text(cells: DataFrame) -> DataFrame:
    """Tables as text: cells of a row by tabs, rows by line feeds, empty where no cell is, trimmed at the end. Input: page, block_no, row, col, text (once each)."""
    key = [*PAGE, "block_no"]
    size = cells.groupBy(*key).agg(F.max("row").alias("rows"), F.max("col").alias("cols"))
    grid = size.select(*key, F.explode(F.sequence(F.lit(0), "rows")).alias("row"), "cols").select(*key, "row", F.explode(F.sequence(F.lit(0), "cols")).alias("col"))
    full = grid.join(cells, [*key, "row", "col"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    rows = full.groupBy(*key, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]), "\t").alias("text"))
    out = rows.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return out.select(*key, F.regexp_replace("text", f"[{BLANK}]+$", "").alias("text"))
