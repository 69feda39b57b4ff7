"""Lines from the characters of a page's text layer: islands over the order of characters, all windows partition by page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import BLANK

PAGE = ["doc_id", "page_no"]


def text_layer_lines(chars: DataFrame, dpi: float = 72.0) -> DataFrame:
    """(page, line_no, text, l, t, r, b, size_pt, bold, italic, color, font) from chars (page, char_no, ch, l, t, r, b, font_pt, bold, italic, color, font, hard_break).

    A line ends at a hard break, where the middle jumps by more than 0.6 of a height, where a character stands more than a height
    before the last one, or 1.6 times its size or more behind it. White space counts for nothing but a blank between two
    characters of a line, and hands a hard break on. The style is that of most characters, of equals the first; a page of blanks has no line.
    """
    page = W.partitionBy(*PAGE).orderBy("char_no")
    ink = F.coalesce(F.col("ch").rlike(f"[^{BLANK}]"), F.lit(False))
    so_far = page.rowsBetween(W.unboundedPreceding, W.currentRow)
    breaks, place = F.sum(F.coalesce("hard_break", F.lit(False)).cast("int")).over(so_far), F.row_number().over(page)
    own = chars.select(*PAGE, "char_no", "ch", "l", "t", "r", "b", "font_pt", "bold", "italic", "color", "font", ink.alias("ink"), breaks.alias("breaks"), place.alias("place")).where("ink")
    last = lambda c: F.lag(c).over(page)
    lh = F.greatest(F.lit(1.0), F.least(F.col("b") - F.col("t"), last("b") - last("t")))
    jump = F.abs((F.col("t") + F.col("b")) / 2 - (last("t") + last("b")) / 2) > lh * 0.6
    back, gap = F.col("l") < last("l") - lh, F.col("l") - last("r") > F.greatest(lh, F.col("font_pt") * dpi / 72) * 1.6
    opens = F.when(last("char_no").isNull() | (F.col("breaks") > last("breaks")) | jump | back | gap, 1).otherwise(0)
    own = own.withColumn("opens", opens).withColumn("blank", F.col("place") - last("place") > 1).withColumn("line_no", F.sum("opens").over(page))
    piece = F.concat(F.when((F.col("opens") == 0) & F.col("blank"), " ").otherwise(""), F.col("ch"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_no", piece.alias("s")))), lambda x: x["s"]), "")
    lines = own.groupBy(*PAGE, "line_no").agg(text.alias("text"), F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"))
    style = ["font", "bold", "italic", "color"]
    counts = own.groupBy(*PAGE, "line_no", F.bround(F.col("font_pt") * 2, 0).alias("half"), *style).agg(F.count("*").alias("n"), F.min("char_no").alias("first"), F.min_by("font_pt", "char_no").alias("size_pt"))
    best = counts.withColumn("k", F.row_number().over(W.partitionBy(*PAGE, "line_no").orderBy(F.col("n").desc(), "first"))).where("k = 1")
    out = lines.join(best.select(*PAGE, "line_no", "size_pt", *style), [*PAGE, "line_no"])
    size = F.when(F.col("size_pt") > 0.5, F.col("size_pt")).otherwise(F.greatest(F.lit(4.0), (F.col("b") - F.col("t")) * 72 / dpi * 0.8))
    return out.select(*PAGE, "line_no", "text", "l", "t", "r", "b", size.alias("size_pt"), "bold", "italic", "color", F.nullif("font", F.lit("")).alias("font"))
