"""Spatial joins within a page: the page key is an equality of the join, the geometry a rest condition of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import overlap

PAGE = ["doc_id", "page_no"]


def _areas(rects: DataFrame) -> DataFrame:
    return rects.select(*PAGE, "block_no", *[F.col(c).alias(f"x{c}") for c in "ltrb"])


def _covered(tenths: int) -> Column:
    both = overlap(F.col("l"), F.col("r"), F.col("xl"), F.col("xr")) * overlap(F.col("t"), F.col("b"), F.col("xt"), F.col("xb"))
    return both * 10 > (F.col("r") - F.col("l")) * (F.col("b") - F.col("t")) * tenths


def assign_lines(lines: DataFrame, rects: DataFrame, tenths: int = 5) -> DataFrame:
    """(page, line, block_no): the first rectangle that covers more than the given tenths of a line."""
    return lines.join(_areas(rects), PAGE).where(_covered(tenths)).groupBy(*PAGE, "line_id").agg(F.min("block_no").alias("block_no"))


def covered_lines(lines: DataFrame, rects: DataFrame, tenths: int) -> DataFrame:
    a, x = lines.alias("a"), _areas(rects).alias("x")
    return a.join(x, (F.col("a.doc_id") == F.col("x.doc_id")) & (F.col("a.page_no") == F.col("x.page_no")) & _covered(tenths), "left_semi")


def flow_items(lines: DataFrame, tables: DataFrame, figures: DataFrame) -> DataFrame:
    """What is laid out: lines outside of tables (half covered) and figures (0.7 covered), and these themselves. One anti-join on the page key."""
    item = lambda df, no, kind: df.select(*PAGE, F.lit(kind).alias("item"), F.col(no).alias("item_no"), "l", "t", "r", "b")
    areas = _areas(tables).withColumn("tenths", F.lit(5)).unionByName(_areas(figures).withColumn("tenths", F.lit(7)))
    both = overlap(F.col("l"), F.col("r"), F.col("xl"), F.col("xr")) * overlap(F.col("t"), F.col("b"), F.col("xt"), F.col("xb"))
    covered = both * 10 > (F.col("r") - F.col("l")) * (F.col("b") - F.col("t")) * F.col("tenths")
    a, x = lines.alias("a"), areas.alias("x")
    rest = a.join(x, (F.col("a.doc_id") == F.col("x.doc_id")) & (F.col("a.page_no") == F.col("x.page_no")) & covered, "left_anti")
    return item(rest, "line_id", "line").unionByName(item(tables, "block_no", "table")).unionByName(item(figures, "block_no", "figure"))


def nearest_rect(lines: DataFrame, rects: DataFrame) -> DataFrame:
    """The rectangle of the page nearest to a line's centre (0 inside) by steps along both axes; the lowest number of equals."""
    cx, cy = (F.col("l") + F.col("r")) / 2, (F.col("t") + F.col("b")) / 2
    d = F.greatest(F.col("xl") - cx, cx - F.col("xr"), F.lit(0.0)) + F.greatest(F.col("xt") - cy, cy - F.col("xb"), F.lit(0.0))
    near = lines.join(_areas(rects), PAGE).select(*PAGE, "line_id", F.struct(d.alias("d"), "block_no").alias("x"))
    return near.groupBy(*PAGE, "line_id").agg(F.min("x").alias("x")).select(*PAGE, "line_id", F.col("x.block_no").alias("block_no"), F.col("x.d").alias("distance"))


def edges(rects: DataFrame, column: str = "l") -> DataFrame:
    return rects.groupBy(*PAGE).agg(F.array_sort(F.collect_set(column)).alias("edges"))


def grid_columns(lines: DataFrame, grid: DataFrame, slack: float = 4.0) -> DataFrame:
    """Of each line: the last edge not behind its left (as-of), the nearest edge to its right side, and the number of edges not behind its centre."""
    last = F.size(F.filter("edges", lambda e: e <= F.col("l") + slack))
    near = F.array_min(F.transform("edges", lambda e, i: F.struct(F.abs(e - F.col("r")).alias("d"), (i + 1).alias("i"))))["i"]
    inside = F.size(F.filter("edges", lambda e: e <= (F.col("l") + F.col("r")) / 2))
    return lines.join(grid, PAGE).select(*PAGE, "line_id", last.alias("asof_col"), near.alias("near_col"), inside.alias("bucket"))


def rules(rects: DataFrame) -> DataFrame:
    """The four sides of rectangles as rules: (page, rule, horizontal, pos, start, end)."""
    side = lambda n, h, p, a, b: F.struct(F.lit(n).alias("side"), F.lit(h).alias("horizontal"), F.col(p).alias("pos"), F.col(a).alias("start"), F.col(b).alias("end"))
    sides = F.explode(F.array(side(0, True, "t", "l", "r"), side(1, True, "b", "l", "r"), side(2, False, "l", "t", "b"), side(3, False, "r", "t", "b")))
    return rects.withColumn("s", sides).select(*PAGE, (F.col("block_no") * 4 + F.col("s.side")).alias("rule"), "s.horizontal", "s.pos", "s.start", "s.end")


def rule_intersections(found: DataFrame, tolerance: float = 6.0) -> DataFrame:
    h = found.where("horizontal").select(*PAGE, F.col("rule").alias("h_rule"), F.col("pos").alias("y"), F.col("start").alias("x0"), F.col("end").alias("x1"))
    v = found.where("not horizontal").select(*PAGE, F.col("rule").alias("v_rule"), F.col("pos").alias("x"), F.col("start").alias("y0"), F.col("end").alias("y1"))
    meets = (F.col("x") >= F.col("x0") - tolerance) & (F.col("x") <= F.col("x1") + tolerance) & (F.col("y") >= F.col("y0") - tolerance) & (F.col("y") <= F.col("y1") + tolerance)
    return h.join(v, PAGE).where(meets).select(*PAGE, "h_rule", "v_rule")


def gutters(lines: DataFrame) -> DataFrame:
    """Free intervals between the horizontally merged extents of a page's lines: gaps and islands over [l, r]."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*PAGE).orderBy("l", "r", "line_id")
    reach = F.max("r").over(w.rowsBetween(W.unboundedPreceding, -1))
    return lines.withColumn("reach", reach).where(F.col("l") > F.col("reach")).groupBy(*PAGE, F.col("reach").alias("gap_start")).agg(F.min("l").alias("gap_end"))
