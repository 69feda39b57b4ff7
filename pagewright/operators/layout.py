"""Ordered operators of a page as windows and ordered folds over its positioned lines and blocks.

All windows partition by page, so one exchange serves them; each order ends with a unique key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import upper_median
from ..functions.text import flow, trimmed

PAGE = ("doc_id", "page_no")
ORDER = ("t", "l", "line_id")


def _page(*order) -> W:
    return W.partitionBy(*PAGE).orderBy(*order)


def median_height(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*PAGE).agg(upper_median(F.col("b") - F.col("t")).alias("h_med"), F.count("*").alias("n_lines"))


def body_font_size(lines: DataFrame) -> DataFrame:
    """Half-point size with the most text on each page; of equals the one that comes first."""
    sizes = lines.where("size_pt is not null").withColumn("half_pt", F.bround(F.col("size_pt").cast("double") * 2, 0).cast("bigint"))
    by = sizes.groupBy(*PAGE, "half_pt").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("w"), F.min("line_id").alias("first"))
    return by.groupBy(*PAGE).agg(F.max_by("half_pt", F.struct(F.col("w"), (-F.col("first")).alias("f"))).alias("half_pt"), F.max("w").alias("weight"))


def size_anchors(lines: DataFrame) -> DataFrame:
    """Sizes snapped to the frequent ones of their page: by text, a half-point size is an anchor unless it is within 9 % of a kept one; a line within 9 % of its nearest anchor takes that.

    Which sizes are kept depends on those kept before, so this is a fold over the page's few sizes.
    """
    size = F.coalesce(F.col("size_pt").cast("double"), F.lit(11.0))
    own = lines.select(*PAGE, "line_id", size.alias("size"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    by = own.groupBy(*PAGE, (F.bround(F.col("size") * 2, 0) / 2).alias("half")).agg(F.sum("n").alias("w"), F.min("line_id").alias("first"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), "first", "half")))
    near = lambda a, s: F.abs(a - s) / a <= 0.09
    kept = F.aggregate(order, F.array().cast("array<double>"), lambda acc, x: F.when(F.exists(acc, lambda a: near(a, x["half"])), acc).otherwise(F.concat(acc, F.array(x["half"]))))
    pages = by.groupBy(*PAGE).agg(kept.alias("anchors"))
    best = F.array_min(F.transform("anchors", lambda a, i: F.struct(F.abs(a - F.col("size")).alias("d"), i.alias("i"), a.alias("a"))))["a"]
    return own.join(pages, list(PAGE)).select(*PAGE, "line_id", F.when(near(best, F.col("size")), best).otherwise(F.col("size")).alias("size"))


def bounding_box(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"))


def band_islands(lines: DataFrame) -> DataFrame:
    """Bands without the height tolerance: a line opens a band where it starts at or below all before it."""
    before = F.max("b").over(_page(*ORDER).rowsBetween(W.unboundedPreceding, -1))
    opened = lines.withColumn("opens", F.when(before.isNull() | (F.col("t") >= before), 1).otherwise(0))
    return opened.select(*PAGE, "line_id", F.sum("opens").over(_page(*ORDER)).alias("band"))


def band_fold(lines: DataFrame) -> DataFrame:
    """Bands with state: a line joins the open band if its top is above the band's bottom less 0.4 of the smaller height.

    The state (bottom and least height of the open band) depends on the band, so this is a fold over the page's sorted lines.
    """
    items = F.array_sort(F.collect_list(F.struct("t", "l", "line_id", "b")))
    init = F.struct(F.lit(0).alias("band"), F.lit(-1e18).alias("bottom"), F.lit(0.0).alias("min_h"), F.array().cast("array<struct<line_id:int,band:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        h = x["b"] - x["t"]
        least = F.least(h, F.when(acc["min_h"] > 0, acc["min_h"]).otherwise(h))
        joins = (acc["band"] > 0) & (x["t"] < acc["bottom"] - 0.4 * least)
        band = F.when(joins, acc["band"]).otherwise(acc["band"] + 1)
        return F.struct(
            band.alias("band"), F.when(joins, F.greatest(acc["bottom"], x["b"])).otherwise(x["b"]).alias("bottom"), F.when(joins, F.least(acc["min_h"], h)).otherwise(h).alias("min_h"),
            F.concat(acc["out"], F.array(F.struct(x["line_id"].cast("int").alias("line_id"), band.cast("int").alias("band")))).alias("out"),
        )

    folded = lines.groupBy(*PAGE).agg(items.alias("items")).select(*PAGE, F.explode(F.aggregate("items", init, step)["out"]).alias("x"))
    return folded.select(*PAGE, "x.line_id", "x.band")


def visual_lines(lines: DataFrame) -> DataFrame:
    """Segments of one visual line: a segment joins the latest line whose growing extent it overlaps by more than 0.55, else opens one."""
    items = F.array_sort(F.collect_list(F.struct("t", "l", "line_id", "b")))
    empty = F.array().cast("array<struct<t:double,b:double,ids:array<int>>>")

    def step(acc: Column, x: Column) -> Column:
        def over(v: Column) -> Column:
            shorter = F.least(v["b"] - v["t"], x["b"] - x["t"])
            return (shorter > 0) & (F.least(v["b"], x["b"]) - F.greatest(v["t"], x["t"]) > 0.55 * shorter)

        hit = F.array_max(F.transform(acc, lambda v, i: F.when(over(v), i).otherwise(F.lit(-1))))
        hit = F.coalesce(hit, F.lit(-1))
        mine = F.array(x["line_id"].cast("int"))
        grown = F.transform(acc, lambda v, i: F.when(i == hit, F.struct(F.least(v["t"], x["t"]).alias("t"), F.greatest(v["b"], x["b"]).alias("b"), F.concat(v["ids"], mine).alias("ids"))).otherwise(v))
        return F.when(hit >= 0, grown).otherwise(F.concat(acc, F.array(F.struct(x["t"].alias("t"), x["b"].alias("b"), mine.alias("ids")))))

    folded = lines.groupBy(*PAGE).agg(items.alias("items")).select(*PAGE, F.posexplode(F.array_sort(F.aggregate("items", empty, step))).alias("vline", "v"))
    return folded.select(*PAGE, (F.col("vline") + 1).alias("vline_id"), F.explode("v.ids").alias("line_id"))


def cluster_first(values: Column, tolerance: float) -> Column:
    """Sorted distinct values, without those within tolerance behind the last kept one. For sorted arrays; greedy, so a fold."""
    empty = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(F.array_distinct(values)), empty, lambda acc, x: F.when((F.size(acc) > 0) & (x - F.try_element_at(acc, F.lit(-1)) <= tolerance), acc).otherwise(F.concat(acc, F.array(x))))


def cluster_mean(lines: DataFrame, column: str, tolerance: float) -> DataFrame:
    """Groups of values whose gaps don't exceed the tolerance, with their mean and number."""
    w = _page(column)
    flagged = lines.select(*PAGE, column).distinct().withColumn("opens", F.when(F.col(column) - F.lag(column).over(w) <= tolerance, 0).otherwise(1))
    groups = flagged.withColumn("grp", F.sum("opens").over(w))
    return groups.groupBy(*PAGE, "grp").agg((F.sum(column) / F.count("*")).alias("center"), F.count("*").alias("n"))


def line_gaps(lines: DataFrame) -> DataFrame:
    w = _page(*ORDER)
    return lines.select(*PAGE, "line_id", (F.col("t") - F.lag("b").over(w)).alias("gap"), (F.col("t") - F.lag("t").over(w)).alias("step"))


def line_spacing(lines: DataFrame) -> DataFrame:
    """Median step between tops, 1.2 heights on a page of one line; median gap with 0.3 of the median height as fallback."""
    gaps = lines.select(*PAGE, (F.col("b") - F.col("t")).alias("h"), (F.col("t") - F.lag("t").over(_page(*ORDER))).alias("step"), (F.col("t") - F.lag("b").over(_page(*ORDER))).alias("gap"))
    agg = gaps.groupBy(*PAGE).agg(upper_median(F.col("step")).alias("s"), upper_median(F.col("gap")).alias("g"), upper_median(F.col("h")).alias("h"))
    return agg.select(*PAGE, F.coalesce("s", 1.2 * F.col("h")).alias("spacing"), F.coalesce("g", 0.3 * F.col("h")).alias("median_gap"))


def space_before(blocks: DataFrame) -> DataFrame:
    w = W.partitionBy(*PAGE, "section_no", "column_no").orderBy("block_no")
    return blocks.select(*PAGE, "block_no", F.coalesce(F.greatest(F.col("t") - F.lag("b").over(w), F.lit(0.0)), F.lit(0.0)).alias("space_before"))


def renumber(lines: DataFrame) -> DataFrame:
    return lines.select(*PAGE, "line_id", F.row_number().over(_page(*ORDER)).alias("new_id"))


def block_lines(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines of each block in the block's order.

    The estimate that chooses a broadcast knows neither the length of line_ids nor compression, and would send a row for each line through the driver; hence the merge.
    """
    own = blocks.select(*PAGE, "block_no", "kind", "list_marker", F.posexplode("line_ids").alias("pos", "line_id"))
    return own.hint("merge").join(lines, [*PAGE, "line_id"])


def block_lines_of_pages(lines: DataFrame, blocks: DataFrame, *more: Column) -> DataFrame:
    """Lines of each block, with more columns of the block, where all that follows is done within a page.

    Ids are compared as a rest condition within the page: as part of the key they would have both sides, which are partitioned by page, exchanged again, and the result once more.
    """
    own = blocks.select(*PAGE, "block_no", "kind", *more, F.posexplode("line_ids").alias("pos", "own_id"))
    return lines.hint("merge").join(own, list(PAGE)).where("line_id >= own_id and line_id <= own_id").drop("own_id")


def block_features(own: DataFrame, *more: str) -> DataFrame:
    """Of each block with lines (own, as of block_lines): rows, text, size of its longest line (the first of equals), bold by most letters; more are columns that are equal in a block."""
    n = F.length(F.coalesce("text", F.lit("")))
    agg = own.groupBy(*PAGE, "block_no", "kind", *more).agg(
        F.count("*").alias("rows"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n").alias("raw"),
        F.max_by(F.coalesce("size_pt", F.lit(11.0)), F.struct(n.alias("n"), (-F.col("pos")).alias("p"))).cast("double").alias("size"),
        (F.sum(F.when(F.col("bold"), n).otherwise(0)) * 2 > F.sum(n)).alias("bold"),
    )
    return agg.withColumn("text", flow(F.col("raw"))).drop("raw")


def heading_levels(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Which blocks are headings, and of which level 1 to 3: large ones, or bold ones of one short line; none where most blocks would be.

    Looked for among paragraphs, given headings and ordered list items of one line; the body size is that of most letters of the page's blocks.
    """
    page, size = W.partitionBy(*PAGE), W.partitionBy(*PAGE, "half_pt")
    own = block_lines_of_pages(lines, blocks.where("kind not in ('Table', 'Figure')"), F.coalesce("ordered_list", F.lit(False)).alias("ordered"))
    own = own.withColumn("half_pt", F.bround(F.coalesce("size_pt", F.lit(11.0)).cast("double") * 2, 0).cast("bigint"))
    own = own.withColumn("w", F.sum(F.length(F.coalesce("text", F.lit("")))).over(size)).withColumn("first", F.min("line_id").over(size))
    own = own.withColumn("body", F.max_by("half_pt", F.struct(F.col("w"), (-F.col("first")).alias("f"))).over(page) / 2)
    own = block_features(own, "ordered", "body").where("block_no is not null and (kind in ('Paragraph', 'Heading') or (kind = 'ListItem' and ordered and rows = 1))")
    large = F.col("size") >= F.col("body") * 1.18
    short = F.col("bold") & (F.col("rows") == 1) & (F.col("size") >= F.col("body") * 0.95) & (F.size(F.split("text", " ")) <= 12) & ~F.endswith(trimmed(F.col("text")), F.lit("."))
    fits = F.length("text").between(1, 160) & (F.col("rows") <= 3)
    own = own.withColumn("candidate", fits & (large | short) & ((F.col("kind") != "ListItem") | large | F.col("bold"))).withColumn("r", F.bround("size", 0))
    own = own.withColumn("n", F.count("*").over(page)).withColumn("k", F.count_if("candidate").over(page))
    found = own.where("candidate and not (n > 4 and k * 10 > n * 6)")
    above = F.size(F.collect_set(F.when(F.col("r") >= F.col("body") * 1.18, F.col("r"))).over(page))
    ranked = found.withColumn("rank", F.dense_rank().over(_page(F.col("r").desc()))).withColumn("above", above)
    level = F.when(F.col("size") < F.col("body") * 1.18, F.greatest(F.col("rank"), F.least(F.lit(3), F.col("above") + 1))).otherwise(F.col("rank"))
    return ranked.select(*PAGE, "block_no", F.least(F.lit(3), level).alias("level"))


def bold_majority(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Style of each block: bold where most of its letters are, the size of its longest line (the first of equals)."""
    own = block_lines(lines, blocks).withColumn("n", F.length(F.coalesce("text", F.lit(""))).cast("bigint"))
    agg = own.groupBy(*PAGE, "block_no").agg(
        F.sum("n").alias("letters"), F.sum(F.when(F.col("bold"), F.col("n")).otherwise(0)).alias("bold_letters"), F.max_by("size_pt", F.struct(F.col("n"), (-F.col("pos")).alias("p"))).cast("double").alias("size_pt")
    )
    return agg.select(*PAGE, "block_no", (F.col("bold_letters") * 2 > F.col("letters")).alias("bold"), "size_pt")


def align(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Alignment of each text block with its spreads: by the margins of its column for one line, else by the spread of left edges (but the first), right edges (but the last) and centres, in line heights."""
    column = W.partitionBy(*PAGE, "section_no", "column_no")
    cols = blocks.select(*PAGE, "block_no", "kind", "line_ids", F.min("l").over(column).alias("cl"), F.max("r").over(column).alias("cr"))
    own = cols.where("kind not in ('Table', 'Figure')").select(*PAGE, "block_no", "kind", "cl", "cr", F.posexplode("line_ids").alias("pos", "line_id")).join(lines, [*PAGE, "line_id"])
    agg = own.groupBy(*PAGE, "block_no", "kind", "cl", "cr").agg(F.array_sort(F.collect_list(F.struct("pos", "l", "r", "t", "b"))).alias("x"))
    n = F.size("x")
    values = lambda a, f: F.transform(a, lambda v: f(v))
    spread = lambda a: F.when(F.size(a) > 1, F.array_max(a) - F.array_min(a)).otherwise(0.0)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    lefts, rights = values(F.slice("x", 2, F.greatest(n - 1, F.lit(0))), lambda v: v["l"]), values(F.slice("x", 1, n - 1), lambda v: v["r"])
    agg = agg.select(
        *PAGE, "block_no", "kind", "cl", "cr", n.alias("n"), spread(lefts).alias("left_spread"), spread(rights).alias("right_spread"), spread(values(F.col("x"), lambda v: v["l"] + (v["r"] - v["l"]) / 2)).alias("center_spread"),
        mean(values(F.col("x"), lambda v: v["b"] - v["t"])).alias("h"), F.when(n > 1, mean(rights)).alias("right"), (F.col("x")[0]["l"] - F.col("cl")).alias("lm"), (F.col("cr") - F.col("x")[0]["r"]).alias("rm"), F.greatest(F.lit(1.0), F.col("cr") - F.col("cl")).alias("w"),
    )
    single = F.when((F.col("lm") > F.col("w") * 0.1) & (F.abs(F.col("lm") - F.col("rm")) < F.greatest(F.col("w") * 0.06, "h")), "Center").when((F.col("lm") > F.col("w") * 0.3) & (F.col("rm") < F.greatest(F.col("w") * 0.03, F.col("h") * 0.5)), "Right").otherwise("Left")
    several = (
        F.when((F.col("center_spread") < F.col("h") * 0.8) & (F.col("left_spread") > F.col("h") * 1.2), "Center")
        .when((F.col("right_spread") < F.col("h") * 0.5) & (F.col("left_spread") > F.col("h") * 1.5), "Right")
        .when((F.col("right_spread") < F.col("h") * 0.6) & (F.col("n") >= 3) & (F.col("right") > F.col("cr") - F.col("h") * 1.5), "Justify").otherwise("Left")
    )
    kind = F.when(F.col("kind") == "ListItem", "Left").when(F.col("n") == 1, single).otherwise(several)
    return agg.select(*PAGE, "block_no", "left_spread", "right_spread", "center_spread", kind.alias("align"))


def list_runs(blocks: DataFrame) -> DataFrame:
    """List items with the number of their run, and for ordered ones their place in the run of ordered items."""
    w = _page("block_no")
    key = F.concat(F.col("kind"), F.lit("/"), F.coalesce(F.col("ordered_list"), F.lit(False)).cast("string"))
    runs = blocks.withColumn("key", key).withColumn("opens", F.when(F.col("key") == F.lag("key").over(w), 0).otherwise(1)).withColumn("run", F.sum("opens").over(w))
    numbered = runs.withColumn("item_no", F.row_number().over(W.partitionBy(*PAGE, "run").orderBy("block_no")))
    return numbered.where("kind = 'ListItem'").select(*PAGE, "block_no", "run", "item_no", F.coalesce("ordered_list", F.lit(False)).alias("ordered"))


def section_groups(blocks: DataFrame) -> DataFrame:
    """Sections in groups: neighbours of one column merge, one of several columns stands alone."""
    sections = blocks.groupBy(*PAGE, "section_no").agg(F.max("column_no").alias("last_column"))
    w = _page("section_no")
    single = F.col("last_column") == 0
    opens = F.when(single & (F.lag("last_column").over(w) == 0), 0).otherwise(1)
    return sections.withColumn("opens", opens).select(*PAGE, "section_no", (F.col("last_column") + 1).alias("columns"), F.sum("opens").over(w).alias("grp"))


def ctc_decode(steps: DataFrame, key: str, order: str, symbol: str, blank: str) -> DataFrame:
    """Runs of equal symbols collapsed, blanks dropped: (key, text, runs)."""
    w = W.partitionBy(key).orderBy(order)
    kept = steps.withColumn("before", F.lag(symbol).over(w)).where((F.col("before").isNull() | (F.col("before") != F.col(symbol))) & (F.col(symbol) != blank))
    kept = kept.select(key, F.struct(F.col(order).alias("o"), F.substring(symbol, 1, 1).alias("s")).alias("x"))
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "").alias("text"), F.count("*").alias("runs"))
