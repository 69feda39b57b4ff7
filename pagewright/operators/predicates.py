"""Predicates and small joins over positioned lines, blocks and pages: all expressions, joined on the page key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G

PAGE = ["doc_id", "page_no"]


def _c(name: str) -> Column:
    return F.col(name)


def style_changes(lines: DataFrame) -> DataFrame:
    """Whether each line has the style of the one before it on the page (null for the first)."""
    w = W.partitionBy(*PAGE).orderBy("t", "l", "line_id")
    before = lambda c: F.lag(c).over(w)
    size, color = F.coalesce(_c("size_pt").cast("double"), F.lit(11.0)), F.coalesce("color", F.lit(0))
    rows = lines.select(*PAGE, "line_id", "t", "l", size.alias("size"), F.coalesce("bold", F.lit(False)).alias("bold"), F.coalesce("italic", F.lit(False)).alias("italic"), color.alias("color"))
    same = G.same_style(_c("size"), before("size"), _c("bold") == before("bold"), _c("italic") == before("italic"), _c("color"), before("color"), 0.16)
    return rows.select(*PAGE, "line_id", same.alias("same"))


def centered_lines(lines: DataFrame) -> DataFrame:
    """Lines centred in the content of their page."""
    page = W.partitionBy(*PAGE)
    rows = lines.select(*PAGE, "line_id", "l", "r", (_c("b") - _c("t")).alias("h"), F.min("l").over(page).alias("cl"), F.max("r").over(page).alias("cr"))
    return rows.where(G.centered(_c("l"), _c("r"), _c("h"), _c("cl"), _c("cr"))).select(*PAGE, "line_id")


def interior_gutters(gaps: DataFrame, region: DataFrame, least: Column) -> DataFrame:
    """Gaps (gap_start, gap_end) strictly inside the region (l, r) of their page, at least as wide as an expression over the region says."""
    inside = (_c("gap_start") > _c("l") + 1) & (_c("gap_end") < _c("r") - 1) & (_c("gap_end") - _c("gap_start") >= least)
    return gaps.join(region, PAGE).where(inside).select(*PAGE, "gap_start", "gap_end")


def figures_of_size(figures: DataFrame, pages: DataFrame) -> DataFrame:
    """Figures neither too small for a picture, nor slivers at the page's edge, nor the page itself. pages: width, height, dpi."""
    own = figures.join(pages.select(*PAGE, _c("width").cast("double").alias("pw"), _c("height").cast("double").alias("ph"), F.coalesce(_c("dpi").cast("double"), F.lit(96.0)).alias("dpi")), PAGE)
    w, h, cell = F.least("r", "pw") - F.greatest("l", F.lit(0.0)), F.least("b", "ph") - F.greatest("t", F.lit(0.0)), _c("dpi") / 50
    side, area = F.greatest(_c("dpi") * 0.2, F.least("pw", "ph") * 0.02), _c("pw") * _c("ph")
    edge = (_c("l") <= cell) | (_c("t") <= cell) | (_c("r") >= _c("pw") - cell) | (_c("b") >= _c("ph") - cell)
    keep = (w >= side) & (h >= side) & (w * h >= area * 0.002) & (w * h >= 20 * cell * cell) & ~(edge & (F.greatest(w / h, h / w) > 12)) & (w * h <= area * 0.85)
    return own.where(keep).select(*PAGE, "block_no")


def text_in_figures(lines: DataFrame, figures: DataFrame) -> DataFrame:
    """(page, block_no, inside, share): lines that a figure covers by more than 0.7, and their share of its area."""
    x = figures.select(*PAGE, "block_no", *[_c(c).alias(f"x{c}") for c in "ltrb"])
    both = G.overlap(_c("l"), _c("r"), _c("xl"), _c("xr")) * G.overlap(_c("t"), _c("b"), _c("xt"), _c("xb"))
    area = (_c("r") - _c("l")) * (_c("b") - _c("t"))
    hits = lines.join(x, PAGE).where(both * 10 > area * 7).select(*PAGE, "block_no", area.alias("area"))
    sums = hits.groupBy(*PAGE, "block_no").agg(F.count("*").alias("inside"), F.sum("area").alias("area"))
    own = x.withColumn("whole", (_c("xr") - _c("xl")) * (_c("xb") - _c("xt"))).join(sums, [*PAGE, "block_no"], "left")
    return own.select(*PAGE, "block_no", F.coalesce("inside", F.lit(0)).alias("inside"), F.round(F.coalesce(_c("area"), F.lit(0.0)) / _c("whole"), 6).alias("share"))


def pictures(lines: DataFrame, figures: DataFrame) -> DataFrame:
    """Figures that don't frame text: at most six lines inside, on at most a quarter of the area."""
    return text_in_figures(lines, figures).where("inside <= 6 and share <= 0.25").select(*PAGE, "block_no")


def remapped_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Line boxes of the unrotated page in its rotated and cropped image; lines less than half inside of it are dropped. Character extents (extents) stay only where they run along x."""
    p = pages.select(*PAGE, F.pmod(F.coalesce("rotation", F.lit(0)), F.lit(360)).alias("rot"), "crop", _c("width").cast("double").alias("ow"), _c("height").cast("double").alias("oh"))
    own = lines.join(p, PAGE)
    turn = lambda a, b, c, d: F.when(_c("rot") == 90, a).when(_c("rot") == 180, b).when(_c("rot") == 270, c).otherwise(d)
    w, h = F.when(_c("rot").isin(90, 270), _c("oh")).otherwise(_c("ow")), F.when(_c("rot").isin(90, 270), _c("ow")).otherwise(_c("oh"))
    part = lambda f, size, none: F.coalesce(F.bround(_c(f"crop.{f}").cast("double") * size, 0), none)
    zero = F.lit(0.0)
    own = own.select(
        *PAGE, "line_id", "rot", _c("crop").isNotNull().alias("cropped"), part("x", w, zero).alias("cx"), part("y", h, zero).alias("cy"), part("w", w, w).alias("cw"), part("h", h, h).alias("ch"),
        turn(_c("oh") - _c("b"), _c("ow") - _c("r"), _c("t"), _c("l")).alias("l0"), turn(_c("l"), _c("oh") - _c("b"), _c("ow") - _c("r"), _c("t")).alias("t0"),
        turn(_c("oh") - _c("t"), _c("ow") - _c("l"), _c("b"), _c("r")).alias("r0"), turn(_c("r"), _c("oh") - _c("t"), _c("ow") - _c("l"), _c("b")).alias("b0"),
    )
    own = own.select(*PAGE, "line_id", "rot", "cw", "ch", (_c("l0") - _c("cx")).alias("l"), (_c("t0") - _c("cy")).alias("t"), (_c("r0") - _c("cx")).alias("r"), (_c("b0") - _c("cy")).alias("b"))
    area = (_c("r") - _c("l")) * (_c("b") - _c("t"))
    both = G.overlap(_c("l"), _c("r"), zero, _c("cw")) * G.overlap(_c("t"), _c("b"), zero, _c("ch"))
    return own.where((area > 0) & (both * 2 >= area)).select(*PAGE, "line_id", "l", "t", "r", "b", (_c("rot") == 0).alias("extents"))


def positioned_lines(lines: DataFrame, blocks: DataFrame, bullets: DataFrame | None = None) -> DataFrame:
    """Lines outside of figures and tables, and a "•" without a line_id for each drawn bullet (page, box), with their places in (top, left) order."""
    tables = blocks.where("kind = 'Table'").select(*PAGE, F.explode("line_ids").alias("line_id")).distinct()
    own = lines.where("not coalesce(in_figure, false)").join(tables, [*PAGE, "line_id"], "left_anti").select(*PAGE, "line_id", "text", "l", "t")
    if bullets is not None:
        own = own.unionByName(bullets.select(*PAGE, F.lit(None).cast("int").alias("line_id"), F.lit("•").alias("text"), "l", "t"))
    return own.select(*PAGE, "line_id", "text", F.row_number().over(W.partitionBy(*PAGE).orderBy("t", "l", "line_id")).alias("place"))


def block_text_lines(blocks: DataFrame) -> DataFrame:
    """Every line of each block, of tables as of others: (page, block_no, pos, line_id)."""
    own = lambda df: df.select(*PAGE, "block_no", F.posexplode("line_ids").alias("pos", "line_id"))
    return own(blocks.where("kind = 'Table'")).unionByName(own(blocks.where("kind != 'Table'")))


def free_rules(rules: DataFrame, lines: DataFrame, shrink: float = 2.0) -> DataFrame:
    """Rules without those that lie, by more than 0.6 of their length, in a text's box less a margin: strokes of letters."""
    along = F.when(_c("horizontal"), G.overlap(_c("start"), _c("end"), _c("l") + shrink, _c("r") - shrink)).otherwise(G.overlap(_c("start"), _c("end"), _c("t") + shrink, _c("b") - shrink))
    across = F.when(_c("horizontal"), (_c("pos") > _c("t") + shrink) & (_c("pos") < _c("b") - shrink)).otherwise((_c("pos") > _c("l") + shrink) & (_c("pos") < _c("r") - shrink))
    a, x = rules.alias("a"), lines.select(_c("doc_id").alias("xd"), _c("page_no").alias("xp"), "l", "t", "r", "b").alias("x")
    return a.join(x, (F.col("a.doc_id") == F.col("xd")) & (F.col("a.page_no") == F.col("xp")) & across & (along > (_c("end") - _c("start")) * 0.6), "left_anti")


def alone_on_the_left(lines: DataFrame, reach: float = 1.5) -> DataFrame:
    """Lines with nothing in the window on their left where a drawn bullet would stand: reach heights wide."""
    a = lines.alias("a")
    x = lines.select(_c("doc_id").alias("xd"), _c("page_no").alias("xp"), _c("line_id").alias("xi"), *[_c(c).alias(f"x{c}") for c in "ltrb"])
    h = F.col("a.b") - F.col("a.t")
    touches = (_c("xr") > F.col("a.l") - h * reach) & (_c("xl") < F.col("a.l")) & (_c("xb") > F.col("a.t")) & (_c("xt") < F.col("a.b"))
    return a.join(x, (F.col("a.doc_id") == _c("xd")) & (F.col("a.page_no") == _c("xp")) & (F.col("a.line_id") != _c("xi")) & touches, "left_anti").select(*PAGE, "line_id")


def table_rows(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Row edges of tables whose rows are lines: half way between one line's bottom and the next one's top. (page, block_no, row, t, b, l, r)"""
    own = tables.select(*PAGE, "block_no", _c("l").alias("xl"), _c("t").alias("xt"), _c("r").alias("xr"), _c("b").alias("xb"), F.explode("line_ids").alias("line_id")).join(lines.select(*PAGE, "line_id", "t", "b"), [*PAGE, "line_id"])
    w = W.partitionBy(*PAGE, "block_no").orderBy("t", "line_id")
    top, bottom = (F.lag("b").over(w) + _c("t")) / 2, (_c("b") + F.lead("t").over(w)) / 2
    return own.select(*PAGE, "block_no", (F.row_number().over(w) - 1).alias("row"), F.coalesce(top, "xt").alias("t"), F.coalesce(bottom, "xb").alias("b"), _c("xl").alias("l"), _c("xr").alias("r"))


def cells_of_lines(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """The cell that holds a line's centre (the first of several), else the nearest one by steps along both axes: (page, line_id, block_no, row, distance)."""
    x = cells.select(*PAGE, "block_no", "row", *[_c(c).alias(f"x{c}") for c in "ltrb"])
    cx, cy, zero = (_c("l") + _c("r")) / 2, (_c("t") + _c("b")) / 2, F.lit(0.0)
    d = F.greatest(_c("xl") - cx, cx - _c("xr"), zero) + F.greatest(_c("xt") - cy, cy - _c("xb"), zero)
    inside = (cx >= _c("xl")) & (cx < _c("xr")) & (cy >= _c("xt")) & (cy < _c("xb"))
    best = F.min(F.struct(F.when(inside, 0).otherwise(1).alias("out"), F.when(inside, 0.0).otherwise(d).alias("d"), "block_no", "row")).alias("x")
    return lines.join(x, PAGE).groupBy(*PAGE, "line_id").agg(best).select(*PAGE, "line_id", "x.block_no", "x.row", F.col("x.d").alias("distance"))


def table_styles(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """Styles of the lines in a table's cells (page, block_no, row, col, line_id): sizes within 30 % of the dominant one are it; bold are the lines of rows that are bold by 60 %, and, in tables of more than two rows, of columns that are so without these rows."""
    own = cells.select(*PAGE, "block_no", "row", "col", "line_id").join(lines, [*PAGE, "line_id"])
    own = own.select(*PAGE, "block_no", "row", "col", "line_id", F.coalesce(_c("size_pt").cast("double"), F.lit(11.0)).alias("size"), F.coalesce("bold", F.lit(False)).cast("int").alias("heavy"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    half = own.groupBy(*PAGE, "block_no", F.bround(_c("size") * 2, 0).alias("half")).agg(F.sum("n").alias("n"), F.min(F.struct("row", "col", "line_id")).alias("first"))
    by_weight = W.partitionBy(*PAGE, "block_no").orderBy(_c("n").desc(), "first")
    mode = half.withColumn("k", F.row_number().over(by_weight)).where("k = 1").select(*PAGE, "block_no", (_c("half") / 2).alias("mode"))
    rows = own.withColumn("rows", F.max("row").over(W.partitionBy(*PAGE, "block_no")) + 1)
    in_row = W.partitionBy(*PAGE, "block_no", "row")
    rows = rows.withColumn("by_row", F.sum("heavy").over(in_row) * 10 >= F.count("*").over(in_row) * 6)
    in_col, rest = W.partitionBy(*PAGE, "block_no", "col"), F.when(~_c("by_row"), 1).otherwise(0)
    rows = rows.withColumn("by_col", (_c("rows") > 2) & (F.sum(rest).over(in_col) > 0) & (F.sum(rest * _c("heavy")).over(in_col) * 10 >= F.sum(rest).over(in_col) * 6))
    snapped = F.when(F.abs(_c("size") - _c("mode")) / _c("mode") <= 0.3, _c("mode")).otherwise(_c("size"))
    return rows.join(mode, [*PAGE, "block_no"]).select(*PAGE, "block_no", "line_id", snapped.alias("size"), (_c("by_row") | _c("by_col")).alias("bold"))


def crop_within(outer: Column, x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A crop in pixels of the image that an outer crop (fractions; null: all) gives, as fractions of the whole."""
    part = lambda f, none: F.coalesce(outer[f].cast("double"), F.lit(none))
    ow, oh = part("w", 1.0), part("h", 1.0)
    return F.struct((part("x", 0.0) + x / width * ow).alias("x"), (part("y", 0.0) + y / height * oh).alias("y"), (w / width * ow).alias("w"), (h / height * oh).alias("h"))


def cell_align(l: Column, r: Column, cell_l: Column, cell_r: Column) -> Column:  # noqa: E741
    """Of a cell's text: centred by nearly equal margins that aren't small, right by a right margin under 0.35 of the left one."""
    left, right, w = l - cell_l, cell_r - r, cell_r - cell_l
    return F.when((F.abs(left - right) < w * 0.12) & (left > w * 0.08), "Center").when(right < left * 0.35, "Right").otherwise("Left")


def bold_by_median(rows: DataFrame, ratio: str, length: str) -> DataFrame:
    """Lines whose stroke ratio is over 1.25 times the upper median of the page's lines of four characters or more."""
    med = rows.where(_c(length) >= 4).groupBy(*PAGE).agg(G.upper_median(_c(ratio)).alias("med"))
    return rows.join(med, PAGE).select(*PAGE, "line_id", (_c(ratio) > _c("med") * 1.25).alias("bold"))


def aspect_batches(lines: DataFrame, size: int = 8) -> DataFrame:
    """Lines of a page in batches of similar aspect ratio, so that a batch wastes little on padding."""
    aspect = (_c("r") - _c("l")) / (_c("b") - _c("t"))
    rank = F.row_number().over(W.partitionBy(*PAGE).orderBy("aspect", "line_id"))
    return lines.where("b > t").select(*PAGE, "line_id", aspect.alias("aspect")).withColumn("batch", F.floor((rank - 1) / size).cast("int"))


def first_boxes(lines: DataFrame, most: int = 3000) -> DataFrame:
    """Boxes of a page in (top, left) order with their places; the limit for each page is the detector's own."""
    place = F.row_number().over(W.partitionBy(*PAGE).orderBy("t", "l", "line_id"))
    return lines.select(*PAGE, "line_id", place.alias("place")).where(_c("place") <= most)


def segment_text(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """Text of each row of segments (page, row, line_id), left to right: a tab where the gap exceeds 2.5 heights of the row, else a blank."""
    own = rows.join(lines.select(*PAGE, "line_id", "text", "l", "t", "r", "b"), [*PAGE, "line_id"])
    row = W.partitionBy(*PAGE, "row")
    order = row.orderBy("l", "line_id")
    own = own.select(*PAGE, "row", "line_id", "l", "text", (F.max("b").over(row) - F.min("t").over(row)).alias("h"), (_c("l") - F.lag("r").over(order)).alias("gap"))
    sep = F.when(_c("gap").isNull(), "").when(_c("gap") > _c("h") * 2.5, "\t").otherwise(" ")
    piece = F.struct("l", "line_id", F.concat(sep, F.coalesce("text", F.lit(""))).alias("s"))
    return own.groupBy(*PAGE, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["s"]), "").alias("text"))


def shared_gaps(gaps: DataFrame) -> DataFrame:
    """Pairwise overlaps of the gap lists of neighbouring bands: (page, band, a, b), band being the upper one. gaps: page, band, gap_start, gap_end."""
    nxt = gaps.select(*PAGE, (_c("band") - 1).alias("band"), _c("gap_start").alias("s"), _c("gap_end").alias("e"))
    a, b = F.greatest("gap_start", "s"), F.least("gap_end", "e")
    return gaps.join(nxt, [*PAGE, "band"]).where(b > a).select(*PAGE, "band", a.alias("a"), b.alias("b"))


def band_gaps(lines: DataFrame, banded: DataFrame) -> DataFrame:
    """What of the page's content no line of a band covers, edges included: (page, band, gap_start, gap_end)."""
    page = W.partitionBy(*PAGE)
    own = lines.select(*PAGE, "line_id", "l", "r", F.min("l").over(page).alias("lo"), F.max("r").over(page).alias("hi")).join(banded, [*PAGE, "line_id"])
    w = W.partitionBy(*PAGE, "band").orderBy("l", "r", "line_id")
    reach = F.coalesce(F.max("r").over(w.rowsBetween(W.unboundedPreceding, -1)), "lo")
    inner = own.withColumn("reach", reach).where(_c("l") > _c("reach")).select(*PAGE, "band", _c("reach").alias("gap_start"), _c("l").alias("gap_end"))
    last = own.groupBy(*PAGE, "band").agg(F.max("r").alias("gap_start"), F.max("hi").alias("gap_end")).where("gap_end > gap_start")
    return inner.unionByName(last)


def covering_cell(cells: DataFrame, places: DataFrame, key: list[str]) -> DataFrame:
    """For each place (row, col) the first cell whose spans cover it: cells have row, col, row_span, col_span."""
    c = cells.select(*key, _c("row").alias("r0"), _c("col").alias("c0"), (_c("row") + _c("row_span")).alias("r1"), (_c("col") + _c("col_span")).alias("c1"))
    hit = (_c("row") >= _c("r0")) & (_c("row") < _c("r1")) & (_c("col") >= _c("c0")) & (_c("col") < _c("c1"))
    return places.join(c, key).where(hit).groupBy(*key, "row", "col").agg(F.min(F.struct("r0", "c0")).alias("x")).select(*key, "row", "col", "x.r0", "x.c0")
