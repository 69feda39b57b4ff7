"""Queries over the reference's own operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import edits, export, joins, layout
from ..operators.ranking import ranked
from ..sources import tables as S

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def _kind(spark, d, kind: str) -> DataFrame:
    return S.blocks(spark, d).where(F.col("kind") == kind)


@_query
def list_marker_classify(spark, d):
    rows = S.lines(spark, d).where(F.col("text").rlike("\\S")).select("doc_id", T.marker_kind(F.col("text")).alias("marker_kind"), T.ordered_marker(F.col("text")).alias("m"))
    return rows.groupBy("doc_id", "marker_kind").agg(F.count("*").alias("n"), F.count_distinct("m").alias("markers"))


@_query
def page_median_height(spark, d):
    return layout.median_height(S.lines(spark, d))


@_query
def body_font_size(spark, d):
    return layout.body_font_size(S.lines(spark, d))


@_query
def bbox_union(spark, d):
    return layout.bounding_box(S.lines(spark, d), "doc_id", "page_no")


@_query
def mean_confidence(spark, d):
    c = F.col("confidence").cast("double")
    k = F.bround(F.when(c > 1, c * 10).otherwise(c * 1000), 0).cast("bigint")
    agg = S.lines(spark, d).groupBy("doc_id", "page_no").agg(F.sum(k).alias("thousandths"), F.count("confidence").alias("n"))
    return agg.select("doc_id", "page_no", "n", F.when(F.col("n") > 0, F.col("thousandths").cast("double") / F.col("n")).otherwise(0.0).alias("mean_thousandths"))


@_query
def confidence_filter(spark, d):
    """Lines with a text and a confidence of at least 0.5, numbered anew; confidences above 1 are on the 0-100 scale."""
    return layout.renumber(S.lines(spark, d).where("text rlike '\\\\S' and (confidence between 0.5 and 1 or confidence >= 50)"))


@_query
def uncertain_lines(spark, d):
    rows = S.lines(spark, d).where("not edited and (confidence < 0.75 or confidence > 1 and confidence < 75)")
    return rows.groupBy("doc_id").agg(F.count("*").alias("uncertain"))


@_query
def band_islands(spark, d):
    return layout.band_islands(S.lines(spark, d))


@_query
def band_fold(spark, d):
    return layout.band_fold(S.lines(spark, d))


@_query
def visual_lines(spark, d):
    return layout.visual_lines(S.lines(spark, d))


@_query
def line_gaps(spark, d):
    return layout.line_gaps(S.lines(spark, d))


@_query
def line_spacing(spark, d):
    return layout.line_spacing(S.lines(spark, d))


@_query
def space_before(spark, d):
    return layout.space_before(S.blocks(spark, d))


@_query
def renumber(spark, d):
    return layout.renumber(S.lines(spark, d))


@_query
def cluster_mean(spark, d):
    return layout.cluster_mean(S.lines(spark, d), "l", 8.0)


@_query
def cluster_first(spark, d):
    rows = S.lines(spark, d).groupBy("doc_id", "page_no").agg(F.collect_list("l").alias("v"))
    return rows.select("doc_id", "page_no", F.posexplode(layout.cluster_first(F.col("v"), 8.0)).alias("i", "edge"))


@_query
def gutters(spark, d):
    return joins.gutters(S.lines(spark, d))


@_query
def heading_levels(spark, d):
    return layout.heading_levels(S.lines(spark, d), S.blocks(spark, d))


@_query
def bold_majority(spark, d):
    return layout.bold_majority(S.lines(spark, d), S.blocks(spark, d))


@_query
def align_detect(spark, d):
    return layout.align(S.lines(spark, d), S.blocks(spark, d))


@_query
def numbered_runs(spark, d):
    return layout.list_runs(S.blocks(spark, d))


@_query
def section_groups(spark, d):
    return layout.section_groups(S.blocks(spark, d))


@_query
def table_line_assign(spark, d):
    return joins.assign_lines(S.lines(spark, d), _kind(spark, d, "Table"))


@_query
def figure_lines(spark, d):
    return joins.covered_lines(S.lines(spark, d), _kind(spark, d, "Figure"), 7).select("doc_id", "page_no", "line_id")


@_query
def flow_items(spark, d):
    return joins.flow_items(S.lines(spark, d), _kind(spark, d, "Table"), _kind(spark, d, "Figure"))


@_query
def nearest_table(spark, d):
    return joins.nearest_rect(S.lines(spark, d), _kind(spark, d, "Table"))


@_query
def grid_columns(spark, d):
    return joins.grid_columns(S.lines(spark, d), joins.edges(S.blocks(spark, d)))


@_query
def rule_intersections(spark, d):
    return joins.rule_intersections(joins.rules(S.blocks(spark, d).where("kind in ('Table', 'Figure')")))


def _texts(spark, d) -> DataFrame:
    return export.block_text(layout.block_lines(S.lines(spark, d), S.blocks(spark, d)))


@_query
def flow_text(spark, d):
    own = layout.block_lines(S.lines(spark, d), S.blocks(spark, d).where("kind in ('Paragraph', 'Heading', 'ListItem')"))
    return export.block_text(own).select("doc_id", "page_no", "block_no", F.col("flow").alias("text"))


@_query
def page_plain_text(spark, d):
    return export.page_text(_texts(spark, d))


@_query
def document_text_parts(spark, d):
    return export.document_text(export.page_text(_texts(spark, d)))


@_query
def copied_text(spark, d):
    """Text of a file's pages for the clipboard, as parts in order."""
    return export.page_text(_texts(spark, d)).select("doc_id", "page_no", F.concat("text", F.lit("\n")).alias("part"))


@_query
def html_blocks(spark, d):
    levels = S.blocks(spark, d).select("doc_id", "page_no", "block_no", "heading_level")
    return export.block_html(_texts(spark, d).join(levels, ["doc_id", "page_no", "block_no"]))


@_query
def layout_dump(spark, d):
    """Listing of pages, sections and blocks, with whole texts. section_no and block_no are -1 in rows of a page or section. Styles and tables' sizes are not in layout_blocks."""
    key = ["doc_id", "page_no"]
    own = S.blocks(spark, d)
    n = lambda c: F.bround(c.cast("double"), 0).cast("bigint").cast("string")
    empty = F.lit("")
    level = F.when(F.col("kind") == "Heading", F.coalesce(F.col("heading_level").cast("string"), empty)).otherwise(empty)
    head = F.concat(F.lit("["), "kind", level, F.lit(" c"), F.coalesce(F.col("column_no").cast("string"), empty), F.lit(" "), F.coalesce("align", empty), F.lit(" @"), n(F.col("l")), F.lit(","), n(F.col("t")), F.lit(" "), n(F.col("r") - F.col("l")), F.lit("x"), n(F.col("b") - F.col("t")), F.lit("]"))
    rows = own.select(*key, "section_no", "block_no", "kind", head.alias("head")).join(_texts(spark, d).select(*key, "block_no", "text", "flow"), [*key, "block_no"], "left")
    shown = F.when((F.col("kind") == "Figure") | F.col("text").isNull(), F.col("head")).when(F.col("kind") == "Table", F.concat("head", F.lit("\n"), "text")).otherwise(F.concat("head", F.lit(" "), "flow"))
    blocks = rows.select(*key, "section_no", "block_no", shown.alias("line"))
    section = own.groupBy(*key, "section_no").agg((F.max("column_no") + 1).alias("cols"), F.min("t").alias("t"), F.max("b").alias("b"), F.count("*").alias("n"))
    sections = section.select(*key, "section_no", F.lit(-1).alias("block_no"), F.concat(F.lit("--- section cols="), F.col("cols").cast("string"), F.lit(" y="), n(F.col("t")), F.lit("-"), n(F.col("b"))).alias("line"))
    counts = section.groupBy(*key).agg(F.sum("n").alias("blocks"), F.count("*").alias("sections"))
    pages = S.pages(spark, d).join(counts, key, "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), empty)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    title = F.concat(F.lit("=== "), text("page_label"), F.lit("  "), text("width"), F.lit("x"), text("height"), F.lit(" @"), n(F.coalesce(F.col("dpi").cast("double"), F.lit(96.0))), F.lit("dpi  blocks="), zero("blocks"), F.lit(" sections="), zero("sections"))
    return pages.select(*key, F.lit(-1).alias("section_no"), F.lit(-1).alias("block_no"), title.alias("line")).unionByName(sections).unionByName(blocks)


@_query
def table_to_text(spark, d):
    """Table blocks as text: their lines are rows, cells end at tabs and double blanks."""
    own = layout.block_lines(S.lines(spark, d), _kind(spark, d, "Table")).where("text is not null")
    return export.grid_text(export.split_cells(own))


@_query
def parse_numbers(spark, d):
    """Cells of table rows in the lines of Table blocks, split at tabs and double blanks."""
    own = layout.block_lines(S.lines(spark, d), _kind(spark, d, "Table")).where("text is not null")
    cells = own.select("doc_id", "page_no", "line_id", F.posexplode(F.split("text", "\\t| {2,}")).alias("cell", "c"))
    value, fmt = T.number_cell(F.col("c"))
    return cells.select("doc_id", "page_no", "line_id", "cell", value.cast("double").alias("value"), fmt.alias("format_id"))


@_query
def column_names(spark, d):
    i = S.read(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("i"))
    name = T.column_name(F.col("i"))
    return i.select("i", name.alias("name"), T.column_index(name).alias("back"), T.cell_reference(F.col("i"), F.col("i") + 1).alias("ref"))


@_query
def natural_sort_rank(spark, d):
    docs = S.read(spark, d, "ocr_docs").where("doc_name is not null").select("doc_id", F.coalesce("station", F.lit("")).alias("station"), T.natural_key(F.col("doc_name")).alias("key"))
    return ranked(docs, ["station"], ["key", "doc_id"], "place").select("doc_id", "station", "place")


@_query
def file_kinds(spark, d):
    docs = S.read(spark, d, "ocr_docs")
    return docs.select("doc_id", S.extension(F.col("doc_name")).alias("ext"), S.file_kind(F.col("doc_name")).alias("file_kind"))


@_query
def image_sequence_pages(spark, d):
    pages = S.pages(spark, d).where("image_path is not null").select(F.col("image_path").alias("path")).distinct()
    return S.image_sequences(pages)


@_query
def effective_dpi(spark, d):
    docs = S.read(spark, d, "ocr_docs").select("doc_id", "kind").distinct()
    pages = S.pages(spark, d).join(docs, "doc_id")
    dpi = G.effective_dpi(F.col("kind"), F.col("width"), F.col("height"), F.col("dpi"), F.col("crop").isNotNull())
    return pages.select("doc_id", "page_no", F.round(dpi, 6).alias("dpi"))


@_query
def page_units(spark, d):
    """Boxes of blocks in points, twips and English metric units."""
    pages = S.pages(spark, d).select("doc_id", "page_no", F.coalesce(F.col("dpi").cast("double"), F.lit(96.0)).alias("dpi"))
    own = S.blocks(spark, d).join(pages, ["doc_id", "page_no"])
    w, dpi = F.col("r") - F.col("l"), F.col("dpi")
    return own.select("doc_id", "page_no", "block_no", F.round(G.px_to_pt(w, dpi), 6).alias("width_pt"), G.twips(w, dpi).alias("width_twips"), G.emu(w, dpi).alias("width_emu"))


@_query
def line_colors(spark, d):
    c = F.col("color").cast("int")
    rows = S.lines(spark, d).where("color is not null")
    return rows.groupBy(G.css_color(c).alias("css"), G.color_distance(c, F.lit(0)).alias("from_black")).agg(F.count("*").alias("n"))


@_query
def language_lookup(spark, d):
    """Model of each export option by code, name, culture or display name; English where none has it."""
    models = S.read(spark, d, "language_models")
    names = models.select("lang", "rec_model", F.explode(F.array("lang", "ocr_language", "display_name", "culture")).alias("label")).withColumn("label", F.lower("label")).distinct()
    opts = S.read(spark, d, "export_options").select("doc_id", "ocr_language").distinct().withColumn("label", F.lower(F.trim("ocr_language")))
    joined = opts.join(names, "label", "left")
    return joined.select("doc_id", "ocr_language", F.coalesce("lang", F.lit("en")).alias("lang"), F.col("lang").isNull().alias("fallback"))


@_query
def missing_models(spark, d):
    models = S.read(spark, d, "language_models")
    required = models.select(F.explode(F.array("rec_model", "dictionary", F.lit("det\\det.onnx"), F.lit("cls\\cls.onnx"))).alias("path"))
    used = S.read(spark, d, "history_entries").select(F.lower(F.trim("ocr_language")).alias("lang")).distinct()
    present = models.join(used, "lang", "left_semi").select(F.explode(F.array("rec_model", "dictionary")).alias("path")).where("path is not null")
    return edits.missing_files(required, present)


@_query
def unique_paths(spark, d):
    rows = S.once(S.read(spark, d, "history_entries").where("output_path is not null"), ["entry_id"], ["logged_at"])
    return edits.unique_names(rows, "output_path", "entry_id").select("entry_id", "unique_name")


@_query
def history_top500(spark, d):
    rows = S.once(S.read(spark, d, "history_entries").where("happened_at is not null"), ["entry_id"], ["logged_at"])
    return edits.newest_history(rows).select("entry_id", "doc_id")


@_query
def batch_totals(spark, d):
    return edits.batch_totals(S.read(spark, d, "history_entries"))


@_query
def edit_overlay(spark, d):
    """Lines flagged as edited get a text of their own, as an edit would bring it."""
    rows = S.lines(spark, d)
    changes = rows.where("edited and text is not null").select("doc_id", "page_no", "line_id", F.concat(F.lit("> "), "text").alias("text"))
    out = edits.overlay_text(rows, changes)
    return out.select("doc_id", "page_no", "line_id", "text", F.bround(F.col("confidence") * 1000, 0).cast("bigint").alias("thousandths"), "edited")


@_query
def stale_results(spark, d):
    """Page rows of the latest load keep their version; earlier loads of another version are stale."""
    pages = S.once(S.read(spark, d, "doc_pages"), ["doc_id", "page_no"], ["loaded_at"])
    results = S.read(spark, d, "doc_pages").select("doc_id", "page_no", "page_version").distinct()
    return edits.current_results(pages, results).select("doc_id", "page_no", "page_version")


@_query
def remove_pages(spark, d):
    """Rotated pages are taken out; the others move up."""
    pages = S.pages(spark, d)
    return edits.remove_pages(pages, pages.where("rotation = 180"))


@_query
def pages_to_process(spark, d):
    pages = S.pages(spark, d)
    return edits.pages_to_process(pages, S.read(spark, d, "text_lines").select("doc_id", "page_no").distinct()).select("doc_id", "page_no")


@_query
def text_layer_pages(spark, d):
    """Visible characters of each page, and whether a text layer of at least 16 of them makes recognition needless."""
    n = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x00-\\x20\\uFFFD\\uFFFE]", ""))
    chars = S.lines(spark, d).groupBy("doc_id", "page_no").agg(F.sum(n).cast("bigint").alias("visible"))
    return chars.select("doc_id", "page_no", "visible", (F.col("visible") >= 16).alias("enough"))


@_query
def ctc_decode(spark, d):
    events = S.read(spark, d, "events").where("event_type is not null")
    return layout.ctc_decode(events, "user_id", "event_id", "event_type", "error")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
