"""Layout, tables, text layers, images and sinks: hand-worked cases, ties, nulls and empties."""

import io
import math
import random
import zipfile
import zlib
from xml.dom import minidom

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import text as T
from pagewright.operators import analysis as A
from pagewright.operators import edits, imaging, layout, predicates, ruled, textlayer
from pagewright.sinks import files, markup, sheets
from pagewright.sources import images, pdf
from pagewright.sources import tables as S


def item(no, l, t, r, b, text="some words of text", **kw):  # noqa: E741
    return A.Item(no, A.Rect(l, t, r, b), text, **kw)


def column(start, x0, x1, top, n, step=20, h=14, **kw):
    return [item(start + k, x0, top + k * step, x1, top + k * step + h, **kw) for k in range(n)]


# ------------------------------------------------------------------------------ sections and columns


def test_gaps_and_their_intersection():
    assert A.gaps((0, 100), [(10, 20), (15, 40), (60, 100)]) == [(0, 10), (40, 60)]
    assert A.gaps((0, 100), []) == [(0, 100)] and A.gaps((0, 100), [(-5, 120)]) == []
    assert A.shared([(0, 10), (40, 60)], [(5, 50)]) == [(5, 10), (40, 50)]
    assert A.gutters([(0, 30), (40, 60), (80, 100)], (0, 100), 15) == [(40, 60)]


def test_two_columns_are_one_section_with_two_columns():
    items = column(1, 0, 200, 0, 6) + column(10, 240, 440, 0, 6)
    _, cols, blocks = A.analyse(items, 500, 96)
    assert [len(c) for c in cols] == [2] and [(b.column, [s.no for s in b.segments]) for b in blocks] == [(0, [1, 2, 3, 4, 5, 6]), (1, [10, 11, 12, 13, 14, 15])]


def test_footer_shapes():
    """A full-width footer closes the gutter and opens a section; one narrower than the left column leaves it open and falls into that column."""
    body = column(1, 0, 200, 0, 6) + column(10, 240, 440, 0, 6)
    _, cols, blocks = A.analyse([*body, item(99, 0, 200, 440, 214)], 500, 96)
    assert [len(c) for c in cols] == [2, 1] and blocks[-1].section == 1
    _, cols, blocks = A.analyse([*body, item(99, 0, 200, 100, 214)], 500, 96)
    assert [len(c) for c in cols] == [2] and next(b for b in blocks if 99 in [s.no for s in b.segments]).column == 0


def test_one_band_with_a_gap_has_no_columns():
    _, cols, blocks = A.analyse([item(1, 0, 0, 100, 14), item(2, 300, 0, 400, 14)], 500, 96)
    assert [len(c) for c in cols] == [1] and len(blocks) == 1 and blocks[0].rows[0].text == "some words of text\tsome words of text"


def test_bands_with_specials():
    found = A.bands([item(1, 0, 0, 10, 20), item(2, 0, 10, 10, 30, kind="Figure"), item(3, 0, 22, 10, 40)], 12)
    assert [[i.no for i in b] for b in found] == [[1, 2], [3]] or [[i.no for i in b] for b in found] == [[1, 2, 3]]
    # the figure doesn't lower the least height: 22 < 30 - 0.4 * min(18, 20) = 22.8
    assert [[i.no for i in b] for b in found] == [[1, 2, 3]]
    assert [[i.no for i in b] for b in A.bands([item(1, 0, 0, 10, 20, kind="Figure"), item(2, 0, 16, 10, 40)], 12)] == [[1], [2]]


def test_borderless_table():
    rows = [item(10 * r + c, c * 150, r * 20, c * 150 + 60, r * 20 + 14, f"r{r}c{c}") for r in range(4) for c in range(3)]
    _, cols, blocks = A.analyse(rows, 500, 96)
    assert len(blocks) == 1 and blocks[0].kind == "Table" and len(cols[0]) == 1
    edges, lines, cells = blocks[0].cells[0]
    assert edges == [0, 105, 255, 360] and lines == [0, 17, 37, 57, 74] and [A.cell_text(own) for _, _, own in cells][:4] == ["r0c0", "r0c1", "r0c2", "r1c0"]
    long = [item(10 * r + c, c * 150, r * 20, c * 150 + 60, r * 20 + 14, "x" * 31) for r in range(4) for c in range(3)]
    assert all(b.kind == "Paragraph" for b in A.analyse(long, 500, 96)[2])


# ------------------------------------------------------------------------------ paragraphs


def kinds(items, width=400, **kw):
    return [(b.kind, [s.no for s in b.segments]) for b in A.analyse(items, width, 96, columns=False, **kw)[2]]


def test_paragraph_breaks():
    wide = column(1, 0, 400, 0, 4)
    assert kinds(wide) == [("Paragraph", [1, 2, 3, 4])]
    assert kinds(wide[:2] + [item(3, 0, 60, 400, 74), item(4, 0, 80, 400, 94)]) == [("Paragraph", [1, 2]), ("Paragraph", [3, 4])]  # a gap of 26 over 6
    assert kinds(wide[:2] + [item(3, 0, 40, 400, 54, bold=True), item(4, 0, 60, 400, 74, bold=True)])[0] == ("Paragraph", [1, 2])  # another style
    assert kinds([wide[0], item(2, 0, 20, 200, 34), *wide[2:]]) == [("Paragraph", [1, 2]), ("Paragraph", [3, 4])]  # a short line ends one
    assert kinds([wide[0], wide[1], item(3, 30, 40, 400, 54), item(4, 0, 60, 400, 74)])[0] == ("Paragraph", [1, 2])  # an indent opens one
    assert kinds([item(1, 30, 0, 400, 14), *wide[1:]]) == [("Paragraph", [1, 2, 3, 4])]  # the first line may be indented
    assert kinds([item(1, 150, 0, 250, 14), item(2, 100, 20, 300, 34), item(3, 0, 60, 400, 74)])[0] == ("Paragraph", [1, 2])  # centred lines go together


def test_lists():
    items = [item(1, 0, 0, 400, 14, "• first item that is long"), item(2, 30, 20, 400, 34, "and goes on"), item(3, 0, 40, 400, 54, "2. second"), item(4, 0, 60, 8, 74, "o"), item(5, 20, 60, 400, 74, "third")]
    _, _, blocks = A.analyse(items, 400, 96, columns=False)
    assert [(b.kind, b.marker, b.ordered, b.flow) for b in blocks] == [("ListItem", "•", False, "first item that is long and goes on"), ("ListItem", "2.", True, "second"), ("ListItem", "•", False, "third")]
    assert [s.no for s in blocks[2].segments] == [5] and blocks[2].text_left == 20 and blocks[2].indent == -20 and blocks[2].rect.l == 20
    assert math.isclose(blocks[0].text_left, 400 * 2 / 25) and blocks[1].align == "Left"


@pytest.mark.parametrize("text,marker", [("• a", "•"), ("•a", "•"), ("✗ a", "•"), ("❖a", "•"), ("- a", "•"), ("-a", None), ("–a", "•"), ("▶ a", None), ("∙ a", None), ("12) a", "12)"), ("(iv) a", "(iv)"), ("a.b", None), ("1234. a", None), ("•", None), (" • a", None)])
def test_markers(spark, text, marker):
    m = A.list_marker(A.visual_rows([item(1, 0, 0, 100, 10, text)])[0], 10)
    assert (m.text if m else None) == marker
    row = spark.createDataFrame([(text,)], "t string").select(T.marker_kind(F.col("t")).alias("k"), T.marker_prefix(F.col("t")).alias("n")).first()
    assert row.k == ("none" if marker is None else "bullet" if marker == "•" else "ordered") and row.n == (m.prefix if m else 0)


def test_alignment():
    col = A.Rect(0, 0, 400, 100)
    block = lambda *spans: A.Block("Paragraph", [A.Row([item(k, a, k * 20, b, k * 20 + 14)], A.Rect(a, k * 20, b, k * 20 + 14)) for k, (a, b) in enumerate(spans)], col)
    assert A.alignment(block((150, 250)), col) == "Center" and A.alignment(block((200, 400)), col) == "Right" and A.alignment(block((0, 400)), col) == "Left"
    assert A.alignment(block((100, 300), (150, 250), (120, 280)), col) == "Center" and A.alignment(block((100, 400), (150, 400), (50, 400)), col) == "Right"
    assert A.alignment(block((0, 400), (0, 399), (0, 200)), col) == "Justify" and A.alignment(block((0, 400), (0, 200)), col) == "Left"


def test_headings():
    body = [b for k in range(3) for b in column(10 * k + 10, 0, 400, 100 + k * 120, 3)]
    big = item(1, 0, 0, 300, 20, "Title", size=20)
    bold = item(2, 0, 60, 200, 74, "A short bold one", bold=True)
    _, _, blocks = A.analyse([big, bold, *body], 400, 96, columns=False)
    assert [(b.kind, b.level) for b in blocks] == [("Heading", 1), ("Heading", 2), ("Paragraph", None), ("Paragraph", None), ("Paragraph", None)]
    ended = item(2, 0, 60, 200, 74, "A short bold one.", bold=True)
    assert [b.kind for b in A.analyse([ended, *body], 400, 96, columns=False)[2]][0] == "Paragraph"
    numbered = item(2, 0, 60, 200, 80, "1. Beginning", size=16)
    found = A.analyse([numbered, *body], 400, 96, columns=False)[2][0]
    assert (found.kind, found.level, found.marker, found.flow, found.rect.l) == ("Heading", 1, None, "1. Beginning", 0)
    many = [item(k, 0, k * 60, 200, k * 60 + 20, f"T{k}", size=20) for k in range(6)] + column(90, 0, 400, 400, 2, text="x" * 200)
    assert all(b.kind == "Paragraph" for b in A.analyse(many, 400, 96, columns=False)[2])  # most would be headings


def test_lines_only():
    blocks = A.lines_only([item(2, 200, 1, 300, 15), item(1, 0, 0, 100, 14), item(3, 0, 30, 100, 44)])
    assert [[s.no for s in b.segments] for b in blocks] == [[1, 2], [3]] and blocks[1].space_before == 15 and A.lines_only([]) == []


def test_size_anchors(spark):
    rows = [(1, 1, i, "x" * n, s) for i, (n, s) in enumerate([(50, 10.0), (9, 10.6), (20, 12.0), (3, 11.2), (1, None)], 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, page_no int, line_id int, text string, size_pt float")
    got = {r.line_id: round(r.size, 4) for r in layout.size_anchors(df).collect()}
    assert got == {1: 10.0, 2: 10.0, 3: 12.0, 4: 12.0, 5: 11.0}  # 10.5 is near 10, 11.2 near 12; 11 is as near to 10, the first, but not within 9 %
    items = [item(i, 0, 0, 1, 1, t, size=s or 11.0) for _, _, i, t, s in rows]
    A.anchored_sizes(items)
    assert [i.size for i in items] == [10.0, 10.0, 12.0, 12.0, 11.0]


def test_analysed_blocks_of_a_page(spark):
    lines = [(1, 1, i.no, i.text, *map(float, (i.rect.l, i.rect.t, i.rect.r, i.rect.b)), 11.0, False, False, 0) for i in column(1, 0, 400, 0, 3)] + [(1, 1, 9, None, 0.0, 0.0, 1.0, 1.0, None, None, None, None), (2, 1, 1, "  ", 0.0, 0.0, 1.0, 1.0, None, None, None, None)]
    df = spark.createDataFrame(lines, "doc_id bigint, page_no int, line_id int, text string, l double, t double, r double, b double, size_pt double, bold boolean, italic boolean, color int").withColumn("kind", F.lit("x"))
    special = spark.createDataFrame([(1, 1, 5, "Figure", 0.0, 80.0, 100.0, 180.0)], "doc_id bigint, page_no int, block_no int, kind string, l double, t double, r double, b double")
    pages = spark.createDataFrame([(1, 1, 500, None), (2, 1, 500, 96.0), (3, 1, 500, 96.0)], "doc_id bigint, page_no int, width int, dpi float")
    got = [(r.doc_id, r.kind, r.line_ids, r.special_no) for r in A.analysed_blocks(df, special, pages).orderBy("doc_id", "block_no").collect()]
    assert got == [(1, "Paragraph", [1, 2, 3], None), (1, "Figure", [], 5)]
    assert A.analysed_blocks(df.limit(0), special.limit(0), pages).count() == 0


# ------------------------------------------------------------------------------ tables


GRID = [(True, 0.0, 0.0, 300.0), (True, 50.0, 0.0, 300.0), (True, 100.0, 0.0, 300.0), (False, 0.0, 0.0, 100.0), (False, 100.0, 50.0, 100.0), (False, 200.0, 0.0, 100.0), (False, 300.0, 0.0, 100.0)]


def test_ruled_table_with_a_span(spark):
    t = ruled.find_table(GRID, 4)
    assert t["rows"] == [0, 50, 100] and t["cols"] == [0, 100, 200, 300]
    assert t["cells"] == [(0, 0, 1, 2), (0, 2, 1, 1), (1, 0, 1, 1), (1, 1, 1, 1), (1, 2, 1, 1)]
    assert ruled.find_table([r for r in GRID if r[1] in (0, 100, 300) and (r[0] or r[1] != 100)], 4) is None  # a frame
    rules = spark.createDataFrame([(1, 1, *r) for r in GRID] + [(1, 1, True, 500.0, 0.0, 50.0), (2, 1, True, 0.0, 0.0, 9.0)], "doc_id bigint, page_no int, horizontal boolean, pos double, start double, end double")
    assert [(r.row, r.col, r.row_span, r.col_span) for r in ruled.ruled_cells(rules, 4).orderBy("row", "col").collect()] == t["cells"]


def test_cells_grow_to_rectangles():
    # an L of three cells on a 2 x 3 grid becomes the square around it, and that takes in nothing else
    assert ruled.rectangles(2, 3, [(0, 1), (0, 3)]) == [(0, 0, 2, 2), (0, 2, 1, 1), (1, 2, 1, 1)]
    assert ruled.rectangles(1, 1, []) == [(0, 0, 1, 1)]


def test_rules_that_meet():
    assert len(ruled.rule_groups(GRID + [(True, 900.0, 0.0, 10.0)], 4)) == 1 and ruled.rule_groups(GRID[:3], 4) == []
    assert ruled.mean_clusters([1, 2, 3, 10], 1) == [2, 10]


def test_lines_split_at_columns():
    ext = [(10.0 * k, 10.0 * k + 10) for k in range(8)]
    assert ruled.split_line("ab  cdef", ext, 0, 80, [0, 40, 100]) == [("ab", 0.0, 20.0), ("cdef", 40.0, 80.0)]
    assert ruled.split_line("abcdefgh", None, 0, 80, [0, 40, 100]) == [("abcdefgh", 0, 80)] and ruled.split_line("abcdefgh", ext, 0, 80, [0, 100]) == [("abcdefgh", 0, 80)]


def test_rows_of_a_cell():
    lines = [{"t": t, "b": t + 10, "l": x, "n": n} for n, t, x in ((1, 0, 50), (2, 3, 0), (3, 6, 20), (4, 30, 0))]
    assert [[x["n"] for x in r] for r in ruled.cell_rows(lines)] == [[2, 1], [3], [4]]  # 3 is near 2, but is held against 1


def test_table_styles(spark):
    lines = [(1, 1, i, "x" * 9, s, b) for i, (s, b) in enumerate([(10.0, True), (10.0, True), (12.0, True), (10.0, False), (10.0, True), (20.0, False)], 1)]
    cells = [(1, 1, 7, (i - 1) // 2, (i - 1) % 2, i) for i in range(1, 7)]
    df = spark.createDataFrame(lines, "doc_id bigint, page_no int, line_id int, text string, size_pt double, bold boolean")
    got = {r.line_id: (r.size, r.bold) for r in predicates.table_styles(df, spark.createDataFrame(cells, "doc_id bigint, page_no int, block_no int, row int, col int, line_id int")).collect()}
    assert got == {1: (10.0, True), 2: (10.0, True), 3: (10.0, True), 4: (10.0, False), 5: (10.0, True), 6: (20.0, False)}


# ------------------------------------------------------------------------------ text and numbers


@pytest.mark.parametrize(
    "text,value,fmt",
    [("5", 5.0, 1), ("-5", -5.0, 1), ("1,250", 1250.0, 3), ("1,250.5", 1250.5, 4), ("0.25", 0.25, 2), ("1.23456", 1.23456, 0), ("12%", 0.12, 9), ("12.5%", 0.125, 10), (" 7 ", 7.0, 1), ("12,50", None, None), ("1 2", None, None), ("", None, None)],
)
def test_number_cells(spark, text, value, fmt):
    v, f = T.number_cell(F.col("t"))
    row = spark.createDataFrame([(text,)], "t string").select(v.alias("v"), f.alias("f")).first()
    assert (row.v, row.f) == (value, fmt) == sheets.number_cell(text)


@pytest.mark.parametrize(
    "lines,text",
    [(["a cata-", "logue of"], "a catalogue of"), (["well-", "Known"], "well- Known"), (["书架。", "Next"], "书架。Next"), (["see", "「箱」"], "see「箱」"), (["한국", "어"], "한국 어"), (["end  ", "of"], "end of"), (["1-", "st"], "1- st"), (["", "a"], "a"), (["a-", "b-", "c"], "abc"), ([], "")],
)
def test_flowing_text(spark, lines, text):
    assert T.flow_text(lines) == text
    assert spark.createDataFrame([("\n".join(lines),)], "t string").select(T.flow(F.col("t"))).first()[0] == text


def test_names_columns_fonts(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "x string").select(c(F.col("x"))).first()[0]
    assert [one(T.clean_font_name, n) for n in ("ABCDEF+Arial-BoldMT", "TimesNewRomanPSMT", "Calibri,Italic", "ABC+X", "MT", None)] == ["Arial", "Times New Roman", "Calibri", "ABC+X", None, None]
    assert [one(T.column_index, n) for n in ("A1", "Z", "AA10", "XFD1", "")] == [1, 26, 27, 16384, 0] and [sheets.column_name(k) for k in (0, 25, 26, 16383)] == ["A", "Z", "AA", "XFD"]
    order = ["a2", "A10", "a" + "9" * 25, "a1" + "0" * 25, "b"]
    keys = [one(T.natural_key, n) for n in order]
    assert keys == sorted(keys) and one(T.html_encode, "<é&'😀>") == "&lt;&#233;&amp;&#39;&#128512;&gt;" == markup.html_text("<é&'😀>")
    assert one(T.utf16_length, "a😀") == 3 and one(T.parse_language, "JP") == "Japanese" and one(T.parse_format, None) == "Docx"


def test_unique_names_skip_what_is_taken(spark):
    names = ["o/a.txt", "o/a.txt", "o/a (2).txt", "o/a.txt", "o/b:c.txt"]
    df = spark.createDataFrame(list(enumerate(names)), "k int, p string")
    assert [r.unique_name for r in edits.unique_names(df, "p", "k").orderBy("k").collect()] == ["o/a.txt", "o/a (3).txt", "o/a (2).txt", "o/a (4).txt", "o/b_c.txt"]


# ------------------------------------------------------------------------------ geometry


def test_hull_and_smallest_rectangle():
    rnd = random.Random(1)
    for _ in range(40):
        pts = [(rnd.randint(0, 20), rnd.randint(0, 20)) for _ in range(rnd.randint(3, 12))]
        hull = G.convex_hull(pts)
        if len(hull) < 3:
            continue
        cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
        assert all(cross(a, b, p) >= 0 for a, b in zip(hull, hull[1:] + hull[:1]) for p in pts)
        cx, cy, w, h, angle = G.min_area_rect(hull)
        assert -math.pi / 4 - 1e-9 < angle <= math.pi / 4 + 1e-9
        best = min((max(p[0] * math.cos(k) + p[1] * math.sin(k) for p in hull) - min(p[0] * math.cos(k) + p[1] * math.sin(k) for p in hull)) * (max(p[1] * math.cos(k) - p[0] * math.sin(k) for p in hull) - min(p[1] * math.cos(k) - p[0] * math.sin(k) for p in hull)) for k in [i * math.pi / 720 for i in range(360)])
        assert w * h <= best + 1e-6
        own = G.corners(cx, cy, w, h, angle)
        assert all(cross(a, b, p) >= -1e-6 for a, b in zip(own, own[1:] + own[:1]) for p in hull)
    assert G.convex_hull([(1, 1)]) == [(1, 1)] and G.min_area_rect([]) == (0.0,) * 5 and G.min_area_rect([(0, 0), (4, 2)]) == (2, 1, 4, 2, 0.0)
    w, h, a = G.normalized_angle(4.0, 2.0, math.pi / 2)
    assert (w, h) == (2.0, 4.0) and abs(a) < 1e-9 and G.normalized_angle(4.0, 2.0, math.radians(-45))[:2] == (2.0, 4.0)


# ------------------------------------------------------------------------------ text layers and files


def small_pdf(content: bytes, encrypted: bool = False) -> bytes:
    packed = zlib.compress(content)
    parts = [
        b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", b"2 0 obj << /Type /Pages /Kids [3 0 R 6 0 R] /Count 2 /MediaBox [0 0 200 100] >> endobj",
        b"3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >> endobj",
        b"4 0 obj << /Length %d /Filter /FlateDecode >> stream\n" % len(packed) + packed + b"\nendstream endobj",
        b"5 0 obj << /Type /Font /BaseFont /ABCDEF+Arial-BoldMT /FirstChar 32 /Widths [" + b"500 " * 95 + b"] >> endobj", b"6 0 obj << /Type /Page /Parent 2 0 R >> endobj",
    ]
    return b"%PDF-1.4\n" + b"\n".join(parts) + (b"\ntrailer << /Encrypt 9 0 R >>" if encrypted else b"\ntrailer << /Root 1 0 R >>")


def test_text_layer_of_a_pdf(spark):
    raw = small_pdf(b"BT /F1 10 Tf 1 0 0 rg 20 80 Td (Hello  world) Tj 0 -20 Td [(Next) -3000 (cell)] TJ ET")
    df = spark.createDataFrame([("a.pdf", bytearray(raw)), ("b.pdf", bytearray(b"nothing")), ("c.pdf", bytearray(small_pdf(b"", True)))], "path string, content binary").withColumn("page_no", F.lit(1))
    pages = {(r.path, r.page_no): (r.width, r.height, r.error) for r in pdf.pdf_pages(df).collect()}
    assert pages == {("a.pdf", 1): (200.0, 100.0, None), ("a.pdf", 2): (200.0, 100.0, None), ("b.pdf", None): (None, None, "Cannot open PDF (no header)"), ("c.pdf", None): (None, None, "password protected")}
    chars = pdf.pdf_characters(df)
    assert {(r.path, r.visible, r.enough) for r in pdf.visible_characters(chars).collect()} == {("a.pdf", 18, True)}
    own = chars.select(F.lit(1).cast("bigint").alias("doc_id"), "page_no", "char_no", "ch", "l", "t", "r", "b", "font_pt", T.font_bold(F.col("font_name"), F.col("weight")).alias("bold"), T.font_italic(F.col("font_name"), F.col("italic_flag")).alias("italic"), "color", T.clean_font_name(F.col("font_name")).alias("font"), F.lit(False).alias("hard_break"))
    got = textlayer.text_layer_lines(own).orderBy("line_no").collect()
    assert [(r.text, r.bold, r.font, r.color, r.size_pt) for r in got] == [("Hello world", True, "Arial", 0xFF0000, 10.0), ("Next", True, "Arial", 0xFF0000, 10.0), ("cell", True, "Arial", 0xFF0000, 10.0)]
    assert (got[0].l, got[0].t) == (20.0, 12.0) and pdf.render_size(612, 792, 200) == (1700, 2200) and math.prod(pdf.render_size(61200, 79200, 200)) <= 145e6


def test_text_layer_lines_by_plain_python(spark):
    rnd = random.Random(2)
    chars, want = [], []
    x, y, cur, gap, brk = 0.0, 0.0, "", False, False
    for k in range(300):
        step = rnd.random()
        if step < 0.1:
            x, y = rnd.choice([0.0, x]), y + rnd.choice([0, 20])
        x += rnd.choice([0, 0, 30]) if step > 0.9 else 0
        ch = " " if step < 0.3 else rnd.choice("abc")
        hard = rnd.random() < 0.05
        chars.append((1, 1, k, ch, x, y, x + 6, y + 10, 10.0, False, False, 0, "F", hard))
        x += 6
    last = None
    for _, _, _, ch, l, t, r, b, *_, hard in chars:  # noqa: E741
        brk |= hard
        if ch == " ":
            gap = True
            continue
        new = last is None or brk or abs(t - last[1]) > 6 or l < last[0] - 10 or l - last[2] > 16
        if new:
            want.append(ch)
        else:
            want[-1] += (" " if gap else "") + ch
        last, gap, brk = (l, t, r), False, False
    df = spark.createDataFrame(chars, "doc_id bigint, page_no int, char_no int, ch string, l double, t double, r double, b double, font_pt double, bold boolean, italic boolean, color int, font string, hard_break boolean")
    assert [r.text for r in textlayer.text_layer_lines(df).orderBy("line_no").collect()] == want and len(want) > 10
    assert textlayer.text_layer_lines(df.where("ch = ' '")).count() == 0


def test_image_headers(spark):
    frame = lambda w, h, nxt: (3).to_bytes(2, "little") + b"".join(t.to_bytes(2, "little") + (3).to_bytes(2, "little") + (1).to_bytes(4, "little") + v.to_bytes(4, "little") for t, v in ((256, w), (257, h), (262, 1))) + nxt.to_bytes(4, "little")
    tiff = b"II*\0" + (8).to_bytes(4, "little") + frame(10, 20, 50) + frame(30, 40, 0)
    png = imaging.to_png(np.zeros((4, 6, 3), np.uint8))
    df = spark.createDataFrame([("d/a.tif", bytearray(tiff)), ("d/b.png", bytearray(png)), ("d/c.gif", bytearray(b"broken"))], "path string, content binary")
    got = sorted((r.path, r.page_no, r.label, r.width, r.height) for r in images.image_pages(df).collect())
    assert got == [("d/a.tif", 1, "Page 1", 10, 20), ("d/a.tif", 2, "Page 2", 30, 40), ("d/b.png", 1, "b.png", 6, 4), ("d/c.gif", 1, "c.gif", None, None)]


def test_files_as_documents(spark, tmp_path):
    paths = ["x/p10.png", "x/p2.PNG", "x/a.pdf", "y/z.webp", "y/q.emf"]
    got = {(r.document, r.kind, r.path, r.page_no) for r in S.workspace_documents(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {("x", "ImageSequence", "x/p2.PNG", 1), ("x", "ImageSequence", "x/p10.png", 2), ("x/a.pdf", "Pdf", "x/a.pdf", 1), ("y/z.webp", "Rejected", "y/z.webp", None), ("y", "ImageSequence", "y/q.emf", 1)}
    (tmp_path / "a.png").write_bytes(b"1")
    (tmp_path / "b.doc").write_bytes(b"2")
    assert {(r.kind, r.error) for r in S.binary_files(spark, str(tmp_path)).collect()} == {("image", None), ("rejected", "Unsupported file type")}
    (tmp_path / "dict").write_text("a\r\nb\n\nc\n")
    assert [r.symbol for r in S.dictionary(spark, str(tmp_path / "dict")).orderBy("index").collect()] == ["", "a", "b", "", "c", " "]
    assert S.memory_images(spark, [("clip", 2, 1, b"abcdef")]).first().kind == "Clipboard"
    defaults, schema = {"lang": "en", "dpi": 200}, "lang string, dpi int"
    for text, want in ((None, ("en", 200)), ('{"lang": "de"}', ("de", 200)), ("{broken", ("en", 200))):
        if text:
            (tmp_path / "s.json").write_text(text)
        assert tuple(S.settings(spark, str(tmp_path / "s.json"), defaults, schema).first()) == want
    S.save_settings(spark.createDataFrame([("fr", 300)], schema), str(tmp_path / "s.json"))
    assert tuple(S.settings(spark, str(tmp_path / "s.json"), defaults, schema).first()) == ("fr", 300)


# ------------------------------------------------------------------------------ images


def test_pixels():
    img = np.full((60, 80, 3), 250, np.uint8)
    img[20:40, 30:50] = (10, 20, 30)
    g = imaging.grey(img)
    t = imaging.otsu(imaging.histogram(g))
    assert t == int(g.min()) and imaging.otsu(np.zeros(256, int)) == 128 and imaging.ink(img).sum() == 400
    assert imaging.page_background(img) == (255, 255, 255) and imaging.snapped((30, 31, 32)) == (0, 0, 0) and imaging.snapped((100, 104, 108)) == (112,) * 3 or imaging.snapped((100, 104, 108)) == (96,) * 3
    m = imaging.measure_ink(img, (25, 15, 55, 45), (255, 255, 255))
    assert m["box"] == (30, 20, 50, 40) and m["color"] == (10, 20, 30) and m["stroke"] == 2 * 400 / 80
    assert imaging.measure_ink(img, (0, 0, 2, 2), (255, 255, 255)) is None and imaging.measure_ink(img, (0, 0, 20, 10), (255, 255, 255)) is None
    assert imaging.flat_fill(img, (32, 22, 48, 38), []) and imaging.cell_fill(img, (30, 20, 50, 40), [], (255, 255, 255)) == (12, 20, 28) and imaging.cell_fill(img, (0, 0, 20, 20), [], (250, 250, 250)) is None
    assert imaging.rule_color(img, [(True, 30.0, 30.0, 50.0)]) == (0, 0, 0) and imaging.rule_color(img, []) == (0, 0, 0)


def test_otsu_by_brute_force():
    rnd = np.random.default_rng(1)
    for _ in range(20):
        h = rnd.integers(0, 9, 256) * (rnd.random(256) < 0.3)
        best, at, n = -1.0, 128, h.sum()
        for t in range(256):
            a, b = h[: t + 1], h[t + 1 :]
            if a.sum() and b.sum():
                v = a.sum() * b.sum() * ((a * np.arange(t + 1)).sum() / a.sum() - (b * np.arange(t + 1, 256)).sum() / b.sum()) ** 2
                if v > best * (1 + 1e-12):
                    best, at = v, t
        assert imaging.otsu(h) == at or n == 0


def test_runs_and_rules():
    mask = np.zeros((40, 60), bool)
    mask[10, 5:50] = True
    mask[10, 20] = False
    mask[11, 5:50] = True
    mask[30:40, 5:50] = True  # an area
    runs = imaging.ink_runs(mask, True, 20, 2)
    assert (10, 5, 50) in runs and imaging.ink_runs(mask, True, 20, 0)[:2] == [(10, 21, 50), (11, 5, 50)]
    assert imaging.strokes(runs, 4, 2) == [{"pos": 11.0, "start": 5, "end": 50, "thick": 2}]
    assert imaging.clear_beside(mask, {"pos": 11.0, "start": 5, "end": 50, "thick": 2}, True) and not imaging.clear_beside(mask, {"pos": 31.0, "start": 5, "end": 50, "thick": 2}, True)
    assert imaging.page_rules(mask, 80) == [(True, 11.0, 5.0, 50.0)]


def test_components_by_brute_force():
    rnd = np.random.default_rng(2)
    for _ in range(20):
        m = rnd.random((12, 15)) < 0.4
        labels = imaging.components(m)
        assert ((labels > 0) == m).all()
        seen, k = np.zeros_like(labels), 0
        for y, x in zip(*np.nonzero(m)):
            if not seen[y, x]:
                k += 1
                todo = [(y, x)]
                seen[y, x] = k
                while todo:
                    a, b = todo.pop()
                    for i in range(max(0, a - 1), min(12, a + 2)):
                        for j in range(max(0, b - 1), min(15, b + 2)):
                            if m[i, j] and not seen[i, j]:
                                seen[i, j] = k
                                todo.append((i, j))
        assert (labels == seen).all()
        grown = imaging.dilated(m, 2)
        assert all(grown[y, x] == m[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].any() for y in range(12) for x in range(15))


def test_figures_bullets_boxes():
    img = np.full((400, 600, 3), 255, np.uint8)
    img[100:220, 100:260] = (200, 30, 30)
    assert len(imaging.figure_boxes(img, (255, 255, 255), [], [], [], 100)) == 1
    assert imaging.figure_boxes(img, (255, 255, 255), [(100, 100, 260, 220)], [], [], 100) == [] and imaging.merged_rects([(0, 0, 10, 10), (11, 0, 20, 10), (50, 50, 60, 60)], 2) == [(0, 0, 20, 10), (50, 50, 60, 60)]
    mask = np.zeros((60, 200), bool)
    mask[26:34, 40:48] = True
    assert imaging.bullet_glyph(mask, (60, 20, 190, 40), []) == (40.0, 26.0, 48.0, 34.0) and imaging.bullet_glyph(mask, (60, 20, 190, 40), [(0, 20, 50, 40)]) is None
    prob = np.zeros((60, 120))
    prob[20:30, 20:90] = 0.9
    (quad, score), *more = imaging.text_boxes(prob)
    assert not more and abs(score - 0.9) < 1e-9 and min(p[0] for p in quad) < 20 and imaging.text_boxes(np.zeros((5, 5))) == []


def test_ctc():
    steps = np.array([[0.1, 0.9, 0], [0, 0.8, 0.2], [1, 0, 0], [0, 0.7, 0.3], [0, 0.1, 0.9]])
    text, conf, centres, confs = imaging.ctc_text(steps, ["", "a", "b"], 50, 50)
    assert text == "aab" and np.allclose(confs, [0.9, 0.7, 0.9]) and np.allclose(centres, [0.2, 0.7, 0.9]) and np.isclose(conf, 2.5 / 3)
    assert imaging.ctc_text(np.zeros((0, 3)), ["", "a", "b"], 50, 50) == ("", 0.0, [], [])


def test_resizing_and_tensors():
    rnd = np.random.default_rng(3)
    img = rnd.integers(0, 255, (30, 40, 3), np.uint8)
    assert (imaging.resize(img, 40, 30) == img).all() and (imaging.resize(np.full((9, 9, 3), 77, np.uint8), 3, 4) == 77).all()
    assert (imaging.crop_quad(img, [(5, 5), (25, 5), (25, 15), (5, 15)]) == img[5:15, 5:25]).all() and imaging.crop_quad(img, [(5, 5), (10, 5), (10, 25), (5, 25)]).shape == (5, 20, 3)
    assert (imaging.processed(img, 90, None) == np.rot90(img, -1)).all() and imaging.processed(img, 0, (0.5, 0.5, 0.5, 0.5)).shape == (15, 20, 3) and imaging.processed(img, 0, (0, 0, 0.1, 0.1)).shape == img.shape
    assert (imaging.oriented(img, 6) == imaging.rotate(img, 90)).all() and (imaging.oriented(img, 1) == img).all() and (imaging.on_white(np.zeros((2, 2, 4), np.uint8)) == 255).all()
    assert imaging.detector_tensor(img).shape == (3, 64, 96) and imaging.classifier_tensor([img]).shape == (1, 3, 80, 160)
    tensor, widths = imaging.recogniser_tensor([img, img[:10]])
    assert tensor.shape == (2, 3, 48, 320) and widths == [64, 192] and tensor[0, :, :, 64:].sum() == 0
    assert (imaging.from_png(imaging.to_png(img)) == img).all()


# ------------------------------------------------------------------------------ sinks


def block(no, kind, text, t, **kw):
    box = {"l": 10.0, "t": t, "r": 300.0, "b": t + 14.0}
    base = {"block_no": no, "section_no": 0, "column_no": 0, "columns": 1, "kind": kind, "heading_level": None, "list_marker": None, "ordered_list": False, "rows": 1, "text": text, "align": "Left", "size_pt": 11.0, "bold": False, "indent": 0.0, "line_spacing": 17.0, "space_before": 6.0, "box": box, "section_box": {"l": 10.0, "t": 0.0, "r": 300.0, "b": 200.0}, "column_box": {"l": 10.0, "t": 0.0, "r": 300.0, "b": 200.0}, "special_no": None, "cells": None, "col_edges": None, "row_edges": None}
    return base | kw


PAGE = {"width": 600.0, "height": 800.0, "dpi": 96.0}
BLOCKS = [
    block(1, "Heading", "Title & more", 0.0, heading_level=2), block(2, "ListItem", "one", 20.0, list_marker="•", indent=-10.0), block(3, "ListItem", "two", 40.0, list_marker="•"), block(4, "ListItem", "three", 60.0, list_marker="1.", ordered_list=True),
    block(5, "Table", "", 80.0, cells=[{"row": r, "col": c, "text": x, "line_ids": []} for r, row in enumerate((("a", "1,250"), ("b\nc", "12%"))) for c, x in enumerate(row)], col_edges=[10.0, 150.0, 300.0], row_edges=[80.0, 90.0, 94.0]),
    block(6, "Paragraph", "Body é", 100.0, align="Center"),
]


def test_page_as_markup():
    html = markup.flow_html(BLOCKS, PAGE, 0)
    assert html.count("<ul") == 1 and html.count("<ol") == 1 and html.count("<li") == 3 and "<h2" in html and "Title &amp; more" in html and "text-align:center" in html and "Body &#233;" in html and html.count("<td>") == 4 and "b<br>c" in html
    assert markup.page_text(BLOCKS) == "Title & more\n\n• one\n\n• two\n\n1. three\n\na\t1,250\nb c\t12%\n\nBody é\n" and markup.page_text([]) == "\n"
    two = [block(1, "Paragraph", "left", 0.0, columns=2), block(2, "Paragraph", "right", 0.0, columns=2, column_no=1, column_box={"l": 320.0, "t": 0.0, "r": 500.0, "b": 200.0})]
    assert 'class="cols"' in markup.flow_html(two, PAGE, 0) and "column-gap:20px" in markup.flow_html(two, PAGE, 0) and '<w:cols w:equalWidth="0" w:num="2">' in markup.editable_xml(two, PAGE, True)[1]
    assert markup.html_head("t", "de-DE", "O'Font").startswith('<!DOCTYPE html>\n<html lang="de">') and markup.number(2.5) == "3" and markup.number(0.25, 1) == "0.3" and markup.number(-0.2) == "0"
    assert "left:10px" in markup.exact_html([{"l": 10.0, "t": 20.0, "r": 40.0, "b": 34.0, "text": "x", "size_pt": 11.0, "bold": True}], PAGE, 0)
    for xml in (*markup.editable_xml(BLOCKS, PAGE, True), markup.plain_xml(BLOCKS)):
        minidom.parseString(f"<r {markup.W}>{xml}</r>")


def test_page_as_sheet():
    cells = sheets.sheet_cells(BLOCKS, PAGE)
    table = [c for c in cells if c[5] in ("a", "1,250", "b\nc", "12%")]
    assert [(c[2], c[6], c[7]) for c in table] == [("A5", None, None), ("B5", 1250.0, 3), ("A6", None, None), ("B6", 0.12, 9)] and cells[0][:5] == (1, 0, "A1", 2, 1)
    side = [block(1, "Paragraph", "left", 0.0, box={"l": 10.0, "t": 0.0, "r": 140.0, "b": 14.0}), block(2, "Paragraph", "right", 0.0, box={"l": 150.0, "t": 2.0, "r": 300.0, "b": 16.0}), BLOCKS[4]]
    assert [c[2] for c in sheets.sheet_cells(side, PAGE)][:2] == ["A1", "B1"] and sheets.sheet_cells([], PAGE) == [] and sheets.clusters([1, 2, 3, 9], 1.5) == [1, 3, 9]
    minidom.parseString(sheets.sheet_xml(BLOCKS, PAGE, sheets.Strings()))
    minidom.parseString(sheets.styles_xml())


def test_documents_as_files(spark, tmp_path):
    lines = [(1, p, i.no, i.text, *map(float, (i.rect.l, i.rect.t, i.rect.r, i.rect.b)), 11.0, False, False, 0) for p in (1, 2) for i in column(1, 0, 400, 0, 3)]
    df = spark.createDataFrame(lines, "doc_id bigint, page_no int, line_id int, text string, l double, t double, r double, b double, size_pt double, bold boolean, italic boolean, color int")
    special = spark.createDataFrame([], "doc_id bigint, page_no int, block_no int, kind string, l double, t double, r double, b double")
    pages = spark.createDataFrame([(1, 1, 500, 700, 96.0), (1, 2, 500, 700, None), (2, 1, 500, 700, 96.0)], "doc_id bigint, page_no int, width int, height int, dpi float")
    blocks = A.analysed_blocks(df, special, pages)
    for fmt in ("txt", "html", "docx", "xlsx"):
        rows = {r.doc_id: r for r in files.export_documents(blocks, pages, f"file://{tmp_path}/{fmt}", fmt).collect()}
        assert {k: (r.pages, r.status) for k, r in rows.items()} == {1: (2, "Done"), 2: (1, "Done")} and not list((tmp_path / fmt).glob("*.tmp"))
        raw = (tmp_path / fmt / f"1.{fmt}").read_bytes()
        if fmt == "txt":
            assert raw.startswith(b"\xef\xbb\xbf") and raw.decode("utf-8-sig") == "\f\n".join([" ".join(["some words of text"] * 3) + "\n"] * 2)
        elif fmt == "html":
            assert raw.count(b"<article") == 2 and raw.endswith(b"</html>\n")
        else:
            z = zipfile.ZipFile(io.BytesIO(raw))
            assert z.testzip() is None
            for name in z.namelist():
                minidom.parseString(z.read(name))
            assert ("word/document.xml" if fmt == "docx" else "xl/worksheets/sheet2.xml") in z.namelist()
    (tmp_path / "blocked").write_text("a file, no folder")
    failed = files.export_documents(blocks, pages, f"{tmp_path}/blocked", "txt").collect()
    assert {r.status for r in failed} == {"Failed"} and all(r.error for r in failed)
    with pytest.raises(ValueError):
        files.export_documents(blocks, pages, str(tmp_path), "rtf")


def test_places_in_hot_groups(spark):
    """The places are those of a window, whatever tasks a group lies in; null keys are left out as joins do."""
    from pyspark.sql import Window

    from pagewright.operators.ranking import ranked

    df = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), (F.col("id") * 7919 % 3000).alias("v"))
    got = {(r.k, r.v): r.n for r in ranked(df, ["k"], ["v"], "n").collect()}
    want = {(r.k, r.v): r.n for r in df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("v"))).collect()}
    assert got == want and ranked(df.limit(0), ["k"], ["v"], "n").count() == 0


def test_positioned_lines_with_drawn_bullets(spark):
    lines = spark.createDataFrame([(1, 1, 1, "b", 20.0, 10.0, False), (1, 1, 2, "a", 20.0, 0.0, None), (1, 1, 3, "in a figure", 0.0, 0.0, True), (1, 1, 4, "cell", 0.0, 50.0, False)], "doc_id bigint, page_no int, line_id int, text string, l double, t double, in_figure boolean")
    blocks = spark.createDataFrame([(1, 1, 1, "Table", [4]), (1, 1, 2, "Paragraph", None)], "doc_id bigint, page_no int, block_no int, kind string, line_ids array<int>")
    bullets = spark.createDataFrame([(1, 1, 5.0, 10.0)], "doc_id bigint, page_no int, l double, t double")
    assert [(r.line_id, r.text) for r in predicates.positioned_lines(lines, blocks, bullets).orderBy("place").collect()] == [(2, "a"), (None, "•"), (1, "b")]


def test_predicates_on_empty_tables(spark):
    """Every join and predicate of pages gives an empty result for empty tables, with its own columns."""
    box = "doc_id bigint, page_no int, line_id int, text string, l double, t double, r double, b double, size_pt float, bold boolean, italic boolean, color int, in_figure boolean"
    lines = spark.createDataFrame([], box)
    blocks = spark.createDataFrame([], "doc_id bigint, page_no int, block_no int, kind string, line_ids array<int>, l double, t double, r double, b double")
    pages = spark.createDataFrame([], "doc_id bigint, page_no int, width int, height int, dpi float, rotation int, crop struct<x:float,y:float,w:float,h:float>")
    for df in (
        predicates.style_changes(lines), predicates.centered_lines(lines), predicates.figures_of_size(blocks, pages), predicates.text_in_figures(lines, blocks), predicates.remapped_lines(lines, pages), predicates.positioned_lines(lines, blocks),
        predicates.block_text_lines(blocks), predicates.alone_on_the_left(lines), predicates.table_rows(lines, blocks), predicates.aspect_batches(lines), predicates.first_boxes(lines), layout.size_anchors(lines), layout.band_fold(lines), layout.visual_lines(lines),
    ):
        assert df.count() == 0 and df.columns[:2] == ["doc_id", "page_no"]
