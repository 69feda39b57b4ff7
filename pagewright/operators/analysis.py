"""Logical structure of a page from its positioned lines, tables and figures: sections, columns, blocks, headings.

What a fold opens depends on the group that is open (the gutters a section still shares, the block a line might
continue), so neither windows nor map-side aggregates can say it. A page is bounded by a sheet of paper: its rows meet by
one exchange on the page key, come sorted, and one pass in Arrow batches gives a row for each block.
"""

from __future__ import annotations

import re
import statistics
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import BULLET_MARKER, LOOSE_BULLETS, ORDERED_MARKER, flow_text
from .kernel import page_kernel

_BULLET, _ORDERED = re.compile(BULLET_MARKER.replace("\\p{Z}", "  -   　")), re.compile(ORDERED_MARKER.replace("\\p{Z}", "  -   　").replace("\\p{Nd}", "0-9"))

Span = tuple[float, float]

# --- fixed values -------------------------------------------------------------------------------
#: A band's overlap that keeps an item out, and the overlap that makes segments one row, in heights.
BAND_SLACK, ROW_OVERLAP = 0.4, 0.55
#: A gutter's least width in median heights and as a share of the page; bands that must have it; median height without lines, in inches.
GUTTER_HEIGHTS, GUTTER_SHARE, GUTTER_BANDS, NO_HEIGHT = 1.1, 0.012, 2, 1 / 6
#: A borderless table: bands, share of them in several columns, median length of texts, columns or the length that fewer need.
TABLE_BANDS, TABLE_SHARE, TABLE_LENGTH, TABLE_COLUMNS, TABLE_SHORT = 3, 0.6, 30, 3, 16
#: A gap in a row that is a tab, in heights; a marker's own segment, in heights.
TAB_GAP, MARKER_WIDTH = 2.5, 1.6
#: Styles: size tolerance of equal ones and within a paragraph, distance of colours.
SAME_SIZE, PARAGRAPH_SIZE, SAME_COLOR = 0.12, 0.16, 60
#: A paragraph's end: gap over the median in heights and pixels, short line in heights and as a share of the column, indent, outdent and shift in heights; median gap without any, in median heights.
GAP_HEIGHTS, GAP_LEAST, SHORT_HEIGHTS, SHORT_SHARE, INDENT, OUTDENT, SHIFT, NO_GAP = 0.4, 4, 3, 0.12, 1.2, 0.8, 1.2, 0.3
#: Centred rows: least margin and difference of margins, as shares of the column.
CENTER_MARGIN, CENTER_DIFF = 0.08, 0.05
#: Alignment of one row (margins as shares, or heights) and of several (spreads in heights).
ONE_CENTER, ONE_DIFF, ONE_RIGHT, ONE_EDGE, ONE_EDGE_HEIGHT = 0.1, 0.06, 0.3, 0.03, 0.5
CENTER_SPREAD, CENTER_LEFTS, RIGHT_SPREAD, RIGHT_LEFTS, JUSTIFY_SPREAD, JUSTIFY_ROWS, JUSTIFY_EDGE = 0.8, 1.2, 0.5, 1.5, 0.6, 3, 1.5
#: Line spacing of one row, in heights; sizes that are one; half a height that makes lines one row of a cell.
ONE_SPACING, SNAP, CELL_ROW = 1.2, 0.09, 0.5
#: Headings: most characters, most rows, size over the body's; of bold ones least size, most words; share of blocks beyond which none are, of more than so many blocks; levels.
HEAD_LENGTH, HEAD_ROWS, HEAD_SIZE, BOLD_SIZE, BOLD_WORDS, HEAD_SHARE, HEAD_BLOCKS, LEVELS = 160, 3, 1.18, 0.95, 12, 0.6, 4, 3
# ------------------------------------------------------------------------------------------------


@dataclass
class Rect:
    l: float
    t: float
    r: float
    b: float

    @property
    def w(self) -> float:
        return self.r - self.l

    @property
    def h(self) -> float:
        return self.b - self.t

    def __or__(self, o: Rect) -> Rect:
        return Rect(min(self.l, o.l), min(self.t, o.t), max(self.r, o.r), max(self.b, o.b))


def around(rects) -> Rect:
    """The box around some, never one of them itself."""
    return replace(reduce(Rect.__or__, rects))


@dataclass
class Item:
    """A line (kind None), table or figure."""

    no: int
    rect: Rect
    text: str = ""
    size: float = 11.0
    bold: bool = False
    italic: bool = False
    color: int = 0
    kind: str | None = None


@dataclass
class Row:
    """A visual line: its segments from left to right, or one table or figure."""

    items: list[Item]
    rect: Rect

    @property
    def special(self) -> bool:
        return self.items[0].kind is not None

    @property
    def text(self) -> str:
        out = self.items[0].text
        for a, b in zip(self.items, self.items[1:]):
            out += ("\t" if b.rect.l - a.rect.r > TAB_GAP * self.rect.h else " ") + b.text
        return out

    @property
    def style(self) -> Item:
        return max(self.items, key=lambda s: len(s.text))


@dataclass
class Block:
    kind: str
    rows: list[Row]
    rect: Rect
    marker: str | None = None
    ordered: bool = False
    prefix: int = 0
    text_left: float = 0.0
    section: int = 0
    column: int = 0
    align: str = "Left"
    indent: float = 0.0
    spacing: float | None = None
    space_before: float = 0.0
    level: int | None = None
    size: float | None = None
    bold: bool = False
    no: int | None = None
    cells: list = field(default_factory=list)

    @property
    def segments(self) -> list[Item]:
        return [s for r in self.rows for s in r.items]

    def row_text(self, k: int) -> str:
        t = self.rows[k].text
        return t[self.prefix :].lstrip() if k == 0 and 0 < self.prefix <= len(t) else t

    @property
    def flow(self) -> str:
        return flow_text([self.row_text(k) for k in range(len(self.rows))])


# ------------------------------------------------------------------------------ sections and columns


def upper_median(values: list[float], fallback: float) -> float:
    return statistics.median_high(values) if values else fallback


def overlap_ratio(a: Span, b: Span) -> float:
    both, shorter = min(a[1], b[1]) - max(a[0], b[0]), min(a[1] - a[0], b[1] - b[0])
    return both / shorter if both > 0 and shorter > 0 else 0.0


def gaps(region: Span, covered: list[Span]) -> list[Span]:
    """What of a region no interval covers."""
    out, at = [], region[0]
    for a, b in sorted(covered):
        if a > at:
            out.append((at, min(a, region[1])))
        at = max(at, b)
        if at >= region[1]:
            return out
    return [*out, (at, region[1])]


def shared(a: list[Span], b: list[Span]) -> list[Span]:
    return [(lo, hi) for x in a for y in b if (hi := min(x[1], y[1])) > (lo := max(x[0], y[0]))]


def gutters(free: list[Span], region: Span, least: float) -> list[Span]:
    """Gaps inside a region, not at its edges, of at least the given width."""
    return [g for g in free if g[0] > region[0] + 1 and g[1] < region[1] - 1 and g[1] - g[0] >= least]


def bands(items: list[Item], h_med: float) -> list[list[Item]]:
    """Items in rows that overlap: one joins unless its top is below the band's bottom less 0.4 of the smaller height."""
    out: list[list[Item]] = []
    bottom = least = 0.0
    for it in sorted(items, key=lambda i: (i.rect.t, i.rect.l)):
        if out and it.rect.t < bottom - BAND_SLACK * (min(it.rect.h, least) if least > 0 else it.rect.h):
            out[-1].append(it)
            bottom = max(bottom, it.rect.b)
            least = least if it.kind else min(least, it.rect.h)
        else:
            out.append([it])
            bottom, least = it.rect.b, h_med if it.kind else it.rect.h
    return out


def sections(found: list[list[Item]], region: Span, least: float, columns: bool = True) -> list[tuple[list[list[Item]], list[Span]]]:
    """Bands in groups with the gutters they share; a band that would close the last gutter, or has gutters of its own only, opens a group."""
    out: list[tuple[list[list[Item]], list[Span]]] = []
    common: list[Span] = []
    for band in found:
        free = gaps(region, [(i.rect.l, i.rect.r) for i in band])
        both = shared(common, free) if out else free
        had, has, own = (bool(columns and gutters(x, region, least)) for x in (common if out else [], both, free))
        if out and not has and (had or own) or not out:
            out.append(([band], free))
            common = free
        else:
            out[-1][0].append(band)
            out[-1] = (out[-1][0], both)
            common = both
    return [(bs, gutters(c, region, least) if columns and len(bs) >= GUTTER_BANDS else []) for bs, c in out]


def borderless(found: list[list[Item]], edges: list[float]) -> bool:
    """Whether bands with gutters are a table: three bands or more, most in several columns, with short texts."""
    items = [i for b in found for i in b]
    if len(found) < TABLE_BANDS or any(i.kind for i in items):
        return False
    column = lambda i: sum((i.rect.l + i.rect.r) / 2 > e for e in edges)
    several = sum(len({column(i) for i in b}) >= 2 for b in found)
    length = upper_median([len(i.text) for i in items], 0)
    return several >= TABLE_SHARE * len(found) and length <= TABLE_LENGTH and (len(edges) + 1 >= TABLE_COLUMNS or length <= TABLE_SHORT)


def borderless_cells(found: list[list[Item]], edges: list[float], box: Rect) -> tuple[list[float], list[float], list[tuple[int, int, list[Item]]]]:
    """(column edges, row edges, cells (row, column, lines)) of a table without rules."""
    rects = [around(i.rect for i in b) for b in found]
    cols = [box.l, *edges, box.r]
    rows = [box.t, *((a.b + b.t) / 2 for a, b in zip(rects, rects[1:])), box.b]
    last = len(cols) - 2
    inside = lambda i, c: (x := (i.rect.l + i.rect.r) / 2) >= cols[c] and (x < cols[c + 1] or c == last)
    return cols, rows, [(r, c, [i for i in b if inside(i, c)]) for r, b in enumerate(found) for c in range(last + 1)]


# ------------------------------------------------------------------------------ visual lines and paragraphs


def visual_rows(items: list[Item]) -> list[Row]:
    """Segments of one line of print: a segment joins the latest row whose growing extent it overlaps by more than 0.55."""
    out: list[Row] = []
    for it in sorted(items, key=lambda i: (i.rect.t, i.rect.l)):
        row = None if it.kind else next((v for v in reversed(out) if not v.special and overlap_ratio((v.rect.t, v.rect.b), (it.rect.t, it.rect.b)) > ROW_OVERLAP), None)
        if row is None:
            out.append(Row([it], it.rect))
        else:
            row.items.append(it)
            row.rect = row.rect | it.rect
    out.sort(key=lambda v: v.rect.t)
    for v in out:
        v.items.sort(key=lambda s: s.rect.l)
    return out


@dataclass
class Marker:
    text: str
    ordered: bool
    prefix: int
    text_left: float


def list_marker(row: Row, h_med: float) -> Marker | None:
    """The list marker that opens a row. One that is a tiny segment of its own is taken out of the row, whose box keeps it."""
    first = row.items[0]
    alone = first.text.strip()
    if len(row.items) > 1 and first.rect.w < MARKER_WIDTH * max(first.rect.h, h_med):
        loose = len(alone) == 1 and alone in LOOSE_BULLETS
        if loose or _ORDERED.match(alone + " x"):
            del row.items[0]
            row.rect = Rect(first.rect.l, row.rect.t, row.rect.r, row.rect.b)
            return Marker("•" if loose else alone, not loose, 0, row.items[0].rect.l)
    m = _BULLET.match(first.text)
    marker, ordered = "•", False
    if m is None:
        m = _ORDERED.match(first.text)
        if m is None:
            return None
        marker, ordered = m.group(1), True
    prefix = m.end() - 1  # the patterns end on the first character of the text
    return Marker(marker, ordered, prefix, first.rect.l + first.rect.w * prefix / max(1, len(first.text)))


def same_style(a: Item, b: Item, tolerance: float = SAME_SIZE) -> bool:
    distance = sum(abs((a.color >> s & 255) - (b.color >> s & 255)) for s in (16, 8, 0))
    return abs(a.size - b.size) / max(1.0, a.size, b.size) <= tolerance and a.bold == b.bold and a.italic == b.italic and distance <= SAME_COLOR


def centered(r: Rect, col: Rect) -> bool:
    left, right = r.l - col.l, col.r - r.r
    return left > CENTER_MARGIN * col.w and abs(left - right) < max(CENTER_DIFF * col.w, r.h)


def breaks(prev: Row, row: Row, cur: Block, marker: Marker | None, col: Rect, h_med: float, med_gap: float) -> str | None:
    """Why a row opens a block rather than going on in the open one; None if it goes on."""
    lh = min(prev.rect.h, row.rect.h)
    shift = row.rect.l - prev.rect.l
    if row.rect.t - prev.rect.b > med_gap + max(GAP_HEIGHTS * lh, GAP_LEAST):
        return "gap"
    if not same_style(row.style, prev.style, PARAGRAPH_SIZE):
        return "style"
    if marker:
        return "marker"
    if cur.kind == "ListItem":
        return "item" if abs(row.rect.l - cur.text_left) > max(lh, h_med) else None
    middle = centered(prev.rect, col) and centered(row.rect, col)
    if prev.rect.r < col.r - max(SHORT_HEIGHTS * lh, SHORT_SHARE * max(1.0, col.w)) and not middle:
        return "short"
    if shift > INDENT * lh and len(cur.rows) >= 2:
        return "indent"
    first_indent = len(cur.rows) == 1 and shift < -OUTDENT * lh
    return "shift" if not first_indent and abs(shift) > SHIFT * lh and not middle else None


def alignment(b: Block, col: Rect) -> str:
    """Left, Center, Right or Justify, by margins for one row and by the spread of edges and centres for several."""
    rects = [r.rect for r in b.rows]
    w, h = max(1.0, col.w), sum(r.h for r in rects) / len(rects)
    if b.kind == "ListItem":
        return "Left"
    if len(rects) == 1:
        left, right = rects[0].l - col.l, col.r - rects[0].r
        if left > ONE_CENTER * w and abs(left - right) < max(ONE_DIFF * w, h):
            return "Center"
        return "Right" if left > ONE_RIGHT * w and right < max(ONE_EDGE * w, ONE_EDGE_HEIGHT * h) else "Left"
    spread = lambda v: max(v) - min(v) if len(v) > 1 else 0.0
    rights = [r.r for r in rects[:-1]]
    sl, sr, sc = spread([r.l for r in rects[1:]]), spread(rights), spread([(r.l + r.r) / 2 for r in rects])
    if sc < CENTER_SPREAD * h and sl > CENTER_LEFTS * h:
        return "Center"
    if sr < RIGHT_SPREAD * h and sl > RIGHT_LEFTS * h:
        return "Right"
    return "Justify" if sr < JUSTIFY_SPREAD * h and len(rects) >= JUSTIFY_ROWS and sum(rights) / len(rights) > col.r - JUSTIFY_EDGE * h else "Left"


def finish(b: Block, col: Rect) -> None:
    """Style, spacing, indent, box and alignment of a text block whose rows are complete."""
    segs = b.segments
    b.rect = around(r.rect for r in b.rows)
    main = max(segs, key=lambda s: len(s.text))
    b.size = main.size
    b.bold = 2 * sum(len(s.text) for s in segs if s.bold) > sum(len(s.text) for s in segs)
    tops = [r.rect.t for r in b.rows]
    b.spacing = upper_median([y - x for x, y in zip(tops, tops[1:])], ONE_SPACING * b.rows[0].rect.h)
    if b.kind == "ListItem":
        b.indent, b.rect.l = b.rect.l - b.text_left, b.text_left
    elif len(b.rows) > 1:
        rest = min(r.rect.l for r in b.rows[1:])
        b.indent, b.rect.l = b.rows[0].rect.l - rest, rest
    b.align = alignment(b, col)


def paragraphs(items: list[Item], col: Rect, h_med: float) -> list[Block]:
    """Blocks of a column in order."""
    rows = visual_rows(items)
    between = [b.rect.t - a.rect.b for a, b in zip(rows, rows[1:]) if not a.special and not b.special]
    med_gap = upper_median(between, NO_GAP * h_med)
    out: list[Block] = []
    cur = prev = None
    for row in rows:
        if row.special:
            out.append(Block(row.items[0].kind, [], row.rect, no=row.items[0].no))
            cur, prev = None, None
            continue
        marker = list_marker(row, h_med)
        if cur is None or breaks(prev, row, cur, marker, col, h_med, med_gap):
            cur = Block("ListItem" if marker else "Paragraph", [], row.rect)
            if marker:
                cur.marker, cur.ordered, cur.prefix, cur.text_left = marker.text, marker.ordered, marker.prefix, marker.text_left
            out.append(cur)
        cur.rows.append(row)
        prev = row
    bottom = col.t
    for b in out:
        if b.rows:
            finish(b, col)
        b.space_before = max(0.0, b.rect.t - bottom)
        bottom = b.rect.b
    return out


def lines_only(items: list[Item]) -> list[Block]:
    """One paragraph for each row; a line belongs to the last row whose first line it overlaps by more than 0.55."""
    rows: list[list[Item]] = []
    for it in sorted(items, key=lambda i: i.rect.t):
        own = next((r for r in reversed(rows) if overlap_ratio((r[0].rect.t, r[0].rect.b), (it.rect.t, it.rect.b)) > ROW_OVERLAP), None)
        if own is None:
            rows.append([it])
        else:
            own.append(it)
    out: list[Block] = []
    bottom = min((i.rect.t for i in items), default=0.0)
    for own in rows:
        row = Row(sorted(own, key=lambda i: i.rect.l), around(i.rect for i in own))
        out.append(Block("Paragraph", [row], row.rect, size=row.style.size, bold=row.style.bold, spacing=ONE_SPACING * row.rect.h, space_before=max(0.0, row.rect.t - bottom)))
        bottom = row.rect.b
    return out


# ------------------------------------------------------------------------------ headings


def body_size(blocks: list[Block]) -> float:
    """The half-point size that most characters have; of equals the one that comes first."""
    weight: dict[float, int] = {}
    for b in blocks:
        for s in b.segments:
            k = round(s.size * 2) / 2
            weight[k] = weight.get(k, 0) + len(s.text)
    return max(weight, key=weight.get) if weight else 0.0


def headings(blocks: list[Block]) -> None:
    """Turns large or short bold blocks into headings of level 1 to 3, unless most blocks would be."""
    texts = [b for b in blocks if b.kind == "Paragraph" or b.kind == "ListItem" and b.ordered and len(b.rows) == 1]
    body = body_size(blocks)
    found = []
    for b in texts:
        text = b.flow
        if not text or len(text) > HEAD_LENGTH or len(b.rows) > HEAD_ROWS:
            continue
        large = b.size >= HEAD_SIZE * body
        short = b.bold and len(b.rows) == 1 and b.size >= BOLD_SIZE * body and text.count(" ") < BOLD_WORDS and not text.rstrip().endswith(".")
        if (large or short) and (b.kind == "Paragraph" or large or b.bold):
            found.append(b)
    if not found or len(texts) > HEAD_BLOCKS and len(found) > HEAD_SHARE * len(texts):
        return
    sizes = sorted({round(b.size) for b in found}, reverse=True)
    above = sum(s >= HEAD_SIZE * body for s in sizes)
    for b in found:
        if b.kind == "ListItem":  # the number stays in the heading's text
            b.marker, b.ordered, b.prefix, b.indent, b.rect = None, False, 0, 0.0, around(r.rect for r in b.rows)
        level = sizes.index(round(b.size)) + 1
        if b.size < HEAD_SIZE * body:
            level = max(level, min(LEVELS, above + 1))
        b.kind, b.level = "Heading", max(1, min(LEVELS, level))


# ------------------------------------------------------------------------------ the page


def anchored_sizes(items: list[Item]) -> None:
    """Snaps sizes to the frequent ones: by text length, a half-point size is an anchor unless a kept one is within 9 %."""
    weight: dict[float, int] = {}
    for i in items:
        k = round(i.size * 2) / 2
        weight[k] = weight.get(k, 0) + len(i.text)
    anchors: list[float] = []
    for s in sorted(weight, key=lambda k: -weight[k]):
        if not any(a and abs(a - s) / a <= SNAP for a in anchors):
            anchors.append(s)
    for i in items:
        a = min(anchors, key=lambda x: abs(x - i.size))
        if a and abs(a - i.size) / a <= SNAP:
            i.size = a


def analyse(items: list[Item], width: float, dpi: float, columns: bool = True, snap: bool = False) -> tuple[list[Rect], list[list[Rect]], list[Block]]:
    """(sections, columns of each, blocks in reading order) of a page; items are its lines outside of tables and figures, and these."""
    lines = [i for i in items if i.kind is None]
    if snap and lines:
        anchored_sizes(lines)
    h_med = upper_median([i.rect.h for i in lines], dpi * NO_HEIGHT)
    if not items:
        return [], [], []
    whole = around(i.rect for i in items)
    region, least = (whole.l, whole.r), max(GUTTER_HEIGHTS * h_med, GUTTER_SHARE * width)
    boxes: list[Rect] = []
    cols: list[list[Rect]] = []
    blocks: list[Block] = []
    for k, (found, free) in enumerate(sections(bands(items, h_med), region, least, columns)):
        own = [i for b in found for i in b]
        box = around(i.rect for i in own)
        boxes.append(box)
        edges = [(a + b) / 2 for a, b in free]
        if edges and borderless(found, edges):
            cols.append([box])
            blocks.append(Block("Table", [], box, section=k, cells=[borderless_cells(found, edges, box)]))
            continue
        rects: list[Rect] = []
        for lo, hi in zip([float("-inf"), *edges], [*edges, float("inf")]):
            inside = [i for i in own if lo <= (i.rect.l + i.rect.r) / 2 < hi]
            if not inside:
                continue
            u = around(i.rect for i in inside)
            col = Rect(u.l, box.t, u.r, box.b)
            for b in paragraphs(inside, col, h_med):
                b.section, b.column = k, len(rects)
                blocks.append(b)
            rects.append(col)
        cols.append(rects)
    headings(blocks)
    return boxes, cols, blocks


_BOX = pa.struct([(c, pa.float64()) for c in "ltrb"])
_CELL = pa.struct([("row", pa.int32()), ("col", pa.int32()), ("line_ids", pa.list_(pa.int32())), ("text", pa.string())])
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("page_no", pa.int32()), ("block_no", pa.int32()), ("section_no", pa.int32()), ("column_no", pa.int32()), ("columns", pa.int32()), ("kind", pa.string()), ("heading_level", pa.int32()),
    ("list_marker", pa.string()), ("ordered_list", pa.bool_()), ("prefix", pa.int32()), ("line_ids", pa.list_(pa.int32())), ("rows", pa.int32()), ("text", pa.string()), ("align", pa.string()), ("size_pt", pa.float64()), ("bold", pa.bool_()),
    ("indent", pa.float64()), ("line_spacing", pa.float64()), ("space_before", pa.float64()), ("box", _BOX), ("section_box", _BOX), ("column_box", _BOX), ("special_no", pa.int32()), ("cells", pa.list_(_CELL)), ("col_edges", pa.list_(pa.float64())), ("row_edges", pa.list_(pa.float64())),
])
_DDL = (
    "doc_id bigint, page_no int, block_no int, section_no int, column_no int, columns int, kind string, heading_level int, list_marker string, ordered_list boolean, prefix int, line_ids array<int>, rows int, text string, align string, size_pt double, "
    "bold boolean, indent double, line_spacing double, space_before double, box struct<l:double,t:double,r:double,b:double>, section_box struct<l:double,t:double,r:double,b:double>, column_box struct<l:double,t:double,r:double,b:double>, "
    "special_no int, cells array<struct<row:int,col:int,line_ids:array<int>,text:string>>, col_edges array<double>, row_edges array<double>"
)


def _tuple(r: Rect) -> dict:
    return {"l": r.l, "t": r.t, "r": r.r, "b": r.b}


def cell_text(lines: list[Item]) -> str:
    """Lines of a cell in rows by their centres (against the first of the row), from left to right."""
    rows: list[list[Item]] = []
    for it in sorted(lines, key=lambda i: i.rect.t + i.rect.b):
        first = rows[-1][0].rect if rows else None
        if first and abs(first.t + first.b - it.rect.t - it.rect.b) / 2 < CELL_ROW * min(first.h, it.rect.h):
            rows[-1].append(it)
        else:
            rows.append([it])
    return "\n".join(" ".join(i.text for i in sorted(r, key=lambda i: i.rect.l)) for r in rows)


def _page(mode: str):
    def page(doc: int, page_no: int, rows: list[dict]) -> Iterator[tuple]:
        width, dpi, items = 0.0, 96.0, []
        for x in rows:
            if x["typ"] == 0:
                width, dpi = x["r"] or 0.0, x["size_pt"] or 96.0
                continue
            rect = Rect(x["l"], x["t"], x["r"], x["b"])
            if x["typ"] == 1:
                if (x["text"] or "").strip():
                    items.append(Item(x["num"], rect, x["text"], x["size_pt"] if x["size_pt"] is not None else 11.0, bool(x["bold"]), bool(x["italic"]), x["color"] or 0))
            else:
                items.append(Item(x["num"], rect, kind=x["text"]))
        if mode == "lines":
            items = [i for i in items if i.kind is None]
            blocks = lines_only(items)
            boxes = [around(i.rect for i in items)] if items else []
            cols = [boxes]
        else:
            boxes, cols, blocks = analyse(items, width, dpi, mode != "column", mode == "snap")
        for n, b in enumerate(blocks, 1):
            col = cols[b.section][b.column]
            cells = [{"row": r, "col": c, "line_ids": [i.no for i in own], "text": cell_text(own)} for _, _, found in b.cells for r, c, own in found]
            ids = [s.no for s in b.segments] or [i for c in cells for i in c["line_ids"]]
            yield (
                doc, page_no, n, b.section, b.column, len(cols[b.section]), b.kind, b.level, b.marker, b.ordered, b.prefix, ids, len(b.rows), b.flow if b.rows else "", b.align, b.size, b.bold,
                b.indent, b.spacing, b.space_before, _tuple(b.rect), _tuple(boxes[b.section]), _tuple(col), b.no, cells or None, *(b.cells[0][:2] if b.cells else (None, None)),
            )

    return page


def analysed_blocks(lines: DataFrame, specials: DataFrame, pages: DataFrame, mode: str = "auto") -> DataFrame:
    """A row for each block that the lines of a page form, in reading order.

    lines: with l, t, r, b, text and style columns; specials: tables and figures (block_no, kind, box), whose lines are not among
    the lines; pages: width and effective dpi (null: 96). mode: auto; snap (sizes snapped to frequent ones first); column (one
    column only); lines (a paragraph for each row). Blank and null texts are left out; a page without lines gives no row.
    """
    flat = lambda df, typ, num, text: df.select("doc_id", "page_no", F.lit(typ).alias("typ"), F.col(num).cast("int").alias("num"), text.alias("text"), *[F.col(c).cast("double").alias(c) for c in "ltrb"])
    none = lambda df: df.withColumns({"size_pt": F.lit(None).cast("double"), "bold": F.lit(None).cast("boolean"), "italic": F.lit(None).cast("boolean"), "color": F.lit(None).cast("int")})
    own = lines.select("doc_id", "page_no", F.lit(1).alias("typ"), F.col("line_id").cast("int").alias("num"), "text", *[F.col(c).cast("double").alias(c) for c in "ltrb"], F.col("size_pt").cast("double").alias("size_pt"), "bold", "italic", F.col("color").cast("int").alias("color"))
    zero = F.lit(0.0)
    head = pages.select("doc_id", "page_no", F.lit(0).alias("typ"), F.lit(0).alias("num"), F.lit(None).cast("string").alias("text"), zero.alias("l"), zero.alias("t"), F.col("width").cast("double").alias("r"), zero.alias("b"), F.coalesce(F.col("dpi").cast("double"), F.lit(96.0)).alias("size_pt"), F.lit(None).cast("boolean").alias("bold"), F.lit(None).cast("boolean").alias("italic"), F.lit(None).cast("int").alias("color"))
    rows = own.unionByName(none(flat(specials, 2, "block_no", F.col("kind")))).unionByName(head)
    rows = rows.repartition("doc_id", "page_no").sortWithinPartitions("doc_id", "page_no", "typ", "num")
    return rows.mapInArrow(page_kernel(_page(mode), _SCHEMA), _DDL)
