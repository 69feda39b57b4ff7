"""Tables from ruling lines: grids of rules that meet, cells between them, cells without a border merged to rectangles, lines put into cells."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .analysis import overlap_ratio
from .kernel import page_kernel

Rule = tuple[bool, float, float, float]  # horizontal, position, start, end

# --- fixed values: rules of each direction that a grid has, its least width and height, share of an edge that a rule covers, pixels by which a column edge must lie within a line
GRID_RULES, GRID_WIDTH, GRID_HEIGHT, EDGE_SHARE, INNER = 2, 40, 20, 0.5, 2
# ------------------------------------------------------------------------------------------------


class Groups:
    """Disjoint sets."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b

    def members(self) -> list[list[int]]:
        found = defaultdict(list)
        for i in range(len(self.up)):
            found[self.root(i)].append(i)
        return list(found.values())


def rule_groups(rules: list[Rule], tolerance: float) -> list[list[Rule]]:
    """Rules that meet, directly or by others, with at least two of each direction."""
    sets = Groups(len(rules))
    for i, (h, y, x0, x1) in enumerate(rules):
        for j, (v, x, y0, y1) in enumerate(rules):
            if h and not v and x0 - tolerance <= x <= x1 + tolerance and y0 - tolerance <= y <= y1 + tolerance:
                sets.join(i, j)
    groups = [[rules[i] for i in g] for g in sets.members()]
    return [g for g in groups if sum(r[0] for r in g) >= GRID_RULES and sum(not r[0] for r in g) >= GRID_RULES]


def mean_clusters(values: list[float], tolerance: float) -> list[float]:
    """Means of runs of sorted values whose steps don't exceed the tolerance."""
    groups: list[list[float]] = []
    for v in sorted(values):
        if groups and v - groups[-1][-1] <= tolerance:
            groups[-1].append(v)
        else:
            groups.append([v])
    return [sum(g) / len(g) for g in groups]


def rectangles(n_rows: int, n_cols: int, open_edges: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(row, column, rows, columns) of the cells of a grid, where cells (numbered by rows) with an open edge between them are one; each grows to its bounding rectangle until none changes."""
    sets = Groups(n_rows * n_cols)
    for a, b in open_edges:
        sets.join(a, b)
    while True:
        boxes = []
        grown = False
        for g in sets.members():
            r0, r1, c0, c1 = min(i // n_cols for i in g), max(i // n_cols for i in g), min(i % n_cols for i in g), max(i % n_cols for i in g)
            boxes.append((r0, c0, r1 - r0 + 1, c1 - c0 + 1))
            grown |= any([sets.join(r * n_cols + c, g[0]) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)])
        if not grown:
            return sorted(boxes)


def find_table(rules: list[Rule], tolerance: float) -> dict | None:
    """Edges and cells of the table that a group of rules draws; None for a frame, or one too small."""
    hs, vs = [r for r in rules if r[0]], [r for r in rules if not r[0]]
    left, right = min([r[2] for r in hs] + [r[1] for r in vs]), max([r[3] for r in hs] + [r[1] for r in vs])
    top, bottom = min([r[2] for r in vs] + [r[1] for r in hs]), max([r[3] for r in vs] + [r[1] for r in hs])
    rows, cols = mean_clusters([r[1] for r in hs] + [top, bottom], tolerance), mean_clusters([r[1] for r in vs] + [left, right], tolerance)
    if len(rows) < 2 or len(cols) < 2 or right - left < GRID_WIDTH or bottom - top < GRID_HEIGHT:
        return None
    nr, nc = len(rows) - 1, len(cols) - 1
    drawn = lambda own, at, a, b: any(abs(r[1] - at) <= tolerance and overlap_ratio((r[2], r[3]), (a, b)) > EDGE_SHARE for r in own)
    gone = [(r * nc + c, r * nc + c + 1) for r in range(nr) for c in range(nc - 1) if not drawn(vs, cols[c + 1], rows[r], rows[r + 1])]
    gone += [(r * nc + c, (r + 1) * nc + c) for r in range(nr - 1) for c in range(nc) if not drawn(hs, rows[r + 1], cols[c], cols[c + 1])]
    cells = rectangles(nr, nc, gone)
    return {"rows": rows, "cols": cols, "cells": cells} if len(cells) > 1 else None


def split_line(text: str, extents: list[tuple[float, float]] | None, left: float, right: float, edges: list[float]) -> list[tuple[str, float, float]]:
    """Pieces (text, left, right) of a line cut at the inner edges of its table by the centres of its characters; whole without extents."""
    cuts = [x for x in edges[1:-1] if left + INNER < x < right - INNER]
    if not cuts or extents is None or len(extents) != len(text):
        return [(text, left, right)]
    out, start = [], 0
    for x in [*cuts, float("inf")]:
        end = start
        while end < len(text) and sum(extents[end]) / 2 < x:
            end += 1
        a, b = start, end
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((text, left, right) if (a, b) == (0, len(text)) else (text[a:b], extents[a][0], max(extents[a][0] + 1, extents[b - 1][1])))
        start = end
    return out


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("page_no", pa.int32()), ("table_no", pa.int32()), *[(c, pa.int32()) for c in ("row", "col", "row_span", "col_span")], *[(c, pa.float64()) for c in "ltrb"]])
_DDL = "doc_id bigint, page_no int, table_no int, row int, col int, row_span int, col_span int, l double, t double, r double, b double"


def ruled_cells(rules: DataFrame, tolerance: float = 6.0) -> DataFrame:
    """(page, table_no, row, col, row_span, col_span, box) of the cells of all tables that rules (horizontal, pos, start, end) draw."""

    def page(doc: int, page_no: int, rows: list[dict]) -> Iterator[tuple]:
        tables = [t for g in rule_groups([(x["horizontal"], x["pos"], x["start"], x["end"]) for x in rows], tolerance) if (t := find_table(g, tolerance))]
        tables.sort(key=lambda t: (t["rows"][0], t["cols"][0]))
        for k, t in enumerate(tables):
            for r, c, nr, nc in t["cells"]:
                yield doc, page_no, k, r, c, nr, nc, t["cols"][c], t["rows"][r], t["cols"][c + nc], t["rows"][r + nr]

    own = rules.select("doc_id", "page_no", "horizontal", F.col("pos").cast("double").alias("pos"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    own = own.repartition("doc_id", "page_no").sortWithinPartitions("doc_id", "page_no", "horizontal", "pos", "start", "end")
    return own.mapInArrow(page_kernel(page, _SCHEMA), _DDL)


def cell_rows(lines: list[dict]) -> list[list[dict]]:
    """Lines of a cell in rows: a line joins the last row if its centre is less than half a (smaller) height from that of the row's first line; rows from left to right."""
    rows: list[list[dict]] = []
    for x in sorted(lines, key=lambda x: x["t"] + x["b"]):
        first = rows[-1][0] if rows else None
        if first and abs(first["t"] + first["b"] - x["t"] - x["b"]) < min(first["b"] - first["t"], x["b"] - x["t"]):
            rows[-1].append(x)
        else:
            rows.append([x])
    return [sorted(r, key=lambda x: x["l"]) for r in rows]
