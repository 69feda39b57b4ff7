"""Pages as sheets: blocks placed on a grid of columns, rows shared by what stands side by side, numbers as numbers."""

from __future__ import annotations

import re
from xml.sax.saxutils import escape

from ..functions.text import NUMBER_CELL

_NUMBER = re.compile(NUMBER_CELL)


def clusters(values: list[float], tolerance: float) -> list[float]:
    """Sorted values without those within the tolerance behind the last kept one."""
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] > tolerance:
            out.append(v)
    return out


def column_name(n: int) -> str:
    """Of a column counted from 0."""
    out, n = "", n + 1
    while n:
        n, m = divmod(n - 1, 26)
        out = chr(65 + m) + out
    return out


def number_cell(text: str) -> tuple[float | None, int | None]:
    """(value, format id) of a cell that is a number; two times None for text."""
    t = text.strip()
    if not _NUMBER.match(t):
        return None, None
    raw = t.rstrip("%").replace(",", "")
    decimals = len(raw.partition(".")[2])
    if t.endswith("%"):
        return float(raw) / 100, 10 if decimals else 9
    if "," in t:
        return float(raw), 4 if decimals else 3
    return float(raw), 0 if decimals > 2 else 2 if decimals else 1


def grid(blocks: list[dict], page: dict) -> list[float]:
    """Edges of the sheet's columns: the content's, those of tables, and the left of each column where there are several."""
    boxes = [b["box"] for b in blocks]
    edges = [min(x["l"] for x in boxes), max(x["r"] for x in boxes)] if boxes else [0.0, page["width"]]
    for b in blocks:
        edges += (b.get("col_edges") or []) if b["kind"] == "Table" else []
        edges += [b["column_box"]["l"]] if b["columns"] > 1 else []
    return clusters(edges, max(8.0, page["width"] * 0.012))


def _entries(blocks: list[dict], page: dict, edges: list[float]) -> list[dict]:
    asof = lambda x: max((i for i in range(len(edges) - 1) if x >= edges[i] - 4), default=0)
    near = lambda x: min(range(len(edges)), key=lambda i: (abs(edges[i] - x), i))
    out = []
    for b in blocks:
        if b["kind"] == "Figure":
            continue
        if b["kind"] == "Table":
            cols, rows = b.get("col_edges") or [b["box"]["l"], b["box"]["r"]], b.get("row_edges") or [b["box"]["t"], b["box"]["b"]]
            for r in range(len(rows) - 1):
                cells = []
                for c in sorted((c for c in b["cells"] or [] if c["row"] == r), key=lambda c: c["col"]):
                    a = near(cols[c["col"]])
                    z = max(a + 1, near(cols[c["col"] + (c.get("col_span") or 1)]))
                    cells.append({"col": a, "span": z - a, "row_span": c.get("row_span") or 1, "text": c["text"]})
                out.append({"t": rows[r], "b": rows[r + 1], "table": True, "height": max(15.0, (rows[r + 1] - rows[r]) * 72 / page["dpi"]), "cells": cells})
            continue
        text = (f"{b['list_marker']} " if b["list_marker"] else "") + b["text"]
        if text:
            a, size = asof(b["box"]["l"]), b["size_pt"] or 11.0
            height = max(15.0, b["rows"] * size * 1.3 + 2 if b["rows"] > 1 else size * 1.35)
            out.append({"t": b["box"]["t"], "b": b["box"]["b"], "table": False, "height": height, "cells": [{"col": a, "span": max(1, near(b["box"]["r"]) - a), "row_span": 1, "text": text}]})
    return out


def sheet_rows(blocks: list[dict], page: dict) -> tuple[list[float], list[list[dict]]]:
    """(column edges, rows of entries): text entries that overlap the first of the last row by more than 0.3, in other columns than all of it, share that row."""
    edges = grid(blocks, page)
    rows: list[list[dict]] = []
    for e in sorted(_entries(blocks, page, edges), key=lambda e: e["t"]):
        first = rows[-1][0] if rows else None
        if first and not e["table"] and not first["table"]:
            both, shorter = min(first["b"], e["b"]) - max(first["t"], e["t"]), min(first["b"] - first["t"], e["b"] - e["t"])
            apart = not any(n["col"] < c["col"] + c["span"] and c["col"] < n["col"] + n["span"] for x in rows[-1] for c in x["cells"] for n in e["cells"])
            if shorter > 0 and both > 0.3 * shorter and apart:
                rows[-1].append(e)
                continue
        rows.append([e])
    return edges, rows


def sheet_cells(blocks: list[dict], page: dict) -> list[tuple[int, int, str, int, int, str, float | None, int | None]]:
    """(row, column, reference, columns, rows, text, value, format id) of the filled cells, one for each place."""
    out = []
    for k, row in enumerate(sheet_rows(blocks, page)[1], 1):
        seen = set()
        for c in sorted((c for e in row for c in e["cells"]), key=lambda c: c["col"]):
            if c["col"] not in seen:
                seen.add(c["col"])
                out.append((k, c["col"], f"{column_name(c['col'])}{k}", c["span"], c["row_span"], c["text"].strip(), *number_cell(c["text"])))
    return out


class Strings:
    """Texts of a workbook, each once."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}

    def __getitem__(self, text: str) -> int:
        return self.at.setdefault(text, len(self.at))

    def xml(self) -> str:
        own = "".join(f'<si><t xml:space="preserve">{escape(t)}</t></si>' for t in self.at)
        return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<sst xmlns="{MAIN}" count="{len(self.at)}" uniqueCount="{len(self.at)}">{own}</sst>'


MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
#: Number formats in the order of the style table; format id -> style.
FORMATS = (0, 1, 2, 3, 4, 9, 10)


def styles_xml() -> str:
    xfs = "".join(f'<xf numFmtId="{f}" fontId="0" fillId="0" borderId="0" xfId="0"{" applyNumberFormat=" + chr(34) + "1" + chr(34) if f else ""}/>' for f in FORMATS)
    return (
        f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<styleSheet xmlns="{MAIN}"><fonts count="1"><font><sz val="11"/><name val="Calibri"/></font></fonts><fills count="2"><fill><patternFill patternType="none"/></fill>'
        f'<fill><patternFill patternType="gray125"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(FORMATS)}">{xfs}</cellXfs></styleSheet>'
    )


def sheet_xml(blocks: list[dict], page: dict, strings: Strings) -> str:
    edges, rows = sheet_rows(blocks, page)
    cols = "".join(f'<col min="{i}" max="{i}" width="{round(max(2.0, (b - a) * 96 / page["dpi"] / 7), 2)}" customWidth="1"/>' for i, (a, b) in enumerate(zip(edges, edges[1:]), 1))
    data, merges = "", []
    cells: dict[int, list] = {}
    for c in sheet_cells(blocks, page):
        cells.setdefault(c[0], []).append(c)
    for k, row in enumerate(rows, 1):
        own = ""
        for _, col, ref, span, row_span, text, value, fmt in cells.get(k, []):
            own += f'<c r="{ref}" s="{FORMATS.index(fmt)}"><v>{value!r}</v></c>' if fmt is not None else f'<c r="{ref}" t="s"><v>{strings[text]}</v></c>'
            if span > 1 or row_span > 1:
                merges.append(f"{ref}:{column_name(col + span - 1)}{k + row_span - 1}")
        data += f'<row r="{k}" ht="{max(e["height"] for e in row):g}" customHeight="1">{own}</row>'
    merged = f'<mergeCells count="{len(set(merges))}">' + "".join(f'<mergeCell ref="{m}"/>' for m in dict.fromkeys(merges)) + "</mergeCells>" if merges else ""
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<worksheet xmlns="{MAIN}">{f"<cols>{cols}</cols>" if cols else ""}<sheetData>{data}</sheetData>{merged}</worksheet>'
