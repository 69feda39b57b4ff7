"""Pages as markup, from the rows of analysed blocks (dictionaries of one page, in reading order)."""

from __future__ import annotations

import base64
from itertools import groupby
from xml.sax.saxutils import escape

Page = dict


def number(v: float, digits: int = 0) -> str:
    """Rounded half away from zero, as formats of the kind 0 and 0.# do; no trailing zeros."""
    scale = 10**digits
    n = int(abs(v) * scale + 0.5) / scale
    text = f"{n:.{digits}f}"
    text = text.rstrip("0").rstrip(".") if digits else text
    return f"-{text}" if v < 0 and float(text) else text


def html_text(text: str) -> str:
    """Marks of the markup as entities; characters 160 to 255 and those outside of the basic plane by number."""
    out = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#39;")
    return out if out.isascii() else "".join(f"&#{ord(c)};" if 160 <= ord(c) <= 255 or ord(c) > 0xFFFF else c for c in out)


def text_css(b: dict) -> str:
    return f"font-size:{number(b['size_pt'] or 11.0, 1)}pt;font-weight:{700 if b['bold'] else 400}"


def table_html(cells: list[dict], width: float) -> str:
    rows = "".join("<tr>" + "".join(f"<td>{'<br>'.join(map(html_text, c['text'].split(chr(10))))}</td>" for c in sorted(own, key=lambda c: c["col"])) + "</tr>\n" for _, own in groupby(sorted(cells, key=lambda c: (c["row"], c["col"])), key=lambda c: c["row"]))
    return f'<table style="width:{number(width)}px">\n{rows}</table>'


def _list_html(items: list[dict], before: float, left: float, k: float) -> str:
    first, ordered = items[0], items[0]["ordered_list"]
    tag, cls = ("ol", ' class="lit"') if ordered else ("ul", "")
    out = f'<{tag}{cls} style="margin:{number(before * k)}px 0 0 {number(max(0, first["box"]["l"] - left + first["indent"]) * k)}px;padding-left:{number(max(12, -first["indent"]) * k)}px">\n'
    for n, b in enumerate(items):
        gap = f";margin-top:{number(b['space_before'] * k)}px" if n else ""
        mark = f'<span class="m">{html_text(b["list_marker"] or "")}</span>' if ordered else ""
        out += f'<li style="{text_css(b)}{gap}">{mark}{html_text(b["text"])}</li>\n'
    return f"{out}</{tag}>\n"


def blocks_html(blocks: list[dict], left: float, top: float, k: float, images: dict[int, bytes]) -> str:
    """Blocks of a column: neighbouring list items of one kind are one list."""
    out, fresh = "", True
    for (is_list, _, _), own in groupby(enumerate(blocks), key=lambda x: (x[1]["kind"] == "ListItem", x[1]["ordered_list"] if x[1]["kind"] == "ListItem" else None, 0 if x[1]["kind"] == "ListItem" else x[0])):
        items = [b for _, b in own]
        b = items[0]
        before = b["box"]["t"] - top if fresh else b["space_before"]
        fresh = False
        margin = f"margin:{number(before * k)}px 0 0 {number(max(0, b['box']['l'] - left) * k)}px"
        if is_list:
            out += _list_html(items, before, left, k)
        elif b["kind"] == "Figure":
            png = images.get(b["special_no"])
            if png:
                w, h = b["box"]["r"] - b["box"]["l"], b["box"]["b"] - b["box"]["t"]
                out += f'<figure style="{margin}"><img src="data:image/png;base64,{base64.b64encode(png).decode()}" width="{number(w * k)}" height="{number(h * k)}" alt="Figure"></figure>\n'
        elif b["kind"] == "Table":
            out += f'<div style="{margin}">{table_html(b["cells"] or [], (b["box"]["r"] - b["box"]["l"]) * k)}</div>\n'
        else:
            tag = f"h{max(1, min(3, b['heading_level'] or 1))}" if b["kind"] == "Heading" else "p"
            css = f"{text_css(b)};{margin}"
            css += f";text-align:{b['align'].lower()}" if b["align"] != "Left" else ""
            css += f";text-indent:{number(b['indent'] * k)}px" if abs(b["indent"]) > 1 else ""
            css += f";line-height:{number(b['line_spacing'] * k)}px" if b["rows"] > 1 and b["line_spacing"] > 0 else ""
            out += f'<{tag} style="{css}">{html_text(b["text"])}</{tag}>\n'
    return out


def content_box(blocks: list[dict], page: Page) -> dict:
    boxes = [b["section_box"] for b in blocks]
    if not boxes:
        return {"l": 0.0, "t": 0.0, "r": page["width"], "b": page["height"]}
    return {"l": min(x["l"] for x in boxes), "t": min(x["t"] for x in boxes), "r": max(x["r"] for x in boxes), "b": max(x["b"] for x in boxes)}


def by_section(blocks: list[dict]) -> list[list[dict]]:
    return [list(own) for _, own in groupby(blocks, key=lambda b: b["section_no"])]


def flow_html(blocks: list[dict], page: Page, index: int, images: dict[int, bytes] | None = None) -> str:
    """A page as flowing markup: sections, columns as a grid, lists, headings, paragraphs, tables, figures."""
    k, box = 96.0 / page["dpi"], content_box(blocks, page)
    pads = " ".join(f"{number(x * k)}px" for x in (box["t"], page["width"] - box["r"]))
    out = f'<article class="page" id="page-{index + 1}" style="width:{number(page["width"] * k)}px;min-height:{number(page["height"] * k)}px;padding:{pads} {number(min(48, (page["height"] - box["b"]) * k))}px {number(box["l"] * k)}px">\n'
    bottom = None
    for own in by_section(blocks):
        s = own[0]["section_box"]
        top = 0.0 if bottom is None else max(0.0, s["t"] - bottom)
        bottom = s["b"]
        cols = {b["column_no"]: b["column_box"] for b in own}
        if len(cols) > 1:
            rects = [cols[c] for c in sorted(cols)]
            grid = " ".join(f"{number((c['r'] - c['l']) * k)}px" for c in rects)
            gap = max(8.0, (rects[1]["l"] - rects[0]["r"]) * k)
            out += f'<section class="cols" style="grid-template-columns:{grid};column-gap:{number(gap)}px;margin-top:{number(top * k)}px;margin-left:{number((rects[0]["l"] - box["l"]) * k)}px">\n'
            for c in sorted(cols):
                out += "<div>\n" + blocks_html([b for b in own if b["column_no"] == c], cols[c]["l"], s["t"], k, images or {}) + "</div>\n"
        else:
            out += f'<section style="margin-top:{number(top * k)}px">\n' + blocks_html(own, box["l"], s["t"], k, images or {})
        out += "</section>\n"
    return out + "</article>\n"


def block_text(b: dict) -> str:
    """Plain text of a block: a table by tabs, a figure none, others with their marker."""
    if b["kind"] == "Table":
        rows = groupby(sorted(b["cells"] or [], key=lambda c: (c["row"], c["col"])), key=lambda c: c["row"])
        return "\n".join("\t".join(c["text"].replace("\n", " ") for c in own) for _, own in rows).rstrip()
    return "" if b["kind"] == "Figure" else (f"{b['list_marker']} " if b["list_marker"] else "") + b["text"]


def page_text(blocks: list[dict]) -> str:
    """Texts of a page with a blank line between, trimmed at the end, and a line feed."""
    return "\n\n".join(t for t in map(block_text, blocks) if t).rstrip() + "\n"


def plain_html(blocks: list[dict], page: Page, index: int) -> str:
    return f'<article class="page plain" id="page-{index + 1}" style="width:{number(page["width"] * 96.0 / page["dpi"])}px">{html_text(page_text(blocks))}</article>\n'


def exact_html(lines: list[dict], page: Page, index: int) -> str:
    """Positioned lines (top to bottom, left to right); without font metrics no line is stretched."""
    k = 96.0 / page["dpi"]
    out = f'<article class="page exact" id="page-{index + 1}" style="width:{number(page["width"] * k)}px;height:{number(page["height"] * k)}px">\n'
    for x in sorted(lines, key=lambda x: (x["t"], x["l"])):
        size = x["size_pt"] or 11.0
        top = x["t"] + (x["b"] - x["t"]) / 2 - size * page["dpi"] / 72 * 1.2 * 0.55
        out += f'<div class="l" style="left:{number(x["l"] * k, 1)}px;top:{number(top * k, 1)}px;{text_css(x)}">{html_text(x["text"])}</div>\n'
    return out + "</article>\n"


def html_head(title: str, culture: str, font: str) -> str:
    """Everything before the first page; the language is the culture's first two letters."""
    name = font.replace("'", "")
    rules = (
        f"body{{font-family:'{name}',sans-serif;margin:1em}}", ".page{position:relative;margin:0 0 2em}", ".page p,.page h1,.page h2,.page h3,.page ul,.page ol{margin:0}", ".cols{display:grid}",
        "ol.lit{list-style-type:none}", ".exact .l{position:absolute;white-space:pre}", ".plain{white-space:pre-wrap}",
    )
    return f'<!DOCTYPE html>\n<html lang="{culture[:2]}">\n<head>\n<meta charset="utf-8">\n<title>{html_text(title)}</title>\n<style>\n' + "\n".join(rules) + "\n</style>\n</head>\n<body>\n"


HTML_TAIL = "</body>\n</html>\n"

# ------------------------------------------------------------------------------ word-processor markup

# --- fixed values, in twips: least and most margin, most of the bottom one, least width and space of columns, least cell, most space before a paragraph; header's place
MARGIN, MARGIN_MOST, MARGIN_BOTTOM, COLUMN, COLUMN_SPACE, CELL, SPACE_MOST, HEADER = 360, 2880, 720, 720, 144, 120, 2880, 360
# ------------------------------------------------------------------------------------------------
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def twips(px: float, dpi: float) -> int:
    return round(px * 1440 / dpi)


def _run(text: str, size: float, bold: bool = False, italic: bool = False) -> str:
    half = max(2, round(size * 2))
    return f'<w:r><w:rPr>{"<w:b/>" if bold else ""}{"<w:i/>" if italic else ""}<w:sz w:val="{half}"/><w:szCs w:val="{half}"/></w:rPr><w:t xml:space="preserve">{escape(text)}</w:t></w:r>'


def margins(page: Page, box: dict) -> tuple[int, int, int, int]:
    """Left, top, right, bottom in twips, from 360 to 2880, the bottom to 720."""
    fit = lambda px, most: max(MARGIN, min(most, twips(px, page["dpi"])))
    return fit(box["l"], MARGIN_MOST), fit(box["t"], MARGIN_MOST), fit(page["width"] - box["r"], MARGIN_MOST), fit(page["height"] - box["b"], MARGIN_BOTTOM)


def section_xml(page: Page, box: dict, columns: list[dict] | None, first: bool) -> str:
    w, h = twips(page["width"], page["dpi"]), twips(page["height"], page["dpi"])
    left, top, right, bottom = margins(page, box)
    cols = '<w:cols w:space="720"/>'
    if columns and len(columns) > 1:
        own = ""
        for a, b in zip(columns, [*columns[1:], None]):
            space = "" if b is None else f' w:space="{max(COLUMN_SPACE, twips(b["l"] - a["r"], page["dpi"]))}"'
            own += f'<w:col w:w="{max(COLUMN, twips(a["r"] - a["l"], page["dpi"]))}"{space}/>'
        cols = f'<w:cols w:equalWidth="0" w:num="{len(columns)}">{own}</w:cols>'
    turn = ' w:orient="landscape"' if w > h else ""
    return (
        f'<w:sectPr><w:type w:val="{"nextPage" if first else "continuous"}"/><w:pgSz w:w="{w}" w:h="{h}"{turn}/>'
        f'<w:pgMar w:top="{top}" w:right="{right}" w:bottom="{bottom}" w:left="{left}" w:header="{HEADER}" w:footer="{HEADER}" w:gutter="0"/>{cols}</w:sectPr>'
    )


def grid_table(b: dict, dpi: float) -> dict:
    """A table's cells on its grid: edges and cells with their spans and boxes."""
    cells = b["cells"] or []
    n_cols, n_rows = 1 + max((c["col"] for c in cells), default=-1), 1 + max((c["row"] for c in cells), default=-1)
    edges = b.get("col_edges") or [b["box"]["l"] + (b["box"]["r"] - b["box"]["l"]) * k / max(1, n_cols) for k in range(n_cols + 1)]
    return {"cols": n_cols, "rows": n_rows, "widths": [max(CELL, twips(y - x, dpi)) for x, y in zip(edges, edges[1:])], "cells": {(c["row"], c["col"]): c for c in cells}}


def table_xml(b: dict, dpi: float, left: float) -> str:
    t = grid_table(b, dpi)
    out = f'<w:tbl><w:tblPr><w:tblW w:w="{twips(b["box"]["r"] - b["box"]["l"], dpi)}" w:type="dxa"/><w:tblInd w:w="{max(0, twips(b["box"]["l"] - left, dpi))}" w:type="dxa"/><w:tblLayout w:type="fixed"/></w:tblPr>'
    out += "<w:tblGrid>" + "".join(f'<w:gridCol w:w="{w}"/>' for w in t["widths"]) + "</w:tblGrid>"
    for r in range(t["rows"]):
        out += "<w:tr>"
        c = 0
        while c < t["cols"]:
            cell = t["cells"].get((r, c), {"text": "", "col_span": 1, "row_span": 1})
            span = min(cell.get("col_span") or 1, t["cols"] - c)
            props = f'<w:tcW w:w="{sum(t["widths"][c : c + span])}" w:type="dxa"/>' + (f'<w:gridSpan w:val="{span}"/>' if span > 1 else "") + ('<w:vMerge w:val="restart"/>' if (cell.get("row_span") or 1) > 1 else "")
            rows = cell["text"].split("\n") if cell["text"] else [""]
            out += f"<w:tc><w:tcPr>{props}</w:tcPr>" + "".join(f"<w:p>{_run(x, b['size_pt'] or 11.0) if x else ''}</w:p>" for x in rows) + "</w:tc>"
            c += span
        out += "</w:tr>"
    return out + "</w:tbl>"


def block_xml(b: dict, dpi: float, left: float, before: float) -> str:
    if b["kind"] == "Table":
        return table_xml(b, dpi, left)
    if b["kind"] == "Figure":
        return ""
    style = f"Heading{max(1, min(3, b['heading_level'] or 1))}" if b["kind"] == "Heading" else "ListParagraph" if b["kind"] == "ListItem" else None
    props = f'<w:pStyle w:val="{style}"/>' if style else ""
    bullet = b["kind"] == "ListItem" and not b["ordered_list"]
    props += '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>' if bullet else ""
    props += f'<w:spacing w:before="{min(twips(max(0.0, before), dpi), SPACE_MOST)}" w:after="0"/>'
    props += f'<w:ind w:left="{max(0, twips(b["box"]["l"] - left, dpi))}"/>'
    jc = {"Center": "center", "Right": "right", "Justify": "both"}.get(b["align"])
    props += f'<w:jc w:val="{jc}"/>' if jc else ""
    text = (f"{b['list_marker']} " if b["list_marker"] and not bullet else "") + b["text"]
    return f"<w:p><w:pPr>{props}</w:pPr>{_run(text, b['size_pt'] or 11.0, b['bold'])}</w:p>"


def editable_xml(blocks: list[dict], page: Page, first: bool) -> tuple[str, str]:
    """(paragraphs and tables of a page, properties of its last section). Neighbouring one-column sections are one; several columns stand alone."""
    box, dpi = content_box(blocks, page), page["dpi"]
    groups: list[list[list[dict]]] = []
    for own in by_section(blocks):
        several = own[0]["columns"] > 1
        if not groups or several or groups[-1][0][0]["columns"] > 1:
            groups.append([])
        groups[-1].append(own)
    out, bottom, props = "", None, section_xml(page, box, None, True)
    for g, group in enumerate(groups):
        if g:
            out += f"<w:p><w:pPr>{props}</w:pPr></w:p>"
        columns = None
        for own in group:
            s = own[0]["section_box"]
            gap = 0.0 if bottom is None else max(0.0, s["t"] - bottom)
            bottom = s["b"]
            cols = {b["column_no"]: b["column_box"] for b in own}
            columns = [cols[c] for c in sorted(cols)] if len(cols) > 1 else None
            last = None
            for b in own:
                fresh = b["column_no"] != last
                if fresh and last is not None:
                    out += '<w:p><w:r><w:br w:type="column"/></w:r></w:p>'
                before = (gap if last is None else 0.0) + b["box"]["t"] - s["t"] if fresh else b["space_before"]
                left = box["l"] + (b["column_box"]["l"] - columns[0]["l"] if columns else 0.0)
                out += block_xml(b, dpi, left, 0.0 if first and not out else before)
                last = b["column_no"]
        props = section_xml(page, box, columns, g == 0)
    return out, props


def plain_xml(blocks: list[dict]) -> str:
    """One paragraph for each line of text."""
    return "".join(f"<w:p>{_run(line, 11.0) if line else ''}</w:p>" for line in page_text(blocks).rstrip("\n").split("\n"))


def exact_xml(lines: list[dict], page: Page) -> str:
    """Each line in a frame at its place on the page."""
    dpi = page["dpi"]
    out = ""
    for x in sorted(lines, key=lambda x: (x["t"], x["l"])):
        frame = f'<w:framePr w:w="{twips(x["r"] - x["l"], dpi)}" w:hSpace="0" w:wrap="around" w:vAnchor="page" w:hAnchor="page" w:x="{twips(x["l"], dpi)}" w:y="{twips(x["t"], dpi)}"/>'
        out += f"<w:p><w:pPr>{frame}</w:pPr>{_run(x['text'], x['size_pt'] or 11.0, bool(x.get('bold')))}</w:p>"
    return out
