"""Documents written as files, one task for each document at a time, page by page.

Pages come sorted by document and page, so a document of any length streams through one writer. A file is written beside
its place and moved there when it is whole; a document that fails is a row with its error, and the others go on.
"""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.kernel import to_batch
from . import markup, sheets

_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


class TextFile:
    """Pages of text, a form feed and a line feed between, with a byte order mark."""

    end = "txt"

    def __init__(self, path: str, title: str, mode: str):
        self.out, self.pages = open(path, "w", encoding="utf-8-sig", newline=""), 0

    def page(self, blocks: list[dict], page: dict) -> None:
        self.out.write(("\f\n" if self.pages else "") + markup.page_text(blocks))
        self.pages += 1

    def close(self) -> None:
        self.out.close()


class HtmlFile:
    end = "html"

    def __init__(self, path: str, title: str, mode: str):
        self.out, self.pages, self.mode = open(path, "w", encoding="utf-8", newline=""), 0, mode
        self.out.write(markup.html_head(title, "en-US", "Calibri"))

    def page(self, blocks: list[dict], page: dict) -> None:
        write = markup.plain_html if self.mode == "plain" else markup.flow_html
        self.out.write(write(blocks, page, self.pages))
        self.pages += 1

    def close(self) -> None:
        self.out.write(markup.HTML_TAIL)
        self.out.close()


def _relations(*targets: tuple[str, str]) -> str:
    own = "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/{kind}" Target="{target}"/>' for i, (kind, target) in enumerate(targets, 1))
    return f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{own}</Relationships>'


def _types(*parts: tuple[str, str]) -> str:
    own = "".join(f'<Override PartName="{name}" ContentType="application/vnd.openxmlformats-officedocument.{kind}+xml"/>' for name, kind in parts)
    return f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{own}</Types>'


class WordFile:
    """The body is streamed into its part of the package; the last section's properties close it."""

    end = "docx"

    def __init__(self, path: str, title: str, mode: str):
        self.zip, self.mode, self.props = zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED), mode, None
        put = self.zip.writestr
        put("[Content_Types].xml", _types(("/word/document.xml", "wordprocessingml.document.main"), ("/word/styles.xml", "wordprocessingml.styles"), ("/word/numbering.xml", "wordprocessingml.numbering")))
        put("_rels/.rels", _relations(("officeDocument", "word/document.xml")))
        put("word/_rels/document.xml.rels", _relations(("styles", "styles.xml"), ("numbering", "numbering.xml")))
        heads = "".join(
            f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:name w:val="heading {k}"/><w:basedOn w:val="Normal"/><w:pPr><w:keepNext/><w:outlineLvl w:val="{k - 1}"/></w:pPr><w:rPr><w:b/><w:sz w:val="{36 - 6 * k}"/></w:rPr></w:style>' for k in (1, 2, 3)
        )
        put("word/styles.xml", f'{_HEAD}<w:styles {markup.W}><w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style>{heads}<w:style w:type="paragraph" w:styleId="ListParagraph"><w:name w:val="List Paragraph"/><w:basedOn w:val="Normal"/></w:style></w:styles>')
        level = '<w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="bullet"/><w:lvlText w:val="•"/><w:lvlJc w:val="left"/><w:pPr><w:ind w:left="720" w:hanging="360"/></w:pPr></w:lvl>'
        put("word/numbering.xml", f'{_HEAD}<w:numbering {markup.W}><w:abstractNum w:abstractNumId="1">{level}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="1"/></w:num></w:numbering>')
        self.out = self.zip.open("word/document.xml", "w", force_zip64=True)
        self.out.write(f"{_HEAD}<w:document {markup.W}><w:body>".encode())

    def page(self, blocks: list[dict], page: dict) -> None:
        if self.props is not None:
            self.out.write(f"<w:p><w:pPr>{self.props}</w:pPr></w:p>".encode())
        if self.mode == "plain":
            body, self.props = markup.plain_xml(blocks), markup.section_xml(page, markup.content_box(blocks, page), None, True)
        else:
            body, self.props = markup.editable_xml(blocks, page, self.props is None)
        self.out.write(body.encode())

    def close(self) -> None:
        self.out.write(f"{self.props or ''}</w:body></w:document>".encode())
        self.out.close()
        self.zip.close()


class SheetFile:
    """A sheet for each page; texts shared by all sheets."""

    end = "xlsx"

    def __init__(self, path: str, title: str, mode: str):
        self.zip, self.strings, self.pages = zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED), sheets.Strings(), 0

    def page(self, blocks: list[dict], page: dict) -> None:
        self.pages += 1
        self.zip.writestr(f"xl/worksheets/sheet{self.pages}.xml", sheets.sheet_xml(blocks, page, self.strings))

    def close(self) -> None:
        names = range(1, self.pages + 1)
        put = self.zip.writestr
        put("xl/sharedStrings.xml", self.strings.xml())
        put("xl/styles.xml", sheets.styles_xml())
        own = "".join(f'<sheet name="Page {i}" sheetId="{i}" r:id="rId{i}"/>' for i in names)
        put("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{sheets.MAIN}" xmlns:r="{_OFFICE}"><sheets>{own}</sheets></workbook>')
        put("xl/_rels/workbook.xml.rels", _relations(*[("worksheet", f"worksheets/sheet{i}.xml") for i in names], ("sharedStrings", "sharedStrings.xml"), ("styles", "styles.xml")))
        put("_rels/.rels", _relations(("officeDocument", "xl/workbook.xml")))
        put("[Content_Types].xml", _types(("/xl/workbook.xml", "spreadsheetml.sheet.main"), ("/xl/sharedStrings.xml", "spreadsheetml.sharedStrings"), ("/xl/styles.xml", "spreadsheetml.styles"), *[(f"/xl/worksheets/sheet{i}.xml", "spreadsheetml.worksheet") for i in names]))
        self.zip.close()


WRITERS = {"txt": TextFile, "html": HtmlFile, "docx": WordFile, "xlsx": SheetFile}
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("path", pa.string()), ("pages", pa.int32()), ("bytes", pa.int64()), ("status", pa.string()), ("error", pa.string())])
_DDL = "doc_id bigint, path string, pages int, bytes bigint, status string, error string"


def export_documents(blocks: DataFrame, pages: DataFrame, folder: str, fmt: str = "txt", mode: str = "flow") -> DataFrame:
    """Writes each document with recognised pages to folder/doc_id.fmt, a folder that all executors share; a row for each: (doc_id, path, pages, bytes, status, error).

    blocks: rows of analysed blocks; pages: (doc_id, page_no, width, dpi, height) of the pages to write. A page without blocks is an empty page; a document
    without pages has no row in pages and so no file. status is Done or Failed; a task that runs again writes its files anew.
    """
    if fmt not in WRITERS:
        raise ValueError(f"no writer for {fmt}")
    parts = F.array_sort(F.collect_list(F.struct([c for c in blocks.columns if c not in ("doc_id", "page_no")])))
    own = blocks.groupBy("doc_id", "page_no").agg(parts.alias("blocks"))
    rows = pages.select("doc_id", "page_no", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"), F.coalesce(F.col("dpi").cast("double"), F.lit(96.0)).alias("dpi"))
    rows = rows.join(own, ["doc_id", "page_no"], "left").repartition("doc_id").sortWithinPartitions("doc_id", "page_no")
    place = folder.removeprefix("file://")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = writer = error = None
        n, out = 0, []

        def close() -> None:
            path, err = f"{place}/{doc}.{fmt}", error
            try:
                if writer is not None:
                    writer.close()
                if err is None:
                    os.replace(f"{path}.tmp", path)
            except Exception as e:
                err = str(e)
            if err is not None and os.path.exists(f"{path}.tmp"):
                os.remove(f"{path}.tmp")
            done = err is None
            out.append((doc, path if done else None, n, os.path.getsize(path) if done else None, "Done" if done else "Failed", err))

        for b in batches:
            for row in b.to_pylist():
                if row["doc_id"] != doc:
                    if doc is not None:
                        close()
                    doc, writer, error, n = row["doc_id"], None, None, 0
                    try:
                        os.makedirs(place, exist_ok=True)
                        writer = WRITERS[fmt](f"{place}/{doc}.{fmt}.tmp", str(doc), mode)
                    except Exception as e:
                        error = str(e)
                if error is None:
                    try:
                        writer.page(row["blocks"] or [], {"width": row["width"] or 0.0, "height": row["height"] or 0.0, "dpi": row["dpi"]})
                        n += 1
                    except Exception as e:  # the document fails, the batch goes on
                        error = str(e)
        if doc is not None:
            close()
        yield to_batch(out, _SCHEMA)

    return rows.mapInArrow(run, _DDL)
