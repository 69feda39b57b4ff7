"""Pages and text characters of PDF files, read without a renderer: enough of the format for text layers in plain fonts.

A file is one record (bytes in, rows out); its objects are found by their marks, streams are inflated, and the content
streams of a page give a row for each character with its box in points from the top left corner.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OBJ = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_NUM = rb"[-+]?(?:\d+\.?\d*|\.\d+)"
_TOKEN = re.compile(rb"\[|\]|<<|>>|<[0-9A-Fa-f\s]*>|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|/[^\s/<>\[\]()]*|" + _NUM + rb"|[A-Za-z'\"*]+", re.S)
#: Characters that a text layer marks as unknown.
NO_CHARS = "�￾"


class BrokenFile(ValueError):
    pass


def _stream(body: bytes) -> bytes:
    m = _STREAM.search(body)
    if not m:
        return b""
    head, data = body[: m.start()], m.group(1)
    if b"FlateDecode" in head:
        try:
            data = zlib.decompressobj().decompress(data)
        except zlib.error:
            return b""
    return data


def _ref(body: bytes, key: bytes) -> int | None:
    m = re.search(rb"/" + key + rb"\s+(\d+)\s+\d+\s+R", body)
    return int(m.group(1)) if m else None


def _refs(body: bytes, key: bytes) -> list[int]:
    m = re.search(rb"/" + key + rb"\s*\[(.*?)\]", body, re.S)
    if m:
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m.group(1))]
    one = _ref(body, key)
    return [] if one is None else [one]


class File:
    def __init__(self, raw: bytes):
        if not raw[:1024].lstrip().startswith(b"%PDF"):
            raise BrokenFile("Cannot open PDF (no header)")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", raw):
            raise BrokenFile("password protected")
        self.objects = {int(n): body for n, body in _OBJ.findall(raw)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        data = _stream(body)
        n, first = (int(re.search(rb"/" + k + rb"\s+(\d+)", body).group(1)) for k in (b"N", b"First"))
        heads = [int(x) for x in data[:first].split()[: 2 * n]]
        ends = [*heads[3::2], len(data) - first]
        for no, a, b in zip(heads[::2], heads[1::2], ends):
            self.objects.setdefault(no, data[first + a : first + b])

    def pages(self) -> list[bytes]:
        """Page objects in the order of the page tree, with what they inherit appended."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), None)
        start = _ref(root, b"Pages") if root else None
        out: list[bytes] = []

        def walk(no: int, above: bytes, depth: int) -> None:
            body = self.objects.get(no, b"")
            if depth > 50:
                return
            if re.search(rb"/Type\s*/Pages\b", body):
                own = b"".join(m.group() for m in re.finditer(rb"/(?:MediaBox|CropBox)\s*\[[^\]]*\]|/Rotate\s+-?\d+|/Resources\s+(?:\d+\s+\d+\s+R|<<.*?>>\s*>>)", body, re.S))
                for kid in _refs(body, b"Kids"):
                    walk(kid, own + above, depth + 1)
            elif body:
                out.append(body + above)

        if start is not None:
            walk(start, b"", 0)
        return out

    def size(self, page: bytes) -> tuple[float, float, float, float]:
        m = re.search(rb"/MediaBox\s*\[\s*(" + _NUM + rb")\s+(" + _NUM + rb")\s+(" + _NUM + rb")\s+(" + _NUM + rb")", page)
        x0, y0, x1, y1 = (float(v) for v in m.groups()) if m else (0.0, 0.0, 612.0, 792.0)
        return min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)

    def content(self, page: bytes) -> bytes:
        return b"\n".join(_stream(self.objects.get(n, b"")) for n in _refs(page, b"Contents"))

    def fonts(self, page: bytes) -> dict[bytes, Font]:
        body = page
        res = _ref(page, b"Resources")
        if res is not None:
            body = self.objects.get(res, b"")
        own = _ref(body, b"Font")
        if own is not None:
            body = self.objects.get(own, b"")
        else:
            m = re.search(rb"/Font\s*<<(.*?)>>", body, re.S)
            body = m.group(1) if m else b""
        return {name: Font(self, self.objects.get(int(no), b"")) for name, no in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", body)}


class Font:
    def __init__(self, file: File, body: bytes):
        m = re.search(rb"/BaseFont\s*/([^\s/<>\[\]()]+)", body)
        self.name = m.group(1).decode("latin-1") if m else ""
        kid = _refs(body, b"DescendantFonts")
        self.wide = bool(kid) or b"Identity-H" in body
        inner = file.objects.get(kid[0], b"") if kid else body
        desc = file.objects.get(_ref(inner, b"FontDescriptor") or -1, b"")
        flags, weight = re.search(rb"/Flags\s+(\d+)", desc), re.search(rb"/FontWeight\s+(\d+)", desc)
        self.italic, self.weight = bool(flags and int(flags.group(1)) & 64), int(weight.group(1)) if weight else None
        self.map = self._unicode(_stream(file.objects.get(_ref(body, b"ToUnicode") or -1, b"")))
        first = re.search(rb"/FirstChar\s+(\d+)", body)
        widths = re.search(rb"/Widths\s*\[(.*?)\]", body, re.S) or (re.search(rb"\[(.*?)\]", file.objects.get(_ref(body, b"Widths") or -1, b""), re.S))
        self.widths = {int(first.group(1)) + i: float(w) for i, w in enumerate(widths.group(1).split())} if first and widths else {}
        for start, own in re.findall(rb"(\d+)\s*\[([^\]]*)\]", (re.search(rb"/W\s*\[(.*)\]", inner, re.S) or [b"", b""])[1]) if kid else []:
            self.widths |= {int(start) + i: float(w) for i, w in enumerate(own.split())}

    @staticmethod
    def _unicode(cmap: bytes) -> dict[int, str]:
        text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
        out: dict[int, str] = {}
        for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
            out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
        for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
            for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                for i in range(int(b, 16) - int(a, 16) + 1):
                    out[int(a, 16) + i] = text(c)[:-1] + chr(ord(text(c)[-1]) + i)
        return out

    def decode(self, raw: bytes) -> Iterator[tuple[str, float, bool]]:
        """(character, width in thousandths, whether it is a blank of one byte)."""
        codes = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw) - 1, 2)] if self.wide else list(raw)
        for c in codes:
            ch = self.map.get(c) if self.map else None
            yield ch if ch is not None else bytes([c]).decode("cp1252", "replace") if c < 256 and not self.wide else "�", self.widths.get(c, 500.0), c == 32 and not self.wide


def _literal(token: bytes) -> bytes:
    if token[:1] == b"<":
        h = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
    special = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b""}
    return re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m.group(1), 8) & 255]) if m.group(1)[:1].isdigit() else special.get(m.group(1), m.group(1)), token[1:-1], flags=re.S)


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def characters(file: File, page: bytes) -> Iterator[tuple]:
    """(ch, l, t, r, b, font_pt, bold weight, italic, color, font) of the shown characters in order, in points from the top left."""
    x0, _, _, y1 = file.size(page)
    fonts = file.fonts(page)
    ctm, color, stack = ONE, 0, []
    tm = lm = ONE
    font, size, spacing, word, scale, lead, rise = None, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0
    args: list = []
    level = lambda v: max(0, min(255, round(float(v) * 255)))

    def show(raw: bytes) -> Iterator[tuple]:
        nonlocal tm
        if font is None:
            return
        for ch, w, blank in font.decode(raw):
            m = _times((size * scale, 0.0, 0.0, size, 0.0, rise), _times(tm, ctm))
            corners = [(u * m[0] + v * m[2] + m[4], u * m[1] + v * m[3] + m[5]) for u, v in ((0, -0.2), (w / 1000, -0.2), (0, 0.8), (w / 1000, 0.8))]
            xs, ys = [c[0] for c in corners], [c[1] for c in corners]
            yield ch, min(xs) - x0, y1 - max(ys), max(xs) - x0, y1 - min(ys), (m[2] ** 2 + m[3] ** 2) ** 0.5, font.weight, font.italic, color, font.name
            tm = _times((1.0, 0.0, 0.0, 1.0, (w / 1000 * size + spacing + (word if blank else 0.0)) * scale, 0.0), tm)

    def line(dx: float, dy: float) -> None:
        nonlocal tm, lm
        tm = lm = _times((1.0, 0.0, 0.0, 1.0, dx, dy), lm)

    inside: list | None = None
    for token in _TOKEN.findall(file.content(page)):
        lead_byte = token[:1]
        if token == b"[":
            inside = []
        elif token == b"]":
            args.append(inside or [])
            inside = None
        elif lead_byte in b"(<" and token not in (b"<<",) or lead_byte == b"/" or lead_byte.isdigit() or lead_byte in b"+-.":
            value = token if lead_byte in b"(</" else float(token)
            (args if inside is None else inside).append(value)
        elif token in (b"<<", b">>"):
            continue
        else:
            op, n = token, [a for a in args if isinstance(a, float)]
            if op == b"q":
                stack.append((ctm, color))
            elif op == b"Q" and stack:
                ctm, color = stack.pop()
            elif op == b"cm" and len(n) >= 6:
                ctm = _times(tuple(n[-6:]), ctm)
            elif op == b"BT":
                tm = lm = ONE
            elif op == b"Tf" and args:
                font, size = fonts.get(args[0][1:] if isinstance(args[0], bytes) else b""), n[-1] if n else size
            elif op in (b"Td", b"TD") and len(n) >= 2:
                lead = -n[-1] if op == b"TD" else lead
                line(n[-2], n[-1])
            elif op == b"Tm" and len(n) >= 6:
                tm = lm = tuple(n[-6:])
            elif op == b"T*":
                line(0.0, -lead)
            elif op in (b"Tc", b"Tw", b"Tz", b"TL", b"Ts") and n:
                spacing, word, scale, lead, rise = (n[-1] if op == b"Tc" else spacing, n[-1] if op == b"Tw" else word, n[-1] / 100 if op == b"Tz" else scale, n[-1] if op == b"TL" else lead, n[-1] if op == b"Ts" else rise)
            elif op == b"g" and n:
                color = level(n[-1]) * 0x010101
            elif op == b"rg" and len(n) >= 3:
                color = level(n[-3]) << 16 | level(n[-2]) << 8 | level(n[-1])
            elif op in (b"Tj", b"'", b'"') and args and isinstance(args[-1], bytes):
                if op != b"Tj":
                    line(0.0, -lead)
                yield from show(_literal(args[-1]))
            elif op == b"TJ" and args and isinstance(args[-1], list):
                for part in args[-1]:
                    if isinstance(part, bytes):
                        yield from show(_literal(part))
                    else:
                        tm = _times((1.0, 0.0, 0.0, 1.0, -part / 1000 * size * scale, 0.0), tm)
            args = []


_PAGES = pa.schema([("path", pa.string()), ("page_no", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), ("error", pa.string())])
_CHARS = pa.schema([
    ("path", pa.string()), ("page_no", pa.int32()), ("char_no", pa.int32()), ("ch", pa.string()), *[(c, pa.float64()) for c in "ltrb"], ("font_pt", pa.float64()), ("weight", pa.int32()), ("italic_flag", pa.bool_()), ("color", pa.int32()), ("font_name", pa.string()),
])


def _each(fn, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = list(fn(path, raw))
                cols = list(zip(*rows)) if rows else [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def pdf_pages(files: DataFrame) -> DataFrame:
    """(path, page_no, width, height, error) in points of the pages of files (path, content); a file that can't be opened is one row with its error."""

    def rows(path: str, raw: bytes | None) -> Iterator[tuple]:
        try:
            file = File(raw or b"")
            for n, page in enumerate(file.pages(), 1):
                x0, y0, x1, y1 = file.size(page)
                yield path, n, x1 - x0, y1 - y0, None
        except Exception as e:
            yield path, None, None, None, str(e)

    return files.select("path", "content").mapInArrow(_each(rows, _PAGES), "path string, page_no int, width double, height double, error string")


def pdf_characters(files: DataFrame) -> DataFrame:
    """Characters of the text layers of files (path, content), in the order in which they are shown; broken files have none."""

    def rows(path: str, raw: bytes | None) -> Iterator[tuple]:
        try:
            file = File(raw or b"")
            for n, page in enumerate(file.pages(), 1):
                for k, x in enumerate(characters(file, page)):
                    yield path, n, k, *x
        except BrokenFile:
            return

    ddl = "path string, page_no int, char_no int, ch string, l double, t double, r double, b double, font_pt double, weight int, italic_flag boolean, color int, font_name string"
    return files.select("path", "content").mapInArrow(_each(rows, _CHARS), ddl)


def render_size(width: float, height: float, dpi: float, most: float = 144e6) -> tuple[int, int]:
    """Pixels of a page at a resolution, made smaller where they were more than most."""
    w, h = width * dpi / 72, height * dpi / 72
    k = min(1.0, (most / (w * h)) ** 0.5) if w * h else 1.0
    return max(1, round(w * k)), max(1, round(h * k))


def visible_characters(chars: DataFrame) -> DataFrame:
    """(path, page_no, visible, enough): characters above the blank but for unknown ones, and whether recognition is needless."""
    seen = (F.ascii("ch") > 0x20) & ~F.col("ch").isin(*NO_CHARS)
    return chars.groupBy("path", "page_no").agg(F.count_if(seen).alias("visible")).withColumn("enough", F.col("visible") >= 16)
