"""Headers of image files: sizes, resolution and frames, without decoding a pixel."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .pdf import _each


def _tiff_frames(raw: bytes) -> list[dict[int, int]]:
    """Tags of each frame of a TIFF file, along its chain of directories; a loop ends it."""
    end = "<" if raw[:2] == b"II" else ">"
    (at,) = struct.unpack(end + "I", raw[4:8])
    out, seen = [], set()
    while at and at not in seen and at + 2 <= len(raw):
        seen.add(at)
        (n,) = struct.unpack(end + "H", raw[at : at + 2])
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack(end + "HHI", raw[at + 2 + 12 * k : at + 10 + 12 * k])
            value = raw[at + 10 + 12 * k : at + 14 + 12 * k]
            tags[tag] = struct.unpack(end + "H", value[:2])[0] if kind == 3 else struct.unpack(end + "I", value)[0]
            if kind == 5:
                a, b = struct.unpack(end + "II", raw[tags[tag] : tags[tag] + 8])
                tags[tag] = a / b if b else 0
        out.append(tags)
        (at,) = struct.unpack(end + "I", raw[at + 2 + 12 * n : at + 6 + 12 * n])
    return out


def image_frames(raw: bytes) -> list[tuple[int, int, float | None]]:
    """(width, height, dpi) of each frame; only TIFF files have more than one."""
    if raw[:4] in (b"II*\0", b"MM\0*"):
        return [(t.get(256, 0), t.get(257, 0), float(t[282]) * (2.54 if t.get(296) == 3 else 1) if t.get(282) else None) for t in _tiff_frames(raw)]
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        w, h = struct.unpack(">II", raw[16:24])
        k = raw.find(b"pHYs")
        return [(w, h, struct.unpack(">I", raw[k + 4 : k + 8])[0] * 0.0254 if k > 0 and raw[k + 12] == 1 else None)]
    if raw[:6] in (b"GIF87a", b"GIF89a"):
        return [(*struct.unpack("<HH", raw[6:10]), None)]
    if raw[:2] == b"BM":
        w, h = struct.unpack("<ii", raw[18:26])
        (per_metre,) = struct.unpack("<i", raw[38:42])
        return [(w, abs(h), per_metre * 0.0254 if per_metre > 0 else None)]
    if raw[:2] == b"\xff\xd8":
        at, dpi = 2, None
        while at + 9 < len(raw):
            mark, n = raw[at + 1], struct.unpack(">H", raw[at + 2 : at + 4])[0]
            if mark == 0xE0 and raw[at + 4 : at + 8] == b"JFIF" and raw[at + 11] in (1, 2):
                dpi = struct.unpack(">H", raw[at + 12 : at + 14])[0] * (2.54 if raw[at + 11] == 2 else 1.0)
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", raw[at + 5 : at + 9])
                return [(w, h, dpi)]
            at += 2 + n
    raise ValueError("unknown image format")


_SCHEMA = pa.schema([("path", pa.string()), ("page_no", pa.int32()), ("label", pa.string()), ("frame_index", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("dpi", pa.float64())])


def image_pages(files: DataFrame) -> DataFrame:
    """(path, page_no, label, frame_index, width, height, dpi) of image files (path, content): a page for each frame, labelled by the file's name or, of several, "Page n". A file whose frames can't be counted is one page without a size."""

    def rows(path: str, raw: bytes | None) -> Iterator[tuple]:
        try:
            frames = image_frames(raw or b"")
        except Exception:
            frames = []
        frames = frames or [(None, None, None)]
        name = path.replace("\\", "/").rsplit("/", 1)[-1]
        for k, (w, h, dpi) in enumerate(frames):
            yield path, k + 1, name if len(frames) == 1 else f"Page {k + 1}", k, w, h, dpi

    ddl = "path string, page_no int, label string, frame_index int, width int, height int, dpi double"
    return files.select("path", "content").mapInArrow(_each(rows, _SCHEMA), ddl)
