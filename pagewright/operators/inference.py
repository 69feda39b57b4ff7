"""Recognition by networks: the plumbing around sessions, with the weights as files that the caller names.

A session is made once for each Python worker, language and number of threads, and kept; tasks are the parallelism, so a
session has one thread unless told otherwise. Any object with run(tensor) -> array serves as a session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import imaging
from .kernel import to_batch

Session = Callable[[np.ndarray], np.ndarray]
_SESSIONS: dict[tuple, Session] = {}


def session(kind: str, language: str, path: str, threads: int = 1, make: Callable[[str, int], Session] | None = None) -> Session:
    """The worker's session; another number of threads or another file makes a new one in its place."""
    key = (kind, language)
    found = _SESSIONS.get(key)
    if found is None or found[0] != (path, threads):
        _SESSIONS[key] = found = ((path, threads), (make or onnx_session)(path, threads))
    return found[1]


def onnx_session(path: str, threads: int) -> Session:
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = threads
    run = onnxruntime.InferenceSession(path, options)
    name = run.get_inputs()[0].name
    return lambda tensor: run.run(None, {name: tensor})[0]


def detect(img: np.ndarray, net: Session) -> list[tuple[list[tuple[float, float]], float]]:
    """Text boxes of a page in its own pixels, from top to bottom."""
    tensor = imaging.detector_tensor(img)
    h, w = tensor.shape[1:]
    sx, sy = img.shape[1] / w, img.shape[0] / h
    clip = lambda v, most: min(max(v, 0.0), float(most))
    boxes = imaging.text_boxes(np.asarray(net(tensor[None])).reshape(h, w))
    return [([(clip(x * sx, img.shape[1]), clip(y * sy, img.shape[0])) for x, y in quad], score) for quad, score in boxes]


def turned(crops: list[np.ndarray], net: Session, batch: int = 16) -> list[bool]:
    """Which crops stand on their head, by more than 0.9."""
    out: list[bool] = []
    for k in range(0, len(crops), batch):
        p = np.asarray(net(imaging.classifier_tensor(crops[k : k + batch])))
        out += [bool(x[1] > x[0] and x[1] > 0.9) for x in p]
    return out


def recognise(crops: list[np.ndarray], net: Session, symbols: list[str], batch: int = 8) -> list[tuple[str, float, list[float], list[float]]]:
    """(text, confidence, centres, confidences) of crops, read in batches of similar aspect ratio."""
    order = sorted(range(len(crops)), key=lambda i: crops[i].shape[1] / crops[i].shape[0])
    out: list = [None] * len(crops)
    for k in range(0, len(order), batch):
        own = order[k : k + batch]
        tensor, widths = imaging.recogniser_tensor([crops[i] for i in own])
        for i, probs, w in zip(own, np.asarray(net(tensor)), widths):
            out[i] = imaging.ctc_text(probs, symbols, tensor.shape[3], w)
    return out


def character_extents(centres: list[float], x0: float, x1: float) -> list[tuple[float, float]]:
    """Left and right of each character between x0 and x1: half way to its neighbours' centres; the outer ones as far out as in."""
    n = len(centres)
    mid = [(a + b) / 2 for a, b in zip(centres, centres[1:])]
    first = max(0.0, centres[0] - ((centres[1] - centres[0]) / 2 if n > 1 else 0.5)) if n else 0.0
    last = min(1.0, centres[-1] + ((centres[-1] - centres[-2]) / 2 if n > 1 else 0.5)) if n else 0.0
    edges = [first, *mid, last] if n else []
    return [(x0 + a * (x1 - x0), x0 + b * (x1 - x0)) for a, b in zip(edges, edges[1:])]


def page_lines(img: np.ndarray, detector: Session, recogniser: Session, symbols: list[str], classifier: Session | None = None, least: float = 0.5) -> list[dict]:
    """Lines of a page: boxes found, cropped, turned upright, read; without those that are empty or less sure than least, numbered from 1, trimmed with their characters' places."""
    boxes = detect(img, detector)
    crops = [imaging.crop_quad(img, quad) for quad, _ in boxes]
    if classifier is not None:
        crops = [imaging.rotate(c, 180) if t else c for c, t in zip(crops, turned(crops, classifier))]
    out = []
    for (quad, _), (text, conf, centres, confs) in zip(boxes, recognise(crops, recogniser, symbols)):
        a, b = len(text) - len(text.lstrip()), len(text.rstrip())
        if a >= b or conf < least:
            continue
        xs, ys = [p[0] for p in quad], [p[1] for p in quad]
        extents = character_extents(centres[a:b], (quad[0][0] + quad[3][0]) / 2, (quad[1][0] + quad[2][0]) / 2)
        out.append({"line_id": len(out) + 1, "text": text[a:b], "confidence": conf, "l": min(xs), "t": min(ys), "r": max(xs), "b": max(ys), "extents": extents, "confidences": confs[a:b]})
    return out


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("page_no", pa.int32()), ("line_id", pa.int32()), ("text", pa.string()), ("confidence", pa.float64()), *[(c, pa.float64()) for c in "ltrb"], ("status", pa.string()), ("error", pa.string())])
_DDL = "doc_id bigint, page_no int, line_id int, text string, confidence double, l double, t double, r double, b double, status string, error string"


def recognise_pages(images: DataFrame, sessions: Callable[[], tuple[Session, Session, list[str], Session | None]]) -> DataFrame:
    """Lines of page images (doc_id, page_no, width, height, pixels); sessions() is called in each worker. A page that fails is one row with its error, and the others go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector, recogniser, symbols, classifier = sessions()
        for b in batches:
            out = []
            for doc, page, w, h, px in zip(*(b.column(i).to_pylist() for i in range(5))):
                try:
                    img = np.frombuffer(px, np.uint8).reshape(h, w, 3)
                    out += [(doc, page, x["line_id"], x["text"], x["confidence"], x["l"], x["t"], x["r"], x["b"], "Done", None) for x in page_lines(img, detector, recogniser, symbols, classifier)]
                except Exception as e:
                    out.append((doc, page, *(None,) * 7, "Failed", str(e)))
            if out:
                yield to_batch(out, _SCHEMA)

    return images.select("doc_id", "page_no", "width", "height", "pixels").mapInArrow(run, _DDL)
