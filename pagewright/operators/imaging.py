"""Pixel kernels of a page image: arrays of RGB bytes (height, width, 3), whole-array operations, called from Arrow batches.

An image is one value of one row; nothing here looks beyond its own image.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# --- fixed values: statistics that networks were trained with -----------------------------------
DETECTOR_MEAN, DETECTOR_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
# ------------------------------------------------------------------------------------------------
Box = tuple[float, float, float, float]


def grey(img: np.ndarray) -> np.ndarray:
    r, g, b = (img[..., k].astype(np.int32) for k in range(3))
    return (29 * b + 150 * g + 77 * r) >> 8


def histogram(values: np.ndarray) -> np.ndarray:
    return np.bincount(values.ravel(), minlength=256)


def otsu(hist: np.ndarray) -> int:
    """The first threshold with the greatest variance between both classes; 128 for an empty histogram or one grey."""
    w = np.cumsum(hist)[:-1].astype(float)
    rest = hist.sum() - w
    ok = (w > 0) & (rest > 0)
    if not ok.any():
        return 128
    s = np.cumsum(hist * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where(ok, w * rest * (s[:-1] / w - (s[-1] - s[:-1]) / rest) ** 2, -1.0)
    return int(between.argmax())


def ink(img: np.ndarray, most: int = 200) -> np.ndarray:
    """Pixels at or under the threshold, which is never above most."""
    g = grey(img)
    return g <= min(most, otsu(histogram(g)))


def color_mode(samples: np.ndarray, bits: int) -> tuple[tuple[int, int, int], float]:
    """(middle of the commonest cell of colours of so many bits each, its share); of equals the one met first."""
    q = samples.reshape(-1, 3) >> (8 - bits)
    keys = (q[:, 0].astype(np.int64) << 2 * bits) | (q[:, 1].astype(np.int64) << bits) | q[:, 2]
    found, first, n = np.unique(keys, return_index=True, return_counts=True)
    best = min(range(len(found)), key=lambda i: (-n[i], first[i]))
    step, mask = 1 << (8 - bits), (1 << bits) - 1
    return tuple(int(found[best] >> s & mask) * step + step // 2 for s in (2 * bits, bits, 0)), n[best] / len(keys)


def page_background(img: np.ndarray) -> tuple[int, int, int]:
    step = max(1, min(img.shape[:2]) // 150)
    c, _ = color_mode(img[::step, ::step], 4)
    return (255, 255, 255) if min(c) > 225 else c


def _distance(a, b) -> int:
    return sum(abs(int(x) - int(y)) for x, y in zip(a, b))


def _free_samples(img: np.ndarray, box: Box, taken: list[Box], step: int) -> np.ndarray:
    """Pixels on a grid of a box outside of other boxes."""
    h, w = img.shape[:2]
    x, y = np.meshgrid(np.arange(box[0], box[2], step), np.arange(box[1], box[3], step))
    free = np.ones(x.shape, dtype=bool)
    for l, t, r, b in taken:  # noqa: E741
        free &= ~((x >= l) & (x < r) & (y >= t) & (y < b))
    ix, iy = x.astype(int), y.astype(int)
    free &= (ix >= 0) & (iy >= 0) & (ix < w) & (iy < h)
    return img[iy[free], ix[free]]


def cell_fill(img: np.ndarray, box: Box, texts: list[Box], background) -> tuple[int, int, int] | None:
    """Fill of a table cell, away from its text and borders; None if it is the page's background."""
    dx, dy = min(6, (box[2] - box[0]) / 6), min(6, (box[3] - box[1]) / 6)
    inner = (box[0] + dx, box[1] + dy, box[2] - dx, box[3] - dy)
    own = _free_samples(img, inner, texts, max(2, int(min(inner[2] - inner[0], inner[3] - inner[1]) / 12)))
    if not len(own):
        return None
    c, _ = color_mode(own, 5)
    return c if _distance(c, background) > 36 else None


def flat_fill(img: np.ndarray, box: Box, texts: list[Box]) -> bool:
    """Whether a region is of one colour but for its text, by over 0.8 of samples."""
    own = _free_samples(img, box, texts, max(2, int(min(box[2] - box[0], box[3] - box[1]) / 20)))
    return len(own) > 0 and color_mode(own, 3)[1] > 0.8


def snapped(c) -> tuple[int, int, int]:
    """Near black, near white and greyish colours made clean."""
    high, low = max(c), min(c)
    if high < 80 and high - low < 30:
        return 0, 0, 0
    if low > 225:
        return 255, 255, 255
    if high - low < 18:
        return (min(255, round(sum(c) // 3 / 16) * 16),) * 3
    return tuple(int(x) for x in c)


def rule_color(img: np.ndarray, rules: list[tuple[bool, float, float, float]]) -> tuple[int, int, int]:
    """Mean colour along rules (horizontal, pos, start, end), made clean; black without any."""
    own = []
    for flat, pos, start, end in rules:
        at = np.arange(start, end, max(1.0, (end - start) / 20)).astype(int)
        fixed = np.full(len(at), int(pos))
        x, y = (at, fixed) if flat else (fixed, at)
        ok = (x >= 0) & (y >= 0) & (x < img.shape[1]) & (y < img.shape[0])
        own.append(img[y[ok], x[ok]])
    own = np.concatenate(own) if own else np.empty((0, 3))
    return snapped(tuple(int(v) for v in own.astype(np.int64).sum(axis=0) // len(own))) if len(own) else (0, 0, 0)


def measure_ink(img: np.ndarray, box: Box, background) -> dict | None:
    """Box, colour and background of a line's ink, and its stroke width (twice its area over its outline); None where there is no text."""
    x0, y0, x1, y1 = max(0, round(box[0])), max(0, round(box[1])), min(img.shape[1], round(box[2])), min(img.shape[0], round(box[3]))
    if x1 - x0 < 3 or y1 - y0 < 3:
        return None
    part = img[y0:y1, x0:x1]
    g = grey(part)
    hist = histogram(g)
    t = otsu(hist)
    dark, light = g <= t, g > t
    mean = lambda m, none: float(g[m].mean()) if m.any() else none
    page = (background[0] * 77 + background[1] * 150 + background[2] * 29) >> 8
    if abs(mean(light, 255.0) - page) < 40:
        is_dark = True
    else:
        is_dark = not abs(mean(dark, 0.0) - page) < 40 and int(dark.sum()) <= g.size // 2
    mask = dark if is_dark else light
    seen = np.flatnonzero(hist)
    strong = g <= max(0, t - (t - seen[0]) // 2) if is_dark else g >= min(255, t + (seen[-1] - t) // 2)
    if not (mask & strong).any() or mask.all():
        return None
    edge = sum(int((a & ~b).sum() + (b & ~a).sum()) for a, b in ((mask[:, 1:], mask[:, :-1]), (mask[1:], mask[:-1])))
    rows, cols = mask.sum(axis=1), np.flatnonzero(mask.any(axis=0))
    body = np.flatnonzero(rows >= max(1, rows.max() // 6))
    top, bottom = int(body[0]), int(body[-1])
    weak = max(1, mask.shape[1] // 500)
    while top > 0 and rows[top - 1] >= weak:
        top -= 1
    while bottom < len(rows) - 1 and rows[bottom + 1] >= weak:
        bottom += 1
    if top >= bottom:
        return None
    color = lambda m: tuple(int(v) for v in part[m].astype(np.int64).sum(axis=0) // m.sum())
    return {"box": (x0 + int(cols[0]), y0 + top, x0 + int(cols[-1]) + 1, y0 + bottom + 1), "color": color(mask & strong), "back": color(~mask), "stroke": 2.0 * int(mask.sum()) / edge if edge else 0.0}


# ------------------------------------------------------------------------------ runs, strokes, components


def ink_runs(mask: np.ndarray, horizontal: bool, least: int, gap: int) -> list[tuple[int, int, int]]:
    """(row, start, end) of runs of ink along rows (or columns), bridging gaps of up to gap, of at least least pixels."""
    own = mask if horizontal else mask.T
    out = []
    for k in np.flatnonzero(own.any(axis=1)):
        at = np.flatnonzero(own[k])
        cut = np.flatnonzero(np.diff(at) > gap + 1)
        starts, ends = at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]] + 1
        out += [(int(k), int(a), int(b)) for a, b in zip(starts, ends) if b - a >= least]
    return out


def strokes(runs: list[tuple[int, int, int]], thick: int, gap: int) -> list[dict]:
    """Rules from runs: runs that overlap in neighbouring rows are a stroke, thick ones are areas and dropped; pieces in line are one rule."""
    groups: list[list[tuple[int, int, int]]] = []
    alive: list[int] = []
    for run in sorted(runs, key=lambda r: r[0]):
        alive = [i for i in alive if run[0] - groups[i][-1][0] <= 1]
        home = next((i for i in alive if run[1] < groups[i][-1][2] and run[2] > groups[i][-1][1]), None)
        if home is None:
            alive.append(len(groups))
            groups.append([run])
        else:
            groups[home].append(run)
    pieces = [{"pos": (g[0][0] + g[-1][0] + 1) / 2, "start": min(r[1] for r in g), "end": max(r[2] for r in g), "thick": g[-1][0] - g[0][0] + 1} for g in groups if g[-1][0] - g[0][0] < thick]
    out: list[dict] = []
    for p in sorted(pieces, key=lambda p: (p["pos"], p["start"])):
        near = next((x for x in out if abs(x["pos"] - p["pos"]) <= 2 and p["start"] <= x["end"] + 4 * gap and p["end"] >= x["start"] - 4 * gap), None)
        if near is None:
            out.append(p)
        else:
            near |= {"start": min(near["start"], p["start"]), "end": max(near["end"], p["end"]), "thick": max(near["thick"], p["thick"])}
    return out


def clear_beside(mask: np.ndarray, rule: dict, horizontal: bool) -> bool:
    """Whether less than half of either side of a rule is ink; at the image's edge it is taken as clear."""
    own = mask if horizontal else mask.T
    off = math.ceil(rule["thick"] / 2) + 2
    before, after = int(rule["pos"]) - off, int(rule["pos"]) + off
    if before < 0 or after >= own.shape[0]:
        return True
    span = slice(int(rule["start"]), int(rule["end"]), 2)
    a, b = own[before, span], own[after, span]
    return len(a) > 0 and 2 * int(a.sum()) < len(a) and 2 * int(b.sum()) < len(b)


def page_rules(mask: np.ndarray, dpi: float) -> list[tuple[bool, float, float, float]]:
    """(horizontal, pos, start, end) of the rules of a page."""
    h, w = mask.shape
    least, thick, gap = int(max(dpi / 4, min(h, w) / 40)), int(max(3, dpi / 25)), int(max(2, dpi / 100))
    out = []
    for flat in (True, False):
        out += [(flat, r["pos"], float(r["start"]), float(r["end"])) for r in strokes(ink_runs(mask, flat, least, gap), thick, gap) if clear_beside(mask, r, flat)]
    return out


def dilated(mask: np.ndarray, radius: int = 2) -> np.ndarray:
    """Grown by a square of the radius: along rows, then along columns."""
    out = mask
    for axis in (1, 0):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (radius, radius)
        wide = np.pad(out, pad)
        n = out.shape[axis]
        out = np.any([wide.take(range(k, k + n), axis=axis) for k in range(2 * radius + 1)], axis=0)
    return out


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of the parts that hang together over sides and corners: runs of each row are joined to those they touch in the row above."""
    h, w = mask.shape
    up: list[int] = [0]

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    runs: list[list[tuple[int, int, int]]] = []
    for y in range(h):
        step = np.diff(np.r_[0, mask[y].astype(np.int8), 0])
        row = []
        for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)):
            up.append(len(up))
            me = len(up) - 1
            for s, e, i in runs[-1] if runs else ():
                if s <= b and e >= a:
                    x, z = sorted((root(i), root(me)))
                    up[z] = x
            row.append((int(a), int(b), me))
        runs.append(row)
    names: dict[int, int] = {}
    out = np.zeros((h, w), dtype=np.int32)
    for y, row in enumerate(runs):
        for a, b, i in row:
            out[y, a:b] = names.setdefault(root(i), len(names) + 1)
    return out


def merged_rects(rects: list[Box], pad: float) -> list[Box]:
    """Rectangles united, until none touches another one grown by pad."""
    out = list(rects)
    again = True
    while again:
        again = False
        for i, (l, t, r, b) in enumerate(out):  # noqa: E741
            j = next((j for j in range(i + 1, len(out)) if l - pad < out[j][2] and r + pad > out[j][0] and t - pad < out[j][3] and b + pad > out[j][1]), None)
            if j is not None:
                x = out.pop(j)
                out[i] = (min(l, x[0]), min(t, x[1]), max(r, x[2]), max(b, x[3]))
                again = True
                break
    return out


def figure_grid(img: np.ndarray, background, clear: list[tuple[Box, float]], cell: int) -> np.ndarray:
    """Cells of which a quarter or more differs from the background, less those of text, rules and tables (with their margins)."""
    h, w = img.shape[:2]
    gh, gw = -(-h // cell), -(-w // cell)
    far = np.abs(img.astype(np.int32) - np.array(background)).sum(axis=2) > 60
    full = np.pad(far, ((0, gh * cell - h), (0, gw * cell - w)))
    grid = full.reshape(gh, cell, gw, cell).sum(axis=(1, 3)) * 4 >= cell * cell
    for (l, t, r, b), pad in clear:  # noqa: E741
        grid[max(0, int((t - pad) / cell)) : int((b + pad) / cell) + 1, max(0, int((l - pad) / cell)) : int((r + pad) / cell) + 1] = False
    return grid


def figure_boxes(img: np.ndarray, background, texts: list[Box], rules: list[Box], tables: list[Box], dpi: float) -> list[Box]:
    """Pictures of a page: what differs from its background outside of text, in parts that hang together over two cells."""
    cell = max(2, round(dpi / 50))
    h, w = img.shape[:2]
    clear = [(x, (x[3] - x[1]) * 0.15 + cell) for x in texts] + [(x, cell) for x in rules] + [(x, cell * 2) for x in tables]
    grid = figure_grid(img, background, clear, cell)
    labels = components(dilated(grid, 2))
    side, area = max(dpi * 0.2, min(w, h) * 0.02), float(w * h)
    found = []
    for k in range(1, int(labels.max(initial=0)) + 1):
        ys, xs = np.nonzero(labels == k)
        x0, x1, y0, y1 = int(xs.min()), int(xs.max()), int(ys.min()), int(ys.max())
        box = (min(x0 + 2, x1), min(y0 + 2, y1), max(x1 - 1, x0 + 1), max(y1 - 1, y0 + 1))
        l, t, r, b = box[0] * cell, box[1] * cell, min(w, box[2] * cell), min(h, box[3] * cell)  # noqa: E741
        if r - l < side or b - t < side or (r - l) * (b - t) < area * 0.002 or int((grid & (labels == k)).sum()) < 20:
            continue
        edge = l <= cell or t <= cell or r >= w - cell or b >= h - cell
        if edge and max((r - l) / (b - t), (b - t) / (r - l)) > 12 or (r - l) * (b - t) > area * 0.85:
            continue
        found.append((float(l), float(t), float(r), float(b)))
    return merged_rects(found, cell)


def bullet_glyph(mask: np.ndarray, line: Box, others: list[Box]) -> Box | None:
    """A small solid blob left of a line, centred on it, in a window that no other line touches; None if there is none."""
    l, t, _, b = line  # noqa: E741
    th, cy = b - t, (t + b) / 2
    win = (l - th * 2.5, cy - th * 0.55, l - 1, cy + th * 0.55)
    if th < 4 or win[0] < 0 or win[2] - win[0] < 3 or any(o[0] < win[2] and o[2] > win[0] and o[1] < win[3] and o[3] > win[1] for o in others):
        return None
    x0, x1, y0, y1 = int(win[0]), int(win[2]), max(0, int(win[1])), min(mask.shape[0] - 1, int(win[3]))
    ys, xs = np.nonzero(mask[y0 : y1 + 1, x0 : x1 + 1])
    if not len(xs) or xs.min() == 0 or ys.min() == 0 or ys.max() == y1 - y0:
        return None
    w, h = float(np.ptp(xs) + 1), float(np.ptp(ys) + 1)
    middle = y0 + (ys.min() + ys.max()) / 2
    small = th * 0.12 <= min(w, h) and max(w, h) <= th * 0.7 and max(w, h) / min(w, h) <= 1.8
    return (float(x0 + xs.min()), float(y0 + ys.min()), x0 + xs.min() + w, y0 + ys.min() + h) if small and len(xs) >= w * h * 0.4 and abs(middle - cy) <= th * 0.35 else None


# ------------------------------------------------------------------------------ text boxes from a probability map


def box_score(prob: np.ndarray, rect: tuple[float, float, float, float, float]) -> float:
    """Mean probability of the pixels in a rotated rectangle (centre, sides, angle)."""
    cx, cy, w, h, angle = rect
    y, x = np.mgrid[: prob.shape[0], : prob.shape[1]] + 0.5
    u, v = (x - cx) * math.cos(angle) + (y - cy) * math.sin(angle), (y - cy) * math.cos(angle) - (x - cx) * math.sin(angle)
    own = prob[(np.abs(u) <= w / 2) & (np.abs(v) <= h / 2)]
    return float(own.mean()) if own.size else 0.0


def text_boxes(prob: np.ndarray, threshold: float = 0.3, least: float = 0.6, ratio: float = 1.5, most: int = 3000) -> list[tuple[list[tuple[float, float]], float]]:
    """(corners, score) of the text boxes in a probability map, from top to bottom. The limit of boxes for a page is the detector's own."""
    from ..functions.geometry import convex_hull, corners, min_area_rect, normalized_angle

    labels = components(prob > threshold)
    out = []
    for k in range(1, int(labels.max(initial=0)) + 1):
        ys, xs = np.nonzero(labels == k)
        if len(xs) < 4:
            continue
        pts = [(float(x + i), float(y + j)) for y in np.unique(ys) for x in (xs[ys == y].min(), xs[ys == y].max()) for i in (0, 1) for j in (0, 1)]
        cx, cy, w, h, angle = min_area_rect(convex_hull(pts))
        score = box_score(prob, (cx, cy, w, h, angle)) if min(w, h) >= 3 else 0.0
        if score < least:
            continue
        d = w * h * ratio / (2 * (w + h))
        w, h = w + 2 * d, h + 2 * d
        if min(w, h) >= 5:
            out.append((corners(cx, cy, *normalized_angle(w, h, angle)), score))
            if len(out) >= most:
                break
    return sorted(out, key=lambda x: (min(p[1] for p in x[0]), min(p[0] for p in x[0])))


def ctc_text(probs: np.ndarray, symbols: list[str], width: int, real_width: int) -> tuple[str, float, list[float], list[float]]:
    """(text, confidence, centres, confidences) of a recogniser's steps (steps, classes): arg-max, runs collapsed to their middle with their greatest probability, blanks (0) dropped."""
    best, p = probs.argmax(axis=1), probs.max(axis=1)
    step = width / max(1, len(best))
    text, centres, confs = [], [], []
    for a, b in zip(*(lambda cut: (np.r_[0, cut], np.r_[cut, len(best)]))(np.flatnonzero(np.diff(best)) + 1)) if len(best) else ():
        k = int(best[a])
        if 0 < k < len(symbols):
            text.append(symbols[k])
            centres += [min(1.0, ((a + b - 1) / 2 + 0.5) * step / real_width)] * len(symbols[k])
            confs += [float(p[a:b].max())] * len(symbols[k])
    return "".join(text), sum(confs) / len(confs) if confs else 0.0, centres, confs


# ------------------------------------------------------------------------------ resizing, cropping, tensors


def sample(img: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear values at places, clamped to the image."""
    h, w = img.shape[:2]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = x.astype(int), y.astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    ax, ay = (x - x0)[..., None], (y - y0)[..., None]
    f = img.astype(np.float32)
    top, bottom = f[y0, x0] + (f[y0, x1] - f[y0, x0]) * ax, f[y1, x0] + (f[y1, x1] - f[y1, x0]) * ax
    return top + (bottom - top) * ay


def _bytes(v: np.ndarray) -> np.ndarray:
    return np.clip(v + 0.5, 0, 255).astype(np.uint8)


def resize(img: np.ndarray, w: int, h: int) -> np.ndarray:
    """Bilinear, with up to 4 x 4 taps for each pixel where it shrinks."""
    sx, sy = img.shape[1] / w, img.shape[0] / h
    nx, ny = min(4, max(1, int(sx))), min(4, max(1, int(sy)))
    total = np.zeros((h, w, 3), dtype=np.float32)
    for j in range(ny):
        for i in range(nx):
            x, y = np.meshgrid((np.arange(w) + (i + 0.5) / nx) * sx - 0.5, (np.arange(h) + (j + 0.5) / ny) * sy - 0.5)
            total += sample(img, x, y)
    return _bytes(total / (nx * ny))


def rotate(img: np.ndarray, degrees: int) -> np.ndarray:
    """Clockwise by quarter turns."""
    return np.rot90(img, -(degrees // 90) % 4)


def crop_quad(img: np.ndarray, quad: list[tuple[float, float]]) -> np.ndarray:
    """A quadrilateral (from its top left on) as an upright image; tall ones are turned to read from left to right."""
    a, b, c, d = quad
    w, h = max(1, round(max(math.dist(a, b), math.dist(d, c)))), max(1, round(max(math.dist(a, d), math.dist(b, c))))
    x, y = np.meshgrid(np.arange(w) + 0.5, np.arange(h) + 0.5)
    out = _bytes(sample(img, a[0] + (b[0] - a[0]) / w * x + (d[0] - a[0]) / h * y - 0.5, a[1] + (b[1] - a[1]) / w * x + (d[1] - a[1]) / h * y - 0.5))
    return rotate(out, 270) if h >= 1.5 * w else out


def processed(img: np.ndarray, rotation: int, crop: Box | None) -> np.ndarray:
    """Rotated, then cropped by fractions (x, y, w, h); a crop of eight pixels or less is none."""
    out = rotate(img, rotation % 360)
    if crop is None:
        return out
    h, w = out.shape[:2]
    x0, y0 = round(crop[0] * w), round(crop[1] * h)
    x1, y1 = min(w, x0 + round(crop[2] * w)), min(h, y0 + round(crop[3] * h))
    x0, y0 = max(0, x0), max(0, y0)
    return out[y0:y1, x0:x1] if x1 - x0 > 8 and y1 - y0 > 8 else out


def oriented(img: np.ndarray, orientation: int) -> np.ndarray:
    """Upright by the orientation that a camera noted."""
    return rotate(img, {3: 180, 6: 90, 8: 270}.get(orientation, 0))


def on_white(rgba: np.ndarray) -> np.ndarray:
    """An image with an alpha channel, laid on white."""
    a = rgba[..., 3:].astype(np.float32) / 255
    return _bytes(rgba[..., :3] * a + 255 * (1 - a))


def detector_tensor(img: np.ndarray, most: int = 960) -> np.ndarray:
    """(3, h, w) in BGR order, sides multiples of 32, by the detector's statistics."""
    h, w = img.shape[:2]
    scale = most / max(w, h) if max(w, h) > most else 1.0
    scale = 64 / min(w, h) if min(w, h) * scale < 64 else scale
    rw, rh = (max(32, round(s * scale / 32) * 32) for s in (w, h))
    own = (img if (rw, rh) == (w, h) else resize(img, rw, rh))[..., ::-1] / 255.0
    return ((own - DETECTOR_MEAN) / DETECTOR_STD).transpose(2, 0, 1).astype(np.float32)


def recogniser_tensor(crops: list[np.ndarray], height: int = 48, most: int = 4800) -> tuple[np.ndarray, list[int]]:
    """((n, 3, height, width) in BGR order from -1 to 1, own widths) of crops, padded to the widest."""
    ratio = max([320 / height, *(c.shape[1] / c.shape[0] for c in crops)])
    width = min(most, math.ceil(height * ratio))
    out, widths = np.zeros((len(crops), 3, height, width), dtype=np.float32), []
    for k, c in enumerate(crops):
        w = min(width, max(1, math.ceil(height * c.shape[1] / c.shape[0])))
        out[k, :, :, :w] = (resize(c, w, height)[..., ::-1] / 127.5 - 1).transpose(2, 0, 1)
        widths.append(w)
    return out, widths


def classifier_tensor(crops: list[np.ndarray], width: int = 160, height: int = 80) -> np.ndarray:
    """(n, 3, height, width) in RGB order, by the same statistics."""
    own = np.stack([resize(c, width, height) for c in crops]) / 255.0
    return ((own - DETECTOR_MEAN) / DETECTOR_STD).transpose(0, 3, 1, 2).astype(np.float32)


# ------------------------------------------------------------------------------ PNG


def to_png(img: np.ndarray) -> bytes:
    h, w = img.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(img, np.uint8).reshape(h, -1)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def from_png(raw: bytes) -> np.ndarray:
    """RGB of an 8-bit PNG without interlacing (grey, RGB, palette, with alpha laid on white)."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, palette = 8, b"", None
    while at < len(raw):
        (n,), kind = struct.unpack(">I", raw[at : at + 4]), raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    if depth != 8 or interlace:
        raise ValueError("only 8-bit PNG without interlacing")
    ch = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * ch)
    out, above = np.zeros((h, w * ch), np.uint8), np.zeros(w * ch, np.int32)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:].astype(np.int32)
        if kind == 2:
            line = line + above
        elif kind:
            for x in range(w * ch):
                left, corner = (int(line[x - ch]), int(above[x - ch])) if x >= ch else (0, 0)
                up = int(above[x])
                if kind == 4:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                else:
                    guess = left if kind == 1 else (left + up) // 2
                line[x] = (line[x] + guess) & 255
        above = line & 255
        out[y] = above
    px = out.reshape(h, w, ch)
    if color == 3:
        return palette[px[..., 0]]
    if color in (0, 4):
        px = np.concatenate([np.repeat(px[..., :1], 3, axis=2), px[..., 1:]], axis=2)
    return on_white(px) if color in (4, 6) else px


def map_images(images: DataFrame, fn, ddl: str, schema: pa.Schema) -> DataFrame:
    """Rows of fn(key, image) for images (doc_id, page_no, width, height, pixels of RGB bytes), one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .kernel import to_batch

        for b in batches:
            out = []
            for doc, page, w, h, px in zip(*(b.column(i).to_pylist() for i in range(5))):
                if px is not None and w and h and len(px) == w * h * 3:
                    out.extend(fn((doc, page), np.frombuffer(px, np.uint8).reshape(h, w, 3)))
            if out:
                yield to_batch(out, schema)

    return images.select("doc_id", "page_no", "width", "height", "pixels").mapInArrow(run, ddl)
