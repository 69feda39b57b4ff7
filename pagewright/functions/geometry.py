"""Geometry, units, colours and rounding as column expressions; all stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals have in common, 0 if none."""
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Common length over the shorter interval; 0 when disjoint or empty."""
    shorter = F.least(a1 - a0, b1 - b0)
    return F.when(shorter > 0, overlap(a0, a1, b0, b1) / shorter).otherwise(0.0)


def coverage(a: str, b: str) -> Column:
    """Share of rectangle a (struct l, t, r, b) that rectangle b covers; 0 for an empty a."""
    c = lambda n, f: F.col(f"{n}.{f}").cast("double")
    area = (c(a, "r") - c(a, "l")) * (c(a, "b") - c(a, "t"))
    both = overlap(c(a, "l"), c(a, "r"), c(b, "l"), c(b, "r")) * overlap(c(a, "t"), c(a, "b"), c(b, "t"), c(b, "b"))
    return F.when(area > 0, both / area).otherwise(0.0)


def px_to_pt(px: Column, dpi: Column) -> Column:
    return px * 72 / dpi


def twips(px: Column, dpi: Column) -> Column:
    return F.bround(px * 1440 / dpi, 0).cast("bigint")


def emu(px: Column, dpi: Column) -> Column:
    return F.bround(px * 914400 / dpi, 0).cast("bigint")


def half_points(pt: Column) -> Column:
    return F.greatest(F.lit(2), F.bround(pt * 2, 0)).cast("bigint")


def round_half(v: Column) -> Column:
    """To half units, halves to even, at least 4."""
    return F.greatest(F.lit(4.0), F.bround(v * 2, 0) / 2)


def red(c: Column) -> Column:
    return F.shiftright(c, 16).bitwiseAND(255)


def green(c: Column) -> Column:
    return F.shiftright(c, 8).bitwiseAND(255)


def blue(c: Column) -> Column:
    return c.bitwiseAND(255)


def color_distance(a: Column, b: Column) -> Column:
    return F.abs(red(a) - red(b)) + F.abs(green(a) - green(b)) + F.abs(blue(a) - blue(b))


def css_color(c: Column) -> Column:
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(c.bitwiseAND(0xFFFFFF)), 6, "0")))


def upper_median(values: Column) -> Column:
    """The element at half the length of the sorted values (the upper of two); null for none. An aggregate."""
    own = F.sort_array(F.collect_list(values))
    return F.try_element_at(own, (F.floor(F.size(own) / 2) + 1).cast("int"))


def effective_dpi(kind: Column, width: Column, height: Column, dpi: Column, cropped: Column, pdf_dpi: float = 200.0) -> Column:
    """Of a page image: a plausible own value, else from the long side of an uncropped large page, else its value, or 96 where it has none. Of a PDF the one it is rendered with."""
    long_side = F.greatest(width, height).cast("double")
    guess = F.least(F.lit(600.0), F.greatest(F.lit(96.0), long_side / 11.3))
    own = dpi.cast("double")
    return F.when(kind == "Pdf", F.coalesce(own, F.lit(pdf_dpi))).when(own.between(150, 1200), own).when((long_side >= 1600) & ~cropped, guess).when(own > 0, own).otherwise(96.0)


def same_style(size_a: Column, size_b: Column, bold: Column, italic: Column, color_a: Column, color_b: Column, tolerance: float = 0.12) -> Column:
    """Sizes within the tolerance, equal weight and slant (given as equalities), colours at most 60 apart."""
    relative = F.abs(size_a - size_b) / F.greatest(F.lit(1.0), size_a, size_b)
    return (relative <= tolerance) & bold & italic & (color_distance(color_a, color_b) <= 60)


def centered(l: Column, r: Column, h: Column, col_l: Column, col_r: Column) -> Column:  # noqa: E741
    left, right, w = l - col_l, col_r - r, col_r - col_l
    return (left > w * 0.08) & (F.abs(left - right) < F.greatest(w * 0.05, h))


def snap_color(c: Column) -> Column:
    """Near black to black, near white to white, greyish to grey in steps of 16; others as they are."""
    r, g, b = red(c), green(c), blue(c)
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    grey = F.least(F.lit(255), (F.bround(F.floor((r + g + b) / 3) / 16.0, 0) * 16).cast("int"))
    return F.when((high < 80) & (high - low < 30), 0).when(low > 225, 0xFFFFFF).when(high - low < 18, grey * 0x010101).otherwise(c.bitwiseAND(0xFFFFFF))


# --- fixed values: letters that reach above the height of an x and below the line ---------------
ASCENDERS, DESCENDERS = "bdfhklt", "gjpqy"
ASCENDERS_CYRILLIC, DESCENDERS_CYRILLIC = "ЁЙБДФ", "дзруфцщ"
# ------------------------------------------------------------------------------------------------


def font_pixels(ink_height: Column, text: Column) -> Column:
    """Em size from the height of a text's ink, by the zones that its letters fill; 0 for none."""
    above, below = text.rlike(f"[\\p{{Lu}}\\p{{Nd}}{ASCENDERS}{ASCENDERS_CYRILLIC}]"), text.rlike(f"[{DESCENDERS}{DESCENDERS_CYRILLIC}]")
    zones = F.when(text.rlike("[\\u3000-\\u303F\\u3040-\\u30FF\\u3400-\\u9FFF\\uAC00-\\uD7AF\\uFF00-\\uFFEF]"), 0.88).when(text.rlike("[()\\[]"), 0.95).when(above & below, 0.92).when(above | below, 0.72).otherwise(0.52)
    return F.when((ink_height > 0) & (F.length(text) > 0), ink_height / zones).otherwise(0.0)


def fit_scale(box_width: Column, text_width: Column) -> Column:
    """Per cent by which a text is stretched to its box, 40 to 250; 100 for a text without width."""
    return F.when(text_width > 0, F.greatest(F.lit(40), F.least(F.lit(250), F.bround(box_width / text_width * 100, 0).cast("int")))).otherwise(100)


def grid_width(px: Column, dpi: Column) -> Column:
    """Width of a sheet column in characters, at least 2."""
    return F.bround(F.greatest(F.lit(2.0), px * 96 / dpi / 7.0), 2)


def unclip(width: Column, height: Column, ratio: float = 1.5) -> tuple[Column, Column]:
    """Sides of a rectangle grown by area times ratio over perimeter on all four; null where one stays under 5."""
    d = width * height * ratio / (2 * (width + height))
    w, h = width + 2 * d, height + 2 * d
    keep = F.least(w, h) >= 5
    return F.when(keep, w), F.when(keep, h)


def polygon_area(points: Column) -> Column:
    """Of an array of (x, y)."""
    nxt = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2


def polygon_perimeter(points: Column) -> Column:
    nxt = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    sides = F.zip_with(points, nxt, lambda p, q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])))
    return F.aggregate(sides, F.lit(0.0), lambda a, x: a + x)


Point = tuple[float, float]


def convex_hull(points: list[Point]) -> list[Point]:
    """Corners of the hull, counter-clockwise in coordinates with y up, from the leftmost on; two points and fewer are their own."""
    if len(points) < 3:
        return list(points)
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def half(own: list[Point]) -> list[Point]:
        out: list[Point] = []
        for p in own:
            while len(out) > 1 and turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    own = sorted(points)
    return half(own) + half(own[::-1])


def normalized_angle(w: float, h: float, angle: float) -> tuple[float, float, float]:
    """The same rectangle with its angle in (-45, 45] degrees (in radians): each quarter turn swaps the sides."""
    quarters = math.ceil(round(math.degrees(angle) / 90 - 0.5, 12))
    return (h, w, angle - quarters * math.pi / 2) if quarters % 2 else (w, h, angle - quarters * math.pi / 2)


def min_area_rect(hull: list[Point]) -> tuple[float, float, float, float, float]:
    """(centre x, y, w, h, angle) of the smallest rectangle around a hull that lies along one of its sides; the first of equals."""
    if len(hull) < 3:
        if not hull:
            return (0.0,) * 5
        xs, ys = zip(*hull)
        return (min(xs) + max(xs)) / 2, (min(ys) + max(ys)) / 2, max(xs) - min(xs), max(ys) - min(ys), 0.0
    best = None
    for a, b in zip(hull, [*hull[1:], hull[0]]):
        n = math.dist(a, b)
        if n < 1e-6:
            continue
        c, s = (b[0] - a[0]) / n, (b[1] - a[1]) / n
        us, vs = [x * c + y * s for x, y in hull], [y * c - x * s for x, y in hull]
        w, h = max(us) - min(us), max(vs) - min(vs)
        if best is None or w * h < best[0]:
            u, v = (max(us) + min(us)) / 2, (max(vs) + min(vs)) / 2
            best = (w * h, u * c - v * s, u * s + v * c, w, h, math.atan2(s, c))
    w, h, angle = normalized_angle(*best[3:])
    return best[1], best[2], w, h, angle


def corners(cx: float, cy: float, w: float, h: float, angle: float) -> list[Point]:
    """Top left, top right, bottom right, bottom left, with y down."""
    c, s = math.cos(angle), math.sin(angle)
    return [(cx + u * c - v * s, cy + u * s + v * c) for u, v in ((-w / 2, -h / 2), (w / 2, -h / 2), (w / 2, h / 2), (-w / 2, h / 2))]
