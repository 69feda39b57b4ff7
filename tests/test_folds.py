"""Ordered folds against plain Python on small random pages, with ties."""

import random

import pytest

from pagewright.functions import text as T
from pagewright.operators import layout
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def pages():
    rnd = random.Random(5)
    rows = []
    for page in range(12):
        for i in range(rnd.randint(1, 14)):
            left, top = rnd.randint(0, 4) * 60.0, rnd.randint(0, 12) * 9.0
            rows.append((1, page, i + 1, left, top, left + 50.0, top + rnd.choice([8.0, 10.0, 22.0])))
    return rows


@pytest.fixture(scope="module")
def lines(spark, pages):
    return spark.createDataFrame(pages, "doc_id bigint, page_no int, line_id int, l double, t double, r double, b double")


def by_page(rows):
    out = {}
    for d, p, i, left, t, r, b in rows:
        out.setdefault(p, []).append((t, left, i, b))
    return {p: sorted(x) for p, x in out.items()}


def test_band_fold(lines, pages):
    want = set()
    for p, items in by_page(pages).items():
        band, bottom, least = 0, None, 0.0
        for t, _, i, b in items:
            h = b - t
            if band and t < bottom - 0.4 * min(h, least):
                bottom, least = max(bottom, b), min(least, h)
            else:
                band, bottom, least = band + 1, b, h
            want.add((p, i, band))
    assert {(r.page_no, r.line_id, r.band) for r in layout.band_fold(lines).collect()} == want


def test_visual_lines(lines, pages):
    want = set()
    for p, items in by_page(pages).items():
        rows = []
        for t, _, i, b in items:
            for v in reversed(rows):
                shorter = min(v[1] - v[0], b - t)
                if shorter > 0 and min(v[1], b) - max(v[0], t) > 0.55 * shorter:
                    v[0], v[1] = min(v[0], t), max(v[1], b)
                    v[2].append(i)
                    break
            else:
                rows.append([t, b, [i]])
        want |= {(p, tuple(v[2])) for v in rows}
    got = {}
    for r in layout.visual_lines(lines).collect():
        got.setdefault((r.page_no, r.vline_id), set()).add(r.line_id)
    assert {(p, frozenset(x)) for p, x in want} == {(p, frozenset(x)) for (p, _), x in got.items()}


def test_cluster_first_is_greedy(spark):
    got = spark.range(1).select(layout.cluster_first(F.array(*map(F.lit, (10.0, 1.0, 5.0, 9.5, 30.0, 1.0))), 8.0).alias("x")).first().x
    assert got == [1.0, 9.5, 30.0]


def test_natural_order(spark):
    names = ["p10.png", "p2.png", "P1.png", "p02b.png"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(T.natural_key(F.col("n"))).collect()] == ["P1.png", "p2.png", "p02b.png", "p10.png"]


@pytest.mark.parametrize("text,kind", [("• x", "bullet"), ("•x", "bullet"), ("- x", "bullet"), ("-x", "none"), ("–x", "bullet"), ("(iv) x", "ordered"), ("12) x", "ordered"), ("A. x", "ordered"), ("1.x", "none"), ("", "none")])
def test_markers(spark, text, kind):
    assert spark.createDataFrame([(text,)], "t string").select(T.marker_kind(F.col("t"))).first()[0] == kind


def test_empty_tables(spark, lines):
    none = lines.limit(0)
    for fn in (layout.band_fold, layout.visual_lines, layout.renumber, layout.line_gaps, layout.median_height):
        assert fn(none).count() == 0


def test_column_names_of_any_length(spark):
    def name(n):
        return "" if n == 0 else name((n - 1) // 26) + chr(65 + (n - 1) % 26)

    numbers = [1, 26, 27, 702, 703, 18278, 18279, 475254, 475255, 2**31, 2**62 + 12345]
    df = spark.createDataFrame([(n,) for n in numbers], "i bigint").select("i", T.column_name(F.col("i")).alias("name"))
    assert {r.i: r.name for r in df.collect()} == {n: name(n) for n in numbers}
