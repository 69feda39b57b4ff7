"""Further queries over the reference's own operators, each with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import analysis, edits, joins, layout, predicates, ruled, textlayer
from ..sinks import markup, sheets
from ..sources import tables as S
from .oracle import _B, _BL, _L, _MED, _P, _with

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
PAGE = ["doc_id", "page_no"]
_ON = "a.doc_id = x.doc_id AND a.page_no = x.page_no"


def _query(sql: str | None = None):
    def add(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


def _kind(spark, d, *kinds: str) -> DataFrame:
    return S.blocks(spark, d).where(F.col("kind").isin(*kinds))


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# ------------------------------------------------------------------------------ predicates


@_query(_with(_L) + """, A AS (SELECT doc_id, page_no, line_id, t, l, coalesce(CAST(size_pt AS DOUBLE), 11.0) AS s, coalesce(bold, false) AS bo, coalesce(italic, false) AS it, coalesce(color, 0) AS c FROM L),
    P AS (SELECT *, lag(s) OVER w AS s0, lag(bo) OVER w AS b0, lag(it) OVER w AS i0, lag(c) OVER w AS c0 FROM A WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY t, l, line_id))
    SELECT doc_id, page_no, line_id, CASE WHEN s0 IS NOT NULL THEN abs(s - s0) / greatest(1.0, s, s0) <= 0.16 AND bo = b0 AND it = i0 AND abs((c >> 16 & 255) - (c0 >> 16 & 255)) + abs((c >> 8 & 255) - (c0 >> 8 & 255)) + abs((c & 255) - (c0 & 255)) <= 60 END AS same FROM P""")
def style_changes(spark, d):
    return predicates.style_changes(S.lines(spark, d))


@_query(_with(_L) + """, A AS (SELECT *, min(l) OVER w AS cl, max(r) OVER w AS cr FROM L WINDOW w AS (PARTITION BY doc_id, page_no))
    SELECT doc_id, page_no, line_id FROM A WHERE l - cl > (cr - cl) * 0.08 AND abs((l - cl) - (cr - r)) < greatest((cr - cl) * 0.05, b - t)""")
def centered_lines(spark, d):
    return predicates.centered_lines(S.lines(spark, d))


@_query(_with(_L) + """, D AS (SELECT *, max(r) OVER (PARTITION BY doc_id, page_no ORDER BY l, r, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM L),
    G AS (SELECT doc_id, page_no, reach AS gap_start, min(l) AS gap_end FROM D WHERE l > reach GROUP BY ALL), R AS (SELECT doc_id, page_no, min(l) AS l, max(r) AS r FROM L GROUP BY ALL)
    SELECT G.doc_id, G.page_no, gap_start, gap_end FROM G JOIN R ON G.doc_id = R.doc_id AND G.page_no = R.page_no WHERE gap_start > l + 1 AND gap_end < r - 1 AND gap_end - gap_start >= (r - l) * 0.012""")
def interior_gutters(spark, d):
    rows = S.lines(spark, d)
    return predicates.interior_gutters(joins.gutters(rows), layout.bounding_box(rows, *PAGE), (F.col("r") - F.col("l")) * 0.012)


_FIG = "F AS (SELECT * FROM B WHERE kind = 'Figure')"


@_query(_with(_B, _P) + f""", {_FIG}, A AS (SELECT F.*, CAST(P.width AS DOUBLE) AS pw, CAST(P.height AS DOUBLE) AS ph, coalesce(CAST(P.dpi AS DOUBLE), 96.0) AS dpi FROM F JOIN P ON F.doc_id = P.doc_id AND F.page_no = P.page_no),
    S AS (SELECT *, least(r, pw) - greatest(l, 0.0) AS w, least(b, ph) - greatest(t, 0.0) AS h, dpi / 50 AS cell FROM A)
    SELECT doc_id, page_no, block_no FROM S WHERE w >= greatest(dpi * 0.2, least(pw, ph) * 0.02) AND h >= greatest(dpi * 0.2, least(pw, ph) * 0.02) AND w * h >= pw * ph * 0.002 AND w * h >= 20 * cell * cell
    AND NOT ((l <= cell OR t <= cell OR r >= pw - cell OR b >= ph - cell) AND greatest(w / h, h / w) > 12) AND w * h <= pw * ph * 0.85""")
def figures_of_size(spark, d):
    return predicates.figures_of_size(_kind(spark, d, "Figure"), S.pages(spark, d))


_IN_FIG = f"""{_FIG}, H AS (SELECT x.doc_id, x.page_no, x.block_no, (a.r - a.l) * (a.b - a.t) AS area FROM L a JOIN F x ON {_ON} AND greatest(least(a.r, x.r) - greatest(a.l, x.l), 0.0) * greatest(least(a.b, x.b) - greatest(a.t, x.t), 0.0) * 10 > (a.r - a.l) * (a.b - a.t) * 7),
    I AS (SELECT F.doc_id, F.page_no, F.block_no, count(H.area) AS inside, round(coalesce(sum(H.area), 0.0) / ((F.r - F.l) * (F.b - F.t)), 6) AS share FROM F LEFT JOIN H ON F.doc_id = H.doc_id AND F.page_no = H.page_no AND F.block_no = H.block_no GROUP BY F.doc_id, F.page_no, F.block_no, F.l, F.t, F.r, F.b)"""


@_query(_with(_L, _B) + f", {_IN_FIG} SELECT * FROM I")
def text_in_figures(spark, d):
    return predicates.text_in_figures(S.lines(spark, d), _kind(spark, d, "Figure"))


@_query(_with(_L, _B) + f", {_IN_FIG} SELECT doc_id, page_no, block_no FROM I WHERE inside <= 6 AND share <= 0.25")
def pictures(spark, d):
    return predicates.pictures(S.lines(spark, d), _kind(spark, d, "Figure"))


@_query(_with(_L, _P) + """, A AS (SELECT L.*, ((coalesce(rotation, 0) % 360) + 360) % 360 AS rot, P.crop AS crop, CAST(P.width AS DOUBLE) AS ow, CAST(P.height AS DOUBLE) AS oh FROM L JOIN P ON L.doc_id = P.doc_id AND L.page_no = P.page_no),
    B AS (SELECT *, CASE WHEN rot IN (90, 270) THEN oh ELSE ow END AS w, CASE WHEN rot IN (90, 270) THEN ow ELSE oh END AS h,
      CASE rot WHEN 90 THEN oh - b WHEN 180 THEN ow - r WHEN 270 THEN t ELSE l END AS l0, CASE rot WHEN 90 THEN l WHEN 180 THEN oh - b WHEN 270 THEN ow - r ELSE t END AS t0,
      CASE rot WHEN 90 THEN oh - t WHEN 180 THEN ow - l WHEN 270 THEN b ELSE r END AS r0, CASE rot WHEN 90 THEN r WHEN 180 THEN oh - t WHEN 270 THEN ow - l ELSE b END AS b0 FROM A),
    C AS (SELECT *, coalesce(round_even(CAST(crop.x AS DOUBLE) * w, 0), 0.0) AS cx, coalesce(round_even(CAST(crop.y AS DOUBLE) * h, 0), 0.0) AS cy, coalesce(round_even(CAST(crop.w AS DOUBLE) * w, 0), w) AS cw, coalesce(round_even(CAST(crop.h AS DOUBLE) * h, 0), h) AS ch FROM B),
    D AS (SELECT doc_id, page_no, line_id, rot, cw, ch, l0 - cx AS l, t0 - cy AS t, r0 - cx AS r, b0 - cy AS b FROM C)
    SELECT doc_id, page_no, line_id, l, t, r, b, rot = 0 AS extents FROM D WHERE (r - l) * (b - t) > 0 AND greatest(least(r, cw) - greatest(l, 0.0), 0.0) * greatest(least(b, ch) - greatest(t, 0.0), 0.0) * 2 >= (r - l) * (b - t)""")
def remapped_lines(spark, d):
    return predicates.remapped_lines(S.lines(spark, d), S.pages(spark, d))


@_query(_with(_L, _B) + """, T AS (SELECT DISTINCT doc_id, page_no, unnest(line_ids) AS line_id FROM B WHERE kind = 'Table'), A AS (SELECT L.* FROM L ANTI JOIN T USING (doc_id, page_no, line_id) WHERE NOT coalesce(in_figure, false))
    SELECT doc_id, page_no, line_id, text, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY t, l, line_id) AS place FROM A""")
def positioned_lines(spark, d):
    return predicates.positioned_lines(S.lines(spark, d), S.blocks(spark, d))


@_query(_with(_B) + "SELECT doc_id, page_no, block_no, i - 1 AS pos, line_ids[i] AS line_id FROM (SELECT *, unnest(generate_series(1, len(line_ids))) AS i FROM B)")
def block_text_lines(spark, d):
    return predicates.block_text_lines(S.blocks(spark, d))


# ------------------------------------------------------------------------------ joins

_RULES = """R AS (SELECT doc_id, page_no, block_no * 4 + s AS rule, s < 2 AS horizontal, CASE s WHEN 0 THEN t WHEN 1 THEN b WHEN 2 THEN l ELSE r END AS pos, CASE WHEN s < 2 THEN l ELSE t END AS a, CASE WHEN s < 2 THEN r ELSE b END AS z
    FROM B, (SELECT unnest([0, 1, 2, 3]) AS s) WHERE kind IN ('Table', 'Figure'))"""


@_query(_with(_L, _B) + f""", {_RULES} SELECT doc_id, page_no, rule FROM R WHERE NOT EXISTS (SELECT 1 FROM L x WHERE x.doc_id = R.doc_id AND x.page_no = R.page_no AND CASE WHEN horizontal THEN pos > x.t + 2 AND pos < x.b - 2 AND least(z, x.r - 2) - greatest(a, x.l + 2) > (z - a) * 0.6
    ELSE pos > x.l + 2 AND pos < x.r - 2 AND least(z, x.b - 2) - greatest(a, x.t + 2) > (z - a) * 0.6 END)""")
def free_rules(spark, d):
    return predicates.free_rules(joins.rules(_kind(spark, d, "Table", "Figure")), S.lines(spark, d)).select(*PAGE, "rule")


@_query(_with(_L) + "SELECT a.doc_id, a.page_no, a.line_id FROM L a WHERE NOT EXISTS (SELECT 1 FROM L x WHERE a.doc_id = x.doc_id AND a.page_no = x.page_no AND a.line_id <> x.line_id AND x.r > a.l - (a.b - a.t) * 1.5 AND x.l < a.l AND x.b > a.t AND x.t < a.b)")
def alone_on_the_left(spark, d):
    return predicates.alone_on_the_left(S.lines(spark, d))


_CELLS = """T AS (SELECT B.doc_id, B.page_no, B.block_no, B.l AS xl, B.t AS xt, B.r AS xr, B.b AS xb, L.line_id, L.t, L.b FROM (SELECT *, unnest(line_ids) AS line_id FROM B WHERE kind = 'Table') B JOIN L ON L.doc_id = B.doc_id AND L.page_no = B.page_no AND L.line_id = B.line_id),
    C AS (SELECT doc_id, page_no, block_no, row_number() OVER w - 1 AS row, coalesce((lag(b) OVER w + t) / 2, xt) AS t, coalesce((b + lead(t) OVER w) / 2, xb) AS b, xl AS l, xr AS r FROM T WINDOW w AS (PARTITION BY doc_id, page_no, block_no ORDER BY t, line_id))"""


@_query(_with(_L, _B) + f", {_CELLS} SELECT * FROM C")
def table_row_edges(spark, d):
    return predicates.table_rows(S.lines(spark, d), _kind(spark, d, "Table"))


@_query(_with(_L, _B) + f""", {_CELLS}, M AS (SELECT a.doc_id, a.page_no, a.line_id, x.block_no, x.row, (a.l + a.r) / 2 AS cx, (a.t + a.b) / 2 AS cy, x.l, x.t, x.r, x.b FROM L a JOIN C x ON {_ON}),
    N AS (SELECT *, cx >= l AND cx < r AND cy >= t AND cy < b AS hit, greatest(l - cx, cx - r, 0.0) + greatest(t - cy, cy - b, 0.0) AS dist FROM M), O AS (SELECT *, CASE WHEN hit THEN 0.0 ELSE dist END AS distance FROM N)
    SELECT doc_id, page_no, line_id, block_no, row, distance FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, line_id ORDER BY NOT hit, distance, block_no, row) AS k FROM O) WHERE k = 1""")
def cells_of_lines(spark, d):
    rows = S.lines(spark, d)
    return predicates.cells_of_lines(rows, predicates.table_rows(rows, _kind(spark, d, "Table")))


def _table_rules(spark, d) -> DataFrame:
    """Rules of tables whose rows are lines: their frame, and a horizontal one between neighbouring rows."""
    tables = _kind(spark, d, "Table")
    rows = predicates.table_rows(S.lines(spark, d), tables).where("row > 0")
    inner = rows.select(*PAGE, F.lit(True).alias("horizontal"), F.col("t").alias("pos"), F.col("l").alias("start"), F.col("r").alias("end"))
    return joins.rules(tables).select(*PAGE, "horizontal", "pos", "start", "end").unionByName(inner)


@_query()
def ruled_cells(spark, d):
    return ruled.ruled_cells(_table_rules(spark, d))


_SIDES = """SB AS (SELECT a.doc_id, a.page_no, a.block_no, a.row, EXISTS (SELECT 1 FROM K x WHERE a.doc_id = x.doc_id AND a.page_no = x.page_no AND abs(x.pos - a.b) <= 6 AND least(x.z, a.r) - greatest(x.a, a.l) > 0.5 * least(x.z - x.a, a.r - a.l)) AS border FROM C a)"""


@_query(_with(_L, _B) + f""", {_CELLS}, K AS (SELECT doc_id, page_no, t AS pos, l AS a, r AS z FROM C WHERE row > 0 UNION ALL SELECT doc_id, page_no, unnest([t, b]), l, r FROM B WHERE kind = 'Table'), {_SIDES} SELECT * FROM SB""")
def cell_borders(spark, d):
    """Whether a horizontal rule within 6 pixels covers over half of the lower edge of each table row (an interval semi-join)."""
    rules = _table_rules(spark, d).where("horizontal").select(F.col("doc_id").alias("xd"), F.col("page_no").alias("xp"), "pos", "start", "end")
    cells = predicates.table_rows(S.lines(spark, d), _kind(spark, d, "Table"))
    near = (F.abs(F.col("pos") - F.col("b")) <= 6) & (F.least("end", "r") - F.greatest("start", "l") > F.least(F.col("end") - F.col("start"), F.col("r") - F.col("l")) * 0.5)
    hit = cells.join(rules, (F.col("doc_id") == F.col("xd")) & (F.col("page_no") == F.col("xp")) & near, "left_semi").select(*PAGE, "block_no", "row", F.lit(True).alias("border"))
    return cells.select(*PAGE, "block_no", "row").join(hit, [*PAGE, "block_no", "row"], "left").withColumn("border", F.coalesce("border", F.lit(False)))


_BANDS = """W AS (SELECT *, max(b) OVER (PARTITION BY doc_id, page_no ORDER BY t, l, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM L),
    V AS (SELECT *, sum(CASE WHEN m IS NULL OR t >= m THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY t, l, line_id) AS band, min(l) OVER (PARTITION BY doc_id, page_no) AS lo, max(r) OVER (PARTITION BY doc_id, page_no) AS hi FROM W)"""
_GAPS = f"""{_BANDS}, U AS (SELECT *, coalesce(max(r) OVER (PARTITION BY doc_id, page_no, band ORDER BY l, r, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo) AS reach FROM V),
    G AS (SELECT doc_id, page_no, band, reach AS gap_start, l AS gap_end FROM U WHERE l > reach UNION ALL SELECT doc_id, page_no, band, max(r), max(hi) FROM V GROUP BY doc_id, page_no, band HAVING max(hi) > max(r))"""


@_query(_with(_L) + f", {_GAPS} SELECT * FROM G")
def band_gaps(spark, d):
    rows = S.lines(spark, d)
    return predicates.band_gaps(rows, layout.band_islands(rows))


@_query(_with(_L) + f", {_GAPS} SELECT g.doc_id, g.page_no, g.band, greatest(g.gap_start, n.gap_start) AS a, least(g.gap_end, n.gap_end) AS b FROM G g JOIN G n ON g.doc_id = n.doc_id AND g.page_no = n.page_no AND n.band = g.band + 1 WHERE least(g.gap_end, n.gap_end) > greatest(g.gap_start, n.gap_start)")
def shared_gaps(spark, d):
    rows = S.lines(spark, d)
    return predicates.shared_gaps(predicates.band_gaps(rows, layout.band_islands(rows)))


@_query(_with(_B) + """, C AS (SELECT doc_id, page_no, block_no, section_no AS row, column_no AS col, 1 + block_no % 2 AS row_span, 1 + block_no % 3 AS col_span FROM B), P AS (SELECT DISTINCT doc_id, page_no, row, col FROM C),
    H AS (SELECT P.doc_id, P.page_no, P.row, P.col, C.row AS r0, C.col AS c0, row_number() OVER (PARTITION BY P.doc_id, P.page_no, P.row, P.col ORDER BY C.row, C.col) AS k FROM P JOIN C ON P.doc_id = C.doc_id AND P.page_no = C.page_no AND P.row >= C.row AND P.row < C.row + C.row_span AND P.col >= C.col AND P.col < C.col + C.col_span)
    SELECT doc_id, page_no, row, col, r0, c0 FROM H WHERE k = 1""")
def covering_cell(spark, d):
    """Blocks as cells at (section, column) with spans, and which of them covers each place that is taken."""
    cells = S.blocks(spark, d).select(*PAGE, F.col("section_no").alias("row"), F.col("column_no").alias("col"), (1 + F.col("block_no") % 2).alias("row_span"), (1 + F.col("block_no") % 3).alias("col_span"))
    return predicates.covering_cell(cells, cells.select(*PAGE, "row", "col").distinct(), PAGE)


@_query(_with(_L, _B) + """, M AS (SELECT doc_id, page_no, line_ids[1] AS line_id, max(list_marker) AS glyph FROM B WHERE kind = 'ListItem' AND len(line_ids) > 0 GROUP BY ALL)
    SELECT L.doc_id, L.page_no, L.line_id, coalesce(M.glyph, '') AS glyph FROM L LEFT JOIN M ON L.doc_id = M.doc_id AND L.page_no = M.page_no AND L.line_id = M.line_id""")
def bullet_lookup(spark, d):
    """The list marker of the block that a line opens, '' for other lines."""
    marks = _kind(spark, d, "ListItem").where("size(line_ids) > 0").groupBy(*PAGE, F.col("line_ids")[0].alias("line_id")).agg(F.max("list_marker").alias("glyph"))
    return S.lines(spark, d).select(*PAGE, "line_id").join(marks, [*PAGE, "line_id"], "left").select(*PAGE, "line_id", F.coalesce("glyph", F.lit("")).alias("glyph"))


# ------------------------------------------------------------------------------ aggregations


@_query(_with(_L, _B, _BL) + """, T AS (SELECT doc_id, page_no, block_no, pos AS row, 0 AS col, line_id, coalesce(CAST(size_pt AS DOUBLE), 11.0) AS size, coalesce(bold, false) AS bold, length(coalesce(text, '')) AS n FROM BL WHERE kind = 'Table'),
    H AS (SELECT doc_id, page_no, block_no, round_even(size * 2, 0) AS half, sum(n) AS n, min(row) AS f FROM T GROUP BY ALL), M AS (SELECT doc_id, page_no, block_no, half / 2 AS mode FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, block_no ORDER BY n DESC, f) AS k FROM H) WHERE k = 1)
    SELECT T.doc_id, T.page_no, T.block_no, T.line_id, CASE WHEN abs(size - mode) / mode <= 0.3 THEN mode ELSE size END AS size, T.bold FROM T JOIN M ON T.doc_id = M.doc_id AND T.page_no = M.page_no AND T.block_no = M.block_no""")
def table_styles(spark, d):
    """Styles in Table blocks, whose lines are rows of one cell: here a row is bold if its line is, and no column adds to that."""
    cells = _kind(spark, d, "Table").select(*PAGE, "block_no", F.posexplode("line_ids").alias("row", "line_id")).withColumn("col", F.lit(0))
    return predicates.table_styles(S.lines(spark, d), cells)


@_query(_with(_L) + f""", A AS (SELECT *, (r - l) / length(text) / (b - t) AS ratio, length(text) AS n FROM L WHERE length(text) > 0 AND b > t), M AS (SELECT doc_id, page_no, {_MED('ratio')} AS med FROM A WHERE n >= 4 GROUP BY ALL)
    SELECT A.doc_id, A.page_no, A.line_id, ratio > med * 1.25 AS bold FROM A JOIN M ON A.doc_id = M.doc_id AND A.page_no = M.page_no""")
def bold_by_median(spark, d):
    """The rule for bold over the width of a character in line heights, as no stroke widths are in the tables."""
    rows = S.lines(spark, d).where("length(text) > 0 and b > t").select(*PAGE, "line_id", ((F.col("r") - F.col("l")) / F.length("text") / (F.col("b") - F.col("t"))).alias("ratio"), F.length("text").alias("n"))
    return predicates.bold_by_median(rows, "ratio", "n")


@_query(_with(_P) + """, R AS (SELECT DISTINCT doc_id, page_no FROM text_lines) SELECT P.doc_id, count(*) AS pages, count(R.page_no) AS recognised, bool_and(R.page_no IS NOT NULL) AS all_recognised FROM P LEFT JOIN R ON P.doc_id = R.doc_id AND P.page_no = R.page_no GROUP BY P.doc_id""")
def document_counters(spark, d):
    return edits.document_counters(S.pages(spark, d), S.read(spark, d, "text_lines").where("bounds is not null or bounds is null"))


@_query(_with(_L, _B, _BL) + """SELECT BL.doc_id, BL.page_no, BL.block_no, round(coalesce(avg(CASE WHEN CAST(L.confidence AS DOUBLE) > 1 THEN CAST(L.confidence AS DOUBLE) / 100 ELSE CAST(L.confidence AS DOUBLE) END), 0.0), 6) AS confidence
    FROM BL JOIN L ON BL.doc_id = L.doc_id AND BL.page_no = L.page_no AND BL.line_id = L.line_id GROUP BY BL.doc_id, BL.page_no, BL.block_no""")
def block_confidence(spark, d):
    """Mean of the parts' confidences (of a line's characters, here of a block's lines) by a fold; 0 without any."""
    own = layout.block_lines(S.lines(spark, d), S.blocks(spark, d))
    c = F.col("confidence").cast("double")
    agg = own.groupBy(*PAGE, "block_no").agg(F.collect_list(F.when(c > 1, c / 100).otherwise(c)).alias("x"))
    return agg.select(*PAGE, "block_no", _r(F.aggregate("x", F.lit(0.0), lambda a, v: a + v, lambda a: F.when(F.size("x") > 0, a / F.size("x")).otherwise(0.0))).alias("confidence"))


@_query(_with(_L) + """, A AS (SELECT doc_id, page_no, line_id, coalesce(CAST(size_pt AS DOUBLE), 11.0) AS size, length(coalesce(text, '')) AS n FROM L WHERE regexp_matches(text, '\\S')),
    B AS (SELECT doc_id, page_no, round_even(size * 2, 0) / 2 AS half, sum(n) AS w, min(line_id) AS f FROM A GROUP BY ALL), P AS (SELECT doc_id, page_no, list([half] ORDER BY w DESC, f) AS own FROM B GROUP BY ALL),
    K AS (SELECT doc_id, page_no, list_reduce(own, lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: abs(a - x[1]) / a <= 0.09)) > 0 THEN acc ELSE list_append(acc, x[1]) END) AS anchors FROM P),
    N AS (SELECT A.*, list_min(list_transform(anchors, lambda a, i: {'d': abs(a - size), 'i': i, 'a': a})).a AS best FROM A JOIN K ON A.doc_id = K.doc_id AND A.page_no = K.page_no)
    SELECT doc_id, page_no, line_id, CASE WHEN abs(best - size) / best <= 0.09 THEN best ELSE size END AS size FROM N""")
def size_anchors(spark, d):
    """Sizes of lines snapped to the anchors of their page."""
    rows = S.lines(spark, d).where("text rlike '\\\\S'")
    return layout.size_anchors(rows)


# ------------------------------------------------------------------------------ order


@_query(_with(_L) + "SELECT doc_id, page_no, line_id, (r - l) / (b - t) AS aspect, CAST(floor((row_number() OVER (PARTITION BY doc_id, page_no ORDER BY (r - l) / (b - t), line_id) - 1) / 8) AS INT) AS batch FROM L WHERE b > t")
def aspect_batches(spark, d):
    return predicates.aspect_batches(S.lines(spark, d))


@_query(_with(_L) + "SELECT doc_id, page_no, line_id, place FROM (SELECT doc_id, page_no, line_id, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY t, l, line_id) AS place FROM L) WHERE place <= 3000")
def first_boxes(spark, d):
    return predicates.first_boxes(S.lines(spark, d))


@_query(_with(_L) + f""", {_BANDS}, S AS (SELECT doc_id, page_no, band AS row, line_id, l, coalesce(text, '') AS text, max(b) OVER w - min(t) OVER w AS h, l - lag(r) OVER (PARTITION BY doc_id, page_no, band ORDER BY l, line_id) AS gap FROM V WINDOW w AS (PARTITION BY doc_id, page_no, band))
    SELECT doc_id, page_no, row, string_agg(CASE WHEN gap IS NULL THEN '' WHEN gap > h * 2.5 THEN chr(9) ELSE ' ' END || text, '' ORDER BY l, line_id) AS text FROM S GROUP BY doc_id, page_no, row""")
def segment_text(spark, d):
    rows = S.lines(spark, d)
    return predicates.segment_text(rows, layout.band_islands(rows).withColumnRenamed("band", "row"))


_CHARS = """Q AS (SELECT doc_id, page_no, line_id, text, l, t, r, b, coalesce(CAST(size_pt AS DOUBLE), 11.0) AS font_pt, coalesce(bold, false) AS bold, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY t, l, line_id) AS k FROM L WHERE length(text) > 0),
    CH AS (SELECT doc_id, page_no, k, i, substr(text, i, 1) AS ch, l + (r - l) * (i - 1) / length(text) AS l, t, l + (r - l) * i / length(text) AS r, b, font_pt, bold, i = 1 AS brk, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY k, i) AS char_no FROM (SELECT *, unnest(generate_series(1, length(text))) AS i FROM Q))"""


@_query(_with(_L) + f""", {_CHARS}, I AS (SELECT *, NOT regexp_matches(ch, '^[\\s\\p{{Z}}]$') AS ink FROM CH), K AS (SELECT *, coalesce(sum(CASE WHEN ink THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY char_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM I),
    M AS (SELECT * FROM (SELECT *, bool_or(brk) OVER (PARTITION BY doc_id, page_no, g) AS br, bool_or(NOT ink) OVER (PARTITION BY doc_id, page_no, g) AS bl FROM K) WHERE ink),
    N AS (SELECT *, lag(l) OVER w AS l0, lag(t) OVER w AS t0, lag(r) OVER w AS r0, lag(b) OVER w AS b0 FROM M WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY char_no)), H AS (SELECT *, greatest(1.0, least(b - t, b0 - t0)) AS lh FROM N),
    O AS (SELECT *, CASE WHEN l0 IS NULL OR br OR abs((t + b) / 2 - (t0 + b0) / 2) > lh * 0.6 OR l < l0 - lh OR l - r0 > greatest(lh, font_pt * 200 / 72) * 1.6 THEN 1 ELSE 0 END AS o FROM H),
    Z AS (SELECT *, sum(o) OVER (PARTITION BY doc_id, page_no ORDER BY char_no) AS line_no FROM O)
    SELECT doc_id, page_no, line_no, string_agg(CASE WHEN o = 0 AND bl THEN ' ' ELSE '' END || ch, '' ORDER BY char_no) AS text, round(min(l), 4) AS l, min(t) AS t, round(max(r), 4) AS r, max(b) AS b FROM Z GROUP BY doc_id, page_no, line_no""")
def text_layer_lines(spark, d):
    """Lines taken apart into characters of equal width, with a hard break before each, and put together again from these."""
    return textlayer.text_layer_lines(_characters(spark, d), 200.0).select(*PAGE, "line_no", "text", _r("l", 4).alias("l"), "t", _r("r", 4).alias("r"), "b")


def _characters(spark, d) -> DataFrame:
    rows = S.lines(spark, d).where("length(text) > 0").withColumn("k", F.row_number().over(W.partitionBy(*PAGE).orderBy("t", "l", "line_id")))
    n = F.length("text")
    chars = rows.select(*PAGE, "k", "l", "t", "r", "b", "size_pt", "bold", "italic", "color", "family", n.alias("n"), F.posexplode(F.transform(F.sequence(F.lit(1), n), lambda i: F.col("text").substr(i, F.lit(1)))).alias("i", "ch"))
    w, i = F.col("r") - F.col("l"), F.col("i")
    no = F.row_number().over(W.partitionBy(*PAGE).orderBy("k", "i"))
    return chars.select(*PAGE, no.alias("char_no"), "ch", (F.col("l") + w * i / F.col("n")).alias("l"), "t", (F.col("l") + w * (i + 1) / F.col("n")).alias("r"), "b", F.coalesce(F.col("size_pt").cast("double"), F.lit(11.0)).alias("font_pt"), F.coalesce("bold", F.lit(False)).alias("bold"), F.coalesce("italic", F.lit(False)).alias("italic"), "color", F.col("family").alias("font"), (i == 0).alias("hard_break"))


@_query(_with(_L) + f", {_CHARS} SELECT doc_id, page_no, count(*) FILTER (unicode(ch) > 32 AND unicode(ch) NOT IN (65533, 65534)) AS visible FROM CH GROUP BY doc_id, page_no")
def text_layer_count(spark, d):
    seen = (F.ascii("ch") > 0x20) & ~F.ascii("ch").isin(0xFFFD, 0xFFFE)
    return _characters(spark, d).groupBy(*PAGE).agg(F.count_if(seen).alias("visible"))


# ------------------------------------------------------------------------------ scalars


def _sql_css(c: str) -> str:
    return f"'#' || lower(lpad(to_hex({c} & 16777215), 6, '0'))"


@_query(_with(_L) + f""", C AS (SELECT DISTINCT CAST(color AS BIGINT) AS color FROM L WHERE color IS NOT NULL), P AS (SELECT color, color >> 16 & 255 AS r, color >> 8 & 255 AS g, color & 255 AS b FROM C), M AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM P)
    SELECT {_sql_css('color')} AS css, {_sql_css("CASE WHEN hi < 80 AND hi - lo < 30 THEN 0 WHEN lo > 225 THEN 16777215 WHEN hi - lo < 18 THEN CAST(least(255, round_even(floor((r + g + b) / 3) / 16.0, 0) * 16) AS BIGINT) * 65793 ELSE color END")} AS snapped FROM M""")
def snapped_colors(spark, d):
    c = S.lines(spark, d).where("color is not null").select(F.col("color").cast("int").alias("color")).distinct()
    return c.select(G.css_color(F.col("color")).alias("css"), G.css_color(G.snap_color(F.col("color"))).alias("snapped"))


_CJK_SQL = "[" + "".join(f"\\x{{{a}}}-\\x{{{b}}}" for a, b in (*T.CJK_RANGES, T.HANGUL_RANGE)) + "]"


@_query(_with(_L) + f"""SELECT doc_id, page_no, line_id, round(CASE WHEN b - t > 0 AND length(text) > 0 THEN (b - t) / CASE WHEN regexp_matches(text, '{_CJK_SQL}') THEN 0.88 WHEN regexp_matches(text, '[()\\[]') THEN 0.95
    WHEN regexp_matches(text, '[\\p{{Lu}}\\p{{Nd}}bdfhkltЁЙБДФ]') AND regexp_matches(text, '[gjpqyдзруфцщ]') THEN 0.92 WHEN regexp_matches(text, '[\\p{{Lu}}\\p{{Nd}}bdfhkltЁЙБДФgjpqyдзруфцщ]') THEN 0.72 ELSE 0.52 END ELSE 0.0 END, 6) AS px FROM L WHERE text IS NOT NULL""")
def font_pixels(spark, d):
    return S.lines(spark, d).where("text is not null").select(*PAGE, "line_id", _r(G.font_pixels(F.col("b") - F.col("t"), F.col("text"))).alias("px"))


@_query("""WITH O AS (SELECT DISTINCT ocr_language AS label FROM export_options UNION SELECT DISTINCT out_format FROM history_entries)
    SELECT label, CASE WHEN lower(label) IN ('zh', 'ch', 'chinese') THEN 'Chinese' WHEN lower(label) IN ('ja', 'jp', 'japanese') THEN 'Japanese' WHEN lower(label) IN ('ru', 'russian') THEN 'Russian' ELSE 'English' END AS language,
    CASE WHEN lower(label) IN ('xlsx', 'excel') THEN 'Xlsx' WHEN lower(label) IN ('html', 'htm') THEN 'Html' WHEN lower(label) IN ('txt', 'text') THEN 'Text' ELSE 'Docx' END AS format FROM O""")
def parsed_labels(spark, d):
    labels = S.read(spark, d, "export_options").select(F.col("ocr_language").alias("label")).union(S.read(spark, d, "history_entries").select("out_format")).distinct()
    return labels.select("label", T.parse_language(F.col("label")).alias("language"), T.parse_format(F.col("label")).alias("format"))


@_query(_with(_L) + """, N AS (SELECT DISTINCT unnest([family, 'ABCDEF+' || family || '-BoldMT', family || ',Italic', family || 'PSMT']) AS name FROM L WHERE family IS NOT NULL), A AS (SELECT name, CASE WHEN instr(name, '+') = 7 THEN substr(name, 8) ELSE name END AS x FROM N),
    B AS (SELECT name, regexp_replace(regexp_replace(x, '(?i)[-,](Bold|Italic|Oblique|Regular|Roman|Book|Medium|Light|Black|Semibold|SemiBold|Demi|Heavy|BoldItalic|BoldOblique)+.*$', ''), '(PSMT|MT|PS)$', '') AS x FROM A)
    SELECT name, nullif(trim(regexp_replace(x, '([a-z])([A-Z])', '\\1 \\2', 'g')), '') AS family, regexp_matches(name, '(?i)Bold|Black|Heavy|Semibold|Demi') AS bold, regexp_matches(name, '(?i)Italic|Oblique') AS italic FROM B""")
def font_names(spark, d):
    """Families, weights and slants from font names as text layers have them, made from the families of lines."""
    f = F.col("family")
    forms = F.array(f, F.concat(F.lit("ABCDEF+"), f, F.lit("-BoldMT")), F.concat(f, F.lit(",Italic")), F.concat(f, F.lit("PSMT")))
    names = S.lines(spark, d).where("family is not null").select(F.explode(forms).alias("name")).distinct()
    n = F.col("name")
    return names.select("name", T.clean_font_name(n).alias("family"), T.font_bold(n, F.lit(None).cast("int")).alias("bold"), T.font_italic(n, F.lit(None).cast("boolean")).alias("italic"))


@_query(_with(_L, _P) + """, A AS (SELECT L.doc_id, L.page_no, L.line_id, r - l AS w, b - t AS h, length(text) * coalesce(CAST(size_pt AS DOUBLE), 11.0) * 0.5 AS tw, coalesce(CAST(P.dpi AS DOUBLE), 96.0) AS dpi FROM L JOIN P ON L.doc_id = P.doc_id AND L.page_no = P.page_no WHERE text IS NOT NULL AND r > l AND b > t), U AS (SELECT *, w * h * 1.5 / (2 * (w + h)) AS g FROM A)
    SELECT doc_id, page_no, line_id, CASE WHEN tw > 0 THEN greatest(40, least(250, CAST(round_even(w * 72 / dpi / tw * 100, 0) AS INT))) ELSE 100 END AS scale, round_even(greatest(2.0, w * 96 / dpi / 7.0), 2) AS chars,
    CASE WHEN least(w + 2 * g, h + 2 * g) >= 5 THEN round(w + 2 * g, 6) END AS uw, CASE WHEN least(w + 2 * g, h + 2 * g) >= 5 THEN round(h + 2 * g, 6) END AS uh FROM U""")
def line_measures(spark, d):
    """Stretch of a line to its box (by half an em for each character), its width in a sheet's characters, its box grown for a detector."""
    rows = S.lines(spark, d).where("text is not null and r > l and b > t").join(S.pages(spark, d).select(*PAGE, F.coalesce(F.col("dpi").cast("double"), F.lit(96.0)).alias("dpi")), PAGE)
    w, h, dpi = F.col("r") - F.col("l"), F.col("b") - F.col("t"), F.col("dpi")
    uw, uh = G.unclip(w, h)
    return rows.select(*PAGE, "line_id", G.fit_scale(w * 72 / dpi, F.length("text") * F.coalesce(F.col("size_pt").cast("double"), F.lit(11.0)) * 0.5).alias("scale"), G.grid_width(w, dpi).alias("chars"), _r(uw).alias("uw"), _r(uh).alias("uh"))


@_query(_with(_L, _B) + """SELECT doc_id, page_no, block_no, round((r - l) * (b - t), 4) AS area, round(2 * ((r - l) + (b - t)), 4) AS perimeter FROM B""")
def polygon_measures(spark, d):
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    points = F.array(corner("l", "t"), corner("r", "t"), corner("r", "b"), corner("l", "b"))
    return S.blocks(spark, d).select(*PAGE, "block_no", _r(G.polygon_area(points), 4).alias("area"), _r(G.polygon_perimeter(points), 4).alias("perimeter"))


@_query(_with(_P) + """SELECT doc_id, page_no, round(coalesce(CAST(crop.x AS DOUBLE), 0.0) + 10.0 / width * coalesce(CAST(crop.w AS DOUBLE), 1.0), 9) AS x, round(coalesce(CAST(crop.y AS DOUBLE), 0.0) + 20.0 / height * coalesce(CAST(crop.h AS DOUBLE), 1.0), 9) AS y,
    round(100.0 / width * coalesce(CAST(crop.w AS DOUBLE), 1.0), 9) AS w, round(200.0 / height * coalesce(CAST(crop.h AS DOUBLE), 1.0), 9) AS h FROM P WHERE width > 0 AND height > 0""")
def crop_within(spark, d):
    """A crop of 100 x 200 pixels at (10, 20) inside each page's own crop."""
    n = lambda v: F.lit(float(v))
    c = predicates.crop_within(F.col("crop"), n(10), n(20), n(100), n(200), F.col("width"), F.col("height"))
    return S.pages(spark, d).where("width > 0 and height > 0").select(*PAGE, *[_r(c[f], 9).alias(f) for f in "xywh"])


@_query(_with(_L, _B, _BL) + """SELECT BL.doc_id, BL.page_no, BL.block_no, BL.line_id, CASE WHEN abs((BL.l - B.l) - (B.r - BL.r)) < (B.r - B.l) * 0.12 AND BL.l - B.l > (B.r - B.l) * 0.08 THEN 'Center' WHEN B.r - BL.r < (BL.l - B.l) * 0.35 THEN 'Right' ELSE 'Left' END AS align
    FROM BL JOIN B ON BL.doc_id = B.doc_id AND BL.page_no = B.page_no AND BL.block_no = B.block_no WHERE BL.kind = 'Table'""")
def cell_align(spark, d):
    tables = _kind(spark, d, "Table")
    own = layout.block_lines(S.lines(spark, d), tables).join(tables.select(*PAGE, "block_no", F.col("l").alias("xl"), F.col("r").alias("xr")), [*PAGE, "block_no"])
    return own.select(*PAGE, "block_no", "line_id", predicates.cell_align(F.col("l"), F.col("r"), F.col("xl"), F.col("xr")).alias("align"))


_BUL, _ORD = (x.replace("'", "''") for x in (T.BULLET_MARKER, T.ORDERED_MARKER))


@_query(_with(_L) + f""", M AS (SELECT *, CASE WHEN regexp_extract(text, '{_BUL}', 0) <> '' THEN regexp_extract(text, '{_BUL}', 0) ELSE regexp_extract(text, '{_ORD}', 0) END AS m FROM L WHERE length(text) > 0), N AS (SELECT *, greatest(length(m) - 1, 0) AS n FROM M)
    SELECT doc_id, page_no, line_id, n AS prefix, CASE WHEN n > 0 THEN regexp_replace(substr(text, n + 1), '^[\\s\\p{{Z}}]+', '') ELSE text END AS rest, round(l + (r - l) * n / length(text), 6) AS text_left FROM N""")
def marker_text(spark, d):
    """Of each line: the characters of its list marker, the text behind it, and where that begins."""
    t, n = F.col("text"), F.col("prefix")
    rows = S.lines(spark, d).where("length(text) > 0").withColumn("prefix", T.marker_prefix(t))
    rest = F.when(n > 0, F.regexp_replace(F.substring(t, n + 1, F.length(t)), f"^[{T.BLANK}]+", "")).otherwise(t)
    return rows.select(*PAGE, "line_id", "prefix", rest.alias("rest"), _r(F.col("l") + (F.col("r") - F.col("l")) * n / F.length(t)).alias("text_left"))


@_query(_with(_L) + f"""SELECT doc_id, count(*) FILTER (regexp_matches(text, '^{_CJK_SQL}')) AS cjk, count(*) FILTER (regexp_matches(text, '^{_CJK_SQL.replace(chr(92) + 'x{AC00}-' + chr(92) + 'x{D7AF}', '')}')) AS joined FROM L WHERE length(text) > 0 GROUP BY doc_id""")
def cjk_openings(spark, d):
    """Lines of each file that open with a CJK character, and with one that needs no blank before it."""
    first = F.substring("text", 1, 1)
    return S.lines(spark, d).where("length(text) > 0").groupBy("doc_id").agg(F.count_if(T.is_cjk(first)).alias("cjk"), F.count_if(T.joins_without_space(first)).alias("joined"))


@_query(_with(_L) + """, A AS (SELECT doc_id, page_no, line_id, l, r, lag(l) OVER w AS l0, lag(r) OVER w AS r0 FROM L WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY t, l, line_id))
    SELECT doc_id, page_no, line_id, CASE WHEN least(r - l, r0 - l0) > 0 THEN round(greatest(least(r, r0) - greatest(l, l0), 0.0) / least(r - l, r0 - l0), 6) ELSE 0.0 END AS ratio FROM A WHERE l0 IS NOT NULL""")
def overlap_ratios(spark, d):
    """How much of the narrower one a line and the one before it share from left to right."""
    w = W.partitionBy(*PAGE).orderBy("t", "l", "line_id")
    rows = S.lines(spark, d).select(*PAGE, "line_id", "l", "r", F.lag("l").over(w).alias("l0"), F.lag("r").over(w).alias("r0")).where("l0 is not null")
    return rows.select(*PAGE, "line_id", _r(G.overlap_ratio(F.col("l"), F.col("r"), F.col("l0"), F.col("r0"))).alias("ratio"))


@_query(_with(_L) + "SELECT doc_id, page_no, line_id, greatest(4.0, round_even(CAST(size_pt AS DOUBLE) * 2, 0) / 2) AS size, greatest(2, CAST(round_even(CAST(size_pt AS DOUBLE) * 2, 0) AS BIGINT)) AS half_points FROM L WHERE size_pt IS NOT NULL")
def rounded_sizes(spark, d):
    s = F.col("size_pt").cast("double")
    return S.lines(spark, d).where("size_pt is not null").select(*PAGE, "line_id", G.round_half(s).alias("size"), G.half_points(s).alias("half_points"))


# ------------------------------------------------------------------------------ sources and mutations


@_query(_with(_P) + """, D AS (SELECT DISTINCT image_path AS path FROM P WHERE image_path IS NOT NULL UNION SELECT DISTINCT source_path FROM ocr_docs WHERE source_path IS NOT NULL),
    K AS (SELECT path, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS ext, regexp_extract(path, '^(.*)[\\\\/][^\\\\/]*$', 1) AS folder, regexp_extract(path, '([^\\\\/]*)$', 1) AS name FROM D), N AS (SELECT *, list_transform(regexp_extract_all(upper(name), '([0-9]+|[^0-9]+)'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(CAST(length(ltrim(p, '0')) AS VARCHAR), 10, '0') || ltrim(p, '0') ELSE p END) AS parts FROM K)
    SELECT folder AS document, 'ImageSequence' AS kind, path, row_number() OVER (PARTITION BY folder ORDER BY array_to_string(parts, chr(1)), path) AS page_no, NULL AS error FROM N WHERE ext IN ('png', 'jpg', 'jpeg', 'jpe', 'bmp', 'dib', 'gif', 'tif', 'tiff', 'ico', 'emf', 'wmf')
    UNION ALL SELECT path, 'Pdf', path, 1, NULL FROM N WHERE ext = 'pdf' UNION ALL SELECT path, 'Rejected', path, NULL, 'unsupported file type' FROM N WHERE ext NOT IN ('pdf', 'png', 'jpg', 'jpeg', 'jpe', 'bmp', 'dib', 'gif', 'tif', 'tiff', 'ico', 'emf', 'wmf')""")
def workspace_documents(spark, d):
    paths = S.pages(spark, d).where("image_path is not null").select(F.col("image_path").alias("path")).union(S.read(spark, d, "ocr_docs").where("source_path is not null").select("source_path")).distinct()
    return S.workspace_documents(paths)


@_query(_with(_B) + """, E AS (SELECT *, CASE WHEN block_no % 7 = 0 THEN block_no % 6 END AS s, kind = 'ListItem' AND coalesce(ordered_list, false) AS item FROM B), R AS (SELECT *, sum(CASE WHEN item THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_no ORDER BY block_no) AS run FROM E),
    N AS (SELECT *, count(*) FILTER (item) OVER (PARTITION BY doc_id, page_no, run ORDER BY block_no) AS c FROM R), M AS (SELECT *, CASE WHEN item THEN c ELSE coalesce(lag(c) OVER (PARTITION BY doc_id, page_no ORDER BY block_no), 0) + 1 END AS n, s IS NOT NULL AND kind NOT IN ('Table', 'Figure') AS o FROM N)
    SELECT doc_id, page_no, block_no, CASE WHEN NOT o THEN kind WHEN s = 0 THEN 'Paragraph' WHEN s <= 3 THEN 'Heading' ELSE 'ListItem' END AS kind, CASE WHEN o AND s BETWEEN 1 AND 3 THEN s ELSE heading_level END AS heading_level,
    CASE WHEN o THEN CASE s WHEN 4 THEN '•' WHEN 5 THEN n || '.' END ELSE list_marker END AS list_marker, CASE WHEN o AND s >= 4 THEN s = 5 ELSE coalesce(ordered_list, false) END AS ordered_list FROM M""")
def restyled_blocks(spark, d):
    """Every seventh block of a page is given a style by its number."""
    blocks = S.blocks(spark, d)
    return edits.restyle_blocks(blocks, blocks.where("block_no % 7 = 0").select(*PAGE, "block_no", (F.col("block_no") % 6).alias("style")))


@_query(_with(_L, _B) + """, H AS (SELECT doc_id, page_no, block_no, unnest(line_ids) AS line_id FROM B WHERE kind NOT IN ('Table', 'Figure')), E AS (SELECT doc_id, page_no, line_id, NOT coalesce(bold, false) AS nb, 12.5 AS ns FROM L WHERE edited),
    S AS (SELECT E.*, H.block_no FROM E LEFT JOIN H ON E.doc_id = H.doc_id AND E.page_no = H.page_no AND E.line_id = H.line_id), A AS (SELECT H.doc_id, H.page_no, H.line_id, S.nb, S.ns FROM S JOIN H ON S.doc_id = H.doc_id AND S.page_no = H.page_no AND S.block_no = H.block_no UNION ALL SELECT doc_id, page_no, line_id, nb, ns FROM S WHERE block_no IS NULL),
    M AS (SELECT doc_id, page_no, line_id, bool_or(nb) AS nb, max(ns) AS ns FROM A GROUP BY ALL)
    SELECT L.doc_id, L.page_no, L.line_id, coalesce(M.nb, L.bold, false) AS bold, coalesce(L.italic, false) AS italic, coalesce(M.ns, CAST(size_pt AS DOUBLE)) AS size_pt, family FROM L LEFT JOIN M ON L.doc_id = M.doc_id AND L.page_no = M.page_no AND L.line_id = M.line_id""")
def edited_styles(spark, d):
    """The bold toggle and a size of 12.5 points for each line that was edited, over its whole block."""
    rows = S.lines(spark, d)
    asked = rows.where("edited").select(*PAGE, "line_id", F.lit(True).alias("toggle_bold"), F.lit(False).alias("toggle_italic"), F.lit(" ").alias("family"), F.lit(12.5).alias("size"))
    return edits.edit_styles(rows, S.blocks(spark, d), asked)


@_query(_with(_P) + """, E AS (SELECT *, ((coalesce(rotation, 0) % 360) + 360) % 360 AS rot, CASE WHEN page_no % 3 = 0 THEN 90 WHEN page_no % 3 = 1 THEN 0 END AS turn, page_no % 2 = 0 AND page_no % 3 <> 2 AS cut FROM P), F AS (SELECT *, coalesce(turn, 0) <> 0 AS turned, CASE WHEN coalesce(turn, 0) = 0 THEN crop END AS base FROM E)
    SELECT doc_id, page_no, CASE WHEN turned THEN (rot + turn) % 360 ELSE rot END AS rotation, CASE WHEN cut THEN round(coalesce(CAST(base.x AS DOUBLE), 0.0) + 0.25 * coalesce(CAST(base.w AS DOUBLE), 1.0), 9) ELSE round(CAST(base.x AS DOUBLE), 9) END AS x,
    CASE WHEN cut THEN round(0.5 * coalesce(CAST(base.w AS DOUBLE), 1.0), 9) ELSE round(CAST(base.w AS DOUBLE), 9) END AS w, page_version + CAST(turned AS INT) + CAST(cut AS INT) AS page_version, NOT turned AND NOT cut AS result_kept FROM F""")
def turned_pages(spark, d):
    """Pages by number turned, cropped to their middle, both or neither."""
    pages, n = S.pages(spark, d), F.col("page_no")
    half = F.struct(*[F.lit(v).alias(f) for f, v in (("x", 0.25), ("y", 0.25), ("w", 0.5), ("h", 0.5))])
    asked = pages.where("page_no % 3 != 2").select(*PAGE, F.when(n % 3 == 0, 90).otherwise(0).alias("turn"), F.when(n % 2 == 0, half).alias("crop"))
    out = edits.turn_and_crop(pages, asked)
    return out.select(*PAGE, "rotation", _r(F.col("crop.x"), 9).alias("x"), _r(F.col("crop.w"), 9).alias("w"), "page_version", "result_kept")


# ------------------------------------------------------------------------------ the whole analysis, and its renderings


def _analysed(spark, d, mode: str = "auto") -> DataFrame:
    rows, special = S.lines(spark, d), _kind(spark, d, "Table", "Figure")
    inside = special.select(*PAGE, F.explode("line_ids").alias("line_id")).distinct()
    free = rows.where("not coalesce(in_figure, false)").join(inside, [*PAGE, "line_id"], "left_anti")
    return analysis.analysed_blocks(rows if mode == "lines" else free, special, S.pages(spark, d), mode)


@_query()
def sections(spark, d):
    own = _analysed(spark, d)
    return own.groupBy(*PAGE, "section_no").agg(F.first("section_box").alias("x"), F.max("columns").alias("columns"), F.count("*").alias("blocks")).select(*PAGE, "section_no", "columns", "blocks", "x.l", "x.t", "x.r", "x.b")


@_query()
def columns(spark, d):
    own = _analysed(spark, d)
    return own.groupBy(*PAGE, "section_no", "column_no").agg(F.first("column_box").alias("x"), F.count("*").alias("blocks")).select(*PAGE, "section_no", "column_no", "blocks", "x.l", "x.t", "x.r", "x.b")


@_query()
def paragraph_blocks(spark, d):
    return _analysed(spark, d).select(*PAGE, "block_no", "kind", "heading_level", "list_marker", "ordered_list", "line_ids", "text", "align", "size_pt", "bold", "indent", "line_spacing", "space_before", *[F.col(f"box.{c}").alias(c) for c in "ltrb"])


@_query()
def lines_only_blocks(spark, d):
    return _analysed(spark, d, "lines").select(*PAGE, "block_no", "line_ids", "text", "space_before", "line_spacing")


@_query()
def borderless_tables(spark, d):
    own = _analysed(spark, d).where("cells is not null")
    return own.select(*PAGE, "block_no", F.explode("cells").alias("c")).select(*PAGE, "block_no", "c.row", "c.col", "c.line_ids", "c.text")


def _rendered(spark, d, fn, schema: str, mode: str = "auto") -> DataFrame:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    own = _analysed(spark, d, mode)
    parts = F.array_sort(F.collect_list(F.struct([c for c in own.columns if c not in PAGE])))
    pages = S.pages(spark, d).select(*PAGE, *[F.col(c).cast("double").alias(c) for c in ("width", "height")], F.coalesce(F.col("dpi").cast("double"), F.lit(96.0)).alias("dpi"))
    rows = pages.join(own.groupBy(*PAGE).agg(parts.alias("blocks")), PAGE, "left")
    arrow: pa.Schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        from pagewright.operators.kernel import to_batch

        for b in batches:
            out = []
            for row in b.to_pylist():
                page = {"width": row["width"] or 0.0, "height": row["height"] or 0.0, "dpi": row["dpi"]}
                out += [(row["doc_id"], row["page_no"], *x) for x in fn(row["blocks"] or [], page, row["page_no"] - 1)]
            if out:
                yield to_batch(out, arrow)

    return rows.mapInArrow(run, schema)


@_query()
def html_flow_pages(spark, d):
    return _rendered(spark, d, lambda b, p, i: [(markup.flow_html(b, p, i),)], "doc_id bigint, page_no int, html string")


@_query()
def html_plain_pages(spark, d):
    return _rendered(spark, d, lambda b, p, i: [(markup.plain_html(b, p, i),)], "doc_id bigint, page_no int, html string")


def _exact(spark, d, fn) -> DataFrame:
    """fn of the lines of each page that stand outside of figures, and of the page."""
    rows = S.lines(spark, d).where("text is not null and not coalesce(in_figure, false)")
    lines = rows.groupBy(*PAGE).agg(F.collect_list(F.struct("t", "l", "r", "b", "text", F.col("size_pt").cast("double").alias("size_pt"), F.coalesce("bold", F.lit(False)).alias("bold"))).alias("lines"))
    pages = S.pages(spark, d).select(*PAGE, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("width", "height")], F.coalesce(F.col("dpi").cast("double"), F.lit(96.0)).alias("dpi"))
    out = F.udf(lambda own, w, h, dpi, n: fn([x.asDict() for x in own or []], {"width": w, "height": h, "dpi": dpi}, n - 1), "string", useArrow=True)
    return pages.join(lines, PAGE, "left").select(*PAGE, out("lines", "width", "height", "dpi", "page_no").alias("body"))


@_query()
def html_exact_pages(spark, d):
    """Lines of each page at their places."""
    return _exact(spark, d, markup.exact_html)


@_query()
def word_exact_pages(spark, d):
    """Lines of each page in frames at their places."""
    return _exact(spark, d, lambda lines, page, n: markup.exact_xml(lines, page))


@_query()
def block_hulls(spark, d):
    """Hull of the corners of each block's lines, and the smallest rectangle around it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    own = layout.block_lines(S.lines(spark, d), S.blocks(spark, d))
    boxes = own.groupBy(*PAGE, "block_no").agg(F.flatten(F.collect_list(F.array(*"ltrb"))).alias("boxes"))
    schema = "doc_id bigint, page_no int, block_no int, corners int, cx double, cy double, w double, h double, angle double"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def measure(flat):
        box = iter(flat)
        hull = G.convex_hull([p for l, t, r, b in zip(box, box, box, box) for p in ((l, t), (r, t), (r, b), (l, b))])  # noqa: E741
        return (len(hull), *[round(v, 4) for v in G.min_area_rect(hull)])

    def run(batches):
        from pagewright.operators.kernel import to_batch

        for x in batches:
            yield to_batch([(*key, *measure(flat)) for *key, flat in zip(*[c.to_pylist() for c in x.columns])], arrow)

    return boxes.mapInArrow(run, schema)


@_query()
def word_pages(spark, d):
    return _rendered(spark, d, lambda b, p, i: [markup.editable_xml(b, p, i == 0)], "doc_id bigint, page_no int, body string, section string")


@_query()
def word_plain_pages(spark, d):
    return _rendered(spark, d, lambda b, p, i: [(markup.plain_xml(b),)], "doc_id bigint, page_no int, body string")


@_query()
def sheet_cells(spark, d):
    return _rendered(spark, d, lambda b, p, i: sheets.sheet_cells(b, p), "doc_id bigint, page_no int, row int, col int, ref string, col_span int, row_span int, text string, value double, format_id int")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
