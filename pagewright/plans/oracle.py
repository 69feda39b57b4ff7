"""SQL for the queries over the reference's own operators. Folds and the like, which SQL can't say, are tested by brute force instead."""

from __future__ import annotations

from ..functions import text as T

_L = """L AS (SELECT doc_id, page_no, line_id, text, confidence, CAST(bounds.l AS DOUBLE) AS l, CAST(bounds.t AS DOUBLE) AS t, CAST(bounds.r AS DOUBLE) AS r, CAST(bounds.b AS DOUBLE) AS b,
  style.size_pt AS size_pt, style.bold AS bold, style.italic AS italic, style.color AS color, style.family AS family, in_figure, edited
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, line_id ORDER BY loaded_at, text) AS rn FROM text_lines WHERE bounds IS NOT NULL) WHERE rn = 1)"""
_B = """B AS (SELECT doc_id, page_no, block_no, kind, line_ids, CAST(bounds.l AS DOUBLE) AS l, CAST(bounds.t AS DOUBLE) AS t, CAST(bounds.r AS DOUBLE) AS r, CAST(bounds.b AS DOUBLE) AS b,
  heading_level, list_marker, ordered_list, section_no, column_no, align, space_before
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, block_no ORDER BY kind, space_before NULLS FIRST) AS rn FROM layout_blocks WHERE bounds IS NOT NULL) WHERE rn = 1)"""
_P = "P AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY loaded_at NULLS FIRST) AS rn FROM doc_pages) WHERE rn = 1)"
_BL = """BL AS (SELECT B.doc_id, B.page_no, B.block_no, B.kind, B.list_marker, B.pos, L.line_id, L.text, L.l, L.t, L.r, L.b, L.size_pt, L.bold
  FROM (SELECT doc_id, page_no, block_no, kind, list_marker, i - 1 AS pos, line_ids[i] AS line_id FROM (SELECT *, unnest(generate_series(1, len(line_ids))) AS i FROM B)) B
  JOIN L ON L.doc_id = B.doc_id AND L.page_no = B.page_no AND L.line_id = B.line_id)"""
_CJK = "[" + "".join(f"\\x{{{a}}}-\\x{{{b}}}" for a, b in T.CJK_RANGES) + "]"
_BLANK, _ENDS = "[\\s\\p{Z}]", "'[\\s\\p{Z}]+$', ''"
_BUL, _ORD = (x.replace("'", "''") for x in (T.BULLET_MARKER, T.ORDERED_MARKER))


def _flow(raw: str) -> str:
    """Flowing text of lines that are trimmed at their ends and joined by line feeds."""
    out = f"regexp_replace({raw}, '^\\n+', '')"
    for _ in range(2):  # a letter may be behind one mark and before the next
        out = f"regexp_replace({out}, '(\\p{{L}})-\\n(\\p{{Ll}})', '\\1\\2', 'g')"
    out = f"regexp_replace({out}, '({_CJK})\\n+', '\\1', 'g')"
    for _ in range(2):
        out = f"regexp_replace({out}, '\\n({_CJK})', '\\1', 'g')"
    return f"replace({out}, chr(10), ' ')"


_N = f"greatest(length(CASE WHEN regexp_extract(text, '{_BUL}', 0) <> '' THEN regexp_extract(text, '{_BUL}', 0) ELSE regexp_extract(text, '{_ORD}', 0) END) - 1, 0)"
#: Texts of blocks: as printed, and flowing.
_X = f"""X0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, block_no ORDER BY pos, text) AS k FROM BL WHERE text IS NOT NULL),
  X1 AS (SELECT *, CASE WHEN kind = 'ListItem' AND list_marker IS NOT NULL AND k = 1 AND {_N} > 0 THEN regexp_replace(substr(text, {_N} + 1), '^[\\s\\p{{Z}}]+', '') ELSE text END AS s FROM X0),
  X2 AS (SELECT doc_id, page_no, block_no, kind, max(list_marker) AS mark, string_agg(s, chr(10) ORDER BY k) AS raw, string_agg(s, ' ' ORDER BY k) AS line, string_agg(regexp_replace(s, {_ENDS}), chr(10) ORDER BY k) AS ended FROM X1 GROUP BY doc_id, page_no, block_no, kind),
  X3 AS (SELECT *, CASE WHEN kind = 'ListItem' AND mark IS NOT NULL THEN mark || ' ' ELSE '' END AS m FROM X2),
  X AS (SELECT doc_id, page_no, block_no, kind, CASE kind WHEN 'Table' THEN regexp_replace(regexp_replace(raw, '\\t| {{2,}}', chr(9), 'g'), {_ENDS}) WHEN 'Figure' THEN '' WHEN 'Heading' THEN m || line ELSE m || raw END AS text,
    CASE WHEN kind IN ('Table', 'Figure') THEN '' ELSE m || {_flow('ended')} END AS flow FROM X3)"""
_PT = f"PT AS (SELECT doc_id, page_no, regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY block_no), {_ENDS}) || chr(10) AS text FROM X WHERE text <> '' GROUP BY doc_id, page_no)"
_W = "OVER (PARTITION BY doc_id, page_no ORDER BY t, l, line_id)"
_BULLET, _ORDERED = _BUL, _ORD
_MED = lambda x: f"list_sort(list({x}) FILTER ({x} IS NOT NULL))[CAST(floor(count({x}) / 2) AS INT) + 1]"
_COVER = "greatest(least(a.r, x.r) - greatest(a.l, x.l), 0.0) * greatest(least(a.b, x.b) - greatest(a.t, x.t), 0.0) * 10 > (a.r - a.l) * (a.b - a.t) * "
_ON = "a.doc_id = x.doc_id AND a.page_no = x.page_no"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def oracle_sql() -> dict[str, str]:
    l, b, bl = _with(_L), _with(_B), _with(_L, _B, _BL)  # noqa: E741
    x = _with(_L, _B, _BL, _X)
    return {
        "list_marker_classify": l + f"""SELECT doc_id, marker_kind, count(*) AS n, count(DISTINCT m) AS markers FROM (SELECT doc_id, regexp_extract(text, '{_ORDERED}', 1) AS m,
            CASE WHEN regexp_extract(text, '{_BULLET}', 1) || regexp_extract(text, '{_BULLET}', 2) <> '' THEN 'bullet' WHEN regexp_extract(text, '{_ORDERED}', 1) <> '' THEN 'ordered' ELSE 'none' END AS marker_kind
            FROM L WHERE regexp_matches(text, '\\S')) GROUP BY doc_id, marker_kind""",
        "page_median_height": l + f"SELECT doc_id, page_no, {_MED('(b - t)')} AS h_med, count(*) AS n_lines FROM L GROUP BY doc_id, page_no",
        "body_font_size": l + """, S AS (SELECT doc_id, page_no, CAST(round_even(CAST(size_pt AS DOUBLE) * 2, 0) AS BIGINT) AS half_pt, sum(length(coalesce(text, ''))) AS w, min(line_id) AS f FROM L WHERE size_pt IS NOT NULL GROUP BY ALL)
            SELECT doc_id, page_no, half_pt, w AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY w DESC, f) AS k FROM S) WHERE k = 1""",
        "bbox_union": l + "SELECT doc_id, page_no, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b FROM L GROUP BY doc_id, page_no",
        "mean_confidence": l + """SELECT doc_id, page_no, count(confidence) AS n, CASE WHEN count(confidence) > 0 THEN CAST(sum(CAST(round_even(CASE WHEN CAST(confidence AS DOUBLE) > 1 THEN CAST(confidence AS DOUBLE) * 10 ELSE CAST(confidence AS DOUBLE) * 1000 END, 0) AS BIGINT)) AS DOUBLE) / count(confidence) ELSE 0.0 END AS mean_thousandths FROM L GROUP BY doc_id, page_no""",
        "confidence_filter": l + f"SELECT doc_id, page_no, line_id, row_number() {_W} AS new_id FROM L WHERE regexp_matches(text, '\\S') AND CASE WHEN confidence > 1 THEN CAST(confidence AS DOUBLE) / 100 ELSE confidence END >= 0.5",
        "uncertain_lines": l + "SELECT doc_id, count(*) AS uncertain FROM L WHERE NOT edited AND CASE WHEN confidence > 1 THEN CAST(confidence AS DOUBLE) / 100 ELSE CAST(confidence AS DOUBLE) END < 0.75 GROUP BY doc_id",
        "band_islands": l + """SELECT doc_id, page_no, line_id, sum(opens) OVER (PARTITION BY doc_id, page_no ORDER BY t, l, line_id) AS band FROM (SELECT *, CASE WHEN m IS NULL OR t >= m THEN 1 ELSE 0 END AS opens FROM
            (SELECT *, max(b) OVER (PARTITION BY doc_id, page_no ORDER BY t, l, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM L))""",
        "band_fold": """WITH RECURSIVE """ + _L + """, O AS (SELECT doc_id, page_no, line_id, t, b, b - t AS h, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY t, l, line_id) AS k FROM L),
            F AS (SELECT doc_id, page_no, line_id, k, 1 AS band, b AS bottom, h AS least FROM O WHERE k = 1 UNION ALL
            SELECT O.doc_id, O.page_no, O.line_id, O.k, CASE WHEN O.t < F.bottom - 0.4 * least(O.h, CASE WHEN F.least > 0 THEN F.least ELSE O.h END) THEN F.band ELSE F.band + 1 END, CASE WHEN O.t < F.bottom - 0.4 * least(O.h, CASE WHEN F.least > 0 THEN F.least ELSE O.h END) THEN greatest(F.bottom, O.b) ELSE O.b END,
            CASE WHEN O.t < F.bottom - 0.4 * least(O.h, CASE WHEN F.least > 0 THEN F.least ELSE O.h END) THEN least(F.least, O.h) ELSE O.h END FROM F JOIN O ON O.doc_id = F.doc_id AND O.page_no = F.page_no AND O.k = F.k + 1)
            SELECT doc_id, page_no, line_id, band FROM F""",
        "visual_lines": """WITH RECURSIVE """ + _L + """, O AS (SELECT doc_id, page_no, line_id, t, b, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY t, l, line_id) AS k, count(*) OVER (PARTITION BY doc_id, page_no) AS n FROM L),
            F AS (SELECT doc_id, page_no, k, n, [{'t': t, 'b': b, 'ids': [line_id]}] AS v FROM O WHERE k = 1 UNION ALL
            SELECT doc_id, page_no, k, n, CASE WHEN hit IS NULL THEN list_append(v, {'t': t, 'b': b, 'ids': [line_id]}) ELSE list_transform(v, lambda x, i: CASE WHEN i = hit THEN {'t': least(x.t, t), 'b': greatest(x.b, b), 'ids': list_append(x.ids, line_id)} ELSE x END) END
            FROM (SELECT O.*, F.v, list_max(list_filter(list_transform(F.v, lambda x, i: CASE WHEN least(x.b - x.t, O.b - O.t) > 0 AND least(x.b, O.b) - greatest(x.t, O.t) > 0.55 * least(x.b - x.t, O.b - O.t) THEN i END), lambda i: i IS NOT NULL)) AS hit FROM F JOIN O ON O.doc_id = F.doc_id AND O.page_no = F.page_no AND O.k = F.k + 1)),
            S AS (SELECT doc_id, page_no, list_sort(v) AS v FROM F WHERE k = n) SELECT doc_id, page_no, i AS vline_id, unnest(v[i].ids) AS line_id FROM (SELECT *, unnest(generate_series(1, len(v))) AS i FROM S)""",
        "cluster_first": l + """, V AS (SELECT doc_id, page_no, list_transform(list_sort(list_distinct(list(l))), lambda x: [x]) AS v FROM L GROUP BY doc_id, page_no), K AS (SELECT doc_id, page_no, list_reduce(v, lambda acc, x: CASE WHEN x[1] - acc[-1] <= 8.0 THEN acc ELSE list_append(acc, x[1]) END) AS e FROM V)
            SELECT doc_id, page_no, i - 1 AS i, e[i] AS edge FROM (SELECT *, unnest(generate_series(1, len(e))) AS i FROM K)""",
        "line_gaps": l + f"SELECT doc_id, page_no, line_id, t - lag(b) {_W} AS gap, t - lag(t) {_W} AS step FROM L",
        "line_spacing": l + f""", D AS (SELECT doc_id, page_no, b - t AS h, t - lag(t) {_W} AS s, t - lag(b) {_W} AS g FROM L)
            SELECT doc_id, page_no, coalesce({_MED('s')}, 1.2 * {_MED('h')}) AS spacing, coalesce({_MED('g')}, 0.3 * {_MED('h')}) AS median_gap FROM D GROUP BY doc_id, page_no""",
        "space_before": b + "SELECT doc_id, page_no, block_no, coalesce(greatest(t - lag(b) OVER (PARTITION BY doc_id, page_no, section_no, column_no ORDER BY block_no), CASE WHEN lag(b) OVER (PARTITION BY doc_id, page_no, section_no, column_no ORDER BY block_no) IS NULL THEN NULL ELSE 0.0 END), 0.0) AS space_before FROM B",
        "renumber": l + f"SELECT doc_id, page_no, line_id, row_number() {_W} AS new_id FROM L",
        "cluster_mean": l + """, D AS (SELECT DISTINCT doc_id, page_no, l FROM L), F AS (SELECT *, CASE WHEN l - lag(l) OVER (PARTITION BY doc_id, page_no ORDER BY l) <= 8.0 THEN 0 ELSE 1 END AS o FROM D),
            G AS (SELECT *, sum(o) OVER (PARTITION BY doc_id, page_no ORDER BY l) AS grp FROM F) SELECT doc_id, page_no, grp, sum(l) / count(*) AS center, count(*) AS n FROM G GROUP BY doc_id, page_no, grp""",
        "gutters": l + """, D AS (SELECT *, max(r) OVER (PARTITION BY doc_id, page_no ORDER BY l, r, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM L)
            SELECT doc_id, page_no, reach AS gap_start, min(l) AS gap_end FROM D WHERE l > reach GROUP BY doc_id, page_no, reach""",
        "heading_levels": _with(_L, _B, _BL, _X) + """, Z AS (SELECT *, coalesce(CAST(size_pt AS DOUBLE), 11.0) AS size, length(coalesce(text, '')) AS n FROM BL WHERE kind NOT IN ('Table', 'Figure')),
            G AS (SELECT doc_id, page_no, round_even(size * 2, 0) AS half, sum(n) AS w, min(line_id) AS f FROM Z GROUP BY ALL), Y AS (SELECT doc_id, page_no, half / 2 AS body FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY w DESC, f) AS k FROM G) WHERE k = 1),
            F AS (SELECT doc_id, page_no, block_no, kind, count(*) AS rows, arg_max(size, n * 100000 - pos) AS size, coalesce(sum(CASE WHEN bold THEN n ELSE 0 END), 0) * 2 > sum(n) AS bold, string_agg(regexp_replace(coalesce(text, ''), '[\\s\\p{Z}]+$', ''), chr(10) ORDER BY pos, text) AS ended FROM Z GROUP BY ALL),
            T AS (SELECT F.*, """ + _flow("ended") + """ AS text, Y.body, coalesce(B.ordered_list, false) AS ordered FROM F JOIN B ON F.doc_id = B.doc_id AND F.page_no = B.page_no AND F.block_no = B.block_no JOIN Y ON F.doc_id = Y.doc_id AND F.page_no = Y.page_no),
            O AS (SELECT *, size >= body * 1.18 AS large, bold AND rows = 1 AND size >= body * 0.95 AND len(string_split(text, ' ')) <= 12 AND NOT regexp_replace(text, '[\\s\\p{Z}]+$', '') LIKE '%.' AS short FROM T WHERE kind IN ('Paragraph', 'Heading') OR (kind = 'ListItem' AND ordered AND rows = 1)),
            C AS (SELECT *, length(text) BETWEEN 1 AND 160 AND rows <= 3 AND (large OR short) AND (kind <> 'ListItem' OR large OR bold) AS cand, round_even(size, 0) AS r FROM O),
            N AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_no) AS n, count(*) FILTER (cand) OVER (PARTITION BY doc_id, page_no) AS k FROM C), K AS (SELECT * FROM N WHERE cand AND NOT (n > 4 AND k * 10 > n * 6)),
            A AS (SELECT doc_id, page_no, count(DISTINCT r) FILTER (r >= body * 1.18) AS above FROM K GROUP BY ALL), D AS (SELECT K.*, A.above, dense_rank() OVER (PARTITION BY K.doc_id, K.page_no ORDER BY r DESC) AS rank FROM K JOIN A ON K.doc_id = A.doc_id AND K.page_no = A.page_no)
            SELECT doc_id, page_no, block_no, least(3, CASE WHEN size < body * 1.18 THEN greatest(rank, least(3, above + 1)) ELSE rank END) AS level FROM D""",
        "bold_majority": bl + """, D AS (SELECT *, length(coalesce(text, '')) AS n FROM BL), R AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, block_no ORDER BY n DESC, pos) AS k FROM D)
            SELECT doc_id, page_no, block_no, sum(CASE WHEN bold THEN n ELSE 0 END) * 2 > sum(n) AS bold, CAST(max(size_pt) FILTER (k = 1) AS DOUBLE) AS size_pt FROM R GROUP BY doc_id, page_no, block_no""",
        "align_detect": _with(_L, _B, _BL) + """, V AS (SELECT doc_id, page_no, block_no, min(l) OVER w AS cl, max(r) OVER w AS cr FROM B WINDOW w AS (PARTITION BY doc_id, page_no, section_no, column_no)),
            E AS (SELECT BL.*, cl, cr, row_number() OVER (PARTITION BY BL.doc_id, BL.page_no, BL.block_no ORDER BY pos) AS i, count(*) OVER (PARTITION BY BL.doc_id, BL.page_no, BL.block_no) AS n FROM BL JOIN V ON BL.doc_id = V.doc_id AND BL.page_no = V.page_no AND BL.block_no = V.block_no WHERE kind NOT IN ('Table', 'Figure')),
            A AS (SELECT doc_id, page_no, block_no, kind, cl, cr, n, CASE WHEN n > 2 THEN max(l) FILTER (i > 1) - min(l) FILTER (i > 1) ELSE 0.0 END AS left_spread, CASE WHEN n > 2 THEN max(r) FILTER (i < n) - min(r) FILTER (i < n) ELSE 0.0 END AS right_spread,
              CASE WHEN n > 1 THEN max(l + (r - l) / 2) - min(l + (r - l) / 2) ELSE 0.0 END AS center_spread, avg(b - t) AS h, avg(r) FILTER (i < n) AS right_avg, max(l) FILTER (i = 1) - cl AS lm, cr - max(r) FILTER (i = 1) AS rm, greatest(1.0, cr - cl) AS w FROM E GROUP BY doc_id, page_no, block_no, kind, cl, cr, n)
            SELECT doc_id, page_no, block_no, left_spread, right_spread, center_spread, CASE WHEN kind = 'ListItem' THEN 'Left' WHEN n = 1 THEN CASE WHEN lm > w * 0.1 AND abs(lm - rm) < greatest(w * 0.06, h) THEN 'Center' WHEN lm > w * 0.3 AND rm < greatest(w * 0.03, h * 0.5) THEN 'Right' ELSE 'Left' END
            WHEN center_spread < h * 0.8 AND left_spread > h * 1.2 THEN 'Center' WHEN right_spread < h * 0.5 AND left_spread > h * 1.5 THEN 'Right' WHEN right_spread < h * 0.6 AND n >= 3 AND right_avg > cr - h * 1.5 THEN 'Justify' ELSE 'Left' END AS align FROM A""",
        "numbered_runs": b + """, K AS (SELECT *, kind || '/' || CAST(coalesce(ordered_list, false) AS VARCHAR) AS key FROM B),
            O AS (SELECT *, CASE WHEN key = lag(key) OVER (PARTITION BY doc_id, page_no ORDER BY block_no) THEN 0 ELSE 1 END AS o FROM K), R AS (SELECT *, sum(o) OVER (PARTITION BY doc_id, page_no ORDER BY block_no) AS run FROM O),
            N AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, run ORDER BY block_no) AS item_no FROM R) SELECT doc_id, page_no, block_no, run, item_no, coalesce(ordered_list, false) AS ordered FROM N WHERE kind = 'ListItem'""",
        "section_groups": b + """, S AS (SELECT doc_id, page_no, section_no, max(column_no) AS c FROM B GROUP BY ALL), O AS (SELECT *, CASE WHEN c = 0 AND lag(c) OVER (PARTITION BY doc_id, page_no ORDER BY section_no) = 0 THEN 0 ELSE 1 END AS o FROM S)
            SELECT doc_id, page_no, section_no, c + 1 AS columns, sum(o) OVER (PARTITION BY doc_id, page_no ORDER BY section_no) AS grp FROM O""",
        "table_line_assign": _with(_L, _B) + f"SELECT a.doc_id, a.page_no, a.line_id, min(x.block_no) AS block_no FROM L a JOIN B x ON {_ON} AND {_COVER} 5 WHERE x.kind = 'Table' GROUP BY ALL",
        "figure_lines": _with(_L, _B) + f"SELECT a.doc_id, a.page_no, a.line_id FROM L a WHERE EXISTS (SELECT 1 FROM B x WHERE x.kind = 'Figure' AND {_ON} AND {_COVER} 7)",
        "flow_items": _with(_L, _B) + f"""SELECT doc_id, page_no, 'line' AS item, line_id AS item_no, l, t, r, b FROM L a WHERE NOT EXISTS (SELECT 1 FROM B x WHERE x.kind = 'Table' AND {_ON} AND {_COVER} 5)
            AND NOT EXISTS (SELECT 1 FROM B x WHERE x.kind = 'Figure' AND {_ON} AND {_COVER} 7) UNION ALL SELECT doc_id, page_no, lower(kind), block_no, l, t, r, b FROM B WHERE kind IN ('Table', 'Figure')""",
        "nearest_table": _with(_L, _B) + f""", D AS (SELECT a.doc_id, a.page_no, a.line_id, x.block_no, greatest(x.l - (a.l + a.r) / 2, (a.l + a.r) / 2 - x.r, 0.0) + greatest(x.t - (a.t + a.b) / 2, (a.t + a.b) / 2 - x.b, 0.0) AS distance FROM L a JOIN B x ON {_ON} WHERE x.kind = 'Table')
            SELECT doc_id, page_no, line_id, block_no, distance FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, line_id ORDER BY distance, block_no) AS k FROM D) WHERE k = 1""",
        "grid_columns": _with(_L, _B) + f""", E AS (SELECT doc_id, page_no, e, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY e) AS i FROM (SELECT DISTINCT doc_id, page_no, l AS e FROM B)),
            J AS (SELECT a.doc_id, a.page_no, a.line_id, a.l, a.r, x.e, x.i FROM L a JOIN E x ON {_ON})
            SELECT doc_id, page_no, line_id, count(*) FILTER (e <= l + 4.0) AS asof_col, arg_min(i, abs(e - r) * 1000000 + i) AS near_col, count(*) FILTER (e <= (l + r) / 2) AS bucket FROM J GROUP BY doc_id, page_no, line_id""",
        "rule_intersections": b + """, R AS (SELECT doc_id, page_no, block_no * 4 + s AS rule, s < 2 AS h, CASE s WHEN 0 THEN t WHEN 1 THEN b WHEN 2 THEN l ELSE r END AS pos, CASE WHEN s < 2 THEN l ELSE t END AS a, CASE WHEN s < 2 THEN r ELSE b END AS z
            FROM B, (SELECT unnest([0, 1, 2, 3]) AS s) WHERE kind IN ('Table', 'Figure'))
            SELECT h.doc_id, h.page_no, h.rule AS h_rule, v.rule AS v_rule FROM R h JOIN R v ON h.doc_id = v.doc_id AND h.page_no = v.page_no AND h.h AND NOT v.h AND v.pos >= h.a - 6 AND v.pos <= h.z + 6 AND h.pos >= v.a - 6 AND h.pos <= v.z + 6""",
        "flow_text": x + "SELECT doc_id, page_no, block_no, flow AS text FROM X WHERE kind IN ('Paragraph', 'Heading', 'ListItem')",
        "page_plain_text": _with(_L, _B, _BL, _X, _PT) + "SELECT * FROM PT",
        "document_text_parts": _with(_L, _B, _BL, _X, _PT) + "SELECT doc_id, page_no, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY page_no) = 1 THEN chr(65279) ELSE chr(12) || chr(10) END || text AS part FROM PT",
        "copied_text": _with(_L, _B, _BL, _X, _PT) + "SELECT doc_id, page_no, text || chr(10) AS part FROM PT",
        "html_blocks": x + """, H0 AS (SELECT X.doc_id, X.page_no, X.block_no, X.kind, CAST(least(greatest(coalesce(B.heading_level, 1), 1), 3) AS VARCHAR) AS lv, replace(replace(replace(replace(replace(CASE WHEN X.kind = 'Table' THEN text ELSE flow END, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS s
            FROM X JOIN B ON X.doc_id = B.doc_id AND X.page_no = B.page_no AND X.block_no = B.block_no),
            H AS (SELECT *, array_to_string(list_transform(regexp_extract_all(s0, '(?s).'), lambda c: CASE WHEN unicode(c) BETWEEN 160 AND 255 OR unicode(c) > 65535 THEN '&#' || unicode(c) || ';' ELSE c END), '') AS s FROM (SELECT doc_id, page_no, block_no, kind, lv, s AS s0 FROM H0))
            SELECT doc_id, page_no, block_no, CASE kind WHEN 'Heading' THEN '<h' || lv || '>' || s || '</h' || lv || '>' WHEN 'ListItem' THEN '<li>' || s || '</li>' WHEN 'Table' THEN '<pre>' || s || '</pre>' ELSE '<p>' || replace(s, chr(10), '<br>') || '</p>' END AS html FROM H WHERE kind <> 'Figure'""",
        "layout_dump": _with(_L, _B, _BL, _X, _P) + """, H AS (SELECT doc_id, page_no, section_no, block_no, kind, '[' || kind || CASE WHEN kind = 'Heading' THEN coalesce(CAST(heading_level AS VARCHAR), '') ELSE '' END || ' c' || coalesce(CAST(column_no AS VARCHAR), '') || ' ' || coalesce(align, '') || ' @'
            || CAST(round_even(l, 0) AS BIGINT) || ',' || CAST(round_even(t, 0) AS BIGINT) || ' ' || CAST(round_even(r - l, 0) AS BIGINT) || 'x' || CAST(round_even(b - t, 0) AS BIGINT) || ']' AS head FROM B),
            S AS (SELECT doc_id, page_no, section_no, max(column_no) + 1 AS cols, min(t) AS t, max(b) AS b, count(*) AS n FROM B GROUP BY ALL), K AS (SELECT doc_id, page_no, CAST(sum(n) AS BIGINT) AS blocks, count(*) AS sections FROM S GROUP BY ALL)
            SELECT H.doc_id, H.page_no, H.section_no, H.block_no, CASE WHEN H.kind = 'Figure' OR X.text IS NULL THEN head WHEN H.kind = 'Table' THEN head || chr(10) || X.text ELSE head || ' ' || X.flow END AS line
            FROM H LEFT JOIN X ON H.doc_id = X.doc_id AND H.page_no = X.page_no AND H.block_no = X.block_no
            UNION ALL SELECT doc_id, page_no, section_no, -1, '--- section cols=' || cols || ' y=' || CAST(round_even(t, 0) AS BIGINT) || '-' || CAST(round_even(b, 0) AS BIGINT) FROM S
            UNION ALL SELECT P.doc_id, P.page_no, -1, -1, '=== ' || coalesce(page_label, '') || '  ' || coalesce(CAST(width AS VARCHAR), '') || 'x' || coalesce(CAST(height AS VARCHAR), '') || ' @' || CAST(round_even(coalesce(CAST(dpi AS DOUBLE), 96.0), 0) AS BIGINT) || 'dpi  blocks=' || coalesce(K.blocks, 0) || ' sections=' || coalesce(K.sections, 0)
            FROM P LEFT JOIN K ON P.doc_id = K.doc_id AND P.page_no = K.page_no""",
        "table_to_text": bl + """SELECT doc_id, page_no, block_no, regexp_replace(string_agg(array_to_string(list_concat(parts, list_transform(generate_series(1, n - len(parts)), lambda k: '')), chr(9)), chr(10) ORDER BY pos, text), '[\\s\\p{Z}]+$', '') AS text
            FROM (SELECT *, max(len(parts)) OVER (PARTITION BY doc_id, page_no, block_no) AS n FROM (SELECT *, string_split_regex(text, '\\t| {2,}') AS parts FROM BL WHERE kind = 'Table' AND text IS NOT NULL)) GROUP BY doc_id, page_no, block_no""",
        "parse_numbers": bl + f"""SELECT doc_id, page_no, line_id, cell, CASE WHEN ok THEN CASE WHEN pc THEN TRY_CAST(raw AS DOUBLE) / 100 ELSE TRY_CAST(raw AS DOUBLE) END END AS value,
            CASE WHEN NOT ok THEN NULL WHEN pc THEN CASE WHEN dec > 0 THEN 10 ELSE 9 END WHEN grp THEN CASE WHEN dec > 0 THEN 4 ELSE 3 END WHEN dec > 2 THEN 0 WHEN dec > 0 THEN 2 ELSE 1 END AS format_id
            FROM (SELECT *, regexp_matches(t, '{T.NUMBER_CELL}') AS ok, regexp_replace(t, '[,%]', '', 'g') AS raw, t LIKE '%\\%' ESCAPE '\\' AS pc, contains(t, ',') AS grp, length(regexp_extract(regexp_replace(t, '[,%]', '', 'g'), '\\.([0-9]+)$', 1)) AS dec
            FROM (SELECT doc_id, page_no, line_id, i - 1 AS cell, regexp_replace(parts[i], '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS t FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM (SELECT *, string_split_regex(text, '\\t| {{2,}}') AS parts FROM BL WHERE kind = 'Table' AND text IS NOT NULL))))""",
        "column_names": """WITH RECURSIVE N AS (SELECT CAST(p_partkey AS BIGINT) AS i, CAST(p_partkey AS BIGINT) AS n, '' AS name FROM part
            UNION ALL SELECT i, (n - 1) // 26, chr(CAST(65 + (n - 1) % 26 AS INT)) || name FROM N WHERE n > 0) SELECT i, name, i AS back, name || (i + 1) AS ref FROM N WHERE n = 0""",
        "natural_sort_rank": """SELECT doc_id, station, row_number() OVER (PARTITION BY station ORDER BY array_to_string(list_transform(regexp_extract_all(upper(doc_name), '([0-9]+|[^0-9]+)'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(CAST(length(ltrim(p, '0')) AS VARCHAR), 10, '0') || ltrim(p, '0') ELSE p END), chr(1)), doc_id) AS place
            FROM (SELECT doc_id, doc_name, coalesce(station, '') AS station FROM ocr_docs WHERE doc_name IS NOT NULL)""",
        "file_kinds": """SELECT doc_id, ext, CASE WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ('png', 'jpg', 'jpeg', 'jpe', 'bmp', 'dib', 'gif', 'tif', 'tiff', 'ico', 'emf', 'wmf') THEN 'image' WHEN ext IS NULL THEN 'rejected' ELSE 'rejected' END AS file_kind
            FROM (SELECT doc_id, lower(regexp_extract(doc_name, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM ocr_docs)""",
        "image_sequence_pages": _with(_P) + """, D AS (SELECT DISTINCT image_path AS path FROM P WHERE image_path IS NOT NULL), F AS (SELECT path, regexp_extract(path, '^(.*)[\\\\/][^\\\\/]*$', 1) AS folder, regexp_extract(path, '([^\\\\/]*)$', 1) AS name FROM D
            WHERE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) IN ('png', 'jpg', 'jpeg', 'jpe', 'bmp', 'dib', 'gif', 'tif', 'tiff', 'ico', 'emf', 'wmf'))
            SELECT folder, path, row_number() OVER (PARTITION BY folder ORDER BY array_to_string(list_transform(regexp_extract_all(upper(name), '([0-9]+|[^0-9]+)'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(CAST(length(ltrim(p, '0')) AS VARCHAR), 10, '0') || ltrim(p, '0') ELSE p END), chr(1)), path) AS page_no FROM F""",
        "effective_dpi": _with(_P) + """, K AS (SELECT DISTINCT doc_id, kind FROM ocr_docs) SELECT P.doc_id, page_no, round(CASE WHEN kind = 'Pdf' THEN coalesce(CAST(dpi AS DOUBLE), 200.0) WHEN CAST(dpi AS DOUBLE) BETWEEN 150 AND 1200 THEN CAST(dpi AS DOUBLE)
            WHEN greatest(width, height) >= 1600 AND crop IS NULL THEN least(600.0, greatest(96.0, CAST(greatest(width, height) AS DOUBLE) / 11.3)) WHEN dpi > 0 THEN CAST(dpi AS DOUBLE) ELSE 96.0 END, 6) AS dpi FROM P JOIN K ON P.doc_id = K.doc_id""",
        "page_units": _with(_B, _P) + """, U AS (SELECT B.doc_id, B.page_no, B.block_no, B.r - B.l AS w, coalesce(CAST(P.dpi AS DOUBLE), 96.0) AS dpi FROM B JOIN P ON P.doc_id = B.doc_id AND P.page_no = B.page_no)
            SELECT doc_id, page_no, block_no, round(w * 72 / dpi, 6) AS width_pt, CAST(round_even(w * 1440 / dpi, 0) AS BIGINT) AS width_twips, CAST(round_even(w * 914400 / dpi, 0) AS BIGINT) AS width_emu FROM U""",
        "line_colors": l + """SELECT '#' || lower(lpad(to_hex(c & 16777215), 6, '0')) AS css, ((c >> 16) & 255) + ((c >> 8) & 255) + (c & 255) AS from_black, count(*) AS n FROM (SELECT CAST(color AS BIGINT) AS c FROM L WHERE color IS NOT NULL) GROUP BY ALL""",
        "language_lookup": """WITH N AS (SELECT DISTINCT lang, lower(unnest([lang, ocr_language, display_name, culture])) AS label FROM language_models), O AS (SELECT DISTINCT doc_id, ocr_language FROM export_options)
            SELECT doc_id, O.ocr_language, coalesce(N.lang, 'en') AS lang, N.lang IS NULL AS fallback FROM O LEFT JOIN N ON lower(trim(O.ocr_language)) = N.label""",
        "missing_models": """SELECT DISTINCT path FROM (SELECT unnest([rec_model, dictionary, 'det\\det.onnx', 'cls\\cls.onnx']) AS path FROM language_models) WHERE path IS NOT NULL AND path NOT IN (SELECT p FROM (SELECT unnest([rec_model, dictionary]) AS p FROM language_models WHERE lang IN (SELECT lower(trim(ocr_language)) FROM history_entries WHERE ocr_language IS NOT NULL)) WHERE p IS NOT NULL)""",
        "unique_paths": """WITH H AS (SELECT entry_id, regexp_extract(output_path, '^(.*[\\\\/])?([^\\\\/]*)$', 1) || regexp_replace(regexp_extract(output_path, '^(.*[\\\\/])?([^\\\\/]*)$', 2), '[<>:"|?*\\x00-\\x1f]', '_', 'g') AS c FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY logged_at NULLS FIRST) AS k FROM history_entries WHERE output_path IS NOT NULL) WHERE k = 1),
            N AS (SELECT *, regexp_extract(c, '^(.*?)(\\.[A-Za-z0-9]+)?$', 1) AS stem, regexp_extract(c, '^(.*?)(\\.[A-Za-z0-9]+)?$', 2) AS ext, row_number() OVER (PARTITION BY c ORDER BY entry_id) AS n FROM H),
            T AS (SELECT regexp_extract(stem, '^(.*) \\(([0-9]{1,9})\\)$', 1) AS stem, ext, list_sort(list_distinct(list(CAST(regexp_extract(stem, '^(.*) \\(([0-9]{1,9})\\)$', 2) AS BIGINT)))) AS taken FROM N WHERE regexp_matches(stem, '^(.*) \\(([0-9]{1,9})\\)$') GROUP BY ALL)
            SELECT entry_id, CASE WHEN n = 1 THEN c ELSE N.stem || ' (' || list_reduce(list_prepend(n, coalesce(taken, [])), lambda k, t: CASE WHEN t >= 2 AND t <= k THEN k + 1 ELSE k END) || ')' || N.ext END AS unique_name FROM N LEFT JOIN T ON N.stem = T.stem AND N.ext = T.ext""",
        "history_top500": """SELECT entry_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY logged_at NULLS FIRST) AS k FROM history_entries WHERE happened_at IS NOT NULL) WHERE k = 1 ORDER BY happened_at DESC, entry_id DESC LIMIT 500""",
        "batch_totals": """SELECT coalesce(regexp_replace(lower(trim(out_format)), '^\\.', ''), '?') AS format, count(*) AS entries, CAST(sum(page_count) AS BIGINT) AS pages, CAST(sum(CASE WHEN round(elapsed_s * 100, 0) >= 0 THEN round(elapsed_s * 100, 0) END) AS BIGINT) AS hundredths, count(*) FILTER (round(elapsed_s * 100, 0) < 0) AS bad_times
            FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY logged_at NULLS FIRST) AS k FROM history_entries) WHERE k = 1 GROUP BY ALL""",
        "edit_overlay": l + """SELECT doc_id, page_no, line_id, CASE WHEN edited THEN coalesce('> ' || text, text) ELSE text END AS text, CASE WHEN edited AND text IS NOT NULL THEN 1000 ELSE CAST(round_even(CAST(confidence AS DOUBLE) * 1000, 0) AS BIGINT) END AS thousandths, edited FROM L""",
        "stale_results": _with(_P) + "SELECT DISTINCT d.doc_id, d.page_no, d.page_version FROM doc_pages d JOIN P ON P.doc_id = d.doc_id AND P.page_no = d.page_no AND P.page_version = d.page_version",
        "remove_pages": _with(_P) + "SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS new_page_no FROM P WHERE rotation IS NULL OR rotation <> 180",
        "pages_to_process": _with(_P) + "SELECT doc_id, page_no FROM P WHERE NOT EXISTS (SELECT 1 FROM text_lines t WHERE t.doc_id = P.doc_id AND t.page_no = P.page_no)",
        "text_layer_pages": l + "SELECT doc_id, page_no, CAST(sum(length(regexp_replace(coalesce(text, ''), '[\\x00-\\x20\\x{FFFD}\\x{FFFE}]', '', 'g'))) AS BIGINT) AS visible, sum(length(regexp_replace(coalesce(text, ''), '[\\x00-\\x20\\x{FFFD}\\x{FFFE}]', '', 'g'))) >= 16 AS enough FROM L GROUP BY doc_id, page_no",
        "ctc_decode": """WITH S AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events WHERE event_type IS NOT NULL)
            SELECT user_id, string_agg(substr(event_type, 1, 1), '' ORDER BY event_id) AS text, count(*) AS runs FROM S WHERE (p IS NULL OR p <> event_type) AND event_type <> 'error' GROUP BY user_id""",
    }
