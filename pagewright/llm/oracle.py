"""SQL for the queries of the subpackage that SQL can express; the others are tested by brute force."""

from __future__ import annotations

from . import queries  # noqa: F401  (without them there is nothing to check)


def _words(key: str, column: str, source: str) -> str:
    return f"SELECT {key}, regexp_extract_all(replace(lower({column}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+') AS w FROM {source}"


def _stretches(key: str, column: str, source: str) -> str:
    """All stretches of twelve words of a column."""
    return f"SELECT {key}, i, array_to_string(list_slice(w, i, i + 11), ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(w) - 11)) AS i FROM ({_words(key, column, source)}) WHERE len(w) >= 12)"


_TWELVE = f"D AS ({_stretches('doc_id', 'text', 'documents')}), I AS ({_stretches('item_id', 'passage', 'eval_items')})"
#: Stretches of 200 characters that two texts have, and the stretches of each text that they make.
_WINDOWS = "W AS (SELECT DISTINCT doc_id, i, hash(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 199)) AS i FROM documents WHERE length(text) >= 200))"
_SPANS = f"""{_WINDOWS}, S AS (SELECT doc_id, i FROM W WHERE h IN (SELECT h FROM W GROUP BY h HAVING min(doc_id) <> max(doc_id))), O AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS o FROM S),
    G AS (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM O), P AS (SELECT doc_id, min(i) - 1 AS start, max(i) - min(i) + 200 AS length FROM G GROUP BY doc_id, g)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p8_found": f"WITH {_TWELVE} SELECT DISTINCT doc_id, item_id FROM D JOIN I ON D.g = I.g",
        "p8_matches": f"""WITH {_TWELVE}, H AS (SELECT DISTINCT doc_id, item_id, I.i AS a, D.i AS b FROM D JOIN I ON D.g = I.g), O AS (SELECT *, CASE WHEN a - lag(a) OVER (PARTITION BY doc_id, item_id, b - a ORDER BY a) = 1 THEN 0 ELSE 1 END AS o FROM H),
            R AS (SELECT *, sum(o) OVER (PARTITION BY doc_id, item_id, b - a ORDER BY a) AS g FROM O) SELECT doc_id, item_id, min(a) - 1 AS item_word, min(b) - 1 AS doc_word, count(*) + 11 AS words FROM R GROUP BY doc_id, item_id, b - a, g""",
        "p9_found": f"WITH {_WINDOWS}, V AS (SELECT DISTINCT doc_id, h FROM W) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM V a JOIN V b ON a.h = b.h AND a.doc_id < b.doc_id",
        "p9_classes": f"""WITH {_WINDOWS}, C AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS class_id FROM documents), V AS (SELECT DISTINCT class_id, h FROM W JOIN C ON W.doc_id = C.doc_id),
            L AS (SELECT a.class_id, count(DISTINCT b.class_id) AS links FROM V a JOIN V b ON a.h = b.h AND a.class_id <> b.class_id GROUP BY a.class_id) SELECT C.doc_id, C.class_id, coalesce(L.links, 0) AS links FROM C LEFT JOIN L ON C.class_id = L.class_id""",
        "p9_spans": f"WITH {_SPANS} SELECT doc_id, start, length FROM P",
        "p9_shared_share": f"""WITH {_SPANS}, T AS (SELECT doc_id, sum(length) AS n FROM P GROUP BY doc_id) SELECT d.doc_id, coalesce(length(text), 0) AS n_chars, CAST(coalesce(T.n, 0) AS BIGINT) AS shared_chars, CASE WHEN coalesce(length(text), 0) > 0 THEN coalesce(T.n, 0) / length(text) ELSE 0.0 END AS share
            FROM documents d LEFT JOIN T ON d.doc_id = T.doc_id""",
    }
