"""Problem 6: text statistics of each file, and what kind of text it is.

A file is split into its pages; every page gives partial counts that add up, and the state of its two
ends (a word divided over the page end is one word, not two). They are summed in a tree of two levels:
first by page end, where the states of the two pages beside it meet and correct the counts, and by salted
parts of the file, then by file. So a file of any number of pages never meets in one task. Ratios come
then, rules over ratios next, and the class last.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .linekinds import is_contact, is_junk, is_list_item, is_page_number, is_table_row

_WORD = re.compile("[^\\W_]+(?:[-'’][^\\W_]+)*")
_CJK = re.compile("[぀-ヿ㐀-䶿一-鿿]")
_END = re.compile("[.!?…。！？][”“»\"'’)」』）]*\\s*$")
_DIVIDED = re.compile("[^\\W\\d_][-‐¬\xad]\\s*$")
COUNTS = ("lines", "prose_lines", "list_lines", "table_lines", "junk_lines", "words", "word_chars", "chars", "symbols", "ended_lines", "common_words", "conf_sum", "conf_n")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), *[(c, pa.float64() if c == "conf_sum" else pa.int64()) for c in COUNTS], ("open_end", pa.bool_()), ("mid_start", pa.bool_())])
_DDL = "doc_id bigint, part int, " + ", ".join(f"{c} {'double' if c == 'conf_sum' else 'bigint'}" for c in COUNTS) + ", open_end boolean, mid_start boolean"
#: Parts of a file on the first level of the tree.
PARTS = 64
#: Ratios (numerator, denominator) and the rules over them.
RATIOS = {
    "mean_word_length": ("word_chars", "words"), "symbol_ratio": ("symbols", "chars"), "ended_share": ("ended_lines", "lines"), "common_share": ("common_words", "words"), "mean_confidence": ("conf_sum", "conf_n"),
    "prose_share": ("prose_lines", "lines"), "list_share": ("list_lines", "lines"), "table_share": ("table_lines", "lines"), "junk_share": ("junk_lines", "lines"),
}
#: Rule: ratio from which (True) or below which (False) it holds, and what it is worth for each class, as a share of lines.
RULES = {
    "symbols_many": ("symbol_ratio", 0.17, True, {"junk": 0.3}),
    "sentences_end": ("ended_share", 0.1, True, {"prose": 0.1}),
    "words_common": ("common_share", 0.12, True, {"prose": 0.05, "table": -0.05}),
    "words_rare": ("common_share", 0.03, False, {"table": 0.03, "list": 0.03}),
    "words_short": ("mean_word_length", 4.0, False, {"table": 0.02}),
}


def line_class(text: str, kind: str, alone: bool) -> str:
    """prose, list, table, junk, or other (headings, contact lines, page numbers)."""
    if is_page_number(text):
        return "other"
    if is_junk(text):
        return "junk"
    if not alone and kind == "Paragraph":
        return "prose"
    if is_table_row(text) or kind == "Table":
        return "table"
    if kind == "Heading":
        return "other"
    if is_list_item(text) or kind == "ListItem":
        return "list"
    if is_contact(text):
        return "other"
    if _END.search(text) and len(text) > 25 or len(text) > 45:
        return "prose"
    return "other" if kind == "Figure" or text.isupper() else "list"


def _kernel(frequent: frozenset[str]):
    chars = frozenset(w for w in frequent if len(w) == 1 and _CJK.match(w))

    def page(doc: int, page_no: int, lines: dict, blocks: list) -> Iterator[tuple]:
        n = dict.fromkeys(COUNTS, 0)
        first = last = ""
        for _, kind, ids in blocks:
            own = [lines[i] for i in dict.fromkeys(ids) if i in lines and lines[i][0].strip()]
            before = ""
            for text, conf in own:
                n["lines"] += 1
                cls = line_class(text, kind, len(own) == 1)
                if cls != "other":
                    n[f"{cls}_lines"] += 1
                if conf is not None and conf == conf:
                    n["conf_sum"] += conf / 100 if conf > 1 else conf
                    n["conf_n"] += 1
                words = _WORD.findall(text)
                n["chars"] += len(text)
                n["symbols"] += len(text) - sum(map(len, words)) - sum(map(str.isspace, text))
                if cls == "junk":
                    continue
                for w in words:
                    cjk = len(_CJK.findall(w)) if not w.isascii() else 0
                    if cjk * 2 > len(w):  # spaceless scripts: a letter counts as a word
                        n["words"] += len(w)
                        n["common_words"] += sum(c in chars for c in w)
                    else:
                        n["words"] += 1
                        n["common_words"] += w.lower() in frequent
                    n["word_chars"] += len(w)
                if before and _DIVIDED.search(before) and words:
                    n["words"] -= 1
                n["ended_lines"] += _END.search(text) is not None
                before = text
                if cls == "prose":
                    first = first or text
                    last = text
        none = (0,) * len(COUNTS)
        yield doc, -1 - page_no % PARTS, *n.values(), False, False
        if _DIVIDED.search(last):
            yield doc, page_no + 1, *none, True, False
        if first[:1].islower():
            yield doc, page_no, *none, False, True

    return page


def page_counts(lines: DataFrame, blocks: DataFrame, frequent: DataFrame) -> DataFrame:
    """Partial counts of each page under a part of its file (negative), and the states of its ends under the number of the page behind the end."""
    words = frozenset(r[0] for r in common.small_set(frequent.where("word is not null").select("word").distinct(), 100_000))
    rows = common.page_rows(lines, blocks, extra="confidence")
    return rows.mapInArrow(common.page_kernel(_kernel(words), _SCHEMA), _DDL)


def totals(partial: DataFrame) -> DataFrame:
    """The tree: by part or page end, with the correction of words divided there, then by file."""
    one = partial.groupBy("doc_id", "part").agg(*[F.sum(c).alias(c) for c in COUNTS], (F.bool_or("open_end") & F.bool_or("mid_start")).cast("bigint").alias("divided"))
    return one.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in COUNTS], F.sum("divided").alias("divided")).withColumn("words", F.col("words") - F.col("divided"))


def classed(total: DataFrame) -> DataFrame:
    """Ratios, rule outcomes and class: the largest share of lines with what the rules add; of equals prose, then junk, table, list."""
    ratio = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 6)
    df = total.select("*", *[ratio(a, b).alias(name) for name, (a, b) in RATIOS.items()])
    df = df.select("*", *[F.coalesce(F.col(r) >= limit if above else F.col(r) < limit, F.lit(False)).alias(name) for name, (r, limit, above, _) in RULES.items()])
    scores = {}
    for cls in ("prose", "junk", "table", "list"):
        score = F.coalesce(F.col(f"{cls}_share"), F.lit(0.0))
        for name, (_, _, _, worth) in RULES.items():
            if cls in worth:
                score = score + F.when(F.col(name) & (F.col(f"{cls}_lines") > 0), worth[cls]).otherwise(0.0)
        scores[cls] = F.round(score, 6)
    most = F.greatest(*scores.values())
    cls = F.when(F.col("prose_lines") + F.col("junk_lines") + F.col("table_lines") + F.col("list_lines") == 0, None)
    for name, score in scores.items():
        cls = cls.when(score == most, name)
    return df.withColumn("text_class", cls)


def text_statistics(docs: DataFrame, lines: DataFrame, blocks: DataFrame, frequent: DataFrame) -> DataFrame:
    """One row per file of docs: counts, ratios, rule outcomes and class. A file without lines has zero counts and null ratios and class.

    Confidences on a 0-100 scale count as hundredths; null and NaN ones are left out of the mean.
    """
    df = docs.where("doc_id is not null").select("doc_id").distinct().join(totals(page_counts(lines, blocks, frequent)), "doc_id", "left").fillna(0, [*COUNTS, "divided"])
    return classed(df).select(
        "doc_id", "lines", "words", "mean_word_length", "symbol_ratio", "ended_share", "common_share", "mean_confidence",
        "prose_lines", "list_lines", "table_lines", "junk_lines", *RULES, "text_class",
    )


def find_not_prose(docs: DataFrame, lines: DataFrame, blocks: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc_id, text_class) of the files of docs whose statistics say list, table or junk.

    A file without lines in blocks has no class and isn't returned; repeated rows count once.
    """
    return text_statistics(docs, lines, blocks, frequent).where("text_class in ('list', 'table', 'junk')").select("doc_id", "text_class")
