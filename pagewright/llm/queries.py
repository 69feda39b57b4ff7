"""Queries of the subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import encode, langid, leakage, lookalike, pii, quality, scan_noise, sentences, shared_spans
from .common import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.find_sentence_ends(table(spark, d, "text_lines"), table(spark, d, "layout_blocks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_pii(table(spark, d, "text_lines"), table(spark, d, "layout_blocks"), table(spark, d, "person_names"))


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "text_lines"), table(spark, d, "layout_blocks"), table(spark, d, "person_names"))


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = pii.candidates(table(spark, d, "text_lines"), table(spark, d, "layout_blocks"), table(spark, d, "person_names"))
    return pii.term_disclosure(rows)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.find_noise(table(spark, d, "text_lines"), table(spark, d, "layout_blocks"))


def p3_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.find_paragraphs(table(spark, d, "text_lines"), table(spark, d, "layout_blocks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.find_languages(*(table(spark, d, n) for n in ("text_lines", "layout_blocks", "export_options", "language_models", "documents")))


def p4_languages(spark: SparkSession, d: str) -> DataFrame:
    return langid.languages(*(table(spark, d, n) for n in ("text_lines", "layout_blocks", "language_models", "documents")))


def p4_segments(spark: SparkSession, d: str) -> DataFrame:
    return langid.language_segments(*(table(spark, d, n) for n in ("text_lines", "layout_blocks", "language_models", "documents")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.find_lookalikes(table(spark, d, "text_lines"))


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.unify_lines(table(spark, d, "text_lines"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.find_not_prose(*(table(spark, d, n) for n in ("ocr_docs", "text_lines", "layout_blocks", "common_words")))


def p6_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_statistics(*(table(spark, d, n) for n in ("ocr_docs", "text_lines", "layout_blocks", "common_words")))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_matches(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_matches(table(spark, d, "documents"), table(spark, d, "eval_items"), spread=None).drop("kind")


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_matches(table(spark, d, "documents"), table(spark, d, "eval_items")).where("kind = 'near'").drop("kind")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.find_pairs(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.link_classes(table(spark, d, "documents"))


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.find_spans(table(spark, d, "documents"))


def p9_shared_share(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_share(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name[0] == "p" and name[1:2].isdigit()}
