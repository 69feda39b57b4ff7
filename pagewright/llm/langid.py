"""Problem 4: the language of each file and of each Paragraph block.

Character n-grams of each language are kept in one bit-sliced Bloom filter: a row of it has one bit for
each language of the table of languages, and the rows of an n-gram, ANDed, are the set of all languages
that have it. A text's n-grams give a count for each language; what the fill of its slice lets through by
chance is taken off, and the largest share decides. The filter has a fixed size, whatever it is fitted on.
A block in several languages is cut into segments of lines by the cheapest sequence of languages.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .linekinds import is_contact, is_junk, is_page_number

# --- fixed values -------------------------------------------------------------------------------
THREE_LETTERS = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "rus": "ru", "zho": "zh", "chi": "zh", "jpn": "ja", "kor": "ko"}
# ------------------------------------------------------------------------------------------------
#: Labelled documents that the filter is fitted on, at most (chosen by a hash of their id).
FIT_ROWS = 4000
#: Languages that a row has room for.
MOST_LANGS = 64
#: Rows of the filter (eight bytes each), and rows an n-gram takes.
ROWS, HASHES = 1 << 18, 3
#: An n-gram belongs to a language with this share of the n-grams of its text, and of the share in the language that has it most.
LEAST_SHARE, LEAST_OF_BEST = 2e-5, 0.15
#: Lead over the file's language that a block of another one must have, as a share of its n-grams and as a number of them.
BLOCK_LEAD, BLOCK_EVIDENCE = 0.2, 3.0
#: What a change of language between two lines of a block costs, in n-grams.
CHANGE = 6.0

_WORDS = re.compile("[^\\W\\d_]+")
_WIDE = re.compile("[぀-ヿ㐀-䶿一-鿿]")
_SENTENCE = re.compile("[.!?…。！？][”“»\"'’」）)]*\\s*$|[、，。]")
_ADDRESS = re.compile("[!-~]*(?:@|\\[at\\]|\\.(?:png|pdf|tif|docx|jpg)\\b)[!-~]*")


def grams(word: str) -> list[str]:
    """n-grams of a word in lower case: letters and pairs of spaceless scripts, else three letters with the word's ends."""
    if _WIDE.search(word):
        return [*word, *(word[i : i + 2] for i in range(len(word) - 1))]
    w = f" {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


def _rows_of(gram: str) -> list[int]:
    h = xxhash.xxh64_intdigest(gram)
    return [(h >> (20 * i)) % ROWS for i in range(HASHES)]


def fit(texts: Iterator[tuple[str, str]], langs: tuple[str, ...]) -> bytes:
    """The filter's rows from (text, language) pairs; a few wrong labels don't matter."""
    counts = {lang: Counter() for lang in langs}
    for text, lang in texts:
        words = Counter(_WORDS.findall(_ADDRESS.sub(" ", text).lower()))
        own = counts[lang]
        for w, n in words.items():
            for g in grams(w):
                own[g] += n
    sums = {lang: max(1, sum(c.values())) for lang, c in counts.items()}
    best: dict[str, float] = {}
    for lang, c in counts.items():
        for g, n in c.items():
            best[g] = max(best.get(g, 0.0), n / sums[lang])
    rows = np.zeros(ROWS, dtype=np.uint64)
    for bit, lang in enumerate(langs):
        for g, n in counts[lang].items():
            share = n / sums[lang]
            if n >= 2 and share >= LEAST_SHARE and share >= LEAST_OF_BEST * best[g]:
                rows[_rows_of(g)] |= np.uint64(1 << bit)
    return rows.tobytes()


def languages_of(models: DataFrame) -> tuple[str, ...]:
    """Codes of the languages that are told apart, in order; more than a row has room for are refused."""
    return tuple(r[0] for r in sorted(common.small_set(models.where("lang is not null").select("lang").distinct(), MOST_LANGS)))


def fit_filter(documents: DataFrame, langs: tuple[str, ...]) -> bytes:
    """The filter fitted on at most about FIT_ROWS documents with one of the labels, in one task."""
    labelled = documents.where(F.col("lang").isin(*langs) & (F.length("text") > 0)).select("text", "lang", F.xxhash64("doc_id").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((t, lang) for b in batches for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([fit(pairs, langs)], type=pa.binary())], names=["rows"])

    share = max(1, -(-documents.count() // FIT_ROWS))  # one of so many rows, by hash; counted from the files' footers
    found = labelled.where(F.pmod("h", F.lit(share)) == 0).select("text", "lang").repartition(1).mapInArrow(run, "rows binary").collect()
    return bytes(found[0][0]) if found else bytes(8 * ROWS)


class Judge:
    """Counts of n-grams for each language, packed into one integer for each word."""

    def __init__(self, rows: bytes, langs: tuple[str, ...]):
        self.rows, self.langs = array("Q", rows), langs
        slices = np.frombuffer(rows, dtype=np.uint64)
        fill = [float((slices >> np.uint64(bit) & np.uint64(1)).mean()) for bit in range(len(langs))]
        self.chance = [min(0.9, f**HASHES) for f in fill]
        self.words: dict[str, int] = {}

    def packed(self, word: str) -> int:
        rows, total = self.rows, 0
        own = grams(word)
        for g in own:
            a, b, c = _rows_of(g)
            mask = rows[a] & rows[b] & rows[c]
            bit = 0
            while mask:
                if mask & 1:
                    total += 1 << (24 * bit)
                mask >>= 1
                bit += 1
        return total + (len(own) << (24 * len(self.langs)))

    def counts(self, text: str) -> tuple[int, list[float]]:
        """n-grams of the text, and those of each language, corrected for false positives."""
        known, total = self.words, 0
        for w in _WORDS.findall(text.lower()):
            p = known.get(w)
            if p is None:
                if len(known) > 500_000:
                    known.clear()
                p = known[w] = self.packed(w)
            total += p
        n = total >> (24 * len(self.langs))
        return n, [max(0.0, ((total >> (24 * i) & 0xFFFFFF) - c * n) / (1 - c)) for i, c in enumerate(self.chance)]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("page_no", pa.int32()), ("block_no", pa.int32()), ("paragraph", pa.bool_()), ("lang", pa.string()), ("letters", pa.int64()), ("grams", pa.int32()), ("scores", pa.list_(pa.float32()))])
_DDL = "doc_id bigint, page_no int, block_no int, paragraph boolean, lang string, letters bigint, grams int, scores array<float>"


def _clean(text: str) -> str:
    return _ADDRESS.sub(" ", text) if "@" in text or "." in text or "[" in text else text


def _page(sent, langs: tuple[str, ...]):
    """Rows of a page; sent: a broadcast of the filter's rows."""
    state: list[Judge] = []

    def page(doc: int, page_no: int, lines: dict[int, str], blocks: list) -> Iterator[tuple]:
        if not state:
            state.append(Judge(sent.value, langs))
        for no, kind, ids in blocks:
            own = [lines[i] for i in dict.fromkeys(ids) if i in lines]
            if len(own) == 1:
                if is_page_number(own[0]) or is_junk(own[0]):
                    continue
                contact = is_contact(own[0]) or not _SENTENCE.search(own[0])  # names, titles, addresses: no language of their own
            else:
                own, contact = [t for t in own if not is_junk(t)], False
            text = "\n".join(own)
            text = re.sub("(?<=[^\\W\\d_])[-‐¬\xad]\n(?=[^\\W\\d_])", "", text)
            if _WIDE.search(text):
                text = text.replace("\n", "")
            n, scores = state[0].counts(_clean(text))
            if n == 0 or max(scores) <= 0:
                continue
            top = max(range(len(langs)), key=lambda i: (scores[i], -i))
            yield doc, page_no, no, kind == "Paragraph" and not contact, langs[top], n, n, [s / n for s in scores]

    return page


def segments(counts: list[tuple[int, list[float]]], langs: int) -> list[tuple[int, int, int]]:
    """(first line, last line, language) of the cheapest sequence: a line costs the n-grams that its language doesn't have, a change CHANGE. Lines without n-grams go with their neighbours."""
    best = [(0.0, [k]) for k in range(langs)]
    for at, (n, scores) in enumerate(counts):
        own = [n - min(float(n), s) for s in scores]
        if at == 0:
            best = [(own[k], [k]) for k in range(langs)]
            continue
        low = min(range(langs), key=lambda k: best[k][0])
        best = [(best[k][0] + own[k], [*best[k][1], k]) if best[k][0] <= best[low][0] + CHANGE else (best[low][0] + CHANGE + own[k], [*best[low][1], k]) for k in range(langs)]
    path = min(best, key=lambda x: x[0])[1] if counts else []
    out: list[tuple[int, int, int]] = []
    for i, k in enumerate(path):
        if out and out[-1][2] == k:
            out[-1] = (out[-1][0], i, k)
        else:
            out.append((i, i, k))
    return out


_SEGMENTS = pa.schema([("doc_id", pa.int64()), ("page_no", pa.int32()), ("block_no", pa.int32()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])


def _segment_page(sent, langs: tuple[str, ...]):
    state: list[Judge] = []

    def page(doc: int, page_no: int, lines: dict[int, str], blocks: list) -> Iterator[tuple]:
        if not state:
            state.append(Judge(sent.value, langs))
        for no, kind, ids in blocks:
            own = [(i, lines[i]) for i in dict.fromkeys(ids) if i in lines and not is_junk(lines[i])]
            if kind != "Paragraph" or not own or len(own) == 1 and is_page_number(own[0][1]):
                continue
            counts = [state[0].counts(_clean(t)) for _, t in own]
            for a, b, k in segments(counts, len(langs)):
                n = sum(x[0] for x in counts[a : b + 1])
                if n:
                    shares = sorted(((sum(x[1][j] for x in counts[a : b + 1]), j) for j in range(len(langs))), reverse=True)
                    mine = next(s for s, j in shares if j == k)
                    rest = next((s for s, j in shares if j != k), 0.0)
                    yield doc, page_no, no, own[a][0], own[b][0], langs[k], round(mine / (mine + rest), 4) if mine + rest > 0 else 0.0

    return page


def language_segments(lines: DataFrame, blocks: DataFrame, models: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, page_no, block_no, first_line, last_line, lang, confidence): each Paragraph block as segments of one language, at lines; the confidence is the share that the language has over the next one. Lines without letters belong to their neighbours; a block without any has no row."""
    langs = languages_of(models)
    sent = lines.sparkSession.sparkContext.broadcast(fit_filter(documents, langs))
    rows = common.page_rows(lines, blocks, "kind = 'Paragraph'")
    return rows.mapInArrow(common.page_kernel(_segment_page(sent, langs), _SEGMENTS), "doc_id bigint, page_no int, block_no int, first_line int, last_line int, lang string, confidence double")


def block_languages(lines: DataFrame, blocks: DataFrame, models: DataFrame, documents: DataFrame) -> DataFrame:
    langs = languages_of(models)
    sent = lines.sparkSession.sparkContext.broadcast(fit_filter(documents, langs))
    rows = common.page_rows(lines, blocks)
    return rows.mapInArrow(common.page_kernel(_page(sent, langs), _SCHEMA), _DDL)


def _main(found: DataFrame) -> DataFrame:
    """The language of most of each file's text, and its share of it."""
    sums = found.groupBy("doc_id", "lang").agg(F.sum("letters").alias("n"))
    return sums.groupBy("doc_id").agg(F.max_by("lang", F.struct("n", "lang")).alias("main"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


def _labels(models: DataFrame) -> DataFrame:
    names = models.where("lang is not null").select("lang", F.explode(F.array("lang", "ocr_language", "display_name", "culture")).alias("label"))
    three = models.sparkSession.createDataFrame(sorted(THREE_LETTERS.items()), "label string, lang string").select("lang", "label")
    return names.unionByName(three).where("label is not null").select("lang", F.lower(F.trim("label")).alias("label")).distinct()


def _spelling(label):
    return F.lower(F.replace(F.trim(label), F.lit("_"), F.lit("-")))


def judged_blocks(found: DataFrame, main: DataFrame, langs: tuple[str, ...]) -> DataFrame:
    lead = F.array_max("scores") - F.element_at("scores", F.array_position(F.array(*map(F.lit, langs)), F.col("main")).cast("int"))
    return found.join(main, "doc_id").withColumn("lead", lead)


def find_languages(lines: DataFrame, blocks: DataFrame, options: DataFrame, models: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, page_no, block_no, lang): files without or with a wrong label (0, 0), and Paragraph blocks in another language than their file.

    A file without any text of a known language isn't returned. Repeated rows count once; labels are compared
    trimmed and in lower case.
    """
    found = common.staged(block_languages(lines, blocks, models, documents), "languages")
    main = _main(found)
    labels = options.where("doc_id is not null").select("doc_id", _spelling(F.col("ocr_language")).alias("label")).distinct()
    named = labels.join(_labels(models), "label", "left")
    files = named.join(main, "doc_id").where("lang is null or lang != main").select("doc_id", F.lit(0).alias("page_no"), F.lit(0).alias("block_no"), F.col("main").alias("lang"))
    other = judged_blocks(found.where("paragraph"), main, languages_of(models)).where((F.col("lang") != F.col("main")) & (F.col("lead") >= BLOCK_LEAD) & (F.col("lead") * F.col("grams") >= BLOCK_EVIDENCE))
    return files.unionByName(other.select("doc_id", "page_no", "block_no", "lang")).distinct()


def languages(lines: DataFrame, blocks: DataFrame, models: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, page_no, block_no, lang, confidence): each file (0, 0) with the share of its main language, and each Paragraph block with the share of its n-grams that its language has over the next one."""
    found = common.staged(block_languages(lines, blocks, models, documents), "languages")
    main = _main(found)
    s = F.sort_array("scores", asc=False)
    own = found.where("paragraph").select("doc_id", "page_no", "block_no", "lang", F.round(F.try_divide(s[0].cast("double"), (s[0] + s[1]).cast("double")), 4).alias("confidence"))
    return own.unionByName(main.select("doc_id", F.lit(0).alias("page_no"), F.lit(0).alias("block_no"), F.col("main").alias("lang"), F.round("share", 4).alias("confidence")))
