"""Problem 2: personal information in lines of text, and its replacement by typed placeholders.

Candidates are found in the text of a block, so that one broken over lines is seen whole. Shapes that
only personal items have (an address with @, an identity number with letters, a name from the table beside
another or an initial) are protected entities of their own, which no count overrides. A number whose shape
orders and files share is judged by information: over the whole corpus, the terms before numbers are counted
together with protected and with innocent ones. A term's disclosure is how many bits it adds to the share of
protected numbers; an ambiguous number behind a term that discloses is generalised to its type. The longest
term that was seen decides, a shorter one where it wasn't, and without any the share of the type.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .linekinds import is_junk
from .lookalike import _PLAIN_CASES, foreign_tokens

# --- fixed values -------------------------------------------------------------------------------
FILE_ENDS = frozenset("png jpg jpeg tif tiff pdf gif bmp docx doc xlsx txt html htm zip".split())
TITLES = ("Dr.", "Prof.", "DR.", "PROF.", "Dra.", "Pr.", "д-р", "проф.", "Проф.", "Д-р")
STREETS_EN = "Street|St\\.?|Road|Rd\\.?|Lane|Ln\\.?|Row|Avenue|Ave\\.?|Close|Way|Walk|Yard|Hill|Court|Ct\\.?|Mews|Drive|Dr\\.|Place|Pl\\.|Square|Sq\\.|Terrace|Gardens|Crescent|Boulevard|Blvd\\.?"
STREETS_DE = "weg|str\\.|straße|strasse|gasse|platz|allee|ufer|damm|ring|hof|steig"
STREETS_FR = "rue|avenue|av\\.|place|quai|allée|chemin|impasse|boulevard|bd|cours|route|passage|square"
STREETS_ES = "Calle|C/|Plaza|Pza\\.|Avda\\.?|Avenida|Paseo|Ronda|Camino|Travesía|Carretera"
STREETS_RU = "ул\\.|улица|пер\\.|переулок|пл\\.|площадь|просп\\.|пр-т|пр\\.|наб\\.|бул\\.|ш\\.|шоссе"
# ------------------------------------------------------------------------------------------------
_B = "(?<![A-Za-z0-9.\\-/_])"
_E = "(?![A-Za-z0-9_]|[-/.]\\d)"
EMAIL = re.compile(
    "(?<![A-Za-z0-9._+-])[A-Za-z0-9][A-Za-z0-9._+-]*(?:\\s?@\\s?|\\s?[\\[({]\\s?(?:at|AT|ät|arroba|собака)\\s?[\\])}]\\s?)"
    "[A-Za-z0-9][A-Za-z0-9-]*(?:(?:\\.|\\s?[\\[({]\\s?(?:\\.|dot|DOT|punkt|point|punto)\\s?[\\])}]\\s?|\\s(?:dot|DOT|punkt|point|punto)\\s)[A-Za-z0-9][A-Za-z0-9-]*)+"
)
PHONE = re.compile(
    "(?<![\\w+/.-])(?:\\+\\d{1,3}(?:[ .\\-/]?\\(?\\d{1,8}\\)?){2,7}(?<=\\d)|\\(\\d{2,5}\\)[ ]?\\d{3,6}[- ]\\d{2,5}|\\d{3}-\\d{4}\\s(?:ext|x|доб)\\.?\\s?\\d{1,5}|0\\d{2,4} ?/ ?\\d{2}(?: ?\\d{2,3}){1,2}-\\d{2}"
    "|0\\d(?:[. ]\\d{2}){4}|8 \\(?\\d{3}\\)? \\d{3}[ -]\\d{2}[ -]\\d{2}|555-\\d{4}|0\\d{1,2}-\\d{8}|0\\d{1,2}-\\d{4}-\\d{4}|0\\d{1,2}\\(\\d{3,4}\\)\\d{4}"
    "|(?<=电话)[\\d()+ -]{9,}\\d|(?<=電話は)[\\d()+ -]{9,}\\d)(?![\\w]|[-/.]\\d)",
    re.ASCII,
)
#: Numbers of protected (p), ambiguous (a: identity numbers, q: telephone numbers) and innocent (i) shape.
NUMBERS = re.compile(
    f"{_B}(?=[A-Z\\d])(?:(?P<p>\\d{{11}}|[A-Z]{{2}} ?\\d{{2}} ?\\d{{2}} ?\\d{{2}} ?[A-Z]|[A-Z]{{2}}\\d{{7}}|\\d{{3}}\\.\\d{{3}}\\.\\d{{3}}/[\\dA-Z])|(?P<a>\\d{{2}}-\\d{{5}}-\\d)|(?P<q>\\d{{3}}-\\d{{4}})"
    f"|(?P<i>\\d{{8}}|\\d{{4}} \\d{{5}}|\\d{{2}}-\\d{{6}}-\\d|\\d{{5}}/\\d{{2}}|[A-Z]\\d{{3}}-\\d{{2,3}}|[A-Z]-\\d{{5}})){_E}"
)
_CITY = "[A-ZÀ-Þ][\\w'’-]+"
ADDRESS_LATIN = re.compile(
    f"(?:(?:Flat|Apt\\.?|Unit|Suite) \\d{{1,4}}, )?(?<![\\w.-])\\d{{1,4}}[a-z]? {_CITY}(?: {_CITY})? (?:{STREETS_EN})(?![\\w])(?:, {_CITY}(?: {_CITY})?(?: \\d{{5}}(?!\\d))?)?"
    f"|P\\. ?O\\. ?Box \\d{{1,5}}(?:, {_CITY}(?: \\d{{5}}(?!\\d))?)?"
    f"|[A-ZÄÖÜ][\\wäöüß-]*(?:{STREETS_DE}) ?\\d{{1,4}} ?[a-z]?, \\d{{5}} {_CITY}|{_CITY} (?:Weg|Straße|Str\\.|Gasse|Platz|Allee) \\d{{1,4}}, \\d{{5}} {_CITY}"
    f"|(?<!\\w)\\d{{1,4}}(?: ?(?:bis|ter|B))?, ?(?:{STREETS_FR}) (?:(?:du|de|des|de la|de l')\\s?)?{_CITY},? \\d{{5}} {_CITY}"
    f"|(?:{STREETS_ES}) (?:(?:de|del|de la) )?{_CITY},? \\d{{1,4}}(?:, ?\\d{{1,2}}[º°oª.]? ?[A-Z]?)?, \\d{{5}} {_CITY}"
)
ADDRESS_RU = re.compile(f"(?:(?:г\\.|гор\\.) ?)?[А-ЯЁ][\\wё-]+, (?:{STREETS_RU}) ?[А-ЯЁ][\\wё-]+, (?:д\\.|дом) ?\\d+(?:, (?:кв\\.|корп\\.|оф\\.) ?\\d+)*")
ADDRESS_CJK = re.compile(
    "〒 ?\\d{3}-?\\d{4} ?(?:[一-鿿]{1,4}[都道府県] ?[一-鿿]{1,5}[市区町村郡] ?[一-鿿぀-ヿ]{1,8}? ?\\d{1,3}(?:-\\d{1,4}){1,3})?"
    "|[一-鿿]{2}[市县区] ?[一-鿿]{2,6}?[巷街路道弄] ?\\d{1,4} ?号(?: ?\\d{1,5} ?室)?"
    "|(?<![가-힣])[가-힣]{1,5}(?:시|군|구|읍) [가-힣]{1,6}(?:로|길) ?(?:\\d{1,4}번길 ?)?\\d{1,4}(?!\\d)"
)
_QUICK = re.compile("[\\d@\\[(]")
_AT = re.compile("@|[\\[({]\\s?(?:at|AT|ät|arroba|собака)\\s?[\\])}]")
_LONG_NUMBER = re.compile("\\d[\\d.()/+ -]{3}")
_LATIN_HINT = re.compile("Box|\\d[a-z]? [A-ZÀ-Þ]")
_EAST = re.compile("[〒市县区都道府県시군구읍]")
_CUE = re.compile("([^\\W\\d_]+\\.?)?[^\\w]{0,3}([^\\W\\d_]+)[^\\w]{0,4}$")
_CJK = re.compile("[぀-ヿ㐀-䶿一-鿿]")
_MARKS_AT_END = frozenset("-‐¬\xad")
_DIVIDED = re.compile("(?<=[^\\W\\d_])[-‐¬\xad]\\s*$")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")


def flatten(lines: list[str]) -> tuple[str, list[int], list[list[int] | None]]:
    """Text of a block in one line and one form; where each line starts in it, and for lines that changed the places of their characters."""
    spaceless = _CJK.search("".join(lines)) is not None
    parts: list[str] = []
    starts: list[int] = []
    maps: list[list[int] | None] = []
    size = 0
    for k, text in enumerate(lines):
        blank = "" if spaceless or k + 1 == len(lines) else " "
        if blank and text.rstrip()[-1:] in _MARKS_AT_END:
            m = _DIVIDED.search(text)
            if m:
                text, blank = text[: m.start()], ""
        at = None
        if not text.isascii():
            if _PLAIN_CASES.search(text):
                text, at = _one_form(text)
            for s, e, best in foreign_tokens(text):
                if len(best) == e - s:
                    text = text[:s] + best + text[e:]
        starts.append(size)
        maps.append(at)
        parts += (text, blank)
        size += len(text) + len(blank)
    return "".join(parts), starts, maps


def _one_form(text: str) -> tuple[str, list[int]]:
    """Text without invisible characters, composed and in ordinary widths; for each of its characters the place in the original."""
    piece: list[str] = []
    at: list[int] = []
    for i, ch in enumerate(text):
        if ch.isascii():
            piece.append(ch)
            at.append(i)
            continue
        if _INVISIBLE.match(ch):
            continue
        if unicodedata.combining(ch) and piece:
            both = unicodedata.normalize("NFC", piece[-1] + ch)
            if len(both) == 1:
                piece[-1] = both
                continue
        for c in (unicodedata.normalize("NFKC", ch) if _PLAIN_CASES.match(ch) else ch) or " ":
            piece.append(" " if c.isspace() else c)
            at.append(i)
    return "".join(piece), at


class Names:
    """Finds name parts in text: an automaton over the given table, in both cases and without inner hyphens."""

    def __init__(self, parts: list[tuple[str, str]]):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        kinds: dict[str, str] = {}
        for part, kind in parts:
            for form in {part, part.upper(), part.replace("-", ""), part.upper().replace("-", "")}:
                kinds[form] = "both" if kinds.get(form, kind) != kind else kind
        for form, kind in kinds.items():
            self.find.add_word(form, (len(form), kind))
        self.empty = not kinds
        if not self.empty:
            self.find.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, str]]:
        if self.empty:
            return []
        found = []
        for end, (n, kind) in self.find.iter(text):
            s, e = end + 1 - n, end + 1
            if ord(text[s]) < 0x2E80 and (text[s - 1 : s].isalpha() and s and ord(text[s - 1]) < 0x2E80 or text[e : e + 1].isalpha() and ord(text[e]) < 0x2E80):
                continue
            found.append((s, e, kind))
        found.sort(key=lambda x: (x[0], -x[1]))
        out: list[tuple[int, int, str]] = []
        for h in found:
            if not out or h[0] >= out[-1][1]:
                out.append(h)
        return out

    _INITIALS_BEFORE = re.compile("(?<![^\\W\\d_])(?:[A-ZÀ-ÞА-ЯЁ]\\. ?){1,2}$")
    _INITIALS_AFTER = re.compile(",? (?:[A-ZÀ-ÞА-ЯЁ]\\.(?: ?[A-ZÀ-ÞА-ЯЁ]\\.)?)(?=[\\s,;)]|$)")
    _BETWEEN = re.compile(" (?:[A-ZÀ-ÞА-ЯЁ]\\. ?){0,2}$")

    def people(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of each family name with a given name, an initial or a title, and of these."""
        hits = self.hits(text)
        used: set[int] = set()
        for k, (s, e, kind) in enumerate(hits):
            if k in used:
                continue
            if k + 1 < len(hits):
                s2, e2, kind2 = hits[k + 1]
                gap = text[e:s2]
                cjk = ord(text[s]) >= 0x2E80
                pair = None
                if kind != "family" and kind2 != "given" and len(gap) <= 8 and self._BETWEEN.fullmatch(gap):
                    pair = (s, e2)
                elif kind != "given" and kind2 != "family" and (gap in ((""," ") if cjk else (" ", ", ", ","))):
                    pair = (s, e2)
                if pair:
                    used.add(k + 1)
                    a, b = pair
                    after = self._INITIALS_AFTER.match(text, b) if gap.startswith(",") else None
                    yield self._title(text, a), after.end() if after and text[b] == " " and text[b + 1 : b + 3][1:] == "." and text[after.end() : after.end() + 1] in ("", ",", ";", ")") else b
                    continue
            if kind == "given" or ord(text[s]) >= 0x2E80:
                continue
            before = self._INITIALS_BEFORE.search(text, max(0, s - 6), s)
            if before:
                a = before.start()
                if not text[max(0, a - 1) : a].isdigit() and not text[max(0, a - 4) : a].rstrip().endswith(("Nr", "No")):
                    yield self._title(text, a), e
                    continue
            a = self._title(text, s)
            if a < s:
                yield a, e
                continue
            after = self._INITIALS_AFTER.match(text, e)
            if after and (text[e] == "," or ord(text[s]) >= 0x400):
                yield s, after.end()

    @staticmethod
    def _title(text: str, s: int) -> int:
        head = text[max(0, s - 8) : s].rstrip()
        for t in TITLES:
            if head.endswith(t):
                a = text.rindex(t, 0, s)
                return Names._title(text, a) if a else a
        return s


def _cues(text: str, s: int) -> list[str]:
    """The terms before a number, the longest first: the last two words and the last one, or in spaceless text the last three letters and two; none without a word."""
    m = _CUE.search(text[max(0, s - 40) : s])
    if not m:
        return []
    word = m.group(2).lower()
    if _CJK.search(word):
        return [word[-3:], word[-2:]] if len(word) > 2 else [word]
    before = (m.group(1) or "").rstrip(".").lower()
    return [f"{before} {word}", word] if before else [word]


def find_items(text: str, names: Names) -> list[tuple[int, int, str, list[str] | None, int]]:
    """(start, end, type, terms, shape) of the items in a block's text; shape: 2 no number, 1 protected, 0 ambiguous, -1 innocent."""
    out: list[tuple[int, int, str, list[str] | None, int]] = []
    if _QUICK.search(text):
        if _AT.search(text):
            clear = text
            for m in EMAIL.finditer(text):
                end = re.split("[^A-Za-z0-9]+", m.group().rstrip("])} "))[-1].lower()
                if end in FILE_ENDS or not re.search("[A-Za-z]{2}", end):
                    continue
                s, e = m.span()
                out.append((s, e, "email", None, 2))
                clear = clear[:s] + "\0" * (e - s) + clear[e:]
            text = clear
        if _LONG_NUMBER.search(text):
            clear = text
            for m in PHONE.finditer(text):
                s, e = m.span()
                if sum(map(str.isdigit, m.group())) >= 7 and text[max(0, s - 1) : s] != "〒":
                    out.append((s, e, "phone", _cues(text, s), 2))
                    clear = clear[:s] + "\0" * (e - s) + clear[e:]
            text = clear
            for m in NUMBERS.finditer(text):
                if m["q"] and text[: m.start()].rstrip()[-1:] == "〒":
                    continue
                out.append((*m.span(), "phone" if m["q"] else "national_id", _cues(text, m.start()), 1 if m["p"] else -1 if m["i"] else 0))
        if _LATIN_HINT.search(text):
            out += [(*m.span(), "address", None, 2) for m in ADDRESS_LATIN.finditer(text)]
        if not text.isascii():
            if "д." in text or "дом" in text:
                out += [(*m.span(), "address", None, 2) for m in ADDRESS_RU.finditer(text)]
            if _EAST.search(text):
                out += [(*m.span(), "address", None, 2) for m in ADDRESS_CJK.finditer(text)]
    for s, e in names.people(text):
        out.append((s, e, "name", None, 2))
    return out


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("page_no", pa.int32()), ("line_id", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("pii_type", pa.string()), ("terms", pa.list_(pa.string())), ("shape", pa.int32())])
_DDL = "doc_id bigint, page_no int, line_id int, start int, stop int, pii_type string, terms array<string>, shape int"


def _page(sent):
    """Rows of a page; sent: a broadcast of name parts."""
    state: list[Names] = []

    def page(doc: int, page_no: int, lines: dict[int, str], blocks: list) -> Iterator[tuple]:
        if not state:
            state.append(Names(sent.value))
        names = state[0]
        free = dict(lines)
        groups = []
        for _, kind, ids in blocks:
            own = [(i, free.pop(i)) for i in dict.fromkeys(ids) if i in free]
            if kind in ("Table", "ListItem"):
                groups += [[x] for x in own]
            else:
                groups.append(own)
        groups += [[x] for x in free.items()]
        for own in groups:
            own = [(i, t) for i, t in own if t.strip()]
            if not own or len(own) == 1 and is_junk(own[0][1]):
                continue
            if len(own) == 1 and own[0][1].isascii():
                text, starts, maps = own[0][1], [0], [None]
            else:
                text, starts, maps = flatten([t for _, t in own])
            for s, e, kind, terms, shape in find_items(text, names):
                while s < e and text[s].isspace():
                    s += 1
                while e > s and text[e - 1].isspace():
                    e -= 1
                a = s
                while a < e:  # one row for each line that holds a part
                    k = bisect_right(starts, a) - 1
                    b = min(e, starts[k + 1]) if k + 1 < len(starts) else e
                    last = b - 1
                    while last > a and text[last].isspace():
                        last -= 1
                    start, stop = a - starts[k], last - starts[k]
                    if maps[k]:
                        start, stop = maps[k][start], maps[k][min(stop, len(maps[k]) - 1)]
                    yield doc, page_no, own[k][0], start, stop + 1, kind, terms, shape
                    a = b

    return page


#: Share of protected numbers behind a term from which an ambiguous one is taken as protected, and weight of the type's own share in it.
DISCLOSURE, BACK_OFF = 0.5, 1.0


def term_disclosure(rows: DataFrame) -> DataFrame:
    """(pii_type, term, protected, n, share, bits): of the numbers behind each term those of the type, and how many bits the term adds to the type's share of all.

    For each type, its clear items are protected and numbers of innocent shape are not.
    """
    seen = rows.where("terms is not null and shape != 0").select("doc_id", "page_no", "line_id", "start", "pii_type", "terms", "shape")
    clear = seen.where("shape > 0").select("pii_type", F.explode("terms").alias("term"), F.lit(1).alias("yes"))
    innocent = seen.where("shape < 0").select(F.explode(F.array(F.lit("phone"), F.lit("national_id"))).alias("pii_type"), "terms")
    other = seen.where("shape > 0").select(F.when(F.col("pii_type") == "phone", "national_id").otherwise("phone").alias("pii_type"), "terms")
    rest = innocent.unionByName(other).select("pii_type", F.explode("terms").alias("term"), F.lit(0).alias("yes"))
    counts = clear.unionByName(rest).groupBy("pii_type", "term").agg(F.sum("yes").alias("protected"), F.count("*").alias("n"))
    base = counts.groupBy("pii_type").agg((F.sum("protected") / F.sum("n")).alias("base"))
    both = counts.join(base, "pii_type").withColumn("share", (F.col("protected") + BACK_OFF * F.col("base")) / (F.col("n") + BACK_OFF))
    return both.select("pii_type", "term", "protected", "n", "base", "share", F.log2(F.col("share") / F.col("base")).alias("bits"))


def candidates(lines: DataFrame, blocks: DataFrame, name_parts: DataFrame) -> DataFrame:
    parts = [(r[0], r[1]) for r in common.small_set(name_parts.where("name_part is not null and part_kind is not null and length(name_part) > 0").select("name_part", "part_kind").distinct(), 1_000_000)]
    sent = lines.sparkSession.sparkContext.broadcast(parts)
    rows = common.page_rows(lines, blocks).mapInArrow(common.page_kernel(_page(sent), _SCHEMA), _DDL)
    return common.staged(rows, "pii")


def find_spans(lines: DataFrame, blocks: DataFrame, name_parts: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_id, start, stop, pii_type): places in the original line of each personal item or its part in that line."""
    rows = candidates(lines, blocks, name_parts)
    known = term_disclosure(rows)
    keep = ["doc_id", "page_no", "line_id", "start", "stop", "pii_type"]
    # the items of a term meet in one small row for each distinct list of terms, so a hot term is no hot key of items
    asked = rows.where("shape = 0").select("pii_type", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
    asked = asked.distinct().select("pii_type", "terms", F.posexplode_outer("terms").alias("k", "term"))
    judged = asked.join(known.select("pii_type", "term", "share"), ["pii_type", "term"], "left")
    judged = judged.groupBy("pii_type", "terms").agg(F.min_by("share", F.when(F.col("share").isNotNull(), F.col("k"))).alias("share"))
    base = known.select("pii_type", "base").distinct()
    judged = judged.join(base, "pii_type", "left").where(F.coalesce("share", "base", F.lit(0.0)) >= DISCLOSURE).select("pii_type", "terms")
    ambiguous = rows.where("shape = 0").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>"))).join(judged, ["pii_type", "terms"], "left_semi")
    return rows.where("shape > 0").select(keep).unionByName(ambiguous.select(keep)).distinct()


def find_pii(lines: DataFrame, blocks: DataFrame, name_parts: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_id, pii_type) of the lines that hold all or a part of a personal item.

    Lines in no block are read alone. Null, blank and junk lines hold none; repeated rows count once; without
    name parts no names are found.
    """
    return find_spans(lines, blocks, name_parts).select("doc_id", "page_no", "line_id", "pii_type").distinct()


def redact(lines: DataFrame, blocks: DataFrame, name_parts: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_id, text): each line once, with [EMAIL], [PHONE], [NATIONAL_ID], [ADDRESS] or [NAME] for each item or part; all else is unchanged, null stays null."""
    spans = find_spans(lines, blocks, name_parts)
    spans = spans.groupBy("doc_id", "page_no", "line_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "pii_type")), asc=False).alias("spans"))
    rows = lines.where("doc_id is not null and page_no is not null and line_id is not null").groupBy("doc_id", "page_no", "line_id").agg(F.min("text").alias("text"))
    rows = rows.join(spans, ["doc_id", "page_no", "line_id"], "left")
    # from the last span to the first; a span that a later one overlaps is cut at its start
    start = F.struct(F.col("text").alias("text"), F.lit(1 << 30).alias("edge"))
    step = lambda acc, x: F.struct(
        F.when(x["start"] >= acc["edge"], acc["text"]).otherwise(F.concat(acc["text"].substr(F.lit(1), x["start"]), F.lit("["), F.upper(x["pii_type"]), F.lit("]"), acc["text"].substr(F.least(x["stop"], acc["edge"]) + 1, F.length(acc["text"])))).alias("text"),
        x["start"].alias("edge"),
    )
    return rows.select("doc_id", "page_no", "line_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.aggregate("spans", start, step)["text"]).alias("text"))
