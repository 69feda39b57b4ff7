"""Problem 1: sentence ends of Paragraph blocks in spaced and spaceless scripts.

Spaced scripts: every run of terminators with the closers behind it is a node of a terminator
lattice; a node is an end unless the word before it is an abbreviation, an initial, an ordinal of a
date, or what follows shows that the sentence goes on. Nodes inside a quotation count only when the
quotation itself ends a sentence.

Spaceless scripts: the text between marks is segmented by the best path through a lattice of words that
are counted from the corpus (wordlattice). A gap between two words is then classified by what stands in it
(a terminator, one with closers, a blank, nothing) and by its words: how much more often than others the
one before it ends, and the one behind it opens a sentence. So a particle behind a closing quotation mark
carries the sentence on, and a final word before an opening one ends it without any mark.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .lookalike import unify
from .wordlattice import CJK, MOST_SCORE, Lattice, fit

# --- fixed values -----------------------------------------------------------------------------
#: Abbreviations (lower case, without the last period) after which a sentence goes on.
ABBREVIATIONS = frozenset(
    """no nos nr sec fig figs p pp vol ch art arts abs vgl cf ref refs approx ca env aprox ed eds bd s st vs esp incl tel fax ext dept
    mr mrs ms mx dr dra prof sr sra srta mme mlle mm. fr hr rev hon jr gen col capt bzw ggf inkl evtl sog str hg jg
    jan feb mar apr jun jul aug sep sept oct nov dec janv févr avr juil déc ene abr ago dic mär okt dez
    i.e e.g p.o z d.h u.a n.º núm pág págs av avda cía ud uds vd
    т п пп ст см ср прим рис табл стр с ул кв г д корп тел им гл проф акад тов обл пл пер наб янв фев мар апр авг сен сент окт ноя дек""".split()
)
#: Abbreviations that often stand last: an end when a capital or an opening mark follows.
FINAL_ABBREVIATIONS = frozenset("etc usw p.m a.m al ff uam др проч".split())
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
SPEECH_ZH = ("问道", "说道", "写道", "喊道", "答道", "问", "说", "写着")
#: Particles that carry a sentence on behind a closing quotation mark, whatever the corpus has counted.
PARTICLES = ("と", "って", "という", "とは", "の", "を", "が", "は", "に", "的")
GO_ON_KO = ("라고", "이라고", "고 ", "하고", "라는", "라며", "는 ", "은 ")
# ----------------------------------------------------------------------------------------------

#: What a gap of a spaceless script is worth before its words are looked at, by what stands in it: a full terminator, an ASCII one,
#: a terminator with closers behind it, and speech that goes on behind it.
FULL, ASCII_MARK, CLOSED, SPEECH = 10.5, 9.0, 3.0, -8.0
#: What is added to the odds of any gap where a blank stands, and where nothing does (asked only where a block has no terminator at all).
BLANK, BARE = 0.0, -1.0

_CJK = re.compile(f"[{CJK}]")
_HANGUL = re.compile("[가-힣]")
_NODE = re.compile("[.!?…]+(?:[”“\"»’'\\)\\]]|[   \n]»)*(?=\\s)")
_NODE_CJK = re.compile(f"(?:[。！？｡…]+|(?<=[{CJK}）」])[.!?．]+(?![\\w.])|(?<=[\\w%％)）])[!?]+(?=[{CJK}”」\n]|$)|(?<=[\\w%)）”」])[.](?=[\n]?[{CJK}“「]))[”」』）)\"»]*")
_QUOTE = re.compile("„[^“”„]*[“”]|“[^”“]*”|«[^»«]*»|「[^」]*」|『[^』]*』|\"[^\"]*\"")
_WORD_BEFORE = re.compile("[^\\s(\\[«“„\"']*$")
_LEAD = re.compile("[\\s“„«\"'‘(\\[¡¿「『]*")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_OPEN_ONLY = re.compile("^\\s*[(\\[]?(?:\\d{1,3}|[A-Za-z]|[ivxIVX]{1,5})[.)]$")


def _spaced_end(text: str, start: int, end: int, span: tuple[int, int] | None) -> bool:
    rest = text[end : end + 40]
    tail = rest[_LEAD.match(rest).end() :]
    if not tail:
        return True
    nxt = tail[0]
    cluster = text[start:end]
    if nxt.islower() or nxt in "—–,;:)]·":
        return False
    closed = cluster[-1] in "”“\"»"
    if closed and _HANGUL.match(nxt) and tail.startswith(GO_ON_KO):
        return False
    if cluster[0] == "." and (len(cluster) == 1 or (not cluster.strip(".)") and cluster.count(".") == 1)):
        head = text[max(0, start - 40) : start]
        word = _WORD_BEFORE.search(head).group()
        if not word.isascii():  # invisible and full-width characters inside the word don't change it
            word = unify(_INVISIBLE.sub("", unicodedata.normalize("NFKC", word)))
        word = word.lower()
        if not word:  # a period of its own, as in a broken abbreviation
            return nxt.isupper()
        if word in FINAL_ABBREVIATIONS:
            return not nxt.isdigit()
        if word.endswith("str") and nxt.isdigit():  # street names
            return False
        if word in ABBREVIATIONS or word.endswith(("l'art", "d'art")):
            before = head[: len(head) - len(word)].rstrip()
            if word in ("г", "гг") and before[-1:].isdigit():
                return not nxt.isdigit()
            return word in ("д", "п") and before.endswith("т.") and not nxt.isdigit()
        if len(word) == 1 and word.isalpha():
            before = head[:-1].rstrip()
            if word == "b" and before.endswith("z."):
                return False
            if before[-1:].isdigit() or head[-2:-1] in "/-":
                return True
            return not (head[-1].isupper() and nxt.isupper())
        if word.isdigit():
            if len(word) <= 2 and re.match("[^\\W\\d_]+", tail) and re.match("[^\\W\\d_]+", tail).group().lower() in MONTHS:
                return False
            if start - len(word) == 0 or _OPEN_ONLY.match(text[: start + 1]):
                return False
    return True


_CLOSERS = "”」』\"»"
_RUN_BEHIND = re.compile(f"[\\s“「『（(]*([{CJK}]+)")
_CLAUSE_END = re.compile("[。！？，!?,]")


def _words_at(flat: str, start: int, end: int, lattice: Lattice) -> tuple[str, str]:
    """The word before start and the one behind end, on the best path of their clauses; '' for none."""
    left = right = ""
    k = start
    while k and _CJK.match(flat[k - 1]):
        k -= 1
    if k < start:
        ends = lattice.segment(flat[k:start])
        left = flat[k + (ends[-2] if len(ends) > 1 else 0) : start]
    m = _RUN_BEHIND.match(flat, end)
    if m:
        right = m.group(1)[: lattice.segment(m.group(1))[0]]
    return left, right


def _spaceless_ends(text: str, lattice: Lattice) -> list[tuple[int, int, bool]]:
    """(start of the terminator, end, whether it is one) of the gaps of spaceless text that end a sentence."""
    at = [i for i, c in enumerate(text) if c != "\n"]
    flat = "".join(text[i] for i in at)
    flat_at = {p: i for i, p in enumerate(at)}

    def place(p: int) -> int:
        while p < len(text) and text[p] == "\n":
            p += 1
        return flat_at.get(p, len(flat))

    out = []
    nodes = [(m.start(), m.end()) for m in _NODE_CJK.finditer(text)]
    for s, e in nodes:
        rest = text[e:].lstrip("\n ")
        if rest and rest[0] in "，、,；;：:）)":
            continue
        a, b = place(s), place(e)
        worth = FULL if text[s] in "。！？｡" else ASCII_MARK
        if text[e - 1] in _CLOSERS:
            clause = _CLAUSE_END.split(flat[b : b + 200], maxsplit=1)[0]
            worth = CLOSED + (SPEECH if clause.endswith(SPEECH_ZH) else 0.0)
        right = ""
        if rest and lattice:
            left, right = _words_at(flat, a, b, lattice)
            worth += (lattice.score(left, 0) if worth > CLOSED else 0.0) + (0.0 if rest[0] in "“「『" else lattice.score(right, 1))  # a quotation opens a sentence whatever its first word
        if worth <= FULL and text[e - 1] in _CLOSERS and (right in PARTICLES if right else rest.startswith(PARTICLES)):
            worth -= MOST_SCORE
        if worth > 0:
            out.append((s, e, True))
    if lattice and not nodes:
        for m in re.finditer(f"[{CJK}]+", flat):
            ends = lattice.segment(m.group())
            words = [m.group()[a:b] for a, b in zip([0, *ends], ends)]
            for w, nxt, e in zip(words, words[1:], ends):
                if lattice.odds + BARE + lattice.score(w, 0) + lattice.score(nxt, 1) > 0:
                    p = at[m.start() + e - 1] + 1
                    out.append((p, p, False))
    if lattice and " " in text or "　" in text:
        for m in re.finditer(f"(?<=[{CJK}])[ 　]+(?=[{CJK}])", text):
            left, right = _words_at(flat, place(m.start()), place(m.end()), lattice)
            if lattice.odds + BLANK + lattice.score(left, 0) + lattice.score(right, 1) > 0:
                out.append((m.start(), m.start(), False))
    return sorted(set(out))


NO_WORDS = Lattice({})


def sentence_ends(text: str, lattice: Lattice = NO_WORDS) -> list[int]:
    """Offsets behind the last character of every sentence but the last of a block's lines, joined by line feeds."""
    cjk = len(_CJK.findall(text)) if not text.isascii() else 0
    spaceless = cjk * 4 > len(text) and not (len(_HANGUL.findall(text)) > cjk)
    if not spaceless and not re.search("[.!?…。！？｡．]", text):
        return []
    spans = [(m.start(), m.end()) for m in _QUOTE.finditer(text)] if re.search("[“„«「『\"]", text) else []
    ends: list[tuple[int, tuple[int, int] | None]] = []
    k = 0
    if spaceless:
        found = _spaceless_ends(text, lattice)
    else:
        found = [(m.start(), m.end(), True) for m in _NODE.finditer(text)]
    for s, e, _ in found:
        while k < len(spans) and spans[k][1] <= s:
            k += 1
        span = spans[k] if k < len(spans) and spans[k][0] < s < spans[k][1] else None
        if span and e > span[1]:  # closers that belong to nothing: an opening mark stuck to the end
            e = span[1]
        if spaceless or _spaced_end(text, s, e, span):
            ends.append((e, span))
    accepted = {e for e, _ in ends}
    return [e for e, span in ends if span is None or e >= span[1] or span[1] in accepted]


_UNIT = re.compile("^\\s*(?:[•◦▪‣·●○■□–—*-]\\s|\\(?\\d{1,3}[.)]\\s|\\(?[a-zA-Zivx]{1,4}\\)\\s)|\t|[^\\s.]  +\\S|[<✉]|^(?:E-?mail|Tel|ID|Lot|Ref|Order|No)\\b")


def page_sentences(words):
    """Rows of a page, with the words of a broadcast dictionary (None: without)."""
    state: list[Lattice] = []

    def page(doc: int, page_no: int, lines: dict[int, str], blocks: list) -> Iterator[tuple]:
        if not state:
            state.append(Lattice(words.value) if words is not None else NO_WORDS)
        for _, kind, ids in blocks:
            if kind != "Paragraph":
                continue
            own = [(i, lines[i]) for i in dict.fromkeys(ids) if i is not None and lines.get(i)]
            if not own:
                continue
            text = "\n".join(t for _, t in own)
            if len(own) == 1 and (_UNIT.search(text) or sum(map(str.isalpha, text)) * 2 < len(text)):
                yield doc, page_no, own[0][0], len(text)
                continue
            k, base, last = 0, 0, own[-1]
            total = len(text)
            for e in sentence_ends(text, state[0]):
                if e >= total or not text[e:].strip():
                    break
                while e > base + len(own[k][1]):
                    base += len(own[k][1]) + 1
                    k += 1
                if e > base:
                    yield doc, page_no, own[k][0], e - base
            yield doc, page_no, last[0], len(last[1])

    return page


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("page_no", pa.int32()), ("line_id", pa.int32()), ("end_pos", pa.int32())])


def find_sentence_ends(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_id, end_pos) of every sentence end of the Paragraph blocks.

    Repeated rows count once. A block without any line that has a text yields nothing; lines that are
    missing, null or empty are skipped; empty tables give an empty result. Extra columns are ignored.
    """
    words = lines.sparkSession.sparkContext.broadcast(fit(lines))
    rows = common.page_rows(lines, blocks, "kind = 'Paragraph'")
    return rows.mapInArrow(common.page_kernel(page_sentences(words), _SCHEMA), "doc_id bigint, page_no int, line_id int, end_pos int")
