"""Problem 5: one form for text that looks the same.

Lines with only ordinary characters are passed by the JVM (one regular expression); the others go
through compatibility normalisation of letters and digits, deletion of ignorable characters, one
kind of blank, and for every token with letters of another script a Viterbi search over its
look-alike lattice: each letter may be any of its look-alikes, a path pays for changes of script and
gains the script-consistent character n-grams of the line.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import to_batch
from .linekinds import is_junk

# --- fixed values: letters that look the same, in Latin, Cyrillic and Greek order -------------
_SETS = """a а α
A А Α
B В Β
c с ϲ
C С Ϲ
e е
E Е Ε
H Н Η
i і ι
I І Ι
j ј
J Ј
K К Κ
M М Μ
N Ν
o о ο
O О Ο
p р ρ
P Р Ρ
s ѕ
S Ѕ
T Т Τ
v ѵ ν
x х χ
X Х Χ
y у γ
Y У Υ
Z Ζ
h һ
d ԁ
q ԛ
w ԝ
k к κ
m м
t т τ
n п η
u и υ
g ɡ
a ɑ
i ı"""
# ----------------------------------------------------------------------------------------------


def _script(ch: str) -> str:
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "L"
    if 0x370 <= o < 0x400:
        return "G"
    if 0x400 <= o < 0x530:
        return "C"
    if 0x250 <= o < 0x2B0:
        return "I"
    return "?"


LATTICE: dict[str, set[str]] = {}
for _line in _SETS.splitlines():
    _own = _line.split()
    for _a in _own:
        LATTICE.setdefault(_a, set()).update(_own)

#: Blanks other than space and tab; invisible characters; letters and digits in another width, style, ligature or radical.
_BLANKS = "   -   　\u0085  "
_INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ"
_COMPAT = "ĲĳǄ-ǌſᴬ-ᵪ①-⒛Ⓐ-ⓩ⺀-⿟ㄱ-ㆎ豈-﫿ﬀ-ﬆ０-９Ａ-Ｚａ-ｚｦ-ￜ\U0001d400-\U0001d7ff\U0002f800-\U0002fa1f"
_MARKS = "̀-゙゚ͯᄀ-ᇿ"
_FOREIGN = "ɐ-ʯͰ-ϿЀ-ԯ"
_PLAIN_CASES = re.compile(f"[{_INVISIBLE}](?!\\s*$)|[{_BLANKS}]|[{_COMPAT}]|[{_MARKS}]")
_TOKEN = re.compile("[^\\W\\d_]+(?:[-'’][^\\W\\d_]+)*")
#: Characters of which one alone may need a change; lines with letters of two scripts may need one too, all others are left as they are.
SUSPICIOUS = "[" + "".join(x for x in (_INVISIBLE, _BLANKS, _COMPAT.replace("\U0001d400-\U0001d7ff", "\\x{1d400}-\\x{1d7ff}").replace("\U0002f800-\U0002fa1f", "\\x{2f800}-\\x{2fa1f}"), _MARKS)) + "ɐ-ʯͰ-Ͽ]"
_LETTERS = re.compile("[^\\W\\d_]+")
_IGNORABLE = re.compile(f"[{_INVISIBLE}]")
_BLANK = re.compile(f"[{_BLANKS}]")
#: What a step from one script to another costs, a letter other than the written one, and a letter of another script than the line's.
SWITCH, CHANGE, FOREIGN = 4.0, 1.0, 1.1
#: Cost of a pair of letters that the lines don't have.
UNSEEN = 8.0
#: Different words that a task counts before it hands their pairs on.
COUNTED = 400_000


def letter_pairs(words: dict[str, int]) -> Counter[str]:
    """Pairs of letters, word ends included, in words of one script."""
    pairs: Counter[str] = Counter()
    for w, n in words.items():
        if len({_script(c) for c in w}) == 1 and _script(w[0]) in "LC":
            for p in map("".join, zip(f"^{w.lower()}", f"{w.lower()}$")):
                pairs[p] += n
    return pairs


def pair_costs(pairs: dict[str, int]) -> dict[str, float]:
    """Cost of each pair: minus the logarithm of its share in the pairs with the same first letter."""
    heads: Counter[str] = Counter()
    for p, n in pairs.items():
        heads[p[0]] += n
    return {p: -math.log(n / heads[p[0]]) for p, n in pairs.items()}


def fit_pairs(texts: Iterator[str]) -> dict[str, float]:
    return pair_costs(letter_pairs(Counter(w for t in texts for w in _LETTERS.findall(t))))


def best_path(token: str, base: str, scores: dict[str, float] | None = None) -> str:
    """The cheapest path through the look-alike lattice of token, in a line whose other words are written in base.

    Without scores all pairs of letters of one script cost the same.
    """
    pair = (lambda a, b: scores.get((a + b).lower(), UNSEEN)) if scores else (lambda a, b: 0.0)
    states: dict[str, tuple[float, str]] = {"^": (0.0, "")}
    for ch in token:
        options = LATTICE.get(ch, {ch})
        nxt: dict[str, tuple[float, str]] = {}
        for alt in sorted(options | {ch}):
            sc = _script(alt)
            if alt != ch and sc == "I":
                continue
            own = (CHANGE if alt != ch else 0.0) + (0.0 if sc in (base, "?") else FOREIGN)
            for prev, (c, path) in states.items():
                before = _script(prev) if path else sc
                step = UNSEEN * bool(scores) + SWITCH if before != sc and "?" not in (before, sc) else pair(prev, alt) if sc != "?" else 0.0
                if alt not in nxt or (c + own + step, path + alt) < nxt[alt]:
                    nxt[alt] = (c + own + step, path + alt)
        states = nxt
    return min((c + (pair(last, "$") if _script(last) != "?" else 0.0), path) for last, (c, path) in states.items())[1]


def compose(text: str) -> str:
    """Compatibility forms of letters and digits resolved, ignorables deleted, blanks unified, letters composed."""
    if _PLAIN_CASES.search(text) or _IGNORABLE.search(text):
        text = _IGNORABLE.sub("", text)
        text = _BLANK.sub(" ", text)
        text = re.sub(f"[{_COMPAT}]+[゙゚ﾞﾟ]*", lambda m: unicodedata.normalize("NFKC", m.group()), text)
        text = unicodedata.normalize("NFC", text)
    return text


def foreign_tokens(text: str, scores: dict[str, float] | None = None) -> Iterator[tuple[int, int, str]]:
    """(start, end, best form) of the tokens that hold look-alikes; text is composed."""
    if text.isascii() or not re.search(f"[{_FOREIGN}]", text):
        return
    latin, cyr = len(re.findall("[A-Za-zÀ-ɏ]", text)), len(re.findall("[Ѐ-ԯ]", text))
    for m in _TOKEN.finditer(text):
        token = m.group()
        scripts = {_script(c) for c in token if c not in "-'’"} - {"?"}
        if len(scripts) < 2 and not scripts & {"I"}:
            sc = next(iter(scripts), "?")
            base = "C" if cyr > latin else "L"
            if sc == base or sc == "?" or any(c not in LATTICE for c in token if c not in "-'’"):
                continue
            if text[m.end() : m.end() + 1] in "-_.@0123456789/" and text[m.end() : m.end() + 2].strip(".") or text[max(0, m.start() - 1) : m.start()] in tuple("-_.@0123456789/"):
                continue
            if token.isupper() and sc == "L":  # codes and initials
                continue
            strong = any(_script(c) == sc and c not in LATTICE for c in text)  # real words of that script stand beside it
            if strong or (cyr if base == "C" else latin) < 4 * len(token):
                continue
        else:
            own = sum(_script(c) == "C" for c in token)
            base = "C" if own * 2 > len(token) or (cyr - own) > latin else "L"
            strong = [c for c in token if c not in LATTICE and c not in "-'’"]
            if strong:
                k = sum(_script(c) == "C" for c in strong)
                base = "C" if k * 2 > len(strong) else "L"
        best = best_path(token, base, scores)
        if best != token:
            yield m.start(), m.end(), best


def unify(text: str, scores: dict[str, float] | None = None) -> str:
    """The one form of a line."""
    out = compose(text)
    parts, at = [], 0
    for s, e, best in foreign_tokens(out, scores):
        parts += [out[at:s], best]
        at = e
    return "".join([*parts, out[at:]]) if parts else out


def is_case(text: str, scores: dict[str, float] | None = None) -> bool:
    """Whether a line holds a character that stands for another one that looks the same."""
    if not text.strip() or is_junk(text):
        return False
    if _PLAIN_CASES.search(text):
        return True
    return next(foreign_tokens(text, scores), None) is not None


def suspicious(text: Column) -> Column:
    return text.rlike(SUSPICIOUS) | (text.rlike("[Ѐ-ԯ]") & text.rlike("[A-Za-z]"))


def candidates(lines: DataFrame) -> DataFrame:
    rows = lines.where("doc_id is not null and page_no is not null and line_id is not null and text is not null")
    return rows.select("doc_id", "page_no", F.col("line_id").cast("int").alias("line_id"), "text").where(suspicious(F.col("text")))


_KEY = pa.schema([("doc_id", pa.int64()), ("page_no", pa.int32()), ("line_id", pa.int32())])


def pair_scores(lines: DataFrame) -> dict[str, float]:
    """Costs of pairs over all lines: counted in each task, summed by pair. The alphabets of two scripts bound how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()

        def done() -> pa.RecordBatch:
            found = letter_pairs(words)
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["pair", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                words.update(_LETTERS.findall(text))
            if len(words) > COUNTED:
                yield done()
        yield done()

    texts = lines.where(F.col("text").rlike("[A-Za-zÀ-ɏЀ-ԯ]")).select("text")
    return pair_costs(dict(texts.mapInArrow(run, "pair string, n bigint").groupBy("pair").agg(F.sum("n")).collect()))


def find_lookalikes(lines: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_id) of the lines that are not in the one form. Null, empty, blank and junk lines are no cases; repeated rows count once."""
    scores = pair_scores(lines)

    def cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([is_case(t, scores) for t in b.column(3).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(i).cast(_KEY[i].type).filter(keep) for i in range(3)], schema=_KEY)

    return candidates(lines).mapInArrow(cases, "doc_id bigint, page_no int, line_id int").distinct()


def unify_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_id, text) of all lines in the one form; a null text stays null; of a repeated row the smallest form stays.

    Rows without a complete key are left out.
    """
    schema = pa.schema([*_KEY, ("text", pa.string())])
    scores = pair_scores(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(4)]
            yield to_batch(list(zip(*cols[:3], [unify(t, scores) for t in cols[3]])), schema)

    rows = lines.where("doc_id is not null and page_no is not null and line_id is not null").select("doc_id", "page_no", F.col("line_id").cast("int").alias("line_id"), "text")
    odd = suspicious(F.col("text"))
    changed = candidates(lines).mapInArrow(run, "doc_id bigint, page_no int, line_id int, text string")
    return rows.where(odd.isNull() | ~odd).unionByName(changed).groupBy("doc_id", "page_no", "line_id").agg(F.min("text").alias("text"))
