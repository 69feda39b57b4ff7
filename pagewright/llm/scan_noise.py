"""Problem 3: noise of scanned pages, and continuous paragraphs without it.

1. One pass over all lines counts word forms under their confusable-glyph skeleton (and, in spaceless
   scripts, the contexts of confusable glyphs). Forms of one skeleton meet in one group; the frequent
   ones are good, rare ones that a known confusion derives from a far more frequent one are misread.
2. These verdicts go into ONE Bloom filter of blocks, sized by their number; it is all that is sent to the tasks, and its fill is checked.
3. A second pass goes page by page over the blocks in reading order: division marks at line ends,
   misread words, page numbers, and single lines that may be running titles.
4. Running titles are lines that, with digits masked, stand on two or more pages of a file.
5. Windows over one small row for each page bring the ends of neighbouring pages together: they decide marks
   at page ends and which blocks are one paragraph. Its text is reflowed with the words as printed.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .linekinds import is_contact, is_junk, is_list_item, is_page_number, is_table_row
from .lookalike import compose, unify

# --- fixed values: what is printed, and what it is read as --------------------------------------
CONFUSIONS = {
    "m": ("rn",), "d": ("cl",), "n": ("ri",), "u": ("ii",), "h": ("li",), "w": ("vv",), "e": ("c",), "t": ("f",), "o": ("0",), "i": ("!", "l", "1"),
    "l": ("1", "i"), "s": ("5",), "g": ("9",), "é": ("6",), "b": ("6",), "in": ("m",), "rn": ("m",), "cl": ("d",), "ü": ("ii",), "q": ("9",), "z": ("2",), "B": ("8",),
    "т": ("г",), "о": ("0",), "и": ("н",), "в": ("8",), "з": ("3",), "п": ("л",), "ш": ("щ",), "ы": ("ьи",), "м": ("гл",), "б": ("6",), "ё": ("е",),
}
#: The skeleton of a glyph: the strokes that it shares with what it is read as.
_STROKES = {
    "n": "ii", "m": "iii", "u": "ii", "h": "ii", "r": "i", "l": "i", "1": "i", "!": "i", "d": "ci", "e": "c", "f": "t", "0": "o", "5": "s", "9": "g", "q": "g",
    "é": "6", "б": "6", "b": "6", "ü": "ii", "2": "z", "v": "v", "w": "vv", "г": "т", "н": "и", "8": "в", "3": "з", "щ": "ш", "л": "п", "ы": "ьи", "м": "тп", "о": "o", "ё": "е",
}
#: Glyphs of spaceless scripts: printed, read.
_GLYPHS = "はほ をき 了丁 的旳 日曰 员贠 ンソ 页贞 入人 理埋 見貝 未末 シツ 己已 土士 へヘ ロ口 カ力 大太 ばぱ"
STRAY = "·~¦^|"
# ------------------------------------------------------------------------------------------------
GLYPH = {p[1]: p[0] for p in _GLYPHS.split()}
PRINTED = frozenset(GLYPH.values())
#: A form is good from this count on, unless it derives from a far more frequent one.
LEAST = 3
#: How much more frequent the printed form must be than the misread one.
RATIO = 10
#: Bits of a block of the filter (1 MB), bits a key is given, and hash functions: one key in 500 or fewer is there by chance.
BLOCK, BITS_A_KEY, HASHES = 1 << 23, 16, 5
#: Share of set bits of a block beyond which the filter would let too much through; it is refused then.
MOST_FILL = 0.5
#: Confidence of a line under which its forms are no evidence for themselves.
UNSURE = 0.6
#: Different tokens that a task counts before it hands them on.
COUNTED = 400_000

_CJK = re.compile("[々぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿]")
_SKELETON = str.maketrans(_STROKES)
_STRAY_IN = re.compile(f"(?<=[^\\W\\d_])[{re.escape(STRAY)}](?=[^\\W\\d_])")
_EDGE = " \t.,;:?…\"'“”„«»‘’()[]{}<>—–-‐¬\xad¿¡、。，！？；：（）「」『』"
_DIVIDES = re.compile("([^\\W_][^\\s]*)([-‐¬\xad])\\s*$")
_ALPHA = re.compile("[^\\W\\d_]+(?:[-'’][^\\W\\d_]+)*$")
_FORM = re.compile(f"[^\\W_{re.escape(STRAY)}][\\w{re.escape(STRAY)}!'’-]*$")


@lru_cache(maxsize=200_000)
def skeleton(form: str) -> str:
    return form.translate(_SKELETON)


@lru_cache(maxsize=100_000)
def derives(printed: str, read: str) -> bool:
    """Whether one confusion or stray mark, in words of ten letters on two, turns the printed form into the read one."""
    most = 2 if len(printed) >= 10 else 1
    seen = {(0, 0, 0)}
    todo = [(0, 0, 0)]
    while todo:
        i, j, n = todo.pop()
        if i == len(printed) and j == len(read):
            return n > 0
        nxt = []
        if i < len(printed) and j < len(read) and printed[i] == read[j]:
            nxt.append((i + 1, j + 1, n))
        if n < most:
            if j < len(read) and read[j] in STRAY:
                nxt.append((i, j + 1, n + 1))
            for k in (1, 2):
                for alt in CONFUSIONS.get(printed[i : i + k], ()) if i + k <= len(printed) else ():
                    if read.startswith(alt, j):
                        nxt.append((i + k, j + len(alt), n + 1))
        for x in nxt:
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return False


@lru_cache(maxsize=200_000)
def token_form(token: str) -> str:
    """The word form of a token between blanks, in lower case; '' for what is no word."""
    if not token.isascii():
        token = unify(token)
    form = token.strip(_EDGE + "!").lower()
    if len(form) < 2 or not _FORM.match(form):
        return ""
    letters = sum(map(str.isalpha, form))
    return form if letters * 2 >= len(form) and letters >= 1 else ""


def _count_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens: Counter[str] = Counter()
    firsts: set[str] = set()
    contexts: Counter[str] = Counter()
    marks = set(GLYPH) | PRINTED

    def rows() -> list[tuple]:
        forms: Counter[str] = Counter()
        for t, n in tokens.items():
            form = token_form(t)
            if form:
                forms[form] += n
        for t in firsts:  # seen, but maybe only the rest of a divided word, or on a line that was hard to read: no evidence for itself
            form = token_form(t)
            if form:
                forms[form] += 0
        out = [(skeleton(_STRAY_IN.sub("", f)), f, n) for f, n in forms.items()]
        for c, n in contexts.items():  # side, context, glyph
            glyph = c[-1]
            out.append((f"\t{c[:-1]}{GLYPH.get(glyph, glyph)}", c, n))
        tokens.clear()
        firsts.clear()
        contexts.clear()
        return out

    for b in batches:
        for text, sure in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if _CJK.search(text):
                t = re.sub("\\d", "9", compose(text))
                for i, ch in enumerate(t):
                    if ch in marks:
                        if i > 1:
                            contexts[f"<{t[i - 2 : i]}{ch}"] += 1
                        if i + 2 < len(t):
                            contexts[f">{t[i + 1 : i + 3]}{ch}"] += 1
            else:
                own = text.split()
                if own and _DIVIDES.search(own[-1]):
                    own.pop()
                if sure:
                    tokens.update(own[1:])
                    firsts.update(own[:1])
                else:
                    firsts.update(own)
        if len(tokens) + len(firsts) + len(contexts) > COUNTED:
            yield common.to_batch(rows(), _FORMS)
    yield common.to_batch(rows(), _FORMS)


_FORMS = pa.schema([("skeleton", pa.string()), ("form", pa.string()), ("n", pa.int64())])


def verdicts(group: dict[str, int]) -> Iterator[str]:
    """Keys for the filter from the forms of one skeleton: good forms, their skeleton and compound heads, misread forms and contexts."""
    some = next(iter(group))
    if some[0] in "<>" and len(some) == 4:
        for c, n in group.items():
            printed = GLYPH.get(c[-1])
            if printed:
                right = group.get(c[:-1] + printed, 0)
                if right >= 5 and right >= 8 * n:
                    yield f"c:{c}"
                elif n * 2 > right:
                    yield f"k:{c}"
        return
    good: list[tuple[str, int]] = []
    for f, n in sorted(group.items(), key=lambda x: (-x[1], x[0])):
        printed = next((g for g, v in good if v >= RATIO * max(n, 1) and derives(g, f)), None)
        if printed is not None:
            yield f"m:{f}"
            yield f"p:{f}>{printed}"
        elif n >= LEAST and _ALPHA.match(f):
            good.append((f, n))
            yield f"g:{f}"
            yield f"s:{skeleton(f)}"
            if "-" in f:
                yield f"h:{f.split('-')[0]}"


def _key_hash(key: str) -> int:
    """63 bits of a key."""
    return xxhash.xxh64_intdigest(key) >> 1


def _places(h: int, blocks: int) -> tuple[int, list[int]]:
    """The block of a key's hash, and its bits there."""
    a, b = h & 0xFFFFFFFF, (h >> 32) | 1
    return (h >> 23) % blocks, [(a + i * b) % BLOCK for i in range(HASHES)]


def _judge_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the keys of each group of forms with one skeleton."""
    group: dict[str, int] = {}
    last = None
    out: list[int] = []
    for b in batches:
        for sk, form, n in zip(*(b.column(i).to_pylist() for i in range(3))):
            if sk != last:
                if group:
                    out += {_key_hash(k) for k in verdicts(group)}
                    group = {}
                last = sk
            group[form] = n
        if len(out) > common.OUT_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["h"])
            out = []
    if group:
        out += {_key_hash(k) for k in verdicts(group)}
    yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["h"])


def _fill(blocks: int):
    """The bits of each block, from hashes that come sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOCK // 8, dtype=np.uint8)
        last = None
        schema = pa.schema([("block", pa.int32()), ("fill", pa.float64()), ("bits", pa.binary())])
        done = lambda: common.to_batch([(last, float(np.unpackbits(bits).mean()), zlib.compress(bits.tobytes(), 1))], schema)
        for b in batches:
            for block, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if block != last:
                    if last is not None:
                        yield done()
                        bits[:] = 0
                    last = block
                for p in _places(h, blocks)[1]:
                    bits[p >> 3] |= 1 << (p & 7)
        if last is not None:
            yield done()

    return run


def build_filter(lines: DataFrame) -> list[bytes]:
    """The blocks of the filter over all lines, compressed. Their number follows from the number of keys: two bytes a key."""
    c = F.col("confidence").cast("double") if "confidence" in lines.columns else F.lit(None).cast("double")
    sure = F.coalesce(F.when(c > 1, c / 100).otherwise(c) >= UNSURE, F.lit(True))
    texts = lines.where("text is not null").select("text", sure.alias("sure"))
    forms = texts.mapInArrow(_count_forms, "skeleton string, form string, n bigint").groupBy("skeleton", "form").agg(F.sum("n").alias("n"))
    keys = common.staged(forms.repartition("skeleton").sortWithinPartitions("skeleton").mapInArrow(_judge_groups, "h bigint"), "noise_keys")
    blocks = max(1, -(-keys.count() * BITS_A_KEY // BLOCK))
    block = F.pmod(F.shiftright("h", 23), F.lit(blocks)).cast("int")
    parts = keys.distinct().select(block.alias("block"), "h").repartition("block").sortWithinPartitions("block").mapInArrow(_fill(blocks), "block int, fill double, bits binary")
    out = [b""] * blocks
    for no, fill, bits in parts.toLocalIterator():
        if fill > MOST_FILL:
            raise RuntimeError(f"block {no} of the filter is filled to {fill:.2f}")
        out[no] = bytes(bits)
    return out


class Filter:
    """Read side of the filter, with a cache of what was asked."""

    def __init__(self, packed: list[bytes]):
        self.blocks = [zlib.decompress(x) if x else bytes(BLOCK // 8) for x in packed]
        self.known: dict[str, bool] = {}
        self.tokens: dict[str, int] = {}
        self.fixed: dict[tuple[str, bool], str] = {}

    def __contains__(self, key: str) -> bool:
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            block, places = _places(_key_hash(key), len(self.blocks))
            bits = self.blocks[block]
            found = self.known[key] = all(bits[p >> 3] >> (p & 7) & 1 for p in places)
        return found

    def token(self, token: str) -> int:
        """0: a good word, or no word; 1: misread; 2: unknown."""
        code = self.tokens.get(token)
        if code is None:
            if len(self.tokens) > 500_000:
                self.tokens.clear()
            code = self.tokens[token] = self._judge(token)
        return code

    def _judge(self, token: str) -> int:
        if "@" not in token and not token.isupper() and _STRAY_IN.search(token):
            bare = token_form(_STRAY_IN.sub("", token))
            if bare and (f"g:{bare}" in self or f"s:{skeleton(bare)}" in self):
                return 1
        form = token_form(token)
        if not form:
            return 2 if token.isalpha() else 0
        if f"g:{form}" in self:
            return 0
        if f"m:{form}" in self:
            return 1
        if "!" in token.rstrip("!"):
            word = token.strip(_EDGE).lower()
            if f"s:{skeleton(word)}" in self and _FORM.match(word):
                return 1
        return 2


def _wrong_glyph(line: str, i: int, known: Filter) -> bool:
    ch = line[i]
    left, right = f"<{line[i - 2 : i]}{ch}" if i > 1 else "", f">{line[i + 1 : i + 3]}{ch}" if i + 2 < len(line) else ""
    bad = (left and f"c:{left}" in known) or (right and f"c:{right}" in known)
    return bool(bad) and not (left and f"k:{left}" in known) and not (right and f"k:{right}" in known)


def misread_lines(texts: list[str], known: Filter) -> set[int]:
    """Indices of the lines of a block that hold a misread word."""
    hit: set[int] = set()
    spaceless = _CJK.search("".join(texts)) is not None
    if spaceless:
        flat, owner = [], []
        for k, t in enumerate(texts):
            t = re.sub("\\d", "9", compose(t)) if not t.isascii() else re.sub("\\d", "9", t)
            flat.append(t)
            owner += [k] * len(t)
            if _STRAY_IN.search(t):
                hit.add(k)
        line = "".join(flat)
        for i, ch in enumerate(line):
            if ch in GLYPH and _wrong_glyph(line, i, known):
                hit.add(owner[i])
        return hit
    head = ""  # what the line before leaves of a divided word
    judge = known.token
    for k, text in enumerate(texts):
        tokens = text.split()
        if not tokens:
            continue
        divided = _DIVIDES.search(tokens[-1]) if tokens[-1][-1] in "-‐¬\xad" and k + 1 < len(texts) else None
        first, last = 1 if head else 0, len(tokens) - (divided is not None)
        if head:
            whole = token_form(head + tokens[0])
            if whole and f"g:{whole}" not in known and f"g:{token_form(head + '-' + tokens[0])}" not in known:
                start, end = head.strip(_EDGE), tokens[0].strip(_EDGE)
                if f"m:{whole}" in known or (f"s:{skeleton(_STRAY_IN.sub('', whole))}" in known and not _ALPHA.match(start + end)):
                    hit.add(k if not _ALPHA.match(end) else k - 1 if not _ALPHA.match(start) else _side(head, tokens[0], k, known))
        codes = [judge(t) for t in tokens]
        if any(codes):
            if 1 in codes[first:last]:
                hit.add(k)
            else:
                for i in range(first, last):
                    if codes[i] and _marked(tokens, i, known) or i + 1 < last and (codes[i] or codes[i + 1]) and _split(tokens[i], tokens[i + 1], known):
                        hit.add(k)
                        break
        head = tokens[-1][: divided.start(2)].lstrip(_EDGE) if divided else ""
    return hit


def _marked(tokens: list[str], i: int, known: Filter) -> bool:
    """A letter read as an exclamation mark at the end of a word, before a word in lower case."""
    if not tokens[i].endswith("!") or not tokens[i + 1 : i + 2] or not tokens[i + 1][0].islower():
        return False
    word = tokens[i].strip(_EDGE).lower()
    return f"g:{word.rstrip('!')}" not in known and f"s:{skeleton(word)}" in known and _FORM.match(word) is not None


def _split(a: str, b: str, known: Filter) -> bool:
    """Whether two tokens are one good word with a blank inside."""
    if not a[-1].isalpha() or not b[0].islower():
        return False
    x, y = unify(a).strip(_EDGE).lower(), unify(b).strip(_EDGE).lower()
    return x.replace("-", "").isalpha() and y.replace("-", "").isalpha() and f"g:{x}{y}" in known and not (f"g:{x}" in known and f"g:{y}" in known)


def _side(head: str, rest: str, k: int, known: Filter) -> int:
    """The line that holds the wrong letter of a divided word: the one whose part alone no longer fits."""
    return k - 1 if any(x in head.lower() for x in ("rn", "cl", "ri", "ii", "vv")) else k


def divides(tail: str, rest: str, known: Filter) -> bool:
    """Whether the mark at the end of tail only divides the word that goes on as rest ('' if that is not known)."""
    m = _DIVIDES.search(tail)
    if m is None:
        return False
    head = m.group(1).lstrip(_EDGE)
    if not head or not head[-1].isalpha():
        return False
    if m.group(2) in "¬\xad":
        return True
    a = unify(head).lower()
    if not rest:
        return f"h:{a}" not in known
    if not rest[0].isalpha():
        return False
    b = unify(rest).strip(_EDGE + "!").lower()
    if f"g:{a}{b}" in known:
        return True
    if f"g:{a}-{b}" in known or (f"h:{a}" in known and f"s:{skeleton(a + b)}" not in known):
        return False
    return True


def running_key(text: str) -> str:
    """A title line with digits masked, without marks: lines of one title are equal but for misread letters."""
    return re.sub("[\\W_]+", "", re.sub("\\d+", "", unify(text).lower()))


#: What a printed glyph is read as, the other way round.
_PRINTED_AS: dict[str, list[str]] = {}
for _printed, _alts in CONFUSIONS.items():
    for _alt in _alts:
        _PRINTED_AS.setdefault(_alt, []).append(_printed)


def printed_forms(read: str) -> list[set[str]]:
    """The forms that a read one derives from: by one confusion, and by two (from ten letters on)."""
    found: list[set[str]] = []
    todo = {(read, 0)}  # what is before the place is settled
    for edits in (1, 2):
        nxt: set[tuple[str, int]] = set()
        for form, start in todo:
            for j in range(start, len(form)):
                if form[j] in STRAY:
                    nxt.add((form[:j] + form[j + 1 :], j))
                for k in (1, 2):
                    for printed in _PRINTED_AS.get(form[j : j + k], ()) if j + k <= len(form) else ():
                        nxt.add((form[:j] + printed + form[j + k :], j + len(printed)))
        found.append({f for f, _ in nxt if edits == 1 or len(f) >= 10})
        todo = nxt
    return found


def _like(word: str, model: str) -> str:
    """word in the case of model."""
    return word.upper() if len(model) > 1 and model.isupper() else word[:1].upper() + word[1:] if model[:1].isupper() else word


def printed_word(word: str, known: Filter) -> str:
    """The printed form of a word (lower case, no marks around); the word itself where none is sure."""
    if f"g:{word}" in known:
        return word
    steps = printed_forms(word)
    for forms in steps:
        own = sorted(f for f in forms if f"p:{word}>{f}" in known)
        if own:
            return own[0]
    for forms in steps:
        own = sorted(f for f in forms if f"g:{f}" in known)
        if own:
            return own[0] if len(own) == 1 else word
    return word


def corrected(token: str, known: Filter, after: str = "") -> str:
    """A token as it was printed; marks around it stay. after: the next token."""
    memo = known.fixed
    code = known.token(token)
    marked = code and _marked([token, after] if after else [token], 0, known)
    if code == 0 or code == 2 and not marked:
        return token
    found = memo.get((token, marked))
    if found is None:
        if len(memo) > 200_000:
            memo.clear()
        plain = token if token.isascii() else unify(token)
        edge = _EDGE if marked or "!" in plain.rstrip("!") else _EDGE + "!"
        core = plain.strip(edge)
        at = plain.find(core) if core else 0
        word = _STRAY_IN.sub("", core).lower()
        word = printed_word(core.lower() if f"m:{core.lower()}" in known and f"g:{word}" not in known else word, known)
        found = memo[(token, marked)] = plain[:at] + _like(word, core) + plain[at + len(core) :] if core else token
    return found


def joined(head: str, mark: str, rest: str, known: Filter) -> str:
    """The word that a line end cuts: without the mark where that only divides it."""
    bare = rest.strip(_EDGE)
    word = head + ("" if divides(head + mark, rest, known) else mark) + rest
    return corrected(word, known) if bare else word


def _cut(text: str) -> tuple[str, str, str] | None:
    """(text before the last token, its head, its mark) of a text that ends in a mark between the parts of a word."""
    stripped = text.rstrip()
    at = max(stripped.rfind(" "), stripped.rfind("\t"), stripped.rfind("\u3000")) + 1
    m = _DIVIDES.search(stripped[at:])
    return None if m is None else (stripped[:at], stripped[at : at + m.start(2)], m.group(2))


def _spaceless_lines(texts: list[str], known: Filter) -> list[str]:
    """Lines of a block in a spaceless script with the printed glyphs and without stray marks."""
    plain = [compose(t) for t in texts]
    line = re.sub("\\d", "9", "".join(plain))
    fixed = list("".join(plain))
    for m in _GLYPH_IN.finditer(line):
        if _wrong_glyph(line, m.start(), known):
            fixed[m.start()] = GLYPH[m.group()]
    whole, at, out = "".join(fixed), 0, []
    for t in plain:
        out.append(_STRAY_IN.sub("", whole[at : at + len(t)]))
        at += len(t)
    return out


def append(text: str, more: str, known: Filter) -> str:
    """A paragraph that goes on with more: words cut at its end joined, no blank between spaceless characters."""
    text, more = text.rstrip(" \t\r\n"), more.lstrip()
    if not text or not more:
        return text or more
    cut = _cut(text) if text[-1] in "-‐¬\xad" else None
    if cut is not None:
        first = more.split(maxsplit=1)[0]
        return cut[0] + joined(cut[1], cut[2], first, known) + more[len(first) :]
    return text + ("" if _CJK_EDGE.match(text[-1]) or _CJK_EDGE.match(more[0]) else " ") + more


_GLYPH_IN = re.compile(f"[{''.join(GLYPH)}]")
_CJK_EDGE = re.compile("[\u3000-\u303f々\u3040-\u30ff㇀-ㇿ㐀-䶿一-鿿豈-\ufaff\uff00-\uffef]")


def reflow(texts: list[str], known: Filter, open_start: bool = False, open_end: bool = False) -> str:
    """The lines of a block as one text: divided words joined, misread words as printed, split ones whole.

    open_start, open_end: the first or last token may be a part of a word and stays as it is.
    """
    lines = [t for t in texts if t.strip()]
    if _CJK.search("".join(lines)):
        text = ""
        for t in _spaceless_lines(lines, known):
            text = append(text, t, known)
        return text
    tokens: list[str] = []
    whole: list[bool] = []  # joined at a line end, and corrected then
    for t in lines:
        own = t.split()
        cut = _cut(tokens[-1]) if tokens and tokens[-1][-1] in "-‐¬\xad" else None
        if cut is not None:
            tokens[-1], whole[-1] = joined(cut[1], cut[2], own[0], known), True
            own = own[1:]
        tokens += own
        whole += [False] * len(own)
    judge = known.token
    codes = [judge(t) for t in tokens]
    if not any(codes):
        return " ".join(tokens)
    out: list[str] = []
    i, n = 0, len(tokens)
    while i < n:
        t, more = tokens[i], i + 1 < n
        if codes[i] or more and codes[i + 1]:
            rough = whole[i] or (i == 0 and open_start) or (i == n - 1 and open_end and _cut(t) is not None)
            if not rough and more and not whole[i + 1] and _split(t, tokens[i + 1], known) and not is_junk(t):
                t, i = t + tokens[i + 1], i + 1
                t = corrected(t, known, tokens[i + 1] if i + 1 < n else "")
            elif not rough and codes[i]:
                t = corrected(t, known, tokens[i + 1] if more else "")
        out.append(t)
        i += 1
    return " ".join(out)


_TERMINATED = re.compile("[.!?…。！？:：;][\\s\"'“”„«»‘’」』)\\]]*$")


def begins(head: str) -> int:
    """How a block begins: 0 as a list item, 2 in lower case, as only the rest of a paragraph does, 1 otherwise."""
    return 0 if is_list_item(head) else 2 if head.lstrip()[0].islower() else 1


_ROWS = pa.schema([
    ("doc_id", pa.int64()), ("page_no", pa.int32()), ("line_id", pa.int32()), ("noise", pa.string()), ("key", pa.string()), ("misread", pa.bool_()),
    ("block_no", pa.int32()), ("edge", pa.bool_()), ("flows", pa.bool_()), ("head", pa.string()), ("begins", pa.int32()), ("open", pa.bool_()), ("text", pa.string()),
])
_ROWS_DDL = "doc_id bigint, page_no int, line_id int, noise string, key string, misread boolean, block_no int, edge boolean, flows boolean, head string, begins int, open boolean, text string"
_NO_BLOCK = (None,) * 7


def _title_end(text: str) -> tuple:
    """No block's columns, but for open, which is false where the line ends as a sentence does (short titles don't)."""
    return None, None, None, None, None, False if _TERMINATED.search(text) else None, None


def _page(packed, with_text: bool = False):
    """Rows of a page: noise; "maybe" a running title; "cut", a mark at the end of the last block; "block", at the ends of the page.

    with_text: instead "maybe", and "block" for all Paragraph blocks, with their text.
    """
    state: list[Filter] = []

    def page(doc: int, page_no: int, lines: dict[int, str], blocks: list) -> Iterator[tuple]:
        if not state:
            state.append(Filter(packed.value))
        known = state[0]
        body = []  # number, kind, lines, whether it may be a running title
        for k, (no, kind, ids) in enumerate(blocks):
            own = [(i, lines[i]) for i in dict.fromkeys(ids) if i in lines and lines[i].strip()]
            if not own or len(own) == 1 and is_page_number(own[0][1]):
                if own and not with_text:
                    yield doc, page_no, own[0][0], "page_no", None, False, *_NO_BLOCK
                continue
            text = own[0][1]
            plain = is_list_item(text) or is_table_row(text) or is_contact(text) or is_junk(text)
            maybe = len(own) == 1 and kind == "Paragraph" and (k < 2 or k > len(blocks) - 3) and not plain
            body.append((no, kind, own, maybe, kind == "Paragraph" and not (len(own) == 1 and plain)))
        firm = [n for n, b in enumerate(body) if not b[3]]
        top, bottom = (firm[0], firm[-1]) if firm else (len(body), -1)
        for n, (no, kind, own, maybe, flows) in enumerate(body):
            texts = [t for _, t in own]
            last, text = own[-1]
            if n <= top or n >= bottom or (with_text and kind == "Paragraph"):
                shown = reflow(texts, known, n <= top, n >= bottom) if with_text and kind == "Paragraph" and not (len(own) == 1 and is_junk(text)) else "\n".join(texts) if with_text and kind == "Paragraph" else None
                yield doc, page_no, own[0][0], "block", None, maybe, no, n <= top or n >= bottom, flows, texts[0].split()[0], begins(texts[0]), _TERMINATED.search(texts[-1]) is None, shown
            if kind != "Paragraph" or len(own) == 1 and is_junk(text):
                continue
            if with_text:
                if maybe:
                    yield doc, page_no, last, "maybe", running_key(text), False, *_title_end(text)
                continue
            wrong = misread_lines(texts, known)
            if maybe:
                yield doc, page_no, last, "maybe", running_key(text), bool(wrong), *_title_end(text)
            else:
                for j in wrong:
                    if not is_junk(texts[j]):
                        yield doc, page_no, own[j][0], "misread", None, False, *_NO_BLOCK
            for j, (i, text) in enumerate(own):
                if text.rstrip()[-1:] in "-‐¬\xad" or text[-1:] == "\xad":
                    if j + 1 == len(own) and n >= bottom:
                        if len(text.split()) > 1:
                            yield doc, page_no, i, "cut", text.split()[-1] if text.split() else "", False, no, *_NO_BLOCK[1:]
                        continue
                    rest = texts[j + 1].split() if j + 1 < len(own) else [""]
                    if divides(text, rest[0] if rest else "", known):
                        yield doc, page_no, i, "hyphen", None, False, *_NO_BLOCK

    return page


_CUTS = pa.schema([("doc_id", pa.int64()), ("page_no", pa.int32()), ("line_id", pa.int32()), ("noise", pa.string())])


def _judge_cuts(packed):
    """Marks at page ends, by the first word of the next page; a misread word that the page end cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(packed.value)
        for b in batches:
            out = []
            for doc, page_no, i, tail, next_page, next_line, rest in zip(*(b.column(k).to_pylist() for k in range(7))):
                rest = rest or ""
                if not divides(tail, rest, known):
                    continue
                out.append((doc, page_no, i, "hyphen"))
                head = tail[: _DIVIDES.search(tail).start(2)].lstrip(_EDGE)
                if rest and f"m:{token_form(head + rest)}" in known:
                    start, end = head.strip(_EDGE), rest.strip(_EDGE)
                    late = not _ALPHA.match(end) or bool(_ALPHA.match(start)) and _side(head, rest, 1, known) == 1
                    out.append((doc, next_page, next_line, "misread") if late else (doc, page_no, i, "misread"))
            if out:
                yield common.to_batch(out, _CUTS)

    return run


def _titles(rows: DataFrame) -> DataFrame:
    """Lines that may be running titles, with noise running, misread or null."""
    maybe = rows.where("noise = 'maybe'").select("doc_id", "page_no", "line_id", "key", "misread", F.col("open").isNotNull().alias("ended"))
    size = F.lit(5)  # a misread letter leaves one end of the title as it is
    ends = F.explode(F.array(F.concat(F.lit("<"), F.left("key", size)), F.concat(F.lit(">"), F.right("key", size))))
    keys = maybe.where("length(key) >= 4 and (length(key) >= 8 or not ended)").groupBy("doc_id", "key").agg(F.count_distinct("page_no").alias("pages"))
    ended = keys.withColumn("end", ends)
    titles = ended.groupBy("doc_id", "end").agg(F.sum("pages").alias("n"), F.max_by("key", F.struct("pages", "key")).alias("title")).where("n >= 2").drop("n")
    near = (F.col("title") == F.col("key")) | (F.levenshtein("title", "key") * 6 <= F.length("title"))
    named = ended.join(titles, ["doc_id", "end"]).where(near).groupBy("doc_id", "key").agg(F.min("title").alias("title"))
    judged = maybe.join(named, ["doc_id", "key"], "left")
    repeated = judged.where("title is not null").groupBy("doc_id", "title").agg((F.min("page_no") != F.max("page_no")).alias("repeated"))
    return judged.join(repeated, ["doc_id", "title"], "left").withColumn("noise", F.when(F.col("repeated"), "running").when(F.col("misread"), "misread"))


def _page_ends(rows: DataFrame, running: DataFrame) -> DataFrame:
    """One small row for each page: its first and last block without running titles, and the first block of the page that follows."""
    ends = rows.where("noise = 'block' and edge").select("doc_id", "page_no", "line_id", "block_no", "flows", "head", "begins", "open").join(running, ["doc_id", "page_no", "line_id"], "left_anti")
    first, last = F.struct("block_no", "line_id", "flows", "head", "begins"), F.struct("block_no", "flows", "open")
    pages = ends.groupBy("doc_id", "page_no").agg(F.min_by(first, "block_no").alias("first"), F.max_by(last, "block_no").alias("last"))
    own = W.partitionBy("doc_id").orderBy("page_no")
    return pages.withColumn("next_page", F.lead("page_no").over(own)).withColumn("next", F.lead("first").over(own))


def _noise(packed, rows: DataFrame) -> DataFrame:
    titles = _titles(rows).select("doc_id", "page_no", "line_id", "noise")
    running = titles.where("noise = 'running'").drop("noise")
    ends = _page_ends(rows, running).select("doc_id", "page_no", F.col("last.block_no").alias("block_no"), "next_page", F.col("next.line_id").alias("next_line"), F.when(F.col("next.flows"), F.col("next.head")).alias("rest"))
    cuts = rows.where("noise = 'cut'").select("doc_id", "page_no", "line_id", "key", "block_no").join(running, ["doc_id", "page_no", "line_id"], "left_anti")
    cuts = cuts.join(ends, ["doc_id", "page_no", "block_no"], "left").select("doc_id", "page_no", "line_id", "key", "next_page", "next_line", "rest")
    cuts = cuts.mapInArrow(_judge_cuts(packed), "doc_id bigint, page_no int, line_id int, noise string")
    sure = rows.where("noise in ('page_no', 'misread', 'hyphen')").select("doc_id", "page_no", "line_id", "noise")
    sure = sure.where("noise != 'hyphen'").unionByName(sure.where("noise = 'hyphen'").join(running, ["doc_id", "page_no", "line_id"], "left_anti"))
    return sure.unionByName(cuts).unionByName(titles.where("noise is not null")).distinct()


def _pass(lines: DataFrame, blocks: DataFrame, with_text: bool, name: str):
    packed = lines.sparkSession.sparkContext.broadcast(build_filter(lines))
    rows = common.page_rows(lines, blocks).mapInArrow(common.page_kernel(_page(packed, with_text), _ROWS), _ROWS_DDL)
    return packed, common.staged(rows, name)


def find_noise(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_id, noise) with noise hyphen, running, page_no or misread.

    Lines that are null, blank or in no block, and junk lines, are no cases; repeated rows count once.
    """
    return _noise(*_pass(lines, blocks, False, "scan_noise"))


_PARAGRAPHS = pa.schema([("doc_id", pa.int64()), ("page_no", pa.int32()), ("block_no", pa.int32()), ("last_page", pa.int32()), ("last_block", pa.int32()), ("text", pa.string())])
_PARAGRAPHS_DDL = "doc_id bigint, page_no int, block_no int, last_page int, last_block int, text string"


def _join_parts(packed):
    """The parts of each paragraph, in order, as one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(packed.value)
        for b in batches:
            out = []
            for doc, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = ""
                for k, part in enumerate(parts):
                    own = part["text"]
                    if not _CJK.search(own) and "\n" not in own and (k == 0 or _cut(text) is None):  # the first token was left as it is
                        first, _, more = own.partition(" ")
                        own = corrected(first, known, more.split(" ", 1)[0]) + own[len(first) :]
                    text = append(text, own, known) if k else own
                out.append((doc, parts[0]["page_no"], parts[0]["block_no"], parts[-1]["page_no"], parts[-1]["block_no"], text))
            if out:
                yield common.to_batch(out, _PARAGRAPHS)

    return run


def find_paragraphs(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, page_no, block_no, last_page, last_block, text): the Paragraph blocks as continuous text without noise, one row for each paragraph.

    Running titles and page numbers are gone, divided and split words whole, misread ones as printed where the
    corpus says what that is; blocks that a page end cuts are one paragraph, placed where it begins.
    """
    packed, rows = _pass(lines, blocks, True, "scan_paragraphs")
    running = _titles(rows).where("noise = 'running'").select("doc_id", "page_no", "line_id")
    pages = _page_ends(rows, running)
    own = W.partitionBy("doc_id").orderBy("page_no")
    linked = F.col("last.flows") & F.col("next.flows") & (F.col("next.begins") > 0) & (F.col("last.open") | (F.col("next.begins") == 2))
    pages = pages.withColumn("linked", F.coalesce(linked, F.lit(False)))
    pages = pages.withColumn("entered", F.coalesce(F.lag("linked").over(own), F.lit(False)))
    begins = ~(F.col("entered") & (F.col("first.block_no") == F.col("last.block_no")))
    here = F.struct(F.col("page_no").alias("page"), F.col("last.block_no").alias("block"))
    pages = pages.withColumn("anchor", F.last(F.when(begins, here), ignorenulls=True).over(own))
    pages = pages.withColumn("start", F.lag("anchor").over(own))
    moved = pages.where("entered").select("doc_id", "page_no", F.col("first.block_no").alias("block_no"), "start")
    texts = rows.where("noise = 'block' and text is not null").select("doc_id", "page_no", "line_id", "block_no", "edge", "text")
    inner = texts.where("not edge").select("doc_id", "page_no", "block_no", F.col("page_no").alias("last_page"), F.col("block_no").alias("last_block"), "text")
    edge = texts.where("edge").join(running, ["doc_id", "page_no", "line_id"], "left_anti").join(moved, ["doc_id", "page_no", "block_no"], "left")
    start = F.coalesce("start", F.struct(F.col("page_no").alias("page"), F.col("block_no").alias("block")))
    parts = edge.groupBy("doc_id", start.alias("start")).agg(F.array_sort(F.collect_list(F.struct("page_no", "block_no", "text"))).alias("parts")).select("doc_id", "parts")
    return inner.unionByName(parts.mapInArrow(_join_parts(packed), _PARAGRAPHS_DDL))
