"""What a single line of a page looks like: junk, table row, list item, contact, page number or text."""

from __future__ import annotations

import re

_MOJIBAKE = re.compile("Ã[\\u0080-ÿƒ¤©Ã]|Â[©\\u0080-¿]|[ÐÑ][¿€\\u0080-¿]|â€|ï¿|æ–|å—")
_NOISE_MARKS = re.compile("[\\\\/|\\]\\[{}<>*=_^~#&%$@+!;:`'\"?.,()\\-IlO01 ]")
_HARD_MARKS = re.compile("[\\\\|\\]\\[{}<>*=_^~#&%+$@]")
_NUMBER_JUNK = re.compile("(?:\\d+[|\\]^~]\\s*)+$")
_PLAIN_WORDS = re.compile("[a-z]+(?: [a-z]+)*$")
_VOWELS = re.compile("[aeiouyáéíóúàèäöü]")
_CELLS = re.compile("(?:\\t+|\\s+)(?:[\\dOlIoSB][\\dOlIoSB.,]*%?|[—–-])(?=\\s|$)")
_ROW = re.compile("^\\s*\\D[^\\t]{0,60}?(?:(?:\\t+|\\s+)(?:\\d[\\d.,OlIoSB]*%?|[OlIoSB]\\d[\\d.,]*%?|[—–-])){2,}\\s*$")
_LIST = re.compile("^\\s*(?:[•◦▪‣●○■□∙·*–—-]\\s*|\\(?\\d{1,3}[.)、．]\\s*|\\(?(?:[a-zA-Zа-я]|[ivx]{2,4})[.)]\\s+)(?=[^\\W_])")
_PAGE_NO = re.compile(
    "^\\s*(?:[-–—•·\\[(|]\\s*)?(?:(?:page|folio|p\\.|pág\\.|página|seite|s\\.|стр\\.|страница|с\\.|第|- )\\s*)?[\\dlIO]{1,6}"
    "(?:\\s*(?:/|\\||of|sur|von|de|из|页\\s*共|쪽|ページ|頁|页)\\s*[\\dlIO]{0,6})?\\s*(?:页|頁|ページ|쪽)?\\s*(?:[-–—•·\\])|])?\\s*$",
    re.IGNORECASE,
)
_CONTACT = re.compile("^\\s*(?:✉|e-?mail|tel\\b|id [A-Z0-9]|lot [\\d]|ref\\. [\\d]|order [\\d]|no\\. [\\d])|@|·.*\\d{3}|^[(+\\d][\\d\\s()./+ext-]{8,}$", re.IGNORECASE)


def is_junk(text: str) -> bool:
    """No language: symbol soup, repeated strokes, consonant strings, numbers with stray marks, or a wrong decoding."""
    t = text.strip()
    n = len(t)
    if n < 3 or is_page_number(t):
        return False
    if n > 5 and len(set(t)) <= 3 and not any(map(str.isdigit, t)):
        return True
    if _PLAIN_WORDS.match(t):
        letters = t.replace(" ", "")
        return len(letters) >= 5 and len(_VOWELS.findall(letters)) * 12 < len(letters)
    if not t.isascii() and len(_MOJIBAKE.findall(t)) * 8 >= n:
        return True
    if _NUMBER_JUNK.match(t):
        return True
    hard = len(_HARD_MARKS.findall(t))
    if hard * 4 >= n:
        return len(re.findall("[^\\W\\d_Il]", t)) * 4 < n
    return False


def is_table_row(text: str) -> bool:
    cells = len(_CELLS.findall(text))
    return cells >= 2 and (cells >= 3 or _ROW.match(text) is not None) and _ROW.match(text) is not None


def is_list_item(text: str) -> bool:
    return _LIST.match(text) is not None


def is_page_number(text: str) -> bool:
    return len(text) < 28 and _PAGE_NO.match(text) is not None and any(c.isdigit() or c in "lIO" for c in text)


def is_contact(text: str) -> bool:
    return _CONTACT.search(text) is not None
