"""Text functions of the document model as column expressions (and in Python, for page kernels)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------
BULLETS = "•·●○◦■□▪▫‣⁃➢➤►✓✔✗❖◆◇-–—*"
LOOSE_BULLETS = "•·●○◦■□▪▫‣⁃➢➤►✓✔✗❖◆◇-–—*oeO°»>"
ORDERED = "\\(?(?:[0-9]{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.)]"
NUMBER_CELL = "^[-+]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\\.[0-9]+)?%?$"
CJK_RANGES = (("3000", "303F"), ("3040", "30FF"), ("3400", "9FFF"), ("FF00", "FFEF"))
HANGUL_RANGE = ("AC00", "D7AF")
FONT_STYLE = "(?i)[-,](Bold|Italic|Oblique|Regular|Roman|Book|Medium|Light|Black|Semibold|SemiBold|Demi|Heavy|BoldItalic|BoldOblique)+.*$"
FONT_MAKER = "(MT|PS|PSMT)$"
FONT_BOLD = "(?i)Bold|Black|Heavy|Semibold|Demi"
FONT_ITALIC = "(?i)Italic|Oblique"
LANGUAGE_NAMES = {"zh": "Chinese", "ch": "Chinese", "chinese": "Chinese", "ja": "Japanese", "jp": "Japanese", "japanese": "Japanese", "ru": "Russian", "russian": "Russian"}
FORMAT_NAMES = {"xlsx": "Xlsx", "excel": "Xlsx", "html": "Html", "htm": "Html", "txt": "Text", "text": "Text"}
# ------------------------------------------------------------------------------------------------
#: White space of any kind, without and within brackets.
BLANK = "\\s\\p{Z}"
_GLYPHS = BULLETS.replace("-", "")
#: Both end on the first character of the text behind the marker.
BULLET_MARKER = f"^([{_GLYPHS}])[{BLANK}]*[^{BLANK}]|^(-) [{BLANK}]*[^{BLANK}]"
ORDERED_MARKER = f"^({ORDERED})[{BLANK}]+[^{BLANK}]"
CJK = "".join(f"\\u{a}-\\u{b}" for a, b in CJK_RANGES)
_CJK = re.compile(f"[{CJK}]")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{BLANK}]+|[{BLANK}]+$", "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: a character outside of the basic plane counts twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def bullet_marker(text: Column) -> Column:
    """The bullet that opens a line, or ''. A hyphen counts only before a blank."""
    return F.concat(F.regexp_extract(text, BULLET_MARKER, 1), F.regexp_extract(text, BULLET_MARKER, 2))


def ordered_marker(text: Column) -> Column:
    return F.regexp_extract(text, ORDERED_MARKER, 1)


def marker_kind(text: Column) -> Column:
    return F.when(bullet_marker(text) != "", "bullet").when(ordered_marker(text) != "", "ordered").otherwise("none")


def marker_prefix(text: Column) -> Column:
    """Characters that a marker takes with the blanks behind it, 0 without one."""
    whole = F.when(bullet_marker(text) != "", F.regexp_extract(text, BULLET_MARKER, 0)).otherwise(F.regexp_extract(text, ORDERED_MARKER, 0))
    return F.greatest(F.length(whole) - 1, F.lit(0))


def is_cjk(char: Column) -> Column:
    return char.rlike(f"^[{CJK}\\u{HANGUL_RANGE[0]}-\\u{HANGUL_RANGE[1]}]")


def joins_without_space(char: Column) -> Column:
    """Characters of scripts that wrap without blanks, marks included; Hangul has blanks."""
    return char.rlike(f"^[{CJK}]")


def flow_text(lines: list[str]) -> str:
    """Text of a paragraph from its lines: a word divided by a hyphen is joined, no blank next to CJK."""
    out = ""
    for k, line in enumerate(lines):
        line = line.rstrip()
        if k and out:
            if out[-1] == "-" and line[:1].islower() and out[-2:-1].isalpha():
                out = out[:-1]
            elif not _CJK.match(out[-1]) and not _CJK.match(line[:1]):
                out += " "
        out += line
    return out


def flow(joined: Column) -> Column:
    """flow_text of lines that are joined by line feeds."""
    out = F.regexp_replace(joined, f"[{BLANK}&&[^\\n]]+(?=\\n|\\z)", "")
    out = F.regexp_replace(out, "^\\n+", "")
    out = F.regexp_replace(out, "(?<=\\p{L})-\\n(?=\\p{Ll})", "")
    out = F.regexp_replace(out, f"(?<=[{CJK}])\\n+", "")
    out = F.regexp_replace(out, f"\\n(?=[{CJK}])", "")
    return F.replace(out, F.lit("\n"), F.lit(" "))


def number_cell(text: Column) -> tuple[Column, Column]:
    """(value, number format id) of a sheet cell's text, white space around it aside; null for text."""
    t = trimmed(text)
    ok = t.rlike(NUMBER_CELL)
    raw = F.regexp_replace(t, "[,%]", "")
    percent, grouped = F.endswith(t, F.lit("%")), F.contains(t, F.lit(","))
    value = raw.try_cast("double")
    value = F.when(ok, F.when(percent, value / 100).otherwise(value))
    decimals = F.length(F.regexp_extract(raw, "\\.([0-9]+)$", 1))
    fmt = (
        F.when(~ok, None).when(percent, F.when(decimals > 0, 10).otherwise(9)).when(grouped, F.when(decimals > 0, 4).otherwise(3))
        .when(decimals > 2, 0).when(decimals > 0, 2).otherwise(1)
    )
    return value, fmt


def column_name(index: Column) -> Column:
    """Sheet column name of a 1-based index of any size (bijective base 26; 14 letters hold every bigint); '' for 0 and less."""
    start = F.struct(index.cast("bigint").alias("n"), F.lit("").alias("s"))
    letter = lambda n: F.char((F.lit(65) + (n - 1) % 26).cast("int"))
    step = lambda x, _: F.when(x["n"] > 0, F.struct(F.call_function("div", x["n"] - 1, F.lit(26)).cast("bigint").alias("n"), F.concat(letter(x["n"]), x["s"]).alias("s"))).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda x: x["s"])


def column_index(reference: Column) -> Column:
    """1-based index of the letters that open a cell reference."""
    letters = F.split(F.upper(F.regexp_extract(reference, "^[A-Za-z]*", 0)), "")
    return F.aggregate(letters, F.lit(0).cast("bigint"), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64))


def cell_reference(column: Column, row: Column) -> Column:
    return F.concat(column_name(column), row.cast("string"))


def natural_key(name: Column) -> Column:
    """A string whose order is the natural order of names: digit runs of any length by value, all else without case, fewer parts first."""
    parts = F.regexp_extract_all(F.upper(name), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    digits = lambda p: F.regexp_replace(p, "^0+", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits(p)).cast("string"), 10, "0"), digits(p))).otherwise(p)), "\u0001")


def html_encode(text: Column) -> Column:
    """Marks of the markup as entities; characters 160 to 255 and those outside of the basic plane by number."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    code = lambda c: F.ascii(c)
    number = lambda c: F.when(code(c).between(160, 255) | (code(c) > 0xFFFF), F.concat(F.lit("&#"), code(c).cast("string"), F.lit(";"))).otherwise(c)
    return F.when(out.rlike("[\\u00A0-\\u00FF\\x{10000}-\\x{10FFFF}]"), F.array_join(F.transform(F.split(out, ""), number), "")).otherwise(out)


def clean_font_name(name: Column) -> Column:
    """Family of a font name: without a subset prefix of six characters, style and maker's suffix, its words apart; null if nothing is left."""
    out = F.when(F.locate("+", name) == 7, F.substring(name, 8, 1 << 20)).otherwise(name)
    for pattern, by in ((FONT_STYLE, ""), (FONT_MAKER, ""), ("(?<=[a-z])(?=[A-Z])", " ")):
        out = F.regexp_replace(out, pattern, by)
    return F.nullif(trimmed(out), F.lit(""))


def font_bold(name: Column, weight: Column) -> Column:
    return F.coalesce(weight >= 600, F.lit(False)) | F.coalesce(name.rlike(FONT_BOLD), F.lit(False))


def font_italic(name: Column, flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | F.coalesce(name.rlike(FONT_ITALIC), F.lit(False))


def _named(label: Column, names: dict[str, str], other: str) -> Column:
    found = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(found, F.lower(label)), F.lit(other))


def parse_language(label: Column) -> Column:
    """Language of a command-line label; English for all that it doesn't know."""
    return _named(label, LANGUAGE_NAMES, "English")


def parse_format(label: Column) -> Column:
    """Output format of a command-line label; Docx for all that it doesn't know."""
    return _named(label, FORMAT_NAMES, "Docx")
