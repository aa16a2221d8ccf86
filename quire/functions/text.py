"""Scalar functions over text, as Spark columns. Offsets and lengths count code points."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes: Unicode's, not only U+0020.
UNICODE_SPACE = "\\s\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
WORD = "[\\p{IsAlphabetic}\\p{N}_]"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+$", "")


def literal_pattern(needle: str, *, case_sensitive: bool = False, whole_word: bool = False) -> str:
    """A Java pattern for a literal; case is folded for ASCII letters alone, and neighbours that are letters, digits or _ forbid a whole word."""
    quoted = re.sub(r"([\\\[\](){}.*+?^$|#&~<>\-])", r"\\\1", needle)
    body = quoted if case_sensitive else f"(?i:{quoted})"
    return f"(?<!{WORD}){body}(?!{WORD})" if whole_word else body


def sanitize(text: Column) -> Column:
    """Without C0 controls but tab, line feed and carriage return."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")


def truncate(text: Column, most: int) -> Column:
    """The first characters, and an ellipsis where some were cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def elide(text: Column, most: int) -> Column:
    """At most so many characters, the ellipsis included."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, max(0, most - 1)), F.lit("…"))).otherwise(text)


def escape_xml(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def norm_label(text: Column) -> Column:
    """Without white space and the punctuation that labels are written with."""
    return F.regexp_replace(text, f"[{UNICODE_SPACE}()·:：'\"※]", "")


def normalize_css(prop: Column, value: Column) -> Column:
    """Hex colours in lower case and full length; whole numbers before px, pt, % and em without a fraction."""
    v = F.btrim(value)
    short = F.regexp_extract(v, "^#([0-9a-fA-F])([0-9a-fA-F])([0-9a-fA-F])$", 0) != ""
    digits = [F.substring(v, i, 1) for i in (2, 3, 4)]
    colour = F.when(short, F.lower(F.concat(F.lit("#"), *[d for x in digits for d in (x, x)]))).when(F.rlike(v, F.lit("^#[0-9a-fA-F]{6}$")), F.lower(v))
    number = F.regexp_extract(v, "^([0-9.+-]+)\\s*(px|pt|%|em)$", 1)
    unit = F.regexp_extract(v, "^([0-9.+-]+)\\s*(px|pt|%|em)$", 2)
    amount = number.try_cast("double")
    whole = F.when(amount == F.floor(amount), F.concat(amount.cast("long").cast("string"), unit))
    trimmed = F.concat(F.regexp_replace(F.regexp_replace(number, "^\\+", ""), "(\\.[0-9]*?)0+$", "$1"), unit)
    sized = F.when((unit != "") & amount.isNotNull(), F.coalesce(whole, trimmed))
    return F.coalesce(F.when(F.contains(prop, F.lit("color")), colour), sized, v)


def hex_colour(text: Column) -> Column:
    """#RRGGBB in upper case, or null."""
    return F.when(F.rlike(text, F.lit("^#?[0-9a-fA-F]{6}$")), F.concat(F.lit("#"), F.upper(F.right(text, F.lit(6)))))


def code_fence_body(text: Column) -> Column:
    """What a leading ``` fence holds, or the trimmed text."""
    found = F.regexp_extract(trim(text), "(?s)^```[A-Za-z]*\\n(.*?)\\n?```$", 1)
    return F.when(found != "", found).otherwise(trim(text))


#: Markers of font families; Korean markers come before Latin ones, serif before gothic in each.
SERIF_KO = ("바탕", "명조", "궁서", "순명조", "신명")
GOTHIC_KO = ("돋움", "돋음", "고딕", "굴림", "돋보임", "그래픽", "안상수")
SERIF_EN = ("batang", "myeongjo", "myungjo", "gungsuh", "gungseo", "serif", "times", "georgia", "garamond", "minion")
GOTHIC_EN = ("dotum", "gulim", "gothic", "sans", "malgun", "arial", "helvetica", "verdana", "tahoma", "pretendard", "nanum gothic", "nanumgothic")


def _holds(text: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(text, F.lit(m))
    return out


def font_class(name: Column) -> Column:
    """serif, gothic or other, by the name."""
    low = F.lower(name)
    return F.when(_holds(name, SERIF_KO), "serif").when(_holds(name, GOTHIC_KO), "gothic").when(_holds(low, SERIF_EN), "serif").when(_holds(low, GOTHIC_EN), "gothic").otherwise("other")


def panose_class(family: Column, style: Column) -> Column:
    """serif or gothic by two PANOSE bytes, where they tell."""
    return F.when((family == 2) & style.between(2, 10), "serif").when((family == 2) & style.between(11, 15), "gothic")


#: Code-point ranges.
FULL_WIDTH = ((0x1100, 0x11FF), (0x2E80, 0x2FDF), (0x3000, 0x303F), (0x3040, 0x30FF), (0x3130, 0x318F), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA960, 0xA97F), (0xAC00, 0xD7A3), (0xD7B0, 0xD7FF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF))
SCRIPTS = {
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7A3), (0xD7B0, 0xD7FF)),
    "hanja": ((0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)),
    "japanese": ((0x3040, 0x30FF),),
    "latin": ((0x0000, 0x024F),),
}


def _class(ranges: tuple[tuple[int, int], ...]) -> str:
    return "[" + "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in ranges) + "]"


def count_class(text: Column, ranges: tuple[tuple[int, int], ...]) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, _class(ranges), ""))


def script_counts(text: Column) -> dict[str, Column]:
    found = {k: count_class(text, r) for k, r in SCRIPTS.items()}
    return found | {"other": F.length(text) - sum(found.values(), F.lit(0))}


def flat_width(text: Column, size: Column | int = 1000) -> Column:
    """The sum of flat advances: full-width characters one em, space and tab 0.3, others half."""
    size = size if isinstance(size, Column) else F.lit(size)
    full, gaps = count_class(text, FULL_WIDTH), F.length(text) - F.length(F.translate(text, " \t", ""))
    return (full * 10 + gaps * 3 + (F.length(text) - full - gaps) * 5) * size / 10.0


def nice_ceil(value: Column) -> Column:
    """The least of 1, 2, 5 times a power of ten that is no less; 1 for what is not positive."""
    base = F.pow(F.lit(10.0), F.floor(F.log10(value)))
    n = value / base
    return F.when(value > 0, F.when(n <= 1, 1.0).when(n <= 2, 2.0).when(n <= 5, 5.0).otherwise(10.0) * base).otherwise(1.0)


def mm_to_units(mm: Column) -> Column:
    """1/7200 inch units."""
    return F.round(mm * 7200 / 25.4).cast("long")
