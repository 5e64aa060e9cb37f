"""Decoding of entity spellings and folded characters, encoding of glyphs, newline and edge rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rx import CLOSE, OPEN, SPACES

#: Entity spellings that decode to each glyph.
DECODE = {
    '"': "&ldquo; &quot; &#8220; &#34;",
    "«": "&laquo; &#171; &bdquo; &#8222; &#8223;",
    "»": "&raquo; &#187; &rdquo; &#8221;",
    "\u00a0": "&nbsp; &#160;",
    "\u202f": "&#8239; &#x202F; &#x202f;",
    "\u2009": "&thinsp; &#8201;",
    "–": "&ndash; &#8211;",
    "—": "&mdash; &#8212; &#151;",
    "−": "&minus; &#8722;",
    "≡": "&equiv; &#8801;",
    "″": "&Prime; &#8243;",
    "…": "&hellip; &#8230; &#133; &#0133;",
    "≠": "&ne; &#8800;",
    "≤": "&le; &#8804;",
    "≥": "&ge; &#8805;",
    "≅": "&cong; &#8773;",
    "½": "&frac12; &#189;",
    "¼": "&frac14; &#188;",
    "¾": "&frac34; &#190;",
    "±": "&plusmn; &#177;",
    "™": "&trade; &#8482; &#153;",
    "®": "&reg; &#174;",
    "©": "&copy; &#169;",
    "§": "&sect; &#167;",
    "€": "&euro; &#8364;",
    "₽": "&#8381;",
    "\u0301": "&#769;",
    "‘": "&lsquo; &#8216;",
    "’": "&rsquo; &#8217;",
    "×": "&times; &#215;",
    "°": "&deg; &#176;",
    "№": "&#8470;",
    "←": "&larr; &#8592;",
    "→": "&rarr; &#8594;",
    "²": "&sup2; &#178;",
    "³": "&sup3; &#179;",
}
#: Single characters that fold to another.
FOLD = {"“": '"', "„": "«", "‟": "«", "”": "»", "\u2010": "-", "\u2012": "-"}
#: Entities that glyphs are written as.
ENCODE = {
    "\u00a0": "&nbsp;", "\u202f": "&#8239;", "\u2009": "&thinsp;", "«": "&laquo;", "»": "&raquo;", "„": "&bdquo;", "“": "&ldquo;", "‘": "&lsquo;", "’": "&rsquo;", "″": "&Prime;",
    "—": "&mdash;", "–": "&ndash;", "−": "&minus;", "…": "&hellip;", "©": "&copy;", "®": "&reg;", "™": "&trade;", "§": "&sect;", "€": "&euro;", "₽": "&#8381;", "°": "&deg;",
    "×": "&times;", "±": "&plusmn;", "№": "&#8470;", "≠": "&ne;", "≤": "&le;", "≥": "&ge;", "≅": "&cong;", "≡": "&equiv;", "←": "&larr;", "→": "&rarr;", "²": "&sup2;", "³": "&sup3;",
    "½": "&frac12;", "¼": "&frac14;", "¾": "&frac34;", "\u0301": "&#769;",
}


_FOLD, _GLYPH = re.compile("[" + "".join(FOLD) + "]"), re.compile("[" + "".join(ENCODE) + "]")
_SPELLED = {name: glyph for glyph, names in DECODE.items() for name in names.split()}
_SPELLING = re.compile("|".join(sorted(map(re.escape, _SPELLED), key=len, reverse=True)))
_NUMERIC = re.compile(r"&#(?:([0-9]{1,7})|[xX]([0-9a-fA-F]{1,6}));")
_REFERENCES = re.compile(r"(?:\s|&[#0-9A-Za-z]+;)+")
_OPAQUE = re.compile(f"{OPEN}[NHWF]\\d+{CLOSE}|</?[a-zA-Z!?][^<>]*>")


# --- texts ---
def folds(t: str) -> bool:
    return not t.isascii() and ("“" in t or "„" in t or "‟" in t or "”" in t or "\u2010" in t or "\u2012" in t)


def decoded(t: str) -> str:
    """Spellings to glyphs in one pass; &amp;, &lt; and &gt; stay, so nothing decodes twice."""
    if folds(t):
        t = _FOLD.sub(lambda m: FOLD[m[0]], t)
    return _SPELLING.sub(lambda m: _SPELLED[m[0]], t) if "&" in t else t


def encoded(t: str, xml: bool = False) -> str:
    """Glyphs to entities; XML knows five names, so there they are numeric."""
    if t.isascii():
        return t
    return _GLYPH.sub((lambda m: f"&#{ord(m[0])};") if xml else (lambda m: ENCODE[m[0]]), t)


def line_ends(t: str) -> str:
    if "\r" in t:
        t = t.replace("\r\n", "\n").replace("\r", "\n")
    return re.sub("\n{3,}", "\n\n", t) if "\n\n\n" in t else t


def _blank(t: str) -> bool:
    if not t.strip(SPACES):
        return True
    if not _REFERENCES.fullmatch(t):
        return False

    def read(m: re.Match) -> str:
        code = int(m[1]) if m[1] else int(m[2], 16)
        return chr(code) if code <= 0x10FFFF else m[0]

    return not _NUMERIC.sub(read, decoded(t)).strip(SPACES)


def shows_nothing(t: str) -> bool:
    """Whether a content is white space once decoded, leaving out tags and what shows nothing itself."""
    return _blank(t) or ("<" in t or OPEN in t) and _blank(_OPAQUE.sub("", t))


def units(t: str) -> int:
    """Length in UTF-16 code units."""
    return len(t) if t.isascii() else len(t.encode("utf-16-le", "surrogatepass")) // 2


# --- columns ---
def decode(c: Column) -> Column:
    """The same as decoded, as a column."""
    folded = F.translate(c, "".join(FOLD), "".join(FOLD.values()))
    for glyph, names in DECODE.items():
        folded = F.regexp_replace(folded, F.lit("|".join(names.split())), F.lit(glyph))
    return folded


def _encode(c: Column, names: dict[str, str]) -> Column:
    for glyph, name in names.items():
        c = F.replace(c, F.lit(glyph), F.lit(name))
    return c


def encode_html(c: Column) -> Column:
    return _encode(c, ENCODE)


def encode_xml(c: Column) -> Column:
    """Numeric references only: XML knows five names."""
    return _encode(c, {g: f"&#{ord(g)};" for g in ENCODE})


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units: two for each character beyond the basic plane."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]+", ""))
