"""Words of a text without what does not matter in a comparison: case, accents and their encoding, punctuation, markup,
quoting and comment signs, line breaks, escapes and invisible characters. Plain Python, used inside Arrow-batched UDFs.
"""

from __future__ import annotations

import html
import re
import unicodedata

TAG = re.compile(r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>|<!--.*?-->", re.S)
INLINE = re.compile(r"</?(?:b|i|em|strong|u|s|span|small|sub|sup|mark|code|tt|font|a)(?:\s[^<>]*)?>", re.I)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});")
UNICODE_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})")
ESCAPE = re.compile(r"\\[nrtbf\"'/]")
# UTF-8 read as Latin-1 or Windows-1252: a lead byte and its continuation
BROKEN = re.compile("[\u00c2-\u00c5\u00e2][\u0080-\u00bf\u20ac\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\u017d\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\u017e\u0178]{1,2}")
APOSTROPHE = re.compile(r"(?<=\w)['\u2019\u02bc`](?=\w)")
HYPHENATED = re.compile(r"(?<=[^\W\d_])[-\u2010]\r?\n[>#/*\s-]*(?=[^\W\d_])")
NUMBER_SIGN = re.compile(r"(?<=\d)[.,](?=\d)")
WORD = re.compile(r"[^\W_]+")


def _mend(m: re.Match) -> str:
    s = m.group()
    for code in ("cp1252", "latin-1"):
        try:
            return s.encode(code).decode("utf-8")
        except UnicodeError:
            continue
    return s


def _char(m: re.Match) -> str:
    return chr(int(m.group(1) or m.group(2), 16))


def plain(text: str) -> str:
    """Lower-case text without markup, escapes, accents and invisible characters."""
    return cased(text).lower()


def cased(text: str) -> str:
    """plain() with the letters' case as it was."""
    t = text
    if "\\" in t:
        t = ESCAPE.sub(" ", UNICODE_ESCAPE.sub(_char, t))
    if "&" in t:
        t = ENTITY.sub(lambda m: html.unescape(m.group()), t)
    if "<" in t:
        t = TAG.sub(" ", INLINE.sub("", t))
    if not t.isascii():
        t = BROKEN.sub(_mend, t)
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.category(c) not in ("Mn", "Cf", "Me", "Co", "Cn"))
    return t


def words(text: str | None) -> list[str]:
    """The words of a text in order; a number with a decimal sign, or a word with an apostrophe, is one word."""
    if not text:
        return []
    t = APOSTROPHE.sub("", plain(text))
    if "\n" in t:
        t = HYPHENATED.sub("", t)
    return WORD.findall(NUMBER_SIGN.sub("", t))
