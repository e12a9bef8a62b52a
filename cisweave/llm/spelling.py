"""Sentences in a spelling-insensitive form: look-alike letters, digits for letters, spaced or dotted letters, stretched
letters, masks, quoting signs and line breaks are undone; `manner` tells which of them, and how a sentence was said. Plain
Python, used inside Arrow-batched UDFs."""

from __future__ import annotations

import re

from cisweave.llm.words import cased

#: fixed values: letters of other scripts that look like Latin ones, and signs written for letters
ALIKE = "аеорсухіјѕԁһкмтвнгꜱɡαοερνι"
LOOK_ALIKE = str.maketrans(ALIKE, "aeopcyxijsdhkmtbhrsgaoepvi")
LEET = str.maketrans("0134579@$€!|", "oieastgaseil")

LINE_SIGN = re.compile(r"^[ \t]*(?:(?:>+|#+|//+|--+|\*+|-|;+|%+|\d+\.)[ \t]+)+", re.M)
ADDRESS = re.compile(r"(?:https?://|www\.)\S+")
SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*·]{1,2}){3,}[^\W\d_](?![^\W_])")
END = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+|\n{2,}")
TOKEN = re.compile(r"[a-z0-9@$€!|*]*[a-z*][a-z0-9@$€!|*]*|\d+(?:[.,]\d+)*")
#: words of a window, and by how many the next one begins later, in a sentence of more words
WINDOW, STEP, LETTERS = 48, 36, 64
STRETCHED = re.compile(r"([a-z])\1{2,}")

#: manners of saying a sentence, one bit each: addressed to someone, letters disguised
TO_SOMEONE, DISGUISED = 1, 2
MANNERS = (TO_SOMEONE, DISGUISED)
TOWARDS = re.compile(r"^\W*(?:@\w+|(?:re|to|an|a|para|pour)\b:?\s*[#@]?\w*\d\w*)\s*[:,]", re.I)
MIXED = re.compile(f"[a-z][{ALIKE}]|[{ALIKE}][a-z]", re.I)
#: letters written as signs, or masked, within a word
SIGNS = re.compile(r"(?<![^\W_])[a-z]+(?:[0134579@$€|]+[a-z]+)+(?![^\W_])|(?<![^\W_])[a-z]\*{2,}", re.I)
#: stands where spaced letters were joined, until sentences are told apart
MARK = "⟊"


def _join_spaced(m: re.Match) -> str:
    return re.sub(r"[^\w]|_", "", m.group()) + MARK


def _token(w: str) -> str:
    if w[0].isdigit() and not re.search("[a-z]", w):
        return "0"
    if "*" in w and len(w.replace("*", "")) <= 3:
        return "*"
    w = w.strip("!|*")
    if not w:
        return ""
    if not w.isalpha():
        w = re.sub("[^a-z]", "", w.translate(LEET))
    return STRETCHED.sub(r"\1", w)


def _manner(s: str) -> int:
    m = DISGUISED if MARK in s or SIGNS.search(s) or (not s.isascii() and MIXED.search(s)) else 0
    if TOWARDS.match(s):
        m |= TO_SOMEONE
    return m


def sentences_said(text: str | None) -> list[tuple[str, int]]:
    """Normalised sentences of the whole text, code included, with their manners; numbers are 0, masked words *."""
    if not text:
        return []
    t = LINE_SIGN.sub("", text.replace("\r\n", "\n").replace("```", "\n\n"))
    out = []
    # a single line break continues a sentence; an empty line ends it
    for paragraph in re.split(r"\n[ \t]*\n", t):
        p = ADDRESS.sub(" ", cased(paragraph.replace("\n", " ")))
        p = SPACED.sub(_join_spaced, p)
        for raw in END.split(p):
            s = raw.lower().translate(LOOK_ALIKE).replace("'", "").replace(MARK, "")
            w = [x for x in map(_token, TOKEN.findall(s)) if x]
            if any(len(x) > LETTERS for x in w):
                w = [x[i : i + LETTERS] for x in w for i in range(0, len(x), LETTERS)]
            if w:
                m = _manner(raw)
                out += [(" ".join(w[i : i + WINDOW]), m) for i in range(0, max(1, len(w) - WINDOW + STEP), STEP)]
    return out


def sentences(text: str | None) -> list[str]:
    """Normalised sentences of the whole text."""
    return [s for s, _ in sentences_said(text)]
