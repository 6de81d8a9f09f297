"""Line filling, indentation, widths and numerals for the text writers (plain Python)."""

from __future__ import annotations

import re
import unicodedata

from folioflow.functions.text import WIDE, ZERO
from folioflow.operators.template import _roman

#: Marks of inline pieces: a breakable blank, a soft line end and a forced one (characters that no text may hold).
BLANK, SOFT, HARD = "\ue000", "\ue001", "\ue002"


#: Characters that may take no column or two (the marks are none of them).
_ODD = re.compile("[\u0300-\udfff\ue003-\U0010ffff]")


def width(s: str) -> int:
    if s.isascii() or not _ODD.search(s):
        return len(s)
    return sum(0 if any(a <= ord(c) <= b for a, b in ZERO) or unicodedata.combining(c) else 2 if any(a <= ord(c) <= b for a, b in WIDE) else 1 for c in s)


def fill(s: str, columns: int = 72, wrap: str = "auto", hard: str = "\n") -> str:
    """Marks become blanks and line ends: auto fills lines, none joins them, preserve keeps soft ends."""
    lines = []
    for part in s.split(HARD):
        if wrap == "preserve":
            lines.append(part.replace(SOFT, "\n").replace(BLANK, " "))
            continue
        words = [w for w in part.replace(SOFT, BLANK).split(BLANK) if w]
        if wrap == "none":
            lines.append(" ".join(words))
            continue
        plain = "\n" not in part
        size = len if plain and not _ODD.search(part) else width
        out, a, col = [], 0, 0
        for k, w in enumerate(words):
            head = size(w if plain else w.split("\n", 1)[0])
            if col and col + 1 + head > columns:
                out.append(" ".join(words[a:k]))
                a, col = k, 0
            elif k > a:
                col += 1
            col = col + head if plain or "\n" not in w else width(w.rsplit("\n", 1)[1])
        out.append(" ".join(words[a:]))
        lines.append("\n".join(out))
    return hard.join(lines)


def indent(s: str, first: str, rest: str) -> str:
    return "\n".join((first if i == 0 else rest) + line if line else (first.rstrip() if i == 0 else "") for i, line in enumerate(s.split("\n")))


def pad(s: str, n: int, align: str) -> str:
    gap = max(0, n - width(s))
    if align == "AlignRight":
        return " " * gap + s
    if align == "AlignCenter":
        return " " * (gap // 2) + s + " " * (gap - gap // 2)
    return s + " " * gap


def alpha(n: int) -> str:
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(97 + r) + out
    return out


def numeral(n: int, style: str) -> str:
    if style.endswith("Alpha") and n > 0:
        s = alpha(n)
    elif style.endswith("Roman") and 0 < n < 4000:
        s = _roman(n)
    else:
        return str(n)
    return s.upper() if style.startswith("Upper") else s


def marker(n: int, style: str, delim: str) -> str:
    s = numeral(n, style)
    return f"({s})" if delim == "TwoParens" else f"{s})" if delim == "OneParen" else f"{s}."
