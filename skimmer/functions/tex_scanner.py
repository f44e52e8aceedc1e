"""LaTeX commands to plain text in one scan, left to right.

Each command is looked up once by its whole name: a known macro, an accent, a letter with a name, a sign. Arguments are found by a table of
matching braces, and what they hold is scanned where it stands, however deep; what a macro drops is jumped over. So a text takes
time in proportion to its length, whatever it holds.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left

# What stands for a macro. After the name: * a star that may follow, [ a bracket that may follow, ] any number of
# brackets, d an argument that is dropped, t one that is kept ($1, $2: in order of the arguments kept), n a name in braces or without,
# s white space that goes too, + letters that may follow the name and stay.
MACROS = {
    "label": ("d", ""), "index": ("d", ""),
    "footnote": ("t", " ($1)"),
    "section": ("*t", "\n\n=== $1 ===\n"), "subsection": ("*t", "\n--- $1 ---\n"), "subsubsection": ("*t", "\n$1\n"),
    "caption": ("t", "Caption: $1"),
    "textbf": ("t", "$1"), "textit": ("t", "$1"), "emph": ("t", "$1"), "texttt": ("t", "$1"), "textsc": ("t", "$1"), "textsf": ("t", "$1"),
    "cite": ("*[d", "[ref]"), "ref": ("d", "?"), "eqref": ("d", "(?)"),
    "url": ("t", "$1"), "href": ("tt", "$2 ($1)"),
    "item": ("s", "\n- "),
    "title": ("t", "$1"), "author": ("t", "$1"), "date": ("t", "$1"),
    "maketitle": ("", ""), "centering": ("", ""), "noindent": ("", ""),
    "hspace": ("*d", ""), "vspace": ("*d", ""), "newpage": ("", ""), "clearpage": ("", ""), "cleardoublepage": ("", ""),
    "par": ("", "\n\n"), "qquad": ("+", "  "), "quad": ("+", " "), "left": ("", ""), "right": ("", ""),
    "mathbb": ("t", "$1"), "mathcal": ("t", "$1"), "mathbf": ("t", "$1"), "mathit": ("t", "$1"), "mathrm": ("t", "$1"), "mathfrak": ("t", "$1"), "mathsf": ("t", "$1"), "mathtt": ("t", "$1"),
    "operatorname": ("*t", "$1"), "overline": ("t", "$1"), "underline": ("t", "$1"),
    "sqrt": ("[t", "sqrt($1)"), "frac": ("tt", "($1/$2)"),
    "begin": ("d[", ""), "end": ("d[", ""),
    "includegraphics": ("[t", "[Figure: $1]"),
    "input": ("d", ""), "include": ("d", ""), "usepackage": ("[d", ""),
    "newcommand": ("*n]d", ""), "renewcommand": ("*n]d", ""), "DeclareMathOperator": ("*dd", ""),
    "bibitem": ("[d", ""), "bibliographystyle": ("d", ""),
}
#: Other names that begin so keep their argument.
STYLE = "text"
# Letters with a name of their own.
LETTERS = {"ss": "ß", "SS": "SS", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å", "o": "ø", "O": "Ø", "i": "ı", "j": "ȷ", "l": "ł", "L": "Ł"}
# Accent commands and the combining mark of each.
MARKS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "u": "\u0306", "c": "\u0327", "v": "\u030c", "H": "\u030b", "r": "\u030a", "d": "\u0323", "b": "\u0331", "k": "\u0328"}

_TOKEN = re.compile(r"\\(?:([A-Za-z]+)|(.?))|[{}~]", re.S)
_NAME = re.compile(r"\{?\\\w+\}?", re.A)
_ACCENT = re.compile(r"\\(?:(['`^\"~=.])\s*(?:\{\s*([A-Za-z])\s*\}|([A-Za-z]))|([uvHcdbrk])(?:\s*\{\s*([A-Za-z])\s*\}|\s+([A-Za-z])(?![A-Za-z])))")
_OPEN_NAME = re.compile("|".join(name for name, (spec, _) in MACROS.items() if "+" in spec))
_MACROS = {name: (spec, re.split(r"\$(\d)", shown)) for name, (spec, shown) in MACROS.items()}


def places(text: str) -> list[int]:
    """Where tokens may begin, in order: each sign is looked for by itself, which is much faster than any pattern."""
    out = []
    for sign in "\\{}~":
        at = text.find(sign)
        while at >= 0:
            out.append(at)
            at = text.find(sign, at + 1)
    out.sort()
    return out


def braces(text: str, spots: list[int] | None = None) -> dict[int, int]:
    """Where each brace that opens is closed; braces after a backslash, and those without a partner, are no braces. ``spots``: the text's ``places``, if they are known."""
    out, open_, free = {}, [], 0
    for at in places(text) if spots is None else spots:
        if at < free:
            continue
        sign = text[at]
        if sign == "\\":
            free = at + 2
        elif sign == "{":
            open_.append(at)
        elif sign == "}" and open_:
            out[open_.pop()] = at
    return out


def composed(command: str, letter: str) -> str:
    """The letter with the command's mark: one sign where Unicode has one, else both."""
    return unicodedata.normalize("NFC", letter + MARKS[command])


def _arguments(text: str, at: int, spec: str, partner: dict[int, int]) -> tuple[int, list[tuple[int, int]]] | None:
    """Where a use that begins its arguments at ``at`` ends, and the spans of the arguments that it keeps; None if one is missing."""
    kept = []
    for kind in spec:
        here = text[at : at + 1]
        if kind == "*":
            at += here == "*"
        elif kind in "[]":
            while text[at : at + 1] == "[" and (end := text.find("]", at)) > 0:
                at = end + 1
                if kind == "[":
                    break
        elif kind == "s":
            while text[at : at + 1].isspace():
                at += 1
        elif kind == "+":
            continue
        elif kind == "n":
            if not (m := _NAME.match(text, at)):
                return None
            at = m.end()
        else:
            if here != "{" or at not in partner:
                return None
            if kind == "t":
                kept.append((at + 1, partner[at]))
            at = partner[at] + 1
    return at, kept


class _Open:
    """A macro whose arguments are being scanned: what came before it, its spans, what they gave."""

    def __init__(self, before: list[str], spans: list[tuple[int, int]], shown: list[str], end: int):
        self.before, self.spans, self.shown, self.end, self.given = before, spans, shown, end, []


def scanned(text: str, signs: dict[str, str] | None = None, macros: bool = True) -> str:
    """``text`` with its macros replaced and, if ``signs`` are given (by name with the backslash), its accents, letters and signs too."""
    spots, next_ = places(text), 0
    partner = braces(text, spots) if macros else {}
    out: list[str] = []
    open_: list[_Open] = []
    at = 0
    while True:
        if open_ and at == open_[-1].spans[len(open_[-1].given)][1]:  # an argument ends, maybe just where it began
            own = open_[-1]
            own.given.append("".join(out))
            if len(own.given) < len(own.spans):
                out, at = [], own.spans[len(own.given)][0]
            else:
                open_.pop()
                own.before += [own.given[int(x) - 1] if k % 2 else x for k, x in enumerate(own.shown)]
                out, at = own.before, own.end
            continue
        next_ = bisect_left(spots, at, next_)
        stop = spots[next_] if next_ < len(spots) else len(text)
        out.append(text[at:stop])
        at = stop
        if next_ == len(spots):
            break
        if open_ and at == open_[-1].spans[len(open_[-1].given)][1]:
            continue
        m = _TOKEN.match(text, stop)
        at, name = m.end(), m[1]
        if m[0] in "{}":
            out.append(m[0])
            continue
        if m[0] == "~":
            out.append((signs or {}).get("~", "~"))
            continue
        if macros and (m[2] == "\\"):
            out.append("\n")
            continue
        known = _MACROS.get(name) if macros and name else None
        if known is None and macros and name and (prefix := _OPEN_NAME.match(name)):
            known, at = _MACROS[prefix[0]], stop + 1 + prefix.end()
        if known is None and macros and name and name.startswith(STYLE) and len(name) > len(STYLE) and name.islower():
            known = ("t", ["", "1", ""])
            if signs is not None and "\\" + name in signs:  # a sign, after which empty braces go
                out.append(signs["\\" + name])
                at += 2 * text.startswith("{}", at)
                continue
        if known and (found := _arguments(text, at, known[0], partner)):
            end, spans = found
            if spans:
                open_.append(_Open(out, spans, known[1], end))
                out, at = [], spans[0][0]
            else:
                out.append(known[1][0])
                at = end
            continue
        if signs is None:
            out.append(m[0])
            continue
        accent = _ACCENT.match(text, stop)
        if accent:
            out.append(composed(accent[1] or accent[4], accent[2] or accent[3] or accent[5] or accent[6]))
            at = accent.end()
        elif text.startswith(r"\t{oo}", stop):
            out.append("o\u0361o")
            at = stop + 6
        elif name in LETTERS:
            out.append(LETTERS[name])
            at += 2 * text.startswith("{}", at)
        elif m[0] in signs:
            out.append(signs[m[0]])
        elif name:
            out.append(m[0])
        else:  # the sign after a backslash without meaning is a sign of its own
            out.append("\\")
            at = stop + 1
    # what is still open here can't be: spans end at braces of the text
    return "".join(out)
